"""Queries on entities, curation, retrieval, reports and jobs (E*, J*, A*, W*, T*, X*, G*, V*, R*, C*, D*) with their SQL."""

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import clean, curate, entities, index, report, search, segments, temporal, topk
from ..operators import vectors as cells
from . import fixtures as X
from . import jobs
from .rule_queries import AGE, DYN, IMP, KEYS, NOISE, RATE, RER, SHINGLES, SIMSET, TRIG, WORDS, O, Q, boost_col, has, imp, q

C, LIT = F.col, F.lit
AS = X.AS_OF
NEG = ("worthless", "nicht", "haha")


def csv(col):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), ",")


# --- entities -----------------------------------------------------------------------------------------------------------


@q("e01_rule_entities", r"""r AS (SELECT mid, list_distinct(list_filter(list_concat(regexp_extract_all(content, '\x27([^\x27]+)\x27', 1), regexp_extract_all(content, '"([^"]+)"', 1), list_filter(['App', 'Thnt'], lambda w: contains(content, w)), regexp_extract_all(rest, '[A-Z][a-z]+'), list_filter(regexp_extract_all(rest, '[A-Z][a-zA-Z0-9-]+'), lambda m: NOT regexp_matches(m, '[A-Z][a-z]'))), lambda e: length(e) > 1)) AS es FROM (SELECT mid, content, regexp_replace(regexp_replace(content, '\x27[^\x27]+\x27', chr(10), 'g'), '"[^"]+"', chr(10), 'g') AS rest FROM mem)) SELECT mid, array_to_string(list_sort(list_filter(es, lambda e: len(list_filter(es, lambda o: o <> e AND contains(o, e))) = 0)), ',') AS entities FROM r""")
def e01(s, d):
    es = entities.rule_entities(C("content"), fixed=("App", "Thnt"), numbered=(), quotes=("'([^']+)'", '"([^"]+)"'))
    return X.mem(s, d).select("mid", F.array_join(es, ",").alias("entities"))


@q("e02_builtin_entities", r"SELECT mid, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(content, '(?i)th[_\-]?[a-z]'), regexp_extract_all(content, '(?i)agent[_\-]?\d+')))), ',') AS entities FROM mem")
def e02(s, d):
    return X.mem(s, d).select("mid", F.array_join(entities.builtin_entities(C("content"), (r"th[_\-]?[a-z]", r"agent[_\-]?\d+")), ",").alias("entities"))


DICT = "dict AS (SELECT entity FROM ent GROUP BY entity HAVING count(*) >= 3)"


def dictionary(s, d):
    return X.ent(s, d).groupBy("entity").agg(F.count(LIT(1)).alias("n")).where("n >= 3").select("entity")


@q("e03_learned_matches", f"{DICT} SELECT mid, entity FROM mem, dict WHERE contains(content, entity)")
def e03(s, d):
    return entities.learned_matches(X.mem(s, d), dictionary(s, d))


@q("e04_layered", r"SELECT mid, array_to_string(CASE WHEN len(b) > 0 THEN b WHEN len(l) > 0 THEN l ELSE x END, ',') AS entities, CASE WHEN len(b) > 0 THEN 'builtin' WHEN len(l) > 0 THEN 'learned' WHEN len(x) > 0 THEN 'external' ELSE 'none' END AS source FROM (SELECT mid, list_sort(list_distinct(regexp_extract_all(content, '(?i)worth[a-z]'))) AS b, list_filter(['The', 'Thnt'], lambda w: contains(content, w)) AS l, list_slice(regexp_extract_all(content, '[A-Z][a-z]+'), 1, 1) AS x FROM mem)")
def e04(s, d):
    t = C("content")
    b = entities.builtin_entities(t, ("worth[a-z]",))
    learned = F.filter(F.array(LIT("The"), LIT("Thnt")), lambda w: F.contains(t, w))
    v = entities.layered(b, learned, F.slice(F.regexp_extract_all(t, LIT("[A-Z][a-z]+"), LIT(0)), 1, 1))
    return X.mem(s, d).select("mid", v.alias("v")).select("mid", F.array_join("v.entities", ",").alias("entities"), "v.source")


@q("e05_learn", f"{DICT}, f AS (SELECT entity, count(*) AS use_count FROM ent WHERE entity NOT IN (SELECT entity FROM dict) GROUP BY entity) SELECT entity, CAST({AS} AS BIGINT) AS first_seen_s, CAST({AS} AS BIGINT) AS last_used_s, use_count FROM f ORDER BY use_count DESC, entity LIMIT greatest(0, 1000 - (SELECT count(*) FROM dict))")
def e05(s, d):
    return entities.learn(X.ent(s, d).select("entity"), dictionary(s, d), AS)


GEN = "n AS (SELECT DISTINCT entity FROM ent WHERE mid % 2 = 0), o AS (SELECT DISTINCT entity AS e FROM ent WHERE mid % 2 = 1), g AS (SELECT entity, e FROM n JOIN o ON length(e) >= ceil(length(entity) / 2.0) AND left(entity, CAST(ceil(length(entity) / 2.0) AS INT)) = left(e, CAST(ceil(length(entity) / 2.0) AS INT)) UNION ALL SELECT entity, entity FROM n), b AS (SELECT entity, min(e) AS lo, max(e) AS hi FROM g GROUP BY entity HAVING count(*) >= 3), p AS (SELECT entity, left(lo, CAST(list_max(list_filter(range(0, least(length(lo), length(hi)) + 1), lambda i: left(lo, CAST(i AS INT)) = left(hi, CAST(i AS INT)))) AS INT)) AS prefix FROM b), t AS (SELECT g.entity, prefix, substring(e, length(prefix) + 1) AS s FROM g JOIN p ON g.entity = p.entity), k AS (SELECT entity, prefix, bool_and(regexp_full_match(s, '[a-z]+')) AS low FROM t GROUP BY entity, prefix)"


@q("e06_generalise", f"{GEN} SELECT entity, prefix || '[a-z]+' AS pattern FROM k WHERE low AND prefix <> ''")
def e06(s, d):
    e = X.ent(s, d)
    return entities.generalise(e.where("mid % 2 = 0").select("entity").distinct(), e.where("mid % 2 = 1").select("entity").distinct())


@q("e07_usage", f"l AS (SELECT entity, CAST({AS} - 400 * 86400 AS BIGINT) AS first_seen_s, CAST({AS} - 100 * 86400 AS BIGINT) AS last_used_s, count(*) AS use_count FROM ent WHERE mid % 2 = 0 GROUP BY entity), h AS (SELECT entity, count(*) AS n, min(created_s) AS lo, max(created_s) AS hi FROM ent JOIN mem ON ent.mid = mem.mid WHERE ent.mid % 2 = 1 GROUP BY entity) SELECT coalesce(l.entity, h.entity) AS entity, coalesce(first_seen_s, lo) AS first_seen_s, greatest(last_used_s, hi) AS last_used_s, coalesce(use_count, 0) + coalesce(n, 0) AS use_count FROM l FULL JOIN h ON l.entity = h.entity")
def e07(s, d):
    e = X.ent(s, d)
    known = e.where("mid % 2 = 0").groupBy("entity").agg(F.count(LIT(1)).alias("use_count")).withColumn("first_seen_s", LIT(AS - 400 * 86400).cast("long")).withColumn("last_used_s", LIT(AS - 100 * 86400).cast("long"))
    hits = e.where("mid % 2 = 1").join(X.mem(s, d).select("mid", C("created_s").alias("ts_s")), "mid").select("entity", "ts_s")
    return entities.use(known, hits)


@q("e08_cleanup", f"SELECT entity, max(created_s) AS last_used_s FROM ent JOIN mem ON ent.mid = mem.mid GROUP BY entity HAVING max(created_s) >= {AS} - 10 * 86400")
def e08(s, d):
    used = X.ent(s, d).join(X.mem(s, d).select("mid", "created_s"), "mid").groupBy("entity").agg(F.max("created_s").alias("last_used_s"), F.min("created_s").alias("first_seen_s"))
    return entities.cleanup(used, AS, 10).select("entity", "last_used_s")


@q("e09_merge_external", "r AS (SELECT mid, list(entity) AS es FROM ent GROUP BY mid) SELECT mid, array_to_string(list_sort(list_distinct(list_concat(es, CASE WHEN mid % 3 = 0 THEN ['Extra', 'The'] ELSE [] END))), ',') AS entities FROM r")
def e09(s, d):
    rules = X.ent(s, d).groupBy("mid").agg(F.collect_list("entity").alias("entities"))
    ext = X.mem(s, d).where("mid % 3 = 0").select("mid", F.array(LIT("Extra"), LIT("The")).alias("entities"))
    return entities.merge_external(rules, ext).select("mid", F.array_join("entities", ",").alias("entities"))


@q("j09_similar_entities", f"{SIMSET} SELECT q, e, round(similarity, 6) AS similarity FROM sim WHERE similarity >= CAST(0.5 AS DOUBLE)")
def j09(s, d):
    names = X.ent(s, d).select(C("entity").alias("q")).distinct()
    # Halves go up as in round, which makes a decimal of each of very many rows.
    return entities.similar_pairs(names).select("q", "e", (F.floor(C("similarity") * 1e6 + 0.5) / 1e6).alias("similarity"))


QE = "qe AS (SELECT DISTINCT qid, e AS q FROM (SELECT qid, unnest(regexp_extract_all(query, '[A-Z][a-z]+')) AS e FROM qry) WHERE length(e) > 1)"
SIMQ = SIMSET.replace("SELECT a.entity AS q, b.entity AS e,", "SELECT a.q AS q, b.entity AS e,").replace("FROM e2 a JOIN e2 b ON a.entity <> b.entity", "FROM (SELECT DISTINCT q FROM qe) a JOIN e2 b ON a.q <> b.entity").replace("a.entity", "a.q")
CAND = "cand AS (SELECT DISTINCT qid, mid, score FROM (SELECT qid, ent.mid FROM qe JOIN ent ON left(ent.entity, 3) = left(qe.q, 3)) c JOIN (SELECT mid AS m2, score FROM mem) m ON c.mid = m.m2)"


def qents(s, d):
    return X.qry(s, d).select("qid", F.explode(F.regexp_extract_all("query", LIT("[A-Z][a-z]+"), LIT(0))).alias("q")).where("length(q) > 1").distinct()


def cands(s, d):
    e = X.ent(s, d)
    c = qents(s, d).withColumn("p", F.substring("q", 1, 3)).join(e.withColumn("p", F.substring("entity", 1, 3)), "p").select("qid", "mid").distinct()
    return c.join(X.mem(s, d).select("mid", "score"), "mid")


@q("f24_isolation_needed", f"{QE}, {SIMQ}, {CAND} SELECT DISTINCT cand.qid FROM cand JOIN ent ON ent.mid = cand.mid JOIN qe ON qe.qid = cand.qid JOIN sim ON sim.q = qe.q AND sim.e = ent.entity WHERE similarity >= CAST(0.5 AS DOUBLE)")
def f24(s, d):
    ce = cands(s, d).join(X.ent(s, d), "mid").select("qid", C("entity").alias("e")).distinct()
    return entities.isolation_needed(qents(s, d), ce)


@q("j10_inhibition", f"{QE}, {SIMQ}, {CAND}, ex AS (SELECT DISTINCT cand.qid, cand.mid FROM cand JOIN ent ON ent.mid = cand.mid JOIN qe ON qe.qid = cand.qid AND qe.q = ent.entity), nr AS (SELECT DISTINCT cand.qid, cand.mid FROM cand JOIN ent ON ent.mid = cand.mid JOIN qe ON qe.qid = cand.qid JOIN sim ON sim.q = qe.q AND sim.e = ent.entity WHERE similarity >= CAST(0.5 AS DOUBLE)) SELECT cand.qid, cand.mid, ex.mid IS NULL AND nr.mid IS NOT NULL AS inhibited, round(CASE WHEN ex.mid IS NULL AND nr.mid IS NOT NULL THEN score * CAST(0.1 AS DOUBLE) ELSE score END, 6) AS score FROM cand LEFT JOIN ex ON ex.qid = cand.qid AND ex.mid = cand.mid LEFT JOIN nr ON nr.qid = cand.qid AND nr.mid = cand.mid")
def j10(s, d):
    return entities.inhibit(cands(s, d), qents(s, d), X.ent(s, d)).select("qid", "mid", "inhibited", F.round("score", 6).alias("score"))


@q("j03_by_entities", f"{DICT} SELECT mem.mid, matched FROM mem JOIN (SELECT mid, string_agg(ent.entity, ',' ORDER BY ent.entity) AS matched FROM ent JOIN dict ON ent.entity = dict.entity GROUP BY mid) m ON m.mid = mem.mid")
def j03(s, d):
    return entities.by_entities(X.mem(s, d).withColumn("final_score", C("score")), X.ent(s, d), dictionary(s, d)).select("mid", "matched")


@q("j05_hydrate", "SELECT mid, coalesce((SELECT string_agg(entity, ',' ORDER BY entity) FROM ent WHERE ent.mid = mem.mid), '') AS entities FROM mem")
def j05(s, d):
    return entities.hydrate(X.mem(s, d), X.ent(s, d)).select("mid", F.array_join("entities", ",").alias("entities"))


# --- curation ------------------------------------------------------------------------------------------------------------

W = WORDS
CONTR = f"({has('lower(n.content)', NEG)} OR (n.created_s > o.created_s AND floor((n.created_s - o.created_s) / 86400.0) > 7))"
EP = "ep AS (SELECT DISTINCT a.mid AS a, b.mid AS b FROM entx a JOIN entx b ON a.entity = b.entity WHERE a.mid IN (SELECT mid FROM mem_new) AND b.mid IN (SELECT mid FROM mem_old))"
CS = "CAST(CASE WHEN floor((n.created_s - o.created_s) / 86400.0) > 7 THEN 0.5 WHEN floor((n.created_s - o.created_s) / 86400.0) > 0 THEN 0.25 WHEN floor((n.created_s - o.created_s) / 86400.0) < -7 THEN -0.5 ELSE 0 END AS DOUBLE) + CAST(CASE WHEN n.confidence - o.confidence > CAST(0.3 AS DOUBLE) THEN 1 WHEN n.confidence - o.confidence > CAST(0.1 AS DOUBLE) THEN 0.5 WHEN n.confidence - o.confidence < CAST(-0.3 AS DOUBLE) THEN -1 WHEN n.confidence - o.confidence < CAST(-0.1 AS DOUBLE) THEN -0.5 ELSE 0 END AS DOUBLE) * CAST(0.3 AS DOUBLE) + CAST(sign(CASE n.ownership WHEN 'user' THEN 3 WHEN 'third_party' THEN 1 ELSE 2 END - CASE o.ownership WHEN 'user' THEN 3 WHEN 'third_party' THEN 1 ELSE 2 END) AS DOUBLE) * CAST(0.2 AS DOUBLE)"
DEC = f"{EP}, tk AS (SELECT mid, {W.format('content')} AS t FROM memx), hit AS (SELECT ep.a, ep.b, o.ord, {CS} AS conflict FROM ep JOIN mem_new n ON n.mid = ep.a JOIN mem_old o ON o.mid = ep.b JOIN tk x ON x.mid = ep.a JOIN tk y ON y.mid = ep.b WHERE len(x.t) > 0 AND len(y.t) > 0 AND len(list_intersect(x.t, y.t)) / CAST(len(list_distinct(list_concat(x.t, y.t))) AS DOUBLE) > CAST(0.7 AS DOUBLE) AND {CONTR}), tg AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY a ORDER BY ord, b) = 1), dec AS (SELECT mem_new.mid AS a, CASE WHEN conflict > CAST(0.3 AS DOUBLE) THEN 'UPDATE' WHEN conflict < CAST(-0.3 AS DOUBLE) THEN 'NOOP' ELSE 'ADD' END AS op, b AS target, conflict FROM mem_new LEFT JOIN tg ON tg.a = mem_new.mid)"


def decided(s, d):
    return curate.decide(X.mem_new(s, d), X.mem_old(s, d), X.entx(s, d), words=NEG)


@q("j06_operator_dedup", f"{DEC} SELECT a, op, target, round(conflict, 6) AS conflict FROM dec")
def j06(s, d):
    return decided(s, d).withColumn("conflict", F.round("conflict", 6))


@q("j06_applied", f"{DEC}, u AS (SELECT target, arg_max(n.content, n.ord) AS c, arg_max(n.importance, n.ord) AS i, max(n.score) AS sc FROM dec JOIN mem_new n ON n.mid = dec.a WHERE op = 'UPDATE' GROUP BY target) SELECT o.mid, coalesce(u.c, o.content) AS content, round(coalesce(u.i, o.importance), 6) AS importance, round(greatest(o.score, u.sc), 6) AS score FROM mem_old o LEFT JOIN u ON u.target = o.mid UNION ALL SELECT n.mid, n.content, round(n.importance, 6), round(n.score, 6) FROM mem_new n JOIN dec ON dec.a = n.mid WHERE op = 'ADD'")
def j06b(s, d):
    out = curate.apply_decisions(X.mem_old(s, d).select("mid", "content", "importance", "score"), X.mem_new(s, d), decided(s, d))
    return out.select("mid", "content", F.round("importance", 6).alias("importance"), F.round("score", 6).alias("score"))


T1, T2 = ("worthless", "thing"), ("with",)
LIKE = f"{EP}, tk AS (SELECT mid, list_distinct(regexp_extract_all(lower(content), '[a-zA-Z]+')) AS t FROM memx), lk AS (SELECT ep.a, ep.b, o.ord, n.ord AS nord, n.content AS nc, n.importance AS ni, o.importance AS oi, n.score AS ns, o.score AS os, contains(lower(n.content), lower(o.content)) OR contains(lower(o.content), lower(n.content)) AS inside, len(list_intersect(x.t, y.t)) / CAST(greatest(least(len(x.t), len(y.t)), 1) AS DOUBLE) AS ov, CASE WHEN {has('n.content', T1)} THEN 1 WHEN {has('n.content', T2)} THEN 2 END AS tier FROM ep JOIN mem_new n ON n.mid = ep.a JOIN mem_old o ON o.mid = ep.b JOIN tk x ON x.mid = ep.a JOIN tk y ON y.mid = ep.b), lks AS (SELECT * FROM lk WHERE inside OR ov >= CAST(0.3 AS DOUBLE)), dn AS (SELECT * FROM lks WHERE tier IS NOT NULL AND ov >= CAST(0.3 AS DOUBLE)), dp AS (SELECT * FROM lks WHERE tier IS NULL OR ov < CAST(0.3 AS DOUBLE)), ft AS (SELECT * FROM dp QUALIFY row_number() OVER (PARTITION BY a ORDER BY ord, b) = 1)"


def overlaps(s, d):
    return curate.overlap_dedup(X.mem_new(s, d), X.mem_old(s, d), X.entx(s, d), tier1=T1, tier2=T2)


@q("j07_overlap_inserts", f"{LIKE} SELECT mid FROM mem_new WHERE mid NOT IN (SELECT a FROM ft)")
def j07a(s, d):
    return overlaps(s, d)[0].select("mid")


@q("j07_overlap_updates", f"{LIKE} SELECT b AS mid, arg_max(nc, nord) AS content, round(arg_max(ni, nord), 6) AS importance, round(greatest(max(os), max(ns)), 6) AS score FROM ft WHERE ni > oi GROUP BY b")
def j07b(s, d):
    return overlaps(s, d)[1].select("mid", "content", F.round("importance", 6).alias("importance"), F.round("score", 6).alias("score"))


@q("j07_overlap_downgrades", f"{LIKE} SELECT b AS mid, count(*) AS n, arg_max(tier, nord) AS override_tier, round(max(os) * product(CAST(CASE tier WHEN 1 THEN 0.1 ELSE 0.4 END AS DOUBLE)), 6) AS score FROM dn GROUP BY b")
def j07c(s, d):
    return overlaps(s, d)[2].select("mid", "n", "override_tier", F.round("score", 6).alias("score"))


@q("j08_verify_beliefs", f"ws AS (SELECT mid, list_distinct(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda w: w <> '')) AS t FROM memx), bp AS (SELECT DISTINCT a.mid AS a, b.mid AS b FROM entx a JOIN entx b ON a.entity = b.entity JOIN mem_new x ON x.mid = a.mid AND x.mtype = 'belief' JOIN mem_old y ON y.mid = b.mid AND y.mtype = 'fact'), v AS (SELECT bp.a, bp.b, CASE WHEN len(list_intersect(x.t, y.t)) / CAST(greatest(len(x.t), 1) AS DOUBLE) > CAST(0.2 AS DOUBLE) * 2.5 THEN 'confirmed' WHEN {has('lower(n.content)', NEG)} <> {has('lower(o.content)', NEG)} AND len(list_intersect(x.t, y.t)) / CAST(greatest(len(x.t), 1) AS DOUBLE) > CAST(0.3 AS DOUBLE) THEN 'contradicted' END AS verdict FROM bp JOIN ws x ON x.mid = bp.a JOIN ws y ON y.mid = bp.b JOIN memx n ON n.mid = bp.a JOIN memx o ON o.mid = bp.b), f AS (SELECT * FROM v WHERE verdict IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a ORDER BY b) = 1) SELECT n.mid, coalesce(verdict, 'unchanged') AS verdict, b AS fact, round(CASE verdict WHEN 'confirmed' THEN CAST(1 AS DOUBLE) WHEN 'contradicted' THEN greatest(CAST(0.1 AS DOUBLE), confidence - CAST(0.3 AS DOUBLE)) ELSE confidence END, 6) AS confidence FROM mem_new n LEFT JOIN f ON f.a = n.mid WHERE n.mtype = 'belief'")
def j08(s, d):
    return curate.verify_beliefs(X.mem_new(s, d).where("mtype = 'belief'"), X.mem_old(s, d).where("mtype = 'fact'"), X.entx(s, d), NEG).withColumn("confidence", F.round("confidence", 6))


@q("j14_supersede", f"{DEC}, lo AS (SELECT target AS mid, max(a) AS superseded_by FROM dec WHERE op = 'UPDATE' GROUP BY target), wi AS (SELECT a AS mid, string_agg(CAST(target AS VARCHAR), ',') AS supersedes FROM dec WHERE op = 'UPDATE' GROUP BY a) SELECT mem.mid, superseded_by IS NOT NULL AS superseded, superseded_by, CASE WHEN superseded_by IS NOT NULL THEN 1 ELSE 0 END AS state, coalesce(supersedes, '') AS supersedes FROM mem LEFT JOIN lo ON lo.mid = mem.mid LEFT JOIN wi ON wi.mid = mem.mid")
def j14(s, d):
    out = curate.supersede(X.mem(s, d), decided(s, d), AS)
    return out.select("mid", "superseded", "superseded_by", "state", F.coalesce(F.array_join("supersedes", ","), LIT("")).alias("supersedes"))


@q("j18_close_relations", "SELECT event_id AS rid, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) > 1 AS superseded FROM events")
def j18(s, d):
    r = X.attr_version(s, d).select(C("vid").alias("rid"), C("entity").alias("subject"), C("attribute").alias("relation_type"), C("value").alias("object"), C("ts_us").alias("ts"))
    return curate.close_relations(r).select("rid", "superseded")


TOPF = "fa AS (SELECT entity, m.mid, content, importance, m.mid % 4 = 0 AS ident FROM ent JOIN mem m ON m.mid = ent.mid WHERE mtype = 'fact'), rk AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY importance DESC, mid) AS r, bool_or(ident) OVER (PARTITION BY entity) AS has FROM fa), pl AS (SELECT entity, mid, content, importance, r AS pos FROM rk WHERE NOT has AND r <= 5), id AS (SELECT entity, mid, content, importance, row_number() OVER (PARTITION BY entity ORDER BY mid) AS pos FROM rk WHERE ident QUALIFY pos <= 3), ot AS (SELECT entity, mid, content, importance, 3 + row_number() OVER (PARTITION BY entity ORDER BY r) AS pos FROM rk WHERE has AND NOT ident AND r <= 5 QUALIFY pos <= 5), tf AS (SELECT * FROM pl UNION ALL SELECT * FROM id UNION ALL SELECT * FROM ot)"


@q("w03_top_facts", f"{TOPF} SELECT entity, mid, pos FROM tf")
def w03(s, d):
    return curate.top_facts(X.mem(s, d).where("mtype = 'fact'"), X.ent(s, d), C("mid") % 4 == 0).select("entity", "mid", "pos")


@q("a06_summaries", f"{TOPF}, n AS (SELECT entity, count(*) AS n_facts FROM fa GROUP BY entity), la AS (SELECT entity, max(created_s) AS last_s FROM ent JOIN mem ON mem.mid = ent.mid WHERE mtype = 'summary' GROUP BY entity), du AS (SELECT n.entity, n_facts, last_s FROM n LEFT JOIN la ON la.entity = n.entity WHERE (last_s IS NULL AND n_facts >= 3) OR (n_facts >= 8 AND floor(({AS} - last_s) / 86400.0) >= 7)) SELECT du.entity, n_facts, last_s IS NOT NULL AS is_reflection, (SELECT string_agg(substring(content, 1, 40), '; ' ORDER BY pos) FROM tf WHERE tf.entity = du.entity) AS content, (SELECT round(avg(importance), 6) FROM tf WHERE tf.entity = du.entity) AS importance FROM du")
def a06(s, d):
    m, e = X.mem(s, d), X.ent(s, d)
    last = e.join(m.where("mtype = 'summary'").select("mid", "created_s"), "mid").select("entity", "created_s")
    return curate.summaries(m.where("mtype = 'fact'"), e, last, AS, C("mid") % 4 == 0).select("entity", "n_facts", "is_reflection", "content", F.round("importance", 6).alias("importance"))


@q("a07_profiles", "SELECT entity, mtype, mem.mid, count(*) FILTER (WHERE mtype IN ('fact', 'belief')) OVER (PARTITION BY entity) AS n FROM ent JOIN mem ON mem.mid = ent.mid")
def a07(s, d):
    return curate.profiles(X.mem(s, d), X.ent(s, d))


@q("a09_access_stats", "SELECT mid, count(*) AS accesses, count(*) FILTER (WHERE access_type = 'retrieval') AS retrieval, count(*) FILTER (WHERE access_type = 'used_in_response') AS used_in_response, count(*) FILTER (WHERE access_type = 'user_mentioned') AS user_mentioned, CAST(floor(max(ts_us) / 1000000.0) AS BIGINT) AS last_s FROM access_log GROUP BY mid")
def a09(s, d):
    return curate.access_stats(X.access_log(s, d))


@q("p17_access_modes", "SELECT mem.mid, coalesce(n, 0) AS v124, coalesce(n - r, 0) AS v125 FROM mem LEFT JOIN (SELECT mid, count(*) AS n, count(*) FILTER (WHERE access_type = 'retrieval') AS r FROM access_log GROUP BY mid) a ON a.mid = mem.mid")
def p17m(s, d):
    m, log = X.mem(s, d), X.access_log(s, d)
    a = curate.apply_access_mode(m, log).select("mid", C("access_count").alias("v124"))
    return a.join(curate.apply_access_mode(m, log, "v1.2.5").select("mid", C("access_count").alias("v125")), "mid")


# --- statistics and reports ---------------------------------------------------------------------------------------------

STATE = "CASE WHEN expires_s <= 1706745600 THEN 2 WHEN mid % 6 = 0 THEN 1 ELSE 0 END"


def stated(s, d):
    return X.mem(s, d).withColumn("state", F.when(C("expires_s") <= AS, 2).when(C("mid") % 6 == 0, 1).otherwise(0))


@q("a01_store_stats", f"SELECT count(*) FILTER (WHERE s = 0) AS active, count(*) FILTER (WHERE s = 0 AND mtype = 'fact') AS facts, count(*) FILTER (WHERE s = 0 AND mtype = 'belief') AS beliefs, count(*) FILTER (WHERE s = 0 AND mtype = 'summary') AS summaries, count(*) FILTER (WHERE s = 1) AS archived FROM (SELECT mtype, {STATE} AS s FROM mem)")
def a01(s, d):
    return report.store_stats(stated(s, d))


@q("a02_pool_counts", f"SELECT state, mtype, count(*) AS n FROM (SELECT {STATE} AS state, mtype FROM mem) GROUP BY CUBE (state, mtype)")
def a02(s, d):
    return report.pool_counts(stated(s, d))


BAND = "CASE WHEN importance >= CAST(0.9 AS DOUBLE) THEN 'critical' WHEN importance >= CAST(0.7 AS DOUBLE) THEN 'high' WHEN importance >= CAST(0.4 AS DOUBLE) THEN 'medium' ELSE 'low' END"


@q("a03_histogram", f"SELECT mtype, band, n, CAST(floor(sum(n) OVER (PARTITION BY mtype) * 100 / sum(n) OVER ()) AS BIGINT) AS percent FROM (SELECT mtype, {BAND} AS band, count(*) AS n FROM mem GROUP BY 1, 2)")
def a03(s, d):
    return report.histogram(X.mem(s, d))


@q("a04_postings", f"SELECT mid, unnest({KEYS.format('content')}) AS term FROM mem")
def a04(s, d):
    return index.postings(X.mem(s, d)).select("mid", "term")


@q("a05_relation_index", "SELECT entity, mtype, mem.mid FROM ent JOIN mem ON mem.mid = ent.mid")
def a05(s, d):
    return index.relation_index(X.mem(s, d), X.ent(s, d))


@q("a08_noise_stats", f"SELECT noise_reason, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS rate FROM (SELECT {NOISE} AS noise_reason FROM mem) GROUP BY 1")
def a08(s, d):
    return report.rates(X.mem(s, d).select(R.noise_reason(C("content"), C("importance")).alias("noise_reason")), "noise_reason")


@q("a10_operation_stats", f"{DEC} SELECT op, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS rate FROM dec GROUP BY 1")
def a10(s, d):
    return report.rates(decided(s, d), "op")


@q("a11_conflict_stats", f"{DEC} SELECT action, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS rate FROM (SELECT CASE WHEN conflict > CAST(0.3 AS DOUBLE) THEN 'UPDATE' WHEN conflict < CAST(-0.3 AS DOUBLE) THEN 'KEEP' ELSE 'MERGE' END AS action FROM dec WHERE target IS NOT NULL) GROUP BY 1")
def a11(s, d):
    return report.rates(decided(s, d).where("target IS NOT NULL").select(R.conflict_action(C("conflict")).alias("action")), "action")


@q("a12_scorer_stats", "SELECT event_type AS phase, count(*) FILTER (WHERE user_id % 2 = 0) AS calls, count(*) FILTER (WHERE user_id % 4 = 0) AS successes, count(*) FILTER (WHERE user_id % 2 = 1) AS fallbacks, CAST(sum(event_id % 50) AS BIGINT) AS tokens, coalesce(array_to_string(list_slice(list('e' || event_id ORDER BY event_id) FILTER (WHERE event_id % 11 = 0), 1, 5), '|'), '') AS errors FROM events GROUP BY 1")
def a12(s, d):
    e = X.table(s, d, "events").select(C("event_type").alias("phase"), C("event_id").alias("eid"), (C("user_id") % 2 == 0).alias("called"), (C("user_id") % 4 == 0).alias("success"), (C("user_id") % 2 == 1).alias("fallback"), (C("event_id") % 50).alias("tokens"), F.when(C("event_id") % 11 == 0, F.concat(LIT("e"), "event_id")).alias("error"))
    return report.scorer_stats(e)


@q("a13_health", f"SELECT count(*) AS total, count(*) FILTER (WHERE st = 'active') AS active, count(*) FILTER (WHERE st = 'stale') AS stale, count(*) FILTER (WHERE importance >= CAST(0.8 AS DOUBLE)) AS high_priority, count(*) FILTER (WHERE st = 'conflict') AS conflict FROM (SELECT importance, CASE WHEN mid % 7 = 0 THEN 'conflict' WHEN {AGE} > 20 THEN 'stale' ELSE 'active' END AS st FROM mem)")
def a13(s, d):
    from ..functions.text import floor_days

    return report.health(X.mem(s, d).withColumn("status", R.health_status(C("mid") % 7 == 0, floor_days(LIT(AS), C("created_s")) > 20)))


@q("a14_entity_counts", "SELECT entity, count(*) AS n FROM ent GROUP BY entity")
def a14(s, d):
    return report.entity_counts(X.ent(s, d))


@q("a15_integrity", "v AS (SELECT mid + CASE WHEN mid % 13 = 0 THEN 1 ELSE 0 END AS mid, CASE WHEN mid % 17 = 0 THEN ' ' ELSE content END AS content, CASE WHEN mid % 19 = 0 THEN 'x' ELSE mtype END AS mtype, CASE WHEN mid % 23 = 0 THEN 9 ELSE 0 END AS state FROM mem) SELECT kind, count(*) AS n FROM (SELECT 'no_content' AS kind FROM v WHERE trim(content) = '' UNION ALL SELECT 'type' FROM v WHERE mtype = 'x' UNION ALL SELECT 'state' FROM v WHERE state = 9 UNION ALL SELECT 'repeated' FROM (SELECT mid FROM v GROUP BY mid HAVING count(*) > 1) UNION ALL SELECT 'orphan' FROM (SELECT DISTINCT mid FROM ent WHERE mid NOT IN (SELECT mid FROM v))) GROUP BY kind")
def a15(s, d):
    m = X.mem(s, d)
    v = m.select((C("mid") + F.when(C("mid") % 13 == 0, 1).otherwise(0)).alias("mid"), F.when(C("mid") % 17 == 0, " ").otherwise(C("content")).alias("content"), F.when(C("mid") % 19 == 0, "x").otherwise(C("mtype")).alias("mtype"), F.when(C("mid") % 23 == 0, 9).otherwise(0).alias("state"), "ownership")
    return report.violations(v, X.ent(s, d)).groupBy("kind").agg(F.count(LIT(1)).alias("n"))


@q("a17_pending_counts", f"SELECT count(*) AS pending, count(*) FILTER (WHERE {has('content', ('worthless', 'nicht', 'pour'))}) AS urgent FROM mem")
def a17(s, d):
    u = R.urgency(C("content"), ("worthless",), ("nicht", "pour"), ("^$^",))["urgent"]
    return X.mem(s, d).agg(F.count(LIT(1)).alias("pending"), F.count_if(u).alias("urgent"))


@q("v2_v3_migrate", "SELECT mid, created_s AS timestamp_s, CASE WHEN mid % 5 = 0 THEN 'legacy' ELSE CAST(session_id AS VARCHAR) END AS session_id, CASE WHEN mid % 5 = 0 THEN 'user' ELSE ownership END AS ownership, content AS source_quote FROM mem")
def v2(s, d):
    old = X.mem(s, d).withColumn("session_id", F.when(C("mid") % 5 != 0, C("session_id").cast("string"))).drop("source_turn")
    return report.backfill(report.migrate(old)).select("mid", "timestamp_s", "session_id", "ownership", "source_quote")


@q("v4_cascade", f"SELECT mid, entity FROM ent WHERE mid IN (SELECT mid FROM mem WHERE {STATE} <> 2)")
def v4(s, d):
    return report.cascade(X.ent(s, d), stated(s, d).where("state <> 2"))


@q("t03_rankings", "SELECT mid, score, rank FROM (SELECT mid, score, row_number() OVER (ORDER BY score DESC, mid) AS rank FROM mem) WHERE rank <= 50")
def t03(s, d):
    return report.top_by(X.mem(s, d), "score", 50).select("mid", "score", "rank")


@q("t04_dashboard_lists", "SELECT mid, mtype, rank FROM (SELECT mid, mtype, row_number() OVER (PARTITION BY mtype ORDER BY importance DESC, mid) AS rank FROM mem) WHERE (mtype = 'fact' AND rank <= 20) OR (mtype = 'belief' AND rank <= 10)")
def t04(s, d):
    return report.top_by_type(X.mem(s, d), {"fact": 20, "belief": 10}).select("mid", "mtype", "rank")


@q("t05_latest_access", "SELECT log_id, mid FROM access_log ORDER BY ts_us DESC, log_id LIMIT 20")
def t05(s, d):
    return report.latest(X.access_log(s, d), 20).select("log_id", "mid")


@q("w10_newest_facts", "SELECT mid, created_s FROM mem WHERE mtype = 'fact' ORDER BY created_s DESC, mid LIMIT 20")
def w10(s, d):
    return report.top_by(X.mem(s, d).where("mtype = 'fact'"), "created_s", 20).select("mid", "created_s")


ONE = "replace(content, chr(10), ' ')"
SNAP = f"""sn AS (SELECT *, mid % 8 = 0 AS down, {ONE} AS one FROM mem), sc AS (
SELECT 'critical' AS section, row_number() OVER (ORDER BY score DESC, mid) AS pos, '- **' || one || '**' AS line FROM sn WHERE importance >= CAST(0.9 AS DOUBLE) QUALIFY pos <= 5
UNION ALL SELECT 'high', row_number() OVER (ORDER BY score DESC, mid) AS pos, '- ' || one FROM sn WHERE importance >= CAST(0.7 AS DOUBLE) AND importance < CAST(0.9 AS DOUBLE) QUALIFY pos <= 5
UNION ALL SELECT 'downgraded', row_number() OVER (ORDER BY score DESC, mid) AS pos, '- ~~' || substring(one, 1, 40) || '~~ (Score: ' || printf('%.2f', importance) || ' → ' || printf('%.2f', score) || ')' FROM sn WHERE down QUALIFY pos <= 5
UNION ALL SELECT 'ranking', row_number() OVER (ORDER BY score DESC, mid) AS pos, '| ' || row_number() OVER (ORDER BY score DESC, mid) || ' | ' || printf('%.2f', score) || ' | [' || upper(substring(mtype, 1, 1)) || '] ' || substring(one, 1, 40) || ' |' FROM sn QUALIFY pos <= 15
UNION ALL SELECT 'entities', row_number() OVER (ORDER BY entity) AS pos, '- **' || entity || '**: ' || count(*) || ' 条相关记忆' FROM ent GROUP BY entity QUALIFY pos <= 10
UNION ALL SELECT 'totals', pos, '- **' || k || '**: ' || v || ' 条' || CASE WHEN pos < 4 THEN ' (' || CAST(floor(v * 100 / n) AS BIGINT) || '%)' ELSE '' END FROM (SELECT count(*) AS n, count(*) FILTER (WHERE mtype = 'fact') AS a, count(*) FILTER (WHERE mtype = 'belief') AS b, count(*) FILTER (WHERE mtype = 'summary') AS c, count(*) FILTER (WHERE importance >= CAST(0.9 AS DOUBLE)) AS d, count(*) FILTER (WHERE importance >= CAST(0.7 AS DOUBLE) AND importance < CAST(0.9 AS DOUBLE)) AS e FROM mem), LATERAL (VALUES (1, 'Facts', a), (2, 'Beliefs', b), (3, 'Summaries', c), (4, '关键信息', d), (5, '重要信息', e)) AS t(pos, k, v))"""


def snapshot(s, d):
    return report.snapshot(X.mem(s, d).withColumn("conflict_downgraded", C("mid") % 8 == 0), X.ent(s, d))


@q("r05_snapshot", f"{SNAP} SELECT section, pos, line FROM sc")
def r05(s, d):
    return snapshot(s, d)


@q("r05_snapshot_text", f"{SNAP}, o AS (SELECT list_position(['critical', 'high', 'downgraded', 'ranking', 'entities', 'totals'], section) AS s, pos, line FROM sc UNION ALL SELECT DISTINCT list_position(['critical', 'high', 'downgraded', 'ranking', 'entities', 'totals'], section), 0, '## ' || section FROM sc) SELECT string_agg(line, chr(10) ORDER BY s, pos) AS text FROM o")
def r05t(s, d):
    return report.snapshot_text(snapshot(s, d))


@q("s12_snapshot_sink", f"{SNAP}, o AS (SELECT list_position(['critical', 'high', 'downgraded', 'ranking', 'entities', 'totals'], section) AS s, pos, line FROM sc UNION ALL SELECT DISTINCT list_position(['critical', 'high', 'downgraded', 'ranking', 'entities', 'totals'], section), 0, '## ' || section FROM sc) SELECT string_agg(line, chr(10) ORDER BY s, pos) || chr(10) AS text FROM o")
def s12(s, d):
    from ..sources import io

    path = io.shared_path(s, "snapshot")
    io.write_document(report.snapshot_text(snapshot(s, d)), path)
    return s.read.text(path, wholetext=True).select(C("value").alias("text"))


@q("r02_pending_view", f"SELECT mid AS ord, CASE WHEN {has('content', ('worthless', 'nicht', 'pour'))} THEN '🔴' ELSE '⚪' END || ' ' || substring(content, 1, 50) || '...' AS line, round(importance, 1) AS importance, (SELECT count(*) FROM mem) AS pending, (SELECT count(*) FROM mem WHERE {has('content', ('worthless', 'nicht', 'pour'))}) AS urgents FROM mem")
def r02(s, d):
    u = R.urgency(C("content"), ("worthless",), ("nicht", "pour"), ("^$^",))["urgent"]
    return report.pending_view(X.mem(s, d).withColumn("ord", C("mid")), u)


DASH = f"greatest(0, CAST(floor(({AS} - coalesce(last_accessed_s, created_s)) / 86400.0) AS BIGINT))"


@q("r04_dashboard", f"v AS (SELECT *, {DASH} AS days, CASE WHEN mid % 7 = 0 THEN 'conflict' WHEN {DASH} > 10 THEN 'stale' ELSE 'active' END AS st FROM mem), t AS (SELECT count(*) AS a, count(*) FILTER (WHERE st = 'active') AS b, count(*) FILTER (WHERE st = 'stale') AS c, count(*) FILTER (WHERE importance >= CAST(0.8 AS DOUBLE)) AS d, count(*) FILTER (WHERE st = 'conflict') AS e FROM v) SELECT 'totals' AS section, pos, '| ' || k || ' | ' || n || ' |' AS line FROM t, LATERAL (VALUES (1, 'total', a), (2, 'active', b), (3, 'stale', c), (4, 'high_priority', d), (5, 'conflict', e)) AS x(pos, k, n) UNION ALL SELECT mtype, pos, line FROM (SELECT mtype, row_number() OVER (PARTITION BY mtype ORDER BY importance DESC, mid) AS pos, '| ' || substring(CAST(mid AS VARCHAR), 1, 12) || ' | ' || replace(replace(substring(content, 1, 40), chr(10), ' '), '|', chr(92) || '|') || '... | ' || CASE WHEN importance >= CAST(0.8 AS DOUBLE) THEN '🔴' WHEN importance >= CAST(0.5 AS DOUBLE) THEN '🟡' ELSE '⚪' END || ' | ' || CASE st WHEN 'conflict' THEN '🔀' WHEN 'stale' THEN '⚠️' ELSE '✅' END || ' | ' || days || ' |' AS line FROM v) WHERE (mtype = 'fact' AND pos <= 20) OR (mtype = 'belief' AND pos <= 10)")
def r04(s, d):
    return report.dashboard(X.mem(s, d).withColumn("last_verified_s", C("last_accessed_s")), C("mid") % 7 == 0, AS, 10)


@q("r06_token_budget", "k AS (SELECT session_id, mid, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, mid) AS rank, count(*) OVER (PARTITION BY session_id) AS n FROM mem) SELECT mid, rank, CAST(floor(1000 * CASE rank WHEN 1 THEN CAST(0.4 AS DOUBLE) WHEN 2 THEN CAST(0.25 AS DOUBLE) WHEN 3 THEN CAST(0.15 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) / (n - 3) END) AS BIGINT) AS tokens FROM k")
def r06(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("session_id")
    k = X.mem(s, d).withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "mid"))).withColumn("n", F.count(LIT(1)).over(w))
    return report.token_budget(k, 1000).select("mid", "rank", "tokens")


@q("s11_search_export", "SELECT mtype, mem.mid, '[' || mem.mid || '] ' || content || coalesce(chr(10) || '  entities: ' || names, '') AS line FROM mem LEFT JOIN (SELECT mid, string_agg(entity, ', ' ORDER BY entity) AS names FROM ent GROUP BY mid) e ON e.mid = mem.mid")
def s11(s, d):
    return index.search_export(X.mem(s, d), X.ent(s, d))


@q("s11_export_counts", "SELECT mtype, count(*) AS n, sum(length('[' || mid || '] ' || content || coalesce(chr(10) || '  entities: ' || names, ''))) AS chars FROM mem LEFT JOIN (SELECT mid AS m2, string_agg(entity, ', ' ORDER BY entity) AS names FROM ent GROUP BY mid) e ON m2 = mid GROUP BY mtype")
def s11c(s, d):
    from ..sources import io

    path = io.shared_path(s, "export")
    return index.export(X.mem(s, d), X.ent(s, d), path)


@q("s06_line_segments", "SELECT source, pos, trim(line) AS content FROM (SELECT doc_id AS source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents) WHERE length(trim(line)) > 5")
def s06(s, d):
    from ..sources.io import line_segments

    return line_segments(X.table(s, d, "documents").select(C("doc_id").alias("source"), "text"))


MSG = "SELECT conv_id AS session, text AS content, CAST(strftime(to_timestamp(1704067200 + conv_id * 3600 + turn), '%Y-%m-%dT%H:%M:%SZ') AS VARCHAR) AS timestamp FROM conversations WHERE role = 'user' AND length(trim(text)) >= 10"


def transcripts(s, d):
    c = X.table(s, d, "conversations")
    ts = F.date_format(F.timestamp_seconds(1704067200 + C("conv_id") * 3600 + C("turn")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    msg = F.struct("role", F.array(F.struct(LIT("text").alias("type"), C("text").alias("text")), F.struct(LIT("image").alias("type"), LIT("x").alias("text"))).alias("content"))
    return c.select(LIT("message").alias("type"), ts.alias("timestamp"), msg.alias("message"), C("conv_id").alias("session"))


@q("s04_transcripts", f"SELECT session, trim(content) AS content FROM ({MSG})")
def s04(s, d):
    from ..sources.io import user_messages

    return user_messages(transcripts(s, d), AS, hours=24 * 3650).select("session", "content")


@q("s05_collect", f"i AS (SELECT 'p_' || replace(substring(timestamp, 1, 10), '-', '') || '_' || substring(md5(trim(content) || '_' || timestamp), 1, 16) AS id, session FROM ({MSG})), o AS (SELECT DISTINCT id FROM i WHERE session % 3 = 0) SELECT DISTINCT id FROM i WHERE id NOT IN (SELECT id FROM o)")
def s05(s, d):
    from ..sources.io import collect_pending, user_messages

    m = user_messages(transcripts(s, d), AS, hours=24 * 3650)
    none = m.select(LIT("").alias("id")).limit(0)
    return collect_pending(m, collect_pending(m.where("session % 3 = 0"), none, 16), 16).select("id")


@q("s07_pending_segments", "SELECT trim(content) AS content, session_id AS session, 'b1' AS consumed_by FROM mem WHERE length(trim(content)) > 5")
def s07(s, d):
    from ..sources.io import pending_segments

    p = X.mem(s, d).select("mid", "content", C("session_id").alias("session"), C("created_s").alias("timestamp"))
    segments, consumed = pending_segments(p, "b1")
    marks = consumed.select("consumed_by").distinct()
    return segments.crossJoin(F.broadcast(marks)).select("content", "session", "consumed_by")


@q("s15_expired_log", f"SELECT mid AS memory_id, content, created_s AS created_at, expires_s AS expires_at, CAST({AS} AS BIGINT) AS expired_at FROM mem WHERE expires_s <= {AS}")
def s15(s, d):
    from ..sources import io

    path = io.shared_path(s, "expired")
    expired, _ = curate.split_expired(X.mem(s, d), AS)
    for part in (0, 1):  # two runs append to one log
        io.log_expired(expired.where(C("mid") % 2 == part), path, AS)
    return s.read.schema("memory_id long, content string, created_at long, expires_at long, expired_at long").json(path)


@q("s16_profile_sink", "SELECT substring(md5(entity), 1, 8) AS entity_id, entity, mtype, mem.mid FROM ent JOIN mem ON mem.mid = ent.mid")
def s16(s, d):
    from ..sources import io

    path = io.shared_path(s, "profiles")
    rows = curate.profiles(X.mem(s, d), X.ent(s, d)).withColumn("entity_id", F.substring(F.md5("entity"), 1, 8))
    io.write_partitioned(rows, path, "entity_id", 16)
    return s.read.parquet(path).select("entity_id", "entity", "mtype", "mid")


@q("s08_upsert", "SELECT mid, CASE WHEN mid % 4 = 0 THEN 'new' ELSE content END AS content FROM mem")
def s08(s, d):
    from ..sources.io import upsert

    m = X.mem(s, d).select("mid", "content").withColumn("seq", LIT(1))
    return upsert(m, m.where("mid % 4 = 0").withColumn("content", LIT("new"))).select("mid", "content")


def upserted(s, d):
    """Every fourth record comes again, with one entity of its own, no importance and state 2; as many are new."""
    from ..sources.io import upsert_records

    m = X.mem(s, d).select("mid", "content", "importance", "score", "confidence", "ownership").withColumn("seq", LIT(1)).withColumn("state", LIT(1))
    again = m.where("mid % 4 = 0")
    new = again.unionByName(again.withColumn("mid", -C("mid") - 1)).withColumn("seq", LIT(2)).withColumn("state", LIT(2))
    new = new.withColumn("importance", F.when(C("mid") % 8 == 0, C("importance"))).withColumn("entities", F.array(LIT("Own"), F.concat(LIT("E"), C("mid") % 3), LIT("Own")))
    return upsert_records(m, new, {"entities": X.ent(s, d)}, {"entities": "entity"})


UPS = "up AS (SELECT mid, importance, 1 AS state, false AS new FROM mem WHERE mid % 4 <> 0 UNION ALL SELECT mid, CASE WHEN mid % 8 = 0 THEN importance ELSE 0.5 END, 0, true FROM mem WHERE mid % 4 = 0 UNION ALL SELECT -mid - 1, CASE WHEN (-mid - 1) % 8 = 0 THEN importance ELSE 0.5 END, 0, true FROM mem WHERE mid % 4 = 0)"


@q("s08_records", f"{UPS} SELECT mid, round(importance, 6) AS importance, state FROM up")
def s08r(s, d):
    return upserted(s, d).records.select("mid", F.round("importance", 6).alias("importance"), "state")


@q("s08_children", f"{UPS} SELECT mid, entity FROM ent WHERE mid IN (SELECT mid FROM up WHERE NOT new) UNION ALL SELECT mid, unnest(['Own', 'E' || mid % 3]) FROM up WHERE new")
def s08c(s, d):
    return upserted(s, d).children["entities"]


@q("c03_index_sizes", f"SELECT (SELECT count(*) FROM (SELECT mid, unnest({KEYS.format('content')}) AS term FROM mem)) AS postings, (SELECT count(*) FROM ent) AS relations")
def c03(s, d):
    p, r = jobs.rebuild_indexes(X.mem(s, d), X.ent(s, d))
    return p.agg(F.count(LIT(1)).alias("postings")).crossJoin(r.agg(F.count(LIT(1)).alias("relations")))


@q("c04_archive", "SELECT mid, CASE WHEN mid IN (SELECT mid FROM access_log) THEN 1 ELSE 0 END AS state FROM mem")
def c04(s, d):
    return jobs.archive(X.mem(s, d).withColumn("state", LIT(0)), X.access_log(s, d)).select("mid", "state")


@q("c02_mini_consolidate", f"SELECT mid, substring(mtype, 1, 1) || '_' || strftime(to_timestamp(created_s), '%Y%m%d') || '_' || substring(md5(content), 1, 16) AS id, round({IMP}, 6) AS importance FROM mem WHERE ({NOISE.replace('importance <', 'CAST(0.5 AS DOUBLE) <')}) IS NULL AND ({has('content', ('worthless', 'nicht'))} OR {IMP} >= CAST(0.5 AS DOUBLE))")
def c02(s, d):
    pending = X.mem(s, d).withColumn("urgent", C("content").rlike("worthless|nicht"))
    return jobs.mini_consolidate(pending, imp(), LIT(False)).select("mid", "id", F.round("importance", 6).alias("importance"))


EX = f"ve AS (SELECT * FROM mem_old WHERE NOT coalesce(expires_s <= {AS}, false))"
NW = f"nw AS (SELECT mid, mid AS ord, content, mtype, ownership, {IMP} AS importance, {IMP} AS score, CASE WHEN mtype = 'belief' THEN CAST(0.6 AS DOUBLE) END AS confidence, created_s FROM mem_new WHERE length(trim(content)) > 5 AND ({NOISE.replace('importance <', 'CAST(0.5 AS DOUBLE) <')}) IS NULL AND {IMP} >= CAST(0.3 AS DOUBLE))"
KEEP = f"CAST(CASE WHEN CAST(floor(({AS} - la) / 86400.0) AS BIGINT) <= 3 THEN 0.99 WHEN CAST(floor(({AS} - la) / 86400.0) AS BIGINT) <= 7 THEN 0.97 WHEN CAST(floor(({AS} - la) / 86400.0) AS BIGINT) <= 14 THEN 0.95 ELSE 1 END AS DOUBLE)"
VER = f"ws AS (SELECT mid, content AS wc, list_distinct(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda w: w <> '')) AS t FROM memx), kf AS (SELECT mid, 0 AS g FROM ve WHERE mtype = 'fact' UNION ALL SELECT mid, 1 FROM nw WHERE mtype = 'fact'), bp AS (SELECT DISTINCT a.mid AS a, b.mid AS b, g FROM entx a JOIN entx b ON a.entity = b.entity JOIN nw ON nw.mid = a.mid AND nw.mtype = 'belief' JOIN kf ON kf.mid = b.mid), vd AS (SELECT bp.a, bp.b, g, CASE WHEN len(list_intersect(x.t, y.t)) / CAST(greatest(len(x.t), 1) AS DOUBLE) > CAST(0.5 AS DOUBLE) THEN 'confirmed' WHEN {has('lower(x.wc)', NEG)} <> {has('lower(y.wc)', NEG)} AND len(list_intersect(x.t, y.t)) / CAST(greatest(len(x.t), 1) AS DOUBLE) > CAST(0.3 AS DOUBLE) THEN 'contradicted' END AS verdict FROM bp JOIN ws x ON x.mid = bp.a JOIN ws y ON y.mid = bp.b), vf AS (SELECT * FROM vd WHERE verdict IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a ORDER BY g, b) = 1)"
C1 = f"{EX}, {NW}, " + DEC.replace("mem_new", "nw").replace("mem_old", "ve") + f", {VER}, u AS (SELECT target, arg_max(n.content, n.ord) AS c, arg_max(n.importance, n.ord) AS i, max(n.score) AS sc FROM dec JOIN nw n ON n.mid = dec.a WHERE op = 'UPDATE' GROUP BY target), cu AS (SELECT o.mid, o.mtype, coalesce(u.c, o.content) AS content, coalesce(u.i, o.importance) AS importance, greatest(o.score, u.sc) AS score, o.confidence, o.created_s, o.last_accessed_s AS la FROM ve o LEFT JOIN u ON u.target = o.mid UNION ALL SELECT n.mid, CASE WHEN verdict = 'confirmed' THEN 'fact' ELSE n.mtype END, n.content, n.importance, n.score, CASE verdict WHEN 'confirmed' THEN CAST(1 AS DOUBLE) WHEN 'contradicted' THEN greatest(CAST(0.1 AS DOUBLE), n.confidence - CAST(0.3 AS DOUBLE)) ELSE n.confidence END, n.created_s, NULL FROM nw n JOIN dec ON dec.a = n.mid LEFT JOIN vf ON vf.a = n.mid WHERE op = 'ADD'), de AS (SELECT mid, mtype, content, importance, confidence, created_s, score * (1 - {RATE} * (1 - importance * CAST(0.5 AS DOUBLE)) * {KEEP}) AS score FROM cu), ac AS (SELECT * FROM de WHERE score >= CAST(0.05 AS DOUBLE))"


def consolidated(s, d):
    from ..sources import io

    m = io.stored(X.memx(s, d).withColumn("ord", C("mid")), "memx")
    stored, seg = m.where("session_id % 5 <> 0"), m.where("session_id % 5 = 0")
    return jobs.consolidate(stored, seg, X.names(m), imp(), LIT(False), AS, NEG, NEG, stale_days=20)


@q("c01_consolidate", f"{C1} SELECT mid, mtype, content, round(confidence, 6) AS confidence, round(score, 6) AS score, CASE WHEN score < CAST(0.05 AS DOUBLE) THEN 1 ELSE 0 END AS state, CASE WHEN score >= CAST(0.05 AS DOUBLE) THEN {AGE} > 20 END AS stale FROM de UNION ALL SELECT mid, mtype, content, round(confidence, 6), round(score, 6), 2, NULL FROM mem_old WHERE mid NOT IN (SELECT mid FROM ve)")
def c01(s, d):
    return consolidated(s, d).records.select("mid", "mtype", "content", F.round("confidence", 6).alias("confidence"), F.round("score", 6).alias("score"), "state", "stale")


@q("c01_outputs", f"{C1}, fc AS (SELECT entity, count(*) AS n FROM entx JOIN cu ON cu.mid = entx.mid WHERE mtype = 'fact' GROUP BY entity), ls AS (SELECT entity, max(created_s) AS last_s FROM entx JOIN ve ON ve.mid = entx.mid WHERE mtype = 'summary' GROUP BY entity) SELECT 'summaries' AS part, count(*) AS n FROM fc LEFT JOIN ls ON ls.entity = fc.entity WHERE (last_s IS NULL AND n >= 3) OR (n >= 8 AND floor(({AS} - last_s) / 86400.0) >= 7) UNION ALL SELECT 'profiles', count(*) FROM entx JOIN ac ON ac.mid = entx.mid UNION ALL SELECT 'postings', count(*) FROM (SELECT unnest({KEYS.format('content')}) FROM ac) UNION ALL SELECT 'relations', count(*) FROM entx JOIN ac ON ac.mid = entx.mid UNION ALL SELECT 'rankings', least(50, count(*)) FROM ac UNION ALL SELECT 'snapshot', least(5, count(*) FILTER (WHERE importance >= CAST(0.9 AS DOUBLE))) + least(5, count(*) FILTER (WHERE importance >= CAST(0.7 AS DOUBLE) AND importance < CAST(0.9 AS DOUBLE))) + least(15, count(*)) + least(10, (SELECT count(DISTINCT entity) FROM entx JOIN ac ON ac.mid = entx.mid)) + 5 FROM ac")
def c01o(s, d):
    out = consolidated(s, d)
    rows = None
    for part in ("summaries", "profiles", "postings", "relations", "rankings", "snapshot"):
        n = getattr(out, part).agg(F.count(LIT(1)).alias("n")).select(LIT(part).alias("part"), "n")
        rows = n if rows is None else rows.unionByName(n)
    return rows


DERIVED = f"""{C1}, fc AS (SELECT entity, count(*) AS n FROM entx JOIN cu ON cu.mid = entx.mid WHERE mtype = 'fact' GROUP BY entity), ls AS (SELECT entity, max(created_s) AS last_s FROM entx JOIN ve ON ve.mid = entx.mid WHERE mtype = 'summary' GROUP BY entity), en AS (SELECT entity, mtype, ac.mid FROM entx JOIN ac ON ac.mid = entx.mid)
SELECT 'summaries' AS part, fc.entity AS key, CAST(0 AS BIGINT) AS mid, n FROM fc LEFT JOIN ls ON ls.entity = fc.entity WHERE (last_s IS NULL AND n >= 3) OR (n >= 8 AND floor(({AS} - last_s) / 86400.0) >= 7)
UNION ALL SELECT 'profiles', entity || ' ' || mtype, mid, count(*) FILTER (WHERE mtype IN ('fact', 'belief')) OVER (PARTITION BY entity) FROM en
UNION ALL SELECT 'relations', entity || ' ' || mtype, mid, 0 FROM en
UNION ALL SELECT 'postings', unnest({KEYS.format('content')}), mid, 0 FROM ac
UNION ALL SELECT 'rankings', '', mid, row_number() OVER (ORDER BY score DESC, mid) AS n FROM ac QUALIFY n <= 50"""


@q("c01_derived", DERIVED)
def c01r(s, d):
    out = consolidated(s, d)
    row = lambda df, part, key, mid, n: df.select(LIT(part).alias("part"), key.alias("key"), mid.cast("long").alias("mid"), n.cast("long").alias("n"))
    typed = F.concat_ws(" ", "entity", "mtype")
    rows = row(out.summaries, "summaries", C("entity"), LIT(0), C("n_facts"))
    rows = rows.unionByName(row(out.profiles, "profiles", typed, C("mid"), C("n"))).unionByName(row(out.relations, "relations", typed, C("mid"), LIT(0)))
    return rows.unionByName(row(out.postings, "postings", C("term"), C("mid"), LIT(0))).unionByName(row(out.rankings, "rankings", LIT(""), C("mid"), C("rank")))


@q("x02_known_facts", f"{EX}, {NW}, {VER} SELECT nw.mid, coalesce(verdict, 'unchanged') AS verdict, b AS fact FROM nw LEFT JOIN vf ON vf.a = nw.mid WHERE nw.mtype = 'belief'")
def x02(s, d):
    m = X.memx(s, d).withColumn("ord", C("mid"))
    _, valid = curate.split_expired(m.where("session_id % 5 <> 0"), AS)
    new = jobs.extract(m.where("session_id % 5 = 0 AND length(trim(content)) > 5"), imp(), LIT(False))
    return curate.verify_beliefs(new.where("mtype = 'belief'"), jobs.known_facts(valid, new), X.entx(s, d), NEG).select("mid", "verdict", "fact")


@q("t06_sample", f"SELECT mid, '[' || printf('%.1f', {IMP}) || '] ' || substring(content, 1, 40) || '...' AS line FROM mem WHERE ({NOISE.replace('importance <', 'CAST(0.5 AS DOUBLE) <')}) IS NULL AND {IMP} >= CAST(0.3 AS DOUBLE) ORDER BY mid LIMIT 3")
def t06(s, d):
    kept = clean.importance_filter(X.mem(s, d).drop("importance"), imp()).where("method = 'rule'")
    return clean.sample(kept, 3, "mid")


@q("t07_dynamic_sort", f"SELECT mid, rank FROM (SELECT mid, row_number() OVER (ORDER BY round({DYN}, 9) DESC, mid) AS rank FROM mem) WHERE rank <= 50")
def t07(s, d):
    score = R.dynamic_score(C("score"), C("importance"), C("mtype"), C("created_s"), boost_col(), LIT(AS))
    return report.by_dynamic_score(X.mem(s, d), score).select("mid", "rank")


@q("u01_scorer", f"SELECT mid, round(CASE WHEN {IMP} < CAST(0.3 AS DOUBLE) THEN {IMP} + CAST(0.2 AS DOUBLE) ELSE {IMP} END, 6) AS importance, CASE WHEN {IMP} < CAST(0.3 AS DOUBLE) THEN 'external' ELSE 'rule' END AS method FROM mem WHERE ({NOISE.replace('importance <', 'CAST(0.5 AS DOUBLE) <')}) IS NULL AND ({IMP} >= CAST(0.3 AS DOUBLE) OR ({IMP} >= CAST(0.2 AS DOUBLE) AND mid % 2 = 0))")
def u01(s, d):
    scorer = lambda rows: rows.withColumn("importance", F.when(C("mid") % 2 == 0, C("importance") + 0.2).otherwise(0.0))
    return clean.importance_filter(X.mem(s, d).drop("importance"), imp(), scorer=scorer).select("mid", F.round("importance", 6).alias("importance"), "method")


@q("u03_external_entities", r"SELECT mid, CASE WHEN len(b) > 0 THEN 'builtin' WHEN len(l) > 0 THEN 'learned' WHEN mid % 2 = 0 THEN 'external' ELSE 'none' END AS source, CASE WHEN len(b) > 0 THEN array_to_string(b, ',') WHEN len(l) > 0 THEN array_to_string(l, ',') WHEN mid % 2 = 0 THEN 'Extra' ELSE '' END AS entities FROM (SELECT mid, list_sort(list_distinct(regexp_extract_all(content, '(?i)worth[a-z]'))) AS b, list_filter(['The', 'Thnt'], lambda w: contains(content, w)) AS l FROM mem)")
def u03(s, d):
    t = C("content")
    rows = X.mem(s, d).select("mid", "content", entities.builtin_entities(t, ("worth[a-z]",)).alias("builtin"), F.filter(F.array(LIT("The"), LIT("Thnt")), lambda w: F.contains(t, w)).alias("learned"))
    ask = lambda rows: rows.withColumn("reply", F.when(C("mid") % 2 == 0, LIT('["Extra"]')).otherwise(LIT("no answer")))
    return entities.with_external(rows, ask).select("mid", "source", F.array_join("entities", ",").alias("entities"))


@q("u04_extracted_validity", "v AS (SELECT mem.mid AS vid, entity, a AS attribute, regexp_extract(content, a || ' ([a-z]+)', 1) AS value, created_s * 1000000 AS ts_us FROM mem JOIN ent ON ent.mid = mem.mid, (VALUES ('with'), ('from')) AS t(a)) SELECT vid, entity, attribute, value, lead(ts_us) OVER (PARTITION BY entity, attribute ORDER BY ts_us, vid) AS valid_to FROM v WHERE value <> ''")
def u04(s, d):
    found = {a: F.regexp_extract("content", f"{a} ([a-z]+)", 1) for a in ("with", "from")}
    return temporal.validity(temporal.extracted(X.mem(s, d), X.ent(s, d), found)).select("vid", "entity", "attribute", "value", "valid_to")


# --- retrieval ----------------------------------------------------------------------------------------------------------

KW = f"po AS (SELECT mid, unnest({KEYS.format('content')}) AS term FROM mem), kw AS (SELECT s.qid, po.mid, count(*) AS score FROM {SHINGLES} s JOIN po ON po.term = s.term GROUP BY 1, 2)"
EN = "qf AS (SELECT DISTINCT qid, e.entity FROM qry JOIN (SELECT DISTINCT entity FROM ent) e ON contains(query, e.entity)), en AS (SELECT qid, mid, count(*) AS score FROM qf JOIN ent ON ent.entity = qf.entity GROUP BY 1, 2)"
TF = "tc AS (SELECT mid, term, count(*) AS tf FROM (SELECT mid, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS term FROM mem) GROUP BY 1, 2), idf AS (SELECT term, ln((1 + (SELECT count(*) FROM mem)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf FROM tc GROUP BY term), wt AS (SELECT mid, tc.term, idf, tf * idf AS w FROM tc JOIN idf ON idf.term = tc.term), sz AS (SELECT mid, sqrt(sum(w * w)) AS size FROM wt GROUP BY mid), qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM qry) GROUP BY 1, 2), ti AS (SELECT qid, wt.mid, sum(qtf * idf * w) / any_value(size) AS score FROM qt JOIN wt ON wt.term = qt.term JOIN sz ON sz.mid = wt.mid GROUP BY 1, 2)"
TOPN = lambda name, src, n: f"{name} AS (SELECT qid, mid, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, mid) AS pos FROM {src} QUALIFY pos <= {n})"


def posts(s, d):
    return index.postings(X.mem(s, d))


def kw(s, d, most=None):
    return search.keyword_channel(X.qry(s, d), posts(s, d), most)


def en(s, d, most=None):
    return search.entity_channel(search.query_entities(X.qry(s, d), X.ent(s, d)), X.ent(s, d), most)


def ti(s, d, most=None):
    return search.tfidf_channel(X.qry(s, d), X.mem(s, d), most)


best = search.top


@q("j01_keyword_search", f"{KW}, {TOPN('k', 'kw', 20)} SELECT qid, mid, score, pos FROM k")
def j01(s, d):
    return search.top(kw(s, d), 20)


@q("j02_entity_search", f"{EN}, {TOPN('k', 'en', 20)} SELECT qid, mid, score, pos FROM k")
def j02(s, d):
    return search.top(en(s, d), 20)


@q("j04_pending_search", "w AS (SELECT qid, list_distinct(regexp_extract_all(lower(query), '[a-zA-Z]+')) AS w FROM qry) SELECT qid, mid, importance AS score, round(len(list_filter(w, lambda x: contains(lower(content), x))) / CAST(len(w) AS DOUBLE), 6) AS match FROM w, (SELECT mid, content, importance FROM mem) WHERE len(w) > 0 AND len(list_filter(w, lambda x: contains(lower(content), x))) > 0")
def j04(s, d):
    return search.pending_channel(X.qry(s, d), X.mem(s, d)).withColumn("match", F.round("match", 6))


@q("g03_tfidf_search", f"{TF}, {TOPN('k', 'ti', 10)} SELECT qid, mid, pos, round(score, 9) AS score FROM k")
def g03(s, d):
    return best(ti(s, d), 10).select("qid", "mid", "pos", F.round("score", 9).alias("score"))


@q("g04_bm25_search", "tc AS (SELECT mid, term, count(*) AS tf FROM (SELECT mid, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS term FROM mem) GROUP BY 1, 2), dl AS (SELECT mid, CAST(sum(tf) AS DOUBLE) AS dl FROM tc GROUP BY mid), st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS a FROM dl), df AS (SELECT term, count(*) AS df FROM tc GROUP BY term), qt AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(array_to_string(regexp_extract_all(query, '[A-Za-z][A-Za-z0-9_-]+'), ' ')), '[a-z0-9]+')) AS term FROM qry), bm AS (SELECT qid, tc.mid, sum(ln(1 + (n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / a))) AS score FROM qt JOIN df ON df.term = qt.term JOIN tc ON tc.term = qt.term JOIN dl ON dl.mid = tc.mid, st GROUP BY 1, 2), k AS (SELECT qid, mid, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, mid) AS pos FROM bm QUALIFY pos <= 10) SELECT qid, mid, pos, round(score, 9) AS score FROM k")
def g04(s, d):
    return best(search.bm25_channel(X.qry(s, d), X.mem(s, d)), 10).select("qid", "mid", "pos", F.round("score", 9).alias("score"))


@q("g05_vector_search", "SELECT * FROM (SELECT a.vec_id AS qid, b.vec_id AS mid, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) DESC, b.vec_id) AS pos, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) WHERE pos <= 10")
def g05(s, d):
    v = X.table(s, d, "embeddings")
    return search.vector_channel(v.where("vec_id % 20 = 0").select(C("vec_id").alias("qid"), C("embedding").alias("qv")), v.select(C("vec_id").alias("mid"), C("embedding").alias("v")), 10, digits=6)


@q("j01_early_stop", f"{KW}, {TOPN('k', 'kw', 20)} SELECT qid, mid, CAST(score AS BIGINT) AS score, pos FROM k")
def j01e(s, d):
    found = topk.search(topk.keyword_weights(X.qry(s, d)), topk.build(topk.keyword_parts(posts(s, d))), 20).results
    return found.select("qid", "mid", C("score").cast("long").alias("score"), "pos")


O["g03_early_stop"], O["g04_early_stop"] = O["g03_tfidf_search"], O["g04_bm25_search"]


@q("g03_early_stop")
def g03e(s, d):
    found = topk.search(topk.tfidf_terms(X.qry(s, d)), topk.build(topk.tfidf_parts(X.mem(s, d))), 10).results
    return found.select("qid", "mid", "pos", F.round("score", 9).alias("score"))


@q("g04_early_stop")
def g04e(s, d):
    found = topk.search(topk.bm25_terms(X.qry(s, d)), topk.build(topk.bm25_parts(X.mem(s, d))), 10).results
    return found.select("qid", "mid", "pos", F.round("score", 9).alias("score"))


def vectors(s, d):
    v = X.table(s, d, "embeddings")
    kind = F.when(C("vec_id") % 3 == 0, "fact").otherwise("belief")
    return v.select(C("vec_id").alias("mid"), C("embedding").alias("v"), kind.alias("mtype"))


G5 = "SELECT * FROM (SELECT a.vec_id AS qid, b.vec_id AS mid, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) DESC, b.vec_id) AS pos, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0{}) WHERE pos <= 10"


@q("g05_index_search", G5.format(""))
def g05i(s, d):
    v = vectors(s, d)
    return cells.search(v.where("mid % 20 = 0").select(C("mid").alias("qid"), C("v").alias("qv")), cells.build(v, 24), 10, probes=4, digits=6)


@q("g05_typed_index_search", G5.format(" AND b.vec_id % 3 = 0"))
def g05t(s, d):
    v = vectors(s, d)
    return cells.search(v.where("mid % 20 = 0").select(C("mid").alias("qid"), C("v").alias("qv")), cells.build(v, 24), 10, probes=4, digits=6, where="mtype = 'fact'")


def changed(s, d):
    """An index that five changes make: two thirds of the records, the rest, edits of every tenth, deletes of every seventh, and some again."""
    from ..sources import io

    root = io.shared_path(s, "index")
    m = X.mem(s, d).join(X.table(s, d, "embeddings").select((C("vec_id") * 1000).alias("mid"), C("embedding").alias("v")), "mid", "left").select("mid", "content", "mtype", "v")
    edited = lambda df: df.withColumn("content", F.concat("content", LIT(" zebra quagga")))
    none = m.limit(0)
    for ups, gone in ((m.where("mid % 3 <> 0"), None), (m.where("mid % 3 = 0"), None), (edited(m.where("mid % 10 = 0")), None), (none, m.where("mid % 7 = 0")), (edited(m.where("mid % 21 = 0")), m.where("mid % 11 = 0"))):
        segments.change(s, root, ups, gone, fanout=3)
    return root


CHG = f"mm AS (SELECT mid, CASE WHEN mid % 10 = 0 OR mid % 21 = 0 THEN content || ' zebra quagga' ELSE content END AS content FROM mem WHERE (mid % 7 <> 0 OR mid % 21 = 0) AND (mid % 11 <> 0 OR mid % 21 = 0))"


@q("g07_segment_search", f"{CHG}, po AS (SELECT mid, unnest({KEYS.format('content')}) AS term FROM mm), kw AS (SELECT s.qid, po.mid, count(*) AS score FROM (SELECT qid, term FROM {SHINGLES} UNION ALL SELECT -1, unnest(['zebra', 'quagga'])) s JOIN po ON po.term = s.term GROUP BY 1, 2), {TOPN('k', 'kw', 20)} SELECT qid, mid, score, pos FROM k")
def g07s(s, d):
    ask = X.qry(s, d).unionByName(s.range(1).select(LIT(-1).cast("long").alias("qid"), LIT("zebra").alias("query")))
    terms = search.keyword_terms(ask).where("qid >= 0").unionByName(s.range(1).select(LIT(-1).cast("long").alias("qid"), F.explode(F.array(LIT("zebra"), LIT("quagga"))).alias("term")))
    return search.top(search.keyword_matches(terms, segments.live_postings(s, changed(s, d))), 20)


@q("g07_segment_vectors", f"{CHG}, vv AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id * 1000 IN (SELECT mid FROM mm)) SELECT * FROM (SELECT a.vec_id AS qid, b.vec_id * 1000 AS mid, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) DESC, b.vec_id) AS pos, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a, vv b WHERE a.vec_id % 20 = 0) WHERE pos <= 10")
def g07v(s, d):
    qs = vectors(s, d).where("mid % 20 = 0").select(C("mid").alias("qid"), C("v").alias("qv"))
    return search.vector_channel(qs, segments.live_vectors(s, changed(s, d)).select("mid", "v"), 10, digits=6)


@q("g06_hybrid", f"{KW}, {TF} SELECT coalesce(kw.qid, ti.qid) AS qid, coalesce(kw.mid, ti.mid) AS mid, round(CAST(0.3 AS DOUBLE) * coalesce(kw.score, 0) + CAST(0.7 AS DOUBLE) * coalesce(round(ti.score, 9), 0), 6) AS score FROM kw FULL JOIN ti ON kw.qid = ti.qid AND kw.mid = ti.mid WHERE CAST(0.3 AS DOUBLE) * coalesce(kw.score, 0) + CAST(0.7 AS DOUBLE) * coalesce(round(ti.score, 9), 0) >= CAST(0.2 AS DOUBLE)")
def g06(s, d):
    return search.hybrid_search(X.qry(s, d), X.mem(s, d), posts(s, d)).withColumn("score", F.round("score", 6))


@q("g07_index_refresh", "SELECT count(*) AS total, count(v.mid) AS indexed, count(*) FILTER (WHERE v.mid IS NULL) AS missing FROM mem LEFT JOIN (SELECT DISTINCT vec_id * 1000 AS mid FROM embeddings) v ON v.mid = mem.mid")
def g07(s, d):
    return search.index_refresh(X.mem(s, d), X.table(s, d, "embeddings").select((C("vec_id") * 1000).alias("mid")))


CH = f"{KW}, {EN}, {TF}, {TOPN('k1', 'kw', 20)}, {TOPN('k2', 'en', 20)}, {TOPN('k3', 'ti', 20)}"
FU = f"{CH}, fx AS (SELECT qid, mid, sum(1 / CAST(60 + pos AS DOUBLE)) AS score FROM (SELECT qid, mid, pos FROM k1 UNION ALL SELECT qid, mid, pos FROM k2 UNION ALL SELECT qid, mid, pos FROM k3) GROUP BY 1, 2), {TOPN('fu', 'fx', 35)}"


def channels(s, d):
    return [best(c(s, d, 20), 20) for c in (kw, en, ti)]


def fused(s, d):
    return best(search.reciprocal_ranks(channels(s, d)), 35)


@q("g01_rank_fusion", f"{FU} SELECT qid, mid, pos, round(score, 9) AS score FROM fu")
def g01(s, d):
    return fused(s, d).select("qid", "mid", "pos", F.round("score", 9).alias("score"))


@q("g02_priority_merge", f"{CH} SELECT qid, mid, channel, pos FROM (SELECT qid, mid, 0 AS channel, pos FROM k1 UNION ALL SELECT qid, mid, 1, pos FROM k2 UNION ALL SELECT qid, mid, 2, pos FROM k3) QUALIFY row_number() OVER (PARTITION BY qid, mid ORDER BY channel, pos) = 1")
def g02(s, d):
    return search.merge_by_priority(channels(s, d)).select("qid", "mid", "channel", "pos")


@q("a16_channel_stats", f"{CH} SELECT qid, count(*) FILTER (WHERE c = 1) AS keyword, count(*) FILTER (WHERE c = 2) AS entity, count(*) FILTER (WHERE c = 3) AS tfidf FROM (SELECT qid, 1 AS c FROM k1 UNION ALL SELECT qid, 2 FROM k2 UNION ALL SELECT qid, 3 FROM k3) GROUP BY qid")
def a16(s, d):
    return search.channel_stats(dict(zip(("keyword", "entity", "tfidf"), channels(s, d), strict=True)))


RR = f"rr AS (SELECT k2.qid, k2.mid, {RER.format('k2.s2')} AS score FROM (SELECT qid, mid, score AS s2 FROM en) k2 JOIN mem ON mem.mid = k2.mid), rt AS (SELECT qid, mid, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, mid) AS pos FROM rr QUALIFY pos <= 8)"


def ranked(s, d, n=8):
    return best(search.rerank(en(s, d), X.mem(s, d), AS), n)


@q("t02_rerank_cut", f"{EN}, {RR} SELECT qid, mid, pos, round(score, 9) AS score FROM rt")
def t02(s, d):
    return ranked(s, d).select("qid", "mid", "pos", F.round("score", 9).alias("score"))


@q("j11_spread", f"{EN}, {RR}, he AS (SELECT DISTINCT qid, entity FROM rt JOIN ent ON ent.mid = rt.mid WHERE pos <= 5), nr AS (SELECT he.qid, he.entity, m.mid, m.score FROM he JOIN ent ON ent.entity = he.entity JOIN mem m ON m.mid = ent.mid WHERE mtype = 'fact' AND NOT EXISTS (SELECT 1 FROM rt WHERE rt.qid = he.qid AND rt.mid = m.mid)), kp AS (SELECT * FROM nr QUALIFY row_number() OVER (PARTITION BY qid, entity ORDER BY score DESC, mid) <= 5), bt AS (SELECT qid, mid, max(score) * CAST(0.3 AS DOUBLE) AS score FROM kp GROUP BY 1, 2) SELECT qid, mid, round(score, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, mid) AS pos FROM bt QUALIFY pos <= 3")
def j11(s, d):
    return search.spread(ranked(s, d), X.ent(s, d), X.mem(s, d).where("mtype = 'fact'"), most_results=8).select("qid", "mid", "pos", F.round("score", 9).alias("score"))


@q("j13_external_hits", "SELECT m.session_id AS qid, m.mid, CAST(m.source_turn AS DOUBLE) AS score FROM mem m WHERE m.mid % 3 = 0")
def j13(s, d):
    from ..functions.text import record_id

    rid = F.concat(record_id(LIT("f"), F.concat("content", C("mid").cast("string")), C("created_s")))
    m = X.mem(s, d).withColumn("id", rid)
    hits = m.where("mid % 3 = 0").select(C("session_id").alias("qid"), F.concat(LIT("> ["), "id", LIT("] text")).alias("snippet"), C("source_turn").cast("double").alias("score"))
    return search.external_channel(hits, m)


@q("p28_prompt_block", f"{EN}, {RR}, x AS (SELECT rt.qid, rt.pos, m.mid, m.content, upper(substring(m.mtype, 1, 1)) AS t, CASE WHEN m.score >= CAST(0.8 AS DOUBLE) THEN 'direct' WHEN m.score >= CAST(0.5 AS DOUBLE) THEN 'marked' END AS tier FROM rt JOIN mem m ON m.mid = rt.mid), y AS (SELECT *, row_number() OVER (PARTITION BY qid, tier ORDER BY pos) AS r FROM x WHERE tier IS NOT NULL), z AS (SELECT qid, tier, r, CASE tier WHEN 'direct' THEN '- [' || t || '] ' || substring(content, 1, 200) ELSE '- [' || t || '] ' || substring(content, 1, 150) || ' (ref:' || mid || ')' END AS line FROM y WHERE (tier = 'direct' AND r <= 5) OR (tier = 'marked' AND r <= 3)), b AS (SELECT qid, CASE WHEN bool_or(tier = 'direct') THEN '## 相关记忆' ELSE '## 可能相关' END || chr(10) || string_agg(line, chr(10) ORDER BY tier, r) AS t FROM z GROUP BY qid) SELECT qid, CASE WHEN length(t) * 1.5 > 500 THEN substring(t, 1, 333) || chr(10) || '...' ELSE t END AS block FROM b")
def p28(s, d):
    m = X.mem(s, d)
    r = ranked(s, d).select("qid", "mid", "pos").join(m.select("mid", "mtype", "content", R.injection_tier(C("score")).alias("tier")), "mid")
    return search.prompt_block(r)


@q("d09_entity_first", f"{EN}, {KW}, f AS (SELECT qid, mid, CAST(score AS DOUBLE) / 4 AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, mid) AS pos FROM en QUALIFY pos <= 10), st AS (SELECT qid, max(score) AS best, count(*) AS n FROM f GROUP BY qid), mo AS (SELECT kw.qid, kw.mid, kw.score, 10 - coalesce(n, 0) AS room FROM kw LEFT JOIN st ON st.qid = kw.qid WHERE coalesce(best, 0) <= CAST(0.85 AS DOUBLE) AND NOT EXISTS (SELECT 1 FROM f WHERE f.qid = kw.qid AND f.mid = kw.mid)) SELECT qid, mid, score, 'entity' AS channel FROM f UNION ALL SELECT qid, mid, CAST(score AS DOUBLE), 'keyword' FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, mid) AS pos FROM mo) WHERE pos <= room")
def d09(s, d):
    return search.entity_first(en(s, d).withColumn("score", C("score") / 4), kw(s, d).withColumn("score", C("score").cast("double")))


@q("d10_enriched", f"{EN}, x AS (SELECT qid, en.mid, CAST(0.4 AS DOUBLE) * en.score + CAST(0.35 AS DOUBLE) * mem.score + CAST(0.25 AS DOUBLE) * importance AS score FROM en JOIN mem ON mem.mid = en.mid) SELECT qid, mid, round(score, 9) AS score FROM x QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, mid) <= 15")
def d10(s, d):
    return search.enriched(en(s, d), X.mem(s, d)).select("qid", "mid", F.round("score", 9).alias("score"))


@q("g08_route", f"{FU}, rr AS (SELECT fu.qid, fu.mid, {RER.format('fu.s2')} AS score FROM (SELECT qid, mid, score AS s2 FROM fu) fu JOIN mem ON mem.mid = fu.mid) SELECT qid, mid, pos, round(score, 9) AS score FROM (SELECT qid, mid, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 7) DESC, mid) AS pos FROM rr) WHERE pos <= 8")
def g08(s, d):
    r = search.rerank(fused(s, d).select("qid", "mid", "score"), X.mem(s, d), AS)
    return search.top(r, 8, F.desc(F.round("score", 7))).select("qid", "mid", "pos", F.round("score", 9).alias("score"))


BM = "bl AS (SELECT mid, CAST(sum(tf) AS DOUBLE) AS dl FROM tc GROUP BY mid), bs AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS a FROM bl), bd AS (SELECT term, count(*) AS df FROM tc GROUP BY term), bq AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(array_to_string(regexp_extract_all(query, '[A-Za-z][A-Za-z0-9_-]+'), ' ')), '[a-z0-9]+')) AS term FROM qry), bm AS (SELECT qid, tc.mid, sum(ln(1 + (n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / a))) AS score FROM bq JOIN bd ON bd.term = bq.term JOIN tc ON tc.term = bq.term JOIN bl ON bl.mid = tc.mid, bs GROUP BY 1, 2)"
LAYERQ = "CASE " + " ".join(f"WHEN {has('lower(query)', w)} THEN {n}" for _, n, w in TRIG) + " ELSE 2 END"
CLASSES = f"kc AS (SELECT qid, query, CASE WHEN {has('lower(query)', ('eron',))} OR {LAYERQ} = 0 THEN 'precise' WHEN {has('lower(query)', ('and',))} THEN 'broad' ELSE 'topic' END AS class FROM qry), ks AS (SELECT qid, query, CASE class WHEN 'precise' THEN 15 WHEN 'topic' THEN 25 ELSE 35 END AS initial, CASE class WHEN 'precise' THEN 10 WHEN 'topic' THEN 16 ELSE 25 END AS rerank, CASE class WHEN 'precise' THEN 8 WHEN 'topic' THEN 13 ELSE 18 END AS final FROM kc)"
#: The queries hold no time words of the default list; these proxies occur in some.
DAYS_OF = {"haat": 3, "erha": 5, "ansh": 9}
TIMES = "tq AS (SELECT qid, CASE " + " ".join(f"WHEN contains(query, '{w}') THEN {n}" for w, n in DAYS_OF.items()) + f" END AS days FROM qry), tr AS (SELECT qid, mid, score FROM tq JOIN mem ON created_s >= {AS} - 86400 * days AND created_s < {AS} - 86400 * days + 86400)"
CUT = lambda name, src: f"{name} AS (SELECT x.qid, x.mid, x.score, row_number() OVER (PARTITION BY x.qid ORDER BY round(x.score, 9) DESC, x.mid) AS pos FROM {src} x JOIN ks ON ks.qid = x.qid WHERE x.qid NOT IN (SELECT qid FROM tr) QUALIFY pos <= ks.initial)"
PEND = f"pw AS (SELECT qid, list_distinct(regexp_extract_all(lower(query), '[a-zA-Z]+')) AS w FROM qry), pn AS (SELECT qid, mid, importance AS score FROM pw, (SELECT mid, content, importance FROM mem) WHERE len(w) > 0 AND qid NOT IN (SELECT qid FROM tr) AND len(list_filter(w, lambda x: contains(lower(content), x))) > 0)"
VEC = "ve AS (SELECT a.vec_id AS qid, b.vec_id * 1000 AS mid, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT qid FROM qry))"
ALIKE = "qe AS (SELECT qid, entity AS q FROM qf), " + SIMQ
DAYSM = f"CAST(floor(({AS} - last_accessed_s) / 86400.0) AS BIGINT)"
RERI = f"CAST(0.35 AS DOUBLE) * exp(-(CASE WHEN mem.mid % 4 = 0 THEN CAST(0.05 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END) * coalesce(greatest(0, {DAYSM}), 30)) + CAST(0.35 AS DOUBLE) * importance + CAST(0.3 AS DOUBLE) * (CAST(0.5 AS DOUBLE) * mg.s2 + CAST(0.5 AS DOUBLE) * mem.score)"
MERGE = "fx AS (SELECT qid, mid, sum(1 / CAST(60 + pos AS DOUBLE)) AS score FROM (SELECT qid, mid, pos FROM c1 UNION ALL SELECT qid, mid, pos FROM c2 UNION ALL SELECT qid, mid, pos FROM c3 UNION ALL SELECT qid, mid, pos FROM c4 UNION ALL SELECT qid, mid, pos FROM c5) GROUP BY 1, 2), fu AS (SELECT fx.qid, fx.mid, fx.score, row_number() OVER (PARTITION BY fx.qid ORDER BY round(fx.score, 9) DESC, fx.mid) AS pos FROM fx)"
PRIO = "fu AS (SELECT qid, mid, CAST(score AS DOUBLE) AS score, 0 AS pos FROM (SELECT qid, mid, 0 AS c, pos, score FROM c5 UNION ALL SELECT qid, mid, 1, pos, score FROM c2 UNION ALL SELECT qid, mid, 2, pos, CAST(score AS DOUBLE) FROM c3 UNION ALL SELECT qid, mid, 3, pos, CAST(score AS DOUBLE) FROM c4) QUALIFY row_number() OVER (PARTITION BY qid, mid ORDER BY c, pos) = 1)"
ROUTED = lambda merge: f"{KW}, {EN}, {TF}, {BM}, {CLASSES}, {TIMES}, {PEND}, {VEC}, {CUT('c1', 'ti')}, {CUT('c2', 'bm')}, {CUT('c3', 'kw')}, {CUT('c4', 'en')}, {CUT('c5', 've')}, {merge}, mg AS (SELECT qid, mid, score AS s2 FROM pn UNION ALL SELECT fu.qid, fu.mid, fu.score FROM fu JOIN ks ON ks.qid = fu.qid WHERE fu.pos <= rerank AND NOT EXISTS (SELECT 1 FROM pn WHERE pn.qid = fu.qid AND pn.mid = fu.mid)), rr AS (SELECT mg.qid, mg.mid, {RERI} AS score FROM mg JOIN mem ON mem.mid = mg.mid), {ALIKE}, rx AS (SELECT DISTINCT rr.qid, rr.mid FROM rr JOIN ent ON ent.mid = rr.mid JOIN qe ON qe.qid = rr.qid AND qe.q = ent.entity), rn AS (SELECT DISTINCT rr.qid, rr.mid FROM rr JOIN ent ON ent.mid = rr.mid JOIN qe ON qe.qid = rr.qid JOIN sim ON sim.q = qe.q AND sim.e = ent.entity WHERE similarity >= CAST(0.5 AS DOUBLE)), ri AS (SELECT rr.qid, rr.mid, CASE WHEN rx.mid IS NULL AND rn.mid IS NOT NULL THEN rr.score * CAST(0.1 AS DOUBLE) ELSE rr.score END AS score FROM rr LEFT JOIN rx ON rx.qid = rr.qid AND rx.mid = rr.mid LEFT JOIN rn ON rn.qid = rr.qid AND rn.mid = rr.mid), rt AS (SELECT ri.qid, ri.mid, ri.score, final, row_number() OVER (PARTITION BY ri.qid ORDER BY round(ri.score, 9) DESC, ri.mid) AS pos FROM ri JOIN ks ON ks.qid = ri.qid QUALIFY pos <= ks.rerank), he AS (SELECT DISTINCT qid, entity FROM rt JOIN ent ON ent.mid = rt.mid WHERE pos <= 5), nr AS (SELECT he.qid, he.entity, m.mid, m.score FROM he JOIN ent ON ent.entity = he.entity JOIN mem m ON m.mid = ent.mid WHERE mtype = 'fact' AND NOT EXISTS (SELECT 1 FROM rt WHERE rt.qid = he.qid AND rt.mid = m.mid)), kp AS (SELECT * FROM nr QUALIFY row_number() OVER (PARTITION BY qid, entity ORDER BY score DESC, mid) <= 5), bt AS (SELECT qid, mid, max(score) * CAST(0.3 AS DOUBLE) AS score FROM kp GROUP BY 1, 2), fi AS (SELECT qid, mid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, mid) AS pos, score, 'temporal' AS source FROM tr UNION ALL SELECT qid, mid, pos, score, 'search' FROM rt WHERE pos <= final UNION ALL SELECT qid, mid, 1000 + row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, mid) AS pos, score, 'spread' FROM bt QUALIFY pos <= 1003)"


def routed(s, d, tfidf=True):
    m, v = X.mem(s, d), X.table(s, d, "embeddings")
    qv = v.join(X.qry(s, d).select(C("qid").alias("vec_id")), "vec_id", "left_semi").select(C("vec_id").alias("qid"), C("embedding").alias("qv"))
    return search.route(
        X.qry(s, d), m.withColumn("is_identity", C("mid") % 4 == 0), X.ent(s, d), posts(s, d), AS, pending=m, external=search.bm25_channel(X.qry(s, d), m), query_vectors=qv,
        vectors=v.select((C("vec_id") * 1000).alias("mid"), C("embedding").alias("v")), tfidf=tfidf, triggers=TRIG, precise=("eron",), broad=("and",), time_words=DAYS_OF,
    )


ROUTE_ROWS = "SELECT fi.qid, fi.mid, pos, round(fi.score, 9) AS score, CASE WHEN mem.score >= CAST(0.8 AS DOUBLE) THEN 'direct' WHEN mem.score >= CAST(0.5 AS DOUBLE) THEN 'marked' ELSE 'reference' END AS tier, source FROM fi JOIN mem ON mem.mid = fi.mid"


@q("g08_full_router", f"{ROUTED(MERGE)} {ROUTE_ROWS}")
def g08f(s, d):
    return routed(s, d).results.withColumn("score", F.round("score", 9))


@q("g08_priority_router", f"{ROUTED(PRIO)} {ROUTE_ROWS}")
def g08p(s, d):
    return routed(s, d, tfidf=False).results.withColumn("score", F.round("score", 9))


@q("g08_route_stats", f"{ROUTED(MERGE)}, al AS (SELECT qid, 'tfidf' AS c FROM c1 UNION ALL SELECT qid, 'external' FROM c2 UNION ALL SELECT qid, 'keyword' FROM c3 UNION ALL SELECT qid, 'entity' FROM c4 UNION ALL SELECT qid, 'vector' FROM c5 UNION ALL SELECT qid, 'pending' FROM pn UNION ALL SELECT qid, 'merged' FROM mg UNION ALL SELECT fi.qid, 'final' FROM fi JOIN mem ON mem.mid = fi.mid) SELECT qid, " + ", ".join(f"count(*) FILTER (WHERE c = '{c}') AS {c}" for c in ("tfidf", "external", "keyword", "entity", "vector", "pending", "merged", "final")) + " FROM al GROUP BY qid")
def g08s(s, d):
    return routed(s, d).stats


@q("r03_search_view", f"{ROUTED(MERGE)}, rs AS ({ROUTE_ROWS}), tc2 AS (SELECT qid, count(*) FILTER (WHERE tier = 'direct') AS direct, count(*) FILTER (WHERE tier = 'marked') AS marked, count(*) FILTER (WHERE tier = 'reference') AS reference FROM rs GROUP BY qid) SELECT rs.qid, row_number() OVER (PARTITION BY rs.qid ORDER BY pos, rs.mid) AS place, rs.mid, '[' || upper(substring(mtype, 1, 1)) || '] ' || substring(content, 1, 50) || '...' AS line, rs.score, importance, direct, marked, reference FROM rs JOIN mem ON mem.mid = rs.mid JOIN tc2 ON tc2.qid = rs.qid QUALIFY place <= 10")
def r03(s, d):
    return search.search_view(routed(s, d).results, X.mem(s, d)).withColumn("score", F.round("score", 9))


# --- time ------------------------------------------------------------------------------------------------------------


@q("f25_j16_time_ranges", f"t AS (SELECT session_id AS qid, {AS} - 86400 * (3 + session_id % 20) AS f FROM mem GROUP BY session_id) SELECT qid, mid, created_s FROM t JOIN mem ON created_s >= f AND created_s < f + 86400")
def f25(s, d):
    text = F.concat((3 + C("session_id") % 20).cast("string"), LIT("d"))
    qs = X.mem(s, d).select(C("session_id").alias("qid"), text.alias("query")).distinct()
    words = {f"{n}d": n for n in range(22, 2, -1)}
    ranged = qs.select("qid", temporal.time_range(C("query"), LIT(AS), words).alias("r")).select("qid", "r.*")
    return temporal.in_range(ranged, X.mem(s, d))


@q("w09_validity", "SELECT vid, lead(ts_us) OVER (PARTITION BY entity, attribute ORDER BY ts_us, vid) AS valid_to FROM attr_version")
def w09(s, d):
    return temporal.validity(X.attr_version(s, d)).select("vid", "valid_to")


@q("j17_value_at", "t AS (SELECT DISTINCT entity, attribute, epoch_us(TIMESTAMP '2024-01-15') AS at_us FROM attr_version) SELECT t.entity AS tid, t.attribute, vid, value FROM t JOIN attr_version v ON v.entity = t.entity AND v.attribute = t.attribute AND ts_us <= at_us QUALIFY row_number() OVER (PARTITION BY t.entity, t.attribute ORDER BY ts_us DESC, vid DESC) = 1")
def j17(s, d):
    v = X.attr_version(s, d)
    t = v.select("entity", "attribute").distinct().withColumn("tid", C("entity")).withColumn("at_us", LIT(1705276800000000))
    return temporal.value_at(v, t).select("tid", "attribute", "vid", "value")


@q("j15_evidence", "SELECT m.mid, m.mid || coalesce(',' || o.mid, '') AS evidence, least(m.confidence, o.confidence) AS confidence FROM mem m LEFT JOIN mem o ON o.session_id = m.session_id AND o.source_turn = m.source_turn - 1")
def j15(s, d):
    m = X.mem(s, d)
    prev = m.select("session_id", (C("source_turn") + 1).alias("source_turn"), F.array("mid").alias("supersedes"))
    rows = m.join(prev, ["session_id", "source_turn"], "left")
    return temporal.evidence(rows).select("mid", csv("evidence_ids").alias("evidence"), "confidence")


@q("j15_evidence_chain", "SELECT a.mid, b.mid AS evidence, a.source_turn - b.source_turn AS hop FROM mem a JOIN mem b ON a.session_id = b.session_id AND b.source_turn < a.source_turn AND a.source_turn - b.source_turn <= 5 AND (SELECT count(*) FROM mem c WHERE c.session_id = a.session_id AND c.source_turn BETWEEN b.source_turn AND a.source_turn) = a.source_turn - b.source_turn + 1")
def j15c(s, d):
    m = X.mem(s, d)
    prev = m.select("session_id", (C("source_turn") + 1).alias("source_turn"), C("mid").alias("evidence"))
    return temporal.evidence_chain(hops=5, edges=m.join(prev, ["session_id", "source_turn"]).select("mid", "evidence"))


@q("j15_evidence_roots", "p AS (SELECT a.mid, b.mid AS prev, a.confidence FROM mem a LEFT JOIN mem b ON b.session_id = a.session_id AND b.source_turn = a.source_turn - 1), r AS (SELECT mid, mid AS root, 0 AS hops, confidence FROM p WHERE prev IS NULL UNION ALL SELECT p.mid, r.root, r.hops + 1, least(p.confidence, r.confidence) FROM p JOIN r ON r.mid = p.prev) SELECT mid, root, CAST(hops AS BIGINT) AS hops, round(confidence, 6) AS confidence, false AS cyclic FROM r")
def j15r(s, d):
    m = X.mem(s, d)
    prev = m.select("session_id", (C("source_turn") + 1).alias("source_turn"), C("mid").alias("supersedes_id"))
    rows = m.join(prev, ["session_id", "source_turn"], "left").select("mid", "supersedes_id", "confidence")
    return temporal.evidence_roots(rows).withColumn("confidence", F.round("confidence", 6))


@q("c05_state_at", f"SELECT mid FROM mem WHERE created_s <= {AS - 10 * 86400} AND (expires_s IS NULL OR expires_s > {AS - 10 * 86400})")
def c05(s, d):
    return temporal.state_at(X.mem(s, d), AS - 10 * 86400).select("mid")


@q("c05_difference", "SELECT mid, CASE WHEN mid % 5 = 0 THEN 'added' WHEN mid % 7 = 0 THEN 'removed' ELSE 'changed' END AS change FROM mem WHERE (mid % 5 = 0) <> (mid % 7 = 0) OR (mid % 5 <> 0 AND mid % 7 <> 0 AND mid % 11 = 0)")
def c05d(s, d):
    m = X.mem(s, d)
    new = m.where("mid % 7 <> 0").withColumn("content", F.when(C("mid") % 11 == 0, F.concat("content", LIT("!"))).otherwise(C("content")))
    return temporal.difference(m.where("mid % 5 <> 0"), new)


@q("c05_stored_difference", "SELECT mid, CASE WHEN mid % 5 = 0 THEN 'added' WHEN mid % 7 = 0 THEN 'removed' ELSE 'changed' END AS change FROM mem WHERE (mid % 5 = 0) <> (mid % 7 = 0) OR (mid % 5 <> 0 AND mid % 7 <> 0 AND mid % 11 = 0)")
def c05v(s, d):
    from ..sources import io, versions

    root, m = io.shared_path(s, "memories"), X.mem(s, d)
    first = versions.replace(m.where("mid % 5 <> 0"), root)
    versions.replace(m.where("mid % 7 <> 0").withColumn("content", F.when(C("mid") % 11 == 0, F.concat("content", LIT("!"))).otherwise(C("content"))), root)
    return temporal.difference(versions.read(s, root, first.number), versions.read(s, root))


@q("c05_invalidated", f"{EP} SELECT DISTINCT b AS mid FROM ep JOIN mem_new n ON n.mid = a JOIN mem_old o ON o.mid = b WHERE {CONTR}")
def c05i(s, d):
    return temporal.invalidated(X.mem_new(s, d), X.mem_old(s, d), X.entx(s, d), NEG)


# --- design notes ------------------------------------------------------------------------------------------------------


@q("d01_hard_ttl", f"SELECT mid FROM mem WHERE NOT (importance < CAST(0.3 AS DOUBLE) AND {AGE} > 7)")
def d01(s, d):
    return curate.hard_ttl(X.mem(s, d), AS).select("mid")


@q("d02_vote", f"v AS (SELECT session_id AS entity, mtype AS attribute, ownership AS value, round(sum(score * exp(CAST(-0.01 AS DOUBLE) * {AGE})), 6) AS votes FROM mem GROUP BY 1, 2, 3) SELECT entity, attribute, value, votes FROM v QUALIFY row_number() OVER (PARTITION BY entity, attribute ORDER BY votes DESC, value DESC) = 1")
def d02(s, d):
    return curate.vote(X.mem(s, d).select(C("session_id").alias("entity"), C("mtype").alias("attribute"), C("ownership").alias("value"), "score", "created_s"), AS)


@q("d03_merge_attributes", f"a AS (SELECT entity, mem.mid, content, created_s, CASE WHEN {has('content', ('with', 'from'))} THEN 'location' WHEN {has('content', ('thing',))} THEN 'job' END AS attribute FROM mem JOIN ent ON ent.mid = mem.mid) SELECT entity, attribute, mid, content, row_number() OVER (PARTITION BY entity, attribute ORDER BY created_s DESC, mid DESC) = 1 AS newest FROM a WHERE attribute IS NOT NULL")
def d03(s, d):
    return curate.merge_attributes(X.mem(s, d), {"location": ("with", "from"), "job": ("thing",)}, X.ent(s, d)).drop("created_s")


@q("d04_deny", "SELECT mid, round(CASE WHEN mid % 3 = 0 THEN confidence - CAST(0.3 AS DOUBLE) ELSE confidence END, 6) AS confidence FROM mem WHERE mtype = 'belief' AND CASE WHEN mid % 3 = 0 THEN confidence - CAST(0.3 AS DOUBLE) ELSE confidence END >= CAST(0.2 AS DOUBLE)")
def d04(s, d):
    b = X.mem(s, d).where("mtype = 'belief'")
    return curate.deny(b, b.where("mid % 3 = 0").select("mid", LIT("contradicted").alias("verdict"))).select("mid", F.round("confidence", 6).alias("confidence"))


@q("d05_accessed_bonus", f"SELECT mid, round(CASE WHEN mid IN (SELECT mid FROM access_log) THEN score + CAST(0.1 AS DOUBLE) ELSE score * (1 - {RATE} * (1 - importance * CAST(0.5 AS DOUBLE))) END, 6) AS score FROM mem")
def d05(s, d):
    return curate.accessed_bonus(X.mem(s, d), X.access_log(s, d)).select("mid", F.round("score", 6).alias("score"))


@q("d06_reactivate", f"SELECT mid, CASE WHEN {STATE} = 1 AND mid IN (SELECT mid FROM access_log) THEN 0 ELSE {STATE} END AS state, round(CASE WHEN {STATE} = 1 AND mid IN (SELECT mid FROM access_log) THEN CAST(0.3 AS DOUBLE) ELSE score END, 6) AS score FROM mem")
def d06(s, d):
    return curate.reactivate(stated(s, d), X.access_log(s, d)).select("mid", "state", F.round("score", 6).alias("score"))


@q("d07_timeline", "SELECT CAST(strftime(to_timestamp(created_s), '%Y-%m-%d') AS VARCHAR) AS period, mid FROM mem")
def d07(s, d):
    return index.timeline(X.mem(s, d), "day").select(C("period").cast("string").alias("period"), "mid")


@q("d08_slots", "SELECT mid, CASE WHEN regexp_matches(content, 'with ([a-z]+)') THEN 'with' WHEN regexp_matches(content, 'from ([a-z]+)') THEN 'from' END AS category, CASE WHEN regexp_matches(content, 'with ([a-z]+)') THEN regexp_extract(content, 'with ([a-z]+)', 1) WHEN regexp_matches(content, 'from ([a-z]+)') THEN regexp_extract(content, 'from ([a-z]+)', 1) END AS value FROM mem")
def d08(s, d):
    v = clean.slots(C("content"), {"with": "with ([a-z]+)", "from": "from ([a-z]+)"})
    return X.mem(s, d).select("mid", v.alias("v")).select("mid", "v.category", "v.value")


@q("d11_incremental_decay", f"SELECT mid, round(CASE WHEN mid % 4 = 0 OR {AGE} > 7 THEN score * (1 - {RATE} * (1 - importance * CAST(0.5 AS DOUBLE)) * CAST(CASE WHEN CAST(floor(({AS} - last_accessed_s) / 86400.0) AS BIGINT) <= 3 THEN 0.99 WHEN CAST(floor(({AS} - last_accessed_s) / 86400.0) AS BIGINT) <= 7 THEN 0.97 WHEN CAST(floor(({AS} - last_accessed_s) / 86400.0) AS BIGINT) <= 14 THEN 0.95 ELSE 1 END AS DOUBLE)) ELSE score END, 6) AS score FROM mem")
def d11(s, d):
    m = X.mem(s, d).withColumn("dirty", C("mid") % 4 == 0).withColumn("computed_s", C("created_s"))
    return curate.incremental_decay(m, AS).select("mid", F.round("score", 6).alias("score"))


@q("d12_recent", f"SELECT mid FROM mem WHERE mtype = 'fact' AND created_s > {AS} - 7 * 86400 AND created_s <= {AS}")
def d12(s, d):
    return report.recent(X.mem(s, d), AS, 7, "fact").select("mid")


@q("d13_rollup", "SELECT CAST(date_trunc('week', to_timestamp(created_s)) AS DATE) AS period, mtype, count(*) AS n, coalesce(array_to_string(list_slice(list(mid ORDER BY mid) FILTER (WHERE importance >= CAST(0.8 AS DOUBLE)), 1, 20), ','), '') AS important FROM mem GROUP BY 1, 2".replace("CAST(date_trunc('week', to_timestamp(created_s)) AS DATE) AS period", "CAST(CAST(date_trunc('week', to_timestamp(created_s)) AS DATE) AS VARCHAR) AS period"))
def d13(s, d):
    return report.rollup(X.mem(s, d)).withColumn("period", C("period").cast("string"))


@q("d14_stability", "SELECT event_id, coalesce(lag(event_id % 5 <> 0, 1) OVER w AND lag(event_id % 5 <> 0, 2) OVER w AND lag(event_id % 5 <> 0, 3) OVER w, false) AS skip FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def d14(s, d):
    e = X.table(s, d, "events").select("event_id", "user_id", "ts", F.when(C("event_id") % 5 != 0, "rule").otherwise("llm").alias("method"))
    return curate.stable_decisions(e, "user_id", ["ts", "event_id"]).select("event_id", "skip")


@q("u02_verdicts", "SELECT mid, CASE WHEN mid % 3 = 0 THEN 'llm' WHEN mid % 3 = 1 THEN 'rule_fallback' ELSE 'rule' END AS method, CASE WHEN mid % 3 = 0 THEN CAST(0.9 AS DOUBLE) ELSE importance END AS importance FROM mem")
def u02(s, d):
    m = X.mem(s, d)
    reply = F.when(C("mid") % 3 == 0, LIT('{"importance": 0.9, "category": "x"}')).otherwise(LIT('{"importance": null}'))
    return clean.with_verdicts(m.select("mid", "importance"), m.where("mid % 3 < 2").select("mid", reply.alias("reply"))).select("mid", "method", "importance")


__all__ = ["Q", "O"]
