"""Queries on rules and scores (F*, P*) with their SQL. Lexicons are small proxies: the default lists are Chinese and the given tables hold none."""

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from . import fixtures as X

Q, O = {}, {}
C, LIT = F.col, F.lit
AS = X.AS_OF
P_CLASSES = (("identity", 1.0, ("nicht", "worthless", "pour")), ("preference", 0.8, ("thing", "thou")), ("project", 0.7, ("with", "from")), ("temporary", 0.2, ("ththe", "haha")))
P_BOOSTS = ((0.5, ("the and",)), (0.3, ("ing of",)), (0.2, ("that",)))
P_REDUCE = (-0.2, ("the thnt", "of of"))


def has(col, words):
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def q(name, sql=None):
    def keep(fn):
        Q[name] = fn
        if sql:
            O[name] = X.sql(sql)
        return fn

    return keep


NOISE = "CASE WHEN regexp_matches(trim(content), '(?i)\\d+\\s*[\\+\\-\\*/]\\s*\\d+|weather|what time|search for|google|translate|set.*timer|remind me|^what is \\d+|^who is|^where is|^when is') THEN 'pattern' WHEN regexp_matches(trim(content), '(?i)^(hi|hello)|^(thanks|thank you)|^(bye|goodbye)|^(ok|okay)|^(yes)|^(no)') THEN 'conversation' WHEN regexp_matches(trim(content), '(?i)debug') THEN 'pattern' WHEN length(trim(content)) < 5 THEN 'length' WHEN importance < CAST(0.2 AS DOUBLE) THEN 'importance' END"


@q("f01_noise_reason", f"SELECT mid, {NOISE} AS noise_reason FROM mem")
def f01(s, d):
    return X.mem(s, d).select("mid", R.noise_reason(C("content"), C("importance")).alias("noise_reason"))


@q("f01_noise_documents", "SELECT noise_reason, count(*) AS n FROM (SELECT " + NOISE.replace("content", "text").replace("WHEN importance < CAST(0.2 AS DOUBLE) THEN 'importance' ", "") + " AS noise_reason FROM documents) GROUP BY 1")
def f01d(s, d):
    return X.table(s, d, "documents").select(R.noise_reason(C("text")).alias("noise_reason")).groupBy("noise_reason").agg(F.count(LIT(1)).alias("n"))


@q("f02_strict_features", f"n AS (SELECT mid, count(*) AS k FROM ent GROUP BY mid) SELECT mem.mid, coalesce({NOISE}, CASE WHEN coalesce(k, 0) = 0 AND importance < CAST(0.5 AS DOUBLE) THEN 'entity' END) AS noise_reason FROM mem LEFT JOIN n ON n.mid = mem.mid")
def f02(s, d):
    n = X.ent(s, d).groupBy("mid").agg(F.count(LIT(1)).alias("k"))
    return X.mem(s, d).join(n, "mid", "left").select("mid", R.noise_reason(C("content"), C("importance"), F.coalesce("k", LIT(0)), strict=True).alias("noise_reason"))


@q("f03_context_noise", f"SELECT mid, coalesce({NOISE}, CASE WHEN source_turn = 0 THEN 'conversation' WHEN session_id % 3 = 0 AND importance < CAST(0.3 AS DOUBLE) THEN 'conversation' END) AS noise_reason FROM mem")
def f03(s, d):
    m = X.mem(s, d)
    kind, state = F.when(C("source_turn") == 0, "greeting").otherwise("talk"), F.when(C("session_id") % 3 == 0, "idle").otherwise("open")
    return m.select("mid", R.noise_reason(C("content"), C("importance"), kind=kind, state=state).alias("noise_reason"))


@q("f04_keep_clean", f"SELECT mid, content FROM mem WHERE ({NOISE}) IS NULL")
def f04(s, d):
    return X.mem(s, d).where(R.noise_reason(C("content"), C("importance")).isNull()).select("mid", "content")


@q("f05_legacy_noise", r"SELECT doc_id, CASE WHEN regexp_full_match(t, '[oO]+[kK]+[~.!?]*|[yY]e+[sS]*[~.!?]*|[nN]o+[~.!?]*|[lL][oO]+[lL]+[~.!?]*') THEN 'pure_interjection' WHEN regexp_full_match(t, '(OK|ok)[~.!?]*|(thanks?|thx)[~.!?]*') THEN 'simple_ack' WHEN regexp_full_match(t, '[☀-⛿✀-➿\s~.!?]+|[.,!?~\s]+') THEN 'emoji_only' WHEN length(t) <= 2 AND NOT contains(t, chr(10)) THEN 'too_short' END AS category FROM (SELECT doc_id, trim(coalesce(text, '')) AS t FROM documents)")
def f05(s, d):
    return X.table(s, d, "documents").select("doc_id", R.legacy_noise(F.coalesce("text", LIT(""))).alias("category"))


IMP = "least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), CAST(CASE " + " ".join(f"WHEN {has('content', w)} OR {has('lower(content)', w)} THEN {v}" for _, v, w in P_CLASSES) + " ELSE 0.5 END AS DOUBLE) + CAST(CASE " + f"WHEN {has('content', P_REDUCE[1])} THEN -0.2 " + " ".join(f"WHEN {has('content', w)} THEN {v}" for v, w in P_BOOSTS) + " ELSE 0 END AS DOUBLE)))"
CLS = "CASE " + " ".join(f"WHEN {has('content', w)} OR {has('lower(content)', w)} THEN '{n}'" for n, _, w in P_CLASSES) + " ELSE 'general_fact' END"


def imp():
    return R.importance(C("content"), P_CLASSES, boosts=P_BOOSTS, reduce=P_REDUCE)


@q("p01_importance", f"SELECT mid, {CLS} AS category, round({IMP}, 6) AS importance FROM mem")
def p01(s, d):
    return X.mem(s, d).select("mid", R.importance_class(C("content"), P_CLASSES).alias("category"), F.round(imp(), 6).alias("importance"))


@q("f06_importance_filter", f"SELECT mid, round({IMP}, 6) AS importance, CASE WHEN {IMP} < CAST(0.3 AS DOUBLE) THEN 'external' ELSE 'rule' END AS method FROM mem WHERE ({NOISE.replace('importance <', 'CAST(0.5 AS DOUBLE) <')}) IS NULL AND {IMP} >= CAST(0.2 AS DOUBLE)")
def f06(s, d):
    from ..operators.clean import importance_filter

    return importance_filter(X.mem(s, d).drop("importance"), imp()).select("mid", F.round("importance", 6).alias("importance"), "method")


@q("f07_mini_filter", f"SELECT mid FROM mem WHERE ({NOISE.replace('importance <', 'CAST(0.5 AS DOUBLE) <')}) IS NULL AND ({has('content', ('worthless', 'nicht'))} OR importance >= CAST(0.5 AS DOUBLE))")
def f07(s, d):
    from ..operators.clean import mini_filter

    return mini_filter(X.mem(s, d).withColumn("urgent", T.any_of(C("content"), ("worthless", "nicht")))).select("mid")


@q("f08_urgency", f"SELECT mid, CASE WHEN {has('content', ('worthless',))} THEN 'critical' WHEN {has('content', ('nicht', 'pour'))} THEN 'important' WHEN regexp_matches(content, '(the|of).*(must|thnt)') THEN 'time_sensitive' ELSE '' END AS category, CAST(CASE WHEN {has('content', ('worthless',))} THEN 0.9 WHEN {has('content', ('nicht', 'pour'))} OR regexp_matches(content, '(the|of).*(must|thnt)') THEN 0.8 ELSE 0.5 END AS DOUBLE) AS importance FROM mem")
def f08(s, d):
    return X.mem(s, d).select("mid", R.urgency(C("content"), ("worthless",), ("nicht", "pour"), ("(the|of).*(must|thnt)",)).alias("u")).select("mid", "u.category", "u.importance")


TTL = ("worthless|pour", "(the|of).*(thnt)", "(nicht|with).*(ing)")


@q("f09_ttl_patterns", f"SELECT mid, CASE WHEN regexp_matches(content, '{TTL[0]}') THEN 0 WHEN regexp_matches(content, '{TTL[1]}') THEN 12 WHEN regexp_matches(content, '{TTL[2]}') THEN 48 END AS hours FROM mem")
def f09(s, d):
    return X.mem(s, d).select("mid", R.ttl_hours(C("content"), *((x,) for x in TTL)).alias("hours"))


SENSOR = ((12, ("worthless",)), (48, ("nicht", "pour")), (240, ("thing",)), (840, ("with", "from")))
SENSED = "CASE " + " ".join(f"WHEN {has('content', w)} THEN {h}" for h, w in SENSOR) + " END"


@q("f10_time_sensor", f"SELECT mid, CASE WHEN importance BETWEEN CAST(0.35 AS DOUBLE) AND CAST(0.7 AS DOUBLE) THEN {AS} + 3600 * {SENSED} END AS expires_s FROM mem")
def f10(s, d):
    never = ("^$^",)
    return X.mem(s, d).select("mid", R.expiry(C("content"), C("importance"), LIT(AS), permanent=never, immediate=never, short=never, sensor=SENSOR).alias("expires_s"))


@q("f11_tier3_ttl", f"SELECT mid, CAST({AS} + 3 * 86400 AS BIGINT) AS expires_s FROM mem WHERE expires_s IS NULL AND NOT {has('content', ('haha', 'nicht'))} AND mid IN (SELECT mid FROM ent WHERE entity IN (SELECT entity FROM ent GROUP BY entity HAVING count(*) >= 5))")
def f11(s, d):
    from ..operators.entities import tier3_expiry

    e = X.ent(s, d)
    return tier3_expiry(X.mem(s, d), e, e.groupBy("entity").count().where("count >= 5"), AS, verbs=("haha", "nicht"))


@q("f12_expiry_split", f"SELECT mid, coalesce(expires_s <= {AS}, false) AS expired FROM mem")
def f12(s, d):
    from ..operators.curate import split_expired

    expired, valid = split_expired(X.mem(s, d), AS)
    return expired.select("mid", LIT(True).alias("expired")).unionByName(valid.select("mid", LIT(False).alias("expired")))


@q("f13_ttl_cleanup", f"SELECT mid, CASE WHEN expires_s < {AS} THEN 2 ELSE 0 END AS state FROM mem")
def f13(s, d):
    from ..operators.curate import ttl_cleanup

    return ttl_cleanup(X.mem(s, d).withColumn("state", LIT(0)), AS).select("mid", "state")


@q("f14_active_scan", "SELECT mid, mtype, score FROM mem WHERE mtype = 'fact' AND mid % 3 <> 0")
def f14(s, d):
    from ..operators.report import active

    return active(X.mem(s, d).withColumn("state", F.when(C("mid") % 3 == 0, 1).otherwise(0)).withColumn("final_score", C("score")), "fact").select("mid", "mtype", "score")


@q("f15_point_lookup", "ids AS (SELECT DISTINCT mid FROM access_log) SELECT mem.mid, content, coalesce((SELECT string_agg(entity, ',' ORDER BY entity) FROM ent WHERE ent.mid = mem.mid), '') AS entities FROM mem WHERE mid IN (SELECT mid FROM ids)")
def f15(s, d):
    from ..operators.entities import hydrate

    found = X.mem(s, d).join(X.access_log(s, d).select("mid").distinct(), "mid", "left_semi")
    return hydrate(found, X.ent(s, d)).select("mid", "content", F.array_join("entities", ",").alias("entities"))


@q("f16_stale_scan", f"SELECT mid, CAST(floor(({AS} - coalesce(last_accessed_s, created_s)) / 86400.0) AS BIGINT) > 10 AS stale, CASE WHEN CAST(floor(({AS} - coalesce(last_accessed_s, created_s)) / 86400.0) AS BIGINT) > 10 THEN CAST(floor(({AS} - coalesce(last_accessed_s, created_s)) / 86400.0) AS BIGINT) END AS stale_days, CASE WHEN CAST(floor(({AS} - coalesce(last_accessed_s, created_s)) / 86400.0) AS BIGINT) > 10 THEN last_accessed_s ELSE {AS} END AS last_verified_s FROM mem")
def f16(s, d):
    from ..operators.curate import stale_scan

    return stale_scan(X.mem(s, d).withColumn("last_verified_s", C("last_accessed_s")), AS, 10).select("mid", "stale", "stale_days", "last_verified_s")


TRIG = (("layer0_explicit", 0, ("worthless",)), ("layer0_time", 0, ("haha",)), ("layer1_preference", 1, ("thing",)), ("layer1_identity", 1, ("thou",)), ("layer1_relation", 1, ("with", "from")), ("layer1_project", 1, ("of",)))
LAYER = "CASE " + " ".join(f"WHEN {has('lower(query)', w)} THEN {n}" for _, n, w in TRIG) + " ELSE 2 END"


@q("f17_trigger_layer", f"SELECT qid, {LAYER} AS layer, CASE " + " ".join(f"WHEN {has('lower(query)', w)} THEN '{n}'" for n, _, w in TRIG) + " ELSE 'default' END AS trigger, CASE " + " ".join(f"WHEN {has('lower(query)', w)} THEN array_to_string(list_filter({list(w)}, lambda k: contains(lower(query), k)), ',')" for _, _, w in TRIG) + " ELSE '' END AS matched FROM qry")
def f17(s, d):
    return X.qry(s, d).select("qid", R.trigger(C("query"), TRIG).alias("t")).select("qid", "t.layer", "t.trigger", F.array_join("t.matched", ",").alias("matched"))


@q("f18_query_class", f"k AS (SELECT qid, CASE WHEN {has('lower(query)', ('eron',))} OR {LAYER} = 0 THEN 'precise' WHEN {has('lower(query)', ('and',))} THEN 'broad' ELSE 'topic' END AS class FROM qry) SELECT qid, class, CASE class WHEN 'precise' THEN 15 WHEN 'topic' THEN 25 ELSE 35 END AS initial, CASE class WHEN 'precise' THEN 10 WHEN 'topic' THEN 16 ELSE 25 END AS rerank, CASE class WHEN 'precise' THEN 8 WHEN 'topic' THEN 13 ELSE 18 END AS final FROM k")
def f18(s, d):
    c = X.qry(s, d).withColumn("class", R.query_class(C("query"), R.trigger(C("query"), TRIG)["layer"], ("eron",), ("and",)))
    return c.select("qid", "class", *(R.size_of(C("class"), i).alias(n) for i, n in enumerate(("initial", "rerank", "final"))))


@q("f19_override_tier", f"SELECT mid, CASE WHEN {has('content', ('worthless', 'thing'))} THEN 1 WHEN {has('content', ('with',))} THEN 2 END AS override_tier FROM mem")
def f19(s, d):
    return X.mem(s, d).select("mid", R.override_tier(C("content"), ("worthless", "thing"), ("with",)).alias("override_tier"))


CW = {"relation": ("thing", "with", "from"), "negation": ("nicht", "worthless"), "metaphor": ("thou",), "temporal": ("that", "this")}
COUNT = lambda w: "len(list_filter(" + str(list(w)) + ", lambda k: contains(content, k)))"
NAMES = r"len(list_distinct(regexp_extract_all(content, '[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?')))"
CPLX = f"CASE WHEN length(content) < 10 THEN CAST(0 AS DOUBLE) ELSE least(CAST(1 AS DOUBLE), CASE WHEN {COUNT(CW['relation'])} >= 1 THEN CAST(0.2 AS DOUBLE) + ({COUNT(CW['relation'])} - 1) * CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CASE WHEN {COUNT(CW['negation'])} >= 1 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CASE WHEN {COUNT(CW['metaphor'])} >= 1 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CASE WHEN {COUNT(CW['temporal'])} >= 2 THEN CAST(0.15 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CASE WHEN {NAMES} >= 3 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CASE WHEN contains(content, '?') THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) END"


@q("p09_complexity", f"SELECT mid, round({CPLX}, 6) AS complexity, {CPLX} >= CAST(0.4 AS DOUBLE) AS is_complex FROM mem")
def p09(s, d):
    c = R.complexity(C("content"), **CW)
    return X.mem(s, d).select("mid", F.round(c, 6).alias("complexity"), (c >= 0.4).alias("is_complex"))


@q("f20_escalation", f"SELECT mid, CASE WHEN importance >= CAST(0.5 AS DOUBLE) AND c >= CAST(0.4 AS DOUBLE) THEN 'high_confidence_but_complex' WHEN importance >= CAST(0.5 AS DOUBLE) THEN 'high_confidence_simple' WHEN importance < CAST(0.2 AS DOUBLE) AND c >= CAST(0.3 AS DOUBLE) THEN 'low_confidence_but_complex' WHEN importance < CAST(0.2 AS DOUBLE) THEN 'low_confidence_simple' ELSE 'uncertain_range' END AS reason FROM (SELECT mid, importance, {CPLX} AS c FROM mem)")
def f20(s, d):
    return X.mem(s, d).select("mid", R.escalation(C("content"), C("importance"), **CW)["reason"].alias("reason"))


@q("p02_memory_type", f"SELECT mid, CASE WHEN {has('lower(content)', ('thing', 'with'))} THEN 'belief' WHEN {has('lower(content)', ('that',))} THEN 'summary' ELSE 'fact' END AS mtype2 FROM mem")
def p02(s, d):
    return X.mem(s, d).select("mid", R.memory_type(C("content"), ("thing", "with"), ("that",)).alias("mtype2"))


@q("p03_records", f"SELECT mid, substring(mtype, 1, 1) || '_' || strftime(to_timestamp(created_s), '%Y%m%d') || '_' || substring(md5(content), 1, 16) AS id, mtype, round(importance, 6) AS importance, ({CLS}) = 'identity' AS is_identity, CASE WHEN mtype = 'belief' THEN CAST(0.6 AS DOUBLE) END AS confidence, CASE WHEN mtype = 'belief' THEN substring(content, 1, 50) END AS basis FROM mem")
def p03(s, d):
    from ..operators.clean import records

    out = records(X.mem(s, d), R.importance_class(C("content"), P_CLASSES) == "identity")
    return out.select("mid", "id", "mtype", F.round("importance", 6).alias("importance"), "is_identity", "confidence", "basis")


@q("p04_ids", "SELECT mid, 'p_' || strftime(to_timestamp(created_s), '%Y%m%d') || '_' || substring(md5(content), 1, 6) AS short_id, substring(md5(content), 1, 12) AS cache_key FROM mem")
def p04(s, d):
    return X.mem(s, d).select("mid", T.record_id(LIT("p"), C("content"), C("created_s"), 6).alias("short_id"), F.substring(F.md5("content"), 1, 12).alias("cache_key"))


@q("p05_mixed_tokens", "SELECT mid, array_to_string(list_sort(list_distinct(regexp_extract_all(content, '[a-zA-Z]+'))), ' ') AS tokens FROM mem")
def p05(s, d):
    return X.mem(s, d).select("mid", F.array_join(F.array_sort(T.mixed_tokens(C("content"))), " ").alias("tokens"))


WORDS = r"list_distinct(list_filter(regexp_split_to_array(trim(lower(regexp_replace({0}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')), ' ' || chr(9) || chr(10) || chr(13)), '\s+'), lambda w: length(w) > 1 AND w NOT IN ('the', 'a', 'an', 'is', 'are', 'was', 'were')))"


@q("p06_word_tokens", "SELECT mid, array_to_string(list_sort(" + WORDS.format("content") + "), ' ') AS tokens FROM mem")
def p06(s, d):
    return X.mem(s, d).select("mid", F.array_join(F.array_sort(T.word_tokens(C("content"))), " ").alias("tokens"))


KEYS = "list_distinct(list_concat(list_transform(regexp_extract_all({0}, '[a-zA-Z0-9][-a-zA-Z0-9.]+'), lambda x: lower(x)), list_transform(regexp_extract_all({0}, '[a-zA-Z]{{2,}}'), lambda x: lower(x))))"


@q("p07_index_keywords", "SELECT mid, array_to_string(list_sort(" + KEYS.format("content") + "), ' ') AS keywords FROM mem")
def p07(s, d):
    return X.mem(s, d).select("mid", F.array_join(F.array_sort(T.index_keywords(C("content"))), " ").alias("keywords"))


SHINGLES = "(SELECT qid, query AS term FROM qry WHERE length(query) >= 2 UNION SELECT qid, substring(query, i, k) FROM (SELECT qid, query, unnest(range(1, length(query) + 1)) AS i FROM qry WHERE length(query) >= 2), (SELECT unnest([2, 3, 4]) AS k) WHERE i + k - 1 <= length(query))"


@q("p08_query_shingles", f"SELECT qid, term FROM {SHINGLES}")
def p08(s, d):
    return X.qry(s, d).select("qid", F.explode(T.query_shingles(C("query"))).alias("term"))


PAIRS = "p AS (SELECT a.mid AS a, b.mid AS b, a.content AS x, b.content AS y FROM mem a JOIN mem b ON a.session_id = b.session_id AND b.source_turn = a.source_turn + 1)"


def pairs(s, d):
    m = X.mem(s, d).select("session_id", "source_turn", "mid", "content")
    n = m.select("session_id", (C("source_turn") - 1).alias("source_turn"), C("mid").alias("b"), C("content").alias("y"))
    return m.join(n, ["session_id", "source_turn"]).withColumnsRenamed({"mid": "a", "content": "x"})


@q("p10_jaccard", f"{PAIRS}, t AS (SELECT a, b, {WORDS.format('x')} AS u, {WORDS.format('y')} AS v FROM p) SELECT a, b, round(CASE WHEN len(u) = 0 OR len(v) = 0 THEN 0 ELSE len(list_intersect(u, v)) / CAST(len(list_distinct(list_concat(u, v))) AS DOUBLE) END, 6) AS similarity FROM t")
def p10(s, d):
    return pairs(s, d).select("a", "b", F.round(T.jaccard(T.word_tokens(C("x")), T.word_tokens(C("y"))), 6).alias("similarity"))


@q("p11_overlap", f"{PAIRS}, t AS (SELECT a, b, x, y, list_distinct(regexp_extract_all(x, '[a-zA-Z]+')) AS u, list_distinct(regexp_extract_all(y, '[a-zA-Z]+')) AS v FROM p) SELECT a, b, round(len(list_intersect(u, v)) / CAST(greatest(least(len(u), len(v)), 1) AS DOUBLE), 6) AS overlap, contains(x, y) OR contains(y, x) AS contained FROM t")
def p11(s, d):
    return pairs(s, d).select("a", "b", F.round(T.overlap_coefficient(T.mixed_tokens(C("x")), T.mixed_tokens(C("y"))), 6).alias("overlap"), (F.contains("x", C("y")) | F.contains("y", C("x"))).alias("contained"))


SIM = "CASE WHEN {0} = {1} THEN CAST(1 AS DOUBLE) WHEN pl / CAST(mx AS DOUBLE) >= 0.5 THEN pl / CAST(mx AS DOUBLE) WHEN contains({0}, {1}) OR contains({1}, {0}) THEN mn / CAST(mx AS DOUBLE) ELSE greatest(CAST(0 AS DOUBLE), 1 - levenshtein({0}, {1}) / CAST(mx AS DOUBLE)) END"
SIMSET = "e2 AS (SELECT DISTINCT entity FROM ent), sp AS (SELECT a.entity AS q, b.entity AS e, list_max(list_filter(range(0, least(length(a.entity), length(b.entity)) + 1), lambda i: left(a.entity, CAST(i AS INT)) = left(b.entity, CAST(i AS INT)))) AS pl, greatest(length(a.entity), length(b.entity)) AS mx, least(length(a.entity), length(b.entity)) AS mn FROM e2 a JOIN e2 b ON a.entity <> b.entity), sim AS (SELECT q, e, " + SIM.format("q", "e") + " AS similarity FROM sp)"


@q("p12_entity_similarity", f"{PAIRS}, w AS (SELECT a, b, regexp_extract(x, '[a-zA-Z]+') AS q, regexp_extract(y, '[a-zA-Z]+') AS e FROM p), z AS (SELECT *, list_max(list_filter(range(0, least(length(q), length(e)) + 1), lambda i: left(q, CAST(i AS INT)) = left(e, CAST(i AS INT)))) AS pl, greatest(length(q), length(e)) AS mx, least(length(q), length(e)) AS mn FROM w WHERE length(q) > 0 AND length(e) > 0) SELECT a, b, round({SIM.format('q', 'e')}, 6) AS similarity FROM z")
def p12(s, d):
    w = pairs(s, d).select("a", "b", F.regexp_extract("x", "[a-zA-Z]+", 0).alias("q"), F.regexp_extract("y", "[a-zA-Z]+", 0).alias("e")).where("length(q) > 0 AND length(e) > 0")
    return w.select("a", "b", F.round(T.entity_similarity(C("q"), C("e")), 6).alias("similarity"))


@q("p13_suffix_type", r"SELECT entity, CASE WHEN t = '' THEN 'empty' WHEN regexp_full_match(t, '\d+') THEN 'digit' WHEN regexp_full_match(t, '[A-Z]') THEN 'single_upper' WHEN regexp_full_match(t, '[A-Z]{2,3}') THEN 'multi_upper' WHEN regexp_full_match(t, '[a-z]+') THEN 'lower' ELSE 'mixed' END AS kind FROM (SELECT DISTINCT entity, substring(entity, 3) AS t FROM ent)")
def p13(s, d):
    return X.ent(s, d).select("entity").distinct().select("entity", T.suffix_type(F.expr("substring(entity, 3)")).alias("kind"))


DAYS = f"CAST(floor(({AS} - last_accessed_s) / 86400.0) AS BIGINT)"


@q("p14_floor_days", f"SELECT mid, {DAYS} AS days FROM mem")
def p14(s, d):
    return X.mem(s, d).select("mid", T.floor_days(LIT(AS), C("last_accessed_s")).alias("days"))


CNT = "CAST(retrieval_count + 2 * used_in_response_count + 3 * user_mentioned_count AS DOUBLE)"
EFF = f"CASE WHEN greatest(0, {DAYS}) <= 7 THEN {CNT} * (1 - greatest(0, {DAYS}) / CAST(7 AS DOUBLE) * CAST(0.5 AS DOUBLE)) * CASE WHEN greatest(0, {DAYS}) <= 3 THEN CAST(1.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END ELSE {CNT} * pow(CAST(0.9 AS DOUBLE), {DAYS} - 7) * CAST(0.1 AS DOUBLE) END"
BOOST = f"CASE WHEN {CNT} <= 0 OR last_accessed_s IS NULL THEN CAST(0 AS DOUBLE) ELSE least(CAST(0.5 AS DOUBLE), ln({EFF} + 1) * ({EFF} / 7) * CAST(0.2 AS DOUBLE)) END"


def count_col():
    return R.weighted_count(C("retrieval_count"), C("used_in_response_count"), C("user_mentioned_count"))


def boost_col():
    return R.access_boost(count_col(), C("last_accessed_s"), LIT(AS))


@q("p15_weighted_count", f"SELECT mid, {CNT} AS weighted FROM mem")
def p15(s, d):
    return X.mem(s, d).select("mid", count_col().alias("weighted"))


@q("p16_access_boost", f"SELECT mid, round({BOOST}, 6) AS boost FROM mem")
def p16(s, d):
    return X.mem(s, d).select("mid", F.round(boost_col(), 6).alias("boost"))


@q("p17_access_update", f"SELECT mid, retrieval_count + coalesce(r, 0) AS retrieval_count, used_in_response_count + coalesce(u, 0) AS used_in_response_count, user_mentioned_count + coalesce(m, 0) AS user_mentioned_count, greatest(last_accessed_s, t) AS last_accessed_s FROM mem LEFT JOIN (SELECT mid AS lm, count(*) FILTER (WHERE access_type = 'retrieval') AS r, count(*) FILTER (WHERE access_type = 'used_in_response') AS u, count(*) FILTER (WHERE access_type = 'user_mentioned') AS m, CAST(floor(max(ts_us) / 1000000.0) AS BIGINT) AS t FROM access_log GROUP BY mid) ON lm = mid")
def p17(s, d):
    from ..operators.curate import apply_access

    return apply_access(X.mem(s, d), X.access_log(s, d)).select("mid", "retrieval_count", "used_in_response_count", "user_mentioned_count", "last_accessed_s")


@q("p18_rank_score", f"SELECT mid, round(importance * confidence * (1 + {BOOST}), 6) AS final_score FROM mem")
def p18(s, d):
    return X.mem(s, d).select("mid", F.round(R.rank_score(C("importance"), C("confidence"), boost_col()), 6).alias("final_score"))


RATE = "CAST(CASE mtype WHEN 'fact' THEN 0.008 WHEN 'belief' THEN 0.07 ELSE 0.025 END AS DOUBLE)"
KEEP = f"CAST(CASE WHEN {DAYS} <= 3 THEN 0.99 WHEN {DAYS} <= 7 THEN 0.97 WHEN {DAYS} <= 14 THEN 0.95 ELSE 1 END AS DOUBLE)"


@q("p19_protected_decay", f"SELECT mid, round(score * (1 - {RATE} * (1 - importance * CAST(0.5 AS DOUBLE)) * {KEEP}), 6) AS new_score FROM mem")
def p19(s, d):
    return X.mem(s, d).select("mid", F.round(R.protected_decay(C("score"), C("importance"), C("mtype"), C("last_accessed_s"), LIT(AS)), 6).alias("new_score"))


@q("p20_plain_decay", f"SELECT mid, round(score * (1 - {RATE} * (1 - importance * CAST(0.5 AS DOUBLE))), 6) AS new_score FROM mem")
def p20(s, d):
    return X.mem(s, d).select("mid", F.round(R.plain_decay(C("score"), C("importance"), C("mtype")), 6).alias("new_score"))


AGE = f"CAST(floor(({AS} - created_s) / 86400.0) AS BIGINT)"
DYN = f"score * pow(pow(CAST(CASE mtype WHEN 'fact' THEN 0.992 WHEN 'belief' THEN 0.93 ELSE 0.975 END AS DOUBLE), 1 - importance * CAST(0.5 AS DOUBLE)), {AGE}) + {BOOST}"


@q("p21_dynamic_score", f"SELECT mid, round({DYN}, 6) AS dynamic_score FROM mem")
def p21(s, d):
    return X.mem(s, d).select("mid", F.round(R.dynamic_score(C("score"), C("importance"), C("mtype"), C("created_s"), boost_col(), LIT(AS)), 6).alias("dynamic_score"))


@q("p22_time_decay", f"SELECT mid, round(score * exp(CAST(-0.01 AS DOUBLE) * {AGE}), 6) AS decayed FROM mem")
def p22(s, d):
    return X.mem(s, d).select("mid", F.round(R.time_decay(C("score"), T.floor_days(LIT(AS), C("created_s"))), 6).alias("decayed"))


@q("p23_final_score", f"SELECT mid, round(score + {BOOST}, 6) AS final_score FROM mem")
def p23(s, d):
    return X.mem(s, d).select("mid", F.round(C("score") + boost_col(), 6).alias("final_score"))


RER = f"CAST(0.35 AS DOUBLE) * exp(CAST(-0.1 AS DOUBLE) * coalesce(greatest(0, {DAYS}), 30)) + CAST(0.35 AS DOUBLE) * importance + CAST(0.3 AS DOUBLE) * (CAST(0.5 AS DOUBLE) * {{0}} + CAST(0.5 AS DOUBLE) * score)"


@q("p24_rerank_score", f"SELECT mid, round({RER.format('retrieval_count')}, 9) AS rerank FROM mem")
def p24(s, d):
    return X.mem(s, d).select("mid", F.round(R.rerank_score(C("retrieval_count"), C("score"), C("importance"), C("last_accessed_s"), LIT(AS)), 9).alias("rerank"))


CP = "p AS (SELECT n.mid AS a, o.mid AS b, n.created_s AS ns, o.created_s AS os, n.confidence AS nc, o.confidence AS oc, n.ownership AS nw, o.ownership AS ow FROM mem n JOIN mem o ON n.session_id = o.session_id AND o.source_turn = n.source_turn + 1), c AS (SELECT a, b, CAST(CASE WHEN floor((ns - os) / 86400.0) > 7 THEN 1 WHEN floor((ns - os) / 86400.0) > 0 THEN 0.5 WHEN floor((ns - os) / 86400.0) < -7 THEN -1 ELSE 0 END AS DOUBLE) AS t, CAST(CASE WHEN nc - oc > CAST(0.3 AS DOUBLE) THEN 1 WHEN nc - oc > CAST(0.1 AS DOUBLE) THEN 0.5 WHEN nc - oc < CAST(-0.3 AS DOUBLE) THEN -1 WHEN nc - oc < CAST(-0.1 AS DOUBLE) THEN -0.5 ELSE 0 END AS DOUBLE) AS f, CAST(sign(CASE nw WHEN 'user' THEN 3 WHEN 'third_party' THEN 1 ELSE 2 END - CASE ow WHEN 'user' THEN 3 WHEN 'third_party' THEN 1 ELSE 2 END) AS DOUBLE) AS o FROM p), sc AS (SELECT *, t * CAST(0.5 AS DOUBLE) + f * CAST(0.3 AS DOUBLE) + o * CAST(0.2 AS DOUBLE) AS conflict FROM c)"


def conflict_pairs(s, d):
    keep = ["mid", "created_s", "confidence", "ownership"]
    m = X.mem(s, d)
    o = m.select("session_id", (C("source_turn") - 1).alias("source_turn"), *(C(k).alias(f"o_{k}") for k in keep))
    p = m.select("session_id", "source_turn", *keep).join(o, ["session_id", "source_turn"])
    return p, (C("created_s"), C("o_created_s"), C("confidence"), C("o_confidence"), C("ownership"), C("o_ownership"))


@q("p25_conflict_score", f"{CP} SELECT a, b, round(conflict, 6) AS conflict, CASE WHEN conflict > CAST(0.3 AS DOUBLE) THEN 'UPDATE' WHEN conflict < CAST(-0.3 AS DOUBLE) THEN 'KEEP' ELSE 'MERGE' END AS action FROM sc")
def p25(s, d):
    p, cols = conflict_pairs(s, d)
    v = R.conflict_score(*cols)
    return p.select(C("mid").alias("a"), C("o_mid").alias("b"), F.round(v, 6).alias("conflict"), R.conflict_action(v).alias("action"))


@q("p26_conflict_reason", f"{CP} SELECT a, b, coalesce(nullif(concat_ws('、', CASE WHEN t > 0 THEN '新记忆更新' WHEN t < 0 THEN '旧记忆更新' END, CASE WHEN f > 0 THEN '新记忆置信度更高' WHEN f < 0 THEN '旧记忆置信度更高' END, CASE WHEN o > 0 THEN '新记忆来源更可靠' WHEN o < 0 THEN '旧记忆来源更可靠' END), ''), '不确定，保留两条记忆') AS reason FROM sc")
def p26(s, d):
    p, cols = conflict_pairs(s, d)
    return p.select(C("mid").alias("a"), C("o_mid").alias("b"), R.conflict_reason(*cols).alias("reason"))


@q("p27_injection_tier", "SELECT mid, CASE WHEN score >= CAST(0.8 AS DOUBLE) THEN 'direct' WHEN score >= CAST(0.5 AS DOUBLE) THEN 'marked' ELSE 'reference' END AS tier, CASE WHEN score < CAST(0.5 AS DOUBLE) THEN substring(content, 1, 50) || '...' END AS preview FROM mem")
def p27(s, d):
    t = R.injection_tier(C("score"))
    return X.mem(s, d).select("mid", t.alias("tier"), F.when(t == "reference", F.concat(F.substring("content", 1, 50), LIT("..."))).alias("preview"))


@q("p29_id_in_text", r"SELECT mid, regexp_extract('hit [f_' || strftime(to_timestamp(created_s), '%Y%m%d') || '_' || substring(md5(content), 1, 6) || '] ' || content, '\[([fbs]_\d{8}_[a-f0-9]+)\]', 1) AS found FROM mem")
def p29(s, d):
    text = F.concat(LIT("hit ["), T.record_id(LIT("f"), C("content"), C("created_s"), 6), LIT("] "), C("content"))
    return X.mem(s, d).select("mid", T.id_in_text(text).alias("found"))


@q("p30_capture", "SELECT conv_id, turn, trim(text) AS content, least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), CAST(turn AS DOUBLE) / 4)) AS importance, array_to_string(list_filter(list_transform(string_split(role || ', ' || 'x', ','), lambda e: trim(e)), lambda e: e <> ''), '|') AS entities FROM conversations WHERE trim(coalesce(text, '')) <> ''")
def p30(s, d):
    from ..operators.clean import capture

    c = X.table(s, d, "conversations").select("conv_id", "turn", C("text").alias("content"), (C("turn") / 4).alias("importance"), F.concat("role", LIT(", x")).alias("entities"))
    return capture(c).withColumn("entities", F.array_join("entities", "|"))


@q("p31_belief_overlap", f"{PAIRS}, t AS (SELECT a, b, x, y, list_distinct(list_filter(regexp_split_to_array(lower(x), '\\s+'), lambda w: w <> '')) AS u, list_distinct(list_filter(regexp_split_to_array(lower(y), '\\s+'), lambda w: w <> '')) AS v FROM p) SELECT a, b, round(len(list_intersect(u, v)) / CAST(greatest(len(u), 1) AS DOUBLE), 6) AS overlap, {has('lower(x)', ('not', 'nicht'))} AS negated FROM t")
def p31(s, d):
    u, v = T.whitespace_words(C("x")), T.whitespace_words(C("y"))
    return pairs(s, d).select("a", "b", F.round(F.size(F.array_intersect(u, v)) / F.greatest(F.size(u), LIT(1)), 6).alias("overlap"), T.any_of(F.lower("x"), ("not", "nicht")).alias("negated"))


@q("p32_importance_band", "SELECT mid, CASE WHEN importance >= CAST(0.9 AS DOUBLE) THEN 'critical' WHEN importance >= CAST(0.7 AS DOUBLE) THEN 'high' WHEN importance >= CAST(0.4 AS DOUBLE) THEN 'medium' ELSE 'low' END AS band FROM mem")
def p32(s, d):
    return X.mem(s, d).select("mid", R.importance_band(C("importance")).alias("band"))


@q("p33_health_status", f"SELECT mid, CASE WHEN mid % 7 = 0 THEN 'conflict' WHEN {AGE} > 20 THEN 'stale' ELSE 'active' END AS status FROM mem")
def p33(s, d):
    return X.mem(s, d).select("mid", R.health_status(C("mid") % 7 == 0, T.floor_days(LIT(AS), C("created_s")) > 20).alias("status"))


@q("p34_flatten_message", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS content FROM conversations WHERE role = 'user' GROUP BY conv_id")
def p34(s, d):
    from ..sources.io import message_text

    parts = X.table(s, d, "conversations").withColumn("part", F.struct(F.when(C("role") == "user", "text").otherwise("other").alias("type"), "text"))
    whole = parts.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]).alias("content"))
    return whole.select("conv_id", message_text(C("content")).alias("content")).where("content <> ''")


@q("p35_lineage", f"{CP} SELECT a, CAST(a AS VARCHAR) || ',' || CAST(b AS VARCHAR) AS supersedes FROM p")
def p35(s, d):
    from ..operators.curate import inherit_lineage

    p, _ = conflict_pairs(s, d)
    old = F.to_json(F.array(C("mid").cast("string")))
    return p.select(C("mid").alias("a"), F.array_join(inherit_lineage(old, C("o_mid").cast("string")), ",").alias("supersedes"))


@q("f21_contradictory", f"SELECT n.mid AS a, o.mid AS b FROM mem n JOIN mem o ON n.session_id = o.session_id AND o.source_turn = n.source_turn + 1 WHERE {has('lower(n.content)', ('worthless', 'nicht'))} OR (n.created_s > o.created_s AND floor((n.created_s - o.created_s) / 86400.0) > 7)")
def f21(s, d):
    m = X.mem(s, d)
    o = m.select("session_id", (C("source_turn") - 1).alias("source_turn"), C("mid").alias("b"), C("created_s").alias("os"))
    p = m.join(o, ["session_id", "source_turn"])
    return p.where(R.contradictory(C("content"), C("created_s"), C("os"), ("worthless", "nicht"))).select(C("mid").alias("a"), "b")


@q("f22_archive_split", f"SELECT mid, ({DYN}) < CAST(0.05 AS DOUBLE) AS archived FROM mem")
def f22(s, d):
    from ..operators.curate import split_archive

    m = X.mem(s, d).withColumn("score", R.dynamic_score(C("score"), C("importance"), C("mtype"), C("created_s"), boost_col(), LIT(AS)))
    keep, gone = split_archive(m)
    return keep.select("mid", LIT(False).alias("archived")).unionByName(gone.select("mid", LIT(True).alias("archived")))


