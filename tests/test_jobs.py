"""Curation, retrieval and reports on small made cases, against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import rules as R
from mnemospark.functions import text as T
from mnemospark.operators import blocks, clean, curate, report, search, temporal
from mnemospark.plans import fixtures as X
from mnemospark.plans import record_queries
from mnemospark.plans.rule_queries import Q
from mnemospark.sources import io

AS_OF = 1706745600
D = "/root/testdata/sf0.001"
assert record_queries


@pytest.mark.parametrize(("of", "least"), [("union", 0.7), ("union", 0.2), ("new", 0.3), ("smaller", 0.3), ("smaller", 0.5)])
@pytest.mark.parametrize("hot", [True, False])
def test_token_pairs_miss_none(spark, of, least, hot):
    """Also where one entity is in every record."""
    r = random.Random(2)
    sets = lambda: {i: {f"w{min(int(r.expovariate(0.25)), 30)}" for _ in range(r.randrange(1, 12))} for i in range(60)}
    a, b = sets(), {100 + i: x for i, x in sets().items()}
    names = {i: {f"e{r.randrange(12)}", f"f{r.randrange(5)}"} | ({"all"} if hot else set()) for i in (*a, *b)}
    df = lambda x: spark.createDataFrame([(i, sorted(s)) for i, s in x.items()], "mid long, tokens array<string>")
    links = spark.createDataFrame([(i, e) for i, es in names.items() for e in es], "mid long, entity string")
    rows = curate.token_pairs(df(a), df(b), links, least, of, few=4).collect()
    got = {tuple(x) for x in rows}
    size = {"union": lambda x, y: len(x | y), "new": lambda x, y: len(x), "smaller": lambda x, y: min(len(x), len(y))}[of]
    near = [(i, j) for i, j in itertools.product(a, b) if names[i] & names[j]]
    want = {(i, j) for i, j in near if len(a[i] & b[j]) >= least * size(a[i], b[j])}
    assert want <= got <= set(near) and len(rows) == len(got)
    assert of != "union" or len(got) < len(near)


@pytest.mark.parametrize(("of", "least"), [("union", 0.7), ("new", 0.3), ("smaller", 0.3)])
def test_an_entity_in_every_record_makes_few_pairs(spark, of, least):
    r = random.Random(3)
    sets = {i: {f"w{r.randrange(400)}" for _ in range(8)} | {"the", "of"} for i in range(160)}
    df = lambda keep: spark.createDataFrame([(i, sorted(s)) for i, s in sets.items() if keep(i)], "mid long, tokens array<string>")
    links = spark.createDataFrame([(i, "all") for i in sets], "mid long, entity string")
    n = curate.token_pairs(df(lambda i: i < 80), df(lambda i: i >= 80), links, least, of).count()
    assert n < 0.3 * 80 * 80


def test_tokens_of_one_side_are_not_shuffled(spark):
    """Of sets with many tokens of their own only the common ones reach the join."""
    df = lambda side: spark.createDataFrame([(i + side, [f"own{side}-{i}-{j}" for j in range(20)] + ["common"]) for i in range(1, 31)], "mid long, tokens array<string>")
    pairs = curate._by_token(df(0), df(100), 0.02)
    assert pairs.count() == 900
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def test_blocks_deal_few_rows():
    for rows in ((5000, 50_000), (50_000, 5000), (11_000, 110_000), (66_000, 660_000), (0, 0), (1, 10**6)):
        i, j = blocks.sides_of(rows, (16384, 32768))
        assert rows[0] <= 16384 * i and rows[1] <= 32768 * j
        assert i * rows[1] + j * rows[0] <= 8 * sum(rows) or i * j <= 5 * 21  # fewer than eight by eight
    assert blocks.sides_of((5000, 50_000), (16384, 32768)) == (1, 16)


def test_consolidation_makes_its_input_once(spark):
    """What is derived reads stored tables; the conversations are read and joined once, before."""
    assert not any("conversations.parquet" in f for f in Q["c01_derived"](spark, D).inputFiles())


def test_tokens_that_meet_by_chance_make_few_pairs(spark):
    """Half of a small vocabulary each: nearly all share a first token and nearly none are similar. Repeated rows lose no pair."""
    r = random.Random(5)
    sets = {i: r.sample([f"w{j}" for j in range(40)], 20) for i in range(120)}
    links = spark.createDataFrame([(i, "all") for i in [*sets, 900]], "mid long, entity string")
    rows = lambda keep: [(i, s) for i, s in sets.items() if keep(i)]
    df = lambda x: spark.createDataFrame(x, "mid long, tokens array<string>")
    a, b = rows(lambda i: i < 60), rows(lambda i: i >= 60)
    got = {tuple(x) for x in curate.token_pairs(df(a), df([*b, (900, sets[0]), (900, sets[0])]), links, 0.7).collect()}
    assert (0, 900) in got and len(got) < 0.02 * 60 * 60


def test_contained_pairs(spark):
    r = random.Random(6)
    texts = {i: "".join(r.choice("aAbc ") for _ in range(r.choice([0, 1, 2, 5, 12, 30]))) for i in range(120)}
    names = {i: {r.choice("xyz"), "hot"} for i in texts}
    df = lambda keep: spark.createDataFrame([(i, t) for i, t in texts.items() if keep(t)], "mid long, content string")
    links = spark.createDataFrame([(i, e) for i, es in names.items() for e in es], "mid long, entity string")
    for chars in (8, 2):
        got = {tuple(x) for x in curate.contained_pairs(df(lambda t: len(t) < 13), df(lambda t: True), links, chars).collect()}
        assert got == {(i, j) for i, t in texts.items() for j, u in texts.items() if len(t) < 13 and t.lower() in u.lower()}


def record(mid, content, **more):
    base = {"mid": mid, "content": content, "mtype": "fact", "ownership": "user", "importance": 0.5, "score": 0.5, "confidence": 0.5, "created_s": AS_OF - 86400, "ord": mid}
    return base | more


RECORD = "mid long, content string, mtype string, ownership string, importance double, score double, confidence double, created_s long, ord long"


def table(spark, rows):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in RECORD.split(", ")) for r in rows], RECORD)


def test_decisions_update_keep_and_add(spark):
    old = [record(1, "Paul lives in a red brick house"), record(2, "Anna works in the old town library", created_s=AS_OF), record(3, "Rome is a city")]
    new = [record(11, "Paul lives in a red brick house not", confidence=0.9, created_s=AS_OF), record(12, "Anna works in the old town library not", confidence=0.1, ownership="third_party", created_s=AS_OF - 30 * 86400), record(13, "Rome is something else, not a town"), record(14, "Paul lives in a red brick house")]
    links = spark.createDataFrame([(r["mid"], r["content"].split()[0]) for r in old + new], "mid long, entity string")
    out = {x["a"]: (x["op"], x["target"]) for x in curate.decide(table(spark, new), table(spark, old), links, words=("not",)).collect()}
    assert out == {11: ("UPDATE", 1), 12: ("NOOP", 2), 13: ("ADD", None), 14: ("ADD", None)}


def test_contained_texts_of_few_words_are_duplicates(spark):
    old, new = [record(1, "cat")], [record(2, "Concatenate"), record(3, "A dog")]
    links = spark.createDataFrame([(1, "X"), (2, "X"), (3, "X")], "mid long, entity string")
    inserts, _, _ = curate.overlap_dedup(table(spark, new), table(spark, old), links)
    assert [x["mid"] for x in inserts.collect()] == [3]


@pytest.mark.parametrize("bucket", [10, 1000, 30 * 86_400_000_000])
def test_value_at(spark, bucket):
    r = random.Random(4)
    versions = [(v, r.choice("ab"), "x", f"v{v}", r.randrange(200)) for v in range(80)]
    times = [(t, r.choice("abc"), "x", r.randrange(-20, 260)) for t in range(60)]
    v = spark.createDataFrame(versions, "vid long, entity string, attribute string, value string, ts_us long")
    t = spark.createDataFrame(times, "tid long, entity string, attribute string, at_us long")
    got = {(x["tid"], x["vid"], x["value"]) for x in temporal.value_at(v, t, bucket).collect()}
    want = set()
    for tid, e, _, at in times:
        known = [(ts, vid, value) for vid, e2, _, value, ts in versions if e2 == e and ts <= at]
        if known:
            want.add((tid, max(known)[1], max(known)[2]))
    assert got == want


def test_spread_of_a_hot_entity(spark):
    links = spark.createDataFrame([(i, "hot") for i in range(200)] + [(i, f"e{i}") for i in range(200)], "mid long, entity string")
    facts = spark.createDataFrame([(i, i % 7 / 10) for i in range(200)], "mid long, score double")
    results = spark.createDataFrame([(q, (i * 7 + 6) % 200, i + 1) for q in range(3) for i in range(20)], "qid long, mid long, pos long")
    got = sorted((x["qid"], x["mid"], round(x["score"], 6)) for x in search.spread(results, links, facts, most_results=20).collect())
    taken = {(i * 7 + 6) % 200 for i in range(20)}
    best = sorted((i for i in range(200) if i not in taken), key=lambda i: (-(i % 7), i))[:3]
    assert got == [(q, i, round(i % 7 / 10 * 0.3, 6)) for q in range(3) for i in sorted(best)]


def test_a_leading_any_pattern_is_searched_without_it(spark):
    df = spark.createDataFrame([("熵的定义",), ("x\n熵的定义",), ("定义",)], "content string")
    assert [x[0] for x in df.select(T.matches(F.col("content"), (".*的定义",))).collect()] == [True, True, False]
    words = [x[0] for x in df.select(T.any_of_lower(F.lit("ABC搜索"), ("搜索", "abc"))).collect()]
    assert words == [True] * 3 and R.noise_reason is not None


def test_the_router_takes_every_path(spark):
    rows = Q["g08_full_router"](spark, D).collect()
    assert {x["source"] for x in rows} == {"search", "spread", "temporal"} and {x["tier"] for x in rows} == {"direct", "marked", "reference"}
    timed = {x["qid"] for x in rows if x["source"] == "temporal"}
    assert timed and not timed & {x["qid"] for x in rows if x["source"] != "temporal"}


def test_written_decisions_are_of_every_kind(spark):
    from mnemospark.plans.record_queries import decided

    ops = {x["op"] for d in ("sf0.001", "sf0.01") for x in decided(spark, f"/root/testdata/{d}").select("op").distinct().collect()}
    assert ops == {"ADD", "UPDATE", "NOOP"}
    assert Q["a11_conflict_stats"](spark, D).count() >= 2 and Q["j14_supersede"](spark, D).where("superseded").count() > 0
    settled = Q["x02_known_facts"](spark, "/root/testdata/sf0.01").where("verdict <> 'unchanged'").collect()
    assert {x["verdict"] for x in settled} >= {"confirmed"}


def test_scorer_sees_only_the_uncertain_rows(spark):
    rows = spark.createDataFrame([(1, "a sure thing", 0.9), (2, "a doubtful thing", 0.25), (3, "another doubtful one", 0.25), (4, "a poor thing", 0.1)], "mid long, content string, i double")
    asked = []

    def scorer(df):
        asked.append({x["mid"] for x in df.collect()})
        return df.withColumn("importance", F.when(F.col("mid") == 2, 0.8).otherwise(0.0))

    out = {x["mid"]: x["method"] for x in clean.importance_filter(rows, F.col("i"), scorer=scorer).collect()}
    assert asked == [{2, 3}] and out == {1: "rule", 2: "external"}


def test_reports_of_nothing(spark):
    m = X.mem(spark, D).limit(0)
    links = X.ent(spark, D).limit(0)
    lines = {(x["section"], x["pos"]): x["line"] for x in report.snapshot(m, links).collect()}
    assert set(lines) == {("totals", i) for i in range(1, 6)} and lines["totals", 1] == "- **Facts**: 0 条 (0%)"
    assert report.dashboard(m.withColumn("last_verified_s", F.col("created_s")), F.lit(False), AS_OF).count() == 5
    assert report.pending_view(m.withColumn("ord", F.col("mid")), F.lit(True)).count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        io.shared_path(Session(), "x")


def test_records_of_one_entity_meet_without_pairs(spark, monkeypatch):
    """Every record has the entity and a third of its tokens in common with all others: what is kept grows with the records."""
    kept = []
    keep = lambda df, name: kept.append((out := io.stored(df, name)).count()) or out
    monkeypatch.setattr(curate, "stored", keep)
    r = random.Random(4)
    text = lambda i: " ".join(f"w{chr(97 + x)}" for x in sorted(r.sample(range(9), 4))) + f" All{' worthless' if i % 3 == 0 else ''}"
    rows = {i: text(i) for i in range(160)}
    df = spark.createDataFrame([(i, t, i, i % 7 / 7, 0.5, 0.5, "user", 0) for i, t in rows.items()], "mid long, content string, ord long, importance double, score double, confidence double, ownership string, created_s long")
    links = spark.createDataFrame([(i, e) for i in rows for e in ("all", f"e{i % 5}")], "mid long, entity string")
    new, old = df.where("mid < 60"), df.where("mid >= 60")
    sets = {i: set(t.lower().split()) for i, t in rows.items()}
    inserts, updates, downgrades = curate.overlap_dedup(new, old, links, 0.3, ("worthless",), ("nothing",))
    like = {(i, j) for i in range(60) for j in range(60, 160) if len(sets[i] & sets[j]) / min(len(sets[i]), len(sets[j])) >= 0.3}
    first = {i: min(j for k, j in like if k == i) for i in range(60) if i % 3 and any(k == i for k, _ in like)}
    down = {j: sum(k % 3 == 0 for k, m in like if m == j) for j in range(60, 160)}
    assert {x.mid for x in inserts.collect()} == set(range(60)) - set(first)
    assert {x.mid: x.content for x in updates.collect()} == {j: rows[max(i for i, k in first.items() if k == j and i % 7 > j % 7)] for j in {k for i, k in first.items() if i % 7 > k % 7}}
    assert {x.mid: x.n for x in downgrades.collect()} == {j: n for j, n in down.items() if n}
    verdicts = {x.mid: (x.verdict, x.fact) for x in curate.verify_beliefs(new, old, links, ("worthless",)).collect()}
    share = lambda i, j: len(sets[i] & sets[j]) / len(sets[i])
    for i in range(60):
        hits = [j for j in range(60, 160) if share(i, j) > 0.5 or ((i % 3 == 0) != (j % 3 == 0) and share(i, j) > 0.3)]
        want = ("unchanged", None) if not hits else ("confirmed" if share(i, hits[0]) > 0.5 else "contradicted", hits[0])
        assert verdicts[i] == want
    assert kept and max(kept) <= 320


def test_a_day_of_many_records_is_dealt_over_tasks(spark):
    """All records are of one day: the rows come from several tasks."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        m = spark.range(400).select(F.col("id").alias("mid"), (F.lit(AS_OF) + F.col("id")).alias("created_s"))
        q = spark.createDataFrame([(i, AS_OF + i, AS_OF + 100 + i) for i in range(5)], "qid long, from_s long, to_s long")
        rows = temporal.in_range(q, m).select("qid", "mid", F.spark_partition_id().alias("p")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted((r.qid, r.mid) for r in rows) == [(i, x) for i in range(5) for x in range(i, i + 100)]
    assert len({r.p for r in rows}) > 3
