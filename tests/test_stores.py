"""Versions, streams over several files, index segments, vector cells and bucketed tables, against plain Python."""

import itertools
import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemospark.functions.text import entity_similarity
from mnemospark.operators import curate, entities, index, search, segments, temporal, topk, vectors
from mnemospark.plans import fixtures as X
from mnemospark.plans import rule_queries, stream_queries
from mnemospark.sources import io, versions
from mnemospark.streaming import streams

AS_OF = 1706745600
D = "/root/testdata/sf0.001"
assert stream_queries.Q is rule_queries.Q


# --- versions ------------------------------------------------------------------------------------------------------------


def test_a_failed_write_leaves_the_version_before(spark):
    root = io.shared_path(spark, "versions")
    first = versions.replace(spark.range(3), root)
    broken = spark.range(5).withColumn("x", F.raise_error(F.lit("broken")))
    with pytest.raises(Exception, match="broken"):
        versions.replace(broken, root)
    assert versions.current(spark, root) == first and versions.read(spark, root).count() == 3
    second = versions.replace(spark.range(7), root, {"why": "more"})
    assert (second.number, versions.current(spark, root).note) == (2, {"why": "more"})
    assert [versions.read(spark, root, n).count() for n in (1, 2)] == [3, 7]
    assert versions.read(spark, root, as_of_s=(first.made_s + second.made_s) / 2).count() == 3


def test_of_two_writers_from_one_version_the_second_is_refused(spark):
    root = io.shared_path(spark, "versions")
    start = versions.current(spark, root)
    versions.publish(spark, root, start, [versions.new_part(spark.range(2), root)])
    with pytest.raises(versions.Conflict):
        versions.publish(spark, root, start, [versions.new_part(spark.range(9), root)])
    assert versions.read(spark, root).count() == 2
    with pytest.raises(ValueError):
        versions.read(spark, root, 5)


# --- streams -------------------------------------------------------------------------------------------------------------


def test_access_merge_counts_each_batch_once_and_lists_late_rows(spark):
    root = io.shared_path(spark, "accesses")
    df = lambda rows: spark.createDataFrame(rows, "mid long, access_type string, s long").select("mid", "access_type", F.timestamp_seconds("s").alias("ts"))
    batches = [df([(1, "retrieval", 100), (2, "retrieval", 5000)]), df([(1, "used_in_response", 4500), (1, "retrieval", 10)]), df([(3, "user_mentioned", 9000), (2, "retrieval", 1)]), df([])]
    job = streams.merge_accesses(root, 1000, compact_after=2)
    for i, b in enumerate(batches):
        job(b, i)
        job(b, i)  # played again
    got = {r["mid"]: tuple(r)[1:] for r in streams.merged_accesses(spark, root).collect()}
    assert got == {1: (2, 1, 1, 0, 4500), 2: (1, 1, 0, 0, 5000), 3: (1, 0, 0, 1, 9000)}
    assert sorted((r["mid"], r["access_type"]) for r in streams.late_accesses(spark, root).collect()) == [(1, "retrieval"), (2, "retrieval")]
    assert len(versions.versions(spark, root)) == 4 and len(versions.current(spark, root).parts) <= 2


def test_access_counts_equal_the_batch_form(spark):
    root, log = io.shared_path(spark, "accesses"), stream_queries.accesses(spark, D)
    src = io.arriving_stream(spark, io.arriving(log, F.unix_seconds("ts"), 3))
    streams.drain(src, streams.merge_accesses(root, 10**9), io.shared_path(spark, "offsets")).awaitTermination()
    m = X.mem(spark, D).select("mid", "retrieval_count", "used_in_response_count", "user_mentioned_count", "last_accessed_s")
    batch = curate.apply_access(m, X.access_log(spark, D)).collect()
    merged = curate.add_access(m, streams.merged_accesses(spark, root)).collect()
    assert sorted(map(tuple, merged), key=str) == sorted(map(tuple, batch), key=str)


def file_stream(spark, batches, schema):
    """A stream with a file for each batch of rows; schema has s, the event time in seconds."""
    path = io.shared_path(spark, "files")
    for rows in batches:
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(path)
    return io.arriving_stream(spark, path)


def test_a_renewed_expiry_cancels_the_timer(spark):
    streams.rocksdb(spark)
    batches = [
        [(1, 200, 100), (2, 300, 100), (3, 5000, 100), (4, None, 100), (5, 250, 100), (6, 900, 100)],
        [(1, 700, 150), (5, None, 160), (2, 250, 90), (6, 20, 170)],  # renewed, without expiry, an older version, one already over
        [(9, None, 420)],  # 2 expires, with its newer version's time
        [(1, 900, 350), (7, 10, 1)],  # late: the watermark is 320
        [(9, None, 1100)],
        [(8, 1000, 1090), (9, None, 1105)],
    ]
    out = io.drained(streams.expire_by_timer(file_stream(spark, batches, "mid long, expires_s long, s long"), "100 seconds"))
    got = sorted((r["mid"], r["expires_s"]) for r in out.collect())
    assert (2, 300) in got and (6, 20) in got and not {3, 4, 5, 7} & {m for m, _ in got}
    assert [e for m, e in got if m == 1] == [900]
    assert len(got) == len({m for m, _ in got})


def test_sessions_keep_ten_ids_and_close_by_the_watermark(spark):
    streams.rocksdb(spark)
    r = random.Random(3)
    events = [(u, i, 10_000 + r.randrange(30_000) if u else 10_000 + i) for i, u in enumerate([0] * 300 + [1, 2, 3] * 40)]
    order = sorted(events, key=lambda e: e[2] + e[1] % 3 * 200)
    batches = [order[k : k + 110] for k in range(0, len(order), 110)] + [[(9, -1, 10**6)]]
    out = io.drained(streams.intents(file_stream(spark, batches, "user_id long, event_id long, s long"), 600, "15 minutes")).where("user_id < 9").collect()
    want = []
    for u in range(4):
        own, session = sorted((s, i) for v, i, s in events if v == u), []
        for s, i in own:
            if session and s - session[-1][0] >= 600:
                want.append((u, session))
                session = []
            session.append((s, i))
        want.append((u, session))
    want = [(u, x[0][0] * 10**6, (x[-1][0] + 600) * 10**6, len(x), ",".join(str(i) for _, i in sorted(x, reverse=True)[:10])) for u, x in want]
    assert sorted(map(tuple, out)) == sorted(want)


def test_many_open_sessions_join_at_once():
    """20,000 events of two users, a session each, then one user's as many that unite them: no step for each pair of sessions."""
    none = [np.zeros(0, np.int64)] * 7
    ts = np.arange(20_000) * 1000
    began = time.time()
    apart = none
    for user in (7, 3):
        apart = streams._joined(apart, np.full_like(ts, user), np.random.default_rng(user).permutation(ts), np.zeros_like(ts), 1000, 3)
    one = streams._joined(apart, np.full_like(ts, 3), ts + 500, np.ones_like(ts), 1000, 3)
    assert time.time() - began < 5
    assert len(apart[0]) == 40_000 and len(one[0]) == 20_001 and [x[0] for x in one[:5]] == [3, 0, 20_000_500, 40_000, 3]
    assert (one[5][:3].tolist(), one[6][:3].tolist()) == ([19_999_500, 19_999_000, 19_998_500], [1, 0, 1])
    assert all((a[1:] == b[20_000:]).all() for a, b in zip(one[:5], apart[:5], strict=True))


def test_a_message_that_comes_again_in_a_later_file_is_dropped(spark):
    rows = [[(1, "a", 100), (2, "b", 110)], [(1, "a", 100), (3, "c", 4000)], [(2, "b", 110), (4, "d", 90_000)], [(5, "late", 1), (4, "d", 90_000)]]
    src = file_stream(spark, rows, "id long, content string, s long")
    out = io.drained(streams.pending_stream(src, "1 hour", critical=("x",), important=("y",), time=("^$^",)))
    assert sorted(r["id"] for r in out.collect()) == [1, 2, 3, 4]


def test_pending_batches_are_consolidated_once(spark):
    root = io.shared_path(spark, "records")
    job = streams.consolidate_pending(root, rule_queries.imp(), F.lit(False))
    pending = X.mem(spark, D).withColumn("urgent", F.lit(True))
    for batch, i in ((pending.where("mid % 2 = 0"), 0), (pending.where("mid % 2 = 1"), 1), (pending.where("mid % 2 = 1"), 1)):
        job(batch, i)
    from mnemospark.plans import jobs

    want = jobs.mini_consolidate(pending, rule_queries.imp(), F.lit(False)).select("id").collect()
    assert sorted(r["id"] for r in versions.read(spark, root).select("id").collect()) == sorted(r["id"] for r in want)


# --- index segments and vectors ------------------------------------------------------------------------------------------


def test_segments_equal_a_rebuild_after_each_change(spark):
    r, root, now = random.Random(8), io.shared_path(spark, "index"), {}
    words = ["alpha", "beta", "gamma", "delta"]
    schema = "mid long, content string, mtype string, v array<double>"
    merges = 0
    for step in range(9):
        ups = {r.randrange(30): (" ".join(r.choice(words) for _ in range(3)), "fact", [r.random(), r.random()] if r.random() < 0.8 else None) for _ in range(25 if step == 0 else 4)}
        gone = [i for i in now if r.random() < 0.15 and i not in ups]
        before = len(versions.current(spark, root).note.get("segments", []))
        segments.change(spark, root, spark.createDataFrame([(i, *x) for i, x in ups.items()], schema), spark.createDataFrame([(i,) for i in gone], "mid long"), fanout=3)
        merges += len(versions.current(spark, root).note["segments"]) <= before
        now = {i: x for i, x in (now | ups).items() if i not in gone}
        table = spark.createDataFrame([(i, *x) for i, x in now.items()], schema)
        assert sorted(map(tuple, segments.live_postings(spark, root).collect())) == sorted(map(tuple, index.postings(table).collect()))
        live = {x["mid"]: (x["mtype"], x["v"]) for x in segments.live_vectors(spark, root).collect()}
        assert live == {i: (t, v) for i, (_, t, v) in now.items() if v is not None}
    assert merges >= 2


def some_vectors(spark, n=900, width=8):
    r = random.Random(1)
    middles = [[r.gauss(0, 1) for _ in range(width)] for _ in range(12)]
    rows = [(i, [x + r.gauss(0, 0.25) for x in middles[i % 12]], "fact" if i % 3 else "belief") for i in range(n)]
    rows += [(n, [0.0] * width, "fact"), (n + 1, rows[0][1], "fact"), (n + 2, [2 * x for x in rows[0][1]], "fact")]
    return rows, spark.createDataFrame(rows, "mid long, v array<double>, mtype string")


def nearest(rows, qv, k):
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    score = lambda v: round(sum(x * y for x, y in zip(v, qv, strict=True)) / (norm(v) * norm(qv)), 9)
    return [i for _, i in sorted((-score(v), i) for i, v, _ in rows if norm(v))[:k]]


def test_vector_index_is_exact_and_its_probes_reach_the_recall(spark):
    rows, df = some_vectors(spark)
    built = vectors.build(df, 24)
    asked = df.where("mid % 20 = 0 AND mid < 900").select(F.col("mid").alias("qid"), F.col("v").alias("qv"))
    for only in (None, "fact"):
        got = {}
        for x in vectors.search(asked, built, 10, probes=3, where=None if only is None else "mtype = 'fact'").collect():
            got.setdefault(x["qid"], []).append((x["pos"], x["mid"]))
        kept = [x for x in rows if only is None or x[2] == only]
        assert {q: [m for _, m in sorted(x)] for q, x in got.items()} == {q: nearest(kept, rows[q][1], 10) for q in range(0, 900, 20)}
    probed = vectors.search(asked, built, 10, probes=3, exact=False).collect()
    want = {(q, m) for q in range(0, 900, 20) for m in nearest(rows, rows[q][1], 10)}
    assert len(want & {(x["qid"], x["mid"]) for x in probed}) / len(want) >= 0.9
    assert "PushedFilters: [IsNotNull(mtype), EqualTo(mtype,fact)" in vectors.search(asked, built, 10, 3, exact=False, where="mtype = 'fact'")._jdf.queryExecution().toString()


def test_vector_index_of_few_or_no_vectors(spark):
    _, df = some_vectors(spark, 3)
    asked = df.select(F.col("mid").alias("qid"), F.col("v").alias("qv"))
    assert vectors.search(asked, vectors.build(df, 50), 10, 2).count() == 5 * 5
    assert vectors.search(asked, vectors.build(df.limit(0), 4), 10, 2).count() == 0
    assert vectors.search(asked.limit(0), vectors.build(df, 4), 10, 2).count() == 0


def test_early_stop_gives_the_same_rows_from_fewer_postings(spark):
    r = random.Random(2)
    common, rare = ["the", "and", "with"], [f"r{i}" for i in range(60)]
    rows = [(i, " ".join(r.choice(common) for _ in range(r.randrange(1, 9))) + " " + " ".join(r.choices(rare, k=r.randrange(0, 4)))) for i in range(3000)]
    m = spark.createDataFrame(rows, "mid long, content string")
    ask = spark.createDataFrame([(1, "the r1 r2"), (2, "and with r5 r5 r9"), (3, "r7"), (4, "the and with"), (5, "unheard"), (6, "")], "qid long, query string")
    forms = [(topk.bm25_parts(m), topk.bm25_terms(ask), search.bm25_channel(ask, m)), (topk.tfidf_parts(m), topk.tfidf_terms(ask), search.tfidf_channel(ask, m))]
    line = lambda x: (x["qid"], x["pos"], x["mid"], round(x["score"], 9))
    for parts, terms, channel in forms:
        built = topk.build(parts, block=32)
        found = topk.search(terms, built, 10)
        assert sorted(map(line, found.results.collect())) == sorted(map(line, search.top(channel, 10).collect()))
        some = terms.where("qid < 4")  # of common terms alone everything must be read; a rarer one lets their tails go
        all_met = some.join(built.postings, "term").count()
        read = topk.search(some, built, 10).read
        assert 0 < read < 0.5 * all_met, (read, all_met)
        assert built.blocks.agg(F.max("n")).first()[0] < 4 * 32 and built.blocks.agg(F.sum("n")).first()[0] == built.postings.count()
    keys = topk.build(topk.keyword_parts(index.postings(m)), block=32)
    asked = topk.keyword_weights(ask)
    assert sorted(map(line, topk.search(asked, keys, 10).results.collect())) == sorted(map(line, search.top(search.keyword_channel(ask, index.postings(m)), 10).collect()))
    assert topk.search(asked.limit(0), keys, 10).results.count() == 0 and topk.search(asked, topk.build(topk.keyword_parts(index.postings(m.limit(0)))), 10).results.count() == 0


def test_bucketed_tables_join_without_an_exchange(spark):
    posts = io.write_bucketed(index.postings(X.mem(spark, D)), "postings_by_term", "term", 8)
    links = io.write_bucketed(X.ent(spark, D), "links_by_entity", "entity", 8)
    asked = X.qry(spark, D)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for stored_, key, run in ((posts, "term", lambda t: search.keyword_terms(asked).join(t, "term")), (links, "entity", lambda t: search.query_entities(asked, X.ent(spark, D)).join(t, "entity"))):
            plan = run(stored_)._jdf.queryExecution().executedPlan().toString()
            scan = [x for x in plan.splitlines() if "FileScan" in x and "Bucketed: true" in x]
            assert scan and "SelectedBucketsCount: 8 out of 8" in scan[0]
            lines = plan.splitlines()
            depth = lambda x: len(x) - len(x.lstrip(" :+-"))
            above, last = [], depth(scan[0])
            for x in reversed(lines[: lines.index(scan[0])]):
                if depth(x) < last:
                    above, last = [*above, x], depth(x)
            above = list(itertools.takewhile(lambda x: "Join" not in x, above))
            assert above and not any("Exchange" in x for x in above), (key, above)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sorted(map(tuple, search.keyword_channel(asked, posts).collect())) == sorted(map(tuple, search.keyword_channel(asked, index.postings(X.mem(spark, D))).collect()))


# --- time, chains and prefixes -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bucket", [3, 50, 30 * 86_400_000_000])
def test_validity_of_a_hot_key(spark, bucket):
    r = random.Random(5)
    rows = [(i, r.choice(["hot", "hot", "hot", "a", None]), "x", r.randrange(-40, 300)) for i in range(300)]
    df = spark.createDataFrame(rows, "vid long, entity string, attribute string, ts_us long")
    got = {x["vid"]: x["valid_to"] for x in temporal.validity(df, bucket).collect()}
    want = {}
    for e in ("hot", "a", None):
        own = sorted((t, i) for i, x, _, t in rows if x == e)
        want |= {i: n[0] if n else None for (_, i), n in itertools.zip_longest(own, own[1:])}
    assert got == want


def test_chains_of_any_length(spark, monkeypatch):
    n, steps = 1000, []
    kept = temporal.stored
    monkeypatch.setattr(temporal, "stored", lambda df, name: (steps.append(name), kept(df, name))[1])
    rows = [(i, i - 1 if i else None, 1 - i / 2000) for i in range(n)] + [(2000 + i, 2000 + (i + 1) % 7, 0.5) for i in range(7)] + [(3000, 2003, 0.9), (3001, 9999, 0.4)]
    df = spark.createDataFrame(rows, "mid long, supersedes_id long, confidence double")
    got = {x["mid"]: (x["root"], x["hops"], x["cyclic"]) for x in temporal.evidence_roots(df).collect()}
    assert all(got[i] == (0, i, False) for i in range(n)) and got[3001] == (3001, 0, False)
    assert all(got[i] == (None, None, True) for i in [*range(2000, 2007), 3000]) and len(steps) <= 12


def test_evidence_chains_double_and_end_in_cycles(spark):
    edges = [(i, i - 1) for i in range(1, 70)] + [(100, 101), (101, 102), (102, 100), (103, 100), (50, 20)]
    df = spark.createDataFrame(edges, "mid long, evidence long")
    step, want = {}, {}
    for a, b in edges:
        step.setdefault(a, set()).add(b)
    for a in step:
        front, hop = {a}, 0
        while front := {c for b in front for c in step.get(b, ())} - {c for x, c in want if x == a}:
            hop += 1
            want |= {(a, c): hop for c in front}
    rows = lambda hops: {(x["mid"], x["evidence"]): x["hop"] for x in temporal.evidence_chain(df, hops).collect()}
    assert rows(None) == want and rows(5) == {k: h for k, h in want.items() if h <= 5}


def test_patterns_of_prefix_nodes(spark):
    r = random.Random(9)
    names = lambda k: list({r.choice(["proj", "pro", "robot_", "A.b"]) + r.choice(["1", "22", "A", "BC", "DEF", "xy", "z", ""]) for _ in range(k)})
    new, old = names(25), names(25)
    got = {tuple(x) for x in entities.generalise(spark.createDataFrame([(x,) for x in new], "entity string"), spark.createDataFrame([(x,) for x in old], "entity string")).collect()}
    import re

    def kind(s):
        return next((k for k, p in (("empty", ""), ("digit", r"\d+"), ("single_upper", "[A-Z]"), ("multi_upper", "[A-Z]{2,3}"), ("lower", "[a-z]+")) if re.fullmatch(p, s)), "mixed")

    want = set()
    for e in new:
        group = [x for x in old if x.startswith(e[: math.ceil(len(e) / 2)])] + [e]
        lo, hi = min(group), max(group)
        p = lo[: next((i for i in range(min(len(lo), len(hi))) if lo[i] != hi[i]), min(len(lo), len(hi)))]
        kinds, sizes = {kind(x[len(p) :]) for x in group}, [len(x) - len(p) for x in group]
        if len(group) >= 3 and len(kinds) == 1 and p:
            span = f"[A-Z]{{{min(sizes)}}}" if min(sizes) == max(sizes) else f"[A-Z]{{{min(sizes)},{max(sizes)}}}"
            tail = {"digit": r"\d+", "single_upper": "[A-Z]", "multi_upper": span, "lower": "[a-z]+"}.get(kinds.pop())
            if tail:
                want.add((e, re.sub(r"(\W)", r"\\\1", p) + tail))
    assert got == want


def test_upserted_records_get_defaults_and_their_own_children(spark):
    stored_ = spark.createDataFrame([(1, "a", 0.9, 1, 1), (2, "b", 0.8, 1, 1)], "mid long, content string, importance double, state int, seq int")
    new = spark.createDataFrame([(2, "c", None, 2, 3, ["x", "x"]), (2, "old", 0.1, 2, 2, ["y"]), (3, "d", 0.2, 2, 1, [])], "mid long, content string, importance double, state int, seq int, entities array<string>")
    links = spark.createDataFrame([(1, "p"), (2, "q")], "mid long, entity string")
    out = io.upsert_records(stored_, new, {"entities": links}, {"entities": "entity"}, {"importance": 0.5})
    assert {x["mid"]: (x["content"], x["importance"], x["state"]) for x in out.records.collect()} == {1: ("a", 0.9, 1), 2: ("c", 0.5, 0), 3: ("d", 0.2, 0)}
    assert sorted(map(tuple, out.children["entities"].collect())) == [(1, "p"), (2, "x")]


def test_channels_in_blocks_give_the_best_of_the_whole(spark):
    """The best rows of each query are those of the joined channel, ties by mid."""
    m, ask = X.mem(spark, D), X.qry(spark, D)
    posts = index.postings(m)
    line = lambda r: (r["qid"], r["mid"], r["pos"], round(r["score"], 8))
    for whole, few in ((search.keyword_channel(ask, posts), search.keyword_channel(ask, posts, 7)), (search.tfidf_channel(ask, m), search.tfidf_channel(ask, m, 7))):
        assert sorted(map(line, search.top(whole, 7).collect())) == sorted(map(line, search.top(few, 7).collect()))


def test_few_of_the_like_names_are_compared(spark):
    """A tenth of what the join on lengths compares, with the same pairs."""
    names = [r["entity"] for r in X.ent(spark, "/root/testdata/sf0.01").select("entity").distinct().collect()]
    few, every = spark.createDataFrame([(x,) for x in sorted(names)[::8]], "q string"), spark.createDataFrame([(x,) for x in names], "e string")
    compared = entities.near_names(few, every, 0.5).count()
    by_length = sum(min(len(a), len(b)) >= 0.5 * max(len(a), len(b)) for a in sorted(names)[::8] for b in names if a != b)
    assert compared < 0.1 * by_length, (compared, by_length)


@pytest.mark.parametrize("threshold", [0.5, 0.7])
def test_near_names_leave_their_blocks_only_if_they_are_near(spark, threshold):
    """Exactly the pairs within the edits, up to a word's bits; longer names lose none."""
    r = random.Random(8)
    names = sorted({"".join(r.choice("abé日") for _ in range(r.choice([1, 2, 5, 9, 30, 63, 64]))) for _ in range(70)})
    names += [x + y for x in names[:8] for y in ("a", "ab")] + ["ab" * 33, "ab" * 33 + "b", "ab" * 31]
    df = lambda c: spark.createDataFrame([(x,) for x in sorted(set(names))], f"{c} string")
    longest = F.greatest(F.length("q"), F.length("e"))
    near = df("q").crossJoin(df("e")).where("q <> e").where(F.levenshtein("q", "e") <= F.floor(longest * (1 - threshold) + 1e-9))
    want = {tuple(x) for x in near.select("q", "e").collect()}
    got = [tuple(x) for x in entities.near_names(df("q"), df("e"), threshold).select("q", "e").collect()]
    short = lambda pairs: {p for p in pairs if max(map(len, p)) <= 64}
    assert want <= set(got) and len(got) == len(set(got)) and short(want) == short(got)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.6, 0.8])
def test_like_names_are_all_found(spark, threshold):
    r = random.Random(4)
    names = sorted({"".join(r.choice("abA_日") for _ in range(r.randrange(0, 9))) for _ in range(120)} | {"a", "", "projekt_1", "projekt_22", "projekt"})
    df = lambda c: spark.createDataFrame([(x,) for x in names], f"{c} string")
    pairs = df("q").crossJoin(df("e")).where("q <> e").withColumn("s", entity_similarity(F.col("q"), F.col("e"))).where(F.col("s") >= threshold).where("q <> '' AND e <> ''")
    got = entities.similar_pairs(df("q"), df("e"), threshold)
    assert sorted((x["q"], x["e"], round(x["similarity"], 9)) for x in got.collect()) == sorted((x["q"], x["e"], round(x["s"], 9)) for x in pairs.collect())


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.55, 0.8])
def test_names_of_one_table_meet_once_in_blocks(spark, monkeypatch, threshold):
    """Both directions of every like pair, with the similarity that the column function has, from words of 8 to 64 bits and beyond."""
    monkeypatch.setattr(entities.blocks, "side_of", lambda n, most: 3)
    r = random.Random(5)
    names = {"".join(r.choice("abé日😀") for _ in range(r.choice([1, 2, 5, 8, 9, 16, 17, 20, 32, 33, 64]))) for _ in range(120)}
    names |= {x + y for x in sorted(names)[::3] for y in ("a", "ab")} | {"b" + x for x in sorted(names)[::5]} | {"", "ab" * 33, "ab" * 33 + "b", "ab" * 31}
    df = lambda c: spark.createDataFrame([(x,) for x in sorted(names)], f"{c} string")
    whole = df("q").crossJoin(df("e")).where("q <> e AND q <> '' AND e <> ''").withColumn("similarity", entity_similarity(F.col("q"), F.col("e")))
    want = sorted(map(tuple, whole.where(F.col("similarity") >= threshold).collect()))
    assert want and sorted(map(tuple, entities.similar_pairs(df("q"), threshold=threshold).collect())) == want
    assert sorted(map(tuple, entities.similar_pairs(df("q"), df("e"), threshold).collect())) == want


def test_like_names_are_neither_written_nor_judged_twice(spark, monkeypatch):
    """Only the names go to the shared folder: the pairs, of which there are very many, leave as the result."""
    made, names = [], X.ent(spark, D).select(F.col("entity").alias("q")).distinct()
    monkeypatch.setattr(entities, "stored", lambda df, name: made.append(name) or io.stored(df, name))
    both = entities.similar_pairs(names, names.withColumnRenamed("q", "e")).count()
    assert made == ["queries", "names"]
    assert entities.similar_pairs(names).count() == both > 0 and made == ["queries", "names", "queries"]
    judged = lambda left, right: iter([pa.record_batch([pa.array([left.num_rows * (left.num_rows - 1) // 2 if right is None else left.num_rows * right.num_rows])], ["n"])])
    n = names.count()
    assert entities.blocks.own_pairs(names, 4, "q", judged, "n long").agg(F.sum("n")).first()[0] == n * (n - 1) // 2


def test_vector_channel_meets_in_blocks_with_many_copies(spark):
    """Exact with ties by mid, and without a nested loop over all pairs."""
    _, df = some_vectors(spark, 300)
    copies = df.unionByName(df.where("mid % 3 = 0").withColumn("mid", F.col("mid") + 1000)).select("mid", "v").cache()
    asked = copies.where("mid % 20 = 0").select(F.col("mid").alias("qid"), F.col("v").alias("qv"))
    channel = search.vector_channel(asked, copies, 7, digits=6)
    plan = channel._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {(x.qid, x.pos): (x.mid, x.score) for x in channel.collect()}
    rows = [tuple(x) for x in copies.collect() if any(x.v)]
    cosine = lambda x, y: round(sum(a * b for a, b in zip(x, y, strict=True)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y)), 6)
    want = {}
    for qid, v in ((m, v) for m, v in rows if m % 20 == 0):
        best = sorted((-cosine(v, u), m) for m, u in rows)[:7]
        want |= {(qid, i + 1): (m, -c) for i, (c, m) in enumerate(best)}
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 2e-6 for x in got)


def test_a_search_reads_the_rest_whole_once_looking_up_costs_more(spark, monkeypatch):
    """Equal parts never let a query stop early: its postings are read once, not term by term for each record named."""
    made = []
    keep = lambda df, name: made.append(name) or io.stored(df, name)
    monkeypatch.setattr(topk, "stored", keep)
    parts = spark.createDataFrame([(f"t{i % 9}", m, 1.0) for m in range(400) for i in (m, m + 1, m * 7)], "term string, mid long, part double").distinct()
    terms = spark.createDataFrame([(q, f"t{(q + i) % 12}", 1.0) for q in range(6) for i in range(5)], "qid long, term string, weight double")
    built = topk.build(parts, block=8)
    made.clear()
    got = topk.search(terms, built, 5)
    full = search.top(terms.join(parts, "term").groupBy("qid", "mid").agg(F.sum("weight").alias("score")), 5)
    assert sorted(map(tuple, got.results.select("qid", "mid", "score", "pos").collect())) == sorted(map(tuple, full.select("qid", "mid", "score", "pos").collect()))
    assert made.count("scores") <= 1
