"""Packing, ranked search and the filter audit against brute force, with nulls, ties, repeated rows, empty tables and other columns."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mnemospark.llm import audit, packing, ranked

MODEL = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, uid string, rank string, part string"  # names that clash with internal ones


def table(spark, rows):
    return spark.createDataFrame([(i, t, "u", "r", "p") for i, t in rows], SCHEMA)


# --- packing -------------------------------------------------------------------------------------------------------


def odd_texts():
    r = random.Random(5)
    signs = "aZéÉßİΣς'sdﬁǅ́̈Å中ひ한1٣½_-.,!?\"#\x00\x1c\x85\xa0 ​ 😀👩‍💻"
    texts = ["".join(r.choice(signs + "   \n\t") for _ in range(r.randrange(1, 200))) for _ in range(200)]
    return texts + ["<|startoftext|> a<|endoftext|>b <|startoftext|><|startoftext|>", "it's THEY'LL we'd", " ́a", "a ̸=", "x" * 5000, "", " "]


def test_words_encode_as_whole_texts_do():
    coder, model, texts = packing.Encoder(MODEL), Tokenizer.from_file(MODEL), odd_texts()
    want = [model.encode(x, add_special_tokens=False).ids for x in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode([x.encode() for x in texts])] == want
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode([x.encode() for x in texts])] == want  # from memory


def test_long_texts_are_cut_at_white_space_only():
    text = " ".join(odd_texts()).encode()
    assert b"".join(packing.parts(text, 100)) == text and len(list(packing.parts(text, 100))) > 20
    coder = packing.Encoder(MODEL)
    assert b"".join(y for x in packing.parts(text, 100) for y in coder.encode([x])) == coder.encode([text])[0]


def least_bins(demand, capacity):
    """The optimum, by trying every assignment in order of the number of bins."""
    for k in range(1, len(demand) + 1):
        room = [list(capacity) for _ in range(k)]

        def place(i, room=room, k=k):
            if i == len(demand):
                return True
            tried = set()
            for b in range(k):
                if tuple(room[b]) not in tried and all(x >= y for x, y in zip(room[b], demand[i], strict=True)):
                    tried.add(tuple(room[b]))
                    room[b] = [x - y for x, y in zip(room[b], demand[i], strict=True)]
                    if place(i + 1):
                        return True
                    room[b] = [x + y for x, y in zip(room[b], demand[i], strict=True)]
            return False

        if place(0):
            return k
    return 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_vector_best_fit_is_close_to_the_optimum(rule):
    r, extra = random.Random(2), 0
    for _ in range(30):
        demand = [(n, 1, n * n) for n in (r.choice([r.randrange(1, 60), r.randrange(1, 15)]) for _ in range(9))]
        capacity = (64, r.choice([3, 4, 9]), r.choice([2500, 4096]))
        demand = [x for x in demand if x[2] <= capacity[2]]
        bins = packing.best_fit(np.array(demand), np.array(capacity), np.ones(3), rule)
        for b in set(bins):
            assert all(sum(x[d] for x, y in zip(demand, bins, strict=True) if y == b) <= capacity[d] for d in range(3))
        assert len(set(bins)) <= least_bins(demand, capacity) + 1
        extra += len(set(bins)) - least_bins(demand, capacity)
    assert extra <= 6 if rule == "norm" else extra <= 30
    with pytest.raises(ValueError):
        packing.best_fit(np.array([[70, 1, 4900]]), np.array([64, 9, 4900]), np.ones(3))


def test_vector_best_fit_takes_the_bin_of_least_residual_norm():
    """Step by step as in the definition, with all bins open until the end."""
    r = np.random.default_rng(1)
    n = r.integers(1, 40, 200)
    demand, capacity, weight = np.stack([n, np.ones_like(n), n * n], 1), np.array([100, 6, 4000]), np.array([1.0, 0.5, 2.0])
    got = packing.best_fit(demand, capacity, weight)
    room, want = [], {}
    for i in sorted(range(200), key=lambda i: (-(demand[i] / capacity) @ weight, *(-demand[i]), i)):
        fits = [b for b, x in enumerate(room) if (x >= demand[i]).all()]
        norm = {b: float((weight * ((room[b] - demand[i]) / capacity) ** 2).sum()) for b in fits}
        best = min(fits, key=lambda b: norm[b]) if fits else len(room)
        if not fits:
            room.append(capacity.copy())
        room[best] = room[best] - demand[i]
        want[i] = best
    size = lambda bins: sorted(sorted(n[i] for i in range(200) if bins[i] == b) for b in set(bins[i] for i in range(200)))
    assert size(got) == size(want)  # ties between bins of equal norm may go either way


def packed_rows(spark, rows, limit, group, **options):
    cut = packing.pieces(table(spark, rows), MODEL, limit=limit)
    return [r.asDict() for r in packing.pack(cut, limit=limit, group=group, **options).collect()]


@pytest.mark.parametrize(("group", "options"), [(20_000, {}), (25, {}), (25, {"most": 3, "attention": 3000}), (25, {"rule": "dot"})])
def test_packing(spark, group, options):
    r = random.Random(3)
    words = ["alpha", "Beta!", "γάμμα", "don't", "x1y2", "zz"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 9, 20, 60])))) for i in range(120)]
    rows += [(200, None), (201, ""), (None, "alpha beta"), (5, rows[5][1]), (5, rows[5][1]), (300, "word " * 700), (301, "zz " * 49), *[(400 + i, "same text") for i in range(60)]]
    limit = 50
    got = packed_rows(spark, rows, limit, group, **options)
    model = Tokenizer.from_file(MODEL)
    want = collections.Counter()
    for i, t in rows:
        ids = model.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), limit):
            x = ids[k : k + limit]
            want[(i, k // limit, k, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))] += 1
    assert collections.Counter((g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got) == want
    bins = collections.defaultdict(list)
    for g in got:
        bins[g["sequence_id"]].append((g["offset"], g["length"]))
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= limit and len(x) <= options.get("most", limit) and sum(n * n for _, n in x) <= options.get("attention", limit * limit)
    total = sum(g["length"] for g in got)
    if not options:
        assert len(bins) <= math.ceil(total / limit) + 1 + (group == 25) * 2


def test_sequences_hold_the_documents_ids(spark):
    rows = [(1, "one two three"), (2, "four five"), (3, None), (4, "six " * 30)]
    got = packing.sequences(table(spark, rows), MODEL, limit=12).collect()
    model = Tokenizer.from_file(MODEL)
    for r in got:
        assert len(r["ids"]) <= 12
    ids = collections.Counter(x for r in got for x in r["ids"])
    assert ids == collections.Counter(x for _, t in rows for x in [*model.encode(t or "", add_special_tokens=False).ids, 1])


def test_packing_of_nothing_and_of_pieces_that_never_fill(spark):
    assert packed_rows(spark, [], 50, 25) == []
    got = packed_rows(spark, [(i, "zz " * 25) for i in range(90)], 50, 25)  # 26 of 50 each: no two fit
    assert len({g["sequence_id"] for g in got}) == 90
    with pytest.raises(ValueError):
        packing.pack(None, rule="first")


# --- ranked search -------------------------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k=10):
    bags = [(i, plain_terms(t)) for i, t in docs]
    bags = [(i, w, collections.Counter(w)) for i, w in bags if w]
    n_docs, length = len(bags), sum(len(w) for _, w, _ in bags)
    df = collections.Counter(t for _, _, c in bags for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, w, c in bags:
            m = 25 + (75 * len(w) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in plain_terms(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def search_sample():
    r = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["Ünder", "ßs", "x-y", "A1"]
    text = lambda n: " ".join(words[int(len(words) * r.random() ** 3)] for _ in range(n))
    docs = [(i, text(r.choice([1, 5, 30, 80]))) for i in range(150)]
    docs += [(200 + i, docs[3][1]) for i in range(30)] + [(300, None), (301, ""), (302, "?!"), (None, docs[4][1]), (None, "w1 w1"), docs[6], docs[6], (303, "w2 " * 4000)]
    items = [(i, text(r.choice([1, 3, 12]))) for i in range(12)] + [(50, docs[3][1]), (51, None), (52, "..."), (53, "nowhere"), (54, "w1 w1 w1 w2"), (54, "w5"), (None, "w3"), (1, None)]
    return docs, [*items, items[0]]


@pytest.mark.parametrize(("shard", "query_bytes"), [(8192, 1 << 22), (16, 1 << 22), (16, 60)])
def test_ranked_search(spark, monkeypatch, shard, query_bytes):
    docs, items = search_sample()
    monkeypatch.setattr(ranked, "SHARD", shard)
    run = ranked._shards  # the tasks see the setting as it is when the plan is made

    def with_setting(shared):
        inner = run(shared)

        def go(batches, shard=shard):
            from mnemospark.llm import ranked as module

            module.SHARD = shard
            return inner(batches)

        return go

    monkeypatch.setattr(ranked, "_shards", with_setting)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = ranked.search(table(spark, docs).repartition(3), asked, query_bytes=query_bytes).collect()
    assert sorted(map(tuple, got), key=str) == brute_search(docs, items)


def test_ranked_search_of_empty_tables(spark):
    docs, items = search_sample()
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert ranked.search(table(spark, []), asked).count() == 0
    assert ranked.search(table(spark, docs), asked.limit(0)).count() == 0
    assert ranked.search(table(spark, [(1, "?")]), asked).count() == 0


def lists_of(docs, queries):
    shard = ranked._Shard(None)
    for i, t in docs:
        shard.add(i, t.encode())
    row = ranked._arrays(shard.batch(), 0)
    bags = [plain_terms(t) for _, t in docs]
    names = sorted({t for q in queries for t in q})
    df = [sum(t in w for w in bags) for t in names]
    weight = np.array([math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * d + 1))) for d in df], np.int64)
    number = {w: i for i, w in enumerate(x.encode() for x in names)}
    return ranked.Lists(row, ranked.Queries([], number, weight, [], [], len(bags), sum(map(len, bags)))), row, weight, number


def test_range_maxima_are_right():
    r = random.Random(1)
    docs = [(i, " ".join(r.choice("abcdef") for _ in range(r.randrange(1, 30)))) for i in range(100)]
    lists, _, _, _ = lists_of(docs, ["abcdef"])
    for k in range(6):
        for _ in range(100):
            a, b = sorted(r.sample(range(lists.start[k], lists.end[k] + 1), 2))
            place, value = lists.maxima(np.array([a]), np.array([b]))
            assert value[0] == lists.impact[a:b].max() and lists.impact[place[0]] == value[0] and place[0] == a + lists.impact[a:b].argmax()


def test_best_first_scores_few_documents():
    """A query whose rare term is in few documents scores these and little else."""
    r = random.Random(1)
    docs = [(i, " ".join(r.choice("abcdef") for _ in range(20)) + (" rare" if i % 100 == 0 else "")) for i in range(4000)]
    lists, row, weight, number = lists_of(docs, [["a", "rare"]])
    top = ranked.Top(10)
    used = [b"a", b"rare"]
    scored = ranked.best_first(lists, row["ids"], np.array([lists.at[number[x]] for x in used]), weight[[number[x] for x in used]], top)
    assert len(top.doc) == 10 and all(d % 100 == 0 for d in top.doc) and scored < 400


# --- filter audit --------------------------------------------------------------------------------------------------


def brute_audit(docs, labels):
    tests = []
    for i, t, part in docs:
        t = t or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        fails = ("A" if len(w) < 50 else "") + ("B" if 100 * len(set(w)) < 65 * len(w) else "") + ("C" if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else "")
        fails += ("D" if re.search("[#$%&*|]", t) else "") + ("E" if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs) else "")
        tests.append((part or "", fails, any(j == i is not None and q == 1 for j, q, _ in labels), any(j == i is not None and x == 1 for j, _, x in labels)))
    out = {}
    for part in {p for p, *_ in tests}:
        share = collections.Counter()
        rows = []
        for order in itertools.permutations("ABCDE"):
            left = [x for x in tests if x[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                here = [x for x in left if f in x[1]]
                redundant = sum(f in x[1] for x in gone)
                left, gone = [x for x in left if f not in x[1]], gone + here
                share[f] += len(here)
                alone = sum(x[0] == part and x[1] == f for x in tests)
                rows.append(("".join(order), step, f, len(left), len(here), redundant, alone, sum(x[2] for x in here), sum(x[3] for x in here)))
        for order, step, f, *counts in rows:
            out[(part, order, step)] = (*counts, share[f])
    return out


def test_filter_audit(spark):
    r = random.Random(4)
    word = lambda: r.choice(["foo", "bar", "BAZ", "Qux", "é", "a#b", "z|"]) + str(r.randrange(40))
    docs = [(i, " ".join(word() for _ in range(r.choice([0, 3, 49, 50, 60, 200]))), r.choice(["s1", "s2", "", None])) for i in range(60)]
    docs += [(100, None, "s1"), (101, "", None), (None, docs[3][1], "s2"), (None, None, None), (102, docs[3][1], "s1"), (1, docs[3][1], "s1"), docs[3], docs[3], (103, "plain words here " * 2000, "s3"), (104, " ".join(f"x{i}" for i in range(70)), "only clean")]
    labels = [(i, r.randrange(2), r.randrange(2)) for i in range(0, 100, 2)] + [(4, None, 1), (4, 1, None), (None, 1, 1), (103, 1, 1), (999, 1, 1)]
    df = spark.createDataFrame([(*x, "m", "n") for x in docs], "doc_id long, text string, source string, mask string, n string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.interactions(audit.masks(df, known), "ABCDE").collect()
    want = brute_audit(docs, labels)
    assert len(got) == len(want) == 600 * 5
    for x in got:
        assert tuple(x)[3:] == want[(x["part"], x["filter_order"], x["step"])]


def test_filter_audit_of_empty_tables_and_other_filters(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (2, "A", "s"), (3, "a b", "s")], "doc_id long, text string, source string")
    known = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(audit.masks(df.limit(0), known), "ABCDE").count() == 0
    cells = audit.masks(df, known, rules=lambda t: {"U": t.rlike("[A-Z]")})
    assert sorted(map(tuple, cells.collect())) == [("s", 0, 1, 0, 0), ("s", 1, 1, 0, 0), ("s", 2, 1, 0, 0)]
    got = {(x["filter_order"], x["step"]): (x["kept"], x["removed"], x["shapley"]) for x in audit.interactions(cells, "UX").collect()}
    assert got == {("UX", 1): (2, 1, 2), ("UX", 2): (1, 1, 2), ("XU", 1): (2, 1, 2), ("XU", 2): (1, 1, 2)}
    with pytest.raises(ValueError):
        audit.interactions(cells.where(F.lit(False)), "")
