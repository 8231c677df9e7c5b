"""The ten operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import io
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import decontaminate, jaccard, language, lines, media, pieces, repeats, resampling, substrings, suffixes, toxicity
from mnemospark.llm.common import keyed

SCHEMA = "doc_id long, text string, lang string, tkey string"  # tkey: a column that clashes with an internal name


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", "x") for i, t in rows], schema)


def sample(seed=0, n=40):
    """Documents that share passages, with copies, near copies, nulls, empty, periodic and long texts, and repeated rows."""
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "δelta", "e", "zeta!", "eta", "theta"]
    passage = " ".join(r.choice(words) for _ in range(60))
    rows = []
    for i in range(n):
        own = " ".join(r.choice(words) + str(r.randrange(50)) for _ in range(r.randrange(5, 120)))
        rows.append((i, own if i % 3 else f"{own[: r.randrange(len(own))]} {passage}\n{own}"))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, rows[6][1] + " tail"), (103, None), (104, ""), (105, " \n\t "), (106, "ha " * 150), (107, "a" * 500), (108, "same line\n" * 3), (None, rows[4][1]), (109, "x" * 3000 + passage)]
    rows += [rows[2], rows[2], (103, None)]
    return rows


def ordered(rows):
    """Distinct documents in the operators' order: null doc_id first. Keys of different texts with one doc_id don't occur here."""
    return sorted({(i, t or "") for i, t in rows}, key=lambda x: (x[0] is not None, x[0] or 0))


def brute_spans(docs, length):
    """Flags of the symbols that an earlier window covers, for sequences in order."""
    seen, out = {}, []
    for k, seq in enumerate(docs):
        gone = [False] * len(seq)
        for i in range(len(seq) - length + 1):
            w = tuple(seq[i : i + length])
            if w in seen:
                gone[i : i + length] = [True] * length
            else:
                seen[w] = (k, i)
        out.append(gone)
    return out


@pytest.mark.parametrize(("block", "hot"), [(3000, 20000), (4, 3)])
def test_substring_dedup(spark, block, hot):
    rows = sample()
    docs = ordered(rows)
    split = [re.findall(r"[^\x20\x09-\x0D]+", t) for _, t in docs]
    want = {d: (len(w), sum(g), " ".join(x for x, y in zip(w, g, strict=True) if not y)) for (d, _), w, g in zip(docs, split, brute_spans(split, 20), strict=True)}
    base = keyed(table(spark, rows))
    spans = substrings.repeated_words(base, 20, block, hot)
    got = substrings.map_met(base, spans, substrings._kept, "doc_id long, tkey long, n_words long, n_removed long, text string").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["n_removed"], r["text"]) == want[r["doc_id"]], r["doc_id"]


@pytest.mark.parametrize(("block", "hot"), [(8000, 50000), (4, 3)])
def test_suffix_array_dedup(spark, block, hot):
    rows = sample(1)
    docs = ordered(rows)
    flags = brute_spans([t.encode() for _, t in docs], 100)
    want = {}
    for (d, t), g in zip(docs, flags, strict=True):
        b = t.encode()
        want[d] = (len(b), sum(g), sum(k for k, _ in itertools.groupby(g)), bytes(x for x, y in zip(b, g, strict=True) if not y))
    base = keyed(table(spark, rows))
    spans = suffixes.repeated_bytes(base, 100, block, hot)
    got = suffixes.map_met(base, spans, suffixes._kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[r["doc_id"]], r["doc_id"]


@pytest.mark.parametrize("most", [0, 1, 3])
def test_more_hot_anchors_than_are_broadcast(spark, monkeypatch, most):
    """Beyond MAX_HOT anchors the others' salts are joined; shards stay as small, and rows are the same."""
    monkeypatch.setattr(repeats, "MAX_HOT", max(most, 1) if most else 1)
    rows = [*sample(), *((500 + i, sample()[3][1]) for i in range(25))]
    docs = ordered(rows)
    split = [re.findall(r"[^\x20\x09-\x0D]+", t) for _, t in docs]
    want = {d: sum(g) for (d, _), g in zip(docs, brute_spans(split, 20), strict=True)}
    base = keyed(table(spark, rows))
    dealt = []
    kept = repeats._dealt
    monkeypatch.setattr(repeats, "_dealt", lambda found, hot, n: dealt.append(hot.count()) or kept(found, hot, n))
    spans = substrings.repeated_words(base, 20, 4, 3)
    got = substrings.map_met(base, spans, substrings._kept, "doc_id long, tkey long, n_words long, n_removed long, text string").collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == want and dealt and dealt[0] > 0


def test_a_shard_of_very_many_distinct_words():
    """More distinct words than there are code points."""
    n = 40_000
    segs = [" ".join(f"w{30 * i + k}" for k in range(30)).encode() for i in range(n)] + [b"x " + b" ".join(b"w%d" % k for k in range(25)), b"y z"]
    texts, width = substrings._letters(segs)
    assert width == 2 and len(set("".join(texts))) < 1_114_112
    flags, window = substrings.phrase_automaton(20)(segs)
    assert [len(x) for x in flags[-2:]] == [7, 0] and flags[-2].tolist() == [False] + [True] * 6 and not any(x.any() for x in flags[:n])
    assert window(n, 1) == b" ".join(b"w%d" % k for k in range(20))


@pytest.mark.parametrize("most", [4, 6, 10, 1000])
def test_automata_with_one_and_two_letters_a_word(most):
    r = random.Random(7)
    segs = [b" ".join(b"v%d" % r.randrange(6) for _ in range(r.randrange(1, 40))) for _ in range(60)]
    want = brute_spans([x.split() for x in segs], 3)
    flags, _ = substrings.phrase_automaton(3, most)(segs)
    for x, f, w in zip(segs, flags, want, strict=True):
        n, gone = len(x.split()), [False] * len(x.split())
        for i in np.flatnonzero(f).tolist():
            gone[i : i + 3] = [True] * 3
        assert gone == w and len(f) == max(0, n - 2)


def test_long_unlike_words_have_unlike_hashes(spark):
    """Words in the order of Thue and Morse and their complements: sums of powers modulo 2**64 can't tell them apart."""
    from mnemospark.llm.common import byte_class, hash_words

    for n in (64, 256, 1024, 4096):
        word = "".join("ab"[i.bit_count() % 2] for i in range(n))
        other = word.translate(str.maketrans("ab", "ba"))
        data = np.frombuffer(f"{word} {other} {word.upper()}".encode(), np.uint8)
        h = hash_words(data, byte_class("space"), lower=True)[0]
        assert h[0] == h[2] != h[1]
    rows = [(1, word), (2, other), (3, word.upper())]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(table(spark, rows), k=3, percent=90).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_media_without_samples_and_of_16_bits(spark):
    files = [b"P5\n0 3\n255\n", b"P5\n3 0\n255\n", b"P6\n0 0\n255\n", b"BM" + bytes(200), b"P5\n2 2\n0\n" + bytes(4), b"P5\n9 9\n255\nshort", b"P5\n2 2\n65535\n" + (300).to_bytes(2, "big") * 4, b"P2\n2 1\n15\n15 0\n", None, b""]
    df = spark.createDataFrame([(i, bytearray(x) if x is not None else None, "x") for i, x in enumerate(files)], "doc_id long, media binary, error string")
    got = {r["doc_id"]: r for r in media.media_features(df).collect()}
    assert all(got[i]["error"] for i in (0, 1, 2, 3, 4, 5, 9)) and got[8]["error"] is None and got[8]["feature"] is None
    tile = lambda i: np.load(io.BytesIO(got[i]["tile_npy"]))
    assert (tile(6) == 1).all() and tile(7)[0, 0] == 255 and tile(7)[0, -1] == 0


def test_longest_previous_factor():
    r = random.Random(2)
    for text in [b"", b"a", b"aaaa", b"abracadabra", *(bytes(r.choice(b"ab") for _ in range(60)) for _ in range(20))]:
        want = [max([0, *(next((k for k in range(len(text) - i + 1) if k == len(text) - i or text[i + k] != text[j + k]), 0) for j in range(i))]) for i in range(len(text))]
        assert suffixes.longest_previous_factor(text).tolist() == want
        flags, _ = suffixes.previous_factors(8)([text])
        assert flags[0].tolist() == [x >= 8 for x in want[: max(0, len(text) - 7)]]


def test_blocks_are_flagged_from_lpf():
    r = random.Random(3)
    for length in (1, 5, 8, 20, 100):
        segs = [bytes(r.choice(b"ab") for _ in range(r.randrange(0, 30))) * r.randrange(1, 9) for _ in range(12)]
        segs += [segs[0], b"", b"a" * 150, segs[3][:9] + segs[4]]
        windows = [x[i : i + length] for x in segs for i in range(len(x) - length + 1)]
        same = lambda a, b: next((k for k in range(length) if a[k] != b[k]), length)
        want = [max([0, *(same(w, x) for x in windows[:i])]) for i, w in enumerate(windows[:150])]
        start = np.cumsum([0, *map(len, segs)])
        at = np.concatenate([np.arange(a, b - length + 1) for a, b in itertools.pairwise(start.tolist())])
        text = b"".join(segs) + bytes(8)
        words = np.ndarray((len(text) - 8,), ">u8", text, strides=(1,)) if length >= 8 else np.frombuffer(text, np.uint8)
        got = suffixes.capped_lpf(*suffixes.suffix_order(words, at, length))
        assert got[:150].tolist() == want
        flags, _ = suffixes.previous_factors(length)(segs)
        assert np.concatenate(flags).tolist() == (got >= length).tolist()


def test_segments_cover_each_window_once():
    unit = repeats.Bytes(20)
    texts = [b"", b"ab" * 60, b"", bytes(range(32, 120)), b"short", b"z" * 50]
    seen = set()
    for row, _, _, lo, n in repeats.segments(unit, texts, True):
        for r, a, k in zip(row.tolist(), lo.tolist(), n.tolist(), strict=True):
            for i in range(a, a + k - 19):
                assert (r, i) not in seen
                seen.add((r, i))
    assert seen == {(r, i) for r, t in enumerate(texts) for i in range(len(t) - 19)}


def brute_components(rows, k, percent):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))

    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 90, 2_000_000), (5, 80, 2_000_000), (3, 80, 60)])
def test_jaccard_join(spark, k, percent, block):
    r = random.Random(3)
    rows = sample(4, 20)
    base = [r.choice("abcdefghij") + str(r.randrange(30)) for _ in range(80)]
    for i in range(25):  # near copies in a chain of small edits
        base[r.randrange(len(base))] = f"new{i}"
        rows.append((200 + i, " ".join(base)))
    rows += [(300, "One two"), (301, "one TWO"), (302, "one")]
    got = sorted((tuple(x) for x in jaccard.near_duplicates(table(spark, rows), k, percent, block).collect()), key=str)
    assert got == brute_components(rows, k, percent)


def test_trie_links():
    r = np.random.default_rng(0)
    for _ in range(60):
        base = r.integers(0, 60, r.integers(1, 40))
        sets = {tuple(sorted({*base.tolist()[: r.integers(1, 41)], *r.integers(0, 80, r.integers(0, 4)).tolist()})) for _ in range(15)}
        sets = [np.array(x, np.uint64) for x in sets]
        links = jaccard.trie_links(sets, 80)

        def groups(pairs, n=len(sets)):
            up = list(range(n))
            for i, j in pairs:
                a, b = up[i], up[j]
                up = [b if x == a else x for x in up]
            return {frozenset(i for i in range(n) if up[i] == c) for c in up}

        all_pairs = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        assert groups(links) == groups(all_pairs)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_line_dedup(spark, limit):
    rows = [(i, f"Header LINE \nown {i}\n\n footer") for i in range(12)] + [(20, None), (21, ""), (22, "header line"), (23, "own 3\r\nx")]
    base = keyed(table(spark, rows))
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in lines.drop_lines(base, lines.hot_lines(base, 10), max_broadcast=limit).collect()}
    assert got[3] == (4, 2, "own 3\n") and got[20] == got[21] == (1, 0, "") and got[22] == (1, 1, "") and got[23] == (2, 0, "own 3\r\nx")
    out = lines.dedup_lines(table(spark, rows)).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"doc_id", "text", "lang", "tkey"}


def test_lines_count_doc_ids_and_batches_meet_the_runs(spark, monkeypatch):
    rows = [(1, "mine\nshared")] * 12 + [(1, f"mine\nversion {k}") for k in range(12)] + [(None, f"mine\n{k}") for k in range(12)] + [(i, f"shared\nown {i}") for i in range(2, 11)]
    met = []
    unseen = lines.SortedRuns.unseen
    monkeypatch.setattr(lines.SortedRuns, "unseen", lambda self, x: met.append(sum(map(len, self.levels))) or unseen(self, x))
    hot = {r["h"] for r in lines.hot_lines(keyed(table(spark, rows)), 10).collect()}
    assert hot == {hashlib.md5(b"shared").hexdigest()}
    assert met == [1, 2, 3]
    runs = lines.SortedRuns(spark, fanout=2)
    for k in range(5):
        runs.meet(spark.createDataFrame([("a", 1), ("b" if k % 2 else "c", 2), (f"d{k}", 3)], "h string, n long"))
    assert {r["h"]: r["n"] for r in runs.counts().collect()} == {"a": 5, "b": 4, "c": 6} | {f"d{k}": 3 for k in range(5)}
    rows = [r for level in runs.levels for run in level for r in run.table.collect()]
    assert len(rows) == len({r["h"] for r in rows}) == 8


def test_a_batch_meets_a_run_without_shuffling_it(spark):
    runs = lines.SortedRuns(spark, fanout=4, buckets=8)
    rows = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("h"), F.lit(1).cast("long").alias("n"))
    runs.meet(rows.where("n > 0"))
    runs.meet(rows.limit(500))
    plan = runs.unseen(rows)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "Bucketed: true" in x]
    assert len(scans) == sum(map(len, runs.levels)) and all("8 out of 8" in x for x in scans)
    assert plan.count("Exchange hashpartitioning(h") == 1  # the batch's own


def test_sorted_runs_compact_and_anti_join(spark):
    runs = lines.SortedRuns(spark, fanout=2)
    kept = []
    for k in range(4):
        batch = table(spark, [(k * 10 + i, f"common\nline {k}-{i}\nline {k - 1}-{i}") for i in range(3)])
        kept += [r["line"] for r in lines.dedup_batch(batch, runs).collect()]
    assert sorted(kept) == sorted({"common", *(f"line {k}-{i}" for k in range(-1, 4) for i in range(3))})
    assert [len(x) for x in runs.levels] == [0, 0, 1]


def brute_leaks(text, items, n):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for i, t in items:
        own = words(t)
        m = min(n, len(own))
        windows = {tuple(own[a : a + m]) for a in range(len(own) - m + 1)} if m else set()
        for a in range(len(w) - m + 1 if m else 0):
            if tuple(w[a : a + m]) in windows:
                hit |= set(range(a, a + m))
                found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontamination(spark, block):
    items = [(1, "The Quick brown-fox jumps over the lazy dog while it rains in spain again"), (2, "Tiny item"), (10, "ünïcode wörds"), (3, None), (4, "..."), (None, "none")]
    long = "the quick brown fox jumps over the lazy dog while it rains in spain again"
    rows = [(0, f"x {long} y"), (1, "nothing here"), (2, None), (3, ""), (4, "a TINY item, tiny"), (5, f"{long} {long}"), (6, "item tiny"), (7, "ünïcode  wörds")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(decontaminate.find_leaks(keyed(table(spark, rows)), bench, 10, block)).collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, ids = brute_leaks(rows[r["doc_id"]][1], items, 10)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(ids), hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(ids).encode()).hexdigest()
    kept = {r["doc_id"] for r in decontaminate.decontaminate(table(spark, rows), bench).collect()}
    assert kept == {1, 2, 3, 6}
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(table(spark, rows), bench, remove="spans").collect()}
    assert cut[0] == "x  y" and cut[1] == "nothing here" and len(cut) == len(rows)


def test_media(spark):
    rows = sample(5)
    for r in media.text_media(table(spark, rows)).collect():
        text = dict(rows)[r["doc_id"]]
        data = (text or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        stored = media.encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())


def test_image_formats_and_resize(spark):
    rng = np.random.default_rng(0)
    grey = rng.integers(0, 256, (7, 13), dtype=np.uint8)
    for form in (media.encode_pgm, media.encode_bmp):
        assert (media.decode(form(grey)) == grey).all()
    assert (media.decode(b"P2\n# c\n3 1\n255\n1 2 255\n") == [[1, 2, 255]]).all()
    assert media.decode(b"P6\n1 1\n255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode(b"P1\n3 1\n101\n").tolist() == [[0, 255, 0]]
    for rows, cols in ((3, 4), (7, 13), (8, 9), (1, 1)):
        fine = np.kron(grey, np.ones((rows, cols)))  # each cell of the grid is a whole number of these
        want = fine.reshape(rows, 7, cols, 13).mean((1, 3))
        for strip in (1 << 16, 2):
            assert np.allclose(media.area_resize(grey, rows, cols, strip), want)
    df = spark.createDataFrame([(1, bytearray(media.encode_bmp(grey))), (2, bytearray(b"no")), (3, None)], "doc_id long, media binary")
    out = {r["doc_id"]: r for r in media.media_features(df).collect()}
    assert out[1]["dhash"] and out[2]["error"] and out[3]["error"] is None


def test_sentencepiece(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rows = [*sample(6), (400, "  a  b\tc\n"), (401, "日本語 😀😀 ﬁ"), (402, "▁x a▁b"), (403, "\x00a\r\n"), (404, "y" * 300), (405, " ")]
    for r in pieces.encode_checked(table(spark, rows)).collect():
        text = dict(rows)[r["doc_id"]]
        assert r["ids"] == sp.encode(text or "") and r["round_trip"]
    enc = pieces.encode_checked(table(spark, [(1, "hello wörld")]))
    assert pieces.decode(enc).first()["text"] == "hello wörld"


def test_viterbi_finds_the_best_path():
    vocab = {"▁a": -1.0, "b": -2.5, "ab": -2.0, "▁": -3.0, "a": -2.2, "▁ab": -3.6, "bb": -2.1, "abb": -9.0}
    model = pieces.Pieces(list(vocab), list(vocab.values()), [True] * len(vocab), -1, 0)
    assert model.algorithm == "viterbi"

    def best(word):
        if not word:
            return 0.0, ()
        return max((vocab.get(word[:k], model.floor if k == 1 else -np.inf) + best(word[k:])[0], (word[:k], *best(word[k:])[1])) for k in range(1, len(word) + 1))

    for word in ("▁ab", "▁abb", "▁abab", "▁bbb", "▁aab"):
        ends = model.best_paths(np.array([[ord(c) for c in word]], np.uint64))[0]
        got = [word[s:e] for s, e in enumerate(ends.tolist()) if e]
        assert abs(sum(vocab.get(p, model.floor) for p in got) - best(word)[0]) < 1e-9


def language_rows(n=240):
    r = random.Random(7)
    syllables = {"en": ["the", "ing", "and", "wh", "sh"], "de": ["sch", "ung", "ein", "ü", "ß"], "fr": ["eau", "é", "que", "oi", "ç"]}
    return [(i, " ".join("".join(r.choices(syllables[lang], k=3)) for _ in range(r.randrange(3, 40))), lang) for i, lang in ((i, r.choice(list(syllables))) for i in range(n))]


def test_language_id(spark):
    rows = [*((i, t, lang, "x") for i, t, lang in language_rows()), (900, None, "en", "x"), (901, "123 !?", "en", "x"), (902, "", None, "x"), (903, "ü", None, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language.train(language.learnable(docs), 50)
    base = docs.select("doc_id", F.lit(0).cast("long").alias("tkey"), "text")
    got = {r["doc_id"]: r for r in language.predict(base, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902)) and got[903]["lang_pred"] == "de"
    held = [(i, lang) for i, _, lang in language_rows() if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in held]) > 0.97
    empty = language.predict(base, language.train(docs.limit(0)))
    assert {r["lang_pred"] for r in empty.collect()} == {"und"}
    assert language.keep_identified(docs, 0.5, 50).columns == docs.columns


def test_toxicity(spark):
    r = random.Random(8)
    syl = ["tha", "ner", "ing", "ou", "sel", "mo", "ri"]
    word = lambda: "".join(r.choices(syl, k=r.randrange(1, 4)))
    rows, labels = [], []
    for i in range(500):
        w = [word() for _ in range(r.randrange(5, 60))]
        bad = i % 5 == 0
        if bad:
            w[r.randrange(len(w))] = r.choice(["worthless", "Idiot!", "clown"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1 if bad else 0))
    extra = [(1000, None), (1001, ""), (1002, "you i.d.i.o.t"), (1003, "w o r t h l e s s you"), (1004, "a clownn here"), (1005, "x" * 5000)]
    docs = table(spark, rows + extra).withColumn("held_out", F.lit(False))
    known = spark.createDataFrame([x for x in labels if zlib.crc32(str(x[0]).encode()) % 5], "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.score(docs, toxicity.train(docs, known)).collect()}
    assert len(got) == len(rows) + len(extra)
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == y for i, y in held]) > 0.95
    assert [got[i]["predicted"] for i in (1000, 1001, 1002, 1003, 1004, 1005)] == [0, 0, 1, 1, 1, 0]
    none = toxicity.train(docs, known.limit(0))
    assert all(0 <= x["score"] <= 1 for x in toxicity.score(docs, none).collect())


def test_subsequence_kernel():
    def brute(s, t):
        total = 0.0
        for a in itertools.combinations(range(len(s)), toxicity.ORDER):
            for b in itertools.combinations(range(len(t)), toxicity.ORDER):
                if all(s[i] == t[j] for i, j in zip(a, b, strict=True)):
                    total += toxicity.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
        return total

    words = ["idiot", "idxiot", "clown", "toidi", "abc", "ab"]
    k = toxicity.kernel(toxicity.encode(words), toxicity.encode(words))
    assert np.allclose(k, [[brute(a, b) for b in words] for a in words], rtol=1e-4)
    assert np.allclose(toxicity.own_kernel(toxicity.encode(words)), [brute(a, a) for a in words], rtol=1e-4)


def test_resampling(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choices(["good", "fine", "word"] if i % 2 else ["bad", "junk", "spam"], k=20))) for i in range(200)] + [(500, None), (501, "")]
    target = spark.createDataFrame([(i,) for i in range(1, 100, 2)], "doc_id long")
    out = resampling.resample(table(spark, rows), target, share=0.3).collect()
    chosen = [x for x in out if x["selected"]]
    assert len(out) == 202 and len(chosen) == 60
    assert min(x["gumbel_key"] for x in chosen) >= max(x["gumbel_key"] for x in out if not x["selected"])
    assert np.mean([x["doc_id"] % 2 for x in chosen]) > 0.95
    values = spark.createDataFrame([(r.randrange(-1000, 1000),) for _ in range(500)], "v long")
    order = sorted((x["v"] for x in values.collect()), reverse=True)
    assert [resampling.kth_largest(values, k, 7) for k in (1, 10, 250, 500)] == [order[k - 1] for k in (1, 10, 250, 500)]


def test_empty_tables(spark):
    docs = table(spark, [(1, "x")]).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    base = keyed(docs)
    assert jaccard.near_duplicates(docs).count() == 0
    assert substrings.dedup_words(base).count() == suffixes.dedup_bytes(base).count() == 0
    assert lines.dedup_lines(docs).count() == decontaminate.decontaminate(docs, bench).count() == 0
    assert media.text_media(docs).count() == pieces.encode_checked(docs).count() == language.keep_identified(docs).count() == 0
    assert resampling.resample(docs, bench.select(F.col("item_id").alias("doc_id"))).count() == 0
    full = table(spark, [(1, "x"), (2, None)])
    assert decontaminate.decontaminate(full, bench).count() == 2


def plain_margin(model, token):
    """The machine's margin of a token, by the kernel's definition."""

    def k(s, t):
        total = 0.0
        for a in itertools.combinations(range(len(s)), toxicity.ORDER):
            for b in itertools.combinations(range(len(t)), toxicity.ORDER):
                if all(s[i] == t[j] for i, j in zip(a, b, strict=True)):
                    total += toxicity.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
        return total

    w = "<" + "".join(c for c in token.lower() if c.isalpha()) + ">"
    if len(w) < toxicity.ORDER + 2:
        return model.bias
    return sum(v * k(w, m) / np.sqrt(k(w, w) * k(m, m)) for m, v in zip(model.landmarks, model.weights, strict=True)) + model.bias


def test_toxicity_scores_follow_from_the_plain_kernel(spark):
    r = random.Random(18)
    bad = ["idiot", "clown", "worthless"]
    word = lambda: "".join(r.choices(["tha", "ner", "ing", "ou"], k=r.randrange(1, 4)))
    rows = [(i, " ".join(r.sample([word() for _ in range(12)] + r.choices(bad, k=2) * (i % 4 == 0), k=12))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "i d i o t !"), (203, "idxiot id.iot"), rows[4], rows[4]]
    docs = table(spark, rows).withColumn("held_out", F.lit(True))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)] + [(4, 0), (None, 1), (7, 5)], "doc_id long, toxic int")
    model, again = (toxicity.train(docs, labels) for _ in range(2))
    assert model.landmarks == again.landmarks and np.allclose(model.weights, again.weights) and np.allclose(model.document, again.document)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for x in got:
        low = (text[x["doc_id"]] or "").lower()
        words = low.split() + (["idiot"] if x["doc_id"] == 202 else [])
        margins = sorted((plain_margin(model, w) for w in words), reverse=True)
        first, second = ([*margins, model.bias, model.bias])[:2]
        share = np.log((sum(m > 0 for m in margins) + 0.5) / (len(words) + 20))
        z = model.document @ [1, first if words else model.bias, second if words else model.bias, share]
        assert abs(x["score"] - 1 / (1 + np.exp(-z))) < 1e-3 and x["predicted"] == (x["score"] >= 0.5)
    score = {x["doc_id"]: x["score"] for x in got}
    assert score[203] > 0.5 > score[200] == score[201]
    none = spark.createDataFrame([], "doc_id long, text string, held_out boolean")
    assert toxicity.score(none, model).count() == 0 and toxicity.train(none, labels).landmarks == []


def test_signatures_join_similar_sets_and_few_others():
    r = np.random.default_rng(5)
    sets = [np.sort(r.integers(0, 1 << 64, int(n), dtype=np.uint64)) for n in r.integers(4, 13, 20_000)]
    rows, sigs = jaccard.signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), 80)
    assert np.unique(sigs, return_counts=True)[1].max() <= 3  # unrelated sets
    for percent in (80, 90):
        for _ in range(300):
            n = int(r.integers(4, 400))
            a = r.integers(0, 1 << 64, n, dtype=np.uint64)
            both = np.concatenate([a[r.integers(0, n * (100 - percent) // 100 + 1) :], r.integers(0, 1 << 64, int(r.integers(0, n * (100 - percent) // 100 + 1)), dtype=np.uint64)])
            x, y = np.sort(a), np.sort(both)
            same = len(np.intersect1d(x, y))
            if len(x) == len(y) == same or 100 * same < percent * (len(x) + len(y) - same):
                continue
            rows, sigs = jaccard.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), percent)
            assert set(sigs[rows == 0].tolist()) & set(sigs[rows == 1].tolist())


def test_keep_one_tells_texts_of_one_doc_id_apart(spark):
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (7, a + " end"), (3, b), (5, b + " end"), (None, a), (3, b), (8, None), (9, "")]
    kept = sorted(((x["doc_id"], x["text"]) for x in jaccard.keep_one(table(spark, rows)).collect()), key=str)
    assert kept == sorted([(5, a), (3, b), (3, b), (8, None), (9, "")], key=str)
    for block in (50, 400):  # clusters for several tasks
        many = [(i, " ".join(f"w{j}" if j != i else f"x{i}" for j in range(120))) for i in range(30)] + rows
        kept = {x["doc_id"] for x in jaccard.keep_one(table(spark, many), block=block).collect()}
        assert kept == {0, 3, 5, 8, 9}


CLASH = "doc_id long, text string, tkey string, _k string, _doc string, _text string, _hits string, _h string"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e", "f") for i, t in rows], CLASH)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_names_of_other_columns_dont_matter(spark, limit):
    item = "one two three four five six seven eight nine ten"
    rows = [(i, f"header\nown {i}") for i in range(11)] + [(20, f"x {item} y"), (None, f"z {item}"), (21, None), (20, f"x {item} y")]
    docs = clashing(spark, rows)
    others = lambda df: {tuple(r)[2:] for r in df.collect()}
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for out, n in (
        (lines.dedup_lines(docs, max_broadcast=limit), len(rows)), (decontaminate.decontaminate(docs, bench, max_bytes=limit), len(rows) - 3),
        (decontaminate.decontaminate(docs, bench, remove="spans", max_bytes=limit), len(rows)),
    ):
        assert out.columns == docs.columns and out.count() == n and others(out) == {tuple("abcdef")}
    cut = decontaminate.decontaminate(docs, bench, remove="spans", max_bytes=limit).collect()
    assert sorted(r["text"] for r in cut if r["doc_id"] == 20) == ["x  y", "x  y"] and [r["text"] for r in cut if r["doc_id"] == 21] == [None]


def test_leaks_are_equal_however_large_the_benchmark_is(spark):
    r = random.Random(11)
    word = lambda: r.choice(["Alpha", "beta", "ü", "d4", "e-f", "gamma"])
    items = [(i if i % 5 else None, " ".join(word() for _ in range(r.randrange(1, 14)))) for i in range(30)] + [(50, None), (51, "..."), (52, "")]
    rows = [(i, " ".join(word() for _ in range(r.randrange(0, 60)))) for i in range(30)] + [(40, None), (41, ""), (None, "alpha beta"), (3, "alpha"), (7, "beta")]
    rows += [rows[5], rows[5], (60, "x " * 3000 + items[1][1])]
    bench, base = spark.createDataFrame(items, "item_id long, text string"), keyed(table(spark, rows))
    key = lambda x: (x["doc_id"] is not None, x["doc_id"] or 0, x["tkey"], x["n_words"])
    small, large = (sorted(decontaminate.find_leaks(base, bench, 10, b).collect(), key=key) for b in (1 << 20, 0))
    spans = lambda x: sorted({(h["s"], h["e"]) for h in x["hits"]})
    assert [(*key(x), spans(x), x["items"]) for x in small] == [(*key(x), spans(x), x["items"]) for x in large]
    assert len(small) == len(rows)
    texts = {(i, t or "") for i, t in rows}
    for x in small:
        want = [t for i, t in texts if i == x["doc_id"] and brute_leaks(t, items, 10)[0] == x["n_words"]]
        assert any(brute_leaks(t, items, 10)[1] == decontaminate.covered(x["hits"]) for t in want)
    assert any(None in x["items"] for x in small)


def test_windows_that_many_items_and_documents_share(spark):
    shared = " ".join(f"s{i}" for i in range(14))
    items = [(i, f"{shared} own{i}") for i in range(30)] + [(i, f"only {i} " + " ".join(f"w{i}x{k}" for k in range(12))) for i in range(30, 34)]
    rows = [(i, f"a{i} {shared} {shared} b{i}") for i in range(40)] + [(50, items[31][1]), (51, None)]
    test = spark.createDataFrame(items, "item_id long, text string")
    got = [sorted(map(str, decontaminate.report(decontaminate.find_leaks(keyed(table(spark, rows)), test, 10, limit)).collect())) for limit in (1 << 20, 0)]
    assert got[0] == got[1]
    by_id = {r["doc_id"]: r for r in decontaminate.report(decontaminate.find_leaks(keyed(table(spark, rows)), test, 10, 0)).collect()}
    assert by_id[0]["n_items"] == 30 and by_id[0]["n_hit"] == 28 and by_id[50]["n_items"] == 1 and by_id[51]["n_items"] == 0


def test_wide_words_are_encoded_whole(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    r = random.Random(12)
    model = pieces.Pieces.load(pieces.model_path())
    texts = ["".join(r.choice("theringandso") for _ in range(n)) for n in (199, 200, 201, 1000, 20_000)] + ["a" * 3000, "日本語の文章" * 300]
    assert [x.tolist() for x in model.encode(texts)] == [sp.encode(x) for x in texts]


def test_resampling_weights_and_keys(spark):
    r = random.Random(13)
    rows = [(i, " ".join(r.choices(["Good", "fine", "word", "bad", "ünk"], k=r.randrange(0, 25)))) for i in range(60)] + [(70, None), (71, ""), (72, "x"), (5, "other text"), (None, "good word")]
    rows.append(rows[3])
    target = [0, 2, 4, 5, 5, None, 999]
    docs, ids = table(spark, rows), spark.createDataFrame([(i,) for i in target], "doc_id long")

    def grams(text):
        """Buckets of a text's unigrams and bigrams, word by word."""
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        data = [next(resampling.bucket_rows([w.encode()]))[1][0] for w in words]
        return data + [int(next(resampling.bucket_rows([f"{a} {b}".encode()]))[2][0]) for a, b in itertools.pairwise(words)]

    count = lambda own: np.bincount([b for x in own for b in grams(x)], minlength=resampling.BUCKETS) + 1.0
    raw, wanted = count([t for _, t in rows]), count([t for i, t in rows if i in set(target) - {None}])
    ratio = np.log(wanted / wanted.sum()) - np.log(raw / raw.sum())
    for most in (100, 0):  # ids in the tasks, ids by a join
        assert np.allclose(resampling.log_ratios(keyed(docs), ids, most), ratio)
    u = {(x["doc_id"], x["tkey"]): x["u"] for x in keyed(docs).withColumn("u", (F.shiftrightunsigned(F.xxhash64(F.lit(3), "doc_id", "tkey"), 11) + 0.5) / float(1 << 53)).collect()}
    weights = sorted((round(float(ratio[grams(t)].sum()), 6) for _, t in rows))
    out = resampling.resample(docs, ids, share=0.5).collect()
    assert np.allclose(sorted(x["log_weight"] for x in out), weights, atol=2e-6) and len(out) == len(rows)
    keys = sorted(x["gumbel_key"] - x["log_weight"] for x in out)
    noise = sorted(-np.log(-np.log(v)) for (d, k), v in u.items() for _ in range(sum(1 for i, t in rows if i == d) if d == rows[3][0] else 1))
    assert np.allclose(keys, noise, atol=3e-6)
    assert all(x["log_weight"] == 0 for x in out if x["doc_id"] in (70, 71))
    assert sum(x["selected"] for x in out) >= len(rows) // 2 and len({x["selected"] for x in out if x["doc_id"] == rows[3][0]}) == 1
    assert resampling.resample(table(spark, rows).limit(0), ids).count() == 0


def test_language_scores_follow_from_the_model(spark):
    rows = [*((i, t, lang, "x") for i, t, lang in language_rows(60)), (900, None, "en", "x"), (901, "", "en", "x"), (902, "the " * 4000, "en", "x"), (5, language_rows(60)[5][1], "en", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language.train(docs, 50)
    for x in language.predict(keyed(docs), model).collect():
        text = next((t for i, t, *_ in rows if i == x["doc_id"]), None)
        if not text:
            assert (x["lang_pred"], x["score"]) == ("und", 0.0)
            continue
        grams = [g for k in language.ORDERS for a in range(len(text) - k + 1) for g in language.ngrams(np.array([ord(c) for c in text.lower()[a : a + k]], np.uint32), k).tolist()] if len(text) < 3000 else None
        z = (model.weights[grams].astype(float).mean(0) if grams else model.logits([text])[0] - model.bias) + model.bias
        p = np.exp(z / model.temperature - np.max(z / model.temperature))
        assert abs(x["score"] - (p / p.sum()).max()) < 1e-5 and x["lang_pred"] == model.labels[int(p.argmax())]
    again = language.train(docs, 50)
    assert np.array_equal(model.weights, again.weights) and model.temperature == again.temperature


def test_scratch_tables_go(spark):
    import os

    from mnemospark.llm import common

    folder = common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with common.scratch(spark):
        bucketed, _ = common.store_bucketed(common.store(spark.range(5), "one"), "three", "id", 2)
        kept = common.written(bucketed.where("id > 1"), common.place(spark, "two"))
    assert [x.split("-")[0] for x in set(os.listdir(folder)) - before] == ["two"] and kept.count() == 3
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("three")]
    # another thread's tables are its own
    import threading

    with common.scratch(spark):
        other = threading.Thread(target=lambda: common.store(spark.range(1), "apart"))
        other.start()
        other.join()
    assert [x for x in os.listdir(folder) if x.startswith("apart")]


@pytest.mark.parametrize("few", [0, 10, 100_000])
def test_components(spark, monkeypatch, few):
    from mnemospark.llm import components

    monkeypatch.setattr(components, "FEW", few)
    r = random.Random(15)
    edges = [(f"{r.randrange(300):03}", f"{r.randrange(300):03}") for _ in range(170)] + [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("hub", f"h{i}") for i in range(50)] + [("x", "x")]
    up = {}
    for a, b in edges:
        ga, gb = up.setdefault(a, {a}), up.setdefault(b, {b})
        if ga is not gb and a != b:
            ga |= gb
            for x in gb:
                up[x] = ga
    want = {(x, min(g)) for x, g in up.items() if len(g) > 1}
    assert {tuple(x) for x in components.components(spark.createDataFrame(edges, "u string, v string")).collect()} == want


def test_media_features_follow_from_plain_area_means(spark):
    def means(image, rows, cols):
        h, w = image.shape
        overlap = lambda k, n, size, p: max(0.0, min((k + 1) * size / n, p + 1) - max(k * size / n, p))
        down = np.array([[overlap(i, rows, h, y) for y in range(h)] for i in range(rows)])
        across = np.array([[overlap(j, cols, w, x) for x in range(w)] for j in range(cols)])
        return down @ image.astype(float) @ across.T * (rows * cols / (h * w))

    r = random.Random(14)
    rows = [(1, "hello world"), (2, None), (3, "".join(chr(r.randrange(32, 1000)) for _ in range(900))), (4, "ab" * 700), (1, "hello world")]
    for x in media.text_media(table(spark, rows)).collect():
        data = (dict(rows)[x["doc_id"]] or "").encode()
        image = np.frombuffer(data + bytes(-len(data) % 64 or (0 if data else 64)), np.uint8).reshape(-1, 64)
        small, tile = np.round(means(image, 8, 9), 6), io.BytesIO()
        bits = "".join(str(int(small[i, j + 1] > small[i, j])) for i in range(8) for j in range(8))
        np.save(tile, np.clip(np.round(np.round(means(image, 32, 32), 6)), 0, 255).astype(np.uint8))
        assert x["feature"] == f"{len(image)}x64;dhash={int(bits, 2):016x};tile={zlib.crc32(tile.getvalue()):08x}"
