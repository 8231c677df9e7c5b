"""The pipeline on a small corpus, stage by stage, against plain Python."""

import collections
import os
import random
from pathlib import Path

import corpus_pipeline
import pytest
from mnemospark.llm import common, language, pieces
from test_operators import brute_components, brute_leaks

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(1)
    syllables = {"en": ["the", "ing", "and", "wh", "sh"], "de": ["sch", "ung", "ein", "ü", "ß"]}
    text = lambda lang: " ".join("".join(r.choices(syllables[lang], k=4)) for _ in range(60))
    rows = [(i, f"shared header\n{text(lang)}", lang) for i, lang in ((i, "en" if i % 3 else "de") for i in range(60))]
    rows += [(100, rows[5][1], "en"), (101, rows[7][1] + " end", "en"), (102, "12345 !!", "en"), (103, None, "en"), (104, rows[8][1] + "\nbenchmark one two three four five six seven eight nine ten", "en")]
    rows += [(105, "", "de"), rows[9], rows[9], (None, rows[10][1], "en"), (106, " ".join(text("en") for _ in range(60)), "en"), (9, rows[11][1] + " other", "en")]
    return rows


def plain_stages(rows, model):
    """The rows (doc_id, text) that each stage keeps."""
    out = [[(i, t) for i, t in rows if (p := model.predict([t]))[0][0] != "und" and p[1][0] >= 0.5]]
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\v\f\r"))
    seen = collections.defaultdict(set)
    for i, t in out[-1]:
        for x in t.split("\n"):
            if i is not None and key(x):
                seen[key(x)].add(i)
    hot = {k for k, ids in seen.items() if len(ids) >= 10}
    out.append([(i, "\n".join(x for x in t.split("\n") if key(x) not in hot)) for i, t in out[-1]])
    distinct = list(dict.fromkeys(out[-1]))
    marked = [(k, t) for k, (_, t) in enumerate(distinct)]  # groups by number, as one doc_id may have several texts
    group = {k: g for k, _, g in brute_components(marked, 5, 80)}
    best = {}
    for k, (i, t) in enumerate(distinct):
        best.setdefault(group[k], []).append((i is None, i if i is not None else 0, t))
    kept = {(i, t) for k, (i, t) in enumerate(distinct) if not t.strip() or min(x[:2] for x in best[group[k]]) == (i is None, i if i is not None else 0)}
    out.append([x for x in out[-1] if x in kept])
    items = [(1, "Benchmark one two three four five six seven eight nine ten")]
    out.append([(i, t) for i, t in out[-1] if not brute_leaks(t, items, 10)[1]])
    return out


def test_pipeline(spark, tmp_path: Path):
    rows = corpus()
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "Benchmark one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    first = docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = plain_stages([(i, t) for i, t, _ in rows], language.train(language.learnable(first)))
    order = lambda x: sorted(x, key=str)
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        docs = common.store(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == COLUMNS
        assert order((x["doc_id"], x["text"]) for x in docs.collect()) == order(expected), name
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    folder = common.store(first.limit(1), "mark").inputFiles()[0].removeprefix("file:").rsplit("/", 2)[0]
    before = len(os.listdir(folder))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(os.listdir(folder)) - before == 1  # what the last stage reads, and no other table
    assert order((x["doc_id"], x["ids"]) for x in out) == order((i, sp.encode(t)) for i, t in want[-1])
    assert all(x["round_trip"] and x["n_tokens"] == len(x["ids"]) for x in out) and {102, 103, 105} & {x["doc_id"] for x in out} == set()


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_take_an_empty_table(spark, tmp_path, name, stage):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = stage(spark, spark.createDataFrame([], SCHEMA), str(tmp_path))
    assert out.count() == 0 and (name == "sentencepiece_encoding" or out.columns == COLUMNS)
