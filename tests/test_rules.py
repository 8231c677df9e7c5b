"""Literal cases of the rules with their default (Chinese) word lists."""

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import rules as R
from mnemospark.functions import text as T
from mnemospark.operators import entities

AS_OF = 1706745600


def values(spark, column, *rows, names="content"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], names if isinstance(names, list) else [names])
    return [r[0] for r in df.select(column).collect()]


def test_ttl_patterns(spark):
    rows = ["今天3点开会", "我叫张三", "明天去完成报告", "今天去提交", "苹果是红的"]
    assert values(spark, R.ttl_hours(F.col("content")), *rows) == [12, 0, 48, 12, None]


def test_time_sensor(spark):
    assert values(spark, R.sensed_hours(F.col("content")), "这周完成报告", "这个月", "明天", "现在", "苹果") == [240, 840, 48, 12, None]


def test_weighted_count_and_boost(spark):
    assert values(spark, R.weighted_count(*map(F.col, "abc")), (10, 5, 2), names=["a", "b", "c"]) == [26.0]
    rows = [(26.0, AS_OF - 86400), (26.0, AS_OF - 100 * 86400), (0.0, AS_OF), (5.0, None)]
    df = spark.createDataFrame(rows, "n double, t long").select(R.access_boost(F.col("n"), F.col("t"), F.lit(AS_OF)))
    near, far, none, never = (r[0] for r in df.collect())
    assert near > 0.3 and far < 0.1 and none == never == 0.0


def test_importance(spark):
    rows = ["我对花生过敏", "我喜欢苹果", "项目进度", "随便说说", "记住我喜欢苹果", "重要但是顺便说一下", "天空"]
    assert values(spark, F.round(R.importance(F.col("content")), 6), *rows) == [1.0, 0.8, 0.7, 0.2, 1.0, 0.0, 0.5]


def test_reduce_overrides_boost(spark):
    assert values(spark, F.round(R.importance(F.col("content")), 6), "记住，不重要") == [0.3]


def test_types_and_urgency(spark):
    assert values(spark, R.memory_type(F.col("content")), "我觉得总结", "总结一下", "苹果", "Maybe so") == ["belief", "summary", "fact", "belief"]
    assert values(spark, R.urgency(F.col("content"))["category"], "密码是123", "决定了", "明天必须交", "苹果") == ["critical", "important", "time_sensitive", ""]


def test_noise(spark):
    rows = ["3 + 5 等于多少", "你好", "今天天气怎么样", "帮我搜索", "我住在北京的朝阳区", "嗯", "hi there friend", "abcd", "写一段代码"]
    out = values(spark, R.noise_reason(F.col("content")), *rows)
    assert out == ["pattern", "conversation", "pattern", "pattern", None, "conversation", "conversation", "length", "pattern"]
    assert values(spark, R.legacy_noise(F.col("content")), "哈哈哈", "好的", "。", "!!!", "苹果很好吃") == ["pure_interjection", "simple_ack", "too_short", "emoji_only", None]


def test_complexity(spark):
    rows = ["他不是医生，而是护士", "短", "虽然他认为应该去但是其实没有去，因为据说影响很大，关系复杂吗"]
    c = values(spark, F.round(R.complexity(F.col("content")), 2), *rows)
    assert c[0] < 0.4 and c[1] == 0.0 and c[2] >= 0.4


def test_tokens(spark):
    assert values(spark, F.array_sort(T.mixed_tokens(F.col("content"))), "我爱Spark")[0] == sorted(["我", "爱", "我爱", "Spark"])
    assert values(spark, T.mixed_tokens(F.col("content")), "a") == [["a"]]
    assert values(spark, T.word_tokens(F.col("content")), "The cats, and dogs!") == [["cats", "and", "dogs"]]
    assert values(spark, T.query_shingles(F.col("content")), "abc", "a") == [["abc", "ab", "bc"], []]


@pytest.mark.parametrize(("a", "b", "least", "most"), [("机器人_50", "机器人_5", 0.5, 1.0), ("项目A", "项目A", 1.0, 1.0), ("苹果", "香蕉", 0.0, 0.0), ("", "", 1.0, 1.0)])
def test_entity_similarity(spark, a, b, least, most):
    (v,) = values(spark, T.entity_similarity(F.col("a"), F.col("b")), (a, b), names=["a", "b"])
    assert least <= v <= most


def test_builtin_and_quoted_entities(spark):
    assert values(spark, entities.builtin_entities(F.col("content")), "项目A 和 项目B 都很重要") == [["项目A", "项目B"]]
    assert "寒武纪" in values(spark, entities.rule_entities(F.col("content")), "张三负责'寒武纪'项目")[0]
    assert values(spark, entities.rule_entities(F.col("content"), fixed=()), "Memory-System") == [["Memory", "System"]]


def test_generalise(spark):
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "entity string")
    out = entities.generalise(one(["项目C"]), one(["项目A", "项目B", "城市_1"])).collect()
    assert [tuple(r) for r in out] == [("项目C", "项目[A-Z]")]
    assert entities.generalise(one(["项目C"]), one(["项目1", "项目B"])).count() == 0


def test_conflict_scores(spark):
    day = 86400
    rows = [(45 * day, 0, 0.8, 0.8, "user", "user"), (day, 0, 1.0, 0.6, "user", "assistant"), (day, 0, 0.8, 0.8, "user", "user")]
    df = spark.createDataFrame(rows, "n long, o long, nc double, oc double, nw string, ow string")
    score = R.conflict_score(*(F.col(c) for c in ("n", "o", "nc", "oc", "nw", "ow")))
    out = df.select(F.round(score, 6), R.conflict_action(score)).collect()
    assert [tuple(r) for r in out] == [(0.5, "UPDATE"), (0.75, "UPDATE"), (0.25, "MERGE")]


def test_inhibition(spark):
    cand = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.85), (1, 3, 0.7)], "qid int, mid int, score double")
    links = spark.createDataFrame([(1, "机器人_50"), (2, "机器人_5"), (3, "天气")], "mid int, entity string")
    q = spark.createDataFrame([(1, "机器人_50")], "qid int, q string")
    out = {r["mid"]: round(r["score"], 6) for r in entities.inhibit(cand, q, links).collect()}
    assert out == {1: 0.9, 2: 0.085, 3: 0.7}


def test_learned_matches_find_every_contained_entity(spark):
    words = ["The", "Thnt", "--", "New York", " ", "k C", "\tz", "日本", "a.b", "nowhere", "😂k", ""]
    texts = {1: "There Thnting a--b", 2: "in New York City", 3: "x\tz", 4: "今日本日", 5: "axb a.bc", 6: "", 7: None, 8: "NewYork", 9: "a😂😂k b"}
    rows = [*texts.items(), (1, texts[1]), (None, texts[2]), (1, "The  end")]
    m = spark.createDataFrame(rows, "mid long, content string")
    got = entities.learned_matches(m, spark.createDataFrame([(w,) for w in words + words[:1]], "entity string"))
    want = [(i or 0, w) for i, t in rows for w in words if w and w in (t or "")]
    assert sorted((i or 0, w) for i, w in got.collect()) == sorted(want)
