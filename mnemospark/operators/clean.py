"""Filters that turn segments into records."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import noise_reason


def importance_filter(segments: DataFrame, importance: Column, threshold: float = 0.3, margin: float = 0.1, scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """segments that are no noise and reach the threshold (method 'rule'); those within margin below it go to the external
    scorer (method 'external'). Without a scorer they are returned as its work-list; a scorer's rows must have importance."""
    clean = segments.where(noise_reason(F.col("content")).isNull()).withColumn("importance", importance).where(F.col("importance") >= threshold - margin)
    sure = clean.where(F.col("importance") >= threshold).withColumn("method", F.lit("rule"))
    open_ = clean.where(F.col("importance") < threshold).withColumn("method", F.lit("external"))
    if scorer is not None:
        open_ = scorer(open_).where(F.col("importance") >= threshold)
    return sure.unionByName(open_)


def sample(segments: DataFrame, n: int = 3, order: str = "ord") -> DataFrame:
    """The first n filtered segments, as a log shows them: importance to one place and 40 characters."""
    line = F.concat(F.lit("["), F.format_number("importance", 1), F.lit("] "), F.substring("content", 1, 40), F.lit("..."))
    return segments.orderBy(order).limit(n).select(order, line.alias("line"))


def mini_filter(pending: DataFrame, threshold: float = 0.5) -> DataFrame:
    """pending rows (content, urgent, importance): no noise, and urgent or important."""
    return pending.where(noise_reason(F.col("content")).isNull() & (F.col("urgent") | (F.col("importance") >= threshold)))


def records(segments: DataFrame, identity: Column, digits: int = 16) -> DataFrame:
    """Memory records of segments (content, mtype, importance, created_s): id, scores, flags; beliefs get confidence and basis."""
    from ..functions.text import record_id

    belief = F.col("mtype") == "belief"
    return (
        segments.withColumn("id", record_id(F.substring("mtype", 1, 1), F.col("content"), F.col("created_s"), digits))
        .withColumn("score", F.col("importance")).withColumn("final_score", F.col("importance")).withColumn("is_identity", identity)
        .withColumn("confidence", F.when(belief, 0.6)).withColumn("basis", F.when(belief, F.substring("content", 1, 50)))
    )


def capture(rows: DataFrame) -> DataFrame:
    """Manual captures (content, importance, entities as a comma list): blank ones go, importance is kept within [0, 1]."""
    names = F.filter(F.transform(F.split("entities", ","), lambda e: F.trim(e)), lambda e: e != "")
    return (
        rows.withColumn("content", F.trim("content")).where(F.col("content") != "")
        .withColumn("importance", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("importance").cast("double")))).withColumn("entities", names)
    )


def with_verdicts(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows (mid, importance) with the external verdicts (mid, reply: JSON text) where they parse, else the rule's value."""
    parsed = verdicts.select("mid", F.from_json("reply", "importance double, category string").alias("v"))
    joined = rows.join(parsed, "mid", "left")
    good = F.col("v.importance").isNotNull()
    method = F.when(good, "llm").when(F.col("v").isNotNull(), "rule_fallback").otherwise("rule")
    return joined.withColumn("method", method).withColumn("importance", F.coalesce("v.importance", "importance")).withColumn("category", F.col("v.category")).drop("v")


def slots(content: Column, templates: dict[str, str]) -> Column:
    """Category and captured value of the first template that matches."""
    out = None
    for name, pattern in templates.items():
        value = F.struct(F.lit(name).alias("category"), F.regexp_extract(content, pattern, 1).alias("value"))
        out = F.when(content.rlike(pattern), value) if out is None else out.when(content.rlike(pattern), value)
    return out
