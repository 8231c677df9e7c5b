"""Inverted indexes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import index_keywords


def postings(memories: DataFrame) -> DataFrame:
    """Distinct (term, mid): rows, never an array for a term, so hot terms stay spread."""
    return memories.select(F.explode(index_keywords(F.col("content"))).alias("term"), "mid")


def relation_index(memories: DataFrame, links: DataFrame) -> DataFrame:
    """(entity, mtype, mid): the link table with the record's type."""
    return links.join(memories.select("mid", "mtype"), "mid").select("entity", "mtype", "mid")


def timeline(memories: DataFrame, unit: str = "month") -> DataFrame:
    """(period, mid) of records by day or month of creation."""
    return memories.select(F.date_trunc(unit, F.timestamp_seconds("created_s")).cast("date").alias("period"), "mid")


def search_export(memories: DataFrame, links: DataFrame) -> DataFrame:
    """A line `[id] content` and an entity line for each record."""
    names = links.groupBy("mid").agg(F.array_join(F.array_sort(F.collect_set("entity")), ", ").alias("names"))
    line = F.concat(F.lit("["), F.col("mid"), F.lit("] "), F.col("content"))
    return memories.join(names, "mid", "left").select("mtype", "mid", F.concat_ws("\n", line, F.concat(F.lit("  entities: "), F.col("names"))).alias("line"))


def export(memories: DataFrame, links: DataFrame, path: str) -> DataFrame:
    """The lines as text files, one folder for each type; (mtype, n, chars) counts of what was written."""
    lines = search_export(memories, links)
    lines.select("mtype", "line").write.partitionBy("mtype").mode("overwrite").text(path)
    return lines.groupBy("mtype").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"))
