"""An index in segments: postings and vectors of each change, tombstones by number, compaction."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions
from .index import postings

#: Segments that are merged into one when there are more.
FANOUT = 4

_KINDS = ("postings", "vectors", "touched")


def _write(root: str, seq: int, frames: dict[str, DataFrame]) -> dict:
    """A segment: a part of each kind. Its number is the order of changes: of a record, the highest one that names it counts."""
    return {"seq": seq} | {kind: versions.new_part(df, root) for kind, df in frames.items()}


def _rows(spark: SparkSession, segments: list[dict], kind: str) -> DataFrame:
    """Rows of one kind with the number of their segment; a merged segment's rows have their own."""
    rows = None
    for s in segments:
        own = spark.read.parquet(s[kind])
        own = own if "seq" in own.columns else own.withColumn("seq", F.lit(s["seq"]).cast("long"))
        rows = own if rows is None else rows.unionByName(own)
    return rows


def _live(spark: SparkSession, segments: list[dict], kind: str) -> DataFrame:
    """Rows of each record's last change. A deleted record has a last change without rows."""
    last = _rows(spark, segments, "touched").groupBy("mid").agg(F.max("seq").alias("seq"))
    return _rows(spark, segments, kind).join(last, ["mid", "seq"])


def change(spark: SparkSession, root: str, upserts: DataFrame, deletes: DataFrame | None = None, fanout: int = FANOUT) -> versions.Version:
    """The next version of the index under root: upserts (mid, content, mtype, v) are new or edited records, deletes (mid) go; a
    record in both stays.

    Only the changed records are indexed: their postings and vectors are a new segment, and their ids, in `touched`, make what
    earlier segments have of them void. Beyond `fanout` segments the later ones are merged; once they hold a quarter of what the
    first has, all are. A change that fails leaves the version before it.
    """
    after = versions.current(spark, root)
    seq = after.note.get("seq", 0) + 1
    gone = upserts.select("mid").limit(0) if deletes is None else deletes.select("mid")
    frames = {
        "postings": postings(upserts),
        "vectors": upserts.where("v IS NOT NULL").select("mid", "mtype", "v"),
        "touched": upserts.select("mid").unionByName(gone).distinct(),
    }
    segments = [*after.note.get("segments", []), _write(root, seq, frames)]
    if len(segments) > fanout:
        sizes = [_rows(spark, [s], "touched").count() for s in segments]
        first = segments[1:] if 4 * sum(sizes[1:]) < sizes[0] else segments
        segments = [*segments[: len(segments) - len(first)], _merged(spark, root, first, whole=len(first) == len(segments))]
    parts = [s[kind] for s in segments for kind in _KINDS]
    return versions.publish(spark, root, after, parts, {"seq": seq, "segments": segments})


def _merged(spark: SparkSession, root: str, segments: list[dict], whole: bool) -> dict:
    """Segments as one, without what is void. Tombstones go where nothing earlier is left that they could touch."""
    last = _rows(spark, segments, "touched").groupBy("mid").agg(F.max("seq").alias("seq"))
    frames = {kind: _live(spark, segments, kind) for kind in ("postings", "vectors")}
    if whole:
        alive = frames["postings"].select("mid").unionByName(frames["vectors"].select("mid")).distinct()
        last = last.join(alive, "mid", "left_semi")
    return _write(root, segments[-1]["seq"], frames | {"touched": last})


def live_postings(spark: SparkSession, root: str) -> DataFrame:
    """(term, mid) of the current version, as index.postings gives them for the records that are there now."""
    return _live(spark, versions.current(spark, root).note["segments"], "postings").select("term", "mid")


def live_vectors(spark: SparkSession, root: str) -> DataFrame:
    """(mid, mtype, v) of the current version."""
    return _live(spark, versions.current(spark, root).note["segments"], "vectors").select("mid", "mtype", "v")
