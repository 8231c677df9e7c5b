"""An index of vectors in coarse cells, searched with exact rescoring."""

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import stored
from .blocks import spark_schema
from .search import best_cosines, dot, top

#: Vectors that the cells' centres are learned from at most.
SAMPLE = 50_000


class VectorIndex(NamedTuple):
    """rows: (mid, cell, u, ...) with u the unit vector, stored by cell; cells: (cell, centre, radius, n), radius the largest angle
    between the centre and a vector of the cell."""

    rows: DataFrame
    cells: DataFrame


def unit(v):
    """The vector at length 1 as doubles; null for one of length 0."""
    size = F.sqrt(dot(v, v))
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size))


def angle(a, b):
    """The angle between unit vectors."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


def centres(units: DataFrame, cells: int, sample: int = SAMPLE, steps: int = 4) -> DataFrame:
    """(cell, centre): cells' unit centres by spherical k-means over a sample of at most about `sample` vectors (u).

    The sample is drawn by a hash of the vector, so every run draws the same one. The centres, cells * width numbers, are the
    only thing that is broadcast. A cell that no vector chooses goes.
    """
    n = units.count()
    drawn = stored(units.where(F.pmod(F.xxhash64("u"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / max(n, 1)))).select("u"), "sample")
    key = Window.orderBy("h", "u")  # over the first `cells` rows only
    first = drawn.select("u", F.xxhash64("u", F.lit(1)).alias("h")).distinct().orderBy("h", "u").limit(cells)
    now = stored(first.select((F.row_number().over(key) - 1).alias("cell"), F.col("u").alias("centre")), "centres")
    for _ in range(steps):
        near = nearest(drawn, now)
        sums = near.select("cell", F.posexplode("u").alias("i", "x")).groupBy("cell", "i").agg(F.sum("x").alias("x"))
        mean = sums.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
        now = stored(mean.select("cell", unit(F.col("m")).alias("centre")).where("centre IS NOT NULL"), "centres")
    return now


def nearest(units: DataFrame, cells: DataFrame) -> DataFrame:
    """units with the nearest cell and the angle to its centre; centres meet all vectors as one broadcast row."""
    table = cells.agg(F.array_sort(F.collect_list(F.struct("cell", "centre"))).alias("_cells"))
    best = F.array_max(F.transform("_cells", lambda c: F.struct(dot(c["centre"], F.col("u")).alias("cosine"), c["cell"].alias("cell"))))
    found = units.crossJoin(F.broadcast(table)).withColumn("_best", best).drop("_cells")
    return found.withColumn("cell", F.col("_best.cell")).withColumn("angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_best.cosine"))))).drop("_best")


def build(vectors: DataFrame, cells: int, sample: int = SAMPLE) -> VectorIndex:
    """An index of all vectors (mid, v, ...); those of length 0 match nothing and aren't in it. Both tables are written to the
    shared folder. Only centres are learned from a sample, every vector is indexed."""
    units = vectors.withColumn("u", unit(F.col("v"))).where("u IS NOT NULL").drop("v")
    middle = centres(units, cells, sample)
    spread = F.pmod(F.xxhash64("mid"), F.lit(8))  # a cell of very many vectors is in several files
    rows = stored(nearest(units, middle).repartition("cell", spread).sortWithinPartitions("cell"), "vectors")
    sizes = rows.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n"))
    return VectorIndex(rows, stored(middle.join(sizes, "cell"), "cells"))


def _scored(asked: DataFrame, rows: DataFrame, wanted: DataFrame, k: int, digits: int) -> DataFrame:
    """The k largest cosines of each query (qid, qu) in each wanted cell (qid, cell), at least those of the k best of all. A cell's rows and
    its queries are dealt in blocks that meet as products of matrices."""
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).join(wanted.groupBy("cell").agg(F.count(F.lit(1)).alias("m")), "cell")
    sizes = stored(sizes.select("cell", F.ceil(F.col("n") / 16384).alias("ni"), F.ceil(F.col("m") / 4096).alias("mi")), "sizes")
    own = lambda n: F.pmod(F.xxhash64("mid"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    met = rows.select("cell", "mid", F.col("u").alias("v")).join(F.broadcast(sizes), "cell").withColumn("i", own("ni")).withColumn("j", every("mi")).withColumn("side", F.lit(1))
    pairs = wanted.join(asked, "qid").select("cell", F.col("qid").alias("mid"), F.col("qu").alias("v"))
    pairs = pairs.join(F.broadcast(sizes), "cell").withColumn("j", own("mi")).withColumn("i", every("ni")).withColumn("side", F.lit(0))
    schema = "qid long, mid long, score double"
    empty = spark_schema(schema).empty_table()

    def best(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        parts = [table.filter(pa.array(side == x)).combine_chunks() for x in (0, 1)]
        return best_cosines(*parts, k=k, digits=digits) if all(p.num_rows for p in parts) else empty

    found = pairs.unionByName(met).groupBy("cell", "i", "j").applyInArrow(best, schema)
    return found.select("qid", "mid", F.round("score", digits).alias("score"))


def search(queries: DataFrame, index: VectorIndex, k: int, probes: int, exact: bool = True, where=None, digits: int = 9) -> DataFrame:
    """The k nearest vectors by cosine of each query (qid, qv), with their places, as vector_channel gives them.

    First the `probes` cells of nearest centre are rescored exactly. With exact=True a query then reads every other cell that
    may hold a better or equal one: by the triangle inequality no vector of a cell is nearer than the angle to its centre less
    the cell's radius. So nothing is missed, and cells that can't matter aren't read. exact=False stops after the probes. `where`, a
    condition on further columns of the index such as the type, is applied to the stored rows (pushed down to the scan).
    """
    rows = index.rows if where is None else index.rows.where(where)
    asked = queries.select("qid", unit(F.col("qv")).alias("qu")).where("qu IS NOT NULL")
    table = index.cells.agg(F.collect_list(F.struct("cell", "centre", "radius")).alias("c"))
    near = asked.crossJoin(F.broadcast(table)).select("qid", "qu", F.explode("c").alias("c")).select("qid", "c.cell", "c.radius", angle(F.col("qu"), F.col("c.centre")).alias("angle"))
    near = stored(near.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("angle", "cell"))), "near")
    found = top(_scored(asked, rows, near.where(F.col("place") <= probes).select("qid", "cell"), k, digits), k)
    if not exact:
        return found
    found = stored(found, "probed")
    kth = found.where(F.col("pos") == k).select("qid", F.col("score").alias("kth"))
    best = F.cos(F.greatest(F.lit(0.0), F.col("angle") - F.col("radius")))
    slack = 2 * 10.0**-digits  # rounding, and of the angles
    rest = near.where(F.col("place") > probes).join(kth, "qid", "left").where(F.col("kth").isNull() | (best >= F.col("kth") - slack - 1e-9)).select("qid", "cell")
    return top(found.select("qid", "mid", "score").unionByName(_scored(asked, rows, rest, k, digits)), k)
