"""Connected components of an edge table by alternating large-star and small-star steps."""

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import store


#: Nodes whose edges a task contracts together (some 200 bytes each), and edges that one task may finish: they have no more nodes.
NODES = 100_000
FEW = NODES // 2


def _contracted(batches):
    """A partition's edges, NODES at a time, as stars around the least node of what they connect: fewer edges, shorter paths."""
    up: dict = {}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def stars(kind):
        nodes = [x for x in up if up[x] != x]
        for i in range(0, len(nodes), 10_000):
            own = nodes[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(own, kind), pa.array([find(x) for x in own], kind)], names=["u", "v"])

    kind = None
    for batch in batches:
        kind = batch.schema.field("u").type
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            up.setdefault(u, u)
            up.setdefault(v, v)
            a, b = find(u), find(v)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) > NODES:
            yield from stars(kind)
            up.clear()
    yield from stars(kind)


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, comp) of edges (u, v): comp is the least node of the component. Nodes without an edge have no row.

    Partitions first contract their own edges. Then each step is two aggregations and a join on slim rows, written to the
    shared folder; a node of very many neighbours costs partial minima and a join that Spark can split. Steps grow with the
    logarithm of a component's size. When no more than FEW edges are left (they are counted as they are written), one task
    contracts them all, which gives the same components.
    """
    kind = edges.schema["u"].dataType.simpleString()
    slim = edges.where("u <> v").select("u", "v").distinct().mapInArrow(_contracted, f"u {kind}, v {kind}")
    now, state, before = *_stored(slim.distinct(), name), None
    while state != before and state[0] > FEW:
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now, state = _stored(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), name)
    if state[0] <= FEW:
        now = store(now.coalesce(1).mapInArrow(_contracted, f"u {kind}, v {kind}"), name)
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _stored(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The stored edges, and their number and a hash of them, which are taken while they are written."""
    seen = Observation()
    out = store(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), name)
    return out, (seen.get["n"], seen.get["x"])
