"""Filter interaction audit (13): what each filter removes in every order of the filters.

Documents are counted by failure mask; each mask cell then folds over all orders with aggregate and transform, which gives one
weighted struct for each order and step, and the cells of a part are merged by elementwise sums. Only counts meet, no texts.
"""

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, store

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Orders are n!, so more filters than this would make the order array large.
MAX_FILTERS = 7


def words(text: Column) -> Column:
    """The maximal runs of other characters than space, tab, and line breaks."""
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda x: x != "")


def cleaning_rules(text: Column) -> dict[str, Column]:
    """Four failure conditions: few words, few distinct words, many capitals, and signs of markup or code."""
    w = words(text)
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(w) < 50,
        "B": F.size(F.array_distinct(w)) * 100 < F.size(w) * 65,
        "C": capitals * 100 > F.length(text) * 5,
        "D": text.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame, rules=cleaning_rules, part: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: documents by failure mask; bit i stands for the i-th rule, the last for a copied text.

    A text is a copy where a row with a smaller doc_id has the same one. Only digests (SHA-256), doc_ids and masks are shuffled:
    rows are counted before any shuffle, and the least doc_id of a text meets its rows by text and doc_id together, so a text
    that a third of all rows have stays spread out. Null texts are empty; a null part is the empty string; rows without a
    doc_id are neither copies nor originals; repeated rows count each and aren't copies of one another; a document is good or
    toxic if any label row of its doc_id says so. Empty tables give no cells.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    conditions = list(rules(F.col("t")).values())
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))
    base = docs.select(F.col("doc_id").cast("long").alias("d"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("t"))
    seen = base.select("d", "part", bits.cast("int").alias("mask"), F.unhex(F.sha2("t", 256)).alias("digest"))
    rows = store(seen.groupBy("d", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n")), "audit")
    first = rows.where("d IS NOT NULL").groupBy("digest").agg(F.min("d").alias("d")).withColumn("first", F.lit(True))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("d"))
    known = known.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("g"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("x"))
    copied = F.col("d").isNotNull() & F.col("first").isNull()
    full = F.col("mask") + F.when(copied, 1 << len(conditions)).otherwise(0)
    met = rows.join(first, ["digest", "d"], "left").join(known, "d", "left")
    weight = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    return met.groupBy("part", full.alias("mask")).agg(F.sum("n").alias("n"), weight("g").alias("good"), weight("x").alias("toxic"))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), i)


def folded(orders: Column) -> Column:
    """One mask cell over all orders: a struct (filter and COUNTS) for each order and step, in that order."""
    zero = F.lit(0).cast("long")
    n, good, toxic = (F.col(x).cast("long") for x in ("n", "good", "toxic"))

    def step(acc, i):
        bit = _bit(i)
        fails, gone = F.col("mask").bitwiseAND(bit) != 0, F.col("mask").bitwiseAND(acc["seen"]) != 0
        here = fails & ~gone
        counted = {
            "kept": F.when(~fails & ~gone, n), "removed": F.when(here, n), "redundant": F.when(fails & gone, n),
            "unique_fails": F.when(F.col("mask") == bit, n), "good_lost": F.when(here, good), "toxic_lost": F.when(here, toxic),
        }
        out = F.struct(i.cast("int").alias("filter"), *(v.otherwise(zero).alias(k) for k, v in counted.items()))
        return F.struct(acc["seen"].bitwiseOR(bit).alias("seen"), F.concat(acc["out"], F.array(out)).alias("out"))

    kind = f"array<struct<filter:int,{','.join(f'{x}:bigint' for x in COUNTS)}>>"
    start = F.struct(F.lit(0).alias("seen"), F.array().cast(kind).alias("out"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda acc: acc["out"])))


def merged(cells: Column) -> Column:
    """Elementwise sums of the cells' arrays."""
    both = lambda p, q: F.struct(p["filter"].alias("filter"), *((p[x] + q[x]).alias(x) for x in COUNTS))
    return F.aggregate(F.slice(cells, 2, F.size(cells)), cells[0], lambda acc, x: F.zip_with(acc, x, both))


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def with_shares(steps: Column, filters: int) -> Column:
    """steps with what each one's filter removes in all orders, by step."""
    removed = lambda f: F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["filter"] == f, x["removed"]).otherwise(0))
    return _bound(F.array(*map(removed, range(filters))), lambda shares: F.transform(steps, lambda x: F.struct(x.alias("counts"), shares[x["filter"]].alias("shapley"))))


def interactions(cells: DataFrame, names: str) -> DataFrame:
    """part, filter_order, step, COUNTS and shapley for each part, order of the filters and step.

    cells: part, mask, n, good, toxic; names has a letter for each bit. At most 2 ** len(names) cells of a part meet, each an
    array of len(names) * len(names)! structs, whatever the number of documents. shapley is the number of documents that the
    step's filter removes, summed over all orders.
    """
    if not 0 < len(names) <= MAX_FILTERS:
        raise ValueError(f"1 to {MAX_FILTERS} filters")
    every = list(permutations(range(len(names))))
    literal = lambda rows: F.expr(f"array({', '.join(rows)})")
    orders, labels = literal(f"array({', '.join(map(str, x))})" for x in every), literal(f"'{''.join(names[i] for i in x)}'" for x in every)
    total = cells.groupBy("part", "mask").agg(*(F.sum(x).alias(x) for x in ("n", "good", "toxic")))
    parts = total.select("part", folded(orders).alias("cell")).groupBy("part").agg(F.collect_list("cell").alias("cells"))
    steps = _bound(merged(F.col("cells")), lambda x: with_shares(x, len(names)))
    rows = parts.select("part", F.posexplode_outer(steps).alias("pos", "s"))  # outer: no filter that would compute steps again
    order = labels[F.floor(F.col("pos") / len(names)).cast("int")].alias("filter_order")
    return rows.select("part", order, (F.col("pos") % len(names) + 1).cast("int").alias("step"), *(F.col(f"s.counts.{x}").alias(x) for x in COUNTS), F.col("s.shapley").alias("shapley"))


def op13(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    return interactions(masks(docs, labels), "ABCDE")


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                  list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                  min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w),
              'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
              'E': coalesce(doc_id > least, false)} AS r FROM d LEFT JOIN l USING (doc_id)),
m AS (SELECT part, concat(CASE WHEN r['A'] THEN 'A' ELSE '' END, CASE WHEN r['B'] THEN 'B' ELSE '' END, CASE WHEN r['C'] THEN 'C' ELSE '' END,
                          CASE WHEN r['D'] THEN 'D' ELSE '' END, CASE WHEN r['E'] THEN 'E' ELSE '' END) AS fails,
             count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT concat(a.c, b.c, c.c, d.c, e.c) AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS letter, filter_order[1:step - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
p AS (SELECT *, contains(fails, letter) AS bad, len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda c: contains(fails, c) AND contains(before, c))) > 0 AS gone FROM m, s),
c AS (SELECT part, filter_order, step, letter,
             sum(CASE WHEN NOT bad AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN bad AND NOT gone THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN bad AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN bad AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN bad AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
      FROM p GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM c
"""
