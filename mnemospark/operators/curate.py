"""Curation: dedup, conflicts, beliefs, summaries, profiles, decay, expiry, archive (J06-J08, J14, J18, A06, A07, A09, F12-F22, D*)."""

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import rules as R
from ..functions.text import any_of, floor_days, jaccard, mixed_tokens, overlap_coefficient, whitespace_words, word_tokens
from ..sources.io import stored
from . import blocks


def split_expired(memories: DataFrame, as_of_s: int) -> tuple[DataFrame, DataFrame]:
    """(expired, valid); rows without a time stay valid."""
    gone = F.coalesce(F.col("expires_s") <= as_of_s, F.lit(False))
    return memories.where(gone), memories.where(~gone)


def ttl_cleanup(memories: DataFrame, as_of_s: int, column: str = "expires_s") -> DataFrame:
    """active rows whose deletion time has passed become junk (state 2)."""
    return memories.withColumn("state", F.when((F.col("state") == 0) & (F.col(column) < as_of_s), 2).otherwise(F.col("state")))


def stale_scan(memories: DataFrame, as_of_s: int, days: int = 30) -> DataFrame:
    """F16: stale and stale_days of rows not verified for more than so many days; the others are verified as of now."""
    age = floor_days(F.lit(as_of_s), F.coalesce("last_verified_s", "created_s"))
    old = F.coalesce(age > days, F.lit(False))
    return memories.withColumn("stale", old).withColumn("stale_days", F.when(old, age)).withColumn("last_verified_s", F.when(old, F.col("last_verified_s")).otherwise(F.lit(as_of_s)))


def split_archive(memories: DataFrame, least: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(remaining, archived) by score."""
    return memories.where(~F.coalesce(F.col("score") < least, F.lit(False))), memories.where(F.col("score") < least)


def inherit_lineage(old_supersedes: Column, old_id: Column) -> Column:
    """The superseded record's own lineage (a JSON array) and its id."""
    empty = F.array().cast("array<string>")
    return F.concat(F.coalesce(F.from_json(old_supersedes, "array<string>"), empty), F.array(old_id))


def access_stats(log: DataFrame) -> DataFrame:
    """Counts by access type and last access of each memory."""
    count = lambda kind: F.count_if(F.col("access_type") == kind)
    return log.groupBy("mid").agg(
        F.count(F.lit(1)).alias("accesses"), count("retrieval").alias("retrieval"), count("used_in_response").alias("used_in_response"), count("user_mentioned").alias("user_mentioned"),
        F.floor(F.max("ts_us") / 1_000_000).alias("last_s"),
    )


def apply_access(memories: DataFrame, log: DataFrame) -> DataFrame:
    """Counters and last access with the log's events added; the log is aggregated before the join."""
    return add_access(memories, access_stats(log))


def add_access(memories: DataFrame, stats: DataFrame) -> DataFrame:
    """P17 with counts (as access_stats gives them) that are already there, such as a stream's."""
    add = lambda c, k: (F.col(c) + F.coalesce(F.col(k), F.lit(0))).alias(c)
    joined = memories.join(stats, "mid", "left")
    changed = {"retrieval_count": add("retrieval_count", "retrieval"), "used_in_response_count": add("used_in_response_count", "used_in_response"), "user_mentioned_count": add("user_mentioned_count", "user_mentioned"), "last_accessed_s": F.greatest("last_accessed_s", "last_s").alias("last_accessed_s")}
    return joined.select(*(changed.get(c, F.col(c)) for c in memories.columns))


def apply_access_mode(memories: DataFrame, log: DataFrame, mode: str = "v1.2.4") -> DataFrame:
    """P17 in its two store forms: v1.2.4 counts every access in access_count, v1.2.5 only those that are no retrieval."""
    s = access_stats(log)
    n = F.coalesce("accesses", F.lit(0)) if mode == "v1.2.4" else F.coalesce(F.col("accesses") - F.col("retrieval"), F.lit(0))
    return memories.join(s, "mid", "left").select("mid", n.alias("access_count"), F.coalesce("retrieval", F.lit(0)).alias("retrievals"))


# --- candidate pairs --------------------------------------------------------------------------------------------------


def _need(least: float, of: str, a: Column, b: Column) -> Column:
    """Tokens that sets of sizes a (new) and b (old) have in common at least, for a share of `least`."""
    share = {"union": (a + b) * (least / (1 + least)), "new": a * least, "smaller": F.least(a, b) * least}[of]
    return F.greatest(F.ceil(share - 1e-9), F.lit(1))


#: Longs of 64 bits that stand for a token set before it is compared (see _prefixes).
FOLDS = 4
#: Slots of the table of counts by which tokens are ordered (see _by_token); a power of two.
SLOTS = 1 << 18
#: Ids of so many records are broadcast at most.
SHORT = 1 << 21


def _slots(rows: DataFrame) -> np.ndarray:
    """How many tokens of each side's sets (side, h) fall in each slot."""
    count = lambda side: F.count_if(F.col("side") == side).alias(f"n{side}")
    counts = rows.select("side", F.explode("h").alias("w")).groupBy(F.pmod("w", F.lit(SLOTS)).alias("slot")).agg(count(0), count(1)).toArrow()
    out = np.zeros((2, SLOTS), np.int64)
    for side in (0, 1):
        out[side, counts["slot"].to_numpy()] = counts[f"n{side}"].to_numpy()
    return out


def _prefixes(batches, shared, least: float):
    """(w, mid, n, i, s0, ...): the first tokens of each set (side, mid, h) by (slot's count, token) and their places i from 1, without those
    whose slot is empty on the other side; s: the set folded to FOLDS longs: each token flips one bit. Common tokens cancel out, so two
    sets' folds differ in no more bits than the sets do in tokens."""
    counts = shared.value
    both = counts.sum(0)
    for batch in batches:
        h, side = batch.column("h"), batch.column("side").to_numpy()
        n = h.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        w, row = h.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
        folds = np.zeros((len(n), FOLDS), np.int64)
        np.bitwise_xor.at(folds, (row, w & (FOLDS - 1)), np.left_shift(np.int64(1), (w >> 8) & 63))
        order = np.lexsort((w, both[w & (SLOTS - 1)], row))
        w = w[order]
        place = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n) + 1
        most = n - np.maximum(np.ceil(n * least - 1e-9), 1).astype(np.int64) + 1
        keep = (place <= most[row]) & (counts[1 - side[row], w & (SLOTS - 1)] > 0)
        row = row[keep]
        columns = [pa.array(w[keep]), batch.column("mid").take(pa.array(row)), pa.array(n[row].astype(np.int32)), pa.array(place[keep].astype(np.int32)), *(pa.array(folds[row, i]) for i in range(FOLDS))]
        yield pa.RecordBatch.from_arrays(columns, ["w", "mid", "n", "i", *(f"s{i}" for i in range(FOLDS))])


def _by_token(new: DataFrame, old: DataFrame, least: float) -> DataFrame:
    """(a, b) of token sets that may share `least` of their union: they meet on one of the first n - ceil(least * n) + 1 tokens of
    both, rare ones first, that leaves enough places after it.

    Tokens are 64-bit hashes here, written once to the shared folder. How rare a token is comes from a table of SLOTS counts that each task
    gets, so sets are ordered where they are read: only their first tokens are shuffled, and of these only those that the other side may have.
    Sets that meet by chance have folds (see _prefixes) that differ in too many bits: they go inside the join, so the pairs that leave it are
    nearly all similar, and only these are shuffled.
    """
    whole = [df.select(F.lit(i).alias("side"), "mid", F.transform("tokens", lambda w: F.xxhash64(w)).alias("h")) for i, df in enumerate((new, old))]
    rows = stored(whole[0].unionByName(whole[1]), "hashes")
    shared = rows.sparkSession.sparkContext.broadcast(_slots(rows))
    folds = [f"s{i}" for i in range(FOLDS)]
    schema = f"w long, mid {rows.schema['mid'].dataType.simpleString()}, n int, i int, " + ", ".join(f"{s} long" for s in folds)

    def first(side: int, key: str) -> DataFrame:
        cut = rows.where(F.col("side") == side).mapInArrow(partial(_prefixes, shared=shared, least=least), schema)
        return cut.select("w", F.col("mid").alias(key), *(F.col(c).alias(f"{c}_{key}") for c in ("n", "i", *folds)))

    need = _need(least, "union", F.col("n_a"), F.col("n_b"))
    bits = [F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))) for s in folds]
    near = sum(bits[1:], bits[0]) <= F.col("n_a") + F.col("n_b") - 2 * need
    met = first(0, "a").join(first(1, "b"), "w").where((F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b")) + 1 >= need) & near)
    return met.select("a", "b").distinct()


#: An entity of more records than this on both sides is met by token.
FEW = 32


def token_pairs(new: DataFrame, old: DataFrame, links: DataFrame, least: float, of: str = "union", few: int = FEW) -> DataFrame:
    """(a, b) of token sets (mid, tokens) that share an entity and may share `least` of what they hold together (of='union'), of
    new's tokens ('new') or of the smaller set's ('smaller').

    A share of the union leaves few tokens to meet on, so rare tokens come first and entities are held against each other after.
    The other shares leave most tokens: there records meet on the entity, and those of an entity that more than `few` records
    on both sides have meet on entity and token (see _hot_pairs), so an entity in every record makes few pairs.
    """
    names = links.select("mid", "entity")
    if of == "union":
        pairs = _by_token(new, old, least)
        both = pairs.join(names.withColumnRenamed("mid", "a"), "a").join(names.withColumnRenamed("mid", "b"), ["b", "entity"])
        return both.select("a", "b").distinct()
    left, right = (df.where(F.size("tokens") > 0).select(F.col("mid").alias(k), F.size("tokens").alias(f"n_{k}")).join(names.withColumnRenamed("mid", k), k) for k, df in (("a", new), ("b", old)))
    counts = left.groupBy("entity").agg(F.count(F.lit(1)).alias("na")).join(right.groupBy("entity").agg(F.count(F.lit(1)).alias("nb")), "entity")
    counts = stored(counts.withColumn("hot", F.least("na", "nb") > few).select("entity", "hot"), "entities")
    cold = counts.where("NOT hot").select("entity")
    need = _need(least, of, F.col("n_a"), F.col("n_b"))
    pairs = left.join(cold, "entity").join(right, "entity").where(F.least("n_a", "n_b") >= need).select("a", "b")
    hot = counts.where("hot").select("entity")
    if not hot.isEmpty():
        pairs = pairs.unionByName(_hot_pairs(new, old, names.join(hot, "entity", "left_semi"), least, of))
    return pairs.distinct()


def _hot_pairs(new: DataFrame, old: DataFrame, links: DataFrame, least: float, of: str) -> DataFrame:
    """The pairs of token_pairs for entities of many records.

    Records meet on entity and token, by classes of size (powers of two). Tokens stand by how rare they are among the entity's
    records, and a pair meets only on a token that leaves enough places after it on both sides to reach the share (its first
    common token always does); the classes bound the share before the join, so common tokens mostly don't enter it. An entity
    whose records would meet more often by token than as whole lists meets by itself, so there are never more meetings than
    pairs of an entity. The placed tokens are written once to the shared folder.
    """
    sides = []
    for side, df in enumerate((new, old)):
        rows = df.select("mid", F.size("tokens").alias("n"), F.explode("tokens").alias("w")).join(links.select("mid", "entity"), "mid")
        sides.append(rows.withColumn("side", F.lit(side)))
    both = sides[0].unionByName(sides[1])
    common = both.groupBy("entity", "w").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("side", "mid", "entity").orderBy("df", "w")
    placed = both.join(common, ["entity", "w"]).withColumn("i", F.row_number().over(order))
    placed = stored(placed.select("side", "mid", "n", "entity", "w", "i"), "placed")
    classes = (placed.agg(F.max("n")).first()[0] or 1).bit_length()
    low, first = F.call_function("shiftleft", F.lit(1), F.col("other")), F.col("side") == 0
    own = {
        "new": F.when(first, F.col("n") * least).otherwise(low * least),
        "smaller": F.least(F.col("n"), low) * least,
    }[of]
    rows = placed.withColumn("c", F.length(F.bin("n")) - 1).withColumn("other", F.explode(F.array(*map(F.lit, range(classes)))))
    rows = rows.where(F.col("i") <= F.col("n") - F.greatest(F.ceil(own - 1e-9), F.lit(1)) + 1)
    rows = rows.withColumn("ca", F.when(first, F.col("c")).otherwise(F.col("other"))).withColumn("cb", F.when(first, F.col("other")).otherwise(F.col("c")))
    key = ["entity", "w", "ca", "cb"]
    meets = rows.groupBy(*key).agg(F.count_if(F.col("side") == 0).alias("ra"), F.count_if(F.col("side") == 1).alias("rb")).where("ra > 0 AND rb > 0")
    heads = placed.where("i = 1").groupBy("entity").agg((F.count_if(F.col("side") == 0) * F.count_if(F.col("side") == 1)).alias("pairs"))
    whole = stored(meets.groupBy("entity").agg(F.sum(F.col("ra") * F.col("rb")).alias("met")).join(heads, "entity").select("entity", (F.col("met") > F.col("pairs")).alias("whole")), "by-entity")
    rows = rows.join(meets.join(whole.where("NOT whole"), "entity").select(key), key)
    a = rows.where("side = 0").select(*key, F.col("mid").alias("a"), F.col("n").alias("n_a"), F.col("i").alias("i_a"))
    b = rows.where("side = 1").select(*key, F.col("mid").alias("b"), F.col("n").alias("n_b"), F.col("i").alias("i_b"))
    need = _need(least, of, F.col("n_a"), F.col("n_b"))
    by_token = a.join(b, key).where(F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b")) + 1 >= need)
    lists = placed.where("i = 1").join(whole.where("whole"), "entity", "left_semi")
    left, right = (lists.where(F.col("side") == i).select("entity", F.col("mid").alias(k), F.col("n").alias(f"n_{k}")) for i, k in enumerate("ab"))
    by_entity = left.join(right, "entity").where(F.least("n_a", "n_b") >= need)
    return by_token.select("a", "b").unionByName(by_entity.select("a", "b")).distinct()


def contained_pairs(inner: DataFrame, outer: DataFrame, links: DataFrame, chars: int = 8) -> DataFrame:
    """(x, y) of records (mid, content) that share an entity and of which y's text holds x's, letter case aside.

    They meet on the entity and the inner text's first few characters, which the outer texts' substrings of that length hold.
    """
    low = lambda df, key: df.select(F.col("mid").alias(key), F.lower("content").alias(f"c_{key}")).join(links.select(F.col("mid").alias(key), "entity"), key)
    x = low(inner, "x").withColumn("k", F.substring("c_x", 1, chars))
    sizes = x.select("entity", F.length("k").alias("g")).distinct()
    y = low(outer, "y").join(sizes, "entity").where(F.length("c_y") >= F.col("g"))
    parts = F.transform(F.sequence(F.lit(1), F.length("c_y") - F.col("g") + 1), lambda i: F.substring("c_y", i, F.col("g")))
    met = x.join(y.select("y", "entity", F.explode(F.array_distinct(parts)).alias("k")), ["entity", "k"]).select("x", "c_x", "y").distinct()
    texts = outer.select(F.col("mid").alias("y"), F.lower("content").alias("c_y"))
    return met.join(texts, "y").where(F.contains("c_y", "c_x")).select("x", "y").distinct()


_SIDE = ("content", "created_s", "confidence", "ownership", "importance", "score", "ord")


def paired(new: DataFrame, old: DataFrame, links: DataFrame, tokens, least: float, of: str = "union", small: int = 0) -> DataFrame:
    """Pairs of new and old records that share an entity and may share `least` of their tokens (see token_pairs), or of which a
    record of fewer than `small` tokens lies in the other's text; with both sides' columns (n_*, o_*) and token sets, made once
    for each record. The pairs are written once to the shared folder."""
    sides = [df.select("mid", *_SIDE, tokens(F.col("content")).alias("tokens")) for df in (new, old)]
    pairs = token_pairs(sides[0].select("mid", "tokens"), sides[1].select("mid", "tokens"), links, least, of)
    if small:
        few = [x.where(F.size("tokens") < small).select("mid", "content") for x in sides]
        inside = [contained_pairs(few[0], old, links).toDF("a", "b"), contained_pairs(few[1], new, links).toDF("b", "a")]
        pairs = pairs.unionByName(inside[0]).unionByName(inside[1]).distinct()
    pairs = stored(pairs, "pairs")
    if pairs.count() <= SHORT:  # records without a pair stay where they are
        sides = [df.join(F.broadcast(pairs.select(F.col(k).alias("mid")).distinct()), "mid", "left_semi") for df, k in zip(sides, "ab", strict=True)]
    side = lambda df, p, k: df.select(F.col("mid").alias(k), *(F.col(c).alias(p + c) for c in (*_SIDE, "tokens")))
    return pairs.join(side(sides[0], "n_", "a"), "a").join(side(sides[1], "o_", "b"), "b")


def decide(new: DataFrame, old: DataFrame, links: DataFrame, threshold: float = 0.7, words=L.CONTRADICTION_WORDS) -> DataFrame:
    """(a, op, target, conflict) for each new record. The target is the first old record, in stored order, that shares an
    entity, is similar beyond the threshold and contradicted. UPDATE, NOOP or ADD by the conflict score; ADD without a target."""
    p = paired(new, old, links, word_tokens, threshold).where(jaccard(F.col("n_tokens"), F.col("o_tokens")) > threshold).where(R.contradictory(F.col("n_content"), F.col("n_created_s"), F.col("o_created_s"), words))
    score = R.conflict_score(*(F.col(c) for c in ("n_created_s", "o_created_s", "n_confidence", "o_confidence", "n_ownership", "o_ownership")))
    target = p.groupBy("a").agg(F.min_by(F.struct("b", score.alias("s")), F.struct("o_ord", "b")).alias("t"))
    action = R.conflict_action(F.col("t.s"))
    op = F.when(action == "UPDATE", "UPDATE").when(action == "KEEP", "NOOP").otherwise("ADD")
    return new.select(F.col("mid").alias("a")).join(target, "a", "left").select("a", F.when(F.col("t").isNull(), "ADD").otherwise(op).alias("op"), F.col("t.b").alias("target"), F.col("t.s").alias("conflict"))


def apply_decisions(old: DataFrame, new: DataFrame, decisions: DataFrame) -> DataFrame:
    """The next version of the stored records: the last update of a target wins, its score is the larger one; ADDs are appended."""
    d = decisions.where("op = 'UPDATE'").join(new.select(F.col("mid").alias("a"), F.col("content").alias("c"), F.col("importance").alias("i"), F.col("score").alias("s"), F.col("ord").alias("o")), "a")
    last = d.groupBy(F.col("target").alias("mid")).agg(F.max_by(F.struct("c", "i"), F.struct("o", "a")).alias("u"), F.max("s").alias("s"))
    kept = old.join(last, "mid", "left").withColumn("content", F.coalesce("u.c", "content")).withColumn("importance", F.coalesce("u.i", "importance")).withColumn("score", F.greatest("score", "s")).select(*old.columns)
    added = new.join(decisions.where("op = 'ADD'").select(F.col("a").alias("mid")), "mid", "left_semi")
    return kept.unionByName(added.select(*old.columns))


def _block_rows(records: DataFrame, links: DataFrame, tokens: Column, flag: Column) -> DataFrame:
    """Records with an entity, as blocks take them: mid, ord, flag, tokens and entities (ids as rows have them, absent orders first)."""
    names = links.groupBy("mid").agg(F.collect_set("entity").alias("names"))
    rows = records.join(names, "mid")  # tokens come after: the text is less to shuffle
    return rows.select("mid", F.coalesce(F.col("ord").cast("long"), F.lit(-(1 << 63))).alias("ord"), flag.cast("int").alias("flag"), tokens.alias("tokens"), "names")


def _in_blocks(new: DataFrame, old: DataFrame, judge, schema: str, name: str) -> DataFrame:
    """What judge gives for all blocks of new and old records (as _block_rows has them), written once to the shared folder."""
    new, old = stored(new, f"{name}-new"), stored(old, f"{name}-old")
    sizes = blocks.sides_of((new.count(), old.count()), (16384, 32768))
    return stored(blocks.grid(new, old, sizes, "mid", judge, schema), name)


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by([("ord", "ascending"), ("mid", "ascending")])


def _sizes(table: pa.Table) -> np.ndarray:
    return table["tokens"].combine_chunks().value_lengths().fill_null(0).to_numpy()


def _like_blocks(new: pa.Table, old: pa.Table, least: float) -> pa.Table:
    """J07 for two blocks: a new record's first duplicate (b not null, n null), and an old record's downgrades: how many by a tier, and the
    last one's order, id and tier."""
    new, old = _ordered(new), _ordered(old)
    tokens, names = (blocks.Sets(new[c], old[c]) for c in ("tokens", "names"))
    need = [blocks.least_common(_sizes(t), lambda x: x >= least) for t in (new, old)]
    tier = new["flag"].to_numpy(zero_copy_only=False)
    a, b, oa, ob = new["mid"].to_numpy(), old["mid"].to_numpy(), new["ord"].to_numpy(), old["ord"].to_numpy()
    counts, last = np.zeros((2, len(b)), np.int64), np.full(len(b), -1)
    first = []
    for low, high in blocks.tiles(len(a), len(b)):
        like = tokens.common(low, high) >= np.minimum(need[0][low:high, None], need[1][None])
        like &= names.common(low, high) > 0
        kind = tier[low:high]
        dup = np.flatnonzero((kind == 0) & like.any(1))
        at = like[dup].argmax(1)
        first.append((a[low:high][dup], b[at], ob[at]))
        for t in (1, 2):
            counts[t - 1] += like[kind == t].sum(0)
        over = np.flatnonzero(kind > 0)
        if len(over):
            hit = like[over[::-1]]
            some = hit.any(0)
            last[some] = low + over[::-1][hit.argmax(0)[some]]
    fa, fb, fo = (np.concatenate(x) for x in zip(*first, strict=True))
    got = np.flatnonzero(last >= 0)
    k, m = len(fa), len(got)
    column = lambda x, y, kind: pa.array(np.concatenate([x, y]), kind)
    none = lambda n: np.zeros(n, np.int64)
    return pa.table({
        "down": pa.array(np.arange(k + m) >= k), "a": column(fa, a[last[got]], pa.int64()), "b": column(fb, b[got], pa.int64()), "o": column(fo, oa[last[got]], pa.int64()),
        "tier": column(none(k), tier[last[got]], pa.int32()), "n1": column(none(k), counts[0][got], pa.int64()), "n2": column(none(k), counts[1][got], pa.int64()),
    })


def overlap_dedup(new: DataFrame, old: DataFrame, links: DataFrame, least: float = 0.3, tier1=L.OVERRIDE_TIER1, tier2=L.OVERRIDE_TIER2, penalties=(0.1, 0.4)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(inserts, updates, downgrades). A new record like an old one (containment or overlap) is its duplicate, unless it
    carries an override signal: then the old one is downgraded. All are judged on the input version: downgrades multiply.

    An overlap of 0.3 of the smaller set leaves nearly all records of a common entity, so all records meet in blocks (see blocks) that
    give a row for each record and no pairs. A text inside another shares all its tokens but the first and the last, so only texts of few
    tokens meet by their letters.
    """
    tokens = mixed_tokens(F.lower("content"))
    tier = R.override_tier(F.col("content"), tier1, tier2)
    rows = [_block_rows(df, links, tokens, kind) for df, kind in ((new, F.coalesce(tier, F.lit(0))), (old, F.lit(0)))]
    met = _in_blocks(*rows, partial(_like_blocks, least=least), "down boolean, a long, b long, o long, tier int, n1 long, n2 long", "overlaps")
    small = math.ceil(2 / (1 - least)) if least < 1 else 2**31 - 1
    few = [df.where(F.size(tokens) < small).select("mid", "content") for df in (new, old)]
    inside = contained_pairs(few[0], old, links).toDF("a", "b").unionByName(contained_pairs(few[1], new, links).toDF("b", "a")).distinct()
    texts = [df.select(F.col("mid").alias(k), tokens.alias(f"t_{k}"), F.col("ord").cast("long").alias(f"o_{k}")) for df, k in ((new, "a"), (old, "b"))]
    inside = inside.join(texts[0], "a").join(texts[1], "b").where(overlap_coefficient(F.col("t_a"), F.col("t_b")) < least)
    dup = met.where("NOT down").select("a", "b", "o").unionByName(inside.select("a", "b", F.coalesce("o_b", F.lit(-(1 << 63))).alias("o")))
    first = dup.groupBy("a").agg(F.min_by("b", F.struct("o", "b")).alias("b"))
    inserts = new.join(first.select(F.col("a").alias("mid")), "mid", "left_anti")
    side = lambda df, p, k, *columns: df.select(F.col("mid").alias(k), *(F.col(c).alias(p + c) for c in columns))
    better = first.join(side(new, "n_", "a", "content", "importance", "score", "ord"), "a").join(side(old, "o_", "b", "importance", "score"), "b").where(F.col("n_importance") > F.col("o_importance"))
    updates = better.groupBy(F.col("b").alias("mid")).agg(F.max_by("n_content", F.struct("n_ord", "a")).alias("content"), F.max_by("n_importance", F.struct("n_ord", "a")).alias("importance"), F.greatest(F.max("o_score"), F.max("n_score")).alias("score"))
    down = met.where("down").groupBy(F.col("b").alias("mid")).agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"), F.max_by("tier", F.struct("o", "a")).alias("override_tier"))
    factor = F.pow(F.lit(penalties[0]), F.col("n1")) * F.pow(F.lit(penalties[1]), F.col("n2"))
    downgrades = down.join(old.select("mid", F.col("score").alias("_s")), "mid").select("mid", (F.col("_s") * factor).alias("score"), "override_tier", (F.col("n1") + F.col("n2")).alias("n"))
    return inserts, updates, downgrades


def _verdict_blocks(new: pa.Table, old: pa.Table) -> pa.Table:
    """J08 for two blocks: a belief's first fact that confirms or contradicts it."""
    old = _ordered(old)
    tokens, names = (blocks.Sets(new[c], old[c]) for c in ("tokens", "names"))
    sure, some = (blocks.least_common(_sizes(new), lambda x, s=share: x > s) for share in (0.5, 0.3))
    negated = [t["flag"].to_numpy() for t in (new, old)]
    a, b, ob = new["mid"].to_numpy(), old["mid"].to_numpy(), old["ord"].to_numpy()
    out = []
    for low, high in blocks.tiles(len(a), len(b)):
        common = tokens.common(low, high)
        other = negated[0][low:high, None] != negated[1][None]
        hit = (common >= sure[low:high, None]) | (other & (common >= some[low:high, None]))
        hit &= names.common(low, high) > 0
        got = np.flatnonzero(hit.any(1))
        at = hit[got].argmax(1)
        out.append((a[low:high][got], b[at], ob[at], common[got, at] >= sure[low:high][got]))
    return pa.table(dict(zip(("a", "b", "o", "confirmed"), (pa.array(np.concatenate(x)) for x in zip(*out, strict=True)), strict=True)))


def verify_beliefs(beliefs: DataFrame, facts: DataFrame, links: DataFrame, negations=L.BELIEF_NEGATIONS) -> DataFrame:
    """(mid, verdict, fact, confidence): the first fact, in stored order, that shares an entity and confirms (overlap over
    half) or contradicts (one side negated, overlap over 0.3) the belief; else unchanged. All beliefs and facts meet in blocks."""
    rows = (_block_rows(df, links, whitespace_words(F.col("content")), F.coalesce(any_of(F.lower("content"), negations), F.lit(False))) for df in (beliefs, facts))
    hit = _in_blocks(*rows, _verdict_blocks, "a long, b long, o long, confirmed boolean", "verdicts")
    first = hit.groupBy(F.col("a").alias("mid")).agg(F.min_by(F.struct(F.when(F.col("confirmed"), "confirmed").otherwise("contradicted").alias("verdict"), "b"), F.struct("o", "b")).alias("v"))
    confidence = F.when(F.col("v.verdict") == "confirmed", 1.0).when(F.col("v.verdict") == "contradicted", F.greatest(F.lit(0.1), F.coalesce("confidence", F.lit(0.6)) - 0.3)).otherwise(F.col("confidence"))
    return beliefs.join(first, "mid", "left").select("mid", F.coalesce("v.verdict", F.lit("unchanged")).alias("verdict"), F.col("v.b").alias("fact"), confidence.alias("confidence"))


def supersede(memories: DataFrame, decisions: DataFrame, as_of_s: int) -> DataFrame:
    """Losers of an UPDATE are superseded and archived, winners get the lineage. decisions: (a, op, target)."""
    up = decisions.where("op = 'UPDATE'")
    lost = up.groupBy(F.col("target").alias("mid")).agg(F.max("a").alias("superseded_by"))
    won = up.groupBy(F.col("a").alias("mid")).agg(F.array_sort(F.collect_set(F.col("target").cast("string"))).alias("supersedes"))
    out = memories.join(lost, "mid", "left").join(won, "mid", "left")
    return out.withColumn("superseded", F.col("superseded_by").isNotNull()).withColumn("state", F.when(F.col("superseded"), 1).otherwise(0)).withColumn("conflict_resolved_s", F.when(F.col("supersedes").isNotNull(), F.lit(as_of_s)))


def close_relations(relations: DataFrame) -> DataFrame:
    """Relations (subject, relation_type, object, ts): all but the newest of a subject and type are superseded.

    The newest is found by an aggregate, so a subject with very many rows is not gathered in one place.
    """
    newest = relations.groupBy("subject", "relation_type").agg(F.max(F.struct("ts", "rid")).alias("top"))
    return relations.join(newest, ["subject", "relation_type"]).withColumn("superseded", F.struct("ts", "rid") != F.col("top")).drop("top")


def top_facts(facts: DataFrame, links: DataFrame, identity: Column, k: int = 5, most_identity: int = 3, others: int = 2) -> DataFrame:
    """(entity, mid, pos) of each entity's facts for its summary: the k most important, identity facts first."""
    f = links.join(facts.select("mid", "content", "importance", identity.alias("is_identity")), "mid")
    by = Window.partitionBy("entity").orderBy(F.desc("importance"), "mid")
    id_rank = Window.partitionBy("entity").orderBy("mid")
    top = f.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k)
    ident = f.where("is_identity").withColumn("r", F.row_number().over(id_rank)).where(F.col("r") <= most_identity)
    has = ident.select("entity").distinct().withColumn("has", F.lit(True))
    rest = top.join(has, "entity", "left").withColumn("has", F.coalesce("has", F.lit(False)))
    plain = rest.where("NOT has").withColumn("pos", F.col("r"))
    other = rest.where("has AND NOT is_identity").withColumn("r2", F.row_number().over(Window.partitionBy("entity").orderBy("r"))).where(F.col("r2") <= others).withColumn("pos", F.col("r2") + most_identity)
    cols = ["entity", "mid", "content", "importance", "pos"]
    return plain.select(*cols).unionByName(ident.withColumn("pos", F.col("r")).select(*cols)).unionByName(other.select(*cols))


def summaries(facts: DataFrame, links: DataFrame, last: DataFrame, as_of_s: int, identity: Column, trigger: int = 3, again: int = 8, days: int = 7) -> DataFrame:
    """A summary for each entity with enough facts: first time from `trigger`, again from `again` facts if the last one
    (entity, created_s) is so many days old. content, importance, source_facts, n_facts, is_reflection."""
    counts = links.join(facts.select("mid"), "mid", "left_semi").groupBy("entity").agg(F.count(F.lit(1)).alias("n_facts"))
    due = counts.join(last.groupBy("entity").agg(F.max("created_s").alias("last_s")), "entity", "left")
    fresh = F.col("last_s").isNull() & (F.col("n_facts") >= trigger)
    old = F.col("last_s").isNotNull() & (F.col("n_facts") >= again) & (floor_days(F.lit(as_of_s), F.col("last_s")) >= days)
    due = due.where(fresh | old)
    body = top_facts(facts, links, identity).groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("pos", "mid", F.substring("content", 1, 40).alias("c")))).alias("t"), F.avg("importance").alias("importance"))
    text = F.array_join(F.transform("t", lambda x: x["c"]), "; ")
    ids = F.transform("t", lambda x: x["mid"])
    return due.join(body, "entity").select("entity", "n_facts", F.col("last_s").isNotNull().alias("is_reflection"), text.alias("content"), "importance", ids.alias("source_facts"))


def profiles(memories: DataFrame, links: DataFrame) -> DataFrame:
    """An entity's profile as rows (entity, mtype, mid, n), n its number of facts and beliefs. Rows, not lists: an entity
    of very many records is never gathered."""
    rows = links.join(memories.select("mid", "mtype"), "mid")
    counts = rows.groupBy("entity").agg(F.count_if(F.col("mtype").isin("fact", "belief")).alias("n"))
    return rows.join(counts, "entity").select("entity", "mtype", "mid", "n")


# --- forms from the design notes ---------------------------------------------------------------------------------------


def hard_ttl(memories: DataFrame, as_of_s: int, below: float = 0.3, days: int = 7) -> DataFrame:
    """Rows that stay: not both unimportant and older than so many days."""
    return memories.where(~((F.col("importance") < below) & (floor_days(F.lit(as_of_s), F.col("created_s")) > days)))


def vote(versions: DataFrame, as_of_s: int, rate: float = 0.01) -> DataFrame:
    """For each entity and attribute the value of the largest sum of score * exp(-rate * days)."""
    weight = R.time_decay(F.col("score"), floor_days(F.lit(as_of_s), F.col("created_s")), rate)
    sums = versions.groupBy("entity", "attribute", "value").agg(F.round(F.sum(weight), 6).alias("votes"))
    return sums.groupBy("entity", "attribute").agg(F.max(F.struct("votes", "value")).alias("t")).select("entity", "attribute", "t.value", "t.votes")


def merge_attributes(rows: DataFrame, classes: dict[str, tuple], links: DataFrame) -> DataFrame:
    """(entity, attribute, mid, created_s, content, newest): an attribute's newest record and, as rows, its history."""
    attribute = None
    for name, words in classes.items():
        hit = any_of(F.col("content"), words)
        attribute = F.when(hit, name) if attribute is None else attribute.when(hit, name)
    r = rows.select("mid", "created_s", "content", attribute.alias("attribute")).where("attribute IS NOT NULL").join(links, "mid")
    last = r.groupBy("entity", "attribute").agg(F.max(F.struct("created_s", "mid")).alias("last"))
    newest = F.struct("created_s", "mid") == F.col("last")
    return r.join(last, ["entity", "attribute"]).select("entity", "attribute", "mid", "created_s", "content", newest.alias("newest"))


def deny(beliefs: DataFrame, verdicts: DataFrame, step: float = 0.3, least: float = 0.2) -> DataFrame:
    """Contradicted beliefs lose confidence and go below the least."""
    bad = verdicts.where("verdict = 'contradicted'").select("mid", F.lit(True).alias("bad"))
    out = beliefs.join(bad, "mid", "left").withColumn("confidence", F.when(F.col("bad"), F.col("confidence") - step).otherwise(F.col("confidence")))
    return out.where(F.col("confidence") >= least).drop("bad")


def accessed_bonus(memories: DataFrame, today: DataFrame, bonus: float = 0.1) -> DataFrame:
    """Rows accessed today gain a bonus instead of decaying. today: (mid)."""
    hit = today.select("mid").distinct().withColumn("hit", F.lit(True))
    plain = R.plain_decay(F.col("score"), F.col("importance"), F.col("mtype"))
    return memories.join(hit, "mid", "left").withColumn("score", F.when(F.col("hit"), F.col("score") + bonus).otherwise(plain)).drop("hit")


def reactivate(memories: DataFrame, hits: DataFrame, score: float = 0.3) -> DataFrame:
    """Archived rows (state 1) that were hit become active again with a fixed score."""
    hit = hits.select("mid").distinct().withColumn("hit", F.lit(True))
    back = F.coalesce(F.col("hit") & (F.col("state") == 1), F.lit(False))
    return memories.join(hit, "mid", "left").withColumn("score", F.when(back, score).otherwise(F.col("score"))).withColumn("state", F.when(back, 0).otherwise(F.col("state"))).drop("hit")


def incremental_decay(memories: DataFrame, as_of_s: int, days: int = 7) -> DataFrame:
    """Decay of rows that are dirty or were computed more than so many days ago; the others keep their score."""
    due = F.col("dirty") | (floor_days(F.lit(as_of_s), F.col("computed_s")) > days)
    new = R.protected_decay(F.col("score"), F.col("importance"), F.col("mtype"), F.col("last_accessed_s"), F.lit(as_of_s))
    return memories.withColumn("score", F.when(due, new).otherwise(F.col("score"))).withColumn("computed_s", F.when(due, F.lit(as_of_s)).otherwise(F.col("computed_s")))


def stable_decisions(decisions: DataFrame, key: str, order: list[str], n: int = 3) -> DataFrame:
    """Skip: were the last n decisions before this one all by rule?"""
    w = Window.partitionBy(key).orderBy(*order)
    past = [F.coalesce(F.lag("method", i).over(w) == "rule", F.lit(False)) for i in range(1, n + 1)]
    skip = past[0]
    for p in past[1:]:
        skip = skip & p
    return decisions.withColumn("skip", skip)
