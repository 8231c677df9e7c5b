"""Entities: extraction, learning, similarity, inhibition."""

import math
from collections.abc import Callable, Iterator
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import any_of, entity_similarity, extract_all, prefix_length, suffix_type
from ..sources.io import stored
from . import blocks


def links(memories: DataFrame, entities: Column, least: int = 2) -> DataFrame:
    """(mid, entity) pairs, distinct: the n:m link table."""
    return memories.select("mid", F.explode(entities).alias("entity")).where(F.length("entity") >= least).distinct()


def suppress_contained(entities: Column) -> Column:
    """Entities that no longer entity of the list contains."""
    return F.filter(entities, lambda e: ~F.exists(entities, lambda o: (o != e) & F.contains(o, e)))


def rule_entities(content: Column, fixed=L.FIXED_ENTITIES, numbered=L.NUMBERED_ENTITIES, quotes=L.QUOTES, learned: Column | None = None) -> Column:
    """Quoted spans, fixed words, capitalised words, numbered names and project names, without contained ones.

    Project names count only where they hold no capitalised word, which has taken their place before. Quoted spans are cut
    out first; where quotes of two kinds interleave, spans are read kind by kind in the text as it is.
    """
    empty = F.array().cast("array<string>")
    quoted, rest = empty, content
    for q in quotes:
        quoted = F.concat(quoted, extract_all(content, q, 1))
        rest = F.regexp_replace(rest, q.replace("(", "(?:"), "\n")
    people = extract_all(rest, "[A-Z][a-z]+")
    projects = F.filter(extract_all(rest, "[A-Z][a-zA-Z0-9-]+"), lambda m: ~m.rlike("[A-Z][a-z]"))
    own = F.flatten(F.array(*(extract_all(rest, p) for p in numbered))) if numbered else empty
    words = F.filter(F.array(*map(F.lit, fixed)), lambda w: F.contains(content, w)) if fixed else empty
    parts = [quoted, words, people, projects, own] + ([learned] if learned is not None else [])
    return F.array_sort(suppress_contained(F.array_distinct(F.filter(F.concat(*parts), lambda e: F.length(e) > 1))))


def builtin_entities(content: Column, patterns=L.BUILTIN_ENTITIES) -> Column:
    """All matches of the built-in patterns, case-insensitive, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*(extract_all(content, f"(?i){p}") for p in patterns)))))


def learned_matches(memories: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(mid, entity) for learned entities that a content contains, for each row of memories.

    One equi join whatever the dictionary's size: an entity without white space lies in a content if and only if it lies in
    one of its tokens, so distinct tokens are exploded to substrings of the lengths that such entities have. For entities with
    white space, contents are.
    """
    names = dictionary.select("entity").where(F.length("entity") > 0).distinct()
    spaced = F.col("entity").rlike(r"\s")
    rows = memories.select("mid", F.xxhash64("content").alias("c"), F.col("content").alias("t"))
    own = F.filter(F.array_distinct(F.split("t", r"\s+")), lambda t: F.arrays_overlap(F.split(t, ""), F.col("heads")))
    tokens = rows.crossJoin(F.broadcast(_shape(names.where(~spaced)))).select("mid", "c", F.explode(own).alias("t"))
    pairs = _contained(tokens.select("t").distinct(), names.where(~spaced)).select("t", "entity")
    found = tokens.join(pairs, "t").select("mid", "c", "entity").unionByName(_contained(rows, names.where(spaced)).select("mid", "c", "entity")).distinct()
    again = rows.groupBy("mid", "c").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    times = F.coalesce(again["times"], F.lit(1).cast("long"))
    on = found["mid"].eqNullSafe(again["mid"]) & (found["c"] == again["c"])
    return found.join(again, on, "left").select(found["mid"], "entity", F.explode(F.sequence(F.lit(1).cast("long"), times))).select("mid", "entity")


def _shape(names: DataFrame) -> DataFrame:
    """One row: the lengths and the first characters that names have."""
    return names.agg(F.collect_set(F.length("entity")).alias("lengths"), F.collect_set(F.substring("entity", 1, 1)).alias("heads"))


def _contained(texts: DataFrame, names: DataFrame) -> DataFrame:
    """texts' columns and entity for the names that text t contains: an equi join on substrings of the lengths that names have."""
    sized = texts.crossJoin(F.broadcast(_shape(names))).withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.length("t"))))
    parts = F.transform(F.sequence(F.lit(1), F.length("t") - F.col("n") + 1), lambda i: F.substring("t", i, F.col("n")))
    parts = F.filter(parts, lambda p: F.array_contains("heads", F.substring(p, 1, 1)))
    return sized.select(*texts.columns, F.explode(F.array_distinct(parts)).alias("entity")).join(names, "entity")


def layered(builtin: Column, learned: Column, external: Column) -> Column:
    """The first layer that found something, with its name."""
    value = lambda es, name: F.struct(es.alias("entities"), F.lit(name).alias("source"))
    return F.when(F.size(builtin) > 0, value(builtin, "builtin")).when(F.size(learned) > 0, value(learned, "learned")).when(F.size(external) > 0, value(external, "external")).otherwise(value(builtin, "none"))


def with_external(rows: DataFrame, extractor: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows (mid, content, builtin, learned) with the entities and the layer they come from. Only rows that no layer has
    anything for go to the extractor, a function on a DataFrame that adds `reply`, a JSON array of names; what doesn't parse
    counts as none."""
    open_ = (F.size("builtin") == 0) & (F.size("learned") == 0)
    names = F.coalesce(F.from_json("reply", "array<string>"), F.array().cast("array<string>"))
    asked = extractor(rows.where(open_)).withColumn("external", names).drop("reply")
    every = rows.where(~open_).withColumn("external", F.array().cast("array<string>")).unionByName(asked.select(*rows.columns, "external"))
    return every.withColumn("v", layered(F.col("builtin"), F.col("learned"), F.col("external"))).select("mid", "v.entities", "v.source")


def learn(seen: DataFrame, known: DataFrame, as_of_s: int, limit: int = 1000) -> DataFrame:
    """New rows (entity, first_seen_s, last_used_s, use_count) for unseen entities, most frequent first, up to the limit
    less those known. seen: (entity); known: (entity)."""
    room = max(0, limit - known.count())
    fresh = seen.join(known.select("entity"), "entity", "left_anti").groupBy("entity").agg(F.count(F.lit(1)).alias("use_count"))
    kept = fresh.orderBy(F.desc("use_count"), "entity").limit(room)
    return kept.select("entity", F.lit(as_of_s).cast("long").alias("first_seen_s"), F.lit(as_of_s).cast("long").alias("last_used_s"), "use_count")


def prefix_nodes(names: DataFrame) -> DataFrame:
    """(prefix, n, lo, hi, kinds, shortest, longest) of every prefix of names (e): how many names have it, the least and the greatest
    of them, and the kinds and lengths of what follows it. Linear in the names' characters; no pairs of names."""
    rows = names.where(F.length("e") > 0).select("e", F.explode(F.sequence(F.lit(1), F.length("e"))).alias("h"))
    rest = F.expr("substring(e, h + 1)")
    return rows.groupBy(F.substring("e", F.lit(1), F.col("h")).alias("prefix")).agg(
        F.count(F.lit(1)).alias("n"), F.min("e").alias("lo"), F.max("e").alias("hi"), F.collect_set(suffix_type(rest)).alias("kinds"), F.min(F.length(rest)).alias("shortest"), F.max(F.length(rest)).alias("longest")
    )


def generalise(new: DataFrame, existing: DataFrame, least: int = 3) -> DataFrame:
    """(entity, pattern) for new entities that share a prefix of at least half their length with enough existing ones.

    Names meet at prefix nodes only: a new name's half prefix has a node with the number and the ends of the names below it; the
    prefix that the ends share with the new name is a node again, and all these names are below it, so its kinds are theirs.
    """
    nodes = stored(prefix_nodes(existing.select(F.col("entity").alias("e"))), "prefixes")
    half = F.ceil(F.length("entity") / 2).cast("int")
    ends = new.select("entity", F.substring("entity", F.lit(1), half).alias("prefix")).join(nodes.select("prefix", "n", "lo", "hi"), "prefix", "left")
    ends = ends.select("entity", (F.coalesce("n", F.lit(0)) + 1).alias("n"), F.least("entity", "lo").alias("lo"), F.greatest("entity", "hi").alias("hi")).where(F.col("n") >= least)
    ends = ends.select("entity", F.substring("lo", F.lit(1), prefix_length(F.col("lo"), F.col("hi"))).alias("prefix"))
    own = F.expr("substring(entity, length(prefix) + 1)")
    met = ends.join(nodes.select("prefix", "kinds", "shortest", "longest"), "prefix", "left")
    kinds = F.array_union(F.coalesce("kinds", F.array().cast("array<string>")), F.array(suffix_type(own)))
    one = met.select("entity", "prefix", kinds.alias("k"), F.least("shortest", F.length(own)).alias("a"), F.greatest("longest", F.length(own)).alias("b"))
    one = one.where((F.size("k") == 1) & (F.length("prefix") > 0)).withColumn("k", F.col("k")[0])
    several = F.when(F.col("a") == F.col("b"), F.format_string("[A-Z]{%d}", "a")).otherwise(F.format_string("[A-Z]{%d,%d}", "a", "b"))
    tail = F.when(F.col("k") == "digit", "\\d+").when(F.col("k") == "single_upper", "[A-Z]").when(F.col("k") == "multi_upper", several).when(F.col("k") == "lower", "[a-z]+")
    escaped = F.regexp_replace("prefix", r"([^\p{L}\p{N}_])", r"\\$1")
    return one.select("entity", F.concat(escaped, tail).alias("pattern")).where("pattern IS NOT NULL")


def use(learned: DataFrame, hits: DataFrame) -> DataFrame:
    """Learned rows with the hits' counts added; hits: (entity, ts_s). Entities without a row get one."""
    counted = hits.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.min("ts_s").alias("lo"), F.max("ts_s").alias("hi"))
    return learned.join(counted, "entity", "full").select(
        "entity", F.coalesce("first_seen_s", "lo").alias("first_seen_s"), F.greatest("last_used_s", "hi").alias("last_used_s"), (F.coalesce("use_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("use_count")
    )


def cleanup(learned: DataFrame, as_of_s: int, days: int = 365) -> DataFrame:
    """Learned rows used or first seen within so many days."""
    return learned.where(F.coalesce("last_used_s", "first_seen_s") >= as_of_s - days * 86400)


def merge_external(rules: DataFrame, external: DataFrame) -> DataFrame:
    """Union of rule and external entities; both (mid, entities)."""
    found = external.select("mid", F.col("entities").alias("x"))
    empty = F.array().cast("array<string>")
    return rules.join(found, "mid", "left").select("mid", F.array_sort(F.array_union("entities", F.coalesce("x", empty))).alias("entities"))


def _grams(name: Column) -> Column:
    """The two-letter parts of a name between border marks, with their places."""
    whole = F.concat(F.lit("\x01"), name, F.lit("\x02"))
    return F.transform(F.sequence(F.lit(1), F.length(name) + 1), lambda i: F.struct(F.substring(whole, i, F.lit(2)).alias("g"), i.alias("i")))


def _bag(name: Column) -> Column:
    """A name's letters, each with its number among the equal ones before it: common ones of two bags are common letters."""
    letters = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.substring(name, i, F.lit(1)))
    return F.transform(letters, lambda x, i: F.concat(x, F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda y: y == x)).cast("string")))


#: Letters of the longest names that meet in blocks: their edits are counted in words of 64 bits.
WORD = 64
#: Names that are read at a time, bytes of each table of their edits (some of them fit a core's cache) and pairs of a piece of the result.
TEXTS, STATES, PIECE = 256, 1 << 17, 1 << 15


def near_names(queries: DataFrame, candidates: DataFrame | None, threshold: float) -> DataFrame:
    """(q, e, similarity) of unequal names that may be at most D = floor((1 - threshold) * L) edits apart, L the longer one's length, for
    thresholds of 0.5 or more. candidates None: the queries themselves, of which each two are compared once.

    Names of up to WORD letters meet in blocks (see _near_blocks), all of them with all, and only pairs that are near leave a task, with
    their similarity; the others, if there are any, meet by _near_long. Both sides are written once to the shared folder; the pairs, whose
    number grows with the square of the names, aren't."""
    asked = stored(queries.where(F.length("q") > 0).select("q"), "queries")
    every = asked.select(F.col("q").alias("e")) if candidates is None else stored(candidates.where(F.length("e") > 0).select("e"), "names")
    sides = [asked, every] if candidates is not None else [asked]
    counts = [df.agg(F.count_if(F.length(df[0]) <= WORD), F.count_if(F.length(df[0]) > WORD)).first() for df in sides]
    n = [blocks.side_of(few, 16384) for few, _ in counts]
    short = [df.select(df[0].alias("name")).where(F.length("name") <= WORD) for df in sides]
    meet = partial(blocks.own_pairs, short[0], n[0]) if candidates is None else partial(blocks.all_pairs, *short, tuple(n))
    near = meet("name", partial(_near_blocks, threshold=threshold, mutual=candidates is None), "q string, e string, similarity double")
    if any(long for _, long in counts):
        far = _near_long(asked.where(F.length("q") > WORD), every, threshold)
        far = far.unionByName(_near_long(asked.where(F.length("q") <= WORD), every.where(F.length("e") > WORD), threshold))
        near = near.unionByName(far.withColumn("similarity", entity_similarity(F.col("q"), F.col("e"))))
    return near


def _near_long(queries: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """near_names by a join, which may give more.

    Such names have L + 1 - 2 D two-letter parts (with their borders) in common at least, each at places at most D apart, and
    L - D letters. They meet on such a part and the length; the few that have enough parts in common are held against their letters.
    """
    low, high = F.ceil(F.length("q") * threshold - 1e-9).cast("int"), F.floor(F.length("q") / threshold + 1e-9).cast("int")
    a = queries.where(F.length("q") > 0).select("q", F.length("q").alias("m"), F.explode(F.sequence(F.greatest(low, F.lit(1)), high)).alias("n"))
    a = a.select("q", "m", "n", F.explode(_grams(F.col("q"))).alias("x")).select("q", "m", "n", "x.g", F.col("x.i").alias("i"))
    b = candidates.where(F.length("e") > 0).select("e", F.length("e").alias("n"), F.explode(_grams(F.col("e"))).alias("x")).select("e", "n", "x.g", F.col("x.i").alias("j"))
    longest = F.greatest("m", "n")
    edits = F.floor(longest * (1 - threshold) + 1e-9)
    met = a.join(b, ["g", "n"]).where((F.col("q") != F.col("e")) & (F.abs(F.col("i") - F.col("j")) <= edits))
    met = met.groupBy("q", "e", "m", "n").agg(F.count(F.lit(1)).alias("common")).where(F.col("common") >= longest + 1 - 2 * edits)
    bags = [queries.select("q", _bag(F.col("q")).alias("qb")), candidates.select("e", _bag(F.col("e")).alias("eb"))]
    near = met.join(bags[0], "q").join(bags[1], "e").where(F.size(F.array_intersect("qb", "eb")) >= longest - edits)
    return near.select("q", "e")


class _Names:
    """Names of a block in order, so that names that begin alike follow each other, and for each length their places and letters, as
    numbers of an alphabet."""

    def __init__(self, names) -> None:
        names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
        self.names = names.take(pc.sort_indices(names))
        texts = self.names.to_pylist()
        self.sizes = np.array([len(t) for t in texts])
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.int32)
        self.letters = np.unique(self.codes)

    def spell(self, alphabet: np.ndarray) -> None:
        sizes, codes = self.sizes, np.zeros((len(self.sizes), int(self.sizes.max())), np.intp)
        codes[np.arange(codes.shape[1]) < sizes[:, None]] = np.searchsorted(alphabet, self.codes)
        places = ((n, np.flatnonzero(sizes == n)) for n in np.unique(sizes).tolist())
        self.lengths = {n: _Texts(at.astype(np.int32), codes[at, :n]) for n, at in places}


class _Texts:
    """Names of one length, as places in their block and letters."""

    def __init__(self, places: np.ndarray, codes: np.ndarray) -> None:
        self.places, self.codes, self.size = places, codes, codes.shape[1]

    @cached_property
    def tiles(self) -> list[tuple[int, int, list[tuple[np.ndarray, np.ndarray | None]]]]:
        """(low, high, steps) for TEXTS names at a time: for each letter's place the letters by which the names' distinct beginnings go on,
        and which beginnings those are, None if the same as before."""
        out = []
        for low in range(0, len(self.codes), TEXTS):
            some = self.codes[low : low + TEXTS]
            new = np.ones(some.shape, bool)
            new[1:] = np.logical_or.accumulate(some[1:] != some[:-1], axis=1)
            before, n, steps = np.zeros(len(some), np.intp), 1, []
            for j in range(self.size):
                at = np.flatnonzero(new[:, j])
                steps.append((some[at, j], before[at] if len(at) > n else None))
                before, n = np.cumsum(new[:, j]) - 1, len(at)
            out.append((low, low + len(some), steps))
        return out


def _near_texts(short: _Texts, texts: _Texts, letters: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, at, edits) of all short names and texts, which are as long or longer, that are at most so many edits apart.

    A column of a short name's table of edits is a word of bits (Myers), with the bits of the steps down (`more`, `less`); a tile of TEXTS
    texts and as many short names as fit goes on by a letter at a time, texts that begin alike as one. At the end the steps add up to the
    edits. Every pair is judged; none has to be looked for."""
    kind = next(np.dtype(k) for k in (np.uint8, np.uint16, np.uint32, np.uint64) if short.size <= 8 * np.dtype(k).itemsize)
    word, wide = kind.type, STATES // TEXTS // kind.itemsize
    memory, counts = np.empty((7, STATES), np.uint8), np.empty((2, TEXTS * wide), np.uint8)
    last = word((1 << short.size) - 1)
    for first in range(0, len(short.codes), wide):
        some = short.codes[first : first + wide]
        bits = np.zeros((letters, len(some)), kind)
        for j, row in enumerate(some.T):
            bits[row, np.arange(len(some))] |= word(1 << j)
        tables = memory[:, : TEXTS * len(some) * kind.itemsize].view(kind).reshape(7, TEXTS, len(some))
        for low, high, steps in texts.tiles:
            more, less, more2, less2, same, down, level = tables
            more[:1], less[:1] = ~word(0), 0
            for codes, before in steps:
                n = len(codes)
                if before is not None:
                    more.take(before, 0, more2[:n], "clip")
                    less.take(before, 0, less2[:n], "clip")
                    more, more2, less, less2 = more2, more, less2, less
                p, m, x, d, s, h = more[:n], less[:n], same[:n], down[:n], level[:n], more2[:n]
                bits.take(codes, 0, x, "clip")
                np.bitwise_and(x, p, d)  # d: steps of 0 along the diagonal
                d += p
                d ^= p
                d |= x
                d |= m
                np.bitwise_or(d, p, s)  # s: all but the steps of +1 along the text, h: those of -1, moved on by a place
                s ^= m
                s += s
                np.bitwise_and(d, p, h)
                h += h
                np.bitwise_and(s, d, x)
                s ^= x
                np.bitwise_or(s, h, p)
                np.bitwise_xor(d, x, m)
            p, m = more[: high - low], less[: high - low]
            p &= last
            m &= last
            up, off = (c[: p.size].reshape(p.shape) for c in counts)
            np.bitwise_count(p, up)
            np.bitwise_count(m, off)
            up -= off
            edits = up.ravel().view(np.int8)  # less the text's length
            near = np.flatnonzero(edits <= most - texts.size)
            if len(near):
                at, row = np.divmod(near.astype(np.int32), np.int32(len(some)))
                yield row + np.int32(first), at + np.int32(low), edits[near] + np.int8(texts.size)


def _alike(short: _Texts, texts: _Texts, row: np.ndarray, at: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """entity_similarity of short names and texts, which are as long or longer, that are so many edits apart."""
    m, n = short.size, texts.size
    out = np.maximum(0.0, 1.0 - np.arange(WORD + 1) / n)[edits]
    if m < n and m / n != 1.0 - (n - m) / n:  # a contained name: the same but for the last bit
        some = np.flatnonzero(edits == n - m)
        a, b = short.codes[row[some]], texts.codes[at[some]]
        out[some[np.any([(a == b[:, i : i + m]).all(1) for i in range(n - m + 1)], axis=0)]] = m / n
    half = -(-n // 2)
    if m >= half:
        some = np.flatnonzero((short.codes[row, half - 1] == texts.codes[at, half - 1]) & (short.codes[row, 0] == texts.codes[at, 0]))
        begin = np.logical_and.accumulate(short.codes[row[some]] == texts.codes[at[some], :m], axis=1).sum(1)
        out[some[begin >= half]] = begin[begin >= half] / n
    return out


def _near_pairs(q: _Names, e: _Names | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in q, place in e, similarity) of two blocks' names that are near; e None: of each two names of q, once."""
    alphabet = q.letters if e is None else np.union1d(q.letters, e.letters)
    for names in (q, e or q):
        names.spell(alphabet)
    for m, a in q.lengths.items():
        for n, b in (e or q).lengths.items():
            most = math.floor(max(m, n) * (1 - threshold) + 1e-9)
            if abs(m - n) > most or (e is None and m > n):
                continue
            short, texts = (a, b) if m <= n else (b, a)
            for row, at, edits in _near_texts(short, texts, len(alphabet), most):
                some = row < at if a is b else edits > 0
                row, at, edits = row[some], at[some], edits[some]
                places = [short.places[row], texts.places[at]]
                yield *(places if m <= n else places[::-1]), _alike(short, texts, row, at, edits)


def _near_blocks(left: pa.Table, right: pa.Table | None, threshold: float, mutual: bool) -> Iterator[pa.RecordBatch]:
    """The pairs (q, e, similarity) of unequal names of two blocks, or of one, that are at most D edits apart (see near_names), some at a
    time; mutual: (e, q) too."""
    q, e = _Names(left["name"]), right and _Names(right["name"])
    names, others, found = q.names, (e or q).names, []

    def piece() -> pa.RecordBatch:
        i, j, s = map(np.concatenate, zip(*found, strict=True))
        found.clear()
        a, b, s = names.take(pa.array(i)), others.take(pa.array(j)), pa.array(s)
        both = [(a, b), (b, a), (s, s)] if mutual else [(a,), (b,), (s,)]
        return pa.record_batch([pa.concat_arrays(x) for x in both], ["q", "e", "similarity"])

    n = 0
    for pairs in _near_pairs(q, e, threshold):
        found.append(pairs)
        n += len(pairs[0])
        if n >= PIECE:
            yield piece()
            n = 0
    if n:
        yield piece()


def similar_pairs(queries: DataFrame, candidates: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(q, e, similarity) of unequal entities with similarity of the threshold or more. queries: (q); candidates: (e), both
    distinct; None: the queries themselves, which takes half the comparisons.

    A common prefix, a contained name and an edit distance of the threshold all bound the edits by its complement, so from 0.5 on
    near_names loses nothing. Below, an equi join on the admissible lengths is left.
    """
    if threshold >= 0.5:
        pairs = near_names(queries, candidates, threshold)
    else:
        low, high = F.ceil(F.length("q") * threshold).cast("int"), F.floor(F.length("q") / threshold).cast("int")
        a = queries.where(F.length("q") > 0).withColumn("n", F.explode(F.sequence(F.greatest(low, F.lit(1)), high)))
        b = queries.select(F.col("q").alias("e")) if candidates is None else candidates
        pairs = a.join(b.withColumn("n", F.length("e")), "n").where(F.col("q") != F.col("e")).withColumn("similarity", entity_similarity(F.col("q"), F.col("e")))
    return pairs.where(F.col("similarity") >= threshold).select("q", "e", "similarity")


def isolation_needed(query_entities: DataFrame, candidate_entities: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(qid) of queries with an entity that is like, but unequal to, an entity of their candidates.
    query_entities: (qid, q); candidate_entities: (qid, e)."""
    pairs = similar_pairs(query_entities.select("q").distinct(), candidate_entities.select("e").distinct(), threshold)
    return query_entities.join(pairs, "q").join(candidate_entities, ["qid", "e"], "left_semi").select("qid").distinct()


def inhibit(candidates: DataFrame, query_entities: DataFrame, links_: DataFrame, factor: float = 0.1, threshold: float = 0.5) -> DataFrame:
    """Candidates (qid, mid, score) without an entity of the query but with one that is like it get score * factor."""
    pairs = similar_pairs(query_entities.select("q").distinct(), links_.select(F.col("entity").alias("e")).distinct(), threshold)
    exact = query_entities.join(links_.withColumnRenamed("entity", "q"), "q").select("qid", "mid").distinct()
    close = query_entities.join(pairs, "q").select("qid", F.col("e").alias("entity")).distinct()
    near = close.join(links_, "entity").select("qid", "mid").distinct().join(exact, ["qid", "mid"], "left_anti").withColumn("inhibited", F.lit(True))
    out = candidates.join(near, ["qid", "mid"], "left").withColumn("inhibited", F.coalesce("inhibited", F.lit(False)))
    return out.withColumn("score", F.when(F.col("inhibited"), F.col("score") * factor).otherwise(F.col("score")))


def by_entities(memories: DataFrame, links_: DataFrame, wanted: DataFrame, limit: int | None = None) -> DataFrame:
    """Memories with a wanted entity and the list of those matched, best final score first. wanted: (entity)."""
    matched = links_.join(wanted.distinct(), "entity").groupBy("mid").agg(F.array_join(F.array_sort(F.collect_set("entity")), ",").alias("matched"))
    out = memories.join(matched, "mid")
    return out.orderBy(F.desc("final_score"), "mid").limit(limit) if limit else out


def hydrate(memories: DataFrame, links_: DataFrame) -> DataFrame:
    """Memories with their entity list; links are aggregated before the join, so rows don't multiply."""
    lists = links_.groupBy("mid").agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    empty = F.array().cast("array<string>")
    return memories.join(lists, "mid", "left").withColumn("entities", F.coalesce("entities", empty))


def tier3_expiry(memories: DataFrame, links_: DataFrame, active: DataFrame, as_of_s: int, days: int = 3, verbs=L.ACTION_VERBS) -> DataFrame:
    """mid and expires_s of records without expiry that mention an active entity and have no action verb."""
    hot = links_.join(active.select("entity").distinct(), "entity", "left_semi").select("mid").distinct()
    return memories.where(F.col("expires_s").isNull() & ~any_of(F.col("content"), verbs)).join(hot, "mid", "left_semi").select("mid", F.lit(as_of_s + days * 86400).cast("long").alias("expires_s"))
