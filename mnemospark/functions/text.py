"""Column functions: tokens, ids, similarities, day arithmetic. All are JVM expressions."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import STOP_WORDS

HAN = "[\\x{4e00}-\\x{9fff}]"


def any_of(text: Column, words) -> Column:
    """Does text contain one of the words?"""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words), F.lit(False))


def any_of_lower(text: Column, words) -> Column:
    """Does the lower-cased text contain one of the words? Words without case are sought in the text as it is."""
    plain = [w for w in words if w.lower() == w == w.upper()]
    cased = [w for w in words if w not in plain]
    return any_of(text, plain) | any_of(F.lower(text), cased) if cased else any_of(text, plain)


def matches(text: Column, patterns, flags: str = "") -> Column:
    """Does one of the patterns match somewhere? One alternation, so one pass; a leading .* adds nothing to a search."""
    return text.rlike(flags + "|".join(f"(?:{p.removeprefix('.*')})" for p in patterns)) if patterns else F.lit(False)


def found_words(text: Column, words) -> Column:
    """The words that text contains, in lexicon order."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def mixed_tokens(text: Column) -> Column:
    """ASCII words, Han characters and pairs of neighbouring Han characters, distinct."""
    han = extract_all(text, HAN)
    pairs = F.when(F.size(han) >= 2, F.zip_with(F.slice(han, 1, F.size(han) - 1), F.slice(han, 2, F.size(han) - 1), lambda a, b: F.concat(a, b))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(extract_all(text, "[a-zA-Z]+"), pairs, han))


def word_tokens(text: Column, stop_words=STOP_WORDS) -> Column:
    """Lower-cased words of two characters or more that aren't stop words, distinct."""
    words = F.split(F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " "))), r"\s+")
    stop = F.array(*map(F.lit, stop_words)) if stop_words else F.array().cast("array<string>")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w)))


def index_keywords(text: Column) -> Column:
    """Keywords of the inverted index, distinct."""
    mixed = F.transform(extract_all(text, r"[a-zA-Z0-9][-a-zA-Z0-9.]+"), F.lower)
    return F.array_distinct(F.concat(mixed, extract_all(text, HAN + "{2,}"), F.transform(extract_all(text, "[a-zA-Z]{2,}"), F.lower)))


def query_shingles(query: Column, sizes=(2, 3, 4)) -> Column:
    """The whole query and all its substrings of the given sizes, distinct; shorter ones than two characters give none."""
    n = F.length(query)
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.transform(F.array(*map(F.lit, sizes)), lambda k: F.substring(query, i, k))))
    starts = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.transform(F.array(*map(F.lit, sizes)), lambda k: i + k - 1 <= n)))
    full = F.filter(F.zip_with(parts, starts, lambda p, ok: F.when(ok, p)), lambda p: p.isNotNull())
    return F.when(n >= 2, F.array_distinct(F.concat(F.array(query), full))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """P10: similarity of two token sets; 0 when either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set's size (at least 1)."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))


def prefix_length(a: Column, b: Column) -> Column:
    return F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))


def entity_similarity(a: Column, b: Column) -> Column:
    """1 if equal; the common prefix's share if half or more; the length ratio if one contains the other; else edit similarity."""
    longest, shortest = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    share = prefix_length(a, b) / longest
    return (
        F.when(a == b, F.lit(1.0)).when((longest > 0) & (share >= 0.5), share)
        .when(F.contains(a, b) | F.contains(b, a), shortest / longest)
        .otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - F.levenshtein(a, b) / longest))
    )


def suffix_type(s: Column) -> Column:
    """P13."""
    return (
        F.when(s == "", "empty").when(s.rlike(r"^\p{Nd}+$"), "digit").when(s.rlike("^[A-Z]$"), "single_upper")
        .when(s.rlike("^[A-Z]{2,3}$"), "multi_upper").when(s.rlike("^[a-z]+$"), "lower").otherwise("mixed")
    )


def floor_days(later, earlier: Column) -> Column:
    """Whole days between two times in epoch seconds, rounded down."""
    return F.floor((later - earlier) / 86400)


def record_id(prefix: Column, content: Column, created_s: Column, digits: int = 16) -> Column:
    """{prefix}_{yyyymmdd}_{md5 start}; digits=6 gives the short form, which collides at scale."""
    return F.concat(prefix, F.lit("_"), F.date_format(F.timestamp_seconds(created_s), "yyyyMMdd"), F.lit("_"), F.substring(F.md5(content), 1, digits))


def id_in_text(text: Column) -> Column:
    """The record id that a search hit's snippet holds in brackets, else ''."""
    return F.regexp_extract(text, r"\[([fbs]_\d{8}_[a-f0-9]+)\]", 1)


def whitespace_words(text: Column) -> Column:
    """Distinct words of lower-cased text, split at white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))
