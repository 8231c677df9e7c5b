"""Rule columns: noise, importance, type, urgency, time to live, complexity, scores."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .text import any_of, any_of_lower, extract_all, floor_days, found_words, matches

# --- noise ---------------------------------------------------------------------------------------------------------


def noise_reason(content: Column, importance: Column | None = None, n_entities: Column | None = None, strict: bool = False, *, patterns=L.NOISE_PATTERNS, keywords=L.NOISE_KEYWORDS, conversation=L.CONVERSATION_NOISE, distraction=L.DISTRACTION_PATTERNS, kind: Column | None = None, state: Column | None = None) -> Column:
    """Why a text is noise, else null. One cascade, so cheap tests come first and the first hit names the reason."""
    text = F.trim(content)
    importance = F.lit(0.5) if importance is None else importance
    out = (
        F.when(matches(text, patterns, "(?i)"), "pattern").when(any_of_lower(text, keywords), "keyword")
        .when(matches(text, conversation, "(?i)"), "conversation").when(matches(text, distraction, "(?i)"), "pattern")
        .when(F.length(text) < 5, "length").when(importance < 0.2, "importance")
    )
    if strict and n_entities is not None:
        out = out.when((n_entities == 0) & (importance < 0.5), "entity")
    if kind is not None:
        out = out.when(kind.isin("greeting", "farewell", "acknowledgment"), "conversation")
    if state is not None:
        out = out.when((state == "idle") & (importance < 0.3), "conversation")
    return out


def legacy_noise(content: Column, categories=L.LEGACY_NOISE) -> Column:
    """category of an anchored match on the trimmed text, the first one wins; else null."""
    text, out = F.trim(content), None
    for name, patterns in categories.items():
        hit = text.rlike("^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")$")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


# --- importance, type, urgency ----------------------------------------------------------------------------------------


def importance_class(content: Column, classes=L.IMPORTANCE_CLASSES, default: str = L.GENERAL_IMPORTANCE[0]) -> Column:
    out = None
    for name, _, words in classes:
        hit = any_of(content, words) | any_of(F.lower(content), words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def importance(content: Column, classes=L.IMPORTANCE_CLASSES, default: float = L.GENERAL_IMPORTANCE[1], boosts=L.BOOSTS, reduce=L.REDUCE) -> Column:
    """Score of the first class that matches plus the largest boost; a reducing word overrides every boost; within [0, 1]."""
    base = None
    for _, score, words in classes:
        hit = any_of(content, words) | any_of(F.lower(content), words)
        base = F.when(hit, F.lit(score)) if base is None else base.when(hit, F.lit(score))
    boost = F.when(any_of(content, reduce[1]), F.lit(reduce[0]))
    for value, words in boosts:
        boost = boost.when(any_of(content, words), F.lit(value))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), base.otherwise(F.lit(default)) + boost.otherwise(F.lit(0.0))))


def memory_type(content: Column, belief=L.BELIEF_WORDS, summary=L.SUMMARY_WORDS) -> Column:
    """Belief before summary before fact."""
    low = F.lower(content)
    return F.when(any_of(low, belief), "belief").when(any_of(low, summary), "summary").otherwise("fact")


def urgency(content: Column, critical=L.URGENT_CRITICAL, important=L.URGENT_IMPORTANT, time=L.URGENT_TIME) -> Column:
    """struct of urgent, importance and category."""
    value = lambda u, i, c: F.struct(F.lit(u).alias("urgent"), F.lit(i).alias("importance"), F.lit(c).alias("category"))
    return (
        F.when(any_of(content, critical), value(True, 0.9, "critical")).when(any_of(content, important), value(True, 0.8, "important"))
        .when(matches(content, time), value(True, 0.8, "time_sensitive")).otherwise(value(False, 0.5, ""))
    )


# --- time to live -----------------------------------------------------------------------------------------------------


def ttl_hours(content: Column, permanent=L.TTL_PERMANENT, immediate=L.TTL_IMMEDIATE, short=L.TTL_SHORT) -> Column:
    """hours of life by the strong patterns: 0 permanent, 12, 48, or null for none."""
    return F.when(matches(content, permanent), 0).when(matches(content, immediate), 12).when(matches(content, short), 48)


def sensed_hours(content: Column, sensor=L.TIME_SENSOR) -> Column:
    """hours of life by time words; null is permanent."""
    out = None
    for hours, words in sensor:
        hit = any_of(content, words)
        out = F.when(hit, hours) if out is None else out.when(hit, hours)
    return out


def expiry(content: Column, importance_: Column, as_of_s: Column, low: float = 0.35, high: float = 0.70, **lists) -> Column:
    """F09 then F10: when a record expires, in epoch seconds; null is permanent. lists: patterns for ttl_hours and `sensor`."""
    sensor = lists.pop("sensor", L.TIME_SENSOR)
    strong = ttl_hours(content, **lists)
    hours = F.when(strong.isNotNull(), F.nullif(strong, F.lit(0))).when(importance_.between(low, high), sensed_hours(content, sensor))
    return (as_of_s + hours * 3600).cast("long")


# --- complexity -------------------------------------------------------------------------------------------------------


def complexity(content: Column, relation=L.RELATION_WORDS, negation=L.NEGATION_WORDS, metaphor=L.METAPHOR_WORDS, temporal=L.TEMPORAL_WORDS) -> Column:
    """Additive score of semantic complexity, 0 for texts under 10 characters, 1 at most; complex from 0.4, escalate from 0.3."""
    count = lambda words: F.size(found_words(content, words))
    n = count(relation)
    names = F.size(F.array_distinct(extract_all(content, "[\\x{4e00}-\\x{9fff}]{2,4}(?:先生|女士|同学|老师|医生|教授)?"))) + F.size(F.array_distinct(extract_all(content, r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?")))
    marks = F.size(extract_all(content, "[，。！？；：、]")) / F.length(content)
    part = lambda hit, value: F.when(hit, value).otherwise(F.lit(0.0))
    score = (
        part(n >= 1, 0.2 + (n - 1) * 0.1) + part(count(negation) >= 1, F.lit(0.25)) + part(count(metaphor) >= 1, F.lit(0.25)) + part(count(temporal) >= 2, F.lit(0.15))
        + part(names >= 3, F.lit(0.25)) + part(marks > 0.1, F.lit(0.1)) + part(content.rlike("[?？]|[吗呢]$"), F.lit(0.1))
    )
    return F.when(F.length(content) < 10, F.lit(0.0)).otherwise(F.least(F.lit(1.0), score))


def escalation(content: Column, importance_: Column, **words) -> Column:
    """which rows a costly scorer should see: struct of escalate and reason."""
    score = complexity(content, **words)
    value = lambda yes, why: F.struct(F.lit(yes).alias("escalate"), F.lit(why).alias("reason"))
    return (
        F.when((importance_ >= 0.5) & (score >= 0.4), value(True, "high_confidence_but_complex")).when(importance_ >= 0.5, value(False, "high_confidence_simple"))
        .when((importance_ < 0.2) & (score >= 0.3), value(True, "low_confidence_but_complex")).when(importance_ < 0.2, value(False, "low_confidence_simple"))
        .otherwise(value(True, "uncertain_range"))
    )


# --- queries ----------------------------------------------------------------------------------------------------------


def trigger(query: Column, triggers=L.TRIGGERS) -> Column:
    """struct of layer, trigger and matched keywords."""
    low, out = F.lower(query), None
    for name, layer, words in triggers:
        value = F.struct(F.lit(layer).alias("layer"), F.lit(name).alias("trigger"), found_words(low, words).alias("matched"))
        hit = any_of(low, words)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.struct(F.lit(2).alias("layer"), F.lit("default").alias("trigger"), F.array().cast("array<string>").alias("matched")))


def query_class(query: Column, layer: Column, precise=L.PRECISE_WORDS, broad=L.BROAD_WORDS) -> Column:
    """F18."""
    low = F.lower(query)
    return F.when(any_of(low, precise) | (layer == 0), "precise").when(any_of(low, broad), "broad").otherwise("topic")


def size_of(class_: Column, place: int, sizes=L.QUERY_SIZES) -> Column:
    """Candidate (0), rerank (1) or final (2) size of a query class."""
    out = None
    for name, own in sizes.items():
        out = F.when(class_ == name, own[place]) if out is None else out.when(class_ == name, own[place])
    return out


# --- scores -----------------------------------------------------------------------------------------------------------


def _by_type(mtype: Column, rates: dict, default: float) -> Column:
    out = None
    for name, rate in rates.items():
        out = F.when(mtype == name, F.lit(rate)) if out is None else out.when(mtype == name, F.lit(rate))
    return out.otherwise(F.lit(default))


def weighted_count(retrieval: Column, used: Column, mentioned: Column, weights=L.ACCESS_WEIGHTS) -> Column:
    """P15."""
    zero = F.lit(0)
    return F.coalesce(retrieval, zero) * weights["retrieval"] + F.coalesce(used, zero) * weights["used_in_response"] + F.coalesce(mentioned, zero) * weights["user_mentioned"]


def access_boost(count: Column, last_accessed_s: Column, as_of_s: Column, recent: int = 7, coefficient: float = 0.2, most: float = 0.5) -> Column:
    """0 without access; recent accesses weigh more, older ones fade."""
    days = F.greatest(F.lit(0), floor_days(as_of_s, last_accessed_s)).cast("double")
    near = count * (1.0 - days / recent * 0.5) * F.when(days <= 3, 1.5).otherwise(1.0)
    effective = F.when(days <= recent, near).otherwise(count * F.pow(F.lit(0.9), days - recent) * 0.1)
    boost = F.least(F.lit(most), F.log(effective + 1) * (effective / recent) * coefficient)
    return F.when((count <= 0) | last_accessed_s.isNull(), F.lit(0.0)).otherwise(boost)


def rank_score(importance_: Column, confidence: Column, boost: Column) -> Column:
    """P18."""
    return importance_ * F.coalesce(confidence, F.lit(1.0)) * (1 + boost)


def protected_decay(score: Column, importance_: Column, mtype: Column, last_accessed_s: Column, as_of_s: Column, rates=L.DECAY_RATES) -> Column:
    """One decay run, weaker for important and recently accessed records."""
    days = floor_days(as_of_s, last_accessed_s)
    keep = F.when(days <= 3, 0.99).when(days <= 7, 0.97).when(days <= 14, 0.95).otherwise(1.0)
    return score * (1 - _by_type(mtype, rates, 0.01) * (1 - importance_ * 0.5) * keep)


def plain_decay(score: Column, importance_: Column, mtype: Column, rates=L.DECAY_RATES) -> Column:
    """P20."""
    return score * (1 - _by_type(mtype, rates, 0.01) * (1 - importance_ * 0.5))


def dynamic_score(score: Column, importance_: Column, mtype: Column, created_s: Column, boost: Column, as_of_s: Column, rates=L.DAILY_RATES) -> Column:
    """Decay at read time, by whole days since creation."""
    return score * F.pow(F.pow(_by_type(mtype, rates, 0.992), 1 - importance_ * 0.5), floor_days(as_of_s, created_s)) + boost


def time_decay(score: Column, days: Column, rate: float = 0.01) -> Column:
    """P22."""
    return score * F.exp(-rate * days)


def rerank_score(match: Column, memory_score: Column, importance_: Column, last_accessed_s: Column, as_of_s: Column, identity: Column | None = None) -> Column:
    """Recency, importance and relevance; an unknown date counts as 30 days."""
    days = F.coalesce(F.greatest(F.lit(0), floor_days(as_of_s, last_accessed_s)), F.lit(30))
    recency = F.exp(-(F.lit(0.1) if identity is None else F.when(identity, 0.05).otherwise(0.1)) * days)
    return 0.35 * recency + 0.35 * importance_ + 0.30 * (0.5 * match + 0.5 * memory_score)


def conflict_parts(new_s, old_s, new_conf, old_conf, new_owner, old_owner, priority=L.SOURCE_PRIORITY):
    """P25's three comparisons, new against old: time, confidence, source."""
    days, diff = floor_days(new_s, old_s), new_conf - old_conf
    time = F.when(days > 7, 1.0).when(days > 0, 0.5).when(days < -7, -1.0).otherwise(0.0)
    conf = F.when(diff > 0.3, 1.0).when(diff > 0.1, 0.5).when(diff < -0.3, -1.0).when(diff < -0.1, -0.5).otherwise(0.0)
    rank = lambda c: _by_type(c, priority, 2)
    return time, conf, F.signum(rank(new_owner) - rank(old_owner)).cast("double")


def conflict_score(*args) -> Column:
    time, conf, source = conflict_parts(*args)
    return time * 0.5 + conf * 0.3 + source * 0.2


def conflict_action(score: Column) -> Column:
    """P25: UPDATE, KEEP or MERGE."""
    return F.when(score > 0.3, "UPDATE").when(score < -0.3, "KEEP").otherwise("MERGE")


def conflict_reason(*args) -> Column:
    """P26."""
    words = (("新记忆更新", "旧记忆更新"), ("新记忆置信度更高", "旧记忆置信度更高"), ("新记忆来源更可靠", "旧记忆来源更可靠"))
    parts = [F.when(x > 0, a).when(x < 0, b) for x, (a, b) in zip(conflict_parts(*args), words, strict=True)]
    return F.coalesce(F.nullif(F.concat_ws("、", *parts), F.lit("")), F.lit("不确定，保留两条记忆"))


def contradictory(new_content: Column, new_s: Column, old_s: Column, words=L.CONTRADICTION_WORDS) -> Column:
    """F21."""
    return any_of(F.lower(new_content), words) | later(new_s, old_s)


def later(new_s: Column, old_s: Column, days: int = 7) -> Column:
    """Is new more than so many whole days after old?"""
    return F.coalesce((new_s > old_s) & (floor_days(new_s, old_s) > days), F.lit(False))


def override_tier(content: Column, tier1=L.OVERRIDE_TIER1, tier2=L.OVERRIDE_TIER2) -> Column:
    """1, 2 or null."""
    return F.when(any_of(content, tier1), 1).when(any_of(content, tier2), 2)


def injection_tier(memory_score: Column, high: float = 0.8, low: float = 0.5) -> Column:
    """P27."""
    return F.when(memory_score >= high, "direct").when(memory_score >= low, "marked").otherwise("reference")


def importance_band(value: Column) -> Column:
    """P32."""
    return F.when(value >= 0.9, "critical").when(value >= 0.7, "high").when(value >= 0.4, "medium").otherwise("low")


def health_status(conflict: Column, stale: Column) -> Column:
    """P33."""
    return F.when(conflict, "conflict").when(stale, "stale").otherwise("active")
