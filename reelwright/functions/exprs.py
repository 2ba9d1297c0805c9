"""Column expressions: text, scores, enumerations, time and binary fields."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelwright.functions import params


def clean_word(word: Column) -> Column:
    """Trimmed, in lower case, without quotes at its ends; other punctuation stays."""
    return F.btrim(F.lower(F.regexp_replace(word, r"^\s+|\s+$", "")), F.lit("'\""))


def to_ms(seconds: Column) -> Column:
    """Whole milliseconds, cut off towards zero."""
    return (seconds * 1000).cast("bigint")


def hundredths(ms: Column) -> Column:
    """Whole milliseconds as seconds with two decimals, ties to the even one: times at the engine's edge."""
    tens = F.floor(ms / 10).cast("bigint")
    rest = ms - tens * 10
    up = (rest > 5) | ((rest == 5) & (F.pmod(tens, F.lit(2)) == 1))
    return ((tens + up.cast("int")) / 100.0).cast("double")


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """x within lo and hi; null stays null (greatest and least skip nulls)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def checker_confidence(x: Column) -> Column:
    """A raw score in [-1, 1] moved into [0, 1]; 0.5 where there is none."""
    return F.coalesce(clamp((x + 1) / 2), F.lit(0.5))


def softmax_second(a: Column, b: Column) -> Column:
    """The probability of the second of two logits."""
    return F.lit(1.0) / (F.exp(a - b) + 1)


def combined(first: Column, second: Column, skin: Column) -> Column:
    return F.greatest(first, second, skin)


def any_flag(first: Column, second_score: Column, skin: Column) -> Column:
    return first | (second_score > params.SECOND_CHECKER) | skin


def nsfw_threshold(is_cartoon: Column, live: float = params.LIVE_THRESHOLD, cartoon: float = params.CARTOON_THRESHOLD) -> Column:
    return F.when(is_cartoon, F.lit(cartoon)).otherwise(F.lit(live))


def cartoon_by_features(sat_mean: Column, edge_density: Column) -> Column:
    """From the mean saturation (0..255) and the share of edge pixels."""
    return F.least(F.lit(1.0), F.greatest(sat_mean, F.lit(0.0)) / 180) * 0.6 + F.least(F.lit(1.0), edge_density / 0.3) * 0.4 > 0.5


def cartoon_by_saturation(mean: Column, distinct: Column) -> Column:
    return (mean > 0.4) & (distinct < 100)


def skin_verdict(ratio: Column, contour: Column) -> Column:
    """flag and confidence from the skin share and the largest contour's share."""
    return F.struct(((ratio > 0.40) & (contour > 0.15)).alias("flag"), F.least(F.lit(1.0), (ratio + contour) / 0.6).alias("confidence"))


def silence_weighted(score: Column, silence_ratio: Column) -> Column:
    return F.when(silence_ratio > params.SILENT, F.round(score * 0.5, 4)).otherwise(score)


def risk_of(tags: Column) -> Column:
    return F.when(F.size(tags) > 0, F.lit("mature")).otherwise(F.lit("safe"))


def action_of(tags: Column) -> Column:
    return F.when(F.size(tags) > 0, F.lit("swap")).otherwise(F.lit("play"))


def _code(value: Column, table: dict[str, int], what: str) -> Column:
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.when(value.isin(*table), F.try_element_at(known, value)).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(value, F.lit("null"))))).cast("int")


def risk_code(risk: Column) -> Column:
    """Fails the query on a name that is not a risk."""
    return _code(risk, params.RISKS, "risk")


def action_code(action: Column) -> Column:
    """Fails the query on a name that is not an action."""
    return _code(action, params.ACTIONS, "action")


def duration_ms(start_s: Column, end_s: Column, start_ms: Column, end_ms: Column) -> Column:
    """From seconds if both are there, else from milliseconds, else 0."""
    return F.coalesce(to_ms(end_s - start_s), end_ms - start_ms, F.lit(0)).cast("bigint")


def codec_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in params.CODECS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, code.cast("int")), F.format_string("Unknown (0x%08X)", code.cast("bigint")))


def has_flag(flags: Column, name: str) -> Column:
    return flags.cast("bigint").bitwiseAND(F.lit(1 << params.FLAGS[name])) != 0


def segment_id(number: Column) -> Column:
    return F.format_string("seg_%03d", number)


def checked_id(sid: Column) -> Column:
    """sid; fails the query if it takes more than 16 bytes."""
    return F.when(F.octet_length(sid) <= 16, sid).otherwise(F.raise_error(F.concat(F.lit("segment id is longer than 16 bytes: "), sid)))


def caption_weight(text: Column, keywords: dict[str, int]) -> Column:
    """The weight of all keywords that stand in text as whole words, each counted once. One alternation rules out most texts."""
    low = F.lower(text)
    pattern = lambda w: rf"\b{re.escape(w)}\b"
    total = F.lit(0)
    for w, weight in keywords.items():
        total = total + F.when(low.rlike(pattern(w)), weight).otherwise(0)
    return F.when(low.rlike(r"\b(?:" + "|".join(re.escape(w) for w in keywords) + r")\b"), total).otherwise(0)


def caption_tags(text: Column, keywords: dict[str, dict[str, int]] | None = None, thresholds: dict[str, int] | None = None) -> Column:
    """The sorted tags whose keywords reach their threshold."""
    keywords, thresholds = keywords or params.keyword_weights(), thresholds or params.KEYWORD_THRESHOLD
    tags = [F.when(caption_weight(text, words) >= thresholds.get(tag, 2), F.lit(tag)) for tag, words in sorted(keywords.items())]
    return F.array_compact(F.array(*tags))


def parsed_topics(answer: Column, topics: list[str] | None = None) -> Column:
    """Topics in a classifier's answer: those of its JSON array, in order and with repeats; without a parsable one, all that it names."""
    known = F.array(*[F.lit(t) for t in topics or params.TOPICS])
    listed = F.from_json(F.regexp_extract(answer, r"(?s)\[.*\]", 0), "array<string>")
    return F.when(listed.isNotNull(), F.filter(listed, lambda t: F.array_contains(known, t))).otherwise(F.filter(known, lambda t: F.contains(answer, t)))
