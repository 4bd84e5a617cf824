"""Column expressions of the usage domain: counters, labels, money, buckets, statistics. All run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The largest exact integer of a double, the fallback label, the normal quantile of a 95 % interval.
MAX_COUNT = 9007199254740991
FALLBACK_MODEL = "Unrecognized AI version"
Z_95 = 1.959963984540054

#: Counters of a call, in the order reports list them.
COUNTERS = ("input_tokens", "cache_write_input_tokens", "cache_read_input_tokens", "output_tokens", "reasoning_output_tokens", "usage_records")

# Histogram buckets of reports as (name, least, largest); None is unbounded.
RECORD_BUCKETS = (("zero", 0, 0), ("one", 1, 1), ("two_to_four", 2, 4), ("five_to_nineteen", 5, 19), ("twenty_plus", 20, None))
TOKEN_BUCKETS = (
    ("under_10k", 0, 9_999),
    ("ten_to_49k", 10_000, 49_999),
    ("fifty_to_199k", 50_000, 199_999),
    ("two_hundred_to_999k", 200_000, 999_999),
    ("one_million_plus", 1_000_000, None),
)
ELAPSED_MINUTES = (("under_10m", 0, 10), ("ten_to_59m", 10, 60), ("one_to_3h", 60, 240), ("four_to_11h", 240, 720), ("twelve_h_plus", 720, None))
WORKFLOW_SHAPES = (("single_exchange", 1, 1), ("short_multi_exchange", 2, 4), ("sustained", 5, 19), ("high_iteration", 20, None))

# The closed forms of model labels, longest label, and the grammar of a plain dollar amount.
MODEL_LABELS = (
    r"^claude-(?:(?:opus|sonnet|haiku|fable|mythos)-\d{1,2}(?:-\d{1,2}){0,2}|\d{1,2}(?:-\d{1,2}){0,2}-(?:opus|sonnet|haiku|fable|mythos))$",
    r"^gpt-\d{1,2}(?:[.-]\d{1,2})*(?:-(?:sol|terra|luna|mini|nano|codex(?:-mini)?|chat|pro|turbo|preview))?$",
    r"^o[1-9](?:-(?:mini|pro|preview|latest))?$",
    r"^deepseek-v\d{1,2}(?:[.-]\d{1,2})*(?:-(?:pro|lite|chat|coder|reasoner))?$",
    r"^codex-auto-review$",
    r"^codex-(?:mini|large|latest)(?:-latest)?$",
)
LONGEST_LABEL = 160
MONEY = r"(?i)^(?:(?:US\$|USD|\$) ?)?(-?(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)?(?:\.[0-9]+)?)(?: ?(?:USD|\$))?$"


def is_count(c: Column) -> Column:
    return c.isNotNull() & (c >= 0) & (c <= MAX_COUNT)


def checked_sum(c: Column) -> Column:
    """A sum of counts that fails, as a report must, when it leaves the exact integers."""
    total = F.sum(c)
    return F.when(total > MAX_COUNT, F.raise_error(F.lit("the sum isn't a safe count")).cast("long")).otherwise(total)


def total_tokens() -> Column:
    """Reasoning tokens are part of the output and don't count again."""
    return F.col("input_tokens") + F.col("cache_write_input_tokens") + F.col("cache_read_input_tokens") + F.col("output_tokens")


def month_of(day: Column) -> Column:
    """Calendar month of a day's text; days that aren't known are `undated`."""
    return F.coalesce(F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(day, 1, 7)), F.lit("undated"))


def valid_calendar_day(day: Column) -> Column:
    """A real day of the proleptic Gregorian calendar, the year 0000 included."""
    year, month, date = (F.substring(day, a, n).try_cast("int") for a, n in ((1, 4), (6, 2), (9, 2)))
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    days = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.coalesce(day.rlike(r"^\d{4}-\d{2}-\d{2}$") & month.between(1, 12) & (date >= 1) & (date <= days), F.lit(False))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\ufeff]+|[\s\ufeff]+$", "")


def strict_money(text: Column) -> Column:
    """A plain dollar amount, or null; signs are kept and callers take negative amounts as missing."""
    digits = F.regexp_extract(trimmed(text), MONEY, 1)
    return F.when(digits.rlike("[0-9]"), F.replace(digits, F.lit(","), F.lit("")).try_cast("double"))


def sanitize_model_label(label: Column) -> Column:
    """One of the closed forms of labels in lower case, a trailing date dropped; anything else, which may be private text, is the fallback."""
    clean = F.lower(trimmed(F.regexp_replace(F.regexp_replace(label, r"[\x00-\x1f\x7f<>\\/]", " "), r"(?U)[\s\ufeff]+", " ")))
    short = F.length(clean) <= LONGEST_LABEL
    clean = F.regexp_replace(clean, r"-(?:\d{8}|\d{4}-\d{2}-\d{2})$", "")
    return F.when(short & any_of([clean.rlike(p) for p in MODEL_LABELS]), clean).otherwise(F.lit(FALLBACK_MODEL))


def safe_label(label: Column, longest: int = LONGEST_LABEL) -> Column:
    """A label of a billing row as it may be shown: control and markup signs blank, blanks single, cut; null without any text."""
    clean = trimmed(F.regexp_replace(F.regexp_replace(label, r"[\x00-\x1f\x7f<>\\/`\"']", " "), r"(?U)[\s\ufeff]+", " "))
    return F.nullif(F.substring(clean, 1, longest), F.lit(""))


def is_hostile(label: Column) -> Column:
    """Labels with control or markup signs, or names that objects have anyway."""
    return label.rlike(r"[\x00-\x1f\x7f<>\\/`]") | label.isin("__proto__", "constructor", "prototype")


def retained_label(label: Column) -> Column:
    """A label under which an export's usage stays visible, known or not: a common name stands for hostile and missing ones."""
    return F.when(F.coalesce(is_hostile(label), F.lit(True)), F.lit(FALLBACK_MODEL)).otherwise(F.coalesce(safe_label(label), F.lit(FALLBACK_MODEL)))


def in_bucket(c: Column, low: float, high: float | None, half_open: bool = False) -> Column:
    if high is None:
        return c >= low
    return (c >= low) & ((c < high) if half_open else (c <= high))


def bucket_of(c: Column, buckets: tuple, half_open: bool = False, missing: str | None = None) -> Column:
    first, *rest = [F.when(in_bucket(c, low, high, half_open), F.lit(name)) for name, low, high in buckets]
    return F.coalesce(first, *rest, F.lit(missing))


def round_half_up(c: Column, digits: int) -> Column:
    """Rounds halves toward plus infinity, also below zero."""
    return F.floor(c * 10.0**digits + 0.5) / 10.0**digits


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """95 % Wilson interval of a share; null for no trials."""
    p, z2 = F.try_divide(hits.cast("double"), n), Z_95 * Z_95
    middle, spread = p + z2 / (2 * n), Z_95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    low, high = (F.try_divide(middle + s * spread, 1 + z2 / n) for s in (-1, 1))
    return F.when(n > 0, F.greatest(F.lit(0.0), low)), F.when(n > 0, F.least(F.lit(1.0), high))


def interval_score(low: Column, high: Column, actual: Column, alpha: float = 0.2) -> Column:
    """Width, and 2 / alpha times the miss on either side."""
    below, above = F.greatest(low - actual, F.lit(0.0)), F.greatest(actual - high, F.lit(0.0))
    return high - low + (2 / alpha) * below + (2 / alpha) * above


def multiplicative_error(actual: Column, predicted: Column) -> Column:
    return F.greatest(float_ratio(actual, predicted), float_ratio(predicted, actual))


def float_log(x: Column) -> Column:
    """ln as floating-point numbers have it: -Infinity of 0, where Spark has null."""
    return F.when(x == 0, float("-inf")).otherwise(F.log(x))


def float_ratio(a: Column, b: Column) -> Column:
    """a / b as floating-point numbers have it: by 0 it is infinite, of 0 or NaN it is NaN, where Spark fails."""
    by_zero = F.when(a.isNull(), None).when((a == 0) | F.isnan(a), float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))
    return F.when(b == 0, by_zero).otherwise(a / b)


def interpolated(low: Column, high: Column, share: Column) -> Column:
    """Between low and high; of two equal infinities the same, of one the infinite one."""
    infinite = (F.abs(low) == float("inf")) | (F.abs(high) == float("inf"))
    return F.when((low == high) | (share == 0), low).when(infinite, low * (1 - share) + high * share).otherwise(low + (high - low) * share)


# Fixed values of FNV-1a: offset 2166136261, prime 16777619.
def fnv1a(text: Column) -> Column:
    """Unsigned 32-bit FNV-1a over a text's ASCII codes."""
    step = lambda h, ch: (h.bitwiseXOR(F.ascii(ch).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2166136261).cast("long"), step)


def token_estimate(text: Column) -> Column:
    """Characters by four, rounded up."""
    return F.ceil(F.length(text) / 4)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), 0)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; two empty sets have none in common."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def gap_similarity(a: Column, b: Column) -> Column:
    return 1 / (1 + F.abs(F.log1p(a) - F.log1p(b)))


def quantile_of(values: Column, q: Column) -> Column:
    """Linear interpolation at q * (n - 1) in a sorted array; q may be a column."""
    at = q * (F.size(values) - 1)
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    a, b = F.get(values, low), F.get(values, high)
    return interpolated(a, b, at - low)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
