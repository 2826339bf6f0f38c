"""Scalar rules on columns: defaults, guarded arithmetic, names, units, time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulse.schemas import (
    MIN_PAYLOAD_BYTES,
    PLAUSIBLE_FROM_MS,
    PLAUSIBLE_TO_MS,
    SCENARIOS,
)

_UUID = "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- identity and labels ------------------------------------------------------


def is_uuid(x: Column | str) -> Column:
    """Full 36-character UUID text; short groups are not accepted."""
    return F.lower(_c(x)).rlike(_UUID)


def label_or(x: Column | str, default: str) -> Column:
    """A label, or the default when it is null or blank."""
    x = F.trim(_c(x))
    return F.coalesce(F.when(x != "", x), F.lit(default))


def display_label(x: Column | str, labels: Mapping[str, str]) -> Column:
    """Readable label; values without one pass through."""
    x = _c(x)
    pairs = F.create_map(*[F.lit(t) for pair in labels.items() for t in pair])
    return F.coalesce(F.try_element_at(pairs, x), x)


def preferred_rank(x: Column | str, order: Sequence[str]) -> Column:
    """Sort rank of a category: listed values first, every other value after them."""
    position = F.array_position(F.array(*[F.lit(v) for v in order]), _c(x))
    return F.when(position > 0, position).otherwise(F.lit(len(order) + 1).cast("long"))


def safe_name(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(_c(x)), "[^a-z0-9_-]", "_")


def run_topic(strategy, scenario, run_id, epoch_s) -> Column:
    """Topic name that isolates one run."""
    parts = [safe_name(strategy), safe_name(scenario), safe_name(run_id)]
    return F.concat_ws("_", F.lit("events"), *parts, _c(epoch_s).cast("string"))


# --- lenient casts --------------------------------------------------------------


def lenient_double(x: Column | str) -> Column:
    """Number or null; text that is no number, and NaN, are null."""
    number = _c(x).try_cast("double")
    return F.when(~F.isnan(number), number)


def lenient_long(x: Column | str) -> Column:
    return F.floor(lenient_double(x)).try_cast("bigint")


def is_unparsable(x: Column | str) -> Column:
    """Missing or not a number."""
    return lenient_double(x).isNull()


# --- predicates -----------------------------------------------------------------


def in_scope(scenario: Column | str, scope: str = "official") -> Column:
    return _c(scenario).isin(SCENARIOS) if scope == "official" else F.lit(True)


def is_advanced(scenario: Column | str) -> Column:
    return F.coalesce(_c(scenario).rlike("cyclic|bursty"), F.lit(False))


def of_run(strategy: str, scenario: str, run_id: str) -> Column:
    """Whole-value match on the run key, so that run_1 does not select run_10."""
    return (
        (F.col("strategy") == strategy)
        & (F.col("scenario") == scenario)
        & (F.col("run_id") == run_id)
    )


def is_plausible_ms(x: Column | str) -> Column:
    return _c(x).between(PLAUSIBLE_FROM_MS, PLAUSIBLE_TO_MS)


# --- arithmetic -----------------------------------------------------------------


def ratio_or_null(n: Column | str, d: Column | str) -> Column:
    return F.when(_c(d) > 0, _c(n) / _c(d))


def ratio_or_zero(n: Column | str, d: Column | str) -> Column:
    return F.when(_c(d) > 0, _c(n) / _c(d)).otherwise(F.lit(0.0))


def at_least(x: Column | str, bound) -> Column:
    """Lower clamp. Null stays null, which greatest() alone would not give."""
    x = _c(x)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(bound).cast("double")))


def at_most(x: Column | str, bound: Column | str) -> Column:
    """Upper clamp; null when the value is null, unclamped when the bound is."""
    x = _c(x)
    return F.when(x.isNotNull(), F.least(x, _c(bound)))


def payload_bytes(x: Column | str) -> Column:
    """Requested payload size, raised to the smallest size allowed."""
    return F.greatest(F.lit(MIN_PAYLOAD_BYTES), _c(x))


def payload_was_raised(x: Column | str) -> Column:
    return _c(x) < MIN_PAYLOAD_BYTES


# --- time and units ---------------------------------------------------------------


def latency_ms(visible="visible_at", produced="produced_at") -> Column:
    return _c(visible) - _c(produced)


def elapsed_s(t: Column | str, start: Column | str) -> Column:
    return F.floor((_c(t) - _c(start)) / 1000).cast("bigint")


def bucket(x: Column | str, width: int) -> Column:
    return (F.floor(_c(x) / width) * width).cast("bigint")


def s_to_ms(x: Column | str) -> Column:
    return _c(x) * 1000


def bytes_to_mib(x: Column | str) -> Column:
    return _c(x) / 1048576.0


def mib_to_gib(x: Column | str) -> Column:
    return _c(x) / 1024.0


def to_millions(x: Column | str) -> Column:
    return _c(x) / 1000000.0


def iso_utc(epoch_s: Column | str) -> Column:
    """ISO-8601 UTC text, whatever the session time zone."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    moment = F.timestamp_add("SECOND", _c(epoch_s), origin)
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def now_ms() -> Column:
    """Visibility stamp: one value for a whole batch, like a transaction's start time."""
    return F.unix_millis(F.current_timestamp())
