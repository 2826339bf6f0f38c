"""JSON records to typed columns, with a reason for every record that is turned away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.functions.columns import is_uuid
from pulse.schemas import DEFAULT_DOMAIN, DOMAIN_FIELDS, ENVELOPE

_CORRUPT = "_corrupt_record"
_REQUIRED = ["event_id", "produced_at", "strategy", "scenario", "run_id"]


def decode_value(df: DataFrame) -> DataFrame:
    """Record value bytes as UTF-8 text."""
    return df.withColumn("value", F.col("value").cast("string"))


def from_json_once(df: DataFrame, schema: T.StructType, keep: list[str], text="value") -> DataFrame:
    """Parse ``text`` and put its fields beside the ``keep`` columns.

    ``inline`` makes the parse a step of its own. As a plain projection the optimizer would copy
    the parse into every filter on a parsed field and run it twice for each record.
    """
    options = {"columnNameOfCorruptRecord": _CORRUPT}
    with_corrupt = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = F.from_json(F.col(text), with_corrupt, options)
    # A null text parses to a null struct, which inline() turns into one row of nulls.
    return df.select(*keep, F.inline(F.array(parsed)))


def parse_events(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Envelope columns plus ``accepted`` and ``reject_reasons``, empty for an accepted record.

    ``df`` is Kafka-shaped. A record that is no JSON object of the envelope's types has the one
    reason ``malformed_json``; else every missing field is named. Fields outside the envelope are
    ignored.
    """
    keep = keep if keep is not None else [c for c in df.columns if c not in ("key", "value")]
    parsed = from_json_once(decode_value(df), ENVELOPE, [*keep, "value"])
    return (
        parsed.withColumn("event_id", F.lower("event_id"))
        .withColumn("payload", F.coalesce("payload", F.lit("")))
        .withColumn("accepted", _is_valid())
        .withColumn("reject_reasons", _reject_reasons())
        .drop(_CORRUPT)
    )


def _is_valid() -> Column:
    """The rules as one plain condition. Accepted records are taken by it, so that the list of
    reasons is made up only where somebody reads it."""
    valid = F.col("value").isNotNull() & F.col(_CORRUPT).isNull()
    for name in _REQUIRED:
        valid = valid & F.col(name).isNotNull()
    return F.coalesce(valid & is_uuid("event_id"), F.lit(False))


def _reject_reasons() -> Column:
    missing = [F.when(F.col(c).isNull(), F.lit(f"missing_{c}")) for c in _REQUIRED]
    bad_id = F.when(~is_uuid("event_id"), F.lit("invalid_event_id"))
    return (
        F.when(F.col("value").isNull(), F.array(F.lit("null_value")))
        .when(F.col(_CORRUPT).isNotNull(), F.array(F.lit("malformed_json")))
        .otherwise(F.array_compact(F.array(*missing, bad_id)))
    )


def without_text(parsed: DataFrame) -> DataFrame:
    """Parsed records, of which only the rejected ones still carry their text; what follows moves half the bytes."""
    return parsed.withColumn("value", F.when(~F.col("accepted"), F.col("value")))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where("accepted").drop("accepted", "reject_reasons", "value")


def rejected(parsed: DataFrame) -> DataFrame:
    """Quarantine: the raw text and why it was turned away."""
    return parsed.where("NOT accepted").drop("accepted")


def reject_counts(parsed: DataFrame) -> DataFrame:
    """Records by reason, the accepted ones under ``accepted``."""
    fine = F.array(F.lit("accepted"))
    reasons = F.when(F.col("accepted"), fine).otherwise(F.col("reject_reasons"))
    return (
        parsed.select(F.explode(reasons).alias("reason"))
        .groupBy("reason")
        .agg(F.count("*").alias("records"))
    )


# --- domain events ----------------------------------------------------------------


def parse_domain(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """All domain fields of a record in one parse; ``schema`` names the record's own kind.

    An unknown or missing kind counts as the default one. Fields of other kinds are null.
    """
    keep = keep if keep is not None else [c for c in df.columns if c not in ("key", "value")]
    fields = [T.StructField("schema", T.StringType())]
    for struct in DOMAIN_FIELDS.values():
        fields += struct.fields
    parsed = from_json_once(
        decode_value(df), T.StructType([*ENVELOPE.fields, *fields]), [*keep, "value"]
    )
    known = F.col("schema").isin(list(DOMAIN_FIELDS))
    parsed = parsed.withColumn("schema", F.when(known, F.col("schema")).otherwise(DEFAULT_DOMAIN))
    own = [
        F.when(F.col("schema") == kind, F.col(f.name)).alias(f.name)
        for kind, struct in DOMAIN_FIELDS.items()
        for f in struct.fields
    ]
    return parsed.select(*keep, *ENVELOPE.names, "schema", *own)


def domain_view(parsed: DataFrame, kind: str) -> DataFrame:
    """One kind's records with only its own fields."""
    names = [*ENVELOPE.names, "schema", *DOMAIN_FIELDS[kind].names]
    return parsed.where(F.col("schema") == kind).select(*names)


def domain_violations() -> dict[str, Column]:
    """Boolean columns, true where a record breaks a rule of its kind."""
    c = F.col
    return {
        "alert_mismatch": c("alert") != ((c("heart_rate_bpm") > 150) | (c("heart_rate_bpm") < 45)),
        "quote_disorder": ~((c("bid") <= c("price")) & (c("price") <= c("ask"))),
        "temperature_range": ~c("temperature_c").between(-10, 60),
        "humidity_range": ~c("humidity_pct").between(10, 99.9),
        "pressure_range": ~c("pressure_hpa").between(950, 1050),
        "battery_range": ~c("battery_v").between(2.5, 4.2),
        "status_unknown": ~c("status").isin("ok", "warn", "error"),
        "price_range": ~c("price").between(1, 80000),
        "heart_rate_range": ~c("heart_rate_bpm").between(40, 180),
        "steps_range": ~c("steps_delta").between(0, 20),
    }


def domain_report(parsed: DataFrame) -> DataFrame:
    """Records and violations by kind: every rule in one aggregate, then one row per rule."""
    rules = domain_violations()
    counts = parsed.groupBy("schema").agg(
        F.count("*").alias("records"),
        *[F.count_if(rule).alias(name) for name, rule in rules.items()],
    )
    pairs = ", ".join(f"'{name}', {name}" for name in rules)
    return counts.selectExpr("schema", "records", f"stack({len(rules)}, {pairs}) AS (rule, violations)")
