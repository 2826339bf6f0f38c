"""The event sink as a database table.

Spark's JDBC writer cannot skip keys that are there already, so rows go to a staging table in
parallel and one statement moves them over. The table's own default stamps ``visible_at``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pulse.functions.columns import label_or
from pulse.schemas import ENVELOPE, FLUSH_ROWS, KEY, SINK_DEFAULTS

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?")


def write_options(options: dict[str, str], table: str, mode: str = "batch") -> dict[str, str]:
    return options | {"dbtable": table, "batchsize": str(FLUSH_ROWS[mode]), "stringtype": "unspecified"}


def staged_rows(events: DataFrame) -> DataFrame:
    """The envelope as the table takes it: no label is null, as a written null would stand in for the column's default."""
    return events.withColumns({c: label_or(c, default) for c, default in SINK_DEFAULTS.items()}).select(*ENVELOPE.names)


def stage(events: DataFrame, options: dict[str, str], staging: str, mode: str = "batch") -> None:
    """Fill the staging table. It is emptied first, so a repeated write leaves no copies."""
    (
        staged_rows(events)
        .write.format("jdbc")
        .options(**write_options(options, staging, mode))
        .option("truncate", "true")
        .mode("overwrite")
        .save()
    )


def merge_statement(staging: str, target: str) -> str:
    """First copy wins: staged rows whose key the target has are left out. A task that was run twice may have staged a row
    twice, so of the staged ones, too, each key goes over once."""
    names = ", ".join(ENVELOPE.names)
    once = f"SELECT DISTINCT ON (event_id) {names} FROM {staging} ORDER BY event_id"
    return f"INSERT INTO {target} ({names}) {once} ON CONFLICT (event_id) DO NOTHING"


def empty_statement(target: str) -> str:
    """Remove one run's rows, and no other's; the labels are parameters."""
    return f"DELETE FROM {target} WHERE " + " AND ".join(f"{c} = ?" for c in KEY)


def execute(spark: SparkSession, options: dict[str, str], statement: str, values: tuple[str, ...] = ()) -> None:
    """Run one statement on the database, from the driver."""
    jvm = spark._jvm
    login = jvm.java.util.Properties()
    for name in ("user", "password"):
        if name in options:
            login.setProperty(name, options[name])
    connection = jvm.java.sql.DriverManager.getConnection(options["url"], login)
    try:
        prepared = connection.prepareStatement(statement)
        for place, value in enumerate(values, 1):
            prepared.setString(place, value)
        prepared.execute()
    finally:
        connection.close()


def insert_absent(
    events: DataFrame, options: dict[str, str], target: str, staging: str, mode: str = "batch"
) -> None:
    """Add events to the target table, once each: safe to repeat, as both steps are."""
    stage(events, options, staging, mode)
    execute(events.sparkSession, options, merge_statement(staging, target))


@dataclass(frozen=True)
class JdbcStore:
    """A database table as the sink of ``pulse.plans.ingest.ingest_into_table``. ``writer`` names the staging table, so that writers do
    not fill one another's."""

    spark: SparkSession
    options: dict[str, str]
    target: str
    writer: str = "batch"
    mode: str = "batch"

    def __post_init__(self):
        for name in (self.target, self.writer):
            if not _NAME.fullmatch(name):
                raise ValueError(f"no name of a table: {name!r}")

    @property
    def staging(self) -> str:
        return f"{self.target}_stage_{self.writer.replace('.', '_')}"

    def add(self, events: DataFrame) -> None:
        insert_absent(events, self.options, self.target, self.staging, self.mode)

    def empty_run(self, strategy: str, scenario: str, run_id: str) -> None:
        execute(self.spark, self.options, empty_statement(self.target), (strategy, scenario, run_id))
