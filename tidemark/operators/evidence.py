"""Measurements with a verdict, and the gate over them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.store import Table

SCHEMA = "run_id string, step string, metric string, value string, value_num double, note string, recorded_at timestamp"


class Evidence:
    """Collects what a step measured and appends it to a table once."""

    def __init__(self, table: Table, run_id: str, step: str):
        self.table, self.run_id, self.step, self.rows = table, run_id, step, []

    def record(self, metric: str, value: object, note: str | None = None) -> None:
        """Whole numbers are shown with separators; truth values and texts have no number."""
        number = None if isinstance(value, bool) or not isinstance(value, int | float) else float(value)
        shown = f"{value:,}" if isinstance(value, int) and not isinstance(value, bool) else None if value is None else str(value)
        self.rows.append((self.run_id, self.step, metric, shown, number, note, datetime.now(timezone.utc)))

    def verdict(self, criterion: str, holds: bool, note: str | None = None) -> bool:
        self.record(f"acceptance_{criterion}", "PASS" if holds else "FAIL", note)
        return holds

    def flush(self) -> None:
        """Append the rows, if any; a second flush adds nothing."""
        rows, self.rows = self.rows, []
        if not rows:
            return
        found = self.table.spark.createDataFrame(rows, SCHEMA)
        self.table.append(found) if self.table.exists() else self.table.create(found)


def latest_per_metric(evidence: DataFrame, prefix: str = "") -> DataFrame:
    """The newest row of every metric that starts with ``prefix``; of one instant the greatest value.  An aggregate with
    partial results: no metric's rows are gathered."""
    columns = [c for c in evidence.columns if c != "metric"]
    own = evidence.where(F.col("metric").startswith(prefix)) if prefix else evidence
    newest = F.max_by(F.struct(*columns), F.struct("recorded_at", "value")).alias("r")
    return own.groupBy("metric").agg(newest).select("metric", "r.*")


def latest(evidence: DataFrame, metric: str) -> DataFrame:
    """The newest row of one metric: a top-1, not a window over the whole table."""
    return evidence.where(F.col("metric") == metric).orderBy(F.desc("recorded_at"), F.col("value").desc_nulls_last()).limit(1)


@dataclass(frozen=True)
class Criterion:
    id: str
    title: str
    required: bool


CRITERIA = (
    Criterion("A1", "clicks and prices land as two feeds", True),
    Criterion("A2", "enough products change their price by much", True),
    Criterion("A3", "own sessions, held against the ids that came", True),
    Criterion("A4", "several ways to bind prices agree", True),
    Criterion("A5", "shown prices match the prices in force", True),
    Criterion("A6", "new columns rewrite no file", False),
    Criterion("A7", "new clustering rewrites no file", False),
    Criterion("A8", "compaction leaves fewer files and the same rows", True),
    Criterion("A9", "elasticity has normalised windows and a floor", True),
    Criterion("A10", "lost revenue is told both ways", True),
    Criterion("A11", "the frozen copy stands and is kept", False),
    Criterion("A12", "three ways of serving give one answer", True),
)


def gate(evidence: DataFrame, criteria: tuple[Criterion, ...] = CRITERIA) -> DataFrame:
    """(id, title, status, kind, blocks) of every criterion: its latest verdict, or NOT RUN; required ones block unless PASS."""
    spark = evidence.sparkSession
    wanted = spark.createDataFrame([(c.id, c.title, c.required, f"acceptance_{c.id}") for c in criteria], "id string, title string, required boolean, metric string")
    found = latest_per_metric(evidence, "acceptance_").select("metric", F.col("value").alias("status"))
    status = F.coalesce("status", F.lit("NOT RUN"))
    both = F.broadcast(wanted).join(found, "metric", "left")
    return both.select("id", "title", status.alias("status"), F.when(F.col("required"), "required").otherwise("manual").alias("kind"), (F.col("required") & (status != "PASS")).alias("blocks"))


def require(summary: DataFrame) -> None:
    """Stop where a required criterion does not hold."""
    blocking = [f"{r.id} {r.title}: {r.status}" for r in summary.where("blocks").orderBy("id").collect()]
    if blocking:
        raise AssertionError("; ".join(blocking))
