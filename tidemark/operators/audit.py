"""Freezing a table, proving that the copy stands, and guarding history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import gold, layout
from tidemark.sources.history_policy import shortfalls
from tidemark.sources.store import Table

_STEPS = "step string, holds boolean"


def freeze(live: Table, target: str, moment: float | None = None) -> Table:
    """A copy of the version that was there at ``moment`` (now by default); an existing copy is never replaced."""
    return live.clone(target, None if moment is None else live.version_at(moment))


def immutability_proof(live: Table, frozen: Table) -> DataFrame:
    """(step, holds): the copy and the version it was made of read alike, before and after the live table changes."""
    source = int(frozen.entry().properties["cloned_version"])
    spark, digest = live.spark, lambda rows: tuple(layout.digest(rows).first())
    before = digest(frozen.read())
    steps = [("copy equals its version", before == digest(live.read(source)))]
    changed = live.update(F.lit(True), {"purchases": F.col("purchases") + 1})
    steps.append(("live has changed", digest(live.read(changed)) != before))
    steps.append(("copy stands", digest(frozen.read()) == before))
    steps.append(("time travel stands", digest(live.read(source)) == before))
    live.restore(changed - 1)
    return spark.createDataFrame(steps, _STEPS)


def retention_check(live: Table, frozen: Table, proof: DataFrame) -> DataFrame:
    """(step, holds): both keep their history, nothing they need can be deleted, both still read alike, the proof holds."""
    source = int(frozen.entry().properties["cloned_version"])
    top = gold.top_category(frozen.read()).first()
    category = top.category_id if top else ""
    alike = gold.reading(frozen.read(), category).first() == gold.reading(live.read(source), category).first()
    steps = [
        ("history is kept", not live.violations() + frozen.violations()),
        ("nothing can be deleted", not live.vacuum() + frozen.vacuum()),
        ("copy and time travel agree", alike),
        ("proof holds", proof.where("not holds").isEmpty() and not proof.isEmpty()),
    ]
    return live.spark.createDataFrame(steps, _STEPS)


def history_guard(tables: list[Table]) -> DataFrame:
    """(table, problem) of every versioned table that keeps too little; folders without a log are passed over."""
    found = [(t.path.rsplit("/", 1)[1], problem) for t in tables if t.exists() for problem in shortfalls(t.entry().properties, t.layer)]
    return tables[0].spark.createDataFrame(found, "table string, problem string")


def evolution_proof(table: Table, money: str) -> DataFrame:
    """(step, n_rows, checksum, same_files, empty_column): metadata changes rewrite no file and change no value."""
    files = set(table.entry().files)
    found = []

    def look(step: str, column: str | None = None) -> None:
        rows = table.read()
        empty = F.lit(True) if column is None else F.lit(rows.where(F.col(column).isNotNull()).isEmpty())
        found.append(gold.evolution_checksum(rows, money).select(F.lit(step).alias("step"), "n_rows", "checksum", F.lit(set(table.entry().files) == files).alias("same_files"), empty.alias("empty_column")))

    look("1 before")
    table.add_column("_proof", "string", after=money)
    look("2 column added", "_proof")
    table.rename_column("_proof", "_proof2")
    look("3 column renamed", "_proof2")
    table.set_cluster_by(money)
    look("4 clustering changed", "_proof2")
    every = found[0]
    for rows in found[1:]:
        every = every.unionByName(rows)
    return every


def layout_probe(table: Table, time_column: str, day: int, files: int | None = None) -> DataFrame:
    """Files, mean bytes and files that hold one day's rows, before and after compaction (into half the files by default)."""
    files = files or max(1, len(table.entry().files) // 2)
    before = layout.file_probe(table.read_files(), time_column, day).withColumn("step", F.lit("1 before"))
    table.optimize(files)
    return before.unionByName(layout.file_probe(table.read_files(), time_column, day).withColumn("step", F.lit("2 after")))
