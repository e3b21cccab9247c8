"""Names: schemas, tables by name, statistics, and a client that runs SQL with figures."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def create_schema(spark: SparkSession, name: str, comment: str = "") -> None:
    """Nothing if it is there already."""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name} COMMENT '{comment}'")


def publish(rows: DataFrame, name: str, path: str, properties: dict[str, str] | None = None, comment: str = "") -> None:
    """Write rows as the table ``name`` over Parquet at ``path``."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").option("path", path).format("parquet").saveAsTable(name)
    if properties:
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({', '.join(f'{k!r} = {v!r}' for k, v in properties.items())})")
    if comment:
        spark.sql(f"COMMENT ON TABLE {name} IS '{comment}'")


def table(spark: SparkSession, name: str) -> DataFrame:
    """A table whose name is a parameter."""
    return spark.sql("SELECT * FROM IDENTIFIER(:name)", args={"name": name})


def listing(spark: SparkSession, like: str) -> DataFrame:
    """(schema, table) of every schema whose name fits ``like``; a schema without tables has one row without table."""
    found = []
    for schema in [r[0] for r in spark.sql(f"SHOW SCHEMAS LIKE '{like}'").collect()]:
        names = [r.tableName for r in spark.sql(f"SHOW TABLES IN {schema}").collect() if not r.isTemporary]
        found += [(schema, n) for n in names] or [(schema, None)]
    return spark.createDataFrame(found, "schema string, table string")


def properties(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(f"SHOW TBLPROPERTIES {name}")


def analyze(spark: SparkSession, name: str) -> DataFrame:
    """Collect statistics of the table and all its columns, and return (column, distinct, nulls) as the optimizer sees them."""
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
    found = []
    for column in spark.table(name).columns:
        stats = {r.info_name: r.info_value for r in spark.sql(f"DESCRIBE EXTENDED {name} `{column}`").collect()}
        found.append((column, int(stats["distinct_count"]), int(stats["num_nulls"])))
    return spark.createDataFrame(found, "column string, distinct long, nulls long")


class Client:
    """Runs SQL and keeps what each run took."""

    LOG = "statement string, seconds double, n_rows long"

    def __init__(self, spark: SparkSession):
        self.spark, self.runs = spark, []

    def run(self, statement: str, **args) -> DataFrame:
        """The rows of a statement that gives a bounded result, such as a report."""
        start = time.perf_counter()
        rows = self.spark.sql(statement, args=args or None)
        found = rows.collect()
        self.runs.append((statement, time.perf_counter() - start, len(found)))
        return self.spark.createDataFrame(found, rows.schema)

    def log(self) -> DataFrame:
        return self.spark.createDataFrame(self.runs, self.LOG)

    def slowest(self) -> DataFrame:
        return self.log().orderBy(F.desc("seconds"), "statement").limit(1)
