"""Results kept ready: created once, refreshed on demand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tidemark.sources.store import Table


class MaterializedView:
    """A query whose result is a versioned table; readers see the last refresh."""

    def __init__(self, table: Table, query: Callable[[], DataFrame]):
        self.table, self.query = table, query

    def create(self) -> MaterializedView:
        """Nothing if it is there already."""
        if not self.table.exists():
            self.table.create(self.query())
        return self

    def refresh(self) -> int:
        return self.table.overwrite(self.query(), "REFRESH")

    def read(self) -> DataFrame:
        return self.table.read()
