"""A table keyed by path with a layer of replaced rows on top: what an edit touches is a few rows, whatever the table's size.

The layer is held by the driver and bounded: beyond `most` rows the owner writes table() as a new base. An edit gives a new
Layers that shares the base, so readers of the old one are not disturbed and plans do not grow with the number of edits.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

MOST_ROWS = 20_000


class Layers:
    def __init__(self, base: DataFrame, fresh: Mapping[str, list[tuple]] | None = None, key: str = "path"):
        self.base, self.key = base, key
        self.fresh: dict[str, list[tuple]] = dict(fresh or {})  # by path; an empty list removes the path

    @property
    def crowded(self) -> bool:
        return sum(map(len, self.fresh.values())) + len(self.fresh) > MOST_ROWS

    def table(self) -> DataFrame:
        if not self.fresh:
            return self.base
        spark = self.base.sparkSession
        gone = spark.createDataFrame([(p,) for p in self.fresh], f"{self.key} string")
        rows = spark.createDataFrame([r for own in self.fresh.values() for r in own], self.base.schema)
        return self.base.join(gone, self.key, "left_anti").select(*self.base.columns).unionByName(rows)

    def replaced(self, rows: Iterable, paths: Iterable[str]) -> Layers:
        """With the rows of the paths gone and these rows there, each of one of the paths."""
        at = self.base.columns.index(self.key)
        fresh = self.fresh | {p: [] for p in paths}
        for r in rows:
            fresh[r[at]] = [*fresh[r[at]], tuple(r)]
        return Layers(self.base, fresh, self.key)
