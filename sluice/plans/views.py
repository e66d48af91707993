"""A registry of views that are kept as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Snapshots


class Views:
    """Named functions of tables. define makes a view that is computed when read; refresh writes its rows as a new version and reads those from then on.

    Versions are folders of their own (see Snapshots), so readers of the last one are not disturbed and a refresh that fails changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.made, self.sources, self.seen = spark, path, {}, {}, {}

    def define(self, name: str, make: Callable[[], DataFrame], on: tuple[Snapshots, ...] = ()) -> None:
        """on: the tables after whose commits update() refreshes the view."""
        self.made[name], self.sources[name] = make, on
        make().createOrReplaceTempView(name)

    def refresh(self, name: str) -> DataFrame:
        self.seen[name] = [s.versions() for s in self.sources[name]]
        kept = Snapshots(self.spark, f"{self.path}/{name}")
        df = kept.read(kept.commit(self.made[name]()))
        df.createOrReplaceTempView(name)
        return df

    def refresh_all(self) -> dict[str, DataFrame]:
        return {name: self.refresh(name) for name in self.made}

    def update(self) -> list[str]:
        """Refreshes the views of which a table has a commit that they haven't seen, and names them."""
        stale = [n for n in self.made if self.sources[n] and self.seen.get(n) != [s.versions() for s in self.sources[n]]]
        for name in stale:
            self.refresh(name)
        return stale


def report(df: DataFrame, rows: int = 20) -> str:
    """The first rows as a table of text, to be printed."""
    return df._show_string(rows, False)
