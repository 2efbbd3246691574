"""Intermediate tables of the training-data operators: the library's durable tables, and what else these operators share."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame

from corpusloom.workspace import BROADCAST_BYTES, Tables, small

__all__ = ["BROADCAST_BYTES", "Workspace", "fresh", "parts", "small"]


class Workspace(Tables):
    """A folder of intermediate tables of one run."""

    table = Tables.keep

    def drop(self, name: str) -> None:
        """Deletes a table that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def parts(rows: int, each: int) -> int:
    return max(1, ceil(rows / each))
