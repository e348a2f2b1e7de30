"""Versioned snapshots: one folder a run, published by a commit file; readers pin what they resolved."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession

from symloom.model import SCHEMAS
from symloom.runtime import Files

SCHEMA_VERSION = 1


class SnapshotStore:
    """Runs below ``root``. A run counts only once its meta file exists; the live pointer names a published run.

    Files are never changed in place: a pointer is a new file of growing number, the newest counts.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)

    def _run(self, run: str) -> str:
        return f"{self.root}/runs/{run}"

    def write(self, run: str, tables: dict[str, DataFrame], partition: dict[str, str] | None = None) -> None:
        """Tables of an unpublished run; edges are best partitioned by kind."""
        for name, df in tables.items():
            w = df.write.mode("overwrite")
            if partition and name in partition:
                w = w.partitionBy(partition[name])
            w.parquet(f"{self._run(run)}/{name}")

    def publish(self, run: str) -> None:
        self.files.write_text(f"{self._run(run)}/meta.json", json.dumps({"schema": SCHEMA_VERSION, "at": time.time()}))
        self.point(run)

    def point(self, run: str) -> None:
        """Make a published run the live one."""
        if run not in self.published():
            raise ValueError(f"run {run} is not published")
        self.files.write_text(f"{self.root}/live/{len(self.files.children(f'{self.root}/live')):08d}", run)

    def published(self) -> list[str]:
        return [r for r in self.files.children(f"{self.root}/runs") if self.files.exists(f"{self._run(r)}/meta.json")]

    def live(self) -> str | None:
        names = self.files.children(f"{self.root}/live")
        return self.files.read_text(f"{self.root}/live/{names[-1]}") if names else None

    def read(self, table: str, run: str | None = None) -> DataFrame:
        """A table of the live run, or of a pinned one; another schema version is refused."""
        run = run or self.live()
        if run is None or run not in self.published():
            raise LookupError("no published snapshot")
        if json.loads(self.files.read_text(f"{self._run(run)}/meta.json"))["schema"] != SCHEMA_VERSION:
            raise LookupError("the snapshot has another schema version; build it anew")
        return self.spark.read.parquet(f"{self._run(run)}/{table}")

    def rollback(self) -> str:
        """Back to the published run before the live one, in the order of names."""
        now = self.live()
        before = [r for r in self.published() if now is None or r < now]
        if not before:
            raise LookupError("no earlier run")
        self.point(before[-1])
        return before[-1]

    def recover(self) -> list[str]:
        """Delete runs that were never published."""
        gone = [r for r in self.files.children(f"{self.root}/runs") if r not in self.published()]
        for r in gone:
            self.files.delete(self._run(r))
        return gone

    def collect_garbage(self, keep: int, pinned: set[str] = frozenset()) -> list[str]:
        """Delete all but the newest ``keep`` published runs; the live and pinned ones stay."""
        runs = self.published()
        stay = {*runs[-keep:], self.live(), *pinned} if keep else {self.live(), *pinned}
        gone = [r for r in runs if r not in stay]
        for r in gone:
            self.files.delete(self._run(r))
        return gone


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])
