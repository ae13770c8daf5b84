"""A table that grows batch by batch, kept in few folders.

Each batch is a folder of tier 0. As soon as a tier holds ``fan_in`` folders they are merged into one of the next tier, so after
n batches there are at most ``fan_in - 1`` folders in each of about log(n) tiers. A manifest names the folders that are the
table. Writers add a new version of it once its folders are complete; readers take the newest version and go on with its
folders, whatever is merged meanwhile.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

MANIFEST = "version long, folder string, tier int, first long, last long"


@dataclass(frozen=True)
class Entry:
    """A folder with the batches from ``first`` to ``last``."""

    folder: str
    tier: int
    first: int
    last: int


@dataclass(frozen=True)
class Tiers:
    """``merge`` folds the rows of several folders into rows of the same columns, whatever their cut into folders; without it
    nothing is merged. One writer at a time. ``keep`` older versions stay readable."""

    path: str
    merge: Callable[[DataFrame], DataFrame] | None = None
    fan_in: int = 8
    keep: int = 2

    def versions(self, spark: SparkSession) -> dict[int, list[Entry]]:
        """The versions that are complete; a file that is still being written does not show."""
        try:
            rows = spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/*").collect()  # a few versions of few folders
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        found: dict[int, list[Entry]] = {}
        for r in sorted(rows, key=lambda r: (r.version, r.first)):
            found.setdefault(r.version, []).append(Entry(r.folder, r.tier, r.first, r.last))
        return found

    def entries(self, spark: SparkSession) -> list[Entry]:
        versions = self.versions(spark)
        return versions[max(versions)] if versions else []

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows of all batches as of now, at most a few per key and tier; ``merge`` makes them one per key."""
        folders = [e.folder for e in self.entries(spark)]
        if not folders:
            raise FileNotFoundError(f"{self.path}: no batch has been written")
        return spark.read.parquet(*folders)

    def add(self, rows: DataFrame, number: int) -> None:
        """Add a batch. A batch that is there already, because it is repeated after a failure, changes nothing."""
        spark = rows.sparkSession
        entries = self.entries(spark)
        if any(e.first <= number <= e.last for e in entries):
            return
        folder = self._folder(f"batch-{number}")
        rows.write.parquet(folder)
        self._publish(spark, [*entries, Entry(folder, 0, number, number)])
        if self.merge:
            self._compact(spark)

    def _compact(self, spark: SparkSession) -> None:
        while True:
            entries = self.entries(spark)
            tiers = {e.tier for e in entries}
            full = next((t for t in sorted(tiers) if sum(e.tier == t for e in entries) >= self.fan_in), None)
            if full is None:
                return
            old = [e for e in entries if e.tier == full]
            first, last = min(e.first for e in old), max(e.last for e in old)
            folder = self._folder(f"tier-{full + 1}-{first}-{last}")
            self.merge(spark.read.parquet(*[e.folder for e in old])).write.parquet(folder)
            self._publish(spark, [*[e for e in entries if e.tier != full], Entry(folder, full + 1, first, last)])

    def _folder(self, name: str) -> str:
        return f"{self.path}/parts/{name}-{uuid.uuid4().hex}"

    def _publish(self, spark: SparkSession, entries: list[Entry]) -> None:
        """The next version, which shows at once when its only file is moved into place, and then what is out of use goes."""
        before = self.versions(spark)
        version = max(before, default=0) + 1
        rows = [(version, e.folder, e.tier, e.first, e.last) for e in entries]
        target = f"{self.path}/manifest/version-{version}-{uuid.uuid4().hex}"
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(target)
        self._clean(spark, before, {e.folder for e in entries}, version)

    def _clean(self, spark: SparkSession, before: dict[int, list[Entry]], used: set[str], version: int) -> None:
        """Drop versions older than ``keep`` and the folders that only they name. What a crash leaves behind is named by no
        version and read by nobody."""
        gone = [v for v in before if v < version - self.keep]
        kept = used | {e.folder for v in before if v not in gone for e in before[v]}
        folders = {e.folder for v in gone for e in before[v]} - kept
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for v in gone:
            for status in files.globStatus(hadoop.Path(f"{self.path}/manifest/version-{v}-*")) or []:
                files.delete(status.getPath(), True)
        for folder in folders:
            files.delete(hadoop.Path(folder), True)
