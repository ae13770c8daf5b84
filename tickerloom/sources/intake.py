"""Incremental intake of candle files: a run lists all files but reads only those it has not taken yet.

What was taken is a table of files with their size and time of change. Rows are kept as they were read, with the number of
their intake, since a file that is replaced may give way to one it had covered. A file's rows count if they come from the
intake that took its present version.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.schemas import CANDLE_FILE
from tickerloom.sources.candles import label_candles, scan_klines
from tickerloom.streaming.tiers import Tiers
from tickerloom.workspace import settle, stage

FILES = "file_path string, size long, changed timestamp, intake long"


def listed_files(spark: SparkSession, base_path: str) -> DataFrame:
    """``file_path, size, changed`` of all files below a folder, and the ``path`` to open them by; no file is opened."""
    files = settle(spark).read.format("binaryFile").option("recursiveFileLookup", "true").load(base_path)
    return files.select(
        "path",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("changed"),
    )


def _as_is(rows: DataFrame) -> DataFrame:
    return rows


@dataclass(frozen=True)
class CandleIntake:
    """Rows and files taken so far, below ``path`` on shared storage. One run at a time."""

    path: str
    fan_in: int = 8

    @property
    def _rows(self) -> Tiers:
        return Tiers(f"{self.path}/rows", _as_is, self.fan_in)

    @property
    def _files(self) -> Tiers:
        return Tiers(f"{self.path}/files", _as_is, self.fan_in)

    def files(self, spark: SparkSession) -> DataFrame:
        """Each file's last taken version and its intake."""
        if not self._files.entries(spark):
            return spark.createDataFrame([], FILES)
        version = F.max_by(F.struct("size", "changed", "intake"), "intake").alias("v")
        return self._files.read(spark).groupBy("file_path").agg(version).select("file_path", "v.*")

    def take(self, spark: SparkSession, base_path: str) -> int:
        """Read the files below ``base_path`` that are new or changed, and return how many.

        Rows are added before the files that name them, so a run that fails in between leaves rows that nothing counts, and
        the next run takes their files again. Only the names of files new since the last run come to the driver; a first run reads the
        folder as a whole.
        """
        known = self.files(spark)
        fresh = listed_files(spark, base_path).join(known.drop("intake"), ["file_path", "size", "changed"], "left_anti")
        fresh = stage(fresh, "new_files")
        n = fresh.count()
        if not n:
            return 0
        first = not self._files.entries(spark)
        source = base_path if first else [r["path"] for r in fresh.select("path").collect()]
        number = max((e.last for e in self._rows.entries(spark)), default=-1) + 1
        rows = scan_klines(spark, source).join(fresh.select("file_path"), "file_path", "left_semi")
        self._rows.add(rows.withColumn("intake", F.lit(number).cast("long")), number)
        self._files.add(fresh.drop("path").withColumn("intake", F.lit(number).cast("long")), number)
        return n

    def candles(self, spark: SparkSession) -> DataFrame:
        """All rows of the present version of every file, as :func:`scan_klines` gives them."""
        if not self._rows.entries(spark):
            return label_candles(spark.createDataFrame([], CANDLE_FILE).withColumn("file_path", F.lit("")))
        live = self.files(spark).select("file_path", "intake")
        return self._rows.read(spark).join(live, ["file_path", "intake"], "left_semi").drop("intake")
