"""Trees of headerless candle files, one file per symbol and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.functions.calendar import epoch_to_date
from tickerloom.operators.bars import candle_order, dedup_key
from tickerloom.schemas import CANDLE_FILE
from tickerloom.workspace import settle

# Fixed value: ``{SYMBOL}-{interval}-{period}``, looked for in the value of the last ``key=value`` folder (a Spark writer
# names its files at random) or else in the file name.
SYMBOL_PATTERN = r"([^/=]+)-(\d+[a-zA-Z])-"
LAST_FOLDER, FILE_NAME = r".*/[^/=]+=([^/]+)/[^/]*$", r"([^/]*)$"


def symbol_from_path(path: Column) -> Column:
    """Ticker in a candle path, null when the name does not follow the pattern."""
    folder = F.nullif(F.regexp_extract(path, LAST_FOLDER, 1), F.lit(""))
    named = F.coalesce(folder, F.regexp_extract(path, FILE_NAME, 1))
    return F.nullif(F.regexp_extract(named, SYMBOL_PATTERN, 1), F.lit(""))


def label_candles(raw: DataFrame) -> DataFrame:
    return raw.withColumns(
        {"symbol": symbol_from_path(F.col("file_path")), "date": epoch_to_date(F.col("open_time"))}
    )


def scan_klines(
    spark: SparkSession, base_path: str | list[str], mode: str = "PERMISSIVE", malformed: str | None = None
) -> DataFrame:
    """All candle rows below ``base_path``, or of a list of files, with the file they came from, ticker and date.

    ``mode`` is the reader's treatment of malformed lines; with ``malformed`` their text is kept in a column of that
    name. Rows from files without a ticker in their name keep a
    null symbol here; :func:`unnamed_rows` counts them and :func:`clean_candles` drops them.
    """
    schema = CANDLE_FILE if malformed is None else T.StructType([*CANDLE_FILE, T.StructField(malformed, T.StringType())])
    reader = settle(spark).read.schema(schema).option("header", "false").option("mode", mode)
    if malformed is not None:
        reader = reader.option("columnNameOfCorruptRecord", malformed)
    raw = reader.option("recursiveFileLookup", "true").csv(base_path)
    return label_candles(raw.select("*", F.col("_metadata.file_path").alias("file_path")))


def unnamed_rows(candles: DataFrame) -> DataFrame:
    return candles.agg(F.count_if(F.col("symbol").isNull()).alias("n_unnamed"))


def clean_candles(candles: DataFrame) -> DataFrame:
    """One row per symbol and date; where files overlap the daily one wins."""
    return dedup_key(candles.na.drop(subset=["symbol", "date"]), candle_order())


def write_klines(bars: DataFrame, path: str, stem: Column) -> None:
    """Write bars as candle files, one folder per value of ``stem``."""
    known = {f.name: F.lit(0).cast(f.dataType) for f in CANDLE_FILE}
    known.update({c: F.col(c) for c in bars.columns if c in known})
    rows = bars.select(*[v.alias(n) for n, v in known.items()], stem.alias("file"))
    rows.repartition("file").sortWithinPartitions("file", "open_time").write.partitionBy("file").mode("overwrite").csv(path)
