import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

START = dt.date(2020, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def usd_series(spark):
    """Build USD bars from ``{symbol: prices}``; ``days`` gives day offsets when dates have gaps."""

    def build(prices, days=None, volume=1.0, btc=0.0):
        rows = []
        for symbol, values in prices.items():
            offsets = days or range(len(values))
            for k, (offset, price) in enumerate(zip(offsets, values)):
                moved = btc[k] if isinstance(btc, list) else btc
                amount = volume[k] if isinstance(volume, list) else volume
                rows.append((symbol, START + dt.timedelta(days=offset), price, float(amount), float(moved)))
        schema = "symbol string, date date, close_usd double, volume_usd double, btc_return double"
        return spark.createDataFrame(rows, schema)

    return build


def by_key(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}
