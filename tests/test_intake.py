import os

import pytest
from test_bars import candle_line, write_candles

from tickerloom.plans.daily import DailyRun
from tickerloom.sources import intake as K
from tickerloom.sources.candles import clean_candles, scan_klines

DAY_MS, FIRST_MS = 86_400_000, 1_577_836_800_000
MONTH, DAILY = "monthly/AAAUSDT-1d-2020-01.csv", "daily/AAAUSDT-1d-2020-01-03.csv"


def lines(prices, first=0):
    return [candle_line(FIRST_MS + (first + k) * DAY_MS, p) for k, p in enumerate(prices)]


def replace(root, name, rows, seconds):
    write_candles(root, name, rows)
    os.utime(os.path.join(root, name), (1_700_000_000 + seconds,) * 2)


@pytest.fixture
def sources(monkeypatch):
    """What each scan was given."""
    seen, scan = [], K.scan_klines

    def noting(spark, base_path, **more):
        seen.append(base_path)
        return scan(spark, base_path, **more)

    monkeypatch.setattr(K, "scan_klines", noting)
    return seen


def closes(bars):
    return [r.close for r in bars.orderBy("symbol", "date").collect()]


def test_only_new_and_changed_files_are_read(spark, tmp_path, sources):
    root, run = str(tmp_path / "in put"), DailyRun(str(tmp_path / "out"))
    replace(root, MONTH, lines([1.0, 2.0, 3.0]), 0)
    replace(root, DAILY, lines([30.0], 2), 0)
    assert closes(run.bars(spark, root)) == [1.0, 2.0, 30.0]  # the daily file wins
    assert closes(run.bars(spark, root)) == [1.0, 2.0, 30.0] and sources == [root]
    replace(root, "daily/AAAUSDT-1d-2020-01-04.csv", lines([4.0], 3), 0)
    assert closes(run.bars(spark, root)) == [1.0, 2.0, 30.0, 4.0]
    assert len(sources) == 2 and [os.path.basename(p) for p in sources[1]] == ["AAAUSDT-1d-2020-01-04.csv"]
    replace(root, MONTH, lines([1.5, 2.0, 3.0]), 60)  # corrected
    assert closes(run.bars(spark, root)) == [1.5, 2.0, 30.0, 4.0]
    replace(root, DAILY, lines([50.0], 4), 60)  # the day it covered shows again
    got = run.bars(spark, root)
    assert closes(got) == [1.5, 2.0, 3.0, 4.0, 50.0] == closes(clean_candles(scan_klines(spark, root)))
    assert [len(s) for s in sources[2:4]] == [1, 1]


def test_a_failed_intake_is_taken_again(spark, tmp_path, monkeypatch):
    root, intake = str(tmp_path / "in"), K.CandleIntake(str(tmp_path / "state"), fan_in=2)
    replace(root, MONTH, lines([1.0, 2.0]), 0)
    assert intake.candles(spark).count() == 0
    add = K.Tiers.add

    def failing(self, rows, number):
        if self.path.endswith("/files"):
            raise RuntimeError("lost")
        add(self, rows, number)

    monkeypatch.setattr(K.Tiers, "add", failing)
    with pytest.raises(RuntimeError):
        intake.take(spark, root)
    monkeypatch.undo()
    assert intake.files(spark).count() == 0 and intake.candles(spark).count() == 0
    replace(root, DAILY, lines([30.0], 2), 0)
    assert intake.take(spark, root) == 2 and intake.candles(spark).count() == 3
    for k in range(4):  # many intakes stay in few folders
        replace(root, f"daily/AAAUSDT-1d-2020-01-1{k}.csv", lines([float(k)], 10 + k), 0)
        assert intake.take(spark, root) == 1
    assert intake.take(spark, root) == 0 and intake.candles(spark).count() == 7
    assert len(intake._rows.entries(spark)) <= 3
    assert sorted(intake.candles(spark).columns) == sorted(scan_klines(spark, root).columns)
