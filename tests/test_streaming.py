import pandas as pd
import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidegrid import catalog
from tidegrid.operators.bars import base_bars
from tidegrid.session import use_utc
from tidegrid.sources.trades import event_trades
from tidegrid.streaming import bars as stream

SF = "/root/testdata/sf0.001"


def test_stream_bars_equal_batch_bars_before_the_watermark(spark):
    use_utc(spark)
    interval = catalog.GRID.base_interval_ms
    source = stream.event_stream(spark, SF, "events.parquet")
    streamed = stream.run_to_table(stream.stream_bars(source, interval, "1 hour"), "t")
    batch = base_bars(event_trades(spark, SF), interval * 1_000_000).where("trade_count > 0")
    cut = event_trades(spark, SF).agg(F.max("event_time_ns")).first()[0] - 3_600 * 1_000_000_000
    names = ["symbol", "market_type", "date", "decision_time_ns", "last_price", "trade_count", "seller_trade_count"]
    want = rows(batch.where(F.col("decision_time_ns") <= cut).select(*names), *names[:4])
    assert rows(streamed.select(*names), *names[:4]) == want


def bar_files(spark, folder, interval):
    """Two files per key, the later bars in the second file; gives all bars of the days."""
    batch = base_bars(event_trades(spark, SF), interval * 1_000_000)
    half = F.col("decision_time_ns") % 86_400_000_000_000 < 43_200_000_000_000
    traded = batch.where("trade_count > 0")
    traded.where(half).coalesce(1).write.parquet(folder)
    traded.where(~half).coalesce(1).write.mode("append").parquet(folder)
    return batch


def test_filled_stream_ends_its_days_and_keeps_no_state(spark, tmp_path):
    interval = catalog.GRID.base_interval_ms
    folder, names = str(tmp_path / "bars"), ["symbol", "market_type", "date"]
    batch = bar_files(spark, folder, interval)
    end = batch.agg(F.max("decision_time_ns")).first()[0]
    columns = [*names, "decision_time_ns", "last_price", "trade_count", "quantity"]
    want = rows(batch.select(*columns), *columns[:4])
    traded = batch.where("trade_count > 0").agg(F.max("decision_time_ns")).first()[0]
    assert traded < end  # else no tick is needed
    for ticks, days in ((end, 30), (traded, 29)):
        reports = []
        source = stream.with_clock(stream.bar_stream(spark, folder), stream.write_clock(spark, ticks), "decision_time_ns")
        filled = stream.run_to_table(stream.fill_stream(source, interval), "f", progress=reports)
        found = rows(stream.on_time(filled).select(*columns), *columns[:4])
        closed = {r[2] for r in want} if days == 30 else {r[2] for r in want} - {max(r[2] for r in want)}
        assert [r for r in found if r[2] in closed] == [r for r in want if r[2] in closed]
        left = reports[-1]["stateOperators"][0]["numRowsTotal"]
        assert (left == 0) == (days == 30), reports[-1]
        assert set(found) <= set(want) and stream.late_counts(filled).count() == 0


def test_late_and_repeated_bars_are_counted(spark, tmp_path):
    """A bar before its key's last one goes to the side table, a bar of a closed day is dropped and counted."""
    interval = catalog.GRID.base_interval_ms
    folder = str(tmp_path / "bars")
    batch = bar_files(spark, folder, interval)
    first = batch.where("trade_count > 0").orderBy("date", "symbol", "market_type", "decision_time_ns").limit(3)
    first.coalesce(1).write.mode("append").parquet(folder)  # read together: repeated
    reports = []
    source = stream.with_clock(stream.bar_stream(spark, folder), stream.write_clock(spark, first.first()[3]), "decision_time_ns")
    filled = stream.run_to_table(stream.fill_stream(source, interval), "f", progress=reports)
    assert sum(r["late_bars"] for r in stream.late_counts(filled).collect()) == 3
    assert stream.on_time(filled).groupBy("symbol", "market_type", "date", "decision_time_ns").count().where("count > 1").count() == 0
    assert stream.dropped_behind_watermark(reports) == 0


def test_late_bars_are_no_silent_loss():
    names = ["decision_time_ns", "last_price", *stream.ACTIVITY_COLUMNS]
    bars = pd.DataFrame([[30, 2.0, *(1 for _ in names[2:])], [60, 3.0, *(1 for _ in names[2:])]], columns=names)
    out = stream.fill_gaps(bars, 10, 1.0, 10)
    assert out["decision_time_ns"].tolist() == [20, 30, 40, 50, 60]
    assert out["last_price"].tolist() == [1.0, 2.0, 2.0, 2.0, 3.0]
    assert out["trade_count"].tolist() == [0, 1, 0, 0, 1] and not out["late"].any()
    out = stream.fill_gaps(bars, 30, 1.0, 10)
    assert out["decision_time_ns"].tolist() == [40, 50, 60, 30] and out["late"].tolist() == [False] * 3 + [True]
    assert stream.fill_gaps(bars, 90, 1.0, 10)["late"].all()
    assert stream.fill_gaps(bars.iloc[[0, 0, 1]], 20, 1.0, 10)["late"].tolist() == [False] * 4 + [True]
    with pytest.raises(ValueError):
        stream.fill_gaps(bars, 25, 1.0, 10)
    quiet = stream.quiet_bars(("A", "spot", "d"), 70, 5.0, 100, 10)
    assert quiet["decision_time_ns"].tolist() == [80, 90, 100] and quiet["last_price"].tolist() == [5.0] * 3
