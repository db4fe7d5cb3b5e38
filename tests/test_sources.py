"""File formats and tables with hand-made inputs."""

import lzma
import struct

import pytest
from pyspark.sql import functions as F

from tickloom.sources import files, tables
from tickloom.streaming import ticks as L


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_tick_file(spark, tmp_path):
    p = _write(tmp_path / "t.csv", "timestamp,bid,ask,volume\n2024-01-01T00:00:01,1.085,1.086,3\n2024-01-01T00:00:00,1.086,1.085,1\n")
    r = files.load_ticks(spark, p, "EURUSD").collect()
    assert len(r) == 1 and r[0].pair == "EURUSD" and abs(r[0].spread - 0.001) < 1e-12 and r[0].volume == 3
    with pytest.raises(ValueError):
        files.load_ticks(spark, str(tmp_path / "t.xlsx"))


def test_tick_exports(spark, tmp_path):
    _write(tmp_path / "EURUSD" / "a.csv", "20240101 00:00:00.123;1.10500;1.10502;0.75\nnot a clock;1;2;3\n20240101 00:00:05.000;1.2;1.1;1\n")
    _write(tmp_path / "EURUSD" / "b.csv", "2024.01.01,00:00:00.123,1.2,1.3,9\n2024.01.02,10:00:00,1.2,1.3,1\n")
    raw = files.load_tick_exports(spark, str(tmp_path))
    rows = files.first_per_time(raw).orderBy("ts").collect()
    assert [(r.pair, r.bid) for r in rows] == [("EURUSD", 1.105), ("EURUSD", 1.2)]
    assert str(rows[0].ts) == "2024-01-01 00:00:00.123000"
    inside = files.first_per_time(raw, "2024-01-02 00:00:00", "2024-01-02 10:00:00").collect()
    assert len(inside) == 1
    _write(tmp_path / "BAD" / "c.csv", "1;2;3\n")
    with pytest.raises(Exception, match="width"):
        files.load_tick_exports(spark, str(tmp_path)).collect()


def test_bar_exports(spark, tmp_path):
    a = _write(tmp_path / "a.csv", "DateTime,BidOpen,BidHigh,BidLow,BidClose,AskOpen,AskHigh,AskLow,AskClose,Volume\n"
               "2024-01-01 00:00:00,1,2,0.5,1.5,1,2,0.5,1.6,10\n2024-01-01 00:01:00,1,2,0.5,,1,2,0.5,1.6,10\n")
    b = _write(tmp_path / "b.csv", "20240101 00:00:00,1,2,0.5,1.5,1,2,0.5,1.6,10\n")
    c = _write(tmp_path / "c.csv", "DateTime,BidHigh,BidLow,AskHigh,AskLow\n2024-01-01 00:00:00,2,1,3,2\n")
    for p, bid, ask, volume in ((a, 1.5, 1.6, 10), (b, 1.5, 1.6, 10), (c, 1.5, 2.5, 1)):
        r = files.load_bar_exports(spark, p, "EURUSD").collect()
        assert [(x.bid, x.ask, x.volume) for x in r] == [(bid, ask, volume)]


def test_hour_blobs(spark, tmp_path):
    def blob(folder, records):
        path = tmp_path / folder
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(lzma.compress(b"".join(struct.pack(">IIIff", *r) for r in records)) if records else b"")
    blob("EURUSD/2024/00/05/13h_ticks.bi5", [(1500, 110502, 110500, 1.0, 2.005), (2000, 110503, 110500, 0.5, 0.5)])
    blob("USDJPY/2024/11/31/00h_ticks.bi5", [(0, 150010, 150000, 1.0, 1.0)])
    blob("USDJPY/2024/11/31/01h_ticks.bi5", [])
    r = files.load_hour_blobs(spark, str(tmp_path)).orderBy("pair", "ts").collect()
    assert [(x.pair, str(x.ts), x.bid, x.ask, x.volume) for x in r] == [
        ("EURUSD", "2024-01-05 13:00:01.500000", 1.105, 1.10502, 1.5),
        ("EURUSD", "2024-01-05 13:00:02", 1.105, 1.10503, 0.5),
        ("USDJPY", "2024-12-31 00:00:00", 150.0, 150.01, 1.0)]


def test_daily_series(spark, tmp_path):
    _write(tmp_path / "GOLD_stooq_xau.csv", "timestamp,value\n2024-01-01,1\n2024-01-02,x\n2024-01-03,3\n")
    _write(tmp_path / "GOLD_yahoo_gc.csv", "timestamp,value\n2024-01-02,9\n")
    _write(tmp_path / "IRON_ORE_yahoo_tio.csv", "timestamp,value\n2020-01-02,7\n")
    s = files.load_daily_series(spark, str(tmp_path))
    p = files.daily_panel(s, "2024-01-02", "2024-01-31").orderBy("asset").collect()
    assert [(r.asset, r.provider, r.value) for r in p] == [("GOLD", "stooq", 3.0), ("IRON_ORE", "yahoo", 7.0)]


def test_indicators(spark, tmp_path):
    _write(tmp_path / "CPI.json", '{"data": [{"date": "2024-01-05", "value": "2.0"}, {"date": "bad", "value": "1"},'
           ' {"date": "2024-02-05", "value": "."}, {"date": "2030-01-01", "value": "1"}, {"date": "2024-03-01", "value": "3", "forecast": "2.5"}]}')
    r = files.load_indicators(spark, str(tmp_path), "2024-01-01", "2024-12-31").orderBy("ts").collect()
    assert [(x.event, x.actual, x.forecast, x.prior, x.impact) for x in r] == [
        ("CPI", 2.0, 1.98, 1.96, "High"), ("CPI", 3.0, 2.5, 2.94, "High")]


def test_run_logs(spark, tmp_path):
    _write(tmp_path / "big_0331_tft_cv.json", '[{"fold": 0, "best_metric": 1.5, "history": {"train_loss": [3, 2], "dir_acc": [0.4, 0.6]}},'
           ' {"fold": 1, "best_metric": 0.5, "history": {"train_loss": [1]}}]')
    _write(tmp_path / "tft_fold0_config.json", '{"best_val_sharpe_proxy": 0.7}')
    from tickloom.operators.performance import leaderboard

    logs = files.load_run_logs(spark, str(tmp_path))
    assert {(r.run, r.model, r.fold, r.epochs, r.best_acc) for r in logs.collect()} == {
        ("big_0331", "tft", 0, 2, 0.6), ("big_0331", "tft", 1, 1, 0.0)}
    top = leaderboard(logs).first()
    assert (top.folds, top.mean_epochs, top.best_metric, top.mean_metric) == (2, 1, 1.5, 1.0)
    assert files.load_fold_configs(spark, str(tmp_path)).first().best_checkpoint == 0.7


def test_source_choice(spark):
    a = spark.createDataFrame([("x", 1)], "pair string, v int")
    b = spark.createDataFrame([("x", 2), ("y", 3)], "pair string, v int")
    assert {(r.pair, r.v) for r in files.pick_source({"a": a, "b": b}).collect()} == {("x", 1), ("y", 3)}
    assert files.pick_source({"a": a, "b": b}, "b").count() == 2
    with pytest.raises(ValueError):
        files.pick_source({"a": a}, "zzz")


def test_tick_table_is_idempotent(spark, tmp_path):
    t = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, id) ts, 'p' pair, 1.0D bid, 1.1D ask, 2.0D volume, 's' source from range(50)")
    path = str(tmp_path / "ticks")
    tables.write_ticks(t.where("hour(ts) < 10"), path)
    tables.write_ticks(t, path)
    tables.write_ticks(t, path)
    assert spark.read.parquet(path).count() == 50
    r = tables.read_range(spark.read.parquet(path), "p", "2024-01-01 05:00:00", "2024-01-02 00:00:00", 3).collect()
    assert [str(x.ts) for x in r] == ["2024-01-01 22:00:00", "2024-01-01 23:00:00", "2024-01-02 00:00:00"]
    assert str(tables.latest(spark.read.parquet(path)).first().ts) == "2024-01-03 01:00:00"
    tables.replace_days(t.where("day(ts) = 1").limit(3), path)
    assert spark.read.parquet(path).where("date = '2024-01-01'").count() == 3
    assert spark.read.parquet(path).count() == 29


def test_bad_messages_are_dropped(spark):
    raw = spark.createDataFrame([('{"time":"2024-01-01T00:00:00Z","pair":"p","bid":1,"ask":2,"volume":3}',), ("nonsense",), ("{}",)], "value string")
    assert L.tick_messages(raw).count() == 1
    news = spark.createDataFrame([('{"time":"2024-01-01T00:00:00Z","headline":"h","sentiment":0.5,"source":"s"}',), ("{",)], "value string")
    assert L.news_messages(news).first().sentiment == 0.5


def test_replayed_batch_adds_nothing(spark, tmp_path):
    raw = spark.createDataFrame([('{"time":"2024-01-01T00:00:00Z","pair":"p","bid":1,"ask":2,"volume":3}',)], "value string")
    raw.write.text(str(tmp_path / "in"))
    stream = L.tick_messages(spark.readStream.schema("value string").text(str(tmp_path / "in")))
    table = str(tmp_path / "table")
    for run in ("a", "b"):  # a lost checkpoint replays everything
        L.store_ticks(stream, table, str(tmp_path / run)).awaitTermination()
    assert spark.read.parquet(table).count() == 1
    assert spark.read.parquet(table).select(F.round("spread", 6)).first()[0] == 1.0
