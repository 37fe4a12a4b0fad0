"""Zips as a data source, logs that a repeated job doesn't double, sliding windows and sessions."""

from __future__ import annotations

import datetime as dt
import resource
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from ridgeline.operators.klines import klines, sessions, sliding
from ridgeline.sources import trades as tr
from ridgeline.sources import zipped


@pytest.fixture
def zips(tmp_path):
    for month in ("2024-01", "2024-02"):
        with zipfile.ZipFile(tmp_path / f"trades-{month}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for part in range(2):
                z.writestr(f"{month}-{part}.csv", "".join(f"{i},{i / 2},{'true' if i % 2 else 'false'},{month}\n" for i in range(part * 100, part * 100 + 100)))
            z.writestr("readme.txt", "no rows")
    return tmp_path


def test_zips_are_read_file_by_file(spark, zips):
    zipped.register(spark)
    read = spark.read.format("zipped_csv").schema("id long, price double, maker boolean, month string")
    df = read.load(f"{zips}/*.zip")
    assert df.rdd.getNumPartitions() == 4 and df.count() == 400 and df.where("maker").count() == 200
    assert df.agg(F.sum("price")).first()[0] == 2 * sum(i / 2 for i in range(200))
    assert {r[0] for r in read.option("months", "2024-02").load(str(zips)).select("month").distinct().collect()} == {"2024-02"}
    few = spark.read.format("zipped_csv").schema("price double").option("names", "id,price,maker,month").load(f"file://{zips}/trades-2024-01.zip")
    assert few.columns == ["price"] and few.count() == 200
    with pytest.raises(Exception, match="schema"):
        spark.read.format("zipped_csv").load(str(zips)).count()


def test_headers_and_blocks(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.writestr("a.CSV", "id,name\n" + "".join(f"{i},row {i}\n" for i in range(5_000)))
        z.writestr("empty.csv", "id,name\n")
    zipped.register(spark)
    monkeypatch.setattr(zipped, "BLOCK_BYTES", 1_000)
    reader = zipped.ZippedCsvReader(spark.createDataFrame([], "id long, name string").schema, {"path": str(tmp_path / "one.zip"), "header": "true"})
    parts = reader.partitions()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    batches = list(reader.read(parts[0]))
    assert len(batches) > 20 and sum(b.num_rows for b in batches) == 5_000 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000
    df = spark.read.format("zipped_csv").schema("id long, name string").option("header", "true").load(str(tmp_path))
    assert df.count() == 5_000 and df.where("name = 'row 17'").first()["id"] == 17


def test_a_run_is_written_once(spark, tmp_path):
    log = spark.createDataFrame([(0, 0.5), (1, 0.6)], "round_id int, auc double")
    for fmt in ("parquet", "csv"):
        for run in ("one", "two", "two"):
            tr.write_log(log, str(tmp_path / fmt), fmt, run)
        got = spark.read.option("header", True).format(fmt).load(str(tmp_path / fmt))
        assert {(r["run"], r["count"]) for r in got.groupBy("run").count().collect()} == {("one", 2), ("two", 2)}
    write = tr.batch_log(str(tmp_path / "stream"))
    for batch in (0, 1, 1):
        write(log, batch)
    assert spark.read.parquet(str(tmp_path / "stream")).count() == 4
    for run in ("one", "two", "two"):
        tr.to_sqlite(log, str(tmp_path / "log.sqlite"), "runs", run)
    with sqlite3.connect(tmp_path / "log.sqlite") as con:
        assert con.execute("SELECT run, count(*) FROM runs GROUP BY run ORDER BY run").fetchall() == [("one", 2), ("two", 2)]


def _ticks(spark, rows):
    return spark.createDataFrame([("a", i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), 10.0 + i, 1.0, i % 2 == 0) for i, s in enumerate(rows)], "series string, trade_id long, datetime timestamp, price double, quantity double, is_buyer_maker boolean")


def test_sliding_windows_and_sessions(spark):
    df = _ticks(spark, [0, 50, 70, 400, 410, 2_000])
    got = {(r["datetime"].minute, r["datetime"].second): (r["no_of_trades"], r["open"], r["close"]) for r in sliding(df, 120, 60).where("datetime >= '2024-01-01'").collect()}
    assert got[0, 0] == (3, 10.0, 12.0) and got[1, 0] == (1, 12.0, 12.0) and got[6, 0] == (2, 13.0, 14.0)
    assert sliding(df, 3600, 3600).select("open", "close", "volume").collect() == klines(df, 3600).select("open", "close", "volume").collect()
    found = [(r["no_of_trades"], (r["end"] - r["datetime"]).total_seconds()) for r in sessions(df, 100).orderBy("datetime").collect()]
    assert found == [(3, 170.0), (2, 110.0), (1, 100.0)]
    with pytest.raises(ValueError):
        sliding(df, 60, 120)


def test_streamed_sessions_equal_batch(spark, tmp_path):
    df = _ticks(spark, [0, 50, 70, 400, 410, 2_000, 9_000])
    for lo, hi in ((0, 3), (3, 7)):
        df.where(f"trade_id >= {lo} AND trade_id < {hi}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 100, delay="1 minute")
        stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(240)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("datetime").collect()
    assert got == sessions(df, 100).where("datetime < '2024-01-01 02:00:00'").orderBy("datetime").collect() and len(got) == 3
