"""Bars of a stream, in several runs, against bars of all rows at once."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ridgeline.operators.bars import compute_bars, restarting
from ridgeline.streaming.bars import stream_bars

COLUMNS = "series string, datetime timestamp, open double, high double, low double, close double, volume double, no_of_trades long, liquidity_sum double, maker_ratio double, maker_volume double, maker_liquidity double, mean double"


def test_restarting_equals_the_loop():
    r = random.Random(1)
    for n in (0, 1, 5, 700):
        values, want, total, group = [r.choice([0.0, 1.0, 2.5, 40.0]) for _ in range(n)], [], 3.0, 0
        for v in values:
            want.append(group)
            total += v
            if total >= 30:
                group, total = group + 1, 0.0
        import numpy as np

        groups, left, last = restarting(np.array(values), 30, 3.0)
        assert (groups.tolist(), left, last) == (want, total, group)


@pytest.mark.parametrize("bar_type", ["volume", "trade"])
def test_stream_equals_batch_after_restarts(spark, tmp_path, bar_type):
    r, rows = random.Random(9), []
    for name, n in (("a", 120), ("b", 40)):
        for i in range(n):
            p = r.uniform(90, 110)
            rows.append((name, dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(hours=i), p, p + 1, p - 1, p + 0.5, r.uniform(1, 9), r.randint(1, 20), r.uniform(100, 900), r.random(), 1.0, 2.0, p))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = f"{tmp_path}/in"
        for part in range(3):  # each run starts again from the checkpoint; rows of a run are out of order
            own = [x for x in rows if part * 40 <= (x[1] - rows[0][1]).total_seconds() / 3600 < part * 40 + 40]
            r.shuffle(own)
            spark.createDataFrame(own, COLUMNS).coalesce(1).write.mode("append").parquet(source)
            bars = stream_bars(spark.readStream.schema(COLUMNS).parquet(source), bar_type, 60, "3 hours")
            bars.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination(240)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {(x["series"], x["datetime"]): x for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    passed = rows[119][1] - dt.timedelta(hours=3)
    want = compute_bars(spark.createDataFrame(rows, COLUMNS).where(F.col("datetime") <= F.lit(passed)), bar_type, 60).collect()
    assert len(want) > 8 and got.keys() == {(x["series"], x["datetime"]) for x in want}
    for x in want:
        y = got[x["series"], x["datetime"]]
        assert all(y[c] == pytest.approx(x[c], rel=1e-9) for c in x.asDict() if c not in ("series", "datetime")), (x, y)
