"""Activity bars of a stream of klines: the running sum is state, rows are taken in the order of time once the watermark has passed them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ridgeline.operators.bars import COLUMN, restarting

#: A bar's sums, and the means weighted by trades.
_SUMS, _WEIGHTED = ("volume", "no_of_trades", "liquidity_sum", "maker_volume", "maker_liquidity"), ("maker_ratio", "mean")
_ROW = ("datetime", "open", "high", "low", "close", *_SUMS, *_WEIGHTED)
#: The open bar: time, prices, sums (weighted means as sums), rows, the running sum; then the key's first time, the seconds to its second, and rows so far.
_OPEN = ("at", "open", "high", "low", "close", *_SUMS, *_WEIGHTED, "bar_count", "total", "first", "base", "seen")
_BARS = ("open", "high", "low", "close", *_SUMS, *_WEIGHTED)


def _output(df: DataFrame, keys: tuple[str, ...]) -> T.StructType:
    return T.StructType([*(df.schema[k] for k in keys), T.StructField("datetime", T.TimestampType()), *(T.StructField(c, T.DoubleType()) for c in _BARS), T.StructField("bar_count", T.LongType()), T.StructField("base_interval", T.DoubleType())])


class _Bars(StatefulProcessor):
    """State of a key: rows that the watermark hasn't passed yet (as many as come in its delay), and one open bar."""

    def __init__(self, threshold: float, column: str, names: list[str]):
        self.threshold, self.column, self.names = threshold, column, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField("micros", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in _ROW[1:])]))
        self.open = handle.getValueState("open", T.StructType([T.StructField(c, T.DoubleType()) for c in _OPEN]))

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        new = []
        for pdf in rows:
            micros = pdf["datetime"].astype("datetime64[us]").astype("int64")
            columns = [np.where(pdf[c].isna(), 0.0, pdf[c].astype(float)) for c in _ROW[1:]]
            new += [(int(m), *map(float, v)) for m, *v in zip(micros, *columns, strict=True)]
        yield from self._advance(key, [*self.waiting.get(), *new], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        yield from self._advance(key, list(self.waiting.get()), timerValues)

    def _advance(self, key, rows: list[tuple], timerValues) -> Iterator:
        """Take the rows up to the watermark in order; the others wait for a timer."""
        import pandas as pd

        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(map(tuple, rows))
        ready = [r for r in rows if r[0] <= passed]
        left = rows[len(ready) :]
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(left[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        if ready:
            bar = dict(zip(_OPEN, self.open.get(), strict=True)) if self.open.exists() else dict.fromkeys(_OPEN, 0.0)
            values = np.array([r[_ROW.index(self.column)] for r in ready])
            groups, total, after = restarting(values, self.threshold, bar["total"])
            closed = []
            for g in range(int(groups[-1]) + 1):
                self._add(bar, ready[slice(*np.searchsorted(groups, [g, g + 1]))])
                if g < after:  # full
                    closed.append(self._bar(key, bar))
                    bar |= dict.fromkeys(_OPEN[: _OPEN.index("first")], 0.0)
            bar["total"] = total
            self.open.update(tuple(float(bar[c]) for c in _OPEN))
            if closed:
                yield pd.DataFrame(closed, columns=self.names)

    def _add(self, bar: dict, rows: list[tuple]) -> None:
        """Take rows into the open bar."""
        for r in rows:
            row = dict(zip(_ROW, r, strict=True))
            if not bar["seen"]:
                bar["first"] = float(row["datetime"])
            elif bar["seen"] == 1:
                bar["base"] = (row["datetime"] - bar["first"]) / 1e6
            bar["seen"] += 1
            if not bar["bar_count"]:
                bar |= {"at": row["datetime"], "open": row["open"], "high": row["high"], "low": row["low"]}
            bar |= {"high": max(bar["high"], row["high"]), "low": min(bar["low"], row["low"]), "close": row["close"], "bar_count": bar["bar_count"] + 1}
            for c in _SUMS:
                bar[c] += row[c]
            for c in _WEIGHTED:
                bar[c] += row[c] * row["no_of_trades"]

    def _bar(self, key, bar: dict) -> list:
        import pandas as pd

        trades = bar["no_of_trades"]
        means = [bar[c] / trades if trades else float("nan") for c in _WEIGHTED]
        return [*key, pd.Timestamp(int(bar["at"]), unit="us"), *(bar[c] for c in ("open", "high", "low", "close", *_SUMS)), *means, int(bar["bar_count"]), bar["base"]]


def stream_bars(klines: DataFrame, bar_type: str, threshold: float, delay: str = "2 hours", keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Bars of a streaming frame of klines whose datetime is a timestamp, as activity_bars makes them, each given out once, when it is full.

    A bar is full when the watermark has passed the row that crosses the threshold; rows later than the delay are dropped. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass). The base interval is 0 in bars that close with a key's first row.
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    schema = _output(klines, keys)
    rows = klines.select(*keys, *_ROW).withWatermark("datetime", delay)
    return rows.groupBy(*keys).transformWithStateInPandas(_Bars(threshold, COLUMN[bar_type], schema.names), schema, "Append", "EventTime")
