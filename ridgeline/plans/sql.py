"""SQL text for the DuckDB twins of the queries: small builders, written apart from the engine's own."""

from __future__ import annotations

W = "OVER (PARTITION BY series ORDER BY datetime"


def rows(n: int) -> str:
    return f"{W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(f: str, c: str, n: int) -> str:
    return f"CASE WHEN count({c}) {rows(n)} = {n} THEN {f}({c}) {rows(n)} END"


def mean(c: str, n: int) -> str:
    return roll("avg", c, n)


def std(c: str, n: int) -> str:
    return roll("stddev_samp", c, n)


def lag(c: str, n: int = 1) -> str:
    return f"lag({c}, {n}) {W})" if n >= 0 else f"lead({c}, {-n}) {W})"


def change(c: str, n: int = 1) -> str:
    return f"({c} / {lag(c, n)} - 1)"


def ewm(c: str, alpha: float) -> str:
    return f"list_reduce(list(({c})::DOUBLE) {W} ROWS UNBOUNDED PRECEDING), lambda x, y: {1 - alpha!r} * x + {alpha!r} * y)"


def clip(c: str, lo: float, hi: float) -> str:
    return f"CASE WHEN ({c}) IS NULL THEN NULL ELSE least(greatest({c}, {lo}), {hi}) END"


def near(c: str, q: float) -> str:
    return f"list_sort(list({c}) FILTER ({c} IS NOT NULL))[(floor((count({c}) - 1) * {q!r} + 0.5) + 1)::INT]"


def exact(c: str, q: float) -> str:
    return f"list_sort(list({c}))[(least(floor({q} * count(*)), count(*) - 1) + 1)::INT]"


def stages(base: str, steps: list[dict[str, str]], out: list[str], digits: int = 6, keys: str = "series, datetime", where: str = "") -> str:
    """SELECT over base after adding columns step by step; numbers are rounded, NaN and infinities are null."""
    sql, name = f"WITH b0 AS ({base})", "b0"
    for i, step in enumerate(steps, 1):
        added = ", ".join(f'{e} AS "{c}"' for c, e in step.items())
        sql += f", b{i} AS (SELECT *, {added} FROM {name})"
        name = f"b{i}"
    cols = ", ".join(f'round(CASE WHEN isfinite("{c}"::DOUBLE) THEN "{c}"::DOUBLE END, {digits}) AS "{c}"' if not c.startswith("=") else f'"{c[1:]}"' for c in out)
    return f"{sql} SELECT {keys}, {cols} FROM {name}" + (f" WHERE {where}" if where else "")


TRADES = """SELECT 'u' || (user_id % 4)::VARCHAR AS series, event_id AS trade_id, ts AS datetime, value + 1 AS price,
  (props::JSON ->> '$.k')::DOUBLE + 1 AS quantity, event_type IN ('purchase', 'click') AS is_buyer_maker, event_type FROM events"""


def klines(size: int = 3600, trades: str = TRADES) -> str:
    return f"""SELECT series, time_bucket(INTERVAL {size} SECOND, datetime, TIMESTAMP '1970-01-01') AS datetime, arg_min(price, trade_id) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, trade_id) AS close, avg(price) AS mean, stddev_pop(price) AS std, {exact('price', 0.5)} AS median, {exact('price', 0.75)} - {exact('price', 0.25)} AS iqr,
  sum(quantity) AS volume, avg(is_buyer_maker::INT) AS maker_ratio, count(*) AS no_of_trades, arg_min(price * quantity, trade_id) AS open_liquidity, max(price * quantity) AS high_liquidity,
  min(price * quantity) AS low_liquidity, arg_max(price * quantity, trade_id) AS close_liquidity, sum(price * quantity) AS liquidity_sum,
  sum(is_buyer_maker::INT * quantity) AS maker_volume, sum(is_buyer_maker::INT * price * quantity) AS maker_liquidity FROM ({trades}) GROUP BY 1, 2"""
