"""An account of a currency and an asset: a checked, append-only ledger; and a backtest that trades with it."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from statistics import mean, stdev

MOST_USDT, MOST_BTC, SLACK_SELL, SLACK_COVER = 1e12, 1e9, 1e-14, 1e-10


@dataclass
class Account:
    """Amounts are in USDT; what is bought or sold is rounded to 15 places, totals to 2."""

    start_usdt: float
    long: float = 0.0
    short: float = 0.0
    rows: list[dict] = field(default_factory=list)

    def __post_init__(self):
        self._credit, self._debit, self._sums = float(self.start_usdt), 0.0, dict.fromkeys(("buy", "sell", "short", "cover"), 0.0)
        self.rows.append({"position_id": 0, "action": "hold", "amount": 0.0, "btc": 0.0, "price": 0.0, "total_usdt": self.start_usdt, "total_btc": 0.0})

    @property
    def usdt(self) -> float:
        return self.rows[-1]["total_usdt"]

    @property
    def net(self) -> float:
        return self.long - self.short

    def update(self, action: str, amount: float, price: float) -> None:
        if action not in ("buy", "sell", "short", "cover", "hold"):
            raise ValueError(f"unknown action {action}")
        if action != "hold" and not amount > 0:
            raise ValueError("the amount must be positive")
        if not price > 0:
            raise ValueError("the price must be positive")
        if self.usdt > MOST_USDT or self.long > MOST_BTC or amount > MOST_USDT:
            raise ValueError("a limit is exceeded")
        btc = 0.0 if action == "hold" else round(amount / price, 15)
        if action == "buy" and amount > self.usdt:
            raise ValueError("not enough money")
        if action == "sell" and btc > self.long + SLACK_SELL:
            raise ValueError("not enough to sell")
        if action == "cover" and (self.short == 0 or btc > self.short + SLACK_COVER):
            raise ValueError("not so much was borrowed")
        sums = self._sums
        if action != "hold":
            sums[action] += btc
            self._credit += amount if action in ("sell", "short") else 0.0
            self._debit += amount if action in ("buy", "cover") else 0.0
        self.long, self.short = sums["buy"] - sums["sell"], sums["short"] - sums["cover"]
        usdt = self._credit - self._debit
        if not (math.isfinite(usdt) and math.isfinite(self.long)) or usdt > MOST_USDT or self.long > MOST_BTC:
            raise ValueError("a limit is exceeded")
        self.rows.append({"position_id": len(self.rows), "action": action, "amount": float(amount), "btc": btc, "price": float(price), "total_usdt": round(usdt, 2), "total_btc": round(self.long, 15)})


def run_backtest(prediction: list, opens: list[float], closes: list[float], start_usdt: float = 30_000.0, fee_rate: float = 0.001) -> dict[str, float]:
    """Buy at the open and sell at the close of each bar predicted 1, with fees on both sides.

    Only the sale's net amount is booked, so a little of the asset stays in the account.
    """
    if not len(prediction) == len(opens) == len(closes):
        raise ValueError("the columns differ in length")
    account = Account(start_usdt)
    gains, volumes, equity = [], [], []
    for p, o, c in zip(prediction, opens, closes, strict=True):
        before = account.usdt
        if p != 1 or not o > 0 or not c > 0 or before <= 1:
            continue
        stake = before - before * fee_rate
        account.update("buy", stake, o)
        gross = account.long * c
        account.update("sell", gross - gross * fee_rate, c)
        gains.append(account.usdt - before)
        volumes.append(stake)
        equity.append(account.usdt)
    names = ("pnl", "win_rate", "max_drawdown", "expected_value", "sharpe_ratio", "net_long_volume", "net_short_volume", "net_trade_volume")
    if not gains:
        return dict.fromkeys(names, 0)
    peak, drop = equity[0], 0.0
    for e in equity:
        peak = max(peak, e)
        drop = max(drop, (peak - e) / peak)
    steps = [(b - a) / a for a, b in zip([start_usdt, *equity], equity, strict=False) if a] if len(equity) > 1 else []
    spread = stdev(steps) if len(steps) > 1 else 0.0
    sharpe = mean(steps) / spread if spread else 0.0
    found = (account.usdt - start_usdt, sum(g > 0 for g in gains) / len(gains), drop, sum(gains) / len(gains), sharpe, sum(volumes), 0.0, sum(volumes))
    return {n: round(v, 2) for n, v in zip(names, found, strict=True)}
