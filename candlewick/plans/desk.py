"""Order handling that the strategies share: fills, lots, resting and queued orders."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Lot:
    at: int
    price: float
    code: str


@dataclass
class Desk:
    """Codes per bar, finished trades, lots held.  ``bars`` maps names to arrays of one ticker, oldest first."""

    bars: dict[str, np.ndarray]
    codes: list[str] = field(default_factory=list)
    trades: list[dict] = field(default_factory=list)
    lots: list[Lot] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.o, self.h, self.l, self.c = (self.bars[k] for k in ("open", "high", "low", "close"))
        self.n = len(self.c)
        self.codes = [""] * self.n

    def mark(self, i: int, code: str) -> None:
        self.codes[i] = f"{self.codes[i]} + {code}" if self.codes[i] else code

    def buy(self, i: int, price: float, code: str) -> None:
        self.lots.append(Lot(i, price, code))
        self.mark(i, code)

    def _record(self, lot: Lot, i: int, price: float, code: str, resolved: bool = True) -> None:
        self.trades.append({"entry_at": lot.at, "entry_price": lot.price, "entry_code": lot.code, "exit_at": i, "exit_price": price, "exit_code": code, "bars_held": i - lot.at, "gross_return_pct": (price / lot.price - 1) * 100, "resolved": resolved})

    def sell(self, i: int, price: float, code: str, note: str | None = None) -> None:
        """All lots; "TP" or "CL" goes in front of a code that leaves it open, by the lot's own gain."""
        for lot in self.lots:
            self._record(lot, i, price, code if code[:2] in ("TP", "CL", "SE", "SL") else f"{'TP' if price > lot.price else 'CL'} {code}")
        self.mark(i, note or self.trades[-1]["exit_code"])
        self.lots.clear()

    def finish(self, price=None) -> None:
        """Lots still held are open trades, marked at the last close."""
        for lot in self.lots:
            last = self.c[-1] if price is None else price
            self._record(lot, self.n - 1, last, "OPEN", False)


class NextOpen:
    """Strategies that decide at a close and fill at the next open, with at most one lot.

    A subclass gives ``signal`` (per bar), ``code`` of a buy, ``arm`` (a signal was taken),
    ``filled``, ``resting`` (price and code of an order hit inside the bar; the stop before the
    limit) and ``manage`` (at the close of a held bar; a code queues a sale at the next open).
    Resting orders live from the first close after the fill.
    """

    code = "BUY"

    def __init__(self, bars: dict[str, np.ndarray], features: dict[str, np.ndarray]):
        self.desk = Desk(bars)
        self.f = features
        self.entry, self.entry_at, self.live = np.nan, -1, False
        self.buying, self.selling = False, ""

    def arm(self, i: int) -> None: ...

    def filled(self, i: int) -> None: ...

    def resting(self, i: int) -> tuple[float, str] | None: ...

    def manage(self, i: int) -> str: ...

    def walk(self) -> Desk:
        """Over all bars, from the orders that are queued; what is held at the end stays held."""
        d, signal = self.desk, self.f["signal"]
        for i in range(d.n):
            if self.selling:
                d.sell(i, d.o[i], self.selling)
                self.selling = ""
            if self.buying:
                self.buying, self.live = False, False
                self.entry, self.entry_at = d.o[i], i
                d.buy(i, d.o[i], self.code)
                self.filled(i)
            if d.lots and self.live and (hit := self.resting(i)):
                d.sell(i, *hit)
            if d.lots:
                self.selling = self.manage(i) or ""
                self.live = True
            elif signal[i]:
                self.buying = True
                self.arm(i)
        return d

    def run(self) -> Desk:
        d = self.walk()
        d.finish()
        d.armed = self.buying
        return d
