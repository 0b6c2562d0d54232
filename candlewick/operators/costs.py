"""Trading costs: tick grid, slippage and fees, as Column expressions."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

SLACK = 1e-9


class CostError(ValueError):
    """A cost configuration that can't be used."""


@dataclass(frozen=True)
class Band:
    lower: float
    upper: float | None
    tick: float


@dataclass(frozen=True)
class Costs:
    buy_fee: float
    sell_fee: float
    bands: tuple[Band, ...] = field(default_factory=tuple)
    slippage_ticks: int = 0
    lot_size: int = 100
    verified: bool = True

    def __post_init__(self) -> None:
        if not self.bands:
            raise CostError("no tick bands")
        if self.bands[0].lower != 0:
            raise CostError("the first band starts above 0")
        for band, after in zip(self.bands, [*self.bands[1:], None]):
            if band.tick <= 0:
                raise CostError("a tick is not positive")
            if after is None and band.upper is not None:
                raise CostError("the last band has an upper end")
            if after is not None and band.upper != after.lower:
                raise CostError("bands leave a gap or overlap")

    @classmethod
    def from_dict(cls, config: dict) -> Costs:
        if not config.get("verified", False):
            raise CostError("the configuration is not verified")
        bands = tuple(Band(b["lower"], b.get("upper"), b["tick"]) for b in config["tick_bands"])
        return cls(config["buy_fee"], config["sell_fee"], bands, config.get("slippage_ticks", 0), config.get("lot_size", 100))

    @classmethod
    def from_file(cls, path: str | Path) -> Costs:
        return cls.from_dict(json.loads(Path(path).read_text()))

    def tick(self, price: Column) -> Column:
        out = None
        for b in self.bands:
            if b.upper is not None:
                out = F.when(price < b.upper, float(b.tick)) if out is None else out.when(price < b.upper, float(b.tick))
        return F.lit(float(self.bands[-1].tick)) if out is None else out.otherwise(float(self.bands[-1].tick))

    def on_grid(self, price: Column, way: str = "nearest") -> Column:
        ratio, tick = price / self.tick(price), self.tick(price)
        steps = {"up": F.ceil(ratio - SLACK), "down": F.floor(ratio + SLACK), "nearest": F.bround(ratio, 0)}[way]
        return F.round(steps * tick, 6)

    def buy_price(self, raw: Column) -> Column:
        up = self.on_grid(raw, "up")
        return self.on_grid(up + self.slippage_ticks * self.tick(up), "up") if self.slippage_ticks else up

    def sell_price(self, raw: Column) -> Column:
        down = self.on_grid(raw, "down")
        slipped = self.on_grid(down - self.slippage_ticks * self.tick(down), "down") if self.slippage_ticks else down
        return F.greatest(slipped, F.lit(0.0))

    def net_return_pct(self, entry: Column, exit_: Column) -> Column:
        """Entry is put on the grid here even if it was before, so slippage on an already slipped entry counts twice."""
        paid, got = self.buy_price(entry) * (1 + self.buy_fee), self.sell_price(exit_) * (1 - self.sell_fee)
        return (got / paid - 1) * 100


#: An example schedule of price bands and ticks, with retail fees.
EXAMPLE = Costs(0.0015, 0.0025, (Band(0, 200, 1), Band(200, 500, 2), Band(500, 2000, 5), Band(2000, 5000, 10), Band(5000, None, 25)))
