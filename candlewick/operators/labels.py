"""Outcome labels: what became of a signal bought at the next open."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions.series import position, yes
from candlewick.operators.costs import Costs


@dataclass(frozen=True)
class Rule:
    """Hold for ``horizon_bars``, or leave earlier at a target or a stop (percent); ``tie_break`` settles a bar that touches both."""

    horizon_bars: int
    target_pct: float | None = None
    stop_pct: float | None = None
    tie_break: str = "unfavourable"
    label: str = ""

    def __post_init__(self) -> None:
        if self.horizon_bars < 1:
            raise ValueError("a rule holds for one bar at least")
        if any(x is not None and x <= 0 for x in (self.target_pct, self.stop_pct)):
            raise ValueError("targets and stops are positive distances from the fill, or None")
        if self.tie_break not in ("unfavourable", "favourable"):
            raise ValueError(f"no such tie break: {self.tie_break}")

    @property
    def version(self) -> str:
        """A name that changes with any field but the label, which only replaces its readable part."""
        fields = asdict(self)
        readable = fields.pop("label")
        if not readable and self.target_pct is self.stop_pct is None:
            readable = f"hold-h{self.horizon_bars}"
        elif not readable:
            legs = [f"{k}{'x' if x is None else x}" for k, x in (("t", self.target_pct), ("s", self.stop_pct), ("h", self.horizon_bars))]
            readable = "-".join([*legs, self.tie_break[:5]])
        return f"{readable}-{hashlib.sha256(json.dumps(fields, sort_keys=True).encode()).hexdigest()[:8]}"


HOLD_20 = Rule(20)
TARGET_8_4 = Rule(20, 8.0, 4.0)
COLUMNS = ["ticker", "entry_date", "rule_version", "fill_date", "fill_price", "exit_date", "exit_price", "outcome", "bars_held", "return_pct", "gross_return_pct", "mae", "mfe"]


def eligible(signals: DataFrame, min_depth: int = 3, require_gate: bool = True, require_above_ma5: bool = True, exclude_unclean: bool = True) -> DataFrame:
    keep = F.col("alignment_depth") >= min_depth
    if require_gate:
        keep &= yes(F.col("rsi_gate"))
    if require_above_ma5:
        keep &= yes(F.col("above_ma5"))
    if exclude_unclean:
        keep &= ~F.col("data_quality").isin("stale", "suspect")
    return signals.where(keep)


def labelled(bars: DataFrame, entries: DataFrame, rules: list[Rule], costs: Costs | None = None, cutoff: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each entry (ticker, date) and rule.

    Bars are numbered, and an entry meets the bars of the longest horizon by number, so only
    they move.  Entries may bring their number as bars_available; columns of theirs to
    ``carry`` come out with the labels.
    """
    if cutoff:
        bars = bars.where(F.col("date") <= F.lit(cutoff).cast("date"))
    longest = max(r.horizon_bars for r in rules)
    numbered = bars.select("ticker", "date", "open", "high", "low", "close", position().alias("k"))
    if "bars_available" in entries.columns:
        wanted = entries.select("ticker", "date", F.col("bars_available").alias("k"), *carry).dropDuplicates(["ticker", "date"])
    else:
        wanted = numbered.select("ticker", "date", "k").join(entries.select("ticker", "date", *carry).dropDuplicates(["ticker", "date"]), ["ticker", "date"])
    steps = wanted.select("ticker", F.col("date").alias("_entry"), F.explode(F.sequence(F.col("k") + 1, F.col("k") + longest)).alias("k"), *carry)
    # both are many rows by nature, whatever the files that they come from weigh
    met = steps.hint("merge").join(numbered, ["ticker", "k"]).groupBy("ticker", F.col("_entry").alias("date"), *carry)
    own = met.agg(F.sort_array(F.collect_list(F.struct("k", "date", "open", "high", "low", "close"))).alias("ahead")).where("ahead[0].open > 0")
    fill = F.col("ahead")[0]["open"]
    paid = costs.buy_price(fill) if costs else fill
    own = own.withColumns({"fill_price": paid, "fill_date": F.col("ahead")[0]["date"]})
    spec = F.array(*[F.struct(F.lit(r.version).alias("version"), F.lit(r.horizon_bars).alias("h"), F.lit(r.target_pct).cast("double").alias("target"), F.lit(r.stop_pct).cast("double").alias("stop"), F.lit(r.tie_break).alias("tie")) for r in rules])
    own = own.withColumn("rule", F.explode(spec)).withColumn("win", F.slice("ahead", 1, F.col("rule.h")))
    up = F.expr("fill_price * (1 + rule.target / 100)")
    down = F.expr("fill_price * (1 - rule.stop / 100)")
    own = own.withColumns({"up": up, "down": down})
    own = own.withColumn("hits", F.expr("transform(win, b -> coalesce(b.high >= up, false) or coalesce(b.low <= down, false))"))
    own = own.withColumn("at", F.expr("array_position(hits, true)"))
    own = own.withColumn("seen", F.expr("if(at > 0, slice(win, 1, int(at)), win)")).withColumn("bar", F.expr("element_at(seen, -1)"))
    touched_up, touched_down = yes(F.col("bar.high") >= F.col("up")), yes(F.col("bar.low") <= F.col("down"))
    favours = F.when(F.col("rule.tie") == "favourable", touched_up).otherwise(~touched_down)
    outcome = F.when(F.col("at") > 0, F.when(favours, "target").otherwise("stop")).when(F.size("win") < F.col("rule.h"), "open").otherwise("timeout")
    own = own.withColumn("outcome", outcome)
    price = F.when(F.col("outcome") == "target", F.col("up")).when(F.col("outcome") == "stop", F.col("down")).otherwise(F.col("bar.close"))
    done = F.col("outcome") != "open"
    own = own.withColumn("exit_price", price)
    net = costs.net_return_pct(F.col("fill_price"), F.col("exit_price")) if costs else F.lit(None).cast("double")
    return own.select(
        "ticker",
        F.col("date").alias("entry_date"),
        F.col("rule.version").alias("rule_version"),
        "fill_date",
        "fill_price",
        F.col("bar.date").alias("exit_date"),
        "exit_price",
        "outcome",
        (F.size("seen") - 1).alias("bars_held"),
        F.when(done, net).alias("return_pct"),
        F.when(done, (F.col("exit_price") / F.col("fill_price") - 1) * 100).alias("gross_return_pct"),
        F.expr("least(0D, (array_min(transform(seen, b -> b.low)) / fill_price - 1) * 100)").alias("mae"),
        F.expr("greatest(0D, (array_max(transform(seen, b -> b.high)) / fill_price - 1) * 100)").alias("mfe"),
        *carry,
    )
