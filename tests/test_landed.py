"""Landed files, dimensions as of a day, drawn samples."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from candlewick.operators import history, verification
from candlewick.sources import landed


def test_wide_batches_become_rows(spark):
    wide = spark.createDataFrame([(date(2024, 1, 2), 1.0, 2.0, None, 7, "x"), (date(2024, 1, 3), None, None, 3.5, None, "y")], "date date, `A.JK|Open` double, `A.JK|Close` double, `B|C|close` double, `B|C|volume` int, note string")
    got = sorted(tuple(r) for r in landed.depivoted(wide).collect())
    assert got == [("A.JK", date(2024, 1, 2), 1.0, None, None, 2.0, None), ("B|C", date(2024, 1, 2), None, None, None, None, 7.0), ("B|C", date(2024, 1, 3), None, None, None, 3.5, None)]
    assert "Exchange" not in landed.depivoted(wide)._jdf.queryExecution().executedPlan().toString()
    assert landed.depivoted(wide.limit(0)).count() == 0
    with pytest.raises(ValueError):
        landed.depivoted(wide.select("date", "note"))


LINES = {
    '{"code": "A", "n": 1}': None, ' {"code": "B", "n": null, "more": [1, {"x": 2}]} ': None, '{"code": "C"}': None, None: "empty", "  ": "empty", "<!DOCTYPE html>": "page", '{"code": "D", "n": 1': "not_json", "plain": "not_json",
    "[]": "not_an_object", "3": "not_an_object", '"x"': "not_an_object", "null": "not_an_object", '{"code": "E", "n": "many"}': "wrong_type", '{"n": 4}': "missing", '{"code": null, "n": 4}': "missing", "{}": "missing",
}


def test_lines_are_parsed_or_kept_with_a_reason(spark):
    lines = spark.createDataFrame([(k, line) for k, line in enumerate(LINES)], "at int, line string").repartition(3)
    good, bad = landed.json_lines(lines, "code string, n bigint", ["code"])
    assert sorted(tuple(r) for r in good.collect()) == [(0, "A", 1), (1, "B", None), (2, "C", None)]
    assert {r.line: r.reason for r in bad.collect()} == {line: why for line, why in LINES.items() if why}
    assert all(x.count() == 0 for x in landed.json_lines(lines.limit(0), "code string, n bigint", ["code"]))


def test_values_as_of_a_day(spark):
    day = lambda k: date(2024, 1, k)
    old = spark.createDataFrame([("A", day(5), 10), ("A", day(9), 20), ("A", day(9), 15), ("B", day(1), 1), (None, day(2), 3)], "ticker string, as_of date, shares bigint")
    facts = [("A", day(4), "x"), ("A", day(5), "y"), ("A", day(8), "z"), ("A", day(9), "z"), ("A", day(9), "z"), ("B", day(20), None), ("C", day(9), "w"), (None, day(9), "v")]
    got = history.as_of(spark.createDataFrame(facts, "ticker string, on date, note string"), old, ["ticker"], "shares", "on").collect()
    want = [(*f, {"A": {4: None, 5: 10, 8: 10, 9: 20}, "B": {20: 1}, None: {9: 3}}.get(f[0], {}).get(f[1].day)) for f in facts]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    spans = history.intervals(old.where("shares <> 15"), ["ticker"]).where("ticker = 'A'").orderBy("as_of").collect()
    assert [(r.valid_from, r.valid_to) for r in spans] == [(day(5), day(8)), (day(9), None)]
    assert {r.ticker: r.shares for r in history.newest(old, ["ticker"], "shares").collect()} == {"A": 20, "B": 1, None: 3}


def test_draws_do_not_depend_on_partitions(spark):
    names = spark.createDataFrame([(f"T{k:03}", "xyz"[k % 3]) for k in range(200)] + [("T001", "x"), (None, "x")], "ticker string, sector string")
    draw = lambda frame, *a: sorted(r.ticker for r in verification.sampled(frame, "ticker", *a).collect())
    first = draw(names.repartition(7), 20, 5)
    assert first == draw(names.orderBy(F.desc("ticker")).coalesce(1), 20, 5) != draw(names, 20, 6)
    assert set(draw(names, 10, 5)) < set(first)  # a smaller draw is part of a larger one
    by = verification.sampled(names, "ticker", 4, 1, "sector").groupBy("sector").agg(F.countDistinct("ticker").alias("n")).collect()
    assert {r.sector: r.n for r in by} == {"x": 4, "y": 4, "z": 4}


def test_sampled_names_are_held_against_a_second_source(spark):
    bars = spark.createDataFrame([(t, date(2024, 1, d), 100.0) for t in "ABC" for d in (1, 2, 3)], "ticker string, date date, close double")
    other = spark.createDataFrame([("A", date(2024, 1, 1), 100.2), ("A", date(2024, 1, 2), 103.0), ("B", date(2024, 1, 9), 1.0)], "ticker string, date date, close double")
    names = spark.createDataFrame([("A",), ("B",), ("C",), ("A",)], "ticker string")
    assert sorted(tuple(r) for r in verification.verified(bars, other, names).collect()) == [("A", True, 2, 1), ("B", True, 0, 0), ("C", False, 0, 0)]
