import math

import pytest
from pyspark.sql import functions as F

from boutframe.functions import scalars as sc
from boutframe.functions.odds import lower_tail, with_moneyline


def text(value):
    return F.lit(value).cast("string")


def number(value):
    return F.lit(value).cast("double")


@pytest.mark.parametrize(
    "raw, expected",
    [(" OAK ", "LV"), ("LA", "LAR"), ("GNB", "GB"), ("XXX", "XXX"), (None, None), ("WAS", "WSH")],
)
def test_any_standard_code(one, raw, expected):
    assert one(sc.any_standard_code(text(raw))) == expected


def test_miss_rules(one):
    assert one(sc.standard_code(text("crd"))) == "ARI"
    assert one(sc.standard_code(text("CRD"))) == "CRD"
    assert one(sc.standard_code(text(" crd"))) == " crd"
    assert one(sc.rating_code(text("OAK"))) == "LV"
    assert one(sc.rating_code(text("LV"))) is None
    assert one(sc.place_code(text("New England"))) == "NE"
    assert one(sc.modern_name(text("St. Louis Rams"))) == "Los Angeles Rams"
    assert one(sc.modern_name(text("Chicago Bears"))) == "Chicago Bears"


@pytest.mark.parametrize(
    "label, expected",
    [
        ("New England (10-3-1)", "New England"),
        ("New England (10-3)", "New England"),
        ("NY Giants", "NY Giants"),
        ("A (1-2) B", "A (1-2) B"),
        ("A (1-2-3-4)", "A"),
    ],
)
def test_strip_record(one, label, expected):
    assert one(sc.strip_record(text(label))) == expected


@pytest.mark.parametrize(
    "own, other, won", [(20.0, 17.0, 1.0), (17.0, 17.0, 0.5), (3.0, 17.0, 0.0), (20.0, None, None), (None, None, None)]
)
def test_outcome(one, own, other, won):
    assert one(sc.outcome(number(own), number(other))) == won


def test_clock(one):
    assert one(sc.clock_seconds(text("31:07"))) == 1867.0
    assert one(sc.clock_seconds(text(None))) is None
    assert one(sc.clock_seconds(text("half"))) is None


def test_guarded_rate(one):
    assert one(sc.guarded_rate(number(0.0), number(0.0), 0.4)) == 0.4
    assert one(sc.guarded_rate(number(3.0), number(4.0), 0.4)) == 0.75
    assert one(sc.guarded_rate(number(3.0), number(None), 0.5)) == 0.5


def test_number_or_zero(one):
    assert one(sc.number_or_zero(text("--"))) == 0.0
    assert one(sc.number_or_zero(text("-3.5"))) == -3.5
    assert one(sc.number_or_zero(text(None))) == 0.0
    for odd in ("NaN", "1.5d", "2f", "Infinity", "-inf", "1e999", "0x10", "1_0", ""):
        assert one(sc.number_or_zero(text(odd))) == 0.0
    assert one(sc.number_or_zero(text(" 1e3 "))) == 1000.0 and one(sc.number_or_zero(text(".5"))) == 0.5


def test_prediction_line(one):
    line = one(
        sc.prediction_line(F.lit(2024), F.lit(3), F.lit("Away"), F.lit("A home with a rather long name"), F.lit(0.625))
    )
    assert line == (
        f"Season: 2024 {'Week 3':<7}: {'Away':<21} ({'62.5%)':<8} at "
        f"{'A home with a rather long name':<21} ({'37.5%)':<8}"
    )


def tail_by_erfc(distance):
    return 0.5 * math.erfc(distance / math.sqrt(2))


def test_lower_tail_has_full_relative_precision(spark):
    points = [i / 20 for i in range(0, 300)]
    rows = (
        spark.createDataFrame([(p,) for p in points], "d double")
        .select("d", lower_tail(F.col("d")).alias("p"))
        .collect()
    )
    for r in rows:
        assert r["p"] == pytest.approx(tail_by_erfc(r["d"]), rel=2e-13)


def moneyline_by_rule(spread):
    sigma = 14.21377923
    q = 0.5 * math.erfc(spread / sigma / math.sqrt(2)) * 1.05
    return round(-100 * q / (1 - q) if spread < 0 else 100 * (1 - q) / q)


def test_moneylines(spark):
    spreads = [i / 2 for i in range(-60, 61)]
    rows = with_moneyline(
        spark.createDataFrame([(s,) for s in spreads], "spread double"), {"line": "spread"}
    ).collect()
    lines = {r["spread"]: r["line"] for r in rows}
    known = {-7: -261, -3: -158, 0: 90, 3: 129, 7: 206, 14: 487, -24: 48650, -23.5: -62834}
    for spread, expected in known.items():
        assert lines[spread] == expected
    assert lines == {s: float(moneyline_by_rule(s)) for s in spreads}
