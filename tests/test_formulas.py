import math

import pytest
from pyspark.sql import functions as F

from zonelytics.functions import formulas as fm


def value(spark, column, **row):
    keys = list(row)
    df = spark.createDataFrame([tuple(row.values())], keys)
    return df.select(column.alias("v")).first()[0]


def test_vapour_pressure_deficit(spark):
    got = value(spark, fm.vpd_kpa("t", "h"), t=25.0, h=60.0)
    assert got == pytest.approx(0.6108 * math.exp(17.27 * 25 / 262.3) * 0.4)
    assert got == pytest.approx(1.267, abs=1e-3)


@pytest.mark.parametrize("t,h,expected", [(27.0, 50.0, 27.0), (30.0, 50.0, -8.785 + 1.611 * 30 + 2.339 * 50 - 0.146 * 30 * 50)])
def test_heat_index_starts_above_27(spark, t, h, expected):
    assert value(spark, fm.heat_index("t", "h"), t=t, h=h) == pytest.approx(expected)


@pytest.mark.parametrize("t,v,expected", [(10.0, 5.0, 10.0), (-5.0, 20.0, 13.12 + 0.6215 * -5 - 11.37 * 20**0.16 + 0.3965 * -5 * 20**0.16)])
def test_wind_chill_starts_below_10(spark, t, v, expected):
    assert value(spark, fm.wind_chill("t", "v"), t=t, v=v) == pytest.approx(expected)


def test_zero_guards(spark):
    assert value(spark, fm.recycling_pct("u", "r"), u=0.0, r=5.0) == 0.0
    assert value(spark, fm.cost_per_kg("c", "k"), c=5.0, k=0.0) == 0.0
    assert value(spark, fm.ratio(F.col("a"), F.col("b"), 100.0), a=1.0, b=0.0) is None


def test_hours_in_range_can_go_negative(spark):
    assert value(spark, F.lit(24.0) - fm.excursion_hours("a", "b"), a=40.0, b=20.0) == -16.0


@pytest.mark.parametrize("score,label", [(85.0, "Healthy"), (84.9, "Warning"), (60.0, "Warning"), (59.9, "Critical")])
def test_health_bands(spark, score, label):
    assert value(spark, fm.health_status("s"), s=score) == label


def test_unit_hash_is_uniform_and_stable(spark):
    df = spark.range(2000).select(fm.unit_hash("id", F.lit(1)).alias("u"))
    low, high, mean = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= low and high < 1 and abs(mean - 0.5) < 0.03
    assert df.repartition(7).agg(F.sum("u")).first()[0] == pytest.approx(df.agg(F.sum("u")).first()[0])


def test_strawberry_shelf_life(spark):
    short = fm.low_shelf_life("r", "s", "c")
    assert value(spark, short, r=2, s=3, c="Strawberry") is True
    assert value(spark, short, r=2, s=3, c="Basil") is False
    assert value(spark, short, r=2, s=10, c="Basil") is True


def test_template_fill(spark):
    df = spark.createDataFrame([("Z1", None)], "zone_id string, x double")
    assert df.select(fm.fill_template("[{{zone_id}}] {{x}}{{other}}!", df.columns)).first()[0] == "[Z1] {{other}}!"
