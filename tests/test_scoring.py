"""Golden cases of each branch of the scores; the values follow from the rules by hand."""

import pytest
from pyspark.sql import functions as F

from hearthgrid.operators import scoring


def points(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def number(x):
    return F.lit(x).cast("double")


@pytest.mark.parametrize(("age", "want"), [(None, None), (0, 24), (5, 22), (10, 20), (15, 18), (20, 16), (35, 6), (40, 5), (50, 2), (90, 2)])
def test_age(spark, age, want):
    """24 points: 1 - .15 * age / 10; .85 - .20 * (age - 10) / 10; .65 - .40 * (age - 20) / 15; .25 - .01 * (age - 35), .10 at least."""
    assert points(spark, scoring.age_score(number(age), 10, 20, 35)) == want


@pytest.mark.parametrize(("price", "pct", "want"), [(None, None, None), (500, None, 20), (550, 21, 16), (775, 20, 18), (1000, None, 15), (1000, 25, 12), (1060, None, 6), (1120, None, 2), (1150, None, 0), (5000, 30, 0)])
def test_price(spark, price, pct, want):
    assert points(spark, scoring.price_score(number(price), number(pct), 1000.0)) == want


@pytest.mark.parametrize(("area", "want"), [(None, None), (95, 5), (100, 9), (115, 11), (130, 14), (150, 15), (170, 16), (400, 16)])
def test_area(spark, area, want):
    assert points(spark, scoring.area_score(number(area), 100.0, 130.0)) == want


@pytest.mark.parametrize(("km", "weight", "want"), [(None, 1.0, 20), (0.5, 1.0, 26), (0.9, 0.5, 13), (1.05, 1.0, 21), (1.2, 1.0, 17), (2.2, 1.0, 23), (9.0, 1.0, 12)])
def test_location(spark, km, weight, want):
    assert points(spark, scoring.location_score(number(km), F.lit(weight), 0.9, 1.2)) == want


@pytest.mark.parametrize(("beds", "baths", "want"), [(None, None, None), (3, None, 6), (None, 2, 4), (None, 3, 6), (3, 3, 12), (4, 3, 13), (5, 3, 14), (9, 9, 14), (1, 3, 12), (1, 0, 6)])
def test_programme(spark, beds, baths, want):
    """8.4 points for bedrooms, three quarters of them at any number; 5.6 for baths."""
    assert points(spark, scoring.programme_score(number(beds), number(baths), 3, 3)) == want


@pytest.mark.parametrize(
    ("got", "prefs", "priced", "want"),
    [
        ((20, 24, 15, 16, 14), 6, True, (95, 100, 95)),
        ((26, 24, 20, 16, 14), 6, True, (100, 100, 100)),
        ((26, None, None, None, None), 0, True, (26, 26, 100)),
        ((20, None, 15, None, None), 0, True, (76, 46, 89)),
        ((20, None, 15, None, None), -12, True, (64, 46, 77)),
        ((26, 24, None, 16, 14), 6, False, (69, 80, 100)),
        ((20, 10, None, 10, 10), 0, False, (43, 80, 70)),
        ((None,) * 5, 0, True, (0, 0, 100)),
    ],
)
def test_composition(spark, got, prefs, priced, want):
    criteria = [(number(g), float(w)) for g, w in zip(got, (26, 24, 20, 16, 14), strict=True)]
    c = scoring.compose(criteria, number(prefs), F.lit(priced))
    assert tuple(spark.range(1).select(c["score"], c["confidence"], c["ceiling"]).first()) == want
