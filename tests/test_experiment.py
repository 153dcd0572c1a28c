"""Counts larger than the small tables have, and none."""

from pyspark.sql import functions as F

from tessaline.functions import stats
from tessaline.plans import catalog


def test_chi_squared_of_millions(spark):
    """Sixty times the events of scale 0.1, and counts whose products leave 64 bits."""
    rows = [(602_436, 2_395_920, 602_604, 2_399_040), (3_000_000_000, 5_000_000_000, 2_999_000_000, 5_001_000_000), (0, 0, 0, 0)]
    got = [x.x for x in spark.createDataFrame(rows, "i long, j long, k long, l long").select(F.round(stats.chi_squared(*map(F.col, "ijkl")), 6).alias("x")).collect()]
    exact = lambda a, b, c, d: (a + b + c + d) * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    assert got == [round(exact(*rows[0]), 6), round(exact(*rows[1]), 6), 0.0]


def test_an_experiment_without_rows(spark, tmp_path):
    spark.createDataFrame([], "event_type string, user_id bigint").write.parquet(str(tmp_path / "events.parquet"))
    row = catalog.registry().queries["b02_experiment"](spark, str(tmp_path)).first()
    assert tuple(row[c] for c in ("n1", "h1", "n2", "h2", "chi_squared", "cohens_h")) == (None, None, None, None, 0.0, None)
