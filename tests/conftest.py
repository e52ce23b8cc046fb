import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tideline import fixed_values as X  # noqa: E402
from tideline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions=4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def site_panel(spark):
    """Three sites, four years of days, seasonal and deterministic."""
    day = F.col("i") % 1461
    d = spark.range(3 * 1461).select(F.col("id").alias("i"))
    season = F.sin((day - 100) * (2 * 3.141592653589793 / 365.25))
    wave = F.sin(day * 0.7) + F.cos(day * 0.13)
    site = F.floor(F.col("i") / 1461)
    total = F.exp(6.5 + 3.5 * season + 0.6 * wave + 0.3 * site)
    names = F.element_at(F.array(*[F.lit(x) for x in ("문의", "추동", "회남")]), (site + 1).cast("int"))
    label = (
        F.when(total >= 10_000, "경계").when(total >= 1_000, "관심").otherwise("미발령")
    )
    cols = {
        X.DATE: F.date_add(F.to_date(F.lit("2019-01-01")), day.cast("int")),
        X.SITE: names,
        X.STAGE_LABEL: label,
        X.STAGE_CODE: F.when(total >= 10_000, 2.0).when(total >= 1_000, 1.0).otherwise(0.0),
        X.TOTAL: total,
        X.SPECIES[0]: F.when(F.col("i") % 17 != 0, total * 0.6),
        X.SPECIES[1]: total * 0.2,
        X.SPECIES[2]: total * 0.15,
        X.SPECIES[3]: total * 0.05,
        X.WATER_TEMP: 15 + 12 * season + 0.5 * wave,
        X.PH: 7.5 + 0.5 * season,
        X.DO: 10 - 3 * season,
        X.TURBIDITY: 5 + wave,
        X.CHL_A: 10 + 8 * season + wave,
        X.AIR_TEMP: 14 + 16 * season + 2 * wave,
        X.MAX_TEMP: 19 + 16 * season + 2 * wave,
        X.RAIN: F.when(F.col("i") % 9 == 0, 20.0 + 15 * season),
        X.RAIN_DAM: F.when(F.col("i") % 9 == 0, 18.0 + 15 * season),
        X.WIND: 1.5 + 0.8 * wave,
        X.HUMIDITY: 65 + 10 * season,
        X.SUNSHINE: 6 + 3 * season + wave,
        X.RADIATION: 14 + 6 * season + wave,
        "수위(EL.m)": 72 + 3 * season,
        X.STORAGE: 62 + 12 * season + wave,
        X.INFLOW: F.greatest(80 + 70 * season + 30 * wave, F.lit(0.0)),
        X.OUTFLOW: F.greatest(75 + 60 * season + 40 * wave, F.lit(0.0)),
    }
    return d.select(*[c.alias(n) for n, c in cols.items()]).cache()
