"""Shares of a maximum where the maximum is zero: as the SQL twin has them, not an error."""

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from gridlake.operators import join
from gridlake.plans import catalogue


def test_broadcast_dims_over_zero(spark, tmp_path):
    # By user: the values of one hour on the first days.
    days = {0: [0.0], 1: [0.0, 0.0], 2: [0.0, -5.0], 3: [-2.0, -4.0], 4: [5.0, 10.0, 0.0], 5: [None], 6: [None, 0.0], 7: [0.004, -0.004]}
    rows = [(u * 10 + k, dt.datetime(2024, 1, k, 9, 30), u, v) for u, vs in days.items() for k, v in enumerate(vs, 1)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double")
    events.write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    df = catalogue.queries()["broadcast_dims"](spark, str(tmp_path))
    assert dict(df.dtypes) == {"xi": "int", "yi": "int", "ti": "int", "share": "double"}
    got = sorted((r.xi, r.yi, r.ti, repr(r.share)) for r in df.collect())
    want = duck.sql(catalogue.oracle_sql()["broadcast_dims"]).select("xi, yi, ti, share").fetchall()
    assert got == sorted((*at, repr(share)) for *at, share in want)
    shares = {(x - 1, t): share for x, _, t, share in got}
    assert shares[0, 1] == shares[1, 2] == shares[7, 1] == shares[7, 2] == "nan"
    assert (shares[2, 1], shares[2, 2], shares[3, 2], shares[4, 1], shares[5, 1]) == ("nan", "-inf", "2.0", "0.5", "None")


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_quotient(spark, ansi):
    inf, nan = math.inf, math.nan
    cases = [
        (1.0, 0.0, inf), (-1.0, 0.0, -inf), (0.0, 0.0, nan), (1.0, -0.0, -inf), (-1.0, -0.0, inf), (inf, 0.0, inf), (nan, 0.0, nan), (None, 0.0, None),
        (1.0, None, None), (0.0, 5.0, 0.0), (7.0, 2.0, 3.5), (1.0, nan, nan), (1.0, inf, 0.0), (inf, inf, nan), (1e308, 1e-10, inf), (1.0, 3.0, 1.0 / 3.0),
    ]
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a double, b double")
        got = dict(df.select("i", join.quotient(F.col("a"), F.col("b"))).collect())
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert [repr(got[i]) for i in range(len(cases))] == [repr(c[2]) for c in cases]
