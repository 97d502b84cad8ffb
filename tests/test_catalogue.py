from datetime import datetime, timedelta

import duckdb
import pytest
from oracle import agree, connect

from lodeframe.plans import catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf_dir, con, name):
    df = catalogue.queries()[name](spark, sf_dir)
    if name in catalogue.oracle_sql():
        agree(df, con, catalogue.oracle_sql()[name])
    else:
        assert df.count() > 0


@pytest.mark.parametrize("micros", [250_000, 500_000, 748_247, 1_500_000])
@pytest.mark.parametrize("name", ["q14_cache_lookup", "q42_cache_upkeep", "q52_cleanup_counts"])
def test_ages_near_the_limit(spark, tmp_path, name, micros):
    """Users whose only event lies within some seconds of an age limit, on every quarter of a second and beside it."""
    day, now = datetime(2024, 1, 31), datetime(2024, 1, 31) + timedelta(microseconds=micros)
    times = [day - timedelta(days=days, microseconds=250_000 * k + beside) for days in (3, 29) for k in range(-12, 7) for beside in (-1, 0, 1)]
    rows = [(k, at, k, "purchase", 1.25) for k, at in enumerate(times)] + [(len(times), now, len(times), "view", 1.25)]
    made = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    made.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    agree(catalogue.queries()[name](spark, str(tmp_path)), con, catalogue.oracle_sql()[name])
