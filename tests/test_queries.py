"""Every registered query of the engine against its SQL at the smallest scale."""

import pytest

from sparkloom.plans import function_queries, library_queries, registry, relational, tpch  # noqa: F401
from tests.oracle import connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    from tests.oracle import same

    out = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE_SQL:
        same(out, con, registry.ORACLE_SQL[name])
    else:
        assert out.count() >= 0


def test_epochs_to_the_digit(spark, tmp_path):
    """All digits, which ``same`` rounds: halves of a millisecond, times before 1970, beyond a double's digits, null."""
    import duckdb

    times = "2024-01-01 00:00:07.179575|2024-01-01 00:00:00.0005|2024-02-29 23:59:59.999999|1970-01-01 00:00:00|1969-12-31 23:59:59.9985|1969-12-31 23:59:59.999501|1969-12-31 23:59:59|1900-03-01 05:06:07.000001|0001-01-01 00:00:00.0005|3000-07-07 07:59:59.999999|9999-12-31 23:59:59.9994"
    rows = ", ".join(f"({i}, TIMESTAMP '{x}')" for i, x in enumerate(times.split("|")))
    duckdb.sql(f"COPY (SELECT i::bigint AS event_id, ts FROM (VALUES {rows}, (99, NULL)) v(i, ts)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    for sf_dir in (str(tmp_path), SF):
        want = duckdb.connect()
        want.execute(f"SET TimeZone='UTC'; CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
        want = want.execute(registry.ORACLE_SQL["fn_temporal_epochs"])
        names = [d[0] for d in want.description]
        got = registry.QUERIES["fn_temporal_epochs"](spark, sf_dir).select(*names).orderBy("event_id").collect()
        assert list(map(tuple, got)) == sorted(want.fetchall())


def exact(spark, tmp_path, name, table, select):
    """Rows of a query over a made table, and of its SQL, with all digits and signs."""
    import duckdb

    duckdb.sql(f"COPY ({select}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"SET TimeZone='UTC'; CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    want = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    got = registry.QUERIES[name](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_lists_keep_the_sign_of_what_rounds_to_zero(spark, tmp_path):
    exact(spark, tmp_path, "fn_lists", "embeddings", "SELECT 1::bigint AS vec_id, [-0.000008, 0.25, -0.00000001, -0.5, -0.0, 0.0, 0.0000001, -0.00005]::float[] AS embedding UNION ALL SELECT 2, [-1e-9, 1e-9, -1e-10, -1e-8]::float[]")


def test_uuid7_times_of_the_nearest_millisecond(spark, tmp_path):
    times = "2024-01-01 00:00:59.9995|2024-01-01 00:00:59.999499|2024-01-31 23:59:59.999999|1970-01-01 00:00:00|1970-01-01 00:00:00.0005|3000-12-31 23:59:59.9999|9999-12-31 23:59:59"
    rows = ", ".join(f"({i}, TIMESTAMP '{x}')" for i, x in enumerate(times.split("|")))
    exact(spark, tmp_path, "fn_uuid7_times", "events", f"SELECT i::bigint AS event_id, ts FROM (VALUES {rows}, (99, NULL)) v(i, ts)")


def test_nan_inf_of_odd_numbers(spark, tmp_path):
    """Nulls in each column, negative keys, no number and infinite ones."""
    rows = "(1, 4, '2.5', '0.1'), (-5, 5, 'nan', '0.07'), (NULL, 6, 'inf', NULL), (9, NULL, '-inf', '0.0'), (9223372036854775807, 7, NULL, '0.05'), (0, 1, '3', '0.08'), (7, 2, NULL, '0.01'), (8, 3, '-0.0', 'nan')"
    exact(spark, tmp_path, "fn_numeric_nan_inf", "lineitem", f"SELECT k::bigint AS l_orderkey, n::int AS l_linenumber, q::double AS l_quantity, x::double AS l_tax FROM (VALUES {rows}) v(k, n, q, x)")


def test_ranks_as_exact_percentiles(spark):
    """A value's rank tells on which side of an exact percentile it lies, ties and single values included."""
    from pyspark.sql import functions as F

    for values in ([1.0], [1.0, 1.0, 2.0], [float(k * k % 17) for k in range(40)], [3.0] * 9 + [4.0], [float(k) for k in range(101)]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        picks = df.where("v IS NOT NULL").distinct().withColumnRenamed("v", "m")
        for low, high in ((0.095, 0.105), (0.46, 0.54), (0.0, 1.0), (0.3, 0.3)):
            want = df.agg(F.percentile("v", low).alias("a"), F.percentile("v", high).alias("b")).crossJoin(picks).select("m", F.col("m").between(F.col("a"), F.col("b")))
            got = df.crossJoin(picks).groupBy("m").agg(library_queries._within("v", F.col("m"), low, high))
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["agg_approximate_within_bounds", "agg_mergeable_sketches"])
def test_no_exact_percentiles_held(spark, name):
    """Exact percentiles keep a group's values in one task."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert " percentile(" not in plan and "(percentile(" not in plan


@pytest.mark.parametrize("name", ["fn_images", "fn_image_pixels", "fn_image_files", "fn_audio"])
def test_small_files_with_costly_rows_go_to_all_cores(spark, name):
    assert registry.QUERIES[name](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_to_unix_epoch_and_trunc_by_whole_numbers(spark):
    from sparkloom import functions as X

    df = spark.sql("SELECT timestamp_ntz'1969-12-31 23:59:58.9985' AS a, timestamp_ntz'3000-07-07 07:59:59.999999' AS b, CAST(NULL AS timestamp_ntz) AS c")
    r = df.select(*(X.to_unix_epoch(x, u) for x in "abc" for u in ("s", "ms", "us")), X.date_trunc("hour", "b").cast("string"), X.date_trunc("second", "a").cast("string")).first()
    assert list(r) == [-1, -1001, -1001500, 32519865599, 32519865599999, 32519865599999999, None, None, None, "3000-07-07 07:00:00", "1969-12-31 23:59:58"]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
