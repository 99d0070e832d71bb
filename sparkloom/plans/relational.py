"""One query for each relational operator: joins, as-of joins, aggregates, windows, set operations, reshaping, sorting, SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom import functions as X
from sparkloom.frame import Frame
from sparkloom.functions.windows import Window, over, ranked
from sparkloom.plans.registry import query
from sparkloom.session import Session

_L = "SELECT c_custkey AS k, c_nationkey::double AS n, c_mktsegment AS name FROM customer"
_R = "SELECT CASE WHEN o_orderstatus = 'P' THEN -o_custkey ELSE o_custkey END AS k, o_orderkey::double AS n, o_totalprice AS price FROM orders"


def _sides(t):
    left = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("double").alias("n"), F.col("c_mktsegment").alias("name"))
    right = t("orders").select(F.when(F.col("o_orderstatus") == "P", -F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("k"), F.col("o_orderkey").cast("double").alias("n"), F.col("o_totalprice").alias("price"))
    return Frame(left), Frame(right)


for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):

    @query(f"join_{_how}", f'SELECT coalesce(l.k, r.k) AS k, l.n AS n, l.name AS name, r.n AS "right.n", r.price AS price FROM ({_L}) l {_sql} ({_R}) r ON l.k = r.k')
    def _join(t, how=_how):
        left, right = _sides(t)
        return left.join(right, on="k", how=how).df


for _how, _sql in (("semi", "SEMI JOIN"), ("anti", "ANTI JOIN")):

    @query(f"join_{_how}", f"SELECT l.* FROM ({_L}) l {_sql} ({_R}) r ON l.k = r.k")
    def _half(t, how=_how):
        left, right = _sides(t)
        return left.join(right, on="k", how=how).df


for _strategy in ("broadcast", "sort_merge", "hash"):

    @query(f"join_strategy_{_strategy}", "SELECT n_nationkey AS n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
    def _hinted(t, strategy=_strategy):
        return Frame(t("nation")).join(Frame(t("region")), left_on="n_regionkey", right_on="r_regionkey", strategy=strategy).df


@query("join_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(t):
    return Frame(t("nation").select("n_name")).join(Frame(t("region").select("r_name")), how="cross").df


@query("join_suffix", "SELECT l.k, l.n, l.name, r.n AS n_right, r.price FROM (" + _L + ") l JOIN (" + _R + ") r ON l.k = r.k")
def join_suffix(t):
    left, right = _sides(t)
    return left.join(right, on="k", suffix="_right").df


@query("join_null_safe", "SELECT a.s, count(*) AS n FROM (SELECT nullif(event_type, 'click') AS s FROM events) a JOIN (SELECT DISTINCT nullif(event_type, 'click') AS s FROM events) b ON a.s IS NOT DISTINCT FROM b.s GROUP BY 1")
def join_null_safe(t):
    s = F.nullif(F.col("event_type"), F.lit("click")).alias("s")
    a, b = Frame(t("events").select(s)), Frame(t("events").select(s).distinct())
    return a.join(b, on="s", null_equals_null=True).df.groupBy("s").agg(F.count("*").alias("n"))


@query("join_theta", "SELECT count(*) AS n FROM part p JOIN nation ON p_size < n_nationkey AND p_size % 5 = n_nationkey % 5")
def join_theta(t):
    return t("part").join(t("nation"), (F.col("p_size") < F.col("n_nationkey")) & (F.col("p_size") % 5 == F.col("n_nationkey") % 5)).agg(F.count("*").alias("n"))


_EV = "SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'click'"
_BY = "(SELECT user_id, ts, min(value) AS price FROM events WHERE event_type <> 'click' GROUP BY user_id, ts)"


def _asof(t, strategy):
    left = t("events").where("event_type = 'click'").select("event_id", "user_id", "ts", "value")
    right = t("events").where("event_type <> 'click'").groupBy("user_id", "ts").agg(F.min("value").alias("price"))
    return Frame(left).join_asof(Frame(right), on="ts", by="user_id", strategy=strategy).df


@query("join_asof_backward", f"SELECT e.event_id, e.user_id, e.ts, e.value, r.price FROM ({_EV}) e ASOF LEFT JOIN {_BY} r ON e.user_id = r.user_id AND e.ts >= r.ts")
def asof_backward(t):
    return _asof(t, "backward")


@query("join_asof_forward", f"SELECT e.event_id, e.user_id, e.ts, e.value, r.price FROM ({_EV}) e ASOF LEFT JOIN {_BY} r ON e.user_id = r.user_id AND e.ts <= r.ts")
def asof_forward(t):
    return _asof(t, "forward")


@query(
    "join_asof_nearest",
    f"""WITH b AS (SELECT e.*, r.ts AS t0, r.price AS p0 FROM ({_EV}) e ASOF LEFT JOIN {_BY} r ON e.user_id = r.user_id AND e.ts >= r.ts),
    f AS (SELECT e.event_id, r.ts AS t1, r.price AS p1 FROM ({_EV}) e ASOF LEFT JOIN {_BY} r ON e.user_id = r.user_id AND e.ts <= r.ts)
    SELECT event_id, user_id, ts, value, CASE WHEN t0 IS NULL OR (t1 IS NOT NULL AND epoch_us(t1) - epoch_us(ts) <= epoch_us(ts) - epoch_us(t0)) THEN p1 ELSE p0 END AS price FROM b JOIN f USING (event_id)""",
)
def asof_nearest(t):
    return _asof(t, "nearest")


# Aggregates.


@query(
    "agg_all_kinds",
    """SELECT l_returnflag, count(l_tax) AS n, count(*) AS n_all, count(DISTINCT l_suppkey) AS suppliers, sum(l_linenumber) AS lines, round(avg(l_tax), 6) AS mean_tax,
       min(l_quantity) AS lo, max(l_quantity) AS hi, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(median(l_quantity), 6) AS med,
       round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, bool_and(l_quantity > 0) AS all_pos, bool_or(l_discount > 0.09) AS some_big
       FROM lineitem GROUP BY l_returnflag""",
)
def agg_all_kinds(t):
    return t("lineitem").groupBy("l_returnflag").agg(
        X.count("l_tax").alias("n"), X.count(mode="all").alias("n_all"), X.count_distinct("l_suppkey").alias("suppliers"), X.sum("l_linenumber").alias("lines"), F.round(X.mean("l_tax"), 6).alias("mean_tax"),
        X.min("l_quantity").alias("lo"), X.max("l_quantity").alias("hi"), F.round(X.stddev("l_quantity"), 6).alias("sd"), F.round(X.var("l_quantity", ddof=0), 6).alias("vp"), F.round(X.median("l_quantity"), 6).alias("med"),
        F.round(X.percentile("l_extendedprice", 0.9), 4).alias("p90"), X.bool_and(F.col("l_quantity") > 0).alias("all_pos"), X.bool_or(F.col("l_discount") > 0.09).alias("some_big"),
    )


@query("agg_global", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders")
def agg_global(t):
    return Frame(t("orders")).agg(X.count().alias("n"), F.round(X.sum("o_totalprice"), 2).alias("total"), F.round(X.mean("o_totalprice"), 4).alias("mean"), X.min("o_orderdate").alias("first"), X.max("o_orderdate").alias("last")).df


@query("agg_lists", "SELECT n_regionkey, list(n_name ORDER BY n_name) AS names, list(DISTINCT length(n_name) ORDER BY length(n_name)) AS sizes, string_agg(n_name, ';' ORDER BY n_name) AS text FROM nation GROUP BY 1")
def agg_lists(t):
    rows = Frame(t("nation").withColumn("size", F.length("n_name").cast("long")))
    out = rows.groupby("n_regionkey").agg(X.list_agg("n_name").alias("names"), X.list_agg_distinct("size").alias("sizes")).df
    return out.select("n_regionkey", F.array_sort("names").alias("names"), F.array_sort("sizes").alias("sizes"), F.array_join(F.array_sort("names"), ";").alias("text"))


@query("agg_ddof_product_skew", "SELECT p_brand, round(sqrt(var_pop(p_size) * count(*) / (count(*) - 2)), 6) AS sd2, round(exp(sum(ln(1 + p_size / 1000.0))), 6) AS prod, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 2")
def agg_ddof(t):
    return t("part").groupBy("p_brand").agg(F.round(X.stddev("p_size", ddof=2), 6).alias("sd2"), F.round(X.product(1 + F.col("p_size") / 1000.0), 6).alias("prod"), F.count("*").alias("n")).where("n > 2")


@query("agg_rollup", "SELECT c_mktsegment, n_name, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY ROLLUP (c_mktsegment, n_name)")
def agg_rollup(t):
    return Frame(t("nation").join(t("customer"), F.col("n_nationkey") == F.col("c_nationkey"))).rollup("c_mktsegment", "n_name").agg(X.count().alias("n")).df


@query("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(t):
    return Frame(t("lineitem")).cube("l_returnflag", "l_linestatus").agg(X.count().alias("n")).df


@query("agg_map_groups", "SELECT c_nationkey, max(c_acctbal) - min(c_acctbal) AS spread FROM customer GROUP BY 1")
def agg_map_groups(t):
    import pandas as pd

    def spread(g):
        return pd.DataFrame({"c_nationkey": [g["c_nationkey"].iloc[0]], "spread": [g["c_acctbal"].max() - g["c_acctbal"].min()]})

    return Frame(t("customer").select("c_nationkey", "c_acctbal")).groupby("c_nationkey").map_groups(spread, "c_nationkey int, spread double").df


@query("agg_user_aggregate", "SELECT l_returnflag, round(sum(l_quantity * l_quantity), 2) AS result FROM lineitem GROUP BY 1")
def agg_user(t):
    from sparkloom.functions import udf

    class Squares(udf.Aggregate):
        state, result = "s double", "double"

        def aggregate(self, rows):
            return {"s": float((rows["l_quantity"] ** 2).sum())}

        def combine(self, states):
            return {"s": float(states["s"].sum())}

        def finalize(self, state):
            return round(state["s"], 2)

    return udf.aggregate(t("lineitem").select("l_returnflag", "l_quantity"), Squares(), ["l_returnflag"])


@query("describe_schema", "SELECT * FROM (VALUES ('r_regionkey', 'int'), ('r_name', 'string')) v(column_name, type)")
def describe_schema(t):
    return Frame(t("region")).describe().df


@query("summarize", "SELECT 'n_nationkey' AS \"column\", 'int' AS type, cast(min(n_nationkey) AS varchar) AS min, cast(max(n_nationkey) AS varchar) AS max, count(n_nationkey) AS count, 0::bigint AS count_nulls FROM nation UNION ALL SELECT 'n_name', 'string', min(n_name), max(n_name), count(n_name), 0 FROM nation")
def summarize(t):
    return Frame(t("nation").select("n_nationkey", "n_name")).summarize().df.drop("approx_count_distinct")


# Windows.

_O = "o_orderkey, o_custkey, o_totalprice"


@query("window_partition", f"SELECT {_O}, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM orders")
def window_partition(t):
    w = Window().partition_by("o_custkey")
    return t("orders").select("o_orderkey", "o_custkey", "o_totalprice", over(F.count("*"), w).alias("n"), over(F.max("o_totalprice"), w).alias("top"))


@query("window_ordered_whole_partition", f"SELECT {_O}, sum(o_orderkey) OVER (PARTITION BY o_custkey) AS total FROM orders")
def window_ordered(t):
    return t("orders").select("o_orderkey", "o_custkey", "o_totalprice", over(F.sum("o_orderkey"), Window().partition_by("o_custkey").order_by("o_orderkey")).alias("total"))


@query(
    "window_ranks",
    f"""SELECT {_O}, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, lag(o_orderkey, 1, -1) OVER w AS before, lead(o_orderkey, 2, -1) OVER w AS after2
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""",
)
def window_ranks(t):
    w, v = Window().partition_by("o_custkey").order_by("o_orderkey"), Window().partition_by("o_custkey").order_by("o_orderpriority")
    return t("orders").select("o_orderkey", "o_custkey", "o_totalprice", ranked(X.row_number(), w).alias("rn"), ranked(X.rank(), v).alias("rk"), ranked(X.dense_rank(), v).alias("dr"), ranked(X.lag("o_orderkey", 1, -1), w).alias("before"), ranked(X.lead("o_orderkey", 2, -1), w).alias("after2"))


@query(
    "window_frames",
    f"""SELECT {_O}, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s3,
        count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 5000 PRECEDING AND 5000 FOLLOWING) AS near,
        CASE WHEN count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3 THEN
        min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS low,
        first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS f,
        last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS l FROM orders""",
)
def window_frames(t):
    w = Window().partition_by("o_custkey").order_by("o_orderkey")
    near = w.rows_between(-1, 1)
    return t("orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", over(F.sum("o_orderkey"), w.rows_between(-2, 0)).alias("s3"), over(F.count("*"), w.range_between(-5000, 5000)).alias("near"),
        over(F.min("o_totalprice"), w.rows_between(-2, 0, min_periods=3)).alias("low"), over(X.first_value("o_orderkey"), near).alias("f"), over(X.last_value("o_orderkey"), near).alias("l"),
    )


@query("window_top_per_group", "SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def window_top(t):
    w = Window().partition_by("c_nationkey").order_by("c_acctbal", "c_custkey", desc=[True, False])
    return t("customer").withColumn("rn", ranked(X.row_number(), w)).where("rn <= 3").select("c_nationkey", "c_custkey", "c_acctbal")


# Sets, order, reshaping.

_A, _B = "SELECT c_nationkey AS v FROM customer", "SELECT s_nationkey + 5 AS v FROM supplier"


def _ab(t):
    return Frame(t("customer").select(F.col("c_nationkey").alias("v"))), Frame(t("supplier").select((F.col("s_nationkey") + 5).alias("v")))


for _name, _sql in (("union", "UNION"), ("union_all", "UNION ALL"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except_distinct", "EXCEPT"), ("except_all", "EXCEPT ALL"), ("concat", "UNION ALL")):

    @query(f"set_{_name}", f"{_A} {_sql} {_B}")
    def _set(t, name=_name):
        a, b = _ab(t)
        return getattr(a, name)(b).df


@query("set_union_by_name", "SELECT r_regionkey AS k, r_name AS name, NULL::varchar AS other FROM region UNION ALL BY NAME SELECT n_nationkey AS k, n_name AS other FROM nation")
def set_union_by_name(t):
    a = Frame(t("region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")))
    return a.union_all_by_name(Frame(t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("other")))).df


@query("distinct_on", "SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)")
def distinct_on(t):
    return Frame(t("orders")).distinct("o_custkey", "o_orderpriority").agg(X.count().alias("n")).df


@query("sort_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def sort_limit_offset(t):
    return Frame(t("orders").select("o_orderkey", "o_totalprice")).sort(["o_totalprice", "o_orderkey"], desc=[True, False]).offset(10).limit(25).df


@query("sort_nulls", "SELECT v, row_number() OVER (ORDER BY v DESC NULLS FIRST, k) AS at FROM (SELECT n_nationkey AS k, nullif(n_regionkey, 2)::double AS v FROM nation)")
def sort_nulls(t):
    from sparkloom.functions.windows import ordering

    rows = t("nation").select(F.col("n_nationkey").alias("k"), F.nullif("n_regionkey", F.lit(2)).cast("double").alias("v"))
    return rows.select("v", F.row_number().over(Window().order_by("v", "k", desc=[True, False]).spec(True)).alias("at")).orderBy(*ordering("v", True))


@query("explode_lists", "SELECT doc_id, place, w FROM (SELECT doc_id, unnest(range(0, greatest(len(ws), 1))) AS place, unnest(CASE WHEN len(ws) = 0 THEN [NULL] ELSE ws END) AS w FROM (SELECT doc_id, list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '') AS ws FROM documents))")
def explode_lists(t):
    rows = t("documents").select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != "").alias("w"))
    out = Frame(rows).explode("w", index_column="place").df
    return out.withColumn("place", F.coalesce("place", F.lit(0).cast("long")))


@query("unpivot", "SELECT n_nationkey, variable, value FROM (SELECT n_nationkey, n_regionkey::bigint AS n_regionkey, length(n_name)::bigint AS size FROM nation) UNPIVOT (value FOR variable IN (n_regionkey, size))")
def unpivot(t):
    return Frame(t("nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("n_regionkey"), F.length("n_name").cast("long").alias("size"))).unpivot("n_nationkey").df


@query("pivot", "SELECT l_returnflag, max(l_quantity) FILTER (l_linestatus = 'F') AS F, max(l_quantity) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY 1")
def pivot(t):
    return Frame(t("lineitem")).pivot("l_returnflag", "l_linestatus", "l_quantity", "max", ["F", "O"]).df


@query("drop_null_rows", "SELECT count(*) AS n FROM (SELECT nullif(event_type, 'click') AS e, value FROM events) WHERE e IS NOT NULL")
def drop_null_rows(t):
    return Frame(t("events").select(F.nullif("event_type", F.lit("click")).alias("e"), "value")).drop_null("e").agg(X.count().alias("n")).df


@query("skip_existing", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def skip_existing(t):
    done = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return Frame(t("orders").select("o_orderkey")).skip_existing(Frame(done), "o_orderkey").df


@query("sample_fraction")
def sample_fraction(t):
    return Frame(t("orders")).sample(fraction=0.1, seed=3).df


@query("sample_size", "SELECT 50::bigint AS n")
def sample_size(t):
    return Frame(t("orders")).sample(size=50, seed=3).agg(X.count().alias("n")).df


@query("monotonic_id", "SELECT count(*) AS n, count(*) AS ids FROM lineitem")
def monotonic_id(t):
    return Frame(t("lineitem")).add_monotonically_increasing_id("id").agg(X.count().alias("n"), X.count_distinct("id").alias("ids")).df


# SQL.


@query(
    "sql_cte_subqueries",
    """WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > (SELECT avg(o_totalprice) * 10 FROM orders))
       SELECT c_custkey, c_name, round(total, 2) AS total, CASE WHEN total > 2000000 THEN 'high' ELSE 'low' END AS class, c_custkey // 7 AS bucket
       FROM big JOIN customer ON c_custkey = o_custkey WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)
       AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o.o_orderstatus = 'F')""",
)
def sql_cte(t):
    from sparkloom.plans.registry import ORACLE_SQL

    s = Session(t("orders").sparkSession)
    return s.sql(ORACLE_SQL["sql_cte_subqueries"], orders=t("orders"), customer=t("customer"), nation=t("nation")).df


@query("sql_windows_sets", "SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name DESC) AS rn FROM nation WHERE n_name LIKE '%A%' UNION ALL SELECT r_regionkey, r_name, 0 FROM region")
def sql_windows(t):
    from sparkloom.plans.registry import ORACLE_SQL

    return Session(t("nation").sparkSession).sql(ORACLE_SQL["sql_windows_sets"], nation=t("nation"), region=t("region")).df


@query("time_buckets", "SELECT time_bucket(INTERVAL 15 MINUTES, ts) AS bucket, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def time_buckets(t):
    return t("events").groupBy(X.date_trunc("15 minutes", "ts").alias("bucket"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
