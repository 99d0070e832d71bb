"""The frame API on small fixtures: nulls, duplicates, empty inputs."""

import datetime as dt

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom import functions as X
from sparkloom.frame import Frame
from sparkloom.functions import udf
from sparkloom.functions.windows import Window, over
from sparkloom.session import Session, dialect
from sparkloom.sources import readers


def make(spark, rows, schema):
    return Frame(spark.createDataFrame(rows, schema))


def listed(frame, *by):
    return [tuple(r) for r in frame.df.orderBy(*by).collect()]


def test_join_renames_and_nulls(spark):
    a = make(spark, [(1, 10), (2, 20), (None, 30)], "idx int, val int")
    b = make(spark, [(1, 1.5), (1, 2.5), (None, 9.0), (4, 4.0)], "idx int, val double")
    inner = a.join(b, on="idx")
    assert inner.column_names == ["idx", "val", "right.val"]
    assert sorted(r[2] for r in inner.df.collect()) == [1.5, 2.5]
    assert a.join(b, on="idx", how="outer").count_rows() == 6
    assert a.join(b, on="idx", how="inner", null_equals_null=True).count_rows() == 3
    assert a.join(b, on="idx", how="anti").count_rows() == 2
    assert a.join(b, left_on="idx", right_on="val", how="left", suffix="_b").column_names == ["idx", "val", "idx_b", "val_b"]
    with pytest.raises(ValueError):
        a.join(b, on="idx", how="cross")


def test_asof_null_keys_and_ties(spark):
    left = make(spark, [("a", 10, 1), ("a", None, 2), (None, 10, 3), ("b", 5, 4)], "e string, t int, v int")
    right = make(spark, [("a", 8, 80), ("a", 12, 120), (None, 10, 999), ("a", None, 998)], "e string, t int, w int")
    get = lambda s: {r["v"]: r["w"] for r in left.join_asof(right, on="t", by="e", strategy=s).df.collect()}
    assert get("backward") == {1: 80, 2: None, 3: None, 4: None}
    assert get("forward") == {1: 120, 2: None, 3: None, 4: None}
    assert get("nearest") == {1: 120, 2: None, 3: None, 4: None}
    empty = make(spark, [], "e string, t int, w int")
    assert {r["w"] for r in left.join_asof(empty, on="t", by="e").df.collect()} == {None}


def test_explode_keeps_empty_and_null(spark):
    f = make(spark, [(1, [1, 2]), (2, []), (3, None)], "id int, v array<int>")
    assert listed(f.explode("v", index_column="at"), "id", "at") == [(1, 1, 0), (1, 2, 1), (2, None, None), (3, None, None)]
    assert f.explode("v", ignore_empty_and_null=True).count_rows() == 2
    two = make(spark, [(1, [1, 2], ["x"])], "id int, a array<int>, b array<string>")
    assert listed(two.explode("a", "b"), "a") == [(1, 1, "x"), (1, 2, None)]


def test_sort_puts_nulls_as_greatest(spark):
    f = make(spark, [(1,), (None,), (3,)], "v int")
    assert [r[0] for r in f.sort("v").df.collect()] == [1, 3, None]
    assert [r[0] for r in f.sort("v", desc=True).df.collect()] == [None, 3, 1]
    assert [r[0] for r in f.sort("v", nulls_first=True).df.collect()] == [None, 1, 3]


def test_window_without_frame_is_whole_partition(spark):
    f = make(spark, [("a", 1), ("a", 2), ("b", 5)], "k string, v int")
    out = f.df.select("k", over(F.sum("v"), Window().partition_by("k").order_by("v")).alias("s"))
    assert sorted(tuple(r) for r in out.collect()) == [("a", 3), ("a", 3), ("b", 5)]


def test_group_aggregates(spark):
    f = make(spark, [("a", 1.0), ("a", None), (None, 3.0), (None, 5.0)], "k string, v double")
    assert dict(tuple(r) for r in f.groupby("k").sum("v").df.collect()) == {"a": 1.0, None: 8.0}
    assert dict(tuple(r) for r in f.groupby("k").agg(X.stddev("v", ddof=2).alias("s")).df.collect()) == {"a": None, None: None}
    assert sorted((r[0] or "", sorted(map(str, r[1]))) for r in f.groupby("k").list_agg("v").df.collect()) == [("", ["3.0", "5.0"]), ("a", ["1.0", "None"])]
    assert f.count_distinct("k").to_pydict() == {"k": [1]}


def test_string_functions(spark):
    df = spark.createDataFrame([("helloWorld",), ("hello-world",), ("HelloWorld",), ("HTTPServer",)], "t string")
    out = df.select(X.to_snake_case("t"), X.to_camel_case("t"), X.to_upper_camel_case("t"), X.to_title_case("t")).collect()
    assert [tuple(r) for r in out[:3]] == [("hello_world", "helloWorld", "HelloWorld", "Hello World")] * 3
    assert out[3][0] == "http_server"
    one = spark.createDataFrame([("a.b.c", "kitten", "sitting", None)], "s string, a string, b string, n string")
    r = one.select(X.split("s", "."), X.regexp_extract("s", "z+"), X.hamming_distance_str("a", "b"), X.levenshtein_distance("a", "b"), X.concat_ws("-", "n", "n"), X.find("s", "zz"), X.damerau_levenshtein_distance("a", "b"), X.jaro_similarity("a", "n")).first()
    assert list(r) == [["a", "b", "c"], None, None, 3, None, -1, 3, None]


def test_list_functions(spark):
    df = spark.createDataFrame([([1, None, 3],), ([],), (None,), ([None],)], "v array<int>")
    got = [tuple(r) for r in df.select(X.list_sum("v"), X.list_count("v"), X.list_mean("v"), X.list_distinct("v"), X.list_sort("v", desc=True)).collect()]
    assert got == [(4, 2, 2.0, [1, 3], [None, 3, 1]), (None, 0, None, [], []), (None, None, None, None, None), (None, 0, None, [], [None])]
    c = spark.createDataFrame([([1, 2, 3, 4, 5],), ([1],), (None,)], "v array<int>").select(X.chunk("v", 2)).collect()
    assert [r[0] for r in c] == [[[1, 2], [3, 4]], [], None]
    assert spark.createDataFrame([(3,), (0,)], "n int").select(X.seq("n")).collect() == [([0, 1, 2],), ([],)]
    assert spark.createDataFrame([(["a", "b", "a"],)], "v array<string>").select(X.value_counts("v")).first()[0] == {"a": 2, "b": 1}


def test_temporal(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 5, 16, 13, 47, 9, 123456),)], "t timestamp_ntz")
    r = df.select(X.day_of_week("t"), X.date_trunc("15 minutes", "t"), X.date_trunc("1 week", "t"), X.strftime("t", "%d/%m/%Y at %H"), X.microsecond("t"), X.millisecond("t")).first()
    assert list(r) == [3, dt.datetime(2024, 5, 16, 13, 45), dt.datetime(2024, 5, 13), "16/05/2024 at 13", 123456, 123]


def test_numeric_edges(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 1.0)], "a double, b double")
    out = [r[0] for r in df.select(X.true_divide("a", "b")).collect()]
    assert out[0] == float("inf") and out[1] == float("-inf") and out[2] != out[2] and out[3] is None
    assert [r[0] for r in df.select(X.ln("a")).collect()][2] == float("-inf")


def test_iceberg_bucket(spark):
    df = spark.createDataFrame([(34, "iceberg")], "i long, s string")
    assert list(df.select(X.partition_iceberg_bucket("i", 2**31 - 1), X.partition_iceberg_bucket("s", 2**31 - 1)).first()) == [2017239379, 1210000089]


def test_sql_dialect(spark):
    assert "NULLS LAST" in dialect("select * from t order by a")
    assert dialect("select 'a // b order by c'") == "select 'a // b order by c'"
    f = make(spark, [(7,), (None,), (2,)], "v int")
    assert [r[0] for r in Session(spark).sql("SELECT v // 2 AS h FROM t ORDER BY v DESC", t=f).df.collect()] == [None, 3, 1]


def test_files(spark, tmp_path):
    f = make(spark, [(1, "a"), (2, "b,c"), (3, None)], "k int, s string")
    for fmt in ("parquet", "csv", "json"):
        path = f"{tmp_path}/{fmt}"
        getattr(f, f"write_{fmt}")(path, write_mode="overwrite")
        back = getattr(readers, f"read_{fmt}")(spark, path, file_path_column="p")
        assert listed(back.select("k", "s"), "k") == [(1, "a"), (2, "b,c"), (3, None)]
    (tmp_path / "t.txt").write_text("x\n\ny\n")
    assert readers.read_text(spark, f"{tmp_path}/t.txt").count_rows() == 2
    assert readers.from_glob_path(spark, f"{tmp_path}/t.txt").count_rows() == 1
    body = b"GET / HTTP/1.1\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: request\r\nWARC-Date: 2024-01-02T03:04:05Z\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (len(body), body))
    r = readers.read_warc(spark, f"{tmp_path}/a.warc").df.first()
    assert r["WARC_Type"] == "request" and bytes(r["warc_content"]) == body


def test_sql_source(spark, tmp_path):
    import sqlite3

    path = f"{tmp_path}/x.db"
    with sqlite3.connect(path) as db:
        db.execute("create table t (k int, s text)")
        db.executemany("insert into t values (?, ?)", [(k, str(k)) for k in range(20)])

    def conn():
        import sqlite3

        return sqlite3.connect(path)

    out = readers.read_sql(spark, "select * from t", conn, partition_col="k", num_partitions=3, schema="k long, s string")
    assert out.df.agg(F.count("*"), F.sum("k")).first()[:] == (20, 190)


def test_generator_and_sink(spark):
    from sparkloom.operators.sinks import Sink

    def one():
        yield from ((k,) for k in range(3))

    f = readers.read_generator(spark, [one, one], "k long")
    assert f.count_rows() == 6

    class Counts(Sink):
        def write(self, batches):
            yield {"rows": sum(b.num_rows for b in batches)}

    assert sum(r["rows"] for r in f.write_sink(Counts()).to_pylist()) == 6


def test_udfs(spark):
    from sparkloom.functions import udf

    df = spark.createDataFrame([(1,), (0,), (None,)], "v int")
    safe = udf.func("double", on_error="ignore")(lambda v: 1 / v)
    assert [r[0] for r in df.select(safe("v")).collect()] == [1.0, None, None]

    async def plus(v):
        return v + 1

    assert [r[0] for r in df.where("v is not null").select(udf.func("long")(plus)("v")).collect()] == [2, 1]


def test_sample_and_rows(spark):
    f = readers.range(spark, 100)
    assert f.sample(size=7, seed=1).count_rows() == 7
    assert f.sample(size=150, with_replacement=True, seed=1).count_rows() == 150
    assert len(list(f.iter_rows())) == 100
    assert sum(len(p) for p in f.iter_partitions()) == 100


def test_batches_and_samples(spark):
    f = Frame(spark.range(0, 1000, 1, 3).selectExpr("id", "id % 7 AS v"))
    seen = [r["n"] for r in f.into_batches(64).map_batches(lambda b: pa.RecordBatch.from_pydict({"n": [b.num_rows]}), "n long").to_pylist()]
    assert sum(seen) == 1000 and sorted(seen) == sorted([64] * 15 + [13, 13, 14]) and f.into_batches(64).count_rows() == 1000
    sizes = udf.batch("int", batch_size=50)(lambda s: pd.Series([len(s)] * len(s), index=s.index))
    assert {r["n"] for r in f.select(sizes("id").alias("n")).to_pylist()} <= {50, 33, 34}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
    assert sum(b.num_rows for b in f.to_arrow_iter(100)) == 1000
    again = Frame(f.df.repartition(5))
    one = lambda x, **kw: sorted(r["id"] for r in x.sample(size=20, seed=3, **kw).to_pylist())
    assert one(f) == one(again) and len(set(one(f))) == 20
    assert [r["id"] for r in f.shuffle(seed=5).to_pylist()] == [r["id"] for r in again.shuffle(seed=5).to_pylist()]
    assert len(one(f, with_replacement=True)) == 20 and len(f.sample(size=3000, with_replacement=True, seed=1).to_pylist()) == 3000
    assert Frame(f.df.limit(0)).sample(size=5, with_replacement=True).to_pylist() == []


def test_warc_ranges(spark, tmp_path):
    """Records of a gzip file, a member each, read by ranges that cut members, and of one member."""
    import gzip

    from sparkloom.sources import readers

    record = lambda k: b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:%d>\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (k, 50 + k * 13, bytes((k * 7 + i * i) % 251 for i in range(50 + k * 13)))
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(record(k)) for k in range(60)))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(record(k) for k in range(60, 80))))
    (tmp_path / "c.warc").write_bytes(b"".join(record(k) for k in range(80, 90)))
    for size in ("300", "100000"):
        out = readers.read_warc(spark, str(tmp_path), rangeBytes=size).df.collect()
        assert sorted(int(r["WARC_Record_ID"]) for r in out) == list(range(90))
        assert all(len(r["warc_content"]) == r["Content_Length"] == 50 + int(r["WARC_Record_ID"]) * 13 for r in out)


def test_minhash_simhash_of_long_texts_in_linear_time(spark):
    """Equal to loops, and texts of 100,000 characters in seconds: work once grew with the square of a text's length."""
    import random
    import time

    import xxhash

    rng = random.Random(5)
    texts = ["".join(rng.choices("abcde é漢😀 \n", k=n)) for n in (100_000, 99_999, 4, 3, 0)]
    start = time.time()
    got = spark.createDataFrame(list(enumerate([*texts, None])), "k int, t string").select("k", X.simhash("t", 4).alias("s"), X.minhash("t", 2, 2).alias("m")).collect()
    assert time.time() - start < 60
    for k, text in enumerate(texts):
        grams = [xxhash.xxh64_intdigest(text[i : i + 4].encode(), 42) for i in range(max(len(text) - 3, 1))]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in grams) > len(grams))
        assert got[k].s == (want ^ 1 << 63) - (1 << 63)
        assert len(got[k].m) == 2
    assert got[5].s is None and got[5].m is None


def test_minhash_simhash_by_loops(spark):
    import re
    import struct

    import xxhash

    from sparkloom import functions as X

    texts = ["a b c d", "one", "", "the quick brown fox jumps", "x  y\tz", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", X.minhash("t", 4, 2, seed=9).alias("m"), X.simhash("t", 3).alias("s")).collect()
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    for k, m, s in rows:
        if texts[k] is None:
            assert m is None and s is None
            continue
        words = re.sub(r"\s+", " ", texts[k]).strip().split(" ")
        grams = [" ".join(words[i : i + 2]) for i in range(len(words) - 1)] or [" ".join(words)]
        assert m == [min(signed(xxhash.xxh64_intdigest(g.encode(), xxhash.xxh64_intdigest(struct.pack("<i", seed), 42))) for g in grams) for seed in range(9, 13)]
        parts = [texts[k][i : i + 3] for i in range(max(1, len(texts[k]) - 2))]
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        assert s == signed(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))


def test_sink_discards_and_checkpoints(spark, tmp_path):
    from sparkloom.operators.sinks import CheckpointStore

    df = spark.range(10).withColumnRenamed("id", "k")
    store = CheckpointStore(spark, f"file://{tmp_path}/store")
    assert store.unseen(df, "k").count() == 10 and store.runs() == []
    store.stage(df.where("k < 4"), "k", "a")
    assert store.unseen(df, "k").count() == 10
    store.commit("a")
    assert store.runs() == ["a"] and sorted(r["k"] for r in store.unseen(df, "k").collect()) == list(range(4, 10))
    with pytest.raises(OSError, match="wasn't staged"):
        store.commit("b")


def test_asof_buckets_agree(spark):
    import random

    rng = random.Random(5)
    left = Frame(spark.createDataFrame([(rng.choice("ab"), rng.choice([None, *range(200)]), k) for k in range(300)], "e string, t int, v int"))
    right = Frame(spark.createDataFrame([(rng.choice(["a", "b", None]), t, t * 2 + j) for j, t in enumerate(rng.sample(range(200), 40))], "e string, t int, w int"))
    for strategy in ("backward", "forward", "nearest"):
        for by in ("e", None):
            one, many = (sorted(map(str, left.join_asof(right, on="t", by=by, strategy=strategy, buckets=n).to_pylist())) for n in (1, 9))
            assert one == many


def test_metrics_and_skipped_files(spark, tmp_path):
    f = make(spark, [(k % 3, k) for k in range(100)], "k int, v int").groupby("k").agg(n=F.count("v"))
    with pytest.raises(ValueError):
        f.metrics  # noqa: B018
    seen = f.collect().metrics.df.where("metric = 'numOutputRows' and operator like '%Aggregate%'").collect()
    assert 3 in {r["value"] for r in seen}

    folder = str(tmp_path / "p")
    spark.range(1000).repartition(3).write.parquet(folder)
    whole = sorted((tmp_path / "p").glob("*.parquet"))
    (tmp_path / "p" / "a.parquet").write_bytes(whole[0].read_bytes()[:200])
    got = readers.read_parquet(spark, folder, schema="id long", ignore_corrupt_files=True)
    with pytest.raises(ValueError):
        got.skipped_corrupt_files  # noqa: B018
    assert got.collect().count_rows() == 1000
    (path, reason, partial), *rest = got.skipped_corrupt_files
    assert path.endswith("a.parquet") and reason and not partial and not rest

    import gzip

    packed = gzip.compress(b"".join(b"%d,x\n" % (k * k) for k in range(20000)))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "good.csv.gz").write_bytes(packed)
    (tmp_path / "c" / "short.csv.gz").write_bytes(packed[: len(packed) // 2])
    lines = readers.read_csv(spark, str(tmp_path / "c"), schema="a long, b string", has_headers=False, ignore_corrupt_files=True).collect()
    assert [(p[-12:], bool(r)) for p, r, _ in lines.skipped_corrupt_files] == [("short.csv.gz", True)]
    assert make(spark, [(1,)], "a int").collect().skipped_corrupt_files == []


def test_table_object(spark):
    s = Session(spark)
    s.drop_table("kept_rows")
    t = s.create_table_if_not_exists("kept_rows", make(spark, [(1, "a")], "k int, v string"))
    t.append(make(spark, [("b", 2)], "v string, k int"))
    assert listed(t.read(), "k") == [(1, "a"), (2, "b")] and t.schema().names == ["k", "v"]
    t.overwrite(make(spark, [(3, None)], "k int, v string"))
    assert listed(s.get_table("kept_rows").select("k"), "k") == [(3,)]
    assert s.create_table_if_not_exists("kept_rows", make(spark, [(9, "z")], "k int, v string")).read().count_rows() == 1
    with pytest.raises(ValueError):
        t.write(make(spark, [(1, "a")], "k int, v string"), mode="ignore")
    with pytest.raises(ValueError):
        s.get_table("no_such_rows")
    s.drop_table("kept_rows")
