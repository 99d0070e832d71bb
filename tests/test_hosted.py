"""Sinks for hosted stores against stores in a folder, and a crawl laid out on disk."""

import gzip
import json
import os
import uuid

import pyarrow.parquet as pq
import pytest

from sparkloom.frame import Frame
from sparkloom.sources import datasets


def _lines(folder) -> list:
    return [json.loads(line) for f in os.listdir(folder) for line in open(os.path.join(folder, f))]


def test_turbopuffer(spark, tmp_path):
    folder = str(tmp_path)

    class Space:
        def write(self, upsert_rows, distance_metric):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.writelines(json.dumps([distance_metric, len(upsert_rows), r]) + "\n" for r in upsert_rows)

    class Store:
        def namespace(self, name):
            assert name == "space"
            return Space()

    df = spark.range(25).selectExpr("id AS k", "array(id * 1.0D, 2.0D) AS v", "'x' AS note").repartition(3)
    out = Frame(df).write_turbopuffer("space", id_column="k", vector_column="v", distance_metric="cosine_distance", client=Store, rows_a_write=4)
    assert sum(r["rows"] for r in out.to_pylist()) == 25
    got = sorted(_lines(folder), key=lambda x: x[2]["id"])
    assert [x[2] for x in got] == [{"id": k, "vector": [k, 2.0], "note": "x"} for k in range(25)]
    assert max(x[1] for x in got) <= 4 and {x[0] for x in got} == {"cosine_distance"}


def test_bigtable(spark, tmp_path):
    folder = str(tmp_path)

    class Row:
        def __init__(self, key):
            self.cells = [key.decode()]

        def set_cell(self, family, name, value):
            self.cells.append([family, name.decode(), value])

    class Batcher:
        def __init__(self, table):
            self.table, self.rows = table, []

        def __enter__(self):
            return self

        def __exit__(self, *_):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.writelines(json.dumps(r.cells) + "\n" for r in self.rows)

        def mutate(self, row):
            self.rows.append(row)

    class Table:
        def direct_row(self, key):
            return Row(key)

        def mutations_batcher(self):
            return Batcher(self)

    class Client:
        def instance(self, name):
            return self

        def table(self, name):
            return Table()

    df = spark.createDataFrame([("a", 1, 2.5, None), ("b", None, None, [1, 2])], "k string, n long, x double, l array<int>")
    Frame(df).write_bigtable("p", "i", "t", "k", {"n": "f", "x": "f", "l": "g"}, client=Client)
    assert sorted(_lines(folder)) == [["a", ["f", "n", 1], ["f", "x", "2.5"]], ["b", ["g", "l", "[1, 2]"]]]
    with pytest.raises(Exception, match="without a family"):
        Frame(df).write_bigtable("p", "i", "t", "k", {"n": "f"}, client=Client)


def test_huggingface(spark, tmp_path):
    folder = str(tmp_path)
    os.makedirs(f"{folder}/data")
    open(f"{folder}/data/train-old.parquet", "w").close()
    open(f"{folder}/data/test-old.parquet", "w").close()

    class Store:
        def create(self, repo):
            assert repo == "me/set"

        def add(self, repo, path, content, revision):
            with open(f"{folder}/{path}.up", "wb") as f:
                f.write(content)
            return path

        def files(self, repo, revision):
            return [f"data/{f}" for f in os.listdir(f"{folder}/data") if not f.endswith(".up")]

        def commit(self, repo, added, removed, message, revision):
            for p in added:
                os.rename(f"{folder}/{p}.up", f"{folder}/{p}")
            for p in removed:
                os.remove(f"{folder}/{p}")

    out = Frame(spark.range(1000).repartition(3)).write_huggingface("me/set", overwrite=True, client=Store, file_bytes=1).to_pylist()
    files = [f for f in os.listdir(f"{folder}/data") if f.startswith("train")]
    assert sorted(f"data/{f}" for f in files) == sorted(r["path"] for r in out) and "train-old.parquet" not in files
    assert sorted(k for f in files for k in pq.read_table(f"{folder}/data/{f}")["id"].to_pylist()) == list(range(1000))
    assert os.path.exists(f"{folder}/data/test-old.parquet")


def test_common_crawl(spark, tmp_path):
    names = [f"crawl-data/C/segments/{s}/wet/{k}.warc.wet.gz" for s in ("1", "2") for k in range(2)]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        body = name.encode()
        (tmp_path / name).write_bytes(gzip.compress(b"WARC/1.0\r\nWARC-Type: conversion\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (len(body), body)))
    (tmp_path / "crawl-data/C/wet.paths.gz").write_bytes(gzip.compress("\n".join(names).encode()))
    read = lambda **kw: sorted(bytes(r["warc_content"]).decode() for r in datasets.common_crawl(spark, "C", content="text", root=f"file://{tmp_path}", **kw).df.collect())
    assert read() == names and read(segment="2") == names[2:] and read(num_files=1) == names[:1]
    with pytest.raises(ValueError, match="content"):
        datasets.common_crawl(spark, "C", content="sound")
