import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, task long, fp long, h string, size string, bid string"
SF = "/root/testdata/sf0.001"


def texts():
    """Null, empty, odd, long and repeated texts; near copies; shared passages; license lines."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghijklé中", k=rng.randint(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage = prose(70)
    base = prose(120)
    near = base.split()
    near[60] = "changed"
    out = [None, None, "", "", " \n\t", "one", "ONE two", "one two three", "\x00\x1f #$% <>|", "  x", "café \U0001f600 中文"]
    out += [base, base, base.upper(), " ".join(near), base + " tail", prose(40) + " " + passage + " " + prose(30), passage + " " + prose(55), prose(20) + passage]
    out += ["ab" * 400, "x" * 900, prose(9) + "\n" + prose(9) + "\n" + prose(9)] + ["same line here\n" * 40] * 2
    out += ["This is Under the MIT-License; Apache License, Version 2 and CC BY NC. " + prose(30), "cc by nc cc by nc", "licensed under cc by 4 0", "Licensed under the Apache License Version 2 0 " + prose(25)]
    out += [prose(rng.randint(20, 90)) for _ in range(60)] + [prose(9000)]
    return out


def rows():
    ids = [None, None, *range(3, 1000)]
    sources = ["web", "web", "web", "book", None, "a", "Z"]
    return [(None if k in (20, 21) else ids[k], t, None, sources[k % 7], None if t is None else len(t), k, 1, 2, "h", "s", "b") for k, t in enumerate(texts())] + [(50, "a row whose doc_id comes twice", "en", "web", 30, 0, 0, 0, None, None, None)]


@pytest.fixture(scope="session")
def odd_rows():
    return rows()


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def small_rows(small):
    return [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
