"""Packing against the tokenizer itself, and the mixed encoder against it."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import packing
from sparkloom.llm.bpe import ByteBpe
from sparkloom.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    out = Tokenizer.from_file(tokenizer_path())
    out.encode_special_tokens = True
    return out


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("window", [2048, 64])
@pytest.mark.parametrize("name", ["odd", "small"])
def test_pack(request, tokenizer, name, window):
    docs = request.getfixturevalue(name)
    rows = [(r["doc_id"], ids_of(tokenizer, r["text"])) for r in docs.select("doc_id", "text").collect()]
    pieces = packing.pack(docs, tokenizer_path(), window=window, with_ids=True).collect()
    places, parts = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] and len(p["ids"]) == p["length"] > 0
        places[p["sequence_id"]].append((p["offset"], p["length"]))
        parts[p["doc_id"], p["doc_tokens"]].append((p["start"], p["ids"]))
    for at in places.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= window
    assert sorted(places) == list(range(len(places)))
    total = sum(len(ids) for _, ids in rows)
    assert sum(p["length"] for p in pieces) == total and len(places) <= -(-total // window) + 1
    for d, ids in rows:  # every id of every document is in some piece at its place
        found = defaultdict(set)
        for start, part in parts[d, len(ids)]:
            for k, x in enumerate(part, start):
                found[k].add(x)
        assert all(ids[k] in found[k] for k in range(len(ids)))


def test_encoder(tokenizer):
    texts = [None, "", "don't we'll  I'M it's\n\n x", "  lead and trail  ", "  x ½² a1b2", "café \U0001f600中文 กำ", "<|endoftext|> 'sx ''s", "\x00\x1c\x85 a", "é ñ कि", "x" * 3000, "'" * 40, "\t \t a\r\n b"]
    for column in (texts, texts[:4]):
        ids, heads = ByteBpe(tokenizer_path()).encode(pa.array(column))
        for k, t in enumerate(column):
            assert ids[heads[k] : heads[k + 1]].tolist() == ids_of(tokenizer, t)[:-1]


def test_empty(none):
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_plan_leaves_one_short_window():
    rng = np.random.default_rng(1)
    for _ in range(20):
        histogram = {int(k): int(n) for k, n in zip(rng.integers(1, 64, 30), rng.integers(1, 50, 30), strict=True)}
        rows, n = packing.pack_plan(histogram, 64)
        assert sum((b - a) * (high - low) for _, low, high, a, b, _, _ in rows) == sum(k * x for k, x in histogram.items())
        assert n == -(-sum(k * x for k, x in histogram.items()) // 64)
