"""Classifiers on held-out labels, the language model on held-out text, the archive reader and the pipeline."""

import os
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import batches, licenses, lm, media, mixing, quality_classifier, quality_rules, shared, simhash, substring_dedup, toxicity
from sparkloom.llm.components import components, stars
from tests.llm import brute

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    pos = np.asarray(label) == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def test_toxicity_held_out(tables):
    docs, labels = tables
    out = toxicity.score_documents(docs, labels)
    assert out.count() == docs.count()
    rows = out.join(labels, "doc_id").where("held_out and toxic is not null").select("score", "predicted", "toxic").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert auc([r["score"] for r in rows], [r["toxic"] for r in rows]) > 0.9
    clean = toxicity.clean_documents(docs, labels)
    assert clean.columns == docs.columns and clean.count() == out.where("predicted = 0").count()


def test_quality_held_out(tables):
    docs, labels = tables
    out = quality_classifier.score_documents(docs, labels)
    assert out.count() == docs.count()
    rows = out.join(labels, "doc_id").where("held_out").select("tail_probability", "expected_grade", "quality").collect()
    assert auc([r["tail_probability"] for r in rows], [r["quality"] for r in rows]) > 0.85
    assert all(0 <= r["expected_grade"] <= 2 for r in rows)


@pytest.mark.parametrize("score", [toxicity.score_documents, quality_classifier.score_documents])
def test_classifier_cases(spark, odd, none, score):
    labels = spark.createDataFrame([(k, k % 2, k % 3 % 2) for k in range(3, 90)] + [(None, 1, 1), (5, None, None), (7, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    assert score(odd, labels).count() == odd.count()
    assert score(odd, labels.limit(0)).count() == odd.count()
    assert score(none, labels).count() == 0


def test_lm_beats_base(tables):
    rows = lm.score_documents(tables[0]).where("held_out").select("score", "base_score").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_lm_filter():
    rng = np.random.default_rng(2)
    h = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64) << np.uint64(1))
    level = lm.levels(rng.integers(1, 1000, h.size))
    piece = lm.segment(h, level, h[:0], level[:0], 1 << 22, 10.0)
    found = lm.LogFilter(np.append(piece, np.uint8(0)), np.array([0, 8 * piece.size])).lookup(h)
    assert (found >= level).all() and (found == level).mean() > 0.8


def test_lm_filter_keeps_all():
    h = np.arange(1, 1001, dtype=np.uint64) << np.uint64(40)
    with pytest.raises(ValueError, match="more shards"):  # never fewer n-grams
        lm.segment(h, np.ones(1000, np.int64), h, np.full(1000, 2), 8000, 10.0)


@pytest.fixture(scope="module")
def lm_case(spark):
    """Texts, which are held out, and a plain P(w | h) from exact counts, each replaced by its level's."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 300, 100)) for _ in range(60)] * 2 + [f"w{k} w{k + 1} unseen{k}" for k in range(20)]
    held = [k >= 120 or k % 10 == 3 for k in range(140)]
    tokens = [["", *t.split(), ""] for t in texts]  # an end token is before the first word and after the last
    train = [ws for ws, out in zip(tokens, held, strict=True) if not out]
    stands = lambda n: float(lm.level_counts()[lm.levels(np.array([n]))][0])
    one = {w: stands(n) for w, n in Counter(w for ws in train for w in ws[1:]).items()}
    two = {x: stands(n) for x, n in Counter(x for ws in train for x in zip(ws[:-1], ws[1:], strict=True)).items()}
    mass, kinds, total = Counter(), Counter(), sum(one.values()) + 0.1 * (len(one) + 1)
    for (h, _), c in two.items():
        mass[h] += c
        kinds[h] += 1

    def p(h, w):
        word = (one.get(w, 0) + 0.1) / total
        return (two.get((h, w), 0) + kinds[h] * word) / (mass[h] + kinds[h]) if kinds[h] else word

    docs = spark.createDataFrame([(k, t, out) for k, (t, out) in enumerate(zip(texts, held, strict=True))], "doc_id long, text string, out boolean")
    return docs, tokens, p, sorted(one)


def test_lm_scores(lm_case):
    docs, tokens, p, _ = lm_case
    want = [sum(np.log10(p(h, w)) for h, w in zip(ws[:-1], ws[1:], strict=True)) for ws in tokens]
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs, F.col("out"), bits=10000.0, shard_bytes=10_000).collect()}
    assert [got[k] for k in range(len(tokens))] == pytest.approx(want, abs=1e-6)


def test_lm_sums_to_one(spark, lm_case):
    """Probabilities after a history, over all words and an unknown one, within the filter's error rate."""
    docs, _, p, words = lm_case
    assert sum(p("w5", w) for w in [*words, "?"]) == pytest.approx(1)
    asked = [f"w5 {w}" for w in [*words, "?"] if w] + ["w5"]
    both = docs.union(spark.createDataFrame([(1000 + k, t, True) for k, t in enumerate(asked)], docs.schema))
    end = [*(f"w5 {w}" for w in words if w), "w5 ?"]
    out = {r["doc_id"]: r["score"] for r in lm.score_documents(both, F.col("out")).collect()}
    start = np.log10(p("", "w5"))
    of = [10 ** (out[1000 + k] - start - np.log10(p(t.split()[1], ""))) for k, t in enumerate(end)] + [10 ** (out[1000 + len(asked) - 1] - start)]
    assert sum(of) == pytest.approx(1, abs=len(words) * 2.0**-lm.PROBES)


@pytest.mark.parametrize("bits", [16.0, 24.0, 64.0])
def test_lm_beats_base_at_each_size(tables, bits):
    docs = tables[0].limit(1500)
    rows = lm.score_documents(docs, bits=bits).where("held_out").select("score", "base_score").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_lm_counts_do_not_wrap():
    keys, counts = np.arange(3, dtype=np.uint64), np.array([1, 5_000_000_000, 7])
    assert [x.tolist() for x in lm._unsqueeze(lm._squeeze(keys, counts))] == [[0, 1, 2], [1, 5_000_000_000, 7]]


def test_lm_memory(spark, monkeypatch):
    """Bytes of NumPy arrays for each token of a batch that a step holds at most, in steps run here on one batch."""
    rng, shards, most = np.random.default_rng(4), 8, {}
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.2, 2000) % 300_000) for _ in range(500)]
    docs = pa.table({"doc_id": range(500), "text": texts, "held_out": [k % 10 == 0 for k in range(500)]})
    n = sum(len(t.split()) + 1 for t in texts)

    def measured(step, f):
        tracemalloc.start()
        out = f()
        most[step] = max(most.get(step, 0), tracemalloc.get_traced_memory()[1] / n)
        tracemalloc.stop()
        return out

    blob = batches.to_bytes(docs)
    sent = measured("counts", lambda: list(lm._counts(shards)(iter([pa.RecordBatch.from_pydict({"bid": [0], "rows": [blob]})]))))
    alone = {"shard": pa.array([0]), "bid": pa.array([0])}  # all in one shard, as one of a larger corpus would be
    words, pairs = (np.concatenate([lm._unsqueeze(b.column(c)[0].as_py())[0] for b in sent]) for c in ("words", "pairs"))
    whole = pa.table(alone | {c: pa.array([lm._squeeze(np.sort(x), np.ones(x.size, np.int64))]) for c, x in (("words", words), ("pairs", pairs))})
    measured("tally", lambda: lm._tally(16.0, 1)(whole))
    tally = pa.concat_tables(lm._tally(16.0, shards)(pa.Table.from_batches([b])) for b in sent)
    kinds = np.array(tally.column("kind").to_pylist())
    parts = tally.filter(pa.array(kinds == "part")).select(["words"]).rename_columns(["sums"])
    asked = lm._histories((0,), tally.filter(pa.array(kinds == "word")), parts)
    found = pa.concat_tables([asked, tally.filter(pa.array(kinds == "pair")).select(["shard", "bid", "pair_levels"])], promote_options="default")
    monkeypatch.setattr(lm, "answered", lambda batches, answers, f, schema: f)
    score = lm.score_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    rows = measured("score", lambda: score(0, batches.from_bytes(blob), found))
    assert sum(t.num_rows for t in rows) == 500
    assert most["counts"] < 55 and most["tally"] < 42 and most["score"] < 55, most


def test_lm_pages(spark, monkeypatch):
    """Batches are not compressed twice, and both tables' pages are checked at each row."""
    options, real = {}, shared.saved

    def kept(df, name, **given):
        options[name] = given
        out = real(df, name, **given)
        if name == "lm-batches":
            files = Path(out._saved_at.removeprefix("file:")).glob("*.parquet")
            options["codecs"] = {m.row_group(0).column(1).compression for m in map(pq.read_metadata, files) if m.num_row_groups}
        return out

    monkeypatch.setattr(lm, "saved", kept)
    monkeypatch.setattr(batches, "saved", kept)
    lm.score_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    assert options["codecs"] == {"UNCOMPRESSED"}
    assert all(options[t].get("parquet.page.size.row.check.min") == "1" for t in ("lm-batches", "lm-tally"))


def test_substring_memory(spark, monkeypatch):
    """Bytes of NumPy arrays for each byte of a batch that a step holds at most; its batches are not compressed twice, their pages checked at each row."""
    rng = np.random.default_rng(6)
    passages = [rng.bytes(300).hex() for _ in range(40)]
    docs = pa.table({"text": [rng.bytes(500).hex() + passages[k % 40] for k in range(2500)]}).to_batches()[0]
    most = {}

    def measured(step, f):
        tracemalloc.start()
        out = f()
        most[step] = tracemalloc.get_traced_memory()[1] / docs.nbytes
        tracemalloc.stop()
        return out

    entries = measured("entries", lambda: substring_dedup._entries(docs, 200))
    answers = substring_dedup._judge(pa.table({"bid": [0], "entries": [entries.tobytes()]}))
    found = pa.concat_tables(measured("act", lambda: substring_dedup._act(200)(0, docs, answers)))
    assert {r for r, b in zip(found.column("row").to_pylist(), found.column("bytes").to_pylist(), strict=True) if b is None} == set(range(2500))
    assert most["entries"] < 20 and most["act"] < 20, most

    kept, real = {}, shared.saved

    def saved(df, name, **given):
        out = real(df, name, **given)
        files = Path(out._saved_at.removeprefix("file:")).glob("*.parquet")
        kept[name] = given, {m.row_group(0).column(1).compression for m in map(pq.read_metadata, files) if m.num_row_groups}
        return out

    monkeypatch.setattr(batches, "saved", saved)
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for query in (substring_dedup.without_repeats, substring_dedup.removal_report):
        kept.clear()
        query(one)
        given, codecs = kept["substring-batches"]
        assert codecs == {"UNCOMPRESSED"} and given.get("parquet.page.size.row.check.min") == "1"


@pytest.mark.parametrize("query", [media.media_round_trip, lm.score_documents, simhash.near_duplicates, substring_dedup.removal_report, substring_dedup.without_repeats, simhash.deduplicated, mixing.mix, mixing.mixed_documents, licenses.scan, quality_rules.quality_metrics, quality_rules.keep_documents])
def test_empty_tables(none, query):
    assert query(none).count() == 0


def test_stages_on_odd_rows(odd, spark):
    """Each stage that returns documents on nulls, repeats and clashing columns."""
    labels = spark.createDataFrame([(k, k % 2, int(k % 9 == 0)) for k in range(3, 90)], "doc_id long, quality int, toxic int")
    clash = odd.withColumnsRenamed({"task": "__times", "fp": "mix_source", "h": "Mix_Cut", "size": "__gone", "bid": "simhash_doc"})
    for stage in (lambda x: toxicity.clean_documents(x, labels), simhash.deduplicated, substring_dedup.without_repeats, mixing.mixed_documents, quality_rules.keep_documents):
        out = stage(clash)
        assert out.columns == clash.columns and out.count() > 0
        assert stage(clash.limit(0)).count() == 0


def test_long_text(spark):
    """A text of 3 MB, longer than any slice, beside short ones."""
    rng = np.random.default_rng(14)
    long = " ".join(f"w{k}" for k in rng.integers(0, 1 << 40, 250_000)) + " under the mit license"
    assert len(long) > 3_000_000
    rows = [(0, long), (1, "a b c"), (2, long[1_000_000:1_000_400])]
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    by = lambda df: {r["doc_id"]: r for r in df.collect()}
    assert {d: r["n_tokens"] for d, r in by(lm.score_documents(docs)).items()} == {d: len(t.split()) + 1 for d, t in rows}
    assert by(licenses.scan(docs))[0]["first_word"] == 250_000
    assert by(quality_rules.quality_metrics(docs))[0]["word_chars"] == len(long.replace(" ", ""))
    assert {d: int(r["fingerprint"], 16) for d, r in by(simhash.near_duplicates(docs)).items()} == {d: brute.fingerprint(t) for d, t in rows}
    assert {d: r["n_removed"] for d, r in by(substring_dedup.removal_report(docs)).items()} == {0: 400, 1: 0, 2: 400}
    assert {d: r["size"] for d, r in by(mixing.mix(docs)).items()} == {d: len(t.split()) for d, t in rows}
    assert by(media.media_round_trip(docs))[0]["n_bytes"] == len(long)
    assert len(simhash.deduplicated(docs).collect()) == 3


def test_archives(spark, odd, tmp_path):
    folder = str(tmp_path / "archives")
    media.write_archives(odd, folder)
    options = {"rangeBytes": "4096", "batchBytes": "2048"}
    read = media.read_archives(spark, folder, **options)
    assert read.count() == odd.count() and read.where("error is not null or tries <> 1").isEmpty()
    tar = next(f"{folder}/{x}" for x in sorted(os.listdir(folder)) if x.endswith(".tar"))
    with open(tar, "r+b") as f:  # one member is spoilt; its neighbours stay readable
        f.seek(512 + 20)
        f.write(b"\xff\xff")
    read = media.read_archives(spark, folder, mode="permissive", **options)
    assert read.count() == odd.count()
    assert [(r["offset"], r["tries"]) for r in read.where("error is not null").collect()] == [(0, 3)]
    with pytest.raises(Exception, match="checksum|PNG"):
        media.read_archives(spark, folder, **options).count()


def test_png_is_read_by_its_own_rules():
    for n in (0, 1, 64, 1000):
        text = bytes(k * 7 % 256 for k in range(n))
        assert media.decode_png(media.encode_png(media.pad(text), n)) == (media.pad(text), n)


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = rng.integers(0, 300, (220, 2))
    hub = np.stack([np.full(200, 1000), np.arange(1001, 1201)], axis=1)
    chain = np.stack([np.arange(2000, 2100), np.arange(2001, 2101)], axis=1)
    edges = np.concatenate([edges, hub, chain])
    pairs = set(map(tuple, edges.tolist())) | {(b, a) for a, b in edges.tolist()}
    nodes = sorted({x for p in pairs for x in p})
    root = brute.roots(len(nodes), lambda a, b: (nodes[a], nodes[b]) in pairs)
    want = {n: nodes[r] for n, r in zip(nodes, root, strict=True) if nodes[r] != n}
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges.tolist(), "a long, b long")).collect() if r["node"] != r["root"]}
    assert out == want
    a, b = stars(edges[:, 0], edges[:, 1])
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_in_blocks(spark):
    """All pairs of a large bucket meet in some bucket of two blocks; small buckets stay."""
    rows = spark.createDataFrame([(7, k) for k in range(50)] + [(8, k) for k in range(5)], "bucket long, id long")
    out = simhash.in_blocks(rows, rows.select("bucket"), "id", 12).collect()
    by = {}
    for r in out:
        by.setdefault(r["bucket"], set()).add(r["id"])
    assert by.pop(8) == set(range(5))
    met = {(a, b) for ids in by.values() for a in ids for b in ids}
    assert len(met) == 2500 and max(map(len, by.values())) < 50


def test_large_groups(spark):
    """Thousands of near copies in buckets that are split and compared in blocks."""
    rng = np.random.default_rng(12)
    base = [f"w{k}" for k in rng.integers(0, 5000, 300)]
    rows = []
    for k in range(3000):
        text = list(base)
        text[int(rng.integers(300))] = f"v{k}"
        rows.append((k, " ".join(text)))
    rows += [(5000 + k, " ".join(f"u{x}" for x in rng.integers(0, 5000, 300))) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for out in (simhash.similar_documents(docs, block_rows=700), simhash.similar_documents(docs)):
        found = {r["doc_id"]: r["component_id"] for r in out.collect()}
        assert all(found[k] == 0 for k in range(3000)) and all(found[5000 + k] == 5000 + k for k in range(50))
    kept = simhash.deduplicated(docs, block_rows=700)
    assert kept.count() == 51 and kept.columns == docs.columns


def test_deduplicated_cases(spark):
    """Rows that share a doc_id, rows without one, clashing names and other case."""
    rng = np.random.default_rng(13)
    prose = lambda: " ".join(f"w{k}" for k in rng.integers(0, 5000, 60))
    a, b, c, d, e = (prose() for _ in range(5))
    rows = [(1, a), (1, b), (2, b), (3, a + " more"), (None, c), (None, c), (None, d), (4, d), (5, e), (5, e), (6, None), (7, ""), (None, None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, Simhash_Doc int, simhash_key string")
    out = simhash.deduplicated(docs)
    assert out.columns == docs.columns
    assert Counter((r[0], r[1]) for r in out.collect()) == Counter([(1, a), (1, b), (None, c), (4, d), (5, e), (6, None)])


def test_similar_documents(spark):
    rng = np.random.default_rng(4)
    words = np.array([f"w{k}" for k in range(3000)])
    rows, n = [], 40
    for k in range(n):
        base = rng.choice(words, 400)
        copy = base.copy()
        copy[rng.choice(400, 4, replace=False)] = "x"  # up to 20 of about 400 shingles change: similarity about 0.9
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    out = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(out[2 * k + 1] == 2 * k for k in range(n)) >= 0.95 * n
    assert all(out[2 * k] == 2 * k for k in range(n))


def test_recall_at_the_border(spark):
    """Of pairs whose exact similarity is 0.8 to 0.85 at least nine in ten are found."""
    rng = np.random.default_rng(21)
    shingles = lambda ws: {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)}
    rows, border = [], []
    while len(border) < 150:
        base = [f"w{x}" for x in rng.integers(0, 20000, int(rng.integers(60, 400)))]
        copy = list(base)
        for _ in range(int(rng.integers(1, 12))):
            copy[int(rng.integers(len(copy)))] = f"v{rng.integers(1 << 30)}"
        a, b = shingles(base), shingles(copy)
        if 0.8 <= len(a & b) / len(a | b) < 0.85:
            border.append(len(rows))
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    out = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert np.mean([out[k] == out[k + 1] for k in border]) >= 0.9


def test_wide_links_of_large_buckets():
    """A member that links to the first one is still held against the rest, in buckets of any size."""
    rng = np.random.default_rng(6)
    bits = np.zeros((400, 512), np.uint8)
    for k in range(1, 100):  # variants of the first member
        bits[k, rng.choice(512, 80, replace=False)] = 1
    bits[100] = bits[7]
    bits[100, np.flatnonzero(bits[7] == 0)[:90]] = 1  # near the variant 7 only
    for k in range(101, 250):  # each within the radius of an earlier one
        bits[k] = bits[rng.integers(100, k)]
        bits[k, rng.choice(512, 70, replace=False)] ^= 1
    bits[250:] = rng.integers(0, 2, (150, 512))
    far = (bits[:, None] != bits[None]).sum(axis=2)
    assert far[0, 100] > 93 >= far[7, 100]
    fp = pa.array([np.packbits(x, bitorder="little").tobytes() for x in bits], pa.binary())
    ids = np.arange(400)
    batch = pa.RecordBatch.from_arrays([pa.array(np.full(400, 9)), pa.array(ids), fp], ["bucket", "id", "fp"])
    found = {x: y for out in simhash._wide_links(8, 93)(iter([batch])) for x, y in zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True)}
    want = brute.roots(400, lambda a, b: far[a, b] <= 93)
    assert found == {k: r for k, r in enumerate(want) if r != k}


def test_similar_sets(spark):
    """Short texts against brute force over all pairs; repetitions of shingles don't count."""
    rng = np.random.default_rng(7)
    words = [f"w{k}" for k in range(5000)]
    texts = ["", "one"]
    for _ in range(60):
        base = rng.choice(words, rng.integers(5, 25)).tolist()
        texts += [" ".join(x) for x in (base, [*base, "more"], [*base, "a", "b"], ["x", *base[1:]], [*base[:-1], "y"], ["at", *base, "end"])]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for t in texts]
    short = [k for k in range(len(texts)) if len(sets[k]) <= 20]
    texts, sets = [texts[k] for k in short], [sets[k] for k in short]
    line = " ".join(rng.choice(words, 30))
    rest = " ".join(rng.choice(words, 40))
    n = len(texts)
    texts += [f"{line} " * 2 + rest, f"{line} " * 40 + rest]  # the same set of shingles
    out = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [out[k] for k in range(n)] == brute.roots(n, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert out[n + 1] == n
