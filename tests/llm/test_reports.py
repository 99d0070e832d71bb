"""The digests of the operators against plain versions, on odd rows and on the smallest tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import licenses, lm, media, mixing, quality_rules, simhash, substring_dedup
from tests.llm import brute


def got(df):
    return Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.fixture(params=["odd", "small"])
def case(request, odd, odd_rows, small, small_rows):
    return (odd, [r[:2] for r in odd_rows]) if request.param == "odd" else (small, small_rows)


def test_media(case):
    docs, rows = case
    out = media.media_round_trip(docs).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    want = Counter()
    for d, t in rows:
        raw = (t or "").encode()
        padded = media.pad(raw)
        assert len(padded) % 64 == 0 and padded.rstrip(b"\0") == raw.rstrip(b"\0") and len(padded) >= 64
        want[d, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])] += 1
    assert got(out) == want


def test_lm_base(case):
    docs, rows = case
    out = lm.score_documents(docs)
    want = Counter((d, d is not None and brute.crc(d) % 10 == 0, *b[:3]) for (d, _), b in zip(rows, brute.base_scores(rows), strict=True))
    assert got(out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")) == want
    base = sorted(r[0] for r in out.select("base_score").collect())
    assert np.allclose(base, sorted(b[3] for b in brute.base_scores(rows)), rtol=1e-9)
    assert all(r[0] < 0 for r in out.select("score").collect())


def test_simhash(case):
    docs, rows = case
    fps = [brute.fingerprint(t) for _, t in rows]
    root = brute.roots(len(rows), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    low = defaultdict(list)
    for k, r in enumerate(root):
        low[r].append(rows[k][0])
    name = {r: min((d for d in ids if d is not None), default=None) for r, ids in low.items()}
    want = Counter((d, f"{f:016x}", name[r]) for (d, _), f, r in zip(rows, fps, root, strict=True))
    assert got(simhash.near_duplicates(docs)) == want
    assert got(simhash.near_duplicates(docs, bucket_rows=3)) == want


@pytest.mark.parametrize("hot", [16384, 1])
def test_substrings(case, hot, monkeypatch):
    docs, rows = case
    texts = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (d, _), text, gone in zip(rows, texts, brute.removed(texts, 200), strict=True):
        kept = bytes(c for k, c in enumerate(text) if k not in gone)
        want[d, len(text), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(kept).hexdigest()] += 1
    spans = substring_dedup.repeated_spans
    monkeypatch.setattr(substring_dedup, "repeated_spans", lambda b, length: spans(b, length, hot=hot))
    assert got(substring_dedup.removal_report(docs)) == want


def test_substrings_keep_rows(odd, odd_rows):
    out = substring_dedup.without_repeats(odd)
    assert out.columns == odd.columns
    texts = [(r[1] or "").encode() for r in odd_rows]
    want = Counter()
    for r, text, gone in zip(odd_rows, texts, brute.removed(texts, 200), strict=True):
        kept = bytes(c for k, c in enumerate(text) if k not in gone).decode("utf-8", "ignore")
        want[r[0], None if r[1] is None else kept, r[3], None if r[1] is None else len(kept)] += 1
    assert got(out.select("doc_id", "text", "source", "n_chars")) == want


def test_mixing(odd, odd_rows, small):
    for docs in (odd, small):
        rows = [(r["doc_id"], len(brute.WORD.findall(r["text"] or "")), r["source"]) for r in docs.collect()]
        by = Counter()
        for _, n, s in rows:
            by[s] += n
        target, taken = brute.targets(by), Counter()
        out = mixing.mix(docs).collect()
        assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in out) == Counter((d, n, by[s]) for d, n, s in rows)
        assert sorted(round(r["target"], 6) for r in out) == sorted(round(target[s], 6) for _, _, s in rows)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in out)
        for r in out:
            taken[round(r["target"], 6), r["source_size"]] += r["taken"]
        for s, t in target.items():
            assert abs(taken[round(t, 6), by[s]] - t) <= 3, (s, t)
        assert got(mixing.mix(docs.repartition(5))) == got(mixing.mix(docs))


def test_mixed_rows(odd, odd_rows):
    words = lambda df: sum(len(brute.WORD.findall(r["text"] or "")) for r in df.collect())
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    assert words(out) == sum(r["taken"] for r in mixing.mix(odd).collect())


def test_licenses(case):
    docs, rows = case
    out = licenses.scan(docs)
    assert got(out) == Counter((d, *brute.licenses(t), brute.labels(t)[0], round(brute.labels(t)[1], 6)) for d, t in rows)


def test_license_spans(spark):
    """Whole texts, edited and shuffled ones; a phrase over and over is no license."""
    mit = licenses.TEXTS[0][1]
    words = mit.split()
    texts = ["free of charge " * 40, "under the mit " * 3, mit, mit.upper() + " tail", " ".join(words[:60] + ["inserted", "words"] + words[60:]), " ".join(words[:100]), " ".join(words[90:] + words[:90])]
    texts += [t for _, t in licenses.TEXTS[3:]] + [t for _, t in licenses.LINES]
    out = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(out[k]["labels"], round(out[k]["score"], 9)) for k in range(len(texts))] == [(x, round(y, 9)) for x, y in map(brute.labels, texts)]
    assert [out[k]["labels"] for k in range(7)] == ["", "", "mit", "mit", "mit", "", ""]
    assert out[0]["score"] < 0.1 and out[2]["score"] == 1.0 and 0.9 < out[4]["score"] < 1


def test_quality_rules(case):
    docs, rows = case
    out = quality_rules.quality_metrics(docs)
    assert got(out.drop("kept")) == Counter((d, *brute.quality(t)) for d, t in rows)
    assert not any(r["kept"] and r["base_failed"] for r in out.collect())
    kept = quality_rules.keep_documents(docs)
    assert kept.columns == docs.columns and kept.count() == out.where("kept").count()
    assert got(quality_rules.quality_metrics(docs, rules=quality_rules.RULES[::-1])) == got(out)


def test_cascade_is_short_circuited():
    """A rule sees only the rows that earlier ones kept, and measures only those."""
    seen, measured = Counter(), Counter()

    def rule(name, rejects):
        def counted(t):
            seen[name] += len(t.column)
            return rejects(t)

        return quality_rules.Rule(name, counted)

    column = pa.array(["few words"] * 30 + ["word " * 5 * k + "# " * 40 for k in range(10, 20)] + [" ".join(f"w{k}" for k in range(50))] * 5)
    order = (rule("few", lambda t: t.n_words < 20), rule("symbols", lambda t: 10 * t.n_symbols > t.n_words), rule("upper", lambda t: 10 * t.n_upper > 4 * t.n_letters))
    count = quality_rules.Texts.count

    def counting(self, table):
        measured[id(table)] += len(self.column)
        return count(self, table)

    quality_rules.Texts.count = counting
    try:
        kept = quality_rules.cascade(quality_rules.Texts(column), order)
        assert seen == {"few": 45, "symbols": 15, "upper": 5} and kept.sum() == 5
        assert sorted(measured.values()) == [5, 5, 15]
        seen.clear()
        assert not quality_rules.cascade(quality_rules.Texts(column), order, np.arange(45) < 30).any()
        assert seen == {"few": 30}
    finally:
        quality_rules.Texts.count = count


def test_cascade_sample(small):
    order = quality_rules.plan_cascade(small, sample_rows=50)
    assert sorted(r.name for r in order) == sorted(r.name for r in quality_rules.RULES)
    assert len(quality_rules.plan_cascade(small.limit(0))) == len(quality_rules.RULES)
