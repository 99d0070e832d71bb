"""The pipeline's stages one after the other, each against a plain version on what its predecessor kept."""

from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm import mixing, simhash, toxicity
from sparkloom.llm.queries import tokenizer_path
from sparkloom.llm.shared import saved
from tests.llm import brute
from tests.llm.conftest import SF


def shingles(text):
    words = brute.WORD.findall(brute.lower(text))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_stages(spark, small):
    docs, kept = small, []
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF), f"test-{name}")
        kept.append(docs)
    toxic, near, cut, mixed, packed = kept
    assert all(x.columns == small.columns for x in kept[:-1])

    scored = toxicity.score_documents(small, spark.read.parquet(f"{SF}/labels.parquet"))
    assert Counter(r[0] for r in toxic.select("doc_id").collect()) == Counter(r[0] for r in scored.where("predicted = 0").select("doc_id").collect())

    before = {r["doc_id"]: shingles(r["text"]) for r in toxic.collect()}
    after = {r["doc_id"] for r in near.collect()}
    like = lambda a, b: len(before[a] & before[b]) >= 0.8 * len(before[a] | before[b])
    ids = sorted(before)
    for b, own in enumerate(brute.roots(len(ids), lambda a, b: like(ids[a], ids[b]))):
        assert own == b or ids[b] not in after
    classes = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(toxic).collect()}
    assert after == {d for d, c in classes.items() if d == c}

    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in near.collect()]
    want = Counter((d, bytes(c for k, c in enumerate(t) if k not in gone).decode("utf-8", "ignore")) for (d, t), gone in zip(rows, brute.removed([t for _, t in rows], 200), strict=True))
    assert Counter((r["doc_id"], r["text"] or "") for r in cut.collect()) == want

    words = lambda df: sum(len(brute.WORD.findall(r["text"] or "")) for r in df.collect())
    assert words(mixed) == sum(r["taken"] for r in mixing.mix(cut).collect())

    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    tokens = sum(len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in mixed.collect())
    pieces = packed.collect()
    assert sum(p["length"] for p in pieces) == tokens
    assert len({p["sequence_id"] for p in pieces}) <= -(-tokens // 2048) + 1
