"""Plain versions of the operators, one document or pair at a time."""

import re
import zlib
from collections import Counter
from math import log10

import xxhash

from sparkloom.llm.licenses import TEMPLATES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def lower(text):
    return (text or "").translate(LOWER)


def crc(doc_id):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode())


def fingerprint(text, size=4):
    words = WORD.findall(lower(text))
    shingles = [words[k : k + size] for k in range(len(words) - size + 1)] if len(words) >= size else [words] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, linked):
    """Smallest index reachable from each of n nodes."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def removed(texts, length):
    """For each text the set of removed byte positions."""
    starts = {}
    for d, text in enumerate(texts):
        for p in range(len(text) - length + 1):
            starts.setdefault(text[p : p + length], []).append((d, p))
    out = [set() for _ in texts]
    for places in starts.values():
        if len(places) > 1:
            for d, p in places:
                out[d].update(range(p, p + length))
    return out


def base_scores(rows):
    """(doc_id, text) -> n_tokens, n_known, train_tokens, base_score."""
    tokens = [[*WORD.findall(lower(t)), None] for _, t in rows]
    train = Counter(w for (d, _), ws in zip(rows, tokens, strict=True) if d is None or crc(d) % 10 for w in ws)
    n, v = sum(train.values()), len(train)
    return [(len(ws), sum(train[w] > 0 for w in ws), n, sum(log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for ws in tokens]


def targets(sizes, epochs=3):
    """Water-filling, round by round: {source: target}."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    left, held = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in held]
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > epochs * sizes[s]]
        if not over:
            return held | {s: left * weight[s] / total for s in free}
        for s in over:
            held[s] = float(epochs * sizes[s])
        left = sum(sizes.values()) - sum(held.values())


PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def licenses(text):
    words = ALNUM.findall(lower(text))
    found = [(k, label) for label, phrase in PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    places = [k for k, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def labels(text, share=0.7, shift=4):
    """Labels and score by comparing words: matches of three words, by diagonal, and the longest rising chain of each span."""
    words = ALNUM.findall(lower(text))
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    found, best = set(licenses(text)[4].split(",")) - {""}, 1.0 if licenses(text)[1] else 0.0
    for label, template in TEMPLATES:
        own = ALNUM.findall(lower(template))
        hits = [(i - j, i, j) for j in range(len(own) - 2) for i in places.get(tuple(own[j : j + 3]), ())]
        spans, last = [], None
        for d, i, j in sorted(hits):
            if last is None or d - last > shift:
                spans.append([])
            spans[-1].append((i, j))
            last = d
        for span in spans:
            chain = {}
            for i, j in sorted(span):
                chain[i, j] = 1 + max((n for (a, b), n in chain.items() if a < i and b < j), default=0)
            n, whole = max(chain.values()), len(own) - 2
            best = max(best, n / whole)
            if n >= (whole if whole < 10 else share * whole):
                found.add(label)
    return ",".join(sorted(found)), best


def quality(text):
    text = text or ""
    words, lines, seen = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)], Counter()
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    seen.update(windows)
    cover = {k + i for k, w in enumerate(windows) if seen[w] > 1 for i in range(8)}
    failed = len(words) < 20 or 100 * len(cover) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover), failed
