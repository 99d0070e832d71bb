"""Quality rules as a short-circuit cascade.

Each rule rejects documents by one test on the text.  The cost and the share of
rejections of every rule are measured on a sample; the cascade then runs rules
by rejections per cost and evaluates each only on the rows that the earlier ones
kept: once a row is out, no further measure of it is taken.  The sample is drawn
by seed from all rows.  The verdict does not depend on the order, only the work
does; between rules of equal worth the order is that of the list.

Defined cases: null or empty text has no words and fails ``few_words``; repeated
rows get equal verdicts; a null doc_id stays null; a long text is measured whole,
within a few times its own size of memory; an empty table gives an empty result;
other columns, whatever their names, are not read by ``quality_metrics`` and are
kept by ``keep_documents``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm import textkit as tk

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True
_ALPHA = _LETTER.copy()
_ALPHA[0x80:] = True
METRICS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


class Texts:
    """A slice of texts whose measures are computed when a rule first asks for them."""

    def __init__(self, column: pa.Array, known: dict[str, np.ndarray] | None = None):
        self.column, self._kept = column, known or {}

    def __getattr__(self, name: str) -> np.ndarray:
        if name in ("data", "offs"):
            self.data, self.offs = tk.flat(self.column)
            return self.__dict__[name]
        if name in ("starts", "ends", "firsts"):
            self.starts, self.ends, self.firsts = tk.words(self.data, self.offs, tk.SPACE_WORDS)
            return self.__dict__[name]
        if name.startswith("_") or not hasattr(type(self), "get_" + name):
            raise AttributeError(name)
        if name not in self._kept:
            self._kept[name] = getattr(self, "get_" + name)()
        return self._kept[name]

    def narrowed(self, rows: np.ndarray) -> Texts:
        """Only these rows; what is known of them already is not measured again."""
        return Texts(self.column.take(pa.array(rows)), {n: x[rows] for n, x in self._kept.items()})

    def get_n_words(self) -> np.ndarray:
        return np.diff(self.firsts)

    def count(self, table: np.ndarray) -> np.ndarray:
        return tk.per_doc(table[self.data[: self.offs[-1]]], self.offs)

    def get_word_chars(self) -> np.ndarray:
        return self.count(_LEAD & tk.SPACE_WORDS)

    def get_n_symbols(self) -> np.ndarray:
        return self.count(_SYMBOL)

    def get_n_upper(self) -> np.ndarray:
        return self.count(_UPPER)

    def get_n_letters(self) -> np.ndarray:
        return self.count(_LETTER)

    def get_n_alpha_words(self) -> np.ndarray:
        seen = np.zeros(self.offs[-1] + 1, np.int32)
        np.cumsum(_ALPHA[self.data[: self.offs[-1]]], out=seen[1:])
        return tk.per_doc(seen[self.ends] > seen[self.starts], self.firsts)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each line that holds a word."""
        n = int(self.offs[-1])
        stops = np.flatnonzero(self.data[:n] == 10)
        starts = np.unique(np.concatenate([self.offs[:-1], stops + 1]))
        starts = starts[starts < n]
        ends = np.minimum(np.append(starts[1:], n), n)
        owner = np.searchsorted(self.offs, starts, "right") - 1
        stopped = (ends > 0) & (self.data[np.maximum(ends - 1, 0)] == 10)
        ends = ends - stopped
        full = np.searchsorted(self.starts, ends) > np.searchsorted(self.starts, starts)
        return starts[full], ends[full], owner[full]

    def get_n_lines(self) -> np.ndarray:
        return np.bincount(self.lines()[2], minlength=self.offs.size - 1)

    def get_n_dup_lines(self) -> np.ndarray:
        starts, ends, owner = self.lines()
        keys = tk.mix(tk.Rolling(self.data, int(self.offs[-1])).ranges(starts, ends) + tk._M2 * owner.astype(tk.U))
        _, first = np.unique(keys, return_index=True)
        n = self.offs.size - 1
        return np.bincount(owner, minlength=n) - np.bincount(owner[first], minlength=n)

    def get_n_repeat_words(self) -> np.ndarray:
        g, at = tk.grams(tk.word_hashes(self.data, self.starts, self.ends), self.firsts, 8)
        owner = np.searchsorted(self.firsts, at, "right") - 1
        again = at[tk.repeated(tk.mix(g + tk._M2 * owner.astype(tk.U)))]
        cover = np.zeros(self.starts.size + 9, np.int64)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + 8, -1)
        return tk.per_doc(np.cumsum(cover)[: self.starts.size] > 0, self.firsts)


@dataclass(frozen=True)
class Rule:
    """``rejects`` gives True for each text of a slice that fails the rule."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


BASE = (
    Rule("few_words", lambda t: t.n_words < 20),
    Rule("repeats", lambda t: 100 * t.n_repeat_words > 30 * t.n_words),
)
RULES = (
    *BASE,
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("word_length", lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 15 * t.n_words)),
    Rule("dup_lines", lambda t: 10 * t.n_dup_lines > 3 * t.n_lines),
    Rule("alpha_words", lambda t: 10 * t.n_alpha_words < 7 * t.n_words),
    Rule("shouting", lambda t: 10 * t.n_upper > 4 * t.n_letters),
)


def _measure(rules: tuple[Rule, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, out, seen = np.zeros(len(rules)), np.zeros(len(rules), np.int64), 0
        for batch in batches:
            for part in tk.text_slices(batch):
                seen += part.num_rows
                for k, rule in enumerate(rules):
                    texts = Texts(part.column("text"))
                    began = time.perf_counter()
                    out[k] += int(rule.rejects(texts).sum())
                    cost[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"k": list(range(len(rules))), "cost": cost.tolist(), "out": out.tolist(), "seen": [seen] * len(rules)})

    return run


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 512, seed: int = 11) -> tuple[Rule, ...]:
    """Order rules by rejections per second, measured on about ``sample_rows`` rows drawn from all."""
    texts = docs.select("text")
    rows = texts.count()
    sample = texts.sample(False, min(1.0, sample_rows / max(rows, 1)), seed)
    got = sample.mapInArrow(tk.tidy(_measure(rules)), "k long, cost double, out long, seen long").groupBy("k").sum("cost", "out").collect()
    worth = {r[0]: (r[2] + 0.5) / (r[1] + 1e-6) for r in got}
    return tuple(rules[k] for k in sorted(range(len(rules)), key=lambda k: (-worth.get(k, 0.0), k)))


def cascade(texts: Texts, order: tuple[Rule, ...], start: np.ndarray | None = None) -> np.ndarray:
    """Which texts all rules keep, of those that ``start`` marks; each rule sees only the rows that the earlier ones kept."""
    alive = np.arange(len(texts.column)) if start is None else np.flatnonzero(start)
    kept = np.zeros(len(texts.column), bool)
    if alive.size < kept.size:
        texts = texts.narrowed(alive)
    for rule in order:
        if not alive.size:
            break
        good = ~rule.rejects(texts)
        if not good.all():
            alive, texts = alive[good], texts.narrowed(np.flatnonzero(good))
    kept[alive] = True
    return kept


def keep_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 512) -> DataFrame:
    """The rows that pass every rule, with all their columns."""
    order = plan_cascade(docs, rules, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.text_slices(batch):
                yield part.filter(pa.array(cascade(Texts(part.column("text")), order)))

    return docs.mapInArrow(tk.tidy(run), docs.schema)


def quality_metrics(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 512) -> DataFrame:
    """Base measures of every document and the cascade's verdict.

    The base measures are wanted for every row; the cascade takes its further
    ones only of rows that are still in, and takes none of them twice.
    """
    order = plan_cascade(docs, rules, sample_rows)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.text_slices(batch):
                texts = Texts(part.column("text"))
                out = {n: getattr(texts, n) for n in names}
                failed = np.zeros(part.num_rows, bool)
                for rule in BASE:
                    failed |= rule.rejects(texts)
                kept = cascade(texts, order, ~failed)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(out[n].astype(np.int64)) for n in names), pa.array(failed), pa.array(kept)],
                    ["doc_id", *names, "base_failed", "kept"],
                )

    return docs.select("doc_id", "text").mapInArrow(tk.tidy(run), METRICS)
