"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND, then overlap checks.

The index holds one block of items at a time (ITEMS_PER_INDEX, so its size is bounded) and every document is read
against each. A document is cut into passages twice as long as the longest item, at half that step, so every item
that it holds lies whole in one. A passage is a query. Terms' greatest impacts bound its score, then greatest impacts
per block of items, and what may still reach the threshold is scored by the postings. Impacts are divided by the
item's own score, so one threshold serves all items.

A retrieved item counts as a leak if the passage holds enough of its question's and of its answer's word 5-grams, or
some of the answer's and enough of all.
The answer is the part after the last question mark or, without one, the last quarter of the words; a part of fewer
than five words takes in neighbours of the other part.

Defined cases: a null or empty text, or one of punctuation only, on either side, has no leaks; items shorter than five
words are compared by their whole word sequence, wherever it stands in a passage; repeated items and documents give their rows once per item_id and document row; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

ITEMS_PER_INDEX = 1024
ITEMS_PER_BLOCK = 4
K1, B = 1.2, 0.75
THRESHOLD = 0.5  # of the item's own BM25 score
SHINGLE = 5
QUESTION, ANSWER = 0.8, 0.5  # least shares of 5-grams found in the passage; the whole item may reach QUESTION instead
LEAK = "doc_id bigint, item_id bigint, passage bigint, score double, question_overlap double, answer_overlap double"


def words(text: str | None) -> list[str]:
    return [w.strip(".,;:!?\"'()[]") for w in (text or "").lower().split()]


def grams(tokens: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(tokens[i: i + n]) for i in range(max(len(tokens) - n + 1, 1))} if tokens else set()


def question_and_answer(text: str) -> tuple[set, set]:
    """5-grams of both parts, which reach into the other part where one is shorter; a shorter item is one gram, twice."""
    head, mark, tail = text.rpartition("?")
    tokens = words(text)
    cut = len(words(head + mark)) if mark and tail.strip() else len(tokens) - max(1, len(tokens) // 4)
    return grams(tokens[:max(cut, SHINGLE)]), grams(tokens[max(0, min(cut, len(tokens) - SHINGLE)):])


def _sums(parts: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """Values added up by their keys."""
    if not parts:
        return np.zeros(size)
    return np.bincount(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), size)


@dataclass
class Index:
    item_ids: list[int]
    terms: dict[str, int]
    bound: np.ndarray  # greatest impact per term; the last entry, for unknown words, is 0
    block_bounds: np.ndarray  # terms x blocks of items: greatest impacts
    postings: list[tuple[np.ndarray, np.ndarray]]  # per term: items and impacts
    parts: list[tuple[set, set]]
    width: int

    @staticmethod
    def of(items: list[tuple[int, str]]) -> Index:
        items = sorted(((i, t) for i, t in items if any(words(t))), key=lambda x: (len(words(x[1])), x[0]))  # blocks of like lengths
        counts = [Counter(words(t)) for _, t in items]
        lens = np.array([sum(c.values()) for c in counts], float)
        df = Counter(w for c in counts for w in c)
        terms = {w: i for i, w in enumerate(sorted(df))}
        idf = {w: np.log(1 + (len(items) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
        found: list[list[tuple[int, float]]] = [[] for _ in terms]
        for at, (count, size) in enumerate(zip(counts, lens, strict=True)):
            own = {w: idf[w] * f * (K1 + 1) / (f + K1 * (1 - B + B * size / lens.mean())) for w, f in count.items()}
            whole = sum(own.values())
            for w, v in own.items():
                found[terms[w]].append((at, v / whole))
        postings = [(np.array([i for i, _ in f]), np.array([v for _, v in f])) for f in found]
        blocks = np.zeros((len(terms), -(-len(items) // ITEMS_PER_BLOCK)), np.float32)
        for term, (at, value) in enumerate(postings):
            np.maximum.at(blocks[term], at // ITEMS_PER_BLOCK, value * (1 + 1e-6))  # rounding must not lower a bound
        return Index([i for i, _ in items], terms, np.array([*(v.max() for _, v in postings), 0.0]), blocks, postings,
                     [question_and_answer(t) for _, t in items], int(2 * max(lens, default=1)))

    def search(self, ids: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
        """(passage start, item, score) of every item that reaches the threshold in a passage of known or unknown terms."""
        step = max(1, self.width // 2)
        starts = np.arange(0, max(1, len(ids) - step), step)
        sums = np.concatenate(([0.0], np.cumsum(self.bound[ids])))
        likely = starts[sums[np.minimum(starts + self.width, len(ids))] - sums[starts] >= threshold]
        out, n = [], len(self.item_ids)
        for start in likely.tolist():
            own = np.unique(ids[start: start + self.width])
            own = own[own < len(self.terms)]
            if self.bound[own].sum() < threshold:
                continue
            open_blocks = self.block_bounds[own].sum(0) >= threshold
            if not open_blocks.any():
                continue
            scores = _sums([self.postings[t] for t in own], n)
            hits = np.flatnonzero((scores >= threshold) & open_blocks[np.arange(n) // ITEMS_PER_BLOCK])
            out += [(start, int(i), float(scores[i])) for i in hits]
        return out


def leaks_of(index: Index, text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, int, float, float, float]]:
    """item_id, passage start (in words), score and both overlaps of every verified leak; the best passage per item."""
    tokens = words(text)
    if not tokens or not index.item_ids:
        return []
    find, unknown = index.terms.get, len(index.terms)
    ids = np.array([find(w, unknown) for w in tokens])
    best: dict[int, tuple] = {}
    passages: dict[tuple[int, int], set] = {}
    for start, item, score in index.search(ids, threshold):
        both = index.parts[item][0] | index.parts[item][1]
        at = start, len(next(iter(both)))  # fewer than SHINGLE words in shorter items
        if at not in passages:
            passages[at] = grams(tokens[start: start + index.width], at[1])
        asked, answered = (len(p & passages[at]) / len(p) for p in index.parts[item])
        if answered and (asked >= QUESTION and answered >= ANSWER or len(both & passages[at]) >= QUESTION * len(both)):
            best[item] = max(best.get(item, ()), (score, -start, asked, answered))
    return [(index.item_ids[i], -b[1], b[0], b[2], b[3]) for i, b in sorted(best.items())]


def item_blocks(benchmark: DataFrame, size: int = ITEMS_PER_INDEX) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, read one after the other."""
    items = benchmark.filter("item_id is not null and text is not null").groupBy(F.col("item_id").cast("bigint").alias("item_id")).agg(F.min("text").alias("text"))
    blocks = max(1, -(-items.count() // size))
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        yield [(r["item_id"], r["text"]) for r in rows]


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each item that a document holds."""
    small_batches(docs.sparkSession)
    found = None
    for items in item_blocks(benchmark):
        index = Index.of(items)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d, *leak) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for leak in leaks_of(index, t, threshold)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in LEAK.split(", ")])

        part = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, LEAK)
        found = part if found is None else found.union(part)
    return found


def _leaky(index: Index, threshold: float):
    @F.pandas_udf("boolean")
    def leaky(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(leaks_of(index, t, threshold)) for t in texts], dtype=bool)

    return leaky


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that hold no item, with all their columns."""
    small_batches(docs.sparkSession)
    clean = docs
    for items in item_blocks(benchmark):
        clean = clean.filter(~_leaky(Index.of(items), threshold)("text"))
    return clean
