"""Exact token counts at every prefix of a text, by dynamic programming, for byte-level BPE files (.json).

The last token of an encoded byte string is the one vocabulary token that ends it, encodes to itself, and does not
merge with the last token of what stands before it. So the count at a prefix is one more than that at an earlier
prefix, and one pass over a word gives the counts at all its prefixes. Word counts are laid end to end for a document;
the stored array answers how many tokens any prefix has, and which prefix fits a budget, without encoding again.

The counts are those of the tokenizers library for each prefix as a text of its own: special strings are one token once
they are complete, white space at the end is one word, and a half contraction ('r of 're) is two words.

Defined cases: a null or empty text has the one count 0; rows with a null or repeated doc_id are counted like any other;
an empty table gives an empty result; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
import json
import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

TABLE_CHARS = 8_000_000  # characters of the distinct words a task remembers; beyond them it starts afresh
PAIRS = 1_000_000  # pairs of tokens a task remembers; then likewise
SLICE_CHARS = 500_000  # of a long text taken at once; a slice ends between words
OUTPUT_CHARS = 2_000_000  # of the texts returned together, one text at least
COUNTED = "doc_id bigint, text_bytes bigint, counts array<int>"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file: itself if printable, else the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class PrefixCounter:
    """Counts at all prefixes of words and texts, by one vocabulary file."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError(f"{path} is no plain byte-level BPE file")
        letters = byte_letters()
        as_bytes = lambda token: bytes(map(letters.__getitem__, token))
        self.ids = {as_bytes(token): i for token, i in model["vocab"].items()}
        self.parts: dict[int, tuple[int, int]] = {}  # of a merged token
        self.rank: dict[int, int] = dict.fromkeys(self.ids.values(), -1)  # of the merge that makes a token
        self.merges: dict[tuple[int, int], int] = {}
        for n, merge in enumerate(model["merges"]):
            a, b = map(as_bytes, merge if isinstance(merge, list) else merge.split(" "))
            pair, made = (self.ids[a], self.ids[b]), self.ids[a + b]
            self.parts[made], self.rank[made], self.merges[pair] = pair, n, n
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]) or any(a != b and a in b for a in special for b in special):
            raise ValueError(f"special tokens of {path} are of a kind that is not supported")
        self.special = regex.compile("|".join(map(regex.escape, special)) or "(?!)")
        self.path, self.library = path, None
        self.pattern, self.gap, self.double = regex.compile(pattern), regex.compile(r"\S(?=\s)"), regex.compile(r"\s\s")
        self.blank = set(regex.findall(r"\s", "".join(map(chr, range(0x3001)))))
        self.settled: set[str] = set()  # characters whose class is the same in every Unicode version since they came
        self.alone: dict[int, bool] = {}
        self.apart: dict[int, bool] = {}
        self.endings = ahocorasick.Automaton()
        for token, i in self.ids.items():
            if self.stands(i):
                self.endings.add_word(token.decode("latin-1"), (i, len(token)))
        self.endings.make_automaton()
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.kept = np.zeros((3, 1 << 12), np.int64)  # of each word: where its counts start, its length, its tokens
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0

    def stay_apart(self, left: int, right: int, before: float = math.inf) -> bool:
        """Whether no merge of a rank below `before` crosses the border between two tokens. Their own merges are undone from the last one on."""
        strict = True
        while True:
            across = self.merges.get((left, right))
            if across is not None and (across < before or (across == before and not strict)):
                return False
            a, b = self.rank[left], self.rank[right]
            if a == b == -1:
                return True
            strict = a > b  # of equal merges the leftmost comes first
            if strict:
                before, left = a, self.parts[left][1]
            else:
                before, right = b, self.parts[right][0]

    def stands(self, token: int) -> bool:
        """Whether a token's bytes encode to that token."""
        if token not in self.alone:
            self.alone[token] = token not in self.parts or (
                all(map(self.stands, self.parts[token])) and self.stay_apart(*self.parts[token], before=self.rank[token]))
        return self.alone[token]

    def byte_counts(self, word: bytes) -> list[int]:
        """Tokens of word[:i] for i from 1 on."""
        last: list[int] = []
        counts: list[int] = []
        apart, done = self.apart, 0
        for end, (token, size) in self.endings.iter(word.decode("latin-1")):  # the longest that ends there comes first
            if end < done:
                continue
            start = end - size
            if start < 0:
                last.append(token)
                counts.append(1)
                done += 1
                continue
            pair = last[start] << 32 | token
            fits = apart.get(pair)
            if fits is None:
                fits = apart[pair] = self.stay_apart(last[start], token)
            if fits:
                last.append(token)
                counts.append(counts[start] + 1)
                done += 1
        return counts

    def word_counts(self, word: str) -> list[int]:
        """Tokens of each prefix of one word of the pattern, by code points."""
        raw = word.encode()
        counts = self.byte_counts(raw)
        if len(raw) != len(word):
            ends = np.frombuffer(raw, np.uint8) & 0xC0 != 0x80
            counts = np.array(counts)[np.append(np.flatnonzero(ends)[1:], len(raw)) - 1].tolist()
        if len(word) == 3 and word[0] == "'" and word[1:].isalpha():  # 're, 've, 'll: cut short they are two words
            counts[1] = 2
        return counts

    def learn(self, words: list[str]) -> None:
        found = [self.word_counts(word) for word in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        first, more, most = len(self.index), int(sizes.sum()), self.used
        while first + len(found) > self.kept.shape[1]:
            self.kept = np.concatenate((self.kept, np.zeros_like(self.kept)), axis=1)
        while most + more > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.kept[:, first:first + len(found)] = most + np.cumsum(sizes) - sizes, sizes, [c[-1] for c in found]
        self.flat[most:most + more] = np.fromiter(itertools.chain.from_iterable(found), np.int32, more)
        self.index.update(zip(words, range(first, first + len(found)), strict=True))
        self.used += more

    def words(self, text: str) -> list[str]:
        """The words of the pattern. The library itself cuts a text with characters that are newer than this Python's Unicode tables."""
        if not text.isascii() and not self.settled.issuperset(text):
            new = set(text) - self.settled
            self.settled.update(c for c in new if unicodedata.category(c) != "Cn")
            if not self.settled >= new:
                if self.library is None:
                    from tokenizers import Tokenizer

                    self.library = Tokenizer.from_file(self.path).pre_tokenizer
                return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def of_slice(self, text: str) -> np.ndarray:
        """Counts at the prefixes of a text without special strings, from the first character on."""
        words, spaces = self.words(text), []
        if self.double.search(text):
            spaces = [(i, a + b[0]) for i, (a, b) in enumerate(itertools.pairwise(words), 1) if a[-1] in self.blank and b[0] in self.blank]
        if new := [w for w in {*words, *(run for _, run in spaces)} if w not in self.index]:
            self.learn(new)
        start, size, total = self.kept
        ids = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        sizes, totals = size[ids], total[ids]
        before, at = np.cumsum(totals) - totals, np.cumsum(sizes) - sizes
        counts = self.flat[np.repeat(start[ids] - at, sizes) + np.arange(len(text))] + np.repeat(before, sizes).astype(np.int32)
        for i, run in spaces:  # a prefix that ends in white space ends in one word of it
            counts[at[i]] = before[i - 1] + total[self.index[run]]
        return counts

    def of_plain(self, text: str) -> np.ndarray:
        """The same, slice by slice."""
        out, total, start = [], 0, 0
        while start < len(text):
            found = self.gap.search(text, min(start + SLICE_CHARS, len(text)))
            end = found.end() if found else len(text)
            out.append(self.of_slice(text[start:end]) + np.int32(total))
            total, start = int(out[-1][-1]), end
            if self.used > TABLE_CHARS:
                self.forget()
            if len(self.apart) > PAIRS:
                self.apart.clear()
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def of_text(self, text: str) -> np.ndarray:
        """Token counts of text[:k] for every k from 0 to its length."""
        out, total, start = [np.zeros(1, np.int32)], 0, 0
        for found in self.special.finditer(text):
            inner = self.of_plain(text[start:found.end() - 1])  # an unfinished special string is plain text
            size = found.start() - start
            total_after = total + (int(inner[size - 1]) if size else 0) + 1
            out += [inner + np.int32(total), np.array([total_after], np.int32)]
            total, start = total_after, found.end()
        out.append(self.of_plain(text[start:]) + np.int32(total))
        return np.concatenate(out)


@functools.lru_cache(maxsize=1)
def counter_of(path: str, pattern: str) -> PrefixCounter:
    """One counter a Python worker, which keeps the words it knows for its next task. Its tables are bounded."""
    return PrefixCounter(path, pattern)


def prefix_counts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text_bytes and counts of every row: counts[k] is the number of tokens of the text's first k code points."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path, pattern)
        for batch in batches:
            ids, first = batch.column(0), 0
            held: list[np.ndarray] = []
            for text in itertools.chain(batch.column(2).to_pylist(), (None,)):
                done = first + len(held) == batch.num_rows
                if held and (done or sum(map(len, held)) > OUTPUT_CHARS):
                    ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
                    part = slice(first, first + len(held))
                    yield pa.RecordBatch.from_arrays(
                        [ids[part], batch.column(1)[part], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held)))],
                        ["doc_id", "text_bytes", "counts"])
                    first, held = first + len(held), []
                if not done:
                    held.append(counter.of_text(text or ""))

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("text_bytes"),
        "text").mapInArrow(run, COUNTED)


def n_tokens(counts: Column) -> Column:
    return F.element_at(counts, -1).cast("bigint")


def fitting_chars(counts: Column, budget: int) -> Column:
    """Code points of the longest prefix of at most `budget` tokens. Counts may fall again, so it is looked for from the end."""
    fits = F.transform(F.reverse(counts), lambda c: c <= budget)
    return F.when(n_tokens(counts) <= budget, F.size(counts) - 1).otherwise(F.size(counts) - F.array_position(fits, True)).cast("bigint")


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and fit_chars: the code points that fit the limit. All read off the stored counts."""
    held = prefix_counts(docs, path, pattern)
    return held.select(
        "doc_id", F.col("text_bytes").alias("n_bytes"), n_tokens(F.col("counts")).alias("n_tokens"),
        (n_tokens(F.col("counts")) > limit).alias("over_limit"), fitting_chars(F.col("counts"), limit).alias("fit_chars"))
