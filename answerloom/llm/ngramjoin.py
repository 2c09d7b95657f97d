"""Exact Jaccard self-join of word-shingle sets by token-combination prefixes, and its components.

Shingles are ordered by how frequent their class is (counts of hashed shingles over all rows), rare ones first.
A set's prefix is extended until it holds more signatures than the set may lose shingles: a rare shingle is a
signature by itself, frequent ones sign in combinations of two or three, so no very frequent shingle gathers a long
list. Two sets that reach the threshold share a signature, which is in the shorter prefix that the smaller set needs.
Equal sets are one class from the start.

Links are found in rounds: in each list of a signature the members meet one leader, and what has linked need not
meet again. The first leader is the member whose prefix comes to the signature soonest: it has the fewest shingles
of its own, so it is nearest to the middle of a group of near copies. The pairs that are left over after the star
rounds, in different components, are then compared in full, inside lists of up to LONG_LIST classes. Longer lists are
refined: their classes sign anew, in larger combinations (see `refined_pairs`), so that only classes with a whole part
of their sets in common are paired.
Every pair passes an exact bound first (the overlap of two sets is at most that of their hashed histograms).

Shingles are 64-bit hashes. Defined cases: a null, empty or blank text has no shingles and is linked with nothing;
a text shorter than one shingle is one shingle; a row with a null doc_id is left as it is, with no component;
repeated rows give their own result rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import fresh, small_batches
from .graph import components

BUCKETS = 1 << 20  # classes of shingles whose frequency is counted
FREQUENT = (8, 128)  # a class is frequent, or very frequent, above these times the mean count
PARTS = (64, 16, 4, 1)  # of the frequent classes, one number after the other; combinations are formed inside a part
STAR_ROUNDS = 2
LONG_LIST = 64  # classes; the rest of a longer list is not paired but refined
BINS = 512  # of the histograms that bound an overlap
SETS = "doc_id bigint, text_hash bigint, n bigint, class bigint, histogram binary"

_BASE = 0x9E3779B97F4A7C15 | 1  # of the rolling word hash, modulo 2 ** 64
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses, up to the longest text a worker has met."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(12, n.bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams, A-Z lower-cased; a shorter text is one shingle."""
    data = np.frombuffer((text or "").encode().lower(), np.uint8)  # bytes.lower touches A-Z only
    edges = np.diff(np.concatenate(([True], _IS_SPACE[data], [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    if not len(starts):
        return np.zeros(0, np.int64)
    up, down = _powers(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)))
    words = _mixed((total[ends] - total[starts]) * down[starts])
    out = np.zeros(max(len(words) - n + 1, 1), np.uint64)
    for k in range(min(n, len(words))):
        out = _mixed(out + words[k: k + len(out)] * np.uint64(2 * k + 3)) + np.uint64(min(n, len(words)))
    return np.unique(out.astype(np.int64))


def _texts(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def described_sets(docs: DataFrame, n: int) -> DataFrame:
    """Per row: doc_id, a hash of the text, the number of shingles, a hash of the set, and its histogram over BINS hashed bins.

    Histogram counts stop at 255; the bound treats such a bin as unbounded.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, n) for t in batch.column(1).to_pylist()]
            bins = [np.minimum(np.bincount((s >> 20) % BINS, minlength=BINS), 255).astype(np.uint8).tobytes() for s in sets]
            keys = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), pa.array(bins, pa.binary())],
                ["doc_id", "text_hash", "n", "class", "histogram"])

    return _texts(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, SETS)


def class_counts(docs: DataFrame, n: int) -> np.ndarray:
    """For each of BUCKETS classes of shingles its count over the mean count; 0 up to the mean. Fixed in size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(1).to_pylist():
                np.add.at(total, shingle_set(text, n) % BUCKETS, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    counts = settle(_texts(docs).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")))
    mean = max((counts.agg(F.sum("n")).first()[0] or 0) / BUCKETS, 1.0)
    above = counts.filter(F.col("n") > mean).toArrow()  # at most BUCKETS rows of 12 bytes, whatever the input
    out = np.zeros(BUCKETS, np.float32)
    out[above["bucket"].to_numpy()] = above["n"].to_numpy() / mean
    return out


def losses(size: int, percent: int) -> tuple[int, int]:
    """Shingles that a set of this size may lack in a partner that is no smaller, and in any partner."""
    return size - -(-2 * percent * size // (100 + percent)), size - -(-percent * size // 100)


def prefix_signatures(shingles: np.ndarray, weight: np.ndarray, lose: tuple[int, int], times=FREQUENT, parts=PARTS) -> tuple[list[int], int, list[int]]:
    """Signatures of one set, how many of them, from the front, suffice for partners that are no smaller, and what came before each.

    The last is the number of losses that the prefix can bear already where the signature stands.

    weight: the class count over the mean, by which shingles are ordered; lose: see `losses`. A group of p shingles
    that sign in k-combinations loses all its signatures only with p - k + 1 of its shingles, so the prefix ends when
    these numbers add up to more than may be lost. Of two close sets, the one whose prefix ends first has a signature
    that the other one has as well. A set that is used up before goes on with fewer and larger groups, at last with
    single shingles; two close sets that are both used up meet there.
    """
    order = np.lexsort((shingles, weight))
    ordered = shingles[order].tolist()
    level = (np.searchsorted(np.asarray(times), weight[order]) + 1).tolist()
    out: list[int] = []
    before: list[int] = []
    short = None
    for groups in (*parts, 0):
        taken: dict[tuple[int, int], list[int]] = {}
        signs = 0
        for s, k in zip(ordered, level, strict=True):
            if k == 1 or not groups:
                out.append(s)
                signs += 1
            else:
                group = taken.setdefault((k, s % groups), [])
                out.extend(hash((k, *some, s)) & 0x7FFFFFFFFFFFFFFF for some in itertools.combinations(group, k - 1))
                group.append(s)
                signs += len(group) >= k
            before.extend([signs] * (len(out) - len(before)))
            if short is None and signs > lose[0]:
                short = len(out)
            if signs > lose[1]:
                return out, short, before
    return out, len(out), before


def signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """sig, class, n, short (enough for partners that are no smaller) and before: the signatures of every set with at least two shingles."""
    counts = class_counts(docs, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, short, places, sizes, keys = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                own = shingle_set(text, n)
                if len(own) < 2:
                    continue  # a set of one links with equal sets only, which are one class
                signs, first, before = prefix_signatures(own, counts[own % BUCKETS], losses(len(own), percent))
                found.append(signs)
                short.append(np.arange(len(signs)) < first)
                places.append(np.array(before, np.int32))
                sizes.append(len(own))
                keys.append(int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True))
            lens = [len(f) for f in found]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.fromiter(itertools.chain.from_iterable(found), np.int64, sum(lens))),
                pa.array(np.repeat(np.array(keys, np.int64), lens)), pa.array(np.repeat(np.array(sizes, np.int64), lens)),
                pa.array(np.concatenate([np.zeros(0, bool), *short])), pa.array(np.concatenate([np.zeros(0, np.int32), *places]))],
                ["sig", "class", "n", "short", "before"])

    return _texts(docs).mapInArrow(run, "sig bigint, class bigint, n bigint, short boolean, before int")


def whole_sets(docs: DataFrame, n: int) -> DataFrame:
    """class and shingles of every row, one row a class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, n) for t in batch.column(1).to_pylist()]
            keys = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)  # arrays all the way: sets as lists of numbers take five times the memory
            shingles = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), shingles], ["class", "shingles"])

    return _texts(docs).mapInArrow(run, "class bigint, shingles array<bigint>").dropDuplicates(["class"])


def _sets_of(classes: DataFrame, named: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """class and shingles of these classes (and of others that share a doc_id with them); their texts are read again."""
    wanted = settle(named.join(classes, "class").select(F.col("doc_id").alias("_wanted")))
    texts = _texts(docs)
    return settle(whole_sets(texts.join(wanted, texts["doc_id"] == wanted["_wanted"], "left_semi"), n))


def _close(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _most_shared(a: pd.Series, b: pd.Series) -> pd.Series:
    """No two sets with these histograms share more shingles."""
    least = np.minimum(*(np.frombuffer(b"".join(s), np.uint8).reshape(-1, BINS) for s in (a, b)))
    return pd.Series(np.where((least == 255).any(1), 1 << 62, least.sum(1, dtype=np.int64)))


def _verified(pairs: DataFrame, bins: DataFrame, named: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold.

    bins: class, n and histogram, named: class and one doc_id of it. Only texts of pairs that pass the bound are read again.
    """
    side = lambda table, x, *cols: table.select(F.col("class").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in cols])
    most = F.pandas_udf(_most_shared, "bigint")
    bounded = pairs.join(side(bins, "a", "n", "histogram"), "a").join(side(bins, "b", "n", "histogram"), "b").select(
        "a", "b", "n_a", "n_b", most("histogram_a", "histogram_b").alias("most"))
    likely = settle(bounded.filter((100 + percent) * F.col("most") >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b", "n_a", "n_b"))
    sets = _sets_of(likely.select(F.explode(F.array("a", "b")).alias("class")).distinct(), named, docs, n)
    shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return settle(
        likely.join(side(sets, "a", "shingles"), "a").join(side(sets, "b", "shingles"), "b")
        .filter(100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b"))


def part_numbers(most: int) -> list[int]:
    """1, 2, 3, 4, 6, 8, 12, ...: the numbers of parts that sets are cut into, up to the first that is `most` or more."""
    out = [1, 2, 3, 4]
    while out[-1] < most:
        out.append(out[-2] * 2)
    return out[: 1 + sum(m < most for m in out)]


def _parts_needed(need: Column) -> Column:
    """The first of `part_numbers` that is `need` or more."""
    power = F.pow(F.lit(2), F.length(F.bin(need - 1))).cast("bigint")
    return F.when(need <= 2, need).when(power * 3 >= need * 4, (power * 3 / 4).cast("bigint")).otherwise(power)


def part_keys(shingles: np.ndarray, own: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every part of a set: its key, the number of parts and whether it is empty.

    own: shingles of this set that no other one has; they are left out. most: how many parts are needed at most.
    """
    kept = np.setdiff1d(shingles, own).astype(np.uint64)
    mixed = _mixed(kept + np.uint64(_BASE))
    keys, numbers, empty = [], [], []
    for m in part_numbers(most):
        part = (mixed % np.uint64(m)).astype(np.int64)
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, part, _mixed(mixed))
        count = np.bincount(part, minlength=m)
        keys.append(_mixed(sums + _mixed(np.arange(m, dtype=np.uint64) + np.uint64(m << 32)) * np.uint64(3)))
        numbers.append(np.full(m, m, np.int64))
        empty.append(count == 0)
    return np.concatenate(keys).astype(np.int64), np.concatenate(numbers), np.concatenate(empty)


def refined_pairs(members: DataFrame, named: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs a, b of classes of long lists that may still be close, in different components.

    members: sig, class, n and own of these lists. Two sets differ in at most d = (n_a + n_b)(100 - percent) / (100 +
    percent) shingles. Shingles that none of the other sets has, u_a and u_b of them, are such differences; so if the
    rest is cut into d - u_a - u_b + 1 parts by hash, one part is the same in both. That part is the signature, a
    combination of as many shingles as can be. Every set is cut into all numbers of parts that it may need, a pair
    is made only in the one that it does need: first for the sizes and u that a list holds, then for the components
    of these, and only then for classes. Empty parts count together with the long list's own signature.
    """
    classes = settle(members.select("class", "n", "own").distinct())
    sets = _sets_of(classes, named, docs, n).join(classes, "class").select("class", "n", "own", "shingles")
    lone = (sets.select("class", F.explode("shingles").alias("s")).groupBy("s").agg(F.min("class").alias("class"), F.count("*").alias("times"))
            .filter("times = 1").groupBy("class").agg(F.collect_list("s").alias("lone")))  # part of one set each
    held = sets.join(lone, "class", "left").select("class", "n", "own", "shingles", "lone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, size, own, shingles, lone in zip(*(c.to_pylist() for c in batch.columns[:3]), *batch.columns[3:], strict=True):
                alone = lone.values.to_numpy() if lone.is_valid else np.zeros(0, np.int64)
                most = size * (100 - percent) // percent - len(alone) + 1
                if most < 1:
                    continue  # it differs from every other set by too much
                keys, numbers, empty = part_keys(shingles.values.to_numpy(), alone, most)
                same = lambda x: pa.array(np.full(len(keys), x, np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(numbers), pa.array(empty), same(key), same(size), same(own), same(len(alone))],
                    ["key", "parts", "empty", "class", "n", "own", "u"])

    keyed = settle(held.mapInArrow(run, "key bigint, parts bigint, empty boolean, class bigint, n bigint, own bigint, u bigint"))
    void = keyed.filter("empty").join(members.select("class", "sig"), "class").select(F.xxhash64("key", "sig").alias("key"), "parts", "class", "n", "own", "u")
    rows = keyed.filter("not empty").select("key", "parts", "class", "n", "own", "u").union(void)
    shared = rows.groupBy("key", "parts").agg(F.min("own").alias("low"), F.max("own").alias("high")).filter("low <> high").select("key", "parts")
    rows = settle(rows.join(shared, ["key", "parts"]))
    side = lambda table, x, *cols: table.select("key", "parts", *[F.col(c).alias(f"{c}_{x}") for c in cols])
    kinds = rows.select("key", "parts", "n", "u").distinct()
    need = F.floor((F.col("n_a") + F.col("n_b")) * (100 - percent) / (100 + percent)) - F.col("u_a") - F.col("u_b") + 1
    kinds = side(kinds, "a", "n", "u").join(side(kinds, "b", "n", "u"), ["key", "parts"]).filter(
        (F.struct("n_a", "u_a") <= F.struct("n_b", "u_b")) & _close(F.col("n_a"), F.col("n_b"), percent) & (need >= 1)
        & (_parts_needed(need) == F.col("parts")))
    groups = rows.select("key", "parts", "n", "u", "own").distinct()
    parties = kinds.join(side(groups, "a", "n", "u", "own"), ["key", "parts", "n_a", "u_a"]).join(
        side(groups, "b", "n", "u", "own"), ["key", "parts", "n_b", "u_b"]).filter("own_a <> own_b")
    whole = ("n", "u", "own", "class")
    on = lambda x: ["key", "parts", *(f"{c}_{x}" for c in whole[:3])]
    pairs = parties.join(side(rows, "a", *whole), on("a")).join(side(rows, "b", *whole), on("b"))
    return pairs.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).distinct()


def join(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`; two documents link at `percent` Jaccard similarity.

    Runs jobs while the plan is built and stores tables in the shared folder.
    """
    return grouped(docs, n, percent).drop("text_hash")


def one_of_each_group(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """The rows of `docs`, one of each component: the one of the smallest doc_id, of its texts the one of the smallest hash.

    Decided by row: of a doc_id with two texts only the copied one goes, and of equal rows of doc_id and text one stays
    (any of them, if other columns differ). Rows without words or doc_id all stay. Columns may have any names.
    """
    found = settle(grouped(docs, n, percent).filter("n_shingles > 0 and doc_id is not null"))
    stays = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("stays"))
    doc, text = fresh(docs, "copy_doc"), fresh(docs, "copy_text")
    keys = found.groupBy("component_id", "doc_id", "text_hash").agg(F.count("*").alias("times")).join(stays, "component_id").select(
        F.col("doc_id").alias(doc), F.col("text_hash").alias(text), "times", (F.struct("doc_id", "text_hash") == F.col("stays")).alias("first"))
    keys = settle(keys.filter("times > 1 or not first"))
    same = (F.col("doc_id").cast("bigint") == F.col(doc)) & (F.xxhash64("text") == F.col(text))
    alone = docs.join(keys.select(doc, text), same, "left_anti")
    repeated = settle(keys.filter("first").select(doc, text))
    if repeated.isEmpty():
        return alone
    return alone.union(docs.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def grouped(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """`join`, with a hash of each row's text."""
    described = settle(described_sets(docs, n))
    ids = described.select("doc_id", "text_hash", "n", "class")
    rows = settle(signatures(docs, n, percent))
    lists = settle(rows.groupBy("sig").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high").select("sig"))
    listed = settle(rows.join(lists, "sig").groupBy("sig", "class", "n").agg(F.max("short").alias("short"), F.min("before").alias("before")))  # copies have the same rows
    named = settle(ids.filter("n > 0 and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id")))
    bins = settle(
        described.join(named.select(F.col("doc_id").alias("_first"), F.col("class").alias("_class")),
                       (F.col("doc_id") == F.col("_first")) & (F.col("class") == F.col("_class")), "left_semi")
        .dropDuplicates(["class"]).select("class", "n", "histogram"))
    links = labels = None
    for turn in range(STAR_ROUNDS + 1):
        if labels is None:
            marked = listed.withColumn("own", F.col("class"))
        else:
            marked = settle(listed.join(labels.select(F.col("node").alias("class"), "component"), "class", "left").select(
                "sig", "class", "n", "short", "before", F.coalesce("component", "class").alias("own")))
        draw = F.struct(*([] if turn else ["before"]), F.xxhash64("class", F.lit(turn)), "class", "n", "own")
        leads = settle(
            marked.groupBy("sig").agg(F.min(draw).alias("lead"), F.min("own").alias("low"), F.max("own").alias("high"), F.count("*").alias("members"))
            .filter("low <> high").select("sig", "members", F.col("lead.class").alias("b"), F.col("lead.n").alias("n_b"), F.col("lead.own").alias("own_b")))
        left = marked.select("sig", F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("own").alias("own_a"))
        right = leads.drop("members")
        if turn == STAR_ROUNDS:
            right = settle(marked.filter("short").join(leads.filter(F.col("members") <= LONG_LIST).select("sig"), "sig").select(
                "sig", F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("own").alias("own_b")))
        pairs = left.join(right, "sig").filter((F.col("own_a") != F.col("own_b")) & _close(F.col("n_a"), F.col("n_b"), percent))
        if turn == STAR_ROUNDS:
            pairs = pairs.filter("n_b <= n_a")  # the smaller one's short prefix meets the other's whole prefix
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if turn == STAR_ROUNDS:
            longer = leads.filter(F.col("members") > LONG_LIST).select("sig")
            members = settle(marked.join(longer, "sig").select("sig", "class", "n", "own"))
            if not members.isEmpty():
                pairs = pairs.union(refined_pairs(members, named, docs, n, percent)).distinct()
        pairs = settle(pairs)
        if pairs.isEmpty():
            continue  # leaders may all differ too much in size; only the last round is exact
        found = _verified(pairs, bins, named, docs, n, percent)
        if not found.isEmpty():
            links = found if links is None else settle(links.union(found))
            labels = components(links)
    # Classes are hashes; a component's id is its smallest doc_id.
    whole = named if labels is None else named.join(labels.select(F.col("node").alias("class"), "component"), "class", "left")
    whole = settle(whole.select("class", "doc_id", (F.col("class") if labels is None else F.coalesce("component", "class")).alias("component")))
    first = whole.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_class = settle(whole.join(first, "component").select("class", "component_id"))
    return ids.join(by_class, "class", "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
