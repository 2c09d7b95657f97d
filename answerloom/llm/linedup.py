"""Line dedup: a distributed suffix array over line ids finds repeated runs of lines; later copies are deleted.

Lines with a word become 64-bit ids. Only ids that occur twice or more can be in a repeated run, so a document falls
into segments between its other lines. Equal segments are one: all but the first copy are decided at once. The
suffixes of the distinct segments are ranked by prefix doubling (each round ranks pairs of ranks by a range sort).
The longest common prefixes of neighbours in the suffix array are read off the kept ranks, from the longest
power of two down. In an interval of the array whose common prefix is a run, the first occurrence in document order
stays and every other one is deleted: each suffix looks for the longest prefix that it shares with an earlier one,
inside chunks of the array plus short summaries of all chunks before and after.

A run counts if it has at least `min_words` words. Document order is (doc_id, hash of the text).

Defined cases: a null or empty text stays as it is; blank lines are kept and are no part of a run; a null doc_id
comes first; rows with the same doc_id and text are one document with one result; an empty table gives an empty
result; other columns are carried along unread, whatever their names are, but for an input column named like the
count of removed lines, which that count replaces.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import sorted_ordinal
from ..session import settle
from .common import fresh

MIN_WORDS = 8
CHUNK = 50_000  # suffixes of one chunk of the array

Stair = list[tuple[int, int]]  # (common prefix with the chunk's edge, first position), from the edge outwards


def _doc_key():
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text"))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, doc_key, at, line and words of every line with a word; `at` counts these lines."""
    solid = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = docs.filter("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), _doc_key().alias("doc_key"), F.posexplode_outer(solid).alias("at", "line")).filter("at is not null")
    return rows.select(
        "doc_id", "doc_key", "at", F.xxhash64("line").alias("line"), F.regexp_count("line", F.lit("[^\\x20\\x09-\\x0D]+")).alias("words")
    ).dropDuplicates(["doc_key", "doc_id", "at"])


def segments(docs: DataFrame) -> DataFrame:
    """Maximal stretches of lines that occur twice or more: doc_id, doc_key, start, lines, words (arrays)."""
    lines = settle(_lines(docs))
    again = settle(lines.groupBy("line").agg(F.count("*").alias("n")).filter("n > 1").select("line"))
    kept = lines.join(again, "line")
    inside = Window.partitionBy("doc_id", "doc_key").orderBy("at")
    runs = kept.withColumn("run", F.col("at") - F.row_number().over(inside))
    return runs.groupBy("doc_id", "doc_key", "run").agg(
        F.min("at").alias("start"), F.array_sort(F.collect_list(F.struct("at", "line", "words"))).alias("rows")
    ).select("doc_id", "doc_key", "start", F.col("rows.line").alias("lines"), F.col("rows.words").alias("words"))


def suffix_ranks(firsts: DataFrame) -> tuple[DataFrame, int]:
    """sid, i, left (lines to the segment's end) and ranks (one a level, by prefixes of 1, 2, 4 ... lines) of every suffix.

    `firsts`: sid and lines of distinct segments. The last level ranks whole suffixes. One round of jobs per level.
    """
    longest = firsts.agg(F.max(F.size("lines"))).first()[0] or 0
    state = firsts.select("sid", F.posexplode("lines").alias("i", "rank"), F.size("lines").alias("n")).select(
        "sid", "i", (F.col("n") - F.col("i")).alias("left"), F.array("rank").alias("ranks"), "rank")
    step, levels = 1, 1
    while step < longest:
        ahead = F.lead("rank", step).over(Window.partitionBy("sid").orderBy("i"))
        paired = settle(state.withColumn("ahead", ahead).withColumnRenamed("rank", "own"))
        pairs = paired.select("own", "ahead").distinct()
        numbered = sorted_ordinal(pairs, ["own", "ahead"], "rank")
        same = F.col("p.own").eqNullSafe(F.col("q.own")) & F.col("p.ahead").eqNullSafe(F.col("q.ahead"))
        state = paired.alias("p").join(numbered.alias("q"), same).select(
            "p.sid", "p.i", "p.left", F.concat("p.ranks", F.array("q.rank")).alias("ranks"), "q.rank")
        step, levels = 2 * step, levels + 1
    return settle(state), levels


def neighbours(suffixes: DataFrame, levels: int) -> DataFrame:
    """The suffix array without equal suffixes: ordinal, sid, i of the first occurrence, left, and lcp with the one before."""
    place = F.struct("sid", "i")
    classes = suffixes.groupBy("rank").agg(F.min(F.struct(place.alias("place"), "left")).alias("f"))
    array = settle(sorted_ordinal(classes.select("rank", F.col("f.place.sid").alias("sid"), F.col("f.place.i").alias("i"), F.col("f.left").alias("left")), ["rank"], "ordinal"))
    before = array.select((F.col("ordinal") + 1).alias("ordinal"), F.col("sid").alias("sid_b"), F.col("i").alias("i_b"))
    pairs = settle(array.join(before, "ordinal", "left").withColumn("lcp", F.lit(0)))
    for level in reversed(range(levels)):
        at = suffixes.select("sid", "i", F.get("ranks", F.lit(level)).alias("r"), "left")
        one = at.select(F.col("sid").alias("s1"), F.col("i").alias("p1"), F.col("r").alias("r1"), F.col("left").alias("l1"))
        two = at.select(F.col("sid").alias("s2"), F.col("i").alias("p2"), F.col("r").alias("r2"), F.col("left").alias("l2"))
        met = pairs.join(one, (F.col("sid") == F.col("s1")) & (F.col("i") + F.col("lcp") == F.col("p1")), "left").join(
            two, (F.col("sid_b") == F.col("s2")) & (F.col("i_b") + F.col("lcp") == F.col("p2")), "left")
        span = 1 << level
        equal = (F.col("r1") == F.col("r2")) & (F.col("l1") >= span) & (F.col("l2") >= span)
        pairs = met.select("ordinal", "sid", "i", "left", "sid_b", "i_b", (F.col("lcp") + F.when(equal, span).otherwise(0)).alias("lcp"))
        if level % 3 == 0:
            pairs = settle(pairs)  # keeps the plans short
    return pairs.select("ordinal", "sid", "i", "left", "lcp")


def _stair(lcps: np.ndarray, places: np.ndarray) -> Stair:
    """What a look from the edge sees: lcps[k] is the common prefix of element k with the edge so far, places in that order."""
    out: Stair = []
    for shared, place in zip(np.minimum.accumulate(lcps).tolist(), places.tolist(), strict=True):
        if not shared:
            break
        if out and place >= out[-1][1]:
            continue
        if out and out[-1][0] == shared:
            out.pop()
        out.append((shared, place))
    return out


def _pass_on(own: Stair, beyond: Stair, through: int) -> Stair:
    """A chunk's stair, continued by the one that reaches its far edge, of which at most `through` lines come through."""
    out = list(own)
    for shared, place in beyond:
        shared = min(shared, through)
        if not shared or (out and place >= out[-1][1]):
            continue
        if out and out[-1][0] == shared:
            out.pop()
        out.append((shared, place))
    return out


def _best_before(lcps: np.ndarray, places: np.ndarray, stair: Stair) -> np.ndarray:
    """For each element the longest prefix shared with an earlier place among the elements before it and the stair."""
    # far to near, then the edge itself, which comes before nothing; each with the prefix it shares with the one below
    stack = [(place, farther) for (_, place), (farther, _) in zip(reversed(stair), [(0, 0), *reversed(stair)], strict=False)]
    stack.append((1 << 62, stair[0][0] if stair else 0))
    best = np.zeros(len(places), np.int64)
    for k, (place, shared) in enumerate(zip(places.tolist(), lcps.tolist(), strict=True)):
        low = shared
        while stack and stack[-1][0] > place:
            low = min(low, stack.pop()[1])
        if stack:
            best[k] = low
        stack.append((place, low))
    return best


def _chunk_arrays(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = rows.sort_values("ordinal")
    return rows["lcp"].to_numpy(np.int64), rows["place"].to_numpy(np.int64)


def earlier_prefixes(array: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """sid, i, left and best: how many lines of each suffix class's first occurrence also begin at an earlier place."""
    bits = (array.agg(F.max("i")).first()[0] or 0).bit_length()
    placed = settle(array.withColumn("place", F.shiftleft("sid", bits) + F.col("i")).withColumn("chunk", F.floor(F.col("ordinal") / chunk)))

    def summary(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lcps, places = _chunk_arrays(rows)
        right = _stair(np.concatenate(([1 << 40], lcps[:0:-1])), places[::-1])
        left = _stair(lcps, places)  # the first lcp leads over the left edge
        return pd.DataFrame({"chunk": [key[0]], "least": [int(lcps.min())], "right": [np.array(right, np.int64).ravel().tolist()], "left": [np.array(left, np.int64).ravel().tolist()]})

    parts = placed.groupBy("chunk").applyInPandas(summary, "chunk bigint, least bigint, right array<bigint>, left array<bigint>")
    parts = sorted(parts.collect(), key=lambda r: r["chunk"])  # a few numbers for each chunk, no suffixes
    stair = lambda flat: list(zip(flat[::2], flat[1::2], strict=True))
    from_left: dict[int, Stair] = {}
    from_right: dict[int, Stair] = {}
    seen: Stair = []
    for r in parts:
        from_left[r["chunk"]] = seen
        seen = _pass_on(stair(r["right"]), seen, r["least"])
    seen = []
    for r in reversed(parts):
        from_right[r["chunk"]] = seen
        seen = _pass_on(stair(r["left"]), seen, r["least"])

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ordinal")
        lcps, places = _chunk_arrays(rows)
        before = _best_before(lcps, places, from_left[key[0]])
        after = _best_before(np.concatenate(([1 << 40], lcps[:0:-1])), places[::-1], from_right[key[0]])[::-1]
        return pd.DataFrame({"sid": rows["sid"], "i": rows["i"], "left": rows["left"], "best": np.maximum(before, after)})

    return placed.groupBy("chunk").applyInPandas(solve, "sid bigint, i int, left int, best bigint")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, doc_key, first and last line number (among lines with a word) of every run that is a later copy."""
    found = settle(segments(docs).withColumn("key", F.xxhash64("lines")))
    place = F.struct("doc_id", "doc_key", "start")
    firsts = settle(found.groupBy("key").agg(F.min(place).alias("f")))
    marked = settle(found.join(firsts, "key").withColumn("is_first", F.struct("doc_id", "doc_key", "start").eqNullSafe(F.col("f"))))
    total = F.aggregate("words", F.lit(0), lambda a, x: a + x)
    copies = marked.filter(~F.col("is_first") & (total >= min_words)).select(
        "doc_id", "doc_key", F.col("start").alias("first"), (F.col("start") + F.size("lines") - 1).alias("last"))
    numbered = settle(sorted_ordinal(marked.filter("is_first").select("doc_id", "doc_key", "start", "lines", "words"), ["doc_id", "doc_key", "start"], "sid"))
    suffixes, levels = suffix_ranks(numbered.select("sid", "lines"))
    best = earlier_prefixes(neighbours(suffixes, levels), chunk)
    first = best.select("sid", "i", F.lit(True).alias("is_class"), "best")
    runs = suffixes.select("sid", "i", "left").join(first, ["sid", "i"], "left").select(
        "sid", "i", F.when(F.col("is_class"), F.col("best")).otherwise(F.col("left")).cast("int").alias("n")).filter("n > 0")
    spans = runs.groupBy("sid").agg(F.collect_list(F.struct("i", "n")).alias("spans"))  # at most one for each line of a document
    held = numbered.join(spans, "sid").select("doc_id", "doc_key", "start", "words", F.explode("spans").alias("s"))
    long_enough = F.aggregate(F.slice("words", F.col("s.i") + 1, F.col("s.n")), F.lit(0), lambda a, x: a + x) >= min_words
    return copies.union(held.filter(long_enough).select(
        "doc_id", "doc_key", (F.col("start") + F.col("s.i")).alias("first"), (F.col("start") + F.col("s.i") + F.col("s.n") - 1).alias("last")))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, chunk: int = CHUNK, removed: str | None = "n_removed_lines") -> DataFrame:
    """`docs` with its columns, its texts without later copies of repeated runs, and, if `removed` names it, their number."""
    runs = repeated_runs(docs, min_words, chunk)
    doc, key, own, spans, parts, at, gone = (fresh(docs, c) for c in ("run_doc", "run_key", "own_key", "run_spans", "line_parts", "solid_at", "gone_at"))
    ranges = settle(runs.groupBy(F.col("doc_id").alias(doc), F.col("doc_key").alias(key)).agg(F.collect_set(F.struct("first", "last")).alias(spans)))
    keyed = docs.withColumn(own, _doc_key())
    met = keyed.join(ranges, F.col("doc_id").cast("bigint").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(key)), "left")
    lines = F.split("text", "\n")
    solid = F.transform(lines, lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    hit = F.col(spans).isNotNull()
    met = met.withColumn(parts, F.when(hit, lines)).withColumn(
        at, F.when(hit, F.filter(F.transform(solid, lambda s, i: F.when(s, i)), lambda i: i.isNotNull())))
    met = met.withColumn(gone, F.array_distinct(F.flatten(F.transform(
        spans, lambda r: F.slice(F.col(at), r["first"] + 1, r["last"] - r["first"] + 1)))))
    text = F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone)), lambda i: F.get(parts, i)), "\n")
    return met.select(
        *[F.when(hit, text).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != removed],
        *([F.coalesce(F.size(gone), F.lit(0)).alias(removed)] if removed else []))
