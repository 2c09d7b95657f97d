import hashlib
import random
import zlib

import pytest

from answerloom.llm import merkle

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def written(value):
    text = None if value is None else str(value)
    return "-" if text is None else f"{len(text.encode())}:{text}"


def tree(nodes):
    """The root, and for each node its left and right siblings, level by level."""
    above, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(place):
            start = at - at % 16
            above[i].append((nodes[start:at], nodes[at + 1: start + 16]))
        nodes = [H(*nodes[i: i + 16]) for i in range(0, len(nodes), 16)]
        place = [at // 16 for at in place]
    return nodes[0], above


def brute_force(rows):
    by = {}
    for i, source, lang, n, text in rows:
        leaf = H(*map(written, (i, source, lang, n, text)))
        shown = text
        if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 and text is not None:
            shown = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        by.setdefault(source, []).append((i is not None, i or 0, leaf, H(*map(written, (i, source, lang, n, shown))), i))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort()
    trees = {s: tree([x[2] for x in by[s]]) for s in names}
    root, tops = tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        subroot, above = trees[s]
        for (_, _, leaf, shown, i), beside in zip(by[s], above, strict=True):
            path = beside + top
            node = shown
            for left, right in path:
                node = H(*left, node, *right)
            out.append((i, leaf, subroot, root, H(*["".join(a + b) for a, b in path]), node, node == root))
    return out


def documents(spark, rows):
    return spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, at int")


def rows_of(sizes, seed):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(10**6), s, rnd.choice(("en", None)), rnd.choice((5, None)), rnd.choice(("Some Text É", "", None, "lower"))) for s, n in sizes for _ in range(n)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("levels", [1, 2, 3])
@pytest.mark.parametrize("sizes", [
    [("a", 1)], [("a", 1), (None, 1)], [("a", 17), ("É", 16), (None, 300), ("", 1)], [("s", 530), ("t", 289), ("u", 256), ("v", 257)],
    [(f"s{i}", 1 + i % 3) for i in range(40)]])
def test_manifest_equals_brute_force(spark, monkeypatch, levels, sizes):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    rows = rows_of(sizes, levels)
    rows += [rows[0], rows[0], (None, *rows[-1][1:])]
    got = merkle.manifest(documents(spark, rows)).drop("source_no").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_force(rows), key=str)


def test_deep_tree_by_blocks_of_sixteen(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    rows = rows_of([("a", 4500), ("b", 4097)], 9)  # 282 and 257 blocks: three rounds with gaps
    got = merkle.manifest(documents(spark, rows)).drop("source_no").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_force(rows), key=str)


def test_no_rows_and_missing_columns(spark):
    docs = documents(spark, rows_of([("a", 3)], 1))
    assert merkle.manifest(docs.limit(0)).count() == 0
    got = merkle.manifest(docs.select("doc_id", "source", "text")).drop("source_no").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_force([(r["doc_id"], r["source"], None, None, r["text"]) for r in docs.collect()]), key=str)
