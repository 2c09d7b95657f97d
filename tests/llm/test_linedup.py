import random

import pytest

from answerloom.llm import linedup


def brute(rows, min_words):
    """Each later copy of a run of lines goes, by comparing all pairs of places."""
    docs = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda d: (d[0] is not None, d[0] or 0))
    lines = [[x for x in t.split("\n") if x.strip()] for _, t in docs]
    places = [(d, i) for d, own in enumerate(lines) for i in range(len(own))]
    gone = {}
    for d, i in places:
        best = 0
        for e, j in places:
            if (e, j) >= (d, i):
                break
            n = 0
            while i + n < len(lines[d]) and j + n < len(lines[e]) and lines[d][i + n] == lines[e][j + n]:
                n += 1
            best = max(best, n)
        if best and sum(len(x.split()) for x in lines[d][i: i + best]) >= min_words:
            gone.setdefault(docs[d], set()).update(range(i, i + best))
    out = []
    for doc_id, text in rows:
        cut = gone.get((doc_id, text), set())
        kept, at = [], -1
        for line in (text or "").split("\n"):
            at += bool(line.strip())
            if not line.strip() or at not in cut:
                kept.append(line)
        out.append((doc_id, None if text is None else "\n".join(kept), len(cut)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "chunk"), [(1, 7), (2, 3), (3, 50_000)])
def test_equals_brute_force(spark, seed, chunk):
    rnd = random.Random(seed)
    pool = [" ".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 4))) + str(k) for k in range(9)]
    block = [rnd.choice(pool) for _ in range(12)]
    rows = []
    for d in range(40):
        own = [rnd.choice([*pool, f"only {d} {i}", ""]) for i in range(rnd.randint(0, 12))]
        if d % 3 == 0:
            own += block[rnd.randint(0, 4): rnd.randint(5, 12)]
        rows.append((d, "\n".join(own)))
    rows += [(90 + k, "\n".join(block)) for k in range(4)] + [(5, rows[5][1]), (None, rows[7][1]), (200, None), (201, "")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, text string, line string, words string")
    got = linedup.dedup_lines(df, min_words=4, chunk=chunk)
    assert got.columns == ["doc_id", "text", "line", "words", "n_removed_lines"]
    assert sorted(((r["doc_id"], r["text"], r["n_removed_lines"]) for r in got.collect()), key=str) == brute(rows, 4)


def test_empty_table(spark):
    assert linedup.dedup_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_columns_named_like_its_own(spark):
    names = ["_own", "_doc", "_key", "_ranges", "run_doc", "own_key", "gone_at", "Line_Parts"]
    text = "one two three four five\nsix seven eight nine ten"
    df = spark.createDataFrame([(1, text, *names, 7), (2, text, *names, 7)], ["doc_id", "text", *names, "n_removed_lines"])
    got = {r["doc_id"]: r for r in linedup.dedup_lines(df).collect()}
    assert all(got[i][c] == c for i in got for c in names)
    assert [(got[i]["text"], got[i]["n_removed_lines"]) for i in (1, 2)] == [(text, 0), ("", 2)]
    assert linedup.dedup_lines(df, removed=None).columns == df.columns
