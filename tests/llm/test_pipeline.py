"""The pipeline's stages in the form in which it calls them: nulls, repeats, clashing columns, empty tables."""

import random

import pytest

import corpus_pipeline as pipeline

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, class string, copy_doc string, language_found string, n_removed_lines string"
EXTRA = ("own class", "own copy", "own language", "own lines")
STAGES = dict(pipeline.STAGES)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *EXTRA) for i, t in rows], COLUMNS)


def prose(seed, n=60):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(("river", "stone", "walk", "over", "green", "hill")) + str(rnd.randrange(400)) for _ in range(n))


def kept(stage, spark, rows):
    df = docs(spark, rows)
    got = STAGES[stage](spark, df, "/root/testdata/sf0.001")
    assert got.columns == df.columns
    found = got.collect()
    assert all(tuple(r)[5:] == EXTRA for r in found)
    return sorted(((r["doc_id"], r["text"]) for r in found), key=str)


def test_near_copies_are_decided_by_row(spark):
    a, b, c = prose(1), prose(2), prose(3)
    near = a.replace(a.split()[59], "changed")
    rows = [(1, a), (2, near), (3, b), (3, near), (4, c), (4, c), (4, c), (5, None), (5, None), (6, ""), (None, a), (None, a), (7, "one"), (8, "one")]
    want = [(1, a), (3, b), (4, c), (5, None), (5, None), (6, ""), (None, a), (None, a), (7, "one")]
    assert kept("near_copies", spark, rows) == sorted(want, key=str)


def test_near_copies_that_share_their_id(spark):
    a = prose(4)
    near = a.replace(a.split()[59], "changed")
    got = kept("near_copies", spark, [(1, a), (1, near), (2, near)])
    assert len(got) == 1 and got[0][0] == 1


def test_lines(spark):
    a, b = "\n".join(prose(5).split(" over")), prose(6)
    got = kept("line_dedup", spark, [(1, a), (2, f"{a}\n{b}"), (3, None), (4, ""), (None, b), (2, f"{a}\n{b}")])
    assert got == sorted([(1, a), (2, ""), (2, ""), (3, None), (4, ""), (None, b)], key=str)


def test_benchmark(spark):
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first()["text"]
    got = kept("decontamination", spark, [(1, f"{prose(7)} {item}"), (2, prose(7)), (3, None), (4, ""), (None, prose(8)), (2, prose(7))])
    assert got == sorted([(2, prose(7)), (2, prose(7)), (3, None), (4, ""), (None, prose(8))], key=str)


def test_language_rejects_texts_without_letters(spark):
    words = "the people of the town and the river were in the green hills with all that they had"
    got = kept("language", spark, [(i, f"{words} {i}") for i in range(40)] + [(50, None), (51, ""), (52, "12 34"), (None, words)])
    assert {i for i, _ in got} == {*range(40), None}


@pytest.mark.parametrize("stage", list(STAGES))
def test_empty_table(spark, stage):
    assert STAGES[stage](spark, docs(spark, [(1, "x")]).limit(0), "/root/testdata/sf0.001").count() == 0
