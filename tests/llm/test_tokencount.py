import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from answerloom.llm import tokencount

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
SPECIAL = "<|endoftext|>"
TEXTS = [
    "Hello world, it's what they're after, we'll see, I've 'rx", "", None, "  two  gaps\n\n \tand an end \n", f"a {SPECIAL} b{SPECIAL}{SPECIAL} <|endof",
    "naïve Straße 東京 🙂🙂 ͸\U00010940 ՘x", "\x1c\x1d  　x", "aaaaaaa" * 40, "tion ing the" * 30, "0123456789 " * 20, f"x  {SPECIAL}"]


@pytest.fixture(scope="module")
def library():
    held = Tokenizer.from_file(PATH)
    return lambda text: len(held.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return tokencount.counter_of(PATH, PATTERN)


def test_every_prefix_equals_the_library(counter, library):
    rnd = random.Random(5)
    letters = ["ab", "aA ", "'srevlld t", "abc'\n \t", "éß東🙂 a", "\x1c \xa0a", f"{SPECIAL} a", "01 !'", "tion ing the", " \r\n　x"]
    texts = [t or "" for t in TEXTS]
    for _ in range(800):
        some = rnd.choice(letters)
        text = "".join(rnd.choice(some) for _ in range(rnd.randint(0, 15)))
        texts.append(text + SPECIAL + text[:3] if rnd.random() < 0.2 else text)
    for text in texts:
        assert counter.of_text(text).tolist() == [library(text[:k]) for k in range(len(text) + 1)], repr(text)


def test_slices_and_full_tables_change_nothing(counter, library, monkeypatch):
    monkeypatch.setattr(tokencount, "SLICE_CHARS", 7)
    monkeypatch.setattr(tokencount, "TABLE_CHARS", 20)
    text = "some words,  and  more\n\n words that aren't there  yet " * 5
    assert counter.of_text(text).tolist() == [library(text[:k]) for k in range(len(text) + 1)]


@pytest.mark.parametrize("text", ["a" * 200_000, "acgt" * 50_000, " " * 100_000 + "x", "word " * 200_000])
def test_very_long_texts(counter, library, text):
    counts = counter.of_text(text)
    assert len(counts) == len(text) + 1 and counts[-1] == library(text)


def test_counts_and_budgets(spark, library):
    rows = [(i, t, "x", -1) for i, t in enumerate(TEXTS)] + [(None, "null id", "x", -1), (0, TEXTS[0], "x", -1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, counts string, n_bytes int")
    got = tokencount.count_tokens(docs, PATH, PATTERN, limit=9).collect()

    def want(i, text):
        n = library(text)
        fits = max(k for k in range(len(text) + 1) if library(text[:k]) <= 9)
        return i, len(text.encode()), n, n > 9, fits

    assert sorted(map(tuple, got), key=str) == sorted((want(i, t or "") for i, t, _, _ in rows), key=str)
    held = {r["doc_id"]: r["counts"] for r in tokencount.prefix_counts(docs, PATH, PATTERN).collect()}
    assert held[2] == [0] and len(held[0]) == len(TEXTS[0]) + 1
    assert tokencount.count_tokens(docs.limit(0), PATH, PATTERN).count() == 0
