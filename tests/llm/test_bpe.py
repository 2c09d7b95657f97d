import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken

from answerloom.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    "Hello world, it's 2024!", "", None, "   leading  and   double spaces\n\n tabs\tand nbsp ", "aaaaaaaaaaaa" * 60,
    "naïve Straße 東京 🙂🙂 'll 've", "\x00\x01 control", "\r\n \n  x", "x" * 97 + "the" * 40, "word " * 3000, "0123456789" * 30, "a b", "a  b", " ", "　x y"]


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_round_trip_equals_tiktoken(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "null id", 2), (0, TEXTS[0], 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    enc = reference()
    want = []
    for i, t, _ in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = bpe.round_trip(df, RANKS, public_tokenizers.PATTERN)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    encoded = bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    assert sorted([(r[0], r[1]) for r in encoded.collect()], key=str) == sorted([(i, enc.encode_ordinary(t or "")) for i, t, _ in rows], key=str)
    decoded = bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).select("doc_id", "decoded").collect()
    assert sorted([(r[0], bytes(r[1])) for r in decoded], key=str) == sorted([(i, (t or "").encode()) for i, t, _ in rows], key=str)
    assert bpe.round_trip(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_very_long_text_decodes_in_slices():
    coder, text = bpe.Codec(RANKS, public_tokenizers.PATTERN), "abcdx efghy " * 1_000_000
    ids = np.frombuffer(coder.encode([text])[0], "<u4")
    assert len(ids) > 3_500_000 and ids.tolist() == reference().encode_ordinary(text)
    assert coder.decode([ids[:0], ids, ids[:3]]) == [b"", text.encode(), reference().decode(ids[:3].tolist()).encode()]
    coder.close()


def test_words_of_an_older_generation_are_still_right(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    coder, enc = bpe.Codec(RANKS, public_tokenizers.PATTERN), reference()
    for turn in range(6):
        texts = [f"wordly{k} thing{k + turn} again, again" for k in range(4)]
        assert [np.frombuffer(i, "<u4").tolist() for i in coder.encode(texts)] == [enc.encode_ordinary(t) for t in texts]
    coder.close()
