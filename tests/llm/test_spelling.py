import random
import re
import zlib
from collections import Counter

from answerloom.llm import spelling


def words_of(rows):
    counts = Counter()
    for i, text in rows:
        for raw in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute_force(words):
    near = {a: [b for b in words if one_edit(a, b)] for a in words}
    form = {}
    for a in words:
        best = min(near[a], key=lambda b: (-words[b], b), default=None)
        form[a] = best if best is not None and words[best] >= 5 * words[a] else None

    def root(a):
        while form[a] is not None:
            a = form[a]
        return a

    return [(a, form[a], root(a), n, len(near[a]), words.get(form[a])) for a, n in words.items()]


def misspelt(rnd, word, letters):
    at, kind = rnd.randrange(len(word)), rnd.randrange(3)
    if kind == 0:
        return word[:at] + word[at + 1:]
    return word[:at] + rnd.choice(letters) + word[at + (kind == 1):]


def test_variants_equal_brute_force(spark):
    rnd, letters = random.Random(3), "abcé"
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randint(6, 13))) for _ in range(40)]
    texts = []
    for word in base:
        texts += [word.upper()] * rnd.choice((5, 30, 200))
        for _ in range(6):
            variant = misspelt(rnd, word, letters)
            texts += [variant] * rnd.choice((3, 5, 7, 40))
            texts += [misspelt(rnd, variant, letters)] * 5
    rnd.shuffle(texts)
    rows = [(i, " ".join(texts[i * 30:(i + 1) * 30])) for i in range(len(texts) // 30 + 1)]
    rows += [(None, "nullid-nullid nullid nullid\tnullid"), (3, rows[3][1]), (900, None), (901, ""), (902, "12 !"), (903, "x" * 100_000)]
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id bigint, text string, word string, n int")
    want = brute_force(words_of(rows))
    got = spelling.group_variants(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(w[1] is not None for w in want) > 30 and any(w[1] != w[2] for w in want if w[1])
    assert spelling.group_variants(df.limit(0)).count() == 0


def test_every_near_pair_shares_a_key(spark):
    rnd = random.Random(8)
    words = set()
    for _ in range(300):
        word = "".join(rnd.choice("ab") for _ in range(rnd.randint(6, 9)))
        words |= {word, misspelt(rnd, word, "ab")}
    words = sorted(w for w in words if len(w) >= 6)
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")
    got = {(r["a"], r["b"]) for r in spelling.near_words(df).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)} and len(got) > 500
