"""Small fixtures with nulls, repeats, empty tables and clashing column names, against brute force where there is one."""

import hashlib
import json
import random
import re
import zlib

import pytest

from answerloom.llm import chat, decontam, htmltext, langid, ngramjoin, quality, sharding, urlfilter

EXTRA = ("x", "y")  # values of extra columns whose names clash with the operators' own


def documents(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, class string")


def doc(i, text, lang="en"):
    return (i, text, lang, "s", None)


def prose(rnd, n):
    return " ".join(rnd.choice(("the", "of", "river", "stone", "walks", "over", "green", "hill", "and", "quiet")) + rnd.choice(("", "s", "ed")) for _ in range(n))


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i: i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


@pytest.mark.parametrize("stars,long", [(ngramjoin.STAR_ROUNDS, ngramjoin.LONG_LIST), (0, 1), (0, 10)])
def test_ngram_join_equals_brute_force(spark, monkeypatch, stars, long):
    monkeypatch.setattr(ngramjoin, "STAR_ROUNDS", stars)
    monkeypatch.setattr(ngramjoin, "LONG_LIST", long)  # 1: every list is refined
    rnd = random.Random(4)
    base = prose(rnd, 150)
    rows = []
    for i in range(60):
        words = (base if i % 2 else prose(rnd, rnd.choice((3, 40, 150)))).split()
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(len(words))] = rnd.choice(("new", "Other", "word"))
        rows.append(doc(i, " ".join(words)))
    rows += [doc(100, None), doc(101, ""), doc(102, "one"), doc(103, "ONE"), doc(None, base), doc(1, rows[1][1]), doc(104, "two words"), doc(105, base.upper())]
    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {i: i for i in sets if i is not None}
    changed = True
    while changed:
        changed = False
        for a in root:
            for b in root:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 90 * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    want = sorted(((r[0], len(shingles(r[1])), root.get(r[0])) for r in rows), key=str)
    got = ngramjoin.join(documents(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert len({root[i] for i in root}) < len(root) - 10


def test_ngram_join_past_leaders_of_another_size(spark):
    def texts(seed):
        rnd = random.Random(seed)
        said = [f"w{rnd.random()}" for _ in range(100)]
        other = " ".join(f"v{rnd.random()}" for _ in range(150))
        return f"{' '.join(said)} {other}", " ".join(said), " ".join([*said[:50], "changed", *said[51:]]), other

    def key(text):
        return int.from_bytes(hashlib.blake2b(ngramjoin.shingle_set(text, 3).tobytes(), digest_size=8).digest(), "little", signed=True)

    sets = spark.createDataFrame([(i, *(key(t) for t in texts(i)[:3])) for i in range(40)], "seed int, a bigint, b bigint, c bigint")
    for turn in range(ngramjoin.STAR_ROUNDS):  # the long text leads every list in each star round
        draw = lambda x: f"xxhash64({x}, {turn})"  # noqa: B023, E731
        sets = sets.filter(f"{draw('a')} < least({draw('b')}, {draw('c')})")
    long, b, c, other = texts(sets.first()["seed"])
    rows = [doc(1, long), doc(2, b), doc(3, c), *[doc(i, other) for i in range(4, 9)]]
    got = {r["doc_id"]: r["component_id"] for r in ngramjoin.join(documents(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 2, **dict.fromkeys(range(4, 9), 4)}


def test_ngram_join_of_nothing(spark):
    assert ngramjoin.join(documents(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("weights", [(0.0, 20.0, 500.0), (500.0, 500.0, 500.0), (20.0, 20.0, 20.0), (0.0, 0.0, 3.0)])
@pytest.mark.parametrize("percent", [90, 80])
def test_prefix_signatures_meet_for_all_close_sets(weights, percent):
    import numpy as np

    def sign(s):
        found, short, _ = ngramjoin.prefix_signatures(s, np.choose(s % 3, weights), ngramjoin.losses(len(s), percent))
        return set(found[:short]), set(found)

    rnd, met = np.random.default_rng(1), 0
    for _ in range(2000):
        n = int(rnd.integers(2, 120))
        a = np.unique(rnd.integers(0, 1 << 40, n))
        b = a.copy()
        at = rnd.integers(0, len(b), int(rnd.integers(1, max(2, len(a) // 8))))
        b[at] = rnd.integers(0, 1 << 40, len(at))
        b = np.unique(b[rnd.integers(0, 3) * (len(b) > 30):])
        both = len(np.intersect1d(a, b))
        if 100 * both < percent * len(np.union1d(a, b)) or np.array_equal(a, b):
            continue
        small, large = sorted((sign(a), sign(b)), key=lambda x: len(x[1])) if len(a) == len(b) else (sign(a), sign(b)) if len(a) < len(b) else (sign(b), sign(a))
        assert small[0] & large[1]
        assert len(a) != len(b) or large[0] & small[1]
        met += 1
    assert met > 400


def test_parts_needed_are_part_numbers(spark):
    got = spark.range(1, 3000).select("id", ngramjoin._parts_needed(ngramjoin.F.col("id")).alias("parts")).collect()
    assert all(r["parts"] == ngramjoin.part_numbers(r["id"])[-1] >= r["id"] for r in got)


@pytest.mark.parametrize("percent", [90, 80])
def test_refined_pairs_hold_all_close_pairs_and_few_others(spark, monkeypatch, percent):
    rnd = random.Random(percent)
    base = [rnd.choice(("oak", "elm", "ash", "fir", "yew")) + str(rnd.randrange(40)) for _ in range(100)]
    rows = []
    for i in range(150):
        words = base[:]
        for _ in range(rnd.randint(1, 7) if i else 0):
            words[rnd.randrange(len(words))] = f"own{rnd.random()}" if i % 3 else rnd.choice(base)
        rows.append(doc(i, " ".join(words)))
    sets = {r[0]: shingles(r[1]) for r in rows}
    close = {(a, b) for a in sets for b in sets if a < b and sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    docs = documents(spark, rows)
    described = ngramjoin.described_sets(docs, 3).dropDuplicates(["class"])
    ids = {r["class"]: r["doc_id"] for r in described.collect()}
    members = described.selectExpr("1L sig", "class", "n", "class own")
    found = ngramjoin.refined_pairs(members, described.select("class", "doc_id"), docs, 3, percent).collect()
    found = {tuple(sorted((ids[r["a"]], ids[r["b"]]))) for r in found}
    by_set = {frozenset(sets[d]): d for d in ids.values()}
    same = lambda d: by_set[frozenset(sets[d])]
    assert {tuple(sorted((same(a), same(b)))) for a, b in close} <= found
    assert len(close) > 30 and len(found) < len(ids) * (len(ids) - 1) // 3


def test_quality(spark):
    good = "\n".join(" ".join(f"word{i}of{k}" for k in range(20)) + "." for i in range(4))
    menu = good.split("\n")[0] + "\n" + "\n".join(f"Home {i} | About {i} | Contact us now {i} | More of this and that and the other {i}" for i in range(9))
    rows = [doc(1, good), doc(2, menu), doc(3, None), doc(4, ""), doc(5, "a b a b a b"), doc(None, good), doc(1, good), doc(6, " \t\n")]
    got = {(r["doc_id"], r["n_words"]): r for r in quality.judge(documents(spark, rows)).collect()}
    kept = {k[0]: r["kept"] for k, r in got.items()}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False, None: True, 6: False}
    assert got[(5, 6)]["n_repeat_words"] == 6 and got[(5, 6)]["word_chars"] == 6 and got[(3, 0)]["base_failed"]
    assert quality.judge(documents(spark, rows).limit(0)).count() == 0


def test_sharding(spark):
    rnd = random.Random(2)
    rows = [doc(i, "z" * 50 if i % 3 == 0 else "é" * rnd.randint(0, 90)) for i in range(400)] + [doc(None, None), doc(3, "z" * 50), doc(3, "z" * 50)]
    got = sharding.shard_records(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(16)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    crc = sorted(zlib.crc32((r[1] or "").encode()) for r in rows)
    assert sorted(r["text_crc32"] for r in got) == crc
    assert sharding.shard_records(documents(spark, rows).limit(0)).count() == 0


def test_language(spark):
    rnd = random.Random(3)
    german = lambda n: " ".join(rnd.choice(("der", "und", "schön", "ungefähr", "nicht", "zeitung", "straße")) for _ in range(n))
    rows = [doc(i, prose(rnd, 30), "en") if i % 2 else doc(i, german(30), "de") for i in range(200)]
    rows += [doc(900, None), doc(901, "123 !!"), doc(902, german(20), None), doc(None, prose(rnd, 20)), doc(1, rows[1][1])]
    df = documents(spark, rows)
    got = langid.identify(df, langid.train(df)).collect()
    found = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert found[900]["lang_pred"] == found[901]["lang_pred"] == "und" and found[902]["lang_pred"] == "de" and found[None]["lang_pred"] == "en"
    assert sum(found[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(200)) >= 198
    assert langid.accepted(df, langid.train(df), 0.2).columns == df.columns
    empty = df.limit(0)
    assert langid.train(empty) is None and langid.identify(empty, None).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df, None).collect()} == {"und"}


def test_urls(spark):
    rows = [(1, "http://a.EXAMPLE.com/en/1?x#y"), (2, "https://www.example.com/en/"), (3, "http://x.net/es/1"), (4, "http://cheap-pills.example.org/en/2"),
            (5, None), (6, "no scheme"), (7, "http://com"), (8, "x://y://z/w"), (1, "http://a.EXAMPLE.com/en/1?x#y"), (9, "https://library.museum.org/maps")]
    got = urlfilter.judge_urls(spark.createDataFrame([(*r, "h") for r in rows], "page_id bigint, url string, host string")).collect()
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert len(got) == len(rows)
    assert by[1] == ("a.example.com", "/en/1", "example.com/en/", "block") and by[2][2:] == ("www.example.com/en/", "allow")
    assert by[3][2:] == ("net/es/", "block") and by[4][2:] == (None, "block") and by[9][3] == "allow"
    assert by[5][:3] == by[6][:3] == ("", "", None) and by[7][:3] == ("com", "", None) and by[8][:2] == ("y:", "//z/w")


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(20, 40)))) for i in range(30)] + [(50, None), (51, ""), (1, "again")]
    items[1] = (1, items[1][1])
    rows = [doc(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 300))) + (" " + items[i % 30][1] + " tail" if i % 4 == 0 else "")) for i in range(60)]
    rows += [doc(None, items[2][1]), doc(70, None), doc(71, "")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = documents(spark, rows)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(df, bench).collect()}
    texts = {i: min(t for j, t in items if j == i) for i, t in items if t}
    want = {(r[0], i) for r in rows for i, t in texts.items() if decontam.grams(decontam.words(t)) <= decontam.grams(decontam.words(r[1]))}
    assert got == want and len(want) >= 15
    clean = decontam.without_leaks(df, bench)
    assert clean.columns == df.columns
    assert sorted((r["doc_id"] for r in clean.collect()), key=str) == sorted((r[0] for r in rows if r[0] not in {w[0] for w in want}), key=str)
    assert decontam.find_leaks(df, bench.limit(0)).count() == 0


def test_short_items_leak_wherever_they_stand(spark):
    items = [(1, "Zanzibar"), (2, "quick brown fox"), (3, "one two three four five"), (4, "Who wrote Hamlet? William Shakespeare"),
             (5, "Is the sea salty? Yes it is very much so indeed"), (6, "Why? Because"), (7, "?!"), (8, "Name a river that flows north? The Nile")]
    rnd = random.Random(4)
    rows = [doc(10 * i + k, " ".join((prose(rnd, k * 20), text, prose(rnd, k * 15))).strip()) for i, text in items for k in range(3)]
    rows += [doc(900, "brown quick fox, one two four three five; who wrote it? William wrote Hamlet. is the sea salty ? !"), doc(901, "fox"), doc(902, None)]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(documents(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    plain = lambda text: f" {' '.join(decontam.words(text))} "
    want = {(r[0], i) for r in rows for i, t in items if i != 7 and r[1] and plain(t) in plain(r[1])}
    assert got == want and len(want) == 21
    left = decontam.without_leaks(documents(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted(r["doc_id"] for r in left.collect()) == [70, 71, 72, 900, 901, 902]


def test_html(spark):
    page = ('<html><body><header><h1>Site</h1></header><div id="sidebar"><p>About us.</p></div><div class="content"><h1>Title</h1><p>Hello &amp; world,\n this is '
            'an article. It has text.</p><p>Second, with words.</div><section class="comments"><p>Nice one, thanks.</p></section></body></html>')
    rows = [(1, page), (2, None), (3, ""), (4, "<article><p>Only.</p></article>"), (1, page), (None, "<p>unclosed")]
    got = htmltext.extract(spark.createDataFrame([(i, "u", h, "t") for i, h in rows], "page_id bigint, url string, html string, text string")).collect()
    text = {r["page_id"]: (r["text"], r["n_chars"]) for r in got}
    assert len(got) == len(rows) and text[2] == text[3] == ("", 0) and text[4] == ("Only.", 5)
    assert text[1][0] == "Title Hello & world, this is an article. It has text. Second, with words."


@pytest.mark.parametrize("attrs", ['title="The hidden river"', "data-t='a hidden lake'", 'class="md:block hidden lg:flex"', 'title="display:none"', "data-hidden=1"])
def test_html_keeps_what_only_names_hidden(attrs):
    _, nodes = htmltext.parse(f"<article {attrs}><p>Words.</p></article>")
    assert not any(n.hidden for n in nodes)


@pytest.mark.parametrize("attrs", ["hidden", 'HIDDEN=""', 'title="a" hidden', 'style="color: red; DISPLAY : none"', "style=display:none", "hidden=until-found"])
def test_html_drops_what_is_hidden(attrs):
    _, nodes = htmltext.parse(f"<article><p {attrs}>Words.</p></article>")
    assert [n.hidden for n in nodes] == [False, False, True]


def test_calls_and_results_of_one_turn(spark):
    calls = lambda *ids: json.dumps({"tool_calls": [{"id": i, "name": "reply", "arguments": {"text": "x", "turn": 1}} for i in ids]})
    gives = lambda i: json.dumps({"tool_call_id": i, "content": i})
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", calls("a", "b")), (1, 1, "assistant", calls("c")), (1, 1, "assistant", "Wait."), (1, 1, "assistant", "Wait."),
            *[(1, 2, "tool", gives(i)) for i in "abc"], (1, 2, "tool", gives("a"))]
    got = chat.link(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert sorted((r["call_id"], r["status"]) for r in got) == [("a", "linked"), ("b", "linked"), ("c", "linked"), ("turn-0", "linked")]
    assert {r["call_id"]: json.loads(r["message"])["result"] for r in got} == {"a": "a", "b": "b", "c": "c", "turn-0": "Wait."}


def test_tool_calls(spark):
    call = lambda i, after=None: {"id": i, "name": "reply", "arguments": {"turn": 1, "text": "x"}, "depends_on": after}
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "ho"), (1, 2, "user", None), (1, 1, "assistant", "ho"), (2, 1, "assistant", "alone"), (None, 1, "user", "x"),
            (3, 0, "assistant", json.dumps({"tool_calls": [call("b", "a"), call("a"), call("p", "q"), call("q", "p")]})),
            (3, 1, "tool", json.dumps({"tool_call_id": "a", "content": {"z": 1, "b": 2}})), (4, 0, "user", "{not json")]
    df = spark.createDataFrame([(*r, "n") for r in rows], "conv_id bigint, turn bigint, role string, text string, name string")
    got = {(r["conv_id"], r["call_id"]): r for r in chat.link(df).collect()}
    assert set(got) == {(1, "turn-0"), (1, "turn-2"), (2, "turn-0"), (3, "a"), (3, "b"), (3, "p"), (3, "q"), (4, "turn-0")}
    assert got[1, "turn-0"]["message"] == '{"arguments":{"text":"hi","turn":0},"id":"turn-0","name":"reply","result":"ho"}'
    assert (got[1, "turn-2"]["level"], got[1, "turn-2"]["valid"], got[1, "turn-2"]["status"]) == (1, False, "no result")
    assert got[2, "turn-0"]["status"] == "orphan result" and got[3, "b"]["level"] == 1 and got[3, "p"]["level"] is None
    assert json.loads(got[3, "a"]["message"])["result"] == {"b": 2, "z": 1} and got[3, "a"]["valid"]
    assert chat.link(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op3_quality_rules", "op10_tool_calls", "op11_spelling_variants", "op12_merkle_manifest"])
def test_query_equals_sql(spark, name):
    import duckdb

    from answerloom.llm import queries
    from tools.compare import TABLES, rows_of

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df, cur = queries.QUERIES[name](spark, folder), con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())
