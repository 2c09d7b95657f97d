"""Ranks, running sums and lookups against brute force, with one group holding most rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from answerloom.operators import ranking, sampling


def skewed(spark, n=3000):
    return spark.range(n).select(
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("grp"))


def test_hash_rank_is_a_plain_ranking(spark):
    df = skewed(spark)
    rows = df.collect()
    got = {r.key: (r.rank, r.group_size) for r in ranking.hash_rank(df, ["key"], by=["grp"], op="t").collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r.grp, []).append((hashlib.md5(f"42|t|{r.key}".encode()).hexdigest(), r.key))
    want = {key: (i, len(g)) for g in groups.values() for i, (_, key) in enumerate(sorted(g), 1)}
    assert got == want


def test_hash_rank_handles_null_groups(spark):
    df = spark.createDataFrame([("a", None), ("b", None), ("c", "x")], "key string, grp string")
    got = {r.key: r.group_size for r in ranking.hash_rank(df, ["key"], by=["grp"]).collect()}
    assert got == {"a": 2, "b": 2, "c": 1}


def test_sorted_ordinal(spark):
    df = skewed(spark)
    got = {r.key: r.ordinal for r in ranking.sorted_ordinal(df, ["key"]).collect()}
    assert got == {k: i for i, k in enumerate(sorted(r.key for r in df.collect()))}
    per = ranking.sorted_ordinal(df, ["key"], by=["grp"]).collect()
    hot = sorted(r.key for r in per if r.grp == "hot")
    assert [r.ordinal for r in sorted(per, key=lambda r: r.key) if r.grp == "hot"] == list(range(len(hot)))


def test_running_total(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 5).alias("v"))
    rows = sorted(ranking.running_total(df, [-F.col("id")], "v").collect(), key=lambda r: -r.id)
    total = 0
    for r in rows:
        total += r.v
        assert r.running == total


def test_lookup_with_hot_and_missing_keys(spark):
    fact = skewed(spark).withColumn("grp", F.when(F.col("key") == "k5", F.lit(None)).otherwise(F.col("grp")))
    dim = fact.filter("grp is not null and grp <> 'g3'").groupBy("grp").agg(F.count("*").alias("n")).withColumn("val", F.upper("grp"))
    got = ranking.lookup(fact, dim, "grp", ["val"], "n", F.col("key")).collect()
    assert len(got) == 3000
    for r in got:
        assert r.val == (None if r.grp in (None, "g3") else r.grp.upper())


def test_evenly_spaced_rounds_half_to_even(spark):
    got = {r.n: r.p for r in spark.createDataFrame([(1,), (5,), (8,), (12,), (100,)], "n int").select(
        "n", ranking.evenly_spaced(F.col("n"), 8).alias("p")).collect()}
    for n, p in got.items():
        k = min(8, n)
        want = [n // 2] if k == 1 else list(range(n)) if k >= n else [round(i * ((n - 1) / (k - 1))) for i in range(k)]
        assert p == want, n


def test_exact_samples(spark):
    df = spark.range(1001).select(F.col("id").cast("string").alias("key"))
    assert sampling.sample_exact(df, ["key"], 0.1).count() == 101
    assert sampling.sample_exact(df, ["key"], 0.1, rounding="floor").count() == 100
    assert sampling.sample_exact(df, ["key"], 5000).count() == 1001
    assert sampling.sample_exact(df, ["key"], 0.00001, rounding="floor").count() == 1


def test_group_split_keeps_groups_whole_and_strata_even(spark):
    df = spark.range(2000).select(
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("clip"),
        F.when(F.col("id") < 700, "big").when(F.col("id") < 1900, F.concat(F.lit("g"), F.floor(F.col("id") / 4).cast("string"))).alias("group_id"),
        F.when(F.col("id") % 2 == 0, "punch").otherwise("kick").alias("action"))
    out = sampling.group_split(df, train=0.8, val=0.1).collect()
    assert len(out) == 2000
    where = {}
    for r in out:
        where.setdefault(r.group_id or r.clip, set()).add(r.split)
    assert all(len(s) == 1 for s in where.values())
    assert {s for v in where.values() for s in v} == {"train", "val", "test"}


def test_shards_cover_everything(spark):
    for total in (3, 20, 21):
        df = spark.range(total).select(F.format_string("%03d", F.col("id")).alias("key"))
        for rule in ("balanced", "ceil_chunk", "round_robin", "floor_chunk"):
            rows = sorted(sampling.shard(df, ["key"], 7, rule).collect(), key=lambda r: r.key)
            got = [r["shard"] for r in rows]
            base, extra = divmod(total, 7)
            chunk = -(-total // 7)
            want = {
                "balanced": [i for i in range(7) for _ in range(base + (i < extra))],
                "ceil_chunk": [i // chunk for i in range(total)],
                "round_robin": [i % 7 for i in range(total)],
                "floor_chunk": [min(i // base, 6) if base else 6 for i in range(total)],
            }[rule]
            assert got == want, (rule, total)


def test_top_k_beyond_report_size(spark):
    from answerloom.operators.ranking import top_k
    from pyspark.sql import functions as F

    df = spark.range(5000).select((F.col("id") % 2).alias("g"), "id")
    got = top_k(df, 1500, [F.col("id").desc()], ["g"])
    assert got.columns == ["g", "id"]
    assert sorted(r["id"] for r in got.collect()) == list(range(2000, 5000))


@pytest.mark.parametrize("n", [7, 40, 1500])
def test_stratified_sample_equals_brute_force(spark, n):
    md5 = lambda *parts: hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    rows = [(i, "none" if i % 3 == 0 else None if i % 101 == 0 else f"s{i * i % 37:02d}") for i in range(4000)]
    df = spark.createDataFrame(rows, "id int, s string")
    got = {(r.id, r.s) for r in sampling.stratified_sample(df, "s", "id", n).collect()}
    kept = max(1, int(n * 0.15))
    names = sorted({s for _, s in rows if s not in ("none", None)})
    per = max((n - kept) // len(names), 1)
    extra = n - kept - per * len(names)
    want = []
    for s in {s for _, s in rows}:
        quota = kept if s == "none" else per + (s is not None and names.index(s) < extra)
        own = sorted((md5(42, "strata", i), i) for i, x in rows if x == s)
        want += [(i, s) for _, i in own[:quota]]
    want.sort(key=lambda r: (md5(42, "strata_cut", r[0]), r[0]))
    assert got == set(want[:n])
