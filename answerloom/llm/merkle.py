"""Merkle manifest of a dataset by butterfly exchange: leaf, subroot, root and proof of every row.

Rows are leaves, ordered in each source by doc_id. Aligned blocks of FANOUT ** BLOCK_LEVELS leaves are hashed inside one
task each, up to the block's own root. Then the blocks exchange roots: in round r the up to 16 blocks whose numbers
differ only in digit r meet, each learns the others' nodes and hashes their parent for itself. So after the last round
every block knows all siblings above it, and no hash travels down again. Where the last, incomplete run lacks a block, the
tree's last block stands in for it. Sources exchange their subroots in the same way.

Defined cases: rows with the same doc_id in a source are ordered by their leaf, equal rows are leaves of their own; a null
doc_id comes first; a null source is a source of its own, before all others; a lone leaf is its own subroot and a lone
subroot the root, both with no siblings (the proof hash is then that of the empty string); an empty table gives an empty
result; a missing column counts as null, and columns other than the five of a leaf are not read.
"""

from __future__ import annotations

import hashlib
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import sorted_ordinal
from ..session import settle

FANOUT = 16
BLOCK_LEVELS = 3  # levels hashed inside one task: 4096 leaves a block
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
MANIFEST = "source_no bigint, doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _written(field: Column) -> Column:
    value = field.cast("string")
    return F.when(field.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_hash(text: Column, columns: dict[str, Column]) -> Column:
    """SHA-256 of the fields, each with its length, so that no two rows are written alike."""
    return F.sha2(F.concat(*[_written(text if f == "text" else columns[f]) for f in FIELDS]), 256)


def tampered_text(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves_of(docs: DataFrame) -> DataFrame:
    """source, doc_id, leaf and claimed (the leaf as it is presented: of the tampered row where 5 divides the id's CRC-32)."""
    kinds = {"doc_id": "bigint", "n_chars": "bigint"}
    columns = {f: (F.col(f) if f in docs.columns else F.lit(None)).cast(kinds.get(f, "string")) for f in FIELDS}
    touched = F.coalesce(F.crc32(columns["doc_id"].cast("string")) % 5 == 0, F.lit(False))
    claimed = F.when(touched, tampered_text(columns["text"])).otherwise(columns["text"])
    return docs.select(
        columns["source"].alias("source"), columns["doc_id"].alias("doc_id"), leaf_hash(columns["text"], columns).alias("leaf"),
        leaf_hash(claimed, columns).alias("claimed"))


def placed_leaves(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leaves with source_no, at (place in the source) and size (leaves of the source); and the numbered sources.

    A range sort numbers all leaves; a partition holds stretches of few sources, so what is joined back are stretches,
    and no source, however large, meets in one task.
    """
    order = ["source", "doc_id", "leaf", "tie"]  # equal rows must be able to part, too
    leaves = settle(leaves_of(docs).withColumn("tie", F.monotonically_increasing_id()))
    spread = leaves.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    fixed = settle(spread.withColumn("seq", F.monotonically_increasing_id()))
    stretches = fixed.groupBy(F.shiftright("seq", 33).alias("part"), "source").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    stretches = settle(stretches)
    sources = sorted_ordinal(stretches.groupBy("source").agg(F.sum("n").alias("size")), ["source"], "source_no")
    sources = settle(sources)
    one = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = stretches.withColumn("before", F.coalesce(F.sum("n").over(one), F.lit(0)))
    starts = starts.alias("p").join(sources.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))).select(
        "part", F.col("p.source").alias("source"), "first", "before", "size", "source_no")
    on = (F.shiftright(F.col("l.seq"), 33) == F.col("p.part")) & F.col("l.source").eqNullSafe(F.col("p.source"))
    placed = fixed.alias("l").join(starts.alias("p"), on).select(
        F.col("p.source_no"), F.col("p.size"), (F.col("l.seq") - F.col("p.first") + F.col("p.before")).alias("at"),
        "l.doc_id", "l.leaf", "l.claimed")
    return placed, sources


def _levels(size: int, most: int = 64) -> int:
    """Levels above `size` nodes until one is left."""
    out, n = 0, size
    while n > 1 and out < most:
        out, n = out + 1, -(-n // FANOUT)
    return out


def _hashed(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def block_levels(leaves: list[str], levels: int) -> list[list[str]]:
    """The nodes of a block at every level, from its leaves up to its root."""
    out = [leaves]
    for _ in range(levels):
        below = out[-1]
        out.append([_hashed(below[i: i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return out


def siblings(levels: list[list[str]], at: int) -> list[tuple[list[str], list[str]]]:
    """Left and right siblings of a leaf at each level of its block."""
    out = []
    for nodes in levels[:-1]:
        start = at - at % FANOUT
        out.append((nodes[start:at], nodes[at + 1: start + FANOUT]))
        at //= FANOUT
    return out


def block_roots(placed: DataFrame) -> DataFrame:
    """tree, at, total and node: one row for each block of leaves."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        size = table["size"][0].as_py()
        root = block_levels(table["leaf"].to_pylist(), _levels(size, BLOCK_LEVELS))[-1][0]
        return pa.table({"tree": table["source_no"][:1], "at": table["block"][:1], "total": [-(-size // FANOUT ** BLOCK_LEVELS)], "node": [root]})

    return placed.select("source_no", "block", "size", "at", "leaf").groupBy("source_no", "block").applyInArrow(
        run, "tree bigint, at bigint, total bigint, node string")


def butterfly(nodes: DataFrame) -> DataFrame:
    """tree, at, node (the tree's root) and path: the left and right siblings of the node on its way up, level by level.

    nodes: tree, at (from 0, without gaps), total (nodes of the tree) and node. Runs one job per round.
    """
    path = F.array().cast("array<struct<left:array<string>,right:array<string>>>")
    held = settle(nodes.select("tree", "at", "total", "node", path.alias("path")))
    rounds = _levels(held.agg(F.max("total")).first()[0] or 0)
    step = 1
    for _ in range(rounds):
        own = held.withColumn("low", F.col("at") % step).withColumn("digit", F.floor(F.col("at") / step) % FANOUT).withColumn(
            "high", F.floor(F.col("at") / (step * FANOUT)))
        # The last block also speaks for the blocks that its incomplete run lacks, where a complete run has their partners.
        lone = own.filter((F.col("at") == F.col("total") - 1) & (F.col("digit") > 0) & (F.col("low") < step - 1))
        deputies = lone.withColumn("low", F.explode(F.sequence(F.col("low") + 1, F.lit(step - 1).cast("bigint")))).withColumn(
            "at", F.lit(None).cast("bigint"))
        group = Window.partitionBy("tree", "high", "low")  # FANOUT rows at most
        met = own.unionByName(deputies.select(own.columns)).withColumn("all", F.array_sort(F.collect_list(F.struct("digit", "node")).over(group)))
        others = lambda side: F.transform(F.filter("all", side), lambda x: x["node"])
        above = F.struct(others(lambda x: x["digit"] < F.col("digit")).alias("left"), others(lambda x: x["digit"] > F.col("digit")).alias("right"))
        grown = F.col("total") > step  # else the tree is done
        held = settle(met.filter("at is not null").select(
            "tree", "at", "total",
            F.when(grown, F.sha2(F.array_join(F.transform("all", lambda x: x["node"]), ""), 256)).otherwise(F.col("node")).alias("node"),
            F.when(grown, F.concat("path", F.array(above))).otherwise(F.col("path")).alias("path")))
        step *= FANOUT
    return held.select("tree", "at", "node", "path")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and source_no for every row. Runs jobs while the plan is built."""
    placed, _ = placed_leaves(docs)
    placed = settle(placed.withColumn("block", F.floor(F.col("at") / FANOUT ** BLOCK_LEVELS)))
    blocks = butterfly(block_roots(placed))
    subroots = blocks.filter("at = 0").select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("at"), "node")
    sources = butterfly(subroots.withColumn("total", F.lit(subroots.count()).cast("bigint")))
    uppers = blocks.alias("b").join(sources.alias("s"), F.col("b.tree") == F.col("s.at")).select(
        F.col("b.tree").alias("source_no"), F.col("b.at").alias("block"), F.col("b.node").alias("subroot"), F.col("s.node").alias("root"),
        F.concat("b.path", "s.path").alias("path"))

    def run(own: pa.Table, upper: pa.Table) -> pa.Table:
        own = own.sort_by("at")
        leaves, claimed, size = own["leaf"].to_pylist(), own["claimed"].to_pylist(), own["size"][0].as_py()
        levels = block_levels(leaves, _levels(size, BLOCK_LEVELS))
        above = [(x["left"], x["right"]) for x in upper["path"][0].as_py()]
        tail = "".join("".join(left + right) for left, right in above)
        subroot, root = upper["subroot"][0].as_py(), upper["root"][0].as_py()
        proofs, folded, known = [], [], {}
        for at, node in enumerate(claimed):
            beside = siblings(levels, at)
            proofs.append(_hashed(["".join(left + right) for left, right in beside] + [tail]))
            for left, right in beside:
                node = _hashed([*left, node, *right])
            if node not in known:  # untampered rows of a block meet at the block's root
                top = node
                for left, right in above:
                    top = _hashed([*left, top, *right])
                known[node] = top
            folded.append(known[node])
        n = len(leaves)
        return pa.table({
            "source_no": own["source_no"], "doc_id": own["doc_id"], "leaf": own["leaf"], "subroot": [subroot] * n, "root": [root] * n,
            "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded]})

    cut = placed.groupBy("source_no", "block")
    return cut.cogroup(uppers.groupBy("source_no", "block")).applyInArrow(run, MANIFEST).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "source_no")
