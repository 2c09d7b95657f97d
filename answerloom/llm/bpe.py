"""Byte-level BPE by recursive DuckDB queries inside each Spark partition.

A partition's distinct words become rows (word, position, token id, next id, next position). Each round of a
recursive query joins the adjacent pairs with the merge table, takes each word's leftmost pair of least rank and
contracts it, until no pair is left to merge. A pre-token that is itself in the vocabulary is one token, as in
the tiktoken library. Decoding joins ids with the vocabulary and concatenates by an ordered aggregation.

Defined cases: a null or empty text has no ids and decodes to no bytes; rows with a null or repeated doc_id are
encoded like any other; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

QUERY_BYTES = 250_000  # bytes of distinct words in one recursive query
LONG_WORD = 96  # longer words contract all safe occurrences of a pair in a round
CACHE_WORDS = 150_000  # words met since the last change of generation; the generation before is kept, too
ENCODE_CHARS = 2_000_000  # characters of the texts encoded together, one document at least
DECODE_TOKENS = 400_000  # ids in one decoding query; longer rows are decoded in slices
ENCODED = "doc_id bigint, ids array<int>"

ENCODE = """
with recursive step(word, pos, id, nid, npos, done) as (
  select word, pos, id, nid, npos, false from start
  union all (
    with best as (
      select word, min((m.rank::bigint << 32) | pos) as pick, arg_min(npos, (m.rank::bigint << 32) | pos) as gone
      from step join merges m on not done and m.pair = id::bigint * 65536 + nid group by word),
    removed as (
      select s.word, s.pos as gpos, s.nid as gnid, s.npos as gnpos, pick
      from step s join best on s.word = best.word and s.pos = best.gone)
    select s.word, s.pos,
      case when s.pos = pick & 4294967295 then (pick >> 32)::int else s.id end,
      case when s.npos = pick & 4294967295 then (pick >> 32)::int
           when s.pos = pick & 4294967295 then gnid else s.nid end,
      case when s.pos = pick & 4294967295 then gnpos else s.npos end, r.word is null
    from step s left join removed r on s.word = r.word where not s.done and s.pos is distinct from gpos))
select word, list(id order by pos) as ids from step where done group by word
"""

# One round for long words. A pair may be contracted everywhere at once if its token is part of no token of
# lower rank: then no pair that this creates comes before the occurrences that are left.
LONG_ROUND = """
create or replace temp table long_next as
with pairs as (
  select word, pos, id, lead(id) over w as nid, row_number() over w as place from long_words window w as (partition by word order by pos)),
ranked as (
  select p.word, p.pos, p.place, m.rank, m.safe, min(m.rank) over (partition by p.word) as least
  from pairs p join merges m on m.pair = p.id::bigint * 65536 + p.nid),
hits as (
  select word, pos, place, rank, safe, row_number() over (partition by word order by pos) as nth from ranked where rank = least),
runs as (select *, row_number() over (partition by word, place - nth order by pos) as in_run from hits),
picked as (select word, place, rank from runs where (safe and in_run % 2 = 1) or nth = 1)
select p.word, p.pos, coalesce(c.rank, p.id)::int as id
from pairs p left join picked c on p.word = c.word and p.place = c.place
left join picked g on p.word = g.word and p.place = g.place + 1
where g.place is null
"""

DECODE = """
select doc, string_agg(token, '' order by pos) as bytes from ids join vocab using (id) group by doc
"""


class Codec:
    """The merge table and vocabulary of one rank file in an in-memory DuckDB, and the words met so far."""

    def __init__(self, ranks_path: str, pattern: str):
        import duckdb
        import regex

        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        parts = (
            (a, b, rank) for token, rank in self.ranks.items() for i in range(1, len(token))
            if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None)
        left, right, merged = np.fromiter((n for part in parts for n in part), np.int64).reshape(-1, 3).T
        unsafe = np.unique(np.concatenate((left[merged < left], right[merged < right])))
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
        self.load("merges", pa.table({"pair": left * 65536 + right, "rank": merged.astype(np.int32), "safe": ~np.isin(merged, unsafe)}))
        self.load("vocab", pa.table({
            "id": pa.array(list(self.ranks.values()), pa.int32()), "token": [t.decode("latin-1") for t in self.ranks]}))
        self.words: list[dict[str, bytes]] = [{}, {}]  # ids of the words met: this generation, the one before

    def close(self) -> None:
        """Give the memory back: Python workers outlive their tasks."""
        self.db.close()
        self.words, self.ranks = [{}, {}], {}

    def load(self, name: str, rows: pa.Table) -> None:
        self.db.register("loaded", rows)
        self.db.execute(f"create or replace temp table {name} as select * from loaded")
        self.db.unregister("loaded")

    def merged(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each word as little-endian integers."""
        out: dict[bytes, bytes] = {}
        left = [w for w in words if w not in self.ranks]
        out.update((w, self.ranks[w].to_bytes(4, "little")) for w in words if w in self.ranks)
        short, size = [], 0
        for word in sorted(left, key=len):  # words of a length take about as many rounds
            if len(word) > LONG_WORD:
                out[word] = self.long_word(word)
                continue
            short.append(word)
            size += len(word)
            if size >= QUERY_BYTES:
                out.update(self.short_words(short))
                short, size = [], 0
        if short:
            out.update(self.short_words(short))
        return out

    def rows(self, words: list[bytes]) -> pa.Table:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        pos = np.arange(len(ids)) - np.repeat(np.cumsum(lens) - lens, lens)
        nid, npos = np.append(ids[1:], -1), np.append(pos[1:], -1)
        nid[npos <= 0] = npos[npos <= 0] = -1  # a word's last row has no next one
        return pa.table({
            "word": np.repeat(np.arange(len(words), dtype=np.int32), lens), "pos": pos.astype(np.int32), "id": ids,
            "nid": nid.astype(np.int32), "npos": npos.astype(np.int32)})

    def short_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        self.load("start", self.rows(words))
        found = self.db.sql(ENCODE).to_arrow_table()
        ids = found["ids"].combine_chunks()
        flat, ends = ids.values.to_numpy().astype("<u4").tobytes(), ids.offsets.to_numpy()
        return {words[w]: flat[4 * a: 4 * b] for w, a, b in zip(found["word"].to_pylist(), ends[:-1], ends[1:], strict=True)}

    def long_word(self, word: bytes) -> bytes:
        self.load("long_words", self.rows([word]))
        size, before = len(word), 0
        while size != before:
            self.db.execute(LONG_ROUND)
            self.db.execute("create or replace temp table long_words as select * from long_next")
            before, size = size, self.db.sql("select count(*) from long_words").fetchall()[0][0]
        return self.db.sql("select id from long_words order by pos").to_arrow_table()["id"].to_numpy().astype("<u4").tobytes()

    def known(self, words: set[str]) -> dict[str, bytes]:
        """The ids of all words, encoded where neither generation has them. A full generation becomes the one before."""
        if len(self.words[0]) > CACHE_WORDS:
            self.words = [{}, self.words[0]]
        now, before = self.words
        new = []
        for word in words:
            if word not in now:
                if (held := before.get(word)) is not None:
                    now[word] = held
                else:
                    new.append(word)
        raw = [word.encode() for word in new]
        ids = self.merged(raw)
        now.update(zip(new, map(ids.__getitem__, raw), strict=True))
        return now

    def encode(self, texts: list[str]) -> list[bytes]:
        found = [self.pattern.findall(text) for text in texts]
        ids = self.known(set().union(*found)).__getitem__
        return [b"".join(map(ids, words)) for words in found]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each row of ids. A long row is decoded in slices, as tokens simply follow each other."""
        slices = [(row, some[i: i + DECODE_TOKENS]) for row, some in enumerate(ids) for i in range(0, len(some), DECODE_TOKENS)]
        out: list[list[bytes]] = [[] for _ in ids]
        for part in _chunks([len(some) for _, some in slices], DECODE_TOKENS):
            for (row, _), held in zip(slices[part], self.decoded([some for _, some in slices[part]]), strict=True):
                out[row].append(held)
        return list(map(b"".join, out))

    def decoded(self, ids: list[np.ndarray]) -> list[bytes]:
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        self.load("ids", pa.table({
            "doc": np.repeat(np.arange(len(ids)), lens), "pos": np.arange(lens.sum()), "id": np.concatenate(ids).astype(np.int32)}))
        found = self.db.sql(DECODE).to_arrow_table()
        out = dict(zip(found["doc"].to_pylist(), found["bytes"].to_pylist(), strict=True))
        return [out[i].encode("latin-1") for i in range(len(ids))]


def _chunks(sizes: list[int], most: int) -> Iterator[slice]:
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if sizes:
        yield slice(start, len(sizes))


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and the ids of every document's whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Codec(ranks_path, pattern)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            for part in _chunks(list(map(len, texts)), ENCODE_CHARS):
                found = coder.encode(texts[part])
                ends = np.cumsum([0, *[len(f) // 4 for f in found]]).astype(np.int32)
                ids = pa.array(np.frombuffer(b"".join(found), "<i4").astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part], pa.ListArray.from_arrays(pa.array(ends), ids)], ["doc_id", "ids"])
        coder.close()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, the ids' SHA-256, and the decoded bytes of every row of ids."""
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Codec(ranks_path, pattern)
        for batch in batches:
            lists = batch.column(1)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            rows = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            for part in _chunks(list(map(len, rows)), DECODE_TOKENS):
                own = rows[part]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[part], pa.array([len(r) for r in own], pa.int64()),
                    pa.array([hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in own]),
                    pa.array(coder.decode(own), pa.binary())], ["doc_id", "n_tokens", "ids_sha256", "decoded"])
        coder.close()

    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode, decode the ids, and report doc_id, n_tokens, ids_sha256, decoded_sha256.

    One Python task does both, so that no second one with tables of its own runs beside it.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Codec(ranks_path, pattern)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            for part in _chunks(list(map(len, texts)), ENCODE_CHARS):
                ids = coder.encode(texts[part])
                decoded = []
                for some in _chunks([len(i) // 4 for i in ids], DECODE_TOKENS):
                    decoded += [hashlib.sha256(d).hexdigest() for d in coder.decode([np.frombuffer(i, "<u4") for i in ids[some]])]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[part], pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()), pa.array(decoded, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        coder.close()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
