"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontam, htmltext, langid, linedup, merkle, ngramjoin, quality, sharding, spelling, tokencount, urlfilter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_byte_bpe")
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out(found["doc_id"]).alias("held_out"), "lang_pred", "score")


@query("op3_quality_rules", sql=f"""
with docs as (select row_number() over () as row_id, doc_id, coalesce(text, '') as text from documents),
cut as (select *, translate(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)), '') as solid,
    [w for w in regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+') if w <> ''] as words,
    [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] as lines from docs),
windows as (select row_id, i, concat_ws(' ', words[i], words[i + 1], words[i + 2]) as gram
    from (select row_id, words, unnest(range(1, len(words) - 1)) as i from cut)),
again as (select row_id, i from windows qualify count(*) over (partition by row_id, gram) > 1),
covered as (select row_id, count(distinct p) as n from (select row_id, unnest([i, i + 1, i + 2]) as p from again) group by row_id),
lines as (select distinct row_id, unnest(lines) as line from cut),
good as (select row_id, sum(length(line)) as chars from lines
    where regexp_matches(line, '{quality.PROSE_END.replace("'", "''")}') and not regexp_matches(line, '{quality.MENU}')
      and length(regexp_replace(line, '[^#*$%&|<>!?]', '', 'g')) * 10 <= length(line)
      and not list_bool_or([contains(lower(line), phrase) for phrase in {list(quality.BOILERPLATE)}])
    group by row_id),
counts as (select row_id, doc_id, len(words)::bigint as n_words, length(solid)::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words,
    coalesce(good.chars, 0) as good_chars,
    length(array_to_string(lines, '')) as line_chars
    from cut left join covered using (row_id) left join good using (row_id)),
based as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counts)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and 1 - good_chars / greatest(line_chars, 1) <= {quality.MAX_LOST} as kept
from based""")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("lost_share", "clean_text")


@query("op5_url_filter")
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


def _crc_steps() -> list[int]:
    """What four bits add to the reflected CRC-32, by their value."""
    steps = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ 0xEDB88320 * (value & 1)
        steps.append(value)
    return steps


@query("op7_sharding", sql=f"""
with docs as (select doc_id, coalesce(text, '') as text, strlen(coalesce(text, '')) + 1 as size from documents),
placed as (select *, sum(size) over (order by md5(text), doc_id nulls first rows unbounded preceding) - size as before,
    sum(size) over () as total, row_number() over (order by md5(text), doc_id nulls first) as nth from docs),
sharded as (select doc_id, hex(encode(text)) as hexes, size, (before * 16 // total)::int as shard, nth from placed),
halves as (select *, flatten([[b & 15, b >> 4] for b in [
    ('0x' || substr(hexes, 2 * i + 1, 2))::bigint for i in range(size - 1)]]) as halves from sharded)
select doc_id, size::bigint as size, xor(list_reduce(list_prepend(4294967295::bigint, halves),
        lambda crc, half: xor(crc >> 4, ({_crc_steps()}::bigint[])[(xor(crc, half) & 15) + 1])), 4294967295) as text_crc32,
    'bytes' as law, shard, (nth - min(nth) over (partition by shard))::bigint as slot, null::int as grown_shard
from halves""")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_records(table(spark, sf_dir, "documents"))


@query("op9_ngram_jaccard_join")
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(table(spark, sf_dir, "documents"))


@query("op6_decontamination")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_tool_calls", sql="""
with said as (select conv_id, turn, role, min(text) as text from conversations
    where conv_id is not null and turn is not null and role is not null group by all),
calls as (select conv_id, turn, text from said where role = 'user'),
results as (select conv_id, turn - 1 as turn, text, true as there from said where role = 'assistant'),
starts as (select conv_id, turn, row_number() over (partition by conv_id, turn % 2 order by turn) as nth from calls),
levels as (select conv_id, turn, row_number() over (partition by conv_id, turn % 2, turn - 2 * nth order by turn) - 1 as level from starts),
linked as (select conv_id, turn, c.text as asked, r.text as given, c.conv_id is not null as called, coalesce(r.there, false) as answered
    from (select conv_id, turn, text from calls) c full join results r using (conv_id, turn))
select conv_id, 'turn-' || turn as call_id, level, case when called then turn else turn + 1 end as turn,
    case when not called then 'orphan result' when answered then 'linked' else 'no result' end as status,
    called and coalesce(length(asked) >= 1, false) and turn >= 0 as valid,
    '{"arguments":' || case when called then '{' || case when asked is null then '' else '"text":' || to_json(asked)::varchar || ',' end
        || '"turn":' || turn || '}' else 'null' end
        || ',"id":"turn-' || turn || '","name":' || case when called then '"reply"' else 'null' end
        || ',"result":' || coalesce(to_json(given)::varchar, 'null') || '}' as message
from linked left join levels using (conv_id, turn)""")
def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(table(spark, sf_dir, "conversations"))


@query("op4_line_dedup")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_removed_lines", "text")


@query("op8_html_text")
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def _crc_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text expression."""
    halves = f"flatten([[b & 15, b >> 4] for b in [('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint for i in range(strlen({text}))]])"
    return (f"xor(list_reduce(list_prepend(4294967295::bigint, {halves}), lambda crc, half: "
            f"xor(crc >> 4, ({_crc_steps()}::bigint[])[(xor(crc, half) & 15) + 1])), 4294967295)")


@query("op11_spelling_variants", sql=f"""
with recursive runs as (select coalesce(doc_id::varchar, '') as doc, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) as raw from documents),
held as (select doc, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n from runs group by all),
drawn as (select run, n, {_crc_sql("(doc || ':' || run)")} as h from held where length(run) >= 6),
spelt as (select case when h % 199 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, n from drawn),
words as (select word, sum(n)::bigint as n from spelt where length(word) >= 6 group by word having sum(n) >= 5),
cut as (select word, n, i, substr(word, 1, i) as head, substr(word, i + 2) as tail from (select word, n, unnest(range(length(word))) as i from words)),
pairs as (
    select a.word as a, b.word as b from cut a join cut b on a.i = b.i and a.head = b.head and a.tail = b.tail where a.word <> b.word
    union select cut.word, words.word from cut join words on words.word = head || tail
    union select words.word, cut.word from cut join words on words.word = head || tail),
near as (select a, b, x.n as n_a, y.n as n_b from pairs join words x on x.word = a join words y on y.word = b),
forms as (select a as word, b as form, n_b as form_n from near where n_b >= 5 * n_a qualify row_number() over (partition by a order by n_b desc, b) = 1),
path(word, stop, depth) as (
    select word, word, 0 from words union all select path.word, form, depth + 1 from path join forms on forms.word = path.stop),
ends as (select word, arg_max(stop, depth) as root from path group by word),
sums as (select a as word, count(*) as n_near from near group by a)
select word, form, root, n, coalesce(n_near, 0)::bigint as n_near, form_n
from words left join forms using (word) left join ends using (word) left join sums using (word)""")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def _field_sql(value: str) -> str:
    return f"case when {value} is null then '-' else strlen({value}::varchar) || ':' || {value} end"


@query("op12_merkle_manifest", sql=f"""
with recursive docs as (select row_number() over () as row_id, *, coalesce({_crc_sql("(doc_id::varchar)")} % 5 = 0, false) as touched,
    {" || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars")))} as front,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lowered from documents),
leaves as (select *, sha256(front || {_field_sql("text")}) as leaf from docs),
placed as (select *, case when touched then sha256(front || {_field_sql("lowered")}) else leaf end as claimed,
    dense_rank() over (order by source nulls first) - 1 as tree, count(*) over (partition by source) as size,
    row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as place from leaves),
nodes(level, tree, idx, node, n) as (
    select 0, tree, place, leaf, size from placed
    union all
    select level + 1, tree, idx // 16, sha256(string_agg(node, '' order by idx)), (n + 15) // 16 from nodes where n > 1 group by level, tree, idx // 16, n),
subroots as (select tree, node from nodes where n = 1),
tops(level, idx, node, n) as (
    select 0, tree, node, (select count(*) from subroots) from subroots
    union all
    select level + 1, idx // 16, sha256(string_agg(node, '' order by idx)), (n + 15) // 16 from tops where n > 1 group by level, idx // 16, n),
runs as (
    select row_id, level as k, idx, node, place >> (4 * level) as own from placed join nodes on nodes.tree = placed.tree and n > 1
        and idx >> 4 = place >> (4 * level + 4)
    union all
    select row_id, level + 1000, idx, node, tree >> (4 * level) from placed join tops on n > 1 and idx >> 4 = tree >> (4 * level + 4)),
steps as (select row_id, row_number() over (partition by row_id order by k) as i,
    coalesce(string_agg(node, '' order by idx) filter (idx < own), '') as before,
    coalesce(string_agg(node, '' order by idx) filter (idx > own), '') as after from runs group by row_id, k),
folded(row_id, i, node) as (
    select row_id, 0::bigint, claimed from placed
    union all
    select folded.row_id, folded.i + 1, sha256(before || folded.node || after) from folded join steps on steps.row_id = folded.row_id and steps.i = folded.i + 1),
proofs as (select row_id, string_agg(before || after, '' order by i) as beside from steps group by row_id),
ends as (select row_id, arg_max(node, i) as folded_root from folded group by row_id)
select doc_id, leaf, subroots.node as subroot, tops.node as root, sha256(coalesce(beside, '')) as proof_sha256, folded_root,
    folded_root = tops.node as verified, tree as source_no
from placed join subroots using (tree) join ends using (row_id) left join proofs using (row_id), tops where tops.n = 1""")
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


@query("op13_token_counts")
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
