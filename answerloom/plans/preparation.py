"""Registered queries: joins and set operations (F), sampling and splits (I), data preparation (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import freetext as ft
from ..functions.hashing import hash_int, hex_int, order_key
from ..functions.render import target_text
from ..operators import accuracy as acc
from ..operators import attribution as att
from ..operators import prep
from ..operators import sampling as smp
from ..operators import setops as so
from ..operators.ranking import hash_rank
from .registry import query
from .view_sql import sql
from .views import VIEW_TYPES, clips, person_arrays, questions, results, table

H = "('0x' || substr(md5({}), 1, 8))::bigint"
TYPE_NO = {t: i for i, (t, _, _) in enumerate(VIEW_TYPES)}
_TN = ", ".join(f"('{t}', {i})" for t, i in TYPE_NO.items())

SPLIT_SQL = """
, units as (select group_id unit, lower(coalesce(nullif(trim(arg_min(coalesce(action, ''), clip)), ''), 'unknown')) stratum from clips group by 1),
ranked as (select *, row_number() over (partition by stratum order by md5('42|split|' || unit), unit) r, count(*) over (partition by stratum) n from units),
split as (select clip, group_id, case when r <= floor(n * 0.2) then 'train' when r <= floor(n * 0.2) + floor(n * 0.1) then 'val' else 'test' end split
          from clips join ranked on group_id = unit)"""


def splits(spark, sf):
    return smp.group_split(clips(spark, sf), train=0.2, val=0.1).select("clip", "group_id", "split")


def indexed(bank):
    return bank.withColumn("question_index", acc.map_column(TYPE_NO, F.col("qtype")))


# --- F --------------------------------------------------------------------------------------

_BANK2 = """
, bank2 as (select *, 1 load from questions union all by name select * replace (n_options - 1 - correct_index as correct_index), 2 load
            from questions where group_id like 'g_2%'),
bank as (select clip, prompt, arg_max(correct_index, load) key from bank2 group by all)"""


def reloaded_bank(spark, sf):
    """The bank with the questions of some groups issued again, their key changed."""
    # both loads from one row: a union would take the questions out of their clips' buckets
    loads = F.when(F.col("group_id").startswith("g_2"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return questions(spark, sf).withColumn("load", F.explode(loads)).withColumn(
        "correct_index", F.when(F.col("load") == 2, F.col("n_options") - 1 - F.col("correct_index")).otherwise(F.col("correct_index")))


@query("error_labels_against_last_bank", sql("""
, bank2 as (select clip, prompt, option_hardness, 1 load from questions
            union all select clip, prompt, list_reverse(option_hardness), 2 from questions where group_id like 'g_2%'),
bank as (select clip, prompt, arg_max(option_hardness, load) labels from bank2 group by all)
select model, labels[selected + 1] label, count(*) n from results join bank using (clip, prompt)
where not is_correct and selected is not null and labels[selected + 1] <> 'correct' group by all""", "results"))
def error_labels_against_last_bank(spark, sf):
    """D16 with the questions of some groups issued again, their labels turned round."""
    bank = questions(spark, sf)
    again = bank.filter(F.col("group_id").startswith("g_2")).withColumn("option_hardness", F.reverse("option_hardness"))
    both = bank.withColumn("load", F.lit(1)).unionByName(again.withColumn("load", F.lit(2)))
    found = att.attribute_errors(results(spark, sf), both, order=["load"])
    return found.filter("label is not null").groupBy("model", "label").agg(F.sum("n").alias("n"))


@query("accuracy_against_last_key", sql(_BANK2 + """
select model, count(*) total, count_if(coalesce(selected = key, false)) correct, count_if(coalesce(selected = key, false)) / count(*)::double accuracy
from results join bank using (clip, prompt) group by 1""", "results"))
def accuracy_against_last_key(spark, sf):
    joined = so.match_bank(results(spark, sf), reloaded_bank(spark, sf), order=["load"], columns=["correct_index"])
    return acc.accuracy(joined.withColumn("is_correct", F.col("selected") == F.col("bank_correct_index")), ["model"])


@query("bank_match_counts", sql("""
, b as (select distinct clip, prompt from questions where group_id not like 'g_3%')
select count(b.clip) matched, count(*) - count(b.clip) unmatched from results r left join b using (clip, prompt)""", "results"))
def bank_match_counts(spark, sf):
    return so.match_counts(results(spark, sf), questions(spark, sf).filter(~F.col("group_id").startswith("g_3")))


@query("accuracy_by_environment", sql("""
select coalesce(environment, '(none)') environment, count(*) total, count_if(is_correct) correct, count_if(is_correct) / count(*)::double accuracy
from results left join clips using (clip) group by 1""", "results"))
def accuracy_by_environment(spark, sf):
    place = clips(spark, sf).select("clip", F.coalesce("environment", F.lit("(none)")).alias("environment"))
    return acc.accuracy(results(spark, sf).join(place, "clip", "left"), ["environment"])


@query("questions_in_train_split", sql(SPLIT_SQL + """
select clip, qtype from questions semi join (select clip from split where split = 'train') t using (clip)""", "questions"))
def questions_in_train_split(spark, sf):
    return so.kept_by(questions(spark, sf), splits(spark, sf).filter("split = 'train'"), ["clip"]).select("clip", "qtype")


@query("questions_left_to_answer", sql("""
select q.clip, q.qtype from questions q anti join (select clip, prompt from results where model = 'atlas-8b' and selected is not null) d using (clip, prompt)""", "results"))
def questions_left_to_answer(spark, sf):
    done = results(spark, sf).filter("model = 'atlas-8b' and selected is not null")
    return so.remaining(questions(spark, sf), done.hint("merge"), ["clip", "prompt"]).select("clip", "qtype")


@query("documents_without_label", """
select doc_id, source from documents anti join labels using (doc_id)""")
def documents_without_label(spark, sf):
    return so.remaining(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"]).select("doc_id", "source")


@query("bank_delta", sql("""
select qtype, count(*) n from questions where qtype = 'sequence_verification' or group_id like 'g_4%' group by 1""", "questions"))
def bank_delta(spark, sf):
    bank = questions(spark, sf)
    base = bank.filter((F.col("qtype") != "sequence_verification") & ~F.col("group_id").startswith("g_4"))
    return so.bank_delta(bank, base).groupBy("qtype").agg(F.count("*").alias("n"))


_RETR = SPLIT_SQL + """
, nog as (select * replace (case when group_id like 'g_5%' then null else group_id end as group_id) from questions),
train as (select nog.* from nog join split using (clip) where split = 'train' and not (qtype = 'primary_action' and is_trick)),
test as (select nog.* from nog join split using (clip) where split <> 'train')"""


def _retrieval_sides(spark, sf):
    """Training and test questions; some clips have no group, and one bucket does not exist."""
    bank = questions(spark, sf).withColumn(
        "group_id", F.when(~F.col("group_id").startswith("g_5"), F.col("group_id")))
    placed = bank.join(splits(spark, sf).select("clip", "split"), "clip")
    train = placed.filter("split = 'train' and not (qtype = 'primary_action' and is_trick)")
    return placed.filter("split <> 'train'"), train


@query("candidates_outside_group", sql(_RETR + """
, tot as (select qtype, is_trick, count(*) n from train group by all),
own as (select qtype, is_trick, group_id, count(*) n from train group by all)
select t.clip, t.qtype, t.is_trick, tot.n - coalesce(own.n, 0) candidates from test t join tot using (qtype, is_trick)
left join own on own.qtype = t.qtype and own.is_trick = t.is_trick and own.group_id is not distinct from t.group_id""", "questions"))
def candidates_outside_group(spark, sf):
    test, train = _retrieval_sides(spark, sf)
    return so.other_group_counts(test, train)


_CHAINS = f"""
, tn(qtype, question_index) as (values {_TN}),
chains as (select clip, qtype, question_index, correct_index,
   case when h % 20 = 0 then null when h % 20 = 1 then 'Too short.'
        else 'The frames show two people close to each other and one of them moves fast. The choice is ' ||
             chr((65 + case when h % 20 in (2, 3) then (correct_index + 1) % n_options else correct_index end)::int) || ')' end reasoning_chain
   from (select *, {H.format("'42|chain|' || clip || '|' || qtype")} h from questions) join tn using (qtype)),
outc as (select *, case when qtype not in ({", ".join(f"'{t}'" for t in K.CHAIN_TYPES)}) then 'direct' when reasoning_chain is null then 'failed'
   when length(reasoning_chain) >= 50 and ascii(upper(nullif(regexp_extract(right(reasoning_chain, 80),
        '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])([A-H])(?:$|[^\\p{{L}}\\p{{N}}_])', 1), ''))) - 65 = correct_index then 'kept' else 'filtered' end outcome from chains)"""


def chain_table(spark, sf):
    """A reasoning text per question: some missing, some short, some that end on another letter."""
    bank = indexed(questions(spark, sf))
    h = hash_int(42, "chain", F.col("clip"), F.col("qtype")) % 20
    named = F.when(h.isin(2, 3), (F.col("correct_index") + 1) % F.col("n_options")).otherwise(F.col("correct_index"))
    text = F.when(h == 0, F.lit(None)).when(h == 1, "Too short.").otherwise(F.concat(
        F.lit("The frames show two people close to each other and one of them moves fast. The choice is "),
        F.char(named + 65), F.lit(")")))
    return bank.select("clip", "qtype", "question_index", "correct_index", text.alias("reasoning_chain"))


@query("chain_outcomes", sql(_CHAINS + " select qtype, outcome, count(*) n from outc group by all", "questions"))
def chain_outcomes(spark, sf):
    return prep.chain_outcomes(chain_table(spark, sf)).groupBy("qtype", "outcome").agg(F.count("*").alias("n"))


@query("chain_commits", sql(_CHAINS + """
select clip, qtype, coalesce(length(reasoning_chain) >= 50 and ascii(upper(nullif(regexp_extract(right(reasoning_chain, 80),
  '(?i)(?:^|[^\\p{L}\\p{N}_])([A-H])(?:$|[^\\p{L}\\p{N}_])', 1), ''))) - 65 = correct_index, false) commits from chains""", "questions"))
def chain_commits(spark, sf):
    return chain_table(spark, sf).select(
        "clip", "qtype", ft.chain_commits(F.col("reasoning_chain"), F.col("correct_index")).alias("commits"))


@query("examples_with_chains", sql(_CHAINS + """
select clip, qtype, case when outcome = 'kept' then reasoning_chain end reasoning_chain from outc""", "questions"))
def examples_with_chains(spark, sf):
    made = prep.chain_outcomes(chain_table(spark, sf))
    examples = indexed(questions(spark, sf)).select("clip", "qtype", "question_index")
    return so.with_chains(examples, made, ["qtype"]).select("clip", "qtype", "reasoning_chain")


@query("merged_chain_coverage", sql(_CHAINS + """
select qtype, count(*) total, count_if(outcome = 'kept') cot from outc group by 1""", "questions"))
def merged_chain_coverage(spark, sf):
    made = prep.chain_outcomes(chain_table(spark, sf)).filter(F.col("qtype").isin(*K.CHAIN_TYPES))
    part = hash_int(42, "part", F.col("clip")) % 2
    parts = [made.filter(part == i).select("clip", "qtype", "used_cot") for i in range(2)]
    return so.chain_coverage(so.merge_chains(parts, questions(spark, sf).select("clip", "qtype")))


@query("clips_in_either_set", sql("""
select clip from questions where qtype = 'primary_action' union select clip from clips where environment is null""", "questions"))
def clips_in_either_set(spark, sf):
    asked = questions(spark, sf).filter("qtype = 'primary_action'")
    return so.all_keys(asked, clips(spark, sf).filter("environment is null"), "clip")




@query("insert_missing_results", sql("""
, base as (select clip, prompt, qtype, is_correct from results where model = 'atlas-8b' and substr(clip, -1) not in ('3', '7')),
new as (select clip, prompt, qtype, is_correct, 1 o from results where model = 'atlas-70b'
        union all select clip, prompt, qtype, is_correct, 2 from results where model = 'borea-7b'),
add as (select clip, prompt, qtype, arg_min(is_correct, o) is_correct from new anti join base using (clip, prompt, qtype) group by all),
u as (select * from base union all by name select * from add)
select qtype, count(*) total, count_if(is_correct) correct from u group by 1""", "results"))
def insert_missing_results(spark, sf):
    base, new = _insert_sides(spark, sf)
    out = so.insert_missing(base, new, ["clip", "prompt", "qtype"], ["o"])
    return out.groupBy("qtype").agg(*acc.counts())


def _insert_sides(spark, sf):
    cols = ["clip", "prompt", "qtype", "is_correct"]
    r = results(spark, sf)
    base = r.filter("model = 'atlas-8b' and right(clip, 1) not in ('3', '7')").select(*cols)
    new = so.stack_all([r.filter("model = 'atlas-70b'").select(*cols, F.lit(1).alias("o")),
                        r.filter("model = 'borea-7b'").select(*cols, F.lit(2).alias("o"))])
    return base, new


@query("insert_report", sql("""
, base as (select distinct clip, prompt, qtype from results where model = 'atlas-8b' and substr(clip, -1) not in ('3', '7')),
new as (select clip, prompt, qtype from results where model in ('atlas-70b', 'borea-7b')),
a as (select distinct clip, prompt, qtype from new anti join base using (clip, prompt, qtype))
select (select count(*) from a) added, (select count(*) from new) - (select count(*) from a) skipped""", "results"))
def insert_report(spark, sf):
    base, new = _insert_sides(spark, sf)
    return so.insert_report(base, new, ["clip", "prompt", "qtype"])


@query("replaced_type_accuracy", sql("""
select qtype, count(*) total, count_if(is_correct) correct, count_if(is_correct) / count(*)::double accuracy from results
where (model = 'atlas-8b' and qtype <> 'compound_action_aggressor') or (model = 'cirrus-think' and qtype = 'compound_action_aggressor') group by 1""", "results"))
def replaced_type_accuracy(spark, sf):
    r = results(spark, sf)
    merged = so.replace_type(r.filter("model = 'atlas-8b'"), r.filter("model = 'cirrus-think'"), "compound_action_aggressor")
    return acc.accuracy(merged, ["qtype"])


@query("filtered_bank", sql("select clip, qtype from questions where not is_secondary and not is_trick", "questions"))
def filtered_bank(spark, sf):
    return so.filter_bank(questions(spark, sf), drop_trick=True).select("clip", "qtype")


@query("filter_report", sql("""
, p as (select clip, count(*) n, count_if(is_secondary) s, count_if(not is_secondary and is_trick) t from questions
        where qtype in ('primary_action', 'role_count_aggressor') group by 1)
select sum(n)::bigint before, sum(s)::bigint dropped_secondary, sum(t)::bigint dropped_trick, sum(n - s - t)::bigint kept,
  count_if(n - s - t = 0) emptied_clips from p""", "questions"))
def filter_report(spark, sf):
    bank = questions(spark, sf).filter(F.col("qtype").isin("primary_action", "role_count_aggressor"))
    return so.filter_report(bank, drop_trick=True)


@query("split_overlap", sql(SPLIT_SQL + """
, two as (select clip, split from split union select clip, 'test' from split where group_id = 'g_8' and split = 'test'
          union select clip, 'extra' from split where group_id = 'g_8')
select clip, count(distinct split) n from two group by 1 having count(distinct split) > 1""", "clips"))
def split_overlap(spark, sf):
    """The real splits are disjoint; a second label for one group's clips must be caught."""
    s = splits(spark, sf).select("clip", "group_id", "split")
    return so.split_overlap(s.unionByName(s.filter("group_id = 'g_8'").withColumn("split", F.lit("extra"))))


@query("pool_difference", sql("""
, o as (select distinct action as value from clips where environment = 'nation_3' and action is not null)
select distinct action as value from clips where environment is null and action is not null except select value from o""", "clips"))
def pool_difference(spark, sf):
    named = clips(spark, sf).filter("action is not null")
    return so.pools_without(
        named.filter("environment is null").select(F.col("action").alias("value")),
        named.filter("environment = 'nation_3'").select(F.col("action").alias("value")))


# --- I --------------------------------------------------------------------------------------

_RANK = "select {k}, row_number() over (order by md5('42|{op}|' || {k}), {k}) r, count(*) over () n from {t}"


@query("sample_clips_by_share", sql(", r as (" + _RANK.format(k="clip", op="sample", t="clips") + ") select clip from r where r <= greatest(ceil(n * 0.07::double), 1)", "clips"))
def sample_clips_by_share(spark, sf):
    return smp.sample_exact(clips(spark, sf).select("clip"), ["clip"], 0.07)


@query("sample_clips_by_number", sql(", r as (" + _RANK.format(k="clip", op="sample", t="clips") + ") select clip from r where r <= 250", "clips"))
def sample_clips_by_number(spark, sf):
    return smp.sample_exact(clips(spark, sf).select("clip"), ["clip"], 250)


@query("sample_documents_floor", "with r as (" + _RANK.format(k="doc_id", op="sample", t="documents") + ") select doc_id from r where r <= greatest(floor(n * 0.033::double), 1)")
def sample_documents_floor(spark, sf):
    return smp.sample_exact(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 0.033, rounding="floor")


@query("sample_per_type", sql("""
, r as (select clip, qtype, row_number() over (partition by qtype order by md5('42|per_group|' || clip || '|' || qtype), clip, qtype) r from questions)
select clip, qtype from r where r <= 5""", "questions"))
def sample_per_type(spark, sf):
    return smp.sample_per_group(questions(spark, sf).select("clip", "qtype"), ["qtype"], ["clip", "qtype"], 5)


@query("stratified_clips", sql("""
, c as (select clip, lower(trim(coalesce(action, 'none'))) stratum from clips),
r as (select *, row_number() over (partition by stratum order by md5('42|strata|' || clip), clip) r from c),
s as (select stratum, row_number() over (order by stratum) no, count(*) over () k from (select distinct stratum from c where stratum <> 'none')),
q as (select clip, r.stratum from r left join s using (stratum)
      where r <= case when r.stratum = 'none' then 15 else greatest(85 // k, 1) + (no <= 85 - greatest(85 // k, 1) * k)::int end)
select clip, stratum from q order by md5('42|strata_cut|' || clip), clip limit 100""", "clips"))
def stratified_clips(spark, sf):
    named = clips(spark, sf).select("clip", F.lower(F.trim(F.coalesce("action", F.lit("none")))).alias("stratum"))
    return smp.stratified_sample(named, "stratum", "clip", 100)


@query("stratified_documents", """
with r as (select doc_id, lang, row_number() over (partition by lang order by md5('42|strata|' || doc_id), doc_id) r from documents),
s as (select lang, row_number() over (order by lang) no, count(*) over () k from (select distinct lang from documents where lang <> 'en')),
q as (select doc_id, r.lang from r left join s using (lang) where r <= case when r.lang = 'en' then 15 else greatest(85 // k, 1) + (no <= 85 - greatest(85 // k, 1) * k)::int end)
select doc_id, lang from q order by md5('42|strata_cut|' || doc_id), doc_id limit 100""")
def stratified_documents(spark, sf):
    return smp.stratified_sample(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 100, reserved="en")


@query("diverse_questions", sql("""
, q as (select clip, qtype, action from questions join clips using (clip) where not is_secondary),
a as (select *, row_number() over (partition by qtype, action order by md5('42|diverse|' || clip || '|' || qtype), clip, qtype) rd from q),
b as (select *, row_number() over (partition by qtype order by rd, md5('42|stratum|' || qtype || '|' || action), clip, qtype) r from a)
select clip, qtype, action from b where r <= 30""", "questions"))
def diverse_questions(spark, sf):
    bank = questions(spark, sf).filter("not is_secondary").select("clip", "qtype")
    named = bank.join(clips(spark, sf).select("clip", "action"), "clip")
    return smp.diverse_sample(named, ["qtype"], "action", ["clip", "qtype"], 30).select("clip", "qtype", "action")


@query("group_split", sql(SPLIT_SQL + " select clip, split from split", "clips"))
def group_split(spark, sf):
    return splits(spark, sf).select("clip", "split")


@query("clip_split", sql("""
, units as (select clip, lower(coalesce(nullif(trim(action), ''), 'unknown')) stratum from clips),
r as (select *, row_number() over (partition by stratum order by md5('42|split|__solo__/' || clip), clip) r, count(*) over (partition by stratum) n from units)
select clip, case when r <= floor(n * 0.8) then 'train' when r <= floor(n * 0.8) + floor(n * 0.1) then 'val' else 'test' end split from r""", "clips"))
def clip_split(spark, sf):
    return smp.group_split(clips(spark, sf), group=None, train=0.8, val=0.1).select("clip", "split")


@query("document_source_split", """
with units as (select source unit, lower(arg_min(lang, doc_id::varchar)) stratum from documents group by 1),
r as (select *, row_number() over (partition by stratum order by md5('42|split|' || unit), unit) r, count(*) over (partition by stratum) n from units)
select doc_id, case when r <= floor(n * 0.5) then 'train' else 'test' end split from documents join r on source = unit""")
def document_source_split(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("clip"), "doc_id", "lang", "source")
    return smp.group_split(d, group="source", stratum="lang", train=0.5).select("doc_id", "split")


_SHARDS = {
    "balanced": "case when o < (n % 7) * (n // 7 + 1) then o // (n // 7 + 1) else n % 7 + (o - (n % 7) * (n // 7 + 1)) // (n // 7) end",
    "ceil_chunk": "o // ceil(n / 7.0)::bigint", "round_robin": "o % 7", "floor_chunk": "least(o // (n // 7), 6)",
}


def _shard_queries():
    for rule, expr in _SHARDS.items():
        @query(f"shards_{rule}", sql(f"""
, x as (select clip, row_number() over (order by clip) - 1 o, count(*) over () n from clips) select clip, ({expr})::bigint shard from x""", "clips"))
        def run(spark, sf, rule=rule):
            return smp.shard(clips(spark, sf).select("clip"), ["clip"], 7, rule)


_shard_queries()


@query("shard_index_range", sql("""
, x as (select clip, row_number() over (order by clip) - 1 o from clips) select clip from x where o >= 100 and o < 900""", "clips"))
def shard_index_range(spark, sf):
    return smp.index_range(clips(spark, sf).select("clip"), ["clip"], 100, 900)


@query("recombined_shards", sql(_BANK2 + " select clip, prompt, key correct_index from bank", "questions"))
def recombined_shards(spark, sf):
    from ..operators.ranking import last_per_key
    return last_per_key(reloaded_bank(spark, sf).select("clip", "prompt", "correct_index", "load"), ["clip", "prompt"], ["load"]).drop("load")


@query("length_balanced_answers", sql("""
, v as (select distinct category, correct_answer v from questions join clips using (clip) where qtype = 'compound_action_victims'),
x as (select category, v, row_number() over (partition by category order by (length(v) between 40 * 0.6::double and 40 * 1.4::double) desc, md5('42|length|' || category || '|' || v), v) r
      from v)
select category, v as value from x where r <= 200""", "questions"))
def length_balanced_answers(spark, sf):
    """200 answer texts per clip category, those near 40 characters first."""
    pool = questions(spark, sf).filter("qtype = 'compound_action_victims'").join(clips(spark, sf).select("clip", "category"), "clip")
    pool = pool.select("category", F.col("correct_answer").alias("value")).distinct()
    return smp.length_balanced(pool, ["category"], "value", F.lit(40), 200).select("category", "value")


@query("weighted_actions", sql("""
, f as (select category, action, count(*) n from clips where action is not null group by all),
w as (select *, max(n) over (partition by category) / n::double weight from f),
x as (select *, row_number() over (partition by category order by -ln((('0x' || substr(md5('42|weighted|' || category || '|' || action), 1, 8))::bigint + 0.5) / 4294967296.0::double) / weight, action) r from w)
select category, action from x where r <= 8""", "clips"))
def weighted_actions(spark, sf):
    """Eight actions per category, rare ones with a higher chance."""
    per = clips(spark, sf).filter("action is not null").groupBy("category", "action").agg(F.count("*").alias("n"))
    top = per.groupBy("category").agg(F.max("n").alias("_top"))
    weighted = per.join(top, "category").withColumn("weight", F.col("_top") / F.col("n"))
    return smp.weighted_sample(weighted, ["category"], "action", "weight", 8).select("category", "action")


# --- J --------------------------------------------------------------------------------------

_CTX = """coalesce(nullif(concat_ws(chr(10), 'Aggressor: ' || aggressor, 'Victim: ' || victim,
  case when lower(action) <> 'none' then 'Action: ' || action end, 'Environment: ' || environment,
  case when len(bystanders) > 0 and not contains(lower(array_to_string(bystanders, ' and ')), 'group of people')
       then 'Bystanders: ' || array_to_string(bystanders, ' and ') end), ''), 'Video context not available')"""


@query("sft_examples", sql(f"""
, tn(qtype, question_index) as (values {_TN})
select clip, qtype, question_index, {_CTX} video_context, correct_answer, array_to_string(answers, ' ## ') options
from questions join clips using (clip) join tn using (qtype) where not is_secondary""", "questions"))
def sft_examples(spark, sf):
    made = prep.sft_examples(indexed(questions(spark, sf)), person_arrays(clips(spark, sf)))
    return made.select("clip", "qtype", "question_index", "video_context", "correct_answer", F.array_join("answers", " ## ").alias("options"))


@query("target_texts", sql(_CHAINS + """
select q.clip, q.qtype, case when outcome = 'kept' then 'Reasoning:' || chr(10) || reasoning_chain || chr(10) || chr(10) || 'Answer: ' else '' end
  || chr((65 + q.correct_index)::int) || ') ' || correct_answer target from questions q join outc using (clip, qtype)""", "questions"))
def target_texts(spark, sf):
    made = prep.chain_outcomes(chain_table(spark, sf)).select(
        "clip", "qtype", F.when(F.col("used_cot"), F.col("reasoning_chain")).alias("reasoning"))
    joined = questions(spark, sf).join(made.hint("merge"), ["clip", "qtype"])
    return joined.select("clip", "qtype", target_text(
        F.col("correct_answer"), F.col("correct_index"), F.col("answers"), F.col("reasoning")).alias("target"))


@query("normalized_examples", sql("""
select clip, prompt, correct_answer, case when qtype = 'primary_action' then 'seen' else '' end reasoning from questions
where qtype in ('primary_action', 'victim_recognition')""", "questions"))
def normalized_examples(spark, sf):
    q = questions(spark, sf).filter(F.col("qtype").isin("primary_action", "victim_recognition"))
    nested = F.col("qtype") == "primary_action"
    mixed = q.select(
        "clip", F.lit("").alias("video_context"), "prompt", F.when(~nested, F.col("correct_answer")).alias("correct_answer"),
        F.when(nested, F.struct(F.col("correct_answer").alias("answer"), F.lit("seen").alias("reasoning"))).alias("chosen"),
        F.lit(None).cast("string").alias("reasoning"), "answers", "correct_index")
    return prep.normalize_examples(mixed).select("clip", "prompt", "correct_answer", "reasoning")


_PERM = "list_transform(list_sort(list_transform(range({n}), lambda i: md5('{salt}|' || {k} || '|' || i) || '|' || lpad(i::varchar, 3, '0'))), lambda s: right(s, 3)::int)"


@query("permuted_options", sql(f"""
, p as (select *, {_PERM.format(n='n_options', salt='42|permute|1', k="clip || '|' || qtype")} perm from questions)
select clip, qtype, array_to_string(list_transform(perm, lambda i: answers[i + 1]), ' ## ') options, list_position(perm, correct_index)::int - 1 correct_index from p""", "questions"))
def permuted_options(spark, sf):
    out = prep.permute_options(questions(spark, sf), ["clip", "qtype"], epoch=1)
    return out.select("clip", "qtype", F.array_join("answers", " ## ").alias("options"), "correct_index")


_PRIO = "case {x} " + " ".join(f"when '{k}' then {v}" for k, v in K.HARDNESS_PRIORITY.items()) + " else 99 end"
_PAIRS = SPLIT_SQL + """
, oc as (select clip, prompt, bool_and(is_correct) ok from results where model = 'atlas-8b' and error is null group by all),
e as (select q.clip, q.qtype, q.prompt, correct_index, ok, unnest(range(n_options)) pos, unnest(answers) txt, unnest(option_hardness) label
      from questions q join split s using (clip) left join oc on oc.clip = q.clip and oc.prompt = q.prompt
      where not q.is_secondary and not q.is_trick and s.split = 'train'),
k as (select *, row_number() over (partition by clip, prompt order by {order}, pos) r from e where label <> 'correct'),
pairs as (select clip, qtype, any_value(ok) ok, any_value(correct_index) correct_index, string_agg(chr((65 + pos)::int) || ') ' || txt || ' [' || label || ']', ' ## ' order by r) rejected
          from k where r <= 3 group by all)"""
_ORD = {
    "fixed": _PRIO.format(x="label"),
    "hard_mining": f"case when coalesce(ok, false) then -({_PRIO.format(x='label')}) else {_PRIO.format(x='label')} end",
    "curriculum": f"case when coalesce(not ok, false) then -({_PRIO.format(x='label')}) else {_PRIO.format(x='label')} end",
}


def _pairs(spark, sf, strategy):
    outcomes = results(spark, sf).filter("model = 'atlas-8b' and error is null").select("clip", "prompt", "qtype", "is_correct")
    train = splits(spark, sf).filter("split = 'train'")
    return prep.preference_pairs(indexed(questions(spark, sf)), clips(spark, sf), train, outcomes, strategy=strategy, n=3, outcome_order=["qtype"])


def _pair_queries():
    for strategy, order in _ORD.items():
        @query(f"preference_pairs_{strategy}", sql(_PAIRS.format(order=order) + """
select clip, qtype, ok model_correct, correct_index, rejected from pairs""", "results"))
        def run(spark, sf, strategy=strategy):
            shown = F.array_join(F.transform("rejected", lambda r: F.concat(r["answer"], F.lit(" ["), r["hardness"], F.lit("]"))), " ## ")
            return _pairs(spark, sf, strategy).select("clip", "qtype", "model_correct", "correct_index", shown.alias("rejected"))


_pair_queries()


@query("preference_pair_stats", sql(_PAIRS.format(order=_ORD["hard_mining"]) + """
select case when ok is null then 'no_eval_fallback' when ok then 'model_correct' else 'model_wrong' end outcome, label, count(*) n
from k where r <= 3 group by all""", "results"))
def preference_pair_stats(spark, sf):
    return prep.pair_stats(_pairs(spark, sf, "hard_mining"))


@query("permuted_pairs", sql(_PAIRS.format(order=_ORD["fixed"]) + f"""
, p as (select q.clip, q.qtype, answers, q.correct_index, k.pos, {_PERM.format(n='n_options', salt='42|permute|0', k="q.clip || '|' || q.prompt")} perm
        from questions q join k on k.clip = q.clip and k.prompt = q.prompt and k.r = 1)
select clip, qtype, array_to_string(list_transform(perm, lambda i: answers[i + 1]), ' ## ') options,
  chr((64 + list_position(perm, correct_index))::int) || ') ' || answers[correct_index + 1] chosen_answer,
  chr((64 + list_position(perm, pos))::int) || ') ' || answers[pos + 1] rejected_answer from p""", "results"))
def permuted_pairs(spark, sf):
    out = prep.permute_pairs(_pairs(spark, sf, "fixed"))
    return out.select("clip", "qtype", F.array_join("answers", " ## ").alias("options"), "chosen_answer", "rejected_answer")


_MOD = "list_reduce(list_prepend(0::hugeint, list_transform(range(8), lambda i: ('0x' || substr(sha2, i * 8 + 1, 8))::hugeint)), lambda a, w: (a * 4294967296 + w) % cand)"


@query("one_shot_references", sql(_RETR + f"""
, buckets as (select qtype, is_trick, count(*) n from train group by all),
idx as (select *, row_number() over (partition by qtype, is_trick order by clip, prompt) - 1 pos from train),
own as (select qtype, is_trick, group_id, list(pos order by pos) ps from idx group by all),
a as (select t.clip, t.prompt, t.qtype, t.is_trick wanted, t.group_id, coalesce(b1.is_trick, b2.is_trick) is_trick, coalesce(b1.n, b2.n) n
      from test t left join buckets b1 on b1.qtype = t.qtype and b1.is_trick = t.is_trick
      left join buckets b2 on b2.qtype = t.qtype and b2.is_trick = (not t.is_trick)),
c as (select a.*, coalesce(ps, []) ps, n - len(coalesce(ps, [])) cand, sha256(a.clip || '|' || a.prompt || '|' || a.qtype) sha2
      from a left join own o on o.qtype = a.qtype and o.is_trick = a.is_trick and o.group_id is not distinct from a.group_id),
j as (select *, {_MOD}::bigint j from c where cand > 0),
p as (select *, j + len(list_filter(ps, lambda v, i: v - (i - 1) <= j)) pos from j)
select p.clip, p.prompt, p.wanted is_trick, idx.clip ref_clip, idx.prompt ref_prompt from p join idx using (qtype, is_trick, pos)
union all select clip, prompt, wanted, null, null from c where cand <= 0 or cand is null""", "questions"))
def one_shot_references(spark, sf):
    test, train = _retrieval_sides(spark, sf)
    return prep.retrieve_one_shot(test, train, carried=()).select("clip", "prompt", "is_trick", "ref_clip", "ref_prompt")


@query("referenced_media", sql("""
select clip from questions where qtype = 'primary_action' and group_id like 'g_1%' union select clip from questions where group_id like 'g_2%'""", "questions"))
def referenced_media(spark, sf):
    q = questions(spark, sf)
    return prep.referenced_media([q.filter("qtype = 'primary_action' and group_id like 'g_1%'"), q.filter("group_id like 'g_2%'")])


_FRAMES = "frames as (select distinct 'clip_' || l_orderkey stem, (l_linenumber - 1) frame_no from lineitem)"


@query("clips_with_complete_frames", sql("""
, """ + _FRAMES + """, f as (select stem from frames where frame_no < 3 group by 1 having count(*) = 3)
select clip, qtype from questions semi join f on f.stem = questions.clip""", "questions"))
def clips_with_complete_frames(spark, sf):
    """Line items stand for stored frames; three are needed."""
    frames = table(spark, sf, "lineitem").select(
        F.concat(F.lit("clip_"), F.col("l_orderkey").cast("string")).alias("stem"), (F.col("l_linenumber") - 1).alias("frame_no"))
    return prep.with_complete_frames(questions(spark, sf), frames, 3).select("clip", "qtype")


@query("inconsistent_questions", sql("""
, b as (select * replace (case when right(clip, 1) = '4' then correct_index + 5 else correct_index end as correct_index,
                          case when right(clip, 1) = '5' then 'other' else correct_answer end as correct_answer) from questions)
select clip, qtype, case when correct_index >= n_options then 'range' else 'text' end fault from b
where correct_index >= n_options or answers[correct_index + 1] <> correct_answer""", "questions"))
def inconsistent_questions(spark, sf):
    tail = F.right("clip", F.lit(1))
    broken = questions(spark, sf).withColumns({
        "correct_index": F.when(tail == "4", F.col("correct_index") + 5).otherwise(F.col("correct_index")),
        "correct_answer": F.when(tail == "5", "other").otherwise(F.col("correct_answer"))})
    return prep.quarantine(broken).select("clip", "qtype", "fault")
