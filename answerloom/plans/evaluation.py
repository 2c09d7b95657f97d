"""Registered queries: scoring and evaluation roll-ups (C, D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import dialects as dia
from ..functions.hashing import hash_int
from ..operators import accuracy as acc
from ..operators import attribution as att
from ..operators import confusion as con
from .registry import query
from .view_sql import sql
from .views import MODELS, VIEW_TYPES, clips, questions, results, table

ONCE = ["qtype"]  # the view issues each question once, so any order names its last row
R6 = lambda c: F.round(F.col(c), 6).alias(c)


def rounded(df, *cols):
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


# --- the minimal slice: which distractor fools each model, by tier -------------------------

@query("distractor_vulnerability_by_tier", sql("""
, w as (select model, q.qtype, option_hardness[selected + 1] label from results r join questions q using (clip, prompt)
        where not r.is_correct and selected is not null),
  t as (select model, tier_name tier, label, count(*) n from w join tiers using (qtype) where label <> 'correct' group by all)
select model, tier, label, n, sum(n) over (partition by model, tier)::bigint errors,
       round(n * 100.0 / sum(n) over (partition by model, tier), 6) share from t""", "results", tiers=True))
def distractor_vulnerability_by_tier(spark, sf):
    found = att.with_tier(att.attribute_errors(results(spark, sf), questions(spark, sf), order=ONCE))
    return rounded(att.error_shares(found, ["model", "tier"]), "share")


# --- C: dialects -------------------------------------------------------------------------

STRIP = "trim({}, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' ')"
L, E = "(?:^|[^\\p{L}\\p{N}_])", "(?:$|[^\\p{L}\\p{N}_])"
_LETTER = f"nullif(regexp_extract(t, '(?i){L}([A-H]){E}', 1), '')"
_num = lambda p, flags="": f"try_cast(nullif(regexp_extract(t, '{flags}{p}', 1), '') as int) - 1"
_in = lambda e, n: f"case when {e} between 0 and {n} - 1 then {e} end"

SQL_INDEX = {
    "letter": f"ascii(upper({_LETTER})) - 65",
    "number": "coalesce(" + ", ".join(
        _in(_num(p, f), "n") for p, f in ((r"^(\d)$", ""), (r"(?:answer|option|choice)[\s:]*(\d)", "(?i)"),
                                          (r"^(\d)\.", ""), (r"^\((\d)\)", ""), (r"(\d)(?:\s|$)", "")))
    + ", list_position(list_transform(answers, lambda a: contains(lower(t), lower(a))), true) - 1)",
    "raw": _in(_num(f"{L}(\\d+){E}"), "n"),
    "leading": f"coalesce({_num('^(\\d+)')}, ascii(upper(nullif(regexp_extract(t, '^([A-Ha-h])', 1), ''))) - 65)",
    "role_graph": _num(r"(\d+)"),
    "letter_d": _in(f"(ascii(nullif(regexp_extract(upper(t), '{L}([A-D]){E}', 1), '')) - 65)", "n"),
    "letter_or_digit": f"coalesce({_in(f'(ascii(upper({_LETTER})) - 65)', 'n')}, "
                       "list_filter(range(1, n + 1), lambda k: starts_with(t, k::varchar))[1] - 1)",
}

_TALK_SQL = """
talk as (select conv_id::varchar || '-' || turn::varchar clip, {strip} t, text response,
   ['the', role, 'one two', left(text, 3), right(text, 9), 'von', 'de la', 'none'] answers, 8 n, (turn % 8)::int correct_index
   from conversations
   union all select 'd' || doc_id, {strip}, text, ['the', source, 'and of', left(text, 4)], 4, (doc_id % 4)::int from documents)
""".format(strip=STRIP.format("text"))


def talk(spark, sf):
    """Conversation turns and documents as free responses to an eight- or four-option question."""
    c = table(spark, sf, "conversations")
    d = table(spark, sf, "documents")
    lit = F.lit
    first = c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("clip"),
        F.col("text").alias("response"),
        F.array(lit("the"), F.col("role"), lit("one two"), F.left("text", lit(3)), F.right("text", lit(9)),
                lit("von"), lit("de la"), lit("none")).alias("answers"),
        (F.col("turn") % 8).cast("int").alias("correct_index"))
    second = d.select(
        F.concat(lit("d"), F.col("doc_id").cast("string")).alias("clip"), F.col("text").alias("response"),
        F.array(lit("the"), F.col("source"), lit("and of"), F.left("text", lit(4))).alias("answers"),
        (F.col("doc_id") % 4).cast("int").alias("correct_index"))
    return first.unionByName(second)


def _dialect_queries():
    for name, expr in SQL_INDEX.items():
        hit = "coalesce(i = correct_index, false)"
        if name == "letter":
            hit = ("case when i is not null then i = correct_index else trim(lower(answers[correct_index + 1])) <> '' "
                   "and contains(lower(t), trim(lower(answers[correct_index + 1]))) end")
        talk_sql = (
            f"with {_TALK_SQL.strip()}, s as (select *, ({expr})::int i from talk) "
            f"select clip, i selected, {hit} is_correct, i is not null parsed from s")

        @query(f"dialect_{name}_on_texts", talk_sql)
        def on_texts(spark, sf, name=name):
            return dia.score_responses(talk(spark, sf), name).select("clip", "selected", "is_correct", "parsed")

        res_sql = sql(
            f", s as (select *, ({expr})::int i from (select *, response t, n_options n from results where response is not null)) "
            f"select model, qtype, count(*) total, count_if({hit}) correct, count_if(i is not null) parsed from s group by all",
            "results")

        @query(f"dialect_{name}_by_type", res_sql)
        def by_type(spark, sf, name=name):
            rows = results(spark, sf, with_text=name in dia.READ_TEXTS).filter("response is not null")
            return dia.score_responses(rows, name, options="n_options").groupBy("model", "qtype").agg(
                *acc.counts(), F.count_if("parsed").alias("parsed"))


_dialect_queries()


@query("key_from_answer_text", sql("""
select clip, qtype, list_position(list_transform(answers, lambda a: trim(lower(a))), trim(lower(correct_answer)))::int - 1 found,
       correct_index from questions""", "questions"))
def key_from_answer_text(spark, sf):
    return questions(spark, sf).select(
        "clip", "qtype", dia.key_from_text(F.col("answers"), F.col("correct_answer")).alias("found"), "correct_index")


@query("parsed_rate", sql("""
select model, count(*) total, avg(case when selected is null then 0.0 else 1.0 end) parsed_rate from results group by 1""", "results"))
def parsed_rate(spark, sf):
    return acc.parsed_rate(results(spark, sf))


@query("selected_label_counts", sql("""
select model, bank_labels[selected + 1] label, count(*) n from results
where not is_correct and selected >= 0 group by all""", "results"))
def selected_label_counts(spark, sf):
    joined = results(spark, sf).join(questions(spark, sf).select("clip", "qtype", "option_hardness"), ["clip", "qtype"])
    label = dia.selected_label(F.col("is_correct"), F.col("selected"), F.col("option_hardness"))
    return joined.select("model", label.alias("label")).filter("label is not null").groupBy("model", "label").agg(
        F.count("*").alias("n"))


# --- D: roll-ups -----------------------------------------------------------------------------

@query("accuracy_by_type", sql("""
select model, qtype, count(*) total, count_if(is_correct) correct, count_if(is_correct) / count(*)::double accuracy
from results group by all""", "results"))
def accuracy_by_type(spark, sf):
    return acc.accuracy(results(spark, sf), ["model", "qtype"])


@query("label_quality_accuracy", """
select quality, count(*) total, count_if(toxic = 0) correct, count_if(toxic = 0) / count(*)::double accuracy
from labels group by 1""")
def label_quality_accuracy(spark, sf):
    return acc.accuracy(table(spark, sf, "labels").withColumn("is_correct", F.col("toxic") == 0), ["quality"])


@query("primary_secondary_summary", sql("""
, p as (select *, case when is_secondary then 'secondary' else 'primary' end part from results),
g as (select model, part, qtype, grouping_id(model, part, qtype) gid, count(*) total, count_if(is_correct) correct
      from p group by grouping sets ((model, part, qtype), (model, part), (model))),
v as (select model, count(distinct clip) clips from results group by 1)
select model, case gid when 0 then 'type' when 1 then 'part' else 'overall' end as level, part, qtype, total, correct,
       correct / total::double accuracy, clips from g join v using (model)""", "results"))
def primary_secondary_summary(spark, sf):
    return acc.summary(results(spark, sf))


def _tier_sql(name):
    rows = ", ".join(f"('{q}', '{t}')" for q, t in K.TIER_MAPS[name].items())
    return sql(f""", m(qtype, tier) as (values {rows})
select model, tier, count(*) total, count_if(is_correct) correct, count_if(is_correct) / count(*)::double accuracy
from results join m using (qtype) group by all""", "results")


def _tier_queries():
    for name in K.TIER_MAPS:
        @query(f"tier_accuracy_{name}", _tier_sql(name))
        def run(spark, sf, name=name):
            return acc.tier_accuracy(results(spark, sf), name)


_tier_queries()

_TRICK = """
, s as (select model, count_if({t}) trick_total, coalesce(count_if({t} and is_correct) * 100.0 / nullif(count_if({t}), 0), 0) trick_accuracy,
   count_if(not {t}) normal_total, coalesce(count_if(not {t} and is_correct) * 100.0 / nullif(count_if(not {t}), 0), 0) normal_accuracy
   from {src} group by 1)"""


@query("trick_against_normal", sql(_TRICK.format(t="is_trick", src="results") + """
select *, normal_accuracy - trick_accuracy gap from s""", "results"))
def trick_against_normal(spark, sf):
    return acc.trick_split(results(spark, sf).withColumn("is_trick", F.col("is_trick")))


@query("trick_from_bank_range", sql(_TRICK.format(
    t="b.is_trick", src="results r join (select clip, prompt, is_trick from questions where group_id <> 'g_0') b using (clip, prompt)") + """
select min(trick_accuracy) min_trick_accuracy, max(trick_accuracy) max_trick_accuracy,
       min(normal_accuracy) min_normal_accuracy, max(normal_accuracy) max_normal_accuracy from s""", "results"))
def trick_from_bank_range(spark, sf):
    """The bank decides what is a trick question; answers it does not know are dropped."""
    bank = questions(spark, sf).filter("group_id <> 'g_0'").select("clip", "prompt", "is_trick")
    joined = results(spark, sf).drop("is_trick").join(bank, ["clip", "prompt"])
    return acc.accuracy_range(acc.trick_split(joined))


@query("merged_shard_accuracy", sql("""
select model, qtype, is_trick, count(*) total, count_if(is_correct) correct, count_if(is_correct) / count(*)::double accuracy
from results group by all""", "results"))
def merged_shard_accuracy(spark, sf):
    rows = results(spark, sf)
    shard = hash_int(42, "shard", F.col("clip")) % 3
    shards = [rows.filter(shard == i) for i in range(3)]
    return acc.accuracy(acc.merge_shards(shards, ["rows"] * 3), ["model", "qtype", "is_trick"])


@query("merged_summaries", sql("""
, s as (select model, ('0x' || substr(md5('42|shard|' || clip), 1, 8))::bigint % 3 shard, count(*) total,
   count_if(is_correct) correct, avg(case when selected is null then 0.0 else 1.0 end) * 100 pr from results group by all)
select model, sum(total)::bigint total, sum(correct)::bigint correct, sum(floor(pr / 100 * total))::bigint parsed,
  sum(correct) * 100.0 / sum(total) accuracy, sum(floor(pr / 100 * total)) * 100.0 / sum(total) parsed_rate
from s group by 1""", "results"))
def merged_summaries(spark, sf):
    shard = hash_int(42, "shard", F.col("clip")) % 3
    parts = results(spark, sf).withColumn("shard", shard).groupBy("model", "shard").agg(
        *acc.counts(), (F.avg(F.col("selected").isNotNull().cast("double")) * 100).alias("parsed_rate"))
    return acc.merge_summaries(parts)


@query("accuracy_by_action", sql("""
, n as (select clip, lower(trim(coalesce(action, 'none'))) as action from clips),
c as (select action, count(*) clip_count from n group by 1)
select action, model, count(*) total, count_if(is_correct) correct, count_if(is_correct) / count(*)::double * 100 accuracy, clip_count
from results join n using (clip) join c using (action) where error is null group by all""", "results"))
def accuracy_by_action(spark, sf):
    return acc.accuracy_by_attribute(results(spark, sf), clips(spark, sf), "action")


_PEOPLE_SQL = """
, p as (select clip, (aggressor is not null)::int aggressors, (victim is not null)::int victims,
   coalesce(len(bystanders), 0)::int bystanders from clips),
l as (select clip, role, n from (select *, aggressors + victims + bystanders total_people from p)
      unpivot (n for role in (aggressors, victims, bystanders, total_people))),
b as (select model, role, case when n >= 3 then '3+' else n::varchar end bucket, count(*) total, count_if(is_correct) correct,
      count_if(is_correct) * 100.0 / count(*) accuracy from results join l using (clip) where not is_secondary group by all)"""
ROLES = ["aggressors", "victims", "bystanders", "total_people"]


def _people(spark, sf):
    c = clips(spark, sf)
    return c.select(
        "clip", F.col("aggressor").isNotNull().cast("int").alias("aggressors"),
        F.col("victim").isNotNull().cast("int").alias("victims"),
        F.greatest(F.coalesce(F.size("bystanders"), F.lit(0)), F.lit(0)).alias("bystanders")).withColumn(
        "total_people", F.col("aggressors") + F.col("victims") + F.col("bystanders"))


@query("accuracy_by_people", sql(_PEOPLE_SQL + " select * from b", "results"))
def accuracy_by_people(spark, sf):
    return acc.accuracy_by_people(results(spark, sf), _people(spark, sf), ROLES)


@query("accuracy_by_people_delta", sql(_PEOPLE_SQL + """
select model, role, round(max_by(accuracy, bucket) - min_by(accuracy, bucket), 6) delta from b group by all having count(*) > 1""", "results"))
def accuracy_by_people_delta(spark, sf):
    return rounded(acc.people_delta(acc.accuracy_by_people(results(spark, sf), _people(spark, sf), ROLES)), "delta")


_CAP = """
, g(qtype, capability) as (values {rows}),
a as (select model, capability, count(*) total, count_if(is_correct) correct, count_if(is_correct) * 100.0 / count(*) accuracy
      from results join g using (qtype) where error is null group by all)""".format(
    rows=", ".join(f"('{q}', '{c}')" for c, qs in K.CAPABILITY_GROUPS.items() for q in qs))


@query("capability_accuracy", sql(_CAP + " select * from a", "results"))
def capability_accuracy(spark, sf):
    return acc.capability_accuracy(results(spark, sf))


@query("composition_gap", sql(_CAP + """
, w as (select model, max(accuracy) filter (capability = 'Action Only') action_accuracy,
  max(accuracy) filter (capability = 'Role Only') role_accuracy,
  max(accuracy) filter (capability = 'Action + Role (compound)') compound_accuracy from a group by 1)
select *, action_accuracy - compound_accuracy gap from w""", "results"))
def composition_gap(spark, sf):
    return acc.composition_gap(acc.capability_accuracy(results(spark, sf)))


_TIER = """
, a as (select model, tier_name tier, count_if(is_correct) / count(*)::double * 100 accuracy
        from results join tiers using (qtype) group by all)"""


@query("tier_drop", sql(_TIER + """
select model, max(accuracy) filter (tier = 'Basic') as basic, max(accuracy) filter (tier = 'Compound') as compound,
  max(accuracy) filter (tier = 'Detailed') as detailed,
  max(accuracy) filter (tier = 'Basic') - max(accuracy) filter (tier = 'Detailed') as "drop" from a group by 1""", "results", tiers=True))
def tier_drop(spark, sf):
    return acc.tier_drop(acc.tier_accuracy(results(spark, sf)))


@query("tier_envelope", sql(_TIER + "select tier, min(accuracy) lowest, max(accuracy) highest from a group by 1", "results", tiers=True))
def tier_envelope(spark, sf):
    return acc.tier_envelope(acc.tier_accuracy(results(spark, sf)))


SIZES = {m: size for m, size, *_ in MODELS}
_SIZE = _TIER + """
, z(model, size) as (values ('atlas-8b', 'small'), ('atlas-70b', 'large'), ('borea-7b', 'small'), ('cirrus-think', 'reasoning')),
s as (select size, tier, avg(accuracy) mean_accuracy, stddev_pop(accuracy) std_accuracy, count(*) models from a join z using (model) group by all)"""


@query("scale_comparison", sql(_SIZE + """
select size, tier, round(mean_accuracy, 6) mean_accuracy, round(std_accuracy, 6) std_accuracy, models from s""", "results", tiers=True))
def scale_comparison(spark, sf):
    return rounded(acc.scale_comparison(acc.tier_accuracy(results(spark, sf)), SIZES), "mean_accuracy", "std_accuracy")


@query("scale_gap", sql(_SIZE + """
select tier, round(max(mean_accuracy) filter (size = 'large') - max(mean_accuracy) filter (size = 'small'), 6) gap from s group by 1""",
                        "results", tiers=True))
def scale_gap(spark, sf):
    return rounded(acc.size_gap(acc.scale_comparison(acc.tier_accuracy(results(spark, sf)), SIZES)), "gap")


@query("family_pairs", sql(_TIER + """
select 'atlas' as family, tier, max(accuracy) filter (model = 'atlas-8b') small_accuracy,
  max(accuracy) filter (model = 'atlas-70b') large_accuracy from a where model like 'atlas%' group by 2""", "results", tiers=True))
def family_pairs(spark, sf):
    return acc.family_pairs(acc.tier_accuracy(results(spark, sf)), [("atlas-8b", "atlas-70b", "atlas")])


MATRIX_TYPES = [t for t, _, _ in VIEW_TYPES]


@query("type_matrix", sql(""", a as (select model, qtype, count_if(is_correct) / count(*)::double * 100 x from results group by all),
w as (select model, {cols} from a group by 1),
u as (select * from w union all select 'AVERAGE', {avgs} from w)
select model, {rounded}, round(({plus}) / {n}, 6) row_mean from u""".format(
    cols=", ".join(f"max(x) filter (qtype = '{t}') {t}" for t in MATRIX_TYPES),
    avgs=", ".join(f"avg({t})" for t in MATRIX_TYPES), rounded=", ".join(f"round({t}, 6) {t}" for t in MATRIX_TYPES),
    plus=" + ".join(MATRIX_TYPES), n=len(MATRIX_TYPES)), "results"))
def type_matrix(spark, sf):
    return rounded(acc.type_matrix(results(spark, sf), MATRIX_TYPES), *MATRIX_TYPES, "row_mean")


@query("heatmap_rows_by_overall", sql("""
select model, count_if(is_correct) correct, count_if(error is null) answered,
  count_if(is_correct) / count_if(error is null)::double * 100 overall from results group by 1 order by 4 desc, 1 limit 3""", "results"))
def heatmap_rows_by_overall(spark, sf):
    return acc.top_models(results(spark, sf), 3)


# --- D13-D15: confusion ------------------------------------------------------------------------

_ROLE_PAIRS = """
, p as (select model, case when selected is not null then answers[correct_index + 1] end true_role,
   case when selected is not null then answers[selected + 1] end pred_role from results where qtype = 'role_identification'),
c as (select model, true_role, pred_role, count(*) n from p where true_role is not null and pred_role is not null group by all)"""


@query("role_label_confusion", sql(_ROLE_PAIRS + """
select *, round(n * 100.0 / sum(n) over (partition by model, true_role), 6) row_share from c""", "results"))
def role_label_confusion(spark, sf):
    pairs = con.role_pairs(results(spark, sf, with_text=True))
    return rounded(con.confusion(pairs, "true_role", "pred_role"), "row_share")


@query("role_label_skipped", sql(_ROLE_PAIRS + """
select model, count(*) total, count_if(true_role is null or pred_role is null) skipped from p group by 1""", "results"))
def role_label_skipped(spark, sf):
    return con.skipped(con.role_pairs(results(spark, sf, with_text=True)))


@query("quality_toxic_confusion", """
select quality, toxic, count(*) n, round(count(*) * 100.0 / sum(count(*)) over (partition by quality), 6) row_share
from labels group by quality, toxic""")
def quality_toxic_confusion(spark, sf):
    return rounded(con.confusion(table(spark, sf, "labels"), "quality", "toxic", by=()), "row_share")


_SP = lambda e: f"list_distinct(list_filter(regexp_split_to_array(lower({e}), '\\s+'), lambda w: w not in ('', 'a', 'the', 'in', 'with', 'and', 'person', 'wearing')))"
_JAC = lambda a, b: f"(len({a}) > 0 and len({b}) > 0 and len(list_intersect({a}, {b})) >= 0.4 * len(list_distinct(list_concat({a}, {b}))))"


@query("role_description_confusion", sql(f"""
, p as (select model, case qtype when 'aggressor_identification' then 'aggressor' else 'victim' end true_role, is_correct, selected,
   {_SP('answers[selected + 1]')} st, {_SP('aggressor')} ta, {_SP('victim')} tv,
   list_transform(coalesce(bystanders, []), lambda b: {_SP('b')}) tb
   from results join clips using (clip) where error is null and qtype in ('aggressor_identification', 'victim_recognition')),
c as (select model, true_role, case when is_correct then true_role when selected is null then 'unknown/cross-video'
   when {_JAC('st', 'ta')} then 'aggressor' when {_JAC('st', 'tv')} then 'victim'
   when list_bool_or(list_transform(tb, lambda x: {_JAC('st', 'x')})) then 'bystander'
   else 'unknown/cross-video' end pred_role, count(*) n from p group by all)
select *, round(n * 100.0 / sum(n) over (partition by model, true_role), 6) row_share from c""", "results"))
def role_description_confusion(spark, sf):
    return rounded(con.role_confusion(results(spark, sf, with_text=True), clips(spark, sf)), "row_share")


_BIAS = _ROLE_PAIRS + """
, b as (select model,
   coalesce(sum(n) filter (true_role = 'Victim' and pred_role = 'Aggressor'), 0) * 100.0 / greatest(coalesce(sum(n) filter (true_role = 'Victim'), 0), 1) vic_to_agg,
   coalesce(sum(n) filter (true_role = 'Aggressor' and pred_role = 'Victim'), 0) * 100.0 / greatest(coalesce(sum(n) filter (true_role = 'Aggressor'), 0), 1) agg_to_vic,
   coalesce(sum(n) filter (true_role = 'Bystander' and pred_role = 'Aggressor'), 0) * 100.0 / greatest(coalesce(sum(n) filter (true_role = 'Bystander'), 0), 1) byst_to_agg,
   coalesce(sum(n) filter (pred_role = 'Aggressor'), 0) * 100.0 / sum(n) agg_pred_rate from c group by 1)"""


def _bias(spark, sf):
    pairs = con.role_pairs(results(spark, sf, with_text=True), loose=True)
    return con.directional_bias(con.confusion(pairs, "true_role", "pred_role"))


@query("directional_bias", sql(_BIAS + """
select model, round(vic_to_agg, 6) vic_to_agg, round(agg_to_vic, 6) agg_to_vic, round(byst_to_agg, 6) byst_to_agg,
  round(agg_pred_rate, 6) agg_pred_rate, round(vic_to_agg / greatest(agg_to_vic, 0.1), 6) bias_ratio from b""", "results"))
def directional_bias(spark, sf):
    return rounded(_bias(spark, sf), "vic_to_agg", "agg_to_vic", "byst_to_agg", "agg_pred_rate", "bias_ratio")


@query("bias_overview", sql(_BIAS + """
select round(median(vic_to_agg), 6) median_vic_to_agg, round(median(agg_to_vic), 6) median_agg_to_vic,
  round(median(byst_to_agg), 6) median_byst_to_agg, count_if(vic_to_agg > agg_to_vic) biased_models, count(*) models,
  round(max(vic_to_agg), 6) worst_vic_to_agg, max_by(model, vic_to_agg) worst_model from b""", "results"))
def bias_overview(spark, sf):
    return rounded(con.bias_overview(_bias(spark, sf)), "median_vic_to_agg", "median_agg_to_vic", "median_byst_to_agg",
                   "worst_vic_to_agg")


# --- D16-D20: attribution ------------------------------------------------------------------------

_WRONG = """
, w as (select model, r.qtype, selected, option_hardness lb, q.is_secondary sec
   from results r left join questions q using (clip, prompt) where not r.is_correct {more})"""


@query("distractor_vulnerability", sql(_WRONG.format(more="and selected is not null") + """
, c as (select model, lb[selected + 1] label, count(*) n from w where lb[selected + 1] <> 'correct' group by all)
select *, sum(n) over (partition by model)::bigint errors, round(n * 100.0 / sum(n) over (partition by model), 6) share from c""", "results"))
def distractor_vulnerability(spark, sf):
    return rounded(att.error_shares(att.attribute_errors(results(spark, sf), questions(spark, sf), order=ONCE)), "share")


@query("distractor_type_analysis", sql(_WRONG.format(more="and selected is not null and error is null") + """
, c as (select model, case when not sec then lb[selected + 1] end label, count(*) n from w group by all),
t as (select *, sum(n) over (partition by model)::bigint errors from c)
select *, round(n * 100.0 / errors, 6) share from t where label is not null""", "results"))
def distractor_type_analysis(spark, sf):
    found = att.attribute_errors(results(spark, sf), questions(spark, sf), "type_analysis", order=ONCE)
    return rounded(att.error_shares(found, denominator="all"), "share")


@query("distractor_type_analysis_by_type", sql(_WRONG.format(more="and selected is not null and error is null") + """
, c as (select model, qtype, lb[selected + 1] label, count(*) n from w where not sec group by all)
select *, sum(n) over (partition by model, qtype)::bigint errors, round(n * 100.0 / sum(n) over (partition by model, qtype), 6) share from c""", "results"))
def distractor_type_analysis_by_type(spark, sf):
    found = att.attribute_errors(results(spark, sf), questions(spark, sf), "type_analysis", order=ONCE)
    return rounded(att.error_shares(found, ["model", "qtype"]), "share")


@query("hardness_error_share", sql(_WRONG.format(more="and selected is not null and not r.is_secondary") + """
, c as (select model, lb[selected + 1] label, count(*) n from w group by all)
select *, sum(n) over (partition by model)::bigint errors, round(n * 100.0 / sum(n) over (partition by model), 6) share from c""", "results"))
def hardness_error_share(spark, sf):
    found = att.attribute_errors(results(spark, sf), questions(spark, sf), "hardness_error", order=ONCE)
    return rounded(att.error_shares(found), "share")


@query("attribution_skip_reasons", sql("""
, b as (select clip, prompt, option_hardness lb from questions where group_id not like 'g_1%'),
w as (select model, selected, lb from results left join b using (clip, prompt) where not is_correct)
select model, case when selected is null then 'bad_index' when lb is null then 'no_match'
  when lb[selected + 1] = 'correct' then 'label_correct' else 'kept' end reason, count(*) n from w group by all""", "results"))
def attribution_skip_reasons(spark, sf):
    """Against a bank that lacks the groups g_1..., so that unmatched answers occur."""
    bank = questions(spark, sf).filter(~F.col("group_id").startswith("g_1"))
    return att.skip_reasons(att.attribute_errors(results(spark, sf), bank, order=ONCE))


@query("accuracy_given_label", sql("""
, e as (select distinct clip, prompt, unnest(option_hardness) label from questions where not is_secondary)
select model, label, count(*) total, count_if(is_correct) correct, count_if(is_correct) * 100.0 / count(*) accuracy
from results join e using (clip, prompt) where not is_secondary and label <> 'correct' group by all""", "results"))
def accuracy_given_label(spark, sf):
    return acc_given(spark, sf)


def acc_given(spark, sf):
    return att.accuracy_given_label(results(spark, sf), questions(spark, sf), ONCE)


_LABEL_GRID = ", ".join(f"('{x}')" for x in K.REPORTED_LABELS)
_SHARES = _WRONG.format(more="and selected is not null") + f"""
, lab(label) as (values {_LABEL_GRID}),
c as (select model, tier_name tier, lb[selected + 1] label, count(*) n from w join tiers using (qtype)
      where lb[selected + 1] <> 'correct' group by all),
s as (select {{by}}, sum(n) errors from c group by all),
d as (select {{by}}, label, sum(n) n from c group by all),
sh as (select {{sby}}, lab.label, coalesce(d.n, 0) * 100.0 / s.errors share from s cross join lab left join d on {{on}} and d.label = lab.label)"""


def _shares(spark, sf, by):
    found = att.with_tier(att.attribute_errors(results(spark, sf), questions(spark, sf), order=ONCE))
    return att.dense_shares(found, by)


@query("label_shift", sql(_SHARES.format(by="model, tier", sby="s.model, s.tier", on="d.model = s.model and d.tier = s.tier") + """
select tier, label, round(avg(share), 6) mean_share, round(stddev_pop(share), 6) std_share from sh group by all""", "results", tiers=True))
def label_shift(spark, sf):
    return rounded(att.label_shift(_shares(spark, sf, ["model", "tier"])), "mean_share", "std_share")


@query("label_share_means", sql(_SHARES.format(by="model", sby="s.model", on="d.model = s.model") + """
select coalesce(model, 'ALL') model, coalesce(label, 'ALL') label, round(avg(share), 6) share from sh group by cube (model, label)""", "results", tiers=True))
def label_share_means(spark, sf):
    return rounded(att.share_means(_shares(spark, sf, ["model"])), "share")


@query("unexpected_labels", sql(f"""
select label, count(*) n from (select unnest(option_hardness) label from questions)
where label <> 'correct' and label not in (select * from (values {_LABEL_GRID})) group by 1""", "questions"))
def unexpected_labels(spark, sf):
    return att.unexpected_labels(questions(spark, sf))


# --- D21-D30 -----------------------------------------------------------------------------------

@query("paired_condition_delta", sql("""
, j as (select a.qtype, a.is_correct x, b.is_correct y from results a join results b using (clip, qtype)
        where a.model = 'atlas-8b' and b.model = 'atlas-70b')
select coalesce(qtype, 'OVERALL') qtype, count(*) total, round(count_if(x) * 100.0 / count(*), 2) normal,
  round(count_if(y) * 100.0 / count(*), 2) shuffled, round((count_if(y) - count_if(x)) * 100.0 / count(*), 2) delta
from j group by grouping sets ((qtype), ())""", "results"))
def paired_condition_delta(spark, sf):
    rows = results(spark, sf)
    b = rows.filter("model = 'atlas-70b'").select("clip", F.col("qtype").alias("asked"), "is_correct")
    a = rows.filter("model = 'atlas-8b'").withColumn("asked", F.col("qtype"))
    return acc.paired_delta(a, b, ["clip", "asked"], ["asked"])  # answered once each; never by outcome, which would hide flips


STAGES = {"sft": 1, "cot": 2, "dpo": 3}


def staged(spark, sf):
    """Three models as training stages; the second stage skipped some clips."""
    stage = acc.map_column({"atlas-8b": "sft", "cirrus-think": "cot", "atlas-70b": "dpo"}, F.col("model"))
    rows = results(spark, sf).withColumn("stage", stage).filter("stage is not null")
    return rows.filter((F.col("stage") != "cot") | (hash_int(42, "gap", F.col("clip")) % 10 != 0))


_STAGED = """
, st as (select *, case model when 'atlas-8b' then 'sft' when 'cirrus-think' then 'cot' else 'dpo' end stage from results
   where model <> 'borea-7b' and (model <> 'cirrus-think' or ('0x' || substr(md5('42|gap|' || clip), 1, 8))::bigint % 10 <> 0))"""


@query("stage_transitions", sql(_STAGED + """
, p as (select *, case stage when 'sft' then 1 when 'cot' then 2 else 3 end no from st)
select step, change, count(*) n from (
  select a.stage || '->' || b.stage step, case when a.is_correct then 'REGRESSED' else 'FIXED' end change
  from p a join p b on a.clip = b.clip and a.prompt = b.prompt and b.no = a.no + 1 where a.is_correct <> b.is_correct)
group by all""", "results"))
def stage_transitions(spark, sf):
    return acc.stage_transitions(staged(spark, sf), STAGES, ["qtype"]).groupBy("step", "change").agg(F.count("*").alias("n"))


@query("stage_transitions_last_attempt", sql(_STAGED + """
, tries as (select clip, prompt, stage, is_correct, 1 load from st
            union all select clip, prompt, stage, not is_correct, 2 from st where ('0x' || substr(md5('42|retry|' || clip || stage), 1, 8))::bigint % 3 = 0),
p as (select clip, prompt, case stage when 'sft' then 1 when 'cot' then 2 else 3 end no, stage, arg_max(is_correct, load) ok from tries group by all)
select step, change, count(*) n from (
  select a.stage || '->' || b.stage step, case when a.ok then 'REGRESSED' else 'FIXED' end change
  from p a join p b on a.clip = b.clip and a.prompt = b.prompt and b.no = a.no + 1 where a.ok <> b.ok)
group by all""", "results"))
def stage_transitions_last_attempt(spark, sf):
    """Some clips answered twice at a stage, the second time the other way."""
    first = staged(spark, sf)
    again = first.filter(hash_int(42, "retry", F.concat("clip", "stage")) % 3 == 0).withColumn("is_correct", ~F.col("is_correct"))
    tries = first.withColumn("load", F.lit(1)).unionByName(again.withColumn("load", F.lit(2)))
    return acc.stage_transitions(tries, STAGES, ["load"]).groupBy("step", "change").agg(F.count("*").alias("n"))


@query("ablation_table", sql(_STAGED + """
, l as (select stage, qtype line, is_correct from st union all select stage, 'OVERALL', is_correct from st
   union all select stage, case when is_trick then 'Trick questions' else 'Normal questions' end, is_correct from st),
a as (select stage, line, count(*) total, count_if(is_correct) correct, count_if(is_correct) * 100.0 / count(*) accuracy from l group by all)
select a.stage, line, a.total, a.correct, a.accuracy, case when a.stage <> 'sft' then a.accuracy - b.accuracy end delta
from a left join a b using (line) where b.stage = 'sft'""".replace("select a.stage, line", "select a.stage, a.line").replace(
    "using (line) where b.stage = 'sft'", "on a.line = b.line and b.stage = 'sft'"), "results"))
def ablation_table(spark, sf):
    return acc.ablation_table(staged(spark, sf), list(STAGES))


_pct = lambda types: "round(count_if(is_correct and qtype in ({0})) * 100.0 / nullif(count_if(qtype in ({0})), 0), 2)".format(
    ", ".join(f"'{t}'" for t in types))
_by_tier = lambda t: [q for q, x in K.TIER_MAPS["basic_compound_detailed"].items() if x == t]


@query("leaderboard", sql(", w as (select model, " + ", ".join(
    [f"{_pct([t])} {t}" for t in K.PRIMARY_LEADERBOARD_TYPES]
    + [f"{_pct(_by_tier(t))} as {t.lower()}" for t in ("Basic", "Compound", "Detailed")]
    + [f"{_pct(K.PRIMARY_LEADERBOARD_TYPES)} primary_accuracy", f"{_pct(K.SECONDARY_TYPES)} secondary_accuracy",
       f"{_pct(K.PRIMARY_LEADERBOARD_TYPES + K.SECONDARY_TYPES)} overall_accuracy"]) + """ from results group by 1)
select *, round((basic + compound + detailed) / 3, 2) average, round(basic - compound, 2) drop_compound,
  round(compound - detailed, 2) drop_detailed from w""", "results"))
def leaderboard(spark, sf):
    return acc.leaderboard(results(spark, sf))


@query("error_summary", sql("""
select model, count(*) total, count_if(error is not null) errors, count_if(error is null and selected is null) no_valid_response,
  count_if(error is null and selected is not null) valid from results group by 1""", "results"))
def error_summary(spark, sf):
    return acc.error_summary(results(spark, sf))


def grades(spark, sf):
    """A rubric grade per document turn of the assistant, scores 0-2 from its hash."""
    c = table(spark, sf, "conversations").filter("role = 'assistant'")
    scores = [(hash_int(42, k, F.col("conv_id"), F.col("turn")) % 3).cast("int").alias(k) for k in K.RUBRIC]
    return c.select("conv_id", "turn", (F.col("conv_id") % 3 > 0).alias("is_aggressive"), *scores)


@query("rubric_means", "with g as (select conv_id % 3 > 0 agg, " + ", ".join(
    f"('0x' || substr(md5('42|{k}|' || conv_id || '|' || turn), 1, 8))::bigint % 3 {k}" for k in K.RUBRIC) + """
from conversations where role = 'assistant')
select case when grouping(agg) = 1 then 'overall' when agg then 'aggressive' else 'non_aggressive' end part, """ + ", ".join(
    f"round(avg({k}), 2) {k}" for k in K.RUBRIC) + ", round(avg(" + " + ".join(K.RUBRIC) + """), 2) mean_total, count(*) graded
from g group by grouping sets ((agg), ())""")
def rubric_means(spark, sf):
    return acc.rubric_means(grades(spark, sf))


_JUDGED = """with g as (select conv_id % 3 > 0 agg, h % 7 = 0 refused, case when h % 11 = 0 then null else h % 2 = 0 end ok
from (select *, ('0x' || substr(md5('42|judge|' || conv_id || '|' || turn), 1, 8))::bigint h from conversations))
select """


@query("judged_accuracy", _JUDGED + ", ".join(
    f"count_if(ok and not refused and {w}) {n}_correct, count_if(ok is not null and not refused and {w}) {n}_total, "
    f"round(count_if(ok and not refused and {w}) * 100.0 / greatest(count_if(ok is not null and not refused and {w}), 1), 2) {n}_accuracy"
    for w, n in (("true", "overall"), ("agg", "aggressive"), ("not agg", "non_aggressive"))) +
    ", count_if(refused) refusals, count_if(ok is null) judge_errors from g")
def judged_accuracy(spark, sf):
    h = hash_int(42, "judge", F.col("conv_id"), F.col("turn"))
    rows = table(spark, sf, "conversations").select(
        (F.col("conv_id") % 3 > 0).alias("is_aggressive"), (h % 7 == 0).alias("skipped_refusal"),
        F.when(h % 11 != 0, h % 2 == 0).alias("is_correct"))
    return acc.judged_accuracy(rows)


@query("questions_per_clip", sql("""
select model, clip, count(*) num_questions, count_if(is_correct) num_correct from results group by all""", "results"))
def questions_per_clip(spark, sf):
    return acc.checkpoint_counts(results(spark, sf))


@query("retrieval_run_summary", sql("""
select coalesce(qtype, 'OVERALL') qtype, count(*) total, count_if(is_correct) correct, count_if(is_correct) * 100.0 / count(*) accuracy,
  count_if(selected is not null) * 100.0 / count(*) parsed_rate, count_if(not is_trick) with_reference
from results where model = 'borea-7b' group by grouping sets ((qtype), ())""", "results"))
def retrieval_run_summary(spark, sf):
    rows = results(spark, sf).filter("model = 'borea-7b'").withColumn("has_reference", ~F.col("is_trick"))
    return acc.retrieval_summary(rows)


@query("enrichment_summary", """
with l as (select 'event_type' field, event_type as value from events union all select 'kind', coalesce(props->>'k', '?') from events)
select field, value, n from (select field, value, count(*) n, row_number() over (partition by field order by count(*) desc, value) rn
  from l group by field, value) where rn <= 10""")
def enrichment_summary(spark, sf):
    from ..functions.freetext import json_object

    e = table(spark, sf, "events").select("event_type", json_object(F.col("props"), "k string")["k"].alias("kind"))
    return acc.enrichment_summary(e, ["event_type", "kind"])
