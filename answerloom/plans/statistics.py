"""Registered queries: dataset statistics and the shortcut audit (E), rankings (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import people as ppl
from ..operators import stats as st
from ..operators.ranking import evenly_spaced, sorted_ordinal, top_k
from .evaluation import rounded
from .registry import query
from .view_sql import sql
from .views import clips, questions, raw_annotations, results, table


@query("environment_distribution", sql("""
, e as (select case when environment is null or lower(trim(environment)) in ('', 'none', 'n/a') then '(not annotated)' else lower(trim(environment)) end environment from raw_annotations)
select environment, count(*) n, round(count(*) * 100.0 / (select count(*) from e), 6) share from e group by 1""", "raw"))
def environment_distribution(spark, sf):
    value = ppl.presence(F.col("environment"), "(not annotated)")
    return rounded(st.value_distribution(raw_annotations(spark, sf), value, "environment"), "share")


@query("outcome_distribution", sql("""
, e as (select case when outcome is null or lower(trim(outcome)) in ('', 'n/a') then '(no outcome field)' else lower(trim(outcome)) end outcome from raw_annotations)
select outcome, count(*) n, round(count(*) * 100.0 / (select count(*) from e), 6) share from e group by 1""", "raw"))
def outcome_distribution(spark, sf):
    value = ppl.presence(F.col("outcome"), "(no outcome field)", ("", "n/a"))
    return rounded(st.value_distribution(raw_annotations(spark, sf), value, "outcome"), "share")


@query("event_type_distribution", """
select event_type, count(*) n, round(count(*) * 100.0 / (select count(*) from events), 6) share from events group by 1""")
def event_type_distribution(spark, sf):
    return rounded(st.value_distribution(table(spark, sf, "events"), F.col("event_type"), "event_type"), "share")


@query("action_long_tail", sql("""
, c as (select lower(trim(coalesce(action, 'none'))) as action, count(*) n from clips group by 1 having lower(trim(coalesce(action, 'none'))) <> 'none')
select action, n, round(n * 100.0 / sum(n) over (), 6) share,
  round(sum(n) over (order by n desc, action rows unbounded preceding) * 100.0 / sum(n) over (), 6) cumulative_share from c""", "clips"))
def action_long_tail(spark, sf):
    value = F.lower(F.trim(F.coalesce("action", F.lit("none"))))
    return rounded(st.long_tail(clips(spark, sf), value, "action"), "share", "cumulative_share")


@query("user_long_tail", """
with c as (select user_id::varchar u, count(*) n from events group by 1)
select u as user_id, n, round(n * 100.0 / sum(n) over (), 6) share,
  round(sum(n) over (order by n desc, u rows unbounded preceding) * 100.0 / sum(n) over (), 6) cumulative_share from c""")
def user_long_tail(spark, sf):
    value = F.col("user_id").cast("string")
    return rounded(st.long_tail(table(spark, sf, "events"), value, "user_id"), "share", "cumulative_share")


@query("action_concentration", sql("""
, c as (select lower(trim(action)) as value, count(*) n from clips where action is not null group by 1)
select round((select sum(n) from (select n from c order by n desc, value limit 3)) * 100.0 / sum(n), 6) top_share,
  count_if(n < 15) rare_values, count(*) as "values" from c""", "clips"))
def action_concentration(spark, sf):
    value = F.lower(F.trim(F.coalesce("action", F.lit("none"))))
    return rounded(st.concentration(clips(spark, sf), value), "top_share")


@query("group_structure", sql("""
select category, count(distinct group_id) as "groups", count(*) clips, count(*) / count(distinct group_id)::double clips_per_group
from clips group by 1""", "clips"))
def group_structure(spark, sf):
    return st.group_structure(clips(spark, sf))


_LISTED = lambda c: f"case when {c} is null then [] when {c} like '[%' then list_filter(list_transform(json({c})::varchar[], lambda v: trim(v)), lambda v: v is not null and v <> '') when lower(trim({c})) in ('', 'none', 'n/a') then [] else [trim({c})] end"
_COVER = """
, f as (select file_name clip, contains(lower(file_name), 'normal') normal,
   case when lower(trim(action)) in ('', 'none', 'n/a') then null else trim(action) end as action,
   case when lower(trim(environment)) in ('', 'none', 'n/a') then null else trim(environment) end environment,
   {a} aggressor, {v} victim, {b} bystander from raw_annotations),
l as (select clip, normal, 'action' field, action as value from f union all select clip, normal, 'environment', environment from f
   union all select clip, normal, 'aggressor', unnest(case when len(aggressor) = 0 then [null] else aggressor end) from f
   union all select clip, normal, 'victim', unnest(case when len(victim) = 0 then [null] else victim end) from f
   union all select clip, normal, 'bystander', unnest(case when len(bystander) = 0 then [null] else bystander end) from f)
""".format(a=_LISTED("aggressor"), v=_LISTED("victim"), b=_LISTED("bystanders"))


def _listed(raw):
    """A raw person field as its list of entries, empty when nobody is named."""
    kind = ppl.raw_kind(raw)
    items = F.filter(F.transform(ppl.raw_list(raw), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.when(kind == "list", items).when(
        kind.isin("str", "int") & ~ppl.none_like(raw), F.array(F.trim(raw))).otherwise(F.array().cast("array<string>"))


def field_rows(spark, sf):
    raw = raw_annotations(spark, sf)
    one = lambda c: F.when(ppl.is_missing(F.col(c)), F.array(F.lit(None).cast("string"))).otherwise(F.array(F.trim(c)))
    many = lambda c: F.when(F.size(_listed(F.col(c))) > 0, _listed(F.col(c))).otherwise(F.array(F.lit(None).cast("string")))
    fields = {"action": one("action"), "environment": one("environment"), "aggressor": many("aggressor"),
              "victim": many("victim"), "bystander": many("bystanders")}
    entries = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.alias("vals")) for k, v in fields.items()]))
    return raw.select(F.col("file_name").alias("clip"), ppl.normal_by_name(F.col("file_name")).alias("normal"),
                      entries.alias("e")).select("clip", "normal", "e.field", F.explode("e.vals").alias("value"))


@query("field_coverage", sql(_COVER + """
select field, count(value) present, count_if(value is null and not normal) missing, count(distinct value) unique_values from l group by 1""", "raw"))
def field_coverage(spark, sf):
    return st.field_coverage(field_rows(spark, sf))


_PH = """
, p as (select (aggressor is not null)::int aggressors, (victim is not null)::int victims, coalesce(len(bystanders), 0)::int bystanders from clips),
h as (select role, n people, count(*) clips from (select *, aggressors + victims + bystanders all_people from p)
  unpivot (n for role in (aggressors, victims, bystanders, all_people)) group by all)"""


def _hist(spark, sf):
    from .evaluation import _people
    return st.people_histogram(_people(spark, sf), ["aggressors", "victims", "bystanders"])


@query("people_histogram", sql(_PH + " select * from h", "clips"))
def people_histogram(spark, sf):
    return _hist(spark, sf)


@query("mean_people", sql(_PH + " select role, sum(people * clips) / sum(clips)::double mean_people from h group by 1", "clips"))
def mean_people(spark, sf):
    return st.mean_people(_hist(spark, sf))


@query("top_descriptions_per_role", sql("""
, l as (select 'aggressor' role, aggressor person from clips where aggressor is not null
  union all select 'victim', victim from clips where victim is not null
  union all select 'bystander', unnest(bystanders) from clips),
c as (select role, person, count(*) n from l group by all)
select role, person, n from (select *, row_number() over (partition by role order by n desc, person) rn from c) where rn <= 10""", "clips"))
def top_descriptions_per_role(spark, sf):
    people = F.array(
        F.struct(F.lit("aggressor").alias("role"), F.array("aggressor").alias("p")),
        F.struct(F.lit("victim").alias("role"), F.array("victim").alias("p")),
        F.struct(F.lit("bystander").alias("role"), F.coalesce("bystanders", F.array().cast("array<string>")).alias("p")))
    long = clips(spark, sf).select(F.explode(people).alias("e")).select("e.role", F.explode("e.p").alias("person"))
    return st.top_descriptions(long.filter("person is not null"))


@query("name_prefixes", sql("""
select split_part(file_name, '_', 1) prefix, count(*) n from raw_annotations where contains(file_name, '_') group by 1""", "raw"))
def name_prefixes(spark, sf):
    return st.name_prefixes(raw_annotations(spark, sf), F.col("file_name"))


@query("missing_environment_listing", sql("""
select file_name clip from raw_annotations where not contains(lower(file_name), 'normal')
  and (environment is null or lower(trim(environment)) in ('', 'none', 'n/a'))""", "raw"))
def missing_environment_listing(spark, sf):
    raw = raw_annotations(spark, sf)
    return raw.filter(~ppl.normal_by_name(F.col("file_name")) & ppl.is_missing(F.col("environment"))).select(
        F.col("file_name").alias("clip"))


@query("answer_count_by_type", sql("""
select qtype, len(answers) n_answers, count(*) questions from questions where not is_secondary group by all""", "questions"))
def answer_count_by_type(spark, sf):
    return st.answer_counts(questions(spark, sf), ["qtype"])


@query("type_profile", sql("""
select qtype, count(*) questions, count_if(is_trick) tricks, round(count(*) * 100.0 / (select count(*) from questions where not is_secondary), 6) share,
  round(count_if(is_trick) * 100.0 / count(*), 6) trick_rate from questions where not is_secondary group by 1""", "questions"))
def type_profile(spark, sf):
    return rounded(st.type_profile(questions(spark, sf)), "share", "trick_rate")


@query("answer_diversity", sql("""
, a as (select qtype, unnest(answers) answer from questions where not is_secondary),
c as (select qtype, answer, count(*) n from a group by all),
s as (select qtype, count(*) q from questions where not is_secondary group by 1)
select c.qtype, count(*) unique_answers, sum(n) / max(q)::double answers_per_question,
  arg_min(answer, (-n, answer)) modal_answer, max(n) modal_count from c join s using (qtype) group by 1""", "questions"))
def answer_diversity(spark, sf):
    return st.answer_diversity(questions(spark, sf))


@query("question_coverage", sql("""
, p as (select clip, count(*) n, count_if(not is_secondary) p from questions group by 1)
select count(*) clips, min(n) min_all, max(n) max_all, avg(n) mean_all, min(p) min_primary, max(p) max_primary, avg(p) mean_primary from p""", "questions"))
def question_coverage(spark, sf):
    return st.question_coverage(questions(spark, sf))


@query("duplicate_questions", sql("""
, d as (select clip, qtype, prompt from questions where not is_secondary
  union all select clip, qtype, prompt from questions where not is_secondary and group_id = 'g_7')
select clip, qtype, prompt, count(*) n from d group by all having count(*) > 1 order by n desc, clip, qtype, prompt limit 20""", "questions"))
def duplicate_questions(spark, sf):
    bank = questions(spark, sf)
    return st.duplicate_questions(bank.unionByName(bank.filter("group_id = 'g_7'")))


@query("key_positions", sql("""
, c as (select correct_index, count(*) n from questions where not is_secondary group by 1)
select correct_index, n, round(n * 100.0 / sum(n) over (), 6) share, round(100.0 / count(*) over (), 6) chance from c""", "questions"))
def key_positions(spark, sf):
    return rounded(st.key_positions(questions(spark, sf)), "share", "chance")


_BIASSQL = """
, o as (select correct_index, unnest(range(len(answers))) pos, unnest(answers) o from questions where not is_secondary),
b as (select lower(trim(o)) property, count_if(pos = correct_index) as_correct, count_if(pos <> correct_index) as_distractor, count(*) total
  from o group by 1 having count(*) >= 10),
r as (select *, as_correct / total::double correct_rate from b)"""


@query("property_bias_whole_text", sql(_BIASSQL + " select * from r", "questions"))
def property_bias_whole_text(spark, sf):
    return st.property_bias(questions(spark, sf), whole_text=True)


@query("property_bias_extremes", sql(_BIASSQL + """
select *, 'top' side from (select * from r order by correct_rate desc, property limit 20)
union all select *, 'bottom' from (select * from r order by correct_rate, property desc limit 20)""", "questions"))
def property_bias_extremes(spark, sf):
    return st.extremes(st.property_bias(questions(spark, sf), whole_text=True))


@query("property_bias_by_slot")
def property_bias_by_slot(spark, sf):
    """Person and action properties; their look-ahead pattern has no SQL twin (see tests)."""
    return st.property_bias(questions(spark, sf))


@query("frequent_answers", sql("""
select lower(trim(correct_answer)) answer, count(*) n from questions where not is_secondary group by 1 order by n desc, answer limit 20""", "questions"))
def frequent_answers(spark, sf):
    return st.frequent_answers(questions(spark, sf))


@query("frequency_shortcut", sql("""
, o as (select clip, prompt, is_secondary, unnest(range(len(answers))) pos, lower(trim(unnest(answers))) t from questions),
f as (select t, count_if(not is_secondary) freq from o group by 1),
q as (select clip, prompt, list(freq order by pos) fs from o join f using (t) group by all),
a as (select model, fs[selected + 1] = list_max(fs) m, fs[selected + 1] = list_min(fs) l from results join q using (clip, prompt)
      where error is null and selected is not null)
select model, count(*) answered, count_if(m) chose_most_frequent, count_if(l) chose_least_frequent,
  round(count_if(m) * 100.0 / count(*), 6) most_pct, round(count_if(l) * 100.0 / count(*), 6) least_pct from a group by 1""", "results"))
def frequency_shortcut(spark, sf):
    return rounded(st.frequency_shortcut(results(spark, sf), questions(spark, sf), ["qtype"]), "most_pct", "least_pct")


_QUOTA_ROWS = ", ".join(f"('{q}', '{c}', {K.CATEGORY_QUOTA[c]})" for q, c in K.TYPE_CATEGORY.items())


@query("quota_check", sql(f"""
, g(qtype, category, quota) as (values {_QUOTA_ROWS}),
a as (select category, max(quota) quota, count(*) actual from questions join g using (qtype) group by 1),
e as (select category, actual, quota * (select count(*) from clips) expected from a)
select category, actual, expected, abs(actual - expected) / expected::double deviation, abs(actual - expected) / expected::double < 0.05 ok from e""", "questions"))
def quota_check(spark, sf):
    n_clips = clips(spark, sf).agg(F.count("*")).scalar()
    return st.quota_check(questions(spark, sf), n_clips)


@query("bank_rollup", sql(f"""
, g(qtype, category, quota) as (values {_QUOTA_ROWS}), j as (select category, qtype, clip from questions join g using (qtype))
select coalesce(category, 'ALL') category, coalesce(qtype, 'ALL') qtype, count(*) questions, (select count(distinct clip) from j) clips
from j group by grouping sets ((category, qtype), (category), ())""", "questions"))
def bank_rollup(spark, sf):
    return st.bank_rollup(questions(spark, sf))


# --- H ------------------------------------------------------------------------------------------

@query("evenly_spaced_events", """
with r as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 pos, count(*) over (partition by user_id) n from events),
w as (select distinct user_id, n, unnest(case when n <= 8 then range(n) else
  list_transform(range(8), lambda i: round_even(i * ((n - 1) / 7.0::double), 0)::bigint) end) pos from r)
select user_id, event_id, r.pos from r join w using (user_id, pos)""")
def evenly_spaced_events(spark, sf):
    """Eight evenly spaced events of every user, in time order."""
    e = table(spark, sf, "events").select("user_id", "event_id", "ts")
    placed = sorted_ordinal(e, ["ts", "event_id"], "pos", by=["user_id"])
    sizes = placed.groupBy("user_id").agg(F.count("*").alias("n"))
    wanted = sizes.select("user_id", F.explode(evenly_spaced(F.col("n"), 8)).alias("pos"))
    return placed.join(wanted.distinct(), ["user_id", "pos"], "left_semi").select("user_id", "event_id", "pos")


@query("first_clips_questions", sql("""
select clip, qtype from questions where clip in (select clip from clips order by clip limit 25)""", "questions"))
def first_clips_questions(spark, sf):
    """Questions of the first 25 clips by name: a report-sized cut the caller asks for."""
    head = clips(spark, sf).select("clip").orderBy("clip").limit(25)
    return questions(spark, sf).join(head, "clip", "left_semi").select("clip", "qtype")


@query("common_wrong_choice_per_type", sql("""
, c as (select qtype, answers[selected + 1] option, count(*) n from results where not is_correct and selected is not null group by all)
select qtype, option, n from (select *, row_number() over (partition by qtype order by n desc, option) rn from c) where rn <= 3""", "results"))
def common_wrong_choice_per_type(spark, sf):
    wrong = results(spark, sf, with_text=True).filter("not is_correct and selected is not null")
    counted = wrong.groupBy("qtype", F.get("answers", F.col("selected")).alias("option")).agg(F.count("*").alias("n"))
    return top_k(counted, 3, [F.desc("n"), F.col("option")], by=["qtype"])


@query("worst_confusions_first", sql("""
, p as (select model, answers[correct_index + 1] true_role, answers[selected + 1] pred_role from results
        where qtype = 'role_identification' and selected is not null)
select model, true_role, pred_role, count(*) n from p where true_role <> pred_role group by all order by n desc, model, true_role, pred_role limit 10""", "results"))
def worst_confusions_first(spark, sf):
    from ..operators.confusion import confusion, role_pairs
    pairs = role_pairs(results(spark, sf, with_text=True))
    off = confusion(pairs, "true_role", "pred_role").filter("true_role <> pred_role").drop("row_share")
    return off.orderBy(F.desc("n"), "model", "true_role", "pred_role").limit(10)
