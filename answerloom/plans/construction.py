"""Registered queries: expressions on annotations and options (B), question-bank construction (F8, F14, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import freetext as ft
from ..functions import matching as mt
from ..functions import people as ppl
from ..functions import render as rd
from ..functions.hashing import hash_int
from ..operators import bank as bk
from ..operators import prep
from ..operators import setops as so
from ..operators.sampling import sample_exact
from .preparation import _ORD, SPLIT_SQL, indexed, splits
from .registry import query
from .view_sql import sql
from .views import clips, person_arrays, questions, raw_annotations, results, spread_clips, table


def c(name):
    return F.col(name)


join_list = lambda col: F.array_join(col, " ## ")
_lst = lambda words: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"
_has = lambda expr, words: "(" + " or ".join(f"contains({expr}, '" + w.replace("'", "''") + "')" for w in words) + ")"
NONE = _lst(K.NONE_VALUES)


# --- B: annotations ----------------------------------------------------------------------------

_ITEMS = lambda x: f"(case when {x} is null then null when {x} like '[%' then json({x})::varchar[] when regexp_matches({x}, '^\\d+$') then null else [{x}] end)"
_KEPT = lambda x: f"list_transform(list_filter({_ITEMS(x)}, lambda v: v is null or lower(trim(v)) not in {NONE}), lambda v: case when v like 'Person%' then 'p' || substr(v, 2) else v end)"


@query("normalized_clips", sql(f"""
select file_name clip, case when lower(trim(action)) in {NONE} then null when lower(trim(action)) = 'talking aggressively' then 'aggressive talking'
   when lower(trim(action)) = 'grab clothing' then 'clothing grab' else action end as action,
  case when len({_KEPT('aggressor')}) > 0 then coalesce(array_to_string({_KEPT('aggressor')}, ' ## '), '') end aggressor,
  case when len({_KEPT('victim')}) > 0 then coalesce(array_to_string({_KEPT('victim')}, ' ## '), '') end victim,
  case when len({_KEPT('bystanders')}) > 0 then coalesce(array_to_string({_KEPT('bystanders')}, ' ## '), '') end bystander,
  case when lower(trim(environment)) in {NONE} then null else environment end environment from raw_annotations""", "raw"))
def normalized_clips(spark, sf):
    out = ppl.normalize_clips(raw_annotations(spark, sf))
    return out.withColumns({k: join_list(k) for k in ("aggressor", "victim", "bystander")})


@query("formatted_people", sql("""
, p as (select clip, list_filter([aggressor, victim] || coalesce(bystanders, []), lambda x: x is not null and trim(x) <> '') v from clips)
select clip, case when len(v) = 0 then null when len(v) = 1 then v[1] when len(v) = 2 then v[1] || ' and ' || v[2]
  else array_to_string(v[:-2], ', ') || ', and ' || v[-1] end people from p""", "clips"))
def formatted_people(spark, sf):
    people = F.concat(F.array("aggressor", "victim"), F.coalesce("bystanders", F.array().cast("array<string>")))
    return clips(spark, sf).select("clip", ppl.format_people(people).alias("people"))


_COUNTS = {
    "a": ("case when trim({x}) <> '' then 1 else 0 end", "0", "len(list_filter(l, lambda v: v is not null and v <> ''))"),
    "b": ("case when trim({x}) <> '' then 1 else 0 end", "0", "len(l)"),
    "c": ("case when lower(trim({x})) in ('none', 'n/a', 'unknown', '') then 0 else 1 end", "{x}::int",
          "len(list_filter(l, lambda v: v is not null and lower(trim(v)) not in ('none', 'n/a', 'unknown', '')))"),
    "d": ("case when lower(trim({x})) in ('none', 'n/a', '') then 0 else 1 end", "0", "len(list_filter(l, lambda v: v is not null and trim(v) <> ''))"),
}


@query("people_counts", sql(", l as (select *, case when aggressor like '[%' then json(aggressor)::varchar[] end l from raw_annotations) select file_name clip, " + ", ".join(
    f"(case when aggressor is null then 0 when aggressor like '[%' then {n} when regexp_matches(aggressor, '^\\d+$') then {i.format(x='aggressor')} else {t.format(x='aggressor')} end)::int count_{k}"
    for k, (t, i, n) in _COUNTS.items()) + " from l", "raw"))
def people_counts(spark, sf):
    return raw_annotations(spark, sf).select(
        c("file_name").alias("clip"), *[ppl.people_count(c("aggressor"), v).alias(f"count_{v}") for v in "abcd"])


@query("count_buckets", """
select o_orderkey, case when n >= 3 then '3+' else n::varchar end bucket, case when n >= 3 then '3 or more' else n::varchar end answer
from (select o_orderkey, count(l_orderkey) n from orders left join lineitem on o_orderkey = l_orderkey group by 1)""")
def count_buckets(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    joined = table(spark, sf, "orders").join(lines, c("o_orderkey") == c("l_orderkey"), "left")
    n = F.coalesce("n", F.lit(0))
    return joined.select("o_orderkey", ppl.count_bucket(n).alias("bucket"), ppl.count_answer(n).alias("answer"))


_SPEC = lambda x: f"coalesce(trim({x}) <> '' and lower(trim({x})) not in {_lst(K.GENERIC_TOKENS)} and not {_has(f'lower(trim({x}))', K.GENERIC_PHRASES)}, false)"


@query("specific_people", sql(f"""
select file_name clip, {_SPEC('victim')} victim_specific, coalesce(list_bool_or(list_transform({_ITEMS('bystanders')}, lambda v: {_SPEC('v')})), false) any_bystander,
  array_to_string(list_transform(list_filter({_ITEMS('bystanders')}, lambda v: {_SPEC('v')}), lambda v: trim(v)), ' ## ') bystanders from raw_annotations""", "raw"))
def specific_people(spark, sf):
    raw = raw_annotations(spark, sf)
    items = F.when(ppl.raw_kind(c("bystanders")) == "list", ppl.raw_list(c("bystanders"))).when(
        ppl.raw_kind(c("bystanders")) == "str", F.array("bystanders"))
    return raw.select(
        c("file_name").alias("clip"), ppl.is_specific(c("victim")).alias("victim_specific"),
        ppl.any_specific(items).alias("any_bystander"), join_list(ppl.specific_people(items)).alias("bystanders"))


@query("individual_bystanders", sql("""
, p as (select clip, list_filter(list_transform(bystanders || [' ' || upper(bystanders[1]), victim], lambda v: trim(v)), lambda v: v is not null and v <> '' and not contains(lower(v), 'group of')) v from clips where bystanders is not null)
select clip, array_to_string(list_filter(v, lambda x, i: list_position(list_transform(v, lambda y: lower(y)), lower(x)) = i), ' ## ') people from p""", "clips"))
def individual_bystanders(spark, sf):
    noisy = F.concat("bystanders", F.array(F.concat(F.lit(" "), F.upper(F.get("bystanders", F.lit(0)))), c("victim")))
    return clips(spark, sf).filter("bystanders is not null").select("clip", join_list(ppl.individual_people(noisy)).alias("people"))


@query("split_people", sql("""
select clip, array_to_string(list_filter(list_transform(regexp_split_to_array(aggressor || ', ' || victim || ' and  ' || array_to_string(bystanders, ', and '), '\\s+and\\s+|,\\s*'), lambda v: trim(v)), lambda v: v <> ''), ' ## ') people
from clips where bystanders is not null""", "clips"))
def split_people(spark, sf):
    text = F.concat(c("aggressor"), F.lit(", "), c("victim"), F.lit(" and  "), F.array_join("bystanders", ", and "))
    return clips(spark, sf).filter("bystanders is not null").select("clip", join_list(ppl.split_people(text)).alias("people"))


@query("normal_clips", sql("""
select file_name clip, contains(lower(file_name), 'normal') by_name,
  (action is null or lower(trim(action)) in ('', 'none', 'n/a', 'na', 'unknown')) and (aggressor is null or lower(trim(aggressor)) in ('', 'none', 'n/a', 'na', 'unknown'))
  and (victim is null or lower(trim(victim)) in ('', 'none', 'n/a', 'na', 'unknown')) by_slots,
  environment is null or lower(trim(environment)) in ('', 'none', 'n/a') no_environment from raw_annotations""", "raw"))
def normal_clips(spark, sf):
    return raw_annotations(spark, sf).select(
        c("file_name").alias("clip"), ppl.normal_by_name(c("file_name")).alias("by_name"),
        ppl.normal_by_slots(c("action"), c("aggressor"), c("victim")).alias("by_slots"),
        ppl.is_missing(c("environment")).alias("no_environment"))


@query("available_clips", sql("""
select file_name clip, 'clip_' || l_orderkey || '.mp4' is not null available from raw_annotations left join
  (select distinct l_orderkey from lineitem where l_linenumber = 1) m on file_name = 'clip_' || l_orderkey || '.mp4'""", "raw"))
def available_clips(spark, sf):
    """First line items stand for media files; what is skipped is counted by the flag."""
    media = table(spark, sf, "lineitem").filter("l_linenumber = 1").select(
        F.concat(F.lit("clip_"), c("l_orderkey").cast("string"), F.lit(".mp4")).alias("file_name")).distinct()
    raw = raw_annotations(spark, sf).select("file_name")
    kept = so.kept_by(raw, media, ["file_name"]).withColumn("available", F.lit(True))
    return kept.unionByName(so.remaining(raw, media, ["file_name"]).withColumn("available", F.lit(False))).withColumnRenamed("file_name", "clip")


@query("without_excluded_clips", sql(f"select file_name clip from raw_annotations where file_name not in {_lst(K.EXCLUDED_CLIPS)} and file_name not in ('clip_10.mp4', 'clip_11.mp4')", "raw"))
def without_excluded_clips(spark, sf):
    return raw_annotations(spark, sf).filter(~c("file_name").isin(*K.EXCLUDED_CLIPS, "clip_10.mp4", "clip_11.mp4")).select(
        c("file_name").alias("clip"))


# --- B: tokens and matches ------------------------------------------------------------------------

_TOK = lambda e: f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({e}, '')), '[a-z0-9'']+'), lambda w: w not in {_lst(K.STOP_WORDS)}))"
_M = lambda a, b, t=0.5: f"(len({a}) > 0 and len({b}) > 0 and len(list_intersect({a}, {b})) >= {t} * len(list_distinct(list_concat({a}, {b}))))"


@query("document_tokens", f"select doc_id, len({_TOK('text')}) tokens, array_to_string(list_sort({_TOK('text')}), ' ') words from documents")
def document_tokens(spark, sf):
    t = mt.tokens(c("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(t).cast("bigint").alias("tokens"), F.array_join(F.array_sort(t), " ").alias("words"))


@query("option_slot_matches", sql(f"""
, o as (select q.clip, qtype, unnest(range(n_options)) pos, unnest(answers) o, aggressor, bystanders from questions q join clips using (clip) where qtype in ('aggressor_identification', 'victim_recognition')),
t as (select *, {_TOK('o')} ot, {_TOK('aggressor')} att, list_transform(coalesce(bystanders, []), lambda b: {_TOK('b')}) bt from o)
select clip, qtype, pos, {_M('ot', 'att')} is_aggressor, coalesce(list_bool_or(list_transform(bt, lambda x: {_M('ot', 'x')})), false) is_bystander from t""", "questions"))
def option_slot_matches(spark, sf):
    q = questions(spark, sf).filter(c("qtype").isin("aggressor_identification", "victim_recognition"))
    people = clips(spark, sf).select("clip", "aggressor", "bystanders")
    # people are cut into tokens once a clip, an option once for all of them
    cut = people.select("clip", mt.tokens(c("aggressor")).alias("aggressor"), F.transform("bystanders", lambda b: mt.tokens(b)).alias("bystanders"))
    o = mt.each_option(q.join(cut, "clip"), "clip", "qtype", "aggressor", "bystanders", option="o")
    o = o.select("clip", "qtype", "pos", "aggressor", "bystanders", mt.tokens(c("o")).alias("o"))
    return o.select("clip", "qtype", "pos", mt.slot_match(c("o"), c("aggressor"), cut=True).alias("is_aggressor"),
                    mt.any_match(c("o"), c("bystanders"), cut=True).alias("is_bystander"))


_SIM = lambda a, b: (f"(lower(trim({a})) = lower(trim({b})) or ({_has(f'lower(trim({a}))', K.NONE_KEYWORDS)} and {_has(f'lower(trim({b}))', K.NONE_KEYWORDS)})"
                     f" or (length(trim({a})) > 10 and length(trim({b})) > 10 and (contains(lower(trim({a})), lower(trim({b}))) or contains(lower(trim({b})), lower(trim({a}))))))")


@query("none_claims_and_similar", sql(f"""
, o as (select clip, qtype, unnest(range(n_options)) pos, unnest(answers) o, correct_answer k from questions)
select clip, qtype, pos, {_has('lower(o)', K.NONE_MARKERS)} none_claim, {_SIM('o', 'k')} similar_to_key from o""", "questions"))
def none_claims_and_similar(spark, sf):
    o = mt.each_option(questions(spark, sf), "clip", "qtype", "correct_answer", option="o")
    return o.select("clip", "qtype", "pos", mt.none_claim(c("o")).alias("none_claim"),
                    mt.similar_answers(c("o"), c("correct_answer")).alias("similar_to_key"))


def _slot_sql(text, slot):
    arms = []
    for t, (p, groups) in K.SLOT_PATTERNS.items():
        if slot in groups:
            g = groups.index(slot) + 1
            p = p.replace("'", "''")
            value = f"nullif(trim(regexp_extract(trim({text}), '{p}', {g})), '')"
            if t == "compound_aggressor_location":
                u = f"regexp_matches(trim({text}), '{K.LOCATION_UNCLEAR_PATTERN}')"
                alt = "'unclear'" if slot == "loc" else f"nullif(trim(regexp_extract(trim({text}), '{K.LOCATION_UNCLEAR_PATTERN}', 1)), '')"
                value = f"case when {u} then {alt} else {value} end"
            arms.append(f"when '{t}' then {value}")
    return f"case qtype {' '.join(arms)} end"


@query("parsed_slots", sql(f"""
, o as (select clip, qtype, unnest(range(n_options)) pos, unnest(answers) o from questions)
select clip, qtype, pos, {_slot_sql('o', 'agg')} agg, {_slot_sql('o', 'act')} act, {_slot_sql('o', 'vic')} vic, {_slot_sql('o', 'loc')} loc from o""", "questions"))
def parsed_slots(spark, sf):
    o = mt.each_option(questions(spark, sf), "clip", "qtype", option="o")
    return o.select("clip", "qtype", "pos", *[v.alias(k) for k, v in mt.parse_slots(c("qtype"), c("o")).items()])


_LABEL_SQL = f"""
, o as (select q.clip, qtype, unnest(range(n_options)) pos, unnest(answers) o, correct_answer k, correct_index, aggressor, victim, action, bystanders, environment
        from questions q join clips using (clip)),
g as (select *, {_slot_sql('o', 'agg')} ga, {_slot_sql('o', 'act')} gx, {_slot_sql('o', 'vic')} gv,
   coalesce({_slot_sql('k', 'agg')}, aggressor) ra, coalesce({_slot_sql('k', 'vic')}, victim) rv, coalesce({_slot_sql('k', 'act')}, action) rx from o),
t as (select *, {_TOK('o')} ot, {_TOK('aggressor')} att, {_TOK('victim')} vt, {_TOK('ga')} gat, {_TOK('gv')} gvt, {_TOK('ra')} rat, {_TOK('rv')} rvt,
   {_TOK('gx')} gxt, {_TOK('rx')} rxt, list_transform(coalesce(bystanders, []), lambda b: {_TOK('b')}) bt from g),
m as (select *, {_M('ot', 'att')} oa, {_M('ot', 'vt')} ov, coalesce(list_bool_or(list_transform(bt, lambda x: {_M('ot', 'x')})), false) ob,
   {_M('gat', 'rat')} aa, {_M('gat', 'rvt')} av, {_M('gvt', 'rat')} va, {_M('gvt', 'rvt')} vv,
   coalesce(list_bool_or(list_transform(bt, lambda x: {_M('gat', 'x')})), false) ab, coalesce(list_bool_or(list_transform(bt, lambda x: {_M('gvt', 'x')})), false) vb,
   gx is not null and coalesce(rx, '') <> '' and not {_M('gxt', 'rxt')} wx from t),
lab as (select clip, qtype, pos, case when pos = correct_index or o = k then 'correct' when {_has('lower(o)', K.NONE_MARKERS)} then 'none_claim'
   when qtype = 'role_identification' then case when lower(o) in ('victim', 'aggressor') and lower(k) in ('victim', 'aggressor') then 'role_reversal'
      when lower(o) = 'bystander' then 'bystander_substitution' else 'other_in_cast' end
   when qtype = 'primary_action' then 'wrong_category'
   when qtype = 'aggressor_identification' then case when ov then 'role_reversal' when ob then 'bystander_substitution' when oa then 'other_in_cast' else 'cross_video' end
   when qtype = 'victim_recognition' then case when oa then 'role_reversal' when ob then 'bystander_substitution' when ov then 'other_in_cast' else 'cross_video' end
   when av and va then 'role_reversal' when aa and vv then case when wx then 'wrong_action' else 'other_in_cast' end
   when aa then case when vb then 'bystander_substitution' else 'wrong_victim' end when vv then case when ab then 'bystander_substitution' else 'wrong_aggressor' end
   when ab or vb then 'bystander_substitution' when av or va then 'other_in_cast' else 'cross_video' end label from m)
"""


@query("labelled_bank", sql(_LABEL_SQL + "select * from lab", "questions"))
def labelled_bank(spark, sf):
    return prep.label_bank(questions(spark, sf), clips(spark, sf)).select("clip", "qtype", "pos", "label")


@query("preference_pairs_unlabelled", sql(_LABEL_SQL.rstrip() + SPLIT_SQL + f"""
, e as (select q.clip, q.qtype, q.correct_index, q.correct_answer, unnest(range(n_options)) pos, unnest(answers) txt
        from questions q join split s using (clip) where not is_secondary and not is_trick and s.split = 'train'),
k as (select e.*, label, row_number() over (partition by clip, qtype order by {_ORD['fixed']}, pos) r
      from e join lab using (clip, qtype, pos) where label <> 'correct')
select clip, qtype, correct_index, string_agg(chr((65 + pos)::int) || ') ' || txt || ' [' || label || ']', ' ## ' order by r) rejected
from k where r <= 3 group by all""", "questions"))
def preference_pairs_unlabelled(spark, sf):
    """J6 on a bank that carries no labels."""
    train = splits(spark, sf).filter("split = 'train'")
    pairs = prep.preference_pairs(indexed(questions(spark, sf)).drop("option_hardness"), clips(spark, sf), train, n=3)
    shown = F.array_join(F.transform("rejected", lambda r: F.concat(r["answer"], F.lit(" ["), r["hardness"], F.lit("]"))), " ## ")
    return pairs.select("clip", "qtype", "correct_index", shown.alias("rejected"))


@query("preference_pairs_half_labelled", sql(_LABEL_SQL.rstrip() + SPLIT_SQL + f"""
, e as (select q.clip, q.qtype, q.correct_index, q.correct_answer, unnest(range(n_options)) pos, unnest(answers) txt,
     unnest(case when ('0x' || substr(md5('42|half|' || q.clip || '|' || q.qtype), 1, 8))::bigint % 3 = 0 then option_hardness else list_transform(answers, lambda a: null::varchar) end) own
     from questions q join split s using (clip) where not is_secondary and not is_trick and s.split = 'train'),
l as (select e.*, coalesce(own, label) as label from e join lab using (clip, qtype, pos)),
k as (select *, row_number() over (partition by clip, qtype order by {_ORD['fixed']}, pos) r from l where label <> 'correct')
select clip, qtype, correct_index, string_agg(chr((65 + pos)::int) || ') ' || txt || ' [' || label || ']', ' ## ' order by r) rejected
from k where r <= 3 group by all""", "questions"))
def preference_pairs_half_labelled(spark, sf):
    """J6 on a bank in which a third of the questions has labels, a third a null and a third an empty array."""
    train = splits(spark, sf).filter("split = 'train'")
    turn = hash_int(42, "half", c("clip"), c("qtype")) % 3
    bank = indexed(questions(spark, sf)).withColumn("option_hardness", F.when(turn == 0, c("option_hardness")).when(
        turn == 1, F.array().cast("array<string>")))
    pairs = prep.preference_pairs(bank, clips(spark, sf), train, n=3)
    shown = F.array_join(F.transform("rejected", lambda r: F.concat(r["answer"], F.lit(" ["), r["hardness"], F.lit("]"))), " ## ")
    return pairs.select("clip", "qtype", "correct_index", shown.alias("rejected"))


@query("answer_prefixes", sql("""
, o as (select clip, qtype, unnest(range(n_options)) pos, unnest(answers) o from questions)
select clip, qtype, pos, case when contains(o, '; ') then trim(split_part(o, '; ', 1)) when regexp_matches(o, '(?s)^.+ in ') then trim(regexp_extract(o, '(?s)^(.+) in ', 1)) end prefix from o""", "questions"))
def answer_prefixes(spark, sf):
    o = mt.each_option(questions(spark, sf), "clip", "qtype", option="o")
    return o.select("clip", "qtype", "pos", mt.answer_prefix(c("o")).alias("prefix"))


@query("document_prefixes", """
select doc_id, case when contains(text, '; ') then trim(split_part(text, '; ', 1)) when regexp_matches(text, '(?s)^.+ in ') then trim(regexp_extract(text, '(?s)^(.+) in ', 1)) end prefix from documents""")
def document_prefixes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", mt.answer_prefix(c("text")).alias("prefix"))


_PHRASES = tuple(f"Brand#{i}" for i in range(1, 26)) + ("tin cup", "red coat")


@query("option_phrases", sql("""
, ph as (select list(p order by -length(p), p) ps from (select unnest([""" + ", ".join(f"'{p}'" for p in _PHRASES) + """]) p)),
o as (select clip, qtype, unnest(range(n_options)) pos, unnest(answers) o from questions where qtype in ('compound_action_victims', 'compound_aggressor_action_victim')),
h as (select o.*, list_filter(ps, lambda p: contains(lower(o), lower(p))) hits from o, ph)
select clip, qtype, pos, hits[1] first_hit, array_to_string(hits, ' ## ') hits,
  case when hits[1] is null then o else substr(o, 1, strpos(lower(o), lower(hits[1])) - 1) || 'fresh act' || substr(o, strpos(lower(o), lower(hits[1])) + length(hits[1])) end rewritten from h""", "questions"))
def option_phrases(spark, sf):
    q = questions(spark, sf).filter(c("qtype").isin("compound_action_victims", "compound_aggressor_action_victim"))
    # the sorted phrases are made once a question and the hits once an option
    o = mt.each_option(q.withColumn("_phrases", mt.longest_first(ppl.literals(_PHRASES))), "clip", "qtype", "_phrases", option="o")
    o = o.withColumn("_hits", mt.phrase_hits(c("o"), c("_phrases"))).withColumn("first_hit", F.get("_hits", F.lit(0)))
    rewritten = F.coalesce(mt.rewrite_first(c("o"), c("first_hit"), F.lit("fresh act")), c("o"))
    return o.select("clip", "qtype", "pos", "first_hit", join_list("_hits").alias("hits"), rewritten.alias("rewritten"))


@query("cleaned_roles", sql("""
, o as (select clip, pos, chr((65 + pos)::int) || ') ' || r raw from (select clip, unnest(range(n_options)) pos, unnest(answers) r from questions where qtype = 'role_identification'))
select clip, pos, substr(raw, 4) exact, substr(raw, 4) loose from o""", "questions"))
def cleaned_roles(spark, sf):
    q = questions(spark, sf).filter("qtype = 'role_identification'")
    o = mt.each_option(q, "clip", option="r")
    raw = F.concat(rd.letter(c("pos")), F.lit(") "), c("r"))
    return o.select("clip", "pos", mt.exact_role(raw).alias("exact"), mt.loose_role(raw).alias("loose"))


# --- B: rendering and free text ----------------------------------------------------------------------

_STYLE = "{h} % 3 style, ({h} // 3) % 2 coin".format(h="('0x' || substr(md5('42|style|' || clip || '|' || qtype), 1, 8))::bigint")
_ALL = ", ".join(f"('{t}')" for t in K.QUESTION_TYPES)


def _render_sql(a="agg", v="vic", b="bys", x="act", e="env", style="style", coin="coin"):
    triple = lambda A, X, V: f"case {style} when 0 then {A} || ' performed ' || {X} || ' on ' || {V} when 1 then {A} || ' committed ' || {X} || ' against ' || {V} else 'The action of ' || {X} || ' was carried out by ' || {A} || ' on ' || {V} end"
    return f"""case qtype when 'primary_action' then coalesce({x}, 'unknown action')
 when 'aggressor_identification' then coalesce({a}, 'No one displays aggressive behavior') when 'perspective_aggressor' then coalesce({a}, 'No one displays aggressive behavior')
 when 'victim_recognition' then coalesce({v}, 'No one appears to be victimized') when 'bystander_detection' then coalesce({b}, 'No bystanders are present')
 when 'scene_location' then coalesce({e}, 'Location unclear / not shown')
 when 'interaction_summary' then case when {a} is null and {v} is null then 'No action takes place' else coalesce({a}, 'Unknown person') || ' performs action of ' || coalesce({x}, 'unknown action') || ' on ' || coalesce({v}, 'unknown target') end
 when 'social_appropriateness' then coalesce('The action performed by ' || {a}, 'No actions performed are socially inappropriate')
 when 'compound_aggressor_location' then coalesce({a} || ' in ' || {e}, {a} || '; location unclear', 'No aggressor present; location is ' || {e}, 'No aggressor present and location unclear')
 when 'compound_action_victims' then coalesce({x}, 'No action') || '; Victim: ' || coalesce({v}, 'No one appears to be victimized')
 when 'compound_action_aggressor' then coalesce({x}, 'No action') || '; Aggressor: ' || coalesce({a}, 'No aggressor present')
 when 'compound_action_location' then coalesce({x} || ' in ' || {e}, {x} || ' in unclear location', 'No action in ' || {e}, 'No action and location unclear')
 when 'compound_aggressor_victim' then case when {a} is not null and {v} is not null then case {style} when 0 then 'Aggressor: ' || {a} || '; Victim: ' || {v} when 1 then {a} || ' is the aggressor and ' || {v} || ' is the victim' else {a} || ' attacked ' || {v} end
    when {a} is not null then case {coin} when 0 then 'Aggressor: ' || {a} || '; No victim' else {a} || ' is the aggressor; no victim identified' end
    when {v} is not null then case {coin} when 0 then 'No aggressor; Victim: ' || {v} else 'No aggressor identified; ' || {v} || ' is the victim' end
    else case {coin} when 0 then 'No aggressor described and no victim described' else 'Neither an aggressor nor a victim can be identified' end end
 when 'compound_bystander_location' then coalesce({b} || ' in ' || {e}, {b} || ' in unclear location', 'No bystanders in ' || {e}, 'No bystanders and location unclear')
 when 'compound_aggressor_action_victim' then case when {a} is null and {x} is null and {v} is null then case {coin} when 0 then 'No one did anything to anyone' else 'No aggressive interaction occurred' end
    else {triple(f"coalesce({a}, 'Unknown person')", f"coalesce({x}, 'unknown action')", f"coalesce({v}, 'unknown target')")} end
 when 'sequence_verification' then case {style} when 0 then {a} || ', who is the aggressor, performed the action of ' || {x} || ' against ' || {v} || ' who is the victim'
    when 1 then 'The aggressor, ' || {a} || ', carried out ' || {x} || ' against the victim, ' || {v} else {a} || ' (aggressor) did ' || {x} || ' to ' || {v} || ' (victim)' end
 when 'role_count_aggressor' then na::varchar when 'role_count_victim' then nv::varchar when 'role_count_bystander' then case when nb >= 3 then '3 or more' else nb::varchar end
 when 'compound_aggressor_victim_count' then na || ' aggressor' || (case when na = 1 then '' else 's' end) || ' and ' || nv || ' victim' || (case when nv = 1 then '' else 's' end)
 when 'compound_victim_bystander_count' then nv || ' victim' || (case when nv = 1 then '' else 's' end) || ' and ' || nb || ' bystander' || (case when nb = 1 then '' else 's' end) end"""


_SLOTS = """
, sl as (select *, aggressor agg, victim vic, array_to_string(bystanders, ' and ') bys, action act, environment env,
   (aggressor is not null)::int na, (victim is not null)::int nv, coalesce(len(bystanders), 0)::int nb from clips)"""
_RENDERED = _SLOTS + f"""
, ty(qtype) as (values {_ALL}),
sq as (select *, {_STYLE} from sl, ty),
rendered as (select clip, qtype, {_render_sql()} correct_answer from sq)"""


def all_type_rows(spark, sf):
    types = F.array(*[F.lit(t) for t in K.QUESTION_TYPES])
    return clips(spark, sf).select("clip", F.explode(types).alias("qtype"))


@query("rendered_answers", sql(_RENDERED + " select * from rendered where correct_answer is not null", "clips"))
def rendered_answers(spark, sf):
    out = bk.correct_answers(all_type_rows(spark, sf), person_arrays(clips(spark, sf)))
    return out.filter("correct_answer is not null")


_OPTS = lambda f: f"array_to_string(list_transform(range(n_options), lambda i: {f}), chr(10))"
_LET = "chr((65 + i)::int) || ') ' || answers[i + 1]"


@query("prompt_texts", sql(f"""
select clip, qtype,
 'Watch this video carefully and answer the following multiple-choice question.' || chr(10) || 'Select ONLY the number (1, 2, 3, etc.) of the correct answer.' || chr(10) || chr(10)
   || 'Question: ' || prompt || chr(10) || chr(10) || 'Options:' || chr(10) || {_OPTS("(i + 1) || '. ' || answers[i + 1]")} || chr(10) || chr(10) || 'Answer with ONLY the option number (e.g., ''1'' or ''2'').' numbered,
 'Question: ' || prompt || chr(10) || 'Options:' || chr(10) || {_OPTS(_LET)} || chr(10) || chr(10) || 'Answer with the option letter (A, B, C, ...) followed by the option text.' lettered,
 prompt || chr(10) || chr(10) || 'Options:' || chr(10) || {_OPTS("'  ' || " + _LET)} || chr(10) || chr(10) || 'Answer with ONLY the letter (A, B, C, or D).' short from questions""", "questions"))
def prompt_texts(spark, sf):
    return questions(spark, sf).select(
        "clip", "qtype", rd.numbered_prompt(c("prompt"), c("answers")).alias("numbered"),
        rd.lettered_prompt(c("prompt"), c("answers")).alias("lettered"), rd.short_prompt(c("prompt"), c("answers")).alias("short"))


@query("one_shot_prompts", sql(f"""
, two as (select a.clip, a.qtype, a.prompt, a.answers, a.n_options, b.prompt rp, b.answers ra, b.correct_index ri, b.n_options rn
  from questions a left join questions b on a.clip = b.clip and b.qtype = 'primary_action' and not b.is_trick where a.qtype = 'sequence_verification')
select clip, 'Frame 1: <image>' || chr(10) || 'Frame 2: <image>' || chr(10) || chr(10) || coalesce('Reference Example:' || chr(10) || 'Question: ' || rp || chr(10)
  || array_to_string(list_transform(range(rn), lambda i: chr((65 + i)::int) || ') ' || ra[i + 1]), chr(10)) || chr(10) || 'Correct Answer: ' || chr((65 + ri)::int) || chr(10) || chr(10), '')
  || 'Question: ' || prompt || chr(10) || {_OPTS(_LET)} text from two""", "questions"))
def one_shot_prompts(spark, sf):
    q = questions(spark, sf)
    ref = q.filter("qtype = 'primary_action' and not is_trick").select(
        "clip", c("prompt").alias("rp"), c("answers").alias("ra"), c("correct_index").alias("ri"))
    joined = q.filter("qtype = 'sequence_verification'").join(ref, "clip", "left")
    return joined.select("clip", rd.one_shot_prompt(c("prompt"), c("answers"), 2, c("rp"), c("ra"), c("ri")).alias("text"))


@query("judge_prompts", sql("""
select clip, 'Response: ' || response || chr(10) || 'Action: ' || coalesce(action, 'None (non-aggressive clip)') || chr(10) || 'Place: ' || coalesce(environment, 'Not annotated') text
from results join clips using (clip) where response is not null and model = 'atlas-8b'""", "results"))
def judge_prompts(spark, sf):
    rows = results(spark, sf).filter("response is not null and model = 'atlas-8b'").join(clips(spark, sf), "clip")
    return rows.select("clip", rd.fill("Response: {response}\nAction: {action}\nPlace: {environment}", {
        "response": c("response"), "action": F.coalesce("action", F.lit("None (non-aggressive clip)")),
        "environment": F.coalesce("environment", F.lit("Not annotated"))}).alias("text"))


@query("event_properties", """
select event_id, case when regexp_matches(props, '\\{[^{}]*\\}') then (props->>'k')::int end k from events""")
def event_properties(spark, sf):
    wrapped = F.concat(F.lit("Sure, here it is: "), c("props"), F.lit(" - done"))
    return table(spark, sf, "events").select("event_id", ft.json_object(wrapped, "k int")["k"].alias("k"))


@query("refusals", f"""
with r as (select conv_id, turn, case when conv_id % 5 = 0 then 'Sorry, I cannot assist with this. ' else '' end || text || ' I am unable to say more' t from conversations)
select conv_id, turn, {_has('lower(left(t, 200))', K.REFUSAL_PHRASES)} refused from r""")
def refusals(spark, sf):
    head = F.when(c("conv_id") % 5 == 0, "Sorry, I cannot assist with this. ").otherwise("")
    text = F.concat(head, c("text"), F.lit(" I am unable to say more"))
    return table(spark, sf, "conversations").select("conv_id", "turn", ft.is_refusal(text).alias("refused"))


@query("thinking_split", """
with r as (select conv_id, turn, case when turn % 2 = 0 then left(text, 20) || '<think>' || text || '</think> then <think>x</think> ' || right(text, 20) else text end t from conversations)
select conv_id, turn, nullif(regexp_extract(t, '(?s)<think>.*?</think>', 0), '') thinking,
  case when regexp_matches(t, '(?s)<think>.*?</think>') then trim(regexp_replace(t, '(?s)<think>.*?</think>', '')) else t end answer from r""")
def thinking_split(spark, sf):
    text = F.when(c("turn") % 2 == 0, F.concat(
        F.left("text", F.lit(20)), F.lit("<think>"), c("text"), F.lit("</think> then <think>x</think> "), F.right("text", F.lit(20)))).otherwise(c("text"))
    block, rest = ft.split_thinking(text)
    return table(spark, sf, "conversations").select("conv_id", "turn", block.alias("thinking"), rest.alias("answer"))



def _valid_sql():
    arms = []
    for t, fields in K.REQUIRED_FIELDS.items():
        arms.append(f"when '{t}' then " + (" and ".join("(env is null or trim(env) <> '')" if f == "environment" else "(act is null or trim(act) <> '')" if f == "action" else "true" for f in fields) or "true"))
    arms.append("when 'role_identification' then coalesce(agg is not null or vic is not null or not contains(bystanders[1], 'group of'), false)")
    arms.append("when 'sequence_verification' then agg is not null and act is not null and vic is not null")
    return "case qtype " + " ".join(arms) + " end"


_VALID = _SLOTS + f", ty(qtype) as (values {_ALL}), valid as (select clip, qtype from sl, ty where {_valid_sql()})"


@query("valid_types", sql(_VALID + " select * from valid", "clips"))
def valid_types(spark, sf):
    return bk.valid_types(person_arrays(clips(spark, sf)))


@query("required_fields", sql("""
select file_name clip, (environment is null or trim(environment) <> '') has_environment, (victim is null or trim(victim) <> '') has_victim from raw_annotations""", "raw"))
def required_fields(spark, sf):
    raw = raw_annotations(spark, sf)
    values = {"environment": c("environment"), "victim": F.when(c("victim").isNotNull(), F.array("victim"))}
    kinds = {f: F.lit("present") for f in values}
    return raw.select(c("file_name").alias("clip"), ppl.has_fields(kinds, values, ["environment"]).alias("has_environment"),
                      ppl.has_fields(kinds, values, ["victim"]).alias("has_victim"))


# --- G: pools, types, recipes -----------------------------------------------------------------------------

_POOLS = _SLOTS + """
, v as (
  select 'people' pool, trim(agg) as value from sl union select 'people', trim(vic) from sl union select 'people', trim(unnest(bystanders)) from sl
  union select 'environments', env from sl union select 'actions', act from sl where lower(act) <> 'none'
  union select 'action_statements', unnest([agg || ' performs action of ' || act || ' on ' || vic, vic || ' performs action of ' || act || ' on ' || agg,
     bys || ' performs action of ' || act || ' on ' || vic, vic || ' performs action of ' || act || ' on ' || bys]) from sl
  union select 'action_by_role', unnest(['The action performed by ' || agg, 'The action performed by ' || vic, 'The action performed by ' || bys]) from sl
  union select 'compound_aggressor_location', coalesce(agg || ' in ' || env, agg || '; location unclear', 'No aggressor present; location is ' || env) from sl
  union select 'compound_action_victims', act || '; Victim: ' || coalesce(vic, 'No one appears to be victimized') from sl
  union select 'compound_action_aggressor', act || '; Aggressor: ' || coalesce(agg, 'No aggressor present') from sl
  union select 'compound_action_location', coalesce(act || ' in ' || env, act || ' in unclear location', 'No action in ' || env) from sl
  union select 'compound_aggressor_victim', coalesce('Aggressor: ' || agg || '; Victim: ' || vic, 'Aggressor: ' || agg || '; No victim', 'No aggressor; Victim: ' || vic) from sl
  union select 'compound_bystander_location', coalesce(bys || ' in ' || env, bys || ' in unclear location', 'No bystanders in ' || env) from sl
  union select 'compound_aggressor_action_victim', agg || ' performed ' || act || ' on ' || coalesce(vic, 'unknown target') from sl
  union select 'compound_aggressor_victim_count', na || ' aggressor' || (case when na = 1 then '' else 's' end) || ' and ' || nv || ' victim' || (case when nv = 1 then '' else 's' end) from sl
  union select 'compound_victim_bystander_count', nv || ' victim' || (case when nv = 1 then '' else 's' end) || ' and ' || nb || ' bystander' || (case when nb = 1 then '' else 's' end) from sl
  union select 'compound_aggressor_victim_count', a || ' aggressor' || (case when a = 1 then '' else 's' end) || ' and ' || b || ' victim' || (case when b = 1 then '' else 's' end) from range(4) x(a), range(4) y(b)
  union select 'compound_victim_bystander_count', a || ' victim' || (case when a = 1 then '' else 's' end) || ' and ' || b || ' bystander' || (case when b = 1 then '' else 's' end) from range(4) x(a), range(4) y(b))"""


@query("answer_pools", sql(_POOLS + " select pool, value from v where value is not null and value <> ''", "clips"))
def answer_pools(spark, sf):
    return bk.answer_pools(person_arrays(clips(spark, sf)))


@query("action_weights", sql("""
, f as (select trim(action) as action, count(*) freq from clips where action is not null group by 1)
select action, freq, max(freq) over () / freq::double weight from f""", "clips"))
def action_weights(spark, sf):
    return bk.action_weights(clips(spark, sf))


_CATROWS = ", ".join(
    f"('{t}', '{cat}', {K.CATEGORY_QUOTA[cat]}, {sorted(x for x, y in K.TYPE_CATEGORY.items() if y == cat).index(t)}, {sum(y == cat for y in K.TYPE_CATEGORY.values())})"
    for t, cat in K.TYPE_CATEGORY.items())
_ASSIGN = _VALID + f"""
, cat(qtype, category, quota, place, size) as (values {_CATROWS}),
no as (select clip, row_number() over (order by md5('42|rotate|' || clip), clip) - 1 no from clips),
tu as (select v.clip, category, qtype, quota, (((place - no * quota) % size) + size) % size turn from valid v join cat using (qtype) join no using (clip)
       where qtype <> 'compound_aggressor_victim' or no % 2 = 0),
assigned as (select clip, category, qtype from (select *, row_number() over (partition by clip, category order by turn) rn from tu) where rn <= quota)"""


@query("assigned_types", sql(_ASSIGN + " select * from assigned", "clips"))
def assigned_types(spark, sf):
    return bk.assign_types(person_arrays(spread_clips(spark, sf)))


def assigned(spark, sf):
    from .views import stored
    return stored(spark, sf, "assigned", lambda s, d: bk.assign_types(person_arrays(spread_clips(s, d))), by_clip=False)


@query("category_coverage", sql(_ASSIGN + " select category, qtype, count(*) n from assigned group by all", "clips"))
def category_coverage(spark, sf):
    return assigned(spark, sf).groupBy("category", "qtype").agg(F.count("*").alias("n"))


_REC = ", ".join(f"('{q}', '{l}', {n})" for q, r in K.DEFAULT_RECIPES.items() for l, n in r.items())
_DEMAND = _ASSIGN + ", d as (select qtype, count(*) questions from assigned group by 1)"


def demand(spark, sf, recipes):
    """Distractors a recipe table asks for over the assigned questions."""
    asked = assigned(spark, sf).groupBy("qtype").agg(F.count("*").alias("questions"))
    return bk.recipe_slots(recipes).join(asked, "qtype").groupBy("qtype", "label", "mode").agg(
        F.sum("questions").alias("slots"))


def _profile_queries():
    base = f", rec(qtype, label, n) as (values {_REC})"
    hard = """case when label <> 'cross_video' then label when bool_or(label = 'role_reversal') over w then 'role_reversal'
      when bool_or(label = 'wrong_action') over w then 'wrong_action' when bool_or(label = 'wrong_category') over w then 'wrong_category' else 'cross_video' end"""
    tables = {
        "balanced": "select qtype, label, n, 'standard' as mode from rec",
        "easy": "select qtype, 'cross_video' label, sum(n) n, 'standard' as mode from rec group by 1",
        "hard": f"select qtype, l label, sum(n) n, 'standard' as mode from (select *, {hard} l from rec window w as (partition by qtype)) group by all",
    }
    tables["frequency_inverted"] = tables["hard"].replace("group by all", f"where qtype not in {_lst(K.INVERTED_TYPES)} group by all") + f"""
      union all select qtype, unnest(['role_reversal', 'frequency_saturation']), unnest([1, sum(n) - 1]), 'frequency_inverted' from rec where qtype in {_lst(K.INVERTED_TYPES)} group by 1"""
    for profile, body in tables.items():
        @query(f"recipe_demand_{profile}", sql(_DEMAND + base + f", p as ({body}) select qtype, label, mode, (n * questions)::bigint slots from p join d using (qtype)", "clips"))
        def run(spark, sf, profile=profile):
            return demand(spark, sf, bk.apply_profile(bk.recipe_table(spark), profile))


_profile_queries()


@query("recipe_demand_overlay", sql(_DEMAND + f""", rec(qtype, label, n) as (values {_REC}),
p as (select * from rec where qtype <> 'primary_action' union all select 'primary_action', unnest(['wrong_action', 'cross_video']), unnest([5, 2]))
select qtype, label, 'standard' as mode, (n * questions)::bigint slots from p join d using (qtype)""", "clips"))
def recipe_demand_overlay(spark, sf):
    custom = bk.recipe_table(spark, {"primary_action": {"wrong_action": 5, "cross_video": 2}})
    return demand(spark, sf, bk.overlay_recipes(bk.recipe_table(spark), custom))


# --- F8, G8-G24 -------------------------------------------------------------------------------------------------

_made: dict[tuple, bk.Pools] = {}


def pools_of(spark, sf) -> bk.Pools:
    """The numbered pools of the clips, built once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _made:
        _made[key] = bk.Pools(person_arrays(clips(spark, sf)))
    return _made[key]


_NUM = lambda op, src: f"(select lower(v) key, min(v) as value, row_number() over (order by md5('42|{op}|' || lower(v)), lower(v)) - 1 no, count(*) over () n from ({src}) where v <> '' group by lower(v))"
_DRAWS = _SLOTS + f"""
, pp as {_NUM('people', "select trim(agg) v from sl union all select trim(vic) from sl union all select trim(unnest(bystanders)) from sl")},
pa as {_NUM('actions', "select trim(act) v from sl where lower(act) <> 'none'")},
pe as {_NUM('places', "select trim(env) v from sl")},
dn as (select clip, agg d_agg, vic d_vic, env d_env, row_number() over (order by md5('42|donors|' || clip), clip) - 1 no, count(*) over () n from sl where agg is not null and vic is not null),
nm as (select sl.*, p1.no agg_no, p2.no vic_no, a.no act_no, e.no env_no, d.no donor_no from sl left join pp p1 on lower(agg) = p1.key left join pp p2 on lower(vic) = p2.key
  left join pa a on lower(act) = a.key left join pe e on lower(env) = e.key left join dn d on sl.clip = d.clip)"""
_SKIP1 = lambda d, n, g: f"(case when {g} is null then {d} % {n} else ({d} % ({n} - 1)) + (({d} % ({n} - 1)) >= {g})::int end)"


@query("donor_clips", sql(_DRAWS + f"""
, t as (select clip, {_SKIP1("('0x' || substr(md5('42|donor|' || clip), 1, 8))::bigint", "(select max(n) from dn)", "donor_no")} pick from nm)
select t.clip, dn.clip donor, d_agg, d_vic from t left join dn on pick = no""", "clips"))
def donor_clips(spark, sf):
    pools = pools_of(spark, sf)
    number = bk.skip(hash_int(42, "donor", c("clip")), pools.size["donors"], c("donor_no"))
    side = pools.donors.select(c("no").alias("_no"), c("clip").alias("donor"), "d_agg", "d_vic")
    return pools.clips.select("clip", number.alias("_p")).join(side, c("_p") == c("_no"), "left").select("clip", "donor", "d_agg", "d_vic")


def shown(bank):
    return bank.select("clip", "qtype", "is_trick", join_list("answers").alias("answers"), "correct_answer", "correct_index",
                       join_list("option_hardness").alias("labels"))


_MIX = lambda k="clip || '|' || qtype": (f"list_sort(list_transform(range(len(txt)), lambda i: md5('42|options|' || {k} || '|' || i) || lpad(i::varchar, 3, '0')))")
_SHOW = f""", mx as (select *, list_transform({_MIX()}, lambda s: right(s, 3)::int) ord from opt)
select clip, qtype, is_trick, array_to_string(list_transform(ord, lambda i: txt[i + 1]), ' ## ') answers, correct_answer,
  list_position(list_transform(ord, lambda i: lbl[i + 1]), 'correct')::int - 1 correct_index, array_to_string(list_transform(ord, lambda i: lbl[i + 1]), ' ## ') labels from mx"""

_INVROWS = ", ".join(f"['{l}', '{a}', '{v}', '{x}']" for l, a, v, x in K.INVERTED_LAYOUT)


@query("inverted_questions", sql(_DRAWS + f"""
, tq as (select nm.*, qtype, {_STYLE}, ('0x' || substr(md5('42|invert|' || clip || '|' || qtype), 1, 8))::bigint h from nm, (values {", ".join(f"('{t}')" for t in K.INVERTED_TYPES)}) t(qtype)
   where agg is not null and vic is not null and act is not null),
dd as (select tq.*, a1.value d1, a2.value d2 from tq join pa a1 on a1.no = {_SKIP1('h', 'a1.n', 'act_no')} join pa a2 on a2.no = {_SKIP1('(h + 1)', 'a2.n', 'act_no')}),
ex as (select *, unnest(range(8)) i, unnest([{_INVROWS}]) lay from dd),
tx as (select clip, qtype, i, lay[1] label, {_render_sql("(case when lay[2] = 'A' then agg else vic end)", "(case when lay[3] = 'A' then agg else vic end)", x="(case lay[4] when 'gt' then act when 'd1' then d1 else d2 end)")} t from ex),
opt as (select clip, qtype, false is_trick, list(t order by i) txt, list(label order by i) lbl, list(t order by i)[2] correct_answer from tx group by clip, qtype having count(distinct t) = 8)
""" + _SHOW, "clips"))
def inverted_questions(spark, sf):
    return shown(bk.inverted_questions(person_arrays(clips(spark, sf)), pools_of(spark, sf)))


@query("count_questions", sql(_ASSIGN + f"""
, sq as (select sl.*, qtype, {_STYLE.replace("clip", "sl.clip")} from sl join assigned a on a.clip = sl.clip where qtype like 'role_count_%'),
an as (select clip, qtype, {_render_sql()} correct_answer from sq),
opt as (select *, false is_trick, [correct_answer] || list_filter(['0', '1', '2', '3 or more'], lambda x: x <> correct_answer) txt, ['correct', 'cross_video', 'cross_video', 'cross_video'] lbl from an)
""" + _SHOW, "clips"))
def count_questions(spark, sf):
    return shown(bk.count_questions(assigned(spark, sf).select("clip", "qtype"), person_arrays(clips(spark, sf))))


@query("marked_tricks", sql(_ASSIGN + """
select clip, qtype, row_number() over (partition by qtype order by md5('42|trick|' || clip || '|' || qtype), clip, qtype) <= round(count(*) over (partition by qtype) * 0.1) is_trick from assigned""", "clips"))
def marked_tricks(spark, sf):
    return bk.mark_tricks(assigned(spark, sf).select("clip", "qtype"))


def recipe_bank(spark, sf):
    """The default-recipe bank of the assigned questions, written once per application."""
    from .views import stored
    return stored(spark, sf, "recipe_bank", lambda s, d: bk.recipe_questions(
        assigned(s, d), person_arrays(clips(s, d)), bk.recipe_table(s), pools_of(s, d)))


# --- recipe questions as SQL: the slots' draws in turn, then the walk through the spare values -----------------

_SPARE_TYPES = ", ".join(f"('{t}')" for t in bk.TYPE_SLOTS)
_ACTED = _lst(bk.ACTED)
_h = lambda tag, rest="clip || '|' || qtype": f"('0x' || substr(md5('42|{tag}|' || {rest}), 1, 8))::bigint"
_AT1 = lambda d, n, g: f"(case when {n} - ({g} is not null)::int > 0 then {_SKIP1(d, n, g)} end)"
_SIZES = ("sz as (select (select coalesce(max(n), 0) from pp) npp, (select coalesce(max(n), 0) from pa) npa, (select coalesce(max(n), 0) from pe) npe, (select coalesce(max(n), 0) from dn) ndn)")
_NONE_LIKE = lambda x: _has(x, K.NONE_KEYWORDS)
_NULLS = "case qtype " + " ".join(f"when '{t}' then '{v.replace(chr(39), chr(39) * 2)}'" for t, v in K.NULL_ANSWERS.items()) + " end"
_IDX = "case {0} " + " ".join(f"when '{label}' then {i}" for i, label in enumerate(K.FALLBACK_ORDER)) + " else -1 end"
_NAMED = "{0} is not null and {0} <> 'group of people'"


def _recipe_rows(recipes: dict) -> str:
    whole = {t: {"cross_video": bk.N_DISTRACTORS} for t in bk.TYPE_SLOTS} | {t: r for t, r in recipes.items() if t in bk.TYPE_SLOTS}
    return ", ".join(f"('{t}', '{label}', {i}, {sum(r.values())})" for t, r in whole.items()
                     for i, label in enumerate(label for label in sorted(r) for _ in range(r[label])))


def _recipe_turn(p: int) -> str:
    """Draw number p of every slot of the questions in fold{p - 1}, and the fold over the slots that are not filled yet."""
    return f"""
, ds{p} as (select f.*, rs.label, rs.slot, md5('42|slot|' || clip || '|' || qtype || '|' || slot) turn_key, slot + {7 * p} nth, {_STYLE}
   from (select * from {f"fold{p - 1} where step = 7 and len(lbl) < want" if p else "starts"}) f join rs using (qtype) where not list_contains(slots, slot)),
dr{p} as (select f.*, agg, vic, bys, act, env, na, nv, nb, bystanders, npa - (act_no is not null)::int lft, act_no, env_no, donor_no, npp, npa, npe, ndn,
   least(agg_no, vic_no) lo, case when agg_no <> vic_no then greatest(agg_no, vic_no) end hi,
   {_h('near', "f.clip || '|' || qtype || '|' || slot")} hn from ds{p} f join nm on nm.clip = f.clip, sz),
da{p} as (select *, case when nth < lft then nth when nth >= 7 and lft > 7 then 7 + (nth - 7) % (lft - 7) end a_turn,
   case when npp - (lo is not null)::int - (hi is not null)::int > 0 then ({_h('who')} + nth) % (npp - (lo is not null)::int - (hi is not null)::int) end w0,
   {_AT1(f"({_h('where')} + nth)", 'npe', 'env_no')} p_no, {_AT1(f"({_h('donor')} + nth)", 'ndn', 'donor_no')} v_no from dr{p}),
db{p} as (select *, w1 + coalesce((w1 >= hi)::int, 0) w_no from (select *, w0 + coalesce((w0 >= lo)::int, 0) w1 from da{p})),
d2{p} as (select b.*, pa.value x2, pp.value w2, pe.value e2, dn.d_agg, dn.d_vic, dn.d_env, list_filter(coalesce(bystanders, []), lambda b: b <> 'group of people') near,
   agg is not null and vic is not null both_ from db{p} b left join pa on pa.no = {_AT1(f"({_h('act')} + a_turn)", 'npa', 'act_no')}
   left join pp on pp.no = w_no left join pe on pe.no = p_no left join dn on dn.no = v_no),
d4{p} as (select *, case when len(near) > 0 then near[(hn % len(near))::int + 1] end standin, case when both_ then (hn // 16) % 2 = 0 else agg is not null end on_agg from d2{p}),
mu{p} as (select clip, qtype, slot, label, turn_key, no_text, style, coin, bys, nb, x2 act,
   unnest([{{'l': 'role_reversal', 'ok': both_, 'a': vic, 'v': agg, 'e': env, 'na': nv, 'nv': na}}, {{'l': 'wrong_action', 'ok': true, 'a': agg, 'v': vic, 'e': env, 'na': na, 'nv': nv}},
     {{'l': 'wrong_victim', 'ok': both_ and w2 is not null, 'a': agg, 'v': w2, 'e': env, 'na': na, 'nv': 1}}, {{'l': 'wrong_aggressor', 'ok': both_ and w2 is not null, 'a': w2, 'v': vic, 'e': env, 'na': 1, 'nv': nv}},
     {{'l': 'bystander_substitution', 'ok': standin is not null and (agg is not null or vic is not null), 'a': case when on_agg then standin else agg end, 'v': case when on_agg then vic else standin end, 'e': env,
       'na': case when on_agg then 1 else na end, 'nv': case when on_agg then nv else 1 end}},
     {{'l': 'wrong_location', 'ok': e2 is not null, 'a': agg, 'v': vic, 'e': e2, 'na': na, 'nv': nv}}, {{'l': 'wrong_category', 'ok': true, 'a': agg, 'v': vic, 'e': coalesce(e2, env), 'na': na, 'nv': nv}},
     {{'l': 'cross_video', 'ok': d_agg is not null, 'a': d_agg, 'v': d_vic, 'e': coalesce(d_env, env), 'na': 1, 'nv': 1}}]) m from d4{p} where x2 is not null),
mv{p} as (select * exclude (m), m.l l, m.a agg, m.v vic, m.e env, m.na na, m.nv nv, case when m.l = label then -1 else {_IDX.format('m.l')} end ord from mu{p}
   where m.ok and (m.l = label or {_IDX.format('m.l')} > {_IDX.format('label')})),
mt{p} as (select clip, qtype, slot, turn_key, act, ord, l, no_text, {_render_sql()} t from mv{p}),
cs{p} as (select clip, qtype, slot, turn_key, act, list({{'l': l, 't': t}} order by ord) c from mt{p} where t is not null and lower(t) is distinct from no_text group by all),
ca{p} as materialized (select *, row_number() over (partition by clip, qtype order by turn_key, slot) step from cs{p}),
fold{p}(clip, qtype, correct_answer, no_text, want, txt, lbl, slots, step) as (
   select *{"" if not p else " exclude (step)"}, 0::bigint from {"starts" if not p else f"fold{p - 1} where step = 7 and len(lbl) < want"}
   union all
   select clip, qtype, correct_answer, no_text, want, case when k is null then txt else txt || [k.t] end, case when k is null then lbl else lbl || [k.l] end,
     case when k is null then slots else slots || [slot] end, step
   from (select f.clip, f.qtype, f.correct_answer, f.no_text, f.want, f.step + 1 step, txt, lbl, slots, a.slot,
       case when a.clip is not null and (f.qtype not in {_ACTED} or len(list_filter(txt, lambda u: contains(lower(u), lower(act)))) = 0)
         then list_filter(c, lambda x: not list_contains(list_transform(txt, lambda u: lower(u)), lower(x.t)))[1] end k
     from fold{p} f left join ca{p} a on a.clip = f.clip and a.qtype = f.qtype and a.step = f.step + 1 where f.step < 7))"""


def _recipe_fill(recipes: dict) -> str:
    """From aq (clip, qtype, correct_answer, no_text): filled, after two draws a slot."""
    return f"""
, rs(qtype, label, slot, want) as (values {_recipe_rows(recipes)}),
starts as (select distinct aq.*, want, [lower(correct_answer)] txt, []::varchar[] lbl, []::bigint[] slots from aq join rs using (qtype))""" + _recipe_turn(0) + _recipe_turn(1) + """
, filled as materialized (select * exclude (step, slots) from fold0 where step = 7 and len(lbl) >= want
   union all select * exclude (step, slots) from fold1 where step = 7)"""


def _walk(name: str, before: str, pools: dict[str, str], repeats: bool) -> str:
    """Go on from `before` through the spare values, one at a time, while a question is short and its values last."""
    size = {slot: f"(select coalesce(max(n), 0) from {pool})" for slot, pool in pools.items()}
    sizes = ", ".join(f"{size[slot]} z_{slot}" for slot in pools)
    at, limit = {slot: "case qtype" for slot in pools}, "case qtype"
    for qtype, shown in bk.TYPE_SLOTS.items():
        if repeats and qtype != "sequence_verification":
            continue
        below = "1"
        for slot in shown:
            both = f"({below} * z_{slot})"
            at[slot] += f" when '{qtype}' then ({_h('spare_' + slot)} + k % greatest({both}, 1) + (k % greatest({both}, 1)) // greatest(lcm({below}, z_{slot}), 1)) % greatest(z_{slot}, 1)"
            below = both
        limit += f" when '{qtype}' then " + (f"least(z_act, {below})" if qtype in bk.ACTED and not repeats else below)
    free = "true" if repeats else f"(qtype not in {_ACTED} or (lower(x) is distinct from own_act and len(list_filter(txt, lambda u: contains(lower(u), lower(x)))) = 0))"
    joins = " ".join(f"left join {pool} j_{slot} on j_{slot}.no = at_{slot}" for slot, pool in pools.items())
    return f"""
, {name}_z as materialized (select {sizes}),
{name}_w(clip, qtype, correct_answer, no_text, want, txt, lbl, k) as (
   select clip, qtype, correct_answer, no_text, want, txt, lbl, 0::bigint from {before}
   union all
   select clip, qtype, correct_answer, no_text, want, case when ok then txt || [t] else txt end, case when ok then lbl || ['cross_video'] else lbl end, k + 1
   from (select *, coalesce(t is not null and lower(t) is distinct from no_text and not list_contains(list_transform(txt, lambda u: lower(u)), lower(t)) and {free}, false) ok from (
     select *, case qtype when 'compound_aggressor_victim_count' then s_av when 'compound_victim_bystander_count' then s_vb else {_render_sql('s_agg', 's_vic', 's_by', 'x', 's_env')} end t from (
       select w.*, {', '.join(f"j_{slot}.value {'x' if slot == 'act' else 's_' + slot}" for slot in pools)}, lower(sl.act) own_act, 1 na, 1 nv, 0 nb, {_STYLE.replace("clip", "w.clip")}
       from (select *, {', '.join(f"{expr} end at_{slot}" for slot, expr in at.items() if 'when' in expr)}{''.join(f", null::bigint at_{slot}" for slot, expr in at.items() if 'when' not in expr)}
         from {name}_w, {name}_z where len(lbl) < want and k < coalesce({limit} end, 0)) w join sl on sl.clip = w.clip {joins})))),
{name} as materialized (select clip, qtype, correct_answer, no_text, want, arg_max(txt, k) txt, arg_max(lbl, k) lbl from {name}_w group by all)"""


_COUNTED = lambda a, b, x, y: f"""select {a} || ' {x}' || (case when {a} = 1 then '' else 's' end) || ' and ' || {b} || ' {y}' || (case when {b} = 1 then '' else 's' end) v"""
_SPARES = f"""
, sg as materialized {_NUM('spare_agg', "select d_agg v from dn")}, sv as materialized {_NUM('spare_vic', "select d_vic v from dn")},
sb as materialized {_NUM('spare_by', "select bys v from sl where len(list_filter(coalesce(bystanders, []), lambda b: b <> 'group of people')) > 0")},
av as materialized {_NUM('compound_aggressor_victim_count', _COUNTED('na', 'nv', 'aggressor', 'victim') + " from sl union all " + _COUNTED('a', 'b', 'aggressor', 'victim') + " from range(4) x(a), range(4) y(b)")},
vb as materialized {_NUM('compound_victim_bystander_count', _COUNTED('nv', 'nb', 'victim', 'bystander') + " from sl union all " + _COUNTED('a', 'b', 'victim', 'bystander') + " from range(4) x(a), range(4) y(b)")}"""
_FIRST = {"agg": "sg", "vic": "sv", "by": "sb", "act": "pa", "env": "pe", "av": "av", "vb": "vb"}
_WALKS = (_SPARES + _walk("w1", "filled", _FIRST, False) + _walk("w2", "w1", _FIRST | dict.fromkeys(("agg", "vic", "by"), "pp"), False)
          + _walk("w3", "w2", _FIRST | dict.fromkeys(("agg", "vic", "by"), "pp"), True))
_OPTIONS = """
, opt as (select clip, qtype, {0} is_trick, [correct_answer] || txt[2:] txt, ['correct'] || lbl lbl, correct_answer from {1})"""
_BASE = _ASSIGN + _DRAWS[len(_SLOTS):] + ", " + _SIZES


def _recipe_bank(asked: str) -> str:
    """The recipe bank of `asked`, rows of (clip, qtype)."""
    return _BASE + f"""
, aq0 as (select a.clip, qtype, {_render_sql()} correct_answer from (select a.*, sl.* exclude (clip), {_STYLE.replace("clip", "a.clip")} from ({asked}) a join sl on sl.clip = a.clip where qtype in (select * from (values {_SPARE_TYPES}))) a),
aq as materialized (select clip, qtype, correct_answer, null::varchar no_text from (select *, lower(trim(correct_answer)) x, lower({_NULLS}) y from aq0) where correct_answer is not null and (qtype = 'sequence_verification'
   or not (x = y or ({_NONE_LIKE('x')} and {_NONE_LIKE('y')}) or (length(x) > 10 and length(y) > 10 and (contains(x, y) or contains(y, x))))))""" + _recipe_fill(K.DEFAULT_RECIPES) + _WALKS + _OPTIONS.format("false", "w3")


_RECIPE = _recipe_bank("select clip, qtype from assigned")
_TRICK_TYPES = _lst([t for t in bk.TYPE_SLOTS if "count" not in t])
_TRICKS = _BASE + f"""
, asked as (select clip, qtype from (select clip, qtype, row_number() over (partition by qtype order by md5('42|trick|' || clip || '|' || qtype), clip, qtype) <= round(count(*) over (partition by qtype) * 0.1) hit from assigned)
   where hit and qtype in {_TRICK_TYPES}),
aq as materialized (select a.clip, qtype, {_NULLS} correct_answer, lower({_render_sql()}) no_text from (select a.*, sl.* exclude (clip), {_STYLE.replace("clip", "a.clip")} from asked a join sl on sl.clip = a.clip) a)""" + _recipe_fill(
    {t: {"cross_video": 7} for t in bk.TYPE_SLOTS}) + _WALKS + """
, padded as (select * replace (case when qtype = 'sequence_verification' then txt else txt || list_transform(range(len(lbl), 7), lambda i: 'Option ' || (i + 2)) end as txt,
   case when qtype = 'sequence_verification' then lbl else lbl || list_transform(range(len(lbl), 7), lambda i: 'cross_video') end as lbl) from w3)""" + _OPTIONS.format("true", "padded")


_KEPT_CTES = ("clips as (", "pp as (", "pa as (", "pe as (", "dn as (", "nm as (", "sl as (")


def _recursive(text: str) -> str:
    """The statement as a recursive one; tables that every step of a recursion reads are kept, not made again."""
    for name in _KEPT_CTES:
        text = text.replace(name, name.replace("as (", "as materialized ("), 1)
    return "with recursive " + text.removeprefix("with ")


@query("recipe_questions", _recursive(sql(_RECIPE + _SHOW, "clips")))
def recipe_questions(spark, sf):
    """Greedy slot filling, and the walk through the spare values."""
    return shown(recipe_bank(spark, sf))


@query("recipe_label_counts", _recursive(sql(_RECIPE + " select qtype, label, count(*) n from (select qtype, unnest(lbl) as label from opt) group by all", "clips")))
def recipe_label_counts(spark, sf):
    return recipe_bank(spark, sf).select("qtype", F.explode("option_hardness").alias("label")).groupBy("qtype", "label").agg(F.count("*").alias("n"))


@query("trick_questions", _recursive(sql(_TRICKS + _SHOW, "clips")))
def trick_questions(spark, sf):
    marked = bk.mark_tricks(assigned(spark, sf).select("clip", "qtype")).filter("is_trick").drop("is_trick")
    return shown(bk.trick_questions(marked, pools_of(spark, sf)))


@query("override_questions")
def override_questions(spark, sf):
    return shown(bk.override_questions(assigned(spark, sf), person_arrays(clips(spark, sf)), pools_of(spark, sf)))


@query("balanced_grid_questions")
def balanced_grid_questions(spark, sf):
    return shown(bk.balanced_grid(assigned(spark, sf), person_arrays(clips(spark, sf)), pools_of(spark, sf)))


_WHO = """
, who as (select clip, list_filter([{'r': 'Aggressor', 'p': agg}, {'r': 'Victim', 'p': vic}] || list_transform(coalesce(bystanders, []), lambda b: {'r': 'Bystander', 'p': b}),
    lambda x: x.p is not null and not contains(lower(x.p), 'group of')) w, list_filter([lower(agg), lower(vic)] || list_transform(coalesce(bystanders, []), lambda b: lower(b)), lambda x: x is not null) own from sl)
, pk as (select clip, own, w[(('0x' || substr(md5('42|role|' || clip), 1, 8))::bigint % len(w))::int + 1] pick from who where len(w) > 0)"""
_ROLES = "['Aggressor', 'Victim', 'Bystander', 'No one in the video fits that description']"


@query("role_questions", sql(_DRAWS + _WHO + f"""
, tr as (select clip from clips where group_id like 'g_1%'),
tf as (select pk.clip, arg_min(value, k) as fp from (select *, unnest(range(len(list_distinct(own)) + 1)) k from pk semi join tr using (clip)) pk
   join pp on pp.no = (('0x' || substr(md5('42|foreign|' || pk.clip), 1, 8))::bigint + k) % pp.n where not list_contains(own, lower(value)) group by 1),
z as (select pk.clip, 'role_identification' qtype, fp is not null is_trick, case when fp is not null then 'No one in the video fits that description' else pick.r end correct_answer,
   coalesce(fp, pick.p) person from pk left join tf using (clip)),
opt as (select *, {_ROLES} txt, list_transform({_ROLES}, lambda r: case when r = correct_answer then 'correct' when is_trick then 'cross_video' when r = 'No one in the video fits that description' then 'none_claim'
   when r = 'Bystander' then 'bystander_substitution' else 'role_reversal' end) lbl from z)
""" + _SHOW.replace("select clip, qtype, is_trick,", "select 'Concerning the ' || person || ', their role would best be described as:' prompt, clip, qtype, is_trick,"), "clips"))
def role_questions(spark, sf):
    base = person_arrays(clips(spark, sf))
    bank = bk.role_questions(base, base.filter(c("group_id").startswith("g_1")), pools_of(spark, sf))
    return shown(bank).join(bank.select("clip", "prompt"), "clip")


_NEG = _SLOTS + """
, vv as (select distinct qtype, t as value from (select unnest(['aggressor_identification', 'perspective_aggressor', 'victim_recognition', 'bystander_detection', 'primary_action', 'social_appropriateness',
     'sequence_verification', 'interaction_summary', 'compound_aggressor_action_victim', 'compound_aggressor_location', 'compound_action_victims', 'compound_bystander_location', 'scene_location']) qtype,
   unnest([agg, agg, vic, bys, act, 'The action performed by ' || agg, agg || ', who is the aggressor, performed the action of ' || act || ' against ' || vic, agg || ' performs action of ' || act || ' on ' || vic,
     agg || ' performed ' || act || ' on ' || vic, agg || ' in ' || env, act || '; Victim: ' || vic, bys || ' in ' || env, env]) t
   from sl where not (act is null and agg is null and vic is null)) where t is not null),
np as (select *, row_number() over (partition by qtype order by md5('42|negative|' || value), value) - 1 no, count(*) over (partition by qtype) n from vv),
td as (select clip from sl where act is null and agg is null and vic is null and clip not in (select clip from questions)),
dr as (select td.clip, s.qtype, k, (('0x' || substr(md5('42|negative|' || td.clip || '|' || s.qtype), 1, 8))::bigint + k) % s.n no from td, (select qtype, max(n) n from np group by 1 having max(n) >= 7) s, range(7) r(k)),
ls as (select clip, qtype, list(value order by k) d from dr join np using (qtype, no) group by all union all select clip, 'role_identification', ['Aggressor', 'Victim', 'Bystander'] from td),
nl(qtype, correct_answer) as (values {nulls}),
opt as (select clip, qtype, true is_trick, correct_answer, d || [correct_answer] txt, list_transform(d, lambda x: 'cross_video') || ['correct'] lbl from ls join nl using (qtype))"""


@query("negative_questions", sql(_NEG.replace("{nulls}", ", ".join(f"('{t}', '{v}')" for t, v in K.NULL_ANSWERS.items())) + _SHOW, "questions"))
def negative_questions(spark, sf):
    return shown(bk.negative_questions(person_arrays(clips(spark, sf)), questions(spark, sf)))


_NONEISH = lambda x: f"regexp_matches(lower({x}), '" + "|".join(K.NONE_KEYWORDS) + "')"
_LOW = lambda x: f"lower(trim({x}))"
_HOLDS = lambda x, y: f"(len({_LOW(x)}) > 10 and len({_LOW(y)}) > 10 and (contains({_LOW(x)}, {_LOW(y)}) or contains({_LOW(y)}, {_LOW(x)})))"
_ALIKE = lambda x, y: f"({_LOW(x)} = {_LOW(y)} or ({_NONEISH(x)} and {_NONEISH(y)}) or {_HOLDS(x, y)})"
_ASKED_OF = ("victim_recognition", "victim", "aggressor"), ("aggressor_identification", "aggressor", "victim")

_SAMPLED = """
, near as (select clip, aggressor, victim, list_filter(coalesce(bystanders, []), lambda x: not contains(lower(x), 'group of')) nb from clips),
asked as (""" + " union all ".join(
    f"select clip, '{t}' qtype, {right} a, [{wrong}] || nb own0, '{K.NULL_ANSWERS[t]}' nul0 from near where {right} is not null"
    for t, right, wrong in _ASKED_OF) + f"""),
q0 as (select *, list_filter(own0, lambda x: not {_ALIKE("x", "a")}) own from asked),
q1 as (select *, list_distinct(list_transform(own, lambda x: lower(x))) mine, case when not {_ALIKE("nul0", "a")}
  and not list_contains(list_transform(own, lambda x: lower(x)), lower(nul0)) then nul0 end nul from q0),
q as (select *, greatest(7 - len(own) - (nul is not null)::int, 0) need, ('0x' || substr(md5('42|sampled|' || clip || '|' || qtype), 1, 8))::bigint h from q1),
people as (select trim(p) v from (select unnest([aggressor, victim] || coalesce(bystanders, [])) p from clips) where trim(p) <> ''),
ans as (select distinct a, {_LOW("a")} alow, {_NONEISH("a")} an from asked),
pool as (select *, {_LOW("value")} low, {_NONEISH("key")} nn, row_number() over (order by {_NONEISH("key")}, len(value), md5('42|sampled|' || key), key) - 1 no
  from (select lower(v) key, min(v) value from people group by 1)),
free as (select *, row_number() over (partition by a, part order by no) - 1 r from (
  select a, no, key, value, case when len(value) * 5 between len(a) * 3 and len(a) * 7 then 0 else 1 end part
  from ans, pool where low <> alow and not (nn and an) and not (length(alow) > 10 and length(low) > 10 and (contains(low, alow) or contains(alow, low))))),
sizes as (select a, count(*) filter (part = 0) f0, count(*) filter (part = 1) f1 from free group by 1),
drawn as (select *, least(f0, need + len(mine)) n0 from q join sizes using (a) where need > 0),
tries as (select *, case when k < n0 then 0 else 1 end part, case when k < n0 then (h + k * 2654435761) % f0 else (h + (k - n0) * 2654435761) % f1 end r
  from (select *, unnest(range(n0 + least(f1, need + len(mine) - n0))) k from drawn)),
found as (select clip, qtype, list(value order by k) f from tries join free using (a, part, r) where not list_contains(mine, key) group by all),
ready as (select clip, qtype, a, own || coalesce(f[:need], []) || case when nul is null then [] else [nul] end d from q left join found using (clip, qtype))
select clip, qtype, a correct_answer, array_to_string(d || list_transform(range(len(d), 7), lambda i: 'Option ' || (i + 2)), ' ## ') distractors from ready"""


@query("pool_sampled_distractors", sql(_SAMPLED, "clips"))
def pool_sampled_distractors(spark, sf):
    """Victim and aggressor questions with people of the clip first and a drawn rest."""
    base = person_arrays(clips(spark, sf))
    near = F.coalesce(ppl.individual_people(c("bystander")), F.array().cast("array<string>"))
    kinds = [F.struct(F.lit(t).alias("qtype"), F.get(right, F.lit(0)).alias("correct_answer"), F.concat(wrong, near).alias("own"),
                      F.lit(K.NULL_ANSWERS[t]).alias("null_text")) for t, right, wrong in _ASKED_OF]
    asked = base.select("clip", F.explode(F.array(*kinds)).alias("k")).select("clip", "k.*").filter("correct_answer is not null")
    people = pools_of(spark, sf).people.select("value")
    out = bk.sample_from_pool(asked, people, c("own"), c("null_text"))
    return out.withColumn("distractors", join_list("distractors"))


_LEADING = lambda x: (f"lower(case when contains({x}, '; ') then trim(split_part({x}, '; ', 1)) "
                      f"when regexp_matches({x}, '(?s)^.+ in ') then trim(regexp_extract({x}, '(?s)^(.+) in ', 1)) end)")

_CAPPED = f"""
, r0 as (select clip, group_id, qtype, correct_answer a, split_part(correct_answer, '; ', 1) lead, list_filter(answers, lambda x: x <> correct_answer) d0
  from questions where qtype = 'compound_action_victims'),
r1 as (select clip, qtype, a, {_LEADING("a")} key, list_transform(d0, lambda x, i: case when i % 2 = 1 then lead || '; Victim: person ' || (i - 1) else x end) d from r0),
r2 as (select *, list_transform(d, lambda x: {_LEADING("x")}) p from r1),
r3 as (select *, list_filter(range(len(d)), lambda i: p[i + 1] = key) same,
  greatest(coalesce(list_max(list_transform(list_filter(p, lambda x: x <> key), lambda x: len(list_filter(p, lambda y: y = x)))), 0), 1) top from r2),
r4 as (select *, case when key is not null and len(same) + 1 > top then len(same) - (top - 1) else 0 end evict from r3),
r5 as (select *, list_sort(list_transform(list_sort(list_transform(same, lambda i: md5('42|prefix|' || clip || '|' || qtype || '|' || i) || lpad(i::varchar, 4, '0')))[:evict],
  lambda x: right(x, 4)::int)) gone, list_distinct([lower(a)] || list_transform(d, lambda x: lower(x))) mine,
  ('0x' || substr(md5('42|prefix|' || clip || '|' || qtype), 1, 8))::bigint h from r4),
pool as (select *, {_LOW("value")} low, row_number() over (order by nn, cls, md5('42|prefix|' || key), key) - 1 no from (
  select lower(a) key, min(a) value, {_NONEISH("lower(a)")} nn, coalesce({_LEADING("min(a)")}, '') cls from r0 group by lower(a))),
ans as (select distinct a, {_LOW("a")} alow, coalesce(key, '') akey, {_NONEISH("a")} an from r5 where evict > 0),
ex as (
  select a, no from ans join pool on akey = cls union select a, no from ans join pool on an and nn
  union select a, no from ans join pool on {_LOW("a")} = {_LOW("value")} union select a, no from ans, pool where length(alow) > 10 and length(low) > 10 and (contains(low, alow) or contains(alow, low))),
gaps as (select a, list(g order by g) gs, count(*) lost from (select a, no - (row_number() over (partition by a order by no) - 1) g from ex) group by a),
draws as (select *, (select count(*) from pool) - coalesce(lost, 0) free from r5 left join gaps using (a) where evict > 0),
tries as (select *, (h + k * 2654435761) % free r from (select *, unnest(range(least(free, evict + len(mine)))) k from draws)),
hits as (select clip, mine, evict, k, r + coalesce(len(list_filter(gs, lambda g: g <= r)), 0) no from tries),
found as (select clip, list(value order by k) f from hits join pool using (no) where not list_contains(mine, key) group by clip),
fin as (select r5.*, list_transform(range(len(d)), lambda i: case when list_contains(gone, i) then f[list_position(gone, i)] else d[i + 1] end) z from r5 left join found using (clip))
select clip, qtype, a correct_answer, array_to_string(list_filter(z, lambda x: x is not null), ' ## ') distractors from fin"""


@query("prefix_capped_distractors", sql(_CAPPED, "questions"))
def prefix_capped_distractors(spark, sf):
    q = questions(spark, sf).filter("qtype = 'compound_action_victims'")
    rows = q.select("clip", "qtype", "correct_answer", F.filter("answers", lambda a: a != c("correct_answer")).alias("distractors"))
    # half of the options get the right action in front, so that the cap has work to do
    lead = F.substring_index("correct_answer", "; ", 1)
    rows = rows.withColumn("distractors", F.transform("distractors", lambda d, i: F.when(
        i % 2 == 0, F.concat(lead, F.lit("; Victim: person "), i.cast("string"))).otherwise(d)))
    pool = q.select(c("correct_answer").alias("value")).distinct()
    return bk.cap_prefixes(rows, pool).withColumn("distractors", join_list("distractors"))


@query("unique_action_options")
def unique_action_options(spark, sf):
    """Options of a type whose distractors often share an action, made different."""
    q = questions(spark, sf).filter("qtype = 'compound_action_victims'").select("clip", "qtype", "answers", "correct_index")
    half = F.transform("answers", lambda a, i: F.when(i % 3 == 0, F.regexp_replace(a, r"Brand#\d+", "Brand#7")).otherwise(a))
    rows = q.withColumn("answers", half).withColumn("acts", F.transform("answers", lambda a: F.nullif(
        F.regexp_extract(a, r"(Brand#\d+)", 1), F.lit("")))).withColumn(
        "spare", F.transform(F.sequence(F.lit(30), F.lit(45)), lambda i: F.concat(F.lit("Brand#"), i.cast("string"))))
    return bk.unique_actions(rows, "answers", "acts", "spare").select("clip", "qtype", join_list("answers").alias("answers"))


@query("appended_type", _recursive(sql(_recipe_bank(
    "select clip, qtype from valid where qtype = 'compound_action_aggressor' and clip in (select clip from clips where action is not null)") + _SHOW, "clips")))
def appended_type(spark, sf):
    out = bk.append_type(questions(spark, sf), person_arrays(clips(spark, sf)), "compound_action_aggressor", bk.recipe_table(spark), pools_of(spark, sf))
    return shown(out)


@query("random_questions", sql("""
, r as (select clip, qtype, prompt, row_number() over (order by md5('42|random|' || clip || '|' || qtype || '|' || prompt), clip, qtype, prompt) r from questions)
select clip, qtype from r where r <= 500""", "questions"))
def random_questions(spark, sf):
    return bk.random_questions(questions(spark, sf), 500).select("clip", "qtype")


@query("capped_per_clip", sql("""
, r as (select clip, qtype, row_number() over (partition by clip order by md5('42|capped|' || clip || '|' || qtype), qtype) r from questions where not is_secondary)
select clip, qtype from r where r <= 6""", "questions"))
def capped_per_clip(spark, sf):
    return bk.capped_per_clip(questions(spark, sf)).select("clip", "qtype")


@query("targeted_bank", sql(f"""
, s as (select clip, row_number() over (order by md5('42|sample|' || clip), clip) r, count(*) over () n from clips)
select clip, qtype from questions semi join (select clip from s where r <= greatest(floor(n * 0.2::double), 1)) t using (clip) where qtype in {_lst(K.COUNTING_SOCIAL_TYPES)}""", "questions"))
def targeted_bank(spark, sf):
    chosen = sample_exact(clips(spark, sf).select("clip"), ["clip"], 0.2, rounding="floor")
    return bk.targeted(questions(spark, sf), chosen).select("clip", "qtype")


@query("freeform_prompts", sql("""
select clip, 'How appropriate is this?' prompt, action is not null is_aggressive, trim(action) as action, aggressor, victim, environment from clips""", "clips"))
def freeform_prompts(spark, sf):
    out = bk.freeform_prompts(person_arrays(clips(spark, sf)), "How appropriate is this?")
    g = lambda name: c(f"ground_truth.{name}")
    return out.select("clip", "prompt", g("is_aggressive"), g("action"), F.array_join(g("aggressor"), " and ").alias("aggressor"),
                      F.array_join(g("victim"), " and ").alias("victim"), g("environment"))


@query("question_tags", sql("""
select clip, qtype, array_to_string(list_filter([case when is_trick then 'TRICK' end, case when is_secondary then 'SECONDARY' end,
  case when list_contains(option_hardness, 'frequency_saturation') then 'INVERTED' end], lambda x: x is not null), ',') tags from questions""", "questions"))
def question_tags(spark, sf):
    return bk.tagged(questions(spark, sf)).select("clip", "qtype", F.array_join("tags", ",").alias("tags"))
