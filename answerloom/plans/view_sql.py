"""The derived views as SQL, written separately for the check with another engine."""

from __future__ import annotations

CLIPS = """
lines as (
  select l_orderkey, min(l_partkey) pk, min(l_suppkey) s1, max(l_suppkey) s2,
         min(case when l_returnflag = 'A' then l_suppkey end) s3
  from lineitem group by 1),
clips0 as (
  select o.*, c.*, n.*, l.*, p.*,
    list_filter([case when s2 <> s1 then 'student with bag ' || s2 end,
                 case when s3 <> s1 and s3 <> s2 then 'student with bag ' || s3 end],
                lambda x: x is not null) near
  from orders o join customer c on o_custkey = c_custkey join nation n on c_nationkey = n_nationkey
  left join lines l on o_orderkey = l_orderkey left join part p on pk = p_partkey),
clips as (
  select 'clip_' || o_orderkey clip, p_brand as action,
    case when l_orderkey is not null then 'person in ' || lower(c_mktsegment) || ' coat ' || (o_custkey % 97) end aggressor,
    case when l_orderkey is not null then 'person with ' || p_name || ' ' || s1 end victim,
    case when l_orderkey is null then null
         when o_orderpriority = '5-LOW' then ['group of people']
         when len(near) > 0 then near end bystanders,
    case when o_orderpriority <> '4-NOT SPECIFIED' then lower(n_name) end environment,
    'g_' || o_custkey group_id, lower(o_orderstatus) category
  from clips0)"""

RAW = """
raw0 as (select *, ('0x' || substr(md5('42|raw|' || clip), 1, 8))::bigint % 10 turn from clips),
raw_annotations as (
  select (case when action is null then 'normal_' else '' end) || clip || '.mp4' file_name,
    case when action is null then 'none' when turn = 0 then ' Talking aggressively '
         when turn = 1 then 'grab clothing' else action end as action,
    case when turn = 2 then '[' || coalesce('"' || aggressor || '"', 'null') || ',"","none"]'
         when turn = 3 then 'N/A' when turn = 4 then '3'
         when turn = 5 then regexp_replace(aggressor, '^person', 'Person') else aggressor end aggressor,
    case when turn = 6 then '  ' when turn = 7 then 'unknown' else victim end victim,
    coalesce('["' || array_to_string(bystanders, '","') || '"]', case when turn = 8 then 'none' end) bystanders,
    case when turn = 9 then 'None' else environment end environment,
    case when turn < 5 then category when turn = 5 then 'none' end outcome
  from raw0)"""

QUESTIONS = """
qt(qtype, n, tier) as (values
  ('primary_action', 8, 0), ('role_identification', 4, 0), ('aggressor_identification', 8, 0),
  ('victim_recognition', 8, 0), ('compound_action_aggressor', 8, 1), ('compound_action_victims', 8, 1),
  ('compound_aggressor_victim', 8, 1), ('compound_aggressor_action_victim', 8, 2),
  ('sequence_verification', 8, 2), ('compound_action_location', 8, 3), ('role_count_aggressor', 4, 3),
  ('compound_aggressor_victim_count', 8, 3)),
q0 as (
  select clips.*, qtype, n, tier, tier = 3 is_secondary, md5('42|q|' || clip || '|' || qtype) m
  from clips, qt where action is not null),
q1 as (
  select *, (('0x' || substr(m, 1, 8))::bigint % n)::int correct_index,
    (('0x' || substr(m, 9, 8))::bigint % 100)::int turn,
    ('0x' || substr(m, 17, 8))::bigint % 10 = 0 is_trick,
    ['role_reversal', 'wrong_action', 'wrong_victim', 'wrong_aggressor', 'bystander_substitution',
     'wrong_location', 'wrong_category', 'none_claim', 'other_in_cast', 'cross_video'] lb
  from q0),
q2 as (
  select *,
    list_transform(range(n), lambda i: case when i = correct_index then 'correct'
      when qtype = 'role_identification' then
        ['role_reversal', 'role_reversal', 'bystander_substitution', 'none_claim'][(turn + i) % 4 + 1]
      when n = 4 then 'cross_video' else lb[(turn + i) % 10 + 1] end) option_hardness,
    list_transform(range(n), lambda i: case
      when qtype = 'role_identification' then
        ['Aggressor', 'Victim', 'Bystander', 'No one in the video fits that description'][(turn + i) % 4 + 1]
      when n = 4 then ['0', '1', '2', '3 or more'][(turn + i) % 4 + 1]
      when i <> correct_index and lb[(turn + i) % 10 + 1] = 'none_claim' then 'none of the above'
      else
        case when qtype in ('aggressor_identification', 'compound_aggressor_victim',
                            'compound_aggressor_action_victim', 'sequence_verification') then
               (case when qtype = 'compound_aggressor_victim' then 'Aggressor: ' else '' end) ||
               (case when i = correct_index then aggressor
                     when lb[(turn + i) % 10 + 1] = 'role_reversal' then victim
                     when lb[(turn + i) % 10 + 1] = 'bystander_substitution' then coalesce(bystanders[1], 'student with bag 0')
                     when lb[(turn + i) % 10 + 1] in ('wrong_aggressor', 'cross_video')
                          or qtype = 'aggressor_identification' then 'person in red coat ' || ((turn + i) % 100)
                     else aggressor end) else '' end
        || case qtype when 'compound_aggressor_action_victim' then ' performed '
                      when 'sequence_verification' then ', who is the aggressor, performed the action of ' else '' end
        || case when qtype in ('primary_action', 'compound_action_aggressor', 'compound_action_victims',
                               'compound_aggressor_action_victim', 'sequence_verification', 'compound_action_location')
             then case when i = correct_index then action else 'Brand#' || ((turn + i) % 25 + 1) end else '' end
        || case qtype when 'compound_action_aggressor' then '; Aggressor: ' ||
               (case when i = correct_index then aggressor
                     when lb[(turn + i) % 10 + 1] = 'role_reversal' then victim
                     when lb[(turn + i) % 10 + 1] = 'bystander_substitution' then coalesce(bystanders[1], 'student with bag 0')
                     when lb[(turn + i) % 10 + 1] in ('wrong_aggressor', 'cross_video') then 'person in red coat ' || ((turn + i) % 100)
                     else aggressor end)
             when 'compound_action_victims' then '; Victim: ' when 'compound_aggressor_victim' then '; Victim: '
             when 'compound_aggressor_action_victim' then ' on ' when 'sequence_verification' then ' against '
             when 'compound_action_location' then ' in ' ||
               coalesce(case when i = correct_index then environment else 'nation_' || ((turn + i) % 25) end, 'unclear location')
             when 'compound_aggressor_victim_count' then ((turn + i) % 9) || ' aggressors and 1 victim'
             else '' end
        || case when qtype in ('victim_recognition', 'compound_action_victims', 'compound_aggressor_victim',
                               'compound_aggressor_action_victim', 'sequence_verification') then
             case when i = correct_index then victim
                  when lb[(turn + i) % 10 + 1] = 'role_reversal' then aggressor
                  when lb[(turn + i) % 10 + 1] in ('wrong_victim', 'cross_video')
                       or qtype = 'victim_recognition' then 'person with tin cup ' || ((turn + i) % 100)
                  else victim end else '' end
      end) answers
  from q1),
pr(qtype, prompt) as (values
  ('primary_action', 'If there is an aggressive action taking place in this video, describe it as one of the following:'),
  ('aggressor_identification', 'Who in the video is performing the aggressive behavior?'),
  ('victim_recognition', 'Which person appears to be the target or victim of the aggression shown?'),
  ('compound_action_aggressor', 'Describe the action taking place in the video and identify the aggressor'),
  ('compound_action_victims', 'Describe the action taking place in the video and describe any victims that are present'),
  ('compound_aggressor_victim', 'Which of the following correctly identifies the roles of the individuals shown?'),
  ('compound_aggressor_action_victim', 'Which of the following best describes what happened in the video?'),
  ('sequence_verification', 'Which of the following sequences best describes the interaction shown in the video?'),
  ('compound_action_location', 'Which of the following most accurately describes both the specific type of aggressive action and the location where it occurs?'),
  ('role_count_aggressor', 'How many aggressive people are in the video?'),
  ('compound_aggressor_victim_count', 'How many aggressors and how many victims are in the video?')),
questions as (
  select clip, group_id, q2.qtype, is_secondary, is_trick,
    coalesce(prompt, 'Concerning the ' || victim || ', their role would best be described as:') prompt,
    answers, answers[correct_index + 1] correct_answer, correct_index, option_hardness, n n_options, tier
  from q2 left join pr on q2.qtype = pr.qtype)"""

RESULTS = """
md(model, style, skill) as (values
  ('atlas-8b', 'number', [52, 40, 27, 35]), ('atlas-70b', 'letter', [61, 50, 38, 45]),
  ('borea-7b', 'sentence', [46, 37, 22, 30]), ('cirrus-think', 'dotted', [55, 39, 33, 40])),
r0 as (select questions.*, model, style, skill, md5('42|r|' || model || '|' || clip || '|' || qtype) d from questions, md),
r1 as (
  select *, ('0x' || substr(d, 17, 8))::bigint % 100 fate,
    case when ('0x' || substr(d, 1, 8))::bigint % 100 < skill[tier + 1] then correct_index
         else (('0x' || substr(d, 9, 8))::bigint % n_options)::int end pick
  from r0),
results as (
  select model, clip, qtype, prompt, is_secondary, is_trick, correct_index, n_options, answers, option_hardness bank_labels,
    case when fate < 2 then null when fate < 5 then 'unable to tell'
         when style = 'number' then (pick + 1)::varchar when style = 'letter' then chr(65 + pick) || ') chosen'
         when style = 'sentence' then 'The answer is ' || (pick + 1) || '.'
         else (pick + 1) || '. because of the scene' end response,
    case when fate >= 5 then pick end selected,
    fate >= 5 and pick = correct_index is_correct,
    case when fate < 2 then 'timeout' end error
  from r1)"""

TIERS = """
tiers(qtype, tier_name) as (values
  ('primary_action', 'Basic'), ('aggressor_identification', 'Basic'), ('victim_recognition', 'Basic'),
  ('role_identification', 'Basic'), ('compound_action_aggressor', 'Compound'), ('compound_action_victims', 'Compound'),
  ('compound_aggressor_victim', 'Compound'), ('compound_aggressor_action_victim', 'Detailed'),
  ('sequence_verification', 'Detailed'))"""

_PARTS = {"clips": [CLIPS], "raw": [CLIPS, RAW], "questions": [CLIPS, QUESTIONS], "results": [CLIPS, QUESTIONS, RESULTS]}


def sql(body: str, view: str | None = None, tiers: bool = False, extra: str = "") -> str:
    """A statement with the views it reads in front; `extra` is more CTE text."""
    parts = list(_PARTS[view]) if view else []
    if tiers:
        parts.append(TIERS)
    if extra:
        parts.append(extra)
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body.strip()
