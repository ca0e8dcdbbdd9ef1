"""Plain SQL restatements of the registered queries, over the raw tables.

The trial tables are rebuilt from key arithmetic; what prose says is decided from
the numbers a row was written with, independently of any pattern matching. Lexicons
and catalogue are those of the configuration.
"""

from __future__ import annotations

from .. import fixed_values as fixed


def literal(words) -> str:
    return "[" + ", ".join("'" + w.strip().replace("'", "''") + "'" for w in words) + "]"


def nth(words, key: str) -> str:
    return f"{literal(words)}[CAST(({key}) % {len(words)} AS INT) + 1]"


def cued(assertion: str, modifier: str) -> str:
    """One cue of the class, by pk + sk: those before the modifier first, then those after it."""
    before, after = (fixed.EXTRACTION["assertion"]["cues"][assertion][side] for side in ("pre", "post"))
    n = len(before) + len(after)
    return (f"CASE WHEN (pk + sk) % {n} < {len(before)} THEN {literal(before)}[CAST((pk + sk) % {n} AS INT) + 1] || ' ' || {modifier} "
            f"ELSE {modifier} || ' ' || {literal(after)}[CAST((pk + sk) % {n} AS INT) + 1 - {len(before)}] END")


FORMS = {value: body["surface_forms"] for value, body in fixed.CONCEPTS["modifiers"]["mucosal_involvement"]["values"].items()}
CONCEPTS = ["RASH", "RASH", "RASH", "RASH_ERYTHEMATOUS", "RASH_MACULOPAPULAR", "PRURITUS", "NAUSEA", "NEUTROPENIA"]
EVENT = "CASE CAST(pk % 8 AS INT) " + " ".join(
    f"WHEN {i} THEN {nth(fixed.CONCEPTS['concepts'][c]['lexicon'], 'sk')}" for i, c in enumerate(CONCEPTS)) + " END"
PHRASE = ("CASE WHEN w = 3 THEN NULL WHEN w = 4 THEN 'site wording ' || pk % 97 WHEN w = 1 THEN " + nth(FORMS["UNSPECIFIED"], "pk")
          + "".join(f" WHEN pk % {len(FORMS)} = {i} THEN {nth(forms, f'pk // {len(FORMS)}')}" for i, forms in enumerate(FORMS.values())) + " END")
SAID = f"CASE w WHEN 1 THEN {cued('absent', 'phrase')} WHEN 2 THEN {cued('uncertain', 'phrase')} ELSE phrase END"
IDLE = ("array_to_string(list_transform(range(1, CAST(CASE WHEN sk % 19 = 0 THEN 40 ELSE 1 + sk % 3 END AS BIGINT) + 1), "
        "lambda i: 'Day ' || (pk + i) % 240 || ': ' || " + nth(fixed.EXTRACTION["assertion"]["pseudo_cues"], "pk + i") + " || '.'), ' ')")
EVENTS = f"""
ln AS (SELECT l_orderkey AS ok, l_linenumber AS ln, min(l_partkey) AS pk, min(l_suppkey) AS sk,
              min(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
fd AS (SELECT o_custkey AS k, min(o_orderkey % 200) AS fday FROM orders GROUP BY 1),
e0 AS (SELECT ln.*, o.o_custkey AS k, fd.fday, CAST(o.o_custkey % 7 AS INT) AS s,
              CAST((ok + ln) % 5 AS INT) AS t
       FROM ln JOIN orders o ON ok = o.o_orderkey JOIN fd ON fd.k = o.o_custkey),
w0 AS (SELECT *, CASE WHEN s = 3 AND t = 0 AND sk % 13 = 0 THEN 1 WHEN s = 4 AND t = 1 AND sk % 17 = 0 THEN 0 ELSE t END AS w FROM e0),
e1 AS (SELECT *, 'R-' || ok || '-' || ln AS rid, 'C-' || k AS subject_id,
  'STUDY-' || substr('ABCDEFG', s + 1, 1) AS study_id,
  ['P_structured','P_text','P_absent','P_both','P_negated','P_version','P_concept_variant'][s + 1] AS profile,
  ['D-21.0','D-20.0','D-21.0','D-21.0','D-21.0','D-19.0','D-21.0'][s + 1] AS version,
  ['RASH','RASH','RASH','RASH_ERYTHEMATOUS','RASH_MACULOPAPULAR','PRURITUS','NAUSEA','NEUTROPENIA'][CAST(pk % 8 AS INT) + 1] AS concept,
  CASE WHEN pk % 8 = 3 AND s NOT IN (1, 5) THEN 'Erythematous rash' ELSE
    ['Rash','Rash','Rash','Rash erythematous','Rash maculopapular','Pruritus','Nausea','Neutropenia'][CAST(pk % 8 AS INT) + 1] END AS code,
  {EVENT} AS event, {literal(FORMS)}[CAST(pk % {len(FORMS)} AS INT) + 1] AS site, {PHRASE} AS phrase,
  CAST(pk % 240 - fday AS INT) AS off_true,
  DATE '2022-01-01' + CAST(pk % 240 AS INT) AS onset_true,
  CASE WHEN sk % 23 = 0 OR sk % 29 = 0 THEN NULL ELSE DATE '2022-01-01' + CAST(pk % 240 AS INT) END AS onset,
  CASE WHEN pk % 11 = 0 THEN NULL ELSE DATE '2022-01-01' + CAST(pk % 240 + 2 + pk % 27 AS INT) END AS ends,
  DATE '2022-01-01' + CAST(fday AS INT) AS anchor,
  CAST(1 + CAST(q AS INT) % 4 AS INT) AS grade,
  (s = 1 AND t IN (0, 2, 4)) OR (s IN (3, 4) AND t <> 3) AS in_term,
  s IN (0, 3, 5) AND t <> 3 AS in_structured, s = 6 AND t <> 3 AS in_comment,
  CASE WHEN t IN (0, 4) THEN 'present' WHEN t = 1 THEN 'absent' WHEN t = 2 THEN 'uncertain' END AS said,
  CASE w WHEN 0 THEN 'present' WHEN 1 THEN 'absent' WHEN 2 THEN 'uncertain' END AS told
  FROM w0),
sd AS (SELECT *, {SAID} AS stated FROM e1),
ev AS (SELECT *, study_id || ':' || rid AS record_id,
  CAST(date_diff('day', anchor, onset) AS INT) AS off,
  CASE WHEN NOT in_term THEN event
    WHEN w IN (0, 4) AND sk % 3 <> 1 THEN event || ' ' || {nth(fixed.LINK_WORDS[-3:], 'sk')} || ' ' || {nth(fixed.LINK_WORDS[:-3], 'pk')} || ' ' || phrase
    ELSE event || ' on day ' || pk % 240 || ': ' || stated END AS aeterm,
  CASE WHEN NOT in_comment THEN NULL ELSE {IDLE} || CASE WHEN t = 1 AND sk % 2 = 1 THEN ''
    ELSE ' Day ' || pk % 240 || ': ' || stated || CASE WHEN t IN (0, 4) THEN ' at ' || 1 + sk % 4 || ' places' ELSE '' END || '.' END END AS remark,
  CASE WHEN in_term AND w IN (0, 1, 2) THEN told END AS term_says,
  CASE WHEN in_term AND w IN (0, 2) AND site <> 'UNSPECIFIED' THEN site END AS term_site,
  CASE WHEN NOT in_term THEN NULL WHEN w = 0 THEN [0.95, 0.78, 0.95][CAST(sk % 3 AS INT) + 1]
       WHEN w = 1 THEN 0.9 WHEN w = 2 THEN 0.55 END AS term_conf,
  CASE WHEN in_comment AND (t IN (0, 2) OR (t = 1 AND sk % 2 = 0)) THEN said END AS comment_says,
  CASE WHEN in_comment AND t IN (0, 2) AND site <> 'UNSPECIFIED' THEN site END AS comment_site,
  CASE WHEN NOT in_comment THEN NULL WHEN t = 0 THEN 0.85 WHEN t = 1 AND sk % 2 = 0 THEN 0.9
       WHEN t = 2 THEN 0.55 END AS comment_conf,
  CASE WHEN in_structured THEN said END AS struct_says
  FROM sd),
md AS (SELECT *,
  coalesce(struct_says, CASE WHEN s IN (1, 4) THEN term_says WHEN s = 6 THEN comment_says END) AS m_says,
  CASE WHEN struct_says IS NOT NULL THEN 'direct'
       WHEN (s IN (1, 4) AND term_says IS NOT NULL) OR (s = 6 AND comment_says IS NOT NULL) THEN 'extracted' END AS m_method,
  CASE WHEN struct_says IS NULL AND s IN (1, 4) THEN term_site WHEN s = 6 THEN comment_site END AS m_value,
  CASE WHEN struct_says IS NULL AND s IN (1, 4) THEN term_conf WHEN s = 6 THEN comment_conf END AS m_conf,
  CASE s WHEN 0 THEN 'AEMUCOS' WHEN 1 THEN 'AETERM' WHEN 3 THEN CASE WHEN t = 3 THEN 'AETERM' ELSE 'AEMUCOS' END
         WHEN 4 THEN 'AETERM' WHEN 5 THEN 'SC.MUCOSAL' WHEN 6 THEN 'CO.COVAL' END AS m_variable
  FROM ev),
rc AS (SELECT *, CASE WHEN m_says IS NOT NULL THEN 'observed' WHEN s = 2 THEN 'not_collected' ELSE 'unresolved' END AS m_avail,
  CASE WHEN off IS NULL THEN 'review' WHEN off BETWEEN 0 AND 30 THEN 'ok' ELSE 'non_case' END AS c_time,
  CASE WHEN m_says IS NULL THEN 'not_ascertainable' WHEN m_method = 'extracted' THEN 'not_ascertainable'
       WHEN m_says = 'present' THEN 'ok' WHEN m_says = 'uncertain' THEN 'review' ELSE 'non_case' END AS c_mod1,
  CASE WHEN m_says IS NULL THEN 'not_ascertainable' WHEN m_method = 'extracted' AND m_conf < 0.7 THEN 'review'
       WHEN m_says = 'present' THEN 'ok' WHEN m_says = 'uncertain' THEN 'review' ELSE 'non_case' END AS c_mod2
  FROM md),
rash AS (SELECT * FROM rc WHERE concept LIKE 'RASH%'),
ex AS (SELECT 'C-' || o_custkey AS subject_id, o_custkey AS k, o_orderkey AS seq,
  CASE WHEN o_orderkey % 41 <> 0 THEN [10.0, 20.0, 50.0][CAST(o_orderkey % 3 AS INT) + 1] END AS dose,
  DATE '2022-01-01' + CAST(o_orderkey % 200 AS INT) AS st,
  CASE WHEN o_orderkey % 10 <> 0 THEN DATE '2022-01-01' + CAST(o_orderkey % 200 + 27 AS INT) END AS en
  FROM orders),
gold AS (SELECT *, in_term OR in_comment AS in_text, in_structured OR in_term OR in_comment AS readable FROM ev),
gv AS (SELECT *, CASE WHEN concept NOT LIKE 'RASH%' OR off_true NOT BETWEEN 0 AND 30 THEN 'non_case' ELSE '?' END AS fixed_,
  CASE WHEN t IN (0, 4) THEN 'case' WHEN t = 1 THEN 'non_case' ELSE 'review' END AS if_read FROM gold),
key AS (SELECT *,
  CASE WHEN fixed_ <> '?' THEN fixed_ WHEN NOT readable THEN 'not_ascertainable' ELSE if_read END AS true_verdict,
  CASE WHEN fixed_ <> '?' THEN fixed_ WHEN NOT in_structured THEN 'not_ascertainable' ELSE if_read END AS gold_structured,
  CASE WHEN fixed_ <> '?' THEN fixed_ WHEN NOT (in_structured OR in_term) THEN 'not_ascertainable' ELSE if_read END AS gold_reported_term,
  CASE WHEN fixed_ <> '?' THEN fixed_ ELSE if_read END AS verdict_if_readable,
  CASE WHEN in_structured OR in_text THEN 'observed' WHEN s = 2 THEN 'not_collected' ELSE 'unresolved' END AS true_availability,
  'T-' || concept || '-' || t || '-' || off_true AS truth_id FROM gv)
"""


def verdict(a: str, b: str) -> str:
    """Worst of two criterion outcomes."""
    return (f"CASE WHEN '{{0}}' IN ({a}, {b}) THEN '{{0}}' WHEN '{{1}}' IN ({a}, {b}) THEN '{{1}}' "
            f"WHEN '{{2}}' IN ({a}, {b}) THEN '{{2}}' ELSE 'case' END").format(
        "not_ascertainable", "review", "non_case")


def judged(name: str, rows: str, first: str, first_name: str, second: str, second_name: str
           ) -> str:
    v = verdict(first, second)
    return (f"{name}_0 AS (SELECT *, {v} AS verdict FROM {rows}), {name} AS (SELECT *, "
            f"CASE WHEN verdict = 'case' THEN NULL WHEN {first} = verdict THEN '{first_name}' "
            f"ELSE '{second_name}' END AS deciding_criterion FROM {name}_0)")


MUC = "mucosal_involvement"
V1 = judged("v1", "rash", "c_mod1", MUC, "c_time", "temporal")
V2 = judged("v2", "rash", "c_mod2", MUC, "c_time", "temporal")
TEXT_MODE = """
term_only AS (SELECT *, CASE WHEN s = 6 THEN 'not_ascertainable' ELSE c_mod2 END AS c_term FROM rash)"""
V_TERM = judged("vt", "term_only", "c_term", MUC, "c_time", "temporal")
DOSE = """
ds AS (SELECT record_id, sum(dose * date_diff('day', st, least(coalesce(en, onset), onset))) AS dose_days,
              count(*) AS n_exposures
       FROM rc JOIN ex ON ex.k = rc.k AND st < onset
       WHERE dose IS NOT NULL AND date_diff('day', st, least(coalesce(en, onset), onset)) > 0 GROUP BY 1)"""
TOX = """
tox_0 AS (SELECT rc.*, dose_days,
    CASE WHEN off IS NULL THEN 'review' WHEN off BETWEEN 0 AND 180 THEN 'ok' ELSE 'non_case' END AS c_win,
    CASE WHEN grade >= 3 THEN 'ok' ELSE 'non_case' END AS c_grade,
    CASE WHEN dose_days IS NULL THEN 'not_ascertainable' WHEN dose_days >= 200 THEN 'ok' ELSE 'non_case' END AS c_dose
  FROM rc LEFT JOIN ds USING (record_id) WHERE concept = 'NEUTROPENIA'),
tox_1 AS (SELECT *, CASE WHEN c_dose = 'not_ascertainable' THEN c_dose WHEN c_win = 'review' THEN 'review'
    WHEN 'non_case' IN (c_win, c_grade, c_dose) THEN 'non_case' ELSE 'case' END AS verdict FROM tox_0),
tox AS (SELECT *, CASE WHEN verdict = 'case' THEN NULL WHEN c_win = verdict THEN 'temporal'
    WHEN c_grade = verdict THEN 'grade' ELSE 'cumulative_exposure' END AS deciding_criterion FROM tox_1)"""
SILVER = """
sv AS (SELECT rid AS source_record_id, profile, struct_says AS structured_assertion, term_says AS extracted_assertion,
    term_site AS extracted_value, CAST(term_conf AS DOUBLE) AS extracted_confidence,
    CASE WHEN term_says IS NULL THEN 'abstained' WHEN term_says = struct_says THEN 'agree' ELSE 'disagree' END AS agreement
  FROM ev WHERE s = 3)"""
COUNTS = ("CAST(count(*) AS BIGINT) AS n_total, count(*) FILTER (verdict = 'case') AS n_case, "
          "count(*) FILTER (verdict = 'non_case') AS n_non_case, "
          "count(*) FILTER (verdict = 'review') AS n_review, "
          "count(*) FILTER (verdict = 'not_ascertainable') AS n_not_ascertainable")
RATES = ("n_case + n_non_case AS n_ascertainable, "
         "round_even((n_case + n_non_case)::DOUBLE / n_total, 4) AS ascertainable_fraction, "
         "CASE WHEN n_case + n_non_case > 0 THEN round_even(n_case::DOUBLE / (n_case + n_non_case), 4) END AS incidence")
CELLS = """
pair AS (SELECT a.study_id, a.profile, key.true_verdict AS gold, a.verdict AS predicted FROM v2 a JOIN key ON key.rid = a.rid)"""
CASE_METRICS = """
m AS (SELECT scope, key, sum(n)::BIGINT AS records,
    coalesce(sum(n) FILTER (gold = 'case' AND predicted = 'case'), 0)::BIGINT AS tp,
    coalesce(sum(n) FILTER (gold <> 'case' AND predicted = 'case'), 0)::BIGINT AS fp,
    coalesce(sum(n) FILTER (gold = 'case' AND predicted <> 'case'), 0)::BIGINT AS fn,
    coalesce(sum(n) FILTER (gold = predicted), 0)::BIGINT AS correct,
    coalesce(sum(n) FILTER (predicted = 'not_ascertainable'), 0)::BIGINT AS nap,
    coalesce(sum(n) FILTER (gold = 'not_ascertainable'), 0)::BIGINT AS nag,
    coalesce(sum(n) FILTER (gold = 'not_ascertainable' AND predicted = gold), 0)::BIGINT AS nab
  FROM cells GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0::DOUBLE END AS ppv,
    CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0::DOUBLE END AS sensitivity FROM m),
cm AS (SELECT scope, key, records, tp, fp, fn, tp + fn AS gold_cases, tp + fp AS predicted_cases, ppv, sensitivity,
    CASE WHEN ppv + sensitivity > 0 THEN 2 * ppv * sensitivity / (ppv + sensitivity) ELSE 0.0::DOUBLE END AS f1,
    correct::DOUBLE / records AS accuracy, nap AS not_ascertainable_predicted, nag AS not_ascertainable_gold,
    nap::DOUBLE / records AS not_ascertainable_rate,
    CASE WHEN nag > 0 THEN nab::DOUBLE / nag ELSE 0.0::DOUBLE END AS not_ascertainable_agreement FROM r)"""
PHENO = """
cells AS (SELECT 'pooled' AS scope, 'ALL' AS key, gold, predicted, count(*) AS n FROM pair GROUP BY ALL
  UNION ALL SELECT 'study', study_id, gold, predicted, count(*) FROM pair GROUP BY ALL
  UNION ALL SELECT 'profile', profile, gold, predicted, count(*) FROM pair GROUP BY ALL)"""
HOLD = """
cells AS (SELECT 'side' AS scope, CASE WHEN profile IN ('P_both','P_structured','P_text') THEN 'development' ELSE 'held_out' END AS key,
    gold, predicted, count(*) AS n FROM pair GROUP BY ALL
  UNION ALL SELECT 'profile', profile, gold, predicted, count(*) FROM pair GROUP BY ALL)"""
ASSERT = """
ar AS (SELECT rc.record_id, rc.study_id, rc.subject_id, rc.rid, rc.profile,
    coalesce(rc.struct_says, CASE WHEN rc.in_term OR rc.in_comment THEN rc.said END, 'silent') AS expected,
    coalesce(rc.m_says, 'silent') AS actual, key.true_availability AS ea, rc.m_avail AS aa
  FROM rc JOIN key USING (record_id))"""
RENDER = """
rn AS (SELECT key.truth_id, v2.profile, max_by(v2.verdict, [v2.subject_id, v2.rid]) AS verdict,
    max_by(key.readable, [v2.subject_id, v2.rid]) AS readable,
    max_by(key.verdict_if_readable, [v2.subject_id, v2.rid]) AS reference
  FROM v2 JOIN key ON key.rid = v2.rid WHERE key.ln <= 4 GROUP BY 1, 2),
ag AS (SELECT truth_id, count(*) AS np, count(DISTINCT verdict) = 1 AS agrees, count(*) FILTER (readable) AS nr,
    count(DISTINCT verdict) FILTER (readable) = 1 AS ra, min_by(reference, profile) AS reference,
    string_agg(profile || '=' || verdict, ';' ORDER BY profile || '=' || verdict) AS verdicts
  FROM rn GROUP BY 1 HAVING count(*) >= 2)"""
ABLATION = """
ab AS (SELECT v1r.record_id, v1r.structured, vt.verdict AS reported_term, v2.verdict AS comments,
    key.gold_structured, key.gold_reported_term, key.true_verdict AS gold_comments
  FROM v1r JOIN vt USING (record_id) JOIN v2 USING (record_id) JOIN key USING (record_id))"""
# with no prose, every definition sees what the structured one sees
V_STRUCT = "v1r AS (SELECT record_id, verdict AS structured FROM v1)"
STAGES = """
st AS (SELECT 'structured' AS stage, structured AS v, gold_structured AS g FROM ab
  UNION ALL SELECT 'reported_term', reported_term, gold_reported_term FROM ab
  UNION ALL SELECT 'comments', comments, gold_comments FROM ab),
sm AS (SELECT stage, count(*) AS n_evaluated, count(*) FILTER (v IN ('case', 'non_case')) AS n_ascertained,
    count(*) FILTER (v = 'case') AS n_case, count(*) FILTER (v = 'case' AND g = 'case') AS n_case_correct,
    count(*) FILTER (v = 'case' AND g <> 'case') AS n_case_incorrect, count(*) FILTER (g = 'case') AS gold_cases
  FROM st GROUP BY 1)"""
STEPS = """
sp AS (SELECT 'structured' AS from_stage, 'reported_term' AS to_stage, structured AS lo, reported_term AS up, gold_structured AS gl, gold_reported_term AS gu FROM ab
  UNION ALL SELECT 'reported_term', 'comments', reported_term, comments, gold_reported_term, gold_comments FROM ab),
ic AS (SELECT from_stage, to_stage, count(*) FILTER (up = 'case' AND lo <> 'case') AS added_cases,
    count(*) FILTER (up = 'case' AND lo <> 'case' AND gu = 'case') AS added_correct,
    count(*) FILTER (lo = 'case' AND gl = 'case') AS base_correct,
    count(*) FILTER (up IN ('case','non_case') AND lo NOT IN ('case','non_case')) AS added_ascertained FROM sp GROUP BY 1, 2),
id AS (SELECT *, added_cases - added_correct AS added_incorrect,
    CASE WHEN added_cases > 0 THEN round_even(added_correct::DOUBLE / added_cases, 4) ELSE 0.0::DOUBLE END AS precision_on_added,
    CASE WHEN base_correct > 0 THEN round_even(added_correct::DOUBLE / base_correct, 4)
         WHEN added_correct > 0 THEN 'Infinity'::DOUBLE ELSE 0.0::DOUBLE END AS relative_gain FROM ic),
im AS (SELECT *, added_cases > 0 AND precision_on_added >= 0.8 AND added_correct >= 10 AND relative_gain >= 0.15 AS material FROM id)"""
DECISION = ("CASE WHEN material THEN 'ADOPT' WHEN added_cases = 0 THEN 'DO NOT ADOPT: no verdict changed' "
            "WHEN precision_on_added < 0.8 THEN 'DO NOT ADOPT AS IT STANDS: too many additions are wrong' "
            "ELSE 'DO NOT ADOPT: gain below the declared floor' END")
MENTIONS = """
mn0 AS (SELECT 'AE:' || rid || ':AETERM' AS doc_id, study_id, rid, 'reported_term' AS source_kind, aeterm AS txt, phrase, w AS t, sk,
    term_says AS a, term_site AS v, term_conf AS c, said,
    stated AS surface FROM ev WHERE term_says IS NOT NULL
  UNION ALL SELECT rid || '-CO', study_id, rid, 'comment', '--- derived from order rows, for tests only ---' || chr(10) || remark, phrase, t, sk,
    comment_says, comment_site, comment_conf, said,
    stated FROM ev WHERE comment_says IS NOT NULL),
mn AS (SELECT *, doc_id || ':' || (instr(txt, surface) - 1) || ':' || a AS mention_id FROM mn0)"""
DOCS = """
docs AS (SELECT rid || '-CO' AS doc_id, rid, '--- derived from order rows, for tests only ---' || chr(10) || remark AS full_text
  FROM ev WHERE in_comment)"""
EPISODES = """
ep0 AS (SELECT record_id, rid, study_id, subject_id, concept, onset, coalesce(ends, onset) AS closes FROM rc),
ep1 AS (SELECT *, CASE WHEN onset IS NOT NULL THEN date_diff('day', lag(closes) OVER w, onset) END AS gap0,
    row_number() OVER w AS rn FROM ep0
    WINDOW w AS (PARTITION BY study_id, subject_id, concept ORDER BY onset NULLS LAST, record_id)),
ep2 AS (SELECT *, CASE WHEN gap0 <= 3 THEN 0 ELSE 1 END AS opens FROM ep1),
mem AS (SELECT *, sum(opens) OVER (PARTITION BY study_id, subject_id, concept ORDER BY rn) AS ordinal,
    CASE WHEN opens = 0 THEN CAST(gap0 AS INT) END AS gap FROM ep2),
epi AS (SELECT study_id, subject_id, concept, ordinal, count(*) AS n_records, min(onset) AS first_onset, max(onset) AS last_onset,
    max_by(gap, rn) AS last_gap FROM mem GROUP BY 1, 2, 3, 4),
num AS (SELECT *, row_number() OVER (ORDER BY study_id, subject_id, concept, ordinal) AS episode_number FROM epi),
named AS (SELECT *, concat_ws('::', study_id, subject_id, concept, CASE WHEN episode_number < 10 THEN '0' || episode_number ELSE episode_number::VARCHAR END) AS episode_id,
    CASE WHEN n_records > 1 THEN 'gap_within_tolerance' ELSE 'single_record' END AS rule,
    n_records > 1 AND coalesce(last_gap, 0) > 0 AS review_required FROM num)"""
CHANGES = """
dx AS (SELECT subject_id, st AS day, seq, dose FROM ex WHERE dose IS NOT NULL),
dw AS (SELECT *, max(dose) OVER (PARTITION BY subject_id ORDER BY day, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top,
    lag(dose) OVER (PARTITION BY subject_id ORDER BY day, seq) AS prev FROM dx)"""
SEVERITY = ("CASE WHEN sk % 31 = 0 THEN NULL ELSE ['mild','moderate','severe'][CAST((grade - 1) % 3 AS INT) + 1] END")
RELATED = ("['not_related','unlikely','possible','possible','probable',NULL][CAST(sk % 6 AS INT) + 1]")
ACTION = ("['dose_not_changed','dose_reduced','drug_interrupted','drug_withdrawn','unknown'][CAST(pk % 5 AS INT) + 1]")
OUTCOME = ("['recovered','recovered','recovering','not_recovered','not_recovered'][CAST(pk % 5 AS INT) + 1]")
OUTCOME_CODE = ("CASE WHEN version = 'D-21.0' THEN 'unchanged' WHEN concept = 'RASH_MACULOPAPULAR' THEN 'flagged_for_review' "
                "WHEN concept = 'RASH_ERYTHEMATOUS' THEN 'remapped_mechanically' ELSE 'unchanged' END")
EFFECTIVE = ("CASE WHEN version <> 'D-21.0' AND concept = 'RASH_ERYTHEMATOUS' THEN 'Erythematous rash' ELSE code END")

ORACLE: dict[str, str] = {}


def twin(name: str, select: str, *parts: str, base: str = EVENTS) -> None:
    ctes = ",\n".join(p.strip() for p in (base, *parts) if p)
    ORACLE[name] = (f"WITH {ctes}\n" if ctes else "") + select


def prf(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> str:
    p = f"CASE WHEN {tp} + {fp} > 0 THEN {tp}::DOUBLE / ({tp} + {fp}) ELSE 0.0::DOUBLE END"
    r = f"CASE WHEN {tp} + {fn} > 0 THEN {tp}::DOUBLE / ({tp} + {fn}) ELSE 0.0::DOUBLE END"
    return (f"{tp} AS tp, {fp} AS fp, {fn} AS fn, {tp} + {fn} AS support, {tp} + {fp} AS predicted, {p} AS precision, "
            f"{r} AS recall, CASE WHEN {tp} > 0 THEN 2 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0.0::DOUBLE END AS f1")


# -- sources ---------------------------------------------------------------------
twin("domain_table_scan", """SELECT study_id, count(*) AS n_rows, count(grade) AS n_grades, sum(grade)::BIGINT AS grade_sum,
  count(*) FILTER (sk % 31 = 0) AS n_blank_severity FROM ev GROUP BY 1""")
twin("document_full_text", """SELECT doc_id, rid AS source_record_id, 'comment' AS kind, length(full_text)::INT AS n_chars,
  md5(full_text) AS digest FROM docs""", DOCS)
twin("answer_key_counts", "SELECT study_id, true_availability, true_verdict, count(*) AS n FROM key GROUP BY 1, 2, 3")
twin("truth_renderings", """SELECT truth_id, concept, off_true AS onset_offset_days, count(*) AS n_renderings,
  array_to_string(list_sort(list_distinct(list(study_id))), ',') AS rendered_in FROM key GROUP BY 1, 2, 3""")
twin("snapshot_fingerprint", """, r AS (SELECT 'ex' AS input, concat_ws(chr(31), coalesce(CASE WHEN dose IS NOT NULL THEN CAST(dose AS INT)::VARCHAR END, chr(30)), 'mg',
    coalesce(en::VARCHAR, chr(30)), seq::VARCHAR, st::VARCHAR, 'STUDY DRUG', 'STUDY-' || substr('ABCDEFG', CAST(k % 7 AS INT) + 1, 1), 'Y', subject_id) AS row_text FROM ex
  UNION ALL SELECT 'sc', concat_ws(chr(31), 'AESPID', rid, CASE said WHEN 'present' THEN 'Y' WHEN 'absent' THEN 'N' ELSE 'U' END, 'Mucosal involvement', 'MUCOSAL',
    study_id, 'Y', subject_id) FROM ev WHERE s = 5 AND t <> 3
  UNION ALL SELECT 'dm', concat_ws(chr(31), (21 + c_custkey % 62)::VARCHAR, c_mktsegment, coalesce(n_name, chr(30)),
    ['P_structured','P_text','P_absent','P_both','P_negated','P_version','P_concept_variant'][CAST(c_custkey % 7 AS INT) + 1], chr(30),
    CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END, 'STUDY-' || substr('ABCDEFG', CAST(c_custkey % 7 AS INT) + 1, 1), 'Y', 'C-' || c_custkey)
    FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT 'ae', concat_ws(chr(31), ['none','dose reduced','drug-interrupted','drug withdrawn','unknown'][CAST(pk % 5 AS INT) + 1], code, version,
    coalesce(CASE WHEN s = 5 THEN strftime(ends, '%d-%b-%Y') ELSE ends::VARCHAR END, chr(30)), grade::VARCHAR,
    coalesce(CASE WHEN s IN (0, 3) THEN CASE WHEN t IN (0, 4) THEN 'Y' WHEN t = 1 THEN 'N' WHEN t = 2 THEN 'U' END END, chr(30)),
    ['recovered','resolved','recovering','ongoing','not-recovered'][CAST(pk % 5 AS INT) + 1],
    ['not related','unlikely','possible','Possibly related','probable','no idea'][CAST(sk % 6 AS INT) + 1],
    coalesce(CASE WHEN pk % 7 = 0 THEN ['hospitalisation','other_medically_important','hospitalisation | disability'][CAST(sk % 3 AS INT) + 1] END, chr(30)),
    ln::VARCHAR, CASE WHEN pk % 7 = 0 THEN 'Y' ELSE 'N' END,
    coalesce(CASE WHEN sk % 31 <> 0 THEN ['mild','Moderate','grade 3'][(grade - 1) % 3 + 1] END, chr(30)), rid,
    coalesce(CASE WHEN sk % 23 = 0 THEN NULL WHEN sk % 29 = 0 THEN strftime(onset_true, '%Y-%m')
      WHEN s = 5 THEN strftime(onset_true, '%d-%b-%Y') ELSE onset_true::VARCHAR END, chr(30)), aeterm, study_id, 'Y', subject_id) FROM ev
  UNION ALL SELECT 'co', concat_ws(chr(31), '1', remark, rid || '-CO', 'AESPID', rid, study_id, 'Y', subject_id) FROM ev WHERE in_comment
  UNION ALL SELECT 'documents', concat_ws(chr(31), rid || '-CO', '--- derived from order rows, for tests only ---', 'comment', rid, study_id, subject_id, remark)
    FROM ev WHERE in_comment),
h AS (SELECT input, sha256(row_text) AS d FROM r)
SELECT input, count(*) AS n_rows, CAST(sum(CAST(('0x' || substr(d, 1, 15)) AS BIGINT)) AS VARCHAR) AS row_sum,
  bit_xor(CAST(('0x' || substr(d, 16, 15)) AS BIGINT)) AS row_xor FROM h GROUP BY 1""")
ORACLE["snapshot_fingerprint"] = ORACLE["snapshot_fingerprint"].replace("\n, r AS", ",\nr AS", 1)
twin("subject_cohort", """SELECT 'C-' || c_custkey AS subject_id, 'STUDY-' || substr('ABCDEFG', CAST(c_custkey % 7 AS INT) + 1, 1) AS study_id FROM customer
  UNION SELECT 'C-' || o_custkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer) THEN 'STUDY-' || substr('ABCDEFG', CAST(o_custkey % 7 AS INT) + 1, 1) ELSE '' END FROM orders""", base="")
twin("linked_row_counts", """SELECT study_id, rid AS source_record_id, CASE WHEN s = 5 AND t <> 3 THEN 1 ELSE 0 END::BIGINT AS n_findings,
  CASE WHEN in_comment THEN 1 ELSE 0 END::BIGINT AS n_comments, CASE WHEN in_comment THEN 1 ELSE 0 END::BIGINT AS n_documents FROM ev""")
twin("exposures_by_subject", "SELECT subject_id, count(*) AS n_exposures, min(seq) AS first_seq, max(seq) AS last_seq FROM ex GROUP BY 1")
twin("snapshot_summary", """SELECT (SELECT count(DISTINCT c_custkey % 7) FROM customer) AS studies,
  (SELECT count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)) AS subjects,
  (SELECT count(*) FROM ev) AS ae_records, (SELECT count(*) FROM ev WHERE in_comment) AS documents,
  (SELECT count(*) FROM ev WHERE s = 5 AND t <> 3) AS linked_form_records, (SELECT count(*) FROM ev WHERE in_comment) AS comment_records,
  (SELECT count(*) FROM orders) AS ex_records""")
twin("corpus_summary", """SELECT (SELECT count(DISTINCT c_custkey % 7) FROM customer) AS studies,
  (SELECT count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)) AS subjects,
  (SELECT count(*) FROM ev) AS ae_records, (SELECT count(*) FROM ev WHERE in_comment) AS documents,
  'D-21.0' AS dictionary_target, 'rules' AS backend""")

# -- normalization -----------------------------------------------------------------
twin("concept_lookup", "SELECT code, version, concept AS concept_id, count(*) AS n FROM ev GROUP BY 1, 2, 3")
twin("code_reconciliation", f"""SELECT study_id, code, {OUTCOME_CODE} AS outcome, {EFFECTIVE} AS effective_code, count(*) AS n
  FROM ev GROUP BY 1, 2, 3, 4""")
twin("codelist_readings", f"""SELECT codelist, value, CASE WHEN value IS NULL THEN 'unresolved' ELSE 'observed' END AS availability, count(*) AS n FROM (
  SELECT 'severity' AS codelist, {SEVERITY} AS value FROM ev UNION ALL SELECT 'relatedness', {RELATED} FROM ev
  UNION ALL SELECT 'action', {ACTION} FROM ev UNION ALL SELECT 'outcome', {OUTCOME} FROM ev) GROUP BY 1, 2, 3""")
twin("three_state_readings", """SELECT study_id, NOT (s IN (0, 3) AND t <> 3) AS blank, CASE WHEN s IN (0, 3) THEN said END AS assertion,
  pk % 7 = 0 AS serious, count(*) AS n FROM ev GROUP BY 1, 2, 3, 4""")
twin("grade_readings", "SELECT record_id, grade FROM ev")
twin("record_dates", """SELECT record_id, onset::VARCHAR AS onset, ends::VARCHAR AS end_day,
  CASE WHEN onset IS NULL THEN 'unresolved' ELSE 'observed' END AS onset_availability, sk % 23 <> 0 AND sk % 29 = 0 AS onset_noted FROM ev""")
twin("exposure_dates", "SELECT subject_id, seq::VARCHAR AS seq, st::VARCHAR AS start_day, en::VARCHAR AS end_day FROM ex")
twin("seriousness_criteria", """, c AS (SELECT unnest(['death','life_threatening','hospitalisation','disability','congenital_anomaly','other_medically_important']) AS criterion),
x AS (SELECT study_id, criterion, pk % 7 = 0 AS serious, CASE CAST(sk % 3 AS INT) WHEN 0 THEN criterion = 'hospitalisation' WHEN 1 THEN criterion = 'other_medically_important'
    ELSE criterion IN ('hospitalisation', 'disability') END AS hit FROM ev, c)
SELECT study_id, criterion, CASE WHEN serious THEN 'observed' ELSE 'not_applicable' END AS availability,
  CASE WHEN serious AND hit THEN 'present' WHEN serious THEN 'absent' END AS assertion, count(*) AS n FROM x GROUP BY 1, 2, 3, 4""")
ORACLE["seriousness_criteria"] = ORACLE["seriousness_criteria"].replace("\n, c AS", ",\nc AS", 1)
twin("structured_modifiers", """SELECT record_id, struct_says AS assertion,
  CASE WHEN struct_says IS NOT NULL THEN 'observed' WHEN s = 2 THEN 'not_collected' ELSE 'unresolved' END AS availability,
  CASE m_variable WHEN 'AEMUCOS' THEN 'structured_standard' WHEN 'AETERM' THEN 'reported_term' WHEN 'SC.MUCOSAL' THEN 'linked_form'
    WHEN 'CO.COVAL' THEN 'comment' END AS source, m_variable AS source_variable, CASE WHEN struct_says IS NOT NULL THEN 'direct' END AS method FROM rc""")
twin("exposure_offsets", "SELECT record_id, off AS offset_days, CASE WHEN off IS NULL THEN 'unresolved' ELSE 'observed' END AS availability FROM ev")
twin("canonical_records", f"""SELECT record_id, study_id, subject_id, profile, concept AS concept_id, aeterm AS reported_term, {SEVERITY} AS severity, grade,
  pk % 7 = 0 AS serious, {ACTION} AS action, {OUTCOME} AS outcome, CASE WHEN s = 5 AND t <> 3 THEN 'MUCOSAL' ELSE '' END AS linked_forms FROM ev""")
twin("undeclared_studies", "SELECT study_id, count(*) AS n_rows FROM ev WHERE s NOT IN (0, 1, 3) GROUP BY 1")
twin("provenance_faults", """SELECT 'grade' AS name, 'derived_outside_cross_domain' AS rule, count(*) AS n FROM ev
  UNION ALL SELECT 'onset', 'observed_without_span', count(*) FROM ev WHERE onset IS NOT NULL""")
twin("provenance_audit", "SELECT count(*) * 18 AS n_attributes, 0::BIGINT AS n_broken FROM ev")
LONG = f"""
la AS (SELECT 'reported_term' AS name, 'observed' AS availability, 'present' AS assertion, 'direct' AS method FROM ev
  UNION ALL SELECT 'onset', CASE WHEN onset IS NULL THEN 'unresolved' ELSE 'observed' END, CASE WHEN onset IS NOT NULL THEN 'present' END, CASE WHEN onset IS NOT NULL THEN 'direct' END FROM ev
  UNION ALL SELECT 'end', CASE WHEN ends IS NULL THEN 'unresolved' ELSE 'observed' END, CASE WHEN ends IS NOT NULL THEN 'present' END, CASE WHEN ends IS NOT NULL THEN 'direct' END FROM ev
  UNION ALL SELECT 'exposure_relation', CASE WHEN off IS NULL THEN 'unresolved' ELSE 'observed' END, CASE WHEN off IS NOT NULL THEN 'present' END, CASE WHEN off IS NOT NULL THEN 'derived' END FROM ev
  UNION ALL SELECT 'severity', CASE WHEN v IS NULL THEN 'unresolved' ELSE 'observed' END, CASE WHEN v IS NOT NULL THEN 'present' END, CASE WHEN v IS NOT NULL THEN 'direct' END FROM (SELECT {SEVERITY} AS v FROM ev)
  UNION ALL SELECT 'grade', 'observed', 'present', 'direct' FROM ev
  UNION ALL SELECT 'seriousness', 'observed', CASE WHEN pk % 7 = 0 THEN 'present' ELSE 'absent' END, 'direct' FROM ev
  UNION ALL SELECT 'relatedness', CASE WHEN v IS NULL THEN 'unresolved' ELSE 'observed' END, CASE WHEN v IS NOT NULL THEN 'present' END, CASE WHEN v IS NOT NULL THEN 'direct' END FROM (SELECT {RELATED} AS v FROM ev)
  UNION ALL SELECT 'action', 'observed', 'present', 'direct' FROM ev
  UNION ALL SELECT 'outcome', 'observed', 'present', 'direct' FROM ev
  UNION ALL SELECT '{MUC}', m_avail, m_says, m_method FROM rc
  UNION ALL SELECT 'photosensitivity', 'not_collected', NULL, NULL FROM ev
  UNION ALL SELECT 'seriousness_criteria.' || criterion, CASE WHEN pk % 7 = 0 THEN 'observed' ELSE 'not_applicable' END,
    CASE WHEN pk % 7 <> 0 THEN NULL WHEN CASE CAST(sk % 3 AS INT) WHEN 0 THEN criterion = 'hospitalisation' WHEN 1 THEN criterion = 'other_medically_important'
      ELSE criterion IN ('hospitalisation', 'disability') END THEN 'present' ELSE 'absent' END, CASE WHEN pk % 7 = 0 THEN 'direct' END
    FROM ev, (SELECT unnest(['death','life_threatening','hospitalisation','disability','congenital_anomaly','other_medically_important']) AS criterion))"""
twin("attribute_counts", "SELECT name, availability, assertion, method, count(*) AS n FROM la GROUP BY 1, 2, 3, 4", LONG)
twin("attribute_predicates", f"""SELECT name, count(*) FILTER (availability = 'observed') AS n_observed, count(*) FILTER (assertion = 'present') AS n_present,
  count(*) FILTER (assertion = 'absent') AS n_negative, count(*) FILTER (availability <> 'observed') AS n_silent,
  count(*) FILTER (method = 'extracted') AS n_from_text, count(*) FILTER (availability = 'observed' AND method <> 'extracted') AS n_structured
  FROM la GROUP BY 1""", LONG)
twin("route_descriptions", """SELECT study_id, CASE WHEN m_says IS NULL THEN m_avail ELSE m_says || CASE WHEN m_value IS NULL THEN '' ELSE '=' || m_value END
  || ' via ' || m_method || ' from ' || m_variable END AS route, count(*) AS n FROM rc GROUP BY 1, 2""")
# one pointer per observed attribute; the criteria share a single cell
twin("evidence_spans", f"""SELECT record_id, (5 + (onset IS NOT NULL)::INT + (ends IS NOT NULL)::INT + (off IS NOT NULL)::INT
  + ({SEVERITY} IS NOT NULL)::INT + ({RELATED} IS NOT NULL)::INT + (m_says IS NOT NULL)::INT + (pk % 7 = 0)::INT)::BIGINT AS n FROM rc""")
twin("surface_values", """SELECT phrase AS surface, CASE WHEN v IS NULL THEN 'UNSPECIFIED' ELSE v END AS catalogue_value, count(*) AS n
  FROM mn WHERE t = 0 GROUP BY 1, 2""", MENTIONS)

# -- filters ---------------------------------------------------------------------------
FLAT2 = "fl AS (SELECT rc.*, v2.verdict AS vd FROM rc LEFT JOIN v2 USING (record_id))"
twin("cohort_retrieval", """SELECT record_id, study_id, concept, m_says AS assertion, m_value AS value, m_method AS method, m_conf::DOUBLE AS confidence,
  off AS exposure_offset_days, vd AS verdict, CASE WHEN vd IS NOT NULL THEN 'cutaneous_mucosal.v2' END AS definition FROM fl
  WHERE concept IN ('RASH','RASH_ERYTHEMATOUS','RASH_MACULOPAPULAR','PRURITUS') AND m_says IN ('present','absent') AND m_method IN ('direct','extracted')
    AND off BETWEEN 0 AND 30 ORDER BY record_id LIMIT 50""", V2, FLAT2)
twin("evidence_search", """SELECT record_id, m_says AS assertion, m_variable AS source_variable, m_conf::DOUBLE AS confidence FROM rc
  WHERE m_says = 'absent' AND m_method = 'extracted'""")
twin("record_listing", """SELECT record_id, aeterm AS reported_term, code, concept, m_says AS modifier_assertion, m_value AS modifier_value,
  m_method AS modifier_method, off AS exposure_offset_days FROM rc WHERE s = 3 AND m_says = 'uncertain'
  ORDER BY study_id, subject_id, rid LIMIT 25""")
twin("record_listing_all", """SELECT record_id, aeterm AS reported_term, code, concept, m_says AS modifier_assertion, m_value AS modifier_value,
  m_method AS modifier_method, off AS exposure_offset_days FROM rc WHERE s = 3 AND m_says = 'uncertain'""")
twin("record_listing_total", "SELECT count(*) AS n FROM rc WHERE s = 4 AND m_method = 'extracted'")
twin("study_restriction", "SELECT study_id, verdict, count(*) AS n FROM v2 WHERE s IN (0, 1) GROUP BY 1, 2", V2)
twin("concept_group_scope", "SELECT study_id, concept AS concept_id, count(*) AS n FROM ev WHERE concept LIKE 'RASH%' OR concept = 'PRURITUS' GROUP BY 1, 2")
twin("supportability_screen", """SELECT study_id, profile, ['supported','supported_via_extraction','cannot_ascertain','supported','supported_via_extraction','supported','supported_via_extraction'][s + 1] AS status,
  ['structured_qualifier','reported_term','none','structured_qualifier,reported_term','reported_term','linked_form','comment'][s + 1] AS homes,
  count(*) AS n_events FROM ev GROUP BY ALL""")
twin("both_routes", "SELECT study_id, profile, count(*) AS n FROM ev WHERE s = 3 GROUP BY 1, 2")
twin("askable_records", """SELECT study_id, count(*) FILTER (struct_says IS NULL AND s IN (1, 3, 4, 6)) AS n_askable,
  count(*) FILTER (struct_says IS NULL) AS n_open FROM rc GROUP BY 1""")
twin("boundary_audit", f"""SELECT record_id, '{MUC}' AS modifier, 'AEMUCOS' AS source_variable, 'structured_source' AS reason
  FROM ev WHERE s = 3 AND struct_says IS NOT NULL AND ln % 2 = 0""")
twin("request_audit", """SELECT * FROM (SELECT CASE WHEN concept = 'NAUSEA' THEN 'deterministic_mechanism' WHEN struct_says IS NOT NULL THEN 'settled'
  WHEN s IN (0, 5) THEN 'structured_source' END AS reason, count(*) AS n FROM rc GROUP BY 1) WHERE reason IS NOT NULL""")
twin("coded_field_audit", "SELECT 'code' AS field, count(*) AS n FROM ev WHERE concept = 'NAUSEA'")
twin("term_only_verdicts", "SELECT study_id, verdict, count(*) AS n FROM vt GROUP BY 1, 2", TEXT_MODE, V_TERM)

# -- prose -----------------------------------------------------------------------------
twin("sentence_counts", r"""WITH m AS (SELECT doc_id, regexp_replace(text, '([.?!])[ \t\r\f\v]+(["''(]?[A-Z0-9])', '\1' || chr(10) || '\2', 'g') AS x FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(string_split(x, chr(10)), lambda y: trim(y, E' \t\r\f\v')), lambda y: length(y) > 0) AS s FROM m)
SELECT doc_id, len(s)::BIGINT AS n_sentences, coalesce(list_sum(list_transform(s, lambda y: length(y))), 0)::BIGINT AS n_chars FROM p""", base="")
twin("word_counts", r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z][A-Za-z''’-]*|\d+(\.\d+)?'))::BIGINT AS n_words FROM documents""", base="")
WORD_END = r"($|[^\p{L}\p{M}\p{N}_])"
FOLDED = "lower(text)"
for ending, folded in (("isation", "ization"), ("ise", "ize"), ("ised", "ized"), ("ising", "izing")):
    FOLDED = f"regexp_replace({FOLDED}, '{ending}{WORD_END}', '{folded}\\1', 'g')"
twin("folded_spelling", f"""SELECT doc_id, md5(replace(replace({FOLDED}, 'ae', 'e'), 'oe', 'e')) AS digest FROM documents""", base="")
twin("event_mentions", """SELECT rid AS source_record_id, 1::BIGINT AS n_events, 0 AS first_start, length(event)::INT AS first_end,
  concept AS first_concept FROM ev""")
twin("term_assertions", """SELECT rid AS source_record_id, term_says AS assertion, term_site AS value, term_conf::DOUBLE AS confidence,
  CASE WHEN term_says IS NULL THEN NULL WHEN w = 1 THEN 'negated' WHEN w = 2 THEN 'uncertain' WHEN sk % 3 = 1 THEN 'same_sentence' ELSE 'direct_phrase' END AS rule FROM ev""")
twin("mention_table", """SELECT mention_id, doc_id, study_id, source_kind, a AS assertion, v AS value, surface, c::DOUBLE AS confidence FROM mn""", MENTIONS)
twin("enriched_modifiers", """SELECT record_id, m_says AS assertion, m_avail AS availability, m_value AS value, m_method AS method, m_variable AS source_variable,
  m_conf::DOUBLE AS confidence, CASE WHEN m_method = 'extracted' THEN 'unresolved' END AS prior_availability FROM rc""")
twin("extraction_statistics", """, asked AS (SELECT s, t, m_says, m_method, in_comment, 1 + (in_comment)::INT AS tries FROM rc WHERE struct_says IS NULL AND s IN (1, 3, 4, 6))
SELECT sum(tries)::BIGINT AS requests, count(*) FILTER (m_method = 'extracted') AS recovered, (sum(tries) - count(*) FILTER (m_method = 'extracted'))::BIGINT AS abstained,
  count(*) FILTER (m_says = 'present') AS recovered_present, count(*) FILTER (m_says = 'absent') AS recovered_absent, count(*) FILTER (m_says = 'uncertain') AS recovered_uncertain,
  (sum(tries) - count(*) FILTER (m_method = 'extracted'))::DOUBLE / sum(tries)::DOUBLE AS abstention_rate FROM asked""")
ORACLE["extraction_statistics"] = ORACLE["extraction_statistics"].replace("\n, asked AS", ",\nasked AS", 1)
twin("answer_validation", """SELECT rid AS doc_id, CASE WHEN ln IN (1, 3, 6) THEN 'discarded' WHEN ln = 2 THEN 'abstained' ELSE 'accepted' END AS outcome,
  CASE WHEN ln NOT IN (1, 2, 3, 6) THEN 'present' END AS assertion, CASE WHEN ln IN (4, 5) THEN 'ORAL' END AS value,
  CASE WHEN ln NOT IN (1, 2, 3, 6) THEN length(aeterm)::INT END AS "end",
  CASE WHEN ln = 7 THEN 0.66::DOUBLE WHEN ln NOT IN (1, 2, 3, 6) THEN 0.8::DOUBLE END AS confidence FROM ev""")

# -- evaluation --------------------------------------------------------------------------
twin("structured_incidence", f"SELECT *, {RATES} FROM (SELECT study_id, profile, {COUNTS} FROM v1 GROUP BY 1, 2)", V1)
twin("structured_verdicts", "SELECT record_id, verdict, deciding_criterion FROM v1", V1)
twin("narrative_verdicts", "SELECT record_id, verdict, deciding_criterion FROM v2", V2)
twin("graded_toxicity_verdicts", "SELECT record_id, verdict, deciding_criterion FROM tox", DOSE, TOX)
twin("criterion_findings", f"""SELECT name, satisfied, verdict, method, source_variable, count(*) AS n FROM (
  SELECT 'concept' AS name, true AS satisfied, 'case' AS verdict, 'direct' AS method, 'AEDECOD' AS source_variable FROM rash
  UNION ALL SELECT '{MUC}', c_mod2 = 'ok', CASE WHEN c_mod2 = 'ok' THEN 'case' ELSE c_mod2 END, m_method, m_variable FROM rash
  UNION ALL SELECT 'temporal', c_time = 'ok', CASE WHEN c_time = 'ok' THEN 'case' ELSE c_time END, CASE WHEN off IS NOT NULL THEN 'derived' END, 'AE+EX' FROM rash)
  GROUP BY ALL""")
twin("toxicity_findings", """SELECT name, satisfied, verdict, availability, count(*) AS n FROM (
  SELECT 'concept' AS name, true AS satisfied, 'case' AS verdict, 'observed' AS availability FROM tox
  UNION ALL SELECT 'temporal', c_win = 'ok', CASE WHEN c_win = 'ok' THEN 'case' ELSE c_win END, CASE WHEN off IS NULL THEN 'unresolved' ELSE 'observed' END FROM tox
  UNION ALL SELECT 'grade', c_grade = 'ok', CASE WHEN c_grade = 'ok' THEN 'case' ELSE c_grade END, 'observed' FROM tox
  UNION ALL SELECT 'cumulative_exposure', c_dose = 'ok', CASE WHEN c_dose = 'ok' THEN 'case' ELSE c_dose END,
    CASE WHEN dose_days IS NULL THEN 'unresolved' ELSE 'observed' END FROM tox) GROUP BY ALL""", DOSE, TOX)
twin("text_dependent_cases", "SELECT record_id, study_id FROM v2 WHERE verdict = 'case' AND m_method = 'extracted'", V2)
twin("cases_by_subject", """SELECT study_id, subject_id, count(*) AS n_cases, min(record_id) AS first_record, max(record_id) AS last_record
  FROM v2 WHERE verdict = 'case' GROUP BY 1, 2""", V2)

# -- aggregation ---------------------------------------------------------------------------
twin("narrative_denominators", f"""SELECT *, {RATES} FROM (SELECT study_id, profile, {COUNTS} FROM v2 GROUP BY 1, 2
  UNION ALL SELECT 'ALL', '', {COUNTS} FROM v2)""", V2)
twin("verdict_counts", "SELECT verdict, count(*) AS n FROM v2 GROUP BY 1", V2)
ROUTES = """
rt AS (SELECT 'source_variable' AS route, unnest(['AEDECOD', m_variable, 'AE+EX']) AS key FROM v2 WHERE verdict = 'case'
  UNION ALL SELECT 'method', unnest(['direct', m_method, 'derived']) FROM v2 WHERE verdict = 'case')"""
twin("evidence_routes", "SELECT route, key, count(*) AS n FROM rt GROUP BY 1, 2", V2, ROUTES)
twin("cohort_report", """SELECT counter, scope, key, count(*) AS n FROM (SELECT 'verdict' AS counter, 'ALL' AS scope, verdict AS key FROM v2
  UNION ALL SELECT 'study_verdict', study_id, verdict FROM v2 UNION ALL SELECT route, 'ALL', key FROM rt) GROUP BY 1, 2, 3""", V2, ROUTES)
twin("case_export", """SELECT subject_id, study_id, record_id, CASE verdict WHEN 'case' THEN 1 WHEN 'non_case' THEN 0 END AS status, verdict,
  'cutaneous_mucosal.v2' AS definition, array_to_string(list_sort(list_distinct(list_filter(['direct', m_method, CASE WHEN off IS NOT NULL THEN 'derived' END], lambda x: x IS NOT NULL))), ',') AS evidence_route FROM v2""", V2)
twin("record_counters", f"""SELECT counter, scope, key, count(*) AS n FROM (SELECT 'route' AS counter, profile AS scope, coalesce(m_method, m_avail) AS key FROM rc
  UNION ALL SELECT 'assertion', profile, coalesce(m_says, 'silent') FROM rc UNION ALL SELECT 'availability', profile, m_avail FROM rc
  UNION ALL SELECT 'reconciliation', profile, {OUTCOME_CODE} FROM rc) GROUP BY 1, 2, 3""")
twin("exposure_timing", """SELECT CASE WHEN off IS NULL THEN 'unresolved' WHEN off <= 7 THEN '0-7' WHEN off <= 30 THEN '8-30' WHEN off <= 90 THEN '31-90' ELSE '91+' END AS bucket,
  count(*) AS n, count(*) FILTER (off < 0) AS before_exposure FROM ev GROUP BY 1""")
twin("exposure_coverage", """SELECT count(DISTINCT subject_id) AS subjects, count(*) AS records, count(off) AS offsets_resolved,
  count(*) - count(off) AS offsets_unresolved FROM ev""")
twin("covariate_counts", """SELECT covariate, value, count(*) AS n FROM (
  SELECT unnest(['arm', 'sex', 'country']) AS covariate, unnest([coalesce(c_mktsegment, 'unknown'), CASE WHEN c_custkey IS NULL THEN 'unknown' WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END, coalesce(n_name, 'unknown')]) AS value
  FROM (SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders) p LEFT JOIN customer ON c_custkey = k LEFT JOIN nation ON n_nationkey = c_nationkey) GROUP BY 1, 2""", base="")
twin("cumulative_dose", "SELECT record_id, dose_days::DOUBLE AS dose_days, n_exposures FROM rc LEFT JOIN ds USING (record_id)", DOSE)

# -- scoring ----------------------------------------------------------------------------------
twin("verdict_confusion", "SELECT scope, key, gold, predicted, n FROM cells", V2, CELLS, PHENO)
twin("verdict_labels", f"""SELECT label, {prf()} FROM (SELECT label, count(*) FILTER (gold = predicted AND gold = label) AS tp,
  count(*) FILTER (predicted = label AND gold <> label) AS fp, count(*) FILTER (gold = label AND predicted <> label) AS fn
  FROM pair, (SELECT unnest(['case','non_case','review','not_ascertainable']) AS label) GROUP BY 1)""", V2, CELLS)
twin("phenotype_scores", "SELECT * FROM cm", V2, CELLS, PHENO, CASE_METRICS)
twin("site_slot_scores", f"""SELECT study_id, {prf()} FROM (SELECT study_id,
  (count(*) FILTER (g = p)) AS tp, (count(*) FILTER (p IS NOT NULL AND g IS DISTINCT FROM p)) AS fp, (count(*) FILTER (g IS NOT NULL AND g IS DISTINCT FROM p)) AS fn
  FROM (SELECT study_id, CASE WHEN (in_term OR in_comment) AND t IN (0, 2) AND site <> 'UNSPECIFIED' THEN site END AS g, m_value AS p FROM rc) GROUP BY 1)""")
twin("criteria_set_scores", f"""SELECT {prf()} FROM (SELECT (sum(CASE CAST(sk % 3 AS INT) WHEN 2 THEN 2 ELSE 1 END) FILTER (pk % 7 = 0))::BIGINT AS tp, 0::BIGINT AS fp, 0::BIGINT AS fn FROM ev)""")
twin("assertion_confusion", """SELECT 'assertion' AS matrix, expected AS gold, actual AS predicted, count(*) AS n FROM ar GROUP BY 1, 2, 3
  UNION ALL SELECT 'availability', ea, aa, count(*) FROM ar GROUP BY 1, 2, 3""", ASSERT)
twin("assertion_summary", """SELECT count(*) AS records, count(*) FILTER (expected = actual) AS correct, count(*) FILTER (expected = 'absent' AND actual <> 'absent') AS negatives_lost,
  count(*) FILTER (expected = 'silent' AND actual <> 'silent') AS silence_invented, count(*) FILTER (expected = 'absent' AND actual = 'absent') AS negatives_recovered,
  count(*) FILTER (expected = actual)::DOUBLE / count(*) AS accuracy FROM ar""", ASSERT)
twin("assertion_examples", """SELECT rid AS source_record_id, profile, expected, actual FROM ar WHERE expected <> actual""", ASSERT)
twin("representation_invariance", """, c AS (SELECT count(*) AS truths_compared, count(*) FILTER (agrees) AS agreeing, count(*) FILTER (nr > 0) AS truths_with_evidence,
  count(*) FILTER (nr > 0 AND ra) AS agreeing_with_evidence FROM ag)
SELECT *, truths_with_evidence - agreeing_with_evidence AS discordant, agreeing::DOUBLE / truths_compared AS raw_agreement,
  agreeing_with_evidence::DOUBLE / truths_with_evidence AS supported_agreement FROM c""", V2, RENDER)
ORACLE["representation_invariance"] = ORACLE["representation_invariance"].replace("\n, c AS", ",\nc AS", 1)
twin("discordant_truths", "SELECT truth_id, reference, verdicts FROM ag WHERE nr > 0 AND NOT ra", V2, RENDER)
twin("study_holdout", "SELECT * FROM cm", V2, CELLS, HOLD, CASE_METRICS)
twin("holdout_drop", """SELECT round_even(d.sensitivity - h.sensitivity, 4) AS sensitivity_drop, round_even(d.ppv - h.ppv, 4) AS ppv_drop,
  round_even(h.not_ascertainable_rate - d.not_ascertainable_rate, 4) AS not_ascertainable_rate_change
  FROM cm d, cm h WHERE d.key = 'development' AND h.key = 'held_out'""", V2, CELLS, HOLD, CASE_METRICS)
twin("mention_ranking", """, rk AS (SELECT study_id AS query_id, rid AS item_id, c, said = 'present' AS rel,
    row_number() OVER (PARTITION BY study_id ORDER BY c DESC, rid) AS rn FROM mn),
sz AS (SELECT study_id AS query_id, count(*) AS relevant FROM ev WHERE said = 'present' GROUP BY 1),
x AS (SELECT query_id, count(*) FILTER (rn <= 20) AS returned, count(*) FILTER (rn <= 20 AND rel) AS hits, min(rn) FILTER (rel) AS f FROM rk GROUP BY 1)
SELECT query_id, relevant, returned, hits, coalesce(1.0::DOUBLE / f, 0.0::DOUBLE) AS reciprocal_rank, hits::DOUBLE / relevant AS recall_at_k,
  least(20, relevant)::DOUBLE / relevant AS recall_ceiling, hits::DOUBLE / returned AS precision_at_k FROM x JOIN sz USING (query_id)""", MENTIONS)
ORACLE["mention_ranking"] = ORACLE["mention_ranking"].replace("\n, rk AS", ",\nrk AS", 1)
twin("silver_comparisons", "SELECT source_record_id, structured_assertion, extracted_assertion, extracted_value, extracted_confidence, agreement FROM sv", SILVER)
twin("silver_metrics", """, g AS (SELECT unnest(['overall','profile','reported_term_style']) AS scope, unnest(['ALL', 'P_both', 'mixed']) AS key, sv.* FROM sv),
c AS (SELECT scope, key, count(*) AS eligible_records, count(structured_assertion) AS with_comparator, count(extracted_assertion) AS answered,
  count(*) FILTER (agreement = 'agree') AS agreements, count(*) FILTER (agreement = 'disagree') AS disagreements,
  count(*) FILTER (agreement = 'abstained') AS abstentions FROM g GROUP BY 1, 2),
p AS (SELECT *, agreements::DOUBLE / answered AS precision, agreements::DOUBLE / with_comparator AS recall FROM c)
SELECT *, 2 * precision * recall / (precision + recall) AS f1, answered::DOUBLE / eligible_records AS coverage,
  abstentions::DOUBLE / eligible_records AS abstention_rate FROM p""", SILVER)
ORACLE["silver_metrics"] = ORACLE["silver_metrics"].replace("\n, g AS", ",\ng AS", 1)
twin("silver_by_assertion", """SELECT *, correct::DOUBLE / n AS recall, CASE WHEN answered > 0 THEN correct::DOUBLE / answered ELSE 0.0::DOUBLE END AS precision FROM (
  SELECT structured_assertion, count(*) AS n, count(extracted_assertion) AS answered, count(*) FILTER (agreement = 'agree') AS correct
  FROM sv WHERE structured_assertion IS NOT NULL GROUP BY 1)""", SILVER)
RELIABLE = """
rb AS (SELECT CASE WHEN extracted_confidence < 0.2 THEN 0 WHEN extracted_confidence < 0.4 THEN 1 WHEN extracted_confidence < 0.6 THEN 2
    WHEN extracted_confidence < 0.8 THEN 3 ELSE 4 END AS bin, CAST(extracted_confidence AS DECIMAL(10, 6)) AS c, agreement = 'agree' AS hit
  FROM sv WHERE extracted_assertion IS NOT NULL),
rel AS (SELECT bin, count(*) AS n, count(*) FILTER (hit) AS correct, sum(c)::DOUBLE / count(*) AS mean_confidence,
    count(*) FILTER (hit)::DOUBLE / count(*) AS observed_accuracy FROM rb GROUP BY 1)"""
twin("silver_reliability", "SELECT *, mean_confidence - observed_accuracy AS gap FROM rel", SILVER, RELIABLE)
twin("silver_calibration", """SELECT (SELECT count(*) FROM rb) AS answered,
  (SELECT round_even(sum((c - hit::INT) * (c - hit::INT))::DOUBLE / count(*), 4) FROM rb) AS brier_score,
  (SELECT round_even(sum(CAST(abs(round_even(mean_confidence - observed_accuracy, 4)) AS DECIMAL(10, 4)) * n)::DOUBLE / sum(n)::DOUBLE, 4) FROM rel) AS expected_calibration_error""", SILVER, RELIABLE)
twin("adjudication_queue", """, q AS (SELECT CASE WHEN agreement = 'disagree' THEN 'disagreement' WHEN extracted_assertion IS NOT NULL AND extracted_confidence < 0.8 THEN 'low_confidence'
    WHEN agreement = 'agree' THEN 'sampled_agreement' END AS queue_reason FROM sv)
SELECT queue_reason, CASE WHEN queue_reason = 'sampled_agreement' THEN least(20, count(*)) ELSE count(*) END AS n FROM q WHERE queue_reason IS NOT NULL GROUP BY 1""", SILVER)
ORACLE["adjudication_queue"] = ORACLE["adjudication_queue"].replace("\n, q AS", ",\nq AS", 1)
STAGED = (V1, V_STRUCT, TEXT_MODE, V_TERM, V2, ABLATION)
twin("ablation_stages", """SELECT *, n_ascertained::DOUBLE / n_evaluated AS ascertainable_fraction,
  CASE WHEN n_case > 0 THEN n_case_correct::DOUBLE / n_case ELSE 0.0::DOUBLE END AS precision,
  CASE WHEN gold_cases > 0 THEN n_case_correct::DOUBLE / gold_cases ELSE 0.0::DOUBLE END AS recall FROM sm""", *STAGED, STAGES)
twin("ablation_increments", f"SELECT *, {DECISION} AS decision FROM im", *STAGED, STEPS)
twin("ablation_decision", "SELECT 'structured' AS from_stage, 'reported_term' AS to_stage, 'DO NOT ADOPT: no verdict changed' AS decision", base="")

# -- order-dependent ---------------------------------------------------------------------------
twin("first_exposure", "SELECT subject_id, min(st)::VARCHAR AS anchor_date FROM ex GROUP BY 1")
twin("dose_increases", "SELECT subject_id, day::VARCHAR AS day, seq, top::DOUBLE AS before, dose::DOUBLE AS dose FROM dw WHERE dose > top", CHANGES)
twin("dose_decreases", "SELECT subject_id, day::VARCHAR AS day, seq, prev::DOUBLE AS before, dose::DOUBLE AS dose FROM dw WHERE dose < prev", CHANGES)
twin("latest_anchor", """SELECT record_id, CASE WHEN onset IS NULL THEN (SELECT min(day) FROM dw WHERE dw.subject_id = rc.subject_id AND dose > top)
  ELSE (SELECT max(day) FROM dw WHERE dw.subject_id = rc.subject_id AND dose > top AND day <= onset) END::VARCHAR AS anchor_date FROM rc""", CHANGES)
twin("episode_members", "SELECT record_id, concept, ordinal::BIGINT AS ordinal, gap FROM mem", EPISODES)
twin("episode_table", """SELECT episode_id, episode_number, study_id, subject_id, concept, n_records, first_onset::VARCHAR AS first_onset, last_onset::VARCHAR AS last_onset, rule,
  CASE WHEN n_records > 1 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS confidence, review_required FROM named""", EPISODES)
twin("episode_rules", "SELECT rule, count(*) AS n_episodes, sum(n_records)::BIGINT AS n_records, count(*) FILTER (review_required) AS n_flagged FROM named GROUP BY 1", EPISODES)
twin("record_episode", "SELECT record_id, episode_id, rule FROM mem JOIN named USING (study_id, subject_id, concept, ordinal)", EPISODES)

# -- retrieval -----------------------------------------------------------------------------------
twin("flat_records", f"""SELECT record_id, study_id, concept, code, {OUTCOME_CODE} AS reconciliation, m_says AS assertion, m_avail AS availability, m_value AS value,
  m_method AS method, m_variable AS source_variable, {SEVERITY} AS severity, grade, off AS exposure_offset_days, onset::VARCHAR AS onset, m_conf::DOUBLE AS confidence FROM rc""")
ORACLE["flat_records"] = ORACLE["flat_records"].replace(", m_conf::DOUBLE AS confidence FROM rc", " FROM rc")
twin("verdict_upsert", """SELECT definition_id, definition_version, verdict, count(*) AS n FROM (
  SELECT CASE WHEN concept = 'NEUTROPENIA' THEN 'graded_toxicity' WHEN concept LIKE 'RASH%' THEN 'cutaneous_mucosal' END AS definition_id,
    CASE WHEN concept = 'NEUTROPENIA' OR concept LIKE 'RASH%' THEN 1 END AS definition_version, coalesce(tox.verdict, v1.verdict) AS verdict
  FROM (SELECT record_id, concept FROM rc) LEFT JOIN (SELECT record_id, verdict FROM tox) tox USING (record_id) LEFT JOIN (SELECT record_id, verdict FROM v1) v1 USING (record_id)) GROUP BY 1, 2, 3""",
     V1, DOSE, TOX)


def bm25(docs: str, terms: list[str], key: str, banned: str = "false", fits: str = "") -> str:
    """Terms: words, or conditions over the token list ``tk`` and a place ``i`` in it; ``fits``: other than all of them."""
    tf = ", ".join(f"len(list_filter(range(1, len(tk) + 1), lambda i: {t})) AS tf{i}" if "tk[" in t
                   else f"len(list_filter(tk, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    idf = [f"greatest(ln((nd - df{i} + 0.5) / (df{i} + 0.5)), CASE WHEN ln((nd - df{i} + 0.5) / (df{i} + 0.5)) <= 0 THEN 1e-6 ELSE 0 END)"
           for i in range(len(terms))]
    score = " + ".join(f"{idf[i]} * (tf{i} * 2.2) / (tf{i} + 1.2 * (0.25 + 0.75 * dl / ml))" for i in range(len(terms)))
    every = " AND ".join(f"tf{i} > 0" for i in range(len(terms)))
    return (f"tok AS (SELECT {key}, regexp_extract_all(strip_accents(lower(body)), '[\\p{{L}}\\p{{N}}]+') AS tk FROM ({docs})), "
            f"tfs AS (SELECT {key}, len(tk) AS dl, {banned} AS banned, {tf} FROM tok), "
            f"sts AS (SELECT count(*) AS nd, avg(dl) AS ml, {df} FROM tfs), "
            f"bm AS (SELECT {key}, -({score}) AS score FROM tfs, sts WHERE {fits or every + ' AND NOT banned'})")


twin("mention_search", """SELECT mention_id, v AS value, round(score, 6) AS score, true AS candidate FROM mn JOIN bm USING (doc_id)
  WHERE a = 'present' ORDER BY score, mention_id LIMIT 40""", MENTIONS, DOCS,
     bm25("SELECT doc_id, full_text AS body FROM docs", ["oral", "delay"], "doc_id"))
twin("mention_search_all", """SELECT mention_id, v AS value, round(score, 6) AS score, true AS candidate FROM mn JOIN bm USING (doc_id)
  WHERE a = 'present'""", MENTIONS, DOCS,
     bm25("SELECT doc_id, full_text AS body FROM docs", ["oral", "delay"], "doc_id"))
twin("mention_browse_all", """SELECT mention_id, a AS assertion, 0.0::DOUBLE AS score FROM mn
  WHERE a = 'absent' AND study_id IN ('STUDY-E', 'STUDY-G')""", MENTIONS)
twin("mention_browse", """SELECT mention_id, a AS assertion, 0.0::DOUBLE AS score FROM mn WHERE a = 'absent' AND study_id IN ('STUDY-E', 'STUDY-G')
  ORDER BY mention_id LIMIT 30""", MENTIONS)
twin("document_search", "SELECT doc_id, round(score, 6) AS score FROM bm",
     bm25("SELECT doc_id, text AS body FROM documents", ["the", "of"], "doc_id"), base="")
twin("document_phrase_search", "SELECT doc_id, round(score, 6) AS score FROM bm",
     bm25("SELECT doc_id, text AS body FROM documents", ["tk[i] = 'de' AND tk[i + 1] = 'la'", "starts_with(tk[i], 'cion')"],
          "doc_id", "list_contains(tk, 'licensed')"), base="")
twin("document_search_any", "SELECT doc_id, round(score, 6) AS score FROM bm",
     bm25("SELECT doc_id, text AS body FROM documents", ["tk[i] = 'mit' AND tk[i + 1] = 'license'", "apache", "version",
                                                         "tk[i] = 'de' AND tk[i + 1] = 'la'"],
          "doc_id", "len(list_filter(tk, lambda x: starts_with(x, 'cion'))) > 0",
          "tf0 > 0 OR (tf1 > 0 AND tf2 > 0) OR (tf3 > 0 AND NOT banned)"), base="")
twin("document_phrases", """SELECT doc_id, phrase, count(*) AS n, cast(sum(s) AS bigint) AS starts, cast(sum(s + length(phrase)) AS bigint) AS ends FROM (
  SELECT doc_id, phrase, (k + 1) * length(phrase) - length(phrase) + list_sum(list_transform(parts[1:k + 1], lambda x: length(x))) AS s,
         right(parts[k + 1], 1) AS l, left(parts[k + 2], 1) AS r
  FROM (SELECT *, unnest(range(len(parts) - 1)) AS k FROM (
    SELECT doc_id, phrase, string_split(lower(text), phrase) AS parts
    FROM documents, (VALUES ('general public license'), ('apache license'), ('licensed under'), ('mit license')) AS p(phrase))))
  WHERE NOT regexp_matches(l, '[\\p{L}\\p{N}_]') AND NOT regexp_matches(r, '[\\p{L}\\p{N}_]') GROUP BY 1, 2""", base="")
twin("index_words", """SELECT term, count(*) AS n_docs, cast(sum(tf) AS bigint) AS n_places, cast(sum(place) AS bigint) AS first_places FROM (
  SELECT doc_id, term, count(*) AS tf, min(place) AS place FROM (
    SELECT doc_id, unnest(tk) AS term, unnest(range(len(tk))) AS place FROM (
      SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS tk FROM documents))
  GROUP BY 1, 2) GROUP BY 1""", base="")
twin("dense_rerank", """SELECT vec_id, label, round(list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0)), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 5) AS score
  FROM embeddings""", base="")

# -- runs and comparison ----------------------------------------------------------------------------
BOTH = """
bo AS (SELECT v1.record_id, v1.study_id, v1.verdict AS verdict_a, v2.verdict AS verdict_b, v1.deciding_criterion AS deciding_a, v2.deciding_criterion AS deciding_b,
  CASE WHEN v1.verdict = 'case' AND v2.verdict = 'case' THEN 'shared' WHEN v2.verdict = 'case' THEN 'gained' WHEN v1.verdict = 'case' THEN 'lost' END AS case_change
  FROM v1 JOIN v2 USING (record_id))"""
twin("definition_comparison", "SELECT record_id, verdict_a, verdict_b, deciding_a, deciding_b, case_change FROM bo", V1, V2, BOTH)
twin("comparison_summary", """SELECT count(*) FILTER (case_change = 'shared') AS shared, count(*) FILTER (case_change = 'gained') AS gained,
  count(*) FILTER (case_change = 'lost') AS lost, count(*) FILTER (verdict_a <> verdict_b) AS discordant FROM bo""", V1, V2, BOTH)
twin("case_sets", "SELECT record_id, study_id, case_change FROM bo WHERE case_change IS NOT NULL", V1, V2, BOTH)
twin("manifest_preview", f"""SELECT count(*) AS n_records, count(*) FILTER (verdict = 'case') AS n_case, count(*) FILTER (verdict = 'non_case') AS n_non_case,
  count(*) FILTER (verdict = 'review') AS n_review, count(*) FILTER (verdict = 'not_ascertainable') AS n_not_ascertainable,
  count(*) FILTER (verdict = 'case' AND m_method = 'extracted') AS n_cases_from_text, count(*) FILTER (verdict = 'case') AS n_cases_with_direct_evidence FROM v2""", V2)

# -- the evaluation as one long table: the twins above, one row per number ------------------------
def long_form(section: str, sql: str, *keys: str) -> str:
    key = f"concat_ws('/', {', '.join(keys)})" if keys else "'ALL'"
    left_out = f"EXCLUDE ({', '.join(keys)})" if keys else ""
    held = f"SELECT {''.join(k + ', ' for k in keys)}COLUMNS(* {left_out})::DOUBLE FROM ({sql})"
    return (f"SELECT '{section}' AS section, {key} AS key, metric, value FROM ({held}) "
            f"UNPIVOT INCLUDE NULLS (value FOR metric IN (COLUMNS(* {left_out})))")


_DROPS = f"""SELECT d.sensitivity - h.sensitivity AS sensitivity_drop, d.ppv - h.ppv AS ppv_drop,
  h.not_ascertainable_rate - d.not_ascertainable_rate AS not_ascertainable_rate_change
  FROM ({ORACLE['study_holdout']}) d, ({ORACLE['study_holdout']}) h WHERE d.key = 'development' AND h.key = 'held_out'"""
_ADDED = f"SELECT to_stage, added_cases, added_correct, precision_on_added, relative_gain FROM ({ORACLE['ablation_increments']})"
ORACLE["evaluation_bundle"] = " UNION ALL ".join((
    long_form("phenotype", ORACLE["phenotype_scores"], "scope", "key"),
    long_form("denominators", f"SELECT * EXCLUDE (profile) FROM ({ORACLE['narrative_denominators']})", "study_id"),
    long_form("assertion", ORACLE["assertion_summary"]),
    long_form("holdout", ORACLE["study_holdout"], "scope", "key"),
    long_form("holdout_drop", _DROPS),
    long_form("invariance", ORACLE["representation_invariance"]),
    long_form("silver", ORACLE["silver_metrics"], "scope", "key"),
    long_form("calibration", ORACLE["silver_calibration"]),
    long_form("ablation", ORACLE["ablation_stages"], "stage"),
    long_form("increment", _ADDED, "to_stage"),
))
twin("results_hash_flat", """, rh AS (SELECT sha256(to_json({record_id: record_id, subject_id: subject_id, study_id: study_id, profile: profile,
    verdict: verdict, deciding_criterion: deciding_criterion, definition_id: 'cutaneous_mucosal', definition_version: 2})::VARCHAR) AS d FROM v2)
SELECT substr(sha256(concat_ws(':', count(*), sum(CAST(('0x' || substr(d, 1, 15)) AS BIGINT)), bit_xor(CAST(('0x' || substr(d, 16, 15)) AS BIGINT)))), 1, 32) AS results_hash
FROM rh""", V2)
ORACLE["results_hash_flat"] = ORACLE["results_hash_flat"].replace("\n, rh AS", ",\nrh AS", 1)
