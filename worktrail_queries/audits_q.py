"""Projects from proposals, review samples, overlap audits and text lint."""

from __future__ import annotations

from pyspark.sql import functions as F

from worktrail.functions.text import AUDIT_STOPWORDS
from worktrail.operators import annotation as A
from worktrail.operators import audits as U
from worktrail.operators import rewrites as W
from worktrail_queries.annotation_q import proposals, staged
from worktrail_queries.gold import gold
from worktrail_queries.inputs import read
from worktrail_queries.registry import query
from worktrail_queries.sqlkit import has_any, rnd, table, toks

# Packs pass here unless a proposal names a wrong candidate or a foreign event.
table("okpack", "SELECT pack_id FROM propv GROUP BY pack_id HAVING bool_and(b NOT IN (7, 8, 9))")
table(
    "acc",
    """SELECT p.*, 'project_gharchive_rewrite_' || trim(regexp_replace(repo, '[^A-Za-z0-9]', '_', 'g'), '_') AS project_id, 'memory_rewrite_' || substr(p.task_candidate, 11) AS memory_id,
  'probe_' || p.task_candidate AS probe_id,
  CASE candidate_type WHEN 'negative_policy_example' THEN 'negative_example_storage_gating' WHEN 'authorization_boundary' THEN 'privacy_authorization_boundary'
    WHEN 'issue_triage_policy' THEN 'contextual_workflow_policy_selection' ELSE 'tool_action_policy_alignment' END AS task_type FROM prop p JOIN okpack USING (pack_id)""",
)


def accepted(spark, sf):
    tasks = staged(spark, sf).tasks
    rows = proposals(spark, sf)
    bad = rows.filter("b in (7, 8, 9)").select("pack_id").distinct()
    passed = tasks.select("pack_id").distinct().join(bad, "pack_id", "left_anti")
    return W.accepted(rows, tasks, passed)


table(
    "rwm",
    """SELECT project_id, memory_id, CASE candidate_type WHEN 'issue_triage_policy' THEN 'contextual_policy' ELSE candidate_type END AS memory_type, rewritten_policy AS content, 'active' AS status,
  list_transform(positive_event_ids, lambda e: 'event_rewrite_' || e) AS src, list_transform(negative_event_ids, lambda e: 'event_rewrite_' || e) AS neg, confidence AS future_score,
  'mined_by=' || mining_rule || CASE WHEN candidate_type = 'negative_policy_example' THEN '|invalidates=event_rewrite_' || negative_event_ids[1] ELSE '' END AS relations, row_no FROM acc""",
)


@query(
    "rewrite_memory_table",
    f"""SELECT project_id, memory_id, memory_type, content, status, array_to_string(src, '|') AS source_events, array_to_string(neg, '|') AS negative_evidence, future_score, relations FROM rwm
        UNION ALL SELECT project_id, '{W.DISTRACTOR}', 'distractor', '{W.DISTRACTOR_TEXT.replace("'", "''")}', 'distractor', first(src[1] ORDER BY row_no), '', NULL, '' FROM rwm GROUP BY project_id""",
)
def rewrite_memory_table(spark, sf):
    rows = W.rewrite_memories(accepted(spark, sf))
    return rows.select(
        "project_id", "memory_id", "memory_type", "content", "status", F.array_join("source_events", "|").alias("source_events"),
        F.array_join("negative_evidence", "|").alias("negative_evidence"), "future_score",
        F.array_join(F.transform("relations", lambda r: F.concat(r["type"], F.lit("="), r["target"])), "|").alias("relations"),
    )


@query(
    "rewrite_events",
    """SELECT DISTINCT project_id, 'event_rewrite_' || event_id AS event_id, 'artifact_rewrite_' || event_id AS artifact_id, event_id AS original_event_id, actor, event_type, content, timestamp
       FROM acc JOIN snip USING (annotation_id)""",
)
def rewrite_events(spark, sf):
    evidence = staged(spark, sf).evidence
    return W.rewrite_events(accepted(spark, sf), evidence).select(
        "project_id", "event_id", "artifact_id", "original_event_id", "actor", "event_type", "content", "timestamp"
    )


_lower = "list_transform({0}, lambda a: lower(a))"
table("negmem", "SELECT project_id, first(memory_id ORDER BY row_no) AS negative_memory FROM acc WHERE candidate_type = 'negative_policy_example' GROUP BY project_id")
table(
    "comp",
    """SELECT project_id, list(memory_id ORDER BY row_no)[:2] AS two, any_value(negative_memory) AS nm FROM acc LEFT JOIN negmem USING (project_id) GROUP BY project_id
HAVING count(DISTINCT task_type) < 3 AND count(*) >= 2""",
)


@query(
    "project_from_proposals",
    f"""SELECT project_id, probe_id, task_type, future_probe_query AS query, array_to_string(must_include, '|') AS must_include, array_to_string(must_not_include, '|') AS must_not_include,
          memory_id AS positive, CASE WHEN candidate_type = 'negative_policy_example' THEN memory_id WHEN task_type = '{W.ALIGNMENT}' THEN coalesce(negative_memory, '') ELSE '' END AS negative,
          '{W.DISTRACTOR}' AS distractor, CASE task_type WHEN '{W.STORAGE}' THEN 'habit_storage_gating' WHEN '{W.PRIVACY}' THEN 'privacy_authorization_boundary|workflow_boundary_respect'
            WHEN '{W.SELECTION}' THEN 'contextual_policy_selection|workflow_boundary_respect' ELSE 'tool_action_alignment|workflow_boundary_respect|contextual_policy_selection' END AS capabilities,
          CASE task_type WHEN '{W.STORAGE}' THEN 'storage_precision|overgeneralization_rate' WHEN '{W.PRIVACY}' THEN 'boundary_violation_rate|tool_authorization_accuracy'
            WHEN '{W.SELECTION}' THEN 'cross_event_policy_coverage|boundary_violation_rate' ELSE 'allowed_action_accuracy|boundary_violation_rate' END AS metrics,
          CASE WHEN candidate_type = 'negative_policy_example' THEN 'easy' ELSE 'medium' END AS difficulty FROM acc LEFT JOIN negmem USING (project_id)
        UNION ALL SELECT project_id, '{W.COMPOSITION}', '{W.SELECTION}', '{W.COMPOSITION_QUERY}', '{"|".join(W.COMPOSITION_INCLUDE)}', '{"|".join(W.COMPOSITION_AVOID)}',
          array_to_string(CASE WHEN nm IS NOT NULL AND NOT list_contains(two, nm) THEN list_append(two, nm) ELSE two END, '|'), coalesce(nm, ''), '{W.DISTRACTOR}', '{"|".join(W.COMPOSITION_CAPABILITIES)}',
          'cross_event_policy_coverage|boundary_violation_rate', 'hard' FROM comp""",
)
def project_from_proposals(spark, sf):
    joined = lambda c, n: F.array_join(c, "|").alias(n)
    return W.rewrite_probes(accepted(spark, sf)).select(
        "project_id", "probe_id", "task_type", "query", joined("must_include", "must_include"), joined("must_not_include", "must_not_include"),
        joined("evidence.positive", "positive"), joined("evidence.negative", "negative"), joined("evidence.distractor", "distractor"),
        joined("capabilities", "capabilities"), joined("metrics", "metrics"), "difficulty",
    )


@query(
    "fn_candidate_mappings",
    """SELECT annotation_id, 'memory_rewrite_' || substr(candidate_id, 11) AS memory_id, CASE candidate_type WHEN 'issue_triage_policy' THEN 'contextual_policy' ELSE candidate_type END AS memory_type,
         CASE candidate_type WHEN 'negative_policy_example' THEN 'negative_example_storage_gating' WHEN 'authorization_boundary' THEN 'privacy_authorization_boundary'
           WHEN 'issue_triage_policy' THEN 'contextual_workflow_policy_selection' ELSE 'tool_action_policy_alignment' END AS task_type, true AS needs_distractor FROM task""",
)
def fn_candidate_mappings(spark, sf):
    tasks = staged(spark, sf).tasks
    kind, forbidden = F.col("candidate_type"), F.col("action_boundary.forbidden_actions")
    task = W.task_type(kind, F.col("future_tasks"), forbidden)
    return tasks.select(
        "annotation_id", W.memory_id(F.col("candidate_id")).alias("memory_id"), W.memory_type(kind).alias("memory_type"), task.alias("task_type"),
        W.needs_distractor(task, kind, forbidden).alias("needs_distractor"),
    )


# Review samples ---------------------------------------------------------------------------
_key = "sha256('7' || chr(0) || pack_id || chr(0) || annotation_id || chr(0) || candidate_id || chr(0))"
table(
    "sample",
    f"""SELECT *, row_number() OVER (ORDER BY NOT head, CASE WHEN head THEN candidate_type END, CASE WHEN head THEN kr END, key) AS selection_rank FROM (
  SELECT *, kr <= 3 AS head FROM (SELECT *, {_key} AS key, row_number() OVER (PARTITION BY candidate_type ORDER BY {_key}) AS kr FROM task)) QUALIFY selection_rank <= 40""",
)


def _sample(spark, sf):
    tasks = staged(spark, sf).tasks
    keys = [F.lit("7"), F.col("pack_id"), F.col("annotation_id"), F.col("candidate_id")]
    return U.hash_sample(tasks, keys, "candidate_type", "annotation_id", 40, 3)


@query("hash_sample", "SELECT annotation_id, candidate_type, key AS sample_key, selection_rank FROM sample")
def hash_sample(spark, sf):
    return _sample(spark, sf).select("annotation_id", "candidate_type", "sample_key", "selection_rank")


@query(
    "audit_sample_pack",
    """SELECT 'audit_' || substr(sha256(s.pack_id || chr(0) || s.annotation_id || chr(0) || '7' || chr(0)), 1, 16) AS audit_id, selection_rank, s.repo, s.pack_id, s.annotation_id, s.candidate_id,
         s.candidate_type, p.proposal_id, s.policy AS policy_candidate, p.rewritten_policy, len(s.supporting_events) AS supporting, len(s.negative_events) AS negative, len(p.failed) = 0 AS passed
       FROM sample s JOIN propv p USING (annotation_id)""",
)
def audit_sample_pack(spark, sf):
    tasks = staged(spark, sf).tasks
    validated = A.validate_proposals(proposals(spark, sf), tasks).select("annotation_id", "proposal_id", "rewritten_policy", "passed")
    return U.audit_items(_sample(spark, sf).join(validated, "annotation_id"), 7).select(
        "audit_id", "selection_rank", "repo", "pack_id", "annotation_id", "candidate_id", "candidate_type", "proposal_id",
        F.col("policy").alias("policy_candidate"), "rewritten_policy", F.size("supporting_events").cast("bigint").alias("supporting"),
        F.size("negative_events").cast("bigint").alias("negative"), "passed",
    )


@query(
    "spread_sample",
    """SELECT doc_id, pos FROM (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)
       WHERE CASE WHEN n <= 60 THEN true ELSE pos % greatest(1, n // 60) = 0 AND pos // greatest(1, n // 60) < 60 END""",
)
def spread_sample(spark, sf):
    docs = read(spark, sf, "documents").select("source", "doc_id")
    return U.spread_sample(docs, ["source", "doc_id"], 60).select("doc_id", "pos")


_DEC = "CASE WHEN quality = 1 THEN 'accept' WHEN doc_id % 2 = 0 THEN 'reject' WHEN doc_id % 5 = 1 THEN 'unsure' ELSE 'needs_revision' END"
table(
    "decs",
    f"""SELECT doc_id * 2 AS row_no, 'audit_' || CASE WHEN doc_id % 23 = 4 THEN 'x' ELSE '' END || doc_id AS audit_id, {_DEC} AS decision, toxic = 1 AS blocking, toxic = 1 AND doc_id % 2 = 0 AS label FROM labels
UNION ALL SELECT doc_id * 2 + 1, 'audit_' || doc_id, 'accept', false, false FROM labels WHERE doc_id % 29 = 1""",
)


def _decisions(spark, sf):
    """Labels as review decisions, some for unknown items and some given twice."""
    labels = read(spark, sf, "labels")
    first = labels.selectExpr(
        "doc_id * 2 as row_no", "concat('audit_', if(doc_id % 23 = 4, 'x', ''), doc_id) as audit_id", f"{_DEC} as decision",
        "if(toxic = 1 and doc_id % 2 = 0, array('gold_leakage'), cast(array() as array<string>)) as issue_labels", "toxic = 1 as blocking",
    )
    again = labels.filter("doc_id % 29 = 1").selectExpr(
        "doc_id * 2 + 1 as row_no", "concat('audit_', doc_id) as audit_id", "'accept' as decision", "cast(array() as array<string>) as issue_labels",
        "false as blocking",
    )
    items = read(spark, sf, "documents").select(F.concat(F.lit("audit_"), "doc_id").alias("audit_id"))
    return items, first.unionByName(again)


table(
    "decj",
    """SELECT d.*, i.audit_id IS NOT NULL AS known, row_no = min(row_no) OVER (PARTITION BY d.audit_id) AS is_first FROM decs d LEFT JOIN (SELECT 'audit_' || doc_id AS audit_id FROM documents) i ON i.audit_id = d.audit_id""",
)
_iss = """(CASE WHEN NOT known THEN 1 ELSE 0 END + CASE WHEN known AND NOT is_first THEN 1 ELSE 0 END + CASE WHEN known AND is_first AND decision = 'unsure' THEN 1 ELSE 0 END
  + CASE WHEN known AND is_first AND decision = 'needs_revision' THEN 1 ELSE 0 END + CASE WHEN known AND is_first AND blocking THEN 1 ELSE 0 END)"""


@query(
    "audit_decision_rollup",
    f"""SELECT *, {rnd('CASE WHEN reviewed > 0 THEN accepted / reviewed ELSE 0 END', 6)} AS accept_rate, row_issues = 0 AND missing = 0 AND reviewed > 0 AND accepted / reviewed >= 0.95 AS passed FROM (
         SELECT count(*) AS decisions_total, count(*) FILTER (known AND decision <> 'unsure') AS reviewed, count(*) FILTER (known AND decision = 'accept') AS accepted,
         count(*) FILTER (known AND decision = 'reject') AS rejected, count(*) FILTER (known AND decision = 'needs_revision') AS needs_revision, CAST(sum({_iss}) AS BIGINT) AS row_issues,
         (SELECT count(*) FROM documents WHERE 'audit_' || doc_id NOT IN (SELECT audit_id FROM decs)) AS missing FROM decj)""",
)
def audit_decision_rollup(spark, sf):
    items, decisions = _decisions(spark, sf)
    return U.decision_rollup(items, decisions)


@query("audit_decision_issues", f"SELECT row_no, audit_id, decision, {_iss} AS issues FROM decj WHERE {_iss} > 0")
def audit_decision_issues(spark, sf):
    items, decisions = _decisions(spark, sf)
    rows = U.decision_issues(items, decisions).filter(F.size("codes") > 0)
    return rows.select("row_no", "audit_id", "decision", F.size("codes").cast("bigint").alias("issues"))


# Overlap ----------------------------------------------------------------------------------
_at = lambda text: f"list_distinct({toks(text, AUDIT_STOPWORDS)})"
table(
    "ovl0",
    f"""SELECT p.project_id, p.probe_id, p.task_type, capabilities, {_at('p.query')} AS q, {_at("array_to_string(list_concat(must_include, must_not_include), ' ')")} AS x, {_at("entries")} AS b
FROM probe p JOIN (SELECT project_id, probe_id, string_agg(array_to_string(list_concat(list_concat(allowed_actions, forbidden_actions), list_concat(authorized_tools, conditions)), ' '), ' ') AS entries
  FROM pmem WHERE role = 'positive' GROUP BY ALL) USING (project_id, probe_id)""".replace("FROM pmem", "FROM (SELECT pmem.*, mem.conditions FROM pmem JOIN mem USING (project_id, memory_id))"),
)
table(
    "ovl",
    f"""SELECT project_id, probe_id, task_type, capabilities, len(q) AS query_tokens, len(x) AS expected_tokens, len(b) AS boundary_tokens,
  {rnd('len(list_intersect(q, x)) / greatest(1, len(x))')} AS expected_overlap, {rnd('len(list_intersect(q, b)) / greatest(1, len(b))')} AS boundary_overlap,
  array_to_string(list_sort(list_intersect(q, x)), '|') AS expected_overlap_tokens, array_to_string(list_sort(list_intersect(q, b)), '|') AS boundary_overlap_tokens FROM ovl0""",
)


def _overlap(spark, sf):
    g = gold(spark, sf)
    return U.probe_overlap(g.probes, g.memories)


@query("probe_leakage", "SELECT * EXCLUDE (capabilities) FROM ovl")
def probe_leakage(spark, sf):
    return _overlap(spark, sf).drop("capabilities")


_T = 0.3
_ov = ", ".join(
    f"{rnd(f'quantile_cont({c}, {q})')} AS p{int(q * 100)}_{c}" for c in ("expected_overlap", "boundary_overlap") for q in (0.5, 0.9)
)


@query(
    "overlap_summary",
    f"""SELECT scope, name, count(*) AS probes, {rnd('avg(expected_overlap)')} AS mean_expected_overlap, {rnd('avg(boundary_overlap)')} AS mean_boundary_overlap, {_ov},
          count(*) FILTER (expected_overlap >= {_T}) AS high_expected_overlap_probes, count(*) FILTER (boundary_overlap >= {_T}) AS high_boundary_overlap_probes,
          count(*) FILTER (expected_overlap >= {_T} OR boundary_overlap >= {_T}) AS high_any_overlap_probes
        FROM (SELECT 'all' AS scope, 'all' AS name, * FROM ovl UNION ALL SELECT 'task_type', task_type, * FROM ovl UNION ALL SELECT 'capability', unnest(capabilities), * FROM ovl) GROUP BY ALL""",
)
def overlap_summary(spark, sf):
    return U.overlap_summary(_overlap(spark, sf), _T)


@query(
    "high_risk_topn",
    f"""SELECT project_id, probe_id, expected_overlap, boundary_overlap FROM ovl WHERE expected_overlap >= {_T} OR boundary_overlap >= {_T}
        ORDER BY boundary_overlap DESC, expected_overlap DESC, probe_id DESC, project_id LIMIT 25""",
)
def high_risk_topn(spark, sf):
    return U.high_risk(_overlap(spark, sf), _T).select("project_id", "probe_id", "expected_overlap", "boundary_overlap")


# Text lint --------------------------------------------------------------------------------
RULES = {"double_digit_code": r"[0-9]{2}[ -][0-9]{2}", "shout": r"[!?]{2}", "licence": r"licen[sc]e"}
SAFE = ["not", "copyright", "only", "der", "les"]


@query(
    "line_context_lint",
    f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), e AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i, ls FROM l),
        c AS (SELECT doc_id, line, i + 1 AS line_no, lower(array_to_string(ls[greatest(1, i):i + 2], chr(10))) AS context FROM e),
        h AS (SELECT *, unnest(list_filter([{", ".join(f"CASE WHEN regexp_matches(line, '(?i){p}') THEN '{n}' END" for n, p in RULES.items())}], lambda x: x IS NOT NULL)) AS rule FROM c)
        SELECT doc_id, line_no, rule, {has_any('context', SAFE)} AS allowed FROM h""",
)
def line_context_lint(spark, sf):
    return U.line_context_lint(read(spark, sf, "documents"), "doc_id", "text", RULES, SAFE)


@query("ordered_unique", "SELECT conv_id, string_agg(role, '|' ORDER BY first_turn) AS roles FROM (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY ALL) GROUP BY conv_id")
def ordered_unique(spark, sf):
    """Values in order of first appearance: the first place of each, then a short list."""
    firsts = read(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first_turn"))
    pairs = F.array_sort(F.collect_list(F.struct("first_turn", "role")))
    return firsts.groupBy("conv_id").agg(F.array_join(F.transform(pairs, lambda p: p["role"]), "|").alias("roles"))

