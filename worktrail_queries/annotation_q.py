"""Annotation tasks, prompts, proposals and their checks."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrail.functions.ids import hash_bucket
from worktrail.operators import annotation as A
from worktrail.session import pinned
from worktrail_queries.gold import gold
from worktrail_queries.inputs import candidates, profile
from worktrail_queries.mining_q import bucket_sql, split_sql
from worktrail_queries.registry import query
from worktrail_queries.sqlkit import iso, rnd, table


class Staged:
    """Tasks and their evidence, each written when a query first asks for it. Evidence reads
    what it shows straight from the records, so no whole table of events is written for it."""

    def __init__(self, spark, sf):
        self._spark, self._sf = spark, sf

    @cached_property
    def tasks(self) -> DataFrame:
        return pinned(A.annotation_tasks(candidates(self._spark, self._sf), profile(self._spark, self._sf)))

    @cached_property
    def evidence(self) -> DataFrame:
        g = gold(self._spark, self._sf)
        return pinned(A.evidence_rows(self.tasks, *g.sources))


_STAGED: dict[tuple[str, str], Staged] = {}


def staged(spark, sf) -> Staged:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STAGED:
        _STAGED[key] = Staged(spark, sf)
    return _STAGED[key]


def _terms(lists: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split(translate(array_to_string({lists}, ' '), '_', ' '), ' '), lambda w: length(w) >= 3)))"


table(
    "task",
    f"""SELECT 'gharchive_policy_pack_' || trim(regexp_replace(repo, '[^A-Za-z0-9]', '_', 'g'), '_') AS pack_id, 'annot_' || candidate_id AS annotation_id, cand.*,
  {_terms('allowed_actions')} AS must_include_terms, {_terms('forbidden_actions')} AS must_not_include_terms, candidate_type = 'negative_policy_example' AS requires_negative_evidence
FROM cand JOIN (SELECT repo FROM prof WHERE eligible) USING (repo)""",
)
table(
    "snip",
    f"""SELECT pack_id, annotation_id, role, place, t.event_id, actor, event_type, content, {iso('ts')} AS timestamp, 'events/' || kind || '#' || ord AS raw_pointer,
  CASE WHEN raw_type IN ('PullRequestEvent', 'IssuesEvent', 'IssueCommentEvent', 'CommitCommentEvent') THEN 'https://example.org/' || ord END AS uri
FROM (SELECT pack_id, annotation_id, 'supporting' AS role, unnest(supporting_events) AS event_id, unnest(range(len(supporting_events))) AS place FROM task
  UNION ALL SELECT pack_id, annotation_id, 'negative', unnest(negative_events), unnest(range(len(negative_events))) FROM task) t JOIN ev USING (event_id)""",
)


@query("annotation_tasks", """SELECT pack_id, annotation_id, candidate_id, repo, candidate_type, policy, confidence, array_to_string(must_include_terms, '|') AS must_include_terms,
  array_to_string(must_not_include_terms, '|') AS must_not_include_terms, requires_negative_evidence, CASE WHEN requires_negative_evidence THEN 5 ELSE 4 END AS checklist FROM task""")  # fmt: skip
def annotation_tasks(spark, sf):
    tasks = staged(spark, sf).tasks
    return tasks.select(
        "pack_id", "annotation_id", "candidate_id", "repo", "candidate_type", "policy", "confidence",
        F.array_join("must_include_terms", "|").alias("must_include_terms"), F.array_join("must_not_include_terms", "|").alias("must_not_include_terms"),
        "requires_negative_evidence", F.size("human_review_checklist").cast("bigint").alias("checklist"),
    )


@query("evidence_join", "SELECT annotation_id, role, place, event_id, actor, event_type, content, timestamp, raw_pointer, uri, true AS known FROM snip")
def evidence_join(spark, sf):
    evidence = staged(spark, sf).evidence
    return evidence.select(
        "annotation_id", "role", F.col("place").cast("bigint").alias("place"), "event_id", "actor", "event_type", "content", "timestamp",
        "raw_pointer", "uri", "known",
    )


# Proposals whose candidate hash falls on 7, 8 or 9 carry a fault; on 4, 5 or 6 the
# returned row is unfilled or returned twice.
_b = bucket_sql("candidate_id")
table(
    "prop0",
    f"""SELECT pack_id, annotation_id, candidate_id AS task_candidate, repo, candidate_type, policy, {_b} AS b, row_number() OVER (ORDER BY annotation_id) * 10 AS row_no,
  'proposal_' || candidate_id AS proposal_id, CASE WHEN {_b} = 8 THEN candidate_id || '_x' ELSE candidate_id END AS candidate_id,
  policy || CASE WHEN {_b} % 2 = 0 THEN ' It is not a default assistant habit.' ELSE '' END AS rewritten_policy, 'What should the agent do next in ' || repo || '?' AS future_probe_query,
  list_transform(allowed_actions, lambda a: replace(a, '_', ' ')) AS must_include, list_transform(forbidden_actions, lambda a: replace(a, '_', ' ')) AS must_not_include,
  CASE WHEN {_b} = 9 THEN list_append(supporting_events, 'event_elsewhere') ELSE supporting_events END AS positive_event_ids, negative_events AS negative_event_ids,
  CASE WHEN {_b} = 7 THEN list_append(allowed_actions, 'merge_anything') ELSE allowed_actions END AS allowed_actions, forbidden_actions, conditions, authorized_tools,
  supporting_events, must_include_terms, must_not_include_terms, requires_negative_evidence, future_tasks, confidence, mining_rule, rank FROM task""",
)


def proposals(spark, sf):
    tasks = staged(spark, sf).tasks
    b = hash_bucket(F.col("candidate_id"))
    from worktrail.operators.ordering import group_positions

    # Row numbers in annotation order without one global sort task.
    order = group_positions(tasks.select(F.lit(0).alias("all"), "annotation_id"), ["all"], ["annotation_id"]).select(
        "annotation_id", ((F.col("pos") + 1) * 10).alias("row_no")
    )
    human = lambda c: F.transform(c, lambda a: F.translate(a, "_", " "))
    boundary = F.col("action_boundary")
    widened = boundary.withField(
        "allowed_actions",
        F.when(F.col("b") == 7, F.concat(boundary["allowed_actions"], F.array(F.lit("merge_anything")))).otherwise(boundary["allowed_actions"]),
    )
    return tasks.withColumn("b", b).join(order, "annotation_id").select(
        "row_no",
        "b",
        F.concat(F.lit("proposal_"), "candidate_id").alias("proposal_id"),
        "pack_id",
        "annotation_id",
        F.when(F.col("b") == 8, F.concat("candidate_id", F.lit("_x"))).otherwise(F.col("candidate_id")).alias("candidate_id"),
        F.concat("policy", F.when(F.col("b") % 2 == 0, " It is not a default assistant habit.").otherwise("")).alias("rewritten_policy"),
        F.concat(F.lit("What should the agent do next in "), "repo", F.lit("?")).alias("future_probe_query"),
        human(boundary["allowed_actions"]).alias("must_include"),
        human(boundary["forbidden_actions"]).alias("must_not_include"),
        F.when(F.col("b") == 9, F.concat("supporting_events", F.array(F.lit("event_elsewhere")))).otherwise(F.col("supporting_events")).alias("positive_event_ids"),
        F.col("negative_events").alias("negative_event_ids"),
        widened.alias("action_boundary"),
        F.create_map(F.lit("pack_id"), F.col("pack_id")).alias("metadata"),
    )


@query("annotation_task_checks", """SELECT pack_id, annotation_id, 'action boundary is empty' AS code FROM task WHERE len(allowed_actions) + len(forbidden_actions) = 0
  UNION ALL SELECT pack_id, annotation_id, 'unknown supporting event ids' FROM prop0 WHERE b = 9""")  # fmt: skip
def annotation_task_checks(spark, sf):
    """Tasks with the returned evidence ids, some of which name no event."""
    tasks = staged(spark, sf).tasks
    g = gold(spark, sf)
    given = tasks.drop("supporting_events").join(
        proposals(spark, sf).select("annotation_id", F.col("positive_event_ids").alias("supporting_events")), "annotation_id"
    )
    return A.task_issues(given, A.evidence_rows(given, *g.sources))


table(
    "pack",
    f"""SELECT pack_id, repo, {split_sql('repo')} AS split, CAST(sum(n) AS BIGINT) AS tasks, string_agg(candidate_type || '=' || n, '|' ORDER BY candidate_type || '=' || n) AS candidate_types
FROM (SELECT pack_id, repo, candidate_type, count(*) AS n FROM task GROUP BY ALL) GROUP BY pack_id, repo""",
)


def pack_rows(spark, sf):
    s = staged(spark, sf)
    return A.packs(s.tasks, A.task_issues(s.tasks, s.evidence))


@query("annotation_release", "SELECT p.*, h.content_hash FROM pack p JOIN (SELECT pack_id, sha256(string_agg(annotation_id, chr(10) ORDER BY annotation_id)) AS content_hash FROM task GROUP BY pack_id) h USING (pack_id)")
def annotation_release(spark, sf):
    return pack_rows(spark, sf)


@query("scale_summary", f"SELECT count(*) AS eligible_packs, CAST(sum(tasks) AS BIGINT) AS tasks_total, min(tasks) AS min_per_pack, max(tasks) AS max_per_pack, {rnd('avg(tasks)')} AS mean_per_pack FROM pack")
def scale_summary(spark, sf):
    return A.scale_summary(pack_rows(spark, sf))


@query("split_union", "SELECT split, annotation_id FROM task JOIN pack USING (pack_id)")
def split_union(spark, sf):
    tasks = staged(spark, sf).tasks
    rows = A.release_tasks(tasks, pack_rows(spark, sf)).select("split", "annotation_id")
    train, dev, test = (rows.filter(F.col("split") == s) for s in ("train", "dev", "test"))
    return train.unionByName(dev).unionByName(test)


_jl = lambda c: f"'[' || array_to_string(list_transform({c}, lambda x: '\"' || x || '\"'), ',') || ']'"
_boundary_json = (
    f"'{{\"allowed_actions\":' || {_jl('allowed_actions')} || ',\"authorized_tools\":' || {_jl('authorized_tools')} || ',\"conditions\":' || {_jl('conditions')} || "
    f"',\"exceptions\":[],\"forbidden_actions\":' || {_jl('forbidden_actions')} || ',\"forbidden_tools\":[],\"requires_approval\":[],\"requires_clarification\":[]}}'"
)
_snip_json = (
    "'- {\"actor\":\"' || actor || '\",\"content\":\"' || content || '\",\"content_hashes\":[\"H\"],\"event_id\":\"' || event_id || '\",\"event_type\":\"' || event_type || "
    "'\",\"raw_pointer\":\"' || raw_pointer || '\",\"timestamp\":\"' || timestamp || '\"}'"
)
table(
    "prompt",
    f"""SELECT 'prompt_' || annotation_id AS prompt_id, t.*, 'Pack: ' || pack_id || chr(10) || 'Annotation: ' || annotation_id || chr(10) || 'Repository: ' || repo || chr(10) ||
  'Candidate type: ' || candidate_type || chr(10) || 'Policy candidate: ' || policy || chr(10) || 'Mining rule: ' || mining_rule || chr(10) || 'Supporting evidence:' || chr(10) || s.lines || chr(10) ||
  'Negative evidence:' || chr(10) || coalesce(n.lines, '- none supplied') || chr(10) || 'Action boundary to preserve exactly or narrow, never widen:' || chr(10) || {_boundary_json} || chr(10) ||
  'Verifier expectations:' || chr(10) || '{{"must_include_terms":' || {_jl('must_include_terms')} || ',"must_not_include_terms":' || {_jl('must_not_include_terms')} || ',"must_preserve_action_boundary":' || {_boundary_json} ||
  ',"negative_event_ids_must_be_subset_of":' || {_jl('negative_events')} || ',"positive_event_ids_must_be_subset_of":' || {_jl('supporting_events')} || ',"requires_negative_evidence":' || requires_negative_evidence || '}}' || chr(10) ||
  '{A.CLOSING}' AS user_prompt
FROM task t JOIN (SELECT annotation_id, string_agg({_snip_json}, chr(10) ORDER BY place) AS lines FROM snip WHERE role = 'supporting' GROUP BY ALL) s USING (annotation_id)
LEFT JOIN (SELECT annotation_id, string_agg({_snip_json}, chr(10) ORDER BY place) AS lines FROM snip WHERE role = 'negative' GROUP BY ALL) n USING (annotation_id)""",
)


def prompts(spark, sf):
    s = staged(spark, sf)
    return A.prompt_rows(s.tasks, s.evidence)


@query("prompt_rows", "SELECT prompt_id, pack_id, annotation_id, candidate_type, user_prompt FROM prompt")
def prompt_rows(spark, sf):
    """The hash of the raw record is masked: plain SQL cannot rebuild the record's JSON."""
    masked = F.regexp_replace("user_prompt", '"[0-9a-f]{64}"', '"H"')
    return prompts(spark, sf).select("prompt_id", "pack_id", "annotation_id", "candidate_type", masked.alias("user_prompt"))


@query(
    "pack_jobs",
    f"""WITH RECURSIVE sized AS (SELECT row_number() OVER (ORDER BY pack_id, prompt_id) AS i, pack_id, greatest(1, (length('{A.SYSTEM_PROMPT}') + 1 + length(user_prompt)
          + 63 * ((length(user_prompt) - length(replace(user_prompt, '"H"', ''))) // 3) + 1 + length({_boundary_json}) + 3) // 4) AS tokens FROM prompt),
        bins AS (SELECT i, 1 AS job, 1 AS c, tokens AS used FROM sized WHERE i = 1 UNION ALL
          SELECT s.i, CASE WHEN c >= 100 OR used + tokens > 120000 THEN job + 1 ELSE job END, CASE WHEN c >= 100 OR used + tokens > 120000 THEN 1 ELSE c + 1 END,
            CASE WHEN c >= 100 OR used + tokens > 120000 THEN tokens ELSE used + tokens END FROM bins b JOIN sized s ON s.i = b.i + 1)
        SELECT 'rewrite_job_' || lpad(CAST(job AS VARCHAR), CAST(greatest(4, length(CAST(job AS VARCHAR))) AS INTEGER), '0') AS job_id, count(*) AS prompts, CAST(sum(tokens) AS BIGINT) AS estimated_tokens, count(DISTINCT pack_id) AS packs
        FROM bins JOIN sized USING (i) GROUP BY job""",
)
def pack_jobs(spark, sf):
    """Shards far shorter than the table, so that bins reach over their ends."""
    return A.job_summary(A.pack_jobs(prompts(spark, sf), shard_prompts=150))


# Validation ---------------------------------------------------------------------------------
_any = lambda terms: f"len(list_filter({terms}, lambda w: contains(etext, lower(w)))) > 0"
table(
    "prop",
    f"""SELECT *, lower(replace(rewritten_policy || ' ' || future_probe_query || ' ' || array_to_string(must_include, ' ') || ' ' || array_to_string(must_not_include, ' '), '_', ' ')) AS etext FROM prop0""",
)
table(
    "propv",
    f"""SELECT *, list_filter([CASE WHEN b = 8 THEN 'candidate_id_matches' END, CASE WHEN b = 9 THEN 'positive_event_ids_grounded' END,
    CASE WHEN requires_negative_evidence AND len(negative_event_ids) = 0 THEN 'negative_requirement_preserved' END, CASE WHEN b = 7 THEN 'allowed_actions_subset' END,
    CASE WHEN NOT {_any('must_include_terms')} THEN 'expected_behavior_covers_allowed_or_required_terms' END,
    CASE WHEN requires_negative_evidence AND NOT (contains(etext, 'default') AND (contains(etext, 'habit') OR contains(etext, 'assistant'))) THEN 'negative_example_not_converted_to_default_habit' END],
    lambda x: x IS NOT NULL) AS failed, CASE WHEN {_any('must_not_include_terms')} THEN '' ELSE 'expected_behavior_mentions_forbidden_terms' END AS warnings FROM prop""",
)


@query("validate_proposals", "SELECT row_no, proposal_id, annotation_id, candidate_id, len(failed) = 0 AS passed, array_to_string(failed, '|') AS failed_checks, warnings FROM propv")
def validate_proposals(spark, sf):
    tasks = staged(spark, sf).tasks
    return A.validate_proposals(proposals(spark, sf), tasks).select(
        "row_no", "proposal_id", "annotation_id", "candidate_id", "passed", F.array_join("failed_checks", "|").alias("failed_checks"),
        F.array_join("warnings", "|").alias("warnings"),
    )


@query(
    "boundary_subset",
    "SELECT annotation_id, b <> 7 AS allowed_actions_subset, true AS forbidden_actions_subset, true AS conditions_subset, true AS authorized_tools_subset FROM prop0",
)
def boundary_subset(spark, sf):
    tasks = staged(spark, sf).tasks
    rows = proposals(spark, sf).join(tasks.select("annotation_id", F.col("action_boundary").alias("task_boundary")), "annotation_id")
    checks = A.boundary_subset(F.col("action_boundary"), F.col("task_boundary"))
    names = ["allowed_actions_subset", "forbidden_actions_subset", "conditions_subset", "authorized_tools_subset"]
    return rows.select("annotation_id", *[checks[n].alias(n) for n in names])


@query("or_key_join", "SELECT pack_id AS pack, row_no FROM prop0")
def or_key_join(spark, sf):
    tasks = staged(spark, sf).tasks
    return A.match_packs(proposals(spark, sf), tasks)


@query(
    "pack_validation",
    """SELECT pack_id, count(*) AS annotation_tasks, count(*) AS proposals_total, count(*) FILTER (len(failed) = 0) AS proposals_passed, count(*) FILTER (len(failed) > 0) AS proposals_failed,
         0 AS missing_annotation_outputs, bool_and(len(failed) = 0) AS passed FROM propv GROUP BY pack_id""",
)
def pack_validation(spark, sf):
    tasks = staged(spark, sf).tasks
    rows = pinned(proposals(spark, sf))
    return A.pack_validation(A.validate_proposals(rows, tasks), tasks, A.match_packs(rows, tasks))


def returned(spark, sf):
    """Returned rows: hash 4 unfilled, 5 sent twice, 6 sent twice under a new id."""
    rows = proposals(spark, sf)
    blank = rows.withColumn("rewritten_policy", F.when(F.col("b") == 4, F.lit(" ")).otherwise(F.col("rewritten_policy")))
    twice = rows.filter("b = 5").withColumn("row_no", F.col("row_no") + 1)
    renamed = rows.filter("b = 6").withColumn("row_no", F.col("row_no") + 2).withColumn("proposal_id", F.concat("proposal_id", F.lit("_again")))
    return blank.unionByName(twice).unionByName(renamed)


@query(
    "collect_outputs",
    """SELECT row_no, proposal_id, annotation_id, CASE WHEN b = 4 THEN 'unfilled_proposal' ELSE 'collected' END AS state FROM prop0
       UNION ALL SELECT row_no + 1, proposal_id, annotation_id, 'duplicate_proposal_id' FROM prop0 WHERE b = 5
       UNION ALL SELECT row_no + 2, proposal_id || '_again', annotation_id, 'duplicate_annotation_output' FROM prop0 WHERE b = 6""",
)
def collect_outputs(spark, sf):
    return A.collect_outputs(returned(spark, sf)).select("row_no", "proposal_id", "annotation_id", "state")


@query(
    "dedupe_last_merge",
    """SELECT annotation_id, CASE WHEN b = 5 THEN row_no + 1 WHEN b = 6 THEN row_no + 2 ELSE row_no END AS row_no, CASE WHEN b = 6 THEN proposal_id || '_again' ELSE proposal_id END AS proposal_id,
         CASE WHEN b <> 3 THEN annotation_id END AS prompt_no FROM prop0""",
)
def dedupe_last_merge(spark, sf):
    rows = returned(spark, sf).select("row_no", "annotation_id", "proposal_id")
    order = proposals(spark, sf).filter("b <> 3").select("annotation_id", F.col("annotation_id").alias("prompt_no"))
    return A.merge_by_prompt_order(order, rows).select("annotation_id", "row_no", "proposal_id", "prompt_no")


@query(
    "normalize_model_output",
    f"""SELECT prompt_id, b <> 3 AS parsed, CASE WHEN b <> 3 THEN p.annotation_id END AS annotation_id, CASE WHEN b <> 3 THEN p.task_candidate END AS candidate_id,
         CASE WHEN b = 3 THEN NULL WHEN b % 2 = 0 THEN 'proposal_' || p.task_candidate ELSE 'model_' || b END AS proposal_id, CASE WHEN b <> 3 THEN p.policy END AS rewritten_policy,
         CASE WHEN b = 3 THEN '' ELSE concat_ws('|', CASE WHEN b = 8 THEN 'candidate_id' END, CASE WHEN b % 2 = 0 THEN 'proposal_id' END, 'positive_event_ids', 'negative_event_ids', 'expected_behavior') END AS coercions
       FROM prop0 p JOIN (SELECT annotation_id, 'prompt_' || annotation_id AS prompt_id FROM task) USING (annotation_id)""",
)
def normalize_model_output(spark, sf):
    rows = proposals(spark, sf).join(staged(spark, sf).tasks.select("annotation_id", "policy"), "annotation_id")
    as_json = F.to_json(
        F.struct(
            F.when(F.col("b") % 2 == 1, F.concat(F.lit("model_"), "b")).alias("proposal_id"), "annotation_id", "candidate_id",
            F.col("policy").alias("rewritten_policy"),
        )
    )
    text = (
        F.when(F.col("b") == 3, F.lit("I cannot do that."))
        .when(F.col("b") < 5, F.concat(F.lit("```json\n"), as_json, F.lit("\n```")))
        .otherwise(F.concat(F.lit("Here it is: "), as_json))
    )
    outputs = rows.select(F.concat(F.lit("prompt_"), "annotation_id").alias("prompt_id"), text.alias("text"))
    return A.normalize_output(outputs, prompts(spark, sf)).select(
        "prompt_id", "parsed", "annotation_id", "candidate_id", "proposal_id", "rewritten_policy", F.array_join("coercions", "|").alias("coercions")
    )
