"""Plans, coverage, gates, result tables and slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from worktrail.functions.ids import split_of
from worktrail.operators import audits as U
from worktrail.operators import checks as C
from worktrail.operators import mining as M
from worktrail.operators import profile as P
from worktrail.operators import release as L
from worktrail.operators import scoring as S
from worktrail.operators import slices as Z
from worktrail.operators import tables as T
from worktrail.operators.annotation import release_tasks
from worktrail.plans import readiness as R
from worktrail.session import pinned
from worktrail_queries.annotation_q import pack_rows, staged
from worktrail_queries.audits_q import RULES, SAFE
from worktrail_queries.checks_q import split_consistency, verified
from worktrail_queries.gold import gold
from worktrail_queries.inputs import candidates, profile, raw, read, windows
from worktrail_queries.mining_q import split_sql
from worktrail_queries.registry import query
from worktrail_queries.retrieval_q import RELEASE_BASELINES
from worktrail_queries.scoring_q import scored, scored_submission
from worktrail_queries.sources_q import listed
from worktrail_queries.sqlkit import has_any, in_list, rnd, sql_list, table
from worktrail_queries.submissions import submission


def _stage_inputs(spark, sf):
    spans = P.repo_spans(windows(spark, sf))
    quality = P.quality_summary(profile(spark, sf))
    return quality, P.window_summary(windows(spark, sf), spans), spans, M.candidate_type_counts(candidates(spark, sf))


def _measures(limits) -> str:
    return f"""SELECT 'events' AS name, (SELECT count(*) FROM fl)::DOUBLE AS actual UNION ALL SELECT 'eligible_repos', (SELECT count(*) FROM prof WHERE eligible)
UNION ALL SELECT 'eligible_windows', (SELECT count(*) FROM win WHERE eligible) UNION ALL SELECT 'multi_window_repos', (SELECT count(*) FROM spans WHERE spans_multiple_windows)
UNION ALL SELECT 'longitudinal_span', (SELECT count(*) FROM spans WHERE span_days >= {limits['span_days']}) UNION ALL SELECT 'candidate_count', (SELECT count(*) FROM cand)
UNION ALL SELECT 'candidate_types', (SELECT count(DISTINCT candidate_type) FROM cand)"""


_p = R.PROFILES["paper"]
_need = {
    "events": _p["events"], "eligible_repos": _p["repos"], "candidate_count": _p["tasks"], "eligible_windows": _p["eligible_windows"],
    "multi_window_repos": _p["multi_window_repos"], "longitudinal_span": _p["long_repos"], "candidate_types": _p["candidate_types"],
}
_required = ", ".join(f"('{k}', {float(v)}::DOUBLE)" for k, v in _need.items())
table(
    "stage",
    f"""SELECT m.name AS "check", CASE WHEN actual >= required AND (m.name <> 'candidate_types' OR list_has_all((SELECT list(DISTINCT candidate_type) FROM cand), {sql_list(_p['required_types'])})) THEN 'pass' ELSE 'fail' END AS status,
  actual, required, greatest(0e0, required - actual) AS missing FROM ({_measures(_p)}) m JOIN (VALUES {_required}) r(name, required) ON r.name = m.name""",
)


@query("stage_plan", "SELECT * FROM stage")
def stage_plan(spark, sf):
    return R.stage_plan(*_stage_inputs(spark, sf), "paper")


@query(
    "stage_decision",
    """SELECT n = 0 AS ready_for_annotation_budget, CASE WHEN n = 0 THEN 'paper_scale_annotation' ELSE 'expand_or_restage_slice' END AS recommended_mode, blocking AS blocking_checks
       FROM (SELECT count(*) FILTER (status = 'fail') AS n, coalesce(string_agg("check", '|' ORDER BY "check") FILTER (status = 'fail'), '') AS blocking FROM stage)""",
)
def stage_decision(spark, sf):
    return R.decision(stage_plan(spark, sf), "paper")


table("rtask", "SELECT task.*, split FROM task JOIN pack USING (pack_id)")
table(
    "rstats",
    f"""SELECT *, 3 - nonempty_splits AS empty_splits, {rnd('CASE WHEN skipped_repos + packs > 0 THEN skipped_repos / (skipped_repos + packs) ELSE 0 END')} AS skipped_ratio,
  {rnd('dominant / tasks')} AS dominant_share FROM (SELECT (SELECT count(*) FROM pack) AS packs, (SELECT count(DISTINCT repo) FROM pack) AS repos, (SELECT count(*) FROM prof WHERE NOT eligible) AS skipped_repos,
  (SELECT count(*) FROM rtask WHERE split = 'train') AS train_tasks, (SELECT count(*) FROM rtask WHERE split = 'dev') AS dev_tasks, (SELECT count(*) FROM rtask WHERE split = 'test') AS test_tasks,
  (SELECT count(DISTINCT split) FROM rtask) AS nonempty_splits, (SELECT {rnd('max(n) / min(n)')} FROM (SELECT count(*) AS n FROM rtask GROUP BY split)) AS imbalance,
  (SELECT count(DISTINCT candidate_type) FROM rtask) AS candidate_types, (SELECT count(*) FROM rtask) AS tasks, (SELECT max(n) FROM (SELECT count(*) AS n FROM rtask GROUP BY candidate_type)) AS dominant)""",
)


def _release(spark, sf):
    tasks = staged(spark, sf).tasks
    packs = pack_rows(spark, sf)
    skipped = profile(spark, sf).filter(~F.col("eligible"))
    return R.release_stats(packs, release_tasks(tasks, packs), skipped), tasks


@query("release_stats", "SELECT * EXCLUDE (dominant) FROM rstats")
def release_stats(spark, sf):
    return _release(spark, sf)[0]


_names = ["packs", "repos", "tasks", "nonempty_splits", "train_tasks", "dev_tasks", "test_tasks"]
_scale_rows = " UNION ALL ".join(f"SELECT '{n}' AS \"check\", {n}::DOUBLE AS actual, {float(_p[n])}::DOUBLE AS required, 'min' AS kind FROM rstats" for n in _names)
_scale_rows += f""" UNION ALL SELECT 'empty_splits', empty_splits, {float(_p['max_empty_splits'])}, 'max' FROM rstats UNION ALL SELECT 'skipped_ratio', skipped_ratio, {_p['max_skipped_ratio']}, 'max' FROM rstats
 UNION ALL SELECT 'candidate_types', (SELECT count(DISTINCT candidate_type) FROM task), {float(_p['candidate_types'])}, 'min'
 UNION ALL SELECT 'missing_required_types', {len(_p['required_types'])} - (SELECT count(DISTINCT candidate_type) FROM task WHERE candidate_type IN {in_list(_p['required_types'])}), 0, 'max'
 UNION ALL SELECT name, actual, CASE name WHEN 'events' THEN {_p['events']} WHEN 'eligible_repos' THEN {_p['repos']} WHEN 'eligible_windows' THEN {_p['eligible_windows']} ELSE {_p['multi_window_repos']} END, 'min' FROM ({_measures(_p)})
   WHERE name IN ('events', 'eligible_repos', 'eligible_windows', 'multi_window_repos')
 UNION ALL SELECT 'long_repos', actual, {_p['long_repos']}, 'min' FROM ({_measures(_p)}) WHERE name = 'longitudinal_span'
 UNION ALL SELECT 'split_imbalance', imbalance, 10, 'warn' FROM rstats UNION ALL SELECT 'dominant_type_share', dominant_share, 0.75, 'warn' FROM rstats"""
table(
    "scale",
    f"""SELECT "check", CASE WHEN kind = 'min' AND actual < required THEN 'fail' WHEN kind = 'max' AND actual > required THEN 'fail' WHEN kind = 'warn' AND actual > required THEN 'warn' ELSE 'pass' END AS status,
  actual, required::DOUBLE AS required, CASE WHEN kind = 'min' THEN greatest(0e0, required - actual) ELSE 0e0 END AS missing FROM ({_scale_rows})""",
)


@query("assess_scale", "SELECT * FROM scale")
def assess_scale(spark, sf):
    stats, tasks = _release(spark, sf)
    quality, windows, spans, _ = _stage_inputs(spark, sf)
    return R.assess_scale(stats, M.candidate_type_counts(tasks), quality, windows, spans, "paper")


# Coverage and gates -------------------------------------------------------------------------
_fam = "CASE task_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.TASK_FAMILIES.items()) + " ELSE task_type END"
table(
    "taxonomy",
    f"""SELECT dimension, value, count(*) AS n FROM (SELECT 'task_type' AS dimension, task_type AS value FROM probe UNION ALL SELECT 'task_family', {_fam} FROM probe
  UNION ALL SELECT 'split', {split_sql('repo')} FROM probe UNION ALL SELECT 'difficulty', difficulty FROM probe UNION ALL SELECT 'capability', unnest(capabilities) FROM probe
  UNION ALL SELECT 'metric', unnest(metrics) FROM probe UNION ALL SELECT 'event_source_dataset', 'gharchive' FROM pev UNION ALL SELECT 'event_type', event_type FROM pev
  UNION ALL SELECT 'raw_event_type', raw_type FROM pev UNION ALL SELECT 'artifact_source_dataset', 'gharchive' FROM pev UNION ALL SELECT 'artifact_type', event_type FROM pev
  UNION ALL SELECT 'memory_type', memory_type FROM mem) GROUP BY ALL""",
)


def _taxonomy(spark, sf):
    g = gold(spark, sf)
    projects = g.probes.select("project_id", "repo").distinct()
    artifacts = g.sources[1].join(projects.select("project_id"), "project_id", "left_semi")
    return R.taxonomy_counts(g.probes, g.events, artifacts, g.memories, projects.select("project_id", split_of(F.col("repo")).alias("split")))


@query("taxonomy_coverage", "SELECT * FROM taxonomy")
def taxonomy_coverage(spark, sf):
    return _taxonomy(spark, sf)


# Sources as discovered files: documents by source stand for manifests of a domain.
_KIND = """CASE doc_id % 8 WHEN 0 THEN 'email_workflow_manifest' WHEN 1 THEN 'docs_workflow_manifest' WHEN 2 THEN 'chat_workflow_requires_manifest' WHEN 3 THEN 'github_code_corpus_not_workflow'
  WHEN 4 THEN 'calendar_workflow_manifest' ELSE 'gharchive_public_events' END"""
_USABLE = "doc_id % 8 not in (2, 3) and lang <> 'fr'"
table("srcs", f"SELECT {_KIND} AS dataset_kind, {_USABLE} AS usable FROM documents")
_kinds = ", ".join(f"('{k}')" for k in [*R.SOURCE_DOMAINS, "github_code_corpus_not_workflow"])
table(
    "srca",
    f"""SELECT *, CASE code WHEN 'gharchive_source_missing' THEN 'fail' WHEN '' THEN 'pass' ELSE 'warn' END AS status FROM (SELECT *, CASE WHEN dataset_kind = 'gharchive_public_events' AND usable = 0 THEN 'gharchive_source_missing'
  WHEN dataset_kind = 'email_workflow_manifest' AND usable = 0 THEN 'email_manifest_missing' WHEN dataset_kind = 'github_code_corpus_not_workflow' AND found > 0 THEN 'github_code_corpus_not_workflow' ELSE '' END AS code
  FROM (SELECT k.dataset_kind, count(*) FILTER (s.usable) AS usable, count(s.usable) AS found FROM (VALUES {_kinds}) k(dataset_kind) LEFT JOIN srcs s ON s.dataset_kind = k.dataset_kind GROUP BY k.dataset_kind))""",
)


def _sources(spark, sf):
    return R.source_audit(read(spark, sf, "documents").selectExpr(f"{_KIND} as dataset_kind", f"{_USABLE} as usable"))


@query("source_audit", "SELECT * FROM srca")
def source_audit(spark, sf):
    return _sources(spark, sf)


def _gate_checks(spark, sf):
    """Check tables of several families: stage plan, scale, sources, verifier, splits."""
    verdict = verified(spark, sf).agg(F.bool_and("passed").alias("ok"), F.count("*").alias("n"))
    splits = split_consistency(spark, sf).agg(F.count("*").alias("n"))
    row = lambda df, family, check, ok: df.select(
        F.lit(family).alias("family"), F.lit(check).alias("check"), F.when(ok, "pass").otherwise("fail").alias("status")
    )
    return (
        stage_plan(spark, sf).select(F.lit("stage_plan").alias("family"), "check", "status")
        .unionByName(assess_scale(spark, sf).select(F.lit("scale").alias("family"), "check", "status"))
        .unionByName(_sources(spark, sf).select(F.lit("sources").alias("family"), F.col("dataset_kind").alias("check"), "status"))
        .unionByName(row(verdict, "release", "project_release", F.col("ok")))
        .unionByName(row(splits, "release", "splits", F.col("n") == 0))
    )


table(
    "gatechecks",
    """SELECT 'stage_plan' AS family, "check", status FROM stage UNION ALL SELECT 'scale', "check", status FROM scale UNION ALL SELECT 'sources', dataset_kind, status FROM srca
UNION ALL SELECT 'release', 'project_release', CASE WHEN bool_and(passed) THEN 'pass' ELSE 'fail' END FROM verified UNION ALL SELECT 'release', 'splits', CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END FROM split_issues""",
)


@query(
    "quality_gate_rollup",
    """SELECT count(*) AS checks_total, count(*) FILTER (status = 'pass') AS passed_checks, count(*) FILTER (status = 'warn') AS warnings, count(*) FILTER (status = 'fail') AS failed,
         coalesce(string_agg(family || '/' || "check", '|' ORDER BY family || '/' || "check") FILTER (status = 'fail'), '') AS blocking, count(*) FILTER (status = 'fail') = 0 AS passed FROM gatechecks""",
)
def quality_gate_rollup(spark, sf):
    return R.gate_rollup(_gate_checks(spark, sf))


_dom = ", ".join(f"('{d}', {sql_list(ts)}, '{s}')" for d, _, ts, s in R.DOMAINS)
table(
    "domcov",
    f"""SELECT domain, CASE WHEN count(t.value) > 0 THEN 'covered' ELSE any_value(absent) END AS status, CAST(coalesce(sum(n) FILTER (dimension = 'event_source_dataset'), 0) AS BIGINT) AS evidence_count,
  coalesce(string_agg(DISTINCT value, '|' ORDER BY value), '') AS matched FROM (VALUES {_dom}) d(domain, tokens, absent)
  LEFT JOIN (SELECT * FROM taxonomy WHERE dimension = 'event_source_dataset') t ON len(list_filter(tokens, lambda x: contains(lower(t.value), x))) > 0 GROUP BY domain""",
)


def _coverage(spark, sf):
    names = _taxonomy(spark, sf).filter("dimension = 'event_source_dataset'").select(F.lit("dataset").alias("kind"), F.col("value").alias("name"), "n")
    return R.domain_coverage(names)


@query("domain_coverage", "SELECT * FROM domcov")
def domain_coverage(spark, sf):
    return _coverage(spark, sf)


_map = ", ".join(f"('{k}', '{d}')" for k, d in R.SOURCE_DOMAINS.items())
_bad_rows = "+".join(
    [
        "(SELECT count(*) - count(DISTINCT prediction_id) FROM subm)", "(SELECT count(*) - count(DISTINCT (project_id, probe_id)) FROM subm)",
        "(SELECT count(*) FROM subm WHERE project_id NOT IN (SELECT project_id FROM proj) OR probe_id = 'probe_unknown' OR trim(prediction) = '')",
    ]
)
_unsafe = " OR ".join(f"regexp_matches(line, '(?i){p}')" for p in RULES.values())
# Release checks over the tables: everything but the submitted batch, the claims and the verifier
# passes by construction.
table(
    "relchecks",
    f"""WITH l AS (SELECT string_split(text, chr(10)) AS ls FROM documents), e AS (SELECT unnest(ls) AS line, unnest(range(len(ls))) AS i, ls FROM l),
        c AS (SELECT line, lower(array_to_string(ls[greatest(1, i):i + 2], chr(10))) AS context FROM e)
        SELECT (SELECT bool_and(passed) FROM verified) AS ver, {_bad_rows} = 0 AND (SELECT count(*) FROM (SELECT project_id, probe_id FROM probe EXCEPT SELECT project_id, probe_id FROM subm)) = 0 AS batch,
          NOT EXISTS (SELECT 1 FROM c WHERE ({_unsafe}) AND NOT {has_any('context', SAFE)}) AS claims""",
)


@query(
    "domain_gate_matrix",
    f"""WITH c AS (SELECT d.domain, d.status AS taxonomy_status, coalesce(usable, 0) AS sources, relchecks.* FROM domcov d JOIN (VALUES {_map}) m(kind, domain) USING (domain) LEFT JOIN srca ON srca.dataset_kind = m.kind, relchecks),
        g AS (SELECT domain, taxonomy_status, sources, sources > 0 AS reusable_trace_source, sources > 0 OR domain = 'github_developer_workflow' AS license_privacy_pii_gate, true AS canonical_event_adapter,
          taxonomy_status = 'covered' AND ver AS verifier_checked_project_release, taxonomy_status = 'covered' AS no_gold_submission_input, taxonomy_status = 'covered' AND batch AS baseline_and_external_runner_contract,
          taxonomy_status = 'covered' AND claims AS taxonomy_and_claim_boundary, taxonomy_status = 'covered' AND ver AS readiness_and_artifact_gate FROM c),
        b AS (SELECT *, {" AND ".join(R.GATES)} AS ready, concat_ws('|', {", ".join(f"CASE WHEN NOT {g} THEN '{g}' END" for g in R.GATES)}) AS blockers FROM g)
        SELECT *, CASE WHEN ready THEN 'current_release_ready' WHEN taxonomy_status = 'covered' THEN 'covered_but_release_gate_incomplete' WHEN domain = 'email_workflow' AND sources <= 0 THEN 'blocked_license_privacy_manifest'
            WHEN domain <> 'github_developer_workflow' AND sources > 0 THEN 'source_manifest_ready_release_pipeline_missing' ELSE 'planned_not_released' END AS status FROM b""",
)
def domain_gate_matrix(spark, sf):
    """Release checks of the release that the events make: its verdicts, public inputs, scores,
    the submitted batch, lines of the documents as claims, and the files of the bundle now and
    as recorded."""
    kinds = F.create_map(*[F.lit(x) for pair in R.SOURCE_DOMAINS.items() for x in pair])
    sources = _sources(spark, sf).select(F.try_element_at(kinds, F.col("dataset_kind")).alias("domain"), F.col("usable").alias("sources")).filter("domain is not null")
    # Predictors read whole events; written first, they are what all other steps read too.
    gold(spark, sf).all_events  # noqa: B018
    # Two readers each: verdicts and coverage are made once.
    verdict = pinned(verified(spark, sf).select("project_id", "passed"))
    covered = pinned(_coverage(spark, sf))
    probes = gold(spark, sf).probes
    public, template = L.submission_inputs(probes)
    rows = submission(spark, sf)
    files = listed(spark, sf)
    checks = R.release_checks(
        verdict, L.verify_submission_inputs(public, template), scored(spark, sf), probes, RELEASE_BASELINES, L.validate_predictions(rows, probes),
        L.coverage(rows, probes), covered, U.line_context_lint(read(spark, sf, "documents"), "doc_id", "text", RULES, SAFE),
        C.inventory_drift(files, listed(spark, sf), "name", ["bytes", "sha256"]),
    )
    return R.domain_matrix(R.domain_gates(covered, sources, checks, verdict.agg(F.bool_and("passed").alias("passed"))))


# Result tables ----------------------------------------------------------------------------
@query(
    "failure_table",
    f"""SELECT t.baseline AS system_name, l.label AS failure_label, coalesce(n, 0) AS count, {rnd('coalesce(n, 0) / greatest(1, predictions)')} AS rate FROM (SELECT baseline, count(*) AS predictions FROM scall GROUP BY ALL) t
        CROSS JOIN (SELECT unnest({sql_list(T.FAILURE_LABELS)}) AS label) l LEFT JOIN (SELECT baseline, label, count(*) AS n FROM (SELECT baseline, unnest(labels) AS label FROM scall) GROUP BY ALL) c
        ON c.baseline = t.baseline AND c.label = l.label""",
)
def failure_table(spark, sf):
    return T.failure_rows(scored(spark, sf))


_cols = "predictions, pass_rate, " + ", ".join(S.METRICS)


@query(
    "result_tables",
    f"""SELECT baseline AS system_name, 'task_type' AS group_type, task_type AS "group", {_cols} FROM by_task UNION ALL SELECT baseline, 'capability', capability, {_cols} FROM by_cap""",
)
def result_tables(spark, sf):
    rows = scored(spark, sf)
    tasks = T.breakdown(S.metrics_by_task_type(rows, "baseline"), "task_type")
    return tasks.unionByName(T.breakdown(S.metrics_by_capability(rows, "baseline"), "capability"))


_times = " + ".join(f"CASE WHEN draw >= {edge} THEN 1 ELSE 0 END" for edge in T._POISSON)
_sums = ", ".join(f"CAST(sum(times * CAST({m} AS DECIMAL(18,9))) AS DOUBLE) / sum(times) AS {m}" for m in T.INTERVAL_METRICS)
_cells = " UNION ALL ".join(
    f"SELECT baseline AS system_name, '{m}' AS metric, n_units, {rnd(f'b.{m}')} AS mean, {rnd(f'CASE WHEN n_units = 1 THEN b.{m} ELSE e.{m}_low END')} AS ci_low, {rnd(f'CASE WHEN n_units = 1 THEN b.{m} ELSE e.{m}_high END')} AS ci_high FROM bplain b JOIN bends e USING (baseline)"
    for m in T.INTERVAL_METRICS
)
table("bplain", f"SELECT baseline, count(*) AS n_units, {', '.join(f'CAST(sum(CAST({m} AS DECIMAL(18,9))) AS DOUBLE) / count(*) AS {m}' for m in T.INTERVAL_METRICS)} FROM repsub GROUP BY baseline")
table(
    "bdraws",
    f"""SELECT *, {_times} AS times FROM (SELECT *, CAST('0x' || substr(md5(concat_ws('|', '0', project_id, replicate)), 1, 8) AS BIGINT) AS draw
  FROM repsub, (SELECT unnest(range(1, 1001)) AS replicate))""",
)
table("bmeans", f"SELECT baseline, replicate, {_sums} FROM bdraws WHERE times > 0 GROUP BY baseline, replicate")
table("bends", f"SELECT baseline, {', '.join(f'quantile_cont({m}, 0.025) AS {m}_low, quantile_cont({m}, 0.975) AS {m}_high' for m in T.INTERVAL_METRICS)} FROM bmeans GROUP BY baseline")


@query("bootstrap_ci", _cells)
def bootstrap_ci(spark, sf):
    rows = scored_submission(spark, sf)
    report = S.project_report(rows, gold(spark, sf).probes, rows.select("baseline").distinct())
    return T.bootstrap_ci(report)


# Slices -------------------------------------------------------------------------------------
@query(
    "slice_events",
    """SELECT id, repo, type FROM (SELECT CAST(ord AS VARCHAR) AS id, repo, raw_type AS type, kind, ord, row_number() OVER (PARTITION BY repo ORDER BY 'events/' || kind, ord) AS rn FROM ev)
       WHERE rn <= 20 ORDER BY 'events/' || kind, ord LIMIT 2500""",
)
def slice_events(spark, sf):
    out = Z.slice_events(raw(spark, sf), max_records=2500, max_records_per_repo=20)
    return out.select("id", F.col("repo.name").alias("repo"), "type")


@query(
    "slice_manifest",
    """SELECT 'repo' AS dimension, repo AS value, count(*) AS n FROM (SELECT repo, raw_type, row_number() OVER (PARTITION BY kind ORDER BY ord) AS rn FROM ev) WHERE rn <= 700 GROUP BY repo
       UNION ALL SELECT 'type', raw_type, count(*) FROM (SELECT raw_type, row_number() OVER (PARTITION BY kind ORDER BY ord) AS rn FROM ev) WHERE rn <= 700 GROUP BY raw_type""",
)
def slice_manifest(spark, sf):
    return Z.slice_manifest(Z.slice_events(raw(spark, sf), max_records_per_file=700))
