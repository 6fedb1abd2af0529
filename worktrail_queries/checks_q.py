"""Referential checks, project verification, releases and submissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from worktrail.functions.ids import hash_bucket, split_of
from worktrail.operators import checks as C
from worktrail.operators import projects as J
from worktrail.operators import release as L
from worktrail.operators import verify as V
from worktrail.operators.ordering import top_rows
from worktrail_queries.functions_q import entry_sql
from worktrail_queries.gold import gold
from worktrail_queries.inputs import read
from worktrail_queries.mining_q import bucket_sql, split_sql
from worktrail_queries.registry import query
from worktrail_queries.sqlkit import rnd, sql_list, table
from worktrail_queries.submissions import submission

# Faults that follow from the data: some events link to a later, missing or unknown target,
# and projects by the hash of their id lose evidence.
_LINKS = {
    "causal_links": "CASE WHEN k = 13 THEN [pre || (ord + 3)] WHEN k = 21 THEN ['event_gone'] WHEN k % 10 = 0 AND ord >= 7 THEN [pre || (ord - 7)] ELSE [] END",
    "supersedes": "CASE WHEN k = 34 AND ord >= 1 THEN [pre || (ord - 1)] WHEN k = 35 THEN [pre || (ord + 1)] ELSE [] END",
    "invalidates": "CASE WHEN k = 55 THEN ['github_issue_labeled'] WHEN k = 56 THEN ['unknown_claim'] ELSE [] END",
}
table("linked", "SELECT ev.*, " + ", ".join(f"{v} AS {n}" for n, v in _LINKS.items()) + " FROM (SELECT *, 'event_gharchive_' AS pre FROM ev) ev")


def _spark_expr(sql: str) -> str:
    return (
        sql.replace("[pre || (ord + 3)]", "array(concat('event_gharchive_', ord + 3))")
        .replace("[pre || (ord - 7)]", "array(concat('event_gharchive_', ord - 7))")
        .replace("[pre || (ord - 1)]", "array(concat('event_gharchive_', ord - 1))")
        .replace("[pre || (ord + 1)]", "array(concat('event_gharchive_', ord + 1))")
        .replace("['event_gone']", "array('event_gone')")
        .replace("['github_issue_labeled']", "array('github_issue_labeled')")
        .replace("['unknown_claim']", "array('unknown_claim')")
        .replace("[]", "cast(array() as array<string>)")
    )


def linked(spark, sf):
    """Canonical events with links; all in one project, as the links cross repositories."""
    k = read(spark, sf, "events").selectExpr("event_id as ord", "cast(get_json_object(props, '$.k') as bigint) as k")
    events = gold(spark, sf).all_events.drop("causal_links", "supersedes", "invalidates").join(k, "ord")
    return events.withColumn("project_id", F.lit("corpus")).withColumns({n: F.expr(_spark_expr(v)) for n, v in _LINKS.items()})


table(
    "lev",
    """SELECT 'corpus' AS project_id, ord, event_id, ts, causal_links, supersedes, invalidates, claims FROM linked""",
)
table(
    "temporal_issues",
    """SELECT 'corpus' AS project_id, rel || CASE WHEN t.event_id IS NULL THEN ' references missing event' ELSE ' points to later event' END AS code, r.event_id AS subject, r.target
FROM (SELECT event_id, ts, 'causal_links' AS rel, unnest(causal_links) AS target FROM lev UNION ALL SELECT event_id, ts, 'supersedes', unnest(supersedes) FROM lev) r
LEFT JOIN ev t ON t.event_id = r.target WHERE t.event_id IS NULL OR t.ts > r.ts""",
)


@query("temporal_reference_check", "SELECT * FROM temporal_issues")
def temporal_reference_check(spark, sf):
    return C.temporal_references(linked(spark, sf))


# Gold tables with faults: projects of hash 3 name a missing source event, of hash 4 lose
# the positive evidence of one probe to an unknown memory, of hash 5 expect other words.
table("projb", f"SELECT project_id, {bucket_sql('project_id')} AS b FROM proj")
table(
    "fmem_ev",
    f"SELECT * FROM mem_ev UNION ALL SELECT project_id, '{J.ROUTING}', 'event_gone_' || project_id, 99 FROM projb WHERE b = 3",
)
table(
    "fprobe",
    """SELECT probe.* REPLACE (CASE WHEN b = 4 AND probe_id = 'probe_gharchive_docs_pr_actions' THEN ['memory_gone'] ELSE positive END AS positive,
  CASE WHEN b = 5 THEN ['unrelated words'] ELSE must_include END AS must_include, CASE WHEN b = 5 THEN ['nothing else'] ELSE must_not_include END AS must_not_include), b FROM probe JOIN projb USING (project_id)""",
)
table(
    "ref_issues",
    """SELECT project_id, 'references missing source event' AS code, memory_id AS subject, event_id AS target FROM fmem_ev WHERE event_id NOT IN (SELECT event_id FROM ev)
UNION ALL SELECT project_id, 'references missing memory', probe_id, m FROM (SELECT DISTINCT project_id, probe_id, unnest(list_concat(list_concat(positive, negative), distractor)) AS m FROM fprobe)
WHERE m NOT IN (SELECT memory_id FROM mem)
UNION ALL SELECT 'corpus', 'invalidates unknown target', event_id, t FROM (SELECT event_id, unnest(invalidates) AS t FROM lev) WHERE t NOT IN (SELECT event_id FROM ev)
  AND t NOT IN (SELECT unnest(claims) FROM ev)""",
)


def faulty(spark, sf):
    g = gold(spark, sf)
    b = hash_bucket(F.col("project_id"))
    lost = J.built(g.evidence).select("project_id").filter(b == 3).select(
        "project_id", F.lit(J.ROUTING).alias("memory_id"), F.lit(99).cast("bigint").alias("pos"),
        F.concat(F.lit("event_gone_"), "project_id").alias("event_id"),
    )
    hit = (b == 4) & (F.col("probe_id") == "probe_gharchive_docs_pr_actions")
    positive = F.when(hit, F.array(F.lit("memory_gone"))).otherwise(F.col("evidence.positive"))
    probes = g.probes.withColumn("evidence", F.col("evidence").withField("positive", positive))
    other = lambda column, phrase: F.when(b == 5, F.array(F.lit(phrase))).otherwise(F.col(column))
    probes = probes.withColumn("must_include", other("must_include", "unrelated words")).withColumn(
        "must_not_include", other("must_not_include", "nothing else")
    )
    return g, g.memory_events.unionByName(lost), probes


@query("reference_integrity", "SELECT * FROM ref_issues")
def reference_integrity(spark, sf):
    g, memory_events, probes = faulty(spark, sf)
    corpus = linked(spark, sf)
    events = g.events.select("project_id", "event_id", "artifacts", "claims", "invalidates").unionByName(
        corpus.select("project_id", "event_id", "artifacts", "claims", "invalidates")
    )
    artifacts = g.artifacts.select("project_id", "artifact_id").unionByName(
        g.artifacts.select(F.lit("corpus").alias("project_id"), "artifact_id")
    )
    return C.reference_integrity(events, artifacts, g.memories, memory_events, probes)


# Verification -------------------------------------------------------------------------------
_rows = ", ".join(
    f"('{t}', {sql_list(p)}::VARCHAR[], {sql_list(a)}::VARCHAR[], {n}, {d}, {i}, {f}, {ds}, {mp})".replace("True", "true").replace("False", "false")
    for t, p, a, n, d, i, f, ds, mp in V.CONTRACTS
)
table("contracts", f"SELECT * FROM (VALUES {_rows}) c(task_type, positive_types, any_types, needs_negative, needs_distractor, needs_invalidating, needs_future, min_datasets, min_positive)")
table(
    "fpm",
    """SELECT e.*, memory_type, future_score, negative_evidence, relations, allowed_actions, forbidden_actions, conditions, authorized_tools FROM (
  SELECT project_id, probe_id, 'positive' AS role, unnest(positive) AS memory_id FROM fprobe UNION ALL SELECT project_id, probe_id, 'negative', unnest(negative) FROM fprobe
  UNION ALL SELECT project_id, probe_id, 'distractor', unnest(distractor) FROM fprobe) e JOIN mem USING (project_id, memory_id)""",
)
table(
    "contract_facts",
    """SELECT p.*, c.* EXCLUDE (task_type), coalesce(n_positive, 0) AS n_positive, coalesce(have_positive, []) AS have_positive, coalesce(have_any, []) AS have_any, coalesce(has_future, false) AS has_future,
  coalesce(has_inv, false) AS has_inv, coalesce(datasets, 0) AS datasets FROM fprobe p JOIN contracts c USING (task_type) LEFT JOIN (SELECT project_id, probe_id, count(*) FILTER (role = 'positive') AS n_positive,
  list(DISTINCT memory_type) FILTER (role = 'positive') AS have_positive, list(DISTINCT memory_type) AS have_any, bool_or(role = 'positive' AND future_score IS NOT NULL) AS has_future,
  bool_or(len(negative_evidence) > 0 OR contains(relations, 'invalidates=')) AS has_inv FROM fpm GROUP BY ALL) f USING (project_id, probe_id)
LEFT JOIN (SELECT e.project_id, e.probe_id, 1 AS datasets FROM fpm e JOIN fmem_ev v ON v.project_id = e.project_id AND v.memory_id = e.memory_id JOIN ev ON ev.event_id = v.event_id WHERE role = 'positive' GROUP BY ALL) d USING (project_id, probe_id)""",
)
table(
    "contract_issues",
    """SELECT project_id, 'violates task contract' AS code, probe_id AS subject, unnest(list_filter([
    CASE WHEN n_positive < min_positive THEN 'too few positive memories' END, CASE WHEN NOT list_has_all(coalesce(have_positive, []), positive_types) THEN 'missing positive memory types' END,
    CASE WHEN NOT list_has_all(have_any, any_types) THEN 'missing evidence memory types' END, CASE WHEN needs_negative AND len(negative) = 0 THEN 'requires negative evidence' END,
    CASE WHEN needs_distractor AND len(distractor) = 0 THEN 'requires distractor evidence' END, CASE WHEN needs_future AND NOT has_future THEN 'requires future utility labels on positive evidence' END,
    CASE WHEN needs_invalidating AND NOT has_inv THEN 'requires evidence grounded in an invalidating event' END,
    CASE WHEN datasets < min_datasets THEN 'too few supporting source datasets' END], lambda x: x IS NOT NULL)) AS target FROM contract_facts""",
)
table(
    "align0",
    f"""SELECT project_id, probe_id, memory_id, kind, bool_or({entry_sql('entry', 'expected')}) AS hit FROM (
  SELECT f.project_id, f.probe_id, f.memory_id, translate(lower(array_to_string(must_include, ' ') || ' ' || array_to_string(must_not_include, ' ')), '_', ' ') AS expected, 'any' AS kind,
    unnest(list_concat(list_concat(allowed_actions, forbidden_actions), list_concat(authorized_tools, conditions))) AS entry FROM fpm f JOIN fprobe p ON p.project_id = f.project_id AND p.probe_id = f.probe_id WHERE role = 'positive'
  UNION ALL SELECT f.project_id, f.probe_id, f.memory_id, translate(lower(array_to_string(must_include, ' ') || ' ' || array_to_string(must_not_include, ' ')), '_', ' '), 'forbid',
    unnest(forbidden_actions) FROM fpm f JOIN fprobe p ON p.project_id = f.project_id AND p.probe_id = f.probe_id WHERE role = 'positive') GROUP BY ALL""",
)
table(
    "align_issues",
    """SELECT project_id, 'does not reflect action boundary' AS code, probe_id AS subject, memory_id AS target FROM align0 WHERE kind = 'any' AND NOT hit
UNION ALL SELECT project_id, 'does not cover forbidden action boundary', probe_id, '' FROM align0 WHERE kind = 'forbid' GROUP BY project_id, probe_id HAVING NOT bool_or(hit)""",
)


@query("task_contracts", "SELECT * FROM contract_issues")
def task_contracts(spark, sf):
    g, memory_events, probes = faulty(spark, sf)
    return V.contract_issues(probes, g.memories, memory_events, g.events)


@query("boundary_alignment", "SELECT * FROM align_issues")
def boundary_alignment(spark, sf):
    g, _, probes = faulty(spark, sf)
    return V.alignment_issues(probes, g.memories)


table("all_issues", "SELECT * FROM ref_issues WHERE project_id <> 'corpus' UNION ALL SELECT * FROM contract_issues UNION ALL SELECT * FROM align_issues")
_codes = lambda codes: "(" + ", ".join(f"'{c}'" for c in codes) + ")"
table(
    "verified",
    f"""SELECT p.project_id, p.probes, true AS schema_validity, coalesce(i.n, 0) AS issues, coalesce(i.n, 0) = 0 AS passed, true AS negative_evidence_present, true AS distractor_evidence_present, true AS multi_task_coverage,
  {", ".join(f"coalesce(i.{name}, 0) = 0 AS {name}" for name in V.CHECKS)}
FROM (SELECT project_id, count(*) AS probes FROM fprobe GROUP BY ALL) p LEFT JOIN (SELECT project_id, count(*) AS n, {", ".join(f"count(*) FILTER (code IN {_codes(c)}) AS {n}" for n, c in V.CHECKS.items())}
  FROM all_issues GROUP BY project_id) i USING (project_id)""",
)


def verified(spark, sf):
    g, memory_events, probes = faulty(spark, sf)
    return V.verify_projects(V.project_issues(*g.checked, g.memories, memory_events, probes), probes)


@query("verify_projects", "SELECT * FROM verified")
def verify_projects(spark, sf):
    return verified(spark, sf)


# Keys, sets, splits --------------------------------------------------------------------------
@query("unique_key_check", "SELECT text_hash, n FROM (SELECT sha256(text) AS text_hash, count(*) AS n FROM documents GROUP BY text) WHERE n > 1")
def unique_key_check(spark, sf):
    docs = read(spark, sf, "documents").select(F.sha2("text", 256).alias("text_hash"))
    return C.duplicate_keys(docs, "text_hash")


@query("set_equality", "SELECT doc_id, 'left_only' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right_only' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def set_equality(spark, sf):
    return C.set_difference(read(spark, sf, "documents"), read(spark, sf, "labels"), "doc_id")


table("projs", f"SELECT project_id, {split_sql('project_id')} AS split, b FROM projb")
table(
    "split_issues",
    """SELECT project_id, 'project_in_multiple_splits' AS code FROM projs WHERE b = 1 AND split <> 'test' UNION ALL SELECT project_id, 'duplicate_split_project_id' FROM projs WHERE b = 1
UNION ALL SELECT project_id || '_x', 'split_references_unknown_project' FROM projs WHERE b = 2 UNION ALL SELECT project_id, 'split_missing_manifest_project' FROM projs WHERE b = 2
UNION ALL SELECT project_id, 'split_project_assignment_mismatch' FROM projs WHERE b = 1 AND split <> 'test' UNION ALL SELECT project_id, 'probe_manifest_split_mismatch' FROM projs WHERE b = 5 AND split <> 'dev'
UNION ALL SELECT project_id, 'probe_count_per_project_mismatch' FROM projs WHERE b = 6""",
)


@query("split_consistency", "SELECT project_id, code FROM split_issues")
def split_consistency(spark, sf):
    """Split lists, manifest and probe rows that disagree by the hash of the project."""
    probes = gold(spark, sf).probes
    base = probes.select("project_id").distinct().withColumn("split", split_of(F.col("project_id"))).withColumn("b", hash_bucket(F.col("project_id")))
    named = F.when(F.col("b") == 2, F.concat("project_id", F.lit("_x"))).otherwise(F.col("project_id"))
    members = base.select(named.alias("project_id"), "split").unionByName(base.filter("b = 1").select("project_id", F.lit("test").alias("split")))
    manifest = base.select("project_id", "split", F.when(F.col("b") == 6, 4).otherwise(3).alias("probes"))
    rows = probes.select("project_id").join(base, "project_id").select(
        "project_id", F.when(F.col("b") == 5, "dev").otherwise(F.col("split")).alias("split")
    )
    return C.split_consistency(members, manifest, rows).select("project_id", "code")


@query(
    "inventory_drift",
    """SELECT CAST(doc_id AS VARCHAR) AS path, 'presence' AS field, CASE WHEN doc_id % 11 <> 3 THEN 'present' END AS recorded, CASE WHEN doc_id % 13 <> 5 THEN 'present' END AS current FROM documents
         WHERE (doc_id % 11 = 3) <> (doc_id % 13 = 5)
       UNION ALL SELECT CAST(doc_id AS VARCHAR), 'bytes', CAST(n_chars + 1 AS VARCHAR), CAST(n_chars AS VARCHAR) FROM documents WHERE doc_id % 11 <> 3 AND doc_id % 13 <> 5 AND doc_id % 17 = 2
       UNION ALL SELECT CAST(doc_id AS VARCHAR), 'sha256', sha256(text || ' '), sha256(text) FROM documents WHERE doc_id % 11 <> 3 AND doc_id % 13 <> 5 AND doc_id % 19 = 4""",
)
def inventory_drift(spark, sf):
    """A recorded inventory of the documents against the present one."""
    docs = read(spark, sf, "documents").withColumn("path", F.col("doc_id").cast("string"))
    recorded = docs.filter("doc_id % 11 <> 3").select(
        "path", F.when(F.col("doc_id") % 17 == 2, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("bytes"),
        F.sha2(F.when(F.col("doc_id") % 19 == 4, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("sha256"),
    )
    current = docs.filter("doc_id % 13 <> 5").select("path", F.col("n_chars").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    return C.inventory_drift(recorded, current, "path", ["bytes", "sha256"])


# Releases -----------------------------------------------------------------------------------
table(
    "rel_projects",
    f"""SELECT v.project_id, {split_sql('repo')} AS split, repo AS split_key, v.passed, v.probes FROM verified v JOIN proj USING (project_id)""",
)


def release_projects(spark, sf):
    g = gold(spark, sf)
    return L.release_projects(verified(spark, sf), J.built(g.evidence).select("project_id", "repo"))


@query("export_release", "SELECT r.project_id, probe_id, split, task_type, query, difficulty FROM rel_projects r JOIN probe USING (project_id) WHERE passed")
def export_release(spark, sf):
    return L.release_probes(release_projects(spark, sf), gold(spark, sf).probes).select(
        "project_id", "probe_id", "split", "task_type", "query", "difficulty"
    )


@query(
    "project_record",
    """SELECT r.project_id, split, split_key, passed AS verifier_passed, events, probes, 'contextual_workflow_policy_selection=1|negative_example_storage_gating=1|tool_action_policy_alignment=1' AS task_types,
         'contextual_policy_selection=1|habit_storage_gating=1|tool_action_alignment=2|workflow_boundary_respect=2' AS capabilities
       FROM rel_projects r JOIN (SELECT project_id, count(*) AS events FROM pev GROUP BY ALL) USING (project_id)""",
)
def project_record(spark, sf):
    g = gold(spark, sf)
    return L.project_records(release_projects(spark, sf), g.events, g.probes).select(
        "project_id", "split", "split_key", "verifier_passed", "events", "probes", "task_types", "capabilities"
    )


table("relb", "SELECT r.*, CAST(regexp_extract(project_id, '[0-9]+$') AS BIGINT) // 2 % 10 AS b FROM rel_projects r")
_PROJECT_FAULTS = {
    "split_missing_manifest_project": "b = 1", "probe_splits_manifest_mismatch": "b = 1 OR b = 6 AND split <> 'test'", "duplicate_split_project_id": "b = 3", "split_project_assignment_mismatch": "b = 6 AND split <> 'test'",
    "probe_count_per_project_mismatch": "b IN (2, 8, 9)", "project_file_hash_missing": "b = 3", "project_file_hash_mismatch": "b = 4", "project_release_file_missing": "b = 5",
    "project_dir_missing": "b = 0", "project_profile_id_mismatch": "b = 7", "project_verifier_not_passed": "NOT passed",
}
_PROBE_FAULTS = {"project_probe_split_field_mismatch": "b = 4 AND split <> 'train'", "probe_unknown_source_project": "b = 9", "duplicate_all_probe": "b = 8"}
_RELEASE_FAULTS = [
    "project_count_mismatch", "project_split_probe_total_mismatch", "project_split_probe_count_mismatch", "project_release_verifier_not_required",
    "project_release_unvalidated_llm_generation", "split_references_unknown_project",
]
_IF_ANY = {"project_probe_total_mismatch": "b = 2", "all_project_probe_count_mismatch": "b = 8", "all_project_probes_not_equal_split_union": "b = 1"}


@query(
    "verify_release",
    " UNION ALL ".join(
        [
            *[f"SELECT '{c}' AS code, count(*) AS n FROM relb WHERE {w} HAVING count(*) > 0" for c, w in _PROJECT_FAULTS.items()],
            *[f"SELECT '{c}', count(*) FROM relb JOIN probe USING (project_id) WHERE {w} HAVING count(*) > 0" for c, w in _PROBE_FAULTS.items()],
            *[f"SELECT '{c}', 1" for c in _RELEASE_FAULTS],
            *[f"SELECT '{c}', 1 FROM relb WHERE {w} HAVING count(*) > 0" for c, w in _IF_ANY.items()],
        ]
    ),
)
def verify_release(spark, sf):
    """The release of all projects with faults by the number of the project, and in its totals."""
    from worktrail.operators import release_checks as P

    b = F.col("b")
    probes = gold(spark, sf).probes.select("project_id", "probe_id")
    made = release_projects(spark, sf).select("project_id", "split", "verifier_passed").withColumn("b", F.expr("cast(regexp_extract(project_id, '([0-9]+)$', 1) as bigint) div 2 % 10"))
    counts = probes.groupBy("project_id").agg(F.count("*").alias("probes"))
    made = made.join(counts, "project_id")
    projects = made.withColumn("probes", F.when(b == 2, F.col("probes") + 1).otherwise(F.col("probes")))
    unknown = made.limit(1).select(F.lit("project_unknown").alias("project_id"), F.lit("test").alias("split"))
    members = made.filter("b <> 1").select("project_id", F.when(b == 6, "test").otherwise(F.col("split")).alias("split"))
    members = members.unionByName(made.filter("b = 3").select("project_id", "split")).unionByName(unknown)
    files = made.select("project_id", "b", F.explode(F.array(F.lit("events"), F.lit("profile"))).alias("file")).withColumn("sha256", F.sha2(F.concat("project_id", "file"), 256))
    profile = F.col("file") == "profile"
    listed = files.withColumn("sha256", F.when(~((b == 3) & profile), F.col("sha256"))).drop("b")
    found = files.filter(~((b == 0) | (b == 5) & ~profile)).select(
        "project_id", "file", F.when((b == 4) & profile, "other").otherwise(F.col("sha256")).alias("sha256"), F.when(profile, F.when(b == 7, "other").otherwise(F.col("project_id"))).alias("profile_id")
    )
    rows = probes.join(made.select("project_id", "split", "b"), "project_id").withColumn("project_id", F.when(b == 9, F.concat("project_id", F.lit("_gone"))).otherwise(F.col("project_id")))
    split_probes = rows.filter("b <> 1").withColumn("file_split", F.when(b == 4, "train").otherwise(F.col("split")))
    n = lambda s: F.count_if(F.col("file_split") == s)
    manifest = split_probes.agg((n("train") + 1).alias("train"), n("dev").alias("dev"), n("test").alias("test")).withColumns(
        {
            "projects": made.agg(F.count("*") + 1).scalar(), "probes": rows.agg(F.count("*")).scalar(),
            "verifier_required": F.lit(False), "generation_used": F.lit(True), "generation_validated": F.lit(False),
        }
    )
    release = P.ProjectRelease(manifest, projects, members, listed, found, split_probes, rows.unionByName(rows.filter("b = 8")))
    return P.project_release_issues(release).groupBy("code").agg(F.count("*").alias("n"))


# Submission inputs --------------------------------------------------------------------------
_q = lambda t: "'" + t.replace("'", "''") + "'"
_base = "'In a future ' || repo2 || ' workflow, infer the user''s policy from the provided longitudinal events and decide the compliant tool behavior.'"
table(
    "hard",
    f"""SELECT project_id, probe_id, task_type, {_base} || CASE task_type WHEN 'negative_example_storage_gating' THEN {_q(L.HARD_STORAGE)} WHEN 'contextual_workflow_policy_selection' THEN {_q(L.HARD_CONTEXT)}
  WHEN 'tool_action_policy_alignment' THEN {_q(L.HARD_ACTION)} END AS query
FROM (SELECT *, replace(substr(project_id, 19), '_', '/') AS repo2 FROM probe)""",
)


@query("fn_harden_query", "SELECT project_id, probe_id, query FROM hard")
def fn_harden_query(spark, sf):
    return gold(spark, sf).probes.select(
        "project_id", "probe_id", L.harden_query(F.col("project_id"), F.col("task_type"), F.col("query")).alias("query")
    )


@query(
    "export_submission_inputs",
    "SELECT project_id, probe_id, query, 'pred_' || project_id || '_' || probe_id AS prediction_id, '' AS prediction, 'original_query_hidden=true|query_hardened=true' AS metadata FROM hard",
)
def export_submission_inputs(spark, sf):
    public, template = L.submission_inputs(gold(spark, sf).probes, harden=True)
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")
    return public.join(template.select("project_id", "probe_id", "prediction_id", "prediction"), ["project_id", "probe_id"]).select(
        "project_id", "probe_id", "query", "prediction_id", "prediction", shown.alias("metadata")
    )


def _with_metadata(spark, sf):
    """Probes whose metadata still carries gold keys, by the hash of the project."""
    b = hash_bucket(F.col("project_id"))
    extra = F.when(b == 3, F.create_map(F.lit("gold"), F.lit("x"))).when(b == 4, F.create_map(F.lit("answer"), F.lit("y"), F.lit("note"), F.lit("z"))).otherwise(
        F.create_map(F.lit("note"), F.lit("z"))
    )
    return gold(spark, sf).probes.withColumn("metadata", extra)


@query("strip_gold_columns", "SELECT probe.project_id, probe_id, query, CASE WHEN b = 3 THEN '' ELSE 'note' END AS metadata_keys, false AS has_gold_column FROM probe JOIN projb USING (project_id)")
def strip_gold_columns(spark, sf):
    out = C.strip_gold(_with_metadata(spark, sf))
    return out.select(
        "project_id", "probe_id", "query", F.array_join(F.map_keys("metadata"), "|").alias("metadata_keys"),
        F.lit(bool({"evidence", "must_include", "must_not_include"} & set(out.columns))).alias("has_gold_column"),
    )


@query("forbidden_key_scan", "SELECT 'probes' AS \"table\", probe.project_id || '/' || probe_id AS row_key, '' AS top_level, CASE b WHEN 3 THEN 'gold' ELSE 'answer' END AS in_metadata FROM probe JOIN projb USING (project_id) WHERE b IN (3, 4)")
def forbidden_key_scan(spark, sf):
    rows = _with_metadata(spark, sf).withColumn("row_key", F.concat("project_id", F.lit("/"), "probe_id")).drop("evidence")
    return C.forbidden_keys(rows, "probes", "row_key")


@query(
    "verify_submission_inputs",
    """SELECT 'submission_input_gold_metadata_present' AS code, count(*) AS n FROM probe JOIN projb USING (project_id) WHERE b IN (3, 4)
       UNION ALL SELECT 'submission_template_missing_probe', count(*) FROM probe JOIN projb USING (project_id) WHERE b = 5
       UNION ALL SELECT 'submission_template_prediction_not_empty', count(*) FROM probe JOIN projb USING (project_id) WHERE b = 6""",
)
def verify_submission_inputs(spark, sf):
    """A template that lacks probes (hash 5) or holds text (hash 6)."""
    probes = _with_metadata(spark, sf).drop("evidence", "must_include", "must_not_include")
    _, template = L.submission_inputs(gold(spark, sf).probes)
    b = hash_bucket(F.col("project_id"))
    template = template.filter(b != 5).withColumn("prediction", F.when(b == 6, "text").otherwise(F.col("prediction")))
    return L.verify_submission_inputs(probes, template)


_sub = "(SELECT *, trim(prediction) = '' AS blank FROM subm)"


@query(
    "validate_predictions",
    f"""SELECT 'prediction_submission_duplicate_prediction_id' AS code, CAST(count(*) - count(DISTINCT prediction_id) AS BIGINT) AS n FROM subm
        UNION ALL SELECT 'prediction_submission_duplicate_probe', count(*) - count(DISTINCT (project_id, probe_id)) FROM subm
        UNION ALL SELECT 'prediction_submission_unknown_project', count(*) FROM subm WHERE project_id NOT IN (SELECT project_id FROM proj)
        UNION ALL SELECT 'prediction_submission_unknown_probe', count(*) FROM subm WHERE project_id IN (SELECT project_id FROM proj) AND probe_id = 'probe_unknown'
        UNION ALL SELECT 'prediction_submission_empty_prediction', count(*) FROM {_sub} WHERE blank
        UNION ALL SELECT 'prediction_submission_missing_probes', count(*) FROM (SELECT project_id, probe_id FROM probe EXCEPT SELECT project_id, probe_id FROM subm)""",
)
def validate_predictions(spark, sf):
    return L.validate_predictions(submission(spark, sf), gold(spark, sf).probes)


@query(
    "submission_coverage",
    f"""SELECT count(*) AS release_probes, count(s.project_id) AS covered_probes, {rnd('count(s.project_id) / greatest(1, count(*))')} AS probe_coverage FROM probe p
        LEFT JOIN (SELECT DISTINCT project_id, probe_id FROM subm) s USING (project_id, probe_id)""",
)
def submission_coverage(spark, sf):
    return L.coverage(submission(spark, sf), gold(spark, sf).probes)


@query(
    "dedupe_first",
    "SELECT row_no, prediction_id, project_id, probe_id FROM subm JOIN (SELECT project_id, probe_id FROM probe) USING (project_id, probe_id) QUALIFY row_number() OVER (PARTITION BY project_id, probe_id ORDER BY row_no) = 1",
)
def dedupe_first(spark, sf):
    keys = gold(spark, sf).probes.select("project_id", "probe_id")
    rows = submission(spark, sf).join(keys, ["project_id", "probe_id"], "left_semi")
    return top_rows(rows, ["project_id", "probe_id"], [F.col("row_no")], 1).select("row_no", "prediction_id", "project_id", "probe_id")
