"""Retrieval and predictors over project events; the check SQL scores every pair."""

from __future__ import annotations

from pyspark.sql import functions as F

from worktrail.functions.ids import exact_round
from worktrail.operators import predictors as D
from worktrail.operators import retrieval as R
from worktrail_queries.gold import gold
from worktrail_queries.registry import query
from worktrail_queries.sqlkit import iso, rnd, sql_list, table, toks

table(
    "pev",
    f"""SELECT project_id, evtext.*, {iso('ts')} AS stamp, list_distinct({toks('search_text')}) AS sw, list_distinct({toks('public_text')}) AS pw
FROM evtext JOIN proj USING (repo)""",
)
table("ptok", f"SELECT project_id, probe_id, query, list_distinct({toks('query')}) AS qw FROM probe")
table(
    "recency",
    """SELECT project_id, event_id, pos, pos / greatest(1, n - 1) AS recency FROM (SELECT project_id, event_id,
  row_number() OVER (PARTITION BY project_id ORDER BY ts, ord) - 1 AS pos, count(*) OVER (PARTITION BY project_id) AS n FROM pev)""",
)
table(
    "later",
    """SELECT project_id, event_id, least(10, rank() OVER (PARTITION BY project_id ORDER BY stamp DESC) - 1) AS later FROM pev""",
)
_temporal = sql_list(R.TEMPORAL_WORDS)
table(
    "pairs",
    f"""SELECT p.project_id, p.probe_id, e.event_id, e.ord, e.ts, e.stamp, len(list_intersect(qw, sw)) / len(qw) AS lex, len(list_intersect(qw, pw)) / len(qw) AS plex,
  len(list_intersect(list_intersect(qw, pw), {sql_list(R.SIGNAL_WORDS)})) AS sig, recency, later,
  CASE WHEN list_has_any(qw, {_temporal}) THEN 0.1e0 ELSE 0e0 END AS qbonus,
  CASE WHEN contains(lower(search_text), 'exception') THEN 0.15e0 ELSE 0e0 END AS ebonus
FROM ptok p JOIN pev e ON p.project_id = e.project_id JOIN recency r ON r.project_id = e.project_id AND r.event_id = e.event_id
JOIN later l ON l.project_id = e.project_id AND l.event_id = e.event_id""",
)


def _topk(name: str, score: str, key: str) -> None:
    table(
        name,
        f"""SELECT project_id, probe_id, event_id, score, row_number() OVER (PARTITION BY project_id, probe_id ORDER BY score DESC, {key} DESC, ord) AS rank
FROM (SELECT *, max(score) OVER (PARTITION BY project_id, probe_id) AS top FROM (SELECT *, {score} AS score FROM pairs))
WHERE score > 0 OR top <= 0 QUALIFY rank <= 5""",
    )


_topk("tk_lexical", "lex", "ts")
_topk("tk_temporal", "((lex + 0.15e0 * recency) + ebonus) + qbonus", "ts")
_topk("tk_sub_raw", "plex", "stamp")
_topk("tk_sub_temporal", "plex - 0.05e0 * later", "stamp")
_topk("tk_signal", "plex + 0.05e0 * sig", "stamp")


def _register(name, source, fn):
    @query(name, f"SELECT project_id, probe_id, event_id, {rnd('score', 6)} AS score, rank FROM {source}")
    def run(spark, sf):
        g = gold(spark, sf)
        return fn(g.events, g.probes).withColumn("score", exact_round(F.col("score"), 6))


_register("topk_lexical", "tk_lexical", R.topk_lexical)
_register("topk_temporal", "tk_temporal", R.topk_temporal)
_register("topk_submission_raw", "tk_sub_raw", R.topk_submission_raw)
_register("topk_submission_temporal", "tk_sub_temporal", R.topk_submission_temporal)
_register("topk_signal_boost", "tk_signal", R.topk_signal_boost)


@query("recency_rank", f"SELECT project_id, event_id, pos, {rnd('recency', 6)} AS recency FROM recency")
def recency_rank(spark, sf):
    return R.recency(gold(spark, sf).events).select(
        "project_id", "event_id", "pos", exact_round(F.col("recency"), 6).alias("recency")
    )


@query("later_event_penalty", "SELECT project_id, event_id, later, 0.05e0 * later AS penalty FROM later")
def later_event_penalty(spark, sf):
    return R.later_penalty(gold(spark, sf).events).select("project_id", "event_id", "later", "penalty")


table(
    "profdims",
    """SELECT project_id, ord, 'repos' AS dimension, repo AS value, 0 AS i FROM pev
UNION ALL SELECT project_id, ord, 'top_labels', label, 0 FROM pev WHERE event_type = 'github_issue'
UNION ALL SELECT project_id, ord, 'top_labels', 'assignee=' || replace(owner, '_', ' '), 1 FROM pev WHERE event_type = 'github_issue'
UNION ALL SELECT project_id, ord, 'top_assignees', owner, 0 FROM pev WHERE event_type = 'github_issue'
UNION ALL SELECT project_id, ord, 'top_actors', actor, 0 FROM pev
UNION ALL SELECT project_id, ord, 'workflow_signals', 'blocked', 0 FROM pev WHERE contains(lower(content), 'blocked')""",
)
table(
    "prof10",
    """SELECT project_id, dimension, value, n, row_number() OVER (PARTITION BY project_id, dimension ORDER BY n DESC, first_ord, first_i) AS rank
FROM (SELECT project_id, dimension, value, count(*) AS n, min(ord) AS first_ord, arg_min(i, ord * 10 + i) AS first_i FROM profdims GROUP BY ALL)
QUALIFY rank <= CASE WHEN dimension = 'repos' THEN 5 ELSE 10 END""",
)


@query("event_profile", "SELECT project_id, dimension, value, n, rank FROM prof10")
def event_profile(spark, sf):
    return R.event_profile(gold(spark, sf).events)


@query("predict_no_memory", f"SELECT 'no_memory' AS baseline, project_id, probe_id, 'pred_' || project_id || '_' || probe_id AS prediction_id, '{D.NO_MEMORY}' AS prediction FROM probe")
def predict_no_memory(spark, sf):
    return D.no_memory(gold(spark, sf).probes).drop("memory_ids")


@query(
    "predict_full_log",
    f"SELECT project_id, event_id, pos, artifact_id, {iso('ts')} || ' ' || event_id || ' ' || event_type || ': ' || content AS line FROM pev JOIN recency USING (project_id, event_id)",
)
def predict_full_log(spark, sf):
    g = gold(spark, sf)
    return D.full_log(g.events if "all_events" in vars(g) else g.log)


def rag_sql(source: str, head: str, line: str, baseline: str) -> str:
    return (
        f"SELECT '{baseline}' AS baseline, project_id, probe_id, '{head}' || chr(10) || string_agg({line}, chr(10) ORDER BY rank) AS prediction "
        f"FROM {source} JOIN pev USING (project_id, event_id) GROUP BY project_id, probe_id"
    )


def _boundary_lines() -> str:
    return (
        "'Policy ' || memory_id || ': ' || content || CASE WHEN len(allowed_actions) > 0 THEN "
        "chr(10) || 'Allowed actions: ' || translate(array_to_string(allowed_actions, ', '), '_-', '  ') || "
        "chr(10) || 'Forbidden actions: ' || translate(array_to_string(forbidden_actions, ', '), '_-', '  ') || "
        "chr(10) || 'Authorized tools: ' || array_to_string(authorized_tools, ', ') ELSE '' END"
    )


_uniq_ids = "list_filter(list_concat(positive, negative), lambda x, i: list_position(list_concat(positive, negative), x) = i)"
table(
    "oracle_mem",
    f"""SELECT project_id, probe_id, unnest(ids) AS memory_id, unnest(range(len(ids))) AS place FROM (SELECT project_id, probe_id, {_uniq_ids} AS ids FROM probe)""",
)
table("pred_raw", rag_sql("tk_lexical", D.RAW, "event_id || ': ' || content", "raw_rag"))
table("pred_temporal", rag_sql("tk_temporal", D.TEMPORAL, f"{iso('ts')} || ' ' || event_id || ' ' || event_type || ': ' || content", "temporal_raw_rag"))
table("pred_sub_raw", rag_sql("tk_sub_raw", D.RAW_INPUT, "event_id || ': ' || event_type || ' ' || content", "raw_event_rag_input"))
table("pred_sub_temporal", rag_sql("tk_sub_temporal", D.TEMPORAL_INPUT, "stamp || ' ' || event_id || ' ' || event_type || ': ' || content", "temporal_event_rag_input"))
table(
    "pred_oracle",
    f"""SELECT 'oracle_policy_graph' AS baseline, project_id, probe_id, '{D.ORACLE}' || chr(10) || string_agg({_boundary_lines()}, chr(10) ORDER BY place) AS prediction
FROM oracle_mem JOIN mem USING (project_id, memory_id) GROUP BY project_id, probe_id""",
)


@query(
    "predict_oracle",
    """SELECT p.*, n AS retrieved_events FROM pred_oracle p JOIN
       (SELECT project_id, probe_id, count(DISTINCT event_id) AS n FROM oracle_mem JOIN mem_ev USING (project_id, memory_id) GROUP BY ALL) USING (project_id, probe_id)""",
)
def predict_oracle(spark, sf):
    g = gold(spark, sf)
    predictions, retrieved = D.oracle_graph(g.probes, g.memories, g.memory_events)
    counts = retrieved.groupBy("project_id", "probe_id").agg(F.count("*").alias("retrieved_events"))
    return predictions.join(counts, ["project_id", "probe_id"]).select("baseline", "project_id", "probe_id", "prediction", "retrieved_events")


def _lines(lines):
    return " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in lines)


@query(
    "predict_event_profile",
    f"""SELECT 'event_profile' AS baseline, project_id, probe_id, '{D.PROFILE}' || chr(10) || 'Future task: ' || any_value(query) || chr(10) ||
         'Induced policy/action profile:' || chr(10) || CASE WHEN probe_id LIKE '%storage' THEN {_lines(D.NEGATIVE_LINES)} || chr(10) || {_lines(D.MERGE_LINES)}
           WHEN probe_id LIKE '%ci_policy' THEN {_lines(D.MERGE_LINES)} ELSE '' END ||
         chr(10) || 'Retrieved no-gold workflow events:' || chr(10) || string_agg('- ' || event_id || ': ' || event_type || ' ' || content, chr(10) ORDER BY rank) AS prediction
       FROM tk_signal JOIN pev USING (project_id, event_id) JOIN probe USING (project_id, probe_id) WHERE probe_id NOT LIKE '%pr_actions' GROUP BY project_id, probe_id
       UNION ALL SELECT 'event_profile', project_id, probe_id, '{D.PROFILE}' || chr(10) || 'Future task: ' || any_value(query) || chr(10) || '{D.PROFILE_FALLBACK}' ||
         chr(10) || 'Retrieved no-gold workflow events:' || chr(10) || string_agg('- ' || event_id || ': ' || event_type || ' ' || content, chr(10) ORDER BY rank)
       FROM tk_signal JOIN pev USING (project_id, event_id) JOIN probe USING (project_id, probe_id) WHERE probe_id LIKE '%pr_actions' GROUP BY project_id, probe_id""",
)
def predict_event_profile(spark, sf):
    g = gold(spark, sf)
    predictions, _ = D.event_profile_predictions(g.events, g.probes)
    return predictions.select("baseline", "project_id", "probe_id", "prediction")


RELEASE_BASELINES = ["no_memory", "raw_rag", "full_event_log", "temporal_raw_rag", "oracle_policy_graph"]
table(
    "preds",
    f"""SELECT 'no_memory' AS baseline, project_id, probe_id, '{D.NO_MEMORY}' AS prediction FROM probe
UNION ALL SELECT * FROM pred_raw UNION ALL SELECT * FROM pred_temporal UNION ALL SELECT * FROM pred_oracle""",
)
table(
    "retr",
    """SELECT 'raw_rag' AS baseline, project_id, probe_id, event_id FROM tk_lexical
UNION ALL SELECT 'temporal_raw_rag', project_id, probe_id, event_id FROM tk_temporal
UNION ALL SELECT DISTINCT 'oracle_policy_graph', project_id, probe_id, event_id FROM oracle_mem JOIN mem_ev USING (project_id, memory_id)""",
)


@query(
    "run_predictors",
    """SELECT baseline, project_id, probe_id, prediction, coalesce(n, 0) AS retrieved_events FROM preds LEFT JOIN
       (SELECT baseline, project_id, probe_id, count(*) AS n FROM retr GROUP BY ALL) USING (baseline, project_id, probe_id)
       UNION ALL SELECT 'full_event_log', project_id, probe_id, NULL, n FROM probe JOIN (SELECT project_id, count(*) AS n FROM pev GROUP BY ALL) USING (project_id)""",
)
def run_predictors(spark, sf):
    """The full log retrieves all events of its project; they are counted, never listed."""
    g = gold(spark, sf)
    predictions, retrieved = D.run_predictors(RELEASE_BASELINES, g.events, g.probes, g.memories, g.memory_events)
    counts = retrieved.groupBy("baseline", "project_id", "probe_id").agg(F.count("*").alias("n"))
    logged = g.events.groupBy("project_id").agg(F.count("*").alias("logged"))
    rows = predictions.join(counts, ["baseline", "project_id", "probe_id"], "left").join(logged, "project_id", "left")
    found = F.when(F.col("baseline") == "full_event_log", F.col("logged")).otherwise(F.coalesce("n", F.lit(0)))
    return rows.select("baseline", "project_id", "probe_id", "prediction", found.alias("retrieved_events"))
