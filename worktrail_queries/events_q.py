"""Scans, canonical events and their projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from worktrail.functions.ids import iso_seconds
from worktrail.sources import raw_events as R
from worktrail_queries.inputs import canonical, fresh_light, raw
from worktrail_queries.registry import query
from worktrail_queries.sqlkit import iso


@query("event_type_normalize", "SELECT raw_type, event_type, count(*) AS n FROM ev GROUP BY 1, 2")
def event_type_normalize(spark, sf):
    records = raw(spark, sf)
    return records.groupBy(F.col("type").alias("raw_type"), R.event_type_name(F.col("type")).alias("event_type")).agg(
        F.count("*").alias("n")
    )


@query("event_summary", "SELECT event_id, content FROM ev")
def event_summary(spark, sf):
    return fresh_light(spark, sf).select("event_id", "content")


@query("event_claims", "SELECT event_id, array_to_string(claims, '|') AS claims FROM ev")
def event_claims(spark, sf):
    return fresh_light(spark, sf).select("event_id", F.array_join("claims", "|").alias("claims"))


@query("event_entities", "SELECT CAST(ord AS VARCHAR) AS id, array_to_string(entities, '|') AS entities FROM entities")
def event_entities(spark, sf):
    return raw(spark, sf).select("id", F.array_join(R.event_entities(), "|").alias("entities"))


@query(
    "event_uri",
    """SELECT CAST(ord AS VARCHAR) AS id, CASE WHEN raw_type IN ('PullRequestEvent', 'IssuesEvent', 'IssueCommentEvent', 'CommitCommentEvent')
         THEN 'https://example.org/' || ord END AS uri FROM ev""",
)
def event_uri(spark, sf):
    return raw(spark, sf).select("id", R.event_uri().alias("uri"))


@query(
    "canonicalize_events",
    f"""SELECT event_id, 'project_gharchive_org_repo_' || user_id AS project_id, {iso('ts')} AS timestamp, 'gharchive' AS source_dataset,
          actor, event_type, content, artifact_id, 'github|public_workflow|' || event_type AS project_tags,
          array_to_string(claims, '|') AS claims, array_to_string(entities, '|') AS entities, repo,
          event_type AS artifact_type, 64 AS hash_length
        FROM ev JOIN entities USING (ord)""",
)
def canonicalize_events(spark, sf):
    artifacts, events = canonical(spark, sf)
    hashed = artifacts.select("artifact_id", "artifact_type", F.length("content_hash").alias("hash_length"))
    return (
        events.withColumn("artifact_id", F.col("artifacts")[0])
        .join(hashed, "artifact_id")
        .select(
            "event_id", "project_id", "timestamp", "source_dataset", "actor", "event_type", "content", "artifact_id",
            F.array_join("project_tags", "|").alias("project_tags"), F.array_join("claims", "|").alias("claims"),
            F.array_join("entities", "|").alias("entities"), "repo", "artifact_type", "hash_length",
        )
    )


@query(
    "light_events",
    f"SELECT repo, {iso('ts')} AS timestamp, ord, event_id, actor, event_type, content, array_to_string(claims, '|') AS claims FROM ev",
)
def light_events(spark, sf):
    return fresh_light(spark, sf).select(
        "repo", iso_seconds(F.col("ts")).alias("timestamp"), "ord", "event_id", "actor", "event_type", "content",
        F.array_join("claims", "|").alias("claims"),
    )
