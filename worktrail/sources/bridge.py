"""Maps an analytics events table (event_id, ts, user_id, event_type, props) onto raw
public event records, so that every event operator can run over such a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrail.functions.ids import iso_wall, safe_condition
from worktrail.schemas import SECTION, SECTION_KEYS


def _section(when: str, **fields: str) -> str:
    """A payload section as SQL: null unless the row is of this kind."""
    values = ", ".join(
        f"'{f.name}', cast({fields.get(f.name, 'null')} as {f.dataType.simpleString()})" for f in SECTION.fields
    )
    return f"if({when}, named_struct({values}), null)"


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(spark.read.parquet(f"{sf_dir}/events.parquet"))


def from_table(events: DataFrame) -> DataFrame:
    """Batch or streaming rows of the events table as raw records."""
    base = events.selectExpr(
        "event_id",
        "ts",
        "user_id",
        "event_type as kind",
        "cast(get_json_object(props, '$.k') as bigint) as k",
    ).selectExpr(
        "*",
        """case when k <= 7 then 'Summary: small docs change, please review'
                when k <= 9 then 'Blocked: do not merge before approval'
                when k = 12 and user_id % 5 = 0 then 'Emergency hotfix merged before CI'
                when k between 14 and 19 then 'tl;dr looks fine'
                else 'Routine update' end as body""",
        """case kind when 'click' then 'IssueCommentEvent' when 'view' then 'PullRequestReviewEvent'
                when 'purchase' then 'PullRequestEvent' when 'signup' then 'IssuesEvent'
                when 'error' then if(user_id % 2 = 0, 'WorkflowRunEvent', 'CommitCommentEvent') end as type""",
        "concat('dev_', k % 7) as login",
        "concat('https://example.org/', event_id) as link",
    )
    label = "element_at(array('bug', 'docs', 'security', 'api'), cast(k % 4 + 1 as int))"
    sections = {
        "pull_request": _section(
            "type = 'PullRequestEvent'",
            number="event_id",
            title="concat('Change ', k)",
            body="body",
            state="if(k % 2 = 0, 'closed', 'open')",
            html_url="link",
            user="named_struct('login', login)",
        ),
        "issue": _section(
            "type = 'IssuesEvent'",
            number="event_id",
            title="body",
            body="body",
            labels=f"array(to_json(named_struct('name', {label})))",
            assignee="named_struct('login', concat('owner_', k % 3))",
            url="link",
        ),
        "review": _section("type = 'PullRequestReviewEvent'", body="body", state="if(k % 3 = 0, 'approved', 'commented')"),
        "comment": _section(
            "type in ('IssueCommentEvent', 'CommitCommentEvent')", body="body", author_association="'MEMBER'", html_url="link"
        ),
        "workflow_run": _section(
            "type = 'WorkflowRunEvent'", name="'ci'", status="'completed'", conclusion="if(k % 2 = 0, 'success', 'failure')"
        ),
    }
    action = """case type when 'IssueCommentEvent' then 'created' when 'PullRequestReviewEvent' then 'submitted'
        when 'PullRequestEvent' then if(k % 2 = 0, 'closed', 'opened')
        when 'IssuesEvent' then 'labeled' when 'WorkflowRunEvent' then 'completed' end"""
    parts = ", ".join(f"'{key}', {sections.get(key, f'cast(null as {SECTION.simpleString()})')}" for key in SECTION_KEYS)
    return base.select(
        F.expr("cast(event_id as string) as id"),
        "type",
        F.expr("named_struct('login', login) as actor"),
        F.expr("named_struct('name', concat('org/repo_', user_id)) as repo"),
        F.expr(f"named_struct('action', {action}, 'ref', cast(null as string), {parts}) as payload"),
        iso_wall(F.col("ts")).alias("created_at"),
        F.expr("concat('events/', kind) as source_file"),
        F.col("event_id").alias("ord"),
    )


def project_of(repo: Column) -> Column:
    return F.concat(F.lit("project_gharchive_"), safe_condition(repo))
