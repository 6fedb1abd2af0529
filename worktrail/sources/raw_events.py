"""Raw public event records: JSON readers and the projections onto canonical events."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrail.functions.ids import content_hash, iso_seconds, safe_id
from worktrail.operators.ordering import group_positions, top_rows
from worktrail.schemas import RAW_EVENT, SECTION_KEYS

# Raw event types and the names they get.
EVENT_TYPE_NAMES = {
    "PullRequestEvent": "github_pull_request",
    "PullRequestReviewEvent": "github_pr_review",
    "PullRequestReviewCommentEvent": "github_pr_review_comment",
    "IssueCommentEvent": "github_issue_comment",
    "IssuesEvent": "github_issue",
    "CheckRunEvent": "github_ci_status",
    "CheckSuiteEvent": "github_ci_status",
    "StatusEvent": "github_ci_status",
    "WorkflowRunEvent": "github_ci_status",
    "PushEvent": "github_push",
    "CommitCommentEvent": "github_commit_comment",
}
ADAPTER_TYPES = list(EVENT_TYPE_NAMES)
LIGHT_TYPES = [t for t in ADAPTER_TYPES if t != "PushEvent"]
PR_TYPES = ["github_pull_request", "github_pr_review", "github_pr_review_comment"]
SOURCE_DATASET = "gharchive"
EVENT_LICENSE = "GitHub public event stream; repository licenses vary"


#: Bits of ``ord`` for the place in a file: files up to a terabyte, and eight million of them.
PLACE_BITS = 40


def _placed(rows: DataFrame) -> DataFrame:
    """Adds the file of each row and ``place``, which grows inside the file: where its split
    begins plus the row's place in its task. A split holds fewer rows than bytes and a task
    no more bytes than a split, so splits never overlap; gzip files have one split only."""
    place = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return rows.select("*", F.col("_metadata.file_path").alias("source_file"), place.alias("place"))


def read_raw_events(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines, gzip or not, and .json files that hold lines, one object or an array.

    Malformed JSON raises. ``ord`` orders rows by file name and place in the file, whatever
    the split settings.
    """

    def below(glob: str):
        return spark.read.option("recursiveFileLookup", "true").option("mode", "FAILFAST").option("pathGlobFilter", glob)

    lines = _placed(below("*.{jsonl,gz}").schema(RAW_EVENT).json(path))
    # A .json file holds lines if its first line that isn't blank is a whole object.
    texts = _placed(below("*.json").text(path)).filter(F.trim("value") != "")
    whole = F.trim("value").startswith("{") & F.try_parse_json(F.col("value")).isNotNull()
    kinds = top_rows(texts.select("source_file", "place", whole.alias("as_lines")), ["source_file"], [F.col("place")], 1)
    # The test stands inside the expression too, or a filter on a field would parse all lines.
    line = F.when(F.col("as_lines"), F.col("value"))
    parsed = texts.join(kinds.filter("as_lines").select("source_file", "as_lines"), "source_file")
    parsed = parsed.select(F.from_json(line, RAW_EVENT, {"mode": "FAILFAST"}).alias("r"), "source_file", "place").select("r.*", "source_file", "place")
    documents = _placed(below("*.json").schema(RAW_EVENT).option("multiLine", "true").json(path)).join(
        kinds.filter("not as_lines").select("source_file"), "source_file", "left_semi"
    )
    rows = lines.unionByName(parsed).unionByName(documents)
    # Files are ranked by name in a table of their own; the rank fills the upper bits.
    named = F.regexp_replace(F.col("_metadata.file_path"), "^[a-z]+:/+", "/").alias("file_name")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jsonl,gz,json}").load(path).select(named)
    ranks = group_positions(files.withColumn("all", F.lit(0)), ["all"], ["file_name"]).select(F.col("pos").alias("file_rank"), "file_name")
    ranked = rows.join(ranks, F.regexp_replace("source_file", "^[a-z]+:/+", "/") == F.col("file_name"))
    return (
        ranked.withColumn("ord", F.shiftleft("file_rank", PLACE_BITS) + F.col("place"))
        .drop("file_rank", "file_name", "place")
        .filter("type is not null or id is not null or repo is not null or payload is not null")
    )


def _text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def event_type_name(raw_type: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in EVENT_TYPE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, raw_type), F.lit("github_event"))


def _sections() -> str:
    """The present payload sections as one array, so that a rule over sections is stated
    once, each section enters the plan once, and absent ones cost no more than a test."""
    return (
        "array_compact(array(" + ", ".join(f"if(payload.{k} is null, null, named_struct('key', '{k}', 's', payload.{k}))" for k in SECTION_KEYS) + "))"
    )


def _names(items: str, key: str) -> str:
    """Names out of a list of plain strings or of objects read as JSON text."""
    return (
        f"filter(transform({items}, x -> if(startswith(x, '{{'), get_json_object(x, '$.{key}'), x)), "
        "x -> x is not null and x <> '')"
    )


def event_summary() -> Column:
    """One line per event: who did what, where, and what the payload says."""
    title = "coalesce(nullif(e.s.title, ''), nullif(e.s.name, ''), nullif(e.s.body, ''), nullif(e.s.state, ''))"
    labels, assignees = _names("e.s.labels", "name"), _names("e.s.assignees", "login")
    pieces = f"""concat_ws(', ',
        concat('number=', e.s.number),
        concat('title=', substring({title}, 1, 240)),
        if(e.s.body <> {title} and e.s.body <> '', concat('body=', substring(e.s.body, 1, 240)), null),
        if(size({labels}) > 0, concat('labels=', array_join(slice({labels}, 1, 8), '|')), null),
        if(size({assignees}) > 0, concat('assignees=', array_join(slice({assignees}, 1, 8), '|')), null),
        concat('assignee=', nullif(e.s.assignee.login, '')),
        concat('status=', coalesce(nullif(e.s.conclusion, ''), nullif(e.s.status, ''))))"""
    texts = f"transform({_sections()}, e -> transform(array({pieces}), p -> if(p <> '', concat(e.key, ': ', p), null))[0])"
    reference = "if(payload.ref <> '', concat('ref=', payload.ref), null)"
    # The reference stands in only where no section has any text.
    subject = f"transform(array({texts}), t -> if(size(array_compact(t)) > 0, t, array({reference})))[0]"
    return F.expr(
        f"""concat_ws('; ',
            concat(coalesce(nullif(actor.login, ''), 'unknown actor'), ' ', coalesce(type, 'None')),
            if(payload.action <> '', concat('action=', payload.action), null),
            concat('repo=', coalesce(nullif(repo.name, ''), 'unknown repo')),
            {subject})"""
    )


def event_claims(name: str = "event_type", action: str = "action") -> Column:
    prs = ", ".join(f"'{t}'" for t in PR_TYPES)
    return F.expr(
        f"""array_compact(array({name}, if({action} <> '', concat({name}, '_', {action}), null),
            if({name} = 'github_ci_status', 'ci_signal_observed', null),
            if({name} in ({prs}), 'pr_workflow_signal', null)))"""
    )


def event_entities() -> Column:
    """Sorted distinct names around the event: repository, people, states."""
    return F.expr(
        f"""array_sort(array_distinct(array_compact(concat(
            array(nullif(repo.name, ''), nullif(actor.login, '')),
            flatten(transform({_sections()}, e -> array(nullif(e.s.user.login, ''), e.s.author_association, e.s.state, e.s.conclusion)))))))"""
    )


def event_uri() -> Column:
    """Link of the first payload section that is present, even when it has none."""
    return F.expr(
        f"""get(transform({_sections()},
            e -> coalesce(nullif(e.s.html_url, ''), nullif(e.s.url, ''))), 0)"""
    )


def _record_id() -> Column:
    stem = F.regexp_replace(F.element_at(F.split(F.col("source_file"), "/"), -1), r"\.[^.]*$", "")
    return safe_id(F.coalesce(_text(F.col("id")), F.concat(stem, F.lit("_"), F.col("ord").cast("string"))))


def light_events(raw: DataFrame) -> DataFrame:
    """The narrow table that profiles, windows and rule mining read."""
    return raw.filter(
        F.col("type").isin(LIGHT_TYPES)
        & _text(F.col("repo.name")).isNotNull()
        & _text(F.col("created_at")).isNotNull()
    ).select(
        F.col("repo.name").alias("repo"),
        F.to_timestamp("created_at").alias("ts"),
        "ord",
        F.concat(F.lit(f"event_{SOURCE_DATASET}_"), _record_id()).alias("event_id"),
        F.coalesce(_text(F.col("actor.login")), F.lit("unknown_github_actor")).alias("actor"),
        event_type_name(F.col("type")).alias("event_type"),
        event_summary().alias("content"),
        F.col("payload.action").alias("action"),
    ).select("repo", "ts", "ord", "event_id", "actor", "event_type", "content", event_claims().alias("claims"))


def canonical_events(
    raw: DataFrame, project_id: Column, repo: str | None = None, actor: str | None = None, max_records: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Artifact rows and event rows of accepted records, both from one projection."""
    kept = raw.filter(F.col("type").isin(ADAPTER_TYPES))
    if repo:
        kept = kept.filter(F.col("repo.name") == repo)
    if actor:
        kept = kept.filter(F.col("actor.login") == actor)
    if max_records:
        placed = group_positions(kept.withColumn("all", F.lit(0)), ["all"], ["source_file", "ord"])
        kept = placed.filter(F.col("pos") < max_records).drop("all", "pos", "group_rows")
    record = F.to_json(F.struct("actor", "created_at", "id", "payload", "repo", "type"))
    base = kept.select(
        project_id.alias("project_id"),
        "ord",
        _record_id().alias("record_id"),
        event_type_name(F.col("type")).alias("event_type"),
        event_summary().alias("content"),
        F.concat(F.col("source_file"), F.lit("#"), F.col("ord").cast("string")).alias("raw_pointer"),
        content_hash(record).alias("content_hash"),
        event_uri().alias("uri"),
        event_entities().alias("entities"),
        F.to_timestamp("created_at").alias("ts"),
        F.coalesce(_text(F.col("actor.login")), F.lit("unknown_github_actor")).alias("actor"),
        F.col("repo.name").alias("repo"),
        F.col("type").alias("raw_type"),
        F.col("payload.action").alias("action"),
    ).withColumn("claims", event_claims())
    artifact_id = F.concat(F.lit(f"artifact_{SOURCE_DATASET}_"), F.col("record_id"))
    artifacts = base.select(
        "project_id",
        artifact_id.alias("artifact_id"),
        F.lit(SOURCE_DATASET).alias("source_dataset"),
        F.col("event_type").alias("artifact_type"),
        "uri",
        F.lit(EVENT_LICENSE).alias("license"),
        "content_hash",
        "raw_pointer",
        "content",
        F.create_map(F.lit("repo"), F.col("repo"), F.lit("action"), F.col("action"), F.lit("github_event_type"), F.col("raw_type")).alias(
            "metadata"
        ),
    )
    empty = F.array().cast("array<string>")
    events = base.select(
        F.concat(F.lit(f"event_{SOURCE_DATASET}_"), F.col("record_id")).alias("event_id"),
        "project_id",
        "ts",
        iso_seconds(F.col("ts")).alias("timestamp"),
        "ord",
        F.lit(SOURCE_DATASET).alias("source_dataset"),
        "actor",
        "event_type",
        "content",
        F.array(artifact_id).alias("artifacts"),
        "raw_pointer",
        F.array(F.lit("github"), F.lit("public_workflow"), F.col("event_type")).alias("project_tags"),
        "entities",
        "claims",
        empty.alias("causal_links"),
        empty.alias("supersedes"),
        empty.alias("invalidates"),
        F.lit(None).cast("string").alias("validity"),
        "repo",
        F.create_map(F.lit("repo"), F.col("repo"), F.lit("github_event_type"), F.col("raw_type")).alias("metadata"),
    )
    return artifacts, events
