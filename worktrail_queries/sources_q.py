"""Readers, manifests, mail, file inventories, sinks and plug-in predictors."""

from __future__ import annotations

from pyspark.sql import functions as F

from worktrail.functions.text import str_array
from worktrail.operators import plugins as G
from worktrail.operators import projects as J
from worktrail.operators import scoring as S
from worktrail.operators.checks import union_all
from worktrail.session import scratch_path
from worktrail.sources import files as X
from worktrail.sources import mail as E
from worktrail.sources import manifest_projects as P
from worktrail.sources import manifests as N
from worktrail.sources import raw_events as R
from worktrail.sources import sinks as K
from worktrail.schemas import MANIFEST_RECORD
from worktrail_queries.functions_q import redact_sql, tags_sql
from worktrail_queries.gold import gold
from worktrail_queries.inputs import raw, read
from worktrail_queries.registry import query
from worktrail_queries.scoring_q import _MEANS
from worktrail_queries.sqlkit import sql_list, table
from worktrail_queries.submissions import retrieved_ids, submission


@query("scan_events", "SELECT event_id, repo, actor, event_type, content FROM ev")
def scan_events(spark, sf):
    """The events as gzip JSON Lines, written beside the checkpoints and read back."""
    path = scratch_path(spark, "raw")
    records = raw(spark, sf).select("id", "type", "actor", "repo", "payload", "created_at")
    records.write.option("compression", "gzip").json(f"{path}/2024")
    return R.light_events(R.read_raw_events(spark, path)).select("event_id", "repo", "actor", "event_type", "content")


# Manifests ---------------------------------------------------------------------------------
# Mail: one manifest per documents.source. The number in the source decides license,
# redistribution and review, so that several manifests fail the gate.
_N = "CAST(replace(source, 'src', '') AS BIGINT)"
_PROBLEM = "CASE WHEN n % 5 = 4 THEN 'license unknown' WHEN n % 7 = 3 THEN 'redistribution not allowed' WHEN n % 6 = 5 THEN 'privacy review not passed' ELSE '' END"
table(
    "mmail",
    f"""SELECT doc_id, source, n, CASE WHEN doc_id % 50 = 7 THEN NULL ELSE '2024-01-01T00:00:00Z' END AS stamp, 'Subject: Note ' || doc_id || chr(10) || 'From: user' || doc_id % 10 || '@example.com' || chr(10) ||
  'To: a@example.org, desk' || chr(10) || text AS raw FROM (SELECT *, {_N} AS n FROM documents) WHERE n % 5 <> 4 AND n % 7 <> 3 AND n % 6 <> 5""",
)
table(
    "minge",
    f"""SELECT 'project_mail_' || source AS project_id, 'artifact_email_doc_' || doc_id AS artifact_id, 'event_email_doc_' || doc_id AS event_id, '[REDACTED_EMAIL]' AS actor, sha256(raw) AS content_hash,
  sha256({redact_sql('raw')}) AS redacted_hash, {tags_sql('raw')} AS tags0, doc_id FROM mmail WHERE stamp IS NOT NULL""",
)
table(
    "minge2",
    """SELECT * EXCLUDE (tags0), array_to_string(list_sort(list_distinct(list_filter(list_concat(string_split(tags0, '|'), CASE WHEN doc_id % 4 = 0 THEN ['reviewed'] ELSE [] END), lambda t: t <> ''))), '|') AS tags FROM minge""",
)


def mail_manifests(spark, sf):
    docs = read(spark, sf, "documents").withColumn("n", F.expr("cast(replace(source, 'src', '') as bigint)"))
    headers = docs.select("source", "n").distinct().select(
        F.concat(F.lit("set_"), "source").alias("dataset_name"),
        F.col("source").alias("source_dataset"),
        F.lit(None).cast("string").alias("domain"),
        F.when(F.col("n") % 5 == 4, "Unknown").otherwise("CC-BY-4.0").alias("license"),
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("project_goal"),
        F.concat(F.lit("project_mail_"), "source").alias("project_id"),
        F.struct((F.col("n") % 7 != 3).alias("allowed")).alias("redistribution"),
        F.struct(F.when(F.col("n") % 6 == 5, "pending").otherwise("passed").alias("status"), F.lit(True).alias("pii_redaction")).alias("privacy_review"),
    )
    records = docs.select(
        F.concat(F.lit("project_mail_"), "source").alias("project_id"),
        F.concat(F.lit("doc_"), "doc_id").alias("record_id"),
        F.when(F.col("doc_id") % 50 != 7, F.lit("2024-01-01T00:00:00Z")).alias("timestamp"),
        F.col("text").alias("content"),
        F.concat(F.lit("Note "), "doc_id").alias("subject"),
        F.concat(F.lit("user"), (F.col("doc_id") % 10).cast("string"), F.lit("@example.com")).alias("sender"),
        str_array(["a@example.org", "desk"]).alias("recipients"),
        F.when(F.col("doc_id") % 4 == 0, str_array(["reviewed"])).alias("privacy_tags"),
    )
    return headers, records


@query("ingest_email_manifest", "SELECT project_id, artifact_id, event_id, actor, content_hash, redacted_hash, tags FROM minge2")
def ingest_email_manifest(spark, sf):
    return N.ingest(*mail_manifests(spark, sf)).select(
        "project_id", "artifact_id", "event_id", "actor", "content_hash", F.sha2("content", 256).alias("redacted_hash"),
        F.array_join("privacy_tags", "|").alias("tags"),
    )


@query(
    "manifest_gate",
    """SELECT 'project_mail_' || source AS project_id, concat_ws('|', CASE WHEN n % 5 = 4 THEN 'license unknown' END, CASE WHEN n % 7 = 3 THEN 'redistribution not allowed' END,
         CASE WHEN n % 6 = 5 THEN 'privacy review not passed' END) AS reasons, n % 5 <> 4 AND n % 7 <> 3 AND n % 6 <> 5 AS accepted FROM (SELECT DISTINCT source, CAST(replace(source, 'src', '') AS BIGINT) AS n FROM documents)""",
)
def manifest_gate(spark, sf):
    headers, _ = mail_manifests(spark, sf)
    return N.manifest_issues(headers).select("project_id", F.array_join("reasons", "|").alias("reasons"), "accepted")


# Chat, calendar, documents and browser: conversations by conv_id, pages as browser records.
table(
    "mwork",
    f"""SELECT CASE conv_id % 3 WHEN 0 THEN 'chat_workflow' WHEN 1 THEN 'calendar_workflow' ELSE 'docs_workflow' END AS domain, 'turn_' || conv_id || '_' || turn AS record_id,
  'Actor: ' || role || chr(10) || 'Tool: inbox' || chr(10) || text AS raw, role AS actor FROM conversations
UNION ALL SELECT 'browser_web_workflow', 'page_' || page_id, 'Title: ' || url || chr(10) || 'Action: open' || chr(10) || html, 'unknown_workflow_actor' FROM pages""",
)


def work_manifests(spark, sf):
    goals = {d: s for d, s, *_ in N.DOMAINS}
    headers = spark.createDataFrame([(d,) for d in goals], "domain string").select(
        F.concat("domain", F.lit("_set")).alias("dataset_name"), F.concat("domain", F.lit("_source")).alias("source_dataset"), "domain",
        F.lit("CC0").alias("license"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("project_goal"),
        F.concat(F.lit("project_"), "domain").alias("project_id"), F.struct(F.lit(True).alias("allowed")).alias("redistribution"),
        F.struct(F.lit("passed").alias("status"), F.lit(True).alias("pii_redaction")).alias("privacy_review"),
    )
    kinds = F.element_at(str_array(["chat_workflow", "calendar_workflow", "docs_workflow"]), (F.col("conv_id") % 3 + 1).cast("int"))
    stamp, none = F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.lit(None).cast("string")
    turns = read(spark, sf, "conversations").select(
        F.concat(F.lit("project_"), kinds).alias("project_id"), F.concat_ws("_", F.lit("turn"), "conv_id", "turn").alias("record_id"), stamp,
        F.col("text").alias("content"), none.alias("title"), F.col("role").alias("actor"), F.lit("inbox").alias("tool"), none.alias("action"),
    )
    pages = read(spark, sf, "pages").select(
        F.lit("project_browser_web_workflow").alias("project_id"), F.concat(F.lit("page_"), "page_id").alias("record_id"), stamp,
        F.col("html").alias("content"), F.col("url").alias("title"), none.alias("actor"), none.alias("tool"), F.lit("open").alias("action"),
    )
    return headers, turns.unionByName(pages)


@query(
    "ingest_workflow_manifest",
    f"""SELECT 'project_' || domain AS project_id, domain, 'artifact_' || replace(domain, '_workflow', '') || '_' || record_id AS artifact_id, replace(domain, '_workflow', '') || '_event' AS event_type, actor,
          array_to_string(list_sort([domain, replace(domain, '_workflow', ''), 'workflow']), '|') AS project_tags, sha256(raw) AS content_hash, sha256({redact_sql('raw')}) AS redacted_hash, {tags_sql('raw')} AS tags FROM mwork""",
)
def ingest_workflow_manifest(spark, sf):
    return N.ingest(*work_manifests(spark, sf)).select(
        "project_id", "domain", "artifact_id", "event_type", "actor", F.array_join("project_tags", "|").alias("project_tags"), "content_hash",
        F.sha2("content", 256).alias("redacted_hash"), F.array_join("privacy_tags", "|").alias("tags"),
    )


@query("privacy_tag_counts", "SELECT project_id, tag, 2 * count(*) AS n FROM (SELECT project_id, unnest(string_split(tags, '|')) AS tag FROM minge2) WHERE tag <> '' GROUP BY ALL")
def privacy_tag_counts(spark, sf):
    return N.privacy_tag_counts(N.ingest(*mail_manifests(spark, sf)))


@query(
    "manifest_validate",
    """SELECT project_id, count(*) AS events, count(*) FILTER (doc_id % 9 = 2) AS unknown_event_artifact, CASE WHEN project_id = 'project_mail_src1' THEN count(*) ELSE 0 END AS project_id_mismatch FROM minge2 GROUP BY project_id""",
)
def manifest_validate(spark, sf):
    """Events whose artifact was left out (each ninth record) and whose project is gone."""
    headers, records = mail_manifests(spark, sf)
    rows = N.ingest(headers, records)
    number = F.regexp_extract("record_id", "([0-9]+)$", 1).cast("bigint")
    return N.validate(rows.select("project_id", "event_id", "artifact_id"), rows.filter(number % 9 != 2), headers.filter("project_id <> 'project_mail_src1'"))


# Projects out of manifests: the mail manifests with a memory and a probe per document, and
# work manifests that bring neither graph nor probes. Faults follow from source and document:
# graphs and probes of another project, records without a time, memories without content.
_OTHER = "project_other"


def manifest_tables(spark, sf):
    """(headers, records, memories, probes) of all manifests."""
    mail, records = mail_manifests(spark, sf)
    work, more = work_manifests(spark, sf)
    number = F.regexp_extract("source_dataset", "([0-9]+)$", 1).cast("bigint")
    mail = mail.withColumn("graph_project_id", F.when(number % 4 == 1, _OTHER).otherwise(F.col("project_id")))
    headers = mail.unionByName(work.withColumn("graph_project_id", F.lit(None).cast("string")))
    source = F.regexp_extract("project_id", "([0-9]+)$", 1).cast("bigint")
    late = (source % 3 == 2) & (F.regexp_extract("record_id", "([0-9]+)$", 1).cast("bigint") % 50 == 7)
    records = records.withColumn("timestamp", F.when(~late, "2024-01-01T00:00:00Z"))
    docs = read(spark, sf, "documents").withColumn("project_id", F.concat(F.lit("project_mail_"), "source")).withColumn("n", F.expr("cast(replace(source, 'src', '') as bigint)"))
    i, third = F.col("doc_id"), F.col("doc_id") % 3
    key = lambda name: F.concat(F.lit(name), i.cast("string"))
    event, memory = F.array(key("event_email_doc_")), key("mem_")
    kind = F.element_at(str_array(["user_policy", "work_habit", "negative_policy_example"]), (third + 1).cast("int"))
    task = F.element_at(str_array(["implicit_policy_induction", "cross_day_habit_generalization", "negative_example_storage_gating"]), (third + 1).cast("int"))
    none = F.array().cast("array<string>")
    about = F.concat(F.lit("Ask user"), (i % 10).cast("string"), F.lit("@example.com first: "), "text")
    memories = docs.select(
        "project_id",
        F.to_json(
            F.struct(
                memory.alias("memory_id"), "project_id", kind.alias("memory_type"), F.when((i % 50 != 11) | (F.col("n") % 5 != 2), about).alias("content"), event.alias("source_events"),
                F.when(third == 2, event).otherwise(none).alias("negative_evidence"), F.struct(F.lit(0.5).alias("score"), none.alias("expected_tasks")).alias("future_utility"),
                F.struct(F.array(F.lit("ask_first")).alias("allowed_actions")).alias("action_boundary"), F.struct(F.array(F.struct("text", i.alias("n"))).alias("deep")).alias("metadata"),
            )
        ).alias("memory"),
    )
    foreign = (i % 97 == 5) & (F.col("n") % 5 == 1)
    leaky = (i % 7 == 3) & (F.col("n") % 6 == 2)
    asked = F.concat(F.when(i % 5 == 1, "Should the user ask first about note ").otherwise("What about note "), i.cast("string"), F.lit("?"))
    probes = docs.select(
        "project_id",
        F.to_json(
            F.struct(
                key("probe_").alias("probe_id"), F.when(foreign, _OTHER).otherwise(F.col("project_id")).alias("project_id"), F.lit("t").alias("trajectory_id"), task.alias("task_type"), asked.alias("query"),
                F.struct(F.array(F.lit("ask first")).alias("must_include"), none.alias("must_not_include")).alias("expected_behavior"),
                F.struct(F.array(memory).alias("positive"), F.when(third == 2, F.array(memory)).otherwise(none).alias("negative"), F.when(third == 0, F.array(memory)).otherwise(none).alias("distractor")).alias("evidence"),
                F.array(task).alias("capabilities"), F.struct(F.when(leaky, "shown").alias("memory_graph"), F.lit("kept").alias("answer")).alias("metadata"),
            )
        ).alias("probe"),
    )
    return headers, records.unionByName(more, allowMissingColumns=True), memories, probes


_PROJECTS: dict = {}


def manifest_projects(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _PROJECTS:
        _PROJECTS[key] = P.build_projects(*manifest_tables(spark, sf))
    return _PROJECTS[key]


table("mdoc", f"SELECT *, 'project_mail_' || source AS project_id, {_N} AS n FROM documents")
table(
    "mproj0",
    f"""SELECT project_id, n, {_PROBLEM} AS problem, count(*) AS docs, count(*) FILTER (doc_id % 97 = 5 AND n % 5 = 1) AS foreign_probes, count(*) FILTER (doc_id % 50 = 7 AND n % 3 = 2) AS late,
  count(*) FILTER (doc_id % 50 = 11 AND n % 5 = 2) AS empty, count(DISTINCT doc_id % 3) AS kinds, count(*) FILTER (doc_id % 5 = 1) AS worded, count(*) FILTER (doc_id % 7 = 3 AND n % 6 = 2) AS leaky,
  CASE WHEN n % 5 = 4 THEN 1 ELSE 0 END + CASE WHEN n % 7 = 3 THEN 1 ELSE 0 END + CASE WHEN n % 6 = 5 THEN 1 ELSE 0 END AS reasons FROM mdoc GROUP BY project_id, n""",
)
table("mproj", "SELECT *, problem = '' AND n % 4 <> 1 AND foreign_probes = 0 AS built, reasons + CASE WHEN n % 4 = 1 THEN 1 ELSE 0 END + foreign_probes + late + empty AS issues FROM mproj0")
_WORK = "SELECT unnest(['project_chat_workflow', 'project_calendar_workflow', 'project_docs_workflow', 'project_browser_web_workflow']) AS project_id"


@query(
    "project_from_manifest",
    f"""SELECT project_id, built, CASE WHEN built THEN docs - late ELSE 0 END AS artifacts, CASE WHEN built THEN docs - late ELSE 0 END AS events, CASE WHEN built THEN docs - empty ELSE 0 END AS memories,
         CASE WHEN built THEN docs ELSE 0 END AS probes, issues, 0 AS leaking FROM mproj
       UNION ALL SELECT project_id, false, 0, 0, 0, 0, 2, 0 FROM ({_WORK})""",
)
def project_from_manifest(spark, sf):
    return P.project_summary(manifest_projects(spark, sf)).drop("domain")


@query(
    "manifest_project_issues",
    f"""SELECT project_id, 'manifest_gate' AS code, unnest(list_filter([CASE WHEN n % 5 = 4 THEN 'license unknown' END, CASE WHEN n % 7 = 3 THEN 'redistribution not allowed' END,
         CASE WHEN n % 6 = 5 THEN 'privacy review not passed' END], lambda x: x IS NOT NULL)) AS subject FROM mproj
       UNION ALL SELECT project_id, 'memory_graph_project_mismatch', '{_OTHER}' FROM mproj WHERE n % 4 = 1
       UNION ALL SELECT project_id, 'probe_project_mismatch', 'probe_' || doc_id FROM mdoc WHERE doc_id % 97 = 5 AND n % 5 = 1
       UNION ALL SELECT project_id, 'record_lacks_timestamp', 'doc_' || doc_id FROM mdoc WHERE doc_id % 50 = 7 AND n % 3 = 2
       UNION ALL SELECT project_id, 'memory_incomplete', 'mem_' || doc_id FROM mdoc WHERE doc_id % 50 = 11 AND n % 5 = 2
       UNION ALL SELECT project_id, unnest(['memory_graph_missing', 'probes_missing']), '' FROM ({_WORK})""",
)
def manifest_project_issues(spark, sf):
    return manifest_projects(spark, sf).issues


@query(
    "manifest_project_memories",
    f"""SELECT project_id, 'mem_' || doc_id AS memory_id, sha256({redact_sql("'Ask user' || doc_id % 10 || '@example.com first: ' || text")}) AS content_hash, sha256({redact_sql('text')}) AS deep_hash,
         CAST(doc_id AS VARCHAR) AS deep_number FROM mdoc JOIN mproj USING (project_id) WHERE built AND NOT (doc_id % 50 = 11 AND mdoc.n % 5 = 2)""",
)
def manifest_project_memories(spark, sf):
    """What redaction leaves of plain and of deeply nested texts."""
    deep = lambda path: F.get_json_object(F.col("metadata")["deep"], path)
    return manifest_projects(spark, sf).memories.select(
        "project_id", "memory_id", F.sha2("content", 256).alias("content_hash"), F.sha2(deep("$[0].text"), 256).alias("deep_hash"), deep("$[0].n").alias("deep_number")
    )


@query(
    "manifest_preflight",
    f"""WITH m AS (SELECT *, built AND issues = 0 AND kinds = 3 AS verified FROM mproj),
       r AS (SELECT *, CASE WHEN verified THEN docs ELSE 0 END AS released, CASE WHEN verified THEN worded ELSE 0 END AS shown FROM m)
       SELECT project_id, "check", CASE WHEN ok THEN 'pass' ELSE 'fail' END AS status, CAST(measured AS BIGINT) AS measured FROM (
         SELECT project_id, unnest({sql_list(P.PREFLIGHT)}) AS "check", unnest([verified, verified, verified AND leaky = 0, verified, built AND docs > late, true, true]) AS ok,
           unnest([issues, released, released, 2 * released, CASE WHEN built THEN 2 * kinds ELSE 0 END, shown, shown]) AS measured FROM r
         UNION ALL SELECT project_id, unnest({sql_list(P.PREFLIGHT)}), unnest([false, false, false, false, false, true, true]), unnest([2, 0, 0, 0, 0, 0, 0]) FROM ({_WORK}))""",
)
def manifest_preflight(spark, sf):
    return P.preflight(manifest_projects(spark, sf))


# Mail folders ------------------------------------------------------------------------------
_SUBJECT = "CASE doc_id % 3 WHEN 0 THEN 'Meeting at ten' WHEN 1 THEN 'Fwd: confidential note' ELSE 'Hello' END"


def _messages(spark, sf):
    """One message per document; every eleventh lies in another folder than that of sent mail."""
    head = F.concat(
        F.lit("Date: Mon, 1 Jan 2024 10:00:00 +0100\nFrom: user"), (F.col("doc_id") % 10).cast("string"), F.lit("@example.com\nTo: a@example.org;\n b@example.org\nSubject: "),
        F.expr(_SUBJECT), F.lit('\nContent-Type: text/plain; charset="utf-8"\n\n> quoted line\n'),
    )
    folder = F.when(F.col("doc_id") % 11 == 5, "inbox").otherwise("sent")
    path = F.concat_ws("/", F.lit("box"), folder, "source", F.col("doc_id").cast("string"))
    return read(spark, sf, "documents").select(path.alias("path"), F.encode(F.concat(head, "text"), "UTF-8").alias("raw"))


_CLEAN = "trim(regexp_replace(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '>')), ' '), '\\s+', ' ', 'g'))"
table(
    "sentmail",
    f"""SELECT *, lower(subject || ' > quoted line' || chr(10) || text) AS low, {_CLEAN} AS body FROM (SELECT doc_id, source, text, {_SUBJECT} AS subject FROM documents WHERE doc_id % 11 <> 5)
  WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) + 3 >= 15""",
)


@query(
    "ingest_maildir",
    f"""SELECT 'box/sent/' || source || '/' || doc_id AS path, '2024-01-01T09:00:00+00:00' AS timestamp, subject, '[REDACTED_EMAIL]' AS sender, '[REDACTED_EMAIL]|[REDACTED_EMAIL]' AS recipients,
         CASE WHEN regexp_matches(low, 'meeting|schedule|call') THEN 'email_scheduling_thread' WHEN regexp_matches(low, 'forward|fwd') THEN 'email_forwarding_thread' ELSE 'email_external_or_internal_thread' END AS event_type,
         CASE WHEN NOT regexp_matches(low, 'meeting|schedule|call|forward|confidential|privileged') THEN 'email_workflow_context' ELSE concat_ws('|', CASE WHEN regexp_matches(low, 'meeting|schedule|call') THEN 'scheduling_context' END,
           CASE WHEN regexp_matches(low, 'forward|confidential|privileged') THEN 'sensitive_forwarding_context' END) END AS claims, sha256({redact_sql('body')}) AS content_hash FROM sentmail""",
)
def ingest_maildir(spark, sf):
    messages = _messages(spark, sf)
    return E.mail_records(messages.filter(E.in_sent_folder(F.col("path")))).select(
        "path", "timestamp", "subject", "sender", F.array_join("recipients", "|").alias("recipients"), "event_type",
        F.array_join("claims", "|").alias("claims"), F.sha2("content", 256).alias("content_hash"),
    )


_low = "lower('Note ' || source || ' ' || text)"


@query(
    "classify_mail",
    f"""SELECT doc_id, CASE WHEN regexp_matches(t, 'meeting|schedule|call') THEN 'email_scheduling_thread' WHEN regexp_matches(t, 'forward|fwd') THEN 'email_forwarding_thread' ELSE 'email_external_or_internal_thread' END AS event_type,
          CASE WHEN NOT regexp_matches(t, 'meeting|schedule|call|forward|confidential|privileged') THEN 'email_workflow_context' ELSE concat_ws('|', CASE WHEN regexp_matches(t, 'meeting|schedule|call') THEN 'scheduling_context' END,
            CASE WHEN regexp_matches(t, 'forward|confidential|privileged') THEN 'sensitive_forwarding_context' END) END AS claims FROM (SELECT doc_id, {_low} AS t FROM documents)""",
)
def classify_mail(spark, sf):
    subject = F.concat(F.lit("Note "), "source")
    return read(spark, sf, "documents").select(
        "doc_id", E.event_type(subject, F.col("text")).alias("event_type"), F.array_join(E.claims(subject, F.col("text")), "|").alias("claims")
    )


# Files -------------------------------------------------------------------------------------
_REASON = "CASE WHEN doc_id % 10 = 3 THEN 'malformed' WHEN doc_id % 10 = 5 THEN 'missing timestamp' WHEN doc_id % 10 = 6 THEN 'missing content' ELSE 'valid' END"


@query("schema_conformance", f"SELECT {_REASON} AS reason, count(*) AS n FROM documents GROUP BY 1")
def schema_conformance(spark, sf):
    """Record lines of which every tenth is cut off and others lack a required field."""
    k = F.col("doc_id") % 10
    whole = F.to_json(
        F.struct(
            F.concat(F.lit("doc_"), "doc_id").alias("record_id"), F.when(k != 5, "2024-01-01T00:00:00Z").alias("timestamp"), F.when(k != 6, F.col("text")).alias("content")
        )
    )
    lines = read(spark, sf, "documents").select(F.when(k == 3, F.concat(F.lit("{\"record_id\": "), F.lit("oops"))).otherwise(whole).alias("line"))
    return X.conformance(lines, MANIFEST_RECORD, ["record_id", "timestamp", "content"])


@query(
    "discover_sources",
    """SELECT kind AS dataset_kind, confidence, usable, count(*) AS n FROM (SELECT CASE doc_id % 8 WHEN 0 THEN 'gharchive_public_events' WHEN 1 THEN 'email_workflow_manifest' WHEN 2 THEN 'chat_workflow_manifest' WHEN 3 THEN 'github_code_corpus_not_workflow'
         WHEN 4 THEN 'possible_gharchive_unverified' WHEN 5 THEN 'email_corpus_requires_manifest' WHEN 6 THEN 'calendar_workflow_requires_manifest' END AS kind,
         CASE doc_id % 8 WHEN 0 THEN 0.95e0 WHEN 1 THEN 0.9e0 WHEN 2 THEN 0.86e0 WHEN 3 THEN 0.75e0 WHEN 4 THEN 0.4e0 WHEN 5 THEN 0.35e0 WHEN 6 THEN 0.32e0 END AS confidence, doc_id % 8 < 3 AS usable FROM documents WHERE doc_id % 8 < 7) GROUP BY ALL""",
)
def discover_sources(spark, sf):
    """One file per document: its name and its first lines follow from the document id."""
    docs = read(spark, sf, "documents").withColumn("k", F.col("doc_id") % 8)
    names = F.element_at(str_array(["hour", "box", "talk", "repo_text", "gharchive_x", "enron_mail", "calendar_x", "plain"]), (F.col("k") + 1).cast("int"))
    path = F.concat(F.lit("/data/"), names, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jsonl"))
    gate = F.lit('"license":"CC0","records":[{"a":1}],"redistribution":{"allowed":true},"privacy_review":{"status":"passed","pii_redaction":true}}')
    line = (
        F.when(F.col("k") == 0, F.lit('{"type":"PushEvent","actor":{"login":"a"},"repo":{"name":"r"},"payload":{"ref":"x"},"created_at":"2024-01-01T00:00:00Z"}'))
        .when(F.col("k") == 1, F.concat(F.lit("{"), gate))
        .when(F.col("k") == 2, F.concat(F.lit('{"domain":"chat_workflow",'), gate))
        .when(F.col("k") == 3, F.to_json(F.struct(F.concat(F.lit("def f(): "), "text").alias("text"))))
        .otherwise(F.col("text"))
    )
    files = docs.select(path.alias("path"), F.col("n_chars").alias("bytes"), line.alias("line"))
    lines = files.select("path", F.posexplode(F.split("line", "\n")).alias("line_no", "line"))
    found = X.discover(files.select("path", "bytes"), lines)
    return found.groupBy("dataset_kind", "confidence", "usable").agg(F.count("*").alias("n"))


def number_files(spark, sf) -> str:
    """Document numbers by source in folders of a thousand documents and files of a hundred,
    written beside the checkpoints: a source of any size is many files of bounded size. The rows
    are few bytes and the files many, so their tasks are counted, not sized. Gives the folder's
    path."""
    path = scratch_path(spark, "listed")
    docs = read(spark, sf, "documents").select("source", F.expr("doc_id div 1000").alias("thousand"), F.expr("doc_id div 100").alias("hundred"), F.concat_ws(" ", "doc_id", "n_chars").alias("value"))
    K.write_folders(docs, path, ["source", "thousand", "hundred"], "text", ("value",), None)
    return path


def number_inventory(spark, path: str):
    """Inventory of such a folder. Spark's file names are random; the folder stands for its one
    file."""
    return X.file_inventory(spark, path, "*.txt").withColumn("name", F.regexp_replace("name", "/[^/]*$", "/numbers.txt"))


def listed(spark, sf):
    return number_inventory(spark, number_files(spark, sf))


table(
    "listed",
    """SELECT 'source=' || source || '/thousand=' || thousand || '/hundred=' || hundred || '/numbers.txt' AS name, strlen(body) AS bytes, sha256(body) AS sha256 FROM (
         SELECT source, thousand, hundred, string_agg(line || chr(10), '' ORDER BY line) AS body FROM (SELECT source, doc_id // 1000 AS thousand, doc_id // 100 AS hundred, doc_id || ' ' || n_chars AS line FROM documents) GROUP BY ALL)""",
)


@query("file_inventory", "SELECT name, 'txt' AS kind, CAST(bytes AS BIGINT) AS bytes, sha256 FROM listed")
def file_inventory(spark, sf):
    return listed(spark, sf).select("name", "kind", "bytes", "sha256")


_LANES = ", ".join(f"sum(CAST('0x' || substr(e, {15 * k + 1}, 15) AS BIGINT)::HUGEINT) AS s{k}" for k in range(4))


@query(
    "directory_digest",
    f"""WITH ups AS (SELECT *, string_split(name, '/') AS parts, unnest(range(len(string_split(name, '/')))) AS n FROM listed),
        e AS (SELECT array_to_string(parts[:n], '/') AS folder, bytes, sha256(array_to_string(parts[n + 1:], '/') || chr(10) || sha256) AS e FROM ups)
        SELECT folder, files, CAST(bytes AS BIGINT) AS bytes, sha256(concat_ws('|', files, s0, s1, s2, s3)) AS sha256 FROM (SELECT folder, count(*) AS files, sum(bytes) AS bytes, {_LANES} FROM e GROUP BY 1)""",
)
def directory_digest(spark, sf):
    return X.directory_digest(listed(spark, sf))


@query(
    "write_project",
    """SELECT 'artifacts' AS "table", count(*) AS rows FROM ev UNION ALL SELECT 'events', count(*) FROM pev UNION ALL SELECT 'memories', count(*) FROM mem UNION ALL SELECT 'probes', count(*) FROM probe
       UNION ALL SELECT 'memory_events', count(*) FROM mem_ev UNION ALL SELECT 'projects', count(*) FROM proj""",
)
def write_project(spark, sf):
    """Artifacts, events, the memory graph (memories and their source events), probes and the
    profile of each project."""
    g = gold(spark, sf)
    events, artifacts = g.whole
    tables = {"artifacts": artifacts, "events": events, "memories": g.memories, "probes": g.probes, "memory_events": g.memory_events, "projects": J.built(g.evidence)}
    return K.write_tables(tables, scratch_path(spark, "project"))


@query(
    "jsonl_csv_sink",
    """SELECT format, doc_id, lang, source, n_chars, sha256(text || chr(10) || '"quoted", ' || source) AS text_hash, source || '|' || lang AS tags
       FROM documents, (VALUES ('csv'), ('jsonl')) AS f(format)""",
)
def jsonl_csv_sink(spark, sf):
    """All columns, with newlines, quotes and a nested list, written both ways and read back."""
    path = scratch_path(spark, "sink")
    docs = read(spark, sf, "documents").withColumn("text", F.concat("text", F.lit('\n"quoted", '), "source")).withColumn("tags", F.array("source", "lang"))
    K.write_jsonl(docs, f"{path}/jsonl")
    K.write_csv(docs, f"{path}/csv")
    flat = "doc_id bigint, lang string, n_chars bigint, source string, tags string, text string"
    csv = spark.read.schema(flat).option("header", "true").option("escape", '"').option("multiLine", "true").csv(f"{path}/csv")
    back = [
        spark.read.schema(docs.schema).json(f"{path}/jsonl").withColumn("format", F.lit("jsonl")),
        csv.withColumn("tags", F.from_json("tags", "array<string>")).withColumn("format", F.lit("csv")),
    ]
    return union_all(back).select("format", "doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_hash"), F.array_join("tags", "|").alias("tags"))


# Plug-ins ----------------------------------------------------------------------------------
def first_and_last(probes, events):
    """A tiny predictor: name the first and the last event of the project, and their number."""
    first = last = ""
    n = 0
    for batch in events:
        first = first or batch["event_id"].iloc[0]
        last = batch["event_id"].iloc[-1]
        n += len(batch)
    for probe in probes["probe_id"]:
        yield probe, f"{n} events from {first} to {last}", [first, last]


@query(
    "apply_predictor",
    """SELECT project_id, probe_id, n || ' events from ' || a || ' to ' || b AS prediction, a || '|' || b AS ids FROM probe
       JOIN (SELECT project_id, count(*) AS n, arg_min(event_id, ord) AS a, arg_max(event_id, ord) AS b FROM pev GROUP BY project_id) USING (project_id)""",
)
def apply_predictor(spark, sf):
    g = gold(spark, sf)
    return G.apply_predictor(first_and_last, g.events, g.probes).select("project_id", "probe_id", "prediction", F.array_join("retrieved_event_ids", "|").alias("ids"))


@query(
    "score_many_systems",
    f"""SELECT system AS baseline, {_MEANS} FROM (SELECT *, CASE WHEN (row_no // 1000) % 2 = 0 THEN 'alpha' ELSE 'beta_2' END AS system FROM ss) GROUP BY system""",
)
def score_many_systems(spark, sf):
    """Two submissions written as files, then read as one folder and scored together."""
    path = scratch_path(spark, "submissions")
    g = gold(spark, sf)
    required = S.required_events(S.asked(g.probes, submission(spark, sf)), g.memory_events)
    named = retrieved_ids(spark, sf, required).groupBy("row_no").agg(F.collect_list("event_id").alias("retrieved_event_ids"))
    rows = submission(spark, sf).join(named, "row_no", "left").select(
        "row_no", "prediction_id", "project_id", "probe_id", "prediction", F.lit(None).cast("array<string>").alias("retrieved_memory_ids"), "retrieved_event_ids",
    )
    for name, part in (("alpha", 0), ("beta 2", 1)):
        rows.filter((F.expr("row_no div 1000") % 2) == part).drop("row_no").write.json(f"{path}/{name}.jsonl")
    given = G.read_submissions(spark, path)
    return S.metrics_by(S.score_predictions(given, G.retrieved_events(given), g.probes, g.memories, g.memory_events), "baseline")


# Annotation release ------------------------------------------------------------------------
table(
    "packb",
    """SELECT pack_id, repo, split, tasks, b FROM pack JOIN (SELECT repo, CAST(substr(repo, 10) AS BIGINT) % 10 AS b FROM prof) USING (repo)""",
)


_PACK_FAULTS = {
    "pack_content_hash_mismatch": "b = 1", "duplicate_prompt_export_pack_id": "b = 1", "duplicate_split_pack_id": "b = 2", "pack_task_count_mismatch": "b = 2", "task_count_per_pack_mismatch": "b IN (1, 2, 5)",
    "split_missing_manifest_pack": "b = 3", "split_pack_assignment_mismatch": "b = 4 AND split <> 'test'", "task_splits_manifest_mismatch": "b = 3 OR b = 4 AND split <> 'test'",
    "prompt_export_missing_release_pack": "b = 6", "pack_file_missing": "b = 6", "prompt_annotation_coverage_mismatch": "b IN (5, 6)", "pack_id_mismatch": "b = 8", "pack_repo_mismatch": "b = 8",
    "prompt_export_count_mismatch": "b = 8", "pack_path_missing": "b = 9", "prompt_export_file_missing": "b = 0",
}
_TASK_FAULTS = {
    "duplicate_all_task": "b = 1", "task_unknown_source_pack": "b = 5", "prompt_unknown_annotation": "b = 5", "prompt_missing_positive_event_constraints": "b = 7",
    "prompt_missing_action_boundary_constraint": "b = 7", "task_split_field_mismatch": "b = 9 AND split <> 'train'", "prompt_pack_id_mismatch": "b = 0",
}
_WHOLE_FAULTS = [
    "release_llm_generation_allowed_not_false", "release_rewrite_validation_not_required", "pack_count_mismatch", "split_task_total_mismatch", "pack_task_total_mismatch", "all_task_count_mismatch",
    "all_tasks_not_equal_split_union", "split_task_count_mismatch", "split_references_unknown_pack", "prompt_export_llm_generation_not_false", "prompt_export_validation_not_required",
    "prompt_summary_pack_count_mismatch", "prompt_summary_total_mismatch", "prompt_export_unknown_pack", "prompt_export_empty",
]


@query(
    "release_integrity",
    " UNION ALL ".join(
        [
            *[f"SELECT '{c}' AS code, count(*) AS n FROM packb WHERE {w} HAVING count(*) > 0" for c, w in _PACK_FAULTS.items()],
            *[f"SELECT '{c}', count(*) FROM task JOIN packb USING (pack_id) WHERE {w} HAVING count(*) > 0" for c, w in _TASK_FAULTS.items()],
            *[f"SELECT '{c}', 1" for c in _WHOLE_FAULTS],
        ]
    ),
)
def release_integrity(spark, sf):
    """A release with faults by the number of the repository, and in its totals."""
    from worktrail.operators import integrity as Q
    from worktrail.operators.annotation import release_tasks
    from worktrail_queries.annotation_q import pack_rows, prompts, staged

    tasks = staged(spark, sf).tasks
    b = F.col("b")
    packs = pack_rows(spark, sf).withColumn("b", F.regexp_extract("repo", "([0-9]+)$", 1).cast("bigint") % 10)
    other = F.lit("other")
    files = packs.filter("b <> 6").select(
        "pack_id", F.when(b == 8, other).otherwise(F.col("pack_id")).alias("file_pack_id"), F.when(b == 8, other).otherwise(F.col("repo")).alias("repo"),
        "tasks", F.when(b == 1, other).otherwise(F.col("content_hash")).alias("content_hash"),
    )
    declared = packs.withColumn("tasks", F.when(b == 2, F.col("tasks") + 1).otherwise(F.col("tasks"))).withColumn("path", F.when(b != 9, F.concat("pack_id", F.lit(".json"))))
    unknown = packs.limit(1).select(F.lit("pack_unknown").alias("pack_id"))
    members = packs.filter("b <> 3").select("pack_id", F.when(b == 4, "test").otherwise(F.col("split")).alias("split"))
    members = members.unionByName(packs.filter("b = 2").select("pack_id", "split")).unionByName(unknown.withColumn("split", F.lit("test")))
    rows = release_tasks(tasks, packs).join(packs.select("pack_id", "b"), "pack_id")
    rows = rows.withColumn("pack_id", F.when(b == 5, F.concat("pack_id", F.lit("_gone"))).otherwise(F.col("pack_id"))).select("split", "pack_id", "annotation_id", "b")
    split_tasks = rows.filter("b <> 3").withColumn("file_split", F.when(b == 9, "train").otherwise(F.col("split")))
    all_tasks = rows.unionByName(rows.filter("b = 1"))
    exported = prompts(spark, sf).join(packs.select("pack_id", "b"), "pack_id").filter("b <> 6")
    exported = exported.withColumns(
        {
            "allowed_positive_event_ids": F.when(b == 7, F.array().cast("array<string>")).otherwise(F.col("allowed_positive_event_ids")),
            "action_boundary": F.when(b != 7, F.col("action_boundary")),
            "export_pack_id": F.when(b == 0, other).otherwise(F.col("pack_id")),
        }
    )
    counts = packs.filter("b <> 6").select("pack_id", (F.col("tasks") + F.when(b == 8, 1).otherwise(0)).alias("prompts"), "b")
    exports = counts.unionByName(counts.filter("b = 1")).drop("b").unionByName(unknown.withColumn("prompts", F.lit(0).cast("long")))
    n = lambda s: F.count_if(F.col("file_split") == s)
    manifest = split_tasks.agg((n("train") + 1).alias("train"), n("dev").alias("dev"), n("test").alias("test")).withColumns(
        {
            "packs": packs.agg(F.count("*") + 1).scalar(), "tasks": rows.agg(F.count("*")).scalar(),
            "generation_allowed": F.lit(True), "validation_required": F.lit(False),
        }
    )
    batch = exports.agg((F.count("*") + 1).alias("packs")).withColumns(
        {"prompts": exported.agg(F.count("*") + 1).scalar(), "generation_performed": F.lit(True), "validation_required": F.lit(False)}
    )
    release = Q.Release(manifest, declared, files, members, split_tasks, all_tasks, exported, exports, batch)
    return Q.release_issues(release).groupBy("code").agg(F.count("*").alias("n"))
