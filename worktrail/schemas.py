"""Column layouts shared by the readers, the operators and the writers."""

from pyspark.sql import types as T

STR = T.StringType()
STRS = T.ArrayType(T.StringType())

LOGIN = T.StructType([T.StructField("login", STR)])

# One layout for all seven payload sections. Labels and assignees arrive either as
# plain strings or as objects; reading them as strings keeps both forms.
SECTION = T.StructType(
    [
        T.StructField("title", STR),
        T.StructField("name", STR),
        T.StructField("body", STR),
        T.StructField("state", STR),
        T.StructField("number", T.LongType()),
        T.StructField("status", STR),
        T.StructField("conclusion", STR),
        T.StructField("labels", STRS),
        T.StructField("assignees", STRS),
        T.StructField("assignee", LOGIN),
        T.StructField("user", LOGIN),
        T.StructField("author_association", STR),
        T.StructField("html_url", STR),
        T.StructField("url", STR),
    ]
)

# Fixed value: payload sections in the order in which a summary lists them.
SECTION_KEYS = ["pull_request", "issue", "review", "comment", "check_run", "check_suite", "workflow_run"]

PAYLOAD = T.StructType(
    [T.StructField("action", STR), T.StructField("ref", STR)]
    + [T.StructField(key, SECTION) for key in SECTION_KEYS]
)

RAW_EVENT = T.StructType(
    [
        T.StructField("id", STR),
        T.StructField("type", STR),
        T.StructField("actor", LOGIN),
        T.StructField("repo", T.StructType([T.StructField("name", STR)])),
        T.StructField("payload", PAYLOAD),
        T.StructField("created_at", STR),
    ]
)

# Fixed value: the eight lists of an action boundary.
BOUNDARY_FIELDS = [
    "allowed_actions",
    "forbidden_actions",
    "conditions",
    "exceptions",
    "requires_approval",
    "requires_clarification",
    "authorized_tools",
    "forbidden_tools",
]
BOUNDARY = T.StructType([T.StructField(f, STRS) for f in BOUNDARY_FIELDS])

EXPECTED = T.StructType([T.StructField("must_include", STRS), T.StructField("must_not_include", STRS)])
EVIDENCE = T.StructType([T.StructField(f, STRS) for f in ("positive", "negative", "obsolete", "distractor")])

PREDICTION = T.StructType(
    [
        T.StructField("prediction_id", STR),
        T.StructField("project_id", STR),
        T.StructField("probe_id", STR),
        T.StructField("prediction", STR),
        T.StructField("retrieved_memory_ids", STRS),
        T.StructField("retrieved_event_ids", STRS),
        T.StructField("retrieved_artifact_ids", STRS),
        T.StructField("metadata", T.MapType(STR, STR)),
    ]
)

MANIFEST_RECORD = T.StructType(
    [
        T.StructField("record_id", STR),
        T.StructField("event_id", STR),
        T.StructField("artifact_id", STR),
        T.StructField("timestamp", STR),
        T.StructField("content", STR),
        T.StructField("event_type", STR),
        T.StructField("artifact_type", STR),
        T.StructField("raw_pointer", STR),
        T.StructField("uri", STR),
        T.StructField("subject", STR),
        T.StructField("sender", STR),
        T.StructField("recipients", STRS),
        T.StructField("title", STR),
        T.StructField("actor", STR),
        T.StructField("tool", STR),
        T.StructField("action", STR),
        T.StructField("claims", STRS),
        T.StructField("entities", STRS),
        T.StructField("causal_links", STRS),
        T.StructField("supersedes", STRS),
        T.StructField("invalidates", STRS),
        T.StructField("project_tags", STRS),
        T.StructField("privacy_tags", STRS),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("dataset_name", STR),
        T.StructField("source_dataset", STR),
        T.StructField("domain", STR),
        T.StructField("license", STR),
        T.StructField("license_url", STR),
        T.StructField("project_id", STR),
        T.StructField("title", STR),
        T.StructField("project_goal", STR),
        T.StructField("redistribution", T.StructType([T.StructField("allowed", T.BooleanType()), T.StructField("notes", STR)])),
        T.StructField(
            "privacy_review",
            T.StructType([T.StructField("status", STR), T.StructField("pii_redaction", T.BooleanType())]),
        ),
        T.StructField("records", T.ArrayType(MANIFEST_RECORD)),
    ]
)
