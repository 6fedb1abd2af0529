"""Scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from worktrail.functions import ids as I
from worktrail.functions import privacy as V
from worktrail.functions import profile_text as PT
from worktrail.functions import text as X
from worktrail.operators.mining import labels_and_owners
from worktrail_queries.inputs import canonical, light, read
from worktrail_queries.mining_q import bucket_sql, split_sql
from worktrail_queries.registry import query
from worktrail_queries.sqlkit import has_any, iso, rnd, slug, sql_list, table, toks, words

PHRASES = ["wait for approval", "summary comment", "request review", "merge", "do not merge before approval now", "small docs change please"]


@query("fn_safe_id", r"SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^\pL\pN]', '_', 'g'), '_'), ''), 'unknown') AS safe_id FROM pages")
def fn_safe_id(spark, sf):
    return read(spark, sf, "pages").select("page_id", I.safe_id(F.col("url")).alias("safe_id"))


@query("fn_safe_condition", f"SELECT page_id, {slug('url')} AS condition FROM pages")
def fn_safe_condition(spark, sf):
    return read(spark, sf, "pages").select("page_id", I.safe_condition(F.col("url")).alias("condition"))


_name = "CASE WHEN doc_id % 3 = 0 THEN source || ' Reviewer' WHEN doc_id % 3 = 1 THEN source || '-review' ELSE source || ' reviews' END"


@query("fn_reviewer_slug", f"SELECT doc_id, regexp_replace({slug(_name)}, '(_reviewer|_review)$', '') AS slug FROM documents")
def fn_reviewer_slug(spark, sf):
    return read(spark, sf, "documents").select("doc_id", I.reviewer_slug(F.expr(_name)).alias("slug"))


@query(
    "fn_tokens",
    f"""SELECT doc_id, len(t) AS tokens, len(a) AS audit_tokens, len(c) AS contract_tokens, sha256(array_to_string(t, ' ')) AS token_hash
        FROM (SELECT doc_id, {toks('text')} AS t, {toks('text', X.AUDIT_STOPWORDS)} AS a, {words('text', X.CONTRACT_STOPWORDS)} AS c FROM documents)""",
)
def fn_tokens(spark, sf):
    docs = read(spark, sf, "documents").select(
        "doc_id", X.tokens(F.col("text")).alias("t"), X.tokens(F.col("text"), X.AUDIT_STOPWORDS).alias("a"),
        X.split_words(F.col("text"), X.CONTRACT_STOPWORDS).alias("c"),
    )
    return docs.select(
        "doc_id", F.size("t").cast("bigint").alias("tokens"), F.size("a").cast("bigint").alias("audit_tokens"),
        F.size("c").cast("bigint").alias("contract_tokens"), I.content_hash(F.array_join("t", " ")).alias("token_hash"),
    )


@query("fn_normalize_text", f"SELECT doc_id, array_to_string({toks('text')}, ' ') AS normalized FROM documents")
def fn_normalize_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("normalized"))


@query("fn_humanize", "SELECT page_id, translate(url, '_-', '  ') AS humanized FROM pages")
def fn_humanize(spark, sf):
    return read(spark, sf, "pages").select("page_id", X.humanize(F.col("url")).alias("humanized"))


_q5 = "summary of small docs change, review from dev_1"


@query(
    "fn_lexical_score",
    f"""SELECT event_id, len(list_intersect(q, t)) / len(list_distinct(q)) AS score
        FROM (SELECT event_id, {toks(f"'{_q5}'")} AS q, list_distinct({toks('content')}) AS t FROM ev)""",
)
def fn_lexical_score(spark, sf):
    return light(spark, sf).select(
        "event_id", X.lexical_score(X.tokens(F.lit(_q5)), X.tokens(F.col("content"))).alias("score")
    )


def matched_sql(req: str, ptoks: str, pnorm: str) -> str:
    """SQL twin of requirement_matched over a token list expression for the requirement."""
    n = f"len(list_distinct({req}))"
    hit = f"len(list_intersect(list_distinct({req}), list_distinct({ptoks})))"
    return (
        f"(len({req}) > 0 AND (contains({pnorm}, array_to_string({req}, ' ')) OR CASE WHEN {n} <= 2 THEN {hit} = {n} "
        f"ELSE {hit} >= least({n}, greatest(2, CAST(round_even({n} * 0.6e0, 0) AS BIGINT))) END))"
    )


def negated_sql(req: str, ptoks: str, pnorm: str) -> str:
    near = (
        f"len(list_filter(range(1, len({ptoks}) + 1), lambda i: list_contains({req}, {ptoks}[i]) "
        f"AND list_has_any({ptoks}[greatest(1, i - 6):i + 7], {sql_list(X.NEGATION_WORDS)}))) > 0"
    )
    return f"(len({req}) > 0 AND ({near} OR {has_any(pnorm, X.NEGATION_PHRASES)}))"


table(
    "phrased",
    f"""SELECT event_id, phrase, {toks('phrase')} AS req, t, array_to_string(t, ' ') AS norm
FROM (SELECT event_id, {toks('content')} AS t, unnest({sql_list(PHRASES)}) AS phrase FROM ev)""",
)


def _phrased(spark, sf):
    events = light(spark, sf).select("event_id", X.tokens(F.col("content")).alias("t"))
    return events.select("event_id", "t", F.array_join("t", " ").alias("norm"), F.explode(X.str_array(PHRASES)).alias("phrase"))


@query("fn_requirement_matched", f"SELECT event_id, phrase, {matched_sql('req', 't', 'norm')} AS matched FROM phrased")
def fn_requirement_matched(spark, sf):
    return _phrased(spark, sf).select(
        "event_id", "phrase", X.requirement_matched(F.col("phrase"), F.col("t"), F.col("norm")).alias("matched")
    )


@query(
    "fn_must_not_violated",
    f"SELECT event_id, phrase, {matched_sql('req', 't', 'norm')} AND NOT {negated_sql('req', 't', 'norm')} AS violated FROM phrased",
)
def fn_must_not_violated(spark, sf):
    return _phrased(spark, sf).select(
        "event_id", "phrase", X.must_not_violated(F.col("phrase"), F.col("t"), F.col("norm")).alias("violated")
    )


def subsequence_sql(needle: str, hay: str) -> str:
    return f"(len({needle}) > 0 AND regexp_matches(' ' || array_to_string({hay}, ' ') || ' ', ' ' || array_to_string({needle}, ' (.* )?') || ' '))"


@query("fn_ordered_subsequence", f"SELECT event_id, phrase, {subsequence_sql('req', 't')} AS in_order FROM phrased")
def fn_ordered_subsequence(spark, sf):
    return _phrased(spark, sf).select(
        "event_id", "phrase", X.ordered_subsequence(X.tokens(F.col("phrase")), F.col("t")).alias("in_order")
    )


def action_sql(req: str, ptoks: str) -> str:
    return f"(len({req}) > 0 AND (contains(array_to_string({ptoks}, ' '), array_to_string({req}, ' ')) OR {subsequence_sql(req, ptoks)}))"


@query("fn_action_boundary_match", f"SELECT event_id, phrase, {action_sql('req', 't')} AS matched FROM phrased")
def fn_action_boundary_match(spark, sf):
    return _phrased(spark, sf).select("event_id", "phrase", X.action_matches(F.col("phrase"), F.col("t")).alias("matched"))


@query(
    "fn_tool_match",
    f"SELECT conv_id, turn, array_to_string({toks('role')}, ' ') = array_to_string({toks(chr(39) + 'User_' + chr(39))}, ' ') AS same_tool FROM conversations",
)
def fn_tool_match(spark, sf):
    return read(spark, sf, "conversations").select(
        "conv_id", "turn", X.tool_matches(F.col("role"), F.lit("User_")).alias("same_tool")
    )


def entry_sql(entry: str, expected: str) -> str:
    """SQL twin of boundary_entry_matches; both are text expressions."""
    e = f"list_distinct({words(entry, X.CONTRACT_STOPWORDS)})"
    x = f"list_distinct({words(expected, X.CONTRACT_STOPWORDS)})"
    hit = f"list_intersect({e}, {x})"
    phrase = f"translate(lower({entry}), '_', ' ')"
    return (
        f"(({phrase} <> '' AND contains({expected}, {phrase})) OR (len({e}) > 0 AND CASE WHEN len({e}) <= 2 "
        f"THEN len({hit}) = len({e}) OR list_has_any({hit}, {sql_list(X.DISTINCTIVE_WORDS)}) ELSE len({hit}) >= 2 END))"
    )


@query("fn_boundary_entry_match", f"SELECT event_id, phrase, {entry_sql('phrase', 'low')} AS matched FROM (SELECT event_id, lower(content) AS low, unnest({sql_list(PHRASES)}) AS phrase FROM ev)")
def fn_boundary_entry_match(spark, sf):
    events = light(spark, sf).select("event_id", F.lower("content").alias("low"), F.explode(X.str_array(PHRASES)).alias("phrase"))
    return events.select("event_id", "phrase", X.boundary_entry_matches(F.col("phrase"), F.col("low")).alias("matched"))


@query(
    "fn_flatten_expected",
    "SELECT event_id, translate(lower(array_to_string(list_concat([actor, event_type], [repo]), ' ')), '_', ' ') AS expected FROM ev",
)
def fn_flatten_expected(spark, sf):
    return light(spark, sf).select(
        "event_id", X.flatten_expected(F.array("actor", "event_type"), F.array("repo")).alias("expected")
    )


@query(
    "fn_extract_labels_owners",
    """SELECT event_id, array_to_string(labels, '|') AS labels, array_to_string(owners, '|') AS owners,
         CASE WHEN event_type = 'github_issue' THEN label || '|assignee=' || replace(owner, '_', ' ') ELSE '' END AS public_labels,
         CASE WHEN event_type = 'github_issue' THEN owner ELSE '' END AS public_assignees
       FROM tri JOIN ev USING (event_id)""",
)
def fn_extract_labels_owners(spark, sf):
    events = light(spark, sf).filter(F.col("event_type").isin("github_issue", "github_issue_comment"))
    labels, owners = labels_and_owners(F.col("event_type"), F.col("content"), F.col("actor"))
    return events.select(
        "event_id", F.array_join(labels, "|").alias("labels"), F.array_join(owners, "|").alias("owners"),
        F.array_join(PT.extract_labels(F.col("content")), "|").alias("public_labels"),
        F.array_join(PT.extract_assignees(F.col("content")), "|").alias("public_assignees"),
    )


_query_text = """CASE CAST(event_id AS BIGINT) % 4 WHEN 0 THEN 'Please apply the needs_' || kind || ' label and assign dev.' || u || ' now.'
  WHEN 1 THEN 'In the issue_label_' || kind || ' workflow, request owner_' || u || ' triage first, then assign the team'
  WHEN 2 THEN 'Work under the ' || kind || '-label label condition; assign a_' || u || ', please' ELSE 'No cue for ' || kind END"""
_query_label = """CASE CAST(event_id AS BIGINT) % 4 WHEN 0 THEN 'needs ' || kind WHEN 1 THEN kind WHEN 2 THEN kind || ' label' ELSE '' END"""
_query_people = """CASE CAST(event_id AS BIGINT) % 4 WHEN 0 THEN 'dev.' || u WHEN 1 THEN 'owner ' || u WHEN 2 THEN 'a ' || u ELSE '' END"""
_QT = "(SELECT event_id, event_type AS kind, user_id AS u FROM events)"


@query("fn_query_label_assignees", f"SELECT event_id, {_query_label} AS label, {_query_people} AS assignees FROM {_QT}")
def fn_query_label_assignees(spark, sf):
    rows = read(spark, sf, "events").selectExpr("event_id", "event_type as kind", "user_id as u").selectExpr(
        "event_id", f"{_query_text} as query"
    )
    return rows.select(
        "event_id", PT.query_label(F.col("query")).alias("label"), F.array_join(PT.query_assignees(F.col("query")), "|").alias("assignees")
    )


@query(
    "fn_workflow_signals",
    f"""SELECT event_id, array_to_string(list_filter({sql_list(PT.WORKFLOW_SIGNALS)}, lambda s: contains(norm, s)), '|') AS signals
        FROM (SELECT event_id, array_to_string({toks('content')}, ' ') AS norm FROM ev)""",
)
def fn_workflow_signals(spark, sf):
    return light(spark, sf).select("event_id", F.array_join(PT.workflow_signals(F.col("content")), "|").alias("signals"))


table(
    "evtext",
    """SELECT ev.*, entities,
  content || ' ' || array_to_string(claims, ' ') || ' github public_workflow ' || event_type || ' ' || array_to_string(entities, ' ') AS search_text,
  event_type || ' ' || actor || ' ' || content || ' ' || array_to_string(claims, ' ') || ' ' || array_to_string(entities, ' ') AS public_text
FROM ev JOIN entities USING (ord)""",
)


@query("fn_event_search_text", "SELECT event_id, search_text, public_text FROM evtext")
def fn_event_search_text(spark, sf):
    _, events = canonical(spark, sf)
    return events.select("event_id", search_column().alias("search_text"), public_column().alias("public_text"))


def search_column():
    return PT.search_text(F.col("content"), F.col("claims"), F.col("project_tags"), F.col("entities"))


def public_column():
    return PT.event_text(F.col("event_type"), F.col("actor"), F.col("content"), F.col("claims"), F.col("entities"))


# RE2 has no Unicode word boundary: the neighbours are captured and written back, and the
# search runs twice because neighbouring matches may share one separator.
_W, _N = r"\pL\pN_", r"(^|[^\pL\pN_])"
_E = r"($|[^\pL\pN_])"
_EMAIL = rf"[{_W}][{_W}.+-]*@[{_W}.-]+\.[A-Za-z]{{2,}}{_E}"
_PHONE = rf"{_N}(\p{{Nd}}[\p{{Nd}} -]{{7,}}\p{{Nd}}){_E}"
_SECRET = rf"{_N}(sk-[A-Za-z0-9]{{16,}}|AKIA[A-Z0-9]{{16}}){_E}"


def redact_sql(text: str) -> str:
    def sub(t: str, pattern: str, to: str) -> str:
        return f"regexp_replace({t}, '{pattern}', '{to}', 'g')"

    out = sub(text, _EMAIL, r"[REDACTED_EMAIL]\1")
    for _ in range(2):
        out = sub(out, _PHONE, r"\1[REDACTED_PHONE]\3")
    for _ in range(2):
        out = sub(out, _SECRET, r"\1[REDACTED_SECRET]\3")
    return out


def tags_sql(text: str) -> str:
    return (
        f"concat_ws('|', CASE WHEN regexp_matches({text}, '{_EMAIL}') THEN 'email' END, CASE WHEN regexp_matches({text}, '{_PHONE}') THEN 'phone' END, "
        f"CASE WHEN regexp_matches({text}, '{_SECRET}') THEN 'secret_like' END)"
    )


@query("fn_privacy_tags", f"SELECT doc_id, {tags_sql('text')} AS tags FROM documents")
def fn_privacy_tags(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.array_join(V.privacy_tags(F.col("text")), "|").alias("tags"))


@query("fn_redact", f"SELECT doc_id, sha256(r) AS redacted_hash, length(r) AS redacted_chars FROM (SELECT doc_id, {redact_sql('text')} AS r FROM documents)")
def fn_redact(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", V.redact(F.col("text")).alias("r"))
    return docs.select("doc_id", I.content_hash(F.col("r")).alias("redacted_hash"), F.length("r").cast("bigint").alias("redacted_chars"))


@query(
    "fn_redact_nested",
    f"""SELECT conv_id, turn, {redact_sql('text')} AS body, role AS key0, sha256({redact_sql('text')}) AS listed FROM conversations""",
)
def fn_redact_nested(spark, sf):
    nested = read(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.struct(F.col("text").alias("body"), F.create_map("role", F.array("text")).alias("by_role")).alias("record"),
    )
    out = nested.select("conv_id", "turn", V.redact_nested(F.col("record"), nested.schema["record"].dataType).alias("r"))
    first = F.map_entries("r.by_role")[0]
    return out.select(
        "conv_id", "turn", F.col("r.body").alias("body"), first["key"].alias("key0"), I.content_hash(first["value"][0]).alias("listed")
    )


@query("fn_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def fn_content_hash(spark, sf):
    return read(spark, sf, "documents").select("doc_id", I.content_hash(F.col("text")).alias("content_hash"))


@query("fn_short_hash", "SELECT doc_id, substr(sha256(source || chr(0) || doc_id || chr(0)), 1, 16) AS short_hash FROM documents")
def fn_short_hash(spark, sf):
    return read(spark, sf, "documents").select("doc_id", I.short_hash(F.col("source"), F.col("doc_id")).alias("short_hash"))


@query("fn_split_bucket", f"SELECT page_id, {bucket_sql('url')} AS bucket, {split_sql('url')} AS split FROM pages")
def fn_split_bucket(spark, sf):
    return read(spark, sf, "pages").select(
        "page_id", I.hash_bucket(F.col("url")).cast("bigint").alias("bucket"), I.split_of(F.col("url")).alias("split")
    )


@query(
    "fn_split_key",
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN source ELSE 'doc_' || doc_id END AS split_key FROM documents",
)
def fn_split_key(spark, sf):
    docs = read(spark, sf, "documents")
    first = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise("")
    second = F.when(F.col("doc_id") % 3 == 1, F.col("source"))
    return docs.select("doc_id", I.split_key([first, second], F.concat(F.lit("doc_"), "doc_id")).alias("split_key"))


@query("fn_confidence", f"SELECT event_id, {rnd('least(0.95e0, greatest(0.1e0, value / 100))', 3)} AS confidence FROM events")
def fn_confidence(spark, sf):
    return read(spark, sf, "events").select("event_id", I.confidence(F.col("value") / F.lit(100.0)).alias("confidence"))


@query(
    "fn_fraction",
    "SELECT event_id, CASE WHEN len(f) = 0 THEN 1.0e0 ELSE len(list_filter(f, lambda b: b)) / len(f) END AS fraction FROM (SELECT event_id, CASE WHEN value < 5 THEN [] ELSE [value < 10, value < 20, user_id % 2 = 0] END AS f FROM events)",
)
def fn_fraction(spark, sf):
    flags = F.when(F.col("value") < 5, F.array().cast("array<boolean>")).otherwise(
        F.array(F.col("value") < 10, F.col("value") < 20, F.col("user_id") % 2 == 0)
    )
    return read(spark, sf, "events").select("event_id", flags.alias("f")).select("event_id", X.fraction_true(F.col("f")).alias("fraction"))


@query("fn_parse_ts", f"SELECT ord, {iso('ts')} AS text, epoch_us(ts) AS micros FROM ev")
def fn_parse_ts(spark, sf):
    events = light(spark, sf)
    return events.select("ord", I.iso_seconds(F.col("ts")).alias("text"), F.unix_micros("ts").alias("micros"))


@query(
    "fn_boundary_terms",
    """SELECT repo, array_to_string(list_sort(list_distinct(list_filter(string_split(translate(array_to_string(
         ['merge_before_review', repo, 'wait_for_ci', 'add_summary_comment'], ' '), '_', ' '), ' '), lambda w: length(w) >= 3))), '|') AS terms
       FROM (SELECT DISTINCT repo FROM ev)""",
)
def fn_boundary_terms(spark, sf):
    entries = F.array(F.lit("merge_before_review"), F.col("repo"), F.lit("wait_for_ci"), F.lit("add_summary_comment"))
    return light(spark, sf).select("repo").distinct().select("repo", F.array_join(X.boundary_terms(entries), "|").alias("terms"))


@query(
    "fn_expected_with_boundary",
    """SELECT event_id, 'Wait for CI|' || actor || '|merge after ci' || CASE WHEN event_type = 'github_issue' THEN '' ELSE '|' || translate(event_type, '_', ' ') END AS must_include
       FROM ev""",
)
def fn_expected_with_boundary(spark, sf):
    base = F.array(F.lit("Wait for CI"), F.col("actor"))
    extra = F.array(
        F.lit("wait for ci"), F.lit("merge after ci"), F.lit(""),
        F.when(F.col("event_type") == "github_issue", F.upper("actor")).otherwise(F.translate("event_type", "_", " ")), F.lit("MERGE after CI"),
    )
    return light(spark, sf).select("event_id", F.array_join(X.append_unique(base, extra), "|").alias("must_include"))
