"""Edge cases on small fixtures, against plain Python where a rule is order-dependent."""

import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from worktrail.functions import ids, privacy, profile_text, text
from worktrail.functions.signals import signal_columns
from worktrail.operators import annotation, audits, checks, mining, profile, retrieval, tables, verify
from worktrail.operators.ordering import group_positions
from worktrail.sources import files, manifests, raw_events

T0 = datetime(2024, 1, 1)


def one(df):
    return df.collect()[0][0]


def light(spark, rows):
    """rows: (repo, day offset, event type, actor, content, claims)"""
    data = [
        (r, T0 + timedelta(days=d), i, f"e{i}", a, t, c, list(cl)) for i, (r, d, t, a, c, cl) in enumerate(rows)
    ]
    return spark.createDataFrame(
        data, "repo string, ts timestamp, ord long, event_id string, actor string, event_type string, content string, claims array<string>"
    )


def test_emergency_events_replace_plain_negatives_in_their_group(spark):
    df = light(
        spark,
        [
            ("a/b", 0, "github_pull_request", "x", "blocked by wip", []),
            ("a/b", 1, "github_commit_comment", "x", "Emergency fix", []),
            ("c/d", 0, "github_issue", "y", "swipe left", []),
        ],
    )
    counts = {r.repo: r for r in profile.signal_counts(df, "repo").collect()}
    assert (counts["a/b"].negative_boundary, counts["a/b"].emergency_negative) == (1, 1)
    assert counts["c/d"].negative_boundary == 1  # a marker inside a word counts
    assert {r.event_id for r in profile.negative_fallback(df).collect()} == {"e1", "e2"}
    ranked = {r.repo: r.negative_boundary for r in profile.rank_counts(df).collect()}
    assert ranked["a/b"] == 2  # the ranking counts event by event


def test_windows_start_at_the_first_event_and_skip_empty_ones(spark):
    rows = [("a/b", d, "github_issue", "x", "n", []) for d in (3, 9.9, 10, 31)]
    got = profile.anchored_windows(light(spark, rows)).orderBy("window_index").collect()
    assert [(r.window_index, r.events) for r in got] == [(0, 2), (1, 1), (4, 1)]
    assert got[0].window_start == "2024-01-04T00:00:00+00:00"
    span = profile.repo_spans(profile.anchored_windows(light(spark, rows))).collect()[0]
    assert (span.windows_total, span.span_days) == (3, 28.0)


def test_summary_handles_null_sections_strings_and_references(spark):
    def rec(payload):
        return spark.read.schema(raw_events.RAW_EVENT).json(
            spark.sparkContext.parallelize(
                ['{"id":"1","type":"IssuesEvent","actor":{"login":"bo"},"repo":{"name":"a/b"},"created_at":"2024-01-01T00:00:00Z","payload":' + payload + "}"]
            )
        )

    def summary(payload):
        return one(rec(payload).select(raw_events.event_summary()))

    assert summary('{"ref":"main"}') == "bo IssuesEvent; repo=a/b; ref=main"
    assert summary('{"action":"x","issue":{"title":"T","body":"T","labels":[{"name":"bug"},"ui"],"assignees":["p",{"login":"q"}],"number":4}}') == (
        "bo IssuesEvent; action=x; repo=a/b; issue: number=4, title=T, labels=bug|ui, assignees=p|q"
    )
    assert summary('{"issue":null,"review":{"state":"approved"}}') == "bo IssuesEvent; repo=a/b; review: title=approved"
    assert one(rec('{"review":{},"comment":{"url":"u"}}').select(raw_events.event_uri())) is None  # first present section has no link
    assert raw_events.light_events(rec("{}").withColumn("ord", F.lit(1)).withColumn("source_file", F.lit("f")).withColumn("created_at", F.lit(""))).count() == 0


def test_malformed_lines_raise(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"1","type":"IssuesEvent"}\n{"id": oops\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        raw_events.read_raw_events(spark, str(tmp_path)).collect()


def test_json_array_and_single_object_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id":"1","type":"IssuesEvent"},{"id":"2","type":"WatchEvent"}]')
    (tmp_path / "b.json").write_text('{"id":"3","type":"PushEvent"}')
    (tmp_path / "c.jsonl").write_text('{"id":"4","type":"PushEvent"}\n\n')
    assert sorted(r.id for r in raw_events.read_raw_events(spark, str(tmp_path)).collect()) == ["1", "2", "3", "4"]


def test_identifiers_splits_and_hashes(spark):
    import hashlib

    names = ["acme/docs", "Ünï/x", "__", "a-review", "b_reviewer", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    rows = df.select("n", ids.safe_condition(F.col("n")).alias("c"), ids.reviewer_slug(F.col("n")).alias("s"), ids.hash_bucket(F.col("n")).alias("b")).collect()
    assert [r.c for r in rows] == ["acme_docs", "ünï_x", "value", "a_review", "b_reviewer", "value"]
    assert [r.s for r in rows] == ["acme_docs", "ünï_x", "value", "a", "b", "value"]
    assert all(r.b == int(hashlib.sha256(r.n.encode()).hexdigest(), 16) % 10 for r in rows)


def test_redaction_is_unicode_aware_and_ordered(spark):
    cases = {
        "é123456789": "é123456789",  # a letter before the digits: no boundary
        "call +49 123 456 789 now": "call +[REDACTED_PHONE] now",
        "mail josé@x.org.": "mail [REDACTED_EMAIL].",
        "key sk-abcdefghij0123456789": "key [REDACTED_SECRET]",
        "12345678 ok": "12345678 ok",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for r in df.select("t", privacy.redact(F.col("t")).alias("r")).collect():
        assert r.r == cases[r.t]
    assert one(spark.range(1).select(privacy.redact(F.lit(None).cast("string")))) is None


def test_requirement_and_negation_rules(spark):
    def check(req, pred):
        df = spark.createDataFrame([(req, pred)], "r string, p string").withColumn("t", text.tokens(F.col("p"))).withColumn("n", F.array_join("t", " "))
        row = df.select(
            text.requirement_matched(F.col("r"), F.col("t"), F.col("n")).alias("m"), text.must_not_violated(F.col("r"), F.col("t"), F.col("n")).alias("v")
        ).collect()[0]
        return row.m, row.v

    assert check("wait_for_ci", "Please wait until the CI is done") == (True, True)
    assert check("merge before CI", "never merge; that is, do not merge before CI") == (True, False)
    assert check("merge before CI", "x " * 30 + "merge before ci") == (True, True)
    assert check("merge before CI", "avoid that: merge before ci") == (True, False)
    assert check("", "anything") == (False, False)
    assert check("alpha beta gamma delta epsilon", "alpha gamma x epsilon") == (True, True)  # 3 of 5 are enough
    assert check("store", "") == (False, False)


def test_empty_requirement_lists_count_as_met(spark):
    df = spark.createDataFrame([([],), ([True, False],)], "f array<boolean>")
    assert [r[0] for r in df.select(text.fraction_true(F.col("f"))).collect()] == [1.0, 0.5]


def test_query_cues(spark):
    df = spark.createDataFrame([("Please apply the needs-triage label and assign dev_1, request the triage",)], "q string")
    assert one(df.select(profile_text.query_label(F.col("q")))) == "needs triage"
    assert one(df.select(profile_text.query_assignees(F.col("q")))) == ["dev 1"]


def test_positions_equal_a_plain_sort(spark):
    random.seed(3)
    rows = [("hot" if random.random() < 0.8 else f"k{random.randrange(3)}", random.randrange(50), i) for i in range(2000)]
    got = group_positions(spark.createDataFrame(rows, "k string, t long, o long"), ["k"], ["t", "o"]).collect()
    want = {}
    for key, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        members = list(group)
        want.update({(key, o): (i, len(members)) for i, (_, _, o) in enumerate(members)})
    assert {(r.k, r.o): (r.pos, r.group_rows) for r in got} == want


def brute_topk(events, query, k, bonus):
    words = set(query)
    scored = []
    for e in events:
        lex = len(words & set(e["words"])) / len(words) if words else 0.0
        scored.append((lex + bonus(e), e))
    scored.sort(key=lambda s: (-s[0], -s[1]["t"], s[1]["ord"]))
    kept = [s for s in scored if s[0] > 0] or scored
    return [s[1]["event_id"] for s in kept[:k]]


@pytest.mark.parametrize("weight", [0.0, 0.3])
def test_retrieval_equals_scoring_every_pair(spark, weight):
    random.seed(7)
    vocabulary = [f"w{i}" for i in range(12)]
    events, probes = [], []
    for p in ("p1", "p2", "hot"):
        for i in range(300 if p == "hot" else 25):
            events.append(
                {"project_id": p, "event_id": f"{p}e{i}", "ord": i, "t": random.randrange(20), "words": random.sample(vocabulary, random.randrange(6)),
                 "extra": random.choice([0.0, -0.4, 0.25])}
            )
        for j in range(6):
            probes.append((p, f"q{j}", random.sample(vocabulary, random.randrange(5)) if j else ["absent"], 0.0))
    ev = spark.createDataFrame(
        [(e["project_id"], e["event_id"], e["ord"], e["t"], e["words"], e["extra"] * weight) for e in events],
        "project_id string, event_id string, ord long, t long, words array<string>, extra double",
    )
    pr = spark.createDataFrame(probes, "project_id string, probe_id string, words array<string>, probe_bonus double")
    got = {}
    for r in retrieval.retrieve(ev, pr, 4, ("extra",), recency_key="t").orderBy("rank").collect():
        got.setdefault((r.project_id, r.probe_id), []).append(r.event_id)
    for p, q, words, _ in probes:
        mine = [e for e in events if e["project_id"] == p]
        assert got[(p, q)] == brute_topk(mine, words, 4, lambda e: e["extra"] * weight), (p, q)


def test_collect_outputs_equals_reading_row_by_row(spark):
    random.seed(5)
    rows = [(i, f"id{random.randrange(8)}", "pack", f"a{random.randrange(8)}", random.random() < 0.15) for i in range(60)]
    ids_seen, keys_seen, want = set(), set(), {}
    for no, pid, pack, ann, blank in rows:
        if blank:
            want[no] = "unfilled_proposal"
        elif pid in ids_seen:
            want[no] = "duplicate_proposal_id"
        elif (pack, ann) in keys_seen:
            want[no] = "duplicate_annotation_output"
        else:
            ids_seen.add(pid)
            keys_seen.add((pack, ann))
            want[no] = "collected"
    df = spark.createDataFrame(rows, "row_no long, proposal_id string, pack_id string, annotation_id string, blank boolean")
    df = df.select(
        "*", F.lit("c").alias("candidate_id"), F.when(F.col("blank"), "").otherwise("text").alias("rewritten_policy"), F.lit("q").alias("future_probe_query"),
        *[F.array(F.lit("x")).alias(c) for c in ("must_include", "must_not_include", "positive_event_ids")],
        F.struct(*[F.array(F.lit("x")).alias(c) for c in ("allowed_actions", "forbidden_actions", "requires_approval", "requires_clarification")]).alias("action_boundary"),
    )
    got = {r.row_no: r.state for r in annotation.collect_outputs(df).collect()}
    taken = {n for n, s in got.items() if s == "collected"}
    assert taken == {n for n, s in want.items() if s == "collected"}
    assert got.keys() == want.keys()


def test_selection_fills_split_minimums_then_the_best(spark):
    rows = [(f"r{i}", "train" if i < 6 else ("dev" if i < 8 else "test"), 100 - i, 1, 1, 1) for i in range(9)]
    df = spark.createDataFrame(rows, "repo string, split string, score long, candidate_count long, review long, negative_boundary long")
    got = {r.repo for r in mining.stratified_select(df, target=5, min_per_split=1).collect()}
    assert got == {"r0", "r6", "r8", "r1", "r2"}
    assert {r.repo for r in mining.stratified_select(df, target=2, min_per_split=3).collect()} == {"r0", "r1"}


def test_temporal_links(spark):
    rows = [("p", "a", T0, ["b"], []), ("p", "b", T0 + timedelta(1), ["a"], ["zz"])]
    df = spark.createDataFrame(rows, "project_id string, event_id string, ts timestamp, causal_links array<string>, supersedes array<string>")
    got = {(r.code, r.subject) for r in checks.temporal_references(df).collect()}
    assert got == {("causal_links points to later event", "a"), ("supersedes references missing event", "b")}


def test_drift_names_each_field(spark):
    a = spark.createDataFrame([("x", 1, "h"), ("y", 2, "h")], "path string, bytes long, sha256 string")
    b = spark.createDataFrame([("x", 1, "g"), ("z", 2, "h")], "path string, bytes long, sha256 string")
    got = {(r.path, r.field) for r in checks.inventory_drift(a, b, "path", ["bytes", "sha256"]).collect()}
    assert got == {("x", "sha256"), ("y", "presence"), ("z", "presence")}


def test_sample_takes_the_minimum_of_each_kind(spark):
    rows = [(f"a{i}", "common" if i < 50 else "rare") for i in range(52)]
    df = spark.createDataFrame(rows, "annotation_id string, kind string")
    got = audits.hash_sample(df, [F.col("annotation_id")], "kind", "annotation_id", 10, 2).collect()
    assert len(got) == 10 and sum(r.kind == "rare" for r in got) >= 2 and sorted(r.selection_rank for r in got) == list(range(1, 11))


def test_bootstrap_equals_drawing_by_hand(spark):
    import hashlib

    import numpy as np

    random.seed(1)
    rows = [("s", f"p{i:04d}", *[round(random.random(), 4) for _ in range(5)]) for i in range(60)] + [("t", "p0001", *[0.5] * 5)]
    df = spark.createDataFrame(rows, "baseline string, project_id string, " + ", ".join(f"{m} double" for m in tables.INTERVAL_METRICS))
    got = {(r.system_name, r.metric): r for r in tables.bootstrap_ci(df, samples=200, seed=3).collect()}
    weights = np.zeros((200, 60))
    for k in range(200):
        for i in range(60):
            u = int(hashlib.md5(f"3|p{i:04d}|{k + 1}".encode()).hexdigest()[:8], 16)
            weights[k, i] = sum(u >= e for e in tables._POISSON)
    assert abs(weights.mean() - 1) < 0.05
    for j, m in enumerate(tables.INTERVAL_METRICS):
        values = np.array([r[2 + j] for r in rows[:60]])
        low, high = np.percentile(weights @ values / weights.sum(axis=1), [2.5, 97.5])
        r = got["s", m]
        assert (r.n_units, abs(r["mean"] - values.mean()) < 1e-4) == (60, True) and abs(r.ci_low - low) < 1e-4 and abs(r.ci_high - high) < 1e-4
        assert tuple(got["t", m])[2:] == (1, 0.5, 0.5, 0.5)


def test_files_of_several_chunks_hash_as_a_whole(spark, tmp_path):
    import hashlib

    from worktrail.sources import files

    (tmp_path / "a b").mkdir()
    data = {"a b/x.BIN": bytes(range(256)) * 50, "y.txt": b"", "a b/z": b"1"}
    for name, body in data.items():
        (tmp_path / name).write_bytes(body)
    rows = files.file_inventory(spark, str(tmp_path), chunk=100)
    got = {r.name: (r.kind, r.bytes, r.sha256) for r in rows.collect()}
    assert {k.replace("%20", " "): v[1:] for k, v in got.items()} == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in data.items()}
    other = tmp_path / "copy"
    other.mkdir()
    (other / "y.txt").write_bytes(b"")
    assert files.directory_digest(files.file_inventory(spark, str(other))).first().sha256 == files.directory_digest(files.file_inventory(spark, str(tmp_path), "y.txt").filter("name = 'y.txt'")).first().sha256


def test_raw_files_of_every_layout_in_file_order(spark, tmp_path):
    import gzip
    import json

    from worktrail.sources.raw_events import read_raw_events

    def event(i, pad=0):
        return json.dumps({"type": "PushEvent", "id": str(i), "actor": {"login": "a" + "x" * pad}, "repo": {"name": "r"}, "created_at": "2024-01-01T00:00:00Z"})

    files = {"b-0.jsonl": [event(i, 3000) for i in range(100, 140)], "b-1.jsonl": [event(i) for i in range(140, 1200)], "a.json": [event(1), "", event(2), event(3)]}
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    (tmp_path / "c.json").write_text("[" + ", ".join(event(i) for i in (2001, 2002)) + "]")
    (tmp_path / "d.json").write_text(json.dumps(json.loads(event(3000)), indent=2))
    (tmp_path / "e.gz").write_bytes(gzip.compress("\n".join(event(i) for i in (4000, 4001)).encode()))
    want = [1, 2, 3, *range(100, 1200), 2001, 2002, 3000, 4000, 4001]
    for size in ("128m", "10k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = read_raw_events(spark, str(tmp_path)).orderBy("ord").select("id", "ord").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [int(r.id) for r in rows] == want and len({r.ord for r in rows}) == len(want)


def test_mail_bodies_keep_their_bytes(spark):
    from worktrail.sources import mail

    long = " ".join(f"w{i}" for i in range(20))
    raws = {
        "latin": b"Subject: Caf\xc3\xa9\n au\tlait\nFrom: A <a@b.org>\nDate: Tue, 5 Mar 2024 23:30:00 EST\nContent-Type: text/plain; charset=latin-1\n\ncaf\xe9 " + long.encode(),
        "utf": b"Content-Type: text/plain; charset=utf-8\n\n\xe6\x95\xb0 \xf0\x9f\x98\x80 " + long.encode(),
        "parts": b"Subject: x\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/plain\n\none " + long.encode() + b"\n--B\nContent-Type: text/html\n\n<p>no\n--B\nContent-Type: text/plain; charset=nope\n\ntwo meeting\n--B--\n",
        "quoted": b"Subject: x\n\nshort\n> " + long.encode() + b"\n",
        "few": b"Subject: x\n\ntoo few words",
    }
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in raws.items()], "path string, raw binary")
    got = {r.path: r for r in mail.mail_records(rows).collect()}
    assert set(got) == {"latin", "utf", "parts", "quoted"}
    assert got["latin"].content == "café " + long and got["latin"].subject == "Café au lait" and got["latin"].timestamp == "2024-03-06T04:30:00+00:00"
    assert got["utf"].content == "数 😀 " + long and got["utf"].timestamp == mail.NO_DATE and got["utf"].subject == mail.NO_SUBJECT
    assert got["parts"].content == f"one {long} two meeting" and got["parts"].event_type == "email_scheduling_thread"
    assert got["quoted"].content == "short" and len(got["quoted"].recipients) == 1


def test_predictor_gets_all_events_of_its_project(spark):
    from worktrail.operators.plugins import apply_predictor

    events = spark.createDataFrame([(f"p{i % 3}", i, f"e{i:05d}", "t", "a", "k", "c") for i in range(3000)], "project_id string, ord long, event_id string, timestamp string, actor string, event_type string, content string")
    probes = spark.createDataFrame([("p0", "q1", "?"), ("p0", "q2", "?"), ("p1", "q1", "?"), ("none", "q1", "?")], "project_id string, probe_id string, query string")

    def oldest(asked, stream):
        ids = [i for batch in stream for i in batch["event_id"]]
        return [(q, str(len(ids)), ids[:1]) for q in asked["probe_id"]]

    got = {(r.project_id, r.probe_id): (r.prediction, r.retrieved_event_ids) for r in apply_predictor(oldest, events, probes).collect()}
    assert got == {("p0", "q1"): ("1000", ["e00000"]), ("p0", "q2"): ("1000", ["e00000"]), ("p1", "q1"): ("1000", ["e00001"]), ("none", "q1"): ("0", [])}
    with pytest.raises(Exception, match="doesn't ask"):
        apply_predictor(lambda asked, stream: [("other", "", [])], events, probes).collect()


def test_full_log_flags_equal_those_of_the_joined_text(spark):
    """Phrases within and across lines, with ends inside longer words, repeated words, refusals
    before and behind; also in a project with one line and in one without a refusal."""
    from worktrail.operators import full_log, predictors

    random.seed(5)
    vocabulary = ["merge", "ci", "wait", "never", "not", "review", "label", "default", "emergency", "stored"]
    events = []
    for p in ("p1", "p2"):
        for i in range(37 if p == "p1" else 3):
            content = " ".join(random.choice(vocabulary[: 4 if i % 9 else 10]) for _ in range(random.randrange(4)))
            events.append((p, T0 + timedelta(minutes=i), i, f"e{i}", "kind", content, ["a"]))
    ev = spark.createDataFrame(events, "project_id string, ts timestamp, ord long, event_id string, event_type string, content string, artifacts array<string>")
    asked = ["merge ci", "wait", "never merge", "label default emergency", "kind merge", "i wai", "stored", "", "review " * 3, "e3 kind ci wait", "erge c", "rge wai", "ait", "t", "do not", "never never", "ci wait merge never", "w wait", "not stored default review label ci"]
    reqs = spark.createDataFrame([(p, r) for p in ("p1", "p2") for r in asked], "project_id string, requirement string")
    got = {(r.project_id, r.requirement): (r.matched, r.violated) for r in full_log.requirement_flags(ev, reqs).collect()}
    logs = predictors.full_log(ev).groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("log"))
    whole = reqs.join(logs, "project_id").withColumn("t", text.tokens(F.col("log"))).withColumn("n", F.array_join("t", " "))
    want = whole.select("project_id", "requirement", text.requirement_matched(F.col("requirement"), F.col("t"), F.col("n")).alias("m"), text.must_not_violated(F.col("requirement"), F.col("t"), F.col("n")).alias("v"))
    assert got == {(r.project_id, r.requirement): (r.m, r.v) for r in want.collect()}
    assert {m for m, _ in got.values()} == {True, False}


def test_retrieval_with_update_classes_and_many_probes(spark):
    """Bonuses whose sums round differently from the scores, and words that all events hold."""
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(23)]
    events, probes = [], []
    for i in range(260):
        words = ["name", *random.sample(vocabulary, random.randrange(7))]
        events.append({"ord": i, "t": random.randrange(30), "words": words, "update": random.choice([0.0, 0.25]), "later": -0.05 * random.randrange(11)})
    for j in range(200):
        probes.append(("p", f"q{j}", random.sample(["name", *vocabulary], random.randrange(1, 24)), 0.0))
    ev = spark.createDataFrame([("p", f"e{e['ord']}", e["ord"], e["t"], e["words"], e["update"], e["later"]) for e in events], "project_id string, event_id string, ord long, t long, words array<string>, update double, later double")
    pr = spark.createDataFrame(probes, "project_id string, probe_id string, words array<string>, probe_bonus double")
    for k in (1, 4):
        got = {}
        for r in retrieval.retrieve(ev, pr, k, ("update", "later"), recency_key="t", classes=("update",)).orderBy("rank").collect():
            got.setdefault(r.probe_id, []).append(r.event_id)
        for _, q, words, _ in probes:
            scored = [((len(set(words) & set(e["words"])) / len(words) + e["update"]) + e["later"], e["t"], -e["ord"]) for e in events]
            best = sorted(scored, reverse=True)
            best = [x for x in best if x[0] > 0] or best
            assert got[q] == [f"e{-x[2]}" for x in best[:k]], q


def test_questions_read_a_part_of_their_postings(spark):
    """A project with many different questions and words of very different frequency: the longest
    lists stay unread and others are read down to the classes that can win."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    events = [("p", f"e{i}", i, i, sorted(set(rng.choices(words, weights, k=14)))) for i in range(1200)]
    probes = []
    for j in range(300):
        base = rng.choice(events)[4]
        probes.append(("p", f"q{j}", sorted(set(rng.sample(base, min(6, len(base))) + rng.choices(words, weights, k=3))), 0.0))
    ev = spark.createDataFrame(events, "project_id string, event_id string, ord long, t long, words array<string>")
    pr = spark.createDataFrame(probes, "project_id string, probe_id string, words array<string>, probe_bonus double")
    trace = {}
    got = {}
    for r in retrieval.retrieve(ev, pr, 5, recency_key="t", trace=trace).orderBy("rank").collect():
        got.setdefault(r.probe_id, []).append(r.event_id)
    for _, q, asked, _ in probes:
        best = sorted(((len(set(asked) & set(e[4])) / len(asked), e[3], -e[2]) for e in events), reverse=True)
        assert got[q] == [f"e{-x[2]}" for x in best[:5] if x[0] > 0], q
    key = ["project_id", "word"]
    read = trace["read"].join(trace["lists"], key).filter(F.col("impact") >= F.col("least") + F.size("everywhere")).count()
    whole = trace["asked"].select("project_id", F.explode("rare").alias("word")).join(trace["lists"], key).count()
    assert read < 0.25 * whole, (read, whole)


def test_manifest_gate_reads_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(
        '{"dataset_name":"d","source_dataset":"s","license":"CC0","project_id":"p","redistribution":{"allowed":true},'
        '"privacy_review":{"status":"passed","pii_redaction":true},"records":[{"record_id":"1","timestamp":"t","content":"mail a@b.org","sender":"a@b.org"},{"record_id":"2","content":"x"}]}'
    )
    headers, records = manifests.read_manifests(spark, str(tmp_path / "m.json"))
    rows = manifests.ingest(headers, records).collect()
    assert [r.artifact_id for r in rows] == ["artifact_email_1"]
    assert rows[0].content == "From: [REDACTED_EMAIL]\nmail [REDACTED_EMAIL]" and rows[0].privacy_tags == ["email"]
    refused = manifests.manifest_issues(headers.withColumn("license", F.lit("N/A")))
    assert [r.reasons for r in refused.collect()] == [["license unknown"]]
    assert manifests.profiles(headers).collect()[0].title == "Email workflow trace: d"


def test_inventory_and_digest(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.bin").write_bytes(b"\x00" * 20)
    inv = files.file_inventory(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in inv.collect()}
    assert got["b.bin"][0] == 20 and len(got["b.bin"][1]) == len(got["a.txt"][1]) == 64
    before = files.directory_digest(inv).collect()[0].sha256
    (tmp_path / "a.txt").write_text("two")
    assert files.directory_digest(files.file_inventory(spark, str(tmp_path))).collect()[0].sha256 != before


def test_contracts_need_positive_types(spark):
    probe = "project_id string, probe_id string, task_type string, evidence struct<positive:array<string>,negative:array<string>,obsolete:array<string>,distractor:array<string>>"
    probes = spark.createDataFrame([("p", "q", "cross_tool_boundary_composition", (["m"], [], [], []))], probe)
    memories = spark.createDataFrame(
        [("p", "m", "user_policy", 0.5, [], [])],
        "project_id string, memory_id string, memory_type string, future_score double, negative_evidence array<string>, relations array<struct<type:string,target:string>>",
    )
    sources = spark.createDataFrame([("p", "m", 0, "e")], "project_id string, memory_id string, pos long, event_id string")
    events = spark.createDataFrame(
        [("p", "e", "bo", "set", "t", [], [])],
        "project_id string, event_id string, actor string, source_dataset string, event_type string, invalidates array<string>, supersedes array<string>",
    )
    got = {r.target for r in verify.contract_issues(probes, memories, sources, events).collect()}
    assert got == {"too few positive memories", "requires negative evidence", "requires distractor evidence", "too few supporting source datasets"}


def test_signal_flags_exist_for_each_rule(spark):
    assert set(signal_columns()) >= {"is_pr_or_comment", "is_review", "is_ci", "is_execution_boundary", "is_merge", "is_emergency", "is_plain_negative"}
