"""Operators that split what used to be one running pass: results equal those of the pass."""

import hashlib
import io
import random
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from worktrail.operators import annotation, tables
from worktrail.operators.ordering import group_offsets, group_positions
from worktrail.operators.plugins import apply_predictor
from worktrail.sources import files, mail


def greedy(tokens, max_prompts, max_tokens):
    out, job, count, used = [], 1, 0, 0
    for t in tokens:
        if count and (count >= max_prompts or used + t > max_tokens):
            job, count, used = job + 1, 0, 0
        count, used = count + 1, used + t
        out.append(job)
    return out


@pytest.mark.parametrize(("n", "shard", "most", "limit"), [(1, 5, 3, 10), (230, 10, 4, 30), (230, 7, 7, 25), (97, 1000, 5, 40), (64, 8, 8, 10**9), (50, 9, 3, 1)])
def test_bins_equal_one_running_sum(spark, monkeypatch, n, shard, most, limit):
    """Bins over shard ends, prompts beyond the limit alone, limits that never bind."""
    rng = random.Random(n + shard)
    sizes = [rng.choice([1, 2, 3, 7, 11, 60]) for _ in range(n)]
    monkeypatch.setattr(annotation, "estimated_tokens", lambda prompts: F.col("size"))
    rows = spark.createDataFrame([(f"q{i:05d}", "p", "r", s) for i, s in enumerate(sizes)], "prompt_id string, pack_id string, repo string, size long").repartition(3)
    got = {r.prompt_id: r.job_id for r in annotation.pack_jobs(rows, most, limit, shard).collect()}
    assert [got[f"q{i:05d}"] for i in range(n)] == [f"rewrite_job_{j:04d}" for j in greedy(sizes, most, limit)]


def test_bins_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(annotation, "estimated_tokens", lambda prompts: F.col("size"))
    assert annotation.pack_jobs(spark.createDataFrame([], "prompt_id string, pack_id string, repo string, size long")).count() == 0


def test_offsets_are_running_sums(spark):
    rows = [("a", i, i % 5) for i in range(40)] + [("b", 0, 3), (None, 1, 2), (None, 2, 2)]
    df = spark.createDataFrame(rows, "g string, i long, w long")
    got = {(r.g, r.i): r.offset for r in group_offsets(df.filter("g is not null"), ["g"], ["i"], F.col("w")).collect()}
    assert all(got[g, i] == sum(w for h, j, w in rows if h == g and j < i) for g, i, _ in rows if g)
    assert {(r.g, r.i, r.pos, r.group_rows) for r in group_positions(df.filter("g = 'b'"), ["g"], ["i"]).collect()} == {("b", 0, 0, 1)}


def test_intervals_equal_plain_resampling(spark):
    rng = random.Random(1)
    rows = [(s, f"p{i}", *[round(rng.random(), 4) for _ in tables.INTERVAL_METRICS]) for s in ("x", "y") for i in range(30)] + [("z", "p0", *[0.5] * 5)]
    shape = "baseline string, project_id string, " + ", ".join(f"{m} double" for m in tables.INTERVAL_METRICS)
    df = spark.createDataFrame(rows, shape).repartition(4)
    got = {(r.system_name, r.metric): (r.n_units, r["mean"], r.ci_low, r.ci_high) for r in tables.bootstrap_ci(df, samples=60).collect()}
    for system in ("x", "y", "z"):
        mine = [r for r in rows if r[0] == system]
        for k, m in enumerate(tables.INTERVAL_METRICS):
            means = []
            for rep in range(1, 61):
                times = [sum(int(hashlib.md5(f"0|{r[1]}|{rep}".encode()).hexdigest()[:8], 16) >= e for e in tables._POISSON) for r in mine]
                if sum(times):
                    means.append(sum(t * r[2 + k] for t, r in zip(times, mine, strict=True)) / sum(times))
            ends = np.quantile(means, [0.025, 0.975]) if len(mine) > 1 else [mine[0][2 + k]] * 2
            want = (len(mine), round(sum(r[2 + k] for r in mine) / len(mine), 4), *[round(float(e), 4) for e in ends])
            assert got[system, m] == pytest.approx(want, abs=1.01e-4)


def test_a_change_far_down_changes_every_digest_above(spark, tmp_path):
    for top in ("left", "right"):
        (tmp_path / top / "b" / "c").mkdir(parents=True)
        (tmp_path / top / "b" / "c" / "x.txt").write_text("one")
        (tmp_path / top / "y.txt").write_text("two")
    read = lambda: {r.folder: (r.files, r.bytes, r.sha256) for r in files.directory_digest(files.file_inventory(spark, str(tmp_path))).collect()}
    before = read()
    assert set(before) == {"", "left", "left/b", "left/b/c", "right", "right/b", "right/b/c"}
    assert before["left"] == before["right"] and before["left/b"] == before["right/b"] and before["left"] != before["left/b"]
    assert before[""][:2] == (4, 12)
    (tmp_path / "left" / "b" / "c" / "x.txt").write_text("One")
    after = read()
    assert {f for f in after if after[f] != before[f]} == {"", "left", "left/b", "left/b/c"}


def test_a_projects_questions_come_in_blocks(spark):
    events = spark.createDataFrame([("p", i, f"e{i}", "t", "a", "k", "c") for i in range(50)], "project_id string, ord long, event_id string, timestamp string, actor string, event_type string, content string")
    probes = spark.createDataFrame([("p", f"q{i:02d}", "?") for i in range(23)] + [("empty", "q00", "?")], "project_id string, probe_id string, query string")

    def count(asked, stream):
        n = sum(len(batch) for batch in stream)
        return [(q, f"{len(asked)} {n}", []) for q in asked["probe_id"]]

    got = {(r.project_id, r.probe_id): r.prediction for r in apply_predictor(count, events, probes, block=10).collect()}
    assert got == {**{("p", f"q{i:02d}"): f"{10 if i < 20 else 3} 50" for i in range(23)}, ("empty", "q00"): "1 0"}


def message(k, charset="utf-8", body=b"please schedule the call with the whole team for the next review of this plan on monday morning"):
    return b"Date: Mon, 1 Jan 2024 10:00:00 +0100\nFrom: a%d@example.org\nTo: b@example.org\nSubject: Note %d\nContent-Type: text/plain; charset=%s\n\n%s %d\n" % (k, k, charset.encode(), body, k)


def test_archives_give_the_rows_of_their_folders(spark, tmp_path):
    names = {f"box/{'sent' if k % 3 else 'inbox'}/s{k // 10}/{k}.": message(k) for k in range(60)}
    names["box/sent/empty"] = b""
    (tmp_path / "out").mkdir()
    for name, data in names.items():
        (tmp_path / "out" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "out" / name).write_bytes(data)
    (tmp_path / "plain").mkdir()
    (tmp_path / "packed").mkdir()
    with tarfile.open(tmp_path / "plain" / "m.tar", "w") as plain, tarfile.open(tmp_path / "packed" / "m.tar.gz", "w:gz") as packed:
        for archive in (plain, packed):
            for name, data in names.items():
                info = tarfile.TarInfo(name)
                info.size = len(data)
                archive.addfile(info, io.BytesIO(data))
            link = tarfile.TarInfo("box/sent/link")
            link.type, link.linkname = tarfile.SYMTYPE, "empty"
            archive.addfile(link)
    want = {r.path.split("/out/")[1]: (r.subject, r.sender, r.timestamp, r.content) for r in mail.mail_records(mail.read_maildir(spark, str(tmp_path / "out"))).collect()}
    assert len(want) == 40
    for kind in ("plain", "packed"):
        raw = mail.read_mail_archives(spark, str(tmp_path / kind), members=7)
        assert raw.count() == 41
        assert {r.path: (r.subject, r.sender, r.timestamp, r.content) for r in mail.mail_records(raw).collect()} == want
    cut = (tmp_path / "plain" / "m.tar").read_bytes()[:30000]
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "m.tar").write_bytes(cut)
    assert 0 < mail.read_mail_archives(spark, str(tmp_path / "cut")).count() < 41


@pytest.mark.parametrize("charset", ["undefined", "idna", "hex", "base64", "rot13", "no-such", "utf-7", "utf-16", "punycode", "unicode_escape", "raw_unicode_escape", '"utf-8"', ""])
def test_odd_character_sets_give_rows(spark, charset):
    raw = spark.createDataFrame([("a", message(1, charset)), ("b", message(2, charset, b"\xff\xd8\\ud800 caf\xe9 " * 30))], "path string, raw binary")
    assert raw.count() == mail.parse_messages(raw).filter("body IS NOT NULL").count() == 2


def test_a_snapshot_holds_the_last_row_per_key(spark, tmp_path):
    from worktrail.streaming import streams

    path = str(tmp_path / "snap")
    shape = "k string, n long"
    batches = [[("a", 1), ("b", 1), (None, 1)], [("a", 2), ("c", 1)], [], [("b", 3), (None, 4)], [("d", 9)]]
    want = {}
    for number, rows in enumerate(batches):
        for _ in range(2):  # a batch that runs again changes nothing
            streams.fold_batch(spark.createDataFrame(rows, shape), number, path, ["k"], buckets=4)
        want |= dict(rows)
        got = streams.latest(spark, path, spark.createDataFrame([], shape).schema).collect()
        assert sorted(((r.k, r.n) for r in got), key=str) == sorted(want.items(), key=str)
    kept = {p.name for p in (tmp_path / "snap" / "versions").iterdir()}
    assert kept == {"batch=3", "batch=4"}
    assert streams.latest(spark, str(tmp_path / "none"), spark.createDataFrame([], shape).schema).count() == 0


def test_late_repeated_and_answered_rows(spark, tmp_path):
    from worktrail.streaming import streams

    rows = [("p", "q1", "2024-01-01", "first"), ("p", "q2", "2024-01-02", "answered"), ("p", "q3", "2024-01-25", "c")], [("p", "q1", "2024-01-19", "again"), ("p", "q4", "2024-01-02", "late"), ("p", "q5", "2024-02-20", "e")]
    answered = spark.createDataFrame([("p", "q2"), ("p", "q2")], "project_id string, probe_id string")
    path, told = str(tmp_path), []
    for part in rows:
        df = spark.createDataFrame(part, "project_id string, probe_id string, day string, prediction_id string").withColumn("ts", F.to_timestamp("day"))
        df.coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{path}/in")
        told += streams.run_append(streams.first_predictions(stream, "10 days", answered), path)
    # q1 comes again after its state went with the watermark; within the horizon it doesn't.
    assert {r.prediction_id for r in spark.read.parquet(f"{path}/rows").collect()} == {"first", "c", "again", "e"}
    assert sum(p["late"] for p in told) == 1 and told[-1]["state"] == 1 and max(p["state"] for p in told) >= 2
