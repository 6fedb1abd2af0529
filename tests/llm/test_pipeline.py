import test_bpe
import test_decontam
import test_lines
import test_quality
import test_simhash

import corpus_pipeline
from worktrail.session import pinned

SF = "/root/testdata/sf0.001"


def test_each_stage_equals_brute_force_on_its_own_input(spark):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = [tuple(r) for r in docs.collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "simhash_near_dedup", "decontamination", "byte_bpe"]
    for name, stage in corpus_pipeline.STAGES:
        out = pinned(stage(spark, docs, SF))
        got = [tuple(r) for r in out.collect()]
        text = dict((r[0], r[1]) for r in given)
        if name == "quality_rules":
            assert set(got) <= set(given)
            for doc_id, body, *_ in given:
                n, _, _, _, again = test_quality.brute_counts(body)
                assert doc_id not in {r[0] for r in got} or (n >= 50 and 100 * again <= 50 * n)
            bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").collect()}
            good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
            kept = {r[0] for r in got}
            assert len(kept & bad) <= 0.05 * len(bad) and len(good - kept - {d for d, t in text.items() if len(t.split()) < 50}) <= 0.05 * len(good)
        elif name == "line_dedup":
            want = {r[0]: r[3] for r in test_lines.brute(list(text.items())) if r[2] == 0 or r[3].strip()}
            assert {r[0]: r[1] for r in got} == want and all(r[4] == len(r[1]) for r in got)
        elif name == "simhash_near_dedup":
            rows = list(text.items())
            groups = {k: c for k, _, c in test_simhash.expected(rows)}
            assert sorted(got) == sorted(r for r in given if groups[r[0]] == r[0])
        elif name == "decontamination":
            items = [" " + " ".join(test_decontam.words(r.text)) + " " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            holds = {d for d, t in text.items() if any(i in " " + " ".join(test_decontam.words(t)) + " " for i in items)}
            assert holds and sorted(got) == sorted(r for r in given if r[0] not in holds)
        else:
            assert sorted((r[:4] for r in got), key=str) == test_bpe.expected(list(text.items()))
            assert all(r[4] == test_bpe.WHOLE.encode_ordinary(text[r[0]]) for r in got)
        if name != "byte_bpe":
            assert out.columns == columns and got
        docs, given = out, got
    assert sorted(tuple(r)[:4] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r[:4] for r in given)


def test_empty_and_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, "one listed item of words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    long = "\n".join(" ".join(f"w{i}x{j}" for j in range(30)) for i in range(6))
    rows = [(1, long, None, None, None), (1, long, None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (None, long + "\nmore words here", "en", "s", 5)]
    for some in ([], rows):
        docs = spark.createDataFrame(some, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = pinned(stage(spark, docs, str(tmp_path)))
        assert sorted((r.doc_id for r in docs.collect()), key=str) == ([1, None] if some else [])
