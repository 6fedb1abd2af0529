"""The ten operators as queries over whole tables, each with its production parameters."""

from __future__ import annotations

import functools
import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from worktrail.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable) -> Callable:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from worktrail.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (
  SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS p FROM d WHERE len(lines) >= 3
),
h AS (
  SELECT doc_id, p, lines[p] || chr(10) || lines[p + 1] || chr(10) || lines[p + 2] AS win FROM w
  WHERE regexp_matches(lines[p] || lines[p + 1] || lines[p + 2], '[^ \\t\\v\\f\\r]')
),
later AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS rn FROM h) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, p + k AS p FROM later, (VALUES (0), (1), (2)) AS t(k)),
l AS (SELECT doc_id, len(lines) AS n, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS p FROM d)
SELECT l.doc_id, CAST(any_value(l.n) AS INTEGER) AS lines_seen, CAST(count(gone.p) AS INTEGER) AS lines_cut,
  coalesce(string_agg(l.line, chr(10) ORDER BY l.p) FILTER (WHERE gone.p IS NULL), '') AS text
FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.p = l.p GROUP BY l.doc_id
"""


@query("op4_line_dedup", OP4_SQL)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from worktrail.llm.lines import line_dedup

    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "lines_seen", "lines_cut", "text")


@query("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from worktrail.llm.bpe import encode

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op7_quality_classifier")
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from worktrail.llm.quality_rff import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_decontamination")
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from worktrail.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from worktrail.llm.docstats import COUNTS
    from worktrail.llm.quality_trees import judge, learn

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = learn(docs, table(spark, sf_dir, "labels"))
    return judge(docs, trees).select("doc_id", *COUNTS, "base_failed", "kept", "score")


@query("op2_substring_dedup")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from worktrail.llm.passages import passages

    return passages(table(spark, sf_dir, "documents")).withColumnRenamed("source", "source_doc_id")


@query("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from worktrail.llm.pii import pseudonymise

    name = "spark.worktrail.pii.secret"
    if spark.conf.get(name, None) is None:
        # Pseudonyms of a secret that anybody could read can be undone: without one, make one.
        spark.conf.set(name, secrets.token_hex(16))
    secret = spark.conf.get(name)
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), secret)


@query("op6_warc")
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from worktrail.llm.warc import derivatives, responses

    return derivatives(responses(table(spark, sf_dir, "pages"), "2024-01-01T00:00:00Z"))


@query("op9_lm_scoring")
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from worktrail.llm.pseudo_lm import score

    return score(table(spark, sf_dir, "documents"), every_word=True)


#: crc32 of a list of bytes in DuckDB, bit by bit.
CRC = (
    "xor(list_reduce({}, lambda c, b: list_reduce(range(8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(c, b)), 4294967295), 4294967295)"
)
_DECIMAL = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, coalesce('=' || lang, '-') AS tree,
    sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
    CASE WHEN {CRC.format(_DECIMAL)} % 3 = 0 THEN
      sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))}) END AS altered
  FROM documents
),
p AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n,
    row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS rid FROM d
),
nodes(tree, level, idx, n, digest) AS (
  SELECT tree, 0, idx, n, leaf FROM p
  UNION ALL
  SELECT tree, level + 1, idx // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 8
),
subs AS (SELECT tree, max(level) AS levels, max_by(digest, level) AS subroot FROM nodes GROUP BY tree),
tops AS (
  SELECT subs.*, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM subs JOIN (SELECT DISTINCT tree, lang FROM p) USING (tree)
),
above(level, idx, n, digest) AS (
  SELECT 0, idx, n, subroot FROM tops
  UNION ALL
  SELECT level + 1, idx // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM above WHERE n > 1 GROUP BY level, idx // 8
),
top AS (SELECT max_by(digest, level) AS root, max(level) AS levels FROM above),
own AS (
  SELECT rid, p.tree, unnest(range(subs.levels)) AS level, p.idx FROM p JOIN subs USING (tree)
),
own_top AS (SELECT rid, tops.levels AS below, unnest(range((SELECT levels FROM top))) AS level, tops.idx FROM p JOIN tops USING (tree)),
path AS (
  SELECT rid, own.level AS step, coalesce(string_agg(x.digest, '' ORDER BY x.idx) FILTER (WHERE x.idx < own.idx // pow(8, own.level)::BIGINT), '') AS before,
    coalesce(string_agg(x.digest, '' ORDER BY x.idx) FILTER (WHERE x.idx > own.idx // pow(8, own.level)::BIGINT), '') AS after
  FROM own JOIN nodes x ON x.tree = own.tree AND x.level = own.level AND x.idx // 8 = own.idx // pow(8, own.level + 1)::BIGINT GROUP BY rid, own.level
  UNION ALL
  SELECT rid, o.below + o.level, coalesce(string_agg(x.digest, '' ORDER BY x.idx) FILTER (WHERE x.idx < o.idx // pow(8, o.level)::BIGINT), ''),
    coalesce(string_agg(x.digest, '' ORDER BY x.idx) FILTER (WHERE x.idx > o.idx // pow(8, o.level)::BIGINT), '')
  FROM own_top o JOIN above x ON x.level = o.level AND x.idx // 8 = o.idx // pow(8, o.level + 1)::BIGINT GROUP BY rid, o.below, o.level
),
folds(rid, step, digest) AS (
  SELECT rid, 0, coalesce(altered, leaf) FROM p
  UNION ALL
  SELECT f.rid, f.step + 1, sha256(path.before || f.digest || path.after) FROM folds f JOIN path ON path.rid = f.rid AND path.step = f.step
),
proof AS (SELECT rid, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256 FROM path GROUP BY rid),
folded AS (SELECT rid, max_by(digest, step) AS folded_root FROM folds GROUP BY rid)
SELECT p.doc_id, p.leaf, subs.subroot, top.root, coalesce(proof.proof_sha256, sha256('')) AS proof_sha256, folded.folded_root, folded.folded_root = top.root AS verified
FROM p JOIN subs USING (tree) JOIN folded USING (rid) LEFT JOIN proof USING (rid), top
"""


@query("op12_merkle_manifest", OP12_SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from worktrail.llm.merkle import manifest, proofs, tampered

    docs = tampered(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    return proofs(manifest(docs)).withColumnRenamed("key", "doc_id")


_UTF8 = "list_transform(range(strlen(s)), lambda i: CAST('0x' || substr(hex(encode(s)), 2 * i + 1, 2) AS BIGINT))"
OP13_SQL = f"""
WITH RECURSIVE found AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
),
runs AS (SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s, count(*) AS n FROM found WHERE length(run) >= 7 GROUP BY doc_id, run),
sums AS (SELECT run, n, {CRC.format(_UTF8)} AS h FROM runs),
slips AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM sums),
vocab AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slips WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
places AS (SELECT word, unnest(range(length(word))) AS p FROM vocab),
cut AS (SELECT word, p, left(word, p) || substr(word, p + 2) AS rest FROM places),
pairs AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT cut.word, vocab.word FROM cut JOIN vocab ON vocab.word = cut.rest
  UNION SELECT vocab.word, cut.word FROM cut JOIN vocab ON vocab.word = cut.rest
),
ranked AS (
  SELECT pairs.word, other, v.n AS other_n, count(*) OVER (PARTITION BY pairs.word) AS n_near, row_number() OVER (PARTITION BY pairs.word ORDER BY v.n DESC, other) AS rn
  FROM pairs JOIN vocab v ON v.word = pairs.other
),
formed AS (
  SELECT vocab.word, vocab.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * vocab.n THEN other END AS form, CASE WHEN other_n >= 10 * vocab.n THEN other_n END AS form_n
  FROM vocab LEFT JOIN ranked ON ranked.word = vocab.word AND rn = 1
),
chain(word, last, step) AS (
  SELECT word, word, 0 FROM formed
  UNION ALL SELECT chain.word, formed.form, step + 1 FROM chain JOIN formed ON formed.word = chain.last WHERE formed.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, max_by(last, step) AS root FROM chain GROUP BY word) USING (word)
"""


@query("op13_spelling_variants", OP13_SQL)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from worktrail.llm.spelling import variants

    return variants(table(spark, sf_dir, "documents"))


@query("op11_jaccard_join")
def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from worktrail.llm.shingle_join import similar_documents

    return similar_documents(table(spark, sf_dir, "documents"))
