"""Files as data: inventories with digests, discovery of usable sources, conformance."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worktrail.operators.ordering import top_rows
from worktrail.session import pinned, tasks_wanted

#: Bytes that a task holds of a file while it hashes it; files of any size are hashed alike.
CHUNK_BYTES = 1 << 22


def opened(uri: str):
    """A file of a store that the executors share, open for reading at any place."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(re.sub("^file:/+", "/", uri))
    store, name = fs.FileSystem.from_uri(quote(uri, safe=":/@"))
    return store.open_input_file(name)


def place_of(path: str):
    """(store, path inside it, what stands before such a path in a URI) of a folder."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), re.sub("^(file:)?/+", "/", path).rstrip("/") or "/", "file:"
    store, name = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    at = urlparse(path)
    return store, name.rstrip("/"), f"{at.scheme}://{at.netloc}" if name.startswith("/") else f"{at.scheme}://"


def _sha256_of(uri: str, chunk: int) -> str:
    total = hashlib.sha256()
    with opened(uri) as stream:
        while data := stream.read(chunk):
            total.update(data)
    return total.hexdigest()


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    out = (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")
    return out and not name.startswith(("_common_metadata", "_metadata"))


def _glob(pattern: str) -> re.Pattern:
    """A pattern of file names as Hadoop reads it: * ? [a-c] [^a] {one,other}."""
    out, depth, i = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            inside = pattern[i + 1 : end]
            out += "[" + re.sub("^[!^]", "^", inside).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return re.compile(out, re.DOTALL)


def _listed(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, bytes) of the files below a folder. Tasks list the folders level by level, so that
    no list of all files is held by the driver."""
    wanted = _glob(pattern)

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                store, inside, prefix = place_of(folder)
                itself = store.get_file_info(inside)
                found = [itself] if itself.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inside))
                kept = [x for x in found if not _hidden(x.base_name) and (x.type == fs.FileType.Directory or x.type == fs.FileType.File and wanted.fullmatch(x.base_name))]
                for at in range(0, len(kept), 10_000):
                    some = kept[at : at + 10_000]
                    is_folder = [x.type == fs.FileType.Directory for x in some]
                    columns = [pa.array([prefix + x.path for x in some], pa.string()), pa.array([None if d else x.size for x, d in zip(some, is_folder, strict=True)], pa.int64()), pa.array(is_folder)]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "bytes", "folder"])

    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString()
    folders, files = spark.createDataFrame([(root,)], "path string"), None
    while True:
        level = pinned(folders.mapInArrow(below, "path string, bytes long, folder boolean"))
        some = level.filter("not folder").select("path", "bytes")
        files = some if files is None else files.unionByName(some)
        if level.filter("folder").isEmpty():
            return files
        folders = level.filter("folder").select("path").repartition(tasks_wanted(spark))


def file_inventory(spark: SparkSession, path: str, pattern: str = "*", chunk: int = CHUNK_BYTES) -> DataFrame:
    """(path, name, kind, bytes, sha256) of every file below a folder; ``name`` is the path
    inside it. Tasks list the folders, then read the files in chunks from the store that the
    executors share."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [_sha256_of(uri, chunk) for uri in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], names=["path", "bytes", "sha256"])

    root = urlparse(path).path.rstrip("/") + "/"
    inside = F.regexp_replace("path", "^.*?" + re.escape(root), "")
    dealt = _listed(spark, path, pattern).repartition(tasks_wanted(spark))
    rows = dealt.mapInArrow(hashed, "path string, bytes long, sha256 string").withColumn("name", inside)
    return rows.select("path", "name", F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1)).alias("kind"), "bytes", "sha256")


def directory_digest(inventory: DataFrame, name: str = "name") -> DataFrame:
    """(folder, files, bytes, sha256) of every folder of an inventory, the inventoried one
    (empty name) among them, over all files anywhere below it.

    A file counts in each folder above it, under its path from there, so equal folders have
    equal digests wherever they lie, and a change however far down changes every digest above.
    Hashes of entries are added up in four lanes: sums need no order and are combined before
    the shuffle, so no task ever holds a folder's entries.
    """
    parts = F.split(F.col(name), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("folder"), F.array_join(F.slice(parts, n + 1, 1 << 20), "/").alias("inside")))
    each = inventory.select("bytes", F.coalesce(F.col("sha256"), F.col("bytes").cast("string")).alias("held"), F.explode(above).alias("at"))
    entry = F.sha2(F.concat(F.col("at.inside"), F.lit("\n"), F.col("held")), 256)
    lanes = [F.conv(F.substring("entry", 15 * k + 1, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]
    sums = each.select("at.folder", "bytes", entry.alias("entry")).groupBy("folder").agg(
        F.count("*").alias("files"), F.sum("bytes").alias("bytes"), *[F.sum(lane).alias(f"lane{k}") for k, lane in enumerate(lanes)]
    )
    whole = F.concat_ws("|", F.col("files").cast("string"), *[F.col(f"lane{k}").cast("string") for k in range(4)])
    return sums.select("folder", "files", "bytes", F.sha2(whole, 256).alias("sha256"))


SAMPLE_SCHEMA = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("actor", T.StructType([T.StructField("login", T.StringType())])),
        T.StructField("repo", T.StructType([T.StructField("name", T.StringType())])),
        T.StructField("payload", T.MapType(T.StringType(), T.StringType())),
        T.StructField("created_at", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("license", T.StringType()),
        T.StructField("records", T.ArrayType(T.StringType())),
        T.StructField("redistribution", T.StructType([T.StructField("allowed", T.BooleanType())])),
        T.StructField("privacy_review", T.StructType([T.StructField("status", T.StringType()), T.StructField("pii_redaction", T.BooleanType())])),
        T.StructField("text", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("meta", T.StringType()),
    ]
)
MANIFEST_DOMAINS = ["calendar_workflow", "docs_workflow", "chat_workflow", "browser_web_workflow"]
# Words in a path and the kind they suggest when no record proves more.
PATH_KINDS = [
    (["gharchive", "gh_archive", "githubarchive"], "possible_gharchive_unverified", 0.4),
    (["enron", "avocado", "email"], "email_corpus_requires_manifest", 0.35),
    (["calendar"], "calendar_workflow_requires_manifest", 0.32),
    (["docs", "document"], "docs_workflow_requires_manifest", 0.32),
    (["chat"], "chat_workflow_requires_manifest", 0.32),
    (["browser", "search"], "browser_web_workflow_requires_manifest", 0.32),
    (["github_sample"], "github_code_corpus_not_workflow", 0.75),
]


def record_kind(r: Column) -> Column:
    """What one sampled JSON record is."""
    event = r["type"].isNotNull() & r["actor"].isNotNull() & r["repo"].isNotNull() & r["payload"].isNotNull() & r["created_at"].isNotNull()
    gate = (
        r["records"].isNotNull()
        & (F.coalesce(r["license"], F.lit("")) != "")
        & F.coalesce(r["redistribution"]["allowed"], F.lit(False))
        & F.coalesce(r["privacy_review"]["status"] == "passed", F.lit(False))
        & F.coalesce(r["privacy_review"]["pii_redaction"], F.lit(False))
    )
    body = F.coalesce(r["text"], r["content"])
    code = body.isNotNull() & (F.lower(F.coalesce(r["meta"], F.lit(""))).contains("github") | body.rlike("def |class |#include"))
    return (
        F.when(event, "gharchive_event")
        .when(gate & (r["domain"].isNull() | (r["domain"] == "email_workflow")), "email_workflow_manifest")
        .when(gate & r["domain"].isin(MANIFEST_DOMAINS), F.concat(F.lit("manifest:"), r["domain"]))
        .when(code, "github_code_corpus")
        .otherwise("unknown")
    )


def discover(files: DataFrame, lines: DataFrame, samples: int = 5) -> DataFrame:
    """Kind, confidence and usability per file. ``files`` holds path and bytes, ``lines``
    path, line_no and line; the first records of a file decide, else its name."""
    first = top_rows(lines.filter(F.trim("line") != ""), ["path"], [F.col("line_no")], samples)
    kinds = first.withColumn("r", F.from_json("line", SAMPLE_SCHEMA, {"mode": "PERMISSIVE"})).filter("r is not null").withColumn("kind", record_kind(F.col("r")))
    seen = kinds.groupBy("path").agg(F.collect_set("kind").alias("kinds"))
    rows = files.join(seen, "path", "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    low = F.lower("path")
    domain = F.regexp_replace(F.array_min(F.filter("kinds", lambda k: k.startswith("manifest:"))), "^manifest:", "")
    kind = F.when(F.array_contains("kinds", "gharchive_event"), "gharchive_public_events").when(
        F.array_contains("kinds", "email_workflow_manifest"), "email_workflow_manifest"
    ).when(domain.isNotNull(), F.concat(domain, F.lit("_manifest")))
    confidence = F.when(F.array_contains("kinds", "gharchive_event"), 0.95).when(F.array_contains("kinds", "email_workflow_manifest"), 0.9).when(domain.isNotNull(), 0.86)
    for words, name, sure in PATH_KINDS:
        named = low.rlike("|".join(words))
        kind, confidence = kind.when(named, name), confidence.when(named, sure)
    code = F.array_contains("kinds", "github_code_corpus")
    kind, confidence = kind.when(code, "github_code_corpus_not_workflow"), confidence.when(code, 0.75)
    usable = F.col("dataset_kind").isin("gharchive_public_events", "email_workflow_manifest") | F.col("dataset_kind").rlike("^(calendar|docs|chat|browser_web)_workflow_manifest$")
    return rows.select("path", "bytes", kind.alias("dataset_kind"), confidence.alias("confidence")).filter("dataset_kind is not null").withColumn("usable", usable)


def conformance(lines: DataFrame, schema: T.StructType, required: list[str]) -> DataFrame:
    """Rows by reason: valid, malformed, or the first required field that is missing."""
    marked = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = lines.withColumn("r", F.from_json("line", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    reason = F.when(F.col("r").isNull() | F.col("r._corrupt_record").isNotNull(), "malformed")
    for name in required:
        reason = reason.when(F.col(f"r.{name}").isNull(), f"missing {name}")
    return parsed.groupBy(reason.otherwise("valid").alias("reason")).agg(F.count("*").alias("n"))
