"""Integrity of an annotation release: manifest, packs, splits, task rows and prompt exports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrail.operators.checks import union_all
from worktrail.operators.ordering import beside

SPLITS = ["train", "dev", "test"]
KEY = ["pack_id", "annotation_id"]


@dataclass
class Release:
    """Tables of a release as found.

    manifest: one row (packs, tasks, train, dev, test, generation_allowed, validation_required);
    packs: its entries (pack_id, repo, split, path, tasks, content_hash); files: the pack files
    (pack_id, file_pack_id, repo, tasks, content_hash); members: the split list (pack_id, split);
    split_tasks: rows of the split files (file_split, split, pack_id, annotation_id); all_tasks:
    rows of the common file (split, pack_id, annotation_id); prompts: exported prompts
    (export_pack_id, pack_id, annotation_id, allowed_positive_event_ids, action_boundary);
    exports: the export report's entries (pack_id, prompts); batch: its one-row head (packs,
    prompts, generation_performed, validation_required).
    """

    manifest: DataFrame
    packs: DataFrame
    files: DataFrame
    members: DataFrame
    split_tasks: DataFrame
    all_tasks: DataFrame
    prompts: DataFrame
    exports: DataFrame
    batch: DataFrame


def _issue(df: DataFrame, code: str, subject: str | Column) -> DataFrame:
    named = F.col(subject) if isinstance(subject, str) else subject
    return df.select(F.lit(code).alias("code"), named.cast("string").alias("subject"))


def _twice(df: DataFrame, code: str, *keys: str) -> DataFrame:
    return _issue(df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1"), code, keys[-1])


def _whole(df: DataFrame, checks: dict[str, Column]) -> list[DataFrame]:
    """Issues of a one-row table; each condition names a fault of the release as a whole."""
    return [_issue(df.filter(bad), code, F.lit("release")) for code, bad in checks.items()]


def manifest_issues(r: Release) -> list[DataFrame]:
    listed = r.packs.agg(F.count("*").alias("n_packs"), F.coalesce(F.sum("tasks"), F.lit(0)).alias("n_tasks"))
    rows = r.all_tasks.agg(F.count("*").alias("n_rows"))
    in_splits = r.split_tasks.agg(F.count("*").alias("n_split_rows"))
    either = r.split_tasks.select(*KEY).distinct().withColumn("a", F.lit(1)).join(r.all_tasks.select(*KEY).distinct().withColumn("b", F.lit(1)), KEY, "full")
    apart = either.agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("n_apart"))
    head = beside(r.manifest, listed, rows, in_splits, apart)
    sums = F.col("train") + F.col("dev") + F.col("test")
    whole = _whole(
        head,
        {
            "release_llm_generation_allowed_not_false": F.coalesce("generation_allowed", F.lit(True)),
            "release_rewrite_validation_not_required": ~F.coalesce("validation_required", F.lit(False)),
            "release_has_no_packs": F.col("packs") <= 0,
            "release_has_no_tasks": F.col("tasks") <= 0,
            "pack_count_mismatch": F.col("packs") != F.col("n_packs"),
            "split_task_total_mismatch": F.col("tasks") != sums,
            "pack_task_total_mismatch": F.col("tasks") != F.col("n_tasks"),
            "all_tasks_file_missing": (F.col("n_rows") == 0) & (F.col("n_split_rows") > 0),
            "all_task_count_mismatch": (F.col("n_rows") > 0) & (F.col("tasks") != F.col("n_rows")),
            "all_tasks_not_equal_split_union": F.col("n_apart") > 0,
        },
    )
    declared = r.manifest.select(F.explode(F.array(*[F.struct(F.lit(s).alias("file_split"), F.col(s).alias("declared")) for s in SPLITS])).alias("d")).select("d.*")
    found = r.split_tasks.groupBy("file_split").agg(F.count("*").alias("n"))
    sized = declared.join(found, "file_split", "left")
    return [
        *whole,
        _issue(sized.filter("n is null and declared > 0"), "split_task_file_missing", "file_split"),
        _issue(sized.filter("n <> declared"), "split_task_count_mismatch", "file_split"),
    ]


def pack_issues(r: Release) -> list[DataFrame]:
    named = r.packs.filter("pack_id <> ''")
    repos = named.groupBy("repo").agg(F.count_distinct("split").alias("n")).filter("n > 1")
    given = r.files.select("pack_id", "file_pack_id", F.col("repo").alias("file_repo"), F.col("tasks").alias("file_tasks"), F.col("content_hash").alias("file_hash"))
    both = named.join(given, "pack_id", "left")
    there = both.filter("file_hash is not null")
    return [
        _issue(r.packs.filter("coalesce(pack_id, '') = ''"), "pack_id_missing", F.coalesce("repo", F.lit(""))),
        _twice(named, "duplicate_pack_id", "pack_id"),
        _issue(repos, "repo_in_multiple_splits", "repo"),
        _issue(named.filter(~F.col("split").isin(SPLITS)), "invalid_pack_split", "pack_id"),
        _issue(named.filter("coalesce(path, '') = ''"), "pack_path_missing", "pack_id"),
        _issue(both.filter("file_hash is null and path <> ''"), "pack_file_missing", "pack_id"),
        _issue(there.filter("file_hash <> content_hash"), "pack_content_hash_mismatch", "pack_id"),
        _issue(there.filter("file_pack_id <> pack_id"), "pack_id_mismatch", "pack_id"),
        _issue(there.filter("file_repo <> '' and repo <> '' and file_repo <> repo"), "pack_repo_mismatch", "pack_id"),
        _issue(there.filter("file_tasks <> tasks"), "pack_task_count_mismatch", "pack_id"),
    ]


def split_issues(r: Release) -> list[DataFrame]:
    ids = r.packs.select("pack_id")
    known = r.packs.select("pack_id", F.col("split").alias("m_split"))
    m = r.members.join(known, "pack_id")
    rows = r.all_tasks.join(known, "pack_id")
    actual = r.all_tasks.groupBy("pack_id").agg(F.count("*").alias("actual"))
    counted = r.packs.join(actual, "pack_id", "left").filter(F.coalesce("actual", F.lit(0)) != F.col("tasks"))
    placed = rows.select("pack_id", "m_split").distinct().join(r.members.select("pack_id", F.col("split").alias("listed")), "pack_id", "left")
    return [
        _twice(r.members, "duplicate_split_pack_id", "pack_id"),
        _issue(r.members.join(ids, "pack_id", "left_anti"), "split_references_unknown_pack", "pack_id"),
        _issue(ids.join(r.members, "pack_id", "left_anti"), "split_missing_manifest_pack", "pack_id"),
        _issue(m.filter("split <> m_split"), "split_pack_assignment_mismatch", "pack_id"),
        _issue(r.split_tasks.filter("split <> file_split"), "task_split_field_mismatch", "annotation_id"),
        _issue(r.split_tasks.join(ids, "pack_id", "left_anti"), "task_unknown_source_pack", "annotation_id"),
        _twice(r.split_tasks, "duplicate_split_task", *KEY),
        _twice(r.all_tasks, "duplicate_all_task", *KEY),
        _issue(rows.filter("split <> m_split"), "task_manifest_split_mismatch", "annotation_id"),
        _issue(placed.filter("not listed <=> m_split").select("pack_id").distinct(), "task_splits_manifest_mismatch", "pack_id"),
        _issue(counted, "task_count_per_pack_mismatch", "pack_id"),
    ]


def prompt_issues(r: Release) -> list[DataFrame]:
    ids = r.packs.select("pack_id")
    released, exported = r.all_tasks.select(*KEY).distinct(), r.prompts.select(*KEY).distinct()
    uncovered = released.join(exported, KEY, "left_anti").select("pack_id").unionByName(exported.join(released, KEY, "left_anti").select("pack_id"))
    rows = r.prompts.groupBy(F.col("export_pack_id").alias("pack_id")).agg(F.count("*").alias("n"))
    sized = r.exports.join(rows, "pack_id", "left")
    head = beside(r.batch, r.exports.agg(F.count("*").alias("n_packs")), r.prompts.agg(F.count("*").alias("n_prompts")))
    whole = _whole(
        head,
        {
            "prompt_export_llm_generation_not_false": F.coalesce("generation_performed", F.lit(True)),
            "prompt_export_validation_not_required": ~F.coalesce("validation_required", F.lit(False)),
            "prompt_summary_pack_count_mismatch": F.col("packs") != F.col("n_packs"),
            "prompt_summary_total_mismatch": F.col("prompts") != F.col("n_prompts"),
        },
    )
    return [
        *whole,
        _twice(r.exports, "duplicate_prompt_export_pack_id", "pack_id"),
        _issue(ids.join(r.exports, "pack_id", "left_anti"), "prompt_export_missing_release_pack", "pack_id"),
        _issue(r.exports.join(ids, "pack_id", "left_anti"), "prompt_export_unknown_pack", "pack_id"),
        _issue(sized.filter("n is null and prompts > 0"), "prompt_export_file_missing", "pack_id"),
        _issue(r.exports.filter("prompts <= 0"), "prompt_export_empty", "pack_id"),
        _issue(sized.filter("n <> prompts"), "prompt_export_count_mismatch", "pack_id"),
        _issue(r.prompts.filter("pack_id <> export_pack_id"), "prompt_pack_id_mismatch", "annotation_id"),
        _issue(r.prompts.select(*KEY).join(released, KEY, "left_anti"), "prompt_unknown_annotation", "annotation_id"),
        _issue(r.prompts.filter(F.size("allowed_positive_event_ids") == 0), "prompt_missing_positive_event_constraints", "annotation_id"),
        _issue(r.prompts.filter(F.col("action_boundary").isNull()), "prompt_missing_action_boundary_constraint", "annotation_id"),
        _issue(uncovered.join(ids, "pack_id", "left_semi").distinct(), "prompt_annotation_coverage_mismatch", "pack_id"),
    ]


def release_issues(release: Release) -> DataFrame:
    """Issue rows (code, subject); faults of the release as a whole have the subject release."""
    return union_all([*manifest_issues(release), *pack_issues(release), *split_issues(release), *prompt_issues(release)])
