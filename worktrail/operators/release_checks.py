"""Verification of a project release: manifest, splits, project files and probe rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrail.operators.checks import union_all
from worktrail.operators.integrity import SPLITS, _issue, _twice, _whole
from worktrail.operators.ordering import beside

KEY = ["project_id", "probe_id"]


@dataclass
class ProjectRelease:
    """Tables of a release as found.

    manifest: one row (projects, probes, train, dev, test, verifier_required, generation_used,
    generation_validated); projects: its entries (project_id, split, probes, verifier_passed);
    members: the split list (project_id, split); listed: files the entries name (project_id,
    file, sha256); found: files that exist (project_id, file, sha256, profile_id, null but for a
    profile); split_probes: rows of the split files (file_split, split, project_id, probe_id);
    all_probes: rows of the common file (split, project_id, probe_id).
    """

    manifest: DataFrame
    projects: DataFrame
    members: DataFrame
    listed: DataFrame
    found: DataFrame
    split_probes: DataFrame
    all_probes: DataFrame


def _totals(r: ProjectRelease) -> list[DataFrame]:
    listed = r.projects.agg(F.count("*").alias("n_projects"), F.coalesce(F.sum("probes"), F.lit(0)).alias("n_probes"))
    rows = r.all_probes.agg(F.count("*").alias("n_rows"))
    in_splits = r.split_probes.agg(F.count("*").alias("n_split_rows"))
    either = r.split_probes.select(*KEY).distinct().withColumn("a", F.lit(1)).join(r.all_probes.select(*KEY).distinct().withColumn("b", F.lit(1)), KEY, "full")
    apart = either.agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("n_apart"))
    whole = _whole(
        beside(r.manifest, listed, rows, in_splits, apart),
        {
            "project_release_has_no_projects": F.col("projects") <= 0,
            "project_release_has_no_probes": F.col("probes") <= 0,
            "project_count_mismatch": F.col("projects") != F.col("n_projects"),
            "project_probe_total_mismatch": F.col("probes") != F.col("n_probes"),
            "project_split_probe_total_mismatch": F.col("probes") != F.col("train") + F.col("dev") + F.col("test"),
            "project_release_verifier_not_required": ~F.coalesce("verifier_required", F.lit(False)),
            "project_release_unvalidated_llm_generation": F.coalesce("generation_used", F.lit(False)) & ~F.coalesce("generation_validated", F.lit(False)),
            "all_project_probes_file_missing": (F.col("n_rows") == 0) & (F.col("n_split_rows") > 0),
            "all_project_probe_count_mismatch": (F.col("n_rows") > 0) & (F.col("probes") != F.col("n_rows")),
            "all_project_probes_not_equal_split_union": F.col("n_apart") > 0,
        },
    )
    declared = r.manifest.select(F.explode(F.array(*[F.struct(F.lit(s).alias("file_split"), F.col(s).alias("declared")) for s in SPLITS])).alias("d")).select("d.*")
    sized = declared.join(r.split_probes.groupBy("file_split").agg(F.count("*").alias("n")), "file_split", "left")
    return [
        *whole,
        _issue(sized.filter("n is null and declared > 0"), "project_split_probe_file_missing", "file_split"),
        _issue(sized.filter("n <> declared"), "project_split_probe_count_mismatch", "file_split"),
    ]


def _files(r: ProjectRelease) -> list[DataFrame]:
    there = r.found.select("project_id").distinct()
    known = r.listed.join(there, "project_id", "left_semi")
    both = known.withColumnRenamed("sha256", "listed_hash").join(r.found, ["project_id", "file"], "left")
    present = both.filter("sha256 is not null")
    return [
        _issue(r.projects.filter("coalesce(project_id, '') <> ''").join(there, "project_id", "left_anti"), "project_dir_missing", "project_id"),
        _issue(both.filter("sha256 is null"), "project_release_file_missing", "project_id"),
        _issue(present.filter("listed_hash is null"), "project_file_hash_missing", "project_id"),
        _issue(present.filter("listed_hash <> sha256"), "project_file_hash_mismatch", "project_id"),
        _issue(r.found.filter("profile_id <> project_id"), "project_profile_id_mismatch", "project_id"),
    ]


def _rows(r: ProjectRelease) -> list[DataFrame]:
    named = r.projects.filter("project_id <> ''")
    ids = named.select("project_id")
    known = named.select("project_id", F.col("split").alias("m_split"))
    m = r.members.join(known, "project_id")
    rows = r.all_probes.join(known, "project_id")
    actual = r.all_probes.groupBy("project_id").agg(F.count("*").alias("actual"))
    counted = named.join(actual, "project_id", "left").filter(F.coalesce("actual", F.lit(0)) != F.col("probes"))
    placed = rows.select("project_id", "m_split").distinct().join(r.members.select("project_id", F.col("split").alias("placed")), "project_id", "left")
    many = r.members.groupBy("project_id").agg(F.count_distinct("split").alias("n")).filter("n > 1")
    return [
        _issue(r.projects.filter("coalesce(project_id, '') = ''"), "project_id_missing", F.lit("")),
        _twice(named, "duplicate_release_project_id", "project_id"),
        _issue(named.filter(~F.col("split").isin(SPLITS)), "invalid_project_split", "project_id"),
        _issue(named.filter("not coalesce(verifier_passed, false)"), "project_verifier_not_passed", "project_id"),
        _twice(r.members, "duplicate_split_project_id", "project_id"),
        _issue(many, "project_in_multiple_splits", "project_id"),
        _issue(r.members.join(ids, "project_id", "left_anti"), "split_references_unknown_project", "project_id"),
        _issue(ids.join(r.members, "project_id", "left_anti"), "split_missing_manifest_project", "project_id"),
        _issue(m.filter("split <> m_split"), "split_project_assignment_mismatch", "project_id"),
        _issue(r.split_probes.filter("split <> file_split"), "project_probe_split_field_mismatch", "probe_id"),
        _issue(r.split_probes.join(ids, "project_id", "left_anti"), "probe_unknown_source_project", "probe_id"),
        _twice(r.split_probes, "duplicate_split_probe", *KEY),
        _twice(r.all_probes, "duplicate_all_probe", *KEY),
        _issue(rows.filter("split <> m_split"), "probe_manifest_split_mismatch", "probe_id"),
        _issue(placed.filter("not placed <=> m_split").select("project_id").distinct(), "probe_splits_manifest_mismatch", "project_id"),
        _issue(counted, "probe_count_per_project_mismatch", "project_id"),
    ]


def project_release_issues(release: ProjectRelease) -> DataFrame:
    """Issue rows (code, subject); faults of the release as a whole have the subject release."""
    return union_all([*_totals(release), *_files(release), *_rows(release)])
