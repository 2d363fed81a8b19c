"""Notebook API over a folder of scans (``<root>/<run>/templates.parquet`` ...) and an index folder."""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave import schemas
from logweave.functions import text
from logweave.operators import diff, registry
from logweave.sources import files


class Index:
    """Registry, template registry and baseline of many scans."""

    def __init__(self, spark: SparkSession, runs_root: str, index_dir: str):
        self.spark, self.root, self.dir = spark, runs_root, index_dir

    def _documents(self, paths: list[str]) -> DataFrame:
        """Run documents as registry rows; a missing field takes its default."""
        df = files.read_run_documents(self.spark, paths)
        kinds = dict(df.dtypes)

        def col(path: str, t: str, d=None) -> F.Column:
            top = path.split(".")[0]
            have = top in kinds and ("." not in path or path.split(".")[1] in (getattr(df.schema[top].dataType, "names", None) or []))
            c = F.col(path).cast(t) if have else F.lit(None).cast(t)
            return c if d is None else F.coalesce(c, F.lit(d).cast(t))

        path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
        cols = {
            "run_id": col("run_id", "string", ""), "service_name": col("service_name", "string", ""), "created_at": col("created_at", "string", ""),
            **{c: col(c, "long", 0) for c in ("event_count", "template_count", "error_count", "input_bytes")},
            "code_event_count": col("issue_kind_counts.code", "long", 0), "infra_event_count": col("issue_kind_counts.infra", "long", 0),
            **{c: col(c, "double", 0.0) for c in ("scan_duration_seconds", "events_per_second", "throughput_gb_per_second")},
            **{c: col(c, "string") for c in ("engine", "git_branch", "git_commit", "container")},
            "image_fingerprint": col("autodiscovery.fingerprint", "string"), "autodiscovery_status": col("autodiscovery.status", "string"),
            "run_dir": F.regexp_replace(path, "/run.json$", ""), "run_json_mtime_us": F.unix_micros("_metadata.file_modification_time"),
        }
        return df.select(*[c.alias(n) for n, c in cols.items()]).where("run_id <> ''").withColumn("indexed_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))

    def _over_runs(self, table: str) -> DataFrame:
        paths = sorted(glob.glob(f"{self.root}/**/{table}.parquet", recursive=True))
        if not paths:
            raise FileNotFoundError(f"no {table}.parquet below {self.root}")
        folder = F.regexp_extract(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/"), rf"^(.*)/{table}\.parquet/", 1)
        return self.spark.read.option("mergeSchema", True).parquet(*paths).withColumn("run_dir", folder)

    def _changed(self) -> tuple[list[str], list[str]]:
        """(run documents that are new or were written since they were indexed, folders of all)."""
        paths = sorted(os.path.realpath(p) for p in glob.glob(f"{self.root}/**/run.json", recursive=True))
        if not paths:
            raise FileNotFoundError(f"no run.json below {self.root}")
        known: dict[str, int] = {}
        if os.path.exists(f"{self.dir}/registry.parquet") and "run_json_mtime_us" in (old := self.registry()).columns:
            known = {r.run_dir: r.run_json_mtime_us for r in old.select("run_dir", "run_json_mtime_us").toLocalIterator()}
        fresh = lambda p: known.get(os.path.dirname(p), -1) // 1000 != int(os.stat(p).st_mtime * 1000)
        return [p for p in paths if fresh(p)], [os.path.dirname(p) for p in paths]

    def build(self, min_green_runs: int = 3, scenario_regex: str | None = None, everything: bool = False) -> int:
        """Index scans: registry, template_registry and baseline tables, these split by service too; the number of runs that were indexed.

        Runs whose document has not changed since keep their row; if none has,
        and none is gone, nothing is written.
        """
        changed, folders = self._changed()
        known = os.path.exists(f"{self.dir}/registry.parquet")
        old = self.registry().where(F.col("run_dir").isin(folders)) if known and not everything else None
        if old is not None and not changed and old.count() == self.registry().count():
            return 0
        runs = self._documents(changed if old is not None else [f"{d}/run.json" for d in folders]) if changed or old is None else None
        if runs is not None:
            incidents = self._over_runs("incidents").groupBy("run_dir").agg(F.count(F.lit(1)).alias("connectivity_incident_count"), F.coalesce(F.sum("duration_s"), F.lit(0.0)).alias("connectivity_total_downtime_s"))
            runs = runs.join(incidents, "run_dir", "left").na.fill(0, ["connectivity_incident_count"]).na.fill(0.0, ["connectivity_total_downtime_s"])
            status = F.when(F.col("event_count") == 0, "unknown").when((F.col("code_event_count") == 0) & (F.col("connectivity_incident_count") == 0), "green").otherwise("red")
            runs = runs.withColumn("status", status).withColumn("scenario", text.scenario(F.col("run_id"), scenario_regex))
        runs = old if runs is None else runs if old is None else registry.upsert(old, runs)
        files.write_table(runs, f"{self.dir}/registry.next.parquet")  # the old one is read while it is written
        files.write_table(registry.ordered(files.read_table(self.spark, f"{self.dir}/registry.next.parquet"), "registry"), f"{self.dir}/registry.parquet")
        runs = self.registry()
        per = self._over_runs("templates").join(runs.select("run_dir", "run_id"), "run_dir")
        known_templates = files.align(registry.template_registry(per, runs), schemas.TEMPLATE_REGISTRY)
        files.write_table(registry.ordered(known_templates, "template_registry"), f"{self.dir}/template_registry.parquet")
        files.write_table(registry.ordered(files.align(registry.baseline(per, runs, min_green_runs), schemas.BASELINE), "baseline"), f"{self.dir}/baseline.parquet")
        files.split_by_service(self.baseline(), f"{self.dir}/by_service")
        files.split_by_service(self.template_registry(), f"{self.dir}/template_registry_by_service")
        files.split_by_service(self.overrides(), f"{self.dir}/overrides_by_service")
        return len(changed)

    def registry(self) -> DataFrame:
        return files.read_table(self.spark, f"{self.dir}/registry.parquet")

    def runs(self, service: str | None = None, scenario: str | None = None, status: str | None = None) -> DataFrame:
        df = self.registry()
        for c, v in (("service_name", service), ("scenario", scenario), ("status", status)):
            df = df.where(F.col(c) == v) if v is not None else df
        return df.orderBy("service_name", "created_at", "run_id")

    def _run_dir(self, run_id: str) -> str:
        row = self.registry().where(F.col("run_id") == run_id).select("run_dir").first()
        if row is None:
            raise KeyError(run_id)
        return row.run_dir

    def templates(self, run_id: str) -> DataFrame:
        return files.read_table(self.spark, f"{self._run_dir(run_id)}/templates.parquet")

    def events(self, run_id: str, *columns: str) -> DataFrame:
        return files.read_table(self.spark, f"{self._run_dir(run_id)}/events.parquet", *columns)

    def template_registry(self) -> DataFrame:
        return files.read_table(self.spark, f"{self.dir}/template_registry.parquet")

    def baseline(self, service: str | None = None, scenario: str | None = None) -> DataFrame:
        df = files.read_table(self.spark, f"{self.dir}/baseline.parquet")
        df = df.where(F.col("service_name") == service) if service else df
        return df.where(F.col("scenario") == scenario) if scenario else df

    def overrides(self) -> DataFrame:
        path = f"{self.dir}/overrides.parquet"
        return files.read_table(self.spark, path) if os.path.exists(path) else self.spark.createDataFrame([], schemas.OVERRIDES)

    def overrides_for(self, service: str, scenario: str) -> DataFrame:
        return diff.overrides_for(self.overrides(), service, scenario)

    def decide(self, service: str, scenario: str, template: str, decision: str | None, reason: str = "", set_by: str = "", set_at: str = "") -> None:
        """Set or clear the decision on a template and keep it."""
        rows = diff.set_override(self.overrides(), service, scenario, template, decision, reason, set_by, set_at).collect()  # decisions are made by hand, one at a time
        files.write_table(self.spark.createDataFrame(rows, schemas.OVERRIDES), f"{self.dir}/overrides.parquet")

    def services_and_scenarios(self) -> DataFrame:
        return registry.services_and_scenarios(self.registry())

    def diff_for(self, run_id: str, z_threshold: float = 3.0, min_count: int = 5) -> DataFrame:
        """Findings of one run against its cohort's baseline, after overrides."""
        run = self.registry().where(F.col("run_id") == run_id)
        per = self.templates(run_id).withColumn("run_id", F.lit(run_id))
        return diff.apply_overrides(diff.diff_findings(per, run, self.baseline(), z_threshold, min_count), self.overrides())

    def lineage_for(self, template: str, k: int = 5, min_similarity: float = 0.0) -> DataFrame:
        """Registered templates most like a template text."""
        return diff.most_similar(self.template_registry(), template, k, min_similarity)

    def register_views(self) -> None:
        """registry, template_registry and baseline for SQL."""
        for name in ("registry", "template_registry", "baseline"):
            getattr(self, name)().createOrReplaceTempView(name)
