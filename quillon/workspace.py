"""Projects: records, exclusions, runs and results as Parquet, with a small manifest that listings read alone."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.sinks import write_file

TABLES = ("records", "excluded", "groups", "results", "rules", "exclusions")
# What a view may overlay, and settings of earlier versions that are dropped.
VIEW_FIELDS = ("query", "year_start", "year_end", "auto_keyword", "chart_settings", "vos_settings", "last_vos_path", "chart_export_dir")
LEGACY_FIELDS = ("skip_dedupe",)
_MANIFEST = "project string, name string, generation long, saved double, stale array<string>, tables map<string, string>, settings map<string, string>, view_applied boolean"


class Workspace:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest_path(self, project: str) -> str:
        return f"{self.root}/{project}/manifest.json"

    def manifest(self, project: str) -> dict:
        return json.loads(self.spark.read.text(self._manifest_path(project), wholetext=True).first().value)

    def save(self, project: str, tables: dict[str, DataFrame], **settings) -> dict:
        """Writes tables under a new generation, then the manifest that points to them: readers see old or new."""
        p, fs = self._fs(self._manifest_path(project))
        old = self.manifest(project) if fs.exists(p) else {"generation": 0, "tables": {}, "name": project, "stale": []}
        generation = old["generation"] + 1
        new = {**old, **settings, "generation": generation, "saved": time.time(), "tables": dict(old["tables"])}
        for name, df in tables.items():
            if name not in TABLES:
                raise ValueError(f"unknown table: {name}")
            path = f"{self.root}/{project}/{name}/g{generation}"
            df.write.parquet(path)
            new["tables"][name] = path
        write_file(self.spark, self._manifest_path(project), json.dumps(new))
        self._delete_view(project)
        return new

    def _view_path(self, project: str) -> str:
        return f"{self.root}/{project}/view.json"

    def _delete_view(self, project: str) -> None:
        p, fs = self._fs(self._view_path(project))
        fs.delete(p, False)

    def save_view(self, project: str, **settings) -> None:
        """Settings of a project's view alone, without a new generation; what no view has is left out."""
        view = {k: v for k, v in settings.items() if k in VIEW_FIELDS}
        write_file(self.spark, self._view_path(project), json.dumps({"saved": time.time(), "view": view}))

    def catalog(self) -> DataFrame:
        """All projects, one a row, from their manifests and views alone: no table of a project is opened.

        `settings` has the project's own settings as JSON texts, overlaid by those of its view if that isn't older; settings
        of earlier versions are dropped. The small files are read by tasks, so their number isn't the driver's.
        """
        p, fs = self._fs(self.root)
        empty = self.spark.createDataFrame([], _MANIFEST)
        if not fs.exists(p) or not fs.globStatus(self._fs(f"{self.root}/*/manifest.json")[0]):
            return empty
        own = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1)
        raw = lambda name: self.spark.read.text(f"{self.root}/*/{name}", wholetext=True).select(own.alias("project"), "value")
        m = raw("manifest.json").withColumn("m", F.from_json("value", "name string, generation long, saved double, stale array<string>, tables map<string, string>")).withColumn("all", F.from_json("value", "map<string, string>"))
        known = ("name", "generation", "saved", "stale", "tables", *LEGACY_FIELDS)
        m = m.select("project", "m.*", F.map_filter("all", lambda k, v: ~k.isin(*known)).alias("settings"))
        if fs.globStatus(self._fs(f"{self.root}/*/view.json")[0]):
            v = raw("view.json").select(F.col("project").alias("_p"), F.from_json("value", "saved double, view map<string, string>").alias("v"))
        else:
            v = self.spark.createDataFrame([], "_p string, v struct<saved: double, view: map<string, string>>")
        newer = F.coalesce(F.col("v.saved") >= F.col("saved"), F.lit(False))
        view = F.map_filter(F.col("v.view"), lambda k, x: k.isin(*VIEW_FIELDS))
        kept = F.map_filter("settings", lambda k, x: ~F.coalesce(F.map_contains_key(view, k), F.lit(False)))
        found = m.join(v, m["project"] == v["_p"], "left").withColumn("view_applied", newer).withColumn("settings", F.when(newer, F.map_concat(kept, view)).otherwise(F.col("settings")))
        return found.select(*[c.split()[0] for c in _MANIFEST.replace("map<string, string>", "m").split(", ")])

    def scan(self, table: str, where=None) -> DataFrame:
        """A table of all projects (of which `where`, a condition on the catalog, holds) with the column `project`, as of now.

        The scan is planned from the catalog: the files of chosen projects' present generations and no others.
        """
        if table not in TABLES:
            raise ValueError(f"unknown table: {table}")
        projects = self.catalog() if where is None else self.catalog().where(where)
        paths = [r.path for r in projects.select(F.col("tables")[table].alias("path")).where("path is not null").collect()]
        if not paths:
            raise ValueError(f"no project has {table}")
        rows = self.spark.read.option("mergeSchema", True).parquet(*paths)
        return rows.withColumn("project", F.regexp_extract("_metadata.file_path", rf"([^/]+)/{table}/g\d+/[^/]+$", 1))

    def load(self, project: str, table: str) -> DataFrame:
        return self.spark.read.parquet(self.manifest(project)["tables"][table])

    def list(self) -> list[dict]:
        """Names and generations from the manifests; no record is read."""
        p, fs = self._fs(self.root)
        if not fs.exists(p):
            return []
        found = []
        for status in fs.listStatus(p):
            name = status.getPath().getName()
            q, _ = self._fs(self._manifest_path(name))
            if not name.startswith(".") and fs.exists(q):
                m = self.manifest(name)
                found.append({"project": name, "name": m.get("name", name), "generation": m["generation"]})
        return sorted(found, key=lambda x: x["project"])

    def rename(self, project: str, name: str) -> None:
        write_file(self.spark, self._manifest_path(project), json.dumps({**self.manifest(project), "name": name}))

    def mark_stale(self, project: str, *parts: str) -> None:
        m = self.manifest(project)
        write_file(self.spark, self._manifest_path(project), json.dumps({**m, "stale": sorted({*m.get("stale", []), *parts})}))

    def ready(self, project: str, generation: int, scope: dict) -> bool:
        """Whether what was computed for a generation and scope still holds."""
        m = self.manifest(project)
        return m["generation"] == generation and m.get("scope") == scope and not m.get("stale")

    def archive(self, project: str) -> str:
        """Moves a project to the trash folder."""
        source, fs = self._fs(f"{self.root}/{project}")
        to, _ = self._fs(f"{self.root}/.trash/{project}-{int(time.time() * 1000)}")
        fs.mkdirs(to.getParent())
        fs.rename(source, to)
        return to.toString()

    def active(self, project: str) -> DataFrame:
        """Records without excluded ones."""
        records = self.load(project, "records")
        if "excluded" not in self.manifest(project)["tables"]:
            return records
        return records.join(self.load(project, "excluded").select("record_key"), "record_key", "left_anti").select(*[F.col(c) for c in records.columns])
