"""Job catalogue: Parquet tables of paths and jobs below a working folder."""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOBS = "id long, parameters string, digest string, type string, launched double, finished double"
PATHS = "id long, job long, path string, type string"
HIDDEN = "name string, column string, value string, upto long"


def digest(options: dict, extra: str | None = None) -> str:
    """Ten hex digits of the sorted options."""
    text = json.dumps({k: v for k, v in sorted(options.items()) if v is not None}, sort_keys=True, default=str) + (extra or "")
    return hashlib.md5(text.encode()).hexdigest()[:10]


class Catalogue:
    """Tables are only appended to: a deletion adds a row that hides others, so that a crash loses nothing."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        rows = self._stored(name, JOBS if name == "jobs" else PATHS)
        for r in self._stored("hidden", HIDDEN).where(F.col("name") == name).distinct().collect():
            rows = rows.where(~F.col(r["column"]).cast("string").eqNullSafe(F.lit(r["value"])) | (F.col("id") > r["upto"]))
        return rows

    def _stored(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except Exception as e:  # the table is not there yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, name: str, rows: list[tuple]) -> None:
        schema = {"jobs": JOBS, "paths": PATHS, "hidden": HIDDEN}[name]
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")

    def next_id(self, name: str = "jobs") -> int:
        return (self._stored(name, JOBS if name == "jobs" else PATHS).agg(F.max("id")).first()[0] or 0) + 1

    def already_run(self, options: dict, kind: str) -> bool:
        return self.table("jobs").where((F.col("digest") == digest(options)) & (F.col("type") == kind)).limit(1).count() > 0

    def add_job(self, options: dict, kind: str, launched: float, outputs: dict[str, str] | None = None) -> int:
        job = self.next_id()
        self._append("jobs", [(job, json.dumps(options, sort_keys=True, default=str), digest(options), kind, launched, time.time())])
        for path, typ in (outputs or {}).items():
            self.add_path(path, typ, job)
        return job

    def add_path(self, path: str, typ: str, job: int) -> int:
        found = self.path_id(path)
        if found is not None:
            return found
        new = self.next_id("paths")
        self._append("paths", [(new, job, path, typ)])
        return new

    def path_id(self, path: str) -> int | None:
        row = self.table("paths").where(F.col("path") == path).select(F.min("id")).first()
        return row[0]

    def describe(self, name: str = "jobs", columns: list[str] | None = None, where: str | None = None) -> DataFrame:
        df = self.table(name)
        df = df.where(where) if where else df
        return df.select(*columns) if columns else df

    def delete(self, name: str, column: str, value) -> None:
        """Hide the rows written so far with this value."""
        self._append("hidden", [(name, column, None if value is None else str(value), self.next_id(name) - 1)])

    def clean(self, job: int) -> None:
        """Forget a job and its paths."""
        self.delete("jobs", "id", job)
        self.delete("paths", "job", job)
