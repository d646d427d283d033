"""Written tables: every publish is a new folder, one manifest line makes it visible.

Readers resolve a table through the manifest, so several tables published
together change together and no reader sees a half-written one. ``append`` is different: it adds files
to the published folder, so tables appended to one after another change one by one, in that order. There
is one writer at a time; a reader calls ``refresh`` to see what was published since. Parquet has no
row-level update, so upserts rewrite a table into its next version.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rolesift.schemas import MARTS, align_table, schema_of

_WRITERS = 4
_MANIFEST = "entries array<struct<table: string, path: string>>, seq bigint"


class Tables:
    """The published tables below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.refresh()

    # -- manifest ------------------------------------------------------------
    def refresh(self) -> None:
        """Look up the published version of every table (one row per table)."""
        try:
            log = self.spark.read.schema(_MANIFEST).json(f"{self.root}/_manifest")
            rows = (
                log.select("seq", F.inline("entries"))
                .groupBy("table").agg(F.max_by("path", "seq").alias("path"), F.max("seq").alias("seq"))
                .collect()
            )
        except AnalysisException as missing:  # nothing published yet
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            rows = []
        self._paths = {row["table"]: row["path"] for row in rows}
        self._seq = max((row["seq"] for row in rows), default=0)

    def _commit(self, paths: dict[str, str]) -> None:
        self._seq += 1
        line = self.spark.createDataFrame([(list(paths.items()), self._seq)], _MANIFEST)
        line.coalesce(1).write.mode("append").json(f"{self.root}/_manifest")
        self._paths.update(paths)

    # -- tables --------------------------------------------------------------
    def read(self, table: str) -> DataFrame:
        """The published version of an allow-listed table, empty before the first one."""
        schema = schema_of(table)
        path = self._paths.get(table)
        if path is None:
            # a limit of zero tells the planner that it is empty, so joins with it are dropped instead of exchanged
            return self.spark.createDataFrame([], schema).limit(0)
        return self.spark.read.schema(schema).parquet(path)

    def publish(self, frames: dict[str, DataFrame]) -> None:
        """Write the next version of each table, then show all of them at once.

        The writes are independent jobs, so small ones run beside large ones.
        """
        paths = {table: f"{self.root}/{table}/{uuid.uuid4().hex}" for table in frames}

        def write(table: str) -> None:
            align_table(frames[table], table).write.parquet(paths[table])

        with ThreadPoolExecutor(max_workers=_WRITERS) as pool:
            list(pool.map(inheritable_thread_target(self.spark)(write), frames))
        self._commit(paths)

    def append(self, table: str, df: DataFrame) -> int:
        """Append by column name and return the number of rows added.

        The rows are written into the folder of the published version; a table
        without one gets its first version.
        """
        frame = align_table(df, table)
        observed = Observation(f"appended-{uuid.uuid4().hex}")
        counted = frame.observe(observed, F.count(F.lit(1)).alias("n"))
        path = self._paths.get(table)
        if path is None:
            path = f"{self.root}/{table}/{uuid.uuid4().hex}"
            counted.write.parquet(path)
            self._commit({table: path})
        else:
            counted.write.mode("append").parquet(path)
        return int(observed.get["n"])

    # -- marts ---------------------------------------------------------------
    def refresh_marts(self, marts: dict[str, DataFrame]) -> int:
        self.publish(marts)
        return len(marts)

    def load_mart(self, name: str, profile_id: str | None = None) -> DataFrame:
        if name not in MARTS:
            raise ValueError(f"unknown mart: {name}")
        return scan_mart(self.read(name), profile_id)


def scan_mart(mart: DataFrame, profile_id: str | None = None) -> DataFrame:
    """A mart, or the rows of one profile (the filter reaches the Parquet scan)."""
    return mart if profile_id is None else mart.filter(F.col("profile_id") == profile_id)

