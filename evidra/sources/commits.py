"""What a run has done so far: tables in the shared folder, each committed whole or in batches, read again when the run is resumed."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Commits:
    """The committed tables of a run, below root/run-<run_id>.

    A folder counts once Spark's writer has left its mark in it, so what a lost driver had half written is not seen: step() writes it
    anew, and work() leaves it aside. root: by default spark.checkpoint.dir; a temporary folder only where Spark is local.
    """

    def __init__(self, spark: SparkSession, run_id: str | None = None, root: str | None = None):
        base = root or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = base or "file://" + tempfile.mkdtemp(prefix="evidra-")
        self.spark, self.run_id = spark, run_id or uuid.uuid4().hex
        self.root = f"{base.rstrip('/')}/run-{self.run_id}"

    def below(self, name: str) -> Commits:
        """The commits of a part of the run."""
        out = Commits.__new__(Commits)
        out.spark, out.run_id, out.root = self.spark, self.run_id, f"{self.root}/{name}"
        return out

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def done(self, name: str) -> bool:
        fs, p = self._files(f"{self.root}/{name}/_SUCCESS")
        return fs.exists(p)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def step(self, name: str, df: DataFrame) -> DataFrame:
        """df, as the first run that came to its end had it."""
        if not self.done(name):
            df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.read(name, df.schema)

    def batches(self, name: str) -> list[str]:
        """Folders of the committed batches of a table."""
        fs, p = self._files(f"{self.root}/{name}")
        if not fs.exists(p):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
        return sorted(f"{self.root}/{name}/{x}" for x in found if self.done(f"{name}/{x}"))

    def work(self, name: str, todo: DataFrame, keys: list[str], make: Callable[[DataFrame], DataFrame], schema: str, parts: int = 1) -> DataFrame:
        """make(todo), asked for in batches by hash of the keys, and only for keys that no committed batch holds.

        Every batch is a folder of its own, so nothing that is committed is written again; a batch that was lost is asked for
        again as a whole. make gives rows that carry the keys. The number of folders is bounded by parts times the resumptions.
        """
        held = self.batches(name)
        rest = todo.join(self.spark.read.schema(schema).parquet(*held).select(*keys).distinct(), keys, "left_anti") if held else todo
        for i in range(parts):
            part = rest if parts == 1 else rest.where(F.pmod(F.xxhash64(*keys), F.lit(parts)) == i)
            make(part).write.parquet(f"{self.root}/{name}/batch-{uuid.uuid4().hex}")
        return self.spark.read.schema(schema).parquet(*self.batches(name))

    def drop(self, name: str = "") -> None:
        fs, p = self._files(f"{self.root}/{name}".rstrip("/"))
        fs.delete(p, True)
