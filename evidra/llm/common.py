"""What the operators of this subpackage share: tables in the shared folder, file access, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: bytes.translate table that lower-cases A-Z and leaves every other byte alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset and Spark is local (tests), below a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="evidra-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, uri: str) -> None:
    """Deletes a folder through Spark's own file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: What is open in the enclosing temporary() blocks.
_OPEN: list[list[Scratch]] = []


@contextmanager
def temporary(spark: SparkSession):
    """Deletes, at its end, the tables of every Scratch that was made inside: store what is to stay before."""
    _OPEN.append([])
    try:
        yield
    finally:
        for s in _OPEN.pop():
            delete(spark, s.root)


class Scratch:
    """Tables written to the shared folder. They cut lineage, survive lost executors, and go with drop() or only()."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.made, self.tables = spark, shared_dir(spark, name), 0, []
        if _OPEN:
            _OPEN[-1].append(self)

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made:03d}-{name}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._evidra_path = path
        self.tables.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete(self.spark, t._evidra_path)
            self.tables = [x for x in self.tables if x is not t]

    def only(self, *tables: DataFrame) -> None:
        """Drops all other tables: what a result still reads stays."""
        self.drop(*(t for t in self.tables if not any(t is x for x in tables)))


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI, as tasks use it: local paths, or what pyarrow reaches by scheme."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    scheme, rest = uri.split("://", 1)
    # Hadoop's names of what pyarrow calls otherwise.
    return pafs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3', 'abfss': 'abfs'}.get(scheme, scheme)}://{rest}")


def rows(batches: Iterator[pa.RecordBatch], at_most: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of a bounded number of rows."""
    for b in batches:
        for i in range(0, b.num_rows, at_most):
            yield b.slice(i, at_most)


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, component) for the ends of links (a, b): the smallest node that can be reached.

    Every round hooks each node, and the node that it points at, to the smallest label among its
    neighbours and then follows the pointer once more, so that the number of rounds grows with the
    logarithm of the longest chain. Tables are written between the joins; with shuffles on both
    sides of each join, adaptive execution can split the rows of a hub. No links give no rows.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    edges = scratch.store(both, "edges")
    labels = scratch.store(edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), F.col("component").alias("of_b")), "b")
        least = near.groupBy(F.col("a").alias("node")).agg(F.min("of_b").alias("least"))
        met = labels.join(least, "node")
        asked = met.select("node", F.least("component", "least").alias("to"), "component").union(
            met.select(F.col("component"), "least", F.lit(None).cast("long"))
        )
        hooked = scratch.store(asked.groupBy("node").agg(F.min("to").alias("to"), F.max("component").alias("was")), "hooked")
        jump = hooked.select(F.col("node").alias("to"), F.col("to").alias("on"))
        after = scratch.store(hooked.join(jump, "to").select("node", F.col("on").alias("component"), "was"), "labels")
        scratch.drop(labels, hooked)
        labels = after
        if after.where("component <> was").isEmpty():
            scratch.drop(edges)
            return after.select("node", "component")


def reached(scratch: Scratch, classes: DataFrame, links: DataFrame, owned: DataFrame | None = None) -> DataFrame:
    """(key columns of classes, node, least): node is shared by all that links (a, b) connect, least is their smallest id.

    classes: node, id and keys. owned (id, node): where an id has several nodes, these are connected too.
    """
    component = components(scratch, links)
    if owned is not None:
        # Through the one with the smallest number.
        first = owned.groupBy("id").agg(F.min("node").alias("b"), F.max("node").alias("hi")).where("b < hi")
        first = scratch.store(first.select("id", "b"), "repeated")
        if not first.isEmpty():
            component = components(scratch, links.union(owned.join(first, "id").where("node <> b").select(F.col("node").alias("a"), "b")))
    met = classes.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    linked = component.where("component <> node").select("component").distinct()
    ids = met.join(linked, "component", "left_semi").groupBy("component").agg(F.min("id").alias("least"))
    told = met.drop("node").join(ids, "component", "left").withColumn("least", F.coalesce("least", "id"))
    return told.drop("id").withColumnRenamed("component", "node")
