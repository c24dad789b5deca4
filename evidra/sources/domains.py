"""Input of domains and output of runs."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import urls as U


#: What stands before a host, the host, and what stands behind it.
_PARTS = re.compile(r"^(\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^@/?#]*@)?|\s*)([^:/?#\s]*)(.*)$", re.S)


def _ascii(values: pa.Array) -> pa.Array:
    def one(v):
        if v is None or v.isascii():
            return v
        before, host, rest = _PARTS.match(v).groups()
        try:
            return before + host.encode("idna").decode("ascii") + rest
        except UnicodeError:
            return ""

    return pa.array(map(one, values.to_pylist()), pa.string())


def normalized(value: Column) -> Column:
    """U.normalize_domain() of a name in any script."""
    return U.normalize_domain(F.arrow_udf(_ascii, "string")(value))


def inline(spark: SparkSession, domains: list[str]) -> DataFrame:
    """(ord, input_domain, normalized_domain) in the order given."""
    d = spark.createDataFrame([(i, x) for i, x in enumerate(domains)], "ord int, input_domain string")
    return d.withColumn("normalized_domain", normalized(F.col("input_domain")))


def from_file(spark: SparkSession, path: str) -> DataFrame:
    """The same from a JSON array of strings, with or without a byte-order mark; anything else raises."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("v"))
    parsed = text.select(F.from_json("v", "array<string>").alias("a"), F.try_parse_json("v").alias("j"))
    whole = F.forall(F.coalesce("a", F.array().cast("array<string>")), lambda x: x.isNotNull())
    kinds = F.schema_of_variant("j").isin("ARRAY<STRING>")
    bad = parsed.where(F.col("a").isNull() | ~whole | (F.size("a") == 0) | ~F.coalesce(kinds, F.lit(False)))
    if not bad.isEmpty():
        raise ValueError("the input must be a non-empty JSON array of strings")
    d = parsed.select(F.posexplode("a").alias("ord", "input_domain"))
    return d.withColumn("normalized_domain", normalized(F.col("input_domain")))


def write_run(results: DataFrame, path: str, mode: str, run_id: str, batch: str = "all") -> None:
    """Adds rows to a run under (mode, run_id, batch); a batch written again replaces itself, others stay.

    A checkpoint for each domain is a batch for each.
    """
    out = results.withColumn("mode", F.lit(mode)).withColumn("run_id", F.lit(run_id)).withColumn("batch", F.lit(batch))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mode", "run_id", "batch").parquet(path)


def read_run(spark: SparkSession, path: str, mode: str, run_id: str) -> DataFrame:
    return spark.read.parquet(path).where((F.col("mode") == mode) & (F.col("run_id") == run_id)).drop("mode", "run_id", "batch")
