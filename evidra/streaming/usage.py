"""Provider replies as a stream: a reply that arrives again, in a repeated batch or from a repeated task, bills once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.operators import scoring
from evidra.sources.commits import Commits

#: How late a repetition may come, by the time at which a reply was made.
LATE = "1 day"


def once(replies: DataFrame, late: str = LATE) -> DataFrame:
    """A stream of replies (ord, attempt, at and more), each attempt of an ord once. State goes when at is later than late."""
    return replies.withWatermark("at", late).dropDuplicatesWithinWatermark(["ord", "attempt"])


def rolled_up(replies: DataFrame, batch: str, late: str = LATE) -> DataFrame:
    """scoring.usage() of a table of replies (ord, attempt, at and more) that arrives in the order of its column batch, repetitions in it.

    Each batch is a start of the stream that goes on with the state and the committed replies of those before.
    """
    spark, commits = replies.sparkSession, Commits(replies.sparkSession)
    dealt = commits.step("dealt", replies)
    schema = dealt.drop(batch).schema
    for r in dealt.select(batch).distinct().orderBy(batch).toLocalIterator():
        dealt.where(F.col(batch).eqNullSafe(F.lit(r[0]))).drop(batch).write.mode("append").parquet(f"{commits.root}/replies")
        q = once(spark.readStream.schema(schema).parquet(f"{commits.root}/replies"), late).writeStream.format("parquet").option("path", f"{commits.root}/once").option("checkpointLocation", f"{commits.root}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return scoring.usage(spark.read.schema(schema).parquet(f"{commits.root}/once"))
