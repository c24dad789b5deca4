"""Pages as a stream: each micro-batch is cleaned and appended under its number, so a repeated batch replaces itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidra.operators import html
from evidra.sources.domains import write_run


def clean_stream(spark: SparkSession, pages_dir: str, schema, out: str, checkpoint: str):
    """Starts a query that cleans new page files below pages_dir into out."""

    def batch(df: DataFrame, n: int) -> None:
        write_run(html.clean(df), out, "stream", "pages", f"{n:08d}")

    return spark.readStream.schema(schema).parquet(pages_dir).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
