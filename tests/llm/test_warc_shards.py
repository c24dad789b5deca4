"""Shards and files of the archive writer."""

import os

import pytest
from pyspark.sql import functions as F

from evidra.llm import warc


def pages(spark, ids, n=2000):
    return spark.createDataFrame([(i, f"http://a/{i}", f"{k} " * (n // 4)) for k, i in enumerate(ids)], "page_id long, url string, html string")


@pytest.mark.parametrize("far", [[], [10**15], [-(2**63), 2**63 - 1]])
def test_a_far_off_id_changes_no_balance(spark, far):
    ids = [*range(200), *far]
    sizes = spark.createDataFrame([(i, 1000) for i in ids], "page_id long, size long")
    starts, _ = warc.shard_starts(sizes, 20_000)
    shards = [r["count"] for r in sizes.groupBy(warc.place(F.col("page_id"), starts)).count().collect()]
    assert sum(shards) == len(ids) and max(shards) <= 45 and len(shards) >= 7


def test_files_roll_and_read_in_many_tasks(spark, tmp_path):
    root = f"file://{tmp_path}/x"
    df = pages(spark, [*range(300), 10**12])
    manifest = warc.write(df, root, shard=100_000)
    m = manifest.collect()
    assert len({r.shard for r in m}) > 3 and any(r.seq for r in m)
    assert not os.path.exists(tmp_path / "x/_temporary")
    back = warc.read(manifest, root)
    assert back.rdd.getNumPartitions() > 1
    assert {(r.page_id, bytes(r.payload).decode()) for r in back.collect()} == {(r.page_id, r.html) for r in df.collect()}


def test_a_missing_file_raises(spark, tmp_path):
    root = f"file://{tmp_path}/y"
    manifest = warc.write(pages(spark, range(5)), root).collect()
    with pytest.raises(OSError):
        warc_row = [("none", manifest[0].name, manifest[0].bytes + 1)]
        import pyarrow as pa

        batch = pa.RecordBatch.from_pylist([dict(zip(("temporary", "name", "bytes"), warc_row[0], strict=True))])
        list(warc._renamer(root)([batch]))


def test_same_payload_under_many_ids(spark, tmp_path):
    df = spark.createDataFrame([(i % 5 if i % 7 else None, "u", "x" * 1200 if i % 2 else "y" * 1200) for i in range(70)], "page_id long, url string, html string")
    root = f"file://{tmp_path}/z"
    got = warc.read(warc.write(df, root), root).select("page_id", "payload_digest", "record_type", "refers_to").collect()
    assert len(got) == 70
    for r in got:
        if r.page_id is None or r.page_id == 4:
            assert (r.record_type, r.refers_to) == ("response", None)
        else:
            assert (r.record_type, r.refers_to) == ("revisit", 4)
