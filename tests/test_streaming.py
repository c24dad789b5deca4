"""Pages as a stream: new files are cleaned once, and a second start reads only what is new."""

import random

from pyspark.sql import functions as F

from evidra.operators import frontier
from evidra.streaming import frontier as stream
from evidra.streaming.pages import clean_stream

SCHEMA = "url string, html string"


def test_stream(spark, tmp_path):
    pages, out, state = (str(tmp_path / x) for x in ("pages", "out", "state"))

    def add(*urls):
        rows = [(u, f"<title>{u[-1]}</title><p>This page says something about {u}.</p>") for u in urls]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(pages)
        clean_stream(spark, pages, spark.createDataFrame([], SCHEMA).schema, out, state).awaitTermination(120)

    add("https://a.test/1", "https://a.test/2")
    add("https://a.test/3")
    got = spark.read.parquet(out)
    assert sorted((r.title, r.batch) for r in got.select("title", got.batch.cast("int").alias("batch")).collect()) == [("1", 0), ("2", 0), ("3", 1)]
    assert got.where("usable").count() == 3


def test_a_search_over_arriving_pages(spark):
    """Whatever the batches, redirects and missing pages among them, the visits are those of a search over the whole table."""
    r = random.Random(8)
    rows, hops = [], []
    for h in range(8):
        host = f"h{h}.test"
        urls = [f"https://{host}/"] + [f"https://{host}/{w}/{i}" for w in ("about", "team", "x", "blog", "login", "sales") for i in range(4)]
        for page in urls[: r.choice([1, 8, 20])]:
            rows += [(host, page, pos, r.choice([*urls, "https://other.test/about"]), r.choice(["", "Our team"])) for pos in range(r.choice([0, 3, 9]))]
        hops += [(host, u, r.choice(urls)) for u in r.sample(urls[1:], 5)]
    links = spark.createDataFrame(rows, "host string, page_url string, pos int, url string, text string")
    redirects = spark.createDataFrame(hops, "host string, url string, final_url string")
    hosts = spark.createDataFrame([(f"h{h}.test",) for h in range(8)], "host string")
    want = sorted(map(tuple, frontier.best_first(links, 8, 3, 12, hosts, redirects).select("host", "page_no", "url", "priority", "depth").collect()))
    shown = links.groupBy("host", F.col("page_url").alias("at")).agg(F.array_sort(F.collect_list(F.struct("pos", "url", "text"))).alias("links"))
    pages = shown.select("host", "at", frontier.offered(F.col("links"), F.col("host")).alias("offers"))
    plain = pages.select("host", F.col("at").alias("url"), F.lit(None).cast("string").alias("end"), "offers")
    led = redirects.select("host", "url", F.col("final_url").alias("end")).join(pages.withColumnRenamed("at", "end"), ["host", "end"], "left").select("host", "url", "end", "offers")
    events = plain.join(led.select("host", "url"), ["host", "url"], "left_anti").unionByName(led)
    # Hosts without any page of their own have the closing event alone.
    bare = hosts.join(events.select("host"), "host", "left_anti").select("host", F.lit("https://none.test/").alias("url"), F.lit(None).cast("string").alias("end"), F.lit(None).cast(frontier.OFFERS).alias("offers"))
    got = stream.searched(events.unionByName(bare), 2, max_pages=8, max_depth=3, seen=12)
    assert sorted(map(tuple, got.select("host", "page_no", "url", "priority", "depth").collect())) == want
