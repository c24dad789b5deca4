"""Every catalogue query against its SQL on the smallest tables, and case tables for the scalar functions."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from evidra.functions import urls as U
from evidra.operators import html
from evidra.plans.catalogue import SQL, Q

DATA = "/root/testdata/sf0.001"


def plain(r):
    return tuple(round(x, 8) if isinstance(x, float) else x for x in r)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, duck, name):
    df = Q[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((plain(r) for r in df.select(cols).collect()), key=repr)
    if name in SQL:
        want = sorted((plain(r) for r in duck.execute(f"select {', '.join(cols)} from ({SQL[name]})").fetchall()), key=repr)
        assert got == want


DOMAINS = {
    " Example.COM ": "example.com", "https://www.example.com/a?b#c": "www.example.com", "example.com:443": "example.com", "//example.com.": "example.com", "8.8.8.8": "8.8.8.8",
    "": None, "exa mple.com": None, "a\\b.com": None, "https://": None, "localhost": None, "x.local": None, "a..com": None, "-a.com": None, "a-.com": None, "u:p@a.com": None, "ftp://a.com": None,
    "a.com:8080": None, "127.0.0.1": None, "10.1.2.3": None, "192.168.0.1": None, "169.254.1.1": None, "0.0.0.0": None, "192.0.2.1": None, "[::1]": None, "2130706433": None, "127.1": None,
}


def test_domains(spark):
    df = spark.createDataFrame([(k,) for k in DOMAINS], "d string")
    assert {r.d: r.n for r in df.select("d", U.normalize_domain(F.col("d")).alias("n")).collect()} == DOMAINS


def test_clean(spark):
    page = "<html><head><title> A  page </title><style>x</style></head><body><nav><a href='/team'>Team</a></nav><main><p>Hello <b>world</b> here.</p><p hidden>no</p><div class='cookie-banner'>no</div><a href='?b=2&a=1&utm_x=3#f'>more</a></main><footer>mail <a href='mailto:Hi@acme.test?cc=x@acme.test'>us</a> or you@acme.test</footer></body></html>"
    r = html.clean(spark.createDataFrame([("https://acme.test/x", page)], "url string, html string")).first()
    assert r.title == "A page" and r.email_candidates == ["hi@acme.test"]
    assert [x.url for x in r.links] == ["https://acme.test/team", "https://acme.test/x?a=1&b=2"]
    assert "Hello" in r.text and "no" not in r.text.split("\n") and r.usable


def test_blocks_apart_from_examples(spark, tmp_path):
    """Pages that speak of examples right before and behind the blocks put into them."""
    page = "<html><head><title>An example</title></head><body><h1>Some sample</h1><article><p>For example this</p></article><footer>x.example.org</footer></body></html>"
    spark.createDataFrame([(i, f"https://x.example.org/{i}", page) for i in range(26)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in Q["q_html_blocks"](spark, str(tmp_path)).collect())
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(c.execute(SQL["q_html_blocks"]).fetchall())


def test_title_cut_in_a_reference(spark):
    """As in HTML and the reference's parser, a name such as amp is a reference without its semicolon too."""
    r = html.clean(spark.createDataFrame([("https://acme.test/", "<title>This &amp;&amp</title><article>of that &amp</article>")], "url string, html string")).first()
    assert r.title == "This &&" and r.text == "This &&\nof that &"
