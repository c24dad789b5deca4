"""Text functions against Python's own."""

import re

from pyspark.sql import functions as F

from evidra.functions import text as T
from evidra.functions import urls as U
from evidra.operators import grounding
from evidra.plans.catalogue import Q


def test_folding(spark):
    texts = ["Straße", "ΣΊΣΥΦΟΣ", "ﬁne İstanbul", "ŉ x", "", "ᾳᾼ", "Ꭰ ꭰ", None, "plain ASCII Text", "ſ", *map(chr, (0x1E9E, 0x1F50, 0xFB13))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.f for r in df.select("t", T.folded(F.col("t")).alias("f")).collect()}
    assert got == {t: None if t is None else t.casefold() for t in texts}


def test_blanks_and_sentences(spark):
    texts = [" a b \tc\n", "\x1cx\x85y", "One. Two.", "One.", "One", "What? ", "Is 3.5 enough!"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: (r.s, r.o) for r in df.select("t", T.squeezed(F.col("t")).alias("s"), T.single_sentence(F.col("t")).alias("o")).collect()}
    assert {t: s for t, (s, _) in got.items()} == {t: " ".join(t.split()) for t in texts}
    assert [got[t][1] for t in texts[2:]] == [False, True, False, False, True]


def test_search_in_texts(spark):
    """What stands in a squeezed text, and lines, as plain Python finds them."""
    texts = ["a b\tc  d", "x y z", " lead trail ", "one\r\ntwo a@b.test\rthree\x85four a@b.test", "a  b a b", "　wide　", "Our CUSTOMER Story\nno\x0bformer CEO of x\nFormer  CEO\ninvestors", ""]
    asked = ["a b c d", "b c", "y z", "x y", "lead trail", "ail", "two a@b.test", "a b a", "wide", "a@b.test", "d"]
    df = spark.createDataFrame([(t, x) for t in texts for x in asked], "t string, x string")
    for r in df.select("t", "x", T.says(F.col("t"), F.col("x")).alias("s"), T.first_line(F.col("t"), F.col("x"), 14).alias("l"), T.outsider_lines(F.col("t")).alias("o")).collect():
        lines = re.split(T.LINES, r.t)
        assert r.s == (r.x in " ".join(r.t.split())), (r.t, r.x)
        assert r.l == next((y for y in lines if r.x in y and len(y) <= 14), None), (r.t, r.x)
        assert r.o == [y for y in lines if re.search(T.OUTSIDER, y)]


def test_texts_are_not_squeezed_to_be_searched(spark):
    """Squeezing a text costs more than all else that grounding does with it; it happens where an excerpt's words stand apart otherwise."""
    s = spark.createDataFrame([(1, "p", True, "https://a.test/", "a  b")], "ord int, source_id string, usable boolean, final_url string, text string")
    c = spark.createDataFrame([(1, "name", 0, n, "p", "a b ") for n in range(2)], "ord int, aspect string, item int, pos int, source_id string, excerpt string")
    found = grounding.resolve(c, s)
    assert [(r.pos, r.excerpt) for r in found.collect()] == [(0, "a b")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "regexp_replace(text" not in plan.split("Join")[1]


def test_people_search_texts_once(spark, monkeypatch):
    """Citations of companies and of people meet the texts in one join."""
    asked, resolve = [], grounding.resolve
    monkeypatch.setattr(grounding, "resolve", lambda *x: asked.append(x) or resolve(*x))
    assert Q["q_people_grounding"](spark, "/root/testdata/sf0.001").count() and len(asked) == 1


def test_excerpts_are_squeezed_once(spark):
    """Not once more for each bound of their length, and repeated ones go without a sort."""
    s = spark.createDataFrame([(1, "p", True, "https://a.test/", "a  b c")], "ord int, source_id string, usable boolean, final_url string, text string")
    asked = ["a b", "ab", " a  b", "b c", None, "", "x" * 601, "a b"]
    c = spark.createDataFrame([(1, "name", 0, n, "p", x) for n, x in enumerate(asked)], "ord int, aspect string, item int, pos int, source_id string, excerpt string")
    found = grounding.resolve(c, s)
    assert sorted((r.pos, r.excerpt) for r in found.collect()) == [(0, "a b"), (3, "b c")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(excerpt") == 1 and "Window" not in plan


def test_profiles_without_a_canonical_form(spark):
    """URLs that name the host as it is are read without their canonical form, to the same profiles."""
    hosts = ["linkedin.com", "WWW.LinkedIn.com", "linkedin.com.", "linkedin.com:443", "linkedin.com:99999", "u@linkedin.com", "linkedin.com.evil.test", "lin\u212aedin.com", "linkedin.com\n"]
    paths = ["", "/", "/in/ann", "/in/ann/", "/in/ann//", "/in//", "/in/ann/x", "/in/a%20b", "/in/ann\n", "/IN/ann", "/in/ann?x=%zz#f", "?in/ann", "\\in\\ann"]
    urls = [None, "", *(f"{s}{h}{p}" for s in ("https://", "HTTP://", "ftp://", "") for h in hosts for p in paths)]
    canonical = U.canonical_url(F.col("u"))
    slug = F.regexp_extract(U.part(canonical, 3), r"^/in/([^/]+)/?$", 1)
    want = F.when(U.host(canonical).isin("linkedin.com", "www.linkedin.com") & (slug != ""), F.concat(F.lit("https://www.linkedin.com/in/"), slug))
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", U.profile_url(F.col("u")).alias("got"), want.alias("want"))
    assert [r for r in df.collect() if r.got != r.want] == []
