"""Context assembly with a real vocabulary against a plain computation."""

import json
import re

import pytest
from pyspark.sql import functions as F

from evidra.operators import context

SCHEMA = "ord int, source_id string, page_no int, usable boolean, kind string, final_url string, title string, text string"
FIRST = "first_party_html"


@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.tiktoken")


def plain(rows, count, limit, spent):
    """{ord: (text, context tokens, request tokens, dropped)} chunk by chunk."""
    out = {}
    for o in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == o and r[3] and r[4] == FIRST), key=lambda r: r[2])
        if not mine:
            continue
        lines = [json.dumps({"sources": [{"source_id": r[1], "url": r[5], "title": r[6]} for r in mine]}, ensure_ascii=False)]
        used, dropped, places = count(lines[0] + "\n"), 0, []
        for r in mine:
            buckets = {}
            parts = [c for p in r[7].splitlines() for c in re.split(r"(?<=[.!?])\s+(?=[A-Z])", p) if c]
            for c in dict.fromkeys(parts):
                low = c.lower()
                kind = next((n for n, words in context.CATEGORIES if any(w in low for w in words)), 3)
                buckets[kind] = buckets.get(kind, 0) + 1
                places.append((buckets[kind], kind, r[1], json.dumps({"source_id": r[1], "text": c}, ensure_ascii=False)))
        for *_, line in sorted(places):
            n = count(line + "\n")
            if n > 500 or used + n > limit - spent:
                dropped += 1
            else:
                lines.append(line)
                used += n
        some = len(lines) > 1
        out[o] = ("\n".join(lines) if some else "", used if some else 0, spent + (used if some else 0), dropped)
    return out


def sources():
    long = "\n".join(f"Paragraph {i} says many things about ünïcode, \"quotes\" and \\ signs. It goes on. And on!" for i in range(150))
    rows = [
        (0, "page-1", 1, True, FIRST, "https://a.test/", "A \"title\"", "Public email: hi@a.test\nAnn Lee is the founder of A. It sells tools.\nBuilt for teams.\n" + long),
        (0, "page-10", 3, True, FIRST, "https://a.test/x", "é", "x " * 3000 + "\nOur team. Our team. Our team."),
        (0, "page-2", 2, True, FIRST, "https://a.test/y", "", long),
        (0, "page-3", 4, False, FIRST, "https://a.test/z", "no", "Unusable."),
        (0, "search-1", 5, True, "search_snippet", "https://s.test", "no", "A snippet."),
        (1, "page-1", 1, True, FIRST, "https://b.test/", "B", "w " * 2000),
        (2, "page-1", 1, False, FIRST, "https://c.test/", "C", "Nothing."),
    ]
    return rows


def test_against_a_plain_computation(spark, vocabulary):
    rows = sources()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    count = lambda s: context.count_tokens(s, "", vocabulary)
    got = context.assembled(df, context.token_column("", vocabulary), F.lit(700), 3000)
    assert {r.ord: (r.text, r.context_tokens, r.request_tokens, r.dropped_chunks) for r in got.collect()} == plain(rows, count, 3000, 700)
    first = got.where("ord = 0").first()
    assert first.request_tokens <= 3000 and first.dropped_chunks > 0 and "hi@a.test" in first.text and "Ann Lee" in first.text
    assert got.where("ord = 1").first().text == ""


def test_overhead(vocabulary):
    count = lambda s: context.count_tokens(s, "", vocabulary)
    n = context.overhead("Do this. ", {"type": "object"}, count, "and that")
    assert n == count('Do this. {"type":"object"}and that') + 512
    with pytest.raises(ValueError):
        context.overhead("Do this. ", {}, count, limit=500)
    with pytest.raises(ValueError):
        context.encoder("no-such-model")
