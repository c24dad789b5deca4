"""The one-pass frontier against best-first search at depth 1, with room to spare and with full memories."""

import random

import pytest

from pyspark.sql import functions as F

from evidra.functions import urls as U
from evidra.operators import frontier

WORDS = ["about", "team", "contact", "pricing", "careers", "blog", "x", "login", "company", "docs", "a/b", "sales", "y.pdf"]


@pytest.mark.parametrize("seen", [3, 6, 12, 300])
def test_one_pass_equals_search(spark, seen):
    r = random.Random(seen)
    rows = []
    for h in range(30):
        host = f"h{h}.test"
        for pos in range(r.choice([1, 2, 5, 12, 30])):
            to = r.choice([host, host, host, "www." + host, "other.test"])
            rows.append((host, f"https://{host}/", pos, f"https://{to}/{r.choice(WORDS)}" + r.choice(["", "", "/1"]), r.choice(["", "About us", "News", "Our product"])))
    rows.append(("only.test", "https://only.test/", 0, None, "broken"))
    rows.append((None, None, 0, "https://a.test/", "no host"))
    links = spark.createDataFrame(rows, "host string, page_url string, pos int, url string, text string")
    got = sorted(map(tuple, frontier.select_pages(links, 8, seen).collect()))
    assert got == sorted(map(tuple, frontier.best_first(links, 8, 1, seen).collect()))
    assert [x[2] for x in got if x[0] == "only.test"] == [0] + [5] * min(5, seen - 1)
    assert not [x for x in got if x[0] is None]


def searched(host, links, ranks, redirects, max_pages, max_depth, seen):
    """A search with one queue: (url, priority, depth) in the order of visits."""
    queue, known, gone, out, spare = [(0, 0, f"https://{host}/")], {f"https://{host}/"}, set(), [], True

    def remember(url, depth, rank):
        if depth <= max_depth and url not in known and len(known) < seen:
            known.add(url)
            queue.append((rank, depth, url))

    while len(out) < max_pages:
        if spare and (not queue or min(queue)[0] >= 6):
            spare = False
            for path in frontier.FALLBACK:
                remember(f"https://{host}{path}", 1, 5)
        queue = [x for x in queue if x[2] not in gone]
        if not queue:
            return out
        rank, depth, url = min(queue)
        queue.remove((rank, depth, url))
        gone.add(url)
        out.append((url, rank, depth))
        end = redirects.get(url, url)
        gone.add(end)
        first = {}
        for _, to, text in sorted((p, t, x) for at, p, t, x in links if at == end):
            first.setdefault(to, ranks[host, to, text])
        for to in sorted(first):
            if first[to] is not None:
                remember(to, depth + 1, first[to])
    return out


@pytest.mark.parametrize("max_depth, seen, max_pages", [(0, 300, 8), (1, 300, 8), (2, 300, 8), (3, 300, 12), (2, 7, 8), (3, 4, 6)])
def test_search_to_any_depth(spark, max_depth, seen, max_pages):
    r = random.Random(seen * 10 + max_depth)
    rows, hops, want = [], [], {}
    for h in range(12):
        host = f"h{h}.test"
        urls = [f"https://{host}/"] + [f"https://{host}/{w}/{i}" for w in WORDS for i in (1, 2)]
        mine = [(r.choice(urls[:8]), pos, r.choice([*urls, f"https://www.{host}/team", "https://other.test/about"]), r.choice(["", "Our team", "News", "Jobs"])) for pos in range(r.choice([0, 3, 40]))]
        ends = {u: r.choice(urls) for u in r.sample(urls[1:], 4)}
        rows += [(host, *x) for x in mine]
        hops += [(host, a, b) for a, b in ends.items()]
        want[host] = mine, ends
    links = spark.createDataFrame(rows, "host string, page_url string, pos int, url string, text string")
    own = F.when(U.in_scope(F.col("url"), F.col("host")), frontier.priority(F.col("url"), F.col("text"))).alias("rank")
    rank = {(x.host, x.url, x.text): x["rank"] for x in links.select("host", "url", "text", own).collect()}
    want = {h: searched(h, mine, rank, ends, max_pages, max_depth, seen) for h, (mine, ends) in want.items()}
    hosts = spark.createDataFrame([(h,) for h in want], "host string")
    redirects = spark.createDataFrame(hops, "host string, url string, final_url string")
    got = {h: [] for h in want}
    for x in frontier.best_first(links, max_pages, max_depth, seen, hosts, redirects).orderBy("host", "page_no").collect():
        got[x.host].append((x.url, x.priority, x.depth))
    assert got == want


def test_links_of_other_pages_are_not_at_depth_one(spark):
    rows = [("a.test", "https://a.test/", 0, "https://a.test/x", ""), ("a.test", "https://a.test/x", 0, "https://a.test/team/deep", "")]
    links = spark.createDataFrame(rows, "host string, page_url string, pos int, url string, text string")
    assert "https://a.test/team/deep" not in {r.url for r in frontier.select_pages(links, 20).collect()}
    assert "https://a.test/team/deep" in {r.url for r in frontier.best_first(links, 20, 2).collect()}
    hosts = spark.createDataFrame([("bare.test",)], "host string")
    for found in (frontier.select_pages(links, 9, 300, hosts), frontier.best_first(links, 9, 1, 300, hosts)):
        assert [r.priority for r in found.where("host = 'bare.test'").orderBy("page_no").collect()] == [0, 5, 5, 5, 5, 5]
