"""Rules that travel with a URL, and rules met by their prefixes, against regular expressions."""

import random
import re
import time

from evidra.operators import robots

RULES = "origin string, state string, delay double, rules array<struct<allow:boolean,pattern:string>>"


def decided(rules, target):
    best = (-1, True)
    for allow, p in rules:
        ends = p.endswith("$")
        body = ".*".join(re.escape(x) for x in (p[:-1] if ends else p).split("*"))
        if p and re.match(body + (r"\Z" if ends else ""), target):
            best = max(best, (len(p.replace("*", "").rstrip("$")), allow))
    return best[1]


def test_both_ways_against_expressions(spark):
    r = random.Random(6)
    rules, urls = {}, []
    for o in range(6):
        of = []
        for _ in range(r.choice([0, 3, 40, 90])):
            p = "".join(r.choice(["/", "a", "b", "ab", "*", "*", ".", "?", "+", "(", "é", "$"]) for _ in range(r.randrange(0, 6)))
            of.append((r.random() < 0.5, r.choice(["", "/", "/", "/"]) + p + r.choice(["", "", "$", "*$"])))
        rules[f"https://o{o}.test"] = of
        urls += [f"https://o{o}.test/" + "".join(r.choice(["/", "a", "b", "ab", ".", "+", "(", "é", "$"]) for _ in range(r.randrange(0, 8))) + r.choice(["", "?a", "?b=a?a"]) for _ in range(60)]
    table = spark.createDataFrame([(o, "available", 0.4, x) for o, x in rules.items()], RULES)
    asked = spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, origin long")
    want = {u: decided(rules[u[:15]], u[15:]) for u in urls}
    for inline in (1000, 20, -1):
        got = robots.allowed(asked, table, inline).collect()
        assert {x.url: x.allowed for x in got} == want and sorted(x.origin for x in got) == list(range(len(urls))), inline


def test_many_rules_on_one_origin(spark):
    of = [(i % 2 == 0, f"/{i % 100}/{i}") for i in range(10_000)] + [(False, f"/*/x{i}$") for i in range(20)]
    table = spark.createDataFrame([("https://o.test", "available", 0.4, of)], RULES)
    urls = [f"https://o.test/{i % 100}/{i}" for i in range(0, 20_000, 4)] + ["https://o.test/q/x7", "https://o.test/q/x7/"]
    began = time.time()
    got = {x.url: x.allowed for x in robots.allowed(spark.createDataFrame([(u,) for u in urls], "url string"), table).collect()}
    assert time.time() - began < 60
    prefixes = {p: a for a, p in of[:10_000]}
    for u in urls:
        target = u[14:]
        fits = [p for n in range(len(target) + 1) if (p := target[:n]) in prefixes]
        assert got[u] == (target != "/q/x7" if not fits else prefixes[fits[-1]])
