"""Edges without a network: queues, robots, crawls over scripted answers and a server of our own, and providers with scripted answers."""

import gzip
import json
import sys
import threading
import types
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from evidra import schema
from evidra.connectors import providers as P
from evidra.connectors.fetch import _rendered, over_http, rendered, stored
from evidra.connectors.http import Answer, PublicNames, RequestFailed, send
from evidra.operators import queue, robots
from evidra.plans import crawl as C
from evidra.plans.run import demo_extraction
from evidra.settings import Settings
from evidra.sources.commits import Commits

# Workers cannot import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROBOTS = {
    "*": "User-agent: *\nDisallow: /a\nAllow: /a/b\n",
    "own": "crawl-delay: 3\nDisallow: /x\nUser-agent: *\nDisallow: /\n\nUser-Agent : EVIDRA # us\nuser-agent: other\nDisallow: /p*/q$\nCrawl-delay: 0.1\ncrawl-delay: 1.5\ncrawl-delay: nan\n",
    "early": "Crawl-delay: 2\nUser-agent: *\nDisallow:\n",
    "two": "User-agent: *\nDisallow: /a\nUser-agent: z\nDisallow: /\nUser-agent: *\nAllow: /a\nCrawl-delay: 7\n",
    "tab": "User-agent:\t*\nDisallow:\t/t\n",
}
URLS = ["https://h.test/", "https://h.test/a", "https://h.test/a/b/c", "https://h.test/p1/q", "https://h.test/p1/q?x", "https://h.test/t?a", "https://h.test/x"]


#: What each file says: its delay, and the URLs it allows.
TOLD = {"*": (0.4, "/ /a/b/c /p1/q /p1/q?x /t?a /x"), "own": (1.5, "/ /a /a/b/c /p1/q?x /t?a /x"), "early": (2.0, "/ /a /a/b/c /p1/q /p1/q?x /t?a /x"), "two": (7.0, "/ /a /a/b/c /p1/q /p1/q?x /t?a /x"), "tab": (0.4, "/ /a /a/b/c /p1/q /p1/q?x /x")}


def test_rules_of_a_table(spark):
    rows = [(f"https://{k}.test", 200, v) for k, v in ROBOTS.items()] + [("https://gone.test", 410, None), ("https://no.test", 403, ""), ("https://down.test", None, None), ("https://busy.test", 429, None), ("https://page.test", 200, "<HTML>"), ("https://odd.test", 204, "")]
    table = robots.parse(spark.createDataFrame(rows, "origin string, status int, body string"), "evidra")
    told = {r.origin: r for r in table.collect()}
    assert {k: told[f"https://{k}.test"].state for k in ("gone", "no", "down", "busy", "page", "odd")} == {"gone": "missing", "no": "denied", "down": "unavailable", "busy": "unavailable", "page": "unavailable", "odd": "denied"}
    urls = spark.createDataFrame([(u.replace("h.test", f"{k}.test"),) for k in [*ROBOTS, "gone", "no", "down", "nowhere"] for u in URLS], "url string")
    got = {r.url: r.allowed for r in robots.allowed(urls, table).collect()}
    for k, (delay, free) in TOLD.items():
        assert told[f"https://{k}.test"].delay == delay
        assert {u for u in URLS if got[u.replace("h.test", f"{k}.test")]} == {f"https://h.test{x}" for x in free.split()}, k
    assert all(got[u.replace("h.test", "gone.test")] and not any(got[u.replace("h.test", f"{k}.test")] for k in ("no", "down", "nowhere")) for u in URLS)


def test_pace_and_waits(spark):
    rows = [("a", "o", 2.0, 0.0), ("b", "o", 2.0, 0.0), ("c", "o", 2.0, 200.0), ("d", "o", 2.0, 103.0), ("e", "p", 0.5, 0.0)]
    got = queue.paced(spark.createDataFrame(rows, "id string, origin string, delay double, not_before double"), 100.0)
    assert {r.id: r.start for r in got.collect()} == {"a": 102, "b": 104, "d": 106, "c": 200, "e": 100.5}
    now = 1445412480.0 - 90  # 90 seconds before the date below
    asked = [(0, "3", 3), (0, "-3", 0), (0, "Wed, 21 Oct 2015 07:28:00 GMT", 90), (0, "nan", None), (2, "soon", None), (9, None, None), (0, "", None)]
    t = spark.createDataFrame([(a, r) for a, r, _ in asked], "attempt int, after string")
    waits = [r[0] for r in t.select(queue.wait(F.col("attempt"), F.col("after"), F.lit(now), F.lit("k"))).collect()]
    for (attempt, _, want), w in zip(asked, waits, strict=True):
        assert w == want if want is not None else min(8, 0.5 * 2**attempt) <= w <= min(8, 0.5 * 2**attempt) + 0.2


def test_public_names():
    names = PublicNames(lambda host: {"a.test": ["93.184.216.34"], "b.test": [], "c.test": ["93.184.216.34", "127.0.0.1"], "d.test": ["fe80::1%eth0"], "e.test": ["2606:2800:220:1::1"]}[host])
    assert [h in names for h in ("a.test", "b.test", "c.test", "d.test", "e.test", "none.test")] == [True, False, False, False, True, False]
    free = threading.Event()
    slow = PublicNames(lambda host: free.wait(20) and ["93.184.216.34"], 0.2)
    assert "a.test" not in slow
    free.set()


class Scripted:
    """Answers by URL: (status, body, headers), or an exception; the last of several is repeated. Told by worker, so each URL counts for itself."""

    def __init__(self, told):
        self.told, self.n = told, {}

    def __call__(self, url, seconds, *_):
        turns = self.told.get(url, [(404, "", {})])
        self.n[url] = self.n.get(url, -1) + 1
        # A worker may be a new one: a second attempt is told by its turn in the table of attempts, not by memory.
        x = turns[min(self.n[url], len(turns) - 1)]
        if isinstance(x, Exception):
            raise x
        status, body, headers = x
        return Answer(status, headers, body.encode())


class AnyName(PublicNames):
    def __contains__(self, host):
        return host != "hidden.test" and host != "www.hidden.test"


SET = Settings(max_pages_per_domain=4, domain_concurrency=1, domain_budget_seconds=60)


def settle(spark, told, asks, settings=SET, live=False, **how):
    fetch = over_http(settings, Scripted(told), AnyName, live=live, **how)
    commits = Commits(spark)
    rules = C.RobotsFiles(fetch, settings, commits) if live else None
    t = spark.createDataFrame([(str(i), h, u, s) for i, (h, u, s) in enumerate(asks)], "id string, host string, url string, spent double")
    rows = C.settled(t, fetch, settings, commits, "x", lambda s: s.isin(*C.AGAIN), rules).collect()
    assert len(rows) == len(asks)
    return [r for _, r in sorted((int(r.id), r) for r in rows)]


def test_redirects_failures_and_budgets(spark):
    to = lambda place: [(302, "", {"location": place})]
    told = {"https://a.test/": to("/b?utm_source=x"), "https://a.test/b": to("https://www.a.test/c"), "https://www.a.test/c": [(200, "end", {})], "https://b.test/": to("https://c.test/"), "https://d.test/": to("/"), "https://e.test/": [(302, "", {})], "https://f.test/": [RequestFailed("oversize")], "https://g.test/": [RuntimeError("secret")], "https://h.test/": [(503, "", {"retry-after": "500"})], "https://i.test/": [RequestFailed("timeout", True)], "https://hidden.test/": [(200, "x", {})], "https://k.test/": [(200, "x", {})]}
    asks = [(f"{x}.test", f"https://{x}.test/", 0.0) for x in [*"abdefghi", "hidden"]] + [("k.test", "https://k.test/", 59.99), ("k.test", "https://other.test/", 0.0)]
    rows = settle(spark, told, asks)
    assert [(r.url, r.status, r.code) for r in rows] == [
        ("https://www.a.test/c", 200, None),
        ("https://c.test/", None, "unsafe_destination"),
        ("https://d.test/", 302, "redirect_limit"),
        ("https://e.test/", 302, "redirect"),
        ("https://f.test/", None, "oversize"),
        ("https://g.test/", None, "unexpected_error"),
        ("https://h.test/", 503, "deadline_exceeded"),
        ("https://i.test/", None, "timeout"),
        ("https://hidden.test/", None, "unsafe_destination"),
        ("https://k.test/", None, "deadline_exceeded"),
        ("https://other.test/", None, "unsafe_destination"),
    ]
    assert rows[0].html == "end" and rows[0].hop == 2 and rows[7].attempt == 1 and rows[7].spent >= 0.5 and "secret" not in str(rows)


def test_robots_come_first(spark):
    files = {"a": [(200, "User-agent: *\nDisallow: /no\nCrawl-delay: 0.6", {})], "c": [(403, "", {})], "d": [(301, "", {"location": "https://www.d.test/robots.txt"})]}
    told = {f"https://{k}.test/robots.txt": v for k, v in files.items()} | {f"https://{k}.test{p}": [(200, p, {})] for k in "abcd" for p in ("/", "/no", "/x")} | {"https://www.d.test/robots.txt": [(200, "User-agent: *\nDisallow: /", {})]}
    rows = settle(spark, told, [(f"{k}.test", f"https://{k}.test{p}", 0.0) for k in "abcd" for p in ("/", "/no", "/x")], live=True)
    assert [r.code for r in rows] == [None, "robots_available", None] + [None] * 3 + ["robots_denied"] * 3 + ["robots_available"] * 3
    assert abs(rows[0].at - rows[2].at) >= 0.6


class Pages(BaseHTTPRequestHandler):
    def do_GET(self):
        hits.append(self.path)
        told = {"/": (200, b"home"), "/zip": (200, gzip.compress("zip é".encode())), "/big": (200, b"x" * 5_000_001), "/out": (302, b""), "/loop": (302, b""), "/in": (301, b""), "/bare": (302, b"")}
        status, body = told.get(self.path, (404, b""))
        self.send_response(status)
        if self.path == "/zip":
            self.send_header("Content-Encoding", "gzip")
        to = {"/out": "https://other.test/", "/loop": "/loop", "/in": "/zip?utm_source=a"}.get(self.path)
        if to:
            self.send_header("Location", to)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


hits: list[str] = []


def test_bounded_http(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        a = send(base + "/zip", 10)
        assert a.text == "zip é" and "content-encoding" not in a.headers and send(base + "/nothing", 5).status == 404
        with pytest.raises(RequestFailed) as e:
            send(base + "/big", 10)
        assert e.value.code == "oversize"
        fetch = over_http(SET, test_origins=(base,), live=False)
        t = spark.createDataFrame([(p, "a.test", base + p, 0.0) for p in ("/", "/in", "/loop", "/bare", "/out")], "id string, host string, url string, spent double")
        rows = {r.id: r for r in C.settled(t, fetch, SET, Commits(spark), "x", lambda s: s.isin(*C.AGAIN)).collect()}
        assert (rows["/"].html, rows["/in"].html, rows["/in"].url) == ("home", "zip é", base + "/zip")
        assert {k: r.code for k, r in rows.items() if r.code} == {"/loop": "redirect_limit", "/bare": "redirect", "/out": "unsafe_destination"}
        assert hits.count("/loop") == 6
    finally:
        server.shutdown()


def pages_table(spark, pages):
    return spark.createDataFrame([(u, *p) if isinstance(p, tuple) else (u, 200, p) for u, p in pages.items()], "url string, status int, html string")


def test_a_crawl_of_stored_pages(spark):
    page = "<p>words <a href='/team'>Team</a><a href='/login'>x</a><a href='https://other.test/'>o</a><a href='/blog/1'>b</a><a href='mailto:a@b.test'>m</a></p>"
    fetch = stored(pages_table(spark, {"https://a.test/": page, "https://a.test/team": (503, "")}), "<p>other</p>")
    hosts = spark.createDataFrame([("a.test",), ("a.test",), ("b.test",)], "host string")
    commits = Commits(spark)
    pages, spent = C.crawl(hosts, fetch, SET, commits)
    rows = pages.where("host = 'a.test'").orderBy("page_no").collect()
    assert [(r.requested_url, r.depth, r.priority, r.failure) for r in rows] == [("https://a.test/", 0, 0, None), ("https://a.test/team", 1, 1, "http_503"), ("https://a.test/about", 1, 5, None), ("https://a.test/company", 1, 5, None)]
    assert [r.source_id for r in rows] == ["page-1", "page-2", "page-3", "page-4"] and [r.selection_reason for r in rows][:3] == ["homepage", "discovered: Team (priority 1)", "generic fallback after limited relevant discovery"]
    assert pages.count() == 8 and {r.host: r.spent >= 0 for r in spent.collect()} == {"a.test": True, "b.test": True}
    # What is committed is not made again.
    broken = stored(pages_table(spark, {"https://x.test/": (500, "")}))
    assert sorted(map(str, C.crawl(hosts, broken, SET, commits)[0].drop("retrieval_method").collect())) == sorted(map(str, pages.drop("retrieval_method").collect()))


def test_a_live_crawl(spark):
    told = {"https://a.test/": [(301, "", {"location": "https://www.a.test/"})], "https://www.a.test/": [(200, "<a href='/team'>Team</a><a href='https://a.test/contact'>Contact</a>", {})], "https://www.a.test/team": [(200, "<p>the team</p>", {})], "https://www.a.test/robots.txt": [(200, "User-agent: *\nDisallow: /team", {})]}
    pages, spent = C.crawl(spark.createDataFrame([("a.test",)], "host string"), over_http(SET, Scripted(told), AnyName), SET, Commits(spark))
    rows = pages.orderBy("page_no").collect()
    assert [(r.requested_url, r.final_url, r.failure) for r in rows][:3] == [("https://a.test/", "https://www.a.test/", None), ("https://www.a.test/team", "https://www.a.test/team", "robots_available"), ("https://a.test/contact", "https://a.test/contact", "http_404")]
    assert len(rows) == 4 and spent.first().spent > 0


def test_a_crawl_out_of_time(spark):
    short = Settings(max_pages_per_domain=3, domain_budget_seconds=1.0)
    told = {"https://a.test/": [(200, "<p>home</p>", {})], "https://a.test/about": [(503, "", {"retry-after": "30"})]}
    pages, _ = C.crawl(spark.createDataFrame([("a.test",)], "host string"), over_http(short, Scripted(told), AnyName, live=False), short, Commits(spark))
    assert [(r.source_id, r.failure) for r in pages.orderBy("page_no").collect()] == [("page-1", None), (C.FAILED, "deadline_exceeded")]


GOOD = demo_extraction()


def sent(status, body, headers=None):
    def send(url, seconds, head, method, data):
        send.last = (url, head, json.loads(data))
        if isinstance(status, Exception):
            raise status
        return Answer(status, headers or {}, json.dumps(body).encode())

    return send


def gemini(parts=None, end="STOP", usage=None, **more):
    return {"candidates": [{"content": {"parts": parts or [{"text": "thinking", "thought": True}, {"text": json.dumps(GOOD)}]}, "finishReason": end}], "usageMetadata": usage or {"promptTokenCount": 100, "cachedContentTokenCount": 20, "candidatesTokenCount": 50, "thoughtsTokenCount": 10}, "modelVersion": "gemini-2.5-flash", "responseId": "g1"} | more


def openai(text=None, status="completed", kind="output_text", **more):
    return {"id": "o1", "model": "gpt-4.1-mini-x", "status": status, "output": [{"type": "message", "content": [{"type": kind, "text": text if text is not None else json.dumps(GOOD)}]}], "usage": {"input_tokens": 9, "input_tokens_details": {"cached_tokens": 4}, "output_tokens": 3}} | more


S = Settings(gemini_model="gemini-2.5-flash", gemini_api_key="kg", openai_api_key="ko")


def test_gemini():
    send = sent(200, gemini(), {"x-request-id": "q"})
    r = P.GeminiProvider(S, send).request("context", "", 5)
    assert (r.parsed, r.model, r.response_id, r.request_id, r.input_tokens, r.cached_input_tokens, r.output_tokens, r.problem) == (GOOD, "gemini-2.5-flash", "g1", "q", 100, 20, 60, None)
    url, head, body = send.last
    assert url.endswith("/gemini-2.5-flash:generateContent") and head["x-goog-api-key"] == "kg" and "kg" not in url + json.dumps(body)
    form = body["generationConfig"]["responseJsonSchema"]
    assert form["additionalProperties"] is False and set(form["required"]) == set(form["properties"]) and body["generationConfig"]["thinkingConfig"] == {"thinkingBudget": 0}
    draft = "issues\n" + json.dumps({"validated_draft": {"team_members": [{"name": "Ida"}], "contact_points": []}})
    P.GeminiProvider(S, send).request("context", draft, 5)
    form = send.last[2]["generationConfig"]["responseJsonSchema"]["properties"]
    assert form["team_members"]["items"]["properties"]["name"]["enum"] == ["Ida"] and form["contact_points"]["maxItems"] == 0
    for body, problem in ((gemini(end="SAFETY"), "refusal"), (gemini(end="MAX_TOKENS"), "incomplete_response"), (gemini(candidates=[]), "missing_parsed_output"), (gemini([{"text": "{}"}]), "structured_schema_invalid"), (gemini(promptFeedback={"blockReason": "X"}), "refusal")):
        r = P.GeminiProvider(S, sent(200, body)).request("c", "", 5)
        assert (r.parsed, r.problem, r.input_tokens) == (None, problem, 100)


def test_openai():
    send = sent(200, openai())
    r = P.OpenAIProvider(S, send).request("context", "fix it", 5)
    assert (r.parsed, r.model, r.response_id, r.input_tokens, r.cached_input_tokens, r.output_tokens, r.problem) == (GOOD, "gpt-4.1-mini-x", "o1", 9, 4, 3, None)
    assert send.last[1]["Authorization"] == "Bearer ko" and send.last[2]["store"] is False and "fix it" in send.last[2]["instructions"]
    for body, problem in ((openai(kind="refusal"), "refusal"), (openai(status="incomplete"), "incomplete_response"), (openai(output=[]), "missing_parsed_output"), (openai(text="{}"), "structured_schema_invalid")):
        assert P.OpenAIProvider(S, sent(200, body)).request("c", "", 5).problem == problem
    assert P.OpenAIProvider(S, sent(200, openai(usage=None))).request("c", "", 5).input_tokens is None


DAILY = {"error": {"details": [{"violations": [{"quotaId": "RequestsPerDayPerProject"}]}]}}
SOON = {"error": {"details": [{"retryDelay": "7s"}, {"violations": [{"quotaValue": "10"}]}]}}


@pytest.mark.parametrize(
    "make, status, body, code, retryable, wait",
    [
        *[(m, s, {}, c, again, None) for m in (P.OpenAIProvider, P.GeminiProvider) for s, c, again in ((400, "model_schema_or_request_unsupported", False), (401, "authentication_or_permission", False), (403, "authentication_or_permission", False), (422, "model_schema_or_request_unsupported", False), (500, "provider_http_500", True), (408, "provider_http_408", True), (418, "provider_http_418", False), (429, "rate_limit", True))],
        (P.OpenAIProvider, 429, {"error": {"code": "insufficient_quota"}}, "insufficient_quota", False, None),
        (P.GeminiProvider, 429, DAILY, "insufficient_quota", False, None),
        (P.GeminiProvider, 429, SOON, "rate_limit", True, "7"),
        (P.GeminiProvider, 200, {"usageMetadata": {"promptTokenCount": 1, "cachedContentTokenCount": 2}}, "invalid_provider_response", False, None),
        (P.OpenAIProvider, TimeoutError(), {}, "provider_timeout_or_connection", True, None),
    ],
)
def test_failures(make, status, body, code, retryable, wait):
    with pytest.raises(P.ProviderFailure) as e:
        make(S, sent(status, body)).request("c", "", 5)
    assert (e.value.code, e.value.retryable, e.value.retry_after) == (code, retryable, wait) and "kg" not in str(e.value)


ODD = [None, 5, "x", [], {}, ["x"], {"content": ["x"]}, [{"content": [{"parts": 5}]}], [{"content": {"parts": ["x", {"text": 5}]}}], {"input_tokens": [1]}]


@pytest.mark.parametrize("make, whole", [(P.OpenAIProvider, openai), (P.GeminiProvider, gemini)])
def test_odd_answers_are_failures(make, whole):
    """Any member of an answer may be of any kind: there is a reply, or a failure with a code."""
    names = ("output", "usage", "status", "id", "model", "candidates", "usageMetadata", "promptFeedback", "error", "responseId", "modelVersion")
    for status in (200, 429, 500):
        for body in [*ODD, *(whole(**{n: x}) for n in names for x in ODD)]:
            try:
                r = make(S, sent(status, body)).request("c", "", 5)
                assert r.problem is None or r.parsed is None
            except P.ProviderFailure as e:
                assert e.code


def test_closed_shapes():
    assert schema.fit(GOOD, schema.EXTRACTION) == GOOD
    for change in ({"extra": 1}, {"company_name": None}, {"company_name": {"value": 5, "evidence": []}}, {"contact_points": [{"email": "a", "category": "boss", "evidence": []}]}):
        with pytest.raises(schema.Misfit):
            schema.fit(GOOD | change, schema.EXTRACTION)
    with pytest.raises(schema.Misfit):
        schema.fit({k: v for k, v in GOOD.items() if k != "team_members"}, schema.EXTRACTION)


def test_a_browser_is_not_asked_for_files():
    """Chromium itself is not here; what is fetched how is."""
    fetch = rendered(Settings(navigation_timeout_ms=20_000))
    assert (fetch.method, fetch.live, fetch.seconds) == ("playwright", True, 20.0)
    assert fetch.files.method == "http_fallback" and fetch.files.files is None


class Page:
    """What a browser's page is asked, and what its document's request comes to."""

    def __init__(self, status, location=None, leaves=False):
        self.main_frame, self.status, self.location, self.leaves, self.told = self, status, location, leaves, []

    def route(self, _, gate):
        self.gate = gate

    def goto(self, url, **_):
        self.gate(Route(self, url))
        self.gate(Route(self, "https://a.test/frame", frame=None))
        self.gate(Route(self, "https://hidden.test/x.js", page=False))
        self.gate(Route(self, "https://a.test/x.js", page=False))
        if self.leaves:
            self.gate(Route(self, "https://a.test/elsewhere"))

    def content(self):
        return "<p>html</p>"

    def wait_for_timeout(self, _):
        pass

    def close(self):
        self.told.append("closed")

    mouse = type("Mouse", (), {"wheel": lambda *_: None})()


class Route:
    def __init__(self, owner, url, page=True, frame=True):
        self.owner, self.request = owner, type("Request", (), {"url": url, "is_navigation_request": lambda _: page, "frame": owner if frame else None})()

    def fetch(self, **_):
        return type("Response", (), {"status": self.owner.status, "headers": {"location": self.owner.location} if self.owner.location else {}})()

    def abort(self):
        self.owner.told.append(f"abort {self.request.url}")

    def continue_(self):
        self.owner.told.append(f"pass {self.request.url}")

    def fulfill(self, response):
        self.owner.told.append(f"show {self.request.url}")


@pytest.mark.parametrize("page, want", [(Page(200), {"status": 200, "location": None, "retry_after": None, "html": "<p>html</p>"}), (Page(302, "/b"), {"status": 302, "location": "/b", "retry_after": None}), (Page(503), {"status": 503, "location": None, "retry_after": None}), (Page(200, leaves=True), "client_redirect")])
def test_what_a_page_may_load(monkeypatch, page, want):
    sync = types.ModuleType("playwright.sync_api")
    sync.Error = type("Error", (Exception,), {})
    monkeypatch.setitem(sys.modules, "playwright", types.ModuleType("playwright"))
    monkeypatch.setitem(sys.modules, "playwright.sync_api", sync)
    browser = types.SimpleNamespace(page=lambda r: page, names=AnyName(), settings=Settings())
    ask = lambda: _rendered({"url": "https://a.test/", "seconds": 5.0}, browser)
    if isinstance(want, str):
        with pytest.raises(RequestFailed, match=want):
            ask()
    else:
        assert ask() == want
    shown = "abort" if 300 <= page.status < 400 else "show"
    assert page.told[:4] == [f"{shown} https://a.test/", "abort https://a.test/frame", "abort https://hidden.test/x.js", "pass https://a.test/x.js"] and page.told[-1] == "closed"
