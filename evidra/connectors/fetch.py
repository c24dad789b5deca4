"""Ways to fetch pages. Each takes a table of requests that may be made and gives a table of answers; none decides what comes next.

Requests: id string, url string, origin string, start double (seconds since 1970), delay double, seconds double. Answers: ANSWERS. A request whose
fetching fails in any way is an answer with a failure, so no request stops another.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.connectors.http import USER_AGENT, PublicNames, RequestFailed, send
from evidra.functions import urls as U

ANSWERS = "id string, status int, location string, html string, failure string, retryable boolean, retry_after string, took double, at double"
_FORM = pa.schema([("id", pa.string()), ("status", pa.int32()), ("location", pa.string()), ("html", pa.string()), ("failure", pa.string()), ("retryable", pa.bool_()), ("retry_after", pa.string()), ("took", pa.float64()), ("at", pa.float64())])


@dataclass(frozen=True)
class Fetch:
    """method: how pages were got, as results tell it. live: whether robots files are asked for and origins paced.

    seconds: what a request may take at most, by default the HTTP timeout. files: how files that are no pages are got, by default the same way.
    """

    method: str
    run: Callable[[DataFrame], DataFrame]
    live: bool = False
    test_origins: tuple[str, ...] = ()
    seconds: float | None = None
    files: Fetch | None = None


def stored(pages: DataFrame, otherwise: str | None = None, method: str = "fixture") -> Fetch:
    """Pages of a table (url, status, html), by canonical URL; other URLs have the page otherwise, or are missing. One join, whatever their number."""
    held = pages.select(U.canonical_url(F.col("url")).alias("__url"), F.struct(F.col("status").cast("int").alias("status"), "html").alias("p")).groupBy("__url").agg(F.min("p").alias("p"))

    def run(requests: DataFrame) -> DataFrame:
        met = requests.withColumn("__url", U.canonical_url(F.col("url"))).join(held, "__url", "left")
        status = F.coalesce("p.status", F.lit(404 if otherwise is None else 200))
        html = F.when(F.col("p").isNull(), F.lit(otherwise)).otherwise(F.col("p.html"))
        none = F.lit(None).cast("string")
        return met.select("id", status.alias("status"), none.alias("location"), F.coalesce(html, F.lit("")).alias("html"), none.alias("failure"), F.lit(False).alias("retryable"), none.alias("retry_after"), F.lit(0.0).alias("took"), F.col("start").alias("at"))

    return Fetch(method, run)


def _dealt(requests: DataFrame, settings) -> DataFrame:
    """Requests by origin, each origin in one task and in the order of their starts."""
    tasks = max(settings.domain_concurrency, int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return requests.select("id", "url", "origin", "start", "delay", "seconds").repartition(tasks, "origin").sortWithinPartitions("start", "id")


def _answered(one: Callable[[dict], dict], opened: Callable | None = None):
    """Makes each request when its time has come, and none sooner after the last of its origin than the delay."""

    def run(batches):
        last: dict[str, float] = {}
        state = opened() if opened else None
        try:
            for b in batches:
                for r in b.to_pylist():
                    pause = max(r["start"], last.get(r["origin"], 0.0) + r["delay"]) - time.time()
                    if pause > 0:
                        time.sleep(pause)
                    last[r["origin"]] = at = time.time()
                    try:
                        told = one(r, state) if opened else one(r)
                    except RequestFailed as e:
                        told = {"failure": e.code, "retryable": e.retryable}
                    except Exception as e:
                        told = {"failure": "unexpected_error", "location": type(e).__name__}
                    yield pa.RecordBatch.from_pylist([{"id": r["id"], "html": "", "retryable": False} | told | {"at": at, "took": time.time() - at}], schema=_FORM)
        finally:
            if state is not None:
                state.close()

    return run


def over_http(settings, get: Callable = send, names: Callable = PublicNames, method: str = "http_fallback", live: bool = True, test_origins: tuple[str, ...] = ()) -> Fetch:
    """Plain requests. get: sends one. names: makes what tells public hosts. test_origins: origins that need not be public."""

    def fetched(r: dict, public: _Names) -> dict:
        if r["origin"] not in test_origins and urlsplit(r["url"]).hostname not in public.names:
            return {"failure": "unsafe_destination"}
        a = get(r["url"], r["seconds"])
        return {"status": a.status, "location": a.headers.get("location"), "html": a.text, "retry_after": a.headers.get("retry-after")}

    return Fetch(method, lambda requests: _dealt(requests, settings).mapInArrow(_answered(fetched, lambda: _Names(names())), ANSWERS), live, test_origins)


@dataclass
class _Names:
    names: PublicNames

    def close(self) -> None:
        pass


class _Browser:
    """Chromium by the playwright package, one a task; a context for each origin of it."""

    def __init__(self, settings, names):
        from playwright.sync_api import sync_playwright

        self.settings, self.names, self.contexts = settings, names, {}
        self.driver = sync_playwright().start()
        self.browser = self.driver.chromium.launch(headless=not settings.headed)

    def close(self) -> None:
        self.browser.close()
        self.driver.stop()

    def page(self, r: dict):
        if r["origin"] not in self.contexts:
            self.contexts[r["origin"]] = self.browser.new_context(user_agent=USER_AGENT, service_workers="block")
        return self.contexts[r["origin"]].new_page()


def _rendered(r: dict, b: _Browser) -> dict:
    """The page that was asked for, as it looks after a while. Its document comes from that URL alone: any other is not loaded."""
    from playwright.sync_api import Error

    limit, page, met = r["seconds"] * 1000, b.page(r), {}

    def gate(route):
        q = route.request
        if urlsplit(q.url).hostname not in b.names:
            return route.abort()
        if not q.is_navigation_request():
            return route.continue_()
        if q.frame != page.main_frame:
            return route.abort()
        if met:  # the page leads elsewhere by itself
            met["left"] = True
            return route.abort()
        a = route.fetch(max_redirects=0, timeout=limit)
        met.update(status=a.status, location=a.headers.get("location"), retry_after=a.headers.get("retry-after"))
        return route.abort() if 300 <= a.status < 400 else route.fulfill(response=a)

    try:
        page.route("**/*", gate)
        try:
            page.goto(r["url"], wait_until="domcontentloaded", timeout=limit)
        except Error as e:
            if not met:
                raise RequestFailed("navigation_error", True) from e
        if met.get("status", 0) >= 300:
            return met
        for _ in range(2):
            page.mouse.wheel(0, 900)
            page.wait_for_timeout(min(limit, b.settings.render_wait_ms) / 2)
        if met.pop("left", False):
            raise RequestFailed("client_redirect")
        html = page.content()
        if len(html.encode("utf-8", "surrogatepass")) > b.settings.max_html_bytes:
            raise RequestFailed("oversize")
        return met | {"html": html}
    finally:
        page.close()


def rendered(settings, names: Callable = PublicNames) -> Fetch:
    """Pages as Chromium renders them; robots files come over plain HTTP."""
    run = lambda requests: _dealt(requests, settings).mapInArrow(_answered(_rendered, lambda: _Browser(settings, names())), ANSWERS)
    return Fetch("playwright", run, True, seconds=settings.navigation_timeout_ms / 1000, files=over_http(settings, names=names))
