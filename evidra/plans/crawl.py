"""A crawl in rounds: every host takes its best next page, all pages of a round are fetched as one table, and what they link to comes into the next.

URLs, scope, robots rules, pace, redirects, second attempts and time budgets are columns; a fetch only fetches (connectors.fetch). A round's
requests are dealt by origin into small tasks, so a lost task repeats a few requests and no origin is asked by two. Every table is
committed, and a crawl that is resumed reads what it had.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.connectors.fetch import Fetch
from evidra.functions import urls as U
from evidra.operators import frontier, html, queue, robots
from evidra.sources.commits import Commits

PAGES = "host string, source_id string, page_no int, requested_url string, final_url string, http_status int, depth int, priority int, selection_reason string, retrieval_method string, retrieved_at timestamp, html string, failure string, retryable boolean"
FAILED = "domain_failure"
AGENT = "evidra"
# Hops to a page at most, and statuses worth a second attempt.
HOPS, AGAIN = 6, (408, 500, 502, 503, 504)
SETTLED = "id string, host string, url string, hop int, attempt int, spent double, status int, html string, code string, retryable boolean, at double, delay double"


def allowed_place(url, host, test_origins: tuple[str, ...] = ()):
    """Whether a URL may be asked for in a host's crawl."""
    own = U.in_scope(url, host)
    return F.coalesce(own | U.origin(url).isin(*test_origins) if test_origins else own, F.lit(False))


def settled(asks: DataFrame, fetch: Fetch, settings, commits: Commits, name: str, again: Callable, rules: RobotsFiles | None = None, clock: Callable[[], float] = time.time) -> DataFrame:
    """SETTLED for asks (id, host, url, spent): the answer that redirects and one second attempt lead to, or the code of why there is none.

    again: a condition on a status for which to ask a second time. rules: robots rules that hold and set the pace. spent grows by what
    requests and required waits took; where it would pass the domain's budget the code is deadline_exceeded.
    """
    todo = asks.select("id", "host", "url", "spent", F.lit(0).alias("hop"), F.lit(0).alias("attempt"), F.lit(0.0).alias("not_before"))
    ends = []
    for k in range(2 * HOPS):
        now = float(clock())
        t = todo.withColumn("origin", U.origin(F.col("url")))
        place = F.when(~allowed_place(F.col("url"), F.col("host"), fetch.test_origins), "unsafe_destination")
        if rules is None:
            t = t.withColumn("delay", F.lit(0.0)).withColumn("refused", place)
        else:
            t = rules.of(t, f"{name}-{k}", clock)
            t = t.withColumn("refused", F.coalesce(place, F.when(~F.col("allowed"), F.concat(F.lit("robots_"), "robots_state"))))
        left = queue.left(settings.domain_budget_seconds, F.col("spent"))
        t = t.withColumn("refused", F.coalesce(F.when(left < queue.LEAST, "deadline_exceeded"), "refused")).withColumn("seconds", F.least(left, F.lit(float(fetch.seconds or settings.http_timeout_seconds))))
        t = t.select("id", "host", "url", "origin", "spent", "hop", "attempt", "not_before", "delay", "refused", "seconds")
        go = queue.paced(t.where("refused is null"), now)
        met = t.join(fetch.run(go.select("id", "url", "origin", "start", "delay", "seconds")), "id", "left")
        spent = F.col("spent") + F.coalesce("took", F.lit(0.0))
        moved = F.col("status").between(300, 399) & (F.col("status") != 304)
        to = U.canonical_url(U.resolved(F.col("location"), F.col("url")))
        code = F.coalesce("refused", "failure", F.when(moved & F.coalesce(F.col("location") == "", F.lit(True)), "redirect").when(moved & to.isNull(), "unsafe_destination").when(moved & (F.col("hop") + 1 >= HOPS), "redirect_limit"))
        once_more = (F.col("attempt") == 0) & F.when(F.col("failure").isNotNull(), F.col("retryable")).otherwise(F.coalesce(again(F.col("status")), F.lit(False)))
        wait = queue.wait(F.col("attempt"), F.col("retry_after"), F.lit(now), F.col("id"))
        met = met.select(
            "id", "host", "url", "hop", "attempt", spent.alias("spent"), "status", "html", "retryable", "at", "delay", code.alias("code"),
            F.when(moved & code.isNull(), to).alias("to"), F.when(F.coalesce(once_more, F.lit(False)) & F.col("refused").isNull(), wait).alias("wait"),
        )
        late = F.col("wait") >= queue.left(settings.domain_budget_seconds, F.col("spent"))
        met = met.withColumn("code", F.when(late, "deadline_exceeded").otherwise(F.col("code"))).withColumn("wait", F.when(~late, F.col("wait")))
        met = commits.step(f"{name}-{k}", met)
        ends.append(met.where("`to` is null and wait is null"))
        waited = F.coalesce("wait", F.lit(0.0))
        todo = met.where("`to` is not null or wait is not null").select(
            "id", "host", F.coalesce("to", "url").alias("url"), (F.col("spent") + waited).alias("spent"), F.when(F.col("to").isNotNull(), F.col("hop") + 1).otherwise(F.col("hop")).alias("hop"),
            F.when(F.col("to").isNotNull(), 0).otherwise(F.col("attempt") + 1).alias("attempt"), F.when(F.col("wait").isNotNull(), F.lit(now) + F.col("wait")).otherwise(0.0).alias("not_before"),
        )
        if todo.isEmpty():
            break
    out = ends[0]
    for e in ends[1:]:
        out = out.unionByName(e)
    names = [x.split()[0] for x in SETTLED.split(", ")]
    return out.select(*names)


class RobotsFiles:
    """Robots rules by origin; those of new origins are asked for when a table first names them."""

    def __init__(self, fetch: Fetch, settings, commits: Commits):
        self.fetch, self.settings, self.commits, self.parts = fetch, settings, commits, []

    def _known(self) -> DataFrame:
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.unionByName(p)
        return out

    def of(self, t: DataFrame, name: str, clock) -> DataFrame:
        """t (origin, host, url, spent) with delay, robots_state and allowed; spent grows by what asking for the files took."""
        fresh = t.groupBy("origin").agg(F.min("host").alias("host"), F.min("spent").alias("spent"))
        if self.parts:
            fresh = fresh.join(self._known().select("origin"), "origin", "left_anti")
        if not fresh.isEmpty():
            asks = fresh.select(F.col("origin").alias("id"), "host", F.concat("origin", F.lit("/robots.txt")).alias("url"), "spent")
            again = lambda status: status.isin(408, 429) | (status >= 500)
            got = settled(asks, self.fetch, self.settings, self.commits, f"{name}-robots", again, clock=clock)
            took = got.join(fresh.select(F.col("origin").alias("id"), F.col("spent").alias("before")), "id").select("host", F.col("id").alias("origin"), F.greatest(F.col("spent") - F.col("before"), F.lit(0.0)).alias("robots_took"))
            files = got.select(F.col("id").alias("origin"), F.when(F.col("code").isNull(), F.col("status")).alias("status"), F.col("html").alias("body"))
            self.parts.append(self.commits.step(f"{name}-rules", robots.parse(files, AGENT)))
            t = t.join(took, ["host", "origin"], "left").withColumn("spent", F.col("spent") + F.coalesce("robots_took", F.lit(0.0))).drop("robots_took")
        known = self._known()
        t = robots.allowed(t, known).join(known.select("origin", F.col("delay").alias("__delay")), "origin", "left")
        return t.withColumn("delay", F.coalesce("__delay", F.lit(robots.MIN_DELAY))).drop("__delay")


def crawl(hosts: DataFrame, fetch: Fetch, settings, commits: Commits, clock: Callable[[], float] = time.time) -> tuple[DataFrame, DataFrame]:
    """(PAGES, spent by host) of hosts (host), each once.

    Failures of pages count as pages. A host whose time is spent has a row FAILED behind the pages that it had time for.
    """
    rules = RobotsFiles(fetch.files or fetch, settings, commits) if fetch.live else None
    also = (lambda u: U.origin(u).isin(*fetch.test_origins)) if fetch.test_origins else None
    state = frontier.turn(frontier.started(hosts.select("host").distinct()).withColumn("offers", F.lit(None).cast(frontier.OFFERS)), settings.max_depth)
    state = commits.step("crawl-0-state", state)
    pages = []
    for n in range(1, settings.max_pages_per_domain + 1):
        asking = state.where("at is not null")
        if asking.isEmpty():
            break
        asks = asking.select(F.col("host").alias("id"), "host", F.col("at").alias("url"), "spent")
        got = settled(asks, fetch, settings, commits, f"crawl-{n}", lambda status: status.isin(*AGAIN), rules, clock)
        status = F.col("status")
        failure = F.coalesce("code", F.when(status == 429, "access_blocked").when(status >= 400, F.concat(F.lit("http_"), status.cast("string"))))
        choice = asking.select("host", F.size("pages").alias("page_no"), F.element_at("pages", -1).alias("c"))
        met = got.join(choice, "host").select(
            "host", "page_no", F.col("c.url").alias("requested_url"), F.col("url").alias("final_url"), status.alias("http_status"), "c.depth", "c.priority",
            F.when(F.col("code").isNull(), F.timestamp_millis((F.coalesce("at", F.lit(float(clock()))) * 1000).cast("long"))).alias("retrieved_at"),
            F.when(failure.isNull(), F.col("html")).otherwise("").alias("html"), failure.alias("failure"), F.coalesce("retryable", F.lit(False)).alias("retryable"), "spent",
        )
        links = F.transform(html.parse(F.col("html"))["links"], lambda x: F.struct(U.canonical_url(U.resolved(x["href"], F.col("final_url"))).alias("url"), x["text"].alias("text")))
        good = F.col("failure").isNull()
        met = met.withColumn("links", links).withColumn("offers", F.when(good, frontier.offered(F.filter("links", lambda x: x["url"].isNotNull()), F.col("host"), also)))
        met = commits.step(f"crawl-{n}-pages", met)
        pages.append(met)
        told = met.select("host", F.when(F.col("failure").isNull(), F.col("final_url")).alias("end"), "offers", F.col("spent").alias("now"), (F.col("failure") == "deadline_exceeded").alias("over"))
        after = state.join(told, "host", "left").withColumn("at", F.coalesce("end", "at")).withColumn("spent", F.coalesce("now", "spent"))
        over = F.coalesce("over", F.lit(False))
        after = after.withColumn("queue", F.when(over, F.slice("queue", 1, 0)).otherwise(F.col("queue"))).withColumn("spare", F.col("spare") & ~over)
        state = commits.step(f"crawl-{n}-state", frontier.turn(after.withColumn("offers", F.when(~over, F.col("offers"))), settings.max_depth))
    spent = state.select("host", "spent")
    if not pages:
        return hosts.sparkSession.createDataFrame([], PAGES), spent
    every = pages[0]
    for p in pages[1:]:
        every = every.unionByName(p)
    # Why a page was chosen: by the words of the first link to it.
    each = every.select("host", "page_no", F.posexplode("links").alias("pos", "l")).where("l.url is not null")
    said = each.groupBy("host", F.col("l.url").alias("requested_url")).agg(F.min(F.struct("page_no", "pos", F.col("l.text").alias("text")))["text"].alias("said"))
    every = every.join(said, ["host", "requested_url"], "left")
    found = F.concat(F.lit("discovered: "), F.substring(F.coalesce("said", F.lit("")), 1, 100), F.lit(" (priority "), F.col("priority").cast("string"), F.lit(")"))
    why = F.when(F.col("page_no") == 1, "homepage").when(F.col("priority") == frontier.SPARE, "generic fallback after limited relevant discovery").otherwise(found)
    over = F.coalesce(F.col("failure") == "deadline_exceeded", F.lit(False))
    out = every.withColumn("selection_reason", why).withColumn("retrieval_method", F.lit(fetch.method)).withColumn("source_id", F.when(over, FAILED).otherwise(F.concat(F.lit("page-"), F.col("page_no").cast("string"))))
    return out.select(*(F.col(x.split()[0]).cast(x.split()[1]) for x in PAGES.split(", "))), spent
