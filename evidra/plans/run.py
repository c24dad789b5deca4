"""Whole runs: domains in, a saved and audited file out, from live connectors or from fixtures."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.connectors import search as S
from evidra.connectors.fetch import Fetch, rendered, stored
from evidra.connectors.providers import FixtureProvider, GeminiProvider, OpenAIProvider
from evidra.operators import grounding, queue
from evidra.plans import crawl as C
from evidra.plans import enrich as E
from evidra.plans import extract as X
from evidra.settings import Settings
from evidra.sources import domains as D
from evidra.sources import runs
from evidra.sources.commits import Commits

ESTIMATED = "Gemini context tokens use a local o200k_base estimate; usage contains provider-reported counts, including any thinking tokens in output_tokens."


#: Domains that are worked on together; what a wave came to is committed and saved before the next begins.
WAVE = 10_000


def process(domains: DataFrame, fetch: Fetch, provider: Callable, settings: Settings, commits: Commits, search_send=None, clock: Callable[[], float] = time.time) -> DataFrame:
    """Results of domains (ord, input_domain, normalized_domain): crawled, cleaned, extracted, searched for and scored.

    A host that is named more than once is crawled once. A domain has one time budget for its crawl, its extraction and its search.
    """
    hosts = domains.where("normalized_domain is not null").select(F.col("normalized_domain").alias("host")).distinct()
    pages, took = C.crawl(hosts, fetch, settings, commits, clock)
    named = domains.select("ord", F.col("normalized_domain").alias("host"))
    fetched, spent = pages.join(named, "host").drop("host"), took.join(named, "host").select("ord", "spent")
    broken = fetched.where(F.col("source_id") == C.FAILED).select("ord", F.lit("budget").alias("stage"), F.col("failure").alias("code"), F.lit("Per-domain time budget exhausted").alias("message"), F.lit(False).alias("retryable"))
    found = commits.step("sources", E.sources(domains, fetched.where(F.col("source_id") != C.FAILED), lambda df: commits.step("cleaned", df)))
    told = X.extract(domains, found, provider, settings, commits, spent, clock)
    grounded, search = told["grounded"], None
    if settings.enable_search:
        grounded, search = _searched(domains, found, commits.step("grounded", grounded), told["spent"], settings, commits, search_send)
    return E.enrich(domains, found, grounded, told["replies"], told["contexts"], told["failures"].unionByName(broken), search, settings.pricing, spent.withColumnRenamed("spent", "duration_seconds"))


def _searched(domains: DataFrame, found: DataFrame, grounded: DataFrame, spent: DataFrame, settings: Settings, commits: Commits, send):
    team = grounded.select("ord", F.posexplode("team_members").alias("item", "p")).select("ord", "item", "p.*")
    company = grounded.join(domains, "ord").select("ord", F.coalesce("company_name", "normalized_domain").alias("company"))
    targets = grounding.search_targets(team)
    left = spent.select("ord", queue.left(settings.domain_budget_seconds, F.col("spent")).alias("left"))
    said = commits.step("hits", S.searched(targets.join(company, "ord").join(left, "ord"), settings, **({"send": send} if send else {})))
    fetched = found.groupBy("ord").agg(F.count("*").alias("n"))
    snippets, candidates = grounding.search_candidates(targets, said.where("hit is not null"), company, fetched)
    packed = grounding.packed_people(grounding.with_candidates(team, candidates))
    out = grounded.drop("team_members").join(packed, "ord", "left")
    requests = said.where("hit is null and warning is null").groupBy("ord").agg(F.count("*").alias("n"))
    return out, {"snippets": snippets, "requests": requests, "warnings": said.where("warning is not null").select("ord", "warning")}


def run(spark: SparkSession, domains: list[str] | DataFrame, settings: Settings, output: str | None, fetch: Fetch, provider: Callable, mode: str, search_send=None, run_id: str | None = None, wave: int = WAVE, root: str | None = None) -> tuple[dict, DataFrame]:
    """(head, results) of a run; with output, saved there at the start and after each wave of domains.

    run_id: a run that did not come to its end, to be resumed: waves and, within a wave, tables and answers that are committed are read
    and not made again. Whatever ends a run early, the file holds the results of all waves that are whole.
    """
    d = D.inline(spark, domains) if isinstance(domains, list) else domains
    n = d.agg(F.max("ord")).first()[0]
    if n is None:
        raise ValueError("at least one domain is needed")
    if output:
        runs.ensure_destination(output, mode)
    warnings = ["DEMO: synthetic fixture data; no real company or provider results"] if mode == "demo" else []
    if mode == "live" and settings.llm_provider == "gemini":
        warnings.append(ESTIMATED)
    run_id = run_id or str(uuid.uuid4())
    head = {"schema_version": "1.0", "run_id": run_id, "mode": mode, "started_at": datetime.now(UTC), "finished_at": None, "model": settings.model_name if mode == "live" else "fixture-adapter", "configuration": settings.redacted(), "complete": False, "warnings": warnings}
    commits = Commits(spark, run_id, root)
    d = commits.step("domains", d)
    schema = spark.createDataFrame([], ", ".join(f"{k} {v}" for k, v in E.RESULT.items())).schema
    results = spark.createDataFrame([], schema)
    if output:
        runs.save(head, results, output)
    try:
        for w in range(n // wave + 1):
            name, of_wave = f"results-{w}", commits.below(f"wave-{w}")
            if not commits.done(name):
                mine = d.where(F.col("ord").between(w * wave, (w + 1) * wave - 1))
                commits.step(name, process(mine, fetch, provider, settings, of_wave, search_send))
                of_wave.drop()
            done = commits.read(name, schema)
            results = done if w == 0 else results.unionByName(done)
            if output and w < n // wave:
                runs.save(head, results, output)
    except BaseException as e:
        e.add_note(f"resume with run_id={run_id!r}")
        raise
    else:
        head |= {"complete": True, "finished_at": datetime.now(UTC)}
    finally:
        if output:
            runs.save(head, results, output)
    return head, results


def enrich(domains: list[str], *, settings: Settings | None = None, output: str | None = None, spark: SparkSession | None = None, run_id: str | None = None) -> tuple[dict, DataFrame]:
    """Public domains through Chromium and the chosen model; results keep the order of the domains."""
    settings = settings or Settings.load()
    settings.require_live_key()
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.speculation", "false").getOrCreate()
    provider = GeminiProvider if settings.llm_provider == "gemini" else OpenAIProvider
    return run(spark, domains, settings, output, rendered(settings), partial(provider, settings), "live", run_id=run_id)


HOME = """<html><head><title>Quillmoor</title></head><body><nav><a href="/team">Team</a><a href="/pricing">Pricing</a></nav>
<main><h1>Quillmoor</h1><p>Quillmoor makes planning boards for small workshops.</p><p>Its boards show orders, tools and free hours.</p>
<p>Built for workshop owners and their teams.</p><section><h2>Our team</h2><p>Ida Brandt is the founder of Quillmoor.</p></section></main>
<footer><a href="mailto:post@quillmoor.test?subject=Hello">Write to our team</a></footer></body></html>"""


def demo_extraction() -> dict:
    claim = lambda x: {"value": x, "evidence": [{"source_id": "page-1", "excerpt": x}]}
    told = [{"source_id": "page-1", "excerpt": "Ida Brandt is the founder of Quillmoor."}]
    return {
        "company_name": claim("Quillmoor"),
        "overview_sentence_1": claim("Quillmoor makes planning boards for small workshops."),
        "overview_sentence_2": claim("Its boards show orders, tools and free hours."),
        "target_audience": claim("Built for workshop owners and their teams."),
        "contact_points": [],
        "team_members": [{"name": "Ida Brandt", "role": "founder", "linkedin_url": None, "relationship_evidence": told, "role_evidence": told, "profile_evidence": []}],
    }


def demo(spark: SparkSession, output: str, vocabulary: str) -> tuple[dict, DataFrame]:
    """One made-up company, its page and its extraction; no network. vocabulary: a .tiktoken file."""
    settings = Settings(max_pages_per_domain=3, vocabulary=vocabulary)
    pages = stored(spark.createDataFrame([], "url string, status int, html string"), HOME)
    return run(spark, ["quillmoor.test"], settings, output, pages, partial(FixtureProvider, demo_extraction()), "demo")
