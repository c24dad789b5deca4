"""Whole runs without network: the demo, batches with failures, extraction rounds, saving, loading and the command line."""

import json
import os
import sys
from functools import partial

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from evidra import cli
from evidra.connectors.fetch import over_http, stored
from evidra.connectors.http import Answer, PublicNames
from evidra.connectors.providers import FixtureProvider, ProviderFailure, Reply
from evidra.connectors.search import searched
from evidra.operators import audit
from evidra.plans import extract as X
from evidra.plans import run as R
from evidra.settings import SettingError, Settings
from evidra.sources import domains as D
from evidra.sources import runs
from evidra.sources.commits import Commits

# Workers cannot import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def settings(vocabulary):
    return Settings(vocabulary=vocabulary, max_pages_per_domain=3, domain_budget_seconds=60)


GOOD = R.demo_extraction()
BAD = json.loads(json.dumps(GOOD))
BAD["team_members"][0]["role"] = "CEO"
SOUND, UNSOUND = Reply(GOOD, "m", "r", "q", 100, 20, 50), Reply(BAD, "m", "r2", None, 10, 0, 5)
FAILS = ProviderFailure("rate_limit", retryable=True, retry_after="0")


#: Answers by domain and attempt, the last one again and again; requests made, and the code of the end.
SCRIPTS = {
    "sound.test": ([SOUND], 1, None),
    "waits.test": ([FAILS, SOUND], 2, None),
    "fails.test": ([FAILS], 3, "rate_limit"),
    "refuses.test": ([Reply(None, "m", problem="refusal")], 1, "refusal"),
    "breaks-off.test": ([Reply(None, "m", problem="incomplete_response")], 2, "incomplete_response"),
    "says-nothing.test": ([Reply(None, "m")], 2, "missing_parsed_output"),
    "spent.test": ([ProviderFailure("insufficient_quota")], 1, "insufficient_quota"),
    "misformed.test": ([ProviderFailure("structured_schema_invalid", repairable=True), SOUND], 2, None),
    "later.test": ([ProviderFailure("rate_limit", retryable=True, retry_after="1000")], 1, "deadline_exceeded"),
    "crashes.test": ([RuntimeError("secret text")], 1, "invalid_provider_response"),
    "odd.test": ([Reply({"extra": 1}, "m")], 1, "invalid_provider_response"),
}


class Sound:
    def request(self, *_):
        return SOUND


class ByTurn:
    """Answers of SCRIPTS. A worker may be a new one, so the turn is told by what stands in the folder that all share."""

    def __init__(self, folder):
        self.folder = folder

    def request(self, context, repair, seconds):
        domain = context.split("\n")[0].split(": ")[1]
        turns = SCRIPTS[domain][0]
        made = [f for f in os.listdir(self.folder) if f.startswith(domain)]
        with open(f"{self.folder}/{domain}-{len(made)}", "w") as f:
            f.write(repair)
        turn = turns[min(len(made), len(turns) - 1)]
        if isinstance(turn, Exception):
            raise turn
        return turn


def home(spark, pages=(), otherwise=R.HOME, method="playwright"):
    """Stored pages; other URLs show the same page."""
    rows = [(u, *p) if isinstance(p, tuple) else (u, 200, p) for u, p in dict(pages).items()]
    return stored(spark.createDataFrame(rows, "url string, status int, html string"), otherwise, method)


def test_rounds(spark, settings, tmp_path):
    s = Settings(vocabulary=settings.vocabulary, max_pages_per_domain=1, max_llm_requests_per_domain=3, domain_budget_seconds=100)
    _, results = R.run(spark, list(SCRIPTS), s, None, home(spark), partial(ByTurn, str(tmp_path)), "live")
    rows = {r.input_domain: r for r in results.collect()}
    made = {k: sum(f.startswith(k) for f in os.listdir(tmp_path)) for k in SCRIPTS}
    assert made == {k: n for k, (_, n, _) in SCRIPTS.items()} == {k: r.usage.request_count for k, r in rows.items()}
    assert {k: [e.code for e in r.errors] for k, r in rows.items()} == {k: [code] if code else [] for k, (_, _, code) in SCRIPTS.items()}
    assert all((r.company_name == "Quillmoor") == (SCRIPTS[k][2] is None) for k, r in rows.items()) and "secret" not in str(rows)
    told = lambda k, n: (tmp_path / f"{k}-{n}").read_text()
    assert (told("waits.test", 1), told("breaks-off.test", 1), told("misformed.test", 1)) == ("", X.SHORTER, X.REFORM)


def test_a_run_that_was_killed_goes_on(spark, settings, tmp_path, monkeypatch):
    """The answers of the second wave's round are committed, and then the driver is lost: nobody is asked twice."""
    s = Settings(vocabulary=settings.vocabulary, max_pages_per_domain=1, max_llm_requests_per_domain=1)
    for k in ("calls", "tables"):
        (tmp_path / k).mkdir()
    names, path = ["sound.test", "waits.test", "misformed.test"], str(tmp_path / "out.json")
    run = lambda run_id: R.run(spark, names, s, path, home(spark), partial(ByTurn, str(tmp_path / "calls")), "live", run_id=run_id, wave=2, root=f"file://{tmp_path}/tables")
    enrich, n = R.E.enrich, []

    def dies(*a, **k):
        n.append(1)
        if len(n) == 2:
            raise KeyboardInterrupt
        return enrich(*a, **k)

    monkeypatch.setattr(R.E, "enrich", dies)
    with pytest.raises(KeyboardInterrupt) as e:
        run("7")
    assert "run_id='7'" in e.value.__notes__[0]
    saved = json.loads((tmp_path / "out.json").read_text())
    assert not saved["complete"] and [r["input_domain"] for r in saved["results"]] == names[:2]
    monkeypatch.setattr(R.E, "enrich", enrich)
    head, results = run("7")
    assert head["complete"] and [r.input_domain for r in results.orderBy("ord").collect()] == names
    assert sorted(os.listdir(tmp_path / "calls")) == sorted(f"{x}-0" for x in names)
    saved = json.loads((tmp_path / "out.json").read_text())
    assert saved["complete"] and [r["input_domain"] for r in saved["results"]] == names


def test_committed_batches_are_not_made_again(spark, tmp_path):
    c, made = Commits(spark, "b", f"file://{tmp_path}"), []

    def make(t):
        made.append(sorted(r.id for r in t.collect()))
        if len(made) == 3:
            raise OSError("lost")
        return t.selectExpr("id", "id * 2 as twice")

    todo = spark.range(40)
    with pytest.raises(OSError):
        c.work("x", todo, ["id"], make, "id long, twice long", 4)
    # What a lost writer leaves has no mark.
    spark.range(40).selectExpr("id", "0L as twice").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"file://{tmp_path}/run-b/x/batch-half")
    got = c.work("x", todo, ["id"], make, "id long, twice long", 4)
    assert sorted((r.id, r.twice) for r in got.collect()) == [(i, 2 * i) for i in range(40)]
    assert sorted(i for k, x in enumerate(made) if k != 2 for i in x) == list(range(40))
    assert c.work("x", todo, ["id"], lambda t: t.selectExpr("id", "0L as twice"), "id long, twice long").where("twice <> 2 * id").isEmpty()


PAGES = {"https://quillmoor.test/": R.HOME, "https://quillmoor.test/team": R.HOME, "https://gone.test/": (404, "")}


class AnyName(PublicNames):
    def __contains__(self, host):
        return True


def crashing(url, seconds):
    if "crash" in url:
        raise RuntimeError("secret text")
    status, html = (200, PAGES[url]) if isinstance(PAGES.get(url), str) else (404, "")
    return Answer(status, {}, html.encode())


#: Answers by domain: first, and to a repair.
TURNS = {
    "mended.test": (UNSOUND, SOUND),
    "stubborn.test": (UNSOUND, UNSOUND),
    "refusing.test": (UNSOUND, Reply(None, "m", problem="refusal")),
    "quillmoor.test": (ProviderFailure("authentication_or_permission"), None),
}


class ByDomain:
    def request(self, context, repair, seconds):
        turn = TURNS[context.split("\n")[0].split(": ")[1]][bool(repair)]
        if isinstance(turn, Exception):
            raise turn
        return turn


def test_batch(spark, settings):
    names = ["quillmoor.test", "crash.test", "not a domain", "gone.test", "Quillmoor.test"]
    fetch = over_http(settings, crashing, AnyName, "playwright", live=False)
    head, results = R.run(spark, names, settings, None, fetch, partial(FixtureProvider, GOOD), "live")
    rows = results.orderBy("ord").collect()
    assert [r.input_domain for r in rows] == names and [r.status for r in rows] == ["success", "failed", "failed", "failed", "success"]
    one = rows[0]
    assert one.company_overview.count(".") == 2 and one.crawl.attempted_pages == 3 and one.crawl.duplicate_pages == 1
    assert [(p.name, p.role) for p in one.team_members] == [("Ida Brandt", "founder")] and one.team_members[0].role_evidence[0].source_url == "https://quillmoor.test/"
    assert [c.email for c in one.contact_points] == ["post@quillmoor.test"] and set(one.field_evidence) == {"company_name", "company_overview", "target_audience"}
    assert one.crawl.duration_seconds > 0 and rows[2].crawl.duration_seconds == 0
    # A host is crawled once, whoever names it.
    assert one.sources == rows[4].sources
    assert {e.code for e in rows[1].errors} == {"no_usable_pages", "unexpected_error"} and "secret" not in str(rows[1])
    assert [e.code for e in rows[2].errors] == ["invalid_domain"] and rows[2].confidence_score == 0
    assert {e.code for e in rows[3].errors} == {"http_404", "no_usable_pages"}
    assert head["complete"] and audit.audit(results).isEmpty()


def test_one_repair_and_one_page(spark, settings):
    one = Settings(vocabulary=settings.vocabulary, max_pages_per_domain=1)
    _, results = R.run(spark, list(TURNS), one, None, home(spark), ByDomain, "live")
    rows = {r.input_domain: r for r in results.collect()}
    told = {k: (r.status, [e.code for e in r.errors], r.usage.request_count, r.company_name, r.team_members[0].role if r.team_members else None) for k, r in rows.items()}
    assert told == {
        "mended.test": ("success", [], 2, "Quillmoor", "founder"),
        "stubborn.test": ("partial", ["unsupported_extraction"], 2, "Quillmoor", None),
        "refusing.test": ("partial", ["refusal"], 2, "Quillmoor", None),
        "quillmoor.test": ("partial", ["authentication_or_permission"], 1, None, None),
    }
    # Addresses survive a provider that fails.
    assert [c.email for c in rows["quillmoor.test"].contact_points] == ["post@quillmoor.test"] and not rows["quillmoor.test"].usage.accounting_complete
    assert all(len(r.sources) == 1 for r in rows.values())


def hit(url, title, content):
    return {"url": url, "title": title, "content": content}


def answered(status, *results):
    return lambda url, seconds, headers, method, body: Answer(status, {}, json.dumps({"results": list(results)}).encode())


def test_search(spark, settings):
    s = Settings(vocabulary=settings.vocabulary, max_pages_per_domain=1, enable_search=True, tavily_api_key="k")
    told = answered(200, hit("https://linkedin.com/in/ida/", "Ida Brandt - Quillmoor", "x"), hit("https://www.linkedin.com/in/other", "Other person", "elsewhere"), hit("https://linkedin.com/in/z", "", "Ida Brandt Quillmoor"))
    run = lambda s, send: R.run(spark, ["quillmoor.test"], s, None, home(spark), partial(FixtureProvider, GOOD), "live", search_send=send)[1].first()
    r = run(s, told)
    assert [x.kind for x in r.sources] == ["first_party_html", "search_snippet", "search_snippet"] and r.search_requests == 1
    p = r.team_members[0]
    assert (p.linkedin_status, [c.url for c in p.linkedin_candidates]) == ("search_candidate", ["https://www.linkedin.com/in/ida"])
    r = run(s, answered(401))
    assert r.status == "success" and [w for w in r.warnings if "Tavily" in w] and len(r.sources) == 1
    targets = spark.createDataFrame([(0, 0, "Ida", "Q", 9.0)], "ord int, item int, name string, company string, left double")
    (row,) = searched(targets, Settings(enable_search=True)).collect()
    assert row.hit is None and "TAVILY_API_KEY" in row.warning


def test_demo_file_and_command_line(spark, vocabulary, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    path = str(tmp_path / "a" / "demo.json")
    assert cli.main(["demo", "--output", path, "--vocabulary", vocabulary]) == 0
    assert cli.main(["validate-output", path]) == 0 and "Valid demo output: 1 result(s), complete=True" in capsys.readouterr().out
    assert cli.main(["validate-output", path, "--require-domains", "quillmoor.test"]) == 2
    head, results = runs.load(spark, path)
    r = results.first()
    assert (r.status, r.confidence_score, r.usage.cost_reason) == ("success", 0.9, "Pricing absent or does not match configured model") and "FIXTURE" in head["warnings"][0].upper()
    assert cli.main(["demo", "--output", str(tmp_path / "output.json"), "--vocabulary", vocabulary]) == 2
    data = json.loads((tmp_path / "a" / "demo.json").read_text())

    def broken(change):
        other = json.loads(json.dumps(data))
        change(other, other["results"][0])
        (tmp_path / "x.json").write_text(json.dumps(other))
        with pytest.raises(ValueError):
            runs.load(spark, str(tmp_path / "x.json"))

    broken(lambda d, r: r["field_evidence"]["company_name"][0].update(excerpt="Invented"))
    broken(lambda d, r: r["usage"].update(cached_input_tokens=1))
    broken(lambda d, r: d.update(mode="live"))
    broken(lambda d, r: d.update(extra=1))

    def told(change):
        other = json.loads(json.dumps(data))
        change(other, other["results"][0])
        return json.dumps(other)

    row = "run.results[]"
    forms = [
        (told(lambda d, r: None), set()),
        (told(lambda d, r: d.update(extra=1)), {("run", "unknown")}),
        (told(lambda d, r: r.update(extra=1)), {(row, "unknown")}),
        (told(lambda d, r: r.update(status="fine")), {(f"{row}.status", "value")}),
        (told(lambda d, r: r.pop("warnings")), {(f"{row}.warnings", "missing")}),
        (told(lambda d, r: r.update(confidence_score=float("nan"))), {("run", "json")}),
        (told(lambda d, r: r.update(confidence_score=1.5)), {(f"{row}.confidence_score", "value")}),
        (told(lambda d, r: d.update(warnings=None, finished_at=None)), {("run.warnings", "null")}),
        (told(lambda d, r: d.update(started_at="2026-01-01 00:00")), {("run.started_at", "value")}),
        (told(lambda d, r: r["sources"][0]["links"][0].update(url=5, y=1)), {(f"{row}.sources[].links[].url", "kind"), (f"{row}.sources[].links[]", "unknown")}),
        (told(lambda d, r: r["crawl"].update(attempted_pages=1.5, usable_pages=-1)), {(f"{row}.crawl.attempted_pages", "kind"), (f"{row}.crawl.usable_pages", "value")}),
        (told(lambda d, r: r["field_evidence"].update(other=[{}])), {(f"{row}.field_evidence[][].{k}", "missing") for k in ("source_id", "excerpt", "source_url")}),
        ("[1", {("run", "json")}),
        ("[]", {("run", "kind")}),
    ]
    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(forms)], "id int, text string")
    found = {}
    for x in runs.misfits(texts).collect():
        found.setdefault(x.id, set()).add((x["at"], x.rule))
    assert [found.get(i, set()) for i in range(len(forms))] == [w for _, w in forms]
    data["mode"] = "live"
    (tmp_path / "live.json").write_text(json.dumps(data))
    with pytest.raises(runs.PersistenceError):
        runs.ensure_destination(str(tmp_path / "live.json"), "demo")
    assert [p.name for p in (tmp_path / "a").iterdir()] == ["demo.json"]


def test_command_line_errors(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    for name in ("OPENAI_API_KEY", "GEMINI_API_KEY"):
        monkeypatch.delenv(name, raising=False)
    (tmp_path / "in.json").write_text("﻿[1]", encoding="utf-8")
    assert cli.main(["run", "--input", str(tmp_path / "in.json")]) == 2
    assert cli.main(["run", "--domains", "a.test"]) == 2 and "openai_api_key" in capsys.readouterr().err
    assert cli.main(["run", "--domains", "a.test", "--max-pages", "99"]) == 2
    with pytest.raises(SystemExit):
        cli.main(["run", "--domains", "a.test", "--input", "x"])
    assert cli.main(["doctor", "--output-dir", str(tmp_path / "out")]) == 2


def test_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# keys\nOPENAI_API_KEY='abc'\nMAX_DEPTH=3\nMAX_PAGES_PER_DOMAIN=\nHEADED=true\n")
    monkeypatch.setenv("MAX_DEPTH", "4")
    s = Settings.load(str(tmp_path / ".env"), domain_concurrency=5)
    assert (s.openai_api_key, s.max_depth, s.max_pages_per_domain, s.headed, s.domain_concurrency) == ("abc", 4, 8, True, 5)
    assert "abc" not in repr(s) and "openai_api_key" not in s.redacted()
    for bad in ({"max_depth": 9}, {"render_wait_ms": 40_000}, {"input_price_per_million": 1.0}, {"gemini_model": "x"}, {"llm_provider": "x"}, {"domain_budget_seconds": float("inf")}):
        with pytest.raises(SettingError):
            Settings(**bad)


def test_domain_files_and_checkpoints(spark, tmp_path):
    (tmp_path / "d.json").write_text('﻿["Münch.test", "a.test"]', encoding="utf-8")
    assert [tuple(r) for r in D.from_file(spark, str(tmp_path / "d.json")).orderBy("ord").collect()] == [(0, "Münch.test", "xn--mnch-0ra.test"), (1, "a.test", "a.test")]
    odd = {"bücher.de?x=ä": "xn--bcher-kva.de", "https://bücher.de/a//b": "xn--bcher-kva.de", "bücher.de:443": "xn--bcher-kva.de", "//Bücher.de#ü": "xn--bcher-kva.de", "a.de/ü": "a.de", "https://u@bücher.de/": None, "bücher.de:8443": None, "ü..de": None, "bücher": None}
    assert {r.input_domain: r.normalized_domain for r in D.inline(spark, list(odd)).collect()} == odd
    for bad in ("[]", "{}", '["a", 1]', "x"):
        (tmp_path / "b.json").write_text(bad)
        with pytest.raises(ValueError):
            D.from_file(spark, str(tmp_path / "b.json"))
    rows = lambda *o: spark.createDataFrame([(i,) for i in o], "ord int")
    path = str(tmp_path / "run")
    D.write_run(rows(0), path, "live", "r", "0")
    D.write_run(rows(1), path, "live", "r", "1")
    D.write_run(rows(1), path, "live", "r", "1")
    D.write_run(rows(7), path, "demo", "r")
    assert sorted(r.ord for r in D.read_run(spark, path, "live", "r").collect()) == [0, 1]


def test_required_results(spark, settings):
    _, results = R.run(spark, ["quillmoor.test"], settings, None, home(spark, PAGES, None), Sound, "live")
    want = lambda *d: D.inline(spark, list(d))
    run = spark.createDataFrame([("live", True)], "mode string, complete boolean")
    rules = lambda r, run, d: {x.rule for x in audit.live(r, run).unionByName(audit.required(r, d)).collect()}
    assert rules(results, run, want("quillmoor.test")) == set()
    assert rules(results, spark.createDataFrame([("live", False)], "mode string, complete boolean"), want("quillmoor.test")) == {"live_complete"}
    assert rules(results, run, want("other.test")) == {"required_missing", "not_required"}
    assert rules(results, run, want("quillmoor.test", "https://quillmoor.test/x")) == {"required_distinct"}
    assert rules(results.union(results), run, want("quillmoor.test")) == {"result_repeated"}
    assert rules(results.withColumn("input_domain", F.lit("x.test")), run, want("quillmoor.test")) == {"normalized"}
    assert rules(results.withColumn("status", F.lit("partial")), run, want("quillmoor.test")) == {"all_success"}
    assert rules(results.withColumn("usage", F.col("usage").withField("response_ids", F.array().cast("array<string>"))), run, want("quillmoor.test")) == {"usage_recorded"}
    http = F.transform("sources", lambda s: s.withField("retrieval_method", F.lit("http_fallback")))
    assert rules(results.withColumn("sources", http), run, want("quillmoor.test")) == {"browser_source"}
