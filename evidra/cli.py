"""Command line: run, demo, validate-output and doctor. Exit codes: 0 and 1 by results, 2 for what cannot be run, 130 when interrupted."""

from __future__ import annotations

import argparse
import importlib.metadata
import json
import os
import sys
import tempfile

from evidra.schema import Misfit
from evidra.settings import SettingError, Settings


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="evidra", description="evidence-backed company records from public pages")
    commands = p.add_subparsers(dest="command", required=True)
    c = commands.add_parser("run", help="crawl domains and extract what their pages prove")
    which = c.add_mutually_exclusive_group(required=True)
    which.add_argument("--domains", nargs="+")
    which.add_argument("--input", help="a JSON array of strings")
    c.add_argument("--output", default="output.json")
    c.add_argument("--max-pages", type=int, dest="max_pages_per_domain")
    c.add_argument("--concurrency", type=int, dest="domain_concurrency")
    c.add_argument("--headed", action="store_true", default=None)
    c.add_argument("--search", action="store_true", default=None, dest="enable_search")
    c.add_argument("--strict", action="store_true")
    c.add_argument("--resume", metavar="RUN_ID", help="a run that did not come to its end; the same domains")
    c = commands.add_parser("demo", help="one made-up company without network")
    c.add_argument("--output", default="artifacts/demo_output.json")
    c.add_argument("--vocabulary", default="", help="a .tiktoken file; by default the setting")
    c = commands.add_parser("validate-output", help="check a saved run")
    c.add_argument("path")
    c.add_argument("--require-domains", nargs="+")
    c = commands.add_parser("doctor", help="check the installation; asks no provider")
    c.add_argument("--output-dir", default="artifacts")
    return p


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("evidra").config("spark.sql.session.timeZone", "UTC").config("spark.speculation", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def domains_of(path: str) -> list[str]:
    with open(path, encoding="utf-8-sig") as f:
        told = json.load(f)
    if not isinstance(told, list) or not told or not all(isinstance(x, str) for x in told):
        raise ValueError("the input must be a non-empty JSON array of strings")
    return told


def code(results, strict: bool = False) -> int:
    from evidra.operators import scoring

    return scoring.exit_code(results, strict).first()[0]


def doctor(settings: Settings, folder: str) -> int:
    told: dict = {"python": sys.version.split()[0]}
    for package in ("pyspark", "pyarrow", "tiktoken", "playwright"):
        try:
            told[package] = importlib.metadata.version(package)
        except importlib.metadata.PackageNotFoundError:
            told[package] = None
    told |= {"llm_provider": settings.llm_provider, "model": settings.model_name, "selected_key_present": bool(settings.api_key.strip()), "optional_search_enabled": settings.enable_search}
    told |= {f"{k}_present": bool(getattr(settings, f"{k}_api_key")) for k in ("openai", "gemini", "tavily")}
    try:
        os.makedirs(folder, exist_ok=True)
        with tempfile.TemporaryFile(dir=folder):
            told["output_writable"] = True
    except OSError:
        told["output_writable"] = False
    try:
        from playwright.sync_api import sync_playwright

        with sync_playwright() as p:
            p.chromium.launch(headless=not settings.headed).close()
            told["chromium_launch"] = True
    except Exception:
        told["chromium_launch"] = False
    print(json.dumps(told, indent=2))
    return 0 if told["selected_key_present"] and told["output_writable"] and told["chromium_launch"] else 2


def validate(path: str, required: list[str] | None) -> int:
    from evidra.operators import audit
    from evidra.sources import domains, runs

    spark = session()
    head, results = runs.load(spark, path)
    if required:
        run = spark.createDataFrame([(head["mode"], head["complete"])], "mode string, complete boolean")
        audit.required_or_raise(audit.live(results, run).unionByName(audit.required(results, domains.inline(spark, required))))
    print(f"Valid {head['mode']} output: {results.count()} result(s), complete={head['complete']}")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    try:
        if args.command == "validate-output":
            return validate(args.path, args.require_domains)
        if args.command == "demo":
            from evidra.plans import run

            _, results = run.demo(session(), args.output, args.vocabulary or Settings.load().vocabulary)
            print(f"Synthetic DEMO saved to {args.output}")
            return code(results)
        given = {k: getattr(args, k, None) for k in ("max_pages_per_domain", "domain_concurrency", "headed", "enable_search")}
        settings = Settings.load(**given)
        if args.command == "doctor":
            return doctor(settings, args.output_dir)
        told = args.domains or domains_of(args.input)
        settings.require_live_key()
        from evidra.plans import run

        _, results = run.enrich(told, settings=settings, output=args.output, spark=session(), run_id=args.resume)
        print(f"Saved {results.count()} results to {args.output}")
        return code(results, args.strict)
    except KeyboardInterrupt:
        print("Interrupted; the output says what was complete", file=sys.stderr)
        return 130
    except (SettingError, Misfit) as e:
        # Names only: a value may be a secret.
        print(f"Invalid configuration/output fields: {e}", file=sys.stderr)
        return 2
    except Exception as e:
        from evidra.sources.runs import PersistenceError

        plain = isinstance(e, (ValueError, OSError, PersistenceError))
        print(f"Configuration/output error: {e}" if plain else f"Setup failure: {type(e).__name__}; run doctor for diagnostics", file=sys.stderr)
        return 2
