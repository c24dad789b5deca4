"""Runs as one JSON file: {schema_version, run_id, mode, started_at, finished_at, model, configuration, results, complete, warnings}."""

from __future__ import annotations

import json
import os
import re
import tempfile
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as K

from evidra.operators import audit
from evidra.plans.enrich import RESULT
from evidra.schema import CATEGORIES, Misfit
from evidra.sources import strict

HEAD = "schema_version string, run_id string, mode string, started_at timestamp, finished_at timestamp, model string, complete boolean, warnings array<string>"
# What members of a result may hold.
ALLOWED = {
    "run.schema_version": ("1.0",),
    "run.mode": ("live", "demo"),
    "run.results.status": ("success", "partial", "failed"),
    "run.results.contact_points.category": CATEGORIES,
    "run.results.contact_points.verification_status": ("publicly_observed_not_deliverability_verified",),
    "run.results.team_members.linkedin_status": ("first_party_link", "search_candidate", "not_found"),
    "run.results.team_members.linkedin_candidates.status": ("search_candidate",),
    "run.results.sources.kind": ("first_party_html", "search_snippet"),
    "run.results.sources.retrieval_method": ("playwright", "http_fallback", "tavily", "fixture"),
}
NULLABLE = {
    "run.finished_at",
    "run.results.normalized_domain", "run.results.company_name", "run.results.company_overview", "run.results.target_audience", "run.results.team_members.role", "run.results.team_members.linkedin_url", "run.results.sources.retrieved_at", "run.results.sources.http_status",
    "run.results.sources.search_query", "run.results.usage.estimated_llm_cost_usd", "run.results.estimated_search_cost_usd", "run.results.errors.source_id", "run.results.crawl.duration_seconds",
}



#: A run, as places of a closed schema; its configuration may hold anything.
ROOT, ROW = "run", "run.results[]"


def _places() -> list[tuple]:
    row = K.StructType([f for f in K._parse_datatype_string(_ddl()).fields if f.name != "ord"])
    head = [*K._parse_datatype_string(HEAD).fields, K.StructField("configuration", K.BinaryType()), K.StructField("results", K.ArrayType(row))]
    return strict.places(K.StructType(head), ROOT, NULLABLE, ALLOWED)


def misfits(texts: DataFrame, root: str = ROOT) -> DataFrame:
    """strict.misfits() of runs as JSON (id, text), or of results; and cached tokens of more than all input."""
    rows = _places()
    depth = max(r[-1] for r in rows)
    return strict.misfits(texts, strict.table(texts.sparkSession, rows), depth, root)


def overcounted(results: DataFrame) -> DataFrame:
    return results.where(F.col("usage.cached_input_tokens") > F.col("usage.input_tokens"))


def _or_raise(found: DataFrame) -> None:
    if worst := found.orderBy("id", "at", "rule").first():
        raise Misfit(f"{worst['at'].replace('[]', '')} ({worst['rule']})")


class PersistenceError(Exception):
    pass


def ensure_destination(path: str, mode: str) -> None:
    """Raises where a demo would be written as output.json or over a live run."""
    if mode != "demo":
        return
    if os.path.basename(path).casefold() == "output.json":
        raise PersistenceError("output.json is kept for live runs")
    if os.path.isfile(path):
        try:
            with open(path, encoding="utf-8") as f:
                old = json.load(f)
        except ValueError:
            return
        if isinstance(old, dict) and old.get("mode") == "live":
            raise PersistenceError("a demo does not replace a live run")


def _ddl() -> str:
    return ", ".join(f"{k} {v}" for k, v in RESULT.items())


def _stamp(x: datetime | None) -> str | None:
    return None if x is None else x.isoformat()


def save(head: dict, results: DataFrame, path: str) -> None:
    """Audits a run and writes it on the driver, results by ord; the file appears whole or not at all."""
    ensure_destination(path, head["mode"])
    spark = results.sparkSession
    told = head | {k: _stamp(head[k]) for k in ("started_at", "finished_at")}
    temporary = None
    try:
        of_run = spark.createDataFrame([tuple(head[x.split()[0]] for x in HEAD.split(", "))], HEAD)
        audit.required_or_raise(audit.audit(results).unionByName(audit.run_rules(of_run, results)))
        if not overcounted(results).isEmpty():
            raise Misfit("run.results.usage.cached_input_tokens")
        some = not results.isEmpty()
        form = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timeZone": "UTC"}
        texts = results.select("ord", F.to_json(F.struct(*(c for c in results.columns if c != "ord")), form).alias("j"))
        if some:
            _or_raise(misfits(texts.select(F.col("ord").alias("id"), F.col("j").alias("text")), ROW))
        lines = texts.orderBy("ord").select("j").toLocalIterator()
        folder = os.path.dirname(os.path.abspath(path))
        os.makedirs(folder, exist_ok=True)
        handle, temporary = tempfile.mkstemp(dir=folder, prefix=f".{os.path.basename(path)}.", suffix=".tmp")
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            first = {k: told[k] for k in ("schema_version", "run_id", "mode", "started_at", "finished_at", "model", "configuration", "complete", "warnings")}
            f.write(json.dumps(first, ensure_ascii=False, indent=2, allow_nan=False).removesuffix("\n}") + ',\n  "results": [')
            for i, line in enumerate(lines):
                r = json.loads(line.j)
                text = json.dumps(r, ensure_ascii=False, indent=2, allow_nan=False).replace("\n", "\n    ")
                f.write((",\n    " if i else "\n    ") + text)
            f.write("\n  ]\n}\n")
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except (OSError, ValueError) as e:
        raise PersistenceError(f"the run cannot be checked or written: {e}") from e
    finally:
        if temporary and os.path.exists(temporary):
            os.unlink(temporary)


def load(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(head, results) of a saved run, checked in form and audited; whatever does not hold raises a ValueError. Only the head comes to the driver."""
    uri = path if re.match(r"^[a-z][a-z0-9+.-]*:", path) else f"file://{os.path.abspath(path)}"
    text = spark.read.text(uri, wholetext=True).select(F.lit(0).alias("id"), F.col("value").alias("text"))
    _or_raise(misfits(text))
    inner = ", ".join(f"{k} {v}" for k, v in RESULT.items() if k != "ord")
    # The values of ord in a file are their places.
    results = text.select(F.posexplode(F.from_json("text", f"results array<struct<{inner.replace(' ', ':')}>>".replace(",:", ","), {"mode": "FAILFAST"})["results"]).alias("ord", "r")).select("ord", "r.*")
    if not overcounted(results).isEmpty():
        raise Misfit("run.results.usage.cached_input_tokens")
    of_run = text.select(F.from_json("text", HEAD, {"mode": "FAILFAST"}).alias("h")).select("h.*")
    audit.required_or_raise(audit.audit(results).unionByName(audit.run_rules(of_run, results)))
    told = text.select(F.from_json("text", HEAD.replace("timestamp", "string")).alias("h"), F.get_json_object("text", "$.configuration").alias("c")).first()
    return told.h.asDict() | {"configuration": json.loads(told.c)}, results
