"""A search for public profiles of people whom pages name without one."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.connectors.http import send as send_request
from evidra.connectors.providers import at, objects
from evidra.operators import queue

URL = "https://api.tavily.com/search"
# What a result is told where a search fails, or has no key.
FAILED = "Optional Tavily search failed or exceeded its budget; existing facts retained"
NO_KEY = "Search requested but TAVILY_API_KEY missing; search skipped"
HITS = "ord int, item int, hit int, query string, url string, title string, content string, warning string"


def search_once(name: str, company: str, key: str, seconds: float, send=send_request) -> tuple[str, list[dict]]:
    """(query, hits) for a person, at most three; an answer of another form raises."""
    query = f'site:linkedin.com/in/ "{name}" "{company}"'
    body = {"query": query, "max_results": 3, "search_depth": "basic", "include_answer": False, "include_raw_content": False, "include_images": False, "auto_parameters": False}
    a = send(URL, seconds, {"Authorization": f"Bearer {key}", "Content-Type": "application/json"}, "POST", json.dumps(body, ensure_ascii=False).encode())
    found = at(json.loads(a.body), "results") if a.status == 200 else None
    if not isinstance(found, list):
        raise ValueError("no answer to a search")
    return query, [x for x in objects(found[:3]) if all(isinstance(x.get(k), str) for k in ("url", "title", "content"))]


def searched(targets: DataFrame, settings, send: Callable = send_request) -> DataFrame:
    """HITS for targets (ord, item, name, company, left): rows without a hit number tell of a request, and rows with a warning why an ord's search ended.

    left: seconds that the domain's time still has. Whatever goes wrong ends the search of that ord alone.
    """
    if not settings.tavily_api_key:
        return targets.select("ord", "item", *(F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in HITS.split(", ")[2:-1])), F.lit(NO_KEY).alias("warning"))
    schema = pa.schema([(n, pa.int32() if t == "int" else pa.string()) for n, t in (x.split() for x in HITS.split(", "))])

    def run(batches):
        ended, used = set(), {}
        for b in batches:
            for r in b.to_pylist():
                o = {"ord": r["ord"], "item": r["item"]}
                if r["ord"] in ended:
                    continue
                rows, began = [o], time.monotonic()
                left = r["left"] - used.get(r["ord"], 0.0)
                try:
                    if left < queue.LEAST:
                        raise TimeoutError
                    query, hits = search_once(r["name"], r["company"], settings.tavily_api_key, min(left, settings.http_timeout_seconds), send)
                    rows += [o | {"hit": i, "query": query, **{k: h[k] for k in ("url", "title", "content")}} for i, h in enumerate(hits, 1)]
                except Exception:
                    ended.add(r["ord"])
                    rows.append(o | {"warning": FAILED})
                used[r["ord"]] = used.get(r["ord"], 0.0) + time.monotonic() - began
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    tasks = max(settings.domain_concurrency, int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return targets.select("ord", "item", "name", "company", "left").repartition(tasks, "ord").sortWithinPartitions("ord", "item").mapInArrow(run, HITS)
