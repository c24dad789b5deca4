"""From domains, their pages and what a provider extracted to results.

sources() parses every page once and extractions come from outside: write both, as enrich() reads them several times. All joins
are by ord, the number of a domain, so every step spreads over domains. A result is one row with its sources, evidence, errors,
usage and score, as the audit and the exported file have it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.operators import frontier, grounding, html, scoring

ERROR = "struct<stage:string,code:string,message:string,retryable:boolean,source_id:string,material:boolean>"
LINK = "struct<url:string,text:string,nearby_text:string>"
SOURCE = f"struct<source_id:string,requested_url:string,final_url:string,kind:string,retrieval_method:string,retrieved_at:timestamp,http_status:int,usable:boolean,selection_reason:string,depth:int,html_bytes:bigint,cleaned_text_chars:bigint,text:string,links:array<{LINK}>,email_candidates:array<string>,search_query:string,title:string>"
USAGE = "struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint,request_count:bigint,reported_response_count:bigint,response_ids:array<string>,request_ids:array<string>,models:array<string>,accounting_complete:boolean,estimated_llm_cost_usd:double,cost_reason:string,cost_scope:string>"
CRAWL = "struct<attempted_pages:bigint,usable_pages:bigint,duplicate_pages:bigint,html_bytes:bigint,cleaned_text_chars:bigint,estimated_context_tokens:bigint,estimated_request_tokens:bigint,dropped_chunks:bigint,duration_seconds:double>"
PERSON = f"struct<name:string,role:string,linkedin_url:string,linkedin_status:string,relationship_evidence:{grounding.EVIDENCE},role_evidence:{grounding.EVIDENCE},profile_evidence:{grounding.EVIDENCE},linkedin_candidates:array<struct<url:string,evidence:{grounding.EVIDENCE},status:string>>>"
CONTACT = f"struct<email:string,category:string,evidence:{grounding.EVIDENCE},verification_status:string>"
BREAKDOWN = "struct<" + ",".join(f"{k}:double" for k in scoring.WEIGHTS) + ",explanation:string>"
REPLIES = "ord int, input_tokens bigint, cached_input_tokens bigint, output_tokens bigint, request_count bigint, reported_response_count bigint, response_ids array<string>, request_ids array<string>, models array<string>, accounting_complete boolean"
#: A result, as it is exported; ord is its place.
RESULT = {
    "ord": "int",
    "input_domain": "string",
    "normalized_domain": "string",
    "status": "string",
    "company_name": "string",
    "company_overview": "string",
    "target_audience": "string",
    "contact_points": f"array<{CONTACT}>",
    "team_members": f"array<{PERSON}>",
    "confidence_score": "double",
    "confidence_breakdown": BREAKDOWN,
    "field_evidence": f"map<string,{grounding.EVIDENCE}>",
    "sources": f"array<{SOURCE}>",
    "crawl": CRAWL,
    "usage": USAGE,
    "search_requests": "bigint",
    "estimated_search_cost_usd": "double",
    "warnings": "array<string>",
    "errors": f"array<{ERROR}>",
}


def _with(df: DataFrame, **defaults: Column) -> DataFrame:
    return df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})


def sources(domains: DataFrame, pages: DataFrame, kept: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """pages (ord, source_id, page_no, final_url, http_status, depth, priority, html), cleaned for their domain.

    Adds problem, material and duplicate; a page with a problem, its own or one met in fetching it (failure, retryable), is not usable.
    A repeated text is usable but marked: it counts as fetched and is not quoted. Pages of unknown domains are left out. kept: writes
    the cleaned pages and reads them, so that none is parsed twice.
    """
    met = pages.join(domains.select("ord", F.col("normalized_domain").alias("__host")), "ord")
    met = _with(met, failure=F.lit(None).cast("string"), retryable=F.lit(False), requested_url=F.col("final_url"), selection_reason=F.lit(""), retrieval_method=F.lit("playwright"), retrieved_at=F.lit(None).cast("timestamp"))
    s = html.clean(met, "final_url", "html", F.col("__host"), F.col("http_status")).drop("html", "__host")
    s = s.withColumn("problem", F.coalesce("failure", "problem")).withColumn("usable", F.col("usable") & F.col("problem").isNull()).drop("failure")
    s = s.withColumn("material", F.coalesce(F.col("problem").isNotNull() & scoring.material(F.col("depth"), F.col("priority"), F.col("problem")), F.lit(False)))
    s = s.withColumn("kind", F.lit("first_party_html")).withColumn("search_query", F.lit(None).cast("string"))
    # What a page with a problem says is no evidence, so it keeps no text.
    for name, empty in (("text", F.lit("")), ("links", F.array().cast(f"array<{LINK}>")), ("email_candidates", F.array().cast("array<string>")), ("cleaned_text_chars", F.lit(0).cast("long")), ("html_bytes", F.lit(0).cast("long"))):
        s = s.withColumn(name, F.when(F.col("problem").isNull(), F.col(name)).otherwise(empty))
    s = kept(s) if kept else s
    s = frontier.distinct_texts(s.withColumn("__by", F.struct("ord", F.col("problem").isNull().alias("fetched"))), "__by", "page_no", "text").drop("__by")
    return s.withColumn("duplicate", F.col("duplicate") & F.col("problem").isNull())


def quotable(found: DataFrame) -> DataFrame:
    """The sources that extraction and grounding see."""
    return found.where("problem is null and not duplicate")


def page_errors(found: DataFrame) -> DataFrame:
    """(ord, place, error)."""
    message = F.concat(F.lit("Page retrieval: "), F.col("problem"))
    error = F.struct(F.lit("crawl").alias("stage"), F.col("problem").alias("code"), message.alias("message"), F.coalesce("retryable", F.lit(False)).alias("retryable"), "source_id", "material")
    return found.where("problem is not null").select("ord", F.struct(F.lit(0).alias("section"), F.col("page_no").cast("int").alias("n")).alias("place"), error.cast(ERROR).alias("error"))


def _error(df: DataFrame, section: int, stage: str, code: Column, message: Column, retryable: Column | None = None) -> DataFrame:
    e = F.struct(F.lit(stage).alias("stage"), code.alias("code"), message.alias("message"), (F.lit(False) if retryable is None else retryable).alias("retryable"), F.lit(None).cast("string").alias("source_id"), F.lit(True).alias("material"))
    return df.select("ord", F.struct(F.lit(section).alias("section"), F.lit(0).alias("n")).alias("place"), e.cast(ERROR).alias("error"))


def enrich(domains: DataFrame, found: DataFrame, grounded: DataFrame, replies: DataFrame | None = None, contexts: DataFrame | None = None, failures: DataFrame | None = None, search: dict[str, DataFrame] | None = None, pricing: dict | None = None, durations: DataFrame | None = None) -> DataFrame:
    """One row for each domain, with the columns of RESULT.

    domains: ord, input_domain, normalized_domain. found: as sources() gives them. grounded: as grounding.ground() gives it, with
    completed. replies: one row a request, as scoring.usage() takes them. contexts: ord, context_tokens, request_tokens,
    dropped_chunks. failures: ord, stage, code, message, retryable. search: tables snippets, candidates, requests (ord, n), warnings (ord,
    warning). pricing: model, pricing_model and rates. durations (ord, duration_seconds): what crawls took; without
    it that is null, and a domain that was not crawled took none. A domain that is none fails without a score; one without usable pages
    keeps the addresses that its pages show.
    """
    spark = domains.sparkSession
    empty = lambda ddl: spark.createDataFrame([], ddl)
    own = F.struct(F.lit(0).alias("section"), F.col("page_no").cast("int").alias("n"))
    shaped = [F.col(k.split(":")[0]) for k in _names(SOURCE)]
    listed = found.select("ord", own.alias("place"), F.struct(*shaped).cast(SOURCE).alias("s"))
    if search:
        snip = _with(search["snippets"], retrieved_at=F.lit(None).cast("timestamp"), http_status=F.lit(None).cast("int"), selection_reason=F.lit("Observed leader missing direct profile"), depth=F.lit(0), html_bytes=F.lit(0).cast("long"), links=F.array().cast(f"array<{LINK}>"), email_candidates=F.array().cast("array<string>"))
        at = F.struct(F.lit(1).alias("section"), F.regexp_extract("source_id", r"(\d+)$", 1).cast("int").alias("n"))
        listed = listed.unionByName(snip.select("ord", at.alias("place"), F.struct(*shaped).cast(SOURCE).alias("s")))
    pages = listed.groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col("s.source_id").alias("id"), F.struct("s").alias("x")))), lambda v: v["x"]["s"]).alias("sources"))
    own_page = F.col("kind") == "first_party_html"
    crawl = found.groupBy("ord").agg(F.count_if(F.col("duplicate")).alias("duplicate_pages"), F.sum("html_bytes").alias("html_bytes"), F.sum("cleaned_text_chars").alias("cleaned_text_chars"), F.count_if(F.col("problem").isNull()).alias("n_fetched"), F.count_if(own_page).alias("n_own"), F.count_if(own_page & F.col("usable")).alias("n_usable"))
    seen = grounding.packed_contacts(grounding.observed_contacts(found).withColumn("category", F.lit("other_business"))).withColumnRenamed("contact_points", "seen_contacts")
    told = scoring.usage(replies) if replies is not None else empty(REPLIES)
    valid = domains.where("normalized_domain is not null")
    errors = [page_errors(found)]
    no_pages = valid.join(crawl.where("n_fetched > 0").select("ord"), "ord", "left_anti")
    errors.append(_error(no_pages, 1, "crawl", F.lit("no_usable_pages"), F.lit("No usable public page content")))
    errors.append(_error(domains.where("normalized_domain is null"), 0, "input", F.lit("invalid_domain"), F.lit("Invalid or unsafe company domain")))
    if failures is not None:
        e = F.struct("stage", "code", "message", "retryable", F.lit(None).cast("string").alias("source_id"), F.lit(True).alias("material"))
        errors.append(failures.select("ord", F.struct(F.lit(2).alias("section"), F.lit(0).alias("n")).alias("place"), e.cast(ERROR).alias("error")))
    every = errors[0]
    for e in errors[1:]:
        every = every.unionByName(e)
    of_errors = every.groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "error"))), lambda x: x["error"]).alias("errors"))
    out = domains.select("ord", "input_domain", "normalized_domain")
    for part in (grounded, pages, crawl, seen, told, of_errors):
        out = out.join(part, "ord", "left")
    size = "ord int, context_tokens bigint, request_tokens bigint, dropped_chunks bigint"
    out = out.join((contexts if contexts is not None else empty(size)).select("ord", "context_tokens", "request_tokens", "dropped_chunks"), "ord", "left")
    if durations is not None:
        out = out.join(durations, "ord", "left").fillna(0.0, ["duration_seconds"])
    if search:
        out = out.join(search["requests"].select("ord", F.col("n").alias("search_requests")), "ord", "left").join(search["warnings"].groupBy("ord").agg(F.array_sort(F.collect_set("warning")).alias("search_warnings")), "ord", "left")
    out = _with(out, search_requests=F.lit(0).cast("long"), search_warnings=F.lit(None).cast("array<string>"), completed=F.lit(False), duration_seconds=F.lit(None).cast("double"))
    zero = ["duplicate_pages", "html_bytes", "cleaned_text_chars", "context_tokens", "request_tokens", "dropped_chunks", "search_requests", "input_tokens", "cached_input_tokens", "output_tokens", "request_count", "reported_response_count"]
    out = out.fillna(0, zero).fillna(True, ["accounting_complete"])
    for name in ("response_ids", "request_ids", "models"):
        out = out.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    price = {"model": "", "pricing_model": None, "rates": (None, None, None)} | (pricing or {})
    out = scoring.cost(out, price["model"], price["pricing_model"], price["rates"])
    out = out.withColumn("usage", F.struct(*(F.col(x) for x in _names(USAGE))))
    for name in ("contact_points", "team_members", "sources", "errors"):
        out = out.withColumn(name, F.coalesce(F.col(name).cast(RESULT[name]) if name != "team_members" else _people(out), F.array().cast(RESULT[name])))
    contacts = F.when(F.size("contact_points") == 0, F.coalesce(F.col("seen_contacts").cast(RESULT["contact_points"]), F.array().cast(RESULT["contact_points"]))).otherwise(F.col("contact_points"))
    out = out.withColumn("contact_points", contacts).withColumn("field_evidence", F.coalesce("field_evidence", F.create_map().cast(RESULT["field_evidence"])))
    out = out.withColumn("warnings", F.concat(F.coalesce("issues", F.array().cast("array<string>")), F.coalesce("search_warnings", F.array().cast("array<string>"))))
    # Counted with the crawl and not in the list of sources, so that scores and states need no texts. Snippets of a search are no pages.
    attempted, usable = F.coalesce("n_own", F.lit(0)), F.coalesce("n_usable", F.lit(0))
    counts = {"attempted_pages": attempted, "usable_pages": usable, "estimated_context_tokens": F.col("context_tokens"), "estimated_request_tokens": F.col("request_tokens"), "duration_seconds": F.col("duration_seconds")}
    out = out.withColumn("crawl", F.struct(*(counts.get(x, F.col(x) if x in out.columns else F.lit(0)).alias(x) for x in _names(CRAWL))))
    share = F.coalesce(F.try_divide(F.col("crawl.usable_pages").cast("double"), F.col("crawl.attempted_pages").cast("double")), F.lit(0.0))
    out = scoring.status(scoring.factors(out.withColumn("estimated_search_cost_usd", F.lit(None).cast("double")), share))
    return out.select(*(F.col(k).cast(v).alias(k) for k, v in RESULT.items()))


def _people(out: DataFrame) -> Column:
    fields = out.schema["team_members"].dataType.elementType.names
    more = {"linkedin_candidates": F.array()} if "linkedin_candidates" not in fields else {}
    return F.transform("team_members", lambda p: F.struct(*(p[f].alias(f) for f in fields), *(v.alias(k) for k, v in more.items()))).cast(RESULT["team_members"])


def _names(struct: str) -> list[str]:
    """Field names of a struct's DDL, in order."""
    out, depth, name = [], 0, ""
    for c in struct[len("struct<") : -1]:
        if c == "<":
            depth += 1
        elif c == ">":
            depth -= 1
        if depth == 0 and c == ",":
            out.append(name.split(":")[0])
            name = ""
        else:
            name += c
    return [*out, name.split(":")[0]]
