"""Scores, states, usage and cost of company rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the six factors.
WEIGHTS = {
    "overview_supported": 0.25,
    "audience_supported": 0.20,
    "public_contact_present": 0.15,
    "named_leader_with_supported_role_present": 0.20,
    "directly_supported_linkedin_fraction": 0.10,
    "retrieval_success_fraction": 0.10,
}


def crawl_stats(sources: DataFrame) -> DataFrame:
    first = F.col("kind") == "first_party_html"
    return sources.groupBy("ord").agg(F.count_if(first).alias("attempted_pages"), F.count_if(first & F.col("usable")).alias("usable_pages"), F.sum("html_bytes").alias("html_bytes"), F.sum("cleaned_text_chars").alias("cleaned_text_chars"))


def material(depth: Column, priority: Column, code: Column) -> Column:
    """Whether a page's error weighs on the result."""
    return (depth == 0) | ((priority < 5) & ~code.isin("http_404", "http_410", "soft_404"))


# Fixed value: what a score is not.
EXPLANATION = "Evidence/completeness heuristic; not a calibrated probability of correctness"


def breakdown(retrieved: Column | None = None) -> dict[str, Column]:
    """The six factors of a result row: company_overview, target_audience, contact_points, team_members, sources.

    retrieved: the usable share of first-party sources, where it is at hand; the sources with their texts are not needed then.
    """
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    n = lambda c, keep=None: F.size(F.filter(c, keep) if keep else F.col(c)).cast("double")
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    own = lambda s: s["kind"] == "first_party_html"
    return {
        "overview_supported": flag(F.col("company_overview") != ""),
        "audience_supported": flag(F.col("target_audience") != ""),
        "public_contact_present": flag(F.size("contact_points") > 0),
        "named_leader_with_supported_role_present": flag(F.exists("team_members", lambda p: p["role"] != "")),
        "directly_supported_linkedin_fraction": part(n("team_members", lambda p: p["linkedin_status"] == "first_party_link"), n("team_members")),
        "retrieval_success_fraction": part(n("sources", lambda s: own(s) & s["usable"]), n("sources", own)) if retrieved is None else retrieved,
    }


def weighted(f: dict[str, Column]) -> Column:
    return F.round(sum((F.lit(w) * f[k] for k, w in WEIGHTS.items()), F.lit(0.0)), 6)


def factors(r: DataFrame, retrieved: Column | None = None) -> DataFrame:
    """r, a table of result rows, with confidence_breakdown and confidence_score. retrieved: as breakdown() takes it."""
    f = breakdown(retrieved)
    told = F.struct(*(v.alias(k) for k, v in f.items()), F.lit(EXPLANATION).alias("explanation"))
    return r.withColumn("confidence_breakdown", told).withColumn("confidence_score", weighted({k: F.col(f"confidence_breakdown.{k}") for k in WEIGHTS}))


def status(r: DataFrame) -> DataFrame:
    """r with status: failed without any fact, success if whole and clean, else partial. r: result rows with completed and errors."""
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    useful = has("company_name") | has("company_overview") | has("target_audience") | some("contact_points") | some("team_members")
    clean = ~F.coalesce(F.exists("errors", lambda e: e["material"]), F.lit(False))
    whole = has("company_overview") & has("target_audience") & F.coalesce("completed", F.lit(False)) & clean
    return r.withColumn("status", F.when(~useful, "failed").when(whole, "success").otherwise("partial"))


def exit_code(results: DataFrame, strict: bool, *by: str) -> DataFrame:
    """(exit_code) of a run, or of each of several: strict is 0 if all succeed, else 0 if any does not fail."""
    s = F.col("status")
    code = F.when(F.bool_or(s != "success"), 1).otherwise(0) if strict else F.when(F.bool_or(s != "failed"), 0).otherwise(1)
    return results.groupBy(*by).agg(code.alias("exit_code"))


def usage(replies: DataFrame) -> DataFrame:
    """Usage of each ord over provider replies (ord, attempt, model, response_id, request_id, input_tokens, cached_input_tokens, output_tokens).

    A reply without input tokens reported none, nor did a failed request; ids are listed in order of attempt.
    """
    told = F.col("input_tokens").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(told, F.col(c))), F.lit(0)).cast("long")
    ids = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c) != "", F.struct("attempt", c)))), lambda x: x[c])
    return replies.groupBy("ord").agg(
        total("input_tokens").alias("input_tokens"),
        total("cached_input_tokens").alias("cached_input_tokens"),
        total("output_tokens").alias("output_tokens"),
        F.count("*").alias("request_count"),
        F.count_if(told).alias("reported_response_count"),
        ids("response_id").alias("response_ids"),
        ids("request_id").alias("request_ids"),
        F.array_distinct(ids("model")).alias("models"),
        F.bool_and(told).alias("accounting_complete"),
    )


# Reasons beside a cost.
REASONS = {
    "none": "No provider requests; no billed usage observed",
    "model": "Pricing absent or does not match configured model",
    "provider": "Provider model does not match pricing model",
    "rates": "Pricing rates unavailable",
    "silent": "No provider-reported usage; billed amount unknown",
    "whole": "Estimate from provider-reported usage and configured USD prices",
    "part": "INCOMPLETE: estimate covers known usage only; failed-request billing unknown",
}


# Fixed value: what a cost covers.
SCOPE = "Reported LLM usage only; excludes browser, network, and search costs"


def cost(u: DataFrame, model: str, pricing_model: str | None, rates: tuple[float | None, float | None, float | None]) -> DataFrame:
    """u (usage) with estimated_llm_cost_usd and cost_reason. rates: USD a million of fresh input, cached input and output."""
    other = F.exists("models", lambda m: (m != model) & ~F.startswith(m, F.lit(model + "-")))
    no_rates = F.lit(any(r is None for r in rates))
    why = F.when(F.col("request_count") == 0, "none").when(F.lit(pricing_model != model), "model").when(other, "provider").when(no_rates, "rates").when(F.col("reported_response_count") == 0, "silent")
    r = [F.lit(float(x or 0)) for x in rates]
    usd = ((F.col("input_tokens") - F.col("cached_input_tokens")) * r[0] + F.col("cached_input_tokens") * r[1] + F.col("output_tokens") * r[2]) / 1_000_000
    key = F.coalesce(why, F.when(F.col("accounting_complete"), "whole").otherwise("part"))
    text = F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv))
    return u.withColumn("estimated_llm_cost_usd", F.when(why.isNull(), F.round(usd, 10))).withColumn("cost_reason", text[key]).withColumn("cost_scope", F.lit(SCOPE))
