"""Audit of a run: each rule gives its violations (rule, ord, detail); no rows mean a valid run.

A result is one row with all that it holds: sources, contact_points, team_members with their evidence, field_evidence,
errors, usage and confidence_breakdown. The general rules look only inside a row, so they need no join and no
shuffle; what is required of a whole run compares it with the list of domains.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions import text as T
from evidra.functions import urls as U
from evidra.operators import scoring
from evidra.operators.grounding import EVIDENCE
from evidra.sources.domains import normalized

VIOLATIONS = "array<struct<rule:string,detail:string>>"


def _when(rule: str, bad: Column, detail: Column) -> Column:
    """A violation if bad."""
    one = F.array(F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail")))
    return F.when(F.coalesce(bad, F.lit(False)), one).otherwise(F.array().cast(VIOLATIONS))


def _each(rule: str, items: Column, bad, detail) -> Column:
    """A violation for each bad item."""
    wrong = F.filter(F.coalesce(items, F.array()), lambda x: F.coalesce(bad(x), F.lit(False)))
    return F.transform(wrong, lambda x: F.struct(F.lit(rule).alias("rule"), detail(x).cast("string").alias("detail")))


def resolves(e: Column) -> Column:
    """Whether the excerpt stands in its source, the last of several that evidence names, under the URL that it tells."""
    named = F.try_element_at(F.filter("sources", lambda s: s["usable"] & (s["source_id"] == e["source_id"])), F.lit(-1))
    held = lambda x, s: F.length(x).between(3, 600) & (s["final_url"] == e["source_url"]) & T.says(s["text"], x)
    return F.coalesce(T.let(named, lambda s: T.let(T.squeezed(e["excerpt"]), lambda x: held(x, s))), F.lit(False))


def observed(email: Column) -> Column:
    """Whether a first-party source shows an address of the company."""

    def shows(s):
        # A line of the text stands in it.
        held = lambda line: F.length(T.squeezed(F.coalesce(line, email))).between(3, 600) & (line.isNotNull() | T.says(s["text"], T.squeezed(email)))
        return s["usable"] & (s["kind"] == "first_party_html") & F.array_contains(s["email_candidates"], email) & T.let(T.first_line(s["text"], email, 600), held)

    return F.exists("sources", shows)


def all_evidence() -> Column:
    """Everything that a result cites."""
    none = F.array().cast(EVIDENCE)
    of = lambda items, *names: F.flatten(F.transform(F.coalesce(items, F.array()), lambda p: F.concat(*(F.coalesce(p[n], none) for n in names))))
    candidates = F.flatten(F.transform(F.coalesce("team_members", F.array()), lambda p: F.flatten(F.transform(F.coalesce(p["linkedin_candidates"], F.array()), lambda c: c["evidence"]))))
    return F.concat(F.coalesce(F.flatten(F.map_values("field_evidence")), none), of(F.col("contact_points"), "evidence"), of(F.col("team_members"), "relationship_evidence", "role_evidence", "profile_evidence"), candidates)


def source_ids() -> Column:
    ids = F.transform("sources", lambda s: s["source_id"])
    twice = F.array_distinct(F.filter(ids, lambda x: F.size(F.filter(ids, lambda y: y == x)) > 1))
    return _each("source_ids_unique", twice, lambda x: F.lit(True), lambda x: x)


def contacts_observed() -> Column:
    return _each("contact_observed", F.col("contact_points"), lambda c: ~observed(c["email"]) | (F.size(c["evidence"]) == 0), lambda c: c["email"])


def evidence_resolves() -> Column:
    return _each("evidence_resolves", all_evidence(), lambda e: ~resolves(e), lambda e: F.concat_ws(":", e["source_id"], e["excerpt"]))


def people_related() -> Column:
    def related(p):
        return F.exists(p["relationship_evidence"], lambda e: T.folded(e["excerpt"]).contains(T.folded(p["name"])) & e["excerpt"].rlike(T.RELATIONSHIP) & ~T.outsider(e["excerpt"]))

    return _each("person_related", F.col("team_members"), lambda p: ~related(p), lambda p: p["name"])


def roles_evidenced() -> Column:
    def told(p):
        return F.exists(p["role_evidence"], lambda e: T.folded(e["excerpt"]).contains(T.folded(p["role"])) & T.folded(e["excerpt"]).contains(T.folded(p["name"])))

    return _each("role_evidenced", F.col("team_members"), lambda p: (p["role"] != "") & ~told(p), lambda p: p["name"])


def profiles_observed() -> Column:
    beside = lambda x: F.struct(U.profile_url(x["url"]).alias("url"), T.folded(x["nearby_text"]).alias("beside"))
    own = F.filter("sources", lambda s: s["usable"] & (s["kind"] == "first_party_html"))
    links = F.flatten(F.transform(own, lambda s: F.transform(F.coalesce(s["links"], F.array()), beside)))

    def unsound(shown):
        linked = lambda p: T.let(T.folded(p["name"]), lambda n: F.exists(shown, lambda x: F.coalesce((x["url"] == p["linkedin_url"]) & x["beside"].contains(n), F.lit(False))))
        sound = lambda p: (p["linkedin_status"] == "first_party_link") & (F.size(p["profile_evidence"]) > 0) & linked(p)
        return _each("profile_observed", F.col("team_members"), lambda p: (p["linkedin_url"] != "") & ~sound(p), lambda p: p["name"])

    return T.let(links, unsound)


def fields_evidenced() -> Column:
    bare = lambda f: (F.col(f) != "") & ~F.coalesce(F.size(F.try_element_at("field_evidence", F.lit(f))) > 0, F.lit(False))
    return F.concat(*(_when("field_evidenced", bare(f), F.lit(f)) for f in ("company_name", "company_overview", "target_audience")))


def success_whole() -> Column:
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return _when("success_whole", (F.col("status") == "success") & ~(has("company_overview") & has("target_audience")), F.col("status"))


def success_clean() -> Column:
    return _when("success_clean", (F.col("status") == "success") & F.exists("errors", lambda e: e["material"]), F.col("status"))


def scores() -> Column:
    again = scoring.breakdown()
    total = scoring.weighted(again)
    wrong = F.col("confidence_score").isNull() | (F.abs(F.col("confidence_score") - total) > 1e-6)
    apart = reduce(lambda a, b: a | b, (~F.col(f"confidence_breakdown.{k}").eqNullSafe(v) for k, v in again.items()))
    return F.concat(_when("score_recomputes", wrong, F.col("confidence_score")), _when("breakdown_recomputes", apart, F.col("confidence_score")))


RULES = [source_ids, contacts_observed, evidence_resolves, people_related, roles_evidenced, profiles_observed, fields_evidenced, success_whole, success_clean, scores]


def audit(results: DataFrame) -> DataFrame:
    """All general rules: (rule, ord, detail)."""
    # The outer form, so that no inferred filter works out all rules again.
    found = results.select(F.col("ord").cast("int").alias("ord"), F.explode_outer(F.concat(*(rule() for rule in RULES))).alias("v"))
    return found.where("v is not null").select("v.rule", "ord", "v.detail")


def _told(df: DataFrame, rule: str, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col("ord").cast("int").alias("ord"), detail.cast("string").alias("detail"))


def run_rules(run: DataFrame, results: DataFrame) -> DataFrame:
    """Rules of a run's head (mode, started_at, finished_at, complete, warnings): a complete run has an end, a demo says so, a live run has no fixtures."""
    r = run.withColumn("ord", F.lit(None).cast("int"))
    says = F.exists("warnings", lambda w: F.lower(w).contains("fixture"))
    fixtures = results.where(F.exists("sources", lambda s: s["retrieval_method"] == "fixture")).select("ord", F.lit("live").alias("mode"))
    rules = [
        _told(r.where("complete and finished_at is null"), "complete_finished", F.col("mode")),
        _told(r.where((F.col("mode") == "demo") & ~F.coalesce(says, F.lit(False))), "demo_warns", F.col("mode")),
        _told(fixtures.join(run.select("mode"), "mode", "left_semi"), "live_without_fixtures", F.col("mode")),
        _told(r.where("schema_version <> '1.0'"), "schema_version", F.col("schema_version")),
    ]
    return reduce(DataFrame.unionByName, rules)


def required(results: DataFrame, domains: DataFrame) -> DataFrame:
    """Results are exactly the required domains, as often, each normalised from its input."""
    want = domains.select(normalized(F.col("input_domain")).alias("normalized_domain"))
    counted = want.groupBy("normalized_domain").agg(F.count("*").alias("n")).withColumn("ord", F.lit(None).cast("int"))
    have = results.groupBy("normalized_domain").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
    rules = [
        _told(counted.where("n > 1"), "required_distinct", F.col("normalized_domain")),
        _told(counted.join(have.select("normalized_domain"), "normalized_domain", "left_anti"), "required_missing", F.col("normalized_domain")),
        _told(results.join(counted.select("normalized_domain"), "normalized_domain", "left_anti"), "not_required", F.col("normalized_domain")),
        _told(have.where("n > 1"), "result_repeated", F.col("normalized_domain")),
        _told(results.where(~F.col("normalized_domain").eqNullSafe(normalized(F.col("input_domain")))), "normalized", F.col("input_domain")),
    ]
    return reduce(DataFrame.unionByName, rules)


def live(results: DataFrame, run: DataFrame) -> DataFrame:
    """A live, complete run: every row a success with a usable rendered page and recorded responses."""
    rendered = F.exists("sources", lambda s: s["usable"] & (s["retrieval_method"] == "playwright"))
    u = F.col("usage")
    recorded = (u["request_count"] > 0) & (u["reported_response_count"] > 0) & (u["input_tokens"] > 0) & (u["output_tokens"] > 0) & (F.size(u["response_ids"]) > 0)
    rules = [
        _told(run.where("mode <> 'live' or not complete").withColumn("ord", F.lit(None).cast("int")), "live_complete", F.col("mode")),
        _told(results.where("status <> 'success'"), "all_success", F.col("status")),
        _told(results.where(~F.coalesce(rendered, F.lit(False))), "browser_source", F.col("normalized_domain")),
        _told(results.where(~F.coalesce(recorded, F.lit(False))), "usage_recorded", F.col("normalized_domain")),
    ]
    return reduce(DataFrame.unionByName, rules)


class Violation(ValueError):
    pass


def required_or_raise(violations: DataFrame) -> None:
    first = violations.orderBy("rule", "ord", "detail").first()
    if first:
        raise Violation(f"{first.rule}: {first.detail}")
