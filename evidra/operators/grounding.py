"""Grounding: citations resolve against sources, and only what is evidenced stays.

Tables: sources (ord, source_id, page_no, kind, usable, final_url, text, links, email_candidates); claims (ord, field, value);
contacts (ord, item, email, category); people (ord, item, name, role, linkedin_url); and citations (ord, aspect, item,
pos, source_id, excerpt), where aspect is a claim's field (item 0), contact, relationship, role or profile. Evidence is an
array of (source_id, excerpt, source_url) in the order of citation. Issues are rows (ord, place, issue), place being where
they come in a result's list.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import text as T
from evidra.functions import urls as U

# The claims of an extraction, in order.
FIELDS = ["company_name", "overview_sentence_1", "overview_sentence_2", "target_audience"]
# What citations of people are for.
OF_PEOPLE = ["relationship", "role", "profile"]
# Fixed value: a phrase by which a page speaks of its own people.
OWN_TEAM = r"(?i)\bour (team|founder|chief|ceo|cto)\b"
EVIDENCE = "array<struct<source_id:string,excerpt:string,source_url:string>>"
Kept = Callable[[DataFrame, str], DataFrame]
ISSUES = "ord {}, place struct<section:int,item:int,part:int>, issue string"


def _own() -> Column:
    return (F.col("kind") == "first_party_html").alias("__own")


def resolve(citations: DataFrame, sources: DataFrame, *more: Column) -> DataFrame:
    """Citations whose squeezed excerpt (3 to 600 characters) stands in their usable source, with source_url.

    Of repeated evidence of one owner the first stays; it differs in pos alone, so it takes a hash and no sort. more: further narrow columns of
    sources to bring along. A source's text is searched as its citations meet it; no citation carries it on.
    """
    # Null for other lengths, which stands nowhere: a filter by length would squeeze each excerpt again for every bound.
    c = citations.withColumn("excerpt", T.let(T.squeezed(F.col("excerpt")), lambda x: F.when(F.length(x).between(3, 600), x)))
    s = sources.where("usable").select(F.col("ord").alias("__ord"), F.col("source_id").alias("__id"), F.col("final_url").alias("source_url"), F.col("text").alias("__text"), *more)
    held = (F.col("ord") == F.col("__ord")) & (F.col("source_id") == F.col("__id")) & T.says(F.col("__text"), F.col("excerpt"))
    met = c.join(s, held).drop("__ord", "__id", "__text")
    return met.groupBy(*(x for x in met.columns if x != "pos")).agg(F.min("pos").alias("pos")).select(met.columns)


def listed(when: Column | None = None, order: str | Column = "pos") -> Column:
    """Aggregates resolved citations to evidence, those under a condition."""
    one = F.struct(F.col(order).alias("o") if isinstance(order, str) else order.alias("o"), "source_id", "excerpt", "source_url")
    every = F.sort_array(F.collect_list(one if when is None else F.when(when, one)))
    return F.transform(every, lambda x: F.struct(x["source_id"].alias("source_id"), x["excerpt"].alias("excerpt"), x["source_url"].alias("source_url")))


def _issue(df: DataFrame, section: int, text: Column, item: str | None = None, part: int = 0) -> DataFrame:
    place = F.struct(F.lit(section).alias("section"), (F.col(item) if item else F.lit(0)).cast("int").alias("item"), F.lit(part).alias("part"))
    return df.select("ord", place.alias("place"), text.alias("issue"))


def observed_contacts(sources: DataFrame) -> DataFrame:
    """(ord, email, place, evidence): addresses of first-party sources with the first short line of each that shows them."""
    s = sources.where("usable and kind = 'first_party_html' and size(email_candidates) > 0 and ord is not null and source_id is not null")

    def shown(e, at):
        line = lambda x: F.struct(e.alias("email"), F.struct("page_no", at.alias("at")).alias("pos"), T.squeezed(F.coalesce(x, e)).alias("excerpt"), (x.isNotNull() | T.says(F.col("text"), T.squeezed(e))).alias("held"))
        return T.let(T.first_line(F.col("text"), e, 600), line)

    # A line is looked for in its own source, so no text leaves its row. The outer form, as the plain one infers a filter that repeats all of this.
    each = s.select("ord", "source_id", F.col("final_url").alias("source_url"), F.inline_outer(F.transform("email_candidates", shown)))
    each = each.where("email is not null and held and length(excerpt) between 3 and 600")
    return each.groupBy("ord", "email").agg(F.min("pos").alias("place"), F.array_distinct(listed()).alias("evidence"))


def valid_claims(claims: DataFrame, citations: DataFrame, sources: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """(ord, field, value, evidence, issue): value and evidence are null where evidence is missing, with an issue.

    Every citation must resolve and be distinct, the value has 1 to 700 characters, and a company name
    stands in some excerpt. resolved: citations as resolve() gives them, where they are at hand.
    """
    mine = citations.where(F.col("aspect").isin(FIELDS))
    asked = mine.groupBy("ord", F.col("aspect").alias("field")).agg(F.count("*").alias("asked"))
    held = (resolve(mine, sources) if resolved is None else resolved.where(F.col("aspect").isin(FIELDS))).groupBy("ord", F.col("aspect").alias("field")).agg(listed().alias("evidence"))
    c = claims.withColumn("value", T.squeezed(F.col("value"))).join(asked, ["ord", "field"], "left").join(held, ["ord", "field"], "left")
    c = c.withColumn("__fold", T.folded(F.col("value")))
    whole = (F.size("evidence") == F.col("asked")) & F.length("value").between(1, 700)
    c = c.withColumn("__whole", F.coalesce(whole, F.lit(False)))
    named = (F.col("field") != "company_name") | F.exists("evidence", lambda x: T.folded(x["excerpt"]).contains(F.col("__fold")))
    c = c.withColumn("__good", F.col("__whole") & F.coalesce(named, F.lit(False)))
    # What an extraction is told about its claims.
    issue = F.when(F.col("value").isNull() | F.col("__good"), None).when(~F.col("__whole"), F.concat("field", F.lit(": missing/invalid source citation or unsupported value"))).otherwise("company_name: name is not observed in evidence")
    return c.select("ord", "field", F.when(F.col("__good"), F.col("value")).alias("value"), F.when(F.col("__good"), F.col("evidence")).alias("evidence"), issue.alias("issue"))


def core(held: DataFrame) -> DataFrame:
    """(ord, company_name, company_overview, target_audience, field_evidence, overview_issue) from valid claims.

    The overview takes both sentences, each a single one, or it is not there and what they cite neither.
    """
    of = {f: F.max(F.when(F.col("field") == f, F.struct("value", "evidence"))).alias(f) for f in FIELDS}
    wide = held.where("value is not null").groupBy("ord").agg(*of.values())
    wide = held.select("ord").distinct().join(wide, "ord", "left")
    one, two = F.col("overview_sentence_1"), F.col("overview_sentence_2")
    both = F.coalesce(T.single_sentence(one["value"]) & T.single_sentence(two["value"]), F.lit(False))
    # Fixed value: what an extraction is told about its overview.
    issue = F.when(~both & (one.isNotNull() | two.isNotNull()), "company_overview: requires two supported single sentences ending in punctuation")
    entry = lambda name, e: F.struct(F.lit(name).alias("key"), e.cast(EVIDENCE).alias("value"))
    entries = F.array(
        F.when(F.col("company_name").isNotNull(), entry("company_name", F.col("company_name.evidence"))),
        F.when(both, entry("company_overview", F.concat(one["evidence"], two["evidence"]))),
        F.when(F.col("target_audience").isNotNull(), entry("target_audience", F.col("target_audience.evidence"))),
    )
    return wide.select(
        "ord",
        F.col("company_name.value").alias("company_name"),
        F.when(both, F.concat_ws(" ", one["value"], two["value"])).alias("company_overview"),
        F.col("target_audience.value").alias("target_audience"),
        F.map_from_entries(F.filter(entries, lambda x: x.isNotNull())).alias("field_evidence"),
        issue.alias("overview_issue"),
    )


def companies(held: DataFrame) -> DataFrame:
    """(ord, company_name) of valid claims, as core() has it, for those that have one."""
    return held.where("field = 'company_name' and value is not null").groupBy("ord").agg(F.max("value").alias("company_name"))


def contact_categories(observed: DataFrame, extracted: DataFrame, citations: DataFrame, sources: DataFrame, resolved: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(observed contacts with category, issues). The last extracted contact that is observed and evidenced gives the category.

    Each of its resolved excerpts has the address. Addresses that were not observed are never added.
    """
    held = resolve(citations.where("aspect = 'contact'"), sources) if resolved is None else resolved.where("aspect = 'contact'")
    said = held.groupBy("ord", "item").agg(F.collect_list(F.lower("excerpt")).alias("said"))
    address = T.stripped(F.lower("email"))
    each = extracted.select("ord", "item", address.alias("email"), F.col("category").alias("given")).join(said, ["ord", "item"], "left")
    each = each.join(observed.select("ord", "email", F.lit(True).alias("seen")), ["ord", "email"], "left")
    ok = F.coalesce(F.col("seen") & F.forall("said", lambda x: x.contains(F.col("email"))), F.lit(False))
    each = each.withColumn("ok", ok)
    last = each.where("ok").groupBy("ord", "email").agg(F.max_by("given", "item").alias("category"))
    out = observed.join(last, ["ord", "email"], "left").withColumn("category", F.coalesce("category", F.lit("other_business")))
    # Fixed value: what an extraction is told about a contact.
    return out, _issue(each.where("not ok"), 5, F.lit("contact_points: email was not observed with supporting evidence"), "item")


def people(found: DataFrame, citations: DataFrame, sources: DataFrame, companies: DataFrame, resolved: DataFrame | None = None, kept: Kept = lambda df, name: df) -> tuple[DataFrame, DataFrame]:
    """(accepted people with their evidence, issues). companies: ord, company_name.

    A person needs a relationship excerpt of a first-party source that names them and the company or 'our team',
    where no line of the source about them puts them outside; of equal names the first accepted stays. A role needs an
    excerpt with name and role, a profile an observed link beside the name, in an excerpt with both.
    """
    p = found.join(companies.select("ord", F.col("company_name").alias("__company")), "ord", "left")
    p = p.withColumn("name", T.squeezed(F.col("name"))).withColumn("role", T.squeezed(F.col("role"))).withColumn("__profile", U.profile_url(F.col("linkedin_url")))
    of_people = F.col("aspect").isin(OF_PEOPLE)
    e = resolve(citations.where(of_people), sources, _own()) if resolved is None else resolved.where(of_people)
    e = e.join(p.select("ord", "item", "name", "role", "__company", "__profile"), ["ord", "item"])
    # Of a source only the lines that put someone outside and the profiles with what stands beside them are brought to the citations.
    link = lambda x: F.struct(U.profile_url(x["url"]).alias("profile"), x["url"].alias("url"), F.lower(x["nearby_text"]).alias("beside"), T.outsider(x["nearby_text"]).alias("out"))
    shown = sources.where("usable").select("ord", "source_id", F.transform(T.outsider_lines(F.col("text")), F.lower).alias("__lines"), F.filter(F.transform("links", link), lambda x: x["profile"].isNotNull() & ~x["out"]).alias("__links"))
    e = e.join(shown, ["ord", "source_id"], "left")
    said, name = F.lower("excerpt"), F.lower("name")
    named = said.contains(name) & ~T.outsider(F.col("excerpt"))
    inside = F.coalesce(T.folded(F.col("excerpt")).contains(T.folded(F.col("__company"))), F.lit(False)) | F.col("excerpt").rlike(OWN_TEAM)
    outside = F.exists("__lines", lambda x: x.contains(F.lower("name")))
    trusted = (F.col("aspect") == "relationship") & F.col("__own") & named & F.col("excerpt").rlike(T.RELATIONSHIP) & inside & ~outside
    roled = (F.col("aspect") == "role") & named & said.contains(F.lower("role"))
    beside = F.exists("__links", lambda x: (x["profile"] == F.col("__profile")) & x["beside"].contains(F.lower("name")) & F.col("excerpt").contains(x["url"]))
    linked = (F.col("aspect") == "profile") & F.col("__own") & said.contains(name) & F.coalesce(beside, F.lit(False))
    e = e.select("ord", "item", "pos", "source_id", "excerpt", "source_url", trusted.alias("__trusted"), roled.alias("__roled"), linked.alias("__linked"))
    trusted, roled, linked = F.col("__trusted"), F.col("__roled"), F.col("__linked")
    held = e.groupBy("ord", "item").agg(listed(trusted).alias("relationship_evidence"), listed(roled).alias("role_evidence"), listed(linked).alias("profile_evidence"))
    none = F.array().cast(EVIDENCE)
    p = p.join(held, ["ord", "item"], "left").withColumns({k: F.coalesce(k, none) for k in ("relationship_evidence", "role_evidence", "profile_evidence")})
    p = p.withColumn("__ok", F.coalesce(F.length("name").between(1, 100) & (F.size("relationship_evidence") > 0), F.lit(False)))
    p = p.withColumn("__n", F.row_number().over(Window.partitionBy("ord", "__ok", T.folded(F.col("name"))).orderBy("item")))
    p = kept(p, "people")
    taken = p.where("__ok and __n = 1")
    has_role, has_profile = F.size("role_evidence") > 0, F.col("__profile").isNotNull() & (F.size("profile_evidence") > 0)
    short = F.concat(F.lit("'"), F.coalesce(F.left("name", F.lit(100)), F.lit("")), F.lit("'"))
    # What an extraction is told about its people.
    issues = [
        _issue(p.where("not __ok"), 6, F.concat(F.lit("team_members: "), short, F.lit(" has an unsupported company relationship or external testimonial; omit this person unless valid company evidence exists")), "item"),
        _issue(taken.where((F.coalesce("role", F.lit("")) != "") & ~has_role), 6, F.concat(F.lit("team_members.role: "), short, F.lit(" role not present in person-specific evidence; use an exact observed title or null")), "item", 1),
        _issue(taken.where((F.coalesce("linkedin_url", F.lit("")) != "") & ~has_profile), 6, F.concat(F.lit("team_members.linkedin_url: "), short, F.lit(" has no observed person/profile association; set linkedin_url to null and profile_evidence to []")), "item", 2),
    ]
    role = (F.coalesce("role", F.lit("")) != "") & has_role
    wanted = (F.coalesce("linkedin_url", F.lit("")) != "") & has_profile
    out = taken.select(
        "ord",
        "item",
        "name",
        F.when(role, F.col("role")).alias("role"),
        F.when(wanted, F.col("__profile")).alias("linkedin_url"),
        F.when(wanted, "first_party_link").otherwise("not_found").alias("linkedin_status"),
        "relationship_evidence",
        F.when(role, F.col("role_evidence")).otherwise(none).alias("role_evidence"),
        F.when(wanted, F.col("profile_evidence")).otherwise(none).alias("profile_evidence"),
    )
    return out, reduce(DataFrame.unionByName, issues)


def named_people(claims: DataFrame, citations: DataFrame, found_people: DataFrame, sources: DataFrame, kept: Kept = lambda df, name: df) -> tuple[DataFrame, DataFrame]:
    """people() with the companies that claims prove. Texts are searched once for all that it takes: names of companies and people."""
    field = "company_name"
    mine = citations.where(F.col("aspect").isin(field, *OF_PEOPLE))
    resolved = kept(resolve(mine, sources, _own()), "resolved")
    held = valid_claims(claims.where(F.col("field") == field), mine, sources, resolved)
    return people(found_people, mine, sources, companies(held), resolved, kept)


def ground(claims: DataFrame, citations: DataFrame, found_people: DataFrame, extracted: DataFrame, sources: DataFrame, kept: Kept = lambda df, name: df) -> DataFrame:
    """What the sources prove of extractions, a row for each ord with claims: the core fields, field_evidence,
    contact_points, team_members and issues, distinct and in order.

    All citations are searched for at once. kept: writes a table under a name and reads it; what several parts of the
    result need is worked out once then.
    """
    resolved = kept(resolve(citations, sources, _own()), "resolved")
    held = kept(valid_claims(claims, citations, sources, resolved), "claims")
    fields = core(held)
    contacts, wrong = contact_categories(kept(observed_contacts(sources), "observed"), extracted, citations, sources, resolved)
    team, doubts = people(found_people, citations, sources, companies(held), resolved, kept)
    order = F.array_position(F.array(*map(F.lit, FIELDS)), F.col("field")).cast("int")
    section = F.when(order <= 3, order - 1).otherwise(4)
    of_claims = held.where("issue is not null").select("ord", F.struct(section.alias("section"), F.lit(0).alias("item"), F.lit(0).alias("part")).alias("place"), "issue")
    of_overview = _issue(fields.where("overview_issue is not null"), 3, F.col("overview_issue"))
    issues = reduce(DataFrame.unionByName, [of_claims, of_overview, wrong, doubts])
    told = issues.groupBy("ord").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "issue"))), lambda x: x["issue"])).alias("issues"))
    return fields.drop("overview_issue").join(packed_contacts(contacts), "ord", "left").join(packed_people(team), "ord", "left").join(told, "ord", "left").withColumn("issues", F.coalesce("issues", F.array().cast("array<string>")))


def packed_contacts(contacts: DataFrame) -> DataFrame:
    """(ord, contact_points) in the order in which pages show them."""
    # Fixed value: what seeing an address proves.
    one = F.struct("place", "email", "category", "evidence", F.lit("publicly_observed_not_deliverability_verified").alias("verification_status"))
    return contacts.groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("place")).alias("contact_points"))


def packed_people(team: DataFrame) -> DataFrame:
    one = F.struct("item", *(c for c in team.columns if c not in ("ord", "item")))
    return team.groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("item")).alias("team_members"))


def supported_count(r: DataFrame) -> Column:
    """How much of a result is supported; an overview counts twice."""
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False)).cast("int")
    size = lambda c: F.coalesce(F.size(F.coalesce(F.col(c), F.array())), F.lit(0))
    return has("company_name") + 2 * has("company_overview") + has("target_audience") + size("contact_points") + size("team_members")


def best_attempt(attempts: DataFrame) -> DataFrame:
    """(ord, attempt): the clean attempt, else the last of those that support most. attempts: ord, attempt, supported, issues."""
    best = F.max_by("attempt", F.struct((F.col("issues") == 0).cast("int"), "supported", "attempt"))
    return attempts.groupBy("ord").agg(best.alias("attempt"))


def search_targets(team: DataFrame, most: int = 2) -> DataFrame:
    """(ord, item, name): the first people of each ord whose profile no page shows. team: ord, item, name, linkedin_url."""
    n = F.row_number().over(Window.partitionBy("ord").orderBy("item"))
    return team.where("linkedin_url is null").withColumn("n", n).where(F.col("n") <= most).select("ord", "item", "name")


def search_candidates(targets: DataFrame, hits: DataFrame, companies: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snippet sources, candidates): what a search for targets found on profiles, three hits a person.

    targets: ord, item, name. hits: ord, item, hit, query, url, title, content. companies: ord, company. fetched: ord, n
    sources so far. Every sound hit on a profile is a source; those that name person and company are candidates, each
    profile once, with its title as evidence.
    """
    h = hits.withColumn("n", F.row_number().over(Window.partitionBy("ord", "item").orderBy("hit"))).where("n <= 3")
    h = h.withColumn("profile", U.profile_url(F.col("url"))).where(F.col("profile").isNotNull() & F.length("title").between(3, 600) & (F.length("content") <= 10_000))
    h = h.join(targets, ["ord", "item"]).join(companies, "ord").join(fetched.select("ord", F.col("n").alias("n_sources")), "ord", "left")
    number = F.coalesce("n_sources", F.lit(0)) + F.row_number().over(Window.partitionBy("ord").orderBy("item", "hit"))
    h = h.withColumn("source_id", F.concat(F.lit("search-"), number.cast("string"))).withColumn("text", F.concat("title", F.lit("\n"), "content"))
    snippets = h.select("ord", "source_id", F.lit("search_snippet").alias("kind"), F.lit("tavily").alias("retrieval_method"), F.col("url").alias("requested_url"), F.col("url").alias("final_url"), F.lit(True).alias("usable"), "text", "title", F.col("query").alias("search_query"), F.length("text").cast("long").alias("cleaned_text_chars"))
    said = T.folded(F.col("text"))
    c = h.where(said.contains(T.folded(F.col("name"))) & said.contains(T.folded(F.col("company"))))
    c = c.withColumn("once", F.row_number().over(Window.partitionBy("ord", "item", "profile").orderBy("hit"))).where("once = 1")
    evidence = F.array(F.struct("source_id", F.col("title").alias("excerpt"), F.col("url").alias("source_url")))
    return snippets, c.select("ord", "item", "hit", F.col("profile").alias("url"), evidence.alias("evidence"), F.lit("search_candidate").alias("status"))


def with_candidates(team: DataFrame, candidates: DataFrame) -> DataFrame:
    """team with linkedin_candidates, and linkedin_status search_candidate where there are some."""
    one = F.struct("hit", "url", "evidence", "status")
    of = candidates.groupBy("ord", "item").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("hit")).alias("linkedin_candidates"))
    out = team.join(of, ["ord", "item"], "left")
    found = F.coalesce(F.size("linkedin_candidates") > 0, F.lit(False))
    return out.withColumn("linkedin_status", F.when(found, "search_candidate").otherwise(F.col("linkedin_status"))).withColumn("linkedin_candidates", F.coalesce("linkedin_candidates", F.array().cast(f"array<struct<url:string,evidence:{EVIDENCE},status:string>>")))
