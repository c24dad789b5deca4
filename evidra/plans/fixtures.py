"""Tables for the catalogue's queries on grounding, results and their audit, made from the documents.

The rows are SQL that Spark and DuckDB both read, so both sides start from the same tables; what follows from them is computed by
the operators on one side and by plain SQL on the other. {docs} stands for the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import text as T
from evidra.operators import grounding
from evidra.plans import enrich as E
from evidra.sources.commits import Commits

_CO = "'Acme' || cast(ord as string)"
_PAGE = f"""said || chr(10) || {_CO} || ' builds tools for labs.' || chr(10) || 'It sells them to cities.' || chr(10) || 'Ann Lee is the CEO of ' || {_CO} || '.' || chr(10)
|| case ord % 3 when 0 then '' when 1 then 'Customer testimonial: ' else 'A former CEO says: ' end || 'Bo Ray is the founder of ' || {_CO} || '.' || chr(10) || 'Dee Oh leads our team.' || chr(10)
|| 'Public email: hi@acme.test | Write to us' || chr(10) || 'Observed profile link: https://linkedin.com/in/ann | Ann Lee, CEO'"""
#: Tables by name; each may read those before it.
ROWS = {
    "base": "select cast(doc_id as int) as ord, coalesce(text, '') as said from {docs}",
    "pages_": f"select ord, 'page-1' as source_id, 1 as page_no, {_PAGE} as text, 'https://acme.test/' as final_url from base "
    "union all select ord, 'page-2', 2, 'Write to hi@acme.test or to gone@acme.test' || chr(10) || 'ANN LEE, founder of the company', 'https://acme.test/b' from base",
    "claims_": f"select ord, 'company_name' as field, {_CO} as value from base union all select ord, 'overview_sentence_1', case ord % 5 when 0 then 'Two. Sentences.' else {_CO} || ' builds  tools for labs.' end from base "
    "union all select ord, 'overview_sentence_2', case when ord % 7 = 0 then null else 'It sells them to cities.' end from base union all select ord, 'target_audience', case when ord % 6 = 0 then repeat('x', 701) else 'Labs' end from base",
    "contacts_": "select ord, 0 as item, ' HI@acme.test' as email, 'sales' as category from base union all select ord, 1, 'hi@acme.test', 'press' from base union all select ord, 2, 'new@acme.test', 'support' from base",
    "people_": "select ord, 0 as item, 'Ann  Lee' as name, case ord % 2 when 0 then 'CEO' else 'CTO' end as role, 'https://linkedin.com/in/ann/' as linkedin_url from base union all select ord, 1, 'Bo Ray', null, null from base "
    "union all select ord, 2, 'ann LEE', 'CEO', null from base union all select ord, 3, 'Cy', null, null from base union all select ord, 4, 'Dee Oh', 'lead', 'https://linkedin.com/in/dee' from base",
    "citations_": f"select ord, 'company_name' as aspect, 0 as item, 0 as pos, 'page-1' as source_id, case ord % 4 when 0 then {_CO} || ' builds tools' when 1 then 'It sells them' when 2 then {_CO} || '  builds   tools' else 'Nowhere ' || {_CO} end as excerpt from base "
    f"union all select ord, 'overview_sentence_1', 0, 0, 'page-1', {_CO} || ' builds tools for labs.' from base union all select ord, 'overview_sentence_1', 0, 1, 'page-1', {_CO} || ' builds  tools for labs.' from base where ord % 5 = 1 "
    "union all select ord, 'overview_sentence_2', 0, 0, 'page-1', 'It sells them to cities.' from base union all select ord, 'target_audience', 0, 0, case when ord % 9 = 0 then 'page-7' else 'page-1' end, 'for labs' from base "
    "union all select ord, 'contact', 0, 0, 'page-1', 'Public email: hi@acme.test' from base union all select ord, 'contact', 1, 0, 'page-1', case when ord % 2 = 0 then 'It sells them' else 'hi@acme.test | Write' end from base "
    "union all select ord, 'contact', 2, 0, 'page-1', 'Public email: hi@acme.test' from base "
    f"union all select ord, 'relationship', 0, 0, 'page-1', 'Ann Lee is the CEO of ' || {_CO} from base union all select ord, 'role', 0, 0, 'page-1', 'Ann Lee is the CEO' from base union all select ord, 'profile', 0, 0, 'page-1', 'Observed profile link: https://linkedin.com/in/ann | Ann Lee' from base "
    f"union all select ord, 'relationship', 1, 0, 'page-1', 'Bo Ray is the founder of ' || {_CO} from base union all select ord, 'relationship', 2, 0, 'page-1', 'Ann Lee is the CEO of ' || {_CO} from base "
    "union all select ord, 'relationship', 2, 1, 'page-2', 'ANN LEE, founder of the company' from base union all select ord, 'relationship', 3, 0, 'page-1', 'Cy works' from base "
    "union all select ord, 'relationship', 4, 0, 'page-1', 'Dee Oh leads our team.' from base union all select ord, 'role', 4, 0, 'page-1', 'Dee Oh leads our team.' from base union all select ord, 'profile', 4, 0, 'page-1', 'Observed profile link: https://linkedin.com/in/ann' from base",
}


def sql() -> str:
    """The tables as a list of common table expressions for DuckDB."""
    return ", ".join(f"{k} as ({v.replace('{docs}', 'documents')})" for k, v in ROWS.items())


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """sources, claims, contacts, people and citations as the operators take them."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, text in ROWS.items():
        args = {k: v for k, v in ({"docs": docs} | out).items() if "{" + k + "}" in text or f"from {k}" in text}
        out[name] = spark.sql(text.replace("from base", "from {base}"), **args)
    link = F.struct(F.lit("https://linkedin.com/in/ann").alias("url"), F.lit("in").alias("text"), F.when(F.col("ord") % 8 == 0, "Someone").otherwise("Ann Lee, CEO").alias("nearby_text"))
    first = F.col("page_no") == 1
    mails = F.when(first, F.array(F.lit("hi@acme.test"))).otherwise(F.array(F.lit("gone@acme.test"), F.lit("hi@acme.test")))
    sources = out["pages_"].withColumns({"kind": F.lit("first_party_html"), "usable": first | (F.col("ord") % 4 != 1), "links": F.when(first, F.array(link)).otherwise(F.array().cast(f"array<{E.LINK}>")), "email_candidates": mails})
    return {"sources": sources, **{k[:-1]: out[k] for k in ("claims_", "contacts_", "people_", "citations_")}}


def grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    commits = Commits(spark)
    t = {k: commits.step(k, v) for k, v in t.items()}
    return grounding.ground(t["claims"], t["citations"], t["people"], t["contacts"], t["sources"], lambda df, name: commits.step(f"of-{name}", df))


_SQ = f"trim(regexp_replace({{0}}, '{T.BLANK}', ' ', 'g'))"
_REL, _OUT = T.RELATIONSHIP, T.OUTSIDER
#: What the sources prove, in plain SQL.
GROUNDED = f"""
src as (select *, {_SQ.format("text")} as flat, page_no = 1 or ord % 4 <> 1 as usable from pages_),
resolved as (select c.ord, c.aspect, c.item, min(c.pos) as pos, {_SQ.format("c.excerpt")} as excerpt, s.source_id, s.final_url as source_url from citations_ c join src s on s.ord = c.ord and s.source_id = c.source_id and s.usable
  where length({_SQ.format("c.excerpt")}) between 3 and 600 and contains(s.flat, {_SQ.format("c.excerpt")}) group by all),
mails as (select ord, source_id, text, flat, unnest(case when page_no = 1 then ['hi@acme.test'] else ['gone@acme.test', 'hi@acme.test'] end) as email from src where usable),
shown as (select ord, source_id, email, {_SQ.format("coalesce(list_filter(string_split(text, chr(10)), lambda x: contains(x, email) and length(x) <= 600)[1], email)")} as excerpt from mails where contains(text, email)),
counted as (select c.ord, c.field, {_SQ.format("c.value")} as v, (select count(*) from citations_ x where x.ord = c.ord and x.aspect = c.field) as asked, (select count(*) from resolved x where x.ord = c.ord and x.aspect = c.field) as held,
  (select coalesce(bool_or(contains(lower(x.excerpt), lower({_SQ.format("c.value")}))), false) from resolved x where x.ord = c.ord and x.aspect = c.field) as named from claims_ c),
valid as (select ord, field, held, asked > 0 and held = asked and length(v) between 1 and 700 as whole, case when asked > 0 and held = asked and length(v) between 1 and 700 and (field <> 'company_name' or named) then v end as value,
  case when v is null then null when not (asked > 0 and held = asked and length(v) between 1 and 700) then field || ': missing/invalid source citation or unsupported value' when field = 'company_name' and not named then 'company_name: name is not observed in evidence' end as issue from counted),
flatc as (select ord, max(value) filter (where field = 'company_name') as company_name, max(value) filter (where field = 'overview_sentence_1') as s1, max(value) filter (where field = 'overview_sentence_2') as s2, max(value) filter (where field = 'target_audience') as target_audience,
  cast(coalesce(sum(held) filter (where field like 'overview%'), 0) as integer) as n_over from valid group by 1),
both_ as (select *, coalesce(len(regexp_extract_all(s1, '[.!?](?:\\s+|$)')) = 1 and right(s1, 1) in ('.', '!', '?') and len(regexp_extract_all(s2, '[.!?](?:\\s+|$)')) = 1 and right(s2, 1) in ('.', '!', '?'), false) as fine from flatc),
wide as (select ord, company_name, target_audience, case when fine then s1 || ' ' || s2 end as company_overview, case when not fine and (s1 is not null or s2 is not null) then 'company_overview: requires two supported single sentences ending in punctuation' end as overview_issue, case when fine then n_over else 0 end as overview_cited from both_),
said_contacts as (select c.ord, c.item, trim(lower(c.email)) as email, c.category, exists (select 1 from shown s where s.ord = c.ord and s.email = trim(lower(c.email))) and exists (select 1 from resolved r where r.ord = c.ord and r.aspect = 'contact' and r.item = c.item)
  and not exists (select 1 from resolved r where r.ord = c.ord and r.aspect = 'contact' and r.item = c.item and not contains(lower(r.excerpt), trim(lower(c.email)))) as ok from contacts_ c),
persons as (select p.ord, p.item, {_SQ.format("p.name")} as name, {_SQ.format("p.role")} as role, p.linkedin_url, 'https://www.linkedin.com/in/' || regexp_extract(p.linkedin_url, '/in/([^/]+)', 1) as profile, w.company_name from people_ p join wide w using (ord)),
proof as (select p.*,
  (select count(*) from resolved r join src s on s.ord = r.ord and s.source_id = r.source_id where r.ord = p.ord and r.item = p.item and r.aspect = 'relationship' and contains(lower(r.excerpt), lower(p.name)) and regexp_matches(r.excerpt, '{_REL}') and not regexp_matches(r.excerpt, '{_OUT}')
    and (coalesce(contains(lower(r.excerpt), lower(p.company_name)), false) or regexp_matches(r.excerpt, '{grounding.OWN_TEAM}')) and len(list_filter(string_split(s.text, chr(10)), lambda x: contains(lower(x), lower(p.name)) and regexp_matches(x, '{_OUT}'))) = 0) as n_rel,
  (select count(*) from resolved r where r.ord = p.ord and r.item = p.item and r.aspect = 'role' and contains(lower(r.excerpt), lower(p.name)) and contains(lower(r.excerpt), lower(p.role)) and not regexp_matches(r.excerpt, '{_OUT}')) as n_role,
  (select count(*) from resolved r where r.ord = p.ord and r.item = p.item and r.aspect = 'profile' and r.source_id = 'page-1' and p.profile = 'https://www.linkedin.com/in/ann' and contains(lower(r.excerpt), lower(p.name)) and contains(r.excerpt, 'https://linkedin.com/in/ann')
    and contains(lower(case when p.ord % 8 = 0 then 'Someone' else 'Ann Lee, CEO' end), lower(p.name))) as n_prof from persons p),
ranked_ as (select *, row_number() over (partition by ord, lower(name) order by item) as nth from proof where n_rel > 0),
accepted as (select ord, item, name, case when n_role > 0 then role end as role, case when n_prof > 0 then profile end as linkedin_url, case when n_prof > 0 then 'first_party_link' else 'not_found' end as linkedin_status, n_rel, n_role, n_prof, role as asked_role, linkedin_url as asked_url from ranked_ where nth = 1)
"""
ISSUES = """,
every as (select ord, case field when 'company_name' then 0 when 'overview_sentence_1' then 1 when 'overview_sentence_2' then 2 else 4 end as a, 0 as b, 0 as c, issue from valid where issue is not null
  union all select ord, 3, 0, 0, overview_issue from wide where overview_issue is not null union all select ord, 5, item, 0, 'contact_points: email was not observed with supporting evidence' from said_contacts where not ok
  union all select ord, 6, item, 0, 'team_members: ''' || name || ''' has an unsupported company relationship or external testimonial; omit this person unless valid company evidence exists' from proof where n_rel = 0
  union all select ord, 6, item, 1, 'team_members.role: ''' || name || ''' role not present in person-specific evidence; use an exact observed title or null' from accepted where asked_role <> '' and n_role = 0
  union all select ord, 6, item, 2, 'team_members.linkedin_url: ''' || name || ''' has no observed person/profile association; set linkedin_url to null and profile_evidence to []' from accepted where asked_url <> '' and n_prof = 0),
once as (select ord, issue, min((a, b, c)) as place from every group by 1, 2)
select w.ord, coalesce((select string_agg(issue, '|' order by place) from once o where o.ord = w.ord), '') as issues, array_to_string(list_sort(list_filter([case when company_name is not null then 'company_name' end, case when company_overview is not null then 'company_overview' end, case when target_audience is not null then 'target_audience' end], lambda x: x is not null)), ',') as fields from wide w
"""
#: Results: every third document's domain is none, page 2 of some is missing, a third page repeats the second, usage is reported for three of four.
ENRICHED = """
doms as (select ord, case when ord % 11 = 10 then null else 'acme.test' end as normalized_domain from base),
facts as (select d.ord, d.normalized_domain, w.company_name, w.company_overview, w.target_audience, d.ord % 10 <> 9 as completed,
  (select count(*) from accepted a where a.ord = d.ord) as n_people, (select count(*) from accepted a where a.ord = d.ord and a.role is not null) as n_roles, (select count(*) from accepted a where a.ord = d.ord and a.linkedin_url is not null) as n_prof,
  (select string_agg(concat_ws(':', a.name, a.role, a.linkedin_status), ',' order by a.item) from accepted a where a.ord = d.ord) as team,
  (select string_agg(e.email || ':' || e.category, ',' order by e.place) from (select s.email, min(case s.source_id when 'page-1' then 0 when 'page-2' then case s.email when 'gone@acme.test' then 1 else 2 end end) as place,
     coalesce((select arg_max(c.category, c.item) from said_contacts c where c.ord = d.ord and c.ok and c.email = s.email), 'other_business') as category from shown s where s.ord = d.ord group by s.email) e) as contacts,
  cast(3 as bigint) as attempted_pages, cast(case when d.ord % 4 = 1 then 1 else 3 end as bigint) as usable_pages, cast(case when d.ord % 4 = 1 then 0 else 1 end as bigint) as duplicate_pages from doms d join wide w using (ord)),
enriched as (select *, case when coalesce(company_overview, '') <> '' then 1.0::double else 0.0::double end as overview_supported, case when coalesce(target_audience, '') <> '' then 1.0::double else 0.0::double end as audience_supported, 1.0::double as contact_present,
  case when n_roles > 0 then 1.0::double else 0.0::double end as role_present, case when n_people > 0 then n_prof / n_people else 0 end::double as linkedin_fraction, (usable_pages / attempted_pages)::double as retrieval_fraction,
  round(0.25::double * overview_supported + 0.2::double * audience_supported + 0.15::double * contact_present + 0.2::double * role_present + 0.1::double * linkedin_fraction + 0.1::double * retrieval_fraction, 6) as confidence_score,
  case when company_overview <> '' and target_audience <> '' and completed and normalized_domain is not null then 'success' else 'partial' end as status,
  concat_ws(',', case when normalized_domain is null then 'invalid_domain:true' end, case when ord % 4 = 1 then 'http_404:false,http_404:false' end) as errors,
  case when ord % 4 = 3 then null else round((700 * 0.4 + 300 * 0.1 + 50 * 1.6) / 1000000, 10) end as estimated_llm_cost_usd,
  cast((company_name is not null)::integer + 2 * (company_overview is not null)::integer + (target_audience is not null)::integer + len(string_split(contacts, ',')) + n_people as integer) as supported from facts)
"""


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = Commits(spark)
    # The sources are stored once, with what is found.
    t = {k: v if k == "sources" else commits.step(k, v) for k, v in tables(spark, sf_dir).items()}
    s = t["sources"]
    found = s.unionByName(s.where("page_no = 2").withColumns({"page_no": F.lit(3), "source_id": F.lit("page-3")}))
    bad = ~F.col("usable")
    found = found.withColumns(
        {
            "requested_url": F.col("final_url"), "retrieval_method": F.lit("playwright"), "retrieved_at": F.lit(None).cast("timestamp"), "http_status": F.when(bad, 404).otherwise(200), "selection_reason": F.lit(""),
            "depth": F.when(F.col("page_no") == 1, 0).otherwise(1), "html_bytes": F.length("text").cast("long"), "cleaned_text_chars": F.length("text").cast("long"), "search_query": F.lit(None).cast("string"), "title": F.lit(""),
            "problem": F.when(bad, "http_404"), "retryable": F.lit(False), "material": F.lit(False), "duplicate": (F.col("page_no") == 3) & ~bad,
        }
    )
    found = commits.step("found", found)
    g = grounding.ground(t["claims"], t["citations"], t["people"], t["contacts"], E.quotable(found), lambda df, name: commits.step(f"of-{name}", df)).withColumn("completed", F.col("ord") % 10 != 9)
    g = commits.step("grounded", g)
    base = found.where("page_no = 1").select("ord")
    domains = base.select("ord", F.lit("Acme.test").alias("input_domain"), F.when(F.col("ord") % 11 != 10, "acme.test").alias("normalized_domain"))
    told = F.col("ord") % 4 != 3
    replies = base.select("ord", F.lit(1).alias("attempt"), F.lit("m-1-x").alias("model"), F.when(told, "r1").alias("response_id"), F.lit("q1").alias("request_id"), F.when(told, 1000).cast("long").alias("input_tokens"), F.lit(300).cast("long").alias("cached_input_tokens"), F.lit(50).cast("long").alias("output_tokens"))
    return E.enrich(domains, found, g, replies, pricing={"model": "m-1", "pricing_model": "m-1", "rates": (0.4, 0.1, 1.6)})


#: Each way to break a valid result: the rule that tells, and the change.
BREAKS = [
    ("source_ids_unique", {"sources": "concat(sources, sources)"}),
    ("contact_observed", {"contact_points": "transform(contact_points, c -> named_struct('email', 'no@acme.test', 'category', c.category, 'evidence', c.evidence, 'verification_status', c.verification_status))"}),
    ("evidence_resolves", {"field_evidence": "transform_values(field_evidence, (k, v) -> transform(v, e -> named_struct('source_id', e.source_id, 'excerpt', e.excerpt || '?', 'source_url', e.source_url)))"}),
    ("person_related", {"team_members": "transform(team_members, p -> struct('Zed' as name, cast(null as string) as role, cast(null as string) as linkedin_url, p.linkedin_status, p.relationship_evidence, p.role_evidence, p.profile_evidence, p.linkedin_candidates))"}),
    ("role_evidenced", {"team_members": "transform(team_members, p -> struct(p.name, 'Chief of Mars' as role, p.linkedin_url, p.linkedin_status, p.relationship_evidence, p.role_evidence, p.profile_evidence, p.linkedin_candidates))"}),
    ("profile_observed", {"team_members": "transform(team_members, p -> struct(p.name, p.role, 'https://www.linkedin.com/in/zed' as linkedin_url, p.linkedin_status, p.relationship_evidence, p.role_evidence, p.profile_evidence, p.linkedin_candidates))"}),
    ("field_evidenced", {"field_evidence": "map_filter(field_evidence, (k, v) -> false)"}),
    ("success_whole", {"target_audience": "cast(null as string)"}),
    ("success_clean", {"errors": f"array(cast(named_struct('stage', 'x', 'code', 'x', 'message', 'x', 'retryable', false, 'source_id', 'x', 'material', true) as {E.ERROR}))"}),
    ("score_recomputes", {"confidence_score": "confidence_score + 0.01D"}),
    ("breakdown_recomputes", {"confidence_breakdown": f"cast(named_struct('a', 0.5D, 'b', 1D, 'c', 1D, 'd', 1D, 'e', 1D, 'f', 1D, 'g', 'x') as {E.BREAKDOWN})"}),
    ("", {}),
]
#: Only results that are a success are broken. Where a change moves a factor, score and breakdown are wrong too.
MUTATED = f"""with {sql()}, {GROUNDED}, {ENRICHED}, whole as (select *, ord % {len(BREAKS)} as k from enriched where status = 'success'),
broken(k, rule) as (values {", ".join(f"({k}, '{rule}')" for k, (rule, _) in enumerate(BREAKS) if rule)}, (7, 'score_recomputes'), (7, 'breakdown_recomputes'))
select b.rule, w.ord from whole w join broken b on b.k = w.k
union all select unnest(['score_recomputes', 'breakdown_recomputes']), ord from whole where (k = 3 and role_present = 1) or (k = 4 and role_present = 0)"""


def mutated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successes, each broken in the way that its number tells."""
    whole = enriched(spark, sf_dir).where("status = 'success'")
    way, out = F.col("ord") % len(BREAKS), {}
    for k, (_, change) in enumerate(BREAKS):
        for c, x in change.items():
            out[c] = F.when(way == k, F.expr(x).cast(whole.schema[c].dataType)).otherwise(out.get(c, F.col(c)))
    return whole.withColumns(out)


#: People and what a search finds for them: profiles, other pages, titles too short, people of other companies.
_HITS = {
    "team": "select cast(doc_id as int) as ord, 0 as item, 'Ann Lee' as name, case when doc_id % 2 = 0 then 'https://www.linkedin.com/in/ann' end as linkedin_url from {docs} union all select cast(doc_id as int), 1, 'Bo Ray', null from {docs} union all select cast(doc_id as int), 2, 'Cy Ho', null from {docs}",
    "hits": "select ord, item, h as hit, case when (ord + h) % 5 = 0 then 'https://example.com/in/x' when (ord + h) % 5 < 3 then 'https://linkedin.com/in/p' || cast(item as string) || '/?trk=a' else 'https://www.linkedin.com/in/q' || cast(h as string) end as url, "
    "case when (ord + item + h) % 7 = 0 then 'ab' else upper(name) || ' - works' end as title, case when (ord + h) % 6 = 1 then 'elsewhere' else 'at acme' || cast(ord as string) end as content from team, {numbers}",
}
HITS = f"team as ({_HITS['team'].replace('{docs}', 'documents')}), hits as ({_HITS['hits'].replace('{numbers}', '(select unnest([1, 2, 3, 4]) as h) n')})"


def search_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    team = spark.sql(_HITS["team"], docs=spark.read.parquet(f"{sf_dir}/documents.parquet"))
    hits = spark.sql(_HITS["hits"].replace("from team, {numbers}", "from {team} cross join (select explode(array(1, 2, 3, 4)) as h) n"), team=team)
    ords = team.select("ord").distinct()
    return {"team": team, "hits": hits.withColumn("query", F.lit("q")), "companies": ords.select("ord", F.concat(F.lit("Acme"), F.col("ord").cast("string")).alias("company")), "fetched": ords.select("ord", F.lit(2).alias("n"))}
