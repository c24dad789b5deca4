"""The query catalogue: each query runs over the driver's tables or a literal fixture, most with DuckDB SQL beside it."""

from __future__ import annotations

from functools import reduce
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.functions import text as T
from evidra.functions import urls as U
from evidra.operators import audit, context, frontier, grounding, html, queue, robots, scoring
from evidra.plans import extract
from evidra.plans import fixtures as X
from evidra.settings import Settings
from evidra.sources import runs
from evidra.sources.commits import Commits
from evidra.streaming import frontier as stream
from evidra.streaming import usage as usage_stream

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_HOST = "regexp_replace(lower(regexp_extract(regexp_extract({0}, '^[a-z]+://([^/?#]*)', 1), '^(?:[^@]*@)?([^:]*)', 1)), '[.]+$', '')"
_PARAMS = "list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: {'k': url_decode(replace(regexp_extract(x, '^([^=]*)', 1), '+', ' ')), 'v': url_decode(replace(regexp_extract(x, '^[^=]*=?(.*)$', 1), '+', ' '))})"
_ENC = "replace(url_encode({0}), '%20', '+')"
_CANON = (
    "select page_id, url, concat(regexp_extract(url, '^([a-z]+)://', 1), '://', " + _HOST.format("url") + ", case when regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) = '' then '/' else regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) end, "
    "case when len(q) = 0 then '' else '?' || array_to_string(list_transform(q, lambda p: " + _ENC.format("p.k") + " || '=' || " + _ENC.format("p.v") + "), '&') end) as canonical from "
    "(select page_id, url, list_sort(list_filter(" + _PARAMS + ", lambda p: not starts_with(lower(p.k), 'utm_') and lower(p.k) not in ('gclid', 'fbclid', 'msclkid'))) as q from pages)"
)


@query(_CANON)
def q_canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", U.canonical_url(F.col("url")).alias("canonical"))


@query(f"select page_id, {_HOST.format('url')} as host from pages")
def q_host_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.normalize_domain(F.col("url")).alias("host"))


@query(f"select h as host, case when starts_with(h, 'www.') then substr(h, 5) else 'www.' || h end as alias, cast(count(*) as bigint) as pages from (select {_HOST.format('url')} as h from pages) group by 1, 2")
def q_aliases_scope(spark, sf_dir):
    h = U.host(F.col("url"))
    p = table(spark, sf_dir, "pages").where(U.in_scope(F.col("url"), h)).select(h.alias("host"))
    return p.groupBy("host").agg(F.count("*").alias("pages")).select("host", F.get(U.aliases(F.col("host")), F.lit(1)).alias("alias"), "pages")


@query("select p.k as parameter, cast(count(*) as bigint) as n from (select unnest(" + _PARAMS + ") as p from pages) where starts_with(lower(p.k), 'utm_') or lower(p.k) in ('gclid', 'fbclid', 'msclkid') group by 1")
def q_tracking_params(spark, sf_dir):
    each = table(spark, sf_dir, "pages").select(F.explode(U.parameters(U.part(F.col("url"), 4))).alias("p"))
    return each.where(U.is_tracking(F.col("p.k"))).groupBy(F.col("p.k").alias("parameter")).agg(F.count("*").alias("n"))


#: Addresses by number: profiles in several forms, and what only looks like one.
_PROFILES = "page_id, concat(case page_id % 8 when 0 then 'https://linkedin.com/in/p' when 1 then 'http://www.LinkedIn.com/in/p' when 2 then 'https://linkedin.com.evil.test/in/p' when 3 then 'https://www.linkedin.com/company/p' when 4 then 'https://de.linkedin.com/in/p' when 5 then '/in/p' when 6 then 'https://www.linkedin.com:443/in/p' else 'https://linkedin.com/in/a/p' end, page_id, case page_id % 3 when 0 then '/' when 1 then '?trk=x' else '' end) as url"


@query(f"select page_id, url, case when regexp_matches(url, '(?i)^https?://(?:www[.])?linkedin[.]com(?::443)?/in/[^/?#]+/?(?:[?#].*)?$') then 'https://www.linkedin.com/in/' || regexp_extract(url, '/in/([^/?#]+)', 1) end as profile from (select {_PROFILES} from pages)")
def q_profile_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").selectExpr("page_id", _PROFILES.removeprefix("page_id, ")).withColumn("profile", U.profile_url(F.col("url")))


@query("select page_id, cast(octet_length(encode(html)) as bigint) as html_bytes, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g')) as title from pages")
def q_html_bytes_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").cast("long").alias("html_bytes"), T.squeezed(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


_LINKS = f"""
l as (select {_HOST.format("url")} as host, url as page_url, regexp_extract(url, '^([a-z]+)://', 1) as scheme, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"[^>]*>[^<]*', 1)) as href, generate_subscripts(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"[^>]*>[^<]*', 1), 1) - 1 as pos, unnest(regexp_extract_all(html, '<a\\s[^>]*href="[^"]*"[^>]*>([^<]*)', 1)) as text from pages),
u as (select host, page_url, pos, text, case when starts_with(href, '/') then scheme || '://' || host || href end as url from l)
"""


@query(f"with {_LINKS} select host, page_url, cast(pos as integer) as pos, url, text from u")
def q_links(spark, sf_dir):
    return frontier.page_links(table(spark, sf_dir, "pages"))


@query("""
with l as (select doc_id, lower(regexp_extract_all(text, '(?i)(?:^|[^A-Za-z0-9_.+-])([A-Z0-9.!#$%&''*+/=?^_`{|}~-]+@[A-Z0-9.-]+\\.[A-Z]{2,63})', 1)::varchar)::varchar[] as e from documents)
select doc_id, array_to_string(list_sort(list_distinct(e)), ',') as emails from l where len(e) > 0
""")
def q_emails(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.emails(F.col("text")).alias("e"))
    return d.where(F.size("e") > 0).select("doc_id", F.array_join("e", ",").alias("emails"))


@query("""
with l as (select doc_id, lower(regexp_extract_all(text, '(?i)(?:^|[^A-Za-z0-9_.+-])([A-Z0-9.!#$%&''*+/=?^_`{|}~-]+@[A-Z0-9.-]+\\.[A-Z]{2,63})', 1)::varchar)::varchar[] as e from documents),
x as (select doc_id, unnest(list_distinct(e)) as email from l)
select doc_id, email, split_part(email, '@', 1) not in ('example', 'test', 'yourname', 'user', 'you') as owned from x
""")
def q_email_ownership(spark, sf_dir):
    """Addresses of documents taken as owned where the company host is their own domain, placeholders left out."""
    e = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.emails(F.col("text"))).alias("email"))
    host = F.split_part("email", F.lit("@"), F.lit(2))
    return e.withColumn("owned", F.size(T.owned(F.array("email"), U.aliases(host))) > 0)


_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
# The first stored page of each host stands for its root page.
_RANKED = f"""{_LINKS},
home as (select {_HOST.format("url")} as host, min(page_id) as page_id, arg_min(url, page_id) as page_url from pages group by 1),
p as (select *, {_PATH} as path, lower(regexp_replace({_PATH} || ' ' || text, '[/_\\-]', ' ', 'g')) as said from u),
ranked as (select host, page_url, pos, url, case when url is null or regexp_matches(path, '{frontier.EXCLUDED}') or regexp_matches(url, '{frontier.EXCLUDED}') then null
  when regexp_matches(said, '{frontier.LOW}') then 8 {" ".join(f"when regexp_matches(said, '{w}') then {n}" for n, w in frontier.RANKS)} else 6 end as priority from p)
"""
_CAPPED = f"""with {_RANKED},
hosts as (select distinct host from ranked),
once as (select host, url, priority, row_number() over (partition by host, url order by pos) as n from ranked semi join home using (host, page_url) where priority is not null and url <> 'https://' || host || '/'),
capped as (select host, url, priority, row_number() over (partition by host order by url) as n from once where n = 1),
known as (select host, 'https://' || host || '/' as url, 0 as priority, 0 as depth from hosts union all select host, url, priority, 1 from capped where n < @seen@),
room as (select host, count(*) as held from known group by host),
more as (select h.host, 'https://' || h.host || f.path as url, f.i from hosts h, (values {", ".join(f"({i}, '{x}')" for i, x in enumerate(frontier.FALLBACK))}) f(i, path)),
extra as (select m.host, m.url, row_number() over (partition by m.host order by m.i) as n from more m where not exists (select 1 from known k where k.host = m.host and k.url = m.url)),
whole as (select * from known union all select e.host, e.url, 5, 1 from extra e join room r on r.host = e.host where e.n + r.held <= @seen@),
numbered as (select *, cast(row_number() over (partition by host order by priority, depth, url) as integer) as page_no from whole)
select host, url, priority, depth, page_no from numbered where page_no <= 8"""


def _crawled(spark, sf_dir):
    """Links of the stored pages, the first page of each host taken as its root."""
    pages = table(spark, sf_dir, "pages")
    home = pages.groupBy(U.host(F.col("url")).alias("host")).agg(F.min_by("url", "page_id").alias("home"))
    links = frontier.page_links(pages).join(home, "host")
    return links.withColumn("page_url", F.when(F.col("page_url") == F.col("home"), F.concat(F.lit("https://"), "host", F.lit("/"))).otherwise(F.col("page_url"))).drop("home")


_TOPK = _CAPPED.replace("@seen@", str(frontier.SEEN))


#: Words put behind a link's path, by number.
_TAILS = ["team", "login", "blog/contact", "pricing", "a.pdf", "careers-x", "x", "our_people", "docs", "sales?cart=1"]
_RANKED_TAILS = _RANKED.replace("from u),\nranked", "from (select * replace (concat(url, '/', ['" + "', '".join(_TAILS) + f"'][cast((pos + length(url)) % {len(_TAILS)} as integer) + 1]) as url) from u)),\nranked")


@query(f"with {_RANKED_TAILS} select priority, cast(count(*) as bigint) as n from ranked group by 1")
def q_link_priority(spark, sf_dir):
    words = F.array(*map(F.lit, _TAILS))
    l = frontier.page_links(table(spark, sf_dir, "pages")).withColumn("url", F.concat("url", F.lit("/"), F.get(words, ((F.col("pos") + F.length("url")) % len(_TAILS)).cast("int"))))
    return l.withColumn("priority", frontier.priority(F.col("url"), F.col("text"))).groupBy("priority").agg(F.count("*").alias("n"))


@query(_TOPK)
def q_frontier_topk(spark, sf_dir):
    return frontier.select_pages(_crawled(spark, sf_dir))


@query(_CAPPED.replace("@seen@", "4"))
def q_seen_cap(spark, sf_dir):
    return frontier.select_pages(_crawled(spark, sf_dir), seen=4)


@query(_TOPK)
def q_frontier_best_first(spark, sf_dir):
    """The search over the same links: no stored page is a link's target, so depth 2 adds nothing to depth 1."""
    return frontier.best_first(_crawled(spark, sf_dir), max_depth=2)


# A host's pages as a site that links on: page 0 is its root, and page k is what link (k - 1) % 2 of page (k - 1) // 2 leads to.
_SITE = f"""with recursive {_LINKS.strip()},
numbered as (select url as page_url, {_HOST.format("url")} as host, row_number() over (partition by {_HOST.format("url")} order by page_id) - 1 as k from pages),
linked as (select n.host, n.k, u.pos, concat(u.url, '/', ['{"', '".join(_TAILS)}'][cast((u.pos + length(u.url)) % {len(_TAILS)} as integer) + 1]) as url, u.text from numbered n join u using (host, page_url)),
placed as (select host, k, 'https://' || host || '/' as page_url from numbered where k = 0 union all select n.host, n.k, p.url from numbered n join linked p on p.host = n.host and p.k = (n.k - 1) // 2 and p.pos = (n.k - 1) % 2 where n.k > 0),
held as (select host, page_url, min(k) as k from placed group by all),
site as (select h.host, h.page_url, l.pos, l.url, l.text from held h join linked l using (host, k)),
"""


def _site(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    no = F.row_number().over(Window.partitionBy("host").orderBy("page_id")) - 1
    numbered = pages.select("page_id", U.host(F.col("url")).alias("host"), F.col("url").alias("page_url")).withColumn("k", no)
    tails = F.array(*map(F.lit, _TAILS))
    url = F.concat("url", F.lit("/"), F.get(tails, ((F.col("pos") + F.length("url")) % len(_TAILS)).cast("int")))
    links = Commits(spark).step("links", frontier.page_links(pages))
    linked = links.join(numbered, ["host", "page_url"]).select("host", "k", "pos", url.alias("url"), "text")
    root = numbered.where("k = 0").select("host", "k", F.concat(F.lit("https://"), "host", F.lit("/")).alias("page_url"))
    up = linked.select("host", F.expr("2 * k + pos + 1").alias("k"), "pos", F.col("url").alias("page_url")).where("pos < 2").drop("pos")
    placed = root.unionByName(numbered.where("k > 0").select("host", "k").join(up, ["host", "k"]))
    held = placed.groupBy("host", "page_url").agg(F.min("k").alias("k"))
    return held.join(linked, ["host", "k"]).select("host", "page_url", "pos", "url", "text")


_STEP = f"""links as (select host, page_url, pos, url, case when regexp_matches(path, '{frontier.EXCLUDED}') then null when regexp_matches(said, '{frontier.LOW}') then 8
  {" ".join(f"when regexp_matches(said, '{w}') then {n}" for n, w in frontier.RANKS)} else 6 end as priority from
  (select *, {_PATH} as path, lower(regexp_replace({_PATH} || ' ' || text, '[/_\\-]', ' ', 'g')) as said from site)),
firsts as (select host, page_url, url, arg_min(priority, pos) as priority from links where priority is not null group by all)"""


def _site_sql(depth: int) -> str:
    """The search as a recursive query: a state is a host's number of pages so far, the URLs it knows and those it has taken."""
    return f"""{_SITE}
{_STEP},
search as (
  select distinct host, 0 as n, [{{'priority': 0, 'depth': 0, 'url': 'https://' || host || '/'}}] as open, ['https://' || host || '/'] as known, true as spare, null::struct(priority integer, depth integer, url varchar) as page from site
  union all
  select host, n + 1, list_filter(every, lambda x: x.url <> best.url), list_distinct(list_concat(known, list_transform(every, lambda x: x.url))), now_spare, best from (
    select host, n, known, every, now_spare, list_sort(every)[1] as best from (
      select host, n, known, list_concat(open, case when lacks then list_filter([{", ".join("{'priority': 5, 'depth': 1, 'url': 'https://' || host || '" + x + "'}" for x in frontier.FALLBACK)}], lambda x: not list_contains(known, x.url)) else [] end) as every, spare and not lacks as now_spare from (
        select s.host, s.n, list_distinct(list_concat(s.known, list_transform(f.new, lambda x: x.url))) as known, list_concat(s.open, f.new) as open, s.spare,
          s.spare and (len(list_concat(s.open, f.new)) = 0 or list_sort(list_concat(s.open, f.new))[1].priority >= 6) as lacks
        from search s, lateral (select coalesce(list({{'priority': f.priority, 'depth': s.page.depth + 1, 'url': f.url}}), []) as new from firsts f where f.host = s.host and f.page_url = s.page.url and s.page.depth < {depth} and not list_contains(s.known, f.url)) f
        where s.n < 8)) where len(every) > 0))
select host, page.url as url, page.priority as priority, page.depth as depth, n as page_no from search where n > 0"""


@query(_site_sql(3))
def q_frontier_deep(spark, sf_dir):
    """Best-first search to depth 3 where pages link on."""
    return frontier.best_first(_site(spark, sf_dir), max_depth=3)


@query(_site_sql(3))
def q_frontier_stream(spark, sf_dir):
    """The same search over the site's pages as they arrive, in batches by hash."""
    links = _site(spark, sf_dir)
    shown = links.groupBy("host", F.col("page_url").alias("url")).agg(F.array_sort(F.collect_list(F.struct("pos", "url", "text"))).alias("links"))
    events = shown.select("host", "url", F.lit(None).cast("string").alias("end"), frontier.offered(F.col("links"), F.col("host")).alias("offers"))
    return stream.searched(events, max_depth=3)


@query("select doc_id, sha256(text) as fingerprint, row_number() over (partition by source, text order by doc_id) > 1 as duplicate from documents")
def q_fingerprint_dedup(spark, sf_dir):
    return frontier.distinct_texts(table(spark, sf_dir, "documents"), "source", "doc_id", "text").select("doc_id", "fingerprint", "duplicate")


# Robots files by number: (group, agents, delays, rules), and the status of their answer.
_FILES = [
    (200, [(0, ["*"], ["2"], [(False, "/en/"), (True, "/en/1"), (False, "/*?page=")]), (1, ["evidra", "other"], ["5", "0.1"], [(False, "/fr/"), (True, "/fr/8"), (False, "/*x$")])]),
    (200, [(0, ["*", "slow"], ["1", "3", "nan"], [(False, "/"), (True, "/en/"), (True, "/de/"), (False, "/de/")]), (1, ["googlebot"], [], [(False, "/en/")])]),
    (404, []),
    (403, []),
    (503, []),
    (200, [(0, ["*"], [], [(False, "")]), (1, ["EVI"], ["7"], [(False, "/*/1"), (True, "/*/10")]), (2, ["*"], ["9"], [(False, "/")])]),
]


def _robots(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", U.origin(F.col("url")).alias("origin"))
    texts = []
    for status, groups in _FILES:
        lines = ["# a file", "Disallow: /before-any-agent"]
        for _, agents, delays, rules in groups:
            lines += [f"User-agent:\t{a}  # one" for a in agents] + [f"Crawl-delay: {d}" for d in delays] + [f"{'Allow' if ok else 'DISALLOW'} : {x}" for ok, x in rules]
        texts.append((len(texts), status, "\r\n".join(lines)))
    files = spark.createDataFrame(texts, "k int, status int, body string")
    origins = p.select("origin").distinct().withColumn("k", (F.length("origin") % len(_FILES)).cast("int"))
    return p, robots.parse(origins.join(files, "k"), "evidra")


_RULES = ", ".join(f"({k}, {g}, {any(a != '*' and a.lower() in 'evidra' for a in agents)}, {'*' in agents}, {allow}, '{x}')" for k, (_, groups) in enumerate(_FILES) for g, agents, _, rules in groups for allow, x in rules)
_GROUPS = ", ".join(f"({k}, {any(a != '*' and a.lower() in 'evidra' for a in agents)}, {'*' in agents}, {max([0.4, *[float(d) for d in delays if d != 'nan'][-1:]])})" for k, (_, groups) in enumerate(_FILES) for _, agents, delays, _ in groups)
_STATES = ", ".join(f"({k}, '{ {200: 'available', 404: 'missing', 403: 'denied'}.get(status, 'unavailable')}')" for k, (status, _) in enumerate(_FILES))
_ORIGINS = f"o as (select distinct regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) as origin, cast(length(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)) % {len(_FILES)} as integer) as k from pages), states(k, state) as (values {_STATES})"


@query(f"""
with {_ORIGINS}, r(k, g, specific, star, allow, pattern) as (values {_RULES}),
chosen as (select *, bool_or(specific) over (partition by k) as any_specific from r),
p as (select page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) as origin, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) as target from pages),
hits as (select p.page_id, arg_max(c.allow, length(replace(rtrim(c.pattern, '$'), '*', '')) * 2 + c.allow::integer) as allow from p join o using (origin) join chosen c on c.k = o.k and (c.specific or (not c.any_specific and c.star)) and c.pattern <> ''
  and regexp_matches(p.target, '^' || replace(replace(replace(c.pattern, '?', '[?]'), '.', '[.]'), '*', '.*')) group by 1)
select p.page_id, p.url, s.state as robots_state, case s.state when 'available' then coalesce(h.allow, true) when 'missing' then true else false end as allowed from p join o using (origin) join states s using (k) left join hits h using (page_id)
""")
def q_robots_allow(spark, sf_dir):
    p, rules = _robots(spark, sf_dir)
    return robots.allowed(p, rules).select("page_id", "url", "robots_state", "allowed")


# Rules by number for the hosts of the pages: literal paths, stars and ends.
_MANY = "concat(case n % 5 when 0 then '/' || {chr} when 1 then '/en/' || (n % 997) when 2 then '/*/' || (n % 89) || '$' when 3 then '/fr/' || (n % 61) || '*?page=' else '/de/' || (n % 7) || (n % 13) || '$' end)"


@query(f"""
with o as (select distinct regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) as origin from pages),
r as (select n, n % 3 = 0 as allow, {_MANY.replace("{chr}", "chr(cast(97 + (n // 5) % 26 as integer))")} as pattern from range(1000) t(n)),
p as (select page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) as target from pages)
select p.page_id, coalesce(arg_max(r.allow, length(replace(rtrim(r.pattern, '$'), '*', '')) * 2 + r.allow::integer), true) as allowed, cast(max(length(replace(rtrim(r.pattern, '$'), '*', ''))) as integer) as size
from p left join r on regexp_matches(p.target, '^' || replace(replace(r.pattern, '?', '[?]'), '*', '.*')) group by 1
""")
def q_robots_index(spark, sf_dir):
    """A thousand rules on every origin, met by their prefixes."""
    p = table(spark, sf_dir, "pages")
    target = F.regexp_extract("url", "^[a-z]+://[^/?#]*([^#]*)", 1)
    asked = p.select("page_id", U.origin(F.col("url")).alias("origin"), target.alias("target"))
    pattern = _MANY.replace("{chr}", "char(97 + (n div 5) % 26)")
    rules = F.expr(f"transform(sequence(0, 999), n -> named_struct('allow', n % 3 = 0, 'pattern', {pattern}))")
    robots_ = asked.select("origin").distinct().withColumn("rules", rules)
    best = robots.indexed(asked.select("origin", "target").distinct(), robots_)
    return asked.join(best, ["origin", "target"], "left").select("page_id", F.coalesce("best.allow", F.lit(True)).alias("allowed"), F.col("best.size").alias("size"))


@query(f"""with {_ORIGINS}, g(k, specific, star, delay) as (values {_GROUPS}), chosen as (select *, bool_or(specific) over (partition by k) as any_specific from g),
r(k, g, specific, star, allow, pattern) as (values {_RULES}), held as (select k, cast(count(*) as integer) as n from (select *, bool_or(specific) over (partition by k) as any_specific from r) where specific or (not any_specific and star) group by 1),
d as (select k, max(delay)::double as delay from chosen where specific or (not any_specific and star) group by 1)
select o.origin, s.state, coalesce(d.delay, 0.4::double) as delay, coalesce(h.n, 0) as rules from o join states s using (k) left join d using (k) left join held h using (k)""")
def q_robots_delay(spark, sf_dir):
    return _robots(spark, sf_dir)[1].select("origin", "state", "delay", F.size("rules").alias("rules"))


_ASKED = "select page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) as origin, cast(0.5 + length(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)) % 4 * 0.25 as double) as delay, cast(case when page_id % 5 = 0 then 1000 + page_id % 97 else 0 end as double) as not_before from pages"


@query(f"""with asked as ({_ASKED}), n as (select *, greatest(not_before, 1000 + delay) as base, row_number() over (partition by origin order by not_before, page_id) as k from asked)
select a.page_id, a.origin, max(b.base + (a.k - b.k) * a.delay) as start from n a join n b on a.origin = b.origin and b.k <= a.k group by all""")
def q_pacing(spark, sf_dir):
    """When each page may be asked for, were all asked for at 1000."""
    asked = spark.sql(_ASKED.replace("from pages", "from {pages}"), pages=table(spark, sf_dir, "pages"))
    return queue.paced(asked, 1000.0, order="page_id").select("page_id", "origin", "start")


@query(f"select page_id, {_HOST.format('url')} as host, cast(case when page_id % 11 in (2, 5, 7) then 2 else 1 end as integer) as attempt from pages")
def q_resumed_batches(spark, sf_dir):
    """Pages worked on in batches by a run that lost some of them, and by one that was resumed: what is committed is not made again."""
    todo, commits = table(spark, sf_dir, "pages").select("page_id", "url"), Commits(spark)
    made = lambda n: lambda t: t.select("page_id", U.host(F.col("url")).alias("host"), F.lit(n).alias("attempt"))
    form = "page_id long, host string, attempt int"
    commits.work("hosts", todo.where(~(F.col("page_id") % 11).isin(2, 5, 7)), ["page_id"], made(1), form, 3)
    return Commits(spark, commits.run_id).work("hosts", todo, ["page_id"], made(2), form, 2)


#: What a provider says to attempt a of page p, by (7 p + 3 a) % 6: code, whether it may pass, whether to mend it, and the wait that it asks for.
_TURNS = {0: (None, False, False, None), 1: ("rate_limit", True, False, "2"), 2: ("refusal", False, False, None), 3: ("incomplete_response", False, True, None), 4: (None, False, False, None), 5: ("provider_http_500", True, False, "30")}


@query("""with recursive r as (
  select page_id as ord, 0 as attempt, 0 as requests, false as repaired, 0.0::double as spent, null::varchar as code, false as done from pages
  union all
  select ord, attempt + 1, case when late then requests else requests + 1 end, repaired or mends, case when late then spent else s + case when waits then wait else 0 end end,
    case when late or (waits and overdue) then 'deadline_exceeded' when waits or mends then null else said end, late or not ((waits and not overdue) or mends) from (
    select *, 40 - spent < 0.05 as late, wait is not null and attempt < 3 as waits, coalesce(wait >= greatest(0, 40 - s), false) as overdue, k in (3, 4) and attempt < 3 and not repaired as mends from (
      select *, (7 * ord + 3 * attempt) % 6 as k, spent + 1 + ord % 3 as s, [null, 'rate_limit', 'refusal', 'incomplete_response', null, 'provider_http_500'][(7 * ord + 3 * attempt) % 6 + 1] as said,
        [null, 2, null, null, null, 30][(7 * ord + 3 * attempt) % 6 + 1] as wait from r where not done)))
select ord, cast(requests as integer) as requests, repaired, spent, code from r where done""")
def q_retries(spark, sf_dir):
    """Requests, waits and repairs of each page as a domain, by a provider whose answers are a table: rounds until nothing follows."""
    settings = Settings(max_llm_requests_per_domain=4, domain_budget_seconds=40.0)
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), F.lit("").alias("repair"), F.lit(0).alias("attempt"), F.lit(False).alias("repaired"), F.lit(0.0).alias("spent"))
    left, ends = queue.left(settings.domain_budget_seconds, F.col("spent")), []
    of = lambda i, kind: F.get(F.array(*(F.lit(t[i]).cast(kind) for t in _TURNS.values())), F.col("k"))
    for _ in range(settings.max_llm_requests_per_domain):
        ends.append(rows.where(left < queue.LEAST).select("ord", F.col("attempt").alias("requests"), "repaired", "spent", F.lit("deadline_exceeded").alias("code")))
        asked = rows.where(left >= queue.LEAST)
        told = asked.select("ord", ((F.col("ord") * 7 + F.col("attempt") * 3) % 6).cast("int").alias("k"))
        replies = told.select("ord", F.when(F.col("k").isin(0, 4), "{}").alias("parsed"), of(0, "string").alias("code"), of(1, "boolean").alias("retryable"), of(2, "boolean").alias("repairable"), of(3, "string").alias("retry_after"), (F.col("ord") % 3 + 1).cast("double").alias("took"))
        issues = told.where("k in (0, 4)").select("ord", F.when(F.col("k") == 4, F.array(F.lit("an issue"))).otherwise(F.array().cast("array<string>")).alias("issues"), F.lit("mend it").alias("mend"))
        met = extract.following(asked, replies, issues, settings, 1000.0)
        ends.append(met.where("not again").select("ord", F.col("next_attempt").alias("requests"), F.col("next_repaired").alias("repaired"), "spent", "code"))
        rows = met.where("again").select("ord", F.col("next_repair").alias("repair"), F.col("next_attempt").alias("attempt"), F.col("next_repaired").alias("repaired"), "spent")
    return reduce(DataFrame.unionByName, ends)


def _sources(spark, sf_dir):
    """Ten documents to a key; a tenth of them unusable, words of each category put in."""
    d = table(spark, sf_dir, "documents")
    said = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\nPublic email: a@b.test"))).when(F.col("doc_id") % 7 == 1, F.concat("text", F.lit("\nOur team has a Founder. Built for \"you\"."))).otherwise(F.col("text"))
    return d.select(F.expr("doc_id div 10").alias("ord"), F.col("doc_id").alias("source_id"), said.alias("text"), (F.col("doc_id") % 10 != 3).alias("usable"), F.lit("first_party_html").alias("kind"), F.concat(F.lit("https://a.test/"), "lang").alias("final_url"), F.col("lang").alias("title"), F.col("doc_id").alias("page_no"))


_CHUNKS = """
given as (select doc_id // 10 as ord, doc_id as source_id, lang, case doc_id % 7 when 0 then text || chr(10) || 'Public email: a@b.test' when 1 then text || chr(10) || 'Our team has a Founder. Built for "you".' else text end as text from documents where doc_id % 10 <> 3),
lines as (select ord, source_id, unnest(string_split(text, chr(10))) as p, generate_subscripts(string_split(text, chr(10)), 1) as line from given),
parts as (select ord, source_id, line, unnest(string_split(regexp_replace(p, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) as chunk, generate_subscripts(string_split(regexp_replace(p, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), 1) as part from lines),
firsts as (select *, row_number() over (partition by ord, source_id, chunk order by line, part) as n from parts where chunk <> ''),
chunks as (select ord, source_id, cast(row_number() over (partition by ord, source_id order by line, part) as integer) as pos, chunk,
  case when contains(lower(chunk), 'public email:') then 0 when regexp_matches(lower(chunk), 'founder|chief|profile link|our team') then 1 when regexp_matches(lower(chunk), 'built for|developers|teams|customers') then 2 else 3 end as category from firsts where n = 1)
"""


@query(f"with {_CHUNKS} select ord, source_id, pos, md5(chunk) as chunk, category from chunks")
def q_chunks(spark, sf_dir):
    return context.chunks(context.given(_sources(spark, sf_dir))).withColumn("chunk", F.md5("chunk"))


@query(f"with {_CHUNKS} select category, cast(count(*) as bigint) as n, cast(sum(length(chunk)) as bigint) as chars from chunks group by 1")
def q_chunk_category(spark, sf_dir):
    return context.chunks(context.given(_sources(spark, sf_dir))).groupBy("category").agg(F.count("*").alias("n"), F.sum(F.length("chunk")).alias("chars"))


@query(f"with {_CHUNKS}, nth as (select *, row_number() over (partition by ord, category, source_id order by pos) as k from chunks) select ord, source_id, pos, cast(row_number() over (partition by ord order by k, category, cast(source_id as varchar)) as integer) as turn from nth")
def q_round_robin(spark, sf_dir):
    return context.interleaved(context.chunks(context.given(_sources(spark, sf_dir)))).select("ord", "source_id", "pos", "turn")


_INDEX = """'{"sources": [' || string_agg('{"source_id": ' || to_json(cast(source_id as varchar)) || ', "url": ' || to_json('https://a.test/' || lang) || ', "title": ' || to_json(lang) || '}', ', ' order by source_id) || ']}'"""
_WORDS = "len(regexp_extract_all({0}, '[^ \\t\\n\\x0B\\f\\r]+')) + 1"
_LINE = """'{"source_id": ' || to_json(cast(source_id as varchar)) || ', "text": ' || to_json(chunk) || '}'"""


@query(f"""with {_CHUNKS}, nth as (select *, row_number() over (partition by ord, category, source_id order by pos) as k, {_LINE} as line from chunks),
turns as (select ord, line, row_number() over (partition by ord order by k, category, cast(source_id as varchar)) as turn, {_WORDS.format("line")} as t from nth),
heads as (select ord, {_INDEX} as line from given group by 1),
folded as (select ord, h.line as head, list_reduce(list_prepend({{'u': {_WORDS.format("h.line")}::bigint, 's': 0, 'd': 0, 't': 0::bigint, 'l': h.line}}, list({{'u': 0::bigint, 's': 0, 'd': 0, 't': t, 'l': turns.line}} order by turn)),
  lambda a, x: case when x.t <= {context.CHUNK_LIMIT} and a.u + x.t <= 3000 - 900 then {{'u': a.u + x.t, 's': a.s + 1, 'd': a.d, 't': x.t, 'l': a.l || chr(10) || x.l}} else {{'u': a.u, 's': a.s, 'd': a.d + 1, 't': x.t, 'l': a.l}} end) as f from turns join heads h using (ord) group by ord, h.line)
select ord, case when f.s > 0 then f.u else 0 end as context_tokens, 900 + case when f.s > 0 then f.u else 0 end as request_tokens, cast(f.s as bigint) as selected_chunks, cast(f.d as bigint) as dropped_chunks, case when f.s > 0 then md5(f.l) else md5('') end as text from folded""")
def q_context_budget(spark, sf_dir):
    """Contexts of 3000 words, 900 of which the instructions take."""
    words = lambda line: F.regexp_count(line, F.lit(r"\S+")).cast("long") + 1
    return context.assembled(_sources(spark, sf_dir), words, F.lit(900), 3000).withColumn("text", F.md5("text"))


@query(f"with {_CHUNKS} select ord, {_INDEX} as line from given group by 1")
def q_source_index(spark, sf_dir):
    return context.source_index(context.given(_sources(spark, sf_dir)))


_ENTITIES = "replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&quot;', chr(34)), '&#x27;', chr(39)), '&amp;', '&')"
# On regular pages the content is the article; text nodes lie between tags.
_CLEAN = f"""
p as (select page_id, url, html, {_HOST.format("url")} as host, trim(regexp_replace({_ENTITIES.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")}, '\\s+', ' ', 'g')) as title,
  string_split(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1), '(?s)<!--.*?-->|<[^>]*>', chr(1), 'g'), chr(1)) as nodes,
  [trim(regexp_replace(x, '\\s+', ' ', 'g')) for x in string_split(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(?:script|style)>', chr(1), 'g'), '(?s)<!--.*?-->|<[^>]*>', chr(1), 'g'), chr(1))] as seen from pages),
l as (select *, [title] || list_filter([trim(regexp_replace({_ENTITIES.format("x")}, '\\s+', ' ', 'g')) for x in flatten([string_split(n, chr(10)) for n in nodes])], lambda x: length(x) >= 3) as every from p),
t as (select page_id, url, html, host, title, seen, array_to_string(list_filter(every, lambda x, i: x <> '' and list_position(every, x) = i), chr(10)) as text from l),
clean as (select page_id, host, title, html, cast(octet_length(encode(html)) as bigint) as html_bytes, text, cast(length(text) as bigint) as cleaned_text_chars, length(text) >= 30 as usable, seen from t)
"""


@query(f"""with {_CLEAN} select page_id, title, html_bytes, cleaned_text_chars, usable, cast(len(regexp_extract_all(html, '<a\\s[^>]*href=')) as integer) as n_links,
coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(array_to_string(seen, ' '), '(?i)(?:^|[^A-Za-z0-9_.+-])([A-Z0-9.!#$%&''*+/=?^_`{{|}}~-]+@[A-Z0-9.-]+\\.[A-Z]{{2,63}})', 1), lambda x: lower(x)),
  lambda x: split_part(x, '@', 2) in (host, 'www.' || host, regexp_replace(host, '^www\\.', ''))))), ','), '') as emails, md5(text) as text_md5 from clean""")
def q_clean_pages(spark, sf_dir):
    c = html.clean(table(spark, sf_dir, "pages"))
    return c.select("page_id", "title", "html_bytes", "cleaned_text_chars", "usable", F.size("links").alias("n_links"), F.array_join("email_candidates", ",").alias("emails"), F.md5("text").alias("text_md5"))


_STATUS = "case when page_id % 7 = 0 then 404 when page_id % 11 = 0 then 403 else 200 end"
_BARE = "regexp_replace(regexp_replace(regexp_replace(html, '<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')"


#: Pages by number: missing ones, challenges and short ones among them.
_PROBLEMS = "case page_id % 5 when 1 then replace(html, '<title>', '<title>404 ') when 2 then concat('<title>Access denied</title><p>wait a moment, page ', page_id, '</p>') when 3 then '<p>tiny</p><script>of much script text that nobody reads</script>' else html end"


@query(f"""
with q as (select page_id, {_PROBLEMS} as html from pages),
p as (select page_id, {_STATUS} as status, lower(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g'))) as t, lower(trim({_BARE})) as v from q)
select page_id, status, case when status in (401, 403, 429) then 'access_blocked' when status >= 400 then 'http_' || status when regexp_matches(t, '{html.MISSING}') then 'soft_404'
  when length(v) < 3000 and (regexp_matches(t, '{html.BLOCKED}') or regexp_matches(v, '{html.CHALLENGE}')) then 'challenge' when length(v) < 30 then 'empty_content' end as problem from p""")
def q_content_problem(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("p", html.parse(F.expr(_PROBLEMS))).withColumn("status", F.when(F.col("page_id") % 7 == 0, 404).when(F.col("page_id") % 11 == 0, 403).otherwise(200))
    return p.select("page_id", "status", html.content_problem(F.col("p.title"), F.col("p.shown"), F.col("status")).alias("problem"))


#: References by number, and what they are against a page's URL: p its origin, f its folder, up the folder above, n its path.
_REFS = {
    "https://b.test/x": "'https://b.test/x'",
    "//c.test/p": "scheme || '://c.test/p'",
    "/a/./b/../c?x=/../": "p || '/a/c?x=/../'",
    "../up": "p || up || 'up'",
    "./here": "p || f || 'here'",
    "here/.": "p || f || 'here/'",
    "..": "p || up",
    "?q=1": "p || n || '?q=1'",
    "#f": "regexp_replace(url, '#.*$', '') || '#f'",
    "deep/er/../flat.html": "p || f || 'deep/flat.html'",
    "../../../../../../top#f/..": "p || '/top#f/..'",
}


@query(f"""with u as (select page_id, url, regexp_extract(url, '^([a-z]+):', 1) as scheme, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) as p, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as n from pages),
d as (select *, regexp_replace(case when n = '' then '/' else n end, '[^/]*$', '') as f from u), e as (select *, regexp_replace(f, '[^/]+/$', '') as up from d)
select page_id, case page_id % {len(_REFS)} {" ".join(f"when {k} then '{h}'" for k, h in enumerate(_REFS))} end as href, case page_id % {len(_REFS)} {" ".join(f"when {k} then {x}" for k, x in enumerate(_REFS.values()))} end as url from e""")
def q_resolve_url(spark, sf_dir):
    """References of many forms against the URLs of the pages."""
    href = F.get(F.array(*map(F.lit, _REFS)), (F.col("page_id") % len(_REFS)).cast("int"))
    return table(spark, sf_dir, "pages").withColumn("href", href).select("page_id", "href", U.resolved(F.col("href"), F.col("url")).alias("url"))


#: Blocks put into the pages, by number: what of them a page of zqx.test comes to say, its own addresses, and what stands beside its links.
_BLOCKS = [
    ('<script type="application/ld+json">{"name":"zqx Labs","other":1,"employee":[{"name":"zqx A","age":3}],"url":"https://zqx.test/"}</script>', ['JSON-LD: [{"name": "zqx Labs", "employee": [{"name": "zqx A"}], "url": "https://zqx.test/"}]'], [], []),
    ('<script type="application/ld+json">{"@graph":[{"name":"zqx","email":5}]}</script><script type="application/ld+json">{zqx broken</script>', ['JSON-LD: [{"name": "zqx", "email": null}]'], [], []),
    ('<meta name="description" content="zqx says"><meta name="keywords" content="zqx no"><meta property="og:site_name" content="zqx site">', ["Metadata: zqx says", "Metadata: zqx site"], [], []),
    ('<div style="DISPLAY : none">zqx hidden</div><p style="visibility:hidden">zqx hidden</p><p>zqx shown</p>', ["zqx shown"], [], []),
    ('<div class="site-cookie-banner">zqx cookies</div><div id="consent_banner">zqx no</div><p hidden>zqx no</p><p aria-hidden="true">zqx no</p><svg>zqx no</svg><p>zqx rest</p>', ["zqx rest"], [], []),
    ('<p>zqx words that stand beside <a href="/zqx">it</a></p>', ["zqx words that stand beside"], [], ["zqx words that stand beside it"]),
    ('<p>zqx write to all of us here <a href="mailto:ZQX@zqx.test?cc=no@zqx.test">zqx mail</a></p>', ["zqx write to all of us here", "zqx mail", "Public email: zqx@zqx.test | zqx write to all of us here zqx mail"], ["zqx@zqx.test"], []),
    ("<p>zqx reach zqx@zqx.test now</p>", ["zqx reach zqx@zqx.test now", "Public email: zqx@zqx.test"], ["zqx@zqx.test"], []),
    ("<p>zqx for example zqx@zqx.test only</p>", ["zqx for example zqx@zqx.test only"], [], []),
    ("<p>zqx mail zqx@zqx.test</p><pre>zqx@zqx.test</pre>", ["zqx mail zqx@zqx.test"], [], []),
    ('<p>zqx profile of someone here <a href="https://linkedin.com/in/zqx">Zed</a></p>', ["zqx profile of someone here", "Observed profile link: https://linkedin.com/in/zqx | zqx profile of someone here Zed"], [], ["zqx profile of someone here Zed"]),
    ("<nav>zqx nav</nav><form>zqx form</form><header>zqx head</header><pre>zqx pre</pre><p>zqx kept</p>", ["zqx kept"], [], []),
    ("<p>zqx to user@zqx.test other@else.test info@www.zqx.test</p>", ["zqx to user@zqx.test other@else.test info@www.zqx.test", "Public email: info@www.zqx.test"], ["info@www.zqx.test"], []),
]
#: Words between a block and the page, as many as keep an example that the page itself speaks of away from the block's addresses.
_APART = "<p>" + "apart " * (html.MARGIN // 5) + "</p>"
_OF_BLOCKS = ", ".join("({}, '{}', '{}', '{}')".format(k, "|".join(t), ",".join(e), "|".join(n)) for k, (_, t, e, n) in enumerate(_BLOCKS))


@query(f"with w(k, said, emails, beside) as (values {_OF_BLOCKS}) select page_id, said, emails, beside from pages join w on k = page_id % {len(_BLOCKS)}")
def q_html_blocks(spark, sf_dir):
    """Linked data, meta elements, what is hidden, boilerplate, surroundings of links, and addresses of every kind, in blocks put into the pages."""
    block = F.get(F.array(*(F.lit(_APART + b + _APART) for b, *_ in _BLOCKS)), (F.col("page_id") % len(_BLOCKS)).cast("int"))
    put = table(spark, sf_dir, "pages").withColumn("html", F.replace("html", F.lit("<article>"), F.concat(F.lit("<article>"), block)))
    p = html.clean(put, host=F.lit("zqx.test"))
    said = F.filter(F.split("text", "\n"), lambda x: x.contains("zqx"))
    beside = F.transform(F.filter("links", lambda x: x["url"].contains("zqx")), lambda x: x["nearby_text"])
    return p.select("page_id", F.array_join(said, "|").alias("said"), F.array_join("email_candidates", ",").alias("emails"), F.array_join(beside, "|").alias("beside"))


_CODES = "case page_id % 5 when 0 then 'http_404' when 1 then 'http_500' when 2 then 'soft_404' when 3 then 'challenge' else 'http_410' end"


@query(f"select page_id, page_id % 3 = 0 or (page_id % 8 < 5 and {_CODES} not in ('http_404', 'http_410', 'soft_404')) as material from pages")
def q_error_materiality(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", scoring.material(F.col("page_id") % 3, F.col("page_id") % 8, F.expr(_CODES)).alias("material"))


@query("select doc_id, len(regexp_extract_all(text, '[.!?](?:\\s+|$)')) = 1 and right(text, 1) in ('.', '!', '?') as single from documents")
def q_single_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.single_sentence(F.col("text")).alias("single"))


@query(f"with {_CLEAN} select host as ord, cast(count(*) as bigint) as attempted_pages, cast(count(*) filter (where usable) as bigint) as usable_pages, cast(sum(html_bytes) as bigint) as html_bytes, cast(sum(cleaned_text_chars) as bigint) as cleaned_text_chars from clean group by 1")
def q_crawl_stats(spark, sf_dir):
    s = html.clean(table(spark, sf_dir, "pages")).select(U.host(F.col("url")).alias("ord"), F.lit("first_party_html").alias("kind"), "usable", "html_bytes", "cleaned_text_chars")
    return scoring.crawl_stats(s)


_REPLY = "select conv_id as ord, turn, case when turn % 5 = 4 then null else length(text) end as input_tokens, case when turn % 5 <> 4 then length(text) // 2 end as cached, case when turn % 5 <> 4 then length(role) end as output_tokens, case when role = 'user' then 'm-1' else 'm-1-x' end as model, case when turn % 3 <> 1 then 'r' || turn end as response_id from conversations"
_USAGE = f"""select ord, cast(coalesce(sum(input_tokens), 0) as bigint) as input_tokens, cast(coalesce(sum(cached), 0) as bigint) as cached_input_tokens, cast(coalesce(sum(output_tokens), 0) as bigint) as output_tokens, cast(count(*) as bigint) as request_count,
cast(count(input_tokens) as bigint) as reported_response_count, coalesce(string_agg(response_id, ',' order by turn), '') as response_ids, '' as request_ids, array_to_string(list_filter(list(model order by turn, model), lambda x, i: list_position(list(model order by turn, model), x) = i), ',') as models, bool_and(input_tokens is not null) as accounting_complete from ({_REPLY}) group by 1"""


def _replies(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("ord"), F.when(F.col("turn") % 5 != 4, F.length("text")).alias("input_tokens"), F.floor(F.length("text") / 2).alias("cached_input_tokens"), F.length("role").alias("output_tokens"), F.when(F.col("role") == "user", "m-1").otherwise("m-1-x").alias("model"), F.col("turn").alias("attempt"), F.when(F.col("turn") % 3 != 1, F.concat(F.lit("r"), F.col("turn").cast("string"))).alias("response_id"), F.lit("").alias("request_id"))


def _usage(spark, sf_dir):
    return scoring.usage(_replies(spark, sf_dir))


@query(_USAGE)
def q_usage_rollup(spark, sf_dir):
    return _usage(spark, sf_dir).withColumns({c: F.array_join(c, ",") for c in ("models", "response_ids", "request_ids")})


@query(_USAGE)
def q_usage_stream(spark, sf_dir):
    """The same from three batches of a stream, the second of which repeats a third of the first and the third a third of all."""
    r = _replies(spark, sf_dir).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("attempt")))
    third = F.pmod(F.xxhash64("ord", "attempt"), F.lit(3))
    batches = F.array_compact(F.array(third, F.when(third == 0, F.lit(1)), F.when((F.col("ord") + F.col("attempt")) % 3 == 0, F.lit(2))))
    told = usage_stream.rolled_up(r.withColumn("batch", F.explode(F.array_distinct(batches))), "batch")
    return told.withColumns({c: F.array_join(c, ",") for c in ("models", "response_ids", "request_ids")})


@query(f"select ord, case when reported_response_count > 0 then round(((input_tokens - cached_input_tokens) * 0.4 + cached_input_tokens * 0.1 + output_tokens * 1.6) / 1000000, 10) end as estimated_llm_cost_usd, case when reported_response_count = 0 then '{scoring.REASONS['silent']}' when accounting_complete then '{scoring.REASONS['whole']}' else '{scoring.REASONS['part']}' end as cost_reason from ({_USAGE})")
def q_cost(spark, sf_dir):
    return scoring.cost(_usage(spark, sf_dir), "m-1", "m-1", (0.4, 0.1, 1.6)).select("ord", "estimated_llm_cost_usd", "cost_reason")


@query(f"with h as (select distinct {_HOST.format('url')} as host from pages) select 'required_missing' as rule, cast(null as integer) as ord, host as detail from h where length(host) % 5 = 0")
def q_required_set_equality(spark, sf_dir):
    h = table(spark, sf_dir, "pages").select(U.normalize_domain(F.col("url")).alias("input_domain")).distinct()
    r = h.where(F.length("input_domain") % 5 != 0).select(F.lit(1).alias("ord"), "input_domain", F.col("input_domain").alias("normalized_domain"))
    return audit.required(r, h)


_G = f"with {X.sql()}, {X.GROUNDED}"


def _joined(items, *parts):
    return F.array_join(F.transform(items, lambda x: F.concat_ws(":", *(p(x) for p in parts))), ",")


@query(f"{_G} select ord, aspect, item, excerpt, source_url from resolved")
def q_resolve(spark, sf_dir):
    t = X.tables(spark, sf_dir)
    return grounding.resolve(t["citations"], t["sources"]).select("ord", "aspect", "item", "excerpt", "source_url")


@query(f"{_G} select ord, email, excerpt, source_id from shown")
def q_observed_contacts(spark, sf_dir):
    e = grounding.observed_contacts(X.tables(spark, sf_dir)["sources"]).select("ord", "email", F.explode("evidence").alias("e"))
    return e.select("ord", "email", "e.excerpt", "e.source_id")


@query(f"{_G} select ord, field, value, cast(case when value is null then 0 else held end as integer) as evidence, issue from valid")
def q_claim_valid(spark, sf_dir):
    t = X.tables(spark, sf_dir)
    return grounding.valid_claims(t["claims"], t["citations"], t["sources"]).withColumn("evidence", F.coalesce(F.size("evidence"), F.lit(0)))


@query(f"{_G} select ord, company_overview, overview_issue, overview_cited from wide")
def q_overview(spark, sf_dir):
    t = X.tables(spark, sf_dir)
    c = grounding.core(grounding.valid_claims(t["claims"], t["citations"], t["sources"]))
    return c.select("ord", "company_overview", "overview_issue", F.coalesce(F.size(F.try_element_at("field_evidence", F.lit("company_overview"))), F.lit(0)).alias("overview_cited"))


@query(f"{_G} select s.ord, s.email, coalesce(arg_max(c.category, c.item) filter (where c.ok and c.email = s.email), 'other_business') as category, cast(count(c.item) filter (where not c.ok) as integer) as issues from (select distinct ord, email from shown) s left join said_contacts c on c.ord = s.ord group by 1, 2")
def q_contact_categories(spark, sf_dir):
    t = X.tables(spark, sf_dir)
    out, issues = grounding.contact_categories(grounding.observed_contacts(t["sources"]), t["contacts"], t["citations"], t["sources"])
    n = issues.groupBy("ord").agg(F.count("*").cast("int").alias("issues"))
    return out.join(n, "ord", "left").select("ord", "email", "category", F.coalesce("issues", F.lit(0)).alias("issues"))


@query(f"{_G} select ord, item, name, role, linkedin_url, linkedin_status, cast(n_rel as integer) as n_rel, cast(case when role is null then 0 else n_role end as integer) as n_role, cast(case when linkedin_url is null then 0 else n_prof end as integer) as n_prof from accepted")
def q_people_grounding(spark, sf_dir):
    t = X.tables(spark, sf_dir)
    commits = Commits(spark)
    keep = lambda df, name: commits.step(name, df) if name == "resolved" else df
    p, _ = grounding.named_people(t["claims"], t["citations"], t["people"], t["sources"], keep)
    return p.select("ord", "item", "name", "role", "linkedin_url", "linkedin_status", F.size("relationship_evidence").alias("n_rel"), F.size("role_evidence").alias("n_role"), F.size("profile_evidence").alias("n_prof"))


@query(f"{_G} {X.ISSUES}")
def q_issues(spark, sf_dir):
    g = X.grounded(spark, sf_dir)
    return g.select("ord", F.array_join("issues", "|").alias("issues"), F.array_join(F.array_sort(F.map_keys("field_evidence")), ",").alias("fields"))


@query(f"{_G}, {X.ENRICHED} select ord, normalized_domain, status, company_name, company_overview, target_audience, contacts, team, attempted_pages, usable_pages, duplicate_pages, confidence_score, errors, estimated_llm_cost_usd, supported from enriched")
def q_enrich(spark, sf_dir):
    e = X.enriched(spark, sf_dir)
    contacts = _joined("contact_points", lambda x: x["email"], lambda x: x["category"])
    team = _joined("team_members", lambda x: x["name"], lambda x: x["role"], lambda x: x["linkedin_status"])
    counts = [F.col(f"crawl.{c}").alias(c) for c in ("attempted_pages", "usable_pages", "duplicate_pages")]
    errors = _joined("errors", lambda x: x["code"], lambda x: x["material"].cast("string"))
    return e.select("ord", "normalized_domain", "status", "company_name", "company_overview", "target_audience", contacts.alias("contacts"), team.alias("team"), *counts, "confidence_score", errors.alias("errors"), F.col("usage.estimated_llm_cost_usd").alias("estimated_llm_cost_usd"), grounding.supported_count(e).alias("supported"))


@query(f"{_G}, {X.ENRICHED} select ord, status, confidence_score, overview_supported, audience_supported, contact_present, role_present, linkedin_fraction, retrieval_fraction from enriched")
def q_confidence(spark, sf_dir):
    short = ["overview_supported", "audience_supported", "contact_present", "role_present", "linkedin_fraction", "retrieval_fraction"]
    return X.enriched(spark, sf_dir).select("ord", "status", "confidence_score", *(F.col(f"confidence_breakdown.{k}").alias(a) for k, a in zip(scoring.WEIGHTS, short, strict=True)))


@query(f"{_G}, {X.ENRICHED} select ord % 3 as part, strict, cast(case when strict then (case when bool_and(status = 'success') then 0 else 1 end) else (case when bool_or(status <> 'failed') then 0 else 1 end) end as integer) as exit_code from enriched, (select unnest([true, false]) as strict) group by 1, 2")
def q_exit_code(spark, sf_dir):
    e = X.enriched(spark, sf_dir).withColumn("part", F.col("ord") % 3)
    codes = [scoring.exit_code(e, strict, "part").withColumn("strict", F.lit(strict)) for strict in (True, False)]
    return codes[0].unionByName(codes[1])


@query(X.MUTATED)
def q_audit_rules(spark, sf_dir):
    """The general rules over enriched rows, each broken in one way by its number."""
    return audit.audit(X.mutated(spark, sf_dir)).select("rule", "ord").distinct()


@query(f"""{_G}, {X.ENRICHED} select 'all_success' as rule, ord, status as detail from enriched where status <> 'success' union all select 'browser_source', ord, normalized_domain from enriched where usable_pages = 0
union all select 'usage_recorded', ord, normalized_domain from enriched where ord % 4 = 3 union all select 'live_complete', null, 'demo'""")
def q_audit_live(spark, sf_dir):
    run = spark.createDataFrame([("demo", True)], "mode string, complete boolean")
    return audit.live(X.enriched(spark, sf_dir), run)


#: Ways to break the text of a run, by number: a change of the text, and the misfit that it is. The first is none.
_MISFITS = [
    ("text", None, None),
    ("replace(text, '\"complete\":true', '\"complete\":\"yes\"')", "run.complete", "kind"),
    ("replace(text, '\"schema_version\":\"1.0\",', '')", "run.schema_version", "missing"),
    ("replace(text, '\"input_domain\":', '\"other\":1,\"input_domain\":')", "run.results[]", "unknown"),
    ("regexp_replace(text, '\"status\":\"(success|partial|failed)\"', '\"status\":\"fine\"')", "run.results[].status", "value"),
    ("replace(text, '\"warnings\":[\"w\"]', '\"warnings\":[null]')", "run.warnings[]", "null"),
    ("replace(text, '\"warnings\":[\"w\"]', '\"warnings\":[NaN]')", "run", "json"),
    ("substring(text, 1, 40)", "run", "json"),
    ("replace(text, '+00:00', ' UTC')", "run.started_at", "value"),
    ("regexp_replace(text, '\"input_tokens\":[0-9]+', '\"input_tokens\":-1')", "run.results[].usage.input_tokens", "value"),
    ("regexp_replace(text, '\"request_count\":[0-9]+', '\"request_count\":1.5')", "run.results[].usage.request_count", "kind"),
]
_WAYS = ", ".join(f"({k}, '{at}', '{rule}')" for k, (_, at, rule) in enumerate(_MISFITS) if at)


@query(f"with {X.sql()}, ways(k, place, rule) as (values {_WAYS}) select b.ord, w.place, w.rule from base b join ways w on w.k = b.ord % {len(_MISFITS)}")
def q_strict_load(spark, sf_dir):
    """Runs of one result each as JSON, each broken in one way by its number, walked against the closed schema."""
    e = X.enriched(spark, sf_dir)
    form = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timeZone": "UTC"}
    row = e.select("ord", F.to_json(F.struct(*(c for c in e.columns if c != "ord")), form).alias("j"))
    head = '{"schema_version":"1.0","run_id":"r","mode":"live","started_at":"2026-01-01T00:00:00+00:00","finished_at":null,"model":"m","complete":true,"warnings":["w"],"configuration":{"any":[1]},"results":['
    texts = row.select("ord", F.concat(F.lit(head), "j", F.lit("]}")).alias("text"))
    way = (F.col("ord") % len(_MISFITS)).cast("int")
    broken = F.coalesce(*(F.when(way == k, F.expr(x)) for k, (x, _, _) in enumerate(_MISFITS)))
    found = runs.misfits(texts.select(F.col("ord").alias("id"), broken.alias("text")))
    return found.select(F.col("id").alias("ord"), F.col("at").alias("place"), "rule")


@query("with a as (select doc_id // 4 as ord, cast(doc_id % 4 as integer) as attempt, cast(n_chars % 5 as integer) as supported, cast(n_chars % 3 as integer) as issues from documents) select ord, arg_max(attempt, (issues = 0)::integer * 1000 + supported * 10 + attempt) as attempt from a group by 1")
def q_best_attempt(spark, sf_dir):
    a = table(spark, sf_dir, "documents").selectExpr("doc_id div 4 as ord", "cast(doc_id % 4 as int) as attempt", "cast(n_chars % 5 as int) as supported", "cast(n_chars % 3 as int) as issues")
    return grounding.best_attempt(a)


@query(f"""with {X.HITS}, t as (select * from (select *, row_number() over (partition by ord order by item) as k from team where linkedin_url is null) where k <= 2),
h as (select *, row_number() over (partition by ord, item order by hit) as k from hits),
sound as (select h.ord, h.item, h.hit, h.url, h.title, h.content, t.name, 'Acme' || h.ord as company, 'https://www.linkedin.com/in/' || regexp_extract(h.url, '^https://(?:www[.])?linkedin[.]com/in/([^/?#]+)/?(?:[?#].*)?$', 1) as profile,
  row_number() over (partition by h.ord order by h.item, h.hit) as k2 from h join t using (ord, item) where h.k <= 3 and regexp_matches(h.url, '^https://(?:www[.])?linkedin[.]com/in/[^/?#]+/?(?:[?#].*)?$') and length(h.title) between 3 and 600 and length(h.content) <= 10000),
c as (select *, row_number() over (partition by ord, item, profile order by hit) as once from sound where contains(lower(title || chr(10) || content), lower(name)) and contains(lower(title || chr(10) || content), lower(company)))
select ord, cast(item as integer) as item, profile as url, 'search-' || (2 + k2) as source_id, title as excerpt, 'search_candidate' as status from c where once = 1""")
def q_search_candidates(spark, sf_dir):
    t = X.search_tables(spark, sf_dir)
    _, c = grounding.search_candidates(grounding.search_targets(t["team"]), t["hits"], t["companies"], t["fetched"])
    return c.select("ord", "item", "url", F.get("evidence", F.lit(0))["source_id"].alias("source_id"), F.get("evidence", F.lit(0))["excerpt"].alias("excerpt"), "status")
