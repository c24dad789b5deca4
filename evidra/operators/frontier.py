"""Link ranking and the crawl frontier."""

from __future__ import annotations

import heapq
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import urls as U

# Paths that are never followed, and words by rank.
EXCLUDED = r"(?i)(?:^|[/_\-])(?:login|log-in|signin|sign-in|signup|sign-up|register|checkout|logout|delete|unsubscribe|cart|download|auth)(?:[/_\-?]|$)|\.(?:pdf|zip|exe|dmg|png|jpg|jpeg|gif|webp|mp4|csv|xml)$"
LOW = r"\b(blog|docs|documentation|changelog|news|legal|privacy|terms)\b"
RANKS = [
    (1, r"\b(about|company|team|founders?|leadership|our people)\b"),
    (2, r"\b(contact|support|sales)\b"),
    (3, r"\b(product|solutions?|customers?|pricing|platform)\b"),
    (4, r"\b(careers?|jobs)\b"),
]
# Pages tried where links say little, and how many URLs of a host are remembered.
FALLBACK = ["/about", "/company", "/team", "/contact", "/pricing"]
SEEN = 300
# From this rank on a link says little, and the rank of a fallback.
POOR, SPARE = 6, 5


def priority(url: Column, text: Column) -> Column:
    """Rank of a link, lower first; null if it is excluded."""
    path = U.part(url, 3)
    said = F.lower(F.regexp_replace(F.concat_ws(" ", path, text), r"[/_\-]", " "))
    rank = F.when(said.rlike(LOW), 8)
    for n, words in RANKS:
        rank = rank.when(said.rlike(words), n)
    return F.when(~path.rlike(EXCLUDED) & ~url.rlike(EXCLUDED), rank.otherwise(6))


def page_links(pages: DataFrame) -> DataFrame:
    """(host, page_url, pos, url, text) by native extraction of href attributes."""
    tag = r'<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)'
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(tag), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(tag), F.lit(2)).alias("text"))
    each = pages.select(U.host(F.col("url")).alias("host"), F.col("url").alias("page_url"), F.posexplode(found).alias("pos", "l"))
    return each.select("host", "page_url", "pos", U.canonical_url(U.resolved(F.col("l.href"), F.col("page_url"))).alias("url"), F.col("l.text").alias("text"))


def select_pages(links: DataFrame, max_pages: int = 8, seen: int = SEEN, hosts: DataFrame | None = None) -> DataFrame:
    """The first max_pages of each host at depth 1: its root, ranked links in scope, and fallbacks.

    Only links of the root page count, as a search of depth 1 follows no others. Links of one URL count once,
    with the first anchor's rank; at most seen URLs are remembered, in URL order. links: host, page_url (canonical), pos (from
    0 on each page), url, text. hosts (host): those to select for, by default those of links. Rows without host are left out.

    One pass over links: root and fallbacks ride along with the first link of each page and meet the
    links in one aggregation by URL. Only seen + 5 rows of a host then go to the windows by host.
    """
    kind = "struct<pos:int,text:string>"
    own = [F.struct(F.concat(F.lit("https://"), "host", F.lit(path)).alias("url"), F.lit(i).alias("special"), F.lit(None).cast(kind).alias("link")) for i, path in enumerate(["/", *FALLBACK])]
    link = F.struct("url", F.lit(None).cast("int").alias("special"), F.struct(F.col("pos").cast("int").alias("pos"), "text").alias("link"))
    of_root = F.when(F.col("page_url") == F.concat(F.lit("https://"), "host", F.lit("/")), F.array(link)).otherwise(F.array().cast(f"array<struct<url:string,special:int,link:{kind}>>"))
    first = F.array(*own) if hosts is None else F.array().cast(f"array<struct<url:string,special:int,link:{kind}>>")
    offers = F.concat(of_root, F.when(F.col("pos") == 0, first).otherwise(F.array().cast(f"array<struct<url:string,special:int,link:{kind}>>")))
    offered = links.where("host is not null").select("host", F.explode(offers).alias("o"))
    if hosts is not None:
        offered = offered.unionByName(hosts.where("host is not null").select("host", F.explode(F.array(*own)).alias("o")))
    offered = offered.select("host", "o.*").where("url is not null")
    once = offered.groupBy("host", "url").agg(F.min("special").alias("special"), F.min("link").alias("link"))
    rank = F.when(F.col("link").isNotNull() & U.in_scope(F.col("url"), F.col("host")), priority(F.col("url"), F.col("link.text")))
    ranked = once.select("host", "url", "special", rank.alias("rank")).where("rank is not null or special is not null")
    host = Window.partitionBy("host")
    # Root and fallbacks first: whatever is cut off here lies behind the first seen links.
    few = ranked.withColumn("n", F.row_number().over(host.orderBy(F.col("special").isNull(), "url"))).where(F.col("n") < seen + 1 + len(FALLBACK))
    is_link = F.col("rank").isNotNull() & ~F.col("special").eqNullSafe(F.lit(0))
    few = few.withColumn("is_link", is_link).withColumn("link_no", F.sum(F.col("is_link").cast("int")).over(host.orderBy("url")))
    few = few.withColumn("found", F.col("is_link") & (F.col("link_no") < seen))
    few = few.withColumn("held", F.sum(F.col("found").cast("int")).over(host) + 1).withColumn("spare", ~F.col("found") & (F.col("special") > 0))
    few = few.withColumn("spare_no", F.sum(F.coalesce("spare", F.lit(False)).cast("int")).over(host.orderBy(F.col("special").asc_nulls_last(), "url")))
    root = F.coalesce(F.col("special") == 0, F.lit(False))
    every = few.where(root | F.col("found") | (F.col("spare") & (F.col("spare_no") + F.col("held") <= seen)))
    every = every.select("host", "url", F.when(root, 0).when(F.col("found"), F.col("rank")).otherwise(SPARE).alias("priority"), F.when(root, 0).otherwise(1).alias("depth"))
    order = host.orderBy("priority", "depth", "url")
    return every.withColumn("page_no", F.row_number().over(order)).where(F.col("page_no") <= max_pages).select("host", "url", "priority", "depth", "page_no")


_CHOICE = "struct<priority:int,depth:int,url:string>"
STATE = f"host string, queue array<{_CHOICE}>, known array<string>, visited array<string>, spare boolean, pages array<{_CHOICE}>, at string, depth int, spent double"
OFFERS = "array<struct<url:string,priority:int>>"


def turned(r: dict, max_depth: int, seen: int) -> dict:
    """One turn of a host's search, STATE and offers as a dict: what the last page links to comes in, the next page goes out."""
    host, known = r["host"], set(r["known"])
    ahead = [(c["priority"], c["depth"], c["url"]) for c in r["queue"]]
    heapq.heapify(ahead)

    def remember(offers):
        for offer in offers:
            if offer[1] <= max_depth and offer[2] not in known and len(known) < seen:
                known.add(offer[2])
                heapq.heappush(ahead, offer)

    gone = {*r["visited"], *filter(None, [r["at"]])}
    remember((x["priority"], r["depth"] + 1, x["url"]) for x in r["offers"] or [])
    poor = not ahead or ahead[0][0] >= POOR
    if r["spare"] and poor:
        remember((SPARE, 1, f"https://{host}{path}") for path in FALLBACK)
    while ahead and ahead[0][2] in gone:
        heapq.heappop(ahead)
    out = {"host": host, "known": sorted(known), "spare": r["spare"] and not poor, "pages": r["pages"], "at": None, "depth": None, "spent": r["spent"]}
    if ahead:
        best = heapq.heappop(ahead)
        out |= {"pages": [*r["pages"], dict(zip(("priority", "depth", "url"), best, strict=True))], "at": best[2], "depth": best[1]}
        gone.add(best[2])
    return out | {"queue": [dict(zip(("priority", "depth", "url"), c, strict=True)) for c in ahead], "visited": sorted(gone)}


def _turns(max_depth: int, seen: int):
    choice = pa.struct([("priority", pa.int32()), ("depth", pa.int32()), ("url", pa.string())])
    texts = pa.list_(pa.string())
    schema = pa.schema([("host", pa.string()), ("queue", pa.list_(choice)), ("known", texts), ("visited", texts), ("spare", pa.bool_()), ("pages", pa.list_(choice)), ("at", pa.string()), ("depth", pa.int32()), ("spent", pa.float64())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([turned(r, max_depth, seen) for r in b.to_pylist()], schema=schema)

    return run


def started(hosts: DataFrame) -> DataFrame:
    """STATE of a search before its first turn, a row for each host."""
    root = F.concat(F.lit("https://"), "host", F.lit("/"))
    none = F.array().cast("array<string>")
    return hosts.select(
        "host",
        F.array(F.struct(F.lit(0).alias("priority"), F.lit(0).alias("depth"), root.alias("url"))).alias("queue"),
        F.array(root).alias("known"),
        none.alias("visited"),
        F.lit(True).alias("spare"),
        F.array().cast(f"array<{_CHOICE}>").alias("pages"),
        F.lit(None).cast("string").alias("at"),
        F.lit(None).cast("int").alias("depth"),
        F.lit(0.0).alias("spent"),
    )


def turn(state: DataFrame, max_depth: int = 2, seen: int = SEEN) -> DataFrame:
    """STATE after a turn: offers (OFFERS, by URL), what the page at shows, come in, and the next page is at; null where none is left.

    A host's row holds at most seen URLs. spent goes along.
    """
    names = [x.split()[0] for x in STATE.split(", ")]
    return state.select(*names, "offers").mapInArrow(_turns(max_depth, seen), STATE)


def offered(links: Column, host: Column, also: Column | None = None, seen: int = SEEN) -> Column:
    """OFFERS of a page's links (array of structs with url and text): ranked ones in scope, or for which also holds, once each by URL.

    Of equal URLs the first link counts. Only the first 2 * seen can be remembered, whatever came before, so no more are offered.
    """
    def of(x, i):
        fine = U.in_scope(x["url"], host) if also is None else U.in_scope(x["url"], host) | also(x["url"])
        return F.struct(x["url"].alias("url"), i.alias("pos"), F.when(fine, priority(x["url"], x["text"])).alias("priority"))

    ranked = F.array_sort(F.filter(F.transform(links, of), lambda x: x["priority"].isNotNull()))
    once = F.aggregate(ranked, F.array().cast("array<struct<url:string,pos:int,priority:int>>"), lambda a, x: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["url"] == x["url"]) | (F.size(a) >= 2 * seen), a).otherwise(F.concat(a, F.array(x))))
    return F.transform(once, lambda x: F.struct(x["url"].alias("url"), x["priority"].alias("priority")))


def _kept(df: DataFrame) -> DataFrame:
    """df, worked out once, in the checkpoint folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="evidra-"))
    return df.checkpoint()


def best_first(links: DataFrame, max_pages: int = 8, max_depth: int = 2, seen: int = SEEN, hosts: DataFrame | None = None, redirects: DataFrame | None = None) -> DataFrame:
    """(host, url, priority, depth, page_no): best-first search over a stored link table, max_pages of each host.

    links: host, page_url, pos, url, text; only ranked links in scope are followed. hosts (host): those to search,
    by default those of links. redirects (host, url, final_url): a page that leads elsewhere shows the links
    of its end, and its end is not visited again.

    A host's search is one row that holds at most seen URLs. It takes a turn for each page: the page's links are
    looked up in the table, and no other links of the host are ever brought together. Of a page only the first 2 * seen
    links in URL order can be remembered, whatever came before, so more never leave the window.
    """
    # Where links are worked out by long expressions, a filter on them would repeat these many times over.
    links = _kept(links.select("host", "page_url", "pos", "url", "text"))
    ranked = links.where("host is not null").withColumn("priority", priority(F.col("url"), F.col("text"))).where("priority is not null").where(U.in_scope(F.col("url"), F.col("host")))
    ranked = ranked.select("host", U.canonical_url(F.col("page_url")).alias("at"), "pos", "url", "priority")
    once = ranked.groupBy("host", "at", "url").agg(F.min(F.struct("pos", "priority")).alias("first"))
    some = once.withColumn("n", F.row_number().over(Window.partitionBy("host", "at").orderBy("url"))).where(F.col("n") <= 2 * seen)
    offers = some.groupBy("host", "at").agg(F.array_sort(F.collect_list(F.struct("url", F.col("first.priority").alias("priority")))).alias("offers"))
    # Every turn looks pages up in it.
    offers = _kept(offers)
    wanted = (links if hosts is None else hosts).where("host is not null").select("host").distinct()
    state = started(wanted)
    for n in range(max_pages):
        if n and redirects is not None:
            ends = redirects.select("host", U.canonical_url(F.col("url")).alias("at"), U.canonical_url(F.col("final_url")).alias("end")).dropDuplicates(["host", "at"])
            state = state.join(ends, ["host", "at"], "left").withColumn("at", F.coalesce("end", "at")).drop("end")
        met = state.join(offers, ["host", "at"], "left") if n else state.withColumn("offers", F.lit(None).cast(OFFERS))
        state = turn(met, max_depth, seen)
    return state.select("host", F.posexplode("pages").alias("no", "p")).select("host", "p.url", "p.priority", "p.depth", (F.col("no") + 1).alias("page_no"))


def distinct_texts(pages: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """pages with fingerprint and duplicate: whether an earlier row of the same key has the text. Rows of one key, text and order are one page.

    The first row of each text comes from a partial aggregation and meets its row by key, text and order, which no group of copies
    shares. pages is read twice: write it before where it is dear.
    """
    p = pages.withColumn("fingerprint", F.sha2(F.col(text), 256))
    first = p.groupBy(F.col(by).alias("__by"), F.col("fingerprint").alias("__text")).agg(F.min(order).alias("__first")).withColumn("__is", F.lit(True))
    same = F.col(by).eqNullSafe(F.col("__by_")) & F.col("fingerprint").eqNullSafe(F.col("__text")) & F.col(order).eqNullSafe(F.col("__first"))
    met = p.join(first.withColumnRenamed("__by", "__by_"), same, "left")
    return met.withColumn("duplicate", F.col("__is").isNull()).drop("__by_", "__text", "__first", "__is")
