"""Robots rules: the state of a file, its rules, and the longest match, in native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import text as T
from evidra.functions import urls as U

# Fixed value: the least delay between two requests.
MIN_DELAY = 0.4
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def state(status: Column, body: Column) -> Column:
    """available, missing, denied or unavailable, from the last answer for a robots file; status is null without one."""
    page = F.coalesce(body.rlike(r"(?i)<(?:html|!doctype)"), F.lit(False))
    return (
        F.when(status.isin(404, 410), "missing")
        .when((status == 200) & ~page & body.isNotNull(), "available")
        .when(status.isNull() | status.isin(200, 408, 429) | (status >= 500), "unavailable")
        .otherwise("denied")
    )


def parse(files: DataFrame, agent: str) -> DataFrame:
    """(origin, state, delay, rules array<struct<allow, pattern>>) from files (origin, status, body), one row each.

    A group begins at a user-agent line that follows a rule; rules before any agent say nothing. Groups that name
    a part of the agent's name hold; without one, those for * do. A group's delay is the last it names, the
    largest of the groups counts.
    """
    f = files.select("origin", "body", state(F.col("status"), F.col("body")).alias("state"))
    lines = f.where("state = 'available'").select("origin", F.posexplode(F.split("body", T.LINES)).alias("no", "raw"))
    line = F.regexp_replace("raw", r"#[\s\S]*$", "")
    l = lines.select("origin", "no", F.lower(T.stripped(F.regexp_extract(line, r"^([^:]*):", 1))).alias("key"), T.stripped(F.regexp_extract(line, r"^[^:]*:([\s\S]*)$", 1)).alias("value")).where(line.contains(":"))
    by = Window.partitionBy("origin").orderBy("no")
    agents = F.sum((F.col("key") == "user-agent").cast("int")).over(by)
    l = l.withColumn("rule", F.col("key").isin("allow", "disallow") & (agents > 0))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("rule") | (F.col("key") == "user-agent"), F.col("rule")), True).over(before)
    opens = (F.col("key") == "user-agent") & F.coalesce(last, F.lit(False))
    # Lines before the first agent belong to its group.
    g = l.withColumn("group", F.sum(opens.cast("int")).over(by))
    a = F.lower("value")
    named = F.when(F.col("key") == "user-agent", F.when(a == "*", 1).when(F.lit(agent.lower()).contains(a), 2))
    number = F.when((F.col("key") == "crawl-delay") & F.col("value").rlike(NUMBER), F.expr("try_cast(value as double)"))
    delay = F.when((number > 0) & (number < float("inf")), F.greatest(number, F.lit(MIN_DELAY)))
    groups = g.groupBy("origin", "group").agg(
        F.max(named).alias("fit"),
        F.max_by(delay, F.when(delay.isNotNull(), F.col("no"))).alias("delay"),
        F.array_sort(F.collect_list(F.when(F.col("rule"), F.struct("no", (F.col("key") == "allow").alias("allow"), F.col("value").alias("pattern"))))).alias("rules"),
    )
    best = groups.where("fit is not null").withColumn("best", F.max("fit").over(Window.partitionBy("origin"))).where("fit = best")
    told = best.groupBy("origin").agg(F.max("delay").alias("delay"), F.flatten(F.collect_list("rules")).alias("rules"))
    rules = F.transform(F.array_sort("rules"), lambda r: F.struct(r["allow"].alias("allow"), r["pattern"].alias("pattern")))
    none = F.array().cast("array<struct<allow:boolean,pattern:string>>")
    out = f.select("origin", "state").join(told, "origin", "left")
    return out.select("origin", "state", F.coalesce("delay", F.lit(MIN_DELAY)).alias("delay"), F.coalesce(rules, none).alias("rules"))


#: Rules of an origin up to which they travel with each URL; more are looked up by their literal prefixes.
INLINE = 64
_PATTERN = "struct<pieces:array<string>,ends:boolean,size:int,allow:boolean>"


def _taken_apart(rule: Column) -> Column:
    """A rule as the pieces between its stars, whether the last one ends the target, its literal size and its verdict."""
    pattern = rule["pattern"]
    ends = F.endswith(pattern, F.lit("$"))
    body = F.when(ends, F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    size = F.length(F.regexp_replace(F.regexp_replace(pattern, r"\*", ""), r"\$+$", ""))
    return F.struct(F.split(body, r"\*").alias("pieces"), ends.alias("ends"), size.cast("int").alias("size"), rule["allow"].alias("allow"))


def _matches(target: Column, rule: Column) -> Column:
    """Whether a target begins with the first piece and has the others behind it, in order: each is taken as early as it can be."""
    pieces, last = rule["pieces"], F.size(rule["pieces"])
    first = F.get(pieces, F.lit(0))
    # Where the piece after the ones taken may begin; 0 once one is not found. What ends the target is not taken on the way.
    inner = F.slice(pieces, 2, F.greatest(last - F.when(rule["ends"], 2).otherwise(1), F.lit(0)))
    at = F.aggregate(inner, (F.length(first) + 1).cast("int"), lambda at, x: F.when(at == 0, 0).otherwise(F.coalesce(F.nullif(F.call_function("locate", x, target, at), F.lit(0)) + F.length(x), F.lit(0))))
    end = F.get(pieces, last - 1)
    fits = F.when(~rule["ends"], at > 0).when(last == 1, target == first).otherwise((at > 0) & F.endswith(target, end) & (F.length(target) - F.length(end) + 1 >= at))
    return F.startswith(target, first) & fits


def _best(rules: Column, target: Column) -> Column:
    """(size, allow) of the longest of the rules that match, allow before disallow; null if none does."""
    hits = F.filter(rules, lambda x: _matches(target, x))
    return F.array_max(F.transform(hits, lambda x: F.struct(x["size"].alias("size"), x["allow"].alias("allow"))))


def indexed(asked: DataFrame, robots: DataFrame) -> DataFrame:
    """asked (origin, target) with best, (size, allow) of the longest rule that matches, by joins on literal prefixes.

    What stands before a rule's first star or its end must begin the target. Rules that are nothing else are one row for each prefix, with
    the longest one's verdict; others are tested where their prefix fits. A target is cut at the lengths that its origin's prefixes
    have, so the work is the number of those lengths and of the rules that fit, not of the origin's rules.
    """
    rule = robots.select("origin", F.explode(F.filter("rules", lambda r: r["pattern"] != "")).alias("r")).select("origin", _taken_apart(F.col("r")).alias("r"), F.col("r.pattern").alias("pattern"))
    prefix = F.get("r.pieces", F.lit(0))
    plain = (F.size("r.pieces") == 1) & ~F.col("r.ends")
    table = rule.groupBy("origin", prefix.alias("prefix")).agg(
        F.max(F.when(plain, F.struct(F.col("r.size").alias("size"), F.col("r.allow").alias("allow")))).alias("plain"),
        F.collect_list(F.when(~plain, F.col("r"))).alias("others"),
    )
    lengths = table.groupBy("origin").agg(F.array_sort(F.collect_set(F.length("prefix"))).alias("lengths"))
    cut = asked.join(lengths, "origin").select("origin", "target", F.explode(F.filter("lengths", lambda n: n <= F.length("target"))).alias("n"))
    met = cut.withColumn("prefix", F.substring("target", F.lit(1), F.col("n"))).join(table, ["origin", "prefix"])
    return met.groupBy("origin", "target").agg(F.max(F.array_max(F.array("plain", _best(F.col("others"), F.col("target"))))).alias("best"))


def allowed(urls: DataFrame, robots: DataFrame, inline: int = INLINE) -> DataFrame:
    """urls (url) with robots_state and allowed. robots: as parsed, one row for each origin; write it before, as it is read for its sizes.

    Of the rules that match the longest decides, allow on a tie, and none allows. A missing file allows all, a denied or
    unavailable one nothing, and an origin that robots does not list is unavailable. Origins of more than inline rules are
    matched by indexed(); the rules of others come with the row.
    """
    query = U.part(F.col("url"), 4)
    target = F.concat(U.part(F.col("url"), 3), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    u = urls.withColumn("__at", F.struct(U.origin(F.col("url")).alias("origin"), target.alias("target")))
    few = F.size("rules") <= inline
    parts = F.when(few, F.transform(F.filter("rules", lambda r: r["pattern"] != ""), _taken_apart))
    r = robots.select(F.struct("origin", "state", parts.alias("rules"), (~few).alias("many")).alias("__robots"))
    met = u.join(r, F.col("__at.origin") == F.col("__robots.origin"), "left")
    best = _best(F.col("__robots.rules"), F.col("__at.target"))
    many = robots.where(~few)
    if not many.isEmpty():
        asked = u.select("__at.origin", "__at.target").join(many.select("origin"), "origin", "left_semi").distinct()
        found = indexed(asked, many).select(F.struct("origin", "target").alias("__found"), F.col("best").alias("__best"))
        met = met.join(found, F.col("__at") == F.col("__found"), "left")
        best = F.when(F.col("__robots.many"), F.col("__best")).otherwise(best)
    known = F.coalesce(F.col("__robots.state"), F.lit("unavailable"))
    free = F.when(known == "available", F.coalesce(best["allow"], F.lit(True))).otherwise(known == "missing")
    return met.withColumn("robots_state", known).withColumn("allowed", free).drop("__at", "__robots", "__found", "__best")
