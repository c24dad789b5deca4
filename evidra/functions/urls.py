"""URL and host functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidra.functions import text as T

#: The generic split of a URI (RFC 3986, appendix B): scheme, authority, path, query.
SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#[\s\S]*)?$"
AUTHORITY = r"^(?:([^@]*)@)?([^:]*)(?::([0-9]*))?$"
# Query parameters that only track.
TRACKING = ["gclid", "fbclid", "msclkid"]
LABEL = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
#: IPv4 ranges that are not public.
PRIVATE_V4 = r"^(?:0|10|127)\.|^100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^169\.254\.|^172\.(?:1[6-9]|2\d|3[01])\.|^192\.0\.[02]\.|^192\.168\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\.|^(?:2[4-5]\d)\."
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


def part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, SPLIT, i)


def host(url: Column) -> Column:
    """Lower-case host without port, user and trailing dots."""
    return F.regexp_replace(F.lower(F.regexp_extract(part(url, 2), AUTHORITY, 2)), r"\.+$", "")


def port(url: Column) -> Column:
    return F.regexp_extract(part(url, 2), AUTHORITY, 3)


def origin(url: Column) -> Column:
    return F.concat(part(url, 1), F.lit("://"), part(url, 2))


def unescaped(x: Column) -> Column:
    """x with its percent escapes decoded; what is no escape stays, and a plus too."""
    literal = F.regexp_replace(F.replace(x, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(literal), x)


def _decoded(x: Column) -> Column:
    return unescaped(F.replace(x, F.lit("+"), F.lit(" ")))


def _encoded(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def parameters(query: Column) -> Column:
    """array<struct<k, v>> of a query string, empty parts left out."""
    pairs = F.filter(F.split(query, "&"), lambda x: x != "")
    return F.transform(pairs, lambda x: F.struct(_decoded(F.regexp_extract(x, "^([^=]*)", 1)).alias("k"), _decoded(F.regexp_extract(x, "^[^=]*=?([\\s\\S]*)$", 1)).alias("v")))


def is_tracking(k: Column) -> Column:
    return F.startswith(F.lower(k), F.lit("utm_")) | F.lower(k).isin(TRACKING)


def canonical_url(url: Column) -> Column:
    """Canonical form of an absolute http(s) URL; null if it has no host, a user or a port that is none."""
    keep = F.array_sort(F.filter(parameters(part(url, 4)), lambda p: ~is_tracking(p["k"])))
    query = F.array_join(F.transform(keep, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    scheme, p = F.lower(part(url, 1)), port(url)
    # Port 0 counts as none, and leading zeros say nothing.
    number = F.coalesce(F.try_to_number(F.nullif(p, F.lit("")), F.lit("999999")).cast("int"), F.lit(0))
    net = F.concat(host(url), F.when(number.isin(0, 80, 443), "").otherwise(F.concat(F.lit(":"), number.cast("string"))))
    path = F.when(part(url, 3) == "", "/").otherwise(part(url, 3))
    out = F.concat(scheme, F.lit("://"), net, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    sound = part(url, 2).rlike(AUTHORITY) & (F.length(F.regexp_replace(p, "^0+", "")) <= 5) & (number <= 65535)
    return F.when(scheme.isin("http", "https") & (host(url) != "") & ~part(url, 2).contains("@") & sound, out)


def _undotted(path: Column) -> Column:
    """An absolute path without its . and .. segments."""
    parts = F.split(F.substring(path, 2, 1_000_000), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    end = F.when(path.rlike(r"/\.\.?$") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), end)).otherwise(path)


def resolved(href: Column, base: Column) -> Column:
    """href against base: absolute, //host, /path, ?query, #fragment and relative paths, dot segments removed from paths."""
    root = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    folder = F.regexp_replace(F.when(part(base, 3) == "", "/").otherwise(part(base, 3)), "[^/]*$", "")
    path, rest = F.regexp_extract(href, "^[^?#]*", 0), F.regexp_extract(href, "^[^?#]*([\\s\\S]*)$", 1)
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(part(base, 1), F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, _undotted(path), rest))
        .when(F.startswith(href, F.lit("?")), F.concat(root, part(base, 3), href))
        .when((href == "") | F.startswith(href, F.lit("#")), F.concat(F.regexp_replace(base, "#[\\s\\S]*$", ""), href))
        .otherwise(F.concat(root, _undotted(F.concat(folder, path)), rest))
    )


def normalize_domain(value: Column) -> Column:
    """The public host that a domain or URL names, or null. ASCII; other scripts come as xn-- names."""
    v = F.trim(value)
    url = F.when(v.contains("://"), v).otherwise(F.concat(F.lit("https://"), F.regexp_replace(v, "^//", "")))
    h, p = host(url), port(url)
    v4 = h.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    name = h.rlike(rf"^(?:{LABEL}\.)+{LABEL}$") & ~h.rlike(r"(?:^|\.)\d+$") & (F.length(h) <= 253) & ~h.rlike(r"\.(?:localhost|local|internal)$")
    good = (v != "") & ~v.rlike(r"[\s\\\x00-\x1f]") & F.lower(part(url, 1)).isin("http", "https") & ~part(url, 2).contains("@") & p.isin("", "80", "443")
    return F.when(good & part(url, 2).rlike(AUTHORITY) & ((v4 & ~h.rlike(PRIVATE_V4)) | (~v4 & name)), h)


def aliases(h: Column) -> Column:
    return F.array(h, F.when(F.startswith(h, F.lit("www.")), F.substring(h, 5, 10_000)).otherwise(F.concat(F.lit("www."), h)))


def in_scope(url: Column, h: Column) -> Column:
    c = canonical_url(url)
    return F.coalesce(F.array_contains(aliases(h), host(c)) & (port(c) == ""), F.lit(False))


def profile_url(url: Column) -> Column:
    """The canonical public profile that a URL names, or null."""

    def slug(u):
        return F.nullif(F.regexp_extract(part(u, 3), r"^/in/([^/]+)/?$", 1), F.lit(""))

    def named(c):
        return F.when(host(c).isin("linkedin.com", "www.linkedin.com"), slug(c))

    # Most addresses are of other sites, which shows without taking them apart, and most others name the host as it is: a path needs no canonical form.
    low = F.lower(url)
    found = F.when(low.rlike(r"^https?://(?:www\.)?linkedin\.com[/?#]"), slug(url)).when(low.contains("linkedin.com"), T.let(canonical_url(url), named))
    return F.concat(F.lit("https://www.linkedin.com/in/"), found)
