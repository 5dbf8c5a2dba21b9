"""URL columns: canonical form, resolution, scope, routing host, asset and scheme tests.

Everything is a native Column expression; only hosts with letters outside ASCII pass through one Arrow
UDF for their punycode form, and every other row sends it a null.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The extensions of files that are no pages.
ASSET_EXTENSIONS = (
    "7z avi css gif gz ico jpeg jpg js json mov mp3 mp4 pdf png rar svg tar wav webp woff woff2 xml zip"
).split()
# Href prefixes that are never followed (matched as written, after trimming).
DEAD_PREFIXES = ("javascript:", "mailto:", "tel:", "#")

#: White space as Python's str.strip sees it: Java's \s is ASCII only.
WS = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_HOSTPORT = r"^(\[[^\]]*\]|[^:]*)(?::(.*))?$"
_FOREIGN = r"[^\x00-\x7f]"
_ABSOLUTE = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


#: The same characters, for trimming.
WS_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(c: Column) -> Column:
    """White space off both ends, as str.strip does; only the ends are looked at."""
    return F.btrim(c, F.lit(WS_CHARS))


@F.pandas_udf(T.StringType())
def _punycode(host: pd.Series) -> pd.Series:
    known: dict[str, str | None] = {}

    def ascii_form(h: str | None) -> str | None:
        if h is None:
            return None
        if h not in known:
            try:
                known[h] = h.encode("idna").decode("ascii")
            except UnicodeError:
                known[h] = None
        return known[h]

    return host.map(ascii_form, na_action="ignore")


_WEB_HOST = re.compile(r"^((?:https?:)?//(?:[^/?#]*@)?)([^/?#:@]+)", re.I)


def ascii_host(host: str) -> str:
    """A host in punycode; one that has none stays as it is."""
    try:
        return host if host.isascii() else host.lower().encode("idna").decode("ascii")
    except UnicodeError:
        return host


def ascii_address(address: str | None) -> str | None:
    """A web address, or a link as a page has it, with its host in punycode; all else stays as it is."""
    if address is None or address.isascii():
        return address
    s = re.sub(r"[\t\r\n]", "", address.strip())
    m = _WEB_HOST.match(s)
    return m[1] + ascii_host(m[2]) + s[m.end() :] if m and not m[2].isascii() else address


def remove_dot_segments(path: Column) -> Column:
    """RFC 3986 section 5.2.4 over an absolute path; a trailing '.' or '..' keeps its slash."""
    parts = F.split(path, "/", -1)
    segments = F.slice(parts, 2, F.size(parts))
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda out, s: F.when(s == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))))
        .when(s == ".", out)
        .otherwise(F.concat(out, F.array(s))),
    )
    tail = F.when(path.rlike(r"/\.\.?$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    full = F.concat(F.lit("/"), F.array_join(F.concat(kept, tail), "/"))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), full).otherwise(path)


# In steps, each a transform of an array of its own: the planner shares what an expression has in common with itself
# neither inside conditions nor inside lambdas, and a long chain of patterns would be matched again at every mention.


def _split(x: Column) -> Column:
    # Tabs and line ends inside an address are dropped before it is split.
    s = F.regexp_replace(strip(x["url"]), r"[\t\r\n]", "")
    fields = ((1, "scheme"), (2, "authority"), (3, "path"), (4, "query"))
    return F.struct(x["ascii"].alias("ascii"), *[F.regexp_extract(s, _ABSOLUTE, k).alias(n) for k, n in fields])


def _refine(p: Column) -> Column:
    hostport = F.regexp_replace(p["authority"], r"^.*@", "")
    return F.struct(
        p["ascii"].alias("ascii"),
        F.lower(p["scheme"]).alias("scheme"),
        F.lower(F.regexp_extract(hostport, _HOSTPORT, 1)).alias("host"),
        F.regexp_extract(hostport, _HOSTPORT, 2).alias("port"),
        p["path"].alias("path"),
        p["query"].alias("query"),
    )


def _compose(p: Column) -> Column:
    port_number = p["port"].try_cast("int")
    default = F.when(p["scheme"] == "http", F.lit(80)).otherwise(F.lit(443))
    port = F.when((p["port"] == "") | (port_number == default), F.lit("")).otherwise(
        F.concat(F.lit(":"), port_number.cast("string"))
    )
    host = F.when(p["host"].rlike(_FOREIGN), p["ascii"]).otherwise(p["host"])
    path = F.when(p["path"] == "", F.lit("/")).otherwise(remove_dot_segments(p["path"]))
    query = F.when(p["query"] == "?", F.lit("")).otherwise(p["query"])
    good = (
        p["scheme"].isin("http", "https")
        & (p["host"] != "")
        & ((p["port"] == "") | (p["port"].rlike("^[0-9]+$") & port_number.between(0, 65535)))
        & ~p["host"].rlike(r"^[^\[].*[\[\]]|^\[[^\]]*$")
    )
    return F.when(good, F.concat(p["scheme"], F.lit("://"), host, port, path, query))


def _steps(given: Column) -> Column:
    """An array of (url, ascii) in parts."""
    return F.transform(F.transform(given, _split), _refine)


def _no_host() -> Column:
    return F.lit(None).cast("string")


def canonicalize(url: Column, idn: bool = True) -> Column:
    """The canonical form of a web address, or null.

    http and https with a host only; scheme and host lower-cased; hosts outside ASCII in punycode (with
    idn=False such rows become null, and no Python runs); default port, credentials, fragment and bare '?'
    dropped; an empty path becomes '/', dot segments are resolved; the query is kept as it is. Null and
    empty input give null."""
    known = _no_host()
    if idn:
        host = _steps(F.array(F.struct(url.alias("url"), _no_host().alias("ascii"))))[0]["host"]
        known = _punycode(F.when(url.rlike(_FOREIGN), F.when(host.rlike(_FOREIGN), host)))
    return F.transform(_steps(F.array(F.struct(url.alias("url"), known.alias("ascii")))), _compose)[0]


def canonicalize_all(addresses: Column) -> Column:
    """canonicalize(idn=False) of every element of an array."""
    given = F.transform(addresses, lambda u: F.struct(u.alias("url"), _no_host().alias("ascii")))
    return F.transform(_steps(given), _compose)


def url_host(canonical: Column) -> Column:
    """Host of a canonical address, without the port ('' when there is none)."""
    return F.regexp_extract(canonical, r"^https?://(\[[^\]]*\]|[^/?#:]*)", 1)


def url_path(canonical: Column) -> Column:
    """Path of a canonical address."""
    return F.regexp_extract(canonical, r"^https?://[^/?#]*([^?#]*)", 1)


def routing_host(url: Column) -> Column:
    """Lower-cased text between '://' and the first '/', '?' or '#': port and credentials stay. '' if none."""
    return F.lower(F.regexp_extract(url, r"^[hH][tT][tT][pP][sS]?://([^/?#]+)", 1))


def site(url: Column) -> Column:
    """The site of an address: its host, lower-cased, without a leading 'www.'; null for null input."""
    host = F.lower(F.regexp_extract(strip(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def _bare(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(host), r"\.+$", ""), r"^www\.", "")


def in_scope(host: Column, scope_host: Column) -> Column:
    """True if host is scope_host or below it, ignoring case, trailing dots and one leading 'www.'.
    Empty or null on either side gives false."""
    h, s = _bare(F.coalesce(host, F.lit(""))), _bare(F.coalesce(scope_host, F.lit("")))
    return (h != "") & (s != "") & ((h == s) | F.endswith(h, F.concat(F.lit("."), s)))


def followable(href: Column) -> Column:
    """False for null or empty links and for the dead prefixes."""
    s = strip(F.coalesce(href, F.lit("")))
    ok = F.coalesce(href, F.lit("")) != ""
    for prefix in DEAD_PREFIXES:
        ok = ok & ~F.startswith(s, F.lit(prefix))
    return ok


def is_asset(canonical: Column) -> Column:
    """True if the path ends in one of the asset extensions."""
    return F.lower(url_path(canonical)).rlike(r"\.(?:" + "|".join(ASSET_EXTENSIONS) + ")$")


def resolve(base: Column, href: Column) -> Column:
    """href against the address of its page (RFC 3986 section 5.2), before canonicalisation."""
    b, h = strip(base), strip(href)
    root = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    path = F.regexp_extract(b, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    return (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(F.startswith(h, F.lit("//")), F.concat(scheme, F.lit(":"), h))
        .when(F.startswith(h, F.lit("/")), F.concat(root, h))
        .when(F.startswith(h, F.lit("?")), F.concat(root, path, h))
        .when(h == "", b)
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), h))
    )


def link_target(
    base: Column, href: Column, stay_in_domain: Column, scope_host: Column | None = None, idn: bool = True
) -> Column:
    """A link of a page as a crawlable address, or null: resolved, canonical, no asset, inside the scope
    (scope_host, or the host of the page where that is empty) if stay_in_domain."""
    canon = canonicalize(resolve(base, href), idn)
    own = url_host(F.lower(strip(base)))
    boundary = own if scope_host is None else F.coalesce(F.nullif(scope_host, F.lit("")), own)
    inside = ~F.coalesce(stay_in_domain, F.lit(False)) | in_scope(url_host(canon), boundary)
    return F.when(followable(href) & canon.isNotNull() & ~is_asset(canon) & inside, canon)


def link_targets(base: Column, hrefs: Column, stay_in_domain: Column, scope_host: Column) -> Column:
    """link_target of every element of an array, without what is no target; hosts outside ASCII
    are left out, so give them in punycode (ascii_address, ascii_host)."""
    b = F.struct(
        strip(base).alias("base"),
        F.coalesce(F.nullif(scope_host, F.lit("")), url_host(F.lower(strip(base)))).alias("boundary"),
        F.coalesce(stay_in_domain, F.lit(False)).alias("stay"),
    )

    def all_of(p: Column) -> Column:
        found = canonicalize_all(F.transform(F.filter(hrefs, followable), lambda h: resolve(p["base"], h)))
        return F.filter(found, lambda c: c.isNotNull() & ~is_asset(c) & (~p["stay"] | in_scope(url_host(c), p["boundary"])))

    # One element, so that what depends on the page alone is computed once.
    return F.flatten(F.transform(F.array(b), all_of))


def slug(url: Column) -> Column:
    """File name of a site: host and path, other characters as '_', no '_' at the ends, 80 characters."""
    place = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    place = F.regexp_replace(place, r"[?#].*$", "")
    name = F.regexp_replace(F.regexp_replace(place, r"[^A-Za-z0-9_\-]", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(name, 1, 80), F.lit("")), F.lit("scraped_document"))
