"""Canonical listing URLs and URL parts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions import let

# --- fixed values: query parameters that only track the visitor -----------
TRACKING_PARAM = r"(?i)^(utm_|fbclid$|gclid$|mc_|ref$|ref_)"

_URL = (
    r"^(?i)(https?|wss?|ftp):[/\\]*"
    r"(?:([^/\\?#@]*)@)?"
    r"(\[[0-9A-Fa-f:.]+\]|[^/\\?#:@\s<>\[\]^|%]+)"
    r"(?::([0-9]*))?"
    r"([/\\][^?#]*)?"
    r"(?:\?([^#]*))?"
    r"(?:#.*)?$"
)
_UNSAFE = r"""[^\x21-\x7e]|["<>`{}]"""
_DEFAULT_PORTS = ["http:80", "https:443", "ws:80", "wss:443", "ftp:21"]


_BLANKS = "".join(map(chr, range(0x21))) + "\u00a0\ufeff"


def _tidy(url: Column) -> Column:
    return F.translate(F.btrim(url, F.lit(_BLANKS)), "\t\r\n", "")


def _decode(part: Column) -> Column:
    escaped = F.regexp_replace(part, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(part.contains("%") | part.contains("+"), F.url_decode(escaped)).otherwise(part)


def _query(query: Column) -> Column:
    """Drop tracking parameters, sort the rest by name (stable) and write them again."""
    named = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p, i: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("name"),
            i.alias("at"),
            _decode(F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p))).alias("value"),
        ),
    )
    kept = F.array_sort(F.filter(named, lambda p: ~p["name"].rlike(TRACKING_PARAM)))
    written = F.transform(kept, lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"])))
    marked = let(F.array_join(written, "&"), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    return F.when(query == "", "").otherwise(marked)


def _path(path: Column) -> Column:
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    plain = F.when(slashed.rlike(_UNSAFE) | slashed.contains("/."), let(_encoded(slashed), _walked)).otherwise(slashed)
    return let(F.rtrim(plain, F.lit("/")), lambda p: F.when(p == "", "/").otherwise(p))


def _encoded(path: Column) -> Column:
    """Percent-encode what may not stand in a path."""
    spelled = F.transform(
        F.split(path, ""), lambda c: F.when(c == " ", "%20").when(c.rlike(_UNSAFE), F.url_encode(c)).otherwise(c)
    )
    return F.array_join(spelled, "")


def _walked(path: Column) -> Column:
    """Resolve "." and ".." segments."""
    steps = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda seen, part: F.when(part == "..", F.slice(seen, F.lit(1), F.greatest(F.size(seen) - 1, F.lit(1))))
        .when(part == ".", seen)
        .otherwise(F.concat(seen, F.array(part))),
    )
    return F.array_join(steps, "/")


def url_parts(url: Column) -> Column:
    """Scheme, user, host, port, path, query; one element only when it is no web address."""
    return F.split(F.regexp_replace(_tidy(url), _URL, "$1\u0000$2\u0000$3\u0000$4\u0000$5\u0000$6"), "\u0000")


def url_from_parts(parts: Column) -> Column:
    """Canonical text of ``url_parts``; NULL when they are not valid."""
    scheme, user, host, port = F.lower(F.get(parts, 0)), F.get(parts, 1), F.lower(F.get(parts, 2)), F.get(parts, 3)
    number = F.concat(F.lit(":"), port.try_cast("int").cast("string"))
    shown = F.when((port == "") | F.concat(scheme, number).isin(_DEFAULT_PORTS), "").otherwise(number)
    valid = (F.size(parts) == 6) & ((port == "") | F.coalesce(port.try_cast("int") <= 65535, F.lit(False)))
    login = F.when(user != "", F.concat(user, F.lit("@"))).otherwise("")
    return F.when(valid, F.concat(scheme, F.lit("://"), login, host, shown, _path(F.get(parts, 4)), _query(F.get(parts, 5))))


def canonical_url(url: Column) -> Column:
    """Stable form of an absolute web address; NULL when it is not one."""
    return let(url_parts(url), url_from_parts)


def url_path(url: Column) -> Column:
    """Path of an absolute URL, at least one slash."""
    return let(F.get(url_parts(url), 4), lambda path: F.when(path == "", "/").otherwise(path))


def absolute_url(href: Column, base: Column) -> Column:
    """Resolve a link against the page it was found on."""
    origin = F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]+(?:/[^?#]*/)?)", 1)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z]+:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.rlike(r"^[?#]"), F.concat(F.regexp_extract(base, r"^([^?#]+)", 1), href))
        .otherwise(F.concat(F.regexp_replace(folder, "/?$", "/"), href))
    )
