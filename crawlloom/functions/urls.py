"""URL functions as column expressions.

URLs are split by the generic pattern of RFC 3986, since Spark's parse_url refuses URLs that are
accepted here, such as those with braces. What is refused is said explicitly in ok().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
#: White space that is trimmed: the ASCII kind and the other Unicode spaces.
SPACE = r"[ \t\n\r\x0B\f\x85\xA0  -     　]"
#: Bytes that stay as they are in a path that holds no others.
PLAIN_PATH = r"^(?:[A-Za-z0-9\-_.~$&+,/:;=@!'()*\[\]]|%[0-9A-Fa-f]{2})*$"
#: Bytes that stay when a path has to be encoded again.
SAFE = r"^[A-Za-z0-9\-_.~$&+,/:;=@]$"
BAD_PERCENT = r"%(?![0-9A-Fa-f]{2})"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim(s: Column) -> Column:
    return F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", "")


class Parts:
    """A URL's parts from one match of SPLIT, for expressions that need several of them."""

    def __init__(self, url: Column, parts: Column):
        self.url = url
        self.scheme, self.authority, self.raw_path, self.asked, self.marked = (F.lower(F.get(parts, F.lit(0))), *[F.get(parts, F.lit(i)) for i in range(1, 5)])
        self.host = F.regexp_replace(self.authority, "^.*@", "")

    def ok(self) -> Column:
        name, p, f = self.host, self.raw_path, F.substr(self.marked, F.lit(2))
        bad = (
            self.url.rlike(r"[\x00-\x1F\x7F]")
            | (p.contains("%") & p.rlike(BAD_PERCENT))
            | (f.contains("%") & f.rlike(BAD_PERCENT))
            | name.rlike(r"[ \"<>^`{}|\\]")
            | (name.contains(":") & name.rlike(r":[^:\]]*$") & ~name.rlike(r":[0-9]*$"))
            | (name.startswith("[") & ~name.rlike(r"\](:[0-9]*)?$"))
            | self.url.startswith(":")
            | ((self.scheme == "") & (self.authority == "") & p.rlike("^[^/]*:"))
        )
        return ~bad

    def opaque(self) -> Column:
        return (self.scheme != "") & ~self.url.rlike(r"^[^:]*://") & (self.raw_path != "") & ~self.raw_path.startswith("/")


def parted(url: Column, body: Callable[[Parts], Column]) -> Column:
    """body of the URL's parts; the sign between them can't be in a URL that parses."""
    return let(F.split(F.regexp_replace(url, SPLIT, "$1\x00$2\x00$3\x00$4\x00$5"), "\x00"), lambda p: body(Parts(url, p)))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SPLIT, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, SPLIT, 2)


def host(url: Column) -> Column:
    """Host and port, without user information."""
    return F.regexp_replace(authority(url), "^.*@", "")


def raw_path(url: Column) -> Column:
    return F.regexp_extract(url, SPLIT, 3)


def query(url: Column) -> Column:
    """The raw query without its question mark."""
    return F.substr(F.regexp_extract(url, SPLIT, 4), F.lit(2))


def fragment(url: Column) -> Column:
    return F.substr(F.regexp_extract(url, SPLIT, 5), F.lit(2))


def ok(url: Column) -> Column:
    """Whether the URL parses at all."""
    return parted(url, Parts.ok)


def opaque(url: Column) -> Column:
    """Whether a scheme is followed by neither a host nor a rooted path, as in mailto:."""
    return parted(url, Parts.opaque)


def decoded(path: Column) -> Column:
    """Percent-decoded; a plus stays a plus. Null for a bad escape."""
    return F.when(path.contains("%"), F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))).otherwise(path)


def path(url: Column) -> Column:
    return F.when(opaque(url), "").otherwise(decoded(raw_path(url)))


def escaped(path_: Column) -> Column:
    """A raw path as it is printed: unchanged if made of allowed characters, else decoded and encoded again."""

    def encode(c: Column) -> Column:
        return F.when(c.rlike(SAFE), c).otherwise(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")))

    again = F.aggregate(F.split(decoded(path_), ""), F.lit(""), lambda a, c: F.concat(a, F.when(c == "", "").otherwise(encode(c))))
    return F.when(path_.rlike(PLAIN_PATH), path_).otherwise(again)


def site(url: Column) -> Column:
    """scheme://authority of an absolute URL."""
    return F.concat(scheme(url), F.lit("://"), authority(url))


def canonicalize(url: Column) -> Column:
    """Fragment off, an empty path /, the path printed; otherwise, and where it doesn't parse, unchanged."""

    def printed(u: Parts) -> Column:
        own = F.when(u.scheme != "", F.concat(u.scheme, F.lit(":"))).otherwise("")
        name = F.when(url.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"), F.concat(F.lit("//"), u.authority)).otherwise("")
        p = u.raw_path
        rest = F.when(u.opaque(), p).otherwise(F.when(p == "", "/").otherwise(escaped(p)))
        return F.when(u.ok(), F.concat(own, name, rest, u.asked)).otherwise(url)

    return parted(url, printed)


def without_dots(p: Column) -> Column:
    """A rooted path without . and .. segments."""

    def step(acc: Column, s: Column) -> Column:
        return F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))

    parts = F.split(F.regexp_replace(p, "^/", ""), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    closed = F.when(p.rlike(r"(^|/)\.\.?$"), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(p == "", "").when(p.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(closed, "/"))).otherwise(F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)))


def normalize(base: Column, href: Column) -> Column:
    """href resolved against base without its fragment; null if empty, a fragment only, unparseable or not http(s)."""

    def resolved(h: Parts, b: Parts) -> Column:
        own_scheme = F.when(h.scheme == "", b.scheme).otherwise(h.scheme)
        absolute = (h.scheme != "") | (h.authority != "")
        p, base_path = escaped(h.raw_path), escaped(b.raw_path)
        joined = F.when(p == "", base_path).when(p.startswith("/"), p).otherwise(F.concat(F.regexp_replace(base_path, "[^/]*$", ""), p))
        name = F.when(absolute, h.authority).otherwise(b.authority)
        full = let(F.when(absolute, p).otherwise(joined), without_dots)
        query_ = F.when(~absolute & (h.raw_path == "") & (h.asked == ""), b.asked).otherwise(h.asked)
        out = F.concat(own_scheme, F.lit(":"), F.when(name != "", F.concat(F.lit("//"), name)).otherwise(""), full, query_)
        wanted = (h.url != "") & ~h.url.startswith("#") & h.ok() & ~h.opaque() & own_scheme.isin("http", "https")
        return F.when(wanted, out)

    return let(trim(href), lambda h: parted(h, lambda own: parted(base, lambda b: resolved(own, b))))


def same_host(base: Column, url: Column) -> Column:
    return F.lower(host(base)) == F.lower(host(url))


def key_of(url: Column) -> Column:
    """What variants of one URL share: scheme and host in lower case, the decoded path without one final slash, the query."""
    p = path(url)
    trimmed = F.when((p != "/") & p.endswith("/"), F.regexp_replace(p, "/$", "")).otherwise(p)
    q = query(url)
    key = F.concat(scheme(url), F.lit("://"), F.lower(host(url)), trimmed, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.when(ok(url), key).otherwise(url)


def parent_path(url: Column) -> Column:
    """The path of a parent URL; / for none, the URL itself if it has no path or doesn't parse."""
    p = path(url)
    return F.when(url == "", "/").when(~ok(url) | (p == ""), url).otherwise(p)


def invalid_detail(url: Column) -> Column:
    """Why a URL is no page address, or null."""
    return F.when(~ok(url) | (scheme(url) == "") | (host(url) == ""), "URL is not a valid absolute http(s) URL").when(~scheme(url).isin("http", "https"), "URL scheme must be http or https")


def has_placeholder(url: Column) -> Column:
    return url.rlike(r"[{}]")


def excluded(url: Column, prefixes: list[str]) -> Column:
    """Whether the URL's path is one of the prefixes or below it, whole segments only; '' and / exclude nothing."""
    wanted = [p for p in (x.removesuffix("/") for x in prefixes) if p]
    if not wanted:
        return F.lit(False)
    p = path(url)
    own = F.when(p.rlike("^/?$"), "/").otherwise(F.regexp_replace(p, "/$", ""))
    hits = F.exists(F.array(*[F.lit(x) for x in wanted]), lambda e: (own == e) | own.startswith(F.concat(e, F.lit("/"))))
    return F.coalesce(F.when(ok(url), hits), F.lit(False))


def base_candidates(base: Column) -> Column:
    """The base URL, and it with its final slashes off or one added."""
    return F.array(base, F.when(base.endswith("/"), F.regexp_replace(base, "/+$", "")).otherwise(F.concat(base, F.lit("/"))))


def sibling(url: Column, path_: str) -> Column:
    """The URL of path_ on the same authority, without query and fragment."""
    return F.concat(site(url), F.lit(path_))
