"""URLs as columns: resolving, normalising, and judging by path alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import once

PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def part(url: Column, i: int) -> Column:
    """1 scheme, 2 host, 3 path, 4 query."""
    return F.regexp_extract(url, PARTS, i)


def _without_dots(path: Column) -> Column:
    """Dot segments resolved."""
    def step(out: Column, s: Column) -> Column:
        up = F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))
        return F.when(s == "..", up).when(s == ".", out).otherwise(F.concat(out, F.array(s)))

    segments = F.aggregate(F.split(F.substring(path, F.lit(2), F.length(path)), "/"), F.array().cast("array<string>"), step)
    tail = F.when(path.rlike(r"/\.\.?$"), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(segments, "/"), tail)


def resolve(url: Column, base: Column) -> Column:
    """An absolute URL of a link on the page base."""
    origin = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    folder = F.regexp_replace(part(base, 3), r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    relative = F.concat(folder, part(url, 3))
    rest = F.regexp_extract(url, r"(\?[^#]*)", 1)
    return (
        F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), url)
        .when(url.startswith("//"), F.concat(part(base, 1), F.lit(":"), url))
        .when(url.startswith("/"), F.concat(origin, _without_dots(part(url, 3)), rest))
        .when(url.rlike(r"^\?"), F.concat(origin, part(base, 3), rest))
        .when(url == "", base)
        .otherwise(F.concat(origin, _without_dots(relative), rest))
    )


def normalise(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, no tracking or blank parameters, no slash at the end; https without a scheme."""
    keep = lambda kv: (F.substring_index(kv, "=", 1) != "") & kv.contains("=") & ~kv.endswith("=") & ~F.lower(kv).rlike("^(" + "|".join(fixed.TRACKING) + ")")
    query = F.array_join(F.filter(F.split(part(url, 4), "&"), keep), "&")
    scheme = F.lower(part(url, 1))
    path = F.regexp_replace(part(url, 3), "/+$", "")
    return F.concat(
        F.when(scheme == "", "https").otherwise(scheme),
        F.lit("://"),
        F.lower(part(url, 2)),
        F.when(path == "", "/").otherwise(path),
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )


def host(url: Column) -> Column:
    """Host without port and www."""
    return F.regexp_replace(F.regexp_replace(F.lower(part(url, 2)), ":.*$", ""), r"^www\.", "")


def same_site(url: Column, domain: Column) -> Column:
    d = F.lower(domain)
    return once(host(url), lambda h: (h == d) | h.endswith(F.concat(F.lit("."), d)))


def url_hash(url: Column) -> Column:
    return F.substring(F.sha2(F.trim(F.coalesce(url, F.lit(""))).cast("binary"), 256), 1, 32)


def _path(url: Column) -> Column:
    p = part(url, 3)
    return F.when(p == "", "/").otherwise(p)


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def _last(path: Column) -> Column:
    return F.coalesce(F.element_at(F.when(F.size(_segments(path)) > 0, _segments(path)), -1), F.lit(""))


def _stem(segment: Column) -> Column:
    return F.regexp_replace(segment, r"\.[^.]*$", "")


def _long_slug(last: Column) -> Column:
    return (F.length(last) >= 20) & (F.length(last) - F.length(F.replace(last, F.lit("-"), F.lit(""))) >= 3)


def is_article_like(url: Column) -> Column:
    """Ordered rules on the path: files, sections and shops are none, then dates, numbers, page types, telling words and long slugs are."""
    p = _path(url)
    last, depth = _last(p), F.size(_segments(p))
    return (
        F.when(p.rlike("(?i)" + fixed.SKIP_TYPE) | p.rlike(f"(?i)(^|/)({fixed.SKIP_PART})(/|$)") | p.rlike("(?i)" + fixed.SHOP) | (depth == 0), False)
        .when(_stem(last).rlike("(?i)" + fixed.SECTION) & (depth <= 2), False)
        .when(p.rlike(r"/\d{4}[/-]\d{1,2}|/\d{4,}") | last.rlike("(?i)" + fixed.PAGE_TYPE) | F.lower(p).rlike("|".join(fixed.ARTICLE_PARTS)), True)
        .otherwise(_long_slug(last))
    )


def article_rank(url: Column, folder: Column) -> Column:
    """Score of how much a path looks like an article; six more in the section of the list page."""
    p = _path(url)
    last, depth = _last(p), F.size(_segments(p))
    plus = lambda c, n: F.when(c, n).otherwise(0)
    signs = [plus(p.rlike("(?i)" + rx), n) for rx, n in fixed.ARTICLE_SIGNS]
    section = F.regexp_replace(folder, "/+$", "")
    inside = (section != "") & p.startswith(F.concat(section, F.lit("/"))) & (p != F.concat(section, F.lit("/")))
    return sum(signs, F.least(F.lit(3), F.greatest(F.lit(0), depth - 1))) + plus(_long_slug(last), 2) + plus(last.rlike(r"\d{4,}"), 2) - plus(_stem(last).rlike("(?i)" + fixed.SECTION), 4) + plus(inside, 6)


def section_of(list_url: Column) -> Column:
    """Folder of a list page, with a slash at the end."""
    p = F.regexp_replace(_path(list_url), r"(?i)/(index|default|list|main)\.(html?|php|jsp|aspx?)$", "")
    return F.when(p.endswith("/"), p).otherwise(F.concat(p, F.lit("/")))


def suffix_weight(domain: Column) -> Column:
    d = F.lower(F.trim(F.coalesce(domain, F.lit(""))))
    out = F.lit(fixed.OTHER_SUFFIX)
    for suffix, w in reversed(fixed.SUFFIXES):
        out = F.when(d.endswith(suffix), w).otherwise(out)
    return out


def domain_score(domain: Column, authority: Column | None = None) -> Column:
    """The largest of suffix weight, listed host and the source's own authority."""
    d = F.regexp_replace(F.lower(F.trim(F.coalesce(domain, F.lit("")))), r"^www\.", "")
    exact = F.create_map(*[x for h, w in fixed.HOSTS.items() for x in (F.lit(h), F.lit(w))])[d]
    sub = F.lit(None).cast("double")
    for h, w in reversed(fixed.HOSTS.items()):
        sub = F.when(d.endswith("." + h), w).otherwise(sub)
    listed = F.coalesce(exact, sub)
    return F.greatest(suffix_weight(d), F.coalesce(listed, F.lit(0.0)), F.coalesce(authority, F.lit(0.0)) if authority is not None else F.lit(0.0))
