"""Text, Markdown and HTML as columns. Lines are split as Python's splitlines() does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
OTHER_ENDS = r"[\r\x0b\x0c\x1c-\x1e\x85  ]"
WS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0　"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(WS))


def once(value: Column, body) -> Column:
    """body(value) with value evaluated once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines(text: Column) -> Column:
    """Texts whose only line ends are \\n, nearly all, are split without a pattern."""
    return once(text, lambda x: F.split(F.when(x.rlike(OTHER_ENDS), F.regexp_replace(x, LINES, "\n")).otherwise(x), "\n"))


def matched_chars(x: Column, pattern: str) -> Column:
    """Characters of x inside matches of pattern."""
    return F.length(x) - F.length(F.regexp_replace(x, pattern, ""))


def has_link(x: Column) -> Column:
    """Whether x holds what no Markdown link lacks; patterns are only tried where it does."""
    return x.contains("](")


def link_share(line: Column) -> Column:
    """Share of characters inside Markdown links; 1.0 for an empty line."""
    return F.when(F.length(line) > 0, F.when(has_link(line), matched_chars(line, fixed.LINK) / F.length(line)).otherwise(0.0)).otherwise(1.0)


def is_prose(line: Column) -> Column:
    """Long enough, no heading, quote, table or fence, and hardly any links."""
    return once(strip(line), lambda s: (F.length(s) >= fixed.PROSE_CHARS) & ~s.rlike(r"^(#|>|\||```|~~~|---|===)") & (link_share(s) <= fixed.PROSE_LINK_SHARE))


def anchors_only(x: Column) -> Column:
    """Markdown links replaced by their text."""
    return F.when(has_link(x), F.regexp_replace(x, r"\[\[*([^\]]{0,120})\]\([^)\s]{0,300}\)", "$1")).otherwise(x)


def prose_only(text: Column) -> Column:
    """Non-blank lines whose link share is at most 0.40, links as text."""
    kept = F.filter(F.transform(lines(F.coalesce(text, F.lit(""))), strip), lambda s: (s != "") & (link_share(s) <= fixed.LINE_LINK_SHARE))
    return F.array_join(F.transform(kept, anchors_only), "\n")


def clean_markdown(text: Column) -> Column:
    """Blank runs squeezed; of a run of link lines only the first three stay: a line goes if it and the three before are links."""
    linkish = lambda x: once(strip(x), lambda s: (has_link(s) | s.contains("://")) & (s.rlike(r"^[-*\[\]()!>\s]*(https?://|\[.*\]\()") | ((F.length(s) < 40) & has_link(s))))

    def thin(ls: Column) -> Column:
        def keep(flags: Column) -> Column:
            flag = lambda i: F.coalesce(F.get(flags, i), F.lit(False))
            run = lambda i: flag(i) & flag(i - 1) & flag(i - 2) & flag(i - 3)
            return F.filter(ls, lambda _, i: ~run(i))

        return once(F.transform(ls, linkish), keep)

    squeezed = once(F.coalesce(text, F.lit("")), lambda x: F.when(x.contains("\n\n\n"), F.regexp_replace(x, r"\n{3,}", "\n\n")).otherwise(x))
    return strip(F.array_join(once(lines(squeezed), thin), "\n"))


def strip_navigation(text: Column, window: int = 30, least: int = 2, back: int = 15, tail: int = 12) -> Column:
    """The body from the first cluster of prose lines (`least` within `window`), with a heading up to `back` lines before it, to
    `tail` lines behind the last prose line or the first footer line; the text as it is without such a cluster or with six
    lines or fewer."""
    footer = r"(?i)^[\s#>|\-*_·]*(" + fixed.FOOTER + ")"

    def cut(ls: Column) -> Column:
        n = F.size(ls)

        def with_flags(prose: Column) -> Column:
            at = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(prose, i))
            cluster = lambda i: F.size(F.filter(F.slice(prose, i + 1, window), lambda p: p)) >= least
            anchor = F.array_min(F.filter(at, cluster))

            def body(a: Column) -> Column:
                before = F.when(a > 0, F.sequence(F.greatest(a - back, F.lit(0)), F.greatest(a - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
                start = F.coalesce(F.array_max(F.filter(before, lambda j: strip(F.get(ls, j)).startswith("#"))), a)
                last = F.array_max(F.filter(at, lambda k: k > a))
                end = F.coalesce(F.least(n, last + 1 + tail), n)
                part = F.slice(ls, start + 1, end - start)
                first_footer = lambda b: F.array_min(F.filter(F.transform(b, lambda x, i: F.when((i > 0) & x.rlike(footer), i)), lambda i: i.isNotNull()))
                return once(part, lambda b: strip(F.array_join(F.slice(b, F.lit(1), F.coalesce(first_footer(b), F.size(b))), "\n")))

            return once(anchor, lambda a: F.when(a.isNotNull() & (n > 6), body(a)))

        return once(F.transform(ls, is_prose), with_flags)

    return F.coalesce(once(lines(text), cut), text)


def unescape(x: Column) -> Column:
    """Common HTML entities; &amp; last."""
    for name, char in fixed.ENTITIES.items():
        x = F.replace(x, F.lit(f"&{name};"), F.lit(char))
    return x


def html_to_text(html: Column) -> Column:
    """Scripts, navigation and the like dropped, block ends as line ends, tags as spaces, entities unescaped, white space squeezed."""
    s = F.coalesce(html, F.lit(""))
    s = F.regexp_replace(s, r"(?is)<(" + "|".join(fixed.DROPPED_TAGS) + r")[^>]*>.*?</\1>", " ")
    s = F.regexp_replace(s, r"(?s)<!--.*?-->", " ")
    s = F.regexp_replace(s, rf"(?i)</({fixed.BLOCK_TAGS})\s*>", "\n")
    s = F.regexp_replace(unescape(F.regexp_replace(s, r"<[^>]+>", " ")), r"[ \t\xa0]+", " ")
    s = F.array_join(F.transform(lines(s), strip), "\n")
    return strip(F.regexp_replace(s, r"\n{3,}", "\n\n"))


def html_title(html: Column) -> Column:
    return strip(unescape(F.regexp_replace(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1), r"[ \t\xa0]+", " ")))


def pick_date(meta: Column) -> Column:
    """The first date that a page's metadata (a map of names and values) has, by names in order, 32 characters at most."""
    found = [F.nullif(F.try_element_at(meta, F.lit(k)), F.lit("")) for k in fixed.DATE_META]
    return F.substring(F.coalesce(*found), 1, 32)


def html_date(html: Column) -> Column:
    d = F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?i)(?:published_time|publishdate|pubdate|date)["']?\s*[:=]\s*["'](\d{4}-\d{1,2}-\d{1,2})""", 1)
    return F.nullif(d, F.lit(""))


def html_links(html: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)<a[^>]+href=["']([^"'#]+)["']"""), F.lit(1))
    return F.filter(found, lambda h: ~h.rlike("(?i)^(javascript|mailto|tel):"))


def first_heading(md: Column) -> Column:
    """The first # heading within 4,000 characters, links as text."""
    t = F.regexp_extract(F.substring(F.coalesce(md, F.lit("")), 1, 4000), r"(?m)^#\s+(.+?)\s*$", 1)
    return F.substring(F.trim(F.regexp_replace(anchors_only(t), r"\s+", " ")), 1, 300)


def better_title(meta: Column, heading: Column) -> Column:
    return F.when((heading != "") & (F.length(heading) > F.length(meta)), heading).otherwise(meta)


def image_urls(md: Column, limit: int = 3) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce(md, F.lit("")), F.lit(r"!\[[^\]]*\]\((https?://[^)\s]+)"), F.lit(1))), 1, limit)


def parse_date(raw: Column, as_of: str) -> Column:
    """Date of a text with year, month and maybe day; null if invalid, after as_of or before 1990."""
    full, part = r"(\d{4})[-/年.](\d{1,2})[-/月.](\d{1,2})", r"(\d{4})[-/年.](\d{1,2})"
    of = lambda p, i: F.regexp_extract(raw, p, i)
    iso = F.when(raw.rlike(full), F.concat_ws("-", of(full, 1), F.lpad(of(full, 2), 2, "0"), F.lpad(of(full, 3), 2, "0"))).when(raw.rlike(part), F.concat_ws("-", of(part, 1), F.lpad(of(part, 2), 2, "0"), F.lit("01")))
    d = F.try_to_date(iso, "yyyy-MM-dd")
    return F.when((d <= F.lit(as_of).cast("date")) & (F.year(d) >= 1990), d)
