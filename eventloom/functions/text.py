"""Text column functions: similarity, cleaning, keys, placeholders, lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a value that isn't known yet.
PLACEHOLDER_TBD = r"(?i)^(?:venue[\s-]+)?(?:tbd|tba|tbc)$"
PLACEHOLDER_OTHER = r"(?i)^(?:n/a|none|null|needed|required|registration|sign[\s\-_]*up!?|volunteer|vacant|\?{1,3})$"
PLACEHOLDER_HARES = r"(?i)^(?:hares?\s+(?:needed|required|wanted)|needs?\s+(?:a\s+)?hares?)\b[\s\S]*$"
ENTITIES = (("&nbsp;|&#160;|&#xa0;", " "), ("&lt;|&#60;", "<"), ("&gt;|&#62;", ">"), ("&quot;|&#34;", '"'), ("&apos;|&#39;|&#x27;", "'"), ("&ndash;|&#8211;", "\u2013"), ("&mdash;|&#8212;", "\u2014"), ("&rsquo;|&#8217;", "\u2019"), ("&hellip;|&#8230;", "\u2026"), ("&eacute;|&#233;", "\u00e9"), ("&amp;|&#38;|&#038;", "&"))


def blank_to_null(c: Column) -> Column:
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(t != "", t)


def is_placeholder(c: Column) -> Column:
    t = F.trim(c)
    return F.coalesce(t.rlike(PLACEHOLDER_TBD) | t.rlike(PLACEHOLDER_OTHER) | t.rlike(PLACEHOLDER_HARES), F.lit(False))


def decode_entities(c: Column) -> Column:
    """Text with the usual HTML entities decoded once; the ampersand comes last, or "&amp;lt;" would be decoded twice."""
    for entity, value in ENTITIES:
        c = F.regexp_replace(c, f"(?i){entity}", value)
    return c


def strip_placeholder(c: Column) -> Column:
    return F.when(~is_placeholder(c), blank_to_null(c))


def name_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length on trimmed lower-case names; 0 if either is empty."""
    x, y = F.lower(F.trim(F.coalesce(a, F.lit("")))), F.lower(F.trim(F.coalesce(b, F.lit(""))))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(1 - F.levenshtein(x, y) / longest)


def candidate_score(query: Column, names: Column) -> Column:
    """Best score of a query over an array of names: equality 1, else similarity plus 0.3 where one holds
    the other and the shorter has six characters or more, at most 1."""
    q = F.lower(F.trim(query))

    def score(name: Column) -> Column:
        n = F.lower(F.trim(name))
        held = (q.contains(n) | n.contains(q)) & (F.least(F.length(q), F.length(n)) >= 6)
        return F.least(F.lit(1.0), name_similarity(q, n) + F.when(held, 0.3).otherwise(0.0))

    return F.coalesce(F.array_max(F.transform(F.filter(names, lambda n: F.trim(n) != ""), score)), F.lit(0.0))


def cluster_key(title: Column) -> Column:
    """Key of titles that name one series: lower case without dashes, colons, "#", the word "trail" and numbers that stand alone;
    the first four words; null below two words or eight characters."""
    bare = F.lower(title)
    for pattern, to in ((r"[#\-–—:]", " "), (r"\btrail\b", ""), (r"\b\d+\b", ""), (r"\s+", " ")):
        bare = F.regexp_replace(bare, pattern, to)
    words = F.filter(F.split(F.trim(bare), " "), lambda w: w != "")
    key = F.array_join(F.slice(words, 1, 4), " ")
    return F.when((F.size(words) >= 2) & (F.length(key) >= 8), key)


def slug(c: Column) -> Column:
    """Key for addresses: brackets go, other runs of characters become a dash."""
    return code(F.regexp_replace(c, r"[()]", ""))


def code(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def region_slug(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), r"[()]", ""), r"[,.\s]+", "-")
    return F.regexp_replace(F.regexp_replace(bare, "-+", "-"), r"^-|-$", "")


def normal_list(c: Column, separator: str = r"\s*,\s*") -> Column:
    """A list in one order: split, trimmed, distinct, sorted, joined."""
    items = F.filter(F.transform(F.split(c, separator), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.array_sort(F.array_distinct(items)), ", ")


def name_parts(c: Column) -> Column:
    """Names of a list with commas, ampersands and "and", without placeholders; the first spelling of names
    that differ in case stays."""
    parts = F.filter(F.transform(F.split(c, r"(?i)\s*(?:,|&|\band\b)\s*"), lambda x: F.trim(x)), lambda x: (x != "") & ~is_placeholder(x))
    keys = F.transform(parts, lambda x: F.lower(x))
    return F.filter(parts, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)


def run_number(c: Column) -> Column:
    """The number of "#123" that ends at a delimiter; none for 0."""
    found = F.regexp_extract(c, r"[#＃][\s:]*(\d+)(?=$|[\s:\-–—,.()/])", 1).try_cast("int")
    return F.when(found > 0, found)


def strip_tags(html: Column) -> Column:
    """Visible text of HTML: scripts and styles go, block ends become line feeds, other tags blanks, entities
    of markup are decoded, runs of blanks collapse."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|section|article)\s*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    t = decode_entities(t)
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t\x0B\f\r]+", " "), r" *\n[ \n]*", "\n")
    return F.trim(F.regexp_replace(t, r"^\n+|\n+$", ""))


def collapse_doubled(c: Column) -> Column:
    """The first half of a text whose paragraphs repeat as a whole."""
    blocks = F.filter(F.split(c, r"\n\s*\n"), lambda b: F.trim(b) != "")
    key = lambda a: F.transform(a, lambda b: F.lower(F.regexp_replace(b, r"\s+", " ")))
    half = F.floor(F.size(blocks) / 2).cast("int")
    first, second = F.slice(blocks, F.lit(1), half), F.slice(blocks, half + 1, half)
    doubled = (F.size(blocks) > 1) & (F.pmod(F.size(blocks), F.lit(2)) == 0) & (key(first) == key(second))
    return F.when(doubled, F.array_join(first, "\n\n")).otherwise(c)


def scrub_contacts(c: Column) -> Column:
    """Without e-mail addresses and telephone numbers."""
    t = F.regexp_replace(c, r"\b[\w.+-]+@[\w-]+(\.[\w-]+)+\b", "")
    t = F.regexp_replace(t, r"(?<!\d)\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}(?!\d)|(?<!\d)\d{10}(?!\d)", "")
    return blank_to_null(F.regexp_replace(t, r"\s{2,}", " "))


def safe_url(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.rlike(r"(?i)^https?://[^\s/]+"), t)


def domain(c: Column) -> Column:
    """A link's host without "www."; other texts as they are."""
    host = F.regexp_extract(c, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", F.regexp_replace(F.lower(host), r"^www\.", "")).otherwise(c)


def trimmed_url(c: Column) -> Column:
    """A link for comparison: lower case without closing slashes."""
    return F.regexp_replace(F.lower(c), "/+$", "")


def url_variants(c: Column) -> Column:
    """Spellings of one link: both schemes, with and without "www.", with and without a closing slash."""
    rest = F.regexp_replace(trimmed_url(c), r"^https?://(?:www\.)?", "")
    return F.flatten(F.array(*(F.array(F.concat(F.lit(s + w), rest), F.concat(F.lit(s + w), rest, F.lit("/"))) for s in ("https://", "http://") for w in ("", "www."))))


# Labels of well-known sites, in this order.
SITE_LABELS = (("calendar.google.com", "Google Calendar"), ("docs.google.com", "Google Sheets"), ("facebook.com", "Facebook"), ("hashrego.com", "Hash Rego"), ("meetup.com", "Meetup"), ("blogspot.com", "Blogspot"), ("digitalpress.blog", "DigitalPress"))


def url_label(url: Column, given: Column) -> Column:
    """A given label, else the site's name, else its host."""
    host = domain(url)
    out = F.when(url.rlike(r"(?i)^https?://"), host).otherwise("Source")
    for site, label in reversed(SITE_LABELS):
        out = F.when((host == site) | host.endswith("." + site), label).otherwise(out)
    out = F.when((host == "google.com") & url.rlike(r"(?i)^https?://(?:www\.)?google\.com/calendar"), "Google Calendar").otherwise(out)
    return F.when(given.isNotNull() & (given != "Source") & (given != ""), given).otherwise(out)


def plain_text(markdown: Column) -> Column:
    """Markdown without emphasis, links' addresses, headings, quotes and list marks."""
    for pattern, to in ((r"\*{3,}", "\n\n"), (r"\*\*(.+?)\*\*", "$1"), (r"\*(.+?)\*", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"(?m)^>\s+", ""), (r"(?m)^[-*+]\s+", ""), (r"\n{3,}", "\n\n")):
        markdown = F.regexp_replace(markdown, pattern, to)
    return F.regexp_replace(markdown, r"^\s+|\s+$", "")


def display_title(title: Column, short: Column, full: Column, run: Column) -> Column:
    """A title, or the organiser's name with the run where it says no more than that."""
    fallback = F.when(run > 0, F.concat(short, F.lit(" \u2014 Run #"), run.cast("string"))).otherwise(short)
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+hash\s+house\s+harriers$", ""), r"\s+hash$", ""), r"\s+h3$", ""))
    t = F.trim(F.coalesce(title, F.lit("")))
    says_no_more = (t == "") | t.rlike(r"^\(.*\)$") | t.rlike(r"(?i)^run\s*#?\d+$") | (bare(t) == F.trim(F.lower(short))) | F.coalesce((bare(full) != "") & (bare(t) == bare(full)), F.lit(False))
    return F.when(says_no_more, fallback).otherwise(t)


def display_location(name: Column, city: Column) -> Column:
    """Place and city, or the place alone where it names the city or ends in a state."""
    n = blank_to_null(F.regexp_replace(name, r"https?://\S+", ""))
    town = F.trim(F.split_part(city, F.lit(","), F.lit(1)))
    word = lambda c: F.concat(F.lit("[^a-z0-9]"), F.regexp_replace(F.lower(c), r"([^a-z0-9\s])", r"\\$1"), F.lit("[^a-z0-9]"))
    within = lambda c: F.regexp_like(F.concat(F.lit(" "), F.lower(n), F.lit(" ")), word(c))
    told = within(city) | ((town != "") & within(town)) | n.rlike(r", [A-Za-z]{2}(?:\s+\d{5}(?:-\d{4})?)?\s*$")
    return F.when(n.isNull() | city.isNull() | (city == ""), F.coalesce(F.when(city != "", city), n)).when(told, n).otherwise(F.concat(n, F.lit(", "), city))


def normal_url(c: Column) -> Column:
    """Lower-case host without "www.", no fragment, query or closing slashes."""
    host = F.regexp_replace(F.lower(F.try_parse_url(c, F.lit("HOST"))), r"^www\.", "")
    return F.concat(host, F.regexp_replace(F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit("")), "/+$", ""))
