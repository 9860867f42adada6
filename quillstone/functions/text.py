"""Text as Column expressions: tokens, metadata lines, previews, tags, names and dates.

Everything here is a built-in expression, so it runs inside the scan's stage.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that queries drop; fixed values.
STOP_WORDS = (
    "that", "this", "with", "from", "have", "been", "were", "will", "when", "which", "their", "there", "about", "would", "could", "should", "into",
    "also", "each", "does", "just", "more", "than", "then", "them", "some", "only", "other", "very", "after", "before", "most", "same", "both",
)

#: A run of ASCII letters and digits, or a run that starts at a non-ASCII character; and the parts of
#: a compound, in ASCII and in other runs.
SEGMENT = r"[A-Za-z0-9]++|[^\x00-\x7F][A-Za-z0-9\x{80}-\x{10FFFF}]*+"
#: The same without runs of one byte, for counting.
LONG_SEGMENT = r"[A-Za-z0-9]{2,}+|[^\x00-\x7F][A-Za-z0-9\x{80}-\x{10FFFF}]*+"
#: A capital after another character of its run: only texts with one have compounds.
COMPOUND = r"[A-Za-z0-9\x{80}-\x{10FFFF}][A-Z]"
ASCII_PARTS = r"^[^A-Z]+|[A-Z][^A-Z]*"
OTHER_PARTS = r"^[^\p{Lu}]+|\p{Lu}[^\p{Lu}]*"
METADATA_LINE = r"^\[(tags|source|type|modified|tier|confidence|links|linked from):"
FIRST_CONTENT = r"(?:\A|\n)(?! *(?:\n|\z))(?! *\[(?:tags|source|type|modified|tier|confidence|links|linked from):)([^\n]*)"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-cased tokens of two bytes or more in order; the parts of a compound stand before it."""

    def expand(seg: Column) -> Column:
        whole = F.lower(seg)
        parts = F.when(F.octet_length(seg) == F.length(seg), _all(seg, ASCII_PARTS)).otherwise(_all(seg, OTHER_PARTS))
        parts = F.filter(F.transform(parts, F.lower), lambda p: (F.octet_length(p) >= 2) & (p != whole))
        return F.when(seg.rlike(".[A-Z]"), F.concat(parts, F.array(whole))).otherwise(F.array(whole))

    text = F.coalesce(text, F.lit(""))
    segs = F.filter(_all(text, SEGMENT), lambda s: F.octet_length(s) >= 2)
    return F.when(text.rlike(COMPOUND), F.flatten(F.transform(segs, expand))).otherwise(F.transform(segs, F.lower))


def once(col: Column) -> Column:
    """col, held back from being written out again in filters and projections that use it: the optimizer
    doesn't move what isn't deterministic. For what is dear, such as tokens."""
    return F.when(F.monotonically_increasing_id() >= 0, col)


def query_tokens(text: Column) -> Column:
    """Distinct tokens that are no stop words, in order."""
    return F.array_distinct(F.filter(tokens(text), lambda t: ~t.isin(*STOP_WORDS)))


def _py_tokens(text: str) -> list[str]:
    out = []
    for seg in re.findall(r"[A-Za-z0-9]+|[^\x00-\x7F](?:[A-Za-z0-9]|[^\x00-\x7F])*", text):
        if len(seg.encode()) < 2:
            continue
        if re.search(".[A-Z]", seg):
            up = str.isupper if not seg.isascii() else lambda c: "A" <= c <= "Z"
            part = ""
            for c in [*seg, None]:
                if c is None or (part and up(c)):
                    if len(part.encode()) >= 2 and part.lower() != seg.lower():
                        out.append(part.lower())
                    part = ""
                part += c or ""
        out.append(seg.lower())
    return out


def query_terms(query: str) -> list[str]:
    """query_tokens of a Python string, for planning."""
    return list(dict.fromkeys(t for t in _py_tokens(query) if t not in STOP_WORDS))


def lines(body: Column) -> Column:
    return F.split(F.coalesce(body, F.lit("")), "\n")


def _values(body: Column, key: str) -> Column:
    """What stands in the `[key: …]` lines."""
    head = f"[{key}: "
    hit = F.filter(lines(body), lambda x: x.startswith(head) & x.endswith("]"))
    return F.transform(hit, lambda x: F.substring(x, F.lit(len(head) + 1), F.length(x) - len(head) - 1))


def _last(values: Column) -> Column:
    return F.get(values, F.size(values) - 1)


def tags_of(body: Column) -> Column:
    """Tags of the last tag line."""
    cut = F.transform(F.split(F.coalesce(_last(_values(body, "tags")), F.lit("")), ","), lambda t: F.trim(t))
    return F.filter(cut, lambda t: t != "")


def source_of(body: Column) -> Column:
    return F.trim(_last(_values(body, "source")))


def confidence_of(body: Column) -> Column:
    """The last confidence that is a number, else 1."""
    numbers = F.filter(F.transform(_values(body, "confidence"), lambda v: F.trim(v).try_cast("double")), lambda v: v.isNotNull())
    return F.coalesce(_last(numbers), F.lit(1.0))


def links_of(body: Column) -> Column:
    """(topic, idx) of the last links line; pairs without a number are dropped."""
    pairs = F.filter(F.split(F.coalesce(_last(_values(body, "links")), F.lit("")), r"\s+"), lambda p: p.rlike(r"^.*:\d+$"))
    return F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^(.*):(\d+)$", 1).alias("topic"), F.regexp_extract(p, r"^(.*):(\d+)$", 2).cast("long").alias("idx")))


def content_lines(body: Column) -> Column:
    """Lines that are neither blank nor metadata."""
    return F.filter(lines(body), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(METADATA_LINE))


def first_content(body: Column) -> Column:
    """The first of content_lines, read no further than there; empty if there is none."""
    return F.regexp_extract(F.coalesce(body, F.lit("")), FIRST_CONTENT, 1)


def truncated(text: Column, n: int) -> Column:
    """The longest front part of at most n bytes that ends between two characters."""
    cut = F.substring(text, 1, n)
    fits = F.filter(F.sequence(F.lit(0), F.least(F.length(text), F.lit(n))), lambda k: F.octet_length(F.substring(text, F.lit(1), k)) <= n)
    return F.when(F.octet_length(text) <= n, text).when(F.octet_length(cut) <= n, cut).otherwise(F.substring(text, F.lit(1), F.array_max(fits)))


def day_of(ts_min: Column) -> Column:
    return F.floor(ts_min / 1440)


def date_text(ts_min: Column) -> Column:
    """`YYYY-MM-DD HH:MM` of minutes since the epoch; 0 is unknown."""
    return F.when(ts_min == 0, "unknown").otherwise(F.date_format(F.timestamp_seconds(ts_min.cast("long") * 60), "yyyy-MM-dd HH:mm"))


def freshness(days_old: Column) -> Column:
    return F.when(days_old == 0, "today").when(days_old == 1, "yesterday").when(days_old <= 7, "this week").otherwise("")


def snippet(topic: Column, ts_min: Column, body: Column) -> Column:
    """`[topic] date first two content lines`, at most 120 bytes of content, cut at a word."""
    text = F.concat_ws(" ", F.slice(F.transform(content_lines(body), lambda x: F.trim(x)), 1, 2))
    cut = truncated(text, 120)
    worded = F.when(cut == text, text).when(F.instr(cut, " ") > 0, F.regexp_extract(cut, r"^(.*) [^ ]*$", 1)).otherwise(cut)
    return F.concat(F.lit("["), topic, F.lit("] "), date_text(ts_min), F.lit(" "), worded)


def singular(tag: Column) -> Column:
    n = F.octet_length(tag)
    stem = lambda k: F.substring(tag, F.lit(1), F.length(tag) - k)
    return (
        F.when(n <= 3, tag).when(tag.endswith("ies") & (n > 4), F.concat(stem(3), F.lit("y"))).when(tag.endswith("sses"), stem(2))
        .when(tag.endswith("s") & ~tag.endswith("ss") & ~tag.endswith("us") & ~tag.endswith("is"), stem(1)).otherwise(tag)
    )


def normal_tags(tags: Column) -> Column:
    """Trimmed, singular, lower-cased, distinct and sorted."""
    clean = F.transform(tags, lambda t: F.lower(singular(F.trim(t))))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda t: t != "")))


#: What a first line may begin with, and the tag it then gets; fixed values.
PREFIX_TAGS = (
    ("gotcha:", "gotcha"), ("deploy gotcha:", "gotcha"), ("invariant:", "invariant"), ("security:", "invariant"), ("decision:", "decision"), ("design:", "decision"),
    ("architectural", "decision"), ("module:", "module-map"), ("overview:", "architecture"), ("data flow:", "data-flow"), ("flow:", "data-flow"), ("perf:", "performance"),
    ("benchmark:", "performance"), ("hot path:", "performance"), ("gap:", "gap"), ("missing:", "gap"), ("todo:", "gap"), ("friction", "gap"), ("how-to:", "how-to"),
    ("impl:", "how-to"), ("impl spec:", "how-to"), ("shipped", "how-to"), ("playbook:", "how-to"), ("coupling:", "coupling"), ("change impact:", "change-impact"),
    ("transformation:", "coupling"), ("pattern:", "pattern"), ("feature:", "how-to"), ("bug:", "gotcha"), ("fix:", "how-to"),
)


def auto_tags(text: Column) -> Column:
    """Tags that the first line that isn't blank asks for, in the table's order."""
    first = F.lower(F.trim(F.coalesce(F.get(F.filter(lines(text), lambda x: F.trim(x) != ""), F.lit(0)), F.lit(""))))
    hits = F.array(*(F.when(first.startswith(p), t) for p, t in PREFIX_TAGS))
    return F.array_distinct(F.filter(hits, lambda t: t.isNotNull()))


def composed(text: Column, tags: Column, source: Column, confidence: Column, links: Column) -> Column:
    """A body: metadata lines for what is not null, then the text; confidence only under 1."""
    return F.concat_ws(
        "\n",
        F.when(F.length(tags) > 0, F.concat(F.lit("[tags: "), tags, F.lit("]"))), F.when(source.isNotNull(), F.concat(F.lit("[source: "), source, F.lit("]"))),
        F.when(confidence < 1, F.concat(F.lit("[confidence: "), confidence.cast("string"), F.lit("]"))), F.when(F.length(links) > 0, F.concat(F.lit("[links: "), links, F.lit("]"))), text,
    )


def topic_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}-]", "-")


def glob_pattern(glob: str) -> str:
    """`*` matches anything; without one the glob is a substring."""
    return "^" + ".*".join(re.escape(p) for p in glob.split("*")) + "$" if "*" in glob else re.escape(glob)


def source_is(source: Column, name: str) -> Column:
    """Whether a source's path, without the line after it, is a file's name or ends in it after a slash."""
    return F.regexp_replace(source, r":\d+$", "").rlike("(^|/)" + re.escape(name) + "$")


def source_holds(source: Column, part: str) -> Column:
    return source.contains(part)


def label_words(line: Column, n: int = 3) -> Column:
    """The first n words, up to the first that opens a bracket, holds a slash or is a dash or arrow."""
    words = F.filter(F.split(F.regexp_replace(line, r"^[#*\- ]+", ""), r"\s+"), lambda w: w != "")
    stop = lambda w: w.startswith("(") | w.startswith("[") | w.contains("/") | w.isin("→", "--", "—")
    first = F.array_min(F.filter(F.transform(words, lambda w, i: F.when(stop(w), i)), lambda i: i.isNotNull()))
    kept = F.slice(words, F.lit(1), F.least(F.coalesce(first, F.size(words)), F.lit(n)))
    return F.regexp_replace(F.array_join(kept, " "), r"[:,;—]+$", "")


def dominant_term(line: Column) -> Column:
    """The longest capitalised word of three bytes or more, the last of equals; null without one."""
    words = F.transform(F.split(line, r"\s+"), lambda w: F.regexp_replace(F.regexp_replace(w, r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}]+$", ""))
    fit = F.filter(words, lambda w: (F.octet_length(w) >= 3) & w.rlike(r"^\p{Lu}"))
    best = F.aggregate(fit, F.lit(""), lambda a, w: F.when(F.octet_length(w) >= F.octet_length(a), w).otherwise(a))
    return F.nullif(best, F.lit(""))


def token_hash(term: str) -> int:
    """FNV-1a of the UTF-8 bytes, 64 bits; 0 becomes 1."""
    h = 0xCBF29CE484222325
    for b in term.encode():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h or 1
