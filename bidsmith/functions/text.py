"""Text and vector measures as built-in expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidsmith.config import CODE_MARKS, ERROR_INDICATORS, ERROR_WORDS, HTML_MARKS, IMPORTANT_WORDS
from bidsmith.functions import sequences

TOKEN = r"([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|\b\d{4,}\b|[a-z0-9_]+)"
WORD = r"(\w+)"


def tokens(text: Column) -> Column:
    """Lower-case identifiers, numbers and words."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


def normal(text: Column) -> Column:
    """Lower case, without punctuation, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]", ""), r"\s+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(normal(text), " "), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two word sets; two empty sets share nothing."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def single_bm25(own: Column, query: Column) -> Column:
    """(bm25, matched) of one document's tokens for a query's, the document itself being the mean length: an Arrow-batched function."""
    x = sequences.matched_terms(own, query)
    base = F.least(F.lit(1.0), x["raw"] / 10)
    return F.when(own.isNotNull() & query.isNotNull(), F.struct(F.when(x["long"], F.least(F.lit(1.0), base + 0.3)).otherwise(base).alias("bm25"), x["matched"].alias("matched")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, held to [0, 1]; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))))


def clipped(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays of text."""
    return sequences.shared_grams(1)(a, b)[0]


def token_f1(a: Column, b: Column) -> Column:
    """Harmonic mean of multiset precision and recall."""
    both = clipped(a, b)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(both == 0, 0.0).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def bleu(a: Column, b: Column, most: int = 4) -> Column:
    """Geometric mean of the clipped n-gram precisions of a that aren't 0; no brevity penalty."""
    both = sequences.shared_grams(most)(a, b)
    shares = [F.try_divide(both[n - 1], F.greatest(F.lit(0), F.size(a) - (n - 1))) for n in range(1, most + 1)]
    logs = F.filter(F.array(*(F.when(s > 0, F.ln(s)) for s in shares)), lambda x: x.isNotNull())
    return F.when(F.size(logs) > 0, F.exp(F.aggregate(logs, F.lit(0.0), lambda s, x: s + x) / F.size(logs))).otherwise(0.0)


def estimated_tokens(text: Column) -> Column:
    """Characters by kind of content (4; JSON 3.2; code, where its marks stand more than twice in 1,000 characters, 3.5), rounded, plus the marks of URLs and 2 for each UUID; 1 at least, 0 for no text."""
    as_json = text.rlike(r"^\s*[\[{]") & F.try_parse_json(text).isNotNull()
    base = F.floor(F.length(text) / F.when(as_json, 3.2).when(F.regexp_count(text, F.lit(CODE_MARKS)) > F.length(text) / 500, 3.5).otherwise(4.0) + 0.5)
    urls = F.regexp_extract_all(text, F.lit(r"(https?://\S+)"), F.lit(1))
    marks = F.length(F.regexp_replace(F.array_join(urls, ""), r"[^/?&]", ""))
    uuids = F.size(F.regexp_extract_all(text, F.lit(r"([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})"), F.lit(1)))
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), base + marks + 2 * uuids)).cast("bigint")


def is_html(text: Column) -> Column:
    """A doctype or html tag at the start, or two marks in the first 2,000 characters."""
    own = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    head = F.substring(own, 1, 2000)
    marks = sum((F.contains(head, F.lit(m)).cast("int") for m in HTML_MARKS), F.lit(0))
    return own.startswith("<!doctype html") | own.startswith("<html") | (marks >= 2)


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles, navigation and tags go, five entities are read, white space is one space."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|nav|head|footer)\b.*?</\1>", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]+>", " ")
    for entity, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(c))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def has_errors(text: Column) -> Column:
    own = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for w in ERROR_INDICATORS:
        out = out | F.contains(own, F.lit(w))
    return out


def line_score(line: Column, context: list[str], anchors: tuple[str, ...] = ()) -> Column:
    """0.3 a context word (over 2 characters), 0.4 an anchor, 0.2 for a class mark, 0.1 unless blank; 1 at most."""
    low = F.lower(line)
    total = F.lit(0.0)
    for w in dict.fromkeys(x.lower() for x in context):
        if len(w) > 2:
            total = total + F.when(F.contains(low, F.lit(w)), 0.3).otherwise(0.0)
    for a in anchors:
        total = total + F.when(F.contains(low, F.lit(a.lower())), 0.4).otherwise(0.0)
    marked = low.rlike(ERROR_WORDS) | low.rlike(IMPORTANT_WORDS) | line.rlike(r"^#+\s") | line.rlike(r"^\*\*") | line.rlike(r"^>\s")
    return F.least(F.lit(1.0), total + F.when(marked, 0.2).otherwise(0.0) + F.when(F.trim(line) != "", 0.1).otherwise(0.0))


def simhash(text: Column, gram: int = 4) -> Column:
    """64-bit SimHash (as a signed integer) over character grams; md5's first 16 hex digits are the gram hashes."""
    return sequences.simhashes(gram)(F.lower(F.coalesce(text, F.lit(""))))


def decayed(importance: Column, age_days: Column, accesses: Column, rate: float) -> Column:
    """Exponential decay, up to 0.3 back for accesses."""
    out = importance * F.exp(-rate * age_days)
    return F.when(accesses > 0, F.least(F.lit(1.0), out + F.least(F.lit(0.3), accesses * 0.05))).otherwise(out)


def ranking(importance: Column, age_days: Column, accesses: Column) -> Column:
    return importance * (1 / (1 + age_days * 0.1)) * F.least(F.lit(1.0), 0.5 + accesses * 0.1)


def fitting(entries: Column, budget: int) -> Column:
    """Of an array of structs with cost, in order: those that still fit the budget; others are skipped."""
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.filter(entries, lambda e: F.lit(False)).alias("kept"))
    step = lambda s, e: F.when(s["used"] + e["cost"] <= budget, F.struct((s["used"] + e["cost"]).alias("used"), F.concat(s["kept"], F.array(e)).alias("kept"))).otherwise(s)
    return F.aggregate(entries, start, step)["kept"]
