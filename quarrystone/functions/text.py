"""Scalar text, hash and geometry expressions; all of them are Catalyst built-ins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LATIN = "[a-z0-9]+(?:[-_.:/][a-z0-9]+)*"
CJK = "[一-鿿]+"
#: Named entities that are unescaped, in the order of replacement; the ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of the value, which is evaluated once, however often ``use`` names it and in whatever lambda: an expression that a lambda names
    is otherwise evaluated anew for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalized(text: Column) -> Column:
    """Case-folded, with runs of white space as one blank. Folding is exact for Latin text."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"\s+", " "))


def lexical_tokens(text: Column) -> Column:
    """Latin runs, and of every CJK run the run itself and its bigrams (a run of two counts twice)."""
    low = normalized(text)
    pairs = lambda run: F.when(F.length(run) > 1, F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda k: F.substring(run, k, 2)))
    cjk = F.transform(F.regexp_extract_all(low, F.lit(CJK), F.lit(0)), lambda run: F.concat(F.array(run), F.coalesce(pairs(run), F.array())))
    latin = F.regexp_extract_all(low, F.lit(LATIN), F.lit(0))
    return F.when(low.rlike(CJK), F.concat(latin, F.flatten(cjk))).otherwise(latin)


def inner_tokens(text: Column) -> Column:
    """Distinct lexical tokens of every text that contains this one: Latin runs but those at its two ends, bigrams of CJK runs.

    A CJK run itself may go on in the other text; a Latin run may where nothing stands before or after it, or a
    separator that joins it to what follows."""
    low = normalized(text)
    latin = F.regexp_extract_all(F.regexp_replace(F.regexp_replace(low, "^[a-z0-9_.:/-]+", " "), "[a-z0-9_.:/-]+$", " "), F.lit(LATIN), F.lit(0))
    pairs = F.filter(lexical_tokens(text), lambda t: (F.length(t) == 2) & t.rlike(f"^{CJK}$"))
    return F.array_distinct(F.concat(latin, pairs))


def html_text(html: Column) -> Column:
    """Script and style bodies go, tags become line feeds, common entities are unescaped."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", "\n")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^0-9a-z一-鿿]", "")


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by NUL."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def unit(vector: Column) -> Column:
    """L2-normalised; a zero vector is an error."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(vector, lambda x: x / F.when(norm > 0, norm).otherwise(F.raise_error(F.lit("zero vector"))))


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def area(box: Column) -> Column:
    return F.greatest(F.lit(0.0), box[2] - box[0]) * F.greatest(F.lit(0.0), box[3] - box[1])


def overlap(a: Column, b: Column) -> Column:
    """Area of the intersection of two boxes (left, top, right, bottom)."""
    return area(F.array(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])))


def iou(a: Column, b: Column) -> Column:
    both = overlap(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def page_sized(box: Column) -> Column:
    """Width and height of at least 0.92 and area of at least 0.88 once clipped to the page."""
    w = F.least(F.lit(1.0), box[2]) - F.greatest(F.lit(0.0), box[0])
    h = F.least(F.lit(1.0), box[3]) - F.greatest(F.lit(0.0), box[1])
    return (w >= 0.92) & (h >= 0.92) & (w * h >= 0.88)
