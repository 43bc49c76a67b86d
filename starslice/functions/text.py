"""Scalar text expressions: names, integers, slugs, markup text. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NBSP = "\u00a0"
EM_DASH = "\u2014"

# Labels that mark a printed total row.
TOTAL_LABELS = ("total", "totals", "grand total", "grand totals")


def strip(text: Column) -> Column:
    """Leading and trailing white space of any kind (``trim`` only knows blanks)."""
    return F.regexp_replace(text, r"^[\s\u00a0]+|[\s\u00a0]+$", "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\u00a0]+", " "))


def normalize_name(name: Column) -> Column:
    """Lower case, no parenthesised text, letters and single spaces only, no trailing "county"."""
    plain = F.regexp_replace(F.lower(F.replace(name, F.lit(NBSP), F.lit(" "))), r"\(.*?\)", " ")
    words = F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^a-z ]", " "), r"\s+", " "))
    return F.regexp_replace(words, r" county$", "")


def clean_int(text: Column) -> Column:
    """``1,231`` -> 1231; blank and dashes -> 0; anything else -> NULL (a reject)."""
    bare = strip(F.regexp_replace(text, r"[,\u00a0]", ""))
    return F.when(bare.isin("", "-", EM_DASH), F.lit(0).cast("long")).when(bare.rlike(r"^\d+$"), bare.try_cast("long"))


def clean_decimal(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("double")


def is_total_label(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(label), r"[^a-z ]", "")).isin(*TOTAL_LABELS)


def slug(label: Column) -> Column:
    """Permit label to slug: no "permittee" prefix, one spelling of non-resident, underscores."""
    s = F.regexp_replace(F.lower(label), r"^permittee\s+", "")
    s = F.regexp_replace(s, r"\bnon-?\s*resident\b", "non_resident")
    return F.regexp_replace(F.regexp_replace(s, r"[^a-z_]+", "_"), r"^_+|_+$", "")


# Named character references that occur in report pages; the ampersand last so that nothing is decoded twice.
NAMED_REFERENCES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "\u2013", "mdash": "\u2014", "minus": "\u2212", "lsquo": "\u2018",
    "rsquo": "\u2019", "ldquo": "\u201c", "rdquo": "\u201d", "hellip": "\u2026", "bull": "\u2022", "middot": "\u00b7", "deg": "\u00b0",
    "frac12": "\u00bd", "times": "\u00d7", "copy": "\u00a9", "reg": "\u00ae", "eacute": "\u00e9", "amp": "&",
}


def _numeric_references(text: Column) -> Column:
    """``&#8212;`` and ``&#x2014;``; a number that is no character stays as it is."""
    def decoded(piece: Column, i: Column) -> Column:
        code = F.coalesce(F.conv(F.nullif(F.regexp_extract(piece, r"^[xX]([0-9a-fA-F]{1,6});", 1), F.lit("")), 16, 10),
                          F.nullif(F.regexp_extract(piece, r"^([0-9]{1,7});", 1), F.lit(""))).cast("long")
        good = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when((i > 0) & good, F.concat(char, F.regexp_replace(piece, r"^[xX0-9a-fA-F]+;", ""))).when(i > 0, F.concat(F.lit("&#"), piece)).otherwise(piece)

    parts = F.array_join(F.transform(F.split(text, "&#"), decoded), "")
    return F.when(F.contains(text, F.lit("&#")), parts).otherwise(text)


def unescape(text: Column) -> Column:
    """Numeric character references and the named ones of ``NAMED_REFERENCES``."""
    text = _numeric_references(text)
    for entity, char in NAMED_REFERENCES.items():
        text = F.replace(text, F.lit(f"&{entity};"), F.lit(char))
    return text


def visible_markup(html: Column) -> Column:
    """Markup without comments, scripts and styles."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>", " ")


def inner_text(fragment: Column) -> Column:
    return collapse(unescape(F.regexp_replace(fragment, r"<[^>]*>", " ")))


# Words kept in lower case inside a feature name.
SMALL_WORDS = ("Of", "The", "De", "And")


def feature_name(name: Column) -> Column:
    """Whitespace collapsed and small words after the first one lower-cased."""
    words = F.split(collapse(name), " ")
    fixed = F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*SMALL_WORDS), F.lower(w)).otherwise(w))
    return F.array_join(fixed, " ")


def route_name(name: Column) -> Column:
    return collapse(F.replace(name, F.lit("I- "), F.lit("I-")))
