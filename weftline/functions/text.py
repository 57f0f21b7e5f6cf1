"""Text expressions that Spark evaluates in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def terms(text: str | Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def query_terms(text: str | Column) -> Column:
    """Distinct terms of at least two characters, in order of appearance."""
    return F.array_distinct(F.filter(terms(text), lambda t: F.length(t) > 1))


def token_count(text: str | Column) -> Column:
    """A token for every four characters, one at least."""
    c = F.col(text) if isinstance(text, str) else text
    return F.greatest(F.lit(1), F.floor((F.length(c) + 3) / 4).cast("int"))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def sentences(text: str | Column) -> Column:
    """Pieces between white space that follows a full stop, question or exclamation mark."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), stripped), lambda s: s != "")


def item_id(source: str, text: str) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", source, text)), 1, 12)


def document_id(text: str) -> Column:
    return F.substring(F.sha1(F.col(text)), 1, 16)


def preview(text: str | Column, n: int) -> Column:
    """White space collapsed, cut to ``n`` characters with an ellipsis."""
    c = F.col(text) if isinstance(text, str) else text
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.substring(flat, 1, n - 3), F.lit("...")))


def age(ts: str, as_of: Column) -> Column:
    return F.greatest(F.lit(0.0), as_of - F.col(ts))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def html_text(html: str) -> Column:
    """Scripts and styles, then tags, replaced by spaces."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"<[^>]+>", " ")
