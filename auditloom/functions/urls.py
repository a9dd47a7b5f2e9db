"""Expressions on addresses; a scheme is never required."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def strip_anchors(url: Column) -> Column:
    """Without citation anchors (``#`` and digits) at the end; words after ``#`` stay."""
    return F.regexp_replace(url, r"(#[0-9]+)+\z", "")


def canonical(url: Column) -> Column:
    """The key of a page for deduplication: no citation anchors, scheme or closing slash."""
    return F.regexp_replace(F.regexp_replace(strip_anchors(url), _SCHEME, ""), r"/\z", "")


def variants(url: Column) -> Column:
    """The forms under which evidence may hold a candidate's address."""
    bare = F.regexp_replace(url, _SCHEME, "")
    return F.array_distinct(F.array(url, bare, F.regexp_replace(url, r"/\z", ""), F.regexp_replace(bare, r"/\z", "")))


def is_pdf(url: Column) -> Column:
    return F.lower(path(url)).endswith(".pdf")


def is_deep(url: Column) -> Column:
    """At least three slashes within the path."""
    inner = F.regexp_replace(path(url), r"^/+|/+$", "")
    return F.length(inner) - F.length(F.replace(inner, F.lit("/"), F.lit(""))) >= 3


def sanitized(name: Column) -> Column:
    """A name for a directory: characters that paths cannot have become ``_``; a default for nothing."""
    clean = F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r'[\s/\\:*?"<>|]', "_")
    return F.when(clean == "", "未命名领域").otherwise(clean)
