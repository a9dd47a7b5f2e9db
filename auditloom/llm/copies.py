"""Copies hidden by formatting: dictionary encoding and compact integer tuples.

A record is described by fields.  Every distinct raw value is canonicalised
once, each canonical (field, value) gets an integer from one dictionary, and a
record becomes the sorted tuple of the integers of its field values.  Records
with one tuple are copies.

Scale: the raw values are aggregated before Python sees them (map-side combine,
so a value that a third of all rows share is one row after the partial
aggregate); the dictionary is written to the checkpoint folder, because its ids
must not change when a lost executor makes a stage run again; groups are never
gathered, the smallest id of a group is a partial aggregate that is joined back.
In that join one side has one row for each key, so a hot key streams and AQE may
split it.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.session import checkpointed

#: White space and characters without width, which may stand anywhere in an address.
_BLANK = re.compile(r"[\s\u00ad\u180e\u200b-\u200f\u2028-\u202e\u2060-\u2064\ufeff]+")
_SCHEME = re.compile(r"^(?:[a-z][a-z0-9+.\-]*:)?/{2,}|^(?:https?|ftp):/*")
_EDGE = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c not in "#%=-_~") + "“”‘’「」『』【】〈〉《》、。，；：！？·…"
_HOST = re.compile(r"^(?:[^\W_](?:[\w\-]*[^\W_])?\.)+[^\W\d_][\w\-]*$|^localhost$|^\d{1,3}(?:\.\d{1,3}){3}$")
_LABEL = re.compile(r"^[^\W_](?:[\w\-]*[^\W_])?$")
_IPV6 = re.compile(r"^([0-9a-f:.]*:[0-9a-f:.]*:[0-9a-f:.]*)\](?::(\d*))?$")
#: Ports that go without saying.
_USUAL = {"", "80", "443"}


def _without_anchors(text: str) -> str:
    """``text`` without ``#`` and digits at its end; digits that no ``#`` precedes stay."""
    head = text.rstrip("#0123456789")
    cut = text.find("#", len(head))
    return text if cut < 0 else text[:cut]


def page_fields(address: str | None) -> list[tuple[str, str]] | None:
    """The (field, value) pairs of the page that ``address`` names, or None if it names none.

    Fields are ``host`` (with a port beside the usual ones), ``path<position>`` and
    ``query<parameter>``.  A host of one label needs a scheme before it.  Scheme, user,
    white space, case, width of characters, surrounding and doubled punctuation,
    order and repetition of parameters and trailing ``#digits`` have no effect.
    """
    if not address:
        return None
    text = _BLANK.sub("", unicodedata.normalize("NFKC", address)).lower().replace("。", ".")
    if "&" in text and ";" in text:
        text = html.unescape(text)
    before = None
    while before != text:  # anchors and wrapping punctuation alternate at the end
        before, text = text, _without_anchors(text.rstrip(_EDGE))
        text = text.lstrip(_EDGE.replace("/", ""))
    told = bool(_SCHEME.match(text))
    text = _SCHEME.sub("", text).lstrip(_EDGE)
    place, _, params = text.partition("?")
    host, *path = re.split(r"[/\\]+", place)
    host = host.rpartition("@")[2].lstrip(_EDGE)
    if m := _IPV6.match(host):
        host, port = f"[{m[1]}]", m[2] or ""
    else:
        host, _, port = host.partition(":")
        host, port = re.sub(r"\.{2,}", ".", host.strip(_EDGE)), port.strip(_EDGE)
        if len(host) > 253 or not (port.isascii() and port.isdigit() or not port) or not (_HOST.match(host) or told and _LABEL.match(host)):
            return None
    if port not in _USUAL:
        host = f"{host}:{port}"
    # punctuation around and between segments and parameters has no effect
    path = [s for s in (x.strip(_EDGE) for x in path) if s]
    pairs = sorted({p for p in (x.strip(_EDGE + "=#") for x in re.split(r"[&;?]+", params)) if p})
    out = [("host", host)]
    out += [(f"path{i}", s) for i, s in enumerate(path)]
    return out + [(f"query {p.partition('=')[0]}", p.partition("=")[2]) for p in pairs]


def _tokens_udf(fields: Callable[[str | None], list[tuple[str, str]] | None]) -> Callable[..., Column]:
    @F.pandas_udf("array<string>")
    def tokens(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in values:
            yield batch.map(lambda v: None if (f := fields(v)) is None else [f"{k}\x1f{x}" for k, x in f])

    return tokens


def encode_values(values: DataFrame, key_col: str, tokens_col: str) -> DataFrame:
    """``key_col, record``: the sorted integer tuple of each array of tokens.

    The keys are integers too, so that no text but that of the dictionary is
    shuffled.
    """
    token = values.select(key_col, F.explode(tokens_col).alias("_token"))
    ids = checkpointed(token.select("_token").distinct().withColumn("_id", F.monotonically_increasing_id()))
    return token.join(ids, "_token").groupBy(key_col).agg(F.array_sort(F.collect_list("_id")).alias("record"))


def collapse_copies(df: DataFrame, id_col: str, value_col: str, scope_cols: list[str] = [], fields: Callable = page_fields) -> DataFrame:
    """``scope_cols, keep_id, n_copies, value`` of every distinct value of ``df``.

    ``keep_id`` is the smallest id of all rows that have the record in their
    scope, ``n_copies`` the number of those rows.  Null, blank and unreadable
    values form no group and do not come out; exact repeats count as copies; an
    empty table gives an empty result.
    """
    src = df.select(*scope_cols, F.col(id_col).alias("_row"), F.col(value_col).alias("value")).where("value is not null")
    distinct = src.groupBy(*scope_cols, "value").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    distinct = distinct.withColumn("_tokens", _tokens_udf(fields)(F.col("value"))).where("_tokens is not null")
    distinct = checkpointed(distinct.withColumn("_key", F.monotonically_increasing_id()))  # Python runs once; keys stay
    coded = distinct.select(*scope_cols, "_key", "_first", "_n").join(encode_values(distinct, "_key", "_tokens"), "_key")
    groups = coded.groupBy(*scope_cols, "record").agg(F.min("_first").alias("keep_id"), F.sum("_n").alias("n_copies"))
    found = coded.join(groups, [*scope_cols, "record"]).select("_key", "keep_id", "n_copies")
    return distinct.join(found, "_key").select(*scope_cols, "keep_id", "n_copies", "value")


def copy_rows(df: DataFrame, id_col: str, value_col: str, scope_cols: list[str] = [], fields: Callable = page_fields) -> DataFrame:
    """``scope_cols, keep_id, copy_id``: one row for every row that repeats an earlier one's page."""
    pages = collapse_copies(df, id_col, value_col, scope_cols, fields).where("n_copies > 1").select(*scope_cols, "value", "keep_id")
    rows = df.select(*scope_cols, F.col(id_col).alias("copy_id"), F.col(value_col).alias("value"))
    return rows.join(pages, [*scope_cols, "value"]).where("copy_id <> keep_id").select(*scope_cols, "keep_id", "copy_id")


def deduplicate(df: DataFrame, id_col: str, value_col: str, fields: Callable = page_fields) -> DataFrame:
    """One row for each page: ``keep_id, value`` as first written and ``n_copies``.

    Rows that name no page are kept one by one, with ``n_copies`` 1.
    """
    pages = collapse_copies(df, id_col, value_col, [], fields).groupBy("keep_id").agg(F.max("n_copies").alias("n_copies"))
    copies = copy_rows(df, id_col, value_col, [], fields).select("copy_id")
    rows = df.select(F.col(id_col).alias("keep_id"), F.col(value_col).alias("value"))
    kept = rows.join(copies, rows.keep_id == copies.copy_id, "left_anti")
    return kept.join(pages, "keep_id", "left").select("keep_id", "value", F.coalesce("n_copies", F.lit(1)).cast("bigint").alias("n_copies"))
