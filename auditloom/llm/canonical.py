"""Free entries mapped to a reference list: token-level repair and soft TF-IDF.

The reference list gives the vocabulary: the phrases of an entry are its name,
the terms of its scope note, and what a caller's table adds.  A phrase has two
forms, itself and the words that other phrases cut it into; each word weighs
its inverse document frequency among the phrases.

Every distinct value is split into tokens: its text without blanks, that text
without affixes, its words, and the stretches of CJK text that are as long as a
reference token.  Affixes are learned: what stands before or behind many other
values.  Each distinct token is joined to the vocabulary by edit distance,
through the deletion variants that two texts within that distance share.  The
repaired tokens are combined: a phrase scores the weighted share of its tokens
that were found, each with its similarity (soft TF-IDF), and the best supported
phrase that covers most of the value decides.  If the rows carry entries of their
own, some of them right, tokens that keep one entry's company become phrases of
it, and ties are broken by that company.

Scale: values are aggregated before Python sees them; the reference list and the
caller's table are of checked size and the only things broadcast; a token longer
than any phrase and its edits has no variants, as nothing can lie within reach;
distinct tokens meet the vocabulary in an equi-join, so no pair is formed that
shares no variant; rows get their entry in a join with one row for each distinct
value.

Defined results: null and blank values do not come out; a value that fits no
entry comes out with ''; ties go to the entry that the rows' own entries name
most often, then to the phrase that stands further right, then to the first
entry.  Values may have any length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.text import banded_distance, deletions, normal
from auditloom.session import checkpointed

#: Phrases of a reference list at most; it is broadcast.
MAX_PHRASES = 50_000
#: Share of a phrase's weight that must be found, and where rows of the value carry the entry.
ENOUGH, ENOUGH_TOLD = 0.7, 0.6
#: Longest affix, and different values that it must stand beside to be one.
AFFIX, AFFIX_USES = 6, 5
#: Rows of one entry beside a token, and their share of all rows with an entry beside it, that make it a phrase of the entry.
LEARNED, LEARNED_SHARE = 6, 0.35
#: What a learned phrase counts beside one of the list, and its longest text.
LEARNED_WEIGHT, LEARNED_LENGTH = 0.7, 24
_EDGE = " -*/。.,，、;；:：~·()（）[]【】\"'“”"
_CJK = re.compile(r"[㐀-鿿]+")
_LATIN = re.compile(r"[a-z]+|[0-9]+")
#: What separates the terms of a scope note, and what ends them (fixed values).
_TERMS, _TERM_END = re.compile(r"[、，,；;/]|与|和|及|或|等"), re.compile(r"等$")


def core(raw: str) -> str:
    """The value without decoration: normal form, no blanks between CJK, no punctuation around."""
    text = re.sub(r"(?<=[㐀-鿿]) +| +(?=[㐀-鿿])", "", normal(raw))
    return text.strip(_EDGE)


def compact(text: str) -> str:
    return re.sub(r"[\W_]+", "", text)


def allowed(token: str) -> int:
    """Edits that a whole token may be away from a reference token."""
    return 0 if len(token) < 2 or (len(token) == 2 and token.isascii()) else 1 if len(token) < 6 else 2


def split_tokens(raw: str, lengths: set[int]) -> list[tuple[str, str, int, int]]:
    """``(token, kind, position, length of the whole)`` of one value."""
    text = core(raw)
    whole = compact(text)
    out = {(whole, "whole", 0)} if whole else set()
    if whole.isascii():
        out |= {(w, "word", m.start()) for m in _LATIN.finditer(text) if len(w := m[0]) > 2}
    for run in _CJK.finditer(whole):
        for n in lengths:
            for i in range(len(run[0]) - n + 1):
                out.add((run[0][i : i + n], "part", run.start() + i))
    for m in _LATIN.finditer(whole):
        if not whole.isascii() and len(m[0]) > 2:
            out.add((m[0], "part", m.start()))
    return [(t, k, p, len(whole)) for t, k, p in out if t]


def similarity(token: str, target: str, kind: str) -> float:
    """1 for equal tokens, less with each edit, 0 beyond what the kind allows."""
    if token == target:
        return 1.0
    most = allowed(target)
    if kind == "part":  # a stretch of a longer text has to be surer
        most = 1 if len(target) >= 3 and len(token) == len(target) else 0
    if len(target) == 2 and len(token) != 2:
        most = 0
    d = banded_distance(token, target, most) if most else 1
    return 1 - d / (len(target) + 1) if d <= most else 0.0


class Entry(NamedTuple):
    """An entry of a reference list; an ``exact`` one is meant by nothing but its name."""

    name: str
    note: str = ""
    also: tuple[str, ...] = ()
    exact: bool = False


def note_terms(note: str) -> list[str]:
    """The terms that a scope note lists."""
    return [t for x in _TERMS.split(note or "") if (t := _TERM_END.sub("", x.strip()))]


def _cut(phrase: str, known: list[str]) -> list[str]:
    """The words of a phrase: Latin words, and in CJK the stretches that other phrases leave of it."""
    if phrase.isascii():
        return _LATIN.findall(phrase)
    text = compact(phrase)
    inner = [k for k in known if len(k) < len(text) and k in text]
    words = re.split("(" + "|".join(map(re.escape, inner)) + ")", text) if inner else [text]
    return [w for w in words if w]


def vocabulary(entries: list[Entry]) -> list[tuple[str, int, str, int, float]]:
    """``(entry, phrase number, token, length of the phrase, weight)`` of every reference token."""
    phrases = [(e.name, p) for e in entries if not e.exact for p in dict.fromkeys([e.name, *note_terms(e.note), *e.also])]
    if len(phrases) > MAX_PHRASES:
        raise ValueError("the reference list is larger than the documented bound")
    texts = [normal(p) for _, p in phrases]
    known = sorted({compact(t) for t in texts if _CJK.fullmatch(compact(t)) and len(compact(t)) >= 2}, key=lambda t: (-len(t), t))
    forms = []
    for number, ((entry, _), text) in enumerate(zip(phrases, texts)):
        words = _cut(text, known)
        forms += [(entry, number * 2, [compact(text)], len(compact(text)))] + ([(entry, number * 2 + 1, words, len(compact(text)))] if len(words) > 1 else [])
    holds: dict[str, int] = {}
    for _, _, tokens, _ in forms:
        for t in set(tokens):
            holds[t] = holds.get(t, 0) + 1
    rows = []
    for entry, number, tokens, length in forms:
        idf = {t: math.log(1 + len(forms) / holds[t]) for t in tokens}
        rows += [(entry, number, t, length, w / sum(idf.values())) for t, w in idf.items()]
    return rows


def _affixes(cores: DataFrame) -> DataFrame:
    """``side, affix`` from distinct ``core``: what stands before or behind many other values."""
    n = F.length("core")
    size = F.sequence(F.lit(1), F.least(F.lit(AFFIX), n - 2))
    before = F.transform(size, lambda k: F.struct(F.lit("before").alias("side"), F.substring("core", F.lit(1), k).alias("affix"), F.substring("core", k + 1, n).alias("core")))
    behind = F.transform(size, lambda k: F.struct(F.lit("behind").alias("side"), F.substring("core", n - k + 1, k).alias("affix"), F.substring("core", F.lit(1), n - k).alias("core")))
    parts = cores.where(n > 2).select(F.explode(F.concat(before, behind)).alias("_a")).select("_a.*")
    return parts.join(cores.select("core"), "core").groupBy("side", "affix").agg(F.count("*").alias("n")).where(F.col("n") >= AFFIX_USES).select("side", "affix")


def _stripped(cores: DataFrame) -> DataFrame:
    """``core, bare, cut``: every core without an affix before it, behind it, or both, and how much was cut before."""
    known = checkpointed(_affixes(cores))
    size = lambda c: F.sequence(F.lit(1), F.least(F.lit(AFFIX), F.length(c) - 2))
    long = cores.where(F.length("core") > 2).withColumn("k", F.explode(size("core"))).withColumn("affix", F.substring("core", F.lit(1), F.col("k")))
    front = long.join(known.where("side = 'before'"), "affix").select("core", F.substring("core", F.col("k") + 1, F.length("core")).alias("bare"), F.col("k").alias("cut"))
    ways = front.unionByName(cores.select("core", F.col("core").alias("bare"), F.lit(0).alias("cut")))
    tail = ways.where(F.length("bare") > 2).withColumn("k", F.explode(size("bare"))).withColumn("affix", F.substring("bare", F.length("bare") - F.col("k") + 1, F.col("k")))
    back = tail.join(known.where("side = 'behind'"), "affix").select("core", F.substring("bare", F.lit(1), F.length("bare") - F.col("k")).alias("bare"), "cut")
    return front.unionByName(back)


def map_values(values: DataFrame, value_col: str, entries: list[Entry], hints: DataFrame | None = None) -> DataFrame:
    """``value_col, entry, score`` of every distinct value; entry '' if none fits.

    ``hints`` (value, entry, n) tells which entries the rows of a value carry.
    """
    spark = values.sparkSession
    rows = vocabulary(entries)
    lengths = {len(t) for _, _, t, _, _ in rows if _CJK.fullmatch(t) and len(t) >= 2}
    longest = max([len(t) for _, _, t, _, _ in rows] + [LEARNED_LENGTH] * (hints is not None)) + 2

    @F.pandas_udf("array<struct<token:string, kind:string, pos:int, whole:int>>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda v: split_tokens(v, lengths))

    @F.pandas_udf("array<string>")
    def variants(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: sorted(deletions(t, allowed(t))) if len(t) <= longest else [t])

    @F.pandas_udf("double")
    def alike(token: pd.Series, target: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([similarity(*x) for x in zip(token, target, kind)], dtype="float64")

    distinct = values.select(value_col).where(F.col(value_col).isNotNull()).distinct()
    tokens = checkpointed(distinct.withColumn("_t", F.explode(split(value_col))).select(value_col, "_t.*"))
    own = tokens.where("kind = 'whole'").select(value_col, F.col("token").alias("core"))
    bare = _stripped(own.select("core").distinct())
    bare = own.join(bare, "core").select(value_col, F.col("bare").alias("token"), F.lit("whole").alias("kind"), F.col("cut").alias("pos"), F.length("core").alias("whole"))
    tokens = checkpointed(tokens.unionByName(bare.distinct()))

    phrases = spark.createDataFrame([(e, n, t, length, w, i, 1.0) for i, (e, n, t, length, w) in enumerate(rows)], "entry string, phrase int, target string, length int, weight double, ordinal int, trust double")
    targets = spark.createDataFrame([(t, k) for t in sorted({r[2] for r in rows}) for k in sorted(deletions(t, allowed(t)))], "target string, variant string")
    targets, phrases = F.broadcast(targets), F.broadcast(phrases)  # of checked size
    company = None
    if hints is not None:
        company = checkpointed(tokens.where("kind = 'whole'").join(hints.select(value_col, "entry", "n"), value_col).groupBy("token", "entry").agg(F.sum("n").alias("n"), F.sum(F.when(F.length("token") == F.col("whole"), F.col("n")).otherwise(0)).alias("typed")))
        # what was typed as a whole; affixes cut off may have changed the meaning
        typed = company.where("typed > 0").select("token", "entry", F.col("typed").alias("n")).where(F.length("token") <= LEARNED_LENGTH)
        learned = typed.groupBy("token").agg(F.max(F.struct("n", "entry")).alias("_b"), F.sum("n").alias("n")).where((F.col("_b.n") >= LEARNED) & (F.col("_b.n") >= LEARNED_SHARE * F.col("n")))
        learned = learned.select(F.col("_b.entry").alias("entry"), (-1 - F.pmod(F.xxhash64("token"), F.lit(1 << 30))).cast("int").alias("phrase"), F.col("token").alias("target"), F.length("token").alias("length"), F.lit(1.0).alias("weight"), F.lit(1 << 30).alias("ordinal"), F.lit(LEARNED_WEIGHT).alias("trust"))
        learned = checkpointed(learned.join(phrases.select("target").distinct(), "target", "left_anti").select(*phrases.columns))
        phrases = phrases.unionByName(learned)
        targets = targets.unionByName(learned.select("target", F.explode(variants("target")).alias("variant")))

    words = tokens.select("token", "kind").distinct().repartition("token")
    near = words.withColumn("variant", F.explode(variants("token"))).join(targets, "variant").select("token", "kind", "target").distinct()
    near = near.withColumn("sim", alike("token", "target", "kind")).where("sim > 0")

    found = tokens.join(near, ["token", "kind"]).join(phrases, "target")
    # a stretch of the value counts by its share of the value, the value as a whole fully
    cover = F.when(F.col("kind") == "whole", F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("length") / F.col("whole")))
    # soft TF-IDF: each token of a phrase counts once, with its best repair
    best = found.groupBy(value_col, "entry", "phrase", "target").agg(F.max("sim").alias("sim"), F.max(cover).alias("cover"), F.first("weight").alias("weight"), F.max("pos").alias("pos"), F.min("ordinal").alias("ordinal"), F.max("trust").alias("trust"))
    scored = best.groupBy(value_col, "entry", "phrase").agg(
        F.sum(F.col("sim") * F.col("weight")).alias("support"), F.max("pos").alias("pos"), F.avg("cover").alias("cover"), F.min("ordinal").alias("ordinal"), F.max("trust").alias("trust")
    )
    scored = scored.where(F.col("support") >= ENOUGH_TOLD).withColumn("score", F.round(F.col("support") * F.col("cover") * F.col("trust"), 6))
    if company is not None:
        told = tokens.where("kind = 'whole'").select(value_col, "token").join(company, "token").groupBy(value_col, "entry").agg(F.max("n").alias("hint"))
        scored = scored.join(told, [value_col, "entry"], "left")
    else:
        scored = scored.withColumn("hint", F.lit(None).cast("bigint"))
    scored = scored.where((F.col("support") >= ENOUGH) | F.col("hint").isNotNull())
    # a maximum instead of a window: it is combined map-side
    pick = F.max(F.struct("score", F.coalesce("hint", F.lit(0)).alias("hint"), "pos", (-F.col("ordinal")).alias("first"), "entry"))
    chosen = scored.groupBy(value_col).agg(pick.alias("_p")).select(value_col, "_p.entry", "_p.score")
    return distinct.join(chosen, value_col, "left").select(value_col, F.coalesce("entry", F.lit("")).alias("entry"), F.coalesce("score", F.lit(0.0)).alias("score"))


def map_rows(df: DataFrame, id_col: str, value_col: str, entries: list[Entry], hint_col: str | None = None, fallback: Column | None = None) -> DataFrame:
    """``id_col, entry`` of every row of ``df`` whose value is neither null nor blank nor exactly an entry."""
    names = [e.name for e in entries]
    blank = F.regexp_replace(value_col, r"[\s\x{00A0}\x{00AD}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{2064}\x{3000}\x{FEFF}]+", "") == ""
    rows = df.where(F.col(value_col).isNotNull() & ~blank & ~F.col(value_col).isin(names))
    hints = None
    if hint_col:
        told = rows.where(F.col(hint_col).isin([e.name for e in entries if not e.exact]) & (F.lit(True) if fallback is None else ~fallback))
        hints = told.groupBy(value_col, F.col(hint_col).alias("entry")).agg(F.count("*").alias("n"))
    mapped = map_values(rows, value_col, entries, hints).select(value_col, "entry")
    return rows.select(id_col, value_col).join(mapped, value_col).select(id_col, "entry")
