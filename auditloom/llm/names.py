"""Variant spellings of names: pigeonhole segment join with banded edit distance.

A name is split once into the offering it denotes and the spellings of its
organisation: its text in CJK, all its words in other scripts, and weak forms
(nicknames, acronyms, cut words).  How offerings and kinds of organisations are
worded is the caller's to give (``Wording``); with an empty one every word counts.

Distinct spellings are compared, not names, each at its full length: each is cut
into k + 1 segments, k growing with its length, an inverted index holds them,
every spelling looks up its substrings at the positions that k edits can shift a
segment to, and banded edit distance verifies what meets there.  Where a segment is
short, and so many spellings could share it, its key also holds what the rest
leaves when it loses up to one character, so that no list of the index grows
with the corpus but by spellings that are alike.  A spelling belongs to its
commonest neighbour; text in CJK to the words it is written with most often.

Scale: names are made distinct before Python sees them; all joins are equi-joins
on short keys with partial aggregates; nothing is collected or broadcast; the
pairs of one source, which TESTDATA asks for, are spread over blocks.

Defined results: null and blank names do not come out; equal names are one name;
a name without an offering denotes the default one; names without any
organisation are one source only where their letters are the same; weak forms
belong to an organisation only where exactly one with that offering fits; names
may have any length and script.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.text import banded_distance, deletions, normal
from auditloom.session import checkpointed

#: Fewest characters of a spelling in CJK and of another word that may hold an edit, and characters for each further one.
EDIT_CJK, EDIT_WORD, MORE_EACH = 4, 6, 12
#: Most edits of the longest spellings; up to here k + 1 segments and one undone swap lose nothing.
MOST_EDITS = 4
#: Letters of a word that is no mere abbreviation.
WHOLE_WORD = 5
#: Segments shorter than this are looked up with the rest of their spelling.
SHORT_SEGMENT = 4
#: Share of a word's names that the commonest CJK spelling beside it has at least; below, it is a common word.
FAIR_SHARE = 0.2
#: Names of a source that meet in one block at most.
BLOCK = 1000


@dataclass(frozen=True)
class Wording:
    """What a caller knows of the words in names.

    ``offerings`` and ``kinds`` (of organisations) give each its ways of writing,
    ``default`` is what a name without an offering denotes, ``dated`` are the
    offerings whose year counts.
    """

    offerings: dict[str, list[str]] = field(default_factory=dict)
    kinds: dict[str, list[str]] = field(default_factory=dict)
    default: str = ""
    dated: frozenset[str] = frozenset()

    @cached_property
    def by_form(self) -> list[tuple[str, str]]:
        return sorted(((f, o) for o, fs in self.offerings.items() for f in fs), key=lambda x: -len(x[0]))

    @cached_property
    def words(self) -> re.Pattern | None:
        forms = [rf"(?<![a-z]){re.escape(f)}(?![a-z])".replace(r"\ ", " ?") for f, _ in self.by_form if f.isascii()]
        return re.compile("|".join(forms)) if forms else None

    @cached_property
    def of_word(self) -> dict[str, str]:
        return {f.replace(" ", ""): o for f, o in self.by_form if f.isascii()}

    @cached_property
    def full_kinds(self) -> list[str]:
        return sorted((k for k in self.kinds if not k.isascii()), key=lambda k: -len(k))

    @cached_property
    def short_kinds(self) -> dict[str, str]:
        return {f: k for k, fs in self.kinds.items() for f in fs if not f.isascii()}

    @cached_property
    def kind_words(self) -> dict[str, str]:
        return {f: k for k, fs in self.kinds.items() for f in [k, *fs] if f.isascii()}

    def is_kind(self, word: str) -> bool:
        return word in self.kind_words or len(word) > 5 and any(k.isascii() and abs(len(k) - len(word)) < 2 and banded_distance(word, k, 1) <= 1 for k in self.kinds)


_YEAR = re.compile(r"(?:19|20)\d\d")
_CJK = re.compile(r"[㐀-鿿]+")
_WORD = re.compile(r"([^\W_㐀-鿿]+)(\.?)")
_NICK = re.compile(r"^(?:[老小](.)|(.)家|(.)\3)(.{0,4})$")


def parse(name: str, wording: Wording) -> dict:
    """The source that a name tells and the spellings of its organisation."""
    text = unicodedata.normalize("NFKC", name)
    # words written together: a capital within, or a script change
    text = normal(re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", text))
    text = re.sub(r"[·•_@|/\\]+", " ", text)
    plain = re.sub(r"[\W_]+", "", text)
    year = offer = ""
    if wording.words and (m := wording.words.search(text)):
        offer = wording.of_word[m[0].replace(" ", "")]
        text = text[: m.start()] + " " + text[m.end() :]
    if m := _YEAR.search(text):
        year = m[0]
        text = text[: m.start()] + " " + text[m.end() :]
    # a long form counts anywhere, a short one where CJK begins or ends
    if not offer:
        for form, o in wording.by_form:
            if not form.isascii() and (len(form) > 2 or o == wording.default) and form in text:
                offer = o
                i = text.rindex(form)
                text = text[:i] + " " + text[i + len(form) :]
                break
    runs = _CJK.findall(text)
    if not offer and runs:
        for form, o in wording.by_form:
            hit = next((i for i in range(len(runs) - 1, -1, -1) if not form.isascii() and runs[i].endswith(form) and not any(runs[i].endswith(k) for k in wording.full_kinds)), None)
            if hit is not None:
                offer = o
                runs[hit] = runs[hit][: -len(form)]
                break
    cjk, end = "".join(runs), ""
    if kind := next((k for k in wording.full_kinds if cjk.endswith(k) and len(cjk) > len(k)), None):
        cjk, end = cjk[: -len(kind)], kind[-1]
    nick = (m[1] or m[2] or m[3]) + (m[4][-1:] or end) if (m := _NICK.match(cjk)) else ""
    words, short, weak = [], [], ""
    for m in _WORD.finditer(text):
        word = m[1]
        if wording.is_kind(word):
            continue
        if m[2] or len(word) == 1:
            weak = weak or word + m[2]
        elif len(word) < WHOLE_WORD:
            short.append(word)
        else:
            end_kind = next((k for k in wording.kind_words if len(k) > 4 and word.endswith(k) and len(word) - len(k) >= EDIT_WORD), None)
            words.append(word[: -len(end_kind)] if end_kind else word)
    return {
        "source": f"{offer or wording.default}{year if offer in wording.dated else ''}", "cjk": cjk, "kind": end, "nick": nick,
        "words": sorted({*words, *short}) if words else [], "weak": "" if words else weak or "".join(short[:1]),
        "rest": " ".join(sorted(short)) or plain,
    }


def acronyms(spelling: str) -> list[str]:
    """How an organisation's words are shortened: initials, or of one word its first consonants, letter and letters."""
    words = spelling.split()
    if len(words) > 1:
        return ["".join(w[0] for w in words)]
    consonants = re.sub("[aeiou]", "", spelling)
    return sorted({consonants[:3], spelling[0] + ".", spelling[:4] + ".", spelling[:3] + "."})


def edits(spelling: str) -> int:
    """Edits within which another spelling can be the same word, by its length."""
    n, least = len(spelling), EDIT_CJK if _CJK.match(spelling) else EDIT_WORD
    return 0 if n < least else min(MOST_EDITS, 1 + n // MORE_EACH)


def cuts(length: int, k: int) -> list[tuple[int, int]]:
    """Begin and length of the ``k + 1`` segments of a text of this length."""
    n = k + 1
    small, more = divmod(length, n)
    out, at = [], 0
    for i in range(n):
        size = small + (i >= n - more)
        out.append((at, size))
        at += size
    return out


def _keys(text: str, length: int, j: int, at: int, n: int, gone: tuple[int, ...]) -> list[str]:
    """The keys of one segment; a long one by its digest, a short one with what the rest is when it loses ``gone`` characters."""
    head = f"{length}|{j}|"
    piece = text[at : at + n]
    if n > 24:
        return [head + hashlib.md5(piece.encode("utf-8", "surrogatepass")).hexdigest()]
    if n >= SHORT_SEGMENT:
        return [head + piece]
    rest = text[:at] + "\x1f" + text[at + n :]
    return [f"{head}{piece}|{r}" for r in sorted(deletions(rest, 1)) if len(rest) - len(r) in gone]


def index_keys(spelling: str) -> list[str]:
    """Keys under which a spelling stands in the inverted index."""
    n, k = len(spelling), edits(spelling)
    return [f"{n}|=|{spelling}"] if not k else [x for j, (a, size) in enumerate(cuts(n, k)) for x in _keys(spelling, n, j, a, size, (0, 1))]


def _sample(length: int, cjk: bool) -> int:
    return edits(("一" if cjk else "a") * length)


def probe_keys(spelling: str) -> list[str]:
    """Keys at which every spelling is found that lies within its own number of edits.

    A segment that is found ``s`` places away has at least ``s`` edits on one side
    and what the lengths differ beyond that on the other.  A swap of neighbours
    across a border of segments changes both, so the spelling with that pair
    swapped looks up too.
    """
    n, cjk = len(spelling), bool(_CJK.match(spelling))
    out = set() if edits(spelling) else {f"{n}|=|{spelling}"}
    for length in range(max(1, n - MOST_EDITS), n + MOST_EDITS + 1):
        k = _sample(length, cjk)
        if abs(length - n) > k or not k:
            continue
        segments = cuts(length, k)
        forms = {spelling}
        if abs(length - n) < k:
            borders = {a + s for a, _ in segments[1:] for s in range(1 - k, k)}
            forms |= {spelling[: b - 1] + spelling[b] + spelling[b - 1] + spelling[b + 1 :] for b in borders if 0 < b < n}
        for j, (a, size) in enumerate(segments):
            for s in range(-k, k + 1):
                if abs(s) + abs(n - length - s) <= k and 0 <= a + s <= n - size:
                    for form in forms:
                        out.update(_keys(form, length, j, a + s, size, (0,) if n < length else (1,)))
    return sorted(out)


def neighbours(spellings: DataFrame, wording: Wording = Wording()) -> DataFrame:
    """``script, core, near``: all pairs of distinct spellings (``script``, ``core``) within the edits of either.

    Pigeonhole: of k + 1 segments, k edits leave one unchanged, at most k places
    away.  A spelling in CJK that ends with a short form of a kind of organisation
    is also near what it is without that end, and what is near that, one way
    (``both`` is false).
    """
    ends = sorted(wording.short_kinds, key=len)

    @F.pandas_udf("array<string>")
    def index(s: pd.Series) -> pd.Series:
        return s.map(index_keys)

    @F.pandas_udf("array<struct<form:string, key:string>>")
    def probe(s: pd.Series) -> pd.Series:
        def keys(x: str) -> list[dict]:
            forms = [x[: -len(e)] for e in ends if x.endswith(e) and len(x) - len(e) >= 2]
            forms = {f: probe_keys(f) if len(f) >= EDIT_CJK else index_keys(f) for f in forms} | {x: probe_keys(x)}
            return [{"form": f, "key": k} for f, ks in forms.items() for k in ks]

        return s.map(keys)

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series, own: pd.Series) -> pd.Series:
        most = [edits(y) if o or len(x) >= EDIT_CJK else 0 for x, y, o in zip(a, b, own)]
        return pd.Series([banded_distance(x, y, k) <= k for x, y, k in zip(a, b, most)], dtype=bool)

    # few bytes, much work: as many tasks as any shuffle has
    spellings = spellings.repartition(int(spellings.sparkSession.conf.get("spark.sql.shuffle.partitions")), "core")
    indexed = spellings.select("script", F.col("core").alias("near"), F.explode(index("core")).alias("key"))
    probes = spellings.select("script", "core", F.explode(probe("core")).alias("_p")).select("script", "core", F.col("_p.form").alias("form"), F.col("_p.key").alias("key"))
    met = probes.join(indexed, ["script", "key"]).where("core <> near").select("script", "core", "form", "near").distinct()
    met = met.withColumn("both", F.col("form") == F.col("core"))
    return met.where(close("form", "near", "both")).groupBy("script", "core", "near").agg(F.max("both").alias("both"))


def hubs(counted: DataFrame, wording: Wording) -> DataFrame:
    """``script, core, hub``: every spelling with the one it belongs to, from ``script, core, n``.

    That is the spelling around it, itself included, that has most names around:
    slips of one spelling lie around it, not around each other.  One that ends with
    a short form of a kind belongs to what is left without it.
    """
    text = F.col("core")
    cut = F.array(*[F.when(text.endswith(e) & (F.length(text) >= len(e) + EDIT_CJK), F.substring(text, F.lit(1), F.length(text) - len(e))) for e in sorted(wording.short_kinds)], F.lit(None).cast("string"))
    bare = counted.where("script = 'c'").select("script", F.explode(F.filter(cut, lambda c: c.isNotNull())).alias("core"), F.lit(0).cast("bigint").alias("n"))
    counted = checkpointed(counted.unionByName(bare).groupBy("script", "core").agg(F.sum("n").alias("n")))
    near = checkpointed(neighbours(counted.select("script", "core"), wording))
    back = near.select("script", F.col("near").alias("core"), F.col("core").alias("near"), "both")
    self = counted.select("script", "core", F.col("core").alias("near"), F.lit(True).alias("both"))
    around = near.unionByName(back).unionByName(self).select("script", "core", "near").distinct()
    weight = around.join(counted.withColumnRenamed("core", "near"), ["script", "near"]).groupBy("script", "core").agg(F.sum("n").alias("w"), F.max(F.when(F.col("core") == F.col("near"), F.col("n"))).alias("n"))
    choice = near.unionByName(back.where("both")).unionByName(self)
    sized = choice.join(weight.withColumnRenamed("core", "near"), ["script", "near"])
    hub = checkpointed(sized.groupBy("script", "core").agg(F.max(F.struct(~F.col("both"), "w", "n", "near")).getField("near").alias("hub")))
    above = hub.select("script", F.col("core").alias("hub"), F.col("hub").alias("top"))
    return hub.join(above, ["script", "hub"]).select("script", "core", F.col("top").alias("hub"))


def parsed_names(names: DataFrame, name_col: str, wording: Wording) -> DataFrame:
    """Every distinct name that is not blank, with its parts."""
    schema = "name string, source string, cjk string, kind string, nick string, words array<string>, weak string, rest string"
    cols = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{"name": n} | parse(n, wording) for n in b["name"]], columns=cols)

    distinct = names.select(F.col(name_col).alias("name")).where(F.col("name").isNotNull()).distinct()
    filled = distinct.where(F.regexp_replace("name", r"[\s\x{00A0}\x{2000}-\x{200F}\x{3000}\x{FEFF}]+", "") != "")
    return filled.mapInPandas(run, schema)


def _main(rows: DataFrame, key: str, share: float) -> DataFrame:
    """``key, latin``: what a key stands with most often (``n``), if that has the share."""
    best = F.max(F.struct("n", "latin"))
    return rows.groupBy(key).agg(best.alias("_b"), F.sum("n").alias("_n")).where(F.col("_b.n") >= share * F.col("_n")).select(key, F.col("_b.latin").alias("latin"))


def link_names(names: DataFrame, name_col: str, wording: Wording = Wording()) -> DataFrame:
    """``name, organisation, source`` of every name; names with both equal are one source."""
    parts = checkpointed(parsed_names(names, name_col, wording))
    spelt = parts.select("name", F.explode(F.concat(F.array(F.struct(F.lit("c").alias("script"), F.col("cjk").alias("core"))), F.transform("words", lambda w: F.struct(F.lit("w").alias("script"), w.alias("core"))))).alias("_f"))
    spelt = spelt.select("name", "_f.*").where("core <> ''")
    hub = checkpointed(hubs(spelt.groupBy("script", "core").agg(F.count("*").alias("n")), wording))
    # the words of a name as one key, whatever their order
    latin = spelt.where("script = 'w'").join(hub, ["script", "core"]).groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("hub")), " ").alias("latin"))
    of_cjk = hub.where("script = 'c'").select(F.col("core").alias("cjk"), F.col("hub").alias("cjk_hub"))
    whole = checkpointed(parts.join(of_cjk, "cjk", "left").join(latin, "name", "left"))

    beside = checkpointed(whole.where("cjk_hub is not null and latin is not null").groupBy("cjk", "cjk_hub", "latin").agg(F.count("*").alias("n")))
    # a word beside many spellings in CJK, none of which has a fair share of it, is a common word
    each = beside.groupBy("latin", "cjk_hub").agg(F.sum("n").alias("n"))
    common = each.groupBy("latin").agg(F.max("n").alias("_m"), F.sum("n").alias("_n")).where(F.col("_m") < FAIR_SHARE * F.col("_n")).select("latin")
    beside = beside.join(common, "latin", "left_anti")
    own = _main(beside, "cjk", 0.5).withColumnRenamed("latin", "own")
    other = _main(beside.groupBy("cjk_hub", "latin").agg(F.sum("n").alias("n")), "cjk_hub", 1 / 3).withColumnRenamed("latin", "partner")
    whole = whole.join(common.withColumn("is_common", F.lit(True)), "latin", "left").join(own, "cjk", "left").join(other, "cjk_hub", "left")
    word = F.coalesce(F.when(F.col("is_common").isNull(), F.col("latin")), "own", "partner")
    organisation = F.coalesce(F.concat(F.lit("w:"), word), F.when(F.col("nick") == "", F.concat(F.lit("c:"), "cjk_hub")), F.concat(F.lit("w:"), "latin"))
    whole = checkpointed(whole.withColumn("organisation", organisation).select("name", "source", "organisation", "cjk_hub", "kind", "nick", "weak", "rest"))
    known = whole.where("organisation is not null")

    @F.pandas_udf("array<string>")
    def shortened(spelling: pd.Series) -> pd.Series:
        return spelling.map(acronyms)

    strong = known.where(F.col("organisation").startswith("w:")).select("organisation", "source").distinct().select("organisation", "source", F.explode(shortened(F.substring("organisation", 3, 1 << 30))).alias("key"))
    nicks = known.where("cjk_hub is not null and kind <> ''").select("organisation", "source", "kind", F.explode(F.array_distinct(F.split("cjk_hub", ""))).alias("_c")).select("organisation", "source", F.concat("_c", "kind").alias("key"))
    only = strong.unionByName(nicks).groupBy("source", "key").agg(F.min("organisation").alias("one"), F.max("organisation").alias("other")).where("one = other")
    loose = whole.where("organisation is null").withColumn("key", F.when(F.col("weak") != "", F.col("weak")).when(F.length("nick") > 1, F.col("nick")))
    alone = F.coalesce(F.concat(F.lit("c:"), "cjk_hub"), F.when(F.col("rest") != "", F.concat(F.lit("="), "rest")), F.concat(F.lit("?"), "name"))
    loose = loose.join(only.select("source", "key", "one"), ["source", "key"], "left").select("name", F.coalesce("one", alone).alias("organisation"), "source")
    return known.select("name", "organisation", "source").unionByName(loose)


def _bucket(n: Column) -> Column:
    return F.pmod(F.xxhash64("name"), n).cast("int")


def variant_pairs(names: DataFrame, name_col: str, wording: Wording = Wording()) -> DataFrame:
    """``name_a, name_b``: all pairs of different spellings of one source.

    The names of a large source are dealt to buckets, and each two buckets meet in
    a block of their own.
    """
    linked = checkpointed(link_names(names, name_col, wording))
    size = linked.groupBy("organisation", "source").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_k"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    dealt = linked.join(size, ["organisation", "source"]).withColumn("_b", _bucket(F.col("_k")))
    blocks = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda i: F.struct(F.least(i, "_b").alias("i"), F.greatest(i, "_b").alias("j")))
    dealt = dealt.select("organisation", "source", "name", F.explode(blocks).alias("_at")).select("organisation", "source", "name", "_at.i", "_at.j")
    a, b = dealt.withColumnRenamed("name", "name_a"), dealt.withColumnRenamed("name", "name_b")
    return a.join(b, ["organisation", "source", "i", "j"]).where("name_a < name_b").select("name_a", "name_b")


def variant_classes(names: DataFrame, name_col: str, wording: Wording = Wording()) -> DataFrame:
    """``name, class_id, n_links``: the class of each name (its smallest spelling) and its links."""
    linked = checkpointed(link_names(names, name_col, wording))
    classes = linked.groupBy("organisation", "source").agg(F.min("name").alias("class_id"), (F.count("*") - 1).alias("n_links"))
    return linked.join(classes, ["organisation", "source"]).select("name", "class_id", "n_links")
