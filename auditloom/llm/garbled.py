"""Text decoded with the wrong encoding: improbable runs and inverse mappings.

One pass counts, over all strings, characters and adjacent pairs in a sketch of fixed
size: a pair has a bin in each of several rows, its count is the least of them, less
what a bin holds anyhow (the row's median: nothing while most bins are empty), so that
pairs never seen stay rare however many others fill the bins.  A pair's score is how far its mutual information lies below a
threshold.  The information is taken within the classes of the two characters
(else all rare scripts would look bound together, garbled ones most) and
discounted where pair or characters are rare; the maximum-scoring segments of these
scores are the improbable runs of a string.  Inside such runs (grown to the
borders of their script) inverse mappings are tried: the run is encoded with a
wrong and decoded with a right encoding, again for text garbled twice, and the
result has to be valid nearly throughout and made of characters that the corpus
knows.  Parts of a garbled string without any improbable or telling pair stay as they are.  Copies of a record make its own pairs look bound together, so no count can
clear a string: where bytes of UTF-8 show under a wrong reading (``telling``), every
run is tried under stricter rules.

Scale: two maps over the records without shuffling them; the bins are summed
map-side, at most ``PAIR_BINS + CHAR_BINS`` numbers leave the executors and are
broadcast, whatever the corpus.

Defined results: null, empty and ASCII strings are never cases; correct text in
any language has no valid inverse and is no case; a replacement character, what one
becomes when it is read as GBK, and a C1 control are damage by definition: a string
with one is a case whatever its scores, and has no restored text; very long strings
are read whole; equal strings are judged alike.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.operators import nested

PAIR_ROWS, ROW_BINS, CHAR_BINS, CLASSES = 4, 1 << 18, 1 << 16, 5
PAIR_BINS = PAIR_ROWS * ROW_BINS
#: Discounted mutual information under which a pair speaks for garbling, most that one pair says, and what a segment needs.
LIKELY, MOST, ENOUGH = 3.0, 3.0, 4.5
#: Share of a run's bytes that an inverse mapping has to explain, and of restored CJK characters that the corpus has to know.
VALID, KNOWN = 0.6, 0.6
#: Encodings with one byte a character that text is wrongly read with, and those of several bytes (fixed values).
SINGLE = ["cp1252", "cp1251", "cp437", "koi8-r", "mac_roman"]
MULTI = ["gb18030", "big5", "cp932"]

_REPLACED = "�"
#: What replacement characters become when their bytes are read as GBK (fixed value).
_REREAD = "锟斤拷"
_WIDE = re.compile(r"[㐀-鿿豈-﫿]")


def _single_table(name: str) -> dict[int, int]:
    """Character -> byte; bytes that cp1252 leaves undefined stand for themselves, as lenient decoders have it."""
    table = {b: b for b in range(256)} if name == "cp1252" else {b: b for b in range(128)}
    for b in range(128, 256):
        try:
            table[ord(bytes([b]).decode(name))] = b
        except UnicodeDecodeError:
            pass
    return table


_TABLES = {n: _single_table(n) for n in SINGLE}


def _encode(run: str, wrong: str) -> bytes:
    if wrong in _TABLES:
        return codecs.charmap_encode(run, "ignore", _TABLES[wrong])[0]
    return run.replace(_REPLACED, "").encode(wrong, "ignore")


def _classes() -> np.ndarray:
    """ASCII, Latin letters, general punctuation, CJK and its neighbours, all else."""
    c = np.full(CHAR_BINS, 4, dtype=np.int8)
    c[:0x80], c[0x80:0x250], c[0x2000:0x2070] = 0, 1, 2
    for a, b in ((0x2E80, 0xA000), (0xAC00, 0xD7B0), (0xE000, 0xFB00), (0xFE30, 0xFE70), (0xFF00, 0xFFF0)):
        c[a:b] = 3
    return c


_CLASS = _classes()


def _shapes() -> tuple[np.ndarray, ...]:
    """By encoding (one bit each): characters read from a leading byte of UTF-8, from one within a character, from both, and from two high bytes."""
    lead, inner, both, high = (np.zeros(CHAR_BINS, dtype=np.uint8) for _ in range(4))
    for bit, table in enumerate(_TABLES.values()):
        for c, b in table.items():
            lead[c] |= (0xC2 <= b < 0xF5) << bit
            inner[c] |= (0x80 <= b < 0xC0) << bit
    for c in _TABLES["cp1252"]:
        high[c] = _TABLES["cp1252"][c] > 0x80
    for bit, name in enumerate(MULTI, len(_TABLES)):
        for c in range(0x80, CHAR_BINS):
            raw = chr(c).encode(name, "ignore")
            if raw:
                both[c] |= (len(raw) > 1 and 0xE3 <= raw[0] < 0xEA and 0x80 <= raw[1] < 0xC0) << bit
                inner[c] |= (0x80 <= raw[0] < 0xC0) << bit
    return lead | both, inner, high


_LEAD, _INNER, _HIGH = _shapes()


def telling(flat: np.ndarray) -> np.ndarray:
    """The places where neighbouring characters can be UTF-8 in a wrong reading, or two bytes a character in cp1252, or a C1 control."""
    c = np.minimum(flat, CHAR_BINS - 1)
    out = (c >= 0x80) & (c < 0xA0) & (c != 0x85)
    out[:-1] |= (_LEAD[c[:-1]] & _INNER[c[1:]]) > 0
    out[:-3] |= (_HIGH[c[:-3]] & _HIGH[c[1:-2]] & _HIGH[c[2:-1]] & _HIGH[c[3:]]) > 0
    return out


class Corpus:
    """What the passes know of all strings: bins of characters and pairs."""

    def __init__(self, chars: np.ndarray, pairs: np.ndarray, classes: np.ndarray):
        self.chars, self.pairs, self.classes = chars, pairs, classes
        n = max(1.0, float(pairs.sum()) / PAIR_ROWS)
        self.noise = float(max(np.median(row) for row in pairs.reshape(PAIR_ROWS, ROW_BINS)))
        self.rare, self.known = max(2.0, n * 2e-5), max(3.0, n * 5e-7)
        total = np.maximum(np.bincount(_CLASS, weights=chars, minlength=CLASSES), 1.0)
        joint = np.maximum(classes.reshape(CLASSES, CLASSES), 1.0)
        self.shift = np.log(total[:, None] * total[None, :] / joint).ravel()

    def information(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Mutual information of adjacent characters within their classes, discounted where they are rare."""
        joint = np.maximum(self.pairs[pair_bins(a, b)].min(axis=0) - self.noise, 0.0)
        a, b = a & (CHAR_BINS - 1), b & (CHAR_BINS - 1)
        ca, cb = self.chars[a].astype(np.float64), self.chars[b].astype(np.float64)
        low = np.minimum(ca, cb)
        pmi = np.log(np.maximum(joint, 0.5) / np.maximum(ca * cb, 1.0)) + self.shift[_CLASS[a].astype(np.int64) * CLASSES + _CLASS[b]]
        return pmi * low / (low + self.rare)

    def scores(self, flat: np.ndarray) -> np.ndarray:
        """For each adjacent pair, how much it speaks for garbling."""
        a, b = flat[:-1], flat[1:]
        s = np.full(len(a), -0.5)
        seen = np.flatnonzero((a > 127) | (b > 127))
        s[seen] = np.clip(LIKELY - self.information(a[seen], b[seen]), -MOST, MOST)
        return s

    def knows(self, text: str) -> float:
        """The share of the non-ASCII characters of ``text`` that are CJK and occur often enough."""
        own = [c for c in text if c > "\x7f"]
        return sum(_kind(c) == 2 and self.chars[ord(c) & (CHAR_BINS - 1)] >= self.known for c in own) / len(own) if own else 0.0


def pair_bins(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bins of pairs, one line for each row of the sketch."""
    key = (a.astype(np.uint64) << np.uint64(21) | b.astype(np.uint64)) + np.uint64(1)
    factors = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)[:PAIR_ROWS, None]
    mixed = key[None, :] * factors
    mixed = (mixed ^ (mixed >> np.uint64(29))) * factors
    return (mixed >> np.uint64(46)).astype(np.int64) + (np.arange(PAIR_ROWS, dtype=np.int64) * ROW_BINS)[:, None]


def codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def count(texts: list[str], chars: np.ndarray, pairs: np.ndarray, classes: np.ndarray) -> None:
    """Add the characters and the pairs with a non-ASCII character of ``texts``."""
    texts = [t for t in texts if not t.isascii()]
    if not texts:
        return
    flat = codes(texts)
    chars += np.bincount(flat & (CHAR_BINS - 1), minlength=CHAR_BINS)
    edge = np.zeros(len(flat), dtype=bool)
    edge[np.cumsum([len(t) for t in texts]) - 1] = True
    a, b = flat[:-1], flat[1:]
    own = ((a > 127) | (b > 127)) & ~edge[:-1]
    a, b = a[own], b[own]
    pairs += np.bincount(pair_bins(a, b).ravel(), minlength=PAIR_BINS)
    classes += np.bincount(_CLASS[a & (CHAR_BINS - 1)].astype(np.int64) * CLASSES + _CLASS[b & (CHAR_BINS - 1)], minlength=CLASSES * CLASSES)


def enough(length: int) -> float:
    """What a segment needs; less in texts too short to reach ENOUGH."""
    return min(ENOUGH, 0.2 * length)


def best_segment(scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The largest sum of neighbouring scores within each string, all strings at once."""
    s = scores.copy()
    s[first[first > 0] - 1] = -1e7  # the pair across two strings: nothing adds up over it
    total = np.r_[0.0, np.cumsum(s)]
    gain = total - np.minimum.accumulate(total)
    return np.maximum.reduceat(gain, first)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int]]:
    """All maximal scoring segments ``[begin, end)`` of pairs (Ruzzo and Tompa)."""
    out: list[tuple[int, int, float, float]] = []
    total = 0.0
    for i, s in enumerate(scores.tolist()):
        before, total = total, total + s
        if s <= 0:
            continue
        seg = (i, i + 1, before, total)
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= seg[2]:
                j -= 1
            if j < 0 or out[j][3] >= seg[3]:
                out.append(seg)
                break
            seg = (out[j][0], seg[1], out[j][2], seg[3])
            del out[j:]
    return [(a, b) for a, b, lo, hi in out if hi - lo >= enough(len(scores) + 1)]


def _kind(c: str) -> int:
    return 0 if c < "\x80" else 2 if _WIDE.match(c) or "⺀" <= c < "ꀀ" or "가" <= c < "힤" or c >= "豈" else 1


def grow(text: str, begin: int, end: int) -> list[tuple[int, int]]:
    """The run without ASCII at its ends and grown over neighbours, so that no encoded character is cut.

    Once over symbols and letters outside CJK, the unit of one-byte readings, and
    once over everything but ASCII, that of readings with several bytes.
    """
    out = []
    for most in (1, 2):
        a, b = begin, end
        while a < b and not 0 < _kind(text[a]) <= most:
            a += 1
        while b > a and not 0 < _kind(text[b - 1]) <= most:
            b -= 1
        if a < b:
            while a > 0 and 0 < _kind(text[a - 1]) <= most:
                a -= 1
            while b < len(text) and 0 < _kind(text[b]) <= most:
                b += 1
            out.append((a, b))
    return out


def inverse(run: str, corpus: Corpus, depth: int = 3) -> str | None:
    """The run as it was meant, or None if no inverse mapping holds."""
    best: tuple[float, str | None] = (0.0, None)
    odd = sum(c > "\x7f" and c != _REPLACED for c in run)
    if not odd:
        return None
    wide = sum(_kind(c) == 2 for c in run) * 2 > odd
    for wrong, right in [(w, "utf-8") for w in (MULTI if wide else SINGLE)] + ([] if wide else [("cp1252", r) for r in ("gb18030", "big5")]):
        raw = _encode(run, wrong)
        high = sum(b > 127 for b in raw)
        if not high or (not wide and high < 0.8 * odd):
            continue
        text = raw.decode(right, "ignore")
        new = "".join(c for c in text if c > "\x7f")
        share = len(new.encode(right, "ignore")) / high
        if not new or share < VALID:
            continue
        known = corpus.knows(new)
        if right != "utf-8":
            # any two letters are a pair of bytes: the characters have to be well known, and more than one
            if len(_WIDE.findall(new)) < 2 or known < 0.8 or share < 0.8:
                continue
        elif known < KNOWN:
            if wide:
                continue
            if depth > 1 and (deeper := inverse(text, corpus, depth - 1)) is not None:
                text, known = deeper, 1.0
            elif share < 0.95 or any("\x80" <= c < "\xa0" for c in new):
                continue
        if share + known > best[0]:
            best = (share + known, text)
    return best[1]


def holds(run: str, corpus: Corpus) -> bool:
    """Whether an inverse mapping of a run holds without regard to how probable its pairs are.

    Several characters that the corpus knows, or one that gives just this run.
    """
    meant = inverse(run, corpus)
    own = [c for c in meant or "" if c > "\x7f"]
    if len(own) > 1 and corpus.knows(meant) >= KNOWN:
        return True
    if not own or any(corpus.chars[ord(c) & (CHAR_BINS - 1)] < corpus.known for c in own):
        return False
    return len(own) > 1 or any(_encode(run, w) == meant.encode() for w in ("cp1252", *MULTI))


def _parts(text: str) -> list[tuple[int, int]]:
    """All runs of one script besides ASCII; a lone symbol within CJK belongs to it."""
    kinds = [1 if c == _REPLACED else _kind(c) for c in text]
    for i in range(1, len(kinds) - 1):
        if kinds[i] == 1 and kinds[i - 1] == kinds[i + 1] == 2:
            kinds[i] = 2
    out: list[tuple[int, int]] = []
    for i, k in enumerate(kinds):
        if k and out and out[-1][1] == i and kinds[i - 1] == k:
            out[-1] = (out[-1][0], i + 1)
        elif k:
            out.append((i, i + 1))
    return out


def _controls(run: str) -> bool:
    return any("\x80" <= c < "\xa0" and c != "\x85" for c in run)


def repair(text: str, corpus: Corpus, scores: np.ndarray | None = None) -> tuple[bool, str | None]:
    """``(garbled, restored)``; restored is None where something is lost for good."""
    if text.isascii():
        return False, text
    lost = _REPLACED in text or _REREAD in text
    flat = codes([text])
    scores = corpus.scores(flat) if scores is None else scores
    told = telling(flat)
    if not lost:
        runs = {r for a, b in maximal_segments(scores) for r in grow(text, a, b + 1)}
        if not any(_controls(text[a:b]) or inverse(text[a:b], corpus) is not None for a, b in runs):
            if not told.any() or not any(told[a:b].any() and (_controls(text[a:b]) or holds(text[a:b], corpus)) for a, b in _parts(text)):
                return False, text
    out, at = [], 0
    for a, b in _parts(text):
        if not (told[a:b].any() or scores[max(0, a - 1) : b].max(initial=0.0) > 0):
            continue  # nothing improbable in it or at its ends
        meant = inverse(text[a:b], corpus)
        if meant is not None:
            out += [text[at:a], meant]
            at = b
        lost = lost or meant is None and _controls(text[a:b])
    return True, None if lost else "".join(out) + text[at:]


def learn(df: DataFrame, column: str) -> tuple[Corpus, set[str]]:
    """Counts over all strings of the JSON column, and its fields that hold arrays of objects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars, pairs, classes = (np.zeros(n, dtype=np.int64) for n in (CHAR_BINS, PAIR_BINS, CLASSES * CLASSES))
        found: set[str] = set()
        for batch in batches:
            texts = []
            for t in batch.column(0).to_pylist():
                nested.array_fields(column, t, found)
                texts += [s for _, s in nested.strings(column, t, set())]
            count(texts, chars, pairs, classes)
        both = np.r_[chars, pairs, classes]
        used = np.flatnonzero(both)
        fields = sorted(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.tolist() + [-1] * len(fields), pa.int32()), pa.array([None] * len(used) + fields, pa.string()), pa.array(both[used].tolist() + [1] * len(fields), pa.int64())],
            ["bin", "chain", "n"],
        )

    sums = df.select(column).mapInArrow(run, "bin int, chain string, n bigint").groupBy("bin", "chain").agg(F.sum("n").alias("n"))
    most = PAIR_BINS + CHAR_BINS + CLASSES * CLASSES + nested.MAX_ARRAY_FIELDS
    got = sums.limit(most + 1).toArrow()
    if got.num_rows > most:
        raise ValueError("the records use data as field names: more array fields than any schema has")
    bins, n = got["bin"].to_numpy(), got["n"].to_numpy()
    both = np.zeros(CHAR_BINS + PAIR_BINS + CLASSES * CLASSES, dtype=np.int64)
    both[bins[bins >= 0]] = n[bins >= 0]
    return Corpus(*np.split(both, [CHAR_BINS, CHAR_BINS + PAIR_BINS])), {c for c in got["chain"].to_pylist() if c is not None}


def judge(texts: list[str], corpus: Corpus) -> dict[str, tuple[bool, str | None]]:
    """Verdict of every string of ``texts`` that has an improbable or telling run or a lost character."""
    odd = [t for t in dict.fromkeys(texts) if len(t) > 1 and not t.isascii()]
    out: dict[str, tuple[bool, str | None]] = {t: (True, None) for t in texts if t == _REPLACED}
    for at in range(0, len(odd), 20_000):
        part = odd[at : at + 20_000]
        flat = codes(part)
        scores = corpus.scores(flat)
        first = np.r_[0, np.cumsum([len(t) for t in part])[:-1]]
        best = best_segment(scores, first)
        told = np.logical_or.reduceat(telling(flat), first)
        for t, f, g, tell in zip(part, first, best, told):
            if g >= enough(len(t)) or tell or _REPLACED in t or _REREAD in t:
                bad = repair(t, corpus, scores[f : f + len(t) - 1])
                if bad[0]:
                    out[t] = bad
    return out


def find_garbled(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """``id_col, field_path, garbled, restored`` of every affected string of a JSON column."""
    corpus, arrays = learn(df, column)
    shared = df.sparkSession.sparkContext.broadcast((corpus.chars, corpus.pairs, corpus.classes))  # of fixed size
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Corpus(*shared.value)
        for batch in batches:
            ids, paths, texts = [], [], []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for path, s in nested.strings(column, t, arrays):
                    if not s.isascii():
                        ids.append(key)
                        paths.append(path)
                        texts.append(s)
            verdict = judge(texts, known)
            keep = [i for i, s in enumerate(texts) if s in verdict]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in keep], batch.column(0).type), *(nested._strings(x) for x in ([paths[i] for i in keep], [texts[i] for i in keep], [verdict[texts[i]][1] for i in keep]))],
                [id_col, "field_path", "garbled", "restored"],
            )

    return df.select(id_col, column).mapInArrow(run, f"`{id_col}` {id_type}, field_path string, garbled string, restored string")
