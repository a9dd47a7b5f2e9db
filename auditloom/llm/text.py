"""Small text tools: normal forms and edit distance with a band."""

from __future__ import annotations

import re
import unicodedata
from os.path import commonprefix

#: Traditional characters and their simplified forms (fixed values).
TRADITIONAL = str.maketrans(
    "報庫數測據術標網會區開業電論專檢絡協聯導體檔實驗團產試參準資訊發訓課碼倉庫導學獻聞項頁門戶題誌規範書證機構與層級單華東龍馬鳳麗",
    "报库数测据术标网会区开业电论专检络协联导体档实验团产试参准资讯发训课码仓库导学献闻项页门户题志规范书证机构与层级单华东龙马凤丽",
)

_INVISIBLE = re.compile(r"[­᠎​-‏ -‮⁠-⁤﻿]")


def normal(text: str) -> str:
    """Compatibility form, simplified characters, lower case, single blanks, nothing invisible."""
    text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).translate(TRADITIONAL).lower()
    return " ".join(text.split())


def banded_distance(a: str, b: str, most: int) -> int:
    """Edit distance (insertion, deletion, substitution, swap of neighbours) or ``most + 1`` if it is larger.

    Only the ``2 * most + 1`` diagonals that can matter are computed and held, so
    time and memory grow with length times ``most``.
    """
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    head = len(commonprefix((a, b)))
    a, b = a[head:], b[head:]
    tail = len(commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        return min(max(len(a), len(b)), most + 1)
    big, width = most + 1, 2 * most + 1
    # cell d of row i is the distance of a[:i] and b[:i + d - most]
    two, before = [big] * width, [big] * most + list(range(most + 1))
    for i in range(1, len(a) + 1):
        row = [big] * width
        for d in range(width):
            j = i + d - most
            if j < 0 or j > len(b):
                continue
            best = before[d + 1] + 1 if d + 1 < width else big
            if j:
                best = min(best, before[d] + (a[i - 1] != b[j - 1]), row[d - 1] + 1 if d else big)
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    best = min(best, two[d] + 1)
            row[d] = min(best, big)
        if min(row) > most:
            return big
        two, before = before, row
    return before[len(b) - len(a) + most]


def deletions(text: str, most: int) -> set[str]:
    """``text`` and all texts left by deleting up to ``most`` of its characters."""
    out = last = {text}
    for _ in range(most):
        last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t))}
        out = out | last
    return out
