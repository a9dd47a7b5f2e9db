"""Template residue, filler and error pages: a linear classifier over hashed n-grams.

Texts are cut into segments (lines and sentences).  A regularised logistic model
over hashed character n-grams, the length and title features scores every
segment, and its score alone decides.  Its labels are weak: response statuses and
phrases name the residue of some pages, and a segment that mostly stands on such
pages is residue too, so wordings without a known phrase are learned from their
neighbours.  It is fitted on a bounded sample of labelled segments and validated
on hosts it has not seen, against the statuses alone, of which neither phrases
nor features know anything (digits are masked).

A document is a case if most of its body (menus and footers aside) is residue, or
if a segment with a placeholder is.  Placeholders, found by a grammar of their
delimiters, are replaced by one symbol before scoring, so the model tells by the
words around it whether one stands for a value or is spoken about; code fences
and quoted code are taken out.

Scale: the fit takes about ``SAMPLE_SEGMENTS`` distinct segments of about
``SAMPLE_DOCUMENTS`` documents, cut by hash where they lie, into one task
whatever the corpus; the model is an array of fixed size, the only thing
broadcast; scoring is one map over whole texts without a shuffle, and scores each
distinct segment of a batch once.

Defined results: null, empty and blank texts are no cases; repeated rows are
judged alike; very long texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.session import checkpointed

#: Bounds of the fit: documents sampled, distinct segments of them that count (half for each label), and their longest.
SAMPLE_DOCUMENTS, SAMPLE_SEGMENTS, SAMPLE_LENGTH = 20_000, 40_000, 4_000
#: Size of the hashed feature space (a power of two) and lengths of n-grams.
FEATURES, ORDERS = 1 << 18, (1, 2, 3, 4)
#: Penalty, passes and share of a body that makes a document a case.
PENALTY, PASSES, MOSTLY = 1e-5, 12, 0.5
#: Share of known phrases that makes all of a page's segments residue for the fit.
WEAK_PAGE = 0.4
#: Stands for any placeholder in a segment that is scored.
MARK = ""

#: Words in brackets that ask for a value (fixed values).
ASKS = r"待(?:填|补)|请?(?:填写|填入|输入|插入)|(?:此处|在此|这里)|(?i:\b(?:insert|enter|add|fill in|todo|tbd)\b|\byour\b[^\[\]()<>\n]*\bhere\b)"


def _asking(begin: str, end: str) -> str:
    """A pair of brackets around words that ask for a value; nothing inside opens another pair, so texts are read in linear time."""
    inner = f"[^{re.escape(begin)}{re.escape(end)}\\n]"
    return f"{re.escape(begin)}(?={inner}*?(?:{ASKS})){inner}++{re.escape(end)}"


#: The grammar of unfilled placeholders and failed substitutions: delimiters of template languages around anything, of format
#: strings around a name, brackets that ask, blanks with a label, and what programs print for no value (fixed values).
PLACEHOLDER = re.compile(
    r"(?=[{$#<%_@\[｛【（(«X×uNny:：Y])(?:"
    + "|".join(
        [
            r"\{\{[^{}]++\}\}|\{%[^%{}]++%\}|<%[^%<>]++%>|\[\[[^\[\]]++\]\]|[$#%]\{[^{}\n]++\}|｛[^｛｝\n]++｝|«[^«»\n]++»|@@[^@\s]++@@|<!-- ?\w++ ?-->",
            r"\{(?:[A-Za-z_]\w*+|\d{1,2})\}|%\([A-Za-z_]\w*+\)[sd]|%[A-Za-z]\w*+%|(?<!_)__[A-Za-z0-9]++(?:_[A-Za-z0-9]++)*+__(?!_)|\[[\u4e00-\u9fff]{2,}+\]",
            *[_asking(*p) for p in ("[]", "【】", "（）", "()", "<>")],
            r"(?<!_)_{3,}+（[^（）\n]++）|(?:(?<!X)X{3,}+|(?<!×)×{2,}+)[\u4e00-\u9fff]{1,6}?(?=[\u4e00-\u9fff。，,.\s])",
            r"\[object Object\]|\((?:null|undefined)\)|(?<![A-Za-z0-9_\"'`=.])(?:undefined|NaN)(?![A-Za-z0-9_\"'`=])|[：:]\s*+(?:null|None|NULL)(?![A-Za-z0-9_])",
            r"(?<![A-Za-z0-9_\"'`=.])(?:null|None|NULL)(?=[\u4e00-\u9fff])|(?<=See )(?:null|None) (?=for)|(?<=[与由])(?:null|None)|(?<![A-Za-z])(?:yyyy-mm-dd|YYYY-MM-DD)",
        ]
    )
    + ")"
)
#: Phrases that stand on error pages, in filler and in script notices (fixed values).
RESIDUE = re.compile(
    r"\blorem\b|\bipsum\b|bad gateway|gateway time-?out|not found|internal (?:server )?error|service unavailable|too many requests|forbidden|unauthori[sz]ed|session expired|sign in again|try again|could not process|no longer (?:served|available)|upstream server|\boops\b|start page|wait \d+ seconds|禁止访问|(?:enable|switch|turn|allow) (?:it|them)\b|scripts? (?:is|are) (?:blocked|off)|something went wrong|enable it\b|联系管理员|服务没有"
    r"|traceback \(most|nullreference|keyerror|exception in|fatal error"
    r"|页面不存在|页面已下线|网关(?:错误|超时)|服务器(?:内部)?错误|内部错误|无法连接到服务器|数据库连接失败|系统繁忙|站点维护|没有(?:查看)?权限|无权(?:查看|访问)|已(?:被)?删除|已下架|找不到您|请检查网址|稍后(?:再试|重试|再来)|没有及时应答"
    r"|(?:enable|requires?|allow|turn on|switch on|support)\b[^.]{0,30}(?:javascript|scripting|scripts|cookies?)|(?:javascript|cookies?|scripting) (?:is|are) (?:off|disabled|required)|启用 ?javascript|未启用|关闭了 ?(?:cookie|javascript)|禁用了?脚本|支持脚本|允许本站脚本|脚本被拦截|关闭脚本|浏览器版本过低|检查您的浏览器|更换浏览器"
    r"|nothing (?:lives|exists|is) (?:at|here)|lives at this address|can(?:no|')t be (?:reached|displayed|found)|could not be (?:found|loaded|displayed)|has (?:moved|expired|been removed)|under maintenance|be right back|access denied|unavailable"
    r"|needs? (?:scripts?|javascript|cookies?)|scripts? to be|(?:turned|switched) on in your|(?:update|upgrade|change) your browser|your browser (?:is|does|blocks|has)|拦截了?(?:页面)?脚本|页面无法(?:显示|打开|访问|加载)|无法(?:显示|打开|访问)(?:该|此|本)?(?:页|内容)|页面(?:走丢|丢失|已过期|出错)|内容不(?:存在|可用)|访问(?:被拒|受限)"
    r"|placeholder text|dummy text|text here|示例(?:内容|段落|标题)|(?:此处|这里)(?:填写|放置|输入)|敬请期待"
    r"|示例文字|文字占位|仅供排版|测试测试|这里是(?:标题|正文|副标题)|正文内容正文|your text goes here|sample (?:heading|paragraph|text)|layout only|double-click to edit|asdf asdf|qwer",
    re.I,
)
#: A response status at the head of a page.
STATUS = re.compile(r"^[\s\[(（#*<]*(?:(?:http|error|错误码?|状态码?)\W*)?[45]\d\d(?!\d)|[\[(（][45]\d\d[\])）]\W*$", re.I)
#: Segments at the head of a page where a status may stand, and its longest line.
HEAD, HEAD_LENGTH = 3, 60
#: Words of texts that discuss, quote or document such things, for the labels only (fixed values).
DISCUSSES = re.compile(r"因此|统计中|拒收|从清单|手册|文档给出|不受影响|常见的|写法|语法|占位符|模板变量|说明了|栏目|格式为|字段|均已填写|返回错误码|入口正常|explains?\b|the guide|documents? how|filled at|for example|报错", re.I)
#: Menu and footer lines (fixed values).
MENU = re.compile(r"^(?:©|copyright|返回(?:首页|顶部)|点击此处|登录 ?/|首页\b|home\b ?[>|]|时间 .{0,30}节点|语言：|loading…?$|[0-9a-f]{8,}$|\d+$)|(?:(?: \| | · | > ).*){3,}|版权所有", re.I)

#: The same inside a line, as on pages whose line breaks were lost (fixed values).
INLINE_MENU = re.compile(r"登录 ?/ ?注册|语言：\S{1,20}|\bHome(?: > \w{1,20})+|(?:\d{1,4} 秒后)?返回(?:首页|顶部)|© ?\d{4} .{1,40}?版权所有")
_LIST = re.compile(r"(?:[^\s|·]{1,24} [|·] ){2,}[^\s|·]{1,24}")

_FENCE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`", re.S)
_CUT = re.compile(r"(?<=[。！？!?])(?![”’」』\"'])|\n+|(?<=[.;:]) +(?=[A-Z(])|(?<=[。]) +")
_DIGITS = re.compile(r"\d+")


def segments(text: str) -> list[str]:
    """The lines and sentences of a text, code taken out and placeholders marked."""
    text = _FENCE.sub(" ", text)
    if " | " in text or " · " in text:
        text = _LIST.sub("\n", text)
    text = INLINE_MENU.sub("\n", PLACEHOLDER.sub(MARK, text))
    return [s for x in _CUT.split(text) if (s := x.strip())]


def scored_form(segment: str) -> str:
    return _DIGITS.sub("0", segment.lower())


def features(forms: list[str], first: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of many segments in one flat array, and where each segment begins."""
    flat = np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.array([len(f) for f in forms], dtype=np.int64)
    who = np.repeat(np.arange(len(forms)), size)
    parts, owners = [], []
    h = np.zeros(len(flat), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(flat) < n:
            break
        h = (h[: len(flat) - n + 1] * np.uint64(0x100000001B3) + flat[n - 1 :] + np.uint64(n)) & np.uint64(0xFFFFFFFFFFFF)
        if n in ORDERS:
            inside = who[: len(flat) - n + 1] == who[n - 1 :]
            parts.append((((h[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(FEATURES)).astype(np.int64))
            owners.append(who[: len(flat) - n + 1][inside])
    # length and title features
    log = np.minimum(np.log2(size + 1).astype(np.int64), 12)
    title = np.array(first, dtype=np.int64) + 2 * np.array([f.startswith(("#", "<")) for f in forms], dtype=np.int64)
    # a placeholder as often as its segment is long, else the words of a long one drown it
    often = np.array([MARK in f for f in forms]) * (1 + size // 8)
    parts += [FEATURES + log, FEATURES + 16 + title, np.full(often.sum(), FEATURES + 24)]
    owners += [np.arange(len(forms)), np.arange(len(forms)), np.repeat(np.arange(len(forms)), often)]
    index, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return index[order], np.r_[0, np.cumsum(np.bincount(owner, minlength=len(forms)))]


SPACE = FEATURES + 32


def score(weights: np.ndarray, forms: list[str], first: list[bool]) -> np.ndarray:
    """The log odds of each segment (the last weight is the intercept)."""
    if not forms:
        return np.empty(0)
    index, at = features(forms, first)
    return np.add.reduceat(weights[index], at[:-1]) / np.sqrt(np.diff(at)) + weights[-1]


def fit(forms: list[str], first: list[bool], labels: np.ndarray, importance: np.ndarray) -> np.ndarray:
    """Weights of the L2-regularised logistic model, by adaptive gradient steps over batches."""
    index, at = features(forms, first)
    w, g2 = np.zeros(SPACE + 1), np.full(SPACE + 1, 1e-6)
    rng = np.random.default_rng(0)
    for _ in range(PASSES):
        for rows in np.array_split(rng.permutation(len(forms)), max(1, len(forms) // 256)):
            counts = at[rows + 1] - at[rows]
            scale = 1 / np.sqrt(counts)
            start = np.repeat(at[rows] - np.r_[0, np.cumsum(counts)[:-1]], counts)
            cols = index[np.arange(counts.sum()) + start]
            z = np.add.reduceat(w[cols], np.r_[0, np.cumsum(counts)[:-1]]) * scale + w[-1]
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) * importance[rows]
            grad = np.bincount(cols, np.repeat(err * scale, counts), minlength=SPACE + 1)
            grad[-1] = err.sum()
            used = np.flatnonzero(grad)
            grad[used] += PENALTY * len(rows) * w[used]
            g2[used] += grad[used] ** 2
            w[used] -= 0.5 * grad[used] / np.sqrt(g2[used])
    return w


class Phrases:
    """What phrases say of a form, worked out once for each."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[bool, bool, bool]] = {}

    def __call__(self, form: str) -> tuple[bool, bool, bool]:
        """Whether a form is a menu, residue, and a speaking placeholder."""
        if form not in self.known:
            about = bool(DISCUSSES.search(form))
            self.known[form] = (MARK not in form and bool(MENU.search(form)), not about and bool(RESIDUE.search(form)), not about and MARK in form)
        return self.known[form]


def has_status(text: str) -> bool:
    """Whether a response status stands at the head of a text."""
    head = [s for s in segments(text[: 50 * HEAD_LENGTH]) if not MENU.search(s)][:HEAD]
    return any(len(s) <= HEAD_LENGTH and STATUS.search(s) for s in head)


def weak_labels(text: str, phrases: Phrases, statuses: bool = True) -> list[tuple[str, bool, bool]]:
    """``(form, first, residue)`` of the segments of one text by phrases and, if wanted, statuses."""
    forms = [f for s in segments(text) if not phrases(f := scored_form(s))[0]]
    hit = [phrases(f)[1] for f in forms]
    total = sum(map(len, forms))
    page = total > 0 and sum(len(f) for f, h in zip(forms, hit) if h) >= WEAK_PAGE * total
    page = page or statuses and total <= HEAD * HEAD_LENGTH and has_status(text)
    return [(f, i == 0, h or page or phrases(f)[2]) for i, (f, h) in enumerate(zip(forms, hit))]


def train(docs: DataFrame, id_col: str, text_col: str, statuses: bool = True) -> np.ndarray:
    """Fit the model on a bounded sample of weakly labelled segments, inside one task.

    The sample is the documents with small hashes, so that it is the same in every
    run and hosts are drawn in proportion, and of their forms the commonest.
    """

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phrases = Phrases()
        for b in batches:
            rows = [x for t in b["text"] for x in weak_labels(t, phrases, statuses) if len(x[0]) <= SAMPLE_LENGTH]
            yield pd.DataFrame(rows, columns=["form", "first", "residue"])

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches) or [pd.DataFrame({"form": [], "first": [], "pos": [], "neg": []})])
        pdf = pdf.sort_values(["form", "first"], ignore_index=True)
        residue = (pdf["pos"] > pdf["neg"]).to_numpy(dtype=bool)
        if residue.all() or not residue.any():  # one label alone: nothing to tell apart
            w = np.zeros(SPACE + 1)
            w[-1] = 1.0 if len(pdf) and residue.all() else -1.0
        else:
            labels = residue.astype(float)
            weight = np.log2(1 + (pdf["pos"] + pdf["neg"]).to_numpy(dtype=float))
            weight[labels == 1] *= weight[labels == 0].sum() / max(1e-9, weight[labels == 1].sum()) * 0.5
            w = fit(pdf["form"].tolist(), pdf["first"].tolist(), labels, np.minimum(weight, 8.0))
        yield pd.DataFrame({"w": [w.astype(np.float32).tobytes()]})

    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("_h"))
    share = min(1.0, SAMPLE_DOCUMENTS / max(1, rows.count()))
    sample = rows.where(F.pmod("_h", F.lit(1_000_003)) < F.lit(int(share * 1_000_003) + 1))
    labelled = sample.select("text").mapInPandas(label, "form string, first boolean, residue boolean")
    counted = labelled.groupBy("form", "first").agg(F.count_if("residue").alias("pos"), F.count_if(~F.col("residue")).alias("neg"))
    counted = checkpointed(counted.withColumn("is", F.col("pos") > F.col("neg")))
    # each label has half of the bound, its commonest forms first, and what the other leaves of its half
    n = {r["is"]: r["n"] for r in counted.groupBy("is").agg(F.count("*").alias("n")).collect()}
    order = [F.desc(F.col("pos") + F.col("neg")), F.xxhash64("form"), "form", "first"]
    part = {k: counted.where(F.col("is") == k).orderBy(*order).limit(max(SAMPLE_SEGMENTS // 2, SAMPLE_SEGMENTS - n.get(not k, 0))) for k in (True, False)}
    bounded = part[True].unionByName(part[False])
    row = bounded.coalesce(1).mapInPandas(one, "w binary").first()
    if row is None:  # no documents, nothing to learn
        return np.r_[np.zeros(SPACE), -1.0]
    return np.frombuffer(row["w"], dtype=np.float32).astype(np.float64)


def judge(texts: list[str | None], weights: np.ndarray) -> list[tuple[bool, bool, float]]:
    """``(residue page, placeholder, share of residue)`` of each text; each distinct segment is scored once."""
    at: dict[tuple[str, bool], int] = {}
    menu: dict[str, bool] = {}
    which, owner = [], []
    for i, t in enumerate(texts):
        first = True
        for s in [] if t is None or not t.strip() else segments(t):
            f = scored_form(s)
            if f not in menu:
                menu[f] = MARK not in f and bool(MENU.search(f))
            if not menu[f]:
                which.append(at.setdefault((f, first), len(at)))
                owner.append(i)
                first = False
    z = score(weights, [f for f, _ in at], [b for _, b in at])
    size, marked = np.array([len(f) for f, _ in at]), np.array([MARK in f for f, _ in at], dtype=bool)
    which, owner = np.array(which, dtype=np.int64), np.array(owner, dtype=np.int64)
    if not len(which):
        return [(False, False, 0.0)] * len(texts)
    bad, marked, size = (z > 0)[which], marked[which], size[which]
    total = np.bincount(owner, size, minlength=len(texts))
    residue = np.bincount(owner, size * (bad & ~marked), minlength=len(texts))
    mark = np.bincount(owner, bad & marked, minlength=len(texts)) > 0
    share = np.divide(residue, total, out=np.zeros(len(texts)), where=total > 0)
    return [(bool(sh >= MOSTLY), bool(m), float(sh)) for sh, m in zip(share, mark)]


def find_residue(docs: DataFrame, id_col: str, text_col: str, weights: np.ndarray | None = None) -> DataFrame:
    """``id_col, is_page, has_placeholder, share`` of every document."""
    w = train(docs, id_col, text_col) if weights is None else weights
    model = docs.sparkSession.sparkContext.broadcast(w.astype(np.float32))  # of fixed size
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = model.value.astype(np.float64)
        for b in batches:
            found = judge([None if pd.isna(t) else t for t in b[text_col]], weights)
            yield pd.DataFrame({id_col: b[id_col], "is_page": [x[0] for x in found], "has_placeholder": [x[1] for x in found], "share": [x[2] for x in found]})

    return docs.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {id_type}, is_page boolean, has_placeholder boolean, share double")


def cases(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The ids of the documents to leave out."""
    return find_residue(docs, id_col, text_col).where("is_page or has_placeholder").select(id_col)


def validate(docs: DataFrame, id_col: str, text_col: str, host_col: str, held_out: float = 0.3) -> DataFrame:
    """What a model that learned from phrases alone finds on hosts it has not seen.

    One row for each label: documents and how many of them were found.  Pages with
    a response status at their head are labelled true; the phrases do not know
    statuses, and the features see every number as the same digit.  Documents with
    a body longer than such pages and without a placeholder are labelled false.
    """
    unseen = F.pmod(F.xxhash64(F.coalesce(host_col, F.lit(""))), F.lit(1000)) < int(1000 * held_out)
    w = train(docs.where(~unseen), id_col, text_col, statuses=False)

    @F.pandas_udf("boolean")
    def told(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            short = sum(len(s) for s in segments(t) if not MENU.search(s)) <= HEAD * HEAD_LENGTH
            out.append(True if short and has_status(t) else False if not short and not PLACEHOLDER.search(t) else None)
        return pd.Series(out, dtype=object)

    test = docs.where(unseen & F.col(text_col).isNotNull())
    found = find_residue(test, id_col, text_col, w).select(id_col, (F.col("is_page") | F.col("has_placeholder")).alias("found"))
    labels = test.select(id_col, told(text_col).alias("has_status")).where("has_status is not null")
    return labels.join(found, id_col).groupBy("has_status").agg(F.count("*").alias("n_docs"), F.count_if("found").alias("n_found"))
