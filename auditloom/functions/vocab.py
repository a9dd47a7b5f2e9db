"""Vocabularies that decide results (fixed values) and the expressions that apply them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are cut from the ends of words.
BLANKS = " \t\r\n\u00a0\u3000"
#: Types of sources with the confirmed other words for them; OTHER takes the rest.
OTHER = "其他"
SOURCE_TYPES = ["文档", "报告", "标准", "社区", "代码仓库", "官网", "专利", "数据集", "文献", OTHER]
SOURCE_TYPE_ALIASES = {
    "厂商文档": "文档", "官方文档": "文档", "市场研究": "报告", "技术白皮书": "报告", "行业标准": "标准", "开放标准": "标准",
    "开源社区": "社区", "仓库": "代码仓库", "开放组织": "官网", "专利数据库": "专利",
}
#: The reference list of the catalog tables and frequent other words for its entries.
LIST_TYPES = ["技术文档", "研究报告", "标准规范", "技术社区", "代码仓库", "官方网站", "专利文献", "数据集", "学术论文", "数据库", "新闻资讯", "课程教程", OTHER]
LIST_ALIASES = {"白皮书": "研究报告", "行业研报": "研究报告", "调研报告": "研究报告", "官网": "官方网站", "专利": "专利文献", "论文": "学术论文", "教程": "课程教程", "快讯": "新闻资讯"}
GRANULARITIES = ["合集级", "单篇级"]
PHASES = ["验证", "增量", "扩量"]
INCREMENTAL = "增量发现"
MIN_INCREMENTAL = 20
#: Hosts that audits take for garbage: booksellers, shops, job boards, aggregators.
GARBAGE_HOSTS = [
    "books.google", "worldofbooks", "manualslib", "directindustry", "elcodis", "iczoom", "alibris", "abebooks", "springer", "ebay", "amazon", "tradeindia",
    "alibaba", "made-in-china", "globalsources", "b2b", "job.", "zhaopin", "liepin", "51job", "seek", "indeed", "docin", "doc88", "wenku", "zhidao",
    "qianzhan", "chinairn", "smartchina", "toutiao", "dxpress", "gelonghui", "finance.eastmoney", "api3.cls", "baike.baidu",
]
#: Hosts that ingest refuses.
REFUSED_HOSTS = ["shuma.taobao.com", "zhuanlan.zhihu.com", "csdn", "jd.com", "www.amazon."]
#: Words of a reason that explain why results were left.
EXPLAINED = ["新闻", "资讯", "媒体", "报道", "门户", "公众号", "已收录", "已收", "超出", "边界", "无主题", "与领域无关", "图书馆", "招聘", "宣传稿"]
#: Words of sentences that state a decision.
DECISION = (
    "不收|拒收|提取|收录|放弃|跳过|skip|单篇|规格页|平台准入|已在库|重复|无符合|没有符合|零提取|0 条|same-source|same source|collect|reject|镜像|mirror"
)
#: Words of names that denote other organisations than vendors.
ORGANISATION = (
    "协会|学会|联盟|组织|委员会|工作组|研究院|研究所|科学院|大学|学院|学校|实验室|中心|政府|基金会|商会|论坛|峰会|大会|媒体|咨询|研究|标准|认证|检测|检验|计量|"
    "情报|图书馆|博物馆|园区|孵化|MSA|University|Institute|Alliance|Association|Consortium|Foundation|Forum|Society|Committee|Standards|Lab|Centre|Center|"
    "Initiative|Council|Federation|Union|Fraunhofer"
)
ORGANISATION_NAMES = ["3GPP", "IEEE", "JEDEC", "GSMA", "ETSI", "Omdia", "LightCounting", "OCP开放计算项目", "Matter 中文官方网站", "IEEE Sensors 会议论文库", "中国卫星导航系统管理办公室"]
#: Paths of a site's entry.
ENTRY_PATH = r"^(|index\.(html?|php|aspx?)|[a-z]{2}(-[a-z]{2})?|default\.html?)\z"
#: The only shell command that a run may give.
LEGAL_COMMAND = r"postprocess\.py.*--(prepare|rename-report)"
#: Pages that are one document each.
SINGLE_DOCUMENT = [r"patents\.google\.com/patent/[A-Za-z0-9]+"]


def any_of(words: list[str]) -> str:
    """A regular expression for any of ``words``, in the syntax that Java and RE2 share."""
    return "|".join(re.sub(r"([.\\+*?\[^\]$(){}=!<>|:\-#/])", lambda m: "\\" + m[1] if m[1] in ".\\+*?[]^$(){}|" else m[1], w) for w in words)


def canonical_type(word: Column, types: list[str] = LIST_TYPES, aliases: dict[str, str] = LIST_ALIASES) -> Column:
    """Null and blank words to '', an entry to itself, another word for it to the entry, the rest to OTHER."""
    w = F.btrim(F.coalesce(word, F.lit("")), F.lit(BLANKS))
    known = {t: t for t in types} | aliases
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.when(w == "", "").otherwise(F.coalesce(F.element_at(table, w), F.lit(OTHER)))


def canonical_granularity(level: Column) -> Column:
    """One of the two levels; everything else is a collection."""
    return F.when(level.isin(GRANULARITIES), level).otherwise(GRANULARITIES[0])


def phase_group(phase: Column) -> Column:
    """The group of a phase by how it begins, '' for none."""
    out = F.lit("")
    for p in reversed(PHASES):
        out = F.when(F.coalesce(phase, F.lit("")).startswith(p), p).otherwise(out)
    return out


def is_garbage(host: Column, hosts: list[str] = GARBAGE_HOSTS) -> Column:
    """Whether any listed word stands in the host; false for ''."""
    return F.coalesce(host.rlike(any_of(hosts)), F.lit(False))


def yes_no(flag: Column) -> Column:
    return F.when(flag, "是").otherwise("否")
