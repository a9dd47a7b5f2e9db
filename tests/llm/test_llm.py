"""Text operators against brute force, other libraries and exact round trips."""

import base64
import itertools
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditloom.llm import canonical, copies, garbled, names, packing, residue, tables, text, tokens
from auditloom.llm import queries as llm_queries

# normal forms and distances


def plain_distance(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7), st.integers(0, 3))
def test_banded_distance(a, b, most):
    assert text.banded_distance(a, b, most) == min(plain_distance(a, b), most + 1)


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(["abcd", "一二三四"]).flatmap(lambda a: st.tuples(st.text(a, min_size=2, max_size=30), st.lists(st.tuples(st.integers(0, 3), st.integers(0, 29), st.sampled_from(a)), max_size=3))))
def test_pigeonhole_loses_nothing(case):
    a, steps = case
    b = list(a)
    for kind, at, c in steps:
        at = at % max(1, len(b))
        if kind == 0:
            b[at : at + 1] = [c]
        elif kind == 1:
            b.insert(at, c)
        elif kind == 2 and len(b) > 1:
            b.pop(at)
        else:
            b[at : at + 2] = b[at : at + 2][::-1]
    b = "".join(b)
    if plain_distance(a, b) <= names.edits(b):
        assert set(names.probe_keys(a)) & set(names.index_keys(b))


# p2


def test_parse_names():
    def parse(n):
        return names.parse(n, tables.NAMES)

    p = parse("智通龙青實驗室 Jamusiruvo Association 專利檢索平台")
    assert (p["source"], p["cjk"], p["words"], p["kind"]) == ("专利检索平台", "智通龙青", ["jamusiruvo"], "室")
    assert parse("Annual Report 2024 - 盛川捷森标协")["source"] == "年度报告2024"
    assert parse("2023年报@盛川捷森")["source"] == "年度报告2023"
    assert parse("盛川捷森标准协会")["source"] == "官网" and parse("")["source"] == "官网"
    assert parse("老方实验室 Zamifiditi Photonics 数据集平台")["nick"] == "方室"
    assert parse("Star, Northern docs")["words"] == ["northern", "star"]
    assert names.parse("Northern Star docs", names.Wording())["words"] == ["docs", "northern", "star"]


def linked(spark, groups, rows=None):
    df = spark.createDataFrame([(n, "x", "y") for n in rows or [n for g in groups for n in g]], "name string, core string, organisation string")
    want = {tuple(sorted(p)) for g in groups for p in itertools.combinations(g, 2)}
    got = {(r["name_a"], r["name_b"]) for r in names.variant_pairs(df, "name", tables.NAMES).collect()}
    assert got == want, (got - want, want - got)
    return df


def test_variant_pairs(spark):
    groups = [
        ["盛川捷森标准协会 Pamolikoka Networks 数据集平台", "盛川捷森数据集平台", "数据集平台 - Pamolikoka Netw.", "PAMOLKIOKA NETWORKS Datasets", "“盛川捷林标准协会數據集平台”"],
        ["盛川捷森标准协会 Pamolikoka Networks 年度报告2024", "Pamolikoka 2024年报"], ["盛川捷森标准协会 Pamolikoka Networks 年度报告2025"],
        ["Nagotufupo Foundation", "Nagotufupo Foundation 官网", "nagotufupo_fdn"],
    ]
    df = linked(spark, groups, [n for g in groups for n in g] + [None, "", "  ", "？", groups[0][0]])
    links = {r["name"]: (r["class_id"], r["n_links"]) for r in names.variant_classes(df, "name", tables.NAMES).collect()}
    assert links[groups[1][1]][1] == 1 and links["？"][1] == 0 and len(links) == 12
    assert names.variant_pairs(df.limit(0), "name").count() == 0
    assert names.variant_pairs(spark.createDataFrame([("长" * 100_000,), ("长" * 100_000 + "官网",), ("长" * 99_999 + "短",)], "name string"), "name", tables.NAMES).count() == 3


def test_whole_names_of_any_length(spark):
    linked(
        spark,
        [
            ["中国移动通信论文库", "中国移动通信 论文"], ["中国移动互联网论文库"], ["中国科学院自动化研究院"], ["中国科学院计算技术研究院"], ["华为官网", "华为官方网站"], ["百度代码仓库", "百度代码"], ["百事代码"],
            ["Ovis docs", "Ovis documentation"], ["Northern Light docs", "docs: light, northern"], ["Northern Star docs"], ["Light docs"], ["Night docs"],
            ["格迅思禾基金会论文库", "格迅思禾论文", "格迅思禾会论文库"], ["官网", " 官网。"], ["？"], ["?"],
            ["International Electrotechnical Commission papers", "internationl electrotechnical comission 论文"],
        ],
    )


def test_common_words_link_nothing(spark):
    organisations = ["盛川捷森", "智通龙青", "瑞河玉远", "海星江元", "拓龙恒顺", "东湖万启", "麟江川恒"]
    linked(spark, [[f"{o} Solarium 论文库", f"{o}论文", f"Solarium {o} 论文"] for o in organisations] + [["Solarium 论文库", "Solarium papers"]])


def test_nicknames_and_acronyms_of_one_organisation(spark):
    linked(spark, [["盛川捷森研究院 Pamolikoka Systems 论文库", "PML 论文", "老森院论文库"], ["智通龙青实验室 Jamusiruvo Systems 论文库"], ["XQZ 论文"], ["老天院论文库"]])


def test_blocks_of_a_large_source(spark, monkeypatch):
    monkeypatch.setattr(names, "BLOCK", 7)
    linked(spark, [[f"盛川捷森{' ' * i}论文库" for i in range(40)], ["智通龙青论文", "智通龙青论文库"]])


def test_neighbours_like_brute_force(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice(a) for _ in range(rng.randint(2, 13))) for a in ("ab", "一二三") for _ in range(120)})
    df = spark.createDataFrame([("w", w) for w in words], "script string, core string")
    got = {(r["core"], r["near"]) for r in names.neighbours(df).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and plain_distance(a, b) <= names.edits(b)}


# p4

LIST = [
    ("技术文档", "手册、指南、接口说明"), ("研究报告", "白皮书、调研、市场与评测分析"), ("标准规范", ""), ("技术社区", "论坛、问答、讨论组"), ("代码仓库", ""), ("官方网站", ""), ("专利文献", ""), ("数据集", "语料"), ("学术论文", ""), ("数据库", ""),
    ("新闻资讯", "新闻、快讯、媒体报道"), ("课程教程", ""), ("其他", "以上都不适用"),
]
ENTRIES = [canonical.Entry(n, note, tuple(tables.SOURCE_TYPES.get(n, ())), n == "其他") for n, note in LIST]
BARE = [canonical.Entry(n, note, (), n == "其他") for n, note in LIST]


@pytest.fixture(scope="module")
def mapped(spark):
    def run(values, entries=ENTRIES, hints=None):
        df = spark.createDataFrame([(v, "x") for v in values], "raw string, entry string")
        told = spark.createDataFrame(hints, "raw string, entry string, n bigint") if hints else None
        return {r["raw"]: r["entry"] for r in canonical.map_values(df, "raw", entries, told).collect()}

    return run


def test_map_values(mapped):
    want = {
        "研穷报告": "研究报告", "究研报告": "研究报告", "ｗｈｉｔｅ ｐａｐｅｒ": "研究报告", "whitep aper": "研究报告", "第三方行业研报": "研究报告", "白 皮书（PDF）": "研究报告", "数据积": "数据集",
        "YANJIU-BAOGAO": "研究报告", "repos": "代码仓库", "nws": "新闻资讯", "開放數據集": "数据集", "报告（研究）": "研究报告",
        "登录页": "", "厂商价格表": "", "job board": "", "n/a": "", "？": "", "地图": "", "其它": "", "其他资料": "", "x" * 50_000: "", "".join(map(chr, range(0x4E00, 0x4E00 + 2000))): "",
    }
    assert mapped(want) == want


def test_the_list_alone(mapped):
    want = {"研穷报告": "研究报告", "手册": "技术文档", "市场分析": "研究报告", "评测分析": "研究报告", "快讯 *": "新闻资讯", "讨论组": "技术社区", "white paper": ""}
    assert mapped(want, BARE) == want


def test_words_and_ties_are_learned_from_the_rows(mapped):
    hints = [("white paper", "研究报告", 8), ("white paper", "数据集", 3), ("数据裤", "数据库", 3), ("数据裤", "数据集", 1), ("砖利", "专利文献", 1), ("job board", "数据集", 2), ("job board", "数据库", 2), ("job board", "官方网站", 2)]
    want = {"white paper": "研究报告", "White-Paper": "研究报告", "whte paper": "研究报告", "数据裤": "数据库", "job board": ""}
    assert mapped(want, BARE, hints) == want
    assert mapped(["砖利"], hints=hints) == {"砖利": "专利文献"} and mapped(["砖利"]) == {"砖利": ""}


def test_affixes_are_learned(spark):
    words = ["研究报告", "数据集", "技术社区", "官方网站", "代码仓库", "学术论文"]
    cores = spark.createDataFrame([(w,) for w in words + [f"国内{w}" for w in words] + [f"{w}英文版" for w in words] + ["国内研究报告英文版", "研究数据集"]], "core string")
    assert {tuple(r) for r in canonical._affixes(cores).collect()} == {("before", "国内"), ("behind", "英文版")}
    got = {(r["bare"], r["cut"]) for r in canonical._stripped(cores).where("core = '国内研究报告英文版'").collect()}
    assert got == {("研究报告英文版", 2), ("国内研究报告", 0), ("研究报告", 2)}


def test_vocabulary_weighs_by_idf():
    rows = canonical.vocabulary([canonical.Entry("a", "", ("研究报告", "调研报告", "报告", "调研")), canonical.Entry("b", "研究")])
    weights = {t: w for e, n, t, _, w in rows if n == 3}
    assert set(weights) == {"研究", "报告"} and sum(weights.values()) == pytest.approx(1)
    own = {t: w for _, n, t, _, w in rows if n == 5}
    assert set(own) == {"调研", "报告"} and own["调研"] > own["报告"]


def test_map_rows(spark):
    df = spark.createDataFrame([(1, "白皮书", "其他"), (2, "白皮书", None), (3, None, None), (4, " 　", ""), (5, "研究报告", "研究报告"), (6, "待定", "其他")], "id int, raw string, own string")
    got = canonical.map_rows(df, "id", "raw", ENTRIES, "own", F.col("own") == "其他").collect()
    assert {(r["id"], r["entry"]) for r in got} == {(1, "研究报告"), (2, "研究报告"), (6, "")}
    assert canonical.map_rows(df.limit(0), "id", "raw", ENTRIES).count() == 0


def test_reference_join_like_brute_force():
    targets = sorted({t for _, _, t, _, _ in canonical.vocabulary(ENTRIES)})
    for token in ["研穷报告", "rpeo", "data bse".replace(" ", ""), "forumm", "砖利", "官罔", "xyz"]:
        brute = {t for t in targets if canonical.similarity(token, t, "whole") > 0}
        met = {t for t in targets if text.deletions(t, canonical.allowed(t)) & text.deletions(token, canonical.allowed(token))}
        assert brute <= met


# p5


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    words = ["年度报告", "测试条件", "数据集平台", "参数数据库", "公开样本", "目录页按年份归档", "响应时间", "标准检索页", "产品资料下载", "联系方式"]
    strings = ["".join(rng.choice(words) for _ in range(4)) + str(rng.randint(0, 99)) for _ in range(3000)] + ["Prüfbericht für Geräte", "Relatório de medição nº 3", "Каталог содержит записи"] * 20
    counts = [np.zeros(n, dtype=np.int64) for n in (garbled.CHAR_BINS, garbled.PAIR_BINS, garbled.CLASSES**2)]
    garbled.count(strings, *counts)
    return garbled.Corpus(*counts)


TEXT = "公开样本数据集平台，测试条件2024"


@pytest.mark.parametrize("wrong,right", [("latin-1", "utf-8"), ("cp1251", "utf-8"), ("cp437", "utf-8"), ("latin-1", "gb18030")])
def test_round_trip(corpus, wrong, right):
    bad = TEXT.encode(right).decode(wrong, "ignore" if wrong == "cp1251" else "strict")
    found, restored = garbled.repair(bad, corpus)
    assert found and (restored == TEXT or wrong == "cp1251")
    part = "目录页" + bad + " end"
    assert garbled.repair(part, corpus)[0]


def test_twice_and_lost(corpus):
    twice = TEXT.encode().decode("latin-1").encode().decode("latin-1")
    assert garbled.repair(twice, corpus) == (True, TEXT)
    assert garbled.repair(TEXT.encode("gb18030").decode("utf-8", "replace"), corpus) == (True, None)
    assert garbled.repair("锟斤拷锟斤拷", corpus) == (True, None)
    assert garbled.repair(TEXT.encode().decode("gb18030", "replace"), corpus)[0]


@pytest.mark.parametrize("good", ["", "plain", TEXT, "Prüfbericht für Geräte – Ausgabe 3", "Größe, Höhe", "São Ångström créée", "Каталог содержит 3 записи", "產業聯盟發佈的標準", "登録済みの資料", "전체 항목", "半导体集团", "👩‍💻🚀", "x" * 200_000 + "é"])
def test_correct_text(corpus, good):
    assert garbled.repair(good, corpus) == (False, good)


def test_segments_like_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.normal(size=7), rng.normal(size=5)
        both = np.r_[a, 0.0, b]  # a joint pair lies between the strings
        got = garbled.best_segment(np.r_[both], np.array([0, 8]))
        best = lambda s: max([0.0] + [s[i:j].sum() for i in range(len(s)) for j in range(i + 1, len(s) + 1)])
        assert np.allclose(got, [best(a), best(b)])


@pytest.mark.parametrize("wrong", ["gb18030", "cp1252", "cp1251"])
def test_copies_of_a_garbled_record_do_not_clear_it(spark, wrong):
    rng = random.Random(6)
    good = ["年度报告", "测试条件", "数据集平台", "公开样本", "参数数据库", "目录页按年份归档"]
    bad = "年度报告下载".encode().decode(wrong, "ignore")
    rows = [(i, json.dumps(["".join(rng.choice(good) for _ in range(4)) + "下载"], ensure_ascii=False)) for i in range(400)] + [(1000 + i, json.dumps([bad], ensure_ascii=False)) for i in range(200)]
    df = spark.createDataFrame(rows, "evidence_id bigint, tool_response string")
    got = {r["evidence_id"]: r["restored"] for r in garbled.find_garbled(df, "evidence_id", "tool_response").collect()}
    assert set(got) == set(range(1000, 1200))
    assert wrong == "cp1251" or set(got.values()) == {"年度报告下载"}


def test_pairs_stay_apart_in_a_full_sketch():
    rng = np.random.default_rng(1)
    counts = [np.zeros(n, dtype=np.int64) for n in (garbled.CHAR_BINS, garbled.PAIR_BINS, garbled.CLASSES**2)]
    own = "测试报告数据目录公开样本"
    garbled.count([own] * 3000 + ["".join(map(chr, rng.integers(0x4E00, 0x9000, 2000))) for _ in range(600)], *counts)
    corpus = garbled.Corpus(*counts)
    assert corpus.noise > 0  # more pairs than bins
    a, b = garbled.codes(list(own[:-1])), garbled.codes(list(own[1:]))
    assert (corpus.information(a, b) > garbled.LIKELY).all()
    unseen = rng.integers(0x9000, 0x9F00, (2, 500)).astype(np.uint32)
    assert (corpus.pairs[garbled.pair_bins(*unseen)].min(axis=0) <= corpus.noise).mean() > 0.9


def test_only_strange_parts_are_changed(corpus):
    bad = TEXT.encode().decode("latin-1")
    assert garbled.repair(f"Größe 目录页按年份归档 {bad} Höhe", corpus) == (True, f"Größe 目录页按年份归档 {TEXT} Höhe")


def test_find_garbled(spark):
    rng = random.Random(2)
    good = ["年度报告", "测试条件", "数据集平台", "公开样本"]
    rows = [(i, json.dumps({"results": [{"title": "".join(rng.choice(good) for _ in range(3)), "content": {"t": "x"}}, "公开样本"]}, ensure_ascii=False), "z") for i in range(200)]
    bad = "公开样本数据集平台".encode().decode("latin-1")
    rows += [(900, json.dumps({"results": [{"title": bad}, bad, {"content": [{"t": bad}]}]}), "z"), (901, bad, "z"), (902, None, None), (903, "", ""), (904, '{"a":"' + bad, "z"), (905, json.dumps(bad), "z")]
    df = spark.createDataFrame(rows, "evidence_id bigint, tool_response string, garbled string")
    got = {(r["evidence_id"], r["field_path"], r["restored"]) for r in garbled.find_garbled(df, "evidence_id", "tool_response").collect()}
    w = "公开样本数据集平台"
    assert got == {(900, "tool_response.results[0].title", w), (900, "tool_response.results[1]", w), (900, "tool_response.results[2].content[0].t", w), (901, "tool_response", w), (905, "tool_response", w)}
    assert garbled.find_garbled(df.limit(0), "evidence_id", "tool_response").count() == 0


# p6

SAME = [
    "https://a.b.example/x/Y.pdf?lang=zh&id=1", "HTTP://A.B.EXAMPLE//x/y.pdf?id=1&lang=zh", "a.b.example/x/y.pdf?id=1&lang=zh#3#1", " ｈｔｔｐｓ：／／ａ．ｂ．ｅｘａｍｐｌｅ／ｘ／ｙ．ｐｄｆ？ｉｄ＝１＆ｌａｎｇ＝ｚｈ。", "**https://a.b.​example/x/y.pdf?lang=zh&amp;id=1**",
    "（https://a.b。example/ x/y.pdf/?&id=1&&lang=zh&）、", "//a.b.example/x/y.pdf?id=1;lang=zh#3.",
]
OTHER = ["https://a.b.example/x/y.pdf", "https://a.b.example/x/y.pdf?id=2&lang=zh", "https://a.b.example/y.pdf/x?id=1&lang=zh", "https://b.example/x/y.pdf?id=1&lang=zh", "https://a.b.example/"]


def test_page_fields():
    assert len({tuple(copies.page_fields(u)) for u in SAME}) == 1
    assert len({tuple(copies.page_fields(u)) for u in [SAME[0], *OTHER]}) == len(OTHER) + 1
    assert [copies.page_fields(u) for u in (None, "", " ", "无", "见备注", "n/a", "-")] == [None] * 7


def test_hosts_of_any_kind():
    pages = [
        ["https://a.com:8080/x", "HTTPS://a.com:8080/x/", "a.com:8080/x#3"], ["https://a.com/x", "http://a.com:80/x", "https://user:word@a.com:443/x", "a.com:/x"], ["http://intranet/x", "HTTP://Intranet/x/"],
        ["http://[2001:db8::1]/x", "https://[2001:DB8::1]:443/x"], ["http://[2001:db8::1]:81/x"], ["http://10.0.0.1:9000/"],
    ]
    made = [{tuple(copies.page_fields(u) or ()) for u in group} for group in pages]
    assert all(len(m) == 1 and () not in m for m in made) and len(set.union(*made)) == len(pages)
    assert [copies.page_fields(u) for u in ("intranet/x", "http://", "说明:见备注", "a:b", "n/a")] == [None] * 5


def test_copy_rows(spark):
    rows = [(10 + i, "s", u) for i, u in enumerate(SAME)] + [(3, "s", SAME[0]), (50, "s", OTHER[0]), (51, "s", None), (52, "s", ""), (53, "s", "无"), (54, "s", "无"), (60, "t", SAME[1])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "id int, scope string, url string, record int, value string")
    got = {(r["scope"], r["keep_id"], r["copy_id"]) for r in copies.copy_rows(df, "id", "url", ["scope"]).collect()}
    assert got == {("s", 3, 10 + i) for i in range(len(SAME))}
    kept = {r["keep_id"]: r["n_copies"] for r in copies.deduplicate(df.where("scope = 's'"), "id", "url").collect()}
    assert kept == {3: len(SAME) + 1, 50: 1, 51: 1, 52: 1, 53: 1, 54: 1}
    assert copies.copy_rows(df.limit(0), "id", "url").count() == 0
    long = spark.createDataFrame([(i, "a.example/" + "p" * 200_000) for i in range(2)], "id int, url string")
    assert copies.copy_rows(long, "id", "url").count() == 1


# p7


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_tokens_like_tiktoken(reference, texts):
    got = tokens.bpe().encode(texts)
    assert [x.tolist() for x in got] == [reference.encode_ordinary(t) for t in texts]


def test_tokens_of_long_and_odd_texts(reference):
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(tokens.VOCABULARY.replace(".tiktoken", ".json"))
    hf.encode_special_tokens = True
    texts = ["", " ", "a" * 5000, "中文" * 3000, "<|endoftext|> x", "don't I'LL 12345", "\r\n\t  x  ", "".join(map(chr, range(0x4E00, 0x5200))), "👩‍💻🚀"]
    got = [x.tolist() for x in tokens.bpe().encode(texts)]
    assert got == [reference.encode_ordinary(t) for t in texts] == [hf.encode(t, add_special_tokens=False).ids for t in texts]
    assert tokens.bpe().encode([None]) == [None]


def test_encode_table(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "", None), (1, "a b", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in tokens.encode_table(df, "doc_id", "text").collect() if r["doc_id"] != 2)
    assert got == [(1, [64, 275]), (1, [64, 275]), (3, [])]
    assert tokens.encode_table(df, "doc_id", "text").where("doc_id = 2").first()["ids"] is None
    assert df.limit(0).select(tokens.token_ids(F.col("text"))).count() == 0


# p8


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 9), max_size=12), st.sampled_from([[20], [20, 50], [20, 64, 128]]))
def test_plan_bins(histogram, caps):
    plan = packing.plan_bins(histogram, caps)
    held: dict[int, int] = {}
    for cap, m, content in plan:
        used = sum(s * k for s, k in content)
        assert used <= cap and cap in caps and not any(c < cap and used <= c for c in caps)
        for s, k in content:
            held[s] = held.get(s, 0) + k * m
    assert held == histogram


def best_fit(sizes, cap):
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = min((b for b in bins if b[0] >= s), key=lambda b: b[0], default=None)
        if fit is None:
            bins.append(fit := [cap])
        fit[0] -= s
    return len(bins)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_one_capacity_is_best_fit(sizes):
    histogram = {s: sizes.count(s) for s in sizes}
    assert sum(m for _, m, _ in packing.plan_bins(histogram, [50])) == best_fit(sizes, 50)


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_AT_ONCE", 50)  # several salts
    rng = random.Random(5)
    sizes = [rng.choice([7, 7, 7, rng.randint(1, 30), 0, None, 250]) for _ in range(600)]
    df = spark.createDataFrame([(i, s, "x", 1) for i, s in enumerate(sizes)], "id int, size int, plan string, bin_id int").repartition(5)
    rows = packing.pack(df, "id", "size", {"one": [100], "joint": [20, 100]}).collect()
    for plan in ("one", "joint"):
        own = [r for r in rows if r["plan"] == plan]
        total: dict[int, int] = {}
        caps: dict[int, int] = {}
        for r in own:
            if r["bin_id"] is None:
                assert r["n_tokens"] == 0
                continue
            total[r["bin_id"]] = total.get(r["bin_id"], 0) + r["n_tokens"]
            assert caps.setdefault(r["bin_id"], r["capacity_tokens"]) == r["capacity_tokens"]
        assert all(total[b] <= caps[b] for b in total)
        per: dict[int, list] = {}
        for r in own:
            per.setdefault(r["id"], []).append((r["first_token"], r["n_tokens"]))
        for i, s in enumerate(sizes):
            pieces = sorted(per[i])
            assert sum(n for _, n in pieces) == (s or 0) and len(pieces) == max(1, -(-(s or 0) // 100))
            assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:]))
        assert sum(caps.values()) - sum(total.values()) < 0.02 * sum(total.values())
    assert packing.pack(df.limit(0), "id", "size", {"one": [100]}).count() == 0
    assert packing.fill_report(packing.pack(df, "id", "size", {"one": [100]})).first()["overflow"] <= 0


# p9


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(4)
    clean = ["该站提供中英文两个版本，英文版更新更及时。", "目录页按年份归档，最早一期发布于2025-01-0%d。", "测试条件为环境温度%d摄氏度。", "The dataset ships as %d tables with a plain-text data dictionary.", "巡检中有%d条链接返回 404，已从清单移除，其余入口正常。", "模板变量 {{ node }} 在导出时替换为节点名，本文仅说明语法。", "写报告时先放 lorem ipsum 之类的填充文字再替换，是常见的做法。"]
    bad = ["502 Bad Gateway\n上游服务没有及时应答。\n返回首页", "404 页面不存在\n您访问的页面可能已被删除。", "请启用 JavaScript 后刷新页面。", "Scripts are blocked. Enable them to continue.", "此处为示例文字，请替换为正式内容。", "Lorem ipsum dolor sit. Ipsum lorem amet."]
    rows = []
    for i in range(400):
        parts = [rng.choice(clean) for _ in range(rng.randint(1, 6))]
        rows.append((i, "".join(p % rng.randint(1, 9) if "%d" in p else p for p in parts), f"h{i % 40}", False))
    for i in range(120):
        rows.append((1000 + i, rng.choice(bad) + (f"\n编号 {i}" if i % 3 == 0 else ""), f"h{i % 40}", True))
    for i, mark in enumerate(["{{ domain }}", "${title}", "%SUMMARY%", "__CONTACT__", "【请填写节点名】", "（简介待填）", "[YOUR DOMAIN HERE]", "undefined", "{3}", "«图表»"] * 3):
        rows.append((2000 + i, f"本页由{mark}于2026-01-02整理，共3项。" + clean[0], f"h{i}", True))
    rows += [(3000, None, None, False), (3001, "", "h", False), (3002, " \n", "h", False), (3003, "示例：\n```\n<h1>${title}</h1>\n```\n以上片段演示写法。" + clean[0], "h", False), (3004, clean[0] * 3000 + "请启用 JavaScript 后刷新页面。", "h", False)]
    return rows


def test_residue(spark, documents):
    df = spark.createDataFrame([(*r, 0.5) for r in documents], "doc_id bigint, text string, source string, truth boolean, share double")
    got = {r["doc_id"] for r in residue.cases(df, "doc_id", "text").collect()}
    want = {r[0] for r in documents if r[3]}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.01 * len(documents)
    assert not got & {3000, 3001, 3002, 3003, 3004}
    agreed = {r["has_status"]: (r["n_docs"], r["n_found"]) for r in residue.validate(df, "doc_id", "text", "source").collect()}
    assert agreed[True][0] > 5 and agreed[True][1] >= 0.9 * agreed[True][0] and agreed[False][1] <= 0.05 * agreed[False][0]
    assert residue.cases(df.limit(0), "doc_id", "text").count() == 0


LONG = "a_long_name" * 6


@pytest.mark.parametrize("mark", ["_" * 60 + "（姓名）", "X" * 30 + "公司", "×" * 30 + "公司", f"{{{LONG}}}", f"%({LONG})s", f"__{LONG}__", f"@@{LONG}@@", f"%{LONG}%", f"${{{LONG}}}", "{{ a | upper }}", "{{ items[0] }}", "{{ a | default: '无' }}", "{{ a" + " " * 30 + "}}", "名称:  null", "名称：\tNone", "名称:\n null", "{{ organisation.profile.contact_person.primary_email_address }}", "{{ user['name'] }}", "{{ price | round }}", f"[[{LONG}]]", "【请填写" + "长" * 60 + "】", "（" + "长" * 60 + "待填）", f"<%= {LONG * 3} %>", "[INSERT " + LONG + "]", "[公司名称]"])
def test_placeholders_of_any_length(mark):
    assert any(residue.MARK in s for s in residue.segments(f"本页由{mark}，共3项。"))


@pytest.mark.parametrize("unit", ["__a ", "@@a", "{a", "%(a", "${a", "{{a|", "{{ ", ": ", ":\n", "×", "_（", "X公", "[", "[[", "<%", "@@ ", "【请", "（待", "<!-- ", "[your ", "__", "«"])
def test_open_bounds_are_read_in_linear_time(unit):
    import time

    began = time.time()
    residue.segments(unit * (100_000 // len(unit)))
    residue.segments(unit + "a" * 100_000 + unit + " " * 100_000)
    assert time.time() - began < 5


def test_statuses():
    assert all(map(residue.has_status, ["502 Bad Gateway\nx", "首页 | 产品 | 支持 | 联系\n[410] 页面已下线", "HTTP 500：内部错误", "服务不可用（503）\n时间 2025"]))
    assert not any(map(residue.has_status, ["", "“502 Bad Gateway”类报错占36%。", "共收录404条", "5021 条", "a\nb\nc\n404 x"]))


def test_residue_with_more_residue_than_the_sample_holds(spark, documents, monkeypatch):
    monkeypatch.setattr(residue, "SAMPLE_SEGMENTS", 200)
    more = [(5000 + i, f"502 Bad Gateway {chr(0x4E00 + i)}\n网关错误{chr(0x5200 + i)}，请稍后重试。", "h", True) for i in range(200)]
    rows = [r for r in documents if r[0] not in (3000, 3001, 3002)] + more
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, truth boolean")
    got = {r["doc_id"] for r in residue.cases(df, "doc_id", "text").collect()}
    want = {r[0] for r in rows if r[3]}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.05 * len(rows)
    only = spark.createDataFrame(more, "doc_id bigint, text string, source string, truth boolean")
    assert residue.cases(only, "doc_id", "text").count() == len(more)


@pytest.mark.parametrize("unit", ["x", "{", "{{", "_", "__a", "`", "X", "%a", "@", "[", "（", "| ", " · ", "\n", "a b "])
def test_long_odd_texts_are_read_in_linear_time(unit):
    import time

    began = time.time()
    residue.segments(unit * (100_000 // len(unit)))
    assert time.time() - began < 5


@pytest.mark.parametrize("name", sorted(llm_queries.queries()))
def test_queries_run(spark, sf, name):
    assert llm_queries.queries()[name](spark, sf).count() >= 0
