"""Literal cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from auditloom.functions import urls, vocab


def value(spark, expr, **cols):
    schema = ", ".join(f"{k} string" for k in cols)
    return spark.createDataFrame([tuple(cols.values())], schema).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("word,want", [("厂商文档", "文档"), ("市场研究", "报告"), ("专利数据库", "专利"), ("没见过的新词", "其他"), ("  ", ""), (None, ""), ("文档", "文档")])
def test_canonical_type(spark, word, want):
    once = vocab.canonical_type(F.col("w"), vocab.SOURCE_TYPES, vocab.SOURCE_TYPE_ALIASES)
    assert value(spark, once, w=word) == want
    assert value(spark, vocab.canonical_type(once, vocab.SOURCE_TYPES, vocab.SOURCE_TYPE_ALIASES), w=word) == want


@pytest.mark.parametrize("url,want", [("https://A.com/x", "a.com"), ("www.corning.com/", "www.corning.com"), ("zhuanlan.zhihu.com?x=1", "zhuanlan.zhihu.com"), ("", "")])
def test_host(spark, url, want):
    assert value(spark, urls.host(F.col("u")), u=url) == want


@pytest.mark.parametrize("url,want", [("a.com/d.pdf#3#1", "a.com/d.pdf"), ("a.com/p#content", "a.com/p#content"), ("a.com/s?x=1#2", "a.com/s?x=1")])
def test_strip_anchors(spark, url, want):
    assert value(spark, urls.strip_anchors(F.col("u")), u=url) == want


@pytest.mark.parametrize("name,want", [("算 力/服:务*器", "算_力_服_务_器"), (" ", "未命名领域"), (None, "未命名领域")])
def test_sanitized(spark, name, want):
    assert value(spark, urls.sanitized(F.col("n")), n=name) == want


@pytest.mark.parametrize("phase,want", [("验证搜索", "验证"), ("增量", "增量"), ("扩量轮", "扩量"), ("乱写", ""), (None, "")])
def test_phase_group(spark, phase, want):
    assert value(spark, vocab.phase_group(F.col("p")), p=phase) == want


@pytest.mark.parametrize("host,want", [("shuma.taobao.com", True), ("blog.csdn.net", True), ("www.jd.com", True), ("docs.aws.amazon.com", False), ("a.com", False), ("", False)])
def test_refused_hosts(spark, host, want):
    assert value(spark, vocab.is_garbage(F.col("h"), vocab.REFUSED_HOSTS), h=host) is want


@pytest.mark.parametrize("url,pdf,deep", [("a.com/x/Y.PDF", True, False), ("https://a.com/a/b/c/d", False, True), ("a.com/a/b/c/", False, False)])
def test_url_shape(spark, url, pdf, deep):
    assert (value(spark, urls.is_pdf(F.col("u")), u=url), value(spark, urls.is_deep(F.col("u")), u=url)) == (pdf, deep)
