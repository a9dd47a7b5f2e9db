"""Queries of the catalog engine, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.functions import urls, vocab
from auditloom.operators import audit, catalog, evidence, gates
from auditloom.sources import logs
from auditloom.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# pieces of SQL that several queries share
def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_TRIM = "trim({0}, '" + vocab.BLANKS + "')"
_TYPE_SQL = "case when " + _TRIM.format("coalesce({0}, '')") + " = '' then '' when " + _TRIM + " in (" + _in(vocab.LIST_TYPES) + ") then " + _TRIM + " " + " ".join("when " + _TRIM + f" = '{a}' then '{t}'" for a, t in vocab.LIST_ALIASES.items()) + " else '其他' end"
_HOST = "lower(regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)', 1))"
_PATH = "regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*([^?#]*)', 1)"
_STRIP = "regexp_replace({0}, '(#[0-9]+)+$', '')"
_CANON = "regexp_replace(regexp_replace(regexp_replace({0}, '(#[0-9]+)+$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '/$', '')"
_BARE = "regexp_replace({0}, '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
_FORMS = "list_distinct([{0}, " + _BARE + ", regexp_replace({0}, '/$', ''), regexp_replace(" + _BARE + ", '/$', '')])"
_GROUP = "case when {0} like '验证%' then '验证' when {0} like '增量%' then '增量' when {0} like '扩量%' then '扩量' else '' end"
_GRAN = "case when {0} in ('合集级', '单篇级') then {0} else '合集级' end"
_SRC = "src as (select * from store where type = 'source')"
_SEARCH = "sea as (select * from store where type = 'search')"
_NODES = "nod as (select distinct run_id, node from (select run_id, unnest(nodes) node from manifest))"
_DECLARED = "dec as (select run_id, 'vendors' list, x.name as name, x.node as node from (select run_id, unnest(vendors) x from manifest) where coalesce(x.name, '') <> '' union all select run_id, 'knowledge', x.name, x.node from (select run_id, unnest(knowledge) x from manifest) where coalesce(x.name, '') <> '')"
_LEAF = "leaf as (select store_id, max_by(node, length(node)) leaf from (select s.store_id, n.node from store s join nod n on s.run_id = n.run_id and (s.category_path = n.node or s.category_path like '%-' || n.node)) group by 1)"
_EV = """ev as (select evidence_id, run_id, case when json_valid(tool_input) then tool_input end ti, case when json_valid(tool_response) then tool_response end tr from evidence_log),
evq as (select evidence_id, run_id, coalesce(ti->>'$.query', tr->>'$.query') query, tr from ev)"""
_ITEMS = """res as (select evidence_id, run_id, query, unnest(json_extract(tr, '$.results[*]')) r, generate_subscripts(json_extract(tr, '$.results[*]'), 1) - 1 pos from evq),
it as (select evidence_id, run_id, query, pos, -1 sub, r item from res union all
 select evidence_id, run_id, query, pos, generate_subscripts(json_extract(r, '$.content[*]'), 1) - 1, unnest(json_extract(r, '$.content[*]')) from res)"""
_PLAIN = "regexp_replace(json_extract(tr, '$.results')::varchar, '\\\\(u[0-9a-fA-F]{4}|.)', ' ', 'g')"
_TOKENS = (
    "tk as (select run_id, evidence_id, query, trim(unnest(regexp_extract_all(" + _PLAIN + ", '" + evidence.TOKEN.replace("'", "''") + "')), '*') t from evq),\n"
    "tok as (select distinct run_id, evidence_id, query, unnest(list_concat([t], list_transform(range(1, len(string_split(t, '#'))), lambda i: array_to_string(string_split(t, '#')[1:i], '#')))) token from tk)"
)


def _with(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.parsed(table(spark, sf_dir, "evidence_log"))


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.leaf_nodes(logs.sources(spark, sf_dir), logs.nodes(spark, sf_dir), "store_id")


def _grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.grounded(logs.sources(spark, sf_dir), _evidence(spark, sf_dir), "store_id")


# scans


@query("select run_id, count(*) n_lines, count(*) filter (tool_response is null) n_null, count(*) filter (tool_response is not null and not json_valid(tool_response)) n_bad from evidence_log group by 1")
def scan_evidence(spark, sf_dir):
    """Lines of each run that cannot be read are kept and counted."""
    doc = F.try_parse_json("tool_response")
    return table(spark, sf_dir, "evidence_log").groupBy("run_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("tool_response").isNull()).alias("n_null"), F.count_if(F.col("tool_response").isNotNull() & doc.isNull()).alias("n_bad"))


@query(_with(_EV, _SEARCH) + "select e.run_id, count(*) filter (j.query is not null) kept, count(*) filter (j.query is null) left_out, count(*) filter (e.query is null) without_query from evq e left join (select distinct run_id, query from sea) j on e.run_id = j.run_id and e.query = j.query group by 1")
def evidence_slice(spark, sf_dir):
    """Evidence lines of each run whose query is in its journal."""
    asked = logs.searches(spark, sf_dir).select("run_id", "query").where("query is not null").distinct().withColumn("_in", F.lit(True))
    e = _evidence(spark, sf_dir).select("run_id", "query").join(asked, ["run_id", "query"], "left")
    return e.groupBy("run_id").agg(F.count_if(F.col("_in")).alias("kept"), F.count_if(F.col("_in").isNull()).alias("left_out"), F.count_if(F.col("query").isNull()).alias("without_query"))


@query("select coalesce(source_type_raw, '') word, count(*) n from store where type in ('source', 'knowledge') and source_type = '其他' group by 1")
def unmapped_types(spark, sf_dir):
    """Raw words of entries and knowledge that fell to the rest type."""
    return table(spark, sf_dir, "store").where("type in ('source', 'knowledge') and source_type = '其他'").groupBy(F.coalesce("source_type_raw", F.lit("")).alias("word")).agg(F.count("*").alias("n"))


# scalar functions over whole columns


@query(f"select distinct source_type_raw word, {_TYPE_SQL.format('source_type_raw')} canonical from store where type <> 'search'")
def canon_type(spark, sf_dir):
    return table(spark, sf_dir, "store").where("type <> 'search'").select(F.col("source_type_raw").alias("word"), vocab.canonical_type(F.col("source_type_raw")).alias("canonical")).distinct()


@query(_with(_NODES, _LEAF) + "select s.store_id, l.leaf from store s left join leaf l using (store_id) where s.type = 'source'")
def leaf_node(spark, sf_dir):
    return _located(spark, sf_dir).select("store_id", "leaf")


@query(f"select store_id, {_HOST.format('url')} host from store where url is not null")
def domain_of(spark, sf_dir):
    return table(spark, sf_dir, "store").where("url is not null").select("store_id", urls.host(F.col("url")).alias("host"))


@query(f"select store_id, {_STRIP.format('url')} url from store where url is not null")
def strip_anchors(spark, sf_dir):
    return table(spark, sf_dir, "store").where("url is not null").select("store_id", urls.strip_anchors(F.col("url")).alias("url"))


@query(f"select store_id, unnest({_FORMS.format('url')}) form from store where url is not null")
def url_variants(spark, sf_dir):
    return table(spark, sf_dir, "store").where("url is not null").select("store_id", F.explode(urls.variants(F.col("url"))).alias("form"))


@query("select run_id, case when trim(coalesce(domain, '')) = '' then '未命名领域' else regexp_replace(trim(domain), '[\\s/\\\\:*?\"<>|]', '_', 'g') end dir_name from manifest")
def sanitize_domain(spark, sf_dir):
    return table(spark, sf_dir, "manifest").select("run_id", urls.sanitized(F.col("domain")).alias("dir_name"))


@query(f"select log_id, {_GROUP.format('阶段')} phase_group from search_log")
def phase_group(spark, sf_dir):
    return logs.journal(spark, sf_dir).select("log_id", vocab.phase_group(F.col("phase")).alias("phase_group"))


_SCOPE = "select s.store_id, s.run_id, s.phase, s.node, s.query, s.extracted, coalesce(s.query, '') = '' or coalesce(contains(s.query, m.domain), false) or len(list_filter(m.nodes, lambda n: contains(s.query, n))) > 0 inside from sea s join manifest m using (run_id)"


def _scoped(spark, sf_dir):
    m = table(spark, sf_dir, "manifest").select("run_id", "domain", "nodes")
    s = logs.searches(spark, sf_dir).join(m, "run_id")
    inside = (F.coalesce("query", F.lit("")) == "") | F.coalesce(F.contains("query", "domain"), F.lit(False)) | F.coalesce(F.exists("nodes", lambda n: F.contains(F.col("query"), n)), F.lit(False))
    return s.select("store_id", "run_id", "phase", "node", "query", "extracted", inside.alias("inside"))


@query(_with(_SEARCH) + f"select store_id, case when inside then '框架内' else '非框架内' end scope from ({_SCOPE})")
def query_scope(spark, sf_dir):
    return _scoped(spark, sf_dir).select("store_id", F.when(F.col("inside"), "框架内").otherwise("非框架内").alias("scope"))


@query(f"select store_id, coalesce(regexp_matches({_HOST.format('url')}, '{vocab.any_of(vocab.GARBAGE_HOSTS)}'), false) is_garbage from store where type = 'source'")
def garbage_filter(spark, sf_dir):
    return logs.sources(spark, sf_dir).select("store_id", vocab.is_garbage(urls.host(F.col("url"))).alias("is_garbage"))


@query(f"select run_id, count(*) filter (granularity is null or granularity not in ('合集级', '单篇级')) n_missing, count(*) filter ({_GRAN.format('granularity')} = '单篇级') n_single from store where type = 'source' group by 1")
def granularity(spark, sf_dir):
    level = F.col("granularity")
    return logs.sources(spark, sf_dir).groupBy("run_id").agg(F.count_if(~F.coalesce(level.isin(vocab.GRANULARITIES), F.lit(False))).alias("n_missing"), F.count_if(vocab.canonical_granularity(level) == "单篇级").alias("n_single"))


@query(_with(_EV, _ITEMS) + "select evidence_id, pos::int pos, sub::int sub, item->>'$.url' url from it where coalesce(item->>'$.url', '') <> ''")
def result_urls(spark, sf_dir):
    return evidence.result_urls(_evidence(spark, sf_dir)).select("evidence_id", "pos", "sub", "url")


@query(_with(_EV, _ITEMS) + "select evidence_id, count(*) n_items, count(item->>'$.title') n_titles, count(coalesce(item->>'$.text', case when json_type(item) = 'VARCHAR' then item->>'$' end)) n_texts from it group by 1")
def evidence_texts(spark, sf_dir):
    return evidence.result_items(_evidence(spark, sf_dir)).groupBy("evidence_id").agg(F.count("*").alias("n_items"), F.count("title").alias("n_titles"), F.count("text").alias("n_texts"))


@query(f"select entry_id, {_HOST.format('访问地址')} host, {_PATH.format('访问地址')} path, regexp_extract(访问地址, '^[^?#]*\\?([^#]*)', 1) query from source_catalog where 访问地址 is not null")
def url_parts(spark, sf_dir):
    u = F.col("url")
    return logs.catalog(spark, sf_dir).where("url is not null").select("entry_id", urls.host(u).alias("host"), urls.path(u).alias("path"), urls.query(u).alias("query"))


_DEEP = "length(regexp_replace({0}, '^/+|/+$', '', 'g')) - length(replace(regexp_replace({0}, '^/+|/+$', '', 'g'), '/', '')) >= 3"


@query(f"with u as (select run_id, {_PATH.format('访问地址')} p, regexp_extract(访问地址, '^[^?#]*\\?([^#]*)', 1) q from source_catalog where 访问地址 is not null) select run_id, count(*) n, count(*) filter (lower(p) like '%.pdf') n_pdf, count(*) filter ({_DEEP.format('p')}) n_deep, count(*) filter (q <> '') n_query from u group by 1")
def url_shape(spark, sf_dir):
    u = F.col("url")
    return logs.catalog(spark, sf_dir).where("url is not null").groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(urls.is_pdf(u)).alias("n_pdf"), F.count_if(urls.is_deep(u)).alias("n_deep"), F.count_if(urls.query(u) != "").alias("n_query"))


@query(
    f"with o as (select run_id, 数据源名称 name, lower(regexp_replace({_PATH.format('coalesce(访问地址, chr(39))')}, '^/+|/+$', '', 'g')) p from source_catalog where 数据源类型 = '官方网站') "
    f"select run_id, count(*) n, count(*) filter (regexp_matches(p, '{vocab.ENTRY_PATH}')) n_entry, count(*) filter (coalesce(regexp_matches(name, '{vocab.ORGANISATION}', 'i') or name in ({_in(vocab.ORGANISATION_NAMES)}), false)) n_org from o group by 1"
)
def site_entry_split(spark, sf_dir):
    """Official sites: entry or inner page, other organisation or vendor."""
    return audit.site_entries(logs.catalog(spark, sf_dir), "官方网站")


@query(_with(_EV, _ITEMS, "u as (select distinct run_id, " + _HOST.format("item->>'$.url'") + " host, item->>'$.url' url from it where coalesce(item->>'$.url', '') <> '')", _SRC) + "select s.store_id, count(u.url) n_forms, min(u.url) example from src s left join u on s.run_id = u.run_id and " + _HOST.format("s.url") + " = u.host and u.host <> '' where s.url is not null group by 1")
def host_hint(spark, sf_dir):
    """What forms of a candidate's host the run's evidence has."""
    seen = evidence.result_urls(_evidence(spark, sf_dir)).select("run_id", urls.host(F.col("url")).alias("host"), "url").where("host <> ''").distinct()
    seen = seen.groupBy("run_id", "host").agg(F.count("*").alias("n_forms"), F.min("url").alias("example"))
    s = logs.sources(spark, sf_dir).where("url is not null").select("store_id", "run_id", urls.host(F.col("url")).alias("host"))
    return s.join(seen, ["run_id", "host"], "left").select("store_id", F.coalesce("n_forms", F.lit(0)).alias("n_forms"), "example")


# filters and validation


@query("select run_id, count(*) filter (trim(coalesce(name, '')) = '' or trim(coalesce(url, '')) = '') n_invalid, count(*) n from store where type = 'source' group by 1")
def invalid_rows(spark, sf_dir):
    blank = (F.trim(F.coalesce("name", F.lit(""))) == "") | (F.trim(F.coalesce("url", F.lit(""))) == "")
    return logs.sources(spark, sf_dir).groupBy("run_id").agg(F.count_if(blank).alias("n_invalid"), F.count("*").alias("n"))


@query(_with(_NODES, _LEAF) + "select s.run_id, count(*) n_unmatched from store s left join leaf l using (store_id) where s.type = 'source' and l.leaf is null group by 1")
def unmatched_nodes(spark, sf_dir):
    return _located(spark, sf_dir).where("leaf is null").groupBy("run_id").agg(F.count("*").alias("n_unmatched"))


_HIT = "hit as (select distinct c.store_id from (select store_id, run_id, unnest(" + _FORMS.format("url") + ") token from src where url is not null) c join (select distinct run_id, token from tok) t using (run_id, token))"
_GROUNDED = _with(_SRC, _EV, _TOKENS, _HIT)


@query(_GROUNDED + "select s.store_id, h.store_id is not null is_grounded from src s left join hit h using (store_id)")
def grounding(spark, sf_dir):
    """Candidates whose address stands in the evidence of their run."""
    return _grounded(spark, sf_dir).select("store_id", "is_grounded")


@query(_GROUNDED + "select run_id, count(*) n_ungrounded from src s left join hit h using (store_id) where h.store_id is null group by 1")
def ungrounded(spark, sf_dir):
    return _grounded(spark, sf_dir).where("not is_grounded").groupBy("run_id").agg(F.count("*").alias("n_ungrounded"))


@query("select store_id from store s where type = 'source' and url is not null and exists (select 1 from store f where f.type = 'source' and f.run_id = s.run_id and f.url = s.url and f.store_id < s.store_id)")
def ingest_skip_dupes(spark, sf_dir):
    """Entries whose exact address an earlier entry of the run has."""
    s = logs.sources(spark, sf_dir).where("url is not null").select("store_id", "run_id", "url")
    first = s.groupBy("run_id", "url").agg(F.min("store_id").alias("first"))
    return s.join(first, ["run_id", "url"]).where("store_id > first").select("store_id")


_OUTCOME = (
    "case when trim(coalesce(s.name, '')) = '' or trim(coalesce(s.url, '')) = '' then 'incomplete' when regexp_matches(" + _HOST.format("s.url") + ", '" + vocab.any_of(vocab.REFUSED_HOSTS) + "') then 'garbage' "
    "when l.leaf is null then 'unknown_node' when h.store_id is null then 'ungrounded' when s.store_id <> f.first then 'skipped' else 'accepted' end"
)
_FIRST = "fst as (select run_id, url, min(store_id) as first from src where url is not null group by 1, 2)"


@query(_with(_SRC, _EV, _TOKENS, _HIT, _NODES, _LEAF, _FIRST) + f"select s.store_id, {_OUTCOME} outcome from src s left join leaf l using (store_id) left join hit h on s.store_id = h.store_id left join fst f on s.run_id = f.run_id and s.url = f.url")
def ingest_outcomes(spark, sf_dir):
    """Every entry judged alone: accepted, skipped, or why it is rejected."""
    s = logs.sources(spark, sf_dir)
    return catalog.ingest_outcomes(s, logs.nodes(spark, sf_dir), _grounded(spark, sf_dir), "store_id").select("store_id", "outcome")


_KNOW = "kno as (select * from store where type = 'knowledge')"
_KOUT = "case when trim(coalesce(name, '')) = '' or trim(coalesce(node, '')) = '' then 'incomplete' when d.name is null then 'not_declared' when not coalesce(verified, false) then 'unverified' when trim(coalesce(url, '')) = '' then 'without_url' when regexp_matches(" + _HOST.format("url") + ", '" + vocab.any_of(vocab.REFUSED_HOSTS) + "') then 'garbage' when h.store_id is null then 'ungrounded' else 'accepted' end"


_KHIT = "hit as (select distinct c.store_id from (select store_id, run_id, unnest(" + _FORMS.format("url") + ") token from kno where url is not null) c join (select distinct run_id, token from tok) t using (run_id, token))"


@query(_with(_KNOW, _DECLARED, _EV, _TOKENS, _KHIT) + f"select k.store_id, {_KOUT.replace('(name,', '(k.name,').replace('(node,', '(k.node,')} outcome from kno k left join (select distinct run_id, name from dec) d on k.run_id = d.run_id and k.name = d.name left join hit h on k.store_id = h.store_id")
def knowledge_gate(spark, sf_dir):
    k = evidence.grounded(logs.knowledge(spark, sf_dir), _evidence(spark, sf_dir), "store_id")
    return gates.knowledge_outcomes(k, logs.declared(spark, sf_dir)).select("store_id", "outcome")


@query(
    "select run_id, name, category_path, url from store where type = 'source' union all "
    "select run_id, name, coalesce(nullif(category_path, ''), node), url from store where type = 'knowledge' and verified and coalesce(name, '') <> '' and coalesce(url, '') <> ''"
)
def knowledge_merge(spark, sf_dir):
    """Verified knowledge joins the candidates; without a path it takes its node."""
    return gates.with_knowledge(logs.sources(spark, sf_dir), logs.knowledge(spark, sf_dir))


@query("select run_id, count(*) filter (verified) n_verified, count(*) filter (verified and (coalesce(name, '') = '' or coalesce(url, '') = '')) n_incomplete, count(*) n from store where type = 'knowledge' group by 1")
def knowledge_incomplete(spark, sf_dir):
    lacking = (F.coalesce("name", F.lit("")) == "") | (F.coalesce("url", F.lit("")) == "")
    return logs.knowledge(spark, sf_dir).groupBy("run_id").agg(F.count_if("verified").alias("n_verified"), F.count_if(F.col("verified") & lacking).alias("n_incomplete"), F.count("*").alias("n"))


@query(_with(_KNOW, _DECLARED) + "select distinct d.run_id, d.list, d.name from dec d where not exists (select 1 from kno k where k.run_id = d.run_id and k.name = d.name)")
def gate_checklist(spark, sf_dir):
    """Declared items that no knowledge row records."""
    return gates.pending(logs.declared(spark, sf_dir), logs.knowledge(spark, sf_dir))


@query(_with(_SEARCH, _SRC) + f"select run_id, sum(extracted)::bigint extracted from sea where ({_GROUP.format('phase')}) in ('增量', '扩量') and run_id not in (select run_id from src) group by 1 having sum(extracted) > 0")
def gate_sources_missing(spark, sf_dir):
    return gates.sources_missing(logs.searches(spark, sf_dir), logs.sources(spark, sf_dir))


_LATEST = "lat as (select * from (select *, row_number() over (partition by run_id, phase, node, query order by store_id desc) rn from sea) where rn = 1)"
_EVQ = "asked as (select distinct run_id, query from evq where query is not null)"


@query(
    _with(_SEARCH, _EV, _EVQ, _NODES, _LATEST)
    + f"select n.run_id, n.node, count(j.store_id) filter (a.query is not null) n_evidenced from nod n left join (select * from lat where ({_GROUP.format('phase')}) = '增量') j on n.run_id = j.run_id and n.node = j.node left join asked a on j.run_id = a.run_id and j.query = a.query where n.run_id in (select run_id from lat where ({_GROUP.format('phase')}) = '增量') group by 1, 2 having count(j.store_id) filter (a.query is not null) < {vocab.MIN_INCREMENTAL}"
)
def gate_quota(spark, sf_dir):
    """Nodes with fewer evidenced incremental searches than asked for."""
    return gates.quota(_journal(spark, sf_dir), logs.nodes(spark, sf_dir), _evidence(spark, sf_dir))


def _journal(spark, sf_dir):
    return catalog.latest(logs.searches(spark, sf_dir), ["run_id", "phase", "node", "query"], "store_id")


@query(_with(_SEARCH, _LATEST) + f"select store_id from lat where ({_GROUP.format('phase')}) in ('增量', '扩量') and coalesce(extracted, 0) = 0 and trim(coalesce(zero_reason, '')) = ''")
def gate_zero_reason(spark, sf_dir):
    return gates.zero_without_reason(_journal(spark, sf_dir)).select("store_id")


_RURL = "rurl as (select distinct run_id, query, " + _HOST.format("item->>'$.url'") + " host from it where coalesce(item->>'$.url', '') <> '')"


@query(_with(_SEARCH, _LATEST, _EV, _ITEMS, _RURL) + f"select l.store_id, count(*) n_hosts from lat l join rurl r using (run_id, query) where coalesce(l.extracted, 0) = 0 and contains(l.zero_reason, '垃圾域') group by 1 having count(*) filter (regexp_matches(host, '{vocab.any_of(vocab.GARBAGE_HOSTS)}')) = 0")
def gate_garbage_claim(spark, sf_dir):
    """Reasons that claim garbage hosts although no result host is one."""
    return gates.garbage_claims(_journal(spark, sf_dir), evidence.result_urls(_evidence(spark, sf_dir)))


_CATHOST = "cat as (select distinct run_id, " + _HOST.format("访问地址") + " host from source_catalog where 访问地址 is not null)"


@query(_with(_SEARCH, _LATEST, _EV, _ITEMS, _RURL, _CATHOST) + "select l.store_id from lat l join rurl r using (run_id, query) left join cat c on r.run_id = c.run_id and r.host = c.host where coalesce(l.extracted, 0) = 0 and (contains(l.zero_reason, '已收') or contains(l.zero_reason, '重复')) group by 1 having count(c.host) = 0")
def report_claimed_collected(spark, sf_dir):
    """Reasons that claim collected results although no result host is in the catalog."""
    return gates.collected_claims(_journal(spark, sf_dir), evidence.result_urls(_evidence(spark, sf_dir)), logs.catalog(spark, sf_dir))


@query(_with(_SEARCH, _LATEST, _EV, _ITEMS) + "select distinct l.store_id from lat l join it r using (run_id, query) where coalesce(l.extracted, 0) = 0 and regexp_matches(r.item->>'$.url', '" + "|".join(vocab.SINGLE_DOCUMENT) + "')")
def report_single_doc_zero(spark, sf_dir):
    return gates.single_documents(_journal(spark, sf_dir), evidence.result_urls(_evidence(spark, sf_dir)))


@query(_with(_SEARCH, _SRC) + "select distinct run_id from sea where run_id not in (select run_id from src where trim(coalesce(name, '')) <> '' and trim(coalesce(url, '')) <> '')")
def gate_no_candidates(spark, sf_dir):
    """Runs with a journal but without any candidate."""
    whole = logs.sources(spark, sf_dir).where("trim(coalesce(name, '')) <> '' and trim(coalesce(url, '')) <> ''")
    return logs.searches(spark, sf_dir).select("run_id").distinct().join(whole, "run_id", "left_anti")


# joins


@query(_with(_EV, _EVQ, _SEARCH) + "select s.store_id, a.query is not null is_evidenced from sea s left join asked a using (run_id, query)")
def query_evidenced(spark, sf_dir):
    asked = _evidence(spark, sf_dir).where("query is not null").select("run_id", "query").distinct().withColumn("is_evidenced", F.lit(True))
    return logs.searches(spark, sf_dir).select("store_id", "run_id", "query").join(asked, ["run_id", "query"], "left").select("store_id", F.coalesce("is_evidenced", F.lit(False)).alias("is_evidenced"))


_LINEAGE = (
    "lj as (select * from (select *, row_number() over (partition by run_id, query order by store_id desc) rn from sea) where rn = 1), "
    "ent as (select run_id, " + _STRIP.format("url") + " url, min(store_id) store_id from src where url is not null group by 1, 2), "
    "lin as (select i.evidence_id, i.pos, i.sub, i.run_id, j.phase, j.node, i.query, j.results, " + _STRIP.format("i.item->>'$.url'") + " url, e.store_id from it i join lj j on i.run_id = j.run_id and i.query = j.query "
    "left join ent e on i.run_id = e.run_id and e.url = " + _STRIP.format("i.item->>'$.url'") + " where coalesce(i.item->>'$.url', '') <> '')"
)


@query(_with(_SRC, _SEARCH, _EV, _ITEMS, _LINEAGE) + "select l.evidence_id, l.pos::int pos, l.sub::int sub, l.phase, l.node, l.query, l.results, l.url, case when s.store_id is null then '否' else '是' end collected, coalesce(s.name, '') as name, coalesce(s.reason, '') reason from lin l left join src s on l.store_id = s.store_id")
def lineage(spark, sf_dir):
    """Every result address of a journal query and the entry it became."""
    return catalog.lineage(evidence.result_urls(_evidence(spark, sf_dir)), logs.searches(spark, sf_dir), logs.sources(spark, sf_dir)).drop("run_id")


@query(
    _with(_SRC, _SEARCH, _EV, _ITEMS)
    + ", su as (select distinct run_id, " + _STRIP.format("item->>'$.url'") + " url from it where coalesce(item->>'$.url', '') <> ''), "
    + "tx as (select run_id, evidence_id, query, trim(unnest(regexp_extract_all(coalesce(item->>'$.text', case when json_type(item) = 'VARCHAR' then item->>'$' end), '" + evidence.TOKEN.replace("'", "''") + "')), '*') t from it where query is not null), "
    + "tt as (select run_id, evidence_id, query, unnest(list_concat([t], list_transform(range(1, len(string_split(t, '#'))), lambda i: array_to_string(string_split(t, '#')[1:i], '#')))) token from tx), "
    + "c as (select store_id, run_id, " + _STRIP.format("url") + " url from src where url is not null), f as (select store_id, run_id, url, unnest(" + _FORMS.format("url") + ") token from c), "
    + "m as (select f.store_id, f.run_id, f.url, min_by(tt.query, (tt.evidence_id, tt.query)) query from f join tt on f.run_id = tt.run_id and f.token = tt.token where tt.token <> '' and not exists (select 1 from su where su.run_id = f.run_id and su.url = f.url) group by 1, 2, 3), "
    + "lj as (select * from (select *, row_number() over (partition by run_id, query order by store_id desc) rn from sea) where rn = 1) "
    + "select m.store_id, m.url, m.query, coalesce(lj.phase, '') phase, coalesce(lj.node, '') node, '摘要文本提取' note from m left join lj on m.run_id = lj.run_id and m.query = lj.query"
)
def lineage_text_fallback(spark, sf_dir):
    """Entries whose address stands only in the text of results, with the journal's row of the query."""
    s = logs.sources(spark, sf_dir)
    return catalog.text_lineage(s, _evidence(spark, sf_dir), logs.searches(spark, sf_dir)).drop("run_id")


@query(
    _with(_SRC, _EV, _TOKENS)
    + "select s.store_id, q.first_query from src s left join (select c.store_id, min_by(t.query, (t.evidence_id, t.query)) first_query from (select store_id, run_id, unnest("
    + _FORMS.format("(" + _STRIP.format("url") + ")")
    + ") token from src where url is not null) c join tok t using (run_id, token) where t.query is not null group by 1) q using (store_id)"
)
def first_query(spark, sf_dir):
    """The query of the earliest evidence line that holds an entry's address."""
    return evidence.first_queries(logs.sources(spark, sf_dir), _evidence(spark, sf_dir), "store_id")


@query(_with(_KNOW, _DECLARED) + "select d.run_id, d.node, count(distinct d.name) n_pending from dec d where not exists (select 1 from kno k where k.run_id = d.run_id and k.name = d.name) group by 1, 2")
def pending_items(spark, sf_dir):
    done = logs.knowledge(spark, sf_dir).select("run_id", "name").where("name is not null").distinct()
    return logs.declared(spark, sf_dir).join(done, ["run_id", "name"], "left_anti").groupBy("run_id", "node").agg(F.count_distinct("name").alias("n_pending"))


@query(_with(_EV, _EVQ, _SEARCH) + "select a.run_id, count(*) evidence_queries, count(*) filter (j.query is null) unlogged from asked a left join (select distinct run_id, query from sea) j using (run_id, query) group by 1")
def reverse_gap(spark, sf_dir):
    """Evidence queries of each run that its journal lacks."""
    return gates.reverse_gap(_evidence(spark, sf_dir), logs.searches(spark, sf_dir))


@query(
    _with(_SRC, _SEARCH, _NODES, _LEAF)
    + ", r as (select s.run_id, l.leaf node, count(*) recorded from src s join leaf l using (store_id) group by 1, 2), x as (select run_id, node, sum(extracted)::bigint extracted from sea group by 1, 2) "
    "select n.run_id, n.node, coalesce(recorded, 0) recorded, coalesce(extracted, 0) extracted, greatest(0, coalesce(extracted, 0) - coalesce(recorded, 0)) missing from nod n left join r using (run_id, node) left join x using (run_id, node)"
)
def coverage(spark, sf_dir):
    """Recorded, extracted and missing entries of every declared node."""
    return gates.coverage(_located(spark, sf_dir), logs.searches(spark, sf_dir), logs.nodes(spark, sf_dir))


# aggregates


_STATS = (
    "cnt as (select s.run_id, l.leaf node, s.source_type, count(*) n from src s join leaf l using (store_id) join hit h on s.store_id = h.store_id group by 1, 2, 3), "
    "tot as (select run_id, source_type, sum(n)::bigint n from cnt group by 1, 2) "
    "select n.run_id, n.node, coalesce(sum(c.n), 0)::bigint n, coalesce(string_agg(c.source_type || ':' || c.n, '; ' order by c.n desc, c.source_type), '') types from nod n left join cnt c using (run_id, node) group by 1, 2 "
    "union all select run_id, '总计', sum(n)::bigint, string_agg(source_type || ':' || n, '; ' order by n desc, source_type) from tot group by 1"
)


@query(_with(_SRC, _EV, _TOKENS, _HIT, _NODES, _LEAF) + ", " + _STATS)
def stats_by_node(spark, sf_dir):
    """Grounded entries of every declared node by type, with a total for each run."""
    # nodes first: an operator that reads its rows twice would read the evidence twice
    rows = evidence.grounded(_located(spark, sf_dir), _evidence(spark, sf_dir), "store_id").where("is_grounded")
    return catalog.stats_by_node(rows, logs.nodes(spark, sf_dir))


@query(
    _with(_SRC, _EV, _TOKENS, _HIT, _NODES, _LEAF, _FIRST)
    + f", o as (select s.run_id, {_OUTCOME} outcome from src s left join leaf l using (store_id) left join hit h on s.store_id = h.store_id left join fst f on s.run_id = f.run_id and s.url = f.url) "
    "select run_id, count(*) total, count(*) filter (outcome = 'incomplete') invalid, count(*) filter (outcome = 'garbage') garbage_filtered, count(*) filter (outcome = 'unknown_node') unmatched, count(*) filter (outcome = 'ungrounded') ungrounded, count(*) filter (outcome = 'skipped') skipped, count(*) filter (outcome = 'accepted') accepted from o group by 1"
)
def run_summary(spark, sf_dir):
    """The counters of each run in one pass over the outcomes."""
    o = catalog.ingest_outcomes(logs.sources(spark, sf_dir), logs.nodes(spark, sf_dir), _grounded(spark, sf_dir), "store_id")
    names = {"incomplete": "invalid", "garbage": "garbage_filtered", "unknown_node": "unmatched", "ungrounded": "ungrounded", "skipped": "skipped", "accepted": "accepted"}
    return o.groupBy("run_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("outcome") == k).alias(v) for k, v in names.items()])


@query(_with(_SEARCH) + f"select inside, case when inside then '' else node end node, count(*) n, sum(extracted)::bigint extracted from ({_SCOPE}) where ({_GROUP.format('phase')}) <> '验证' group by 1, 2")
def query_scope_summary(spark, sf_dir):
    """Searches inside the frame, and those outside by node."""
    s = _scoped(spark, sf_dir).where(vocab.phase_group(F.col("phase")) != "验证")
    return s.groupBy("inside", F.when(F.col("inside"), "").otherwise(F.col("node")).alias("node")).agg(F.count("*").alias("n"), F.sum("extracted").alias("extracted"))


@query("select code, actor, (grouping(code) * 2 + grouping(actor))::int level, count(*) n from reject_event group by grouping sets ((code), (actor), ())")
def reject_summary(spark, sf_dir):
    """Reject events by code, by actor and in all."""
    t = table(spark, sf_dir, "reject_event")
    return t.groupingSets([["code"], ["actor"], []], "code", "actor").agg((F.grouping("code").cast("int") * 2 + F.grouping("actor").cast("int")).alias("level"), F.count("*").alias("n"))


@query(_with(_SEARCH, _LATEST, _EV, _EVQ) + "select l.run_id, l.node, count(*) n, count(*) filter (a.query is null) unevidenced from lat l left join asked a using (run_id, query) group by 1, 2")
def quota_attestation(spark, sf_dir):
    asked = _evidence(spark, sf_dir).where("query is not null").select("run_id", "query").distinct().withColumn("_in", F.lit(True))
    return _journal(spark, sf_dir).join(asked, ["run_id", "query"], "left").groupBy("run_id", "node").agg(F.count("*").alias("n"), F.count_if(F.col("_in").isNull()).alias("unevidenced"))


@query(_with(_SEARCH, _LATEST) + f"select run_id, count(*) n, count(*) filter (trim(coalesce(zero_reason, '')) <> '') n_with_reason from lat where ({_GROUP.format('phase')}) in ('增量', '扩量') and coalesce(extracted, 0) = 0 group by 1")
def zero_extraction(spark, sf_dir):
    z = _journal(spark, sf_dir).where(vocab.phase_group(F.col("phase")).isin("增量", "扩量") & (F.coalesce("extracted", F.lit(0)) == 0))
    return z.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce("zero_reason", F.lit(""))) != "").alias("n_with_reason"))


@query(
    _with(_KNOW, _DECLARED)
    + "select m.run_id, coalesce(d.n, 0) declared, coalesce(k.n, 0) recorded, coalesce(k.v, 0) verified, coalesce(k.n, 0) - coalesce(k.v, 0) unverified from manifest m left join (select run_id, count(distinct name) n from dec group by 1) d using (run_id) left join (select run_id, count(*) n, count(*) filter (verified) v from (select *, row_number() over (partition by run_id, name order by store_id desc) rn from kno where name is not null) where rn = 1 group by 1) k using (run_id)"
)
def knowledge_recon(spark, sf_dir):
    """Declared, recorded, verified and unverified items of each run."""
    last = catalog.latest(logs.knowledge(spark, sf_dir).where("name is not null"), ["run_id", "name"], "store_id")
    k = last.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if("verified").alias("v"))
    d = logs.declared(spark, sf_dir).groupBy("run_id").agg(F.count_distinct("name").alias("d"))
    n, v = F.coalesce("n", F.lit(0)), F.coalesce("v", F.lit(0))
    return table(spark, sf_dir, "manifest").select("run_id").join(d, "run_id", "left").join(k, "run_id", "left").select("run_id", F.coalesce("d", F.lit(0)).alias("declared"), n.alias("recorded"), v.alias("verified"), (n - v).alias("unverified"))


@query("select run_id, 阶段 phase, count(*) n, coalesce(sum(提取候选数), 0)::bigint extracted, count(*) filter (coalesce(提取候选数, 0) = 0) n_zero, count(*) filter (coalesce(提取候选数, 0) = 0) * 100 // count(*) zero_percent, (coalesce(sum(提取候选数), 0) * 100 // count(*))::bigint extracted_per_100 from search_log group by 1, 2")
def funnel_by_phase(spark, sf_dir):
    return audit.funnel(logs.journal(spark, sf_dir))


@query("select run_id, 节点 node, count(*) n, count(*) < 20 below_quota from search_log where 阶段 = '增量发现' group by 1, 2")
def incremental_per_node(spark, sf_dir):
    return logs.journal(spark, sf_dir).where(F.col("phase") == vocab.INCREMENTAL).groupBy("run_id", "node").agg(F.count("*").alias("n"), (F.count("*") < vocab.MIN_INCREMENTAL).alias("below_quota"))


@query("select 数据源类型 source_type, 粒度 granularity, (grouping(数据源类型) * 2 + grouping(粒度))::int level, count(*) n from source_catalog group by grouping sets ((数据源类型), (粒度))")
def type_histogram(spark, sf_dir):
    t = logs.catalog(spark, sf_dir)
    return t.groupingSets([["source_type"], ["granularity"]], "source_type", "granularity").agg((F.grouping("source_type").cast("int") * 2 + F.grouping("granularity").cast("int")).alias("level"), F.count("*").alias("n"))


@query(
    f"with h as (select run_id, {_HOST.format('访问地址')} host, count(*) n from source_catalog where 访问地址 is not null group by 1, 2) select run_id, count(*) n_hosts, count(*) filter (n = 1) n_single, coalesce(sum(n) filter (n >= 5), 0)::bigint n_big, (coalesce(sum(n) filter (n >= 5), 0) * 100 // sum(n))::bigint big_percent from h group by 1"
)
def domain_concentration(spark, sf_dir):
    return audit.concentration(logs.catalog(spark, sf_dir))


@query("select run_id, count(*) n, count(*) filter (trim(coalesce(来源搜索, '')) = '') n_empty, count(*) filter (trim(coalesce(来源搜索, '')) = '') * 100 // count(*) empty_percent from source_catalog group by 1")
def attribution_gap(spark, sf_dir):
    empty = F.count_if(F.trim(F.coalesce("first_query", F.lit(""))) == "")
    return logs.catalog(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("n"), empty.alias("n_empty"), F.floor(empty * 100 / F.count("*")).alias("empty_percent"))


@query(
    "with c as (select run_id, count(*) delivered, count(*) filter (数据源类型 = '其他') other from source_catalog group by 1), s as (select run_id, count(*) searches from search_log group by 1), "
    "a as (select m.domain_id, m.run_id, c.delivered, c.other, coalesce(s.searches, 0) searches, row_number() over (partition by m.domain_id order by m.run_id desc) rn, count(*) over (partition by m.domain_id) k from manifest m join c using (run_id) left join s using (run_id)) "
    "select domain_id, run_id, delivered, other, other * 100 // greatest(1, delivered) other_percent, searches, delivered * 100 // greatest(1, searches) per_100_searches from a where rn <= 8 and k >= 2"
)
def history_runs(spark, sf_dir):
    """The last eight runs of each domain that has at least two."""
    return audit.history(table(spark, sf_dir, "manifest"), logs.catalog(spark, sf_dir), logs.journal(spark, sf_dir))


@query("select coalesce(model, '') model, count(*) n from manifest group by 1")
def model_usage(spark, sf_dir):
    return table(spark, sf_dir, "manifest").groupBy(F.coalesce("model", F.lit("")).alias("model")).agg(F.count("*").alias("n"))


_ZERO = (
    "z as (select distinct run_id, 阶段 phase, 节点 node, 查询词 query from search_log where 阶段 = '增量发现' and coalesce(提取候选数, 0) = 0), "
    "rs as (select run_id, 节点 node, 查询词 query, max_by(coalesce(零提取理由, ''), log_id) reason from search_log where 阶段 = '增量发现' group by 1, 2, 3), "
    "hs as (select distinct z.run_id, z.node, z.query, " + _HOST.format("l.url") + " host from z join lin l on z.run_id = l.run_id and z.phase = l.phase and z.query = l.query), "
    "ct as (select h.run_id, h.node, h.query, count(*) n, count(*) filter (regexp_matches(h.host, '" + vocab.any_of(vocab.GARBAGE_HOSTS) + "')) g, count(c.host) d from hs h left join cat c on h.run_id = c.run_id and h.host = c.host group by 1, 2, 3), "
    "cl as (select ct.run_id, ct.node, ct.query, case when d = n then '已收' when g = n then '结果垃圾' when g > 0 then '混合' when regexp_matches(coalesce(rs.reason, ''), '" + vocab.any_of(vocab.EXPLAINED) + "') then '理由已说明' else '疑似漏收' end class "
    "from ct left join rs on ct.run_id = rs.run_id and ct.node = rs.node and ct.query = rs.query)"
)


def _zero(spark, sf_dir):
    rows = catalog.lineage(evidence.result_urls(_evidence(spark, sf_dir)), logs.searches(spark, sf_dir), logs.sources(spark, sf_dir))
    return audit.zero_classes(logs.journal(spark, sf_dir), rows, logs.catalog(spark, sf_dir))


@query(_with(_SRC, _SEARCH, _EV, _ITEMS, _LINEAGE, _CATHOST, _ZERO) + "select run_id, class, count(*) n from cl group by 1, 2")
def zero_split(spark, sf_dir):
    """Searches without a find, by what their results were."""
    return _zero(spark, sf_dir).groupBy("run_id", "class").agg(F.count("*").alias("n"))


@query(_with(_SRC, _SEARCH, _EV, _ITEMS, _LINEAGE, _CATHOST, _ZERO) + "select run_id, class, node, query from (select *, row_number() over (partition by run_id, class order by node, query) rn from cl) where rn <= 4")
def zero_split_samples(spark, sf_dir):
    """The first four of each class."""
    w = Window.partitionBy("run_id", "class").orderBy("node", "query")
    return _zero(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn <= 4").select("run_id", "class", "node", "query")


@query(
    _with(_SEARCH, _LATEST, _EV, _ITEMS, _RURL, _CATHOST)
    + f", v as (select run_id, store_id from lat where ({_GROUP.format('phase')}) in ('增量', '扩量') and coalesce(extracted, 0) = 0), g as (select l.store_id from lat l join rurl r using (run_id, query) where coalesce(l.extracted, 0) = 0 and contains(l.zero_reason, '垃圾域') group by 1 having count(*) filter (regexp_matches(host, '{vocab.any_of(vocab.GARBAGE_HOSTS)}')) = 0), "
    "c as (select l.store_id from lat l join rurl r using (run_id, query) left join cat c on r.run_id = c.run_id and r.host = c.host where coalesce(l.extracted, 0) = 0 and (contains(l.zero_reason, '已收') or contains(l.zero_reason, '重复')) group by 1 having count(c.host) = 0) "
    "select v.run_id, count(*) total, count(g.store_id) garbage_claims, count(c.store_id) collected_claims from v left join g using (store_id) left join c using (store_id) group by 1"
)
def zero_audit(spark, sf_dir):
    """Zero extractions of each run and the claims that evidence contradicts."""
    j = _journal(spark, sf_dir)
    z = j.where(vocab.phase_group(F.col("phase")).isin("增量", "扩量") & (F.coalesce("extracted", F.lit(0)) == 0)).select("run_id", "store_id")
    c = gates.claims(j, evidence.result_urls(_evidence(spark, sf_dir)), logs.catalog(spark, sf_dir))
    return z.join(c, "store_id", "left").groupBy("run_id").agg(F.count("*").alias("total"), F.count_if("garbage_claim").alias("garbage_claims"), F.count_if("collected_claim").alias("collected_claims"))


# order


_DEDUP = """with recursive s as (select run_id, store_id, row_number() over (partition by run_id order by store_id) rn, 'u:' || {canon} u, 'n:' || {host} || '|' || name n from store where type = 'source' and coalesce(url, '') <> '' and coalesce(name, '') <> ''),
g as (select run_id, rn, store_id, true kept, [u, n] seen from s where rn = 1 union all
 select s.run_id, s.rn, s.store_id, not (list_contains(g.seen, s.u) or list_contains(g.seen, s.n)), case when list_contains(g.seen, s.u) or list_contains(g.seen, s.n) then g.seen else g.seen || [s.u, s.n] end from g join s on s.run_id = g.run_id and s.rn = g.rn + 1)
select store_id from g where kept"""


@query(_DEDUP.format(canon=_CANON.format("url"), host=_HOST.format("url")))
def dedup(spark, sf_dir):
    """Entries that remain when each goes if an earlier kept one has its page or its host and name."""
    return catalog.keep_first(logs.sources(spark, sf_dir), "store_id", ["run_id"]).select("store_id")


@query(_with(_SEARCH, _LATEST) + "select store_id from lat")
def journal_latest(spark, sf_dir):
    return _journal(spark, sf_dir).select("store_id")


@query("select store_id from (select store_id, row_number() over (partition by run_id, name order by store_id desc) rn from store where type = 'knowledge' and name is not null) where rn = 1")
def knowledge_latest(spark, sf_dir):
    return catalog.latest(logs.knowledge(spark, sf_dir).where("name is not null"), ["run_id", "name"], "store_id").select("store_id")


@query(f"select host, n from (select {_HOST.format('访问地址')} host, count(*) n from source_catalog where 访问地址 is not null group by 1) order by n desc, host limit 8")
def top_hosts(spark, sf_dir):
    """The eight commonest hosts."""
    return logs.catalog(spark, sf_dir).where("url is not null").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(8)


@query("select run_id, name from (select distinct run_id, name from store where type = 'source' and name is not null) union select run_id, 数据源名称 from source_catalog where 数据源名称 is not null")
def delivered_names(spark, sf_dir):
    """Set operation: names that a run stored or delivered."""
    a = logs.sources(spark, sf_dir).where("name is not null").select("run_id", "name")
    return a.unionByName(logs.catalog(spark, sf_dir).where("name is not null").select("run_id", "name")).distinct()


# transcripts: the evidence log told as sessions, each call a line of the assistant and one of the user; fetches stand for shell calls


def _transcript(spark, sf_dir):
    e = table(spark, sf_dir, "evidence_log").where("tool_input is not null and not contains(tool_input, '\\u0000')").join(table(spark, sf_dir, "manifest").select("run_id", F.coalesce("model", F.lit("?")).alias("model")), "run_id")
    tool = F.when(F.col("tool_name") == "WebFetch", "Bash").otherwise(F.col("tool_name"))
    ask = F.struct(F.lit("assistant").alias("type"), F.struct("model", F.array(
        F.struct(F.lit("thinking").alias("type"), F.col("tool_input").alias("thinking"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<command:string>").alias("input")),
        F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("thinking"), F.col("evidence_id").cast("string").alias("id"), tool.alias("name"), F.struct(F.col("run_id").alias("command")).alias("input")),
    ).alias("content")).alias("message"))
    back = F.struct(F.lit("user").alias("type"), F.struct(F.array(F.struct(F.lit("tool_result").alias("type"), F.col("evidence_id").cast("string").alias("tool_use_id"), F.coalesce("tool_response", F.lit("")).alias("content"))).alias("content")).alias("message"))
    at = F.col("evidence_id") * 2
    lines = e.select(F.coalesce("session_id", F.lit("")).alias("session"), F.explode(F.array(F.struct(at.alias("line_no"), F.to_json(ask).alias("line")), F.struct((at + 1).alias("line_no"), F.to_json(back).alias("line")))).alias("_l"))
    return audit.transcript_blocks(lines.select("session", "_l.line_no", "_l.line"))


_CALLS = "e as (select coalesce(session_id, '') as session, evidence_id, run_id, case when tool_name = 'WebFetch' then 'Bash' else tool_name end tool, tool_input thought, coalesce(tool_response, '') back, coalesce(m.model, '?') model from evidence_log join manifest m using (run_id) where tool_input is not null)"


@query(_with(_CALLS) + "select session, model, count(*) n from e group by 1, 2")
def transcript_scan(spark, sf_dir):
    """Lines of each session by model."""
    return audit.models(_transcript(spark, sf_dir))


@query(_with(_CALLS) + "select session, evidence_id::varchar id, tool, length(back) chars from e")
def tool_pairs(spark, sf_dir):
    """Each tool result with the call it answers."""
    return audit.tool_pairs(_transcript(spark, sf_dir))


@query(
    _with(_CALLS)
    + "select session, search_no, sum(length(thought))::bigint chars from (select session, thought, tool, coalesce(sum((tool = 'WebSearch')::int) over (partition by session order by evidence_id rows between unbounded preceding and 1 preceding), 0)::bigint + 1 search_no from e) group by 1, 2 having max(tool) = 'WebSearch'"
)
def thinking_per_search(spark, sf_dir):
    """Characters thought since the search before, for each search."""
    return audit.thinking_per_search(_transcript(spark, sf_dir))


@query(_with(_CALLS) + "select session, evidence_id * 2 line_no, null::varchar ts, tool, run_id command, length('{\"command\":\"' || run_id || '\"}') args from (select *, row_number() over (partition by session order by evidence_id) rn from e where tool = 'Bash') where rn <= 20")
def anomaly_calls(spark, sf_dir):
    return audit.anomalies(_transcript(spark, sf_dir))


@query(
    _with(_CALLS)
    + "select session, line_no, sentence from (select *, row_number() over (partition by session order by line_no, i) rn from (select session, evidence_id * 2 line_no, unnest(regexp_split_to_array(thought, '\\n+')) sentence, generate_subscripts(regexp_split_to_array(thought, '\\n+'), 1) i from e) where regexp_matches(sentence, '"
    + vocab.DECISION + "') and length(sentence) > 20) where rn <= 200"
)
def decision_sentences(spark, sf_dir):
    return audit.decisions(_transcript(spark, sf_dir))


@query(
    _with(_CALLS)
    + "select session, bucket, count(*) n_blocks, sum(n)::bigint chars, floor(avg(n))::bigint mean_chars, max(n) max_chars from (select session, '思考' bucket, length(thought) n from e union all select session, '工具返回', length(back) from e union all select session, '参数:' || tool, length('{\"command\":\"' || run_id || '\"}') from e) group by 1, 2"
)
def context_chars(spark, sf_dir):
    """What fills each session's context."""
    return audit.context_chars(_transcript(spark, sf_dir))


@query("select run_id, name from (select distinct run_id, name from store where type = 'source' and name is not null) intersect select run_id, 数据源名称 from source_catalog where 数据源名称 is not null")
def stored_and_delivered_names(spark, sf_dir):
    """Set operation: names that a run both stored and delivered."""
    a = logs.sources(spark, sf_dir).where("name is not null").select("run_id", "name")
    return a.intersect(logs.catalog(spark, sf_dir).where("name is not null").select("run_id", "name"))


@query("select file_kind, count(*) n_lines, count(*) filter (not coalesce(json_valid(record), false)) n_bad from run_file_rows group by 1")
def scan_store_bad_lines(spark, sf_dir):
    """Archived lines by kind, and those that cannot be read."""
    bad = F.count_if(F.try_parse_json("record").isNull())
    return table(spark, sf_dir, "run_file_rows").groupBy("file_kind").agg(F.count("*").alias("n_lines"), bad.alias("n_bad"))


@query("select store_id, coalesce(regexp_matches(url, '" + "|".join(vocab.SINGLE_DOCUMENT) + "'), false) is_single from store where type = 'source'")
def single_doc(spark, sf_dir):
    return logs.sources(spark, sf_dir).select("store_id", F.coalesce(F.col("url").rlike("|".join(vocab.SINGLE_DOCUMENT)), F.lit(False)).alias("is_single"))


@query(_with(_KNOW, _DECLARED) + "select distinct run_id, name, 'store' origin from kno where name is not null union all select distinct run_id, name, 'manifest' from dec where list = 'knowledge' and run_id not in (select run_id from kno)")
def knowledge_source_pick(spark, sf_dir):
    """A run's knowledge: from its store if that has any, else from its manifest."""
    k = logs.knowledge(spark, sf_dir)
    own = k.where("name is not null").select("run_id", "name", F.lit("store").alias("origin")).distinct()
    rest = logs.declared(spark, sf_dir).where("list = 'knowledge'").select("run_id", "name", F.lit("manifest").alias("origin")).distinct()
    return own.unionByName(rest.join(k.select("run_id").distinct(), "run_id", "left_anti"))


@query(
    _with(_SRC, _NODES, _LEAF, _KNOW, _DECLARED)
    + ", c as (select s.run_id, l.leaf node, coalesce(s.source_type, '') source_type, count(*) n from src s join leaf l using (store_id) group by 1, 2, 3), t as (select run_id, node, string_agg(source_type || ':' || n, '; ' order by n desc, source_type) types from c group by 1, 2), "
    "p as (select d.run_id, d.node, string_agg(distinct d.name, '; ' order by d.name) pending from dec d where not exists (select 1 from kno k where k.run_id = d.run_id and k.name = d.name) group by 1, 2) "
    "select n.run_id, n.node, coalesce(t.types, '') types, coalesce(p.pending, '') pending from nod n left join t using (run_id, node) left join p using (run_id, node)"
)
def coverage_details(spark, sf_dir):
    """Types recorded and items pending at every declared node."""
    counts = _located(spark, sf_dir).where("leaf is not null").groupBy("run_id", F.col("leaf").alias("node"), F.coalesce("source_type", F.lit("")).alias("source_type")).agg(F.count("*").alias("n"))
    types = catalog.type_text(counts, ["run_id", "node"], "source_type", "n").drop("n")
    done = logs.knowledge(spark, sf_dir).where("name is not null").select("run_id", "name").distinct()
    left = logs.declared(spark, sf_dir).join(done, ["run_id", "name"], "left_anti").groupBy("run_id", "node").agg(F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("pending"))
    rows = logs.nodes(spark, sf_dir).join(types, ["run_id", "node"], "left").join(left, ["run_id", "node"], "left")
    return rows.select("run_id", "node", F.coalesce("types", F.lit("")).alias("types"), F.coalesce("pending", F.lit("")).alias("pending"))


@query()  # the other engine's edit distance counts bytes
def nearest_name(spark, sf_dir):
    """For each recorded name that the manifest lacks, the declared name nearest to it."""
    return gates.nearest_declared(logs.knowledge(spark, sf_dir), logs.declared(spark, sf_dir))
