"""Readers: the append-only logs as typed DataFrames, from tables and from files.

File readers never fail on a bad line: it is kept and counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.session import table

STORE_SCHEMA = (
    "type string, ts string, phase string, node string, query string, results int, extracted int, zero_reason string, name string, category_path string, "
    "source_type string, source_type_raw string, granularity string, url string, description string, reason string, verified boolean, note string"
)
REJECT_SCHEMA = "ts string, code string, actor string, node string, name string, url string, detail map<string,string>"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, line`` of text files, numbered from 0 within each file.

    Files are split like any others: lines are counted for each split, and a line's
    number is the lines of the splits before it and its place in its own.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_i"), F.col("value").alias("line"))
    before = Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "_at").agg(F.count("*").alias("_n"), F.min("_i").alias("_first")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return lines.join(splits, ["file", "_at"]).select("file", (F.col("_before") + F.col("_i") - F.col("_first")).alias("line_no"), "line")


def read_store_lines(spark: SparkSession, path: str) -> DataFrame:
    """A JSONL store with ``seq`` (line number) and ``bad_line`` for what cannot be read."""
    lines = numbered_lines(spark, path).where("trim(line) <> ''")
    row = F.from_json("line", STORE_SCHEMA + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.select(F.col("line_no").alias("seq"), row.alias("r")).select("seq", "r.*").withColumnRenamed("_bad", "bad_line")


def read_evidence_lines(spark: SparkSession, path: str) -> DataFrame:
    """Evidence lines as VARIANT; invalid UTF-8 and broken JSON leave ``doc`` null."""
    text = F.make_valid_utf8("line")
    return numbered_lines(spark, path).where("line <> ''").select("line_no", text.alias("line"), F.try_parse_json(text).alias("doc"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """``session, line_no, line`` of transcript files, one session a file."""
    return numbered_lines(spark, path).select(F.regexp_extract("file", r"([^/]*)\z", 1).alias("session"), "line_no", F.make_valid_utf8("line").alias("line"))


def with_columns(df: DataFrame, **wanted: tuple[str, ...]) -> DataFrame:
    """Each wanted column from the first of its names that ``df`` has, null if it has none: deliveries change their columns."""
    return df.select(*[next((F.col(f"`{c}`") for c in names if c in df.columns), F.lit(None).cast("string")).alias(k) for k, names in wanted.items()])


def first_file(spark: SparkSession, pattern: str) -> str | None:
    """The first path in order that a glob pattern matches, on any file system Spark reads."""
    glob = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob)
    return min((f.getPath().toString() for f in found or []), default=None)


def read_csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A delivered CSV: byte-order mark, quotes and line breaks in fields; empty rows are left out."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    return df.dropna(how="all")


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Reject events; a missing file means none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], REJECT_SCHEMA)
    return spark.read.schema(REJECT_SCHEMA).json(path)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "store").where("type = 'source'").select("store_id", "run_id", "name", "category_path", "source_type", "source_type_raw", "granularity", "url", "reason")


def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "store").where("type = 'knowledge'").select("store_id", "run_id", "name", "node", "verified", "category_path", "source_type", "url", "reason", "note")


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "store").where("type = 'search'").select("store_id", "run_id", "phase", "node", "query", "results", "extracted", "zero_reason")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = {"数据源名称": "name", "分类路径": "category_path", "数据源类型": "source_type", "粒度": "granularity", "访问地址": "url", "来源搜索": "first_query"}
    return table(spark, sf_dir, "source_catalog").select("entry_id", "run_id", *[F.col(a).alias(b) for a, b in cols.items()])


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = {"阶段": "phase", "节点": "node", "查询词": "query", "返回链接数": "results", "提取候选数": "extracted", "零提取理由": "zero_reason"}
    return table(spark, sf_dir, "search_log").select("log_id", "run_id", *[F.col(a).alias(b) for a, b in cols.items()])


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared nodes of each run, once each."""
    return table(spark, sf_dir, "manifest").select("run_id", F.explode("nodes").alias("node")).distinct()


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vendors and knowledge items that a run's manifest declares."""
    m = table(spark, sf_dir, "manifest")
    each = [m.select("run_id", F.lit(c).alias("list"), F.explode(c).alias("_x")).select("run_id", "list", "_x.name", "_x.node") for c in ("vendors", "knowledge")]
    return each[0].unionByName(each[1]).where("name is not null and name <> ''")
