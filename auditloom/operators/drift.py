"""Schemas that drift between files: tagged-union inference and one table.

Each record is opened into (file, path, tag), at every depth, where the tag is the
JSON type of the value.  Fusing the schemas of parallel files keeps every
alternative type of a path; a conflict becomes typed branches plus one canonical
value.  Files of one group in order of time are compared pairwise by the
alternatives of their fields, and each appearing, vanishing, renamed or retyped
field is reported.

A rename needs the same content under the same type: the removed and the added
field are compared by the cosine of their content profiles, they must be each
other's best match, and names that stand side by side in any file are never one
field.  Values are profiled only for the fields that vanish and appear in one
step, in a second, narrow pass.

Tags are counted within each batch of rows, so a row costs no shuffle; windows run
over files, not rows.

Defined results: blanks and byte-order marks around field names do not count; of
two spellings of a field in one record the first value that is not null is the
field's, the others stand in its branch ``others``; null values make a field
present but give it no type; a tie between types goes to the type first in the
order of TAGS; records that are not JSON objects carry no fields; integers of up
to 38 digits keep all of them, what no branch can hold keeps its text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditloom.operators import nested
from auditloom.session import checkpointed

#: JSON types, in the order that breaks ties.
TAGS = ["string", "boolean", "integer", "number", "array", "object"]
#: Words for true and false in free entry (fixed values).
YES = ["true", "1", "是", "y", "yes", "通过", "t"]
NO = ["false", "0", "否", "n", "no", "不通过", "f"]
#: Profiles at least so similar can be one field under two names.
SAME_CONTENT = 0.5
#: Steps in which two names are found to be one field before their content need not decide again.
KNOWN_RENAMES = 2
#: Distinct field names that the driver takes at most (names belong to the schema).
MAX_FIELDS = 100_000

_NAME_EDGE = r"[\s\x{00A0}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}]+"

_EDGES = re.compile(r"^[\s\u00a0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]+|[\s\u00a0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]+$")


def clean_name(name: Column) -> Column:
    return F.regexp_replace(name, f"^{_NAME_EDGE}|{_NAME_EDGE}$", "")


def tag(value: Column) -> Column:
    """The JSON type of a variant; null for JSON null."""
    t = F.schema_of_variant(value)
    return (
        F.when(t.startswith("OBJECT"), "object")
        .when(t.startswith("ARRAY"), "array")
        .when(t == "STRING", "string")
        .when(t == "BOOLEAN", "boolean")
        .when((t == "BIGINT") | t.rlike(r"^DECIMAL\((19|[23]\d),0\)$"), "integer")
        .when((t != "VOID") & t.isNotNull(), "number")
    )


def entries(record: Column) -> Column:
    """``array<struct<field, value>>`` of a JSON object, null if it is none."""
    opened = F.map_entries(F.from_json(record, "map<string,variant>"))
    return F.transform(opened, lambda e: F.struct(clean_name(e["key"]).alias("field"), e["value"].alias("value")))


def _tag(value: object) -> str:
    if isinstance(value, bool):
        return "boolean"
    for kind, name in ((str, "string"), (int, "integer"), (float, "number"), (list, "array"), (dict, "object")):
        if isinstance(value, kind):
            return name
    return "null"


def tagged_paths(record: str | None) -> list[tuple[str, bool, str]]:
    """``(path, top, tag)`` of every value of a record, at any depth: fields joined by dots, ``[]`` for elements."""
    top = nested.parse(record)
    if not isinstance(top, dict):
        return []
    out, stack = [], [(_EDGES.sub("", k), True, v) for k, v in top.items()]
    while stack:
        path, own, value = stack.pop()
        out.append((path, own, _tag(value)))
        if isinstance(value, dict):
            stack += [(f"{path}.{k}", False, v) for k, v in value.items()]
        elif isinstance(value, list):
            stack += [(f"{path}[]", False, v) for v in value]
    return out


def tagged_union(rows: DataFrame, key_cols: list[str], record_col: str = "record") -> DataFrame:
    """``key_cols, path, top, tag, n``: how often each path has each alternative type; ``top`` are the record's own fields."""
    keys = rows.select(*key_cols).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            held = [batch.column(i).to_pylist() for i in range(len(key_cols))]
            for *key, text in zip(*held, batch.column(len(key_cols)).to_pylist()):
                for found in tagged_paths(text):
                    counts[(*key, *found)] += 1
            cols = list(zip(*counts)) if counts else [()] * (len(key_cols) + 3)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, batch.column(i).type) for i, c in enumerate(cols[:-3])], nested._strings(list(cols[-3])), pa.array(cols[-2], pa.bool_()), pa.array(cols[-1], pa.string()), pa.array(list(counts.values()), pa.int64())],
                [*key_cols, "path", "top", "tag", "n"],
            )

    schema = StructType([*keys.fields, *StructType.fromDDL("path string, top boolean, tag string, n bigint").fields])
    return rows.select(*key_cols, record_col).mapInArrow(run, schema).groupBy(*key_cols, "path", "top", "tag").agg(F.sum("n").alias("n"))


def file_fields(rows: DataFrame, file_cols: list[str], record_col: str = "record") -> DataFrame:
    """``file_cols, field, tag, n_values``: each field of each file with its main type, from its alternatives."""
    return _main_tags(tagged_union(rows, file_cols, record_col), file_cols)


def _main_tags(union: DataFrame, file_cols: list[str]) -> DataFrame:
    typed = F.col("tag") != "null"
    order = F.array_position(F.array(*[F.lit(t) for t in TAGS]), F.col("tag"))
    best = F.max(F.when(typed, F.struct("n", (-order).alias("o"), "tag")))
    tops = union.where("top")
    return tops.groupBy(*file_cols, F.col("path").alias("field")).agg(best.getField("tag").alias("tag"), F.coalesce(F.sum(F.when(typed, F.col("n"))), F.lit(0)).alias("n_values"))


def alternatives(rows: DataFrame, group_cols: list[str], file_col: str, time_col: str, record_col: str = "record") -> DataFrame:
    """The tagged union of each group: every path with each alternative type, where it first appears and how often it occurs."""
    counted = tagged_union(rows, [*group_cols, file_col, time_col], record_col)
    return counted.groupBy(*group_cols, F.col("path").alias("field"), "tag").agg(F.min(F.struct(time_col, file_col)).getField(file_col).alias("first_file"), F.sum("n").alias("n_values"))


def _profile_terms(value: Column, kind: Column) -> Column:
    """What a value adds to its field's profile: characters of text, magnitude of numbers."""
    text = F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value))
    size = F.concat(F.lit("len:"), F.floor(F.log2(F.length(text) + 1)).cast("string"))
    chars = F.concat(F.filter(F.split(F.lower(text), ""), lambda c: c != ""), F.array(size, size, size, size))
    number = F.abs(F.try_variant_get(value, "$", "double"))
    scale = F.floor(F.log2(number + 1))
    magnitude = F.array(*[F.concat(F.lit("mag:"), (scale + d).cast("string")) for d in (-1, 0, 1)])
    # true and false are worded in many ways; other wording is no other content
    word = F.lower(F.trim(text))
    flag = F.when(word.isin(YES), F.array(*map(F.lit, ("flag", "flag", "yes")))).when(word.isin(NO), F.array(*map(F.lit, ("flag", "flag", "no"))))
    chars = F.coalesce(F.when(kind == "string", flag), chars)
    return F.when(kind == "boolean", F.array(F.lit("boolean"))).when(kind.isin("integer", "number"), magnitude).otherwise(chars)


def changes(
    rows: DataFrame, group_cols: list[str], kind_col: str, file_col: str, time_col: str, record_col: str = "record", same_content: float = SAME_CONTENT
) -> DataFrame:
    """``file_col, change_kind, old_field, new_field`` of each file against the one before it in its group.

    ``kind_col``, one of ``group_cols``, says which files share a schema.
    """
    fields = checkpointed(file_fields(rows, [*group_cols, file_col], record_col))  # of the size of all schemas
    order = Window.partitionBy(*group_cols).orderBy(time_col, file_col)
    # a file that has rows but no readable record still has its place
    files = rows.groupBy(*group_cols, file_col).agg(F.min(time_col).alias(time_col)).withColumn("_before", F.lag(file_col).over(order)).where("_before is not null")
    files = checkpointed(files.select(*group_cols, F.col(file_col).alias("_file"), "_before"))
    now = files.join(fields.withColumnRenamed(file_col, "_file"), [*group_cols, "_file"]).select(*group_cols, "_file", "_before", "field", F.col("tag").alias("new_tag"), F.lit(True).alias("_in_new"))
    past = files.join(fields.withColumnRenamed(file_col, "_before"), [*group_cols, "_before"]).select(*group_cols, "_file", "_before", "field", F.col("tag").alias("old_tag"), F.lit(True).alias("_in_old"))
    diff = now.join(past, [*group_cols, "_file", "_before", "field"], "full_outer").where("_in_old is null or _in_new is null or old_tag <> new_tag")
    diff = checkpointed(diff)

    gone = diff.where("_in_new is null").select(*group_cols, "_file", "_before", F.col("field").alias("old_field"), F.col("old_tag").alias("tag"))
    came = diff.where("_in_old is null").select(*group_cols, "_file", "_before", F.col("field").alias("new_field"), F.col("new_tag").alias("tag"))
    pairs = gone.join(came, [*group_cols, "_file", "_before", "tag"])
    # names that stand side by side anywhere in the same kind of file are two fields
    names = pairs.select(kind_col, "old_field", "new_field").distinct()
    beside = fields.select(kind_col, file_col, "field")
    both = names.join(beside.withColumnRenamed("field", "old_field"), [kind_col, "old_field"]).join(beside.withColumnRenamed("field", "new_field"), [kind_col, file_col, "new_field"], "left_semi")
    pairs = checkpointed(pairs.join(both.select(kind_col, "old_field", "new_field").distinct(), [kind_col, "old_field", "new_field"], "left_anti"))

    ends = pairs.select(*group_cols, F.explode(F.array(F.struct(F.col("_before").alias("f"), F.col("old_field").alias("field"), "tag"), F.struct(F.col("_file").alias("f"), F.col("new_field").alias("field"), "tag"))).alias("_x"))
    ends = ends.select(*group_cols, F.col("_x.f").alias(file_col), "_x.field", "_x.tag").distinct()
    opened = rows.join(ends.select(*group_cols, file_col).distinct(), [*group_cols, file_col], "left_semi").select(*group_cols, file_col, F.explode(entries(F.col(record_col))).alias("_e")).select(*group_cols, file_col, "_e.field", "_e.value")
    terms = opened.join(ends, [*group_cols, file_col, "field"]).where(tag(F.col("value")) == F.col("tag")).select(*group_cols, file_col, "field", F.explode(_profile_terms(F.col("value"), F.col("tag"))).alias("term"))
    # the square root keeps the few commonest characters from deciding alone
    profile = terms.groupBy(*group_cols, file_col, "field", "term").agg(F.sqrt(F.count("*").cast("double")).alias("w"))
    norm = profile.groupBy(*group_cols, file_col, "field").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    profile = profile.join(norm, [*group_cols, file_col, "field"]).select(*group_cols, file_col, "field", "term", (F.col("w") / F.col("norm")).alias("w"))
    old = profile.select(*group_cols, F.col(file_col).alias("_before"), F.col("field").alias("old_field"), "term", F.col("w").alias("_wo"))
    new = profile.select(*group_cols, F.col(file_col).alias("_file"), F.col("field").alias("new_field"), "term", F.col("w").alias("_wn"))
    sims = pairs.join(old, [*group_cols, "_before", "old_field"]).join(new, [*group_cols, "_file", "new_field", "term"])
    sims = sims.groupBy(*group_cols, "_file", "old_field", "new_field").agg(F.sum(F.col("_wo") * F.col("_wn")).alias("sim"))
    sims = checkpointed(pairs.select(*group_cols, "_file", "old_field", "new_field").join(sims, [*group_cols, "_file", "old_field", "new_field"], "left").withColumns({"_x": F.least("old_field", "new_field"), "_y": F.greatest("old_field", "new_field")}))
    # a few values say little: names that are one field in other steps are one here
    known = sims.where(F.col("sim") >= same_content).groupBy(kind_col, "_x", "_y").agg(F.count("*").alias("_k")).where(F.col("_k") >= KNOWN_RENAMES)
    alike = sims.join(known, [kind_col, "_x", "_y"], "left").where((F.col("sim") >= same_content) | F.col("_k").isNotNull())
    alike = alike.select(*group_cols, "_file", "old_field", "new_field", F.greatest(F.coalesce("sim", F.lit(0.0)), F.when(F.col("_k").isNotNull(), same_content).otherwise(0.0)).alias("sim"))
    by_old = Window.partitionBy(*group_cols, "_file", "old_field").orderBy(F.desc("sim"), "new_field")
    by_new = Window.partitionBy(*group_cols, "_file", "new_field").orderBy(F.desc("sim"), "old_field")
    renamed = alike.withColumns({"_a": F.row_number().over(by_old), "_b": F.row_number().over(by_new)}).where("_a = 1 and _b = 1")
    renamed = renamed.select(*group_cols, "_file", "old_field", "new_field")

    added = came.join(renamed, [*group_cols, "_file", "new_field"], "left_anti").select("_file", F.lit("added").alias("change_kind"), F.lit("").alias("old_field"), "new_field")
    removed = gone.join(renamed, [*group_cols, "_file", "old_field"], "left_anti").select("_file", F.lit("removed").alias("change_kind"), "old_field", F.lit("").alias("new_field"))
    retyped = diff.where("_in_old and _in_new").select("_file", F.lit("retyped").alias("change_kind"), F.col("field").alias("old_field"), F.col("field").alias("new_field"))
    out = added.unionByName(removed).unionByName(retyped).unionByName(renamed.select("_file", F.lit("renamed").alias("change_kind"), "old_field", "new_field"))
    return out.withColumnRenamed("_file", file_col)


def field_names(found: DataFrame, fields: DataFrame, file_col: str = "file_id") -> dict[str, list[str]]:
    """Canonical name -> all names of a field, from the renames found.

    Names joined by renames, the commonest renames first, are one field unless any
    two of them stand in one file; the commonest name is canonical.  Only names and
    pairs of names come to the driver, never rows.
    """
    count = {r["field"]: r["n"] for r in fields.groupBy("field").agg(F.count("*").alias("n")).limit(MAX_FIELDS + 1).collect()}
    if len(count) > MAX_FIELDS:
        raise ValueError("the records use data as field names")
    renames = found.where("change_kind = 'renamed'").groupBy(F.least("old_field", "new_field").alias("a"), F.greatest("old_field", "new_field").alias("b")).agg(F.count("*").alias("n"))
    renames = checkpointed(renames)
    names = renames.select(F.explode(F.array("a", "b")).alias("field")).distinct()
    own = fields.join(names, "field").select(file_col, "field")
    met = own.withColumnRenamed("field", "a").join(own.withColumnRenamed("field", "b"), file_col).where("a < b").select("a", "b").distinct()
    apart = {(r["a"], r["b"]) for r in met.collect()}
    group = {f: [f] for f in count}
    for r in sorted(renames.collect(), key=lambda r: (-r["n"], r["a"], r["b"])):
        x, y = group[r["a"]], group[r["b"]]
        if x is not y and not any((min(a, b), max(a, b)) in apart for a in x for b in y):
            x += y
            group.update({f: x for f in y})
    once = {id(g): sorted(g, key=lambda f: (-count[f], f)) for g in group.values()}
    return {names[0]: names for names in sorted(once.values(), key=lambda g: (-count[g[0]], g[0]))}


def _typed(value: Column, others: Column, main: str) -> Column:
    """A variant as typed branches with its tag and, by the field's main type, one canonical value."""
    kind = tag(value)
    text = F.try_variant_get(value, "$", "string")
    inner = F.coalesce(
        F.when(kind == "array", F.try_variant_get(value, "$[0]", "string")),
        F.when(kind == "object", F.element_at(F.filter(F.transform(F.map_entries(F.from_json(F.to_json(value), "map<string,variant>")), lambda e: F.when(F.schema_of_variant(e["value"]) == "STRING", e["value"].cast("string"))), lambda x: x.isNotNull()), 1)),
        text,
    )
    word = F.lower(F.trim(inner))
    canonical = {
        "boolean": F.when(word.isin(YES), "true").when(word.isin(NO), "false"),
        "integer": F.coalesce(F.when(word.rlike(r"^[+-]?\d+$"), word.try_cast("decimal(38,0)").cast("string")), F.when(word.try_cast("double").isNotNull(), word)),
        "number": F.when(word.endswith("%"), F.regexp_replace(word, "%$", "").try_cast("double") / 100).otherwise(word.try_cast("double")).cast("string"),
    }.get(main, inner)
    return F.struct(
        kind.alias("tag"),
        F.when(kind == "boolean", F.try_variant_get(value, "$", "boolean")).alias("as_boolean"),
        F.when(kind == "integer", F.try_variant_get(value, "$", "decimal(38,0)")).alias("as_integer"),
        F.when(kind == "number", F.try_variant_get(value, "$", "double")).alias("as_number"),
        F.when(kind == "string", text).alias("as_string"),
        F.when(kind.isin("array", "object"), F.to_json(value)).alias("as_json"),
        canonical.alias("canonical"),
        others.alias("others"),
    )


def unified(rows: DataFrame, key_cols: list[str], names: dict[str, list[str]], main: dict[str, str], record_col: str = "record") -> DataFrame:
    """One consistent table: ``key_cols`` and for each canonical field a struct of typed branches."""
    opened = rows.select(*key_cols, entries(F.col(record_col)).alias("_e"))
    cols = []
    for name, spellings in names.items():
        own = F.filter("_e", lambda e: e["field"].isin(spellings) & tag(e["value"]).isNotNull())
        others = F.transform(F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0))), lambda e: F.to_json(e["value"]))
        cols.append(_typed(F.get(own, F.lit(0)).getField("value"), others, main.get(name, "string")).alias(name))
    return opened.select(*key_cols, *cols)


def main_types(fields: DataFrame, names: dict[str, list[str]]) -> dict[str, str]:
    """The commonest type of each canonical field over all files."""
    of = {f: n for n, fs in names.items() for f in fs}
    total: dict[str, dict[str, int]] = {}
    for r in fields.where("tag is not null").groupBy("field", "tag").agg(F.count("*").alias("n")).limit(len(TAGS) * MAX_FIELDS).collect():
        t = total.setdefault(of[r["field"]], {})
        t[r["tag"]] = t.get(r["tag"], 0) + r["n"]
    return {n: max(t, key=lambda k: (t[k], -TAGS.index(k))) for n, t in total.items()}
