"""Readers and writers: delimited text, Parquet, JSON, folders, record lists, versions, exports and hand-offs."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_delimited(
    spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, encoding: str = "utf-8", date_format: str | None = None,
    text_columns: list[str] | None = None, source_column: str | None = None, dayfirst: bool = True,
) -> DataFrame:
    """CSV or TSV with inferred types; ``text_columns`` stay text, day-first dates are found by ``sniff_dayfirst``."""
    reader = spark.read.option("sep", delimiter).option("header", header).option("encoding", encoding).option("multiLine", True)
    raw = reader.option("inferSchema", False).csv(path)
    kept = set(text_columns or [])
    typed = reader.option("inferSchema", True)
    typed = typed.option("dateFormat", date_format) if date_format else typed
    inferred = typed.csv(path).schema
    out = raw.select(*[F.col(f"`{f.name}`") if f.name in kept else F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in inferred.fields])
    if date_format:
        for f in inferred.fields:
            if isinstance(f.dataType, T.DateType):
                out = out.withColumn(f.name, F.to_date(raw[f.name], date_format))
    out = out if not dayfirst else parse_dayfirst(out, [f.name for f in inferred.fields if isinstance(f.dataType, T.StringType) and f.name not in kept])
    return out.withColumn(source_column, F.col("_metadata.file_path")) if source_column else out


NUMBER = r"^[+-]?(\d{1,3}([.,]\d{3})+|\d+)([.,]\d+)?$"


def normalise_numbers(df: DataFrame, decimal: str | None = None) -> DataFrame:
    """Text columns of comma-decimal numbers become doubles: all non-blank values must look like numbers and one must show a
    decimal comma; with a declared mark at least 90 % must be castable.  One aggregation decides for all columns."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df

    def plain(c: str, mark: str) -> Column:
        s = F.trim(c)
        return F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")) if mark == "," else F.replace(s, F.lit(","), F.lit(""))

    made = []
    for c in texts:
        s = F.trim(c)
        some = F.count_if(s != "")
        made += [
            (F.count_if((s != "") & ~s.rlike(NUMBER)) == 0).alias(f"{c}__all"), (F.count_if(s.rlike(r",\d{1,2}$|,\d{4,}$")) > 0).alias(f"{c}__evidence"),
            (F.count_if((s != "") & plain(c, decimal or ",").try_cast("double").isNotNull()) >= 0.9 * some).alias(f"{c}__most"), (some > 0).alias(f"{c}__some"),
        ]
    r = df.agg(*made).first()
    for c in texts:
        if r[f"{c}__some"] and (r[f"{c}__most"] if decimal else r[f"{c}__all"] and r[f"{c}__evidence"]):
            df = df.withColumn(c, plain(c, decimal or ",").try_cast("double"))
    return df


def sniff_dayfirst(df: DataFrame, column: str) -> str | None:
    """dd/MM/yyyy or MM/dd/yyyy by tokens over 12 among all values; mixed evidence or a value of another form: none."""
    few = df.select(F.col(column).alias("v")).where("v is not null")
    a, b = (F.regexp_extract("v", r"^\s*(\d{1,2})[/.-](\d{1,2})[/.-]\d{4}", i).try_cast("int") for i in (1, 2))
    r = few.agg(F.count("*").alias("n"), F.count(a).alias("k"), F.count_if(a > 12).alias("day"), F.count_if(b > 12).alias("month")).first()
    if not r.n or r.k < r.n or (r.day and r.month):
        return None
    return "dd/MM/yyyy" if r.day else "MM/dd/yyyy" if r.month else None


def parse_dayfirst(df: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        fmt = sniff_dayfirst(df, c)
        if fmt:
            df = df.withColumn(c, F.try_to_timestamp(F.regexp_replace(F.trim(c), "[.-]", "/"), F.lit(fmt)).cast("date"))
    return df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def flatten(df: DataFrame, depth: int = 2) -> DataFrame:
    """Lists of objects exploded and objects spread into ``a_b`` columns, ``depth`` times; name clashes keep the column nested."""
    for _ in range(depth):
        for f in df.schema.fields:
            if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                df = df.withColumn(f.name, F.explode_outer(f.name))
        cols = []
        for f in df.schema.fields:
            inner = [f"{f.name}_{g.name}" for g in f.dataType.fields] if isinstance(f.dataType, T.StructType) else []
            if inner and not set(inner) & set(df.columns):
                cols += [F.col(f"`{f.name}`.`{g.name}`").alias(n) for g, n in zip(f.dataType.fields, inner)]
            else:
                cols.append(F.col(f"`{f.name}`"))
        df = df.select(*cols)
    return df


def read_json(spark: SparkSession, path: str, flat: bool = False, lines: bool = True) -> DataFrame:
    df = spark.read.option("multiLine", not lines).json(path)
    return flatten(df) if flat else df


def read_folder(spark: SparkSession, path: str, glob: str = "*.csv", source_column: str = "source_file") -> DataFrame:
    """All files of one kind, columns by name, what a file lacks is null; the file's name is a column."""
    kind = glob.rsplit(".", 1)[-1]
    reader = spark.read.option("pathGlobFilter", glob)
    if kind in ("csv", "tsv", "txt"):
        # files with one header are one read: only the first lines are looked at before
        sep, groups = "\t" if kind == "tsv" else ",", {}
        # a header may hold quoted separators; a file's first line is the one at its first byte
        lines = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path)
        block = F.col("_metadata.file_block_start")
        heads = lines.where(block == 0).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.first("value").alias("head"))
        heads = heads.groupBy("head").agg(F.array_sort(F.collect_list("path")).alias("paths")).orderBy("head")
        for r in heads.toLocalIterator():  # a row a header
            groups[r.head] = [unquote(p) for p in r.paths]
        reads = [spark.read.option("sep", sep).option("header", True).csv(files).withColumn(source_column, F.col("_metadata.file_name")) for files in groups.values()]
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), reads)
    df = reader.json(path) if kind in ("json", "ndjson", "jsonl") else reader.option("mergeSchema", True).parquet(path)
    return df.withColumn(source_column, F.col("_metadata.file_name"))


def find_list(schema: T.DataType, depth: int = 4, at: tuple[str, ...] = ()) -> tuple[str, ...] | None:
    """Path of the first list of objects, at most ``depth`` names deep."""
    if isinstance(schema, T.StructType) and len(at) < depth:
        for f in schema.fields:
            if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                return (*at, f.name)
        for f in schema.fields:
            found = find_list(f.dataType, depth, (*at, f.name))
            if found:
                return found
    return None


def read_records(df: DataFrame, list_path: str | None = None, epoch_columns: list[str] = ()) -> DataFrame:
    """Rows of a record list inside JSON answers: nested objects as ``a_b`` columns, lists as JSON text, epochs as timestamps."""
    path = tuple(list_path.split(".")) if list_path else find_list(df.schema)
    rows = df.select(F.explode_outer(".".join(f"`{p}`" for p in path)).alias("r")).select("r.*") if path else df
    while any(isinstance(f.dataType, T.StructType) for f in rows.schema.fields):
        cols = []
        for f in rows.schema.fields:
            if isinstance(f.dataType, T.StructType):
                cols += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}_{g.name}") for g in f.dataType.fields]
            else:
                cols.append(F.col(f"`{f.name}`"))
        rows = rows.select(*cols)
    out = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType)) else F.col(f"`{f.name}`") for f in rows.schema.fields]
    rows = rows.select(*out)
    return rows.withColumns({c: F.timestamp_seconds(F.col(c)) for c in epoch_columns})


#: Types that hold all values of two others.
WIDER = {frozenset(("bigint", "double")): "double", frozenset(("bigint", "decimal")): "double", frozenset(("decimal", "double")): "double"}


def _settled(kinds: set[str]) -> str:
    """One type for all values of a column; numbers of several types are doubles, whatever else is mixed is text."""
    kinds = kinds - {"void"} or {"string"}
    while len(kinds) > 1:
        a, b, *more = sorted(kinds)
        kinds = {WIDER.get(frozenset((a, b)), "string"), *more}
    kind = kinds.pop()
    return "string" if kind.startswith(("array", "object", "struct", "variant")) else "double" if kind == "decimal" else kind


def read_mixed_records(df: DataFrame, column: str, epoch_columns: list[str] = (), derive: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Columns of JSON objects in a text column whose fields differ from row to row in presence and type.

    Rows become VARIANT values; their fields, nested ones as ``a_b``, and the types that each has anywhere come from one aggregation over all
    rows a level of nesting.  A field of one type keeps it, whole and broken numbers are doubles, other mixtures and lists are their JSON text.  Rows that are no
    JSON object are null in all columns.  ``epoch_columns`` are seconds since 1970; ``derive`` names day counts from one number of seconds to another."""
    rows = df.select(F.try_parse_json(column).alias("v"))
    members = lambda x: F.explode(F.expr(f"map_entries(try_cast({x} as map<string, variant>))")).alias("e")
    level = rows.select(members("v")).select(F.array("e.key").alias("path"), F.col("e.value").alias("value"))
    kinds: dict[tuple[str, ...], set[str]] = {}
    while True:  # a turn a level of nesting
        told = F.lower(F.regexp_extract(F.schema_of_variant("value"), "^[A-Za-z]+", 0))
        seen = level.groupBy("path", told.alias("kind")).agg(F.count("*").alias("n")).collect()  # a row a field and type
        for r in sorted(seen, key=lambda r: (list(r.path), r.kind)):
            kinds.setdefault(tuple(r.path), set()).add(r.kind)
        if not any(r.kind == "object" for r in seen):
            break
        level = level.where(told == "object").select("path", members("value")).select(F.concat("path", F.array("e.key")).alias("path"), F.col("e.value").alias("value"))
    cols = []
    for p in sorted(p for p, k in kinds.items() if k - {"object", "void"} or k == {"void"}):  # what is an object everywhere has only its fields
        at = "$" + "".join('["' + x.replace("\\", "\\\\").replace('"', '\\"') + '"]' for x in p)
        kind = _settled(kinds[p])
        cols.append(F.try_variant_get("v", at, kind).alias("_".join(p)))
    out = rows.select(*cols)
    days = {name: F.round((F.col(b) - F.col(a)) / 86400.0, 1) for name, (a, b) in (derive or {}).items()}
    return out.withColumns(days | {c: F.timestamp_seconds(F.col(c)) for c in epoch_columns}) if days or epoch_columns else out


def write_output(df: DataFrame, extra: DataFrame, key: list[str]) -> DataFrame:
    """Model output beside its input by the row key; carried columns keep their types."""
    return df.join(extra, key, "left")


def export(df: DataFrame, fmt: str, path: str) -> None:
    writer = df.write.option("header", True) if fmt == "csv" else df.write
    getattr(writer, fmt)(path)


def handoff(df: DataFrame, order_by: list[str], columns: list[str] | None = None, filter: str | None = None, limit: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(rows, print): the first rows in an order (at most 2000) and the SHA-256 of their JSON lines."""
    rows = (df.where(F.expr(filter)) if filter else df).select(*(columns or df.columns)).orderBy(*order_by).limit(min(limit, 2000))
    line = F.to_json(F.struct(*rows.columns))
    item = F.struct(*[F.col(c) for c in order_by if c in rows.columns], line.alias("_line"))
    prints = rows.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_line"]), "\n"), 256).alias("sha256"), F.count("*").alias("rows"))
    return rows, prints
