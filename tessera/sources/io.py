"""Text-first readers and writers: TSV, headerless lists, FASTA, JSON lines, gzip annotations, id lists."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import set_hash  # noqa: F401  (re-exported for callers that lock an input)
from tessera.operators import guards
from tessera.operators.quality import equal_tables, fingerprint, unique_key
from tessera.sources.tables import move, remove


class InputError(ValueError):
    """An input breaks its contract."""


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A TSV with header, every column text, blanks kept as ''. Columns are checked against the header when rows are read."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.schema(schema).csv(path, sep="\t", header=True, quote='"', escape='"', enforceSchema=False, mode="FAILFAST")
    return raw.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def read_unique_tsv(spark: SparkSession, path: str, columns: list[str], key: str) -> DataFrame:
    """read_tsv with a key that must be unique and not blank."""
    df = read_tsv(spark, path, columns)
    if bad := unique_key(df, key, "key").first()["violations"]:
        raise InputError(f"{path}: {bad} blank or repeated keys in {key}")
    return df


def read_headerless(spark: SparkSession, path: str, fields: dict[str, int], least: int, comment: str | None = None, strict: bool = False) -> DataFrame:
    """Fields of a headerless TSV by position; lines with fewer than ``least`` fields are skipped, or an error if strict.

    Keeps the line's place as (file, block, line_no) for first- and last-wins rules; gzip is read by one task a file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"))
    lines = lines.filter(F.trim("value") != "")
    if comment:
        lines = lines.filter(~F.col("value").startswith(comment))
    parts = F.split("value", "\t", -1)
    if strict and (bad := lines.filter(F.size(parts) < least).limit(1).collect()):
        raise InputError(f"{path}: a line has fewer than {least} fields: {bad[0]['value'][:80]}")
    return lines.filter(F.size(parts) >= least).select(*[parts[i].alias(n) for n, i in fields.items()], "file", "block", "line_no")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """The first two fields of a headerless TSV; a shorter line is an error."""
    return read_headerless(spark, path, {"id1": 0, "id2": 1}, 2, strict=True)


#: The columns that hold the ids of a table, where none is named.
ID_COLUMNS = ("accession", "candidate_accession", "Entry")


def _unique_ids(ids: DataFrame, path: str) -> DataFrame:
    n, distinct, tabs = ids.agg(F.count("*"), F.count_distinct("id"), F.count_if(F.col("id").contains("\t"))).first()
    if not n or n != distinct or tabs:
        raise InputError(f"{path}: {n} ids, {n - distinct} repeated, {tabs} with tabs")
    return ids


def read_ids(spark: SparkSession, path: str, place: bool = False) -> DataFrame:
    """One id a line; a tab inside a line, a repeated id or an empty file is an error. ``place`` orders the ids as they stand: by file, block and line."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path)
    ids = lines.select(F.trim("value").alias("id"), at.alias("place")) if place else lines.select(F.trim("value").alias("id"))
    return _unique_ids(ids.filter("id <> ''"), path)


def read_table_ids(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """The ids of a TSV with header: of the named column, or of the one of ``ID_COLUMNS`` that it has; none or two of these, a repeated id or no id is an error."""
    raw = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"')
    if column is None:
        found = [c for c in ID_COLUMNS if c in raw.columns]
        if len(found) != 1:
            raise InputError(f"{path}: the id column is not clear: {found}")
        column = found[0]
    if column not in raw.columns:
        raise InputError(f"{path}: no column {column}")
    return _unique_ids(raw.select(F.trim(column).alias("id")).filter("id <> ''"), path)


def fasta_accession(header: Column) -> Column:
    """The second '|' field after sp or tr, else the first token before '|'."""
    first = F.split(header, r"\s+")[0]
    parts = F.split(first, r"\|")
    return F.when(parts[0].isin("sp", "tr") & (F.size(parts) > 1), F.try_element_at(parts, F.lit(2))).otherwise(parts[0])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """accession, header, sequence; sequences may span lines; a sequence before the first header or a repeated id is an error."""
    records = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("r"), F.col("value").startswith(">").alias("first"), F.col("_metadata.file_block_start").alias("at"))
    split = F.split("r", "\r?\n", 2)
    out = records.filter(F.trim("r") != "").select(F.trim(split[0]).alias("header"), F.upper(F.regexp_replace(F.coalesce(F.try_element_at(split, F.lit(2)), F.lit("")), r"\s|^>", "")).alias("sequence"))
    out = out.select(fasta_accession(F.col("header")).alias("accession"), "header", "sequence")
    if bad := unique_key(out, "accession", "fasta").first()["violations"]:
        raise InputError(f"{path}: {bad} blank or repeated accessions")
    return out


def read_fasta_ids(spark: SparkSession, path: str) -> DataFrame:
    """The accession of every record, in no order; sequences are not kept."""
    return spark.read.text(path).filter(F.col("value").startswith(">")).select(fasta_accession(F.substring("value", 2, 1_000_000)).alias("accession"))


def fasta_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).filter(F.col("value").startswith(">")).count()


def read_jsonl_last(spark: SparkSession, path: str, schema: str, key: str, order: str | None = None) -> DataFrame:
    """JSON lines, blank ones skipped; the last object of a key wins: by ``order``, a field, or else by file name and place in the file."""
    from tessera.operators.rank import first_per_key

    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()) if order is None else F.lit(0)
    lines = spark.read.text(path).select("value", place.alias("_at")).filter(F.trim("value") != "")
    rows = lines.select(F.from_json("value", schema).alias("o"), "_at").select("o.*", "_at")
    return first_per_key(rows, [key], [F.desc(order or "_at")]).drop("_at")


#: documents of a task
TASK_DOCUMENTS = 2_000


def write_json_documents(docs: DataFrame, path: str) -> None:
    """One file for each row (``value``, a JSON document). Files cost by their number, so tasks are dealt by it, and not by their few bytes."""
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // TASK_DOCUMENTS))
    docs.repartition(tasks).write.option("maxRecordsPerFile", 1).mode("errorifexists").text(path)


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType, required: str = "results") -> DataFrame:
    """One JSON object a file; a document without ``required`` fails the job that reads it, so every file is read once."""
    docs = spark.read.schema(schema).json(path, multiLine=True)
    return guards.require(docs, F.col(required).isNotNull(), f"a document lacks {required}")


def write_shards(df: DataFrame, key: str, path: str, length: int = 4) -> None:
    """Records in folders by the first characters of their key."""
    df.withColumn("prefix", F.substring(F.col(key).cast("string"), 1, length)).write.partitionBy("prefix").mode("errorifexists").parquet(path)


def read_shards(spark: SparkSession, path: str, key: str, wanted: DataFrame, length: int = 4) -> DataFrame:
    """The records of the keys in ``wanted`` (a column of the same name); only the folders of their prefixes are read."""
    k = wanted.select(F.col(key).cast("string").alias("_k"), F.substring(F.col(key).cast("string"), 1, length).alias("_p")).distinct()
    all_ = spark.read.option("basePath", path).parquet(path).withColumn("prefix", F.col("prefix").cast("string"))
    return all_.join(k, (F.col("prefix") == F.col("_p")) & (F.col(key).cast("string") == F.col("_k")), "left_semi")


def read_shard(spark: SparkSession, path: str, key: str, value: str, length: int = 4) -> DataFrame:
    """The records of one key; only its folder is read."""
    return spark.read.option("basePath", path).parquet(path).filter((F.col("prefix") == value[:length]) & (F.col(key).cast("string") == value))


def write_tsv(df: DataFrame, path: str, fields: list[str], extra: str = "ignore") -> None:
    """Fixed column order; extra columns are ignored or an error; never overwrites, and equal content is left alone."""
    if extra == "raise" and (more := [c for c in df.columns if c not in fields]):
        raise InputError(f"extra columns: {more}")
    write_once(df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in fields]), path, fields)


def write_once(df: DataFrame, path: str, fields: list[str]) -> None:
    """Write where nothing is; the same content again does nothing; other content is an error."""
    try:
        df.write.mode("errorifexists").csv(path, sep="\t", header=True, quote='"', escape='"', emptyValue="")
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        if equal_tables(read_tsv(df.sparkSession, path, fields), df, "same").first()["violations"]:
            raise InputError(f"{path} has other content") from e


def freeze(df: DataFrame, name: str, key: str, path: str) -> None:
    """Store a table's fingerprint, once; ``verify_frozen`` compares with it later."""
    fingerprint(df, name, key).write.mode("errorifexists").parquet(path)


def verify_frozen(df: DataFrame, name: str, key: str, path: str) -> DataFrame:
    """name, violations (0 if the table still has the stored fingerprint), frozen_rows, rows."""
    stored, now = df.sparkSession.read.parquet(path), fingerprint(df, name, key)
    pair = stored.select("name", F.struct("rows", "keys", "content").alias("a")).join(now.select("name", F.struct("rows", "keys", "content").alias("b")), "name", "full")
    return pair.select("name", (~F.col("a").eqNullSafe(F.col("b"))).cast("long").alias("violations"), F.col("a.rows").alias("frozen_rows"), F.col("b.rows").alias("rows"))


def fasta_text(header: Column, sequence: Column, width: int = 80) -> Column:
    """One FASTA record; width 0 keeps the sequence in one line."""
    body = F.regexp_replace(sequence, f"(.{{{width}}})(?=.)", "$1\n") if width else sequence
    return F.concat(F.lit(">"), header, F.lit("\n"), body)


def write_fasta(df: DataFrame, path: str, header: Column, sequence: str, width: int = 80) -> None:
    df.select(fasta_text(header, F.col(sequence), width).alias("value")).write.mode("errorifexists").text(path)


def write_ids(df: DataFrame, path: str, key: str, order: list[Column] | None = None) -> None:
    """Ids one a line, in the table's order given by the columns ``order`` (by key without): files read by name, line after line, give it."""
    by = order or [F.col(key)]
    df.repartitionByRange(*by).sortWithinPartitions(*by).select(F.col(key).cast("string")).write.mode("errorifexists").text(path)


def split_by_class(df: DataFrame, path: str, by: str, expected: dict[object, int] | None = None) -> None:
    """One folder for each class. With the expected count of each class, the job that writes counts too, and other counts (or another class) leave nothing behind."""
    if expected is None:
        return df.write.partitionBy(by).mode("errorifexists").parquet(path)
    spark, seen, attempt = df.sparkSession, Observation(), f"{path}-attempt-{uuid.uuid4().hex}"
    counts = [F.count_if(F.col(by).eqNullSafe(F.lit(c))).alias(f"n{i}") for i, c in enumerate(expected)]
    df.observe(seen, F.count("*").alias("rows"), *counts).write.partitionBy(by).parquet(attempt)
    found = {c: seen.get[f"n{i}"] for i, c in enumerate(expected)}
    if found != expected or seen.get["rows"] != sum(expected.values()):
        remove(spark, attempt)
        raise InputError(f"{path}: class counts differ: {found}, {seen.get['rows']} rows in all")
    move(spark, attempt, path)
    return None


def export_text(df: DataFrame) -> DataFrame:
    """A view's cells as text with tabs and line ends as spaces, null as ''."""
    return df.select(*[F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[\t\r\n]", " ").alias(c) for c in df.columns])


#: opens a text file so that spreadsheets read it as UTF-8
BOM = "\ufeff"


def write_export(df: DataFrame, path: str) -> None:
    """A view as TSV files for spreadsheets: each has the byte order mark and the header, and cells have no tabs or line ends."""
    text = export_text(df)
    text.toDF(BOM + text.columns[0], *text.columns[1:]).write.mode("errorifexists").csv(path, sep="\t", header=True, quote="", quoteAll=False, escape="\\", encoding="UTF-8", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def nested_summary(df: DataFrame, dataset: str, level: str, kind: str) -> DataFrame:
    """One JSON document of counts: for each data set its rows, and for each level its rows, their share of the data set's, and the rows of each class.

    One pass counts all grouping sets; the summary must be small (it is one value). Keys are sorted; blanks stand for null.
    """
    names = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((dataset, "d"), (level, "l"), (kind, "k"))])
    sets = names.groupingSets([[F.col("d")], [F.col("d"), F.col("l")], [F.col("d"), F.col("l"), F.col("k")]], "d", "l", "k").agg(F.count("*").alias("n"), F.grouping_id("d", "l", "k").alias("g"))
    by_key = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)
    entries = lambda key, value: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v"))), by_key))
    classes = sets.filter("g = 0").groupBy("d", "l").agg(entries("k", F.col("n")).alias("classes"))
    base = sets.filter("g = 3").select("d", F.col("n").alias("base"))
    levels = sets.filter("g = 1").select("d", "l", "n").join(classes, ["d", "l"]).join(base, "d")
    share = F.format_string("%.8f", F.col("n") / F.col("base"))
    folded = levels.groupBy("d", "base").agg(entries("l", F.struct("n", share.alias("share"), "classes")).alias("levels"))
    return folded.agg(F.to_json(entries("d", F.struct(F.col("base").alias("n"), "levels"))).alias("json"))


def json_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON document of a summary table with few rows: key -> value, sorted by key."""
    rows = F.array_sort(F.collect_list(F.struct(F.concat_ws("/", *keys).alias("key"), F.col("value").alias("value"))))
    return df.agg(F.to_json(F.map_from_entries(rows)).alias("json"))
