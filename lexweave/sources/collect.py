"""Collecting documents (id, text, source, pos) from folders of text files, JSON lines and delimited files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.functions.prefix import placed
from lexweave.functions.text import strip


def make_id(source: Column, index: Column, text: Column) -> Column:
    """Base name of the source with spaces as underscores, the index in eight digits, and 16 hex digits of the text's SHA-256."""
    base = F.regexp_replace(F.regexp_extract(source, "([^/]*)$", 1), " ", "_")
    return F.concat_ws("-", base, F.format_string("%08d", index), F.substring(F.sha2(text, 256), 1, 16))


def _documents(rows: DataFrame, source: Column) -> DataFrame:
    """Rows (pos, text) to documents; blank ones are dropped after they have taken a position."""
    out = rows.withColumn("text", strip(F.col("text"))).where(F.col("text") != "").withColumn("source", source)
    return out.select(make_id(F.col("source"), F.col("pos"), F.col("text")).alias("id"), "text", "source", "pos")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def decode_text(content: Column, encoding: str = "UTF-8") -> Column:
    """Bytes as text, latin-1 where they aren't valid; line ends become line feeds."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1")) if encoding.upper() == "UTF-8" else F.decode(content, encoding)
    return F.regexp_replace(text, "\r\n?", "\n")


def collect_directory(spark: SparkSession, path: str, pattern: str = "*.txt", source_name: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A document for each file that the pattern matches, in the order of paths; `**` searches subfolders too."""
    if not _exists(spark, path):
        raise NotADirectoryError(path)
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern.rsplit("/", 1)[-1]).option("recursiveFileLookup", "**" in pattern)
    files = reader.load(path).select("path", "content")
    rows = files.join(placed(files.select("path"), ["path"], None, "pos"), "path").select("pos", decode_text(F.col("content"), encoding).alias("text"))
    return _documents(rows, F.lit(source_name or path))


def _in_file_order(df: DataFrame) -> DataFrame:
    """df with pos: the rank of each row by file, block and place in its partition, by counts of partitions."""
    marked = df.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()})
    before = placed(marked.groupBy("_file", "_block").agg(F.count("*").alias("_n")), ["_file", "_block"], "_n", "_before")  # a row per block
    own = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_at"))
    return marked.join(before, ["_file", "_block"]).withColumn("pos", (F.col("_before") + own - 1).cast("long")).drop("_file", "_block", "_at", "_before")


def collect_jsonl(spark: SparkSession, path: str, text_field: str = "text", source_name: str | None = None, null_text: bool = False) -> DataFrame:
    """A document for each line; blank lines don't count. null_text: a JSON null is the text "None", else it is dropped."""
    lines = _in_file_order(spark.read.text(path).where(strip(F.col("value")) != ""))
    bad = lines.where(F.expr("try_parse_json(value) IS NULL")).limit(1).collect()
    if bad:
        raise ValueError(f"{path}: not JSON: {bad[0].value[:80]!r}")
    value = F.get_json_object("value", f"$['{text_field}']")
    has = F.array_contains(F.json_object_keys("value"), text_field)
    if lines.where(~F.coalesce(has, F.lit(False))).limit(1).count():
        raise KeyError(text_field)
    text = F.coalesce(value, F.lit("None")) if null_text else value
    return _documents(lines.select("pos", text.alias("text")), F.lit(source_name or path))


def collect_csv(spark: SparkSession, path: str, text_column: str = "text", delimiter: str = ",", source_name: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A document for each row of a delimited file with a header."""
    rows = spark.read.csv(path, header=True, sep=delimiter, multiLine=True, quote='"', escape='"', encoding=encoding, ignoreLeadingWhiteSpace=False)
    if text_column not in rows.columns:
        raise ValueError(f"no column {text_column}; there are {rows.columns}")
    return _documents(_in_file_order(rows).select("pos", F.col(text_column).alias("text")), F.lit(source_name or path))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; a line that isn't JSON ends the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_pairs(spark: SparkSession, path: str, fields: tuple[str, ...] = ("prompt", "response"), optional: tuple[str, ...] = ()) -> DataFrame:
    """Instruction rows whose required fields are there and not blank, else ValueError; at least one row."""
    df = read_jsonl(spark, path, ", ".join(f"{f} string" for f in (*fields, *optional)))
    fine = F.lit(True)
    for f in fields:
        fine = fine & (F.coalesce(strip(F.col(f)), F.lit("")) != "")
    n, bad = df.agg(F.count("*"), F.count_if(~fine)).first()
    if not n or bad:
        raise ValueError(f"{path}: {bad} of {n} rows lack one of {fields}")
    return df


def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    """input_ids and labels of equal lengths, else ValueError."""
    df = read_jsonl(spark, path, "input_ids array<int>, labels array<int>")
    n, bad = df.agg(F.count("*"), F.count_if(~F.coalesce(F.size("input_ids") == F.size("labels"), F.lit(False)))).first()
    if not n or bad:
        raise ValueError(f"{path}: {bad} of {n} rows are not valid")
    return df


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """item_id, question, choices, answer_index of the JSON lines of a multiple-choice benchmark, checked by evaluate.check_items; item_id is the line's rank."""
    from lexweave.operators.evaluate import check_items

    lines = _in_file_order(spark.read.text(path).where(strip(F.col("value")) != ""))
    item = F.from_json("value", "question string, choices array<string>, answer_index int", {"mode": "FAILFAST"})
    return check_items(lines.select(F.col("pos").alias("item_id"), item.alias("item")).select("item_id", "item.*"))


def synthetic_corpus(spark: SparkSession, sentences: list[str], repeats: int = 400, seed: int = 0) -> DataFrame:
    """pos, text: every sentence once in each of `repeats` rounds, in an order of its own by a seeded hash."""
    if not sentences or repeats <= 0:
        raise ValueError("there must be sentences and rounds")
    order = lambda r, k: F.md5(F.concat_ws("-", F.lit(seed), r, k))
    listed = F.transform(F.array(*map(F.lit, sentences)), lambda s, k: F.struct(order(F.col("id"), k).alias("o"), s.alias("text")))
    return spark.range(repeats).select("id", F.posexplode(F.array_sort(listed)).alias("k", "x")).select((F.col("id") * len(sentences) + F.col("k")).alias("pos"), "x.text")
