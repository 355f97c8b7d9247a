"""Scans of raw post files, lexicons and file-name metadata."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberscope.functions.scores import discretise_polarity
from emberscope.sources.csv_records import read_records
from emberscope.schemas import FILE_SUFFIXES, HEADER_KEYS, RAW_POST_SCHEMA

CORRUPT = "_corrupt"


def file_topic(path: Column) -> Column:
    """Topic folder of a file: the last folder of its path (``topic=`` prefix allowed)."""
    folder = F.url_decode(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))
    return F.regexp_replace(folder, "^topic=", "")


def read_raw_posts(
    spark: SparkSession,
    paths: str | Sequence[str],
    recursive: bool = True,
    multi_line: bool = True,
    keep_bad_rows: bool = False,
    schema: T.StructType = RAW_POST_SCHEMA,
    header: bool = True,
    glob: str = "*.csv",
) -> DataFrame:
    """Raw post CSVs as text columns, with topic, source file and row position.

    Lines starting with ``#`` are dropped and quoted text may span lines.
    Files may have other columns than each other: with ``header`` the first
    line of each file that is no comment names them, and a column of
    ``schema`` that a file lacks is null.  Rows with too few fields are filled
    with nulls.  Rows with surplus fields are dropped, or kept with
    ``bad_row`` set and their text in ``_corrupt``.  The topic is the folder
    below the given path.  Large files are read by many tasks; ``multi_line``
    is needed for text that spans lines, and takes one more pass over the lines.
    """
    roots = [paths] if isinstance(paths, str) else list(paths)
    if multi_line:
        records, blocks = read_records(spark, roots, recursive, glob)
        return _parsed(records, blocks, roots, schema, header, keep_bad_rows)
    options = {
        "header": str(header).lower(),
        "comment": "#",
        "escape": '"',
        "recursiveFileLookup": str(recursive).lower(),
        "pathGlobFilter": glob,
        "columnNameOfCorruptRecord": CORRUPT,
        "mode": "PERMISSIVE",
        # A pruned parse would not notice surplus fields.
        "columnPruning": "false",
    }
    variants = _header_variants(spark, roots, recursive, glob) if header else []

    def read(names: Sequence[str], files: Sequence[str]) -> DataFrame:
        raw = spark.read.options(**options).schema(_fields(names)).csv(list(files))
        # Dropping by mode would depend on the columns a query reads, and a test of the
        # corrupt column alone is refused; the test therefore reads a data column too.
        some_column = F.coalesce(F.col(f"`{names[0]}`"), F.lit(""))
        return raw.select(
            *_wanted(names, schema),
            CORRUPT,
            (_surplus(names) | (some_column == "\0")).alias("bad_row"),
            topic_below(F.col("_metadata.file_path"), roots).alias("topic"),
            F.col("_metadata.file_name").alias("source_file"),
            F.col("_metadata.file_path").alias("source_path"),
            F.col("_metadata.file_block_start").alias("file_offset"),
            F.monotonically_increasing_id().alias("row_pos"),
        )

    if len(variants) > 1:
        located = reduce(DataFrame.unionByName, [read(names, files) for names, files in variants])
    else:
        located = read(variants[0][0] if variants else [f.name for f in schema.fields], roots)
    return located if keep_bad_rows else located.filter(~F.col("bad_row")).drop("bad_row", CORRUPT)


def _fields(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])


def _wanted(names: Sequence[str], schema: T.StructType, row: str = "") -> list[Column]:
    """The columns of ``schema`` from a row that has those of ``names``."""
    return [
        (F.col(f"{row}`{f.name}`") if f.name in names else F.lit(None).cast("string")).alias(f.name) for f in schema.fields
    ]


def _surplus(names: Sequence[str], corrupt: str = CORRUPT) -> Column:
    outside_quotes = F.regexp_replace(corrupt, r'"(?:[^"]|"")*+"', "")
    return F.coalesce(F.regexp_count(outside_quotes, F.lit(",")) >= len(names), F.lit(False))


def _header_names(line: str) -> list[str]:
    return [n.strip().strip('"') for n in line.split(",")]


def _parsed(
    records: DataFrame, blocks: DataFrame, roots: Sequence[str], schema: T.StructType, header: bool, keep_bad_rows: bool
) -> DataFrame:
    """Records to posts.  The files' headers differ little, so each distinct one is known to the driver."""
    text = F.regexp_replace("record", "^\ufeff", "")
    rows = records.withColumn("record", text).filter(~F.col("record").startswith("#") & (F.trim("record") != ""))
    heads = {None: [f.name for f in schema.fields]}
    if header:
        first = blocks.filter("header IS NOT NULL").select(F.col("path").alias("_path"), "header", "header_line")
        heads = {r["header"]: _header_names(r["header"]) for r in first.select("header").distinct().orderBy("header").collect()}
        below = (F.col("block") > 0) | (F.col("line") > F.col("header_line"))
        rows = rows.join(first, F.col("path") == F.col("_path")).filter(below)
    options = {"escape": '"', "columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"}
    parts = []
    for head, names in heads.items():
        own = rows.filter(F.col("header") == head) if len(heads) > 1 else rows
        kinds = ", ".join(f"`{f.name}` STRING" for f in _fields(names).fields)
        row = F.from_csv("record", kinds, options)
        parts.append(
            own.withColumn("_row", row).select(
                *_wanted(names, schema, "_row."),
                F.col(f"_row.{CORRUPT}").alias(CORRUPT),
                _surplus(names, f"_row.{CORRUPT}").alias("bad_row"),
                topic_below(F.col("path"), roots).alias("topic"),
                F.url_decode(F.regexp_extract("path", r"([^/]+)$", 1)).alias("source_file"),
                F.col("path").alias("source_path"),
                F.col("block").alias("file_offset"),
                F.col("line").alias("row_pos"),
            )
        )
    if not parts:  # no file has a line
        return _parsed(records, blocks, roots, schema, False, keep_bad_rows)
    located = reduce(DataFrame.unionByName, parts)
    return located if keep_bad_rows else located.filter(~F.col("bad_row")).drop("bad_row", CORRUPT)


def topic_below(path: Column, roots: Sequence[str]) -> Column:
    """Folder of a file directly below one of ``roots``; its last folder if it lies in none of them deeper."""
    found = []
    for root in roots:
        place = re.escape(re.sub(r"^[a-z0-9]+:(//[^/]*)?", "", root).rstrip("/"))
        folder = F.regexp_extract(F.url_decode(path), rf"^(?:[a-z0-9]+:(?://[^/]*)?)?{place}/([^/]+)/", 1)
        found.append(F.nullif(F.regexp_replace(folder, "^topic=", ""), F.lit("")))
    return F.coalesce(*found, file_topic(path))


def _header_variants(spark: SparkSession, roots: Sequence[str], recursive: bool, glob: str) -> list[tuple[list[str], list[str]]]:
    """Distinct headers (first line that is no comment) with their files.

    The driver holds the file names, as Spark's own file listing does.
    """
    lines = (
        spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).text(list(roots))
        .select(
            F.regexp_replace("value", "^\ufeff|\r$", "").alias("line"), F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"),
        )
        .filter("block = 0 AND line NOT LIKE '#%' AND trim(line) <> ''")
    )
    heads = lines.groupBy("path").agg(F.min_by("line", "pos").alias("line"))
    found = heads.groupBy("line").agg(F.sort_array(F.collect_list("path")).alias("files")).orderBy("line").collect()
    return [([n.strip().strip('"') for n in r["line"].split(",")], [_file_name(f) for f in r["files"]]) for r in found]


def _file_name(uri: str) -> str:
    """The path a reader takes for the encoded address of a file; pattern characters stand for themselves."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", unquote(uri))


def read_comment_metadata(spark: SparkSession, paths: str | Sequence[str], glob: str = "*.csv") -> DataFrame:
    """Query, collection time and row count from the ``# key: value`` lines of each file."""
    lines = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(paths)
        .select("value", F.col("_metadata.file_path").alias("path"))
        .filter(F.col("value").startswith("#"))
    )
    found = {
        name: F.nullif(F.trim(F.regexp_extract("value", f"{key}:(.*)$", 1)), F.lit(""))
        for name, key in HEADER_KEYS.items()
    }
    per_file = lines.groupBy("path").agg(*[F.max(v).alias(k) for k, v in found.items()])
    return per_file.select(
        file_topic(F.col("path")).alias("topic"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("source_file"),
        "query",
        "collected_at",
        F.col("original_count").try_cast("bigint").alias("original_count"),
    )


def list_topics(spark: SparkSession, root: str) -> DataFrame:
    """Topics by folder, from file listing only."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    )
    return files.select(file_topic(F.col("path")).alias("topic")).filter("topic not like '.%'").distinct()


def list_files(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """Distinct matching files below ``root``; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
        .select("path")
        .distinct()
    )


def _without_digit_parts(stem: Column) -> Column:
    parts = F.filter(F.split(stem, "_"), lambda p: ~p.rlike("^[0-9]+$"))
    return F.array_join(parts, "_")


def query_from_file_name(name: Column) -> Column:
    """``tweets_<query>_<digits>.csv`` to the query; other names lose only the extension."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    rest = _without_digit_parts(F.substring(stem, 8, 1_000_000))
    return F.when(
        stem.startswith("tweets_"), F.coalesce(F.nullif(rest, F.lit("")), stem)
    ).otherwise(stem)


def topic_from_path(path: Column) -> Column:
    """Folder after ``original`` or ``outputs``; else the file name without known endings."""
    def after(folder: str) -> Column:
        part = F.regexp_extract(path, rf"(?:^|/){folder}/([^/]+)", 1)
        return F.when((part != "") & ~part.endswith(".csv"), part)

    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")
    bare = F.regexp_replace(stem, f"({'|'.join(FILE_SUFFIXES)})$", "")
    named = F.nullif(_without_digit_parts(bare), F.lit(""))
    return F.coalesce(after("original"), after("outputs"), named, F.lit("unknown"))


def _decoder(encoding: str):
    @F.pandas_udf("string")
    def decode(lines: pd.Series) -> pd.Series:
        def one(raw: bytes) -> str | None:
            try:
                return bytes(raw).decode(encoding)
            except UnicodeDecodeError:
                return None

        return lines.map(one)

    return decode


def read_polarity_dictionary(spark: SparkSession, path: str, encodings: Sequence[str] = ("cp932", "utf-8")) -> DataFrame:
    """``word:reading:class:score`` lines to ``word, polarity, line_no`` in {-1, +1}.

    The first encoding that reads every line is used, else the last one.
    """
    raw = spark.read.text(path).select(
        F.col("value").cast("binary").alias("raw"), F.monotonically_increasing_id().alias("line_no")
    )
    lines = raw
    for encoding in encodings:
        lines = raw.select(_decoder(encoding)("raw").alias("value"), "line_no")
        if encoding == encodings[-1] or not lines.filter(F.col("value").isNull()).limit(1).count():
            break
    parts = lines.withColumn("p", F.split(F.trim("value"), ":")).filter(F.size("p") >= 4)
    graded = parts.select(
        F.col("p")[0].alias("word"),
        discretise_polarity(F.col("p")[3].try_cast("double")).alias("polarity"),
        "line_no",
    )
    return graded.filter(F.col("polarity") != 0)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``word,polarity`` CSV; the last line of a repeated word counts."""
    raw = spark.read.option("header", "true").schema("word string, polarity double").csv(path)
    numbered = raw.withColumn("line_no", F.monotonically_increasing_id())
    return numbered.groupBy("word").agg(F.max_by("polarity", "line_no").alias("polarity"))
