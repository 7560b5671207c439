"""Text inputs: numbered records, lists of files, tab-separated samples, click logs, vocabularies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.operators.positions import line_positions

# The white space that a text strip removes, as a regular expression class.
SPACE = r"[\s\p{Z}\x0B\x1C-\x1F\x85]"


def strip(column: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(column, f"^{SPACE}+|{SPACE}+$", "")


def words(column: Column) -> Column:
    """Split on runs of white space; an empty text has no words."""
    return F.regexp_extract_all(column, F.lit(f"[^{SPACE[1:-1]}]+"), F.lit(0))


def has_words(column: Column) -> Column:
    """Whether there is anything but white space; stops at the first such character."""
    return column.rlike(f"[^{SPACE[1:-1]}]")


def one_line(column: Column) -> Column:
    """Text on one line: runs of white space become one blank."""
    return F.array_join(words(column), " ")


def drop_blank_records(df: DataFrame, column: str) -> DataFrame:
    """Strip the column and skip the rows that are empty then."""
    return df.where(has_words(F.col(column))).withColumn(column, strip(F.col(column)))


def split_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All lines with their file and the start of the split they are read in."""
    lines = spark.read.option("lineSep", "\n").text(paths)
    return lines.withColumn("file_path", F.col("_metadata.file_path")).withColumn("_block", F.col("_metadata.file_block_start"))


def read_text_records(spark: SparkSession, paths: str | Sequence[str], name: str = "record_no", base: int = 1) -> DataFrame:
    """Non-blank stripped lines with their number per file.

    Large files are read in splits: lines are counted per split, and their place in it comes from the order in which they are read.
    """
    lines = split_lines(spark, paths)
    kept = drop_blank_records(lines, "value").withColumn("_line", F.monotonically_increasing_id())
    return line_positions(kept, name, base)


def read_file_list(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Manifest entries ``(line_no, path)``, counted from 0 over non-blank lines."""
    return read_text_records(spark, paths, "line_no", 0).withColumnRenamed("value", "path")


def read_tsv_records(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Samples ``text<tab>segmented<tab>label``: numbered good rows, and the rows with another field count."""
    lines = split_lines(spark, paths)
    fields = drop_blank_records(lines, "value").withColumn("_f", F.split("value", "\t"))
    three = fields.where(F.size("_f") == 3).withColumn("_line", F.monotonically_increasing_id())
    good = line_positions(three, "guid").select(
        *[c for c in lines.columns if c not in ("value", "_block")],
        "guid",
        F.col("_f")[0].alias("text"),
        F.col("_f")[1].alias("segmented"),
        F.col("_f")[2].alias("label"),
    )
    bad = fields.where(F.size("_f") != 3).withColumn("n_fields", F.size("_f")).drop("_f", "_block")
    return good, bad


def read_labelled_list(spark: SparkSession, paths: str | Sequence[str], mode: str, root: str) -> tuple[DataFrame, DataFrame]:
    """Image list ``path label``, and the lines without an integer label; a test list has paths only."""
    lines = spark.read.option("lineSep", "\n").text(paths).select(strip(F.col("value")).alias("value"))
    if mode == "test":
        return lines.select(F.concat_ws("/", F.lit(root), "value").alias("path")), lines.limit(0)
    parts = F.split("value", f"{SPACE}+")
    label = F.get(parts, F.lit(1)).try_cast("int")
    good = lines.where(label.isNotNull()).select(
        F.concat_ws("/", F.lit(root), F.lit(mode), F.replace(F.get(parts, F.lit(0)), F.lit("JPEG"), F.lit("jpeg"))).alias("path"),
        label.alias("label"),
    )
    return good, lines.where(label.isNull())


def read_ctr_records(spark: SparkSession, paths: str | Sequence[str], dense: int = 13, sparse: int = 26) -> tuple[DataFrame, DataFrame]:
    """Click log of blank-separated attributes: label, dense numbers, then one id slot per sparse feature.

    Good rows, and the lines with another number of attributes or with some that are no numbers, as ``(value, n_fields)``.
    """
    parts = F.col("_p")
    label, ids = F.get(parts, F.lit(0)).try_cast("int"), F.slice(parts, 2 + dense, sparse)
    numbers = F.transform(F.slice(parts, 2, dense), lambda x: x.try_cast("float"))
    lines = spark.read.option("lineSep", "\n").text(paths).withColumn("_p", F.split(F.trim("value"), " "))
    fits = (F.size(parts) == 1 + dense + sparse) & label.isNotNull() & F.forall(numbers, lambda x: x.isNotNull())
    fits = fits & F.forall(ids, lambda x: x.try_cast("bigint").isNotNull())
    slots = [F.array(F.get(parts, F.lit(1 + dense + i)).try_cast("bigint")).alias(f"C{i + 1}") for i in range(sparse)]
    good = lines.where(fits).select(numbers.alias("dense"), *slots, label.alias("label"))
    return good, lines.where(~fits).select("value", F.size(parts).alias("n_fields"))


def read_vocabulary(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Word and line number (from 0, blank lines count too); the last of equal words wins."""
    lines = split_lines(spark, paths)
    numbered = line_positions(lines.withColumn("_line", F.monotonically_increasing_id()), "idx")
    keys = [c for c in lines.columns if c not in ("value", "_block")]
    return numbered.groupBy(*keys, strip(F.col("value")).alias("word")).agg(F.max("idx").alias("idx"))


def write_lines(df: DataFrame, path: str, bucket: str, order: Sequence[str], value: str) -> None:
    """One ordered text file per bucket; choose buckets of bounded size."""
    ordered = df.repartition(bucket).sortWithinPartitions(bucket, *order)
    ordered.select(bucket, value).write.partitionBy(bucket).text(path)
