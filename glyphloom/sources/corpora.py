"""Readers of labelled corpora and gold standards."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphloom.functions import text as T
from glyphloom.storage import written


# Where the usual corpora lie below a data folder, by language and use.
CORPORA = {
    ("EN", "train"): "Raw/EN/E-c-En-train.csv",
    ("EN", "dev"): "Raw/EN/2018-E-c-En-dev.csv",
    ("AR", "train"): "Raw/AR/2018-E-c-Ar-train.csv",
    ("AR", "dev"): "Raw/AR/2018-E-c-Ar-dev.csv",
}


def language_of(path: str) -> str | None:
    """The folder below Raw in a corpus path, or None."""
    found = re.search(r"(?:^|/)Raw/(.*)/", path)
    return found[1] if found else None


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, n, value: the lines of text files, numbered from 0 in each.

    A file may be read in any number of blocks: lines are numbered within their block, and a prefix sum of the blocks' counts, a row a block, says where each begins.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    raw = written(raw, "lines")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = raw.groupBy("file", "block").agg(F.count("*").alias("many"), F.min("at").alias("first")).withColumn("start", F.coalesce(F.sum("many").over(before), F.lit(0)))
    # A block's rows have consecutive numbers in the order of its lines. A row a block is broadcast: lines aren't gathered by their file.
    return raw.join(F.broadcast(starts.select("file", "block", "first", "start")), ["file", "block"]).select("file", (F.col("start") + F.col("at") - F.col("first")).alias("n"), "value")


def _cleaned(arabic: bool) -> Column:
    return T.split_emojis(T.clean_arabic(T.clean_line(F.col("value"))) if arabic else T.clean_line(F.col("value")))


def _cells(lines: DataFrame, *more: str) -> DataFrame:
    cells = F.split(T.strip(F.col("line")), "\t")
    return lines.select(
        *more, F.get(cells, 0).alias("doc_id"), T.strip(T.strip_mentions(F.coalesce(F.get(cells, 1), F.lit("")))).alias("text"),
        F.transform(F.slice(cells, 3, 1 << 20), lambda x: F.coalesce(T.strip(x).try_cast("int"), F.lit(0))).alias("gs"),
    )


def labelled_files(spark: SparkSession, path: str, arabic: bool = False) -> DataFrame:
    """doc_id string, text, gs array<int>, labels array<string> of UTF-8 TSV files: id, text and a 0/1 column for each label, under a header whose names from the third on are the labels.

    Each file has a header of its own, the first of its lines that isn't empty, and may have labels of its own. Lines are cleaned before they are split; empty ones go.
    """
    lines = written(numbered_lines(spark, path).select("file", "n", _cleaned(arabic).alias("line")).where("line <> ''"), "cleaned")
    heads = lines.groupBy("file").agg(F.min_by("line", "n").alias("head"), F.min("n").alias("first"))
    names = F.filter(F.split(F.col("head"), f"{T.SPACE}+"), lambda x: x != "")
    rows = lines.join(F.broadcast(heads.select("file", "first", F.slice(names, 3, 1 << 20).alias("labels"))), "file").where("n > first")
    return _cells(rows, "labels").select("doc_id", "text", "gs", "labels")


def labelled_tsv(spark: SparkSession, path: str, arabic: bool = False, labels: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """(rows, labels) of labelled_files() that share their labels; rows is (doc_id string, text, gs array<int>). Files without headers are read with their labels given."""
    if labels is not None:
        return _cells(spark.read.text(path).select(_cleaned(arabic).alias("line")).where("line <> ''")), labels
    rows = written(labelled_files(spark, path, arabic), "corpus")
    head = rows.select("labels").first()
    return rows.drop("labels"), list(head["labels"]) if head else []


def write_tsv(rows: DataFrame, path: str, names: list[str], header: bool = False) -> None:
    """doc_id, text and the columns `names` as TSV lines, under a header in each file if asked for; line breaks are written out, tabs become spaces."""
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit(" "))
    line = F.concat_ws("\t", F.col("doc_id").cast("string"), text, *[F.col(n).cast("string") for n in names])
    made = rows.select(line.alias("\t".join(["id", "text", *names])))
    # A CSV writer that knows no quotes and no separator writes lines under their column's name.
    (made.write.mode("overwrite").options(header=True, quote="", sep="\x01", escape="").csv(path) if header else made.write.mode("overwrite").text(path))


def gold_of(rows: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """doc_id, label, gs of labelled_tsv() rows, or of labelled_files() by their own labels; what is longer, row or labels, is cut."""
    names = F.col("labels") if labels is None else F.array(*map(F.lit, labels)).cast("array<string>")
    cells = rows.select("doc_id", names.alias("labels"), F.posexplode("gs").alias("i", "gs")).where(F.col("i") < F.size("labels"))
    return cells.select("doc_id", F.get(F.col("labels"), F.col("i")).alias("label"), "gs")


def gold_standard(spark: SparkSession, path: str, until: int | None = None) -> DataFrame:
    """form, tag, bw of the different lines of CSV files after the first two of each (and before line `until`): those whose tag is of a noun or a verb."""
    lines = numbered_lines(spark, path)
    kept = lines.where((F.col("n") >= 2) & (F.col("n") < until if until is not None else F.lit(True))).select("value").distinct()
    cells = F.split(T.strip(F.col("value")), ",")
    rows = kept.where(F.size(cells) > 1).select(F.get(cells, 0).alias("form"), F.get(cells, 1).alias("tag"))
    return rows.where(F.substring("tag", 1, 2).isin("NN", "VB")).withColumn("bw", T.shaddas(T.to_buckwalter(F.col("form"))))
