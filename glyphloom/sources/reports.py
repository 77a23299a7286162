"""Sinks: TSV lines, CSV, and coloured spreadsheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.functions import text as T

from . import workbooks


def lexicon_lines(wide: DataFrame, labels: list[str], places: int = 2) -> DataFrame:
    """line: token and its weights, separated by tabs, of lexicon.as_rows()."""
    return wide.select(F.concat_ws("\t", "token", *[T.fixed(F.col(f"`{x}`"), places) for x in labels]).alias("line"))


def lexicon_export(wide: DataFrame, labels: list[str], surrogates: DataFrame | None = None, header: bool = False, arabic: bool = False) -> DataFrame:
    """line, in the order of the tokens: weights with three places; emoji surrogates as the emoji, Buckwalter words in Arabic script, a header line first if asked for."""
    rows = wide.withColumn("shown", F.col("token"))
    if surrogates is not None:
        rows = wide.join(surrogates, wide["token"] == surrogates["surrogate"], "left").withColumn("shown", F.coalesce("emoji", "token"))
    cells = [T.fixed(F.col(f"`{x}`"), 3) for x in labels]
    lines = rows.select(F.lit(1).alias("part"), "token", F.concat_ws("\t", T.displayed(F.col("shown"), arabic), *cells).alias("line"))
    if header:
        lines = lines.unionByName(wide.sparkSession.createDataFrame([(0, "", "\t".join(["", *labels]))], "part int, token string, line string"))
    return lines.orderBy("part", "token").select("line")


def score_lines(scored: DataFrame, labels: list[str], header: bool = False) -> DataFrame:
    """line: doc_id and all its label scores with two places, of classify.scores(); a line with the labels' names if asked for."""
    wide = scored.groupBy("doc_id").pivot("label", labels).agg(F.first("s"))
    lines = wide.select(F.concat_ws("\t", F.col("doc_id").cast("string"), *[T.fixed(F.coalesce(F.col(f"`{x}`"), F.lit(0.0)), 2) for x in labels]).alias("line"))
    return wide.sparkSession.createDataFrame([("\t".join(["", *labels]),)], "line string").unionByName(lines) if header else lines


def feature_lines(features: DataFrame, most: int | None = None) -> DataFrame:
    """doc_id, line: all of each document's terms, or its `most` heaviest, as "term: weight", heaviest first."""
    if most is not None:
        rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("w").desc(), "token"))
        features = features.withColumn("n", rank).where(F.col("n") <= most)
    # A line holds all its terms, so they are put in order where it is made.
    lists = features.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("w"), "token", T.fixed(F.col("w"), 3).alias("shown")))).alias("parts"))
    return lists.select("doc_id", F.array_join(F.zip_with("parts.token", "parts.shown", lambda t, w: F.concat(t, F.lit(": "), w)), ", ").alias("line"))


def document_form(docs: DataFrame, sizes: DataFrame) -> DataFrame:
    """doc_id, shown: <size, text>."""
    return docs.join(sizes, "doc_id").select("doc_id", F.format_string("<%s, %s>", F.col("size").cast("string"), "text").alias("shown"))


def write_csv(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").option("header", False).csv(path)


def write_xlsx(rows: DataFrame, path: str, colour: str | None = "colour", drop: tuple[str, ...] = (), size: int = 11, most: int | None = None) -> int:
    """A workbook of `rows`, in their order; a row's font has the colour that its colour column names. Returns how many rows it has.

    Rows of the colours in `drop` are left out. Rows that one worksheet can't hold go on in the next; more than `most` are an error, which leaves no file.
    """
    named = rows.withColumnRenamed(colour, "colour") if colour in rows.columns else rows
    kept = named.where(~F.col("colour").isin(*drop) | F.col("colour").isNull()) if drop else named
    if most is not None and kept.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows: write_csv() is for these")
    workbooks.write(kept, path, size=size, **({} if most is None else {"most": most}))
    return workbooks.read(rows.sparkSession, path).count()
