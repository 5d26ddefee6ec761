"""Joins and lookups of packaging: sources with their timing and audio, references with files, words with dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T


def languages(spark: SparkSession) -> DataFrame:
    """Three rows, so a broadcast has a proven bound."""
    return spark.createDataFrame(X.LANGUAGES, "code string, epub_lang string, tts_engine string, tts_voice string, sre_lang string")


def with_language(docs: DataFrame, configs: DataFrame, lang: str = "lang") -> DataFrame:
    return docs.join(F.broadcast(configs), F.col(lang) == F.col("epub_lang"))


def without_language(docs: DataFrame, configs: DataFrame, lang: str = "lang") -> DataFrame:
    """The audit: what no configuration covers."""
    return docs.join(F.broadcast(configs.select("epub_lang")), F.col(lang) == F.col("epub_lang"), "left_anti")


def _stems(rows: DataFrame, path: str, side: str) -> DataFrame:
    """One row for each stem: its rows' number and one of them."""
    return rows.withColumn("stem", T.stem(F.col(path))).groupBy("stem").agg(F.count("*").alias(f"n_{side}"), F.first(F.struct(*rows.columns)).alias(side))


def by_stem(left: DataFrame, right: DataFrame, left_path: str, right_path: str) -> DataFrame:
    """Rows whose file names agree up to the suffix, one of each side; all others are in by_stem_audit."""
    both = _stems(left, left_path, "left").filter("n_left = 1").join(_stems(right, right_path, "right").filter("n_right = 1"), "stem")
    return both.select("stem", "left.*", "right.*")


def by_stem_audit(left: DataFrame, right: DataFrame, left_path: str, right_path: str) -> DataFrame:
    """Stems that are not there exactly once on either side: stem, n_left, n_right."""
    both = _stems(left, left_path, "left").join(_stems(right, right_path, "right"), "stem", "full")
    counted = both.select("stem", F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))
    return counted.filter("n_left <> 1 OR n_right <> 1")


def book_metadata(books: DataFrame, sidecars: DataFrame) -> DataFrame:
    """books: book_id, path; sidecars: path, title and the other values. Books whose sidecar is there once, with a title."""
    there = sidecars.withColumnRenamed("path", "sidecar").withColumn("n", F.count("*").over(Window.partitionBy("sidecar")))
    return books.withColumn("sidecar", T.sidecar(F.col("path"))).join(there.filter("n = 1 AND title IS NOT NULL").drop("n"), "sidecar")


def book_metadata_audit(books: DataFrame, sidecars: DataFrame) -> DataFrame:
    """book_id, fault of books without exactly one sidecar or without a title."""
    seen = sidecars.groupBy(F.col("path").alias("sidecar")).agg(F.count("*").alias("n"), F.count("title").alias("titles"))
    b = books.withColumn("sidecar", T.sidecar(F.col("path"))).join(seen, "sidecar", "left")
    fault = F.when(F.col("n").isNull(), "file missing").when(F.col("n") > 1, "several files").when(F.col("titles") == 0, "title missing")
    return b.select("book_id", fault.alias("fault")).filter("fault IS NOT NULL")


def first_of_each(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Distinct by key, the first in order wins, order kept in `pos`."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def resolve(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Each reference's file: at its path, else under images/; found is null where neither is there."""
    at = files.select(F.col("path").alias("direct"))
    below = files.select(F.col("path").alias("fallback"))
    r = refs.join(at, F.col("ref") == F.col("direct"), "left").join(below, F.concat(F.lit("images/"), T.file_name(F.col("ref"))) == F.col("fallback"), "left")
    return r.withColumn("found", F.coalesce("direct", "fallback")).drop("direct", "fallback")


def metadata(lines: DataFrame, book: str = "book_id") -> DataFrame:
    """Key and value lines to one row a book: split at the first colon (ASCII, else full-width), blank values skipped,
    unknown keys ignored, the last of a repeated key wins, accessibility values gather in order."""
    at = F.instr(F.col("line"), ":")
    at = F.when(at > 0, at).otherwise(F.instr(F.col("line"), "："))
    kv = lines.filter(at > 0).select(book, "line_no", T.stripped(F.substring(F.col("line"), F.lit(1), at - 1)).alias("key"), T.stripped(F.substring(F.col("line"), at + 1, F.length("line"))).alias("value"))
    kv = kv.filter("value <> ''")
    named = [F.max_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.col("line_no"))).alias(v) for k, v in X.METADATA_KEYS.items()]
    access = F.collect_list(F.when(F.col("key").isin(X.ACCESS_KEYS), F.struct("line_no", "key", "value")))
    shown = F.array_join(F.transform(F.array_sort(access), lambda s: F.concat(s["key"], F.lit("="), s["value"])), ";")
    return kv.groupBy(book).agg(*named, shown.alias("accessibility"))


def unregistered(words: DataFrame, dictionary: DataFrame, key: str = "word") -> DataFrame:
    return words.join(dictionary, key, "left_anti")
