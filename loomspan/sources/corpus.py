"""Corpus inputs: files, the line table, listings, manifests, job documents, notebooks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import defaults as D
from loomspan.functions import text as T
from loomspan.sources import folders

FILE = ("repo_name", "file_path")


def language_hint(ext: Column) -> Column:
    pairs = [F.lit(x) for pair in D.LANGUAGE_OF_EXT.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), ext), F.lit("unknown"))


def scan_files(spark: SparkSession, root: str, repo_name: str, exts: list[str], excluded: list[str] | None = None) -> DataFrame:
    """``(repo_name, file_path, ext, lang, size, text, file_hash)`` of a folder tree, hidden names included; ``.env`` counts whatever
    ``exts`` says. Folders that are left out are not entered; names and sizes are judged before contents are read."""
    spark.dataSource.register(folders.Folders)
    asked = {"path": root, "excluded": json.dumps(excluded or D.EXCLUDED_DIRS), "exts": json.dumps(exts), "names": json.dumps([".env"]), "maxBytes": str(D.MAX_FILE_BYTES)}
    raw = spark.read.format("folders").options(**asked).load()
    ext = T.extension(F.col("file_path"))
    text = T.clean_text(F.col("content"), D.READ_CHARS)
    out = raw.select(F.lit(repo_name).alias("repo_name"), "file_path", ext.alias("ext"), F.col("length").alias("size"), text.alias("text"))
    return out.withColumns({"lang": language_hint(F.col("ext")), "file_hash": T.sha256(F.col("text"))})


def files_from_texts(docs: DataFrame, repo: Column, path: Column, text: Column) -> DataFrame:
    """The second form of a corpus: a table of texts. Line ends are unified before anything is hashed."""
    out = docs.select(repo.alias("repo_name"), path.alias("file_path"), F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n").alias("text"))
    ext = T.extension(F.col("file_path"))
    return out.withColumns({"ext": ext, "lang": language_hint(ext), "size": F.octet_length("text").cast("long"), "file_hash": T.sha256(F.col("text"))})


def line_table(files: DataFrame) -> DataFrame:
    """``(repo_name, file_path, line_no, line)``, lines from 1."""
    return files.select(*FILE, F.posexplode(T.split_lines(F.col("text"))).alias("p", "line")).select(*FILE, (F.col("p") + 1).alias("line_no"), "line")


def with_lines(files: DataFrame) -> DataFrame:
    """Files plus ``lines`` (array) and ``n_lines``."""
    return files.withColumn("lines", T.split_lines(F.col("text"))).withColumn("n_lines", F.size("lines"))


def snippet(lines: Column, start: Column, stop: Column) -> Column:
    """Lines start..stop joined; an equi-join to the array of lines replaces a range join."""
    return F.array_join(F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(stop - F.greatest(start, F.lit(1)) + 1, F.lit(0))), "\n")


def listing(files: DataFrame, limit: int = 400) -> DataFrame:
    """The first ``limit`` paths of each repository."""
    order = Window.partitionBy("repo_name").orderBy("file_path")
    return files.select(*FILE).withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n")


def header(files: DataFrame, n: int) -> DataFrame:
    """``(repo_name, file_path, header)``: the first n lines."""
    return with_lines(files).select(*FILE, F.array_join(F.slice("lines", 1, n), "\n").alias("header"))


def manifests(files: DataFrame, max_chars: int = 3000) -> DataFrame:
    """``(repo_name, snippets map)`` of the listed root manifests."""
    found = files.where(F.col("file_path").isin(D.MANIFESTS))
    return found.groupBy("repo_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("file_path", F.left("text", F.lit(max_chars)))))).alias("snippets"))


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Job documents, one JSON file each; malformed ones are left out."""
    schema = "job_id string, status string, repo_name string, repo_path string, created_at_utc string, updated_at_utc string, pid int, summary string, error string"
    return spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").schema(schema).json(folder)
