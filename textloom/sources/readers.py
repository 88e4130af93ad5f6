"""Readers and writers: whole text files, CoNLL-U, records; JSON and CSV sinks."""

from __future__ import annotations

import hashlib
import os
import shutil
import tarfile
import tempfile
import urllib.request
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import check_integer

FIELDS = ("form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")


def read_texts(spark: SparkSession, path: str | list[str], encoding: str = "utf-8") -> DataFrame:
    """doc_id (file), text: line breaks as \\n, no byte-order mark."""
    text = F.decode("content", encoding) if encoding.lower() not in ("utf-8", "utf-8-sig") else F.col("content").cast("string")
    clean = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), clean.alias("text"))


def parse_conllu(files: DataFrame) -> DataFrame:
    """dep_words from doc_id, text: sentences end at blank lines; comments, multiword ranges and empty nodes are left out."""
    sents = F.filter(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n[ \t]*\n"), lambda s: s.rlike(r"(?m)^\d+\t"))
    rows = files.select("doc_id", F.posexplode(sents).alias("sent_id", "s"))
    lines = rows.select("doc_id", "sent_id", F.explode(F.filter(F.split("s", "\n"), lambda x: x.rlike(r"^\d+\t"))).alias("line"))
    cells = lines.withColumn("c", F.split("line", "\t"))
    value = lambda i: F.when(F.get("c", F.lit(i)).isin("_", ""), F.lit(None)).otherwise(F.get("c", F.lit(i)))
    return cells.select("doc_id", "sent_id", F.get("c", F.lit(0)).cast("int").alias("idx"), F.get("c", F.lit(1)).alias("form"), *(value(i + 1).alias(f) if f != "head" else F.coalesce(F.get("c", F.lit(6)).try_cast("int"), F.lit(0)).alias("head") for i, f in enumerate(FIELDS) if f != "form"))


def read_conllu(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A file is one document, read whole, so the order of its lines is kept."""
    return parse_conllu(read_texts(spark, path))


def with_tokens(dep: DataFrame) -> DataFrame:
    """doc_id, text (forms between spaces, a sentence a line), tokens: a document's annotation as one array, in order."""
    fields = ("sent_id", "idx", "form", "lemma", "upos", "feats", "head", "deprel")
    rows = dep.select("doc_id", F.struct(*(F.col(f).cast("int").alias(f) if f in ("sent_id", "idx", "head") else F.col(f) for f in fields)).alias("t"))
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("t")).alias("tokens"))
    lines = F.transform(F.array_distinct(F.transform("tokens", lambda t: t["sent_id"])), lambda s: F.array_join(F.transform(F.filter("tokens", lambda t: t["sent_id"] == s), lambda t: t["form"]), " "))
    return docs.select("doc_id", F.array_join(lines, "\n\n").alias("text"), "tokens")


def read_annotated(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return with_tokens(read_conllu(spark, path))


class Dataset:
    """A named collection of files: fetched once as an archive into a folder, then read as records of texts.

    url, checksum, folder describe the archive; pattern: which of its files are texts, documents of one file each.
    """

    def __init__(self, name: str, url: str, folder: str, checksum: str | None = None, pattern: str = "**/*.txt"):
        if not name or not url:
            raise ValueError("a dataset needs a name and a url")
        self.name, self.url, self.folder, self.checksum, self.pattern = name, url, folder, checksum, pattern

    def download(self, force: bool = False) -> str:
        return fetch_archive(self.url, self.folder, self.checksum, force)

    def files(self) -> list[str]:
        import glob

        found = sorted(f for f in glob.glob(os.path.join(self.folder, self.pattern), recursive=True) if os.path.isfile(f))
        if not found:
            raise FileNotFoundError(f"{self.name} isn't there; download() fetches it")
        return found

    def records(self, spark: SparkSession, *filters: Column, limit: int | None = None) -> DataFrame:
        return records(read_texts(spark, self.files()), *filters, limit=check_limit(limit))

    def texts(self, spark: SparkSession, *filters: Column, limit: int | None = None) -> DataFrame:
        return self.records(spark, *filters, limit=limit).select("text")


def check_limit(limit: int | None) -> int | None:
    return limit if limit is None else check_integer(limit, "limit", 1)


def records(df: DataFrame, *filters: Column, limit: int | None = None) -> DataFrame:
    """Records that pass all filters (substring_filter, length_filter, or any other predicate)."""
    check_limit(limit)
    for f in filters:
        df = df.where(f)
    return df if limit is None else df.limit(limit)


def finite(df: DataFrame) -> DataFrame:
    """nan and infinities as null, as JSON needs."""
    return df.select(*(F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def write_json(df: DataFrame, path: str) -> None:
    finite(df).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Maps and arrays are written as JSON."""
    flat = finite(df).select(*(F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in df.dtypes))
    flat.write.mode("errorifexists").option("header", True).csv(path)


def file_sha256(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def download_file(url: str, folder: str, name: str | None = None, force: bool = False) -> str:
    """A file of a URL, through a partial file; an existing one stays unless forced."""
    os.makedirs(folder, exist_ok=True)
    final = os.path.join(folder, name or os.path.basename(url.split("?")[0]) or "download")
    if force or not os.path.exists(final):
        with urllib.request.urlopen(url) as r, open(final + ".part", "wb") as f:  # noqa: S310
            shutil.copyfileobj(r, f)
        os.replace(final + ".part", final)
    return final


def extract_archive(archive: str, folder: str) -> str:
    """ZIP or TAR into folder, all or nothing; members that would leave it are refused."""
    parent = os.path.dirname(os.path.abspath(folder))
    os.makedirs(parent, exist_ok=True)
    with tempfile.TemporaryDirectory(dir=parent) as part:
        inside = lambda name: os.path.realpath(os.path.join(part, name)).startswith(os.path.realpath(part) + os.sep)
        if zipfile.is_zipfile(archive):
            with zipfile.ZipFile(archive) as z:
                if not all(map(inside, z.namelist())):
                    raise ValueError("the archive has a member outside its folder")
                z.extractall(part)
        else:
            with tarfile.open(archive) as t:
                t.extractall(part, filter="data")
        shutil.copytree(part, folder, dirs_exist_ok=True)
    return folder


def fetch_archive(url: str, folder: str, checksum: str | None = None, force: bool = False) -> str:
    """Download, check (SHA-256), extract."""
    if os.path.isdir(folder) and os.listdir(folder) and not force:
        return folder
    with tempfile.TemporaryDirectory() as part:
        path = download_file(url, part)
        with open(path, "rb") as f:
            found = hashlib.file_digest(f, "sha256").hexdigest()
        if checksum and found != checksum:
            raise ValueError(f"checksum {found} isn't {checksum}")
        return extract_archive(path, folder)
