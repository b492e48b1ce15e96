"""Scans: local files, delimited and JSON lines, paged services, question benchmarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TEXT_SUFFIXES = ("md", "txt", "html", "htm", "csv", "tsv", "json", "log")


def text_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = TEXT_SUFFIXES, most_bytes: int = 1_000_000, hidden: bool = False) -> DataFrame:
    """(path, suffix, title, body, problem) of files below a folder. Too large ones keep their row, with a problem in place of the body."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = files.withColumns({"suffix": suffix, "_name": name}).where(F.col("suffix").isin(*suffixes))
    if not hidden:
        rows = rows.where(~F.startswith("_name", F.lit(".")))
    fits = F.col("length") <= most_bytes
    body = F.when(fits, F.try_validate_utf8(F.col("content").cast("string")))
    heading = F.regexp_extract(body, r"(?m)^# +(.+)$", 1)
    problem = F.when(~fits, "too_large").when(body.isNull(), "not_utf8")
    return rows.select("path", "suffix", F.when(heading != "", F.trim(heading)).otherwise(F.col("_name")).alias("title"), body.alias("body"), problem.alias("problem"))


def jdbc_rows(spark: SparkSession, url: str, query: str, most_rows: int | None = None, **options: str) -> DataFrame:
    """Rows of a named query of a database."""
    rows = spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()
    return rows.limit(most_rows) if most_rows is not None else rows


def eval_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cases of a JSON-lines file with the text of the lines that cannot be read."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def structured_records(rows: DataFrame, paths: dict[str, str], json: str = "json") -> DataFrame:
    """Records from JSON text by dotted paths; those without id or body are left out. Adds a checksum of the body."""
    out = rows.select(*(F.get_json_object(json, f"$.{p}").alias(name) for name, p in paths.items()))
    return out.where("id is not null and trim(body) <> ''").withColumn("checksum", F.sha2(F.encode("body", "UTF-8"), 256))


def question_set(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(case_id, question, answers, text) of a document or chart question set, in its published JSON form."""
    if kind == "docvqa":
        item = spark.read.option("multiLine", "true").json(path).select(F.explode("data").alias("d"))
        return item.select(F.col("d.question_id").cast("string").alias("case_id"), F.col("d.question").alias("question"), F.col("d.answers").alias("answers"), F.col("d.document_text").alias("text"))
    if kind == "chartqa":
        d = spark.read.option("multiLine", "true").json(path)
        return d.select(F.col("id").cast("string").alias("case_id"), F.col("query").alias("question"), F.array(F.col("label").cast("string")).alias("answers"), F.col("chart_text").alias("text"))
    raise ValueError(f"unknown question set: {kind}")


class _Page(InputPartition):
    pass


class _PagedReader(DataSourceReader):
    def __init__(self, fetch, most_pages):
        self.fetch, self.most_pages = fetch, most_pages

    def partitions(self):
        return [_Page(0)]

    def read(self, partition):
        cursor, seen = None, set()
        for _ in range(self.most_pages):
            rows, cursor = self.fetch(cursor)
            yield from rows
            if cursor is None or cursor in seen:
                return
            seen.add(cursor)


def paged_source(name: str, schema: str, fetch: Callable, most_pages: int = 10) -> type[DataSource]:
    """A data source over cursor pages: fetch(cursor) gives (rows, next cursor). It ends at no cursor, a repeated one, or most_pages."""

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return _PagedReader(fetch, most_pages)

    return Paged
