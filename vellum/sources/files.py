"""Files as tables: scans with hashes, text as elements, CSV tables, JSON lines; formats without a reader here are named, not dropped.

Readers are chosen by ending from READERS; register() adds one. Text formats are read by Spark;
Word and Excel files in their zipped form are read by `office`; formats in OFFICE need a
library that turns bytes into elements, given to register().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum import schemas
from vellum.functions import text as T

ENDINGS = [".pdf", ".docx", ".doc", ".xlsx", ".xls", ".csv", ".txt", ".md", ".html", ".htm"]
TEXT = [".txt", ".md"]
OFFICE = [".pdf", ".doc", ".xls"]
#: Readers for bytes: ending -> function(bytes) giving (text, category, page) in order.
READERS: dict[str, Callable[[bytes], Iterator[tuple[str, str, int]]]] = {}


def _own() -> dict[str, Callable]:
    """Readers that come with the engine."""
    from vellum.sources import office

    return {".docx": office.safe(office.docx), ".xlsx": office.safe(office.xlsx)}


def register(ending: str, reader: Callable[[bytes], Iterator[tuple[str, str, int]]]) -> None:
    READERS[ending.lower()] = reader


def scan(spark: SparkSession, folder: str, endings: list[str] | None = None) -> DataFrame:
    """(path, name, ending, size, modified, file_hash, content) of the files below a folder, other endings left out before their bytes are hashed."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    e = T.file_ending(F.col("path"))
    keep = raw.where(e.isin(ENDINGS if endings is None else endings))
    return keep.select("path", T.base_name(F.col("path")).alias("name"), e.alias("ending"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("file_hash"), "content")


def decoded(c):
    """Bytes as UTF-8, or where they aren't valid, as the Vietnamese single-byte code page."""

    @F.pandas_udf("string")
    def single_byte(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else bytes(b).decode("cp1258", errors="replace"))

    text = c.cast("string")
    valid = F.is_valid_utf8(text)
    return F.coalesce(F.when(valid, text), single_byte(F.when(~valid, c)))


def elements(files: DataFrame) -> DataFrame:
    """(doc, pos, text, category, page) of scanned files: text line by line, HTML as Markdown lines, other formats by their registered reader; a file without a reader gives one element of category Unsupported."""
    readers = _own() | READERS

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from vellum.operators import html

        for f in frames:
            out = []
            for name, ending, content in zip(f["name"], f["ending"], f["content"], strict=True):
                if ending in readers:
                    got = list(readers[ending](bytes(content)))
                elif ending in (".html", ".htm"):
                    got = [(x, "Text", 1) for x in html.article(_text(content), "")["content"].split("\n") if x.strip()]
                elif ending == ".csv":
                    import csv
                    import io

                    got = [("\n".join(" | ".join(c.strip() for c in r) for r in csv.reader(io.StringIO(_text(content))) if any(c.strip() for c in r)), "Table", 1)]
                elif ending in TEXT:
                    got = [(x.strip(), "Text", 1) for x in _text(content).splitlines() if x.strip()]
                else:
                    got = [(f"no reader for {ending}", "Unsupported", 1)]
                out += [(name, i, *x) for i, x in enumerate(got)]
            yield pd.DataFrame(out, columns=["doc", "pos", "text", "category", "page"])

    return files.select("name", "ending", "content").mapInPandas(run, schemas.ELEMENT)


def _text(content: bytes) -> str:
    try:
        return bytes(content).decode("utf-8-sig")
    except UnicodeDecodeError:
        return bytes(content).decode("cp1258", errors="replace")


def wrapped(spark: SparkSession, folder: str, line: str = "#####") -> DataFrame:
    """(doc, section, title, body) of hand-marked text files: a line of the mark closes a section, the first line after it is the title."""
    t = spark.read.text(folder, wholetext=True).select(T.file_stem(F.input_file_name()).alias("doc"), F.col("value"))
    s = t.select("doc", F.posexplode(F.split("value", rf"(?m)^\s*{line}\s*$")).alias("section", "s")).withColumn("s", F.regexp_replace("s", r"^\s+|\s+$", "")).where("s <> ''")
    return s.select("doc", "section", F.trim(F.substring_index("s", "\n", 1)).alias("title"), F.trim(F.regexp_replace("s", r"^[^\n]*\n?", "")).alias("body"))


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """(doc, rows array<array<string>>) of CSV files without a header; rows of empty cells only are dropped."""
    raw = spark.read.text(path, wholetext=True).select(T.base_name(F.input_file_name()).alias("doc"), "value")

    @F.pandas_udf("array<array<string>>")
    def read(s: pd.Series) -> pd.Series:
        import csv
        import io

        return s.map(lambda v: [r for r in csv.reader(io.StringIO(v)) if any(c.strip() for c in r)])

    return raw.select("doc", read("value").alias("rows"))


def latest_json(spark: SparkSession, path: str, schema: str, keys: list[str], order: str) -> DataFrame:
    """Rows of JSON lines, of each key the one with the largest `order`; broken lines are left out."""
    d = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    g = d.groupBy(*keys).agg(F.max_by(F.struct(*d.columns), F.col(order)).alias("x"))
    return g.select("x.*")


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Appends to a folder of JSON lines the rows whose key isn't there; how many there were. The rows are decided once and then written."""
    from vellum.session import checkpointed, exists

    spark = df.sparkSession
    if exists(spark, path):
        df = df.join(spark.read.schema(df.schema).json(path).select(key).distinct(), key, "left_anti")
    df = checkpointed(df.dropDuplicates([key]))
    df.write.mode("append").json(path)
    return df.count()
