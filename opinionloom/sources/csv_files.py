"""Raw review files."""

from __future__ import annotations

import csv

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinionloom.functions.binding import column
from opinionloom.session import python_tasks, written

MIN_FILE_BYTES = int(0.1 * 1024 * 1024)

# pandas' default missing values.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)


def list_csv_files(spark: SparkSession, folder: str) -> DataFrame:
    """Path and size of the CSV files of a folder; file contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.csv")
        .load(folder)
        .select("path", "length")
    )


def largest_csv(spark: SparkSession, folder: str) -> str:
    """SRC1, LIM3: path of the largest CSV file; of equals the first by name."""
    rows = list_csv_files(spark, folder).orderBy(F.desc("length"), "path").limit(1).collect()
    if not rows:
        raise FileNotFoundError(f"no CSV files in {folder}")
    return rows[0]["path"]


def validated_csv(spark: SparkSession, folder: str, min_bytes: int = MIN_FILE_BYTES) -> str:
    """SRC2: the largest CSV file, refused when it is suspiciously small."""
    path = largest_csv(spark, folder)
    size = list_csv_files(spark, folder).filter(F.col("path") == path).first()["length"]
    if size < min_bytes:
        raise ValueError(f"{path} holds only {size} bytes")
    return path


def all_csv(spark: SparkSession, folder: str, min_bytes: int = 0) -> list[str]:
    """Paths of all CSV files of at least ``min_bytes``, by name; refused when there is none."""
    paths = [r["path"] for r in list_csv_files(spark, folder).filter(F.col("length") >= min_bytes).orderBy("path").collect()]
    if not paths:
        raise FileNotFoundError(f"no CSV files in {folder}")
    return paths


def is_utf8(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether every line of a file is valid UTF-8; stops at the first line that is not."""
    return spark.read.text(path).filter(~F.is_valid_utf8("value")).isEmpty()


def has_quoted_line_breaks(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether some line has an odd number of quotes, so that a quoted value goes on in the next one."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their file, the begin of their split, and how many quotes they hold; in the order of the file within a split."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    place = (F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"))
    return spark.read.option("lineSep", "\n").text(path).select(*place, (quotes % 2).cast("int").alias("odd"), F.col("value").cast("binary").alias("value"))


def split_states(lines: DataFrame) -> DataFrame:
    """Rows ``(path, split, inside)``: whether a split begins within quotes. The quotes of each split are counted, and the odd
    ones before it summed up: a row per split."""
    odd = lines.groupBy("path", "split").agg((F.sum("odd") % 2).alias("odd"))
    before = F.sum("odd").over(Window.partitionBy("path").orderBy("split")) - F.col("odd")
    return odd.select("path", "split", (before % 2 == 1).alias("inside"))


def csv_records(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """SRC3: rows ``(path, split, number, value)``, a record of a CSV file each, read in splits however many line breaks are
    quoted.

    Every split knows from the quotes before it whether it begins within a record. A record that goes on in later splits is
    put together from its pieces, at most two of a split; all others stay where they are read. Quotes
    stand only around values, and are doubled within them. Line breaks within values come as they are, and the one behind a record goes.
    """
    lines = _lines(spark, path)
    # a row per split
    inside_of = {(r["path"], r["split"]): r["inside"] for r in split_states(lines).collect()}
    known = python_tasks(spark).broadcast(inside_of)

    def run(batches):
        place, inside, number, held, whole = None, False, 0, [], True
        for batch in batches:
            out = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("path", "split", "odd")), batch.column("value").to_pylist())
            for path, split, odd, value in rows:
                if (path, split) != place:
                    if held:  # the split before ended within a record
                        out.append((*place, number, b"\n".join(held), "open" if whole else "rest"))
                    place, number, held = (path, split), 0, []
                    inside = known.value[place]
                    whole = not inside
                held.append(value)
                inside ^= bool(odd)
                if not inside:
                    out.append((*place, number, b"\n".join(held), "whole" if whole else "rest"))
                    number, held, whole = number + 1, [], True
            yield _record_batch(out)
        if held:
            yield _record_batch([(*place, number, b"\n".join(held), "open" if whole else "rest")])

    pieces = written(lines.mapInArrow(run, "path string, split long, number int, value binary, kind string"), "csv-records")
    whole = pieces.filter("kind = 'whole'").select("path", "split", "number", "value")
    parts = pieces.filter("kind != 'whole'")
    began = F.sum(F.when(F.col("kind") == "open", 1).otherwise(0)).over(Window.partitionBy("path").orderBy("split", "number"))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("split", "number", F.hex("value").alias("h")))), lambda p: p["h"])
    joined = (
        parts.withColumn("began", began).groupBy("path", "began")
        .agg(F.min(F.struct("split", "number")).alias("at"), F.unhex(F.array_join(texts, "0A")).alias("value"))
        .select("path", "at.split", "at.number", "value")
    )
    return whole.union(joined).withColumn("value", F.regexp_replace(F.decode("value", encoding), "\r$", ""))


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.string())
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    names = ["path", "split", "number", "value", "kind"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read_reviews_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SRC3: all columns as text, missing-value tokens as null, Latin-1 where the bytes are not UTF-8.

    Files without quoted line breaks are read by Spark's own reader, others by their records; both in splits. The files are
    looked through to tell, and have one header.
    """
    encoding = "UTF-8" if is_utf8(spark, path) else "ISO-8859-1"
    if has_quoted_line_breaks(spark, path):
        df = _parsed(csv_records(spark, path, encoding))
    else:
        df = spark.read.option("header", True).option("escape", '"').option("encoding", encoding).csv(path)
    return df.select(*(missing_as_null(column(name)).alias(name) for name in df.columns))


def _parsed(records: DataFrame) -> DataFrame:
    """Columns of records whose first in each file is the header; blank records are left out."""
    first = (F.col("split") == 0) & (F.col("number") == 0)
    header = records.filter(first).orderBy("path").select("value").first()
    if header is None:
        return records.select().limit(0)
    names = next(csv.reader([header["value"].removeprefix("\ufeff")]))
    schema = ", ".join(f"{column(name)} string" for name in names)
    rows = records.filter(~first & (F.trim("value") != ""))
    return rows.select(F.from_csv("value", schema, {"escape": '"'}).alias("r")).select("r.*")


def missing_as_null(name: str):
    """S15: null for any of the missing-value tokens."""
    return F.when(~F.col(name).isin(*NULL_TOKENS), F.col(name))
