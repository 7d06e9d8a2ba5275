import datetime
import random

import pytest

from opinionloom.operators import ingest
from opinionloom.schemas import REVIEWS_RAW, missing_columns, require_columns, schema_differences
from opinionloom.sources import csv_files, snapshots

HEADER = '"reviews.text","reviews.rating","reviews.date",name,other\n'


def write(folder, name, text, encoding="utf-8"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(text.encode(encoding))
    return str(folder / name)


def raw(spark, rows):
    return spark.createDataFrame(
        [(i, *row) for i, row in enumerate(rows)], "review_id long, `reviews.text` string, `reviews.rating` string, `reviews.date` string"
    )


def test_standardize(spark):
    long = "a text that is long enough"
    df = raw(spark, [
        (long, "4.7", "2017-01-13T00:00:00.000Z"), (long, "abc", None), (long, "", None), (long, "NaN", None),
        (None, "5", None), (" exactly10 ", "5", None), ("\t0123456789 ", "5", None), (" 01234567890\n", "5", "garbage"),
    ])
    rows = ingest.standardize(df).orderBy("review_id").collect()
    assert [(r["review_id"], r["rating"], r["review_date"]) for r in rows] == [
        (0, 4, datetime.datetime(2017, 1, 13)), (7, 5, None)
    ]
    assert rows[1]["review_text"] == "01234567890"
    counts = {r["drop_reason"]: r["count"] for r in ingest.drop_counts(ingest.drop_reason(df)).collect()}
    assert counts == {"kept": 2, "rating not a number": 3, "missing text or rating": 1, "text too short": 2}
    assert ingest.unparsed_dates(df).first()[0] == 7


def test_missing_required_column_is_named(spark):
    with pytest.raises(ValueError, match="reviews.rating"):
        ingest.standardize(spark.createDataFrame([("x",)], "`reviews.text` string"))
    assert missing_columns(spark.range(1), ["id", "x"]) == ["x"]
    assert require_columns(spark.range(1), ["id"]).columns == ["id"]


def test_csv_quotes_line_breaks_and_null_tokens(spark, tmp_path):
    path = write(tmp_path / "raw", "a.csv", HEADER + '"line one\nsays ""hi""",5,2017-01-13,NA,x\nplain,4,,n/a,\n')
    rows = csv_files.read_reviews_csv(spark, path).collect()
    assert rows[0]["reviews.text"] == 'line one\nsays "hi"'
    assert [r["name"] for r in rows] == [None, None]
    assert rows[1]["reviews.date"] is None and rows[1]["other"] is None


def one_piece(spark, path):
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*(csv_files.missing_as_null(f"`{n}`").alias(n) for n in df.columns))


@pytest.mark.parametrize("split", [30, 120, 1 << 20])
def test_quoted_line_breaks_are_read_in_splits(spark, tmp_path, split):
    rng = random.Random(split)
    pieces = ["a", "word ", "\n", '""', ",", "\n\n", "é", ""]
    names = ["reviews.text", "b", "c"]
    for file in range(2):
        rows = [names] + [
            ['"' + "".join(rng.choices(pieces, k=rng.randrange(1, 9))) + '"' if rng.random() < 0.7 else f"plain{i}" for _ in names] for i in range(15)
        ]
        rows.append(['"' + "long\n" * 60 + '"', "x", '"\n"'])  # over many splits
        write(tmp_path / "raw", f"{file}.csv", "\n".join(",".join(r) for r in rows) + "\n" * file)
    paths = [str(tmp_path / "raw" / f"{file}.csv") for file in range(2)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        found = csv_files.read_reviews_csv(spark, paths)
        rows = sorted(map(tuple, found.collect()), key=str)
        splits = csv_files.split_states(csv_files._lines(spark, paths)).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert rows == sorted(map(tuple, one_piece(spark, paths).collect()), key=str) and found.columns == names
    assert len(rows) == 2 * 16 and (splits > 30) == (split < 50)


def test_records_end_with_carriage_returns_too(spark, tmp_path):
    path = write(tmp_path / "raw", "a.csv", 'a,b\r\n"x\ny",1\r\n\r\nz,2')
    assert [tuple(r) for r in csv_files.read_reviews_csv(spark, path).orderBy("b").collect()] == [("x\ny", "1"), ("z", "2")]


@pytest.mark.parametrize("encoding", ["utf-8", "latin-1"])
def test_records_in_other_encodings(spark, tmp_path, encoding):
    path = write(tmp_path / "raw", "a.csv", HEADER + '"café\nà",5,,,\n', encoding)
    assert csv_files.read_reviews_csv(spark, path).first()["reviews.text"] == "café\nà"


@pytest.mark.parametrize("encoding", ["utf-8", "latin-1"])
def test_csv_encodings(spark, tmp_path, encoding):
    path = write(tmp_path / "raw", "a.csv", HEADER + "café,5,,,\n", encoding)
    assert csv_files.read_reviews_csv(spark, path).first()["reviews.text"] == "café"


def test_largest_file_and_size_check(spark, tmp_path):
    folder = tmp_path / "raw"
    write(folder, "small.csv", HEADER)
    write(folder, "big.csv", HEADER + "x,1,,,\n")
    write(folder, "bigger.txt", HEADER * 9)
    assert csv_files.largest_csv(spark, str(folder)).endswith("/big.csv")
    with pytest.raises(ValueError, match="big.csv"):
        csv_files.validated_csv(spark, str(folder))
    assert csv_files.validated_csv(spark, str(folder), 10).endswith("/big.csv")
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        csv_files.largest_csv(spark, str(tmp_path / "empty"))


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(1, "t", 5, None, None, None, None)], REVIEWS_RAW)
    df.write.parquet(str(tmp_path / "raw"))
    assert snapshots.read_snapshot(spark, str(tmp_path / "raw"), "raw").columns == df.columns
    assert snapshots.read_first_snapshot(spark, str(tmp_path / "none"), str(tmp_path / "raw")).count() == 1
    with pytest.raises(FileNotFoundError):
        snapshots.read_first_snapshot(spark, str(tmp_path / "none"))
    assert schema_differences(df, "raw") == []
    assert schema_differences(df.drop("reviewer"), "raw") == ["reviewer: missing"]


def test_profile(spark):
    df = spark.createDataFrame(
        [(5, datetime.datetime(2017, 1, 2), "a"), (5, None, None), (1, datetime.datetime(2016, 5, 1), "b")],
        "rating int, review_date timestamp, product_name string",
    )
    assert tuple(ingest.dataset_profile(df).first()) == (3, datetime.date(2016, 5, 1), datetime.date(2017, 1, 2))
    assert {tuple(r) for r in ingest.null_counts(df).collect()} == {("rating", 0), ("review_date", 1), ("product_name", 1)}
    assert [tuple(r) for r in ingest.rating_histogram(df).collect()] == [(1, 1, 10), (5, 2, 20)]
