"""Rows that every operator has to survive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, size long, score double"
LONG = " ".join(f"word{i % 977} tail{i % 13}" for i in range(30_000))

ROWS = [
    (1, "one two three four five six seven", "en", "a", 33, 1, "k", 1, 0.5),
    (2, "one two three four five six seven", "en", "a", 33, 1, "k", 1, 0.5),
    (2, "one two three four five six seven", "en", "a", 33, 1, "k", 1, 0.5),
    (3, None, "en", "a", None, None, None, None, None),
    (4, "", None, None, 0, 1, "k", 1, 0.5),
    (5, " \t\n ", "de", "b", 4, 1, "k", 1, 0.5),
    (6, LONG, "en", "b", len(LONG), 1, "k", 1, 0.5),
    (7, "x" * 100_000, "de", "b", 100_000, 1, "k", 1, 0.5),
    (None, "no id at all here", "de", None, 17, 1, "k", 1, 0.5),
    (8, "!!! 123 +++", "de", "c", 11, 1, "k", 1, 0.5),
    (9, "Größe Ünd ßpät \U0001f600 日本語", "de", "c", 20, 1, "k", 1, 0.5),
]


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, SCHEMA)


def no_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


PAGES = "page_id long, url string, html string, text string, host string, key string, digest string"


def pages(spark: SparkSession) -> DataFrame:
    body = "<article><p>" + "words and more " * 200 + "</p></article>"
    rows = [
        (1, "http://a.example.org/en/1", body, "t", "h", "k", "d"),
        (2, None, body, None, None, None, None),
        (3, "no scheme", None, "t", "h", "k", "d"),
        (4, "https://X.Com/fr/é?q#f", "", "t", "h", "k", "d"),
        (5, "http://example.org/es/", "<p>" * 5000 + "deep", "t", "h", "k", "d"),
        (5, "http://example.org/es/", "<p>" * 5000 + "deep", "t", "h", "k", "d"),
        (None, "http://", body, "t", "h", "k", "d"),
        (7, "http://b.net/" + "a" * 5000, "<div class='ad'>buy</div><p>WARC/1.1\r\n\r\nContent-Length: 5\r\n</p>", "t", "h", "k", "d"),
    ]
    return spark.createDataFrame(rows, PAGES)


def no_pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], PAGES)
