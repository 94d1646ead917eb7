from __future__ import annotations

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text
from scriptorium.functions.decode import decode_text
from scriptorium.functions.headers import md_title, title_of, txt_title, txt_url
from scriptorium.functions.names import extension, folder_of, is_hidden, name_warning, stem_of


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("x")).first()["x"]


NAMES = [
    ("a.txt", "txt", None, "a"),
    ("a.TXT", "txt", None, "a"),
    ("A.b.Md", "md", None, "A.b"),
    ("trailing.txt ", "txt", "trailing whitespace in filename", "trailing"),
    ("trailing.md  ", "md", "trailing whitespace in filename", "trailing"),
    ("20250906txt", "txt", "missing-dot extension", "20250906"),
    ("notesMD", "md", "missing-dot extension", "notes"),
    ("notesmd ", "md", "trailing whitespace in filename", "notes"),
    ("x.pdf", None, None, None),
    ("a.btxt", None, None, None),
    (".DS_Store", None, None, None),
    (".x.txt", None, None, None),
    ("txt", "txt", "missing-dot extension", ""),
    ("README", None, None, None),
]


def test_names(spark):
    frame = spark.createDataFrame([(n,) for n, *_ in NAMES], "n string")
    name = F.col("n")
    rows = frame.select(
        "n", extension(name).alias("e"), name_warning(name).alias("w"), stem_of(name, extension(name)).alias("s")
    ).collect()
    got = {r["n"]: (r["e"], r["w"] if r["e"] else None, r["s"] if r["e"] else None) for r in rows}
    assert got == {n: (e, w, s) for n, e, w, s in NAMES}


def test_paths(spark):
    rows = [("a/b/c.txt", "a/b", False), ("c.txt", "", False), ("a/.git/c.txt", "a/.git", True),
            (".c.txt", "", True), ("__pycache__/c.txt", "__pycache__", True), ("x__pycache__/c.txt", "x__pycache__", False)]
    frame = spark.createDataFrame([(p,) for p, *_ in rows], "p string")
    got = frame.select("p", folder_of(F.col("p")).alias("f"), is_hidden(F.col("p")).alias("h")).collect()
    assert {tuple(r) for r in got} == set(rows)


@pytest.mark.parametrize(
    "body,title,url",
    [
        ("Title: Exact\ntitle: lower\nURL: u1\ntitleUrl: u2", "Exact", "u1"),
        ("title: lower\ntitleUrl:u2", "lower", "u2"),
        ("title: lower\nTitle: Exact", "Exact", None),
        ("Title:   \nTitle: second: part", "second: part", None),
        ("TITLE: no\nTitle x: no", None, None),
        ("\n" * 29 + "Title: line thirty", "line thirty", None),
        ("\n" * 30 + "Title: line thirty-one", None, None),
        ("a Title: after separator\u0085URL: v", "after separator", "v"),
        ("", None, None),
    ],
)
def test_txt_header(spark, body, title, url):
    assert one(spark, body, txt_title) == title
    assert one(spark, body, txt_url) == url


@pytest.mark.parametrize(
    "body,title",
    [
        ("plain\n# Heading\n", "Heading"),
        ("###   Deep  \n# Later", "Deep"),
        ("#no space\n", "#no space"),
        ("#   \ntext", "#"),
        ("* a\n- b\n\n  plain line \n", "plain line"),
        ("\n" * 40 + "# too late", None),
        ("####### seven", "####### seven"),
        ("", None),
    ],
)
def test_md_title(spark, body, title):
    assert one(spark, body, md_title) == title


def test_title_falls_back_to_stem(spark):
    assert one(spark, "no header", lambda c: title_of(c, F.lit("txt"), F.lit("stem"))) == "stem"


@pytest.mark.parametrize(
    "content,expected",
    [
        (b"\xef\xbb\xbfTitle: x\r\ny\rz", "Title: x\ny\nz"),
        ("naïve 日本".encode(), "naïve 日本"),
        (b"\x93quoted\x94 \x80 caf\xe9 \x81", "“quoted” € café �"),
        (b"", ""),
        (b"\xef\xbb\xbf\xef\xbb\xbfx", "﻿x"),
    ],
)
def test_decode(spark, content, expected):
    assert one(spark, bytearray(content), decode_text, "binary") == expected


TOKENS = [
    ("naïve NAÏVE naïve", ["naive"] * 3),
    ("ế Å İ ſ", ["e", "a", "i", "s"]),
    ("ø ł đ ß ﬁ", ["ø", "ł", "đ", "ß", "ﬁ"]),
    ("a_b don't x-y 3.14 a​b", ["a", "b", "don", "t", "x", "y", "3", "14", "a", "b"]),
    ("x² ½", ["x²", "½"]),
    ("日本語 テスト", ["日本語", "テスト"]),
    ("", []),
    ("... - _", []),
]


@pytest.mark.parametrize("value,expected", TOKENS)
def test_tokens(spark, value, expected):
    assert one(spark, value, text.tokens) == expected
    assert text.query_tokens(value) == expected
    assert one(spark, value, text.token_count) == len(expected)


def test_driver_and_column_tokens_agree(spark):
    """Random mixes over the scripts with known rules: both tokenisers and the counter agree."""
    rng = random.Random(7)
    pool = [chr(c) for c in (*range(0x20, 0x250), *range(0x370, 0x500), *range(0x1E00, 0x2000), *range(0x300, 0x370))]
    pool = [c for c in pool if unicodedata.category(c) not in ("Cn", "Cs")]
    rows = [("".join(rng.choices(pool, k=40)),) for _ in range(300)]
    frame = spark.createDataFrame(rows, "v string")
    for r in frame.select("v", text.tokens(F.col("v")).alias("t"), text.token_count(F.col("v")).alias("n")).collect():
        assert r["t"] == text.query_tokens(r["v"]), ascii(r["v"])
        assert len(r["t"]) == r["n"], ascii(r["v"])


def test_separated_texts_hold_the_same_tokens(spark):
    chars = ["a", "Z", "9", "é", "É", "\u0301", "ß", "İ", "ς", "\u212a", "٣", "½", "中", "\U00010400", "😀", "\u00a0", "\x00", " ", "-", "_"]
    pick = random.Random(3)
    texts = ["", " ", "\u0301a", "a-\u0301b", *("".join(pick.choices(chars, k=pick.randrange(1, 30))) for _ in range(300))]
    stray = [b"Ab\x80c \xbf1", b"\xc3\xa9\xc0 x", b"\xff"]
    raw = [(t.encode(),) for t in texts] + [(t,) for t in stray]
    frame = spark.createDataFrame(raw, "b binary").select(F.col("b").cast("string").alias("v"))
    rows = frame.select(text.tokens(F.col("v")).alias("t"), text.separated(F.col("v")).alias("s")).collect()
    for row in rows:
        assert re.findall("[a-z0-9\x80-\U0010ffff]+", row["s"].lower()) == row["t"]
