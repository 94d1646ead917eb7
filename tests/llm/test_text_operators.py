"""Token counts, decontamination, language, HTML, WARC and URL operators."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import odd
import pytest

from scriptorium.llm import base, decontaminate, html, langid, tokens, urls, warc


def test_pieces_equal_greedy_longest_match():
    rng = random.Random(5)
    for _ in range(300):
        piece = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
        starts, goes = {piece() for _ in range(6)}, {piece() for _ in range(6)}
        counter = tokens.PieceCounter(starts, goes)
        for _ in range(20):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
            n, at = 0, 0
            while at < len(word):
                known = starts if at == 0 else goes
                size = max((i for i in range(1, len(word) - at + 1) if word[at : at + i] in known), default=0)
                if not size:
                    n = 0
                    break
                n, at = n + 1, at + size
            assert counter.count(word) == n


def test_token_counts_equal_a_library(spark):
    models = pytest.importorskip("tokenizers.models")
    starts, goes = tokens.read_vocabulary(tokens.VOCABULARY)
    names = ["[UNK]", *sorted(starts), *sorted("##" + p for p in goes)]
    library = models.WordPiece({p: i for i, p in enumerate(names)}, unk_token="[UNK]", max_input_chars_per_word=10**9)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for row in tokens.count_tokens(docs).collect():
        words = re.findall(r"\w+|[^\w\s]", row["text"])
        assert row["n_words"] == len(words)
        assert row["n_tokens"] == sum(len(library.tokenize(w)) for w in words)


def test_token_counts_of_odd_rows(spark):
    rows = tokens.count_tokens(odd.documents(spark).withColumnRenamed("n", "n_words")).collect()
    assert len(rows) == len(odd.ROWS)
    by = {(r["doc_id"], (r["text"] or "")[:3]): r for r in rows}
    assert by[(3, "")]["n_tokens"] == by[(4, "")]["n_words"] == by[(5, " \t\n")]["n_tokens"] == 0
    assert by[(7, "xxx")]["n_words"] == 1
    assert tokens.count_tokens(odd.no_documents(spark)).count() == 0


def _windows(text: str, items: dict[int, str], size: int) -> tuple[int, set[int], set[str]]:
    words_of = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    words, hit, found = words_of(text or ""), set(), set()
    for item, t in items.items():
        w = words_of(t or "")
        n = min(size, len(w))
        for i in range(len(w) - n + 1) if n else ():
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(item))
    return len(words), hit, found


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("a b C dé".split()) for _ in range(n))
    items = {i: text(rng.randint(0, 9)) for i in range(12)} | {20: None}
    docs = {i: text(rng.randint(0, 60)) for i in range(60)} | {99: None}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for block in (decontaminate.BLOCK_WORDS, 2):
        found = decontaminate.find(d, b, 4, block).withColumn("hits", decontaminate.hit_words(decontaminate.F.col("_found")))
        for r in found.collect():
            n, hit, ids = _windows(docs[r["doc_id"]], items, 4)
            assert (r["_found"]["n_words"], r["hits"], r["_found"]["items"]) == (n, len(hit), sorted(ids))


def test_decontamination_removes_spans(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs = [(1, "Before, it. " + item.upper() + "! After it all goes on and on with many more words than that.", "x"), (2, item, "x"), (3, "clean", "x"), (4, None, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, items string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = {r["doc_id"]: r for r in decontaminate.remove(d, b).collect()}
    assert kept[1]["text"] == "Before, it. ! After it all goes on and on with many more words than that."
    assert set(kept) == {1, 3, 4} and kept[3]["text"] == "clean" and kept[3]["items"] == "x" and kept[4]["text"] is None
    assert decontaminate.remove(d, b.limit(0)).count() == 4


def test_decontamination_removes_short_items(spark):
    words = [f"w{i}" for i in range(60)]
    for size in range(1, 10):
        item = [f"q{i}" for i in range(size)]
        texts = [" ".join([*words, *item, *words]), " ".join([*item, *words, "x,", *item[:-1], *words, *item]), " ".join(words)]
        d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        b = spark.createDataFrame([(1, " ".join(item).upper())], "item_id long, text string")
        kept = {r["doc_id"]: r["text"].split() for r in decontaminate.remove(d, b).collect()}
        assert kept == {0: words * 2, 1: [*words, "x,", *item[:-1], *words], 2: words}
        assert not any(r["contaminated"] for r in decontaminate.report(decontaminate.remove(d, b), b).collect())


def test_items_without_an_id_are_windows(spark):
    b = spark.createDataFrame([(None, "one two three"), (2, "five six"), (None, "two three")], "item_id long, text string")
    for block in (decontaminate.BLOCK_WORDS, 1):
        d = odd.documents(spark)
        found = decontaminate.find(d, b, block_words=block)
        rows = found.select("doc_id", "n", decontaminate.hit_words(decontaminate.F.col("_found")).alias("h"), "_found.items", "_found.n_words")
        got = sorted(map(str, rows.collect()))
        assert len(got) == len(odd.ROWS)
        if block == 1:
            assert got == one
        one = got
    r = decontaminate.report(d, b).filter("doc_id = 1").first()
    assert (r["n_hit"], r["n_items"], r["contaminated"]) == (5, 1, True)
    assert r["items_sha256"] == hashlib.sha256(b"2").hexdigest()
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove(d, b, max_coverage=1.0).collect()}
    assert cut[1].split() == ["four", "seven"]


def test_decontamination_of_odd_rows(spark):
    b = spark.createDataFrame([(1, odd.ROWS[0][1]), (None, "x"), (3, None), (4, "")], "item_id long, text string")
    rows = decontaminate.report(odd.documents(spark), b).collect()
    assert len(rows) == len(odd.ROWS)
    assert Counter(r["doc_id"] for r in rows if r["contaminated"]) == {1: 1, 2: 2}
    assert all(r["items_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows if not r["n_items"])
    assert decontaminate.report(odd.no_documents(spark), b).count() == 0
    assert len(decontaminate.remove(odd.documents(spark), b).columns) == len(odd.documents(spark).columns)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.report(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").collect()
    held = [r for r in rows if r["held_out"] and r["n_chars"] > 40]
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_filters_hold_what_was_learned():
    grams = {f"l{i:03}": langid.grams_of([f"wort{i} nur{i} hier{chr(97 + i % 26)}"])[0] for i in range(70)}
    model = langid.Model(grams)
    for i, (name, found) in enumerate(sorted(grams.items())):
        for at in model._slots(found):
            assert ((model.table[i // 64][at] >> langid.np.uint64(i % 64)) & langid.np.uint64(1)).all(), name


def test_language_of_odd_rows(spark):
    docs = odd.documents(spark)
    rows = langid.identify(docs, langid.learn(docs)).collect()
    assert len(rows) == len(odd.ROWS)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (3, 4, 5, 8)} == {"und"}
    assert all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    assert {r["lang_pred"] for r in langid.report(docs.limit(3).filter("false")).collect()} == set()
    none = langid.identify(docs, langid.learn(odd.no_documents(spark))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert langid.keep_identified(docs).columns == docs.columns


PAGE = """<!DOCTYPE html><html><head><title>T &am</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x>y">menu one</a></li><li>menu two</li></ul></nav>
<div class="cookie-notice">We use cookies on this site.</div><aside>Other things to read elsewhere</aside>
<%s><h1>The  heading</h1><p>First <b>par</b>agraph &amp; more\n words of text that go on for a while.<br>Next line.
<p>Second paragraph with some more words in it.<div class="ad">Buy this now</div><form>Search <input></form>
<p>Third one ends here.</%s><div id="comments"><p>Nice one!</p></div><footer>&copy; 2024 somebody</footer></body></html>"""
TEXT = (
    "The heading First paragraph & more words of text that go on for a while. Next line. "
    "Second paragraph with some more words in it. Third one ends here."
)


def test_main_text_of_marked_and_plain_pages(spark):
    pages = spark.createDataFrame([(i, PAGE % ((tag,) * 2)) for i, tag in enumerate(["article", "main", "div"] * 4)], "page_id long, html string")
    for r in html.main_text(pages).collect():
        assert r["text"] == TEXT
    assert html.extract(PAGE % ("div", "div"), {}) == TEXT


def test_long_excluded_parts_do_not_part_an_article():
    one, two = (" ".join(f"{w}{i}" for i in range(100)) for w in ("first", "second"))
    for open_, close in (("script", "script"), ("style", "style"), ('div class="ad"', "div"), ('p class="notice"', "p")):
        page = f"<body><nav>menu one</nav><article><p>{one}</p><{open_}>{'var x = 1; ' * 1500}</{close}><p>{two}</p></article></body>"
        for scores in ({}, {"word p": html.MAX_SCORE}):
            assert html.extract(page, scores) == f"{one} {two}"


@pytest.mark.parametrize(
    "page",
    [
        '<div class="content no-sidebar"><p>{0}</p></div>',
        '<div class="wrap has-sidebar"><article><p>{0}</p></article></div>',
        '<div id="sidebar"><article><p>{0}</p></article></div>',
        '<div class="widget"><p>{0}</p></div>',
        '<article><p class="post-header">{0}</p></article><div class="site-footer">about us</div>',
        '<article><p class="search-results">{0}</p><ul class="comment-list"><li>I like it a lot</li></ul></article>',
        '<main><p>{0}</p></main><div class="sidebar"><p>see also these</p></div>',
        '<p>{0}</p><div class="comments">' + "<p>reader says a lot</p>" * 400 + "</div>",
    ],
)
def test_named_parts(page):
    text = " ".join(f"word{i}" for i in range(40))
    assert html.extract(page.format(text), {}) == text


def test_white_space_and_pages_of_adverts_only():
    assert html.extract("<p>one&nbsp;&#8195;two\u00a0 three&nbsp;</p>", {}) == "one two three"
    assert html.extract('<div class="ad">buy now</div>', {}) == ""


def test_stray_closing_tags_cost_no_walk():
    import time

    page = "<div>" * 20_000 + "<p>some text</p>" + "</span>x" * 20_000 + "<b>" * 20_000 + "<hr>" * 20_000
    start = time.time()
    assert html.extract(page, {"tag div": -0.25}).startswith("some text")
    assert time.time() - start < 3


def test_region_has_the_largest_sum():
    """Against all contiguous regions."""
    draw = random.Random(5)
    names = ["p", "div", "b", "nav", "li", 'div class="ad"', "span", "article"]
    for _ in range(300):
        page = "".join(
            draw.choice([f"<{(n := draw.choice(names))}>", f"</{n.split()[0]}>", f"w{i} " * draw.randint(1, 4)]) for i in range(draw.randint(1, 25))
        )
        scores = {f"word {n}": draw.choice([-2.0, 0.5, 3.0]) for n in ("p", "div", "li", "")} | {f"tag {n}": -draw.random() * 4 for n in ("p", "div", "li", "b")}
        values, skipped = [], False
        runs = html.sequence(page)
        for kind, name, text, never, _ in runs:
            if never:
                values.append(0.0 if skipped else html.NEVER_SCORE)
            elif kind == "word":
                values.append(len(text.split()) * scores.get("word " + name, scores.get("word " + name.split(".")[0], 1.0)))
            else:
                values.append(scores.get("tag " + name, -0.5) / (1 if kind == "tag" else 2))
            skipped = never
        regions = {
            (i, j): sum(values[i : j + 1]) for i in range(len(values)) for j in range(i, len(values)) if sum(values[i : j + 1]) > 1e-9
        }
        best = max(regions.values(), default=0.0)

        def shown(i, j):
            parts = [
                "" if kind == "word" and never else text if kind == "word" else " " if text not in html.INLINE else ""
                for kind, _, text, never, _ in runs[i : j + 1]
            ]
            return " ".join("".join(parts).split())

        equal = {shown(i, j) for (i, j), total in regions.items() if total > best - 1e-9} or {""}
        assert html.extract(page, scores) in equal, page


def test_main_text_equals_the_articles(spark):
    import html as entities

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html.main_text(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        plain = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", inner))
        assert r["text"] == re.sub(r"\s+", " ", entities.unescape(plain)).strip()


def test_main_text_of_odd_rows(spark):
    rows = html.main_text(odd.pages(spark)).collect()
    by = {r["page_id"]: r["text"] for r in rows}
    assert len(rows) == 8 and by[3] == by[4] == "" and by[5] == "deep" and by[1].startswith("words and more")
    assert html.main_text(odd.no_pages(spark)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    pages = odd.pages(spark)
    warc.write(pages, str(tmp_path / "w"), segment_bytes=700, min_revisit=1000)
    rows = warc.read(spark, str(tmp_path / "w")).collect()
    assert len(rows) == 8 and all(r["complete"] for r in rows)
    body = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    by = {r["id"]: r for r in rows}
    assert bytes(by["<urn:capture:7>"]["payload"]) == body[7]
    assert (by["<urn:capture:1>"]["type"], by["<urn:capture:2>"]["type"]) == ("revisit", "response")
    assert by["<urn:capture:1>"]["refers_to"] == "<urn:capture:2>"
    assert by["<urn:capture:1>"]["payload_bytes"] == len(body[1]) == by["<urn:capture:2>"]["payload_bytes"]
    assert sorted(r["type"] for r in rows if "5" in r["id"]) == ["response", "revisit"]
    assert warc.report(spark, odd.no_pages(spark)).count() == 0


def test_warc_of_null_and_repeated_ids(spark):
    """Every row comes back, and of equal payloads all but one of the largest id are revisits."""
    body = "é" * 600
    rows = [(i, u, h) for i, u, h in [(None, None, body), (None, "-", body), (None, None, body), (3, "a", body), (9, "b", body), (9, "c", body)]]
    rows += [(None, "u", "short"), (None, "u", "short"), (9, "d", "other"), (4, "e", "x" * 5000), (None, "z", "y" * 2000), (None, "z", "y" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = Counter(tuple(r) for r in warc.report(spark, pages).collect())
    digest = {h: hashlib.sha1(h.encode()).hexdigest() for _, _, h in rows}
    want = Counter()
    for h in digest:
        same = [i for i, _, x in rows if x == h]
        size = len(h.encode())
        first = max((i for i in same if i is not None), default=None)
        for k, i in enumerate(sorted(same, key=lambda i: (i is not None, i), reverse=True)):
            revisit = size >= 1000 and k > 0
            want[(i, size, digest[h], "revisit" if revisit else "response", first if revisit else None)] += 1
    assert found == want


def test_warc_of_a_long_page_takes_linear_time(spark, tmp_path):
    import time

    pages = spark.createDataFrame([(1, "u", "0123456é" * (3 << 20)), (2, "v", "short")], "page_id long, url string, html string")
    pages = pages.repartition(1)
    start = time.time()
    warc.write(pages, str(tmp_path / "long"))
    found = {r["id"]: r for r in warc.read(spark, str(tmp_path / "long")).select("id", "complete", "payload_bytes").collect()}
    assert found["<urn:capture:1>"]["complete"] and found["<urn:capture:1>"]["payload_bytes"] == 9 * (3 << 20)
    assert time.time() - start < 40
    print("seconds", time.time() - start)


def test_warc_reader_takes_other_archives(spark, tmp_path):
    import gzip

    record = lambda fields, block: ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5;x=1\r\nhello\r\n6\r\n world\r\n0\r\n\r\n"
    sha = hashlib.sha1(b"hello world").hexdigest()
    first = {"WARC-Type": "response", "WARC-Record-ID": "<a>", "WARC-Payload-Digest": f"sha1:{sha}", "WARC-Segment-Number": 1}
    more = lambda n, **x: {"WARC-Type": "continuation", "WARC-Record-ID": f"<a{n}>", "WARC-Segment-Origin-ID": "<a>", "WARC-Segment-Number": n} | {k.replace("_", "-"): v for k, v in x.items()}
    files = {
        "1.warc": record(more(3, WARC_Segment_Total_Length=len(block)), block[60:]),
        "2.warc.gz": gzip.compress(record(first, block[:20])) + gzip.compress(record(more(2), block[20:60])),
        "3.warc": record({"WARC-Type": "response", "WARC-Record-ID": "<b>", "WARC-Segment-Number": 1}, b"half") + b"WARC/1.0\r\nContent-Length: 99\r\n\r\ntorn",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    rows = {r["id"]: r for r in warc.read(spark, str(tmp_path)).collect()}
    assert rows["<a>"]["complete"] and bytes(rows["<a>"]["payload"]) == b"hello world"
    assert not rows["<b>"]["complete"] and rows["<b>"]["payload"] is None and len(rows) == 2


def test_url_rules(spark):
    cases = {
        "http://a.b.org/x": ("a.b.org", "/x", "org/", "allow"),
        "http://ORG": ("org", "", None, None),
        "https://example.org/en/12?q": ("example.org", "/en/12", "example.org/en/1", "block"),
        "x://m.example.org/es/#a": ("m.example.org", "/es/", "example.org/es/", "block"),
        "x://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://a.com/fr/1": ("a.com", "/fr/1", "com/fr/", "allow"),
        "http://a.com/de/://b.org/": ("a.com", "/de/://b.org/", "com/de/", "block"),
        "http://com.net/de/": ("com.net", "/de/", None, None),
        "nothing": ("", "", None, None),
        None: ("", "", None, None),
    }
    rows = spark.createDataFrame([(u,) for u in cases], "url string")
    host, path = urls.host_of(urls.F.col("url")), urls.path_of(urls.F.col("url"))
    found = urls.rule_of(urls.F.col("h"), urls.F.col("p"))
    for r in rows.withColumns({"h": host, "p": path}).withColumn("f", found).collect():
        f = r["f"] or {"rule": None, "verdict": None}
        assert (r["h"], r["p"], f["rule"], f["verdict"]) == cases[r["url"]], r["url"]


def _mixture(counts: Counter, text: str, order: int, least: int) -> list[float]:
    out = []
    padded = urls._START * order + text
    for i in range(order, len(padded)):
        p = 1 / urls.ALPHABET
        for k in range(order + 1):
            context = padded[i - k : i]
            following = {c: n for (x, c), n in counts.items() if x == context}
            total = sum(following.values())
            if total >= least:
                p = (following.get(padded[i], 0) + len(following) * p) / (total + len(following))
        out.append(math.log(p))
    return out


def test_url_scores_equal_brute_force(spark):
    good, bad = ["http://aa.net/x", "http://ab.net/y"], ["http://zz.net/q", "http://zq.net/x1"]
    labelled = spark.createDataFrame([(u, True) for u in good] + [(u, False) for u in bad], "url string, accepted boolean")
    model = urls.train(labelled, 3)
    tested = ["http://aq.net/x", "zz", "é", good[0]]
    scores = {r["url"]: r["score"] for r in urls.score(spark.createDataFrame([(u,) for u in tested], "url string"), model, 3).collect()}
    models = []
    for texts in (good, bad):
        counts: Counter = Counter()
        for t in texts:
            padded = urls._START * 3 + t
            for i in range(3, len(padded)):
                for k in range(4):
                    counts[(padded[i - k : i], padded[i])] += 1
        models.append(counts)
    for u in tested:
        a, r = (_mixture(c, u, 3, urls.MIN_CONTEXT) for c in models)
        assert scores[u] == pytest.approx(sum(x - y for x, y in zip(a, r, strict=True)) / len(u)), u
    assert scores[tested[1]] < scores[tested[0]]


def test_url_grams_meet_no_common_context_as_one_key(spark):
    """A gram's row at a context that many share is dealt by the gram, so no key holds more than its share."""
    grams = spark.range(4000).selectExpr("concat('abc', cast(id as string), 'z') AS gram").selectExpr("substring(gram, 1, 5) AS gram").distinct()
    model = urls.train(spark.createDataFrame([("http://abc.org/z", True), ("http://abd.com/y", False)], "url string, accepted boolean"))
    plan = urls.gram_scores(grams, model)._jdf.queryExecution().analyzed().toString()
    assert "salt" in plan and urls.gram_scores(grams, model).count() == grams.count()


def test_url_filter_of_odd_rows(spark):
    rows = urls.judge(odd.pages(spark)).collect()
    assert len(rows) == 8 and {r["verdict"] for r in rows} <= {"allow", "block"}
    assert {r["host"] for r in rows if r["page_id"] in (2, 3)} == {""}
    assert urls.report(odd.no_pages(spark)).count() == 0


def test_url_models_follow_the_labels(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = urls.judge(pages).filter("rule is null").collect()
    share = lambda part: sum(r["verdict"] == "block" for r in part) / max(1, len(part))
    assert share([r for r in rows if "/es/" in r["path"]]) > 0.9 > 0.5 > share([r for r in rows if "/fr/" in r["path"]])


def test_language_stage_hands_python_small_batches(spark, monkeypatch):
    """The job that makes the kept rows runs with the bounds, and they end with it."""
    text = "der hund und die katze " * 200
    docs = spark.range(4000, numPartitions=1).selectExpr("id AS doc_id", f"'{text}' AS text", "'de' AS lang")
    settings = []
    saved = langid.saved

    def noted(frame, label):
        settings.append({name: spark.conf.get(name) for name in base.BATCHES})
        return saved(frame, label)

    monkeypatch.setattr(langid, "saved", noted)
    before = {name: spark.conf.get(name) for name in base.BATCHES}
    assert langid.keep_identified(docs).count() == 4000
    assert settings == [{name: str(value) for name, value in base.BATCHES.items()}]
    assert before == {name: spark.conf.get(name) for name in base.BATCHES}
