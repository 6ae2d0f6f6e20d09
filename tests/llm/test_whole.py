"""Cases in which an operator once did less than the whole job."""

import base64
import random
import textwrap

import pytest
from pyspark.sql import functions as F

from meridian.llm import html_extract as he
from meridian.llm import licenses as lic
from meridian.llm import warc
from meridian.llm.quality_rules import cleaned_documents, quality_rules

from .helpers import documents


def seen(source):
    """All text of a page that is judged."""
    page = he.Page(source)
    return he.main_text(page, [True] * len(page.tag))


# ---- pages


ARTICLE = "<article><h1>Head</h1><p>First <b>bold</b> words here, and more of them.<p>Second paragraph is here as well.</article>"
ARTICLE_TEXT = "Head\n\nFirst bold words here, and more of them.\n\nSecond paragraph is here as well."


@pytest.mark.parametrize("top", ["<html><head><title>t</title><body>", "<html><head><title>t</title><meta charset=utf-8><link rel=x>", "<head><script>x</script><style>p{}</style>", "<head></html>", "<head><title>t</title></head><body><head>"])
def test_a_head_without_end_tag_hides_no_text(top):
    source = top + ARTICLE
    assert seen(source) == ARTICLE_TEXT
    assert he.extract([source], he.trained()) == [ARTICLE_TEXT]


def test_text_ends_a_head():
    assert seen("<head><title>t</title>plain text") == "plain text" and seen("<head>one<p>two") == "one\n\ntwo"
    assert seen("<head> <title>t</title> <noscript>n</noscript> </head>") == ""


@pytest.mark.parametrize("odd", ['<svg class="i"/>', "<svg-icon></svg-icon>", "<title-bar></title-bar>", "<template-x></template-x>", "<style-guide/>", '<svg class="i"><path d="M0 0"/>', "<svg><title/><style/><path d=x>", "<svg><g><svg></svg><text>label</text></g></svg>", "<svg><style>a > b {}</style><title>icon</title></svg>", "<script>1</script >", "<svg><foreignObject><p>label</p></foreignObject></svg>"])
def test_odd_raw_elements_hide_nothing_else(odd):
    source = f"<body>{ARTICLE.replace('<p>Second', f'<p>{odd}</p><p>Second')}<svg></svg>"
    assert seen(source) == ARTICLE_TEXT
    assert he.extract([source], he.trained()) == [ARTICLE_TEXT]


def test_an_unclosed_svg_ends_at_an_outer_end_tag():
    assert seen("<p>one <a href=x><svg><path d=y></a> two</p>") == "one two"
    assert seen("<div><svg><desc><p>label</div>after") == "after"
    assert seen("<p>one<svg") == "one" and seen("<p>one<svg>label") == "one"


def test_text_of_math_and_fallback_of_object_are_judged():
    assert seen("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>") == "so x=2 holds"
    assert seen("<p>see <object data=f><param name=a>a picture</object> here</p>") == "see a picture here"


# ---- licences


def license_ids(spark, texts):
    got = {r.doc_id: r.license_id for r in lic.scan_licenses(documents(spark, texts)).collect()}
    return [got[i] for i in range(len(texts))]


def test_the_sql_knows_the_long_licences(spark):
    from meridian.llm.queries import long_digests
    assert {r.digest for r in lic.known(spark, lic.full_texts()).collect()} == {d for _, d in long_digests()}


def test_whole_texts_of_long_licences(spark):
    names, texts = zip(*dict(reversed(lic.full_texts())).items())
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "BSL-1.0"} <= set(names)
    filled = next(t for i, t in lic.full_texts() if i == "Apache-2.0").replace("[yyyy] [name of copyright owner]", "2024 someone")
    bare = filled.partition(lic.TERMS_END)[0]
    reflowed = " ".join(bare.split())
    assert license_ids(spark, [*texts, filled, bare, reflowed, bare + "and more"]) == [*names, "Apache-2.0", "Apache-2.0", "Apache-2.0", None]


@pytest.mark.parametrize("line", ["Copyright Joyent, Inc. and other Node contributors.", "Copyright The Authors", "Copyright <YEAR> <NAME>", "Portions Copyright (c) 2001 X", "Copyright (c) 2020 A\nCopyright B and C\nPortions copyright D"])
def test_copyright_lines_that_name_no_year(spark, line):
    texts = dict(reversed(lic.KNOWN_TEXTS[:15]))
    wrapped = ["\n".join(textwrap.wrap(texts[i], 30 + n)) for i in ("MIT", "BSD-3-Clause") for n in range(12)]
    assert any("\ncopyright" in x for x in wrapped)
    got = license_ids(spark, [f"{line}\n\n{t}" for t in [*texts.values(), *wrapped]] + [f"{texts['ISC']}\n{line}", line, f"{texts['MIT']}\nand {line}"])
    assert got == [*texts, *["MIT"] * 12, *["BSD-3-Clause"] * 12, "ISC", None, None]


# ---- archives


def test_records_with_long_headers_are_read(spark):
    r = random.Random(5)
    urls = ["data:text/html;base64," + base64.b64encode(r.randbytes(n)).decode() for n in (70_000, 150_000, 900_000)] + ["http://x/"]
    df = spark.createDataFrame([(i, u, f"<p>{'same words ' * 200}</p>") for i, u in enumerate(urls)] + [(9, urls[2], "<p>own</p>")], "page_id long, url string, html string")
    got = {x.page_id: x for x in warc.round_trip(df).collect()}
    assert {i: x.url for i, x in got.items()} == {**dict(enumerate(urls)), 9: urls[2]}
    assert [got[i].refers_to for i in (0, 1, 2, 3, 9)] == [3, 3, 3, None, None]
    assert len({(got[i].payload_bytes, got[i].payload_digest) for i in range(4)}) == 1 and got[9].payload_bytes == 10
    # The response that others refer to is the one with the long header.
    back = df.where("page_id < 4").withColumn("page_id", -F.col("page_id"))
    assert all(x.payload_bytes == got[0].payload_bytes for x in warc.round_trip(back).collect()) and warc.round_trip(back).count() == 4


# ---- quality rules


def test_lines_above_the_limit_are_removed_from_the_text(spark):
    body = ["\n\n".join(f"  Line {k} of {i} " + "and words " * 9 for k in range(3)) for i in range(4)]
    texts = [f"Common  LINE\n{body[i]}\n common line \n\nend {i}\n" for i in range(4)] + ["other host\nCommon line", None, "common line", "Common line\nCommon line"]
    hosts = {i: "a" for i in range(4)} | {4: "b", 5: "a", 6: None, 7: "a"}
    docs = documents(spark, texts, hosts).withColumn("source", F.when(F.col("doc_id") != 6, F.col("source")))
    rows = {r.doc_id: r for r in cleaned_documents(docs.unionAll(docs.where("doc_id = 1")), max_docs_per_host=2).collect()}
    assert [rows[i].text for i in range(8)] == [f"{body[i]}\n\nend {i}\n" for i in range(4)] + [texts[4], "", texts[6], ""]
    for r in rows.values():
        assert len("".join(r.text.split())) == r.word_chars - r.removed_chars
    assert "text" not in quality_rules(docs).columns
