import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from gablework.functions import (
    clean_text,
    decode_entities,
    element_links,
    element_texts,
    list_page_url,
    location_parts,
    pair_map,
    parse_int,
    parse_number,
    parse_price,
    property_type_from_url,
    resolve_url,
    word_ngrams,
    words,
)
from gablework.functions.html import page_tokens
from gablework.operators.normalize import validate

NUMBERS = [
    ("1.234,56", 1234.56),
    ("3.5", 3.5),
    ("1000", 1000.0),
    ("1.500", 1500.0),
    ("1,500", 1500.0),
    ("0.500", 500.0),
    ("1234.567", 1234.567),
    ("1.234.567", 1234567.0),
    ("1,234,567", 1234567.0),
    ("1.234.567,89", 1234567.89),
    ("1,234,567.89", 1234567.89),
    ("1.234,567.8", None),
    ("1,234.567,89", None),
    ("-5", 5.0),
    ("khoảng 70 m²", 70.0),
    ("٣ m", 3.0),
    ("không rõ", None),
    ("", None),
    (None, None),
]


def test_parse_number(spark):
    rows = spark.createDataFrame([(t,) for t, _ in NUMBERS], "t string").select(parse_number(F.col("t"))).collect()
    assert [r[0] for r in rows] == [v for _, v in NUMBERS]


def test_parse_int_rounds_half_to_even(spark):
    texts = ["2,5 phòng", "3,5", "4", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_int(F.col("t"))).collect()
    assert [r[0] for r in rows] == [2, 4, 4, None]


PRICES = [
    ("2 tỷ", 100.0, 2e9, 2e7),
    ("3.5 triệu", 70.0, 3.5e6, 5e4),
    ("2 tỷ 500 triệu", 100.0, 2.5e9, 2.5e7),
    ("50 triệu/m2", 80.0, 4e9, 5e7),
    ("50 triệu/m²", None, None, 5e7),
    ("50 triệu/m²", 0.0, None, 5e7),
    ("2 tỷ 500 triệu/m²", 10.0, 2e10, 2e9),
    ("0 tỷ", 50.0, None, None),
    ("Thỏa thuận", 50.0, None, None),
    ("0 triệu/m²", 80.0, 0.0, 0.0),
    ("2 - 3 tỷ", None, 3e9, None),
    ("2 tỷ 500", None, 2e9, None),
    ("15 type", None, 1.5e10, None),
    ("2 TỶ", None, 2e9, None),
    ("1,5 TRIỆU", None, 1.5e6, None),
    ("2 ty", None, 2e9, None),
    ("2 tỉ", None, None, None),
    (None, 50.0, None, None),
]


def test_parse_price(spark):
    df = spark.createDataFrame([(t, a) for t, a, _, _ in PRICES], "t string, a double")
    rows = df.select(parse_price(F.col("t"), F.col("a")).alias("p")).select("p.total", "p.per_m2").collect()
    assert [(r.total, r.per_m2) for r in rows] == [(t, p) for _, _, t, p in PRICES]


def test_clean_text(spark):
    texts = [" a 　b\tc  d\x1c", "   ", "", None, "x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(clean_text(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["a b c d", None, None, None, "x"]


def test_urls(spark):
    cases = [
        ("https://h/ban-nha-rieng-duong-x-tai-phuong-1-quan-2-ha-noi/pr1", "house", "ha-noi", "2", "quan"),
        ("/ban-dat-tai-hue?x=1", "land", "hue", None, None),
        ("x-tai-a-b", None, "a-b", None, None),
        ("a-tai", None, None, None, None),
        ("https://h", None, None, None, None),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "u string")
    rows = df.select(property_type_from_url(F.col("u")).alias("t"), location_parts(F.col("u")).alias("l")).collect()
    assert [(r.t, r.l.province_slug, r.l.district_slug, r.l.ward_slug) for r in rows] == [c[1:] for c in cases]
    links = spark.createDataFrame([("/a",), ("//o/b",), ("c",), ("https://z/q",)], "h string")
    assert [r[0] for r in links.select(resolve_url(F.col("h"), "https://s")).collect()] == [
        "https://s/a", "https://o/b", "https://s/c", "https://z/q",
    ]
    page = spark.range(1).select(list_page_url(F.lit(3), extra={"q": "a b~*", "z": None})).first()[0]
    assert page.endswith("?vrs=1&page=3&q=a+b~%2A")


def test_page_parts(spark):
    html = """<div class="re__srp-list x"><div class='re__card-full'><a class="foo" href="/no">n</a>
    <a href="/x?a=1&amp;b=2" class="js__product-link-for-product-id z"><h3>Nh&agrave; &#7841;&#x1EF7; &unk;</h3></a></div>
    <div class="re__card-full"><a class="js__product-link-for-product-id">no href</a></div>
    <div class="re__card-full-label-verified"><a class="js__product-link-for-product-id" href="y">z</a>
    <a class="js__product-link-for-product-id" href="second">z</a></div>
    <div class="re__card-full"><a class="js__product-link-for-product-id" href="y">again</a></div></div>
    <div class="re__card-full"><a class="js__product-link-for-product-id" href="/outside">z</a></div>
    <script>var a="<div class='re__section-body'>"</script>
    <div class="re__section-body">own <p>one<br>two <b>three</p><ul><li>four<li> five </ul></div><p>out</p>"""
    row = (
        spark.createDataFrame([(html,)], "h string")
        .select(page_tokens(F.col("h")).alias("t"))
        .select(
            element_links(
                F.col("t"), "div.re__srp-list", ["div.re__card-full", "div.re__card-full-label-verified"],
                "a.js__product-link-for-product-id", "https://s",
            ).alias("links"),
            element_texts(F.col("t"), [".re__section-body", "*"]).alias("body"),
            element_texts(F.col("t"), ["h3"]).alias("h3"),
        )
        .first()
    )
    assert row.links == ["https://s/x?a=1&b=2", "https://s/y"]
    assert row.body == ["one", "two", "three", "four", "five"]
    assert row.h3 == ["Nhà ạỷ &unk;"]


def test_pairs_entities_and_ngrams(spark):
    row = spark.range(1).select(
        pair_map(F.array(*map(F.lit, "aba")), F.array(*map(F.lit, "1234"))).alias("pairs"),
        decode_entities(F.lit("&lt;&#128512;&nbsp;&eacute;&#0;")).alias("text"),
        word_ngrams(words(F.lit("Nhà đẹp 1 ở HCM_x"))).alias("grams"),
        word_ngrams(words(F.lit(""))).alias("none"),
    ).first()
    assert row.pairs == {"b": "2", "a": "3"}
    assert row.text == "<😀 é�"
    assert row.grams == ["nhà", "đẹp", "hcm_x", "nhà đẹp", "đẹp hcm_x"]
    assert row.none == []


def test_links_to_parent_folders(spark):
    from gablework.functions.urls import resolve_url

    links = {
        "../x": "/x",
        "../../x/y": "/x/y",
        "./a": "/a",
        "a/../b": "/b",
        "a/b/../../c?d=../e": "/c?d=../e",
        "a/b/../c": "/a/c",
        "/p/q": "/p/q",
        "?q=1": "?q=1",
    }
    df = spark.createDataFrame([(k,) for k in links], "href string")
    got = {r.href: r.url for r in df.select("href", resolve_url(F.col("href"), "https://site.example/").alias("url")).collect()}
    assert got == {k: "https://site.example" + v for k, v in links.items()}


def test_links_resolve_like_the_standard_library(spark):
    draw = random.Random(4)
    steps = ["a", "b", "c.html", ".", "..", "..", "", "x y", "...", "..z"]
    hrefs = ["/".join(draw.choice(steps) for _ in range(draw.randint(1, 12))) for _ in range(400)]
    hrefs += ["/".join(["d"] * 9 + [".."] * 6 + ["e"]), "/k/../l", "a/../../../b?q=../x#../y", "?p=1", "#top", "a/..", "a/.", "..", "/"]
    hrefs = [h for h in hrefs if h and not h.startswith("//")]
    rows = spark.createDataFrame([(h,) for h in hrefs], "href string").select("href", resolve_url(F.col("href"), "https://site.vn").alias("u")).collect()
    wrong = [(r.href, r.u, urljoin("https://site.vn", r.href)) for r in rows if r.u != urljoin("https://site.vn", r.href)]
    assert not wrong, wrong[:5]


def test_values_that_are_no_numbers_are_invalid(spark):
    rows = [("1", "5e9", "40"), ("2", '{"a": 1}', "40"), ("3", "[1]", '"wide"'), ("4", '"5 ty"', "null"), ("5", "null", None), ("6", "-1", "true")]
    df = spark.createDataFrame(rows, "url string, p string, a string").select(
        "url", F.try_parse_json("p").alias("price_vnd"), F.try_parse_json("a").alias("area_m2"), F.lit(None).cast("double").alias("price_per_m2_vnd")
    )
    found = {r.url: r.validation_errors for r in validate(df).collect()}
    assert found == {"1": [], "2": ["price_invalid"], "3": ["price_invalid", "area_invalid"], "4": ["price_invalid"], "5": [], "6": ["price_non_positive"]}
    text = spark.createDataFrame([("1", "12", 50.0)], "url string, price_vnd string, area_m2 double")
    assert validate(text).first().validation_errors == ["price_invalid"]
