from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bibspark.functions import identity as idt
from bibspark.functions import text as tx
from bibspark.functions import web


def one(spark, column, **values):
    """A column's value over one row of literals."""
    row = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>").alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("name", "key"),
    [("  École ", "ECOLE"), ("Ёлка", "ЕЛКА"), ("Йод", "ЙОД"), ("йод", "ЙОД"), ("naïve", "NAIVE"), ("Việt", "VIET"), ("straße", "STRAßE"), ("", ""), ("Ａ", "Ａ"), ("Ольга", "ОЛЬГА"), ("café", "CAFE")],
)
def test_fold(name, key):
    assert tx.fold_text(name) == key


def test_fold_column_and_buckets(spark):
    rows = spark.createDataFrame([(n,) for n in ("École", "ёж", "42", "Zed", None, "  ")], "n string")
    out = rows.select(tx.fold_or_null(F.col("n")).alias("f")).select("f", tx.bucket(F.col("f")).alias("b")).collect()
    assert [(r.f, r.b) for r in out] == [("ECOLE", "E"), ("ЕЖ", "Е"), ("42", "#"), ("ZED", "Z"), (None, "#"), (None, "#")]


def test_letters():
    assert tx.letter_bounds("Я") == ("Я", "а")
    assert tx.letter_bounds("A") == ("A", "B")
    assert tx.letter_bounds("AB") is None and tx.letter_bounds("#") is None and tx.letter_bounds("a") is None
    assert len(tx.ALPHABET) == 32 + 26 + 1


def test_letter_filters(spark):
    rows = spark.createDataFrame([(x,) for x in ("АННА", "ЯК", "BOB", "ЁЖ", "1984", "[X", "Z")], "f string")
    assert {r.f for r in rows.filter(tx.in_letter(F.col("f"), "А")).collect()} == {"АННА"}
    assert {r.f for r in rows.filter(tx.in_no_letter(F.col("f"))).collect()} == {"ЁЖ", "1984", "[X"}


@pytest.mark.parametrize(("text", "year"), [("2003-06-01", 2003), ("D:20030601", 2003), ("0101-01-01", 0), ("x", 0), ("c. 1999, 2001", 1999), ("99999", 9999), (None, 0)])
def test_year(spark, text, year):
    assert one(spark, tx.parse_year(F.col("t").cast("string")), t=text) == year


@pytest.mark.parametrize(("text", "seconds"), [("2021-05-06", 1620259200), ("2021-31-05", 1622419200), ("", 0), ("2021-32-32", 0), ("nonsense", 0)])
def test_inp_date(spark, text, seconds):
    assert one(spark, tx.inp_date(F.col("t")), t=text) == seconds


@pytest.mark.parametrize(("text", "seconds"), [("2021-05-06 00:00:00", 1620259200), ("2021-05-06 02:00:00+02:00", 1620259200), ("2021-05-06T00:00:00Z", 1620259200), ("2021-05-06 00:00:00.123456", 1620259200), ("?", 0)])
def test_library_timestamp(spark, text, seconds):
    assert one(spark, tx.library_timestamp(F.col("t")), t=text) == seconds


@pytest.mark.parametrize(("raw", "stars"), [(0, None), (1, None), (2, 1), (5, 2), (10, 5)])
def test_rating(spark, raw, stars):
    assert one(spark, tx.rating_stars(F.col("r")), r=raw) == stars


def test_authors(spark):
    assert one(spark, tx.inp_authors(F.col("a")), a="Лем,Станислав,:Liu, Cixin ,:,,:Solo:") == ["Станислав Лем", "Cixin Liu", "Solo"]


@pytest.mark.parametrize(("title", "series", "out"), [("Saga - 2 - Title", "Saga", "Title"), ("Saga - 2 - Title", "Other", "Saga - 2 - Title"), (" T ", "", "T"), ("Saga-1.5-X - Y", "Saga", "X - Y")])
def test_series_prefix(spark, title, series, out):
    assert one(spark, tx.strip_series_prefix(F.col("t"), F.col("s")), t=title, s=series) == out


@pytest.mark.parametrize(
    ("markup", "plain"),
    [("", ""), ("plain", "plain"), ("<p>One</p><p>Two</p>", "One Two"), ("a&mdash;b &lsquo;c&rsquo;", "a—b 'c'"), ("<b>bold</b>text", "bold text"), ("<p>broken", "broken"), ("a < b &amp; c", "a < b & c"), ("x<br>y", "xy"), ("<p> &nbsp; </p>z", "z")],
)
def test_strip_markup(markup, plain):
    assert tx.strip_markup_text(markup) == plain


def test_strip_qualifiers():
    assert tx.strip_qualifiers_text("Death's End (Past [x) y] z) w") == "Death's End  z w"


@pytest.mark.parametrize(
    ("title", "junk"), [("Dune", False), ("Dune Boxed Set", True), ("3 Books of Dune", True), ("Dune, Book 3", False), ("1 Book", False), ("Mindset", False), ("Dune Audiobook", True), ("沙丘", True), ("The Dune Trilogy", True), ("7-book saga", True)]
)
def test_junk_title(spark, title, junk):
    assert one(spark, tx.is_junk_title(F.col("t")), t=title) is junk


@pytest.mark.parametrize(("query", "title", "ok"), [("Dune", "The Dune", True), ("Dune Messiah", "Dune", False), ("", "Anything", True), ("Dune", "", True), ("Dune (Saga)", "Dune", True), ("Dune", "Dune Collection", False)])
def test_title_acceptable(spark, query, title, ok):
    tokens = tx.title_tokens(tx.strip_qualifiers(F.col("q")))
    assert one(spark, tx.title_acceptable(tokens, F.col("t")), q=query, t=title) is ok


@pytest.mark.parametrize(("code", "base"), [("en-US", "en"), ("EN", "en"), ("eng", "en"), ("ger", "de"), ("und", ""), ("english", ""), ("", ""), (" ru ", "ru"), ("en-Latn-US", "en"), ("grc", "grc"), ("zz", ""), ("pt_BR", "pt"), (None, ""), ("iw", "he"), ("in-ID", "id"), ("xyz", "")])
def test_language(spark, code, base):
    assert one(spark, idt.language(F.col("c").cast("string")), c=code) == base


@pytest.mark.parametrize(("value", "ok"), [("978-0-306-40615-7", True), ("9780306406158", False), ("0-306-40615-2", True), ("080442957X", True), ("1234567890123", False), ("abc", False), ("4006381333931", False)])
def test_isbn(spark, value, ok):
    assert one(spark, idt.is_isbn(F.col("v")), v=value) is ok


def test_clean_identifiers(spark):
    pairs = [("ISBN", "urn:isbn:0-306-40615-2"), ("isbn-13", "978-0-306-40615-7"), ("isbn", "9780000000002"), ("asin", "b000fa"), ("amazon", "B0"), ("amazon", "c000fa"), ("uuid", "x"), ("x", "urn:uuid:1"), ("doi", "{12345678-1234-1234-1234-123456789abc}"), ("doi", "10.1/x"), ("", "y"), ("z", " "), ("nil", "00000000-0000-0000-0000-000000000000")]
    rows = spark.createDataFrame([(pairs,)], "i array<struct<type:string,value:string>>")
    got = rows.select(idt.clean_identifiers(F.col("i")).alias("x")).first()["x"]
    assert [tuple(r) for r in got] == [("amazon", "C000FA"), ("doi", "10.1/x"), ("isbn", "9780306406157"), ("nil", "00000000-0000-0000-0000-000000000000")]


@pytest.mark.parametrize(("type_", "value", "strong"), [("isbn", "9780306406157", True), ("isbn", "9780306406158", False), ("amazon", "0000000000", False), ("amazon", "B01", True), ("doi", "10.1", False)])
def test_strong(spark, type_, value, strong):
    assert one(spark, idt.is_strong(F.col("t"), F.col("v")), t=type_, v=value) is strong


def test_genres(spark):
    assert one(spark, idt.genres(F.col("g")), g=["sf", "Fiction / science fiction / Space Opera", " HISTORY ", "nope", "", "sf_fantasy"]) == ["Science Fiction", "History", "Fantasy"]
    assert len(idt.GENRES) == 38


def test_group_key(spark):
    key = lambda t, a, lang: one(spark, idt.group_key(F.col("t"), F.col("a"), F.col("l")), t=t, a=a, l=lang)
    assert key("The Three-Body Problem ", ["Liu, Cixin"], "EN") == key("the three-body problem", ["Cixin Liu"], "en")
    assert key("X", ["A B", "C"], "") == key("x", ["c", "B, A"], "und")
    assert key("X", ["A"], "en") != key("X", ["A"], "de")


def test_short_number(spark):
    for value, text in ((2.0, "2"), (1.5, "1.5"), (None, ""), (-3.0, "-3")):
        assert one(spark, idt.short_number(F.col("v").cast("double")), v=value) == text


def test_distinct_folds(spark):
    assert one(spark, idt.distinct_folds(F.col("n")), n=[" Ann ", "ANN", "", "Bob", "bob "]) == ["Ann", "Bob"]


def test_images(spark):
    assert one(spark, web.resized_image(F.col("u")), u="https://x/a._AC_UL320_.JPG") == "https://x/a.jpg"
    assert one(spark, web.thumbnail(F.col("u"), 450), u="https://x/a._SX50_SY75_.png") == "https://x/a._SY450_.png"
    assert one(spark, web.resized_image(F.col("u")), u="https://x/a.jpg") == "https://x/a.jpg"
    assert one(spark, web.largest_image(F.col("j")), j='{"b": [1, 9], "a": [3, 3], "c": [2, 2]}') == "a"
    assert one(spark, web.largest_image(F.col("j")), j="{}") is None


def test_addresses(spark):
    assert one(spark, web.identifier_url(F.col("t"), F.col("v")), t="amazon", v="B1") == "https://www.amazon.com/dp/B1"
    assert one(spark, web.identifier_url(F.col("t"), F.col("v")), t="doi", v="x") is None
    assert one(spark, web.mime(F.col("f")), f="EPUB") == "application/epub+zip"
    assert one(spark, web.rfc3339(F.col("s")), s=0) == "1970-01-01T00:00:00Z"
