"""Names, letters, dates, markup and titles.

What Spark can express is a Column expression; Unicode decomposition, entity-aware XML and nested brackets are pandas UDFs
over Arrow batches.  Folds are computed once, at ingest, and stored.
"""

from __future__ import annotations

import html
import re
import unicodedata
import xml.parsers.expat
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that count as white space, as text to strip and as a class for regular expressions.
WHITE = " \t\n\v\f\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WHITE_CLASS = "[ \\t\\n\\x0B\\f\\r\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"

#: The alphabet in display order.
CYRILLIC = [chr(c) for c in range(ord("А"), ord("Я") + 1)]
LATIN = [chr(c) for c in range(ord("A"), ord("Z") + 1)]
OTHER = "#"
ALPHABET = [*CYRILLIC, *LATIN, OTHER]


# ---- folds -----------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=4096)
def _is_latin(ch: str) -> bool:
    return unicodedata.name(ch, "").startswith("LATIN ") or ch in "ªº"


def fold_text(text: str) -> str:
    """Upper case by single characters, accents off Latin letters, Ё as Е; other scripts keep their marks."""
    upper = "".join(u if len(u := c.upper()) == 1 else c for c in text.strip(WHITE))
    out, latin = [], False
    for ch in unicodedata.normalize("NFD", upper):
        mark = unicodedata.category(ch) == "Mn"
        if mark and latin:
            continue
        if not mark:
            latin = _is_latin(ch)
        out.append(ch)
    return unicodedata.normalize("NFC", "".join(out)).replace("Ё", "Е")


@F.pandas_udf(T.StringType())
def fold(names: pd.Series) -> pd.Series:
    """The key that merges spellings of a name and files it under a letter."""
    return names.map(lambda x: None if x is None else fold_text(x))


@F.pandas_udf(T.ArrayType(T.StringType()))
def fold_all(lists: pd.Series) -> pd.Series:
    """The folds of a list of names, in its order."""
    return lists.map(lambda xs: None if xs is None else [None if x is None else fold_text(x) for x in xs])


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def fold_or_null(name: Column) -> Column:
    """fold(); null for a null or blank name."""
    return F.when(trimmed(name) != "", fold(name))


def bucket(folded: Column) -> Column:
    """The alphabet bucket of a folded name: its first letter, else '#'."""
    first = F.substring(folded, 1, 1)
    inside = first.between(CYRILLIC[0], CYRILLIC[-1]) | first.between(LATIN[0], LATIN[-1])
    return F.when(inside, first).otherwise(OTHER)


def letter_bounds(letter: str) -> tuple[str, str] | None:
    """The half-open range of folded names under a letter; None for any other text."""
    if letter not in ALPHABET or letter == OTHER:
        return None
    return letter, chr(ord(letter) + 1)


def in_letter(folded: Column, letter: str) -> Column:
    """A filter that Parquet statistics can use."""
    low, high = letter_bounds(letter)
    return (folded >= low) & (folded < high)


def in_no_letter(folded: Column) -> Column:
    return ~(((folded >= CYRILLIC[0]) & (folded < chr(ord(CYRILLIC[-1]) + 1))) | ((folded >= LATIN[0]) & (folded < chr(ord(LATIN[-1]) + 1))))


# ---- numbers and dates -----------------------------------------------------------------------------------------------


def parse_year(text: Column) -> Column:
    """The first run of four digits if it is 1000 or more, else 0."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), "[0-9]{4}", 0)
    return F.when((found == "") | (found < "1000"), 0).otherwise(found.try_cast("int")).cast("int")


def series_index(text: Column) -> Column:
    """A series position, 0 if it isn't a number."""
    return F.coalesce(trimmed(text).try_cast("double"), F.lit(0.0))


def inp_date(text: Column) -> Column:
    """Seconds of a Y-M-D date, else of a Y-D-M date, else 0."""
    clean = trimmed(text)
    shaped = F.when(clean.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), clean)
    found = F.coalesce(F.try_to_timestamp(shaped, F.lit("yyyy-MM-dd")), F.try_to_timestamp(shaped, F.lit("yyyy-dd-MM")))
    return F.coalesce(F.unix_timestamp(found), F.lit(0)).cast("long")


def library_timestamp(text: Column) -> Column:
    """Seconds of a timestamp with or without fraction and zone, by a blank or a T; 0 if it has another form."""
    clean = F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]+)?([+-][0-9]{2}:[0-9]{2}|Z)?$"), text)
    return F.coalesce(F.unix_seconds(F.to_utc_timestamp(F.try_to_timestamp(clean), "UTC")), F.lit(0)).cast("long")


def rating_stars(raw: Column) -> Column:
    """Half stars 0 to 10 as whole stars 1 to 5; null below one star."""
    return F.when(raw >= 2, F.floor(raw / 2)).cast("int")


# ---- authors and series ----------------------------------------------------------------------------------------------


def listed(field: Column) -> Column:
    """The parts of a list separated by colons, trimmed, blanks left out."""
    return F.filter(F.transform(F.split(field, ":"), trimmed), lambda x: x != "")


def inp_authors(field: Column) -> Column:
    """'Last,First,Middle:...' as names 'First Middle Last'."""

    def name(author: Column) -> Column:
        parts = F.transform(F.split(author, ","), trimmed)
        turned = F.concat(F.slice(parts, 2, 1 << 20), F.slice(parts, 1, 1))
        return F.array_join(F.filter(turned, lambda p: p != ""), " ")

    return F.filter(F.transform(listed(field), name), lambda n: n != "")


def strip_series_prefix(title: Column, series: Column) -> Column:
    """'{series} - {n} - {title}' as the title alone, if the series is the same."""
    pattern = "^(.+?)\\s*-\\s*[0-9]+(?:\\.[0-9]+)?\\s*-\\s*(.+)$"
    clean = trimmed(title)
    same = (series != "") & clean.rlike(pattern) & (trimmed(F.regexp_extract(clean, pattern, 1)) == series)
    return F.when(same, trimmed(F.regexp_extract(clean, pattern, 2))).otherwise(clean)


# ---- markup ----------------------------------------------------------------------------------------------------------

#: Named entities that text may hold beyond XML's own.
ENTITIES = {
    "nbsp": " ",
    "ndash": "–",
    "mdash": "—",
    "ldquo": "“",
    "rdquo": "”",
    "copy": "©",
    "reg": "®",
    "trade": "™",
    "hellip": "…",
    "bull": "•",
    "middot": "·",
    "laquo": "«",
    "raquo": "»",
    "euro": "€",
    "pound": "£",
    "yen": "¥",
    "cent": "¢",
}
#: In text to be searched, curly single quotes are apostrophes; in text to be shown, they stay.
SEARCHED = ENTITIES | {"lsquo": "'", "rsquo": "'"}
SHOWN = ENTITIES | {"lsquo": "‘", "rsquo": "’"}
_DTD = "".join(f'<!ENTITY {k} "&#{ord(v)};">' for k, v in SEARCHED.items())


def _xml_texts(fragment: str) -> list[str] | None:
    """The text nodes of a fragment in order; None if it isn't well formed."""
    texts: list[str] = []
    pieces: list[str] = []

    def close(*_):
        if (t := "".join(pieces).strip(WHITE)):
            texts.append(t)
        pieces.clear()

    parser = xml.parsers.expat.ParserCreate()
    parser.CharacterDataHandler = pieces.append
    parser.StartElementHandler = parser.EndElementHandler = parser.CommentHandler = parser.ProcessingInstructionHandler = close
    try:
        parser.Parse(f"<!DOCTYPE root [{_DTD}]><root>{fragment}</root>", True)
    except (xml.parsers.expat.ExpatError, ValueError):
        return None
    return texts


def strip_markup_text(fragment: str) -> str:
    """Plain text of an XML or HTML fragment: text nodes with single blanks between them; malformed ones lose their tags."""
    texts = _xml_texts(fragment) if fragment else []
    if texts is not None:
        return " ".join(texts)
    plain = html.unescape(re.sub("<[^>]*>", "", fragment))
    return " ".join(w for w in re.split(f"[{re.escape(WHITE)}]+", plain) if w)


@F.pandas_udf(T.StringType())
def strip_markup(fragments: pd.Series) -> pd.Series:
    return fragments.map(lambda x: None if x is None else strip_markup_text(x))


def strip_tags(text: Column) -> Column:
    """Tags deleted and white space collapsed: the malformed branch before entities, in Spark's own functions."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", ""), "[ \\t\\n\\x0B\\f\\r]+", " "), F.lit(" "))


# ---- titles ----------------------------------------------------------------------------------------------------------

#: Words that don't count in a title, marks of other kinds of edition, and words of multi-book products.
STOPWORDS = ["the", "a", "an", "of", "and", "to"]
JUNK_MARKERS = ["audiobook", "audio cd", "audible audiobook", "bulk pack", "free sampler", "(a book companion)", "study guide", "supersummary", "sparknotes", "cliffsnotes"]
COLLECTION_WORDS = ["set", "collection", "boxset", "omnibus", "anthology", "bundle", "trilogy"]


def strip_qualifiers_text(title: str) -> str:
    depth, out = 0, []
    for ch in title:
        if ch in "([":
            depth += 1
        elif ch in ")]":
            depth = max(0, depth - 1)
        elif not depth:
            out.append(ch)
    return "".join(out)


@F.pandas_udf(T.StringType())
def strip_qualifiers(titles: pd.Series) -> pd.Series:
    """Titles without what stands in round or square brackets, nested ones too."""
    return titles.map(lambda x: None if x is None else strip_qualifiers_text(x))


def title_tokens(title: Column) -> Column:
    """Lower-case runs of letters and digits, stopwords left out."""
    words = F.split(F.lower(F.regexp_replace(title, "[^\\p{L}\\p{Nd}]+", " ")), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(STOPWORDS))


def is_junk_title(title: Column) -> Column:
    """An edition that isn't the book itself: another script, an aid, or several books in one."""
    tokens = title_tokens(title)
    low = F.lower(title)
    marked = low.contains(JUNK_MARKERS[0])
    for m in JUNK_MARKERS[1:]:
        marked = marked | low.contains(m)
    several = F.array_join(tokens, " ").rlike("(^| )0*([2-9]|[1-9][0-9]+) books?( |$)")
    return title.rlike("[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsHangul}]") | marked | F.arrays_overlap(tokens, F.array(*map(F.lit, COLLECTION_WORDS))) | several


def title_matches(query_tokens: Column, title: Column) -> Column:
    return F.size(F.array_except(query_tokens, title_tokens(title))) == 0


def title_acceptable(query_tokens: Column, title: Column) -> Column:
    """Whether a candidate's title may stand for the title asked for; query_tokens are title_tokens(strip_qualifiers(query))."""
    return F.when(is_junk_title(title), False).when((F.size(query_tokens) == 0) | (trimmed(title) == ""), True).otherwise(title_matches(query_tokens, title))
