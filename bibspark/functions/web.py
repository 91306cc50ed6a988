"""Addresses of books and covers, and how values are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The size part of an image's address at two shops, MIME types, and places of identifiers.
_SIZED = "(?i)\\._[a-z0-9,_]+_\\.(jpg|jpeg|png|gif)$"
MIME = {"epub": "application/epub+zip", "fb2": "application/x-fictionbook+xml", "mobi": "application/x-mobipocket-ebook", "azw": "application/vnd.amazon.ebook", "azw3": "application/vnd.amazon.ebook", "pdf": "application/pdf"}
PLACES = {"amazon": "https://www.amazon.com/dp/", "goodreads": "https://www.goodreads.com/book/show/", "google": "https://books.google.com/books?id=", "isbn": "https://isbnsearch.org/isbn/"}


def resized_image(url: Column, size: str = "") -> Column:
    """An image address with its size part replaced before the lower-case ending; addresses without one stay."""
    ending = F.lower(F.regexp_extract(url, _SIZED, 1))
    return F.when(url.rlike(_SIZED), F.concat(F.regexp_replace(url, _SIZED, ""), F.lit(f"{size}."), ending)).otherwise(url)


def thumbnail(url: Column, height: int) -> Column:
    return resized_image(url, f"._SY{height}_")


def secure(url: Column) -> Column:
    return F.regexp_replace(url, "^http://", "https://")


def without_curl(url: Column) -> Column:
    """Without the parameter that adds a curled page edge."""
    return F.regexp_replace(F.regexp_replace(url, "&edge=curl|edge=curl&", ""), "\\?edge=curl$", "")


def largest_image(images: Column) -> Column:
    """Of a JSON object from address to [width, height], the address with the largest area, the smallest address of equals."""
    entries = F.map_entries(F.from_json(images, "map<string,array<int>>"))
    sized = F.transform(entries, lambda e: F.struct((-(F.get(e["value"], F.lit(0)).cast("long") * F.get(e["value"], F.lit(1)))).alias("a"), e["key"].alias("u")))
    return F.get(F.array_sort(F.filter(sized, lambda s: s["a"].isNotNull())), F.lit(0))["u"]


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def identifier_url(type_: Column, value: Column) -> Column:
    return F.concat(_lookup(PLACES, type_), value)


def mime(file_format: Column) -> Column:
    return F.coalesce(_lookup(MIME, F.lower(file_format)), F.lit("application/octet-stream"))


def rfc3339(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def plural(count: Column, one: str) -> Column:
    return F.concat(count.cast("string"), F.when(count == 1, F.lit(f" {one}")).otherwise(F.lit(f" {one}s")))
