"""Metadata of book files: EPUB, FB2 (plain or zipped), MOBI family and PDF.

Files come from Spark's binaryFile reader and are parsed in Arrow batches; a file that can't be parsed yields null.  Reads
are bounded: structural text at 64 MiB, covers at 10 MiB.
"""

from __future__ import annotations

import base64
import binascii
import html
import io
import posixpath
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SHOWN, WHITE
from ..schema import METADATA
from . import pdf as pdf_file

TEXT_MOST, COVER_MOST = 64 << 20, 10 << 20
#: Endings and formats, the longest ending first.
ENDINGS = {".fb2.zip": "fb2", ".epub": "epub", ".azw3": "azw3", ".mobi": "mobi", ".fb2": "fb2", ".azw": "azw", ".pdf": "pdf"}

Metadata = dict


def file_format(path: Column) -> Column:
    """The format of a path by its ending; null for others."""
    low, out = F.lower(path), F.lit(None).cast("string")
    for ending, name in reversed(ENDINGS.items()):
        out = F.when(low.endswith(ending), name).otherwise(out)
    return out


def _blank() -> Metadata:
    return {"title": "", "authors": [], "genres": [], "annotation": "", "series": "", "series_number": 0.0, "language": "", "publisher": "", "year": 0, "pages": 0, "identifiers": [], "cover": None}


def _year(text: str) -> int:
    found = re.search("[0-9]{4}", text)
    return int(found[0]) if found and int(found[0]) >= 1000 else 0


def _number(text: str) -> float:
    try:
        return float(text.strip(WHITE))
    except ValueError:
        return 0.0


def _local(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _all(node: ET.Element | None, *path: str) -> list[ET.Element]:
    nodes = [] if node is None else [node]
    for name in path:
        nodes = [c for n in nodes for c in n if _local(c.tag) == name]
    return nodes


def _text(node: ET.Element) -> str:
    return (node.text or "").strip(WHITE)


def _first(nodes: list[ET.Element]) -> str:
    return next((t for n in nodes if (t := _text(n))), "")


def _attr(node: ET.Element, name: str) -> str:
    return next((v for k, v in node.attrib.items() if _local(k) == name), "")


def _entry(archive: zipfile.ZipFile, name: str, most: int) -> bytes:
    """A file of an archive, read no further than its limit."""
    with archive.open(name) as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise ValueError(f"{name} is larger than {most} bytes")
    return data


# ---- EPUB ------------------------------------------------------------------------------------------------------------


def _isbn_like(text: str) -> bool:
    digits = text.replace("-", "").replace(" ", "")
    if re.fullmatch("97[89][0-9]{10}", digits):
        return sum(int(d) * (3 if i % 2 else 1) for i, d in enumerate(digits)) % 10 == 0
    if re.fullmatch("[0-9]{9}[0-9Xx]", digits):
        return sum((10 if d in "Xx" else int(d)) * (10 - i) for i, d in enumerate(digits)) % 11 == 0
    return False


def strip_series(title: str, series: str) -> str:
    title = title.strip(WHITE)
    found = re.fullmatch(r"(.+?)\s*-\s*[0-9]+(?:\.[0-9]+)?\s*-\s*(.+)", title) if series else None
    return found[2].strip(WHITE) if found and found[1].strip(WHITE) == series else title


def epub(data: bytes) -> Metadata:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        roots = _all(ET.fromstring(_entry(archive, "META-INF/container.xml", TEXT_MOST)), "rootfiles", "rootfile")
        opf = next(p for r in roots if (p := _attr(r, "full-path")))
        package = ET.fromstring(_entry(archive, opf, TEXT_MOST))
        said = lambda name: _all(package, "metadata", name)
        out = _blank()
        metas = [(_attr(m, "name"), _attr(m, "content")) for m in said("meta")]
        out["series"] = next((c for n, c in metas if n == "calibre:series" and c), "")
        out["series_number"] = next((x for n, c in metas if n == "calibre:series_index" and (x := _number(c))), 0.0)
        out["title"] = strip_series(_first(said("title")), out["series"])
        out["authors"] = [t for n in said("creator") if (t := _text(n))]
        out["genres"] = [n.text or "" for n in said("subject")]
        out["annotation"], out["language"], out["publisher"] = _first(said("description")), _first(said("language")), _first(said("publisher"))
        out["year"] = _year(_first(said("date")))
        for node in said("identifier"):
            value, kind = _text(node), _attr(node, "scheme").strip(WHITE).lower()
            if not kind and (value.lower().startswith(("urn:isbn:", "isbn:")) or _isbn_like(value)):
                kind = "isbn"
            if value and kind:
                out["identifiers"].append((kind, value))
        items = [(_attr(i, "id"), _attr(i, "media-type"), _attr(i, "href")) for i in _all(package, "manifest", "item")]
        images = [i for i in items if i[1].startswith("image/")]
        wanted = next((c for n, c in metas if n == "cover"), None) or next((i[0] for i in images if "cover" in i[0]), None)
        href = next((i[2] for i in images if i[0] == wanted), None)
        if href:
            try:
                out["cover"] = _entry(archive, posixpath.join(posixpath.dirname(opf), unquote(href)), COVER_MOST)
            except (KeyError, ValueError):
                pass
        return out


# ---- FB2 -------------------------------------------------------------------------------------------------------------

#: Elements of an annotation and the HTML that shows them.
_SHOWN_AS = {"p": "p", "emphasis": "em", "strong": "strong", "strikethrough": "s", "sub": "sub", "sup": "sup", "code": "code", "a": "a"}


def _parse_xml(data: bytes) -> ET.Element:
    """XML in its declared charset, with the named entities that books use."""
    found = re.match(rb"""\s*(?:\xef\xbb\xbf)?<\?xml[^>]*encoding=["']([A-Za-z0-9._-]+)["'][^>]*\?>""", data)
    text = data.decode(found[1].decode() if found else "utf-8-sig").lstrip("﻿")
    text = re.sub(r"^\s*<\?xml[^>]*\?>", "", text)
    text = re.sub(r"&([a-zA-Z]+);", lambda m: SHOWN.get(m[1], m[0]), text)
    return ET.fromstring(text)


def annotation_html(node: ET.Element) -> str:
    out: list[str] = [html.escape(node.text or "", quote=True)]
    for child in node:
        name = _local(child.tag)
        if name == "empty-line":
            out.append("<br/>")
        else:
            tag, inner = _SHOWN_AS.get(name), annotation_html(child)
            href = _attr(child, "href").strip(WHITE) if name == "a" else ""
            out.append(f"<{tag}{f' href="{html.escape(href)}"' if href else ''}>{inner}</{tag}>" if tag else inner)
        out.append(html.escape(child.tail or "", quote=True))
    return "".join(out)


def _person(node: ET.Element) -> str:
    first, middle, last, nick = (_first(_all(node, n)) for n in ("first-name", "middle-name", "last-name", "nickname"))
    return nick if nick and not first and not last else " ".join(p for p in (first, middle, last) if p)


def fb2(data: bytes) -> Metadata:
    book = _parse_xml(data[:TEXT_MOST])
    if _local(book.tag) != "FictionBook":
        raise ValueError("not a FictionBook")
    out = _blank()
    info = next(iter(_all(book, "description", "title-info")), None)
    out["title"] = _first(_all(info, "book-title")[:1])
    out["authors"] = [p for n in _all(info, "author") if (p := _person(n))]
    out["genres"] = [n.text or "" for n in _all(info, "genre")]
    out["language"] = _first(_all(info, "lang")[:1])
    for node in _all(info, "annotation")[:1]:
        out["annotation"] = annotation_html(node).strip(WHITE)
    for node in _all(info, "sequence")[:1]:
        out["series"], out["series_number"] = _attr(node, "name").strip(WHITE), _number(_attr(node, "number"))
    publish = next(iter(_all(book, "description", "publish-info")), None)
    out["publisher"], out["year"] = _first(_all(publish, "publisher")[:1]), _year(_first(_all(publish, "year")[:1]))
    if isbn := _first(_all(publish, "isbn")[:1]):
        out["identifiers"].append(("isbn", isbn))
    for image in _all(info, "coverpage", "image")[:1]:
        name = _attr(image, "href").removeprefix("#")
        for node in _all(book, "binary"):
            if name and _attr(node, "id") == name and _attr(node, "content-type").startswith("image/"):
                try:
                    out["cover"] = base64.b64decode(re.sub(r"[ \n\r\t]", "", node.text or ""), validate=True)
                except binascii.Error:
                    pass
                break
    return out


def fb2_zip(data: bytes) -> Metadata:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        return fb2(_entry(archive, next(n for n in archive.namelist() if n.lower().endswith(".fb2")), TEXT_MOST))


# ---- MOBI ------------------------------------------------------------------------------------------------------------

#: Record types of the extended header.
_AUTHOR, _PUBLISHER, _ABOUT, _ISBN, _DATE, _COVER, _TITLE, _LANGUAGE = 100, 101, 103, 104, 106, 201, 503, 524


def _records(data: bytes) -> list[bytes]:
    (n,) = struct.unpack_from(">H", data, 76)
    starts = [struct.unpack_from(">I", data, 78 + 8 * i)[0] for i in range(n)] + [len(data)]
    return [data[a:b] if a < b else data[a:] for a, b in zip(starts, starts[1:], strict=False)]


def mobi(data: bytes) -> Metadata:
    records = _records(data)
    head = records[0]
    if len(head) < 132 or head[16:20] != b"MOBI":
        raise ValueError("no MOBI header")
    (encoding,) = struct.unpack_from(">I", head, 28)
    decode = lambda b: b.decode("cp1252" if encoding == 1252 else "utf-8", "replace")
    out = _blank()
    at, size = struct.unpack_from(">II", head, 84)
    if size and at + size <= len(head):
        out["title"] = decode(head[at : at + size]).strip(WHITE)
    (length,), (flags,) = struct.unpack_from(">I", head, 20), struct.unpack_from(">I", head, 128)
    extra = head[16 + length :]
    if flags & 0x40 and length >= 116 and len(extra) >= 12 and extra[:4] == b"EXTH":
        (count,), pos, cover = struct.unpack_from(">I", extra, 8), 12, None
        for _ in range(count):
            if pos + 8 > len(extra):
                break
            kind, n = struct.unpack_from(">II", extra, pos)
            if n < 8 or pos + n > len(extra):
                break
            body = extra[pos + 8 : pos + n]
            pos += n
            if kind == _COVER and len(body) == 4:
                (cover,) = struct.unpack(">I", body)
                continue
            value = decode(body).strip(WHITE)
            if not value:
                continue
            if kind == _AUTHOR:
                out["authors"].append(value)
            elif kind == _ISBN:
                out["identifiers"].append(("isbn", value))
            elif kind == _TITLE:
                out["title"] = value
            elif kind == _DATE:
                out["year"] = out["year"] or _year(value)
            elif kind in (_PUBLISHER, _ABOUT, _LANGUAGE):
                name = {_PUBLISHER: "publisher", _ABOUT: "annotation", _LANGUAGE: "language"}[kind]
                out[name] = out[name] or value
        if cover is not None and len(head) >= 112:
            (first,) = struct.unpack_from(">I", head, 108)
            if first != 0xFFFFFFFF and first + cover < len(records) and len(records[first + cover]) <= COVER_MOST:
                out["cover"] = records[first + cover]
    out["title"] = html.unescape(out["title"])
    return out


# ---- PDF -------------------------------------------------------------------------------------------------------------


def pdf(data: bytes) -> Metadata:
    """Info strings, the page count and the first picture of page one; without a trailer, an object that has a title is the info."""
    doc, out = pdf_file.Document(data), _blank()
    out["pages"] = pdf_file.page_count(doc)
    info = doc.entry("Info")
    if not doc.trailers:
        info = next((d for n in sorted(doc.places) if isinstance(d := doc.object(n), dict) and {"Title", "Author"} & d.keys()), {})
    of = lambda key: pdf_file.text(doc, info, key).strip(WHITE)
    out["title"], out["annotation"], out["year"] = of("Title"), of("Subject"), _year(of("CreationDate"))
    out["authors"] = [a] if (a := of("Author")) else []
    picture = pdf_file.cover(doc)
    out["cover"] = picture if picture and len(picture) <= COVER_MOST else None
    return out


# ---- dispatch --------------------------------------------------------------------------------------------------------

#: By ending; a deployment may add its own.
PARSERS: dict[str, Callable[[bytes], Metadata]] = {".fb2.zip": fb2_zip, ".epub": epub, ".azw3": mobi, ".mobi": mobi, ".fb2": fb2, ".azw": mobi, ".pdf": pdf}


def parse_file(path: str, data: bytes | None) -> Metadata | None:
    """A file's metadata by the longest ending that fits; null if there is none or the file can't be parsed."""
    ending = next((e for e in sorted(PARSERS, key=len, reverse=True) if path.lower().endswith(e)), None)
    if ending is None or data is None:
        return None
    try:
        out = PARSERS[ending](data)
    except Exception:  # a broken file must never end a run
        return None
    return out | {"identifiers": [{"type": t, "value": v} for t, v in out["identifiers"]]}


def parsed(files: DataFrame, *, path: str = "path", content: str = "content") -> DataFrame:
    """(path, metadata...) of binaryFile rows; files that can't be parsed are left out."""

    def run(batches):
        for frame in batches:
            rows = [(p, parse_file(p, c)) for p, c in zip(frame["path"], frame["content"], strict=True)]
            good = [{"path": p} | m for p, m in rows if m is not None]
            yield pd.DataFrame(good, columns=["path", *_blank()])

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(run, f"path string, {METADATA}")


def scan_folder(spark: SparkSession, root: str) -> DataFrame:
    """(path, file_format, file_size, mtime) of a tree's book files; contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    rows = rows.select("path", file_format(F.col("path")).alias("file_format"), F.col("length").alias("file_size"), F.unix_seconds("modificationTime").alias("mtime"))
    return rows.filter(F.col("file_format").isNotNull())


def read_files(spark: SparkSession, root: str, wanted: DataFrame | None = None) -> DataFrame:
    """Metadata of a tree's book files, of the wanted paths alone if given."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(file_format(F.col("path")).isNotNull())
    rows = rows if wanted is None else rows.join(wanted.select("path"), "path", "left_semi")
    return parsed(rows)
