"""What a PDF says of itself: its objects, plain or in compressed object streams, its page count, its info strings and a cover.

Objects are found by their headers rather than by the cross-reference table, so files whose table is damaged are read as well; of an
object that is there twice the last counts, as an update appends it.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass

#: The most that a compressed stream may hold.
STREAM_MOST = 64 << 20
_BLANK = b"\0\t\n\f\r "
_END = re.compile(rb"[\0\t\n\f\r ()<>\[\]{}/%]")
_OBJECT = re.compile(rb"(?<![0-9])([0-9]{1,9})[\0\t\n\f\r ]+[0-9]{1,5}[\0\t\n\f\r ]+obj(?![a-z])")
_REFERENCE = re.compile(rb"[\0\t\n\f\r ]+[0-9]{1,5}[\0\t\n\f\r ]+R(?![A-Za-z])")
_STREAM = re.compile(rb"[\0\t\n\f\r ]*stream(\r\n|\n|\r)")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r\n": b"", b"\r": b""}


class Name(str):
    """A name, without its slash."""


@dataclass(frozen=True)
class Reference:
    number: int


@dataclass
class Stream:
    entries: dict
    raw: bytes


def _skip(data: bytes, at: int) -> int:
    while at < len(data):
        if data[at] == 37:  # a comment
            ends = [e for e in (data.find(b"\n", at), data.find(b"\r", at)) if e >= 0]
            at = min(ends, default=len(data))
        elif data[at] not in _BLANK:
            break
        else:
            at += 1
    return at


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in parentheses, which may nest."""
    start, depth = at, 1
    while depth and at < len(data):
        c = data[at]
        depth += (c == 40) - (c == 41)
        at += 2 if c == 92 else 1
    body = data[start : at - 1]
    octal = lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1])
    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", octal, body, flags=re.S), at


def value(data: bytes, at: int, depth: int = 0):
    """(value, end): what stands at a place; an unknown word is None."""
    if depth > 60:
        raise ValueError("nested too deeply")
    at = _skip(data, at)
    two = data[at : at + 2]
    if two == b"<<":
        entries, at = {}, _skip(data, at + 2)
        while at < len(data) and data[at : at + 2] != b">>":
            key, at = value(data, at, depth + 1)
            found, at = value(data, at, depth + 1)
            if isinstance(key, Name):
                entries[str(key)] = found
            at = _skip(data, at)
        return entries, at + 2
    if two[:1] == b"<":
        end = data.find(b">", at)
        end = len(data) if end < 0 else end
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), end + 1
    if two[:1] == b"(":
        return _literal(data, at + 1)
    if two[:1] == b"[":
        items, at = [], _skip(data, at + 1)
        while at < len(data) and data[at] != 93:
            found, at = value(data, at, depth + 1)
            items.append(found)
            at = _skip(data, at)
        return items, at + 1
    end = _END.search(data, at + 1)
    end = end.start() if end else len(data)
    word = data[at:end]
    if word[:1] == b"/":
        return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes.fromhex(m[1].decode()), word[1:]).decode("latin-1")), end
    if re.fullmatch(rb"[0-9]+", word) and (after := _REFERENCE.match(data, end)):
        return Reference(int(word)), after.end()
    if re.fullmatch(rb"[+-]?[0-9]+", word):
        return int(word), end
    if re.fullmatch(rb"[+-]?[0-9]*\.[0-9]*", word) and word.strip(b"+-.") != b"":
        return float(word), end
    return {b"true": True, b"false": False}.get(word), max(end, at + 1)


class Document:
    def __init__(self, data: bytes):
        if not data.startswith(b"%PDF-"):
            raise ValueError("not a PDF")
        self.data, self.places = data, {}
        self.packed: dict[int, object] = {}
        at = 0
        while m := _OBJECT.search(data, at):  # headers inside streams are no headers
            self.places[int(m[1])] = m.end()
            at = self._read(m.end())[1]
        self.trailers = [t for m in re.finditer(rb"trailer", data) if isinstance(t := value(data, m.end())[0], dict)]
        for number in [*self.places]:
            found = self.object(number)
            if isinstance(found, Stream) and found.entries.get("Type") == "ObjStm":
                self._unpack(found)
            elif isinstance(found, Stream) and found.entries.get("Type") == "XRef":
                self.trailers.append(found.entries)

    def object(self, number: int):
        at = self.places.get(number)
        return self.packed.get(number) if at is None else self._read(at)[0]

    def _read(self, at: int):
        """(object, end) of what follows a header."""
        found, end = value(self.data, at)
        word = _STREAM.match(self.data, end)
        if not isinstance(found, dict) or not word:
            return found, end
        size = self.resolved(found.get("Length"))
        stop = word.end() + size if isinstance(size, int) and size >= 0 else -1
        if stop < 0 or not self.data[stop : stop + 20].lstrip(_BLANK).startswith(b"endstream"):
            stop = self.data.find(b"endstream", word.end())
            stop = len(self.data) if stop < 0 else stop
        return Stream(found, self.data[word.end() : stop]), stop

    def resolved(self, x, depth: int = 0):
        """What a reference leads to; other values as they are."""
        return self.resolved(self.object(x.number), depth + 1) if isinstance(x, Reference) and depth < 20 else x

    def _unpack(self, stream: Stream) -> None:
        try:
            body, n, first = unpacked(self, stream), int(self.resolved(stream.entries["N"])), int(self.resolved(stream.entries["First"]))
        except (KeyError, TypeError, ValueError, zlib.error):
            return
        heads = [int(x) for x in body[:first].split()[: 2 * n]]
        for number, offset in zip(heads[::2], heads[1::2], strict=False):
            self.packed[number] = value(body, first + offset)[0]

    def entry(self, name: str) -> dict:
        """A dictionary that the last trailer with such an entry names."""
        for trailer in reversed(self.trailers):
            if isinstance(found := self.resolved(trailer.get(name)), dict):
                return found
        return {}

    def pages(self):
        """The dictionaries of pages in order."""
        waiting, seen = [self.entry("Root").get("Pages")], set()
        while waiting:
            node = waiting.pop()
            if isinstance(node, Reference):
                if node.number in seen:
                    continue
                seen.add(node.number)
            node = self.resolved(node)
            if not isinstance(node, dict):
                continue
            kids = self.resolved(node.get("Kids"))
            if isinstance(kids, list):
                waiting += reversed(kids)
            else:
                yield node


def filters(doc: Document, stream: Stream) -> list[str]:
    found = doc.resolved(stream.entries.get("Filter"))
    return [str(doc.resolved(f)) for f in found] if isinstance(found, list) else [] if found is None else [str(found)]


def unpacked(doc: Document, stream: Stream) -> bytes:
    """A stream's bytes behind the filter that compresses, with its row predictors undone."""
    names = filters(doc, stream)
    if not names:
        return stream.raw
    if names != ["FlateDecode"]:
        raise ValueError(f"a stream packed by {names}")
    out = zlib.decompressobj().decompress(stream.raw, STREAM_MOST)
    how = doc.resolved(stream.entries.get("DecodeParms"))
    how = doc.resolved(how[0]) if isinstance(how, list) and how else how
    if not isinstance(how, dict) or doc.resolved(how.get("Predictor", 1)) < 10:
        return out
    depth = max(1, doc.resolved(how.get("Colors", 1)) * doc.resolved(how.get("BitsPerComponent", 8)) // 8)
    width = -(-doc.resolved(how.get("Columns", 1)) * doc.resolved(how.get("Colors", 1)) * doc.resolved(how.get("BitsPerComponent", 8)) // 8)
    above, rows = bytearray(width), []
    for at in range(0, len(out) - width, width + 1):
        kind, row = out[at], bytearray(out[at + 1 : at + 1 + width])
        for i in range(width):
            left, up, corner = (row[i - depth] if i >= depth else 0), above[i], (above[i - depth] if i >= depth else 0)
            nearest = min((left, up, corner), key=lambda x: abs(left + up - corner - x))  # noqa: B023
            row[i] = (row[i] + [0, left, up, (left + up) // 2, nearest][min(kind, 4)]) & 255
        rows.append(bytes(row))
        above = row
    return b"".join(rows)


def _png(width: int, height: int, colors: int, pixels: bytes) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + pixels[i * width * colors : (i + 1) * width * colors] for i in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if colors == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def picture(doc: Document, stream: Stream) -> bytes | None:
    """An image's file: what is a file already as it stands, plain gray or colour pixels as a PNG."""
    names = filters(doc, stream)
    if names and names[-1] in ("DCTDecode", "JPXDecode"):
        return zlib.decompressobj().decompress(stream.raw, STREAM_MOST) if names[:-1] == ["FlateDecode"] else stream.raw if len(names) == 1 else None
    colors = {"DeviceRGB": 3, "DeviceGray": 1}.get(str(doc.resolved(stream.entries.get("ColorSpace"))))
    width, height = (doc.resolved(stream.entries.get(k)) for k in ("Width", "Height"))
    if not colors or doc.resolved(stream.entries.get("BitsPerComponent")) != 8 or not isinstance(width, int) or not isinstance(height, int):
        return None
    pixels = unpacked(doc, stream)
    return _png(width, height, colors, pixels) if len(pixels) >= width * height * colors > 0 else None


def cover(doc: Document) -> bytes | None:
    """Of the first page's images, masks left out, the first by object number that gives a file."""
    page = next(doc.pages(), {})
    resources, up = page.get("Resources"), page
    for _ in range(60):  # pages inherit what they leave out
        if resources is not None or not isinstance(up := doc.resolved(up.get("Parent")), dict):
            break
        resources = up.get("Resources")
    resources = doc.resolved(resources)
    images = doc.resolved(resources.get("XObject")) if isinstance(resources, dict) else None
    for ref in sorted((r for r in (images or {}).values() if isinstance(r, Reference)), key=lambda r: r.number):
        found = doc.resolved(ref)
        if not isinstance(found, Stream) or found.entries.get("Subtype") != "Image" or doc.resolved(found.entries.get("ImageMask")) is True:
            continue
        try:
            if data := picture(doc, found):
                return data
        except (ValueError, TypeError, zlib.error):
            continue
    return None


def text(doc: Document, info: dict, key: str) -> str:
    found = doc.resolved(info.get(key))
    if not isinstance(found, bytes):
        return ""
    if found.startswith(b"\xfe\xff"):
        return found[2:].decode("utf-16-be", "replace")
    return found[3:].decode("utf-8", "replace") if found.startswith(b"\xef\xbb\xbf") else found.decode("latin-1")


def page_count(doc: Document) -> int:
    """What the page tree says, else what it holds, else the pages that are there."""
    top = doc.resolved(doc.entry("Root").get("Pages"))
    stated = doc.resolved(top.get("Count")) if isinstance(top, dict) else None
    if isinstance(stated, int) and stated > 0:
        return stated
    return sum(1 for _ in doc.pages()) or sum(isinstance(d := doc.object(n), dict) and d.get("Type") == "Page" for n in {*doc.places, *doc.packed})
