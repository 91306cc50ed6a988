from __future__ import annotations

import base64
import io
import sqlite3
import struct
import zipfile
import zlib

import pytest

from bibspark.sources import calibre, ebooks, inpx

OPF = """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf"><metadata>
<dc:title> Saga - 2 - The Title </dc:title><dc:creator> Ann </dc:creator><dc:creator> </dc:creator><dc:subject>sf</dc:subject><dc:description>About</dc:description><dc:language>en</dc:language>
<dc:publisher>Pub</dc:publisher><dc:date>2003-01-01</dc:date><dc:identifier opf:scheme="ISBN">978-0-306-40615-7</dc:identifier><dc:identifier>urn:isbn:1</dc:identifier><dc:identifier>junk</dc:identifier>
<meta name="calibre:series" content="Saga"/><meta name="calibre:series_index" content="2"/><meta name="cover" content="c1"/></metadata>
<manifest><item id="c1" href="img%20a.jpg" media-type="image/jpeg"/></manifest></package>"""
FB2 = """<?xml version="1.0" encoding="windows-1251"?><FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0" xmlns:l="http://www.w3.org/1999/xlink"><description><title-info><genre>sf</genre>
<author><first-name>Лев</first-name><middle-name>Н</middle-name><last-name>Толстой</last-name></author><author><nickname>Nick</nickname></author><book-title>Книга</book-title>
<annotation><p>One &mdash; <emphasis>two</emphasis> &amp; <odd>three</odd></p><empty-line/><a l:href="http://x">l</a></annotation><lang>ru</lang><sequence name="Цикл" number="1.5"/><coverpage><image l:href="#c"/></coverpage></title-info>
<publish-info><publisher>Изд</publisher><year>1999</year><isbn>123</isbn></publish-info></description><binary id="c" content-type="image/png">COVER</binary></FictionBook>"""


def epub_bytes():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>')
        z.writestr("OEBPS/c.opf", OPF)
        z.writestr("OEBPS/img a.jpg", b"image")
    return out.getvalue()


def fb2_bytes():
    return FB2.replace("COVER", base64.b64encode(b"png").decode()).encode("cp1251")


def mobi_bytes():
    extra = [(100, b"Ann"), (100, b"Bob"), (103, b"About"), (104, b"123"), (106, b"2001-05"), (503, b"New &amp; Title"), (524, b"en"), (201, struct.pack(">I", 1))]
    body = b"".join(struct.pack(">II", k, len(v) + 8) + v for k, v in extra)
    exth = b"EXTH" + struct.pack(">II", 12 + len(body), len(extra)) + body
    head = bytearray(248)
    head[16:20] = b"MOBI"
    struct.pack_into(">I", head, 20, 232)
    struct.pack_into(">I", head, 28, 1252)
    struct.pack_into(">I", head, 108, 1)
    struct.pack_into(">I", head, 128, 0x40)
    title = "Café".encode("cp1252")
    rec0 = bytes(head) + exth
    head_title = struct.pack(">II", len(rec0), len(title))
    rec0 = rec0[:84] + head_title + rec0[92:] + title
    records = [rec0, b"first image", b"cover image"]
    at = 78 + 8 * len(records)
    table = b""
    for r in records:
        table += struct.pack(">II", at, 0)
        at += len(r)
    return bytes(76) + struct.pack(">H", len(records)) + table + b"".join(records)


def test_epub():
    m = ebooks.epub(epub_bytes())
    assert (m["title"], m["authors"], m["series"], m["series_number"], m["year"], m["publisher"], m["cover"]) == ("The Title", ["Ann"], "Saga", 2.0, 2003, "Pub", b"image")
    assert m["identifiers"] == [("isbn", "978-0-306-40615-7"), ("isbn", "urn:isbn:1")]


def test_fb2():
    m = ebooks.fb2(fb2_bytes())
    assert (m["title"], m["authors"], m["language"], m["series"], m["series_number"]) == ("Книга", ["Лев Н Толстой", "Nick"], "ru", "Цикл", 1.5)
    assert m["annotation"] == '<p>One — <em>two</em> &amp; three</p><br/><a href="http://x">l</a>'
    assert (m["publisher"], m["year"], m["identifiers"], m["cover"]) == ("Изд", 1999, [("isbn", "123")], b"png")


def test_mobi():
    m = ebooks.mobi(mobi_bytes())
    assert (m["title"], m["authors"], m["annotation"], m["year"], m["language"], m["identifiers"], m["cover"]) == ("New & Title", ["Ann", "Bob"], "About", 2001, "en", [("isbn", "123")], b"cover image")


def test_pdf():
    m = ebooks.pdf(b"%PDF-1.4\n1 0 obj<</Type /Page>>endobj 2 0 obj<</Type/Pages>>endobj 3 0 obj<</Title (A \\(b\\)) /Author <FEFF0041> /CreationDate (D:20030601)>>endobj")
    assert (m["pages"], m["title"], m["authors"], m["year"]) == (1, "A (b)", ["A"], 2003)


def packed_pdf():
    """A PDF whose catalogue, pages and info stand in an object stream, with a cross-reference stream for a trailer."""
    info = "<</Title <FEFF041A04420435> /Author (An\\\\n \\(B\\)) /Subject (About) /CreationDate (D:19991231)>>"
    objects = {1: "<</Type/Catalog/Pages 2 0 R>>", 2: "<</Type/Pages/Kids[3 0 R 4 0 R]/Count 2/Resources<</XObject<</A 9 0 R/B 8 0 R/M 7 0 R>>>>>>", 3: "<</Type/Page/Parent 2 0 R>>", 4: "<</Type/Page/Parent 2 0 R>>", 5: info}
    body, heads = "", []
    for number, text in objects.items():
        heads += [str(number), str(len(body))]
        body += text + " "
    head = " ".join(heads) + " "
    packed = zlib.compress((head + body).encode())
    stream = lambda n, entries, data: b"%d 0 obj <<%s/Length %d>>stream\n%s\nendstream endobj\n" % (n, entries, len(data), data)
    out = b"%PDF-1.5\n" + stream(6, b"/Type/ObjStm/N 5/First %d/Filter/FlateDecode" % len(head), packed)
    out += stream(7, b"/Subtype/Image/ImageMask true/Filter/DCTDecode", b"mask") + stream(8, b"/Subtype/Image/Filter/DCTDecode", b"\xff\xd8jpeg endobj 1 0 obj") + stream(9, b"/Subtype/Image/Filter/DCTDecode", b"later")
    return out + stream(10, b"/Type/XRef/Root 1 0 R/Info 5 0 R", b"")


def test_pdf_in_object_streams():
    m = ebooks.pdf(packed_pdf())
    assert (m["pages"], m["title"], m["authors"], m["annotation"], m["year"], m["cover"]) == (2, "Кте", ["An\\n (B)"], "About", 1999, b"\xff\xd8jpeg endobj 1 0 obj")


def test_pdf_plain_pixels_and_updates():
    pixels = bytes(range(12))
    rows = b"".join(b"\x02" + bytes((pixels[6 * r + i] - (pixels[6 * (r - 1) + i] if r else 0)) & 255 for i in range(6)) for r in range(2))
    image = zlib.compress(rows)
    data = b"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj 2 0 obj<</Kids[3 0 R]>>endobj 3 0 obj<</Resources 4 0 R>>endobj 4 0 obj<</XObject<</I 5 0 R>>>>endobj 6 0 obj<</Title(old)>>endobj\n"
    data += b"5 0 obj<</Subtype/Image/Width 2/Height 2/BitsPerComponent 8/ColorSpace/DeviceRGB/Filter/FlateDecode/DecodeParms<</Predictor 12/Colors 3/Columns 2>>/Length %d>>stream\n%s\nendstream endobj\ntrailer<</Root 1 0 R/Info 6 0 R>>\n6 0 obj<</Title(new)>>endobj" % (len(image), image)
    m = ebooks.pdf(data)
    assert (m["pages"], m["title"]) == (1, "new") and m["cover"].startswith(b"\x89PNG")
    body = m["cover"][m["cover"].index(b"IDAT") + 4 :]
    assert zlib.decompress(body[:-16]) == b"\0" + pixels[:6] + b"\0" + pixels[6:]


@pytest.mark.parametrize("path", ["a.epub", "b.fb2", "c.mobi", "d.pdf", "e.fb2.zip", "f.txt"])
def test_broken_files_are_null(path):
    assert ebooks.parse_file(path, b"not a book") is None


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.epub").write_bytes(epub_bytes())
    (tmp_path / "sub" / "B.FB2").write_bytes(fb2_bytes())
    (tmp_path / "broken.mobi").write_bytes(b"x")
    (tmp_path / "note.txt").write_text("x")
    with zipfile.ZipFile(tmp_path / "c.fb2.zip", "w") as z:
        z.writestr("c.fb2", fb2_bytes())
    found = ebooks.scan_folder(spark, str(tmp_path))
    assert sorted((r.path.rpartition("/")[2], r.file_format) for r in found.collect()) == [("B.FB2", "fb2"), ("a.epub", "epub"), ("broken.mobi", "mobi"), ("c.fb2.zip", "fb2")]
    read = {r.path.rpartition("/")[2]: r.title for r in ebooks.read_files(spark, str(tmp_path)).collect()}
    assert read == {"a.epub": "The Title", "B.FB2": "Книга", "c.fb2.zip": "Книга"}
    assert ebooks.read_files(spark, str(tmp_path), found.filter("file_format = 'epub'")).count() == 1


def test_inpx(spark, tmp_path):
    line = lambda *f: "\x04".join(f)
    lines = [
        line("Лем,Станислав,:", "sf:", "Солярис", "Цикл", "2", "1", "100", "9", "0", "FB2", "2021-31-05", "ru", "") + "\r",
        line("A,B,", "sf:", "", "", "0", "2", "x", "9", "", "fb2"),
        line("A,B,", "sf:", "Gone", "", "", "3", "1", "9", "1 ", "fb2", "", ""),
        line("A,B,", "sf:", "No entry", "", "", "4", "1", "9", "0", "fb2", "", ""),
        line("too", "short"),
        "",
    ]
    with zipfile.ZipFile(tmp_path / "lib.inpx", "w") as z:
        z.writestr("books.inp", "\n".join(lines))
        z.writestr("missing.inp", lines[0])
        z.writestr("version.info", "1")
    with zipfile.ZipFile(tmp_path / "books.zip", "w") as z:
        for n in ("1.fb2", "2.fb2", "3.fb2"):
            z.writestr(n, "x")
    (tmp_path / "corrupt.zip").write_bytes(b"x")
    rows = {r.source_path: r for r in inpx.read(spark, str(tmp_path / "lib.inpx"), str(tmp_path), 5).collect()}
    assert rows.keys() == {"books.zip/1.fb2", "books.zip/2.fb2"}
    one = rows["books.zip/1.fb2"]
    assert (one.title, one.authors, one.series, one.series_number, one.language, one.added_at, one.file_size, one.genres) == ("Солярис", ["Станислав Лем"], "Цикл", 2.0, "ru", 1622419200, 100, ["sf"])
    two = rows["books.zip/2.fb2"]
    assert (two.title, two.series_number, two.added_at, two.file_size, two.language) == ("2", None, 0, 0, "")


def test_calibre(spark, tmp_path):
    path = str(tmp_path / "metadata.db")
    with sqlite3.connect(path) as db:
        kinds = {"long": "INTEGER", "double": "REAL", "string": "TEXT"}
        for name, spec in calibre.TABLES.items():
            db.execute(f"CREATE TABLE {name} ({', '.join(f'{c.split()[0]} {kinds[c.split()[1]]}' for c in spec.split(', '))})")
        db.execute("CREATE TABLE custom_column_3 (id INTEGER, book INTEGER, value INTEGER)")
        db.executescript("""
            INSERT INTO books VALUES (1,'Dune','Frank/Dune',2.0,1,'0101-01-01 00:00:00','2021-05-06 00:00:00+00:00'),(2,'Solo','s',1.0,0,'1999-02-02',NULL),(3,'No file','n',1.0,0,NULL,NULL);
            INSERT INTO authors VALUES (1,'Zed'),(2,'Ann'); INSERT INTO books_authors_link VALUES (1,1,1),(2,1,2);
            INSERT INTO series VALUES (1,'Saga'); INSERT INTO books_series_link VALUES (1,1,1);
            INSERT INTO tags VALUES (1,'sf'); INSERT INTO books_tags_link VALUES (1,1,1);
            INSERT INTO publishers VALUES (1,'Ace'); INSERT INTO books_publishers_link VALUES (1,1,1);
            INSERT INTO ratings VALUES (1,9),(2,1); INSERT INTO books_ratings_link VALUES (1,1,1),(2,2,2);
            INSERT INTO languages VALUES (1,'eng'),(2,'rus'); INSERT INTO books_languages_link VALUES (1,1,2,1),(2,1,1,0);
            INSERT INTO comments VALUES (1,1,'<p>x</p>'); INSERT INTO identifiers VALUES (1,1,'isbn','9780306406157');
            INSERT INTO data VALUES (1,1,'EPUB',10,'d'),(2,1,'AZW3',11,'d'),(3,2,'PDF',NULL,'s');
            INSERT INTO custom_columns VALUES (3,'pages','Pages','int'); INSERT INTO custom_column_3 VALUES (1,1,321),(2,2,0);""")
    rows = {(r.library_key, r.file_format): r for r in calibre.read(spark, path, 9).collect()}
    assert rows.keys() == {("calibre:1", "epub"), ("calibre:1", "azw3"), ("calibre:2", "pdf")}
    one, two = rows["calibre:1", "epub"], rows["calibre:2", "pdf"]
    assert (one.authors, one.series, one.series_number, one.rating, one.language, one.publisher, one.year, one.pages, one.added_at, one.source_path, one.arrival) == (["Zed", "Ann"], "Saga", 2.0, 4, "en", "Ace", 0, 321, 1620259200, "Frank/Dune/d.epub", 2)
    assert (two.authors, two.series, two.series_number, two.rating, two.language, two.year, two.pages, two.file_size) == (None, None, None, None, "", 1999, 0, 0)
