"""Zipped documents: entry lists, Word files, e-books, spreadsheets, slides and card decks.

A package is read from the ``content`` column of Spark's binaryFile source and taken apart in Arrow batches; a broken
one gives a row with an error and does not fail the job.
"""

from __future__ import annotations

import hashlib
import io
import json
import posixpath
import re
import sqlite3
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame

from .html import blocks

SEGMENTS = "path string, no int, part string, tag string, text string, hidden boolean, error string"


def _local(tag: object) -> str:
    return str(tag).rsplit("}", 1)[-1]


def entries(content: bytes) -> list[tuple[str, int]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [(i.filename, i.file_size) for i in z.infolist() if not i.is_dir()]


def _paragraph(p: ET.Element) -> str:
    out = []
    for e in p.iter():
        name = _local(e.tag)
        out.append((e.text or "") if name == "t" else "\n" if name in ("br", "cr") else "\t" if name == "tab" else "")
    return "".join(out)


def docx(content: bytes) -> Iterator[tuple[str, str, str, bool]]:
    """(part, tag, text, hidden): headers, the body, notes, footers, in this order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        order = [*sorted(n for n in names if re.fullmatch(r"word/header\d*\.xml", n)), "word/document.xml", "word/footnotes.xml", "word/endnotes.xml",
                 *sorted(n for n in names if re.fullmatch(r"word/footer\d*\.xml", n))]
        for part in (p for p in order if p in names):
            for p in ET.fromstring(z.read(part)).iter():
                if _local(p.tag) == "p" and re.search(r"[^\W_]", text := _paragraph(p)):
                    yield part, "p", text.strip(), False


def pptx(content: bytes) -> Iterator[tuple[str, str, str, bool]]:
    """Slides in the presentation's order; hidden ones are marked."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        rels = {r.get("Id"): posixpath.normpath(posixpath.join("ppt", r.get("Target", ""))) for r in ET.fromstring(z.read("ppt/_rels/presentation.xml.rels"))}
        ids = [v for e in ET.fromstring(z.read("ppt/presentation.xml")).iter() if _local(e.tag) == "sldId" for k, v in e.attrib.items() if _local(k) == "id" and k != "id"]
        for part in (rels.get(i) for i in ids):
            if part in names:
                root = ET.fromstring(z.read(part))
                for p in root.iter():
                    if _local(p.tag) == "p" and re.search(r"[^\W_]", text := _paragraph(p)):
                        yield part, "p", text.strip(), root.get("show") == "0"


def xlsx_cells(content: bytes) -> Iterator[tuple[str, str, str, str]]:
    """(sheet, cell, type, value) of all cells, shared strings put in."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ET.fromstring(z.read("xl/sharedStrings.xml")) if _local(si.tag) == "si"]
        rels = {r.get("Id"): posixpath.normpath(posixpath.join("xl", r.get("Target", ""))) for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in (e for e in ET.fromstring(z.read("xl/workbook.xml")).iter() if _local(e.tag) == "sheet"):
            part = next((rels.get(v) for k, v in sheet.attrib.items() if k.endswith("}id")), None)
            if part not in names:
                continue
            for c in (e for e in ET.fromstring(z.read(part)).iter() if _local(e.tag) == "c"):
                kind = c.get("t", "n")
                value = next((v.text or "" for v in c if _local(v.tag) == "v"), None)
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
                if value is not None:
                    yield sheet.get("name", ""), c.get("r", ""), kind, shared[int(value)] if kind == "s" and int(value) < len(shared) else value


def epub(content: bytes) -> Iterator[tuple[str, str, str, bool]]:
    """Spine files in order, then other pages, marked hidden."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        box = ET.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.get("full-path", "") for e in box.iter() if _local(e.tag) == "rootfile")
        package = ET.fromstring(z.read(opf))
        here = posixpath.dirname(opf)
        items = {e.get("id"): posixpath.normpath(posixpath.join(here, e.get("href", ""))) for e in package.iter() if _local(e.tag) == "item"}
        spine = [items.get(e.get("idref")) for e in package.iter() if _local(e.tag) == "itemref"]
        for e in package.iter():
            if _local(e.tag) in ("title", "description") and (e.text or "").strip():
                yield opf, _local(e.tag), e.text.strip(), True
        rest = [n for n in names if re.search(r"\.x?html?$", n) and n not in spine]
        for part in [*(p for p in spine if p in names), *rest]:
            for tag, text in blocks(z.read(part).decode("utf-8", "replace")):
                yield part, tag, text, part in rest


def fb2(content: bytes) -> Iterator[tuple[str, str, str, bool]]:
    """Paragraphs, titles and verses of a FictionBook; its description is marked hidden."""
    if content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            content = z.read(next(n for n in z.namelist() if n.endswith(".fb2")))

    def walk(e: ET.Element, hidden: bool) -> Iterator[tuple[str, str, str, bool]]:
        name = _local(e.tag)
        hidden = hidden or name == "description"
        if name in ("p", "v", "subtitle", "text-author", "book-title", "td", "th"):
            text = re.sub(r"\s+", " ", "".join(e.itertext())).strip()
            if re.search(r"[^\W_]", text):
                yield "fb2", name, text, hidden
            return
        for x in e:
            if name != "binary":
                yield from walk(x, hidden)

    yield from walk(ET.fromstring(content), False)


def apkg(content: bytes) -> Iterator[tuple[str, str, str, str]]:
    """(term, translation, example, example_tr) of a card deck's notes, by the names of their fields."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        name = next(n for n in ("collection.anki21", "collection.anki2") if n in z.namelist())
        data = z.read(name)
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(data)
        models = json.loads(db.execute("select models from col").fetchone()[0] or "{}")
        notes = db.execute("select mid, flds from notes order by id").fetchall()
    finally:
        db.close()
    for mid, fields in notes:
        names = [f["name"].lower() for f in models.get(str(mid), {}).get("flds", [])]
        values = [" ".join(t for _, t in blocks(v)) if "<" in v else v.strip() for v in fields.split("\x1f")]
        find = lambda *keys: next((i for i, n in enumerate(names) if any(k in n for k in keys)), None)
        front = find("front", "term", "word", "expression")
        back = find("back", "meaning", "translation", "definition")
        front, back = 0 if front is None else front, 1 if back is None or back == front else back
        example, more = find("example", "sentence"), find("example translation", "sentence translation", "example_tr")
        get = lambda i: values[i] if i is not None and i < len(values) else ""
        if get(front) and get(back):
            yield get(front), get(back), get(example), get(more)


def _scan(files: DataFrame, read: Callable, schema: str, width: int) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "long": pa.int64()}
        types = [kinds[c.split()[1]] for c in schema.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(path, i, *row, None) for i, row in enumerate(read(content))]
                except Exception as e:  # a file that can't be read is a result, whatever is wrong with it
                    rows.append((path, -1, *[None] * width, f"{type(e).__name__}: {e}"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return files.select("path", "content").mapInArrow(run, schema)


READERS = {"docx": docx, "pptx": pptx, "epub": epub, "fb2": fb2}


def segments(files: DataFrame, kind: str) -> DataFrame:
    """(path, no, part, tag, text, hidden, error) of files of a kind in READERS."""
    return _scan(files, READERS[kind], SEGMENTS, 4)


def zip_entries(files: DataFrame) -> DataFrame:
    return _scan(files, entries, "path string, no int, name string, size long, error string", 2)


def cells(files: DataFrame) -> DataFrame:
    return _scan(files, xlsx_cells, "path string, no int, sheet string, cell string, type string, value string, error string", 4)


def decks(files: DataFrame) -> DataFrame:
    return _scan(files, apkg, "path string, no int, term string, translation string, example string, example_tr string, error string", 4)


def write_docx(segments: list[tuple[int, str]]) -> bytes:
    """A Word file with a grey marker paragraph and a text paragraph for each (id, text)."""
    from xml.sax.saxutils import escape

    def para(text: str, marker: bool = False) -> str:
        look = '<w:rPr><w:color w:val="999999"/><w:sz w:val="16"/></w:rPr>' if marker else ""
        lines = "<w:br/>".join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in text.split("\n"))
        return f"<w:p><w:r>{look}{lines}</w:r></w:p>"

    body = "".join(para(f"[[{i}]]", True) + para(t) for i, t in segments)
    office = "http://schemas.openxmlformats.org"
    files = {
        "[Content_Types].xml": f'<Types xmlns="{office}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{office}/package/2006/relationships"><Relationship Id="rId1" Type="{office}/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<w:document xmlns:w="{office}/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


def _zip(files: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files:
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def _written(rows: DataFrame, make: Callable[[list], bytes]) -> DataFrame:
    """(path, content) from (path, an array of what ``make`` takes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                content = pa.array([make(batch.column(1)[i].as_py())], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), content], names=["path", "content"])

    return rows.mapInArrow(run, "path string, content binary")


def write_zips(rows: DataFrame) -> DataFrame:
    """(path, content) of zipped packages from (path, entries): an array of (name, text), in this order."""
    return _written(rows.select("path", "entries"), lambda files: _zip([(f["name"], f["text"].encode()) for f in files]))


def write_docs(rows: DataFrame) -> DataFrame:
    """(path, content) of Word files from (path, segments): an array of (id, text)."""
    return _written(rows.select("path", "segments"), lambda own: write_docx([(s["id"], s["text"]) for s in own]))


def deck(rows: list[dict], name: str) -> bytes:
    """A card deck with one note and card for each row (term, translation, example, example_tr)."""
    fields = ("Front", "Back", "Example", "Example translation")
    model, own = 1_600_000_000_000, 1_600_000_000_001
    models = {str(model): {
        "id": model, "name": "Basic", "type": 0, "mod": 0, "usn": -1, "sortf": 0, "did": own, "css": "", "latexPre": "", "latexPost": "", "vers": [], "tags": [], "req": [[0, "any", [0]]],
        "flds": [{"name": n, "ord": i, "sticky": False, "rtl": False, "font": "Arial", "size": 20, "media": []} for i, n in enumerate(fields)],
        "tmpls": [{"name": "Card 1", "ord": 0, "qfmt": "{{Front}}<br><i>{{Example}}</i>", "afmt": "{{FrontSide}}<hr id=answer>{{Back}}<br><i>{{Example translation}}</i>", "did": None, "bqfmt": "", "bafmt": ""}],
    }}
    decks = {str(own): {"id": own, "name": name, "mod": 0, "usn": -1, "desc": "", "dyn": 0, "conf": 1, "collapsed": False, "extendNew": 0, "extendRev": 0, "newToday": [0, 0], "revToday": [0, 0], "lrnToday": [0, 0], "timeToday": [0, 0]}}
    db = sqlite3.connect(":memory:")
    try:
        # Tables and columns of the collection format.
        db.executescript(
            "create table col (id integer primary key, crt integer, mod integer, scm integer, ver integer, dty integer, usn integer, ls integer, conf text, models text, decks text, dconf text, tags text);"
            "create table notes (id integer primary key, guid text, mid integer, mod integer, usn integer, tags text, flds text, sfld text, csum integer, flags integer, data text);"
            "create table cards (id integer primary key, nid integer, did integer, ord integer, mod integer, usn integer, type integer, queue integer, due integer, ivl integer, factor integer, reps integer, lapses integer, left integer, odue integer, odid integer, flags integer, data text);"
            "create table revlog (id integer primary key, cid integer, usn integer, ease integer, ivl integer, lastIvl integer, factor integer, time integer, type integer);"
            "create table graves (usn integer, oid integer, type integer);"
        )
        db.execute("insert into col values (1, 0, 0, 0, 11, 0, 0, 0, '{}', ?, ?, '{}', '{}')", (json.dumps(models), json.dumps(decks)))
        for i, r in enumerate(rows, 1):
            value = "\x1f".join(r[c] or "" for c in ("term", "translation", "example", "example_tr"))
            guid = hashlib.sha1(f"{name}\x1f{r['term']}".encode()).hexdigest()[:10]
            db.execute("insert into notes values (?, ?, ?, 0, -1, '', ?, ?, ?, 0, '')", (own + i, guid, model, value, r["term"], note_checksum(r["term"])))
            db.execute("insert into cards values (?, ?, ?, 0, 0, -1, 0, 0, ?, 0, 0, 0, 0, 0, 0, 0, 0, '')", (own + i, own + i, own, i))
        db.commit()
        return _zip([("collection.anki2", db.serialize()), ("media", b"{}")])
    finally:
        db.close()


def write_decks(rows: DataFrame, name: str) -> DataFrame:
    """(path, content) of card decks from (path, notes): an array of (term, translation, example, example_tr)."""
    return _written(rows.select("path", "notes"), lambda notes: deck(notes, name))


def note_checksum(term: str) -> int:
    """A deck note's checksum: the first eight hex digits of SHA-1."""
    return int(hashlib.sha1(term.encode()).hexdigest()[:8], 16)
