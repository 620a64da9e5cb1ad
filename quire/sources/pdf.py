"""Plain PDF files as tables: text blocks with boxes and fonts, metadata, embedded images, structural checks, pages.

Reads the objects of a file and its Flate streams with the standard library; text comes from the show operators with their text
matrices. Encrypted files and fonts with their own encodings give no text (the caller's OCR would step in). Files are parsed one
at a time in Arrow batches, so memory follows the largest file of a batch.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_STRING = rb"\((?:\\.|[^\\()])*\)"
_SHOW = re.compile(
    rb"/(?P<font>\S+)\s+(?P<size>[\d.]+)\s+Tf|(?P<tm>(?:-?[\d.]+\s+){6})Tm|(?P<td>-?[\d.]+\s+-?[\d.]+)\s+T[dD]|(?P<nl>T\*)|(?P<bt>\bBT\b)|(?P<tj>" + _STRING + rb")\s*(?:Tj|'|\")|\[(?P<array>(?:\s*(?:" + _STRING + rb"|-?[\d.]+))*)\s*\]\s*TJ"
)


def _text(raw: bytes) -> str:
    plain = re.sub(rb"\\([0-7]{1,3})", lambda m: bytes([int(m.group(1), 8) & 255]), raw[1:-1])
    plain = re.sub(rb"\\(.)", lambda m: {b"n": b"\n", b"r": b"\r", b"t": b"\t"}.get(m.group(1), m.group(1)), plain, flags=re.S)
    return plain.decode("utf-16-be", "replace") if plain.startswith(b"\xfe\xff") else plain.decode("latin-1")


def objects(data: bytes) -> dict[int, bytes]:
    return {int(m.group(1)): m.group(2) for m in _OBJECT.finditer(data)}


def stream(body: bytes) -> bytes:
    found = _STREAM.search(body)
    if not found:
        return b""
    try:
        return zlib.decompressobj().decompress(found.group(1)) if b"/FlateDecode" in body else found.group(1)
    except zlib.error:
        return b""


def pages(data: bytes) -> list[list[bytes]]:
    """The content streams of each page, in the order of the objects."""
    known = objects(data)
    out = []
    for body in (b for _, b in sorted(known.items()) if re.search(rb"/Type\s*/Page\b", b)):
        refs = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        out.append([stream(known.get(int(n), b"")) for n in re.findall(rb"(\d+)\s+\d+\s+R", refs.group(1))] if refs else [])
    return out


def text_blocks(data: bytes) -> list[tuple]:
    """(page, block, x0, y0, x1, y1, font_size, text) of every shown string; y grows upward as in the file."""
    rows = []
    for number, parts in enumerate(pages(data)):
        size, x, y, block = 12.0, 0.0, 0.0, 0
        for m in _SHOW.finditer(b"\n".join(parts)):
            if m["font"]:
                size = float(m["size"])
            elif m["bt"]:
                x = y = 0.0
            elif m["tm"]:
                x, y = map(float, m["tm"].split()[4:6])
            elif m["td"]:
                dx, dy = map(float, m["td"].split())
                x, y = x + dx, y + dy
            elif m["nl"]:
                y -= 1.2 * size
            else:
                text = _text(m["tj"]) if m["tj"] else "".join(_text(s) for s in re.findall(_STRING, m["array"] or b""))
                if text.strip():
                    rows.append((number, block, x, y, x + 0.5 * size * len(text), y + size, size, text))
                    block += 1
    return rows


def metadata(data: bytes) -> dict:
    """Entries of the document information and counts; None where they are missing."""
    entry = lambda k: (m := re.search(rb"/" + k + rb"\s*(" + _STRING + rb")", data)) and _text(m.group(1))
    version = re.match(rb"%PDF-(\d\.\d)", data)
    return {"title": entry(b"Title"), "author": entry(b"Author"), "created": entry(b"CreationDate"), "keywords": entry(b"Keywords"), "version": version and version.group(1).decode(), "pages": len(pages(data)), "encrypted": b"/Encrypt" in data}


def images(data: bytes) -> list[tuple[int, int, int]]:
    """(object, width, height) of the embedded images."""
    rows = []
    for number, body in objects(data).items():
        if re.search(rb"/Subtype\s*/Image\b", body):
            w, h = (re.search(rb"/" + k + rb"\s+(\d+)", body) for k in (b"Width", b"Height"))
            rows.append((number, int(w.group(1)) if w else 0, int(h.group(1)) if h else 0))
    return rows


def problems(data: bytes) -> list[str]:
    """What is wrong with a file's structure; empty for a sound one."""
    out = []
    if not data.startswith(b"%PDF-"):
        out.append("no header")
    if b"%%EOF" not in data[-1024:]:
        out.append("no end of file")
    if b"xref" not in data and b"/XRef" not in data:
        out.append("no cross references")
    if not pages(data):
        out.append("no pages")
    if b"/Encrypt" in data:
        out.append("encrypted")
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _each(files: DataFrame, of, schema: str) -> DataFrame:
    columns = [c.strip().split(" ")[0] for c in schema.split(",")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(p, *row) for p, c in zip(batch.path, batch.content, strict=True) for row in of(bytes(c))], columns=columns)

    return files.mapInPandas(rows, schema)


def read_blocks(files: DataFrame) -> DataFrame:
    return _each(files, text_blocks, "path string, page int, block int, x0 double, y0 double, x1 double, y1 double, font_size double, text string")


def read_pages(files: DataFrame) -> DataFrame:
    """One row per page with its decoded content."""
    return _each(files, lambda data: [(k, b"\n".join(p)) for k, p in enumerate(pages(data))], "path string, page int, content binary")


def read_metadata(files: DataFrame) -> DataFrame:
    return _each(files, lambda data: [tuple(metadata(data).values())], "path string, title string, author string, created string, keywords string, version string, pages int, encrypted boolean")


def read_images(files: DataFrame, width: int = 50, height: int = 50) -> DataFrame:
    """Embedded images of at least a size."""
    return _each(files, images, "path string, object int, width int, height int").filter((F.col("width") >= width) & (F.col("height") >= height))


def checked(files: DataFrame) -> DataFrame:
    return _each(files, lambda data: [(problems(data),)], "path string, problems array<string>").withColumn("valid", F.size("problems") == 0)
