"""Sources with a format of their own: shapefiles, spreadsheets, cadastre XML, tables in pages and what photographs say of themselves.

Files come through Spark's binary and text readers; Python takes each apart on an executor, and what is related
inside a file by ids (the cadastre's points, curves, rings and parcels) is put together by joins.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.plans.stages import ship

SHAPES = {1: "Point", 3: "LineString", 5: "Polygon", 8: "MultiPoint"}


def shape_records(data: bytes, box: tuple[float, float, float, float] | None = None) -> Iterator[tuple[int, str, list[list[tuple[float, float]]]]]:
    """(record number from 1, kind, parts) of a .shp file; with a box only those that meet it, before their points are decoded."""
    at, n = 100, 0
    while at + 12 <= len(data):
        size = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
        body, n, at = data[at + 8 : at + 8 + size], n + 1, at + 8 + size
        code = struct.unpack("<i", body[:4])[0]
        kind = SHAPES.get(code % 10)
        if kind is None:
            continue
        if kind == "Point":
            x, y = struct.unpack("<2d", body[4:20])
            if box is None or (box[0] <= x <= box[2] and box[1] <= y <= box[3]):
                yield n, kind, [[(x, y)]]
            continue
        x0, y0, x1, y1 = struct.unpack("<4d", body[4:36])
        if box is not None and (x0 > box[2] or x1 < box[0] or y0 > box[3] or y1 < box[1]):
            continue
        if kind == "MultiPoint":
            parts, points, start = [0], struct.unpack("<i", body[36:40])[0], 40
        else:
            n_parts, points = struct.unpack("<2i", body[36:44])
            parts, start = list(struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts])), 44 + 4 * n_parts
        flat = struct.unpack(f"<{2 * points}d", body[start : start + 16 * points])
        xy = list(zip(flat[::2], flat[1::2], strict=True))
        yield n, kind, [xy[a:b] for a, b in zip(parts, [*parts[1:], points], strict=True)]


def dbf_rows(data: bytes, encoding: str) -> list[dict[str, str]]:
    """Rows of a .dbf file as text, deleted ones as empty."""
    rows, head, width = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding), data[at + 16]))
        at += 32
    out = []
    for i in range(rows):
        raw, at, row = data[head + i * width : head + (i + 1) * width], 1, {}
        for name, size in fields:
            row[name] = raw[at : at + size].decode(encoding, "replace").strip()
            at += size
        out.append({} if raw[:1] == b"*" else row)
    return out


def read_shapes(spark: SparkSession, path: str, *, box: tuple[float, float, float, float] | None = None, encoding: str = "cp932") -> DataFrame:
    """(path, n, kind, parts, properties) of ZIP files with a shapefile in them, or of bare .shp files (then without properties)."""
    ship(spark)

    def read(batches):
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                files = {"": content}
                if content[:2] == b"PK":
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        files = {n.lower(): z.read(n) for n in z.namelist() if n.lower().endswith((".shp", ".dbf"))}
                for name in sorted(n for n in files if not n.endswith(".dbf")):
                    table = files.get(name[:-4] + ".dbf") if name else None
                    rows = dbf_rows(table, encoding) if table else []
                    got = [(p, n, kind, [[{"x": x, "y": y} for x, y in part] for part in parts], rows[n - 1] if n <= len(rows) else {}) for n, kind, parts in shape_records(files[name], box)]
                    yield pd.DataFrame(got, columns=["path", "n", "kind", "parts", "properties"])

    schema = "path string, n int, kind string, parts array<array<struct<x:double,y:double>>>, properties map<string,string>"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, schema)


def sheet_rows(data: bytes, sheet: int = 0) -> Iterator[list[str | None]]:
    """Rows of a worksheet as text, cells in their columns; formulas give their stored value."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iterfind(".//m:t", ns)) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", ns)]
        for row in ElementTree.fromstring(z.read(names[sheet])).iterfind(".//m:row", ns):
            cells: dict[int, str | None] = {}
            for c in row.iterfind("m:c", ns):
                column = 0
                for letter in re.match(r"[A-Z]+", c.get("r", "A"))[0]:
                    column = column * 26 + ord(letter) - 64
                v = c.find("m:v", ns)
                if c.get("t") == "inlineStr":
                    cells[column - 1] = "".join(t.text or "" for t in c.iterfind(".//m:t", ns))
                elif v is not None and v.text is not None:
                    cells[column - 1] = shared[int(v.text)] if c.get("t") == "s" else v.text
            yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]


def read_sheets(spark: SparkSession, path: str, *, sheet: int = 0) -> DataFrame:
    """(path, row, cells) of a worksheet of each .xlsx file, rows counted from 0."""
    ship(spark)

    def read(batches):
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(p, i, r) for i, r in enumerate(sheet_rows(content, sheet))], columns=["path", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, row int, cells array<string>")


class _Tables(HTMLParser):
    def __init__(self, heading: str):
        super().__init__()
        self.heading, self.title, self.rows = heading, None, []
        self.into: list[str] | None = None
        self.cells: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == self.heading or tag in ("td", "th") and self.cells is not None:
            self.into = []
        elif tag == "tr":
            self.cells = []

    def handle_endtag(self, tag):
        text = "".join(self.into).strip() if self.into is not None else ""
        if tag == self.heading and self.into is not None:
            self.title, self.into = text, None
        elif tag in ("td", "th") and self.into is not None and self.cells is not None:
            self.cells.append(text)
            self.into = None
        elif tag == "tr" and self.cells is not None:
            if self.cells:
                self.rows.append((self.title, self.cells))
            self.cells = None

    def handle_data(self, data):
        if self.into is not None:
            self.into.append(data)


def table_rows(html: str | None, heading: str = "h2") -> list[tuple[str | None, list[str]]]:
    """(heading before it, cells) of each table row."""
    p = _Tables(heading)
    p.feed(html or "")
    return p.rows


def page_tables(pages: DataFrame, *, key: str, html: str, heading: str = "h2", width: int | None = None, header: str | None = None) -> DataFrame:
    """(key, i, heading, cells): rows of the tables in pages, under a heading if ``width`` asks for rows of so many cells; rows that begin with ``header`` are left out."""
    ship(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()

    def read(batches):
        for batch in batches:
            rows = [(k, i, title, cells) for k, page in zip(batch[key], batch[html], strict=True) for i, (title, cells) in enumerate(table_rows(page, heading))]
            yield pd.DataFrame(rows, columns=[key, "i", "heading", "cells"])

    got = pages.select(key, html).mapInPandas(read, f"{key} {kind}, i int, heading string, cells array<string>")
    if width is not None:
        got = got.where((F.size("cells") == width) & F.col("heading").isNotNull() & (F.col("heading") != ""))
    return got if header is None else got.where(F.col("cells")[0] != header)


# The cadastre's names.
_Z, _T = "{http://www.moj.go.jp/MINJI/tizuzumen}", "{http://www.moj.go.jp/MINJI/tizuxml}"
_SPACE, _THEME, _PARCEL, _SHAPE = "空間属性", "主題属性", "筆", "形状"


def cadastre_parts(data: bytes) -> Iterator[tuple]:
    """(part, id, ref, ring, seq, x, y, tags): points, curve vertices (a place or a reference), ring curves and parcels of one file; x is east, y north."""
    root = ElementTree.fromstring(data)
    space, theme = root.find(_T + _SPACE), root.find(_T + _THEME)
    place = lambda d: (float(d.findtext(_Z + "Y")), float(d.findtext(_Z + "X")))
    for p in space.iterfind(_Z + "GM_Point"):
        yield ("point", p.get("id"), None, None, 0, *place(p.find(f"{_Z}GM_Point.position/{_Z}DirectPosition")), None)
    for c in space.iterfind(_Z + "GM_Curve"):
        back = (c.findtext(_Z + "GM_OrientablePrimitive.orientation") or "").strip() == "-"
        columns = list(c.iter(_Z + "GM_PointArray.column"))
        for i, column in enumerate(reversed(columns) if back else columns):
            ref = column.find(f"{_Z}GM_Position.indirect/{_Z}GM_PointRef.point")
            direct = column.find(_Z + "GM_Position.direct")
            yield ("vertex", c.get("id"), ref.get("idref") if ref is not None else None, None, i, *(place(direct) if ref is None else (None, None)), None)
    for s in space.iterfind(_Z + "GM_Surface"):
        for i, ring in enumerate(s.iter(_Z + "GM_Ring")):
            for j, g in enumerate(ring.iterfind(_Z + "GM_CompositeCurve.generator")):
                yield ("ring", s.get("id"), g.get("idref"), i, j, None, None, None)
    for f in theme.iterfind(_T + _PARCEL):
        shape = f.find(_T + _SHAPE)
        tags = {e.tag.removeprefix(_T): e.text.strip() for e in f if e.text and e.text.strip()}
        yield ("parcel", f.get("id"), shape.get("idref") if shape is not None else None, None, 0, None, None, tags)


def with_ring(df: DataFrame, pieces: str) -> DataFrame:
    """``df`` with points, a closed ring, and gaps, how many of its ``pieces`` (arrays of points, in order around) don't begin where the one before ends.

    Every piece is turned by its two neighbours: so that its end meets the one after it and its beginning the one before it rather than the other way round.
    Of two pieces the second follows the first.
    """
    first, last = (lambda p: p[0]), (lambda p: F.element_at(p, -1))
    meets = lambda point, piece: ((point == first(piece)) | (point == last(piece))).cast("int")
    listed = df.withColumn("_p", F.filter(pieces, lambda p: F.size(p) > 0)).withColumn("_n", F.size("_p"))
    beside = lambda i, step: F.element_at("_p", F.pmod(i + step, F.col("_n")) + 1)

    def turned(p, i):
        ahead = meets(last(p), beside(i, 1)) + meets(first(p), beside(i, -1))
        back = meets(first(p), beside(i, 1)) + meets(last(p), beside(i, -1))
        return F.when(back > ahead, F.reverse(p)).otherwise(p)

    def of_two(p, i):
        begins = meets(last(p), beside(i, 1)) < meets(first(p), beside(i, 1))
        start = F.when(meets(last(F.col("_p")[0]), F.col("_p")[1]) < meets(first(F.col("_p")[0]), F.col("_p")[1]), first(F.col("_p")[0])).otherwise(last(F.col("_p")[0]))
        return F.when(F.when(i == 0, begins).otherwise((last(p) == start) & (first(p) != start)), F.reverse(p)).otherwise(p)

    way = F.when(F.col("_n") == 2, F.transform("_p", of_two)).when(F.col("_n") > 2, F.transform("_p", turned)).otherwise(F.col("_p"))
    ended = lambda i: last(F.element_at("_w", F.greatest(i, F.lit(1))))  # noqa: E731  the end of the piece before the i-th, counted from 0
    got = listed.withColumn("_w", way)
    got = got.withColumn("gaps", F.size(F.filter("_w", lambda p, i: (i > 0) & (first(p) != ended(i)))))
    got = got.withColumn("points", F.flatten(F.transform("_w", lambda p, i: F.when((i > 0) & (first(p) == ended(i)), F.slice(p, 2, F.size(p))).otherwise(p))))
    shut = F.when((F.size("points") > 0) & (F.try_element_at("points", F.lit(1)) != F.try_element_at("points", F.lit(-1))), F.concat("points", F.slice("points", 1, 1))).otherwise(F.col("points"))
    return got.withColumn("points", shut).drop("_p", "_n", "_w")


def read_parcels(spark: SparkSession, path: str) -> DataFrame:
    """(path, id, tags, rings, gaps): parcels with their rings, references resolved from parcel to surface, ring, curve and point by joins."""
    ship(spark)
    names = ["path", "part", "id", "ref", "ring", "seq", "x", "y", "tags"]

    def read(batches):
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                frame = pd.DataFrame([(p, *row) for row in cadastre_parts(content)], columns=names)
                yield frame.astype({"ring": "Int32", "seq": "Int32", "x": "Float64", "y": "Float64"})

    parts = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, part string, id string, ref string, ring int, seq int, x double, y double, tags map<string,string>")
    of = lambda name: parts.where(F.col("part") == name)
    points = of("point").select("path", F.col("id").alias("ref"), F.col("x").alias("px"), F.col("y").alias("py"))
    vertices = of("vertex").join(points, ["path", "ref"], "left").select("path", "id", "seq", F.coalesce("x", "px").alias("x"), F.coalesce("y", "py").alias("y"))
    curves = vertices.groupBy("path", F.col("id").alias("ref")).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("curve"))
    ordered = of("ring").select("path", "id", "ref", "ring", "seq").join(curves, ["path", "ref"])
    pieces = ordered.groupBy("path", "id", "ring").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "curve"))), lambda v: v["curve"]).alias("pieces"))
    rings = with_ring(pieces, "pieces")
    listed = F.sort_array(F.collect_list(F.struct("ring", "points")))
    surfaces = rings.groupBy("path", F.col("id").alias("ref")).agg(F.transform(listed, lambda v: v["points"]).alias("rings"), F.sum("gaps").alias("gaps"))
    return of("parcel").select("path", "id", "ref", "tags").join(surfaces, ["path", "ref"]).select("path", "id", "tags", "rings", "gaps")


# The tags of an EXIF block that are read, by directory.
_MAIN = {0x010F: "make", 0x0110: "model", 0x0132: "changed", 0x8769: "sub", 0x8825: "gps"}
_SUB = {0x9003: "time", 0x9011: "offset"}
_GPS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon", 5: "alt_ref", 6: "alt", 16: "dir_ref", 17: "dir"}
_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def _directory(block: bytes, at: int, end: str, names: dict[int, str]) -> dict:
    out: dict = {}
    if at + 2 > len(block):
        return out
    for i in range(struct.unpack(end + "H", block[at : at + 2])[0]):
        entry = block[at + 2 + 12 * i : at + 14 + 12 * i]
        if len(entry) < 12:
            break
        tag, kind, n = struct.unpack(end + "HHI", entry[:8])
        if tag not in names or kind not in _SIZE:
            continue
        size = _SIZE[kind] * n
        where = struct.unpack(end + "I", entry[8:])[0]
        raw = entry[8 : 8 + size] if size <= 4 else block[where : where + size]
        if len(raw) < size:
            continue
        if kind == 2:
            out[names[tag]] = raw.split(b"\0")[0].decode("latin-1").strip()
        elif kind in (5, 10):
            parts = struct.unpack(end + ("II" if kind == 5 else "ii") * n, raw)
            out[names[tag]] = [a / b if b else None for a, b in zip(parts[::2], parts[1::2], strict=True)]
        else:
            out[names[tag]] = list(struct.unpack(end + {1: "B", 3: "H", 4: "I", 7: "B", 9: "i"}[kind] * n, raw))
    return out


def exif(data: bytes) -> dict | None:
    """time, offset, lat, lon, alt, dir, dir_ref and camera of a JPEG file's EXIF block; None without one."""
    at = 2
    if data[:2] != b"\xff\xd8":
        return None
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            block = data[at + 10 : at + 2 + size]
            break
        at += 2 + size
    else:
        return None
    end = "<" if block[:2] == b"II" else ">"
    main = _directory(block, struct.unpack(end + "I", block[4:8])[0], end, _MAIN)
    sub = _directory(block, main["sub"][0], end, _SUB) if "sub" in main else {}
    gps = _directory(block, main["gps"][0], end, _GPS) if "gps" in main else {}

    def degrees(name: str) -> float | None:
        v = gps.get(name)
        if not v or len(v) < 3 or any(x is None for x in v):
            return None
        return (v[0] + v[1] / 60 + v[2] / 3600) * (-1 if gps.get(f"{name}_ref") in ("S", "W") else 1)

    alt = (gps.get("alt") or [None])[0]
    return {
        "time": sub.get("time") or main.get("changed"),
        "offset": sub.get("offset"),
        "lat": degrees("lat"),
        "lon": degrees("lon"),
        "alt": -alt if alt is not None and gps.get("alt_ref") == [1] else alt,
        "dir": (gps.get("dir") or [None])[0],
        "dir_ref": gps.get("dir_ref"),
        "camera": " ".join(x for x in (main.get("make"), main.get("model")) if x) or None,
    }


def read_exif(spark: SparkSession, path: str) -> DataFrame:
    """(path, time, offset, lat, lon, alt, dir, dir_ref, camera) of JPEG files; nulls where a file doesn't say."""
    ship(spark)
    names = ["time", "offset", "lat", "lon", "alt", "dir", "dir_ref", "camera"]

    def read(batches):
        for batch in batches:
            rows = [(p, *((exif(c) or {}).get(n) for n in names)) for p, c in zip(batch["path"], batch["content"], strict=True)]
            frame = pd.DataFrame(rows, columns=["path", *names])
            yield frame.astype({n: "Float64" for n in ("lat", "lon", "alt", "dir")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, time string, offset string, lat double, lon double, alt double, dir double, dir_ref string, camera string")
