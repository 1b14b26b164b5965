"""Sources: markdown with a front matter, nested JSON, tables of text, CSV with fixed columns, registers and binary headers.

Files are read by Spark's readers, so any store that Spark reads will do.
"""

from __future__ import annotations

import io
import struct
import tomllib
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellum.plans.stages import ship

#: Tagged documents. All but the slug have a default; ``travel`` and ``coords`` are by place.
DOCUMENT = (
    "slug string, title string, places array<string>, tags array<string>, mood string, subtitle string, "
    "travel map<string,struct<year:int,month:int,duration:int>>, coords map<string,array<double>>, photo string, body string"
)


def parse_document(raw: str, path: str) -> dict | None:
    """Front matter between lines of three dashes, then the body; None without one or if it isn't YAML."""
    import yaml

    lines = raw.replace("\r\n", "\n").split("\n")
    if not lines or lines[0] != "---" or "---" not in lines[1:]:
        return None
    end = lines.index("---", 1)
    try:
        head = yaml.safe_load("\n".join(lines[1:end])) or {}
    except yaml.YAMLError:
        return None
    if not isinstance(head, dict):
        return None
    slug = path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".md")
    whole = lambda x: int(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None
    texts = lambda x: [str(v) for v in x] if isinstance(x, list) else []
    text = lambda x: str(x) if x else None
    travel = head.get("travel") if isinstance(head.get("travel"), dict) else {}
    coords = head.get("coords") if isinstance(head.get("coords"), dict) else {}
    return {
        "slug": slug,
        "title": str(head.get("title") or slug),
        "places": texts(head.get("places")),
        "tags": texts(head.get("tags")),
        "mood": text(head.get("mood")),
        "subtitle": text(head.get("subtitle")),
        "travel": {str(k): {f: whole((v or {}).get(f)) for f in ("year", "month", "duration")} for k, v in travel.items() if isinstance(v, dict)},
        "coords": {str(k): [float(x) for x in v] for k, v in coords.items() if isinstance(v, list) and all(isinstance(x, (int, float)) for x in v)},
        "photo": text(head.get("photo")),
        "body": "\n".join(lines[end + 1 :]).strip(),
    }


def read_documents(spark: SparkSession, glob: str) -> DataFrame:
    """Tagged documents, with ``ord``, their place in the order of file names. Files without a readable front matter give no row."""
    ship(spark)
    raw = spark.read.text(glob, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    schema = spark.createDataFrame([], f"{DOCUMENT}, path string").schema

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r | {"path": p} for v, p in zip(batch["value"], batch["path"], strict=True) if (r := parse_document(v, p))]
            yield pd.DataFrame(rows, columns=schema.names)

    from pyspark.sql import Window

    got = raw.mapInPandas(parse, schema)
    return got.withColumn("ord", F.row_number().over(Window.orderBy("path"))).drop("path")  # a library of stories, not a corpus


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """OSM elements of Overpass answers, once each by (type, id)."""
    element = "struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,geometry:array<struct<lat:double,lon:double>>,tags:map<string,string>>"
    raw = spark.read.schema(f"elements array<{element}>").option("multiLine", True).json(path)
    return raw.select(F.explode("elements").alias("e")).select("e.*").dropDuplicates(["type", "id"])


def read_features(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """GeoJSON features: properties, kind, rings (lists of positions), and their box as plain columns; with ``box`` only those that meet it."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "features array<string>")["features"]).alias("f"))
    shape = F.get_json_object("f", "$.geometry.type")
    points = F.get_json_object("f", "$.geometry.coordinates")
    position = "array<double>"
    rings = (
        F.when(shape == "Point", F.array(F.array(F.from_json(points, position))))
        .when(shape.isin("LineString", "MultiPoint"), F.array(F.from_json(points, f"array<{position}>")))
        .when(shape.isin("Polygon", "MultiLineString"), F.from_json(points, f"array<array<{position}>>"))
        .when(shape == "MultiPolygon", F.flatten(F.from_json(points, f"array<array<array<{position}>>>")))
    )
    got = raw.select(F.from_json(F.get_json_object("f", "$.properties"), "map<string,string>").alias("properties"), shape.alias("kind"), rings.alias("rings"))
    flat = F.flatten("rings")
    axis = lambda i: F.transform(flat, lambda p: p[i])
    got = got.withColumns({"xmin": F.array_min(axis(0)), "ymin": F.array_min(axis(1)), "xmax": F.array_max(axis(0)), "ymax": F.array_max(axis(1))})
    if box:
        got = got.where((F.col("xmin") <= box[2]) & (F.col("xmax") >= box[0]) & (F.col("ymin") <= box[3]) & (F.col("ymax") >= box[1]))
    return got


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, ragged): rows of text columns, and the lines whose number of fields differs from the header's."""
    raw = spark.read.text(path)
    head = raw.first()
    schema = ", ".join(f"`{c}` string" for c in columns) + ", _bad string"
    lines = raw.where((F.col("value") != (head[0] if head else "")) & (F.trim("value") != ""))
    parsed = lines.select("value", F.from_csv("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r._bad IS NULL").select(*[F.col("r")[c].alias(c) for c in columns]), parsed.where("r._bad IS NOT NULL").select(F.col("value").alias("line"))


def read_zipped_csv(spark: SparkSession, path: str, columns: list[str], *, encoding: str = "cp932", header_rows: int = 2) -> DataFrame:
    """Rows of all CSV members of ZIP files, as text."""
    ship(spark)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])

    def read(batches):
        import csv

        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.lower().endswith((".csv", ".txt"))):
                        rows = list(csv.reader(io.StringIO(z.read(name).decode(encoding))))[header_rows:]
                        yield pd.DataFrame([(r + [None] * len(columns))[: len(columns)] for r in rows], columns=columns, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, schema)


def read_register(spark: SparkSession, text: str, table: str, schema: str) -> DataFrame:
    """Rows of an array of tables in a TOML register; a register is a document that people write, so it is parsed on the driver."""
    names = spark.createDataFrame([], schema).schema.names
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in tomllib.loads(text).get(table, [])], schema)


def read_embedded_json(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(path, json) of ``window.<name> = {...};`` in script or page files."""
    raw = spark.read.text(path, wholetext=True)
    found = F.regexp_extract("value", rf"(?s)window\.{name}\s*=\s*(\{{.*?\}})\s*;?\s*(?:</script>|$)", 1)
    return raw.select(F.col("_metadata.file_path").alias("path"), found.alias("json")).where("json <> ''")


def read_heights(spark: SparkSession, path: str) -> DataFrame:
    """(path, r, c, v) of square big-endian 16-bit height tiles; the missing value -32768 is null."""
    ship(spark)

    def read(batches):
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                v = np.frombuffer(content, ">i2").astype(float)
                n = int(len(v) ** 0.5)
                v[v == -32768] = np.nan
                for lo in range(0, n, 256):  # some rows at a time
                    rows = np.arange(lo, min(n, lo + 256))
                    yield pd.DataFrame({"path": p, "r": np.repeat(rows, n), "c": np.tile(np.arange(n), len(rows)), "v": v[rows[0] * n : (rows[-1] + 1) * n]})

    got = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, r long, c long, v double")
    return got.withColumn("v", F.nanvl("v", F.lit(None).cast("double")))


def decode_height(red, green, blue):
    """Metres of a height that is stored as a colour; null for the colour that means none."""
    code = red * 65536 + green * 256 + blue
    return F.when((red == 128) & (green == 0) & (blue == 0), None).when(code < 1 << 23, code * 0.01).otherwise((code - (1 << 24)) * 0.01)


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) from the frame header, or None."""
    at = 2
    if data[:2] != b"\xff\xd8":
        return None
    while at + 9 < len(data):
        if data[at] != 0xFF:
            return None
        mark = data[at + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 if mark == 0xFF or 0xD0 <= mark <= 0xD9 else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def jpeg_segments(data: bytes) -> list[str]:
    """Names of the metadata segments before the image data."""
    at, out = 2, []
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xE1 <= data[at + 1] <= 0xEF:
            out.append(f"APP{data[at + 1] - 0xE0}:{data[at + 4 : at + 4 + min(size - 2, 16)].split(b'\0')[0].decode('latin-1')}")
        elif data[at + 1] == 0xFE:
            out.append("COM")
        at += 2 + size
    return out


def mp4_boxes(data: bytes) -> list[str]:
    """Names of the boxes, containers walked into."""
    out: list[str] = []
    todo = [(0, len(data))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            head = 8
            if size == 1 and at + 16 <= end:
                size, head = struct.unpack(">Q", data[at + 8 : at + 16])[0], 16
            size = end - at if size == 0 else size
            if size < head or at + size > end:
                break
            name = kind.decode("latin-1")
            out.append(name)
            if name in ("moov", "trak", "mdia", "minf", "stbl", "udta", "edts"):
                todo.append((at + head, at + size))
            at += size
    return out


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, parts) of JPEG and MP4 files: sizes, and metadata segments or boxes."""
    ship(spark)

    def read(batches):
        for batch in batches:
            rows = []
            for p, data in zip(batch["path"], batch["content"], strict=True):
                size = jpeg_size(data)
                rows.append((p, *(size or (None, None)), jpeg_segments(data) if size else mp4_boxes(data)))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "parts"]).astype({"width": "Int32", "height": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, width int, height int, parts array<string>")


def read_placemarks(spark: SparkSession, path: str, tag: str = "Placemark") -> DataFrame:
    """(name, lon, lat, i) of the coordinates of KML placemarks."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(rf"(?s)<{tag}\b.*?</{tag}>"), F.lit(0))).alias("p"))
    listed = raw.select(F.regexp_extract("p", r"(?s)<name>\s*(.*?)\s*</name>", 1).alias("name"), F.posexplode(F.split(F.trim(F.regexp_extract("p", r"(?s)<coordinates>(.*?)</coordinates>", 1)), r"\s+")).alias("i", "c"))
    part = F.split("c", ",")
    return listed.where("c <> ''").select("name", part[0].cast("double").alias("lon"), part[1].cast("double").alias("lat"), "i")


def read_waypoints(spark: SparkSession, path: str) -> DataFrame:
    """(name, lon, lat) of GPX waypoints."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<wpt\b.*?</wpt>"), F.lit(0))).alias("p"))
    return raw.select(F.regexp_extract("p", r"(?s)<name>\s*(.*?)\s*</name>", 1).alias("name"), F.regexp_extract("p", r'lon="([^"]+)"', 1).cast("double").alias("lon"), F.regexp_extract("p", r'lat="([^"]+)"', 1).cast("double").alias("lat"))


def tiles_of(boxes: DataFrame, *, key: str) -> DataFrame:
    """(key, tx, ty): all tiles between tx0..tx1 and ty0..ty1 of each box, once each."""
    return boxes.select(key, F.explode(F.sequence("tx0", "tx1")).alias("tx"), "ty0", "ty1").select(key, "tx", F.explode(F.sequence("ty0", "ty1")).alias("ty")).distinct()
