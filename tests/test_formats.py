"""Sources with a format of their own, on files made here."""

import io
import struct
import zipfile

import pytest


def shapefile() -> tuple[bytes, bytes]:
    def record(n, body):
        return struct.pack(">2i", n, len(body) // 2) + body

    square = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0), (0.0, 0.0)]
    hole = [(0.5, 0.5), (1.0, 0.5), (1.0, 1.0), (0.5, 0.5)]
    polygon = struct.pack("<i4d2i2i", 5, 0, 0, 2, 2, 2, 9, 0, 5) + b"".join(struct.pack("<2d", *p) for p in square + hole)
    point = struct.pack("<i2d", 1, 50.0, 60.0)
    line = struct.pack("<i4d2ii", 3, 10, 10, 12, 13, 1, 2, 0) + struct.pack("<4d", 10, 10, 12, 13)
    null = struct.pack("<i", 0)
    shp = b"\0" * 100 + record(1, polygon) + record(2, point) + record(3, null) + record(4, line)
    fields = b"".join(n.ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, w in ((b"NAME", 6), (b"CODE", 3)))
    rows = b"".join(b" " + a.encode("cp932").ljust(6) + b.encode().ljust(3) for a, b in (("東町", "1"), ("b", "22"), ("c", "3"), ("d", "4")))
    dbf = b"\x03\0\0\0" + struct.pack("<IHH", 4, 32 + 64 + 1, 10) + b"\0" * 20 + fields + b"\r" + rows
    return shp, dbf


def test_shapes(spark, tmp_path):
    from tessellum.sources.formats import read_shapes

    shp, dbf = shapefile()
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/A.shp", shp)
        z.writestr("x/A.dbf", dbf)
    got = {r.n: r for r in read_shapes(spark, str(tmp_path / "a.zip")).collect()}
    assert {n: r.kind for n, r in got.items()} == {1: "Polygon", 2: "Point", 4: "LineString"}
    assert got[1].properties == {"NAME": "東町", "CODE": "1"} and [len(p) for p in got[1].parts] == [5, 4] and tuple(got[1].parts[0][1]) == (0.0, 2.0)
    assert [r.n for r in read_shapes(spark, str(tmp_path / "a.zip"), box=(9, 9, 11, 11)).collect()] == [4]
    (tmp_path / "b.shp").write_bytes(shp)
    assert {(r.n, len(r.properties)) for r in read_shapes(spark, str(tmp_path / "b.shp")).collect()} == {(1, 0), (2, 0), (4, 0)}


def test_sheets(spark, tmp_path):
    from tessellum.sources.formats import read_sheets

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2050</v></c></row><row r="2"><c r="B2" t="inlineStr"><is><t>x</t><t>y</t></is></c><c r="AA2"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><r><t>co</t></r><r><t>de</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/worksheets/sheet10.xml", f"<worksheet {ns}><sheetData/></worksheet>")
    (tmp_path / "a.xlsx").write_bytes(buf.getvalue())
    got = [(r.row, r.cells) for r in read_sheets(spark, str(tmp_path / "a.xlsx")).orderBy("row").collect()]
    assert got == [(0, ["code", None, "2050"]), (1, [None, "xy", *[None] * 24, "2"])]


def test_page_tables(spark):
    from tessellum.sources.formats import page_tables

    html = "<table><tr><td>no</td></tr></table><h2> East &amp; west </h2><table><tr><th>name</th><th>b</th></tr><tr><td>a <b>c</b></td><td>1</td></tr><tr><td>only one</td></tr></table>"
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert [(r.heading, r.cells) for r in page_tables(pages, key="page_id", html="html", width=2, header="name").collect()] == [("East & west", ["a c", "1"])]
    assert page_tables(pages, key="page_id", html="html").count() == 4


def test_parcels(spark, tmp_path):
    from tessellum.sources.formats import read_parcels

    point = lambda i, e, n: f'<zmn:GM_Point id="{i}"><zmn:GM_Point.position><zmn:DirectPosition><zmn:X>{n}</zmn:X><zmn:Y>{e}</zmn:Y></zmn:DirectPosition></zmn:GM_Point.position></zmn:GM_Point>'
    ref = lambda i: f'<zmn:GM_PointArray.column><zmn:GM_Position.indirect><zmn:GM_PointRef.point idref="{i}"/></zmn:GM_Position.indirect></zmn:GM_PointArray.column>'
    direct = "<zmn:GM_PointArray.column><zmn:GM_Position.direct><zmn:X>0</zmn:X><zmn:Y>0</zmn:Y></zmn:GM_Position.direct></zmn:GM_PointArray.column>"
    curve = lambda i, body, sign="+": f'<zmn:GM_Curve id="{i}"><zmn:GM_OrientablePrimitive.orientation>{sign}</zmn:GM_OrientablePrimitive.orientation>{body}</zmn:GM_Curve>'
    ring = lambda *ids: "<zmn:GM_Ring>" + "".join(f'<zmn:GM_CompositeCurve.generator idref="{i}"/>' for i in ids) + "</zmn:GM_Ring>"
    xml = (
        '<地図 xmlns="http://www.moj.go.jp/MINJI/tizuxml" xmlns:zmn="http://www.moj.go.jp/MINJI/tizuzumen"><空間属性>'
        + point("P1", 4, 0) + point("P2", 4, 3) + point("P3", 0, 3)
        + curve("C1", ref("P1") + direct) + curve("C2", ref("P2") + ref("P1"), "-") + curve("C3", ref("P3") + ref("P2")) + curve("C4", ref("P3") + direct)
        + f'<zmn:GM_Surface id="F1"><zmn:GM_Polygon>{ring("C1", "C2", "C3", "C4")}</zmn:GM_Polygon></zmn:GM_Surface></空間属性>'
        '<主題属性><筆 id="H1"><大字名>中町</大字名><地番>12-3</地番><形状 idref="F1"/></筆><筆 id="H2"><地番>9</地番></筆></主題属性></地図>'
    )
    (tmp_path / "a.xml").write_text(xml, encoding="utf-8")
    got = read_parcels(spark, str(tmp_path / "a.xml")).collect()
    assert [(r.id, r.tags, r.gaps) for r in got] == [("H1", {"大字名": "中町", "地番": "12-3"}, 0)]
    r = [(p.x, p.y) for p in got[0].rings[0]]
    assert r[0] == r[-1] and set(r) == {(0, 0), (4, 0), (4, 3), (0, 3)} and len(r) == 5
    assert abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:], strict=False))) / 2 == 12


@pytest.mark.parametrize("end", ["<", ">"])
def test_exif(spark, tmp_path, end):
    from tessellum.sources.formats import read_exif

    def directory(at, entries):
        """Bytes of a directory at a place in the block, with what doesn't fit behind it."""
        body, extra = b"", b""
        beyond = at + 2 + 12 * len(entries) + 4
        for tag, kind, n, raw in entries:
            if len(raw) <= 4:
                value = raw.ljust(4, b"\0")
            else:
                value = struct.pack(end + "I", beyond + len(extra))
                extra += raw
            body += struct.pack(end + "HHI", tag, kind, n) + value
        return struct.pack(end + "H", len(entries)) + body + b"\0" * 4 + extra

    ratio = lambda *v: struct.pack(end + "I" * len(v), *v)
    sub = directory(200, [(0x9003, 2, 20, b"2025:09-28 12:04:06\0"), (0x9011, 2, 7, b"+09:00\0")])
    gps = directory(400, [(1, 2, 2, b"S\0"), (2, 5, 3, ratio(33, 1, 30, 1, 36, 1)), (3, 2, 2, b"E\0"), (4, 5, 3, ratio(135, 1, 0, 1, 0, 1)), (5, 1, 1, b"\1"), (6, 5, 1, ratio(5, 2)), (17, 5, 1, ratio(721, 2))])
    main = directory(8, [(0x010F, 2, 4, b"Own\0"), (0x0110, 2, 8, b"Camera1\0"), (0x8769, 4, 1, struct.pack(end + "I", 200)), (0x8825, 4, 1, struct.pack(end + "I", 400))])
    block = ((b"II*\0" if end == "<" else b"MM\0*") + struct.pack(end + "I", 8) + main).ljust(200, b"\0")
    block = (block + sub).ljust(400, b"\0") + gps
    app = b"Exif\0\0" + block
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xda\0\0")
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8\xff\xda\0\0")
    got = {r.path[-5:]: r for r in read_exif(spark, f"{tmp_path}/*.jpg").collect()}
    a = got["a.jpg"]
    assert (a.time, a.offset, a.camera, a.lon, a.alt, a.dir) == ("2025:09-28 12:04:06", "+09:00", "Own Camera1", 135.0, -2.5, 360.5) and abs(a.lat + 33.51) < 1e-12
    assert got["b.jpg"].time is None


def test_rings_of_turned_pieces(spark):
    import random

    from tessellum.sources.formats import with_ring

    r, rows = random.Random(5), []
    for k in range(60):
        n = r.randint(3, 12)
        ring = [(float(i), float(r.randrange(100) * 20 + i)) for i in range(n)]
        cuts = sorted(r.sample(range(n), r.randint(1, min(4, n - 1))))
        whole = ring[cuts[0] :] + ring[: cuts[0]] + [ring[cuts[0]]]
        at = [c - cuts[0] for c in cuts] + [n]
        parts = [whole[a : b + 1] for a, b in zip(at, at[1:], strict=False)]
        rows.append((k, [p if r.random() < 0.5 or len(parts) == 1 else p[::-1] for p in parts], whole))
    got = {x.k: x for x in with_ring(spark.createDataFrame([(k, p) for k, p, _ in rows], "k int, pieces array<array<struct<x: double, y: double>>>"), "pieces").collect()}
    for k, _, whole in rows:
        points = [tuple(p) for p in got[k].points]
        assert got[k].gaps == 0 and points[0] == points[-1] and len(points) == len(whole)
        start = points.index(whole[0]) if whole[0] in points else -1
        turn = points[start:-1] + points[:start]
        assert turn in (whole[:-1], [whole[0], *whole[-2:0:-1]])
    odd = spark.createDataFrame([(1, [[(0.0, 0.0), (1.0, 0.0)], [(5.0, 5.0), (1.0, 0.0)]]), (2, [[(0.0, 0.0), (1.0, 0.0)], [(7.0, 7.0), (8.0, 8.0)]]), (3, []), (4, [[(1.0, 0.0), (0.0, 0.0)], [(1.0, 0.0), (5.0, 5.0)]])], "k int, pieces array<array<struct<x: double, y: double>>>")
    found = {x.k: (x.gaps, [tuple(p) for p in x.points]) for x in with_ring(odd, "pieces").collect()}
    assert found[1] == (0, [(0, 0), (1, 0), (5, 5), (0, 0)]) and found[2][0] == 1 and found[3] == (0, []) and found[4] == (0, [(0, 0), (1, 0), (5, 5), (0, 0)])
