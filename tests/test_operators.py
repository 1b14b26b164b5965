"""Operators on small fixtures: sources, sinks, graphs, streams and edge cases."""

import io
import math
import struct
import zipfile

import pytest
from pyspark.sql import functions as F


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_documents(spark, tmp_path):
    from tessellum.sources.files import read_documents

    (tmp_path / "b.md").write_text("---\ntitle: Bee\nplaces: [x, y, x]\ntags: [t]\ntravel:\n  x: {year: 2025, month: 9, duration: 3}\ncoords:\n  x: [26.1, 119.9]\n---\n# h\nbody *here*\n", encoding="utf-8")
    (tmp_path / "a.md").write_text("---\nmood: calm\n---\ntext", encoding="utf-8")
    (tmp_path / "c.md").write_text("no front matter", encoding="utf-8")
    (tmp_path / "d.md").write_text("---\n: [broken\n---\nx", encoding="utf-8")
    got = {r.slug: r for r in read_documents(spark, f"{tmp_path}/*.md").collect()}
    assert set(got) == {"a", "b"} and got["a"].title == "a" and got["a"].places == [] and (got["a"].ord, got["b"].ord) == (1, 2)
    assert got["b"].places == ["x", "y", "x"] and got["b"].travel["x"].month == 9 and got["b"].coords["x"] == [26.1, 119.9] and got["b"].mood is None


def test_links_keep_first_orientation(spark):
    from tessellum.operators.documents import link_orientation

    df = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (2, 0, "a"), (2, 1, "b"), (3, 0, "c"), (3, 1, "c")], "g int, pos int, place string").withColumn("ord", F.col("g"))
    assert rows(link_orientation(df, group="g", item="place", order="ord")) == [("b", "a", 2, [1, 2]), ("c", "c", 1, [3])]


def test_selection():
    from tessellum.operators.documents import Selection

    s = Selection().toggled(tag="sea")
    assert s.tag == "sea" and s.toggled(tag="sea").tag is None and s.jumped(region="r") == Selection(region="r")


def test_other_sources(spark, tmp_path):
    from tessellum.sources import files as S

    (tmp_path / "o.json").write_text('{"elements":[{"type":"way","id":1,"nodes":[1,2],"tags":{"a":"b"}},{"type":"way","id":1}]}')
    assert S.read_elements(spark, f"{tmp_path}/o.json").count() == 1
    (tmp_path / "g.json").write_text('{"features":[{"properties":{"n":"p"},"geometry":{"type":"Point","coordinates":[5,6]}},{"properties":{"n":"q"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,0]]]}}]}')
    assert [r.properties["n"] for r in S.read_features(spark, f"{tmp_path}/g.json", (0, 0, 3, 3)).collect()] == ["q"]
    (tmp_path / "t.csv").write_text("a,b\n1,2\n3,4,5\n6,7\n")
    good, bad = S.read_csv(spark, f"{tmp_path}/t.csv", ["a", "b"])
    assert rows(good) == [("1", "2"), ("6", "7")] and bad.count() == 1
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("x.csv", "h1,h2\nu,v\n山,1\n川,-\n".encode("cp932"))
    (tmp_path / "z.zip").write_bytes(z.getvalue())
    assert rows(S.read_zipped_csv(spark, f"{tmp_path}/z.zip", ["k", "n"])) == [("山", "1"), ("川", "-")]
    assert rows(S.read_register(spark, '[[claim]]\nid = "a"\nmatch = ["x"]\n[[claim]]\nid = "b"\n', "claim", "id string, match array<string>")) == [("a", ["x"]), ("b", None)]
    (tmp_path / "r.js").write_text('window.__R = {"a": {"b": [1, 2]}};')
    assert S.read_embedded_json(spark, f"{tmp_path}/r.js", "__R").select(F.get_json_object("json", "$.a.b[1]")).first()[0] == "2"
    (tmp_path / "h.hgt").write_bytes(struct.pack(">4h", 1, 2, -32768, 4))
    assert [r.v for r in S.read_heights(spark, f"{tmp_path}/h.hgt").orderBy("r", "c").collect()] == [1.0, 2.0, None, 4.0]
    (tmp_path / "k.kml").write_text("<kml><Placemark><name>P</name><coordinates>1,2,0 3,4,0</coordinates></Placemark></kml>")
    assert rows(S.read_placemarks(spark, f"{tmp_path}/k.kml")) == [("P", 1.0, 2.0, 0), ("P", 3.0, 4.0, 1)]
    (tmp_path / "w.gpx").write_text('<gpx><wpt lat="1.5" lon="2.5"><name>W</name></wpt></gpx>')
    assert rows(S.read_waypoints(spark, f"{tmp_path}/w.gpx")) == [("W", 2.5, 1.5)]
    assert rows(S.tiles_of(spark.createDataFrame([("a", 1, 2, 5, 6)], "k string, tx0 int, tx1 int, ty0 int, ty1 int"), key="k")) == [("a", x, y) for x in (1, 2) for y in (5, 6)]


def test_media_headers(spark, tmp_path):
    from tessellum.sources.files import jpeg_segments, jpeg_size, mp4_boxes, read_media

    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", 10) + b"Exif\0\0ab" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 480, 640) + b"\0" * 8 + b"\xff\xda\0\2"
    assert jpeg_size(jpeg) == (640, 480) and jpeg_segments(jpeg)[0] == "APP1:Exif" and jpeg_size(b"xx") is None
    box = lambda k, body=b"": struct.pack(">I4s", 8 + len(body), k) + body
    mp4 = box(b"ftyp") + box(b"moov", box(b"udta", box(b"meta")))
    assert mp4_boxes(mp4) == ["ftyp", "moov", "udta", "meta"]
    (tmp_path / "a.jpg").write_bytes(jpeg)
    (tmp_path / "b.mp4").write_bytes(mp4)
    assert {(r.width, r.parts[0]) for r in read_media(spark, str(tmp_path)).collect()} == {(640, "APP1:Exif"), (None, "ftyp")}


def test_sinks(spark, tmp_path):
    from tessellum.sources import sinks as K

    df = spark.createDataFrame([(1, "a", 2.0, 3.0)], "id int, n string, lon double, lat double")
    K.write_json_rows(df, f"{tmp_path}/j")
    assert spark.read.text(f"{tmp_path}/j").first()[0] == '{"id":1,"n":"a","lon":2.0,"lat":3.0}'
    K.write_features(df, f"{tmp_path}/g", lon="lon", lat="lat")
    assert '"coordinates":[2.0,3.0]' in spark.read.text(f"{tmp_path}/g").first()[0]
    K.write_table(df, f"{tmp_path}/c", csv=True)
    K.write_table(df, f"{tmp_path}/p")
    assert spark.read.csv(f"{tmp_path}/c", header=True).count() == spark.read.parquet(f"{tmp_path}/p").count() == 1
    assert K.script_of(df.select("id"), "__X") == 'window.__X=[{"id":1}];\n'
    assert K.replace_block("a<1>old<2>b", "<1>", "<2>", "new") == "a<1>\nnew\n<2>b"
    with pytest.raises(ValueError):
        K.replace_block("a<1>x", "<1>", "<2>", "new")


def test_planted_faults(spark):
    """A clean register gives no finding; each planted fault gives its own."""
    from tessellum.operators import quality as Q
    from tessellum.sources.sinks import report

    clean = spark.createDataFrame([("a", "ok", "n", 1.0, 1.0), ("b", "ok", "n", 2.0, 2.01)], "id string, status string, note string, e double, g double")
    check = lambda df: Q.gate(Q.duplicates(df, "id"), Q.not_in(df, "id", "status", ["ok"]), Q.required(df, "id", "note"), Q.off_by(df, "id", "e", "g", 0.05))
    assert check(clean).count() == 0 and Q.exit_status(check(clean)) == 0
    for fault, want in ((("a", "ok", "n", 1.0, 1.0), "duplicate"), (("c", "odd", "n", 1.0, 1.0), "status"), (("c", "ok", " ", 1.0, 1.0), "required"), (("c", "ok", "n", 1.0, 1.2), "derived"), (("c", "ok", "n", 1.0, None), "derived")):
        found = check(clean.unionByName(spark.createDataFrame([fault], clean.schema)))
        assert {r.check for r in found.collect()} == {want} and Q.exit_status(found) == 1
        assert want in report(found)


def test_spans(spark):
    from tessellum.operators import quality as Q

    df = spark.createDataFrame([(1, "aé 12,5 and 7."), (2, "none"), (3, "")], "id int, text string")
    assert rows(Q.number_spans(df, key="id", text="text")) == [(1, "12,5", 3, 7), (1, "7", 12, 13)]
    claims = spark.createDataFrame([(1, "12,5 and")], "id int, claim string")
    left = Q.uncovered(Q.number_spans(df, key="id", text="text"), Q.literal_spans(df, claims, key="id", text="text", claim="claim"), key="id")
    assert [r.token for r in left.collect()] == ["7"]
    twice = Q.literal_spans(spark.createDataFrame([(1, "aaaa")], "id int, text string"), spark.createDataFrame([(1, "aa")], "id int, claim string"), key="id", text="text", claim="claim")
    assert [(r.lo, r.hi) for r in twice.orderBy("lo").collect()] == [(0, 2), (1, 3), (2, 4)]
    stale = Q.stale(spark.createDataFrame([("x", "aé 12"), ("y", "gone"), ("z", "no")], "id string, claim string"), df, key="id", text="claim", exact=False, size=3)
    assert [r["where"] for r in stale.collect()] == ["y"]


def test_graph_fixtures(spark):
    from tessellum.operators import graph as G
    from tessellum.operators.components import components

    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (3, 4, 2.0), (4, 5, 1.0), (8, 9, 1.0)], "u long, v long, w double")
    assert rows(components(e)) == [(n, 8 if n > 7 else 1) for n in (1, 2, 3, 4, 5, 8, 9)]
    both = G.undirected(e)
    start = spark.createDataFrame([(1, 1, 0.0), (5, 5, 0.0)], "node long, source long, dist double")
    assert rows(G.shortest_paths(both, start)) == [(1, 1, 0.0), (2, 1, 1.0), (3, 1, 1.0), (4, 5, 1.0), (5, 5, 0.0)]
    closed = spark.createDataFrame([(4, 3), (3, 4), (5, 4)], "u long, v long")
    assert 4 not in {r.node for r in G.shortest_paths(both, start, closed=closed).collect()}
    weights = spark.createDataFrame([(4, 10.0), (5, 7.0), (9, 3.0)], "node long, weight double")
    assert rows(G.bridges(e, weights, root=1)) == [(3, 4, 17.0), (4, 5, 7.0), (8, 9, 3.0)]
    assert rows(G.bridges(both, weights, root=1)) == []  # parallel edges cut nothing
    assert rows(G.largest_component(e)) == [(n,) for n in range(1, 6)]
    long_ = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)] + [(10, 100, 1.0)], "u long, v long, w double")
    assert sorted((r.a, r.b, r.n) for r in G.contracted(long_).collect()) == [(0, 10, 10), (10, 40, 30), (10, 100, 1)]
    assert {r.component for r in components(long_).collect()} == {0}
    assert rows(G.trace(long_, spark.createDataFrame([(37,)], "node long"), src="u", dst="v")) == [(37, 37, 0), (37, 38, 1), (37, 39, 2), (37, 40, 3)]
    assert rows(G.simple_paths(both, start=1, end=4, stretch=1.5)) == [([1, 2, 3, 4], 4.0), ([1, 3, 4], 3.0)]
    assert rows(G.plateaus(both, start=1, end=4).select("u", "v")) == [(1, 3), (3, 4)]
    assert components(e.where("u < 0")).count() == 0
    cost = spark.createDataFrame([(10.0, 2.0, False), (10.0, 0.5, False), (10.0, 0.0, True)], "l double, r double, s boolean").select(G.grade_cost(F.col("l"), F.col("r"), F.col("s"), flat=1.0, steep=0.5).alias("c"))
    assert [round(r.c, 3) for r in cost.collect()] == [20.0, 10.0, 33.333]


def test_fit_and_allocation(spark):
    from tessellum.operators import exposure as X

    cells = spark.createDataFrame([(a, b, 1.0 + a * b) for a in range(3) for b in range(3)], "a int, b int, v double")
    ta, tb = spark.createDataFrame([(0, 10.0), (1, 20.0), (2, 30.0)], "a int, t double"), spark.createDataFrame([(0, 30.0), (1, 20.0), (2, 10.0)], "b int, t double")
    got = X.proportional_fit(cells, [("a", ta, "t"), ("b", tb, "t")], rounds=50, tolerance=0.001)
    for key, want in (("a", ta), ("b", tb)):
        assert all(abs(r.s - r.t) < 0.001 for r in got.groupBy(key).agg(F.sum("v").alias("s")).join(want, key).collect())
    df = spark.createDataFrame([("g", 6.0, 1.0), ("g", 6.0, 2.0), ("h", 5.0, 0.0)], "g string, total double, w double")
    assert rows(X.allocate(df, group="g", total="total", weight="w").select("g", "w", "allocated")) == [("g", 1.0, 2.0), ("g", 2.0, 4.0), ("h", 0.0, None)]


def test_ordered_edges(spark):
    from tessellum.operators import ordered as O

    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 1.1, 50.0, 0.9, 1.0, 1.2, 0.8])] + [("b", i, 5.0) for i in range(3)], "k string, i int, v double")
    got = {(r.k, r.i): r.filtered for r in O.hampel(df, key="k", order="i", value="v").collect()}
    assert got["a", 2] == 1.05 and got["b", 1] == 5.0
    assert rows(O.climb(spark.createDataFrame([("a", 0, 0.0), ("a", 1, 2.0), ("a", 2, 6.0), ("a", 3, 5.0)], "k string, i int, v double"), key="k", order="i", value="v", least=5.0)) == [("a", 6.0, 1.0)]
    gaps = spark.createDataFrame([("a", 0, None), ("a", 1, 2.0), ("a", 2, None), ("a", 4, 8.0), ("a", 5, None)], "k string, i int, v double")
    assert [r.filled for r in O.fill_gaps(gaps, key="k", order="i", at=F.col("i"), value="v").orderBy("i").collect()] == [2.0, 2.0, 4.0, 8.0, 8.0]
    wet = spark.createDataFrame([(1, f, lv) for f, lv in enumerate([0, 1, 1, 0, 1, 1, 1, 0])] + [(2, 0, 1)], "px int, frame int, level int")
    assert rows(O.first_sustained(wet, key="px", order="frame", holds=F.col("level") > 0, n=3, keep="frame")) == [(1, 4)]


def test_text_and_geo(spark):
    from tessellum.functions import geo, rules
    from tessellum.functions import text as T

    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first().x
    assert val(T.label_of_id(F.lit("lan-tau--IS"))) == "Lan Tau  IS"
    assert val(T.range_label(F.lit(2024 * 12 + 9), F.lit(2025 * 12 + 11))) == "Sep–Nov 2025" and val(T.range_label(F.lit(24312), F.lit(24312))) == "Dec 2025"
    assert val(T.month_index(F.lit(2025), F.lit(0))) is None
    assert val(T.excerpt(F.lit("# t\n*a* [b]\n" + "word " * 60))).endswith("word…")
    assert val(T.count_of(F.lit("aaaa"), "aa")) == 3
    assert val(T.suppressed_int(F.lit("-"))) == 0 and val(T.suppressed_int(F.lit("X"))) is None and val(T.suppressed_int(F.lit(" 12"))) == 12
    assert val(T.elevation_m(F.lit("標高４５０．５m"))) == 450.5 and round(val(T.elevation_m(F.lit("1,000 ft"))), 1) == 304.8
    assert round(val(T.decimal_degrees(F.lit("""33°30'36"S"""))), 4) == -33.51
    assert val(T.normal_key(F.lit("Ａ校 (分校)　B"))) == "a校b"
    x, y = geo.transverse_mercator(F.lit(136.0), F.lit(36.0), lon0=136.0, lat0=36.0)
    assert abs(val(x)) < 1e-6 and abs(val(y)) < 1e-6
    _, far = geo.transverse_mercator(F.lit(136.0), F.lit(37.0), lon0=136.0, lat0=36.0)
    assert abs(val(far) - 110957) < 30
    assert val(geo.bearing(F.lit(-1.0), F.lit(0.0))) == 270.0 and val(geo.axial_difference(F.lit(175.0), F.lit(5.0))) == 10.0
    assert val(rules.one_way(F.lit("-1"), F.lit(False))) == -1 and val(rules.one_way(F.lit(None).cast("string"), F.lit(True))) == 1
    assert val(rules.bin_of(F.lit(5.0), [1, 3, 7])) == 2


def test_spatial_edges(spark):
    from tessellum.operators import spatial as S

    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0), (3, 500.0, 1.0)], "id int, x double, y double")
    q = spark.createDataFrame([(7, 1.0, 0.0), (8, -1.0, 0.0)], "sid int, x double, y double")
    assert rows(S.nearest(p, q, lid="id", rid="sid", size=2.0).select("id", "sid")) == [(1, 7), (2, 7), (3, 7)]
    pts = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, 1.0, 0.0), ("a", 2, 1.0, 0.01), ("a", 3, 1.0, 2.0)], "k string, i int, x double, y double")
    assert rows(S.path_encode(pts, key="k", order="i")) == [("a", "M0.0,0.0l1.0,0.0l0.0,2.0")]


def test_stream(spark, tmp_path):
    from tessellum.streaming.events import first_sustained, windowed

    frames = [(1, f, lv) for f, lv in enumerate([0.0, 1.0, 2.0, 0.0, 1.0, 3.0, 1.0])] + [(2, 0, 1.0), (2, 1, 1.0)]
    for i, part in enumerate((frames[:5], frames[5:])):
        spark.createDataFrame(part, "px long, frame long, level double").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    s = spark.readStream.schema("px long, frame long, level double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = first_sustained(s).writeStream.format("memory").queryName("sustained").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("sustained")) == [(1, 4, 3.0)]
    ev = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 03:00:00", "a", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.write.parquet(f"{tmp_path}/ev")
    w = windowed(spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/ev"), every="1 hour", late="10 minutes")
    q = w.writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp2").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.total) for r in spark.table("hours").collect()] == [(2, 3.0)]
    assert math.isclose(windowed(ev, every="1 hour").agg(F.sum("total")).first()[0], 7.0)


def test_statistics(spark):
    from tessellum.operators import statistics as S

    df = spark.createDataFrame([(i, float(i % 4)) for i in range(40)], "i long, v double")
    r = S.block_bootstrap(df, value="v", order="i", block=4, draws=200, seed=1).first()
    assert r.low == r.high == 1.5  # every block of four holds each value once
    ring = spark.createDataFrame([(i, float(i == 3), float(i == 3)) for i in range(10)], "i long, a double, b double")
    assert rows(S.shift_null(ring, at="i", a="a", b="b")) == [(0.1, 0.1)]
    angles = spark.createDataFrame([(170.0,), (10.0,)], "a double").agg(*S.axial_mean(F.col("a"), F.lit(1.0), 180.0)).first()
    assert min(angles.mean, 180 - angles.mean) < 1e-9 and angles.r > 0.9


def test_rasters_and_joins(spark):
    from tessellum.operators import joins as J
    from tessellum.operators import rasters as R

    # a bowl with one low rim cell: all drains through it
    h = {(r, c): 9.0 if r in (0, 3) or c in (0, 3) else 1.0 + r for r in range(4) for c in range(4)}
    h[3, 1] = 0.0
    got = {(x.r, x.c): x for x in R.drainage(spark.createDataFrame([("g", r, c, v) for (r, c), v in h.items()], "grid string, r long, c long, v double")).collect()}
    assert got[3, 1].to_r == -1 and got[3, 1].cells == 5 and all(got[k].to_r >= 0 for k in ((1, 1), (1, 2), (2, 1), (2, 2)))
    s = spark.createDataFrame([("a", q, float(k), c) for q, row in enumerate([(0, 5), (4, 0), (0, 5)]) for k, c in zip((0, 1), map(float, row), strict=True)], "route string, seq long, state double, cost double")
    assert [x.state for x in R.best_states(s, turn=10.0).orderBy("seq").collect()] == [0.0, 0.0, 0.0]
    assert [x.state for x in R.best_states(s, turn=1.0).orderBy("seq").collect()] == [0.0, 1.0, 0.0]
    square = lambda o, x: [(o, x + a, b, x + c, d) for a, b, c, d in ((0.0, 0.0, 1.0, 0.0), (1.0, 0.0, 1.0, 1.0), (1.0, 1.0, 0.0, 1.0), (0.0, 1.0, 0.0, 0.0))]
    assert rows(J.shared_borders(spark.createDataFrame(square("p", 0.0) + square("q", 1.0), "o string, x0 double, y0 double, x1 double, y1 double"), owner="o")) == [("p", "q", 1.0)]
    corners = spark.createDataFrame([("t", i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.5), (0.5, 0.5)])], "key string, i int, x double, y double")
    assert rows(R.tile_error(corners, x="x", y="y")) == [("t", 0.5, 0.125)]


def test_page_inventory(spark):
    from tessellum.functions import text as T

    html = "<html><head><title>A  b</title><style>p{}</style></head><body><p>One <b>two</b></p><script>var x='</p>'</script><ul><li>three</li><li> </li></ul></body></html>"
    assert spark.range(1).select(T.html_text_inventory(F.lit(html)).alias("t")).first().t == ["A b", "One two", "three"]
    assert spark.range(1).select(T.title_of(F.lit(html)).alias("t")).first().t == "A  b"
