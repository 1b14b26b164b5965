"""Queries of the gate's checks on content, over claims, routes and points made of the tables' numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellum.operators import gate as G
from tessellum.operators import layers as L
from tessellum.operators import quality as Q
from tessellum.operators import spatial as S

from .layers import STRIPS
from .registry import query, table
from .spatial import EDGES, INSIDE, PTS, SHAPES, places, points, zones

#: id, kind, first and second argument, expected value, tolerance, whether it is relative.
CLAIMS = [
    ("a1", "area", "1", "", 2_055_000.0, 0.01, True),
    ("a2", "area", "2", "", 1.0, 0.01, True),
    ("l1", "length", "1", "", 8230.0, 100.0, False),
    ("l2", "length", "2", "", 8230.0, 100.0, False),
    ("s1", "share", "3", "1", 33.0, 1.0, False),
    ("d1", "dist", "17", "42", 5000.0, 6000.0, False),
    ("d2", "dist", "18", "43", -1.0, 0.5, False),
    ("c1", "calc", "(12 + 3) * 4 / 2.5 - 1", "", 23.0, 0.01, False),
    ("c2", "calc", "2 * 3", "", 7.0, 0.01, False),
    ("c3", "calc", "__import__", "", 7.0, 0.01, False),
    ("n1", "count", "1", "", 0.0, 0.5, False),
]
CLAIM_ROWS = ", ".join(f"('{i}', '{k}', '{a}', '{b}', {e}::DOUBLE, {t}::DOUBLE, {str(r).lower()})" for i, k, a, b, e, t, r in CLAIMS)


@query(f"""
WITH {INSIDE}, claims(id, kind, a, b, expect, tol, relative) AS (VALUES {CLAIM_ROWS}),
m AS (SELECT CAST(zone AS VARCHAR) AS zone, abs(sum(x0 * y1 - x1 * y0)) / 2 AS area, sum(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)) AS length FROM edges GROUP BY zone),
p AS (SELECT CAST(id AS VARCHAR) AS key, x, y FROM pts), n AS (SELECT CAST(zone AS VARCHAR) AS zone, count(*) AS n FROM inside GROUP BY zone),
got AS (SELECT id, area AS got FROM claims JOIN m ON zone = a WHERE kind = 'area' UNION ALL SELECT id, length FROM claims JOIN m ON zone = a WHERE kind = 'length'
 UNION ALL SELECT id, 100 * m.area / k.area FROM claims JOIN m ON m.zone = a JOIN m k ON k.zone = b WHERE kind = 'share' UNION ALL SELECT id, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) FROM claims JOIN p ON p.key = a JOIN p q ON q.key = b WHERE kind = 'dist'
 UNION ALL SELECT id, n FROM claims JOIN n ON zone = a WHERE kind = 'count' UNION ALL SELECT * FROM (VALUES ('c1', 23.0), ('c2', 6.0)))
SELECT 'derived' AS "check", CASE WHEN got IS NULL THEN 'check could not run' ELSE 'is not what the text relies on' END AS msg, id AS "where", 'error' AS severity
FROM claims LEFT JOIN got USING (id) WHERE got IS NULL OR abs(got - expect) > tol * CASE WHEN relative THEN abs(expect) ELSE 1 END
""")
def derived_kinds(spark, sf_dir):
    claims = spark.createDataFrame(CLAIMS, "id string, kind string, a string, b string, expect double, tol double, relative boolean")
    of = lambda kind: claims.where(F.col("kind") == kind).select("id", "a", "b")
    m = S.polygon_measures(zones(spark), polygon="zone").select(F.col("zone").cast("string").alias("a"), "area", "length")
    p = points(spark, sf_dir).select(F.col("id").cast("string").alias("a"), "x", "y")
    other = lambda df: df.select(*[F.col(c).alias("b" if c == "a" else f"{c}2") for c in df.columns])
    hit = S.points_in_polygons(points(spark, sf_dir), zones(spark), point="id", polygon="zone", bucket=50.0)
    n = hit.groupBy(F.col("zone").cast("string").alias("a")).agg(F.count("*").alias("got"))
    both = lambda kind, df: of(kind).join(df, "a").join(other(df), "b")
    results = [
        of("area").join(m, "a").select("id", F.col("area").alias("got")),
        of("length").join(m, "a").select("id", F.col("length").alias("got")),
        both("share", m).select("id", (100 * F.col("area") / F.col("area2")).alias("got")),
        both("dist", p).select("id", F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")).alias("got")),
        of("calc").select("id", G.calc(F.col("a")).alias("got")),
        of("count").join(n, "a").select("id", "got"),
    ]
    return G.derived(claims, results)


@query("""
SELECT l_orderkey * 10 + l_linenumber AS line, (l_quantity + l_linenumber) * 2 - l_discount / 4 AS value FROM lineitem WHERE l_orderkey % 10 = 3
""")
def safe_arithmetic(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").where("l_orderkey % 10 = 3")
    text = F.format_string("(%s + %s) * 2 - %s / 4", F.col("l_quantity").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_discount").cast("string"))
    return df.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), G.calc(text).alias("value"))


@query("""
WITH v AS (SELECT n_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)
SELECT 'derived' AS "check", 'the text says otherwise' AS msg, CAST(n_nationkey AS VARCHAR) AS "where", 'error' AS severity FROM v
WHERE NOT contains('about ' || CASE WHEN n_nationkey % 3 = 0 THEN 2000000 ELSE n END || ' customers', format('{:t,}', n))
""")
def shown_values(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey").agg(F.count("c_custkey").alias("value"))
    said = F.concat(F.lit("about "), F.when(F.col("n_nationkey") % 3 == 0, 2_000_000).otherwise(F.col("value")).cast("string"), F.lit(" customers"))
    claims = n.select(F.col("n_nationkey").cast("string").alias("id"), F.concat(F.lit("n."), F.col("n_nationkey").cast("string")).alias("path"), F.lit("{:,}").alias("fmt"), F.array(said).alias("texts"))
    return G.shown(claims, n.select(F.concat(F.lit("n."), F.col("n_nationkey").cast("string")).alias("path"), "value"))


@query("""
WITH v AS (SELECT r_regionkey AS k, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1)
SELECT 'cell' AS "check", 'the data gives ' || a.n || ' of ' || b.n AS msg, CAST(a.k AS VARCHAR) AS "where", 'error' AS severity FROM v a JOIN v b ON b.k = 0 WHERE a.k % 2 = 0
UNION ALL SELECT 'cell', 'could not be recomputed', '99', 'error'
""")
def table_cells(spark, sf_dir):
    v = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey").agg(F.count("*").alias("value"))
    path = F.concat(F.lit("r."), F.col("r_regionkey").cast("string"))
    text = F.when(F.col("r_regionkey") % 2 == 0, "stale").otherwise(F.concat(F.col("value").cast("string"), F.lit(" of "), F.lit("5")))
    cells = v.select(F.col("r_regionkey").cast("string").alias("cell"), text.alias("text"), F.array(path, F.lit("r.0")).alias("paths"), F.lit("{} of {}").alias("fmt"))
    lost = spark.createDataFrame([("99", "1", ["r.77"], "{}")], cells.schema)
    return G.table_cells(cells.unionByName(lost), v.select(path.alias("path"), "value"))


#: A customer's orders in time are a route over sections; sections have classes, lengths and limits.
ROUTES = """legs AS (SELECT o_custkey AS route, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, o_orderkey % 40 AS section, o_totalprice / 100 AS len, o_orderpriority AS label FROM orders),
limits AS (SELECT p_partkey % 40 AS section, CAST(p_size * 10 AS DOUBLE) AS length, CAST(floor(p_retailprice) AS INTEGER) AS mm, CASE WHEN p_size > 30 THEN p_size END AS hr FROM part)"""


def legs(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("route"), F.row_number().over(w).alias("seq"), (F.col("o_orderkey") % 40).alias("section"), (F.col("o_totalprice") / 100).alias("len"), F.col("o_orderpriority").alias("label"))


def limits(spark, sf_dir):
    hr = F.when(F.col("p_size") > 30, F.col("p_size"))
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("section"), (F.col("p_size") * 10).cast("double").alias("length"), F.floor("p_retailprice").cast("int").alias("mm"), hr.alias("hr"))


@query(f"""
WITH {ROUTES}, k AS (SELECT *, label IS DISTINCT FROM lag(label) OVER w OR row_number() OVER w = 1 AS new FROM legs WHERE len >= 800 WINDOW w AS (PARTITION BY route ORDER BY seq)),
l AS (SELECT route, string_agg(label, ' → ' ORDER BY seq) AS labels FROM k WHERE new GROUP BY route),
m AS (SELECT route, min(mm) AS mm, min(hr) AS hr FROM (SELECT DISTINCT route, section FROM legs) JOIN limits USING (section) WHERE length >= 200 GROUP BY route)
SELECT route, labels, mm || ' mm' || CASE WHEN hr IS NULL THEN '' ELSE ' or ' || hr || ' mm/h' END AS closes FROM l JOIN m USING (route)
""")
def route_rows(spark, sf_dir):
    steps = legs(spark, sf_dir)
    labels = G.runs_of_labels(steps, route="route", order="seq", label="label", least=F.col("len") >= 800)
    mm = G.least_threshold(steps, limits(spark, sf_dir), route="route", section="section")
    hourly = F.coalesce(F.concat(F.lit(" or "), F.col("hr").cast("string"), F.lit(" mm/h")), F.lit(""))
    return labels.join(mm, "route").select("route", "labels", F.concat(F.col("mm").cast("string"), F.lit(" mm"), hourly).alias("closes"))


@query(f"""
WITH {ROUTES}, w AS (SELECT route, count(*) AS n, CAST(round(sum(len)) AS BIGINT) AS len FROM legs GROUP BY route), g AS (SELECT route + CASE WHEN route % 50 = 0 THEN 10000000 ELSE 0 END AS route, n + CASE WHEN route % 7 = 0 THEN 1 ELSE 0 END AS n, len FROM w)
SELECT 'table' AS "check", CASE WHEN w.route IS NULL THEN 'not in the data' WHEN g.route IS NULL THEN 'not on the page' ELSE 'the data gives another row' END AS msg, CAST(coalesce(w.route, g.route) AS VARCHAR) AS "where", 'error' AS severity
FROM w FULL JOIN g ON w.route = g.route WHERE w.route IS NULL OR g.route IS NULL OR w.n <> g.n
""")
def route_table_check(spark, sf_dir):
    want = legs(spark, sf_dir).groupBy("route").agg(F.count("*").alias("n"), F.round(F.sum("len")).cast("long").alias("len"))
    moved = F.col("route") + F.when(F.col("route") % 50 == 0, 10_000_000).otherwise(0)
    got = want.select(moved.alias("route"), (F.col("n") + F.when(F.col("route") % 7 == 0, 1).otherwise(0)).alias("n"), "len")
    return G.rows_agree(want, got, "route")


@query(f"""
WITH {INSIDE}, refs AS (SELECT id AS key, x, y, 60.0::DOUBLE AS tol, CASE WHEN id % 11 = 0 THEN '' ELSE 'survey' END AS source, CASE WHEN id % 13 = 0 THEN 1 + id % 3 END AS layer FROM pts WHERE id % 4 <> 1),
drawn AS (SELECT id AS key, x + id % 90 AS dx, y AS dy FROM pts WHERE id % 17 <> 0), used AS (SELECT id AS key FROM pts WHERE id % 5 <> 2), m AS (SELECT * FROM refs LEFT JOIN drawn USING (key)),
f AS (SELECT key, 'no sourced reference' AS msg, 'error' AS severity FROM used WHERE key NOT IN (SELECT key FROM refs) UNION ALL SELECT key, 'missing from the page', 'error' FROM m WHERE dx IS NULL
 UNION ALL SELECT key, 'no source', 'error' FROM m WHERE dx IS NOT NULL AND source = '' UNION ALL SELECT key, 'not inside its layer', 'error' FROM m WHERE dx IS NOT NULL AND layer IS NOT NULL AND NOT EXISTS (SELECT 1 FROM inside WHERE id = key AND zone = layer)
 UNION ALL SELECT key, 'too far from its reference', 'error' FROM m WHERE layer IS NULL AND sqrt((x - dx) ** 2 + (y - dy) ** 2) > tol UNION ALL SELECT key, 'not used', 'warning' FROM m WHERE dx IS NOT NULL AND key NOT IN (SELECT key FROM used))
SELECT 'points' AS "check", msg, CAST(key AS VARCHAR) AS "where", severity FROM f
""")
def points_check(spark, sf_dir):
    p = points(spark, sf_dir)
    source, layer = F.when(F.col("id") % 11 == 0, "").otherwise("survey"), F.when(F.col("id") % 13 == 0, (1 + F.col("id") % 3).cast("int"))
    refs = p.where("id % 4 <> 1").select(F.col("id").alias("key"), "x", "y", F.lit(60.0).alias("tol"), source.alias("source"), layer.alias("layer"))
    drawn = p.where("id % 17 <> 0").select(F.col("id").alias("key"), (F.col("x") + F.col("id") % 90).alias("x"), "y")
    inside = S.points_in_polygons(p, zones(spark), point="id", polygon="zone", bucket=50.0).select(F.col("id").alias("key"), F.col("zone").alias("layer"))
    return G.points_placed(drawn, refs, p.where("id % 5 <> 2").select(F.col("id").alias("key")), inside)


@query(f"""
WITH {EDGES}, {PTS}, d AS (SELECT CAST(zone AS VARCHAR) AS study, abs(sum(x0 * y1 - x1 * y0)) / 2 AS area, count(*) AS n FROM edges GROUP BY zone)
SELECT 'study' AS "check", 'the areas differ' AS msg, study AS "where", 'error' AS severity FROM d WHERE study = '2' UNION ALL SELECT 'study', 'the numbers differ', study, 'error' FROM d WHERE study = '3'
UNION ALL SELECT 'geo', 'outside the frame', CAST(id AS VARCHAR), 'error' FROM pts WHERE NOT (x BETWEEN -500 AND 9500 AND y BETWEEN 10 AND 990)
UNION ALL SELECT 'geo', 'not inside the frame', v, 'error' FROM (VALUES ('turned'), ('beyond')) t(v)
""")
def study_and_frame(spark, sf_dir):
    d = S.polygon_measures(zones(spark), polygon="zone").select(F.col("zone").cast("string").alias("study"), "area")
    drawn = d.join(zones(spark).groupBy(F.col("zone").cast("string").alias("study")).agg(F.count("*").alias("n")), "study")
    stats = drawn.select("study", (F.col("area") + F.when(F.col("study") == "2", 5.0).otherwise(0.0)).alias("area"), (F.col("n") + F.when(F.col("study") == "3", 1).otherwise(0)).alias("n"))
    frame = (-500.0, 10.0, 9500.0, 990.0)
    views = spark.createDataFrame([("whole", -500.0, 10.0, 9500.0, 990.0), ("turned", 5.0, 50.0, 4.0, 60.0), ("beyond", 0.0, 20.0, 9600.0, 30.0)], "view string, x0 double, y0 double, x1 double, y1 double")
    return Q.gate(G.study(drawn, stats), G.in_frame(points(spark, sf_dir), frame, "id"), G.views_in_frame(views, frame, "view"))


@query("""
WITH s AS (SELECT event_id AS id, user_id, 'img/' || strftime(ts, '%Y%m%d_%H%M%S') || '.jpg' AS src, strftime(ts, '%H:%M') AS real, value AS x, ts FROM events WHERE event_type = 'error')
SELECT 'photos' AS "check", 'not registered as our own' AS msg, CAST(id AS VARCHAR) AS "where", 'error' AS severity FROM s WHERE user_id % 9 IN (0, 1)
UNION ALL SELECT 'photos', 'outside the frame', CAST(id AS VARCHAR), 'error' FROM s WHERE NOT x BETWEEN 0 AND 30
UNION ALL SELECT 'photos', 'time does not match its file', CAST(id AS VARCHAR), 'error' FROM s WHERE id % 10 = 0 AND real <> '00:00' OR strftime(ts, '%Y%m%d') <> '20240101'
UNION ALL SELECT 'photos', 'bearing outside 0 to 359', CAST(id AS VARCHAR), 'error' FROM s WHERE id % 400 >= 360
UNION ALL SELECT 'photos', 'video not beside its poster', CAST(id AS VARCHAR), 'error' FROM s WHERE id % 21 = 0
""")
def photo_check(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    src = F.concat(F.lit("img/"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit(".jpg"))
    beside = F.regexp_replace(src, r"\.jpg$", ".mp4")
    video = F.when(F.col("event_id") % 21 == 0, "img/other.mp4").when(F.col("event_id") % 3 == 0, beside)
    time = F.when(F.col("event_id") % 10 == 0, "00:00").otherwise(F.date_format("ts", "HH:mm"))
    shots = e.select(F.col("event_id").alias("id"), "user_id", src.alias("src"), time.alias("time"), F.col("value").alias("x"), F.lit(1.0).alias("y"), (F.col("event_id") % 400).cast("double").alias("brg"), video.alias("video"))
    media = shots.select(F.col("id"), F.when(F.col("user_id") % 9 == 0, "").otherwise("CC").alias("licence"), (F.col("user_id") % 9 != 1).alias("own"))
    # the register is keyed by the shot here, since several may be of one second
    keyed = shots.withColumn("src0", F.col("src")).withColumn("src", F.concat(F.lit("img/"), F.col("id").cast("string"), F.lit("/"), F.substring("src0", 5, 100)))
    keyed = keyed.withColumn("video", F.when(F.col("video") == beside_of("src0"), beside_of("src")).otherwise(F.col("video")))
    register = media.join(keyed.select("id", "src"), "id").select("src", "own", "licence")
    return G.photos(keyed, register, frame=(0.0, 0.0, 30.0, 2.0), day="20240101")


def beside_of(src: str):
    return F.regexp_replace(src, r"\.jpg$", ".mp4")


@query("""
WITH t AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n, l_quantity FROM lineitem)
SELECT 'labels' AS "check", CASE WHEN w.k IS NULL THEN 'unexpected' ELSE 'missing' END AS msg, CAST(coalesce(w.k, g.k) AS VARCHAR) AS "where", 'error' AS severity
FROM (SELECT DISTINCT k FROM t WHERE n >= 6) w FULL JOIN (SELECT DISTINCT k FROM t WHERE l_quantity >= 48) g ON w.k = g.k WHERE w.k IS NULL OR g.k IS NULL
UNION ALL SELECT 'rows', 'torn', CAST(c_custkey AS VARCHAR), 'error' FROM customer WHERE c_custkey % 100 = 0
""")
def label_check(spark, sf_dir):
    """Labels that the data gives against those drawn, and rows with another number of fields than the header."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"))
    want = g.agg(F.count("*").alias("n")).where("n >= 6").select("k")
    drawn = table(spark, sf_dir, "lineitem").where("l_quantity >= 48").select(F.col("l_orderkey").alias("k"))
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", F.when(F.col("c_custkey") % 100 == 0, "a,b").otherwise("a"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.size(F.split(line, ",")).alias("fields"))
    return Q.gate(Q.set_difference(want, drawn, "k", "labels"), Q.finding(rows.where("fields <> 3"), "rows", "torn", F.col("c_custkey")))


@query("""
SELECT 'links' AS "check", 'not registered' AS msg, url AS "where", 'error' AS severity FROM (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS url FROM pages) WHERE url NOT IN (SELECT regexp_extract(url, '^https?://([^/]+)', 1) FROM pages WHERE page_id % 2 = 0)
UNION ALL SELECT 'media', 'licence not allowed', CAST(doc_id AS VARCHAR), 'error' FROM documents WHERE NOT (starts_with(source, 'src1') OR starts_with(source, 'src2'))
UNION ALL SELECT 'media', 'credit lacks its author', CAST(doc_id AS VARCHAR), 'error' FROM documents WHERE doc_id % 30 = 0
UNION ALL SELECT 'names', 'one script only', CAST(doc_id AS VARCHAR), 'error' FROM documents WHERE NOT regexp_matches(substr(text, 1, 200), '[A-Za-z]{3,}')
""")
def media_and_links(spark, sf_dir):
    """Hosts used against those registered, licences by allowed beginnings, credits that must name their author, and scripts of names."""
    from tessellum.functions.text import has_latin

    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    p, d = table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents")
    used, known = p.select(host.alias("k")), p.where("page_id % 2 = 0").select(host.alias("k"))
    links = Q.both_ways(used, known, "k", "links").where("severity = 'error'")
    credit = F.concat(F.lit("by "), F.when(F.col("doc_id") % 30 == 0, "nobody").otherwise(F.col("source")))
    return Q.gate(
        links,
        Q.starts_with_any(d, "doc_id", "source", ["src1", "src2"], "media", "licence not allowed"),
        Q.finding(d.where(~F.contains(credit, F.col("source"))), "media", "credit lacks its author", F.col("doc_id")),
        Q.finding(d.where(~has_latin(F.substring("text", 1, 200))), "names", "one script only", F.col("doc_id")),
    )


#: Further kinds of claims: shares of overlaps, counts by a test, steepness of a drawn profile.
FURTHER = [
    ("o1", "overlap", "1", "2", 10.0, 0.5, False),
    ("o2", "overlap", "3", "1", 20.0, 15.0, False),
    ("o3", "overlap", "3", "2", 1.0, 0.1, False),
    ("b1", "bld", "all", "", 1.0, 0.5, False),
    ("b2", "bld", "debt", "", 0.0, 0.99, True),
    ("b3", "bld", "none", "", 0.0, 0.5, False),
    ("v1", "valley_ve", "up", "", 30.0, 30.0, False),
    ("v2", "valley_ve", "down", "", 1000.0, 0.1, True),
    ("v3", "valley_ve", "across", "", 1.0, 0.1, True),
]
FURTHER_ROWS = ", ".join(f"('{i}', '{k}', '{a}', '{b}', {e}::DOUBLE, {t}::DOUBLE, {str(r).lower()})" for i, k, a, b, e, t, r in FURTHER)


@query(f"""
WITH {STRIPS.replace(SHAPES, EDGES)}, claims(id, kind, a, b, expect, tol, relative) AS (VALUES {FURTHER_ROWS}), whole AS (SELECT zone, sum(b - a) * 5 AS area FROM strips GROUP BY zone),
shared AS (SELECT p.zone AS a, q.zone AS b, sum(least(p.b, q.b) - greatest(p.a, q.a)) * 5 AS area FROM strips p JOIN strips q ON p.row = q.row AND p.zone <> q.zone AND least(p.b, q.b) > greatest(p.a, q.a) GROUP BY 1, 2),
counts AS (SELECT 'all' AS a, count(*) AS got FROM customer UNION ALL SELECT 'debt', count(*) FROM customer WHERE c_acctbal < 0), line AS (SELECT avg(s_acctbal) / 100 AS bend, max(s_acctbal) / 100 AS length, count(*) / 10 AS coast FROM supplier),
ve AS (SELECT (250.0::DOUBLE / 1900) / (880.0::DOUBLE / (bend + 3 * (length - bend + coast)) / 1000) AS ve FROM line),
got AS (SELECT id, 100 * shared.area / whole.area AS got FROM claims JOIN shared ON CAST(shared.a AS VARCHAR) = claims.a AND CAST(shared.b AS VARCHAR) = claims.b JOIN whole ON whole.zone = shared.a WHERE kind = 'overlap'
 UNION ALL SELECT id, got FROM claims JOIN counts USING (a) WHERE kind = 'bld' UNION ALL SELECT id, CASE a WHEN 'up' THEN ve ELSE ve / 3 END FROM claims, ve WHERE kind = 'valley_ve' AND a IN ('up', 'down'))
SELECT 'derived' AS "check", CASE WHEN got IS NULL THEN 'check could not run' ELSE 'is not what the text relies on' END AS msg, id AS "where", 'error' AS severity
FROM claims LEFT JOIN got USING (id) WHERE got IS NULL OR abs(got - expect) > tol * CASE WHEN relative THEN abs(expect) ELSE 1 END
""")
def further_kinds(spark, sf_dir):
    """Claims on overlaps, counts and drawn profiles, recomputed."""
    claims = spark.createDataFrame(FURTHER, "id string, kind string, a string, b string, expect double, tol double, relative boolean")
    of = lambda kind: claims.where(F.col("kind") == kind).select("id", "a", "b")
    strips = L.scanline(zones(spark), polygon="zone", step=5.0)
    shares = G.overlap_shares(strips, polygon="zone", step=5.0).select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "got")
    counts = G.counted(table(spark, sf_dir, "customer"), {"all": F.lit(True), "debt": F.col("c_acctbal") < 0})
    line = table(spark, sf_dir, "supplier").agg((F.avg("s_acctbal") / 100).alias("bend"), (F.max("s_acctbal") / 100).alias("length"), (F.count("*") / 10).alias("coast"))
    up = G.vertical_exaggeration(F.col("bend"), F.col("length"), F.col("coast"))
    drawn = line.select(F.explode(F.array(F.struct(F.lit("up").alias("a"), up.alias("got")), F.struct(F.lit("down").alias("a"), (up / 3).alias("got")))).alias("x")).select("x.*")
    results = [of("overlap").join(shares, ["a", "b"]), of("bld").join(counts, "a"), of("valley_ve").join(drawn, "a")]
    return G.derived(claims, [r.select("id", "got") for r in results])


@query("""
WITH held AS (SELECT CASE n_nationkey % 5 WHEN 0 THEN 'frame' WHEN 1 THEN 'views' WHEN 2 THEN 'layers' WHEN 3 THEN 'crs' ELSE 'stats' END AS name, max(n_name) AS value FROM nation GROUP BY 1),
layers AS (SELECT CAST(p_partkey AS VARCHAR) AS key, CASE p_partkey % 7 WHEN 0 THEN 'M ' || p_size || ',1 L 2.5,-3 Z M1 1L2 2' WHEN 1 THEN 'M ' || p_size WHEN 2 THEN 'L 1,2' WHEN 3 THEN 'M 1,2 Q 3,4' WHEN 4 THEN '' WHEN 5 THEN 'M -1,2 3,4 L5 -6Z' END AS d FROM part)
SELECT 'geo' AS "check", 'missing' AS msg, n AS "where", 'error' AS severity FROM (VALUES ('frame'), ('views'), ('layers'), ('pts'), ('stats'), ('origin'), ('crs')) t(n) WHERE n NOT IN (SELECT name FROM held)
UNION ALL SELECT 'geo', 'unexpected CRS', value, 'error' FROM held WHERE name = 'crs' AND value <> 'EPSG:6674' UNION ALL SELECT 'geo', 'layer does not parse', key, 'error' FROM layers JOIN part ON CAST(p_partkey AS VARCHAR) = key WHERE p_partkey % 7 NOT IN (0, 5)
""")
def structure_check(spark, sf_dir):
    """Parts of a data file that are missing or wrong, and layers that can't be read."""
    n, k = F.col("n_nationkey") % 5, F.col("p_partkey") % 7
    name = F.when(n == 0, "frame").when(n == 1, "views").when(n == 2, "layers").when(n == 3, "crs").otherwise("stats")
    held = table(spark, sf_dir, "nation").groupBy(name.alias("name")).agg(F.max("n_name").alias("value"))
    size = F.col("p_size").cast("string")
    d = F.when(k == 0, F.concat(F.lit("M "), size, F.lit(",1 L 2.5,-3 Z M1 1L2 2"))).when(k == 1, F.concat(F.lit("M "), size)).when(k == 2, "L 1,2").when(k == 3, "M 1,2 Q 3,4").when(k == 4, "").when(k == 5, "M -1,2 3,4 L5 -6Z")
    layers = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), d.alias("d"))
    return Q.gate(G.structure(held, ["frame", "views", "layers", "pts", "stats", "origin", "crs"], layers, crs="EPSG:6674"))


@query("""
WITH s AS (SELECT 'img/' || s_suppkey || '.jpg' AS src, s_suppkey AS k, 100 + s_suppkey % 50 AS w, 80 + s_suppkey % 30 AS h FROM supplier)
SELECT 'media' AS "check", 'declares ' || CASE WHEN k % 5 = 1 THEN '' ELSE CAST(CASE WHEN k % 5 = 0 THEN w + 1 ELSE w END AS VARCHAR) END || '×' || h || ' px but the file is ' || w || '×' || h AS msg, src AS "where", 'error' AS severity FROM s WHERE k % 5 IN (0, 1) AND k % 4 <> 0
UNION ALL SELECT 'media', 'the source link differs from the register', src, 'error' FROM s WHERE k % 6 IN (1, 2)
""")
def picture_sizes(spark, sf_dir):
    """Pictures that declare another size than their file has, and links that aren't the registered ones."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k.alias("k"), F.concat(F.lit("img/"), k.cast("string"), F.lit(".jpg")).alias("src"), (100 + k % 50).alias("width"), (80 + k % 30).alias("height"))
    k = F.col("k")
    said = F.when(k % 5 == 1, F.lit("")).otherwise(F.concat(F.lit('" width="'), F.when(k % 5 == 0, F.col("width") + 1).otherwise(F.col("width")).cast("string")))
    tag = F.concat(F.lit('<img class="p" src="'), "src", said, F.lit('" height="'), F.col("height").cast("string"), F.lit('" alt="a > b">'))
    pages = s.groupBy((k % 7).alias("page")).agg(F.concat_ws("<p>text</p>", F.collect_list(tag)).alias("html"))
    links = s.select("src", F.when(k % 6 == 1, F.lit(None)).otherwise(F.concat(F.lit("u"), F.when(k % 6 == 2, k + 1).otherwise(k).cast("string"))).alias("url"))
    return Q.gate(G.declared_sizes(pages, s.where("k % 4 <> 0")), G.sources_agree(links, s.select("src", F.concat(F.lit("u"), k.cast("string")).alias("source"))))
