"""Queries and operators that SQL doesn't express, against plain versions on tables and on networks made here."""

import heapq
import math
import random
from html.parser import HTMLParser

from tessellum.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()


def network(seed: int, n: int = 25):
    r = random.Random(seed)
    edges = {}
    for u in range(n):
        for v in r.sample(range(n), 4):
            if u != v:
                w = r.uniform(1, 9)
                edges[u, v] = w
                if r.random() < 0.7:
                    edges[v, u] = w
    return edges


def solve(edges, root, back=False):
    """(distance, neighbour towards the root) of each node."""
    near = {}
    for (u, v), w in edges.items():
        a, b = (v, u) if back else (u, v)
        near.setdefault(a, []).append((b, w))
    dist, heap = {root: 0.0}, [(0.0, root)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > dist[u]:
            continue
        for v, w in near.get(u, ()):
            if d + w < dist.get(v, math.inf):
                dist[v] = d + w
                heapq.heappush(heap, (d + w, v))
    to = {}
    for a, listed in near.items():
        for b, w in listed:
            if a in dist and b != root and abs(dist[a] + w - dist[b]) <= 1e-9:
                to[b] = min(to.get(b, a), a)
    return dist, to


def key(u, v):
    return (min(u, v), max(u, v))


def routes(df):
    out = {}
    for r in df.orderBy("route", "seq").collect():
        out.setdefault(r.route, []).append((r.u, r.v))
    return [out[k] for k in sorted(out)]


def frame(spark, edges):
    return spark.createDataFrame([(u, v, w) for (u, v), w in edges.items()], "u long, v long, w double")


def all_paths(edges, start, end, over=()):
    """Every path without a repeated node, as a tuple of edges."""
    if start == end:
        yield ()
    else:
        for u, v in edges:
            if u == start and v not in over:
                for rest in all_paths(edges, v, end, (*over, u)):
                    yield ((u, v), *rest)


def length(edges, path):
    return sum(edges[e] for e in path)


def kept_apart(edges, offered, share):
    """Which of the listed paths stay: those that no path kept before them overlaps by more than the share of the shorter one."""
    kept = []
    for p in offered:
        sides = [{key(*e) for e in k} for k in kept]
        common = [sum(edges[e] for e in p if key(*e) in s) for s in sides]
        if not any(c > share * min(length(edges, p), length(edges, k)) for c, k in zip(common, kept, strict=True)):
            kept.append(p)
    return [list(p) for p in kept]


def test_penalty_alternatives(spark):
    from tessellum.operators.routing import penalty_alternatives

    edges = network(2, 8)
    end = max((d, n) for n, d in solve(edges, 0)[0].items())[1]
    every = list(all_paths(edges, 0, end))
    found = []
    for _ in range(4):
        used = [key(*e) for p in found for e in p]
        found.append(min(every, key=lambda p: sum(edges[e] * 4.0 ** used.count(key(*e)) for e in p)))
    fine = [p for p in found if length(edges, p) <= 2.5 * length(edges, found[0])]
    want = kept_apart(edges, fine, 0.5)
    assert routes(penalty_alternatives(frame(spark, edges), 0, end, rounds=4, stretch=2.5)) == want and len(want) > 1


def test_plateau_routes(spark):
    from tessellum.operators.routing import plateau_routes

    edges = network(5, 9)
    end = max((d, n) for n, d in solve(edges, 0)[0].items())[1]
    best = lambda a, b: min(all_paths(edges, a, b), key=lambda p: length(edges, p), default=None)
    ahead, rest = {n: best(0, n) for n in range(9)}, {n: best(n, end) for n in range(9)}
    both = {e for p in ahead.values() for e in p or ()} & {e for p in rest.values() for e in p or ()}
    offered = []
    for x in {u for u, _ in both} - {v for _, v in both}:
        chain, y = [], x
        while onward := [e for e in both if e[0] == y]:
            chain += onward
            y = onward[0][1]
        path = ahead[y] + rest[y]
        assert [e for e in path if e in chain] == chain
        if length(edges, path) <= 1.5 * length(edges, ahead[end]) + 1e-9 and length(edges, chain) >= 0.08 * length(edges, ahead[end]):
            offered.append((-length(edges, chain), x, path))
    want = kept_apart(edges, [p for *_, p in sorted(offered)], 0.8)
    assert routes(plateau_routes(frame(spark, edges), 0, end)) == want[:8] and want


def test_route_queries_have_rows(spark):
    for name in ("penalty_routes", "plateau_routes"):
        got = QUERIES[name](spark, SF).collect()
        for k in {r.route for r in got}:
            own = sorted((r.seq, r.u, r.v) for r in got if r.route == k)
            assert [s for s, *_ in own] == list(range(len(own))) and own[0][1] == 0 and own[-1][2] == 9
            assert all(a[2] == b[1] for a, b in zip(own, own[1:], strict=False))
        assert got, name


def test_bridges_of_made_networks(spark):
    """Against removal of every edge, with parallel edges, rings, single edges and several components."""
    from tessellum.operators.graph import bridges

    r = random.Random(8)
    for n, m in ((30, 29), (40, 60)):
        edges = [(a, b) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(m)) if a != b]
        edges += edges[:2] + [(100, 101), (101, 102), (200, 201), (201, 202), (202, 200)]
        weight = {k: float(k % 7) for k in {x for e in edges for x in e} if k % 3}

        def part(node, skip=None, edges=edges):
            seen, todo = {node}, [node]
            while todo:
                x = todo.pop()
                for i, e in enumerate(edges):
                    if i != skip and x in e and (y := e[0] if e[1] == x else e[1]) not in seen:
                        seen.add(y)
                        todo.append(y)
            return seen

        want = set()
        for i, (a, b) in enumerate(edges):
            whole = part(a)
            if b not in part(a, i):
                root = 101 if 101 in whole else min(whole)
                want.add((*key(a, b), sum(weight.get(x, 0) for x in whole - part(root, i))))
        w = spark.createDataFrame(list(weight.items()), "node long, weight double")
        got = bridges(spark.createDataFrame(edges, "u long, v long"), w, root=101)
        assert {(x.u, x.v, round(x.beyond, 6)) for x in got.collect()} == want


def test_bridges_of_a_star_and_a_path(spark):
    from tessellum.operators.graph import bridges

    edges = spark.createDataFrame([(0, k) for k in range(1, 150)] + [(k, k + 1) for k in range(1000, 1100)], "u long, v long")
    one = edges.selectExpr("explode(array(u, v)) as node").distinct().selectExpr("node", "1.0 as weight")
    got = {(r.u, r.v): r.beyond for r in bridges(edges, one, root=0).collect()}
    assert len(got) == 249 and all(got[0, k] == 1 for k in range(1, 150)) and all(got[k, k + 1] == 1100 - k for k in range(1000, 1100))


def test_corridors_and_bridges(spark):
    from tessellum.plans.graphs import in_rows

    edges = [(r.u, r.v, r.w) for r in in_rows(spark, SF).collect()]
    degree = {}
    for u, v, _ in edges:
        degree[u], degree[v] = degree.get(u, 0) + 1, degree.get(v, 0) + 1
    left, want = set(range(len(edges))), []
    while left:
        part, todo = set(), [min(left)]
        while todo:
            i = todo.pop()
            if i in part:
                continue
            part.add(i)
            inner = {n for n in edges[i][:2] if degree[n] == 2}
            todo += [j for j in left if inner & set(edges[j][:2])]
        left -= part
        ends = sorted(n for i in part for n in edges[i][:2] if degree[n] != 2)
        want.append((ends[0] if ends else None, ends[-1] if ends else None, sum(edges[i][2] for i in part), len(part)))
    got = [(r.a, r.b, r.total, r.n) for r in QUERIES["corridors"](spark, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)

    def reached(skip):
        seen, todo = {100}, [100]
        while todo:
            n = todo.pop()
            for i, (u, v, _) in enumerate(edges):
                if i != skip and n in (u, v) and (m := v if n == u else u) not in seen:
                    seen.add(m)
                    todo.append(m)
        return seen

    weight = {r.c_nationkey: r["count"] for r in spark.read.parquet(f"{SF}/customer.parquet").groupBy("c_nationkey").count().collect()}
    whole = reached(None)
    cut = {(*key(u, v), float(sum(weight.get(n, 0) for n in whole - reached(i)))) for i, (u, v, _) in enumerate(edges) if whole - reached(i)}
    assert {tuple(r) for r in QUERIES["bridges"](spark, SF).collect()} == cut and cut


def test_drainage(spark):
    """Each cell drains to a neighbour; water never rises above the fill level, which is the least rim on any way out."""
    from tessellum.plans.spatial import cells

    v = {(f"g{int(r.r) // 20}", int(r.r), int(r.c)): r.v for r in cells(spark, SF).collect()}
    got = {(r.grid, r.r, r.c): (r.to_r, r.to_c, r.cells) for r in QUERIES["drainage"](spark, SF).collect()}
    assert set(got) == set(v)
    near = lambda k: [(k[0], k[1] + a, k[2] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    level = {k: (h if any(n not in v for n in near(k)) else math.inf) for k, h in v.items()}
    changed = True
    while changed:
        changed = False
        for k, h in v.items():
            low = max(h, min((level[n] for n in near(k) if n in v), default=math.inf))
            if low < level[k]:
                level[k], changed = low, True
    inflow = dict.fromkeys(v, 1)
    for k, (r, c, _) in got.items():
        if r < 0:
            assert any(n not in v for n in near(k))
        else:
            assert (k[0], r, c) in near(k) and level[k[0], r, c] <= level[k]
    order, seen = [], set()

    def visit(k):
        while k not in seen and k in got:
            seen.add(k)
            order.append(k)
            r, c, _ = got[k]
            if r < 0:
                return
            k = (k[0], r, c)

    for k in v:
        visit(k)
    for k in v:  # every cell adds one to all cells on its way out
        at, steps = k, 0
        while got[at][0] >= 0:
            at = (at[0], *got[at][:2])
            inflow[at] += 1
            steps += 1
            assert steps <= len(v)
    assert {k: n for k, (_, _, n) in got.items()} == inflow


def test_smoothest_states(spark):
    events = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").collect():
        events.setdefault(f"u{r.user_id}", []).append(r.value)
    states = (0.0, 10.0, 20.0, 40.0)
    got = {}
    for r in QUERIES["smoothest_states"](spark, SF).orderBy("route", "seq").collect():
        got.setdefault(r.route, []).append(r.state)
    assert set(got) == set(events)
    for k, values in events.items():
        best = {s: abs(values[0] - s) for s in states}
        for x in values[1:]:
            best = {s: abs(x - s) + min(best[b] + 0.5 * abs(s - b) for b in states) for s in states}
        cost = sum(abs(x - s) for x, s in zip(values, got[k], strict=True)) + 0.5 * sum(abs(a - b) for a, b in zip(got[k], got[k][1:], strict=False))
        assert abs(cost - min(best.values())) < 1e-9


def test_page_inventory(spark):
    """Every word of a page outside scripts and styles stands in its inventory, in order."""

    class Words(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=False)
            self.out, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style")

        def handle_data(self, data):
            if not self.skip:
                self.out += data.split()

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {}
    for r in QUERIES["page_inventory"](spark, SF).orderBy("page_id", "i").collect():
        got.setdefault(r.page_id, []).append(r.text)
    ascii_words = lambda s: [w for w in s if w.isalpha()]
    checked = 0
    for k, html in pages.items():
        if "<![CDATA[" in html:
            continue
        p = Words()
        p.feed(html)
        p.close()
        want = ascii_words(p.out)
        have = ascii_words(" ".join(got.get(k, [])).split())
        assert set(want) <= set(" ".join(got.get(k, [])).replace("&", " &").split()) | set(have), k
        checked += 1
    assert checked > 0


def test_smallest_boxes(spark):
    pts = {}
    for r in spark.read.parquet(f"{SF}/customer.parquet").collect():
        pts.setdefault(r.c_custkey % 20, []).append((r.c_acctbal, r.c_custkey * 37 % 1000))
    for r in QUERIES["smallest_boxes"](spark, SF).collect():
        if r.long is None:
            assert len(set(pts[r.k])) < 2
            continue
        area = min(
            (max(a) - min(a)) * (max(b) - min(b))
            for t in range(0, 1800)
            for g in [math.radians(t / 10)]
            for a in [[x * math.cos(g) + y * math.sin(g) for x, y in pts[r.k]]]
            for b in [[y * math.cos(g) - x * math.sin(g) for x, y in pts[r.k]]]
        )
        assert r.long * r.short <= area + 1e-6 and r.long >= r.short
        g = math.radians(r.direction)
        along = [x * math.cos(g) + y * math.sin(g) for x, y in pts[r.k]]
        assert abs(max(along) - min(along) - r.long) < 1e-6
