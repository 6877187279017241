"""Building blocks of the DuckDB statements: each one is the text of a few CTEs."""

from __future__ import annotations

CELLS = """st AS (
  SELECT (s_suppkey - 1) // 10 AS run_id, (s_suppkey * 7919) % 38 AS t0, 4 + (s_suppkey * 31) % 9 AS life,
    4 + (s_suppkey * 104729) % 32 AS x0, 4 + (s_suppkey * 15485863) % 32 AS y0,
    ((s_suppkey * 13) % 5 - 2) * 0.5::DOUBLE AS vx, ((s_suppkey * 17) % 5 - 2) * 0.5::DOUBLE AS vy,
    2 + (s_suppkey * 11) % 4 AS r, 8 + (s_suppkey * 23) % 40 AS peak FROM supplier),
c AS (
  SELECT run_id, t0 + a.k AS t, x0 + b.k AS x, y0 + d.k AS y,
    (b.k - vx * a.k) * (b.k - vx * a.k) + (d.k - vy * a.k) * (d.k - vy * a.k) AS d2, r, peak
  FROM st, range(0, 12) a(k), range(-10, 11) b(k), range(-10, 11) d(k) WHERE a.k < life),
cells AS MATERIALIZED (
  SELECT run_id, t, y, x, max(peak / (1 + d2 / (r * r)::DOUBLE)) AS pr,
    min(290 - 100 / (1 + d2 / (6.0::DOUBLE * r * r))) AS bt
  FROM c WHERE x BETWEEN 0 AND 39 AND y BETWEEN 0 AND 39 AND t BETWEEN 0 AND 47 GROUP BY ALL)"""

RUN_GRIDS = """rg AS (
  SELECT run_id, CAST(a.k AS INTEGER) AS y, CAST(b.k AS INTEGER) AS x,
    20 + 0.5::DOUBLE * (run_id % 60) + 0.04::DOUBLE * a.k AS lat,
    -100 + 1.5::DOUBLE * (run_id % 100) + 0.04::DOUBLE * b.k AS lon
  FROM (SELECT DISTINCT (s_suppkey - 1) // 10 AS run_id FROM supplier), range(40) a(k), range(40) b(k))"""

GRID = """grid AS (
  SELECT a.k AS y, b.k AS x, 20 + 0.04::DOUBLE * a.k AS lat, -100 + 0.04::DOUBLE * b.k AS lon
  FROM range(40) a(k), range(40) b(k))"""

DENSE = (
    CELLS
    + """, dense AS MATERIALIZED (
  SELECT r.run_id, CAST(ta.k AS INTEGER) AS t, CAST(ya.k AS INTEGER) AS y, CAST(xa.k AS INTEGER) AS x,
    10 + 0.25::DOUBLE * ((ya.k * 3 + ta.k) % 7) AS u, -5 + 0.25::DOUBLE * ((xa.k * 5 + ta.k) % 9) AS v,
    8 + 0.5::DOUBLE * ((xa.k + ya.k) % 4) AS q, 290 + 0.5::DOUBLE * ((xa.k + 2 * ya.k + ta.k) % 5) AS tk,
    CAST(300 + 10 * ((xa.k * ya.k + ta.k) % 40) AS DOUBLE) AS ivte,
    CAST(-100 + 5 * ((xa.k + ta.k) % 30) AS DOUBLE) AS ivtn,
    coalesce(c.pr, 0.0::DOUBLE) AS pr, coalesce(c.bt, 290.0::DOUBLE) AS bt,
    101300 - 40 * coalesce(c.pr, 0.0::DOUBLE) AS slp
  FROM (SELECT DISTINCT (s_suppkey - 1) // 10 AS run_id FROM supplier) r, range(48) ta(k), range(40) ya(k), range(40) xa(k)
  LEFT JOIN cells c ON c.run_id = r.run_id AND c.t = ta.k AND c.y = ya.k AND c.x = xa.k)"""
)

GAUGE = """gauge AS (
  SELECT epoch_us(ts) // 1800000000 * 1800 AS epoch, CAST(user_id % 12 AS INTEGER) AS y,
    CAST(CAST(json_extract(props, '$.k') AS INTEGER) % 12 AS INTEGER) AS x, value FROM events)"""

OUTLINES = """outline(poly_id, x1, y1, x2, y2) AS (VALUES
  (1, -99.9::DOUBLE, 20.1::DOUBLE, -99.1::DOUBLE, 20.1::DOUBLE), (1, -99.1, 20.1, -99.1, 20.9),
  (1, -99.1, 20.9, -99.9, 20.9), (1, -99.9, 20.9, -99.9, 20.1), (1, -99.7, 20.3, -99.3, 20.3),
  (1, -99.3, 20.3, -99.3, 20.7), (1, -99.3, 20.7, -99.7, 20.7), (1, -99.7, 20.7, -99.7, 20.3),
  (2, -99.0, 20.2, -98.45, 20.8), (2, -98.45, 20.8, -98.9, 21.5), (2, -98.9, 21.5, -99.0, 20.2))"""

REGULAR = """gr AS (SELECT y, x, lat, lon, d AS dy, d * cos(radians(lat)) AS dx FROM grid,
  (SELECT 40075000 / (360 / (max(lat) FILTER (y = 1) - max(lat) FILTER (y = 0))) AS d FROM grid))"""


def with_(parts: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


def haversine(lat1: str, lon1: str, lat2: str, lon2: str, radius: float) -> str:
    return (
        f"2 * {radius} * asin(sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)))"
    )


METRICS = f"""dist AS (
  SELECT g.*, {haversine("l.lat", "l.lon", "g.lat", "g.lon", 6371000)} AS dx0,
    {haversine("u.lat", "u.lon", "g.lat", "g.lon", 6371000)} AS dy0
  FROM grid g LEFT JOIN grid l ON l.y = g.y AND l.x = g.x - 1 LEFT JOIN grid u ON u.x = g.x AND u.y = g.y - 1),
metrics AS MATERIALIZED (
  SELECT a.y, a.x, a.lat, a.lon, b.dx0 AS dx, c.dy0 AS dy, b.dx0 * c.dy0 AS area FROM dist a
  JOIN dist b ON b.y = a.y AND b.x = greatest(a.x, 1) JOIN dist c ON c.x = a.x AND c.y = greatest(a.y, 1))"""


def components(name: str, mask: str, slice_only: bool = False, seam: bool = False) -> str:
    """Cells ``run_id, t, y, x, object_key``: smallest reachable run of cells."""
    rows = "(0, 1), (0, -1)" if slice_only else ", ".join(
        str((a, b)) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)
    )
    across = (
        f""" UNION ALL SELECT a.node, b.node FROM {name}_s a JOIN {name}_s b ON a.run_id = b.run_id AND a.t = b.t
          AND a.y = b.y AND a.node <> b.node AND ((a.x0 = 0 AND b.x1 = 39) OR (a.x1 = 39 AND b.x0 = 0))"""
        if seam
        else ""
    )
    return f"""{name}_m AS MATERIALIZED (SELECT *, x - row_number() OVER (PARTITION BY run_id, t, y ORDER BY x) AS g FROM ({mask})),
{name}_s AS MATERIALIZED (SELECT run_id, t, y, g, min(x) AS x0, max(x) AS x1,
  ((CAST(run_id AS BIGINT) * 64 + t) * 64 + y) * 64 + min(x) AS node FROM {name}_m GROUP BY run_id, t, y, g),
{name}_e(a, b) AS MATERIALIZED (SELECT a.node, b.node FROM {name}_s a CROSS JOIN (VALUES {rows}) o(dt, dy)
  JOIN {name}_s b ON b.run_id = a.run_id AND b.t = a.t + dt AND b.y = a.y + dy AND a.x0 <= b.x1 + 1 AND b.x0 <= a.x1 + 1{across}),
{name}_r(node, label) AS (SELECT node, node FROM {name}_s UNION
  SELECT e.b, r.label FROM {name}_r r JOIN {name}_e e ON e.a = r.node WHERE r.label < e.b),
{name}_l AS MATERIALIZED (SELECT node, min(label) AS label FROM {name}_r GROUP BY node),
{name} AS MATERIALIZED (SELECT m.run_id, m.t, m.y, m.x,
  (label // 4096) % 64 * 1099511627776 + (label // 64) % 64 * 1048576 + label % 64 AS object_key
  FROM {name}_m m JOIN {name}_s s ON s.run_id = m.run_id AND s.t = m.t AND s.y = m.y AND s.g = m.g
  JOIN {name}_l l ON l.node = s.node)"""


def labels_of(name: str) -> str:
    return f"SELECT run_id, t, y, x, object_key FROM {name}"


def steps(name: str, value: str) -> str:
    return f"""{name}_steps AS MATERIALIZED (
  SELECT run_id, object_key, t, count(*) AS n_cells, sum(area) AS size, min({value}) AS lowest, max({value}) AS highest,
    avg({value}) AS average, sum({value}) AS tot, avg(y) AS cy, avg(x) AS cx
  FROM {name} JOIN cells USING (run_id, t, y, x) JOIN metrics USING (y, x) GROUP BY run_id, object_key, t)"""


def kept(name: str, area_km2: float, w: int) -> str:
    return f"""{name}_ids AS MATERIALIZED (
  SELECT run_id, object_key, row_number() OVER (PARTITION BY run_id ORDER BY object_key) AS object_id FROM (
    SELECT DISTINCT run_id, object_key FROM (
      SELECT run_id, object_key, sum(CASE WHEN size >= {area_km2} * 1e6 THEN 1 ELSE 0 END) OVER (
        PARTITION BY run_id, object_key ORDER BY t RANGE BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS good
      FROM {name}_steps) WHERE good = {w}))"""


def stats(name: str, min_steps: int, ids: str | None = None, out: str | None = None) -> str:
    ids, out = ids or f"{name}_ids", out or f"{name}_stats"
    return f"""{out}_box AS (SELECT run_id, object_key, min(y) AS y0, min(x) AS x0, count(DISTINCT t) AS n
  FROM {name} GROUP BY ALL),
{out} AS MATERIALIZED (
  SELECT s.*, i.object_id, g.lat, g.lon, CASE WHEN s.t - lag(s.t) OVER w = 1 THEN
    sqrt(pow(s.cy - lag(s.cy) OVER w, 2) + pow(s.cx - lag(s.cx) OVER w, 2))
    * (SELECT (avg(dx) + avg(dy)) / 2 FROM metrics) / 1000 END AS speed_km
  FROM {name}_steps s JOIN {ids} i USING (run_id, object_key) JOIN {out}_box b USING (run_id, object_key)
  JOIN grid g ON g.y = round_even(s.cy - y0, 0) + y0 AND g.x = round_even(s.cx - x0, 0) + x0
  WHERE b.n >= {min_steps} WINDOW w AS (PARTITION BY s.run_id, s.object_key ORDER BY s.t))"""


def storm(compat: bool = False) -> str:
    lost = """, lost AS (SELECT run_id, pr_id, min(bt_id) AS bt_id FROM (
      SELECT run_id, pr_id, coalesce(bt_id, 0) AS bt_id FROM cover) GROUP BY ALL)""" if compat else ""
    drop = "WHERE (run_id, pr_id, bt_id) NOT IN (SELECT (run_id, pr_id, bt_id) FROM lost)" if compat else ""
    return f"""prc AS MATERIALIZED (SELECT r.run_id, t, y, x, object_id AS pr_id FROM rain r JOIN rain_ids USING (run_id, object_key)),
btc AS MATERIALIZED (SELECT r.run_id, r.t, r.y, r.x, object_id AS bt_id, bt FROM cloud r JOIN cloud_ids USING (run_id, object_key)
  JOIN cells USING (run_id, t, y, x)),
cover AS MATERIALIZED (SELECT DISTINCT a.run_id, pr_id, bt_id FROM prc a LEFT JOIN btc b USING (run_id, t, y, x)){lost},
pairs AS MATERIALIZED (SELECT * FROM (SELECT * FROM cover WHERE bt_id IS NOT NULL) {drop}),
box AS (SELECT run_id, pr_id, min(t) AS t0, max(t) AS t1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1
  FROM prc GROUP BY ALL HAVING max(t) > min(t)),
shield AS (SELECT p.run_id, pr_id, t, sum(size) AS area FROM pairs p JOIN cloud_ids i ON i.run_id = p.run_id AND i.object_id = p.bt_id
  JOIN cloud_steps s ON s.run_id = i.run_id AND s.object_key = i.object_key GROUP BY ALL),
cold AS (SELECT b.run_id, pr_id, c.t, min(bt) AS bt_min FROM box b JOIN btc c ON c.run_id = b.run_id
  AND c.t BETWEEN t0 AND t1 AND c.y BETWEEN y0 AND y1 AND c.x BETWEEN x0 AND x1 GROUP BY ALL),
verdict AS MATERIALIZED (
  SELECT s.run_id, i.object_id AS pr_id, s.t, s.size / 1e6 AS rain_km2, coalesce(h.area, 0) / 1e6 AS cloud_km2,
    s.highest AS pr_max, coalesce(c.bt_min, 999) AS bt_min,
    max(s.highest) OVER (PARTITION BY s.run_id, i.object_id) AS lifetime_peak,
    coalesce(h.area, 0) / 1e6 >= 1000 AND coalesce(c.bt_min, 999) <= 225 AND s.size / 1e6 >= 500 AND s.highest >= 5
      AND max(s.highest) OVER (PARTITION BY s.run_id, i.object_id) >= 15 AS ok
  FROM rain_steps s JOIN rain_ids i USING (run_id, object_key)
  JOIN box b ON b.run_id = s.run_id AND b.pr_id = i.object_id
  LEFT JOIN shield h ON h.run_id = s.run_id AND h.pr_id = i.object_id AND h.t = s.t
  LEFT JOIN cold c ON c.run_id = s.run_id AND c.pr_id = i.object_id AND c.t = s.t
  WHERE (s.run_id, i.object_id) IN (SELECT (run_id, pr_id) FROM pairs)),
storms AS MATERIALIZED (SELECT run_id, pr_id, row_number() OVER (PARTITION BY run_id ORDER BY pr_id) AS storm_id FROM (
  SELECT DISTINCT run_id, pr_id FROM (SELECT run_id, pr_id, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (
    PARTITION BY run_id, pr_id ORDER BY t RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) AS good FROM verdict) WHERE good = 5))"""


def rivers(name: str, min_km: float, min_lat: float, ratio: float) -> str:
    """``river``: cells of ``name`` (with ``object_id``) in the steps in which they are long, narrow and poleward enough.

    The smallest rectangle lies along one of the lines through two of the points; of equal ones the
    least turned is taken.
    """

    def side(a: str, b: str) -> str:
        (u0, v0), (u1, v1) = a.split(), b.split()
        lon = [f"(cos(r) * {u} - sin(r) * {v})" for u, v in ((u0, v0), (u1, v1))]
        lat = [f"(sin(r) * {u} + cos(r) * {v})" for u, v in ((u0, v0), (u1, v1))]
        return haversine(lat[0], lon[0], lat[1], lon[1], 6373)

    sides = ", ".join(side(a, b) for a, b in (("u1 v0", "u0 v0"), ("u0 v0", "u0 v1"), ("u0 v1", "u1 v1")))
    return f"""{name}_pts AS MATERIALIZED (SELECT DISTINCT e.run_id, e.object_id, e.t, g.lon, g.lat FROM (
    SELECT run_id, object_id, t, y, min(x) AS x0, max(x) AS x1 FROM {name} GROUP BY ALL) e
  JOIN grid g ON g.y = e.y AND (g.x = e.x0 OR g.x = e.x1)),
{name}_dirs AS (SELECT run_id, object_id, t, CASE WHEN r > pi() / 2 - 1e-9 THEN 0 ELSE r END AS r FROM (
  SELECT DISTINCT run_id, object_id, t, CASE WHEN r < -1e-9 THEN r + pi() / 2 ELSE r END AS r FROM (
    SELECT a.run_id, a.object_id, a.t, round(CASE WHEN b.lat = a.lat THEN 0 ELSE atan2(b.lat - a.lat, b.lon - a.lon) END, 12) AS r
    FROM {name}_pts a JOIN {name}_pts b ON a.run_id = b.run_id AND a.object_id = b.object_id AND a.t = b.t
      AND (b.lon > a.lon OR (b.lon = a.lon AND b.lat > a.lat))))),
{name}_frames AS (SELECT d.run_id, d.object_id, d.t, d.r, max(lon * cos(r) + lat * sin(r)) AS u1, min(lon * cos(r) + lat * sin(r)) AS u0,
    max(lat * cos(r) - lon * sin(r)) AS v1, min(lat * cos(r) - lon * sin(r)) AS v0
  FROM {name}_dirs d JOIN {name}_pts p ON p.run_id = d.run_id AND p.object_id = d.object_id AND p.t = d.t GROUP BY ALL),
{name}_boxes AS (SELECT run_id, object_id, t, greatest({sides}) AS length_km, least({sides}) AS width_km FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, object_id, t ORDER BY round((u1 - u0) * (v1 - v0), 12), r) AS rn FROM {name}_frames)
  WHERE rn = 1 AND least(u1 - u0, v1 - v0) >= 1e-9 * greatest(u1 - u0, v1 - v0)),
{name}_low AS (SELECT run_id, object_id, min(y) AS y0, min(x) AS x0 FROM {name} GROUP BY ALL),
{name}_at AS (SELECT m.run_id, m.object_id, m.t, g.lat FROM (SELECT run_id, object_id, t, avg(y) AS cy, avg(x) AS cx FROM {name} GROUP BY ALL) m
  JOIN {name}_low l USING (run_id, object_id)
  JOIN grid g ON g.y = round_even(m.cy - l.y0, 0) + l.y0 AND g.x = round_even(m.cx - l.x0, 0) + l.x0),
river AS MATERIALIZED (SELECT c.run_id, c.object_id, c.t, c.y, c.x FROM {name} c JOIN {name}_boxes USING (run_id, object_id, t)
  JOIN {name}_at a USING (run_id, object_id, t)
  WHERE length_km > {min_km} AND abs(a.lat) >= {min_lat} AND length_km >= width_km * {ratio})"""


def storm_outside_rivers(min_lat: float) -> str:
    """Storms of ``verdict`` without the steps in whose box a river lies north of ``min_lat``, and their cells and steps."""
    return f"""wet AS (SELECT DISTINCT b.run_id, b.pr_id, v.t FROM box b JOIN river v ON v.run_id = b.run_id
  AND v.y BETWEEN b.y0 AND b.y1 AND v.x BETWEEN b.x0 AND b.x1 JOIN grid g ON g.y = v.y AND g.x = v.x WHERE g.lat >= {min_lat}),
free AS MATERIALIZED (SELECT * FROM verdict v WHERE (v.run_id, v.pr_id, v.t) NOT IN (SELECT (run_id, pr_id, t) FROM wet)),
dry AS MATERIALIZED (SELECT run_id, pr_id, row_number() OVER (PARTITION BY run_id ORDER BY pr_id) AS storm_id FROM (
  SELECT DISTINCT run_id, pr_id FROM (SELECT run_id, pr_id, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (
    PARTITION BY run_id, pr_id ORDER BY t RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) AS good FROM free) WHERE good = 5)),
dry_ids AS (SELECT d.run_id, i.object_key, d.storm_id AS object_id FROM dry d
  JOIN rain_ids i ON i.run_id = d.run_id AND i.object_id = d.pr_id),
dry_at AS (SELECT i.run_id, i.object_key, f.t FROM free f JOIN rain_ids i ON i.run_id = f.run_id AND i.object_id = f.pr_id),
dry_cells AS MATERIALIZED (SELECT r.* FROM rain r JOIN dry_at USING (run_id, object_key, t)),
dry_cells_steps AS MATERIALIZED (SELECT s.* FROM rain_steps s JOIN dry_at USING (run_id, object_key, t))"""


def breakup(name: str, avg_parts: float, min_steps: int) -> str:
    """``<name>_tracks``: bodies of ``name`` chained over time, short tracks dropped."""
    n = name
    return f"""{components(f"{n}_b", f"SELECT run_id, t, y, x FROM {n}", slice_only=True)},
{n}_p AS MATERIALIZED (SELECT o.run_id, o.object_key AS obj, b.object_key AS part, o.t, o.y, o.x
  FROM {n} o JOIN {n}_b b USING (run_id, t, y, x)),
{n}_z AS MATERIALIZED (SELECT run_id, obj, part, t, count(*) AS cells FROM {n}_p GROUP BY ALL),
{n}_k AS (SELECT run_id, obj FROM {n}_z GROUP BY ALL HAVING count(*) / (max(t) - min(t) + 1) > {avg_parts}),
{n}_o AS MATERIALIZED (SELECT DISTINCT a.run_id, a.part AS a, b.part AS b FROM {n}_p a JOIN {n}_p b
  ON b.run_id = a.run_id AND b.obj = a.obj AND b.t = a.t + 1 AND b.y = a.y AND b.x = a.x
  JOIN {n}_k k ON k.run_id = a.run_id AND k.obj = a.obj),
{n}_q AS (SELECT o.*, za.cells AS ca, zb.cells AS cb,
    row_number() OVER (PARTITION BY o.run_id, b ORDER BY za.cells DESC, a) AS ra,
    row_number() OVER (PARTITION BY o.run_id, a ORDER BY zb.cells DESC, b) AS rb,
    count(*) OVER (PARTITION BY o.run_id, b) AS n
  FROM {n}_o o JOIN {n}_z za ON za.run_id = o.run_id AND za.part = a JOIN {n}_z zb ON zb.run_id = o.run_id AND zb.part = b),
{n}_x AS MATERIALIZED (SELECT run_id, a, b FROM {n}_q WHERE ra = 1 AND (n > 1 OR rb = 1)),
{n}_c(run_id, part, root) AS (
  SELECT z.run_id, z.part, z.part FROM {n}_z z JOIN {n}_k USING (run_id, obj)
    WHERE (z.run_id, z.part) NOT IN (SELECT (run_id, b) FROM {n}_x)
  UNION SELECT x.run_id, x.b, c.root FROM {n}_c c JOIN {n}_x x ON x.run_id = c.run_id AND x.a = c.part),
{n}_t AS MATERIALIZED (SELECT run_id, part, root FROM {n}_c UNION ALL
  SELECT run_id, part, min(part) OVER (PARTITION BY run_id, obj) FROM {n}_z
    WHERE (run_id, obj) NOT IN (SELECT (run_id, obj) FROM {n}_k)),
{n}_i AS (SELECT run_id, root, row_number() OVER (PARTITION BY run_id ORDER BY root) AS object_id FROM (
  SELECT t.run_id, root FROM {n}_t t JOIN {n}_z z ON z.run_id = t.run_id AND z.part = t.part
  GROUP BY t.run_id, root HAVING max(z.t) - min(z.t) + 1 >= {min_steps})),
{n}_tracks AS MATERIALIZED (SELECT p.run_id, p.t, p.y, p.x, i.object_id FROM {n}_p p
  JOIN {n}_t t ON t.run_id = p.run_id AND t.part = p.part JOIN {n}_i i ON i.run_id = t.run_id AND i.root = t.root)"""


def _fold(j: str, n: int) -> str:
    m = f"((({j}) % {2 * n} + {2 * n}) % {2 * n})"
    return f"CASE WHEN {m} < {n} THEN {m} ELSE {2 * n - 1} - {m} END"


def fold_weights(name: str, n: int, size: int) -> str:
    """How often a mirrored boxcar of ``size`` around i sees source cell s."""
    return f"""{name} AS MATERIALIZED (SELECT i, {_fold("i + k", n)} AS s, CAST(count(*) AS DOUBLE) AS w
  FROM range({n}) a(i), range({-(size // 2)}, {size - size // 2}) b(k) GROUP BY 1, 2)"""


def gauss_weights(name: str, n: int, sigma: float) -> str:
    r = int(4 * sigma + 0.5)
    return f"""{name} AS MATERIALIZED (SELECT i, {_fold("i + k", n)} AS s, sum(w) AS w FROM range({n}) a(i),
  (SELECT k, exp(-0.5 * k * k / {sigma * sigma}) / sum(exp(-0.5 * k * k / {sigma * sigma})) OVER () AS w FROM range({-r}, {r + 1}) r(k))
  GROUP BY 1, 2)"""


def smooth(out: str, src: str, axis: str, weights: str, *cols: str) -> str:
    keep = [a for a in ("t", "y", "x") if a != axis]
    sums = ", ".join(f"sum(f.{c} * w.w) AS {c}" for c in cols)
    return f"""{out} AS MATERIALIZED (SELECT f.run_id, {", ".join("f." + k for k in keep)}, CAST(w.i AS INTEGER) AS {axis}, {sums}
  FROM {src} f JOIN {weights} w ON w.s = f.{axis} GROUP BY ALL)"""


def anomaly(per_run_steps: bool = False) -> str:
    """Boxes of 100 km and of 3000 km x 78 h at the mean spacing of the 40 x 40 mesh.

    The two box sizes in cells follow from the mean spacing of about 4.3 km.
    """
    fine, coarse = _boxes()
    return ",\n".join(
        [
            fold_weights("wf", 40, fine), fold_weights("wc", 40, coarse), fold_weights("wt", 48, 78),
            "h0 AS MATERIALIZED (SELECT run_id, t, y, x, slp / 100 AS p FROM dense)",
            smooth("h1", "h0", "x", "wf", "p"), smooth("h2", "h1", "y", "wf", "p"),
            smooth("k1", "h0", "x", "wc", "p"), smooth("k2", "k1", "y", "wc", "p"), smooth("k3", "k2", "t", "wt", "p"),
            f"""anom AS MATERIALIZED (SELECT run_id, t, y, x, h0.p AS slp,
              h2.p / {fine * fine} - k3.p / ({coarse} * {coarse} * 78.0::DOUBLE) AS anomaly
              FROM h0 JOIN h2 USING (run_id, t, y, x) JOIN k3 USING (run_id, t, y, x))""",
        ]
    )


def _boxes() -> tuple[int, int]:
    import math

    step = 40075000 / (360 / 0.04)
    km = sum(step * (1 + math.cos(math.radians(20 + 0.04 * y))) / 2 for y in range(40)) / 40 / 1000
    return int(100 / km), int(3000 / km)
