"""DuckDB statements that compute the catalogue's results in another way.

Objects are found by spreading labels over runs of cells with a recursive query,
windows are replaced by joins, and joins by windows, wherever that is possible.
"""

from __future__ import annotations

import re

from .oracle_parts import (
    CELLS,
    DENSE,
    GAUGE,
    GRID,
    METRICS,
    REGULAR,
    RUN_GRIDS,
    OUTLINES,
    anomaly,
    breakup,
    components,
    fold_weights,
    gauss_weights,
    haversine,
    kept,
    labels_of,
    rivers,
    smooth,
    stats,
    steps,
    storm,
    storm_outside_rivers,
    with_,
)

ORACLE: dict[str, str] = {}

RAIN = components("rain", "SELECT run_id, t, y, x FROM cells WHERE pr >= 5")
CLOUD = components("cloud", "SELECT run_id, t, y, x FROM cells WHERE bt <= 241")
RAIN_STEPS = [CELLS, GRID, METRICS, RAIN, steps("rain", "pr")]
CLOUD_STEPS = [CELLS, GRID, METRICS, CLOUD, steps("cloud", "bt")]
KEPT_RAIN = [*RAIN_STEPS, kept("rain", 500, 3)]
STORMS = [
    *KEPT_RAIN,
    CLOUD,
    steps("cloud", "bt"),
    kept("cloud", 1000, 5),
    storm(),
]
STATS_COLS = """run_id, object_id, t, n_cells, round(size / 1e6, 3) AS km2, round(lowest, 5) AS lowest,
  round(highest, 5) AS highest, round(average, 5) AS average, round(tot, 4) AS tot, round(cy, 5) AS cy,
  round(cx, 5) AS cx, round(lat, 5) AS lat, round(lon, 5) AS lon, round(speed_km, 5) AS speed_km"""

ORACLE["brightness_temperature_olr"] = with_(
    [CELLS],
    "SELECT run_id, t, y, x, round(sqrt(sqrt((80 + pr) / 5.6704e-8::DOUBLE)), 6) AS bt_k FROM cells",
)

_far = "lat, lon, lat + 3.0::DOUBLE, lon + 7.0::DOUBLE"
_h = haversine("lat", "lon", "(lat + 3.0::DOUBLE)", "(lon + 7.0::DOUBLE)", 1)
_dot = """sin(radians(lat)) * sin(radians(lat + 3.0::DOUBLE))
  + cos(radians(lat)) * cos(radians(lat + 3.0::DOUBLE)) * cos(radians(lon + 7.0::DOUBLE) - radians(lon))"""
ORACLE["haversine"] = with_(
    [RUN_GRIDS],
    f"""SELECT run_id, y, x, round({_h} * 6371000, 2) AS hav_m, round({_h} * 6371, 5) AS hav_km,
      round({_h} * 6373, 5) AS arc_km, round(acos(least(1.0::DOUBLE, {_dot})) * 6371000, 2) AS cos_m FROM rg""",
)
ORACLE["grid_columns"] = with_(
    [RUN_GRIDS],
    """SELECT run_id, y, x, round(CASE WHEN lon + 360 >= 180 THEN lon ELSE lon + 360 END, 6) AS lon180,
      CAST((x + 7) % 40 AS BIGINT) AS rolled, (CAST(3 AS BIGINT) * 40 + y) * 40 + x AS cell,
      round(2 * 7.2921159e-5::DOUBLE * sin(radians(lat)) * 1e6, 6) AS coriolis_e6 FROM rg""",
)


def _run_metrics(dist: str) -> str:
    return f"""m1 AS (SELECT *, {dist.format('l')} AS dx0 FROM (SELECT *, lag(lat) OVER w AS llat, lag(lon) OVER w AS llon
      FROM rg WINDOW w AS (PARTITION BY run_id, y ORDER BY x))),
    m2 AS (SELECT *, {dist.format('u')} AS dy0 FROM (SELECT *, lag(lat) OVER w AS ulat, lag(lon) OVER w AS ulon
      FROM m1 WINDOW w AS (PARTITION BY run_id, x ORDER BY y)))"""


_hav = haversine("{0}lat", "{0}lon", "lat", "lon", 6371000)
_cos = """acos(least(1.0::DOUBLE, sin(radians({0}lat)) * sin(radians(lat))
  + cos(radians({0}lat)) * cos(radians(lat)) * cos(radians(lon) - radians({0}lon)))) * 6371000"""
_edges = "coalesce(a.dx0, b.dx0) AS dx, coalesce(a.dy0, c.dy0) AS dy"
_metrics = """FROM m2 a JOIN m2 b ON a.run_id = b.run_id AND a.y = b.y AND b.x = greatest(a.x, 1)
  JOIN m2 c ON a.run_id = c.run_id AND a.x = c.x AND c.y = greatest(a.y, 1)"""
ORACLE["grid_metrics_haversine"] = with_(
    [RUN_GRIDS, _run_metrics(_hav)],
    f"""SELECT a.run_id, a.y, a.x, round(b.dx0, 3) AS dx_m, round(c.dy0, 3) AS dy_m,
      round(b.dx0 * c.dy0, 0) AS area_m2 {_metrics}""",
)
ORACLE["grid_metrics_cosine"] = with_(
    [RUN_GRIDS, _run_metrics(_cos)],
    """SELECT a.run_id, a.y, a.x, round(b.dx0, 1) AS dx_m, round(b.dy0, 1) AS dy_m FROM m2 a
      JOIN m2 b ON a.run_id = b.run_id AND b.x = greatest(a.x, 1) AND b.y = greatest(a.y, 1)""",
)
ORACLE["grid_metrics_regular"] = with_(
    [RUN_GRIDS],
    """SELECT r.run_id, y, x, round(d * cos(radians(lat)), 3) AS dx_m, round(d, 3) AS dy_m,
      round(d * d * cos(radians(lat)), 0) AS area_m2 FROM rg r JOIN (
        SELECT run_id, 40075000 / (360 / abs(max(lat) FILTER (y = 1) - max(lat) FILTER (y = 0))) AS d
        FROM rg GROUP BY run_id) s ON r.run_id = s.run_id""",
)
ORACLE["grid_mean_spacing"] = with_(
    [RUN_GRIDS, _run_metrics(_hav)],
    f"SELECT a.run_id, round((avg(b.dx0) + avg(c.dy0)) / 2, 3) AS spacing_m {_metrics} GROUP BY a.run_id",
)
ORACLE["vapor_transport_field"] = with_(
    [DENSE], "SELECT run_id, t, y, x, round(q * sqrt(u * u + v * v), 6) AS vap FROM dense"
)
ORACLE["ivt_field"] = with_(
    [DENSE], "SELECT run_id, t, y, x, round(sqrt(ivte * ivte + ivtn * ivtn), 6) AS ivt FROM dense"
)
ORACLE["threshold_mask"] = with_(
    [CELLS], "SELECT run_id, t, y, x, pr >= 5 AS rain, bt <= 241 AS cloud FROM cells WHERE pr >= 5 OR bt <= 241"
)
ORACLE["crop_region"] = with_(
    [CELLS, GRID],
    """SELECT run_id, t, y, x FROM cells WHERE
      y <= (SELECT arg_min(y, (abs(lat - 21.2::DOUBLE), y)) FROM grid)
      AND y >= (SELECT arg_min(y, (abs(lat - 20.3::DOUBLE), y)) FROM grid)
      AND x <= (SELECT arg_min(x, (abs(lon + 98.7::DOUBLE), x)) FROM grid)
      AND x >= (SELECT arg_min(x, (abs(lon + 99.6::DOUBLE), x)) FROM grid)""",
)
ORACLE["step_index"] = with_(
    [GAUGE],
    """SELECT run_id, CAST((epoch - lo) // 3600 AS INTEGER) AS t, count(*) AS n FROM (
      SELECT CAST(y % 3 AS BIGINT) AS run_id, epoch, min(epoch) OVER (PARTITION BY y % 3) AS lo FROM gauge) GROUP BY ALL""",
)
ORACLE["time_axis_hours"] = with_(
    [GAUGE],
    """SELECT run_id, CAST(k AS INTEGER) AS t, lo + k * 3600 AS epoch FROM (
      SELECT CAST(y % 3 AS BIGINT) AS run_id, min(epoch) AS lo, max(epoch) AS hi FROM gauge GROUP BY 1) s
      JOIN range(100000) r(k) ON lo + k * 3600 <= hi""",
)
ORACLE["aligned_fields"] = with_(
    [CELLS],
    "SELECT run_id, t, y, x, round(pr, 6) AS pr, round(bt, 6) AS bt FROM cells WHERE pr >= 5 AND bt <= 241",
)
ORACLE["stacked_variables"] = with_(
    [CELLS],
    """SELECT run_id, t, y, x, CASE WHEN pr > 10 THEN round(pr, 6) END AS pr,
      CASE WHEN bt > 10 THEN round(bt, 6) END AS bt FROM cells WHERE pr > 10 OR bt > 10""",
)
ORACLE["reanalysis_scan"] = """
WITH r AS (SELECT epoch_us(ts) // 3600000000 * 3600 AS epoch, event_id % 3 AS kind, 800 + 25 * (user_id % 5) AS level,
  CAST(user_id % 12 AS INTEGER) AS y, CAST(event_id % 7 AS INTEGER) AS x, value, day(ts) AS d, hour(ts) AS h FROM events)
SELECT CASE WHEN kind = 0 THEN 'SLP' ELSE 'T' END AS variable, epoch, y, x, value FROM r
WHERE d IN (3, 4, 9) AND h % 6 = 0 AND (kind = 0 OR (level = 850 AND y <= 9 AND x >= 1))"""
ORACLE["nearest_prices"] = """
WITH axis AS (SELECT DISTINCT CAST(p_retailprice AS DOUBLE) AS v FROM part),
w AS (SELECT DISTINCT CAST(o_totalprice AS DOUBLE) / 100 AS want FROM orders),
below AS (SELECT want, v AS low FROM w ASOF LEFT JOIN axis ON want >= v),
above AS (SELECT want, v AS high FROM w ASOF LEFT JOIN axis ON want <= v)
SELECT want, CASE WHEN high IS NULL OR want - low <= high - want THEN low ELSE high END AS nearest FROM below JOIN above USING (want)"""
ORACLE["label_components_space_time"] = with_([CELLS, RAIN], labels_of("rain"))
ORACLE["slice_components"] = with_(
    [CELLS, components("body", "SELECT run_id, t, y, x FROM cells WHERE bt <= 241", slice_only=True)],
    labels_of("body"),
)
ORACLE["dateline_merge"] = with_(
    [
        CELLS,
        components(
            "roll", "SELECT run_id, t, y, CAST((x + 20) % 40 AS INTEGER) AS x FROM cells WHERE pr >= 5", seam=True
        ),
    ],
    labels_of("roll"),
)
ORACLE["mixed_grid_seams"] = with_(
    [
        CELLS,
        components(
            "roll", "SELECT run_id, t, y, CAST((x + 20) % 40 AS INTEGER) AS x FROM cells WHERE pr >= 5", seam=True
        ).replace("a.node <> b.node", "a.node <> b.node AND a.run_id % 2 = 0"),
    ],
    labels_of("roll"),
)
ORACLE["dense_object_ids"] = with_(
    [CELLS, RAIN],
    """SELECT run_id, object_key, row_number() OVER (PARTITION BY run_id ORDER BY object_key) AS object_id
      FROM (SELECT DISTINCT run_id, object_key FROM rain)""",
)
ORACLE["object_area_steps"] = with_(
    RAIN_STEPS, "SELECT run_id, object_key, t, round(size / 1e6, 3) AS km2 FROM rain_steps"
)
ORACLE["object_bounds_rain"] = with_(
    [CELLS, RAIN],
    """SELECT run_id, object_key, min(t) AS t_min, max(t) AS t_max, min(y) AS y_min, max(y) AS y_max,
      min(x) AS x_min, max(x) AS x_max, count(*) AS n_cells, count(DISTINCT t) AS n_steps FROM rain GROUP BY ALL""",
)
ORACLE["sustained_rain"] = with_(KEPT_RAIN, "SELECT run_id, object_key FROM rain_ids")
ORACLE["lifetime_rain"] = with_(
    [CELLS, RAIN],
    """SELECT run_id, object_key, min(t) AS t_min, max(t) AS t_max FROM rain
      GROUP BY run_id, object_key HAVING max(t) - min(t) + 1 >= 8""",
)
ORACLE["object_speed_rain"] = with_(
    RAIN_STEPS,
    """SELECT run_id, object_key, t, round(CASE WHEN t - lag(t) OVER w = 1 THEN
      sqrt(pow(cy - lag(cy) OVER w, 2) + pow(cx - lag(cx) OVER w, 2)) * 4 END, 6) AS speed_km
      FROM rain_steps WINDOW w AS (PARTITION BY run_id, object_key ORDER BY t)""",
)
ORACLE["precipitation_object_stats"] = with_([*KEPT_RAIN, stats("rain", 3)], f"SELECT {STATS_COLS} FROM rain_stats")
ORACLE["cloud_object_stats"] = with_(
    [*CLOUD_STEPS, kept("cloud", 1000, 5), stats("cloud", 5)], f"SELECT {STATS_COLS} FROM cloud_stats"
)
ORACLE["breakup_clouds"] = with_(
    [CELLS, RAIN, breakup("rain", 1.2, 2)], "SELECT run_id, t, y, x, object_id FROM rain_tracks"
)
ORACLE["overlapping_pairs"] = with_(
    [CELLS, RAIN, CLOUD],
    """SELECT a.run_id, a.object_key AS pr_key, b.object_key AS bt_key, count(*) AS n_shared
      FROM rain a JOIN cloud b USING (run_id, t, y, x) GROUP BY ALL""",
)
ORACLE["partner_cloud_area"] = with_(
    [*RAIN_STEPS, CLOUD, steps("cloud", "bt")],
    """SELECT p.run_id, p.pr_key, c.t, round(sum(c.size) / 1e6, 3) AS km2 FROM (
        SELECT DISTINCT a.run_id, a.object_key AS pr_key, b.object_key AS bt_key
        FROM rain a JOIN cloud b USING (run_id, t, y, x)) p
      JOIN (SELECT run_id, object_key, min(t) t0, max(t) t1 FROM rain GROUP BY ALL) r
        ON p.run_id = r.run_id AND p.pr_key = r.object_key
      JOIN cloud_steps c ON c.run_id = p.run_id AND c.object_key = p.bt_key AND c.t BETWEEN r.t0 AND r.t1
      GROUP BY ALL""",
)
ORACLE["box_minimum"] = with_(
    [CELLS, RAIN],
    """SELECT s.run_id, s.object_key, s.t, round(min(c.bt), 6) AS bt_min FROM (
        SELECT DISTINCT run_id, object_key, t FROM rain) s
      JOIN (SELECT run_id, object_key, min(y) y0, max(y) y1, min(x) x0, max(x) x1 FROM rain GROUP BY ALL) b
        USING (run_id, object_key)
      JOIN cells c ON c.run_id = s.run_id AND c.t = s.t AND c.y BETWEEN y0 AND y1 AND c.x BETWEEN x0 AND x1
        AND c.bt <= 241 GROUP BY ALL""",
)
ORACLE["rain_box_temperature"] = with_(
    [CELLS, components("core", "SELECT run_id, t, y, x FROM cells WHERE pr >= 20")],
    """SELECT s.run_id, s.object_key, s.t, round(avg(c.bt), 6) AS rain_bt FROM (
        SELECT DISTINCT run_id, object_key, t FROM core) s
      JOIN (SELECT run_id, object_key, min(y) y0, max(y) y1, min(x) x0, max(x) x1 FROM core GROUP BY ALL) b
        USING (run_id, object_key)
      JOIN cells c ON c.run_id = s.run_id AND c.t = s.t AND c.y BETWEEN y0 AND y1 AND c.x BETWEEN x0 AND x1
        AND c.pr >= 5 GROUP BY ALL""",
)
ORACLE["classify_storm_steps"] = with_(
    STORMS,
    """SELECT run_id, pr_id, t, round(rain_km2, 3) AS rain_km2, round(cloud_km2, 3) AS cloud_km2,
      round(pr_max, 6) AS pr_max, round(bt_min, 6) AS bt_min, round(lifetime_peak, 6) AS lifetime_peak, ok FROM verdict""",
)
ORACLE["track_storms_objects"] = with_(STORMS, "SELECT run_id, pr_id, storm_id FROM storms")
ORACLE["classify_storms_compat"] = with_(
    [*STORMS[:-1], storm(compat=True)], "SELECT run_id, pr_id, storm_id FROM storms"
)
STORM_STATS = [
    *STORMS,
    """storm_ids AS (SELECT r.run_id, r.object_key, s.storm_id AS object_id FROM storms s
      JOIN rain_ids r ON r.run_id = s.run_id AND r.object_id = s.pr_id)""",
    stats("rain", 5, ids="storm_ids", out="storm_stats"),
]
ORACLE["storm_statistics"] = with_(STORM_STATS, f"SELECT {STATS_COLS} FROM storm_stats")
# transport objects, and the moisture streams of runs which have none, as tracks
MOVING = [
    components("ivt", "SELECT run_id, t, y, x FROM dense WHERE sqrt(ivte * ivte + ivtn * ivtn) > 660"),
    "ivt_ids AS (SELECT run_id, object_key FROM ivt GROUP BY ALL HAVING max(t) - min(t) + 1 >= 3)",
    "ivt_kept AS MATERIALIZED (SELECT m.* FROM ivt m JOIN ivt_ids USING (run_id, object_key))",
    breakup("ivt_kept", 1.5, 3),
    components("ms", "SELECT run_id, t, y, x FROM dense WHERE q * sqrt(u * u + v * v) > 112"),
    """ms_steps AS MATERIALIZED (SELECT run_id, object_key, t, sum(area) AS size FROM ms JOIN metrics USING (y, x) GROUP BY ALL)""",
    kept("ms", 200, 2),
    "ms_kept AS MATERIALIZED (SELECT m.* FROM ms m JOIN ms_ids USING (run_id, object_key))",
    breakup("ms_kept", 1.5, 2),
    """moving AS MATERIALIZED (SELECT * FROM ivt_kept_tracks UNION ALL
      SELECT * FROM ms_kept_tracks WHERE run_id NOT IN (SELECT run_id FROM ivt_kept_tracks))""",
]
ORACLE["identify_all_storm_statistics"] = with_(
    [
        DENSE, *STORMS[1:], *MOVING, rivers("moving", 20, 20, 1.3), storm_outside_rivers(20),
        stats("dry_cells", 1, ids="dry_ids", out="dry_stats"),
    ],
    f"SELECT {STATS_COLS} FROM dry_stats",
)
ORACLE["storm_statistics_smoothed"] = with_(
    [
        CELLS.replace("cells AS MATERIALIZED", "all_cells AS MATERIALIZED"),
        """sparse AS (SELECT run_id, t, y, x, pr, CASE WHEN (x + y) % 13 > 0 THEN bt END AS bt FROM all_cells WHERE pr >= 1.5),
d0 AS MATERIALIZED (SELECT r.run_id, r.t, CAST(ya.k AS INTEGER) AS y, CAST(xa.k AS INTEGER) AS x, coalesce(pr, 0.0::DOUBLE) AS pr, bt,
  coalesce(bt, 0.0::DOUBLE) AS b, CASE WHEN bt IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS n
  FROM (SELECT DISTINCT run_id, t FROM sparse) r CROSS JOIN range(40) ya(k) CROSS JOIN range(40) xa(k)
  LEFT JOIN sparse s ON s.run_id = r.run_id AND s.t = r.t AND s.y = ya.k AND s.x = xa.k)""",
        gauss_weights("wg", 40, 1.0),
        smooth("d1", "d0", "x", "wg", "pr", "b", "n"),
        smooth("d2", "d1", "y", "wg", "pr", "b", "n"),
        """cells AS MATERIALIZED (SELECT run_id, t, y, x, d0.pr, d0.bt, d2.pr AS prs, CASE WHEN bt IS NOT NULL THEN d2.b / d2.n END AS bts
  FROM d0 JOIN d2 USING (run_id, t, y, x))""",
        GRID, METRICS,
        components("rain", "SELECT run_id, t, y, x FROM cells WHERE prs >= 4"), steps("rain", "pr"), kept("rain", 500, 3),
        components("cloud", "SELECT run_id, t, y, x FROM cells WHERE bts <= 241"), steps("cloud", "bt"), kept("cloud", 1000, 5),
        *STORM_STATS[len(STORMS) - 1 :],
    ],
    f"SELECT {STATS_COLS} FROM storm_stats",
)
ORACLE["storm_summaries"] = with_(
    STORM_STATS,
    """SELECT run_id, object_id, round(max(size) / 1e6, 3) AS km2, round(sum(tot), 3) AS volume,
      round(max(highest), 6) AS peak, min(t) AS t_min, max(t) AS t_max FROM storm_stats GROUP BY ALL""",
)
ORACLE["storm_time_series"] = with_(
    STORM_STATS,
    """SELECT run_id, object_id, t, round(size / 1e6, 3) AS size_km2, round(speed_km, 5) AS speed_km,
      round(highest, 5) AS peak, round(lat, 5) AS lat, round(lon, 5) AS lon FROM storm_stats""",
)
ORACLE["storm_rain_accumulation"] = with_(
    STORM_STATS,
    """SELECT run_id, y, x, round(sum(pr), 4) AS storm_pr FROM rain
      JOIN storm_ids USING (run_id, object_key) JOIN cells USING (run_id, t, y, x) GROUP BY run_id, y, x""",
)
ORACLE["legacy_names"] = with_(
    [*KEPT_RAIN, stats("rain", 3)],
    """SELECT run_id, object_id, t AS TimeAct, round(highest, 5) AS rgrPR_Max, round(tot, 4) AS rgrPR_Vol,
      round(lon, 5) AS track_lon FROM rain_stats""",
)
ORACLE["uniform_smooth_fields"] = with_(
    [
        DENSE,
        fold_weights("w5", 48, 5), fold_weights("w4", 40, 4), fold_weights("w3", 40, 3),
        fold_weights("w6", 40, 6), fold_weights("w7", 40, 7),
        """f0 AS MATERIALIZED (SELECT run_id, t, y, x, u AS a,
          CASE WHEN (x + t) % 11 > 0 THEN tk ELSE 0 END AS s,
          CASE WHEN (x + t) % 11 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS n FROM dense)""",
        smooth("f1", "f0", "x", "w3", "a"), smooth("f2", "f1", "y", "w4", "a"), smooth("f3", "f2", "t", "w5", "a"),
        smooth("g1", "f0", "x", "w7", "s", "n"), smooth("g2", "g1", "y", "w6", "s", "n"),
    ],
    """SELECT run_id, t, y, x, round(f3.a / 60, 5) AS u_box, round(g2.s / nullif(g2.n, 0), 5) AS gap_box
      FROM f3 JOIN g2 USING (run_id, t, y, x)""",
)
ORACLE["gaussian_smooth_field"] = with_(
    [DENSE, gauss_weights("wg", 40, 1.0), smooth("f1", "dense", "x", "wg", "pr"), smooth("f2", "f1", "y", "wg", "pr")],
    "SELECT run_id, t, y, x, round(pr, 5) AS pr_smooth FROM f2",
)


def _slope(col: str, axis: str, n: int) -> str:
    lo, hi = f"greatest({axis} - 1, 0)", f"least({axis} + 1, {n - 1})"
    field = {
        "u": "10 + 0.25::DOUBLE * ((y * 3 + t) % 7)",
        "tk": "290 + 0.5::DOUBLE * ((x + 2 * y + t) % 5)",
    }[col]
    high, low = (re.sub(rf"\b{axis}\b", f"({e})", field) for e in (hi, lo))
    return f"(({high}) - ({low})) / ({hi} - {lo})"


ORACLE["gradient_fields"] = with_(
    [DENSE],
    f"""SELECT run_id, t, y, x, {_slope('u', 'y', 40)} AS du_dy, {_slope('tk', 'x', 40)} AS dtk_dx,
      {_slope('tk', 't', 48)} AS dtk_dt FROM dense""",
)
ORACLE["local_minima_bt"] = with_(
    [DENSE],
    """SELECT a.run_id, a.t, a.y, a.x FROM dense a CROSS JOIN range(-1, 2) p(dy) CROSS JOIN range(-1, 2) q(dx)
      JOIN dense b ON b.run_id = a.run_id AND b.t = a.t AND b.y = a.y + dy AND b.x = a.x + dx
      GROUP BY a.run_id, a.t, a.y, a.x, a.bt HAVING (min(b.bt) = a.bt) <> (max(abs(b.bt)) = 0)""",
)
ORACLE["frontal_diagnostic_field"] = with_(
    [DENSE, GRID, REGULAR],
    f"""SELECT run_id, t, y, x, round(abs((dv / dx - du / dy) * tg) / abs(2 * 7.2921159e-5::DOUBLE * sin(radians(lat)) * 0.45::DOUBLE), 4) AS front,
      round(tg, 6) AS t_gradient FROM (
        SELECT d.run_id, d.t, d.y, d.x, g.lat, g.dx, g.dy,
          (least(x + 1, 39) - greatest(x - 1, 0)) AS w,
          ((0.25::DOUBLE * ((least(x + 1, 39) * 5 + t) % 9)) - (0.25::DOUBLE * ((greatest(x - 1, 0) * 5 + t) % 9)))
            / (least(x + 1, 39) - greatest(x - 1, 0)) AS dv,
          {_slope('u', 'y', 40)} AS du,
          sqrt(pow({_slope('tk', 'x', 40)}, 2) + pow({_slope('tk', 'y', 40)}, 2)) AS tg
        FROM dense d JOIN gr g USING (y, x))""",
)
ORACLE["pressure_anomaly_field"] = with_(
    [DENSE, GRID, REGULAR, anomaly(per_run_steps=True)],
    "SELECT run_id, t, y, x, round(anomaly, 3) AS anomaly FROM anom",
)
ORACLE["hourly_rain_gauges"] = with_(
    [GAUGE],
    """SELECT epoch // 10800 * 10800 AS epoch, y, x, round(sum(pr), 4) AS pr FROM (
      SELECT epoch // 3600 * 3600 AS epoch, y, x, avg(pr) AS pr FROM (
        SELECT epoch, y, x, avg(value) AS pr FROM gauge GROUP BY ALL) GROUP BY 1, 2, 3) GROUP BY 1, 2, 3""",
)
ORACLE["rain_sums_from_first_step"] = with_(
    [
        GAUGE,
        """hourly AS (SELECT epoch // 3600 * 3600 AS h, y, x, avg(pr) AS pr FROM (
          SELECT epoch, y, x, avg(value) AS pr FROM gauge GROUP BY ALL) GROUP BY 1, 2, 3)""",
        "ends AS (SELECT min(h) AS lo, max(h) AS hi FROM hourly)",
    ],
    """SELECT lo + (h - lo) // 18000 * 18000 AS epoch, y, x, round(sum(pr), 4) AS pr FROM hourly, ends
      WHERE lo + ((h - lo) // 18000 + 1) * 18000 <= hi + 3600 GROUP BY 1, 2, 3""",
)
ORACLE["chunked_cells"] = with_([CELLS], "SELECT run_id, t, y, x, round(pr, 6) AS pr FROM cells")
ORACLE["median_brightness"] = with_(
    [GAUGE],
    """SELECT epoch // 3600 * 3600 AS epoch, y, x,
      round(median(CASE WHEN value - 2 >= 0 THEN value - 2 END), 4) AS bt FROM gauge GROUP BY 1, 2, 3""",
)
ORACLE["regrid_midpoints"] = with_(
    [
        DENSE,
        """row_pairs AS (SELECT run_id, t, y, x, tk, lead(tk) OVER (PARTITION BY run_id, t, y ORDER BY x) AS e FROM dense),
squares AS (SELECT run_id, t, y, x, tk, e, lead(tk) OVER w AS n, lead(e) OVER w AS ne FROM row_pairs
  WINDOW w AS (PARTITION BY run_id, t, x ORDER BY y))""",
    ],
    """SELECT run_id, t, CAST(y * 40 + x AS BIGINT) AS target_id,
      round(CASE WHEN y % 2 = 1 THEN tk * 0.25 + e * 0.5 + n * 0.25 ELSE ne * 0.25 + e * 0.25 + n * 0.5 END, 5) AS value
      FROM squares WHERE y < 39 AND x < 39""",
)
CENTRES = """centres AS (SELECT s_suppkey AS point_id, -100 + 0.04::DOUBLE * (4 + (s_suppkey * 104729) % 32) + 0.003::DOUBLE AS lon,
  20 + 0.04::DOUBLE * (4 + (s_suppkey * 15485863) % 32) + 0.003::DOUBLE AS lat FROM supplier)"""
# the square with a hole, and the triangle by the sign of its three edges
INSIDE = """inside AS (
  SELECT point_id, CAST(1 AS BIGINT) AS poly_id FROM centres WHERE lon BETWEEN -99.9 AND -99.1 AND lat BETWEEN 20.1 AND 20.9
    AND NOT (lon BETWEEN -99.7 AND -99.3 AND lat BETWEEN 20.3 AND 20.7)
  UNION ALL SELECT point_id, CAST(2 AS BIGINT) FROM centres WHERE
    (-98.45 + 99.0) * (lat - 20.2) - (20.8 - 20.2) * (lon + 99.0) > 0
    AND (-98.9 + 98.45) * (lat - 20.8) - (21.5 - 20.8) * (lon + 98.45) > 0
    AND (-99.0 + 98.9) * (lat - 21.5) - (20.2 - 21.5) * (lon + 98.9) > 0)"""
ORACLE["polygon_points"] = with_([CENTRES, INSIDE], "SELECT point_id, poly_id FROM inside")
ORACLE["land_flags"] = with_(
    [CENTRES, INSIDE],
    "SELECT point_id, point_id IN (SELECT point_id FROM inside) AS land FROM centres",
)
ORACLE["object_extent_boxes"] = with_(
    [
        CELLS, GRID, RAIN,
        """ends AS (SELECT run_id, object_key, t, y, min(x) AS x0, max(x) AS x1 FROM rain GROUP BY ALL)""",
        """pts AS MATERIALIZED (SELECT DISTINCT e.run_id, e.object_key, e.t, g.lon, g.lat FROM ends e
          JOIN grid g ON g.y = e.y AND (g.x = e.x0 OR g.x = e.x1))""",
        """dirs AS (SELECT DISTINCT a.run_id, a.object_key, a.t,
            round(CASE WHEN b.lat = a.lat THEN 0 ELSE atan2(b.lat - a.lat, b.lon - a.lon) END, 12) AS r
          FROM pts a JOIN pts b ON a.run_id = b.run_id AND a.object_key = b.object_key AND a.t = b.t
            AND (b.lon > a.lon OR (b.lon = a.lon AND b.lat > a.lat)))""",
        """boxes AS (SELECT d.run_id, d.object_key, d.t, d.r,
            (max(lon * cos(r) + lat * sin(r)) - min(lon * cos(r) + lat * sin(r)))
            * (max(lat * cos(r) - lon * sin(r)) - min(lat * cos(r) - lon * sin(r))) AS box
          FROM dirs d JOIN pts p ON p.run_id = d.run_id AND p.object_key = d.object_key AND p.t = d.t GROUP BY ALL)""",
    ],
    """SELECT s.run_id, s.object_key, s.t, round(CASE WHEN min(box) > 1e-12 THEN min(box) END, 7) AS box_deg2
      FROM (SELECT DISTINCT run_id, object_key, t FROM rain) s LEFT JOIN boxes b USING (run_id, object_key, t) GROUP BY ALL""",
)
LOW_STEPS = """lows AS MATERIALIZED (SELECT run_id, object_key, t, y, x, (101300 - 40 * pr) / 100 AS slp,
  290 + 0.5::DOUBLE * ((x + 2 * y + t) % 5) AS tk FROM rain JOIN cells USING (run_id, t, y, x)),
centre AS MATERIALIZED (SELECT run_id, object_key, t, y, x, slp AS low FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, object_key, t ORDER BY slp, y, x) AS rn FROM lows) WHERE rn = 1),
cores AS MATERIALIZED (SELECT c.run_id, c.object_key, c.t, c.y, c.x, c.low, n.near, m.mean, n.near - m.mean AS excess
  FROM centre c
  JOIN (SELECT run_id, object_key, t, avg(290 + 0.5::DOUBLE * ((x + dx + 2 * (y + dy) + t) % 5)) AS near
    FROM centre, range(-1, 2) p(dy), range(-1, 2) q(dx)
    WHERE y + dy BETWEEN 0 AND 39 AND x + dx BETWEEN 0 AND 39 GROUP BY ALL) n USING (run_id, object_key, t)
  JOIN (SELECT run_id, object_key, t, avg(tk) AS mean FROM lows GROUP BY ALL) m USING (run_id, object_key, t)),
series AS (SELECT *, t - min(t) OVER w AS i, max(t) OVER w - min(t) OVER w + 1 AS n FROM cores
  WINDOW w AS (PARTITION BY run_id, object_key)),
taps AS (SELECT k, exp(-0.5 * k * k) / sum(exp(-0.5 * k * k)) OVER () AS w FROM range(-4, 5) r(k)),
warm AS MATERIALIZED (SELECT a.run_id, a.object_key, a.t, a.y, a.x, a.low, a.near, a.mean, a.n, sum(k.w * b.excess) AS smooth
  FROM series a CROSS JOIN taps k JOIN series b ON b.run_id = a.run_id AND b.object_key = a.object_key
    AND b.i = CASE WHEN ((a.i + k.k) % (2 * a.n) + 2 * a.n) % (2 * a.n) < a.n
      THEN ((a.i + k.k) % (2 * a.n) + 2 * a.n) % (2 * a.n)
      ELSE 2 * a.n - 1 - ((a.i + k.k) % (2 * a.n) + 2 * a.n) % (2 * a.n) END
  GROUP BY ALL)"""
ORACLE["low_centres"] = with_(
    [CELLS, RAIN, LOW_STEPS], "SELECT run_id, object_key, t, y, x, round(low, 5) AS low FROM centre"
)
ORACLE["warm_core_excess"] = with_(
    [CELLS, RAIN, LOW_STEPS],
    """SELECT run_id, object_key, t, round(near, 5) AS tk_near, round(mean, 5) AS tk_mean,
      round(smooth, 5) AS excess_smooth FROM warm""",
)
ORACLE["track_pieces"] = with_(
    RAIN_STEPS,
    """SELECT run_id, object_key, t, CAST(dense_rank() OVER (PARTITION BY run_id, object_key ORDER BY g) AS BIGINT) AS island
      FROM (SELECT *, t - row_number() OVER (PARTITION BY run_id, object_key ORDER BY t) AS g
            FROM rain_steps WHERE highest >= 20)""",
)
ORACLE["tropical_cyclone_tracks"] = with_(
    [
        CELLS, GRID, RAIN, LOW_STEPS,
        """gate AS (SELECT run_id, object_key FROM warm JOIN grid USING (y, x) GROUP BY ALL HAVING max(n) >= 5
          AND min(abs(lat)) <= 35 AND count(*) FILTER (smooth > 0) >= 2 AND count(*) FILTER (low < 1008) >= 3)""",
        """valid AS (SELECT w.*, g.lat, g.lon FROM warm w JOIN grid g USING (y, x) JOIN gate USING (run_id, object_key)
          WHERE near > 285 AND smooth > 0 AND low < 1008 AND abs(lat) <= 60)""",
        """named AS (SELECT run_id, object_key, row_number() OVER (PARTITION BY run_id ORDER BY object_key) AS tc_id
          FROM (SELECT DISTINCT run_id, object_key FROM valid))""",
        """pieces AS (SELECT *, dense_rank() OVER (PARTITION BY run_id, object_key ORDER BY g) AS island FROM (
          SELECT *, t - row_number() OVER (PARTITION BY run_id, object_key ORDER BY t) AS g FROM valid))""",
        """starts AS (SELECT run_id, object_key, island, arg_min(lon, t) AS lon, arg_min(lat, t) AS lat FROM pieces GROUP BY ALL)""",
        OUTLINES,
        """born AS (SELECT DISTINCT run_id, object_key, island FROM (
          SELECT run_id, object_key, island, poly_id, count(*) AS c FROM starts s JOIN outline e
            ON (e.y1 > s.lat) <> (e.y2 > s.lat) AND s.lon < e.x1 + (s.lat - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)
          GROUP BY ALL) WHERE c % 2 = 1)""",
    ],
    """SELECT run_id, tc_id, t, round(lat, 5) AS lat, round(lon, 5) AS lon, CAST(island AS BIGINT) AS island FROM pieces p
      JOIN named USING (run_id, object_key)
      WHERE (run_id, object_key, island) NOT IN (SELECT (run_id, object_key, island) FROM born)""",
)


def _kind(name: str, mask: str, before: list[str], value: str, min_steps: int, area_km2: float | None) -> str:
    if area_km2 is None:
        keep = f"""{name}_ids AS (SELECT run_id, object_key FROM {name} GROUP BY ALL
          HAVING max(t) - min(t) + 1 >= {min_steps})"""
    else:
        keep = kept(name, area_km2, min_steps)
    parts = [
        *before,
        components(name, f"SELECT run_id, t, y, x FROM ({mask})"),
        f"""{name}_steps AS MATERIALIZED (SELECT run_id, object_key, t, sum(dxdy) AS size FROM {name} JOIN area USING (y, x) GROUP BY ALL)""",
        keep,
        f"{name}_kept AS MATERIALIZED (SELECT m.* FROM {name} m JOIN {name}_ids USING (run_id, object_key))",
        breakup(f"{name}_kept", 1.5, min_steps),
    ]
    return with_(
        parts,
        f"""SELECT run_id, object_id, t, count(*) AS n_cells, round(max(v), 4) AS highest, round(avg(v), 4) AS average,
          round(avg(y), 5) AS cy, round(avg(x), 5) AS cx FROM {name}_kept_tracks
          JOIN (SELECT run_id, t, y, x, {value} AS v FROM {'anom' if 'anom' in mask else 'dense'}) USING (run_id, t, y, x)
          GROUP BY run_id, object_id, t""",
    )


_area = [DENSE, GRID, METRICS, "area AS (SELECT y, x, area AS dxdy FROM metrics)"]
_area_regular = [DENSE, GRID, REGULAR, "area AS (SELECT y, x, dx * dy AS dxdy FROM gr)", anomaly()]
ORACLE["moisture_stream_objects"] = _kind(
    "ms", "SELECT * FROM dense WHERE q * sqrt(u * u + v * v) > 112", _area, "q * sqrt(u * u + v * v)", 2, 200
)
ORACLE["ivt_transport_objects"] = _kind(
    "ivt", "SELECT * FROM dense WHERE sqrt(ivte * ivte + ivtn * ivtn) > 660", _area,
    "sqrt(ivte * ivte + ivtn * ivtn)", 3, None,
)
ORACLE["cyclone_objects"] = _kind("low", "SELECT * FROM anom WHERE anomaly < -4", _area_regular, "slp", 5, None)
ORACLE["anticyclone_objects"] = _kind("high", "SELECT * FROM anom WHERE anomaly > 1", _area_regular, "slp", 5, None)
ORACLE["front_zones"] = with_(
    [
        DENSE, GRID, REGULAR,
        f"""diag AS MATERIALIZED (SELECT run_id, t, y, x, abs((dv / dx - du / dy) * tg)
            / abs(2 * 7.2921159e-5::DOUBLE * sin(radians(lat)) * 0.45::DOUBLE) AS front FROM (
          SELECT d.run_id, d.t, d.y, d.x, g.lat, g.dx, g.dy,
            ((0.25::DOUBLE * ((least(x + 1, 39) * 5 + t) % 9)) - (0.25::DOUBLE * ((greatest(x - 1, 0) * 5 + t) % 9)))
              / (least(x + 1, 39) - greatest(x - 1, 0)) AS dv,
            {_slope('u', 'y', 40)} AS du,
            sqrt(pow({_slope('tk', 'x', 40)}, 2) + pow({_slope('tk', 'y', 40)}, 2)) AS tg
          FROM dense d JOIN gr g USING (y, x)))""",
        components("fr", "SELECT run_id, t, y, x FROM diag WHERE front > 3", slice_only=True),
        """big AS (SELECT run_id, t, object_key FROM fr JOIN gr USING (y, x) GROUP BY ALL HAVING sum(dx * dy) >= 60e6)""",
    ],
    "SELECT run_id, t, y, x, object_key AS front_key FROM fr JOIN big USING (run_id, t, object_key)",
)
