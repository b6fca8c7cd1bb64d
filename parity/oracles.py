"""The SQL each query is checked against, for DuckDB over the same tables."""

from __future__ import annotations


def _with(*ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(c.strip() for c in ctes) + "\n"


def _q(expression: str) -> str:
    """Six places. The boundary is off the middle: values half-way between two steps are common, and
    the order of a sum would decide them."""
    return f"floor(({expression}) * 1e6 + 0.4837) / 1e6 + 0.0"


def _r(expression: str, name: str) -> str:
    return f"{_q(expression)} AS {name}"


# ------------------------------------------------------------------------------------------------
# Weather
# ------------------------------------------------------------------------------------------------
TIES = "l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity"

RAW = """
raw AS (
  SELECT *, t + 100.0 * l_discount AS tx, t - 100.0 * l_tax AS tn
  FROM (
    SELECT *, lpad(CAST(l_suppkey % 20 AS VARCHAR), 5, '0') AS county_id,
      CAST(year(l_shipdate) AS INTEGER) AS yr, CAST(month(l_shipdate) AS INTEGER) AS mon,
      (l_suppkey % 20) % 5 = 0 AND l_linestatus <> 'F' AS is_daily,
      l_quantity - 10.0 + CASE WHEN (l_suppkey % 20) % 3 = 1 THEN 273.15 ELSE 0.0 END AS t,
      CASE WHEN l_returnflag = 'R' THEN l_extendedprice / 1000.0 ELSE 0.0 END AS rain,
      CASE WHEN l_linenumber <> 7 THEN 40.0 + 7.0 * l_linenumber END AS hum,
      CASE WHEN l_linenumber <> 6 THEN 100.0 + l_quantity END AS solar,
      CAST(1.0 + l_linenumber AS DOUBLE) AS wind
    FROM lineitem))
"""
KEPT = """
kept AS (
  SELECT * FROM (SELECT *, bool_or(is_daily) OVER (PARTITION BY county_id, yr) AS any_daily FROM raw)
  WHERE is_daily OR NOT any_daily)
"""
DAYS = """
days AS (
  SELECT *, t - o AS c, tx - o AS cx, tn - o AS cn,
    greatest(0.0, 0.6108 * exp(17.27 * (t - o) / ((t - o) + 237.3))
      - 0.6108 * exp(17.27 * (t - o) / ((t - o) + 237.3)) * (hum / 100.0)) AS vpd0
  FROM (
    SELECT *, CASE WHEN max(greatest(t, tx, tn)) OVER (PARTITION BY county_id, yr) > 100
      THEN 273.15 ELSE 0.0 END AS o
    FROM kept))
"""
# greatest() skips NULL here, so the deficit of rows without humidity is set to NULL again.
VPD = "CASE WHEN hum IS NULL THEN NULL ELSE vpd0 END"
STREAKS = """
streaks AS (
  SELECT county_id, yr, mon, max(n) AS streak FROM (
    SELECT county_id, yr, mon, isl, count(*) FILTER (WHERE rain < 1.0) AS n FROM (
      SELECT *, sum(CASE WHEN rain < 1.0 THEN 0 ELSE 1 END) OVER (
        PARTITION BY county_id, yr, mon
        ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity
        ROWS UNBOUNDED PRECEDING) AS isl
      FROM {source})
    GROUP BY county_id, yr, mon, isl)
  GROUP BY county_id, yr, mon)
"""
MONTHLY = f"""
monthly AS (
  SELECT *, greatest(0.0, pe - p) / (pe + p + 1e-6) AS drought FROM (
    SELECT m.*, s.streak, greatest(0.0, vpd) * dim * 10.0 AS pe
    FROM (
      SELECT county_id, yr, mon, avg(c) AS tm, max(cx) AS hi, min(cn) AS lo,
        sum(greatest(0.0, c - 10.0)) AS gdd, count(*) FILTER (WHERE cx >= 35.0) AS heat,
        sum(greatest(0.0, 0.0 - cn)) AS cold, sum(rain) AS p,
        count(*) FILTER (WHERE rain >= 1.0) AS rainy, count(*) FILTER (WHERE rain < 1.0) AS dry,
        avg(hum) AS hum, coalesce(avg({VPD}), 0.0) AS vpd, avg(wind) AS wind, max(wind) AS gust,
        avg(solar) AS solar, coalesce(sum(solar), 0.0) AS sun,
        stddev_pop(c) + stddev_pop(rain) + stddev_pop(solar) AS vol,
        sum(greatest(0.0, c - 35.0)) AS hs,
        CAST(day(last_day(make_date(yr, mon, 1))) AS INTEGER) AS dim
      FROM days GROUP BY county_id, yr, mon) m
    JOIN streaks s ON m.county_id = s.county_id AND m.yr = s.yr AND m.mon = s.mon))
"""
WEATHER = (RAW, KEPT, DAYS, STREAKS.replace("{source}", "days"), MONTHLY)

_MEASURES = [
    ("weather_temp_mean", "tm"), ("weather_temp_max", "hi"), ("weather_temp_min", "lo"),
    ("weather_temp_range", "hi - lo"), ("weather_gdd", "gdd"),
    ("weather_cold_stress_degree_days", "cold"), ("weather_total_precipitation", "p"),
    ("weather_humidity_mean", "hum"), ("weather_vpd", "vpd"), ("weather_wind_speed_mean", "wind"),
    ("weather_wind_speed_max", "gust"), ("weather_solar_radiation_mean", "solar"),
    ("weather_cumulative_solar_radiation", "sun"),
    ("weather_precipitation_intensity", "p / greatest(rainy, 1)"),
    ("weather_weather_volatility_score", "vol"), ("weather_heat_stress_degree_days", "hs"),
    ("weather_drought_index", "drought"),
]
_COUNTS = [
    ("weather_extreme_heat_days", "heat"), ("weather_rainy_days", "rainy"),
    ("weather_dry_days", "dry"), ("weather_max_dry_streak", "CAST(streak AS BIGINT)"),
    ("weather_days_in_month", "dim"),
]
_BASE = """
based AS (
  SELECT *, tm - avg(tm) OVER w AS ta, p - avg(p) OVER w AS ra FROM monthly
  WINDOW w AS (PARTITION BY county_id, mon))
"""
_KEYS = "county_id, yr AS year, mon AS month"


def _season_weather(keys: str, order: str) -> str:
    return (
        _with(
            *WEATHER,
            f"""
            steps AS (
              SELECT *, (mon - lag(mon) OVER w) * (p + lag(p) OVER w) / 2 AS area FROM monthly
              WINDOW w AS (PARTITION BY {keys} ORDER BY {order}))""",
        )
        + "SELECT "
        + ", ".join("yr AS year" if k == "yr" else k for k in keys.split(", "))
        + ", "
        + ", ".join(
            [
                _r("CASE WHEN count(*) = 1 THEN 0.0 ELSE regr_slope(tm, mon) END", "weather_temperature_trend_slope"),
                _r("CASE WHEN count(*) = 1 THEN 0.0 ELSE regr_slope(p, mon) END", "weather_rainfall_trend_slope"),
                _r("CASE WHEN count(*) = 1 THEN 0.0 ELSE regr_slope(vpd, mon) END", "weather_vpd_trend_slope"),
                _r("CASE WHEN count(*) = 1 THEN max(p) ELSE sum(area) END", "weather_total_precipitation_auc"),
                f"first(mon ORDER BY p DESC, {order}) AS weather_peak_rainfall_month",
                _r("stddev_samp(p) / (avg(p) + 1e-6)", "weather_rainfall_seasonality_index"),
                _r("sum(hs)", "weather_heat_stress_total"),
                _r("max(drought)", "weather_drought_severity_max"),
            ]
        )
        + f" FROM steps GROUP BY {keys}"
    )


ORACLES: dict[str, str] = {}

ORACLES["weather_monthly"] = (
    _with(*WEATHER)
    + f"SELECT {_KEYS}, 'corn' AS crop_type, "
    + ", ".join([_r(e, n) for n, e in _MEASURES] + [f"{e} AS {n}" for n, e in _COUNTS])
    + " FROM monthly"
)
ORACLES["dry_streak"] = (
    _with(RAW, STREAKS.replace("{source}", "raw"))
    + f"SELECT {_KEYS}, CAST(streak AS BIGINT) AS longest_streak FROM streaks"
)
_BY_RAIN = STREAKS.replace(
    "ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity",
    "ORDER BY l_shipdate, rain NULLS LAST",
)
ORACLES["weather_monthly_untied"] = ORACLES["weather_monthly"].replace(
    "ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity",
    "ORDER BY l_shipdate, rain NULLS LAST",
)
ORACLES["dry_streak_dated"] = (
    _with(RAW, _BY_RAIN.replace("{source}", "raw"))
    + f"SELECT {_KEYS}, CAST(streak AS BIGINT) AS longest_streak FROM streaks"
)
ORACLES["weather_limits"] = (
    _with(RAW, KEPT, DAYS, _BY_RAIN.replace("{source}", "days").replace("rain < 1.0", "rain < 12.0"))
    + f"""SELECT county_id, yr AS year, mon AS month, {_r('sum(greatest(0.0, c - 4.5))', 'weather_gdd')},
      count(*) FILTER (WHERE cx >= 22.0) AS weather_extreme_heat_days,
      {_r('sum(greatest(0.0, 3.0 - cn))', 'weather_cold_stress_degree_days')},
      {_r('sum(greatest(0.0, c - 22.0))', 'weather_heat_stress_degree_days')},
      count(*) FILTER (WHERE rain >= 25.0) AS weather_rainy_days, count(*) FILTER (WHERE rain < 12.0) AS weather_dry_days,
      CAST(max(streak) AS BIGINT) AS weather_max_dry_streak
    FROM days JOIN streaks USING (county_id, yr, mon) GROUP BY county_id, yr, mon"""
)
ORACLES["weather_own_climatology"] = (
    _with(*WEATHER, "given AS (SELECT mon AS m, avg(tm) AS bt, avg(p) AS br FROM monthly WHERE yr < 1997 GROUP BY mon)")
    + f"SELECT {_KEYS}, {_r('tm - bt', 'weather_temperature_anomaly')}, {_r('p - br', 'weather_rainfall_anomaly')}"
    + " FROM monthly LEFT JOIN given ON mon = m"
)
ORACLES["weather_anomaly"] = (
    _with(*WEATHER, _BASE)
    + f"SELECT {_KEYS}, {_r('ta', 'weather_temperature_anomaly')}, {_r('ra', 'weather_rainfall_anomaly')} FROM based"
)
ORACLES["weather_given_climatology"] = (
    _with(
        *WEATHER,
        """
        given AS (
          SELECT month(o_orderdate) AS m, o_orderpriority, avg(o_totalprice) / 10000.0 AS bt,
            max(o_totalprice) / 1000.0 AS br
          FROM orders GROUP BY month(o_orderdate), o_orderpriority)""",
    )
    + f"SELECT {_KEYS}, {_r('tm - bt', 'weather_temperature_anomaly')}, {_r('p - br', 'weather_rainfall_anomaly')}"
    + " FROM monthly LEFT JOIN given ON mon = m"
)
ORACLES["weather_climatology"] = (
    _with(*WEATHER)
    + f"SELECT mon AS month, {_r('avg(tm)', 'weather_temperature_baseline')}, {_r('avg(p)', 'weather_rainfall_baseline')}"
    + " FROM monthly GROUP BY mon"
)
ORACLES["weather_climatology_merged"] = ORACLES["weather_climatology"]
ORACLES["weather_lags"] = (
    _with(*WEATHER)
    + f"SELECT {_KEYS}, {_r('lag(p) OVER w', 'weather_rainfall_lag_1')}, {_r('lag(p, 2) OVER w', 'weather_rainfall_lag_2')},"
    + f" {_r('lag(tm) OVER w', 'weather_temp_lag_1')}, {_r('lag(vpd) OVER w', 'weather_vpd_lag_1')}"
    + " FROM monthly WINDOW w AS (PARTITION BY county_id, yr ORDER BY mon)"
)
ORACLES["daily_rows_kept"] = (
    _with(RAW, KEPT) + f"SELECT county_id, l_shipdate AS date, is_daily, {TIES} FROM kept"
)
ORACLES["celsius_rows"] = (
    _with(RAW, "kept AS (SELECT * FROM raw)", DAYS)
    + f"SELECT county_id, {_r('c', 'temperature_mean')}, {_r('cx', 'temperature_max')}, {_r('cn', 'temperature_min')}, {TIES} FROM days"
)
ORACLES["day_measures"] = (
    _with(RAW, "days AS (SELECT *, 0.6108 * exp(17.27 * t / (t + 237.3)) AS es FROM raw)")
    + f"""SELECT {_KEYS}, CAST(day(last_day(l_shipdate)) AS INTEGER) AS days_in_month,
      {_r('greatest(0.0, t - 10.0)', 'gdd')}, tx >= 35.0 AS extreme_heat_day, tn <= 0.0 AS frost_day,
      rain < 1.0 AS dry_day, rain >= 1.0 AS rainy_day,
      {_r('CASE WHEN hum IS NOT NULL THEN greatest(0.0, es - es * (hum / 100.0)) END', 'vpd')}, {TIES}
    FROM days"""
)
ORACLES["readings_of_headers"] = f"""
WITH given AS (
  SELECT *, lpad(CAST(l_suppkey % 20 AS VARCHAR), 5, '0') AS county_id,
    CASE WHEN l_returnflag <> 'A' THEN l_quantity END AS hi,
    CASE WHEN l_linestatus <> 'F' THEN l_quantity - 5.0 END AS lo
  FROM lineitem WHERE l_linenumber <> 7)
SELECT county_id, CAST(NULL AS VARCHAR) AS crop_type, CAST(year(l_shipdate) AS INTEGER) AS year,
  CAST(month(l_shipdate) AS INTEGER) AS month, date_trunc('day', l_shipdate)::TIMESTAMP AS date,
  {_r('(coalesce(hi, lo) + coalesce(lo, hi)) / 2', 'temperature_mean')},
  {_r('hi', 'temperature_max')}, {_r('lo', 'temperature_min')},
  {_r("CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END", 'precipitation')},
  {_r('l_tax', 'humidity')}, CAST(NULL AS DOUBLE) AS wind_speed, CAST(NULL AS DOUBLE) AS solar_radiation,
  {TIES}
FROM given"""
ORACLES["season_weather"] = _season_weather("county_id, yr", "mon")
ORACLES["season_weather_all_years"] = _season_weather("county_id", "yr, mon")
ORACLES["core_weather"] = (
    _with(*WEATHER, _BASE)
    + f"SELECT {_KEYS}, "
    + ", ".join(
        [
            _r(e, n)
            for n, e in [
                *[(n, e) for n, e in _MEASURES if n in (
                    "weather_temp_mean", "weather_temp_max", "weather_temp_min", "weather_temp_range",
                    "weather_gdd", "weather_total_precipitation", "weather_humidity_mean", "weather_vpd",
                    "weather_solar_radiation_mean",
                )],
                ("weather_temperature_anomaly", "ta"), ("weather_rainfall_anomaly", "ra"),
            ]
        ]
        + [f"{e} AS {n}" for n, e in _COUNTS if n != "weather_days_in_month"]
    )
    + " FROM based"
)

# ------------------------------------------------------------------------------------------------
# Vegetation-index scenes
# ------------------------------------------------------------------------------------------------
SCENE = """
    CAST(vec_id AS VARCHAR) AS scene_id, lpad(CAST(label AS VARCHAR), 5, '0') AS county_id,
    CAST(2017 + vec_id % 3 AS INTEGER) AS yr, CAST(vec_id % 12 + 1 AS INTEGER) AS mon, vec_id
"""
PIXELS = f"""
px AS (
  SELECT {SCENE}, p, p // 8 AS y, p % 8 AS x, CAST(embedding[p + 1] AS DOUBLE) * 4.0 AS raw_v
  FROM (SELECT *, unnest(range(64)) AS p FROM embeddings))
"""
LOADED = """
ix AS (
  SELECT *, v >= -0.2 AND v <= 1.0 AS ok FROM (
    SELECT *, CASE WHEN max(raw_v) OVER (PARTITION BY scene_id) > 1.5
        OR min(raw_v) OVER (PARTITION BY scene_id) < -1.5
      THEN raw_v / 255.0 * 2.0 - 1.0 ELSE raw_v END AS v
    FROM px))
"""
INDEX_STATS = """
bins AS (
  SELECT scene_id, bin, count(*) AS n FROM (
    SELECT scene_id,
      CASE WHEN hi = lo THEN 0
        WHEN v < lo + g * ((hi - lo) / 10) THEN g - 1
        WHEN g < 9 AND v >= lo + (g + 1) * ((hi - lo) / 10) THEN g + 1 ELSE g END AS bin
    FROM (
      SELECT *, least(floor((v - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END * 10), 9) AS g FROM (
        SELECT *, min(v) OVER (PARTITION BY scene_id) AS lo, max(v) OVER (PARTITION BY scene_id) AS hi
        FROM ix WHERE ok)))
  GROUP BY scene_id, bin),
entropy AS (
  SELECT scene_id, -sum(n / (t + 1e-8) * ln(n / (t + 1e-8) + 1e-8)) AS ent
  FROM (SELECT *, sum(n) OVER (PARTITION BY scene_id) AS t FROM bins) GROUP BY scene_id),
shares AS (
  SELECT scene_id, any_value(county_id) AS county_id, any_value(yr) AS yr, any_value(mon) AS mon,
    avg(v) FILTER (ok) AS mean, quantile_cont(v, 0.5) FILTER (ok) AS med, max(v) FILTER (ok) AS top,
    stddev_pop(v) FILTER (ok) AS sd, quantile_cont(v, 0.25) FILTER (ok) AS q1,
    quantile_cont(v, 0.75) FILTER (ok) AS q3,
    count(*) FILTER (ok AND v > 0.3) / count(*) FILTER (ok) AS a3,
    count(*) FILTER (ok AND v > 0.5) / count(*) FILTER (ok) AS a5,
    count(*) FILTER (ok AND v > 0.7) / count(*) FILTER (ok) AS a7,
    count(*) FILTER (ok AND v < 0.2) / count(*) FILTER (ok) AS lowr,
    count(*) FILTER (ok) / count(*) AS cover, count(*) FILTER (v > 0.3) / count(*) AS veg
  FROM ix GROUP BY scene_id HAVING count(*) FILTER (ok) > 0),
stats AS (
  SELECT s.*, e.ent, CASE WHEN abs(mean) < 1e-6 THEN 0.0 ELSE sd / abs(mean) END AS cv
  FROM shares s JOIN entropy e ON s.scene_id = e.scene_id)
"""
_INDEX_COLUMNS = [
    ("ndvi_mean", "mean"), ("ndvi_median", "med"), ("ndvi_max", "top"), ("ndvi_std", "sd"),
    ("ndvi_p25", "q1"), ("ndvi_p75", "q3"), ("ndvi_above_0_3_ratio", "a3"),
    ("ndvi_above_0_5_ratio", "a5"), ("ndvi_above_0_7_ratio", "a7"), ("ndvi_low_ratio", "lowr"),
    ("ndvi_valid_coverage_ratio", "cover"), ("ndvi_vegetation_coverage_ratio", "veg"),
    ("ndvi_entropy", "ent"), ("ndvi_cv", "cv"), ("ndvi_iqr", "q3 - q1"),
    ("ndvi_valid_mean_proxy", "mean"), ("ndvi_health_index", "mean * a5"),
    ("ndvi_stress_index", "sd * lowr"), ("ndvi_greenup_potential", "a5 / (a3 + 1e-8)"),
]
_SCENE_KEYS = "scene_id, county_id, CAST(NULL AS VARCHAR) AS crop_type, yr AS year, mon AS month"
_MONTH_KEYS = "county_id, CAST(NULL AS VARCHAR) AS crop_type, yr AS year, mon AS month"
INDEX = (PIXELS, LOADED, INDEX_STATS)


def _reach(mask: str) -> str:
    """Components of the pixels that ``mask`` selects: patch = smallest reachable position."""
    return f"""
mask AS ({mask}),
near AS (
  SELECT a.scene_id, a.p, b.p AS q FROM mask a JOIN mask b
  ON a.scene_id = b.scene_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
reach AS (
  SELECT scene_id, p AS start, p FROM mask
  UNION
  SELECT r.scene_id, r.start, n.q FROM reach r JOIN near n ON r.scene_id = n.scene_id AND r.p = n.p),
areas AS (
  SELECT scene_id, patch, count(*) AS area
  FROM (SELECT scene_id, p, min(start) AS patch FROM reach GROUP BY scene_id, p)
  GROUP BY scene_id, patch),
patches AS (
  SELECT scene_id, count(*) AS patches, avg(area) AS mean_area, stddev_pop(area) AS std_area,
    CAST(max(area) AS DOUBLE) AS max_area
  FROM areas GROUP BY scene_id)"""


ORACLES["ndvi_statistics"] = (
    _with(*INDEX)
    + f"SELECT {_SCENE_KEYS}, " + ", ".join(_r(e, n) for n, e in _INDEX_COLUMNS) + " FROM stats"
)
ORACLES["ndvi_features"] = (
    _with(*INDEX, _reach("SELECT scene_id, p, y, x FROM ix WHERE v > 0.5"), recursive=True)
    + "SELECT s.scene_id, county_id, CAST(NULL AS VARCHAR) AS crop_type, yr AS year, mon AS month, "
    + ", ".join(_r(e, n) for n, e in _INDEX_COLUMNS)
    + f", coalesce(patches, 0) AS ndvi_healthy_patch_count, {_r('coalesce(max_area, 0.0) / 64', 'ndvi_largest_high_ndvi_patch_ratio')}"
    + " FROM stats s LEFT JOIN patches p ON s.scene_id = p.scene_id"
)
ORACLES["ndvi_limits"] = (
    _with(PIXELS, LOADED, _reach("SELECT scene_id, p, y, x FROM ix WHERE v > 0.4"),
          "lim AS (SELECT *, v >= -0.5 AND v <= 0.9 AS fine FROM ix)", recursive=True)
    + f"SELECT l.scene_id, {_r('avg(v) FILTER (fine)', 'ndvi_mean')}, "
    + ", ".join(
        _r(f"count(*) FILTER (fine AND v {c}) / count(*) FILTER (fine)", f"ndvi_{n}_ratio")
        for n, c in (("above_0_3", "> 0.2"), ("above_0_5", "> 0.4"), ("above_0_7", "> 0.6"), ("low", "< 0.1"))
    )
    + f", {_r('count(*) FILTER (fine) / count(*)', 'ndvi_valid_coverage_ratio')}, {_r('count(*) FILTER (v > 0.2) / count(*)', 'ndvi_vegetation_coverage_ratio')},"
    + " coalesce(any_value(patches), 0) AS ndvi_healthy_patch_count"
    + " FROM lim l LEFT JOIN patches p ON l.scene_id = p.scene_id GROUP BY l.scene_id HAVING count(*) FILTER (fine) > 0"
)
ORACLES["ndvi_rejected"] = (
    _with(PIXELS, LOADED)
    + "SELECT scene_id FROM ix GROUP BY scene_id HAVING count(*) FILTER (v - 1.0 >= -0.2 AND v - 1.0 <= 1.0) = 0"
)
ORACLES["ndvi_patches"] = (
    _with(PIXELS, _reach("SELECT scene_id, p, y, x FROM px WHERE raw_v > 0.5"), recursive=True)
    + f"SELECT scene_id, patches, {_r('mean_area', 'mean_area')}, {_r('std_area', 'std_area')}, {_r('max_area', 'max_area')} FROM patches"
)
ORACLES["patch_areas"] = (
    _with(PIXELS, _reach("SELECT scene_id, p, y, x FROM px WHERE raw_v > 0.3"), recursive=True)
    + "SELECT scene_id, CAST(patch AS INTEGER) AS patch, area FROM areas"
)
_BOUNDARY = """
full_ AS (
  SELECT a.scene_id, a.p, count(*) AS n FROM mask a JOIN mask b
  ON a.scene_id = b.scene_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1
  GROUP BY a.scene_id, a.p),
border AS (
  SELECT scene_id, count(*) AS mask_pixels, count(*) FILTER (n < 9) AS boundary_pixels
  FROM full_ GROUP BY scene_id)"""
ORACLES["patch_boundaries"] = (
    _with(PIXELS, "mask AS (SELECT * FROM px WHERE raw_v > -0.5)", _BOUNDARY) + "SELECT * FROM border"
)
ORACLES["index_levels_loaded"] = (
    _with(
        PIXELS,
        """
        cells AS (
          SELECT a.scene_id, a.p // 2 AS p, (a.raw_v + b.raw_v) / 2 AS m
          FROM px a JOIN px b ON a.scene_id = b.scene_id AND b.p = a.p + 1 WHERE a.p % 2 = 0),
        two AS (
          SELECT scene_id, p, CASE WHEN max(m) OVER w > 1.5 OR min(m) OVER w < -1.5
            THEN m / 255.0 * 2.0 - 1.0 ELSE m END AS v
          FROM cells WINDOW w AS (PARTITION BY scene_id))""",
    )
    + f"""SELECT scene_id, 'levels' AS kind, CAST(p AS INTEGER) AS p,
      {_r('floor((raw_v + 4.0) * 30.0) / 255.0 * 2.0 - 1.0', 'v')} FROM px
    UNION ALL SELECT scene_id, 'bands', CAST(p AS INTEGER), {_q('v')} FROM two"""
)
ORACLES["rgb_loaded"] = (
    _with(
        PIXELS,
        """
        given AS (
          SELECT *, CASE WHEN vec_id % 2 = 0 THEN raw_v / 8.0 + 0.5 ELSE raw_v * 40.0 * 4.0 END AS v FROM px),
        stretched AS (
          SELECT *, CASE WHEN min(v) OVER w >= 0 AND max(v) OVER w <= 1 THEN v * 255.0 ELSE v END AS s
          FROM given WINDOW w AS (PARTITION BY scene_id))""",
    )
    + """SELECT scene_id, CAST(p * 3 + k AS INTEGER) AS i,
      CAST(floor(least(greatest(s, 0.0), 255.0)) AS SMALLINT) AS level
    FROM (SELECT *, unnest(range(3)) AS k FROM stretched)"""
)

# ------------------------------------------------------------------------------------------------
# RGB scenes
# ------------------------------------------------------------------------------------------------
RGB = f"""
rgb AS (
  SELECT *, (r * 19595 + g * 38470 + b * 7471 + 32768) >> 16 AS grey, greatest(r, g, b) AS val,
    least(r, g, b) AS low
  FROM (
    SELECT {SCENE}, p, p // 8 AS y, p % 8 AS x,
      CAST(floor(abs(CAST(embedding[p + 1] AS DOUBLE)) * 700.0) AS INTEGER) % 256 AS r,
      CAST(floor(abs(CAST(embedding[p + 1] AS DOUBLE)) * 650.0) AS INTEGER) % 256 AS g,
      CAST(floor(abs(CAST(embedding[p + 1] AS DOUBLE)) * 410.0) AS INTEGER) % 256 AS b
    FROM (SELECT *, unnest(range(64)) AS p FROM embeddings))),
ratios AS (
  SELECT *,
    CAST(CAST(val - r AS DOUBLE) / nullif(val - low, 0) AS FLOAT) AS rc,
    CAST(CAST(val - g AS DOUBLE) / nullif(val - low, 0) AS FLOAT) AS gc,
    CAST(CAST(val - b AS DOUBLE) / nullif(val - low, 0) AS FLOAT) AS bc,
    CAST(CAST(val - low AS DOUBLE) / nullif(val, 0) AS FLOAT) AS sr
  FROM rgb),
turns AS (
  SELECT *, CAST(CAST(sector AS DOUBLE) / 6.0 + 1.0 - floor(CAST(sector AS DOUBLE) / 6.0 + 1.0) AS FLOAT) AS turn
  FROM (
    SELECT *, CAST(CASE WHEN r = val THEN CAST(bc AS DOUBLE) - CAST(gc AS DOUBLE)
      WHEN g = val THEN CAST(2.0 AS DOUBLE) + CAST(rc AS DOUBLE) - CAST(bc AS DOUBLE)
      ELSE CAST(4.0 AS DOUBLE) + CAST(gc AS DOUBLE) - CAST(rc AS DOUBLE) END AS FLOAT) AS sector
    FROM ratios)),
hsv AS (
  SELECT *,
    CASE WHEN val = low THEN 0 ELSE CAST(floor(CAST(turn AS DOUBLE) * 255.0) AS INTEGER) END AS hue,
    CASE WHEN val = low THEN 0 ELSE CAST(floor(CAST(sr AS DOUBLE) * 255.0) AS INTEGER) END AS sat
  FROM turns),
colours AS (
  SELECT *, sat >= 45 AND val >= 35 AND hue BETWEEN 35 AND 110 AS green,
    r > g AND g > b AND r - g BETWEEN 5 AND 30 AND g - b >= 50 AND sat >= 25 AND val >= 20
      AND hue BETWEEN 10 AND 70 AS brown,
    val BETWEEN 25 AND 220 AND ((r >= g AND g >= b AND r - b <= 140) OR sat <= 95) AS soil,
    val <= 45 OR (val >= 220 AND sat <= 40) AS murky
  FROM hsv)
"""
EDGES = """
greys AS (SELECT scene_id, list(grey ORDER BY p) AS gl FROM rgb GROUP BY scene_id),
edges AS (
  SELECT scene_id, count(*) FILTER (CASE WHEN y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6
      THEN 9 * grey - gl[p - 8] - gl[p - 7] - gl[p - 6] - gl[p] - grey - gl[p + 2]
        - gl[p + 8] - gl[p + 9] - gl[p + 10] > 12
      ELSE grey > 12 END) / count(*) AS edge
  FROM rgb JOIN greys USING (scene_id) GROUP BY scene_id)
"""
TEXTURE = """
levels AS (SELECT scene_id, grey, count(*) AS n FROM rgb GROUP BY scene_id, grey),
texture AS (
  SELECT scene_id, -sum(n / 64 * 256.0 / 255.0 * log2(n / 64 * 256.0 / 255.0)) AS ent
  FROM levels GROUP BY scene_id),
contrast AS (SELECT scene_id, stddev_pop(grey) / 255.0 AS con FROM rgb GROUP BY scene_id)
"""
COLOUR_STATS = """
shares AS (
  SELECT scene_id, any_value(county_id) AS county_id, any_value(yr) AS yr, any_value(mon) AS mon,
    count(*) FILTER (green) / count(*) AS green, count(*) FILTER (brown) / count(*) AS brown,
    count(*) FILTER (soil) / count(*) AS soil, count(*) FILTER (murky) / count(*) AS murky,
    avg(val) / 255.0 AS val, avg(sat) / 255.0 AS sat
  FROM colours GROUP BY scene_id),
colour AS (
  SELECT * FROM shares JOIN texture USING (scene_id) JOIN contrast USING (scene_id)
    JOIN edges USING (scene_id))
"""
_COLOUR_COLUMNS = [
    ("ag_green_pixel_ratio", "green"), ("ag_vegetation_area_percent", "green * 100.0"),
    ("ag_brown_yellow_pixel_ratio", "brown"),
    ("ag_green_to_brown_ratio", "CASE WHEN brown = 0 THEN 0.0 ELSE least(green / brown, 100.0) END"),
    ("ag_soil_exposure_ratio", "soil"), ("ag_texture_entropy", "ent"), ("ag_edge_density", "edge"),
    ("ag_local_contrast", "con"), ("ag_mean_brightness", "val"),
    ("ag_color_saturation_mean", "sat"), ("ag_shadow_cloud_ratio", "murky"),
]
COLOUR = (RGB, EDGES, TEXTURE, COLOUR_STATS)
_GREEN = "SELECT scene_id, p, y, x FROM colours WHERE green"

ORACLES["hsv_pixels"] = (
    _with(RGB) + "SELECT scene_id, CAST(p AS INTEGER) AS p, r, g, b, hue, sat, val FROM hsv"
)
ORACLES["ag_statistics"] = (
    _with(*COLOUR)
    + f"SELECT {_SCENE_KEYS}, " + ", ".join(_r(e, n) for n, e in _COLOUR_COLUMNS) + " FROM colour"
)
ORACLES["ag_features"] = (
    _with(*COLOUR, _reach(_GREEN), _BOUNDARY, recursive=True)
    + f"SELECT {_SCENE_KEYS}, "
    + ", ".join(
        _r(e, n)
        for n, e in [
            *_COLOUR_COLUMNS,
            ("ag_largest_vegetation_chunk_ratio", "coalesce(max_area, 0.0) / 64"),
            ("ag_mean_chunk_area", "coalesce(mean_area, 0.0)"),
            ("ag_chunk_area_std", "coalesce(std_area, 0.0)"),
            ("ag_field_uniformity_score",
             "1.0 / (1.0 + edge * 6.0 + con * 4.0 + coalesce(std_area, 0.0) / (coalesce(mean_area, 0.0) + 1.0))"),
            ("ag_vegetation_perimeter_to_area_ratio", "coalesce(boundary_pixels / mask_pixels, 0.0)"),
            ("ag_morphological_compactness",
             "CASE WHEN coalesce(boundary_pixels, 0) = 0 THEN 0.0 ELSE 4.0 * pi() * mask_pixels / (boundary_pixels * boundary_pixels) END"),
        ]
    )
    + ", coalesce(patches, 0) AS ag_number_of_vegetation_chunks"
    + " FROM colour LEFT JOIN patches USING (scene_id) LEFT JOIN border USING (scene_id)"
)
ORACLES["ag_limits"] = (
    _with(RGB)
    + f"SELECT scene_id, {_r('count(*) FILTER (sat >= 60 AND val >= 50 AND hue BETWEEN 50 AND 130) / count(*)', 'ag_green_pixel_ratio')},"
    + f" {_r('count(*) FILTER (val BETWEEN 25 AND 220 AND ((r >= g AND g >= b AND r - b <= 140) OR sat <= 70)) / count(*)', 'ag_soil_exposure_ratio')},"
    + f" {_r('count(*) FILTER (val <= 80 OR (val >= 180 AND sat <= 90)) / count(*)', 'ag_shadow_cloud_ratio')}"
    + " FROM hsv GROUP BY scene_id"
)
ORACLES["green_patches"] = (
    _with(RGB, _reach(_GREEN), recursive=True)
    + "SELECT scene_id, CAST(patch AS INTEGER) AS patch, area FROM areas"
)
ORACLES["grey_texture"] = (
    _with(RGB, TEXTURE)
    + f"SELECT scene_id, {_r('ent', 'texture_entropy')}, {_r('con', 'local_contrast')} FROM texture JOIN contrast USING (scene_id)"
)
ORACLES["grey_edges"] = _with(RGB, EDGES) + f"SELECT scene_id, {_r('edge', 'edge_density')} FROM edges"

# ------------------------------------------------------------------------------------------------
# Scenes in tiles
# ------------------------------------------------------------------------------------------------
TILES = """
tl AS (
  SELECT *, 32 * y + x AS p FROM (
    SELECT CAST(vec_id // 16 AS VARCHAR) AS scene_id, vec_id % 16 // 4 * 8 + k // 8 AS y, vec_id % 4 * 8 + k % 8 AS x,
      CAST(embedding[k + 1] AS DOUBLE) AS e
    FROM (SELECT *, unnest(range(64)) AS k FROM embeddings)))
"""
_BOX = """
box AS (
  SELECT a.scene_id, a.p, any_value(a.v) AS own, sum(b.v) AS around, count(*) AS cells
  FROM lv a JOIN lv b ON a.scene_id = b.scene_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1
  GROUP BY a.scene_id, a.p)
"""
ORACLES["tiled_patch_areas"] = (
    _with(TILES, _reach("SELECT scene_id, p, y, x FROM tl WHERE e * 4.0 > 0.3"), recursive=True)
    + "SELECT scene_id, patch // 32 AS y, patch % 32 AS x, area FROM areas"
)
ORACLES["tiled_edges"] = (
    _with(TILES, "lv AS (SELECT *, CAST(floor(abs(e) * 700.0) AS INTEGER) % 256 AS v FROM tl)", _BOX)
    + "SELECT scene_id, " + _r("count(*) FILTER (CASE WHEN cells = 9 THEN 9 * own - around > 12 ELSE own > 12 END) / count(*)", "edge_density")
    + " FROM box GROUP BY scene_id"
)
ORACLES["tiled_boundaries"] = (
    _with(TILES, "lv AS (SELECT *, CAST(e * 4.0 > -0.5 AS INTEGER) AS v FROM tl)", _BOX)
    + "SELECT scene_id, count(*) FILTER (own = 1 AND around < 9) AS boundary_pixels FROM box GROUP BY scene_id"
)
ORACLES["tiled_quantiles"] = (
    _with(TILES)
    + "SELECT scene_id, " + ", ".join(_r(f"quantile_cont(e * 4.0, {q / 100})", f"q{q}") for q in (25, 50, 75))
    + " FROM tl WHERE e * 4.0 BETWEEN -0.2 AND 1.0 GROUP BY scene_id"
)

# ------------------------------------------------------------------------------------------------
# Months and seasons of scenes
# ------------------------------------------------------------------------------------------------
INDEX_MONTHS = (
    "im AS (SELECT county_id, yr, mon, "
    + ", ".join(f"avg({e}) AS {n}" for n, e in _INDEX_COLUMNS)
    + " FROM stats GROUP BY county_id, yr, mon)"
)
COLOUR_MONTHS = (
    "cm AS (SELECT county_id, yr, mon, "
    + ", ".join(f"avg({e}) AS {n}" for n, e in _COLOUR_COLUMNS)
    + " FROM colour GROUP BY county_id, yr, mon)"
)
ORACLES["scene_month_means"] = (
    _with(*INDEX, INDEX_MONTHS)
    + f"SELECT {_MONTH_KEYS}, " + ", ".join(_r(n, n) for n, _ in _INDEX_COLUMNS) + " FROM im"
)


def _steps(months: str, y: str) -> str:
    return f"""
steps AS (
  SELECT *, {y} AS v, coalesce({y} - lag({y}) OVER w, 0.0) AS chg,
    (mon - lag(mon) OVER w) * ({y} + lag({y}) OVER w) / 2 AS area
  FROM {months} WINDOW w AS (PARTITION BY county_id, yr ORDER BY mon))"""


_SEASON = {
    "growth_slope": "CASE WHEN count(*) = 1 THEN 0.0 ELSE regr_slope(v, mon) END",
    "peak_value": "max(v)",
    "amplitude": "max(v) - min(v)",
    "auc": "CASE WHEN count(*) = 1 THEN max(v) ELSE sum(area) END",
    "stability_score": "1.0 / (1.0 + stddev_samp(chg))",
}
_SEASON_KEYS = "county_id, CAST(NULL AS VARCHAR) AS crop_type, yr AS year"
ORACLES["season_ag"] = (
    _with(*COLOUR, COLOUR_MONTHS, _steps("cm", "ag_vegetation_area_percent"))
    + f"SELECT {_SEASON_KEYS}, "
    + ", ".join(_r(e, f"ag_{n}") for n, e in _SEASON.items())
    + ", first(mon ORDER BY v DESC, mon) AS ag_peak_month, "
    + _r("avg(chg)", "ag_month_to_month_vegetation_change_mean") + ", "
    + _r("stddev_samp(chg)", "ag_month_to_month_vegetation_change_std")
    + " FROM steps GROUP BY county_id, yr"
)
_GREENUP = """CASE WHEN first(mon ORDER BY v DESC, mon) > min(mon)
  THEN (max(v) - first(v ORDER BY mon)) / (first(mon ORDER BY v DESC, mon) - min(mon)) ELSE 0.0 END"""
ORACLES["season_ndvi"] = (
    _with(*INDEX, INDEX_MONTHS, _steps("im", "ndvi_mean"))
    + f"SELECT {_SEASON_KEYS}, "
    + ", ".join(_r(e, f"ndvi_{n}") for n, e in _SEASON.items())
    + ", first(mon ORDER BY v DESC, mon) AS ndvi_peak_month, "
    + _r("avg(chg)", "ndvi_month_to_month_change_mean") + ", "
    + _r("stddev_samp(chg)", "ndvi_month_to_month_change_std") + ", "
    + _r(_GREENUP, "ndvi_greenup_rate") + ", "
    + _r("stddev_samp(v) / (avg(v) + 1e-8)", "ndvi_timeseries_cv")
    + " FROM steps GROUP BY county_id, yr"
)
ORACLES["season_ndvi_patches"] = (
    _with(*INDEX, _reach("SELECT scene_id, p, y, x FROM ix WHERE v > 0.5"), recursive=True)
    + f"SELECT {_MONTH_KEYS}, {_r('avg(mean)', 'ndvi_mean')}, {_r('avg(coalesce(patches, 0))', 'ndvi_healthy_patch_count')},"
    + f" {_r('avg(coalesce(max_area, 0.0) / 64)', 'ndvi_largest_high_ndvi_patch_ratio')}"
    + " FROM stats s LEFT JOIN patches p ON s.scene_id = p.scene_id GROUP BY county_id, yr, mon"
)
ORACLES["season_ag_patches"] = (
    _with(*COLOUR, _reach(_GREEN), """
months AS (SELECT county_id, yr, mon, avg(green * 100.0) AS v, avg(coalesce(patches, 0)) AS n, avg(coalesce(max_area, 0.0) / 64) AS m
  FROM colour LEFT JOIN patches USING (scene_id) GROUP BY county_id, yr, mon)""", recursive=True)
    + f"SELECT county_id, yr AS year, mon AS month, {_r('n', 'ag_number_of_vegetation_chunks')}, {_r('m', 'ag_largest_vegetation_chunk_ratio')},"
    + f" {_r('max(v) OVER w', 'ag_peak_value')}, {_r('max(v) OVER w - min(v) OVER w', 'ag_amplitude')} FROM months WINDOW w AS (PARTITION BY county_id, yr)"
)
ORACLES["container_months"] = (
    _with(PIXELS, LOADED)
    + f"""SELECT CAST(CAST(county_id AS INTEGER) AS VARCHAR) || '|' || yr || '-' || lpad(CAST(mon AS VARCHAR), 2, '0')
      || '-01|' || scene_id AS scene_id, county_id, yr AS year, mon AS month, {_r('avg(v)', 'mean')}
    FROM ix GROUP BY scene_id, county_id, yr, mon"""
)
ORACLES["tensor_months"] = (
    _with(
        PIXELS,
        "grids AS (SELECT scene_id || '|' || (p // 32) || '|' || (p // 16) % 2 AS sid, p // 32 + 1 AS m,"
        " max(raw_v) AS hi, min(raw_v) AS lo FROM px GROUP BY scene_id, p // 32, p // 16)",
    )
    + f"""SELECT sid AS scene_id, CAST(m AS INTEGER) AS month,
      {_r('CASE WHEN far THEN hi / 255.0 * 2.0 - 1.0 ELSE hi END', 'highest')},
      {_r('CASE WHEN far THEN lo / 255.0 * 2.0 - 1.0 ELSE lo END', 'lowest')}
    FROM (SELECT *, hi > 1.5 OR lo < -1.5 AS far FROM grids)"""
)

# ------------------------------------------------------------------------------------------------
# Labels
# ------------------------------------------------------------------------------------------------
LABELS = """
given AS (
  SELECT c_custkey, c_acctbal, c_nationkey, c_mktsegment, trim(n_name) AS state_name,
    c_nationkey % 9 AS state_ansi, c_custkey % 999 AS county_ansi,
    CASE WHEN c_mktsegment <> 'BUILDING' AND c_nationkey % 4 <> 0 THEN 'County' ELSE 'STATE' END AS agg_level_desc,
    CASE WHEN c_custkey % 3 = 0 THEN 'TOTAL' ELSE 'NOT TOTAL' END AS domain_desc,
    'p' || c_nationkey AS source_path, CAST(2017 + c_nationkey % 7 AS INTEGER) AS yr
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  WHERE c_custkey % 11 = 0 OR c_acctbal >= 0),
by_level AS (
  SELECT * FROM (SELECT *, bool_or(agg_level_desc = 'County') OVER (PARTITION BY source_path) AS any_c FROM given)
  WHERE agg_level_desc = 'County' OR NOT any_c),
chosen AS (
  SELECT *, lpad(CAST(state_ansi AS VARCHAR), 2, '0') AS s2, lpad(CAST(county_ansi AS VARCHAR), 3, '0') AS c3,
    CASE yr WHEN 2017 THEN 'train' WHEN 2018 THEN 'train' WHEN 2019 THEN 'train' WHEN 2020 THEN 'train'
      WHEN 2021 THEN 'validation' WHEN 2022 THEN 'test' END AS split
  FROM (SELECT *, bool_or(domain_desc = 'TOTAL') OVER (PARTITION BY source_path) AS any_t FROM by_level)
  WHERE domain_desc = 'TOTAL' OR NOT any_t),
anchors AS (SELECT *, s2 || c3 AS county_id FROM chosen WHERE c_custkey % 11 <> 0)
"""
ORACLES["label_choice"] = (
    _with(LABELS) + "SELECT c_custkey, source_path, agg_level_desc, domain_desc FROM chosen"
)
ORACLES["label_anchors"] = (
    _with(LABELS)
    + f"""SELECT split, county_id, 'corn' AS crop_type, yr AS year, 'yield' AS target_kind,
      {_r('c_acctbal', 'target_value')}, 'BU / ACRE' AS target_unit, source_path, state_name,
      agg_level_desc, domain_desc, s2 AS state_ansi, c3 AS county_ansi,
      CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS feature_segment,
      {_r('CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END', 'feature_balance')},
      c_custkey AS feature_custkey
    FROM anchors"""
)
ORACLES["label_rejects"] = (
    _with(LABELS) + "SELECT c_custkey, 'not numeric' AS reason FROM chosen WHERE c_custkey % 11 = 0"
)
ORACLES["label_usable"] = (
    _with(LABELS)
    + f"SELECT county_id, 'corn' AS crop_type, yr AS year, split, {_r('c_acctbal', 'target_value')} FROM anchors WHERE split IS NOT NULL"
)
ORACLES["label_county_ids"] = _with(LABELS) + "SELECT DISTINCT county_id FROM anchors"
ORACLES["label_in_counties"] = (
    _with(LABELS)
    + f"SELECT county_id, {_r('c_acctbal', 'target_value')}, source_path FROM anchors WHERE county_id IN ('01003', '02010', '03017', '07500')"
)
ORACLES["label_split_counts"] = (
    _with(LABELS)
    + """SELECT 'corn' AS crop_type, s AS split, count(split) AS "rows"
    FROM (SELECT unnest(['train', 'validation', 'test']) AS s) LEFT JOIN anchors ON split = s GROUP BY s"""
)
_PATHS = """
paths AS (
  SELECT o_orderkey % 4 AS kind, crop, yr, CASE o_orderkey % 4
    WHEN 0 THEN 'USDA Crop Dataset/' || crop || '/' || yr || file
    WHEN 1 THEN 'USDA/data/' || yr || '/' || crop || file
    WHEN 2 THEN 'USDA/Crop Dataset/' || crop || '/' || yr || file
    ELSE 'USDA/stats' || file END AS path
  FROM (
    SELECT *, '/USDA_' || crop || '_County_' || yr || '.csv' AS file FROM (
      SELECT o_orderkey, year(o_orderdate) + 18 AS yr,
        ['Corn', 'Soybeans', 'WinterWheat', 'Cotton', 'Rye'][o_orderkey % 5 + 1] AS crop
      FROM orders)))
"""
ORACLES["label_paths_selected"] = (
    _with(_PATHS)
    + "SELECT DISTINCT path FROM paths WHERE kind <> 3 AND yr IN (2017, 2018, 2020) AND crop IN ('Corn', 'WinterWheat')"
)
ORACLES["label_path_fields"] = (
    _with(_PATHS)
    + """SELECT DISTINCT path, CAST(CASE WHEN kind <> 3 THEN yr END AS INTEGER) AS year,
      CASE WHEN kind <> 3 THEN CASE crop WHEN 'Corn' THEN 'corn' WHEN 'Soybeans' THEN 'soybeans'
        WHEN 'WinterWheat' THEN 'winter wheat' WHEN 'Cotton' THEN 'cotton' END END AS crop_type
    FROM paths"""
)
ORACLES["code_lookups"] = """
WITH states AS (
  SELECT * FROM (VALUES (1, 'AL'), (2, 'AK'), (4, 'AZ'), (5, 'AR'), (6, 'CA'), (8, 'CO'), (9, 'CT'),
    (10, 'DE'), (11, 'DC'), (12, 'FL'), (13, 'GA'), (15, 'HI'), (16, 'ID'), (17, 'IL'), (18, 'IN'),
    (19, 'IA'), (20, 'KS'), (21, 'KY'), (22, 'LA'), (23, 'ME'), (24, 'MD')) AS s(code, abbr)),
crops AS (
  SELECT * FROM (VALUES (0, 'corn', 'PRODUCTION, MEASURED IN BU', 'BU / ACRE'),
    (1, 'cotton', 'PRODUCTION, MEASURED IN 480 LB BALES', 'LB / ACRE'),
    (2, 'soybeans', 'PRODUCTION, MEASURED IN BU', 'BU / ACRE'),
    (3, 'winter wheat', 'PRODUCTION, MEASURED IN BU', 'BU / ACRE')) AS c(k, crop, col, unit))
SELECT c_custkey, abbr AS state, crop, col AS "column", unit,
  CASE 2015 + c_custkey % 9 WHEN 2017 THEN 'train' WHEN 2018 THEN 'train' WHEN 2019 THEN 'train'
    WHEN 2020 THEN 'train' WHEN 2021 THEN 'validation' WHEN 2022 THEN 'test' END AS split,
  CASE WHEN trunc(c_acctbal) < 0
    THEN '-' || CASE WHEN length(CAST(CAST(-trunc(c_acctbal) AS BIGINT) AS VARCHAR)) < 3
      THEN lpad(CAST(CAST(-trunc(c_acctbal) AS BIGINT) AS VARCHAR), 3, '0')
      ELSE CAST(CAST(-trunc(c_acctbal) AS BIGINT) AS VARCHAR) END
    WHEN length(CAST(CAST(trunc(c_acctbal) AS BIGINT) AS VARCHAR)) < 4
    THEN lpad(CAST(CAST(trunc(c_acctbal) AS BIGINT) AS VARCHAR), 4, '0')
    ELSE CAST(CAST(trunc(c_acctbal) AS BIGINT) AS VARCHAR) END AS code,
  CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 5 THEN lpad(CAST(c_custkey AS VARCHAR), 5, '0')
    ELSE CAST(c_custkey AS VARCHAR) END AS fips
FROM customer LEFT JOIN states ON c_nationkey = code LEFT JOIN crops ON c_custkey % 5 = k"""
ORACLES["date_key_months"] = """
SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN month(o_orderdate)
  WHEN 1 THEN CAST(substr(strftime(o_orderdate, '%Y%m%d'), 6, 2) AS INTEGER)
  WHEN 2 THEN month(o_orderdate) END AS INTEGER) AS month
FROM orders"""
ORACLES["normalised_keys"] = r"""
SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS key FROM documents"""

# ------------------------------------------------------------------------------------------------
# Assembly
# ------------------------------------------------------------------------------------------------
ORACLES["joined_modalities"] = (
    _with(
        *WEATHER,
        *(c.replace("shares AS", "cshares AS").replace("FROM shares", "FROM cshares") for c in COLOUR),
        COLOUR_MONTHS,
        *INDEX,
        INDEX_MONTHS,
        "wm AS (SELECT county_id, yr + 18 AS yr, mon, tm, rainy FROM monthly)",
    )
    + f"""SELECT county_id, CAST(NULL AS VARCHAR) AS crop_type, CAST(yr AS INTEGER) AS year, mon AS month,
      {_r('cm.ag_green_pixel_ratio', 'ag_green_pixel_ratio')}, {_r('im.ndvi_mean', 'ndvi_mean')},
      {_r('wm.tm', 'weather_temp_mean')}, wm.rainy AS weather_rainy_days
    FROM cm FULL JOIN im USING (county_id, yr, mon) FULL JOIN wm USING (county_id, yr, mon)"""
)
ORACLES["month_wide"] = (
    _with(*INDEX, INDEX_MONTHS)
    + "SELECT county_id, yr AS year, "
    + ", ".join(
        _r(f"max({c}) FILTER (mon = {m})", f"ndvi_m{m:02d}_{c}")
        for m in range(1, 13)
        for c in ("ndvi_mean", "ndvi_max")
    )
    + ", CAST(count(DISTINCT mon) AS INTEGER) AS ndvi_month_count FROM im GROUP BY county_id, yr"
)
_PAIRS = """
pairs AS (
  SELECT county_id, yr, 'ndvi_m' || lpad(CAST(mon AS VARCHAR), 2, '0') || '_ndvi_mean' AS key, ndvi_mean AS value FROM im
  UNION ALL
  SELECT county_id, yr, 'ndvi_month_count', count(*) FROM im GROUP BY county_id, yr
  UNION ALL
  SELECT county_id, yr, 'ndvi_observation_count', count(*) FROM im GROUP BY county_id, yr)
"""
ORACLES["month_keys_values"] = (
    _with(*INDEX, INDEX_MONTHS, _PAIRS)
    + f"""SELECT county_id, yr AS year, key, {_r('value', 'value')} FROM pairs
    UNION ALL SELECT county_id, yr, 'ndvi_m' || lpad(CAST(mon AS VARCHAR), 2, '0') || '_ndvi_max', {_q('ndvi_max')} FROM im"""
)
ORACLES["distinct_month_keys"] = (
    _with(PIXELS) + f"SELECT DISTINCT {_MONTH_KEYS} FROM px"
)
ORACLES["anchor_records"] = (
    _with(
        *INDEX,
        INDEX_MONTHS,
        _PAIRS,
        _steps("im", "ndvi_mean"),
        """
        everything AS (
          SELECT * FROM pairs
          UNION ALL SELECT county_id, yr, 'ndvi_peak_month', first(mon ORDER BY v DESC, mon) FROM steps GROUP BY county_id, yr
          UNION ALL SELECT county_id, yr, 'ndvi_amplitude', max(v) - min(v) FROM steps GROUP BY county_id, yr
          UNION ALL SELECT county_id, yr, 'ndvi_available_months', count(*) FROM im GROUP BY county_id, yr
          UNION ALL SELECT county_id, yr, 'ndvi_feature_rows', count(*) FROM im GROUP BY county_id, yr)""",
        LABELS,
    )
    + f"""SELECT e.county_id, 'corn' AS crop_type, e.yr AS year, split, {_r('c_acctbal', 'target_value')},
      source_path, s2 AS state_ansi, state_name, key, {_r('value', 'value')}
    FROM anchors a JOIN everything e
    ON lpad(CAST(c_custkey % 10 AS VARCHAR), 5, '0') = e.county_id AND a.yr = e.yr WHERE split IS NOT NULL"""
)

# ------------------------------------------------------------------------------------------------
# Fusion and checks
# ------------------------------------------------------------------------------------------------
FUSION = """
fusion AS (
  SELECT o_orderkey, o_orderpriority,
    CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice / 10000.0 END AS tm,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice / 20000.0 END AS tn,
    CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice / 5000.0 END AS tx,
    c_acctbal AS rain,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 4000.0 END AS hum,
    CASE WHEN o_orderkey % 6 <> 0 THEN c_acctbal + 100.0 END AS sol,
    ['Rice', 'soy-beans', 'soybeans', 'MAIZE', '', 'Tomato ', 'oats'][o_orderkey % 7 + 1] AS crop,
    CASE WHEN o_orderkey % 2 <> 0 THEN o_orderpriority END AS region,
    CAST(year(o_orderdate) - CASE WHEN o_orderkey % 17 = 0 THEN 100 ELSE 0 END AS INTEGER) AS yr,
    CAST(CASE WHEN o_orderkey % 8 <> 0 THEN o_orderkey % 40 - 2 END AS INTEGER) AS age,
    ['Healthy', 'leaf_mild', 'No-Disease', 'severe ', 'rust', 'unhealthy'][o_orderkey % 6 + 1]
      || CASE WHEN c_mktsegment = 'BUILDING' THEN ' moderate' ELSE '' END AS disease,
    o_totalprice / 480000.0 AS score, o_totalprice / 500000.0 AS conf
  FROM orders JOIN customer ON o_custkey = c_custkey)
"""
ORACLES["fusion_flat"] = (
    _with(
        FUSION,
        """named AS (SELECT *, replace(replace(lower(trim(crop)), '_', ' '), '-', ' ') AS ck,
          replace(replace(lower(trim(disease)), '_', ' '), '-', ' ') AS dk FROM fusion)""",
    )
    + f"""SELECT o_orderkey, {_r('tm', 'temperature_mean')}, {_r('rain', 'rainfall_total')}, crop AS crop_type,
      CASE ck WHEN '' THEN NULL WHEN 'rice' THEN 1 WHEN 'maize' THEN 2 WHEN 'soybeans' THEN 4
        WHEN 'tomato' THEN 7 ELSE 0 END AS crop_type_encoded,
      yr AS year, disease AS disease_class, {_r('score', 'health_score')},
      {_r('''CASE WHEN dk IN ('healthy', 'no disease') THEN 1.0 WHEN contains(dk, 'healthy') THEN 1.0
        WHEN contains(dk, 'mild') THEN 0.75 WHEN contains(dk, 'moderate') THEN 0.5
        WHEN contains(dk, 'severe') THEN 0.25 ELSE 0.5 END::DOUBLE''', 'disease_class_health_score')},
      {_r('conf', 'image_confidence')}, {_r('tn', 'temperature_min')}, {_r('tx', 'temperature_max')},
      {_r('hum', 'humidity_mean')}, {_r('sol', 'solar_radiation_mean')}, region, age AS planting_age_days
    FROM named"""
)
ORACLES["input_checks"] = (
    _with(FUSION)
    + """SELECT o_orderkey, concat_ws(',',
      CASE WHEN tm IS NULL THEN 'weather_temperature_mean' END,
      CASE WHEN rain < 0 THEN 'weather_rainfall_total' END,
      CASE WHEN hum < 0 OR hum > 100 THEN 'weather_humidity_mean' END,
      CASE WHEN sol < 0 THEN 'weather_solar_radiation_mean' END,
      CASE WHEN length(crop) < 1 THEN 'crop_crop_type' END,
      CASE WHEN yr < 1900 THEN 'crop_year' END,
      CASE WHEN age < 0 THEN 'crop_planting_age_days' END,
      CASE WHEN length(disease) < 1 THEN 'image_prediction_disease_class' END,
      CASE WHEN score < 0 OR score > 1 THEN 'image_prediction_health_score' END,
      CASE WHEN conf < 0 OR conf > 1 THEN 'image_prediction_confidence' END) AS reasons
    FROM fusion"""
)
ORACLES["prediction_checks"] = """
SELECT c_custkey, 0 AS n_warnings, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'predicted_yield' END,
  CASE WHEN c_custkey % 3 = 0 THEN 'unit' END, CASE WHEN c_custkey % 4 = 0 THEN 'model_name' END) AS reasons
FROM customer"""

ORACLES["weather_records"] = (
    _with(
        *WEATHER,
        LABELS,
        """
        seasons AS (SELECT county_id, yr, count(*) AS months, max(p) FILTER (mon = 3) AS march, sum(hs) AS heat
                    FROM monthly GROUP BY county_id, yr)""",
    )
    + f"""SELECT s.county_id, 'corn' AS crop_type, s.yr AS year, CAST(c_custkey AS VARCHAR) AS source_path,
      {_r('c_acctbal', 'target_value')}, CAST(months AS DOUBLE) AS months, CAST(months AS DOUBLE) AS feature_rows,
      {_r('march', 'march_rain')}, {_r('heat', 'heat_stress')}
    FROM anchors a JOIN seasons s ON lpad(CAST(c_custkey % 20 AS VARCHAR), 5, '0') = s.county_id AND 1992 + c_custkey % 7 = s.yr"""
)
ORACLES["container_features"] = (
    _with(PIXELS, LOADED)
    + f"""SELECT 'file' || CAST(scene_id AS BIGINT) % 2 || '|1003|'
      || CASE WHEN CAST(scene_id AS BIGINT) % 10 <> 0 THEN '2019-05-01' ELSE '?' END || '|' || CAST(scene_id AS BIGINT) // 2 AS scene_id,
      '01003' AS county_id, CAST(CASE WHEN CAST(scene_id AS BIGINT) % 10 <> 0 THEN 5 END AS INTEGER) AS month,
      {_r('avg(v)', 'mean')}, {_r('max(v)', 'highest')}
    FROM ix GROUP BY scene_id"""
)
ORACLES["label_features_mixed"] = f"""
SELECT CAST(c_custkey AS VARCHAR) AS source_path, CASE WHEN c_custkey % 2 = 0 THEN 'corn' ELSE 'cotton' END AS crop_type,
  lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 500 AS VARCHAR), 3, '0') AS county_id,
  {_r('c_acctbal', 'target_value')}, CASE WHEN c_custkey % 2 = 0 THEN 'BU / ACRE' ELSE 'LB / ACRE' END AS target_unit,
  CASE c_custkey % 4 WHEN 0 THEN 'BIGINT' WHEN 1 THEN 'DOUBLE' WHEN 2 THEN 'STRING' END AS kind,
  CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN c_custkey || '.5' WHEN 2 THEN 'no. ' || c_custkey END AS extra
FROM customer WHERE c_custkey % 11 <> 0
"""
ORACLES["record_lines"] = r"""
SELECT c_custkey, '{"id":' || c_custkey
  || CASE WHEN c_custkey % 3 <> 0 THEN ',"name":"\"' || c_name || '\\"' ELSE '' END
  || CASE WHEN c_custkey % 4 <> 0 THEN ',"balance":' || CAST(CAST(c_acctbal AS DOUBLE) AS VARCHAR) ELSE '' END
  || ',"features":{"segment":' || CASE WHEN c_custkey % 5 <> 0 THEN '"' || c_mktsegment || '"' ELSE 'null' END || '}'
  || CASE WHEN c_custkey % 4 = 0 THEN ',"balance":null' ELSE '' END || '}' AS line
FROM customer
"""
_CORE_NDVI = [
    "ndvi_mean", "ndvi_median", "ndvi_std", "ndvi_p25", "ndvi_p75", "ndvi_above_0_3_ratio", "ndvi_above_0_5_ratio",
    "ndvi_low_ratio",
]
ORACLES["core_ndvi"] = f"SELECT county_id, crop_type, year, month, {', '.join(_CORE_NDVI)} FROM ({ORACLES['scene_month_means']})"
_CORE_AG = [
    "ag_green_pixel_ratio", "ag_vegetation_area_percent", "ag_brown_yellow_pixel_ratio", "ag_soil_exposure_ratio",
    "ag_texture_entropy", "ag_edge_density",
]
ORACLES["core_ag"] = (
    _with(*COLOUR, COLOUR_MONTHS) + f"SELECT {_MONTH_KEYS}, " + ", ".join(_r(c, c) for c in _CORE_AG) + " FROM cm"
)
ORACLES["dates_assembled"] = f"""
SELECT strftime(d, '%Y-%m-%d') AS date, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, l_orderkey, l_linenumber, l_partkey,
  {_r('l_extendedprice', 'l_extendedprice')}, {_r('l_quantity', 'l_quantity')}
FROM (SELECT *, try_cast(strftime(l_shipdate, '%Y-%m-') || lpad(CAST(CASE WHEN l_orderkey % 9 = 0 THEN 31 ELSE day(l_shipdate) END AS VARCHAR), 2, '0')
  AS DATE) AS d FROM lineitem) WHERE d IS NOT NULL
"""
ORACLES["united_by_name"] = """
SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 3 <> 1 THEN c_name END AS name,
  CASE WHEN c_custkey % 3 <> 2 THEN CAST(c_acctbal AS VARCHAR) END AS balance,
  CASE WHEN c_custkey % 3 = 2 THEN c_mktsegment END AS segment, CAST(NULL AS VARCHAR) AS never_filled
FROM customer
"""
