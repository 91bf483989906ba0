"""Registered queries of the library's own operators over whole tables, with their DuckDB SQL.

The tables hold no flights, so stand-ins of the same shape are used: ``events`` as image and sensor
logs, ``lineitem`` as footprints, ``embeddings`` as 8 x 8 images, ``pages`` and ``events`` as file names.
Each stand-in is one list of expressions that Spark and DuckDB both read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import geo, pixels as px, predicate, projection as pr, text as tx
from .operators import correlate as co, histogram as hi, interpolate as ip, mosaic as mo, neighbours as nn, order as od, registrar as rg, scores as sc
from .operators.quantiles import exact_quantiles
from .sources import files as fs, logs as lg

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col


def query(sql: str | None = None) -> Callable:
    """Register a function of (table reader) under its name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


RECT = {
    "image_id": "l_orderkey * 10 + l_linenumber", "camera_num": "l_suppkey % 3", "x_min": "l_extendedprice / 100", "x_max": "l_extendedprice / 100 + l_quantity",
    "y_min": "CAST(l_partkey AS DOUBLE) / 10", "y_max": "CAST(l_partkey AS DOUBLE) / 10 + 1 + l_discount * 100", "pixel_width": "0.5 + l_tax", "pixel_height": "-0.5 - l_tax",
    "padding": "l_tax * 10", "sensor_x": "l_extendedprice / 100 + l_quantity / 2 + l_discount * 10", "sensor_y": "CAST(l_partkey AS DOUBLE) / 10 + l_tax", "mAltitude": "l_extendedprice / 4",
    "x_size": "CAST(l_quantity AS BIGINT) + 1", "y_size": "CAST(l_discount * 100 AS BIGINT) + 1", "tax": "l_tax",
}
RECT_SQL = "rect AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in RECT.items()) + " FROM lineitem)"


def rects(t: Callable) -> DataFrame:
    return t("lineitem").selectExpr(*(f"{e} AS {n}" for n, e in RECT.items()))


RASTER = {"x_min": 0.0, "x_max": 1100.0, "y_min": 0.0, "y_max": 2100.0, "pixel_width": 0.5, "pixel_height": -0.5, "x_size": 2200, "y_size": 4200}


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Rounded as SQL engines round doubles: the value is scaled in double precision before halves go away
    from zero. ``F.round`` with digits rounds the shortest decimal form, which differs for halves."""
    return df.withColumns({x: F.round(c(x).cast("double") * 10.0**digits, 0) / 10.0**digits for x in columns})


def images(t: Callable) -> DataFrame:
    return t("events").where("event_type = 'purchase'").selectExpr("event_id AS image_id", "ts", "event_id % 3 AS camera_num", "value")


IMG_SQL = "img AS (SELECT event_id AS image_id, ts, event_id % 3 AS camera_num, value FROM events WHERE event_type = 'purchase')"
NAME = "concat('/flight/', CAST(event_id % 3 AS STRING), '/Geo ', CAST(event_id AS STRING), '_', CAST(event_id % 3 AS STRING), CASE WHEN event_id % 5 = 0 THEN '.raw' ELSE '.tif' END)"
NAME_SQL = NAME.replace("STRING", "VARCHAR")


def named(t: Callable) -> DataFrame:
    return t("events").selectExpr("event_id", f"{NAME} AS filepath")


def grey(t: Callable) -> DataFrame:
    """Embeddings as arrays of 0..255."""
    return t("embeddings").select("vec_id", "label", F.transform("embedding", lambda v: F.least(F.greatest(F.floor((v.cast("double") + 0.5) * 255), F.lit(0)), F.lit(255)).cast("int")).alias("px"))


GREY_SQL = "grey AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(least(greatest(floor((CAST(v AS DOUBLE) + 0.5) * 255), 0), 255) AS INT)) AS px FROM embeddings)"

# --- sources -------------------------------------------------------------------------------------


@query("SELECT row_number() OVER (ORDER BY filepath) - 1 AS file_id, filepath FROM (SELECT " + NAME_SQL + " AS filepath FROM events) WHERE regexp_matches(filepath, 'Geo .*(\\.tif|\\.tiff)$')")
def s2_select_files(t):
    return fs.select_files(named(t).select("filepath"), [r"\.tif", r"\.tiff"], "Geo ")


@query("SELECT url AS filepath FROM pages WHERE regexp_matches(url, 'page=\\d+') UNION ALL SELECT url FROM pages WHERE regexp_matches(url, '#top$')")
def s5_discover(t):
    return fs.discover(t("pages").select(c("url").alias("filepath")), [r"page=\d+", r"#top$"])


RAW = "concat(' ', date_format(ts, 'yyyyMMdd_HHmmss'), '_', CAST(event_id * 700001 % 4294967296 - 2147483648 AS STRING))"
RAW_SQL = "' ' || strftime(ts, '%Y%m%d_%H%M%S') || '_' || CAST(event_id * 700001 % 4294967296 - 2147483648 AS VARCHAR)"


@query(f"""SELECT event_id, date_trunc('second', ts) AS timestamp, CAST(CASE WHEN n < 0 THEN n + 4294967296 ELSE n END AS VARCHAR) AS timestamp_id,
  'img_' || event_id || '.raw' AS filename FROM (SELECT *, event_id * 700001 % 4294967296 - 2147483648 AS n FROM events)""")
def s6_image_log(t):
    line = F.expr(f"concat_ws(',', date_format(ts, 'MM-dd HH:mm:ss'), {RAW}, '0', '77', '50', '3', '21', concat('/data/img_', event_id, '.raw'), 'x', 'y')")
    return lg.image_log(t("events").select("event_id", line.alias("value")), keep=["event_id"]).select("event_id", c("timestamp").cast("timestamp_ntz").alias("timestamp"), "timestamp_id", "filename")


@query("SELECT event_id, CAST(event_id AS VARCHAR) AS image_cycle, CAST(event_id % 7 + 100 AS VARCHAR) AS serial_num, event_id % 3 AS camera_num, make_timestamp(1707005484000000 + event_id * 250000) AS timestamp FROM events")
def s7_names_as_log(t):
    path = F.expr("concat('/d/', event_id, '_', CAST(1707005484 + event_id / 4 AS DECIMAL(20,6)), '_', event_id % 7 + 100, '_', event_id % 3, '_img_0.raw')")
    out = lg.log_from_names(t("events").select("event_id", path.alias("filepath")))
    return out.select("event_id", "image_cycle", "serial_num", c("camera_num").cast("long").alias("camera_num"), c("timestamp").cast("timestamp_ntz").alias("timestamp"))


IMU = "SELECT ts, value, event_id, value * 100 - 2000 AS alt, CASE WHEN event_type = 'error' THEN -1.0 ELSE value + 900 END AS p FROM events WHERE event_type <> 'signup'"


@query(f"""SELECT count(*) AS n, count(ts2) AS n_time, round(sum(m), 4) AS altitude, round(sum(g), 4) AS gyro FROM (
  SELECT CASE WHEN p >= 0 THEN ts END AS ts2, CASE WHEN p >= 0 AND alt >= 0 AND alt <= 20000 THEN alt END AS m, CASE WHEN p >= 0 THEN sqrt(value * value + 9 + 16) END AS g FROM ({IMU}))""")
def s8_imu_log(t):
    lines = t("events").where("event_type <> 'signup'").selectExpr("CAST(ts AS STRING) AS CurrTimestamp", "'20.0' AS TempC", "CAST(CASE WHEN event_type = 'error' THEN -1.0 ELSE value + 900 END AS STRING) AS pressure", "CAST(value * 100 - 2000 AS STRING) AS mAltitude", "CAST(value AS STRING) AS imuGyroX", "'3' AS imuGyroY", "'4' AS imuGyroZ")
    header = t("events").where("event_type = 'signup'").selectExpr(*(f"'{x}' AS {x}" for x in lines.columns))
    log = lg.imu_log(lines.unionByName(header))
    return rounded(log.agg(F.count("*").alias("n"), F.count("CurrTimestamp").alias("n_time"), F.sum("mAltitude").alias("altitude"), F.sum("imuGyroMag").alias("gyro")), "altitude", "gyro")


@query("""SELECT event_id, round(6378137.0 * radians(lon), 3) AS sensor_x, round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS sensor_y
FROM (SELECT event_id, user_id % 80 + value / 1000 AS lat, value / 10 - 90 AS lon FROM events WHERE event_type <> 'error')""")
def s9_gps_log(t):
    raw = t("events").selectExpr("event_id", "CASE WHEN event_type = 'error' THEN '00.00.0000 00:00:00000' ELSE CAST(ts AS STRING) END AS CurrTimestamp", "CAST(user_id % 80 + value / 1000 AS STRING) AS GPSLat", "CAST(value / 10 - 90 AS STRING) AS GPSLong")
    return rounded(lg.gps_log(raw, keep=["event_id"]).select("event_id", "sensor_x", "sensor_y"), "sensor_x", "sensor_y", digits=3)


@query("SELECT event_id, CAST(10 * (event_id % 36) - 180 AS DOUBLE) AS west, CAST(10 * (event_id % 36) - 170 AS DOUBLE) AS east, CAST(80 - 10 * (event_id % 18) AS DOUBLE) AS south, CAST(90 - 10 * (event_id % 18) AS DOUBLE) AS north FROM events")
def s14_tile_bounds(t):
    return t("events").select("event_id", *(v.cast("double").alias(k) for k, v in geo.tile_bounds(c("event_id") % 36, c("event_id") % 18).items()))


PIX = "SELECT vec_id, label, i AS i, vec_id * 7 % 57 + i % 8 AS x, vec_id * 13 % 57 + i // 8 AS y, label * 1000000 + vec_id AS ord, px[i + 1] AS v FROM (SELECT vec_id, label, px, unnest(range(0, len(px))) AS i FROM grey)"


def contributions(t: Callable) -> DataFrame:
    p = grey(t).select("vec_id", "label", F.posexplode("px").alias("i", "v"))
    return p.select("vec_id", "label", "i", (c("vec_id") * 7 % 57 + c("i") % 8).alias("x"), (c("vec_id") * 13 % 57 + F.floor(c("i") / 8)).alias("y"), (c("label") * 1000000 + c("vec_id")).alias("order"), (F.when(c("v") > 140, c("v")).otherwise(0)).alias("r"), (c("v") % 5).alias("a"))


PIX_SQL = f"{GREY_SQL}, pix AS (SELECT *, CASE WHEN v > 140 THEN v ELSE 0 END AS r, v % 5 AS a FROM ({PIX}))"


@query(f"WITH {PIX_SQL} SELECT x, y, r, vec_id FROM pix WHERE x BETWEEN 10 AND 29 AND y BETWEEN 20 AND 34")
def s17_read_window(t):
    return mo.read_window(contributions(t), (10, 20, 20, 15)).select("x", "y", "r", "vec_id")


# --- joins ---------------------------------------------------------------------------------------

LOG = "SELECT concat('Geo ', CAST(event_id AS STRING), '_', CAST(event_id % 3 AS STRING), '.tif') AS filename, CAST(event_id AS STRING) AS timestamp_id, value FROM events"
LOG_SQL = LOG.replace("STRING", "VARCHAR")


def log_rows(t: Callable, where: str) -> DataFrame:
    return t("events").where(where).selectExpr("concat('Geo ', event_id, '_', event_id % 3, '.tif') AS filename", "CAST(event_id AS STRING) AS timestamp_id", "value")


def file_rows(t: Callable) -> DataFrame:
    return t("events").selectExpr("event_id AS file_id", "concat('/d/', CASE WHEN event_type IN ('view', 'error') THEN concat('Geo ', event_id, '_', event_id % 3, '.tif') ELSE concat('id', event_id, 'x.tif') END) AS filepath")


FILES_SQL = "f AS (SELECT event_id AS file_id, '/d/' || CASE WHEN event_type IN ('view', 'error') THEN 'Geo ' || event_id || '_' || event_id % 3 || '.tif' ELSE 'id' || event_id || 'x.tif' END AS filepath FROM events)"


@query(f"WITH {FILES_SQL}, l AS ({LOG_SQL} WHERE event_type <> 'error') SELECT file_id, value FROM f JOIN l ON regexp_extract(filepath, '[^/]*$') = filename")
def j1_filename_join(t):
    return co.correlate(file_rows(t), log_rows(t, "event_type <> 'error'")).select("file_id", "value")


CASCADE = f"""WITH {FILES_SQL}, l AS ({LOG_SQL} WHERE event_type <> 'error'), n AS (SELECT *, regexp_extract(filepath, '[^/]*$') AS filename FROM f),
  a AS (SELECT file_id, value FROM n JOIN l USING (filename)), r AS (SELECT n.* FROM n ANTI JOIN l USING (filename)),
  b AS (SELECT file_id, value FROM (SELECT *, regexp_extract_all(filename, '[0-9]+')[-1] AS timestamp_id FROM r) JOIN l USING (timestamp_id))"""


@query(CASCADE + " SELECT * FROM a UNION ALL SELECT * FROM b")
def j2_cascading_join(t):
    return co.correlate(file_rows(t), log_rows(t, "event_type <> 'error'"), ("[0-9]+",)).select("file_id", "value")


@query(CASCADE + " SELECT file_id, value, true AS selected FROM a UNION ALL SELECT file_id, value, true FROM b UNION ALL SELECT file_id, NULL, false FROM f WHERE file_id NOT IN (SELECT file_id FROM a UNION SELECT file_id FROM b)")
def j3_unmatched_passthrough(t):
    return co.correlate(file_rows(t), log_rows(t, "event_type <> 'error'"), ("[0-9]+",), "passthrough").select("file_id", "value", "selected")


def interp_sql(kind: str, out: str) -> str:
    return f"""{out} AS (SELECT i.image_id, a.ts AS t0, b.ts AS t1, CASE WHEN a.ts IS NULL AND b.ts = i.ts THEN b.value ELSE
  a.value + (b.value - a.value) / (epoch_us(b.ts) - epoch_us(a.ts)) * (epoch_us(i.ts) - epoch_us(a.ts)) END AS v
  FROM img i ASOF LEFT JOIN (SELECT ts, value FROM events WHERE event_type = '{kind}') a ON i.ts > a.ts
  ASOF LEFT JOIN (SELECT ts, value FROM events WHERE event_type = '{kind}') b ON i.ts <= b.ts)"""


@query(f"WITH {IMG_SQL}, {interp_sql('click', 'h')} SELECT image_id, round(v, 4) AS altitude FROM h")
def j4_interpolation(t):
    log = t("events").where("event_type = 'click'").select("ts", c("value").alias("altitude"))
    return rounded(ip.interpolate_at(images(t).select("image_id", "ts"), log, "ts", ["altitude"]).select("image_id", "altitude"), "altitude")


SLICE_SQL = f"""WITH {IMG_SQL}, {interp_sql('click', 'h')}, {interp_sql('view', 'g')}
SELECT image_id, round(h.v, 4) AS "mAltitude", round(g.v, 4) AS "imuGyroMag", row_number() OVER (ORDER BY ts, image_id) - 1 AS "order"
FROM img JOIN h USING (image_id) JOIN g USING (image_id) WHERE h.v > 30 AND g.v < 60"""


@query(SLICE_SQL)
def steady_images_in_order(t):
    """Images with interpolated altitude and gyro that pass both cuts, in capture order."""
    log = lambda kind, name: t("events").where(f"event_type = '{kind}'").select("ts", c("value").alias(name))
    rows = ip.interpolate_logs(images(t).select("image_id", "ts"), [(log("click", "mAltitude"), ["mAltitude"]), (log("view", "imuGyroMag"), ["imuGyroMag"])], "ts")
    rows = od.ordered(rows.where(sc.altitude_filter(30) & sc.steady_filter(60)), ["ts"])
    return rounded(rows.select("image_id", "mAltitude", "imuGyroMag", "order"), "mAltitude", "imuGyroMag")


@query(f"WITH {IMG_SQL}, {interp_sql('click', 'h')}, {interp_sql('view', 'g')} SELECT image_id, round(h.v, 4) AS a, round(g.v, 4) AS b FROM img JOIN h USING (image_id) JOIN g USING (image_id)")
def j5_columnwise_join(t):
    log = lambda kind, name: t("events").where(f"event_type = '{kind}'").select("ts", c("value").alias(name))
    one, two = (ip.interpolate_at(images(t).select("image_id", "ts"), log(k, n), "ts", [n]).select("image_id", n) for k, n in (("click", "a"), ("view", "b")))
    return rounded(one.join(two, "image_id"), "a", "b")


@query("SELECT a.event_id AS image_id, '/b/img_' || b.event_id || '.tif' AS filepath FROM events a JOIN events b ON a.event_id = b.event_id WHERE a.event_type = 'view' AND b.value > 30")
def j6_catalogue_join(t):
    meta = t("events").selectExpr("event_id AS image_id", "CASE WHEN event_type = 'view' THEN concat('/a/img_', event_id, '.tif') END AS output_filepath")
    files = t("events").where("value > 30").selectExpr("concat('/b/img_', event_id, '.tif') AS filepath")
    return co.catalogue(meta, files).select("image_id", "filepath")


@query("SELECT o_orderkey AS image_id, round(o_totalprice - c_acctbal, 4) AS dx FROM orders JOIN customer ON c_custkey = o_custkey")
def j7_aligned_arithmetic(t):
    return rounded(t("orders").join(t("customer"), c("c_custkey") == c("o_custkey")).select(c("o_orderkey").alias("image_id"), (c("o_totalprice") - c("c_acctbal")).alias("dx")), "dx")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 2 END AS sensor_order FROM events")
def j8_map_lookup(t):
    m = F.create_map(*(F.lit(x) for k, v in {0: 1, 1: 0, 2: 2}.items() for x in (k, v)))
    return t("events").select("event_id", F.try_element_at(m, (c("event_id") % 4).cast("int")).alias("sensor_order"))


ERR_SQL = "err AS (SELECT camera_num, avg(sqrt((sensor_x - (x_min + x_max) / 2) ** 2 + (sensor_y - (y_min + y_max) / 2) ** 2)) AS mean_error FROM rect WHERE camera_num <> 2 GROUP BY camera_num)"


def centred(t: Callable) -> DataFrame:
    return rects(t).withColumns({"x_center": geo.centre(c("x_min"), c("x_max")), "y_center": geo.centre(c("y_min"), c("y_max"))})


@query(f'WITH {RECT_SQL}, {ERR_SQL} SELECT image_id, round(coalesce(mean_error, "mAltitude" * tan(radians(CASE camera_num WHEN 0 THEN 0 ELSE 30 END + 5.0))), 3) AS spatial_error FROM rect LEFT JOIN err USING (camera_num)')
def j9_camera_error(t):
    rows = centred(t)
    model = rg.fit(rows.where("camera_num <> 2"))
    return rounded(model.transform(rows, {0: 0.0, 1: 30.0, 2: 30.0}).select("image_id", "spatial_error"), "spatial_error", digits=3)


@query("SELECT coalesce(a.event_id, b.event_id) AS event_id, coalesce(a.value, b.value) AS value FROM (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN value END AS value FROM events WHERE event_type <> 'view') a FULL JOIN (SELECT event_id, -value AS value FROM events WHERE value > 30) b ON a.event_id = b.event_id")
def j10_combine_first(t):
    a = t("events").where("event_type <> 'view'").selectExpr("event_id", "CASE WHEN event_id % 3 > 0 THEN value END AS value")
    return sc.combine_first(a, t("events").where("value > 30").selectExpr("event_id", "-value AS value"), ["event_id"])


@query("SELECT event_id, event_type, value * 2 AS doubled, props FROM events")
def j11_passthrough(t):
    return sc.with_passthrough(t("events").drop("ts", "user_id"), ["event_id", "event_type", "value"], lambda df: df.select("event_id", "event_type", (c("value") * 2).alias("doubled")), ["event_id"], ["props"])


NN = "SELECT a.vec_id AS src, b.vec_id AS dst, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) ** 2))) AS d FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id"


@query(f"SELECT src, arg_min(dst, (round(d, 6), dst)) AS dst, round(min(d), 4) AS distance FROM ({NN}) GROUP BY src")
def j12_nearest_neighbour(t):
    """Stated query set: every vector whose id is divisible by 50, against all."""
    v = t("embeddings").select("vec_id", "embedding")
    return rounded(nn.nearest(v.where("vec_id % 50 = 0"), v).select("src", "dst", "distance"), "distance")


PIXEL_SQL = f"pixel AS (SELECT image_id, CAST(round_even((x_min - 0.0) / 0.5, 0) AS BIGINT) AS x_off, CAST(round_even((y_max - 2100.0) / -0.5, 0) AS BIGINT) AS y_off, CAST(round_even((x_max - x_min) / 0.5, 0) AS BIGINT) AS x_size, CAST(round_even((y_min - y_max) / -0.5, 0) AS BIGINT) AS y_size FROM rect)"


@query(f"WITH {RECT_SQL}, {PIXEL_SQL} SELECT tile_x, tile_y, count(*) AS n FROM (SELECT *, unnest(range(y_off // 64, (y_off + y_size - 1) // 64 + 1)) AS tile_y FROM (SELECT *, unnest(range(x_off // 64, (x_off + x_size - 1) // 64 + 1)) AS tile_x FROM pixel WHERE x_size > 0 AND y_size > 0 AND y_off >= 0)) GROUP BY ALL")
def j13_tile_lookup(t):
    p = mo.pixel_rectangles(rects(t), RASTER).where("y_off >= 0")
    return mo.tiles_of(p, 64).groupBy("tile_x", "tile_y").agg(F.count("*").alias("n"))


@query("SELECT coalesce(a.h, b.h) AS h, a.n AS clicks, b.n AS errors FROM (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) a FULL JOIN (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) b ON a.h = b.h")
def j14_outer_time_join(t):
    per = lambda kind, n: t("events").where(f"event_type = '{kind}'").groupBy(F.expr("CAST(date_trunc('hour', ts) AS timestamp_ntz)").alias("h")).agg(F.count("*").alias(n))
    return per("click", "clicks").join(per("error", "errors"), "h", "full_outer")


@query("SELECT DISTINCT l_returnflag, n_name FROM lineitem, nation")
def j15_grid(t):
    return sc.grid(t("lineitem").select("l_returnflag").distinct(), t("nation").select("n_name"))


# --- filters and projections ---------------------------------------------------------------------

WANT = "(mAltitude > 13000.) &(tax < 0.075)"


@query(f'WITH {RECT_SQL} SELECT image_id FROM rect WHERE "mAltitude" > 13000 AND tax < 0.075')
def f1_string_predicate(t):
    return rects(t).where(predicate.parse(WANT)).select("image_id")


@query("SELECT event_id, value > 100 AND event_type <> 'error' AS selected FROM events")
def f2_callable_filter(t):
    rows = t("events").withColumn("selected", c("event_type") != "error")
    return sc.filtered(rows, lambda df: df["value"] > 100, apply=False).select("event_id", "selected")


@query(f"WITH {RECT_SQL} SELECT image_id FROM rect WHERE tax < 0.05")
def f3_steady(t):
    return rects(t).withColumnRenamed("tax", "imuGyroMag").where(sc.steady_filter(0.05)).select("image_id")


@query(f'WITH {RECT_SQL} SELECT image_id FROM rect WHERE "mAltitude" > 13000')
def f4_altitude(t):
    return rects(t).where(sc.altitude_filter()).select("image_id")


@query("SELECT event_id, value FROM events")
def f5_output_columns(t):
    return sc.required(t("events"), ["event_id", "value"], passthrough=False)


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def f6_required_columns(t):
    return sc.required(t("events"), ["event_id"], passthrough=True)


@query("SELECT event_id, timestamp_id FROM (SELECT event_id, regexp_extract_all(url, '[0-9]+')[-1] AS timestamp_id FROM events JOIN pages ON page_id = event_id) WHERE timestamp_id IS NOT NULL")
def f8_null_keys(t):
    both = t("events").join(t("pages"), c("page_id") == c("event_id")).select("event_id", tx.last_match(c("url"), "[0-9]+").alias("timestamp_id"))
    return both.dropna(subset=["timestamp_id"])


@query(f"WITH {RECT_SQL} SELECT image_id FROM rect WHERE 500 - 100 < sensor_x AND sensor_x < 600 AND sensor_y > 50 AND sensor_y < 150")
def f9_bounding_box(t):
    return rects(t).where(predicate.parse("(400 < sensor_x < 600) & (50 < sensor_y < 150)")).select("image_id")


@query(f"WITH {RECT_SQL}, {PIXEL_SQL} SELECT count(*) AS n_out FROM pixel WHERE NOT (x_off >= 0 AND y_off >= 0 AND x_off + x_size <= 1500 AND y_off + y_size <= 4000)")
def f10_out_of_bounds(t):
    return mo.pixel_rectangles(rects(t), RASTER).where(~geo.inside(1500, 4000)).agg(F.count("*").alias("n_out"))


@query(f"""WITH {RECT_SQL}, {PIXEL_SQL} SELECT image_id, xl AS x_off, yl AS y_off, greatest(least(x_off + x_size, 1500), xl) - xl AS x_size, greatest(least(y_off + y_size, 4000), yl) - yl AS y_size
FROM (SELECT *, least(greatest(x_off, 0), 1500) AS xl, least(greatest(y_off, 0), 4000) AS yl FROM pixel)""")
def f11_trim(t):
    return mo.pixel_rectangles(rects(t), RASTER).withColumns(geo.trimmed(1500, 4000)).select("image_id", "x_off", "y_off", "x_size", "y_size")


@query(f"WITH {GREY_SQL} SELECT vec_id, len(list_filter(px, lambda v: v > 0.45 * 255)) AS bright, len(list_filter(px, lambda v: v > 0.45 * 255)) >= 40 AS ok FROM grey")
def f12_brightness(t):
    n = px.bright_count(c("px"), fraction=0.45)
    return grey(t).select("vec_id", n.alias("bright"), (n >= 40).alias("ok"))


M_SQL = "m AS (SELECT vec_id, list_transform(embedding[1:9], lambda v: CAST(v AS DOUBLE) * 4) AS m FROM embeddings)"
DET = "m[1] * (m[5] * m[9] - m[6] * m[8]) - m[2] * (m[4] * m[9] - m[6] * m[7]) + m[3] * (m[4] * m[8] - m[5] * m[7])"


def homographies(t: Callable) -> tuple[DataFrame, list]:
    df = t("embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 9), lambda v: v.cast("double") * 4).alias("m"))
    return df, [c("m")[i] for i in range(9)]


@query(f"WITH {M_SQL} SELECT vec_id, abs({DET}) > 0.6 AND abs({DET}) < 1.7 AS ok FROM m")
def f13_homography_gate(t):
    df, m = homographies(t)
    return df.select("vec_id", sc.homography_gate(m).alias("ok"))


@query(f"""WITH {M_SQL}, p AS (SELECT vec_id, m, unnest([0.0, 8.0, 8.0, 0.0]) AS x, unnest([0.0, 0.0, 8.0, 8.0]) AS y FROM m),
w AS (SELECT vec_id, (m[1] * x + m[2] * y + m[3]) / (m[7] * x + m[8] * y + m[9]) AS u, (m[4] * x + m[5] * y + m[6]) / (m[7] * x + m[8] * y + m[9]) AS v FROM p)
SELECT vec_id, min(u) >= -20 AND max(u) <= 20 AND min(v) >= -20 AND max(v) <= 20 AS ok FROM w GROUP BY vec_id""")
def f14_warp_bounds(t):
    df, m = homographies(t)
    box = geo.warped_box(m, F.lit(8.0), F.lit(8.0))
    return df.select("vec_id", ((box["x_lo"] >= -20) & (box["x_hi"] <= 20) & (box["y_lo"] >= -20) & (box["y_hi"] <= 20)).alias("ok"))


@query("SELECT event_id FROM events WHERE strftime(ts, '%H:%M:%S') BETWEEN '08:30:00' AND '17:15:00'")
def f15_time_of_day(t):
    return t("events").where(F.date_format(c("ts").cast("timestamp"), "HH:mm:ss").between("08:30:00", "17:15:00")).select("event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount BETWEEN 0.02 AND 0.06 AND l_tax BETWEEN 0 AND 0.04")
def f16_acceptance_cuts(t):
    return t("lineitem").where(sc.acceptance({"l_quantity": (10, 20), "l_discount": (0.02, 0.06), "l_tax": (0, 0.04)})).select("l_orderkey", "l_linenumber")


@query("SELECT event_id FROM events WHERE event_type = 'view' AND CAST(ts AS DATE) >= DATE '2024-01-02' AND value IS NOT NULL")
def f17_category_date(t):
    return t("events").where((c("event_type") == "view") & (c("ts").cast("date") >= F.lit("2024-01-02").cast("date")) & c("value").isNotNull()).select("event_id")


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'error')")
def f18_membership(t):
    return t("events").where(predicate.parse("event_type in ['view', 'error']")).select("event_id")


# --- aggregates ----------------------------------------------------------------------------------


@query(f"WITH {RECT_SQL} SELECT camera_num, round(avg(sqrt((sensor_x - (x_min + x_max) / 2) ** 2 + (sensor_y - (y_min + y_max) / 2) ** 2)), 4) AS mean_error FROM rect GROUP BY camera_num")
def a1_camera_mean_error(t):
    return rounded(rg.camera_errors(centred(t)), "mean_error")


@query(f"WITH {RECT_SQL} SELECT median(x_size) AS x_size, median(y_size) AS y_size, round(median(pixel_width), 4) AS pixel_width, round(median(pixel_height), 4) AS pixel_height, round(median(x_max - x_min), 4) AS width, round(median(y_max - y_min), 4) AS height FROM rect")
def a2_medians(t):
    return rounded(rg.medians(rects(t)), "pixel_width", "pixel_height", "width", "height")


EXTENT = "e AS (SELECT min(x_min) - max(padding) AS x_min, max(x_max) + max(padding) AS x_max, min(y_min) - max(padding) AS y_min, max(y_max) + max(padding) AS y_max, median(pixel_width) AS w, median(pixel_height) AS h FROM rect)"


@query(f"""WITH {RECT_SQL}, {EXTENT}, s AS (SELECT *, CAST(round_even((x_max - x_min) / w, 0) AS BIGINT) AS x_size, CAST(round_even((y_min - y_max) / h, 0) AS BIGINT) AS y_size FROM e)
SELECT round(x_min, 4) AS x_min, round(x_max, 4) AS x_max, round(y_min, 4) AS y_min, round(y_max, 4) AS y_max, x_size, y_size, round((x_max - x_min) / x_size, 4) AS pixel_width, round((y_min - y_max) / y_size, 4) AS pixel_height FROM s""")
def a3_extent(t):
    return rounded(mo.extent(rects(t)), "x_min", "x_max", "y_min", "y_max", "pixel_width", "pixel_height")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value IS NULL) AS n_null FROM events GROUP BY event_type")
def a4_counts(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(c("value").isNull()).alias("n_null"))


@query(f"WITH {RECT_SQL} SELECT round(median(sqrt((sensor_x - (x_min + x_max) / 2) ** 2 + (sensor_y - (y_min + y_max) / 2) ** 2)), 4) AS score FROM rect")
def a5_median_score(t):
    rows = rg.centre_distance(centred(t).withColumns({"x_true": c("sensor_x"), "y_true": c("sensor_y")}))
    return rounded(exact_quantiles(rows, {"score": ("score", 0.5)}), "score")


BANDS = "SELECT vec_id, i // 32 AS band, i % 32 AS i, px[i + 1] AS value FROM (SELECT vec_id, px, unnest(range(0, len(px))) AS i FROM grey)"
SIM_SQL = f"""WITH {GREY_SQL}, p AS ({BANDS}), b AS (SELECT p.vec_id, p.band, count(*) AS n, sum(p.value) AS x, sum(q.value) AS y, sum(p.value * q.value) AS xy, sum(p.value * p.value) AS xx, sum(q.value * q.value) AS yy
  FROM p JOIN p q ON q.vec_id = p.vec_id + 1 AND q.band = p.band AND q.i = p.i WHERE p.value <> 0 AND q.value <> 0 GROUP BY p.vec_id, p.band)
SELECT vec_id, round(sum(xy - x * y / n) / sqrt(sum(xx - x * x / n) * sum(yy - y * y / n)), 4) AS score FROM b GROUP BY vec_id"""


def bands(t: Callable) -> DataFrame:
    p = grey(t).select("vec_id", F.posexplode("px").alias("i", "value"))
    return p.select("vec_id", F.floor(c("i") / 32).alias("band"), (c("i") % 32).alias("i"), c("value").cast("double").alias("value"))


@query(SIM_SQL)
def a6_similarity(t):
    return rounded(mo.similarity(bands(t), bands(t).withColumn("vec_id", c("vec_id") - 1), ["vec_id"]), "score")


@query(f"WITH {GREY_SQL} SELECT vec_id, len(list_filter(px, lambda v: v > 0.03 * 255)) AS bright FROM grey")
def a7_bright_area(t):
    return grey(t).select("vec_id", px.bright_count(c("px")).alias("bright"))


@query(f"""WITH {M_SQL}, p AS (SELECT vec_id, m, unnest([0.0, 8.0, 8.0, 0.0]) AS x, unnest([0.0, 0.0, 8.0, 8.0]) AS y FROM m),
w AS (SELECT vec_id, (m[1] * x + m[2] * y + m[3]) / (m[7] * x + m[8] * y + m[9]) AS u, (m[4] * x + m[5] * y + m[6]) / (m[7] * x + m[8] * y + m[9]) AS v FROM p)
SELECT vec_id, round(min(u), 3) AS x_lo, round(max(u), 3) AS x_hi, round(min(v), 3) AS y_lo, round(max(v), 3) AS y_hi FROM w GROUP BY vec_id""")
def a8_warped_box(t):
    df, m = homographies(t)
    return rounded(df.select("vec_id", *(v.alias(k) for k, v in geo.warped_box(m, F.lit(8.0), F.lit(8.0)).items())), "x_lo", "x_hi", "y_lo", "y_hi", digits=3)


@query(f"WITH {PIX_SQL} SELECT x, y, coalesce(arg_min(r, ord) FILTER (r > 0), 0) AS r, 255 AS alpha FROM pix GROUP BY x, y")
def a9_blend(t):
    return mo.blend(contributions(t), ["r"])


@query(f"WITH {PIX_SQL} SELECT x, y, coalesce(arg_min(r, ord) FILTER (r > 0), 0) AS r, coalesce(arg_min(a, ord) FILTER (r > 0), arg_max(a, ord)) AS a FROM pix GROUP BY x, y")
def i1_blend_alpha(t):
    return mo.blend(contributions(t), ["r"], "a")


@query("SELECT user_id % 10 AS camera_num, event_type AS return_code, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id % 10), 4) AS fraction FROM events GROUP BY 1, 2")
def a10_return_codes(t):
    return rounded(hi.code_fractions(t("events").select((c("user_id") % 10).alias("camera_num"), c("event_type").alias("return_code")), ["camera_num"], "return_code"), "fraction")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.16), 4) AS p16, round(quantile_cont(value, 0.84), 4) AS p84 FROM events GROUP BY event_type")
def a11_percentiles(t):
    return rounded(hi.percentiles(t("events"), ["event_type"], "value"), "p50", "p16", "p84")


@query("SELECT event_type, round(median(value), 4) AS median_s, round(sum(value), 3) AS total_s, round(median(value) * 15000 / 3600, 1) AS hours FROM events GROUP BY event_type")
def a12_durations(t):
    return rounded(hi.durations(t("events"), ["event_type"], "value", 15000), "median_s").withColumns({"total_s": F.round("total_s", 3), "hours": F.round("hours", 1)})


@query("SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type")
def a13_distinct(t):
    return t("events").groupBy("event_type").agg(F.count_distinct("user_id").alias("n"))


@query("SELECT user_id, arg_min(event_type, event_id) AS first_type, round(avg(value), 4) AS mean FROM events GROUP BY user_id")
def a14_first_and_mean(t):
    return rounded(t("events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"), F.avg("value").alias("mean")), "mean")


@query("SELECT event_type, arg_min(event_id, (value, event_id)) AS fastest FROM events GROUP BY event_type")
def a15_argmin(t):
    return t("events").groupBy("event_type").agg(F.min_by("event_id", F.struct("value", "event_id")).alias("fastest"))


@query("SELECT least(CAST(floor(l_quantity / 5) AS BIGINT), 9) AS bin, round(sum(l_extendedprice), 2) AS weight FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1")
def a16_weighted_histogram(t):
    return hi.histogram(t("lineitem"), "l_quantity", 0, 50, 10, "l_extendedprice").withColumn("weight", F.round("weight", 2))


@query("SELECT least(CAST(floor(l_quantity / 5) AS BIGINT), 9) AS x_bin, least(CAST(floor(l_partkey / 100.0) AS BIGINT), 19) AS y_bin, round(avg(l_extendedprice), 4) AS mean FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 AND l_partkey BETWEEN 0 AND 2000 GROUP BY 1, 2")
def a17_histogram_2d(t):
    return rounded(hi.histogram_2d(t("lineitem"), ("l_quantity", 0, 50, 10), ("l_partkey", 0, 2000, 20), "l_extendedprice"), "mean")


@query(f"WITH {RECT_SQL}, {PIXEL_SQL} SELECT round(sum(x_size * y_size) * 0.25 / 1e6, 6) AS covered_km2 FROM pixel")
def a18_covered_area(t):
    return rounded(mo.pixel_rectangles(rects(t), RASTER).agg((F.sum(c("x_size") * c("y_size")) * 0.25 / 1e6).alias("covered_km2")), "covered_km2", digits=6)


# --- order, sets, samples ------------------------------------------------------------------------


@query("SELECT event_id, row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS \"order\" FROM events")
def w1_order(t):
    return od.ordered(t("events"), ["user_id", "ts"], "event_id").select("event_id", "order")


@query(f"""WITH {RECT_SQL}, q AS (SELECT image_id, camera_num, (x_min + x_max) / 2 AS x, (y_min + y_max) / 2 AS y FROM rect), f AS (SELECT arg_min(x, image_id) AS x0, arg_min(y, image_id) AS y0 FROM q),
s AS (SELECT image_id, CASE camera_num WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END AS so, sqrt((x - x0) ** 2 + (y - y0) ** 2) AS d FROM q, f)
SELECT CAST(so AS BIGINT) AS sensor_order, count(*) AS n, min(o) AS first, max(o) AS last, round(sum(d), 1) AS distance FROM (SELECT *, row_number() OVER (ORDER BY so, d, image_id) - 1 AS o FROM s) GROUP BY so""")
def w2_sensor_and_distance(t):
    rows = od.sensor_and_distance(centred(t), {0: 1, 1: 0, 2: 2})
    return rows.groupBy("sensor_order").agg(F.count("*").alias("n"), F.min("order").alias("first"), F.max("order").alias("last"), F.round(F.sum("distance_to_starting_image"), 1).alias("distance"))


@query("SELECT event_id, ts FROM events ORDER BY ts, event_id")
def w3_log_sort(t):
    return t("events").select("event_id", "ts").orderBy("ts", "event_id")


@query("SELECT event_id, value FROM events")
def w4_original_order(t):
    return od.ordered(t("events"), ["value"], "event_id").orderBy("event_id").select("event_id", "value")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r FROM events) WHERE r <= 3")
def w5_top_matches(t):
    return od.top_per_group(t("events"), ["user_id"], [c("value").asc(), c("event_id").asc()], 3).select("user_id", "event_id", "value")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def w6_head(t):
    return t("events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(25)


@query("SELECT min(CASE WHEN event_type = 'error' THEN o END) AS first_failure FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS o FROM events)")
def w7_first_failure(t):
    return mo.first_failure(od.ordered(t("events"), ["ts"], "event_id").withColumn("ok", c("event_type") != "error"))


@query("SELECT event_id, value, NULL AS user_id FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, NULL, user_id FROM events WHERE event_type = 'click'")
def u1_union_by_name(t):
    e = t("events")
    return e.where("event_type = 'view'").select("event_id", "value").unionByName(e.where("event_type = 'click'").select("event_id", "user_id"), allowMissingColumns=True)


@query(f"WITH {RECT_SQL} SELECT round(min(x_min), 4) AS x_min, round(max(x_max), 4) AS x_max FROM (SELECT * FROM rect WHERE camera_num = 0 UNION ALL SELECT * FROM rect WHERE camera_num = 1)")
def u2_union_extent(t):
    r = rects(t)
    return rounded(r.where("camera_num = 0").unionByName(r.where("camera_num = 1")).agg(F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max")), "x_min", "x_max")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def u3_difference(t):
    return t("orders").join(t("customer").where("c_mktsegment = 'BUILDING'"), c("o_custkey") == c("c_custkey"), "left_anti").select("o_orderkey")


@query("SELECT DISTINCT event_type FROM events")
def u4_unique(t):
    return t("events").select("event_type").distinct()


PICK = "md5('7:' || event_id)"


@query(f"SELECT event_id, CASE WHEN row_number() OVER (ORDER BY {PICK}, event_id) <= 500 THEN 'test' ELSE 'train' END AS part FROM events")
def u5_split(t):
    return od.split_exact(t("events"), 500, 7, "event_id").select("event_id", "part")


@query(f"SELECT event_id FROM events ORDER BY {PICK}, event_id LIMIT 300")
def u6_downsample(t):
    return od.downsample(t("events"), 300, 7, "event_id").select("event_id")


@query(f"SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY {PICK}, event_id) <= 10 THEN 'train' ELSE 'test' END AS part FROM events")
def u7_stratified(t):
    return od.stratified(t("events"), "event_type", 10, 7, "event_id").select("event_id", "part")


# --- functions -----------------------------------------------------------------------------------


@query(f"SELECT event_id, regexp_extract(p, '[^/]*$') AS name FROM (SELECT event_id, {NAME_SQL} AS p FROM events)")
def x1_basename(t):
    return named(t).select("event_id", tx.basename(c("filepath")).alias("name"))


@query("SELECT page_id, regexp_extract_all(url, '[0-9]+')[-1] AS last FROM pages")
def x2_last_match(t):
    return t("pages").select("page_id", tx.last_match(c("url"), "[0-9]+").alias("last"))


@query("SELECT event_id, date_trunc('second', ts) AS timestamp FROM events")
def x3_capture_time(t):
    e = t("events").select("event_id", F.expr(RAW).alias("obc"), F.expr("date_format(ts, 'MM-dd HH:mm:ss')").alias("odroid"))
    return e.select("event_id", tx.capture_time(c("obc"), c("odroid")).cast("timestamp_ntz").alias("timestamp"))


@query("SELECT event_id, CAST(CASE WHEN n < 0 THEN n + 4294967296 ELSE n END AS VARCHAR) AS timestamp_id FROM (SELECT event_id, event_id * 700001 % 4294967296 - 2147483648 AS n FROM events)")
def x4_unwrapped(t):
    return t("events").select("event_id", tx.unwrapped(F.expr(RAW)).alias("timestamp_id"))


@query('SELECT event_id, CASE WHEN ok THEN a - 300 END AS "TempC", CASE WHEN ok THEN a END AS pressure, CASE WHEN ok THEN a * 60 END AS "mAltitude" FROM (SELECT event_id, value AS a, value - 300 >= -273 AND value * 60 <= 20000 AS ok FROM events)')
def x5_clean_range(t):
    return t("events").select("event_id", *(v.alias(k) for k, v in tx.clean_range(c("value") - 300, c("value"), c("value") * 60).items()))


@query("SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity ** 2 + l_tax ** 2 + l_discount ** 2), 6) AS mag FROM lineitem")
def x6_norm(t):
    return rounded(t("lineitem").select("l_orderkey", "l_linenumber", geo.norm(c("l_quantity"), c("l_tax"), c("l_discount")).alias("mag")), "mag", digits=6)


@query("SELECT event_id, round(6378137.0 * radians(value / 10 - 90), 3) AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(user_id % 80) / 2)), 3) AS y FROM events")
def x7_mercator(t):
    x, y = geo.mercator(c("user_id") % 80, c("value") / 10 - 90)
    return rounded(t("events").select("event_id", x.alias("x"), y.alias("y")), "x", "y", digits=3)


def grid_sql(table: str, lon: str, lat: str, meridian: int) -> str:
    """Rows of a table with east and north of a point in a zone's grid, as DuckDB SQL."""
    e, steps = pr.ECCENTRICITY, list(enumerate(pr.TO_GRID, 1))
    return f"""(SELECT *, 500000 + {pr.MERIDIAN!r} * (eta + {" + ".join(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in steps)}) AS east,
      {pr.MERIDIAN!r} * (xi + {" + ".join(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in steps)}) AS north
    FROM (SELECT *, atan2(t, cos(away)) AS xi, atanh(sin(away) / sqrt(1 + t * t)) AS eta
    FROM (SELECT *, sinh(atanh(sin(phi)) - {e!r} * atanh({e!r} * sin(phi))) AS t FROM (SELECT *, radians(CAST({lat} AS DOUBLE)) AS phi, radians(CAST({lon} AS DOUBLE) - {meridian}) AS away FROM {table}))))"""


@query(f"SELECT event_id, round(east, 3) AS east, round(north, 3) AS north, round(CAST(value / 100 AS DOUBLE), 8) AS lon, CAST(user_id % 80 AS DOUBLE) AS lat FROM {grid_sql('events', 'value / 100', 'user_id % 80', 3)}")
def x7_transverse(t):
    """Points in zone 31, to the millimetre, and back in degrees."""
    df = t("events").select("event_id", (c("value") / 100).alias("lon"), (c("user_id") % 80).cast("double").alias("lat"))
    east, north = pr.transformed("EPSG:4326", "EPSG:32631", c("lon"), c("lat"))
    df = df.select("event_id", east.alias("east"), north.alias("north"))
    lon, lat = pr.transformed("EPSG:32631", "EPSG:4326", c("east"), c("north"))
    df = df.select("event_id", "east", "north", lon.alias("lon"), lat.alias("lat"))
    return rounded(rounded(df, "east", "north", digits=3), "lon", "lat", digits=8)


EDGE_SQL = "(SELECT vec_id, CASE side WHEN 0 THEN x_min + k / 8.0 * (x_max - x_min) WHEN 1 THEN x_max WHEN 2 THEN x_max - k / 8.0 * (x_max - x_min) ELSE x_min END AS px, CASE side WHEN 0 THEN y_min WHEN 1 THEN y_min + k / 8.0 * (y_max - y_min) WHEN 2 THEN y_max ELSE y_max - k / 8.0 * (y_max - y_min) END AS py FROM box, range(0, 8) AS a(k), range(0, 4) AS b(side))"
DEGREES = {"x_min": "CAST(vec_id % 300 AS DOUBLE) / 50 - 90", "x_max": "CAST(vec_id % 300 AS DOUBLE) / 50 - 89", "y_min": "CAST(vec_id % 70 AS DOUBLE)", "y_max": "CAST(vec_id % 70 AS DOUBLE) + 2"}


@query(f"WITH box AS (SELECT vec_id, {', '.join(f'{e} AS {n}' for n, e in DEGREES.items())} FROM embeddings) SELECT vec_id, round(min(east), 3) AS x_min, round(max(east), 3) AS x_max, round(min(north), 3) AS y_min, round(max(north), 3) AS y_max FROM {grid_sql(EDGE_SQL, 'px', 'py', -87)} GROUP BY vec_id")
def x8_transverse_bounds(t):
    """Bounds in degrees as bounds in zone 16, whose sides are curves."""
    df = t("embeddings").selectExpr("vec_id", *(f"{e} AS {n}" for n, e in DEGREES.items()))
    return rounded(df.select("vec_id", *(v.alias(k) for k, v in geo.reprojected("EPSG:4326", "EPSG:32616").items())), "x_min", "x_max", "y_min", "y_max", digits=3)


@query("SELECT event_id, ts - INTERVAL 5 HOUR AS ts FROM events")
def x9_shifted(t):
    return t("events").select("event_id", tx.shifted(c("ts").cast("timestamp"), 5).cast("timestamp_ntz").alias("ts"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice + 5.0 * l_quantity, 4) AS x_max, round(l_partkey - 5.0 * l_quantity, 4) AS y_min FROM lineitem")
def x10_bounds(t):
    x, y = geo.bounds_of(c("l_extendedprice"), c("l_partkey"), F.lit(5.0), F.lit(-5.0), c("l_quantity"), c("l_quantity"))
    return rounded(t("lineitem").select("l_orderkey", "l_linenumber", x.alias("x_max"), y.alias("y_min")), "x_max", "y_min")


@query(f"WITH {RECT_SQL} SELECT image_id, round((x_min + x_max) / 2, 4) AS x_center, round(0.1 * sqrt((x_max - x_min) ** 2 + (y_max - y_min) ** 2), 4) AS padding FROM rect")
def x11_centre_padding(t):
    r = rects(t)
    return rounded(r.select("image_id", geo.centre(c("x_min"), c("x_max")).alias("x_center"), geo.padding(c("x_min"), c("x_max"), c("y_min"), c("y_max"), 0.1).alias("padding")), "x_center", "padding")


@query(f"WITH {RECT_SQL}, {PIXEL_SQL} SELECT * FROM pixel")
def x12_to_pixels(t):
    return mo.pixel_rectangles(rects(t), RASTER).select("image_id", "x_off", "y_off", "x_size", "y_size")


@query(f"WITH {RECT_SQL}, {PIXEL_SQL} SELECT image_id, CAST(x_off AS DOUBLE) / 2 AS x_min, CAST(x_off + x_size AS DOUBLE) / 2 AS x_max, 2100 - CAST(y_off AS DOUBLE) / 2 AS y_max, 2100 - CAST(y_off + y_size AS DOUBLE) / 2 AS y_min FROM pixel")
def x13_to_bounds(t):
    p = mo.pixel_rectangles(rects(t), RASTER).select("image_id", "x_off", "y_off", "x_size", "y_size")
    return p.select("image_id", *(v.alias(k) for k, v in geo.to_bounds(RASTER).items()))


@query(f"WITH {RECT_SQL} SELECT image_id, round(x_min - padding, 4) AS x_min, round(x_max + padding, 4) AS x_max, round(y_min - padding, 4) AS y_min, round(y_max + padding, 4) AS y_max FROM rect")
def x14_search_zone(t):
    return rounded(rects(t).select("image_id", *(v.alias(k) for k, v in geo.search_zone(c("padding")).items())), "x_min", "x_max", "y_min", "y_max")


@query(f"WITH {RECT_SQL} SELECT image_id, round(sqrt((sensor_x - (x_min + x_max) / 2) ** 2 + (sensor_y - (y_min + y_max) / 2) ** 2), 4) AS score FROM rect")
def x15_centre_distance(t):
    return rounded(rg.centre_distance(centred(t).withColumns({"x_true": c("sensor_x"), "y_true": c("sensor_y")})).select("image_id", "score"), "score")


REG_SQL = f"WITH {RECT_SQL}, f AS (SELECT median(x_max - x_min) / 2 AS w, median(y_max - y_min) / 2 AS h FROM rect), {ERR_SQL}"


@query(REG_SQL + " SELECT image_id, round(sensor_x - w, 4) AS x_min, round(sensor_x + w, 4) AS x_max, round(sensor_y - h, 4) AS y_min, round(sensor_y + h, 4) AS y_max FROM rect, f")
def x16_sensor_bounds(t):
    rows = centred(t)
    return rounded(rg.fit(rows).transform(rows, {0: 0.0, 1: 30.0, 2: 30.0}).select("image_id", "x_min", "x_max", "y_min", "y_max"), "x_min", "x_max", "y_min", "y_max")


@query(f'WITH {RECT_SQL} SELECT image_id, round("mAltitude" * tan(radians(35.0)), 4) AS spatial_error FROM rect')
def x17_error_radius(t):
    return rounded(rects(t).select("image_id", geo.error_radius(c("mAltitude"), F.lit(30.0), 5.0).alias("spatial_error")), "spatial_error")


@query(f"WITH {RECT_SQL} SELECT image_id, round(a.x_min - b.sensor_x, 4) AS x_min_diff, round(a.x_max - b.sensor_x, 4) AS x_max_diff, round(0.5 * sqrt((a.x_min + a.x_max - 2 * b.sensor_x) ** 2 + (a.y_min + a.y_max - 2 * b.sensor_y) ** 2), 4) AS center_diff FROM rect a JOIN rect b USING (image_id)")
def x18_bound_differences(t):
    r = rects(t)
    true = r.select("image_id", *(F.col("sensor_x").alias(n) for n in ("x_min", "x_max")), *(F.col("sensor_y").alias(n) for n in ("y_min", "y_max")), "x_size", "y_size")
    return rounded(sc.geometric_differences(r, true).select("image_id", "x_min_diff", "x_max_diff", "center_diff"), "x_min_diff", "x_max_diff", "center_diff")


@query(f"WITH {GREY_SQL} SELECT vec_id, list_transform(px, lambda v: CASE WHEN v <= 114 THEN 0 ELSE v END) AS px FROM grey")
def x19_clean(t):
    return grey(t).select("vec_id", px.cleaned(c("px"), fraction=0.45).alias("px"))


@query(f"WITH {GREY_SQL} SELECT vec_id, list_transform(px, lambda v: CAST(trunc(log10(v + 1.0) * 255 / log10(256.0)) AS INT)) AS px FROM grey")
def x20_log_scale(t):
    return grey(t).select("vec_id", px.log_scaled(c("px")).alias("px"))


@query(f"WITH {GREY_SQL} SELECT vec_id, list_transform(px, lambda v: CAST(trunc(log10(CASE WHEN v <= 114 THEN 0 ELSE v END + 1.0) * 255 / log10(256.0)) AS INT)) AS px FROM grey")
def x21_chain(t):
    return grey(t).select("vec_id", px.chained(lambda p: px.cleaned(p, fraction=0.45), px.log_scaled)(c("px")).alias("px"))


@query(f"WITH {GREY_SQL} SELECT vec_id, list_transform(px, lambda v: CAST(trunc(v / 255 * 4095) AS INT)) AS px FROM grey")
def x22_rescale(t):
    return grey(t).select("vec_id", px.rescaled(c("px"), 255, 4095).alias("px"))


@query(f"WITH {PIX_SQL} SELECT vec_id, i, CASE WHEN r > 0 THEN 255 ELSE 0 END AS alpha FROM pix")
def x23_alpha(t):
    return contributions(t).select("vec_id", c("i").cast("long").alias("i"), px.alpha(c("r")).alias("alpha"))


@query("SELECT event_id, round((value - 10) / 490.0 * 99, 6) AS px, round(10 + event_id % 100 * 490.0 / 99, 6) AS x FROM events")
def x24_edge_axis(t):
    lo, hi_, n = F.lit(10.0), F.lit(500.0), F.lit(100)
    return rounded(t("events").select("event_id", geo.edge_pixels(c("value"), lo, hi_, n).alias("px"), geo.edge_coordinates(c("event_id") % 100, lo, hi_, n).alias("x")), "px", "x", digits=6)


@query("SELECT n_nationkey, i, round(n_nationkey + i * 10.0 / 4, 4) AS x FROM nation, range(5) AS r(i)")
def x25_axes(t):
    e = t("nation").select("n_nationkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("i"))
    return rounded(e.withColumn("x", geo.edge_coordinates(c("i"), c("n_nationkey"), c("n_nationkey") + 10.0, F.lit(5))), "x")


@query(f"WITH {M_SQL} SELECT vec_id, round((m[1] * 3 + m[2] * 2 + m[3]) / (m[7] * 3 + m[8] * 2 + m[9]), 3) AS u, round((m[4] * 3 + m[5] * 2 + m[6]) / (m[7] * 3 + m[8] * 2 + m[9]), 3) AS v FROM m")
def x26_warp_point(t):
    df, m = homographies(t)
    u, v = geo.warp_point(m, F.lit(3.0), F.lit(2.0))
    return rounded(df.select("vec_id", u.alias("u"), v.alias("v")), "u", "v", digits=3)


@query(f"WITH {M_SQL} SELECT vec_id, round({DET}, 6) AS det FROM m")
def x27_determinant(t):
    df, m = homographies(t)
    return rounded(df.select("vec_id", geo.determinant(m).alias("det")), "det", digits=6)


@query(f"WITH {M_SQL} SELECT vec_id, round(abs(log10(abs({DET}))), 4) AS factor FROM m")
def x28_warp_factor(t):
    df, m = homographies(t)
    return rounded(df.select("vec_id", F.abs(F.log10(F.abs(geo.determinant(m)))).alias("factor")), "factor")


@query("SELECT event_id, round(sqrt((value - 100) ** 2 + (user_id - 50) ** 2), 4) AS r, round(degrees(atan2(user_id - 50, value - 100)), 4) AS theta FROM events")
def x29_polar(t):
    r, theta = geo.polar(c("value") - 100, c("user_id") - 50)
    return rounded(t("events").select("event_id", r.alias("r"), theta.alias("theta")), "r", "theta")


@query("SELECT event_id, round(44330.8 * (1 - pow((value + 500) / 1013.25, 0.190263)), 3) AS height FROM events")
def x30_barometric(t):
    return rounded(t("events").select("event_id", geo.barometric_height(c("value") + 500).alias("height")), "height", digits=3)


@query("SELECT event_id, round(value * 0.3048, 4) AS metres, CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) END AS time FROM events")
def x31_units_and_dates(t):
    raw = F.when(c("event_type") == "error", "bad").otherwise(F.expr("date_format(ts, 'yyyy-MM-dd HH:mm:ss')"))
    return t("events").select("event_id", F.round(c("value") * 0.3048, 4).alias("metres"), F.try_to_timestamp(raw, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("time"))


@query("SELECT e.event_id, h.w AS nearest FROM (SELECT event_id, least(greatest(CAST(floor(value / 50) AS BIGINT), 0), 9) AS bin FROM events) e JOIN (SELECT bin, sum(v) AS w FROM (SELECT least(CAST(floor(l_quantity / 5) AS BIGINT), 9) AS bin, l_quantity AS v FROM lineitem) GROUP BY bin) h USING (bin)")
def x32_nearest_bin(t):
    h = hi.histogram(t("lineitem"), "l_quantity", 0, 50, 10, "l_quantity")
    return hi.nearest_bin(t("events").select("event_id", "value"), "value", h, 0, 500, 10).select("event_id", c("weight").alias("nearest"))


# --- image pipelines -----------------------------------------------------------------------------


@query("SELECT event_id, coalesce(CASE WHEN event_type = 'view' THEN value END, CASE WHEN value > 100 THEN -value END, 0) AS result FROM events")
def i4_operator_queue(t):
    return t("events").select("event_id", sc.first_success(F.when(c("event_type") == "view", c("value")), F.when(c("value") > 100, -c("value")), F.lit(0.0)).alias("result"))


@query(f"WITH {M_SQL}, {GREY_SQL} SELECT vec_id, CASE WHEN len(list_filter(px, lambda v: v > 0.45 * 255)) < 20 THEN 'dark_frame' WHEN NOT (abs({DET}) > 0.6 AND abs({DET}) < 1.7) THEN 'bad_det' ELSE 'success' END AS return_code FROM m JOIN grey USING (vec_id)")
def i8_return_codes(t):
    df, m = homographies(t)
    both = df.join(grey(t), "vec_id")
    return both.select("vec_id", sc.return_code({"dark_frame": px.bright_count(c("px"), fraction=0.45) < 20, "bad_det": ~sc.homography_gate(m)}).alias("return_code"))


@query(SIM_SQL.replace("SELECT vec_id, round(", "SELECT vec_id, CASE WHEN vec_id % 4 > 0 THEN round(").replace(", 4) AS score", ", 4) END AS score"))
def i12_score_successes(t):
    s = mo.similarity(bands(t), bands(t).withColumn("vec_id", c("vec_id") - 1), ["vec_id"])
    return rounded(s.withColumn("score", F.when(c("vec_id") % 4 > 0, c("score"))), "score")


@query(f"WITH {RECT_SQL} SELECT a.image_id, round(b.x_min - a.x_min, 4) AS x_min_diff, b.x_size - a.x_size AS x_size_diff FROM rect a LEFT JOIN (SELECT image_id, x_min - 1 AS x_min, x_size FROM rect WHERE camera_num > 0) b USING (image_id)")
def i13_geometric_scores(t):
    r = rects(t)
    true = r.where("camera_num > 0").withColumn("x_min", c("x_min") - 1)
    return rounded(sc.geometric_differences(true, r, how="right").select("image_id", "x_min_diff", "x_size_diff"), "x_min_diff")


@query(SIM_SQL.replace("SELECT vec_id, round(", "SELECT vec_id, (").replace(", 4) AS score", ") > 0.99 AS same"))
def i14_same_image(t):
    s = mo.similarity(bands(t), bands(t).withColumn("vec_id", c("vec_id") - 1), ["vec_id"])
    return s.select("vec_id", (c("score") > 0.99).alias("same"))


@query(REG_SQL + ' SELECT camera_num, count(*) AS n, round(avg(coalesce(mean_error, "mAltitude" * tan(radians(35.0)))), 3) AS spatial_error, round(avg(1.5 * coalesce(mean_error, "mAltitude" * tan(radians(35.0)))), 3) AS padding FROM rect LEFT JOIN err USING (camera_num) GROUP BY camera_num')
def i18_registrar(t):
    rows = centred(t)
    out = rg.fit(rows.where("camera_num <> 2")).transform(rows, {0: 30.0, 1: 30.0, 2: 30.0})
    return rounded(out.groupBy("camera_num").agg(F.count("*").alias("n"), F.avg("spatial_error").alias("spatial_error"), F.avg("padding").alias("padding")), "spatial_error", "padding", digits=3)


@query(f"WITH {RECT_SQL}, p AS (SELECT image_id, x_min, y_max, round_even(x_min / 0.5, 0) AS x_off, round_even((y_max - 2100.0) / -0.5, 0) AS y_off FROM rect) SELECT image_id, abs(x_off * 0.5 - x_min) <= 0.25 + 1e-9 AND abs(2100 - y_off * 0.5 - y_max) <= 0.25 + 1e-9 AS near FROM p")
def i19_round_trip(t):
    p = mo.pixel_rectangles(rects(t), RASTER)
    back = geo.to_bounds(RASTER)
    return p.select("image_id", ((F.abs(back["x_min"] - c("x_min")) <= 0.25 + 1e-9) & (F.abs(back["y_max"] - c("y_max")) <= 0.25 + 1e-9)).alias("near"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n_before FROM events")
def i15_ordered_progress(t):
    return mo.running(od.ordered(t("events"), ["ts"], "event_id", by=["user_id"]), ["user_id"]).select("event_id", "n_before")


