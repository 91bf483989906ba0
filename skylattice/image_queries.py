"""Registered queries of sources, sinks and image kernels: what is written is read back, what is computed has a known answer.

``embeddings`` are 8 x 8 images of one band; each is a file of its own in a folder by label.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions import dictionary, geo
from .operators import features, image_ops, kernels, mosaic as mo, order as od, sequential as sq, tiles as ti
from .operators.graph import shared_folder
from .plans import batches, stages
from .queries import GREY_SQL, M_SQL, ORACLE_SQL, PIX_SQL, QUERIES, RECT_SQL, contributions, grey, homographies, query, rects, rounded
from .sources import files as fs, hdf5, sinks
from .sources.tiff_source import register
from .streaming import incremental, mosaics as streamed

c = F.col
#: Bytes of pictures that a task hands on at once.
HANDED_ON = 4 << 20
_written: dict[tuple[str, int, str], str] = {}


def scratch(df: DataFrame) -> str:
    """A new folder that all executors reach."""
    return f"{shared_folder(df.sparkSession).rstrip('/')}/queries/{uuid.uuid4().hex}"


NAME = "concat('img', pmod(vec_id, 3), '/v', vec_id, '.tif')"
NAME_SQL = "'img' || vec_id % 3 || '/v' || vec_id || '.tif'"
BOX = {"x_min": "CAST(vec_id AS DOUBLE) / 100 - 90", "x_max": "CAST(vec_id AS DOUBLE) / 100 - 88", "y_min": "CAST(vec_id % 400 AS DOUBLE) / 10", "y_max": "CAST(vec_id % 400 AS DOUBLE) / 10 + 4"}
BOX_SQL = "box AS (SELECT vec_id, px, " + ", ".join(f"{e} AS {n}" for n, e in BOX.items()) + " FROM grey)"
HEX_SQL = "array_to_string(list_transform(px, lambda v: printf('%02X', v)), '')"


def images(t: Callable) -> DataFrame:
    """The grey images as bytes, with names and bounds in degrees."""
    data = F.unhex(F.array_join(F.transform("px", lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    eight = F.lit(8).cast("long")
    return grey(t).select("vec_id", F.expr(NAME).alias("name"), eight.alias("rows"), eight.alias("columns"), F.lit(1).cast("long").alias("bands"), data.alias("data"), *(F.expr(e).alias(n) for n, e in BOX.items()))


def stored(t: Callable) -> tuple[SparkSession, str]:
    """The folder of the image files, written once for a table and session."""
    df = images(t)
    spark, source = df.sparkSession, t("embeddings").inputFiles()[0]
    key = (spark.sparkContext.applicationId, id(spark), source)
    if key not in _written:
        folder = scratch(df)
        sinks.save_images(df, folder).agg(F.sum("bytes")).collect()
        _written[key] = folder
    return spark, _written[key]


def content(t: Callable) -> DataFrame:
    spark, folder = stored(t)
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)


def short(path: str = "filepath") -> Column:
    return F.regexp_extract(path, "[^/]+/[^/]+$", 0)


def vec() -> Column:
    return F.regexp_extract("filepath", r"v(\d+)\.tif$", 1).cast("long")


def scenes(t: Callable) -> DataFrame:
    """Pictures (image_id, data: 96 x 112 bytes) of 42 images each, side by side and twice as large."""
    held = images(t).groupBy(F.floor(c("vec_id") / 42).alias("image_id")).agg(F.sort_array(F.collect_list(F.struct("vec_id", F.hex("data").alias("h")))).alias("parts")).where("size(parts) = 42")
    held = held.select("image_id", F.unhex(F.array_join("parts.h", "")).alias("data"))  # bytes, as lists of numbers take many times as much in a task

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for p in batches:
            for r in p.itertuples():
                grid = np.frombuffer(r.data, np.uint8).reshape(6, 7, 8, 8).swapaxes(1, 2).reshape(48, 56, 1)
                yield r.image_id, kernels.resize(grid.astype(float), 96, 112).round().astype(np.uint8).tobytes()

    return held.mapInPandas(lambda batches: fs.in_parts(drawn(batches), ["image_id", "data"], HANDED_ON), "image_id long, data binary")


def scene(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(96, 112, 1)


SCENE_SQL = "SELECT vec_id // 42 AS image_id, (vec_id // 42) * 7 % 30 AS x, (vec_id // 42) * 5 % 20 AS y FROM embeddings GROUP BY 1 HAVING count(*) = 42"


def shifted(t: Callable) -> DataFrame:
    """The scenes, and for each a place (x, y) of a piece of it."""
    return scenes(t).withColumns({"x": c("image_id") * 7 % 30, "y": c("image_id") * 5 % 20})


# --- sources -------------------------------------------------------------------------------------


@query(f"SELECT {NAME_SQL} AS name FROM embeddings")
def s1_file_walk(t):
    return fs.find_files(*stored(t)).select(short().alias("name"))


@query(f"SELECT row_number() OVER (ORDER BY {NAME_SQL}) - 1 AS file_id, {NAME_SQL} AS name FROM embeddings WHERE vec_id % 3 = 1 AND (vec_id % 10) IN (3, 5)")
def s3_selected_files(t):
    return fs.find_selected_files(*stored(t), [r"3\.tif", r"5\.tif"], "/img1/").select("file_id", short().alias("name"))


@query(f"SELECT {NAME_SQL} AS name FROM embeddings WHERE vec_id % 3 = 2")
def s4_described_files(t):
    spark, folder = stored(t)
    root, _, last = folder.rpartition("/")
    return fs.find_input_files(spark, {"directory": last, "extension": r"\.tif", "pattern": "img2"}, root).select(short().alias("name"))


@query(f"SELECT {NAME_SQL} AS name FROM embeddings WHERE vec_id % 3 = 0 AND CAST(vec_id AS VARCHAR) LIKE '1%' UNION ALL SELECT {NAME_SQL} FROM embeddings WHERE vec_id % 3 = 0 AND vec_id % 10 = 2")
def s5_globs(t):
    return fs.discover_directory(*stored(t), ["v1*.tif", "*2.tif"], "/img0/").select(short().alias("name"))


@query(f"WITH {GREY_SQL}, {BOX_SQL} SELECT vec_id, round(x_min, 6) AS x_min, round(x_max, 6) AS x_max, round(y_min, 6) AS y_min, round(y_max, 6) AS y_max, round((x_max - x_min) / 8, 6) AS pixel_width, round((y_min - y_max) / 8, 6) AS pixel_height, 8 AS x_size, 8 AS y_size, round((x_min + x_max) / 2, 6) AS x_center, round((y_min + y_max) / 2, 6) AS y_center, round(0.1 * sqrt((x_max - x_min) ** 2 + (y_max - y_min) ** 2), 6) AS padding FROM box")
def s10_headers(t):
    names = ["x_min", "x_max", "y_min", "y_max", "pixel_width", "pixel_height", "x_center", "y_center", "padding"]
    return rounded(fs.geotiff_headers(content(t)).select(vec().alias("vec_id"), *names, "x_size", "y_size"), *names, digits=6)


@query(f"WITH {GREY_SQL} SELECT vec_id, 8 AS n_rows, 8 AS n_columns, 1 AS n_bands, {HEX_SQL} AS data FROM grey")
def s11_plain_images(t):
    return fs.load_images(content(t)).select(vec().alias("vec_id"), c("rows").alias("n_rows"), c("columns").alias("n_columns"), c("bands").alias("n_bands"), F.hex("data").alias("data"))


@query(f"WITH {GREY_SQL} SELECT vec_id, array_to_string(list_transform(px, lambda v: printf('%02X%02X', v, v)), '') AS data FROM grey")
def s11_rescaled_images(t):
    """From 8 to 16 bits: 255 becomes 65535."""
    return fs.load_images(content(t), kind="<u2").select(vec().alias("vec_id"), F.hex("data").alias("data"))


#: A mirrored place on a side of eight.
MIRROR = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 7 THEN 14 - ({0}) ELSE {0} END"


@query(f"""WITH {GREY_SQL}, near AS (
  SELECT vec_id, y, x, band, px[({MIRROR.format("y + dy")}) * 8 + {MIRROR.format("x + dx")} + 1] * 16 AS v, CASE WHEN band = 1 AND (y + x) % 2 = 1 THEN CAST(dy = 0 AND dx = 0 AS INT) WHEN band = 1 THEN 1 - abs(dy * dx) ELSE (2 - abs(dy)) * (2 - abs(dx)) END AS w
  FROM grey, range(0, 8) AS a(y), range(0, 8) AS b(x), range(0, 3) AS c(band), range(-1, 2) AS d(dy), range(-1, 2) AS e(dx)
  WHERE CASE band WHEN 0 THEN (y + dy) % 2 = 0 AND (x + dx) % 2 = 0 WHEN 1 THEN abs((y + dy) + (x + dx)) % 2 = 1 ELSE abs((y + dy) % 2) = 1 AND abs((x + dx) % 2) = 1 END
)
SELECT vec_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(band AS INT) AS band, CAST(floor(v / 4095 * 255) AS INT) AS v FROM (SELECT vec_id, y, x, band, CAST(sum(w * v) AS DOUBLE) / sum(w) AS v FROM near WHERE w > 0 GROUP BY ALL)""")
def s11_raw_images(t):
    """Sensor frames of 12 bits, written as raw files and read as RGB with colours interpolated."""
    frame = F.unhex(F.array_join(F.transform("px", lambda v: F.concat(F.lpad(F.hex((v * 16) % 256), 2, "0"), F.lpad(F.hex(F.floor(v * 16 / 256)), 2, "0"))), ""))
    df = grey(t).select("vec_id", frame.alias("data"))
    folder = scratch(df)

    def store(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for r in p.itertuples():
                sinks.write_file(f"{folder}/v{r.vec_id}.raw", r.data)
            yield p[["vec_id"]]

    df.mapInPandas(store, "vec_id long").agg(F.count("*")).collect()
    back = fs.load_images(df.sparkSession.read.format("binaryFile").load(folder), (8, 8))
    values = F.transform(F.sequence(F.lit(0), F.lit(191)), lambda i: F.conv(F.hex(F.substr("data", i + 1, F.lit(1))), 16, 10).cast("int"))
    out = back.select(F.regexp_extract("filepath", r"v(\d+)\.raw$", 1).cast("long").alias("vec_id"), F.posexplode(values).alias("i", "v"))
    place = {"y": F.floor(c("i") / 24), "x": F.floor(c("i") / 3) % 8, "band": c("i") % 3}
    return out.select("vec_id", *(e.cast("int").alias(n) for n, e in place.items()), "v")


@query(f"WITH {GREY_SQL}, {BOX_SQL} SELECT vec_id, {HEX_SQL} AS data, round(x_min, 6) AS x_min, round(x_max, 6) AS x_max, round(y_min, 6) AS y_min, round(y_max, 6) AS y_max FROM box")
def s12_referenced_images(t):
    return rounded(fs.load_referenced(content(t)).select(vec().alias("vec_id"), F.hex("data").alias("data"), "x_min", "x_max", "y_min", "y_max"), "x_min", "x_max", "y_min", "y_max", digits=6)


WEB_SQL = "round(6378137.0 * radians(x_min), 2) AS x_min, round(6378137.0 * radians(x_max), 2) AS x_max, round(6378137.0 * ln(tan(pi() / 4 + radians(y_min) / 2)), 2) AS y_min, round(6378137.0 * ln(tan(pi() / 4 + radians(y_max) / 2)), 2) AS y_max"


@query(f"""WITH {GREY_SQL}, {BOX_SQL}, e AS (SELECT *, ln(tan(pi() / 4 + radians(y_min) / 2)) AS lo, ln(tan(pi() / 4 + radians(y_max) / 2)) AS hi FROM box),
r AS (SELECT *, unnest(range(0, 8)) AS i FROM e), p AS (SELECT *, least(greatest((y_max - degrees(2 * atan(exp(hi - (i + 0.5) * (hi - lo) / 8)) - pi() / 2)) / (y_max - y_min) * 8 - 0.5, 0), 7) AS y FROM r),
q AS (SELECT *, CAST(floor(y) AS BIGINT) AS j, y - floor(y) AS f FROM p)
SELECT vec_id, {WEB_SQL}, round(sum((1 - f) * px[8 * j + 1] + f * px[8 * least(j + 1, 7) + 1]), 0) AS column_sum FROM q GROUP BY ALL""")
def s13_reprojected_images(t):
    """Bounds in metres, and the first column of the resampled pixels, summed before they are rounded."""
    df = fs.load_referenced(content(t), "EPSG:4326", "EPSG:3857").select(vec().alias("vec_id"), "x_min", "x_max", "y_min", "y_max")
    box = images(t).select("vec_id", "data", *(c(n).alias(f"s_{n}") for n in sinks.BOUNDS))

    def first_column(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = [kernels.reprojected(np.frombuffer(r.data, np.uint8).reshape(8, 8, 1).astype(float), [r.s_x_min, r.s_x_max, r.s_y_min, r.s_y_max], "EPSG:4326", "EPSG:3857")[0][:, 0].sum() for r in p.itertuples()]
            yield pd.DataFrame({"vec_id": p["vec_id"], "column_sum": out})

    sums = box.mapInPandas(first_column, "vec_id long, column_sum double")
    return rounded(rounded(df.join(sums, "vec_id"), "x_min", "x_max", "y_min", "y_max", digits=2), "column_sum", digits=0)


def tiled(t: Callable) -> tuple[SparkSession, str]:
    """The folder of the scenes' raw grids, as files of 16 x 16 tiles, LZW, with differences."""
    df = raw_scenes(t)
    size = {"rows": F.lit(48).cast("long"), "columns": F.lit(56).cast("long"), "bands": F.lit(1).cast("long")}
    box = {"x_min": c("image_id") * 100.0, "x_max": c("image_id") * 100.0 + 112, "y_min": F.lit(0.0), "y_max": F.lit(96.0)}
    df = df.withColumn("name", F.concat(F.lit("scene"), c("image_id").cast("string"), F.lit(".tif"))).withColumns(size | box)
    folder = scratch(df)
    sinks.save_images(df, folder, 16, "lzw", True).agg(F.sum("bytes")).collect()
    register(df.sparkSession)
    return df.sparkSession, folder


def raw_scenes(t: Callable) -> DataFrame:
    """(image_id, data: 48 x 56 bytes): 42 images each, side by side."""
    held = grey(t).groupBy(F.floor(c("vec_id") / 42).alias("image_id")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "px"))).alias("parts")).where("size(parts) = 42")
    at = lambda i: f"parts[int((i div 56) div 8) * 7 + int((i % 56) div 8)].px[int((i div 56) % 8) * 8 + int((i % 56) % 8)]".replace("i ", f"{i} ")
    data = F.expr(f"unhex(array_join(transform(sequence(0, 48 * 56 - 1), i -> lpad(hex({at('i')}), 2, '0')), ''))")
    return held.select("image_id", data.alias("data"))


def scene_id() -> Column:
    return F.regexp_extract("filepath", r"scene(\d+)\.tif$", 1).cast("long").alias("image_id")


@query(f"SELECT image_id, CAST(100 * image_id AS DOUBLE) AS x_min, CAST(96 AS DOUBLE) AS y_max, CAST(2 AS DOUBLE) AS pixel_width, 56 AS x_size, 48 AS y_size, 16 AS block_columns, true AS few_bytes FROM ({SCENE_SQL})")
def s10_tiff_source(t):
    """Headers through the data source: each file costs less than 64 kB, whatever it holds."""
    spark, folder = tiled(t)
    df = spark.read.format("tiff").load(folder)
    return df.select(scene_id(), "x_min", "y_max", "pixel_width", "x_size", "y_size", "block_columns", (c("bytes_read") < 1 << 16).alias("few_bytes"))


#: A window of the tiled scenes, and the tiles under it.
WINDOW = (18, 5, 20, 14)


@query(f"""WITH {GREY_SQL}, scene AS (SELECT image_id FROM ({SCENE_SQL}))
SELECT image_id, x, y, px[y % 8 * 8 + x % 8 + 1] AS v FROM scene, range({WINDOW[0]}, {WINDOW[0] + WINDOW[2]}) AS a(x), range({WINDOW[1]}, {WINDOW[1] + WINDOW[3]}) AS b(y)
JOIN grey ON vec_id = image_id * 42 + y // 8 * 7 + x // 8""")
def s17_tiff_window(t):
    """Only the tiles under a window of each file are read."""
    spark, folder = tiled(t)
    x, y, w, h = WINDOW
    df = spark.read.format("tiff").option("rows", "blocks").option("window", f"{x},{y},{w},{h}").load(folder)
    bytes_of = F.transform(F.sequence(F.lit(0), F.octet_length("data") - 1), lambda i: F.conv(F.hex(F.substr("data", i + 1, F.lit(1))), 16, 10).cast("int"))
    df = df.select(scene_id(), "x_off", "y_off", "columns", F.posexplode(bytes_of).alias("i", "v"))
    df = df.select("image_id", (c("x_off") + c("i") % c("columns")).alias("x"), (c("y_off") + F.floor(c("i") / c("columns"))).alias("y"), "v")
    return df.where(c("x").between(x, x + w - 1) & c("y").between(y, y + h - 1))


@query(f"""WITH {GREY_SQL}, scene AS (SELECT image_id FROM ({SCENE_SQL}))
SELECT image_id, y // 16 * 16 AS y_off, x // 16 * 16 AS x_off, round(10.0 * (image_id % 36) - 180 + x // 16 * 16 * 10 / 56.0, 6) AS x_min, round(90 - 10.0 * (image_id % 18) - y // 16 * 16 * 10 / 56.0, 6) AS y_max, CAST(sum(px[y % 8 * 8 + x % 8 + 1]) AS BIGINT) AS total
FROM scene, range(0, 56) AS a(x), range(16, 48) AS b(y) JOIN grey ON vec_id = image_id * 42 + y // 8 * 7 + x // 8 GROUP BY ALL""")
def s14_satellite_tiles(t):
    """Chunks of satellite products under a window (rows 16 to 39), with bounds from the tile's name."""
    df = raw_scenes(t)
    folder = scratch(df)

    def store(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for r in p.itertuples():
                m = np.frombuffer(r.data, np.uint8).reshape(48, 56).astype("<u2")
                sinks.write_file(f"{folder}/P{r.image_id}.h{r.image_id % 36:02d}v{r.image_id % 18:02d}.h5", hdf5.encoded(m, "grids/day/light", (16, 16)))
            yield p[["image_id"]]

    df.mapInPandas(store, "image_id long").agg(F.count("*")).collect()
    files = fs.find_files(df.sparkSession, folder).withColumnRenamed("filepath", "path")
    out = hdf5.satellite_tiles(files, "grids/day/light", 56, (0, 16, 56, 24))
    total = F.aggregate(F.sequence(F.lit(0), c("rows") * c("columns") - 1), F.lit(0).cast("long"), lambda a, i: a + F.conv(F.hex(F.substr("data", 2 * i + 1, F.lit(1))), 16, 10).cast("long"))
    out = out.select(F.regexp_extract("filepath", r"P(\d+)\.", 1).cast("long").alias("image_id"), "y_off", "x_off", "x_min", "y_max", total.alias("total"))
    return rounded(out, "x_min", "y_max", digits=6)


@query("SELECT event_id, event_type, value FROM events")
def s15_csv_round_trip(t):
    df = t("events").select("event_id", "event_type", "value")
    path = sinks.save_table(df, scratch(df), format="csv")
    return fs.read_table(df.sparkSession, path, "event_id long, event_type string, value double")


@query("SELECT event_id, value, true AS first FROM events")
def s16_cached(t):
    """The second call finds what the first has stored, and computes nothing."""
    df, path = t("events").select("event_id", "value"), scratch(t("events"))
    fs.cached_or(df.sparkSession, path, lambda: df.withColumn("first", F.lit(True)))
    return fs.cached_or(df.sparkSession, path, lambda: df.withColumn("first", F.lit(False)))


# --- sinks ---------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, value FROM events")
def k1_metadata_table(t):
    df = t("events").select("event_id", "user_id", "value")
    return df.sparkSession.read.parquet(sinks.save_table(df, scratch(df)))


@query("SELECT event_id, -value AS value FROM events")
def k2_rewritten_table(t):
    df, path = t("events").select("event_id", "value"), scratch(t("events"))
    for sign in (1, -1):
        sinks.save_table(df.withColumn("value", sign * c("value")), path, "overwrite")
    return df.sparkSession.read.parquet(path)


@query(f"SELECT {NAME_SQL} AS name, 64 AS pixels FROM embeddings")
def k3_images(t):
    """A file per image; its size is that of the pixels and of one head, which all share."""
    df = content(t).select(short("path").alias("name"), "length")
    least = df.agg(F.min("length").alias("least"))
    return df.crossJoin(F.broadcast(least)).select("name", (c("length") - c("least") + 64).alias("pixels"))


@query(f"WITH {GREY_SQL}, {BOX_SQL} SELECT vec_id, round((x_max - x_min) / 8, 6) AS pixel_width, round((y_max - y_min) / 8, 6) AS pixel_height, {HEX_SQL} AS data FROM box")
def k4_referenced_images(t):
    df = fs.load_referenced(content(t)).select(vec().alias("vec_id"), ((c("x_max") - c("x_min")) / c("columns")).alias("pixel_width"), ((c("y_max") - c("y_min")) / c("rows")).alias("pixel_height"), F.hex("data").alias("data"))
    return rounded(df, "pixel_width", "pixel_height", digits=6)


MOSAIC_SQL = f"{PIX_SQL}, mosaic AS (SELECT x, y, coalesce(arg_min(r, ord) FILTER (r > 0), 0) AS r, 255 AS alpha FROM pix GROUP BY x, y)"


@query(f"WITH {MOSAIC_SQL} SELECT gx AS x, gy AS y, coalesce(r, 0) AS r, coalesce(alpha, 0) AS alpha FROM range(0, 80) AS a(gx), range(0, 70) AS b(gy) LEFT JOIN mosaic ON x = gx AND y = gy")
def k5_empty_raster(t):
    return mo.filled(mo.blend(contributions(t), ["r"]), (0, 0, 80, 70), ["r", "alpha"])


@query(f"WITH {MOSAIC_SQL} SELECT x, y, r FROM mosaic")
def k6_raster_copy(t):
    df = mo.blend(contributions(t), ["r"]).withColumns({"tile_x": F.floor(c("x") / 32), "tile_y": F.floor(c("y") / 32)})
    return df.sparkSession.read.parquet(sinks.save_table(df, scratch(df), by=["tile_x", "tile_y"])).select("x", "y", "r")


@query(f"WITH {MOSAIC_SQL} SELECT x, y, r FROM mosaic WHERE NOT (x BETWEEN 10 AND 19 AND y BETWEEN 20 AND 25) UNION ALL SELECT x + 10, y + 20, r + 1000 FROM mosaic WHERE x BETWEEN 0 AND 9 AND y BETWEEN 0 AND 5")
def k7_window_write(t):
    df = mo.blend(contributions(t), ["r"]).select("x", "y", "r")
    return mo.write_window(df, df.withColumn("r", c("r") + 1000), (10, 20, 10, 6))


@query("SELECT 'v' || vec_id || '.tif' AS name FROM embeddings WHERE vec_id % 7 = 0")
def k8_copied_files(t):
    files = content(t).select(c("path").alias("filepath"), "content").where(vec() % 7 == 0)
    folder = scratch(files)
    sinks.copy_files(files, folder).agg(F.count("*")).collect()
    return fs.find_files(files.sparkSession, folder).select(F.regexp_extract("filepath", "[^/]+$", 0).alias("name"))


@query("SELECT n_name AS name, n_nationkey AS number FROM nation")
def k9_settings(t):
    """A setting per nation, dumped and read back line by line."""
    df, path = t("nation"), f"{scratch(t('nation'))}/settings.yaml"
    sinks.save_settings({r["n_name"]: r["n_nationkey"] for r in df.collect()}, path)  # 25 rows at any scale
    return df.sparkSession.read.text(path).select(F.trim(F.split("value", ":")[0]).alias("name"), F.split("value", ":")[1].cast("int").alias("number"))


@query(f"SELECT printf('%06d_%d.tif', vec_id * 2, vec_id) AS name FROM embeddings WHERE vec_id % 4 IN (0, 2)")
def k10_progress_images(t):
    code = F.element_at(F.array(*map(F.lit, ("success", "bad_det", "dark_frame", "linalg_err"))), (c("vec_id") % 4 + 1).cast("int"))
    df = images(t).select(c("vec_id").alias("image_id"), (2 * c("vec_id")).alias("order"), code.alias("return_code"), c("columns").alias("x_size"), c("rows").alias("y_size"), "data")
    folder = scratch(df)
    sinks.progress_images(df, ["success", "dark_frame"], folder, 1).agg(F.count("*")).collect()
    return fs.find_files(df.sparkSession, folder).select(F.regexp_extract("filepath", "[^/]+$", 0).alias("name"))


@query("SELECT * FROM (VALUES ('error', 0, 5), ('pass', 0, 5), ('load', 0, 5), ('new', 1, 25), ('overwrite', 0, 25)) AS v(policy, is_new, n)")
def k11_policies(t):
    """Five regions are stored first, then 25 nations under each policy."""
    few, many, rows = t("region").select("r_regionkey"), t("nation").select(c("n_nationkey").alias("r_regionkey")), []
    spark = few.sparkSession
    for policy in ("error", "pass", "load", "new", "overwrite"):
        path = sinks.save_table(few, scratch(few))
        try:
            to = path if policy == "load" else sinks.save_table(many, path, policy)
            n = (sinks.loaded_or(spark, path, policy, lambda: many) if policy == "load" else spark.read.parquet(to)).count()
        except Exception as e:
            if "PATH_ALREADY_EXISTS" not in str(e):
                raise
            to, n = path, spark.read.parquet(path).count()
        rows.append((policy, int(to != path), n))
    return spark.createDataFrame(rows, "policy string, is_new int, n int")


# --- functions and kernels -----------------------------------------------------------------------


@query("SELECT url AS filepath, 'table' AS kind FROM pages UNION ALL SELECT n_name, 'list' FROM nation")
def f7_input_coercion(t):
    table, names = t("pages").select("url"), [r[0] for r in t("nation").select("n_name").collect()]  # 25 rows at any scale
    one, two = fs.as_files(table.sparkSession, table), fs.as_files(table.sparkSession, names)
    return one.withColumn("kind", F.lit("table")).unionByName(two.withColumn("kind", F.lit("list")))


@query(f"WITH {GREY_SQL}, {BOX_SQL} SELECT vec_id, {WEB_SQL} FROM box")
def x8_reprojected_bounds(t):
    there = images(t).select("vec_id", *(v.alias(k) for k, v in geo.reprojected("EPSG:4326", "EPSG:3857").items()))
    return rounded(there, "x_min", "x_max", "y_min", "y_max", digits=2)


def per_image(f: Callable[[np.ndarray], float], df: DataFrame, name: str) -> DataFrame:
    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"vec_id": p["vec_id"], name: [f(np.frombuffer(x, np.uint8).reshape(8, 8, 1).astype(float)) for x in p["data"]]})

    return df.select("vec_id", "data").mapInPandas(task, f"vec_id long, {name} double")


@query(f"WITH {GREY_SQL}, q AS (SELECT vec_id, unnest(range(0, 16)) AS k, px FROM grey) SELECT vec_id, round(sum((k + 1) * (px[16 * (k // 4) + 2 * (k % 4) + 1] + px[16 * (k // 4) + 2 * (k % 4) + 2] + px[16 * (k // 4) + 2 * (k % 4) + 9] + px[16 * (k // 4) + 2 * (k % 4) + 10]) / 4.0), 3) AS checksum FROM q GROUP BY vec_id")
def x33_resize(t):
    """Half the size: each new pixel is the mean of four, summed with its place as weight."""
    return rounded(per_image(lambda m: float((kernels.resize(m, 4, 4).ravel() * np.arange(1, 17)).sum()), images(t), "checksum"), "checksum", digits=3)


@query(f"WITH {GREY_SQL}, q AS (SELECT vec_id, unnest(range(0, 64)) AS k, px FROM grey) SELECT vec_id, CAST(sum(CASE WHEN k % 8 >= 2 AND k >= 8 THEN (k + 1) * px[k - 9] ELSE 0 END) AS DOUBLE) AS checksum FROM q GROUP BY vec_id")
def x33_warp(t):
    """Moved by two columns and one row under a homography."""
    m = np.array([[1.0, 0, 2], [0, 1, 1], [0, 0, 1]])
    return rounded(per_image(lambda x: float((kernels.warp(x, m, 8, 8).ravel() * np.arange(1, 65)).sum()), images(t), "checksum"), "checksum", digits=3)


@query(f"WITH {M_SQL} SELECT vec_id, list_transform(range(1, 10), lambda i: CASE WHEN i = 9 THEN 1.0 ELSE round(CASE WHEN i IN (1, 5) THEN 1.0 ELSE 0 END + CASE WHEN i > 6 THEN m[i] / 1e5 ELSE m[i] / 10 END, 4) END) AS h FROM m")
def i6_homography(t):
    """Forty points under a homography, four of them displaced: the consensus finds it."""
    df, _ = homographies(t)
    points = np.stack(np.meshgrid(np.arange(0, 80, 10.0), np.arange(0, 50, 10.0)), 2).reshape(-1, 2)

    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for m in p["m"]:
                h = np.asarray(m) / np.array([10] * 6 + [1e5] * 3) + np.eye(3).ravel() * [1, 0, 0, 0, 1, 0, 0, 0, 0]
                h[8] = 1
                q = np.c_[points, np.ones(len(points))] @ h.reshape(3, 3).T
                q = q[:, :2] / q[:, 2:]
                q[:4] += 40
                out.append(kernels.consensus(points, q, rounds=40).ravel().round(4).tolist())
            yield pd.DataFrame({"vec_id": p["vec_id"], "h": out})

    return df.mapInPandas(task, "vec_id long, h array<double>")


@query(f"SELECT image_id, x AS x_found, y AS y_found, 'success' AS code FROM ({SCENE_SQL})")
def i2_aligned(t):
    """A piece of each scene is aligned with the whole; its place is found."""

    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for r in p.itertuples():
                whole = scene(r.data).astype(float)
                try:
                    m = features.align(whole[r.y : r.y + 65, r.x : r.x + 75], whole)
                    centre = m @ [37, 32, 1]  # of the crop
                    out.append((r.image_id, round(centre[0] / centre[2] - 37), round(centre[1] / centre[2] - 32), "success"))
                except kernels.ImageError as e:
                    out.append((r.image_id, None, None, str(e)))
            yield pd.DataFrame(out, columns=["image_id", "x_found", "y_found", "code"])

    return shifted(t).mapInPandas(task, "image_id long, x_found long, y_found long, code string")


@query(f"SELECT image_id, round(0.7 + image_id % 8 / 10.0, 1) AS scale, CAST((image_id % 7 - 3) * 10 AS DOUBLE) AS degrees FROM ({SCENE_SQL})")
def i5_features(t):
    """Each scene is turned and resized; features of both give the scale and direction back."""

    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for r in p.itertuples():
                whole, scale, angle = scene(r.data).astype(float), 0.7 + r.image_id % 8 / 10, np.radians((r.image_id % 7 - 3) * 10)
                m = np.eye(3)
                m[:2, :2] = scale * np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
                m[:2, 2] = [85, 80] - m[:2, :2] @ [56, 48]
                (a, da), (b, db) = features.features(whole), features.features(kernels.warp(whole, m, 160, 170))
                pair = features.matched(da, db)
                found = kernels.consensus(a[pair[:, 0]], b[pair[:, 1]], 3.0)
                turned = found @ np.array([[46.0, 48, 1], [66, 48, 1]]).T
                (x, y) = np.diff(turned[:2] / turned[2], axis=1)[:, 0]
                out.append((r.image_id, float(np.hypot(x, y) / 20), float(np.degrees(np.arctan2(y, x)))))
            yield pd.DataFrame(out, columns=["image_id", "scale", "degrees"])

    df = scenes(t).mapInPandas(task, "image_id long, scale double, degrees double")
    return df.select("image_id", F.round("scale", 1).alias("scale"), (F.round(c("degrees") / 10) * 10 + F.lit(0.0)).alias("degrees"))


def flight(t: Callable) -> DataFrame:
    """Per scene a training image, a piece of it whose search zone is the whole, a dark frame, and an
    image in whose zone nothing lies; each scene's place is apart from the others'."""

    def flown(parts: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for p in parts:
            for r in p.itertuples():
                whole, off, i = scene(r.data), 400 * r.image_id, 10 * r.image_id
                piece = np.ascontiguousarray(whole[r.y : r.y + 65, r.x : r.x + 75])
                for k, image, training, x in ((0, whole, True, off), (1, piece, False, off), (2, np.zeros_like(piece), False, off), (3, piece, False, off + 200)):
                    yield i + k, k - 1, training, x, 0, 112, 96, *image.shape, image.tobytes()

    schema = "image_id long, order long, training boolean, x_off long, y_off long, x_size long, y_size long, rows long, columns long, bands long, data binary"
    return shifted(t).mapInPandas(lambda parts: fs.in_parts(flown(parts), [f.split()[0] for f in schema.split(", ")], HANDED_ON), schema)


FLIGHT_SQL = f"""SELECT 10 * image_id + k AS image_id, CASE k WHEN 2 THEN 'dark_frame' WHEN 3 THEN 'dst_dark_frame' ELSE 'success' END AS return_code,
  CASE k WHEN 0 THEN 400 * image_id WHEN 1 THEN 400 * image_id + x END AS x_off, CASE k WHEN 0 THEN 0 WHEN 1 THEN y END AS y_off
FROM ({SCENE_SQL}), range(0, 4) AS r(k)"""
#: Places within a pixel of the true one count as it.
NEAR = "CASE WHEN abs({0} - true_{0}) <= 1 THEN true_{0} ELSE {0} END"


def placed(t: Callable) -> DataFrame:
    df, true = sq.sequential_mosaic(flight(t)), shifted(t)
    k, i = c("image_id") % 10, F.floor(c("image_id") / 10)
    true = true.select(c("image_id").alias("i"), "x", "y")
    df = df.withColumns({"k": k, "i": i}).join(true, "i")
    df = df.withColumns({"true_x_off": 400 * c("i") + F.when(c("k") == 0, 0).otherwise(c("x")), "true_y_off": F.when(c("k") == 0, 0).otherwise(c("y"))})
    return df.withColumns({n: F.expr(NEAR.format(n)) for n in ("x_off", "y_off")})


@query(FLIGHT_SQL)
def i17_sequential_mosaic(t):
    return placed(t).select("image_id", "return_code", "x_off", "y_off")


@query(f"SELECT return_code, count(*) AS n, count(x_off) AS n_stored FROM ({FLIGHT_SQL}) GROUP BY return_code")
def i7_row_processor(t):
    """Load, window, align, store: outcomes, and how many images were stored with pixels."""
    df = sq.sequential_mosaic(flight(t))
    return df.groupBy("return_code").agg(F.count("*").alias("n"), F.count("data").alias("n_stored"))


@query(f"SELECT image_id, CAST(x_off * 2 + 100 AS DOUBLE) AS x_min, CAST(5000 - y_off * 2 AS DOUBLE) AS y_max, 'ref/' || image_id || '.tif' AS file FROM ({FLIGHT_SQL}) WHERE return_code = 'success' AND image_id % 10 = 1")
def i11_referencer(t):
    """Successes are stored with bounds in metres and found again with them."""
    raster = {"x_min": 100.0, "y_max": 5000.0, "pixel_width": 2.0, "pixel_height": -2.0}
    df = placed(t).where("return_code = 'success' AND k = 1")
    df = df.withColumns(geo.to_bounds(raster)).select(F.concat(F.lit("ref/"), c("image_id").cast("string"), F.lit(".tif")).alias("name"), c("y_size").alias("rows"), c("x_size").alias("columns"), F.lit(1).cast("long").alias("bands"), "data", *sinks.BOUNDS)
    folder = scratch(df)
    sinks.save_images(df, folder).agg(F.count("*")).collect()
    back = fs.geotiff_headers(df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(folder))
    return back.select(F.regexp_extract("filepath", r"(\d+)\.tif$", 1).cast("long").alias("image_id"), "x_min", "y_max", short().alias("file"))


@query(f"""WITH {PIX_SQL}, mosaic AS (SELECT x, y, arg_min(v, ord) FILTER (v > 0) AS m FROM pix GROUP BY x, y),
both_sides AS (SELECT vec_id, CAST(v AS DOUBLE) AS v, CAST(m AS DOUBLE) AS m FROM pix JOIN mosaic USING (x, y) WHERE v > 0 AND m > 0),
sums AS (SELECT vec_id, count(*) AS n, sum(v) AS a, sum(m) AS b, sum(v * m) AS ab, sum(v * v) AS aa, sum(m * m) AS bb FROM both_sides GROUP BY vec_id)
SELECT vec_id AS image_id, round((ab - a * b / n) / sqrt((aa - a * a / n) * (bb - b * b / n)), 4) AS score FROM sums WHERE aa - a * a / n > 0 AND bb - b * b / n > 0""")
def i12_mosaic_scores(t):
    """Each image against the mosaic of all, tile by tile."""
    df = on_mosaic(t)
    raster = ti.merged(ti.pieces(df, 16), 16)
    return rounded(ti.scores(df, raster, 16).where("score is not null"), "score")


def on_mosaic(t: Callable) -> DataFrame:
    """The images with their places in a mosaic of 64 x 64 and their order, by label and number."""
    df = images(t).join(grey(t).select("vec_id", "label"), "vec_id")
    place = {"order": c("label") * 1000000 + c("vec_id"), "x_off": c("vec_id") * 7 % 57, "y_off": c("vec_id") * 13 % 57, "x_size": F.lit(8), "y_size": F.lit(8)}
    return df.select(c("vec_id").alias("image_id"), *(e.cast("long").alias(n) for n, e in place.items()), "rows", "columns", "bands", "data")


@query(f"SELECT image_id, 'success' AS code, true AS close, 1 AS variation FROM ({SCENE_SQL})")
def i3_aligned_blend(t):
    """A piece is warped onto its scene, by the second of two variations: where it has pixels they are the scene's."""
    operate = image_ops.variations({"pixels": 3.0}, [{"det": (5.0, 6.0)}, {}])

    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for r in p.itertuples():
                whole = scene(r.data)
                done = operate(whole[r.y : r.y + 65, r.x : r.x + 75], whole)
                drawn = done.get("image", np.zeros_like(whole)).astype(float)
                out.append((r.image_id, done["return_code"], bool(np.abs(drawn - whole)[2:-2, 2:-2][drawn[2:-2, 2:-2] > 40].mean() < 6), int(done["i_operator"])))
            yield pd.DataFrame(out, columns=["image_id", "code", "close", "variation"])

    return shifted(t).mapInPandas(task, "image_id long, code string, close boolean, variation int")


@query(f"WITH {PIX_SQL} SELECT x, y, CAST(coalesce(arg_min(v, ord) FILTER (v > 0), 0) AS INT) AS r FROM pix GROUP BY x, y")
def i10_streamed_mosaic(t):
    """A stream of new image files, in two runs with every third image late: tiles are state that the second goes on with."""
    df = on_mosaic(t)
    spark, folder = df.sparkSession, scratch(df)
    for late in (False, True):
        df.where((c("image_id") % 3 == 1) == F.lit(late)).write.mode("append").parquet(f"{folder}/in")
        stream = incremental.read_new_files(spark, f"{folder}/in", df._jdf.schema().toDDL())
        incremental.run_to_end(streamed.mosaic_updates(stream, 16), f"{folder}/out", f"{folder}/state")
    return ti.pixels_of(streamed.newest(spark, f"{folder}/out"), 16, ["r"])


#: Images of two pixel sizes, whose bounds lie on a grid of two metres.
PATCH = {"x_min": "CAST(vec_id * 7 % 57 * 2 AS DOUBLE)", "y_max": "CAST(400 - vec_id * 13 % 57 * 2 AS DOUBLE)", "pixel": "CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 2 END"}


@query(f"""WITH {GREY_SQL}, patch AS (SELECT vec_id, px, {", ".join(f"{e} AS {n}" for n, e in PATCH.items())} FROM grey),
edge AS (SELECT min(x_min) AS x0, max(y_max) AS y1 FROM patch),
pix AS (
  SELECT vec_id, (x_min - x0) / 2 + k % 8 AS x, (y1 - y_max) / 2 + k // 8 AS y, px[k + 1] AS r FROM patch, edge, range(0, 64) AS g(k) WHERE pixel = 2
  UNION ALL
  SELECT vec_id, (x_min - x0) / 2 + k % 4, (y1 - y_max) / 2 + k // 4, round_even((px[16 * (k // 4) + 2 * (k % 4) + 1] + px[16 * (k // 4) + 2 * (k % 4) + 2] + px[16 * (k // 4) + 2 * (k % 4) + 9] + px[16 * (k // 4) + 2 * (k % 4) + 10]) / 4.0, 0)
  FROM patch, edge, range(0, 16) AS g(k) WHERE pixel = 1
)
SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(coalesce(arg_min(r, vec_id) FILTER (r > 0), 0) AS INT) AS r FROM pix GROUP BY ALL""")
def i16_mosaic(t):
    """Extent, pixel rectangles, resampling and blend of referenced images, as tiles, read back by pixel."""
    df = images(t).select(c("vec_id").alias("image_id"), "vec_id", "rows", "columns", "bands", "data").selectExpr("*", *(f"{e} AS {n}" for n, e in PATCH.items()))
    df = df.withColumns({"order": c("image_id"), "x_max": c("x_min") + 8 * c("pixel"), "y_min": c("y_max") - 8 * c("pixel")})
    return ti.pixels_of(stages.mosaic_of(df, 32)[2], 32, ["r"])


@query(f"WITH {PIX_SQL} SELECT x, y, CAST(coalesce(arg_min(v, ord) FILTER (v > 0), 0) AS INT) AS r FROM pix GROUP BY x, y")
def i10_mosaic_update(t):
    """Images that are known to fill their windows update a mosaic in order; none looks at what lies there, so they are merged set-based."""
    df = od.ordered(on_mosaic(t).withColumnRenamed("order", "rank"), ["rank"])
    return ti.pixels_of(sq.sequential_tiles(df, 16, None)[1], 16, ["r"])


@query("SELECT event_id AS image_id, o AS \"order\", value * 2 AS score, CASE WHEN o < (n + 1) // 2 THEN 0 ELSE 1 END AS run FROM (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS o, count(*) OVER () AS n FROM events)")
def i15_batch_loop(t):
    """A run that does half of the rows, and one that goes on where it ended and does the rest."""
    rows = od.ordered(t("events").select(c("event_id").alias("image_id"), "ts", "value"), ["ts"])
    path, half = scratch(rows), (rows.count() + 1) // 2
    score = lambda df: df.select("image_id", "order", (c("value") * 2).alias("score"))
    batches.resumed(rows, path, score, most=half)
    batches.resumed(rows, path, score)
    batches.prune(rows.sparkSession, path)
    return batches.restored(rows.sparkSession, path).select("image_id", "order", "score", "run")


@query("SELECT * FROM (VALUES ('x_min', 'west bound'), ('mAltitude', 'pressure altitude'), ('camera_num', 'camera'), ('tax', 'no description')) AS v(name, description)")
def d1_dictionary(t):
    return dictionary.described(rects(t).select("x_min", "mAltitude", "camera_num", "tax")).select("name", "description")


@query(f"SELECT 'events' AS input, count(*) AS n FROM events UNION ALL SELECT 'nation', count(*) FROM nation")
def d2_base_stage(t):
    spark = t("events").sparkSession
    inputs = {n: {"path": t(n).inputFiles()[0]} for n in ("events", "nation")}
    return stages.base(spark, {"stage": "base", "inputs": inputs})["counts"]


__all__ = ["ORACLE_SQL", "QUERIES", "RECT_SQL"]
