"""The five configured stages, their registry and command line."""

from __future__ import annotations

import argparse
from collections.abc import Callable

import yaml
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geo, predicate
from ..operators import correlate as co, image_ops, interpolate as ip, mosaic as mo, order as od, registrar as rg, scores as sc, sequential as sq, tiles as ti
from ..sources import files as fs, logs as lg, sinks
from .services import Services, merged, parsed

#: Stage name to function of (spark, config); more can be registered.
STAGES: dict[str, Callable[[SparkSession, dict], dict[str, DataFrame]]] = {}
DEFAULTS = {
    "metadata_processor": {"tz_offset_in_hr": 5.0, "unmatched": "drop", "patterns": [], "use_cached_output": True, "crs": "EPSG:3857"},
    "mosaicker": {"padding_fraction": 0.1, "crs": "EPSG:3857", "tile": 256},
    "sequential_mosaicker": {"altitude": 13000.0, "gyro": 0.075, "sensors": {0: 1, 1: 0, 2: 2}, "angles": {0: 30.0, 1: 0.0, 2: 30.0}, "tile": 256, "steps": ["altitude_filter", "steady_filter", "registrar", "order"], "aligner": {}, "variations": []},
    "query_processor": {"condition": "image_id >= 0"},
    "base": {},
}


def stage(name: str) -> Callable:
    def add(f: Callable) -> Callable:
        STAGES[name] = f
        return f

    return add


def load_config(path: str, local: dict | None = None) -> dict:
    with open(path) as f:
        config = merged(yaml.safe_load(f), local or {})
    return parsed(merged({"options": DEFAULTS.get(config.get("stage", "base"), {})}, config))


def inputs(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """Tables of the config: {name: {path, format, schema?} or {directory, ...} of files}."""
    out = {}
    for name, d in (config.get("inputs") or {}).items():
        if "path" in d:
            reader = spark.read.option("header", d.get("header", True))
            out[name] = (reader.schema(d["schema"]) if "schema" in d else reader).format(d.get("format", "parquet")).load(d["path"])
        else:
            out[name] = fs.find_input_files(spark, d)
    return out


@stage("base")
def base(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """Counts of every input; nothing else."""
    tables = inputs(spark, config)
    parts = [df.agg(F.lit(n).alias("input"), F.count("*").alias("n")) for n, df in tables.items()]
    out = spark.createDataFrame([], "input string, n long")
    for p in parts:
        out = out.unionByName(p)
    return {"counts": out}


@stage("metadata_processor")
def metadata(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """Camera, inertial and position logs at capture times, joined with the image files."""
    t, o = inputs(spark, config), config["options"]
    images = lg.image_log(t["img_log"]) if "img_log" in t else lg.log_from_names(t["images"])
    imu = lg.imu_log(t["imu_log"]).withColumnRenamed("CurrTimestamp", "timestamp")
    gps = lg.gps_log(t["gps_log"], crs=o["crs"]).withColumnRenamed("CurrTimestamp", "timestamp")
    shift = lambda df: df.withColumn("timestamp", F.expr(f"timestamp - make_dt_interval(0, 0, 0, {float(o['tz_offset_in_hr']) * 3600})"))
    images = ip.interpolate_logs(images, [(shift(log), [n for n, k in log.dtypes if k == "double"]) for log in (imu, gps)], "timestamp")
    files = t["images"] if "file_id" in t["images"].columns else fs.select_files(t["images"])
    found = co.correlate(files, images.drop("filepath") if "filepath" in images.columns else images, tuple(o["patterns"]), o["unmatched"])
    return {"metadata": found.withColumnRenamed("file_id", "image_id")}


def contents(spark: SparkSession, config: dict, name: str) -> DataFrame:
    """The selected files of an input directory with their content."""
    d = config["inputs"][name]
    found = fs.find_input_files(spark, d).select(F.col("filepath").alias("path"))
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(d["directory"]).join(found, "path", "left_semi")


def mosaic_of(images: DataFrame, tile: int, padding: float = 0.0) -> tuple[DataFrame, dict, DataFrame]:
    """(placed images, raster, its tiles) of images with bounds, on the grid of their common extent."""
    size = {"pixel_width": (F.col("x_max") - F.col("x_min")) / F.col("columns"), "pixel_height": (F.col("y_min") - F.col("y_max")) / F.col("rows")}
    images = images.withColumns(size).withColumn("padding", geo.padding(F.col("x_min"), F.col("x_max"), F.col("y_min"), F.col("y_max"), padding))
    raster = mo.extent(images).first().asDict()
    placed = mo.pixel_rectangles(images, raster)
    return placed, raster, ti.merged(ti.pieces(placed, tile), tile)


@stage("mosaicker")
def mosaicker(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """Referenced image files, drawn on one grid in the order of their paths; first non-empty wins. The grid
    is padded by a fraction of the largest image's diagonal. The mosaic is a table of tiles."""
    o = config["options"]
    images = fs.load_referenced(contents(spark, config, "images"), o["crs"], o.get("target_crs")).where("x_min is not null")
    paths = od.ordered(contents(spark, config, "images").select(F.col("path").alias("filepath")), [], "filepath")
    images = images.join(paths, "filepath").withColumn("image_id", F.col("order"))
    placed, raster, tiles = mosaic_of(images, o["tile"], float(o["padding_fraction"]))
    return {"footprints": placed.drop("data"), "mosaic": tiles, "raster": spark.createDataFrame([raster])}


def numbers(d: dict) -> dict:
    return {int(k): v for k, v in d.items()}


#: Steps from metadata to placed images, by name: functions of (rows, referenced images, options). More
#: can be registered, and the option ``steps`` says which are taken and in what order.
STEPS: dict[str, Callable[[DataFrame, DataFrame, dict], DataFrame]] = {
    "altitude_filter": lambda rows, known, o: rows.where(sc.altitude_filter(o["altitude"])),
    "steady_filter": lambda rows, known, o: rows.where(sc.steady_filter(o["gyro"])),
    "registrar": lambda rows, known, o: rg.fit(known).transform(rows, numbers(o["angles"])),
    "order": lambda rows, known, o: od.sensor_and_distance(rows, numbers(o["sensors"])),
}


def prepared(rows: DataFrame, known: DataFrame, options: dict) -> DataFrame:
    """Metadata after the named steps."""
    for name in options["steps"]:
        if name not in STEPS:
            raise ValueError(f"unknown step {name!r}")
        rows = STEPS[name](rows, known, options)
    return rows


@stage("sequential_mosaicker")
def sequential(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """Filters, registers and orders raw images by the named steps, and aligns each, within its search zone,
    with the training mosaic of the referenced images and what came before; aligners that vary in their
    options are tried in turn. Successes get bounds in metres; the mosaic is a table of tiles. With a
    table ``test`` of true bounds, images in it get the differences from them beside their outcome."""
    t, o = inputs(spark, config), config["options"]
    model = rg.fit(t["referenced"])
    rows = prepared(t["metadata"], t["referenced"], o)
    zone = rows.withColumns(geo.search_zone(F.col("padding")))
    box, medians = ["image_id", "order", "x_min", "x_max", "y_min", "y_max", "training"], model.medians
    known = t["referenced"].withColumns({"order": F.lit(-1).cast("long"), "training": F.lit(True)})
    every = zone.withColumn("training", F.lit(False)).select(*box).unionByName(known.select(*box))
    raster = mo.extent(every.withColumns({"padding": F.lit(0.0), "pixel_width": F.lit(medians["pixel_width"]), "pixel_height": F.lit(medians["pixel_height"])})).first().asDict()
    placed = mo.pixel_rectangles(every, raster)
    services = Services(config.get("services"))
    services.register("image_operator", image_ops.variations)
    operator = services.get("image_operator", defaults=o["aligner"], changes=o["variations"])
    out, tiles = sq.sequential_tiles(placed.join(t["pixels"], "image_id"), o["tile"], operator)
    out = out.where(F.col("order") >= 0).withColumns(geo.to_bounds(raster))
    if "test" in t:
        out = sc.combine_first(out, sc.geometric_differences(out, t["test"], how="inner"), ["image_id"])
    return {"footprints": placed, "progress": out, "mosaic": tiles, "raster": spark.createDataFrame([raster])}


@stage("query_processor")
def query(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """Metadata rows that meet the condition and whose files are available; with the option ``copy_to`` the
    files are copied there."""
    t, o = inputs(spark, config), config["options"]
    kept = t["metadata"].where(predicate.parse(o["condition"]))
    if "files" not in t:
        return {"selected": kept}
    selected = co.catalogue(kept, t["files"])
    if not o.get("copy_to"):
        return {"selected": selected}
    files = contents(spark, config, "files").select(F.col("path").alias("filepath"), "content")
    return {"selected": selected, "copies": sinks.copy_files(files.join(selected.select("filepath").distinct(), "filepath", "left_semi"), o["copy_to"])}


#: Tables that a stage returns and a stored run can stand for.
CACHED = {"metadata_processor": ["metadata"]}


def run(spark: SparkSession, config: dict, validate_only: bool = False) -> dict[str, str]:
    """Runs a stage and stores its tables; the settings are stored beside them, so it can be run again.

    Metadata that are stored already are not computed again, unless ``use_cached_output`` is off or they
    are to be overwritten or stored anew; the policy ``load`` does the same for every stage.
    """
    name = config.get("stage", "base")
    if name not in STAGES:
        raise ValueError(f"unknown stage {name!r}")
    where, policy = config.get("output"), config.get("exists", "error")
    stored = CACHED.get(name, [])
    cached = not validate_only and policy in ("pass", "load") and config.get("options", {}).get("use_cached_output", True)
    if where and stored and cached and all(sinks.exists(spark, f"{where}/{k}") for k in stored):
        return {k: f"{where}/{k}" for k in stored}
    out = STAGES["base" if validate_only else name](spark, config)
    if not where:
        return {}
    return {k: sinks.save_table(df, f"{where}/{k}", policy) for k, df in out.items()}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Run a configured stage.")
    parser.add_argument("config")
    parser.add_argument("--validate_only", action="store_true")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("skylattice").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    config = load_config(a.config)
    print(run(spark, config, a.validate_only))
    if config.get("output"):
        sinks.save_settings({"config": config, "stages": {k: " ".join((f.__doc__ or "").split()) for k, f in STAGES.items()}}, f"{config['output']}/settings.yaml")


if __name__ == "__main__":
    main()
