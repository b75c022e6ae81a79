"""Readers of result files: tables, boxes, axes, contours and profiles. Schemas are given, never inferred by a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import json_maps

DETECTION = "struct<kernel_id:bigint,id:bigint,box:array<double>,deleted:boolean>"
BOXES = f"struct<accepted_detections:array<{DETECTION}>,detections:array<{DETECTION}>,accepted_boxes:array<array<double>>>"
POINTS = "array<array<double>>"
AXIS = "kernel_name string, bottom array<double>, top array<double>, shape_label string, measurement_status string, axis_length double, max_width double, area double, perimeter double, circularity double"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: str | StructType, sep: str = ",") -> DataFrame:
    """A CSV with a header; a value that doesn't fit its type is null."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "PERMISSIVE").csv(path)


def parquet_or_csv(spark: SparkSession, base: str, schema: str | StructType) -> DataFrame | None:
    """base.parquet if it is there, else base.csv, else None."""
    if exists(spark, f"{base}.parquet"):
        return spark.read.parquet(f"{base}.parquet")
    return read_csv(spark, f"{base}.csv", schema) if exists(spark, f"{base}.csv") else None


def image_files(spark: SparkSession, path: str, glob: str = "*.{jpg,jpeg,png}") -> DataFrame:
    """Names and sizes of image files; their content is only read if a query asks for it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("image_name"), "path", "length", "content")


def accepted_boxes(entries: DataFrame, entry: str = "entry") -> DataFrame:
    """The accepted boxes of each image, whichever way its file has them, by number.

    Accepted detections come first; else detections that aren't deleted; else
    plain boxes, numbered from 1. A missing number is the place in the list.
    """
    e = lambda f: F.col(f"{entry}.{f}")
    number = lambda d, i: F.coalesce(d["kernel_id"], d["id"], i + F.lit(1).cast("bigint"))
    listed = lambda c: F.transform(F.filter(c, lambda d: ~F.coalesce(d["deleted"], F.lit(False))), lambda d, i: F.struct(number(d, i).alias("kernel_id"), d["box"].alias("box")))
    bare = F.transform(e("accepted_boxes"), lambda b, i: F.struct((i + 1).cast("bigint").alias("kernel_id"), b.alias("box")))
    return entries.select("image_name", F.explode(F.array_sort(F.coalesce(listed(e("accepted_detections")), listed(e("detections")), bare))).alias("d")).select("image_name", "d.kernel_id", "d.box")


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Box JSON files, an object keyed by image, cut at its entries: image_name, kernel_id, box."""
    return accepted_boxes(json_maps.members(spark, path, BOXES).select(F.col("key").alias("image_name"), F.col("value").alias("entry")))


def read_axes(spark: SparkSession, path: str) -> DataFrame:
    """Axis JSON, an array of records, cut between them; missing numbers are 0."""
    rows = json_maps.records(spark, path, AXIS).drop("file", "place")
    return rows.na.fill(0.0, ["axis_length", "max_width", "area", "perimeter", "circularity"])


def read_contours(spark: SparkSession, path: str) -> DataFrame:
    """Contour JSON, an object keyed by object name, one file or one per image, cut at its entries: kernel_name, c."""
    flat = json_maps.members(spark, path, POINTS, end="]")
    return flat.select(F.col("key").alias("kernel_name"), F.transform("value", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("c"))


def read_profiles(spark: SparkSession, path: str, least: int = 20) -> DataFrame:
    """Lines of a name and its widths; lines with too few numbers, or with something else than numbers, are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") > least)
    rows = rows.select(F.col("p")[0].alias("name"), F.transform(F.slice("p", F.lit(2), F.size("p") - 1), lambda x: x.try_cast("double")).alias("w"))
    return rows.where(~F.exists("w", lambda x: x.isNull()))


def angle_labels(rows: DataFrame, status: str = "ok") -> DataFrame:
    """Labels of one status with a usable direction, brought to length 1."""
    x, y = (F.col(c).try_cast("double") for c in ("cos_theta", "sin_theta"))
    n = F.hypot(x, y)
    return rows.where(F.lower(F.trim("status")) == status).where(n > 1e-12).withColumns({"cos_theta": x / n, "sin_theta": y / n})


def image_records(spark: SparkSession, folder: str, labels: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """image_name, path and status of a folder's images in name order, with the columns of labels if given; without labels, or a row for an image, its status is null.

    limit keeps the first so many, as a test run asks for.
    """
    files = image_files(spark, folder).select("image_name", "path")
    out = files.withColumn("status", F.lit(None).cast("string")) if labels is None else files.join(labels, "image_name", "left")
    return out.orderBy("image_name").limit(limit) if limit is not None else out


def labelled_images(labels: DataFrame, files: DataFrame, status: str = "ok", limit: int | None = None) -> DataFrame:
    """Labels of one status whose image is there by its name or, failing that, by its stem with any suffix."""
    rows = angle_labels(labels, status)
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    exact = files.select(F.col("image_name").alias("image_label"), F.col("path").alias("__a"))
    near = files.groupBy(stem(F.col("image_name")).alias("__stem")).agg(F.min("path").alias("__b"))
    out = rows.withColumn("__stem", stem(F.col("image_label"))).join(exact, "image_label", "left").join(near, "__stem", "left")
    out = out.withColumn("path", F.coalesce("__a", "__b")).where("path is not null").drop("__stem", "__a", "__b")
    return out.orderBy("image_label").limit(limit) if limit is not None else out


def read_latents(spark: SparkSession, path: str, dims: int = 5) -> DataFrame:
    """plant_id and z, the array of latent values, of a latent CSV."""
    names = [f"latent_{i + 1}" for i in range(dims)]
    rows = read_csv(spark, path, ", ".join(["plant_id string", *[f"{n} double" for n in names]]))
    return rows.select("plant_id", F.array(*names).alias("z"))


def detection_counts(boxes: DataFrame) -> DataFrame:
    """Accepted boxes of each image, in name order of the numbers."""
    return boxes.groupBy("image_name").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("kernel_id")).alias("ids"))


#: Lots into which objects are dealt by their image.
LOTS = 256


def _lot(image: str, lots: int):
    return F.pmod(F.xxhash64(F.col(image).cast("string")), F.lit(lots)).cast("int").alias("lot")


def objects_of(spark: SparkSession, path: str, images: DataFrame, image: str = "image_name", lots: int = LOTS) -> DataFrame:
    """The objects of some images, from a table that sinks.write_by_image has laid out.

    The lots of the wanted images, at most as many numbers as there are lots, are
    read first; the scan then opens only their folders.
    """
    own = images.select(F.col(image).cast("string").alias(image)).distinct().select(image, _lot(image, lots))
    wanted = [r[0] for r in own.select("lot").distinct().collect()]
    return spark.read.parquet(path).where(F.col("lot").isin(wanted)).join(own, ["lot", image]).drop("lot")


def read_results(spark: SparkSession, folder: str, essential: str, optional: dict[str, str], schemas: dict[str, str], others: dict | None = None) -> dict:
    """A result folder's tables by name, with ok, errors and warnings; only the essential one must be there.

    others: name to (file, read) for what is no Parquet or CSV table, such as
    boxes, axes, contours or profiles; read(spark, path) gives its rows.
    """
    out = {"ok": True, "errors": [], "warnings": [], "tables": {}}
    for name, (file, read) in (others or {}).items():
        if exists(spark, f"{folder}/{file}"):
            out["tables"][name] = read(spark, f"{folder}/{file}")
        else:
            out["warnings"].append(f"{name} is missing")
    for name in [essential, *optional]:
        got = parquet_or_csv(spark, f"{folder}/{optional.get(name, name)}", schemas[name])
        if got is not None:
            out["tables"][name] = got
        elif name == essential:
            out["ok"] = False
            out["errors"].append(f"{name} is missing")
        else:
            out["warnings"].append(f"{name} is missing")
    return out
