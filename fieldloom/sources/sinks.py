"""Writers of result files. Nulls become each file's own spelling of a missing value here, not before."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import LOTS, _lot


def write_csv(df: DataFrame, path: str, sep: str = ",", missing: str = "", mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("sep", sep).option("nullValue", missing).option("emptyValue", missing).csv(path)


def write_parquet(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """Parquet, in folders by key if asked; only the folders that df has rows for are replaced."""
    w = df.write.mode("overwrite")
    (w.option("partitionOverwriteMode", "dynamic").partitionBy(*by) if by else w).parquet(path)


def write_by_image(df: DataFrame, path: str, image: str = "image_name", lots: int = LOTS) -> None:
    """Objects in folders by lots of images, sorted by image, so that readers.objects_of opens only what it needs; few files, however many images."""
    dealt = df.withColumn("lot", _lot(image, lots)).repartition("lot").sortWithinPartitions("lot", image)
    dealt.write.mode("overwrite").partitionBy("lot").parquet(path)


def replace_processed(df: DataFrame, path: str, by: str, processed: DataFrame) -> None:
    """Parquet in folders by key, of which those of every processed key are replaced, also where a rerun has found no rows for it.

    df has rows of processed keys only. Folders without new rows are deleted
    after the others are written; a run that is broken off in between is repeated
    with the same result.
    """
    spark = df.sparkSession
    write_parquet(df, path, [by])
    fs, p = _store(spark, path)
    folder = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    empty = processed.select(by).distinct().join(df.select(by).distinct(), by, "left_anti")
    for row in empty.select(F.col(by).cast("string")).toLocalIterator():
        fs.delete(p(f"{path.rstrip('/')}/{folder(by, row[0])}"), True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_profiles(df: DataFrame, path: str, name: str, values: str) -> None:
    """A line per row: its name and the values with two decimals."""
    numbers = F.array_join(F.transform(values, lambda x: F.format_string("%.2f", F.bround(x, 2))), " ")
    df.select(F.concat_ws(" ", name, numbers).alias("value")).write.mode("overwrite").text(path)


def write_latents(df: DataFrame, path: str, key: str, columns: list[str]) -> None:
    write_csv(df.select(key, *[F.format_string("%.6f", F.col(c)).alias(c) for c in columns]), path)


def append_log(df: DataFrame, path: str) -> None:
    """Adds rows to a folder of CSV parts, each with its header; read_csv reads them as one table, export_log writes them as one file."""
    write_csv(df, path, mode="append")


def export_log(log: DataFrame, order: str, path: str) -> None:
    """A log of training steps as one CSV file with one header, in order; a row per step, so one task writes it."""
    write_csv(log.orderBy(order).coalesce(1), path)


def write_json_document(df: DataFrame, path: str, key: str | None = None, order: str | None = None) -> None:
    """One compact JSON document in one file: an array of all rows, or with a key an object of the other columns by key; in order if asked.

    Tasks write ranges of the order as fragments; then the fragments, in order
    and with commas between them, are copied through a small buffer into the file
    that gets its name when it is whole. A key that is null is left out.
    """
    spark = df.sparkSession
    if key is not None:
        df, order = df.where(F.col(key).isNotNull()), order or key
        own = F.to_json(F.struct(F.col(key).cast("string").alias("k")))
        text = F.concat(F.expr("substr(k, 6, length(k) - 6)"), F.lit(":"), F.col("v"))
        rows = df.select(*([F.col(order).alias("o")] if order else []), own.alias("k"), F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("v")).withColumn("value", text)
    else:
        rows = df.select(*([F.col(order).alias("o")] if order else []), F.to_json(F.struct(*df.columns)).alias("value"))
    if order:
        rows = rows.repartitionByRange("o").sortWithinPartitions("o", "value")
    fragments = f"{path}.fragments-{uuid.uuid4().hex}"
    rows.select("value").write.option("lineSep", ",").text(fragments)
    fs, p = _store(spark, path)
    draft = p(f"{path}.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(b"[" if key is None else b"{"))
        parts = sorted((f.getPath().getName(), f) for f in fs.listStatus(p(fragments)) if f.getPath().getName().startswith("part-") and f.getLen())
        for i, (_, f) in enumerate(parts):
            # A fragment ends with a comma, which the last one loses.
            stream = fs.open(f.getPath())
            try:
                spark._jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, f.getLen() - (1 if i == len(parts) - 1 else 0))
            finally:
                stream.close()
        out.write(bytearray(b"]" if key is None else b"}"))
    finally:
        out.close()
    fs.delete(p(path), True)
    fs.rename(draft, p(path))
    fs.delete(p(fragments), True)


def write_json_array(df: DataFrame, path: str, files: int = 1) -> None:
    """Compact JSON arrays of all rows, without missing values, one in each of so many files; choose files so that one's rows fit a task."""
    lot = F.pmod(F.xxhash64(*df.columns), F.lit(files))
    rows = df.select(lot.alias("__lot"), F.struct(*df.columns).alias("__row")).groupBy("__lot").agg(F.collect_list("__row").alias("rows"))
    rows.select(F.to_json("rows").alias("value")).repartition(files, "value").write.mode("overwrite").text(path)


def write_json_map(df: DataFrame, path: str, key: str, files: int = 1) -> None:
    """JSON objects keyed by image, each value an object of the other columns, spread over so many files by key."""
    value = F.struct(*[c for c in df.columns if c != key])
    rows = df.select(F.pmod(F.xxhash64(key), F.lit(files)).alias("__lot"), F.struct(F.col(key).cast("string").alias("key"), value.alias("value")).alias("e"))
    rows = rows.groupBy("__lot").agg(F.map_from_entries(F.collect_list("e")).alias("m"))
    rows.select(F.to_json("m").alias("value")).write.mode("overwrite").text(path)


def write_points(df: DataFrame, path: str, name: str, contour: str) -> None:
    """A line per contour: its name, then x,y of each point with two decimals."""
    point = lambda p: F.format_string("%.2f,%.2f", F.bround(p["x"], 2), F.bround(p["y"], 2))
    df.select(F.concat_ws(" ", name, F.array_join(F.transform(contour, point), " ")).alias("value")).write.mode("overwrite").text(path)


def _store(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path
    return p(path).getFileSystem(spark._jsc.hadoopConfiguration()), p


def backup(spark: SparkSession, path: str, to: str) -> None:
    """Copies a file or folder within its store, over what is there."""
    fs, p = _store(spark, path)
    fs.delete(p(to), True)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p(path), fs, p(to), False, spark._jsc.hadoopConfiguration())


#: Where a result folder keeps its manifests, one file per version.
MANIFESTS = "_manifests"


def manifest(spark: SparkSession, folder: str) -> tuple[int, dict[str, str]]:
    """The number of the last version of a result folder and the place of each of its tables; 0 and none before the first."""
    fs, p = _store(spark, folder)
    home = p(f"{folder.rstrip('/')}/{MANIFESTS}")
    if not fs.exists(home):
        return 0, {}
    names = [f.getPath().getName() for f in fs.listStatus(home)]
    numbers = [int(n.removesuffix(".json")) for n in names if re.fullmatch(r"\d+\.json", n)]
    if not numbers:
        return 0, {}
    stream = fs.open(p(f"{folder.rstrip('/')}/{MANIFESTS}/{max(numbers):012d}.json"))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return max(numbers), json.loads(text)


def commit(spark: SparkSession, folder: str, tables: dict[str, tuple], based_on: int | None = None) -> int:
    """Changes several tables of a result folder in one step: name to (rows, write or None). Returns the new version.

    Each table is written to a new place; the step is the new manifest's, which
    is renamed to its name only if no other commit has taken that name. Whatever
    fails before leaves all tables as they were. based_on: the version that the
    rows were read from; a newer one makes the commit fail.
    """
    folder = folder.rstrip("/")
    last, places = manifest(spark, folder)
    if based_on is not None and based_on != last:
        raise RuntimeError(f"version {based_on} is not the last one, {last} is")
    new = dict(places)
    for name, (rows, write) in tables.items():
        new[name] = f"{name}/{last + 1}-{uuid.uuid4().hex}"
        (write or (lambda d, at: d.write.parquet(at)))(rows, f"{folder}/{new[name]}")
    fs, p = _store(spark, folder)
    draft, final = p(f"{folder}/{MANIFESTS}/.{uuid.uuid4().hex}"), p(f"{folder}/{MANIFESTS}/{last + 1:012d}.json")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(new, sort_keys=True).encode()))
    out.close()
    files = spark._jvm.org.apache.hadoop.fs
    kept = spark.sparkContext._gateway.new_array(getattr(files, "Options$Rename"), 0)
    files.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, final, kept)  # fails if there is one
    return last + 1


def current(spark: SparkSession, folder: str, name: str) -> str:
    """The place of a table in a result folder's last version."""
    return f"{folder.rstrip('/')}/{manifest(spark, folder)[1][name]}"


def vacuum(spark: SparkSession, folder: str) -> int:
    """Deletes what the last version doesn't name: older versions, and what broken commits have left. Returns how many places went."""
    folder = folder.rstrip("/")
    last, places = manifest(spark, folder)
    fs, p = _store(spark, folder)
    gone = 0
    for name in places:
        for f in fs.listStatus(p(f"{folder}/{name}")):
            if f"{name}/{f.getPath().getName()}" != places[name]:
                gone += fs.delete(f.getPath(), True)
    for f in fs.listStatus(p(f"{folder}/{MANIFESTS}")):
        if f.getPath().getName() != f"{last:012d}.json":
            fs.delete(f.getPath(), False)
    return gone


def delete_everywhere(spark: SparkSession, folder: str, gone: DataFrame, tables: dict[str, tuple]) -> int:
    """Deletes objects from several tables of a result folder in one step: name to (read, key, write or None); read(spark, path) gives a table's rows."""
    last, _ = manifest(spark, folder)
    ids = gone.select(F.col(gone.columns[0]).alias("__gone")).distinct()
    rows = {name: (read(spark, current(spark, folder, name)), key, write) for name, (read, key, write) in tables.items()}
    return commit(spark, folder, {name: (df.join(ids, F.col(key) == F.col("__gone"), "left_anti"), write) for name, (df, key, write) in rows.items()}, last)


def rename_everywhere(spark: SparkSession, folder: str, names: DataFrame, tables: dict[str, tuple]) -> int:
    """Renames groups in several tables of a result folder in one step: names (old, new); tables as in delete_everywhere, key being the group's column."""
    last, _ = manifest(spark, folder)
    new = names.select(F.col("old").alias("__old"), F.col("new").alias("__new"))
    out = {}
    for name, (read, key, write) in tables.items():
        df = read(spark, current(spark, folder, name))
        renamed = df.join(new, F.col(key) == F.col("__old"), "left").withColumn(key, F.coalesce("__new", key))
        out[name] = (renamed.select(*df.columns), write)
    return commit(spark, folder, out, last)


def swap_in(df: DataFrame, path: str, staged: str, write=None) -> None:
    """Replaces a table by rows that may be read from it: written beside it first, then the old one is renamed, the new one put in its place, and the old one deleted.

    A crash in between leaves the old table under path.old; recover() puts it back.
    write(df, path) is another writer than Parquet's.
    """
    spark = df.sparkSession
    (write or (lambda d, at: d.write.mode("overwrite").parquet(at)))(df, staged)
    fs, p = _store(spark, path)
    old = f"{path.rstrip('/')}.old"
    fs.delete(p(old), True)
    if fs.exists(p(path)):
        fs.rename(p(path), p(old))
    fs.rename(p(staged), p(path))
    fs.delete(p(old), True)


def recover(spark: SparkSession, path: str) -> bool:
    """Puts back the old table where a swap was broken off; whether it had to."""
    fs, p = _store(spark, path)
    old = p(f"{path.rstrip('/')}.old")
    if fs.exists(p(path)) or not fs.exists(old):
        return False
    return fs.rename(old, p(path))


def delete_objects(spark: SparkSession, gone: DataFrame, tables: dict[str, tuple]) -> None:
    """Deletes objects from several result tables: path to (rows, key, write or None); each is rewritten beside itself and swapped in."""
    for path, (rows, key, write) in tables.items():
        kept = rows.join(gone.select(F.col(gone.columns[0]).alias(key)).distinct(), key, "left_anti")
        swap_in(kept.select(*rows.columns), path, f"{path.rstrip('/')}.staged", write)
