"""Result files: reruns, several tables changed in one step, documents cut and joined."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from fieldloom.sources import readers, sinks


def rows_of(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).collect()))


def test_reruns_replace_what_they_processed(spark, tmp_path):
    path = f"{tmp_path}/objects"
    first = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c d/é=", 4), ("e", 5)], "image string, n int")
    sinks.write_parquet(first, path, ["image"])
    again = spark.createDataFrame([("a", 9)], "image string, n int")
    processed = spark.createDataFrame([("a",), ("b",), ("c d/é=",), ("never seen",)], "image string")
    sinks.replace_processed(again, path, "image", processed)
    assert sorted((r.image, r.n) for r in spark.read.parquet(path).collect()) == [("a", 9), ("e", 5)]
    sinks.replace_processed(again.limit(0), path, "image", processed)
    assert [(r.image, r.n) for r in spark.read.parquet(path).collect()] == [("e", 5)]


def test_tables_change_in_one_step(spark, tmp_path):
    folder = f"{tmp_path}/results"
    assert sinks.manifest(spark, folder) == (0, {})
    plants = spark.createDataFrame([("p1", 1.0), ("p2", 2.0)], "plant string, weight double")
    latents = spark.createDataFrame([("p1", 5), ("p2", 6), ("p3", 7)], "plant_id string, z int")
    lines = lambda df, at: df.select(F.concat_ws(" ", *df.columns).alias("value")).write.text(at)
    assert sinks.commit(spark, folder, {"plants": (plants, None), "latents": (latents, None), "lines": (latents, lines)}) == 1
    parquet = lambda s, at: s.read.parquet(at)
    tables = {"plants": (parquet, "plant", None), "latents": (parquet, "plant_id", None)}

    def fails(df, at):
        df.write.parquet(at)
        raise OSError("stopped between two tables")

    for broken in ({"plants": (parquet, "plant", None), "latents": (parquet, "plant_id", fails)}, {"plants": (parquet, "plant", fails), "latents": (parquet, "plant_id", None)}):
        with pytest.raises(OSError, match="between"):
            sinks.delete_everywhere(spark, folder, spark.createDataFrame([("p1",)], "p string"), broken)
        assert rows_of(spark, sinks.current(spark, folder, "plants")) == [("p1", 1.0), ("p2", 2.0)]
        assert len(rows_of(spark, sinks.current(spark, folder, "latents"))) == 3
    before = sinks.current(spark, folder, "plants")
    assert sinks.rename_everywhere(spark, folder, spark.createDataFrame([("p1", "q1"), ("x", "y")], "old string, new string"), tables) == 2
    assert rows_of(spark, sinks.current(spark, folder, "plants")) == [("p2", 2.0), ("q1", 1.0)]
    assert rows_of(spark, sinks.current(spark, folder, "latents")) == [("p2", 6), ("p3", 7), ("q1", 5)]
    # Who reads the version before still can, and a commit on top of it is refused.
    assert rows_of(spark, before) == [("p1", 1.0), ("p2", 2.0)]
    with pytest.raises(RuntimeError, match="not the last"):
        sinks.commit(spark, folder, {"plants": (plants, None)}, based_on=1)
    assert sinks.delete_everywhere(spark, folder, spark.createDataFrame([("q1",), ("p3",), ("p3",)], "p string"), tables) == 3
    assert rows_of(spark, sinks.current(spark, folder, "latents")) == [("p2", 6)]
    assert sorted(r.value for r in spark.read.text(sinks.current(spark, folder, "lines")).collect()) == ["p1 5", "p2 6", "p3 7"]
    assert sinks.vacuum(spark, folder) >= 6
    assert rows_of(spark, sinks.current(spark, folder, "plants")) == [("p2", 2.0)] and sinks.manifest(spark, folder)[0] == 3


def test_two_commits_of_one_version(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/results"
    one = spark.range(1)
    sinks.commit(spark, folder, {"t": (one, None)})

    def meanwhile(df, at):
        df.write.parquet(at)
        if at.split("/")[-1].startswith("2-"):
            sinks.commit(spark, folder, {"t": (spark.range(7), None)})

    with pytest.raises(Exception, match="(?i)exist"):
        sinks.commit(spark, folder, {"t": (spark.range(3), meanwhile)})
    assert spark.read.parquet(sinks.current(spark, folder, "t")).count() == 7


def documents(seed):
    rng = random.Random(seed)
    strange = ['plain', 'quote " here', 'back \\ slash', 'end \\" }', '{"not": [a, map]}', "é 日本, }", "\\\\", "", "tab\tline\n", "]]}},,"]
    value = lambda: {"detections": [{"id": rng.randrange(9), "kernel_id": rng.randrange(9), "box": [1.5, 2, 3, rng.randrange(50)], "note": rng.choice(strange), "deleted": rng.random() < 0.2} for _ in range(rng.randrange(0, 4))], "summary": {"deep": [[{"x": rng.choice(strange)}]]}}
    return {f"{rng.choice(strange)}-{i}": value() for i in range(60)}


@pytest.mark.parametrize(("block", "form"), [(1 << 20, {}), (3000, {"indent": 2}), (900, {"ensure_ascii": False, "separators": (",", ":")})])
def test_documents_are_cut_at_their_entries(spark, tmp_path, block, form):
    made = {f"d{k}.json": documents(k) for k in range(2)}
    for name, d in made.items():
        (tmp_path / name).write_text(json.dumps(d, **form), encoding="utf-8")
    (tmp_path / "empty.json").write_text("{}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        from fieldloom.sources import json_maps

        text = json_maps.entries(spark, str(tmp_path / "*.json"))
        got = {}
        for r in text.collect():
            got.setdefault(r.file.split("/")[-1], []).append((r.place, json.loads("{" + r.text + "}")))
        for name, d in made.items():
            assert [e for _, e in sorted(got[name], key=lambda x: x[0])] == [{k: v} for k, v in d.items()]
        assert set(got) == set(made)
        if block == 900:
            assert spark.read.option("lineSep", "}").text(str(tmp_path / "d0.json")).rdd.getNumPartitions() > 5
        boxes = readers.read_boxes(spark, str(tmp_path / "d0.json"))
        want = sum(not x["deleted"] for v in made["d0.json"].values() for x in v["detections"])
        assert boxes.count() == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_arrays_and_contours_are_cut(spark, tmp_path):
    records = [{"kernel_name": f"k{i}}}", "bottom": [1.0, i], "axis_length": i or None} for i in range(60)]
    contours = {f"k[{i}]": [[float(j), float(i)] for j in range(i % 7)] for i in range(60)}
    (tmp_path / "a.json").write_text(json.dumps(records))
    (tmp_path / "c.json").write_text(json.dumps(contours, separators=(",", ":")))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 200)
    try:
        axes = sorted((r.kernel_name, r.bottom, r.axis_length) for r in readers.read_axes(spark, str(tmp_path / "a.json")).collect())
        assert axes == sorted((r["kernel_name"], r["bottom"], r["axis_length"] or 0.0) for r in records)
        got = {r.kernel_name: [[p.x, p.y] for p in r.c] for r in readers.read_contours(spark, str(tmp_path / "c.json")).collect()}
        assert got == contours
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_one_document_from_many_tasks(spark, tmp_path):
    rows = [(f'k"{i:03d}', i, [1.0, float(i)], None if i % 3 else "x, }") for i in range(200)]
    df = spark.createDataFrame(rows, "name string, n int, p array<double>, note string").repartition(7)
    whole = lambda r: {k: v for k, v in zip(("name", "n", "p", "note"), r, strict=True) if v is not None}
    sinks.write_json_document(df, f"{tmp_path}/a.json", order="n")
    assert json.loads((tmp_path / "a.json").read_text()) == [whole(r) for r in rows]
    sinks.write_json_document(df, f"{tmp_path}/m.json", key="name")
    got = json.loads((tmp_path / "m.json").read_text())
    assert got == {r[0]: {k: v for k, v in whole(r).items() if k != "name"} for r in rows} and list(got) == sorted(got)
    sinks.write_json_document(df.limit(0), f"{tmp_path}/a.json")
    assert json.loads((tmp_path / "a.json").read_text()) == []
    assert sorted(f.name for f in tmp_path.iterdir() if not f.name.startswith(".")) == ["a.json", "m.json"]


def test_only_the_lots_of_wanted_images_are_opened(spark, tmp_path):
    path = f"{tmp_path}/contours"
    rows = [(f"img{i}.jpg", k, [(float(k), float(i))]) for i in range(300) for k in range(3)]
    df = spark.createDataFrame(rows, "image_name string, kernel int, c array<struct<x:double,y:double>>")
    sinks.write_by_image(df, path, lots=32)
    wanted = spark.createDataFrame([("img7.jpg",), ("img7.jpg",), ("img250.jpg",), ("none.jpg",)], "image_name string")
    got = readers.objects_of(spark, path, wanted, lots=32)
    assert sorted((r.image_name, r.kernel, r.c[0].y) for r in got.collect()) == sorted((n, k, c[0][1]) for n, k, c in rows if n in ("img7.jpg", "img250.jpg"))
    assert re.search(r"PartitionFilters: \[[^\]]*lot", got._jdf.queryExecution().executedPlan().toString())
    # The scan lists the folders that its partition filter leaves.
    assert "PartitionFilters" in got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert len([f for f in (tmp_path / "contours").iterdir() if f.name.startswith("lot=")]) == 32
    every = spark.createDataFrame([(n,) for n, *_ in rows], "image_name string")
    assert readers.objects_of(spark, path, every, lots=32).count() == len(rows)


def test_a_whole_result_folder(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([("k1", 2.0)], "kernel string, size double"), f"{tmp_path}/sizes.csv")
    (tmp_path / "boxes.json").write_text(json.dumps({"a.jpg": {"accepted_boxes": [[1, 2, 3, 4]]}}))
    (tmp_path / "profiles.txt").write_text("p " + " ".join(["1.0"] * 25) + "\n")
    others = {"boxes": ("boxes.json", readers.read_boxes), "profiles": ("profiles.txt", readers.read_profiles), "contours": ("contours.json", readers.read_contours)}
    got = readers.read_results(spark, str(tmp_path), "sizes", {"plants": "plants"}, {"sizes": "kernel string, size double", "plants": "plant string"}, others)
    assert got["ok"] and got["errors"] == [] and sorted(got["warnings"]) == ["contours is missing", "plants is missing"]
    assert got["tables"]["boxes"].first().box == [1, 2, 3, 4] and len(got["tables"]["profiles"].first().w) == 25 and got["tables"]["sizes"].count() == 1
