"""Worked examples, ordered logic against loops, invariants, files."""

import math
import os
import random
import time
import tracemalloc
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import geometry as geo
from fieldloom.functions import numeric as num
from fieldloom.functions import profile as prof
from fieldloom.functions import text as tx
from fieldloom.operators import axes, boxes, components_analysis, stats, traits
from fieldloom.plans import fixtures as fx
from fieldloom.plans import queries as plans
from fieldloom.sources import config, readers, sinks
from fieldloom.streaming import files


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


@pytest.mark.parametrize(("text", "label"), [("24-05-SZ-CG-OO77-O3", "24-05-SZ-CG-0077-03"), ("24-05-SZ-CG-C077-03", "24-05-SZ-CG-0077-03")])
def test_labels(spark, text, label):
    assert one(spark, tx.normalise_label(F.lit(text))) == label


@pytest.mark.parametrize(("digits", "weight"), [("1254", "12.54"), ("54", ".54"), ("5", "0.05")])
def test_digits(spark, digits, weight):
    assert one(spark, tx.digits_to_weight(F.lit(digits))) == weight


def test_names(spark):
    assert one(spark, tx.image_of_kernel(F.lit("IMG_14_kernel_001.jpg"))) == "IMG_14.jpg"
    assert one(spark, tx.kernel_number(F.lit("x/IMG_14_kernel_001.jpg"))) == 1
    assert one(spark, tx.kernel_number(F.lit("IMG_14.jpg"))) is None
    assert one(spark, tx.sanitise(F.lit("..a b:c._"))) == "a_b_c"
    assert one(spark, tx.sanitise(F.lit(None).cast("string"))) == "UNKNOWN"
    assert one(spark, tx.parse_box(F.lit("1, 2,3.5,4"))) == [1.0, 2.0, 3.5, 4.0]
    assert one(spark, tx.parse_box(F.lit("1,2,x,4"))) is None


def test_angles(spark):
    assert one(spark, num.directed_gap(F.lit(359.0), F.lit(1.0))) == pytest.approx(2)
    assert one(spark, num.undirected_gap(F.lit(179.0), F.lit(1.0))) == pytest.approx(2)
    assert one(spark, num.unit(F.lit(0.0), F.lit(0.0))) is None
    assert one(spark, num.point_to_segment(F.lit(3.0), F.lit(4.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))) == pytest.approx(5)


def circle(n=360, r=10.0):
    return F.array(*[F.struct(F.lit(r * math.cos(2 * math.pi * i / n)).alias("x"), F.lit(r * math.sin(2 * math.pi * i / n)).alias("y")) for i in range(n)])


def test_circle(spark):
    df = spark.range(1).select(circle().alias("c"))
    row = df.select(geo.signed_area(F.col("c")).alias("a"), geo.perimeter(F.col("c")).alias("p"), geo.centroid(F.col("c")).alias("m")).first()
    assert row.a == pytest.approx(math.pi * 100, rel=1e-3)
    assert 4 * math.pi * row.a / row.p**2 == pytest.approx(1, abs=1e-3)
    assert abs(row.m.x) < 1e-9
    at = lambda y: F.struct(F.lit(0.0).alias("x"), F.lit(y).alias("y"))
    assert df.select(geo.width_at(F.col("c"), at(-10.0), at(10.0), 0.5)).first()[0] == pytest.approx(20, rel=1e-3)
    assert max(map(abs, df.select(geo.circle_deviation(F.col("c"))).first()[0])) < 1e-9


def test_profiles(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "w array<double>")
    assert df.select(prof.gaussian(F.col("w"))).first()[0][0] == 1.0
    assert df.select(prof.iou(F.col("w"), F.col("w"))).first()[0] == 1.0
    assert df.select(prof.rmse(F.col("w"), F.col("w"))).first()[0] == 0.0
    zero = spark.createDataFrame([([0.0, 0.0],)], "w array<double>")
    assert zero.select(prof.iou(F.col("w"), F.col("w"))).first()[0] == 0.0
    assert zero.select(prof.mostly_empty(F.col("w"))).first()[0]
    assert df.select(prof.outline(F.col("w"), True)).first()[0][0].x == 0.0
    assert df.select(prof.trimmed_mean(F.array(F.lit(1.0), F.lit(float("nan")), F.lit(5.0), F.lit(3.0)), 0.4)).first()[0] == 2.0


def rows_by_image(df):
    out = {}
    for row in df.collect():
        out.setdefault(row.image_no, []).append(row)
    return out


def test_suppression_against_a_loop(spark, small):
    df = fx.box(spark, small)
    pairs = rows_by_image(boxes.overlap_pairs(df))
    want = set()
    for image, bs in rows_by_image(df).items():
        area = {b.box_id: (b.x2 - b.x1) * (b.y2 - b.y1) for b in bs}
        sides = {b.box_id: sorted((b.x2 - b.x1, b.y2 - b.y1)) for b in bs}
        by_id = {b.box_id: b for b in bs}
        ma, ms, ml = (float(np.median(v)) for v in (list(area.values()), [s[0] for s in sides.values()], [s[1] for s in sides.values()]))

        def odd(i, area=area, sides=sides, by_id=by_id, m=(ma, ms, ml)):
            return abs(math.log(area[i] / m[0])) + 0.45 * abs(math.log(sides[i][1] / m[2])) + 0.45 * abs(math.log(sides[i][0] / m[1])) - 0.25 * by_id[i].conf

        gone = set()
        for p in sorted(pairs.get(image, []), key=lambda p: (-p.overlap, -p.ratio, p.a_box_id, p.b_box_id)):
            a, b = p.a_box_id, p.b_box_id
            if a in gone or b in gone:
                continue
            small_, large = (a, b) if area[a] <= area[b] else (b, a)
            if area[small_] < 0.35 * ma:
                gone.add(small_)
            elif area[large] > 3 * ma:
                gone.add(large)
            elif abs(odd(a) - odd(b)) > 0.05:
                gone.add(a if odd(a) > odd(b) else b)
            elif abs(by_id[a].conf - by_id[b].conf) > 0.05:
                gone.add(a if by_id[a].conf < by_id[b].conf else b)
            else:
                gone.add(large)
        for b in sorted(bs, key=lambda b: (-area[b.box_id], b.box_id)):
            if b.box_id in gone or area[b.box_id] < 1.25 * ma:
                continue
            inside = [o for o in bs if o.box_id not in gone and o is not b and b.x1 <= (o.x1 + o.x2) / 2 <= b.x2 and b.y1 <= (o.y1 + o.y2) / 2 <= b.y2]
            if len(inside) >= 2:
                gone.add(b.box_id)
        want |= {(image, i) for i in gone}
    got = [tuple(x) for x in boxes.suppress_nested(df).select("image_no", "box_id").collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_reading_order_against_a_loop(spark, small):
    df = fx.box(spark, small)
    got = {(x.image_no, x.box_id): x.place for x in boxes.reading_order(df).collect()}
    for image, bs in rows_by_image(df).items():
        reach = max(10.0, 0.6 * float(np.median([b.y2 - b.y1 for b in bs])))
        rows = []
        for cy, cx, i in sorted(((b.y1 + b.y2) / 2, (b.x1 + b.x2) / 2, b.box_id) for b in bs):
            for row in rows:
                if abs(row["sum"] / len(row["items"]) - cy) <= reach:
                    break
            else:
                row = {"sum": 0.0, "items": []}
                rows.append(row)
            row["sum"] += cy
            row["items"].append((cx, i))
        order = [i for _, _, row in sorted((r["sum"] / len(r["items"]), k, r) for k, r in enumerate(rows)) for _, i in sorted(row["items"])]
        assert [i for _, i in sorted((got[image, i], i) for i in order)] == order


def test_digits_against_a_loop(spark, small):
    df = fx.digit(spark, small)
    got = {x.image_no: x.digits for x in boxes.unique_digits(df).collect()}
    for image, ds in rows_by_image(df).items():
        ds, gone = sorted(ds, key=lambda b: b.box_id), set()
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                if a.box_id in gone:
                    break
                if b.box_id in gone:
                    continue
                share = max(0.0, min(a.x2, b.x2) - max(a.x1, b.x1)) * 20 / 240
                if share > 0.8:
                    gone.add(b.box_id if a.conf >= b.conf else a.box_id)
        assert got[image] == "".join(b.digit for b in sorted(ds, key=lambda b: (b.x1, b.box_id)) if b.box_id not in gone and b.digit.isdigit())


def test_every_event_is_a_digit(spark, small):
    events = {x.event_id for x in fx.table(spark, small, "events").select("event_id").collect()}
    assert {x.box_id for x in fx.digit(spark, small).collect()} == events
    assert {x.image_no for x in plans.QUERIES["digit_reading"](spark, small).collect()} == {i % 2000 for i in events}


def test_axis_merge_against_a_loop(spark):
    rows = [(k, c, float((c * 37 + k * 11) % 180), float((c * 5 + k) % 7), [None, "", "pca", "moments", "scan"][(c + k) % 5]) for k in range(20) for c in range(12)]
    got = {}
    for r in boxes.merge_axes(spark.createDataFrame(rows, "key long, candidate long, angle double, length double, source string")).collect():
        got.setdefault(r.key, {})[r.candidate] = r.merged
    for k in range(20):
        kept = []
        for _, c, angle, _, source in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[3], r[1])):
            for one_ in kept:
                d = (one_[1] - angle) % 180
                if min(d, 180 - d) < 10:
                    one_[2] |= {source} - {None, ""}
                    break
            else:
                kept.append([c, angle, {source} - {None, ""}])
        assert got[k] == {c: max(1, len(n)) for c, _, n in kept}


def test_components(spark, small):
    df = plans._vectors(spark, small)
    x = np.vstack([r.v for r in df.collect()])
    _, _, load, percent = components_analysis.principal_components(df, "v", x.shape[1])
    assert percent.sum() == pytest.approx(100)
    assert np.allclose(load.T @ load, np.eye(len(load)), atol=1e-8)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    lam = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    assert np.allclose(percent, 100 * lam / lam.sum())
    s = components_analysis.scores(df, "vec_id", "v", 3).toPandas()
    assert np.allclose(s[["pc1", "pc2", "pc3"]].std(ddof=1) ** 2, lam[:3])
    with pytest.raises(ValueError):
        components_analysis.principal_components(df.limit(2), "v", 1)


def test_splits_cover(spark):
    got = stats.split_sets(spark.range(97), "id", (0.8, 0.1), "s").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 77, "val": 9, "test": 11}


def test_anti_guard(spark):
    labels = spark.createDataFrame([(1,), (2,)], "k int")
    assert traits.without_deleted(labels, spark.createDataFrame([], "k int"), "k").count() == 2
    assert [r.k for r in traits.without_deleted(labels, spark.createDataFrame([(2,)], "k int"), "k").collect()] == [2]


def test_weights(spark):
    df = spark.createDataFrame([("12.5", 4), ("x", 4), ("1", 0)], "w string, n int")
    assert [r[0] for r in df.select(traits.weight_each(F.col("w"), F.col("n"))).collect()] == [3.125, None, None]


def test_config():
    assert config.overlay({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}}) == {"a": {"b": 9, "c": 2}, "d": 3}
    assert config.stages_from(["a", "b", "c"], start="b") == ["b", "c"]
    assert config.stages_from(["a", "b"], only="b") == ["b"]


def test_box_files(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"i.jpg": {"detections": [{"kernel_id": 2, "box": [1,2,3,4]}, {"kernel_id": 1, "box": [5,6,7,8], "deleted": true}]}, "j.jpg": {"accepted_boxes": [[1,1,2,2],[3,3,4,4]]}}')
    got = [tuple(r) for r in readers.read_boxes(spark, str(tmp_path / "b.json")).orderBy("image_name", "kernel_id").collect()]
    assert got == [("i.jpg", 2, [1, 2, 3, 4]), ("j.jpg", 1, [1, 1, 2, 2]), ("j.jpg", 2, [3, 3, 4, 4])]
    (tmp_path / "a.json").write_text('[{"kernel_name": "k", "axis_length": 3.0}]')
    assert readers.read_axes(spark, str(tmp_path / "a.json")).first().area == 0.0
    (tmp_path / "c.json").write_text('{"k": [[0,0],[1,0],[1,1]]}')
    assert len(readers.read_contours(spark, str(tmp_path / "c.json")).first().c) == 3


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 2.5] * 15), ("b", [3.0, None] * 15)], "name string, w array<double>")
    sinks.write_profiles(df, str(tmp_path / "p"), "name", "w")
    assert [(r.name, len(r.w)) for r in readers.read_profiles(spark, str(tmp_path / "p")).collect() if len(r.w) == 30] == [("a", 30)]
    t = spark.createDataFrame([("x", 1.5), ("y", None)], "k string, v double")
    sinks.write_csv(t, str(tmp_path / "t.csv"))
    got = readers.parquet_or_csv(spark, str(tmp_path / "t"), "k string, v double")
    assert {tuple(r) for r in got.collect()} == {("x", 1.5), ("y", None)}
    sinks.write_parquet(t, str(tmp_path / "t.parquet"))
    gone = spark.createDataFrame([("x",)], "k string")
    sinks.swap_in(traits.delete_keys(spark.read.parquet(str(tmp_path / "t.parquet")), gone, "k"), str(tmp_path / "t.parquet"), str(tmp_path / "t.new"))
    assert [r.k for r in spark.read.parquet(str(tmp_path / "t.parquet")).collect()] == ["y"]
    sinks.write_latents(t.na.drop(), str(tmp_path / "l"), "k", ["v"])
    sinks.append_log(t, str(tmp_path / "log"))
    sinks.append_log(t, str(tmp_path / "log"))
    assert readers.read_csv(spark, str(tmp_path / "log"), "k string, v double").count() == 4
    out = readers.read_results(spark, str(tmp_path), "t", {"other": "other"}, {"t": "k string, v double", "other": "k string"})
    assert out["ok"] and out["warnings"] == ["other is missing"]


def test_stream_gives_batch_rows(spark, tmp_path):
    src = tmp_path / "in"
    spark.range(10).write.parquet(str(src))
    step = lambda df: df.where("id % 2 = 0")
    for _ in range(2):
        q = files.incremental(spark, str(src), "id long", step, str(tmp_path / "out"), str(tmp_path / "state"))
        q.awaitTermination(60)
        time.sleep(0.1)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 2, 4, 6, 8]


def test_minus_anywhere_makes_a_weight_negative(spark):
    rows = spark.createDataFrame([(t,) for t in ("5-3.1", "12-", "-4", "1--2", "7.5", "--", "")], "t string")
    got = [r[0] for r in rows.select(tx.normalise_weight(F.col("t"))).collect()]
    assert got == ["-53.1", "-12", "-4", "-12", "7.5", "-", ""]


def test_image_names_are_cut_at_the_last_mark(spark):
    names = ["a_kernel_001.jpg", "a_kernel_x.jpg", "a_kernel_1_kernel_2.png", "a_kernel_1", "b.jpg", "x_kernel_1.b.jpg", "d/a_kernel_3.tif", "a.x_kernel_1", ".a_kernel_1", "kernel_1.jpg"]

    def image(name):
        stem, suffix = os.path.splitext(name)
        return stem.rsplit("_kernel_", 1)[0] + suffix if "_kernel_" in stem else name

    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(tx.image_of_kernel(F.col("n"))).collect()]
    assert got == [image(n) for n in names]


def test_nothing_to_divide_by(spark):
    one = spark.range(1).select(F.array().cast("array<double>").alias("none"), F.array(F.lit(3.0)).alias("single"), F.array(F.lit(1.0), F.lit(2.0)).alias("two"))
    row = one.select(
        prof.mostly_empty(F.col("none")).alias("empty"), prof.peak_percent(F.col("single")).alias("peak"), prof.to_axis(F.col("two"), F.lit(0.0)).alias("kept"), prof.to_axis(F.col("two"), F.lit(50.0)).alias("scaled"),
        num.axis_gap(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("gap"), num.axis_gap(F.lit(1.0), F.lit(1.0), F.lit(-2.0), F.lit(0.0)).alias("some"),
    ).first()
    assert (row.empty, row.peak, row.kept, row.scaled, row.gap) == (False, 0.0, [1.0, 2.0], [2.0, 4.0], None)
    assert row.some == pytest.approx(45)


def test_histogram_of_equal_values(spark):
    rows = spark.createDataFrame([(4.0,)] * 7 + [(None,)], "v double")
    assert [tuple(r) for r in stats.histogram(rows, "v", 40).collect()] == [(20, 7)]
    assert np.histogram([4.0] * 7, 40)[0].tolist().index(7) == 20
    assert stats.histogram(rows.limit(0), "v", 40).count() == 0


@pytest.mark.parametrize("n", [1, 5, 15, 25, 35, 45, 65, 97])
def test_rounded_split_sizes(spark, n):
    got = Counter(r.split for r in stats.split_sets(spark.range(n), "id", (0.7, 0.2), "s", rounded=True).collect())
    test, val = max(1, round(n * 0.10)), max(1, round(n * 0.20))
    assert got["train"] == max(0, n - test - val)
    if n > 2:
        assert (got["val"], got["test"]) == (val, test)


def test_running_best_with_a_plateau(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, rng.choice([5.0, 4.0, None]) if i < 30 else 4.0) for i in range(200)]
    ranges = stats.in_ranges
    for per_range in (200_000, 17):
        monkeypatch.setattr(stats, "in_ranges", partial(ranges, rows=per_range))
        got = {r.step: (r.best, r.stall) for r in stats.running_best(spark.createDataFrame(rows, "step long, loss double"), "step", "loss").collect()}
        best = None
        for i, v in rows:
            if v is not None and (best is None or v < best[0]):
                best = (v, i)
            assert got[i] == ((best[0], i - best[1]) if best else (None, None))


def test_boxes_meet_in_cells_as_in_loops():
    from fieldloom.functions.cells import Grid

    rng = np.random.default_rng(9)
    for spread, size in ((40, 10), (1000, 5), (10, 300), (0, 4)):
        image = np.sort(rng.integers(0, 4, 150))
        x1, y1 = rng.uniform(0, spread + 1e-3, (2, 150)).round(1)
        x2, y2 = x1 + rng.uniform(0, size, 150).round(1), y1 + rng.uniform(0, size, 150).round(1)
        x1[0], x2[0], y1[0], y2[0] = -500, 900, -500, 900  # one that covers all
        grid = Grid(image, x1, y1, x2, y2)
        pairs = sorted(zip(*(a.tolist() for a in grid.meeting()), strict=True))
        assert pairs == [(i, j) for i in range(150) for j in range(i + 1, 150) if image[i] == image[j] and x1[i] < x2[j] and x1[j] < x2[i] and y1[i] < y2[j] and y1[j] < y2[i]]
        held = sorted(zip(*(a.tolist() for a in grid.holding()), strict=True))
        mx, my = (x1 + x2) / 2, (y1 + y2) / 2
        assert held == [(i, j) for i in range(150) for j in range(150) if i != j and image[i] == image[j] and x1[i] <= mx[j] <= x2[i] and y1[i] <= my[j] <= y2[i]]
    assert [len(a) for a in Grid(np.zeros(0, int), *np.zeros((4, 0))).meeting()] == [0, 0]


def test_boxes_that_are_apart_are_no_pairs(spark):
    """A row of a thousand boxes makes as many pairs as have neighbours, and images take one exchange."""
    rows = [(1, i, 9.0 * i, 0.0, 9.0 * i + 10, 10.0, 0.5) for i in range(1000)]
    df = spark.createDataFrame(rows, "image_no long, box_id long, x1 double, y1 double, x2 double, y2 double, conf double")
    pairs = boxes.overlap_pairs(df, 0.05, 1.0)
    assert pairs.count() == 999
    assert pairs._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_nearest_within(spark):
    rng = random.Random(8)
    points = [(rng.randrange(3), i, rng.uniform(-500, 500), rng.uniform(-500, 500)) for i in range(200)] + [(1, 900, 10.0, 10.0), (1, 901, 10.0, 10.0)]
    queries = [(rng.randrange(4), i, rng.uniform(-600, 600), rng.uniform(-600, 600)) for i in range(60)] + [(1, 99, 10.0, 10.0)]
    got = {(r.image_no, r.line_id): r.box_id for r in boxes.nearest_within(spark.createDataFrame(queries, "image_no long, line_id long, px double, py double"), spark.createDataFrame(points, "image_no long, box_id long, cx double, cy double"), 60.0).collect()}
    for image, line, px, py in queries:
        near = [((x - px) ** 2 + (y - py) ** 2, k) for i, k, x, y in points if i == image]
        assert got[image, line] == min((n for n in near if n[0] <= 3600), default=(0, None))[1]
    assert got[1, 99] == 900


def test_covariance_of_wide_arrays(spark):
    """512 elements, far from 0, over several blocks and tasks; a row isn't squared before it is summed."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 512)) @ np.diag(rng.uniform(0.1, 3, 512)) + 1e6
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)]
    df = spark.createDataFrame(rows, "k int, v array<double>").repartition(5)
    n, mean, cov = components_analysis.centred_sums(df, "v")
    assert n == 300 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T), rtol=1e-6, atol=1e-6)
    assert components_analysis.centred_sums(df.limit(0), "v")[0] == 0
    *_, load, percent = components_analysis.principal_components(df, "v", 3, scale=False)
    lam, vec = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(np.abs(load[:, 0]), np.abs(vec[:, -1]), atol=1e-5) and percent[0] == pytest.approx(100 * lam[-1] / lam.sum(), rel=1e-6)
    with pytest.raises(Exception, match="512 elements"):
        components_analysis.centred_sums(df.union(spark.createDataFrame([(1, [1.0])], "k int, v array<double>")), "v")


def test_boxes_are_looked_at_in_bounded_parts(monkeypatch):
    """Slices of whole images, about so many boxes each, whatever the batch holds."""
    monkeypatch.setattr(boxes, "TOGETHER", 50)
    many = [10] * 20 + [120] + [30] * 5 + [0, 1]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(many))), pa.array([list(range(n)) for n in many])], names=["image_no", "boxes"])
    parts = list(boxes._parts([batch, batch.slice(3, 4)]))
    assert [x for p in parts for x in p.column(0).to_pylist()] == [*range(len(many)), 3, 4, 5, 6]
    assert all(len(p) == 1 or len(p.column(1).flatten()) <= 50 for p in parts) and len(parts) < 15


def test_digits_that_cover_each_other_hold_no_pairs():
    """Four thousand boxes of one image, of which nearly all meet; a loop agrees."""
    rng = np.random.default_rng(4)
    x, sure = rng.integers(0, 6, 4000).astype(float), rng.random(4000).round(2)
    corners = (x, np.full(4000, 5.0), x + 12, np.full(4000, 25.0))
    tracemalloc.start()
    got = boxes._covered(corners, sure, 0.8)
    assert tracemalloc.get_traced_memory()[1] < 4e6
    tracemalloc.stop()
    few, gone = 300, np.zeros(300, bool)
    for i in range(few):
        for j in range(i + 1, few):
            if not gone[i] and not gone[j] and max(0, 12 - abs(x[i] - x[j])) / 12 > 0.8:
                gone[j if sure[i] >= sure[j] else i] = True
    assert boxes._covered(tuple(c[:few] for c in corners), sure[:few], 0.8).tolist() == gone.tolist() and 0 < (~got).sum() < 10


def test_label_of_thousands_of_lines(spark):
    """The label over all lines is as long as they are many."""
    lines = spark.range(20000).select(F.lit(1).alias("image_no"), F.col("id").alias("line"), F.lit("AB-C").alias("text"), F.lit(0.5).alias("conf"), F.col("id").cast("double").alias("y"), F.lit(0.0).alias("x"))
    got = traits.read_labels(lines).first()
    assert got.label == "AB-C" * 20000 and got.score == 50.0


def test_side_areas_at_their_bounds(spark):
    """Pixels a quarter from the line count as their distance says, also where it is next to level."""
    runs, lines, want = [], [], []
    for key, (angle, ax, ay) in enumerate([(180, 150.5, 20.25), (180, 150.5, 20.75), (0, 150.5, 20.25), (90, 150.25, 20.5), (270, 150.75, 20.5), (37, 150.5, 20.25), (217, 148.5, 22.25)]):
        ux, uy = math.cos(math.radians(angle)), math.sin(math.radians(angle))
        own = [(y, x0, n) for y in range(17, 25) for x0, n in ((140, 20), (151, 3), (300, 40))]
        runs += [(key, *q) for q in own]
        lines.append((key, 0, (ax, ay), (0.0, 0.0), (ux, uy)))
        d = [-(x - ax) * uy + (y - ay) * ux for y, x0, n in own for x in range(x0, x0 + n)]
        want.append((key, sum(v < -0.25 for v in d), sum(v > 0.25 for v in d)))
    point = "struct<x:double,y:double>"
    got = axes.side_areas(spark.createDataFrame(runs, "key long, y long, x0 long, length long"), spark.createDataFrame(lines, f"key long, candidate long, at {point}, bottom {point}, top {point}"), "key")
    assert sorted((r.key, r.left, r.right) for r in got.collect()) == want


def test_rounding_next_to_a_half(spark):
    """Rounded as the SQL rounds: by the scaled value, on either side of zero."""
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(8)
    values = [float(np.nextafter((k + 0.5) / 1e5, side)) for k in rng.integers(0, 10**5, 200).tolist() for side in (-9, 9)] + [(k + 0.5) / 1e5 for k in range(300)] + [-0.381875, 0.38187499999999996, float("nan")]
    got = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select("v", plans.places(F.col("v"), 5).alias("r")).collect()
    want = duckdb.connect().execute("select round(unnest(?::double[]), 5)", [values]).fetchall()
    assert [str(x.r) for x in got] == [str(float("nan") if w is None else w) for (w,) in want]
