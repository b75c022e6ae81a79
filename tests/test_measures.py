"""Measurements, the detection chain, axis candidates, labels, latents and files, against loops and worked cases."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import geometry as geo
from fieldloom.functions import numeric as num
from fieldloom.functions import text as tx
from fieldloom.operators import boxes, components_analysis, stats, traits
from fieldloom.plans import measures
from fieldloom.plans import queries as plans
from fieldloom.sources import readers, sinks


def outline(spark, points):
    return spark.createDataFrame([([(float(x), float(y)) for x, y in points],)], "c array<struct<x:double,y:double>>")


def point(x, y):
    return F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))


def test_area_has_no_sign(spark):
    square = [(0, 0), (0, 1), (1, 1), (1, 0)]
    for ring in (square, square[::-1], [*square, (1e-8, 0)]):
        df = outline(spark, ring).select(geo.opened(F.col("c")).alias("c"))
        row = df.select(F.size("c").alias("n"), geo.area(F.col("c")).alias("a"), geo.perimeter(F.col("c")).alias("p")).first()
        assert (row.n, row.a, row.p) == (4, pytest.approx(1), pytest.approx(4))


def test_crossings_within_a_pixel_count_once(spark):
    assert spark.range(1).select(geo.merged(F.array(*map(F.lit, [5.0, 0.0, 0.8, 1.2, 9.0])))).first()[0] == [0.8, 5.0, 9.0]
    thin = outline(spark, [(0, 0), (0.4, 0), (0.4, 100), (0, 100)])
    assert thin.select(geo.width_at(F.col("c"), point(0.2, 0), point(0.2, 100), 0.5)).first()[0] == 0.0


def test_bundle_of_a_rectangle(spark):
    """Twice as long as wide, with a notch near the top end, from which the quarters count."""
    ring = [(-20, 0), (20, 0), (20, 70), (5, 75), (20, 80), (20, 100), (-20, 100), (-20, 80), (-5, 75), (-20, 70)]
    b = outline(spark, ring).select(geo.bundle(F.col("c"), point(0, 0), point(0, 100)).alias("b")).first().b
    assert (b.axis_length, b.width_25pct, b.width_50pct, b.width_75pct, b.max_width) == (100, pytest.approx(10), 40, 40, 40)
    assert b.length_width_ratio == pytest.approx(2.5) and b.area == pytest.approx(4000 - 2 * 75)
    short = outline(spark, ring).select(geo.bundle(F.col("c"), point(0, 0), point(0, 0.5)).alias("b")).first().b
    assert (short.width_50pct, short.max_width, short.length_width_ratio) == (0, 0, None)
    line = outline(spark, [(0, 0), (10, 0), (20, 0)]).select(geo.bundle(F.col("c"), point(0, 0), point(20, 0)).alias("b")).first().b
    assert line.area == 0 and line.eccentricity == pytest.approx(1)


def test_axis_ends(spark):
    ring = outline(spark, [(-20, -5), (20, -5), (20, 5), (-20, 5)])
    e = ring.select(geo.axis_ends(F.col("c"), point(1, 0), F.lit(0.0)).alias("e")).first().e
    assert (e.a.x, e.b.x, e.length) == (pytest.approx(-20), pytest.approx(20), pytest.approx(40))
    m = ring.select(geo.model_axis(F.col("c"), point(0, 0), F.lit(180.0)).alias("m")).first().m
    assert (m.bottom.x, m.top.x) == (pytest.approx(-20), pytest.approx(20))
    far = ring.select(geo.axis_ends(F.col("c"), point(0, 50), F.lit(0.0)).alias("e"), geo.model_axis(F.col("c"), point(0, 50), F.lit(0.0)).alias("m")).first()
    assert far.e is None and far.m.bottom.x == 20
    scan = ring.select(geo.axis_scan(F.col("c"), point(0, 0)).alias("s")).first().s
    assert len(scan) == 180 and max(scan).angle in (14.0, 166.0) and min(scan).angle == 90.0


def test_bottom_is_the_sharper_and_narrower_end(spark):
    """A drop: a point at the left, a round end at the right."""
    drop = [(-60, 0), *[(20 * math.cos(t), 20 * math.sin(t)) for t in np.linspace(-1.9, 1.9, 39)]]
    df = outline(spark, drop)
    size = len(drop)
    score = lambda p, q: geo.bottom_score(geo.tip_sharpness(F.col("c"), geo.nearest_index(F.col("c"), p), size), geo.support_widths(F.col("c"), p, q))
    left, right = df.select(score(point(-60, 0), point(20, 0)).alias("l"), score(point(20, 0), point(-60, 0)).alias("r")).first()
    assert left > right
    assert geo.windows(64) == [5, 10] and geo.windows(360) == [5, 10, 18] and geo.windows(6) == [1]


def test_null_confidence_and_slivers(spark):
    rows = [(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 2, 0.0, 0.0, 10.0, 0.0, 0.9), (1, 3, 1.0, 1.0, 9.9, 9.9, None), (1, 4, 0.0, 0.0, 12.0, 12.0, 0.5)]
    df = spark.createDataFrame(rows, "image_no long, box_id long, x1 double, y1 double, x2 double, y2 double, conf double")
    assert sorted(r.box_id for r in boxes.suppress_nested(df).collect()) == [3, 4]
    assert spark.range(1).select(num.size_gap(F.lit(0.0), F.lit(3.0))).first()[0] == 0.0


def test_centres_on_the_border_count(spark):
    rows = [(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 9.0, 4.0, 11.0, 6.0), (1, 3, 4.0, 9.0, 6.0, 11.0)]
    df = spark.createDataFrame(rows, "image_no long, box_id long, x1 double, y1 double, x2 double, y2 double")
    assert [tuple(r) for r in boxes.holding_centres(df).collect()] == [(1, 1, 2)]


def chain(bs, tray):
    """The chain over one image's boxes (id, x1, y1, x2, y2, conf) on a canvas of 1000 by 700: id to (reasons, place)."""
    out, reasons = {}, {b[0]: [] for b in bs}
    region = None
    if tray:
        pad = round(min(tray[2] - tray[0], tray[3] - tray[1]) * 0.005)
        region = (max(0, tray[0] - pad), max(0, tray[1] - pad), min(1000, tray[2] + pad), min(700, tray[3] + pad))
    size = lambda b: (b[3] - b[1]) * (b[4] - b[2])
    sides = lambda b: sorted((b[3] - b[1], b[4] - b[2]))
    centre = lambda b: ((b[1] + b[3]) / 2, (b[2] + b[4]) / 2)
    shared = lambda a, b: max(0, min(a[3], b[3]) - max(a[1], b[1])) * max(0, min(a[4], b[4]) - max(a[2], b[2]))
    active = []
    for b in bs:
        x, y = centre(b)
        if region:
            if not (region[0] <= x <= region[2] and region[1] <= y <= region[3]) or shared(b, (0, *region)) / size(b) < 0.55:
                reasons[b[0]].append("outside_tray")
                continue
            b = (b[0], max(b[1], region[0]), max(b[2], region[1]), min(b[3], region[2]), min(b[4], region[3]), b[5])
        elif b[1] <= 14 or b[2] <= 14 or b[3] >= 986 or b[4] >= 686:
            reasons[b[0]].append("near_image_edge")
            continue
        active.append(b)
    for b in active:
        if sides(b)[1] > 4 * max(sides(b)[0], 1):
            reasons[b[0]].append("bad_aspect_ratio")
    active = [b for b in active if not reasons[b[0]]]
    if active:
        ma, ms, ml = (float(np.median(v)) for v in ([size(b) for b in active], [sides(b)[0] for b in active], [sides(b)[1] for b in active]))
        if len(active) >= 8:
            for b in active:
                if size(b) < 0.35 * ma or sides(b)[1] < 0.45 * ml or sides(b)[0] < 0.45 * ms:
                    reasons[b[0]].append("too_small")
                if size(b) > 3 * ma or sides(b)[1] > 2.2 * ml or sides(b)[0] > 2.2 * ms:
                    reasons[b[0]].append("too_large")
        active = [b for b in active if not reasons[b[0]]]
        odd = lambda b: abs(math.log(size(b) / ma)) + 0.45 * abs(math.log(sides(b)[1] / ml)) + 0.45 * abs(math.log(sides(b)[0] / ms)) - 0.25 * b[5]
        pairs = []
        for i, a in enumerate(active):
            for b in active[i + 1 :]:
                least = max(1, min(size(a), size(b)))
                if shared(a, b) / least >= 0.86 and max(size(a), size(b)) / least >= 1.15:
                    pairs.append((-shared(a, b) / least, -max(size(a), size(b)) / least, a[0], b[0], a, b))
        for *_, a, b in sorted(pairs):
            if reasons[a[0]] or reasons[b[0]]:
                continue
            small_, large = (a, b) if size(a) <= size(b) else (b, a)
            if size(small_) < 0.35 * ma:
                gone = small_
            elif size(large) > 3 * ma:
                gone = large
            elif abs(odd(a) - odd(b)) > 0.05:
                gone = a if odd(a) > odd(b) else b
            elif abs(a[5] - b[5]) > 0.05:
                gone = a if a[5] < b[5] else b
            else:
                gone = large
            reasons[gone[0]].append("overlap_contained")
        left = [b for b in active if not reasons[b[0]]]
        for b in sorted(left, key=lambda b: (-size(b), b[0])):
            inside = [o for o in left if o is not b and not reasons[o[0]] and b[1] <= centre(o)[0] <= b[3] and b[2] <= centre(o)[1] <= b[4]]
            if not reasons[b[0]] and size(b) >= 1.25 * ma and len(inside) >= 2:
                reasons[b[0]].append("overlap_multi_center")
    kept = [b for b in active if not reasons[b[0]]]
    rows, place = [], {}
    reach = max(10.0, 0.6 * float(np.median([b[4] - b[2] for b in kept]))) if kept else 10.0
    for b in sorted(kept, key=lambda b: (centre(b)[1], centre(b)[0], b[0])):
        for row in rows:
            if abs(np.mean([centre(o)[1] for o in row]) - centre(b)[1]) <= reach:
                row.append(b)
                break
        else:
            rows.append([b])
    order = [b for row in sorted(rows, key=lambda r: float(np.mean([centre(o)[1] for o in r]))) for b in sorted(row, key=lambda b: (centre(b)[0], b[0]))]
    place = {b[0]: k for k, b in enumerate(order, 1)}
    for i, why in reasons.items():
        out[i] = (",".join(why), place.get(i))
    return out


def test_detection_chain_against_a_loop(spark, small):
    own, got = {}, {}
    for b in measures._detections(spark, small).collect():
        own.setdefault((b.image_no, b.tray is not None), []).append((b.box_id, b.x1, b.y1, b.x2, b.y2, b.conf))
    for x in plans.QUERIES["detection_chain"](spark, small).collect():
        got[x.image_no, x.box_id] = (x.reasons, x.final_id)
        assert x.kept == (x.reasons == "") == (x.final_id is not None)
    want = {}
    for (image, tray), bs in own.items():
        want |= {(image, i): v for i, v in chain(sorted(bs), (100, 80, 900, 620) if tray else None).items()}
    assert got == want
    assert len({w for v in want.values() for w in v[0].split(",")}) >= 6


def test_detection_chain_computes_its_boxes_once(spark, small):
    """No step of the chain goes back to the table, and boxes go through three exchanges at most."""
    plan = plans.QUERIES["detection_chain"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert plan.count("Exchange hashpartitioning") <= 3 and "Join" not in plan


def test_axis_choice_against_a_loop(spark, small):
    rows = {}
    for x in measures._candidates(spark, small).collect():
        rows.setdefault(x.key, []).append(x)
    got = {x.key: (x.candidate, x.reasons) for x in plans.QUERIES["axis_choice"](spark, small).collect()}
    apart = lambda a, b: min((a - b) % 180, 180 - (a - b) % 180)
    names = {"area": "area_balance_penalty", "width": "width_symmetry_penalty", "color": "color_symmetry_penalty", "endpoint": "endpoint_penalty"}
    for key, cs in rows.items():
        reference = float(np.percentile([c.length for c in cs], 90))
        low = max(3.0, 0.72 * reference)
        scored = []
        for c in cs:
            short = 0.0 if c.length >= reference else min(1.0, max(0.0, (reference - c.length) / max(reference - low, 1e-6))) if c.length >= low else 1.0
            total = 0.25 * c.area + 0.3 * c.width + 0.25 * c.color + 0.1 * short + 0.1 * c.endpoint
            scored.append((min(1.0, max(0.0, total)), -c.length, c.candidate, c))
        scored.sort(key=lambda x: x[:3])
        best, why = scored[0][3], []
        if len(scored) > 1 and scored[1][0] - scored[0][0] <= 0.035:
            why.append("top2_margin<=0.035")
        why += [f"{n}>=0.70" for k, n in names.items() if best[k] >= 0.7]
        for k in ("area", "width", "color"):
            other = min((x[3] for x in scored), key=lambda c: c[k])
            if best[k] - other[k] >= 0.12 and apart(best.angle, other.angle) >= 25:
                why.append(f"{names[k]}_winner_conflicts")
        assert got[key] == (best.candidate, "|".join(why)), key


def test_labels_from_lines(spark):
    rows = [
        (1, 1, "24-05-SZ-CG-0077-03", 0.7, 5.0, 1.0), (1, 2, "24-05-SZ-CG-0078-03", 0.9, 1.0, 1.0),  # the best line
        (2, 1, "-CG-0077", 0.8, 2.0, 1.0), (2, 2, "24-05", 0.6, 1.0, 1.0),  # only the lines together
        (3, 1, "NOTHING", 0.9, 1.0, 1.0),
        (4, 2, "B-1", 0.5, 1.0, 9.0), (4, 1, "A-", 0.4, 1.0, 2.0),  # one line of text in two parts, by x
    ]
    df = spark.createDataFrame(rows, "image_no long, line long, text string, conf double, y double, x double")
    got = {r.image_no: (r.label, r.score) for r in traits.read_labels(df).collect()}
    assert got == {1: ("24-05-SZ-CG-0078-03", pytest.approx(90 + 60 + 14 + 20)), 2: ("24-05-CG-0077", 60.0), 4: ("A-B-1", 40.0)}
    first = traits.first_source(df.where("image_no < 3"), df, "image_no")
    assert {(r.image_no, r.priority) for r in first.collect()} == {(1, 1.0), (2, 1.0), (3, 0.25), (4, 0.25)}


def test_label_query_against_a_loop(spark, small):
    got = {r.image_no: r.label for r in plans.QUERIES["label_reading"](spark, small).collect()}
    assert got and all(len(v.split("-")) >= 3 for v in got.values())
    valid = spark.createDataFrame([(v,) for v in got.values()], "label string").select(tx.label_valid(F.col("label")).alias("v")).collect()
    assert any(r.v for r in valid)


def test_scales_are_checked(spark):
    rows = [(0.05, 0.05), (0.06, 0.05), (None, 0.05), (0.05, None), (None, None)]
    df = spark.createDataFrame(rows, "m double, f double").select(traits.checked_scale(F.col("m"), F.col("f")).alias("s"))
    got = [tuple(r.s) if r.s else None for r in df.collect()]
    assert got == [(0.05, "detected", None), (0.06, "detected", "deviation"), (0.05, "fixed", "not detected"), (0.05, "detected", None), None]


def test_objects_without_group_keep_their_scale(spark):
    df = spark.createDataFrame([("a", "P", 1.0), ("b", "P", None), ("c", None, None), ("d", None, 3.0)], "kernel_name string, plant_name string, scale double")
    assert {r.kernel_name: r.scale_filled for r in traits.filled_scale(df).collect()} == {"a": 1.0, "b": 1.0, "c": None, "d": 3.0}


def share_by_sums(x, a, b, n=200_000):
    t = (np.arange(n) + 0.5) / n
    f = t ** (a - 1) * (1 - t) ** (b - 1)
    return f[t <= x].sum() / f.sum()


def test_p_values(spark):
    for t, df, p in ((2.0, 10, 0.07338803), (12.7062, 1, 0.05), (1.96, 1_000_000, 0.05), (0.0, 5, 1.0)):
        assert stats.beta_share(df / (df + t * t), df / 2, 0.5) == pytest.approx(p, rel=1e-3)
    assert stats.beta_share(0.3, 2.5, 3.5) == pytest.approx(share_by_sums(0.3, 2.5, 3.5), rel=1e-4)
    rows = [(float(i), float(i * 2 + (i % 3)), float((i * 7) % 5), None if i % 2 else float(i)) for i in range(12)]
    got = {(r.a, r.b): r for r in stats.correlation_tests(spark.createDataFrame(rows, "a double, b double, c double, d double"), ["a", "b", "c", "d"]).collect()}
    assert got["a", "b"].stars == "***" and got["a", "c"].stars == "" and got["a", "d"].n == 6
    assert got["a", "c"].r == pytest.approx(np.corrcoef([r[0] for r in rows], [r[2] for r in rows])[0, 1])
    tiny = stats.correlation_tests(spark.createDataFrame(rows[:2], "a double, b double, c double, d double"), ["a", "b"]).first()
    assert tiny.p is None


def test_splits_of_few(spark):
    for n, want in ((1, {"train": 1}), (2, {"train": 1, "val": 1}), (3, {"train": 2, "val": 1})):
        got = {r.split: r["count"] for r in stats.split_sets(spark.range(n), "id", (0.8, 0.1), "s").groupBy("split").count().collect()}
        assert sum(got.values()) == n and got["train"] >= 1 and got == want
    for n in (3, 4, 10, 97):
        got = {r.split: r["count"] for r in stats.split_sets(spark.range(n), "id", (0.7, 0.2), "s", rounded=True).groupBy("split").count().collect()}
        assert got == {"train": n - max(1, round(n * 0.2)) - max(1, round(n * 0.1)), "val": max(1, round(n * 0.2)), "test": max(1, round(n * 0.1))}


def test_loadings(spark, small):
    got = plans.QUERIES["pca_loadings"](spark, small).toPandas()
    x = np.vstack([r.v for r in plans._vectors(spark, small).collect()])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    lam, vec = np.linalg.eigh(np.cov(z.T))
    first = got[got.component == 1].sort_values("pos")
    assert np.allclose(np.abs(first.loading), np.abs(vec[:, -1]), atol=1e-6)
    assert first.place.iloc[0] == 0 and first.place.iloc[-1] == 1
    with pytest.raises(ValueError):
        components_analysis.principal_components(plans._vectors(spark, small).limit(0), "v", 1)


def test_files_of_results(spark, tmp_path):
    df = spark.createDataFrame([("i.jpg", 1, 2.5), ("j.jpg", 2, None)], "image_name string, n long, v double")
    sinks.write_json_array(df, str(tmp_path / "a"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "a")).collect()]
    assert sorted(json.loads(lines[0]), key=str) == [{"image_name": "i.jpg", "n": 1, "v": 2.5}, {"image_name": "j.jpg", "n": 2}]
    sinks.write_json_map(df, str(tmp_path / "m"), "image_name")
    assert json.loads(spark.read.text(str(tmp_path / "m")).first().value) == {"i.jpg": {"n": 1, "v": 2.5}, "j.jpg": {"n": 2}}
    sinks.write_points(outline(spark, [(1, 2), (3.25, 4.125)]).withColumn("k", F.lit("x")), str(tmp_path / "p"), "k", "c")
    assert spark.read.text(str(tmp_path / "p")).first().value == "x 1.00,2.00 3.25,4.12"
    sinks.append_log(df, str(tmp_path / "log"))
    sinks.append_log(df, str(tmp_path / "log"))
    log = readers.read_csv(spark, str(tmp_path / "log"), "image_name string, n long, v double")
    sinks.export_log(log, "n", str(tmp_path / "one"))
    assert [r.value.split(",")[0] for r in spark.read.text(str(tmp_path / "one")).collect()] == ["image_name", "i.jpg", "i.jpg", "j.jpg", "j.jpg"]
    sinks.backup(spark, str(tmp_path / "one"), str(tmp_path / "one.bak"))
    assert spark.read.text(str(tmp_path / "one.bak")).count() == 5


def test_deletes_reach_every_table(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame([("k1", 1), ("k2", 2)], "kernel_name string, v long").write.parquet(a)
    sinks.write_csv(spark.createDataFrame([("k1", "x"), ("k2", "y")], "name string, t string"), b)
    gone = spark.createDataFrame([("k1",)], "k string")
    sinks.delete_objects(spark, gone, {a: (spark.read.parquet(a), "kernel_name", None), b: (readers.read_csv(spark, b, "name string, t string"), "name", sinks.write_csv)})
    assert [r.kernel_name for r in spark.read.parquet(a).collect()] == ["k2"]
    assert [r.name for r in readers.read_csv(spark, b, "name string, t string").collect()] == ["k2"]
    # Broken off between the two renames, the old table comes back.
    (tmp_path / "a").rename(tmp_path / "a.old")
    assert sinks.recover(spark, a) and not sinks.recover(spark, a)
    assert spark.read.parquet(a).count() == 1


def test_records_of_images(spark, tmp_path):
    for n in ("b.jpg", "a.png", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    got = readers.image_records(spark, str(tmp_path))
    assert sorted((r.image_name, r.status) for r in got.collect()) == [("a.png", None), ("b.jpg", None)]
    assert [r.image_name for r in readers.image_records(spark, str(tmp_path), limit=1).collect()] == ["a.png"]
    labels = spark.createDataFrame([("a.jpg", "OK", "1", "0"), ("b.jpg", "ok", "3", "4"), ("b.jpg", "skip", "1", "0"), ("z.jpg", "ok", "1", "0")], "image_label string, status string, cos_theta string, sin_theta string")
    out = readers.labelled_images(labels, readers.image_files(spark, str(tmp_path)))
    assert sorted((r.image_label, r.path.rsplit("/", 1)[1], round(r.cos_theta, 6)) for r in out.collect()) == [("a.jpg", "a.png", 1.0), ("b.jpg", "b.jpg", 0.6)]
    sinks.write_latents(spark.createDataFrame([("p", *[0.1 * i for i in range(5)])], "plant_id string, " + ", ".join(f"latent_{i + 1} double" for i in range(5))), str(tmp_path / "z.csv"), "plant_id", [f"latent_{i + 1}" for i in range(5)])
    assert readers.read_latents(spark, str(tmp_path / "z.csv")).first().z == [0.0, 0.1, 0.2, 0.3, 0.4]


def test_ranges_change_nothing(spark, monkeypatch):
    """Exact quantiles, distributions and running bests are the same over many ranges as over one."""
    rng = np.random.default_rng(3)
    rows = [(int(k), float(v)) for k, v in zip(rng.integers(0, 3, 4000), rng.choice(rng.normal(size=300), 4000), strict=True)] + [(5, None), (6, 1.0)]
    df = spark.createDataFrame(rows, "k int, v double")
    log = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.normal(size=500).cumsum())], "step long, loss double")
    got = []
    for n in (10_000_000, 150):
        monkeypatch.setattr(stats, "ROWS_PER_RANGE", n)
        monkeypatch.setattr(stats.in_ranges, "__defaults__", (n,))
        monkeypatch.setattr(stats.quantiles, "__defaults__", (n, None if n > 150 else 0))
        q = {r.k: list(r.q) for r in stats.quantiles(df, ["k"], "v", [0, 0.1, 0.25, 0.5, 0.99, 1]).collect()}
        c = sorted((r.v, r.share) for r in stats.distribution(df.where("v is not null"), "v").collect())
        b = sorted((r.step, r.best, r.stall) for r in stats.running_best(log, "step", "loss").collect())
        got.append((q, c, b))
    assert got[0][1:] == got[1][1:] and got[0][0].keys() == got[1][0].keys()
    assert all(np.allclose(q, got[1][0][k]) for k, q in got[0][0].items())
    for k, q in got[1][0].items():
        assert np.allclose(q, np.quantile([v for x, v in rows if x == k], [0, 0.1, 0.25, 0.5, 0.99, 1]))
    best, at = math.inf, 0
    for (step, got_best, stall), r in zip(got[1][2], log.orderBy("step").collect(), strict=True):
        if r.loss < best:
            best, at = r.loss, r.step
        assert (got_best, stall) == (best, step - at)
    assert len({r[0] for r in stats.in_ranges(df, "v", 150).select("__range").distinct().collect()}) > 10


def test_names_match_without_a_broadcast(spark):
    stems = ["corn_12", "ab", "wheat", "a", "zz", "corn", "rice_b", "", "éé", "日本語", "aaaa"]
    images = [(f"i{k}", s, "x") for k, s in enumerate(stems)] + [("e", "q", "corn")]
    names = [("corn", 3), ("corn_1", 2), ("ab", 1), ("xwheatx", 5), ("ce_", 4), ("b", 9), ("é", 20), ("本語", 21), ("aaaaaaa", 22), ("zz", 30)]
    for profiles in (names, [*names, ("", 50)]):
        frame = traits.match_profile(spark.createDataFrame(images, "image_name string, stem string, plant_name string"), spark.createDataFrame(profiles, "name string, ord int"))
        got = {r.image_name: r.profile for r in frame.collect()}
        for image, stem, plant in images:
            near = [(o, n) for n, o in profiles if n in stem or stem in n]
            assert got[image] == (plant if plant in dict(profiles) else min(near)[1] if near else None)
    plan = frame._jdf.queryExecution().sparkPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def crossed(ring, at, u):
    """Places along u of a line's crossings with a ring, merged within a pixel."""
    n, hits = (-u[1], u[0]), []
    for p, q in zip(ring, np.roll(ring, -1, 0), strict=True):
        s, t = (p - at) @ n, (q - at) @ n
        if (s >= 0) != (t >= 0):
            hits.append((p + (q - p) * s / (s - t) - at) @ u)
    out = []
    for h in sorted(hits):
        if out and h - out[-1] <= 1:
            out[-1] = (out[-1] + h) / 2
        else:
            out.append(h)
    return out


def pointed(ring, i):
    """Sharpness round a point of a ring over the scales."""
    n, scores, weights = len(ring), [], []
    used = []
    for f in (1.0, 2.0, 3.5):
        w = max(1, min(round(5 * f), n // 6))
        if w in used:
            continue
        used.append(w)
        level, w = len(used) - 1, max(1, min(w, n // 8))
        values = []
        for k in range(n):
            a, b = ring[k - w] - ring[k], ring[(k + w) % n] - ring[k]
            values.append(1 - math.acos(np.clip(a @ b / np.linalg.norm(a) / np.linalg.norm(b), -1, 1)) / math.pi)
        r = max(2, round(2 * (1 + 0.6 * level)))
        near = sorted(values[(i + o) % n] for o in range(-r, r + 1))
        scores.append(0.65 * near[-1] + 0.35 * np.mean(near[-max(2, r + 1) :]))
        weights.append(1 / (1 + 0.5 * level))
    return float(np.average(scores, weights=weights))


def as_bottom(ring, p, q):
    u = (q - p) / np.linalg.norm(q - p)
    across = np.array([-u[1], u[0]])
    near, mid, upper = ((lambda h: h[-1] - h[0] if len(h) >= 2 else 0.0)(crossed(ring, p + f * (q - p), across)) for f in (0.12, 0.5, 0.75))
    over = lambda w: 1 - min(2.0, near / w) if w > 1e-6 else 0.0
    rising = 1.0 if near <= mid <= upper else 0.5 if near <= mid or near <= upper else 0.0
    return pointed(ring, int(np.argmin(np.linalg.norm(ring - p, axis=1)))) + 0.35 * (0.45 * over(mid) + 0.55 * over(upper)) + 0.15 * rising


def test_method_axes_against_loops(spark, small):
    rows = {}
    for x in plans.QUERIES["method_axes"](spark, small).collect():
        rows.setdefault(x.vec_id, {})[x.source] = x
    sources = ["moments_axis", "longest_centroid_chord", "shortest_centroid_chord"]
    for x in measures.fx.contour(spark, small).where("vec_id < 60").collect():
        ring = np.array([(p.x, p.y) for p in x.c])
        p, q = ring, np.roll(ring, -1, 0)
        cross = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
        at = ((p + q) * cross[:, None]).sum(0) / (3 * cross.sum())
        a, b = p - at, q - at
        cr = a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1]
        xx, yy = (((a * a + a * b + b * b) * cr[:, None]).sum(0) / 12)[:2]
        xy = ((a[:, 0] * b[:, 1] + 2 * a[:, 0] * a[:, 1] + 2 * b[:, 0] * b[:, 1] + b[:, 0] * a[:, 1]) * cr).sum() / 24
        angle = math.degrees(0.5 * math.atan2(2 * xy / abs(cross.sum()), (xx - yy) / abs(cross.sum()))) % 180 if cross.sum() > 0 else math.degrees(0.5 * math.atan2(-2 * xy, yy - xx)) % 180
        chords = []
        for d in range(180):
            h = crossed(ring, at, np.array([math.cos(math.radians(d)), math.sin(math.radians(d))]))
            if len(h) >= 2 and h[-1] - h[0] >= 1:
                chords.append((h[-1] - h[0], d))
        found = []
        for k, d in enumerate((angle, min((-length, d) for length, d in chords)[1], min(chords)[1])):
            u = np.array([math.cos(math.radians(d)), math.sin(math.radians(d))])
            h = crossed(ring, at, u)
            if len(h) < 2 or h[-1] - h[0] < 1:
                continue
            e, f = at + h[0] * u, at + h[-1] * u
            se, sf = as_bottom(ring, e, f), as_bottom(ring, f, e)
            bottom, top, score = (e, f, se) if se >= sf else (f, e, sf)
            v = top - bottom
            found.append((h[-1] - h[0], k, sources[k], math.degrees(math.atan2(v[1], v[0])) % 180, bottom, top, score, abs(se - sf)))
        kept = []
        if any(abs(min((a[3] - b[3]) % 180, (b[3] - a[3]) % 180) - 10) < 1e-6 for a in found for b in found):
            continue  # whole degrees that lie at the limit but for rounding
        for c in sorted(found, key=lambda c: (-c[0], c[1])):
            if not any(min((c[3] - o[3]) % 180, 180 - (c[3] - o[3]) % 180) < 10 for o in kept):
                kept.append(c)
        assert sorted(rows[x.vec_id]) == sorted(c[2] for c in kept), (x.vec_id, [c[:4] for c in found], [(r.source, r.angle, r.length) for r in rows[x.vec_id].values()])
        for c in kept:
            got = rows[x.vec_id][c[2]]
            assert (got.length, got.score) == (pytest.approx(c[0], abs=1e-3), pytest.approx(c[6], abs=1e-3))
            if c[7] > 1e-6:
                assert (got.bottom_x, got.bottom_y) == (pytest.approx(c[4][0], abs=1e-2), pytest.approx(c[4][1], abs=1e-2))


def test_fallback_axis(spark):
    bow = [(0, 0), (40, 10), (80, 0), (40, 14)]
    got = outline(spark, bow).select(geo.fallback_axis(F.col("c"), point(40, 100), 4).alias("x")).first().x
    assert {got.bottom.x, got.top.x} == {0, 80}
    ring = outline(spark, [(0, 0), (100, 0), (100, 50), (0, 50)])
    assert len(ring.select(geo.analysis_contour(F.col("c"), 360)).first()[0]) == 360
