"""Images: smoothing and thresholds against numpy, segmentation against its invariants, files, streams, and the whole chain."""

from __future__ import annotations

import numpy as np
import pytest
from mosaicell.functions import mz, quantiles
from mosaicell.operators import cells, clusters, image, threshold
from mosaicell.pipeline import Imaging
from mosaicell.sources import cube_store
from mosaicell.sources.imzml import ImzML, export_images, export_imzml
from mosaicell.streaming import tic as stream
from pyspark.sql import functions as F

WIDE = [(r, c) for r in range(9) for c in range(11)]


def blobs(seed: int = 1, rows: int = 24, columns: int = 30, n: int = 9) -> np.ndarray:
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:rows, :columns]
    out = np.zeros((rows, columns))
    for _ in range(n):
        out += rng.uniform(50, 100) * np.exp(-((y - rng.uniform(2, rows - 3)) ** 2 + (x - rng.uniform(2, columns - 3)) ** 2) / 4)
    return np.round(out, 3) + rng.integers(0, 3, out.shape) * 0.5


def frame(spark, grid: np.ndarray, name: str = "a", keep_zeros: bool = False):
    return spark.createDataFrame([(name, int(x) + 1, int(y) + 3, float(v)) for (y, x), v in np.ndenumerate(grid) if v or keep_zeros or (y, x) in ((0, 0), (grid.shape[0] - 1, grid.shape[1] - 1))], "image_id string, x int, y int, tic double")


@pytest.mark.parametrize("sigma", [0.5, 1.0, 3.0])
def test_smoothing(spark, sigma):
    grid = np.random.default_rng(2).integers(0, 4, (7, 9)).astype(float)
    kernel = np.array(image.gaussian_kernel(sigma))
    r = len(kernel) // 2
    want = grid
    for axis in (0, 1):
        padded = np.pad(want, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        want = np.apply_along_axis(lambda v: np.convolve(v, kernel, "valid"), axis, padded)
    got = {(p["y"] - 3, p["x"] - 1): p["tic"] for p in image.gaussian_smooth(frame(spark, grid), sigma).collect()}
    assert np.allclose([[got.get((y, x), 0) for x in range(9)] for y in range(7)], want)
    assert np.isclose(sum(got.values()), grid.sum())


def test_thresholds_on_two_levels(spark):
    grid = np.concatenate([np.full(60, 1.0), np.full(40, 9.0)]).reshape(10, 10) + np.random.default_rng(3).uniform(0, 0.5, (10, 10))
    found = {r["method"]: r for r in threshold.candidates(frame(spark, grid), least=0.05, most=0.6).collect()}
    assert set(found) == set(threshold.METHODS)
    for m in ("otsu", "li", "isodata", "gmm2"):
        assert 1.4 < found[m]["threshold"] < 9 and found[m]["cell_frac"] == pytest.approx(0.4, abs=0.02)
    best = threshold.auto_threshold(frame(spark, grid)).first()
    assert best["score"] == max(f["score"] for f in found.values())
    assert threshold.auto_threshold(frame(spark, grid), "gmm").first()["method"] == "gmm2"
    with pytest.raises(ValueError):
        threshold.auto_threshold(frame(spark, grid), "local_gmm")


def test_score_by_hand(spark):
    grid = np.array([[0, 0, 0, 0, 5], [0, 0, 0, 0, 10]], float)
    got = threshold.scored(frame(spark, grid), spark.createDataFrame([("a", "m", 4.0)], "image_id string, method string, threshold double")).first()
    assert (got["cell_frac"], round(got["score"], 6)) == (0.2, 0.893571)


@pytest.mark.parametrize("method", ["watershed", "dfs"])
def test_segmentation(spark, method):
    grids = {"a": blobs(1), "b": blobs(5)}
    tic = frame(spark, grids["a"], "a").unionByName(frame(spark, grids["b"], "b"))
    got = image.segment(tic, 20.0, method, least=1, tolerance=0.4).collect()
    labels = {(p["image_id"], p["y"] - 3, p["x"] - 1): p["cell_id"] for p in got}
    assert len(labels) == len(got)
    for name, grid in grids.items():
        own = {k[1:]: v for k, v in labels.items() if k[0] == name}
        mask = {(y, x) for (y, x), v in np.ndenumerate(grid) if v > 20}
        assert set(own) <= mask and own
        for c in set(own.values()):
            part = {p for p, v in own.items() if v == c}
            if method == "watershed":  # connected, and it has a peak of its own
                todo, seen = [next(iter(part))], set()
                while todo:
                    p = todo.pop()
                    if p in part and p not in seen:
                        seen.add(p)
                        todo += [(p[0] + a, p[1] + b) for a, b in image.FOUR]
                assert seen == part
                assert any(all(grid[p] >= grid[q] for q in ((p[0] + a, p[1] + b) for a, b in image.EIGHT) if 0 <= q[0] < grid.shape[0] and 0 <= q[1] < grid.shape[1]) for p in part)
        if method == "dfs":
            assert set(own) == mask  # orphans went to the nearest cell
    sized = image.segment(tic, 20.0, method, least=8, most=60, tolerance=0.4).groupBy("image_id", "cell_id").count().collect()
    assert all(8 <= r["count"] <= 60 for r in sized)
    with pytest.raises(ValueError):
        image.segment(tic, 20.0, "other")


def brute_flood(grid: np.ndarray, mask: np.ndarray) -> dict:
    """Watershed of one image over a queue in a plain list: the highest value first, then the oldest entry."""
    rows, columns = grid.shape
    inner = lambda y, x: 0 < y < rows - 1 and 0 < x < columns - 1
    tops = {(y, x) for y, x in zip(*np.nonzero(mask)) if grid[y, x] > 0 and inner(y, x) and grid[y, x] == grid[y - 1 : y + 2, x - 1 : x + 2].max()}
    label, numbers = {}, 0
    for top in sorted(tops):
        if top not in label:
            numbers, todo = numbers + 1, [top]
            while todo:
                p = todo.pop()
                if p in tops and p not in label:
                    label[p] = numbers
                    todo += [(p[0] + a, p[1] + b) for a, b in image.FOUR]
    queue = [(-grid[p], k, p) for k, p in enumerate(sorted(label))]
    age = len(queue)
    while queue:
        first = min(queue)
        queue.remove(first)
        y, x = first[2]
        for a, b in ((-1, 0), (0, -1), (0, 1), (1, 0)):
            q = (y + a, x + b)
            if 0 <= q[0] < rows and 0 <= q[1] < columns and mask[q] and q not in label:
                label[q] = label[y, x]
                queue.append((-grid[q], age, q))
                age += 1
    return label


def brute_grow(grid: np.ndarray, mask: np.ndarray, tolerance: float) -> dict:
    """Seeds, brightest first, take connected pixels of like value; what is left goes to the nearest cell."""
    rows, columns = grid.shape
    tops = [(y, x) for y, x in zip(*np.nonzero(mask)) if 0 < y < rows - 1 and 0 < x < columns - 1 and grid[y, x] == grid[y - 1 : y + 2, x - 1 : x + 2].max()]
    scaled = (grid - grid[mask].min()) / (np.ptp(grid[mask]) + 1e-9)
    label: dict = {}
    for seed in sorted(tops, key=lambda p: (-grid[p], p)):
        todo = [] if seed in label else [seed]
        while todo:
            p = todo.pop()
            if p not in label and 0 <= p[0] < rows and 0 <= p[1] < columns and mask[p] and abs(scaled[p] - scaled[seed]) <= tolerance:
                label[p] = seed
                todo += [(p[0] + a, p[1] + b) for a, b in image.EIGHT]
    names = {seed: k + 1 for k, seed in enumerate(sorted(set(label.values())))}
    label = {p: names[v] for p, v in label.items()}
    for p in zip(*np.nonzero(mask)):
        if p not in label:
            label[p] = -min(((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2, v) for q, v in label.items() if v > 0)[1]
    return {p: abs(v) for p, v in label.items()}


def test_segmentation_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(image, "TASK_PIXELS", 40)  # several tasks
    rng = np.random.default_rng(8)
    grids = {f"g{k}": rng.integers(0, 12, (9, 11)).astype(float) for k in range(4)} | {"blobs": blobs(3)}
    bounds = {n: float(np.percentile(g, 55)) for n, g in grids.items()}
    tic = frame(spark, grids["g0"], "g0")
    for name, grid in list(grids.items())[1:]:
        tic = tic.unionByName(frame(spark, grid, name))
    table = spark.createDataFrame(list(bounds.items()), "image_id string, threshold double")
    for method in ("watershed", "dfs"):
        got = {(r["image_id"], r["y"] - 3, r["x"] - 1): r["cell_id"] for r in image.segment(tic, table, method, least=None).collect()}
        want = {}
        for name, grid in grids.items():
            mask = grid > bounds[name]
            own = brute_flood(grid, mask) if method == "watershed" else brute_grow(grid, mask, 0.15)
            want |= {(name, *map(int, p)): v for p, v in own.items()}
        assert got == want


def test_many_images(spark):
    """More images than fit a packed number: 40 000 with two pixels each."""
    mask = spark.range(40_000).select(F.col("id").cast("string").alias("image_id"), F.explode(F.array(F.lit(3), F.lit(4))).alias("x"), F.lit(7).alias("y"))
    found = image.connected_components(mask).groupBy("image_id", "component").count()
    assert found.count() == 40_000 and found.where("count <> 2 or component <> 7 * 16777216 + 3").count() == 0


def test_nearest_label_far_away(spark):
    labelled = spark.createDataFrame([("a", 0, 0, 5), ("a", 1000, 0, 2), ("b", 3, 3, 9)], "image_id string, x int, y int, cell_id int")
    orphans = spark.createDataFrame([("a", 400, 0), ("a", 500, 0), ("a", 700, 3), ("b", -70, 5), ("c", 1, 1)], "image_id string, x int, y int")
    got = {(p["image_id"], p["x"]): p["cell_id"] for p in image.nearest_label(orphans, labelled).collect()}
    assert got == {("a", 400): 5, ("a", 500): 2, ("a", 700): 2, ("b", -70): 9}


def test_components(spark):
    mask = spark.createDataFrame([("a", x, y) for x, y in ((0, 0), (1, 0), (2, 1), (5, 5), (5, 6), (6, 7))] + [("b", 0, 0)], "image_id string, x int, y int")
    sizes = lambda n: sorted(r["count"] for r in image.connected_components(mask, n).groupBy("image_id", "component").count().collect())
    assert sizes(4) == [1, 1, 1, 2, 2] and sizes(8) == [1, 3, 3]


def test_cell_statistics(spark):
    cube = spark.createDataFrame([("a", 0, 0, 1, 4.0), ("a", 1, 0, 1, 2.0), ("a", 2, 0, 1, 1.0), ("a", 0, 0, 2, 8.0)], "image_id string, x int, y int, bin int, intensity double")
    labels = spark.createDataFrame([("a", x, 0, 7) for x in range(4)], "image_id string, x int, y int, cell_id int")
    of = lambda agg: {r["bin"]: r["value"] for r in cells.cell_spectra(cube, labels, agg).collect()}
    dense = {1: [4, 2, 1, 0], 2: [8, 0, 0, 0]}
    for agg, f in (("mean", np.mean), ("sum", np.sum), ("median", np.median), ("max", np.max), ("min", np.min), ("std", np.std)):
        assert of(agg) == {b: pytest.approx(f(v)) for b, v in dense.items()}
    own = cells.with_spectrum(cells.cell_spectra(cube, labels), cells.regions(labels), 4).first()
    assert own["spectrum"] == [0.0, 1.75, 2.0, 0.0] and own["area_um"] == 400 and own["centroid_col"] == 1.5


def test_quality_by_hand(spark):
    df = spark.createDataFrame([("a", 1, [0.0, 0.0, 1.0, 3.0]), ("a", 2, [1.0, 2.0, 4.0, 8.0, 1.0])], "image_id string, cell_id int, spectrum array<double>")
    one, two = cells.qc_metrics(df).orderBy("cell_id").collect()
    assert (one["snr"], one["sparsity"], round(one["dynamic_range"], 6), one["total_intensity"], round(one["spectral_entropy"], 6), one["n_peaks"]) == (pytest.approx(1e9), 0.5, 9.477121, 4.0, 0.811278, 2)
    assert (round(two["snr"], 6), round(two["dynamic_range"], 6), round(two["spectral_entropy"], 6), two["n_peaks"]) == (3.2, 0.90309, 1.875, 2)


def test_combine_clones(spark):
    df = spark.createDataFrame([(k, k % 4, [0.1, 0.2, 0.3, 0.4]) for k in range(8)], "cell_id int, class int, membership array<double>")
    got = cells.combine_clones(df, [1, 3]).orderBy("cell_id").collect()
    assert [r["class"] for r in got[:4]] == [0, 1, 2, 1] and np.allclose(got[0]["membership"], [0.1, 0.6, 0.3])
    with pytest.raises(ValueError):
        cells.combine_clones(df, [1])


def test_imzml_round_trip(spark, tmp_path):
    spark.dataSource.register(ImzML)
    rows = [("s", k, k % 5 + 1, k // 5 + 1, [100.0 + k, 200.5], [1.0, float(k)]) for k in range(12)]
    df = spark.createDataFrame(rows, "image_id string, spectrum_id long, x int, y int, mz array<double>, intensity array<double>")
    path = f"{tmp_path}/s.imzML"
    df.orderBy("y", "x").coalesce(1).write.format("imzml").mode("append").save(path)
    got = spark.read.format("imzml").option("spectra_per_task", 5).load(path)
    assert got.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    pixels = mz.bin_fixed(mz.explode_peaks(df), 100.0, 201.0, 1.0).select("image_id", "x", "y", "bin", "intensity")
    out = f"{tmp_path}/out.imzML"
    export_imzml(pixels, mz.fixed_axis(spark, 100.0, 201.0, 1.0), out)
    dense = spark.read.format("imzml").load(out).orderBy("spectrum_id").collect()
    assert [(r["x"], r["y"]) for r in dense] == sorted(((r[2], r[3]) for r in rows), key=lambda p: p[::-1]) and all(len(r["mz"]) == 102 for r in dense)
    assert sum(sum(r["intensity"]) for r in dense) == sum(sum(r[5]) for r in rows)
    with pytest.raises(Exception, match="path"):
        spark.read.format("imzml").load().count()


def test_imzml_tells_spectra_that_lack_something(spark, tmp_path):
    spark.dataSource.register(ImzML)
    rows = [("s", k, k + 1, 1, [100.0 + k], [1.0]) for k in range(4)]
    df = spark.createDataFrame(rows, "image_id string, spectrum_id long, x int, y int, mz array<double>, intensity array<double>")
    path = tmp_path / "s.imzML"
    df.orderBy("x").coalesce(1).write.format("imzml").mode("append").save(str(path))
    spectra = path.read_text().split("<spectrum ")
    spectra[2] = spectra[2].replace("IMS:1000051", "IMS:1000052")  # no y
    spectra[3] = spectra[3].replace('ref="intensityArray"', 'ref="other"')
    path.write_text("<spectrum ".join(spectra))
    got = spark.read.format("imzml").load(str(path))
    assert got.count() == 4
    assert {(r["spectrum_id"], r["reason"]) for r in mz.rejects(got).collect()} == {(1, "unplaced"), (2, "missing")}
    assert sorted(r["spectrum_id"] for r in mz.sound(got).collect()) == [0, 3]


@pytest.mark.parametrize("lines", [1, 2, 100])
def test_imzml_image_in_parts(spark, tmp_path, lines):
    spark.dataSource.register(ImzML)
    rows = [(f"s/{k % 2}", k % 5 + 1, k // 5 + 1, k % 4, float(k + 1)) for k in range(40)]
    pixels = spark.createDataFrame(rows, "image_id string, x int, y int, bin int, intensity double")
    found = export_images(pixels, mz.fixed_axis(spark, 100.0, 104.0, 1.0), f"{tmp_path}/out", lines=lines).collect()
    assert len(found) == sum(len({r[2] // lines for r in rows if r[0] == image}) for image in ("s/0", "s/1"))
    for image in ("s/0", "s/1"):
        own = {p[1:] for p in rows if p[0] == image}
        folder = {r["path"].rpartition("/")[0] for r in found if r["image_id"] == image}
        got = spark.read.format("imzml").load(folder.pop())
        assert not folder and got.rdd.getNumPartitions() == len({p[1] // lines for p in own})
        got = got.orderBy("spectrum_id").collect()
        assert [(p["y"], p["x"]) for p in got] == sorted({(p[1], p[0]) for p in own}) and len({p["image_id"] for p in got}) == 1
        assert {(p["x"], p["y"], k, v) for p in got for k, v in enumerate(p["intensity"]) if v} == own
    (tmp_path / "none").mkdir()
    assert spark.read.format("imzml").load(f"{tmp_path}/none").count() == 0


def test_imzml_file_for_each_image(spark, tmp_path):
    spark.dataSource.register(ImzML)
    rows = [(f"s/{k % 3}", k % 5 + 1, k // 5 + 1, k % 4, float(k)) for k in range(40)]
    pixels = spark.createDataFrame(rows, "image_id string, x int, y int, bin int, intensity double")
    found = export_images(pixels, mz.fixed_axis(spark, 100.0, 104.0, 1.0), f"{tmp_path}/out").collect()
    assert {r["image_id"] for r in found} == {"s/0", "s/1", "s/2"}
    for r in found:
        got = spark.read.format("imzml").load(r["path"]).orderBy("spectrum_id").collect()
        own = [p for p in rows if p[0] == r["image_id"]]
        assert len(got) == r["spectra"] and [(p["y"], p["x"]) for p in got] == sorted({(p[2], p[1]) for p in own})
        assert {(p["x"], p["y"], k, v) for p in got for k, v in enumerate(p["intensity"]) if v} == {p[1:] for p in own if p[4]}


def test_stream_equals_batch(spark, tmp_path):
    rows = [("s", k, k % 3, k % 2, [1.0, 2.0], [float(k), 1.0]) for k in range(40)] + [("s", 99, 0, 0, [1.0], [1.0, 2.0])]
    df = spark.createDataFrame(rows, stream.SPECTRA)
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    running = stream.running_tic(stream.spectra_stream(spark, f"{tmp_path}/in", 1))
    q = running.writeStream.format("memory").queryName("running").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["x"], r["y"]): r["tic"] for r in spark.table("running").collect()}
    assert got == {(r["x"], r["y"]): r["tic"] for r in image.pixel_tic_raw(mz.sound(df)).collect()}


def test_whole_chain(spark, tmp_path):
    grid, rng = blobs(4, 30, 30, 14), np.random.default_rng(4)
    rows = [("s", int(y * 30 + x), int(x), int(y), [400.5, 500.5, 760.5], [float(v), float(v * rng.uniform(0.5, 2) * (x > 15)), float(v * (x <= 15))]) for (y, x), v in np.ndenumerate(grid)]
    spectra = spark.createDataFrame(rows, "image_id string, spectrum_id long, x int, y int, mz array<double>, intensity array<double>")
    run = Imaging(spectra)
    with pytest.raises(ValueError, match="run the step"):
        run.segment()
    run = run.bin(400.0, 800.0, 1.0).auto_threshold("otsu").segment(least=4).extract().quality(snr=0.0).cluster(k=2)
    n = run.n_cells()
    assert n == run.cells.count() >= 6 and run.cells.where("abs(aggregate(membership, 0D, (s, v) -> s + v) - 1) > 1e-9 or soft_confidence < 0.5").count() == 0
    by_side = run.cells.selectExpr("class", "centroid_col > 15 as right").distinct().collect()
    assert len({r["class"] for r in by_side}) == 2
    assert run.clone_quality(least_cells=2).count() == 2
    table = run.differential()
    assert table.count() == 401 and table.where("pval_adj < pval - 1e-12").count() == 0
    marked = run.find_markers(5, alpha=1.01, fold=1.1)
    assert 0 < marked.markers.count() <= 5 and marked.annotate_ions("pos", 2000.0).columns
    assert run.ion_map(500.0, 0.6).count() > 0
    cells.export_csv(run.cells, run.axis, f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == n
    kept = run.drop_flagged()
    assert kept.n_cells() == kept.cells.count()
    for method, options in (("gmm", {"most": 3}), ("fcm", {"most": 3})):
        found = Imaging(spectra, axis=run.axis, cells=run.cells.drop("embedding", "membership", "class", "soft_confidence")).cluster(method, **options)
        assert found.choice.where("chosen").count() == 1 and found.cells.count() == n


def test_images_apart(spark):
    """A table of two images gives for each what its own run gives; classes are of all cells together."""
    def spectra(name: str, seed: int, scale: float):
        rng = np.random.default_rng(seed)
        return spark.createDataFrame([(name, int(y * 20 + x), int(x), int(y), [400.5, 500.5, 760.5], [float(v * scale), float(v * rng.uniform(0.5, 2)), float(v)])
                                      for (y, x), v in np.ndenumerate(blobs(seed, 20, 20, 7))], "image_id string, spectrum_id long, x int, y int, mz array<double>, intensity array<double>")

    steps = lambda s: Imaging(s).bin_adaptive(390.0, 800.0, resolving_power=500).auto_threshold("otsu").segment(least=4).extract().quality(snr=0.0)
    a, b = spectra("a", 4, 1.0), spectra("b", 9, 30.0)
    both, alone = steps(a.unionByName(b)), [steps(a), steps(b)]
    bounds = {r["image_id"]: r["threshold"] for r in both.threshold.collect()}
    assert bounds == {r["image_id"]: r["threshold"] for one in alone for r in one.threshold.collect()} and bounds["b"] > 5 * bounds["a"]
    assert sorted(map(tuple, both.labels.collect())) == sorted(tuple(r) for one in alone for r in one.labels.collect())
    key = lambda r: (r["image_id"], r["cell_id"])
    for got, want in zip(sorted(both.cells.collect(), key=key), sorted((r for one in alone for r in one.cells.collect()), key=key), strict=True):
        assert key(got) == key(want) and (got["area_px"], got["flagged"], got["reasons"]) == (want["area_px"], want["flagged"], want["reasons"])
        assert np.allclose(got["spectrum"], want["spectrum"]) and got["snr"] == pytest.approx(want["snr"])
    clustered = both.cluster("gmm", k=2)
    scores = clusters.silhouette(clustered.cells)
    assert scores.count() == clustered.n_cells() == scores.select("image_id", "cell_id").distinct().count()
    ids = [r["cell_id"] for r in both.labels.where("image_id = 'a'").select("cell_id").distinct().limit(2).collect()]
    left = both.remove_cells(ids, "a")
    assert left.n_cells() == both.n_cells() - 2 and left.cells.count() == left.n_cells()
    with pytest.raises(ValueError, match="several images"):
        both.remove_cells(ids)
    assert "image_id" in cells.export_rows(clustered.cells, both.axis, "ions").columns and "image_id" in cells.umap_points(clustered.cells).columns
    assert both.crop(10, 10).tic.where("x >= 10 or y >= 10").count() == 0


def test_silhouettes(spark):
    rng = np.random.default_rng(6)
    x, of = rng.normal(size=(60, 3)), rng.integers(0, 3, 60)
    of[:3], of[3] = (0, 1, 2), 3  # class 3 has one cell
    rows = [(f"i{k % 2}", k // 2, int(of[k]), x[k].tolist()) for k in range(60)]
    df = spark.createDataFrame(rows, "image_id string, cell_id long, class int, embedding array<double>")
    got = {(r["image_id"], r["cell_id"]): r["silhouette"] for r in clusters.silhouette(df, 16, 24).collect()}
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    for k in range(60):
        own = (of == of[k]) & (np.arange(60) != k)
        a, b = d[k, own].mean() if own.any() else None, min(d[k, of == c].mean() for c in set(of.tolist()) - {int(of[k])})
        assert got[f"i{k % 2}", k // 2] == pytest.approx(0.0 if a is None else (b - a) / max(a, b))
    assert len(got) == 60
    assert clusters.silhouette(df.limit(0)).collect() == [] and {r["silhouette"] for r in clusters.silhouette(df.withColumn("class", F.lit(1))).collect()} == {0.0}


def test_singular_mixture_is_fitted_again(spark):
    """Two points, each many times: a full covariance without regularisation breaks down, the second fit doesn't."""
    points = spark.createDataFrame([([float(k % 2), 0.0],) for k in range(40)], "embedding array<double>")
    found = clusters.fit_mixtures(points, [2], "full", 0.0, restarts=2)
    assert np.allclose(found[2].means[:, 0], [0, 1], atol=1e-3)


def test_exact_quantiles(spark, monkeypatch):
    rng = np.random.default_rng(7)
    for values in (rng.normal(size=5000), rng.integers(0, 5, 3000).astype(float), np.array([4.0]), np.full(700, 2.5), np.append(np.zeros(900), [1e300, -1e300])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
        monkeypatch.setattr(quantiles, "FEW", 100)
        assert quantiles.exact_quantiles(df, "v", (0.0, 0.01, 0.3, 0.5, 0.999, 1.0)) == pytest.approx(np.quantile(values, (0.0, 0.01, 0.3, 0.5, 0.999, 1.0)).tolist())
    assert quantiles.exact_quantiles(df.limit(0), "v", (0.5,)) == [None]


def brute_rings(mask: np.ndarray) -> list[list[tuple[float, float]]]:
    """Rings of (x, y), each from its least (y, x), by walking along the sides with the inside on the right hand."""
    inside = lambda x, y: 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and bool(mask[y, x])
    todo = {(x, y, k) for y in range(mask.shape[0]) for x in range(mask.shape[1]) for k, (a, b) in enumerate(image.SIDES) if inside(x, y) and not inside(x + a, y + b)}
    out = []
    while todo:
        x, y, k = start = min(todo)
        ring = []
        while (x, y, k) in todo:
            todo.remove((x, y, k))
            (a, b), (s, t) = image.SIDES[k], image.SIDES[(k + 1) % 4]
            ring.append((x + a / 2, y + b / 2))
            if not inside(x + s, y + t):
                k = (k + 1) % 4
            elif inside(x + a + s, y + b + t):
                x, y, k = x + a + s, y + b + t, (k + 3) % 4
            else:
                x, y = x + s, y + t
        assert (x, y, k) == start
        least = min(range(len(ring)), key=lambda i: ring[i][::-1])
        out.append(ring[least:] + ring[:least])
    return sorted(out, key=lambda r: r[0][::-1])


def test_contours_like_brute_force(spark):
    """Holes, pixels that touch at corners, single pixels, a long snake, two images."""
    rng = np.random.default_rng(4)
    hole = np.ones((7, 7), bool)
    hole[2:4, 2:4] = hole[4, 4] = False
    snake = np.zeros((21, 41), bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    masks = {("a", 1): hole, ("a", 2): np.eye(5, dtype=bool), ("b", 1): rng.random((12, 15)) < 0.6, ("b", 9): snake, ("b", 3): np.ones((1, 1), bool)}
    rows = [(i, int(x), int(y), c) for (i, c), m in masks.items() for y, x in zip(*np.nonzero(m))]
    found: dict = {}
    for r in image.contour_rings(spark.createDataFrame(rows, "image_id string, x int, y int, cell_id int")).orderBy("image_id", "cell_id", "ring", "place").collect():
        found.setdefault((r["image_id"], r["cell_id"]), {}).setdefault(r["ring"], []).append((r["place"], r["x"], r["y"]))
    for k, m in masks.items():
        want = brute_rings(m)
        assert [[(x, y) for _, x, y in ring] for ring in found[k].values()] == want and list(found[k]) == list(range(1, len(want) + 1))
        assert all([p for p, *_ in ring] == list(range(len(ring))) for ring in found[k].values())
    assert len(found["a", 1]) == 2 and len(found["a", 2]) == 5
    assert image.contour_rings(spark.createDataFrame([], "image_id string, x int, y int, cell_id int")).collect() == []


@pytest.mark.parametrize("rank", [64, 5])
def test_components_without_the_matrix(spark, rank):
    """Equal to those of the whole scatter matrix, where cells span all bins and where they don't."""
    rng = np.random.default_rng(rank)
    x = rng.normal(size=(300, rank)) @ rng.normal(size=(rank, 64)) + 5
    x -= x.mean(axis=0)
    found = clusters.principal_components(spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>"), 3)
    values, vectors = np.linalg.eigh(x.T @ x)
    want = vectors[:, ::-1][:, :3]
    want = want * np.where(want[np.abs(want).argmax(axis=0), range(3)] < 0, -1, 1)
    assert found.shape == (64, 3) and np.abs(found - want).max() < 1e-6


def dense_zoom(grid: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """By whole matrices: solves for the coefficients, then evaluates the basis."""
    basis = lambda d: np.where(d < 1, 2 / 3 - d**2 + d**3 / 2, np.where(d < 2, (2 - d) ** 3 / 6, 0))

    def matrix(n: int, size: int) -> np.ndarray:
        if n == 1:
            return np.ones((size, 1))
        far = np.arange(-3, n + 3)
        fold = np.array([[float(abs((n - 1) - abs((n - 1) - abs(k))) == i) for i in range(n)] for k in far])  # mirrored at 0 and n - 1
        at = lambda x: basis(np.abs(np.asarray(x, float)[:, None] - far)) @ fold
        return at(np.linspace(0, n - 1, size) if size > 1 else [0.0]) @ np.linalg.inv(at(np.arange(n)))

    return matrix(grid.shape[0], rows) @ grid @ matrix(grid.shape[1], columns).T


@pytest.mark.parametrize("zoom", [1.5, 2.0, 0.6])
def test_zoom_like_a_dense_solve(spark, zoom):
    rng = np.random.default_rng(5)
    grids = {"a": rng.random((7, 11)) * (rng.random((7, 11)) < 0.7), "b": rng.random((2, 9)), "c": rng.random((1, 5)), "d": rng.random((6, 1))}
    for g in grids.values():
        g[0, 0], g[-1, -1] = 1.0, 2.0
    rows = [(n, int(x) + 3, int(y) - 2, float(g[y, x])) for n, g in grids.items() for y, x in zip(*np.nonzero(g))]
    found = image.spline_zoom(spark.createDataFrame(rows, "image_id string, x int, y int, tic double"), zoom).toPandas()
    for n, g in grids.items():
        want = dense_zoom(g, max(1, int(np.floor(g.shape[0] * zoom + 0.5))), max(1, int(np.floor(g.shape[1] * zoom + 0.5))))
        own = found[found.image_id == n].sort_values(["y", "x"])
        assert len(own) == want.size and np.abs(own.tic.to_numpy().reshape(want.shape) - want).max() < 1e-9


def test_stored_cube(spark, tmp_path):
    """Some bins need few of the files; the cube comes back whole."""
    rng = np.random.default_rng(6)
    rows = sorted({(f"i{k % 2}", int(rng.integers(40)), int(rng.integers(30)), int(rng.integers(300))) for k in range(4000)})
    cube = spark.createDataFrame([(*r, float(k)) for k, r in enumerate(rows)], "image_id string, x int, y int, bin int, intensity double")
    cube_store.write_cube(cube, f"{tmp_path}/cube", bins=16)
    whole, some = cube_store.read_cube(spark, f"{tmp_path}/cube"), cube_store.read_cube(spark, f"{tmp_path}/cube", [17, 18, 250])
    assert sorted(whole.select(*cube.columns).collect()) == sorted(cube.collect())
    assert sorted(some.select(*cube.columns).collect()) == sorted(cube.where("bin in (17, 18, 250)").collect())


    def run(df):
        df = df.select(*cube.columns)
        qe = df._jdf.queryExecution()
        qe.executedPlan().executeCollect()
        return qe.executedPlan().collectLeaves().head().metrics().apply("numFiles").value()

    assert 2 <= run(some) < run(whole) / 4


@pytest.mark.parametrize("sample", [2000, 60])
def test_fuzzy_means_end_at_a_fixed_point_of_all_points(spark, monkeypatch, sample):
    """Whether the start has settled on all points or on some of them."""
    starts = clusters._starts
    monkeypatch.setattr(clusters, "_starts", lambda *a, **k: starts(*a, **k, sample=sample))
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(80, 3)) + c for c in (0, 3, 6)])
    points = spark.createDataFrame([("i", k, v.tolist()) for k, v in enumerate(x)], "image_id string, cell_id int, embedding array<double>")
    found = clusters.fcm_clusters(points, 3)[0].orderBy("cell_id").collect()
    u = np.array([r["membership"] for r in found])
    centres = ((u**2).T @ x) / (u**2).sum(axis=0)[:, None]
    again = clusters.fuzzy_memberships()(centres, x)
    assert np.abs(again - u).max() < 1e-5 and np.abs(centres.mean(axis=1) - [0, 3, 6]).max() < 0.5


def test_mixtures_of_all_values(spark):
    """A round over all values is what it is over raw pixels, and a coarse histogram's start ends as likely as those do; two images, one of a single value."""
    rng = np.random.default_rng(9)
    raw = {"a": np.expm1(np.concatenate([rng.normal(1.5, 0.3, 700), rng.normal(3, 0.5, 500)])), "b": np.expm1(np.concatenate([rng.normal(2, 0.4, 300), rng.normal(4, 0.3, 300), rng.normal(5.5, 0.2, 200)])), "c": np.full(9, 4.0)}
    rows = [(n, k % 40, k // 40, float(v)) for n, vs in raw.items() for k, v in enumerate(vs)] + [("a", 0, 99, 0.0)]
    tic = spark.createDataFrame(rows, "image_id string, x int, y int, tic double")

    def step(x, pi, mean, var):
        log = np.log(pi) - 0.5 * np.log(2 * np.pi * var) - (x[:, None] - mean) ** 2 / (2 * var)
        total = np.exp(log).sum(axis=1, keepdims=True)
        p = np.exp(log) / total
        n = p.sum(axis=0)
        new = (p * x[:, None]).sum(axis=0) / n
        return np.log(total).mean(), n / len(x), new, (p * (x[:, None] - new) ** 2).sum(axis=0) / n + 1e-6

    of = lambda r: [np.array([r[f"{c}{j}"] for j in range(r["k"])]) for c in "pms"]
    logs = {n: np.log1p(v[v > 0]) for n, v in raw.items()}
    start = spark.createDataFrame([("a", 2, 0.3, 0.7, 0.0, 1.0, 2.0, 0.0, 0.5, 0.8, 1.0, 0.0), ("b", 3, 0.3, 0.3, 0.4, 1.0, 2.0, 5.0, 0.5, 0.8, 1.0, 0.0)], "image_id string, k int, " + ", ".join(f"{c} double" for c in [*threshold._STATE, "like"]))
    values = tic.where("tic > 0").groupBy("image_id", F.log1p("tic").alias("v")).agg(F.count("*").alias("n"))
    for before, after in zip(start.orderBy("image_id").collect(), threshold._round(values, start).orderBy("image_id").collect()):
        like, *want = step(logs[before["image_id"]], *of(before))
        assert after["like"] == pytest.approx(like) and all(np.allclose(g, w) for g, w in zip(of(after), want))
    found = threshold.mixtures(tic, bins=24).collect()
    assert sorted((r["image_id"], r["k"]) for r in found) == [("a", 2), ("a", 3), ("b", 2), ("b", 3)]
    for r in found:
        x = logs[r["image_id"]]
        assert step(x, *of(r))[0] > step(x, *threshold._mixture(x, np.ones(len(x)), r["k"]))[0] - 1e-3


def test_rings_of_small_and_large_cells(spark, monkeypatch):
    """Small cells are chained in a task, without a written table a round; larger ones spread give the same."""
    rng = np.random.default_rng(3)
    grid = rng.random((60, 40)) < 0.7
    rows = [(name, int(x) - 7, int(y) + 5, int(y // step) * 50 + int(x // step)) for name, step in (("a", 4), ("b", 30)) for y, x in zip(*np.nonzero(grid))]
    labels = spark.createDataFrame(rows, "image_id string, x int, y int, cell_id int")
    names, write = [], image.Scratch.written
    monkeypatch.setattr(image.Scratch, "written", lambda self, df, name, *a: (names.append(name), write(self, df, name, *a))[1])
    whole = sorted(map(tuple, image.contour_rings(labels).collect()))
    assert "rings" not in names and len(whole) > 1000
    monkeypatch.setattr(image, "RING_PIXELS", 100)
    assert sorted(map(tuple, image.contour_rings(labels).collect())) == whole and "rings" in names


def test_maxima_and_components_across_tiles(spark, monkeypatch):
    """Tiles see what lies beyond their edges; each pixel is shuffled about once and not once for each place of the footprint."""
    rng = np.random.default_rng(4)
    values = rng.integers(0, 6, (70, 600)) * (rng.random((70, 600)) < 0.6)
    rows = [(name, int(x) - 300, int(y) - 20, float(values[y, x])) for name in ("a", "b") for y, x in zip(*np.nonzero(values))]
    pixels = spark.createDataFrame(rows, "image_id string, x int, y int, tic double")
    for footprint in ((3, 3), (2, 5)):
        (r, c), there = footprint, {(x, y): v for name, x, y, v in rows if name == "a"}
        near = [(dx, dy) for dy in range(-(r // 2), r - r // 2) for dx in range(-(c // 2), c - c // 2)]
        x0, x1, y0, y1 = min(x for x, _ in there), max(x for x, _ in there), min(y for _, y in there), max(y for _, y in there)
        tops = sorted((name, x, y, v) for name in ("a", "b") for (x, y), v in there.items()
                      if x0 < x < x1 and y0 < y < y1 and v == max(there.get((x + dx, y + dy), 0) for dx, dy in near))
        found = image.local_maxima(pixels, footprint)
        assert sorted(map(tuple, found.collect())) == tops
        assert "Generate explode([" not in found._jdf.queryExecution().toString()
    for neighbours, steps in ((4, [(1, 0), (0, 1)]), (8, [(1, 0), (0, 1), (1, 1), (-1, 1)])):
        root = {p: p for p in there}

        def find(p, root=root):
            while root[p] != p:
                root[p] = p = root[root[p]]
            return p

        for x, y in there:
            for dx, dy in steps:
                if (q := (x + dx, y + dy)) in root:
                    a, b = find((x, y)), find(q)
                    low, high = sorted((a, b), key=lambda p: (p[1], p[0]))
                    root[high] = low
        want = sorted((name, x, y, find((x, y))[1] * (1 << 24) + find((x, y))[0]) for name in ("a", "b") for x, y in there)
        names, write = {}, image.Scratch.written
        with monkeypatch.context() as patch:
            patch.setattr(image.Scratch, "written", lambda self, df, name, *a: (made := write(self, df, name, *a), names.setdefault(name, made))[0])
            patch.setattr(image.Scratch, "clear", lambda self: None)
            found = image.connected_components(pixels.select("image_id", "x", "y"), neighbours)
        assert sorted(map(tuple, found.select("image_id", "x", "y", "component").collect())) == want
        assert names["nodes"].count() < len(rows) / 20  # only parts at tiles' edges are nodes


def test_silhouettes_move_a_row_for_each_cell_and_part(spark):
    """Sums of all classes travel as one row, cells in packed parts: nothing has a row for each cell and class, or cell and tile."""
    rng = np.random.default_rng(5)
    x, classes = rng.normal(size=(700, 2)).round(2), np.stack([rng.integers(0, k, 700) for k in (2, 3, 5)], axis=1)
    rows = spark.createDataFrame([(k, c.tolist(), v.tolist()) for k, (c, v) in enumerate(zip(classes, x))], "row long, classes array<int>, embedding array<double>")
    found = clusters._silhouettes(rows, 100, 300)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for r in found.collect():
        own, mean = classes[:, r["j"]], lambda c: d[r["row"], classes[:, r["j"]] == c]  # noqa: B023
        assert r["class"] == own[r["row"]]
        a, b = mean(r["class"]).sum() / (len(mean(r["class"])) - 1), min(mean(c).mean() for c in set(own) - {r["class"]})
        assert abs(r["silhouette"] - (b - a) / max(a, b)) < 1e-9
    assert found.count() == 2100
    plan = found._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" not in plan and "MapInArrow" in plan


def test_fuzzy_means_take_few_rounds_over_all_points(spark, monkeypatch):
    """Clusters that overlap converge slowly round by round: a scan of all cells each."""
    rng = np.random.default_rng(6)
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(6000, 2)))], "cell_id long, embedding array<double>").coalesce(2)
    scans, steps = [], clusters.fcm_steps
    monkeypatch.setattr(clusters, "fcm_steps", lambda *a: (scans.append(1), steps(*a))[1])
    found, _ = clusters.fcm_clusters(points, k=4)
    assert len(scans) <= 30
    x, u = (np.array([r[c] for r in found.collect()]) for c in ("embedding", "membership"))
    centres = (u**2).T @ x / (u**2).sum(axis=0)[:, None]
    assert np.abs(clusters.fuzzy_memberships()(centres, x) - u).max() < 1e-4
