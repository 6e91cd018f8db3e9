"""Queries over spectra and images; SQL fragments are shared common table expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mz
from ..functions.tables import shared_folder, written
from ..operators import cells, image, threshold
from ..sources import cube_store, fixtures
from .registry import query

LO, HI, WIDTH = 350.0, 550.0, 0.1
N_BINS = mz.axis_size(LO, HI, WIDTH)

PEAKS = """peaks AS (SELECT l_orderkey AS spectrum_id, CAST(l_orderkey % 128 AS BIGINT) AS x, CAST(l_orderkey // 128 AS BIGINT) AS y,
  350.05::DOUBLE + 0.1::DOUBLE * (l_partkey % 2000) AS mz, l_quantity AS intensity FROM lineitem)"""
BINNED = PEAKS + f""", binned AS (SELECT * FROM (SELECT *, CAST(floor((mz::REAL - 350::REAL)::REAL / 0.1::REAL) AS BIGINT) AS bin FROM peaks) WHERE bin BETWEEN 0 AND {N_BINS - 1})"""
CUBE = BINNED + ", cube AS (SELECT x, y, bin, sum(intensity) AS intensity FROM binned GROUP BY x, y, bin)"
TIC = BINNED + ", tic AS (SELECT x, y, sum(intensity) AS tic FROM binned GROUP BY x, y)"
BOUNDS = ", bounds AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM tic)"
MASK = TIC + ", thr AS (SELECT quantile_cont(tic, 0.75) AS t FROM tic WHERE tic > 0), mask AS (SELECT x, y, tic FROM tic, thr WHERE tic > t)"
LABELS = MASK + ", labels AS (SELECT x, y, 1 + (y // 4) * 32 + x // 4 AS cell_id FROM mask)"
LABELLED_CUBE = LABELS + ", cube AS (SELECT x, y, bin, sum(intensity) AS intensity FROM binned GROUP BY x, y, bin)"
#: Every value of the image with its number, zeros of the grid included; then a histogram of 256 buckets.
VALUES = TIC + BOUNDS + """, vals AS (SELECT tic AS v, count(*) AS n FROM tic GROUP BY tic
  UNION ALL SELECT 0.0, (SELECT (x1 - x0 + 1) * (y1 - y0 + 1) FROM bounds) - (SELECT count(*) FROM tic))"""
HIST = VALUES + """, ends AS (SELECT min(v) AS lo, max(v) AS hi FROM vals WHERE n > 0),
  hist AS (SELECT k AS bucket, lo + (k + 0.5) * (hi - lo) / 256 AS centre, coalesce(n, 0) AS n FROM range(256) t(k) CROSS JOIN ends
    LEFT JOIN (SELECT least(255, floor((v - lo) / (hi - lo) * 256))::BIGINT AS b, sum(n) AS n FROM vals, ends WHERE n > 0 GROUP BY b) ON b = k),
  cum AS (SELECT *, sum(n) OVER (ORDER BY bucket) AS w, sum(n * centre) OVER (ORDER BY bucket) AS s, sum(n) OVER () AS all_w, sum(n * centre) OVER () AS all_s FROM hist)"""


def binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mz.bin_fixed(fixtures.peaks(spark, sf_dir), LO, HI, WIDTH)


def tic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.pixel_tic(binned(spark, sf_dir))


def mask_of(pixels: DataFrame, percentile: float = 75.0) -> DataFrame:
    bound = threshold.percentile_threshold(pixels, percentile).select("image_id", "threshold")
    return pixels.join(bound, "image_id").where("tic > threshold").drop("threshold")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.surrogate_labels(mask_of(tic(spark, sf_dir)))


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.datacube(binned(spark, sf_dir))


def axis(spark: SparkSession) -> DataFrame:
    return mz.fixed_axis(spark, LO, HI, WIDTH)


@query("load_spectra", f"WITH {PEAKS} SELECT spectrum_id, x, y, count(*) AS n_peaks, round(sum(mz), 6) AS sum_mz, sum(intensity) AS sum_intensity FROM peaks GROUP BY spectrum_id, x, y")
def load_spectra(spark, sf_dir):
    """Spectra with what their arrays add up to."""
    s = fixtures.spectra(spark, sf_dir)
    return s.select("spectrum_id", "x", "y", F.size("mz").alias("n_peaks"), F.expr("aggregate(mz, 0D, (a, v) -> a + v)").alias("sum_mz"), F.expr("aggregate(intensity, 0D, (a, v) -> a + v)").alias("sum_intensity"))


@query("explode_peaks", f"WITH {PEAKS} SELECT spectrum_id, x, y, round(mz, 6) AS mz, intensity FROM peaks")
def explode_peaks(spark, sf_dir):
    return mz.explode_peaks(fixtures.spectra(spark, sf_dir))


@query("malformed_spectra", f"""WITH {PEAKS}, n AS (SELECT spectrum_id, count(*) AS n, spectrum_id % 11 AS kind FROM peaks GROUP BY spectrum_id)
  SELECT spectrum_id, CASE WHEN kind IN (0, 3) THEN 'missing' WHEN kind IN (1, 4) OR n = 1 THEN 'empty' ELSE 'unequal' END AS reason FROM n WHERE kind < 5""")
def malformed_spectra(spark, sf_dir):
    """Spectra that some arrays were taken from are told with the reason; the others are sound."""
    return mz.rejects(fixtures.spoiled_spectra(spark, sf_dir)).select("spectrum_id", "reason")


@query("sound_spectra", f"""WITH {PEAKS} SELECT spectrum_id, count(*) AS n_peaks, sum(intensity) AS sum_intensity FROM peaks WHERE spectrum_id % 11 >= 5 GROUP BY spectrum_id""")
def sound_spectra(spark, sf_dir):
    s = mz.sound(fixtures.spoiled_spectra(spark, sf_dir))
    return s.select("spectrum_id", F.size("mz").alias("n_peaks"), F.expr("aggregate(intensity, 0D, (a, v) -> a + v)").alias("sum_intensity"))


@query("sample_spectra", f"WITH {PEAKS}, s AS (SELECT spectrum_id, count(*) AS n_peaks FROM peaks GROUP BY spectrum_id) SELECT spectrum_id, n_peaks FROM s ORDER BY md5(concat(spectrum_id, ':42')), spectrum_id LIMIT 50")
def sample_spectra(spark, sf_dir):
    """Fifty spectra by a hash: the feature is the sample."""
    return mz.sample_spectra(fixtures.spectra(spark, sf_dir), 50).select("spectrum_id", F.size("mz").alias("n_peaks"))


@query("relative_coords", f"WITH {PEAKS}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM peaks) SELECT DISTINCT x, y, x - x0 AS rel_x, y - y0 AS rel_y, x1 - x0 + 1 AS width, y1 - y0 + 1 AS height FROM peaks, b")
def relative_coords(spark, sf_dir):
    return image.relative_coords(fixtures.peaks(spark, sf_dir).select("image_id", "x", "y").distinct())


def _normalised(spark, sf_dir, method):
    return mz.explode_peaks(mz.normalized(fixtures.spectra(spark, sf_dir), method)).select("spectrum_id", "mz", "intensity")


@query("normalize_tic", f"WITH {PEAKS} SELECT spectrum_id, round(mz, 6) AS mz, round(intensity / sum(intensity) OVER (PARTITION BY spectrum_id), 6) AS intensity FROM peaks")
def normalize_tic(spark, sf_dir):
    return _normalised(spark, sf_dir, "TIC")


@query("normalize_rms", f"WITH {PEAKS} SELECT spectrum_id, round(mz, 6) AS mz, round(intensity / sqrt(avg(intensity * intensity) OVER (PARTITION BY spectrum_id)), 6) AS intensity FROM peaks")
def normalize_rms(spark, sf_dir):
    return _normalised(spark, sf_dir, "rms")


@query("normalize_median", f"WITH {PEAKS}, m AS (SELECT spectrum_id, greatest(coalesce(quantile_cont(intensity, 0.5) FILTER (intensity > 0), 1.0), 1e-12) AS m FROM peaks GROUP BY spectrum_id) SELECT spectrum_id, round(mz, 6) AS mz, round(intensity / m, 6) AS intensity FROM peaks JOIN m USING (spectrum_id)")
def normalize_median(spark, sf_dir):
    return _normalised(spark, sf_dir, "median")


def _ends(spark, sf_dir):
    """Whole m/z around all peaks."""
    return fixtures.peaks(spark, sf_dir).agg(F.floor(F.min("mz")).cast("double"), F.ceil(F.max("mz")).cast("double")).first()


ENDS = PEAKS + ", ends AS (SELECT floor(min(mz)) AS lo, ceil(max(mz)) AS hi FROM peaks)"


@query("fixed_axis", f"WITH {ENDS} SELECT k AS bin, round(lo + k * 0.1::DOUBLE, 6) AS mz, round(lo + k * 0.1::DOUBLE + 0.1::DOUBLE, 6) AS hi FROM (SELECT lo, unnest(range(ceil((hi + 0.05 - lo) / 0.1)::BIGINT)) AS k FROM ends)")
def fixed_axis(spark, sf_dir):
    return mz.fixed_axis(spark, *_ends(spark, sf_dir)).select("bin", "mz", "hi")


_ADAPTIVE = "WITH RECURSIVE " + ENDS + """, e(k, m) AS (SELECT 0::BIGINT, lo FROM ends UNION ALL SELECT k + 1, m + least(1.0::DOUBLE, greatest(0.01::DOUBLE, {step})) FROM e WHERE m < (SELECT hi FROM ends)),
  b AS (SELECT k AS bin, m AS lo, lead(m) OVER (ORDER BY k) AS hi FROM e) """


def _adaptive_rows(spark, edges):
    return mz.adaptive_axis(spark, edges).select("bin", "lo", "hi")


@query("adaptive_axis_rp", _ADAPTIVE.format(step="m / 2000") + "SELECT bin, round(lo, 6) AS lo, round(hi, 6) AS hi FROM b WHERE hi IS NOT NULL")
def adaptive_axis_rp(spark, sf_dir):
    return _adaptive_rows(spark, mz.adaptive_edges(*_ends(spark, sf_dir), resolving_power=2000))


@query("adaptive_axis_ppm", _ADAPTIVE.format(step="m * 300 / 1e6") + "SELECT bin, round(lo, 6) AS lo, round(hi, 6) AS hi FROM b WHERE hi IS NOT NULL")
def adaptive_axis_ppm(spark, sf_dir):
    return _adaptive_rows(spark, mz.adaptive_edges(*_ends(spark, sf_dir), ppm=300))


@query("axis_diagnostics", _ADAPTIVE.format(step="m / 2000") + """, d AS (SELECT hi - lo AS width, ((lo + hi) / 2)::REAL::DOUBLE AS mz FROM b WHERE hi IS NOT NULL)
  SELECT count(*) AS n_bins, round(min(width), 6) AS min_width, round(max(width), 6) AS max_width, round(min(width / mz * 1e6), 3) AS min_ppm, round(max(width / mz * 1e6), 3) AS max_ppm FROM d""")
def axis_diagnostics(spark, sf_dir):
    found = mz.axis_diagnostics(mz.adaptive_axis(spark, mz.adaptive_edges(*_ends(spark, sf_dir), resolving_power=2000)))
    return found.withColumns({c: F.round(c, 3) for c in ("min_ppm", "max_ppm")})


@query("bin_fixed", f"WITH {BINNED} SELECT bin, count(*) AS n, sum(intensity) AS intensity FROM binned GROUP BY bin")
def bin_fixed(spark, sf_dir):
    return binned(spark, sf_dir).groupBy("bin").agg(F.count("*").alias("n"), F.sum("intensity").alias("intensity"))


@query("bin_adaptive", _ADAPTIVE.format(step="m / 2000") + " SELECT bin, count(*) AS n, sum(intensity) AS intensity FROM peaks JOIN b ON mz >= lo AND mz < hi GROUP BY bin")
def bin_adaptive(spark, sf_dir):
    found = mz.bin_adaptive(fixtures.peaks(spark, sf_dir), mz.adaptive_edges(LO, HI, resolving_power=2000))
    return found.groupBy("bin").agg(F.count("*").alias("n"), F.sum("intensity").alias("intensity"))


@query("auto_mz_range", f"WITH {PEAKS} SELECT round(quantile_cont(mz, 0.01), 6) AS mz_min, round(quantile_cont(mz, 0.99), 6) AS mz_max FROM peaks")
def auto_mz_range(spark, sf_dir):
    return mz.auto_mz_range(fixtures.peaks(spark, sf_dir))


def _ppm_sql(peaks: str, spectrum: str) -> str:
    return f"""WITH {peaks}, s AS (SELECT *, quantile_cont(intensity, 0.5) OVER (PARTITION BY {spectrum}) AS med, count(*) OVER (PARTITION BY {spectrum}) AS k FROM peaks),
  g AS (SELECT mz, lag(mz) OVER (PARTITION BY {spectrum} ORDER BY mz) AS b FROM s WHERE k >= 5 AND intensity > med),
  p AS (SELECT (mz - b) / ((mz + b) / 2) * 1e6 AS ppm FROM g WHERE b IS NOT NULL AND (mz + b) / 2 BETWEEN 350 AND 550)
  SELECT count(*) AS n_gaps, CASE WHEN count(*) >= 200 THEN round(greatest(2.0, least(500.0, quantile_cont(ppm, 0.5))), 6) END AS ppm FROM p"""


@query("auto_ppm", _ppm_sql(PEAKS, "spectrum_id"))
def auto_ppm(spark, sf_dir):
    return mz.auto_ppm(fixtures.peaks(spark, sf_dir), LO, HI)


@query("auto_ppm_images", _ppm_sql(PEAKS.replace("peaks AS (", "own AS (") + ", peaks AS (SELECT spectrum_id % 2 AS image, spectrum_id // 2 AS spectrum_id, mz, intensity FROM own)", "image, spectrum_id"))
def auto_ppm_images(spark, sf_dir):
    """Two images whose spectra have the same numbers."""
    own = fixtures.peaks(spark, sf_dir).withColumns({"image_id": (F.col("spectrum_id") % 2).cast("string"), "spectrum_id": F.floor(F.col("spectrum_id") / 2)})
    return mz.auto_ppm(own, LO, HI)


@query("datacube", f"WITH {CUBE} SELECT x, y, bin, intensity FROM cube")
def datacube(spark, sf_dir):
    return cube(spark, sf_dir)


@query("pixel_tic", f"WITH {TIC} SELECT x, y, tic FROM tic")
def pixel_tic(spark, sf_dir):
    return tic(spark, sf_dir)


@query("pixel_tic_raw", f"WITH {PEAKS} SELECT x, y, sum(intensity) AS tic FROM peaks GROUP BY x, y")
def pixel_tic_raw(spark, sf_dir):
    return image.pixel_tic_raw(fixtures.spectra(spark, sf_dir))


@query("tic_mask", f"WITH {MASK} SELECT x, y, tic FROM mask")
def tic_mask(spark, sf_dir):
    """Peaks to a thresholded total-ion-current image."""
    return mask_of(tic(spark, sf_dir))


@query("crop", f"WITH {TIC} SELECT x, y, tic FROM tic WHERE y < 20 AND x < 50")
def crop(spark, sf_dir):
    return image.crop(tic(spark, sf_dir), 20, 50)


def _smooth_sql(sigma: float) -> str:
    kernel = image.gaussian_kernel(sigma)
    r = len(kernel) // 2
    rows = ", ".join(f"({k - r}, {w!r}::DOUBLE)" for k, w in enumerate(kernel))
    reflect = lambda i, n: f"CASE WHEN (({i}) % (2 * {n}) + 2 * {n}) % (2 * {n}) < {n} THEN (({i}) % (2 * {n}) + 2 * {n}) % (2 * {n}) ELSE 2 * {n} - 1 - (({i}) % (2 * {n}) + 2 * {n}) % (2 * {n}) END"
    return (f"WITH {TIC}{BOUNDS}, size AS (SELECT x0, y0, x1 - x0 + 1 AS w, y1 - y0 + 1 AS h FROM bounds), kernel(k, g) AS (VALUES {rows}), "
            f"ys AS (SELECT y0 + i AS y, y0 + {reflect('i + k', 'h')} AS src, g FROM size, kernel, range(0, (SELECT h FROM size)) t(i)), "
            f"xs AS (SELECT x0 + i AS x, x0 + {reflect('i + k', 'w')} AS src, g FROM size, kernel, range(0, (SELECT w FROM size)) t(i)), "
            "down AS (SELECT tic.x, ys.y, sum(tic * g) AS v FROM tic JOIN ys ON tic.y = ys.src GROUP BY ALL), "
            "smooth AS (SELECT xs.x, down.y, sum(v * g) AS tic FROM down JOIN xs ON down.x = xs.src GROUP BY ALL) ")


@query("gaussian_smooth", _smooth_sql(1.0) + "SELECT x, y, round(tic, 6) AS tic FROM smooth")
def gaussian_smooth(spark, sf_dir):
    return image.gaussian_smooth(tic(spark, sf_dir), 1.0)


@query("tic_heatmap", _smooth_sql(0.5) + ", d AS (SELECT x0 + i AS x, y0 + j AS y FROM size, range(0, (SELECT w FROM size)) a(i), range(0, (SELECT h FROM size)) b(j)) SELECT d.x, d.y, round(coalesce(tic, 0), 6) AS tic FROM d LEFT JOIN smooth USING (x, y)")
def tic_heatmap(spark, sf_dir):
    return image.dense_grid(image.gaussian_smooth(tic(spark, sf_dir), 0.5))


@query("local_maxima", f"""WITH {TIC}{BOUNDS} SELECT a.x, a.y, a.tic FROM tic a, bounds WHERE a.tic > 0 AND a.x > x0 AND a.x < x1 AND a.y > y0 AND a.y < y1
  AND NOT EXISTS (SELECT 1 FROM tic b WHERE b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.tic > a.tic)""")
def local_maxima(spark, sf_dir):
    return image.local_maxima(tic(spark, sf_dir))


@query("connected_components", f"""WITH RECURSIVE {TIC}, t90 AS (SELECT quantile_cont(tic, 0.9) AS t FROM tic WHERE tic > 0), m AS MATERIALIZED (SELECT x, y, y * 16777216 + x AS id FROM tic, t90 WHERE tic > t),
  e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON b.id IN (a.id - 1, a.id + 1, a.id - 16777216, a.id + 16777216)),
  walk(id, root) AS (SELECT id, id FROM m UNION SELECT e.b, w.root FROM walk w JOIN e ON e.a = w.id)
  SELECT m.x, m.y, min(root) AS component FROM walk JOIN m USING (id) GROUP BY m.x, m.y""")
def connected_components(spark, sf_dir):
    return image.connected_components(mask_of(tic(spark, sf_dir), 90.0).select("image_id", "x", "y"))


def _segment(spark, sf_dir, method):
    pixels = written(tic(spark, sf_dir), "tic")
    bound = threshold.percentile_threshold(pixels).first()["threshold"]
    return image.segment(pixels, bound, method)


@query("segment_watershed")
def segment_watershed(spark, sf_dir):
    return _segment(spark, sf_dir, "watershed")


@query("segment_dfs")
def segment_dfs(spark, sf_dir):
    return _segment(spark, sf_dir, "dfs")


@query("nearest_label", f"""WITH {MASK}, seeds AS (SELECT x, y, 1 + (y // 4) * 32 + x // 4 AS cell_id FROM mask WHERE (x + y) % 7 = 0), orphans AS (SELECT x, y FROM mask WHERE (x + y) % 7 <> 0)
  SELECT o.x, o.y, arg_min(cell_id, ((o.x - s.x) ** 2 + (o.y - s.y) ** 2) * 1000000000 + cell_id) AS cell_id FROM orphans o, seeds s GROUP BY o.x, o.y""")
def nearest_label(spark, sf_dir):
    own = written(labels(spark, sf_dir), "labels")
    return image.nearest_label(own.where("(x + y) % 7 <> 0"), own.where("(x + y) % 7 = 0"))


@query("cell_regions", f"WITH {LABELS} SELECT cell_id, count(*) AS area_px, count(*) * 100.0::DOUBLE AS area_um, round(avg(y), 6) AS centroid_row, round(avg(x), 6) AS centroid_col FROM labels GROUP BY cell_id")
def cell_regions(spark, sf_dir):
    return cells.regions(labels(spark, sf_dir))


@query("cell_boundary_pixels", f"""WITH {LABELS} SELECT x, y, cell_id FROM labels a WHERE (SELECT count(*) FROM labels b WHERE b.cell_id = a.cell_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1) < 4""")
def cell_boundary_pixels(spark, sf_dir):
    return image.boundary_pixels(labels(spark, sf_dir))


#: Vertices between a cell's pixel p and a side outside; (tx, ty) is the way on, with the cell on the right hand.
SEGMENTS = LABELS + """, sides(dx, dy, tx, ty) AS (VALUES (1, 0, 0, 1), (0, 1, -1, 0), (-1, 0, 0, -1), (0, -1, 1, 0)),
  edges AS (SELECT l.cell_id, l.x, l.y, dx, dy, tx, ty, a.x IS NOT NULL AS ahead, b.x IS NOT NULL AS beside FROM labels l CROSS JOIN sides
    LEFT JOIN labels q ON q.cell_id = l.cell_id AND q.x = l.x + dx AND q.y = l.y + dy LEFT JOIN labels a ON a.cell_id = l.cell_id AND a.x = l.x + tx AND a.y = l.y + ty
    LEFT JOIN labels b ON b.cell_id = l.cell_id AND b.x = l.x + dx + tx AND b.y = l.y + dy + ty WHERE q.x IS NULL),
  segments AS (SELECT cell_id, 2 * x + dx AS x2, 2 * y + dy AS y2, CASE WHEN NOT ahead THEN 2 * x + tx WHEN NOT beside THEN 2 * (x + tx) + dx ELSE 2 * (x + dx) + tx END AS to_x2,
    CASE WHEN NOT ahead THEN 2 * y + ty WHEN NOT beside THEN 2 * (y + ty) + dy ELSE 2 * (y + dy) + ty END AS to_y2 FROM edges)"""


@query("contour_segments", f"WITH {SEGMENTS} SELECT cell_id, x2, y2, to_x2, to_y2 FROM segments")
def contour_segments(spark, sf_dir):
    return image.contour_segments(labels(spark, sf_dir))


@query("contour_rings", f"""WITH RECURSIVE {SEGMENTS}, walk AS (SELECT cell_id, x2 AS sx, y2 AS sy, x2, y2, 0::BIGINT AS place FROM segments
    UNION ALL SELECT w.cell_id, sx, sy, to_x2, to_y2, place + 1 FROM walk w JOIN segments s ON s.cell_id = w.cell_id AND s.x2 = w.x2 AND s.y2 = w.y2 WHERE NOT (to_x2 = sx AND to_y2 = sy)),
  heads AS (SELECT cell_id, sx, sy, row_number() OVER (PARTITION BY cell_id ORDER BY sy, sx) AS ring FROM walk GROUP BY cell_id, sx, sy HAVING min(y2 * 100000 + x2) = sy * 100000 + sx)
  SELECT cell_id, ring, place, x2 / 2 AS x, y2 / 2 AS y FROM walk JOIN heads USING (cell_id, sx, sy)""")
def contour_rings(spark, sf_dir):
    return image.contour_rings(labels(spark, sf_dir))


@query("size_filter_px", f"WITH {LABELS} SELECT x, y, cell_id FROM labels WHERE cell_id IN (SELECT cell_id FROM labels GROUP BY cell_id HAVING count(*) BETWEEN 3 AND 6)")
def size_filter_px(spark, sf_dir):
    return image.size_filter(labels(spark, sf_dir), 3, 6)


@query("size_filter_um", f"WITH {LABELS} SELECT x, y, cell_id FROM labels WHERE cell_id IN (SELECT cell_id FROM labels GROUP BY cell_id HAVING count(*) BETWEEN pi() * 100 / 100 AND pi() * 225 / 100)")
def size_filter_um(spark, sf_dir):
    return image.size_filter(labels(spark, sf_dir), 20, 30, "um")


@query("remove_cells", f"WITH {LABELS} SELECT x, y, cell_id FROM labels WHERE cell_id NOT IN (1, 5, 34, 99999)")
def remove_cells(spark, sf_dir):
    return cells.remove_cells(labels(spark, sf_dir), [1, 5, 34, 99999])


@query("export_pixels", f"WITH {LABELLED_CUBE} SELECT cube.x, cube.y, bin, intensity FROM cube JOIN labels USING (x, y)")
def export_pixels(spark, sf_dir):
    return cells.export_pixels(cube(spark, sf_dir), labels(spark, sf_dir))


_ION = "SELECT i, k AS bin FROM range({n}) t(k), (VALUES {ions}) ions(i) WHERE 350.0 + k * 0.1::DOUBLE BETWEEN i - 2.05 AND i + 2.05"


@query("ion_map", f"WITH {LABELLED_CUBE}, w AS ({_ION.format(n=N_BINS, ions='(355.0::DOUBLE)')}) SELECT x, y, sum(intensity) AS intensity FROM cube JOIN w USING (bin) JOIN labels USING (x, y) GROUP BY x, y")
def ion_map(spark, sf_dir):
    return image.ion_map(cube(spark, sf_dir), axis(spark), labels(spark, sf_dir), 355.0, 2.05)


def _stored(spark, sf_dir, mzs):
    path = f"{shared_folder(spark)}/cube-{uuid.uuid4().hex}"
    cube_store.write_cube(cube(spark, sf_dir), path)
    return cube_store.read_cube(spark, path, cube_store.bins_of(axis(spark), mzs, 2.05))


@query("ion_map_stored", f"WITH {LABELLED_CUBE}, w AS ({_ION.format(n=N_BINS, ions='(355.0::DOUBLE)')}) SELECT x, y, sum(intensity) AS intensity FROM cube JOIN w USING (bin) JOIN labels USING (x, y) GROUP BY x, y")
def ion_map_stored(spark, sf_dir):
    """The map from a stored cube, of which only the wanted ranges are read."""
    return image.ion_map(_stored(spark, sf_dir, [355.0]), axis(spark), labels(spark, sf_dir), 355.0, 2.05)


@query("spline_zoom")
def spline_zoom(spark, sf_dir):
    return image.spline_zoom(tic(spark, sf_dir), 1.5)


@query("multi_ion_map", f"""WITH {LABELLED_CUBE}, w AS ({_ION.format(n=N_BINS, ions='(355.0::DOUBLE), (360.5), (369.9)')}), m AS (SELECT x, y, i AS ion, sum(intensity) AS v FROM cube JOIN w USING (bin) JOIN labels USING (x, y) GROUP BY x, y, i)
  SELECT x, y, ion, round(v / max(v) OVER (PARTITION BY ion), 6) AS intensity FROM m""")
def multi_ion_map(spark, sf_dir):
    return image.multi_ion_map(cube(spark, sf_dir), axis(spark), labels(spark, sf_dir), [355.0, 360.5, 369.9], 2.05)


def _spectra_sql(value: str) -> str:
    return (f"WITH {LABELLED_CUBE}, area AS (SELECT cell_id, count(*) AS n FROM labels GROUP BY cell_id), v AS (SELECT cell_id, bin, list(intensity ORDER BY intensity) AS v, sum(intensity) AS s FROM cube JOIN labels USING (x, y) GROUP BY cell_id, bin) "
            f"SELECT cell_id, bin, round({value}, 6) AS value FROM v JOIN area USING (cell_id)")


@query("cell_spectra_mean", _spectra_sql("s / n"))
def cell_spectra_mean(spark, sf_dir):
    return cells.cell_spectra(cube(spark, sf_dir), labels(spark, sf_dir), "mean")


@query("cell_spectra_sum", _spectra_sql("s"))
def cell_spectra_sum(spark, sf_dir):
    return cells.cell_spectra(cube(spark, sf_dir), labels(spark, sf_dir), "sum")


@query("cell_spectra_median", _spectra_sql("list_aggregate(list_concat(list_transform(range(n - len(v)), lambda i: 0.0::DOUBLE), v), 'quantile_cont', 0.5)"))
def cell_spectra_median(spark, sf_dir):
    return cells.cell_spectra(cube(spark, sf_dir), labels(spark, sf_dir), "median")


def _histogram_method(spark, sf_dir, name):
    return threshold.histogram_thresholds(tic(spark, sf_dir)).where(F.col("method") == name).select("threshold")


@query("threshold_otsu", f"WITH {HIST} SELECT round(arg_max(centre, w * (all_w - w) * (s / w - (all_s - s) / (all_w - w)) ** 2), 6) AS threshold FROM cum WHERE w > 0 AND w < all_w")
def threshold_otsu(spark, sf_dir):
    return _histogram_method(spark, sf_dir, "otsu")


@query("threshold_triangle", f"""WITH {HIST}, p AS (SELECT min(bucket) FILTER (n > 0) AS a, max(bucket) FILTER (n > 0) AS b, max(n) AS top FROM hist), q AS (SELECT *, (SELECT min(bucket) FROM hist WHERE n = top) AS peak FROM p),
  f AS (SELECT bucket, centre, n, top, peak - a < b - peak AS flip, CASE WHEN peak - a < b - peak THEN b - bucket ELSE bucket - a END AS x, CASE WHEN peak - a < b - peak THEN b - peak ELSE peak - a END AS width FROM hist, q)
  SELECT round(arg_max(centre, (top * x - width * n) * 1000 - x), 6) AS threshold FROM f WHERE x >= 0 AND x < width""")
def threshold_triangle(spark, sf_dir):
    return _histogram_method(spark, sf_dir, "triangle")


@query("threshold_yen", f"""WITH {HIST}, p AS (SELECT bucket, centre, n / all_w::DOUBLE AS p FROM cum), c AS (SELECT bucket, centre, sum(p) OVER (ORDER BY bucket) AS f, sum(p * p) OVER (ORDER BY bucket) AS q, sum(p * p) OVER () - sum(p * p) OVER (ORDER BY bucket) AS r FROM p)
  SELECT round(arg_max(centre, 2 * ln(f * (1 - f)) - ln(q * r)), 6) AS threshold FROM c WHERE f > 0 AND f < 1 - 1e-12 AND r > 1e-15""")
def threshold_yen(spark, sf_dir):
    return _histogram_method(spark, sf_dir, "yen")


@query("threshold_isodata", f"""WITH {HIST} SELECT round(min(centre), 6) AS threshold FROM (SELECT centre, (s / w + (all_s - s) / (all_w - w)) / 2 - centre AS off, (SELECT (hi - lo) / 256 FROM ends) AS width FROM cum WHERE w > 0 AND w < all_w)
  WHERE off >= 0 AND off < width""")
def threshold_isodata(spark, sf_dir):
    return _histogram_method(spark, sf_dir, "isodata")


@query("threshold_percentile", f"WITH {TIC} SELECT 'percentile' AS method, round(quantile_cont(tic, 0.75), 6) AS threshold FROM tic WHERE tic > 0")
def threshold_percentile(spark, sf_dir):
    return threshold.percentile_threshold(tic(spark, sf_dir))


LI = VALUES + """, shifted AS (SELECT v - (SELECT min(v) FROM vals WHERE n > 0) AS v, n FROM vals WHERE n > 0),
  steps(k, t) AS (SELECT 0, sum(v * n) / sum(n) FROM shifted UNION ALL
    SELECT any_value(k) + 1, (sum(v * n) FILTER (v <= t) / sum(n) FILTER (v <= t) - sum(v * n) FILTER (v > t) / sum(n) FILTER (v > t))
      / (ln(sum(v * n) FILTER (v <= t) / sum(n) FILTER (v <= t)) - ln(sum(v * n) FILTER (v > t) / sum(n) FILTER (v > t))) FROM steps, shifted WHERE k < 100 GROUP BY k),
  li AS (SELECT arg_max(t, k) + (SELECT min(v) FROM vals WHERE n > 0) AS threshold FROM steps)"""


@query("threshold_li", f"WITH RECURSIVE {LI} SELECT 'li' AS method, round(threshold, 6) AS threshold FROM li")
def threshold_li(spark, sf_dir):
    return threshold.li_threshold(written(tic(spark, sf_dir), "tic"))


@query("threshold_gmm")
def threshold_gmm(spark, sf_dir):
    return threshold.gmm_thresholds(tic(spark, sf_dir))


@query("threshold_score", f"""WITH {VALUES}, c AS (SELECT t::DOUBLE AS threshold FROM (VALUES (0), (100), (139), (180), (400)) c(t)),
  a AS (SELECT threshold, sum(n) AS n, sum(v * n) AS s, sum(v * v * n) AS q, coalesce(sum(n) FILTER (v > threshold), 0) AS fn, coalesce(sum(v * n) FILTER (v > threshold), 0) AS fs FROM vals, c GROUP BY threshold)
  SELECT threshold, round(CASE WHEN fn / n < 0.05 OR fn / n > 0.6 OR fn = n THEN 0 ELSE 0.6 * (fn / n * (fs / fn - s / n) ** 2 + (1 - fn / n) * ((s - fs) / (n - fn) - s / n) ** 2) / (q / n - (s / n) ** 2 + 1e-9)
    + 0.4 * exp(-((fn / n - 0.15) ** 2) / (2 * 0.12 ** 2)) END, 6) AS score, round(fn / n, 6) AS cell_frac FROM a""")
def threshold_score(spark, sf_dir):
    given = spark.createDataFrame([(fixtures.IMAGE, "given", float(t)) for t in (0, 100, 139, 180, 400)], "image_id string, method string, threshold double")
    return threshold.scored(tic(spark, sf_dir), given).drop("method")


GIVEN = (("a", 0), ("b", 100), ("c", 139), ("d", 180), ("e", 400))
SCORED = VALUES + f""", c AS (SELECT m AS method, t::DOUBLE AS threshold FROM (VALUES {", ".join(map(str, GIVEN))}) c(m, t)),
  a AS (SELECT method, threshold, sum(n) AS n, sum(v * n) AS s, sum(v * v * n) AS q, coalesce(sum(n) FILTER (v > threshold), 0) AS fn, coalesce(sum(v * n) FILTER (v > threshold), 0) AS fs FROM vals, c GROUP BY method, threshold),
  sc AS (SELECT method, threshold, CASE WHEN fn / n < 0.05 OR fn / n > 0.6 OR fn = n THEN 0 ELSE 0.6 * (fn / n * (fs / fn - s / n) ** 2 + (1 - fn / n) * ((s - fs) / (n - fn) - s / n) ** 2) / (q / n - (s / n) ** 2 + 1e-9)
    + 0.4 * exp(-((fn / n - 0.15) ** 2) / (2 * 0.12 ** 2)) END AS score, fn / n AS cell_frac FROM a)"""


@query("threshold_choice", f"WITH {SCORED} SELECT method, threshold, round(score, 6) AS score, round(cell_frac, 6) AS cell_frac FROM sc ORDER BY score DESC LIMIT 1")
def threshold_choice(spark, sf_dir):
    """The best of given thresholds, as the automatic choice takes it."""
    given = spark.createDataFrame([(fixtures.IMAGE, m, float(t)) for m, t in GIVEN], "image_id string, method string, threshold double")
    return threshold.best_of(threshold.scored(tic(spark, sf_dir), given))


@query("threshold_candidates")
def threshold_candidates(spark, sf_dir):
    return threshold.candidates(written(tic(spark, sf_dir), "tic"))


@query("threshold_auto")
def threshold_auto(spark, sf_dir):
    return threshold.auto_threshold(written(tic(spark, sf_dir), "tic"))


@query("tic_histogram", f"""WITH {TIC}, l AS (SELECT ln(1 + tic) AS v FROM tic WHERE tic > 0), e AS (SELECT min(v) AS a, max(v) AS b, least(300, greatest(80, count(*) // 200)) AS k FROM l)
  SELECT least(k - 1, floor((v - a) / (b - a) * k))::BIGINT AS bucket, count(*) AS n FROM l, e GROUP BY bucket""")
def tic_histogram(spark, sf_dir):
    return threshold.tic_histogram(tic(spark, sf_dir)).select("bucket", "n")


