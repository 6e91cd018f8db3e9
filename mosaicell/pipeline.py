"""The steps from spectra to annotated classes of cells as one chain; each step holds a DataFrame, none holds data."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import mz
from .functions.tables import written
from .operators import annotate, cells, clusters, embedding, image, stats, threshold
from .sources import imzml


@dataclass(frozen=True)
class Imaging:
    """Spectra (image_id, spectrum_id, x, y, mz, intensity) and what has been made of them. Steps return a new object."""

    spectra: DataFrame
    axis: DataFrame | None = None
    binned: DataFrame | None = None
    tic: DataFrame | None = None
    candidates: DataFrame | None = None
    threshold: DataFrame | None = None
    labels: DataFrame | None = None
    cells: DataFrame | None = None
    choice: DataFrame | None = None
    markers: DataFrame | None = None
    options: dict = field(default_factory=dict)

    def _need(self, name: str):
        if getattr(self, name) is None:
            raise ValueError(f"{name} is missing: run the step that makes it first")
        return getattr(self, name)

    def bin(self, lo: float, hi: float, width: float = 0.1, normalization: str = "none") -> Imaging:
        """Peaks on a uniform axis, and the image of their totals."""
        axis = mz.fixed_axis(self.spectra.sparkSession, lo, hi, width)
        return self._binned(axis, lambda peaks: mz.bin_fixed(peaks, lo, hi, width), normalization)

    def bin_adaptive(self, lo: float, hi: float, resolving_power: float | None = None, ppm: float | None = None, normalization: str = "none") -> Imaging:
        """Peaks on an axis whose bins widen with m/z, and the image of their totals. Without a width, ppm follows from the spectra; with too few peaks for that, bins are 0.1 wide."""
        if resolving_power is None and ppm is None:
            ppm = mz.auto_ppm(mz.explode_peaks(mz.sound(self.spectra)), lo, hi).first()["ppm"]
            if ppm is None:
                return self.bin(lo, hi, 0.1, normalization)
        edges = mz.adaptive_edges(lo, hi, resolving_power, ppm)
        return self._binned(mz.adaptive_axis(self.spectra.sparkSession, edges), lambda peaks: mz.bin_adaptive(peaks, edges), normalization)

    def _binned(self, axis: DataFrame, place, normalization: str) -> Imaging:
        if self.axis is not None:
            raise ValueError("the axis is set already")
        peaks = mz.explode_peaks(mz.normalized(mz.sound(self.spectra), normalization))
        binned = written(place(peaks).select(*image.PIXEL, "bin", "intensity"), "binned")
        return replace(self, axis=axis, binned=binned, tic=written(image.pixel_tic(binned), "tic"))

    def crop(self, rows: int, columns: int) -> Imaging:
        """Pixels of the first rows and columns alone."""
        return replace(self, binned=image.crop(self._need("binned"), rows, columns), tic=image.crop(self._need("tic"), rows, columns))

    def auto_threshold(self, method: str = "auto", **options) -> Imaging:
        """A threshold for each image."""
        found = written(threshold.auto_threshold(self._need("tic"), method, **options), "thresholds")
        return replace(self, threshold=found.select("image_id", "threshold"), candidates=threshold.candidates(self.tic))

    def set_threshold(self, value: float) -> Imaging:
        """The same threshold for all images."""
        return replace(self, threshold=self._need("tic").select("image_id").distinct().withColumn("threshold", F.lit(float(value))))

    def segment(self, method: str = "watershed", **options) -> Imaging:
        return replace(self, labels=written(image.segment(self._need("tic"), self._need("threshold"), method, **options), "labels"))

    def extract(self, agg: str = "mean", pixel_um: float = 10.0) -> Imaging:
        """Cells with their spectra."""
        labels = self._need("labels")
        long = cells.cell_spectra(image.datacube(self._need("binned")), labels, agg)
        return replace(self, cells=written(cells.with_spectrum(long, cells.regions(labels, pixel_um), self._need("axis").count()), "cells"))

    def quality(self, **options) -> Imaging:
        """Quality metrics and flags as columns of the cells."""
        return replace(self, cells=written(cells.qc_flags(cells.qc_metrics(self._need("cells")), **options), "cells"))

    def drop_flagged(self) -> Imaging:
        """Flagged cells leave both the labels and the table."""
        gone = self._need("cells").where("flagged").select("image_id", "cell_id")
        return replace(self, labels=cells.remove_cells(self.labels, gone), cells=self.cells.where("not flagged"))

    def remove_cells(self, ids, image_id: str | None = None) -> Imaging:
        """These cells leave the labels, and the table where there is one; see operators.cells.remove_cells."""
        gone = lambda rows: cells.remove_cells(rows, ids, image_id)
        return replace(self, labels=gone(self._need("labels")), cells=None if self.cells is None else gone(self.cells))

    def remove_clone(self, clone: int) -> Imaging:
        """Cells of a class leave both the labels and the table."""
        labels, own = cells.remove_clone(self._need("labels"), self._need("cells"), clone)
        return replace(self, labels=labels, cells=own)

    def combine_clones(self, clones, new_label: int | None = None) -> Imaging:
        return replace(self, cells=written(cells.combine_clones(self._need("cells"), clones, new_label), "cells"))

    def cluster(self, method: str = "gmm", n_components: int = 2, reduction: str = "components", **options) -> Imaging:
        """Soft clusters of the cells' principal components, or of their neighbour embedding with `reduction="neighbours"`. Mixtures see standardised spectra, fuzzy means see them scaled alone."""
        if reduction not in ("components", "neighbours"):
            raise ValueError("reduction must be components or neighbours")
        own = self._need("cells")
        spectra = own.select("image_id", "cell_id", "spectrum")
        if reduction == "neighbours":
            embedded = embedding.neighbour_embedding(spectra)
        else:
            embedded = clusters.pca_embedding(clusters.standardized_cells(spectra), n_components, zscore=method == "gmm")
        found, choice = (clusters.gmm_clusters if method == "gmm" else clusters.fcm_clusters)(embedded.select("image_id", "cell_id", "embedding"), **options)
        return replace(self, cells=written(own.join(found, ["image_id", "cell_id"]), "cells"), choice=choice)

    def clone_quality(self, **options) -> DataFrame:
        return cells.clone_quality(self._need("cells"), **options)

    def differential(self, method: str = "kruskal") -> DataFrame:
        return stats.differential(cells.long(self._need("cells"), "class"), self._need("axis"), method)

    def find_markers(self, n: int = 30, alpha: float = 0.05, fold: float = 1.5, method: str = "kruskal") -> Imaging:
        return replace(self, markers=written(stats.top_markers(self.differential(method), n, alpha, fold), "markers"))

    def annotate_ions(self, mode: str = "pos", ppm: float = 5.0, **options) -> DataFrame:
        """Hits for the markers, or for each class's ions where no markers were found yet."""
        return annotate.Annotator(self.spectra.sparkSession, mode, ppm).clones(self._need("cells"), self._need("axis"), markers=self.markers, **options)

    def export_csv(self, path: str, mode: str = "full", decimals: int | None = 4, hits: DataFrame | None = None) -> None:
        cells.export_csv(self._need("cells"), self._need("axis"), path, mode, decimals, hits)

    def export_imzml(self, folder: str, lines: int | None = None) -> None:
        """The labelled pixels of each image as a file of its own, or a folder of its own with a file for each so many lines."""
        imzml.export_images(cells.export_pixels(image.datacube(self._need("binned")), self._need("labels")), self._need("axis"), folder, lines)

    def ion_map(self, mz_value: float, tolerance: float = 0.1, **options) -> DataFrame:
        return image.ion_map(image.datacube(self._need("binned")), self._need("axis"), self._need("labels"), mz_value, tolerance, **options)

    def n_cells(self) -> int:
        return self._need("labels").agg(F.countDistinct("image_id", "cell_id")).first()[0]
