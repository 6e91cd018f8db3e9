"""Image operators on sparse pixels (image_id, x, y, ...): absent pixels of an image's grid are zeros."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import Scratch, components, lowest_of_component, written

PIXEL = ["image_id", "x", "y"]


def relative_coords(pixels: DataFrame) -> DataFrame:
    """Adds rel_x, rel_y (from the image's smallest coordinates), width and height of its grid."""
    bounds = pixels.groupBy("image_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return (pixels.join(bounds, "image_id").withColumns({"rel_x": F.col("x") - F.col("x0"), "rel_y": F.col("y") - F.col("y0"),
                                                        "width": F.col("x1") - F.col("x0") + 1, "height": F.col("y1") - F.col("y0") + 1}).drop("x0", "x1", "y0", "y1"))


def datacube(binned: DataFrame) -> DataFrame:
    """Sum of intensities per pixel and bin; repeated coordinates add up."""
    return binned.groupBy(*PIXEL, "bin").agg(F.sum("intensity").alias("intensity"))


def pixel_tic(binned: DataFrame) -> DataFrame:
    """Total ion current per pixel, from binned peaks at once: the cube isn't needed."""
    return binned.groupBy(*PIXEL).agg(F.sum("intensity").alias("tic"))


def pixel_tic_raw(spectra: DataFrame) -> DataFrame:
    """Total of raw intensities per pixel, of any m/z: added up in the row, then over repeated coordinates."""
    own = F.expr("aggregate(intensity, 0D, (s, v) -> s + v)")
    return spectra.select(*PIXEL, own.alias("own")).groupBy(*PIXEL).agg(F.sum("own").alias("tic"))


def tic_mask(tic: DataFrame, threshold: float | DataFrame) -> DataFrame:
    """Pixels above the threshold: one for all images, or a table (image_id, threshold); images without one have no pixel."""
    if not isinstance(threshold, DataFrame):
        return tic.where(F.col("tic") > threshold)
    own = threshold.select("image_id", F.col("threshold").alias("_bound"))
    return tic.join(own, "image_id").where(F.col("tic") > F.col("_bound")).drop("_bound")


def crop(pixels: DataFrame, rows: int, columns: int) -> DataFrame:
    """Pixels of the first rows and columns."""
    return pixels.where((F.col("y") < rows) & (F.col("x") < columns))


def grid_bounds(pixels: DataFrame) -> DataFrame:
    """(image_id, x0, y0, width, height): a row for each image."""
    return pixels.groupBy("image_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"))


def dense_grid(pixels: DataFrame, value: str = "tic") -> DataFrame:
    """All pixels of each image's grid, with zeros where there is none."""
    grid = (grid_bounds(pixels).withColumn("y", F.explode(F.expr("sequence(y0, y0 + height - 1)"))).withColumn("x", F.explode(F.expr("sequence(x0, x0 + width - 1)"))))
    return grid.select(*PIXEL).join(pixels.select(*PIXEL, value), PIXEL, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [w / sum(weights) for w in weights]


def _smooth_along(pixels: DataFrame, axis: str, kernel: list[float], value: str) -> DataFrame:
    """One pass: each pixel hands its value to those that see it, directly or by reflection at a border."""
    radius = len(kernel) // 2
    start, size = ("x0", "width") if axis == "x" else ("y0", "height")
    steps = F.array(*(F.struct(F.lit(k - radius).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(kernel)))
    turns = F.expr(f"sequence(-int({radius} div (2 * {size})) - 1, int({radius} div (2 * {size})) + 1)")
    at = F.expr(f"{axis} - {start}")
    return (pixels.withColumn("turn", F.explode(turns)).withColumn("image", F.explode(F.array(at + 2 * F.col(size) * F.col("turn"), -at - 1 + 2 * F.col(size) * F.col("turn"))))
            .withColumn("step", F.explode(steps)).withColumn("target", F.col("image") - F.col("step.k")).where(F.expr(f"target >= 0 and target < {size}"))
            .withColumn(axis, (F.col("target") + F.col(start)).cast("int"))
            .groupBy(*PIXEL, "x0", "y0", "width", "height").agg(F.sum(F.col("step.w") * F.col(value)).alias(value)))


def gaussian_smooth(pixels: DataFrame, sigma: float, value: str = "tic") -> DataFrame:
    """Gaussian smoothing with reflection at the borders of each image's grid; rows where the result isn't 0. Sigma 0 changes nothing."""
    if sigma == 0:
        return pixels.select(*PIXEL, value)
    bounded = pixels.select(*PIXEL, value).join(grid_bounds(pixels), "image_id")
    kernel = gaussian_kernel(sigma)
    return _smooth_along(_smooth_along(bounded, "y", kernel, value), "x", kernel, value).select(*PIXEL, value)


def spline_lines(lines: np.ndarray, size: int) -> np.ndarray:
    """Lines (rows of an array) at `size` places spread evenly from their first to their last value, by cubic splines mirrored at both ends.

    The coefficients' tridiagonal system is solved by a forward and a backward recurrence over all lines at once.
    """
    n = lines.shape[1]
    if n == 1:
        return np.repeat(lines, size, axis=1)
    # (c[i-1] + 4 c[i] + c[i+1]) / 6 = value; at the ends the missing neighbour is the other one.
    above, right = np.empty(n), np.empty_like(lines, float)
    above[0], right[:, 0] = 0.5, 6 * lines[:, 0] / 4
    for i in range(1, n):
        below = 2.0 if i == n - 1 else 1.0
        pivot = 4 - below * above[i - 1]
        above[i] = 1 / pivot
        right[:, i] = (6 * lines[:, i] - below * right[:, i - 1]) / pivot
    for i in range(n - 2, -1, -1):
        right[:, i] -= above[i] * right[:, i + 1]
    at = np.arange(size) * ((n - 1) / (size - 1)) if size > 1 else np.zeros(1)
    first = np.minimum(np.floor(at).astype(int), n - 1)
    t = at - first
    weights = ((1 - t) ** 3 / 6, (3 * t**3 - 6 * t**2 + 4) / 6, (-3 * t**3 + 3 * t**2 + 3 * t + 1) / 6, t**3 / 6)
    mirrored = lambda i: (n - 1) - np.abs((n - 1) - np.abs(i) % (2 * (n - 1)))
    return sum(w * right[:, mirrored(first + k)] for w, k in zip(weights, (-1, 0, 1, 2)))


def _zoomed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each new place of each line: (image_id, line, place, v); lines have their values by place, absent ones are 0."""
    for batch in batches:
        long, short = batch.column("n").to_numpy(), batch.column("size").to_numpy()
        out = []
        for n, size in sorted(set(zip(long.tolist(), short.tolist()))):
            rows = np.flatnonzero((long == n) & (short == size))
            dense = np.zeros((len(rows), n))
            for k, r in enumerate(rows.tolist()):
                entries = batch.column("e")[r].values
                dense[k, entries.field("i").to_numpy()] = entries.field("v").to_numpy()
            out.append((np.repeat(rows, size), np.tile(np.arange(size), len(rows)), spline_lines(dense, size).ravel()))
        rows, place, v = (np.concatenate(c) if out else np.empty(0, int) for c in zip(*out)) if out else (np.empty(0, int),) * 3
        take = pa.array(rows)
        yield pa.RecordBatch.from_arrays([batch.column("image_id").take(take), batch.column("line").take(take), pa.array(place, pa.int32()), pa.array(v, pa.float64())], ["image_id", "line", "place", "v"])


def spline_zoom(pixels: DataFrame, zoom: float, value: str = "tic") -> DataFrame:
    """(image_id, x, y, value) of each image on a grid `zoom` times as fine, by cubic splines: first along rows, then along columns.

    The grid reaches from the image's least to its largest coordinate, absent pixels are zeros; the new one has
    round(size x zoom) places each way, numbered from 0, the first and last on the old ones. A line is the unit of work.
    """
    bounds = grid_bounds(pixels)
    kind = pixels.schema["image_id"].dataType.simpleString()
    own = pixels.join(bounds, "image_id").select("image_id", (F.col("y") - F.col("y0")).cast("int").alias("line"), (F.col("x") - F.col("x0")).cast("int").alias("i"), F.col(value).cast("double").alias("v"), "width", "height")

    def along(rows: DataFrame, n: str) -> DataFrame:
        size = F.greatest(F.round(F.col(n) * F.lit(float(zoom))), F.lit(1)).cast("int")
        lines = rows.groupBy("image_id", "line", F.col(n).cast("int").alias("n"), size.alias("size")).agg(F.collect_list(F.struct("i", "v")).alias("e"))
        return lines.mapInArrow(_zoomed, f"image_id {kind}, line int, place int, v double")

    wide = along(own, "width").join(bounds.select("image_id", "height"), "image_id").select("image_id", F.col("place").alias("line"), F.col("line").alias("i"), "v", "height")
    return along(wide, "height").select("image_id", F.col("line").alias("x"), F.col("place").alias("y"), F.col("v").alias(value))


def _offsets(rows: int, columns: int) -> F.Column:
    return F.array(*(F.struct(F.lit(b).alias("dx"), F.lit(a).alias("dy")) for a in range(-(rows // 2), rows - rows // 2) for b in range(-(columns // 2), columns - columns // 2)))


#: Side of a tile, in pixels: what touches only pixels nearby is done tile by tile, as arrays.
TILE = 256


def _tiled(pixels: DataFrame, left: int = 0, right: int = 0, above: int = 0, below: int = 0) -> DataFrame:
    """Adds tx, ty: each pixel once for every tile that it lies in or at most so many pixels to the left of, to the right of, above or below."""
    reach = lambda c, before, after: F.explode(F.sequence(F.floor((F.col(c) - after) / TILE), F.floor((F.col(c) + before) / TILE)))
    return pixels.where("image_id is not null and x is not null and y is not null").withColumn("tx", reach("x", left, right)).withColumn("ty", reach("y", above, below))


def _tops(footprint: tuple[int, int], value: str):
    rows, columns = footprint
    above, left = rows // 2, columns // 2

    def run(tile: pa.Table) -> pa.Table:
        tile = tile.combine_chunks()
        x, y, tx, ty = (tile.column(c).to_numpy().astype(np.int64) for c in ("x", "y", "tx", "ty"))
        x, y = x - tx * TILE + left, y - ty * TILE + above
        order = np.unique(tile.column(value).to_numpy(), return_inverse=True)[1].ravel() + 1  # numbers in the values' order, 0 where nothing is
        grid = np.zeros((TILE + rows - 1, TILE + columns - 1), np.int64)
        np.maximum.at(grid, (y, x), order)
        around = np.zeros((TILE, TILE), np.int64)
        for i in range(rows):
            for j in range(columns):
                np.maximum(around, grid[i : i + TILE, j : j + TILE], out=around)
        own = np.flatnonzero((x >= left) & (x < left + TILE) & (y >= above) & (y < above + TILE))
        return tile.select([*PIXEL, value]).take(pa.array(own[order[own] == around[y[own] - above, x[own] - left]]))

    return run


def local_maxima(pixels: DataFrame, footprint: tuple[int, int] = (3, 3), value: str = "tic", border: int = 1) -> DataFrame:
    """Pixels whose value is over 0 and the largest under the footprint around them, `border` pixels from the grid's edge or more. Tiles of pixels, with what the footprint reaches beyond them, are compared as arrays."""
    rows, columns = footprint
    own = pixels.select(*PIXEL, value)
    tiles = _tiled(own.where(F.col(value) > 0), columns // 2, columns - columns // 2 - 1, rows // 2, rows - rows // 2 - 1)
    tops = tiles.groupBy("image_id", "tx", "ty").applyInArrow(_tops(footprint, value), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields))
    inner = F.expr(f"x - x0 >= {border} and y - y0 >= {border} and x0 + width - 1 - x >= {border} and y0 + height - 1 - y >= {border}")
    return tops.join(grid_bounds(pixels), "image_id").where(inner).select(*PIXEL, value)


def _joined_in_tile(neighbours: int):
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if neighbours == 8 else [])

    def run(tile: pa.Table) -> pa.Table:
        tile = tile.combine_chunks()
        x, y, tx, ty = (tile.column(c).to_numpy().astype(np.int64) for c in ("x", "y", "tx", "ty"))
        i, j = y - ty * TILE, x - tx * TILE
        at = np.full((TILE + 2, TILE + 2), -1)
        order = np.argsort(i * TILE + j)
        at[i[order] + 1, j[order] + 1] = np.arange(len(order))
        u, v = [], []
        for di, dj in steps:
            there = at[i[order] + 1 + di, j[order] + 1 + dj]
            u.append(np.flatnonzero(there >= 0))
            v.append(there[there >= 0])
        u, v, label = np.concatenate(u), np.concatenate(v), np.arange(len(order))
        while True:  # labels fall to the first pixel's: links hook labels, labels point on
            new = label.copy()
            np.minimum.at(new, label[u], label[v])
            np.minimum.at(new, label[v], label[u])
            while (new[new] != new).any():
                new = new[new]
            if (new == label).all():
                break
            label = new
        first = order[label]
        edge = (i == 0) | (i == TILE - 1) | (j == 0) | (j == TILE - 1)
        out = tile.select(PIXEL).take(pa.array(order))
        return out.append_column("part", pa.array(y[first] * (1 << 24) + x[first])).append_column("edge", pa.array(edge[order]))

    return run


def connected_components(mask: DataFrame, neighbours: int = 4) -> DataFrame:
    """Adds `component` to mask pixels: the number x + y * 2**24 of its first pixel in raster order, equal for connected pixels.

    Tiles of pixels are labelled as arrays; only links across the tiles' edges go through alternating star steps, over
    all images in one job. Their nodes are parts of a tile, by number of their row in a written table, so that there may
    be any number of images.
    """
    scratch = Scratch()
    own = _tiled(mask.select(*PIXEL).distinct())
    parts = own.groupBy("image_id", "tx", "ty").applyInArrow(_joined_in_tile(neighbours), ", ".join(f"{c} {mask.schema[c].dataType.simpleString()}" for c in PIXEL) + ", part long, edge boolean")
    parts = scratch.written(parts, "parts")
    edges = parts.where("edge")
    nodes = scratch.written(edges.select("image_id", "part").distinct().withColumn("node", F.monotonically_increasing_id()), "nodes")
    edges = scratch.written(edges.join(nodes, ["image_id", "part"]).select(*PIXEL, "node"), "edges")
    steps = [(1, 0), (0, 1)] + ([(1, 1), (-1, 1)] if neighbours == 8 else [])
    ahead = edges.withColumn("o", F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in steps))))
    ahead = ahead.select("image_id", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), F.col("node").alias("u"))
    roots = components(ahead.join(edges.select(*PIXEL, F.col("node").alias("v")), PIXEL).select("u", "v"))
    lowest = lowest_of_component(nodes.select("node", F.col("part").alias("component")), roots, "component")
    lowest = scratch.written(lowest.join(nodes, "node").where("component <> part").select("image_id", "part", "component"), "lowest")
    found = parts.join(lowest, ["image_id", "part"], "left").select(*PIXEL, F.coalesce("component", "part").alias("component"))
    out = written(mask.join(found, PIXEL), "connected")
    scratch.clear()
    return out


def nearest_label(orphans: DataFrame, labelled: DataFrame, cell_col: str = "cell_id", reach: int = 8) -> DataFrame:
    """Orphan pixels with the label of the nearest labelled pixel; ties go to the smallest label.

    Both sides are cut into squares of `reach` pixels; a pixel meets its own and the eight squares around it. What has
    no label within `reach` tries again with a reach eight times as long: neither all pairs nor one task.
    """
    left, done, spark = orphans.select(*PIXEL), None, orphans.sparkSession
    images = labelled.select("image_id").distinct()
    left = left.join(images, "image_id", "left_semi")
    while True:
        square = lambda c: F.floor(F.col(c) / reach)  # noqa: E731,B023
        near = F.explode(_offsets(3, 3))
        asks = left.withColumn("o", near).select(*PIXEL, (square("x") + F.col("o.dx")).alias("sx"), (square("y") + F.col("o.dy")).alias("sy"))
        gives = labelled.select("image_id", F.col("x").alias("lx"), F.col("y").alias("ly"), F.col(cell_col).alias("label"), square("x").alias("sx"), square("y").alias("sy"))
        d2 = F.pow(F.col("x") - F.col("lx"), 2) + F.pow(F.col("y") - F.col("ly"), 2)
        found = (asks.join(gives, ["image_id", "sx", "sy"]).groupBy(*PIXEL).agg(F.min(F.struct(d2.alias("d2"), "label")).alias("best"))
                 .where(F.col("best.d2") <= reach * reach).select(*PIXEL, F.col("best.label").alias(cell_col)))
        found = written(found, "nearest")
        done = found if done is None else done.unionByName(found)
        left = written(left.join(found, PIXEL, "left_anti"), "orphans")
        if left.isEmpty():
            return done
        reach *= 8


def boundary_pixels(labels: DataFrame) -> DataFrame:
    """Pixels of a cell with a 4-neighbour that isn't the same cell's."""
    sides = F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))))
    around = labels.withColumn("o", F.explode(sides)).select("image_id", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), "cell_id")
    same = around.groupBy(*PIXEL, "cell_id").agg(F.count("*").alias("n")).where("n = 4")
    return labels.join(same, [*PIXEL, "cell_id"], "left_anti")


#: Sides of a pixel in the order in which a contour turns: right, down, left, up.
SIDES = ((1, 0), (0, 1), (-1, 0), (0, -1))


def contour_segments(labels: DataFrame) -> DataFrame:
    """(image_id, cell_id, x2, y2, to_x2, to_y2): the contour of each cell at half between its pixels and what isn't the cell's.

    Marching squares on 0 and 1: a vertex lies between a pixel of the cell and a 4-neighbour outside, in doubled
    coordinates; each has one segment to the next vertex, with the cell on its right hand (y pointing down). Pixels that
    only touch at a corner are told apart. Everything beyond an image's pixels is outside. `labels` has one row for each pixel.
    """
    sides = F.array(*(F.struct(F.lit(k).alias("k"), *(F.lit(v).alias(n) for n, v in zip(("dx", "dy", "tx", "ty"), (*SIDES[k], *SIDES[(k + 1) % 4])))) for k in range(4)))
    own = labels.select(*PIXEL, "cell_id")
    each = own.withColumn("s", F.explode(sides)).select(*PIXEL, "cell_id", "s.*")
    key = ["image_id", "cell_id"]
    there = lambda dx, dy, name: own.select(*key, (F.col("x") - dx).alias("_x"), (F.col("y") - dy).alias("_y"), F.lit(True).alias(name))

    def known(rows: DataFrame, x: F.Column, y: F.Column, name: str) -> DataFrame:
        return rows.withColumns({"_x": x, "_y": y}).join(there(0, 0, name), [*key, "_x", "_y"], "left").drop("_x", "_y")

    out = known(each, F.col("x") + F.col("dx"), F.col("y") + F.col("dy"), "q").where("q is null").drop("q")
    out = known(out, F.col("x") + F.col("tx"), F.col("y") + F.col("ty"), "ahead")
    out = known(out, F.col("x") + F.col("dx") + F.col("tx"), F.col("y") + F.col("dy") + F.col("ty"), "beside")
    # Ahead outside: round the pixel's corner. Else straight on, or into the corner before the pixel beside it.
    nx = F.when(F.col("ahead").isNull(), 2 * F.col("x") + F.col("tx")).when(F.col("beside").isNull(), 2 * (F.col("x") + F.col("tx")) + F.col("dx")).otherwise(2 * (F.col("x") + F.col("dx")) + F.col("tx"))
    ny = F.when(F.col("ahead").isNull(), 2 * F.col("y") + F.col("ty")).when(F.col("beside").isNull(), 2 * (F.col("y") + F.col("ty")) + F.col("dy")).otherwise(2 * (F.col("y") + F.col("dy")) + F.col("ty"))
    return out.select(*key, (2 * F.col("x") + F.col("dx")).alias("x2"), (2 * F.col("y") + F.col("dy")).alias("y2"), nx.alias("to_x2"), ny.alias("to_y2"))


#: Pixels, of whole cells, whose rings are chained together in a task. Larger cells are spread over tasks.
RING_PIXELS = 100_000


def _rings(task: pa.Table) -> pa.Table:
    """The rings of whole cells, by the rules of `contour_segments`: a vertex is a pixel's number times 4 and the number of its side."""
    corners = [tuple(a + b for a, b in zip(SIDES[k], SIDES[(k + 1) % 4])) for k in range(4)]
    mask = Mask(task, tuple((dy, dx) for dx, dy in (*SIDES, *corners)))
    side, corner = np.stack(mask.near[:4], axis=1), np.stack(mask.near[4:], axis=1)
    p, k = np.nonzero(side < 0)
    on = (k + 1) % 4
    ahead, beside = side[p, on], corner[p, k]
    to = np.where(ahead < 0, 4 * p + on, np.where(beside < 0, 4 * ahead + k, 4 * beside + (k + 3) % 4))
    x, y = (2 * mask.values(c).astype(np.int64)[p] + np.array(SIDES)[k, i] for i, c in enumerate(("x", "y")))
    # Vertices in order of their cell, y and x, so that the least of a ring has the least number.
    order = np.lexsort((x, y, mask.group[p]))
    p, x, y, place = p[order], x[order], y[order], np.full(4 * len(side), -1)
    place[(4 * p + k[order])] = np.arange(len(order))
    start = place[to[order]]
    low, to = np.minimum(np.arange(len(order)), start), start
    while True:  # each learns what the vertex it points to has learnt, and points twice as far
        new, to = np.minimum(low, low[to]), to[to]
        if (new == low).all():
            break
        low = new
    steps, to = np.ones(len(order), np.int64), start.copy()
    while len(going := np.flatnonzero(to != low)):  # pointers end at the least vertex
        steps[going], to[going] = steps[going] + steps[to[going]], to[to[going]]
    firsts = np.unique(low)
    group = mask.group[p[firsts]]
    ring = np.zeros(len(order), np.int32)
    ring[firsts] = np.arange(len(firsts)) - np.searchsorted(group, group) + 1
    out = mask.table.select(["image_id", "component"]).take(pa.array(p)).rename_columns(["image_id", "cell_id"])
    for name, column in (("ring", ring[low]), ("place", steps[low] - steps), ("x", x / 2), ("y", y / 2)):
        out = out.append_column(name, pa.array(column))
    return out


def contour_rings(labels: DataFrame) -> DataFrame:
    """(image_id, cell_id, ring, place, x, y): closed rings around each cell and its holes, vertex by vertex.

    ring numbers a cell's rings by their first vertex (least y, then x), from 1; place counts from 0 there, along
    `contour_segments`. Cells share tasks, as arrays: a pixel is shuffled once. Cells of more than RING_PIXELS pixels go
    through `_large_rings`, which spreads a ring over tasks. Pixels without image or cell have no ring.
    """
    scratch = Scratch()
    kinds = {c: labels.schema[c].dataType.simpleString() for c in ("image_id", "cell_id")}
    own = scratch.written(labels.where("image_id is not null and cell_id is not null").select(*PIXEL, "cell_id"), "cells")
    sizes = scratch.written(own.groupBy("image_id", "cell_id").agg(F.count("*").alias("n")), "sizes")
    large, total = sizes.where(F.col("n") > RING_PIXELS).select("image_id", "cell_id"), own.count()
    several = not large.isEmpty()
    small = own.join(large, ["image_id", "cell_id"], "left_anti") if several else own
    dealt = small.withColumn("task", F.pmod(F.xxhash64("image_id", "cell_id"), F.lit(max(1, -(-total // RING_PIXELS))))).withColumnRenamed("cell_id", "component")
    out = dealt.groupBy("task").applyInArrow(_rings, f"image_id {kinds['image_id']}, cell_id {kinds['cell_id']}, ring int, place long, x double, y double")
    if several:
        out = out.unionByName(_large_rings(own.join(large, ["image_id", "cell_id"], "left_semi")))
    out = written(out, "contours")
    scratch.clear()
    return out


def _large_rings(labels: DataFrame) -> DataFrame:
    """What `contour_rings` tells, of cells of any size. Segments are chained by pointer jumping: each round, every vertex
    learns what the vertex it points to has learnt, and points twice as far; rounds are written tables, as many as the
    logarithm of the longest ring. Rings of any length are spread over tasks.
    """
    key = ["image_id", "cell_id"]
    scratch, now = Scratch(), Scratch()
    segments = scratch.written(contour_segments(labels), "segments")
    vertex = lambda y, x: F.struct(F.col(y).alias("y2"), F.col(x).alias("x2"))
    links = scratch.written(segments.select(*key, vertex("y2", "x2").alias("v"), vertex("to_y2", "to_x2").alias("to")), "links")
    state = now.written(links.select(*key, "v", "to", F.least("v", "to").alias("low")), "rings")
    while True:  # the least vertex of each ring
        ahead = state.select(*key, F.col("v").alias("to"), F.col("to").alias("next"), F.col("low").alias("low_next"))
        following = Scratch()
        new = following.written(state.join(ahead, [*key, "to"]).select(*key, "v", F.col("next").alias("to"), F.least("low", "low_next").alias("low"), (F.col("low_next") < F.col("low")).alias("changed")), "rings")
        settled = new.where("changed").isEmpty()
        now.clear()
        now, state = following, new.drop("changed")
        if settled:
            break
    lows = scratch.written(state.select(*key, "v", "low"), "lows")
    now.clear()
    # How far it is to the ring's least vertex: pointers end there.
    now = Scratch()
    state = now.written(links.join(lows, [*key, "v"]).select(*key, "v", "low", "to", F.lit(1).cast("long").alias("steps")), "steps")
    while True:
        ahead = state.select(*key, F.col("v").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        going = state.where("to <> low")
        if going.isEmpty():
            break
        following = Scratch()
        new = going.join(ahead, [*key, "to"]).select(*key, "v", "low", F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps"))
        new = following.written(new.unionByName(state.where("to = low")), "steps")
        now.clear()
        now, state = following, new
    sizes = state.groupBy(*key, "low").agg(F.max("steps").alias("n"))
    numbers = sizes.withColumn("ring", F.row_number().over(W.partitionBy(*key).orderBy("low")))
    out = state.join(numbers, [*key, "low"]).select(*key, "ring", (F.col("n") - F.col("steps")).alias("place"), (F.col("v.x2") / 2).alias("x"), (F.col("v.y2") / 2).alias("y"))
    out = written(out, "contours")
    now.clear()
    scratch.clear()
    return out


def ion_map(cube: DataFrame, axis: DataFrame, labels: DataFrame, mz: float, tolerance: float = 0.1, clip_min: float = 0.0, clip_max: float | None = None, sigma: float = 0.0) -> DataFrame:
    """Sum of the bins within `tolerance` of an m/z per labelled pixel; clipped only if `clip_max` is given."""
    out = multi_ion_map(cube, axis, labels, [mz], tolerance, normalize_each=False, sigma=sigma).drop("ion")
    return out if clip_max is None else out.withColumn("intensity", F.least(F.greatest("intensity", F.lit(float(clip_min))), F.lit(float(clip_max))))


def multi_ion_map(cube: DataFrame, axis: DataFrame, labels: DataFrame, mzs: list[float], tolerance: float = 0.1, normalize_each: bool = True, sigma: float = 0.0) -> DataFrame:
    """(image_id, x, y, ion, intensity) for each ion of a short list, each over its own image's largest value if `normalize_each`.

    A list whose ions have no bin at all is an error for one ion, else such ions are left out.
    """
    ions = F.array(*(F.lit(float(m)) for m in mzs))
    wanted = axis.withColumn("ion", F.explode(ions)).where(F.col("mz").between(F.col("ion") - tolerance, F.col("ion") + tolerance)).select("bin", "ion")
    bins = sorted({r["bin"] for r in wanted.select("bin").collect()})  # a few for each ion
    if not bins and len(mzs) == 1:
        raise ValueError(f"no bin within {tolerance} of m/z {mzs[0]}")
    # The list of bins is a filter that reaches below the cube's aggregation.
    out = (cube.where(F.col("bin").isin(bins)).join(F.broadcast(wanted), "bin").join(labels.select(*PIXEL), PIXEL, "left_semi")
           .groupBy(*PIXEL, "ion").agg(F.sum("intensity").alias("intensity")))
    if sigma > 0:
        parts = [gaussian_smooth(out.where(F.col("ion") == m), sigma, "intensity").withColumn("ion", F.lit(float(m))) for m in mzs]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
    if normalize_each:
        top = out.groupBy("image_id", "ion").agg(F.max("intensity").alias("top"))
        out = out.join(top, ["image_id", "ion"]).withColumn("intensity", F.when(F.col("top") > 0, F.col("intensity") / F.col("top")).otherwise(F.col("intensity"))).drop("top")
    return out.select(*PIXEL, "ion", "intensity")


def size_filter(labels: DataFrame, least: float | None = 2, most: float | None = None, unit: str = "px", pixel_um: float = 10.0, remove_isolated: bool = True) -> DataFrame:
    """Labels of cells within the bounds: pixels, or diameters in micrometres (unit um). Without `remove_isolated` there is no lower bound."""
    if unit not in ("px", "um"):
        raise ValueError("unit must be px or um")
    area = (lambda d: d) if unit == "px" else (lambda d: math.pi * (d / 2) ** 2 / pixel_um**2)
    sizes = labels.groupBy("image_id", "cell_id").agg(F.count("*").alias("n"))
    if least is not None and remove_isolated:
        sizes = sizes.where(F.col("n") >= area(least))
    if most is not None:
        sizes = sizes.where(F.col("n") <= area(most))
    return labels.join(sizes, ["image_id", "cell_id"], "left_semi").select(*PIXEL, "cell_id")


FOUR = ((-1, 0), (0, -1), (0, 1), (1, 0))
EIGHT = (*FOUR, (-1, -1), (-1, 1), (1, -1), (1, 1))
#: Mask pixels, of whole components, that are labelled together in a task.
TASK_PIXELS = 500_000


def _dealt(marked: DataFrame) -> DataFrame:
    """Adds `task`: components by a hash, so many to a task as hold TASK_PIXELS pixels."""
    marked = written(marked, "marked")
    tasks = max(1, -(-marked.count() // TASK_PIXELS))
    return marked.withColumn("task", F.pmod(F.xxhash64("image_id", "component"), F.lit(tasks)))


class Mask:
    """The mask pixels of whole components as arrays, in raster order within a component, and their neighbours' places."""

    def __init__(self, task: pa.Table, steps: tuple[tuple[int, int], ...]):
        task = task.combine_chunks()
        x, y, component = (task.column(c).to_numpy().astype(np.int64) for c in ("x", "y", "component"))
        image = task.column("image_id").chunk(0).dictionary_encode().indices.to_numpy()
        group = np.unique(np.stack([image, component]), axis=1, return_inverse=True)[1].ravel()
        order = np.lexsort((x, y, group))
        self.table, x, y, self.group = task.take(pa.array(order)), x[order], y[order], group[order]
        width, height = int(x.max() - x.min()) + 3, int(y.max() - y.min()) + 3
        code = (self.group * height + y - y.min() + 1) * width + x - x.min() + 1
        self.near = []
        for dy, dx in steps:
            at = np.searchsorted(code, code + dy * width + dx).clip(max=len(code) - 1)
            self.near.append(np.where(code[at] == code + dy * width + dx, at, -1))

    def values(self, column: str) -> np.ndarray:
        return self.table.column(column).to_numpy()

    def labelled(self, label: np.ndarray) -> pa.Table:
        return self.table.select(PIXEL).append_column("label", pa.array(label, pa.int64()))


def _flood(task: pa.Table) -> pa.Table:
    """Watershed: markers grow along falling values; ties by age, then by neighbour order. Where a component has one marker, that takes all."""
    mask = Mask(task, FOUR)
    value, marker, group = mask.values("tic"), mask.values("marker"), mask.group
    low, high = np.full(group[-1] + 1, np.iinfo(np.int64).max), np.full(group[-1] + 1, -1)
    own = marker >= 0
    np.minimum.at(low, group[own], marker[own])
    np.maximum.at(high, group[own], marker[own])
    contested = (low < high)[group]
    label = np.where(contested, marker, high[group]).tolist()
    start = np.nonzero(contested & own)[0].tolist()
    minus, near = (-value).tolist(), list(zip(*(n.tolist() for n in mask.near)))
    heap = [(minus[p], age, p) for age, p in enumerate(start)]
    heapq.heapify(heap)
    age = len(heap)
    while heap:
        _, _, p = heapq.heappop(heap)
        for q in near[p]:
            if q >= 0 and label[q] < 0:
                label[q] = label[p]
                heapq.heappush(heap, (minus[q], age, q))
                age += 1
    return mask.labelled(np.array(label, np.int64))


def _grow(tolerance: float):
    def run(task: pa.Table) -> pa.Table:
        mask = Mask(task, EIGHT)
        scaled, marker = mask.values("scaled").tolist(), mask.values("marker")
        near, label = list(zip(*(n.tolist() for n in mask.near))), [-1] * len(scaled)
        seeds = np.nonzero(marker >= 0)[0]
        for seed in seeds[np.argsort(-mask.values("tic")[seeds], kind="stable")].tolist():  # ties in raster order
            if label[seed] >= 0:
                continue
            own, top, todo = int(marker[seed]), scaled[seed], [seed]
            while todo:
                p = todo.pop()
                if label[p] < 0 and abs(scaled[p] - top) <= tolerance:
                    label[p] = own
                    todo += [q for q in near[p] if q >= 0 and label[q] < 0]
        return mask.labelled(np.array(label, np.int64))

    return run


def segment(tic: DataFrame, threshold: float | DataFrame, method: str = "watershed", sigma: float = 0.0, footprint: tuple[int, int] = (3, 3), least: float | None = 2, most: float | None = None,
            unit: str = "px", pixel_um: float = 10.0, remove_isolated: bool = True, tolerance: float = 0.15) -> DataFrame:
    """Labels (image_id, x, y, cell_id) of the pixels above the threshold.

    method watershed: markers (connected local maxima) flood their surroundings; dfs: seeds, brightest first, take
    connected pixels of like value, and what is left goes to the nearest cell. The threshold may be a table (image_id,
    threshold). Images are cut into the connected components of the mask, which can't influence each other: these, not
    images, are the unit of work, and many of them share a task. The memory of a task is that of its largest component,
    about 200 bytes a pixel. cell_id numbers an image's cells in raster order of their markers, before the size filter,
    so that ids may have gaps.
    """
    if method not in ("watershed", "dfs"):
        raise ValueError("method must be watershed or dfs")
    smooth = written(gaussian_smooth(tic, sigma), "smooth")
    mask = tic_mask(tic, threshold).select(*PIXEL)
    masked = written(connected_components(smooth.join(mask, PIXEL), 4 if method == "watershed" else 8), "masked")
    tops = local_maxima(smooth, footprint).join(mask, PIXEL, "left_semi")
    if method == "watershed":
        marks = connected_components(tops.select(*PIXEL), 4).select(*PIXEL, F.col("component").alias("marker"))
    else:
        marks = tops.select(*PIXEL, (F.col("y").cast("long") * (1 << 24) + F.col("x")).alias("marker"))
    marked = masked.join(marks, PIXEL, "left").withColumn("marker", F.coalesce("marker", F.lit(-1)))
    pixels = marked.select("image_id", F.col("x").cast("int"), F.col("y").cast("int"), F.col("tic").cast("double"), "component", "marker")
    out = f"image_id {marked.schema['image_id'].dataType.simpleString()}, x int, y int, label long"
    if method == "watershed":
        found = _dealt(pixels).groupBy("task").applyInArrow(_flood, out).where("label >= 0")
    else:
        scale = pixels.groupBy("image_id").agg(F.min("tic").alias("low"), F.max("tic").alias("high"))
        scaled = pixels.join(scale, "image_id").withColumn("scaled", (F.col("tic") - F.col("low")) / (F.col("high") - F.col("low") + 1e-9))
        found = written(_dealt(scaled).groupBy("task").applyInArrow(_grow(tolerance), out), "grown")
        grown = found.where("label >= 0")
        found = grown.unionByName(nearest_label(found.where("label < 0"), grown, "label"))
    found = written(found, "labels")
    # A row for each cell, numbered per image.
    numbers = found.select("image_id", "label").distinct().withColumn("cell_id", F.row_number().over(W.partitionBy("image_id").orderBy("label")).cast("int"))
    return written(size_filter(found.join(numbers, ["image_id", "label"]).select(*PIXEL, "cell_id"), least, most, unit, pixel_um, remove_isolated), "segments")
