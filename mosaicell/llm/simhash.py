"""SimHash near-duplicates: tiled exact comparison by exclusive-or and bit counts.

Fingerprints are tiled by the population counts of their four 16-bit quarters. Two fingerprints differ in at least as
many bits as the sum of the differences of those counts, so tile pairs beyond the radius are never formed. Within a
tile pair all fingerprints are compared, in blocks of bounded size, by numpy exclusive-or and bit counts.

Where a similarity of shingles is asked for (`similar_keep`), what SimHash links is verified by the exact Jaccard
similarity of the whole texts' shingles. One SimHash has too little recall for that: independent fingerprints of min-hashes
give further candidates, verified alike.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import Scratch, sweep, written  # rows here are numbers mostly: joins go by rows, not by files
from .common import components, lowest_of_component

SHINGLE_WORDS = 3
RADIUS = 3
#: Fingerprints in a block: a block pair is one unit of work, its exclusive-or matrix is cut into strips.
BLOCK = 2048
#: Independent fingerprints of a text and min-hashes in each: at similarity 0.8 all differ in one pair of 570. Rows that share a
#: fingerprint are compared pair by pair up to SHARED; in larger groups as matrices, in blocks of so many rows and shingles.
PRINTS, HASHES, SHARED = 16, 5, 32
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 19
#: Pairs with the same first row that a task verifies with one copy of its text.
PARTNERS = 256


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """SimHash of UTF-8 bytes as an unsigned integer; 0 for null or a text without words."""
    return _simhash(shingle_hashes(text, words))


def _simhash(hashes: list[int]) -> int:
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").view("<u8")[0])


def shingle_hashes(text: bytes | None, words: int) -> list[int]:
    """A hash of each shingle of UTF-8 bytes; a text of fewer words is one shingle."""
    found = (text or b"").lower().split()  # for bytes: A-Z only, and the six ASCII white spaces
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = [0, *(ends[: len(found) - words] + 1).tolist()]
    return [xxhash.xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts, ends[words - 1 :].tolist())]


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            prints = np.array([fingerprint(x.as_py(), words) for x in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])

    return run


def linked(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> np.ndarray:
    """Links that join what is within the radius in a x b, as a forest: pairs of (fingerprint, smallest it is joined to)."""
    rows, cols = [], []
    for at in range(0, len(a), 256):
        i, j = np.nonzero(np.bitwise_count(a[at : at + 256, None] ^ b[None, :]) <= radius)
        keep = j > i + at if same else slice(None)
        rows.append(a[i[keep] + at])
        cols.append(b[j[keep]])
    return forest(np.concatenate(rows).view(np.int64), np.concatenate(cols).view(np.int64))


def forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Pairs of (node, smallest it is joined to) for the links u, v."""
    if not len(u):
        return np.empty((0, 2), np.int64)
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = label != np.arange(len(nodes))
    return np.stack([nodes[out], nodes[label[out]]], axis=1)


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, found = batch.column(0), batch.column(1), []
            x, xo = left.values.to_numpy().view(np.uint64), left.offsets.to_numpy()
            y, yo = right.values.to_numpy().view(np.uint64), right.offsets.to_numpy()
            for k, same in enumerate(batch.column(2).to_pylist()):
                found.append(linked(x[xo[k] : xo[k + 1]], y[yo[k] : yo[k + 1]], radius, same))
            all_found = np.concatenate([np.empty((0, 2), np.int64), *found])
            yield pa.RecordBatch.from_arrays([pa.array(all_found[:, 0].copy()), pa.array(all_found[:, 1].copy())], ["u", "v"])

    return run


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """Links (u, v) between the distinct fingerprints `fp` of `prints` that join all that differ in `radius` bits or fewer.

    Links are a forest in each pair of blocks, to the smallest fingerprint; a fingerprint must not be repeated; an empty
    table has no links. What is written on the way stays in `scratch`, for the caller to clear. Tiles go by the population counts of quarters, or of halves where the radius makes quarters too many neighbours.
    """
    parts = 4 if radius <= 4 else 2
    bits = 64 // parts
    counts = [F.bit_count(F.shiftrightunsigned("fp", bits * k).bitwiseAND((1 << bits) - 1)) for k in range(parts)]
    tiled = prints.select("fp", *(q.alias(f"q{k}") for k, q in enumerate(counts)))
    where = [f"q{k}" for k in range(parts)]
    # At most 17 ** 4 = 83 521 tiles, whatever the input: small enough to broadcast.
    tiles = tiled.groupBy(*where).agg(F.ceil(F.count("*") / block).alias("blocks"))
    blocks = (tiled.join(F.broadcast(tiles), where)
              .withColumn("b", F.pmod(F.xxhash64("fp"), "blocks"))
              .groupBy(*where, "b").agg(F.collect_list("fp").alias("fps")))  # bounded: about `block` fingerprints
    blocks = (scratch or Scratch()).written(blocks, "tiles")
    near = [d for d in itertools.product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius and d >= (0,) * parts]
    steps = F.array(*(F.struct(*(F.lit(x).alias(f"d{k}") for k, x in enumerate(d))) for d in near))
    left = (blocks.withColumn("d", F.explode(steps))
            .select(F.col("fps").alias("left"), F.col("b").alias("lb"), *(F.expr(f"q{k} + d.d{k}").alias(f"q{k}") for k in range(parts)),
                    F.expr(" and ".join(f"d.d{k} = 0" for k in range(parts))).alias("home"))
            .join(F.broadcast(tiles.select(*where)), where, "left_semi"))
    pairs = (left.join(blocks, where).where("not home or lb <= b")
             .select("left", F.col("fps").alias("right"), F.expr("home and lb = b").alias("same")))
    return pairs.mapInArrow(_compare(radius), "u long, v long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
                   radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """One row (id, fingerprint, component_id) per row of `docs`.

    Null and empty texts and texts without a word have fingerprint 0 and are linked like any other; a text of fewer
    words than a shingle is one shingle. Equal rows and equal fingerprints share a component at once; component_id is
    the smallest non-null id of the component. Texts of any length are read whole. Other columns are ignored, so their
    names can't clash. An empty table gives an empty result.
    """
    prints = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
                     .mapInArrow(_fingerprints(words), f"id {docs.schema[id_col].dataType.simpleString()}, fp long"), "prints")
    scratch = Scratch()
    classes = scratch.written(prints.groupBy("fp").agg(F.min("id").alias("component_id")), "classes")
    roots = components(fingerprint_links(classes, radius, block, scratch))
    lowest = written(lowest_of_component(classes.withColumnRenamed("fp", "node"), roots, "component_id"), "lowest")
    scratch.clear()
    return (prints.join(lowest.withColumnRenamed("node", "fp"), "fp")
            .select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` written with a number for each row, under a name that no column of it has."""
    name = "row"
    while name in docs.columns:
        name += "_"
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def simhash_keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """`docs` without near-duplicates: of each component one row stays, that with the smallest id.

    Rows, not ids, are compared and kept: null ids come last, repeated ids are rows of their own. All columns stay.
    """
    rows, row = _numbered(docs)
    groups = simhash_groups(rows, row, text_col, words, radius).select(row, "component_id")
    first = F.min(F.struct(F.col("id").isNull(), "id", row)).alias("first")
    kept = rows.select(row, F.col(id_col).alias("id")).join(groups, row).groupBy("component_id").agg(first).select(f"first.{row}")
    return rows.join(written(kept, "kept"), row, "left_semi").select(*docs.columns)


_SALTS = np.random.default_rng(5).integers(0, 1 << 63, (PRINTS * HASHES, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def min_prints(shingles: np.ndarray) -> list[int]:
    """The independent fingerprints of a set of shingle hashes: PRINTS hashes of HASHES minima each."""
    low = np.full(len(_SALTS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        mixed = (shingles[None, at : at + 4096] ^ _SALTS) * _SALTS
        low = np.minimum(low, ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)).min(axis=1))
    return [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(low.reshape(PRINTS, HASHES))]


def _set(text: bytes | None, words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def _signed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(x.as_py(), words) for x in batch.column(1).cast(pa.binary())]
            sets = [np.unique(np.array(x, np.uint64)) for x in hashes]
            fps = np.array([_simhash(x) for x in hashes], np.uint64)
            prints = pa.array([np.array(min_prints(x), np.uint64).view(np.int64) if len(x) else [] for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh128_digest(x.tobytes()) for x in sets], pa.binary()), prints, pa.array(fps.view(np.int64)), *batch.columns[2:]],
                                             ["row", "same", "prints", "fp", "id"])

    return run


def _verify(words: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, known = [], {}
            left, right = batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())
            for k, (u, v) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                for row, text in ((u, left), (v, right)):
                    if row not in known:
                        known[row] = _set(text[k].as_py(), words)
                both = len(np.intersect1d(known[u], known[v], assume_unique=True))
                keep.append(both >= least * (len(known[u]) + len(known[v]) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Of the pairs (u, v), u often the same, those that are similar. A text with many partners travels once for each PARTNERS of them."""
    parts = pairs.groupBy("u").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
    dealt = pairs.join(parts, "u").select("u", "v", F.pmod(F.xxhash64("v"), "parts").cast("int").alias("part"))
    left = texts.select(F.col("row").alias("u"), F.col("text").alias("left")).join(parts, "u").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")
    both = (dealt.join(texts.select(F.col("row").alias("v"), F.col("text").alias("right")), "v")
            .join(left, ["u", "part"]).select("u", "v", "left", "right"))
    return both.mapInArrow(_verify(words, least), "u long, v long")


def set_links(left: list[np.ndarray], right: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places i, j of the sets of distinct hashes whose Jaccard similarity is `least` or more. Only hashes that several sets have take part, as bits."""
    sizes = np.array([len(x) for x in (*left, *right)], np.int64)
    values, at, n = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    column = np.cumsum(n > 1) - 1
    owner, shared = np.repeat(np.arange(len(sizes)), sizes), n[at] > 1
    bits = np.zeros((len(sizes), max(1, -(-int((n > 1).sum()) // 64))), np.uint64)
    where = column[at[shared]]
    np.bitwise_or.at(bits, (owner[shared], where >> 6), np.uint64(1) << (where & 63).astype(np.uint64))
    a, b, found = bits[: len(left)], bits[len(left) :], []
    for i in range(len(left)):
        # Sets of too different sizes can't be as similar.
        near = np.flatnonzero((sizes[len(left) :] >= least * sizes[i]) & (least * sizes[len(left) :] <= sizes[i]))
        both = np.bitwise_count(a[i] & b[near]).sum(axis=1, dtype=np.int64)
        j = near[both >= least * (sizes[i] + sizes[len(left) + near] - both)]
        found.append(np.stack([np.full(len(j), i), j], axis=1))
    return tuple(np.concatenate(found).T) if found else (np.empty(0, np.int64),) * 2


def _blocks_compared(least: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        links = np.empty((0, 2), np.int64)
        if left.num_rows and right.num_rows:
            rows = [t.column("row").to_numpy() for t in (left, right)]
            i, j = set_links(*([x.values.to_numpy().view(np.uint64) for x in t.column("set")] for t in (left, right)), least)
            other = rows[0][i] != rows[1][j]
            links = forest(rows[0][i[other]], rows[1][j[other]])
        return pa.table({"u": links[:, 0].copy(), "v": links[:, 1].copy()})

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_set(x.as_py(), words).view(np.int64) for x in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["row", "set"])

    return run


def _large_groups(members: DataFrame, texts: DataFrame, words: int, least: float, scratch: Scratch) -> DataFrame:
    """Links (u, v), as forests, between all similar rows of a group of which one at least is open. members: (print, row, open); texts: (row, text)."""
    members = scratch.written(members, "large")
    wanted = members.join(members.where("open").select("print").distinct(), "print", "left_semi")
    wanted = scratch.written(wanted, "unsettled")
    sets = scratch.written(texts.join(wanted.select("row").distinct(), "row", "left_semi").select("row", "text").mapInArrow(_sets(words), "row long, set array<long>"), "sets")
    sized = scratch.written(wanted.join(sets.select("row", F.size("set").alias("size")), "row"), "sized")
    blocks = lambda rows, size: F.ceil(F.greatest(rows / BLOCK_ROWS, size / BLOCK_SHINGLES, F.lit(1.0))).cast("int")
    some = lambda c: F.coalesce(F.sum(F.when(F.col("open"), c)), F.lit(0))
    groups = sized.groupBy("print").agg(blocks(some(F.lit(1)), some(F.col("size"))).alias("lefts"), blocks(F.count("*"), F.sum("size")).alias("rights"))
    dealt = sized.join(groups, "print").select("print", "row", "open", F.pmod(F.xxhash64("row"), "lefts").cast("int").alias("a"), F.pmod(F.xxhash64("row", F.lit(1)), "rights").cast("int").alias("b"), "lefts", "rights")
    left = dealt.where("open").select("print", "row", "a", F.explode(F.expr("sequence(0, rights - 1)")).alias("b")).join(sets, "row")
    right = dealt.select("print", "row", "b", F.explode(F.expr("sequence(0, lefts - 1)")).alias("a")).join(sets, "row")
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # columns of its own: both sides come from the same tables
    key = ["print", "a", "b"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_blocks_compared(least), "u long, v long")


def _simhash_pairs(classes: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """Pairs (u, v) of rows of `classes` (row, fp) that SimHash joins: a row with the first of its fingerprint, and first rows along `fingerprint_links`."""
    firsts = scratch.written(classes.groupBy("fp").agg(F.min("row").alias("first")), "firsts")
    links = scratch.written(fingerprint_links(firsts.select("fp"), radius, scratch=scratch), "simhash")
    first = lambda c: firsts.select(F.col("fp").alias(c), F.col("first").alias(f"row_{c}"))
    near = links.join(first("u"), "u").join(first("v"), "v").select("row_u", "row_v")
    equal = classes.join(firsts, "fp").where("row <> first").select("first", "row")
    return near.union(equal).toDF("u", "v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def similar_links(classes: DataFrame, texts: DataFrame, words: int, least: float, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that join the rows of `classes` (row, prints, fp; rows differ) whose shingles in `texts` (row, text) have Jaccard
    similarity `least` or more, as far as SimHash joins them (fp, `radius` bits; none where there is no fp) or they share one of the prints.

    Two rounds, so that few texts travel: first what SimHash joins, and each row of a group with the group's first row; then all other pairs that
    the first round's links haven't joined yet. Of large groups, rows that aren't joined with the first one are compared
    with all rows of the group, in blocks of their sets: none is skipped, and no pair is a row. Rows with null or empty
    prints have no links; empty tables give none; ties don't matter, since all that is similar is joined.
    """
    scratch = Scratch()
    members = scratch.written(classes.select("row", F.explode("prints").alias("print")), "prints")
    # Partial aggregates: a group of any size is never gathered.
    groups = scratch.written(members.groupBy("print").agg(F.count("*").alias("n"), F.min("row").alias("first")).where("n > 1"), "groups")
    members = scratch.written(members.join(groups.select("print"), "print", "left_semi"), "members")
    stars = members.join(groups, "print").where("row <> first").select(F.col("first").alias("u"), F.col("row").alias("v"))
    asked = members.select("row")
    if "fp" in classes.columns:
        joined_by_bits = scratch.written(_simhash_pairs(classes.select("row", "fp"), radius, scratch), "pairs")
        stars = stars.unionByName(joined_by_bits)
        asked = asked.unionByName(joined_by_bits.select(F.explode(F.array("u", "v")).alias("row")))
    texts = scratch.written(texts.join(asked.distinct(), "row", "left_semi"), "candidates")
    stars = scratch.written(stars.distinct(), "stars")  # plans name it several times, and the pairs below
    sweep(classes.sparkSession)
    found = written(_verified(stars, texts, words, least), "links")
    joined = scratch.written(components(found), "joined")
    small = members.join(groups.where(F.col("n") <= SHARED).select("print"), "print")
    pairs = small.select("print", F.col("row").alias("u")).join(small.select("print", F.col("row").alias("v")), "print").where("u < v").select("u", "v")
    root = lambda c: joined.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    apart = (pairs.distinct().join(root("u"), "u", "left").join(root("v"), "v", "left")
             .where("coalesce(root_u, u) <> coalesce(root_v, v)").select("u", "v"))
    apart = scratch.written(apart.join(stars, ["u", "v"], "left_anti"), "apart")
    sweep(classes.sparkSession)
    more = written(_verified(apart, texts, words, least), "links")
    # Of a large group, rows that are joined with its first row are open to no one but those that aren't.
    heads = groups.where(F.col("n") > SHARED).join(root("first"), "first", "left").select("print", F.coalesce("root_first", "first").alias("head"))
    large = members.join(heads, "print").join(root("row"), "row", "left").select("print", "row", (F.coalesce("root_row", "row") != F.col("head")).alias("open"))
    more_of_large = written(_large_groups(large, texts, words, least, scratch), "links")
    scratch.clear()
    sweep(classes.sparkSession)
    return found.unionByName(more).unionByName(more_of_large)


def similar_keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """`docs` without near-duplicates: of rows joined by a Jaccard similarity of `least` or more one stays, that with the smallest id.

    Shingles are of `words` words of whole texts. Every link is verified, so rows that only look alike stay. Texts
    without a word, null ones too, are copies of each other. Null ids come last, repeated ids are rows of their own. All
    columns stay; an empty table gives an empty result.
    """
    rows, row = _numbered(docs)
    scratch = Scratch()
    texts = rows.select(F.col(row).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    signed = rows.select(F.col(row).alias("row"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id")).mapInArrow(_signed(words), f"row long, same binary, prints array<long>, fp long, id {kind}")
    first = F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first")
    classes = scratch.written(signed.groupBy("same").agg(F.min_by(F.struct("row", "prints", "fp"), "row").alias("one"), first).select("one.row", "one.prints", "one.fp", "first"), "classes")
    roots = components(similar_links(classes.select("row", "prints", "fp"), texts, words, least))
    kept = lowest_of_component(classes.select(F.col("row").alias("node"), "first"), roots, "first").select(F.col("first.row").alias(row)).distinct()
    kept = written(kept, "kept")
    scratch.clear()
    return rows.join(kept, row, "left_semi").select(*docs.columns)
