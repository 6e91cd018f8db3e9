"""Suffix-array dedup: removes the bytes covered by long strings that start anywhere else, over all documents.

The suffixes of all documents are dealt to tasks by content: every window of `LENGTH` bytes chooses one anchor in its
first `SPREAD` positions (least hash of a short gram), and all windows that are equal choose alike. Windows of an
anchor agree in a core behind it. Cores that occur once settle their windows at once; where all that reaches over a
core is equal too, so are its windows. What is left is sorted: in each task a suffix array is built by mergesort, in
which two suffixes are compared by binary search for their common extension on prefix polynomial hashes; neighbours
that share `LENGTH` bytes are verified byte by byte. Cores with more variants than fit a task are sorted in blocks;
what the sorted blocks hold is merged by Spark, each window once a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, written

LENGTH = 400
#: Positions among which a window chooses its anchor, and bytes of the grams whose hashes are compared.
SPREAD, GRAM = 192, 24
#: Bytes hashed at once, few enough for a processor's cache; longer texts are hashed in parts that overlap. Positions must fit `_AT` bits.
PART, _AT = 1 << 17, 21
#: Variants of a core in a block, and bytes of variants that one task sorts.
BLOCK, TASK_BYTES = 512, 1 << 20
_PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
_BASES = (1_103_515_245, 1_664_525_117)
_SPREADER = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=2)
def _powers(size: int) -> list[np.ndarray]:
    out = []
    for p, base in zip(_PRIMES, _BASES):
        x = np.ones(size, np.uint64)
        n, step = 1, base
        while n < size:
            m = min(n, size - n)
            x[n : n + m] = x[:m] * np.uint64(step) % np.uint64(p)
            n, step = n + m, step * step % p
        out.append(x)
    return out


class PrefixHashes:
    """Prefix polynomial hashes, modulo two primes, of one buffer: hashes of any of its substrings by subtraction."""

    def __init__(self, data: np.ndarray, powers: list[np.ndarray]):
        """powers: as many as the buffer has bytes, and one; hashes from buffers with the same powers compare."""
        self.powers, self.sums, self.top = powers, [], len(powers[0]) - 1
        value = data.astype(np.uint64) + np.uint64(1)
        for p, power in zip(_PRIMES, powers):
            sums = np.zeros(len(data) + 1, np.uint64)  # not reduced: of fewer than 2 ** 32 bytes they stay below 2 ** 63
            np.cumsum(value * power[: len(data)] % np.uint64(p), out=sums[1:])
            self.sums.append(sums)

    def one(self, k: int, start: np.ndarray, size) -> np.ndarray:
        p = np.uint64(_PRIMES[k])
        return (self.sums[k][start + size] - self.sums[k][start]) % p * self.powers[k][self.top - start] % p

    def every(self, k: int, size: int) -> np.ndarray:
        """As one(), of all substrings of `size` bytes in order."""
        p, sums = np.uint64(_PRIMES[k]), self.sums[k]
        n = len(sums) - size
        return (sums[size:] - sums[:n]) % p * self.powers[k][self.top - n + 1 : self.top + 1][::-1] % p

    def of(self, start: np.ndarray, size) -> np.ndarray:
        """62-bit hashes of the substrings."""
        return (self.one(0, start, size) << np.uint64(31)) ^ self.one(1, start, size)


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


class Anchors:
    """Finds the anchors of texts; holds the powers that all buffers share."""

    def __init__(self, length: int, spread: int, gram: int):
        if spread + gram - 1 > length:
            raise ValueError("an anchor and its gram must lie in the window")
        self.length, self.spread, self.gram = length, spread, gram
        self.powers = _powers((1 << _AT) + 1)

    def find(self, raw: bytes, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, first window, last window, anchor, core hash, digest of what they cover) for texts that begin at `starts` in `raw`.

        Positions are in `raw`, which must have fewer than 2 ** _AT bytes. Windows never leave their text.
        """
        n, w = len(raw), self.spread
        ends = np.append(starts[1:], n)
        spans = [np.arange(s, e - self.length + 1) for s, e in zip(starts.tolist(), ends.tolist()) if e - s >= self.length]
        if not spans:
            return (np.empty(0, np.int64),) * 6
        windows = np.concatenate(spans)
        data = np.frombuffer(raw, np.uint8)
        hashes = PrefixHashes(data, self.powers)
        low = np.uint64((1 << _AT) - 1)
        key = hashes.every(0, self.gram)
        key += np.uint64(1)
        key *= _SPREADER
        key &= ~low
        key |= np.arange(len(key), dtype=np.uint64)
        least, size = key, 1  # least[i]: over key[i : i + size]
        while 2 * size <= w:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        if size < w:
            least = np.minimum(least[: len(key) - w + 1], least[w - size :][: len(key) - w + 1])
        anchor = (least[windows] & low).astype(np.int64)
        first = np.nonzero(np.append(True, anchor[1:] != anchor[:-1]))[0]
        last = np.append(first[1:], len(anchor)) - 1
        lo, hi, anchor = windows[first], windows[last], anchor[first]
        core = hashes.of(anchor, self.length - w + 1).astype(np.int64)
        cover = np.fromiter(map(xxhash.xxh3_64_intdigest, map(memoryview(raw).__getitem__, map(slice, lo.tolist(), (hi + self.length).tolist()))), np.uint64, len(lo))
        cover = (cover ^ hashes.of(lo, hi - lo + self.length) * _SPREADER).astype(np.int64)  # two hashes of another kind: bytes made to collide in one don't in the other
        return np.searchsorted(starts, lo, "right") - 1, lo, hi, anchor, core, cover


def _find_anchors(length: int, spread: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Anchors(length, spread, gram)

        def found(ids: list[int], shifts: list[int], texts: list[bytes]) -> pa.RecordBatch:
            starts = np.cumsum([0, *map(len, texts[:-1])])
            text, lo, hi, anchor, core, cover = finder.find(b"".join(texts), starts)
            shift = np.array(shifts, np.int64)[text] - starts[text]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.array(ids, np.int64)[text]), pa.array(lo + shift), pa.array((hi - lo).astype(np.int32)), pa.array((anchor - lo).astype(np.int32)), pa.array(core), pa.array(cover)],
                ["row", "lo", "span", "back", "core", "cover"])

        for batch in batches:
            ids, shifts, texts, size = [], [], [], 0
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_py()
                for at in range(0, max(1, len(raw) - length + 1), PART):  # a part owns the windows that begin in it
                    part = raw[at : at + PART + length - 1]
                    if texts and size + len(part) > PART:
                        yield found(ids, shifts, texts)
                        ids, shifts, texts, size = [], [], [], 0
                    ids.append(row)
                    shifts.append(at)
                    texts.append(part)
                    size += len(part)
            if texts:
                yield found(ids, shifts, texts)

    return run


def _cut_out(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        core, cover, bytes_of = [], [], []
        for text, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
            raw = text.as_py()
            for x in wanted:
                core.append(x["core"])
                cover.append(x["cover"])
                bytes_of.append(raw[x["lo"] : x["lo"] + x["span"] + length])
        yield pa.RecordBatch.from_arrays([pa.array(core, pa.int64()), pa.array(cover, pa.int64()), pa.array(bytes_of, pa.binary())], ["core", "cover", "bytes"])


class SuffixSort:
    """Mergesort of suffixes, group by group, by their first `length` bytes; compared on prefix hashes."""

    def __init__(self, raw: bytes, suffixes: np.ndarray, groups: np.ndarray, length: int):
        """suffixes: where they begin; groups: of each, equal numbers adjacent. Suffixes of a group are sorted and compared."""
        self.data, self.length = np.frombuffer(raw, np.uint8), length
        self.hashes = PrefixHashes(self.data, _powers((1 << len(raw).bit_length()) + 1))  # few sizes, which tasks of a process share
        self.suffixes, self.collided = suffixes, False
        self.whole = self.hashes.of(suffixes, length)
        # The first bytes as numbers that sort as the bytes do: most pairs differ there and need no search.
        heads = np.zeros((len(suffixes), 8), np.uint8)
        if len(suffixes):
            heads[:, : min(8, length)] = sliding_window_view(self.data, min(8, length))[suffixes]
        self.heads = heads.view(">u8").ravel().astype(np.uint64)
        self.bounds = np.append(np.nonzero(np.append(True, groups[1:] != groups[:-1]))[0], len(groups)) if len(groups) else np.zeros(1, np.int64)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of suffixes, at most `length`, by binary search."""
        a, b, lcp = self.suffixes[i], self.suffixes[j], np.zeros(len(i), np.int64)
        step = 1 << (self.length.bit_length() - 1)
        while step:
            fits = lcp + step <= self.length
            longer = np.where(fits, step, 0)
            same = fits & (self.hashes.one(0, a + lcp, longer) == self.hashes.one(0, b + lcp, longer))
            at = np.nonzero(same)[0]  # the second prime is asked only where the first finds no difference
            same[at] = self.hashes.one(1, a[at] + lcp[at], step) == self.hashes.one(1, b[at] + lcp[at], step)
            lcp = np.where(same, lcp + step, lcp)
            step >>= 1
        return lcp

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """-1, 0, 1 as suffix i sorts before, with or after j."""
        out = np.zeros(len(i), np.int64)
        other = np.nonzero(self.whole[i] != self.whole[j])[0]
        a, b = self.heads[i[other]], self.heads[j[other]]
        out[other] = (a > b).astype(np.int64) - (a < b)
        other = other[a == b]
        if len(other):
            lcp = np.minimum(self.common(i[other], j[other]), self.length - 1)
            out[other] = np.sign(self.data[self.suffixes[i[other]] + lcp].astype(np.int64) - self.data[self.suffixes[j[other]] + lcp])
            self.collided |= not out[other].all()  # where an extension ends, bytes differ
        return out

    def array(self) -> np.ndarray:
        """The suffix array: numbers of the suffixes in order, group by group. All groups are merged side by side."""
        n = len(self.suffixes)
        order, sizes = np.arange(n), np.diff(self.bounds)
        begin, width = np.repeat(self.bounds[:-1], sizes), 1
        while len(sizes) and width < sizes.max():
            inside = np.arange(n) - begin
            odd = np.nonzero(inside // width & 1)[0]  # the second run of each pair: the first has `width` suffixes
            base = odd - inside[odd] % width - width
            lo, hi, todo = base.copy(), base + width, np.arange(len(odd))
            while len(todo):  # how many of the first run come before: ties go to the first
                mid = (lo[todo] + hi[todo]) >> 1
                first = self.before(order[mid], order[odd[todo]]) <= 0
                lo[todo] = np.where(first, mid + 1, lo[todo])
                hi[todo] = np.where(first, hi[todo], mid)
                todo = todo[lo[todo] < hi[todo]]
            place = lo + inside[odd] % width
            new, others = np.empty_like(order), np.ones(n, bool)
            new[place], others[place] = order[odd], False
            new[others] = np.delete(order, odd)  # what the second runs leave free, in order
            order, width = new, 2 * width
        return order

    def repeated(self) -> np.ndarray:
        """For each suffix: the number of the first in order of those that share its `length` bytes, or -1 if none does.

        Neighbours with equal hashes are verified byte by byte; if any differ, all is told by bytes instead.
        """
        order = self.array()
        if self.collided:
            return self._by_bytes()
        head = np.zeros(len(order), bool)
        head[self.bounds[:-1]] = True
        same = np.append(False, self.whole[order[1:]] == self.whole[order[:-1]])[: len(order)] & ~head
        at = np.nonzero(same)[0]
        for k in range(0, len(at), 4096):
            some = at[k : k + 4096]
            strings = sliding_window_view(self.data, self.length)
            if (strings[self.suffixes[order[some]]] != strings[self.suffixes[order[some - 1]]]).any():
                return self._by_bytes()
        return self._first_of_runs(order, same)

    def _first_of_runs(self, order: np.ndarray, same: np.ndarray) -> np.ndarray:
        run = np.cumsum(~same) - 1
        sizes = np.bincount(run, minlength=1)
        first = order[np.nonzero(~same)[0]] if len(order) else order
        out = np.empty(len(order), np.int64)
        out[order] = np.where(sizes[run] > 1, first[run], -1) if len(order) else out
        return out

    def _by_bytes(self) -> np.ndarray:
        raw, out = self.data.tobytes(), np.full(len(self.suffixes), -1)
        for a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist()):
            seen: dict[bytes, int] = {}
            for k in range(a, b):
                window = raw[self.suffixes[k] : self.suffixes[k] + self.length]
                first = seen.setdefault(window, k)
                if first != k:
                    out[k] = out[first] = first
        return out


def _sort_task(length: int):
    """Sorts the variants of whole blocks; finds which of their windows repeat in the block, and what other blocks need."""

    def run(task: pa.Table) -> pa.Table:
        task = task.combine_chunks()
        raws = task.column("bytes").to_pylist()
        back, core, block = (task.column(c).to_numpy().astype(np.int64) for c in ("back", "core", "block"))
        many, shared = task.column("blocks").to_numpy() > 1, task.column("n").to_numpy() > 1
        sizes = np.array(list(map(len, raws)), np.int64)
        windows = sizes - length + 1
        begin = np.cumsum(sizes) - sizes
        item = np.repeat(np.arange(len(raws)), windows)
        shift = np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)
        by_core = np.lexsort((block, core))
        number = np.empty(len(raws), np.int64)  # of a core's block
        number[by_core] = np.cumsum(np.append(0, (core[by_core[1:]] != core[by_core[:-1]]) | (block[by_core[1:]] != block[by_core[:-1]])))[: len(raws)]
        # Of how far the anchor is: only windows as far from it can be equal.
        ahead = back[item] - shift
        least = ahead.min(initial=0)
        group = number[item] * (ahead.max(initial=0) - least + 1) + ahead - least
        order = np.argsort(group)
        item, shift, ahead, starts = item[order], shift[order], ahead[order], shift == 0
        raw = b"".join(raws)
        first = SuffixSort(raw, begin[item] + shift, group[order], length).repeated()
        valid = (first >= 0) | shared[item]
        # A row for each run of windows that are found repeated here (their variant's occurrences need them), and one for each
        # window that blocks must compare: once, with its variant only if that still waits for a partner.
        told = np.zeros(len(item) + 1, bool)
        told[order] = valid & ~shared[item]
        follows = np.append(False, told[:-1])[:-1] & ~starts  # the window before, of the same variant, is told too
        a = np.nonzero(told[:-1] & ~follows)[0]
        b = np.nonzero(told[:-1] & ~np.append(follows[1:] & told[1:-1], False)[: len(item)])[0]
        place = np.empty(len(item), np.int64)
        place[order] = np.arange(len(item))
        compare = many[item] & ((first < 0) | (first == np.arange(len(item))))
        k = np.nonzero(compare)[0]
        text = (begin[item] + shift)[k].tolist()
        digest = np.array([_digest(raw[x : x + length]) for x in text], np.int64)
        x = np.concatenate([place[a], k])
        runs = np.arange(len(x)) < len(a)
        return pa.table({"core": core[item[x]], "cover": task.column("cover").to_numpy()[item[x]], "shift": shift[x].astype(np.int32), "until": shift[np.concatenate([place[b], k])].astype(np.int32),
                         "ahead": ahead[x].astype(np.int32), "digest": np.append(np.zeros(len(a), np.int64), digest), "valid": runs, "waits": ~runs & ~valid[x], "compare": ~runs})

    return run


def whole_characters(part: bytes, first: bool, last: bool) -> bytes:
    """A part of a text's UTF-8 without what a cut left of a character at its ends; first, last: whether an end is the text's own."""
    begin, end = 0, len(part)
    while not first and begin < min(3, end) and part[begin] & 0xC0 == 0x80:
        begin += 1
    for back in range(1, 0 if last else min(3, end - begin) + 1):
        lead = part[end - back]
        if lead & 0xC0 != 0x80:  # the last character begins here
            size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            end -= back if size > back else 0
            break
    return part[begin:end]


def _merged(found: pa.ListArray, length: int) -> list[list[tuple[int, int]]]:
    """For each text the bytes that windows of `length` cover, as disjoint runs (from, to) in order; found: its ranges lo, hi of the windows' starts, or null."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(found))]
    values = found.flatten()
    if not len(values):
        return out
    text = np.repeat(np.arange(len(found)), found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    lo, hi = (values.field(c).to_numpy() for c in ("lo", "hi"))
    order = np.lexsort((lo, text))
    text, lo, hi = text[order], lo[order], hi[order] + length
    # Each text's places follow those of the texts before it: one running maximum serves all.
    shift = text * (int(hi.max()) + 1)
    reach = np.maximum.accumulate(hi + shift)
    first = np.nonzero(np.append(True, (text[1:] != text[:-1]) | (lo[1:] + shift[1:] > reach[:-1])))[0]
    last = np.append(first[1:], len(lo)) - 1
    for k, a, b in zip(text[first].tolist(), lo[first].tolist(), (reach - shift)[last].tolist()):
        out[k].append((a, b))
    return out


def _parts(raw: bytes, cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the cuts leave of a text: from, to."""
    return list(zip([0, *(hi for _, hi in cuts)], [*(lo for lo, _ in cuts), len(raw)]))


def _remove(length: int, passage: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, kept, texts, passages, covered = [], [], [], [], [], []
            for text, cuts, runs in zip(batch.column(0), _merged(batch.column(1), length), _merged(batch.column(2), passage)):
                raw = text.as_py()
                parts = _parts(raw, cuts)
                removed.append(sum(hi - lo for lo, hi in cuts))
                spans.append(len(cuts))
                kept.append(b"".join(raw[a:b] for a, b in parts))
                if with_text:
                    texts.append(b"".join(whole_characters(raw[a:b], a == 0, b == len(raw)) for a, b in parts) if cuts else raw)
                passages.append(len(runs))
                covered.append(sum(hi - lo for lo, hi in runs))
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(texts, pa.binary()).cast(pa.string()) if with_text else pa.nulls(len(kept), pa.string()),
                                              pa.array(passages, pa.int64()), pa.array(covered, pa.int64())],
                                             [*batch.schema.names[3:], "n_removed", "n_spans", "kept", "kept_text", "n_passages", "passage_bytes"])

    return run


def _long_runs(length: int, passage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, parts = [], [], []
            for row, text, merged in zip(batch.column(0).to_pylist(), batch.column(1), _merged(batch.column(2), passage)):
                runs = [x for x in merged if x[1] - x[0] >= length]
                raw = text.as_py() if runs else b""
                for lo, hi in runs:
                    rows.append(row)
                    starts.append(lo)
                    parts.append(raw[lo:hi])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(starts, pa.int64()), pa.array(parts, pa.binary())], ["of", "at", "raw"])

    return run


def repeated_windows(texts: DataFrame, length: int = LENGTH, spread: int = SPREAD, gram: int = GRAM, block: int = BLOCK,
                     scratch: Scratch | None = None) -> DataFrame:
    """Windows of `texts` (row long, raw binary; rows differ) that start anywhere else too, as ranges (row, lo, hi) of their starts.

    Equal texts under different rows repeat each other; texts shorter than `length` have no window; without texts there
    are no ranges. What is written on the way stays in `scratch`, for the caller to clear once the ranges are written.
    """
    scratch = scratch or Scratch()
    anchors = scratch.written(texts.where(F.length("raw") >= length).select("row", "raw")
                      .mapInArrow(_find_anchors(length, spread, gram), "row long, lo long, span int, back int, core long, cover long"), "anchors")
    cores = scratch.written(anchors.groupBy("core").agg(F.count("*").alias("n"), F.min("cover").alias("a"), F.max("cover").alias("b"))
                    .where("n > 1").select("core", (F.col("a") != F.col("b")).alias("open")), "cores")
    # Many rows against few: the few are hashed, and the many needn't be sorted.
    shared = scratch.written(anchors.join(cores.hint("shuffle_hash"), "core"), "shared")
    whole = shared.where("not open").select("row", "lo", (F.col("lo") + F.col("span")).alias("hi"))
    opened = shared.where("open")
    variants = scratch.written(opened.groupBy("core", "cover").agg(F.count("*").alias("n"), F.min(F.struct("row", "lo", "span", "back")).alias("one")), "variants")
    counts = scratch.written(variants.groupBy("core").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "counts")
    wanted = variants.select("one.row", F.struct("core", "cover", "one.lo", "one.span").alias("x")).groupBy("row").agg(F.collect_list("x").alias("wanted"))
    cut = texts.join(wanted, "row").select("raw", "wanted").mapInArrow(lambda batches: _cut_out(batches, length), "core long, cover long, bytes binary")
    tasks = max(1, variants.count() * (length + spread) // TASK_BYTES)
    ready = (variants.join(counts, "core").select("core", "cover", "n", "one.back", "blocks", F.pmod(F.xxhash64("cover"), F.col("blocks")).cast("int").alias("block"))
             .join(cut, ["core", "cover"]))
    sorted_ = scratch.written(ready.withColumn("task", F.pmod(F.xxhash64("core", "block"), F.lit(tasks)))
                      .groupBy("task").applyInArrow(_sort_task(length), "core long, cover long, shift int, until int, ahead int, digest long, valid boolean, waits boolean, compare boolean"), "sorted")
    merged = (sorted_.where("compare").groupBy("core", "ahead", "digest").agg(F.count("*").alias("blocks"))
              .where("blocks > 1").select("core", "ahead", "digest"))
    later = scratch.written(merged, "merged").join(sorted_.where("waits"), ["core", "ahead", "digest"]).select("core", "cover", "shift")
    # Runs of starts, few for each variant, of which there are `spread` windows at most.
    island = F.col("shift") - F.row_number().over(W.partitionBy("core", "cover").orderBy("shift"))
    later = later.withColumn("island", island).groupBy("core", "cover", "island").agg(F.min("shift").alias("from"), F.max("shift").alias("to")).drop("island")
    found = sorted_.where("valid").select("core", "cover", F.col("shift").alias("from"), F.col("until").alias("to"))
    runs = scratch.written(found.unionByName(later), "runs")
    part = opened.join(runs.hint("shuffle_hash"), ["core", "cover"]).select("row", (F.col("lo") + F.col("from")).alias("lo"), (F.col("lo") + F.col("to")).alias("hi"))
    copied = opened.join(variants.where("n > 1").select("core", "cover").hint("shuffle_hash"), ["core", "cover"]).select("row", "lo", (F.col("lo") + F.col("span")).alias("hi"))
    return whole.unionByName(part).unionByName(copied)


def _by_row(ranges: DataFrame, name: str) -> DataFrame:
    return ranges.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias(name))  # of one text


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, spread: int = SPREAD,
                   gram: int = GRAM, block: int = BLOCK, keep: tuple[str, ...] = (), passage: int | None = None, passage_spread: int = 128, with_text: bool = True) -> DataFrame:
    """One row (id, *keep, n_bytes, n_removed, n_spans, kept binary, kept_text) per row of `docs`.

    kept_text: the bytes kept, without what a cut left of a character; null unless `with_text`. Texts are UTF-8 bytes (null: empty); a byte is
    removed if a string of `length` bytes over it also starts at another place of any text, overlaps included. All
    occurrences go. Repeated rows are texts of their own. Texts of any length are read whole. Columns not in `keep` are
    dropped; an empty table gives an empty result.

    With `passage`, a length of at most `length`, two columns more tell what repeats in the texts from that length on:
    n_passages, the runs of bytes that strings of `passage` bytes cover which also start anywhere else, and passage_bytes,
    their bytes. All repeated strings of `length` bytes lie in such runs, so only runs as long are looked through again.
    """
    texts = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), *(F.col(c).alias(f"keep_{c}") for c in keep),
                                F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("raw")), "texts")
    scratch = Scratch()
    whole = (length, spread) if passage is None else (passage, passage_spread)
    ranges = _by_row(repeated_windows(texts, *whole, gram, block, scratch), "found")
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    if passage is None or passage == length:
        ranges = written(ranges.withColumn("short", none if passage is None else F.col("found")), "ranges")
    else:
        first = Scratch()
        ranges = first.written(ranges.withColumnRenamed("found", "short"), "ranges")
        scratch.clear()
        parts = first.written(texts.join(ranges, "row").select("row", "raw", "short").mapInArrow(_long_runs(length, passage), "of long, at long, raw binary")
                              .withColumn("row", F.monotonically_increasing_id()), "parts")
        found = repeated_windows(parts, length, spread, gram, block, scratch).join(parts.select("row", "of", "at"), "row")
        found = _by_row(found.select(F.col("of").alias("row"), (F.col("lo") + F.col("at")).alias("lo"), (F.col("hi") + F.col("at")).alias("hi")), "found")
        ranges = written(ranges.join(found, "row", "left").withColumn("found", F.coalesce("found", none)), "ranges")
        first.clear()
    scratch.clear()
    told = texts.join(ranges, "row", "left").select("raw", "found", "short", "id", *(f"keep_{c}" for c in keep), F.length("raw").cast("long").alias("n_bytes"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in told.schema.fields[3:])
    more = [] if passage is None else ["n_passages", "passage_bytes"]
    return (told.mapInArrow(_remove(length, passage or length, with_text), f"{kinds}, n_removed long, n_spans long, kept binary, kept_text string, n_passages long, passage_bytes long")
            .select(F.col("id").alias(id_col), *(F.col(f"keep_{c}").alias(c) for c in keep), "n_bytes", "n_removed", "n_spans", "kept", "kept_text", *more))
