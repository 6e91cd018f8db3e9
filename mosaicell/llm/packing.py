"""Lexical retrieval packing: windows filled with the BM25 neighbours of a seed document.

Documents become token ids; whole windows are cut off long documents. What remains of each document is indexed in
shards of a bounded number of documents: in a shard an inverted index with BM25 weights returns, for each seed, its
best unused neighbours, which greedily fill the seed's window. Shards are independent tasks.

Document frequencies and the mean length are counted once over all pieces. Shards go by content: a tree of centroids
over sketches of the pieces' BM25 weights, whose nodes are split until they are small enough. More pieces make more and
finer shards of pieces that are alike; pieces that no centroids tell apart are dealt by a hash.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW = 1024
#: Documents in a shard of the index, on average.
SHARD_DOCS = 2048
#: Neighbours that are tried before one is cut to fit.
NEIGHBOURS = 48
#: Values of a piece's sketch. Children of a node of the tree of shards, pieces that they are fitted on, rounds of the
#: fit, and levels of the tree at most.
SKETCH, FAN, FIT_PIECES, FIT_ROUNDS, LEVELS = 256, 32, 2048, 8, 12
K1, B = 1.2, 0.75
#: Ids that at least one in so many of a shard's pieces has are rows of its matrix: the matrix has at most so many entries
#: for each posting.
DENSE = 8
#: Used pieces leave the index where no more than this part of it is unused.
SHRINK = 0.7
#: Where these occur, white space may run on and has to be matched with look-ahead.
UNSAFE = ("  ", " \n", "\n ", "\n\n\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u1680", "\u2028", "\u2029",
          "\u202f", "\u205f", "\u3000", *map(chr, range(0x2000, 0x200B)))


class ByteBpe:
    """Ids of a byte-level BPE vocabulary in the tokenizers library's JSON format, as that library's default call gives them.

    Texts are split at the strings of added tokens, such as <|endoftext|>, each of which is one id. The same pre-tokens
    and merges as that library's (tests compare them), several times as fast. Texts without runs of white space take a
    pattern without look-ahead, which cuts them alike and is matched faster.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        if any(t[k] for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in what is around them are not supported")
        vocab, self._added = file["model"]["vocab"], {t["content"]: t["id"] for t in file["added_tokens"]}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if all(c in byte_of for c in t) and t not in self._added}
        encoding = lambda p: tiktoken.Encoding("byte_bpe", pat_str=p, mergeable_ranks=ranks, special_tokens=self._added)
        self._split = partial(encoding(pattern).encode, allowed_special="all")
        self._any = encoding(pattern).encode_ordinary
        self._plain = encoding(pattern.replace(r"\s+(?!\S)|\s+", r"\s")).encode_ordinary

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if any(t in text for t in self._added):
            return array("I", self._split(text)).tobytes()
        plain = not any(c in text for c in UNSAFE) and not text.endswith("\n\n")
        return array("I", (self._plain if plain else self._any)(text)).tobytes()


def _tokenise(path: str, pattern: str, end: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = ByteBpe(path, pattern), np.array([end], "<u4").tobytes()
        for batch in batches:
            row, start, length, total, ids = [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                found = encode(text.as_py() or "") + tail
                n = len(found) // 4
                for s in range(0, n, window):
                    row.append(k)
                    start.append(s)
                    length.append(min(window, n - s))
                    total.append(n)
                    ids.append(found[4 * s : 4 * (s + window)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, total)), pa.array(ids, pa.binary())],
                ["id", "start", "length", "doc_tokens", "ids"])

    return run


@dataclass(frozen=True)
class Corpus:
    """What BM25 counts over all pieces: the inverse document frequency of each id, how many pieces have it, and their mean length."""

    idf: np.ndarray
    df: np.ndarray
    mean: float

    @staticmethod
    def of(df: np.ndarray, n: int, mean: float) -> Corpus:
        return Corpus(np.log1p((n - df + 0.5) / (df + 0.5)), df, mean)

    def weights(self, terms: np.ndarray, tf: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return self.idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / self.mean))


def count_corpus(pieces: list[np.ndarray]) -> Corpus:
    """The counts over a list of pieces."""
    return Corpus.of(np.bincount(np.concatenate([np.unique(p) for p in pieces])), len(pieces), float(np.mean([len(p) for p in pieces])))


class Bm25:
    """An inverted index over a shard's pieces (arrays of ids), with the BM25 weights of the whole corpus.

    Postings of ids that many pieces have are rows of a matrix, with zeros; those of the others are lists.
    """

    def __init__(self, pieces: list[np.ndarray], corpus: Corpus):
        n = len(pieces)
        self.columns = np.arange(n)  # pieces that are scored
        sizes = np.array([len(p) for p in pieces])
        doc = np.repeat(np.arange(n), sizes)
        keys, tf = np.unique(np.concatenate(pieces).astype(np.int64) * n + doc, return_counts=True)
        term, docs = keys // n, keys % n
        weight = corpus.weights(term, tf, sizes[docs]).astype(np.float32)
        first = np.nonzero(np.append(True, term[1:] != term[:-1]))[0]
        df = np.diff(np.append(first, len(term)))
        dense = df * DENSE >= n
        place = np.where(dense, np.cumsum(dense) - 1, np.cumsum(~dense) - 1)  # of each id among its kind
        place, in_matrix = np.repeat(place, df), np.repeat(dense, df)
        self.matrix = np.zeros((int(dense.sum()), n), np.float32)
        self.matrix[place[in_matrix], docs[in_matrix]] = weight[in_matrix]
        self.docs, self.weight = docs[~in_matrix], weight[~in_matrix]
        self.at = np.append(0, np.cumsum(df[~dense]))
        order = np.argsort(docs.astype(np.uint16) if n <= 1 << 16 else docs, kind="stable")
        place, docs, in_matrix = place[order], docs[order], in_matrix[order]
        self.own = [(place[kind], np.searchsorted(docs[kind], np.arange(n + 1))) for kind in (in_matrix, ~in_matrix)]

    def keep(self, kept: np.ndarray) -> None:
        """Leaves out the columns that aren't `kept`."""
        there = kept[self.docs]
        self.at = np.append(0, np.cumsum(there))[self.at]
        self.docs, self.weight = (np.cumsum(kept) - 1)[self.docs[there]], self.weight[there]
        self.matrix, self.columns = np.ascontiguousarray(self.matrix[:, kept]), self.columns[kept]

    def scores(self, seed: int) -> np.ndarray:
        """The score of each column for all terms of the seed."""
        rows, lists = (own[at[seed] : at[seed + 1]] for own, at in self.own)
        start, n = self.at[lists], self.at[lists + 1] - self.at[lists]
        hit = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.docs[hit], self.weight[hit], minlength=len(self.columns)) + self.matrix[rows].sum(axis=0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(0, np.int64)
    for batch in batches:
        found = [np.unique(np.frombuffer(x.as_py(), "<u4")) for x in batch.column(0)]
        if found:
            more = np.bincount(np.concatenate(found).astype(np.int64), minlength=len(df))
            more[: len(df)] += df
            df = more
    term = np.nonzero(df)[0]
    yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], ["term", "df"])


def corpus_of(pieces: DataFrame, n: int, mean: float) -> Corpus:
    """The counts over all pieces (ids); what comes to the driver is a row for each id of the vocabulary."""
    rows = pieces.select("ids").mapInArrow(_count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(int(rows["term"].max()) + 1, np.int64)
    df[rows["term"].to_numpy(np.int64)] = rows["df"].to_numpy(np.int64)
    return Corpus.of(df, n, mean)


class Sketcher:
    """Unit vectors whose products are near the cosines of BM25 weights: each id that pieces share falls, with a sign, on two of their values."""

    def __init__(self, corpus: Corpus):
        self.corpus, ids, self.places, self.signs = corpus, np.arange(len(corpus.df), dtype=np.uint64), [], []
        for salt in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
            h = (ids + np.uint64(1)) * salt
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            self.places.append(((h >> np.uint64(40)) % np.uint64(SKETCH)).astype(np.int64))
            self.signs.append(np.where(corpus.df > 1, np.where(h >> np.uint64(63), 1.0, -1.0), 0.0))

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        terms, tf = np.unique(ids, return_counts=True)
        weight, out = self.corpus.weights(terms, tf, len(ids)), np.zeros(SKETCH)
        for place, sign in zip(self.places, self.signs):
            out += np.bincount(place[terms], weight * sign[terms], minlength=SKETCH)
        return (out / max(np.linalg.norm(out), 1e-30)).astype(np.float16)


def _sketches(corpus: Corpus):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(corpus)
        for batch in batches:
            found = [sketch(np.frombuffer(x.as_py(), "<u4")).tobytes() for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "sketch"])

    return run


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, SKETCH).astype(np.float32)


#: The tree: a node's first child and its children's centroids. The root is 0, leaves are absent.
Tree = dict[int, tuple[int, np.ndarray]]


def descend(x: np.ndarray, tree: Tree) -> np.ndarray:
    """The leaf of each sketch."""
    node, open_ = np.zeros(len(x), np.int64), [0] if 0 in tree else []
    while open_:
        parent = open_.pop()
        at = np.nonzero(node == parent)[0]
        if len(at):
            first, centre = tree[parent]
            node[at] = first + (x[at] @ centre.T).argmax(axis=1)
            open_ += [first + k for k in range(len(centre)) if first + k in tree]
    return node


def _at_nodes(tree: Tree, share: dict[int, float]):
    """(node, sketch) of the share of pieces that each node in `share` is to be fitted on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = descend(_vectors(batch.column(0)), tree)
            draw = (batch.column(1).to_numpy() & ((1 << 30) - 1)) / float(1 << 30)
            some = pa.array(np.nonzero(draw < np.array([share.get(k, 0.0) for k in node.tolist()]))[0])
            yield pa.RecordBatch.from_arrays([pa.array(node).take(some), batch.column(0).take(some)], ["node", "sketch"])

    return run


def _sizes(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n = np.unique(descend(_vectors(batch.column(0)), tree), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n)], ["node", "n"])

    return run


def _children(wanted: dict[int, int]):
    """Spherical k-means of a node's sample; equal sketches count once."""
    def run(sample: pa.Table) -> pa.Table:
        node = sample.column("node")[0].as_py()
        x = np.unique(_vectors(sample.column("sketch")), axis=0)
        x = x[np.random.default_rng(node).permutation(len(x))]
        centre = x[: wanted[node]]
        for _ in range(FIT_ROUNDS):
            own = (x @ centre.T).argmax(axis=1)
            centre = np.stack([x[own == c].sum(axis=0) if (own == c).any() else centre[c] for c in range(len(centre))])
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-30)
        return pa.table({"node": pa.array([node], pa.int64()), "centres": pa.array([centre.astype(np.float32).tobytes()], pa.binary())})

    return run


def content_tree(sketched: DataFrame, n: int, shard_docs: int) -> tuple[Tree, dict[int, int]]:
    """The tree over all `n` pieces (sketch, draw), and how many pieces each leaf has.

    A node of more than 1.5 times `shard_docs` is split, unless a split has left its pieces together.
    """
    tree, sizes, whole = {}, {0: n}, set()
    for _ in range(LEVELS):
        large = {k: m for k, m in sizes.items() if m > 1.5 * shard_docs and k not in whole}
        if not large:
            break
        share = {k: FIT_PIECES / m for k, m in large.items()}
        wanted = {k: min(FAN, -(-3 * m // (2 * shard_docs))) for k, m in large.items()}
        fitted = (sketched.select("sketch", "draw").mapInArrow(_at_nodes(tree, share), "node long, sketch binary")
                  .groupBy("node").applyInArrow(_children(wanted), "node long, centres binary").collect())
        following, parent = 1 + sum(len(c) for _, c in tree.values()), {}
        for r in sorted(fitted, key=lambda r: r["node"]):
            centre = np.frombuffer(r["centres"], np.float32).reshape(-1, SKETCH)
            tree[r["node"]] = following, centre
            parent |= dict.fromkeys(range(following, following + len(centre)), r["node"])
            following += len(centre)
        whole |= large.keys() - {r["node"] for r in fitted}
        found = sketched.select("sketch").mapInArrow(_sizes(tree), "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()
        before, sizes = sizes, {r["node"]: r["n"] for r in found}
        whole |= {k for k in sizes if k in parent and sizes[k] == before[parent[k]]}
    return tree, sizes


def leaf_shards(tree: Tree, sizes: dict[int, int], shard_docs: int) -> dict[int, tuple[int, int]]:
    """Each leaf's first shard and number of shards: small neighbours in the tree share one, large leaves have several."""
    order, open_ = [], [0]
    while open_:
        node = open_.pop()
        if node in tree:
            open_ += range(tree[node][0], tree[node][0] + len(tree[node][1]))
        elif node in sizes:
            order.append(node)
    out, shard, filled = {}, 0, 0
    for node in order:
        parts = -(-sizes[node] // shard_docs) if sizes[node] > 1.5 * shard_docs else 1
        if filled and (parts > 1 or filled + sizes[node] > shard_docs):
            shard, filled = shard + 1, 0
        out[node] = shard, parts
        if parts > 1:
            shard += parts
        else:
            filled += sizes[node]
    return out


def _shards(tree: Tree, shards: dict[int, tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, parts = np.array([shards[k] for k in descend(_vectors(batch.column("sketch")), tree).tolist()], np.int64).reshape(-1, 2).T
            kept = [c for c in batch.schema.names if c not in ("sketch", "draw")]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(first + (batch.column("draw").to_numpy() >> 31) % parts)], [*kept, "shard"])

    return run


def with_shards(rest: DataFrame, n: int, corpus: Corpus, shard_docs: int) -> DataFrame:
    """The `n` pieces (id, start, length, doc_tokens, ids) with the shard that each goes to."""
    if n <= shard_docs:
        return rest.withColumn("shard", F.lit(0).cast("long"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.schema.fields)
    # By the piece's number in the written table: neither a repeated id nor copies fill a shard.
    drawn = rest.withColumn("draw", F.xxhash64(F.monotonically_increasing_id()))
    sketched = written(drawn.mapInArrow(_sketches(corpus), f"{kinds}, draw long, sketch binary"), "sketches")
    tree, sizes = content_tree(sketched, n, shard_docs)
    return sketched.mapInArrow(_shards(tree, leaf_shards(tree, sizes, shard_docs)), f"{kinds}, shard long")


def pack_shard(pieces: list[np.ndarray], window: int = WINDOW, corpus: Corpus | None = None) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in it, length, sequence, offset) so that every id is placed once and only the last window has room.

    A seed is what was cut off the last window, else the longest unused piece. Its neighbours come in order of BM25
    score (ties: longer, then earlier); those that fit whole are placed first, then the best one is cut to fill up.
    Without a `corpus`, counts are over these pieces.
    """
    index, out = Bm25(pieces, corpus or count_corpus(pieces)), []
    sizes = np.array([len(p) for p in pieces])
    unused, order = np.ones(len(pieces), bool), np.argsort(-sizes, kind="stable").tolist()
    seed, begin, sequence, at = None, 0, 0, 0
    while True:
        if seed is None:
            while at < len(order) and not unused[order[at]]:
                at += 1
            if at == len(order):
                return out
            seed, begin = order[at], 0
            unused[seed] = False
        filled = int(sizes[seed]) - begin
        out.append((seed, begin, filled, sequence, 0))
        cut, scores = None, None
        while filled < window and cut is None and unused.any():
            if scores is None:
                if np.count_nonzero(unused) <= SHRINK * len(index.columns):
                    index.keep(unused[index.columns])
                scores = index.scores(seed)
            left = np.nonzero(unused[index.columns])[0]
            free, own = index.columns[left], scores[left]
            if len(free) > NEIGHBOURS:
                best = own >= np.partition(own, -NEIGHBOURS)[-NEIGHBOURS]
                free, own = free[best], own[best]
            free = free[np.lexsort((free, -sizes[free], -own))[:NEIGHBOURS]]
            for k in free.tolist():
                if sizes[k] <= window - filled:
                    out.append((k, 0, int(sizes[k]), sequence, filled))
                    unused[k] = False
                    filled += int(sizes[k])
            left = [k for k in free.tolist() if unused[k]]
            if filled < window and left:
                cut = left[0]
                unused[cut] = False
                out.append((cut, 0, window - filled, sequence, filled))
        seed, begin = (cut, window - filled) if cut is not None else (None, 0)
        sequence += 1


def _pack(window: int, corpus: Corpus):
    def run(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks().sort_by([("id", "ascending"), ("start", "ascending")])
        ids = [np.frombuffer(x, "<u4") for x in shard.column("ids").to_pylist()]
        k, start, length, sequence, offset = map(np.array, zip(*pack_shard(ids, window, corpus)))
        begin = shard.column("start").to_numpy()[k] + start
        number = (shard.column("shard").to_numpy()[k].astype(np.int64) << 32) + sequence
        pieces = [ids[a][s : s + n].tobytes() for a, s, n in zip(k.tolist(), start.tolist(), length.tolist())]
        return pa.table({"id": shard.column("id").take(pa.array(k)), "start": begin, "length": length,
                         "doc_tokens": shard.column("doc_tokens").to_numpy()[k], "ids": pa.array(pieces, pa.binary()),
                         "sequence_id": number, "offset": offset})

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                   end_id: int = 0, window: int = WINDOW, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, ids (little-endian unsigned 32-bit), sequence_id, offset.

    Each document's ids, then `end_id`, lie in exactly one piece each; sequences hold at most `window` ids, and only
    the last of a shard has room left. Null texts count as empty and give one piece with `end_id`. Repeated rows are
    documents of their own; ties are broken by id and start. Texts of any length are read whole; other columns are
    ignored. An empty table gives an empty result.

    `shard_docs` sets how many documents share an index; the number of shards follows the number of documents, and
    documents go to shards by content.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    pieces = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
                     .mapInArrow(_tokenise(tokenizer_path, pattern, end_id, window),
                                 f"id {kind}, start long, length long, doc_tokens long, ids binary"), "pieces")
    full = pieces.where(F.col("length") == window).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < window)
    n, mean = rest.agg(F.count("*"), F.coalesce(F.avg("length"), F.lit(0.0))).first()
    if not n:
        return full.withColumnRenamed("id", id_col)
    corpus = corpus_of(rest, n, mean)
    packed = (with_shards(rest, n, corpus, shard_docs).groupBy("shard")
              .applyInArrow(_pack(window, corpus), f"id {kind}, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"))
    return full.unionByName(packed).withColumnRenamed("id", id_col)
