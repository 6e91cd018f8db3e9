"""Packing: ids like the tokenizers library's, every id placed once, little padding, neighbours together."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from mosaicell.llm import packing, queries
from tokenizers import Tokenizer

from tests.conftest import SF

AWKWARD = [None, "", " ", "\n\n", "a  b   c", "tail  ", "tail\n\n", "x\n\n\ny", "tab\tand\r\nline", "\u00a0no break\u3000wide", "don't I'll we've", "<|endoftext|>", "a <|endoftext|> b", "  <|endoftext|>\n\n<|endoftext|><|endoftext|>  x", "<|endoftext|", "ÆØÅ 漢字 🙂🙂", "word " * 3000, "\x1c\x1d odd", "  lead", "a \n b"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids(reference):
    encode = packing.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    for text in AWKWARD:
        assert np.frombuffer(encode(text or ""), "<u4").tolist() == reference(text)


def check(pieces: list, texts: dict, reference, window: int = 1024) -> float:
    """Every id of every document lies in one piece, sequences are gapless; returns the share of padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for i, rows in by_doc.items():
        ids = np.array([*reference(texts[i]), 0], "<u4")
        at = 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    total = sum(r["length"] for r in pieces)
    return 1 - total / (window * len(by_sequence))


def test_awkward(spark, reference):
    rows = [(k, t, 5, "clash", k) for k, t in enumerate(AWKWARD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, shard string, sequence_id int")
    found = queries.packed(spark, docs).collect()
    check(found, dict(enumerate(AWKWARD)), reference)
    assert len({r["sequence_id"] for r in found}) == -(-sum(r["length"] for r in found) // 1024)
    assert queries.packed(spark, docs.limit(0)).collect() == []
    twice = queries.packed(spark, docs.where("doc_id in (4, 13)").unionByName(docs.where("doc_id = 4"))).collect()
    assert sum(r["length"] for r in twice if r["doc_id"] == 4) == 2 * (len(reference(AWKWARD[4])) + 1)


def test_query(spark, reference):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert check(queries.op1_packing(spark, SF).collect(), texts, reference) < 0.02


def test_ranking():
    """Scores are BM25's, with or without pieces left out; windows take neighbours in their order, ties by length and place."""
    rng = np.random.default_rng(2)
    pieces = [rng.zipf(1.4, rng.integers(1, 60)).clip(max=500) for _ in range(300)] + [np.array([499, 500])] * 3
    corpus = packing.count_corpus(pieces)
    counts = [Counter(p.tolist()) for p in pieces]
    df, mean = Counter(t for c in counts for t in c), sum(map(len, pieces)) / len(pieces)

    def score(seed: int, k: int) -> float:
        norm = 1.2 * (0.25 + 0.75 * len(pieces[k]) / mean)
        return sum(np.log1p((len(pieces) - df[t] + 0.5) / (df[t] + 0.5)) * counts[k][t] * 2.2 / (counts[k][t] + norm) for t in counts[seed] if t in counts[k])

    index, kept = packing.Bm25(pieces, corpus), np.arange(len(pieces)) % 3 > 0
    for shrunk in (False, True):
        if shrunk:
            index.keep(kept)
        for seed in (0, 7, 301):
            assert np.allclose(index.scores(seed), [score(seed, k) for k in range(len(pieces)) if kept[k] or not shrunk], rtol=1e-5)
    placed = packing.pack_shard(pieces, 10_000)
    assert [p[0] for p in placed[1:49]] == sorted((k for k in range(303) if k != placed[0][0]), key=lambda k: (-np.float32(score(placed[0][0], k)), -len(pieces[k]), k))[:48]


def test_neighbours_share_windows():
    rng = np.random.default_rng(1)
    topics = [rng.integers(k * 1000, k * 1000 + 60, (30, 100)) for k in range(8)]
    pieces = [t for k in range(30) for t in (topic[k] for topic in topics)]
    placed = packing.pack_shard(pieces, 1000)
    together = defaultdict(set)
    for piece, _, _, sequence, _ in placed:
        together[sequence].add(piece % 8)
    assert np.mean([len(s) for s in together.values()]) < 3  # topics of ten pieces; at random it would be over 5


def test_shards_by_content(spark):
    """The best neighbour in the whole corpus is in a piece's shard, however many shards there are; counts are of the corpus."""
    rng = np.random.default_rng(3)
    own = [rng.integers(1000, 40_000, 40) for _ in range(100)]
    pieces = [np.concatenate([rng.choice(own[k % 100], 40), rng.integers(0, 900, 80)]).astype("<u4") for k in range(2000)]
    pieces += [pieces[0]] * 500  # copies that no centroids tell apart
    rows = [(k, 0, len(p), len(p), p.tobytes()) for k, p in enumerate(pieces)]
    rest = spark.createDataFrame(rows, "id long, start long, length long, doc_tokens long, ids binary")
    corpus = packing.corpus_of(rest, len(rows), float(np.mean([len(p) for p in pieces])))
    whole = packing.count_corpus(pieces)
    assert corpus.df.tolist() == whole.df.tolist() and np.allclose(corpus.idf, whole.idf) and corpus.mean == whole.mean
    shard = {r["id"]: r["shard"] for r in packing.with_shards(rest, len(rows), corpus, 100).select("id", "shard").collect()}
    sizes = np.bincount(list(shard.values()))
    assert len(shard) == 2500 and (sizes > 0).sum() >= 15 and sizes.max() <= 250
    index, found = packing.Bm25(pieces[:2000], whole), []
    for k in range(1, 2000, 20):
        scores = index.scores(k)
        scores[k] = 0
        found.append(shard[int(scores.argmax())] == shard[k])
    assert np.mean(found) > 0.8  # at random about 0.04
