"""SimHash against a fingerprint and links by brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from mosaicell.llm import queries, simhash
from pyspark.sql import functions as F

from tests.conftest import SF


def slow_fingerprint(text: str | None, n: int = 3) -> int:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(texts: list[str | None], radius: int = 3, words: int = 3) -> list[tuple[str, int]]:
    prints = [slow_fingerprint(t, words) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(f"{p:016x}", find(k)) for k, p in enumerate(prints)]


def corpus() -> list[str | None]:
    rng = random.Random(1)
    texts: list[str | None] = [None, "", "   \t\n", "One", "one", "two words", "three little words", "É É É é", "x\x0by z\x1cw", "\u00a0 \u2003"]
    for _ in range(60):
        words = [rng.choice("abcdefghij") * rng.randint(1, 5) for _ in range(rng.randint(1, 300))]
        texts.append(" ".join(words))
        if rng.random() < 0.6:
            words[rng.randrange(len(words))] = "CHANGED"
            texts.append("  ".join(words))
    return [*texts, texts[-1], texts[12]]


@pytest.mark.parametrize("block,radius,words", [(3, 3, 3), (2048, 3, 3), (64, 6, 5)])
def test_like_brute_force(spark, block, radius, words):
    texts = corpus()
    rows = [(k, t, k, "a", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long, id string, component_id int")
    found = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(docs, block=block, radius=radius, words=words).collect())
    assert found == [(k, *b) for k, b in enumerate(brute(texts, radius, words))]


def test_keep_and_empty(spark):
    rows = [(2, "a b c d"), (1, "a b c d"), (None, "a b c d"), (7, "q w e r t y"), (7, "q w e r t y"), (7, "other words are here"), (None, "alone without an id"), (8, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit(1))
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.simhash_keep(docs).collect()), key=repr)
    assert kept == sorted([(1, "a b c d"), (7, "q w e r t y"), (7, "other words are here"), (None, "alone without an id"), (8, None)], key=repr)
    assert simhash.simhash_keep(docs).columns == docs.columns
    assert simhash.simhash_groups(docs.limit(0)).collect() == [] and simhash.simhash_keep(docs.limit(0)).collect() == []


def test_query(spark):
    rows = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    ids = [r["doc_id"] for r in rows]
    want = [(i, f, ids[c]) for i, (f, c) in zip(ids, brute([r["text"] for r in rows]))]
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.op7_simhash(spark, SF).collect()) == want


def shingle_set(text: str, n: int = 5) -> set:
    words = text.split()
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


def test_similar_pairs_are_found_and_verified(spark):
    """Nearly all pairs from five-word similarity 0.8 on lose a copy, none below it does: six bits of SimHash find few of them."""
    rng = random.Random(4)
    rows, near, far, bits = [], [], [], 0
    for k in range(400):
        a = [str(rng.randrange(10**6)) for _ in range(250)]
        b = list(a)
        for _ in range(rng.randint(3, 8)):
            b[rng.randrange(len(b))] = "changed"
        x, y = (shingle_set(" ".join(t)) for t in (a, b))
        (near if len(x & y) >= 0.8 * len(x | y) else far).append(2 * k + 1)
        bits += near[-1:] == [2 * k + 1] and (slow_fingerprint(" ".join(a), 5) ^ slow_fingerprint(" ".join(b), 5)).bit_count() <= 6
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    rows += [(10_000 + k, " ".join([*a[:200], *(str(rng.randrange(10**6)) for _ in range(6))])) for k in range(100)]  # a group beyond SHARED, all alike
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.similar_keep(docs).collect()}
    recall = sum(i not in kept for i in near) / len(near)
    print("pairs", len(near), len(far), "recall", recall, "six bits", bits / len(near))
    assert len(near) > 100 and len(far) > 30 and recall >= 0.98 and bits / len(near) < 0.8
    assert all(i in kept for i in far) and sum(i >= 10_000 for i in kept) <= 1


def test_similar_keep_rows(spark):
    rows = [(2, "a b c d"), (1, "a b c d"), (None, "a b c d"), (7, "q w e r t y"), (7, "q w e r t y"), (7, "other words are here"), (None, "alone without an id"), (8, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1))
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.similar_keep(docs).collect()), key=repr)
    assert kept == sorted([(1, "a b c d"), (7, "q w e r t y"), (7, "other words are here"), (None, "alone without an id"), (8, None)], key=repr)
    assert simhash.similar_keep(docs).columns == docs.columns and simhash.similar_keep(docs.limit(0)).collect() == []


@pytest.mark.parametrize("share,differ", [(0.744, 8), (0.768, 10)])
def test_pairs_within_a_large_family(spark, share, differ):
    """2000 texts share a template; pairs of them, above the threshold, are joined and no others."""
    rng = random.Random(differ)
    word = lambda: str(rng.randrange(10**7))
    own = round(400 * (1 - 2 * share / (1 + share)))  # of 400 words, after the template
    template, rows = [word() for _ in range(400 - own)], []
    for k in range(1000):
        tail = [word() for _ in range(own)]
        other = list(tail)
        for i in rng.sample(range(len(other) // differ), 2):
            other[i * differ] = word()
        rows += [(2 * k, [*template, *tail]), (2 * k + 1, [*template, *other])]
    sets = {i: shingle_set(" ".join(w)) for i, w in rows}
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    near = [k for k in range(1000) if alike(2 * k, 2 * k + 1) >= 0.8]
    assert len(near) > 900 and max(alike(2 * rng.randrange(1000), 2 * rng.randrange(1000) + 1) for _ in range(300)) < 0.79
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.similar_keep(docs).collect()}
    found = sum(2 * k + 1 not in kept for k in near)
    print("share", share, "pairs", len(near), "found", found)
    assert found >= 0.98 * len(near) and all(2 * k in kept for k in range(1000))
    assert all(2 * k + 1 in kept for k in set(range(1000)) - set(near))


def test_sets_by_brute_force():
    rng = random.Random(1)
    sets = [np.unique(np.array([rng.randrange(30) for _ in range(rng.randint(1, 30))], np.uint64)) for _ in range(150)]
    i, j = simhash.set_links(sets[:70], sets[70:], 0.6)
    jaccard = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    assert sorted(zip(i.tolist(), j.tolist())) == [(a, b) for a in range(70) for b in range(80) if jaccard(sets[a].tolist(), sets[70 + b].tolist()) >= 0.6]


def test_what_simhash_links_is_verified_and_kept(spark):
    """Without any shared print: the links are SimHash's own, but for those that are not similar."""
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in rng.integers(0, 5000, 600)]
    texts = [" ".join(words), " ".join(words[:-1] + ["other"]), " ".join(f"v{k}" for k in rng.integers(0, 5000, 600))]
    prints = [simhash.fingerprint(x.encode(), 5) for x in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= 3
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    rows = [(k, [], signed(prints[k])) for k in range(3)] + [(3, [], signed(prints[0]))]  # the last has a fingerprint that is not its text's
    classes = spark.createDataFrame(rows, "row long, prints array<long>, fp long")
    found = simhash.similar_links(classes, spark.createDataFrame([*enumerate(texts), (3, texts[2])], "row long, text string"), 5, 0.8)
    assert {(r["u"], r["v"]) for r in found.collect()} == {(0, 1)}


def test_joins_are_planned_by_rows_and_not_by_files(spark, monkeypatch):
    """A file of equal or rising numbers is small whatever its rows: no join may be a broadcast for that."""
    from mosaicell.functions.tables import holding
    from pyspark.sql.readwriter import DataFrameWriter

    seen, write = {}, DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (seen.update({path.rpartition("/")[2].partition("-")[0]: spark.conf.get("spark.sql.autoBroadcastJoinThreshold")}), write(self, path, *a, **k))[1])
    df = spark.createDataFrame([(k, f"a b c d e f g h i j k l m n o {k % 3}") for k in range(9)], "doc_id long, text string")
    with holding():
        assert simhash.similar_keep(df, words=3).count() == 1
    assert {"classes", "links", "joined", "kept", "pairs"} <= seen.keys() and set(seen.values()) == {"-1"}


def test_pairs_are_written_before_they_are_verified(spark, monkeypatch):
    """Plans of the driver stay small: what is verified names a written table several times, not the joins behind it."""
    plans, verified = [], simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda pairs, *rest: plans.append(pairs._jdf.queryExecution().optimizedPlan().toString()) or verified(pairs, *rest))
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(k, f"{text} x{k}") for k in range(12)] + [(100 + k, f"y{k} z{k} v{k} u{k} t{k} s{k}") for k in range(5)]
    kept = simhash.similar_keep(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, *range(100, 105)]
    assert len(plans) == 2 and not any(word in plan for plan in plans for word in ("Join", "Aggregate"))


def test_stars_are_settled(spark, monkeypatch):
    """Links that are stars already take no round; chains and repeated links take some."""
    from mosaicell.functions import tables

    names, write = [], tables.Scratch.written
    monkeypatch.setattr(tables.Scratch, "written", lambda self, df, name, *rest: names.append(name) or write(self, df, name, *rest))
    found = tables.components(spark.createDataFrame([(5, 1), (1, 6), (7, 1), (9, 8), (8, 9), (4, 4), (None, 3)], "u long, v long"))
    assert sorted(map(tuple, found.collect())) == [(5, 1), (6, 1), (7, 1), (9, 8)] and len(names) == 1
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(60, 50), (60, 51), (51, 50)], "u long, v long")
    assert sorted(map(tuple, tables.components(chain).collect())) == [*((k, 0) for k in range(1, 41)), (51, 50), (60, 50)]
