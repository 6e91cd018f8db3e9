"""Suffix-array dedup against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from mosaicell.llm import suffix


def covered(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, which bytes lie in a string of `length` bytes that starts anywhere else."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone[:-1])
    return out


def brute(texts: list[bytes], length: int) -> list[tuple[int, int, bytes]]:
    """(removed, spans, kept) of each text."""
    out = []
    for t, covers in zip(texts, covered(texts, length)):
        gone = np.append(covers, False)
        spans = int((gone[1:].astype(int) - gone[:-1] == 1).sum() + gone[0])
        out.append((int(gone.sum()), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def corpus(seed: int, n: int, length: int) -> list[str]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(rng.randint(length // 8, length // 2)) for _ in range(4)]
    texts = []
    for k in range(n):
        kind = k % 6
        if kind == 0 or not texts:
            texts.append(prose(rng.randint(0, length)))
        elif kind == 1:
            texts.append(rng.choice(texts))
        elif kind == 2:
            words = rng.choice(texts).split(" ")
            words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
        elif kind == 3:
            texts.append(prose(rng.randint(0, 30)) + rng.choice(passages) + prose(rng.randint(0, 30)))
        elif kind == 4:
            texts.append(prose(5) + rng.choice(passages) + rng.choice(passages) + "x" * rng.randint(0, 3 * length))
        else:
            texts.append("ab" * rng.randint(0, length))
    return texts


@pytest.mark.parametrize("seed,length,spread,gram,block", [(1, 400, 192, 24, 512), (2, 60, 24, 8, 4), (3, 40, 20, 6, 2), (4, 60, 24, 8, 512)])
def test_like_brute_force(spark, seed, length, spread, gram, block):
    texts = [*corpus(seed, 90, length), "", None, "a", "a"]
    rows = [(k, t, 1, "x") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, core string")  # names that the operator uses inside
    found = suffix.remove_repeats(docs, length=length, spread=spread, gram=gram, block=block).collect()
    raw = [(t or "").encode() for t in texts]
    want = [(k, len(t), *b) for k, (t, b) in enumerate(zip(raw, brute(raw, length)))]
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found) == want
    assert sum(w[2] for w in want) > 1000


@pytest.mark.parametrize("seed,length,passage", [(5, 400, 200), (6, 60, 40), (7, 60, 60)])
def test_passages_like_brute_force(spark, seed, length, passage):
    texts = [*corpus(seed, 90, length), *corpus(seed, 40, passage), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gram, spread = (24, 96) if passage == 200 else (8, 20)
    found = suffix.remove_repeats(docs, length=length, spread=length // 2 - 8, gram=gram, passage=passage, passage_spread=spread).collect()
    raw = [(t or "").encode() for t in texts]
    short = [(size, runs) for size, runs, _ in brute(raw, passage)]
    want = [(k, *long, *short[k]) for k, long in enumerate(brute(raw, length))]
    assert sorted((r["doc_id"], r["n_removed"], r["n_spans"], bytes(r["kept"]), r["passage_bytes"], r["n_passages"]) for r in found) == want
    assert sum(w[4] for w in want) > 500 or passage == length


def test_cuts_leave_whole_characters():
    raw = "aé漢🙂\ufffdz".encode()
    assert suffix.whole_characters(raw, False, False) == raw == suffix.whole_characters(raw, True, True)
    for at in range(len(raw) + 1):
        left, right = suffix.whole_characters(raw[:at], True, False).decode(), suffix.whole_characters(raw[at:], False, True).decode()
        assert "aé漢🙂\ufffdz".startswith(left) and "aé漢🙂\ufffdz".endswith(right) and len(left) + len(right) >= 5


def test_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PART", 1000)
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    texts = [base, base[1500:4700], "q" * 3000, base[:399]]
    finder = suffix.Anchors(400, 192, 24)
    assert len(finder.powers[0]) == (1 << 21) + 1
    found = suffix.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = brute([t.encode() for t in texts], 400)
    assert [(r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in sorted(found)] == want


def test_suffix_array_is_sorted():
    rng = random.Random(6)
    raw = bytes(rng.choice(b"ab") for _ in range(3000))
    groups = np.sort(np.array([rng.randrange(7) for _ in range(900)]))
    starts = np.array([rng.randrange(2900) for _ in range(900)])
    order = suffix.SuffixSort(raw, starts, groups, 100).array()
    for g in range(7):
        at = order[groups[order] == g]
        windows = [raw[starts[k] : starts[k] + 100] for k in at]
        assert windows == sorted(windows)
    assert (np.diff(groups[order]) >= 0).all()


def test_collisions_are_found(monkeypatch):
    raw = b"abcdefghij" * 3 + b"abcdefghiX"
    starts, groups = np.array([0, 10, 30]), np.zeros(3, np.int64)
    sort = suffix.SuffixSort(raw, starts, groups, 10)
    sort.whole[:] = 7  # as if all collided
    assert sort.repeated().tolist() == [0, 0, -1]


def test_sort_tells_runs():
    """What is found repeated comes as runs of windows, not as a row for each window."""
    rng = np.random.default_rng(9)
    head, middle, tail = (rng.integers(97, 123, n).astype(np.uint8).tobytes() for n in (40, 60, 40))
    variants = [b"X" + head + middle + tail, head + middle + tail + b"Y", b"Z" * 41 + middle + b"W" * 40]  # windows of 80 bytes; the first two share 61
    back = [61, 60, 61]
    task = pa.table({"core": [5] * 3, "cover": [1, 2, 3], "n": [1] * 3, "back": pa.array(back, pa.int32()), "blocks": pa.array([1] * 3, pa.int32()), "block": pa.array([0] * 3, pa.int32()), "bytes": pa.array(variants, pa.binary())})
    rows = suffix._sort_task(80)(task).to_pylist()
    assert sorted((r["cover"], r["shift"], r["until"]) for r in rows if r["valid"]) == [(1, 1, 61), (2, 0, 60)] and len(rows) == 2


def test_ranges_merge_by_text():
    rng = random.Random(10)
    found = [None, [], *([(a := rng.randrange(3000), a + rng.randrange(60)) for _ in range(rng.randrange(1, 12))] for _ in range(300))]
    kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
    got = suffix._merged(pa.array([x and [{"lo": a, "hi": b} for a, b in x] for x in found], kind).slice(1), 80)
    for x, runs in zip(found[1:], got, strict=True):
        cover = np.zeros(3200, int)
        for a, b in x:
            cover[a : b + 80] = 1
        edges = np.diff(cover, prepend=0)
        assert runs == list(zip(np.nonzero(edges == 1)[0].tolist(), np.nonzero(edges == -1)[0].tolist()))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.remove_repeats(docs).collect() == []


def test_query(spark):
    from mosaicell.llm import queries

    from tests.conftest import SF

    rows = queries.op5_suffix(spark, SF).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    ids = sorted(texts)
    want = {i: b for i, b in zip(ids, brute([texts[i] for i in ids], 400))}
    assert len(rows) == len(ids)
    for r in rows:
        removed, spans, kept = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(texts[r["doc_id"]]), removed, spans, hashlib.sha256(kept).hexdigest())
