"""The pipeline's stages, one after the other, against what each is to do."""

from __future__ import annotations

import corpus_pipeline
from mosaicell.llm.common import table, written

SF = "/root/testdata/sf0.01"  # the smallest tables have too few toxic documents to learn from


def test_stages(spark, caplog):
    caplog.set_level("INFO", logger="mosaicell.llm.mixing")
    docs, kept = table(spark, SF, "documents"), {}
    first = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        kept[name] = docs.collect()
    toxic = {r["doc_id"] for r in table(spark, SF, "labels").where("toxic = 1").collect()}
    left = {r["doc_id"] for r in kept["toxicity"]}
    assert left < set(first) and len(toxic - left) > 0.5 * len(toxic) and len((set(first) - toxic) - left) < 0.1 * len(first)
    unique = {r["doc_id"]: r["text"] for r in kept["simhash"]}
    assert len(unique) == len(kept["simhash"]) and set(unique) < left and len(set(unique.values())) == len(unique)
    cut = {r["doc_id"]: r["text"] for r in kept["suffix"]}
    assert set(cut) <= set(unique) and any(cut[i] != unique[i] for i in cut) and all(len(cut[i]) <= len(unique[i]) for i in cut)
    assert all(r["n_chars"] == len(r["text"]) for r in kept["suffix"] if r["text"] != unique[r["doc_id"]])
    copies = {i: 0 for i in cut}
    for r in kept["mixing"]:
        assert r["text"] == cut[r["doc_id"]]
        copies[r["doc_id"]] += 1
    assert min(copies.values()) >= 1 and max(copies.values()) <= 8 and sum(copies.values()) > len(copies)
    said = [r for r in caplog.records if r.getMessage().startswith("mix ")]
    assert len(said) == 2 and all(r.levelname == "INFO" for r in said)  # no target is missed by over 1 %
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == set(cut) and all(r["offset"] + r["length"] <= 1024 for r in packed)


PASSAGE_WORDS = 51


def test_passages_of_fifty_words(spark):
    """Passages of 51 to 60 words that documents share go from all of them; other documents stay as they are."""
    import random

    rng = random.Random(3)
    some = [w for r in table(spark, SF, "documents").where("text is not null and lang is not null").orderBy("doc_id").limit(200).collect() for w in r["text"].split()]
    prose = lambda n: " ".join(rng.choice(some) for _ in range(n))
    passages = [prose(PASSAGE_WORDS + k % 10) for k in range(60)]
    rows = [(k, f"{prose(rng.randint(20, 200))} {passages[k % 60]} {prose(rng.randint(20, 200))}", "x", "s", 5) for k in range(180)]
    rows += [(1000 + k, prose(rng.randint(20, 200)), None, None, None) for k in range(200)]
    found = {r["doc_id"]: r["text"] for r in corpus_pipeline.no_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()}
    planted = [k for k, *_ in rows if k < 1000]
    assert sum(passages[k % 60][20:-20] not in found[k] for k in planted) >= 0.98 * len(planted)
    assert all(found[r[0]] == r[1] for r in rows if r[0] >= 1000)


AWKWARD = [(1, None, None, None, None, "a"), (None, "", "x", "s", 0, "b"), (2, "one word", None, None, None, "c"), (2, "one word", None, None, None, "c"), (3, "é" * 150 + " long " * 3000, "x", "s", 9, None),
           (3, "é" * 150 + " long " * 3000, "x", "s", 9, None), (5, "\ufffd kept, a b c", "x", "s", 3, "e")]


def test_awkward_tables(spark):
    """Nulls, empty and long texts, repeated rows and columns with names used inside: each stage gives whole results."""
    docs = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string, n_chars long, row string")
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SF).collect()
        ids = sorted(str(r["doc_id"]) for r in found)
        if name in ("toxicity", "mixing"):
            assert set(ids) == {"1", "2", "3", "5", "None"} and len(ids) >= 7
        elif name == "simhash":
            assert ids == ["2", "3", "5", "None"] or ids == ["1", "2", "3", "5"]
        elif name == "suffix":  # both long texts are repeats in themselves and of each other
            assert ids == ["1", "2", "2", "5", "None"] and {r["text"] for r in found} == {None, "", "one word", "\ufffd kept, a b c"}
        else:
            assert set(ids) == {"1", "2", "3", "5", "None"} and sum(r["start"] == 0 for r in found) == 7
        if name != "packing":
            assert all(set(r.asDict()) == set(corpus_pipeline.COLUMNS) for r in found)
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "suffix", "mixing", "packing"]


def test_python_gets_texts_in_small_batches(spark, monkeypatch):
    """8 MB of texts in a task: by Spark's own limits, one batch."""
    import pyarrow as pa

    def sizes(docs, field, keep):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([b.nbytes] * b.num_rows, pa.int64()), pa.array([0.0] * b.num_rows)], [*corpus_pipeline.COLUMNS, "score"])

        return docs.select(*corpus_pipeline.COLUMNS).mapInArrow(run, "doc_id long, text string, lang string, source string, n_chars long, score double")

    monkeypatch.setattr(corpus_pipeline.toxicity, "train", lambda docs, labels: None)
    monkeypatch.setattr(corpus_pipeline.toxicity, "toxicity", sizes)
    docs = spark.range(40, numPartitions=1).selectExpr("id AS doc_id", "repeat('text ', 40000) AS text", "'en' AS lang", "'x' AS source", "200000L AS n_chars")
    found = dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, SF).collect()
    assert len(found) == 40 and max(r["n_chars"] for r in found) < 4 << 20
