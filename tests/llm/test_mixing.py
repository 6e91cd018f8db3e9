"""Mixing against the optimum that numpy finds, and targets that are met."""

from __future__ import annotations

import numpy as np
import pytest
from mosaicell.llm import mixing, queries
from pyspark.sql import functions as F

from tests.conftest import SF


def optimum(p: np.ndarray, tokens: np.ndarray, target: np.ndarray, least: float, most: float) -> np.ndarray:
    """Expected totals of the optimum, by plain projected gradient in many small rounds."""
    start = min(most, max(least, target.sum() / tokens.sum()))
    r, weight = np.full(len(p), start), 1 / target
    gram = (p * tokens[:, None]).T @ p
    step = 1 / np.linalg.eigvalsh(np.sqrt(weight)[:, None] * gram * np.sqrt(weight)).max()
    for _ in range(20_000):
        r = np.clip(r - step * p @ (weight * (p.T @ (tokens * r) - target)), least, most)
    return p.T @ (tokens * r)


@pytest.mark.parametrize("target,least,most,rounds", [
    ([900.0, 300.0, 50.0], 0.0, 1e6, mixing.ROUNDS),
    ([900.0, 60.0, 30.0], 0.0, 1e6, 400),  # out of reach: slow
    ([3000.0, 3000.0, 400.0], 1.0, 4.0, mixing.ROUNDS)])
def test_rates_reach_the_optimum(spark, target, least, most, rounds):
    rng = np.random.default_rng(1)
    p, tokens = rng.dirichlet([0.4, 0.4, 0.1], 200), rng.integers(0, 30, 200)
    members = spark.createDataFrame([(x.tolist(), int(t)) for x, t in zip(p, tokens)], "p array<double>, tokens long")
    descent, expected = mixing.rates(members.coalesce(1), target, least, most, rounds)
    r = descent.replay(p)[0]
    assert (r >= least).all() and (r <= most).all()
    got, want, goal = p.T @ (tokens * r), optimum(p, tokens, np.array(target), least, most), np.array(target)
    assert np.allclose(got, expected)
    loss = lambda s: ((s - goal) ** 2 / goal).sum()
    assert loss(got) <= 1.02 * loss(want) + 1e-8 * goal.sum()


def words(rng, kind: str, n: int) -> str:
    own = {"a": ["sun", "sea", "sand"], "b": ["ice", "snow", "frost"]}[kind]
    return " ".join(rng.choice([*own, "the", "of"]) for _ in range(n))


def test_mix_meets_shares(spark):
    rng = np.random.default_rng(2)
    kinds = [rng.choice(["a", "b"], p=[0.8, 0.2]) for _ in range(300)]
    rows = [(k, words(rng, kind, int(rng.integers(5, 60))), kind, 0.5) for k, kind in enumerate(kinds)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, rate double")
    found = mixing.mix(docs, docs.where("doc_id < 150").withColumnRenamed("kind", "domain"), {"a": 1.0, "b": 1.0}, 0.6, keep=("kind",))
    assert found.columns == ["doc_id", "kind", "tokens", "posterior", "rate", "copies"] and found.count() == 300
    right = found.where(F.expr("if(posterior[0] >= 0.5, 'a', 'b')") == F.col("kind")).count()
    assert right >= 290
    total = found.agg(*(F.sum(F.expr(f"tokens * rate * posterior[{k}]")) for k in (0, 1)), F.sum("tokens"), F.sum(F.expr("tokens * copies"))).first()
    assert abs(total[0] / total[2] - 0.3) < 0.003 and abs(total[1] / total[2] - 0.3) < 0.003 and abs(total[3] / total[2] - 0.6) < 0.1


def test_budget_follows_from_totals(spark, caplog):
    """With rates of 1 at least, the budget is as small as the shares allow, and they are met."""
    rng = np.random.default_rng(4)
    rows = [(k, words(rng, "a" if k % 5 else "b", int(rng.integers(5, 60)))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = docs.select("doc_id", F.expr("if(doc_id % 5 > 0, 'a', 'b')").alias("domain"))
    with caplog.at_level("INFO", logger="mosaicell.llm.mixing"):
        found = mixing.mix(docs, labelled, {"a": 0.6, "b": 0.4}, None, 1.0, 8.0).collect()
    assert [r.levelname for r in caplog.records if r.getMessage().startswith("mix ")] == ["INFO", "INFO"]
    assert all(1 <= r["rate"] <= 8 and r["copies"] >= 1 for r in found)
    total = sum(r["tokens"] * r["rate"] for r in found)
    assert abs(sum(r["tokens"] * r["rate"] * r["posterior"][0] for r in found) / total - 0.6) < 0.01
    there = sum(r["tokens"] for r in found)
    least = sum(r["tokens"] * r["posterior"][0] for r in found) / 0.6
    assert least <= total * 1.001 and total <= 1.25 * least and total > there


def test_domain_without_documents(spark, caplog):
    docs = spark.createDataFrame([(k, "sun sea sand" if k < 60 else "ice snow frost") for k in range(100)], "doc_id long, text string")
    labelled = docs.select("doc_id", F.expr("if(doc_id < 60, 'a', 'b')").alias("domain"))
    found = mixing.mix(docs, labelled, {"a": 0.4, "b": 0.4, "c": 0.2}, 0.5).agg(*(F.sum(F.expr(f"tokens * rate * posterior[{k}]")) for k in range(3)), F.sum("tokens")).first()
    assert found[0] == pytest.approx(0.25 * found[3], rel=0.01) and found[1] == pytest.approx(0.25 * found[3], rel=0.01) and found[2] == 0
    assert any("no document" in r.getMessage() for r in caplog.records)


def test_awkward_tables(spark):
    docs = spark.createDataFrame([(1, None), (None, "a b"), (2, ""), (2, "c"), (2, "c"), (3, "d " * 5000)], "doc_id long, text string")
    none = spark.createDataFrame([(None, "a"), (1, None), (2, "z"), (3, "a"), (3, "b")], "doc_id long, domain string")
    for labelled in (none, none.limit(0), spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, domain string")):
        found = mixing.mix(docs, labelled, {"a": 1.0, "b": 0.0})
        assert found.count() == 6 and found.where("rate is null or isnan(rate) or copies is null").count() == 0
    assert mixing.mix(docs.limit(0), none, {"a": 1.0, "b": 2.0}).collect() == []
    assert sorted(r["tokens"] for r in found.collect()) == [0, 0, 1, 1, 2, 5000]


def test_label_domains(spark):
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (3, 0, 0), (4, None, 0), (5, None, 1), (6, 1, None)], "doc_id long, quality int, toxic int")
    assert [r["domain"] for r in mixing.label_domains(labels).orderBy("doc_id").collect()] == ["toxic", "fine", "plain", None, "toxic", None]


def test_query(spark):
    found = queries.op10_mixing(spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert found.count() == n
    s = found.agg(F.sum("tokens"), *(F.sum(F.expr(f"tokens * rate * p_{d}")) for d in queries.MIX)).first()
    for got, share in zip(s[1:], queries.MIX.values()):
        assert abs(got - share * queries.MIX_BUDGET * s[0]) <= 0.02 * queries.MIX_BUDGET * s[0]


def test_missed_targets_are_reported(spark, caplog):
    docs = spark.createDataFrame([(k, "sun sea sand" if k < 90 else "ice snow frost") for k in range(100)], "doc_id long, text string")
    labelled = docs.select("doc_id", F.expr("if(doc_id < 90, 'a', 'b')").alias("domain"))
    with caplog.at_level("INFO", logger="mosaicell.llm.mixing"):
        mixing.mix(docs, labelled, {"a": 0.5, "b": 0.5}, 1.25, 1.0, 2.0)
    said = [r for r in caplog.records if r.getMessage().startswith("mix ")]
    assert len(said) == 2 and all(r.levelname == "WARNING" and "target 0.5000" in r.getMessage() for r in said)
    caplog.clear()
    with caplog.at_level("INFO", logger="mosaicell.llm.mixing"):
        mixing.mix(docs, labelled, {"a": 0.5, "b": 0.5}, 0.5)
    assert [r.levelname for r in caplog.records if r.getMessage().startswith("mix ")] == ["INFO", "INFO"]
