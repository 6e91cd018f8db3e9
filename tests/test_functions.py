"""Hand-checked values and properties of the m/z functions, survival functions and the catalogue."""

from __future__ import annotations

import math

import numpy as np
import pytest
from mosaicell.functions import mz, survival
from mosaicell.functions.quantiles import grouped_quantiles
from mosaicell.functions.tables import Scratch, dense
from mosaicell.operators import annotate
from mosaicell.sources import catalogue
from pyspark.sql import functions as F


def test_axes(spark):
    assert mz.axis_size(350, 1100, 0.1) == 7501 and mz.axis_size(600, 1100, 0.1) == 5001
    assert np.allclose(mz.adaptive_edges(100, 103, resolving_power=100), [100, 101, 102, 103])
    assert np.allclose(mz.adaptive_edges(100, 103, resolving_power=200), [100, 100.5, 101.0025, 101.5075125, 102.01505006, 102.52512531, 103.03775094])
    for bad in (dict(resolving_power=1, ppm=1), {}):
        with pytest.raises(ValueError):
            mz.adaptive_edges(1, 2, **bad)
    with pytest.raises(ValueError):
        mz.axis_size(2, 1, 0.1)


def test_bins_like_numpy(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.uniform(349, 552, 5000), 350 + 0.1 * np.arange(300)])
    peaks = spark.createDataFrame([(float(v),) for v in values], "mz double")
    fixed = {r["mz"]: r["bin"] for r in mz.bin_fixed(peaks, 350, 550, 0.1).collect()}
    want = np.floor((values.astype(np.float32) - np.float32(350)) / np.float32(0.1)).astype(int)
    assert fixed == {v: b for v, b in zip(values.tolist(), want.tolist()) if 0 <= b < mz.axis_size(350, 550, 0.1)}
    edges = mz.adaptive_edges(350, 550, resolving_power=2000)
    found = {r["mz"]: r["bin"] for r in mz.bin_adaptive(peaks, edges).collect()}
    place = np.searchsorted(edges, values, "right") - 1
    assert found == {v: b for v, b in zip(values.tolist(), place.tolist()) if 0 <= b < len(edges) - 1}


def test_normalisations(spark):
    rows = [(1, [1.0, 2.0], [1.0, 3.0]), (2, [1.0, 2.0], [0.0, 0.0]), (3, [1.0, 2.0, 3.0, 4.0], [0.0, 2.0, 4.0, 6.0])]
    df = spark.createDataFrame(rows, "spectrum_id long, mz array<double>, intensity array<double>")
    of = lambda m: {r["spectrum_id"]: r["intensity"] for r in mz.normalized(df, m).collect()}
    assert of("TIC")[1] == [0.25, 0.75] and of("tic")[2] == [0.0, 0.0]
    assert np.allclose(of("RMS")[1], np.array([1, 3]) / math.sqrt(5)) and of("median")[3] == [0.0, 0.5, 1.0, 1.5] and of("median")[2] == [0.0, 0.0]
    assert of("none")[1] == [1.0, 3.0]
    with pytest.raises(ValueError):
        mz.normalized(df, "other")


def test_survival():
    assert survival.chi2_survival(3.857143, 1) == pytest.approx(0.049535, abs=1e-6)
    assert survival.chi2_survival(3.579596, 4) == pytest.approx(0.465879, abs=1e-6)
    assert survival.chi2_survival(200, 4) == pytest.approx(math.exp(-100) * 101, rel=1e-12) and survival.chi2_survival(0, 3) == 1
    x = np.linspace(0, 60, 600_001)
    for df in (1, 3, 4, 7):
        density = x ** (df / 2 - 1) * np.exp(-x / 2) / (2 ** (df / 2) * math.gamma(df / 2)) if df > 2 else None
        if density is not None:
            assert survival.chi2_survival(5.0, df) == pytest.approx(density[x >= 5].sum() * 1e-4, abs=2e-4)
    assert survival.f_survival(13.5, 1, 4) == pytest.approx(0.021312, abs=1e-6)
    assert survival.f_survival(1.0, 5, 5) == pytest.approx(0.5) and survival.f_survival(math.inf, 2, 3) == 0


def test_catalogue(spark):
    assert (len(catalogue.compound_rows()), len(catalogue.adduct_rows()), len(catalogue.pathway_rows())) == (56, 17, 13)
    compounds, adducts = catalogue.compounds(spark), catalogue.adducts(spark)
    assert [annotate.annotation_index(compounds, adducts, m).count() for m in ("pos", "neg", "both")] == [430, 364, 952]
    with pytest.raises(ValueError):
        annotate.annotation_index(compounds, adducts, "up")
    double = annotate.annotation_index(compounds, adducts, "pos", charge_aware=True).where("adduct = '[M+2H]2+' and name = 'PC(34:1)'").first()
    assert double["obs_mz"] == pytest.approx(759.5778 / 2 + 1.007276)
    counts = {r["f"]: (dict(r["atoms"]), r["dbe"]) for r in mz.formula_counts(spark.createDataFrame([("C24H50NO7P",), ("CH3CH2OH",), ("",), (None,)], "f string"), "f").withColumn("dbe", mz.dbe()).collect()}
    assert counts["C24H50NO7P"] == ({"C": 24, "H": 50, "N": 1, "O": 7, "P": 1}, 0.5)
    assert counts["CH3CH2OH"][0] == {"C": 2, "H": 6, "O": 1} and counts[""] == ({}, None) and counts[None] == ({}, None)


def test_annotator(spark):
    a = annotate.Annotator(spark, "pos")
    hit = a.peak(760.5851).orderBy("rank").first()
    assert (hit["name"], hit["adduct"]) == ("PC(34:1)", "[M+H]+") and hit["ppm_error"] == pytest.approx(0.0316, abs=1e-4) and hit["confidence_score"] == pytest.approx(0.969368, abs=1e-4)
    assert a.search("ceramide").count() == 0 and a.search("cer(").count() == 20
    twice = spark.createDataFrame([(1, 760.5851, 5.0), (2, 760.5851, 9.0), (3, -1.0, 1.0), (4, None, 1.0), (5, 100.0, 0.5)], "query_id long, mz double, intensity double")
    assert {r["query_id"] for r in a.peaks(twice).collect()} == {1, 2}
    assert a.peaks(twice, intensity_percentile=50).select("query_id").distinct().count() == 2


def test_buckets_equal_nested_loops(spark):
    rng = np.random.default_rng(3)
    masses, asked = rng.uniform(100, 900, 400), []
    for m in masses[:200]:
        asked += [m * (1 + e * 1e-6) for e in (-5.001, -4.999, 0, 4.999, 5.001)]
    index = spark.createDataFrame([(k, float(m)) for k, m in enumerate(masses)], "seq int, obs_mz double")
    queries = spark.createDataFrame([(k, float(m)) for k, m in enumerate(asked)], "query_id long, mz double")
    got = {(r["query_id"], r["seq"]) for r in annotate.ppm_matches(queries, index, 5.0).collect()}
    assert got == {(q, s) for q, a in enumerate(asked) for s, m in enumerate(masses) if abs(a - m) / m * 1e6 <= 5.0}


def test_stat_values(spark):
    from mosaicell.operators import stats

    rows = spark.createDataFrame([(0, c, float(v)) for c, vs in enumerate(([1, 2, 3], [4, 5, 6])) for v in vs] + [(1, c, 7.0) for c in (0, 0, 1)], "bin int, class int, value double")
    counts = stats.value_counts(rows)
    k, a = ({r["bin"]: (r["stat"], r["pval"]) for r in f(counts).collect()} for f in (stats.kruskal, stats.anova))
    assert k[0] == (pytest.approx(3.857143, abs=1e-6), pytest.approx(0.049535, abs=1e-6)) and k[1] == (0.0, 1.0)
    assert a[0][0] == pytest.approx(13.5) and a[1] == (0.0, 1.0)
    tests = spark.createDataFrame(list(enumerate([0.01, 0.04, 0.03, 0.005])), "bin int, pval double")
    assert [round(r["pval_adj"], 6) for r in stats.bh_fdr(tests).orderBy("bin").collect()] == [0.02, 0.04, 0.04, 0.02]
    with pytest.raises(ValueError):
        stats.differential(rows.where("class = 0"), spark.range(1).select(F.col("id").cast("int").alias("bin"), F.lit(1.0).alias("mz")))


@pytest.mark.parametrize("seed", range(3))
def test_sparse_equals_dense(spark, seed):
    from mosaicell.operators import stats

    rng = np.random.default_rng(seed)
    dense = [(b, int(c), float(v)) for b in range(4) for c, v in zip(rng.integers(0, 3, 40), rng.integers(0, 5, 40) * (rng.random(40) < 0.4))]
    rows = spark.createDataFrame([(b, c if b == 0 else dense[k % 40][1], v) for k, (b, c, v) in enumerate(dense)], "bin int, class int, value double")
    sizes = rows.where("bin = 0").groupBy("class").agg(F.count("*").alias("cells"))
    full = {r["bin"]: round(r["h"], 9) for r in stats.kruskal_h(stats.value_counts(rows)).collect()}
    sparse = {r["bin"]: round(r["h"], 9) for r in stats.kruskal_h(stats.value_counts(rows.where("value > 0"), sizes)).collect()}
    assert sparse == full
    fold = lambda *a: {r["bin"]: (round(r["fold_change"], 9), r["best_clone"]) for r in stats.fold_change(*a).collect()}
    assert fold(rows.where("value > 0"), sizes) == fold(rows)


@pytest.mark.parametrize("few,buckets", [(10, 4), (50, 1024), (1 << 20, 8)])
def test_grouped_quantiles(spark, few, buckets):
    rng = np.random.default_rng(few)
    groups = {("a", 1): rng.normal(size=700), ("a", 2): rng.integers(0, 4, 300) / 3, ("b", None): np.full(90, 2.5), (None, 1): np.array([1e300, -1e300, 3.0, 1e-300] * 9), ("c", 1): np.array([4.0]), ("d", 4): rng.exponential(size=11) * 1e9}
    rows = [(k, i, float(v), "x") for (k, i), vs in groups.items() for v in vs] + [("a", 1, None, "x"), ("a", 1, float("nan"), "x"), ("none", 1, None, "x")]
    shares = (0.0, 0.1, 0.25, 0.5, 0.77, 1.0)
    found = {(r["k"], r["i"]): (r["n"], r["q"]) for r in grouped_quantiles(spark.createDataFrame(rows, "k string, i int, value double, n string"), ["k", "i"], "value", shares, few, buckets).collect()}
    assert set(found) == set(groups)
    for g, vs in groups.items():
        assert found[g][0] == len(vs)
        np.testing.assert_allclose(found[g][1], np.quantile(vs, shares), rtol=1e-12, atol=1e-12)
    assert grouped_quantiles(spark.createDataFrame([], "k string, value double"), ["k"], "value", (0.5,)).collect() == []


def test_dense_arrays(spark):
    rows = [([(3, 1.5), (0, 2.0), (9, 4.0)],), ([],), ([(5, 7.0), (12, 1.0), (-1, 1.0)],), ([(k, float(k)) for k in range(10)],)]
    df = spark.createDataFrame(rows, "e array<struct<bin:int,value:double>>")
    assert [r[0] for r in df.select(dense(F.col("e"), F.lit(10), "bin", "value")).collect()] == [[dict(e).get(k, 0.0) for k in range(10)] for (e,) in rows]


def test_index_parses_a_formula_once_for_a_compound(spark):
    rows = [(k, f, 300.0 + k, "both") for k, f in enumerate(("C6H12O6", "CH3CH2Cl", "NaCl", "C2H5NO2CH3", "", None, "Cer", "h2"))]
    compounds = spark.createDataFrame(rows, "seq int, formula string, neutral_mass double, mode string")
    index = annotate.annotation_index(compounds, catalogue.adducts(spark), "neg")
    plan = index._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda word: next(k for k, line in enumerate(plan) if word in line)
    assert depth("Join") < depth("regexp_extract_all") < depth("RepartitionByExpression")
    want = {r["seq"]: r["dbe"] for r in mz.formula_counts(compounds).select("seq", mz.dbe().alias("dbe")).collect()}
    assert {r["seq"]: r["dbe"] for r in index.select("seq", "dbe").collect()} == want


def test_hits_are_ranked_once_for_each_mz(spark):
    index = annotate.annotation_index(catalogue.compounds(spark), catalogue.adducts(spark), "neg")
    masses = [r["obs_mz"] for r in index.select("obs_mz").distinct().collect()][:3] + [0.5]
    queries = spark.createDataFrame([(k, masses[k % 4]) for k in range(40)] + [(99, None)], "query_id long, mz double")
    found = annotate.annotate_peaks(queries, index, 5.0, 2)
    assert "windowspecdefinition(mz" in found._jdf.queryExecution().optimizedPlan().toString()
    each = {}
    for r in found.collect():
        each.setdefault(r["query_id"], set()).add((r["mz_query"], r["seq"], r["adduct_seq"], r["rank"], r["ppm_error"]))
    assert set(each) == {k for k in range(40) if k % 4 < 3}
    assert all(each[k] == each[k % 4] for k in each)


def test_small_files_of_many_rows_are_not_broadcast(spark):
    conf, scratch = "spark.sql.autoBroadcastJoinThreshold", Scratch()
    threshold = spark.conf.get(conf)
    many = scratch.written(spark.range(0, 2_000_000, 1, 4).select(F.floor(F.col("id") / 1000).alias("k"), F.lit("fx").alias("image_id")), "many")
    few = scratch.written(spark.range(2000).select(F.col("id").alias("k")), "few")
    kinds = []
    for right in (many, few):
        joined = many.join(right.select("k"), "k", "left_semi")
        store = spark._jsparkSession.sharedState().statusStore()
        scratch.written(joined, "joined")
        nodes = store.planGraph(store.executionsCount() - 1).allNodes()
        kinds.append({nodes.apply(k).name() for k in range(nodes.size())})
    assert not any("Broadcast" in name for name in kinds[0])
    assert any("Broadcast" in name for name in kinds[1])  # few rows: when they have been counted
    assert spark.conf.get(conf) == threshold
    scratch.clear()
