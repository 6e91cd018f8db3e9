"""Toxicity and language: held-out accuracy, methods against brute force, awkward rows."""

from __future__ import annotations

import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
from mosaicell.llm import langid, queries, toxicity

from tests.conftest import SF

AWKWARD = [(1, None), (2, ""), (3, " \n"), (4, "123 !?"), (5, "a"), (None, "word"), (6, "x" * 300_000), (6, "x" * 300_000), (7, "é" * 10)]


def test_marginals_by_brute_force():
    rng = np.random.default_rng(1)
    odds, a01, a10, a11 = np.exp(rng.standard_normal(7)), 0.3, 0.8, 2.5
    total, toxic = 0.0, np.zeros(7)
    step = {(0, 0): 1.0, (0, 1): a01, (1, 0): a10, (1, 1): a11}
    for states in itertools.product((0, 1), repeat=7):
        weight = np.prod([odds[t] if s else 1.0 for t, s in enumerate(states)]) * np.prod([step[p] for p in zip((0, *states), (*states, 0))])
        total += weight
        toxic += weight * np.array(states)
    padded = np.concatenate([odds, np.zeros(3)])[None]
    assert np.allclose(toxicity.chain(padded, a01, a10, a11)[2][0, :7], toxic / total)


def test_field_learns_words():
    rng = np.random.default_rng(2)
    clean = ["alpha", "beta", "gamma", "delta", "epsilon"]
    words = lambda n: [str(rng.choice(clean)) for _ in range(n)]
    texts, labels = [], []
    for k in range(200):
        w = words(40)
        if k % 4 == 0:
            w[10:12] = ["vile", "scum"]
        texts.append(" ".join(w))
        labels.append(int(k % 4 == 0))
    field = toxicity.fit(texts, labels)
    found = toxicity.marginals_of(field, [["alpha", "vile", "scum", "beta"]], {})[0]
    assert found[1] > 0.8 and found[2] > 0.8 and found[0] < 0.2 and found[3] < 0.2
    assert toxicity.spans("alpha vile scum beta", found) == [{"start": 6, "end": 15, "p": pytest.approx(float(found.max()))}]
    assert toxicity.fit(texts, [0] * 200) is None


def held_out(i: int) -> bool:
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_toxicity_query(spark):
    found = {r["doc_id"]: r for r in queries.op4_toxicity(spark, "/root/testdata/sf0.01").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r["held_out"] == held_out(i) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for i, r in found.items())
    known = [(found[i]["predicted"], t) for i, t in labels.items() if held_out(i) and i in found]
    assert sum(p == t for p, t in known) >= 0.9 * len(known)


def test_toxicity_awkward(spark):
    docs = spark.createDataFrame([(i, t, 0.5, "s") for i, t in AWKWARD], "doc_id long, text string, score double, spans string")
    field = toxicity.Field({"=word": 3.0}, -1.0, 0.5, 0.5, 2.0, (0.0, 1.0, 0.0, 0.0, 0.0))
    for f in (field, None):
        found = toxicity.toxicity(docs, f).collect()
        assert len(found) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in found)
    assert [len(r["spans"]) for r in toxicity.toxicity(docs, field, keep=("text",)).where("doc_id is null").collect()] == [1]
    assert toxicity.toxicity(docs.limit(0), field).collect() == []
    none = spark.createDataFrame([(None, 1), (1, None), (2, 5)], "doc_id long, toxic int")
    assert toxicity.train(docs, none) is None and toxicity.train(docs, none.limit(0)) is None


def test_language_query(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = queries.op6_language(spark, "/root/testdata/sf0.01").collect()
    assert len(found) == len(docs) and all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in found)
    told = [(r["lang_pred"], docs[r["doc_id"]]["lang"]) for r in found if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert sum(a == b for a, b in told) >= 0.95 * len(told)


def test_language_nearest_centroid():
    model = langid.fit(["the cat and the dog", "a dog and the bird", "le chat et le chien", "un chien et des oiseaux"], ["en", "en", "fr", "fr"], 2)
    assert model.languages == ["en", "en", "fr", "fr"]  # two centroids each
    for text in ("the bird and a cat", "le chat et un chien"):
        v = np.log1p(langid.counts(text)) * model.idf
        cosines = model.matrix @ v / np.linalg.norm(v)
        assert model.predict(text)[:2] == (model.languages[int(cosines.argmax())], pytest.approx(float(cosines.max()), abs=1e-5))
    assert not model.predict("zzqx wkjv")[2]
    assert langid.fit(["", "!!"], ["en", "fr"]) is None and langid.fit([], []) is None


def test_language_awkward(spark):
    docs = spark.createDataFrame([(i, t, "en" if i == 7 else None, 1) for i, t in AWKWARD], "doc_id long, text string, lang string, language int")
    found = langid.identify(docs, langid.train(docs)).collect()
    assert len(found) == len(AWKWARD) and {r["doc_id"]: r["language"] for r in found}[3] == "und"
    assert all(r["language"] == "und" for r in langid.identify(docs, None).collect())
    assert langid.identify(docs.limit(0), None).collect() == [] and langid.train(docs.limit(0)) is None


def test_languages_are_clustered_in_tasks_of_their_own(spark):
    """The model from Spark is that of the plain fit on the same texts, for many languages."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(900):
        language = k % 30
        words = ["".join(chr(97 + (c + 3 * language) % 26) for c in rng.integers(0, 6, 4)) for _ in range(20)]
        rows.append((k, " ".join(words) if k % 97 else "!!", f"l{language:02d}" if k % 31 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = langid.train(docs)
    known = sorted((lang, k, text) for k, text, lang in rows if lang and zlib.crc32(str(k).encode()) % 3 != 1)
    plain = langid.fit([text for _, _, text in known], [lang for lang, _, _ in known])
    assert model.languages == plain.languages and len(set(model.languages)) == 30
    assert np.array_equal(model.idf, plain.idf) and np.allclose(model.matrix, plain.matrix, atol=1e-6) and np.allclose(model.least, plain.least, atol=1e-6)


def test_smallest_tables(spark):
    assert queries.op4_toxicity(spark, SF).count() == queries.op6_language(spark, SF).count() > 0


def test_counts_and_fit_by_hand():
    """N-grams, their weights and centroids as a plain program finds them."""
    texts = ["Hund, bellt!", "die Hunde", "dog & barks", "a dog"]
    languages = ["de", "de", "en", "en"]

    def grams(text: str) -> Counter:
        words = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
        raw = f" {words} ".encode()
        return Counter(raw[i : i + n] for n in (2, 3, 4) for i in range(len(raw) - n + 1))

    own = [grams(t) for t in texts]
    for text, found in zip(texts, own):
        assert sorted(x for x in langid.counts(text).tolist() if x) == sorted(found.values())  # no two n-grams here share a bucket
    df = Counter(g for found in own for g in found)
    weight = lambda found: {g: np.log1p(n) * (np.log(5 / (1 + df[g])) + 1) for g, n in found.items() if g in df}
    unit = lambda v: {g: x / np.sqrt(sum(y * y for y in v.values())) for g, x in v.items()}
    vectors, centres = [unit(weight(f)) for f in own], {}
    for language in ("de", "en"):
        total = Counter()
        for v, of in zip(vectors, languages):
            total.update(v if of == language else {})
        centres[language] = unit(total)
    model = langid.fit(texts, languages, 1)
    apart = lambda text: np.count_nonzero(sum(langid.counts(t) for t in [*texts, text])) == len(df.keys() | grams(text).keys())
    asked = [t for t in ("Hund", "dog a", "Hund dog", "barks", "die dog", "bellt dog", "a hund") if apart(t)]  # no bucket shared
    assert len(asked) >= 3
    for text in asked:
        unknown = {g: np.log1p(n) * (np.log(5 / (1 + df[g])) + 1) for g, n in grams(text).items()}
        cosine = {c: sum(x * centres[c].get(g, 0.0) for g, x in unit(unknown).items()) for c in centres}
        best = max(cosine, key=cosine.get)
        assert model.predict(text)[:2] == (best, pytest.approx(cosine[best], abs=1e-5))


def test_score_by_brute_force(spark):
    """A document's score from marginals that are summed over all taggings."""
    field = toxicity.Field({"=vile": 3.0, "=scum": 2.0, "4alph": -0.5}, -1.5, 0.4, 0.7, 2.0, (-1.0, 0.8, 0.6, 0.4, 0.2))
    text = "Alpha vile, beta scum! alpha vile"
    words = text.split()
    odds = [np.exp(-1.5 + {"vile": 3.0, "scum": 2.0, "alpha": -0.5}.get(w.lower().strip(",!"), 0.0)) for w in words]
    step, total, toxic = {(0, 0): 1.0, (0, 1): 0.4, (1, 0): 0.7, (1, 1): 2.0}, 0.0, np.zeros(6)
    for states in itertools.product((0, 1), repeat=6):
        w = np.prod([odds[t] if s else 1.0 for t, s in enumerate(states)]) * np.prod([step[p] for p in zip((0, *states), (*states, 0))])
        total, toxic = total + w, toxic + w * np.array(states)
    p = toxic / total
    kinds: dict = {}
    for w, x in zip(words, p):
        name = w.lower().strip(",!")
        kinds[name] = max(kinds.get(name, 0.0), x if x > 0.05 else 0.0)
    values = (1.0, np.log(p.max() / (1 - p.max())), np.log1p(p.sum()), np.log1p(sum(kinds.values())), np.log(1e-3 + p.sum() / 6))
    want = 1 / (1 + np.exp(-sum(b * x for b, x in zip(field.curve, values))))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert toxicity.toxicity(docs, field).first()["score"] == pytest.approx(want)


def test_samples_with_an_id_repeated_often(spark):
    """An id with 2000 rows is one document of the sample: it neither crowds out others nor counts more."""
    many = [(7, f"the cat and {k}", "en", 0) for k in range(2000)]
    rows = many + [(100 + k, f"a dog and the bird {k} vile scum" if k % 3 == 0 else f"le chat et un chien {k}", "en" if k % 3 == 0 else "fr", int(k % 3 == 0)) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    from mosaicell.llm.common import bounded_sample

    known = docs.selectExpr("doc_id as id", "lang").distinct()
    some = bounded_sample(known, "lang", 300).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in some} == {"en": 300, "fr": 300}
    assert set(langid.train(docs, per_language=300).languages) == {"en", "fr"}
    assert toxicity.train(docs, docs, per_class=300) is not None


def test_language_learns_from_long_texts(spark):
    """A text of any length neither drops a language nor the documents beside it."""
    words = {"en": "the cat and the dog with a bird", "fr": "le chat et un chien des oiseaux"}
    rows = [(k, words[lang] + f" {'ab'[k % 2]} " + words[lang], lang) for k, lang in enumerate(["en", "fr"] * 40)]
    rows += [(1000 + k, f"{words['fr']} " * 70_000 + str(k), "fr") for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.where("lang = 'en' or doc_id >= 1000"))
    assert set(model.languages) == {"en", "fr"}
    assert model.predict("un chat et des chiens")[0] == "fr" and model.predict("a dog and the cats")[0] == "en"


def test_toxicity_learns_from_long_texts(spark):
    """Texts of any length leave both classes, and segments come from all of a clean text."""
    rng = np.random.default_rng(3)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"], n))
    rows = [(k, f"{words(30)} vile scum {words(5)}" if k % 2 else words(40), k % 2) for k in range(300)]
    rows += [(1000 + k, f"{words(1000)} " * 1500, 0) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").coalesce(4)
    only_long = docs.where("toxic = 1 or doc_id >= 1000")
    assert toxicity.train(only_long, only_long) is not None
    field = toxicity.train(docs, docs)
    found = toxicity.marginals_of(field, [["alpha", "vile", "scum", "beta"]], {})[0]
    assert found[1] > 0.8 and found[2] > 0.8 and found[0] < 0.2 and found[3] < 0.2
    drawn = [x for k in range(50) for x in toxicity.segments_of(k, ["head"] * 128 + ["body"] * 1280, 0, set())]
    chosen = sorted(drawn)[:500]
    assert sum("body" in x[1] for x in chosen) > 400
