"""Queries over the catalogue of compounds and the ions of cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import mz
from ..operators import annotate
from ..sources import catalogue, fixtures
from . import cell_queries as cq
from . import image_queries as iq
from .registry import query


def _values(rows) -> str:
    text = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else repr(v)
    return ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)


COMPOUNDS = f"compounds(seq, name, formula, neutral_mass, class, subclass, hmdb, lipidmaps, mode) AS (VALUES {_values(catalogue.compound_rows())})"
ADDUCTS = f"adducts(adduct_seq, adduct, charge, mult, delta) AS (VALUES {_values(catalogue.adduct_rows())})"
PATHWAYS = f"pathways(subclass, pathways) AS (VALUES {_values((s, '; '.join(p)) for s, p in catalogue.pathway_rows())})"
ATOMS = COMPOUNDS + r""", parts AS (SELECT seq, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)(\d*)', 1)) AS element, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)(\d*)', 2)) AS n FROM compounds),
  atoms AS (SELECT seq, element, sum(CASE WHEN n = '' THEN 1 ELSE n::BIGINT END)::BIGINT AS n FROM parts GROUP BY seq, element),
  dbe AS (SELECT seq, 1.0 + coalesce(sum(n) FILTER (element = 'C'), 0) - coalesce(sum(n) FILTER (element = 'H'), 0) / 2 + coalesce(sum(n) FILTER (element = 'N'), 0) / 2 AS dbe FROM atoms GROUP BY seq)"""
INDEX = ATOMS + ", " + ADDUCTS + """, idx AS (SELECT c.*, a.*, neutral_mass + delta AS obs_mz, dbe FROM compounds c JOIN dbe USING (seq) CROSS JOIN adducts a WHERE mode IN ('both', 'neg') AND charge < 0 AND neutral_mass + delta > 0)"""
HITS = """hits AS (SELECT *, round(abs(q.mz - obs_mz) / obs_mz * 1e6, 4) AS ppm_error FROM q JOIN idx ON abs(q.mz - obs_mz) / obs_mz * 1e6 <= {ppm}),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ppm_error, seq, adduct_seq) AS rank FROM hits)"""
#: Compounds from part instead of the catalogue, each peak of lineitem as a query; hits are looked for once for each m/z.
PARTS = f"""compounds(seq, name, formula, neutral_mass, class, subclass, mode) AS (SELECT p_partkey, p_name,
    'C' || p_size || 'H' || (p_partkey % 97 + 2) || CASE WHEN p_partkey % 3 = 0 THEN 'N' || (p_partkey % 5 + 1) ELSE '' END || 'O' || CASE WHEN p_partkey % 4 = 0 THEN 'CH3' ELSE '2P' END,
    351.057276::DOUBLE + 0.1::DOUBLE * (p_partkey % 2000) + 0.0007::DOUBLE * (p_partkey % 7 - 3), p_brand, {list(fixtures.SUBCLASSES)}[p_partkey % {len(fixtures.SUBCLASSES)} + 1], ['both', 'neg', 'pos'][p_partkey % 3 + 1] FROM part)"""
PART_ATOMS, PART_INDEX = (text.replace(COMPOUNDS, PARTS) for text in (ATOMS, INDEX))
PART_HITS = """w AS (SELECT DISTINCT mz FROM q), near AS (SELECT *, round(abs(w.mz - obs_mz) / obs_mz * 1e6, 4) AS ppm_error FROM w JOIN idx ON abs(w.mz - obs_mz) / obs_mz * 1e6 <= {ppm} AND (dbe IS NULL OR dbe >= -0.5)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY mz ORDER BY ppm_error, seq, adduct_seq) AS rank FROM near)"""


def index(spark, mode: str = "neg"):
    return annotate.annotation_index(catalogue.compounds(spark), catalogue.adducts(spark), mode)


def part_index(spark, sf_dir, mode: str = "neg"):
    return annotate.annotation_index(fixtures.compounds(spark, sf_dir), catalogue.adducts(spark), mode)


@query("annotation_index", f"WITH {PART_INDEX} SELECT name, adduct, round(obs_mz, 6) AS obs_mz, round(dbe, 6) AS dbe, subclass, seq::BIGINT AS seq, adduct_seq::BIGINT AS adduct_seq FROM idx")
def annotation_index(spark, sf_dir):
    return part_index(spark, sf_dir).select("name", "adduct", "obs_mz", "dbe", "subclass", "seq", "adduct_seq")


@query("parse_formula", f"WITH {PART_ATOMS} SELECT seq::BIGINT AS seq, element, n FROM atoms")
def parse_formula(spark, sf_dir):
    return mz.formula_counts(fixtures.compounds(spark, sf_dir)).select("seq", F.explode("atoms").alias("element", "n"))


@query("dbe", f"WITH {PART_ATOMS} SELECT seq::BIGINT AS seq, name, round(dbe, 6) AS dbe FROM dbe JOIN compounds USING (seq)")
def dbe(spark, sf_dir):
    return mz.formula_counts(fixtures.compounds(spark, sf_dir)).select("seq", "name", mz.dbe().alias("dbe"))


@query("dbe_filter", f"WITH {PART_INDEX} SELECT name, adduct, seq::BIGINT AS seq FROM idx WHERE dbe >= 3")
def dbe_filter(spark, sf_dir):
    return annotate.dbe_filter(part_index(spark, sf_dir), 3.0).select("name", "adduct", "seq")


@query("catalogue_search", f"WITH {PART_INDEX} SELECT name, adduct, seq::BIGINT AS seq FROM (SELECT * FROM idx WHERE contains(lower(name), 'pc') OR contains(lower(class), 'pc') OR contains(lower(subclass), 'pc') ORDER BY seq, adduct_seq LIMIT 20)")
def catalogue_search(spark, sf_dir):
    """The first twenty hits: the limit is the feature."""
    return annotate.search(part_index(spark, sf_dir), "PC").select("name", "adduct", "seq")


@query("annotate_peak", f"WITH {PART_INDEX}, {iq.PEAKS}, q AS (SELECT mz FROM peaks GROUP BY mz ORDER BY sum(intensity) DESC, mz LIMIT 1), {PART_HITS.format(ppm=400)} SELECT round(mz, 6) AS mz_query, name, adduct, ppm_error, rank FROM ranked")
def annotate_peak(spark, sf_dir):
    """All names for the strongest m/z of all spectra, within a wide tolerance."""
    top = fixtures.peaks(spark, sf_dir).groupBy("mz").agg(F.sum("intensity").alias("s")).orderBy(F.desc("s"), "mz").first()["mz"]
    return annotate.Annotator(spark, "neg", 400.0, compounds=fixtures.compounds(spark, sf_dir)).peak(top).select("mz_query", "name", "adduct", "ppm_error", "rank")


@query("annotate_peak_list", f"WITH {PART_INDEX}, {PATHWAYS}, {iq.PEAKS}, q AS (SELECT spectrum_id, mz, intensity FROM peaks), {PART_HITS.format(ppm=5)} SELECT spectrum_id, round(mz, 6) AS mz_query, intensity, name, adduct, ppm_error, rank, round(1 / (1 + ppm_error), 6) AS confidence_score, coalesce(p.pathways, '') AS pathways FROM q JOIN ranked USING (mz) LEFT JOIN pathways p USING (subclass) WHERE rank <= 3")
def annotate_peak_list(spark, sf_dir):
    """Names, confidence and pathways for every peak."""
    queries = fixtures.peaks(spark, sf_dir).select("spectrum_id", "mz", "intensity").withColumn("query_id", F.monotonically_increasing_id())
    found = annotate.annotate_peaks(queries, part_index(spark, sf_dir), 5.0, 3, pathways=catalogue.pathways(spark))
    return found.select("spectrum_id", "mz_query", "intensity", "name", "adduct", "ppm_error", "rank", "confidence_score", "pathways")


@query("ppm_filter", f"WITH {PART_INDEX}, {iq.PEAKS}, q AS (SELECT mz FROM peaks), {PART_HITS.format(ppm=5)} SELECT round(mz, 6) AS mz, name, adduct, ppm_error FROM near WHERE ppm_error <= 2.5")
def ppm_filter(spark, sf_dir):
    """Of the hits within 5 ppm of any m/z, those within 2.5."""
    queries = fixtures.peaks(spark, sf_dir).select("mz").distinct()
    return annotate.ppm_matches(queries, annotate.dbe_filter(part_index(spark, sf_dir)), 5.0).where("ppm_error <= 2.5").select("mz", "name", "adduct", "ppm_error")


@query("peak_intensity_filter", f"WITH {iq.PEAKS} SELECT spectrum_id, round(mz, 6) AS mz, intensity FROM peaks WHERE intensity > (SELECT quantile_cont(intensity, 0.9) FROM peaks WHERE intensity > 0)")
def peak_intensity_filter(spark, sf_dir):
    return annotate.intense_peaks(fixtures.peaks(spark, sf_dir), 90.0).select("spectrum_id", "mz", "intensity")


MEANS = cq.LONG + """, t AS (SELECT bin, class, sum(value) AS s, count(*) AS n FROM long GROUP BY bin, class), means AS (SELECT bin, class, s / n AS mean, (sum(s) OVER w - s) / (sum(n) OVER w - n) AS rest FROM t WINDOW w AS (PARTITION BY bin)),
  tops AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY abs(log2((mean + 1e-9) / (rest + 1e-9))) DESC, bin) AS rank, log2((mean + 1e-9) / (rest + 1e-9)) AS log2_fc FROM means)"""


@query("clone_top_ions", f"WITH {MEANS}, {cq.AXIS} SELECT class, bin, round(mz, 6) AS mz, round(log2_fc, 6) AS log2_fc, rank FROM tops JOIN axis USING (bin) WHERE rank <= 10")
def clone_top_ions(spark, sf_dir):
    return annotate.clone_top_ions(annotate.clone_means(cq.dense(spark, sf_dir)), cq.axis(spark), 10)


def _clone_hits(spark, sf_dir):
    """Ions of an axis that starts where the catalogue has masses, with a wide tolerance."""
    axis = mz.fixed_axis(spark, 255.0, 286.5, 0.5)
    return annotate.annotate_clones(cq.dense(spark, sf_dir), axis, index(spark), 1500.0, 12, pathways=catalogue.pathways(spark))


CLONES = MEANS + ", " + INDEX + ", axis AS (SELECT CAST(k AS BIGINT) AS bin, 255.0::DOUBLE + 0.5::DOUBLE * k AS mz FROM range(64) t(k)), q AS (SELECT DISTINCT bin AS query_id, mz FROM tops JOIN axis USING (bin) WHERE rank <= 12), " + HITS.format(ppm=1500) + """,
  best AS (SELECT bin, arg_max(class, mean * 1e6 - class * 1e-9) AS best_clone FROM means GROUP BY bin), found AS (SELECT *, best_clone FROM ranked JOIN best ON best.bin = query_id WHERE rank <= 3)"""


@query("annotate_clones", f"WITH {CLONES} SELECT round(mz, 6) AS mz_query, name, adduct, ppm_error, rank, best_clone FROM found")
def annotate_clones(spark, sf_dir):
    return _clone_hits(spark, sf_dir).select("mz_query", "name", "adduct", "ppm_error", "rank", "best_clone")


@query("annotate_ions", f"WITH {CLONES} SELECT name, count(*) AS n FROM found GROUP BY name")
def annotate_ions(spark, sf_dir):
    """The shortcut through the annotator: what is found, by name."""
    axis = mz.fixed_axis(spark, 255.0, 286.5, 0.5)
    return annotate.Annotator(spark, "neg", 1500.0).clones(cq.dense(spark, sf_dir), axis, n_top=12).groupBy("name").agg(F.count("*").alias("n"))


@query("enrichment", f"WITH {CLONES} SELECT best_clone, subclass, count(*) AS n FROM found GROUP BY best_clone, subclass")
def enrichment(spark, sf_dir):
    return annotate.enrichment(_clone_hits(spark, sf_dir))


@query("enrichment_heatmap", f"WITH {CLONES}, e AS (SELECT best_clone, subclass, count(*) AS n FROM found GROUP BY ALL), g AS (SELECT class, subclass, coalesce(n, 0) AS n FROM (SELECT DISTINCT class FROM long) CROSS JOIN (SELECT DISTINCT subclass FROM e) LEFT JOIN e USING (subclass) WHERE e.best_clone = class OR e.best_clone IS NULL UNION ALL SELECT class, s.subclass, 0 FROM (SELECT DISTINCT class FROM long) CROSS JOIN (SELECT DISTINCT subclass FROM e) s WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.subclass = s.subclass AND e.best_clone = class)) SELECT class, subclass, round(n / (max(n) OVER (PARTITION BY subclass) + 1e-9), 6) AS share FROM g")
def enrichment_heatmap(spark, sf_dir):
    return annotate.enrichment_heatmap(annotate.enrichment(_clone_hits(spark, sf_dir)), cq.dense(spark, sf_dir))
