"""The queries opN_<name>: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocation, contamination, gif, langid, lattice, mixing, packing, sharding, simhash, suffix, toxicity, urlfilter, vafile
from .common import shared_folder, table, written


#: Shares of the domains in the mix of op10_mixing, and its tokens as a multiple of what is there.
MIX, MIX_BUDGET = {"fine": 0.6, "plain": 0.38, "toxic": 0.02}, 0.5

#: Bytes from which on op5_suffix tells of repeated passages: fewer than 50 words have.
PASSAGE_BYTES = 200


def tokenizer(spark: SparkSession) -> tuple[str, str]:
    """File and pre-token pattern of the byte-level BPE; the file's place can be set with mosaicell.tokenizer."""
    import public_tokenizers

    return spark.conf.get("mosaicell.tokenizer", public_tokenizers.path("byte_bpe_50k.json")), public_tokenizers.PATTERN


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 1024 ids."""
    return packed(spark, table(spark, sf_dir, "documents"))


def packed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """What op1_packing returns for `docs`."""
    return (packing.pack_documents(docs, *tokenizer(spark))
            .select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"))


def op2_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as the samples of a stored GIF, read back; the feature sums up its frames and their histograms."""
    payloads = table(spark, sf_dir, "documents").select("doc_id", gif.text_payload().alias("payload"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    media = written(gif.as_gifs(payloads, ["doc_id", "n_bytes"]), "media")
    histogram = F.aggregate("frames", F.array(*[F.lit(0).cast("long")] * gif.HIST_BINS), lambda a, f: F.zip_with(a, f["hist_r"], lambda x, y: x + y))
    last = F.element_at("frames", -1)
    return (gif.gif_frames(media, ["doc_id", "n_bytes"])
            .select("doc_id", "n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
                    F.crc32(F.expr("substring(samples, -16, 16)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
                    F.sha2("media", 256).alias("media_sha256"),
                    F.concat_ws(";", F.size("frames").cast("string"), (last["start_ms"] + last["delay_ms"]).cast("string"), F.array_join(histogram.cast("array<string>"), ",")).alias("feature")))


def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9."""
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learned from labels of documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    field = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, field).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that strings of 400 bytes cover which start anywhere else too; beside that, how much of them repeats from 200 bytes on."""
    found = suffix.remove_repeats(table(spark, sf_dir, "documents"), passage=PASSAGE_BYTES, with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "passage_bytes")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs)).select("doc_id", held_out().alias("held_out"), F.col("language").alias("lang_pred"), "score", "accepted")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op8_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes, by 4096 virtual slots and an edited map."""
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/slot-maps-{uuid.uuid4().hex}")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url."""
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def urls_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules of op9_urls say of every page's url, which SQL can express."""
    rows = urlfilter.with_host_and_path(table(spark, sf_dir, "pages")).withColumn("r", urlfilter.rule_for())
    return rows.select("page_id", "host", "path", "r.rule", F.col("r.verdict").alias("rule_verdict"))


URLS_BY_RULE = """WITH u AS (SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
  p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
  r(rule, rule_host, rule_path, rule_verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
  f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS rule_verdict FROM p, r
    WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
  SELECT page_id, host, path, rule, rule_verdict FROM p LEFT JOIN f USING (page_id)"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates for all documents, so that expected tokens of the labels' domains meet their shares."""
    found = mixing.mix(table(spark, sf_dir, "documents"), mixing.label_domains(table(spark, sf_dir, "labels")), MIX, MIX_BUDGET)
    return found.select("doc_id", "tokens", *(F.get("posterior", k).alias(f"p_{n}") for k, n in enumerate(MIX)), "rate", "copies")


def op11_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in windows of ten words of benchmark items."""
    found = contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP11 = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
  i AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
  s AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0),
  p AS (SELECT DISTINCT item, array_to_string(w[s:s + 9], ' ') AS window_text, least(len(w), 10) AS n FROM s),
  c AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n),
  f AS (SELECT r, s, c.n, item FROM (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS window_text FROM c) c JOIN p USING (window_text, n)),
  h AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS place FROM f) GROUP BY r),
  t AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM f) GROUP BY r)
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
  FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""


def op12_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as four bytes, by codebooks that all vectors have formed."""
    return vafile.compressed(table(spark, sf_dir, "embeddings"))


def _codes_sql(parts: int = vafile.PARTS, entries: int = vafile.ENTRIES, rounds: int = vafile.ROUNDS) -> str:
    nearest = """a{r} AS MATERIALIZED (SELECT x.r, x.part, min({{'d': d, 'entry': entry}}) AS m FROM (SELECT x.r, x.part, entry, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v, e)])::BIGINT AS d FROM x JOIN b{r} USING (part)) x GROUP BY ALL)"""
    again = """b{q} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(s.e, b.e) AS e FROM b{r} b LEFT JOIN (SELECT part, entry, list(floor_ ORDER BY place) AS e FROM
      (SELECT part, entry, place, ((sum(y) - (sum(y) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS floor_ FROM (SELECT a.part, a.m.entry AS entry, unnest(v) AS y, generate_subscripts(v, 1) AS place FROM a{r} a JOIN x USING (r, part)) GROUP BY ALL) GROUP BY ALL) s USING (part, entry))"""
    steps = [s for r in range(rounds) for s in (nearest.format(r=r), again.format(r=r, q=r + 1))] + [nearest.format(r=rounds)]
    return f"""WITH k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, [floor(1024 * y::DOUBLE)::BIGINT FOR y IN embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([y FOR y IN embedding IF y IS NULL OR NOT isfinite(y)]) = 0),
  x AS MATERIALIZED (SELECT r, part, v[part * len(v) // {parts} + 1:(part + 1) * len(v) // {parts}] AS v FROM k, (SELECT unnest(range({parts})) AS part)),
  b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, v AS e FROM x WHERE r <= {entries}),
  {(","+chr(10)+"  ").join(steps)},
  c AS (SELECT r, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY r)
  SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256 FROM k JOIN c USING (r)"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 first phrases of each language among all documents."""
    return collocation.collocations(table(spark, sf_dir, "documents"))


OP13 = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
  w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
  g AS (SELECT lang, size, array_to_string(w[s:s + size - 1], ' ') AS phrase FROM (SELECT lang, size, w, unnest(range(1, len(w) - size + 2)) AS s FROM w, (VALUES (1), (2), (3)) AS v(size) WHERE len(w) >= size)),
  f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
  c AS (SELECT lang, phrase, f AS a, size, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
  k AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS left_part, array_to_string(w[k + 1:size], ' ') AS right_part FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
  s AS (SELECT k.lang, k.phrase, a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT AS score FROM k JOIN f l ON l.lang = k.lang AND l.phrase = left_part JOIN f r ON r.lang = k.lang AND r.phrase = right_part),
  b AS (SELECT lang, phrase, a, min({'score': score, 'k': k, 'l': l, 'r': r}) AS m FROM s GROUP BY ALL),
  i AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a AS longer FROM c WHERE size = 3),
  o AS (SELECT b.lang, b.phrase, a, m.l AS l, m.r AS r, m.score AS score FROM b WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * longer >= 50 * a)),
  t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang)
  SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) JOIN t USING (lang) WHERE rank <= 2000"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_packing": op1_packing, "op2_gif": op2_gif, "op3_lattice": op3_lattice, "op4_toxicity": op4_toxicity, "op5_suffix": op5_suffix, "op6_language": op6_language, "op7_simhash": op7_simhash, "op8_slots": op8_slots, "op9_urls": op9_urls, "op10_mixing": op10_mixing,
           "op11_contamination": op11_contamination, "op12_vafile": op12_vafile, "op13_collocations": op13_collocations, "urls_by_rule": urls_by_rule}

ORACLE_SQL: dict[str, str] = {"op11_contamination": OP11, "op12_vafile": _codes_sql(), "op13_collocations": OP13, "urls_by_rule": URLS_BY_RULE}
