"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

Items are cut into windows of WINDOW words, and windows into shingles. A document that contains a window contains all
its shingles, so of shingles in order of rarity a prefix of one decides: only where a document has a window's rarest
shingle, at a place that leaves room for the whole window, are the two compared, word by word. Which shingles of
documents matter at all is told by a bit table of fixed size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

WINDOW = 10
#: Words of a shingle; windows of fewer words are one shingle.
SHINGLE = 4
#: Longs of the bit table (64 bits each), whatever the number of items: half a megabyte. A fuller table lets more shingles pass that are compared in vain.
TABLE = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value of the contract: what lies between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: F.Column) -> F.Column:
    """The words of a text, A-Z lower-cased; none of a null."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # Other letters keep their case; only pure ASCII can take the faster function.
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, BETWEEN), "")


def _with_shingles(rows: DataFrame, size: int) -> DataFrame:
    """Adds s1 to s<size>: hashes of the shingles of so many of `words`, at each word. A shingle that goes past the end has a hash of its own."""
    rows = rows.withColumn("s1", F.transform("words", lambda w: F.xxhash64(w)))
    for n in range(2, size + 1):
        a, b = (n + 1) // 2, n // 2
        rows = rows.withColumn(f"s{n}", F.expr(f"zip_with(s{a}, slice(s{b}, {a + 1}, size(s{b})), (x, y) -> xxhash64(x, y))"))
    return rows


def _passes(hash_: str, bits: str) -> str:
    return f"(shiftright({bits}[cast({hash_} & {TABLE - 1} AS INT)], cast(shiftright({hash_}, 40) & 63 AS INT)) & 1L) = 1L"


def bit_table(hashes: DataFrame) -> DataFrame:
    """One row: TABLE longs in which each value of `hash` has set a bit."""
    spark = hashes.sparkSession
    bits = hashes.groupBy(F.expr(f"hash & {TABLE - 1}").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(shiftright(hash, 40) & 63 AS INT)))").alias("bits"))
    all_ = spark.range(TABLE).withColumnRenamed("id", "at").join(bits, "at", "left").select("at", F.coalesce("bits", F.lit(0)).alias("bits"))
    return all_.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "bits"))), lambda x: x["bits"]).alias("bits"))


def item_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(words, item): the distinct windows of each item; ids as strings, a null id as `null`."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), words_of(F.col(text_col)).alias("words")).where("size(words) > 0")
    cut = F.expr(f"explode(transform(sequence(1, greatest(size(words) - {window - 1}, 1)), s -> slice(words, s, {window})))")
    return rows.select("item", cut.alias("words")).distinct()


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row (id, n_words, n_hit, n_items, items_sha256, contaminated, hits) per row of `docs`.

    A document's word is hit if it lies inside any occurrence of a window: `window` words of an item in a row, or all
    words of a shorter one. hits: where windows occur, as structs of start and end (exclusive, in words). Null and empty texts
    have no words, items without words no windows. Repeated rows and ids stay rows of their own; equal texts are
    compared once. Rows of one item id are one item; a null item id is the item `null`. Texts are read whole, other
    columns are ignored, empty tables give an empty result or one without hits.
    """
    scratch = Scratch()
    owned = scratch.written(item_windows(items, window, item_col, item_text_col), "owned")
    windows = scratch.written(owned.select("words").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    members = owned.join(windows, "words").select("window", "item")
    sizes = sorted(r[0] for r in windows.select(F.least(F.size("words"), F.lit(shingle))).distinct().collect()) or [shingle]

    cut = _with_shingles(windows, sizes[-1])
    own = F.coalesce(*(F.when(F.least(F.size("words"), F.lit(shingle)) == n, F.expr(f"slice(s{n}, 1, size(words) - {n - 1})")) for n in sizes))
    shingles = scratch.written(cut.select("window", "words", F.posexplode(own).alias("at", "hash")).select("window", "at", "hash"), "shingles")

    rows = docs.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("key"), words_of(F.col(text_col)).alias("words"))
    rows = _with_shingles(rows, sizes[-1]).withColumn("bits", bit_table(shingles.select("hash")).scalar())
    # What lies around a shingle, as far as a window with it may reach, is all that comparing needs.
    around = "transform(filter(sequence(0, size(s{n}) - 1), i -> {passes}), i -> struct(s{n}[i] AS hash, i AS at, least(i, {reach}) AS before, slice(words, greatest(i - {reach}, 0) + 1, {reach} + {window}) AS context))"
    met = F.concat(*(F.expr(f"if(size(words) > 0, {around.format(n=n, passes=_passes(f's{n}[i]', 'bits'), reach=window - n, window=window)}, array())") for n in sizes))
    read = scratch.written(rows.select("id", "key", F.size("words").cast("long").alias("n_words"), met.alias("met")), "read")
    met = read.select("key", F.explode("met").alias("m")).select("key", "m.*")

    # A window of which some shingle is nowhere can't occur. Ties in rarity go by hash and place.
    often = met.groupBy("hash").agg(F.count("*").alias("n"))
    rarest = (shingles.join(often, "hash", "left").groupBy("window")
              .agg(F.min(F.struct("n", "hash", "at")).alias("r"), (F.count("n") == F.count("*")).alias("all")).where("all")
              .join(windows, "window").select("window", "words", "r.hash", F.col("r.at").alias("inside")))
    found = (met.join(rarest, "hash").where("before >= inside AND slice(context, before - inside + 1, size(words)) = words")
             .select("key", (F.col("at") - F.col("inside")).alias("start"), F.size("words").alias("length"), "window").distinct())
    found = scratch.written(found, "found")

    texts = found.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("hits"), F.array_sort(F.collect_set("window")).alias("windows"))
    # Words under overlapping windows count once: each window adds what reaches beyond all before it.
    hit = F.expr("aggregate(hits, struct(0L AS n, 0 AS end), (a, x) -> struct(a.n + greatest(x.end - greatest(x.start, a.end), 0) AS n, greatest(a.end, x.end) AS end), a -> a.n)")
    texts = scratch.written(texts.select("key", "hits", hit.alias("n_hit"), "windows", F.sha2(F.array_join(F.transform("windows", lambda w: w.cast("string")), ","), 256).alias("together")), "texts")
    # Items are listed once for each set of windows that occurs, however many texts have it.
    sets = texts.groupBy("together").agg(F.first("windows").alias("windows")).select("together", F.explode("windows").alias("window"))
    named = sets.join(members, "window").groupBy("together").agg(F.array_sort(F.collect_set("item")).alias("items"))
    named = named.select("together", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    texts = texts.join(named, "together").select("key", "hits", "n_hit", "n_items", "items_sha256")
    return (read.select("id", "key", "n_words").join(texts, "key", "left")
            .select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
                    F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), F.coalesce("hits", F.array()).alias("hits")))
