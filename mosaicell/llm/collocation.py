"""Phrase collocations by pivot partitioning, as in MG-FSM.

Each occurrence of a phrase belongs to the rarest of its words, its pivot (the first of several). Texts are rewritten
to fragments: for each word that can be a pivot, the words around it that are more frequent, as far as a phrase
reaches; rarer words end the fragment. Equal fragments are counted together, sent to their pivot's partition, and mined
there; only phrases that contain the pivot are emitted. A frequent pivot's fragments are dealt to several partitions,
whose counts are added up.

The most frequent words, at most MOST_CODED, get numbers that tasks know, so that a fragment or a phrase of them is
one or two integers. Rarer words count as equally rare; their fragments travel as words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

LONGEST, LEAST, TOP = 3, 10, 2000
#: Per cent of a phrase's occurrences from which on a longer one around it replaces it.
INSIDE = 50
#: Words that have numbers. Which occurrences suffice for that follows from the counts; 20 bits hold a number and "none".
MOST_CODED, _BITS = 1 << 19, 20
#: Bits that tell which of the other words are frequent enough for a phrase. Where they fill up, more fragments are mined in vain.
MARKS = 1 << 24
#: Occurrences of a pivot that go to one partition.
DEAL = 20_000
#: Words that a task rewrites at once (as numbers), words that it holds as such, and different words that it counts at once; of all languages.
CHUNK, HELD, COUNTED = 1 << 20, 1 << 17, 1 << 18
# Fixed values of the contract: A-Z are lower-cased, these end a piece, these end a word.
_ENDS, _GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_END = b"."
_TABLE = bytes.maketrans(bytes(range(65, 91)) + _ENDS + _GAPS, bytes(range(97, 123)) + _END * len(_ENDS) + b" " * len(_GAPS))


def _tokens(text: bytes) -> list[bytes]:
    """Words, and a full stop at each end of a piece."""
    return text.translate(_TABLE).replace(_END, b" . ").split()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, words of whole texts and ends of pieces), of HELD words of all languages or one text."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text").cast(pa.binary())):
            tokens = _tokens(text.as_py())
            own = held.setdefault(lang.as_py(), [])
            own.extend(tokens)
            own.append(_END)
            size += len(tokens) + 1
            if size >= HELD:
                while held:
                    yield held.popitem()
                size = 0
    yield from held.items()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def told() -> Iterator[pa.RecordBatch]:
        while held:
            lang, counts = held.popitem()
            del counts[_END]
            if counts:
                words = pa.array(counts.keys(), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(counts), np.int32))), words, pa.array(counts.values(), pa.int64())], ["lang", "word", "f"])

    held: dict[str, Counter] = {}
    for lang, tokens in _chunks(batches):
        held.setdefault(lang, Counter()).update(tokens)
        if sum(len(c) for c in held.values()) >= COUNTED:
            yield from told()
    yield from told()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f) of `docs` (lang, text; no nulls)."""
    return docs.mapInArrow(_count, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _mark(lang: str, word: bytes) -> int:
    return zlib.crc32(lang.encode() + b" " + word) % MARKS


class Vocabulary:
    """What tasks know of the words: numbers and counts of the most frequent, marks of the others that are frequent enough."""

    def __init__(self, words: DataFrame, least: int, most: int) -> None:
        # Counts go to classes of an eighth of an octave: the fewest occurrences at which the words are at most `most` are found on a few hundred rows.
        step = F.greatest(F.lit(0), F.floor(F.log2(F.col("f")) * 8)).cast("int")
        sizes = sorted(((r["step"], r["n"]) for r in words.where(F.col("f") >= least).groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
        held, cut = 0, None
        for s, n in sizes:
            if held + n > most:
                break
            held, cut = held + n, s
        frequent = words.where((F.col("f") >= least) & ((step >= cut) if cut is not None else F.lit(False)))
        coded = frequent.select("lang", "word", "f").toArrow()  # at most `most` rows
        order = np.lexsort((coded["word"].to_numpy(), coded["lang"].to_numpy(), -coded["f"].to_numpy())) if len(coded) else np.zeros(0, int)
        coded = coded.take(pa.array(order))
        self.counts = coded["f"].to_numpy()
        self.langs, self.words = coded["lang"].combine_chunks(), coded["word"].combine_chunks()
        # The words of a language and their numbers: arrays, as each task's process holds them.
        self.own: dict[str, tuple[pa.Array, np.ndarray]] = {}
        for lang in pc.unique(self.langs).to_pylist():
            at = np.flatnonzero(pc.equal(self.langs, lang).to_numpy(zero_copy_only=False))
            self.own[lang] = self.words.take(pa.array(at)).cast(pa.binary()), at.astype(np.int32)
        self.marks = None
        if held < sum(n for _, n in sizes):
            mark = F.crc32(F.concat_ws(" ", "lang", "word")) % MARKS
            scarce = words.where((F.col("f") >= least) & ((step < cut) if cut is not None else F.lit(True)))
            found = scarce.select(mark.alias("m")).groupBy(F.floor(F.col("m") / 63).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(m % 63 AS INT)))").alias("bits")).toArrow()
            self.marks = np.zeros(MARKS // 63 + 1, np.int64)
            self.marks[found["at"].to_numpy()] = found["bits"].to_numpy()

    def numbered(self, lang: str, tokens: list[bytes]) -> np.ndarray:
        """The numbers of words; -1 for those without."""
        if lang not in self.own:
            return np.full(len(tokens), -1, np.int32)
        words, numbers = self.own[lang]
        at = pc.fill_null(pc.index_in(pa.array(tokens, pa.binary()), value_set=words), -1).to_numpy()
        return np.where(at >= 0, numbers[at], np.int32(-1))

    def frequent(self, lang: str, word: bytes) -> bool:
        """Whether a word without a number may have enough occurrences; false is certain."""
        m = _mark(lang, word)
        return self.marks is not None and bool(self.marks[m // 63] >> (m % 63) & 1)


def _spans(f: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Words to the left and right of each position that belong to its fragment. f: occurrences, zero where nothing passes."""
    n, reach = len(f), longest - 1
    padded = np.concatenate([np.zeros(reach, f.dtype), f, np.zeros(reach, f.dtype)])
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_l, open_r = f > 0, f > 0
    for k in range(1, longest):
        open_l = open_l & (padded[reach - k : reach - k + n] > f)
        open_r = open_r & (padded[reach + k : reach + k + n] >= f)
        left, right = left + open_l, right + open_r
    return left, right


def _columns(longest: int) -> list[str]:
    """pivot and salt, numbers of up to three words in each of p0 and p1, and, of pivots without number, the language and the words; occurrences."""
    return ["pivot", "salt", "p0", "p1", "lang", *(f"w{i}" for i in range(2 * longest - 1)), "n"]


def _coded(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """(lang, numbers of the words of whole texts, words that the numbers beyond the vocabulary's mean), of CHUNK words or one text; -1: nothing passes."""
    top = len(vocabulary.counts)
    held: dict[str, tuple[list[np.ndarray], dict[bytes, int], list[bytes]]] = {}
    size = 0

    def told() -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
        while held:
            lang, (parts, _, names) = held.popitem()
            yield lang, np.concatenate(parts), names

    for lang, tokens in _chunks(batches):
        codes = vocabulary.numbered(lang, tokens)
        parts, scarce, names = held.setdefault(lang, ([], {}, []))
        if vocabulary.marks is not None:
            for i in np.flatnonzero(codes < 0).tolist():
                w = tokens[i]
                if (k := scarce.get(w)) is None:
                    k = scarce[w] = top + len(names) if w != _END and vocabulary.frequent(lang, w) else -1
                    if k >= 0:
                        names.append(w)
                codes[i] = k
        parts.append(codes)
        size += len(codes)
        if size >= CHUNK or sum(len(s) for _, s, _ in held.values()) >= COUNTED:
            yield from told()
            size = 0
    yield from told()


def _rewrite(known, longest: int):
    """Fragments as `_columns` tells: numbers of their words if the pivot has one, else the words themselves."""
    reach = longest - 1

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: Vocabulary = known.value
        top = len(vocabulary.counts)
        for lang, codes, names in _coded(batches, vocabulary):
            f = np.zeros(len(codes), np.int64)
            has = (codes >= 0) & (codes < top)
            f[has] = vocabulary.counts[codes[has]] + 1
            f[codes >= top] = 1
            left, right = _spans(f, longest)
            at = np.flatnonzero(left + right)
            if not len(at):
                continue
            # A column for each place around the pivot; 0 where the fragment has no word, else the number and one.
            padded = np.concatenate([np.zeros(reach, np.int32), codes + 1, np.zeros(reach, np.int32)])
            columns = [np.where((k >= -left[at]) & (k <= right[at]), padded[at + reach + k], np.int32(0)) for k in range(-reach, longest)]
            columns.append(columns.pop(reach))  # the pivot last: what np.lexsort sorts by first
            order = np.lexsort(columns)
            columns = [c[order] for c in columns]
            new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])
            starts = np.flatnonzero(new)
            n = np.diff(np.append(starts, len(order)))
            columns = [c[starts] for c in columns]
            pivot = columns.pop()
            columns.insert(reach, pivot)
            for coded in (True, False):
                own = np.flatnonzero((pivot <= top) == coded)
                if not len(own):
                    continue
                some = [c[own] for c in columns]
                if coded:
                    mixed = np.zeros(len(own), np.uint64)
                    for c in some:
                        mixed = (mixed ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    salt = (mixed >> np.uint64(33)).astype(np.int64) % (1 + vocabulary.counts[some[reach] - 1] // DEAL)
                    head = [pa.array(some[reach].astype(np.int64) - 1), pa.array(salt, pa.int64()), *(pa.array(_pack(some[i : i + 3], len(own)), pa.int64()) for i in (0, 3))]
                    rest = [pa.nulls(len(own), pa.string())] * (1 + len(some))
                else:
                    head = [pa.array(np.full(len(own), -1), pa.int64()), pa.array(np.zeros(len(own)), pa.int64()), *[pa.nulls(len(own), pa.int64())] * 2]
                    rest = [pa.array([lang] * len(own), pa.string())]
                    for c in some:
                        values, at_value = np.unique(c, return_inverse=True)
                        said = [None if k == 0 else vocabulary.words[k - 1].as_py() if k <= top else names[k - 1 - top].decode() for k in values.tolist()]
                        rest.append(pa.array(said, pa.string()).take(pa.array(at_value)))
                yield pa.RecordBatch.from_arrays([*head, *rest, pa.array(n[own], pa.int64())], _columns(longest))

    return of


def _pack(columns: list[np.ndarray], rows: int) -> np.ndarray:
    out = np.zeros(rows, np.int64)
    for i, c in enumerate(columns):
        out |= c.astype(np.int64) << (_BITS * i)
    return out


def _unpacked(place: int) -> str:
    """The number and one of the word at a place of the fragment, in SQL; zero for none."""
    return f"(shiftright(p{place // 3}, {_BITS * (place % 3)}) & {(1 << _BITS) - 1})"


def _named(known, longest: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: Vocabulary = known.value
        for batch in batches:
            code = batch.column("code").to_numpy()
            places = [(code >> (_BITS * i)) & ((1 << _BITS) - 1) for i in range(longest)]
            words = [vocabulary.words.take(pa.array(p - 1, pa.int64(), mask=p == 0)) for p in places]
            yield pa.RecordBatch.from_arrays([vocabulary.langs.take(pa.array(places[0] - 1)), pc.binary_join_element_wise(*words, " ", null_handling="skip"), batch.column("f")], ["lang", "phrase", "f"])

    return of


def ngram_counts(docs: DataFrame, words: DataFrame, scratch: Scratch, longest: int = LONGEST, least: int = LEAST, most_coded: int = MOST_CODED) -> DataFrame:
    """(lang, phrase, f) of the phrases of 2 to `longest` words (3 at most) with `least` occurrences, space-joined."""
    spark = docs.sparkSession
    if longest not in (2, 3):
        raise ValueError("phrases have at most 2 or 3 words: their numbers are packed into one integer")
    vocabulary = Vocabulary(words, least, min(most_coded, (1 << _BITS) - 2))
    known = spark.sparkContext.broadcast(vocabulary)
    reach = longest - 1
    columns = _columns(longest)
    rows = docs.mapInArrow(_rewrite(known, longest), ", ".join(f"{c} {'string' if c == 'lang' or c[0] == 'w' else 'long'}" for c in columns))
    # Where the phrases around the pivot begin, and their words; null where the fragment doesn't hold one.
    spans = [(s, size) for size in range(2, longest + 1) for s in range(reach - size + 1, reach + 1)]
    codes = [f"IF({' AND '.join(f'{_unpacked(s + i)} > 0' for i in range(size))}, {' | '.join(f'shiftleft({_unpacked(s + i)}, {_BITS * i})' for i in range(size))}, NULL)" for s, size in spans]
    texts = [f"concat({", ' ', ".join(f'w{s + i}' for i in range(size))})" for s, size in spans]
    # Fragments of a pivot (and salt) meet in a partition; counting phrases there needs no other shuffle.
    home = ["pivot", "salt", "lang", f"w{reach}"]
    dealt = rows.repartition(*home)
    each = dealt.select(*home, "n", F.explode(F.expr(f"array({', '.join(f'struct({c} AS code, {t} AS phrase)' for c, t in zip(codes, texts))})")).alias("p")).where("p.code IS NOT NULL OR p.phrase IS NOT NULL")
    mined = each.groupBy(*home, F.col("p.code").alias("code"), F.col("p.phrase").alias("phrase")).agg(F.sum("n").alias("f"))
    # Pivots are numbered by falling counts: those of which several partitions hold a part come first, and are added up; the others' counts are whole.
    several = int(np.searchsorted(-vocabulary.counts, -DEAL, side="right"))
    parts = mined.where((F.col("pivot") >= 0) & (F.col("pivot") < several) | (F.col("f") >= least))
    found = scratch.written(parts.groupBy("code", "lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least), "mined")
    coded = found.where("code IS NOT NULL").select("code", "f").mapInArrow(_named(known, longest), "lang string, phrase string, f long")
    return coded.unionByName(found.where("code IS NULL").select("lang", "phrase", "f"))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, inside: int = INSIDE, top: int = TOP, lang_col: str = "lang", text_col: str = "text", most_coded: int = MOST_CODED) -> DataFrame:
    """The `top` phrases of each language by score: rows (lang, rank, phrase, a, l, r, n, score).

    a: occurrences of the phrase, at least `least`; l and r: those of its two parts at the cut with the lowest score,
    floor(1000000 a a / (l r)), the first of several; n: words of the language. Phrases inside a longer one that has at
    least `inside` per cent of their occurrences are left out. Ties in score go by a and the phrase's bytes. Null
    languages are `und`, null texts have no words; repeated rows count as often as they occur; texts are read whole;
    other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch()
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    words = scratch.written(word_counts(rows), "words")
    phrases = scratch.written(ngram_counts(rows, words, scratch, longest, least, most_coded), "phrases")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    counts = words.where(F.col("f") >= least).select("lang", F.col("word").alias("phrase"), "f").unionByName(phrases)

    split = phrases.select("lang", "phrase", F.split("phrase", " ").alias("w"), F.col("f").alias("a"))
    cuts = split.select("lang", "phrase", "a", F.explode(F.expr("transform(sequence(1, size(w) - 1), k -> struct(k, array_join(slice(w, 1, k), ' ') AS first, array_join(slice(w, k + 1, size(w)), ' ') AS rest))")).alias("c")).select("lang", "phrase", "a", "c.*")
    cuts = (cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
            .join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]))
    # Decimals of 38 digits: a * a * 1000000 has them up to 10 ** 16 occurrences.
    score = F.expr("cast((cast(a AS DECIMAL(16,0)) * cast(a AS DECIMAL(16,0)) * 1000000BD) div (cast(l AS DECIMAL(19,0)) * cast(r AS DECIMAL(19,0))) AS BIGINT)")
    scored = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("c")).groupBy("lang", "phrase", "a").agg(F.min("c").alias("c"))

    within = split.where("size(w) > 2").select("lang", F.col("a").alias("longer"), F.explode(F.expr(
        "flatten(transform(sequence(2, size(w) - 1), n -> transform(sequence(1, size(w) - n + 1), s -> array_join(slice(w, s, n), ' '))))")).alias("phrase"))
    within = within.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a"))).select("lang", "phrase", "a", "c.score", "c.l", "c.r")
    # First the best of each of 64 shares of a language, then the best of those.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    kept = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return kept.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
