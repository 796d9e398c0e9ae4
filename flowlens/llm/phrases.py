"""Phrase collocation mining by stripes: every prefix keys a counter of the words that follow it.

Length by length, texts give stripes (lang, prefix, bucket, next words, counts): the prefix is the first words of a
phrase, of no words for single ones. A stripe is what one batch of texts has of a prefix; stripes of one prefix are merged
word by word after one shuffle by (lang, prefix, bucket). A prefix with more than one in HOT of all words is split into
buckets of its next words, as is that of no words, so no stripe's merge is one task. Merged stripes have it all: an entry
is a phrase's count, and the total of the prefix that this phrase is one length on; a stripe's largest entry is what
subsumes its prefix from the right. The same entries, dealt by the phrase without its first word, say what subsumes it
from the left; a phrase inside one two words longer is also inside one in between that is as frequent. The stripe of no
words counts all words under null.

A phrase is frequent only if its first and last words without the other end are. Phrases found so far are passed to the
next length as a bit map of their hashes, BITS bits a phrase up to MOST_BITS in all: a false hit costs a counter and
changes no count, since what is too rare falls out when stripes are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.llm import spans
from flowlens.llm.chunks import fresh
from flowlens.llm.tables import by_bytes, keep

LONGEST = 4
LEAST = 30
SUBSUMED = 80  # percent of a phrase's places that are inside one longer phrase
SCALE = 2_000_000
TOP = 2000
BUCKETS = 64
HOT = 500
BITS, MOST_BITS = 16, 1 << 28  # 32 MB at most
SLICE = 16 << 20  # bytes of text counted at once, more only for one longer text
STRIPE = "lang string, prefix string, bucket int, next array<string>, n array<long>"
# White space inside a piece becomes a space, what ends a piece a line break.
TABLE = spans.LOWER.copy()
TABLE[0x09] = 0x20
TABLE[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 0x0A


@dataclass
class Known:
    """Phrases of one length that may be frequent, as a bit map; and those whose stripes are split."""

    bits: np.ndarray  # uint64
    hot: frozenset[tuple[str, str]]

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        size = np.uint64(len(self.bits) * 64 - 1)
        found = np.ones(len(hashes), bool)
        for h in probes(hashes):
            h = h & size
            found &= (self.bits[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) != 0
        return found


def probes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return hashes, spans.mix(hashes + spans.ODD[1])


def combined(hashes: list[np.ndarray]) -> np.ndarray:
    """Hash of a phrase of the words with these hashes."""
    total = np.zeros(len(hashes[0]), np.uint64)
    for i, h in enumerate(hashes):
        total += h * spans.ODD[i + 2]
    return spans.mix(total)


def text_hashes(words: pa.Array) -> np.ndarray:
    words = fresh(words)
    off = np.frombuffer(words.buffers()[1], np.int64)[:len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None else np.zeros(0, np.uint8)
    return spans.range_hashes(data, off[:-1], off[1:])


@dataclass
class Text:
    """Words of some rows: number of each among the different (lang, word), and how many words its piece goes on for."""

    which: np.ndarray
    left: np.ndarray
    words: pa.Array
    langs: pa.Array
    lang: np.ndarray  # of each different word
    hashes: np.ndarray  # of each different (lang, word)


def split(lang: pa.Array, text: pa.Array) -> Text:
    texts = fresh(text, TABLE)
    off = np.frombuffer(texts.buffers()[1], np.int64)[:len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and off[-1] else np.zeros(0, np.uint8)
    breaks = data == 0x0A
    inside = ~breaks & (data != 0x20)
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    row = np.searchsorted(off, start, "right") - 1
    ends = np.concatenate([[0], np.cumsum(breaks)])[start] if len(start) else np.zeros(0, np.int64)
    new = np.ones(len(start) + 1, bool)
    new[1:-1] = (row[1:] != row[:-1]) | (ends[1:] != ends[:-1])
    at = np.flatnonzero(new)
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(start))
    names = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)), pa.py_buffer(data[inside])])
    coded, langs = names.dictionary_encode(), lang.fill_null("und").dictionary_encode()
    of = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
    both, which = np.unique(of * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    word, of = both % max(len(coded.dictionary), 1), both // max(len(coded.dictionary), 1)
    words = coded.dictionary.take(pa.array(word))
    hashes = spans.mix(text_hashes(words) + text_hashes(langs.dictionary.cast(pa.large_string()))[of] * spans.ODD[0]) if len(words) else np.zeros(0, np.uint64)
    return Text(which, left, words, langs.dictionary, of, hashes)


def phrase_hashes(t: Text, k: int) -> np.ndarray:
    """Hash of the k words from each place; of no meaning where the piece ends before."""
    h = t.hashes[t.which]
    return combined([np.concatenate([h[i:], np.zeros(min(i, len(h)), np.uint64)]) for i in range(k)])


def stripes(t: Text, k: int, known: Known | None) -> Iterator[pa.RecordBatch]:
    """Stripes of phrases of k words; known: the frequent ones of k - 1 words."""
    width = len(t.words) + 1
    if not width - 1:
        return
    if k == 1:
        places, prefix, nxt = np.arange(len(t.which)), t.lang[t.which], t.which
    else:
        good = t.left >= k - 1
        good[good] = known.holds(phrase_hashes(t, k - 1)[good])
        places = np.flatnonzero(good & np.append(good[1:], False) & (t.left >= k))
        prefix, nxt = t.which[places], t.which[np.minimum(places + k - 1, len(t.which) - 1)]
        for i in range(1, k - 1):
            _, prefix = np.unique(prefix * width + t.which[places + i], return_inverse=True)
    keys, first, n = np.unique(prefix * width + nxt, return_index=True, return_counts=True)
    if not len(keys):
        return
    prefix, nxt = keys // width, keys % width
    at = places[first]
    words = pa.concat_arrays([t.words, pa.nulls(1, t.words.type)])
    if k == 1:
        totals = np.bincount(prefix, n).astype(np.int64)
        prefix, nxt, n = np.append(prefix, np.arange(len(totals))), np.append(nxt, np.full(len(totals), width - 1)), np.append(n, totals)
        lang, names = prefix, pa.array([""], words.type).take(pa.array(np.zeros(len(prefix), np.int64)))
    else:
        lang = t.lang[t.which[at]]
        names = words.take(pa.array(t.which[at]))
        for i in range(1, k - 1):
            names = pc.binary_join_element_wise(names, words.take(pa.array(t.which[at + i])), pa.scalar(" ", names.type))
    bucket = np.zeros(len(prefix), np.int64)
    if k == 1:
        split_up = np.ones(len(prefix), bool)
    elif known.hot:
        begins = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
        hot = [pair in known.hot for pair in zip(t.langs.take(pa.array(lang[begins])).to_pylist(), names.take(pa.array(begins)).to_pylist(), strict=True)]
        split_up = np.repeat(hot, np.diff(np.append(begins, len(prefix))))
    else:
        split_up = np.zeros(len(prefix), bool)
    own = np.append(text_hashes(t.words), np.uint64(0))  # of words alone: a bucket is the same in every batch
    bucket[split_up] = (own[nxt[split_up]] % np.uint64(BUCKETS)).astype(np.int64)
    order = np.lexsort((bucket, prefix))
    prefix, bucket = prefix[order], bucket[order]
    begins = np.flatnonzero(np.append(True, (prefix[1:] != prefix[:-1]) | (bucket[1:] != bucket[:-1])))
    edges = pa.array(np.append(begins, len(prefix)).astype(np.int32))
    heads = pa.array(order[begins])
    yield pa.RecordBatch.from_arrays([
        t.langs.take(pa.array(lang[order[begins]])).cast(pa.string()), names.take(heads).cast(pa.string()), pa.array(bucket[begins].astype(np.int32)),
        pa.ListArray.from_arrays(edges, words.take(pa.array(nxt[order])).cast(pa.string())), pa.ListArray.from_arrays(edges, pa.array(n[order].astype(np.int64)))],
        ["lang", "prefix", "bucket", "next", "n"])


def merged(texts: DataFrame, k: int, known: Known | None, least: int) -> DataFrame:
    """(lang, prefix, next, n) of all texts (lang, text): merged stripes.

    Their entries of `least` places or more, and under null that of no words.
    """

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE):
                yield from stripes(split(part.column(0), part.column(1)), k, known)

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.mapInArrow(run, STRIPE).repartition(parts, "lang", "prefix", "bucket")  # the grouping below needs no other exchange
    entries = rows.select("lang", "prefix", "bucket", F.inline(F.arrays_zip("next", "n"))).groupBy("lang", "prefix", "bucket", "next").agg(F.sum("n").alias("n"))
    return entries.where(F.col("next").isNull() | (F.col("n") >= least)).drop("bucket")


def bit_map(frequent: DataFrame, k: int) -> np.ndarray:
    """Bits of the hashes of all phrases (lang, phrase) of k words; of a size that follows their number, up to MOST_BITS."""
    size = 1 << 12
    while size < BITS * frequent.count() and size < MOST_BITS:
        size *= 2

    def run(batches):
        for batch in batches:
            split_ = pc.split_pattern(fresh(batch.column(1)), " ")
            words, n = split_.flatten(), batch.num_rows
            if not n:
                continue
            lang = text_hashes(batch.column(0).cast(pa.large_string()))
            own = spans.mix(text_hashes(words) + np.repeat(lang, k) * spans.ODD[0]).reshape(n, k)
            h = np.unique(np.concatenate(probes(combined([own[:, i] for i in range(k)]))) & np.uint64(size - 1))
            word, bit = (h >> np.uint64(6)).astype(np.int64), np.uint64(1) << (h & np.uint64(63))
            at = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(word[at]), pa.array(np.bitwise_or.reduceat(bit, at).view(np.int64))], ["word", "bits"])

    found = frequent.select("lang", "phrase").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits


@dataclass
class Counts:
    """phrases (lang, phrase, k, n): frequent ones of two words or more; parts (lang, part, f): frequent ones of fewer words

    than the longest; inside (lang, phrase, n): counts of what a phrase begins or ends; words (lang, n): of all words.
    """

    phrases: DataFrame
    parts: DataFrame
    inside: DataFrame
    words: DataFrame


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def counted(texts: DataFrame, longest: int = LONGEST, least: int = LEAST) -> Counts:
    """Counts of texts (lang, text)."""
    known, phrases, parts, inside = None, [], [], []
    for k in range(1, longest + 1):
        rows = keep(merged(texts, k, known, least), f"stripes-{k}")
        if k == 1:
            words = keep(rows.where("next IS NULL").groupBy("lang").agg(F.sum("n").alias("n")), "words")
        rows = rows.where(F.col("next").isNotNull() & (F.col("n") >= least))
        found = rows.select("lang", F.concat_ws(" ", F.nullif("prefix", F.lit("")), "next").alias("phrase"), F.lit(k).alias("k"), "n")
        if k > 1:
            phrases.append(found)
            inside.append(rows.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.max("n").alias("n")))
            inside.append(found.select("lang", F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("phrase"), "n"))
        if k < longest:
            # at most HOT phrases, since a place begins one phrase of a length
            total = words.agg(F.sum("n")).first()[0] or 0
            hot = frozenset((r.lang, r.phrase) for r in found.where(F.col("n") * HOT > total).collect())
            known = Known(bit_map(found, k), hot)
            parts.append(found.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")))
    return Counts(union(phrases), union(parts), union(inside), words)


def scored(c: Counts) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases that no longer phrase subsumes."""
    best = c.inside.groupBy("lang", "phrase").agg(F.max("n").alias("inside"))
    exact = "decimal(20,0)"
    own = c.phrases.join(best, ["lang", "phrase"], "left")
    own = own.where(F.col("inside").isNull() | (F.col("inside").cast(exact) * 100 < F.col("n").cast(exact) * SUBSUMED))
    own = keep(own.select("lang", "phrase", "k", F.col("n").alias("a")), "candidates")
    cuts = own.select("lang", "phrase", "k", "a", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    halves = F.array(F.struct(F.lit(True).alias("first"), F.expr("substring_index(phrase, ' ', cut)").alias("part")),
                     F.struct(F.lit(False).alias("first"), F.expr("substring_index(phrase, ' ', cut - k)").alias("part")))
    sides = cuts.select("lang", "phrase", "a", "cut", F.inline(halves)).join(c.parts, ["lang", "part"])
    both = sides.groupBy("lang", "phrase", "a", "cut").agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    whole = both.withColumn("score", F.expr(f"(CAST({SCALE} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0))) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"))
    least = whole.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    return least.select("lang", "phrase", "a", "m.l", "m.r", "m.score")


def collocations(docs: DataFrame, top: int = TOP, lang_col: str = "lang", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each lang by score, count, and phrase.

    Texts are lower case (A-Z), cut into pieces at . , ; : ! ? and line ends, pieces into words at spaces and tabs; null
    texts are empty, a null lang is `und`, empty texts and tables have no phrases; equal rows count each. A phrase has 2
    to LONGEST words and stands in `least` places or more; a and its parts' l and r count all places, n all words of
    the lang. Its cut is the lowest-scoring one, the first of several; score is SCALE * a / (l + r), rounded down. A
    phrase with SUBSUMED percent of its places or more inside one longer phrase is left out. Other columns do not matter.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    counts = counted(texts, least=least)
    rows = scored(counts)
    # first within parts of a lang, so that the last step sees BUCKETS * top rows a lang at most
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", "part").orderBy(*order)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows.join(counts.words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
