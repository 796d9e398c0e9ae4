"""Benchmark decontamination with DataFrame functions only: SimHash windows, Hamming blocks, exact similarity.

Words are lower-case runs without white space, shingles are SHINGLE words (an item with fewer words is one shingle). A
window has as many words as an item; a document shorter than the item is one window. A window can only be similar to
an item if enough of its places hold shingles of items of that length, wherever these stand in them; fingerprints are
made of every window that does. They are made of pairs (shingle, how manyth of its kind), so that a repeated shingle weighs
no more than a single one in each bit. Fingerprints are cut into RADIUS + 1 blocks: two of them within RADIUS bits agree
on a block, so an equality join on blocks finds all of these. Candidates are confirmed by exact similarity: shingles
weigh as often as they occur, and 100 * sum of smaller weights >= percent * sum of larger ones must hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.tables import BROADCAST_IDS, keep, with_ids

SHINGLE = 5
PERCENT = 80
BITS = 64
RADIUS = 19  # at a similarity of 0.8 fingerprints differ in 9.7 bits on average, by more than 19 less than once in 1000 times
EDGES = [b * BITS // (RADIUS + 1) for b in range(RADIUS + 2)]
SPACE = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Words of a text; an empty array for none."""
    body = F.btrim(F.lower(text), F.lit(SPACE))
    return F.when(F.length(body) > 0, F.split(body, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def grams(ws: Column, k: int) -> Column:
    """Hashes of all runs of k words, in order."""
    return F.when(F.size(ws) >= k, F.transform(F.sequence(F.lit(0), F.size(ws) - k), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(k)]))).otherwise(
        F.array().cast("array<bigint>"))


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has BROADCAST_IDS rows at most."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def fingerprint(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fp) from rows (keys, g): each bit is what most shingle hashes have there, 1 in a tie."""
    ones = [F.sum(F.shiftright("g", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(BITS)]
    counted = rows.groupBy(*keys).agg(F.count("*").alias("total"), *ones)
    fp = F.lit(0).cast("long")
    for b in range(BITS):
        fp = fp.bitwiseOR(F.when(2 * F.col(f"b{b}") >= F.col("total"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return counted.select(*keys, fp.alias("fp"))


def occurrences(counts: DataFrame, keys: list[str], count: str) -> DataFrame:
    """(keys, g) with one g for each occurrence of a shingle: common ones of two sides are as many as their common weight."""
    return counts.select(*keys, "g", F.explode(F.sequence(F.lit(1).cast("long"), F.col(count))).alias("nth")).select(*keys, F.xxhash64("g", "nth").alias("g"))


def starts(percent: int) -> Column:
    """Starts of all windows that can be similar, from rows (n, w, k, places): sorted places of shingles of items of w words.

    A window of nw shingles needs percent * (nw + item shingles) / (100 + percent) of them, so it spans that many places
    one after the other; each run of so many gives the starts that the run before has not given.
    """
    last, size = F.greatest(F.lit(0), F.col("n") - F.col("w")), F.col("w") - F.col("k") + 1
    both = size + F.least(size, F.col("n") - F.col("k") + 1)
    need = F.greatest(F.lit(1), F.ceil(F.lit(percent) * both / F.lit(100 + percent) - F.lit(1e-9)).cast("int"))

    def of(i: Column) -> Column:
        given = F.when(i > 0, F.least(F.get("places", i - 1), last) + 1).otherwise(F.lit(0))
        low = F.greatest(given, F.get("places", i + need - 1) - size + 1)
        high = F.least(F.get("places", i), last)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.when(F.size("places") >= need, F.flatten(F.transform(F.sequence(F.lit(0), F.size("places") - need), of))).otherwise(F.array().cast("array<int>"))


def blocks(fp: str) -> Column:
    """Block number and value of each block of a fingerprint, as one long each."""
    parts = [F.shiftright(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) + F.lit(b << 32) for b, (lo, hi) in enumerate(zip(EDGES, EDGES[1:], strict=False))]
    return F.array(*parts)


def contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, windows, best_shared, window_shingles, item_shingles) of every document and item with a similar window.

    windows: how many start positions are similar; best_shared: the largest common weight, with the shingles of both
    sides at that window. Rows without id, text or words, items without words: never similar. Items with equal ids and
    texts count once; documents that repeat an id are looked at text by text and reported once an id.
    """
    it = items.select(F.col(item_col).alias("item_id"), words(F.col(item_text)).alias("ws")).distinct().withColumn("w", F.size("ws")).where("w > 0")
    it = keep(it.withColumn("k", F.least("w", F.lit(SHINGLE))), "items")
    sizes = sorted(r[0] for r in it.select("k").distinct().collect())  # SHINGLE values at most
    if not sizes:
        sizes = [SHINGLE]
    by_k = F.lit(None).cast("array<bigint>")
    for k in sizes:
        by_k = F.when(F.col("k") == k, grams(F.col("ws"), k)).otherwise(by_k)
    it = it.withColumn("gs", by_k)
    item_grams = keep(it.select("item_id", F.xxhash64("ws").alias("ik"), "w", "k", F.posexplode("gs").alias("off", "g")), "item-grams", 10000)
    anchors = small(item_grams.select("g", "w", "k").distinct())

    base = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("rk"), words(F.col(text_col)).alias("ws"))
    hits = None
    for k in sizes:
        found = base.select("doc_id", "rk", F.size("ws").alias("n"), F.posexplode(grams(F.col("ws"), k)).alias("pos", "g")).join(anchors.where(F.col("k") == k), "g")
        found = found.select("doc_id", "rk", "n", "w", "k", "pos")
        hits = found if hits is None else hits.union(found)
    places = hits.groupBy("doc_id", "rk", "n", "w", "k").agg(F.sort_array(F.collect_set("pos")).alias("places"))
    windows = keep(places.select("doc_id", "rk", "w", "k", F.explode(starts(percent)).alias("start")), "windows", 10000)

    texts = with_ids(base, windows.select("doc_id").distinct(), "doc_id").dropDuplicates(["doc_id", "rk"])
    sliced = F.lit(None).cast("array<bigint>")
    for k in sizes:
        sliced = F.when(F.col("k") == k, grams(F.col("part"), k)).otherwise(sliced)
    window = ["doc_id", "rk", "w", "k", "start"]
    parts = windows.join(texts, ["doc_id", "rk"]).select(*window, F.slice("ws", F.col("start") + 1, F.col("w")).alias("part"))
    own = parts.select(*window, F.explode(sliced).alias("g"))
    counted = keep(own.groupBy(*window, "g").agg(F.count("*").alias("c")), "window-grams", 10000)
    item_counts = keep(item_grams.groupBy("item_id", "ik", "w", "k", "g").agg(F.count("*").alias("ic")), "item-counts", 10000)

    probes = fingerprint(occurrences(counted, window, "c"), window).select(*window, "fp", F.explode(blocks("fp")).alias("block"))
    item = ["item_id", "ik", "w", "k"]
    index = fingerprint(occurrences(item_counts, item, "ic"), item).select("item_id", "ik", "w", F.col("fp").alias("item_fp"), F.explode(blocks("fp")).alias("block"))
    near = probes.join(small(keep(index, "item-blocks")), ["w", "block"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    candidates = keep(near.select(*window, "item_id", "ik").distinct(), "window-candidates", 10000)

    totals = counted.groupBy(*window).agg(F.sum("c").alias("nw"))
    item_totals = item_counts.groupBy("item_id", "ik").agg(F.sum("ic").alias("ni"))
    item_counts = item_counts.select("item_id", "ik", "g", "ic")
    shared = (candidates.join(counted, window).join(small(item_counts), ["item_id", "ik", "g"]).groupBy(*window, "item_id", "ik").agg(F.sum(F.least("c", "ic")).alias("shared"))
              .join(totals, window).join(small(item_totals), ["item_id", "ik"]))
    good = shared.where(100 * F.col("shared") >= percent * (F.col("nw") + F.col("ni") - F.col("shared")))
    best = F.max(F.struct("shared", "nw", "ni"))
    return good.groupBy("doc_id", "item_id").agg(F.count_distinct("start").alias("windows"), best.alias("b")).select(
        "doc_id", "item_id", "windows", F.col("b.shared").alias("best_shared"), F.col("b.nw").alias("window_shingles"), F.col("b.ni").alias("item_shingles"))


def drop_contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that hold a window similar to an item; columns and other rows unchanged."""
    gone = contaminated(docs, items, percent, id_col, text_col).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")
