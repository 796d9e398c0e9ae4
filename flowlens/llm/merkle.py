"""Merkle manifest of a dataset: a hash tree over rows of each group, one over the groups, and a proof for every row.

Rows are ranked within their group; written in base FAN, a rank is a path through the tree. Within a block of
FAN ** DIGITS consecutive nodes the digits are grouped away one after another, the last first, and each step nests the
structs of its children in their parent's, so a block is one row of bounded size. Blocks are the nodes of the next tier,
until one is left. On the way back every tier's rows meet the path above them in one grouping by block, and exploding
the nested children, each with what stands left and right of it, gives the proofs; no step joins rows with rows.
A level of a group that has one node only is no level: the node passes through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.llm.tables import keep

FAN = 16
DIGITS = 3  # levels of one block: 4,096 nodes, some 600 KB
PROOF = "array<struct<left: string, right: string>>"


def digest(parts: list[Column]) -> Column:
    """SHA-256 of parts as lower-case hex, each `-` if null, else its length in UTF-8 bytes, `:` and itself."""
    text = [p.cast("string") for p in parts]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


def parent(hashes: Column) -> Column:
    return F.sha2(F.array_join(hashes, ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda h, p: F.sha2(F.concat(p.left, h, p.right), 256))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows (group, ...) with rank (from 0 within the group by `order`, nulls first) and n, the rows of the group.

    Rows are dealt into ranges of (group, order), equal ones by where they were written, so neither a large group nor a
    row with many copies is one task. A row's rank is its place in its written range, less where its group begins there,
    plus the rows of the group in the ranges before: one row a group and range.
    """
    rows = keep(rows, "ranked-rows")
    salted = rows.select("*", F.xxhash64(F.col("_metadata.file_path")).alias("__file"), F.col("_metadata.row_index").alias("__at"))
    keys = ["group", *order, "__file", "__at"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keep(salted.repartitionByRange(n, *keys).sortWithinPartitions(*keys), "ranges")
    dealt = dealt.withColumns({"__range": F.col("_metadata.file_path"), "__place": F.col("_metadata.row_index")})
    ends = dealt.groupBy("__range", "group").agg(F.min("__place").alias("begin"), F.count("*").alias("size"), F.min(F.struct(*keys[1:])).alias("least"))
    own = Window.partitionBy("group")
    ends = ends.select(F.col("__range").alias("r"), F.col("group").alias("g"), "begin", F.sum("size").over(own).alias("n"),
                       F.coalesce(F.sum("size").over(own.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    joined = dealt.join(ends, (F.col("__range") == F.col("r")) & F.col("group").eqNullSafe(F.col("g")))
    return joined.withColumn("rank", F.col("__place") - F.col("begin") + F.col("before")).drop("__file", "__at", "__range", "__place", "r", "g", "begin", "before")


def nodes(n: Column, level: int) -> Column:
    """Nodes of a level over n nodes."""
    return F.ceil(n / F.lit(FAN**level)).cast("long")


def rolled(rows: DataFrame) -> DataFrame:
    """(group, n, block, hash, kids) from (group, n, rank, hash, item): a tier of blocks, children nested in order."""
    digit = [(F.col("rank") / F.lit(FAN**i)).cast("long") % FAN for i in range(DIGITS)]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    level = rows.select("group", "n", (F.col("rank") / F.lit(FAN**DIGITS)).cast("long").alias("block"), *[d.alias(f"d{i}") for i, d in enumerate(digit)], "hash", "item")
    level = level.repartition(parts, "group", "block")  # the groupings below need no other exchange
    inner = ["item"]
    for i in range(DIGITS):
        keys = ["group", "n", "block", *[f"d{j}" for j in range(DIGITS - 1, i, -1)]]
        level = level.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(f"d{i}", "hash", *inner))).alias("kids"))
        level = level.withColumn("hash", F.when(nodes(F.col("n"), i) > 1, parent(F.col("kids.hash"))).otherwise(F.col("kids")[0]["hash"]))
        inner = ["kids"]
    return level.select("group", "n", "block", "hash", "kids")


def tiers(rows: DataFrame, name: str) -> list[DataFrame]:
    """Written tiers from (group, n, rank, hash, item) up to one block a group."""
    found = [keep(rolled(rows), f"{name}-1")]
    while True:
        top = found[-1]
        upper = top.select("group", nodes(F.col("n"), DIGITS).alias("n"), F.col("block").alias("rank"), "hash", F.struct("block").alias("item"))
        if not (upper.agg(F.max("n")).first()[0] or 0) > 1:
            return found
        found.append(keep(rolled(upper), f"{name}-{len(found) + 1}"))


def opened(tier: DataFrame, above: DataFrame) -> DataFrame:
    """(group, item, hash, proof, kept columns) of the children of a tier's blocks; above: (group, block, proof, ...) of the blocks."""
    more = [c for c in above.columns if c not in ("group", "block")]
    both = tier.select("group", "block", "n", "kids").unionByName(above, allowMissingColumns=True).groupBy("group", "block").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", *more)])
    level = both.drop("block")
    for i in range(DIGITS - 1, -1, -1):
        others = [c for c in level.columns if c not in ("kids", "proof")]
        level = level.select(*others, "proof", F.col("kids.hash").alias("hashes"), F.posexplode("kids").alias("at", "kid"))
        beside = F.struct(F.array_join(F.slice("hashes", F.lit(1), F.col("at")), "").alias("left"),
                          F.array_join(F.slice("hashes", F.col("at") + 2, F.lit(FAN)), "").alias("right"))
        proof = F.when(nodes(F.col("n"), i) > 1, F.concat(F.array(beside), F.col("proof"))).otherwise(F.col("proof"))
        level = level.select(*others, proof.alias("proof"), F.col("kid.kids").alias("kids") if i else F.struct("kid.hash", "kid.item").alias("kid"))
    return level.drop("n").select("*", "kid.hash", "kid.item").drop("kid")


def manifest(rows: DataFrame, group_col: str, order: list[str], leaf_col: str, carry: list[str] | None = None) -> DataFrame:
    """(group, leaf, subroot, root, proof, carried columns) of every row.

    Rows of a group ascend by `order`, then by leaf, nulls first; null is a group. While a group has several nodes, every
    FAN consecutive ones (the last run fewer, even one) become the hash of their digests one after another; the
    last is its subroot. Subroots, ordered by group (null first, by UTF-8 bytes), give the root in the same way. proof:
    from the row up to the root, what stands left and right of the node in its run, as concatenated digests; levels
    without other nodes have empty ones. `folded` recomputes the root. Rows that repeat are leaves of their own; an empty
    table has none. order and carry are column names and may be any but those of the result; other columns are left out.
    """
    carry = carry or []
    item = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.lit(0).alias("pad"))
    leaves = rows.select(F.col(group_col).alias("group"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(leaf_col).alias("hash"), item.alias("item"))
    lower = tiers(ranked(leaves, [*[f"o{i}" for i in range(len(order))], "hash"]), "leaves")
    subroots = lower[-1].select(F.lit(0).alias("group"), F.col("group").alias("name"), "hash")
    upper = tiers(ranked(subroots, ["name"]).withColumn("item", F.struct("name")).drop("name"), "subroots")
    above = upper[-1].select("group", "block", F.col("hash").alias("root"), F.expr(f"CAST(array() AS {PROOF})").alias("proof"))
    for i in range(len(upper) - 1, -1, -1):
        above = opened(upper[i], above)
        if i:
            above = above.select("group", F.col("item.block").alias("block"), "root", "proof")
    above = above.select(F.col("item.name").alias("group"), F.lit(0).cast("long").alias("block"), "root", F.col("hash").alias("subroot"), "proof")
    for i in range(len(lower) - 1, -1, -1):
        above = opened(lower[i], above)
        if i:
            above = above.select("group", F.col("item.block").alias("block"), "root", "subroot", "proof")
    return above.select("group", F.col("hash").alias("leaf"), "subroot", "root", "proof", *[F.col(f"item.c{i}").alias(c) for i, c in enumerate(carry)])
