"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets follow the weights; a source never gives more than ``cap`` times its
words, and what it can't give is shared anew by weight.  Seats are blocks of
``block_words`` words: sources get seats by highest quotients, and so do the
shards of each source, seeded hash groups of documents.  What a target leaves
beyond whole blocks is dealt as part of one block more, so that a source gives
its target to the word, however small it is.  In a shard the documents lie in a
seeded order on a line of words, cut into equal blocks and a last, shorter one;
a seeded permutation names the blocks that are taken, the shorter one last.
What a document gives is its overlap with those blocks.

The driver holds a row for each source and for each shard; shards grow with the
corpus, so that there are about ``most_shards`` at most beside one a source.
One shuffle deals ids and sizes to the shards; texts are read where they lie.

Shards and order come from id and text, so reruns agree whatever the
partitioning; rows that repeat both can stand for one another.  Null texts and
texts without words have size 0 and give nothing; null is a source of its own;
rows that repeat, even their ids, count one by one; long texts are cut anywhere
between words; other columns are ignored, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.common import WORD, stored, text_of

#: Primes over any number of blocks in a shard: multiplying by one permutes the blocks.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)


def targets(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """``total`` shared by weight, none above ``cap`` times its size; the excess goes to the others by weight."""
    found: dict[int, float] = {}
    left, open_ = total, list(range(len(sizes)))
    while open_:
        whole = sum(weights[i] for i in open_)
        above = [i for i in open_ if left * weights[i] / whole > cap * sizes[i]]
        if not above:
            found |= {i: left * weights[i] / whole for i in open_}
            break
        found |= {i: float(cap * sizes[i]) for i in above}
        left -= sum(cap * sizes[i] for i in above)
        open_ = [i for i in open_ if i not in found]
    return [found[i] for i in range(len(sizes))]


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by highest quotients votes / (2 seats + 1), none above ``most``; ties go to the earlier one.

    A divisor is searched that gives out no more than ``seats`` at once; the
    rest is dealt seat by seat.
    """
    votes, most = np.asarray(votes, float), np.asarray(most, np.int64)
    seats = int(min(seats, most[votes > 0].sum())) if len(votes) else 0
    if not seats:
        return np.zeros(len(votes), np.int64)
    given = lambda d: (np.minimum(np.floor(votes / d + 0.5), most) * (votes > 0)).astype(np.int64)
    low, high = votes.max() / (2 * seats + 2), 2 * votes.max() + 1
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (low, middle) if given(middle).sum() <= seats else (middle, high)
    held = given(high)
    heap = [(-v / (2 * q + 1), i) for i, (v, q, m) in enumerate(zip(votes, held, most, strict=True)) if v > 0 and q < m]
    heapq.heapify(heap)
    for _ in range(seats - int(held.sum())):
        _, i = heapq.heappop(heap)
        held[i] += 1
        if held[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * held[i] + 1), i))
    return held


def dealt(words: np.ndarray, seats: int, rest: int, block: int, cap: int) -> np.ndarray:
    """Words that shards of ``words`` give: ``seats`` blocks by highest quotients, and ``rest`` words where there is room."""
    most = cap * np.asarray(words, np.int64)
    found = block * sainte_lague(words, seats, most // block)
    left = seats * block + rest - int(found.sum())
    for i in np.argsort(found - most, kind="stable"):
        if left <= 0:
            break
        more = min(left, int(most[i] - found[i]))
        found[i] += more
        left -= more
    return found


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (5, 2, 1), share: float = 1.5, cap: int = 2, block_words: int = 64, shard_words: int = 1_000_000, most_shards: int = 65_536, seed: int = 17, row_col: str | None = None) -> DataFrame:
    """``id_col``, row (a number of its own, or ``row_col``), source, size, source_size, target, taken, pieces.

    ``pieces`` are the word ranges that the mix takes: (first, end, times).
    """
    spark = docs.sparkSession
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("print"), *([F.col(row_col).alias("row")] if row_col else []))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()) if row_col is None else rows, "sizes")
    held = sorted(rows.groupBy("source").agg(F.sum("size").alias("size")).collect(), key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in held]
    weigh = [weights[i % len(weights)] for i in range(len(held))]
    goal = targets(sizes, weigh, share * sum(sizes), cap)
    # blocks by highest quotients, none beyond the target, and each source's remainder
    whole = np.floor(np.array(goal) + 0.5).astype(np.int64)
    seats = sainte_lague(np.array(goal), int(whole.sum()) // block_words, whole // block_words)
    rest = whole - seats * block_words
    shard_words = max(shard_words, -(-sum(sizes) // most_shards))
    shards = [max(1, -(-s // shard_words)) for s in sizes]
    sources = spark.createDataFrame([(i, r.source, s, t, n) for i, (r, s, t, n) in enumerate(zip(held, sizes, goal, shards, strict=True))], "source_no int, source string, source_size long, target double, shards int")

    own = lambda k: F.xxhash64(F.lit(k), "id", "print")
    rows = rows.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")), "left").drop(F.col("s.source"))
    rows = rows.withColumn("shard", F.pmod(own(seed), F.col("shards")).cast("int"))
    lots = rows.groupBy("source_no", "shard").agg(F.sum("size").alias("words")).toPandas().sort_values(["source_no", "shard"])
    lots["quota"] = 0
    for no, part in lots.groupby("source_no"):
        lots.loc[part.index, "quota"] = dealt(part["words"].to_numpy(), int(seats[int(no)]), int(rest[int(no)]), block_words, cap)
    lots = spark.createDataFrame([tuple(map(int, x)) for x in lots.itertuples(index=False)], "source_no int, shard int, words long, quota long")

    line = Window.partitionBy("source_no", "shard").orderBy(own(seed + 1), "id", "print", "row")
    placed = rows.withColumn("end", F.sum("size").over(line)).join(lots, ["source_no", "shard"], "left")
    begin, block = F.col("end") - F.col("size"), F.lit(block_words).cast("long")
    # of the shard's quota: times that all is taken, whole blocks beyond that, words of one block more
    full, beyond = F.expr("quota div words"), F.expr("quota % words")
    blocks, few = F.expr(f"words div {block_words}"), F.floor(beyond / block)
    prime = F.element_at(F.array(*map(F.lit, PRIMES)), (F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.lit(len(PRIMES))) + 1).cast("int"))
    offset = F.pmod(F.xxhash64(F.lit(seed + 3), "source", "shard"), F.lit(1 << 31))

    def place(j: Column) -> Column:
        return F.when(j < blocks, F.pmod(j * prime + offset, blocks)).otherwise(blocks)

    def piece(j: Column, after: bool) -> Column:
        """The part of block ``j`` in the document: the words that one more round takes of it, or those behind them."""
        start, end = j * block, F.least((j + 1) * block, F.col("words"))
        extra = start + F.when(place(j) < few, block).when(place(j) == few, F.pmod(beyond, block)).otherwise(0)
        start, end, more = (F.least(extra, end), end, 0) if after else (start, F.least(extra, end), 1)
        return F.struct((F.greatest(begin, start) - begin).cast("long").alias("first"), (F.least(F.col("end"), end) - begin).cast("long").alias("end"), (full + more).cast("int").alias("times"))

    both = F.flatten(F.transform(F.sequence(F.floor(begin / block), F.floor((F.col("end") - 1) / block)), lambda j: F.array(piece(j, False), piece(j, True))))
    kind = "array<struct<first:bigint,end:bigint,times:int>>"
    pieces = F.when(F.col("size") > 0, F.filter(both, lambda p: (p["times"] > 0) & (p["first"] < p["end"]))).otherwise(F.array().cast(kind))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda acc, p: acc + (p["end"] - p["first"]) * p["times"])
    placed = placed.withColumn("pieces", pieces).withColumn("taken", taken)
    return placed.select(F.col("id").alias(id_col), "row", "source", "size", "source_size", "target", "taken", "pieces")
