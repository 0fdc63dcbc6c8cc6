"""N-gram Jaccard join as a blocked sparse product of documents by n-grams.

Each document is a row of a sparse matrix, each distinct n-gram a column.

1. Columns are dealt to blocks by hash.  A block counts the rows in each of its
   columns, drops columns with a single row, which no pair shares, and sends
   the rest back to their rows.  Heavy columns, which the first pass over the
   texts counts, are known to be shared: their entries are dealt by row, so
   that no task holds such a column as a whole.
2. A row of n columns can only pair with one that shares one of its
   ``n - ceil(t * n) + 1`` rarest columns, columns of its own first.  Most rows
   have that many of their own and leave here.
3. The product runs over these rare columns alone.  In each column, rows are
   first multiplied with one pivot; rows that thereby fall into one component
   need no product with one another.  When few products are left, all pairs of
   rows in different components are taken, so that no link between components
   is lost.  Pairs whose sizes rule out the bound are discarded.
4. Overlaps are counted over all shared columns of a pair and held against the
   bound; links join components.
5. Links never leave a component.  Where they are to be counted, all rows of a
   component are multiplied with one another: it is cut into lots by size and
   hash, and each pair of lots whose sizes allow a link is a product of its own,
   by matrices for common columns and pair by pair for rare ones.

Equal sets are one row from the start, by a fingerprint of the sorted n-grams.
A block's columns have ``BLOCK_ENTRIES`` entries on average; of E entries a
column that isn't heavy has ``HEAVY_ROWS`` or E / ``HEAVY_COLUMNS`` rows at most,
beside ``REPEATED`` in each ``GATHERED`` entries that a task counts at a time.
N-grams are 64-bit hashes of words, of which 48 bits and the block tell columns
apart: two columns of one document are mixed up with a chance of 2 ** -48 a pair
at most, and what is lost or won by that is one column of an overlap.

Nulls count as empty texts; texts without words have no n-grams and no links;
repeated rows fall into one component and link with one another, whatever their
ids; texts of any length are read whole; columns other than id and text are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm import graph
from wakeline.llm.common import stored, text_of, with_group

#: Bytes hashed at once, entries that a task gathers before it sends them to blocks, entries in a block, rows and entries in a bucket.
STRIDE, GATHERED, BLOCK_ENTRIES, BUCKET_ROWS, BUCKET_ENTRIES = 1 << 19, 1_000_000, 2_000_000, 10_000, 6_000_000
#: Rows that make a column heavy, heavy columns at most, and rows of a column among those that a task counts at once from which it is reported.
HEAVY_ROWS, HEAVY_COLUMNS, REPEATED = 200_000, 1_000_000, 8
#: Partners of a row that are verified against one copy of it; products an entry that are taken without further pivots.
PARTNERS, PRODUCTS = 1_000, 200
#: Rows and entries in a lot, columns in a matrix, products that are taken pair by pair at once; a column goes to a matrix if it has a pair for so many of all pairs.
LOT_ROWS, LOT_ENTRIES, MATRIX_COLUMNS, AT_ONCE, DENSE = 2_000, 1_000_000, 4_096, 4_000_000, 100
LOW48 = (1 << 48) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """The public-domain SplitMix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct hashes of a text's word n-grams."""

    def __init__(self, words: int = 5):
        self.words = words
        self.table = bytes(0x20 if b == 0x20 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
        base = 0x9E3779B97F4A7C15
        self.powers = np.full(STRIDE + 1, base, np.uint64)
        self.inverse = np.full(STRIDE + 1, pow(base, -1, 1 << 64), np.uint64)
        self.powers[0] = self.inverse[0] = 1
        np.cumprod(self.powers, out=self.powers)
        np.cumprod(self.inverse, out=self.inverse)
        self.values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))
        self.factors = mixed(np.arange(1001, 1001 + words, dtype=np.uint64) * np.uint64(base)) | np.uint64(1)

    def word_hashes(self, text: bytes) -> np.ndarray:
        import xxhash

        data = np.frombuffer(text.translate(self.table), np.uint8)
        inside = data != 0x20
        if not inside.any():
            return np.zeros(0, np.uint64)
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        start, end = edge[::2], edge[1::2]
        out, at = np.empty(len(start), np.uint64), 0
        while at < len(start):
            to = int(np.searchsorted(end, start[at] + STRIDE, "right"))
            if to == at:  # a word longer than a stride
                out[at] = xxhash.xxh3_64_intdigest(data[start[at] : end[at]].tobytes())
                at += 1
                continue
            first, last = int(start[at]), int(end[to - 1])
            sums = np.zeros(last - first + 1, np.uint64)
            np.cumsum(self.values[data[first:last]] * self.powers[: last - first], out=sums[1:])
            s, e = start[at:to] - first, end[at:to] - first
            out[at:to] = mixed((sums[e] - sums[s]) * self.inverse[s] + (e - s).astype(np.uint64))
            at = to
        return out

    def __call__(self, text: bytes) -> np.ndarray:
        words = self.word_hashes(text)
        if not len(words):
            return words
        n = max(1, len(words) - self.words + 1)
        total = np.zeros(n, np.uint64)
        for k, f in enumerate(self.factors[: len(words)]):
            total += words[k : k + n] * f
        return np.unique(mixed(total + np.uint64(min(len(words), self.words))))


def fingerprint(grams: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(grams.tobytes()) >> 1


def _texts(batches, column: int) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        yield batch, (x.as_py() for x in batch.column(column).cast(pa.binary()))


def row_sets(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id, n (size of the set), print (of the set); and with gram set, n as the rows of a column that a task met often."""

    def run(batches):
        import pyarrow as pa

        shingler, held, size = Shingler(words), [], 0
        names = ["id", "n", "print", "gram"]

        def often(held, kind):
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            grams, n = grams[n >= REPEATED], n[n >= REPEATED]
            return pa.RecordBatch.from_arrays([pa.nulls(len(n), kind), pa.array(n, pa.int64()), pa.nulls(len(n), pa.int64()), pa.array(grams.view(np.int64))], names)

        kind = None
        for batch, texts in _texts(batches, 1):
            found, kind = [], batch.schema.field(0).type
            for grams in map(shingler, texts):
                found.append((len(grams), fingerprint(grams)))
                held.append(grams)
                size += len(grams)
                if size >= GATHERED:
                    yield often(held, kind)
                    held, size = [], 0
            n, prints = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.int64()), pa.nulls(len(n), pa.int64())], names)
        if held:
            yield often(held, kind)

    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, n long, print long, gram long")


class Heavy:
    """Columns of many rows: their hashes in order, the name and the number of rows that all tasks give them."""

    def __init__(self, counts: DataFrame, entries: int, blocks: int):
        least = max(HEAVY_ROWS, entries // HEAVY_COLUMNS)
        # rows of all columns add up to the entries, so HEAVY_COLUMNS of them can be collected at most
        held = counts.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > least).toPandas()
        grams, n = held["gram"].to_numpy(np.int64).view(np.uint64), held["n"].to_numpy(np.int64)
        order = np.argsort(grams)
        self.grams, self.rows = grams[order], np.minimum(n[order], (1 << 32) - 1).astype(np.uint32)
        self.names = (self.grams & np.uint64(LOW48)) | (block_of(self.grams, blocks).astype(np.uint64) & np.uint64(0xFFFF)) << np.uint64(48)
        self.blocks = -(-int(n.sum()) // BLOCK_ENTRIES)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """The place of each n-gram in the list, -1 for others."""
        if not len(self.grams):
            return np.full(len(grams), -1)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return np.where(self.grams[at] == grams, at, -1)


def block_of(grams: np.ndarray, blocks: int) -> np.ndarray:
    return ((grams >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int32)


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a.tobytes()) for a in arrays], "<i8").tobytes(), *(a.tobytes() for a in arrays)])


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = np.frombuffer(data, "<i8", len(kinds)).tolist()
    at, out = 8 * len(kinds), []
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _column_blocks(docs: DataFrame, text_col: str, words: int, blocks: int, heavy: Heavy) -> DataFrame:
    """block, payload: rows with their columns in the block, many rows at once; heavy columns, by their place, are in blocks of rows behind the others."""

    def parts(held: dict[int, np.ndarray]):
        import pyarrow as pa

        prints, sizes = np.array(list(held), np.int64), np.array([len(g) for g in held.values()], np.int64)
        grams, row = np.concatenate(list(held.values())), np.repeat(np.arange(len(held)), sizes)
        block, place = block_of(grams, blocks), heavy.find(grams)
        if heavy.blocks:
            often = place >= 0
            block[often] = blocks + (prints[row[often]].view(np.uint64) % np.uint64(heavy.blocks)).astype(np.int32)
            grams = np.where(often, place.astype(np.uint64), grams)
        order = np.argsort(block.astype(np.uint16) if blocks + heavy.blocks <= 1 << 16 else block, kind="stable")
        grams, row, block = grams[order], row[order], block[order]
        border = np.flatnonzero(np.diff(block, prepend=-1, append=blocks + heavy.blocks))
        for a, b in zip(border, border[1:], strict=False):
            own, counts = np.unique(row[a:b], return_counts=True)
            low = np.ascontiguousarray(grams[a:b].view(np.uint8).reshape(-1, 8)[:, :6])
            yield pa.RecordBatch.from_arrays([pa.array([int(block[a])], pa.int32()), pa.array([_pack(prints[own], sizes[own].astype(np.int32), counts.astype(np.int32), low)], pa.binary())], ["block", "payload"])

    def run(batches):
        shingler, held, n = Shingler(words), {}, 0
        for _, texts in _texts(batches, 0):
            for grams in map(shingler, texts):
                if len(grams) and (key := fingerprint(grams)) not in held:
                    held[key] = grams
                    n += len(grams)
                    if n >= GATHERED:
                        yield from parts(held)
                        held, n = {}, 0
        if held:
            yield from parts(held)

    return docs.select(text_of(text_col).alias("text")).mapInArrow(run, "block int, payload binary")


def _shared_columns(entries: DataFrame, blocks: int, buckets: int, heavy: Heavy) -> DataFrame:
    """bucket, payload: of each row its columns that other rows have too, with their counts of rows."""

    def run(key, frame):
        import pandas as pd

        prints, sizes, counts, low = zip(*(_unpack(x, "<i8", "<i4", "<i4", "u1") for x in frame["payload"]), strict=True)
        prints, sizes, counts = map(np.concatenate, (prints, sizes, counts))
        grams = np.zeros((sum(len(x) for x in low) // 6, 8), np.uint8)
        np.concatenate([x.reshape(-1, 6) for x in low], out=grams[:, :6])
        grams = grams.view("<u8").ravel()
        del low
        rows, first, row = np.unique(prints, return_index=True, return_inverse=True)
        # the same set may come from several tasks
        once = np.repeat(first[row] == np.arange(len(prints)), counts)
        row, grams = np.repeat(row.astype(np.int32), counts)[once], grams[once]
        if int(key[0]) >= blocks:
            grams, df = heavy.names[grams.astype(np.int64)], heavy.rows[grams.astype(np.int64)]
        else:
            order = np.argsort(grams, kind="stable")
            grams, row = grams[order], row[order]
            border = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
            length = np.diff(border, append=len(grams))
            shared = np.repeat(length > 1, length)
            grams, row, df = grams[shared], row[shared], np.repeat(length, length)[shared]
            grams = grams | np.uint64((int(key[0]) & 0xFFFF) << 48)
        to = rows[row] % buckets
        order = np.lexsort((row, to))
        grams, row, df, to = grams[order], row[order], df[order], to[order]
        border = np.flatnonzero(np.diff(to, prepend=-1, append=buckets))
        out = []
        for a, b in zip(border, border[1:], strict=False):
            own, n = np.unique(row[a:b], return_counts=True)
            out.append((int(to[a]), _pack(rows[own], sizes[first[own]], n.astype(np.int32), grams[a:b], df[a:b].astype(np.uint32))))
        return pd.DataFrame(out, columns=["bucket", "payload"])

    return entries.groupBy("block").applyInPandas(run, "bucket long, payload binary")


def _prefixes(shared: DataFrame, percent: int) -> DataFrame:
    """print, n, lone (number of columns of its own), columns (shared ones, sorted), prefix (the rarest shared ones, of which a partner must have one)."""

    def run(frame):
        import pandas as pd

        prints, sizes, counts, grams, df = map(np.concatenate, zip(*(_unpack(x, "<i8", "<i4", "<i4", "<u8", "<u4") for x in frame["payload"]), strict=True))
        rows, first, row = np.unique(prints, return_index=True, return_inverse=True)
        row = np.repeat(row, counts)
        order = np.lexsort((grams, df, row))
        row, grams = row[order], grams[order]
        end = np.cumsum(np.bincount(row, minlength=len(rows)))
        out = []
        for k, (b, a) in enumerate(zip(end, np.concatenate([[0], end[:-1]]), strict=True)):
            n = int(sizes[first[k]])
            rare = n + percent * n // -100 + 1 - (n - int(b - a))
            if rare > 0:
                own = grams[a:b]
                out.append((int(rows[k]), n, n - len(own), np.sort(own).tobytes(), own[:rare].view(np.int64).tolist()))
        return pd.DataFrame(out, columns=["print", "n", "lone", "columns", "prefix"])

    return shared.groupBy("bucket").applyInPandas(run, "print long, n int, lone int, columns binary, prefix array<long>")


def _linked(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose overlap reaches the bound; their columns meet in salted lots."""
    lots = pairs.groupBy("u").agg(F.floor((F.count("*") - 1) / PARTNERS).cast("long").alias("lots"))
    pairs = pairs.join(lots, "u").withColumn("lot", F.pmod(F.xxhash64("v"), F.col("lots") + 1))
    right = pairs.join(rows.select(F.col("print").alias("v"), F.col("n").alias("n_v"), F.col("columns").alias("c_v")), "v").select("u", "v", "lot", "n_v", "c_v")
    left = lots.join(rows.select(F.col("print").alias("u"), F.col("n").alias("n_u"), F.col("columns").alias("c_u")), "u").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), "lots"))).drop("lots")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.to_pydict()
            keep = []
            for k, (a, b, n, m) in enumerate(zip(x["c_u"], x["c_v"], x["n_u"], x["n_v"], strict=True)):
                both = np.concatenate([np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")])
                both.sort(kind="stable")
                overlap = int((both[1:] == both[:-1]).sum())
                if 100 * overlap >= percent * (n + m - overlap):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([x["u"][k] for k in keep], pa.int64()), pa.array([x["v"][k] for k in keep], pa.int64())], ["u", "v"])

    return right.join(left, ["u", "lot"]).select("u", "v", "n_u", "n_v", "c_u", "c_v").mapInArrow(run, "u long, v long")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of columns that each row of ``left`` shares with each of ``right``."""
    count = (len(left), len(right))
    grams, kind = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row = np.repeat(np.arange(sum(count)), [len(x) for x in (*left, *right)])
    order = np.lexsort((row, kind))
    row, kind = row[order], kind[order]
    on_right = row >= count[0]
    n_left, n_right = (np.bincount(kind[x], minlength=len(grams)) for x in (~on_right, on_right))
    begin = np.cumsum(n_left + n_right) - n_right
    dense = n_left * n_right * DENSE > count[0] * count[1]
    out = np.zeros(count, np.int64)

    place = np.cumsum(dense) - 1
    for at in range(0, int(dense.sum()), MATRIX_COLUMNS):
        mine = dense[kind] & (place[kind] >= at) & (place[kind] < at + MATRIX_COLUMNS)
        cells = np.zeros((sum(count), MATRIX_COLUMNS), np.float32)
        cells[row[mine], place[kind[mine]] - at] = 1
        out += (cells[: count[0]] @ cells[count[0] :].T).astype(np.int64)

    mine = ~dense[kind] & ~on_right & (n_right[kind] > 0)
    row_left, times, first = row[mine], n_right[kind[mine]], begin[kind[mine]]
    end = np.cumsum(times)
    at = 0
    while at < len(end):
        to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + AT_ONCE, "right")))
        n = times[at:to]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        other = row[np.repeat(first[at:to], n) + step] - count[0]
        out += np.bincount(np.repeat(row_left[at:to], n) * count[1] + other, minlength=count[0] * count[1]).reshape(count)
        at = to
    return out


def _link_counts(rows: DataFrame, of: DataFrame, weights: DataFrame, percent: int) -> DataFrame:
    """print, partners: the links of a set with other sets, each counted by ``weight``, the number of rows that have that set."""
    members = rows.join(of, rows["print"] == of["node"], "left").select("print", "n", "columns", F.coalesce("root", "print").alias("root")).withColumn("entries", F.length("columns") / 8)
    whole = members.groupBy("root").agg(F.count("*").alias("many"), F.sum("entries").alias("all")).where("many > 1")
    members = members.join(whole, "root").join(weights, "print").withColumn("one", F.expr(f"many <= {LOT_ROWS} AND all <= {LOT_ENTRIES}")).drop("many", "all")
    # sizes of linked sets are in one class or in neighbouring ones; the hundredth leaves room for rounding
    members = stored(members.withColumn("class", F.floor(F.log("n") / math.log(101 / percent))), "members")
    small, large = members.where("one"), members.where("NOT one")
    buckets = max(1, math.ceil(small.agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0] / LOT_ENTRIES))
    small = small.select(F.pmod(F.xxhash64("root"), F.lit(buckets)).alias("task"), F.col("root").alias("unit"), F.lit(0).alias("side"), "print", "n", "weight", "columns")

    lots = stored(large.groupBy("root", "class").agg(F.ceil(F.greatest(F.count("*") / LOT_ROWS, F.sum("entries") / LOT_ENTRIES)).alias("lots")), "lots")
    near = lambda by, name: lots.select("root", (F.col("class") + by).alias("class"), F.col("lots").alias(name))
    shape = lots.join(near(-1, "above"), ["root", "class"], "left").join(near(1, "below"), ["root", "class"], "left")
    large = large.join(shape, ["root", "class"]).withColumn("lot", F.pmod(F.xxhash64("print"), F.col("lots")))
    meets = """explode(concat(
        transform(sequence(0L, lots - 1), x -> struct(xxhash64(root, class, 0, least(x, lot), greatest(x, lot)) AS unit, CASE WHEN x = lot THEN 0 WHEN x > lot THEN 1 ELSE 2 END AS side)),
        transform(filter(sequence(0L, coalesce(above, 0L)), x -> x < above), x -> struct(xxhash64(root, class, 1, lot, x) AS unit, 1 AS side)),
        transform(filter(sequence(0L, coalesce(below, 0L)), x -> x < below), x -> struct(xxhash64(root, class - 1, 1, x, lot) AS unit, 2 AS side))))"""
    large = large.withColumn("meets", F.expr(meets)).select(F.col("meets.unit").alias("task"), "meets.unit", "meets.side", "print", "n", "weight", "columns")

    def run(frame):
        import pandas as pd

        found = [pd.DataFrame({"print": pd.Series(dtype="int64"), "partners": pd.Series(dtype="int64")})]
        for _, part in frame.groupby("unit", sort=False):
            # a lot with itself, or one with another
            sides = [part[part["side"] == k] for k in ((0, 0) if part["side"].iat[0] == 0 else (1, 2))]
            if not (len(sides[0]) and len(sides[1])):
                continue
            n, m = (x["n"].to_numpy(np.int64) for x in sides)
            both = _overlaps(*([np.frombuffer(c, "<u8") for c in x["columns"]] for x in sides))
            linked = 100 * both >= percent * (n[:, None] + m[None, :] - both)
            if part["side"].iat[0] == 0:
                np.fill_diagonal(linked, False)
            found.append(pd.DataFrame({"print": sides[0]["print"], "partners": linked @ sides[1]["weight"].to_numpy(np.int64)}))
            if part["side"].iat[0]:
                found.append(pd.DataFrame({"print": sides[1]["print"], "partners": sides[0]["weight"].to_numpy(np.int64) @ linked}))
        return pd.concat(found)

    return small.union(large).groupBy("task").applyInPandas(run, "print long, partners long").groupBy("print").agg(F.sum("partners").alias("partners"))


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, counts: bool = False) -> DataFrame:
    """``id_col``, n_shingles, component_id: the smallest id that links reach.

    ``counts``: with n_links, the number of other rows that the row is linked to.
    """
    read = stored(row_sets(docs, id_col, text_col, words), "sets")
    sets = read.where("gram IS NULL").drop("gram")
    entries, count = sets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    blocks, buckets = max(1, math.ceil(entries / BLOCK_ENTRIES)), max(1, math.ceil(count / BUCKET_ROWS), math.ceil(entries / BUCKET_ENTRIES))
    heavy = Heavy(read.where("gram IS NOT NULL").select("gram", "n"), entries, blocks)
    shared = _shared_columns(_column_blocks(docs, text_col, words, blocks, heavy), blocks, buckets, heavy)
    rows = stored(_prefixes(shared, percent), "rows")

    # at: the column's place in the row's order, the rarest first; rank: rows with few columns of their own are in the middle of a group
    rank = F.struct((F.col("lone").cast("long") * 1_000_000 / F.col("n")).cast("long").alias("share"), "print")
    entries = rows.select("print", "n", F.col("lone").alias("_lone"), rank.alias("rank"), F.posexplode("prefix").alias("at", "gram")).withColumn("at", F.col("at") + F.col("_lone")).drop("_lone")
    entries, tested, links, pivots = entries.withColumn("root", F.col("print")), None, None, 0
    total = rows.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    # what follows the first common column bounds the overlap, and so do sizes; products of sizes pass 32 bits
    fits = f"least(n, m) * 100L >= {percent}L * greatest(n, m) AND least(n - at, m - u_at) * {100 + percent}L >= {percent}L * (0L + n + m)"
    while True:
        own = entries.groupBy("gram", "root").agg(F.min(F.struct("rank", "n", "root", "at")).alias("head"), F.count("*").alias("own"))
        heads = own.groupBy("gram").agg(F.min("head").alias("head"), F.count("*").alias("roots"), ((F.sum("own") * F.sum("own") - F.sum(F.col("own") * F.col("own"))) / 2).cast("long").alias("products"))
        heads = stored(heads.where("roots > 1").select("gram", F.col("head.rank").alias("u_rank"), F.col("head.n").alias("m"), F.col("head.root").alias("u_root"), F.col("head.at").alias("u_at"), "products"), "heads")
        products = heads.agg(F.coalesce(F.sum("products"), F.lit(0))).first()[0]
        if pivots and not products:
            break
        open_ = stored(entries.join(heads, "gram"), "open")
        last = pivots and products <= PRODUCTS * total
        if last:
            other = open_.select("gram", F.col("print").alias("u"), F.col("n").alias("m"), F.col("root").alias("u_root"), F.col("at").alias("u_at"))
            pairs = open_.select("gram", "print", "n", "root", "at").join(other, "gram").where(f"u < print AND u_root <> root AND {fits}")
        else:
            pairs = open_.withColumn("u", F.col("u_rank.print")).where(f"u <> print AND u_root <> root AND {fits}")
        pairs = pairs.select(F.least("u", "print").alias("u"), F.greatest("u", "print").alias("v")).distinct()
        pairs = stored(pairs.join(tested, ["u", "v"], "left_anti") if tested else pairs, "pairs")
        tested = tested.union(pairs) if tested else pairs
        found = stored(_linked(pairs, rows, percent), "links")
        links = links.union(found) if links else found
        of = graph.components(links)
        if last:
            break
        # a pivot is done with in its column
        pivots += 1
        entries = open_.where("rank > u_rank").select("print", "n", "rank", "at", "gram").join(of, F.col("print") == F.col("node"), "left").select("print", "n", "rank", "at", "gram", F.coalesce("root", "print").alias("root"))

    # one row a distinct set; then components, whose smallest id is that of their sets' smallest ones
    known = sets.groupBy("print").agg(F.first("n").alias("size"), F.min("id").alias("own"), F.count("*").alias("weight")).where("size > 0")
    known = stored(known.join(of, known["print"] == of["node"], "left").select("print", "own", "weight", F.coalesce("root", "print").alias("root")), "known")
    groups = stored(known.groupBy("root").agg(F.min("own").alias("least"), F.count("*").alias("members")).where("members > 1"), "groups")
    named = with_group(known, groups, ["root"], "members", known.count()).select("print", "weight", F.coalesce("least", "own").alias("least"))
    if counts:
        partners = stored(_link_counts(rows, of, known.select("print", "weight"), percent), "partners")
        named = named.join(partners, "print", "left").withColumn("n_links", F.col("weight") - 1 + F.coalesce("partners", F.lit(0))).drop("partners")
    out = with_group(sets.where("n > 0"), stored(named, "named"), ["print"], "weight", count)
    empty = sets.where("n = 0").withColumn("least", F.col("id"))
    more = ["n_links"] if counts else []
    empty = empty.withColumn("n_links", F.lit(0).cast("long")) if counts else empty
    columns = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), *more]
    return out.select(columns).union(empty.select(columns))
