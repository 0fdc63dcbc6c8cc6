"""Exact duplicates by composable polynomial fingerprints.

A text is normalised by deleting white space; its bytes are cut into chunks,
each hashed as a polynomial modulo two primes.  Hashes of neighbours combine as
``left * base ** len(right) + right``, so chunks of a huge document can be
hashed by different tasks and put together afterwards.  Texts of equal length
and fingerprint are then compared chunk by chunk with the first one that a task
meets, and these leads with one another; should one differ, its group is split
by SHA-256 of the normalised text.

Nothing is matched by id.  Nulls count as empty texts, which are equal to one
another.  Of equal texts the one with the most code points stays, then the
smallest id; a null id comes last.  ``kept`` says whether the row's id is the
one that stays, so rows that repeat id and text are kept together; a caller who
needs one of them gives an id that doesn't repeat.  One id may have several
texts.  Texts of any length are read whole; other columns are ignored, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import stored, text_of, with_group

#: Two primes and a base for each; with chunks of 4096 bytes all sums stay below 2 ** 53.
PRIMES, BASES = (2147483647, 2147483629), (1000003, 998244353)
CHUNK = 4096
#: Texts of more characters are hashed segment by segment in tasks of their own.
HUGE_CHARS = 8_000_000
#: Bytes of a chunk when texts are compared, leads of a group that meet in one step, bytes of leads that a task holds.
COMPARED_BYTES, MEMBERS, HELD_BYTES = 65_536, 64, 64 << 20
#: Texts that are hashed at once.
BATCH_ROWS = 1_000
DELETED = b" \t\n\v\f\r"


def combine(left: tuple[int, ...], right: tuple[int, ...], length: int) -> tuple[int, ...]:
    """The fingerprint of a text from those of its halves; ``length``: bytes of the right one."""
    return tuple((a * pow(base, length, p) + b) % p for a, b, base, p in zip(left, right, BASES, PRIMES, strict=True))


def _powers(base: int, p: int) -> np.ndarray:
    out = [1]
    for _ in range(CHUNK - 1):
        out.append(out[-1] * base % p)
    return np.array(out[::-1], float)


class Hasher:
    """Chunk hashes by matrix product; exact, as every sum is below 2 ** 53."""

    def __init__(self):
        self.powers = np.stack([_powers(b, p) for b, p in zip(BASES, PRIMES, strict=True)], axis=1)
        self.shift = [pow(b, CHUNK, p) for b, p in zip(BASES, PRIMES, strict=True)]

    def __call__(self, data: bytes) -> tuple[int, ...]:
        found = [0] * len(PRIMES)
        head = len(data) % CHUNK
        values = np.frombuffer(data, np.uint8)
        if head:
            found = [int(x) % p for x, p in zip(values[:head].astype(float) @ self.powers[-head:], PRIMES, strict=True)]
        for at in range(head, len(data), CHUNK * 256):
            for row in (values[at : at + CHUNK * 256].reshape(-1, CHUNK).astype(float) @ self.powers).tolist():
                found = [(f * s + int(x)) % p for f, s, x, p in zip(found, self.shift, row, PRIMES, strict=True)]
        return tuple(found)


def packed(pair: tuple[int, ...]) -> int:
    return pair[0] << 31 | pair[1]


def fingerprints(docs: DataFrame, id_col: str, text_col: str, huge_chars: int = HUGE_CHARS, texts: bool = False) -> DataFrame:
    """id, points (code points of the text), bytes (of the normalised one), print, sha; with ``texts``, data (the normalised text) in place of sha."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    last = "data binary" if texts else "sha string"
    schema = f"id {dict(docs.dtypes)[id_col]}, points long, bytes long, print long, {last}"
    names = ["id", "points", "bytes", "print", last.split(" ")[0]]
    points = F.char_length("text")
    plain = F.translate("text", " \t\n\v\f\r", "")

    def whole(batches):
        import pyarrow as pa

        hasher = Hasher()
        for batch in (b.slice(at, BATCH_ROWS) for b in batches for at in range(0, b.num_rows, BATCH_ROWS)):
            out = []
            for text in batch.column(2).cast(pa.binary()):
                data = text.as_py().translate(None, DELETED)
                out.append((len(data), packed(hasher(data)), data if texts else hashlib.sha256(data).hexdigest()))
            n, prints, more = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(prints, pa.int64()), pa.array(more, pa.binary() if texts else pa.string())], names)

    def part(batches):
        import pyarrow as pa

        hasher = Hasher()
        for batch in batches:
            out = []
            for text in batch.column(1).cast(pa.binary()):
                data = text.as_py().translate(None, DELETED)
                out.append((len(data), packed(hasher(data))))
            n, prints = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.int64())], ["at", "bytes", "print"])

    def together(batches):
        import pyarrow as pa

        for batch in batches:
            found = []
            for parts in batch.column(3).to_pylist():
                left, size = (0, 0), 0
                for x in parts:
                    left, size = combine(left, (x["print"] >> 31, x["print"] & (1 << 31) - 1), x["bytes"]), size + x["bytes"]
                found.append((size, packed(left)))
            n, prints = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(prints, pa.int64()), batch.column(2)], names)

    small = rows.where(points <= huge_chars).select("id", points.cast("long").alias("points"), "text").mapInArrow(whole, schema)
    # the original text's digest names its parts while they are apart; rows that share it share the parts
    huge = rows.where(points > huge_chars).select("id", "text", points.cast("long").alias("points"), F.sha2("text", 256).alias("name"))
    size = huge_chars // 4 + 1
    cut = huge.select("name", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((points - 1) / size)), lambda i: F.substring("text", (i * size + 1).cast("int"), F.lit(size)))).alias("no", "text"))
    parts = cut.repartition("name", "no").select(F.struct("name", "no").alias("at"), "text").mapInArrow(part, "at struct<name:string,no:int>, bytes long, print long")
    parts = parts.groupBy(F.col("at.name").alias("name")).agg(F.array_sort(F.collect_set(F.struct("at.no", "bytes", "print"))).alias("parts"))
    # SHA-256 runs through a text from its begin; Spark's own function does it
    about = huge.select("name", "id", "points", plain.cast("binary").alias("data") if texts else F.sha2(plain, 256).alias("sha"))
    return small.unionByName(about.join(parts, "name").select("id", "points", names[-1], "parts").mapInArrow(together, schema))


def compared(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str, huge_chars: int = HUGE_CHARS) -> DataFrame:
    """(bytes, print) of groups of which some text differs from another one.

    A task keeps the first text of each group that it meets and holds the
    others against it chunk by chunk.  The first ones' chunks, and the first
    chunk in which a text differs, go on: ``MEMBERS`` tasks' leads meet, then
    what is left of them, so that no group meets in one task as a whole.
    """
    members = fingerprints(docs, id_col, text_col, huge_chars, True).join(groups.select("bytes", "print"), ["bytes", "print"]).select("bytes", "print", "data")
    # a stage of its own, so that no task needs two Python workers at a time
    members = stored(members, "members")

    def leads(batches):
        import pyarrow as pa

        held, size = {}, 0
        for batch in batches:
            for key, print_, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data, lead = memoryview(data.as_buffer()), held.get((key, print_))
                places = range(0, len(data), COMPARED_BYTES)
                if lead is None:
                    if size + len(data) > HELD_BYTES:
                        held, size = {}, 0
                    held[key, print_] = bytes(data)
                    size += len(data)
                else:
                    places = [at for at in places if data[at : at + COMPARED_BYTES] != lead[at : at + COMPARED_BYTES]][:1]
                for at in places:
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([print_], pa.int64()), pa.array([at], pa.int64()), pa.array([bytes(data[at : at + COMPARED_BYTES])], pa.binary())], ["bytes", "print", "at", "chunk"])

    chunks = members.mapInArrow(leads, "bytes long, print long, at long, chunk binary").withColumn("lot", F.floor(F.spark_partition_id() / MEMBERS))
    key = ["bytes", "print", "at"]
    few = chunks.groupBy(*key, "lot").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
    return few.groupBy(*key).agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least <> most").select("bytes", "print").distinct()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge_chars: int = HUGE_CHARS) -> DataFrame:
    """``id_col``, keep_id, group_size, kept, text_sha256: one row per row of ``docs``."""
    prints = stored(fingerprints(docs, id_col, text_col, huge_chars), "prints")
    groups = stored(prints.groupBy("bytes", "print").agg(F.count("*").alias("n")).where("n > 1"), "groups")
    differ = stored(compared(docs, groups, id_col, text_col, huge_chars), "differ")
    if differ.isEmpty():
        split = F.lit("")
    else:
        prints = prints.join(differ.withColumn("split", F.lit(True)), ["bytes", "print"], "left")
        split = F.when(F.col("split"), F.col("sha")).otherwise("")
    prints = prints.withColumn("text_no", split)
    keys = ["bytes", "print", "text_no"]
    best = F.struct(-F.col("points"), F.col("id").isNull(), F.col("id"))
    kept = prints.groupBy(*keys).agg(F.min(best).alias("best"), F.count("*").alias("size")).where("size > 1")
    found = with_group(prints, stored(kept, "kept"), keys, "size", prints.count())
    alone = F.col("size").isNull()
    keep_id = F.when(alone, F.col("id")).otherwise(F.col("best.id"))
    return found.select(F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep_id).alias("kept"), F.col("sha").alias("text_sha256"))
