"""The operators as stages of a corpus pipeline: (spark, docs, sf_dir) to documents.

Rows of ``docs`` keep their columns.  A null text is an empty one.  Rows are
told apart by a number of their own, as ids may repeat or be null: of rows that
share id and text, one stays after the dedup stages.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import apportion, exact, ngram_join, sentencepiece_table, toxicity
from wakeline.llm.common import stored, table

__all__ = ["encoded", "mixed", "stored", "without_copies", "without_near_copies", "without_toxic"]

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold."""
    return toxicity.kept(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``docs`` has."""
    held = {c.lower() for c in docs.columns}
    while name in held:
        name = "_" + name
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs``, stored with a number of each row and a key, the id, nulls last, and that number; and the names of both."""
    row, key = _free(docs, "_row"), _free(docs, "_key")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    return rows.withColumn(key, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))), row, key


def _without(docs: DataFrame, row: str, key: str, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``dropped``; Spark sends the list around only where it is small."""
    dropped = stored(dropped.select(F.col(f"{key}.row").alias(row)), "dropped")
    return docs.join(dropped, row, "left_anti").drop(row, key)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one that the dedup keeps."""
    docs, row, key = _numbered(docs)
    return _without(docs, row, key, exact.dedup(docs, key).where("NOT kept"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join, the one with the smallest id."""
    docs, row, key = _numbered(docs)
    return _without(docs, row, key, ngram_join.link(docs, key).where(F.col(f"{key}.row") != F.col("component_id.row")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, under the documents' ids: a row for words taken once or more, one for those taken twice."""
    rows, row, _ = _numbered(docs)
    more = _free(docs, "_cut")
    pieces = apportion.mix(rows, row_col=row).where("taken > 0").select(F.col("row").alias(row), F.struct("size", "pieces").alias(more))
    found = rows.join(pieces, row).select(*docs.columns, more)
    text, cut = docs.columns.index("text"), len(docs.columns)

    def taken(text: str, size: int, pieces: list[dict], level: int) -> str:
        own = [p for p in pieces if p["times"] >= level]
        if sum(p["end"] - p["first"] for p in own) == size:
            return text
        spans = [m.span() for m in WORD.finditer(text)]
        runs: list[list[int]] = []
        for p in own:
            if runs and runs[-1][1] == p["first"]:
                runs[-1][1] = p["end"]
            else:
                runs.append([p["first"], p["end"]])
        return "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in runs)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows, out = [], []
            for i, (t, c) in enumerate(zip(batch.column(text).to_pylist(), batch.column(cut).to_pylist(), strict=True)):
                t, n, p = t or "", c["size"], c["pieces"]
                for level in range(1, 1 + max(x["times"] for x in p)):
                    rows.append(i)
                    out.append(taken(t, n, p, level))
            kept = batch.take(pa.array(rows, pa.int64()))
            columns = [kept.column(i) for i in range(len(docs_columns))]
            columns[text] = pa.array(out, pa.string())
            if "n_chars" in docs_columns:
                columns[docs_columns.index("n_chars")] = pa.array(map(len, out), chars)
            yield pa.RecordBatch.from_arrays(columns, docs_columns)

    import pyarrow as pa

    docs_columns, chars = docs.columns, pa.int32() if dict(docs.dtypes).get("n_chars") == "int" else pa.int64()
    return found.mapInArrow(run, docs.schema)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids, digests of ids and of the decoded text."""
    return sentencepiece_table.encode_digests(docs, sentencepiece_table.public_model())
