"""SentencePiece encoding and decoding through a table of distinct chunks.

The model marks every space with U+2581.  Where no piece holds a marker behind
another character, merges never cross from a word into the following markers,
so a text falls into independent chunks ``markers + word``.

A first pass counts the distinct words of the whole corpus, combined before the
shuffle.  The ``HEAD_ROWS`` most frequent ones of at most ``HEAD_CHARS``
characters are segmented once, by the library, and sent to all tasks as a table
of ids and decoded text; both constants bound its size.  The second pass looks
up all words of a batch at once and joins ids back by position.  Rarer words
are segmented where they occur, once a batch, and so are texts with runs of
spaces, spaces at an end or markers of their own, and texts of over
``SEGMENT_CHARS`` characters, which are read a segment at a time.  Texts aren't
shuffled.

Nulls count as empty; an empty text has no ids and decodes to an empty text.
Repeated rows give repeated rows, an empty table none; columns other than id
and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import text_of

MARK = "▁"
#: Chunks that a task's table holds before it starts anew, and the longest chunk it keeps.
TABLE_ROWS, KEPT_CHARS = 200_000, 200
#: Characters of a text that are cut into chunks at a time.
SEGMENT_CHARS = 500_000
#: Words of the shared table, and the longest one.
HEAD_ROWS, HEAD_CHARS = 200_000, 64
#: Texts whose words are looked up at once, and their bytes, one more text aside.
BATCH_ROWS, BATCH_BYTES = 2_000, 2_000_000


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkTable:
    """Encodes and decodes as the library does, segmenting each distinct chunk once."""

    chunk = re.compile(f"{MARK}+[^{MARK}]*")
    border = re.compile(f"(?<=[^{MARK}]){MARK}")

    def __init__(self, proto: bytes, rows: int = TABLE_ROWS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.rows = rows
        self.table: dict[str, tuple[int, str, str]] = {}
        crossing = [p for p in map(self.model.id_to_piece, range(self.model.get_piece_size())) if MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces cross white space: {crossing[:3]}")

    def entry(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), ",".join(map(str, ids)), " " + self.model.decode(ids)

    def entries(self, text: str) -> Iterator[list[tuple[int, str, str]]]:
        """(number of ids, ids, decoded text) of each chunk in order, some chunks at a time."""
        marked, at = MARK + text.replace(" ", MARK), 0
        while at < len(marked):
            cut = self.border.search(marked, at + SEGMENT_CHARS)
            end = cut.start() if cut else len(marked)
            chunks = self.chunk.findall(marked, at, end)
            at, table = end, self.table
            try:
                yield [table[c] for c in chunks]
                continue
            except KeyError:
                new = list({c for c in chunks if c not in table})
            if len(table) > self.rows:
                table.clear()
                new = list(set(chunks))
            # the library puts one marker before what it is given
            found = dict(zip(new, map(self.entry, self.model.encode([c[1:] if len(c) > 1 else "" for c in new])), strict=True))
            if MARK in found:  # an empty text has no ids, but a last space behind a word has
                found[MARK] = self.lone_mark()
            table.update((c, e) for c, e in found.items() if len(c) <= KEPT_CHARS)
            yield [found.get(c) or table[c] for c in chunks]

    def lone_mark(self) -> tuple[int, str, str]:
        return self.entry([self.model.piece_to_id(MARK)])

    def digests(self, text: str) -> tuple[int, str, str]:
        total, ids, decoded, first = 0, hashlib.sha256(), hashlib.sha256(), True
        for part in self.entries(text) if text else ():
            total += sum(e[0] for e in part)
            joined, plain = ",".join([e[1] for e in part]), "".join([e[2] for e in part])
            ids.update((joined if first else "," + joined).encode())
            decoded.update((plain[1:] if first else plain).encode())
            first = False
        return total, ids.hexdigest(), decoded.hexdigest()

    def ids(self, text: str) -> list[int]:
        return [int(i) for part in self.entries(text) for e in part for i in e[1].split(",")] if text else []

    def decoded(self, text: str) -> str:
        return "".join(e[2] for part in self.entries(text) for e in part)[1:] if text else ""


def _proto(model: str) -> bytes:
    with open(model, "rb") as f:
        return f.read()


def _plain(texts):
    """Which of the texts fall into words by single spaces alone."""
    import pyarrow.compute as pc

    odd = pc.equal(texts, "")
    for test in (pc.match_substring(texts, "  "), pc.match_substring(texts, MARK), pc.starts_with(texts, " "), pc.ends_with(texts, " "), pc.greater(pc.binary_length(texts), SEGMENT_CHARS)):
        odd = pc.or_(odd, test)
    return pc.invert(odd)


def _parts(texts, rows: int):
    """Where each run of at most ``rows`` texts and about ``BATCH_BYTES`` bytes begins, and how many it has."""
    import numpy as np
    import pyarrow.compute as pc

    full = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // BATCH_BYTES
    starts = np.flatnonzero((np.diff(full, prepend=-1) > 0) | (np.arange(len(texts)) % rows == 0))
    return zip(starts.tolist(), np.diff(starts, append=len(texts)).tolist(), strict=True)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n: how often each distinct word occurs in the whole corpus."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for texts in (b.column(0).slice(at, n) for b in batches for at, n in _parts(b.column(0), BATCH_ROWS)):
            found = pc.value_counts(pc.split_pattern(texts.filter(_plain(texts)), " ").flatten())
            yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["word", "n"])

    return docs.select(text_of(text_col).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _segmented(model, words: list[str]):
    """The table's columns for some words, each segmented once: word, n, ids, written (ids as text), decoded, same (as the word)."""
    import pyarrow as pa

    ids = model.encode(words) if words else []
    decoded = model.decode(ids) if words else []
    return pa.table({
        "word": pa.array(words, pa.string()), "n": pa.array(map(len, ids), pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32())), "written": pa.array([",".join(map(str, i)) for i in ids], pa.string()),
        "decoded": pa.array(decoded, pa.string()), "same": pa.array([w == d for w, d in zip(words, decoded, strict=True)], pa.bool_()),
    })


def head(docs: DataFrame, proto: bytes, text_col: str = "text"):
    """The shared table: the most frequent words, segmented in one task each."""

    def run(batches):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        for batch in batches:
            yield from _segmented(model, batch.column(0).to_pylist()).to_batches()

    top = word_counts(docs, text_col).where(F.char_length("word") <= HEAD_CHARS).orderBy(F.desc("n"), "word").limit(HEAD_ROWS).select("word")
    # HEAD_ROWS rows of bounded length at most
    return top.mapInArrow(run, "word string, n long, ids array<int>, written string, decoded string, same boolean").toArrow().combine_chunks()


class Segmenter:
    """Looks up the words of many texts at once; what the shared table lacks is segmented here."""

    def __init__(self, proto: bytes, shared):
        self.table, self.shared = ChunkTable(proto), shared

    def places(self, words):
        """Row numbers of words in a table, and that table."""
        import pyarrow as pa
        import pyarrow.compute as pc

        at = pc.index_in(words, value_set=self.shared["word"])
        missing = pc.is_null(at)
        if not pc.any(missing).as_py():
            return at.to_numpy(), self.shared
        others = words.filter(missing)
        new = pc.unique(others)
        own = pc.add(pc.index_in(others, value_set=new), pa.scalar(self.shared.num_rows, pa.int32()))
        found = _segmented(self.table.model, new.to_pylist()).select(self.shared.column_names).cast(self.shared.schema)
        return pc.replace_with_mask(at, missing, own).to_numpy(), pa.concat_tables([self.shared, found])

    def _looked_up(self, texts):
        """For plain texts: offsets of their words, row numbers, the table, ids and running sums of ids."""
        import numpy as np
        import pyarrow.compute as pc

        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy()
        at, table = self.places(lists.flatten())
        total = np.concatenate([[0], np.cumsum(table["n"].to_numpy()[at])])
        return offsets - offsets[0], at, table, total

    @staticmethod
    def _column(table, name: str):
        column = table[name]
        return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()

    def _joined(self, table, name: str, at, offsets, mark: str):
        import pyarrow as pa
        import pyarrow.compute as pc

        values = self._column(table, name).take(pa.array(at))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), mark)

    def batch(self, texts, whole: bool):
        """Of each text (number of ids, digests of ids and decoded text), or with ``whole`` (ids, decoded text)."""
        import numpy as np
        import pyarrow as pa

        plain = _plain(texts).to_numpy(zero_copy_only=False)
        odd = (lambda t: (self.table.ids(t), self.table.decoded(t))) if whole else self.table.digests
        out = [None if p else odd(t.as_py()) for p, t in zip(plain.tolist(), texts, strict=True)]
        if not plain.any():
            return out
        texts = texts.filter(pa.array(plain))
        offsets, at, table, total = self._looked_up(texts)
        ends = total[offsets]
        same = np.add.reduceat(~table["same"].to_numpy()[at], offsets[:-1]) == 0
        decoded = texts if same.all() else self._joined(table, "decoded", at, offsets, " ")
        decoded = decoded.cast(pa.binary())
        if whole:
            ids = self._column(table, "ids").take(pa.array(at)).flatten().to_numpy()
            found = [(ids[a:b].tolist(), d.as_py().decode()) for a, b, d in zip(ends[:-1], ends[1:], decoded, strict=True)]
        else:
            sha = lambda x: hashlib.sha256(x.as_buffer()).hexdigest()
            written = self._joined(table, "written", at, offsets, ",").cast(pa.binary())
            found = [(n, sha(w), sha(d)) for n, w, d in zip((ends[1:] - ends[:-1]).tolist(), written, decoded, strict=True)]
        rest = iter(found)
        return [next(rest) if x is None else x for x in out]


def _encoded(docs: DataFrame, model: str, id_col: str, text_col: str, whole: bool) -> DataFrame:
    proto = _proto(model)
    shared = head(docs, proto, text_col)
    if not whole:
        shared = shared.drop_columns("ids")

    def run(batches):
        import pyarrow as pa

        segmenter = Segmenter(proto, shared)
        kinds = (pa.list_(pa.int32()), pa.string()) if whole else (pa.int64(), pa.string(), pa.string())
        names = ("ids", "decoded") if whole else ("n_tokens", "ids_sha256", "decoded_sha256")
        for batch in batches:
            for at, n in _parts(batch.column(1), BATCH_ROWS):
                part = batch.slice(at, n)
                columns = zip(*segmenter.batch(part.column(1), whole), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [id_col, *names])

    rows = docs.select(id_col, text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, " + ("ids array<int>, decoded string" if whole else "n_tokens long, ids_sha256 string, decoded_sha256 string"))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ids and decoded text of every row."""
    return _encoded(docs, model, id_col, text_col, True)


def encode_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode``, with the number of ids and digests in place of ids and text."""
    return _encoded(docs, model, id_col, text_col, False)
