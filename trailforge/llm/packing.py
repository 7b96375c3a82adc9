"""Packing token streams into fixed-length sequences with a bounded number of open windows.

Each task keeps ``open_windows`` windows.  Whole windows are cut from the front
of a long document; the rest is placed where it leaves the least room.  Where
it fits nowhere, the fullest window is completed with a cut of the document if
its gap is over ``slack`` tokens, and emitted; so no window that a task emits
lacks more than ``slack`` tokens.  What is open at the end of every task is
merged by the same rule over all tasks, in groups of bounded size.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize, resident, row_slices, sql_type, whole_text
from .stretches import Remembered, stretches, utf8

WINDOW = 4096
OPEN = 32
SLACK = 48
#: Left-over windows that one task merges.
MERGED_TOGETHER = 50_000
#: New stretches given to the tokenizer at once.
MADE_AT_ONCE = 1_000


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as letters from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()


class WordTokenizer:
    """The ids of a tokenizer that drops white space, made by stretch.

    No pre-token crosses white space or the place between a letter and a sign,
    so the ids of a text are those of its stretches in order.  New stretches of
    Latin letters alone are one pre-token and go to the model; the others go to
    the whole tokenizer, as one text of which the words are given.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self._ids = Remembered(self._make)

    def _make(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found: list[list[int]] = [[]] * len(new)
        model, others = self.whole.model, []
        for i, raw in enumerate(new):
            part = raw.decode("utf-8", "surrogatepass")
            word = part.lstrip(" \t\n\v\f\r")
            if word.isalpha() and max(word) < "\u0250" and "\u0130" not in word:
                letters = word if word.isascii() else word.lower().encode().decode("latin-1").translate(_BYTE_LETTERS)
                found[i] = [t.id for t in model.tokenize(letters)]
            else:
                others.append((i, part))
        for at in range(0, len(others), MADE_AT_ONCE):
            places, parts = zip(*others[at : at + MADE_AT_ONCE], strict=True)
            made = self.whole.encode(parts, is_pretokenized=True, add_special_tokens=False)
            for i, own in groupby(zip(made.word_ids, made.ids, strict=True), key=itemgetter(0)):
                found[places[i]] = [x for _, x in own]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none), one text after the other, and where each begins (and the last ends)."""
        parts, first = stretches(*utf8(texts), lower=True)
        ids, size = self._ids(parts)
        return ids, np.concatenate([[0], np.cumsum(size)])[first]


class Packer:
    """Online best-fit over a fixed number of open windows; ``emit`` gets each piece and each closed window."""

    def __init__(self, size: int = WINDOW, windows: int = OPEN, slack: int = SLACK) -> None:
        self.size, self.windows, self.slack = size, windows, slack
        self.next = 0
        self.open: list[tuple[int, int]] = []  # (room, window), least room first

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, length: int, cut: bool = True) -> Iterator[tuple[int, int, int, int]]:
        """Pieces ``(start, length, window, offset)`` of a stream of ``length`` tokens."""
        start = 0
        while length - start >= self.size:
            yield start, self.size, self._new(), 0
            start += self.size
        while start < length:
            left = length - start
            i = bisect.bisect_left(self.open, (left, -1))
            if i < len(self.open):
                room, window = self.open.pop(i)
                take = left
            elif len(self.open) < self.windows:
                room, window, take = self.size, self._new(), left
            else:
                room, window = self.open.pop(0)
                if not cut or room <= self.slack:
                    continue  # full enough: it stays as it is
                take = room
            yield start, take, window, self.size - room
            start += take
            if room > take:
                bisect.insort(self.open, (room - take, window))

    def fill(self) -> dict[int, int]:
        """What the open windows hold."""
        return {window: self.size - room for room, window in self.open}


PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task bigint, window bigint, offset bigint"


def _pieces(ids: pa.Array, task: int, start, length, crc, total, window, offset) -> pa.RecordBatch:
    whole = [pa.array(x, pa.int64()) for x in (start, length, crc, total, [task] * len(ids), window, offset)]
    return pa.RecordBatch.from_arrays([ids, *whole], names=["doc_id", *(x.split()[0] for x in PIECES.split(", "))])


def _pack_partition(path: str, end_id: int, size: int, windows: int, slack: int, kind: pa.DataType):
    """A function for ``mapInArrow``: tokenizes and packs one partition; windows open at the end are marked by rows without a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        tok, packer = resident(("words", path), lambda: WordTokenizer(path)), Packer(size, windows, slack)
        for batch in row_slices(batches):
            every, bounds = tok.encode(batch["text"])
            rows, at = [], []
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                data = np.append(every[a:b], np.uint32(end_id)).astype("<u4")
                for start, length, window, offset in packer.place(len(data)):
                    rows.append((start, length, zlib.crc32(data[start : start + length]), len(data), window, offset))
                    at.append(i)
            yield _pieces(batch["doc_id"].take(pa.array(at, pa.int64())), task, *zip(*rows, strict=True))
        left = packer.fill()
        if left:
            none = [None] * len(left)
            yield _pieces(pa.nulls(len(left), kind), task, none, none, none, none, list(left), list(left.values()))

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, size: int = WINDOW, windows: int = OPEN, slack: int = SLACK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` of all documents.

    A null or empty text is its end id alone.  Repeated rows are packed each;
    ids may be null; an empty table gives no pieces.  Within a sequence offsets
    are gapless from 0.  Left-over windows are merged whole, so that the
    fingerprints of their pieces hold.
    """
    ins = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    kind = to_arrow_type(docs.schema[id_col].dataType)
    made = materialize(ins.mapInArrow(_pack_partition(tokenizer_path, end_id, size, windows, slack, kind), f"doc_id {sql_type(docs, id_col)}, {PIECES}"), "pieces")
    left = made.where("length is null").select("task", "window", F.col("offset").alias("fill"))
    count = left.count()
    groups = max(1, -(-count // MERGED_TOGETHER))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        group, packer = TaskContext.get().partitionId(), Packer(size, 4 * windows, slack)
        for pdf in batches:
            rows = [(task, window, group, into, at) for task, window, fill in zip(pdf["task"], pdf["window"], pdf["fill"], strict=True) for _, _, into, at in packer.place(fill, cut=False)]
            yield pd.DataFrame(rows, columns=["task", "window", "group_", "into", "at"])

    spread = left.repartition(groups, F.xxhash64("task", "window")).sortWithinPartitions(F.desc("fill"), "task", "window")
    merged = materialize(spread.mapInPandas(whole, "task bigint, window bigint, group_ bigint, into bigint, at bigint"), "merged")
    pieces = made.where("length is not null").join(merged, ["task", "window"], "left")
    # even ids: windows that a task closed; odd ids: merged ones
    sequence = F.coalesce(F.shiftleft("group_", 33) + F.col("into") * 2 + 1, F.shiftleft("task", 33) + F.col("window") * 2)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence.alias("sequence_id"), (F.col("offset") + F.coalesce("at", F.lit(0))).alias("offset"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: pack every document."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
