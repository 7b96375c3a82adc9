"""Byte-level BPE by longest matches and backtracking, in time linear in the text.

The automaton (Aho-Corasick over the vocabulary, bytes read as Latin-1) tells
the longest token that starts at each place.  Tokens are taken greedily; a
token may follow another only if the two are *compatible*, that is, if merging
both together would leave the border between them alone (memoised by pair).
Where none fits, shorter prefixes are tried, then the last token is taken back
and its end is marked as dead, so no place is tried twice.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import resident, row_slices, sql_type, whole_text
from .stretches import Remembered, gather, stretches, utf8

#: Entries of each generation of a worker's memories (results don't depend on it).
MEMO = 150_000
#: A rank after all others.
NEVER = 1 << 62

# Letters and numbers assigned after Unicode 16.0, the version of the tiktoken library's patterns.
_LATER = "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD-A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EEE 11B0A 11DB0-11DF1 1246F 12475-1247F 12550-12686 16EA0-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DFFF 1E6C0-1E6FF 2B73A-2B73F 2B81E-2B81E 2CEA2-2CEAD 323B0-3FC3F"
_later = re.compile("[" + "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in _LATER.split()) + "]")


class Memo:
    """A bounded memory of two generations: what is used again moves to the younger one."""

    def __init__(self, make: Callable, size: int = MEMO) -> None:
        self.make, self.size, self.young, self.old = make, size, {}, {}

    def __call__(self, key):
        got = self.young.get(key)
        if got is None:
            got = self.old.get(key)
            if got is None:
                got = self.make(key)
            if len(self.young) >= self.size:
                self.old, self.young = self.young, {}
            self.young[key] = got
        return got


def parse_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """The ranks in a ``.tiktoken`` file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class BacktrackBPE:
    """Encoder and decoder for one table of ranks and one pattern of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.vocab = {r: b for b, r in ranks.items()}
        self._bytes, self._digits = _table(self.vocab), _table({r: b"%d," % r for r in self.vocab})
        self._pattern = regex.compile(pattern)
        self._stretches, self._matches = Remembered(self._make), Memo(self._match)
        self._compatible: dict[tuple[int, int], bool] = {}
        self._borders: tuple[dict[int, tuple[int, ...]], ...] = ({}, {})
        self.split: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.split[rank] = (rank, rank)
                continue
            parts = self._merged(token, rank)
            if len(parts) == 2:  # else merges never make it; only a whole pre-token can be it
                self.split[rank] = parts
                self.merge[parts] = rank
        self._trie = ahocorasick.Automaton()
        for rank in self.split:
            self._trie.add_word(self.vocab[rank].decode("latin-1"), (rank, len(self.vocab[rank])))
        self._trie.make_automaton()
        self.shorter: dict[int, tuple[int, int] | None] = {}
        for rank in self.split:
            token = self.vocab[rank]
            self.shorter[rank] = next(((r, n) for n in range(len(token) - 1, 0, -1) if (r := ranks.get(token[:n])) in self.split), None)

    def _merged(self, token: bytes, below: int) -> tuple[int, ...]:
        """What merges of a rank under ``below`` leave of ``token``."""
        ids = [self.ranks[token[i : i + 1]] for i in range(len(token))]
        while len(ids) > 2:
            best, at = below, -1
            for i, pair in enumerate(zip(ids, ids[1:], strict=False)):
                got = self.merge.get(pair)
                if got is not None and got < best:
                    best, at = got, i
            if at < 0:
                break
            ids[at : at + 2] = [best]
        return tuple(ids)

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE over the bytes of ``a`` and ``b`` yields just these two."""
        known = self._compatible.get((a, b))
        if known is None:
            if len(self._compatible) >= 4 * MEMO:
                self._compatible.clear()
            known = self._compatible[a, b] = self._check(a, b)
        return known

    def _border(self, token: int, side: int) -> tuple[int, ...]:
        """What stands at the first (0) or last (1) byte of ``token`` while it is made, from that byte to the whole, and ``NEVER``."""
        known = self._borders[side].get(token)
        if known is None:
            steps = [NEVER, token]
            while (part := self.split[steps[-1]][side]) != steps[-1]:
                steps.append(part)
            known = self._borders[side][token] = tuple(reversed(steps))
        return known

    def _check(self, a: int, b: int) -> bool:
        """Replay the merges that reach the border, by rank; none may join the two sides before both are whole."""
        left, right = self._border(a, 1), self._border(b, 0)
        i = j = 0
        while True:
            joint, grows_left, grows_right = self.merge.get((left[i], right[j]), NEVER), left[i + 1], right[j + 1]
            if joint < grows_left and joint <= grows_right:  # of equal ranks the leftmost merge comes first
                return False
            if grows_left == grows_right == NEVER:
                return True
            if grows_left <= grows_right:
                i += 1
            else:
                j += 1

    def encode_bytes(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest: list = [None] * n  # for each place, the longest token that starts there and its length
        for end, found in self._trie.iter(piece.decode("latin-1")):  # the longer later for a start
            longest[end + 1 - found[1]] = found
        dead = bytearray(n + 1)
        out: list[tuple[int, int]] = []
        pairs, shorter = self._compatible, self.shorter
        at, last, token = 0, -1, longest[0] if n else None
        while at < n:
            while token is not None:
                end = at + token[1]
                if not dead[end]:
                    if last < 0:
                        break
                    fits = pairs.get((last, token[0]))
                    if self.compatible(last, token[0]) if fits is None else fits:
                        break
                token = shorter[token[0]]
            if token is not None:
                out.append(token)
                at, last = end, token[0]
                token = longest[at] if at < n else None
            else:
                dead[at] = 1
                last, size = out.pop()
                at -= size
                token = shorter[last]
                last = out[-1][0] if out else -1
        return [t[0] for t in out]

    def find(self, text: str) -> list[str]:
        """The matches of the pattern; what ``_LATER`` lists is read as an unassigned character."""
        if text.isascii() or not _later.search(text):
            return self._pattern.findall(text)
        return [text[m.start() : m.end()] for m in self._pattern.finditer(_later.sub("\U0010ffff", text))]

    def _match(self, match: str) -> tuple[int, ...]:
        return tuple(self.encode_bytes(match.encode("utf-8")))

    def _piece(self, part: str) -> list[int] | tuple[int, ...]:
        word = part[1:] if part[:1] == " " else part
        if word.isalpha() and max(word) < "\u0250":
            return self.encode_bytes(part.encode())  # one match
        found = self.find(part)
        return self._matches(found[0]) if len(found) == 1 else tuple(chain.from_iterable(map(self._known, found)))

    def _known(self, match: str) -> tuple[int, ...]:
        return self._matches(match) if len(match) < 64 else self._match(match)

    def _make(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [self._piece(x.decode("utf-8", "surrogatepass")) for x in new]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and where each begins (and the last ends); special tokens are ordinary text.

        No match of the pattern crosses the place before a run of white space or
        that between a letter and a sign, and what stands before doesn't change
        the matches after it, so stretches are encoded one by one.
        """
        parts, first = stretches(*utf8(texts))
        ids, size = self._stretches(parts)
        return ids, np.concatenate([[0], np.cumsum(size)])[first]

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text]))[0].tolist()

    def decode_all(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each id's begin (and the last's end); an unknown id is a ``KeyError``."""
        return self._written(self._bytes, ids)

    def decode(self, ids: Iterable[int]) -> bytes:
        return self.decode_all(np.fromiter(ids, np.int64))[0].tobytes()

    def digits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in decimals, each followed by a comma, and where each begins (and the last ends)."""
        return self._written(self._digits, ids)

    def _written(self, table: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pool, ends = table
        known = (ids >= 0) & (ids < len(ends) - 1)
        if not known.all() or (ends[ids] == ends[ids + 1]).any():
            raise KeyError(next(i for i in ids.tolist() if i not in self.vocab))
        size = ends[ids + 1] - ends[ids]
        return gather(pool, ends[ids], size), np.concatenate([[0], np.cumsum(size)])


def _table(entries: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All entries joined by number, and where each begins (and the last ends)."""
    every = [entries.get(i, b"") for i in range(max(entries, default=-1) + 1)]
    return np.frombuffer(b"".join(every), np.uint8), np.concatenate([[0], np.cumsum(np.fromiter(map(len, every), np.int64, len(every)))])


def loaded(ranks_path: str, pattern: str) -> BacktrackBPE:
    """The tokenizer of a file, once a worker."""

    def load() -> BacktrackBPE:
        with open(ranks_path, "rb") as f:
            return BacktrackBPE(parse_ranks(f), pattern)

    return resident(("ranks", ranks_path, pattern), load)


def map_texts(docs: DataFrame, make: Callable[[BacktrackBPE, pa.Array], list[pa.Array]], schema: str, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, and the columns of ``schema``, which ``make`` gives for the tokenizer and an array of whole texts (null: empty)."""
    names = ["doc_id", *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(ranks_path, pattern)
        for batch in row_slices(batches):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *make(bpe, batch["text"])], names=names)

    ins = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    return ins.mapInArrow(run, f"doc_id {sql_type(docs, id_col)}, {schema}")


def _lists(bpe: BacktrackBPE, texts: pa.Array) -> list[pa.Array]:
    ids, bounds = bpe.encode_all(texts)
    return [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)``: the token ids of every text.

    A null text counts as empty, and an empty one has no ids; rows that repeat
    are encoded each; an empty table gives none; other columns are not read.
    """
    return map_texts(docs, _lists, "ids array<int>", ranks_path, pattern, id_col, text_col)


def decode(tokens: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, data)``: the bytes of every list of ids (null: none).

    An id that the table doesn't hold, or a null in a list, is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(ranks_path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([bpe.decode(x or ()) for x in batch["ids"].to_pylist()], pa.binary())], names=["doc_id", "data"])

    ins = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return ins.mapInArrow(run, f"doc_id {sql_type(tokens, id_col)}, data binary")


def _digests(bpe: BacktrackBPE, texts: pa.Array) -> list[pa.Array]:
    ids, bounds = bpe.encode_all(texts)
    ids = ids.astype(np.int64)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    listed, decoded = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = ids[a:b]
        listed.append(sha(bpe.digits(own)[0][:-1].tobytes()))
        decoded.append(sha(bpe.decode_all(own)[0].tobytes()))
    return [pa.array(np.diff(bounds)), pa.array(listed, pa.string()), pa.array(decoded, pa.string())]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: encode every document, decode the ids again, and return the digests of both."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return map_texts(docs, _digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
