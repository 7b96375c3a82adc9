"""Document fingerprints: a homomorphic multiset hash over paragraphs.

Each paragraph is hashed to a wide vector of two parts, and a document's
fingerprint is the sum of its paragraphs' vectors:

* ``EXACT`` lanes modulo 2**64, pseudo-random in the whole paragraph: documents
  with other multisets of paragraphs differ here but for chance;
* ``ROUGH`` lanes modulo 2**32, which no text of Spark's can overflow: every stretch of ``GRAM`` bytes inside the
  paragraph (the whole of a shorter one) adds 1 or -1 to one lane.  Read as
  signed numbers they are a sketch whose cosine estimates how alike two texts
  are, even where a paragraph was edited.

Sums don't depend on order, and ``add`` and ``remove`` change a fingerprint by
one paragraph without the rest of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freed_id, held_id, id_kind, materialize, whole_text

EXACT, ROUGH, GRAM = 4, 128, 16  # a gram's lane and sign are 8 bits of its hash
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Rows of a bucket on average, and the most buckets.
ROWS, BUCKETS = 512, 10_000
#: Bytes hashed at once, which bounds the memory for a long paragraph.
CHUNK = 1 << 20


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of each ``GRAM`` bytes, by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    h *= _M1
    h ^= h >> np.uint64(29)
    width = 1
    while width < GRAM:
        h = h[:-width] * _M2 + h[width:]
        h ^= h >> np.uint64(31)
        width *= 2
    return h * _M3


def _rough(data: bytes) -> np.ndarray:
    """The rough lanes of all paragraphs in ``data``, which newlines separate."""
    out = np.zeros(2 * ROUGH, np.int64)
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, max(1, len(raw) - GRAM + 1), CHUNK):
        part = raw[at : at + CHUNK + GRAM - 1]
        if len(part) < GRAM:
            break
        h = _grams(part)
        gaps = np.flatnonzero(part == 10)
        if len(gaps):
            ok = np.cumsum(np.concatenate([[0], part == 10]), dtype=np.int32)
            h = h[ok[GRAM:] == ok[:-GRAM]]
        out += np.bincount((h >> np.uint64(56)).astype(np.int64), minlength=2 * ROUGH)
    return out[:ROUGH] - out[ROUGH:]


def paragraph_vector(paragraph: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Exact and rough lanes of one paragraph (bytes without a newline)."""
    digest = hashlib.blake2b(paragraph, digest_size=8 * EXACT).digest()
    exact = np.frombuffer(digest, "<u8").copy()
    rough = np.zeros(ROUGH, np.int64)
    if len(paragraph) >= GRAM:
        rough = _rough(paragraph)
    elif paragraph:
        lane = digest[0] % ROUGH
        rough[lane] = 1 if digest[1] & 1 else -1
    return exact, rough.astype(np.uint32)


class Fingerprint:
    """A sum of paragraph vectors."""

    def __init__(self, exact: np.ndarray | None = None, rough: np.ndarray | None = None) -> None:
        self.exact = np.zeros(EXACT, np.uint64) if exact is None else exact
        self.rough = np.zeros(ROUGH, np.uint32) if rough is None else rough

    @classmethod
    def of(cls, text: str) -> Fingerprint:
        """Of a whole text; its paragraphs are its lines, and empty ones count (an empty text is one of them)."""
        out, data = cls(), text.encode("utf-8", "surrogatepass")
        short = np.zeros(ROUGH, np.int64)
        exact = []
        for line in data.split(b"\n"):
            digest = hashlib.blake2b(line, digest_size=8 * EXACT).digest()
            exact.append(digest)
            if line and len(line) < GRAM:
                short[digest[0] % ROUGH] += 1 if digest[1] & 1 else -1
        out.exact = np.frombuffer(b"".join(exact), "<u8").reshape(-1, EXACT).sum(0, dtype=np.uint64)
        out.rough = (_rough(data) + short).astype(np.uint32)
        return out

    def add(self, paragraph: str) -> Fingerprint:
        exact, rough = paragraph_vector(paragraph.encode("utf-8", "surrogatepass"))
        return Fingerprint(self.exact + exact, self.rough + rough)

    def remove(self, paragraph: str) -> Fingerprint:
        exact, rough = paragraph_vector(paragraph.encode("utf-8", "surrogatepass"))
        return Fingerprint(self.exact - exact, self.rough - rough)

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact + other.exact, self.rough + other.rough)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and bool((self.exact == other.exact).all() and (self.rough == other.rough).all())

    def __hash__(self) -> int:
        return hash(self.hex())

    def hex(self) -> str:
        return self.exact.astype("<u8").tobytes().hex() + self.rough.astype("<u4").tobytes().hex()

    @classmethod
    def from_hex(cls, text: str) -> Fingerprint:
        data = bytes.fromhex(text)
        return cls(np.frombuffer(data[: 8 * EXACT], "<u8").copy(), np.frombuffer(data[8 * EXACT :], "<u4").copy())

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal fingerprints; else the cosine of the rough lanes, 0 at least."""
        if self == other:
            return 1.0
        a, b = self.rough.view(np.int32).astype(np.float64), other.rough.view(np.int32).astype(np.float64)
        size = float(np.sqrt((a @ a) * (b @ b)))
        return min(1.0, max(0.0, float(a @ b) / size)) if size else 0.0


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(bucket, tail, key, doc_id, text)``: each bucket holds a range of ids and, as ``tail``, the first row after it.

    Bounds are quantiles of the ids (at most ``BUCKETS`` numbers), so a bucket
    is a share of the rows; each text is shuffled once.  The last bucket's tail
    is the first row of all.  Null ids come first.  Ids that aren't whole numbers
    are ordered as texts: their distinct values are numbered by a sort first.
    """
    text = whole_text(text_col).alias("text")
    if docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        ins = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("key"), held_id(docs, id_col), text)
    else:
        named = docs.select(F.concat(F.lit("+"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("name"), F.col(id_col).isNull().alias("none"), held_id(docs, id_col), text)
        names = named.where("not none").select("name").distinct().repartitionByRange("name").sortWithinPartitions("name")
        names = materialize(names.withColumn("place", F.monotonically_increasing_id()), "id-order")
        ins = named.join(names, "name", "left").select(F.when(F.col("none"), F.lit(-(1 << 63))).otherwise(F.col("place")).alias("key"), "doc_id", "text")
    keys = ins.select("key")
    count = keys.count()
    buckets = max(1, min(BUCKETS, count // ROWS))
    bounds = np.zeros(0, np.int64)
    if buckets > 1:
        shares = [i / buckets for i in range(1, buckets)]
        bounds = np.unique(np.array(keys.agg(F.percentile_approx("key", F.lit(shares), F.lit(10 * buckets)).alias("c")).first().c, np.int64))

    @F.pandas_udf("int")
    def bucket_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="left").astype("int32"))

    first = dict(keys.groupBy(bucket_of("key").alias("b")).agg(F.min("key").alias("k")).collect())  # a number a bucket
    used = sorted(first)
    before = {first[b]: used[i - 1] for i, b in enumerate(used)}

    @F.pandas_udf("array<int>")
    def places(key: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, key.to_numpy(), side="left").tolist()
        return pd.Series([[b, before[k]] if k in before else [b] for b, k in zip(own, key.tolist(), strict=True)])

    placed = ins.select(F.posexplode(places("key")).alias("tail", "bucket"), "key", "doc_id", "text")
    return placed.repartition("bucket").sortWithinPartitions("bucket", "tail", "key", "text")


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit (see ``edit``), with their likeness and that to the next document.

    The next document is the one with the next greater id (rows that repeat an
    id: by text); after the last comes the first, and a single row is its own
    next.  Null texts are empty; empty texts are like 1 to each other and 0 to
    others.  An empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row that waits for its next: bucket, id, text, fingerprint
        for pdf in batches:
            out = []
            for bucket, tail, doc_id, text in zip(pdf["bucket"], pdf["tail"], pdf["doc_id"], pdf["text"], strict=True):
                if tail and (held is None or held[0] != bucket):
                    continue  # another row with the id of the tail
                fp = Fingerprint.of(text)
                if held is not None and held[0] == bucket:
                    _, own_id, own, own_fp = held
                    edited = edit(own, text)
                    edited_fp = Fingerprint.of(edited)
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((own_id, len(own), digest, own_fp.hex(), edited_fp.hex(), own_fp.likeness(edited_fp), own_fp.likeness(fp)))
                held = None if tail else (bucket, doc_id, text, fp)
            frame = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            yield frame

    schema = f"doc_id {id_kind(docs, id_col)}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    placed = with_next(docs, id_col, text_col).select("bucket", "tail", "doc_id", "text")
    return freed_id(placed.mapInPandas(run, schema), docs, id_col)


def edit(own: str, following: str) -> str:
    """``own`` with its last ``floor(n / 2)`` code points replaced by the first as many (or all) of ``following``."""
    half = len(own) // 2
    return own[: len(own) - half] + following[:half]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: fingerprints of every document and of its edited text."""
    return compare_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
