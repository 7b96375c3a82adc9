"""SimHash near-duplicates: pigeonring candidates, full Hamming check, components.

Texts with the same fingerprint are one node from the start, so copies are
never paired.  Two fingerprints of 64 bits that differ in at most ``budget``
bits, cut in ``SEGMENTS`` segments on a ring, have a start from which every run
of ``l`` segments differs in at most ``floor(l * budget / SEGMENTS)`` bits (the
pigeonring principle).  With two bits and seven segments the first three
segments of such a chain are equal: each distinct fingerprint is filed under
seven keys of three segments, and the rest of the chain is checked before the
full distance is.  A crowded key never emits its pairs: there, two members
within two bits share an intermediate value one bit from either, so members are
filed under themselves and their one-bit neighbours and hung on the least
member, which links exactly what the pairs would.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freed_id, held_id, id_kind, materialize, split_frames, whole_text
from .components import connected_components

SEED = 42
BUDGET = 2
SEGMENTS = 7
#: First bit of each segment, and the end.
CUTS = [64 * i // SEGMENTS for i in range(SEGMENTS + 1)]
#: Keys with more distinct fingerprints than this are linked through intermediate values.
CROWD = 48

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BITS = np.array([[b >> i & 1 for i in range(8)] for b in range(256)], dtype=np.int64)


def shingle_hashes(text: str, width: int) -> list[int]:
    """Hashes of a text's word shingles in order; a text of at most ``width`` words is one shingle, one without words has none."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(line, SEED)]
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    first, last = (end - size)[: 1 - width].tolist(), end[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(first, last, strict=True)]


def text_fingerprint(text: str, width: int = 3) -> int:
    """The SimHash of a text's word shingles as an unsigned integer; no words: 0."""
    hashes = shingle_hashes(text, width)
    if not hashes:
        return 0
    n = len(hashes)
    lanes = np.array(hashes, dtype="<u8").view(np.uint8).reshape(n, 8)
    if n < 64:
        count = np.unpackbits(lanes, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        count = np.concatenate([np.bincount(lanes[:, j], minlength=256) @ _BITS for j in range(8)])
    return int(np.packbits(count * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, fp)`` with the signed 64-bit fingerprint of each whole text (null: empty)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in split_frames(batches):
            fps = np.array([text_fingerprint(t, width) for t in pdf["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fps})

    ins = docs.select(held_id(docs, id_col), whole_text(text_col).alias("text"))
    return freed_id(ins.mapInPandas(run, f"doc_id {id_kind(docs, id_col)}, fp bigint"), docs, id_col)


def _field(start: int, size: int) -> Column:
    """``size`` bits of ``fp`` from bit ``start`` on the ring of 64."""
    got = F.shiftrightunsigned("fp", start)
    if start + size > 64:
        got = got.bitwiseOR(F.shiftleft("fp", 64 - start))
    return got.bitwiseAND(F.lit((1 << size) - 1))


def _chain(diff: Column, rotation: int) -> Column:
    """Whether the differing bits of a chain from ``rotation`` stay in budget for every length beyond the key."""
    ok = []
    for length in range(1, SEGMENTS + 1):
        parts = [(rotation + j) % SEGMENTS for j in range(length)]
        mask = functools.reduce(int.__or__, (((1 << (CUTS[s + 1] - CUTS[s])) - 1) << CUTS[s] for s in parts))
        mask -= (mask >> 63) << 64
        ok.append(F.bit_count(diff.bitwiseAND(F.lit(mask).cast("bigint"))) <= length * BUDGET // SEGMENTS)
    return functools.reduce(Column.__and__, ok)


def _keys(nodes: DataFrame) -> DataFrame:
    free = (SEGMENTS + BUDGET - 1) // BUDGET - 1  # segments of a chain that must be equal: l * BUDGET < SEGMENTS
    rows = []
    for r in range(SEGMENTS):
        size = sum(CUTS[(r + j) % SEGMENTS + 1] - CUTS[(r + j) % SEGMENTS] for j in range(free))
        rows.append(F.struct(F.lit(r).alias("r"), _field(CUTS[r], size).alias("key")))
    return nodes.select("fp", F.explode(F.array(*rows)).alias("k")).select("fp", "k.r", "k.key")


def links(nodes: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` that connect exactly the distinct fingerprints linked within ``BUDGET`` bits."""
    keys = _keys(nodes)
    shared = keys.groupBy("r", "key").agg(F.count("*").alias("n")).where("n > 1")
    filed = materialize(keys.join(shared, ["r", "key"]), "pigeonring")
    few = filed.where(F.col("n") <= CROWD)
    a, b = few.select("r", "key", F.col("fp").alias("u")), few.select("r", "key", F.col("fp").alias("v"))
    diff = F.col("u").bitwiseXOR(F.col("v"))
    chains = functools.reduce(Column.__or__, ((F.col("r") == r) & _chain(diff, r) for r in range(SEGMENTS)))
    pairs = a.join(b, ["r", "key"]).where("u < v").where(chains & (F.bit_count(diff) <= BUDGET)).select("u", "v")
    flips = F.array(F.lit(0).cast("bigint"), *(F.lit((1 << i) - ((1 << 64) if i == 63 else 0)).cast("bigint") for i in range(64)))
    between = filed.where(F.col("n") > CROWD).select("r", "key", "fp", F.explode(flips).alias("bit"))
    between = between.select("r", "key", "fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("z"))
    hubs = between.groupBy("r", "key", "z").agg(F.min("fp").alias("u"), F.max("fp").alias("top")).where("u <> top")
    hung = between.join(hubs, ["r", "key", "z"]).where("fp <> u").select("u", F.col("fp").alias("v"))
    return pairs.unionByName(hung).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)``: one row a document, the component's least reachable id.

    Nulls: a null text counts as empty (fingerprint zero, linked like any
    other); a null id is carried and never the least unless its whole component
    has none.  Repeated ids are separate documents.  An empty table gives none.
    """
    found = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    parts = connected_components(links(nodes.select("fp")))
    joined = nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    heads = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialize(joined.join(heads, "component").select("fp", "component_id"), "components")
    return found.join(named, "fp").select("doc_id", "fp", "component_id")


def heads_of(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """``docs`` whose id is their component's in ``ids``."""
    keep = ids.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("component_id").distinct()
    at = docs[id_col].eqNullSafe(keep["component_id"])
    return docs.join(keep.hint("merge"), at, "left_semi")  # the ids grow with the documents: sorted at every size


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those whose component has a smaller id; rows that repeat an id stay or go together."""
    return heads_of(docs, near_duplicates(docs, id_col, text_col), id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: fingerprint and component of every document."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
