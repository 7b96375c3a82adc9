"""The border check of adjacent tokens against merging their bytes from scratch."""

import random

import public_tokenizers

from trailforge.llm import byte_bpe


def merged(ranks: dict[bytes, int], data: bytes) -> list[bytes]:
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, at = min((ranks.get(x + y, byte_bpe.NEVER), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == byte_bpe.NEVER:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def test_pairs_as_merged():
    bpe, r = byte_bpe.loaded(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN), random.Random(7)
    tokens = sorted(bpe.split)
    runs = [t for t in tokens if len(set(bpe.vocab[t])) == 1]  # ties in rank
    short = [t for t in tokens if len(bpe.vocab[t]) <= 3]
    seen = set()
    for pool in (tokens, short, runs):
        for _ in range(6_000):
            a, b = r.choice(pool), r.choice(pool)
            x, y = bpe.vocab[a], bpe.vocab[b]
            fits = bpe.compatible(a, b)
            assert fits == (merged(bpe.ranks, x + y) == [x, y]), (x, y)
            seen.add(fits)
    same = [t for t in runs if bpe.vocab[t][:1] == b" "]
    for a in same:
        for b in same:
            assert bpe.compatible(a, b) == (merged(bpe.ranks, bpe.vocab[a] + bpe.vocab[b]) == [bpe.vocab[a], bpe.vocab[b]])
    assert seen == {True, False}
