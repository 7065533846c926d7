"""Documents packed into sequences, in order, by dynamic programming.

Tokens of documents in the given order form one stream. Cuts may fall between documents, after sentences (at a price) and,
where a stretch has neither, at any 64th token (at a higher price). Over the cuts, f(j) is the least padding plus price of
the stream up to j; the window that ends at j starts at the least f(i) + i within reach, which a monotone queue holds. A
window whose length is a power of two needs no padding and is looked up directly.
"""

from __future__ import annotations

import zlib
from array import array
from base64 import b64decode
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
END_ID = 1
BLOCK = 1 << 20
SENTENCE_PRICE = 8.0
TOKEN_PRICE = 64.0
SHORT_PRICE = 16.0
#: A stretch without a cut that is longer than GAP gets one at every STEP tokens.
GAP, STEP = 512, 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of texts as bytes (unsigned, little-endian, 32 bits), as the tokenizer file gives them.

    The same vocabulary as ranks gives the same ids several times faster; only texts that hold the special token's name, to
    which the tokenizer gives an id of its own, go to the tokenizer itself.
    """

    SPECIAL = "<|endoftext|>"

    def __init__(self, tokenizer_file: str, rank_file: str):
        import tiktoken

        lines = (line.split() for line in open(rank_file, "rb"))
        bytes_of = {int(rank): b64decode(token) for token, rank in lines}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in bytes_of.items()}, special_tokens={})
        self.tokenizer_file, self.whole = tokenizer_file, None
        top = max(bytes_of) + 2
        self.closes, self.opens, self.breaks = (np.zeros(top, dtype=bool) for _ in range(3))
        for i, b in bytes_of.items():
            self.closes[i] = b.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?")
            self.opens[i] = b[:1] in (b" ", b"\n", b"\t", b"\r")
            self.breaks[i] = b"\n" in b

    def __call__(self, text: str) -> bytes:
        if self.SPECIAL not in text:
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.tokenizer_file)
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()


@lru_cache(maxsize=2)
def _encoder(tokenizer_file: str, rank_file: str) -> Encoder:
    return Encoder(tokenizer_file, rank_file)


def possible_cuts(ids: np.ndarray, ends: np.ndarray, encoder: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """Positions (from 0 to the stream's length) and their prices; ends: positions after each document."""
    n = len(ids)
    price = np.full(n + 1, np.inf)
    after = encoder.breaks[ids[:-1]] | (encoder.closes[ids[:-1]] & encoder.opens[ids[1:]])
    price[1:n][after] = SENTENCE_PRICE
    price[ends] = 0.0
    price[0] = 0.0
    at = np.flatnonzero(np.isfinite(price))
    for i in np.flatnonzero(np.diff(at) > GAP):
        price[at[i] + STEP : at[i + 1] : STEP] = TOKEN_PRICE
    tail = price[max(0, n - LENGTH) :]
    tail[np.isinf(tail)] = TOKEN_PRICE
    at = np.flatnonzero(np.isfinite(price))
    return at, price[at]


def best_cuts(at: np.ndarray, price: np.ndarray, length: int = LENGTH) -> list[int]:
    """Positions at which the cheapest packing cuts, the first and last included."""
    where: dict[int, list[int]] = {}
    size = 1
    while size < length:
        start = np.searchsorted(at, at - size)
        for j in np.flatnonzero((at >= size) & (at[start] == at - size)).tolist():
            where.setdefault(j, []).append(int(start[j]))
        size *= 2
    place, cost = at.tolist(), price.tolist()
    f, back = [0.0] * len(place), [0] * len(place)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, len(place)):
        p = place[j]
        while place[queue[0][1]] < p - length:
            queue.popleft()
        least, i = queue[0]
        least += length - p
        for k in where.get(j, ()):
            if f[k] + SHORT_PRICE < least:
                least, i = f[k] + SHORT_PRICE, k
        f[j] = least + cost[j]
        back[j] = i
        key = f[j] + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [place[-1]], len(place) - 1
    while j:
        j = back[j]
        cuts.append(place[j])
    return cuts[::-1]


def _pieces(doc_ids: list, encoded: list[bytes], first_sequence: int, encoder: Encoder) -> tuple[pd.DataFrame, int]:
    raw = b"".join(encoded)
    ids = np.frombuffer(raw, dtype="<u4")
    sizes = np.array([len(x) // 4 for x in encoded], dtype=np.int64)
    ends = np.cumsum(sizes)
    cuts = np.array(best_cuts(*possible_cuts(ids, ends, encoder)), dtype=np.int64)
    edges = np.union1d(cuts, np.concatenate(([0], ends)))
    a, b = edges[:-1], edges[1:]
    doc, seq = np.searchsorted(ends, a, side="right"), np.searchsorted(cuts, a, side="right") - 1
    crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    starts = ends - sizes
    rows = pd.DataFrame({
        "doc_id": pd.array([doc_ids[i] for i in doc.tolist()], dtype="Int64"),
        "start": a - starts[doc],
        "length": b - a,
        "ids_crc32": crc,
        "doc_tokens": sizes[doc],
        "sequence_id": first_sequence + seq,
        "offset": a - cuts[seq],
    })
    return rows, len(cuts) - 1


def pack(docs: DataFrame, tokenizer_file: str, rank_file: str, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The pieces of docs (doc_id, text, order columns) in sequences of at most LENGTH tokens.

    Documents keep their order (range partitions, sorted); a task packs blocks of about BLOCK tokens, and only a block's
    last tokens are split down to powers of two. Null and empty texts are one token, the end id. Repeated rows are packed
    once each; null doc_ids stay null. rank_file holds the vocabulary of tokenizer_file as ranks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer_file, rank_file)
        end = array("I", [END_ID]).tobytes()
        sequence = TaskContext.get().partitionId() << 36
        ids, encoded, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype("Int64").tolist(), batch["text"].tolist(), strict=True):
                tokens = encoder(text) + end
                ids.append(None if doc_id is pd.NA else doc_id)
                encoded.append(tokens)
                held += len(tokens) // 4
                if held >= BLOCK:
                    rows, n = _pieces(ids, encoded, sequence, encoder)
                    yield rows
                    sequence, ids, encoded, held = sequence + n, [], [], 0
        if ids:
            yield _pieces(ids, encoded, sequence, encoder)[0]

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *[F.col(c).alias(f"_order{i}") for i, c in enumerate(order)])
    keys = [f"_order{i}" for i in range(len(order))]
    keys.append(F.xxhash64("text"))  # so that null or repeated keys don't meet in one task
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return rows.select("doc_id", "text").mapInPandas(run, PIECES)


def tokenizer_files() -> tuple[str, str]:
    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """All documents, by doc_id, in sequences of 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), *tokenizer_files())
