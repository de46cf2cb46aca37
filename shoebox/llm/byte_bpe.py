"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token starts as a linked list of single bytes. Every adjacent pair whose joined bytes are a token waits in the bucket
of that token's rank, by position. A two-level bitmap over all ranks tells which buckets hold anything: find-first-set on the
top word and then on one leaf word gives the lowest rank, and its leftmost position is merged. A merge unlinks a node and
queues at most two new pairs; entries whose pair has changed since are stale and skipped when met. Each position enters a
bucket a bounded number of times per merge, so a pre-token of n bytes takes O(n log n) at worst, whatever its length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from shoebox.llm.common import map_arrow, worker_memo

LEAF_BITS = 256  # bits of a leaf word: a rank's word is rank >> 8, its bit rank & 255
CACHE_ENTRIES = 800_000  # encoded pre-tokens a Python worker remembers; the memory starts afresh beyond that


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 token and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Encoder(dict):
    """Pre-token (text) to its ids as little-endian 32-bit integers, encoded when first met."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.leaves = [0] * (max(ranks.values()) // LEAF_BITS + 1)  # the lower bitmap; all zero between pre-tokens

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        ids = b"".join([i.to_bytes(4, "little") for i in self.encode(piece.encode("utf-8", "surrogatepass"))])
        if len(piece) <= self.longest:
            self[piece] = ids
        return ids

    def encode(self, piece: bytes) -> list[int]:
        rank_of, longest, leaves = self.ranks.get, self.longest, self.leaves
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        after = list(range(1, n + 1))  # the start of the next token
        before = list(range(-1, n))
        waiting = [-1] * n  # the rank under which the pair that starts here is queued
        buckets: dict[int, list[int]] = {}  # rank to a heap of positions
        top = 0  # the upper bitmap: which leaf words are not zero
        for i in range(n - 1):
            rank = rank_of(piece[i : i + 2])
            if rank is not None:
                waiting[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    leaves[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)
        while top:
            leaf = (top & -top).bit_length() - 1
            word = leaves[leaf]
            rank = (leaf << 8) + (word & -word).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                leaves[leaf] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            if waiting[i] != rank:
                continue  # stale: this pair was merged away or has grown
            j = after[i]
            k = after[i] = after[j]
            waiting[i] = waiting[j] = -1
            h = before[i]
            if k < n:
                before[k] = i
                end = after[k]
                new = rank_of(piece[i:end]) if end - i <= longest else None
                if new is not None:
                    waiting[i] = new
                    if new in buckets:
                        heappush(buckets[new], i)
                    else:
                        buckets[new] = [i]
                        leaves[new >> 8] |= 1 << (new & 255)
                        top |= 1 << (new >> 8)
            if h >= 0:
                new = rank_of(piece[h:k]) if k - h <= longest else None
                if new is None:
                    waiting[h] = -1
                elif new != waiting[h]:
                    waiting[h] = new
                    if new in buckets:
                        heappush(buckets[new], h)
                    else:
                        buckets[new] = [h]
                        leaves[new >> 8] |= 1 << (new & 255)
                        top |= 1 << (new >> 8)
        ids, i, ranks = [], 0, self.ranks
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return ids


def decode(ids: bytes, tokens: list[bytes]) -> bytes:
    """The bytes of ids given as little-endian 32-bit integers."""
    return b"".join(map(tokens.__getitem__, memoryview(ids).cast("I").tolist()))


def token_table(ranks: dict[bytes, int]) -> list[bytes]:
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every whole text of ``docs`` (doc_id, text).

    ``pattern`` cuts a text into pre-tokens, each encoded by itself; there are no special tokens. ``ids`` are the ids as
    little-endian unsigned 32-bit integers, ``decoded_sha256`` is of the bytes they decode to. A null text counts as empty
    (no tokens). Rows are independent: repeated rows come back as often, an empty table gives no rows, other columns
    are ignored. ``rank_file`` must be readable on every executor.
    """

    def run(slices: Iterator[pa.Table]) -> Iterator[pa.Table]:
        import regex

        encoder, tokens = worker_memo(("bpe", rank_file), lambda: (e := Encoder(load_ranks(rank_file)), token_table(e.ranks)))
        cut = regex.compile(pattern)
        one = encoder.__getitem__
        for rows in slices:
            counts, sums, backs, kept = [], [], [], []
            for text in rows["text"].to_pylist():
                ids = b"".join(map(one, cut.findall(text or "")))
                counts.append(len(ids) // 4)
                sums.append(hashlib.sha256(ids).hexdigest())
                backs.append(hashlib.sha256(decode(ids, tokens)).hexdigest())
                if with_ids:
                    kept.append(ids)
            out = {"doc_id": rows["doc_id"], "n_tokens": pa.array(counts, "int64"), "ids_sha256": sums, "decoded_sha256": backs}
            yield pa.table(out | ({"ids": pa.array(kept, "binary")} if with_ids else {}))

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return map_arrow(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, schema)
