"""Packing of tokenised documents into windows by the sum-of-squares rule.

Online: documents arrive one by one, what exceeds whole windows is placed at once, and no placement is revised while its
window is open. With N(h) windows filled to level h, a rest of s tokens goes where the sum over levels of N(h)**2 grows
least: into a window of level h with h + s <= size, or into a new one. The level array keeps, per level, its open windows.

Each task packs the documents of its partition. What is still open at its end, or when the open windows hold more than
``open_tokens``, is joined end to end and cut into full windows; the last rest is cut into pieces of power-of-two lengths,
which need no padding. So every window is full, or a power of two long.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from shoebox.llm.common import map_arrow, worker_memo

WINDOW = 4096
OPEN_TOKENS = 2 << 20
END_ID = 2
LINE = 1000  # new words encoded at once
CACHE_WORDS = 1_500_000  # words a Python worker remembers; the memory starts afresh beyond that
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


@dataclass
class Piece:
    doc_id: int | None
    start: int
    doc_tokens: int
    ids: bytes

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.doc_tokens, self.ids[: 4 * at]), Piece(self.doc_id, self.start + at, self.doc_tokens, self.ids[4 * at :])

    def __len__(self) -> int:
        return len(self.ids) // 4


@dataclass
class SumOfSquares:
    """The open windows of one task, by level; ``done`` gathers finished windows as lists of pieces."""

    size: int = WINDOW
    open_tokens: int = OPEN_TOKENS
    levels: list[list[list[Piece]]] = field(init=False)
    counts: np.ndarray = field(init=False)
    held: int = 0
    done: list[list[Piece]] = field(default_factory=list)

    def __post_init__(self):
        self.levels = [[] for _ in range(self.size)]
        self.counts = np.zeros(self.size + 1, dtype=np.int64)  # the last level, full, always counts 0

    def add(self, piece: Piece) -> None:
        while len(piece) >= self.size:
            whole, piece = piece.cut(self.size)
            self.done.append([whole])
        if len(piece):
            self._place(piece)
            if self.held > self.open_tokens:
                self.flush()

    def _place(self, piece: Piece) -> None:
        s, n = len(piece), self.counts
        # what the sum of squares gains by moving one window from level h to h + s; a new window starts at level 0
        up = 2 * n[s:] + 1
        up[-1] = 0
        gain = up - 2 * n[: self.size + 1 - s] + 1
        gain[0] = up[0]
        gain[1:][n[1 : self.size + 1 - s] == 0] = np.iinfo(np.int64).max
        h = len(gain) - 1 - int(np.argmin(gain[::-1]))  # ties: the fullest window
        window = self.levels[h].pop() if h else []
        window.append(piece)
        if h:
            n[h] -= 1
        if h + s == self.size:
            self.done.append(window)
            self.held -= h
        else:
            self.levels[h + s].append(window)
            n[h + s] += 1
            self.held += s

    def flush(self) -> None:
        """Closes all open windows: their pieces end to end, cut at full windows, the rest at powers of two."""
        pieces = [p for level in self.levels for window in level for p in window]
        left = sum(map(len, pieces))
        self.__post_init__()
        self.held = 0
        window, room = [], 0
        for piece in pieces:
            while len(piece):
                if not room:
                    room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
                    left -= room
                take, piece = piece.cut(min(room, len(piece)))
                window.append(take)
                room -= len(take)
                if not room:
                    self.done.append(window)
                    window = []


class Tokens(dict):
    """Words to their ids as little-endian 32-bit integers. The tokenizer never looks across ASCII white space, so a word's ids
    are the same in any text.
    """

    def __init__(self, file: str):
        super().__init__()
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)

    def _learn(self, words: list[bytes]) -> None:
        """Encodes new words. A word of letters is one piece to the tokenizer, so many are encoded as one line."""
        whole = [(w, t) for w in words if (t := w.decode("utf-8", "replace")).isalpha()]
        for at in range(0, len(whole), LINE):
            part = whole[at : at + LINE]
            got = self.tokenizer.encode(" ".join([t for _, t in part]), add_special_tokens=False)
            ids, piece = np.array(got.ids, dtype="<u4"), np.array(got.word_ids)
            starts = np.flatnonzero(np.diff(piece, prepend=-1)).tolist()
            if len(starts) == len(part):
                raw = ids.tobytes()
                self.update(zip((w for w, _ in part), (raw[4 * a : 4 * b] for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)), strict=True))
        rest = [w for w in words if w not in self]
        for word, got in zip(rest, self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False), strict=True):
            self[word] = np.array(got.ids, dtype="<u4").tobytes()

    def of_texts(self, texts: list[str]) -> Iterator[bytes]:
        if len(self) > CACHE_WORDS:
            self.clear()
        get, found, gaps, missed = self.get, [], [], {}
        for text in texts:
            words = text.encode("utf-8", "surrogatepass").split()
            ids = list(map(get, words))
            found.append(ids)
            at = -1
            for _ in range(ids.count(None)):
                at = ids.index(None, at + 1)
                gaps.append((ids, at, words[at]))
                missed[words[at]] = None
        plain = {w: _plain(w) for w in missed}
        self._learn([p for p in dict.fromkeys(p for parts in plain.values() for p in parts) if p not in self])
        for word, parts in plain.items():
            if len(parts) > 1 or parts[0] is not word:
                self[word] = b"".join([self[part] for part in parts])
        for ids, at, word in gaps:
            ids[at] = self[word]
        return map(b"".join, found)


def _plain(word: bytes) -> tuple[bytes, ...]:
    """Parts whose ids, one after the other, are the word's. The tokenizer lower-cases, and joins a letter with no mark: a full stop
    or comma after a letter is a part of its own, and words of letters alone need no entry for each spelling.
    """
    core, mark = (word[:-1], word[-1:]) if word[-1:] in (b".", b",") else (word, b"")
    text = core.decode("utf-8", "replace")
    if text.isalpha():
        core = core.lower()
    elif not text[-1:].isalpha():
        return (word,)
    return (core, mark) if mark else (core,)


def pack_documents(docs: DataFrame, tokenizer_file: str, window: int = WINDOW, end_id: int = END_ID, open_tokens: int = OPEN_TOKENS) -> DataFrame:
    """Pieces of every document of ``docs`` (doc_id, text) with their place: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    A document's ids are those of its whole text, then ``end_id``; a null text counts as empty and is that one id. Every
    id lies in exactly one piece, pieces of a sequence follow each other without gaps, and a sequence is ``window`` ids long or
    a power of two. Repeated rows are packed as often as they come, an empty table gives no rows, other columns are
    ignored. Sequence ids are unique, not dense: the upper bits are the partition's number. ``tokenizer_file`` must be
    readable on every executor.
    """
    last = int(end_id).to_bytes(4, "little")

    def run(slices: Iterator[pa.Table]) -> Iterator[pa.Table]:
        tokens = worker_memo(("words", tokenizer_file), lambda: Tokens(tokenizer_file))
        packer = SumOfSquares(window, open_tokens)
        number = (TaskContext.get().partitionId()) << 40

        def take() -> pa.Table:
            nonlocal number
            columns = [[] for _ in range(7)]
            for pieces in packer.done:
                offset = 0
                for p in pieces:
                    for column, value in zip(columns, (p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, number, offset), strict=True):
                        column.append(value)
                    offset += len(p)
                number += 1
            packer.done.clear()
            return pa.table([pa.array(c, "int64") for c in columns], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for rows in slices:
            for doc_id, ids in zip(rows["doc_id"].to_pylist(), tokens.of_texts([t or "" for t in rows["text"].to_pylist()]), strict=True):
                ids += last
                packer.add(Piece(doc_id, 0, len(ids) // 4, ids))
            yield take()
        packer.flush()
        yield take()

    return map_arrow(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, SCHEMA)
