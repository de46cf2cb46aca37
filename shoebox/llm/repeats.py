"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

Anchors. Of the grams (short substrings) inside a string of ``length`` bytes the one with the least hash is its anchor, leftmost on ties. Which gram
that is depends on the string alone, so equal strings have equal grams at their anchors. Consecutive starts share anchors: an entry
is an anchor with its run of starts, so there are few entries (about one for each ``window / 2`` bytes).

Index family. Documents come in batches. A batch's entries, sorted by the suffix that begins at the anchor (its first eight bytes,
then a digest of the gram), are a sparse suffix array. A new batch is merge-scanned, a join of sorted keys, with itself and with every
level of the family, which gives the grams that occur twice; it then becomes level 0. Before the next batch comes, levels of
equal size are merged into one of the next, so n batches leave log n levels and each entry is written log n times.

Verification. Only entries with repeated grams go on. Where the whole span under an entry's run is the same for two entries, every start of
the run is repeated. The rest (the entries at the ends of a repeated passage) is cut into blocks of ``BLOCK`` starts, at fixed distances from
the anchor, and treated alike: all strings that start in a block hold its core, so only blocks with a repeated core go on, and those with
the same span are settled. What is still open is compared start by start, by 128-bit digests of the ``length`` bytes. Of a span
that many share, one stands for all. Everything is counted by aggregation, no pairs are made.

Words. With ``unit`` WORD a text is the string of its words' 64-bit hashes, and lengths and places count words. A passage is then told by its
words alone, however few bytes they take and whatever white space is between them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import drop_written, map_arrow, materialize

LENGTH, WINDOW, BATCHES, BLOCK = 400, 257, 4, 16
WORDS, WORD_WINDOW = 51, 40
BYTE, WORD = 1, 8  # bytes of a unit
_RUN = re.compile(rb"\S+")
ENTRY = "prefix bigint, gram bigint, span bigint, doc_id bigint, row bigint, at int, lo int, hi int"
KEY = ["prefix", "gram"]
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def encoded(text: str | None, unit: int = BYTE) -> bytes:
    """The units of a text: its bytes, or the hashes of its words."""
    from xxhash import xxh64_intdigest

    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw if unit == BYTE else np.array([xxh64_intdigest(w) for w in raw.split()], dtype="<u8").tobytes()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Anchors:
    """Finds the entries of a text. Grams are hashed by a polynomial modulo 2 ** 64, all at once from its prefix sums."""

    def __init__(self, length: int, window: int, unit: int = BYTE):
        self.length, self.window, self.gram, self.unit = length, window, length - window + 1, unit
        self._grow(1 << 14)

    def _grow(self, n: int) -> None:
        self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        n, k = len(data), self.gram
        if n > len(self.up):
            self._grow(2 * n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * self.down[: n - k + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def runs(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, first start, last start) of each entry, in order; starts cover all strings of ``length`` bytes."""
        g, w = self.hashes(data), self.window
        least = _sliding(g, w, np.minimum, _MASK)
        padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
        anchors = np.flatnonzero(_sliding(padded, w, np.maximum, 0) == g)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        if len(first) != len(anchors):  # some gram is the least at two places of a window: tell the places apart
            place = np.arange(len(least)) + np.argmin(np.lib.stride_tricks.sliding_window_view(g, w), axis=1)
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            anchors = place[first]
        return anchors, first, np.concatenate([first[1:], [len(least)]]) - 1

    def entries(self, raw: bytes) -> Iterator[tuple[int, ...]]:
        """(prefix, gram digest, span digest, anchor, first start, last start)"""
        from xxhash import xxh3_64_intdigest

        u = self.unit
        if len(raw) < self.length * u:
            return
        view = memoryview(raw)
        for at, lo, hi in zip(*(x.tolist() for x in self.runs(np.frombuffer(raw, dtype=f"<u{u}"))), strict=True):
            prefix = int.from_bytes(bytes(view[at * u : at * u + min(8, self.gram * u)]).ljust(8, b"\0"), "big") - (1 << 63)
            gram, span = view[at * u : (at + self.gram) * u], view[lo * u : (hi + self.length) * u]
            yield prefix, _signed(xxh3_64_intdigest(gram)), _signed(xxh3_64_intdigest(span)), at, lo, hi


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _sliding(x: np.ndarray, w: int, fn: np.ufunc, fill: int) -> np.ndarray:
    """Minimum or maximum over each window: of the tail of one block of w and the head of the next."""
    rows = np.concatenate([x, np.full(-len(x) % w, fill, dtype=x.dtype)]).reshape(-1, w)
    heads, tails = fn.accumulate(rows, axis=1).ravel(), fn.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - w + 1
    return fn(tails[:n], heads[w - 1 : w - 1 + n])


class SuffixFamily:
    """The levels of the index: written tables of entries sorted by suffix, each with its size in batches."""

    def __init__(self, spark):
        self.spark = spark
        self.levels: list[tuple[int, DataFrame]] = []
        self.found: list[DataFrame] = []

    def add(self, entries: DataFrame) -> None:
        """Takes in a batch and notes the keys that it repeats, within itself or in an earlier batch."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * size, self._sorted(a.unionByName(b), "level")))
            drop_written(a, b)
        found = materialize(entries, "repeats-found")  # else the sort's sampling would search the texts twice
        batch = self._sorted(found, "batch")
        drop_written(found)
        keys = batch.groupBy(*KEY).agg((F.count(F.lit(1)) > 1).alias("twice"))
        scans = [keys.filter("twice").select(*KEY)]
        for _, level in self.levels:
            scans.append(keys.filter("not twice").select(*KEY).join(level.select(*KEY).distinct(), KEY, "left_semi"))
        found = scans[0]
        for scan in scans[1:]:
            found = found.unionByName(scan)
        self.found.append(materialize(found.distinct(), "repeats-keys"))
        self.levels.append((1, batch))

    def _sorted(self, entries: DataFrame, name: str) -> DataFrame:
        return materialize(entries.repartitionByRange(*KEY, "span", "row").sortWithinPartitions(*KEY), f"repeats-{name}")

    def repeated(self) -> DataFrame:
        """All entries whose key occurs twice in the family."""
        rows, keys = self.levels[0][1], self.found[0]
        for _, level in self.levels[1:]:
            rows = rows.unionByName(level)
        for found in self.found[1:]:
            keys = keys.unionByName(found)
        self.found.append(materialize(keys.distinct(), "repeats-all-keys"))  # a plain table, so that Spark can split a hot key's rows
        return rows.join(self.found[-1], KEY, "left_semi")

    def drop(self) -> None:
        drop_written(*[t for _, t in self.levels], *self.found)


def suffix_entries(docs: DataFrame, length: int, window: int, unit: int = BYTE) -> DataFrame:
    def run(slices: Iterator[pa.Table]) -> Iterator[pa.Table]:
        finder = Anchors(length, window, unit)
        for rows in slices:
            columns: list[list] = [[] for _ in range(8)]
            for doc_id, row, text in zip(*(rows[c].to_pylist() for c in ("doc_id", "row", "text")), strict=True):
                for prefix, gram, span, at, lo, hi in finder.entries(encoded(text, unit)):
                    for column, value in zip(columns, (prefix, gram, span, doc_id, row, at, lo, hi), strict=True):
                        column.append(value)
            kinds = ["int64"] * 5 + ["int32"] * 3
            yield pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in ENTRY.split(", ")])

    return map_arrow(docs.select("doc_id", "row", "text"), run, ENTRY)


def _per_row(places: DataFrame, *columns: str) -> DataFrame:
    """The places of each document in one array, whose size the document's length bounds."""
    return places.groupBy("doc_id", "row").agg(F.collect_list(F.struct(*columns)).alias("places"))


def _joined(docs: DataFrame, per_row: DataFrame, how: str) -> DataFrame:
    per_row = per_row.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "places")
    return docs.join(per_row, (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id")), how).drop("_id", "_row")


CONTEXT = "doc_id bigint, row bigint, at int, lo int, hi int, n int, part binary"
RUN = ["doc_id", "row", "lo", "hi"]


def contexts(docs: DataFrame, entries: DataFrame, length: int, unit: int = BYTE) -> DataFrame:
    """Entries (doc_id, row, at, lo, hi, n) with the bytes under their runs."""

    def run(slices: Iterator[pa.Table]) -> Iterator[pa.Table]:
        for rows in slices:
            out = []
            for doc_id, row, text, places in zip(*(rows[c].to_pylist() for c in ("doc_id", "row", "text", "places")), strict=True):
                raw = encoded(text, unit)
                out += [(doc_id, row, p["at"], p["lo"], p["hi"], min(p["n"], 2), raw[p["lo"] * unit : (p["hi"] + length) * unit]) for p in places]
            kinds = ["int64"] * 2 + ["int32"] * 4 + ["binary"]
            yield pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in CONTEXT.split(", ")])

    return map_arrow(_joined(docs, _per_row(entries, "at", "lo", "hi", "n"), "inner"), run, CONTEXT)


def cut_into_blocks(parts: DataFrame, length: int, block: int, unit: int = BYTE) -> DataFrame:
    """(core, a, b, doc_id, row, at, lo, hi, n): the runs of ``parts`` cut at multiples of ``block`` starts from the anchor. ``core`` is the
    digest of what all strings that may start in the block hold, a and b are that of the span of those that do.
    """

    def run(slices: Iterator[pa.Table]) -> Iterator[pa.Table]:
        from xxhash import xxh3_64_intdigest, xxh3_128_digest

        for rows in slices:
            out, digests = [], []
            for p in rows.to_pylist():
                part, begin, at = p["part"], p["lo"], p["at"]
                for number in range((begin - at) // block, (p["hi"] - at) // block + 1):
                    low = at + number * block
                    lo, hi = max(low, begin), min(low + block - 1, p["hi"])
                    core = part[(low + block - 1 - begin) * unit : (low + length - begin) * unit] if block > 1 else b""
                    out.append((_signed(xxh3_64_intdigest(core, number & 0xFFFF)) if block > 1 else 0, p["doc_id"], p["row"], at, lo, hi, p["n"]))
                    digests.append(xxh3_128_digest(part[(lo - begin) * unit : (hi + length - begin) * unit], (lo - low) << 16 | (hi - low)))
            if out:
                ab = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                kinds = ["int64"] * 3 + ["int32"] * 4
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.table([columns[0], ab[:, 0].copy(), ab[:, 1].copy(), *columns[1:]], names=["core", "a", "b", "doc_id", "row", "at", "lo", "hi", "n"])

    return map_arrow(parts, run, "core bigint, a bigint, b bigint, doc_id bigint, row bigint, at int, lo int, hi int, n int")


def settle(rows: DataFrame, key: list[str], span: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(repeated runs, what is open) of rows (key, span, doc_id, row, at, lo, hi, n).

    A span that counts more than once is repeated. Open are the keys that have a single span among several spans: one row for
    each of their spans, with its count.
    """
    spans = rows.groupBy(*key, *span).agg(F.sum("n").cast("int").alias("n"), F.min(F.struct("doc_id", "row", "at", "lo", "hi")).alias("one"))
    spans = materialize(spans, f"repeats-{name}")
    runs = rows.filter("n = 1").join(spans.filter("n > 1").select(*key, *span), [*key, *span], "left_semi").select(*RUN)
    several = spans.groupBy(*key).agg(F.count(F.lit(1)).alias("spans"), F.min("n").alias("least")).filter("spans > 1 and least = 1").select(*key)
    return runs, spans.join(several, key, "left_semi").select("one.*", "n")


def bytes_of(runs: DataFrame, parts: DataFrame, length: int, unit: int = BYTE) -> DataFrame:
    """``contexts`` of runs that lie within those of ``parts``."""
    whole = parts.select("doc_id", "row", "at", F.col("lo").alias("from"), "part")
    inner = runs.withColumnsRenamed({"doc_id": "_id", "row": "_row", "at": "_at"})
    same = (F.col("row") == F.col("_row")) & (F.col("at") == F.col("_at")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    piece = F.expr(f"substring(part, (lo - `from`) * {unit} + 1, (hi - lo + {length}) * {unit})")
    return inner.join(whole, same).select("doc_id", "row", "at", "lo", "hi", "n", piece.alias("part"))


def repeated_runs(docs: DataFrame, length: int, window: int, batches: int, unit: int = BYTE) -> DataFrame:
    """(doc_id, row, lo, hi): runs of starts at which a string of ``length`` units begins that also begins elsewhere."""
    family = SuffixFamily(docs.sparkSession)
    for i in range(batches):
        family.add(suffix_entries(docs.filter(F.pmod("row", F.lit(batches)) == i), length, window, unit))
    entries = materialize(family.repeated(), "repeats-entries")
    family.drop()
    runs, still = settle(entries.withColumn("n", F.lit(1)), KEY, ["span"], "spans")
    parts = materialize(contexts(docs, still, length, unit), "repeats-contexts")
    blocks = materialize(cut_into_blocks(parts, length, BLOCK, unit), "repeats-blocks")
    more, still = settle(blocks, ["core"], ["a", "b"], "block-spans")
    starts = materialize(cut_into_blocks(bytes_of(still, parts, length, unit), length, 1, unit), "repeats-starts")
    twice = starts.groupBy("a", "b").agg(F.sum("n").alias("n")).filter("n > 1").select("a", "b")
    last = starts.filter("n = 1").join(twice, ["a", "b"], "left_semi").select(*RUN)
    return runs.unionByName(more).unionByName(last)


def covered(places: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes, as (start, end)."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((p["lo"], p["hi"] + length) for p in places or []):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def remaining(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in spans for x in span), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _with_places(docs: DataFrame, length: int, window: int, batches: int, words: int | None = None) -> DataFrame:
    """The rows of ``docs`` with ``places``, the runs of starts of their repeated strings; null where there are none. With ``words``
    also with ``word_places``, those of their repeated passages of so many words."""
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    keys = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "row", "text")
    places = materialize(_per_row(repeated_runs(keys, length, window, batches), "lo", "hi"), "repeats-places")
    if words:
        runs = repeated_runs(keys, words, min(WORD_WINDOW, words), batches, WORD)
        found = materialize(_per_row(runs, "lo", "hi"), "repeats-word-places")
        docs = _joined(docs, found, "left").withColumnRenamed("places", "word_places")
    return _joined(docs, places, "left").drop("row")


def word_spans(raw: bytes, places: list[dict], words: int) -> list[dict]:
    """The passages of each run of starts as (lo, hi) in bytes, from the first word's start to the last one's end. What stands between two
    passages that only follow each other stays.
    """
    at = [m.span() for m in _RUN.finditer(raw)]
    return [{"lo": at[p["lo"]][0], "hi": at[p["hi"] + words - 1][1]} for p in places]


def without_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, batches: int = BATCHES, words: int | None = None) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, n_chars, ...) with all repeated strings of ``length`` bytes cut out of the text, as in
    ``remove_repeats``. A character of which only a part remains goes too. ``n_chars`` is counted anew where the text changed.
    With ``words`` every passage of so many words goes as well that also begins at another word, here or in another document,
    whatever white space is between the words; both kinds are judged on the input.
    """
    names = docs.columns

    def run(slices: Iterator[pa.Table]) -> Iterator[pa.Table]:
        for rows in slices:
            texts, counts = rows["text"].to_pylist(), rows["n_chars"].to_pylist()
            by_words = rows["word_places"].to_pylist() if words else [None] * len(texts)
            for i, (at, passages) in enumerate(zip(rows["places"].to_pylist(), by_words, strict=True)):
                if at or passages:
                    raw = texts[i].encode("utf-8", "surrogatepass")
                    spans = [{"lo": lo, "hi": hi} for lo, hi in covered(at, length)] + word_spans(raw, passages or [], words)
                    texts[i] = remaining(raw, covered(spans, 0)).decode("utf-8", "ignore")
                    counts[i] = len(texts[i])
            new = {"text": pa.array(texts, "string"), "n_chars": pa.array(counts, "int64")}
            yield pa.table({c: new.get(c, rows[c]) for c in names})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_arrow(_with_places(docs, length, window, batches, words), run, schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of ``docs`` (doc_id, text).

    Every byte goes that lies in a string of ``length`` bytes which also starts anywhere else, in this document or another;
    strings are judged on the input. ``kept`` are the bytes that remain (they may begin or end inside a character). A null
    text counts as empty. Repeated rows are documents of their own, so all their strings repeat. An empty table gives no
    rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def run(slices: Iterator[pa.Table]) -> Iterator[pa.Table]:
        for rows in slices:
            size, gone, spans_of, sums, kept = [], [], [], [], []
            for text, at in zip(rows["text"].to_pylist(), rows["places"].to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                spans = covered(at, length)
                rest = remaining(raw, spans)
                size.append(len(raw))
                gone.append(len(raw) - len(rest))
                spans_of.append(len(spans))
                sums.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.table({
                "doc_id": rows["doc_id"], "n_bytes": pa.array(size, "int64"), "n_removed": pa.array(gone, "int64"),
                "n_spans": pa.array(spans_of, "int64"), "kept_sha256": pa.array(sums, "string"), "kept": pa.array(kept, "binary"),
            })

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    return map_arrow(_with_places(docs, length, window, batches), run, schema)
