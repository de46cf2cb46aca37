"""Operator inputs derived from the given tables.

``Library`` hands out the tables of one data folder: assets, fingerprints, text lines,
decisions and so on, each a lazy DataFrame. Expensive shared steps are written once to the
shared folder and reused within the object's life, as a scan's results would be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.functions import fixed
from shoebox.operators.distributed import dealt
from shoebox.session import materialize

ASSETS = """
select cast(0 as bigint) as library_id, d as asset_id,
 timestampadd(SECOND, cast((d div 20)*100000 + case (d div 20)%6
   when 0 then (d%20)*2
   when 1 then ((d%20) div 8)*1000
   when 2 then (d%20)*60
   when 3 then ((d%20) div 4)*300+((d%20)%4)*3
   when 4 then (d%20)*3600
   else (case when d%20<14 then (d%20)*5 else (d%20)*3600 end) end as bigint), timestamp '2024-01-01 00:00:00') as creation_ts,
 cast(case d%4 when 0 then 4032 when 1 then 3024 when 2 then 1512 else 1179 end as int) as pixel_width,
 cast(case d%4 when 0 then 3024 when 1 then 4032 when 2 then 2016 else 2556 end as int) as pixel_height,
 n_chars*10 as byte_size, d%97=0 as is_favorite, d%3=0 as has_location, n_chars%13=0 as is_video,
 cast((n_chars%5)*1.25 as double) as duration,
 case when (d div 20)%6=2 then concat('b',cast(d div 20 as string)) end as burst_id,
 cast(case when d%11=0 then 4 when d%7=0 then 8 when d%17=0 then 16 when d%19=0 then 1 else 0 end as int) as subtypes,
 case when d%26=0 then concat('RPReplay_',cast(d as string)) else concat('IMG_',cast(d as string)) end as filename,
 md5(text) as content_hash, source
from (select doc_id as d, text, n_chars, source from {documents})
"""

TEXT_LINES = """
select l_orderkey as asset_id,
 cast((l_partkey%100)/100.0 as double) as x, cast(((l_suppkey*7+l_linenumber*13)%100)/100.0 as double) as y,
 least(0.9, l_quantity/100.0) as w, 0.01+l_tax/4 as h,
 case when l_linenumber=1 then '9:41' else concat(l_returnflag, cast(l_partkey as string), l_linestatus) end as text,
 1-l_discount as confidence
from {lineitem}
"""

OCR_LINES = TEXT_LINES.replace(
    " as asset_id,", " as asset_id,\n row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as line_no,"
)

DECISIONS = """
select event_id, cast(ts as timestamp) as ts, user_id as library_id, event_id%{modulus} as asset_id,
 case event_type when 'click' then 'delete' when 'view' then 'keepOnce' when 'purchase' then 'whitelist'
   when 'signup' then 'undo' else 'relabel' end as action,
 cast(floor(value*10000) as bigint) as bytes
from {events}
"""

DELETION_ITEMS = """
select event_id, cast(ts as date) as run_date, user_id as library_id,
 case event_id%5 when 0 then 'duplicate' when 1 then 'chatScreenshot' when 2 then 'gameScreenshot'
   when 3 then 'screenshot' else 'blurry' end as category,
 cast(floor(value*10000) as bigint) as bytes
from {events} where event_type='purchase'
"""

READINGS = """
select cast(0 as bigint) as library_id, o_orderkey as reading_id, cast(o_orderdate as timestamp) as ts,
 o_orderkey%50000+1 as asset_count, cast(floor(o_totalprice*100) as bigint) as bytes
from {orders}
"""

VECTORS = """
select cast(0 as bigint) as library_id, vec_id, embedding, 2 as revision,
 concat('app',cast(label as string)) as app, label, vec_id%50=0 as is_centroid
from {embeddings}
"""

CANDIDATES = """
select cast(0 as bigint) as library_id, doc_id as asset_id,
 case doc_id%6 when 0 then 'chatScreenshot' when 1 then 'gameScreenshot' when 2 then 'documentShot'
   when 3 then 'webShot' when 4 then 'blurry' else 'screenshot' end as category,
 cast((doc_id%100)/100.0 as double) as confidence, n_chars*10 as byte_size
from {documents}
"""


SLICE_WORDS = 100_000  # words after which a slice of texts ends


def _simhash_batches(batches):
    """Arrow batches of (doc_id, text) to (doc_id, two 64-bit SimHashes of the words).

    Each distinct word of a slice is hashed once. A hash's 128 bits become 128 byte counters
    held in 16 longs; runs of at most 255 words add up in those longs without a carry,
    and the runs of one document are then summed in full width. Measured many times faster
    than 64 packed SQL sums over exploded words.
    """
    for pdf in batches:
        texts, start = pdf["text"].to_numpy(), 0
        while start < len(texts):
            # split slice by slice: the words of a whole batch take many times the room of its texts
            kept, counts, words, at = [], [], [], start
            while at < len(texts) and len(words) < SLICE_WORDS:
                found = [w for w in texts[at].split(" ") if w]
                if found:
                    kept.append(at)
                    counts.append(len(found))
                    words += found
                at += 1
            start = at
            if not kept:
                continue
            counts = np.array(counts)
            codes, vocabulary = pd.factorize(np.array(words, dtype=object))
            digests = b"".join(hashlib.md5(w.encode()).digest() for w in vocabulary)
            lanes = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 16), axis=1).view(np.uint64)
            runs = -(-counts // 255)
            first_run = np.r_[0, np.cumsum(runs)[:-1]]
            nth = np.arange(runs.sum()) - np.repeat(first_run, runs)
            run_start = np.repeat(np.r_[0, np.cumsum(counts)[:-1]], runs) + nth * 255
            partial = np.add.reduceat(lanes[codes], run_start, axis=0).view(np.uint8).astype(np.int64)
            ones = np.add.reduceat(partial, first_run, axis=0)
            packed = np.packbits(2 * ones > counts[:, None], axis=1).view(">i8").astype(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[kept], "dhash": packed[:, 0], "phash": packed[:, 1]})


def spread(df: DataFrame) -> DataFrame:
    """Give a small input (one file, one row group) as many partitions as there are cores."""
    width = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= width else df.repartition(width)


def fingerprints(documents: DataFrame) -> DataFrame:
    hashes = spread(documents.select("doc_id", "text")).mapInPandas(_simhash_batches, "doc_id bigint, dhash bigint, phash bigint")
    d = F.col("doc_id")
    return hashes.select(
        d.alias("asset_id"), "dhash", "phash",
        ((d % 100) / 100.0).alias("sharpness"), ((d % 10) / 10.0).alias("flatness"),
        ((d % 7) / 10.0).alias("saturation"), ((d % 9) / 10.0).alias("edge_density"),
        ((d % 11) / 10.0).alias("brightness"), F.lit(fixed.FINGERPRINT_VERSION).alias("version"),
    )


class Library:
    """The tables of one data folder, read lazily; shared heavy steps written once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._kept: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _sql(self, text: str, **tables: DataFrame) -> DataFrame:
        return self.spark.sql(text, **tables)

    def keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Build once, write to the shared folder, reuse."""
        if name not in self._kept:
            self._kept[name] = materialize(build(), name)
        return self._kept[name]

    def assets(self) -> DataFrame:
        """The base table of most operators: written once, so that later scans never read the texts again."""
        return self.keep("assets", lambda: self._sql(ASSETS, documents=self.table("documents")))

    def fingerprints(self) -> DataFrame:
        return self.keep("fingerprints", lambda: fingerprints(self.table("documents")))

    def text_lines(self) -> DataFrame:
        """Lines without their numbers, for what only adds up."""
        return self._sql(TEXT_LINES, lineitem=self.table("lineitem"))

    def ocr_lines(self) -> DataFrame:
        return self.keep("ocr-lines", lambda: self._sql(OCR_LINES, lineitem=dealt(self.table("lineitem"), ["l_orderkey"])))

    def decisions(self) -> DataFrame:
        return self._sql(DECISIONS, events=self.table("events"), modulus=self.decided_assets())

    def decided_assets(self) -> int:
        """Decisions touch two fifths of the library, at any scale."""
        return max(1, self.table("documents").count() * 2 // 5)

    def deletion_items(self) -> DataFrame:
        return self._sql(DELETION_ITEMS, events=self.table("events"))

    def readings(self) -> DataFrame:
        return self._sql(READINGS, orders=self.table("orders"))

    def vectors(self) -> DataFrame:
        return self._sql(VECTORS, embeddings=self.table("embeddings"))

    def candidates(self) -> DataFrame:
        return self._sql(CANDIDATES, documents=self.table("documents"))
