"""Conflict-constrained best-fit packing of documents into sequences.

Documents go to shards by a hash of their row's number, and a shard packs its own. Longest first,
each goes to the open bin with the least room that still holds it and that has
neither its source nor its duplicate cluster yet. A bin carries both as
bitmaps. Bins are ordered by their room: the search starts at the smallest
room that is enough and goes on to the next larger one until a compatible bin
is found; only if there is none a new bin is opened. What is longer than a bin
is cut into full bins and a rest, and the rest is packed like a document.

A shard has about ``shard_rows`` rows and ``shard_words`` words, also where rows
repeat, so a source or a cluster that holds a third of all rows is spread over
all shards. Only identifiers, lengths and marks reach the packer, never texts;
they are written once, so that words are counted once.

Defined cases: documents without words take no room and have no bin; a null
source is a source of its own; a null cluster conflicts with none; rows that
repeat an identifier are packed one by one; other columns are ignored; no rows
give no rows.
"""

from __future__ import annotations

from bisect import insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .mixing import word_count

PACKED = "doc_id long, part int, first_word long, n_words long, shard long, bin long, bin_start long"


class Bins:
    """Open bins by their room, the oldest first, with a bitmap of the rooms that have a bin."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.by_room = capacity, 0, [[] for _ in range(capacity + 1)]
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin of a document and where it starts there; ``source`` and ``cluster`` are bit masks."""
        room = size
        while rest := self.rooms >> room:
            room += (rest & -rest).bit_length() - 1
            bins = self.by_room[room]
            for at, b in enumerate(bins):
                if not (self.sources[b] & source or self.clusters[b] & cluster):
                    del bins[at]
                    if not bins:
                        self.rooms &= ~(1 << room)
                    return self._put(b, room, size, source, cluster)
            room += 1
        self.sources.append(0)
        self.clusters.append(0)
        return self._put(len(self.sources) - 1, self.capacity, size, source, cluster)

    def _put(self, b: int, room: int, size: int, source: int, cluster: int) -> tuple[int, int]:
        self.sources[b] |= source
        self.clusters[b] |= cluster
        left = room - size
        if left:  # a full bin is closed
            insort(self.by_room[left], b)
            self.rooms |= 1 << left
        return b, self.capacity - room


def pack_shard(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(document, part, first word, words, bin, start in the bin) for every part, longest rests first."""
    source_bit = {s: 1 << k for k, s in enumerate(dict.fromkeys(sources))}
    repeated = [c for c, n in Counter(clusters).items() if n > 1 and c is not None]  # others can't conflict
    cluster_bit = {c: 1 << k for k, c in enumerate(repeated)}
    bins, out = Bins(capacity), []
    for k, n in enumerate(sizes):
        for part in range(n // capacity):
            out.append((k, part, part * capacity, capacity, *bins.place(capacity, 0, 0)))
    for k in sorted(range(len(sizes)), key=lambda k: -(sizes[k] % capacity)):
        if rest := sizes[k] % capacity:
            full = sizes[k] // capacity
            out.append((k, full, full * capacity, rest, *bins.place(rest, source_bit[sources[k]], cluster_bit.get(clusters[k], 0))))
    return out


def _packer(capacity: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("mark", "ascending"), ("doc_id", "ascending"), ("size", "ascending")])
        ids, sizes = table.column("doc_id").to_pylist(), table.column("size").to_pylist()
        parts = pack_shard(sizes, table.column("source").to_pylist(), table.column("cluster").to_pylist(), capacity)
        empty = [k for k, n in enumerate(sizes) if not n]
        doc, part, first, words, bin_, start = (np.array(x, np.int64) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 6
        n = len(empty)
        nothing = pa.nulls(n, pa.int64())
        both = lambda x, y: pa.chunked_array([pa.array(x, pa.int64()), y])
        return pa.table(
            {
                "doc_id": pa.array([ids[k] for k in doc] + [ids[k] for k in empty], pa.int64()),
                "part": pa.array([*part, *[0] * n], pa.int32()),
                "first_word": both(first, pa.array([0] * n, pa.int64())),
                "n_words": both(words, pa.array([0] * n, pa.int64())),
                "shard": pa.array([key[0].as_py()] * (len(doc) + n), pa.int64()),
                "bin": both(bin_, nothing),
                "bin_start": both(start, nothing),
            }
        )

    return run


def pack(docs: DataFrame, *, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None, size: Column | None = None, shard_rows: int = 4096, shard_words: int = 1 << 21, seed: int = 1) -> DataFrame:
    """A row for each part of each row of ``docs``: doc_id, part, first_word, n_words, shard, bin and bin_start.

    ``size`` is a column with a document's length (its words if not given),
    ``cluster`` one that is equal for duplicates (a hash of the text if not given).
    """
    if capacity < 1:
        raise ValueError("a bin holds one word at least")
    text = F.col(f"`{text_col}`")
    size = word_count(text) if size is None else F.coalesce(size, F.lit(0))
    cluster = F.xxhash64(text) if cluster is None else cluster
    mark = F.xxhash64(F.col(f"`{id_col}`"), text, F.lit(seed)).alias("mark")
    rows = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), size.cast("long").alias("size"), F.col(f"`{source_col}`").cast("string").alias("source"), cluster.cast("string").alias("cluster"), mark), "lengths")
    count, words = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    shards = max(1, -(-count // shard_rows), -(-int(words or 0) // shard_words))
    # By the row's own number, so that rows that repeat are spread too.
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(shards)).cast("long")).drop("row")
    return dealt.groupBy("shard").applyInArrow(_packer(capacity), PACKED)
