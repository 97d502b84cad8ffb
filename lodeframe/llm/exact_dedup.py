"""Exact dedup by a tree-merge of sorted digest runs.

Every input partition sorts its digests into a run that holds one entry for
each text. Runs then meet in rounds. There are ``fan_in ** rounds`` nodes, and
a node's address has one digit for each round. In round r a node hands the
entries of its run to the ``fan_in`` nodes that differ from it in digit r, by
digit r of the digest (with a fan-in of two this is the binomial exchange).
Each node merges the runs it gets, adds the counts of equal texts and retains
the best identifier. After the last round a node holds all there is of one
range of digests. A text that fills a third of all rows is one entry of each
run, so no node sees more than ``fan_in`` entries of it.

An identifier is retained only for entries whose SHA-256, byte length and
XXH64 all agree.

Defined cases: a null text counts as empty; of rows that repeat both identifier
and text one is kept; null identifiers lose against all others; other columns
of the input are ignored, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_rows, narrow, numbered, staged, text_of

#: A run's entry: digest as four big-endian words, what verifies it, the best identifier, rows.
ENTRY = np.dtype([(k, "<u8") for k in ("d0", "d1", "d2", "d3")] + [("n_bytes", "<i8"), ("xx", "<i8"), ("no_id", "<i8"), ("rank", "<i8"), ("rid", "<i8"), ("rows", "<i8")])
TEXT_KEYS, BEST_KEYS = ("d0", "d1", "d2", "d3", "n_bytes", "xx"), ("no_id", "rank", "rid")
BLOCK_ROWS = 50_000
RUN_SCHEMA = "node long, first binary, entries binary"


def collapse(entries: np.ndarray) -> np.ndarray:
    """Sort by text, then best identifier first; leave one entry for each text, with all its rows."""
    if not len(entries):
        return entries
    entries = entries[np.lexsort([entries[k] for k in reversed(TEXT_KEYS + BEST_KEYS)])]
    new = np.ones(len(entries), bool)
    new[1:] = np.logical_or.reduce([entries[k][1:] != entries[k][:-1] for k in TEXT_KEYS])
    starts = np.flatnonzero(new)
    out = entries[starts].copy()
    out["rows"] = np.add.reduceat(entries["rows"], starts)
    return out


def _digit(entries: np.ndarray, place: int, bits: int) -> np.ndarray:
    return (entries["d0"] >> np.uint64(64 - bits * (place + 1))).astype(np.int64) & ((1 << bits) - 1)


def _send(run: np.ndarray, node: int, place: int, bits: int, rounds: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Blocks of a sorted run for the nodes of the next round: digit ``place`` of the address is replaced."""
    unit = bits * (rounds - 1 - place)
    digits = _digit(run, place, bits)
    for digit in np.unique(digits):
        part = run[digits == digit]
        to = (node & ~(((1 << bits) - 1) << unit)) | (int(digit) << unit)
        for k in range(0, len(part), BLOCK_ROWS):
            block = part[k : k + BLOCK_ROWS]
            yield to, int(block["d0"][0]).to_bytes(8, "big"), block.tobytes()


def _batch(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    node, first, entries = zip(*rows, strict=True)
    return pa.record_batch([pa.array(node, pa.int64()), pa.array(first, pa.binary()), pa.array(entries, pa.binary())], ["node", "first", "entries"])


def _first_runs(bits: int, rounds: int, largest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId() % (1 << (bits * rounds))
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(_send(collapse(np.concatenate(held)), node, 0, bits, rounds)) if held else []
            if rows:
                yield _batch(rows)

        for b in batches:
            part = np.zeros(b.num_rows, ENTRY)
            words = np.frombuffer(b"".join(b.column("digest").to_pylist()), ">u8").reshape(-1, 4)
            for k in range(4):
                part[f"d{k}"] = words[:, k]
            for k in ("n_bytes", "xx", "rid"):
                part[k] = b.column(k).to_numpy(zero_copy_only=False)
            ids = b.column("id")
            part["no_id"] = ids.is_null().to_numpy(zero_copy_only=False)
            rank = ids.fill_null(0).to_numpy(zero_copy_only=False)
            part["rank"] = ~rank if largest else rank
            part["rows"] = 1
            held.append(part)
            size += len(part)
            if size >= 4 * BLOCK_ROWS:
                yield from flush()
                held, size = [], 0
        yield from flush()

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Multiway merge, node by node, of blocks that come in the order of their first digest.

    What is smaller than the first digest of the latest block can meet no
    further entry, so it is final and leaves memory.
    """
    node, held, size = None, [], 0
    for b in batches:
        for to, first, entries in zip(*(b.column(k).to_pylist() for k in ("node", "first", "entries")), strict=True):
            if to != node:
                if held:
                    yield node, collapse(np.concatenate(held))
                node, held, size = to, [], 0
            if size >= 8 * BLOCK_ROWS:
                run = collapse(np.concatenate(held))
                cut = int(np.searchsorted(run["d0"], np.uint64(int.from_bytes(first, "big"))))
                if cut:
                    yield node, run[:cut]
                held, size = [run[cut:]], 0
            held.append(np.frombuffer(entries, ENTRY))
            size += len(held[-1])
    if held:
        yield node, collapse(np.concatenate(held))


def _next_runs(place: int, bits: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, merged in _merged(batches):
            rows = list(_send(merged, node, place, bits, rounds))
            if rows:
                yield _batch(rows)

    return run


def _winners(largest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, merged in _merged(batches):
            w = merged[merged["rows"] > 1]
            words = np.empty((len(w), 4), ">u8")
            for k in range(4):
                words[:, k] = w[f"d{k}"]
            digests = words.tobytes()
            ids = ~w["rank"] if largest else w["rank"]
            yield pa.record_batch(
                [
                    pa.array([digests[k : k + 32] for k in range(0, len(digests), 32)], pa.binary()),
                    pa.array(w["n_bytes"]),
                    pa.array(w["xx"]),
                    pa.array(ids, mask=w["no_id"] != 0),
                    pa.array(w["rid"]),
                    pa.array(w["rows"]),
                ],
                ["digest", "n_bytes", "xx", "keep_id", "keep_rid", "group_size"],
            )

    return run


def text_digest(text: Column) -> list[Column]:
    """Digest of a text and the two values that verify it."""
    return [F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("xx")]


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in: int = 16, node_rows: int = 100_000) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` says whether the smallest or the largest identifier of equal texts
    stays. ``fan_in`` (a power of two) runs meet at a node; there are so many
    rounds, two at least, that a node ends with about ``node_rows`` texts.
    """
    source = narrow(docs, id=id_col, text=text_col).withColumn("rid", F.monotonically_increasing_id())
    digests, winners = _groups(source, keep, fan_in, node_rows)
    alone = F.col("group_size").isNull()
    return digests.join(winners, ["digest", "n_bytes", "xx"], "left").select(
        F.col("id").alias("doc_id"),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _groups(source: DataFrame, keep: str, fan_in: int = 16, node_rows: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """The digests of the rows (id, text, rid), written, and the best of every text that repeats."""
    if keep not in ("smallest", "largest") or fan_in < 2 or fan_in & (fan_in - 1):
        raise ValueError("keep is smallest or largest, fan_in a power of two")
    bits, largest = fan_in.bit_length() - 1, keep == "largest"
    digests = staged(source.select(F.col("id").cast("long").alias("id"), *text_digest(text_of()), "rid"), "digests")
    rounds = max(2, math.ceil(math.log(max(1, digests.count() / node_rows), fan_in)))
    runs = digests.mapInArrow(_first_runs(bits, rounds, largest), RUN_SCHEMA)
    for place in range(1, rounds):
        runs = runs.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_next_runs(place, bits, rounds), RUN_SCHEMA)
    winners = runs.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_winners(largest), "digest binary, n_bytes long, xx long, keep_id long, keep_rid long, group_size long")
    return digests, winners


def drop_exact_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", **options) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns.

    Of rows that repeat identifier and text one stays. Rows go by their number,
    so they are shuffled once.
    """
    rows = numbered(docs)
    source = rows.select(F.col("kept")[id_col].alias("id"), F.col("kept")[text_col].alias("text"), F.col("row").alias("rid"))
    digests, winners = _groups(source, keep, **options)
    kept = digests.join(winners, ["digest", "n_bytes", "xx"], "left").where("group_size IS NULL OR rid = keep_rid")
    return kept_rows(rows, kept.select(F.col("rid").alias("row")))
