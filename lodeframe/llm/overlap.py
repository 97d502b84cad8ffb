"""Near copies by similarity, as the pipeline's near_dedup stage needs them: SimHash and its BK-trees, completed by MinHash keys.

Two texts are near copies if the sets of their shingles (five words) have a
Jaccard similarity of 0.8 or more. Candidates come from the fingerprints of
``simhash`` (equal ones, and those that its BK-trees find within ``radius``
bits). A radius that trees can search misses most such pairs: at a similarity
of 0.8 the distances are about 10 of 64 bits and reach 17, and no cut of 64 bits
into blocks finds those without a scan of all pairs. So texts that share one of
``bands`` MinHash keys of ``rows`` minima each are candidates too (a pair of
similarity 0.8 misses all 30 with a chance of 7e-6). Both come from one pass
over the shingles' hashes.

A candidate is compared by its minima first, a byte of each: what they show to
be under ``floor`` (4.5 standard deviations below 0.8, so that a pair is lost
with a chance of 4e-6) is left. Every link that remains is checked on the words
themselves, so a link is never an estimate.

A key of many texts is not paired all with all: first each text is compared
with the key's first text, the links are joined to components, and then texts of
one key that are in different components are compared inside a task, in pieces
of bounded size, by their minima and then by the hashes of their shingles. Only
links leave it, no more than join its members; the work in it still grows with
the square of a key whose texts are alike but under 0.8.

Defined cases: null and blank texts are copies of each other; a text of fewer
words than a shingle is one shingle; rows that repeat are copies; of a component
the smallest identifier stays, a null only where there is no other; other
columns come through, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, staged, text_of
from .components import components
from .simhash import BITS, SLICE_BYTES, add_votes, hashed_shingles, majority, near_links, one_of_each
from .spans import slices, xxh64


def sketches(texts: list[bytes], shingle: int, count: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint of each text, and ``count`` minima over its shingles under different orders (the largest number for a blank text)."""
    shingles, begin, chunks = hashed_shingles(texts, shingle, seed)
    dice = np.random.default_rng(seed)
    flips, factors = dice.integers(0, 1 << 64, count, np.uint64), dice.integers(0, 1 << 64, count, np.uint64) | np.uint64(1)
    minima = np.full((len(shingles), count), np.iinfo(np.uint64).max, np.uint64)
    votes = np.zeros((len(shingles), BITS), np.int64)
    for low, own, hashes in chunks:
        add_votes(votes, begin, low, own, hashes)
        mine, first = np.unique(own, return_index=True)
        for k in range(count):
            minima[mine, k] = np.minimum(minima[mine, k], np.minimum.reduceat((hashes ^ flips[k]) * factors[k], first))
    return majority(votes, shingles), minima


def similarity(a: bytes, b: bytes, shingle: int) -> float:
    """The Jaccard similarity of two texts' shingles, exactly."""

    def parts(text: bytes) -> set[bytes]:
        words = text.lower().split()
        return {b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))}

    x, y = parts(a), parts(b)
    return len(x & y) / len(x | y)


def sketch_table(source: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """row, doc_id, fp, the keys of all bands and the lowest byte of each minimum, for each row (row, doc_id, text)."""
    width = 8 * (rows + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column("text").to_pylist()
            for part in slices(map(len, held), SLICE_BYTES):
                fp, minima = sketches(held[part], shingle, bands * rows)
                band = np.tile(np.arange(bands, dtype=np.uint64), len(fp))
                raw = np.concatenate([np.column_stack([band, minima.reshape(-1, rows)]).view(np.uint8).ravel(), np.zeros(8, np.uint8)])
                keys = xxh64(raw, np.arange(len(band)) * width, np.full(len(band), width)).view(np.int64)
                low = minima.astype(np.uint8).tobytes()  # the highest bytes of minima are all small
                n = bands * rows
                yield pa.record_batch(
                    [
                        b.column("row")[part],
                        b.column("doc_id")[part],
                        pa.array(fp.view(np.int64)),
                        pa.ListArray.from_arrays(np.arange(0, len(keys) + 1, bands, dtype=np.int32), pa.array(keys)),
                        pa.array([low[k : k + n] for k in range(0, len(low), n)], pa.binary()),
                    ],
                    ["row", "doc_id", "fp", "keys", "minima"],
                )

    return source.select("row", F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text")).mapInArrow(run, "row long, doc_id long, fp long, keys array<long>, minima binary")


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)


def _alike(pairs: DataFrame, table: DataFrame, floor: float) -> DataFrame:
    """The pairs (a, b) of rows whose minima agree often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                same = (_matrix(b.column("x")) == _matrix(b.column("y"))).mean(axis=1) >= floor
                yield b.select(["a", "b"]).filter(pa.array(same))

    sides = [table.select(F.col("row").alias(k), F.col("minima").alias(v)) for k, v in (("a", "x"), ("b", "y"))]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _checked(pairs: DataFrame, source: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) of rows whose texts are at least so similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [similarity(x, y, shingle) >= least for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    named = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    asked = staged(source.select("row", text_of().cast("binary").alias("text")).join(named, "row", "left_semi"), "asked")
    both = pairs.join(asked.select(F.col("row").alias("a"), F.col("text").alias("x")), "a").join(asked.select(F.col("row").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """The distinct hashes of each text's shingles, ascending."""
    shingles, _, chunks = hashed_shingles(texts, shingle)
    every = np.concatenate([np.zeros(0, np.uint64), *[hashes for _, _, hashes in chunks]])
    return [np.unique(x) for x in np.split(every, np.cumsum(shingles)[:-1])] if texts else []


def _members(open_rows: DataFrame, source: DataFrame, table: DataFrame, shingle: int) -> DataFrame:
    """Adds to (key, row, root) what a task needs to compare rows: all keys, minima and the hashes of the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column("text").to_pylist()
            for part in slices(map(len, held), SLICE_BYTES):
                yield pa.record_batch([b.column("row")[part], pa.array([x.tobytes() for x in shingle_sets(held[part], shingle)], pa.binary())], ["row", "hashes"])

    asked = source.select("row", text_of().cast("binary").alias("text")).join(open_rows.select("row").distinct(), "row", "left_semi")
    known = asked.mapInArrow(run, "row long, hashes binary").join(table.select("row", "keys", "minima"), "row")
    return open_rows.join(known, "row").withColumn("band", F.array_position("keys", F.col("key")).cast("int") - 1)


def _apart(members: DataFrame, least: float, floor: float, piece_rows: int) -> DataFrame:
    """Links (a, b) that join rows of one key which are in different components, a spanning forest for each task.

    A key's members are cut into pieces, and any two pieces are one task's. Two rows are compared under the first of the
    keys that they share, and not at all where the task has joined them already; first by their minima, then by the
    hashes of their shingles. Pairs that are no links never leave the task.
    """

    def links(t: pa.Table, one: int, two: int) -> Iterator[tuple[int, int]]:
        rows, piece, band = t.column("row").to_numpy(), t.column("piece").to_numpy(), t.column("band")[0].as_py()
        label = np.unique(t.column("root").to_numpy(), return_inverse=True)[1]
        minima, keys = _matrix(t.column("minima")), np.stack(t.column("keys").to_numpy())
        hashes = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
        left, right = np.flatnonzero(piece == one), np.flatnonzero(piece == two)
        for k in left:
            to = right[(right > k) & (label[right] != label[k])] if one == two else right[label[right] != label[k]]
            to = to[(minima[to] == minima[k]).mean(axis=1) >= floor]
            for j in to[(keys[to] == keys[k]).argmax(axis=1) == band]:
                if label[j] != label[k]:
                    common = np.intersect1d(hashes[j], hashes[k], assume_unique=True).size
                    if common >= least * (len(hashes[j]) + len(hashes[k]) - common):
                        yield min(rows[j], rows[k]), max(rows[j], rows[k])
                        label[label == label[j]] = label[k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def emit() -> pa.RecordBatch:
            found = np.array([*links(pa.Table.from_batches(held), *key[1:])], np.int64).reshape(-1, 2)
            return pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("key", "one", "two")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if high == low:
                    continue
                if key is not None and tuple(keys[low].tolist()) != key:
                    yield emit()
                    held = []
                key = tuple(keys[low].tolist())
                held.append(batch.slice(low, high - low))
        if held:
            yield emit()

    large = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key", F.ceil(F.col("n") / piece_rows).alias("pieces"))
    dealt = members.join(large, "key").withColumn("piece", F.pmod(F.xxhash64("row"), F.col("pieces"))).withColumn("other", F.explode(F.expr("sequence(0L, pieces - 1)")))
    dealt = dealt.select("key", F.least("piece", "other").alias("one"), F.greatest("piece", "other").alias("two"), "row", "root", "piece", "band", "keys", "minima", "hashes")
    keys = ["key", "one", "two"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def near_copies(source: DataFrame, *, shingle: int = 5, least: float = 0.8, radius: int = 3, bands: int = 30, rows: int = 5, piece_rows: int = 512) -> DataFrame:
    """row, doc_id and root (the first row of its component) for each row (row, doc_id, text)."""
    table = staged(sketch_table(source, shingle, bands, rows), "sketches")
    floor = least - 4.5 * math.sqrt(least * (1 - least) / (bands * rows))
    keys = table.select(F.explode("keys").alias("key"), "row")
    low = keys.groupBy("key").agg(F.min("row").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "low")
    shared = staged(keys.join(low, "key"), "shared")
    classes = staged(table.groupBy("fp").agg(F.min("row").alias("low")), "classes")
    first = [classes.select(F.col("fp").alias(k), F.col("low").alias(v)) for k, v in (("a", "x"), ("b", "y"))]
    by_tree = near_links(classes, radius=radius).join(first[0], "a").join(first[1], "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    by_fp = table.select("fp", "row").join(classes, "fp").where("row != low").select(F.col("low").alias("a"), F.col("row").alias("b"))
    by_key = shared.where("row != low").select(F.col("low").alias("a"), F.col("row").alias("b"))
    stars = staged(by_key.union(by_fp).union(by_tree).distinct(), "pairs")
    links = staged(_checked(staged(_alike(stars, table, floor), "alike"), source, shingle, least), "near")
    joined = components(links)
    rooted = shared.join(joined, shared["row"] == joined["node"], "left").select("key", "row", F.coalesce("root", "row").alias("root"))
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("key")
    members = staged(_members(staged(rooted.join(open_keys, "key", "left_semi"), "open"), source, table, shingle), "members")
    rest = staged(_apart(members, least, floor, piece_rows), "pairs")
    joined = components(links.union(_checked(rest, source, shingle, least)))
    return table.select("row", "doc_id").join(joined, table["row"] == joined["node"], "left").select("row", "doc_id", F.coalesce("root", "row").alias("root"))


def drop_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component of near copies, that of its smallest identifier, with all its columns."""
    rows = numbered(docs)
    source = rows.select("row", F.col("kept")[id_col].alias("doc_id"), F.col("kept")[text_col].alias("text"))
    return one_of_each(rows, near_copies(source, **options))
