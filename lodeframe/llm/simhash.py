"""Near-dedup by SimHash fingerprints in BK-trees.

A fingerprint has bit k where over half of the text's word shingles have bit k
in their XXH64. Equal fingerprints are one class. Classes are dealt to shards:
the 64 bits are cut into blocks, and a shard is one value of one choice of
blocks. Two fingerprints that differ in at most ``radius`` bits agree in
``blocks - radius`` blocks at least, so they meet in some shard. In a shard a
BK-tree (children keyed by their Hamming distance to the parent) is searched
for each member, and only edges whose key is within the radius of the query's
distance are followed.

A shard's tree goes to the tasks that ask it, through the shuffle: the trees
together grow with the corpus, so no broadcast of them has a proven bound. A
shard of over ``shard_rows`` members is cut into pieces, and each pair of
pieces (one gives the tree, the other the queries) is a task of its own. A
shard emits a spanning forest of its links and never all pairs; the forests
are joined to components by star rounds.

Defined cases: null and empty texts have fingerprint zero, which links like any
other; a text of fewer words than a shingle is one shingle; repeated rows share
a class; a component's identifier is its smallest non-null document identifier,
null where it has none; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_rows, narrow, numbered, staged, text_of
from .components import components
from .spans import slices, words_of, xxh64

BITS = 64
#: Bytes of text that are hashed at once.
SLICE_BYTES = 1 << 20
#: Shingles of which the bits are held at once.
CHUNK = 1 << 16
#: Members of a tree node that are scanned instead of split further.
LEAF = 8


def hashed_shingles(texts: list[bytes], shingle: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[int, np.ndarray, np.ndarray]]]:
    """How many shingles each text has, where they begin among all, and chunks of them: the first one's place, their texts and hashes."""
    words = words_of(texts)
    count = np.diff(words.first)
    shingles = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(shingles)])
    owner = np.repeat(np.arange(len(count)), shingles)
    head = np.arange(begin[-1]) - begin[owner] + words.first[owner]
    tail = head + np.minimum(count, shingle)[owner] - 1

    def chunks() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for low in range(0, len(head), CHUNK):  # a text may be longer than all that fits
            span = slice(low, low + CHUNK)
            start = words.start[head[span]]
            yield low, owner[span], xxh64(words.buffer, start, words.start[tail[span]] + words.length[tail[span]] - start, seed)

    return shingles, begin, chunks()


def add_votes(votes: np.ndarray, begin: np.ndarray, low: int, own: np.ndarray, hashes: np.ndarray) -> None:
    """Adds the bits of a chunk's hashes to the votes of their texts."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, BITS)
    for k in range(own[0], own[-1] + 1):
        mine = bits[max(begin[k] - low, 0) : max(begin[k + 1] - low, 0)]
        for j in range(0, len(mine), 255):
            votes[k] += mine[j : j + 255].sum(0, dtype=np.uint8)


def majority(votes: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """The fingerprints, unsigned: bits that over half of the shingles have."""
    return np.packbits(votes * 2 > shingles[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(texts: list[bytes], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """The fingerprint of each text, unsigned."""
    shingles, begin, chunks = hashed_shingles(texts, shingle, seed)
    votes = np.zeros((len(shingles), BITS), np.int64)
    for chunk in chunks:
        add_votes(votes, begin, *chunk)
    return majority(votes, shingles)


def fingerprint_table(source: DataFrame, shingle: int = 3) -> DataFrame:
    """row, doc_id and fp (the fingerprint as a signed long) for each row (row, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            parts = [fingerprints(texts[s], shingle) for s in slices(map(len, texts), SLICE_BYTES)]
            fp = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
            yield pa.record_batch([b.column("row"), b.column("doc_id"), pa.array(fp)], ["row", "doc_id", "fp"])

    rows = source.select("row", F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, fp long")


def blocks_for(classes: int, radius: int) -> int:
    """So many blocks that a shard has few members on average: another block for each 256 times the classes."""
    blocks = radius + 1
    while classes > 1 << (24 + 8 * (blocks - radius - 1)) and blocks < 2 * radius + 2:
        blocks += 1
    return blocks


def _shards(blocks: int, radius: int):
    """A column with a row's shards: the choice of blocks and a hash-free packing of their bits."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    out = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        value = F.lit(0).cast("long")
        for k in chosen:
            width = edges[k + 1] - edges[k]
            value = F.shiftleft(value, width).bitwiseOR(F.shiftrightunsigned("fp", edges[k]).bitwiseAND(F.lit((1 << width) - 1)))
        out.append(F.struct(F.lit(n).alias("choice"), value.alias("value")))
    return F.explode(F.array(*out))


def _distances(values: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(values ^ to)


def forest(values: np.ndarray, tree: np.ndarray, asks: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what is within the radius. ``tree`` and ``asks`` are positions in ``values``.

    The BK-tree over ``tree`` is grown and searched at once: the first member is
    a node, the others are its children by their distance, and the queries that
    go on to a child are those whose own distance to the node is within the
    radius of the child's key. A subtree whose members and queries are all
    joined already is left.
    """
    label = np.arange(len(values))
    links: list[tuple[int, int]] = []
    stack = [(tree, asks)]
    while stack:
        nodes, queries = stack.pop()
        if not len(nodes) or not len(queries):
            continue
        have = label[nodes[0]]
        if (label[nodes] == have).all() and (label[queries] == have).all():
            continue
        node = nodes[0]
        near = _distances(values[queries], values[node])
        for q in queries[near <= radius]:
            if label[q] != label[node]:
                links.append((int(q), int(node)))
                label[label == label[q]] = label[node]
        rest = nodes[1:]
        if len(rest) <= LEAF:
            stack.extend((rest[k : k + 1], queries[np.abs(near.astype(np.int16) - int(_distances(values[rest[k : k + 1]], values[node])[0])) <= radius]) for k in range(len(rest)))
            continue
        keys = _distances(values[rest], values[node])
        for key in np.unique(keys):
            stack.append((rest[keys == key], queries[np.abs(near.astype(np.int16) - int(key)) <= radius]))
    return links


def small_forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """The same for a few fingerprints, with a tree of dictionaries."""
    links: list[tuple[int, int]] = []
    root: dict = {}
    for k, value in enumerate(values):
        stack = [(root, None)] if root else []
        while stack:  # search, then insert
            node, _ = stack.pop()
            d = (node["value"] ^ value).bit_count()
            if d <= radius:
                links.append((k, node["at"]))
            stack.extend((child, key) for key, child in node["children"].items() if abs(key - d) <= radius)
        node, new = root, {"value": value, "at": k, "children": {}}
        if not root:
            root = new
            continue
        while (child := node["children"].get(d := (node["value"] ^ value).bit_count())) is not None:
            node = child
        node["children"][d] = new
    return links


def _linked(radius: int):
    def links(rows: np.ndarray, piece: np.ndarray, a: int, b: int) -> list[tuple[int, int]]:
        if a == b and len(rows) <= 4 * LEAF:
            return small_forest([int(x) for x in rows], radius)
        return forest(rows, np.flatnonzero(piece == a), np.flatnonzero(piece == b), radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def emit(held: list[np.ndarray], key: np.ndarray) -> list[tuple[int, int]]:
            table = np.concatenate(held)
            if len(table) < 2:
                return []
            fps = table[:, 4].view(np.uint64)
            return [(int(table[x, 4]), int(table[y, 4])) for x, y in links(fps, table[:, 5], int(key[2]), int(key[3]))]

        for batch in batches:
            table = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(6)], axis=1)
            if not len(table):
                continue
            cuts = np.flatnonzero((table[1:, :4] != table[:-1, :4]).any(axis=1)) + 1
            found: list[tuple[int, int]] = []
            for part in np.split(table, cuts):
                if key is not None and (part[0, :4] == key).all():
                    held.append(part)
                    continue
                if held:
                    found += emit(held, key)
                key, held = part[0, :4], [part]
            yield _edges(found)
        if held:
            yield _edges(emit(held, key))

    return run


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def near_links(classes: DataFrame, *, radius: int = 3, shard_rows: int = 2048, blocks: int | None = None) -> DataFrame:
    """Links (a, b) that join what is within ``radius`` bits among the distinct ``fp`` of ``classes``."""
    blocks = blocks or blocks_for(classes.count(), radius)
    rows = classes.select("fp", _shards(blocks, radius).alias("shard")).select("shard.choice", "shard.value", "fp")
    large = rows.groupBy("choice", "value").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > shard_rows)
    pieces = F.coalesce(F.ceil(F.col("members") / shard_rows), F.lit(1)).cast("int")
    dealt = rows.join(large, ["choice", "value"], "left").select("choice", "value", "fp", pieces.alias("pieces"))
    dealt = dealt.withColumn("piece", F.expr("cast(pmod(xxhash64(fp), pieces) as int)")).withColumn("other", F.explode(F.expr("sequence(0, pieces - 1)")))
    dealt = dealt.select("choice", "value", F.least("piece", "other").alias("a"), F.greatest("piece", "other").alias("b"), "fp", "piece")
    keys = ["choice", "value", "a", "b"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_linked(radius), "a long, b long")


def _placed(source: DataFrame, *, shingle: int = 3, radius: int = 3, shard_rows: int = 2048, blocks: int | None = None) -> DataFrame:
    """row, doc_id, fp, root (a component's smallest fingerprint) and component_id for each row (row, doc_id, text)."""
    prints = staged(fingerprint_table(source, shingle), "fingerprints")
    classes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    joined = components(near_links(classes, radius=radius, shard_rows=shard_rows, blocks=blocks))
    roots = classes.join(joined, classes["fp"] == joined["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    named = roots.join(lowest, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp")


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, fingerprint and component_id for each row of ``docs``; ``options`` are those of ``_placed``."""
    source = narrow(docs, doc_id=id_col, text=text_col).withColumn("row", F.monotonically_increasing_id())
    return _placed(source, **options).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, that of its smallest identifier, with all its columns."""
    rows = numbered(docs)
    placed = _placed(rows.select("row", F.col("kept")[id_col].alias("doc_id"), F.col("kept")[text_col].alias("text")), **options)
    return one_of_each(rows, placed.select("row", "doc_id", "root"))


def one_of_each(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """The row of ``rows`` (as ``numbered`` makes them) that stands for each root of ``placed`` (row, doc_id, root).

    It is the one with the smallest identifier, a null after all others.
    """
    best = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"))
    return kept_rows(rows, best.select("best.row"))
