"""Token ids in Parquet list columns, laid out for selective reads.

A store is a folder of Parquet files in ascending order of the documents: file
k holds the k-th range of identifiers, sorted. ``tokens`` is a list column with
dictionary encoding (a vocabulary's ids take two bytes or less that way);
``doc_id`` and ``local_start`` ascend in a file and are delta encoded. Row
groups and pages are kept small, and every page has its bounds in the page
index, so a read of some documents or of the metadata alone touches little
else. Spark's own committer writes the files, so lost executors cost retries
and never leave half a file.

Defined cases: null and empty texts are their end id alone; null identifiers
come first; rows that share an identifier are in the order of their texts'
hashes; other columns are ignored; no rows make a store without documents.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import input_bytes, narrow, shared_dir, text_of
from .spans import slices, xxh64
from .token_count import load

SCHEMA = "shard int, doc_id long, n_tokens int, local_start long, tokens array<int>"
#: Pre-tokens that a worker remembers (words: eight times as many), and how long they or a word's ids may be; words that are encoded in one call; bytes of text that are cut at once.
REMEMBERED, LONGEST, CALL, SLICE_BYTES = 100_000, 48, 1024, 8 << 20


def cuts_at_space(parsed: dict) -> bool:
    """Whether what stands between white space can be encoded alone.

    So it is if white space becomes a blank, the rest of the normalizer goes by
    characters, and the pre-tokenizer keeps only matches of classes that have
    no white space.
    """
    steps = lambda part, inner: [x for y in ([part] if part else []) for x in (y[inner] if y.get("type") == "Sequence" else [y])]
    normal, cut = steps(parsed["normalizer"], "normalizers"), steps(parsed["pre_tokenizer"], "pretokenizers")
    if not cut or cut[0].get("type") != "Split" or not cut[0].get("invert") or cut[0].get("behavior") != "Removed" or any(x.get("type") != "ByteLevel" or x.get("add_prefix_space") for x in cut[1:]):
        return False
    classes = re.sub(r"\[\^\\s[^]]*\]|\[(?:\\[pP]\{\w+\})+\]", "", cut[0]["pattern"].get("Regex", " "))
    blank = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    plain = not any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] or t["content"].split() != [t["content"]] for t in parsed["added_tokens"])
    return plain and not re.search(r"[\s\\.\[]", classes) and all(x.get("type") in ("NFC", "NFD", "Lowercase") or x == blank for x in normal)


class Remembered(dict):
    """What is known of some strings, None of others. It has two generations, and what is asked for outlives a change."""

    def __init__(self):
        super().__init__()
        self.old: dict[str, bytes] = {}

    def find(self, keys: list[str]) -> list[bytes | None]:
        """What is known of many strings."""
        out = list(map(self.get, keys))
        if self.old:
            missed = [k for k, x in enumerate(out) if x is None]
            for k, ids in zip(missed, map(self.old.get, [keys[k] for k in missed]), strict=True):
                if ids is not None:
                    out[k] = self.add(keys[k], ids)
        return out

    def add(self, key: str, ids: bytes) -> bytes:
        if len(key) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[key] = ids
        return ids


class Memory:
    """Ids of up to ``most`` words as arrays, without the words: 128 bits of hash stand for one, some 40 bytes in all.

    When it is full, the half that was asked for last stays.
    """

    def __init__(self, most: int):
        self.most, self.clock = most, 0
        self.key, self.check, self.start = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.size, self.used, self.values = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, "<i4")

    def __len__(self) -> int:
        return len(self.key)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The place of each word, -1 for those that are not known."""
        self.clock += 1
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = (self.key[at] == key) & (self.check[at] == check)
        self.used[at[hit]] = self.clock
        return np.where(hit, at, -1)

    def add(self, key: np.ndarray, check: np.ndarray, size: np.ndarray, values: np.ndarray) -> None:
        """Words that are not known, with the ids of all of them one after the other."""
        start = np.cumsum(size, dtype=np.int64) - size + len(self.values)
        short = size <= LONGEST
        key, check, start, size = (np.concatenate([a, b[short]]) for a, b in ((self.key, key), (self.check, check), (self.start, start), (self.size, size.astype(np.int32))))
        used, values = np.concatenate([self.used, np.full(int(short.sum()), self.clock, np.int32)]), np.concatenate([self.values, values])
        if len(key) > self.most:
            late = np.argsort(-used, kind="stable")[: self.most // 2]
            key, check, start, size, used = key[late], check[late], start[late], size[late], used[late]
        if len(key) < len(self.key) + len(short):  # ids of words that were not kept go too
            upto = np.cumsum(size, dtype=np.int64)
            values = values[np.repeat(start - (upto - size), size) + np.arange(int(upto[-1]) if len(upto) else 0)]
            start = upto - size
        order = np.argsort(key, kind="stable")
        self.key, self.check, self.start, self.size, self.used, self.values = key[order], check[order], start[order], size[order], used[order], values


def hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash of each word."""
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    data = words.buffers()[2]
    buffer = np.concatenate([np.frombuffer(data, np.uint8)[: offsets[-1]] if data else np.zeros(0, np.uint8), np.zeros(8, np.uint8)])
    return tuple(xxh64(buffer, offsets[:-1], np.diff(offsets), seed) for seed in (42, 1042))


class Encoder:
    """Ids of texts, all of them by the tokenizers library.

    Where white space always ends a token (``cuts_at_space``), texts are cut at
    ASCII white space in Arrow and each distinct word is encoded once: many
    words go to the library's normalizer and pre-tokenizer in one call, and its
    model merges each distinct pre-token once. Words with a special token in
    them, and the texts of other tokenizers, go to the library as they are.
    """

    def __init__(self, definition: str):
        parsed = json.loads(definition)
        self.tokenizer = load(definition)
        self.words = cuts_at_space(parsed)
        self.special = [t["content"] for t in parsed["added_tokens"]]
        self.normal, self.cut, self.model = (getattr(self.tokenizer, x) for x in ("normalizer", "pre_tokenizer", "model"))
        self.known, self.pieces = Memory(8 * REMEMBERED), Remembered()

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<i4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, pieces: list[str]) -> list[bytes]:
        """The ids of pre-tokens; each distinct one that is not known is merged once."""
        out = self.pieces.find(pieces)
        fresh: dict[str, bytes] = {}
        for k in [k for k, x in enumerate(out) if x is None]:
            piece = pieces[k]
            ids = fresh.get(piece)
            if ids is None:
                found = [t.id for t in self.model.tokenize(piece)]
                ids = fresh[piece] = self.pieces.add(piece, struct.pack(f"<{len(found)}i", *found))
            out[k] = ids
        return out

    def _call(self, words: list[str]) -> tuple[bytes, np.ndarray]:
        """The ids of words and how many each has, in the library's steps: all words as one text, its pre-tokens, and each one's merges."""
        text = " ".join(words)
        clean = self.normal.normalize_str(text) if self.normal else text
        size = [len(w) + 1 for w in clean.split(" ")]
        if len(size) != len(words) or any(x in text for x in self.special):
            ids = self._library(words)
            return b"".join(ids), np.array([len(x) // 4 for x in ids], np.int32)
        cut = self.cut.pre_tokenize_str(clean)
        ids = self._merged([piece for piece, _ in cut])
        # A word's pre-tokens stand together, so its ids are a range of all.
        first = np.searchsorted(np.array([at for _, (at, _) in cut], np.int64), np.cumsum([0, *size]))
        upto = np.cumsum([0, *map(len, ids)])
        return b"".join(ids), (np.diff(upto[first]) // 4).astype(np.int32)

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each of some distinct words has its own among them and how many."""
        key, check = hashes(words)
        at = self.known.find(key, check)
        asked = np.flatnonzero(at < 0)
        new = [self._call(words.take(pa.array(asked[k : k + CALL])).to_pylist()) for k in range(0, len(asked), CALL)]
        fresh, count = np.frombuffer(b"".join(x for x, _ in new), "<i4"), np.concatenate([np.zeros(0, np.int32), *(n for _, n in new)])
        values = np.concatenate([self.known.values, fresh])
        start, size = np.empty(len(words), np.int64), np.empty(len(words), np.int32)
        held = np.flatnonzero(at >= 0)
        start[held], size[held] = self.known.start[at[held]], self.known.size[at[held]]
        start[asked], size[asked] = np.cumsum(count, dtype=np.int64) - count + len(self.known.values), count
        if len(asked):
            self.known.add(key[asked], check[asked], count, fresh)
        return values, start, size

    def encode(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, ``end`` after each, and how many each has."""
        parts = [self._part(texts[s], end) for s in slices(pc.binary_length(texts).to_pylist(), SLICE_BYTES)]
        if not parts:
            return np.zeros(0, "<i4"), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _part(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        if not self.words:
            ids = [x + end for x in self._library(texts.to_pylist())]
            return np.frombuffer(b"".join(ids), "<i4"), np.array([len(x) // 4 for x in ids], np.int64)
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        values, start, size = self._ids(coded.dictionary)
        last_id = np.frombuffer(end, "<i4")
        values, start, size = np.concatenate([values, last_id]), np.append(start, len(values)).astype(np.int32), np.append(size, len(last_id)).astype(np.int32)  # few enough ids for 32 bits
        # The end is the last word of every text.
        first = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        word = np.insert(coded.indices.to_numpy(), first[1:], len(size) - 1)
        count = size[word]
        upto = np.cumsum(count, dtype=np.int64)
        total = int(upto[-1]) if len(upto) else 0
        if total >= 1 << 31:  # one very long text
            start, kind = start.astype(np.int64), np.int64
        else:
            kind = np.int32
        gather = np.repeat(start[word] - (upto - count).astype(kind), count)
        gather += np.arange(total, dtype=kind)
        last = first[1:] + np.arange(len(first) - 1)
        return values[gather], np.diff(upto[last], prepend=0)


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(definition: str) -> Encoder:
    """The worker's encoder: what it remembers serves all tasks that the worker runs."""
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(definition)
    return _ENCODERS[key]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 16 << 20, row_group_bytes: int = 8 << 20, page_bytes: int = 64 << 10) -> None:
    """Encode every text, append ``end_id`` and write a store to ``path``.

    ``shard_bytes`` is what a file holds of the stored input.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, start, end = encoder_of(definition.value), TaskContext.get().partitionId(), 0, np.array([end_id], "<i4").tobytes()
        for b in batches:
            n = b.num_rows
            ids, sizes = encoder.encode(b.column("text"), end)
            starts = start + np.concatenate([[0], np.cumsum(sizes)])
            tokens = pa.ListArray.from_arrays((starts - start).astype(np.int32), pa.array(ids, pa.int32()))
            yield pa.record_batch([pa.array([shard] * n, pa.int32()), b.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(starts[:-1]), tokens], ["shard", "doc_id", "n_tokens", "local_start", "tokens"])
            start = int(starts[-1])

    source = narrow(docs, doc_id=id_col, text=text_col)
    rows = source.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    shards = max(1, -(-input_bytes(docs, text_col) // shard_bytes))
    # The row number comes last, so that rows that repeat identifier and text are spread over shards too.
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash").asc(), F.col("row").asc()]
    dealt = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    options = {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#tokens.list.element": "true",
    }
    dealt.mapInArrow(run, SCHEMA).write.options(**options).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and n_tokens of each document, from the metadata columns alone.

    ``start`` counts the ids of all documents before it: those of the files
    before its own (a sum over one row for each file) and those in its file.
    """
    return _with_start(spark.read.schema(SCHEMA).parquet(path), _shard_starts(spark, path)).select("doc_id", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens and tokens; ``where`` on doc_id or n_tokens is pushed into the files."""
    stored = spark.read.schema(SCHEMA).parquet(path)
    return _with_start(stored.where(where) if where else stored, _shard_starts(spark, path)).select("doc_id", "start", "n_tokens", "tokens")


def _shard_starts(spark: SparkSession, path: str) -> DataFrame:
    sizes = spark.read.schema(SCHEMA).parquet(path).groupBy("shard").agg(F.sum(F.col("n_tokens").cast("long")).alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shard_start"))


def _with_start(rows: DataFrame, starts: DataFrame) -> DataFrame:
    return rows.join(starts, "shard").withColumns({"start": F.col("shard_start") + F.col("local_start"), "n_tokens": F.col("n_tokens").cast("long")})


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tokens = b.column("tokens")
        values, offsets = np.ascontiguousarray(tokens.values.to_numpy(zero_copy_only=False).astype("<u4")), tokens.offsets.to_numpy()
        sums = [zlib.crc32(values[x:y].tobytes()) for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.record_batch([b.column("shard"), b.column("doc_id"), b.column("local_start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())], ["shard", "doc_id", "local_start", "n_tokens", "ids_crc32"])


def token_digests(docs: DataFrame, tokenizer_path: str, *, end_id: int, path: str | None = None, **options) -> DataFrame:
    """Write a store, read it back and return doc_id, start, n_tokens and ids_crc32 of what the files hold."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer_path, end_id=end_id, **options)
    stored = spark.read.schema(SCHEMA).parquet(path).select("shard", "doc_id", "local_start", "tokens")
    sums = stored.mapInArrow(_checksums, "shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return _with_start(sums, _shard_starts(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
