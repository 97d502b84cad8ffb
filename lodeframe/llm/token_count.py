"""Token counts with a whole-token shortcut.

Offline, once on the driver, every string of the vocabulary is encoded alone.
Those that come out as one token are whole: a pre-token that equals one counts
as one token and needs no merges. Texts are cut at white space into chunks that
the tokenizer's own pattern never joins; a chunk is cut into pre-tokens; whole
ones are counted directly, and only the others are merged by the library's
model. Each worker remembers the counts of short chunks, up to a fixed number.

Special strings inside a text count as the library has it by default: as one
token each, cut out before anything else.

Defined cases: null and empty texts have no tokens; texts of any length are
read whole; repeated rows get equal counts; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, text_of

#: Unicode's white space, as the tokenizers' patterns have it.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The byte-level pattern with its three kinds of runs taken as one.
CHUNKS = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: The byte-level pattern. A fixed value of the tokenizer.
PRE_TOKENS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Chunks that a worker remembers, and how long they may be.
REMEMBERED, LONGEST = 400_000, 48


@cache
def byte_letters() -> list[str]:
    """The letter of each byte in a byte-level vocabulary: itself where it prints, else the next free one from U+0100."""
    printing = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printing else next(spare)) for b in range(256)]


def load(definition: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition)


def whole_tokens(definition: str) -> frozenset[str]:
    """The vocabulary's strings that the library, given nothing else, encodes as one token."""
    tokenizer = load(definition)
    special = {t["content"] for t in json.loads(definition)["added_tokens"]}
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    strings = []
    for token in tokenizer.get_vocab(with_added_tokens=False):
        if token not in special and all(c in byte_of for c in token):
            raw = bytes(byte_of[c] for c in token)
            try:
                strings.append(raw.decode())
            except UnicodeDecodeError:  # a part of a character can't stand alone in a text
                continue
    encoded = tokenizer.encode_batch_fast(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, encoded, strict=True) if len(e.ids) == 1)


class Counter(dict):
    """Chunk -> its number of tokens."""

    def __init__(self, definition: str, whole: frozenset[str]):
        super().__init__()
        parsed = json.loads(definition)
        pre = parsed["pre_tokenizer"] or {}
        if parsed["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("the shortcut is for byte-level tokenizers without a normalizer")
        self.model, self.whole, self.letters = load(definition).model, whole, byte_letters()
        special = sorted((t["content"] for t in parsed["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def __missing__(self, chunk: str) -> int:
        n = 1 if chunk in self.whole else sum(1 if p in self.whole else self.merged(p) for p in PRE_TOKENS.findall(chunk))
        if len(chunk) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = n
        return n

    def merged(self, pre_token: str) -> int:
        return len(self.model.tokenize("".join([self.letters[b] for b in pre_token.encode()])))

    def count(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(sum(map(self.__getitem__, CHUNKS.findall(p))) for p in parts)


def token_counts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each row.

    ``tokenizer_path`` names a byte-level ``.json`` file that the driver can
    read; its content (and the whole tokens, no more than the vocabulary) goes
    to the executors.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((definition, whole_tokens(definition)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*shared.value)
        for b in batches:
            counts = [counter.count(t) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    source = narrow(docs, doc_id=id_col, text=text_col)
    rows = source.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text_of()).cast("long").alias("n_bytes"), text_of().alias("text"))
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
