"""Language-model scores from a weighted backoff automaton over all of the corpus.

The model is a bigram model with Dirichlet smoothing towards an add-one
unigram model. As an automaton: the root and one state for each word (and one
for the beginning of a text); an arc for each bigram of the training texts,
with the weight log10 ((c(hw) + k p(w)) / (c(h) + k)); a failure arc from each
state to the root with the weight log10 (k / (c(h) + k)); and an arc from the
root for each word with the weight log10 p(w). A text is read once from left to
right. Its state says which arc a word takes; where there is none the failure
arc is followed and paid for. So an unseen bigram has the same probability as
under the interpolated model, and every state's probabilities sum to one.

Counts come from all training texts, so the automaton grows with the corpus
and no machine holds it whole. Documents are dealt to blocks. A block sends
the sorted keys and training counts of its distinct words and bigrams, cut by
ranges of the key, to counters; a counter adds up equal keys and answers every
block with the totals of just the keys that it sent, in their order. With the
answers a block builds the part of the automaton that its own texts can reach,
and reads them. Frequent words are one key of a block, however often they
occur.

The texts are shuffled once: both readings of a block use the same exchange.
A block is a share of the rows by their number, so that rows that repeat are
spread like others.
Words are keyed by two independent hashes of 64 and 32 bits, so that counts are
exact but for collisions of 96 bits; bigrams by 64 bits.

Defined cases: a null text is empty and scores its end alone; a null
identifier is in the training folds; without training texts the vocabulary is
empty and every word has probability one; repeated rows count and score as
often as they occur; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, input_bytes, is_scan, narrow, staged, text_of
from .spans import P1, P2, P3, words_of, xxh64

#: What ends a text and what precedes it; no word has a line break.
END, BEGIN = b"\n", b"\n\n"
SECOND_SEED = 0x5EED
REPLY_SCHEMA = "block long, bucket long, words binary, pairs binary, tokens long, distinct_words long"


def _mark(text: bytes, seed: int) -> np.uint64:
    return xxh64(np.frombuffer(text + bytes(8), np.uint8), np.array([0]), np.array([len(text)]), seed)[0]


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (left * P1) ^ (left >> np.uint64(29))
        h = (h + right) * P2
        h ^= h >> np.uint64(31)
        h *= P3
        return h ^ (h >> np.uint64(33))


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, without the planes that are zero."""
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    used = [k for k in range(8) if planes[k].any()]
    return bytes([sum(1 << k for k in used)]) + b"".join(planes[k].tobytes() for k in used)


def unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.zeros((8, n), np.uint8)
    at = 1
    for k in range(8):
        if packed[0] >> k & 1:
            planes[k] = np.frombuffer(packed, np.uint8, n, at)
            at += n
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences, after their number."""
    return len(keys).to_bytes(8, "little") + pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed[8:], int.from_bytes(packed[:8], "little")), dtype=np.uint64)


@dataclass
class Block:
    """The tokens of a block's texts by their places among its sorted distinct words and bigrams."""

    first: np.ndarray  # of each text among the tokens, and the end
    words: np.ndarray  # distinct keys, ascending
    words2: np.ndarray  # their second hashes
    word: np.ndarray  # of each token
    pairs: np.ndarray
    pair_left: np.ndarray  # of each distinct bigram, a place in words
    pair_right: np.ndarray
    pair: np.ndarray
    begin: int  # the place of BEGIN in words


def read_block(texts: list[bytes]) -> Block:
    spans = words_of(texts)
    count = np.diff(spans.first)
    first = spans.first - spans.first[0] + np.arange(len(texts) + 1)
    h = [np.empty(first[-1], np.uint64) for _ in range(2)]
    ends = first[1:] - 1
    inner = np.ones(first[-1], bool)
    inner[ends] = False
    for k, seed in enumerate((42, SECOND_SEED)):
        h[k][inner] = xxh64(spans.buffer, spans.start, spans.length, seed)
        h[k][ends] = _mark(END, seed)
        h[k] = np.append(h[k], _mark(BEGIN, seed))
    h[1] >>= np.uint64(32)
    assert len(count) == len(texts)
    order = np.argsort(h[0], kind="stable")
    a, b = h[0][order], h[1][order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((h[1], h[0]))
        a, b = h[0][order], h[1][order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    place = np.empty(len(a), np.int64)
    place[order] = np.cumsum(new) - 1
    begin, word = int(place[-1]), place[:-1]
    left = np.empty_like(word)
    left[1:] = word[:-1]
    left[first[:-1]] = begin
    keys = _mix(h[0][np.concatenate([[0], np.arange(len(word) - 1)])] if len(word) else h[0][:0], h[0][:-1])
    keys[first[:-1]] = _mix(np.full(len(texts), _mark(BEGIN, 42)), h[0][first[:-1]])
    pairs, at, pair = np.unique(keys, return_index=True, return_inverse=True)
    return Block(first, a[new], b[new], word, pairs, left[at], word[at], pair, begin)


def _bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted keys: equal ranges of the upper 32 bits."""
    upper = np.array([min(-(-(k << 32) // buckets), 1 << 32) for k in range(buckets + 1)], np.uint64)
    cuts = np.searchsorted(keys >> np.uint64(32), upper)
    cuts[-1] = len(keys)
    return cuts


def _send(buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        texts, train = table.column("text").to_pylist(), np.array(table.column("train").to_pylist(), bool)
        block = read_block(texts)
        counted = np.repeat(train, np.diff(block.first)).astype(float)
        word_counts = np.bincount(block.word, counted, len(block.words))
        word_counts[block.begin] = train.sum()
        pair_counts = np.bincount(block.pair, counted, len(block.pairs))
        w, p = _bucket_cuts(block.words, buckets), _bucket_cuts(block.pairs, buckets)
        rows = []
        for k in range(buckets):
            own, two = slice(w[k], w[k + 1]), slice(p[k], p[k + 1])
            rows.append((k, key[0].as_py(), pack_sorted(block.words[own]), pack(block.words2[own]), pack(word_counts[own]), pack_sorted(block.pairs[two]), pack(pair_counts[two])))
        return pa.Table.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), *[pa.binary()] * 5), strict=True)],
            ["bucket", "block", "words", "words2", "word_counts", "pairs", "pair_counts"],
        )

    return run


def _totals(keys: list[np.ndarray], counts: list[np.ndarray], second: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The total of every key, in the order given, and which of them come first of their kind."""
    every, n = np.concatenate(keys), np.concatenate(counts)
    other = np.concatenate(second) if second else np.zeros(len(every), np.uint64)
    order = np.lexsort((other, every)) if second else np.argsort(every, kind="stable")
    a, b = every[order], other[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.empty(len(a), np.int64)
    group[order] = np.cumsum(new) - 1
    total = np.bincount(group, n.astype(float), int(new.sum())).astype(np.uint64)
    one = np.zeros(len(a), bool)
    one[order[new]] = True
    return total[group], one


def _count(key: tuple, table: pa.Table) -> pa.Table:
    """A counter's answers, a row for each block, and what it adds to the corpus totals (in the first row)."""
    rows = table.sort_by("block").to_pylist()
    words, pairs = ([unpack_sorted(r[k]) for r in rows] for k in ("words", "pairs"))
    second = [unpack(r["words2"], len(w)) for r, w in zip(rows, words, strict=True)]
    total, one = _totals(words, [unpack(r["word_counts"], len(w)) for r, w in zip(rows, words, strict=True)], second)
    own = one & (np.concatenate(words) != _mark(BEGIN, 42))
    tokens, distinct = int(total[own].sum()), int((total[own] > 0).sum())
    pair_total, _ = _totals(pairs, [unpack(r["pair_counts"], len(p)) for r, p in zip(rows, pairs, strict=True)])
    cut = lambda totals, parts: [pack(x) for x in np.split(totals, np.cumsum([len(p) for p in parts])[:-1])]
    n = len(rows)
    return pa.Table.from_arrays(
        [
            pa.array([r["block"] for r in rows], pa.int64()),
            pa.array([key[0].as_py()] * n, pa.int64()),
            pa.array(cut(total, words), pa.binary()),
            pa.array(cut(pair_total, pairs), pa.binary()),
            pa.array([tokens] + [0] * (n - 1), pa.int64()),
            pa.array([distinct] + [0] * (n - 1), pa.int64()),
        ],
        ["block", "bucket", "words", "pairs", "tokens", "distinct_words"],
    )


@dataclass
class Automaton:
    """States: 0 is the root, 1 + k the state after word k. Arcs are sorted by state * words + word."""

    words: int
    root: np.ndarray  # weight of each word's arc from the root
    after: np.ndarray  # the state that each word leads to
    fail: np.ndarray  # weight of each state's arc to the root
    arcs: np.ndarray
    weights: np.ndarray

    @classmethod
    def build(cls, block: Block, word_counts: np.ndarray, pair_counts: np.ndarray, tokens: int, distinct: int, mass: float) -> Automaton:
        n = len(word_counts)
        p = (word_counts + 1) / (tokens + distinct + 1)
        known = word_counts > 0
        fail = np.zeros(n + 1)
        fail[1:] = np.log10(mass / (word_counts + mass))
        seen = np.flatnonzero((pair_counts > 0) & known[block.pair_left])
        left, right = block.pair_left[seen], block.pair_right[seen]
        keys = (left + 1) * n + right
        order = np.argsort(keys)
        weights = np.log10((pair_counts[seen] + mass * p[right]) / (word_counts[left] + mass))
        return cls(n, np.log10(p), np.where(known, np.arange(n) + 1, 0), fail, keys[order], weights[order])

    def read(self, first: np.ndarray, word: np.ndarray, begin: int) -> np.ndarray:
        """The weight of each text. All texts are read side by side, one word further at each step."""
        length = np.diff(first)
        order = np.argsort(-length, kind="stable")
        start, length = first[:-1][order], length[order]
        state = np.full(len(order), self.after[begin])
        total = np.zeros(len(order))
        live = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left")
        for step, n in enumerate(live):
            w, s = word[start[:n] + step], state[:n]
            total[:n] += self._arc(s, w)
            state[:n] = self.after[w]
        out = np.empty(len(order))
        out[order] = total
        return out

    def _arc(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        backed_off = self.fail[state] + self.root[word]
        if not len(self.arcs):
            return backed_off
        keys = state * self.words + word
        at = np.minimum(np.searchsorted(self.arcs, keys), len(self.arcs) - 1)
        return np.where(self.arcs[at] == keys, self.weights[at], backed_off)


def _score(buckets: int, mass: float):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        totals = answers.column("totals")[0].as_py()
        tokens, distinct = totals["tokens"], totals["distinct_words"]
        block = read_block(docs.column("text").to_pylist())
        answers = answers.sort_by("bucket")
        counts = {}
        for name, keys in (("words", block.words), ("pairs", block.pairs)):
            sizes = np.diff(_bucket_cuts(keys, buckets))
            counts[name] = np.concatenate([unpack(x, n) for x, n in zip(answers.column(name).to_pylist(), sizes, strict=True)]).astype(float)
        machine = Automaton.build(block, counts["words"], counts["pairs"], tokens, distinct, mass)
        length = np.diff(block.first)
        owner = np.repeat(np.arange(len(length)), length)
        known = np.bincount(owner, counts["words"][block.word] > 0, len(length)).astype(np.int64)
        base = np.bincount(owner, machine.root[block.word], len(length))
        return pa.table({"doc_id": docs.column("doc_id"), "n_tokens": length.astype(np.int64), "n_known": known, "train_tokens": np.full(len(length), tokens), "base_score": base, "score": machine.read(block.first, block.word, block.begin)})

    return run


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mass: float = 8.0, block_bytes: int = 6 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row.

    ``mass`` is k, the weight of the unigram model in words; ``block_bytes`` is
    what a block holds of the stored input.
    """
    plain = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"), F.monotonically_increasing_id().alias("row"))
    source = plain if is_scan(docs) else staged(plain, "texts")  # both readings of a block must see the same rows
    blocks = max(1, -(-input_bytes(docs, text_col) // block_bytes))
    # By the row's number, so that rows that repeat are spread over all blocks.
    dealt = source.select("doc_id", "text", (crc_fold("doc_id", 7) != 2).alias("train"), F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")).repartition(blocks, "block")
    sent = dealt.groupBy("block").applyInArrow(_send(blocks), "bucket long, block long, words binary, words2 binary, word_counts binary, pairs binary, pair_counts binary")
    # The totals read the same exchange as the replies, with all its columns, so that counters run once.
    answers = sent.repartition(blocks, "bucket").groupBy("bucket").applyInArrow(_count, REPLY_SCHEMA).repartition(blocks, "block")
    whole = F.octet_length("words") + F.octet_length("pairs") + F.col("bucket") >= 0
    totals = answers.select(F.struct(F.sum(F.when(whole, F.col("tokens"))).alias("tokens"), F.sum(F.when(whole, F.col("distinct_words"))).alias("distinct_words")))
    replies = answers.withColumn("totals", totals.scalar())
    scored = dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_score(blocks, mass), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.select("doc_id", (crc_fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
