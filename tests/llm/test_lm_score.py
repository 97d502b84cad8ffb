import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lodeframe.llm.lm_score import lm_scores, pack, pack_sorted, unpack, unpack_sorted


def brute(rows, mass=8.0):
    read = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    one, two, ctx = Counter(), Counter(), Counter()
    for i, t in rows:
        if not held(i):
            seq = [b"\n\n", *read(t), b"\n"]
            one.update(seq[1:])
            two.update(zip(seq, seq[1:]))
            ctx.update(seq[:-1])
    n, v = sum(one.values()), len(one)
    out = []
    for i, t in rows:
        seq = [b"\n\n", *read(t), b"\n"]
        p = [(one[w] + 1) / (n + v + 1) for w in seq[1:]]
        base = sum(map(math.log10, p))
        score = sum(math.log10((two[h, w] + mass * q) / (ctx[h] + mass)) for h, w, q in zip(seq, seq[1:], p))
        out.append((i, held(i), len(seq) - 1, sum(one[w] > 0 for w in seq[1:]), n, round(base, 6), round(score, 6)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 22, 20_000])
def test_whole_table_matches_brute_force(spark, sf_dir, block_bytes):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(lm_scores(docs, block_bytes=block_bytes)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark):
    rows = [(k, "The cat sat on the mat. the cat") for k in range(9)] + [(20, None), (21, ""), (22, "the\tcat\x1cx É é"), (None, "the dog"), (None, None), (22, "w " * 9000)]
    docs = spark.createDataFrame([(i, t, "b", 3.0) for i, t in rows], "doc_id long, text string, block string, score double")
    assert got(lm_scores(docs)) == brute(rows)
    assert lm_scores(docs.limit(0)).count() == 0


def test_only_held_out_rows(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [(i, "a b") for i in ids]
    assert got(lm_scores(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_packing_round_trip():
    for values in ([], [0], [1, 0, 300, 2**40], list(range(1000))):
        x = np.array(values, np.uint64)
        assert unpack(pack(x), len(x)).tolist() == values
        assert unpack_sorted(pack_sorted(np.sort(x))).tolist() == sorted(values)


def test_a_states_probabilities_sum_to_one():
    from lodeframe.llm.lm_score import Automaton, read_block

    texts = [b"a b a c", b"b b a", b"c a b"]
    block = read_block(texts)
    words = np.bincount(block.word, minlength=len(block.words)).astype(float)
    words[block.begin] = len(texts)
    pairs = np.bincount(block.pair, minlength=len(block.pairs)).astype(float)
    own = np.arange(len(words)) != block.begin
    machine = Automaton.build(block, words, pairs, int(words[own].sum()), int(own.sum()), 8.0)
    unseen = 1 / (words[own].sum() + own.sum() + 1)
    end = int(block.word[block.first[1] - 1]) + 1  # nothing follows an end
    for state in set(range(1, len(words) + 1)) - {end}:
        p = 10 ** machine._arc(np.full(own.sum(), state), np.flatnonzero(own))
        assert p.sum() + 10 ** machine.fail[state] * unseen == pytest.approx(1)
