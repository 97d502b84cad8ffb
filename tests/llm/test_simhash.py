import random

import numpy as np
import pytest
import xxhash

from lodeframe.llm.simhash import drop_near_copies, forest, simhash_components, small_forest
from lodeframe.llm.spans import xxh64


def brute(rows, radius=3):
    prints = []
    for _, text in rows:
        words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        votes = [sum(xxhash.xxh64_intdigest(s, 42) >> k & 1 for s in shingles) for k in range(64)]
        prints.append(sum(1 << k for k in range(64) if 2 * votes[k] > len(shingles)))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                root[find(a)] = find(b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(k)] = min(i, ids.get(find(k), i))
    return sorted(((i, f"{p:016x}", ids.get(find(k))) for k, ((i, _), p) in enumerate(zip(rows, prints))), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_xxh64_matches_the_library():
    dice = random.Random(3)
    spans = [dice.randbytes(n) for n in [*range(70), 100, 257]]
    length = np.array([len(s) for s in spans])
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    buffer = np.frombuffer(b"".join(spans) + bytes(8), np.uint8)
    assert xxh64(buffer, start, length, 42).tolist() == [xxhash.xxh64_intdigest(s, 42) for s in spans]


def test_whole_table_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(simhash_components(docs)) == brute(rows)


def test_long_texts_are_hashed_in_parts(monkeypatch):
    from lodeframe.llm import simhash

    texts = [b"", b"One", b"a b " * 700, b"x y z w", b"q " * 1000, b" \n"]
    whole = simhash.fingerprints(texts)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprints(texts).tolist() == whole.tolist() and len(simhash.fingerprints([])) == 0


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "One"), (4, "one \t"), (5, "a b c d e f g h"), (5, "a b c d e f g h"), (None, "x y z"), (None, None), (9, "w " * 5000)]
    docs = spark.createDataFrame([(i, t, "u", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    assert got(simhash_components(docs)) == brute(rows)
    assert simhash_components(docs.limit(0)).count() == 0
    kept = sorted((r.doc_id, r.fp) for r in drop_near_copies(docs).collect() if r.doc_id)
    assert [k for k, _ in kept] == [1, 3, 5, 9]


@pytest.mark.parametrize("shard_rows,blocks", [(2048, 4), (3, 4), (2048, 5), (5, 6)])
def test_pieces_and_blocks_lose_no_link(spark, shard_rows, blocks):
    from pyspark.sql import functions as F

    from lodeframe.llm.simhash import near_links

    dice = random.Random(blocks)
    centres = [dice.getrandbits(64) for _ in range(12)]
    prints = {c ^ sum(1 << b for b in dice.sample(range(64), dice.randrange(5))) for c in centres for _ in range(25)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    classes = spark.createDataFrame([(p,) for p in signed], "fp long").withColumn("low", F.lit(1))
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in near_links(classes, shard_rows=shard_rows, blocks=blocks).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)

    def parts(pairs):
        root = {p: p for p in prints}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        out = {}
        for p in prints:
            out.setdefault(find(p), set()).add(p)
        return sorted(map(sorted, out.values()))

    every = list(prints)
    want = parts((a, b) for k, a in enumerate(every) for b in every[:k] if (a ^ b).bit_count() <= 3)
    assert parts(links) == want
    values = np.array(every, np.uint64)
    at = np.arange(len(every))
    assert parts((every[a], every[b]) for a, b in forest(values, at, at, 3)) == want
    assert parts((every[a], every[b]) for a, b in small_forest(every, 3)) == want
