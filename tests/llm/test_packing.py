import random
from collections import defaultdict

from pyspark.sql import functions as F

from lodeframe.llm.packing import pack, pack_shard


def brute(sizes, sources, clusters, capacity):
    """Every bin is looked at for every document."""
    bins, out = [], []
    for k, n in enumerate(sizes):
        for part in range(n // capacity):
            bins.append([0, set(), set()])
            out.append((k, part, part * capacity, capacity, len(bins) - 1, 0))
    for k in sorted(range(len(sizes)), key=lambda k: -(sizes[k] % capacity)):
        n = sizes[k] % capacity
        if not n:
            continue
        fits = [b for b, (room, s, c) in enumerate(bins) if room >= n and sources[k] not in s and (clusters[k] is None or clusters[k] not in c)]
        if fits:
            b = min(fits, key=lambda b: (bins[b][0], b))
        else:
            bins.append([capacity, set(), set()])
            b = len(bins) - 1
        full = sizes[k] // capacity
        out.append((k, full, full * capacity, n, b, capacity - bins[b][0]))
        bins[b][0] -= n
        bins[b][1].add(sources[k])
        bins[b][2].add(clusters[k])
    return out


def test_tightest_compatible_bin():
    dice = random.Random(2)
    for _ in range(300):
        n = dice.randrange(60)
        sizes = [dice.randrange(45) for _ in range(n)]
        sources = [dice.choice("abcdefgh") for _ in range(n)]
        clusters = [dice.choice([None, 1, 2, *range(50)]) for _ in range(n)]
        got, want = (f(sizes, sources, clusters, 20) for f in (pack_shard, brute))
        assert got == want
        check(got, sizes, sources, clusters, 20)


def check(parts, sizes, sources, clusters, capacity):
    covered, bins = defaultdict(list), defaultdict(list)
    for k, part, first, n, b, start in parts:
        covered[k].append((first, n))
        bins[b].append((start, n, k))
    for k, n in enumerate(sizes):
        at = 0
        for first, length in sorted(covered[k]):
            assert first == at
            at += length
        assert at == n
    for held in bins.values():
        at = 0
        for start, n, _ in sorted(held):
            assert start == at
            at += n
        assert at <= capacity
        names = [sources[k] for _, _, k in held]
        marks = [clusters[k] for _, _, k in held if clusters[k] is not None]
        assert len(set(names)) == len(names) and len(set(marks)) == len(marks)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    out = pack(docs, capacity=1024, shard_rows=300).collect()
    assert {r.doc_id for r in out} == set(rows)
    shards = defaultdict(list)
    for r in out:
        shards[r.shard].append(r)
    assert len(shards) == 4
    for parts in shards.values():
        ids = sorted({r.doc_id for r in parts})
        place = {i: k for k, i in enumerate(ids)}
        sizes = [len(rows[i].text.encode().split()) for i in ids]
        check([(place[r.doc_id], r.part, r.first_word, r.n_words, r.bin, r.bin_start) for r in parts if r.n_words], sizes, [rows[i].source for i in ids], [rows[i].text for i in ids], 1024)
    filled = sum(r.n_words for r in out) / (1024 * len({(r.shard, r.bin) for r in out}))
    assert filled > 0.85


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "x " * 5000, None), (4, "one", None), (4, "one", None), (None, "two", "a"), (6, "same", "a"), (7, "same", "b"), (8, "same", "c")]
    docs = spark.createDataFrame([(i, t, s, 5) for i, t, s in rows], "doc_id long, text string, source string, size int")
    out = pack(docs, capacity=2048).collect()
    assert sum(r.n_words for r in out) == 5000 + 1 + 1 + 1 + 3 and len(out) == 2 + 3 + 2 + 1 + 3
    assert [r.bin for r in out if r.n_words == 0] == [None, None]
    assert len({r.bin for r in out if r.doc_id in (6, 7, 8)}) == 3 and len({r.bin for r in out if r.doc_id == 4}) == 2
    assert pack(docs.limit(0)).count() == 0
    assert pack(docs, capacity=10, size=F.col("size")).where("n_words = 5").count() == 9


def test_copies_of_one_row_are_spread(spark):
    """Rows that repeat, or have no identifier, keep to the bounds of a shard as others do."""
    for i in ("7", "cast(null as long)"):
        docs = spark.range(60_000).selectExpr(f"{i} AS doc_id", "'five words in a row' AS text", "'s' AS source")
        parts = pack(docs, shard_rows=4096).groupBy("shard").count().collect()
        assert sum(r["count"] for r in parts) == 60_000 and max(r["count"] for r in parts) <= 1.1 * 4096
