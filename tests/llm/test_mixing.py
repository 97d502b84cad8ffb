import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodeframe.llm.mixing import hypergeometric, mix, mixed_documents, source_targets, with_leaf_quotas


def brute_targets(sizes):
    """sizes: source -> words. The excess is given out again and again until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    while True:
        rest = total - sum(target.values())
        level = rest / max(1, sum(weight[s] for s in open_))
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {"a": 0, "b": 0}, {None: 100, "z": 3, "": 7, "é": 50, "Z": 1}, {"only": 9}, {f"s{k}": (k * 37) % 101 for k in range(40)}, {"hot": 10_000, **{f"t{k}": 3 for k in range(25)}}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source_key string, size long")
    got = {r.source_key: r.target for r in source_targets(rows).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def check_mix(rows, out, tolerance=1.0):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    source = {i: s for i, s, _ in rows}
    for i, s, t in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(sizes)
    assert len(out) == len(rows)
    for r in out:
        s = source[r.doc_id]
        taken[s] += r.taken
        target[s] = r.target
        assert r.source_size == sizes[s] and 0 <= r.taken <= 3 * r.size
        assert r.target == pytest.approx(want[s])
        spans = [(b["at"], b["at"] + b["length"]) for b in r.drawn]
        assert r.taken == r.passes * r.size + sum(y - x for x, y in spans)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and all(0 <= x < y <= r.size for x, y in spans)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= tolerance


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mix(docs).collect()
    check_mix([(r.doc_id, r.source, r.text) for r in docs.collect()], out)
    again = mix(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken, r.shard, r.slot) for r in out) == sorted((r.doc_id, r.taken, r.shard, r.slot) for r in again)


def test_odd_rows_and_stage(spark):
    rows = [(1, "a", None), (2, "a", ""), (3, None, "one two  three"), (4, "b", "x " * 30_000), (5, "b", "w\tv\nu"), (6, "", "solo")] + [(10 + k, "hot", f"hot words {k} here") for k in range(300)]
    docs = spark.createDataFrame([(i, s, t, 1, "k") for i, s, t in rows], "doc_id long, source string, text string, size int, taken string")
    out = mix(docs).collect()
    check_mix(rows, out)
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = defaultdict(int)
    originals = {i: (t or "").split() for i, _, t in rows}
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
        assert set(r.text.split()) <= set(originals[r.doc_id])
    assert {r.doc_id: r.taken for r in out if r.taken} == dict(words)
    assert mix(docs.limit(0)).count() == 0 and mixed_documents(docs.limit(0)).count() == 0
    assert {r.taken for r in mix(docs.where("doc_id < 3")).collect()} == {0}


def test_repeated_rows_are_drawn_one_by_one(spark):
    docs = spark.createDataFrame([(7, "a", "p q r s"), (7, "a", "p q r s"), (None, "b", "t u"), (None, "b", "t u"), (9, "c", "v " * 40)], "doc_id long, source string, text string")
    out = mix(docs, block_words=2).collect()
    assert len(out) == 5 and sum(r.taken for r in out) == pytest.approx(sum(r.size for r in out), abs=2)


def test_hypergeometric_has_the_right_law(spark):
    import math

    for good, bad, draws in ((5, 9, 6), (3, 400, 100), (70, 20, 45), (1, 1, 1)):
        counts = {r.h: r["count"] for r in spark.range(6000).select(F.expr(hypergeometric(str(good), str(bad), str(draws), "id")).alias("h")).groupBy("h").count().collect()}
        chance = lambda k: math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws)
        cells = [(counts.get(k, 0), 6000 * chance(k)) for k in range(max(0, draws - bad), min(good, draws) + 1)]
        assert sum(n for n, _ in cells) == 6000
        large = [(n, e) for n, e in cells if e >= 5]
        assert sum((n - e) ** 2 / e for n, e in large) < 3 * len(large) + 15


def test_leaves_are_exact(spark):
    words = [5, 0, 17, 100, 3, 3, 0, 9]
    upto = [sum(words[: k + 1]) for k in range(8)]
    for quota in (0, 1, 60, 136, 137):
        row = with_leaf_quotas(spark.createDataFrame([("s", upto, quota, 3)], "source_key string, upto array<long>, rest long, levels int"), 4, "source_key").first()
        assert sum(row.quotas) == quota and all(0 <= q <= w for q, w in zip(row.quotas, words))


def test_leaves_that_are_no_power_of_two(spark):
    words = [5, 9, 17, 100, 3]
    upto = [sum(words[: k + 1]) for k in range(5)]
    for quota in (0, 1, 60, 133, 134):
        row = with_leaf_quotas(spark.createDataFrame([("s", upto, quota, 3)], "source_key string, upto array<long>, rest long, levels int"), 3, "source_key").first()
        assert sum(row.quotas[:5]) == quota and not any(row.quotas[5:]) and all(0 <= q <= w for q, w in zip(row.quotas, words))


def test_copies_of_one_row_are_spread(spark):
    for i in ("7", "cast(null as long)"):
        docs = spark.range(20_000).selectExpr(f"{i} AS doc_id", "'five words in a row' AS text", "if(id < 15000, 's', 't') AS source")
        out = mix(docs)
        parts = [r["count"] for r in out.groupBy("shard").count().collect()]
        assert sum(parts) == 20_000 and max(parts) < 20_000 / 256 * 2
        assert out.agg(F.sum("taken")).first()[0] == pytest.approx(100_000, abs=3)


def test_many_sources(spark):
    docs = spark.range(3_000).selectExpr("id AS doc_id", "'one two three four' AS text", "concat('s', id) AS source")
    out = mix(docs).collect()
    assert len(out) == 3_000 and sum(r.taken for r in out) == pytest.approx(12_000, abs=1500)
    assert all(abs(r.taken - r.target) <= 0.5 for r in out)
