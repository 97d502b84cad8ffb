import math

import numpy as np
import pytest

from lodeframe.llm.ann import balanced_parts, nearest, neighbour_graph, unit


def brute(rows, k=5, every=50):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids = np.array([i for i, _ in good])
    x = np.array([v for _, v in good])
    out = {}
    for q, v in good:
        if q % every == 0:
            score = (x * v).sum(axis=1) / np.sqrt((x * x).sum(axis=1)) / np.sqrt((v * v).sum())
            order = [j for j in np.lexsort((ids, -np.round(score, 12))) if ids[j] != q]
            out[q] = [(int(ids[j]), float(score[j])) for j in order[:k]]
    return out


def recall_of(got, want):
    hit = sum(len({v for v, _ in got.get(q, [])} & {v for v, _ in near}) for q, near in want.items())
    return hit / sum(map(len, want.values()))


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("options", [{}, {"part_rows": 200, "sample_rows": 1000}, {"part_rows": 300, "piece_rows": 50, "query_rows": 8}])
def test_recall_against_brute_force(spark, options):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want, got = brute(rows), collected(nearest(table, **options))
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    assert recall_of(got, want) >= 0.9
    exact = {(q, v): s for q, near in brute(rows, k=len(rows)).items() for v, s in near}
    assert all(s == pytest.approx(exact[q, v], abs=1e-12) for q, near in got.items() for v, s in near)


def test_odd_rows_and_many_copies(spark):
    dice = np.random.default_rng(1)
    good = [(i, dice.normal(size=4).tolist()) for i in range(1, 150)]
    odd = [(200, None), (250, [0.0] * 4), (300, [1.0, None, 0.0, 2.0]), (350, [math.nan, 1.0, 1.0, 1.0]), (400, [math.inf, 1.0, 1.0, 1.0]), (450, [1.0, 2.0]), (None, [1.0] * 4), (500, good[3][1]), (500, good[3][1])]
    copies = [(1000 + i, [0.5, -0.0, 0.25, 1.0]) for i in range(400)]
    rows = good + odd + copies
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, part string").repartition(6)
    rounded = [(i, None if v is None or len(v) != 4 else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = brute([*dict((str(r), r) for r in rounded).values()])
    got = collected(nearest(table, part_rows=10_000))
    assert {q: [v for v, _ in near] for q, near in got.items()} == {q: [v for v, _ in near] for q, near in want.items()}
    assert 1050 in got and [v for v, _ in got[1050]] == [1000, 1001, 1002, 1003, 1004]
    assert nearest(table.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert collected(nearest(few)) == {0: [(1, 0.0)]}


@pytest.mark.parametrize("options", [{}, {"piece_rows": 20}])
def test_many_scaled_copies_tie_by_identifier(spark, options):
    """Scaled copies are classes of their own with the same cosine: the smallest identifiers are due."""
    dice = np.random.default_rng(4)
    base = dice.integers(1, 9, 8).astype(float)
    rows = [(0, base.tolist())] + [(i, (base * 2.0**scale).tolist()) for i, scale in zip(range(1, 51), dice.permutation(50) + 1, strict=True)]
    rows += [(i, dice.normal(size=8).tolist()) for i in range(101, 150)]
    table = spark.createDataFrame([rows[k] for k in dice.permutation(len(rows))], "vec_id long, embedding array<float>").repartition(3)
    got = collected(nearest(table, **options))
    assert [v for v, _ in got[0]] == [1, 2, 3, 4, 5] and [v for v, _ in got[50]] == [0, 1, 2, 3, 4]


def test_parts_are_balanced():
    x = unit(np.random.default_rng(0).normal(size=(900, 16)))
    label = balanced_parts(x, neighbour_graph(x, 8), 7)
    size = np.bincount(label, minlength=7)
    assert size.min() > 0 and size.max() <= math.ceil(1.1 * 900 / 7)
