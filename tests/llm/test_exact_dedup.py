import hashlib
from collections import defaultdict

import pytest

from lodeframe.llm.exact_dedup import drop_exact_copies, exact_dedup


def brute(rows, largest):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    pick = max if largest else min
    out = []
    for i, text in rows:
        ids = [x for x in groups[text or ""] if x is not None]
        out.append((i, pick(ids) if ids else None, len(groups[text or ""]), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


ODD = [(1, None), (2, ""), (3, "a"), (4, "a "), (5, "A"), (6, "a"), (6, "a"), (None, "a"), (None, "n"), (None, "n"), (7, "é"), (8, "é"), (9, "x" * 300_000), (10, "x" * 300_000)]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("fan_in,node_rows", [(2, 2), (4, 3), (16, 100_000)])
def test_matches_brute_force(spark, keep, fan_in, node_rows):
    rows = ODD + [(100 + k, f"text {k % 17}") for k in range(120)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, digest int").repartition(7)
    out = exact_dedup(docs, keep=keep, fan_in=fan_in, node_rows=node_rows).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=repr) == brute(rows, keep == "largest")
    kept = [r for r in out if r.kept]
    assert len(kept) == len({t or "" for _, t in rows}) and all(r.doc_id == r.keep_id for r in kept)


def test_stage_keeps_one_row_and_all_columns(spark):
    docs = spark.createDataFrame([(i, t, "en", "kept?") for i, t in ODD], "doc_id long, text string, lang string, kept string")
    out = drop_exact_copies(docs, keep="largest")
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, len(r.text or "")) for r in out.collect()), key=repr) == sorted([(2, 0), (6, 1), (4, 2), (5, 1), (None, 1), (7, 1), (8, 2), (10, 300_000)], key=repr)


def test_no_rows(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
