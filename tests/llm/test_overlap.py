import random

import corpus_pipeline
import pytest

from lodeframe.llm.overlap import drop_similar


def brute(rows, shingle=5, least=0.8):
    """The identifiers that stay."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(i, low.get(find(k), i))
    return sorted(low.values())


def edited(words, count, dice):
    out = list(words)
    for at in range(count):  # so far apart that each takes five shingles
        out[at * (len(out) // count) + dice.randrange(5, len(out) // count - 5)] = f"new{dice.randrange(10**9)}"
    return out


@pytest.mark.parametrize("options", [None, {}])
def test_edited_copies_go_and_others_stay(spark, sf_dir, options):
    dice = random.Random(5)
    rows = []
    for k in range(30):
        words = [f"w{dice.randrange(4000)}" for _ in range(300)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(edited(words, 3, dice))), (10 * k + 2, " ".join(edited(words, 6, dice)).upper()), (10 * k + 3, " ".join(edited(words, 12, dice)))]
    rows += [(1000 + k, "spam " * 300 + " ".join(f"t{k}x{j}" for j in range(60))) for k in range(5)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    out = corpus_pipeline.near_dedup(spark, docs, sf_dir) if options is None else drop_similar(docs, **options)
    assert out.columns == docs.columns
    kept = sorted(r.doc_id for r in out.collect())
    assert kept == brute(rows) and kept == sorted([10 * k for k in range(30)] + [10 * k + 3 for k in range(30)] + [1000 + k for k in range(5)])


def test_chains_within_a_key(spark):
    """Many texts under common keys, joined in chains: what the first pass leaves apart is checked too."""
    dice = random.Random(6)
    base = [f"w{j}" for j in range(150)]
    rows, now = [], base
    for k in range(60):
        now = edited(now, 2, dice)
        rows.append((k, " ".join(now)))
    rows += [(100, None), (101, " \n"), (102, "One two"), (103, "one TWO"), (104, "one"), (105, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in drop_similar(docs).collect()) == brute(rows)


def test_stage_on_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()) == brute(rows)
