from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from test_overlap import brute as kept_of_copies


def words(text):
    return len((text or "").encode().split())


def test_every_stage_on_its_own_input(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(9_001, None, "en", "src0", 0), (9_002, "", None, None, 0), (9_003, "12 34 !!", "en", "src1", 8)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.union(extra)
    seen = [sorted(map(tuple, docs.collect()), key=repr)]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(sorted(map(tuple, docs.collect()), key=repr))
    start, known, unique, apart, mixed, packed = seen
    assert set(known) <= set(start) and len(known) >= len(start) - 6 and not {9_001, 9_002, 9_003} & {r[0] for r in known}
    first = {}
    for r in sorted(known):
        first.setdefault(r[1], r)
    assert sorted(first.values(), key=repr) == unique
    assert kept_of_copies([r[:2] for r in unique]) == sorted(r[0] for r in apart)
    assert set(apart) <= set(unique)
    original = {r[0]: r for r in apart}
    taken = defaultdict(int)
    for r in mixed:
        taken[r[0]] += words(r[1])
        assert r[2:4] == original[r[0]][2:4] and r[4] == len(r[1])
        assert r[1] == original[r[0]][1] or words(r[1]) < words(original[r[0]][1])
    assert all(n <= 3 * words(original[i][1]) for i, n in taken.items())
    total = sum(words(r[1]) for r in apart)
    assert abs(sum(taken.values()) - total) <= 25
    assert sum(r[3] for r in packed) == sum(taken.values())
    held = Counter()
    rests = defaultdict(list)
    for doc, _, _, n, shard, bin_, _ in packed:
        held[shard, bin_] += n
        rests[shard, bin_].append(doc)
    assert max(held.values()) <= 2048 and all(len(set(x)) == len(x) for x in rests.values())


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "part", "first_word", "n_words", "shard", "bin", "bin_start"] and out.count() > 50


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_clashing_columns_and_shared_identifiers(spark, sf_dir):
    """Columns with any name come through; different texts without or with one identifier all stay."""
    odd = ["__id", "row", "kept", "mark", "sha", "fp", "low", "size", "shard", "drawn", "letter", "score", "a b.c"]
    texts = ["one two three four rivers run", "mountains stand where no river goes", "the third text speaks of the sea", "and a fourth of the wide plain", "the third text speaks of the sea"]
    extra = spark.createDataFrame([(i, t, "en", None, len(t)) for i, t in zip([None, None, 9_001, 9_001, 9_001], texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").union(extra)
    docs = docs.select("*", *[F.lit(c).alias(c) for c in odd])
    for name, stage in corpus_pipeline.STAGES[1:3]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        new = [(r[0], r[1]) for r in out.collect() if r[0] in (None, 9_001)]
        assert sorted(new, key=repr) == sorted({(None, texts[0]), (None, texts[1]), (9_001, texts[2]), (9_001, texts[3])}, key=repr), name
    for _, stage in (corpus_pipeline.STAGES[0], corpus_pipeline.STAGES[3]):
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert {tuple(r[c] for c in odd) for r in out.collect()} == {tuple(odd)}
    assert corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).count() >= docs.where("text RLIKE '[^ ]'").count()


def test_long_texts_and_repeated_rows_through_all_stages(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = " ".join(f"the river runs {k} miles and the mountain" for k in range(12_000))
    rows = [(9_001, words, "en", "src0", len(words)), (9_002, words + " end", "en", "src0", len(words) + 4), (9_003, "all the rivers run to the sea", "en", "src1", 29)]
    docs = table.union(spark.createDataFrame([*rows, *[rows[2]] * 40], table.schema))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids = Counter(r.doc_id for r in docs.where("doc_id > 9000").collect())
        if k == 0:
            assert ids == {9_001: 1, 9_002: 1, 9_003: 41}
        elif k == 1:
            assert ids == {9_001: 1, 9_002: 1, 9_003: 1}
        elif k == 2:
            assert ids == {9_001: 1, 9_003: 1}
    assert docs.where("doc_id = 9001").agg(F.max("n_words")).first()[0] == 2048
