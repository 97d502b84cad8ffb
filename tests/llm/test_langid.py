import numpy as np
from pyspark.sql import functions as F

from lodeframe.llm.langid import WINDOW, Network, fit, forward, identify, keep_identified, language_id, train, training_sample, windows_of


def test_windows_cover_every_byte():
    texts = [b"", b"a", b"b" * WINDOW, b"c" * (WINDOW + 1), bytes(range(1, 256)) * 9]
    matrix, owner, weight = windows_of(texts)
    for k, t in enumerate(texts):
        assert b"".join(row.tobytes() for row in matrix[owner == k])[: len(t)] == t
        assert weight[owner == k].sum() == max(1, len(t))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 150 and right >= 0.97
    scores = [r.score for r in out.collect()]
    assert min(scores) >= 0 and max(scores) <= 1


def test_label_source_and_identifier_are_no_inputs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(docs)
    a = identify(docs, net).select("doc_id", "lang_pred", "score")
    b = identify(docs.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text", F.lit("xx").alias("lang")), net)
    assert sorted((r.doc_id + 1_000_000, r.lang_pred, r.score) for r in a.collect()) == sorted((r.doc_id, r.lang_pred, r.score) for r in b.collect())


def test_odd_rows(spark, sf_dir):
    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(900_001, None, "en"), (900_002, "", "en"), (900_003, "123 -- 4", None), (900_004, "the and of with this that from", None), (None, "the and of", "en"), (900_005, "que el la los para con una", None), (900_005, "the of and " * 40_000, None)]
    docs = labelled.select("doc_id", "text", "lang").union(spark.createDataFrame(odd, "doc_id long, text string, lang string")).withColumn("score", F.lit("clash"))
    out = {r.doc_id: r for r in language_id(docs).where("doc_id > 900000 or doc_id is null").collect()}
    assert {k for k, r in out.items() if r.lang_pred == "und"} == {900_001, 900_002, 900_003}
    assert all(out[k].score == 0 for k in (900_001, 900_002, 900_003))
    kept = keep_identified(docs)
    assert kept.columns == docs.columns
    assert not {900_001, 900_002, 900_003} & {r.doc_id for r in kept.collect()}
    assert kept.count() >= 0.97 * labelled.count()


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {(r.doc_id, r.lang_pred, r.score) for r in language_id(docs).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert language_id(docs.limit(0)).count() == 0
    assert np.shape(keep_identified(docs).collect())[0] == 0


def random_network(dice, languages=3, depth=4, widths=(2, 3, 4), filters=5):
    return Network(
        [f"l{k}" for k in range(languages)],
        dice.normal(size=(256, depth)),
        {w: dice.normal(size=(w * depth, filters)) for w in widths},
        {w: dice.normal(size=filters) for w in widths},
        dice.normal(size=(filters * len(widths), languages)),
        dice.normal(size=languages),
    )


def naive(net, window):
    """The network by loops."""
    pooled = []
    for w, kernel in net.filters.items():
        for f in range(kernel.shape[1]):
            best = -np.inf
            for at in range(WINDOW - w + 1):
                value = sum(net.embedding[window[at + k]] @ kernel[k * net.embedding.shape[1] : (k + 1) * net.embedding.shape[1], f] for k in range(w))
                best = max(best, value)
            pooled.append(max(best + net.biases[w][f], 0))
    e = np.exp(np.array(pooled) @ net.output + net.offset)
    return e / e.sum()


def test_network_equals_a_naive_convolution():
    dice = np.random.default_rng(4)
    net = random_network(dice)
    windows = dice.integers(0, 256, (3, WINDOW)).astype(np.uint8)
    windows[2, 40:] = 0
    for row, window in zip(forward(net, windows), windows):
        assert np.allclose(row, naive(net, window))


def test_training_descends_by_the_right_gradient():
    """Adam's first step moves each weight by the rate against the sign of its slope, which differences of the loss give."""
    dice = np.random.default_rng(5)
    windows, labels = dice.integers(97, 100, (6, WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    at_start = train(windows, labels, ["a", "b", "c"], epochs=0, filters=4, depth=3)
    after = train(windows, labels, ["a", "b", "c"], epochs=1, filters=4, depth=3, rate=1e-3)

    def loss(net):
        wide = Network(net.languages, net.embedding.astype(float), {w: v.astype(float) for w, v in net.filters.items()}, {w: v.astype(float) for w, v in net.biases.items()}, net.output.astype(float), net.offset.astype(float))
        return -np.log(forward(wide, windows)[np.arange(6), labels]).mean()

    checked = 0
    for pick in (lambda n: n.output, lambda n: n.offset, lambda n: n.filters[2], lambda n: n.filters[4], lambda n: n.biases[3], lambda n: n.embedding[97:100]):
        weights = pick(at_start)
        for place in list(np.ndindex(weights.shape))[:8]:
            old = weights[place]
            weights[place] = old + 2e-3
            up = loss(at_start)
            weights[place] = old - 2e-3
            slope = (up - loss(at_start)) / 4e-3
            weights[place] = old
            if abs(slope) > 2e-3:
                assert np.sign(pick(after)[place] - old) == -np.sign(slope)
                checked += 1
    assert checked > 15


def test_sample_keeps_its_bounds(spark):
    for i in ("id", "7L", "cast(null as long)"):
        rows = spark.range(9_000).selectExpr(f"{i} AS id", "cast('the same text' AS binary) AS text", "if(id % 3 = 0, 'a', 'b') AS lang", "id AS row")
        matrix, labels, languages = training_sample(rows, 500, 10)
        assert languages == ["a", "b"] and 400 <= (labels == 0).sum() <= 500 and 400 <= (labels == 1).sum() <= 500
    many = spark.range(300).selectExpr("id", "cast('text' AS binary) AS text", "concat('l', id) AS lang", "id AS row")
    assert len(training_sample(many, 5, 20)[2]) <= 20


def test_columns_of_other_names(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    other = docs.select(F.col("doc_id").alias("my id"), F.col("text").alias("body"), "lang", F.lit(0).alias("doc_id"), F.lit("x").alias("text"))
    want = sorted(map(tuple, language_id(docs).collect()))
    assert sorted(map(tuple, language_id(other, id_col="my id", text_col="body").collect())) == want
    assert keep_identified(other, id_col="my id", text_col="body").count() == keep_identified(docs).count()
