import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lodeframe.llm import token_store
from lodeframe.llm.token_count import Counter, token_counts, whole_tokens
from lodeframe.llm.token_store import Encoder, read_metadata, read_tokens, token_digests, write_tokens

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = ["the", " the", "'s", "'S", "don't", " ", "  ", "\n", "\r\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "é", "é", "Σ", "ΑΣ", "İ", "ß", "中文", "🙂", "12345", "½", "!!!", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "_", "A", "Qz", "\x00", "​", "́"]
ODD = [(1, None), (2, ""), (3, " \n "), (4, "a <|endoftext|> b<|endoftext|>"), (5, "x" * 30_000), (5, "same id"), (None, "no id"), (7, "word " * 20_000), (8, "Ünïcödé ΑΣ")]


def odd_texts(n):
    dice = random.Random(5)
    return ["".join(dice.choices(PARTS, k=dice.randrange(1, 14))) for _ in range(n)]


def test_shortcut_equals_the_library():
    definition = open(BYTE).read()
    counter, tokenizer = Counter(definition, whole_tokens(definition)), Tokenizer.from_file(BYTE)
    assert len(counter.whole) > 49_000
    for t in odd_texts(4000):
        assert counter.count(t) == len(tokenizer.encode(t, add_special_tokens=False).ids), repr(t)


def ids_of(encoder, texts):
    ids, sizes = encoder.encode(pa.array(texts, pa.string()), np.array([2], "<i4").tobytes())
    return [x.tolist()[:-1] for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_encoder_equals_the_library():
    encoder, tokenizer = Encoder(open(WORD).read()), Tokenizer.from_file(WORD)
    assert encoder.words
    latin = ["".join(chr(c) for c in range(k, k + 5)) for k in range(0x2FB)] + ["".join(random.Random(k).choices([chr(c) for c in range(0x300)] + ["'", " ", "s"] * 150, k=40)) for k in range(3000)]
    texts = odd_texts(4000) + latin + [t or "" for _, t in ODD]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # the second time all is remembered
        for t, got, right in zip(texts, ids_of(encoder, texts), want, strict=True):
            assert got == right, repr(t)


def test_encoder_of_another_kind_reads_whole_texts():
    encoder, tokenizer = Encoder(open(BYTE).read()), Tokenizer.from_file(BYTE)
    assert not encoder.words
    texts = odd_texts(500)
    assert ids_of(encoder, texts) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(token_store, "REMEMBERED", 10)
    monkeypatch.setattr(token_store, "CALL", 4)
    encoder, tokenizer = Encoder(open(WORD).read()), Tokenizer.from_file(WORD)
    texts = [" ".join(f"w{k}" for k in range(j, j + 50)) for j in range(0, 500, 25)]
    for t in texts:
        assert ids_of(encoder, [t]) == [tokenizer.encode(t, add_special_tokens=False).ids]
        assert len(encoder.known) <= 80 and max(len(encoder.pieces), len(encoder.pieces.old)) <= 10 and len(encoder.known.values) == encoder.known.size.sum()


def test_counts_of_the_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokenizer = Tokenizer.from_file(BYTE)
    want = sorted((r.doc_id, len(r.text.encode()), n := len(tokenizer.encode(r.text, add_special_tokens=False).ids), n > 512) for r in docs.collect())
    assert sorted(map(tuple, token_counts(docs, BYTE).collect())) == want


def test_counts_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 0) for i, t in ODD], "doc_id long, text string, n_tokens int")
    tokenizer = Tokenizer.from_file(BYTE)
    want = sorted(((i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in ODD), key=repr)
    assert sorted(map(tuple, token_counts(docs, BYTE).collect()), key=repr) == want
    assert token_counts(docs.limit(0), BYTE).count() == 0


def digests(rows, end=2):
    tokenizer, start, out = Tokenizer.from_file(WORD), 0, []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 24, 20_000])
def test_store_round_trip(spark, sf_dir, shard_bytes):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = digests(sorted((r.doc_id, r.text) for r in docs.collect()))
    assert sorted(map(tuple, token_digests(docs, WORD, end_id=2, shard_bytes=shard_bytes).collect())) == want


def test_store_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 9) for i, t in ODD], "doc_id long, text string, shard int")
    got = [tuple(r) for r in token_digests(docs, WORD, end_id=2).collect()]
    both = [digests(sorted(((i, t) for i, t in ODD), key=lambda r: (r[0] is not None, r[0] or 0, flip * (r[1] == "same id")))) for flip in (1, -1)]
    assert sorted(got, key=repr) in [sorted(x, key=repr) for x in both]
    assert token_digests(docs.limit(0), WORD, end_id=2).count() == 0


def test_layout_and_selective_reads(spark, sf_dir, tmp_path):
    import glob

    import pyarrow.parquet as pq

    path = f"{tmp_path}/store"
    write_tokens(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), path, WORD, end_id=2, row_group_bytes=1 << 19)
    meta = [pq.ParquetFile(f).metadata for f in sorted(glob.glob(f"{path}/part-*"))]
    assert sum(m.num_row_groups for m in meta) > 1
    columns = {meta[0].row_group(0).column(k).path_in_schema: meta[0].row_group(0).column(k) for k in range(5)}
    assert "RLE_DICTIONARY" in columns["tokens.list.element"].encodings
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index
    plan = read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan
    some = read_tokens(spark, path, "doc_id BETWEEN 100 AND 104")
    assert "GreaterThanOrEqual(doc_id,100)" in some._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in some.collect()) == [100, 101, 102, 103, 104]


def test_repeated_rows_are_spread_over_shards(spark, tmp_path):
    docs = spark.range(20_000).selectExpr("cast(null as long) AS doc_id", "'the same words again' AS text")
    write_tokens(docs, f"{tmp_path}/store", WORD, end_id=2, shard_bytes=40_000)
    sizes = [r["count"] for r in spark.read.parquet(f"{tmp_path}/store").groupBy("shard").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 10_000 and sum(sizes) == 20_000
    starts = sorted(r.start for r in read_metadata(spark, f"{tmp_path}/store").collect())
    assert starts == [5 * k for k in range(20_000)]
