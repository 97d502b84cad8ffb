"""Language identification by a convolutional network over bytes.

Texts are cut into windows of ``WINDOW`` bytes, all of them, the last one
padded. Byte embeddings go through filters of several widths, each filter's
largest response in the window is kept, and a softmax layer gives the
probability of each language. A text's score is the mean over its windows,
weighted by their bytes. Training is plain numpy (Adam) on labelled text.

``lang`` is read for training only; source and identifier never reach the
network. The training sample is bounded: ``per_language`` windows of each of the
``most_languages`` most common languages at most, drawn by a hash over all
labelled rows, so the driver's part does not grow with the corpus, whatever its
labels and however often rows repeat. Everything else reads every row and every byte.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a
text shorter than a window is one padded window; without labelled rows every
text is ``und``; repeated rows get equal answers (scores are rounded to six
places, as the network works in single precision); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import crc_fold, narrow
from .spans import slices

WINDOW = 256
UNKNOWN = "und"
#: Bytes of text that go through the network at once.
SLICE_BYTES = 1 << 17


@dataclass
class Network:
    """Weights. ``embedding`` is 256 x d; ``filters[w]`` is (w * d) x f; ``output`` is (all f) x languages."""

    languages: list[str]
    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    output: np.ndarray
    offset: np.ndarray


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows as a byte matrix, the text of each and its bytes without padding. An empty text has one window."""
    size = np.array([len(t) for t in texts], np.int64)
    count = np.maximum(1, -(-size // WINDOW))
    first = np.concatenate([[0], np.cumsum(count)])
    flat = np.zeros(first[-1] * WINDOW, np.uint8)
    for k, t in enumerate(texts):
        flat[first[k] * WINDOW : first[k] * WINDOW + len(t)] = np.frombuffer(t, np.uint8)
    owner = np.repeat(np.arange(len(texts)), count)
    place = np.arange(first[-1]) - first[owner]
    return flat.reshape(-1, WINDOW), owner, np.maximum(1, np.minimum(WINDOW, size[owner] - place * WINDOW))


def forward(net: Network, windows: np.ndarray) -> np.ndarray:
    """Probabilities for each window."""
    n = len(windows)
    embedded = net.embedding[windows].reshape(n, -1)
    d = net.embedding.shape[1]
    pooled = []
    for w, kernel in net.filters.items():
        steps = WINDOW - w + 1
        views = np.lib.stride_tricks.as_strided(embedded, (n, steps, w * d), (embedded.strides[0], d * embedded.itemsize, embedded.itemsize))
        pooled.append(np.maximum((views.reshape(n * steps, w * d) @ kernel).reshape(n, steps, -1).max(axis=1) + net.biases[w], 0))
    return _softmax(np.concatenate(pooled, axis=1) @ net.output + net.offset)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], *, widths=(2, 3, 4), filters: int = 16, depth: int = 8, epochs: int = 8, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> Network:
    """Fit a network to labelled windows."""
    dice = np.random.default_rng(seed)
    f32 = np.float32
    net = Network(
        languages,
        dice.normal(0, 0.5, (256, depth)).astype(f32),
        {w: dice.normal(0, (2 / (w * depth)) ** 0.5, (w * depth, filters)).astype(f32) for w in widths},
        {w: np.zeros(filters, f32) for w in widths},
        dice.normal(0, (1 / (filters * len(widths))) ** 0.5, (filters * len(widths), len(languages))).astype(f32),
        np.zeros(len(languages), f32),
    )
    weights = {("e", 0): net.embedding, ("o", 0): net.output, ("b", 0): net.offset}
    weights |= {("k", w): net.filters[w] for w in widths} | {("c", w): net.biases[w] for w in widths}
    mean = {k: np.zeros_like(v) for k, v in weights.items()}
    square = {k: np.zeros_like(v) for k, v in weights.items()}
    step = 0
    for _ in range(epochs):
        order = dice.permutation(len(windows))
        for begin in range(0, len(order), batch):
            rows = order[begin : begin + batch]
            x, y, n = windows[rows], labels[rows], len(rows)
            embedded = net.embedding[x].reshape(n, -1)
            kept, pooled = {}, []
            for w in widths:
                steps = WINDOW - w + 1
                views = np.lib.stride_tricks.as_strided(embedded, (n, steps, w * depth), (embedded.strides[0], depth * 4, 4)).reshape(n * steps, w * depth)
                response = (views @ net.filters[w]).reshape(n, steps, filters)
                at = response.argmax(axis=1)
                top = np.take_along_axis(response, at[:, None, :], axis=1)[:, 0] + net.biases[w]
                kept[w] = (views.reshape(n, steps, -1), at, top > 0)
                pooled.append(np.maximum(top, 0))
            hidden = np.concatenate(pooled, axis=1)
            error = _softmax(hidden @ net.output + net.offset)
            error[np.arange(n), y] -= 1
            error /= n
            back = error @ net.output.T
            slopes = {("o", 0): hidden.T @ error, ("b", 0): error.sum(axis=0)}
            by_byte = np.zeros_like(net.embedding)
            for j, w in enumerate(widths):
                views, at, live = kept[w]
                part = back[:, j * filters : (j + 1) * filters] * live
                best = views[np.arange(n)[:, None], at]  # n x filters x (w * depth)
                slopes["k", w] = np.einsum("nfi,nf->if", best, part)
                slopes["c", w] = part.sum(axis=0)
                to_input = part[:, :, None] * net.filters[w].T[None]
                for k in range(w):
                    np.add.at(by_byte, np.take_along_axis(x, at + k, axis=1), to_input[:, :, k * depth : (k + 1) * depth])
            slopes["e", 0] = by_byte
            step += 1
            for k, v in weights.items():
                g = slopes[k].astype(f32)
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                v -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(f32)
    return net


def training_sample(docs: DataFrame, per_language: int, most_languages: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, labels and languages of a sample that a hash draws from all labelled rows.

    ``docs`` has id, text (binary), lang and row. Only one window of a drawn row
    leaves its executor, and no language has more than ``per_language``: where
    the hash draws more, those with the smallest hashes. The row's number is
    part of the hash, so copies are drawn apart.
    """
    common = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages)
    counts = {r[0]: r[1] for r in common.collect()}  # a row for each output of the network
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    rows_of = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])
    share = docs.withColumns({"count": rows_of[F.col("lang")], "hash": F.pmod(F.xxhash64("id", F.octet_length("text"), "row"), F.lit(1 << 40))})
    place = F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.lit(1), F.ceil(F.octet_length("text") / WINDOW)))
    drawn = share.where(F.col("hash") / float(1 << 40) * F.col("count") < per_language).select("lang", "hash", F.substring("text", (place * WINDOW + 1).cast("int"), F.lit(WINDOW)).alias("window"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "window"))
    rows = sorted((r.lang, bytes(r.window)) for r in drawn.withColumn("place", first).where(F.col("place") <= per_language).collect())
    languages = sorted({lang for lang, _ in rows})
    matrix, _, _ = windows_of([w for _, w in rows]) if rows else (np.zeros((0, WINDOW), np.uint8), None, None)
    return matrix, np.array([languages.index(lang) for lang, _ in rows], np.int64), languages


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1500, most_languages: int = 512, **options) -> Network | None:
    """Train on the rows of ``labelled`` that have text and language; None without any.

    The sample has ``per_language`` windows of each of the ``most_languages`` most common languages at most.
    """
    rows = narrow(labelled, id=id_col, text=text_col, lang=lang_col).withColumn("row", F.monotonically_increasing_id()).where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'")
    windows, labels, languages = training_sample(rows.withColumn("text", F.col("text").cast("binary")), per_language, most_languages)
    return train(windows, labels, languages, **options) if languages else None


def _scored(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            total = np.zeros((len(texts), len(net.languages)))
            has = np.flatnonzero(b.column("letter").to_numpy(zero_copy_only=False))
            for s in slices((len(texts[k]) for k in has), SLICE_BYTES):
                windows, owner, weight = windows_of([texts[k] for k in has[s]])
                for k in range(0, len(windows), SLICE_BYTES // WINDOW):  # a text can be longer than a slice
                    here = slice(k, k + SLICE_BYTES // WINDOW)
                    np.add.at(total, has[s][owner[here]], forward(net, windows[here]) * weight[here, None])
            weight = total.sum(axis=1)
            best = total.argmax(axis=1)
            score = np.divide(total[np.arange(len(texts)), best], weight, out=np.zeros(len(texts)), where=weight > 0)
            lang = [net.languages[k] if w > 0 else UNKNOWN for k, w in zip(best, weight, strict=True)]
            yield pa.record_batch([*(b.column(c) for c in range(b.num_columns - 2)), pa.array(lang, pa.string()), pa.array(np.clip(np.round(score, 6), 0, 1))], [*b.schema.names[:-2], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, net: Network | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score for each row."""
    source = narrow(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    if net is None:
        return source.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    rows = source.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), letter)
    return rows.mapInArrow(_scored(net), "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """Whether a document is outside the training folds."""
    return crc_fold(id_col, 4) == 2


def language_id(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Train on the labelled documents outside the held-out fold, then predict every document; ``options`` are those of ``fit``."""
    net = fit(docs.where(~held_out(f"`{id_col}`")), id_col=id_col, text_col=text_col, **options)
    return identify(docs, net, id_col=id_col, text_col=text_col).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_score: float = 0.4, **options) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of ``min_score`` at least, all columns kept.

    Rows go through the network with their columns beside them, so no join and no shuffle is needed.
    """
    net = fit(docs.where(~held_out(f"`{id_col}`")), id_col=id_col, text_col=text_col, **options)
    if net is None:
        return docs.limit(0)
    text = F.col(f"`{text_col}`")
    letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("__letter")
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    fed = docs.select(columns, F.coalesce(text, F.lit("")).cast("binary").alias("text"), letter.alias("letter"))
    schema = StructType([fed.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    scored = fed.mapInArrow(_scored(net), schema)
    return scored.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select("row.*")
