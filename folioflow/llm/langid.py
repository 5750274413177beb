"""Language identification by a small byte convolutional network, trained in numpy.

A text's bytes are cut into windows of fixed length, the last padded with zeros. Every byte has a learned embedding;
filters of several widths slide over it, the largest response of each filter in the window goes through a softmax layer. A
document's probabilities are those of its windows, weighted by their bytes: whole texts are read, no matter how long.

Training: rows with a language whose crc32(id as text) mod 4 is not 2, from a bounded sample: SAMPLE_DOCS documents of every
language, fewer where there are more than ALL_DOCS / SAMPLE_DOCS languages but one at least, WINDOWS_A_DOC windows each. The sample is chosen by a hash of the id, and everything is
seeded, so that a model depends on the table alone.

Cases: a null text, or one without any letter, is `und` with score 0; repeated rows give repeated result rows; a null id is
not held out and not learned from; a table without labelled rows gives `und` everywhere; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, utf8

UNKNOWN = "und"
WINDOW = 256
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 12, 8
SAMPLE_DOCS, ALL_DOCS, WINDOWS_A_DOC = 400, 100_000, 4
EPOCHS, BATCH, RATE, SEED = 8, 64, 4e-3, 7
#: Windows whose responses are computed at once.
INFER = 64
HELD_OUT_OF, HELD_OUT = 4, 2


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: np.ndarray  # max(WIDTHS) * EMBEDDING x filters of all widths; rows beyond a filter's width are zero
    bias: np.ndarray
    weights: np.ndarray  # filters x languages
    offset: np.ndarray

    def responses(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """windows: n x WINDOW bytes -> patches (n, WINDOW, taps * EMBEDDING) and the filters' responses to them."""
        taps = max(WIDTHS)
        seen = self.embedding[np.pad(windows, ((0, 0), (0, taps - 1)))].reshape(len(windows), -1)
        patches = np.lib.stride_tricks.sliding_window_view(seen, taps * EMBEDDING, axis=1)[:, ::EMBEDDING]
        patches = np.ascontiguousarray(patches)
        return patches, (patches.reshape(-1, taps * EMBEDDING) @ self.filters).reshape(len(windows), WINDOW, -1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for i in range(0, len(windows), INFER):
            pooled = self.responses(windows[i : i + INFER])[1].max(axis=1) + self.bias
            out[i : i + INFER] = _softmax(np.maximum(pooled, 0) @ self.weights + self.offset)
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str]) -> Network:
    """Fit a network to windows (n x WINDOW bytes) and labels (places in languages) by Adam on the cross-entropy."""
    random = np.random.default_rng(SEED)
    taps, total = max(WIDTHS), FILTERS * len(WIDTHS)
    inside = np.concatenate([np.repeat(np.arange(taps * EMBEDDING)[:, None] < w * EMBEDDING, FILTERS, axis=1) for w in WIDTHS], axis=1)
    scale = np.concatenate([np.full(FILTERS, (2 / (w * EMBEDDING)) ** 0.5) for w in WIDTHS])
    values = [
        random.normal(0, 1, (256, EMBEDDING)),
        random.normal(0, 1, (taps * EMBEDDING, total)) * scale * inside,
        np.zeros(total),
        random.normal(0, (1 / total) ** 0.5, (total, len(languages))),
        np.zeros(len(languages)),
    ]
    values = [v.astype(np.float32) for v in values]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    net = Network(languages, *values)
    # Each language counts alike, however many windows it has.
    share = np.bincount(labels, minlength=len(languages)).astype(np.float32)
    weight = (len(labels) / len(languages) / np.maximum(share, 1))[labels]
    step = 0
    for _ in range(EPOCHS):
        order = random.permutation(len(labels))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            x, y, n = windows[rows], labels[rows], len(rows)
            patches, z = net.responses(x)
            at = z.argmax(axis=1)
            pooled = np.take_along_axis(z, at[:, None], axis=1)[:, 0] + net.bias
            hidden = np.maximum(pooled, 0)
            wrong = _softmax(hidden @ net.weights + net.offset)
            wrong[np.arange(n), y] -= 1
            wrong *= (weight[rows] / n)[:, None]
            back = (wrong @ net.weights.T) * (pooled > 0)
            picked = patches[np.arange(n)[:, None], at]  # n x filters x taps * EMBEDDING
            into = back[:, :, None] * net.filters.T[None]
            d_embedding = np.zeros_like(net.embedding)
            padded = np.pad(x, ((0, 0), (0, taps - 1)))
            touched = padded[np.arange(n)[:, None, None], at[:, :, None] + np.arange(taps)]
            np.add.at(d_embedding, touched.ravel(), into.reshape(-1, EMBEDDING))
            slopes = [d_embedding, np.einsum("nf,nfk->kf", back, picked) * inside, back.sum(axis=0), hidden.T @ wrong, wrong.sum(axis=0)]
            step += 1
            for value, slope, m, v in zip(values, slopes, first, second, strict=True):
                m += 0.1 * (slope - m)
                v += 0.001 * (slope * slope - v)
                value -= (RATE * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def cut(text: bytes) -> np.ndarray:
    """A text's windows, the last padded with zeros."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, WINDOW)


def training_windows(text: bytes) -> list[bytes]:
    """WINDOWS_A_DOC pieces of a text for training: half of them of full length, the others shorter ones as of short texts."""
    random = np.random.default_rng(zlib.crc32(text))
    out = []
    for k in range(WINDOWS_A_DOC):
        size = WINDOW if k % 2 == 0 else int(random.integers(8, WINDOW))
        start = int(random.integers(0, max(1, len(text) - size + 1)))
        out.append(text[start : start + size])
    return out


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % HELD_OUT_OF == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network of the languages of docs, from the bounded sample; None if no row has a language and a text."""
    rows = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    # A row a language. Ids are counted, not rows: one that is repeated often takes no other's place.
    counts = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.approx_count_distinct(id_col, 0.03).alias("n")).collect()
    if not counts:
        return None
    wanted = max(1, min(SAMPLE_DOCS, ALL_DOCS // len(counts)))
    # Somewhat more than the wanted number by hash, so that no language is left without, then that number in the hash's order.
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, (2 * wanted + 16) / r["n"])) for r in counts], "lang string, share double")
    order = F.xxhash64(F.col(id_col).cast("string"), F.lit(SEED))
    given = rows.select(F.col(lang_col).alias("lang"), order.alias("order"), F.col(text_col).alias("text"))
    # A row a language is broadcast, as the model itself is.
    chosen = given.join(F.broadcast(shares), "lang").where((F.shiftrightunsigned("order", 11) * F.lit(2.0**-53)) < F.col("share")).select("lang", "order", "text")

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = [training_windows(text) for text in utf8(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.binary()))], ["lang", "order", "windows"])

        return each

    # One text an id and language: an id that is repeated without end counts once.
    sample = map_arrow(chosen, make, "lang string, order long, windows array<binary>").groupBy("lang", "order").agg(F.min("windows").alias("windows")).collect()
    by_lang: dict[str, list] = {r["lang"]: [] for r in counts}
    for r in sorted(sample, key=lambda r: (r["order"], r["windows"])):
        if len(by_lang[r["lang"]]) < wanted:
            by_lang[r["lang"]].append(r["windows"])
    languages = sorted(k for k, v in by_lang.items() if v)
    if not languages:
        return None
    windows = np.concatenate([cut(bytes(w))[:1] for k in languages for ws in by_lang[k] for w in ws])
    labels = np.concatenate([np.full(len(by_lang[k]) * WINDOWS_A_DOC, i) for i, k in enumerate(languages)])
    return train(windows, labels, languages)


def has_letter(text: bytes) -> bool:
    return bool(re.search(rb"[A-Za-z]", text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict(docs: DataFrame, network: Network | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score added; every column of docs stays, if none has one of these names."""
    at = docs.columns.index(text_col)

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = utf8(batch.column(at))
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            rows = [i for i, t in enumerate(texts) if t and has_letter(t)] if network else []
            if rows:
                windows = [cut(texts[i]) for i in rows]
                ends = np.cumsum([len(w) for w in windows])
                sizes = np.full(ends[-1], WINDOW, np.float64)
                lengths = np.array([len(texts[i]) for i in rows])
                sizes[ends - 1] = (lengths - 1) % WINDOW + 1
                p = network.probabilities(np.concatenate(windows)) * sizes[:, None]
                p = np.add.reduceat(p, np.concatenate([[0], ends[:-1]]), axis=0) / lengths[:, None]
                best = p.argmax(axis=1)
                for k, i in enumerate(rows):
                    lang[i] = network.languages[best[k]]
                    score[i] = min(1.0, round(float(p[k, best[k]]), 6))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

        return each

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", lang_pred string, score double"
    return map_arrow(docs, make, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), with a network learned from docs itself."""
    network = fit(docs, id_col, text_col, lang_col)
    given = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return predict(given, network).select("doc_id", "held_out", "lang_pred", "score")


def in_known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.0) -> DataFrame:
    """The rows of docs, as they are, for which a language is predicted with at least the given score."""
    network = fit(docs, id_col, text_col, lang_col)
    text = F.col(text_col)
    named = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)), text.alias("__text"))
    found = predict(named, network, "__text").where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def op6_byte_cnn(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_byte_cnn": op6_byte_cnn}
ORACLES: dict[str, str] = {}
