"""Quality by compression: how much better a text compresses after good text than after bad text.

Two zstandard dictionaries are built from labelled good and bad documents. Every
text is compressed with both, in chunks so that a long text cannot become its
own dictionary. The difference of the sizes, by the bytes of the text and by the
compressed bytes, over the whole and in the worst chunk, is turned into a
probability by logistic regression on further labelled documents.

Fitting takes a bounded sample: at most ``per_class`` documents of each label for
the dictionaries and as many for the calibration, the first by a hash of their
id, of at most ``max_bytes`` bytes each. The calibration gives the labels the shares
that they have among all labelled documents. Scoring covers every text in full.

Cases: null and empty texts are scored as texts of no bytes; a null label does
not count and of contradicting labels the higher does; a null id is never held
out; without sample rows of both labels every score is the share of label 1, or
0.5 without any; repeated documents get equal scores; further columns are
carried along.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelab.llm import text as tx

PER_CLASS = 1500
MAX_BYTES = 32_768
DICTIONARY_BYTES = 112_640
LEVEL = 3
CHUNK = 4096
SAMPLE_PIECE = 1024
CUT = 0.7


def _dictionary(texts: list[bytes]) -> bytes:
    pieces = [t[i : i + SAMPLE_PIECE] for t in texts for i in range(0, len(t), SAMPLE_PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: the text itself
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_AUTO)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False, write_checksum=False)


@dataclass
class Classifier:
    good: bytes
    bad: bytes
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    constant: float | None = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def sizes(self, text) -> tuple[int, list[tuple[int, int, int]]]:
        if "_pair" not in self.__dict__:
            self._pair = (_compressor(self.good), _compressor(self.bad))
        good, bad = self._pair
        n = len(text)
        return n, [(len(c := text[i : i + CHUNK]), len(good.compress(c)), len(bad.compress(c))) for i in range(0, max(n, 1), CHUNK)]

    def features(self, text) -> list[float]:
        n, chunks = self.sizes(text)
        a, b = sum(c[1] for c in chunks), sum(c[2] for c in chunks)
        return [
            (b - a) / (n + 32),
            (b - a) / (a + b),
            (a + b) / 2 / (n + 32),
            min((e - d) / (c + 32) for c, d, e in chunks),
            min((d + e) / 2 / (c + 32) for c, d, e in chunks),
            math.log1p(n),
        ]

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(features), self.constant)
        z = np.clip((_squares(features) - self.centre) / self.spread, -8, 8)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + z @ self.weights[1:], -30, 30)))


def _squares(x: np.ndarray) -> np.ndarray:
    """The features, their squares and their products."""
    k = x.shape[1]
    return np.concatenate([x, *[x[:, i : i + 1] * x[:, j : j + 1] for i in range(k) for j in range(i + 1)]], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, share: float, rounds: int = 40) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression, classes weighted to a share of ones."""
    a = np.c_[np.ones(len(x)), x]
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    w = np.zeros(a.shape[1])
    penalty = 1e-4 * len(a)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (weight * (y - p)) - penalty * w
        curve = (a * (weight * p * (1 - p))[:, None]).T @ a + penalty * np.eye(len(w))
        w += np.linalg.solve(curve, slope)
    return w


def held_out(id_column: str, folds: int = 4, fold: int = 2) -> Column:
    """Whether a document is held out: crc32 of its id as text, modulo ``folds``."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % folds == fold


def _known(labels: DataFrame, id_column: str, label_column: str) -> DataFrame:
    """id and label of the labelled documents that are not held out."""
    known = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull() & ~held_out(id_column))
    return known.groupBy(F.col(id_column).alias("id")).agg(F.max(label_column).alias("label"))


def good_share(labels: DataFrame, id_column: str = "doc_id", label_column: str = "quality") -> float:
    """The share of label 1 among all labelled documents that are not held out; 0.5 without any."""
    return float(_known(labels, id_column, label_column).agg(F.coalesce(F.avg("label"), F.lit(0.5))).first()[0])


def sample(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> dict[int, list[bytes]]:
    """Texts of at most 2 * ``per_class`` labelled documents of each label that are not held out, in hash order."""
    known = _known(labels, id_column, label_column)
    order = F.xxhash64("id")
    picked = [known.where(F.col("label") == q).orderBy(order, "id").limit(2 * per_class) for q in (0, 1)]
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where(F.octet_length("text").between(1, max_bytes))
    # Both limits bound the picked rows, so the broadcast and what comes back are bounded too.
    rows = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "id").dropDuplicates(["id"]).select("label", order.alias("at"), "id", "text").toPandas()
    rows = rows.sort_values(["at", "id"])
    return {q: [t.encode() for t in rows.text[rows.label == q]] for q in (0, 1)}


def fit(docs: DataFrame, labels: DataFrame, **options) -> Classifier:
    texts = sample(docs, labels, **options)
    bad, good = texts[0], texts[1]
    if min(len(bad), len(good)) < 2:
        total = len(bad) + len(good)
        none = np.zeros(0)
        return Classifier(b"", b"", none, none, none, len(good) / total if total else 0.5)
    # Every other one builds a dictionary, the rest calibrates.
    model = Classifier(_dictionary(good[::2]), _dictionary(bad[::2]), np.zeros(0), np.ones(0), np.zeros(0))
    x = _squares(np.array([model.features(t) for t in good[1::2] + bad[1::2]]))
    y = np.array([1.0] * len(good[1::2]) + [0.0] * len(bad[1::2]))
    model.centre, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    model.weights = _logistic(np.clip((x - model.centre) / model.spread, -8, 8), y, good_share(labels, **{k: v for k, v in options.items() if k in ("id_column", "label_column")}))
    return model


def score(docs: DataFrame, model: Classifier, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """The documents with a probability of being good, replacing a column of that name."""
    kept = docs.drop(score_column)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def run(batches):
        found = shared.value
        for batch in batches:
            for part in tx.slices(batch, text_column):
                data, offsets = tx.text_buffer(part.column(part.schema.get_field_index(text_column)))
                if found.constant is None:
                    x = np.array([found.features(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])])
                else:
                    x = np.zeros((part.num_rows, 1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found.scores(x), pa.float64())], [*part.schema.names, score_column])

    return kept.mapInArrow(run, f"{columns}, `{score_column}` double")


def accepted(docs: DataFrame, model: Classifier, text_column: str = "text", cut: float = CUT) -> DataFrame:
    """The documents with a score of at least ``cut``, with all their columns."""
    rows, (text,) = tx.positional(docs, text_column)
    return score(rows, model, text, "score").where(F.col("score") >= cut).select(*rows.columns).toDF(*docs.columns)
