"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance shrunk towards its diagonal; a score is the difference of the two log densities
(Mahalanobis terms by cached Cholesky factors) plus the prior, put on the probability scale by a logistic fit on the same
labelled rows.  Inputs of a score are statistics of the text alone.

Fitting takes a bounded sample: the ``max_labelled`` labelled ids whose hash is smallest, of those not held out (crc32 of
the id as text, mod 4, is 2 for a held-out row); an id that several rows have is one case, of the least vector of
statistics.  Scoring covers every row and makes no shuffle.

Defined results: null and empty texts get the score of their (zero) statistics; repeated rows are scored each; labels that
contradict each other for one id count by their mean, rounded; without both classes among the labels every score is 0.5;
other columns are carried by ``keep_good`` and not read otherwise.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

MAX_LABELLED, THRESHOLD = 20_000, 0.7
#: Fixed value: the symbols of the quality rules.
_SYMBOLS = b"#*$%&<>"
_SENTENCE = re.compile(rb"[.?!][\s]")


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of one text; each is bounded or a logarithm, so that no text is far out of scale."""
    n, n_short = len(text) + 1, (1, 2, 3)
    words = text.split()
    k = len(words) + 1
    lines = text.split(b"\n")
    lower = [w.lower() for w in words]
    share = lambda x, of: (x / of) ** 0.5
    letters_up = len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = n - 1 - len(text.translate(None, b"0123456789"))
    symbols = n - 1 - len(text.translate(None, _SYMBOLS))
    grams = [b" ".join(lower[i : i + 4]) for i in range(len(lower) - 3)]
    return [
        np.log1p(len(words)),
        np.log1p((n - 1) / k),
        share(symbols, n),
        share(text.count(b"|"), k),
        share(text.count(b"!"), k),
        share(n - 1 - letters_up, n),
        share(digits, n),
        share(text.count(b",") + text.count(b"."), k),
        share(len(lines), k),
        share(len(lines) - len(set(lines)), len(lines) + 1),
        share(len(grams) - len(set(grams)), k),
        np.log1p(len(set(lower))) / np.log1p(k),
        share(sum(map(n_short.__contains__, map(len, words))), k),
        share(len(_SENTENCE.findall(text)), k),
    ]


def fit(x: np.ndarray, y: np.ndarray, shrink: float = 0.1) -> dict | None:
    """Means, Cholesky factors and log priors of both classes, and the logistic scale (a, b) of their difference."""
    y = np.asarray(y, int)
    if len(y) == 0 or not 0 < y.sum() < len(y):
        return None
    target = np.diag(x.var(0) + 1e-3)
    classes = []
    for c in (0, 1):
        own = x[y == c]
        mean = own.mean(0)
        cov = (own - mean).T @ (own - mean) / len(own)
        factor = np.linalg.cholesky((1 - shrink) * cov + shrink * target)
        classes.append((mean, np.linalg.inv(factor), np.log(np.diag(factor)).sum(), np.log(len(own) / len(y))))
    model = {"classes": classes, "a": 1.0, "b": 0.0}
    d = np.arcsinh(differences(model, x))  # log-like far out, so that single rows don't rule the scale
    scale = max(d.std(), 1e-9)
    z, w, t = np.column_stack([d / scale, np.ones(len(d))]), np.zeros(2), (y * y.sum() + 1) / (y.sum() + 2) * (y == 1) + (y == 0) / ((y == 0).sum() + 2)
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (p - t) + 1e-3 * w)
    return model | {"a": max(w[0] / scale, 1e-6), "b": w[1]}


def differences(model: dict, x: np.ndarray) -> np.ndarray:
    """Log density of class 1 less that of class 0, priors included."""
    out = []
    for mean, inverse, log_det, prior in model["classes"]:
        out.append(prior - log_det - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(1))
    return out[1] - out[0]


def scores(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None or not len(x):
        return np.full(len(x), 0.5)
    return 1 / (1 + np.exp(-np.clip(model["a"] * np.arcsinh(differences(model, x)) + model["b"], -30, 30)))


def _vectors(batches):
    for batch in batches:
        rows = [statistics(t or b"") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["_id", "_x"])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> dict | None:
    """The model of the labelled, not held-out rows.  The driver gets at most ``max_labelled`` vectors of statistics."""
    own = labels.where("doc_id is not null and quality in (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    marked = own.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.round(F.avg("quality")).cast("int").alias("_y"))
    sample = marked.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)  # at most max_labelled rows of 12 bytes
    texts = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].cast("binary").alias("_text")).join(F.broadcast(sample.select("_id")), "_id", "left_semi")
    cases = map_texts(texts, _vectors, "_id long, _x array<double>").groupBy("_id").agg(F.min("_x").alias("_x"))
    rows = cases.join(F.broadcast(sample), "_id").select("_id", "_x", "_y").orderBy("_id").collect()  # one row an id: at most max_labelled
    return fit(np.array([r["_x"] for r in rows]), np.array([r["_y"] for r in rows])) if rows else None


def _scorer(model: dict | None):
    def run(batches):
        for batch in batches:
            ids, x = batch.column(0), np.array([statistics(t or b"") for t in batch.column(1).to_pylist()])
            held = [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(held, pa.bool_()), pa.array(scores(model, x), pa.float64()), batch.column(2)], ["_id", "held_out", "score", "_rest"])

    return run


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", rest: list[str] | None = None) -> DataFrame:
    """(_id, held_out, score, _rest) of every row, in one pass."""
    packed = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].cast("binary").alias("_text"), F.struct(F.lit(0).alias("_none"), *[docs[c] for c in rest or []]).alias("_rest"))
    schema = T.StructType([T.StructField("_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), packed.schema["_rest"]])
    return map_texts(packed, _scorer(model), schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of docs that score at least ``threshold``, with the same columns."""
    out = score(docs, train(docs, labels), rest=docs.columns, **options).where(F.col("score") >= threshold)
    return out.select(*[F.col("_rest").getField(c).alias(c) for c in docs.columns])


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels)).select(F.col("_id").alias("doc_id"), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
