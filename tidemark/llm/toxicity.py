"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features of a text, each once: words, words cut to their first letters (for inflected forms), pairs of neighbours, and pairs with one or two words between, hashed to
2^20 places.  Every place has its own learning rate; the L1 term keeps most weights at exactly zero, so what
is sent to the workers is the short list of the others.

Labels come from labelled rows outside the held-out fifth (crc32 of the id's text, modulo 5, is 0).  At most
TRAIN_ROWS of them, those of smallest hash of the id, are learnt from; scores read nothing but the text.

Defined results: a null text scores as an empty one; a null id counts as the text "null"; rows whose labels
contradict count as toxic; null labels are no labels; without usable labels every score is near 0; repeated
rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .memos import keeps, serve

BITS = 20
#: Letters that are left of a cut word.
STEM = 5
TRAIN_ROWS = 8_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 12.0, 0.1
TOKEN = re.compile(r"[^\W_]+")
_MEMO = 200_000

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_hashes = _Hashes()
keeps("toxicity", _hashes.clear)


def features(text: str | None) -> np.ndarray:
    """Distinct places of a text's features, sorted."""
    if not text:
        return np.empty(0, np.int32)
    if len(_hashes) > _MEMO:
        _hashes.clear()
    words = TOKEN.findall(text.lower())
    h = np.array([_hashes[w] for w in words], np.uint64)
    parts = [h, np.array([_hashes[w[:STEM]] for w in words if len(w) > STEM], np.uint64) ^ _C[0]]
    for gap in (1, 2, 3):
        if len(h) > gap:
            parts.append((h[:-gap] * _C[0] + h[gap:] * _C[1]) ^ _C[gap])
    with np.errstate(over="ignore"):
        x = np.concatenate(parts) * _C[2]
    return np.unique((x >> np.uint64(64 - BITS)).astype(np.int32))


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal: the places and values of non-zero weights, and the bias."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    xs = [features(t) for t in texts]

    def weights(x):
        return np.where(np.abs(z[x]) <= L1, 0.0, -(z[x] - np.sign(z[x]) * L1) / ((BETA + np.sqrt(n[x])) / ALPHA + L2))

    order = np.arange(len(xs))
    for epoch in range(epochs):
        np.random.default_rng(epoch).shuffle(order)
        for k in order:
            x, y = xs[k], labels[k]
            w, wb = weights(x), -zb / ((BETA + math.sqrt(nb)) / ALPHA)
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum()) + wb))))
            g = p - y
            s = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / ALPHA
            z[x] += g - s * w
            n[x] += g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / ALPHA * wb
            nb += g * g
    at = np.flatnonzero(np.abs(z) > L1)
    return at, weights(at), (-zb / ((BETA + math.sqrt(nb)) / ALPHA) if xs else -30.0)


def remainder(doc: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc).cast("string"), F.lit("null")).cast("binary")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Learns from at most `rows` labelled documents outside the held-out fifth, in one task."""
    ids = labels.select(F.col(doc).alias("__id"), F.col(label).alias("__y")).where("__id is not null and __y is not null").where(remainder("__id") != 0)
    ids = ids.groupBy("__id").agg(F.max("__y").cast("int").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(rows)
    d = docs.select(F.col(doc).alias("__id"), F.col(text).alias("__t")).join(F.broadcast(ids), "__id")  # at most `rows` ids
    d = d.groupBy("__id", "__y").agg(F.min("__t").alias("__t"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        serve("toxicity")
        d = pd.concat([*parts, pd.DataFrame({"__id": [], "__y": [], "__t": []})]).sort_values("__id")
        at, w, b = train(d["__t"].tolist(), d["__y"].astype(int).tolist())
        yield pd.DataFrame({"at": [*at, -1], "w": [*w, b]})

    got = d.repartition(1).mapInPandas(run, "at long, w double").toPandas()
    got = got.groupby("at", as_index=False).first() if len(got) else pd.DataFrame({"at": [-1], "w": [-30.0]})
    own = got[got["at"] >= 0]
    return own["at"].to_numpy(), own["w"].to_numpy(), float(got.loc[got["at"] < 0, "w"].iloc[0])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", name: str = "score") -> DataFrame:
    """Adds a column of scores to docs; in place of one of that name."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        serve("toxicity")
        at, w, b = sent.value
        dense = np.zeros(1 << BITS)
        dense[at] = w
        for s in parts:
            yield pa.array([1 / (1 + math.exp(-max(-35.0, min(35.0, float(dense[features(t.as_py())].sum()) + b)))) for t in s], pa.float64())

    return docs.withColumn(name, F.arrow_udf(run, "double")(F.col(text)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    s = score(docs, model)
    return s.select("doc_id", (remainder() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
