"""Language identification by nearest clustered centroid.

A text becomes hashed counts of its letter bigrams and trigrams (lower-cased, every run
of other characters one space), weighted ``(1 + ln tf) * idf`` and normalised. Each
language has up to ``CLUSTERS`` centroids from spherical k-means; the language of the
nearest centroid by cosine is predicted. A text is rejected if its cosine is ``SLACK``
times below what texts of that language with as many distinct n-grams reach: the
``LOW`` quantile of held-out cosines (each half of the sample against centroids of the
other half), with n-grams drawn from the held-out texts for every size, so that it does
not hang on single odd texts or on the size of the input.

Learning: document frequencies count every training document. The centroids are
fitted on a bounded sample, ``SAMPLE`` different rows (id and text) for each language,
those that hash lowest. Ids, sources and languages of a predicted document play no part.

Defined results: null text or text without a letter is ``und`` with score 0 and
rejected; with nothing to learn from, every text is; ties go to the language that
sorts first; repeated and null ids keep a row each (a null id counts as the empty text
when its remainder is taken); extra columns are ignored; an empty table gives none.

Scale: no shuffle of texts. Sampled rows' hashes (bounded) are broadcast, frequencies are one
vector for each task, and each language is clustered by a task of its own.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import remainder, rows
from .tokens import freeing, release

BIGRAMS, TRIGRAMS, CLUSTERS, SAMPLE, SLACK, LOW, ITERATIONS = 2048, 6144, 4, 500, 2.5, 0.05, 12
DIMS = BIGRAMS + TRIGRAMS
PIECE = 1 << 20  # code points looked at together


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def counts(texts: list[str]) -> np.ndarray:
    """Hashed n-gram counts, a row for each text."""
    out = np.zeros((len(texts), DIMS), np.float32)
    group, at, size = [], 0, 0
    for i, t in enumerate([*texts, ""]):
        if i == len(texts) or (group and size + len(t) > PIECE):
            _add(out[at : at + len(group)], group)
            group, at, size = [], i, 0
        if i < len(texts):
            group.append(t)
            size += len(t)
    return out


def _add(out: np.ndarray, texts: list[str]) -> None:
    """Adds the counts of some texts; n-grams are hashed for ``PIECE`` starts at a time."""
    if not texts:
        return
    lower = [t.lower() for t in texts]
    c = np.frombuffer((" " + " ".join(lower) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lower]) if len(texts) > 1 else None
    for at in range(0, len(c) - 2, PIECE):
        piece = c[at : at + PIECE + 2]
        _hashed(out, np.where(_letters()[piece], piece, 32).astype(np.uint32), 0 if doc is None else doc[at : at + PIECE])


def _hashed(out: np.ndarray, c: np.ndarray, doc: np.ndarray | int) -> None:
    """Adds the n-grams that start at all but the last two of some letters and spaces."""
    n, space = len(c) - 2, c == 32
    a, b, d = c[:n], c[1 : n + 1], c[2 : n + 2]
    two = ~(space[:n] & space[1 : n + 1])
    three = ~space[1 : n + 1] & two
    h2 = ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D) >> np.uint32(8)
    h3 = ((a * np.uint32(0x27D4EB2F)) ^ (b * np.uint32(0x165667B1)) ^ (d * np.uint32(0x9E3779B1))) * np.uint32(0x85EBCA77) >> np.uint32(8)
    base = doc * DIMS
    where = np.concatenate([(base + h2 % BIGRAMS)[two], (base + BIGRAMS + h3 % TRIGRAMS)[three]])
    out += np.bincount(where, minlength=out.size).reshape(out.shape)


def weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors; a row without n-grams stays zero."""
    x = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0).astype(np.float32) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.maximum(norm, 1e-12)


def clustered(x: np.ndarray, k: int = CLUSTERS) -> tuple[np.ndarray, float]:
    """Up to k unit centroids by spherical k-means (seeded farthest first) and the least
    cosine of a row to its nearest."""
    centre = x.mean(0)
    chosen = [int(np.argmax(x @ centre))]
    while len(chosen) < min(k, len(x)):
        near = (x @ x[chosen].T).max(1)
        far = int(np.argmin(near))
        if near[far] > 1 - 1e-6:
            break
        chosen.append(far)
    m = x[chosen]
    for _ in range(ITERATIONS):
        own = np.argmax(x @ m.T, axis=1)
        m = np.stack([x[own == j].mean(0) if (own == j).any() else m[j] for j in range(len(m))])
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    return m.astype(np.float32), float((x @ m.T).max(1).min())


def held_out_cosines(tf: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For growing numbers of distinct n-grams, the LOW quantile of the cosines of held-out texts."""
    rng, halves = np.random.default_rng(5), [np.arange(h, len(tf), 2) for h in (0, 1)]
    if len(tf) < 2:
        halves = [np.arange(len(tf))] * 2
    x, n = weighted(tf, idf), tf.sum(1).astype(np.int64)
    models, ends = [clustered(x[h])[0] for h in halves[::-1]], [np.cumsum(tf[h].astype(np.int64), axis=1) for h in halves]
    sizes, least, m = [], [], 8
    while True:
        some, cosines = [], []
        for h, model, end in zip(halves, models, ends):
            at = np.flatnonzero(n[h] >= m)
            drawn = np.zeros((len(at), tf.shape[1]), np.float32)
            for i, j in enumerate(at.tolist()):
                drawn[i] = np.bincount(np.searchsorted(end[j], rng.integers(0, n[h][j], m), "right"), minlength=tf.shape[1])
            some += (drawn > 0).sum(1).tolist()
            cosines += (weighted(drawn, idf) @ model.T).max(1).tolist()
        if len(some) < max(1, len(tf) / 5):  # sizes that few texts have
            break
        sizes.append(float(np.median(some)))
        least.append(float(np.quantile(cosines, LOW)))
        m *= 2
    if not sizes:
        sizes, least = [float(np.median((tf > 0).sum(1)))], [float(np.quantile(np.concatenate([(x[h] @ c.T).max(1) for h, c in zip(halves, models)]), LOW))]
    return np.array(sizes), np.array(least)


def limit(curve: tuple[np.ndarray, np.ndarray], distinct: int) -> float:
    """The least cosine of a kept text of some distinct n-grams; below the first size it falls as their root."""
    sizes, least = curve
    return float(np.interp(np.log(max(1, distinct)), np.log(sizes), least)) * min(1.0, (distinct / sizes[0]) ** 0.5) / SLACK


def _frequencies(batches):
    import pyarrow as pa

    release()
    total, n = np.zeros(DIMS, np.int64), 0
    for b in rows(batches, 128, 2_000_000):
        tf = counts(b.column("text").to_pylist())
        total += (tf > 0).sum(0)
        n += int(tf.any(1).sum())
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(np.append(total, n))], names=["dim", "n"])


def _vectors(batches):
    import pyarrow as pa

    for b in rows(batches, 128, 2_000_000):
        tf = counts(b.column("text").to_pylist())
        keep = np.flatnonzero(tf.any(1))
        sparse = [(np.flatnonzero(tf[i]).astype(np.int32), tf[i][tf[i] > 0]) for i in keep]
        yield pa.RecordBatch.from_arrays(
            [b.column("lang").take(pa.array(keep)), b.column("h").take(pa.array(keep)), pa.array([d.tobytes() for d, _ in sparse], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in sparse], pa.binary())],
            names=["lang", "h", "dims", "tf"],
        )


def _cluster_of(idf: np.ndarray):
    def run(group):
        import pandas as pd

        tf = np.zeros((len(group), DIMS), np.float32)
        for i, (d, v) in enumerate(sorted(zip(group["dims"], group["tf"]))):
            tf[i, np.frombuffer(d, np.int32)] = np.frombuffer(v, np.float32)
        m, _ = clustered(weighted(tf, idf))
        sizes, least = held_out_cosines(tf, idf)
        curve = {"sizes": [sizes.tolist()] * len(m), "least": [least.tolist()] * len(m)}
        return pd.DataFrame({"lang": group["lang"].iloc[0], "nth": np.arange(len(m)), **curve, "centroid": [c.tobytes() for c in m]})

    return run


class Model:
    """Centroids by language, idf, and each centroid's curve of least cosines by distinct n-grams."""

    def __init__(self, langs: list[str], centroids: np.ndarray, limits: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray):
        self.langs, self.centroids, self.limits, self.idf = langs, centroids, limits, idf

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        tf = counts([t or "" for t in texts])
        if not self.langs:
            return [("und", 0.0, True)] * len(texts)
        near = weighted(tf, self.idf) @ self.centroids.T
        best = np.argmax(near, axis=1)
        out = []
        for i, j in enumerate(best.tolist()):
            if not tf[i].any():
                out.append(("und", 0.0, True))
            else:
                score = float(min(1.0, max(0.0, near[i, j])))
                out.append((self.langs[j], score, score < limit(self.limits[j], int((tf[i] > 0).sum()))))
        return out


def fit(training: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from columns doc_id, text and lang (neither null)."""
    usable = training.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    df = usable.select("text").mapInArrow(_frequencies, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(DIMS + 1, np.int64)
    for r in df:
        n[r["dim"]] = r["n"]
    idf = np.log((1 + n[-1]) / (1 + n[:-1])).astype(np.float32) + np.float32(1)
    # about four times the sample by hash first, so that ranking reads no more, however many documents there are;
    # equal rows count once, in the shares too
    share = usable.groupBy("lang").agg((F.lit(4.0 * sample) / F.approx_count_distinct("h")).alias("share"))
    hashed = usable.select("h", "lang").join(F.broadcast(share), "lang")  # a row for each language, as the model has
    thinned = hashed.where((F.col("share") >= 0.5) | (F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30)))
    ranked = thinned.select("lang", "h").distinct().withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    chosen = F.broadcast(ranked.where(F.col("k") <= sample).select("lang", "h"))  # at most `sample` rows for each language
    vectors = usable.join(chosen, ["lang", "h"]).select("text", "lang", "h").mapInArrow(_vectors, "lang string, h long, dims binary, tf binary")
    found = vectors.dropDuplicates(["lang", "h"]).groupBy("lang").applyInPandas(_cluster_of(idf), "lang string, nth int, sizes array<double>, least array<double>, centroid binary").collect()
    found = sorted(found, key=lambda r: (r["lang"], r["nth"]))
    centroids = np.stack([np.frombuffer(r["centroid"], np.float32) for r in found]) if found else np.zeros((0, DIMS), np.float32)
    limits = [(np.array(r["sizes"]), np.array(r["least"])) for r in found]
    return Model([r["lang"] for r in found], centroids, limits, idf)


def predict(docs: DataFrame, model: Model, named: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """All columns of ``docs`` (which has ``text``), then prediction, score and rejection."""
    names = docs.columns

    def run(batches):
        import pyarrow as pa

        release()
        for b in rows(batches, 128, 2_000_000):
            found = model.predict(b.column("text").to_pylist())
            more = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *more], names=[*names, *named])

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

    out = StructType(list(docs.schema.fields)).add(named[0], StringType()).add(named[1], DoubleType()).add(named[2], BooleanType())
    return docs.mapInArrow(freeing(run), out)


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: learned from the documents not held out."""
    held = (remainder("doc_id", 5) == 0).alias("held_out")
    model = fit(docs.where(remainder("doc_id", 5) != 0))
    return predict(docs.select("doc_id", held, "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
