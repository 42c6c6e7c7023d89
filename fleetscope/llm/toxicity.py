"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams (UTF-8 bytes, A-Z lower-cased) of a
whole text, hashed to ``2 ** bits`` buckets.  Each bucket's value is its log
ratio of smoothed counts in toxic and clean training texts; a linear support
vector machine (dual coordinate descent) is trained on the scaled features, and
a logistic of its margin is the score.

The model is fitted on at most ``max_rows`` labelled texts and ``max_chars``
characters of them, drawn by a hash of the id (so the draw does not depend on
partitioning); the sample's features are bounded by those two parameters.
Scoring runs on every whole text in Spark tasks; the broadcast model has a fixed
size (one weight a bucket).

Defined cases: null and empty texts have no features and get the score of the
bias alone, as does every text when there are no labels of both classes; repeated rows
are scored each and learned once; of different texts that share an id, the one of
the least digest is learned; labels without a document are not used; several labels of a
document: toxic if any says so; input columns besides id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, table, tidy
from .tokens import batches_of, texts_of

ORDERS = (4, 6)


def _buckets(text: bytes, bits: int, scratch: np.ndarray) -> np.ndarray:
    """Distinct n-gram buckets of a text; ``scratch`` has ``2 ** bits`` entries and needs no clearing."""
    if not text:
        return np.zeros(0, np.int64)
    x = np.frombuffer(b" " + text.lower(), np.uint8).astype(np.uint64)  # a first word starts like any other
    found, code, n = [], x, 1
    for order in range(2, max(ORDERS) + 1):
        if len(x) < order:
            break
        code, n = code[:-1] | x[order - 1:] << np.uint64(8 * (order - 1)), order
        if order in ORDERS:
            found.append((code * np.uint64(0x9E3779B97F4A7C15 + 2 * order)) >> np.uint64(64 - bits))
    if not found:  # shorter than the shortest n-gram: the text itself
        found = [(code[:1] * np.uint64(0x9E3779B97F4A7C15 + 2 * n)) >> np.uint64(64 - bits)]
    all_ = np.concatenate(found).astype(np.int64)
    # The last writer of each bucket is its one representative: distinct values without a sort.
    at = np.arange(len(all_), dtype=np.int32)
    scratch[all_] = at
    return all_[scratch[all_] == at]


@dataclass
class Model:
    """Bias and, for each bucket, weight times log-count ratio; the score is a logistic of the margin."""

    bits: int
    bias: float
    weights: np.ndarray
    scale: float = 2.0
    shift: float = 0.0

    def margin(self, buckets: np.ndarray) -> float:
        return self.bias + (float(self.weights[buckets].sum()) / _length(buckets) if len(buckets) else 0.0)

    def scorer(self):
        scratch = np.zeros(1 << self.bits, np.int32)

        def score(text: bytes) -> float:
            margin = self.margin(_buckets(text, self.bits, scratch))
            return float(1.0 / (1.0 + np.exp(-np.clip(self.scale * margin + self.shift, -30, 30))))

        return score


def _length(buckets: np.ndarray) -> float:
    """Damps long texts without hiding a few telling n-grams among many plain ones."""
    return max(1, len(buckets)) ** 0.25


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int) -> Model:
    """The model on all rows, its logistic fitted to margins of rows held out from a model on the other half."""
    model, half = _fit(rows, labels, bits), _fit(rows[::2], labels[::2], bits)
    y = labels[1::2] > 0
    if half.weights.any() and 0 < y.sum() < len(y):
        m = np.asarray([half.margin(b) for b in rows[1::2]])
        # Platt's targets, Newton steps on two parameters.
        target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
        x, ab = np.stack([m, np.ones(len(m))]), np.asarray([2.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(ab @ x, -30, 30)))
            ab = ab - np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2), x @ (p - target))
        if np.isfinite(ab).all() and 0 < ab[0] < 100:
            model.scale, model.shift = map(float, ab)
    return model


def _fit(rows: list[np.ndarray], labels: np.ndarray, bits: int, alpha: float = 1.0, cost: float = 1.0,
         epochs: int = 12) -> Model:
    """Train on bucket arrays; squared-hinge SVM in the dual, classes weighted by their inverse share."""
    size, y = 1 << bits, np.where(labels > 0, 1.0, -1.0)
    n_pos = int((y > 0).sum())
    if not rows or n_pos in (0, len(y)):
        return Model(bits, -1.0, np.zeros(size, np.float32))
    counts = {s: np.full(size, alpha) for s in (1.0, -1.0)}
    for b, s in zip(rows, y):
        counts[s][b] += 1
    ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
    share = {1.0: len(y) / (2 * n_pos), -1.0: len(y) / (2 * (len(y) - n_pos))}
    diag = np.asarray([0.5 / (cost * share[s]) for s in y])
    at = np.concatenate([[0], np.cumsum([len(b) for b in rows])]).tolist()
    flat = np.empty(at[-1], np.float32)  # one array: many small ones would leave holes that the driver keeps
    value = [flat[i:j] for i, j in zip(at[:-1], at[1:])]
    for v, b in zip(value, rows):
        v[:] = ratio[b] / _length(b)
    square = np.asarray([float(v @ v) + 1.0 for v in value]) + diag
    w, bias, dual = np.zeros(size), 0.0, np.zeros(len(y))
    order, active = np.random.default_rng(0), np.arange(len(y))
    for epoch in range(epochs):
        worst, kept = 0.0, []
        for i in order.permutation(active):
            b, v = rows[i], value[i]
            grad = y[i] * (float(w[b] @ v) + bias) - 1.0 + diag[i] * dual[i]
            new = max(dual[i] - grad / square[i], 0.0)
            step = (new - dual[i]) * y[i]
            worst = max(worst, abs(new - dual[i]) * square[i])
            if new > 0 or grad < 0.1:  # texts well beyond the margin rest until the next full pass
                kept.append(i)
            if step:
                w[b] += step * v
                bias += step
                dual[i] = new
        full = len(active) == len(y)
        if worst < 0.05 and full:
            break
        active = np.arange(len(y)) if worst < 0.05 or epoch % 4 == 3 else np.asarray(kept)
    return Model(bits, bias, (w * ratio).astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          keep=None, bits: int = 18, max_rows: int = 6000, max_chars: int = 24_000_000) -> Model:
    """Fit on a bounded sample of labelled texts; ``keep`` (a column over the id) says which may be learned from."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).dropna()
    known = known.filter(keep(F.col("id"))) if keep is not None else known
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    text = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    # Of rows that share an id, the text of the least digest is learned from.
    sizes = (text.select("id", F.struct("key", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).alias("of"))
             .join(known, "id").groupBy("id").agg(F.min("of").alias("of"), F.max("label").alias("label")))
    # The sample's ids: at most max_rows of them; a text that does not fit what is left of max_chars is passed over.
    drawn = sizes.select("id", "of.key", "of.n", "label").orderBy(F.xxhash64("id"), "id").limit(max_rows).collect()
    chosen, total = [], 0
    for r in drawn:
        if total + r["n"] > max_chars:
            continue
        total += r["n"]
        chosen.append((r["id"], r["key"], int(r["label"])))
    if not chosen:
        return fit([], np.zeros(0), bits)
    spark = docs.sparkSession
    ids = spark.createDataFrame(chosen, f"id {docs.schema[id_col].dataType.simpleString()}, key long, label int")

    def features(batches):
        import pyarrow as pa

        scratch = np.zeros(1 << bits, np.int32)
        for whole in batches:
            for batch in batches_of(whole):
                packed = [_buckets(t, bits, scratch).astype("<i4").tobytes() for t in texts_of(batch.column(2))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())],
                                                 names=["id", "label", "buckets"])

    # Repeated rows of the sample count once, and only the sample's features reach the driver.
    got = (text.join(F.broadcast(ids), ["id", "key"]).groupBy("id", "label").agg(F.max("text").alias("text"))
           .select("id", "label", "text").mapInArrow(tidy(features), f"{ids.schema[0].simpleString().replace(':', ' ')}, label int, buckets binary"))
    flat, place = bytearray(), {}
    for r in got.toLocalIterator():
        place[r["id"]] = (len(flat) // 4, len(r["buckets"]) // 4, r["label"])
        flat += r["buckets"]
    sample = np.frombuffer(flat, "<i4")
    ordered = [place[k] for k in sorted(place)]
    model = fit([sample[at:at + n] for at, n, _ in ordered], np.asarray([x for *_, x in ordered]), bits)
    del sample, flat, place, ordered, drawn, chosen
    release()  # the driver works on for long; what the sample took would stay with it
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all by default, but for one named ``score``) and the text's ``score``."""
    columns = columns or [c for c in docs.columns if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(*columns, *[text_col for _ in range(text_col not in columns)])
    at = chosen.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        one = shared.value.scorer()
        for whole in batches:
            for batch in batches_of(whole):
                scores = pa.array([one(t) for t in texts_of(batch.column(at))], pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(columns)], scores], names=[*columns, "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return chosen.mapInArrow(tidy(run), f"{kinds}, score double")


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op7_nb_ngram_svm(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` scored by a model trained on labelled rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), keep=lambda i: ~held_out(i))
    return (score(docs, model, columns=["doc_id"])
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted")))
