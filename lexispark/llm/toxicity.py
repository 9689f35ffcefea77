"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios (Wang & Manning, 2012)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, map_arrow, slices

#: n-gram sizes (bytes of lower-cased, space-padded text), hashed into 2**BITS cells.
SIZES, BITS = (4, 5, 6), 20
#: Expected bound on labelled rows the classifier is fitted on, chosen by a hash of the key, each class by itself.
MAX_ROWS_PER_CLASS = 2000
#: The penalty of a weight's size beside the mean loss of a row; the fit ends when no slope is off by more than this share
#: of it. Steps between two looks at the slopes.
PENALTY, CLOSE, STEPS = 1e-3, 0.02, 50


def cells(text: str) -> np.ndarray:
    """Hashed n-gram cells at every place of a whole text."""
    raw = np.frombuffer(b" " + " ".join(text.lower().split()).encode() + b" ", dtype=np.uint8).astype(np.uint64)
    out = []
    for n in SIZES:
        if len(raw) >= n:
            h = raw[: len(raw) - n + 1].copy()
            for k in range(1, n):
                h <<= np.uint64(8)
                h |= raw[k : len(raw) - n + 1 + k]
            with np.errstate(over="ignore"):
                h *= np.uint64(0x9E3779B97F4A7C15)
            out.append((h >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


@dataclass
class ToxicityModel:
    weight: np.ndarray  # float32 per cell, zero where unused
    bias: float

    def margin(self, text: str) -> float:
        found = cells(text)
        hits = np.unique(found[self.weight[found] != 0])
        return float(self.weight[hits].sum(dtype=np.float64)) + self.bias


def ratios(seen: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log-count ratios of cells, of ``seen`` (classes x cells: rows that hold a cell) and rows of each class."""
    share = (seen + 1.0) / (n + 2.0)[:, None]
    return np.log(share[1] / share[0])


def fit(texts: list[str], labels: np.ndarray, rate: float, penalty: float = PENALTY) -> ToxicityModel:
    """Logistic regression over all cells, each scaled by its log-count ratio, with a penalty on absolute weights, which
    leaves most at zero; the bias is free. ``rate``: share of class 1 among all labelled rows, to which rows are weighted.

    Each round goes on with the cells that have a weight and those whose slope exceeds the penalty, of all cells, and takes
    twice the steps of the one before at most. It ends when all slopes are those of the best fit: the penalty's where a
    weight is not zero, within it where it is. The loss is convex, so it comes to an end."""
    weight, prior = np.zeros(1 << BITS, np.float32), float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6)))
    n = np.array([(labels == 0).sum(), (labels == 1).sum()])
    if min(n) == 0:
        return ToxicityModel(weight, prior if n.sum() else -5.0)
    seen, held = np.zeros((2, 1 << BITS), np.int32), []
    for t, y in zip(texts, labels, strict=True):
        held.append(np.unique(cells(t)))
        seen[int(y), held[-1]] += 1
    ratio, y = ratios(seen, n), labels.astype(float)
    share = np.where(y == 1, rate / n[1], (1 - rate) / n[0]) if 0 < rate < 1 else np.full(len(y), 1 / len(y))
    found, sizes = np.concatenate(held), np.array([len(d) for d in held])
    del held

    def error(margin: np.ndarray) -> np.ndarray:
        return (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y) * share

    def slopes(wrong: np.ndarray) -> np.ndarray:
        out, at = np.zeros(1 << BITS), 0
        for k in range(0, len(sizes), 256):
            size = sizes[k : k + 256]
            out += np.bincount(found[at : at + size.sum()], np.repeat(wrong[k : k + 256], size), minlength=1 << BITS)
            at += size.sum()
        return out * ratio

    def off(slope: np.ndarray, x: np.ndarray, last: float) -> float:
        """How far slopes are from those of the best fit; the bias, whose slope comes last, has no penalty."""
        held = np.where(x == 0, np.maximum(np.abs(slope) - penalty, 0), np.abs(slope + penalty * np.sign(x)))
        return max(float(held.max(initial=0.0)), abs(last))

    w, b, margin, most = np.zeros(1 << BITS), prior, np.full(len(y), prior), STEPS
    while True:
        wrong = error(margin)
        slope = slopes(wrong)
        if off(slope, w, float(wrong.sum())) <= CLOSE * penalty:
            break
        used = (w != 0) | (np.abs(slope) > penalty)
        active = np.flatnonzero(used)
        place = np.cumsum(used) - 1
        here = used[found]
        row, cell = np.repeat(np.arange(len(y)), sizes)[here], place[found[here]]
        scale, own = np.append(ratio[active], 1.0), np.append(w[active], b)

        def outward(x: np.ndarray) -> np.ndarray:
            return np.bincount(row, (x[:-1] * scale[:-1])[cell], minlength=len(y)) + x[-1]

        def inward(x: np.ndarray) -> np.ndarray:
            return np.append(np.bincount(cell, x[row], minlength=len(active)) * scale[:-1], x.sum())

        turn = np.abs(scale) / np.linalg.norm(scale)
        for _ in range(30):  # the loss bends by a quarter of the largest eigenvalue at most
            bent = inward(share * outward(turn))
            turn = bent / np.linalg.norm(bent)
        step, ahead, pace = 1 / (0.25 * 1.05 * np.linalg.norm(bent)), own, 1.0
        for k in range(most):  # proximal descent with momentum, which starts anew where it leads back
            if k % STEPS == STEPS - 1:
                bent = inward(error(outward(own)))
                if off(bent[:-1], own[:-1], float(bent[-1])) <= 0.5 * CLOSE * penalty:
                    break
            new = ahead - step * inward(error(outward(ahead)))
            new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
            if (ahead - new) @ (new - own) > 0:
                pace = 1.0
            faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
            ahead, own, pace = new + (pace - 1) / faster * (new - own), new, faster
        margin, own, b, most = outward(own), own[:-1], float(own[-1]), 2 * most
        w[active] = own
    weight[:] = w * ratio
    return ToxicityModel(weight, float(b))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS_PER_CLASS) -> ToxicityModel:
    """Fit on documents with a 0/1 label; other labels and nulls are left out, repeated labels count once. At most
    about ``max_rows`` keys of each class, by a hash of the key, are drawn from the labels alone; only their texts are
    fetched, by a broadcast of the drawn keys, and go to one task. Texts of other documents are not moved. Null texts
    count as empty; tables without labels, or with one class only, give a constant score."""
    known = labels.select(F.col(key).alias("__id"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and __id is not null").distinct()
    counts = {int(r[0]): r[1] for r in known.groupBy("label").count().collect()}
    total = sum(counts.values())
    scale = 1 << 40
    limits = {y: int(scale * min(1.0, max_rows / max(counts.get(y, 0), 1))) for y in (0, 1)}
    draw = F.pmod(F.xxhash64(F.col("__id").cast("string"), F.lit("draw")), F.lit(scale))
    drawn = known.where(draw <= F.when(F.col("label") == 1, F.lit(limits[1])).otherwise(F.lit(limits[0])))
    sent = F.broadcast(drawn) if drawn.count() <= BROADCAST_ROWS else drawn
    sample = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("text")).join(sent, F.col("k") == F.col("__id")).select("text", "label")
    rate = counts.get(1, 0) / total if total else 0.0

    def learn(batches):
        texts, labels = [], []
        for part in slices(batches):
            texts += [x or "" for x in part.column(0).to_pylist()]
            labels += part.column(1).to_pylist()
        model = fit(texts, np.array(labels, dtype=int), rate)
        yield pa.RecordBatch.from_pydict({"weight": [model.weight.astype("<f4").tobytes()], "bias": [model.bias]})

    # one task sees the bounded sample, in a fixed order
    found = sample.repartition(1).sortWithinPartitions("label", F.xxhash64("text"), "text").mapInArrow(learn, "weight binary, bias double").collect()
    if not found:
        return ToxicityModel(np.zeros(1 << BITS, np.float32), -5.0)
    return ToxicityModel(np.frombuffer(found[0]["weight"], "<f4").astype(np.float32), found[0]["bias"])


def score(df: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score``: probability of label 1 for every whole text; null and empty texts get the model's base rate.

    Rows map one to one (repeated rows stay), other columns are never read, an empty table gives no rows.
    """
    weight, bias = df.sparkSession.sparkContext.broadcast(model.weight), model.bias  # 2**BITS numbers
    source = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))

    def make():
        own = ToxicityModel(weight.value, bias)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            margins = np.array([own.margin(x or "") for x in batch.column(1).to_pylist()])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(margins, -40, 40))))], ["k", "score"])

        return apply

    return map_arrow(source, make, f"k {source.dtypes[0][1]}, score double").toDF(key, "score")


def held_out(key: str = "doc_id", fold: int = 0, folds: int = 5):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest of op7. A document with several labels counts once for each of its distinct labels."""
    model = train(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
