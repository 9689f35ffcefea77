"""Language identification of mixed documents.

Each language has a smoothed likelihood of hashed byte n-grams. For a document, expectation-maximisation estimates
the proportions of the languages in a mixture from its n-gram counts; languages enter and leave the set one by one, as
long as the likelihood less a penalty for each language, which grows with the logarithm of the document's length, grows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices

#: Bytes of an n-gram and bits of the hashed cell.
NGRAM, BITS = 3, 16
#: Expected bound on rows the likelihoods are counted on, chosen by a hash of the key.
MAX_ROWS = 8000
#: Factor of the penalty: n-grams overlap, so a document holds fewer independent ones than places.
PENALTY = 2.0 * NGRAM
#: How near to the best log-likelihood EM needs to come.
CLOSE = 0.05
UNKNOWN = "und"


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed cells of a whole text and their counts; words are padded, digits and signs left out."""
    kept = "".join(c if c.isalpha() else " " for c in text.lower()) if not text.isalpha() else text.lower()
    raw = np.frombuffer((" " + " ".join(kept.split()) + " ").encode(), dtype=np.uint8).astype(np.uint32)
    if len(raw) < NGRAM:
        return np.zeros(0, np.int64), np.zeros(0)
    h = raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]
    h *= np.uint32(0x9E3779B1)
    h >>= np.uint32(32 - BITS)
    if len(h) > 1 << 14:
        counts = np.bincount(h, minlength=1 << BITS)
        found = np.flatnonzero(counts)
        return found, counts[found].astype(float)
    found, counts = np.unique(h, return_counts=True)
    return found.astype(np.int64), counts.astype(float)


def has_letter(text: str | None) -> bool:
    return bool(text) and (text[0].isalpha() or any(map(str.isalpha, text)))


def mixture(p: np.ndarray, counts: np.ndarray, first: int = 0, enough: float = np.inf, too_little: float = -np.inf) -> tuple[np.ndarray, float, float]:
    """Proportions by EM (``p``: n-grams x languages), their log-likelihood, and an upper bound of what any proportions
    reach: the likelihood is concave, so it rises by no more than its largest slope towards a single language. EM goes
    on until the bound is ``CLOSE``, the likelihood exceeds ``enough``, the bound falls to ``too_little``, or the likelihood
    no longer rises in doubles."""
    n, total = p.shape[1], counts.sum()
    share = np.full(n, 0.1 / max(n - 1, 1))
    share[first] = 0.9 if n > 1 else 1.0
    last = -np.inf
    while True:
        mixed = p @ share
        slope = (counts / mixed) @ p
        value = float(counts @ np.log(mixed))
        bound = value + float(slope.max()) - total
        if bound - value <= CLOSE or value > enough or bound <= too_little or value <= last:
            return share, value, bound
        last = value
        share = share * slope / total


@dataclass
class LanguageModel:
    languages: list[str]
    probability: np.ndarray  # cells x languages

    def proportions(self, text: str | None) -> dict[str, float]:
        """The selected languages with their proportions; empty if text is null or has no letter."""
        if not self.languages or not has_letter(text):
            return {}
        found, counts = grams(text)
        if not len(found):
            return {}
        p = self.probability[found]
        alone = counts @ np.log(p)
        chosen = [int(np.argmax(alone))]
        best, share = float(alone[chosen[0]]), np.ones(1)
        price = PENALTY * 0.5 * np.log(max(counts.sum(), 2))
        if len(self.languages) > 1:
            # no set of languages exceeds the bound of all of them: most documents stop here
            everything, _, bound = mixture(p, counts, chosen[0], best + price, best + price)
            better = bound > best + price
            while better:  # add or drop a language as long as the penalised likelihood grows
                better = False
                for k in map(int, np.argsort(-everything, kind="stable")):
                    own = [c for c in chosen if c != k] if k in chosen else [*chosen, k]
                    if not own:
                        continue
                    tried, value, _ = mixture(p[:, own], counts)
                    if value - best > price * (len(own) - len(chosen)) + CLOSE:
                        chosen, best, share, better = own, value, tried, True
        return {self.languages[k]: float(s) for k, s in zip(chosen, share, strict=True)}


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = MAX_ROWS) -> LanguageModel:
    """Count n-grams of about ``max_rows`` rows of each language (by a hash of the key) in one task; rows with null
    text or language are left out."""
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang).cast("string")).count().collect()}
    if not counts:
        return LanguageModel([], np.zeros((1 << BITS, 0)))
    names, scale = sorted(counts), 1 << 40
    each = max(1, max_rows // len(names))
    limit = F.create_map(*(F.lit(x) for n in names for x in (n, int(scale * min(1.0, each / counts[n])))))
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("draw")), F.lit(scale))
    sample = rows.where(draw <= limit[F.col(lang).cast("string")]).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))

    def count(batches):
        table = np.zeros((len(names), 1 << BITS))
        at = {n: k for k, n in enumerate(names)}
        for part in slices(batches):
            for name, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found, n = grams(t)
                table[at[name], found] += n
        for name, row in zip(names, table, strict=True):
            yield pa.RecordBatch.from_pydict({"lang": [name], "counts": [row.astype("<f4").tobytes()]})

    table = np.full((len(names), 1 << BITS), 0.0)
    for r in sample.repartition(1).mapInArrow(count, "lang string, counts binary").collect():
        table[names.index(r["lang"])] += np.frombuffer(r["counts"], dtype="<f4")
    smoothed = table + 0.2
    return LanguageModel(names, (smoothed / smoothed.sum(axis=1, keepdims=True)).T.copy())


def predict(df: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, lang_pred, score, languages`` (and the columns of ``keep``) for every whole text.

    ``languages`` maps the selected set to proportions; ``lang_pred`` is the largest (ties: first by name) and
    ``score`` its proportion. Null texts and texts without a letter are ``und`` with score 0 and an empty map, as is
    everything if no language was learned. Rows map one to one, very long texts are read whole; a column of ``keep`` with
    the name of a result is left out. An empty table gives no rows.
    """
    names, table = model.languages, model.probability.astype(np.float32)
    columns = [c for c in dict.fromkeys([key, *keep]) if c == key or c not in ("lang_pred", "score", "languages")]
    own_names = [f"c{k}" for k in range(len(columns))]  # no name clashes
    source = df.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(columns, own_names, strict=True)), F.col(f"`{text}`").cast("string").alias("t"))
    schema = ", ".join(f"{c} {t}" for c, t in source.dtypes if c != "t")

    def make():
        own = LanguageModel(names, table.astype(float))

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [own.proportions(x) for x in batch.column("t").to_pylist()]
            best = [min(f.items(), key=lambda x: (-x[1], x[0])) if f else (UNKNOWN, 0.0) for f in found]
            return pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in own_names), pa.array([b[0] for b in best], pa.string()), pa.array([min(max(b[1], 0.0), 1.0) for b in best], pa.float64()), pa.array([list(f.items()) for f in found], pa.map_(pa.string(), pa.float64()))],
                [*own_names, "lang_pred", "score", "languages"],
            )

        return apply

    return map_arrow(source, make, f"{schema}, lang_pred string, score double, languages map<string,double>").toDF(*columns, "lang_pred", "score", "languages")


def held_out(key: str = "doc_id", fold: int = 2, folds: int = 4):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """The digest of op10."""
    model = train(docs.select("doc_id", "text", "lang").where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
