"""Hierarchical language identification: families first, then one-versus-one linear SVMs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.llm.common import hold_memo, on_workers

#: Hashed character n-grams: their lengths in bytes and the number of buckets.
GRAMS, BUCKETS = (1, 2, 3, 4), 1 << 12
#: The classifier is fitted on at most this many labelled documents of each language and in total.
FIT_PER_LANGUAGE, FIT_TOTAL = 500, 4_000
EPOCHS, COST = 12, 1.0
UNDETERMINED = "und"
#: Rows below this score are dropped. With few languages hardly any is: every decision's factor is 0.5 or more, but
#: for a winner that lost a duel.
MIN_SCORE = 0.2
_SEED = 11


def features(text: bytes) -> np.ndarray:
    """Unit vector of damped counts of the byte n-grams of a lower-cased text, white space as one blank."""
    body = np.frombuffer(b" " + b" ".join(text.split()) + b" ", dtype=np.uint8).astype(np.uint32)
    out = np.zeros(BUCKETS, dtype=np.float32)
    rolled = np.zeros(len(body), dtype=np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(body) < n:
            break
        rolled = rolled[: len(body) - n + 1] * np.uint32(0x01000193) + body[n - 1 :] + np.uint32(n)
        if n in GRAMS:
            slot = (rolled * np.uint32(0x9E3779B1)) >> np.uint32(32 - int(math.log2(BUCKETS)))
            out += np.bincount(slot, minlength=BUCKETS)
    np.log1p(out, out=out)
    return out / max(float(np.linalg.norm(out)), 1e-9)


def linear_svm(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, cost: float = COST) -> np.ndarray:
    """Weights (bias last) of an L2-regularised hinge-loss SVM by dual coordinate descent."""
    w, bias, alpha = np.zeros(x.shape[1], dtype=np.float32), 0.0, [0.0] * len(x)
    square = (np.einsum("ij,ij->i", x, x) + 1.0).tolist()
    signs = y.tolist()
    rng = np.random.default_rng(_SEED)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (signs[i] * (float(w @ x[i]) + bias) - 1) / square[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * signs[i]
                w += np.float32(step) * x[i]
                bias += step
                alpha[i] = new
    return np.append(w.astype(np.float64), bias)


def families_of(languages: list[str], centroids: np.ndarray) -> list[list[str]]:
    """Groups languages by average-link clustering of their centroids into about the root of their
    number of families."""
    groups = [[i] for i in range(len(languages))]
    unit = centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-9)
    near = unit @ unit.T
    while len(groups) > math.ceil(math.sqrt(len(languages))):
        _, a, b = max(
            (float(near[np.ix_(p, q)].mean()), a, b)
            for a, p in enumerate(groups) for b, q in enumerate(groups) if a < b)
        groups[a] += groups.pop(b)
    return sorted(sorted(languages[i] for i in g) for g in groups)


@dataclass
class LanguageModel:
    """Family separators and, inside each family, a separator of every two languages."""

    families: list[list[str]] = field(default_factory=list)
    family_weights: np.ndarray | None = None
    pair_weights: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, labels: list[str]) -> "LanguageModel":
        names = sorted(set(labels))
        if not names:
            return cls()
        y = np.array(labels)
        families = families_of(names, np.stack([x[y == n].mean(axis=0) for n in names]))
        model = cls(families)
        home = {name: f for f, members in enumerate(families) for name in members}
        at = np.array([home[n] for n in labels])
        if len(families) > 1:
            model.family_weights = np.stack(
                [linear_svm(x, np.where(at == f, 1.0, -1.0)) for f in range(len(families))])
        for members in families:
            for i, a in enumerate(members):
                for b in members[i + 1 :]:
                    use = (y == a) | (y == b)
                    model.pair_weights[a, b] = linear_svm(x[use], np.where(y[use] == a, 1.0, -1.0))
        return model

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        """The language with most duels won (then the largest margin, then the name) in the likeliest
        family, and the product of the logistic margins of the decisions that led to it."""
        if not self.families:
            return UNDETERMINED, 0.0
        x = np.append(v, 1.0)
        family, score = 0, 1.0
        if self.family_weights is not None:
            margins = self.family_weights @ x
            family = int(np.argmax(margins))
            rest = np.delete(margins, family).max()
            score = _logistic(margins[family] - rest)
        members = self.families[family]
        wins = {m: [0, 0.0] for m in members}
        closest = dict.fromkeys(members, math.inf)
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                margin = float(self.pair_weights[a, b] @ x)
                won, lost = (a, b) if margin >= 0 else (b, a)
                wins[won][0] += 1
                wins[won][1] += abs(margin)
                closest[won] = min(closest[won], abs(margin))
                closest[lost] = min(closest[lost], -abs(margin))
        best = min(members, key=lambda m: (-wins[m][0], -wins[m][1], m))
        if len(members) > 1:
            score *= _logistic(2 * closest[best])
        return best, score


def _logistic(margin: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, 2.0 * margin))))


def held_out(key: str = "doc_id"):
    """Whether a row is kept out of the fitting: crc32 of the key as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def has_letter(text: str) -> bool:
    """Whether a character is a letter; superscripts, fractions and Roman numeral signs are none."""
    return any(map(str.isalpha, text))


def _lowered(text: str) -> bytes:
    return text.lower().encode()


def fit_language_model(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fits on a bounded sample of the labelled, not held-out rows, drawn by hash.

    Each language gets the share of ``FIT_PER_LANGUAGE`` documents (about ``FIT_TOTAL`` in all), and at least
    the one with the smallest hash, so that no language is left out; the tasks make the features and the
    driver gets one row per language and a vector of fixed size per drawn document, no texts.
    """
    on_workers(docs.sparkSession)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter(
        ~held_out("id") & F.col("lang").isNotNull() & F.col("text").isNotNull()
    ).withColumn("drawn", F.pmod(F.xxhash64(F.lit(_SEED), "id", "text"), F.lit(1 << 40)) / (1 << 40))
    counts = rows.groupBy("lang").agg(F.count("*"), F.min("drawn")).collect()
    if not counts:
        return LanguageModel()
    per_language = min(FIT_PER_LANGUAGE, max(1, FIT_TOTAL // len(counts)))
    limits = docs.sparkSession.createDataFrame(
        [(name, max(per_language / n, least)) for name, n, least in counts], "lang string, most double")
    sample = rows.join(F.broadcast(limits) if len(counts) <= FIT_TOTAL else limits, "lang").filter("drawn <= most")
    sample = sample.dropDuplicates(["lang", "drawn"])  # repeated rows are drawn together

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [features(_lowered(t)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.binary())], names=["lang", "x"])

    found = sample.select("lang", "text").mapInArrow(describe, "lang string, x binary").collect()
    found.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in found), dtype=np.float32).reshape(-1, BUCKETS)
    return LanguageModel.fit(x, [r["lang"] for r in found])


def predict_languages(
    docs: DataFrame, model: LanguageModel | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; only the text is an input of a prediction.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything when no
    labelled row was there to learn from. An empty table gives an empty result. If ``docs`` has
    columns of those names, they are replaced.
    """
    on_workers(docs.sparkSession)
    model = model or fit_language_model(docs, key, text, lang)

    def guess(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hold_memo("language")
        for batch in batches:
            names, scores = [], []
            for t in batch.to_pylist():
                if t is None or not has_letter(t):
                    name, score = UNDETERMINED, 0.0
                else:
                    name, score = model.predict(features(_lowered(t)))
                names.append(name)
                scores.append(score)
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    # not to be evaluated again, in a second worker, by a filter on the result
    udf = F.arrow_udf("struct<lang_pred: string, score: double>")(guess).asNondeterministic()
    out = docs.withColumn("_guess", udf(F.col(text)))
    return out.withColumns({"lang_pred": F.col("_guess.lang_pred"), "score": F.col("_guess.score")}).drop("_guess")


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that have letters, ``lang`` being the predicted one; other columns as they were.

    Rejected are ``und`` (null texts, texts without letters, everything if no row was labelled) and scores below
    ``MIN_SCORE``, which need a cycle of lost duels. The score compares known languages only, so a text in an unknown
    language is not recognised as such: it stays, as the known language nearest to it.
    """
    found = predict_languages(docs, None, key, text, lang)
    rows = found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= MIN_SCORE))
    return rows.withColumn(lang, F.col("lang_pred")).select(*docs.columns)
