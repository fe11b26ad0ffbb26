"""Hierarchical language identification.

Step one predicts the language family, step two separates the languages of that family with one-versus-one linear
support vector machines.  Features are shares of hashed byte pairs and triples of the lower-cased text, over the whole
text; everything that is no letter counts as a space.  A linear machine over shares is a sum of one weight per byte, so
prediction is a table lookup per byte and the feature vector is never built.

Defined results: ``und`` with score 0 if the text is null, empty or has no letter, or if nothing could be learned.
Rows that repeat are predicted alike.  Only text and the label of rows that are not held out are learned from, at most
about ``PER_LANGUAGE`` documents of each language, picked by a hash of their id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_arrow, steps

#: Labelled documents learned from, for each language.
PER_LANGUAGE = 500
PAIR_BITS, TRIPLE_BITS = 11, 12
_D = (1 << PAIR_BITS) + (1 << TRIPLE_BITS)

#: Families of languages by code; a language that is not here is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "baltic": ("lt", "lv"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "indic": ("bn", "hi", "mr", "ne", "pa", "ur"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
#: Letters by their Unicode category, for training (in the JVM) and prediction alike.
_LETTER_CLASS = r"\p{L}"
_LETTER = regex.compile(_LETTER_CLASS)
_FOLD = np.full(256, 32, np.uint8)
_FOLD[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]


def family(language: str) -> str:
    return _FAMILY.get(language, language)


def _codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all byte pairs and of all byte triples of a text."""
    b = _FOLD[np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b"  ", np.uint8)].astype(np.uint32)
    two = (b[:-2] << np.uint32(8)) | b[1:-1]
    three = (two << np.uint32(8)) | b[2:]
    with np.errstate(over="ignore"):
        return (two * np.uint32(2654435761)) >> np.uint32(32 - PAIR_BITS), ((three * np.uint32(2246822519)) >> np.uint32(32 - TRIPLE_BITS)) + np.uint32(1 << PAIR_BITS)


def shares(text: str) -> np.ndarray:
    two, three = _codes(text)
    return ((np.bincount(two, minlength=_D) + np.bincount(three, minlength=_D)) / len(two)).astype(np.float32)


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by accelerated gradient steps; classes weigh alike; y is 1 or -1."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    ridge = np.full(x.shape[1], 1e-3 / c, np.float32)
    ridge[-1] = 0
    v = np.ones(x.shape[1], np.float32)
    for _ in range(12):
        v = x.T @ (weight * (x @ v))
        size = float(np.linalg.norm(v)) or 1.0
        v /= size
    step = 1.0 / (2 * size + 1e-3 / c)
    w = look = np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ look))
        after = look - step * (ridge * look - 2 * (x.T @ (weight * y * slack)))
        look = after + (k / (k + 3)) * (after - w)
        w = after
    return w[:-1], float(w[-1])


@dataclass
class LanguageModel:
    """``weights`` has a column for each machine: first one for each family, then one for each pair in a family."""

    languages: list[str]
    families: list[str]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, labels: list[str]) -> LanguageModel:
        languages = sorted(set(labels))
        families = sorted({family(a) for a in languages})
        pairs = [(a, b) for a in languages for b in languages if a < b and family(a) == family(b)]
        scale = 1 / (x.std(axis=0) + 1e-4) if len(x) else np.ones(_D, np.float32)
        own, kin = np.array(labels), np.array([family(a) for a in labels])
        columns, bias = [], []
        for f in families:
            w, b = train_svm(x * scale, np.where(kin == f, 1, -1).astype(np.float32)) if len(families) > 1 else (np.zeros(_D, np.float32), 1.0)
            columns.append(w * scale)
            bias.append(b)
        for a, b in pairs:
            part = (own == a) | (own == b)
            w, c = train_svm(x[part] * scale, np.where(own[part] == a, 1, -1).astype(np.float32))
            columns.append(w * scale)
            bias.append(c)
        return cls(languages, families, pairs, np.stack(columns, axis=1).astype(np.float32) if columns else np.zeros((_D, 0), np.float32), np.array(bias))

    def predict(self, text: str) -> tuple[str, float]:
        if not self.languages or not _LETTER.search(text):
            return "und", 0.0
        two, three = _codes(text)
        n, total = len(two), np.zeros(self.weights.shape[1])
        for lo in range(0, n, 65_536):
            total += self.weights[two[lo : lo + 65_536]].sum(axis=0, dtype=np.float64) + self.weights[three[lo : lo + 65_536]].sum(axis=0, dtype=np.float64)
        margin = total / n + self.bias
        chance = 1 / (1 + np.exp(-3 * np.clip(margin, -10, 10)))
        k = int(margin[: len(self.families)].argmax())
        among = [a for a in self.languages if family(a) == self.families[k]]
        votes = {a: [0, 1.0] for a in among}
        for (a, b), p in zip(self.pairs, chance[len(self.families) :]):
            if a in votes:
                votes[a if p >= 0.5 else b][0] += 1
                votes[a][1], votes[b][1] = min(votes[a][1], p), min(votes[b][1], 1 - p)
        best = max(among, key=lambda a: (votes[a][0], votes[a][1], a))
        return best, float(chance[k] * votes[best][1])


def _share_rows(batches):
    for batch in batches:
        for part, texts in steps(batch, "text"):
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("lang")), pa.array([shares(t).astype(np.float16).tobytes() for t in texts], pa.binary())], names=["lang", "x"])


def fit_language_model(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learn from (doc_id, text, lang); feature shares are computed on the executors and only they come to the driver."""
    rows = labelled.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").rlike(_LETTER_CLASS))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel.fit(np.zeros((0, _D), np.float32), [])
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(int(1e6 * min(1.0, per_language / n)) + 1))])
    picked = rows.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1_000_000)) < share[F.col("lang")])
    got = map_arrow(picked, _share_rows, "lang string, x binary").collect()
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32) if got else np.zeros((0, _D), np.float32)
    order = np.lexsort(x.T[::-1][:8]) if len(x) else []
    return LanguageModel.fit(x[order], [got[i]["lang"] for i in order])


def _predictions(model: LanguageModel):
    def run(batches):
        for batch in batches:
            found, scores = [], []
            for _, texts in steps(batch, "text"):
                for t in texts:
                    lang, score = model.predict(t)
                    found.append(lang)
                    scores.append(score)
            names = [n for n in batch.schema.names if n not in ("text", "lang_pred", "score")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"]
            )

    return run


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score of every row of (doc_id, text)."""
    return map_arrow(docs.select("doc_id", "text"), _predictions(model), "doc_id long, lang_pred string, score double")


def _kept(model: LanguageModel):
    def run(batches):
        for batch in batches:
            keep = []
            for _, texts in steps(batch, "text"):
                keep += [model.predict(t)[0] != "und" for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows whose language can be told, all columns as they are; texts without a letter are rejected.

    Every row goes by its own text, whatever its doc_id.
    """
    return docs.mapInArrow(_kept(model), docs.schema)


def trainable(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out())
