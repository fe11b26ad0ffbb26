"""Soft-membership mixing to target weights, in DataFrame operations only.

1. A classifier over words learns the domains of a labelled table and gives every document a posterior.  Words are
   counted in one half of the labelled documents: a word speaks for a domain by the logarithm of (count + SMOOTHING) /
   (count that the other domains let expect + SMOOTHING), less LEAST, so words of a language or a topic, which only lean to a domain, say nothing.  A
   document has two numbers for each domain: the mean of what its words say and a share that nears 1 with their sum.  A
   multinomial regression on these numbers, fitted to the other half of the labelled documents, gives the posteriors;
   they are calibrated, and a document whose words say nothing has those of such documents.
2. Every document gets a rate r >= 0 (how often its tokens are taken).  The expected tokens of domain d are
   sum(r * n_tokens * p[d]), and the rates fit them to the targets by least squares.  The gradient of the squared miss
   moves a document's rate by a combination of its posteriors alone, so the steps taken so far are one slope for every
   domain, and the projected rate is max(0, 1 + sum(slope[d] * p[d])).  Steps are scaled by the inverse of
   sum(n * p * p') over the documents whose rate is not held at a bound, and halved while the objective, which is convex, does
   not fall.  A step reads the posteriors once and brings some numbers per domain to the driver.  A small ridge on the
   slopes makes the fit unique where the targets cannot be met; then the miss is the least one.

Rows of one doc_id (also of a null doc_id) are one document: their words add up and they share one rate.  Null and
wordless texts have 0 tokens and the posterior of documents whose words say nothing.  Labels with a null, or with a domain without a target, are
ignored; with no labels at all the posterior is uniform and all rates are equal.  An empty table gives no rows.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, unused

#: Labelled documents that the classifier learns from, for each domain, and the size of its vocabulary.
PER_DOMAIN, VOCABULARY = 1_500, 8_192
#: Logarithm of how much more likely a word must be in a domain to say something, and the sum at which a share is a half.
SMOOTHING, LEAST, HALF = 5.0, math.log(3), 4.0
TOLERANCE, RIDGE = 1e-7, 1e-7
#: ``mixed`` trades a miss of this share of the tokens for one unit of slope.
SOFT = 1e-3

log = logging.getLogger(__name__)


def _words(text: str = "text") -> Column:
    """Lower-cased words between white space, as an array with empty strings where spaces repeat."""
    return F.split(F.translate(F.lower(F.col(text)), "\n\r\t\x0b\x0c", "     "), " ", -1)


@dataclass
class DomainModel:
    """``weights``: 64-bit hash of a word and what it says for each domain, at most VOCABULARY rows.

    ``factors``: a row for each domain, its constant and the factors of all domains' means and shares.
    """

    domains: list[str]
    factors: np.ndarray
    weights: DataFrame | None


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> DomainModel:
    """Learn from docs (doc_id, text) and labelled (doc_id, domain).

    The driver gets counts per domain, and the numbers of about half of the labelled documents, which PER_DOMAIN bounds;
    the vocabulary, of proven size, stays a DataFrame that can be broadcast.
    """
    d = range(len(domains))
    known = labelled.select("doc_id", "domain").where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
    counts = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return DomainModel(domains, np.zeros((len(domains), 1 + 2 * len(domains))), None)
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(1e6 * min(1.0, PER_DOMAIN / n)) + 1))])
    picked = known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("mix")), F.lit(1_000_000)) < share[F.col("domain")]).distinct()
    # About PER_DOMAIN rows of two values for each domain, whatever the corpus: they are broadcast, and no text is shuffled.
    texts = stored(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), "mix-labelled")
    first = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("half")), F.lit(2)) == 0
    words = texts.where(first).select("domain", F.explode(_words()).alias("word")).where("word <> ''").select("domain", F.xxhash64("word").alias("word"))
    counted = stored(words.groupBy("word").agg(*[F.count_if(F.col("domain") == k).alias(f"n{i}") for i, k in enumerate(domains)]), "mix-words")
    total = " + ".join(f"n{i}" for i in d)
    sums = counted.agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in d]).first()
    whole = max(1, sum(sums[f"n{i}"] or 0 for i in d))
    top = counted.orderBy(F.expr(total).desc(), "word").limit(VOCABULARY)
    # Counts that the other domains let expect.
    odds = [(sums[f"n{i}"] or 0) / max(1, whole - (sums[f"n{i}"] or 0)) for i in d]
    says = [F.log((F.col(f"n{i}") + SMOOTHING) / ((F.expr(total) - F.col(f"n{i}")) * odds[i] + SMOOTHING)) for i in d]
    model = DomainModel(domains, np.zeros((len(domains), 1 + 2 * len(domains))), stored(top.select("word", *[F.greatest(x - LEAST, F.lit(0.0)).alias(f"l{i}") for i, x in enumerate(says)]), "mix-weights"))
    rest = texts.where(~first)
    got = _evidence(rest, model).join(rest.select("doc_id", "domain").distinct(), "doc_id").select("domain", F.array(*_numbers(len(domains))).alias("x")).collect()
    # Documents rarer than one in share count for more, so the posteriors are those of the whole labelled table.
    weight = np.array([max(1.0, counts[r["domain"]] / PER_DOMAIN) for r in got])
    model.factors = _regression(np.array([r["x"] for r in got]).reshape(len(got), 2 * len(domains)), np.array([domains.index(r["domain"]) for r in got], int), weight, [counts.get(k, 0) for k in domains])
    return model


def _regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, counts: list[int], rounds: int = 400, penalty: float = 1e-3) -> np.ndarray:
    """Multinomial regression by accelerated gradient steps; starts at the shares of the domains."""
    prior = np.log((np.array(counts, float) + 1) / (sum(counts) + len(counts)))
    out = np.zeros((len(counts), 1 + x.shape[1]))
    out[:, 0] = prior
    if not len(x):
        return out
    scale = np.append(1.0, x.std(axis=0) + 1e-6)
    full = np.hstack([np.ones((len(x), 1)), x]) / scale
    weight, wanted = weight / weight.sum(), np.eye(len(counts))[y]
    size = 1 / (0.5 * float(np.linalg.eigvalsh((full * weight[:, None]).T @ full)[-1]) + penalty)
    now = look = out * scale
    now[:, 0] = look[:, 0] = prior
    for k in range(rounds):
        z = full @ look.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slope = ((p - wanted) * weight[:, None]).T @ full
        slope[:, 1:] += penalty * look[:, 1:]
        after = look - size * slope
        look = after + k / (k + 3) * (after - now)
        now = after
    return now / scale


def _evidence(docs: DataFrame, model: DomainModel) -> DataFrame:
    """doc_id, n_tokens, known (words of the vocabulary) and the sums l of what they say."""
    d = range(len(model.domains))
    words = docs.select("doc_id", F.explode_outer(_words()).alias("word")).select("doc_id", (F.col("word") != "").alias("counts"), F.xxhash64("word").alias("word"))
    if model.weights is not None:
        words = words.join(F.broadcast(model.weights), "word", "left")
    else:
        words = words.select("*", *[F.lit(None).cast("double").alias(f"l{i}") for i in d])
    return words.groupBy("doc_id").agg(F.count_if("counts").alias("n_tokens"), F.count("l0").alias("known"), *[F.coalesce(F.sum(f"l{i}"), F.lit(0.0)).alias(f"l{i}") for i in d])


def _numbers(domains: int) -> list[Column]:
    """The numbers of a row of ``_evidence``: means, then shares."""
    sums = [F.col(f"l{i}") for i in range(domains)]
    return [s / (F.col("known") + 1) for s in sums] + [s / (s + HALF) for s in sums]


def posteriors(docs: DataFrame, model: DomainModel) -> DataFrame:
    """doc_id, n_tokens, p (one value for each domain, sum 1) of every document."""
    numbers = _numbers(len(model.domains))
    logits = [sum((x * float(w) for x, w in zip(numbers, row[1:])), F.lit(float(row[0]))) for row in model.factors]
    out = _evidence(docs, model).select("doc_id", "n_tokens", F.array(*logits).alias("z"))
    out = out.select("doc_id", "n_tokens", F.transform("z", lambda z: F.exp(z - F.array_max("z"))).alias("e"))
    out = out.withColumn("sum", F.aggregate("e", F.lit(0.0), lambda a, b: a + b))
    return out.select("doc_id", "n_tokens", F.transform("e", lambda e: e / F.col("sum")).alias("p"))


@dataclass
class Rates:
    """``slopes``: one for each domain; ``reached`` and ``wanted``: expected tokens of each domain; ``steps`` taken."""

    slopes: list[float]
    reached: list[float]
    wanted: list[float]
    steps: int = 0
    most: float | None = None

    def point(self, p: str = "p") -> Column:
        """The rate before it is projected."""
        return sum((F.col(p)[i] * s for i, s in enumerate(self.slopes)), F.lit(1.0))

    def column(self, p: str = "p") -> Column:
        rate = F.greatest(F.lit(0.0), self.point(p))
        return rate if self.most is None else F.least(F.lit(self.most), rate)


def ascend(at, start: list, want: np.ndarray, free: np.ndarray, ridge: float, tolerance: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Slopes within the span of ``free`` at which what is reached, plus ridge * slopes, is ``want``.

    ``at(slopes)``: what is reached, the Gram matrix and the objective; ``start``: the same at 0.  The objective is convex
    and quadratic between the places where rates meet bounds; the ridge keeps its minimum finite.  Ends when the gradient
    is within the tolerance or a step lowers the objective by no more than rounding does.
    """
    slopes, (got, gram, square), taken = np.zeros(len(want)), start, 0
    value = square
    while np.abs(rise := free.T @ (want - got - ridge * slopes)).max(initial=0) > tolerance:
        step, size = free @ np.linalg.solve(free.T @ gram @ free + ridge * np.eye(len(rise)), rise), 1.0
        while True:
            after = slopes + size * step
            got_after, gram_after, square_after = at(after)
            value_after = square_after - want @ after + 0.5 * ridge * after @ after
            if value_after <= value - 1e-4 * size * (free @ rise @ step) or size * np.abs(step).max() <= 1e-12 * (1 + np.abs(slopes).max()):
                break
            size /= 2
        taken += 1
        if not value_after < value - 1e-14 * max(1.0, abs(value)):
            break
        slopes, value, got, gram = after, value_after, got_after, gram_after
    return slopes, got, taken


def fit_rates(members: DataFrame, weights: list[float], total_tokens: float | None = None, most: float | None = None, ridge: float = RIDGE, tolerance: float = TOLERANCE) -> Rates:
    """Nonnegative rates for members (n_tokens, p) whose expected tokens are nearest to their shares of ``total_tokens``.

    The total is that of the members by default.  With ``most`` no rate is higher, and the total is free: the rates are
    those nearest to ``most`` that have the shares.  The steps end when the gradient, as a share of all tokens, is within
    the tolerance, or when no step lowers the objective any more; ``Rates`` has what was reached.
    """
    d, k = range(len(weights)), len(weights)
    if not sum(weights) > 0 or min(weights) < 0:
        raise ValueError("weights must be nonnegative, and one of them positive")
    share = np.array(weights) / sum(weights)
    # With a free total, slopes along the shares would only scale it, so there are none.
    free = np.eye(k) if most is None else np.linalg.svd(share[None])[2][1:].T

    def at(slopes: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
        """All tokens; by token: expected tokens, Gram matrix of the documents at no bound, and the objective."""
        rates = Rates(slopes.tolist(), [], [], most=most)
        seen = members.select("n_tokens", "p", rates.point().alias("u"), rates.column().alias("r"))
        inside = F.col("u") > 0 if most is None else (F.col("u") > 0) & (F.col("u") < most)
        got = seen.agg(
            F.sum("n_tokens").alias("n"),
            # The integral of the rate over its point: u * r - r * r / 2, with u at least 0.
            F.sum(F.col("n_tokens") * (F.greatest("u", F.lit(0.0)) * F.col("r") - F.col("r") * F.col("r") / 2)).alias("q"),
            *[F.sum(F.col("n_tokens") * F.col("r") * F.col("p")[i]).alias(f"a{i}") for i in d],
            *[F.sum(F.when(inside, F.col("n_tokens") * F.col("p")[i] * F.col("p")[j])).alias(f"g{i}_{j}") for i in d for j in d if i <= j],
        ).first()
        n = float(got["n"] or 0)
        if not n:
            return 0.0, np.zeros(k), np.zeros((k, k)), 0.0
        gram = np.array([[got[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in d] for i in d]) / n
        return n, np.array([got[f"a{i}"] for i in d]) / n, gram, got["q"] / n

    n, *start = at(np.zeros(k))
    if not n:
        return Rates([0.0] * k, [0.0] * k, [0.0] * k, most=most)
    want = share * ((n if total_tokens is None else total_tokens) / n) if most is None else np.zeros(k)
    slopes, got, taken = ascend(lambda x: at(x)[1:], start, want, free, ridge, tolerance)
    wanted = share * (n * got.sum() if most is not None else n * want.sum())
    return Rates(slopes.tolist(), (n * got).tolist(), wanted.tolist(), taken, most)


def _fitted(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], **options) -> tuple[DomainModel, DataFrame, Rates]:
    model = fit_domains(docs, labelled, sorted(weights))
    members = stored(posteriors(docs, model), "mix-members")
    rates = fit_rates(members, [weights[d] for d in model.domains], **options)
    log.info("tokens of %s after %d steps: reached %s, wanted %s", model.domains, rates.steps, rates.reached, rates.wanted)
    return model, members, rates


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], total_tokens: float | None = None) -> DataFrame:
    """doc_id, n_tokens, p_<domain> for every domain, rate.

    ``weights``: the share of all tokens that each domain shall have.  ``total_tokens``: tokens to take, those of the
    corpus by default.
    """
    model, members, rates = _fitted(docs, labelled, weights, total_tokens=total_tokens)
    return members.select("doc_id", "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(model.domains)], rates.column().alias("rate"))


def mixed(docs: DataFrame, labelled: DataFrame, weights: dict[str, float]) -> DataFrame:
    """A mix without repeats, all columns as they are: the least thinning of the corpus that has the target shares.

    A document stays if a number made of its id, uniform in [0, 1), is below its rate, which is 1 at most.  Documents of
    domains that are to gain have the rate 1.  Shares that no subset has are met in part (see ``SOFT``), and rates are
    scaled so that the highest is 1.  Rows of one doc_id stay or go together; with no labels every row stays.
    """
    _, members, rates = _fitted(docs, labelled, weights, most=1.0, ridge=SOFT)
    top = members.agg(F.max(rates.column()).alias("top")).first()["top"]
    number = F.pmod(F.xxhash64("doc_id", F.lit("take")), F.lit(1 << 40)) / float(1 << 40)
    own = unused(docs, "taken")
    taken = members.where(number < rates.column() / (top or 1.0)).select(F.col("doc_id").alias(own))
    return docs.join(taken, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")


#: Domains of the labels table, and the shares that the mix shall have.  Calibrated posteriors give documents without a
#: toxic word about 0.03 of that domain, as some labels say so; a smaller share than that could not be met.
WEIGHTS = {"clean": 0.88, "poor": 0.06, "toxic": 0.06}


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of labels (doc_id, quality, toxic)."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "poor").alias("domain"))
