"""Mixing documents to target domain weights, in DataFrame expressions."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import keep

#: Domains of the labels table and the share of tokens that each is to have.
TARGETS = {"clean": 0.96, "toxic": 0.02, "junk": 0.02}
#: Labelled documents that the classifier is fitted on at most: those with the least hash of their id.
LABELLED = 20_000
#: Words that the classifier keeps at most, those that tell most; each in so many labelled documents.
FEATURES, LEAST_DOCUMENTS = 512, 10
#: Standard errors, and natural logarithms, that a word's rates in a domain and in the others are to differ by.
SIGNIFICANT, APART = 5.0, 0.7
#: Slots of the table of word weights: the least number from this on that gives each word one of its own.
_SLOTS = 1 << 15


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of labels (doc_id, quality, toxic): junk, toxic or clean; null labels are no labels."""
    domain = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")
    return labels.select("doc_id", domain.alias("domain")).where("doc_id is not null and domain is not null")


def _tokens(text: Column) -> Column:
    """Words in lower case without signs at their ends; the kinds of signs in the text; and how much it repeats itself."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    signs = F.transform(F.array_distinct(F.split(low, r"[\p{L}\p{N}\s]+")), lambda w: F.concat(F.lit("signs "), w))

    def all_of(w: Column) -> Column:
        distinct = F.array_distinct(w)
        share = F.floor(F.size(distinct) * 5 / F.greatest(F.size(w), F.lit(1))).cast("string")
        return F.concat(distinct, signs, F.array(F.concat(F.lit("new words "), share)))

    return F.element_at(F.transform(F.array(words), all_of), 1)


def _vector(values: np.ndarray) -> Column:
    """A constant array, folded into one literal."""
    return F.from_json(F.lit(json.dumps([float(f"{v:.6g}") for v in values])), "array<double>")


def slots_of(hashes: list[int]) -> int:
    """The least number of slots, _SLOTS or more, by which no two of these distinct 64-bit hashes fall together.

    A number of about 2**16 slots keeps 512 hashes apart once in some ten tries, so the search is short; it ends
    for any hashes, since more slots than their range is wide keep all apart.
    """
    n = _SLOTS
    while len({h % n for h in hashes}) < len(hashes):
        n += 1
    return n


@dataclass
class Classifier:
    """Bernoulli word model: by domain a logit without any word, and what each word adds to it."""

    domains: list[str]
    words: list[str]
    hashes: list[int]  # xxhash64 of each word, by Spark
    base: np.ndarray
    weights: np.ndarray

    def score(self, docs: DataFrame, text_col: str) -> DataFrame:
        """docs with n_tokens and p_0, p_1, ...: the posterior of each domain; a text without words has no tokens."""
        text = F.col(text_col).cast("string")
        vocabulary = F.from_json(F.lit(json.dumps(self.words)), "array<string>")
        # A slot for each word makes its weight one access.
        n_slots = slots_of(self.hashes)
        tables = np.zeros((len(self.domains), n_slots))
        for h, column in zip(self.hashes, self.weights.T):
            tables[:, h % n_slots] = column
        slots = F.transform(F.array_intersect(_tokens(text), vocabulary), lambda w: F.pmod(F.xxhash64(w), F.lit(n_slots)).cast("int"))
        n = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
        rows = docs.withColumn("__pressroom_slots", slots).withColumn("n_tokens", n)
        rows = rows.withColumns({f"__pressroom_s{k}": self._logit(k, tables[k]) for k in range(len(self.domains))})
        top = F.greatest(F.lit(-1e300), *[F.col(f"__pressroom_s{k}") for k in range(len(self.domains))])
        parts = [F.exp(F.col(f"__pressroom_s{k}") - top) for k in range(len(self.domains))]
        total = reduce(lambda a, b: a + b, parts)
        return rows.withColumns({f"p_{k}": x / total for k, x in enumerate(parts)}).drop("__pressroom_slots", *[f"__pressroom_s{k}" for k in range(len(self.domains))])

    def _logit(self, k: int, table: np.ndarray) -> Column:
        values = _vector(table)
        return F.aggregate("__pressroom_slots", F.lit(float(self.base[k])), lambda a, i: a + F.get(values, i))


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED, features: int = FEATURES) -> Classifier:
    """Fit on at most `labelled` rows of labels (doc_id, domain): in how many documents of each domain each word stands.

    The labelled ids are few by that bound, so they are broadcast and documents aren't
    shuffled; words are counted map-side first.  Only the `features` words that most surely
    stand oftener in a domain than in the others reach the driver; a domain of more than half
    the documents is known by lacking the words of the others, since what is missing from a
    text depends on its length.  A domain without
    labelled documents has a small prior and no words of its own.
    """
    chosen = labels.where(F.col("domain").isin(domains)).orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(labelled)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    sizes = {r[0]: r[1] for r in rows.groupBy("domain").count().collect()}
    total = [sizes.get(d, 0) for d in domains]
    words = rows.select("domain", F.explode(_tokens(F.col("text"))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"), *[F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(domains)]).where(F.col("n") >= LEAST_DOCUMENTS)
    told = []
    for k in range(len(domains)):
        n_own, n_rest = total[k] + 1.0, sum(total) - total[k] + 1.0
        own, rest = (F.col(f"n{k}") + 0.5) / n_own, (F.col("n") - F.col(f"n{k}") + 0.5) / n_rest
        all_ = (F.col("n") + 1.0) / (n_own + n_rest)
        error = F.sqrt(F.greatest(all_ * (1 - all_), F.lit(1e-12)) * (1 / n_own + 1 / n_rest))
        told.append(F.when((F.log(own / rest) >= APART) & F.lit(n_own <= n_rest), (own - rest) / error).otherwise(0.0))
    best = counts.withColumn("z", F.greatest(F.lit(0.0), *told)).where(F.col("z") >= SIGNIFICANT).orderBy(F.desc("z"), "word").limit(features).withColumn("h", F.xxhash64("word")).collect()
    # Of words with one hash, which don't occur in practice, the surer stays.
    best = list({r["h"]: r for r in reversed(best)}.values())[::-1]
    rate = np.array([[(r[f"n{k}"] + 0.5) / (total[k] + 1.0) for r in best] for k in range(len(domains))]).reshape(len(domains), len(best)).clip(1e-9, 1 - 1e-6)
    prior = np.array(total) + 1.0
    base = np.log(prior / prior.sum()) + np.log1p(-rate).sum(axis=1)
    return Classifier(domains, [r["word"] for r in best], [r["h"] for r in best], base - base.max(), np.log(rate) - np.log1p(-rate))


@dataclass
class Rates:
    """Steps of the projected gradient: a document's rate follows from its posterior and these alone."""

    steps: list[list[float]] = field(default_factory=list)
    expected: list[float] = field(default_factory=list)
    target: list[float] = field(default_factory=list)

    @property
    def residual(self) -> float:
        """The largest miss of a domain's target, as a share of the largest target."""
        return max((abs(e - t) for e, t in zip(self.expected, self.target)), default=0.0) / (max(self.target, default=0.0) or 1.0)

    def of(self, start: Column, posterior: list[Column], steps: list[list[float]]) -> Column:
        if not steps:
            return start
        flat = F.from_json(F.lit(json.dumps([[float(x) for x in s] for s in steps])), "array<array<double>>")
        move = lambda s: reduce(lambda a, b: a + b, [F.get(s, k) * p for k, p in enumerate(posterior)])
        return F.aggregate(flat, start, lambda r, s: F.greatest(F.lit(0.0), r - move(s)))

    def column(self, n_domains: int) -> Column:
        return self.of(F.lit(1.0), [F.col(f"p_{k}") for k in range(n_domains)], self.steps)


def fit_rates(scored: DataFrame, weights: list[float], budget: float | None = None, max_steps: int = 40, tolerance: float = 1e-3) -> Rates:
    """Nonnegative rates whose expected tokens by domain, sum of rate * n_tokens * p_k, are weights * budget.

    Least squares over domains, each residual relative to the domain's own mass, by projected
    gradient from rate 1: every step is one aggregate over the scored table that brings one number for each
    domain to the driver.  Without a budget the domain of the largest weight keeps its tokens.
    Steps end when each total is within tolerance of its target, when they no longer
    change anything, or after max_steps; a warning tells of targets that are missed by over ten times the
    tolerance, and the result's residual says by how much.
    A domain without tokens can't reach its target; the rest are still fitted.
    """
    n = len(weights)
    p = [F.col(f"p_{k}") for k in range(n)]
    tokens = F.col("n_tokens").cast("double")
    pairs = [(a, b) for a in range(n) for b in range(a, n)]
    row = scored.agg(*[F.sum(tokens * p[k]).alias(f"m{k}") for k in range(n)], *[F.sum(tokens * p[a] * p[b]).alias(f"g{a}_{b}") for a, b in pairs]).first()
    mass = np.array([row[f"m{k}"] or 0.0 for k in range(n)])
    share = np.array(weights) / sum(weights)
    if not mass.sum():
        return Rates([], mass.tolist(), mass.tolist())
    if budget is None:
        main = int(share.argmax())
        budget = mass[main] / share[main]
    target = share * budget
    gram = np.zeros((n, n))
    for a, b in pairs:
        gram[a, b] = gram[b, a] = row[f"g{a}_{b}"] or 0.0
    scale = 1 / np.maximum(np.diag(gram), 1e-9 * mass.sum())
    root = np.sqrt(scale)
    step = 1 / max(np.linalg.eigvalsh(root[:, None] * gram * root[None, :]).max(), 1e-9)
    rates, now = Rates([], mass.tolist(), target.tolist()), mass
    table, done = scored.select("n_tokens", *p, F.lit(1.0).alias("rate")), 0
    for i in range(max_steps):
        if np.abs(now - target).max() <= tolerance * target.max():
            break
        rates.steps.append((step * scale * (now - target)).tolist())
        if len(rates.steps) - done > 15:
            table, done = keep(table.withColumn("rate", rates.of(F.col("rate"), p, rates.steps[done:])), "rates"), len(rates.steps)
        rate = rates.of(F.col("rate"), p, rates.steps[done:])
        got = table.select("n_tokens", *p, rate.alias("rate")).agg(*[F.sum(F.col("rate") * tokens * x).alias(f"e{k}") for k, x in enumerate(p)]).first()
        before, now = now, np.array([got[f"e{k}"] or 0.0 for k in range(n)])
        rates.expected = now.tolist()
        if np.abs(now - before).max() <= 0.05 * tolerance * target.max():
            break
    if rates.residual > 10 * tolerance:
        warnings.warn(f"rates miss a target by {rates.residual:.3g} of the largest: expected {rates.expected}, targets {rates.target}", stacklevel=2)
    return rates


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", budget: float | None = None, seed: int = 17, labelled: int = LABELLED) -> DataFrame:
    """docs with n_tokens, domain, p_0 ... (in the order of targets), rate and copies.

    labels is (doc_id, domain).  A classifier fitted on it gives each document's posterior
    over the domains of targets; fit_rates finds rates of 0 or more with the target
    shares of tokens.  copies is the rate rounded to one of its neighbours by a draw that
    hashes id and seed, so that its mean is the rate.

    Null and empty texts have no tokens, the posterior of a text without words, and the rate that follows from it.  Rows that
    repeat an id have one draw.  An empty table gives an empty one; without labels all
    posteriors are uniform.  Columns of docs with the names above are replaced.
    """
    targets = targets or TARGETS
    domains = list(targets)
    model = fit_classifier(docs, labels, domains, id_col, text_col, labelled)
    scored = keep(model.score(docs.drop("n_tokens", "domain", "rate", "copies", *[f"p_{k}" for k in range(len(domains))]), text_col), "scored")
    rates = fit_rates(scored, [targets[d] for d in domains], budget)
    top = F.greatest(*[F.col(f"p_{k}") for k in range(len(domains))])
    domain = F.coalesce(*[F.when(F.col(f"p_{k}") == top, F.lit(d)) for k, d in enumerate(domains)])
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    out = scored.withColumn("domain", domain).withColumn("rate", rates.column(len(domains)))
    return out.withColumn("copies", F.floor(F.col("rate") + draw).cast("long"))


def sample_mix(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as mix gives it copies, columns as they are.

    Copies of a row keep its id.
    """
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(options.pop("id_col", "doc_id")).alias("doc_id"), F.col(options.pop("text_col", "text")).alias("text"))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return mix(packed, labels, **options).where("copies > 0").select("row", copies.alias("copy")).select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    labels = label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    packed = mix(docs, labels)
    return packed.select("doc_id", "source", "n_tokens", "domain", *[F.round(f"p_{k}", 6).alias(f"p_{d}") for k, d in enumerate(TARGETS)], F.round("rate", 6).alias("rate"), "copies")
