"""Mixing documents to target weights by soft membership in domains: DataFrame functions only."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyagg.llm.common import Workspace

#: Hash buckets of words, posteriors' resolution, the squared z-score from which a word counts and how many do for a domain, and calibrations tried.
BUCKETS, GRID, CHANCE, TELLING = 32768, 256, 10.0, 80
BETWEEN = r"[\\s.,;:?()]+"
SCALES = [(a, b) for a in (0.02, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0) for b in (0.0, 0.5, 1.0)]


def words(text: str) -> Column:
    """A text's words, lower-cased: what stands between white space and common punctuation."""
    return F.expr(f"array_remove(split(lower(coalesce({text}, '')), '{BETWEEN}'), '')")


def word_buckets(words: str) -> Column:
    """The buckets of the different words.  How often a text repeats a word tells little: its lines may be copies."""
    return F.expr(f"array_distinct(transform({words}, w -> CAST(xxhash64(w) & {BUCKETS - 1} AS INT)))")


def numbers(values: list[float]) -> str:
    """SQL of a constant array."""
    return f"from_json('{json.dumps([round(v, 5) for v in values])}', 'array<double>')"


class NaiveBayes:
    """Word weights for domains, less those of the last domain, whose score is 0; the posterior is the softmax of
    log prior + a * score / n^b, of which (a, b) is chosen by likelihood."""

    def __init__(self, domains: list[str], prior: list[float], weights: list[list[float]]):
        self.domains, self.prior, self.weights, self.scale = domains, prior, weights, SCALES[0]

    def scores(self, words: str) -> str:
        """SQL for the domains' scores."""
        sums = [f"aggregate({words}, 0D, (s, x) -> s + {numbers([a - b for a, b in zip(w, self.weights[-1], strict=True)])}[x])" for w in self.weights[:-1]]
        return f"array({', '.join([*sums, '0D'])})"

    def posteriors(self, scores: str, words: str, scale: tuple[float, float] | None = None) -> str:
        a, b = scale or self.scale
        prior = f"array({', '.join(f'{math.log(p)}D' for p in self.prior)})"
        z = f"zip_with({scores}, {prior}, (s, p) -> p + {a}D * s / pow(greatest(size({words}), 1), {b}D))"
        e = f"transform(array({z}), z -> transform(z, x -> exp(x - array_max(z))))[0]"
        return f"transform(array({e}), e -> transform(e, x -> x / aggregate(e, 0D, (s, y) -> s + y)))[0]"


def learn_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], space: Workspace, docs_per_domain: int = 4000, limit: int = 200) -> NaiveBayes | None:
    """Fit on a bounded sample of labelled (doc_id, domain): about docs_per_domain ids of each domain, at most `limit` % more,
    by a hash of the id.  The sample is broadcast, as its size is bounded, so documents are not shuffled; word counts
    are pre-aggregated to at most BUCKETS numbers a domain.  Half the sample gives the words' weights, half the calibration.
    """
    labelled = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).select(F.col("doc_id").alias("_id"), F.col("domain").alias("_domain"))
    counts = {r[0]: r[1] for r in labelled.groupBy("_domain").count().collect()}
    if not counts:
        return None
    chance = F.pmod(F.xxhash64("_id", F.lit(23)), F.lit(1 << 24)) / float(1 << 24)
    share = F.lit(0.0)
    for d, n in counts.items():
        share = F.when(F.col("_domain") == d, min(1.0, docs_per_domain / n)).otherwise(share)
    most = docs_per_domain * len(domains) * (100 + limit) // 100
    sample = labelled.where(chance < share).groupBy("_id").agg(F.min("_domain").alias("_domain")).orderBy(F.xxhash64("_id", F.lit(23)), "_id").limit(most)
    half = F.pmod(F.xxhash64("_id", F.lit(29)), F.lit(2))
    # a table of its own: else Spark would try the words of all documents for whether there are any
    texts = space.stage(docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("_id", "_domain", "text"), "sample")
    known = texts.select("_domain", half.alias("half"), words("text").alias("_words")).withColumn("words", word_buckets("_words"))
    seen = known.where("half = 0").select("_domain", F.explode("words").alias("bucket")).groupBy("_domain", "bucket").count().collect()
    if not seen:
        return None
    table = {d: [0.5] * BUCKETS for d in domains}
    for r in seen:
        table[r["_domain"]][r["bucket"]] += r["count"]
    weights = []
    for d in domains:
        rest = [sum(table[k][b] for k in domains if k != d) for b in range(BUCKETS)]
        own, other = sum(table[d]), max(sum(rest), 1.0)
        odds = [math.log(x / own) - math.log(max(y, 0.5) / other) for x, y in zip(table[d], rest, strict=True)]
        # a weight that chance could have made is noise, of which long texts would add up much
        sure = [w * w / (1 / x + 1 / max(y, 0.5)) for w, x, y in zip(odds, table[d], rest, strict=True)]
        least = max(CHANCE, sorted(sure)[-TELLING])
        weights.append([w if z >= least else 0.0 for w, z in zip(odds, sure, strict=True)])
    total = sum(counts.values())
    model = NaiveBayes(domains, [max(counts.get(d, 0), 1) / total for d in domains], weights)
    rest = known.where("half = 1").select("words", F.expr(f"array_position(array({', '.join(repr(d) for d in domains)}), _domain)").alias("place"), F.expr(model.scores("words")).alias("scores"))
    # a sample of even shares: each domain weighs by its prior
    by_domain = F.element_at(F.expr(f"array({', '.join(f'{p}D' for p in model.prior)})"), F.col("place").cast("int"))
    fits = [F.avg(by_domain * F.log(F.greatest(F.lit(1e-12), F.element_at(F.expr(model.posteriors("scores", "words", s)), F.col("place").cast("int"))))).alias(f"s{i}") for i, s in enumerate(SCALES)]
    fit = rest.agg(*fits).first()
    model.scale = max((fit[i], s) for i, s in enumerate(SCALES) if fit[i] is not None)[1] if fit[0] is not None else SCALES[0]
    return model


def in_steps(exact: str) -> str:
    """SQL: posteriors rounded to steps of 1 / GRID that add up to 1, the steps left over to the largest remainders (equal
    ones: the last), so that no domain gains by rounding."""
    cut = f"transform({exact}, x -> named_struct('whole', floor(x * {GRID}), 'rest', x * {GRID} - floor(x * {GRID})))"
    ahead = "size(filter(c, (y, j) -> y.rest > x.rest OR (y.rest = x.rest AND j > i)))"
    return f"transform(array({cut}), c -> transform(c, (x, i) -> (x.whole + IF({ahead} < {GRID} - aggregate(c, 0L, (s, y) -> s + y.whole), 1, 0)) / {GRID}D))[0]"


def membership(docs: DataFrame, model: NaiveBayes | None, domains: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in keep, n_tokens and member, the posteriors of the domains in steps of 1 / GRID, adding up to 1."""
    rows = docs.select("doc_id", *keep, words("text").alias("_all")).withColumn("_words", word_buckets("_all"))
    if model is None:
        exact = rows.withColumn("_exact", F.expr(f"array_repeat({1 / len(domains)}D, {len(domains)})"))
    else:
        exact = rows.withColumn("_scores", F.expr(model.scores("_words"))).withColumn("_exact", F.expr(model.posteriors("_scores", "_words")))
    return exact.select("doc_id", *keep, F.size("_all").cast("long").alias("n_tokens"), F.expr(in_steps("_exact")).alias("member"))


class Rates:
    """Rates r >= 0 that bring sum(r * tokens * member) to the targets: the least of

        1/2 * sum over domains of (share - target)^2 / target + ridge/2 * mean over tokens of (r - 1)^2.

    There r = max(0, 1 - member . error / ridge), where a domain's error is (share - target) / target: a gradient step from rates of 1,
    projected on nonnegative ones.  So a rate is a function of the membership and of one number for each domain.
    """

    def __init__(self, targets: list[float], ridge: float, errors: list[float]):
        self.targets, self.ridge, self.errors = targets, ridge, errors

    def at(self, errors: list[float]) -> Column:
        dot = " + ".join(f"member[{k}] * {float(e)!r}D" for k, e in enumerate(errors))
        return F.expr(f"greatest(0D, 1D - ({dot}) / {self.ridge!r}D)")

    def rate(self) -> Column:
        return self.at(self.errors)


def solved(a: list[list[float]], b: list[float]) -> list[float]:
    """x of a x = b, for a positive definite matrix, by elimination."""
    rows, n = [[*r, v] for r, v in zip(a, b, strict=True)], len(b)
    for i in range(n):
        for k in range(i + 1, n):
            f = rows[k][i] / rows[i][i]
            rows[k] = [x - f * y for x, y in zip(rows[k], rows[i], strict=True)]
    x = [0.0] * n
    for i in reversed(range(n)):
        x[i] = (rows[i][n] - sum(rows[i][k] * x[k] for k in range(i + 1, n))) / rows[i][i]
    return x


def fit_rates(cells: DataFrame, targets: list[float], ridge: float = 0.001, tolerance: float = 1e-7, most: int = 1000) -> Rates:
    """Fit on cells (member, tokens): one row for each membership that occurs, so at most as many as the grid has points.

    Each step projects the gradient's step at the domains' errors, sums the tokens that these rates give over the distributed cells,
    and moves the errors towards those they cause.  The errors are where a convex function has its least value, so its curvature
    (Newton's method) scales the move; one that does not lower it enough is halved.  It ends when the rates' shares are those of the errors to `tolerance` of the targets; `most` steps are
    a guard that a piecewise quadratic function does not reach.
    """
    n = len(targets)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    weigh = [max(t, 1e-4) for t in targets]
    rates = Rates(targets, ridge, [0.0] * n)
    if not total:
        return rates
    mass = [F.col("tokens") * F.col("member")[k] for k in range(n)]
    pairs = [(i, k) for i in range(n) for k in range(i, n)]

    def look(errors):
        """The function's value, slope and curvature."""
        r = rates.at(errors)
        live = F.when(r > 0, 1.0).otherwise(0.0)
        bend = [F.sum(live * mass[i] * F.col("member")[k]) for i, k in pairs]
        row = cells.agg(F.sum(F.col("tokens") * r * r), *(F.sum(r * m) for m in mass), *bend).first()
        value = sum(w * e * e / 2 + t * e for w, t, e in zip(weigh, targets, errors, strict=True)) + ridge / 2 * row[0] / total
        slope = [w * e + t - row[1 + k] / total for k, (w, t, e) in enumerate(zip(weigh, targets, errors, strict=True))]
        curve = [[0.0] * n for _ in range(n)]
        for (i, k), x in zip(pairs, row[1 + n :], strict=True):
            curve[i][k] = curve[k][i] = x / total / ridge + (weigh[i] if i == k else 0.0)
        return value, slope, curve

    value, slope, curve = look(rates.errors)
    for _ in range(most):
        if max(abs(x) / w for x, w in zip(slope, weigh, strict=True)) < tolerance:
            break
        step, part = solved(curve, slope), 1.0
        fall = sum(a * b for a, b in zip(step, slope, strict=True))
        while True:
            tried = [e - part * x for e, x in zip(rates.errors, step, strict=True)]
            found = look(tried)
            if found[0] <= value - 1e-4 * part * fall or part < 1e-6:
                break
            part /= 2
        if part < 1e-6:
            break  # no lower value can be told in double precision
        rates.errors, (value, slope, curve) = tried, found
    return rates


class Mixture:
    """Memberships of a table's documents and, by fit(), the rates that bring their totals to targets."""

    def __init__(self, docs: DataFrame, labelled: DataFrame, domains: list[str], keep: tuple[str, ...] = ()):
        self.domains, space = domains, Workspace(docs.sparkSession, "mix")
        self.model = learn_domains(docs, labelled, domains, space)
        self.rows = space.stage(membership(docs, self.model, domains, keep), "members")
        self.cells = space.stage(self.rows.where("n_tokens > 0").groupBy("member").agg(F.sum("n_tokens").alias("tokens")), "cells")

    def shares(self) -> list[float]:
        """Each domain's share of the expected tokens, as the documents are."""
        sums = self.cells.agg(F.sum("tokens"), *(F.sum(F.col("tokens") * F.col("member")[k]) for k in range(len(self.domains)))).first()
        return [x / sums[0] for x in sums[1:]] if sums[0] else [1 / len(self.domains)] * len(self.domains)

    def fit(self, targets: list[float]) -> Rates:
        return fit_rates(self.cells, targets)


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], keep: tuple[str, ...] = (), total_weight: float = 1.0) -> DataFrame:
    """doc_id, the columns in keep, n_tokens, p_<domain> for each domain of targets, and rate, for each row of docs.

    targets: each domain's share of the mixture's expected tokens, in units of the input's tokens, scaled to add up to
    total_weight.  A rate is how often a document is to be drawn: 1 as often as it is, 0 never.  The classifier learns from
    labelled (doc_id, domain; rows with other domains or null ids are not used); with nothing to learn from, memberships are
    even.  Rates are fitted to the whole table: all documents of equal membership count together, as one row with their
    tokens.  Null and empty texts have no tokens and the prior's membership.  Equal texts have equal rates; an empty table
    gives no rows.  Targets that nonnegative rates cannot reach are approached in the sense of least squares.
    """
    domains = sorted(targets)
    mixture = Mixture(docs, labelled, domains, keep)
    rate = mixture.fit([targets[d] * total_weight / sum(targets.values()) for d in domains]).rate()
    return mixture.rows.select("doc_id", *keep, "n_tokens", *(F.col("member")[i].alias(f"p_{d}") for i, d in enumerate(domains)), rate.alias("rate"))


def thinning(docs: DataFrame, labelled: DataFrame, domain: str, share: float | None = None, keep: tuple[str, ...] = ()) -> tuple[Mixture, Rates, float]:
    """Memberships, and the rates that bring one domain's expected tokens to `share` times what they are and leave the others'.

    share None: that part of them which is in documents that belong to the domain by less than a half.  Rates can reach that
    however well words tell domains apart; a smaller share could take documents of the other domains along.
    """
    domains = ["clean", "poor", "toxic"]
    mixture = Mixture(docs, labelled, domains, keep)
    if share is None:
        own = F.col("member")[domains.index(domain)]
        sums = mixture.cells.agg(F.sum(F.when(own < 0.5, F.col("tokens") * own)), F.sum(F.col("tokens") * own)).first()
        share = (sums[0] or 0.0) / sums[1] if sums[1] else 1.0
    return mixture, mixture.fit([s * (share if d == domain else 1.0) for d, s in zip(domains, mixture.shares(), strict=True)]), share


def thinned(docs: DataFrame, labelled: DataFrame, domain: str, share: float | None = None) -> DataFrame:
    """docs drawn by the rates of thinning().

    A row stays if a number in [0, 1) made of its id's and text's hashes is below its rate; rows of rate 1 or more all stay.
    Null and empty texts stay or go by the prior's membership, repeated rows together; an empty table stays empty.
    """
    mixture, rates, _ = thinning(docs, labelled, domain, share, tuple(c for c in docs.columns if c != "doc_id"))
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit(31)), F.lit(1 << 30)) / float(1 << 30)
    return mixture.rows.where(chance < rates.rate()).select(*docs.columns)


def quality_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a table of (doc_id, quality, toxic): toxic, else clean or poor by quality; null labels give none."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain"))
