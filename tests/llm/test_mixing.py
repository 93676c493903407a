import random

import numpy as np
from polyagg.llm.mixing import fit_rates, in_steps, mix, quality_domains
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"
TARGETS = {"clean": 0.8, "poor": 0.15, "toxic": 0.05}


def test_totals_meet_targets(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), quality_domains(spark.read.parquet(f"{SF}/labels.parquet"))
    out = mix(docs, labels, TARGETS).join(labels, "doc_id", "left").collect()
    assert len(out) == docs.count()
    total = sum(r.n_tokens for r in out)
    assert min(r.rate for r in out) >= 0
    for d, w in TARGETS.items():
        share = sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in out) / total
        assert abs(share - w) < 0.01, (d, share)
    assert all(abs(r.p_clean + r.p_poor + r.p_toxic - 1) < 1e-9 for r in out)
    known = [r for r in out if r.domain]
    right = [max(TARGETS, key=lambda d: r[f"p_{d}"]) == r.domain for r in known]
    assert np.mean(right) > max(np.mean([r.domain == d for r in known]) for d in TARGETS) - 0.02
    mean = {d: np.mean([r[f"p_{d}"] for r in known if r.domain == d]) - np.mean([r[f"p_{d}"] for r in known if r.domain != d]) for d in TARGETS}
    assert mean["toxic"] > 0.1, mean


def brute(member, tokens, targets, ridge):
    share = tokens / tokens.sum()
    r = np.ones(len(tokens))
    g = (member * share[:, None]).T @ member / np.sqrt(np.outer(targets, targets))
    step = 1 / (np.linalg.eigvalsh(g).max() + ridge)
    for _ in range(200_000):
        new = np.maximum(0, r - step * (member @ (((r * share) @ member - targets) / targets) + ridge * (r - 1)))
        if np.abs(new - r).max() < 1e-12:
            break
        r = new
    return r


def test_rates_against_plain_descent(spark):
    rng = np.random.default_rng(1)
    member = rng.dirichlet([1.0, 0.7, 0.4], 200)
    tokens = rng.integers(1, 1000, 200).astype(float)
    cells = spark.createDataFrame([(m.tolist(), float(t)) for m, t in zip(member, tokens)], "member array<double>, tokens double")
    for targets in ([0.2, 0.2, 0.6], [0.5, 0.45, 0.05]):
        rates = fit_rates(cells, targets, ridge=0.02, tolerance=1e-7, most=150)
        got = np.array([r[0] for r in cells.select(rates.rate()).collect()])
        assert np.abs(got - brute(member, tokens, np.array(targets), 0.02)).max() < 0.02


def test_defaults_settle(spark):
    """Weakly separated memberships with a target that they hardly reach."""
    rng = np.random.default_rng(2)
    member = rng.dirichlet([40.0, 6.0, 4.0], 300)
    tokens = rng.integers(1, 1000, 300).astype(float)
    cells = spark.createDataFrame([(m.tolist(), float(t)) for m, t in zip(member, tokens)], "member array<double>, tokens double")
    now = (tokens[:, None] * member).sum(0) / tokens.sum()
    for targets in (now * [1, 1, 0.2], np.array([0.8, 0.15, 0.05])):
        got = np.array([r[0] for r in cells.select(fit_rates(cells, targets.tolist()).rate()).collect()])
        error = ((got * tokens) @ member / tokens.sum() - targets) / targets
        # at the least value each rate is the one that the errors call for
        assert np.abs(got - np.maximum(0, 1 - member @ error / 0.001)).max() < 0.01, error
        assert np.abs(got - brute(member, tokens, targets, 0.001)).max() < 0.02


def test_steps_favour_no_domain(spark):
    rng = np.random.default_rng(4)
    exact = np.concatenate([[[1.0, 0.0, 0.0], [0.9988, 0.0006, 0.0006], [1 / 3] * 3], rng.dirichlet([3.0, 0.5, 0.2], 2000)])
    df = spark.createDataFrame([(e.tolist(),) for e in exact], "e array<double>")
    got = np.array([r[0] for r in df.select(F.expr(in_steps("e"))).collect()])
    assert (got[:2] == [1, 0, 0]).all() and (got.sum(1) == 1).all() and (got * 256 % 1 == 0).all()
    assert np.abs(got - exact).max() < 1 / 256 and np.abs((got - exact).mean(0)).max() < 0.0005


def test_odd_rows(spark):
    schema = "doc_id long, text string, rate string"
    none = spark.createDataFrame([], "doc_id long, domain string")
    assert mix(spark.createDataFrame([], schema), none, TARGETS).collect() == []
    rng = random.Random(1)
    rows = [(None, "idiot", "x"), (1, None, "x"), (2, "", "x"), (3, "a b " * 30_000, "x"), (3, "a b", "x"), (3, "a b", "x")]
    out = mix(spark.createDataFrame(rows, schema), none, TARGETS).collect()
    assert len(out) == 6 and all(np.isclose(r.p_clean, 85 / 256) for r in out)
    rows += [(i, " ".join(rng.choice("pqrs" if i % 2 else "tuvw") for _ in range(20)), "x") for i in range(10, 210)]
    labels = spark.createDataFrame([(i, "clean" if i % 2 else "toxic") for i in range(10, 210)] + [(None, "toxic"), (11, "other"), (1, "poor")], "doc_id long, domain string")
    out = {r.doc_id: r for r in mix(spark.createDataFrame(rows, schema), labels, TARGETS).collect()}
    assert np.mean([out[i].p_clean > out[i].p_toxic for i in range(11, 210, 2)]) == 1
    assert np.mean([out[i].p_clean < out[i].p_toxic for i in range(10, 210, 2)]) == 1
    assert out[11].rate > out[10].rate


def test_domains(spark):
    df = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 0, 0), (4, None, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    assert [r.domain for r in quality_domains(df).orderBy("doc_id").collect()] == ["clean", "toxic", "poor", None, None]
    assert df.select(F.count("*")).first()[0] == 5
