"""Nearest neighbours (2), mixing (3), toxicity (4), quality (10), the pipeline."""

import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from storyloom.llm import bpe, line_crf, mixing, neighbours, quality_rules, secret_scan, toxicity
from storyloom.llm.common import read_table
from storyloom.llm.features import Rows, Weights, keys_of, telling_keys, telling_sample
from tests.llm.conftest import SMALL
from tests.llm.test_similarity_join import plain_classes


def brute(rows, every=100, k=10):
    """Every query against every candidate in plain double arithmetic."""
    sound = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = [float(np.float32(x)) for x in v]
            sound[i] = min(v, sound.get(i, v))
    out = {}
    for q in (i for i in sound if i % every == 0):
        near = []
        for i, v in sound.items():
            if i != q and len(v) == len(sound[q]):
                total = 0.0
                for a, b in zip(v, sound[q]):
                    total += (a - b) * (a - b)
                near.append((float(np.sqrt(total)), i))
        for n, (d, i) in enumerate(sorted(near)[:k]):
            out[(q, n + 1)] = (i, d)
    return out


def found(df):
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in df.collect()}


SHAPES = ({}, {"block_rows": 7, "block_queries": 2, "merge_fan": 2})


@pytest.mark.parametrize("shape", SHAPES)
def test_op2_is_exact_on_ties_and_bad_vectors(spark, shape):
    rng = np.random.default_rng(4)
    points = [rng.normal(size=5).round(1).tolist() for _ in range(20)]
    rows = [(n, points[rng.integers(20)]) for n in range(0, 1000, 9)] + [(100 * n, points[n]) for n in range(6)]
    rows += [(700, None), (800, []), (1100, [0.0] * 5), (1200, [1.0, None, 1.0, 1.0, 1.0]), (1300, [1.0, float("nan"), 0.0, 0.0, 0.0]), (1400, [float("inf")] * 5)]
    rows += [(None, points[0]), (1500, [1.0, 2.0]), (3, [1.0, 2.5]), (1600, [9.0]), (100, points[1]), (100, points[2]), (1700, [1e-30] * 5), (1800, [3e8, -1e8, 0.0, 0.0, 1.0])]
    vectors = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, v string, dim int")
    assert found(neighbours.search(vectors, **shape)) == brute(rows)
    assert neighbours.op2(vectors.where("false")).count() == 0


def test_op2_against_duckdb(small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    want = {(q, n): (i, d) for q, n, i, d in con.execute(neighbours.ORACLE).fetchall()}
    assert found(neighbours.op2(small("embeddings"))) == want


def test_rounding_bounds_hold():
    x = np.random.default_rng(1).normal(size=(50, 3000)) * np.logspace(-6, 6, 50)[:, None]
    whole, scale, square, off = neighbours.rounded(x)
    assert np.allclose(np.linalg.norm(x - whole * scale[:, None], axis=1), off) and np.allclose(square, ((whole * scale[:, None]) ** 2).sum(1))
    assert (neighbours.products(whole, whole) == whole.astype(np.int64) @ whole.astype(np.int64).T).all()


def members(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, n_words long, posterior array<double>")


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(2)
    rows = [(n, int(rng.integers(0, 500)), rng.dirichlet([8, 1, 1] if n % 3 else [1, 6, 3]).tolist()) for n in range(400)]
    for shares, reachable in (
        ({"good": 0.9, "junk": 0.05, "toxic": 0.05}, True),
        ({"good": 0.999, "junk": 0.0005, "toxic": 0.0005}, False),
        ({"good": 0.1, "junk": 0.3, "toxic": 0.6}, True),
    ):
        df = members(spark, rows)
        rates = mixing.fit_rates(df, shares, total=40_000.0)
        rated = df.withColumn("rate", rates.column()).collect()
        assert min(r.rate for r in rated) >= 0
        totals = np.array([[r.rate * r.n_words * p for p in r.posterior] for r in rated]).sum(0)
        assert np.allclose(totals, rates.after)
        # Sixty plain steps with the moments of all documents get no nearer, also where no rates meet the target.
        w, p, r = np.array([x[1] for x in rows], float), np.array([x[2] for x in rows]), np.ones(len(rows))
        second = (w[:, None] * p).T @ p
        miss = lambda x: (x - rates.target) @ np.linalg.solve(second, x - rates.target)
        for _ in range(60):
            r = np.maximum(0, r - p @ np.linalg.solve(second, (r * w) @ p - rates.target))
        assert miss(totals) <= 1.02 * miss((r * w) @ p) + 1e-3
        if reachable:
            assert np.abs(totals - rates.target).max() <= 1e-5 * 40_000
    assert np.abs(mixing.fit_rates(members(spark, rows), {"good": 0.9, "junk": 0.05, "toxic": 0.05}).after[0] - rates.before[0]) < 1


def test_op3(edges, edge_labels, nothing, small):
    rows = mixing.op3(edges, edge_labels).collect()
    assert len(rows) == edges.count() and all(abs(r.p_good + r.p_junk + r.p_toxic - 1) < 1e-9 and r.rate >= 0 for r in rows)
    assert mixing.op3(nothing, edge_labels).count() == 0
    assert {r.p_good for r in mixing.op3(edges, edge_labels.where("false")).collect()} == {1 / 3}
    got = mixing.op3(small("documents"), small("labels")).join(small("labels"), "doc_id").where("n_words > 0")
    good, junk = (got.where(f"quality = {q}").agg(F.avg("p_junk")).first()[0] for q in (1, 0))
    assert good < 0.1 and junk > 0.7


def test_drawn_rows_are_rows(edges, edge_labels, small):
    out = mixing.drawn(edges, edge_labels)
    assert out.columns == edges.columns
    docs = small("documents")
    once, twice = ({r.doc_id for r in mixing.drawn(docs, small("labels")).collect()} for _ in range(2))
    assert once == twice and 0.7 * docs.count() < len(once) <= docs.count()


def test_keys_and_weights_agree():
    texts = ["", "Plain words here", "PLAIN words words ||| ### 12", "ünïcode wörter"]
    kept = np.unique(np.concatenate([keys_of(t) for t in texts[:3]]))
    model = Weights(kept, np.arange(len(kept), dtype=float)[:, None], np.array([0.5]))
    rows = Rows([keys_of(t) for t in texts], kept)
    assert np.allclose(rows.scores(np.arange(len(kept), dtype=float), 0.5), [model.scores(t)[0] for t in texts])
    assert len(telling_keys([[], []])) == 0


def test_corrected_risk_finds_the_words_of_positives():
    rng = np.random.default_rng(3)
    plain = [f"w{n}" for n in range(300)]
    text = lambda bad: " ".join([*rng.choice(plain, 60), *(rng.choice(["vile", "foul", "base"], 2) if bad else [])])
    positive = [keys_of(text(True)) for _ in range(150)]
    unlabelled = [keys_of(text(n % 5 == 0)) for n in range(1000)]
    model = toxicity.train(positive, unlabelled, 0.2)
    assert np.mean([model.scores(text(True))[0] >= 0 for _ in range(100)]) > 0.95
    assert np.mean([model.scores(text(False))[0] >= 0 for _ in range(100)]) < 0.05


def test_risk_and_its_slope_are_the_written_out_ones():
    rng = np.random.default_rng(8)
    score, is_p, prior = rng.normal(size=30) * 2, np.arange(30) < 9, 0.3

    def parts(s):
        loss = lambda x, y: math.log(1 + math.exp(-x if y else x))
        mean = lambda rows, y: sum(loss(x, y) for x in rows) / len(rows)
        return prior * mean(s[:9], True), mean(s[9:], False) - prior * mean(s[:9], False)

    positive, corrected, up, down = toxicity.risk(score, is_p, prior)
    assert np.allclose((positive, corrected), parts(score))
    for k in range(30):
        step = np.zeros(30)
        step[k] = 1e-6
        more, less = parts(score + step), parts(score - step)
        assert np.allclose([up[k], down[k]], [(a - b) / 2e-6 for a, b in zip(more, less)], atol=1e-7)


def test_keys_counted_in_spark_are_the_telling_ones(spark, small):
    docs, labels = small("documents"), small("labels")
    chosen = labels.where("toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("label"))
    kept, one, zero = telling_sample(docs.unionByName(docs), chosen, 1000, 2.0, 3)
    texts = {r.doc_id: r.text for r in docs.collect()}
    groups = [[keys_of(texts[r.doc_id]) for r in sorted(chosen.collect()) if r.label == want] for want in (1, 0)]
    want = telling_keys(groups, 2.0, 3)
    assert len(want) and kept.tolist() == want.tolist()
    for got, group in zip((one, zero), groups, strict=True):
        assert [g.tolist() for g in got] == [np.intersect1d(keys, want).tolist() for keys in group]


def area(score, truth):
    order = np.argsort(np.argsort(score, kind="stable")) + 1
    n = truth.sum()
    return (order[truth == 1].sum() - n * (n + 1) / 2) / (n * (len(truth) - n))


@pytest.mark.parametrize(("operator", "column", "folds", "which", "size", "least"), [(toxicity.op4, "toxic", 5, 0, "sf0.1", 0.94), (line_crf.op10, "quality", 3, 1, "sf0.01", 0.97)])
def test_scores(operator, column, folds, which, size, least, spark, edges, edge_labels, nothing):
    docs, labels = (read_table(spark, f"/root/testdata/{size}", t) for t in ("documents", "labels"))
    got = operator(docs, labels).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % folds == which for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all() and len(got) == docs.count()
    told = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert area(told.score.to_numpy(), told[column].to_numpy()) > least
    for teachers in (edge_labels, edge_labels.where("false")):
        rows = operator(edges, teachers).collect()
        assert len(rows) == edges.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert operator(nothing, edge_labels).count() == 0


def test_marginals_are_those_of_all_labelings():
    rng = np.random.default_rng(6)
    lengths = np.array([1, 4, 2, 4, 3])
    unary, pairs = rng.normal(size=lengths.sum()), rng.normal(size=(2, 2))
    good, two = line_crf.Chains(lengths).marginals(unary, pairs)
    at = 0
    for n in lengths:
        u, weight, mean, both = unary[at : at + n], 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            p = np.exp(sum(u[k] * y[k] for k in range(n)) + sum(pairs[a, b] for a, b in zip(y, y[1:])))
            weight += p
            mean += p * np.array(y)
            for k in range(1, n):
                both[k, y[k - 1], y[k]] += p
        assert np.allclose(good[at : at + n], mean / weight) and np.allclose(two[at + 1 : at + n], both[1:] / weight)
        at += n


def test_run_applies_the_stages(spark, small):
    """The pipeline's rows are those of its stages' rules applied one after another."""
    docs = small("documents")
    kept = [r for r in docs.collect() if not any(rule.rejects(quality_rules.View(r.text)) for rule in quality_rules.RULES)]
    groups = {doc_id: least for doc_id, _, least in plain_classes([(r.doc_id, r.text) for r in kept], 5, 80)}
    firsts = spark.createDataFrame([r for r in kept if groups[r.doc_id] == r.doc_id], docs.schema)
    clean = secret_scan.redacted(firsts)
    drawn = {r.doc_id: r.text for r in mixing.drawn(clean, small("labels")).collect()}
    encoder = bpe.Encoder(bpe.vocabulary(bpe.default_path()))
    got = {r.doc_id: (r.n_tokens, bytes(r.ids)) for r in corpus_pipeline.run(spark, SMALL).collect()}
    want = {i: encoder.encode([t])[0] for i, t in drawn.items()}
    assert got == {i: (len(ids), ids.astype("<u4").tobytes()) for i, ids in want.items()}


def test_stages_return_documents_columns(spark, edges, edge_labels, tmp_path):
    edge_labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (edges, edges.where("false")):
        for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs.write.parquet(f"{tmp_path}/{docs is edges}{n}-{id(docs)}")
            before, docs = docs, stage(spark, spark.read.parquet(f"{tmp_path}/{docs is edges}{n}-{id(docs)}"), str(tmp_path))
            if n < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == before.columns, name
        assert docs.count() >= 0
