import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.llm import mixing, near_copies, quality_rules, simhash
from storyloom.llm.common import read_table, written

MIDDLE = "/root/testdata/sf0.01"


@pytest.mark.filterwarnings("ignore:mixing")
def test_draw_rates_meet_the_shares_within_one(spark):
    rng = np.random.default_rng(7)
    rows = [(n, int(rng.integers(50, 500)), ([0.01, 1e-6, 0.99 - 1e-6] if n % 8 == 0 else [0.999 - 1e-6, 1e-6, 0.001])) for n in range(800)]
    members = spark.createDataFrame(rows, "doc_id long, n_words long, posterior array<double>")
    rates = mixing.fit_draw(members, mixing.TARGETS)
    rated = members.withColumn("rate", rates.column()).collect()
    totals = np.array([[r.rate * r.n_words * p for p in r.posterior] for r in rated]).sum(0)
    assert np.allclose(totals, rates.after) and all(0 <= r.rate <= 1 for r in rated)
    assert min(r.rate for r in rated if r.posterior[0] > 0.9) > 0.99
    assert abs(totals[2] / totals[0] - mixing.TARGETS["toxic"] / mixing.TARGETS["good"]) < 1e-3


def test_a_short_domain_and_a_miss_are_reported(spark):
    kind = "doc_id long, n_words long, posterior array<double>"
    with pytest.warns(UserWarning, match="too few words for the share of junk, toxic"):
        rates = mixing.fit_draw(spark.createDataFrame([(1, 100, [1.0, 0.0, 0.0])], kind), mixing.TARGETS)
    assert rates.steps == []
    with pytest.warns(UserWarning, match="shares missed"):
        rates = mixing.fit_draw(spark.createDataFrame([(n, 100, [1 / 3] * 3) for n in range(5)], kind), mixing.TARGETS)
    assert rates.after[0] >= 0.9 * rates.before[0]


@pytest.mark.filterwarnings("ignore:mixing")
def test_clean_documents_stay_after_near_dedup(spark):
    docs, labels = (read_table(spark, MIDDLE, name) for name in ("documents", "labels"))
    entering = written(near_copies.keep_first(quality_rules.keep_good(docs)))
    clean = entering.join(labels.where("quality = 1 and toxic = 0"), "doc_id").select("doc_id")
    out = written(mixing.drawn(entering, labels).select("doc_id"))
    assert out.join(clean, "doc_id", "left_semi").count() > 0.95 * clean.count() > 0
    members = mixing.posteriors(entering, ["doc_id"], mixing.learn(entering, labels)).join(out, "doc_id", "left_semi")
    words = members.agg(*[F.sum(F.col("n_words") * F.element_at("posterior", d + 1)) for d in range(3)]).first()
    assert abs(words[2] / sum(words) - 0.03 / 0.95) < 0.02


def test_near_copies_of_five_words_go_and_no_others(spark, edges, nothing):
    words = [f"w{n}" for n in range(100)]
    said = lambda *changed: " ".join("other" if n in changed else w for n, w in enumerate(words))
    # One word changed is 5 of 96 shingles; four changed, apart, are 20 of 96 and too many.
    rows = [(1, said()), (2, said(50)), (3, said(99).upper()), (4, said(10, 30, 50, 70)), (5, "short text"), (6, "Short  text"), (7, "short text too"), (7, said(20, 40, 60, 80)), (None, said())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_copies.keep_first(docs)
    assert kept.columns == docs.columns
    assert {tuple(r) for r in kept.collect()} == {rows[n] for n in (0, 3, 4, 6, 7, 8)}
    ids = sorted((r.doc_id for r in near_copies.keep_first(edges).collect() if r.doc_id is not None))
    assert ids == [-3, 1, 4, 5, 6, 7, 9, 11]
    assert near_copies.keep_first(nothing).count() == 0


def test_near_copies_come_by_fingerprint_first(spark, monkeypatch):
    rng = np.random.default_rng(5)
    bits = lambda x: sum(1 << int(b) for b in rng.choice(63, x, replace=False))
    prints = [p ^ bits(k % 5) for k, p in enumerate(int(p) for p in rng.integers(0, 1 << 62, 12) for _ in range(12))]
    found = {(r.a, r.b) for r in near_copies.by_fingerprint(spark.createDataFrame(list(enumerate(prints)), "v long, fp long")).collect()}
    apart = lambda a, b: (prints[a] ^ prints[b]).bit_count()
    assert all(apart(a, b) <= 2 for a, b in found)
    firsts = {p: n for n, p in reversed(list(enumerate(prints)))}
    want = {(firsts[p], n) for n, p in enumerate(prints) if firsts[p] != n}
    for p, n in firsts.items():
        lower = [q for q in firsts if q < p and (p ^ q).bit_count() <= 2]
        want |= {(firsts[min(lower)], n)} if lower else set()
    assert found == want and {apart(a, b) for a, b in found} == {0, 1, 2}

    # The stage searches every distinct text, and a pair below 0.8 is no link, however near its fingerprints.
    words = [f"w{n}" for n in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(words + ["end"])), (3, " ".join(words[::-1])), (4, " ".join(words).upper()), (5, "")]
    searched = []
    monkeypatch.setattr(near_copies, "by_fingerprint", lambda sets: searched.extend(r.v for r in sets.collect()) or sets.crossJoin(sets.select(F.col("v").alias("b"))).where("v < b").selectExpr("v AS a", "b"))
    assert {r.doc_id for r in near_copies.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1, 3, 5}
    assert len(set(searched)) == 3


def test_fingerprint_of_more_shingles_than_a_part(monkeypatch):
    text = " ".join(f"w{n * n % 97}" for n in range(60))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_CHUNK", 7)
    assert simhash.fingerprint(text) == whole
    hashes = np.fromiter(simhash.shingle_hashes(text, 3), np.uint64)
    assert simhash.fingerprint_of(hashes) % (1 << 64) == whole
