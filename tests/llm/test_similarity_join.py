import random

import pytest
from pyspark.sql import functions as F

from storyloom.llm import jaccard_join, near_copies
from storyloom.llm.jaccard_join import Setting
from tests.llm.conftest import EDGES


def plain_set(text, size):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, min(len(words), 1)))}


def plain_classes(docs, size, percent):
    """For each row its number of shingles and class, by comparing all pairs."""
    sets = [plain_set(t, size) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    least = {}
    for k, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[find(k)] = min(least.get(find(k), doc_id), doc_id)
    return [(i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(docs, sets, strict=True))]


def edited(rng, words, times):
    out = list(words)
    for _ in range(times):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def planted(rng):
    """An original with edited copies of many degrees, copies of a copy, a chain of small steps, texts of common passages, and short ones."""
    base = [f"b{n}" for n in range(120)]
    texts = [" ".join(base)] + [edited(rng, base, k % 7) for k in range(140)]
    second = edited(rng, base, 6).split()  # an original of its own, with what base lacks
    texts += [edited(rng, second, k % 4) for k in range(40)] + [" ".join(base[: -k]) for k in range(1, 30)]
    step = [f"c{n}" for n in range(100)]
    for k in range(40):
        step[(7 * k) % 100] = f"s{k}"
        texts.append(" ".join(step))
    passages = [" ".join(f"p{k}x{n}" for n in range(20)) for k in range(6)]
    texts += [" ".join(rng.sample(passages, rng.randrange(1, 6))) for _ in range(120)]
    texts += [" ".join(rng.choice("a b c".split()) for _ in range(rng.randrange(1, 7))) for _ in range(60)] + texts[:20] + ["", None, " "]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_classes_are_those_of_all_pairs(spark, size, percent):
    docs = planted(random.Random(size))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert in_order(jaccard_join.op12(frame, Setting(size, percent)).collect()) == in_order(plain_classes(docs, size, percent))


def test_op12_on_edges(spark, edges, nothing):
    assert in_order(jaccard_join.op12(edges).collect()) == in_order(plain_classes(EDGES, 3, 90))
    assert jaccard_join.op12(nothing).count() == 0


def test_op12_on_the_small_documents(small):
    docs = [(r.doc_id, r.text) for r in small("documents").collect()]
    assert in_order(jaccard_join.op12(small("documents")).collect()) == in_order(plain_classes(docs, 3, 90))


def test_near_copies_keep_the_first_of_each_class(spark):
    docs = planted(random.Random(9)) + [(None, "a text without an id and five words"), (None, "a text without an id and five words")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("__hash", F.lit("mine")).withColumn("root", F.lit("r"))
    kept = near_copies.keep_first(frame)
    assert kept.columns == frame.columns and {r["__hash"] for r in kept.select("__hash").collect()} == {"mine"}
    want = sorted({c for (i, t), (_, n, c) in zip(docs, plain_classes(docs, 5, 80), strict=True) if n and i is not None} | {min(i for i, t in docs if i is not None and not (t or "").strip())})
    got = kept.collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == want
    assert sum(r.doc_id is None for r in got) == 2


def test_the_rounds_stay_linear_in_a_group_of_edited_copies(spark, monkeypatch):
    """Pairs met in a group grow with its members, not with their square."""
    rng = random.Random(2)
    base = [f"b{n}" for n in range(200)]
    docs = [(k, edited(rng, base, 1 + k % 4)) for k in range(1, 400)] + [(400, " ".join(base))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    met, whole = [], jaccard_join.compared
    monkeypatch.setattr(jaccard_join, "compared", lambda pairs, sets: met.append(pairs.count()) or whole(pairs, sets))
    got = jaccard_join.op12(frame, Setting(5, 80)).collect()
    assert {r.component_id for r in got} == {1} and sum(met) <= 3 * len(docs)
