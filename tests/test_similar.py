"""Groups of alike texts against all pairs."""

import random

import pytest

from storyloom.operators import similar
from storyloom.operators.proposing import propose_new_clusters


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 3]) for i in range(max(len(words) - 2, 1))}


def brute_groups(texts, percent):
    root = {i: i for i, t in texts if t.split()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {i: shingles(t) for i, t in texts if t.split()}
    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def planted(rng):
    base = [f"b{n}" for n in range(60)]
    texts = [" ".join(base)]
    for k in range(60):
        words = list(base)
        for _ in range(k % 8):
            words[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    chain = [f"c{n}" for n in range(40)]
    for k in range(15):  # each step is alike the next, the ends are not
        chain = chain[4:] + [f"s{k}x{j}" for j in range(4)]
        texts.append(" ".join(chain))
    passages = [" ".join(f"p{k}x{n}" for n in range(12)) for k in range(5)]
    texts += [" ".join(rng.sample(passages, rng.randrange(1, 5))) for _ in range(50)]
    # Weakly alike: a sixth in common with the next, so no group.
    texts += [" ".join(f"w{n}" for n in range(40 * k, 40 * k + 60)) for k in range(10)]
    texts += ["one", "One", "two words", "...", "", *texts[:5]]
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("percent", [50, 80])
def test_groups_are_those_of_all_pairs(spark, percent):
    texts = planted(random.Random(percent))
    frame = spark.createDataFrame(texts, "id long, text string").repartition(4)
    got = {r.id: r.root for r in similar.alike_texts(frame, percent).collect()}
    assert got == brute_groups([(i, t if t != "..." else "") for i, t in texts], percent)


def test_links_met_grow_with_the_group(spark, monkeypatch):
    """An original with many edited copies is met by each copy once, never copy by copy."""
    rng = random.Random(1)
    base = [f"b{n}" for n in range(100)]
    rows = []
    for k in range(300):
        words = list(base)
        for _ in range(1 + k % 5):
            words[rng.randrange(100)] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    frame = spark.createDataFrame([*rows, (300, " ".join(base))], "id long, text string")
    met = []
    verified = similar._verified
    monkeypatch.setattr(similar, "_verified", lambda pairs, *rest: met.append(pairs.count()) or verified(pairs, *rest))
    assert {r.root for r in similar.alike_texts(frame, 50).collect()} == {0}
    assert sum(met) <= 3 * 301


def test_no_text_no_group(spark):
    kind = "id long, event_id long, title string, published_date timestamp, scraped_text_content string, importance_score double"
    assert propose_new_clusters(spark.createDataFrame([], kind)).count() == 0
    rows = propose_new_clusters(spark.createDataFrame([(1, None, None, None, None, None), (2, None, "t", None, "!!", 0.1)], kind)).collect()
    assert {(r.article_id, r.decision, r.root) for r in rows} == {(1, "uncategorized", None), (2, "uncategorized", None)}
