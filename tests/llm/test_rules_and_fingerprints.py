"""Quality rules (8) and SimHash (7) against plain Python."""

import random
import re
from collections import Counter

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from storyloom.llm import quality_rules, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", "\n", " ", "|", "\x0b", "\x85", "😀", "#x"]), max_size=80).map("".join))
def test_counts_are_those_of_plain_python(text):
    view = quality_rules.View(text)
    assert tuple(getattr(view, c) for c in quality_rules.COUNTS) == base(text)


def test_op8_on_edges(edges):
    rows = quality_rules.op8(edges).collect()
    assert len(rows) == edges.count()
    want = Counter((r.doc_id, *base(r.text)) for r in edges.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_rules_order_by_rejections_for_their_cost():
    rules = (
        quality_rules.Rule("slow", lambda v: sum(range(20_000)) < 0),
        quality_rules.Rule("cheap", lambda v: v.text == "bad"),
    )
    cascade = quality_rules.Cascade(rules, 4)
    assert [cascade.keeps(quality_rules.View(t)) for t in ("bad", "good", "bad", "good")] == [False, True, False, True]
    assert [r.name for r in cascade.rules] == ["cheap", "slow"]
    asked = []
    cascade.rules[1] = quality_rules.Rule("slow", lambda v: bool(asked.append(v.text)))
    assert not cascade.keeps(quality_rules.View("bad")) and not asked
    assert cascade.keeps(quality_rules.View("good")) and asked == ["good"]


def test_verdict_does_not_depend_on_the_sample(small):
    docs = small("documents")
    few, many = (quality_rules.judge(docs, ["doc_id"], sample_docs=n).orderBy("doc_id").collect() for n in (1, 1000))
    assert few == many


def test_keep_good_returns_rows_whole(edges, nothing):
    kept = quality_rules.keep_good(edges)
    assert kept.columns == edges.columns
    assert {r.doc_id for r in kept.collect()} >= {9, 10, None} and quality_rules.keep_good(nothing).count() == 0
    assert quality_rules.op8(nothing).count() == 0


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """Component of each distinct print, by union-find over all pairs."""
    above = {p: p for p in prints}

    def root(p):
        while above[p] != p:
            p = above[p]
        return p

    order = sorted(above)
    for n, a in enumerate(order):
        for b in order[:n]:
            if (a ^ b).bit_count() <= 2:
                above[root(a)] = root(b)
    return {p: root(p) for p in order}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["A", "b", "Éa", "\n", " ", "\x85", "日"]), max_size=60).map("".join))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def check_groups(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    root = plain_groups(set(prints))
    least = {}
    for r, p in zip(rows, prints):
        if r.doc_id is not None:
            least[root[p]] = min(r.doc_id, least.get(root[p], r.doc_id))
    want = Counter((r.doc_id, f"{p:016x}", least.get(root[p])) for r, p in zip(rows, prints))
    assert Counter(map(tuple, simhash.op7(docs).collect())) == want


def test_op7_on_edges_and_documents(edges, nothing, small):
    check_groups(edges)
    check_groups(small("documents"))
    assert simhash.op7(nothing).count() == 0


def test_links_are_all_pairs_within_two_bits(spark):
    rng = random.Random(5)
    prints = set()
    for _ in range(40):
        p = rng.getrandbits(64)
        prints |= {p} | {p ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(12)} | {p ^ 1 << rng.randrange(64)}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    got = [frozenset(r) for r in simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long")).collect()]
    want = {frozenset((signed(a), signed(b))) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= 2}
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(n, n + 1) for n in range(100)] + [(200, n) for n in range(201, 260)] + [(400, 399), (5, 5)]
    got = dict(map(tuple, simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {n: 0 for n in range(101)} | {n: 200 for n in range(200, 260)} | {399: 399, 400: 399}


def test_keep_first_leaves_one_of_each_group(edges):
    kept = simhash.keep_first(edges)
    assert kept.columns == edges.columns
    ids = [r.doc_id for r in kept.collect()]
    firsts = {r.component_id for r in simhash.op7(edges).collect()} - {None}
    assert sorted(i for i in ids if i is not None) == sorted(firsts) and ids.count(None) == 2
