import math
import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from storyloom.llm import importance, prefix_trie
from storyloom.llm.common import numbered
from storyloom.llm.importance import Hashed, Setting
from tests.llm.conftest import EDGES


def plain_features(text, sizes=(1, 1)):
    words = []
    for c in (text or "").translate({n: n + 32 for n in range(65, 91)}):
        wordy = c in "0123456789abcdefghijklmnopqrstuvwxyz" or ord(c) > 127
        if wordy and words and words[-1] is not None:
            words[-1] += c
        elif wordy:
            words[-1:] = [c] if words else []
            words = words or [c]
        elif words and words[-1] is not None:
            words.append(None)
    words = [w for w in words if w is not None]
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) for n in range(sizes[0], sizes[1] + 1) for i in range(len(words) - n + 1)], len(words)


TEXTS = ["", "One two THREE", "three", " !? ", "é\x7fÜ zwei--drei 4four", "a b c d e f", "a", "日本 語", "x" * 9]


@pytest.mark.parametrize("sizes", [(1, 1), (1, 3), (2, 2)])
def test_runs_stay_inside_their_text(sizes):
    setting = Setting(sizes=sizes, n_buckets=1 << 16)
    got = Hashed(setting).batch(TEXTS)
    for text, (n_words, packed) in zip(TEXTS, got, strict=True):
        want, n = plain_features(text, sizes)
        buckets = sorted(int.from_bytes(packed[i : i + 2], "little") for i in range(0, len(packed), 2))
        assert (n_words, buckets) == (n, sorted(w % (1 << 16) for w in want))


def test_batches_do_not_change_rows(monkeypatch):
    one = list(Hashed(Setting())(iter(TEXTS)))
    monkeypatch.setattr(importance, "BATCH_CHARS", 5)
    monkeypatch.setattr(importance, "_MEMO", 2)
    assert one == list(Hashed(Setting())(iter(TEXTS)))


def plain_resampled(docs, target, n=10_000):
    count = lambda texts: [b := [0] * n, [b.__setitem__(f % n, b[f % n] + 1) for t in texts for f in plain_features(t)[0]]][0]
    s, t = count([d[1] for d in docs]), count(target)
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + n) / ((x + 1) * (sum(t) + n)))) for x, y in zip(s, t)]
    rows = []
    for doc_id, text in docs:
        own, words = plain_features(text)
        weight = sum(gain[f % n] for f in own) // len(own) if own else 0
        h = int(sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, row in enumerate(able[: len(able) // 10]):
        row[4] = k + 1
    return [tuple(r[:5]) for r in rows]


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_op11_on_edges(spark, edges, nothing):
    rng = random.Random(4)
    docs = [(i, t) for i, t in EDGES] + [(1000 + i // 2, " ".join(rng.choice("alpha beta gamma delta Ünd 12 x".split()) for _ in range(rng.randrange(60)))) for i in range(120)]
    target = ["alpha alpha ünd", None, "", "gamma ... delta"]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("x")).withColumn("score", F.lit("y"))
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    assert in_order(importance.op11(frame.repartition(5), aim).collect()) == in_order(plain_resampled(docs, target))
    assert importance.op11(nothing, aim).count() == 0
    assert importance.op11(edges, aim.where("false")).count() == edges.count()
    kept = importance.drawn(frame, aim)
    chosen = {d for d, r in zip(docs, plain_resampled(docs, target), strict=True) if r[4] is not None}
    assert kept.columns == frame.columns and in_order(kept.select("doc_id", "text").collect()) == in_order(d for d in docs if d in chosen)


def test_places_are_those_of_one_sort(spark):
    rows = [(k % 7, k) for k in range(1000)] + [(None, -1)]
    placed = numbered(spark.createDataFrame(rows, "a long, b long").repartition(9), "place", F.col("a").asc_nulls_first(), F.col("b").desc())
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -r[1]))
    assert [r[:2] for r in sorted(placed.collect(), key=lambda r: r.place)] == want
    assert sorted(r.place for r in placed.collect()) == list(range(1001))


def plain_trie(turns):
    own = {}
    for conv, turn, role, text in turns:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, prefix_key(role, text), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    members, kids, at_end = {}, {}, {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
            if d:
                kids.setdefault(tuple(v[: d - 1]), set()).add(tuple(v[:d]))
        at_end.setdefault(tuple(v), []).append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own_saved = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        leaves[node] = sum(leaves[k] for k in kids.get(node, ())) or 1
        saved[node] = own_saved + sum(saved[k] for k in kids.get(node, ()))
    return [
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, ())), leaves[k], saved[k], sha256(",".join(map(str, sorted(at_end.get(k, ())))).encode()).hexdigest())
        for k, m in members.items()
    ]


def prefix_key(role, text):
    role, text = role or "", text or ""
    return sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


@pytest.mark.parametrize(("height", "piece", "block"), [(32, 12, 16), (2, 2, 3), (3, 1, 2)])
def test_op13_is_the_plain_trie(spark, monkeypatch, height, piece, block):
    for name, value in (("HEIGHT", height), ("PIECE", piece), ("BLOCK", block)):
        monkeypatch.setattr(prefix_trie, name, value)
    rng = random.Random(5)
    say = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["yes", "no", "", None, "ünd 😀"]))
    turns = [(c, t, *say()) for c in [*range(40), *range(95, 130), 700, -3, -250] for t in range(rng.randrange(1, 9))]
    turns += [(200 + k, t, "user", "same" + str(t % 3)) for k in range(20) for t in range(3 + 4 * (k % 6))]
    turns += [(300, t, "user", "long") for t in range(70)] + [(301, None, "user", "first"), (301, 1, "a", "b"), (301, 1, "a", "b"), (301, 1, "a", "c")]
    turns += [(None, 1, "user", "nobody's"), (302, 0, None, None)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("x")).repartition(6)
    assert in_order(prefix_trie.op13(frame).collect()) == in_order(plain_trie(turns))


def test_op13_of_nothing(spark):
    assert prefix_trie.op13(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
