"""BPE (6) against the tokenizers library, repeated passages (5) against plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from storyloom.llm import bpe, substrings

PATH = bpe.default_path()
LIBRARY = tokenizers.Tokenizer.from_file(PATH)
VOCAB = bpe.Vocabulary(PATH)
PIECES = ["a", "b", "an", "the ", "'s", "'ll", " ", "\n", "\x1c", "\x85", "12", "½", "Ⅷ", "²", "é", "É", "Σ", "ς", "İ", "ı", "日本", "😀", "_", "-!?", "ß", "́",
          "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "aaaaaa", "banana", "ﬁ", "Å", "‍", "ाि", "\xa0", "٣"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_ids_and_text_are_the_librarys(text):
    ids = bpe.Encoder(VOCAB).encode([text])[0]
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want
    assert bpe.decode(ids, VOCAB).decode() == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=6))
def test_any_text_in_one_run_or_many(texts):
    together, small = bpe.Encoder(VOCAB).encode(texts), bpe.Encoder(VOCAB, cache_words=3)
    assert [x.tolist() for x in together] == [small.encode([t])[0].tolist() for t in texts]


def library_rows(docs):
    def row(r):
        ids = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        return r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return Counter(map(row, docs.select("doc_id", "text").collect()))


def test_op6(edges, nothing, small):
    assert Counter(map(tuple, bpe.op6(edges).collect())) == library_rows(edges)
    assert Counter(map(tuple, bpe.op6(small("documents")).collect())) == library_rows(small("documents"))
    assert Counter(map(tuple, bpe.digests(edges, PATH, chunk_chars=10, cache_words=4).collect())) == library_rows(edges)
    assert bpe.op6(nothing).count() == 0


def test_encoded_and_decoded_columns(edges):
    both = bpe.decoded(bpe.encode(edges, ["doc_id"], PATH), PATH).where("doc_id = 6").first()
    want = LIBRARY.encode(edges.where("doc_id = 6").first().text, add_special_tokens=False)
    assert both["ids"] == want.ids and both.decoded == LIBRARY.decode(want.ids, skip_special_tokens=False)


def plain_repeats(rows):
    """Removal by every window of every document."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, words in split:
        for s in range(len(words) - 49) if i is not None else ():
            w = tuple(words[s : s + 50])
            least[w] = min(i, least.get(w, i))
    out = Counter()
    for i, words in split:
        gone = [False] * len(words)
        for s in range(len(words) - 49) if i is not None else ():
            if least[tuple(words[s : s + 50])] < i:
                gone[s : s + 50] = [True] * 50
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out[(i, len(words), sum(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


def passages(seed):
    """Documents of shared passages, cut at random places, some of them in words that repeat."""
    rng = random.Random(seed)
    words = [f"w{n}" for n in range(400)]
    pool = [[rng.choice(words) for _ in range(rng.randint(45, 160))] for _ in range(6)] + [["x"] * 120, ["x", "y"] * 60]
    docs = []
    for i in rng.sample(range(200), 60):
        text = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(pool)
            a = rng.choice((0, 0, rng.randint(0, 40)))
            text += p[a : a + rng.choice((200, rng.randint(40, 90)))] + [rng.choice(words) for _ in range(rng.choice((0, 1, 30)))]
        docs.append((i, " ".join(text)))
    return docs + docs[:3] + [(docs[0][0], docs[5][1]), (None, docs[1][1]), (None, None)]


def test_op5_on_passages(spark):
    for seed in range(3):
        rows = passages(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert Counter(map(tuple, substrings.op5(docs).collect())) == plain_repeats(rows)


def test_op5_on_edges_and_documents(edges, nothing, small):
    for docs in (edges, small("documents")):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        assert Counter(map(tuple, substrings.op5(docs).collect())) == plain_repeats(rows)
    assert substrings.op5(nothing).count() == 0


def test_bounds_are_the_removed_stretches(spark):
    text = " ".join(f"w{n}" for n in range(80))
    docs = spark.createDataFrame([(1, text), (2, "new " + text + " end"), (3, text)], "doc_id long, text string")
    got = {r.doc_id: r.bounds for r in substrings.repeats(docs).collect()}
    assert got == {1: [], 2: [1, 81], 3: [0, 80]}


@settings(max_examples=100, deadline=None)
@given(st.integers(50, 300), st.integers(0, 2**32))
def test_an_anchor_depends_on_its_window_alone(n, seed):
    hashes = np.random.default_rng(seed).integers(0, 2**64, n, np.uint64)
    anchors = substrings.anchors_of(hashes)
    assert len(anchors) == n - 49
    assert all(substrings.anchors_of(hashes[s : s + 50])[0] == anchors[s] for s in range(n - 49))
