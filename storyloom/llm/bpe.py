"""BPE encoding and decoding by a pair occurrence index.

The distinct words of many documents of a partition lie in one flat array of symbols, linked to their
neighbours within the word.  An index maps each mergeable pair, named by its rank, to all its positions.
The active ranks are taken in ascending order; all positions of a rank merge at once, and only the
lists of the pairs at their edges change.  As words are independent and the smallest rank of all is the
smallest of each word that has it, every word gets its own greedy merges.  A vocabulary in which a
merge could bring up a lower rank than its own is refused when it is read.

A task holds at most ``cache_words`` encoded words and takes the documents in runs of ``chunk_chars``
characters (one document at least), so its memory does not grow with the partition.

Nulls, empty and very long texts: a null text counts as empty and has no tokens.  Texts are encoded
whole.  Repeated rows are encoded one by one, an empty table gives an empty result, and other columns
are not read.  Special tokens are recognised where their strings stand in a text, as the vocabulary says.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import mapped_texts

# Fixed values of the vocabulary file's pre-tokenizer: contractions, letters, one digit, other signs.
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_WORDS = regex.compile(_CONTRACTIONS + r"|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
#: The same on texts of these characters alone, where Python's own module is faster.
_LATIN = "a-zA-Zß-öø-ɏÀ-ÖØ-Þ"
_PLAIN = re.compile(f"[\t-\r -~{_LATIN}]*")
_PLAIN_WORDS = re.compile(f"{_CONTRACTIONS}|[{_LATIN}]+|[0-9]|[^\\s0-9{_LATIN}]+")


def _byte_signs() -> list[str]:
    """The sign that stands for each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in set(printable))}
    return [other.get(b, chr(b)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizers file of the word-end kind."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        self.tokens = [b""] * self.size
        for token, number in [*ids.items(), *self.special.items()]:
            self.tokens[number] = token.encode()
        signs = _byte_signs()
        self.inner = np.array([ids[s] for s in signs], np.int32)
        self.last = np.array([ids[s + end] for s in signs], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        rank_made = dict(zip(made.tolist(), range(len(merges)), strict=True))
        keys = np.array([ids[a] * self.size + ids[b] for a, b in merges], np.int64)
        if len(rank_made) < len(merges) or any(max(rank_made.get(k // self.size, -1), rank_made.get(k % self.size, -1)) > r for r, k in enumerate(keys.tolist())):
            raise ValueError("a merge of this vocabulary brings up a rank below its own")
        self.made, self.left, self.right = made, keys // self.size, keys % self.size
        self.ranks = np.argsort(keys)
        self.keys = keys[self.ranks]
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where no merge takes it."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def split_words(text: str) -> list[str]:
    """The pre-tokens of a text without special tokens: composed, lower case, split."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    text = text.replace("Σ", "σ").lower()  # letter by letter: no form of its own at a word's end
    return (_PLAIN_WORDS if _PLAIN.fullmatch(text) else _WORDS).findall(text)


class PairIndex:
    """Symbols of many words and, for each active rank, the positions of its pair."""

    def __init__(self, words: list[bytes], vocab: Vocabulary) -> None:
        self.vocab = vocab
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        self.symbol = vocab.inner[raw]  # 32 bits each, as are the links
        self.symbol[ends - 1] = vocab.last[raw[ends - 1]]
        n = len(raw)
        self.next = np.arange(1, n + 1, dtype=np.int32)
        self.next[ends - 1] = -1
        self.before = np.arange(-1, n - 1, dtype=np.int32)
        self.before[0] = -1
        self.before[ends[:-1]] = -1
        self.ends = ends
        self.at: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self.note(np.flatnonzero(self.next >= 0))

    def note(self, positions: np.ndarray) -> None:
        """Enter the pairs that start at ``positions`` under their ranks."""
        rank = self.vocab.rank_of(self.symbol[positions], self.symbol[self.next[positions]])
        found = np.flatnonzero(rank >= 0)
        if not len(found):
            return
        found = found[np.argsort(rank[found], kind="stable")]
        rank, positions = rank[found], positions[found]
        edges = np.flatnonzero(np.diff(rank)) + 1
        for r, part in zip(rank[np.concatenate(([0], edges))].tolist(), np.split(positions, edges), strict=True):
            if r in self.at:
                self.at[r].append(part)
            else:
                self.at[r] = [part]
                heapq.heappush(self.active, r)

    def merge_all(self) -> tuple[np.ndarray, np.ndarray]:
        """The symbols left when no pair is mergeable, and how many each word has."""
        symbol, after, before = self.symbol, self.next, self.before
        while self.active:
            r = heapq.heappop(self.active)
            lists = self.at.pop(r)
            p = np.unique(np.concatenate(lists))
            left, right = self.vocab.left[r], self.vocab.right[r]
            q = after[p]
            valid = (symbol[p] == left) & (q >= 0)
            valid &= symbol[q] == right
            p = p[valid]
            if left == right:
                p = self.apart(p)
            if not len(p):
                continue
            q = after[p]
            symbol[p], symbol[q] = self.vocab.made[r], -1
            follow = after[q]
            after[p] = follow
            linked = follow >= 0
            before[follow[linked]] = p[linked]
            back = before[p]
            self.note(np.concatenate((back[back >= 0], p[linked])))
        left_over = symbol >= 0
        return symbol[left_over], np.diff(np.cumsum(left_over)[self.ends - 1], prepend=0)

    def apart(self, p: np.ndarray) -> np.ndarray:
        """Of positions of a pair of equal symbols, those that greedy merging from the left takes."""
        taken, last = [], -1
        for here, there in zip(p.tolist(), self.next[p].tolist(), strict=True):
            if here != last:
                taken.append(here)
                last = there
        return np.array(taken, np.int64)


class Encoder:
    """Encodes runs of texts; words stay known from one run to the next, up to ``cache_words``."""

    def __init__(self, vocab: Vocabulary, cache_words: int = 400_000) -> None:
        self.vocab, self.cache_words = vocab, cache_words
        self.forget()

    def forget(self) -> None:
        self.number: dict = {(s,): n for n, s in enumerate(self.vocab.special)}
        self.ids = np.array(list(self.vocab.special.values()), np.uint32)
        self.count = np.ones(len(self.ids), np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids, unsigned 32-bit, of each text."""
        if len(self.number) > self.cache_words:
            self.forget()
        number, known = self.number, len(self.number)
        documents = [self._words(text) for text in texts]
        if len(number) > known:
            fresh = [w.encode() for w in list(number)[known:]]
            ids, count = PairIndex(fresh, self.vocab).merge_all()
            self.ids = np.concatenate((self.ids, ids.astype(np.uint32)))
            self.count = np.concatenate((self.count, count))
        start = np.cumsum(self.count) - self.count
        made = []
        for words in documents:
            count = self.count[words]
            shift = start[words] - (np.cumsum(count) - count)
            made.append(self.ids[np.repeat(shift, count) + np.arange(int(count.sum()))])
        return made

    def _words(self, text: str) -> np.ndarray:
        number = self.number
        pieces = self.vocab.splitter.split(text) if self.vocab.splitter else [text]
        words: list[int] = []
        for n, piece in enumerate(pieces):
            if n % 2:
                words.append(number[(piece,)])
            else:
                words += [number.setdefault(w, len(number)) for w in split_words(piece)]
        return np.array(words, np.int32)


def decode(ids: np.ndarray, vocab: Vocabulary) -> bytes:
    """UTF-8 of the tokens joined by spaces, as a vocabulary without decoder has it; unknown ids give nothing."""
    tokens = vocab.tokens
    return b" ".join([tokens[i] for i in ids.tolist() if i < vocab.size])


def _runs(texts: Iterator[str], chars: int) -> Iterator[list[str]]:
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > chars:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def _mapped(docs: DataFrame, keep: list[str], path: str, columns: dict[str, T.DataType], row: Callable, chunk_chars: int, cache_words: int) -> DataFrame:
    def start() -> Callable[[Iterator[str]], Iterator[tuple]]:
        vocab = vocabulary(path)
        encoder = Encoder(vocab, cache_words)

        def each(texts: Iterator[str]) -> Iterator[tuple]:
            for run in _runs(texts, chunk_chars):
                for ids in encoder.encode(run):
                    yield row(ids, vocab)

        return each

    return mapped_texts(docs, keep, columns, start)


def encode(docs: DataFrame, keep: list[str], path: str, chunk_chars: int = 3_000_000, cache_words: int = 400_000) -> DataFrame:
    """``keep`` columns and ``ids``, the tokens of each text."""
    columns = {"ids": T.ArrayType(T.IntegerType())}
    return _mapped(docs, keep, path, columns, lambda ids, vocab: (ids.astype(np.int32),), chunk_chars, cache_words)


def packed(docs: DataFrame, keep: list[str], path: str, chunk_chars: int = 3_000_000, cache_words: int = 400_000) -> DataFrame:
    """``keep`` columns, ``n_tokens`` and ``ids`` as training readers take them: little-endian unsigned 32-bit numbers."""
    columns = {"n_tokens": T.LongType(), "ids": T.BinaryType()}
    return _mapped(docs, keep, path, columns, lambda ids, vocab: (len(ids), ids.astype("<u4").tobytes()), chunk_chars, cache_words)


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` with ``ids`` and, as ``decoded``, their text."""

    @F.pandas_udf("string")
    def to_text(ids):
        vocab = vocabulary(path)
        return ids.map(lambda i: None if i is None else decode(i, vocab).decode())

    return tokens.withColumn("decoded", to_text("ids"))


def digests(docs: DataFrame, path: str, chunk_chars: int = 3_000_000, cache_words: int = 400_000) -> DataFrame:
    """``doc_id``, the number of tokens, and SHA-256 of the ids and of the text decoded from them."""
    columns = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}

    def row(ids: np.ndarray, vocab: Vocabulary) -> tuple:
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decode(ids, vocab)).hexdigest()

    return _mapped(docs, ["doc_id"], path, columns, row, chunk_chars, cache_words)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6(docs: DataFrame) -> DataFrame:
    return digests(docs, default_path())
