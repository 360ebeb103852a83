"""Target-distribution importance resampling by batch concatenation.

A document's features are its runs of ``sizes`` consecutive words, hashed into buckets.  A bucket's gain
says how much likelier it is in the target texts than in the corpus; a document's weight is the floored
mean of its features' gains.  Weight plus keyed Gumbel noise gives the score, and the highest scores are
drawn: sampling without replacement, in proportion to the exponential of the weight.

Features of a batch of texts are found together: the texts are joined by a sentinel that is part of no
word, one pass of a pattern finds all words, the place of each word among the texts' offsets
(``searchsorted``) names its document, and runs that reach into the next document are masked out before
anything is counted.  Each text is split into words once; only its packed buckets are kept and read
again for corpus counts and for weights.  Ranks come from a sort by range over the cluster.

Batches hold about a million characters, or one text that is longer.  A null text counts as empty; an empty text has no
feature and weight 0.  Texts are taken whole.  A null doc_id counts as an empty one in the noise, and comes
last among ties.  Repeated rows are scored and ranked one by one; rows equal in all figures share
their places in any order.  An empty table gives an empty result; without target texts gains fall on
whatever the corpus has.  Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import mapped_texts, numbered, written

#: A word in lower-cased UTF-8: letters a to z, digits, and whatever is not ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SENTINEL = b"\n"
BATCH_CHARS = 1 << 20
#: Words whose hashes a task remembers; it starts anew beyond that.
_MEMO = 400_000


class Setting(NamedTuple):
    """What features are, and how many documents are drawn."""

    sizes: tuple[int, int] = (1, 1)
    n_buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: int = 2024

    @property
    def packed(self) -> np.dtype:
        return np.dtype(np.min_scalar_type(self.n_buckets - 1)).newbyteorder("<")


class Hashed:
    """Finds the bucketed features of batches of texts; remembers the hashes of words."""

    def __init__(self, setting: Setting) -> None:
        self.setting, self.memo = setting, {}

    def _words(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        if len(memo) > _MEMO:
            memo.clear()
        memo.update((w, crc32(w)) for w in set(words) if w not in memo)
        return np.fromiter(map(memo.__getitem__, words), np.uint32, len(words))

    def batch(self, texts: list[str]) -> list[tuple[int, bytes]]:
        """For each text its number of words and its features' buckets, packed."""
        cells = [t.encode().lower() for t in texts]  # of bytes, lower() changes A-Z alone
        offsets = np.cumsum([0, *(len(c) + len(SENTINEL) for c in cells)])
        found = list(_WORD.finditer(SENTINEL.join(cells)))
        words = [m[0] for m in found]
        owner = np.searchsorted(offsets, np.fromiter((m.start() for m in found), np.int64, len(found)), side="right") - 1
        least, most = self.setting.sizes
        codes, owners = [], []
        code = self._words(words)
        for size in range(1, most + 1):
            if size > 1:
                code = np.fromiter(
                    (crc32(b" " + w, c) for w, c in zip(words[size - 1 :], code.tolist(), strict=False)), np.uint32, max(len(words) - size + 1, 0)
                )
            if size >= least:
                inside = owner[: len(code)] == owner[size - 1 :] if size > 1 else slice(None)
                codes.append(code[inside])
                owners.append(owner[: len(code)][inside])
        codes, owners = np.concatenate(codes), np.concatenate(owners)
        if most > least:
            order = np.argsort(owners, kind="stable")
            codes, owners = codes[order], owners[order]
        buckets = (codes % self.setting.n_buckets).astype(self.setting.packed)
        bounds = np.searchsorted(owners, np.arange(len(texts) + 1))
        n_words = np.bincount(owner, minlength=len(texts))
        return [(n, buckets[a:b].tobytes()) for n, a, b in zip(n_words.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def __call__(self, texts: Iterator[str]) -> Iterator[tuple[int, bytes]]:
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= BATCH_CHARS:
                yield from self.batch(held)
                held, size = [], 0
        if held:
            yield from self.batch(held)


def features(docs: DataFrame, keep: list[str], setting: Setting = Setting()) -> DataFrame:
    """``keep`` columns, ``n_words`` and the packed ``buckets`` of every text."""
    return mapped_texts(docs, keep, {"n_words": T.LongType(), "buckets": T.BinaryType()}, lambda: Hashed(setting))


def _views(column: pa.Array, packed: np.dtype) -> list[np.ndarray]:
    return [np.frombuffer(cell.as_buffer(), packed) for cell in column]


def bucket_counts(rows: DataFrame, setting: Setting = Setting()) -> np.ndarray:
    """How many features of all rows fall into each bucket; ``n_buckets`` numbers come to the driver."""
    n, packed = setting.n_buckets, setting.packed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            total += np.bincount(np.concatenate([*_views(batch.column("buckets"), packed), np.zeros(0, packed)]), minlength=n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    counted = rows.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(n, np.int64)
    for row in counted:
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousands of the log ratio of smoothed shares, floored, for each bucket."""
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = lambda s, t: (t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(rows: DataFrame, keep: list[str], gain: np.ndarray, setting: Setting = Setting()) -> DataFrame:
    """``keep`` columns, ``n_words``, ``n_features`` and ``weight``, the floored mean gain of the features."""
    packed = setting.packed
    schema = T.StructType([*(rows.schema[c] for c in [*keep, "n_words"]), T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = _views(batch.column("buckets"), packed)
            n = np.fromiter(map(len, cells), np.int64, len(cells))
            sums = [int(gain[c].sum()) for c in cells]
            mean = [s // k if k else 0 for s, k in zip(sums, n.tolist(), strict=True)]
            own = [batch.column(c) for c in [*keep, "n_words"]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n), pa.array(mean, pa.int64())], names=[*keep, "n_words", "n_features", "weight"])

    return rows.select(*keep, "n_words", "buckets").mapInArrow(run, schema)


def resampled(docs: DataFrame, target: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` of every row; the rank is null if undrawn."""
    keep = ["doc_id", "text_hash"]
    rows = written(features(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), keep, setting))
    gain = gains(bucket_counts(rows, setting), bucket_counts(features(target, [], setting), setting))
    digest = F.sha2(F.concat(F.lit(f"{setting.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    scored = weights(rows, keep, gain, setting).withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform))))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("text_hash")]
    may = F.col("n_words") >= setting.least_words
    scored = written(scored)
    placed = numbered(scored.where(may), "place", *order)
    n_drawn = placed.count() * setting.percent // 100
    placed = placed.withColumn("rank", F.when(F.col("place") < n_drawn, F.col("place") + 1))
    return placed.drop("place").unionByName(scored.where(~may).withColumn("rank", F.lit(None).cast("long")))


def drawn(docs: DataFrame, target: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """The rows of ``docs``, all columns, that are drawn; of rows with equal doc_id and text all stay if one is drawn."""
    chosen = resampled(docs, target, setting).where("rank is not null").select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__own")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__own"))
    return docs.join(chosen, same, "left_semi")


def op11(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resampled(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


# The CRC-32 polynomial, reflected, and its start and end masks.
_CRC = "list_reduce({bytes}, lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)]), 4294967295::BIGINT)"
#: CRC-32 in SQL: the table of single bytes by eight halvings each, then one step a byte.
CRC_STEPS = "(SELECT list(list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS steps FROM range(256) t(n))"


def crc_sql(value: str) -> str:
    """SQL for the CRC-32 of a text's UTF-8, where ``steps`` is in reach."""
    digits = f"hex(encode({value}))"
    each = f"list_transform(range(1, strlen({value}) + 1), lambda i: ('0x' || substr({digits}, 2 * i - 1, 2))::BIGINT)"
    return f"xor({_CRC.format(bytes=each)}, 4294967295::BIGINT)"


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH own AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), aim AS (SELECT {_WORDS} AS w FROM benchmark),
s AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM own) x GROUP BY word), t AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM aim) x GROUP BY word),
coded AS (SELECT word, {crc_sql('word')} % 10000 AS bucket FROM (SELECT word FROM s UNION SELECT word FROM t) x, {CRC_STEPS} y),
counted AS (SELECT bucket, coalesce(sum(s.n), 0) AS s, coalesce(sum(t.n), 0) AS t FROM coded LEFT JOIN s USING (word) LEFT JOIN t USING (word) GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM counted),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM counted, totals),
summed AS (SELECT r, count(*) AS n, sum(gain) AS g FROM (SELECT r, unnest(w) AS word FROM own) x JOIN coded USING (word) JOIN gain USING (bucket) GROUP BY r),
weighed AS (SELECT own.r, doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE floor(g::DOUBLE / n)::BIGINT END AS weight,
  (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296 AS u FROM own LEFT JOIN summed ON summed.r = own.r),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln(u)))::BIGINT AS score FROM weighed),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (r)
"""
