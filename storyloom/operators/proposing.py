"""Deterministic stand-ins for the decisions a model would make.

Similarity is cosine between article vectors and story centroids, token
overlap between names, and exact shingle similarity between texts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions.text import classify_article, is_non_event_type, normalize_event_name
from storyloom.operators.rollups import ago, grouped, story_article_counts
from storyloom.operators.similar import alike_texts
from storyloom.session import cut_lineage, stored
from storyloom.settings import DEFAULTS

#: Bounds of one comparison task: this many centroids against this many vectors.
CENTROIDS_PER_TASK = 20_000
VECTORS_PER_TASK = 100_000


def story_centroids(articles: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Element-wise mean of the article vectors of every story, whatever their length.

    One aggregate with partial sums: a hot story is summed where its articles
    lie, and no vector is unfolded to rows.  Vectors of different lengths in
    one story are an error.
    """
    vectors = embeddings.select(F.col("vec_id").alias("id"), "embedding")
    placed = grouped(articles).select("id", "event_id").join(vectors, "id")
    means = placed.groupBy("event_id").agg(Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>"))).alias("mean"))
    return means.select("event_id", vector_to_array("mean").alias("centroid"))


def _unit(rows: pd.Series) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in rows])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


_BEST = T.StructType([T.StructField("id", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("cosine", T.DoubleType())])


def _best_in_block(vectors: pd.DataFrame, centroids: pd.DataFrame) -> pd.DataFrame:
    """Nearest centroid of every vector of one block, lowest id on ties."""
    if vectors.empty or centroids.empty:
        return pd.DataFrame({"id": [], "event_id": [], "cosine": []}).astype({"id": "int64", "event_id": "int64", "cosine": "float64"})
    centroids = centroids.sort_values("event_id")
    left, right = _unit(vectors["embedding"]), _unit(centroids["centroid"])
    best, score = [], []
    for start in range(0, len(left), 1024):
        cosine = left[start:start + 1024] @ right.T
        pick = cosine.argmax(axis=1)
        best.append(pick)
        score.append(cosine[np.arange(len(pick)), pick])
    return pd.DataFrame({"id": vectors["id"].to_numpy(), "event_id": centroids["event_id"].to_numpy()[np.concatenate(best)], "cosine": np.concatenate(score)})


def nearest_story(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """Exact nearest centroid of every vector (id, embedding).

    Both sides are cut into blocks of bounded size and each block pair is one
    task that returns one row per vector; no list of pairs is ever formed, and
    nothing is broadcast.  Block counts come from measured row counts.
    """
    blocks = max(1, math.ceil(centroids.count() / CENTROIDS_PER_TASK))
    slices = max(1, math.ceil(vectors.count() / VECTORS_PER_TASK))
    block = F.pmod(F.xxhash64("event_id"), F.lit(blocks)).alias("block")
    slice_ = F.pmod(F.xxhash64("id"), F.lit(slices)).alias("slice")
    left = vectors.select("id", "embedding", slice_, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    right = centroids.select("event_id", "centroid", block, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"))
    per_block = left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInPandas(_best_in_block, _BEST)
    return per_block.groupBy("id").agg(F.max(F.struct("cosine", (-F.col("event_id")).alias("order"))).alias("b")).select(
        "id", (-F.col("b.order")).alias("event_id"), F.col("b.cosine").alias("cosine")
    )


def propose_assignments(articles: DataFrame, stories: DataFrame, embeddings: DataFrame, threshold: float = 0.6, exception_articles: int = 3) -> DataFrame:
    """Decisions for ungrouped articles: the nearest open story above the threshold, else none.

    Types that are not news need a story that already has a few articles.
    """
    open_ids = stories.filter(F.col("status").isin("active", "cooling")).select(F.col("id").alias("event_id"))
    centroids = cut_lineage(story_centroids(grouped(articles).join(open_ids, "event_id", "left_semi"), embeddings))
    waiting = articles.filter(F.col("event_id").isNull())
    vectors = cut_lineage(waiting.select("id").join(embeddings.select(F.col("vec_id").alias("id"), "embedding"), "id"))
    nearest = nearest_story(vectors, centroids)
    kind = classify_article(F.col("title"), F.col("rss_description"), F.col("scraped_text_content"))
    facts = waiting.select("id", is_non_event_type(kind).alias("_soft"), F.coalesce("importance_score", F.lit(0.5)).alias("importance_score"))
    sized = nearest.join(story_article_counts(articles), "event_id")
    joined = facts.join(sized, "id", "left")
    fits = F.coalesce((F.col("cosine") >= threshold) & (~F.col("_soft") | (F.col("article_count") >= exception_articles)), F.lit(False))
    return joined.select(
        F.col("id").alias("pos"), F.col("id").alias("article_id"), F.when(fits, "existing").otherwise("uncategorized").alias("decision"),
        F.when(fits, F.col("event_id")).alias("event_id"), F.lit(None).cast("string").alias("event_name"), "importance_score",
        F.coalesce(F.when(fits, F.col("cosine")), F.lit(0.0)).alias("confidence"),
    )


def propose_cooling(stories: DataFrame, now, days: int = DEFAULTS.cooling_after_days) -> DataFrame:
    """Active stories without an article in the last days."""
    quiet = F.coalesce(F.col("last_article_at") < ago(now, days=days), F.lit(True))
    return stories.filter((F.col("status") == "active") & quiet).select(F.col("id").alias("event_id"))


def propose_revivals(articles: DataFrame, stories: DataFrame, embeddings: DataFrame, now, threshold: float = 0.6, revive_days: int = DEFAULTS.revive_window_days, recent_days: int = DEFAULTS.recluster_days) -> DataFrame:
    """Recently archived stories that are nearest to a fresh ungrouped article."""
    asleep = stories.filter((F.col("status") == "archived") & (F.col("archived_at") >= ago(now, days=revive_days))).select(F.col("id").alias("event_id"))
    centroids = cut_lineage(story_centroids(grouped(articles).join(asleep, "event_id", "left_semi"), embeddings))
    fresh = articles.filter(F.col("event_id").isNull() & (F.col("published_date") >= ago(now, days=recent_days))).select("id")
    vectors = cut_lineage(fresh.join(embeddings.select(F.col("vec_id").alias("id"), "embedding"), "id"))
    near = nearest_story(vectors, centroids).filter(F.col("cosine") >= threshold)
    return near.groupBy("event_id").agg(F.count("*").alias("evidence"), F.max("cosine").alias("best_cosine"))


def _cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def propose_duplicates(stories: DataFrame, articles: DataFrame, embeddings: DataFrame, min_confidence: float = DEFAULTS.dedup_confidence) -> DataFrame:
    """Pairs of open stories that look the same: (older_id, newer_id, confidence).

    Names are token sets.  Stories with the same set pair with the oldest of
    them only, so a group of copies gives as many pairs as it has members.
    Different sets pair when their overlap reaches the bound; candidates come
    from prefix filtering: with tokens ordered rare to common, two sets that
    overlap enough share a token among their first few, so common tokens are
    never joined on.  Centroids, where both stories have one, refine the confidence.
    """
    tokens = F.array_sort(F.array_distinct(F.split(normalize_event_name(F.col("name")), " ")))
    open_stories = stories.filter(F.col("status").isin("active", "cooling")).select("id", "created_at", tokens.alias("tokens"))
    groups = open_stories.groupBy("tokens").agg(F.min(F.struct("created_at", "id")).alias("rep"))
    same = open_stories.join(groups, "tokens").filter(F.col("id") != F.col("rep.id")).select(
        F.col("rep.id").alias("older_id"), F.col("id").alias("newer_id"), F.lit(1.0).alias("overlap")
    )
    sets = cut_lineage(groups.select(F.col("rep.id").alias("id"), F.col("rep.created_at").alias("created_at"), "tokens"))
    frequency = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    ordered = sets.select("id", "created_at", "tokens", F.explode("tokens").alias("token")).join(frequency, "token").groupBy("id", "created_at", "tokens").agg(
        F.array_sort(F.collect_list(F.struct("n", "token"))).alias("_o")
    )
    size = F.size("_o")
    prefix = size - F.ceil(size * F.lit(min_confidence) - F.lit(1e-9)) + 1
    prefixes = ordered.select("id", "created_at", "tokens", F.explode(F.slice(F.transform("_o", lambda o: o["token"]), F.lit(1), prefix.cast("int"))).alias("token"))
    left = prefixes.select("token", F.struct("created_at", "id").alias("a"), F.col("tokens").alias("ta"))
    right = prefixes.select("token", F.struct("created_at", "id").alias("b"), F.col("tokens").alias("tb"))
    long_enough = (F.size("ta") >= F.size("tb") * min_confidence) & (F.size("tb") >= F.size("ta") * min_confidence)
    candidates = left.join(right, "token").filter((F.col("a") < F.col("b")) & long_enough).select(
        F.col("a.id").alias("older_id"), F.col("b.id").alias("newer_id"),
        (F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb"))).alias("overlap"),
    ).filter(F.col("overlap") >= min_confidence).distinct()
    pairs = cut_lineage(same.unionByName(candidates))
    named = pairs.select(F.col("older_id").alias("event_id")).unionByName(pairs.select(F.col("newer_id").alias("event_id"))).distinct()
    centroids = story_centroids(grouped(articles).join(named, "event_id", "left_semi"), embeddings)
    scored = (
        pairs.join(centroids.select(F.col("event_id").alias("older_id"), F.col("centroid").alias("_a")), "older_id", "left")
        .join(centroids.select(F.col("event_id").alias("newer_id"), F.col("centroid").alias("_b")), "newer_id", "left")
        .withColumn("cosine", _cosine(F.col("_a"), F.col("_b")))
    )
    confidence = F.when(F.col("cosine").isNull(), F.col("overlap")).otherwise(F.lit(0.7) * F.col("overlap") + F.lit(0.3) * F.col("cosine"))
    return scored.select("older_id", "newer_id", confidence.alias("confidence")).filter(F.col("confidence") >= min_confidence)


# --- alike texts ---------------------------------------------------------------


def propose_new_clusters(articles: DataFrame, percent: int = DEFAULTS.alike_percent) -> DataFrame:
    """Decisions for ungrouped articles: alike texts share a proposed name, others none.

    Alike means a similarity of ``percent`` hundredths or more of their three-word shingles, and groups
    are what such links connect.  The name is the title of the earliest titled article of the group.
    """
    waiting = articles.filter(F.col("event_id").isNull())
    texts = waiting.select("id", F.coalesce("scraped_text_content", F.lit("")).alias("text")).filter(F.col("text") != "")
    roots = stored(alike_texts(texts, percent))
    named = waiting.select("id", "title", "published_date").join(roots, "id")
    titled = F.when(F.coalesce("title", F.lit("")) != "", F.struct(F.coalesce("published_date", F.lit("9999-12-31").cast("timestamp")), F.col("id")))
    groups = named.groupBy("root").agg(F.count("*").alias("size"), F.min_by("title", titled).alias("name"))
    placed = waiting.select("id", F.coalesce("importance_score", F.lit(0.5)).alias("importance_score")).join(roots, "id", "left").join(groups, "root", "left")
    grouped_now = F.coalesce(F.col("size") >= 2, F.lit(False))
    return placed.select(
        F.col("id").alias("pos"), F.col("id").alias("article_id"), F.when(grouped_now, "new").otherwise("uncategorized").alias("decision"),
        F.lit(None).cast("long").alias("event_id"), F.when(grouped_now, F.coalesce("name", F.concat(F.lit("Untitled story "), F.col("root")))).alias("event_name"),
        "importance_score", F.lit(1.0).alias("confidence"), "root",
    )
