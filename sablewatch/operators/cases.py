"""Past cases: appending to the corpus and exact nearest-neighbour search."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Query vectors and corpus rows of a block.
MAX_QUERIES, BLOCK_ROWS = 4096, 100_000


def case_text(title: Column, description: Column) -> Column:
    return F.concat_ws(" ", title, description)


def append_cases(corpus: DataFrame | None, new: DataFrame, keep: str = "first") -> DataFrame:
    """Corpus after adding ``new`` rows ``(case_id, ..., stored_at)``.

    An id that is already stored keeps its stored row; ``keep="latest"`` lets the newest
    row of an id win instead.
    """
    payload = F.struct(*[c for c in new.columns if c != "case_id"])
    if keep == "latest":
        rows = new if corpus is None else corpus.unionByName(new)
        pick = F.max_by(payload, "stored_at")
    else:
        rows = new if corpus is None else new.join(corpus.select("case_id"), "case_id", "left_anti")
        pick = F.min_by(payload, "stored_at")
    merged = rows.groupBy("case_id").agg(pick.alias("c")).select("case_id", "c.*")
    return merged if corpus is None or keep == "latest" else corpus.unionByName(merged.select(*corpus.columns))


def _distances(vectors: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Rows: queries, columns: vectors. Differences are formed before squaring."""
    if metric == "cosine":
        # A zero vector has no direction: its distance to anything is 1.
        a, b = (x / np.where(n > 0, n, 1.0) for x in (queries, vectors) for n in [np.linalg.norm(x, axis=1, keepdims=True)])
        return np.nan_to_num(1.0 - a @ b.T, nan=np.inf)
    return np.stack([np.sqrt(((vectors - q) ** 2).sum(axis=1)) for q in queries])


def _best(ids: np.ndarray, distances: np.ndarray, k: int) -> np.ndarray:
    if len(ids) > k:
        # Everything tied with the k-th distance stays in until ids break the tie.
        limit = np.partition(distances, k - 1)[k - 1]
        near = np.flatnonzero(distances <= limit)
    else:
        near = np.arange(len(ids))
    return near[np.lexsort((ids[near], distances[near]))][:k]


def _search(query_ids: list, query_vectors: np.ndarray, k: int, metric: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, dtype="int64"), np.empty(0)) for _ in query_ids]
        for pdf in batches:
            if pdf.empty:
                continue
            vectors = np.stack(pdf["embedding"].to_numpy()).astype("float64")
            ids = pdf["case_id"].to_numpy()
            for i, row in enumerate(_distances(vectors, query_vectors, metric)):
                all_ids, all_d = np.concatenate([kept[i][0], ids]), np.concatenate([kept[i][1], row])
                best = _best(all_ids, all_d, k)
                kept[i] = (all_ids[best], all_d[best])
        for query_id, (ids, distances) in zip(query_ids, kept):
            if len(ids):
                yield pd.DataFrame({"query_id": query_id, "case_id": ids, "distance": distances})

    return run


def _search_blocks(k: int, metric: str):
    def run(corpus: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if corpus.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "case_id": [], "distance": []})
        vectors = np.stack(queries["embedding"].to_numpy()).astype("float64")
        return pd.concat(_search(list(queries["query_id"]), vectors, k, metric)(iter([corpus])))

    return run


def nearest_cases(
    corpus: DataFrame, queries: DataFrame, k: int = 5, metric: str = "l2", where: Column | None = None,
    max_queries: int = MAX_QUERIES,
) -> DataFrame:
    """The k nearest corpus rows of each query, ties by id: exact.

    ``corpus`` has ``(case_id bigint, embedding)``, ``queries`` ``(query_id bigint, embedding)``;
    ``where`` filters the corpus first. Blocks of queries meet blocks of the corpus, each pair
    in one task that keeps k rows per query; nothing is collected, whatever the number of
    queries. Cosine takes the distance of a zero vector to any other as 1.
    """
    if where is not None:
        corpus = corpus.filter(where)
    out = "query_id long, case_id long, distance double"
    query_blocks = max(1, math.ceil(queries.count() / max_queries))
    corpus_blocks = max(1, math.ceil(corpus.count() / BLOCK_ROWS))
    blocks = ["query_block", "corpus_block"]
    spread = corpus.select(
        "case_id", "embedding", F.pmod(F.xxhash64("case_id"), F.lit(corpus_blocks)).alias("corpus_block"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"),
    ).withColumn("query_block", F.col("query_block").cast("long"))
    asked = queries.select(
        "query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).alias("query_block"),
        F.explode(F.sequence(F.lit(0), F.lit(corpus_blocks - 1))).alias("corpus_block"),
    ).withColumn("corpus_block", F.col("corpus_block").cast("long"))
    local = spread.groupBy(*blocks).cogroup(asked.groupBy(*blocks)).applyInPandas(_search_blocks(k, metric), out)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "case_id"))
    return local.withColumn("rank", rank).filter(F.col("rank") <= k)


def with_case(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """Search results with the stored columns of their cases (one row per ``case_id``)."""
    return found.join(corpus, "case_id")


def label_centroids(cases: DataFrame) -> DataFrame:
    """Mean vector per label, as query vectors: averages per label and position."""
    flat = cases.select("label", F.posexplode("embedding").alias("pos", "x"))
    means = flat.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vector = F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"])
    return means.groupBy("label").agg(vector.alias("embedding")).select(
        F.col("label").cast("long").alias("query_id"), "embedding"
    )
