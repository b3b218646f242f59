"""Filling fixed-capacity containers with items (problem 7).

First-fit decreasing over a tournament tree of bin capacities, run independently in randomised
groups of documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("tokens", T.LongType()),
        T.StructField("container", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
    ]
)


def byte_tokens(text: Column) -> Column:
    """The size of a text in byte-level tokens: its UTF-8 bytes, none for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, the items in the order given (largest first).

    The tree holds at each node the largest space left in any bin below it; the leftmost bin with
    enough space is found from the root down, in time logarithmic in the number of bins.
    """
    n = len(sizes)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    leaves = 1
    while leaves < max(1, n):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    for i, size in enumerate(sizes.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i] = node - leaves
        offsets[i] = capacity - tree[node]
        tree[node] -= size
        node //= 2
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            most = left if left >= right else right
            if tree[node] == most:
                break
            tree[node] = most
            node //= 2
    return bins, offsets


def pack(documents: DataFrame, capacity: int = 4096, group_docs: int = 20_000, seed: int = 7, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """Where every piece of every document lies: one row per piece.

    A document is one piece unless it is larger than ``capacity``; then it is cut into full pieces
    and a rest, each at a byte offset ``start``.  Null and empty texts have one piece of no tokens.
    Documents are dealt by a seeded hash of their id into as many groups as keep ``group_docs``
    each; only ids and sizes are shuffled, never texts, and no group grows with the corpus.
    """
    sized = documents.select(F.col(identity).cast("long").alias("doc_id"), byte_tokens(F.col(text)).alias("doc_tokens"))
    groups = max(1, -(-documents.count() // group_docs))
    dealt = sized.withColumn("__group", F.pmod(F.xxhash64(F.col("doc_id"), F.col("doc_tokens"), F.lit(seed)), F.lit(groups)))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        ids, size = frame["doc_id"], frame["doc_tokens"].to_numpy(dtype=np.int64)
        pieces = np.maximum(1, -(-size // capacity))
        row = np.repeat(np.arange(len(size)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * capacity
        tokens = np.minimum(size[row] - start, capacity)
        key = ids.fillna(-1).to_numpy(dtype=np.int64)[row]
        order = np.lexsort((piece, key, -tokens))
        bins, offsets = first_fit_decreasing(tokens[order], capacity)
        group = frame["__group"].iat[0]
        return pd.DataFrame(
            {
                "doc_id": ids.iloc[row[order]].array,
                "piece": piece[order].astype(np.int32),
                "start": start[order],
                "tokens": tokens[order],
                "container": [f"{group}-{b}" for b in bins],
                "offset": offsets,
                "doc_tokens": size[row[order]],
            }
        )

    return dealt.groupBy("__group").applyInPandas(fill, PLACED)


def containers(placed: DataFrame, capacity: int = 4096) -> DataFrame:
    """Per container: pieces, tokens and unused space."""
    return placed.groupBy("container").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens"), (F.lit(capacity) - F.sum("tokens")).alias("unused"))


def split_documents(placed: DataFrame) -> DataFrame:
    """``doc_id`` of the documents that no container holds whole, by their second piece."""
    return placed.where("piece = 1").select("doc_id").distinct()
