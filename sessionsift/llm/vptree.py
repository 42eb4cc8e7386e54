"""Nearest neighbours by inner product: vantage-point trees per shard.

The largest inner product is the smallest Euclidean distance once each vector x is given one more component
sqrt(M^2 - |x|^2), with M the largest norm, and each query q a zero there: |q - x|^2 = |q|^2 + M^2 - 2 q.x.
Distances then obey the triangle inequality whatever the vectors' lengths, and so do the trees.

A shard's tree splits its vectors at the median distance from a vantage point until ``leaf`` vectors are
left.  A query at distance d from a vantage point needs the inner ball (radius m) only if d - m <= r / factor'
and the rest only if m - d <= r / factor', where r is its k-th smallest distance so far.  ``factor`` is at
least one: it shrinks the radius that a subtree must come into, so one gives the exact result and larger
ones look at fewer subtrees.  Queries go down together, the nearer half first, and distances are taken in
blocks.

Scale: vectors are dealt to shards of about ``shard_rows`` rows by a hash of their id; queries are dealt in
blocks of ``query_block``; each (shard, block) pair is one task's work and gives k candidates a query, which
are merged by rank.  Queries are a stated set, searched against every row in blocks, so no pair of vectors
outside a (shard, block) pair is ever formed.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, as candidate or as query; equal scores go to the smaller id; fewer candidates than
k give all of them; repeated ids are rows of their own; rows with a null id take no part; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionsift.llm.common import staged

LEAF = 256


class VPTree:
    """Arrays of a tree over the rows of ``x`` (augmented vectors)."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, seed: int = 42):
        self.x, self.order = x, np.arange(len(x))
        self.nodes: list[tuple] = []  # (vantage row, radius, inner node, outer node) or (begin, end)
        rng = np.random.default_rng(seed)
        self.root = self._build(0, len(x), leaf, rng)

    def _build(self, a: int, b: int, leaf: int, rng: np.random.Generator) -> int:
        own = self.order[a:b]
        if b - a <= leaf:
            self.nodes.append((a, b))
            return len(self.nodes) - 1
        spot = self.x[own[rng.integers(len(own))]]
        d = np.linalg.norm(self.x[own] - spot, axis=1)
        half = (b - a) // 2
        split = np.argpartition(d, half)
        self.order[a:b] = own[split]
        radius = float(d[split[half]])
        inner, outer = self._build(a, a + half, leaf, rng), self._build(a + half, b, leaf, rng)
        self.nodes.append((spot, radius, inner, outer))
        return len(self.nodes) - 1

    def search(self, queries: np.ndarray, k: int, factor: float) -> list[np.ndarray]:
        """For each query rows that hold its k nearest (with ties), exactly if ``factor`` is one."""
        best = np.full((len(queries), k), np.inf)  # smallest squared distances so far
        seen: list[list[np.ndarray]] = [[] for _ in range(len(queries))]
        square = (self.x * self.x).sum(axis=1)
        own_square = (queries * queries).sum(axis=1)

        def visit(node: int, q: np.ndarray, least: np.ndarray) -> None:
            """least: a lower bound of each query's distance to the node's vectors."""
            near = least * factor <= np.sqrt(best[q, -1]) * (1 + 1e-9) + 1e-9
            q = q[near]
            if not len(q):
                return
            n = self.nodes[node]
            if len(n) == 2:
                rows = self.order[n[0]:n[1]]
                d = np.maximum(own_square[q, None] + square[rows][None, :] - 2 * queries[q] @ self.x[rows].T, 0)
                merged = np.concatenate([best[q], d], axis=1)
                best[q] = np.sort(np.partition(merged, k - 1, axis=1)[:, :k], axis=1)
                keep = d <= best[q, -1][:, None] * (1 + 1e-9) + 1e-9
                for i, row in zip(q.tolist(), keep):
                    seen[i].append(rows[row])
                return
            spot, radius, inner, outer = n
            least = least[near]
            d = np.linalg.norm(queries[q] - spot, axis=1)
            to_inner, to_outer = np.maximum(least, d - radius), np.maximum(least, radius - d)
            inside = d <= radius
            visit(inner, q[inside], to_inner[inside])
            visit(outer, q, to_outer)
            visit(inner, q[~inside], to_inner[~inside])

        visit(self.root, np.arange(len(queries)), np.zeros(len(queries)))
        return [np.concatenate(s) if s else np.zeros(0, np.int64) for s in seen]


def usable(vector: str | Column) -> Column:
    """True for vectors that take part."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, shard_rows: int = 20_000, query_block: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of ``vectors`` (vec_id, embedding) for each of ``queries``,
    its own id left out."""
    def clean(df: DataFrame) -> DataFrame:
        own = df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
        return own.where(F.col("vec_id").isNotNull() & usable("embedding"))

    base = clean(vectors)
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    found = base.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.max(norm).alias("top")).orderBy(F.desc("n"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dim, top, rows = found["dim"], found["top"], found["n"]
    shards = max(1, -(-rows // shard_rows))
    asked = clean(queries).where(F.size("embedding") == dim)
    blocks = max(1, -(-asked.count() // query_block))

    def part(col: str, n: int) -> Column:
        return F.pmod(F.xxhash64(col), F.lit(n))

    # blocks of queries meet shards of rows; a copy of the shard for each block, a copy of the block for each shard
    base = base.where(F.size("embedding") == dim).withColumn("shard", part("vec_id", shards))
    left = base.withColumn("block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)"))).select("shard", "block", "vec_id", "embedding")
    right = asked.withColumn("block", part("vec_id", blocks)).withColumn("shard", F.explode(F.expr(f"sequence(0L, {shards - 1}L)"))).select("shard", "block", "vec_id", "embedding")

    def near(rows: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(rows) and len(ask):
            rows = rows.sort_values("vec_id", kind="stable")
            ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy())
            q_ids, q = ask["vec_id"].to_numpy(), np.stack(ask["embedding"].to_numpy())
            last = np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))
            tree = VPTree(np.column_stack([x, last]))
            # one more than asked for, since the query itself may be among them, and its copies' ids
            extra = int(pd.Series(ids).value_counts().max())
            for own, v, hits in zip(q_ids.tolist(), q, tree.search(np.column_stack([q, np.zeros(len(q))]), min(k + extra, len(x)), factor)):
                hits = hits[ids[hits] != own]
                score = np.array([float(np.dot(x[h], v)) for h in hits])
                top_k = np.lexsort((ids[hits], -score))[:k]
                out["query_id"] += [own] * len(top_k)
                out["vec_id"] += ids[hits][top_k].tolist()
                out["score"] += score[top_k].tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    some = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(near, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, k: int = 20, every: int = 20, factor: float = 1.0) -> DataFrame:
    """The k nearest rows of each row whose id is divisible by ``every``."""
    e = staged(embeddings.select("vec_id", "embedding"), "vectors")
    return search(e, e.where(F.col("vec_id") % every == 0), k, factor)


ORACLE = """
with e as (
  select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v) as score
  from e q join e c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 20
"""
