"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, one representative per group.

No link is lost at cell borders. A vector also visits every other cell that could hold a partner: two unit vectors
linked at angle t lie at most sin(t) from any hyperplane between them, so a vector whose distance to the border of a
cell is more than that has no partner there. Pairs are found once, by the vector of the lower cell.

Dense groups are not multiplied out. Pivots found in the sample each own a ball of half the link angle: all its
members link with each other, so the ball's size gives their number, and only vectors within one and a half link
angles of a pivot visit its ball. Equal vectors are one node with a count.

Cells are cut into blocks of at most about BLOCK rows; a task multiplies two blocks. It returns link counts and, for
connectivity, one edge per vector to its local component, never pairs. How many cells a vector visits depends on the
data: few for clustered embeddings, most for vectors without structure.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import sampled, saved
from runlens.llm.components import components

THRESHOLD = 0.95
#: The k-means fit and the search for pivots use about so many vectors, picked by a hash.
SAMPLE = 8192
#: Rows of a cell on average, and the most cells.
CELL_ROWS = 2048
MOST_CELLS = 2048
#: Pivots need so many neighbours in the sample.
DENSE = 8
MOST_PIVOTS = 512
BLOCK = 4096
#: Room for rounding in the bounds.
SLACK = 1e-6


@dataclass
class Cells:
    pivots: np.ndarray
    centres: np.ndarray
    threshold: float

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Home cell of each unit vector, and the cells it visits. Balls come first in the numbering."""
        angle = math.acos(self.threshold)
        n_balls = len(self.pivots)
        to_pivot, to_centre = x @ self.pivots.T, x @ self.centres.T
        home = n_balls + to_centre.argmax(axis=1)
        visit_ball = np.zeros((len(x), 0), dtype=bool)
        if n_balls:
            nearest = to_pivot.argmax(axis=1)
            inside = to_pivot[np.arange(len(x)), nearest] >= math.cos(angle / 2) + SLACK
            home = np.where(inside, nearest, home)
            visit_ball = (to_pivot >= math.cos(min(math.pi, 1.5 * angle)) - SLACK) & (np.arange(n_balls)[None] < home[:, None])
        gap = np.sqrt(np.maximum(0, 2 - 2 * self.centres @ self.centres.T))
        own = np.maximum(home - n_balls, 0)
        near = to_centre[np.arange(len(x)), own][:, None] - to_centre <= math.sin(angle) * gap[own] + SLACK
        visit_cell = near & (np.arange(len(self.centres))[None] > own[:, None]) & (home >= n_balls)[:, None]
        visits = np.concatenate([visit_ball, visit_cell], axis=1)
        return home, [np.flatnonzero(v) for v in visits]


def fit(sample: np.ndarray, cells: int, threshold: float, rounds: int = 8) -> Cells:
    """Pivots of dense groups, then spherical k-means on the rest of the sample."""
    half = math.cos(math.acos(threshold) / 2) + SLACK
    degree = np.concatenate([(sample[i : i + 512] @ sample.T >= half).sum(axis=1) for i in range(0, len(sample), 512)])
    free, pivots = np.ones(len(sample), dtype=bool), []
    for i in np.argsort(-degree, kind="stable"):
        if degree[i] < DENSE or len(pivots) == MOST_PIVOTS:
            break
        if free[i]:
            pivots.append(i)
            free &= sample @ sample[i] < half
    rest = sample[free] if free.any() else sample
    k = max(1, min(cells, len(rest)))
    centres = rest[np.random.default_rng(11).choice(len(rest), k, replace=False)]
    for _ in range(rounds if k > 1 else 0):
        of = (rest @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, rest)
        norm = np.linalg.norm(sums, axis=1)
        centres = np.where((norm > 0)[:, None], sums / np.maximum(norm, 1e-300)[:, None], centres)
    return Cells(sample[pivots].reshape(len(pivots), sample.shape[1]), centres, threshold)


def _unit(packed: pd.Series) -> np.ndarray:
    x = np.stack([np.frombuffer(b, dtype=np.float64) for b in packed])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _multiply(threshold: float):
    def multiply(group: pd.DataFrame) -> pd.DataFrame:
        """Link counts and local components of one pair of blocks."""
        left = group[group["side"] == 0]
        right = group[group["side"] == 1]
        one = right.empty
        if one and left["kind"].iloc[0] != 0 or left.empty:
            return pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
        right = left if one else right
        a, b = _unit(left["vector"]), _unit(right["vector"])
        rows, cols = [], []
        links_a, links_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        na, nb = left["copies"].to_numpy(dtype=np.int64), right["copies"].to_numpy(dtype=np.int64)
        ids = np.r_[left["node"].to_numpy(dtype=np.int64), right["node"].to_numpy(dtype=np.int64)]
        label, seen = ids.copy(), []
        for i in range(0, len(a), 1024):
            hit = a[i : i + 1024] @ b.T >= threshold
            if one:
                hit[np.arange(len(hit)), np.arange(i, i + len(hit))] = False
            links_a[i : i + 1024] = hit @ nb
            if not one:
                links_b += na[i : i + 1024] @ hit
            if hit.any():
                r, c = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
                seen.append((r + i, c, hit[np.ix_(r, c)]))
        shift = 0 if one else len(a)
        moved = True
        while moved:  # labels fall to the smallest node of the local component
            before = label.copy()
            for r, c, hit in seen:
                label[r] = np.minimum(label[r], np.where(hit, label[c + shift][None], np.iinfo(np.int64).max).min(axis=1))
                label[c + shift] = np.minimum(label[c + shift], np.where(hit, label[r][:, None], np.iinfo(np.int64).max).min(axis=0))
            moved = bool((label != before).any())
        links = links_a if one else np.r_[links_a, links_b]
        keep = np.flatnonzero(links > 0)
        return pd.DataFrame({"node": ids[keep], "links": links[keep], "root": label[keep]})

    return multiply


def link_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row, by cosine in double precision.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components, and rows with a NULL id, link with
    nothing; they are their own component. Vectors of different lengths never link. Repeated rows count as other
    vectors. Linked are pairs with a cosine of at least ``threshold``; all of them are found.
    """
    e = F.col(embedding)
    sound = F.coalesce(F.size(e) > 0, F.lit(False)) & ~F.coalesce(F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True)) & F.coalesce(F.exists(e, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.when(sound & F.col(vec_id).isNotNull(), e.cast("array<double>")).alias("v"))
    rows = rows.withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("v", F.size("v"))))
    ids = saved(rows.select("vec_id", "node"), "vector-ids")
    nodes = rows.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    nodes = saved(nodes.withColumn("dim", F.size("v")), "vectors")
    sizes = {r["dim"]: r["n"] for r in nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    found, edges = [], []
    for dim, n in sorted(sizes.items()):
        part, part_edges = _link_nodes(nodes.where(F.col("dim") == dim), n, threshold)
        found.append(part)
        edges.append(part_edges)
    if not found:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    counts, links = found[0], edges[0]
    for more, more_edges in zip(found[1:], edges[1:]):
        counts, links = counts.union(more), links.union(more_edges)
    groups = components(links)
    own = ids.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("least"), (F.count(F.lit(1)) - 1).alias("twins"))
    full = own.join(counts.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(groups, "node", "left")
    full = full.select("node", "least", (F.col("twins") + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    named = full.join(full.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "n_links", "component_id")
    out = ids.join(named, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _link_nodes(nodes: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, links) parts and edges among vectors of one length."""
    sample = nodes.where(sampled(F.col("node"), SAMPLE / n)).orderBy("node").select("v").toPandas()["v"]
    sample = sample if len(sample) else nodes.orderBy("node").limit(1).select("v").toPandas()["v"]
    cells = fit(_unit(sample.map(lambda v: np.asarray(v, dtype=np.float64).tobytes())), max(1, min(MOST_CELLS, n // CELL_ROWS)), threshold)
    balls = len(cells.pivots)

    def deal(batches):
        for batch in batches:
            packed = [np.asarray(v, dtype=np.float64).tobytes() for v in batch["v"]]
            home, visits = cells.assign(_unit(pd.Series(packed)))
            at = np.r_[np.arange(len(batch)), np.repeat(np.arange(len(batch)), [len(v) for v in visits])].astype(np.int64)
            cell = np.concatenate([home, *visits])
            visitor = np.arange(len(at)) >= len(batch)
            for k in range(0, len(at), 20_000):
                i = at[k : k + 20_000]
                yield pd.DataFrame({
                    "cell": cell[k : k + 20_000].astype(np.int32), "visitor": visitor[k : k + 20_000], "node": batch["node"].to_numpy(dtype=np.int64)[i],
                    "copies": batch["copies"].to_numpy(dtype=np.int64)[i], "vector": [packed[j] for j in i],
                })

    dealt = saved(nodes.select("node", "copies", "v").mapInPandas(deal, "cell int, visitor boolean, node long, copies long, vector binary"), "cells")
    per_cell = dealt.groupBy("cell").agg(F.count_if(~F.col("visitor")).alias("_h"), F.count_if("visitor").alias("_v"))
    blocks = per_cell.select("cell", *[F.ceil(F.col(c) / BLOCK).cast("int").alias(c) for c in ("_h", "_v")])  # at most MOST_CELLS + MOST_PIVOTS rows
    rows = dealt.join(F.broadcast(blocks), "cell")
    spread = F.xxhash64("node", F.lit("block"))
    mine = F.pmod(spread, F.when(F.col("visitor"), F.col("_v")).otherwise(F.greatest("_h", F.lit(1)))).cast("int")
    rows = rows.withColumn("_b", mine)

    def task(kind: int, i, j, side: int):
        return F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))

    none = F.array().cast("array<struct<kind:int,i:int,j:int,side:int>>")
    b, last_h, last_v = F.col("_b"), F.col("_h") - 1, F.col("_v") - 1
    as_left = F.transform(F.sequence(b, last_h), lambda k: task(0, b, k, 0))
    as_right = F.when(b > 0, F.transform(F.sequence(F.lit(0), b - 1), lambda k: task(0, k, b, 1))).otherwise(none)
    to_visitors = F.when(F.col("_v") > 0, F.transform(F.sequence(F.lit(0), last_v), lambda k: task(1, b, k, 0))).otherwise(none)
    visits = F.when(F.col("_h") > 0, F.transform(F.sequence(F.lit(0), last_h), lambda k: task(1, k, b, 1))).otherwise(none)
    inside = F.when(F.col("cell") < balls, none).otherwise(F.concat(as_left, as_right))
    tasks = F.when(F.col("visitor"), visits).otherwise(F.concat(inside, to_visitors))
    work = rows.withColumn("_t", F.explode(tasks)).select("cell", "_t.*", "node", "copies", "vector")
    linked = saved(work.groupBy("cell", "kind", "i", "j").applyInPandas(_multiply(threshold), "node long, links long, root long"), "links")
    in_ball = dealt.where((F.col("cell") < balls) & ~F.col("visitor")).select("cell", "node", "copies")
    ball = in_ball.groupBy("cell").agg(F.sum("copies").alias("_all"), F.min("node").alias("_root"))
    own = in_ball.join(F.broadcast(ball), "cell")
    counts = linked.select("node", "links").union(own.select("node", (F.col("_all") - F.col("copies")).alias("links")))
    return counts, linked.select(F.col("node").alias("a"), F.col("root").alias("b")).union(own.select("node", "_root"))
