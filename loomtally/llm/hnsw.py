"""Embedding near-duplicates with hierarchical navigable small-world graphs.

Equal vectors are one class (told by 128 bits of hash), with a number of its own, so
ids of rows may be null or repeat. Classes are dealt by a hash to shards of about
`shard_rows` (eight shards at least), each shard gets a graph of its own, and every
class is searched in every shard. The vectors are shuffled once, for all graphs. All candidates are verified by their cosine in
double precision, so no link is below the threshold.

A graph's layers are prefixes of its nodes, ordered by falling random level; nodes
enter in batches, and neighbours are chosen for diversity. Searches run in step for a
batch of queries. Before a shard is used, an audit compares `audit` of its graph's nodes
that have links to other nodes (all, if they are fewer) with brute force and doubles
the beam until `audit_recall` of a node's links to other nodes are found on average (a
shard that fails with the widest beam is searched by blocked products).
A query whose beam holds nothing but links is searched again with a wider one.

Dense neighbourhoods would need beams as wide as they are large. Where a sampled
member has `dense` or more links in its shard, these stay out of the graph, and
queries that can reach them (by angle) are compared with all of them in blocks.

A search returns the number of links and, for components, the least class of each
of the shard's own components that it meets, never the list of links.

Defined results: a vector that is null, empty, zero or has a null or non-finite
component links with nothing, and vectors of different length don't link; rows of equal
or null vec_id are vectors of their own, linked by what they hold; component_id is null
where no vec_id is reachable, least vec_id otherwise; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtally.llm.components import components
from loomtally.session import durable

BROADCAST_BYTES = 64 << 20


def _unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    top = np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    x = x / top
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass
class Graph:
    """x: unit vectors in layer order. links[l]: neighbours of the first n_l nodes."""

    x: np.ndarray
    m: int = 12
    links: list[np.ndarray] = field(default_factory=list)

    def build(self, seed: int, ef: int = 40) -> Graph:
        n, rng = len(self.x), np.random.default_rng(seed)
        levels = np.sort(np.floor(-np.log(1 - rng.random(n)) / np.log(self.m)).astype(int))[::-1]
        sizes = [int((levels >= level).sum()) for level in range(int(levels[0]) + 1)] if n else [0]
        self.links = [np.full((s, self.m * (2 if level == 0 else 1)), -1, dtype=np.int32) for level, s in enumerate(sizes)]
        for level in range(len(sizes) - 1, -1, -1):
            done = 0
            while done < sizes[level]:
                to = min(sizes[level], done + (64 if done == 0 else min(1024, max(64, done // 2))))
                self._insert(level, done, to, ef)
                done = to
        return self

    def _insert(self, level: int, lo: int, hi: int, ef: int) -> None:
        new = np.arange(lo, hi)
        q = self.x[lo:hi]
        own = q @ q.T
        np.fill_diagonal(own, -2)
        k = min(len(new) - 1, ef // 2)
        near = np.argpartition(-own, k - 1, axis=1)[:, :k] + lo if k > 0 else np.zeros((len(new), 0), dtype=np.int64)
        if lo:
            found, _ = self.search(q, ef, level, limit=lo)
            near = np.concatenate([found, near], axis=1)
        self.links[level][lo:hi] = self._choose(new, near, self.m, self.links[level].shape[1])
        # the chosen get a link back, and choose again where they have too many
        src = np.repeat(new, self.links[level].shape[1])
        dst = self.links[level][lo:hi].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
        width = int(min(count.max(), 64)) if len(nodes) else 0
        extra = np.full((len(nodes), width), -1, dtype=np.int64)
        for j in range(width):
            has = count > j
            extra[has, j] = src[first[has] + j]
        if len(nodes):
            self.links[level][nodes] = self._choose(nodes, np.concatenate([self.links[level][nodes], extra], axis=1), self.links[level].shape[1], self.links[level].shape[1])

    def _choose(self, nodes: np.ndarray, near: np.ndarray, most: int, wide: int) -> np.ndarray:
        """For each node, at most `most` of the candidates: nearest first, those nearer to a
        chosen one than to the node only if places are left."""
        if not near.shape[1]:
            return np.full((len(nodes), wide), -1, dtype=np.int32)
        out = []
        for a in range(0, len(nodes), 512):
            ids = near[a : a + 512]
            s = np.einsum("bd,bkd->bk", self.x[nodes[a : a + 512]], self.x[np.maximum(ids, 0)])
            s[(ids < 0) | (ids == nodes[a : a + 512, None])] = -3
            order = np.argsort(-s, axis=1)
            ids, s = np.take_along_axis(ids, order, 1), np.take_along_axis(s, order, 1)
            again = np.concatenate([np.zeros((len(ids), 1), bool), ids[:, 1:] == ids[:, :-1]], axis=1)
            s[again] = -3
            v = self.x[np.maximum(ids, 0)]
            to_kept = np.full(s.shape, -2.0, dtype=np.float32)
            kept, count = np.zeros(s.shape, bool), np.zeros(len(ids), int)
            for j in range(s.shape[1]):
                take = (s[:, j] > -3) & (count < most) & (s[:, j] >= to_kept[:, j])
                kept[:, j] = take
                count += take
                rows = np.nonzero(take)[0]
                if len(rows) and j + 1 < s.shape[1]:
                    to_kept[rows, j + 1 :] = np.maximum(to_kept[rows, j + 1 :], np.einsum("bd,bkd->bk", v[rows, j], v[rows, j + 1 :]))
            rank = np.where(kept, 0, np.where(s > -3, 1, 2))
            order = np.argsort(rank, axis=1, kind="stable")[:, :most]
            picked = np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(ids, order, 1), -1)
            full = np.full((len(picked), wide), -1, dtype=np.int32)
            full[:, : picked.shape[1]] = picked
            out.append(full)
        return np.concatenate(out)

    def search(self, q: np.ndarray, ef: int, level: int = 0, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, cosines) of the ef nearest found, -1 where there are fewer."""
        at = np.zeros((len(q), 1), dtype=np.int64)
        for upper in range(len(self.links) - 1, level, -1):
            ids, _ = self._beam(q, at, 2, upper, len(self.links[upper]))
            at = ids[:, :1]
        limit = limit or len(self.links[level])
        return self._beam(q, np.where(at < limit, at, 0), ef, level, limit)  # a layer in the making may lack the upper ones' nodes

    def _beam(self, q: np.ndarray, start: np.ndarray, ef: int, level: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        links, b = self.links[level], len(q)
        each = 1 if ef <= 4 else 4
        ids, sims = np.full((b, ef), -1, dtype=np.int64), np.full((b, ef), -3, dtype=np.float32)
        ids[:, : start.shape[1]] = start[:, :ef]
        sims[:, : start.shape[1]] = np.einsum("bd,bkd->bk", q, self.x[start[:, :ef]])
        open_ = ids >= 0
        seen = np.zeros((b, limit), dtype=bool)
        np.put_along_axis(seen, start, True, axis=1)
        live = np.arange(b)
        while len(live):
            s = np.where(open_[live], sims[live], -4)
            pick = np.argsort(-s, axis=1)[:, :each] if each > 1 else s.argmax(axis=1)[:, None]
            good = np.take_along_axis(s, pick, 1) > -4
            go = good.any(axis=1)
            live, pick, good = live[go], pick[go], good[go]
            if not len(live):
                break
            flags = open_[live]
            np.put_along_axis(flags, pick, False, axis=1)
            open_[live] = flags
            nodes = np.where(good, np.take_along_axis(ids[live], pick, 1), -1)
            near = np.where(nodes[:, :, None] >= 0, links[np.maximum(nodes, 0)], -1).reshape(len(live), -1).astype(np.int64)
            near[near >= limit] = -1
            near = np.sort(near, axis=1)  # so that a node offered twice counts once
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
            rows, cols = np.nonzero(fresh)
            seen[live[rows], near[rows, cols]] = True
            got = np.full(near.shape, -3, dtype=np.float32)
            got[rows, cols] = np.einsum("nd,nd->n", q[live[rows]], self.x[near[rows, cols]])
            all_ids = np.concatenate([ids[live], near], axis=1)
            all_sims = np.concatenate([sims[live], got], axis=1)
            all_open = np.concatenate([open_[live], fresh], axis=1)
            top = np.argsort(-all_sims, axis=1)[:, :ef]
            sims[live] = np.take_along_axis(all_sims, top, 1)
            ids[live] = np.where(sims[live] > -3, np.take_along_axis(all_ids, top, 1), -1)
            open_[live] = np.take_along_axis(all_open, top, 1) & (ids[live] >= 0)
        return ids, sims


@dataclass
class Shard:
    """Members of one shard, in the order of its graph: the first `len(graph.x)` are its
    nodes, the others belong to dense neighbourhoods (pivot and places)."""

    unit: np.ndarray  # float64
    ids: np.ndarray
    rows: np.ndarray  # vectors in each class
    graph: Graph
    dense: list[tuple[int, np.ndarray]]
    ef: int
    exact: bool
    labels: np.ndarray | None = None

    def linked(self, q: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, member) places of verified links, in blocks."""
        slack = threshold - 1e-4
        if self.exact:
            for a in range(0, len(self.unit), 4096):
                yield tuple(x + (a if i else 0) for i, x in enumerate(self._verified(q, *np.nonzero(q @ self.unit[a : a + 4096].T >= slack), a, threshold)))
            return
        q32, n, ef = q.astype(np.float32), len(self.graph.x), self.ef
        todo = np.arange(len(q))
        while len(todo) and n:
            again = []
            block = max(16, min(512, (32 << 20) // max(n, ef * 256)))
            for a in range(0, len(todo), block):
                part = todo[a : a + block]
                ids, sims = self.graph.search(q32[part], min(ef, n))
                hit = (sims >= slack) & (ids >= 0)
                full = hit[:, -1] & (ef < n)  # the beam may end before the links do
                again.append(part[full])
                hit[full] = False
                rows, cols = np.nonzero(hit)
                yield self._verified(q, part[rows], ids[rows, cols], 0, threshold)
            todo, ef = np.concatenate(again), ef * 4
        reach = np.cos(min(np.pi, 2 * np.arccos(threshold))) - 1e-6
        for pivot, members in self.dense:
            near = np.nonzero(q @ self.unit[pivot] >= reach)[0]
            for a in range(0, len(near), 256):
                for b in range(0, len(members), 4096):
                    r, c = np.nonzero(q[near[a : a + 256]] @ self.unit[members[b : b + 4096]].T >= slack)
                    yield self._verified(q, near[a : a + 256][r], members[b : b + 4096][c], 0, threshold)

    def _verified(self, q: np.ndarray, rows: np.ndarray, cols: np.ndarray, add: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        keep = [np.einsum("nd,nd->n", q[rows[i : i + 65536]], self.unit[cols[i : i + 65536] + add]) >= threshold for i in range(0, len(rows), 65536)]
        keep = np.concatenate(keep) if keep else np.zeros(0, dtype=bool)
        return rows[keep], cols[keep]


def make_shard(ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, threshold: float, dense: int, audit: int, audit_recall: float, ef: int, seed: int) -> Shard:
    unit = _unit(vectors)
    n, rng = len(ids), np.random.default_rng([seed, len(ids)])
    # dense neighbourhoods around sampled members, the largest first
    sample = rng.permutation(n)[:256]
    close = np.concatenate([unit[a : a + 8192] @ unit[sample].T >= threshold for a in range(0, n, 8192)])
    free, groups = np.ones(n, dtype=bool), []
    while True:
        size = close[free].sum(axis=0)
        best = int(size.argmax())
        if size[best] < dense:
            break
        members = np.nonzero(free & close[:, best])[0]
        groups.append((int(sample[best]), members))
        free[members] = False
    order = np.concatenate([np.nonzero(free)[0], np.nonzero(~free)[0]])
    back = np.empty(n, dtype=np.int64)
    back[order] = np.arange(n)
    unit, ids, rows = unit[order], ids[order], rows[order]
    graph = Graph(unit[: int(free.sum())].astype(np.float32)).build(seed)
    shard = Shard(unit, ids, rows, graph, [(int(back[p]), back[m]) for p, m in groups], ef, False)
    probe, truth = _linked_nodes(unit[: len(graph.x)], threshold, audit, rng)
    while len(probe) and _node_recall(shard, probe, truth, threshold) < audit_recall:
        if shard.ef >= max(1024, ef):
            shard.exact = True
            break
        shard.ef *= 2
    shard.labels = _local_components(shard, threshold)
    return shard


def _linked_nodes(nodes: np.ndarray, threshold: float, audit: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The first `audit` nodes in random order that have links to other nodes, and how many."""
    order, probe, truth = rng.permutation(len(nodes)), [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for i in range(0, len(order), 1024):
        part = order[i : i + 1024]
        links = sum((nodes[part] @ nodes[a : a + 8192].T >= threshold).sum(axis=1) for a in range(0, len(nodes), 8192))
        links = links - (np.einsum("nd,nd->n", nodes[part], nodes[part]) >= threshold)  # without itself
        probe.append(part[links > 0])
        truth.append(links[links > 0])
        if sum(map(len, probe)) >= audit:
            break
    return np.concatenate(probe)[:audit], np.concatenate(truth)[:audit]


def _node_recall(shard: Shard, probe: np.ndarray, truth: np.ndarray, threshold: float) -> float:
    """The share of a probe's links to other nodes of the graph that is found, each probe alike."""
    found = np.zeros(len(probe))
    for r, c in shard.linked(shard.unit[probe], threshold):
        other = (c < len(shard.graph.x)) & (c != probe[r])
        found += np.bincount(r[other], minlength=len(probe))
    return float(np.minimum(found / truth, 1).mean())


def _local_components(shard: Shard, threshold: float) -> np.ndarray:
    """The least class of each member's component within the shard."""
    n = len(shard.ids)
    label = np.arange(n)
    rank = np.argsort(np.argsort(shard.ids, kind="stable"), kind="stable")
    by_rank = np.empty(n, dtype=np.int64)
    by_rank[rank] = np.arange(n)
    parent = np.arange(n)  # by rank, so that the least class is the root

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a in range(0, n, 2048):
        for rows, cols in shard.linked(shard.unit[a : a + 2048], threshold):
            x, y = rank[rows + a], rank[cols]
            # pairs that are joined already are dropped in bulk
            for i, j in zip(x[parent[x] != parent[y]].tolist(), y[parent[x] != parent[y]].tolist(), strict=True):
                i, j = find(i), find(j)
                parent[max(i, j)] = min(i, j)
    for i in range(n):
        label[i] = by_rank[find(int(rank[i]))]
    return shard.ids[label]


def near_vectors(
    vectors: DataFrame, threshold: float = 0.95, shard_rows: int = 65_536, least_shards: int = 8, dense: int = 64, audit: int = 256, audit_recall: float = 0.99, ef: int = 32, seed: int = 3
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", "embedding", sound.alias("_sound"), F.xxhash64("embedding").alias("_h"), F.xxhash64(F.lit(seed), "embedding").alias("_g"))
    classes = rows.where("_sound").groupBy("_h", "_g").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("head"), F.count(F.lit(1)).alias("n"))
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    classes = durable(classes.repartition(tasks).withColumn("dim", F.size("embedding")).withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    total = classes.count()
    shards = max(least_shards, -(-total // shard_rows))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h", "_g"], ignore_index=True)
        made = make_shard(pdf["id"].to_numpy(dtype=np.int64), pdf["n"].to_numpy(dtype=np.int64), np.stack(pdf["embedding"].to_numpy()), threshold, dense, audit, audit_recall, ef, seed)
        return pd.DataFrame({"dim": [np.int32(pdf["dim"].iloc[0])], "shard": [np.int32(pdf["shard"].iloc[0])], "graph": [pickle.dumps(made, protocol=5)]})

    dealt = classes.select("id", "n", "embedding", "dim", "_h", "_g", F.pmod(F.col("_g"), F.lit(shards)).cast("int").alias("shard"))
    graphs = durable(dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, graph binary"), "graphs")
    sizes = graphs.select("dim", "shard", F.octet_length("graph").alias("b")).orderBy("dim", "shard").collect()  # a row for each graph
    groups: list[list] = []
    for r in sizes:
        if not groups or sum(x["b"] for x in groups[-1]) + r["b"] > BROADCAST_BYTES:
            groups.append([])
        groups[-1].append(r)

    found = None
    for group in groups:
        keys = [(r["dim"], r["shard"]) for r in group]
        wanted = F.struct("dim", "shard").isin(*[F.struct(F.lit(d).cast("int"), F.lit(s).cast("int")) for d, s in keys])
        # graphs of BROADCAST_BYTES together, or one of at most shard_rows members
        shared = spark.sparkContext.broadcast([(r["dim"], bytes(r["graph"])) for r in graphs.where(wanted).orderBy("dim", "shard").collect()])

        def ask(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            held = [(d, pickle.loads(g)) for d, g in shared.value]
            for batch in batches:
                ids, dims = batch["id"].to_numpy(dtype=np.int64), batch["dim"].to_numpy()
                links, edges = np.zeros(len(ids), dtype=np.int64), [np.zeros((0, 2), dtype=np.int64)]
                for dim in np.unique(dims):
                    own = np.nonzero(dims == dim)[0]
                    unit = _unit(np.stack(batch["embedding"].to_numpy()[own]))
                    for d, shard in held:
                        if d != dim:
                            continue
                        for r, c in shard.linked(unit, threshold):
                            other = shard.ids[c] != ids[own[r]]
                            links += np.bincount(own[r[other]], shard.rows[c[other]], len(ids)).astype(np.int64)
                            edges.append(np.unique(np.column_stack([ids[own[r]], shard.labels[c]]), axis=0))
                pairs = np.unique(np.concatenate(edges), axis=0)
                pairs = pairs[pairs[:, 0] != pairs[:, 1]]
                yield pd.DataFrame({"id": ids, "links": links, "label": ids})
                yield pd.DataFrame({"id": pairs[:, 0], "links": np.zeros(len(pairs), dtype=np.int64), "label": pairs[:, 1]})

        part = durable(classes.select("id", "dim", "embedding").mapInPandas(ask, "id long, links long, label long"), "links")
        shared.destroy()
        found = part if found is None else found.unionByName(part)

    if found is None:
        found = spark.createDataFrame([], "id long, links long, label long")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    labels = components(found.where("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b")))
    slim = classes.select("id", "n", "head", "_h", "_g")
    grouped = (
        slim.join(links.withColumnRenamed("id", "_l"), F.col("id") == F.col("_l"), "left")
        .join(labels, F.col("id") == F.col("node"), "left")
        .select("_h", "_g", "head", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("_links"), F.coalesce("label", "id").alias("_label"))
    )
    least = grouped.groupBy(F.col("_label").alias("_of")).agg(F.min("head").alias("_least"))
    named = grouped.join(least, F.col("_label") == F.col("_of")).select(F.col("_h").alias("_h2"), F.col("_g").alias("_g2"), "_links", "_least")
    return (
        rows.drop("embedding")
        .join(named, F.col("_sound") & (F.col("_h") == F.col("_h2")) & (F.col("_g") == F.col("_g2")), "left")
        .select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("_links").isNull(), F.col("vec_id")).otherwise(F.col("_least")).alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
