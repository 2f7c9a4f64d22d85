"""Operator 13: near duplicates among vectors of one label, found by a robust-pruned flat graph and verified by cosine.

1. Equal vectors of a label form one node, so copies cost nothing further; nodes are what is compared.
2. Overlapping shards. A shard is a label, at first. One with more than CAPACITY members is split by centroids, fitted on
   FIT of its members: a member goes to its nearest centroid's shard, and, as a guest, to that of the next ones; guests are
   not multiplied again. This is repeated until all shards fit into a task. Centroids within the threshold of each other are one,
   so that a group of near copies stays together. A shard in which DENSE of all pairs of a sample are links can't be split by centroids
   without losing links: its members are dealt into blocks, and each two blocks are a shard. Its work grows with its links.
3. Graphs. In each shard nodes are inserted in growing batches: a greedy beam search from the nearest medoids over the graph
   so far gives candidates, the nodes that it expanded included. Robust pruning keeps at most DEGREE of them, none of which
   is much nearer to another one that is kept, and edges back are pruned likewise. As a group of near copies would fill a
   node's list, those within the range have NEAR places of their own; the others keep the group in touch with the rest.
   The adjacency lists that a node has in its shards are united.
4. Search. For each member of a shard a beam search from the nearest medoids finds the nearest nodes; from those within the
   range, and from the node itself, the search goes on along all edges, both ways, as long as nodes are within SLACK times the angle. What
   reaches the threshold by cosine in double precision is a link, counted in the first shard that both have in common.
5. Audit. For some nodes, half of them with links, all links are counted by brute force. If fewer than WANTED of these were found,
   all is done again with more guests and a wider beam; below LEAST in the last attempt the operator fails.

Only a row for each node and shard leaves a task, never pairs; components are joined over these rows.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and those without a label, link with
nothing; vectors of different length never link; rows of a repeated id are vectors of their own with the same id; a null id
never is the smallest, and a row is kept if its id and its component's are both null; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm import common
from skein.llm.jaccard_join import components
from skein.llm.multi_index import distances, fit_centroids, matrix, unit, usable

THRESHOLD = 0.98
#: Members of a shard at most, members that its centroids are fitted on, centroids at most.
CAPACITY, FIT, FANOUT = 1024, 1000, 32
#: Edges of a node to nodes out of range and in range, the pruning factor, queries that are searched together.
DEGREE, NEAR, ALPHA, BLOCK = 24, 12, 1.2, 256
#: Medoids of a shard, and how many of them, the nearest, a search begins at.
MEDOIDS, ENTRIES = 64, 8
SLACK = 1.5
#: Nodes of a beam that are expanded at once, and pairs whose cosines are taken at once.
WIDTH, RUN = 4, 4096
#: Share of linked pairs from which on a shard is dealt into blocks, and members of a block, as a share of the capacity.
DENSE, PART = 0.25, 0.42
#: Edges that a spreading search follows at once.
STEP = 1 << 20
#: (guests, beam) of each attempt.
ATTEMPTS = ((1, 32), (2, 64), (4, 256))
AUDITED, WANTED, LEAST = 64, 0.99, 0.9
#: From this level of splitting on no guests are made, so that shards surely shrink.
NO_GUESTS, MOST_LEVELS = 10, 60


def near_first(sims: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, largest first."""
    k = min(k, sims.shape[1])
    part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(sims, part, axis=1), axis=1, kind="stable"), axis=1)


def likeness(x: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Cosines of queries[i] and the nodes ids[i]; -inf where there is none."""
    return np.where(ids >= 0, np.matmul(x[ids], queries[:, :, None])[:, :, 0], -np.inf)


def beam_search(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids and cosines of the nodes in each query's beam, nearest first, -1 for none, and the ids of those that were expanded."""
    q, every = len(queries), queries @ x[entries].T
    first = near_first(every, min(ENTRIES, beam))
    ids, sims, done = np.full((q, beam), -1, np.int64), np.full((q, beam), -np.inf), np.zeros((q, beam), bool)
    ids[:, : first.shape[1]], sims[:, : first.shape[1]] = entries[first], np.take_along_axis(every, first, axis=1)
    seen, path, width = np.zeros((q, len(x)), bool), [], min(WIDTH, beam)
    seen[np.arange(q)[:, None], entries[first]] = True
    place = np.zeros((q, len(x)), np.int32)
    while True:
        open_ = np.where(done | (ids < 0), -np.inf, sims)
        best = np.argpartition(-open_, width - 1, axis=1)[:, :width]
        go = np.take_along_axis(open_, best, axis=1) > -np.inf
        rows = np.flatnonzero(go.any(axis=1))
        if not len(rows):
            return ids, sims, np.concatenate(path, axis=1) if path else np.empty((q, 0), np.int64)
        r, c = np.nonzero(go)
        done[r, best[r, c]] = True
        step = np.where(go, np.take_along_axis(ids, best, axis=1), -1)
        path.append(step)
        found = np.where(step[rows][:, :, None] >= 0, edges[step[rows]], -1).reshape(len(rows), -1)
        r, c = np.nonzero((found >= 0) & ~seen[rows[:, None], found])
        node = found[r, c]
        place[rows[r], node] = c
        once = place[rows[r], node] == c  # a node that several lists have counts once
        r, node = r[once], node[once]
        seen[rows[r], node] = True
        size = np.bincount(r, minlength=len(rows))
        at = (r, np.arange(len(r)) - np.repeat(np.cumsum(size) - size, size))
        new_ids, new_sims = np.full((len(rows), int(size.max(initial=0))), -1, np.int64), np.full((len(rows), int(size.max(initial=0))), -np.inf)
        new_ids[at], new_sims[at] = node, cosines(queries, x, rows[r], node)
        all_ids, all_sims = np.concatenate((ids[rows], new_ids), axis=1), np.concatenate((sims[rows], new_sims), axis=1)
        all_done = np.concatenate((done[rows], np.zeros(new_ids.shape, bool)), axis=1)
        top = near_first(all_sims, beam)
        ids[rows], sims[rows], done[rows] = (np.take_along_axis(t, top, axis=1) for t in (all_ids, all_sims, all_done))


def pruned(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, wide: float, alpha: float = ALPHA) -> np.ndarray:
    """For each node at most NEAR of its candidates of cosine `wide` or more and DEGREE of the others: the nearest, then the nearest
    of those that no chosen one is nearer to by alpha."""
    out = np.full((len(nodes), NEAR + DEGREE), -1, np.int64)
    step = max(1, (1 << 16) // max(1, candidates.shape[1]))
    for a in range(0, len(nodes), step):
        own = nodes[a : a + step]
        ids = np.where(candidates[a : a + step] == own[:, None], -1, candidates[a : a + step])
        ids = np.sort(ids, axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        sims = likeness(x, ids, x[own])
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        apart = 1 - sims  # half the squared distance
        for place, most, alive in ((0, NEAR, (ids >= 0) & (sims >= wide)), (NEAR, DEGREE, (ids >= 0) & (sims < wide))):
            for k in range(most):
                rows = np.flatnonzero(alive.any(axis=1))
                if not len(rows):
                    break
                pick = alive[rows].argmax(axis=1)
                chosen = ids[rows, pick]
                out[a + rows, place + k] = chosen
                r, c = np.nonzero(alive[rows])
                between = 1 - cosines(x[chosen], x, r, ids[rows[r], c])
                alive[rows[r], c] = alpha * alpha * between > apart[rows[r], c]
                alive[rows, pick] = False
    return out


def medoids(x: np.ndarray) -> np.ndarray:
    """The node nearest to the middle, and those nearest to the centroids of MEDOIDS clusters."""
    middle = int((x @ x.sum(axis=0)).argmax())
    c = fit_centroids(x, min(MEDOIDS, len(x)), steps=5)
    return np.unique(np.append((x @ c.T).argmax(axis=0), middle))


def range_of(threshold: float) -> float:
    """The cosine at SLACK times the threshold's angle."""
    return math.cos(min(math.pi, SLACK * math.acos(threshold))) if threshold < 1 else threshold


def built(x: np.ndarray, wide: float, beam: int, seed: int = 0) -> np.ndarray:
    """The graph of unit vectors: for each its neighbours, among and behind them -1."""
    n, entries = len(x), medoids(x)
    edges = np.full((n, NEAR + DEGREE), -1, np.int64)
    edges[entries] = pruned(x, entries, np.tile(entries, (len(entries), 1)), wide)
    order = np.random.default_rng(seed).permutation(n)
    order, done = order[~np.isin(order, entries)], 0
    while done < len(order):
        batch = order[done : done + min(BLOCK, done + len(entries))]
        ids, _, path = beam_search(x, edges, x[batch], entries, beam)
        edges[batch] = pruned(x, batch, np.concatenate((ids, path), axis=1), wide)
        done += len(batch)
        r, c = np.nonzero(edges[batch] >= 0)
        target, source = edges[batch][r, c], batch[r]
        by = np.argsort(target, kind="stable")
        target, source = target[by], source[by]
        first = np.flatnonzero(np.diff(target, prepend=-1))
        count = np.diff(np.append(first, len(target)))
        back = np.full((len(first), int(count.max(initial=0))), -1, np.int64)
        back[np.repeat(np.arange(len(first)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        edges[target[first]] = pruned(x, target[first], np.concatenate((edges[target[first]], back), axis=1), wide)
    return edges


def cosines(queries: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of queries[i] and x[j], in runs of bounded size."""
    return np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", queries[i[a : a + RUN]], x[j[a : a + RUN]]) for a in range(0, len(i), RUN))])


def undirected(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node where its neighbours begin in a flat list, their number, and that list, with edges both ways."""
    r, c = np.nonzero(edges >= 0)
    a, b = r, edges[r, c]
    a, b = np.divmod(np.unique(np.concatenate((a * len(edges) + b, b * len(edges) + a))), len(edges))
    size = np.bincount(a, minlength=len(edges))
    return np.cumsum(size) - size, size, b


def in_range(x: np.ndarray, edges: np.ndarray, own: np.ndarray, threshold: float, beam: int, entries: np.ndarray, both_ways: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): nodes j within the threshold of the nodes own[i]. The beam's nodes in range and own[i] are where the search spreads from."""
    wide, queries, q = range_of(threshold), x[own], len(own)
    begin, size, flat = both_ways
    ids, sims, _ = beam_search(x, edges, queries, entries, beam)
    seen = np.zeros((q, len(x)), bool)
    r, c = np.nonzero((sims >= wide) & (ids >= 0))
    i, j = np.concatenate((r, np.arange(q))), np.concatenate((ids[r, c], own))
    i, j = np.divmod(np.unique(i * len(x) + j), len(x))
    seen[i, j] = True
    found = [(i, j)]
    while len(i):
        before, total = seen.copy(), np.cumsum(size[j])
        cuts = np.unique(np.append(np.searchsorted(total, np.arange(0, total[-1], STEP)), len(i)))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            m = size[j[a:b]]
            offset = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            seen[np.repeat(i[a:b], m), flat[np.repeat(begin[j[a:b]], m) + offset]] = True
        i, j = np.nonzero(seen & ~before)
        near = cosines(queries, x, i, j) >= wide
        i, j = i[near], j[near]
        found.append((i, j))
    i, j = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    good = (cosines(queries, x, i, j) >= threshold) & (own[i] != j)
    return i[good], j[good]


def shard_links(x: np.ndarray, edges: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """All links a < b that the searches from every node of a shard find."""
    entries, both_ways, pairs = medoids(x), undirected(edges), [np.empty(0, np.int64)]
    for a in range(0, len(x), BLOCK):
        own = np.arange(a, min(a + BLOCK, len(x)))
        i, j = in_range(x, edges, own, threshold, beam, entries, both_ways)
        pairs.append(np.unique(np.minimum(own[i], j) * len(x) + np.maximum(own[i], j)))
    return np.divmod(np.unique(np.concatenate(pairs)), len(x))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each can reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _widths(column) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists as lengths and values."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def _padded(size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    out = np.full((len(size), int(size.max(initial=1))), -1, np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def joined(c: np.ndarray, threshold: float) -> np.ndarray:
    """Centroids of which those within the threshold of each other, also by way of others, are one, their mean; all as they are if only one was left."""
    u = unit(c)
    a, b = np.nonzero(u @ u.T >= threshold)
    root, each = np.unique(local_roots(len(c), a, b), return_inverse=True)
    if len(root) < 2:
        return c
    out = np.zeros((len(root), c.shape[1]))
    np.add.at(out, each, c)
    return out / np.bincount(each)[:, None]


def _shards(nodes: DataFrame, tables: common.Tables, guests: int, capacity: int, threshold: float = THRESHOLD) -> DataFrame:
    """node, n, vector, shard: each node in its own shard and those where it is a guest. No shard that centroids made has more than
    `capacity` members, those of two blocks have that many or fewer on average."""

    def fitted(rows: pa.Table) -> pa.Table:
        x, members = unit(matrix(rows["vector"])), rows["members"][0].as_py()
        blocks = 0
        if ((x @ x.T >= threshold).sum() - len(x)) >= DENSE * len(x) * (len(x) - 1):
            blocks = max(3, math.ceil(members / (PART * capacity)))
        c = joined(fit_centroids(x, int(min(FANOUT, max(4, -(-4 * members // capacity)))), seed=level), threshold)
        return pa.table([rows["shard"].slice(0, 1), pa.array([c.ravel().tolist()]), pa.array([blocks], pa.int32())], ["shard", "centroids", "blocks"])

    def blocked(shard: str, rows: pa.Table, blocks: int) -> pa.Table:
        """Each member in the shards that its block, by hash, makes with every other one."""
        mine = rows["part_of"].to_numpy() % blocks
        others = np.arange(blocks - 1)[None, :]
        others = (others + (others >= mine[:, None])).ravel()
        mine = np.repeat(mine, blocks - 1)
        names = [f"{shard}/{a}+{b}" for a, b in zip(np.minimum(mine, others).tolist(), np.maximum(mine, others).tolist(), strict=True)]
        part = rows.select(["node", "n", "vector"]).take(pa.array(np.repeat(np.arange(rows.num_rows), blocks - 1)))
        flags = [pa.array(np.full(part.num_rows, v)) for v in (False, True)]
        return part.append_column("shard", pa.array(names, pa.string())).append_column("home", flags[0]).append_column("whole", flags[1])

    def dealt(key, rows: pa.Table, fits: pa.Table) -> pa.Table:
        names = ["node", "n", "vector", "shard", "home", "whole"]
        if not rows.num_rows or not fits.num_rows:
            return rows.select(names).slice(0, 0)
        if fits["blocks"][0].as_py():
            return blocked(key[0].as_py(), rows, fits["blocks"][0].as_py())
        x = unit(matrix(rows["vector"]))
        c = np.array(fits["centroids"][0].as_py()).reshape(-1, x.shape[1])
        order = near_first(-distances(x, c), (guests if level < NO_GUESTS else 0) + 1)
        home = rows["home"].to_numpy(zero_copy_only=False)
        out = []
        for k in range(order.shape[1]):
            take = np.arange(len(x)) if k == 0 else np.flatnonzero(home)
            part = rows.select(["node", "n", "vector"]).take(pa.array(take))
            child = pa.array([f"{key[0].as_py()}/{j}" for j in order[take, k].tolist()], pa.string())
            out.append(part.append_column("shard", child).append_column("home", pa.array(home[take] & (k == 0))).append_column("whole", pa.array(np.zeros(len(take), bool))))
        return pa.concat_tables(out)

    kind = "node long, n long, vector array<double>, shard string, home boolean, whole boolean"
    placed = nodes.select("node", "n", "vector", F.concat_ws("/", F.col("label").cast("string"), F.size("vector")).alias("shard"), F.lit(True).alias("home"), F.lit(False).alias("whole"))
    done = []
    for level in range(MOST_LEVELS):
        sizes = placed.where(~F.col("whole")).groupBy("shard").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > capacity)
        big = tables.write(sizes, "large")
        if big.isEmpty():
            return reduce(DataFrame.unionByName, [*done, placed]).drop("home", "whole")
        if level == MOST_LEVELS - 1:
            raise RuntimeError("shards of vectors could not be split further")
        open_ = placed.join(big, "shard")
        some = open_.withColumn("k", F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("node")))).where(F.col("k") <= FIT)
        fits = tables.write(some.groupBy("shard").applyInArrow(fitted, "shard string, centroids array<double>, blocks int"), "centroids")
        parts = F.ceil(F.col("members") / capacity).cast("int")
        rows = open_.withColumn("part", F.pmod(F.xxhash64(F.lit(level), "node"), parts).cast("int")).drop("members")
        rows = rows.withColumn("part_of", F.pmod(F.xxhash64(F.lit("block"), "node"), F.lit(1 << 40)))
        copies = fits.join(big, "shard").select("shard", "centroids", "blocks", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        split = tables.write(rows.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(dealt, kind), "placed")
        done.append(placed.join(big.select("shard"), "shard", "left_anti"))
        placed = split
    return placed


def _graph(members: DataFrame, threshold: float, beam: int) -> DataFrame:
    """node, shard, neighbours (nodes) in each shard."""

    def graph(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")  # so that a repeated task gives the same
        x, node = unit(matrix(rows["vector"])), rows["node"].to_numpy()
        edges = built(x, range_of(threshold), beam)
        some = edges >= 0
        ends = np.concatenate(([0], np.cumsum(some.sum(axis=1)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(node[edges[some]]))
        return pa.table([pa.array(node), rows["shard"], lists], ["node", "shard", "neighbours"])

    return members.groupBy("shard").applyInArrow(graph, "node long, shard string, neighbours array<bigint>")


def _found(members: DataFrame, united: DataFrame, threshold: float, beam: int) -> DataFrame:
    """node, near (linked nodes), links (linked vectors), root (the smallest node of its component there) for each shard in which
    it has links."""

    def search(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        x, node, n = unit(matrix(rows["vector"])), rows["node"].to_numpy(), rows["n"].to_numpy()
        size, flat = _widths(rows["neighbours"])
        at = np.minimum(np.searchsorted(node, flat), len(node) - 1)
        edges = _padded(size, np.where(node[at] == flat, at, -1))  # neighbours of other shards aren't here
        a, b = shard_links(x, edges, threshold, beam)
        here, shards = rows["shard"][0].as_py(), rows["shards"].to_pylist()
        alone = np.array([len(s) == 1 for s in shards])
        own = alone[a] | alone[b]
        kinds: dict = {}
        kind = np.array([kinds.setdefault(tuple(sorted(s)), len(kinds)) for s in shards])
        lists, both = [set(s) for s in kinds], np.flatnonzero(~own)
        codes, which = np.unique(kind[a[both]] * len(lists) + kind[b[both]], return_inverse=True)
        first = [min(lists[p] & lists[q]) == here for p, q in zip(*(v.tolist() for v in np.divmod(codes, len(lists))), strict=True)]
        own[both] = np.array(first, bool)[which]
        near, links = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for p, q in ((a[own], b[own]), (b[own], a[own])):
            np.add.at(near, p, 1)
            np.add.at(links, p, n[q])
        root = local_roots(len(x), a, b)
        some = np.zeros(len(x), bool)
        some[a] = some[b] = True
        columns = [node[some], near[some], links[some], node[root[some]]]
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], ["node", "near", "links", "root"])

    return members.join(united, "node").groupBy("shard").applyInArrow(search, "node long, near long, links long, root long")


def audited_recall(nodes: DataFrame, counted: DataFrame, threshold: float, audited: int = AUDITED) -> float:
    """The share of the links of at most twice `audited` nodes that were found; 1 if these have none. Half of them are taken from all nodes,
    half from those with links (node, near), by hash; their vectors meet all nodes in one scan."""
    order = F.xxhash64(F.lit(13), "node")
    linked = nodes.join(counted, "node").orderBy(order).limit(audited)
    any_ = nodes.join(counted, "node", "left").orderBy(order).limit(audited)
    sample = {r["node"]: r for r in any_.select("node", "label", "vector", F.coalesce("near", F.lit(0)).alias("near")).unionByName(linked.select("node", "label", "vector", "near")).collect()}
    by: dict = {}
    for r in sample.values():
        by.setdefault((str(r["label"]), len(r["vector"])), []).append((r["node"], r["vector"]))
    known = {k: (np.array([i for i, _ in v]), unit(np.array([x for _, x in v], float))) for k, v in by.items()}

    def count(batches):
        for batch in batches:
            label, node, size = batch.column("label").to_pylist(), batch.column("node").to_numpy(), _widths(batch.column("vector"))[0]
            labels = np.array(label, object)
            for (name, length), (ids, x) in known.items():
                at = np.flatnonzero((labels == name) & (size == length))
                if len(at):
                    good = (x @ unit(matrix(batch.column("vector").take(pa.array(at)))).T >= threshold) & (ids[:, None] != node[at])
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(good.sum(axis=1))], ["node", "c"])

    every = nodes.select("node", F.col("label").cast("string").alias("label"), "vector").mapInArrow(count, "node long, c long")
    true = {r["node"]: r["c"] for r in every.groupBy("node").agg(F.sum("c").alias("c")).collect()}
    total = sum(true.values())
    return sum(min(sample[k]["near"], c) for k, c in true.items()) / total if total else 1.0


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, attempts=ATTEMPTS, capacity: int = CAPACITY) -> DataFrame:
    """id, n_links, component_id, kept of every row of vectors (id, vector, label)."""
    spark, tables = vectors.sparkSession, common.Tables(vectors.sparkSession)
    common.bound_batches(spark)
    common.tidy_shuffles(spark)
    vector = F.col("vector").cast("array<double>")
    named = vectors.select("id", F.when(F.lit(True), vector).alias("vector"), "label")
    good = F.col("label").isNotNull()
    linkable = usable(named.where(good), "vector")
    keys = [F.xxhash64(F.lit(k), F.col("label").cast("string"), "vector").alias(f"h{k}") for k in (1, 2)]
    same = linkable.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.any_value("label").alias("label"), F.any_value("vector").alias("vector"))
    nodes = tables.write(same.withColumn("node", F.monotonically_increasing_id()), "nodes")
    for k, (guests, beam) in enumerate(attempts):
        members = tables.write(_shards(nodes, tables, guests, capacity, threshold), "members")
        graph = tables.write(_graph(members, threshold, beam), "graph")
        united = graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"), F.collect_list("shard").alias("shards"))
        found = tables.write(_found(members, united, threshold, beam), "found")
        tables.drop(members, graph)
        counted = found.groupBy("node").agg(F.sum("near").alias("near"), F.sum("links").alias("links"))
        recall = audited_recall(nodes, counted, threshold)
        if recall >= WANTED:
            break
        if k + 1 == len(attempts) and recall < LEAST:
            raise RuntimeError(f"the audit found {recall:.3f} of all links: give wider attempts")
    labels = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), tables)
    label = F.coalesce("c.label", "node").alias("component")
    classes = nodes.drop("vector", "label").join(labels.withColumnRenamed("key", "node").alias("c"), "node", "left").select("node", "h1", "h2", "n", "first", label)
    heads = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = classes.join(heads, "component").join(counted, "node", "left")
    links = (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")
    classes = common.written(classes.select("h1", "h2", "n", links, "component_id"), "classes")
    tables.drop(*[df for df, _ in list(tables.paths.values())])
    return _rows(named, keys, classes)


#: Classes with more than this share of all rows are sent to all executors; there are at most 1 / HOT of them.
HOT = 1e-4


def _rows(named: DataFrame, keys: list, classes: DataFrame) -> DataFrame:
    """The rows with their class's results. Rows of frequent classes are joined without moving."""
    total = classes.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = F.col("n") > max(8, HOT * total)
    linkable = usable(named.where(F.col("label").isNotNull()), "vector").select("id", *keys)
    many = F.broadcast(classes.where(hot).drop("n"))  # at most 1 / HOT rows
    one = linkable.join(many, ["h1", "h2"])
    rest = linkable.join(many.select("h1", "h2"), ["h1", "h2"], "left_anti").join(classes.where(~hot).drop("n"), ["h1", "h2"])
    v = F.col("vector")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    alone = named.where(~F.coalesce(F.col("label").isNotNull() & fine, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = reduce(DataFrame.unionByName, [one.drop("h1", "h2"), rest.drop("h1", "h2"), alone])
    return out.select("id", "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return near_duplicates(table.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"), "label")).withColumnRenamed("id", "vec_id")


ORACLE = f"""
WITH RECURSIVE good AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b)
SELECT vec_id, (SELECT count(*) FROM pairs WHERE a = vec_id) AS n_links, (SELECT min(b) FROM reach WHERE a = vec_id) AS component_id,
  vec_id = (SELECT min(b) FROM reach WHERE a = vec_id) AS kept FROM embeddings
"""
