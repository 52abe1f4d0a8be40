"""Near-duplicate vectors: a navigable small-world graph for every shard, and every vector asks every shard.

Equal vectors are one node with a number of copies. A shard's graph has layers, each a sixteenth of the
one below; a search walks down from the top with a beam. Before a block of queries is searched, some of
them are also compared with the whole shard: while the beam misses any of their links it is doubled,
until it would hold the shard and the comparison is made in full. Around every link found, the graph is
followed through all further links, so a beam need not be as wide as a group of copies. Cosines are
confirmed in double precision. A task returns counts and a spanning forest, never all pairs.

A graph is written as one narrow row for each node. A task reads the rows of one shard, then queries block by block,
so it holds one graph and one block, and a graph is sent once for many blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from soundcheck.llm.components import components, forest
from soundcheck.session import materialise

ROWS_PER_SHARD = 100_000
LEAST_SHARDS = 8
QUERIES_PER_TASK = 8_192  # of a block, which is audited by itself
BLOCKS_PER_TASK = 16
LEAST_TASKS = 32
MOST_PARTS = 10_000  # of the shuffle; a part may hold several tasks' rows, one after the other
LAYER = 16  # a layer has this many times fewer nodes than the one below
NEIGHBOURS = 24
BUILD_BEAM = 48
FIRST_BEAM = 16
AUDITED = 256  # queries of a block that are compared with the whole shard
AT_ONCE = 256
EXHAUSTIVE_AT_ONCE = 64  # queries that are compared with the whole shard
NODES_AT_ONCE = 1_024  # that choose their neighbours
WIDTH = 4  # nodes that a step expands for each query
SLACK = 1e-4  # for cosines in single precision


def layer_sizes(n: int) -> list[int]:
    """Nodes in each layer, from the bottom up."""
    sizes = [n]
    while sizes[-1] > 4 * LAYER:
        sizes.append(sizes[-1] // LAYER)
    return sizes


class Graph:
    """Unit vectors in order of their layer: layer k holds the first ``sizes[k]``; ``links[k]`` are its neighbours, -1 for none."""

    def __init__(self, units: np.ndarray, sizes: list[int], links: list[np.ndarray]):
        self.units, self.sizes, self.links = units, sizes, links
        self.back = None  # of the bottom layer: nodes that link to each, and where theirs begin

    @classmethod
    def build(cls, units: np.ndarray) -> Graph:
        sizes = layer_sizes(len(units))
        graph = cls(units, sizes, [np.full((n, NEIGHBOURS), -1, np.int32) for n in sizes])
        for layer in reversed(range(len(sizes))):
            graph.fill(layer)
        return graph

    def fill(self, layer: int) -> None:
        size, links, done = self.sizes[layer], self.links[layer], 0
        while done < size:
            new = np.arange(done, min(size, done + min(max(done, 64), 512)))
            inner = self.units[new] @ self.units[new].T
            np.fill_diagonal(inner, -2)
            near = np.argsort(-inner, axis=1)[:, :NEIGHBOURS]
            ids, sims = new[near], np.take_along_axis(inner, near, axis=1)
            if done:
                found, found_sims = self.beam(layer, self.units[new], self.descend(self.units[new], layer), BUILD_BEAM, done)
                ids, sims = np.concatenate([ids, found], axis=1), np.concatenate([sims, found_sims], axis=1)
            links[new] = self.choose(ids, sims)
            self.answer(links, new)
            done = new[-1] + 1
        self.connect(links)

    def connect(self, links: np.ndarray) -> None:
        """Nodes that can't be reached from the first one take the last place among their nearest reachable neighbour's."""
        for _ in range(8):
            seen, edge = np.zeros(len(links), bool), np.zeros(1, np.int64)
            while len(edge):
                seen[edge] = True
                edge = np.unique(links[edge])
                edge = edge[edge >= 0]
                edge = edge[~seen[edge]]
            lost = np.flatnonzero(~seen)
            if not len(lost):
                return
            reach = np.where((links[lost] >= 0) & seen[links[lost]], links[lost], -1)
            able = np.flatnonzero((reach >= 0).any(axis=1))
            near = reach[able, (reach[able] >= 0).argmax(axis=1)]
            links[near, NEIGHBOURS - 1] = lost[able]

    def choose(self, ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Neighbours for each row: those nearer to it than to a neighbour already chosen, then the nearest of the rest."""
        order = np.argsort(-np.where(ids < 0, -3, sims), axis=1)[:, :2 * NEIGHBOURS]
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        sims = np.where(ids < 0, -3, sims)
        own = self.units[np.maximum(ids, 0)]
        between = own @ own.transpose(0, 2, 1)
        chosen = np.zeros(ids.shape, bool)
        closest = np.full(ids.shape, -2, np.float32)  # to anything chosen
        for c in range(ids.shape[1]):
            take = (sims[:, c] > closest[:, c]) & (ids[:, c] >= 0) & (chosen.sum(axis=1) < NEIGHBOURS)
            chosen[:, c] = take
            closest = np.where(take[:, None], np.maximum(closest, between[:, :, c]), closest)
        rank = np.argsort(~chosen, axis=1, kind="stable")[:, :NEIGHBOURS]
        out = np.full((len(ids), NEIGHBOURS), -1, np.int32)
        out[:, :rank.shape[1]] = np.take_along_axis(ids, rank, axis=1)
        return out

    def answer(self, links: np.ndarray, new: np.ndarray) -> None:
        """Neighbours of ``new`` get links back, and choose again among all they have."""
        a = np.repeat(new, NEIGHBOURS)
        b = links[new].reshape(-1)
        a, b = a[b >= 0], b[b >= 0]
        sims = np.einsum("ij,ij->i", self.units[a], self.units[b])
        order = np.lexsort((-sims, b))
        a, b, sims = a[order], b[order], sims[order]
        nodes, starts = np.unique(b, return_index=True)
        place = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
        extra = np.full((len(nodes), NEIGHBOURS), -1, np.int64)
        fits = place < NEIGHBOURS
        extra[np.searchsorted(nodes, b[fits]), place[fits]] = a[fits]
        old = links[nodes].astype(np.int64)
        extra[(extra[:, :, None] == old[:, None, :]).any(axis=2)] = -1
        both = np.concatenate([old, extra], axis=1)
        for i in range(0, len(nodes), NODES_AT_ONCE):
            own, some = nodes[i:i + NODES_AT_ONCE], both[i:i + NODES_AT_ONCE]
            near = np.einsum("ijk,ik->ij", self.units[np.maximum(some, 0)], self.units[own])
            links[own] = self.choose(some, near)

    def descend(self, queries: np.ndarray, layer: int) -> np.ndarray:
        """Entry nodes for ``layer``, found in the layers above."""
        entries = np.zeros((len(queries), 1), np.int64)
        for above in range(len(self.sizes) - 1, layer, -1):
            entries = self.beam(above, queries, entries, 8, self.sizes[above])[0]
        return entries

    def beam(self, layer: int, queries: np.ndarray, entries: np.ndarray, width: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest nodes found for each query, best first (-1 for none), and their cosines."""
        links, n = self.links[layer], len(queries)
        rows = np.arange(n)[:, None]
        ids = np.full((n, width), -1, np.int64)
        sims = np.full((n, width), -3, np.float32)
        seen = np.zeros((n, size + 1), bool)  # the last column is for "none"
        opened = np.ones((n, width), bool)
        fresh = np.where(entries < size, entries, -1)
        active = np.arange(n)
        while len(active):
            fresh = np.where(seen[active[:, None], fresh], -1, fresh)
            fresh.sort(axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
            seen[active[:, None], fresh] = True
            seen[:, size] = False
            near = np.einsum("ijk,ik->ij", self.units[np.maximum(fresh, 0)], queries[active])
            near[fresh < 0] = -3
            all_ids, all_sims = np.concatenate([ids[active], fresh], axis=1), np.concatenate([sims[active], near], axis=1)
            all_opened = np.concatenate([opened[active], fresh < 0], axis=1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            at = rows[:len(active)]
            ids[active], sims[active], now = all_ids[at, best], all_sims[at, best], all_opened[at, best]
            rank = np.cumsum(~now, axis=1)
            turn = ~now & (rank <= WIDTH)
            opened[active] = now | turn
            going = turn.any(axis=1)
            turn, active = turn[going], active[going]
            if not len(active):
                break
            picked = np.full((len(active), WIDTH), -1, np.int64)
            r, c = np.nonzero(turn)
            picked[r, (np.cumsum(turn, axis=1) - 1)[r, c]] = ids[active][r, c]
            fresh = np.where(picked[:, :, None] < 0, -1, links[np.maximum(picked, 0)]).reshape(len(active), -1).astype(np.int64)
            fresh[fresh >= size] = -1
        return ids, sims

    def around(self, query: np.ndarray, nodes: np.ndarray, least: float) -> np.ndarray:
        """All nodes with a cosine of ``least`` that links of the bottom layer, either way, join with ``nodes`` through such nodes."""
        if self.back is None:
            flat = self.links[0].reshape(-1)
            order = np.argsort(flat, kind="stable")
            self.back = order // NEIGHBOURS, np.searchsorted(flat[order], np.arange(len(self.units) + 1))
        sources, starts = self.back
        seen = np.zeros(len(self.units), bool)
        seen[nodes] = True
        found, edge = [nodes], nodes
        while len(edge):
            first, many = starts[edge], starts[edge + 1] - starts[edge]
            into = sources[np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())]
            near = np.unique(np.concatenate([self.links[0][edge].reshape(-1), into]))
            near = near[near >= 0]
            near = near[~seen[near]]
            seen[near] = True
            edge = near[self.units[near] @ query >= least]
            found.append(edge)
        return np.concatenate(found)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """In double precision, by a power of two each, so that squares neither overflow nor vanish and nothing is rounded."""
    wide = vectors.astype(np.float64)
    return np.ldexp(wide, -np.frexp(np.abs(wide).max(axis=1, keepdims=True))[1])


def units(wide: np.ndarray) -> np.ndarray:
    """Of ``scaled`` vectors."""
    made = np.empty(wide.shape, np.float32)
    for i in range(0, len(wide), NODES_AT_ONCE):
        rows = wide[i:i + NODES_AT_ONCE]
        made[i:i + NODES_AT_ONCE] = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    return made


def linked(graph: Graph, wide: np.ndarray, norms: np.ndarray, exact: np.ndarray, least: float):
    """Yields (first query, list of linked shard nodes for each query), with an audited beam. ``wide``: the shard's
    vectors and ``exact``: the queries, both as ``scaled`` gives them; ``norms``: of ``wide``."""
    asked = units(exact)

    def confirm(i: int, nodes: np.ndarray) -> np.ndarray:
        q = exact[i]
        return nodes[wide[nodes] @ q >= least * (norms[nodes] * np.linalg.norm(q))]

    def exhaustive(rows: np.ndarray) -> list[np.ndarray]:
        found = []
        for k in range(0, len(rows), EXHAUSTIVE_AT_ONCE):
            some = rows[k:k + EXHAUSTIVE_AT_ONCE]
            sims = asked[some] @ graph.units.T >= least - SLACK
            found += [confirm(i, np.flatnonzero(s)) for i, s in zip(some, sims)]
        return found

    def search(rows: np.ndarray, width: int) -> list[np.ndarray]:
        if width >= len(wide):
            return exhaustive(rows)
        ids, sims = graph.beam(0, asked[rows], graph.descend(asked[rows], 0), width, len(wide))
        near = (sims >= least - SLACK) & (ids >= 0)
        return [confirm(i, graph.around(asked[i], ids[k][near[k]], least - SLACK)) if near[k].any() else np.zeros(0, np.int64)
                for k, i in enumerate(rows)]

    sample = np.unique(np.linspace(0, len(exact) - 1, min(AUDITED, len(exact))).astype(np.int64))
    truth, width = exhaustive(sample), FIRST_BEAM
    while width < len(wide) and any(len(a) < len(b) for a, b in zip(search(sample, width), truth)):
        width *= 2
    for i in range(0, len(exact), AT_ONCE):
        rows = np.arange(i, min(i + AT_ONCE, len(exact)))
        yield i, search(rows, width)


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """(key, rows) of every key in turn; the first ``keys`` columns are whole numbers, by which the rows come sorted."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        found = np.stack([batch.column(c).to_numpy() for c in range(keys)], axis=1)
        ends = [0, *(np.flatnonzero((found[1:] != found[:-1]).any(axis=1)) + 1).tolist(), len(found)]
        for start, end in zip(ends, ends[1:]):
            key = tuple(found[start].tolist())
            if held and key != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(start, end - start))
    if held:
        yield now, pa.Table.from_batches(held)


def build_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each (dim, shard) by class, with their node and its links in all layers, from the bottom up. Classes
    are hashes, so layers are random."""
    for (dim, _), table in runs(batches, 2):
        graph = Graph.build(units(scaled(matrix(table["vector"], dim))))
        layers = np.add.reduce([np.arange(len(table)) < n for n in graph.sizes], dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(layers)])
        links = np.empty((ends[-1], NEIGHBOURS), np.int32)
        for k, n in enumerate(graph.sizes):
            links[ends[:n] + k] = graph.links[k]
        made = table.append_column("node", pa.array(np.arange(len(table), dtype=np.int32))).append_column(
            "links", pa.ListArray.from_arrays(pa.array((ends * NEIGHBOURS).astype(np.int32)), pa.array(links.reshape(-1))))
        yield from made.to_batches(max_chunksize=QUERIES_PER_TASK)


def load_index(table: pa.Table, dim: int) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Graph, vectors (``scaled``), their norms, classes and copies, from the rows of all nodes in turn."""
    wide = scaled(matrix(table["vector"], dim))
    sizes = layer_sizes(len(wide))
    column = table["links"].combine_chunks()
    flat = column.flatten().to_numpy().reshape(-1, NEIGHBOURS)
    starts = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy() // NEIGHBOURS)])
    links = [flat[starts[:n] + k] for k, n in enumerate(sizes)]
    return Graph(units(wide), sizes, links), wide, np.linalg.norm(wide, axis=1), table["class"].to_numpy(), table["copies"].to_numpy()


def search_index(least: float):
    """Over rows by dim, shard, slice and block: those of block -1 are the shard's graph, the others queries."""
    def told(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(3)], names=["u", "v", "links"])

    def tree(classes: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
        other = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(classes[other]), pa.array(classes[root[other]]),
                                           pa.array(np.zeros(len(other), np.int64))], names=["u", "v", "links"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = classes = root = None
        for (*at, block), table in runs(batches, 4):
            if block < 0:
                if loaded:
                    yield tree(classes, root)
                graph, wide, norms, classes, copies = load_index(table, at[0])
                loaded, root = at, np.arange(len(wide))
            elif loaded == at:  # else the shard has no vector of this length
                out, ids = [], table["class"].to_numpy()
                for start, found in linked(graph, wide, norms, scaled(matrix(table["vector"], at[0])), least):
                    pairs = [np.stack([np.arange(len(root)), root], axis=1)]
                    for k, nodes in enumerate(found):
                        if len(nodes):
                            out.append((int(ids[start + k]), int(classes[nodes[0]]), int(copies[nodes].sum())))
                            pairs.append(np.stack([nodes, np.full(len(nodes), nodes[0])], axis=1))
                    root = forest(root, np.concatenate(pairs))
                yield told(out)
        if loaded:
            yield tree(classes, root)

    return search


def usable(vector: Column) -> Column:
    """Not null, not empty, every component finite, some not zero."""
    return vector.isNotNull() & F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding",
                 rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (smallest id in reach), kept, for every row.

    Rows are linked at a cosine of ``least`` or more. Vectors that are null, empty, zero or hold null
    or non-finite components, and rows with a null id, link with nothing; vectors of different
    lengths never link. Equal vectors are linked and are one node of the graphs; repeated rows are
    vectors of their own. A null id gives a null component_id and is kept. An empty table gives no
    rows. Only the two named columns are read.
    """
    given = vectors.schema[vector_col].dataType
    kept = "array<float>" if isinstance(getattr(given, "elementType", None), T.FloatType) else "array<double>"
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.withColumn("class", F.when(usable(F.col("vector")) & F.col("vec_id").isNotNull(), F.xxhash64("vector")))
    nodes = materialise(rows.where("class IS NOT NULL").groupBy("class").agg(
        F.first(F.col("vector").cast(kept)).alias("vector"), F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")).withColumn(
        "dim", F.size("vector").cast("int")), "vectors")
    n = nodes.count()
    shards, blocks = max(LEAST_SHARDS, math.ceil(n / rows_per_shard)), max(1, math.ceil(n / QUERIES_PER_TASK))
    slices = min(blocks, max(math.ceil(blocks / BLOCKS_PER_TASK), math.ceil(LEAST_TASKS / shards)))
    members = nodes.select("dim", F.pmod(F.xxhash64("class", F.lit("shard")), F.lit(shards)).cast("int").alias("shard"), "class", "copies", "vector")
    index = materialise(members.repartition(2 * shards, "dim", "shard").sortWithinPartitions("dim", "shard", "class").mapInArrow(
        build_index, f"dim int, shard int, class long, copies long, vector {kept}, node int, links array<int>"), "index")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    asked = nodes.select("dim", "class", "vector", F.pmod(F.xxhash64("class", F.lit("query")), F.lit(blocks)).cast("int").alias("block")).withColumn(
        "slice", F.pmod("block", F.lit(slices)).cast("int")).withColumn("shard", every(shards))
    both = index.withColumn("slice", every(slices)).withColumn("block", F.lit(-1)).unionByName(asked, allowMissingColumns=True)
    found = materialise(both.select("dim", "shard", "slice", "block", "class", "copies", "vector", "node", "links").repartition(
        min(MOST_PARTS, 2 * shards * slices), "dim", "shard", "slice").sortWithinPartitions("dim", "shard", "slice", "block", "node", "class").mapInArrow(
        search_index(least), "u long, v long, links long"), "found")

    counts = found.groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "class")  # each vector finds its own copies too
    parts = components(found.select("u", "v"))
    grouped = nodes.select("class", "vec_id").join(parts, F.col("class") == F.col("node"), "left").select(
        "class", "vec_id", F.coalesce("component", "class").alias("component"))
    least_id = grouped.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    placed = grouped.join(least_id, "component").select("class", "component_id").join(counts, "class", "left")
    return rows.select("vec_id", "class").join(placed, "class", "left").select(
        "vec_id", F.greatest(F.coalesce("links", F.lit(1)) - 1, F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
