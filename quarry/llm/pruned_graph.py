"""Embedding near-duplicates on a robust-pruned flat graph (operator 9).

Vectors of one label are dealt to overlapping clusters, each to its two nearest
centroids; clusters that the centroids' bounded sample leaves too large are dealt again, to
parts of their own. Every cluster builds a graph over its members: candidates by closeness,
thinned by robust pruning, which drops a neighbour that another one covers. The
adjacency lists of all clusters are united. Parts of a cluster that no edge joins, as
groups of more near copies than a node has candidates, are joined by their closest
pairs. Each vector then searches the united graph around its cluster: a greedy beam
from itself and the medoid finds its surroundings, and the range expands from there
along edges while vectors lie near the threshold.
Links are verified in double precision.

Equal vectors of one label are one node with a count. A link between two nodes
counts for all their copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, written

COSINE = 0.98
CLUSTER = 400  # members a cluster aims at
OVERLAP = 2
SAMPLE = 20_000  # vectors the centroids are fitted on, at most, over all labels
SPLIT = 4 * CLUSTER  # a cluster of more members is dealt again
PARTS = 16  # parts such a cluster is dealt to, at most
FIT = 2_000  # members that the centroids of its parts are fitted on, about
ROUNDS = 8  # times a cluster is dealt again, at most
DEGREE = 24
ALPHA = 1.2
BEAM = 24
SLACK = 0.05  # the range expands through vectors this much below the threshold
BLOCK = 256  # queries searched together in a task
AUDIT_BLOCK = 2_000  # queries that an audit compares at a time


def _matrix(column) -> np.ndarray:
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(x)
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
    return c


def robust_prune(near: np.ndarray, sims: np.ndarray, own: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of the candidates ``near`` (closest first, ``own`` their similarity to the
    vector) those that no kept one is ``alpha`` times closer to. ``sims``: among them."""
    far = np.sqrt(np.maximum(0, 2 - 2 * own))
    between = np.sqrt(np.maximum(0, 2 - 2 * sims))
    kept, alive = [], np.ones(len(near), bool)
    for i in range(len(near)):
        if not alive[i]:
            continue
        kept.append(i)
        if len(kept) == degree:
            break
        alive &= alpha * between[i] > far
    return near[kept]


def _parts(lists: list[set]) -> np.ndarray:
    """The connected part of each node, numbered from 0."""
    part = np.full(len(lists), -1)
    for i in range(len(lists)):
        if part[i] < 0:
            stack, part[i] = [i], part.max() + 1
            while stack:
                for j in lists[stack.pop()]:
                    if part[j] < 0:
                        part[j] = part[i]
                        stack.append(j)
    return part


def _join_parts(lists: list[set], x: np.ndarray) -> None:
    """Join the connected parts of ``lists``, each to the closest node outside it, until
    one is left: every round halves their number at least."""
    while (part := _parts(lists)).any():
        best = np.full(part.max() + 1, -np.inf)
        ends: list = [None] * len(best)
        for at in range(0, len(x), BLOCK):
            s = x[at : at + BLOCK] @ x.T
            s[part[at : at + BLOCK, None] == part] = -np.inf
            to = s.argmax(1)
            for r, j in enumerate(to.tolist()):
                own = part[at + r]
                if ends[own] is None or s[r, j] > best[own]:
                    best[own], ends[own] = s[r, j], (at + r, j)
        for i, j in ends:
            lists[i].add(j)
            lists[j].add(i)


def _build(degree: int, alpha: float):
    """Adjacency lists of one cluster: (node, neighbours), in both directions; one
    connected graph."""

    def run(key, table):
        ids = table.column("node").to_numpy()
        x = _matrix(table.column("unit"))
        n, width = len(ids), min(4 * degree, len(ids) - 1)
        lists: list[set] = [set() for _ in range(n)]
        for at in range(0, n, BLOCK):
            s = x[at : at + BLOCK] @ x.T
            s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
            near = np.argpartition(-s, width - 1, axis=1)[:, :width] if 0 < width < n - 1 else np.argsort(-s, 1)[:, :width]
            for r in range(len(s)):
                c = near[r][np.lexsort((near[r], -s[r, near[r]]))]
                for j in robust_prune(c, x[c] @ x[c].T, s[r, c], degree, alpha):
                    lists[at + r].add(int(j))
                    lists[int(j)].add(at + r)
        _join_parts(lists, x)
        return pa.table({
            "node": pa.array(ids, pa.int64()),
            "near": pa.array([ids[sorted(v)].tolist() for v in lists], pa.list_(pa.int64())),
        })

    return run


def _fit_parts(key, table):
    """The centroids of one large cluster's parts, from a sample of its members."""
    x = _matrix(table.column("unit").take(pa.array(np.argsort(table.column("node").to_numpy()))))
    wanted = -(-table.column("n")[0].as_py() * OVERLAP // CLUSTER)
    centres = _kmeans(x, min(len(x), PARTS, max(2, wanted)))
    return pa.table({"label": pa.array([key[0].as_py()], key[0].type), "dim": pa.array([key[1].as_py()], pa.int32()),
                     "cluster": pa.array([key[2].as_py()], pa.int64()), "centres": pa.array([centres.ravel()])})


def _deal_parts(batches):
    """Members of large clusters (with ``centres``) dealt to parts: those at home to their
    two nearest, others to one. The rest keep their clusters; all are numbered anew."""
    for batch in batches:
        centres, units = batch.column("centres"), batch.column("unit")
        at_home, old = batch.column("home").to_pylist(), batch.column("cluster").to_pylist()
        cluster, members, home = [], [], []
        for i, was in enumerate(old):
            near = [-1]
            if centres[i].is_valid:
                v = units[i].values.to_numpy()
                c = centres[i].values.to_numpy().reshape(-1, len(v))
                near = np.argsort(-(c @ v), kind="stable")[: OVERLAP if at_home[i] else 1].tolist()
            for rank, j in enumerate(near):
                cluster.append(was * (PARTS + 1) + j + 1)
                members.append(i)
                home.append(at_home[i] and rank == 0)
        rows = batch.select(["node", "label", "unit", "dim"]).take(pa.array(members, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*rows.columns, pa.array(cluster, pa.int64()), pa.array(home, pa.bool_())],
            names=[*rows.schema.names, "cluster", "home"],
        )


def _search(cosine: float, beam: int, slack: float):
    """Links found by the members of one cluster on the graph around it."""

    def run(key, table):
        part = table.column("home").to_numpy(zero_copy_only=False).astype(bool)
        ids = table.column("node").to_numpy()
        order = np.lexsort((~part, ids))  # a node that is both member and halo: once
        first = order[np.r_[True, ids[order][1:] != ids[order][:-1]]] if len(order) else order
        table = table.take(pa.array(first))
        ids, part = ids[first], part[first]
        x = _matrix(table.column("unit"))
        lists = table.column("near").combine_chunks()
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        size = np.diff(lists.offsets.to_numpy())
        at = np.searchsorted(ids, flat)
        at[at == len(ids)] = 0
        here = ids[at] == flat  # neighbours beyond the halo are searched from their own clusters
        owner = np.repeat(np.arange(len(ids)), size)[here]
        flat = at[here]
        size = np.bincount(owner, minlength=len(ids))
        start = np.cumsum(size) - size
        members = np.flatnonzero(part)
        if not len(members):  # a cluster that is nobody's closest: its nodes are searched from their own
            none = pa.array([], pa.int64())
            return pa.table({"a": none, "b": none})
        centre = x[members].mean(0)
        medoid = members[np.argmax(x[members] @ centre)]
        width = int(size.max(initial=0))
        padded = np.full((len(ids), max(width, 1)), -1, np.int64)
        padded[owner, np.arange(len(flat)) - start[owner]] = flat
        out_a, out_b = [], []
        for q0 in range(0, len(members), BLOCK):
            q = members[q0 : q0 + BLOCK]
            rows = np.arange(len(q))[:, None]
            seen = np.zeros((len(q), len(ids)), bool)
            sims = np.full((len(q), len(ids)), -2.0)

            def visit(r, c):
                fresh = ~seen[r, c]
                r, c = r[fresh], c[fresh]
                seen[r, c] = True  # a node met twice in one step is computed twice, to the same value
                sims[r, c] = np.einsum("ij,ij->i", x[q[r]], x[c])
                return r, c

            start_r = np.arange(len(q))
            visit(start_r, np.full(len(q), medoid))
            visit(start_r, q)  # a group of near copies may lie off every path from the medoid
            expanded = np.zeros_like(seen)
            while True:  # greedy: expand the best unexpanded nodes of every beam
                top = np.argpartition(-sims, min(beam, len(ids)) - 1, axis=1)[:, :beam]
                todo = seen[rows, top] & ~expanded[rows, top]
                r, k = np.nonzero(todo)
                if not len(r):
                    break
                c = top[r, k]
                expanded[r, c] = True
                near = padded[c]
                rr = np.repeat(r, near.shape[1])
                cc = near.ravel()
                visit(rr[cc >= 0], cc[cc >= 0])
            while True:  # range: expand everything near the threshold
                r, c = np.nonzero(seen & ~expanded & (sims >= cosine - slack))
                if not len(r):
                    break
                expanded[r, c] = True
                for i in range(0, len(r), 20_000):
                    near = padded[c[i : i + 20_000]]
                    rr = np.repeat(r[i : i + 20_000], near.shape[1])
                    cc = near.ravel()
                    visit(rr[cc >= 0], cc[cc >= 0])
            r, c = np.nonzero(sims >= cosine)
            keep = q[r] != c
            out_a.append(ids[q[r[keep]]])
            out_b.append(ids[c[keep]])
        a = np.concatenate(out_a) if out_a else np.zeros(0, np.int64)
        b = np.concatenate(out_b) if out_b else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return run


class FlatGraph:
    """The index of ``vectors(vec_id, embedding, label)``; ``nodes``, ``placed`` and
    ``lists`` are tables in the shared folder."""

    def __init__(self, vectors: DataFrame, cosine: float = COSINE, degree: int = DEGREE, alpha: float = ALPHA):
        self.spark = vectors.sparkSession
        self.cosine, self.degree, self.alpha = cosine, degree, alpha
        x = vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.col("label"),
            F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0)).alias("v"),
        )
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, v: s + v * v))
        usable = (
            F.col("label").isNotNull()
            & F.col("vec_id").isNotNull()
            & F.col("v").isNotNull()
            & F.coalesce(F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
        )
        self.rows = x.select("vec_id", "label", "v", usable.alias("ok"))
        # scaled by the largest component first: no square overflows
        top = F.array_max(F.transform("v", F.abs))
        scaled = self.rows.where("ok").withColumn("top", top).where("top > 0").withColumn(
            "v", F.expr("transform(v, c -> c / top)")
        )
        unit = scaled.withColumn("norm", norm).select(
            "vec_id", "label", F.expr("transform(v, c -> c / norm)").alias("unit")
        )
        self.unit = written(unit)
        self.nodes = written(
            self.unit.groupBy("label", "unit").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
        )

    def build(self) -> None:
        counts = {r["label"]: r["n"] for r in self.nodes.groupBy("label").agg(F.count("*").alias("n")).toLocalIterator()}
        total = sum(counts.values())
        share = min(1.0, SAMPLE / total) if total else 1.0
        sample = (
            self.nodes.where(F.pmod(F.xxhash64("node", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)))
            .limit(2 * SAMPLE)
            .toArrow()
        )
        labels = np.array(sample.column("label").to_pylist(), object)
        dims = np.array([len(v) for v in sample.column("unit").to_pylist()], np.int64)
        centroids: dict = {}
        for label, n in counts.items():
            of = np.flatnonzero(labels == label)
            for d in np.unique(dims[of]):
                x = _matrix(sample.column("unit").take(pa.array(of[dims[of] == d])))
                k = max(1, min(len(x), -(-n * OVERLAP // CLUSTER)))
                centroids[(label, int(d))] = _kmeans(x, k)
        shared = self.spark.sparkContext.broadcast(centroids)  # SAMPLE vectors at most

        def place(batches):
            for batch in batches:
                cluster, members = [], []
                label = batch.column("label").to_pylist()
                for i, v in enumerate(batch.column("unit").to_pylist()):
                    c = shared.value.get((label[i], len(v)))
                    near = np.argsort(-(c @ np.array(v)), kind="stable")[:OVERLAP] if c is not None else [0]
                    for rank, j in enumerate(near):
                        cluster.append((int(j), rank == 0))
                        members.append(i)
                rows = batch.take(pa.array(members, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array([len(v) for v in rows.column("unit").to_pylist()], pa.int32()),
                     pa.array([c for c, _ in cluster], pa.int64()), pa.array([h for _, h in cluster], pa.bool_())],
                    names=[*rows.schema.names, "dim", "cluster", "home"],
                )

        kind = dict(self.nodes.dtypes)["label"]
        self.placed = self._divided(written(
            self.nodes.select("node", "label", "unit").mapInArrow(
                place, f"node long, label {kind}, unit array<double>, dim int, cluster long, home boolean"
            )
        ))
        parts = self.placed.groupBy("label", "dim", "cluster").applyInArrow(
            _build(self.degree, self.alpha), "node long, near array<bigint>"
        )
        # OVERLAP lists a node, of bounded length but for hubs of the reverse edges
        self.lists = written(parts.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))

    def _divided(self, placed: DataFrame) -> DataFrame:
        """``placed`` with every cluster above :data:`SPLIT` members dealt to parts, and these
        again. Nothing is left out: a cluster that cannot be parted stays whole."""
        key = ["label", "dim", "cluster"]
        kind = dict(placed.dtypes)["label"]
        for _ in range(ROUNDS):
            sizes = placed.groupBy(*key).agg(F.count("*").alias("n"))
            large = written(sizes.where(F.col("n") > SPLIT))
            if large.isEmpty():
                break
            sample = placed.join(large, key).where(F.expr(f"pmod(xxhash64(node, 'part'), n) < {FIT}"))
            centres = written(
                sample.select(*key, "node", "unit", "n").groupBy(*key).applyInArrow(
                    _fit_parts, f"label {kind}, dim int, cluster long, centres array<double>"
                )
            )
            placed = written(placed.join(centres, key, "left").mapInArrow(_deal_parts, placed.schema))
        return placed

    def links(self) -> DataFrame:
        """``(a, b)`` with a < b: linked nodes, each pair once."""
        self.build()
        member = self.placed.select("label", "dim", "cluster", "node", "home")
        with_lists = member.join(self.lists, "node")
        # the halo: neighbours outside the cluster that its members' lists name
        halo = (
            with_lists.select("label", "dim", "cluster", F.explode("near").alias("node"))
            .distinct()
            .join(member.select("label", "dim", "cluster", "node"), ["label", "dim", "cluster", "node"], "left_anti")
            .withColumn("home", F.lit(False))
        )
        unit = self.nodes.select("node", "unit")
        around = member.unionByName(halo).join(self.lists, "node").join(unit, "node")
        found = around.groupBy("label", "dim", "cluster").applyInArrow(
            _search(self.cosine, BEAM, SLACK), "a long, b long"
        )
        return found.distinct()


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id,
    embedding, label)``.

    Only vectors of one label, with as many components, are compared; they link at
    ``cosine`` or above, in double precision.

    * a vector that is null, zero, or holds a null or non-finite component, or whose
      label is null, links with nothing: 0 links, its own component, kept;
    * a null vec_id links with nothing and has a null component;
    * equal vectors of one label: linked with each other, one node of the graph;
    * rows that repeat a vec_id are vectors of their own with that id;
    * an empty table gives no rows; other columns are ignored.
    """
    graph = FlatGraph(vectors, cosine)
    links = written(graph.links())
    copies = graph.nodes.select("node", "copies")
    both = links.union(links.select("b", "a"))
    degree = (
        both.join(copies.select(F.col("node").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("more"))
    )
    comp = components(links)
    facts = written(
        graph.nodes.join(degree, F.col("node") == F.col("a"), "left")
        .join(comp, F.col("node") == F.col("id"), "left")
        .select(
            F.col("label").alias("l"),
            F.col("unit").alias("u"),
            (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    linked = graph.unit.join(facts, (F.col("label") == F.col("l")) & (F.col("unit") == F.col("u"))).select(
        "vec_id", "n_links", "component_id"
    )
    zero = F.coalesce(F.array_max(F.transform("v", F.abs)) == 0, F.lit(True))
    rest = graph.rows.where(~F.col("ok") | zero).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def audit(vectors: DataFrame, cosine: float = COSINE, every: int = 50, links: DataFrame | None = None) -> dict:
    """Recall of the graph's links: the vectors whose vec_id ``every`` divides, against
    all others of their label by brute force, a block of queries at a time. ``links(a,
    b)`` are the graph's own unless given. No links to find count as recall 1."""
    graph = FlatGraph(vectors, cosine)
    links = written(graph.links()) if links is None else links
    asked = graph.unit.where(F.pmod("vec_id", F.lit(every)) == 0).select("label", "unit").distinct()
    asked = written(graph.nodes.join(asked, ["label", "unit"], "left_semi").select("node", "label", "unit"))
    queries = asked.count()
    blocks = -(-queries // AUDIT_BLOCK)
    true = found = 0
    for b in range(blocks):
        by: dict = {}
        for r in asked.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == b).toLocalIterator():
            ids, rows = by.setdefault((r["label"], len(r["unit"])), ([], []))
            ids.append(r["node"])
            rows.append(r["unit"])
        block = {k: (np.array(ids), np.array(rows)) for k, (ids, rows) in by.items()}
        shared = graph.spark.sparkContext.broadcast(block)

        def pairs(batches, shared=shared):
            for batch in batches:
                nodes, units = batch.column("node").to_pylist(), batch.column("unit").to_pylist()
                of: dict = {}
                for i, label in enumerate(batch.column("label").to_pylist()):
                    of.setdefault((label, len(units[i])), []).append(i)
                for k, rows in of.items():
                    if k in shared.value:
                        ids, q = shared.value[k]
                        here = np.array([nodes[i] for i in rows])
                        x, y = np.nonzero(q @ np.array([units[i] for i in rows]).T >= cosine)
                        x, y = ids[x], here[y]
                        x, y = x[x != y], y[x != y]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(x, pa.int64()), pa.array(np.minimum(x, y), pa.int64()), pa.array(np.maximum(x, y), pa.int64())],
                            names=["q", "a", "b"],
                        )

        want = written(graph.nodes.select("node", "label", "unit").mapInArrow(pairs, "q long, a long, b long"))
        true += want.count()
        found += want.join(links, ["a", "b"], "left_semi").count()
    return {"queries": queries, "true": true, "found": found, "recall": found / true if true else 1.0}
