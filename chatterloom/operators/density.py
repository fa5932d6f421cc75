"""Topics from the density of text embeddings, without a number of topics given in advance.

1. Equal vectors become one point with a weight.
2. Several random trees cut space into leaves of bounded size, each level by quantiles along a random
   direction. A leaf finds the distance of its points to their n-th neighbour; the least over the trees is the
   core distance. A leaf is the only place where points are compared with each other.
3. Every leaf hands on the spanning tree of its points under mutual reachability, the greatest of their
   distance and their core distances. Borůvka rounds make one spanning forest of these trees.
4. The forest is read from its shortest edge up. A part that reaches `min_size` rows is a cluster; two clusters
   that meet end and begin their parent; smaller parts fall to the cluster that they meet. Edges are taken in
   bands of bounded size, and in a band every connected part is a group of its own.
5. Of the tree of clusters those with most excess of mass are kept, never a cluster and its parent. Rows
   whose first cluster is above a kept one are outliers.

With one leaf the result is that of the complete graph. With more, a tree may miss a neighbour across a cut; other
trees cut elsewhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterloom.operators.clusters import OUTLIER
from chatterloom.operators.evaluate import compute_once
from chatterloom.sources.shipping import ship_package
from chatterloom.sources.staging import StagingArea

#: Points of a leaf at most, and trees.
LEAF_POINTS, TREES = 2_000, 4
#: Parts into which a level cuts a node at most, and levels after which a node is left as it is.
FAN_OUT, MAX_LEVELS = 16, 40
#: Edges of the forest that are read at once.
BAND_EDGES = 2_000_000
#: Distances below this count as this, so that densities are finite.
LEAST_DISTANCE = 1e-9


def unit_vectors(df: DataFrame, vector_col: str, output: str) -> DataFrame:
    """Add the vector scaled to length one as an array of doubles; null where it holds no usable numbers."""
    usable = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    values = compute_once(df, {"_values": F.when(usable, F.transform(vector_col, lambda x: x.cast("double")))})
    norm = F.sqrt(F.aggregate("_values", F.lit(0.0), lambda total, x: total + x * x))
    normed = compute_once(values, {"_norm": F.when(norm > 0, norm).otherwise(F.lit(1.0))})
    return normed.withColumn(output, F.transform("_values", lambda x: x / F.col("_norm"))).drop("_values", "_norm")


def reduced_vectors(df: DataFrame, column: str, dimensions: int | None) -> DataFrame:
    """`column` projected on its main directions; as it is without `dimensions` or where they are no fewer."""
    size = df.where(F.col(column).isNotNull()).select(F.size(column).alias("n")).first()
    if dimensions is None or size is None or size["n"] <= dimensions:
        return df
    vectors = df.withColumn("_vector", array_to_vector(column))
    model = PCA(k=dimensions, inputCol="_vector", outputCol="_reduced").fit(vectors.where(F.col(column).isNotNull()))
    # Nulls would stop the projection; they are no vectors and stay apart.
    with_vector = model.transform(vectors.where(F.col(column).isNotNull())).withColumn(column, vector_to_array("_reduced"))
    without = vectors.where(F.col(column).isNull())
    return with_vector.select(*df.columns).unionByName(without.select(*df.columns))


def _dot(column: str, direction: Sequence[float]) -> Column:
    terms = F.zip_with(column, F.array(*map(F.lit, direction)), lambda x, y: x * y)
    return F.aggregate(terms, F.lit(0.0), lambda total, x: total + x)


def leaves(points: DataFrame, dimensions: int, area: StagingArea, leaf_points: int, trees: int, seed: int) -> DataFrame:
    """`(tree, node, id, weight, vector)`: every point in one leaf of each tree."""
    chance = np.random.default_rng(seed)
    placed = points.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("node", F.lit(0).cast("bigint"))
    for level in range(MAX_LEVELS):
        directions = chance.normal(size=(trees, dimensions))
        along = F.coalesce(*[F.when(F.col("tree") == tree, _dot("vector", row.tolist())) for tree, row in enumerate(directions)])
        projected = compute_once(placed, {"along": along})
        sizes = projected.groupBy("tree", "node").agg(
            F.count(F.lit(1)).alias("n"), F.min("along").alias("low"), F.max("along").alias("high"),
            F.percentile_approx("along", [i / FAN_OUT for i in range(1, FAN_OUT)], 1000).alias("marks"),
        ).where((F.col("n") > leaf_points) & (F.col("low") < F.col("high")))
        # Half-full leaves leave room for quantiles that are not exact.
        parts = F.least(F.lit(FAN_OUT), F.ceil(F.col("n") * 1.5 / leaf_points))
        steps = F.transform(F.sequence(F.lit(1), parts.cast("int") - 1), lambda i: F.get("marks", F.round(i * FAN_OUT / parts).cast("int") - 1))
        cuts = area.stage(sizes.select("tree", "node", F.array_distinct(steps).alias("cuts")), f"cuts-{level}")
        if cuts.limit(1).count() == 0:
            break
        child = F.size(F.filter("cuts", lambda cut: cut < F.col("along")))
        placed = area.stage(
            projected.join(cuts, ["tree", "node"], "left").withColumn(
                "node", F.when(F.col("cuts").isNotNull(), F.xxhash64("node", child)).otherwise(F.col("node"))
            ).drop("cuts", "along"), f"placed-{level}",
        )
    return placed


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def core_distances(points: np.ndarray, weights: np.ndarray, neighbors: int) -> np.ndarray:
    """Distance of each point to its `neighbors`-th other row; infinite where there are not so many."""
    found = np.empty(len(points))
    squares = (points * points).sum(1)
    for start in range(0, len(points), 256):
        rows = points[start:start + 256]
        away = np.sqrt(np.maximum(squares[start:start + 256, None] + squares[None, :] - 2 * rows @ points.T, 0))
        away[np.arange(len(rows)), np.arange(start, start + len(rows))] = 0
        order = np.argsort(away, axis=1, kind="stable")
        # The row itself is no neighbour, its copies are.
        enough = np.cumsum(weights[order], axis=1) > neighbors
        at = enough.argmax(1)
        lines = np.arange(len(rows))
        found[start:start + 256] = np.where(enough[lines, at], away[lines, order[lines, at]], np.inf)
    return found


def spanning_tree(points: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges `(from, to, length)` of the least tree under mutual reachability, grown point by point."""
    n = len(points)
    outside = np.ones(n, bool)
    nearest, length = np.zeros(n, np.int64), np.full(n, np.inf)
    current, edges = 0, []
    for _ in range(n - 1):
        outside[current] = False
        away = np.sqrt(((points - points[current]) ** 2).sum(1))
        reach = np.maximum(np.maximum(away, core), core[current])
        closer = outside & (reach < length)
        nearest[closer], length[closer] = current, reach[closer]
        current = int(np.where(outside, length, np.inf).argmin())
        if not outside[current]:  # everything outside is infinitely far
            current = int(outside.argmax())
        edges.append((nearest[current], current, length[current]))
    if not edges:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a, b, w = zip(*edges)
    return np.array(a, np.int64), np.array(b, np.int64), np.array(w)


def _leaf_cores(placed: DataFrame, neighbors: int) -> DataFrame:
    def run(leaf: pa.Table) -> pa.Table:
        weights = leaf.column("weight").to_numpy()
        found = core_distances(_matrix(leaf.column("vector")), weights, neighbors)
        return pa.table({"id": leaf.column("id"), "core": found})

    per_tree = placed.groupBy("tree", "node").applyInArrow(run, "id bigint, core double")
    # Few rows in all: then the farthest counts.
    return per_tree.groupBy("id").agg(F.min("core").alias("core"))


def _leaf_trees(placed: DataFrame) -> DataFrame:
    def run(leaf: pa.Table) -> pa.Table:
        ids = leaf.column("id").to_numpy()
        a, b, w = spanning_tree(_matrix(leaf.column("vector")), leaf.column("core").to_numpy())
        w = np.maximum(w, LEAST_DISTANCE)
        return pa.table({"u": np.minimum(ids[a], ids[b]), "v": np.maximum(ids[a], ids[b]), "w": w})

    return placed.groupBy("tree", "node").applyInArrow(run, "u bigint, v bigint, w double")


def spanning_forest(edges: DataFrame, area: StagingArea, name: str) -> tuple[DataFrame, DataFrame]:
    """The least forest `(u, v, w)` of weighted edges, and `(id, part)` of every node in it.

    In a Borůvka round every part takes its least edge, equal lengths ordered by their ends. Parts that chose each
    other are roots, named by the lesser; the way to a root is halved until all point to one. Each round leaves at
    most half the parts, and only edges between them.
    """
    between = edges.select("u", "v", "w", F.col("u").alias("a"), F.col("v").alias("b"))
    forest: DataFrame | None = None
    labels: DataFrame | None = None
    number = 0
    while True:
        both = between.select(F.col("a").alias("part"), F.col("b").alias("other"), "u", "v", "w").unionAll(
            between.select(F.col("b").alias("part"), F.col("a").alias("other"), "u", "v", "w")
        )
        least = F.min(F.struct("w", "u", "v", "other")).alias("least")
        chosen = area.stage(both.groupBy("part").agg(least).select("part", "least.*"), f"{name}-chosen-{number}")
        if chosen.limit(1).count() == 0:
            break
        picked = chosen.select("u", "v", "w").distinct()
        forest = picked if forest is None else forest.unionAll(picked)
        # Of two parts that chose each other the lesser is a root.
        back = chosen.select(F.col("part").alias("other"), F.col("other").alias("back"))
        pointers = area.stage(chosen.join(back, "other", "left").select(
            "part", F.when((F.col("back") == F.col("part")) & (F.col("part") < F.col("other")), F.col("part")).otherwise(F.col("other")).alias("root")
        ), f"{name}-pointers-{number}-0")
        turn = 0
        while True:
            further = pointers.select(F.col("part").alias("root"), F.col("root").alias("further"))
            turn += 1
            pointers = area.stage(pointers.join(further, "root").select(
                "part", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")
            ), f"{name}-pointers-{number}-{turn}")
            if pointers.where("moved").limit(1).count() == 0:
                break
            pointers = pointers.drop("moved")
        roots = pointers.select("part", "root")
        if labels is None:
            labels = roots.select(F.col("part").alias("id"), F.col("root").alias("part"))
        else:
            labels = labels.join(roots, "part", "left").select("id", F.coalesce("root", "part").alias("part"))
        labels = area.stage(labels, f"{name}-labels-{number}")
        for end in ("a", "b"):
            renamed = roots.select(F.col("part").alias(end), F.col("root").alias(f"{end}_root"))
            between = between.join(renamed, end, "left").withColumn(end, F.coalesce(f"{end}_root", end)).drop(f"{end}_root")
        between = area.stage(between.where("a <> b"), f"{name}-between-{number}")
        number += 1
    if forest is None or labels is None:
        none = edges.select("u", "v", "w").where(F.lit(False))
        return none, none.select(F.col("u").alias("id"), F.col("v").alias("part"))
    return area.stage(forest, f"{name}-forest"), labels


# --- reading the forest -------------------------------------------------------------------------

_PARTS = "kind string, node bigint, part bigint, size bigint, cluster bigint, mass double, parent bigint, birth double"


def read_part(edges: Sequence[tuple], nodes: dict[int, tuple], min_size: int) -> list[tuple]:
    """Join the nodes of one connected part, shortest edge first.

    `edges` are `(id, a, b, length)` in order, `nodes` give `(size, cluster or None, mass)`. Returns rows of `_PARTS`:
    `part` for the parts that are left, `node` for where each node went (its cluster, if it has found one), and
    `cluster` for clusters that ended, with their parent and the density at which they begin.
    """
    leader = {node: node for node in nodes}
    members = {node: [node] for node in nodes}
    state = dict(nodes)
    found = {node: cluster for node, (_, cluster, _) in nodes.items()}
    told: list[tuple] = []

    def top(node: int) -> int:
        while leader[node] != node:
            leader[node] = leader[leader[node]]
            node = leader[node]
        return node

    def settle(node: int, cluster: int) -> None:
        for member in members.pop(node, ()):
            if found[member] is None:
                found[member] = cluster

    for edge, a, b, length in edges:
        a, b = top(a), top(b)
        if a == b:
            continue
        density = 1 / length
        (size_a, cluster_a, mass_a), (size_b, cluster_b, mass_b) = state.pop(a), state.pop(b)
        size = size_a + size_b
        leader[b] = a
        if cluster_a is None and cluster_b is None:
            if size < min_size:
                members[a] += members.pop(b)
                state[a] = (size, None, 0.0)
                continue
            cluster, mass = edge, size * density
            settle(a, cluster)
            settle(b, cluster)
        elif cluster_a is not None and cluster_b is not None:
            cluster, mass = edge, size * density
            for old, old_size, old_mass in ((cluster_a, size_a, mass_a), (cluster_b, size_b, mass_b)):
                told.append(("cluster", None, None, old_size, old, old_mass, cluster, density))
        elif cluster_a is not None:
            cluster, mass = cluster_a, mass_a + size_b * density
            settle(b, cluster)
        else:
            cluster, mass = cluster_b, mass_b + size_a * density
            settle(a, cluster)
        state[a] = (size, cluster, mass)
    for node, (size, cluster, mass) in state.items():
        told.append(("part", None, node, size, cluster, mass, None, None))
    for node in nodes:
        told.append(("node", node, top(node), None, found[node], None, None, None))
    return told


def _bands(forest: DataFrame, band_edges: int) -> list[tuple[float, float]]:
    """Ranges of edge lengths that hold about `band_edges` edges each."""
    n = forest.count()
    parts = max(1, math.ceil(n / band_edges))
    marks = forest.agg(F.percentile_approx("w", [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    marks = sorted(set(marks or ()))
    return list(zip([-math.inf, *marks], [*marks, math.inf]))


def cluster_tree(
    points: DataFrame, forest: DataFrame, labels: DataFrame, area: StagingArea, min_size: int, band_edges: int = BAND_EDGES
) -> tuple[DataFrame, DataFrame]:
    """`(id, cluster)`, the first cluster of each point or null, and the clusters `(cluster, parent, size, mass, birth)`.

    `points` are `(id, weight, core)`. A cluster without parent begins at density 0.
    """
    heavy = F.col("weight") >= min_size
    dense = F.col("weight") / F.greatest("core", F.lit(LEAST_DISTANCE))
    nodes = points.select(
        F.col("id").alias("node"), F.col("weight").alias("size"),
        F.when(heavy, -F.col("id") - 1).alias("cluster"), F.when(heavy, dense).otherwise(F.lit(0.0)).alias("mass"),
    )
    went = points.select("id", F.when(heavy, -F.col("id") - 1).alias("cluster"), F.col("id").alias("node"))
    ended: DataFrame | None = None
    numbered = area.stage(forest.withColumn("edge", F.monotonically_increasing_id()), "numbered")
    bands = _bands(numbered, band_edges)
    for band, (low, high) in enumerate(bands):
        within = numbered.where((F.col("w") > low) & (F.col("w") <= high))
        if len(bands) == 1:
            linked = within.select("edge", F.col("u").alias("a"), F.col("v").alias("b"), "w")
            parts = labels.select(F.col("id").alias("node"), "part")
        else:
            at = went.select("id", F.col("node"))
            linked = area.stage(
                within.join(at.select(F.col("id").alias("u"), F.col("node").alias("a")), "u").join(
                    at.select(F.col("id").alias("v"), F.col("node").alias("b")), "v"
                ).select("edge", "a", "b", "w"), f"band-{band}",
            )
            _, parts = spanning_forest(linked.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "w"), area, f"band-{band}-parts")
            parts = parts.select(F.col("id").alias("node"), "part")
        rows = nodes.join(parts, "node").select("part", F.lit(None).cast("bigint").alias("edge"), "node", F.lit(None).cast("bigint").alias("b"),
                                                F.lit(None).cast("double").alias("w"), "size", "cluster", "mass")
        lines = linked.join(parts.withColumnRenamed("node", "a"), "a").select(
            "part", "edge", F.col("a").alias("node"), "b", "w", F.lit(None).cast("bigint").alias("size"),
            F.lit(None).cast("bigint").alias("cluster"), F.lit(None).cast("double").alias("mass"),
        )

        def run(group: pa.Table) -> pa.Table:
            is_node = group.column("edge").is_null().to_numpy()
            held = group.filter(pa.array(is_node)).select(["node", "size", "cluster", "mass"])
            known = {
                node: (size, cluster, mass)
                for node, size, cluster, mass in zip(*(held.column(i).to_pylist() for i in range(4)))
            }
            links = group.filter(pa.array(~is_node)).select(["edge", "node", "b", "w"])
            order = np.lexsort((links.column("edge").to_numpy(), links.column("w").to_numpy()))
            links = links.take(pa.array(order))
            told = read_part(list(zip(*(links.column(i).to_pylist() for i in range(4)))), known, min_size)
            columns = list(zip(*told)) if told else [[]] * 8
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64()]
            names = ["kind", "node", "part", "size", "cluster", "mass", "parent", "birth"]
            return pa.table([pa.array(column, kind) for column, kind in zip(columns, types)], names=names)

        read = area.stage(rows.unionByName(lines).groupBy("part").applyInArrow(run, _PARTS), f"read-{band}")
        closed = read.where("kind = 'cluster'").select("cluster", "parent", "size", "mass", "birth")
        ended = closed if ended is None else ended.unionByName(closed)
        moved = read.where("kind = 'node'").select("node", F.col("part").alias("to"), F.col("cluster").alias("first"))
        went = area.stage(went.join(moved, "node", "left").select(
            "id", F.coalesce("cluster", "first").alias("cluster"), F.coalesce("to", "node").alias("node")
        ), f"went-{band}")
        fresh = read.where("kind = 'part'").select(F.col("part").alias("node"), "size", "cluster", "mass")
        untouched = nodes.join(moved.select("node"), "node", "left_anti")
        nodes = area.stage(untouched.unionByName(fresh), f"nodes-{band}")
    roots = nodes.where("cluster IS NOT NULL").select(
        "cluster", F.lit(None).cast("bigint").alias("parent"), "size", "mass", F.lit(0.0).alias("birth")
    )
    return went.select("id", "cluster"), roots.unionByName(ended) if ended is not None else roots


def chosen_clusters(tree: Sequence[tuple], allow_single: bool) -> dict[int, int]:
    """Cluster -> number of the kept cluster that it belongs to, from 0 for the largest; OUTLIER above all kept ones.

    `tree` holds `(cluster, parent or None, size, mass, birth)`. A cluster is kept if its excess of mass is not less than
    that of the best choice below it. A root is kept only if `allow_single` or if there are other roots.
    """
    excess = {cluster: mass - size * birth for cluster, _, size, mass, birth in tree}
    parent = {cluster: above for cluster, above, *_ in tree}
    size_of = {cluster: size for cluster, _, size, *_ in tree}
    children: dict[int, list[int]] = {cluster: [] for cluster in parent}
    for cluster, above in parent.items():
        if above is not None:
            children[above].append(cluster)
    roots = [cluster for cluster, above in parent.items() if above is None]
    order, waiting = [], list(roots)
    while waiting:
        cluster = waiting.pop()
        order.append(cluster)
        waiting += children[cluster]
    best, kept = {}, {}
    for cluster in reversed(order):
        below = sum(best[child] for child in children[cluster])
        whole = parent[cluster] is None and not allow_single and len(roots) == 1
        kept[cluster] = not whole and excess[cluster] >= below
        best[cluster] = excess[cluster] if kept[cluster] else below
    label: dict[int, int | None] = {}
    heads = []
    for cluster in order:
        above = label.get(parent[cluster])
        if above is not None:
            label[cluster] = above
        elif kept[cluster]:
            label[cluster] = cluster
            heads.append(cluster)
        else:
            label[cluster] = None
    number = {head: i for i, head in enumerate(sorted(heads, key=lambda head: (-size_of[head], head)))}
    return {cluster: OUTLIER if label[cluster] is None else number[label[cluster]] for cluster in order}


def _kept(tree: DataFrame, allow_single: bool) -> DataFrame:
    """`(cluster, label)`. The tree has less than two rows per `min_size` rows of the input."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(row.values()) for batch in batches for row in batch.to_pylist()]
        labels = chosen_clusters(rows, allow_single)
        yield pa.RecordBatch.from_arrays(
            [pa.array(labels.keys(), pa.int64()), pa.array(labels.values(), pa.int32())], names=["cluster", "label"]
        )

    return tree.select("cluster", "parent", "size", "mass", "birth").coalesce(1).mapInArrow(run, "cluster bigint, label int")


def density_clusters(
    df: DataFrame, vector_col: str = "embedding", min_size: int = 100, neighbors: int = 15, dimensions: int | None = 5,
    allow_single: bool = False, leaf_points: int = LEAF_POINTS, trees: int = TREES, seed: int = 7,
    area: StagingArea | None = None, band_edges: int = BAND_EDGES,
) -> DataFrame:
    """Add `cluster`, from 0 for the largest; outliers have -1, as have rows whose vector is null or holds no numbers.

    A cluster has `min_size` rows or more, repeated rows included. `neighbors` says how many other rows make a place
    dense. An empty table stays empty; every row of `df` is in the result once.
    """
    area = area if area is not None else StagingArea(df.sparkSession)
    ship_package(df.sparkSession)
    scaled = area.stage(reduced_vectors(unit_vectors(df, vector_col, "_point"), "_point", dimensions), "scaled")
    points = scaled.where("_point IS NOT NULL").groupBy(F.col("_point").alias("vector")).agg(F.count(F.lit(1)).alias("weight"))
    points = area.stage(points.withColumn("id", F.monotonically_increasing_id()), "points")
    first = points.select(F.size("vector").alias("n")).first()
    if first is None:
        return scaled.withColumn("cluster", F.lit(OUTLIER)).drop("_point")
    placed = area.stage(leaves(points, first["n"], area, leaf_points, trees, seed), "leaves")
    core = area.stage(_leaf_cores(placed, neighbors), "core")
    edges = area.stage(_leaf_trees(placed.join(core, "id")), "edges")
    # Rows that no tree finds dense are joined to nothing.
    forest, labels = spanning_forest(edges.where(F.col("w") < float("inf")).groupBy("u", "v").agg(F.min("w").alias("w")), area, "spanning")
    weighted = points.select("id", "weight").join(core, "id")
    went, tree = cluster_tree(weighted, forest, labels, area, min_size, band_edges)
    kept = area.stage(_kept(tree, allow_single), "kept")
    numbers = went.join(kept, "cluster", "left").select("id", F.coalesce("label", F.lit(OUTLIER)).alias("cluster"))
    numbered = area.stage(points.select("id", "vector").join(numbers, "id").select(F.col("vector").alias("_point"), F.col("cluster").alias("_label")), "labels")
    return scaled.join(numbered, "_point", "left").select(
        *df.columns, F.coalesce("_label", F.lit(OUTLIER)).alias("cluster")
    )
