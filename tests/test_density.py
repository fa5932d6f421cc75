"""Density clusters against the tree of all pairs of points."""

import numpy as np
import pytest

from chatterloom.operators import density
from chatterloom.sources.staging import StagingArea


def made(spark, points, keys=None):
    rows = [(int(key), None if row is None else [float(x) for x in row]) for key, row in zip(keys if keys is not None else range(len(points)), points)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")


def plain(points, min_size, neighbors):
    """Clusters of the complete graph, read from above: cut the longest edge, part by part."""
    n = len(points)
    away = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(2))
    core = np.sort(away, axis=1)[:, neighbors]
    reach = np.maximum(np.maximum(away, core[:, None]), core[None, :])
    near, parent, left = np.full(n, np.inf), np.zeros(n, int), set(range(1, n))
    edges, current = [], 0
    while left:
        rest = np.array(sorted(left))
        closer = reach[current, rest] < near[rest]
        near[rest[closer]], parent[rest[closer]] = reach[current, rest[closer]], current
        current = int(rest[near[rest].argmin()])
        edges.append((near[current], parent[current], current))
        left.discard(current)
    links = {i: [] for i in range(n)}
    for w, a, b in edges:
        links[a].append((w, b))
        links[b].append((w, a))

    def side(start, w, other, members):
        seen, todo = {start}, [start]
        while todo:
            at = todo.pop()
            for _, to in links[at]:
                if to in members and to not in seen and {at, to} != {start, other}:
                    seen.add(to)
                    todo.append(to)
        return seen

    clusters = []  # (members, birth, mass, children)

    def read(members, birth):
        number = len(clusters)
        clusters.append([set(members), birth, 0.0, []])
        held = set(members)
        inside = sorted(((w, a, b) for w, a, b in edges if a in held and b in held), reverse=True)
        for w, a, b in inside:
            if a not in held or b not in held:
                continue
            left, right = side(a, w, b, held), side(b, w, a, held)
            density_here = 1 / max(w, density.LEAST_DISTANCE)
            if len(left) >= min_size and len(right) >= min_size:
                clusters[number][2] += len(held) * density_here
                clusters[number][3] += [read(left, density_here), read(right, density_here)]
                return number
            for part in (left, right):
                if len(part) < min_size:
                    clusters[number][2] += len(part) * density_here
                    held -= part
            if not held:
                return number
        return number

    import sys
    sys.setrecursionlimit(10_000)
    read(set(range(n)), 0.0)

    def best(number):
        members, birth, mass, children = clusters[number]
        excess = mass - len(members) * birth
        below = [best(child) for child in children]
        if number and excess >= sum(value for value, _ in below):
            return excess, [number]
        return sum(value for value, _ in below), [head for _, heads in below for head in heads]

    heads = best(0)[1]
    heads.sort(key=lambda head: -len(clusters[head][0]))
    label = np.full(n, -1)
    for i, head in enumerate(heads):
        label[list(clusters[head][0])] = i
    return label


def blobs(seed, sizes, spread=0.05, noise=100):
    chance = np.random.default_rng(seed)
    centres = chance.normal(size=(len(sizes), 3)) * 2
    parts = [centre + chance.normal(size=(size, 3)) * spread * (1 + i) for i, (centre, size) in enumerate(zip(centres, sizes))]
    return np.concatenate([*parts, chance.uniform(-4, 4, size=(noise, 3))])


def unit(points):
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def same_groups(found, want):
    """Equal up to the numbers of clusters of the same size."""
    pairs = set(zip(found, want))
    return len(pairs) == len(set(found)) == len(set(want)) and all((a == -1) == (b == -1) for a, b in pairs)


@pytest.mark.parametrize("min_size,neighbors", [(40, 15), (100, 5)])
def test_equals_all_pairs(spark, min_size, neighbors):
    points = blobs(3, [500, 400, 300, 350, 250], noise=200)
    want = plain(unit(points), min_size, neighbors)
    found = density.density_clusters(made(spark, points), min_size=min_size, neighbors=neighbors, dimensions=None)
    rows = {r.vec_id: r.cluster for r in found.collect()}
    assert len(rows) == len(points) == 2_000
    label = [rows[i] for i in range(len(points))]
    assert same_groups(label, want.tolist()) and max(label) >= 3 and min(label) == -1
    counts = np.bincount([x for x in label if x >= 0])
    assert (counts >= min_size).all() and (np.diff(counts) <= 0).all()


def test_bands_give_the_same(spark):
    points = blobs(5, [60, 45, 75], noise=40)
    df = made(spark, points)

    def label(band_edges):
        found = density.density_clusters(df, min_size=15, neighbors=4, dimensions=None, band_edges=band_edges)
        return [c for _, c in sorted((r.vec_id, r.cluster) for r in found.collect())]

    want = label(1_000)
    assert label(150) == want
    # Equal lengths may be read in another order than in the tree of all pairs.
    agree = sum(x == y for x, y in zip(want, plain(unit(points), 15, 4)))
    assert agree >= 0.98 * len(points) and max(want) >= 2


def test_leaves_are_small_and_find_the_same_clusters(spark):
    points = blobs(9, [700, 600, 500], spread=0.03, noise=60)
    df, area = made(spark, points), StagingArea(spark)
    held = density.unit_vectors(df, "embedding", "vector").select("vector", density.F.lit(1).cast("bigint").alias("weight"), density.F.col("vec_id").alias("id"))
    placed = density.leaves(held, 3, area, 200, 3, 1)
    sizes = [r["count"] for r in placed.groupBy("tree", "node").count().collect()]
    assert max(sizes) <= 300 and sum(sizes) == 3 * len(points)
    want = plain(unit(points), 100, 15)
    rows = {r.vec_id: r.cluster for r in density.density_clusters(df, min_size=100, leaf_points=250, dimensions=None).collect()}
    label = np.array([rows[i] for i in range(len(points))])
    assert label.max() == want.max()
    # Share of rows on which the trees agree with all pairs, cluster by cluster.
    agree = sum(np.bincount(want[label == c] + 1).max() for c in set(label.tolist()))
    assert agree >= 0.97 * len(points)


def test_copies_are_one_point_with_weight(spark):
    points = blobs(2, [60, 80], noise=20)
    copied = np.concatenate([points, np.repeat(points[:1], 40, axis=0), np.repeat(points[100:103], 3, axis=0)])
    want = plain(unit(copied), 25, 5)
    rows = {r.vec_id: r.cluster for r in density.density_clusters(made(spark, copied), min_size=25, neighbors=5, dimensions=None).collect()}
    label = [rows[i] for i in range(len(copied))]
    assert same_groups(label, want.tolist()) and len({label[i] for i in [0, *range(160, 200)]}) == 1


def test_rows_without_vectors_and_few_rows(spark):
    nothing = made(spark, [])
    assert density.density_clusters(nothing).count() == 0
    odd = made(spark, [None, [1.0, 0.0], [float("nan"), 1.0], [0.0, 0.0], [1.0, 0.0], [float("inf"), 2.0]])
    assert [r.cluster for r in density.density_clusters(odd, dimensions=None).collect()] == [-1] * 6
    assert odd.schema.names + ["cluster"] == density.density_clusters(odd, dimensions=None).columns
    same = made(spark, [[1.0, 2.0]] * 30 + [[-1.0, 1.0]] * 25 + [None])
    rows = [(r.vec_id, r.cluster) for r in density.density_clusters(same, min_size=20, neighbors=3, dimensions=None).collect()]
    assert sorted({c for _, c in rows}) == [-1, 0, 1] and sum(c == 0 for _, c in rows) == 30


def test_forest_equals_kruskal(spark):
    chance = np.random.default_rng(4)
    edges = {(min(a, b), max(a, b)): float(w) for a, b, w in zip(chance.integers(0, 150, 400), chance.integers(0, 150, 400), chance.integers(1, 30, 400)) if a != b}
    df = spark.createDataFrame([(int(a), int(b), w) for (a, b), w in edges.items()], "u bigint, v bigint, w double")
    forest, labels = density.spanning_forest(df, StagingArea(spark), "test")
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    want = set()
    for w, a, b in sorted((w, int(a), int(b)) for (a, b), w in edges.items()):
        if top(a) != top(b):
            parent[top(a)] = top(b)
            want.add((a, b, w))
    assert {(r.u, r.v, r.w) for r in forest.collect()} == want and forest.count() == len(want)
    parts = {}
    for r in labels.collect():
        parts.setdefault(top(r.id), set()).add(r.part)
    assert all(len(p) == 1 for p in parts.values()) and len(set().union(*parts.values())) == len(parts)
