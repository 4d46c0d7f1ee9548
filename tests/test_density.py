"""Neighbour lists and density clusters against brute force."""

from __future__ import annotations

import math
import os
import random

import pytest

from chatseam.operators.density import density_clusters, mutual_reachability
from chatseam.operators.neighbours import neighbour_lists
from chatseam.operators.similarity import cluster, reduce_dimensions

LEAST = 1e-9
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_lists(rows, k):
    found = {}
    for a, x in rows:
        others = sorted((math.sqrt(sum((p - q) ** 2 for p, q in zip(x, y, strict=True))), b) for b, y in rows if b != a)
        found[a] = [(b, d) for d, b in others[:k]]
    return found


def plain_clusters(ids, edges, size):
    """Single linkage by union-find over the sorted edges, condensed from the top, most stable clusters chosen."""
    sides = {}
    for a, b, weight in edges:
        sides[a, b] = min(weight, sides.get((a, b), math.inf))
    tree = {i: (i, None, None, None, 1) for i in ids}  # name: (name, weight, left, right, points)
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for at, (weight, a, b) in enumerate(sorted((w, a, b) for (a, b), w in sides.items())):
        left, right = find(a), find(b)
        if left != right:
            name = ("merge", at)
            tree[name] = (name, weight, left, right, tree[left][4] + tree[right][4])
            top[name] = top[left] = top[right] = name
    density = lambda weight: 1 / max(weight, LEAST)

    def points(name):
        found, todo = [], [name]
        while todo:
            node = tree[todo.pop()]
            if node[1] is None:
                found.append(node[0])
            else:
                todo += node[2:4]
        return found

    def condense(name, begins):
        own, children = {}, []
        while True:
            _, weight, left, right, _ = tree[name]
            large = [side for side in (left, right) if tree[side][4] >= size]
            if len(large) == 2:
                children = [condense(side, density(weight)) for side in large]
                passed = sum(child["points"] for child in children)
                break
            for side in (left, right):
                if side not in large:
                    own.update(dict.fromkeys(points(side), density(weight)))
            if not large:
                passed = 0
                break
            name = large[0]
        stability = sum(d - begins for d in own.values()) + passed * (density(weight) - begins)
        return {"own": own, "children": children, "points": len(own) + passed, "stability": stability}

    def best(node, allowed=True):
        below = [best(child) for child in node["children"]]
        inner = sum(value for value, _ in below)
        if allowed and node["stability"] >= inner:
            return node["stability"], [node]
        return inner, [chosen for _, some in below for chosen in some]

    def everything(node):
        found = dict(node["own"])
        for child in node["children"]:
            found.update(everything(child))
        return found

    roots = [condense(name, 0.0) for name in {find(i) for i in ids} if tree[name][4] >= size]
    result = dict.fromkeys(ids, (-1, 0.0))
    for root in roots:
        for chosen in best(root, len(roots) > 1)[1]:
            members = everything(chosen)
            most = max(members.values())
            result.update({i: (min(members), round(d / most, 9)) for i, d in members.items()})
    return result


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(5)


def found_clusters(spark, ids, edges, size):
    points = frame(spark, [(i,) for i in ids], "id long")
    rows = density_clusters(points, frame(spark, edges, "a long, b long, weight double"), size).collect()
    assert len(rows) == len(ids)
    return {row.id: (row.topic, round(row.strength, 9)) for row in rows}


@pytest.fixture(scope="module")
def shapes():
    """Two rings, one inside the other, a dense spot, copies of one point and scattered points."""
    chance = random.Random(5)
    rows = []
    for radius, count in ((1.0, 60), (4.0, 140)):
        for _ in range(count):
            angle, r = chance.uniform(0, 2 * math.pi), radius + chance.gauss(0, 0.08)
            rows.append([r * math.cos(angle), r * math.sin(angle)])
    rows += [[9 + chance.gauss(0, 0.1), 9 + chance.gauss(0, 0.1)] for _ in range(30)]
    rows += [[-9.0, 9.0]] * 25
    rows += [[chance.uniform(-12, 12), chance.uniform(-12, 12)] for _ in range(20)]
    return list(enumerate(rows))


def test_neighbour_lists_are_exact(spark, shapes, monkeypatch):
    monkeypatch.setattr("chatseam.operators.neighbours.QUERY_ROWS", 20)
    monkeypatch.setattr("chatseam.operators.neighbours.CANDIDATE_ROWS", 50)
    rows = shapes + [(900, None), (901, [math.nan, 1.0]), (902, []), (None, [1.0, 1.0])]
    vectors = frame(spark, rows, "vec_id long, embedding array<double>")
    found = {}
    for row in neighbour_lists(vectors, "vec_id", k=7, pivots=12).collect():
        found.setdefault(row.id, []).append((row.distance, row.neighbour))
    plain = plain_lists(shapes, 7)
    assert {i: [(b, pytest.approx(d)) for d, b in sorted(some)] for i, some in found.items()} == plain


def test_neighbour_lists_of_few_and_no_vectors(spark):
    assert neighbour_lists(frame(spark, [], "vec_id long, embedding array<double>"), "vec_id", k=3).collect() == []
    two = frame(spark, [(1, [0.0, 3.0]), (2, [4.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, neighbour_lists(two, "vec_id", k=3).collect())) == [(1, 2, 5.0), (2, 1, 5.0)]
    same = frame(spark, [(i, [1.0]) for i in range(4)], "vec_id long, embedding array<double>")
    lists = sorted(map(tuple, neighbour_lists(same, "vec_id", k=2).collect()))
    assert lists == [(0, 1, 0.0), (0, 2, 0.0), (1, 0, 0.0), (1, 2, 0.0), (2, 0, 0.0), (2, 1, 0.0), (3, 0, 0.0), (3, 1, 0.0)]


def test_rings_are_clusters_where_k_means_fails(spark, shapes):
    vectors = frame(spark, shapes, "vec_id long, embedding array<double>")
    lists = neighbour_lists(vectors, "vec_id", k=8)
    edges = [tuple(row) for row in mutual_reachability(lists, min_samples=5).collect()]
    plain = plain_lists(shapes, 8)
    core = {i: some[4][1] for i, some in plain.items()}
    expected = {}
    for a, some in plain.items():
        for b, distance in some:
            expected[min(a, b), max(a, b)] = max(distance, core[a], core[b])
    assert {(a, b): pytest.approx(w) for a, b, w in edges} == expected
    found = found_clusters(spark, [i for i, _ in shapes], edges, 15)
    assert found == plain_clusters([i for i, _ in shapes], edges, 15)
    inner, outer = {found[i][0] for i in range(60)} - {-1}, {found[i][0] for i in range(60, 200)} - {-1}
    assert inner and outer and not inner & outer
    assert sum(found[i][0] == -1 for i in range(200)) < 20
    by_means = {row.vec_id: row.topic for row in cluster(vectors, k=4, min_cluster_size=1).collect()}
    assert {by_means[i] for i in range(60)} & {by_means[i] for i in range(60, 200)}


@pytest.mark.parametrize(("seed", "size"), [(0, 2), (3, 9)])
def test_clusters_of_random_graphs(spark, seed, size):
    """Few weights, so many ties; several parts; chains; a hub that holds a third of the edges."""
    chance = random.Random(seed)
    ids = list(range(0, 120))
    edges = [(i, i + 1, float(chance.choice([1, 2, 3, 5, 8]))) for i in range(99) if i not in (40, 70)]
    edges += [(0, i, chance.uniform(1, 9)) for i in chance.sample(range(2, 40), 30)]
    edges += [(*sorted(chance.sample(range(41, 70), 2)), chance.uniform(0, 4)) for _ in range(40)]
    edges += [(100 + i, 101 + i, 20.0 - i) for i in range(15)]
    assert found_clusters(spark, ids, edges, size) == plain_clusters(ids, edges, size)


def test_clusters_without_edges_and_with_too_few_points(spark):
    assert found_clusters(spark, [3, 4], [], 2) == {3: (-1, 0.0), 4: (-1, 0.0)}
    assert found_clusters(spark, [1, 2, 3], [(1, 2, 1.0), (2, 3, 2.0)], 5) == dict.fromkeys([1, 2, 3], (-1, 0.0))
    # One cluster that holds everything is none.
    assert found_clusters(spark, [1, 2, 3], [(1, 2, 1.0), (2, 3, 2.0)], 2) == dict.fromkeys([1, 2, 3], (-1, 0.0))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_query_equals_brute_force_on_the_given_vectors(spark):
    """All vectors of the table, in five dimensions, from the distances up."""
    from chatseam.plans import QUERIES
    from chatseam.plans.analysis_queries import drawn_vectors

    vectors = drawn_vectors(spark, SF_DIR)
    rows = [(r.vec_id, list(r.reduced)) for r in reduce_dimensions(vectors, k=5).select("vec_id", "reduced").collect()]
    plain = plain_lists(rows, 10)
    core = {i: some[4][1] for i, some in plain.items()}
    edges = [(min(a, b), max(a, b), max(d, core[a], core[b])) for a, some in plain.items() for b, d in some]
    expected = plain_clusters([i for i, _ in rows], edges, 10)
    found = {r.vec_id: (r.topic, r.strength) for r in QUERIES["density_clusters"](spark, SF_DIR).collect()}
    assert {i: topic for i, (topic, _) in found.items()} == {i: topic for i, (topic, _) in expected.items()}
    assert all(abs(found[i][1] - expected[i][1]) < 1e-6 for i in expected)
    assert len({topic for topic, _ in found.values()}) > 5


def test_a_deep_tree_of_clusters_takes_few_rounds(spark, monkeypatch):
    """Pairs of points on a string: cluster after cluster joins the first ones, so the tree is as deep as there are clusters."""
    from chatseam.operators import density

    steps, plain_saved = [], density.saved
    monkeypatch.setattr(density, "saved", lambda rows: steps.append(1) or plain_saved(rows))
    edges = [(2 * i, 2 * i + 1, 0.5 + i / 100) for i in range(48)] + [(2 * i, 2 * i + 2, 2.0 + i) for i in range(47)]
    edges += [(100 + 2 * i, 101 + 2 * i, 0.3) for i in range(8)] + [(100 + 2 * i, 102 + 2 * i, 5.0 - i % 4) for i in range(7)]
    ids = [*range(96), *range(100, 116)]
    assert found_clusters(spark, ids, edges, 2) == plain_clusters(ids, edges, 2)
    assert len(steps) < 100
