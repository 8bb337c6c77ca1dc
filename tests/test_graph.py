"""Cycles and their paths on rings, chains, trees and random graphs."""

import random
import time

from twinledger.operators.graph import components


def plain_components(pairs):
    """Strongly connected components of two or more, by Tarjan's method without recursion."""
    onward = {}
    for a, b in pairs:
        if a != b:
            onward.setdefault(a, set()).add(b)
            onward.setdefault(b, set())
    number, low, stack, on, out = {}, {}, [], set(), {}
    for root in onward:
        if root in number:
            continue
        work = [(root, iter(sorted(onward[root])))]
        number[root] = low[root] = len(number)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for to in rest:
                if to not in number:
                    number[to] = low[to] = len(number)
                    stack.append(to)
                    on.add(to)
                    work.append((to, iter(sorted(onward[to]))))
                    break
                if to in on:
                    low[node] = min(low[node], number[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    group = []
                    while True:
                        group.append(stack.pop())
                        on.discard(group[-1])
                        if group[-1] == node:
                            break
                    if len(group) > 1:
                        out.update(dict.fromkeys(group, min(group)))
    return out


def held(spark, pairs):
    """Components and paths, each path checked to be a simple cycle of its component from its smallest node on."""
    nodes, paths = components(spark.createDataFrame(pairs, "src string, dst string").repartition(4))
    found = {r.node: r.cycle for r in nodes.collect()}
    ways = {}
    for r in paths.collect():
        ways.setdefault(r.cycle, []).append((r.step, r.node))
    known = set(pairs)
    assert set(ways) == set(found.values())
    for cycle, way in ways.items():
        way.sort()
        assert [s for s, _ in way] == list(range(len(way)))
        names = [n for _, n in way]
        assert len(set(names)) == len(names) > 1 and names[0] == min(names)
        assert all(found[n] == cycle for n in names) and all(p in known for p in zip(names, [*names[1:], names[0]], strict=True))
    return found, {c: [n for _, n in w] for c, w in ways.items()}


def name(i):
    return f"n{i:05d}"


def ring(n, at=0):
    return [(name(at + i), name(at + (i + 1) % n)) for i in range(n)]


SHAPES = {
    "rings": ring(2) + ring(3, 10) + ring(33, 100),
    "ring with tails": ring(17) + [(name(100 + i), name(101 + i)) for i in range(40)] + [(name(140), name(3)), (name(5), name(200)), (name(200), name(201))],
    "rings that touch": ring(9) + [(name(0), "x1"), ("x1", "x2"), ("x2", name(0))] + [(name(4), "y1"), ("y1", name(4))],
    "a ring of rings": [e for i in range(6) for e in ring(5, 10 * i)] + [(name(10 * i), f"z{i}") for i in range(6)] + [(f"z{i}", name(10 * ((i + 1) % 6) + 2)) for i in range(6)],
    "parallel ways": [("a", "b"), ("a", "c1"), ("c1", "c2"), ("c2", "b"), ("a", "d1"), ("d1", "b"), ("b", "e"), ("e", "a")],
    "loops do not count": [("a", "a"), ("b", "c"), ("c", "d"), ("d", "d")],
    "a loop on a chain of a ring": [("a", "b"), ("b", "b1"), ("b1", "b2"), ("b2", "b"), ("b", "c"), ("c", "a")],
    "a tree": [(name(i // 2), name(i)) for i in range(2, 120)],
    "a chain": [(name(i), name(i + 1)) for i in range(150)],
    "two ways and a bridge": ring(8) + ring(7, 20) + [(name(2), name(22)), (name(4), name(25))],
}


def test_shapes_and_random_graphs_beside_each_other(spark):
    rng = random.Random(0)
    graphs = dict(SHAPES)
    for n in (50, 70, 90, 150):
        graphs[f"random {n}"] = sorted({(name(rng.randrange(60)), name(rng.randrange(60))) for _ in range(n)})
    pairs = [(f"{shape}: {a}", f"{shape}: {b}") for shape, edges in graphs.items() for a, b in edges]
    found, ways = held(spark, pairs)
    assert found == plain_components(pairs)
    assert {c: len(w) for c, w in ways.items() if c.startswith("rings: ")} == {f"rings: {name(i)}": n for i, n in ((0, 2), (10, 3), (100, 33))}
    assert ways["parallel ways: a"] == [f"parallel ways: {n}" for n in "abe"]


def test_nothing(spark):
    assert held(spark, []) == ({}, {})


def test_a_ring_of_ten_thousand(spark):
    pairs = ring(10_000) + [(name(20_000 + i), name(20_001 + i)) for i in range(3_000)]
    random.Random(1).shuffle(pairs)
    started = time.time()
    found, ways = held(spark, pairs)
    assert time.time() - started < 60
    assert len(found) == 10_000 and ways == {name(0): [name(i) for i in range(10_000)]}
