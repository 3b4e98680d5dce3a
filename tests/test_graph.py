import random
from collections import Counter, defaultdict

import pytest
from duopanel.operators import graph


def parts(links):
    """Component (least firm) of each link, by plain search."""
    around = defaultdict(set)
    for i, j in links:
        around["i", i].add(("j", j))
        around["j", j].add(("i", i))
    label = {}
    for root in sorted(x for x in around if x[0] == "j"):
        todo = [root]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = root[1]
                todo += around[x]
    return {(i, j): label["j", j] for i, j in links}


def largest(links):
    of = parts(links)
    n = Counter(of.values())
    best = min(n, key=lambda c: (-n[c], c), default=None)
    return {x for x in links if of[x] == best}


def connected(links, link):
    """Whether both ends of ``link`` meet without it."""
    around = defaultdict(set)
    for i, j in links - {link}:
        around["i", i].add(("j", j))
        around["j", j].add(("i", i))
    seen, todo = set(), [("i", link[0])]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += around[x]
    return ("j", link[1]) in seen


@pytest.mark.parametrize("unit", ["match", "spell", "observation"])
def test_leave_out_sets(spark, unit):
    random.seed(7)
    rows = [(i, random.randrange(14), t) for i in range(16) for t in range(random.choice([1, 2, 2, 3, 4]))]
    rows += [(100, 50, 0), (100, 51, 1), (101, 50, 0), (101, 51, 1), (102, 51, 0), (102, 52, 1), (102, 51, 2), (103, 3, 0), (103, 60, 1), (103, 60, 2), (103, 60, 3)]
    x = spark.createDataFrame(rows, "i long, j long, t long")
    observed = Counter((i, j) for i, j, _ in rows)
    spells = Counter((i, j) for n, (i, j, _) in enumerate(sorted(rows, key=lambda r: (r[0], r[2]))) if not n or sorted(rows, key=lambda r: (r[0], r[2]))[n - 1][:2] != (i, j))
    units = {"match": Counter(set(observed)), "spell": spells, "observation": observed}[unit]
    firms = Counter(i for i, _ in observed)
    links = largest({(i, j) for i, j in observed if firms[i] > 1})
    good = largest({k for k in links if units[k] > 1 or connected(links, k)})
    want = good | {(i, j) for i, j in observed if firms[i] == 1 and j in {b for _, b in good}}
    got = graph.leave_out(x, unit).collect()
    assert Counter((r.i, r.j) for r in got) == Counter({k: observed[k] for k in want})
    with pytest.raises(ValueError):
        graph.leave_out(x, "firms")


def test_leave_out_of_nothing(spark):
    assert graph.leave_out(spark.createDataFrame([], "i long, j long, t long")).count() == 0
    assert graph.leave_out(spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "i long, j long, t long")).count() == 0


def apart(links, node):
    """Whether firms are apart without ``node``, (kind, id)."""
    left = {(i, j) for i, j in links if ("i", i) != node and ("j", j) != node}
    firms = {j for _, j in links} - ({node[1]} if node[0] == "j" else set())
    if len(firms) < 2:
        return False
    of = parts(left)
    reached = {j for _, j in left}
    return reached != firms or len({of[x] for x in left}) > 1


def movers_of(links):
    n = Counter(i for i, _ in links)
    return {(i, j) for i, j in links if n[i] > 1}


@pytest.mark.parametrize("seed,kind", [(1, "i"), (2, "j")])
def test_leave_a_node_out(spark, seed, kind):
    """Against deleting every worker or firm one by one."""
    rng = random.Random(seed)
    rows = [(i, rng.randrange(12), t) for i in range(14) for t in range(rng.choice([1, 2, 2, 3]))]
    rows += [(100 + k, 50 + (k + d) % 5, d) for k in range(5) for d in range(2)] + [(200, 50, 0), (200, 0, 1), (201, 53, 0), (201, 0, 1)]  # a long cycle, tied by two workers to one firm
    rows += [(300 + k, 70 + k + d, d) for k in range(3) for d in range(2)] + [(310, 0, 0), (310, 70, 1)]  # a chain
    links = largest(movers_of({(i, j) for i, j, _ in rows}))
    gone = set()
    while True:
        cut = {x for x in {(kind, b[0] if kind == "i" else b[1]) for b in links} if apart(links, x)}
        if not cut:
            break
        gone |= cut
        links = largest(movers_of({(i, j) for i, j in links if (kind, i if kind == "i" else j) not in cut}))
    firms = {j for _, j in links}
    want = sorted(r for r in rows if r[1] in firms and (kind == "j" or ("i", r[0]) not in gone))
    got = graph.leave_out(spark.createDataFrame(rows, "i long, j long, t long"), "worker" if kind == "i" else "firm")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_cut_nodes(spark):
    rng = random.Random(9)
    for _ in range(1):
        links = largest(movers_of({(rng.randrange(25), rng.randrange(22)) for _ in range(48)}))
        df = spark.createDataFrame(sorted(links), "i long, j long")
        for kind in "ij":
            want = {x for x in {b[0] if kind == "i" else b[1] for b in links} if apart(links, (kind, x))}
            assert {r[0] for r in graph.cut_nodes(df, kind).collect()} == want


def test_deep_chain(spark):
    """A chain of firms: every worker is a bridge; ancestors are doubled, not walked."""
    links = spark.createDataFrame([(k, k + d) for k in range(12) for d in range(2)], "i long, j long")
    assert graph.bridges(links).count() == 24
    assert {r[0] for r in graph.cut_nodes(links, "j").collect()} == set(range(1, 12))


def test_strong_components(spark):
    rng = random.Random(3)
    links = {(rng.randrange(20), rng.randrange(20)) for _ in range(34)} | {(30, 31), (31, 32), (32, 30), (32, 33), (40, 41)}
    nodes = {x for b in links if b[0] != b[1] for x in b}

    def reach(start):
        seen, todo = set(), [start]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [b for a, b in links if a == x]
        return seen

    of = {x: reach(x) for x in nodes}
    want = {x: max(y for y in of[x] if x in of[y]) for x in nodes}
    got = {r.j: r.component for r in graph.strong_components(spark.createDataFrame(sorted(links), "j1 long, j2 long")).collect()}
    assert got == want
    rows = [(1, 1, 0), (1, 2, 1), (2, 2, 0), (2, 1, 1), (3, 2, 0), (3, 3, 1), (4, 3, 0), (5, 3, 0)]
    x = spark.createDataFrame([(*r, 0.0) for r in rows], "i long, j long, t long, y double")
    assert sorted(r[1] for r in graph.largest_strongly_connected(x).collect()) == [1, 1, 2, 2, 2]
    assert graph.strong_components(spark.createDataFrame([], "j1 long, j2 long")).count() == 0


def test_cores_keep_what_can_be_taken_away():
    """Any link, worker or firm taken away leaves the firms of a core in the same components as those of all links; cores of parts put together too."""
    import numpy as np

    rng = random.Random(11)

    def firms_apart(links, n):
        of = parts({(i, j) for i, j in links} | {(("f", j), j) for j in range(n)})
        return [of[("f", j), j] for j in range(n)]

    def arrays(links):
        links = sorted(links)
        code = {i: k for k, i in enumerate(dict.fromkeys(i for i, _ in links))}
        return np.array([code[i] for i, _ in links], int), np.array([j for _, j in links], int), links

    for size, n, workers in ((2, 9, 12), (3, 8, 10), (4, 10, 9), (2, 14, 15), (3, 12, 30)) * 4:
        links = {(i, j) for i in range(workers) for j in rng.sample(range(n), rng.randint(2, size + 1))}
        half = [{x for x in links if x[0] % 2 == k} for k in (0, 1)]
        units, pairs = set(), []
        for own in half:
            who, j, rows = arrays(own)
            units |= {x for x, kept in zip(rows, graph.core_of_units(who, j, n)) if kept}
            pairs += graph.core_of_firms(who, j, n).T.tolist()
        who, j, rows = arrays(units)
        units = {x for x, kept in zip(rows, graph.core_of_units(who, j, n)) if kept}
        again = graph.core_of_firms(np.repeat(np.arange(len(pairs)), 2), np.array([sorted(p) for p in pairs]).ravel(), n).T.tolist()
        assert len({i for i, _ in units}) <= 2 * (n - 1) and len(again) <= 2 * (n - 1)
        tied = {(("p", k), j) for k, p in enumerate(again) for j in p}
        for x in links:
            assert firms_apart(units - {x}, n) == firms_apart(links - {x}, n)
            assert firms_apart({y for y in units if y[0] != x[0]}, n) == firms_apart({y for y in links if y[0] != x[0]}, n)
        for s in range(n):
            assert firms_apart({x for x in tied if x[1] != s}, n) == firms_apart({x for x in links if x[1] != s}, n)


@pytest.mark.parametrize("unit", ["match", "worker", "firm"])
def test_many_workers_few_firms(spark, unit, tmp_path_factory, monkeypatch):
    """Sets of many workers are searched in a core that grows with the firms: little is written, in many small steps too, and what hangs by one link, worker or firm goes."""
    import os

    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    monkeypatch.setattr(graph, "LINKS", 300)
    rng = random.Random(5)
    rows = [(i, rng.randrange(10), t) for i in range(4000) for t in range(3)]
    rows += [(9000 + k, 20 + (k + d) % 3, d) for k in range(6) for d in range(2)] + [(9100, 0, 0), (9100, 20, 1)]  # three firms that hang by one worker, and by firms 0 and 20
    got = {tuple(r) for r in graph.leave_out(spark.createDataFrame(rows, "i long, j long, t long"), unit).collect()}
    assert got == {r for r in rows if (0 < r[1] < 10 if unit == "firm" else r[1] < 10 and r[0] != 9100)}
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)
    assert size < 250_000, size
