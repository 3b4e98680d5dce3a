"""Connected sets of the worker-firm graph.

Workers are many and firms few. Up to FIRMS firms, tasks read the links of whole workers and keep only a *core* of them: at most about two workers a firm, whose links have the components of
all links, and still do when any one link, worker or firm is taken away. Cores of tasks are put together and thinned again until one is left, and searches run on that.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..llm.common import drop, written

#: Firms up to which a task holds some numbers for each (16 MB a number); links that a task thins at once, at least.
FIRMS, LINKS = 2_000_000, 1 << 20


def trees(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the links (a, b) that make a spanning forest of nodes 0 to n - 1, and the least node of each node's tree."""
    label, used, left = np.arange(n), [], np.arange(len(a))
    while True:
        x, y = label[a[left]], label[b[left]]
        apart = x != y
        left, x, y = left[apart], x[apart], y[apart]
        if not len(left):
            return np.concatenate(used) if used else left, label
        low, high = np.minimum(x, y), np.maximum(x, y)
        least = np.full(n, n)
        np.minimum.at(least, high, low)
        pick = np.full(n, -1)
        best = low == least[high]
        pick[high[best]] = left[best]
        roots = np.flatnonzero(pick >= 0)
        used.append(pick[roots])
        up = np.arange(n)
        up[roots] = least[roots]
        while True:  # labels only fall
            far = up[up]
            if (far == up).all():
                break
            up = far
        label = up[label]


def _steps(who: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between firms that follow each other among a worker's rows, and the rows at which they end."""
    end = np.flatnonzero(who[1:] == who[:-1]) + 1
    return np.stack([j[end - 1], j[end]]), end


def core_of_units(who: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Which rows stay: those of the workers of a spanning forest of the firms, and of one without these workers.

    Taking a link or a worker outside the first forest away leaves that forest whole; of the first forest's workers all rows stay, and the second forest connects what all other workers do.
    """
    step, end = _steps(who, j)
    kept = np.zeros(who[-1] + 1 if len(who) else 0, bool)
    for _ in range(2):
        free = np.flatnonzero(~kept[who[end]])
        kept[who[end[free[trees(*step[:, free], n)[0]]]]] = True
    return kept[who]


def first_tree(who: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Parents and depths of firms in trees whose firms, in order of depth and number, take all neighbours without a parent as children (-1: none)."""
    order = np.argsort(j, kind="stable")
    at_firm = np.searchsorted(j[order], np.arange(n + 1))
    at_worker = np.searchsorted(who, np.arange(who[-1] + 2 if len(who) else 1))
    parent, depth, open_ = np.full(n, -1), np.full(n, -1), np.ones(len(at_worker) - 1, bool)

    def rows(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = stop - start
        return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum())), size

    front, level = np.unique(trees(*_steps(who, j)[0], n)[1][j]), 0
    depth[front] = 0
    while len(front):
        level += 1
        at, size = rows(at_firm[front], at_firm[front + 1])
        w, by = who[order[at]], np.repeat(front, size)
        new = open_[w]
        w, first = np.unique(w[new], return_index=True)  # the least firm of the level comes first
        by, open_[w] = by[new][first], False
        at, size = rows(at_worker[w], at_worker[w + 1])
        child, by = j[at], np.repeat(by, size)
        new = depth[child] < 0
        child, by = child[new], by[new]
        take = np.lexsort((by, child))
        front, first = np.unique(child[take], return_index=True)
        parent[front], depth[front] = by[take][first], level
    return parent, depth


def core_of_firms(who: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Pairs of firms (2 x pairs) that share a worker: a tree of :func:`first_tree`, and a forest of the pairs outside it.

    When a firm s is taken away, pairs of the forest that led through s end at firms that the tree reached before s took its children: these stay tied to the root.
    """
    parent, depth = first_tree(who, j, n)
    child = np.flatnonzero(parent >= 0)
    # The tree's pairs of a worker all hold its first firm by depth and number; its other firms are free to be tied to each other.
    order = np.lexsort((j, depth[j], who))
    who, j = who[order], j[order]
    head = np.r_[True, who[1:] != who[:-1]] if len(who) else np.zeros(0, bool)
    first = np.repeat(j[head], np.diff(np.r_[np.flatnonzero(head), len(j)]))
    step, end = _steps(who, j)
    own = step[:, ~head[end - 1]]
    free = np.flatnonzero(~head & (parent[j] != first))
    pairs = np.concatenate([own, np.stack([first[free], j[free]])], axis=1)
    return np.concatenate([np.stack([child, parent[child]]), pairs[:, trees(*pairs, n)[0]]], axis=1)


def core_of_parts(who: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Pairs of firms that make a spanning forest."""
    step, _ = _steps(who, j)
    return step[:, trees(*step, n)[0]]


def thinned(links: DataFrame, kind: str) -> tuple | None:
    """The core of ``links`` (i, j, repeated or not) of workers with two firms at least, (j, n): how many of these links each firm has, and a broadcast of all firms in order; None beyond FIRMS firms.

    ``kind``: what may be taken away, "i" for a link or a worker, "j" for a firm, "" for nothing. Where it is not "i", the core's links have workers of their own: one for each pair of firms.
    """
    own = links.select("i", "j").where("i is not null and j is not null")
    firms = own.select("j").distinct().limit(FIRMS + 1).toPandas()["j"]
    n = len(firms)
    if n > FIRMS:
        return None
    context = links.sparkSession.sparkContext
    shared = context.broadcast(pd.Index(firms.sort_values().to_numpy()))

    def core(who: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if kind == "i":
            kept = core_of_units(who, j, n)
            return i[kept], j[kept]
        pairs = np.sort((core_of_firms if kind == "j" else core_of_parts)(who, j, n), axis=0)
        key = np.unique(pairs[0].astype(np.int64) * n + pairs[1])
        return np.repeat(key, 2), np.stack([key // n, key % n], axis=1).ravel()

    def run(batches, count: bool):
        ids, seen = shared.value, np.zeros(n, np.int64)
        held_i, held_j, raw_i, raw_j, limit = None, np.zeros(0, np.int64), [], [], LINKS

        def merged(last: bool):
            """What is held and all whole workers that have come since; the rows of a worker that may go on."""
            i, j = np.concatenate(raw_i), np.concatenate(raw_j)
            cut = len(i) if last else int(np.flatnonzero(np.r_[True, i[1:] != i[:-1]])[-1])
            rest = (i[cut:], j[cut:])
            i, j = i[:cut], j[:cut]
            who = np.cumsum(np.r_[True, i[1:] != i[:-1]]) - 1 if len(i) else np.zeros(0, np.int64)
            key = np.unique(who * n + j)
            who, j, i = key // n, key % n, i[np.searchsorted(who, key // n)] if len(i) else i
            several = np.bincount(who)[who] > 1 if len(who) else np.zeros(0, bool)
            i, j = i[several], j[several]
            if count:
                seen[:] += np.bincount(j, minlength=n)
            if kind != "i" and len(i):  # workers of the core are numbers of pairs, from 0
                i = -np.cumsum(np.r_[True, i[1:] != i[:-1]])
            if held_i is not None:
                i, j = np.concatenate([held_i, i]), np.concatenate([held_j, j])
            if not len(i):
                return i, j, rest
            who = np.cumsum(np.r_[True, i[1:] != i[:-1]]) - 1
            order = np.lexsort((j, who))
            return *core(who, i, j[order]), rest

        for own in batches:
            j = ids.get_indexer(own["j"])
            raw_i.append(own["i"].to_numpy())
            raw_j.append(j.astype(np.int64))
            if sum(map(len, raw_j)) > limit:
                held_i, held_j, (i, j) = merged(False)
                raw_i, raw_j, limit = [i], [j], max(LINKS, 2 * len(held_j))
        if raw_i:
            held_i, held_j, _ = merged(True)
            yield pd.DataFrame({"i": held_i, "j": ids.take(held_j), "n": None})
        if count and seen.any():
            at = np.flatnonzero(seen)
            yield pd.DataFrame({"i": None, "j": ids.take(at), "n": seen[at]})

    kinds = dict(own.dtypes)
    schema = f"i {kinds['i'] if kind == 'i' else 'bigint'}, j {kinds['j']}, n bigint"
    parts, rows = max(1, context.defaultParallelism), own
    found = rows.repartition(parts, "i").sortWithinPartitions("i").mapInPandas(lambda b: run(b, True), schema).checkpoint()
    counts = found.where("n is not null").groupBy("j").agg(F.sum("n").alias("n"))
    cores = found.where("n is null").select("i", "j")
    while parts > 1:
        parts = -(-parts // 4)
        cores = cores.repartition(parts, "i").sortWithinPartitions("i").mapInPandas(lambda b: run(b, False), schema).select("i", "j").checkpoint()
    return cores, counts, shared


def condensed(links: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """As :func:`thinned`; beyond FIRMS firms, all links of workers with two firms at least."""
    found = thinned(links, kind)
    if found is not None:
        return found[:2]
    own = links.select("i", "j").where("i is not null and j is not null").distinct()
    own = own.join(own.groupBy("i").count().where("count > 1").select("i"), "i", "left_semi").checkpoint()
    return own, own.groupBy("j").agg(F.count(F.lit(1)).alias("n"))


def firm_components(panel: DataFrame) -> DataFrame:
    """(j, component): least firm id reached through shared workers."""
    found = thinned(panel, "")
    if found is None:
        return spread_labels(panel)
    pairs, _, shared = found
    kind = dict(panel.dtypes)["j"]

    def labels(batches):
        ids, links = shared.value, pd.concat([pd.DataFrame({"i": [], "j": []}), *batches]).sort_values("i", kind="stable")
        ends = ids.get_indexer(links["j"]).reshape(-1, 2)
        yield pd.DataFrame({"j": ids, "component": ids.take(trees(ends[:, 0], ends[:, 1], len(ids))[1])})

    return pairs.repartition(1).mapInPandas(labels, f"j {kind}, component {kind}").checkpoint()


def spread_labels(panel: DataFrame) -> DataFrame:
    """As :func:`firm_components`, for any number of firms.

    Labels go from firms to workers and back until none changes; each round is two aggregates on the distinct matches and is
    checkpointed, so that lineage does not grow.
    """
    matches = panel.select("i", "j").distinct().persist()
    labels = matches.select("j").distinct().withColumn("component", F.col("j")).checkpoint()
    while True:  # labels only fall
        by_worker = matches.join(labels, "j").groupBy("i").agg(F.min("component").alias("component"))
        moved = matches.join(by_worker, "i").groupBy("j").agg(F.min("component").alias("component"))
        # Jump: a label is itself a firm, whose own label may be less.
        jump = moved.select(F.col("j").alias("component"), F.col("component").alias("lower"))
        following = moved.join(jump, "component").select("j", F.col("lower").alias("component")).checkpoint()
        changed = following.join(labels.withColumnRenamed("component", "was"), "j").where("component <> was").limit(1).count()
        labels = following
        if not changed:
            break
    matches.unpersist()
    return labels


def largest_connected(panel: DataFrame) -> DataFrame:
    """The observations of the component with most of them (ties: least firm id)."""
    labelled = panel.join(firm_components(panel), "j")
    best = labelled.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    return labelled.join(F.broadcast(best), "component", "left_semi").select(panel.columns)


def reachable(links: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes (j) that directed ``links`` (j1, j2) reach from ``start`` (j)."""
    seen = start.select("j").distinct().checkpoint()
    size = seen.count()
    while True:  # nodes are only added
        seen = seen.unionByName(links.join(seen.withColumnRenamed("j", "j1"), "j1").select(F.col("j2").alias("j"))).distinct().checkpoint()
        grown = seen.count()
        if grown == size:
            break
        size = grown
    return seen


def strongly_connected(events: DataFrame) -> DataFrame:
    """Firms (j) of the strongly connected set that holds the firm with most moves (ties: least id)."""
    links = events.where("j1 <> j2").select("j1", "j2").distinct().persist()
    ends = events.where("j1 <> j2").select(F.explode(F.array("j1", "j2")).alias("j"))
    start = ends.groupBy("j").count().orderBy(F.desc("count"), "j").limit(1).select("j")
    back = links.select(F.col("j2").alias("j1"), F.col("j1").alias("j2"))
    return reachable(links, start).join(reachable(back, start), "j", "left_semi")


def strong_components(links: DataFrame) -> DataFrame:
    """(j, component) of the directed ``links`` (j1, j2): firms that reach each other share the greatest id among them.

    Firms without a link in or out are components of their own and go first. Then the greatest id that reaches a firm becomes its colour (with jumps to the colour of
    the colour), and from each firm that has its own colour a search against the links within that colour finds its component, which goes; and so on until no firm is left.
    """
    links = links.where("j1 <> j2").select("j1", "j2").distinct().checkpoint()
    nodes = links.select(F.explode(F.array("j1", "j2")).alias("j")).distinct().checkpoint()
    found = nodes.withColumn("component", F.col("j")).limit(0)
    while not nodes.isEmpty():  # every round takes firms away
        inner = links.select(F.col("j1").alias("j")).intersect(links.select(F.col("j2").alias("j"))).checkpoint()
        alone = nodes.join(inner, "j", "left_anti").withColumn("component", F.col("j")).checkpoint()
        if not alone.isEmpty():
            found = found.unionByName(alone)
            nodes = inner
            links = links.join(inner.withColumnRenamed("j", "j1"), "j1", "left_semi").join(inner.withColumnRenamed("j", "j2"), "j2", "left_semi").select("j1", "j2").checkpoint()
            continue
        colour = nodes.withColumn("c", F.col("j")).checkpoint()
        while True:  # colours only rise
            sent = links.join(colour.withColumnRenamed("j", "j1"), "j1").select(F.col("j2").alias("j"), "c")
            raised = colour.unionByName(sent).groupBy("j").agg(F.max("c").alias("c"))
            jump = raised.select(F.col("j").alias("c"), F.col("c").alias("higher"))
            following = raised.join(jump, "c").select("j", F.col("higher").alias("c")).checkpoint()
            changed = following.join(colour.withColumnRenamed("c", "was"), "j").where("c <> was").limit(1).count()
            colour = following
            if not changed:
                break
        ends = links.join(colour.select(F.col("j").alias("j1"), F.col("c").alias("c1")), "j1").join(colour.select(F.col("j").alias("j2"), F.col("c").alias("c2")), "j2")
        within = ends.where("c1 = c2").select(F.col("j2").alias("j1"), F.col("j1").alias("j2")).checkpoint()  # against the links
        reached = reachable(within, colour.where("j = c"))
        members = colour.join(reached, "j", "left_semi").select("j", F.col("c").alias("component")).checkpoint()
        found = found.unionByName(members)
        nodes = nodes.join(members, "j", "left_anti").checkpoint()
        for end in ("j1", "j2"):
            links = links.join(members.select(F.col("j").alias(end)), end, "left_anti")
        links = links.select("j1", "j2").checkpoint()
    return found


def largest_strongly_connected(panel: DataFrame) -> DataFrame:
    """The observations of the strongly connected set of firms, by workers' moves, with most of them (ties: greatest firm id)."""
    from .panel import event_study

    links = event_study(panel.select("i", "j", "t", "y")).where("j1 <> j2").select("j1", "j2")
    labelled = panel.join(strong_components(links), "j")
    best = labelled.groupBy("component").count().orderBy(F.desc("count"), F.desc("component")).limit(1).select("component")
    return labelled.join(F.broadcast(best), "component", "left_semi").select(panel.columns)


def shared_movers(panel: DataFrame) -> DataFrame:
    """(j, k, n): pairs of firms j < k and the number of workers that both have had. A worker gives as many rows as it has pairs of firms."""
    own = panel.select("i", "j").distinct()
    other = own.withColumnRenamed("j", "k")
    return own.join(other, "i").where("j < k").groupBy("j", "k").agg(F.count(F.lit(1)).alias("n"))


def neighbours(panel: DataFrame, firm) -> DataFrame:
    """(j): firms two steps away in the graph of workers and firms: those that share a worker with ``firm``."""
    own = panel.select("i", "j").distinct()
    workers = own.where(F.col("j") == F.lit(firm)).select("i")
    return own.join(workers, "i", "left_semi").where(F.col("j") != F.lit(firm)).select("j").distinct()


def spanning_forest(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, parent, depth): breadth-first trees of the undirected ``edges`` (a, b) from ``roots`` (node); as many rounds as the graph is deep."""
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).persist()
    front = roots.select("node", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth")).checkpoint()
    depth, reached, last = 0, front, front.select("node").limit(0)
    while True:  # nodes are only added
        depth += 1
        near = both.join(front.select(F.col("node").alias("x")), "x").groupBy("y").agg(F.min("x").alias("parent"))
        seen = last.unionByName(front.select("node"))  # neighbours of a level lie in it, in the one before or in the next
        last, front = front.select("node"), near.withColumnRenamed("y", "node").join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
        if depth % 16 == 0:
            reached = reached.checkpoint()
    both.unpersist()
    return reached.checkpoint()


class Tree:
    """A rooted forest (node, parent, depth) with the ancestors 1, 2, 4, ... steps up: sums over subtrees and meeting points take as many rounds as the depth has bits."""

    def __init__(self, forest: DataFrame):
        self.forest = forest
        deepest = forest.agg(F.max("depth")).first()[0] or 0
        self.up = [forest.where("parent is not null").select("node", F.col("parent").alias("up")).checkpoint()]
        while 2 ** len(self.up) <= deepest:
            last = self.up[-1]
            self.up.append(last.join(last.select(F.col("node").alias("up"), F.col("up").alias("far")), "up").select("node", F.col("far").alias("up")).checkpoint())

    def below(self, values: DataFrame, how: dict[str, str]) -> DataFrame:
        """``values`` (node, columns) gathered over the subtree of each node of ``values``: ``how`` names an aggregate for each column.

        What stands less than 2 ** k steps below is known for every node after round k; the next adds that of the nodes 2 ** k steps below.
        """
        own = values
        for up in self.up:
            far = own.join(up, "node").select(F.col("up").alias("node"), *how)
            own = own.unionByName(far).groupBy("node").agg(*[F.expr(f"{f}({c})").alias(c) for c, f in how.items()]).checkpoint()
        return own

    def meetings(self, edges: DataFrame) -> DataFrame:
        """``edges`` (a, b between nodes of like or neighbouring depth) with ``top``: the depth of the lowest common ancestor of a and b."""
        depth = self.forest.select("node", "depth")

        def moved(found: DataFrame, end: str, up: DataFrame, where) -> DataFrame:
            step = up.select(F.col("node").alias(end), F.col("up").alias("_up"))
            return found.join(step, end, "left").withColumn(end, F.when(where & F.col("_up").isNotNull(), F.col("_up")).otherwise(F.col(end))).drop("_up")

        own = edges.withColumn("x", F.col("a")).withColumn("y", F.col("b"))
        for end in ("x", "y"):
            own = own.join(depth.select(F.col("node").alias(end), F.col("depth").alias(f"d{end}")), end)
        own = moved(moved(own, "x", self.up[0], F.col("dx") > F.col("dy")), "y", self.up[0], F.col("dy") > F.col("dx")) if self.up else own
        own = own.withColumn("d", F.least("dx", "dy")).drop("dx", "dy").checkpoint()
        for up in reversed(self.up):
            far = own
            for end in ("x", "y"):
                far = far.join(up.select(F.col("node").alias(end), F.col("up").alias(f"u{end}")), end, "left")
            apart = F.col("ux").isNotNull() & F.col("uy").isNotNull() & (F.col("ux") != F.col("uy"))
            own = far.select("a", "b", "d", F.when(apart, F.col("ux")).otherwise(F.col("x")).alias("x"), F.when(apart, F.col("uy")).otherwise(F.col("y")).alias("y")).checkpoint()
        own = own.join(depth.select(F.col("node").alias("x"), F.col("depth").alias("dx")), "x")
        return own.select("a", "b", F.when(F.col("x") == F.col("y"), F.col("dx")).otherwise(F.col("dx") - 1).alias("top"))


def named(links: DataFrame) -> DataFrame:
    """``links`` (i, j) with the nodes a and b of the worker-firm graph."""
    return links.select("i", "j", F.concat(F.lit("i"), F.col("i").cast("string")).alias("a"), F.concat(F.lit("j"), F.col("j").cast("string")).alias("b"))


def rooted(links: DataFrame, edges: DataFrame) -> tuple[Tree, DataFrame]:
    """A forest over ``edges`` (those of ``links``, :func:`named`), and the edges outside it."""
    roots = firm_components(links).select(F.concat(F.lit("j"), F.col("component").cast("string")).alias("node")).distinct()
    forest = spanning_forest(edges, roots)
    worker = F.col("node").startswith("i")
    tree = forest.where("parent is not null").select(F.when(worker, F.col("node")).otherwise(F.col("parent")).alias("a"), F.when(worker, F.col("parent")).otherwise(F.col("node")).alias("b"))
    return Tree(forest), edges.join(tree, ["a", "b"], "left_anti").select("a", "b").checkpoint()


def bridges(links: DataFrame) -> DataFrame:
    """(i, j) of ``links`` (i, j, distinct) that no cycle of the worker-firm graph holds.

    Each link outside a spanning forest gets two 64-bit hashes. Summed by exclusive or over the nodes of a subtree, links within it
    cancel out, so that nothing is left (but for a chance of 2 ** -128) exactly where only the tree's own link leads out of it.
    """
    edges = named(links).checkpoint()
    tree, rest = rooted(links, edges)
    hashed = rest.select("a", "b", F.xxhash64("a", "b", F.lit(1)).alias("h"), F.xxhash64("a", "b", F.lit(2)).alias("g"))
    ends = hashed.select(F.explode(F.array("a", "b")).alias("node"), "h", "g").groupBy("node").agg(F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g"))
    own = tree.forest.select("node").join(ends, "node", "left").fillna(0, ["h", "g"])
    cut = tree.below(own, {"h": "bit_xor", "g": "bit_xor"}).where("h = 0 and g = 0").join(tree.up[0], "node") if tree.up else own.limit(0).withColumn("up", F.lit(""))
    return edges.join(cut.select(F.least("node", "up").alias("a"), F.greatest("node", "up").alias("b")), ["a", "b"], "left_semi").select("i", "j")


def blocks(links: DataFrame) -> DataFrame:
    """(node, block) for every node of the worker-firm graph of ``links`` (i, j, distinct) and every biconnected block it lies in. Nodes are ids after the letter i or j.

    The cycle that a link outside a spanning forest closes puts all tree links on it in one block: the two at its ends, and a link with the one above it
    where a cycle from below reaches higher still. What is so tied together is a block.
    """
    edges = named(links).checkpoint()
    tree, rest = rooted(links, edges)
    met = tree.meetings(rest)
    ends = met.select(F.explode(F.array("a", "b")).alias("node"), "top").groupBy("node").agg(F.min("top").alias("top"))
    reach = tree.below(tree.forest.select("node").join(ends, "node", "left"), {"top": "min"}) if tree.up else ends
    parents = tree.forest.where("parent is not null").select("node", "parent", "depth")
    # A tree link is known by its lower end.
    lower = met.select("a", "b", "top").join(tree.forest.select(F.col("node").alias("a"), F.col("depth").alias("da")), "a").join(tree.forest.select(F.col("node").alias("b"), F.col("depth").alias("db")), "b")
    beside = lower.where("top < da and top < db").select(F.col("a").alias("x"), F.col("b").alias("y"))
    over = reach.join(parents, "node").where("top < depth - 1").select(F.col("node").alias("x"), F.col("parent").alias("y"))
    tied = beside.unionByName(over).distinct()
    each = tied.select(F.concat_ws(" ", "x", "y").alias("i"), F.explode(F.array("x", "y")).alias("j"))
    alone = parents.select(F.concat(F.lit("="), F.col("node")).alias("i"), F.col("node").alias("j"))
    label = firm_components(each.unionByName(alone)).select(F.col("j").alias("node"), F.col("component").alias("block"))
    return label.join(parents, "node").select(F.explode(F.array("node", "parent")).alias("node"), "block").distinct()


def cut_nodes(links: DataFrame, kind: str) -> DataFrame:
    """(i) workers or (j) firms (``kind`` "i" or "j") without which other nodes of their component are apart: those in several blocks."""
    several = blocks(links).groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    own = links.select(kind).distinct().withColumn("node", F.concat(F.lit(kind), F.col(kind).cast("string")))
    return own.join(several, "node", "left_semi").select(kind)


def most_links(links: DataFrame) -> DataFrame:
    """The ``links`` (i, j) of the component with most of them (ties: least firm id)."""
    labelled = links.join(firm_components(links), "j")
    best = labelled.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    return labelled.join(F.broadcast(best), "component", "left_semi").select(links.columns)


def leave_out(panel: DataFrame, unit: str = "match") -> DataFrame:
    """Largest set whose firms stay connected when any one match, spell, observation, worker or firm (``unit``) is left out.

    Workers and firms: see :func:`leave_node_out`. Of the others, a match of one unit must not be a bridge of the worker-firm graph of movers; one of several units may. Bridges go and the
    largest component stays, with the stayers of its firms. Bridges are searched in the core of the links, whose workers they all have.
    """
    if unit in ("worker", "firm"):
        return leave_node_out(panel, unit)
    if unit == "match":
        units = F.lit(1)
    elif unit == "observation":
        units = F.count(F.lit(1))
    elif unit == "spell":
        begins = F.coalesce(F.lag("j").over(Window.partitionBy("i").orderBy("t", "j")) != F.col("j"), F.lit(True))
        units = F.sum("_begins")
    else:
        raise ValueError(f"unknown unit {unit}")
    core, counts = condensed(panel, "i")
    firms = best_firms(core, counts)
    core = core.join(firms, "j", "left_semi").checkpoint()
    weak = bridges(core).checkpoint()
    # Units are counted where a bridge is, over all rows of its worker.
    own = panel.join(weak.select("i").distinct(), "i", "left_semi")
    own = own.withColumn("_begins", begins.cast("int")) if unit == "spell" else own
    gone = own.join(weak, ["i", "j"], "left_semi").groupBy("i", "j").agg(units.alias("units")).where("units = 1").select("i", "j").checkpoint()
    lost = gone.groupBy("j").agg(F.count(F.lit(1)).alias("lost"))
    left = counts.join(firms, "j", "left_semi").join(lost, "j", "left").select("j", (F.col("n") - F.coalesce("lost", F.lit(0))).alias("n")).where("n > 0")
    good = best_firms(core.join(gone, ["i", "j"], "left_anti"), left)
    return panel.join(good, "j", "left_semi").join(gone, ["i", "j"], "left_anti").select(panel.columns)


def best_firms(core: DataFrame, counts: DataFrame) -> DataFrame:
    """(j): firms of the component of the links ``core`` with most links by ``counts`` (j, n); ties: least firm id."""
    labelled = counts.join(firm_components(core), "j").checkpoint()
    best = labelled.groupBy("component").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    return labelled.join(F.broadcast(best), "component", "left_semi").select("j").checkpoint()


def leave_node_out(panel: DataFrame, unit: str) -> DataFrame:
    """Largest set whose firms stay connected when any one worker, or firm, is left out.

    In the graph of movers and their firms, workers (firms) without which other firms are apart go, the largest component stays, and so on until none is left.
    Of the rows, those of the remaining firms stay, but for the workers who went.
    """
    kind = "i" if unit == "worker" else "j"
    every = written(panel.select("i", "j").distinct(), "links")
    links, gone = every, None
    while True:  # links only go
        core, counts = condensed(links, kind)
        firms = best_firms(core, counts)
        cut = cut_nodes(core.join(firms, "j", "left_semi").checkpoint(), kind).checkpoint()
        if cut.isEmpty():
            break
        gone = cut if gone is None else gone.unionByName(cut)
        links = links.join(firms, "j", "left_semi").join(cut, kind, "left_anti")
    drop(every)
    kept = panel.join(firms, "j", "left_semi")
    if gone is not None and unit == "worker":
        kept = kept.join(gone, "i", "left_anti")
    return kept.select(panel.columns)


def leave_match_out(panel: DataFrame) -> DataFrame:
    """Largest set that stays connected when any one match is left out."""
    return leave_out(panel, "match")
