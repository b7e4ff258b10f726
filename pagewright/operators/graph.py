"""Graph operators on edge relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Edges up to which a graph is handled in one task.
SMALL = 200_000


def in_one_task(df: DataFrame, run: Callable, schema) -> DataFrame:
    """Applies ``run`` to all rows at once, for relations whose size has been checked."""
    return df.coalesce(1).groupBy().applyInPandas(run, schema)


def united(pairs: list[tuple]) -> dict:
    """The smallest node of each node's component; pairs (a, b)."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def connected_components(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame], a: str = "a", b: str = "b", most_rounds: int = 60, small: int = 0) -> DataFrame:
    """(node, root) for every node of an edge but the roots; root is the component's smallest node.

    At most ``small`` edges are handled in one task; more by rounds.
    Alternates large-star and small-star steps until the edges are stars; the rounds grow with the
    logarithm of the longest path. ``keep`` makes a round's edges durable and cuts their lineage. Joins are
    merged, as edges in files look smaller to Spark than they are in the driver.
    """
    now = keep(edges.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).where("node <> root").distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("root").alias("node"), F.col("node").alias("root")))
        low = both.groupBy("node").agg(F.min("root").alias("low"))
        large = both.join(low.hint("merge"), "node").where("root > node").select(F.col("root").alias("node"), F.least("low", "node").alias("root")).distinct()
        low = large.groupBy("node").agg(F.min("root").alias("low"))
        met = large.join(low.hint("merge"), "node")
        small = met.where("root <> low").select(F.col("root").alias("node"), F.col("low").alias("root")).unionByName(low.select("node", F.col("low").alias("root"))).distinct()
        now = keep(small, "edges")
        new = tuple(now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("node", "root"), F.lit(2**31)))).first())
        if new == mark:
            return now
        mark = new
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")


# --- editing: edges(src, dst, cost, label), nodes(id) ----------------------------------------------


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def add_nodes(nodes: DataFrame, more: DataFrame) -> DataFrame:
    return nodes.unionByName(more).distinct()


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    return edges.unionByName(more)


def remove_node_and_edges(edges: DataFrame, node) -> DataFrame:
    return edges.where((F.col("src") != node) & (F.col("dst") != node))


def remove_node(edges: DataFrame, node) -> DataFrame:
    """Takes a node out and joins each of its sources to each of its targets."""
    kept = remove_node_and_edges(edges, node)
    into = edges.where((F.col("dst") == node) & (F.col("src") != node)).select("src", F.col("cost").alias("c1"), F.lit(1).alias("k"))
    out = edges.where((F.col("src") == node) & (F.col("dst") != node)).select("dst", F.col("cost").alias("c2"), "label", F.lit(1).alias("k"))
    return kept.unionByName(into.join(out, "k").select("src", "dst", (F.col("c1") + F.col("c2")).alias("cost"), "label"))


def remove_edge(edges: DataFrame, src, dst) -> DataFrame:
    return edges.where(~((F.col("src") == src) & (F.col("dst") == dst)))


def has_edge(edges: DataFrame, src, dst) -> bool:
    return not edges.where((F.col("src") == src) & (F.col("dst") == dst)).isEmpty()


def make_undirected(edges: DataFrame) -> DataFrame:
    """One row per pair of ends, smaller first; of several the cheapest."""
    e = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "cost", "label")
    return make_singly_connected(e)


def make_directed(edges: DataFrame) -> DataFrame:
    """Both directions of every undirected edge."""
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost", "label"))


def make_singly_connected(edges: DataFrame, most: float | None = None) -> DataFrame:
    """Of parallel edges the cheapest, and none dearer than ``most``."""
    e = edges if most is None else edges.where(F.col("cost") <= most)
    return e.groupBy("src", "dst").agg(F.min(F.struct("cost", "label")).alias("e")).select("src", "dst", "e.cost", "e.label")


def is_multi_connected(edges: DataFrame) -> bool:
    return not edges.groupBy("src", "dst").count().where("count > 1").isEmpty()


def is_self_connected(edges: DataFrame) -> bool:
    return not edges.where("src = dst").isEmpty()


def make_not_self_connected(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, n): edges at each end."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))


def is_cyclic(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame], small: int = SMALL) -> bool:
    """Whether a directed graph has a cycle: nodes without an incoming edge are peeled off until none is left to peel."""
    now = edges.select("src", "dst")
    if small and now.limit(small + 1).count() <= small:
        import pandas as pd

        def peel(pdf: pd.DataFrame) -> pd.DataFrame:
            into, out = pdf["dst"].value_counts().to_dict(), pdf.groupby("src")["dst"].agg(list).to_dict()
            free = [x for x in out if x not in into]
            left = len(pdf)
            while free:
                for y in out.pop(free.pop(), []):
                    left -= 1
                    into[y] -= 1
                    if not into[y]:
                        free.append(y)
            return pd.DataFrame({"cyclic": [left > 0]})

        found = in_one_task(now, peel, "cyclic boolean").first()
        return bool(found and found["cyclic"])
    while not now.isEmpty():
        left = keep(now.join(now.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"), "peeled")
        if left.count() == now.count():
            return True
        now = left
    return False


def nsubgraphs(nodes: DataFrame, edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> int:
    return subgraph_roots(nodes, edges, keep).select("root").distinct().count()


def subgraph_roots(nodes: DataFrame, edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(id, root): the smallest node of each weak component."""
    stars = connected_components(edges, keep, "src", "dst", small=SMALL).withColumnRenamed("node", "id")
    return nodes.join(stars, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def size_of_subgraph(nodes: DataFrame, edges: DataFrame, node, keep: Callable[[DataFrame, str], DataFrame]) -> int:
    roots = subgraph_roots(nodes, edges, keep)
    own = roots.where(F.col("id") == node).select("root")
    return roots.join(own, "root", "left_semi").count()


def is_tree(nodes: DataFrame, edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> bool:
    return nsubgraphs(nodes, edges, keep) == 1 and make_undirected(make_not_self_connected(edges)).count() == nodes.count() - 1


# --- traversal -------------------------------------------------------------------------------------


def breadth_first(edges: DataFrame, start: DataFrame, keep: Callable[[DataFrame, str], DataFrame], directed: bool = True) -> DataFrame:
    """(start, id, depth) of all nodes reachable from each start (a relation of ``id``), level by level."""
    e = edges.select("src", "dst")
    e = keep((e if directed else e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))).distinct(), "arcs")
    seen = keep(start.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth")), "seen")
    front = seen
    depth = 0
    while not front.isEmpty():
        depth += 1
        step = front.join(e, F.col("id") == F.col("src")).select("start", F.col("dst").alias("id")).distinct()
        front = keep(step.join(seen, ["start", "id"], "left_anti").withColumn("depth", F.lit(depth)), "front")
        seen = keep(seen.unionByName(front), "seen")
    return seen


def has_path(edges: DataFrame, a, b, keep: Callable[[DataFrame, str], DataFrame]) -> bool:
    start = edges.sparkSession.createDataFrame([(a,)], ["id"])
    return not breadth_first(edges, start, keep).where((F.col("id") == b) & (F.col("depth") > 0)).isEmpty()


def shortest_paths(edges: DataFrame, start: DataFrame, keep: Callable[[DataFrame, str], DataFrame], directed: bool = True) -> DataFrame:
    """(start, id, cost, path): cheapest paths from each start, path listed from the destination back.

    Relaxes all edges of nodes that got cheaper, until none does. Costs must not be negative.
    """
    e = edges.select("src", "dst", "cost")
    e = e if directed else e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost"))
    e = keep(e.groupBy("src", "dst").agg(F.min("cost").cast("double").alias("w")), "arcs")
    best = keep(start.select(F.col("id").alias("start"), "id", F.lit(0.0).alias("cost"), F.array("id").alias("path")), "best")
    front = best
    while not front.isEmpty():
        step = front.join(e, F.col("id") == F.col("src")).select("start", F.col("dst").alias("id"), (F.col("cost") + F.col("w")).alias("cost"), F.concat(F.array("dst"), "path").alias("path"))
        step = step.groupBy("start", "id").agg(F.min(F.struct("cost", F.size("path").alias("n"), "path")).alias("s")).select("start", "id", "s.cost", "s.path")
        old = best.select("start", "id", F.col("cost").alias("old"))
        front = keep(step.join(old, ["start", "id"], "left").where("old is null or cost < old - 1e-12").drop("old"), "front")
        best = keep(best.join(front, ["start", "id"], "left_anti").unionByName(front), "best")
    return best


def all_pairs_shortest_paths(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame], directed: bool = True) -> DataFrame:
    return shortest_paths(edges, nodes_of(edges), keep, directed)


def spanning_tree(edges: DataFrame, root, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(id, parent, depth): a breadth-first tree of the undirected graph; the parent is the smallest nearer neighbour."""
    start = edges.sparkSession.createDataFrame([(root,)], ["id"])
    level = breadth_first(edges, start, keep, directed=False).select("id", "depth")
    both = make_directed(edges.select("src", "dst", F.lit(0.0).alias("cost"), F.lit("").alias("label"))).select("src", "dst").distinct()
    up = both.join(level.select(F.col("id").alias("src"), F.col("depth").alias("d")), "src").select(F.col("dst").alias("id"), F.col("src").alias("parent"), "d")
    return level.join(up, "id", "left").where("depth = 0 or d = depth - 1").groupBy("id", "depth").agg(F.min(F.when(F.col("depth") > 0, F.col("parent"))).alias("parent")).select("id", "parent", "depth")


def minimum_spanning_tree(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame], small: int = SMALL) -> DataFrame:
    """(src, dst, cost) of the minimum spanning forest of an undirected graph, by rounds of joining each component over its cheapest edge.

    Equal costs are told apart by the ends, so the result doesn't depend on the partitioning. At most ``small`` edges
    are handled in one task.
    """
    e = keep(make_undirected(make_not_self_connected(edges.select("src", "dst", "cost", F.lit("").alias("label")))).select("src", "dst", "cost"), "edges")
    if e.limit(small + 1).count() <= small:
        import pandas as pd

        def kruskal(pdf: pd.DataFrame) -> pd.DataFrame:
            parent: dict = {}

            def find(x):
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            pdf = pdf.sort_values(["cost", "src", "dst"], ignore_index=True)
            taken = []
            for i, (p, q) in enumerate(zip(pdf["src"], pdf["dst"], strict=True)):
                p, q = find(p), find(q)
                if p != q:
                    parent[p] = q
                    taken.append(i)
            return pdf.loc[taken]

        return in_one_task(e, kruskal, e.schema)
    of = keep(nodes_of(e).select("id", F.col("id").alias("part")), "parts")
    tree = None
    while True:
        a = of.select(F.col("id").alias("src"), F.col("part").alias("p"))
        b = of.select(F.col("id").alias("dst"), F.col("part").alias("q"))
        across = e.join(a, "src").join(b, "dst").where("p <> q")
        pick = F.struct("cost", "src", "dst", "p", "q")
        ends = across.select(F.col("p").alias("part"), pick.alias("s")).unionByName(across.select(F.col("q").alias("part"), pick.alias("s")))
        best = keep(ends.groupBy("part").agg(F.min("s").alias("s")).select("s.*").distinct(), "cheapest")
        if best.isEmpty():
            break
        new = best.select("src", "dst", "cost")
        tree = new if tree is None else tree.unionByName(new)
        stars = connected_components(best.select(F.col("p").alias("a"), F.col("q").alias("b")), keep)
        of = keep(of.join(stars.withColumnRenamed("node", "part"), "part", "left").select("id", F.coalesce("root", "part").alias("part")), "parts")
    return tree if tree is not None else e


def colorize(nodes: DataFrame, edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame], colors: int = 6) -> DataFrame:
    """(id, color): neighbours differ. Rounds of independent sets: a node takes its turn when it outranks its uncoloured neighbours, and takes the least free colour.

    Raises when more than ``colors`` would be needed by this order.
    """
    both = keep(make_directed(make_not_self_connected(edges.select("src", "dst", F.lit(0.0).alias("cost"), F.lit("").alias("label")))).select("src", "dst").distinct(), "arcs")
    deg = both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    rank = keep(nodes.join(deg, "id", "left").select("id", F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.xxhash64("id").alias("h"), "id").alias("rank")), "ranks")
    done = None
    while True:
        left = rank if done is None else rank.join(done, "id", "left_anti")
        if left.isEmpty():
            return rank.select("id", F.lit(0).alias("color")) if done is None else done
        rival = both.join(left.select(F.col("id").alias("dst"), F.col("rank").alias("other")), "dst").groupBy(F.col("src").alias("id")).agg(F.max("other").alias("other"))
        turn = left.join(rival, "id", "left").where("other is null or rank > other").select("id")
        if done is None:
            new = turn.select("id", F.lit(0).alias("color"))
        else:
            used = both.join(done.select(F.col("id").alias("dst"), "color"), "dst").groupBy(F.col("src").alias("id")).agg(F.collect_set("color").alias("used"))
            free = F.array_min(F.array_except(F.sequence(F.lit(0), F.lit(colors)), F.coalesce("used", F.array().cast("array<int>"))))
            new = turn.join(used, "id", "left").select("id", F.when(free >= colors, F.raise_error(F.lit("not enough colours"))).otherwise(free).cast("int").alias("color"))
        done = keep(new if done is None else done.unionByName(new), "colors")


def optimize_partitions(parts: DataFrame, most: int = 16) -> DataFrame:
    """(root, members): of scored groups of nodes (root, members array, score), the disjoint cover of each component with the best mean score.

    Components of more than ``most`` nodes stay ungrouped (each node by itself).
    """
    import pandas as pd

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = [(frozenset(m), float(s)) for m, s in zip(pdf["members"], pdf["score"], strict=True)]
        everything = sorted(frozenset().union(*[g for g, _ in groups]))
        if len(everything) > most:
            out = [[x] for x in everything]
        else:
            top: list = [None, -1.0]

            def go(left: frozenset, chosen: list, total: float) -> None:
                if not left:
                    mean = total / len(chosen)
                    if mean > top[1] + 1e-12:
                        top[:] = [list(chosen), mean]
                    return
                first = min(left)
                for g, s in groups:
                    if first in g and g <= left:
                        go(left - g, [*chosen, sorted(g)], total + s)

            go(frozenset(everything), [], 0.0)
            out = top[0] or [[x] for x in everything]
        return pd.DataFrame({"root": [pdf["root"].iloc[0]] * len(out), "members": out})

    return parts.groupBy("root").applyInPandas(best, "root long, members array<long>")


def graphviz(edges: DataFrame, directed: bool = True) -> DataFrame:
    """(line): one line of dot a row, without the frame."""
    arrow = " -> " if directed else " -- "
    return edges.select(F.concat(F.lit('"'), F.col("src").cast("string"), F.lit(f'"{arrow}"'), F.col("dst").cast("string"), F.lit('" [label="'), F.col("cost").cast("string"), F.lit('"];')).alias("line"))


# --- restrictions ----------------------------------------------------------------------------------

#: What a graph may have; a kind of graph is the set of what it allows.
FLAGS = ("directed", "cyclic", "blob", "multi_connected", "self_connected")
KINDS = {
    "free": frozenset(FLAGS),
    "dag": frozenset({"directed", "blob", "multi_connected"}),
    "tree": frozenset({"directed"}),
    "undirected": frozenset({"cyclic", "blob", "multi_connected"}),
    "undirected_tree": frozenset(),
}


def violations(nodes: DataFrame, edges: DataFrame, kind: str, keep: Callable[[DataFrame, str], DataFrame]) -> list[str]:
    """The flags that a kind of graph forbids and this graph needs, in the order of FLAGS."""
    allowed = KINDS[kind]
    plain = edges if "directed" in allowed else make_undirected(edges)
    found = []
    if "cyclic" not in allowed and (is_cyclic(edges, keep) if "directed" in allowed else undirected_cycle(nodes, edges, keep)):
        found.append("cyclic")
    if "blob" not in allowed and nsubgraphs(nodes, edges, keep) > 1:
        found.append("blob")
    if "multi_connected" not in allowed and is_multi_connected(edges if plain is edges else edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))):
        found.append("multi_connected")
    if "self_connected" not in allowed and is_self_connected(edges):
        found.append("self_connected")
    return found


def conforms_restrictions(nodes: DataFrame, edges: DataFrame, kind: str, keep: Callable[[DataFrame, str], DataFrame]) -> bool:
    return not violations(nodes, edges, kind, keep)


def undirected_cycle(nodes: DataFrame, edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> bool:
    """Whether an undirected graph has a cycle: a forest has as many edges as nodes less components."""
    e = make_not_self_connected(edges)
    return is_self_connected(edges) or make_undirected(e).count() > nodes.count() - nsubgraphs(nodes, edges, keep)


def make_acyclic(edges: DataFrame) -> DataFrame:
    """The edges that lead from a smaller to a larger node: any order of the nodes leaves no cycle, and no edge of a graph that follows it goes."""
    return edges.where("src < dst")


def make_tree(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(src, dst, cost): the cheapest edges that connect what the graph connects, without a cycle."""
    return minimum_spanning_tree(edges, keep)


def make_blob(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): the nodes without an edge may stay, as a blob is a set of nodes; all nodes, those of edges included."""
    return nodes.select("id").unionByName(nodes_of(edges)).distinct()


def depth_first(edges: DataFrame, start, small: int = SMALL) -> DataFrame:
    """(place, id) in the order of a depth-first walk from ``start``, smaller neighbours first. A walk is sequential, so the graph may have at most ``small`` edges."""
    import pandas as pd

    e = edges.select("src", "dst").distinct()
    if e.limit(small + 1).count() > small:
        raise ValueError(f"a depth-first walk needs a graph of at most {small} edges")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in sorted(zip(pdf["src"], pdf["dst"], strict=True), reverse=True):
            near.setdefault(a, []).append(b)
        seen, stack = {}, [start]
        while stack:
            x = stack.pop()
            if x not in seen:
                seen[x] = len(seen)
                stack += [y for y in near.get(x, []) if y not in seen]
        return pd.DataFrame({"place": list(seen.values()), "id": list(seen)})

    return in_one_task(e, run, "place int, id long")


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nnodes, nedges)."""
    return nodes.agg(F.count("*").alias("nnodes")).crossJoin(edges.agg(F.count("*").alias("nedges")))


def has_node(nodes: DataFrame, node) -> bool:
    return not nodes.where(F.col("id") == node).isEmpty()
