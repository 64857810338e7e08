"""Graph operators (G5-G25) over edge tables: loops of joins whose state is written between rounds."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.session import Table, ship

#: Louvain, residual closeness and GEXF hold a whole thresholded token graph at once; larger ones are refused.
LOCAL_EDGES = 1_000_000
#: Terms whose pairs a task counts in one matrix of its own.
HEAVY = 4096


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "weight").union(edges.select("b", "a", "weight"))


def jaccard_weights(sets: DataFrame) -> DataFrame:
    """G1: (a, b, weight), a < b, of terms that share documents: shared documents over all documents of either.
    (doc_id, term) is unique."""
    return list_weights(Table(sets.groupBy("doc_id").agg(F.collect_list("term").alias("terms"))).df)


def list_weights(lists: DataFrame) -> DataFrame:
    """G1 of one row a document, with all its terms in a list of bounded length (top-k terms).

    Pairs of the most frequent terms are counted in each task as a matrix product of documents, so that what is shuffled
    grows with the terms and tasks only; pairs with any other term are made within the document's list.
    """
    names = Table(lists.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("f"))).df
    top = names.orderBy(F.desc("f"), "term").limit(HEAVY)
    shared = _heavy_pairs(lists, [r.term for r in top.collect()])  # HEAVY at most
    if names.count() > HEAVY:
        shared = shared.union(_light_pairs(lists, names, top))
    first = names.select(F.col("term").alias("a"), F.col("f").alias("fa"))
    second = names.select(F.col("term").alias("b"), F.col("f").alias("fb"))
    weight = F.col("i") / (F.col("fa") + F.col("fb") - F.col("i"))
    return shared.join(first, "a").join(second, "b").select("a", "b", weight.alias("weight"))


def _heavy_pairs(lists: DataFrame, terms: list[str]) -> DataFrame:
    """(a, b, i), a < b, of the terms given."""
    spark = ship(lists.sparkSession)
    terms = sorted(terms)
    names = pa.array(terms, pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(names)
        total = np.zeros((n, n))
        for batch in batches:
            at = pc.fill_null(pc.index_in(batch.column(0).flatten(), value_set=names), -1).to_numpy()
            row = np.repeat(np.arange(len(batch)), np.diff(batch.column(0).offsets.to_numpy()))
            for k in range(0, len(batch), 1000):
                cells = (row >= k) & (row < k + 1000) & (at >= 0)
                has = np.zeros((min(1000, len(batch) - k), n), np.float32)
                has[row[cells] - k, at[cells]] = 1
                total += has.T @ has
        a, b = np.nonzero(np.triu(total, 1))
        for k in range(0, len(a), 262_144):
            i, j = a[k : k + 262_144], b[k : k + 262_144]
            yield pa.RecordBatch.from_pydict({"a": i.astype(np.int32), "b": j.astype(np.int32), "i": total[i, j].astype(np.int64)})

    # Each task sends up to a row a pair of terms: as many tasks as keep the cores busy, whatever the number of documents.
    tasks = lists.select("terms").coalesce(2 * spark.sparkContext.defaultParallelism)
    counts = tasks.mapInArrow(count, "a int, b int, i long").groupBy("a", "b").agg(F.sum("i").alias("i"))
    named = spark.createDataFrame(list(enumerate(terms)), "n int, t string")
    for end in ("a", "b"):
        counts = counts.join(F.broadcast(named.withColumnRenamed("n", end).withColumnRenamed("t", f"t{end}")), end)
    return counts.select(F.col("ta").alias("a"), F.col("tb").alias("b"), "i")


def _light_pairs(lists: DataFrame, names: DataFrame, top: DataFrame) -> DataFrame:
    """(a, b, i), a < b, of pairs of which one term at least is not among the top ones."""
    # Numbers in place of terms: pairs of them are cheaper to group than pairs of strings.
    marked = names.select("term").join(F.broadcast(top.select("term", F.lit(True).alias("heavy"))), "term", "left")
    ids = Table(marked.select("term", F.col("heavy").isNull().alias("light"), F.monotonically_increasing_id().alias("id"))).df
    # Pairs are many times the terms: the lists are dealt out by number, not by their own small size.
    spark = lists.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    cells = lists.withColumn("doc", F.monotonically_increasing_id()).select("doc", F.explode("terms").alias("term")).join(ids, "term")
    dealt = cells.repartition(parts, "doc").groupBy("doc").agg(F.collect_list(F.struct("light", "id")).alias("w"))
    pairs = dealt.select("w", F.explode(F.filter("w", lambda x: x["light"])).alias("x"))
    other = F.explode(F.filter("w", lambda y: ~y["light"] | (y["id"] < F.col("x.id"))))
    shared = pairs.select(F.col("x.id").alias("a"), other.alias("y")).select("a", F.col("y.id").alias("b")).groupBy("a", "b").agg(F.count("*").alias("i"))
    first, second = ids.select(F.col("id").alias("a"), F.col("term").alias("ta")), ids.select(F.col("id").alias("b"), F.col("term").alias("tb"))
    return shared.join(first, "a").join(second, "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"), "i")


def threshold_edges(sets: DataFrame, above: float = 0.2) -> DataFrame:
    """The undirected graph of weights above a bar."""
    return jaccard_weights(sets).filter(F.col("weight") > above)


def entropies(sets: DataFrame, tiny: float = 1e-10) -> DataFrame:
    """(term, entropy) in nats of a term's indicator over documents, `tiny` added to each cell: a closed form of how
    many documents have the term and how many there are."""
    n = sets.agg(F.countDistinct("doc_id").cast("double").alias("d"))  # one row
    f = sets.groupBy("term").agg(F.count("*").cast("double").alias("f")).crossJoin(F.broadcast(n))
    total = F.col("f") * (1 + tiny) + (F.col("d") - F.col("f")) * tiny
    one, none = F.lit(1 + tiny) / F.col("s"), F.lit(tiny) / F.col("s")
    return f.withColumn("s", total).select("term", (-(F.col("f") * one * F.ln(one) + (F.col("d") - F.col("f")) * none * F.ln(none))).alias("entropy"))


def knn_edges(weights: DataFrame, entropy: DataFrame, k: int = 5, least: float = 0.2) -> DataFrame:
    """(src, dst, weight): each term's k nearest by weight, from the term of higher entropy to the lower, ties
    alphabetical; an edge met from both ends is one."""
    order = Window.partitionBy("a").orderBy(F.desc("weight"), "b")
    near = both_ways(weights.filter(F.col("weight") >= least)).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    met = near.join(entropy.select(F.col("term").alias("a"), F.col("entropy").alias("ea")), "a").join(entropy.select(F.col("term").alias("b"), F.col("entropy").alias("eb")), "b")
    first = (F.col("ea") > F.col("eb")) | ((F.col("ea") == F.col("eb")) & (F.col("a") < F.col("b")))
    return met.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("dst"), "weight").distinct()


def node_attributes(edges: DataFrame) -> DataFrame:
    """(node, weighted, n_out, n_in) of a directed graph: sum of weights at either end, edges out and in."""
    ends = edges.select(F.col("src").alias("node"), "weight", F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", "weight", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("weight").alias("weighted"), F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, inverse): neighbours, and all other nodes over them."""
    degree = both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    n = degree.agg(F.count("*").alias("n"))  # one row
    return degree.crossJoin(F.broadcast(n)).select("node", "degree", F.round((F.col("n") - 1) / F.col("degree"), 8).alias("inverse"))


def common_neighbours(edges: DataFrame) -> DataFrame:
    """(a, b, n), a < b, of nodes that share neighbours."""
    sym = both_ways(edges).select("a", "b")
    x, y = sym.alias("x"), sym.alias("y")
    return x.join(y, F.expr("x.a = y.a and x.b < y.b")).groupBy(F.col("x.b").alias("a"), F.col("y.b").alias("b")).agg(F.count("*").alias("n"))


def pagerank(edges: DataFrame, rounds: int = 100, alpha: float = 0.85, tolerance: float | None = 1e-8) -> DataFrame:
    """(node, rank) from uniform; weighted, dangling mass spread evenly. Steps end when the ranks' absolute changes
    add up to less than tolerance times their number, after `rounds` at the latest; tolerance None takes all rounds."""
    ends = edges.select(F.col("src").alias("node"), F.col("weight").alias("w")).union(edges.select("dst", F.lit(0.0)))
    nodes = Table(ends.groupBy("node").agg((F.sum("w") == 0).alias("sink")))
    n = nodes.df.count()
    share = Table(edges.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("src"))).select("src", "dst", "share"))
    ranks = Table(nodes.df.withColumn("p", F.lit(1.0 / max(n, 1))))
    lost = ranks.df.filter("sink").agg(F.sum("p")).first()[0] or 0.0
    for _ in range(rounds):
        got = share.df.join(ranks.df, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("share")).alias("i"))
        p = F.lit((1 - alpha + alpha * lost) / max(n, 1)) + alpha * F.coalesce("i", F.lit(0.0))
        before = ranks.df.select("node", "sink", F.col("p").alias("before"))
        after = Table(before.join(got, "node", "left").select("node", "sink", p.alias("p"), F.abs(p - F.col("before")).alias("moved")))
        lost, moved = after.df.agg(F.sum(F.when(F.col("sink"), F.col("p")).otherwise(0.0)), F.sum("moved")).first()
        lost, moved = lost or 0.0, moved or 0.0
        ranks.drop()
        ranks = after
        if tolerance is not None and moved < tolerance * n:
            break
    return ranks.df.select("node", F.round("p", 8).alias("rank"))


def hits(edges: DataFrame, rounds: int = 100, tolerance: float | None = 1e-8) -> DataFrame:
    """(node, authority, hub): weighted, authorities first, each half step scaled to length 1. Steps end when both
    vectors move by less than the tolerance, after `rounds` at the latest; tolerance None takes all rounds."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    state = Table(nodes.withColumns({"a": F.lit(1.0), "h": F.lit(1.0)}))
    za = zh = 1.0  # lengths of the two columns, by which they are scaled where they are used
    for _ in range(rounds):
        from_hubs = edges.join(state.df, F.col("src") == F.col("node"))
        authority = from_hubs.groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("weight") * F.col("h") / zh).alias("a"))
        from_authorities = edges.join(authority, F.col("dst") == F.col("node"))
        hub = from_authorities.groupBy(F.col("src").alias("node")).agg(F.sum(F.col("weight") * F.col("a")).alias("h"))
        old = state.df.select("node", (F.col("a") / za).alias("old_a"), (F.col("h") / zh).alias("old_h"))
        after = Table(old.join(authority, "node", "left").join(hub, "node", "left").fillna(0.0, ["a", "h"]))
        za, zh = (x or 1.0 for x in after.df.agg(*[F.sqrt(F.sum(F.col(c) * F.col(c))) for c in ("a", "h")]).first())
        state.drop()
        state = after
        if tolerance is not None:
            moved = after.df.agg(*[F.sqrt(F.sum((F.col(c) / z - F.col(f"old_{c}")) ** 2)) for c, z in (("a", za), ("h", zh))]).first()
            if max(x or 0.0 for x in moved) < tolerance:
                break
    return state.df.select("node", F.round(F.col("a") / za, 8).alias("authority"), F.round(F.col("h") / zh, 8).alias("hub"))


def top_nodes(scores: DataFrame, k: int = 10) -> DataFrame:
    """(metric, node, value, rank): the k highest nodes of each metric of a (node, metric...) table, ties by node."""
    metrics = [c for c in scores.columns if c != "node"]
    parts = []
    for c in metrics:
        best = scores.select(F.lit(c).alias("metric"), "node", F.col(c).cast("double").alias("value")).orderBy(F.desc("value"), "node").limit(k)
        parts.append(best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("value"), "node"))))
    return reduce(DataFrame.unionByName, parts)


def degree_and_katz(edges: DataFrame, alpha: float = 0.01, terms: int = 20, labelled: int = 5) -> DataFrame:
    """(node, degree, katz, label): both measures of each node; the nodes of the highest Katz values are labelled
    with their names."""
    degree = both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    frame = Table(degree.join(katz(edges, alpha, terms), "node"))
    top = frame.df.orderBy(F.desc("katz"), "node").limit(labelled).select("node", F.col("node").alias("label"))
    return frame.df.join(F.broadcast(top), "node", "left")


def extreme_terms(entropies: DataFrame, k: int = 10) -> DataFrame:
    """(kind, term, entropy): the k terms of the highest entropy, generic, and of the lowest, specific."""
    generic = entropies.orderBy(F.desc("entropy"), "term").limit(k).withColumn("kind", F.lit("generic"))
    return generic.unionByName(entropies.orderBy("entropy", "term").limit(k).withColumn("kind", F.lit("specific"))).select("kind", "term", "entropy")


def katz(edges: DataFrame, alpha: float = 0.01, terms: int = 20) -> DataFrame:
    """(node, katz): row sums of the first terms of the power series of alpha A; alpha below 1 / lambda_max."""
    sym = both_ways(edges)
    state = Table(sym.select(F.col("a").alias("node")).distinct().withColumns({"x": F.lit(1.0), "total": F.lit(0.0)}))
    for _ in range(terms):
        step = sym.join(state.df, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg((F.sum("x") * alpha).alias("y"))
        after = Table(state.df.join(step, "node").select("node", F.col("y").alias("x"), (F.col("total") + F.col("y")).alias("total")))
        state.drop()
        state = after
    return state.df.select("node", F.round("total", 10).alias("katz"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component), the smallest node reachable: smallest labels with pointer jumping until nothing moves."""
    sym = both_ways(edges).select("a", "b")
    label = Table(sym.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = sym.join(label.df, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        low = label.df.join(near, F.col("node") == F.col("a")).select("node", "component", F.least("component", "m").alias("m"))
        jump = label.df.select(F.col("node").alias("m"), F.col("component").alias("up"))
        after = Table(low.join(jump, "m").select("node", F.least("m", "up").alias("component"), (F.least("m", "up") != F.col("component")).alias("moved")))
        moved = not after.df.filter("moved").isEmpty()
        label.drop()
        label = after
        if not moved:
            return label.df.select("node", "component")


def giant(edges: DataFrame) -> DataFrame:
    """Edges of the largest component, the smallest label winning ties."""
    own = Table(components(edges))
    big = own.df.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    nodes = own.df.join(big, "component", "left_semi").select(F.col("node").alias("a"))
    return Table(edges.join(nodes, "a", "left_semi")).df


def distances(edges: DataFrame) -> DataFrame:
    """(s, v, d, sigma): shortest unweighted distances and numbers of shortest paths, level by level."""
    sym = Table(both_ways(edges).select("a", "b"))
    level = Table(sym.df.select(F.col("a").alias("s")).distinct().select("s", F.col("s").alias("v"), F.lit(0).alias("d"), F.lit(1.0).alias("sigma")))
    seen, d = level.df, 0
    while True:
        d += 1
        step = level.df.join(sym.df, F.col("v") == F.col("a")).groupBy("s", "b").agg(F.sum("sigma").alias("sigma"))
        new = step.withColumnRenamed("b", "v").join(seen.select("s", "v"), ["s", "v"], "left_anti")
        level = Table(new.select("s", "v", F.lit(d).alias("d"), "sigma"))
        if level.df.isEmpty():
            return seen
        seen = seen.union(level.df)


def closeness(dist: DataFrame) -> DataFrame:
    """(n - 1) / sum of distances, 0 for a node alone."""
    return dist.groupBy(F.col("s").alias("node")).agg(F.round(F.coalesce((F.count("*") - 1) / F.nullif(F.sum("d"), F.lit(0)), F.lit(0.0)), 8).alias("closeness"))


def eccentricity(dist: DataFrame) -> DataFrame:
    """Greatest distance and its inverse."""
    return dist.groupBy(F.col("s").alias("node")).agg(F.max("d").alias("far")).select("node", "far", F.round(F.try_divide(F.lit(1.0), F.col("far")), 8).alias("eccentricity"))


def center_periphery(dist: DataFrame) -> DataFrame:
    """Nodes at the radius and at the diameter."""
    far = Table(dist.groupBy(F.col("s").alias("node")).agg(F.max("d").alias("far")))
    ends = far.df.agg(F.min("far").alias("lo"), F.max("far").alias("hi"))
    met = far.df.crossJoin(F.broadcast(ends)).filter("far = lo or far = hi")
    return met.select("node", "far", F.when(F.col("far") == F.col("lo"), "center").otherwise("periphery").alias("kind"))


def betweenness(edges: DataFrame, normalised: bool = True) -> DataFrame:
    """Shares of shortest paths through a node over unordered pairs, over (n-1)(n-2)/2 if normalised.

    One search a source, dealt out over tasks that each hold the thresholded graph: distances and numbers of paths
    outwards, then what each node passes on backwards. Nothing grows with the square of the nodes.
    """
    spark = ship(edges.sparkSession)
    near = _neighbours(edges)
    shared = spark.sparkContext.broadcast(near)  # LOCAL_EDGES at most
    nodes = Table(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct())

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, total = shared.value, {}
        for pdf in batches:
            for source in pdf.node:
                far, paths, order = {source: 0}, {source: 1.0}, [source]
                for u in order:  # grows as it is read: breadth first
                    for v in graph[u]:
                        if v not in far:
                            far[v], paths[v] = far[u] + 1, 0.0
                            order.append(v)
                        if far[v] == far[u] + 1:
                            paths[v] += paths[u]
                passed = dict.fromkeys(order, 0.0)
                for v in reversed(order):
                    for u in graph[v]:
                        if far[u] == far[v] - 1:
                            passed[u] += paths[u] / paths[v] * (1 + passed[v])
                    if v != source:
                        total[v] = total.get(v, 0.0) + passed[v]
        yield pd.DataFrame({"node": list(total), "b": list(total.values())}).astype({"node": object, "b": float})

    summed = nodes.df.mapInPandas(search, "node string, b double").groupBy("node").agg(F.sum("b").alias("b"))
    n = len(near)
    scale = 2.0 * ((n - 1) * (n - 2) / 2 if normalised and n > 2 else 1.0)  # each pair is met from both ends
    return nodes.df.join(summed, "node", "left").select("node", F.round(F.coalesce("b", F.lit(0.0)) / scale, 8).alias("betweenness"))


def _local(edges: DataFrame) -> pd.DataFrame:
    if edges.limit(LOCAL_EDGES + 1).count() > LOCAL_EDGES:
        raise ValueError(f"more than {LOCAL_EDGES} edges: raise the weight threshold")
    return edges.select("a", "b", "weight").orderBy("a", "b").toPandas()


def _neighbours(edges: DataFrame) -> dict[str, list[str]]:
    flat = _local(edges)
    near: dict[str, list[str]] = {}
    for a, b in zip(flat.a, flat.b):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    return near


def residual_closeness(edges: DataFrame, top: int = 10) -> DataFrame:
    """(node, rcc): sum of 2^-d over ordered pairs left when a node goes, for the top nodes by betweenness;
    top=0 takes every node. Dealt out by removed node; a task searches from all sources at once, a set of sources
    being the bits of one number."""
    spark = ship(edges.sparkSession)
    near = _neighbours(edges)
    names = sorted(near)
    place = {v: i for i, v in enumerate(names)}
    shared = spark.sparkContext.broadcast((place, [[place[u] for u in near[v]] for v in names]))  # LOCAL_EDGES at most
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    if top:
        nodes = betweenness(edges).orderBy(F.desc("betweenness"), "node").limit(top).select("node")
    # Few rows of much work each: dealt out one by one.
    nodes = Table(nodes).df.repartition(min(len(names), 4 * spark.sparkContext.defaultParallelism), "node")

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, graph = shared.value
        for pdf in batches:
            out = []
            for gone in map(place.__getitem__, pdf.node):
                front = [0 if v == gone else 1 << v for v in range(len(graph))]
                seen, total, d = list(front), 0.0, 0
                while any(front):
                    d += 1
                    after = []
                    for v, around in enumerate(graph):
                        met = 0
                        if v != gone:
                            for u in around:
                                met |= front[u]
                            met &= ~seen[v]
                            seen[v] |= met
                        after.append(met)
                    total += sum(map(int.bit_count, after)) * 2.0**-d
                    front = after
                out.append(round(total, 6))
            yield pdf.assign(rcc=out)

    return nodes.mapInPandas(remove, "node string, rcc double")


def _louvain(flat: pd.DataFrame) -> dict[str, int]:
    """Local moving and contraction, nodes in name order, until modularity stops rising."""
    names = sorted({*flat.a, *flat.b})
    at = {v: i for i, v in enumerate(names)}
    graph: list[dict[int, float]] = [{} for _ in names]
    for a, b, w in zip(flat.a, flat.b, flat.weight):
        graph[at[a]][at[b]] = graph[at[b]][at[a]] = float(w)
    own = list(range(len(names)))
    while True:
        degree = [sum(g.values()) for g in graph]
        double = sum(degree)
        label, total, moved_any = list(range(len(graph))), degree.copy(), False
        moved = double > 0
        while moved:
            moved = False
            for v, g in enumerate(graph):
                into: dict[int, float] = {}
                for u, w in g.items():
                    if u != v:
                        into[label[u]] = into.get(label[u], 0.0) + w
                total[label[v]] -= degree[v]
                gain = {c: w - total[c] * degree[v] / double for c, w in into.items()}
                here = gain.get(label[v], -total[label[v]] * degree[v] / double)
                best = min((c for c in gain), key=lambda c: (-gain[c], c), default=label[v])
                if best != label[v] and gain[best] > here + 1e-12:
                    label[v], moved, moved_any = best, True, True
                total[label[v]] += degree[v]
        if not moved_any:
            return {v: own[i] for v, i in at.items()}
        dense = {c: k for k, c in enumerate(sorted(set(label)))}
        own = [dense[label[c]] for c in own]
        smaller: list[dict[int, float]] = [{} for _ in dense]
        for v, g in enumerate(graph):
            for u, w in g.items():
                a, b = dense[label[v]], dense[label[u]]
                smaller[a][b] = smaller[a].get(b, 0.0) + w
        graph = smaller


def communities(edges: DataFrame, least: int = 10) -> DataFrame:
    """(node, community): Louvain communities of `least` nodes or more, largest first; -1 for the others."""
    flat = _local(edges)
    label = _louvain(flat)
    groups: dict[int, list[str]] = {}
    for v, c in label.items():
        groups.setdefault(c, []).append(v)
    large = sorted((g for g in groups.values() if len(g) >= least), key=lambda g: (-len(g), min(g)))
    number = {v: k for k, g in enumerate(large) for v in g}
    return edges.sparkSession.createDataFrame([(v, number.get(v, -1)) for v in sorted(label)], "node string, community int")


def leaders(edges: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """Each community's k nodes of the highest degree inside it."""
    of = labels.filter("community >= 0")
    sym = both_ways(edges)
    inner = sym.join(of.withColumnRenamed("node", "a").withColumnRenamed("community", "ca"), "a").join(of.withColumnRenamed("node", "b"), "b").filter("ca = community")
    order = Window.partitionBy("community").orderBy(F.desc("degree"), "node")
    return inner.groupBy("community", F.col("a").alias("node")).agg(F.count("*").alias("degree")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def brokers(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, neighbours, communities): how many neighbours, in how many known communities."""
    met = both_ways(edges).join(labels.withColumnRenamed("node", "b"), "b", "left")
    known = F.when(F.col("community") >= 0, F.col("community"))
    return met.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("neighbours"), F.countDistinct(known).alias("communities"))


def to_gexf(edges: DataFrame, directed: bool = False) -> str:
    """The graph as GEXF 1.2draft, of LOCAL_EDGES edges at most."""
    flat = _local(edges)
    root = ET.Element("gexf", version="1.2", xmlns="http://www.gexf.net/1.2draft")
    graph = ET.SubElement(root, "graph", defaultedgetype="directed" if directed else "undirected", mode="static")
    nodes, links = ET.SubElement(graph, "nodes"), ET.SubElement(graph, "edges")
    for v in sorted({*flat.a, *flat.b}):
        ET.SubElement(nodes, "node", id=v, label=v)
    for k, (a, b, w) in enumerate(zip(flat.a, flat.b, flat.weight)):
        ET.SubElement(links, "edge", id=str(k), source=a, target=b, weight=repr(float(w)))
    return ET.tostring(root, encoding="unicode", xml_declaration=True)


def read_gexf(spark, text: str) -> tuple[DataFrame, DataFrame]:
    """O4 back: (nodes with their attributes as a map, edges)."""
    root = ET.fromstring(text)
    ns = {"g": root.tag[1:].partition("}")[0]}
    titles = {a.get("id"): a.get("title") for c in root.iterfind(".//g:attributes", ns) if c.get("class") == "node" for a in c}
    nodes = [(n.get("id"), {titles.get(v.get("for"), v.get("for")): v.get("value") for v in n.iterfind(".//g:attvalue", ns)}) for n in root.iterfind(".//g:node", ns)]
    edges = [(e.get("source"), e.get("target"), float(e.get("weight", "1"))) for e in root.iterfind(".//g:edge", ns)]
    return spark.createDataFrame(nodes, "node string, attributes map<string,string>"), spark.createDataFrame(edges, "a string, b string, weight double")


def gexf_rows(edges: DataFrame) -> DataFrame:
    """A round trip: the edges as read back from their GEXF text."""
    return read_gexf(edges.sparkSession, to_gexf(edges))[1]
