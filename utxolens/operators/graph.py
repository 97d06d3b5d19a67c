"""Jobs over property graphs of many cases at once: edges(case_id, src, dst, value_sats, edge_idx), nodes by (case_id, node).

Edges without value carry nothing. Every loop works on all cases in each round and stops when none changes.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utxolens.functions import ledger as L
from utxolens.operators.iterate import components, dropped, settled


def flows(edges: DataFrame) -> DataFrame:
    """(case_id, node, inflow, outflow, in_degree, out_degree) of every end of an edge with value."""
    live = edges.filter("value_sats > 0")
    ends = live.select("case_id", F.col("dst").alias("node"), F.col("value_sats").alias("i"), F.lit(0).cast("long").alias("o"), F.lit(1).alias("ni"), F.lit(0).alias("no"))
    ends = ends.unionByName(live.select("case_id", F.col("src").alias("node"), F.lit(0).cast("long").alias("i"), F.col("value_sats").alias("o"), F.lit(0).alias("ni"), F.lit(1).alias("no")))
    return ends.groupBy("case_id", "node").agg(F.sum("i").alias("inflow"), F.sum("o").alias("outflow"), F.sum("ni").alias("in_degree"), F.sum("no").alias("out_degree"))


def centrality(edges: DataFrame, hub_degree: int = 4) -> DataFrame:
    """Degrees, volumes and, in millionths, the share of twice the case's value that passes each node."""
    total = Window.partitionBy("case_id")
    own = flows(edges).withColumn("through", F.col("inflow") + F.col("outflow"))
    share = F.round(F.col("through") / F.sum("through").over(total) * 1e6).cast("long")
    return own.select("case_id", "node", "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree")).alias("degree"), "inflow", "outflow", share.alias("share_ppm"), (F.col("in_degree") + F.col("out_degree") >= hub_degree).alias("is_hub"))


def reached_links(edges: DataFrame, seeds: DataFrame, hops: int = 4, max_rounds: int = 1000) -> DataFrame:
    """(case_id, src, dst, value_sats, edge_idx) of the edges with value out of the seeds (case_id, node) and all nodes that value from them reaches.

    A round goes `hops` hops over one shuffle of the edges. A node without further edge comes out as a row without dst, so that it
    isn't tried again.
    """
    more = ["value_sats", *[c for c in ("edge_idx",) if c in edges.columns]]
    live = edges.filter("value_sats > 0").select("case_id", "src", "dst", *more)
    frontier, parts = settled(seeds.select("case_id", "node").distinct()), []
    for _ in range(max_rounds):
        levels = [frontier.select("case_id", F.col("node").alias("src"))]
        for _ in range(hops - 1):
            levels.append(levels[-1].join(live, ["case_id", "src"]).select("case_id", F.col("dst").alias("src")).distinct())
        nodes = reduce(DataFrame.unionByName, levels).distinct()
        done = [p.select("case_id", "src") for p in parts]
        if done:
            nodes = nodes.join(reduce(DataFrame.unionByName, done), ["case_id", "src"], "left_anti")
        parts.append(settled(nodes.join(live, ["case_id", "src"], "left")))
        done.append(parts[-1].select("case_id", "src"))
        frontier = parts[-1].filter("dst is not null").select("case_id", F.col("dst").alias("src")).distinct().join(reduce(DataFrame.unionByName, done), ["case_id", "src"], "left_anti")
        frontier = settled(frontier.withColumnRenamed("src", "node"))
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, parts).filter("dst is not null")
    raise RuntimeError("reachability did not settle")


def taint_poison(edges: DataFrame, seeds: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(case_id, node) that value from a seed (case_id, node) can reach; seeds included, nothing passes through other seeds' guilt. links: their reached_links()."""
    links = reached_links(edges, seeds) if links is None else links
    return seeds.select("case_id", "node").unionByName(links.select("case_id", F.col("dst").alias("node"))).distinct()


def weighed(links: DataFrame, seeds: DataFrame, flow: DataFrame) -> DataFrame:
    """reached_links() into other nodes than seeds, with what taint() needs: ahead (sats of the sender's edges before it), src_seed, the flows() of both ends."""
    before = Window.partitionBy("case_id", "src").orderBy("edge_idx").rowsBetween(Window.unboundedPreceding, -1)
    marked = seeds.select("case_id", F.col("node").alias("src"), F.lit(True).alias("src_seed")).distinct()
    sends = flow.select("case_id", F.col("node").alias("src"), F.col("outflow").alias("src_outflow"), F.col("inflow").alias("src_inflow"))
    own = links.withColumn("ahead", F.coalesce(F.sum("value_sats").over(before), F.lit(0))) if "edge_idx" in links.columns else links
    own = own.drop("edge_idx").join(sends, ["case_id", "src"]).join(marked, ["case_id", "src"], "left")
    own = own.join(flow.select("case_id", F.col("node").alias("dst"), F.col("inflow").alias("dst_inflow")), ["case_id", "dst"])
    return own.join(marked.select("case_id", F.col("src").alias("dst")), ["case_id", "dst"], "left_anti")


def fifo_shares(edges: DataFrame, taint: DataFrame, seeds: DataFrame) -> DataFrame:
    """Adds given: the tainted sats of each edge, as the sender's tainted holdings fill its edges in the order of edge_idx."""
    live = edges.filter("value_sats > 0")
    held = flows(edges).join(taint, ["case_id", "node"], "left").join(seeds.select("case_id", "node", F.lit(True).alias("seed")), ["case_id", "node"], "left")
    holding = F.when(F.col("seed"), F.col("outflow")).otherwise(F.least("outflow", F.floor(F.col("inflow") * F.coalesce("taint", F.lit(0.0)) + 0.5)))
    held = held.select("case_id", F.col("node").alias("src"), holding.cast("long").alias("held"))
    before = Window.partitionBy("case_id", "src").orderBy("edge_idx").rowsBetween(Window.unboundedPreceding, -1)
    filled = live.withColumn("ahead", F.coalesce(F.sum("value_sats").over(before), F.lit(0)))
    filled = filled.join(held, ["case_id", "src"])
    return filled.withColumn("given", F.greatest(F.lit(0), F.least("value_sats", F.col("held") - F.col("ahead"))).cast("long")).drop("ahead", "held")


def taint(edges: DataFrame, seeds: DataFrame, model: str = "haircut", max_rounds: int = 200, digits: int = 12, least_change: float = 1e-9, watch: list | None = None, links: DataFrame | None = None) -> DataFrame:
    """(case_id, node, taint) of nodes with taint, under model haircut or fifo. Seeds stay at 1; no seeds, no taint.

    Semi-naive: in each round only nodes that receive from a node whose taint has just risen (by more than least_change) are computed
    again, from all their edges; the first round's are those behind the seeds. Taints only grow from zero, so this reaches the least fixpoint, on an
    acyclic graph in as many rounds as its longest path, and the state is the highest taint of a node in a log that rounds
    append to. watch, where given, gets the number of nodes computed in each round. Only edges that value from a seed can pass take part;
    links, where given, are these, weighed() and settled.
    """
    seeds = settled(seeds.select("case_id", "node").distinct())
    given = links is not None
    links = links if given else settled(weighed(reached_links(edges, seeds), seeds, flows(edges)))
    if model == "fifo":
        held = F.when(F.col("src_seed"), F.col("src_outflow")).otherwise(F.least("src_outflow", F.floor(F.col("src_inflow") * F.col("taint") + 0.5)))
        gives = F.greatest(F.lit(0), F.least("value_sats", held - F.col("ahead"))).cast("double")
    else:
        gives = F.col("taint") * F.col("value_sats")
    moved = settled(seeds.withColumn("taint", F.lit(1.0)))
    log = [moved]
    for _ in range(max_rounds):
        touched = moved.select("case_id", F.col("node").alias("src")).join(links, ["case_id", "src"]).select("case_id", "dst").distinct()
        if watch is not None:
            watch.append(touched.count())
        state = reduce(DataFrame.unionByName, log).groupBy("case_id", "node").agg(F.max("taint").alias("taint"))
        came = links.join(touched, ["case_id", "dst"], "left_semi").join(state.withColumnRenamed("node", "src"), ["case_id", "src"])
        came = came.groupBy("case_id", F.col("dst").alias("node")).agg(F.sum(gives).alias("came"), F.first("dst_inflow").alias("inflow")).filter("came > 0")
        now = came.select("case_id", "node", F.round(F.least(F.lit(1.0), F.col("came") / F.col("inflow")), digits).alias("taint"))
        known = state.select("case_id", "node", F.col("taint").alias("known"))
        moved = settled(now.join(known, ["case_id", "node"], "left").filter(F.col("known").isNull() | (F.col("taint") - F.col("known") > least_change)).drop("known"))
        if moved.isEmpty():
            state = settled(state)
            if not given:
                dropped(links)
            return state
        log.append(moved)
        if len(log) == 8:
            log = [settled(reduce(DataFrame.unionByName, log).groupBy("case_id", "node").agg(F.max("taint").alias("taint")))]
    raise RuntimeError(f"taint did not settle in {max_rounds} rounds")


def edge_taint(edges: DataFrame, taint_: DataFrame, *more: Column) -> DataFrame:
    """Per (case_id, src, dst): total and tainted sats (the sender's taint), share in millionths and tier, and more figures of their edges."""
    own = edges.filter("value_sats > 0").join(taint_.withColumnRenamed("node", "src"), ["case_id", "src"], "left")
    own = own.groupBy("case_id", "src", "dst").agg(F.sum("value_sats").alias("total_sats"), F.sum(F.round(F.col("value_sats") * F.coalesce("taint", F.lit(0.0))).cast("long")).alias("tainted_sats"), *more)
    share = F.col("tainted_sats") / F.col("total_sats")
    return own.withColumn("taint_ppm", F.round(share * 1e6).cast("long")).withColumn("tier", L.tier(share))


def taint_ledger(edges: DataFrame, taint_: DataFrame) -> DataFrame:
    """Per node: balance, tainted and clean sats of it, tainted inflow, tier."""
    own = flows(edges).join(taint_, ["case_id", "node"], "left").withColumn("taint", F.coalesce("taint", F.lit(0.0)))
    own = own.withColumn("balance_sats", F.greatest(F.lit(0), F.col("inflow") - F.col("outflow")))
    own = own.withColumn("tainted_sats", F.least("balance_sats", F.round(F.col("balance_sats") * F.col("taint")).cast("long")))
    return own.select("case_id", "node", "inflow", "outflow", "balance_sats", "tainted_sats", (F.col("balance_sats") - F.col("tainted_sats")).alias("clean_sats"), F.round(F.col("inflow") * F.col("taint")).cast("long").alias("tainted_inflow"), F.round(F.col("taint") * 1e6).cast("long").alias("taint_ppm"), L.tier(F.col("taint")).alias("tier"))


def compare_models(flow: DataFrame, haircut: DataFrame, fifo: DataFrame, poison: DataFrame) -> DataFrame:
    """Taint of each node of flows() under three models in millionths, their spread, and whether the node is terminal."""
    own = flow.select("case_id", "node", (F.col("out_degree") == 0).alias("terminal"))
    for name, df in (("haircut", haircut), ("fifo", fifo), ("poison", poison.withColumn("taint", F.lit(1.0)))):
        own = own.join(df.select("case_id", "node", F.round(F.col("taint") * 1e6).cast("long").alias(name)), ["case_id", "node"], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return own.withColumn("spread", F.greatest("haircut", "fifo", "poison") - F.least("haircut", "fifo", "poison"))


def concordance(compared: DataFrame) -> DataFrame:
    """Per case: terminal nodes tainted over one percent in any model, in all models, and the ratio in millionths."""
    hits = sum((F.col(m) > 10_000).cast("int") for m in ("haircut", "fifo", "poison"))
    own = compared.filter("terminal").withColumn("hits", hits).groupBy("case_id").agg(F.count_if(F.col("hits") > 0).alias("any_model"), F.count_if(F.col("hits") == 3).alias("all_models"))
    return own.withColumn("concordance_ppm", F.when(F.col("any_model") > 0, F.round(F.col("all_models") / F.col("any_model") * 1e6).cast("long")))


def audit_taint(edges: DataFrame, taint_: DataFrame, seeds: DataFrame) -> DataFrame:
    """Per case, violations: taint out of bounds, seeds not at 1, taint without inflow, more given than received (FIFO, one sat)."""
    own = flows(edges).join(taint_, ["case_id", "node"], "full").join(seeds.select("case_id", "node", F.lit(True).alias("seed")), ["case_id", "node"], "full")
    given = fifo_shares(edges, taint_, seeds).groupBy("case_id", F.col("src").alias("node")).agg(F.sum("given").alias("given"))
    own = own.join(given, ["case_id", "node"], "left")
    t, seed = F.coalesce("taint", F.lit(0.0)), F.coalesce("seed", F.lit(False))
    return own.groupBy("case_id").agg(
        F.count_if((t < 0) | (t > 1)).alias("out_of_bounds"), F.count_if(seed & (t != 1)).alias("unpinned"), F.count_if(~seed & (t > 0) & (F.coalesce("inflow", F.lit(0)) == 0)).alias("without_inflow"),
        F.count_if(~seed & (F.coalesce("given", F.lit(0)) > F.round(F.coalesce("inflow", F.lit(0)) * t) + 1)).alias("minted"),
    )


def _contracted(nodes: DataFrame, open_: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Runs of nodes with one way in and one way out, taken out by pointer jumping: (nodes, edges, records of what left, jumps).

    Such a node's rank is max(best, rank of a node before it + d). Maps of this form compose, so every jump doubles the stretch that a
    pointer spans. A record (case_id, node, head, best, d) points at the node in front of the run. Runs that close on themselves
    have no head: their nodes leave without a record, as nothing can free them.
    """
    ends = open_.groupBy("case_id", F.col("dst").alias("node")).agg(F.count("*").alias("ins"), F.first("src").alias("head"), F.first("w").alias("d")).filter("ins = 1")
    outs = open_.groupBy("case_id", F.col("src").alias("node")).agg(F.count("*").alias("outs")).filter("outs = 1")
    inner = settled(nodes.join(ends, ["case_id", "node"]).join(outs, ["case_id", "node"]).select("case_id", "node", "head", "best", "d"))
    still = inner.select("case_id", F.col("node").alias("head"))
    # a pointer is open while it ends at another node of a run
    done, open_pointers = inner.join(still, ["case_id", "head"], "left_anti").select(*inner.columns), inner.join(still, ["case_id", "head"], "left_semi").select(*inner.columns)
    parts, left, jumps = [settled(done)], settled(open_pointers), 0
    count = left.count()
    limit = count.bit_length() + 1
    while count and jumps < limit:
        before = parts[0]
        for p in parts[1:]:
            before = before.unionByName(p)
        at = before.withColumn("last", F.lit(True)).unionByName(left.withColumn("last", F.lit(False)))
        at = at.select("case_id", F.col("node").alias("head"), F.col("head").alias("head2"), F.col("best").alias("best2"), F.col("d").alias("d2"), "last")
        jumped = left.join(at, ["case_id", "head"]).select("case_id", "node", F.col("head2").alias("head"), F.greatest("best", F.col("best2") + F.col("d")).alias("best"), (F.col("d") + F.col("d2")).alias("d"), "last")
        jumped, jumps = settled(jumped), jumps + 1
        parts.append(jumped.filter("last").drop("last"))
        left = jumped.filter("not last").drop("last")
        count = left.count()
    gone = parts[0]
    for p in parts[1:]:
        gone = gone.unionByName(p)
    gone = settled(gone)
    # edges into runs go; edges out of runs start at the head, and carry the run's own floor to the node behind it
    own = open_.join(inner.select("case_id", F.col("node").alias("dst")), ["case_id", "dst"], "left_anti")
    out = own.join(gone.select("case_id", F.col("node").alias("src"), "head", "best", "d"), ["case_id", "src"])
    floors = out.groupBy("case_id", F.col("dst").alias("node")).agg(F.max(F.col("best") + F.col("w")).alias("floor"))
    kept = own.join(inner.select("case_id", F.col("node").alias("src")), ["case_id", "src"], "left_anti").select("case_id", "src", "dst", "w")
    moved = out.select("case_id", F.col("head").alias("src"), "dst", (F.col("d") + F.col("w")).alias("w"))
    edges = kept.unionByName(moved).groupBy("case_id", "src", "dst").agg(F.max("w").alias("w"))
    rest = nodes.join(inner, ["case_id", "node"], "left_anti").join(floors, ["case_id", "node"], "left")
    return settled(rest.select("case_id", "node", F.greatest("best", "floor").alias("best"))), settled(edges), gone, jumps


def ranks(edges: DataFrame, max_rounds: int | None = None, patience: int = 8) -> DataFrame:
    """(case_id, node, rank, cyclic): longest distance from a source; nodes on or behind cycles come one after the last rank.

    Kahn's rounds: nodes without open predecessors leave, and raise what their successors have at best. After every `patience`
    rounds runs of one-in-one-out nodes are contracted by pointer jumping, so long chains, and what becomes one when parallel
    edges merge, take a logarithm of their length. Rounds have no limit (each takes a level away) unless max_rounds gives one; it counts jumps
    too, and passing it is an error. Edges with a null end take no part; repeated edges count once; no edges, no rows.
    """
    open_ = settled(edges.select("case_id", "src", "dst").dropna().distinct().withColumn("w", F.lit(1).cast("long")))
    all_ = settled(open_.select("case_id", F.col("src").alias("node")).unionByName(open_.select("case_id", F.col("dst").alias("node"))).distinct())
    nodes, parts, records, rounds, extra = all_.withColumn("best", F.lit(0).cast("long")), [all_.limit(0).withColumn("rank", F.lit(0).cast("long"))], [], 0, 0
    while True:
        if max_rounds is not None and rounds + extra > max_rounds:
            raise RuntimeError(f"graphs take more than {max_rounds} rounds")
        free = settled(nodes.join(open_.select("case_id", F.col("dst").alias("node")).distinct(), ["case_id", "node"], "left_anti").select("case_id", "node", F.col("best").alias("rank")))
        if free.isEmpty():
            break
        rounds += 1
        parts.append(free)
        if len(parts) > 32:
            parts = [settled(reduce(DataFrame.unionByName, parts))]
        gone = free.select("case_id", F.col("node").alias("src"), "rank")
        raised = open_.join(gone, ["case_id", "src"]).groupBy("case_id", F.col("dst").alias("node")).agg(F.max(F.col("rank") + F.col("w")).alias("floor"))
        nodes = settled(nodes.join(free, ["case_id", "node"], "left_anti").join(raised, ["case_id", "node"], "left").select("case_id", "node", F.greatest("best", "floor").alias("best")))
        open_ = settled(open_.join(gone, ["case_id", "src"], "left_anti"))
        if rounds % patience == 0 and not open_.isEmpty():
            nodes, open_, record, jumps = _contracted(nodes, open_)
            records.append(record)
            extra += jumps
    done = reduce(DataFrame.unionByName, parts)
    for record in reversed(records):
        done = settled(done)
        ahead = done.select("case_id", F.col("node").alias("head"), F.col("rank").alias("before"))
        found = record.join(ahead, ["case_id", "head"]).select("case_id", "node", F.greatest("best", F.col("before") + F.col("d")).alias("rank"))
        done = done.unionByName(found)
    done = settled(done)
    last = done.groupBy("case_id").agg(F.max("rank").alias("last"))
    left = all_.join(done, ["case_id", "node"], "left_anti").join(last, "case_id", "left")
    left = left.select("case_id", "node", (F.coalesce("last", F.lit(-1)) + 1).alias("rank"), F.lit(True).alias("cyclic"))
    return done.withColumn("cyclic", F.lit(False)).unionByName(left)


def strong_components(edges: DataFrame) -> DataFrame:
    """(case_id, node, component) of nodes on cycles; a component of nodes that all reach each other is named by its greatest node.

    Ends that lie on no cycle are trimmed. Then the greatest node that reaches a node is its colour; of a colour the nodes that
    reach back to the node it is named by are a component. Components leave, until no edge is left. Rounds have no limit: each takes something away.
    """
    left = settled(edges.select("case_id", "src", "dst").filter("src != dst").distinct())
    found = left.select("case_id", F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    while True:
        edges_before = left.count()
        left = left.join(left.select("case_id", F.col("dst").alias("src")).distinct(), ["case_id", "src"], "left_semi")
        left = settled(left.join(left.select("case_id", F.col("src").alias("dst")).distinct(), ["case_id", "dst"], "left_semi"))
        if left.count() < edges_before:
            continue
        if left.isEmpty():
            return found
        colour = settled(left.select("case_id", F.col("src").alias("node"), F.col("src").alias("colour")).distinct())
        moved = colour
        while not moved.isEmpty():
            came = moved.withColumnRenamed("node", "src").join(left, ["case_id", "src"]).groupBy("case_id", F.col("dst").alias("node")).agg(F.max("colour").alias("came"))
            moved = settled(came.join(colour, ["case_id", "node"]).filter("came > colour").select("case_id", "node", F.col("came").alias("colour")))
            colour = settled(colour.join(moved.select("case_id", "node"), ["case_id", "node"], "left_anti").unionByName(moved))
        inside = left.join(colour.select("case_id", F.col("node").alias("src"), "colour"), ["case_id", "src"]).join(colour.select("case_id", F.col("node").alias("dst"), "colour"), ["case_id", "dst", "colour"])
        back = near = settled(colour.filter("node = colour"))
        while not near.isEmpty():
            step = near.withColumnRenamed("node", "dst").join(inside, ["case_id", "dst", "colour"]).select("case_id", F.col("src").alias("node"), "colour").distinct()
            near = settled(step.join(back, ["case_id", "node"], "left_anti"))
            back = settled(back.unionByName(near))
        several = back.groupBy("case_id", "colour").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
        found = settled(found.unionByName(back.join(several, ["case_id", "colour"]).select("case_id", "node", F.col("colour").alias("component"))))
        for end in ("src", "dst"):
            left = left.join(back.select("case_id", F.col("node").alias(end)), ["case_id", end], "left_anti")
        left = settled(left)


def best_inside(links: dict, entry: str, steps: int) -> tuple[dict, bool]:
    """The simple path of highest value from entry to each node of links (node -> {next: value}), and whether the search was whole.

    Depth first, most valuable edge first. A branch goes on only while its value, with the most that the nodes not on it can
    bring in, beats what is known for some of them. After `steps` edges it stops, and says so.
    """
    brings: dict = {}
    for own in links.values():
        for to, value in own.items():
            brings[to] = max(brings.get(to, 0), value)
    order = {node: sorted(own, key=lambda to, own=own: (-own[to], to)) for node, own in links.items()}
    best, path, on = {entry: (0, [entry])}, [entry], {entry}
    rest = sum(v for node, v in brings.items() if node != entry)
    stack, total, taken = [(iter(order.get(entry, [])), 0, 0)], 0, 0
    while stack:
        to = next((n for n in stack[-1][0] if n not in on), None)
        if to is None:
            _, value, brought = stack.pop()
            if stack:
                on.discard(path.pop())
                total, rest = total - value, rest + brought
            continue
        taken += 1
        if taken > steps:
            return best, False
        value = links[path[-1]][to]
        on.add(to)
        path.append(to)
        total, rest = total + value, rest - brings[to]
        stack.append((iter(order.get(to, [])), value, brings[to]))
        if to not in best or total > best[to][0]:
            best[to] = total, list(path)
        if len(best) == len(brings | {entry: 0}) and total + rest <= min((best[n][0] for n in brings if n not in on), default=total + rest):
            stack[-1] = (iter(()), value, brings[to])
    return best, True


def _trails_inside(steps: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        links: dict = {}
        for src, dst, v in pdf[pdf["dst"].notna()][["src", "dst", "v"]].itertuples(index=False):
            links.setdefault(src, {})[dst] = v
        rows = []
        for entry in pdf[pdf["dst"].isna()]["src"]:
            best, whole = best_inside(links, entry, steps)
            rows += [(pdf["case_id"].iloc[0], entry, to, v, ">".join(path), whole) for to, (v, path) in best.items()]
        return pd.DataFrame(rows, columns=["case_id", "entry", "to", "v", "way", "exact"])

    return run


def reached_from(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(case_id, node): starts and all nodes behind them."""
    links = settled(edges.select("case_id", "src", "dst").distinct())
    frontier = reached = settled(starts.select("case_id", "node").distinct())
    while not frontier.isEmpty():
        step = frontier.withColumnRenamed("node", "src").join(links, ["case_id", "src"]).select("case_id", F.col("dst").alias("node")).distinct()
        frontier = settled(step.join(reached, ["case_id", "node"], "left_anti"))
        reached = settled(reached.unionByName(frontier))
    return reached


def trail_ends(edges: DataFrame) -> DataFrame:
    """(case_id, start, end): the source with the highest outflow and the sink with the highest inflow; ties to the first in text order.

    A case without sources or sinks takes the node with the highest outflow or inflow.
    """
    own = flows(edges)
    start = F.max_by("node", F.struct((F.col("in_degree") == 0).alias("a"), F.col("outflow").alias("b"), F.col("after").alias("c")))
    end = F.max_by("node", F.struct((F.col("out_degree") == 0).alias("a"), F.col("inflow").alias("b"), F.col("after").alias("c")))
    after = Window.partitionBy("case_id", "inflow", "outflow", "in_degree", "out_degree").orderBy(F.desc("node"))
    return own.withColumn("after", F.row_number().over(after)).groupBy("case_id").agg(start.alias("start"), end.alias("end"))


def money_trail(edges: DataFrame, starts: DataFrame, ends: DataFrame | None = None, steps: int = 200_000) -> DataFrame:
    """(case_id, path, total_sats, exact): per case the simple path from a start (case_id, node) with the highest total value.

    Of edges between two nodes the sum counts. With ends(case_id, node) it goes to one of them, where one can be reached; else anywhere. Of equal totals
    the greater end, and of equal ways to a node the greater last step wins. Cases of starts without an outgoing edge have no row.

    A simple path passes each strong component once, so nodes get their best totals in the order of the condensed graph, from one best
    total and last step per node; only nodes that improved go on to the next round, and there is no limit of hops. Inside a
    component the best simple paths are searched with a bound on what is left (the problem is NP-hard there); a component
    that takes more than `steps` steps an entry ends with the best found, and the case's exact is false.
    """
    live = edges.filter("value_sats > 0 and src != dst").groupBy("case_id", "src", "dst").agg(F.sum("value_sats").alias("v"))
    near = reached_from(live, starts)
    live = settled(live.join(near.withColumnRenamed("node", "src"), ["case_id", "src"], "left_semi"))
    component = strong_components(live)
    of = lambda end: component.select("case_id", F.col("node").alias(end), F.col("component").alias(f"{end}_of"))
    live = settled(live.join(of("src"), ["case_id", "src"], "left").join(of("dst"), ["case_id", "dst"], "left").withColumn("inner", F.coalesce(F.col("src_of") == F.col("dst_of"), F.lit(False))))
    begin = starts.select("case_id", "node").distinct()
    cross = live.filter("not inner").select("case_id", "src", "dst", "v")
    entries = cross.select("case_id", F.col("dst").alias("node")).unionByName(begin).distinct().join(component, ["case_id", "node"])
    inner = live.filter("inner").select("case_id", F.col("src_of").alias("component"), "src", "dst", "v")
    inner = inner.unionByName(entries.select("case_id", "component", F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(0).cast("long").alias("v")))
    ways = settled(inner.groupBy("case_id", "component").applyInPandas(_trails_inside(steps), "case_id string, entry string, to string, v long, way string, exact boolean"))
    onward = cross.join(ways.select("case_id", F.col("entry").alias("dst"), "to", F.col("v").alias("w"), "way"), ["case_id", "dst"], "left")
    onward = settled(onward.select("case_id", "src", F.coalesce("to", "dst").alias("node"), (F.col("v") + F.coalesce("w", F.lit(0))).alias("v"), F.coalesce("way", "dst").alias("way")))
    first = begin.join(ways.select("case_id", F.col("entry").alias("node"), "to", "v", "way"), ["case_id", "node"], "left")
    first = first.select("case_id", F.coalesce("to", "node").alias("node"), F.coalesce("v", F.lit(0)).cast("long").alias("total"), F.lit(None).cast("string").alias("before"), F.coalesce("way", "node").alias("way"))
    choice = F.max(F.struct("total", "before", "way")).alias("b")
    best = moved = settled(first.groupBy("case_id", "node").agg(choice).select("case_id", "node", "b.*"))
    while not moved.isEmpty():
        came = moved.select("case_id", F.col("node").alias("src"), "total").join(onward, ["case_id", "src"]).select("case_id", "node", (F.col("total") + F.col("v")).alias("total"), F.col("src").alias("before"), "way")
        came = came.groupBy("case_id", "node").agg(choice).select("case_id", "node", "b.*")
        known = best.select("case_id", "node", F.col("total").alias("t"), F.col("before").alias("p"))
        better = (F.col("t").isNull()) | (F.col("total") > F.col("t")) | ((F.col("total") == F.col("t")) & (F.col("before") > F.col("p")))
        moved = settled(came.join(known, ["case_id", "node"], "left").filter(better).drop("t", "p"))
        best = settled(best.join(moved.select("case_id", "node"), ["case_id", "node"], "left_anti").unionByName(moved))
    last = best.filter("total > 0")
    if ends is not None:
        wanted = last.join(ends.select("case_id", "node").distinct(), ["case_id", "node"], "left_semi")
        last = wanted.unionByName(last.join(wanted.select("case_id").distinct(), "case_id", "left_anti"))
    last = last.groupBy("case_id").agg(F.max(F.struct("total", "node", "before", "way")).alias("b"))
    done = None
    open_ = settled(last.select("case_id", F.col("b.total").alias("total_sats"), F.col("b.before").alias("before"), F.col("b.way").alias("path")))
    while not open_.isEmpty():
        ended = open_.filter("before is null").select("case_id", "path", "total_sats")
        done = ended if done is None else done.unionByName(ended)
        step = best.select("case_id", F.col("node").alias("at"), F.col("before").alias("further"), "way")
        open_ = settled(open_.join(step, (open_["case_id"] == step["case_id"]) & (F.col("before") == F.col("at"))).select(open_["case_id"], "total_sats", F.col("further").alias("before"), F.concat_ws(">", "way", "path").alias("path")))
    cut = ways.filter("not exact").select("case_id").distinct().withColumn("cut", F.lit(True))
    done = open_.select("case_id", "path", "total_sats") if done is None else done
    return done.join(cut, "case_id", "left").select("case_id", "path", "total_sats", F.col("cut").isNull().alias("exact"))


def cycles(edges: DataFrame, max_hops: int = 3) -> DataFrame:
    """(case_id, path, hops, least_sats): every simple cycle of up to max_hops edges, written from its smallest node."""
    live = settled(edges.filter("value_sats > 0 and src != dst").groupBy("case_id", "src", "dst").agg(F.sum("value_sats").alias("v")))
    now = live.filter("src < dst").select("case_id", F.array("src", "dst").alias("path"), F.col("dst").alias("at"), F.col("v").alias("least"))
    found = None
    for _ in range(max_hops - 1):
        grown = now.join(live.withColumnRenamed("src", "at"), ["case_id", "at"]).filter(F.col("dst") >= F.element_at("path", 1))
        grown = grown.withColumn("least", F.least("least", "v"))
        closed = grown.filter(F.col("dst") == F.element_at("path", 1)).select("case_id", F.array_join("path", ">").alias("path"), F.size("path").cast("long").alias("hops"), F.col("least").alias("least_sats"))
        found = closed if found is None else found.unionByName(closed)
        now = settled(grown.filter(~F.array_contains("path", F.col("dst"))).select("case_id", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"), "least"))
    return found


def routes(edges: DataFrame, starts: DataFrame, max_hops: int = 10, most: int = 30) -> DataFrame:
    """Per case up to `most` simple routes from a start to a node without outflow, by bottleneck, then path."""
    live = settled(edges.filter("value_sats > 0").groupBy("case_id", "src", "dst").agg(F.sum("value_sats").alias("v")))
    ends = flows(edges).filter("out_degree = 0").select("case_id", F.col("node").alias("at"))
    now = starts.select("case_id", F.col("node").alias("at"), F.array("node").alias("path"), F.lit(None).cast("long").alias("bottleneck"))
    found = None
    for _ in range(max_hops):
        grown = now.join(live.withColumnRenamed("src", "at"), ["case_id", "at"]).filter(~F.array_contains("path", F.col("dst")))
        now = settled(grown.select("case_id", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"), F.least("bottleneck", "v").alias("bottleneck")))
        if now.isEmpty():
            break
        own = now.join(ends, ["case_id", "at"], "left_semi")
        found = own if found is None else found.unionByName(own)
    found = now.filter(F.lit(False)) if found is None else found
    best = Window.partitionBy("case_id").orderBy(F.desc("bottleneck"), "path")
    found = found.select("case_id", F.array_join("path", ">").alias("path"), F.size("path").cast("long").alias("nodes"), "bottleneck")
    return found.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= most)


def collapse(edges: DataFrame, least: int = 3) -> DataFrame:
    """Edges with the sources of each hub that have no other edge put together, where there are `least` of them or more."""
    ends = edges.select("case_id", F.col("src").alias("node")).unionByName(edges.select("case_id", F.col("dst").alias("node")))
    single = ends.groupBy("case_id", "node").agg(F.count("*").alias("n")).filter("n = 1").select("case_id", F.col("node").alias("src"))
    leaf = edges.join(single, ["case_id", "src"], "left_semi")
    groups = leaf.groupBy("case_id", "dst").agg(F.count("*").alias("members"), F.sum("value_sats").alias("value_sats")).filter(F.col("members") >= least)
    hidden = leaf.join(groups.select("case_id", "dst"), ["case_id", "dst"], "left_semi").select("case_id", "src", "dst")
    rest = edges.join(hidden, ["case_id", "src", "dst"], "left_anti").select("case_id", "src", "dst", "value_sats", F.lit(1).cast("long").alias("members"))
    return rest.unionByName(groups.select("case_id", F.concat(F.lit("cluster:"), "dst").alias("src"), "dst", "value_sats", "members"))


def clusters(txi: DataFrame, mixes: DataFrame) -> DataFrame:
    """(address, cluster): addresses joined by common spending, mixes left out; the smallest address names the cluster.

    Each transaction links its addresses to its smallest one.
    """
    own = settled(txi.join(mixes.select("txid"), "txid", "left_anti").select("txid", "address").distinct())
    star = own.join(own.groupBy("txid").agg(F.min("address").alias("b")), "txid").select(F.col("address").alias("a"), "b")
    found = components(star, []).select(F.col("node").alias("address"), F.col("component").alias("cluster"))
    return own.select("address").distinct().join(found, "address", "left").withColumn("cluster", F.coalesce("cluster", "address"))


def trace(outputs: DataFrame, roots: DataFrame, max_depth: int = 2, beam: int | None = None, mixes: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(trace_id, txid, depth): transactions reached from roots (trace_id, txid), level by level, each at its first depth; see trace_ledger().

    Without beam and most no output is written but those that lead on: outputs may have a column mixed in place of mixes."""
    if beam or most:
        return _traced(outputs, roots, max_depth, beam, mixes, most)[0].select("trace_id", "txid", "depth")
    peel = F.coalesce("peel", F.lit(False)) if "peel" in outputs.columns else F.lit(False)
    links = outputs.filter(F.col("spend_txid").isNotNull() & ~F.coalesce(L.is_dust(F.col("value_sats")), F.lit(False)))
    links = links.filter(~F.coalesce("mixed", F.lit(False))) if "mixed" in outputs.columns else links
    links = links.select("txid", F.col("spend_txid").alias("to"), peel.cast("int").alias("more"))
    links = links.join(mixes.select("txid"), "txid", "left_anti") if mixes is not None else links
    frontier = settled(roots.select("trace_id", "txid", F.lit(0).cast("long").alias("depth"), F.lit(max_depth).alias("limit")).distinct())
    seen = [frontier]
    for depth in range(1, max_depth + 3):
        step = frontier.filter(F.col("limit") >= depth).join(links, "txid")
        goes = step.groupBy("trace_id", F.col("to").alias("txid")).agg(F.max(F.least(F.lit(max_depth + 2), F.col("limit") + F.col("more"))).alias("limit"))
        known = reduce(DataFrame.unionByName, seen).select("trace_id", "txid")
        frontier = settled(goes.join(known, ["trace_id", "txid"], "left_anti").select("trace_id", "txid", F.lit(depth).cast("long").alias("depth"), "limit"))
        if frontier.isEmpty():
            break
        seen.append(frontier)
    return reduce(DataFrame.unionByName, seen).select("trace_id", "txid", "depth")


def trace_ledger(outputs: DataFrame, roots: DataFrame, max_depth: int = 2, beam: int | None = None, mixes: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(trace_id, depth, txid, vout, spend_txid, value_sats, fate, reason): every output of every transaction a trace reaches, once.

    Roots and outputs(txid, vout, spend_txid, value_sats, and optionally peel) as in trace(). Of fate `kept` are outputs that led to a transaction
    (reason `new`, the parent edge of a transaction is the largest of these; or `again`, where the trace had it already); `halted`
    are those that are unspent, dust or of a mix; `pruned` are those that a limit left out: `depth`, `beam` or `budget`. The three
    make up all outputs met.

    Transactions of mixes(txid) are reached but not left. A trace ends at depth max_depth; each output with `peel` (a change of high confidence)
    on the way moves that limit one further, to max_depth + 2 at most. Of several ways to a transaction at its first depth the
    furthest limit counts. With `beam`, only that many of the largest outputs of a trace go on from each level; with `most`, a trace
    has that many transactions at most, and of a level the ones with the largest outputs come first.
    """
    return _traced(outputs, roots, max_depth, beam, mixes, most)[1]


def _traced(outputs: DataFrame, roots: DataFrame, max_depth: int, beam: int | None, mixes: DataFrame | None, most: int | None) -> tuple[DataFrame, DataFrame]:
    """Transactions reached, and the ledger of outputs met. Each level is ranked once, and split into what goes on and what stays behind."""
    peel = F.coalesce("peel", F.lit(False)) if "peel" in outputs.columns else F.lit(False)
    vout = F.col("vout") if "vout" in outputs.columns else F.lit(None).cast("long")
    met = outputs.select("txid", vout.alias("vout"), "spend_txid", "value_sats", peel.cast("int").alias("more"))
    mixed = mixes.select("txid", F.lit(True).alias("mixed")).distinct() if mixes is not None else None
    met = settled(met.withColumn("mixed", F.lit(None).cast("boolean")) if mixed is None else met.join(mixed, "txid", "left"))
    met = met.withColumn("halt", F.when(F.col("spend_txid").isNull(), "unspent").when(L.is_dust(F.col("value_sats")), "dust").when(F.col("mixed"), "mix"))
    frontier = seen = settled(roots.select("trace_id", "txid", F.lit(0).cast("long").alias("depth"), F.lit(max_depth).alias("limit")).distinct())
    ledger = None
    for depth in range(1, max_depth + 4):
        step = frontier.join(met, "txid").withColumn("reason", F.when(F.col("halt").isNotNull(), F.col("halt")).when(F.col("limit") < depth, "depth"))
        if beam:
            order = Window.partitionBy("trace_id", F.col("reason").isNull()).orderBy(F.desc("value_sats"), "spend_txid", "vout")
            step = step.withColumn("place", F.row_number().over(order)).withColumn("reason", F.when(F.col("reason").isNull() & (F.col("place") > beam), "beam").otherwise(F.col("reason"))).drop("place")
        step = settled(step)
        reach = F.least(F.lit(max_depth + 2), F.col("limit") + F.col("more"))
        goes = step.filter("reason is null").groupBy("trace_id", F.col("spend_txid").alias("to")).agg(F.max(reach).alias("on"), F.max("value_sats").alias("largest"))
        goes = goes.join(seen.select("trace_id", F.col("txid").alias("to"), F.lit("again").alias("was")), ["trace_id", "to"], "left")
        if most:
            room = seen.groupBy("trace_id").agg((F.lit(most) - F.count("*")).alias("room"))
            place = F.row_number().over(Window.partitionBy("trace_id", F.col("was").isNull()).orderBy(F.desc("largest"), "to"))
            goes = goes.join(room, "trace_id").withColumn("was", F.coalesce("was", F.when(place > F.col("room"), "budget")))
        goes = settled(goes)
        told = step.join(goes.select("trace_id", F.col("to").alias("spend_txid"), F.coalesce("was", F.lit("new")).alias("went")), ["trace_id", "spend_txid"], "left")
        why = F.coalesce("reason", "went")
        fate = F.when(why.isin("new", "again"), "kept").when(why.isin("depth", "beam", "budget"), "pruned").otherwise("halted")
        told = told.select("trace_id", "depth", "txid", "vout", "spend_txid", "value_sats", fate.alias("fate"), why.alias("reason"))
        ledger = told if ledger is None else ledger.unionByName(told)
        frontier = settled(goes.filter("was is null").select("trace_id", F.col("to").alias("txid"), F.lit(depth).cast("long").alias("depth"), F.col("on").alias("limit")))
        if frontier.isEmpty():
            break
        seen = settled(seen.unionByName(frontier))
    return seen, ledger
