"""Literal micro-cases of the graph jobs, and properties that must hold for any input."""

import random

import pytest

from utxolens.operators import graph as G

EDGE = "case_id string, src string, dst string, value_sats long, edge_idx long"


def edges(spark, *rows):
    return spark.createDataFrame([("k", a, b, v, i) for i, (a, b, v) in enumerate(rows)], EDGE)


def seeds(spark, *names):
    return spark.createDataFrame([("k", n) for n in names], "case_id string, node string")


def values(df, column="taint"):
    return {r["node"]: r[column] for r in df.collect()}


def test_haircut_halves_at_even_fan_in(spark):
    got = values(G.taint(edges(spark, ("seed", "v", 50), ("x", "v", 50)), seeds(spark, "seed")))
    assert got == {"seed": 1.0, "v": 0.5}


def test_fifo_fills_edges_in_order(spark):
    e = edges(spark, ("seed", "m", 50), ("x", "m", 50), ("m", "o1", 50), ("m", "o2", 50))
    assert values(G.taint(e, seeds(spark, "seed"), "fifo")) == {"seed": 1.0, "m": 0.5, "o1": 1.0}
    assert values(G.taint(e, seeds(spark, "seed"))) == {"seed": 1.0, "m": 0.5, "o1": 0.5, "o2": 0.5}


def test_no_value_carries_no_taint(spark):
    e = edges(spark, ("seed", "data", 0), ("seed", "a", 5))
    assert set(values(G.taint(e, seeds(spark, "seed")))) == {"seed", "a"}
    assert {r["node"] for r in G.taint_poison(e, seeds(spark, "seed")).collect()} == {"seed", "a"}


@pytest.mark.parametrize("model", ["haircut", "fifo"])
def test_no_seed_no_taint(spark, model):
    assert G.taint(edges(spark, ("a", "b", 5)), seeds(spark), model).count() == 0


def test_long_chain_against_the_row_order(spark):
    e = edges(spark, *[(f"n{i}", f"n{i + 1}", 10) for i in reversed(range(12))])
    assert values(G.taint(e, seeds(spark, "n0")))["n12"] == 1.0


def test_cycle_settles_and_audit_is_clean(spark):
    e = edges(spark, ("seed", "a", 10), ("a", "b", 10), ("b", "a", 5), ("b", "c", 5))
    t = G.taint(e, seeds(spark, "seed"))
    assert 0 < values(t)["c"] <= 1
    assert tuple(G.audit_taint(e, t, seeds(spark, "seed")).first())[1:4] == (0, 0, 0)


def test_audit_finds_tampering(spark):
    e = edges(spark, ("seed", "a", 10))
    bad = spark.createDataFrame([("k", "seed", 0.4), ("k", "a", 1.5)], "case_id string, node string, taint double")
    row = G.audit_taint(e, bad, seeds(spark, "seed")).first()
    assert row["out_of_bounds"] == 1 and row["unpinned"] == 1


def test_ranks_put_cycles_last(spark):
    e = edges(spark, ("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("x", "y", 1), ("y", "x", 1))
    assert values(G.ranks(e), "rank") == {"a": 0, "b": 1, "c": 2, "x": 3, "y": 3}


def longest(pairs):
    """Longest distance from a source, by relaxation; None for nodes on or behind cycles."""
    nodes = {n for p in pairs for n in p}
    rank, left = {}, set(nodes)
    while free := {n for n in left if all(a not in left for a, b in pairs if b == n)}:
        rank |= {n: max([rank[a] + 1 for a, b in pairs if b == n], default=0) for n in free}
        left -= free
    return rank | {n: max(rank.values(), default=-1) + 1 for n in left}


def test_ranks_by_contraction_equal_plain_ones(spark):
    """Many small graphs at once: sparse ones, that hold runs, diamonds and cycles."""
    rng, rows, want = random.Random(3), [], {}
    for case in range(60):
        n = rng.randint(2, 14)
        pairs = {(i, i + 1) for i in range(n) if rng.random() < 0.8} | {tuple(sorted(rng.sample(range(n + 1), 2))) for _ in range(rng.randint(0, 4))}
        pairs |= {tuple(rng.sample(range(n + 1), 2)) for _ in range(rng.randint(0, 1))} | ({(0, 0)} if rng.random() < 0.1 else set())
        rows += [(f"k{case}", f"n{a}", f"n{b}", 1, 0) for a, b in pairs] + [(f"k{case}", None, "n0", 1, 0)]
        want |= {(f"k{case}", f"n{x}"): r for x, r in longest(pairs).items()}
    got = G.ranks(spark.createDataFrame(rows + rows[:9], EDGE), patience=2).collect()
    assert len(got) == len(want) and {(r["case_id"], r["node"]): r["rank"] for r in got} == want


def test_ranks_of_a_long_chain_take_few_rounds(spark):
    n = 100_000
    chain = spark.range(n).selectExpr("'k' as case_id", "cast(id as string) as src", "cast(id + 1 as string) as dst", "1L as value_sats", "id as edge_idx")
    got = G.ranks(chain, max_rounds=40)
    assert got.filter("cyclic or rank != cast(node as long)").isEmpty() and got.count() == n + 1


def test_cycles_are_written_once(spark):
    e = edges(spark, ("a", "b", 3), ("b", "c", 2), ("c", "a", 4), ("b", "a", 9))
    assert sorted(r["path"] for r in G.cycles(e, 3).collect()) == ["a>b", "a>b>c"]


def test_trail_takes_the_heaviest_path(spark):
    e = edges(spark, ("s", "a", 5), ("a", "t", 5), ("s", "b", 9), ("b", "t", 2))
    row = G.money_trail(e, seeds(spark, "s")).first()
    assert (row["path"], row["total_sats"]) == ("s>b>t", 11)


def test_collapse_needs_three_leaves(spark):
    e = edges(spark, ("a", "h", 1), ("b", "h", 2), ("c", "h", 3), ("h", "o", 6), ("p", "q", 1))
    got = {(r["src"], r["dst"], r["value_sats"]) for r in G.collapse(e).collect()}
    assert got == {("cluster:h", "h", 6), ("h", "o", 6), ("p", "q", 1)}


def test_clusters_join_common_spenders(spark):
    txi = spark.createDataFrame([(1, "1"), (1, "2"), (2, "2"), (2, "3"), (3, "4"), (4, "5"), (4, "1")], "txid long, address string")
    none = spark.createDataFrame([(4,)], "txid long")
    assert {r["address"]: r["cluster"] for r in G.clusters(txi, none).collect()} == {"1": "1", "2": "1", "3": "1", "4": "4"}


def test_trace_stops_at_dust_and_depth(spark):
    out = spark.createDataFrame([(0, 1, 9000), (0, 2, 300), (1, 3, 9000), (3, 4, 9000)], "txid long, spend_txid long, value_sats long")
    roots = spark.createDataFrame([(0, 0)], "trace_id long, txid long")
    assert {(r["txid"], r["depth"]) for r in G.trace(out, roots, 2).collect()} == {(0, 0), (1, 1), (3, 2)}


def test_splitting_a_case_changes_nothing(spark):
    rows = [("s", "a", 5), ("a", "b", 3), ("x", "b", 3)]
    two = edges(spark, *rows).unionByName(edges(spark, *rows).replace("k", "other", "case_id"))
    both = G.taint(two, spark.createDataFrame([("k", "s"), ("other", "s")], "case_id string, node string"))
    one = {r["node"]: r["taint"] for r in both.filter("case_id = 'other'").collect()}
    assert one == values(G.taint(edges(spark, *rows), seeds(spark, "s")))


def test_limits_are_errors_not_results(spark):
    chain = edges(spark, *[(f"n{i}", f"n{i + 1}", 10) for i in range(12)])
    ladder = edges(spark, *[(f"{a}{i}", f"{b}{i + 1}", 1) for i in range(12) for a in "xy" for b in "xy"])
    with pytest.raises(RuntimeError):
        G.ranks(ladder, max_rounds=5)
    assert values(G.ranks(ladder, max_rounds=20), "rank")["x12"] == 12
    with pytest.raises(RuntimeError):
        G.taint(chain, seeds(spark, "n0"), max_rounds=4)
    assert values(G.ranks(chain, max_rounds=20), "rank")["n12"] == 12


def test_paths_on_empty_tables(spark):
    none = edges(spark, ("a", "b", 5)).limit(0)
    for job in (G.money_trail, G.routes):
        assert job(none, seeds(spark)).count() == 0 and job(none, seeds(spark, "a")).count() == 0
        assert job(edges(spark, ("a", "b", 5)), seeds(spark)).count() == 0
    assert G.money_trail(none, seeds(spark, "a")).columns == G.money_trail(edges(spark, ("a", "b", 5)), seeds(spark, "a")).columns


def test_digests_count_repeated_rows(spark):
    from utxolens.operators import cases as C

    def digest(*rows):
        return C.snapshot_digest(spark.createDataFrame([("k", r) for r in rows], "case_id string, value string"), "case_id").first()["digest"]

    assert digest("a", "a", "b") != digest("c", "c", "b") and digest("a", "b", "a") == digest("b", "a", "a") != digest("a", "b", "b")


def best_of_all(edges, starts, ends=None):
    """The highest total of all simple paths from starts, to ends if one of them can be reached."""
    links = {}
    for a, b, v in edges:
        if a != b and v > 0:
            links.setdefault(a, {})[b] = links.get(a, {}).get(b, 0) + v
    best = {}

    def walk(node, path, total):
        if total > best.get(node, 0):
            best[node] = total
        for to, v in links.get(node, {}).items():
            if to not in path:
                walk(to, [*path, to], total + v)

    for s in starts:
        walk(s, [s], 0)
    if ends and any(e in best for e in ends):
        best = {e: best[e] for e in ends if e in best}
    return max(best.values(), default=None), links


def test_money_trail_on_any_graph(spark):
    """Two hundred random graphs with cycles, chains longer than ten hops and dead ends, against all simple paths."""
    dice, rows, starts, ends, graphs = random.Random(17), [], [], [], {}
    for g in range(200):
        n = dice.randint(2, 8)
        own = [(f"n{dice.randrange(n)}", f"n{dice.randrange(n)}", dice.choice([0, 1, 2, 5, 9, 100])) for _ in range(dice.randint(1, 16))]
        if g % 20 == 0:
            own += [(f"n{n - 1}" if i == 0 else f"c{i}", f"c{i + 1}", 3) for i in range(14)]
        first, last = {f"n{dice.randrange(n)}" for _ in range(2)}, [f"n{dice.randrange(n)}"] if g % 2 else []
        graphs[f"g{g}"] = own, first, last
        rows += [(f"g{g}", a, b, v, i) for i, (a, b, v) in enumerate(own)]
        starts += [(f"g{g}", s) for s in first]
        ends += [(f"g{g}", e) for e in last]
    edges = spark.createDataFrame(rows, "case_id string, src string, dst string, value_sats long, edge_idx long")
    node = "case_id string, node string"
    got = {r["case_id"]: r for r in G.money_trail(edges, spark.createDataFrame(starts, node), spark.createDataFrame(ends, node)).collect()}
    for case, (own, first, last) in graphs.items():
        want, links = best_of_all(own, first, last)
        assert (case in got) == (want is not None), case
        if want is not None:
            path = got[case]["path"].split(">")
            assert got[case]["total_sats"] == want and got[case]["exact"] and path[0] in first and len(set(path)) == len(path)
            assert sum(links[a][b] for a, b in zip(path, path[1:], strict=False)) == want
    assert max(r["path"].count(">") for r in got.values()) > 12


def test_strong_components_of_any_graph(spark):
    dice, rows, want = random.Random(8), [], {}
    for g in range(40):
        own = {(dice.randrange(9), dice.randrange(9)) for _ in range(14)}
        reach = {a: {a} for a in range(9)}
        for _ in range(9):
            for a, b in own:
                for x in reach.values():
                    if a in x:
                        x.add(b)
        for a in range(9):
            both = {b for b in range(9) if b in reach[a] and a in reach[b]}
            if len(both) > 1:
                want[str(g), str(a)] = str(max(both))
        rows += [(str(g), str(a), str(b)) for a, b in own]
    got = G.strong_components(spark.createDataFrame(rows, "case_id string, src string, dst string")).collect()
    assert len(got) == len(want) and {(r[0], r[1]): r[2] for r in got} == want


def test_a_search_that_is_cut_says_so(spark):
    rows = [("k", f"n{i:02}", f"n{j:02}", 1 + (i * 7 + j * 3) % 11, 0) for i in range(12) for j in range(12) if i != j]
    edges = spark.createDataFrame(rows, "case_id string, src string, dst string, value_sats long, edge_idx long")
    start = spark.createDataFrame([("k", "n00"), ("k", "alone"), ("none", "n00")], "case_id string, node string")
    cut = G.money_trail(edges, start, steps=50).collect()
    assert len(cut) == 1 and not cut[0]["exact"] and cut[0]["total_sats"] > 0
    assert G.money_trail(edges.limit(0), start).collect() == []


def test_a_ledger_of_a_trace_has_every_output_met(spark):
    """Random spending with peels, mixes, dust and all limits, against plain loops."""
    dice, rows, roots = random.Random(12), [], []
    for txid in range(150):
        for vout in range(dice.randint(1, 4)):
            rows.append((txid, vout, dice.choice([None, *range(txid + 1, txid + 6)]) if dice.random() < 0.9 else dice.randrange(150), dice.choice([100, 600, 5000, 5000, 9000, 70_000]), dice.random() < 0.3))
    outputs = spark.createDataFrame(rows, "txid long, vout long, spend_txid long, value_sats long, peel boolean")
    mixed = {t for t in range(150) if t % 11 == 3}
    roots = [(f"t{r}", r) for r in range(0, 150, 4)]
    start, mixes = spark.createDataFrame(roots, "trace_id string, txid long"), spark.createDataFrame([(t,) for t in mixed], "txid long")
    for max_depth, beam, most in ((2, None, None), (3, 2, None), (3, None, 5), (2, 3, 6)):
        want, reached = [], []
        for trace, root in roots:
            seen, level = {root}, {root: max_depth}
            for depth in range(1, max_depth + 4):
                open_ = []
                for t, limit in level.items():
                    for row in (r for r in rows if r[0] == t):
                        halt = "unspent" if row[2] is None else "dust" if row[3] < 546 else "mix" if t in mixed else "depth" if limit < depth else None
                        if halt:
                            want.append((trace, depth - 1, *row[:4], halt))
                        else:
                            open_.append((row, limit))
                open_.sort(key=lambda x: (-x[0][3], x[0][2], x[0][1]))
                cut, goes = (open_[beam:] if beam else []), {}
                for row, limit in open_[: beam or None]:
                    big, on = goes.get(row[2], (0, 0))
                    goes[row[2]] = max(big, row[3]), max(on, min(max_depth + 2, limit + row[4]))
                new = sorted((t for t in goes if t not in seen), key=lambda t: (-goes[t][0], t))
                late = set(new[max(0, most - len(seen)) :]) if most else set()
                want += [(trace, depth - 1, *row[:4], "beam") for row, _ in cut]
                want += [(trace, depth - 1, *row[:4], "again" if row[2] in seen else "budget" if row[2] in late else "new") for row, _ in open_[: beam or None]]
                level = {t: goes[t][1] for t in new if t not in late}
                seen |= set(level)
            reached += [(trace, t) for t in seen]
        got = G.trace_ledger(outputs, start, max_depth, beam, mixes, most).collect()
        assert sorted(map(str, ((*r[:6], r["reason"]) for r in got))) == sorted(map(str, want))
        assert {r["fate"] for r in got} == {"kept", "pruned", "halted"} and all((r["fate"] == "kept") == (r["reason"] in ("new", "again")) for r in got)
        assert sorted((r["trace_id"], r["txid"]) for r in G.trace(outputs, start, max_depth, beam, mixes, most).collect()) == sorted(reached)


@pytest.mark.parametrize("model", ["haircut", "fifo"])
def test_taint_computes_only_what_the_frontier_touches(spark, model):
    """The fixpoint of plain rounds over all nodes, on graphs with cycles; fewer nodes a round where the frontier is small."""
    dice = random.Random(6)
    rows = [(f"n{dice.randrange(12)}", f"n{dice.randrange(12)}", dice.choice([3, 50, 700, 1000])) for _ in range(30)]
    chain = [("n0", "c0", 500)] + [(f"c{i}", f"c{i + 1}", 400) for i in range(12)]
    rows = [r for r in rows if r[0] != r[1]] + chain
    start = ["n0", "n3"]
    inflow, outflow, state = {}, {}, dict.fromkeys(start, 1.0)
    for a, b, v in rows:
        outflow[a], inflow[b] = outflow.get(a, 0) + v, inflow.get(b, 0) + v
    for _ in range(400):
        came, left = {}, {}
        for a, b, v in rows:
            if model == "fifo":
                if a not in left:
                    left[a] = outflow[a] if a in start else min(outflow[a], int(inflow.get(a, 0) * state.get(a, 0.0) + 0.5))
                given = max(0, min(v, left[a]))
                left[a] -= v
            else:
                given = state.get(a, 0.0) * v
            came[b] = came.get(b, 0) + given
        state = {**{n: min(1.0, c / inflow[n]) for n, c in came.items() if c > 0}, **dict.fromkeys(start, 1.0)}
    watch = []
    got = values(G.taint(edges(spark, *rows), seeds(spark, *start), model, watch=watch))
    assert set(got) == set(state) and all(abs(got[n] - t) < 1e-6 for n, t in state.items())
    assert watch[-1] <= 3 and max(watch) > watch[-1] and len(watch) >= 12
