import random

from lectern.operators import hierarchy as h


def graph(spark, edges, nodes=None):
    links = h.clean_links(spark.createDataFrame(edges or [(None, None)], "parent string, child string"))
    names = sorted(nodes or {x for e in edges for x in e if x})
    rows = spark.createDataFrame([(n, n.upper()) for n in names] or [("x", None)], "node string, label string")
    return (rows if names else rows.limit(0)), h.known_links(links, rows)


def findings(links):
    return {r.node: r.finding for r in h.spoilt_by_cycles(links).collect()}


def brute(edges):
    down = {}
    for a, b in edges:
        down.setdefault(a, set()).add(b)

    def reach(n):
        seen, todo = set(), [n]
        while todo:
            for x in down.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    nodes = {x for e in edges for x in e}
    on = {n for n in nodes if n in reach(n)}
    below = {x for n in on for x in reach(n)} - on
    return {n: "on_cycle" for n in on} | {n: "below_cycle" for n in below}


def test_simple_cycle_and_what_hangs_below(spark):
    edges = [("r", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("r", "s"), ("q", "q"), ("q", "p")]
    _, links = graph(spark, edges)
    assert findings(links) == brute(edges)


def test_linked_cycles_leave_their_bridge_out(spark):
    # two cycles joined by a path: its nodes are reachable from a cycle and on none
    edges = [("a", "b"), ("b", "a"), ("b", "x"), ("x", "y"), ("y", "c"), ("c", "d"), ("d", "c"), ("d", "z")]
    _, links = graph(spark, edges)
    assert findings(links) == brute(edges)


def test_random_graphs_against_brute_force(spark):
    dice = random.Random(3)
    for _ in range(3):
        edges = sorted({(f"n{dice.randrange(14)}", f"n{dice.randrange(14)}") for _ in range(16)})
        _, links = graph(spark, edges)
        assert findings(links) == brute(edges)


def test_deep_chain_paths_and_descendants(spark):
    edges = [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(70)]
    nodes, links = graph(spark, edges)
    spoilt = h.spoilt_by_cycles(links)
    assert spoilt.count() == 0
    paths = {r.node: r for r in h.full_paths(nodes, links, spoilt).collect()}
    assert paths["n070"].depth == 70 and paths["n070"].root == "n000" and paths["n070"].path[35] == "n035"
    below = h.descendants(h.full_paths(nodes, links, spoilt))
    assert below.where("node = 'n000'").count() == 70
    assert below.where("node = 'n010' and descendant = 'n020'").first().distance == 10


def test_several_parents_give_several_paths(spark):
    nodes, links = graph(spark, [("a", "c"), ("b", "c"), ("c", "d"), ("a", "c"), ("a", "d")], ["a", "b", "c", "d", "e"])
    spoilt = h.spoilt_by_cycles(links)
    paths = sorted((r.node, "".join(r.path)) for r in h.full_paths(nodes, links, spoilt).collect())
    assert paths == [("a", "a"), ("b", "b"), ("c", "ac"), ("c", "bc"), ("d", "acd"), ("d", "ad"), ("d", "bcd"), ("e", "e")]
    distance = {(r.node, r.descendant): r.distance for r in h.descendants(h.full_paths(nodes, links, spoilt)).collect()}
    assert distance["a", "d"] == 1 and distance["b", "d"] == 2


def test_nulls_unknown_ids_and_empty_input(spark):
    links = h.clean_links(spark.createDataFrame([(None, "a"), ("a", None), ("a", "ghost"), ("a", "b"), ("a", "b")], "parent string, child string"))
    nodes = spark.createDataFrame([("a", None, 1), ("b", "B", 2)], "node string, label string, parent int")
    links = h.known_links(links, nodes)
    assert [tuple(r) for r in links.collect()] == [("a", "b")]
    spoilt = h.spoilt_by_cycles(links)
    assert {r.node: r.labels for r in h.full_paths(nodes.select("node", "label"), links, spoilt).collect()} == {"a": [""], "b": ["", "B"]}
    empty = nodes.select("node", "label").limit(0)
    none = links.limit(0)
    assert h.spoilt_by_cycles(none).columns == ["node", "finding"] and h.spoilt_by_cycles(none).count() == 0
    assert h.full_paths(empty, none, h.spoilt_by_cycles(none)).count() == 0
    assert h.descendants(h.full_paths(empty, none, h.spoilt_by_cycles(none))).count() == 0


def test_squeeze_knows_the_ideographic_space(spark):
    df = spark.createDataFrame([("　 a 　\n b　",)], "t string")
    assert df.select(h.squeeze(df.t)).first()[0] == "a b"


def test_tangled_cycles(spark):
    edges = [("a", "b"), ("b", "a"), ("b", "x"), ("x", "c"), ("c", "d"), ("d", "c"), ("a", "d"), ("d", "z"), ("s", "s"), ("s", "a")]
    _, links = graph(spark, edges)
    assert findings(links) == brute(edges)


def test_nodes_below_a_cycle_keep_their_sound_roots(spark):
    # the cycle y, z leads to b too, but a and x are sound and reach b and c
    nodes, links = graph(spark, [("a", "b"), ("x", "b"), ("b", "c"), ("y", "z"), ("z", "y"), ("z", "b"), ("z", "w")])
    spoilt = h.spoilt_by_cycles(links)
    assert findings(links) == {"y": "on_cycle", "z": "on_cycle", "b": "below_cycle", "c": "below_cycle", "w": "below_cycle"}
    paths = h.full_paths(nodes, links, spoilt.where("finding = 'on_cycle'")).collect()
    assert sorted("".join(r.path) for r in paths) == ["a", "ab", "abc", "x", "xb", "xbc"]
    pairs = {(r.node, r.descendant) for r in h.reachable(links).collect()}
    assert {("a", "b"), ("a", "c"), ("x", "b"), ("x", "c"), ("y", "c"), ("y", "w")} <= pairs and ("a", "w") not in pairs


def test_cycles_cut_off_no_descendants(spark):
    # a sound root above a cycle, what hangs below it, a shortcut, a long chain into a second cycle
    edges = [("r", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("r", "e"), ("q", "q"), ("q", "p"), ("r", "c00")]
    edges += [(f"c{k:02d}", f"c{k + 1:02d}") for k in range(20)] + [("c20", "c15")]
    down = {}
    for a, b in edges:
        down.setdefault(a, []).append(b)
    want = {}
    for n in down:
        far, ring = {n: 0}, [n]
        while ring:
            ring = [far.setdefault(b, far[a] + 1) and b for a in ring for b in down.get(a, ()) if b not in far]
        want |= {(n, x): d for x, d in far.items() if x != n}
    _, links = graph(spark, edges)
    rows = h.reachable(links).collect()
    assert {(r.node, r.descendant): r.distance for r in rows} == want and len(rows) == len(want)
    assert h.reachable(links.limit(0)).count() == 0


def test_descendants_of_and_through_spoilt_nodes(spark, tmp_path):
    from lectern.plans.outlines import p3_descendants

    spark.createDataFrame(
        [("r", None, ["a"]), ("a", "b", []), ("b", "a", ["x"]), ("x", None, ["x"])], "node_id string, parent_id string, children array<string>"
    ).selectExpr("*", "node_id AS title", "CAST(NULL AS array<string>) AS breadcrumb").write.parquet(f"{tmp_path}/source_nodes.parquet")
    spark.createDataFrame(
        [("p", [("Composition ", "q")]), ("q", [("composition", "p")])], "draft_id string, members array<struct<member_type string, draft_id string>>"
    ).selectExpr("*", "draft_id AS canonical_key").write.parquet(f"{tmp_path}/composition_revisions.parquet")
    got = {(r.node_id, r.descendant_id, r.distance) for r in p3_descendants(spark, str(tmp_path)).collect()}
    assert got == {("r", "a", 1), ("r", "b", 2), ("r", "x", 3), ("a", "b", 1), ("b", "a", 1), ("a", "x", 2), ("b", "x", 1), ("p", "q", 1), ("q", "p", 1)}


def test_closure_and_staleness_pass_through_cycles(spark, tmp_path):
    from lectern.plans.integrity import stale_compositions
    from lectern.plans.knowledge import composition_closure

    # r -> p <-> q -> s, r -> s's neighbour t; only s and q have statements, s and p no rendering
    rows = [
        ("r", [("composition", "p"), ("composition", "t")], "x"),
        ("p", [("composition", "q")], None),
        ("q", [("composition", "p"), (" Composition", "s"), ("statement", "2")], "x"),
        ("s", [("Statement", "1")], None),
        ("t", [], "x"),
    ]
    spark.createDataFrame(rows, "draft_id string, members array<struct<member_type string, draft_id string>>, rendering string").selectExpr(
        "*", "draft_id AS canonical_key"
    ).write.parquet(f"{tmp_path}/composition_revisions.parquet")
    closure = [tuple(r) for r in composition_closure(spark, str(tmp_path)).select("composition", "statement").collect()]
    assert sorted(closure) == [("p", "1"), ("p", "2"), ("q", "1"), ("q", "2"), ("r", "1"), ("r", "2"), ("s", "1")]
    assert sorted(r.node for r in stale_compositions(spark, str(tmp_path)).collect()) == ["p", "q", "r", "s"]


def test_levels_by_the_longest_way(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("x", "d"), ("z", "y")]
    nodes, links = graph(spark, edges, [*"abcdxyz", "lone"])
    assert {r.node: r.level for r in h.levels(nodes, links).collect()} == {"a": 3, "b": 2, "c": 1, "d": 0, "x": None, "y": None, "z": None, "lone": 0}
    chain = [(f"n{k:02d}", f"n{k + 1:02d}") for k in range(40)]
    nodes, links = graph(spark, chain)
    assert {r.node: r.level for r in h.levels(nodes, links).collect()}["n00"] == 40
    assert h.levels(nodes.limit(0), links.limit(0)).count() == 0
