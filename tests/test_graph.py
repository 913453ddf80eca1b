import pytest
from pyspark.sql import functions as F

from provenir.graph import ProvGraph
from provenir.operators import audit_graph, centrality, construct, evaluate, stats
from provenir.sources import graph_json


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([("a", "PROC", "x"), ("b", "FILE", "y"), ("c", "FILE", "y"), ("d", "PROC", "x"), ("e", None, "z")], "id string, type string, name string")
    edges = spark.createDataFrame([("a", "b", "INPUT"), ("a", "c", "INPUT"), ("b", "c", "VERSION"), ("a", "d", "FORKPARENT"), ("d", "e", "INPUT"), ("c", "d", None)], "src string, dst string, type string")
    return ProvGraph(nodes, edges)


def test_counts_keep_zeros(graph):
    got = {r.id: r.cnt for r in stats.count_edge_types(graph, stats.STATS["proc_out_file"]).collect()}
    assert got == {"a": 2, "d": 0}


def test_one_pass_equals_single_counts(graph):
    wide = {r.id: r for r in stats.all_stats(graph).collect()}
    for name, s in stats.STATS.items():
        for r in stats.count_edge_types(graph, s).collect():
            assert wide[r.id][name] == r.cnt, name


def test_out_and_in_counts_balance(graph):
    t = stats.all_stats(graph).agg(F.sum("proc_out_file").alias("a"), F.sum("file_in_proc").alias("b")).first()
    assert t.a == t.b


def test_reach(graph):
    reached = centrality.distances(graph)
    assert {(r.source, r.node): r.d for r in reached.collect()} == {("a", "b"): 1, ("a", "c"): 1, ("a", "d"): 1, ("a", "e"): 2, ("b", "c"): 1, ("b", "d"): 2, ("b", "e"): 3, ("c", "d"): 1, ("c", "e"): 2, ("d", "e"): 1}
    score = {r.id: r.value for r in centrality.opsahl(graph).collect()}
    assert score["a"] == pytest.approx(3.5) and score["e"] == 0.0 and score["b"] == pytest.approx(1 + 1 / 2 + 1 / 3)
    share = {r.id: r.value for r in centrality.ancestor(graph).collect()}
    assert share["a"] == pytest.approx(4 / 5) and share["e"] == 0


def test_reach_survives_cycles(spark):
    nodes = spark.createDataFrame([("a", "P", "x"), ("b", "P", "x")], "id string, type string, name string")
    edges = spark.createDataFrame([("a", "b", "t"), ("b", "a", "t"), ("a", "a", "t")], "src string, dst string, type string")
    assert sorted((r.source, r.node, r.d) for r in centrality.distances(ProvGraph(nodes, edges)).collect()) == [("a", "b", 1), ("b", "a", 1)]


def test_pagerank_sums_to_one(graph):
    got = centrality.pagerank(graph, rounds=30).agg(F.sum("value")).first()[0]
    assert got == pytest.approx(1.0)


def test_eigenvector_sides(spark):
    nodes = spark.createDataFrame([(x, "P", x) for x in "abc"], "id string, type string, name string")
    edges = spark.createDataFrame([("a", "b", "t"), ("b", "a", "t"), ("b", "c", "t"), ("c", "a", "t")], "src string, dst string, type string")
    import numpy as np

    m = np.array([[0, 1, 0], [1, 0, 1], [1, 0, 0]], float)
    for side, matrix in (("right", m), ("left", m.T)):
        w, v = np.linalg.eig(matrix)
        want = np.abs(v[:, w.real.argmax()].real)
        got = {r.id: r.value for r in centrality.eigenvector(ProvGraph(nodes, edges), 40, side).collect()}
        assert [got[x] for x in "abc"] == pytest.approx(list(want), abs=1e-3)


def test_edge_precedence(spark):
    t = lambda *rows: spark.createDataFrame(rows or [("-", "-")], "src string, dst string").where("src <> '-'")
    got = construct.resolve_types(t(("a", "b"), ("c", "b"), ("a", "d"), ("q", "r")), t(("a", "b")), t(("c", "b"), ("a", "d")), t(("a", "b"), ("a", "d"), ("m", "n")))
    assert {(r.src, r.dst): r.type for r in got.collect()} == {("a", "b"): "INPUT", ("c", "b"): None, ("a", "d"): "FORKPARENT", ("q", "r"): None, ("m", "n"): "VERSION"}
    with pytest.raises(ValueError):
        construct.resolve_types(t(), t(("a", "b")), t(), t(), strict=True)


SCHEMA = "seq long, kind string, pid string, child string, path string, path2 string, time long"


def test_pid_reuse(spark):
    rows = [(1, "fork", "1", "2", None, None, 10), (2, "exec", "2", None, "/bin/a", None, 11), (3, "read", "2", None, "/x", None, 12), (4, "exit", "2", None, None, None, 13), (5, "read", "2", None, "/x", None, 14), (6, "write", "2", None, "/x", None, 15), (7, "read", "1", None, "/x", None, 16), (8, "rename", "1", None, "/x", "/y", 17)]
    g = audit_graph.build(spark.createDataFrame(rows, SCHEMA))
    edges = {(r.src, r.dst): (r.type, r.operation) for r in g.edges.collect()}
    assert edges[("p2#1", "p1#0")] == ("triggered by", "fork")
    assert edges[("p2#1", "f/x#0")][0] == "used" and edges[("p2#2", "f/x#0")][0] == "used"
    assert edges[("p2#2", "f/x#1")][0] == "generated" and edges[("p1#0", "f/x#1")][0] == "used"
    assert edges[("f/y#1", "f/x#1")] == ("derived", "rename") and edges[("p1#0", "f/y#1")] == ("generated", None) and edges[("p1#0", "f/x#1")][1] is None
    names = {r.id: r.name for r in g.unknown_names().nodes.collect()}
    assert names["p2#1"] == "/bin/a" and names["p2#2"] == "UNKNOWN" and names["f/x#0"] == "x"


def test_own_fork_is_a_loop(spark):
    g = audit_graph.build(spark.createDataFrame([(1, "fork", "1", "1", None, None, 10)], SCHEMA))
    assert [(r.src, r.dst) for r in g.edges.collect()] == [("p1#1", "p1#1")]


def test_later_edges_overwrite(spark):
    e = spark.createDataFrame([("a", "b", "triggered by", "fork", 1, 1), ("a", "b", "used", None, 2, 2)], "src string, dst string, type string, operation string, time long, seq long")
    r = audit_graph.upsert_edges(e).first()
    assert (r.type, r.operation, r.time) == ("used", "fork", 2)


def test_path_normalisation_is_one_pass(spark):
    df = spark.createDataFrame([("a////b",), ("/x/y z ",)], "p string")
    assert [r[0] for r in df.select(audit_graph.normal_path(F.col("p"))).collect()] == ["a//b", "/x/y z "]
    assert df.select(audit_graph.basename(F.col("p"))).collect()[1][0] == "y z"


def test_windows_and_votes(spark):
    nodes = spark.createDataFrame([("p", "process", "n"), ("q", "process", "UNKNOWN"), ("f", "file", "f")], "id string, type string, name string")
    edges = spark.createDataFrame([("p", "f", "used", 100), ("q", "f", "used", 100), ("p", "q", "triggered by", 500)], "src string, dst string, type string, sec long")
    labels = spark.createDataFrame([(1, 109, "u2r"), (2, 110, "none"), (3, 5000, "none")], "id long, ts long, type string")
    g = ProvGraph(nodes, edges)
    assert [(r.label, r.id) for r in evaluate.candidates(g, labels, 10).collect()] == [(1, "p")]
    assert sorted(r.label for r in evaluate.candidates(g, labels, 10, "prefix").collect()) == [1, 2, 3]
    preds = spark.createDataFrame([("p", 0.3)], "id string, pred double")
    decided = evaluate.decisions(evaluate.candidates(g, labels, 10), preds, labels, (0.1, 0.5))
    assert {(r.label, r.psi): (r.normal, r.intrusions) for r in decided.collect()} == {(1, 0.1): (1, 0), (1, 0.5): (0, 1), (2, 0.1): (0, 0), (2, 0.5): (0, 0), (3, 0.1): (0, 0), (3, 0.5): (0, 0)}
    got = {r.psi: (r.tp, r.fn, r.fp, r.tn) for r in evaluate.confusion(decided).collect()}
    assert got == {0.1: (0, 1, 0, 2), 0.5: (1, 0, 0, 2)}


def test_snapshot_as_of(spark):
    events = spark.createDataFrame([(1, 5), (2, 10), (3, 11), (4, 99), (5, 500)], "e long, ts long")
    batches = spark.createDataFrame([("a", 10), ("b", 60), ("c", 130)], "batch string, end_ts long")
    got = {r.e: r.batch for r in audit_graph.snapshot_as_of(events, batches, 20).collect()}
    assert got == {1: "a", 2: "a", 3: "b", 4: "c", 5: None}


def test_snapshot_of_one_crowded_bucket(spark):
    """No frame starts at its row: such a frame is read anew for each row, which takes time with the square of a bucket."""
    n = 3000
    events = spark.range(n).select(F.col("id").alias("e"), (F.col("id") % (n // 2)).alias("ts")).union(spark.sql("select -1L, cast(null as long)"))
    batches = spark.createDataFrame([("b", 10), ("a", 10), ("z", None), ("c", n // 4), ("d", 2 * n)], "batch string, end_ts long")
    found = audit_graph.snapshot_as_of(events, batches, n)
    got = {r.batch: r["count"] for r in found.groupBy("batch").count().collect()}
    assert got == {"a": 22, "c": 2 * (n // 4 - 10), "d": 2 * (n // 2 - n // 4 - 1), None: 1}
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()


def test_json_round_trip(spark, graph, tmp_path):
    graph_json.save(graph, f"file://{tmp_path}/g")
    back = graph_json.load(spark, f"file://{tmp_path}/g")
    assert back.nodes.count() == 5 and back.edges.count() == 6
    (tmp_path / "d.json").write_text('{"nodes": [[0, {"type": "process", "cmd": "/bin/a"}], [1, {"type": "file"}]], "edges": [[0, 1, {"type": "used", "time": "1000000001"}]]}')
    doc = graph_json.load_document(spark, f"file://{tmp_path}/d.json")
    assert {(r.id, r.type, r.name) for r in doc.nodes.collect()} == {("0", "process", "/bin/a"), ("1", "file", None)}
    assert doc.edges.first().type == "used"
    assert graph_json.node_link_lines(graph).count() == 11
