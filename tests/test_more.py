"""Operators at their edges, and the forms that large inputs take, against plain Python."""

import gzip
import math
import random

import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from provenir import session
from provenir.graph import ProvGraph
from provenir.operators import audit_graph, centrality, construct, density, evaluate, ordered, stats
from provenir.plans import raw, registry
from provenir.sources import audit, graph_json, kernel_db, star


def test_before_and_after(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SPAN", 4)
    rnd = random.Random(3)
    rows = sorted({rnd.randrange(-40, 60) for _ in range(30)})
    own = [(b, rnd.randrange(5), rnd.choice([None, b * 10])) for b in rows]
    df = spark.createDataFrame(own, "b long, n long, first long")
    assert {r.b: r["sum"] for r in ordered.before(df.select("b", "n")).collect()} == {b: sum(n for c, n, _ in own if c < b) for b in rows}
    assert {r.b: r.after for r in ordered.after(df.select("b", "first")).collect()} == {b: next((f for c, _, f in own if c > b and f is not None), None) for b in rows}


def test_count_below(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SPAN", 3)
    rnd = random.Random(4)
    points, asked = [rnd.randrange(-500, 500) for _ in range(300)], [rnd.randrange(-600, 600) for _ in range(80)]
    got = ordered.count_below(spark.createDataFrame([(x,) for x in points], "t long"), spark.createDataFrame([(x,) for x in asked], "t long"), 20).collect()
    assert {r.t: r.n for r in got} == {t: sum(p < t for p in points) for t in asked}
    assert ordered.count_below(spark.createDataFrame([], "t long"), spark.createDataFrame([(5,)], "t long"), 20).first().n == 0


def test_prefix_counts_equal_candidates(spark):
    nodes = spark.createDataFrame([(f"p{k}", "process", "n" if k % 4 else "UNKNOWN") for k in range(30)] + [("f", "file", "f")], "id string, type string, name string")
    rnd = random.Random(6)
    edges = spark.createDataFrame([(f"p{rnd.randrange(30)}", "f", "used", rnd.randrange(0, 4000)) for _ in range(90)], "src string, dst string, type string, sec long")
    labels = spark.createDataFrame([(k, rnd.randrange(-500, 5000), "none") for k in range(40)], "id long, ts long, type string")
    g = ProvGraph(nodes, edges)
    counted = {r.label: r.n for r in evaluate.candidates(g, labels, 700, "prefix").groupBy("label").agg(F.count("*").alias("n")).collect()}
    got = {r.label: r.n for r in evaluate.prefix_counts(g, labels, 700, width=100).collect()}
    assert got == {k: counted.get(k, 0) for k in range(40)}
    assert {r.n for r in evaluate.prefix_counts(ProvGraph(nodes, edges.where("sec < 0")), labels, 700).collect()} == {0}


def test_prefix_counts_make_no_pairs(spark, sf_dir, monkeypatch):
    nodes = spark.createDataFrame([("p", "process", "n"), ("q", "process", "n"), ("f", "file", "f")], "id string, type string, name string")
    edges = spark.createDataFrame([("p", "f", "used", 50), ("p", "f", "used", 990), ("q", "f", "used", 2000)], "src string, dst string, type string, sec long")
    labels = spark.createDataFrame([(1, 5), (2, 11), (3, 1001), (4, None)], "id long, ts long")
    g = ProvGraph(nodes, edges)
    counted = {r.label: r.n for r in evaluate.candidates(g, labels, 1000, "prefix").groupBy("label").agg(F.count("*").alias("n")).collect()}
    monkeypatch.setattr(evaluate, "candidates", None)
    assert {r.label: r.n for r in evaluate.prefix_counts(g, labels, 1000).collect()} == {1: 0, 2: 1, 3: 2, 4: 0} and counted == {2: 1, 3: 2}
    n, m, different = differences(registry.queries()["candidates_prefix"](spark, sf_dir), connect(sf_dir), registry.oracle_sql()["candidates_prefix"])
    assert n == m > 0 and not different


def test_sweep_is_written_by_width(spark, tmp_path):
    nodes = spark.createDataFrame([("p", "process", "n"), ("f", "file", "f")], "id string, type string, name string")
    g = ProvGraph(nodes, spark.createDataFrame([("p", "f", "used", 100)], "src string, dst string, type string, sec long"))
    labels = spark.createDataFrame([(1, 105, "u2r"), (2, 150, "none")], "id long, ts long, type string")
    preds = spark.createDataFrame([("p", 0.05)], "id string, pred double")
    swept = evaluate.window_sweep(g, labels, preds, (10, 100))
    for w in (10, 100):
        one = evaluate.confusion(evaluate.decisions(evaluate.candidates(g, labels, w), preds, labels))
        assert sorted(map(str, swept.where(F.col("w") == w).drop("w").collect())) == sorted(map(str, one.collect()))
    evaluate.write_sweep(swept, f"file://{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["w=10", "w=100"] and spark.read.parquet(f"file://{tmp_path}/out").count() == swept.count()
    prefix = evaluate.window_sweep(g, labels, preds, (10,), "prefix")
    assert prefix.columns == swept.columns and prefix.count() == len(evaluate.PSIS)


def test_densities_in_parts(spark, monkeypatch):
    rnd = random.Random(1)
    rows = spark.createDataFrame([(rnd.choice("ab"), "s", "m", round(rnd.random() * 40, 1)) for _ in range(400)] + [("c", "s", "m", 1.0)], "name string, stat string, metric string, value double")
    whole = [density.kde_score(rows, rows), density.parzen_pred(density.parzen(rows.drop("stat")))]
    want = [sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()) if k == 0 else sorted((str(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in df.collect())) for k, df in enumerate(whole)]
    monkeypatch.setattr(density, "PART", 7)
    cut = [density.kde_score(rows, rows), density.parzen_pred(density.parzen(rows.drop("stat")))]
    got = [sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()) if k == 0 else sorted((str(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in df.collect())) for k, df in enumerate(cut)]
    assert got == want


def test_numbered_over_splits(spark, tmp_path):
    lines = [f"20,100,2,{1 if k % 2 else 2},0,{897000000 + k},1\r\n36,1,1,1,1,1,{k},7,0,host\r\n\r\n39,0,{k + 1}\r\n19,100\r\n" for k in range(400)]
    (tmp_path / "a.txt").write_text("".join(lines), newline="")
    with gzip.open(tmp_path / "b.txt.gz", "wt", newline="") as f:
        f.write("".join(lines[:50]))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = audit.numbered(spark, f"file://{tmp_path}")
        rows = sorted((r.file, r.seq, r.split, r.line) for r in got.collect())
        assert len({r[2] for r in rows}) > 4 and len({r[:2] for r in rows}) == len(rows)
        assert [r[3] for r in rows if r[0].endswith("a.txt")] == [x for x in "".join(lines).split("\r\n") if x]
        found = audit.records(got).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    own = sorted((r.file[-1], r.sec - 897000000, r.pid, r.return_value, r.event_id) for r in found)
    assert own == sorted([("t", k, str(k), str(k + 1), 1 if k % 2 else 2) for k in range(400)] + [("z", k, str(k), str(k + 1), 1 if k % 2 else 2) for k in range(50)])


def test_asserts_of_ancestry(spark):
    one = spark.createDataFrame([(1, 0, 2, 0)], "parent_pnode long, parent_version long, child_pnode long, child_version long")
    rows = [(2, 0, "INPUT", None, 1, 0, True, 1)]
    schema = "pnode long, version long, attr string, value string, ref_pnode long, ref_version long, ancestry boolean, seq long"
    assert {r.type for r in construct.make_graph(one, spark.createDataFrame(rows, schema), strict=True).edges.collect()} == {"INPUT"}
    loose = spark.createDataFrame([(1, 0, "FORKPARENT", None, 2, 0, True, 1)], schema)
    assert construct.make_graph(one, loose).edges.count() == 2
    with pytest.raises(ValueError):
        construct.make_graph(one, loose, strict=True)


def test_report(spark):
    one = spark.createDataFrame([(1, 0, 2, 1)], "parent_pnode long, parent_version long, child_pnode long, child_version long")
    rows = spark.createDataFrame([(1, 0, "NAME", "/bin/a", None, None, False, 1), (1, 0, "TYPE", "PROC", None, None, False, 2), (2, 0, "NAME", "x", None, None, False, 3)], "pnode long, version long, attr string, value string, ref_pnode long, ref_version long, ancestry boolean, seq long")
    lines = [r.line for r in construct.report_lines(construct.make_graph(one, rows)).collect()]
    assert lines == ["1", "-> 0", "---> NAME -> /bin/a", "---> TYPE -> PROC", "2", "-> 0", "---> NAME -> x", "-> 1", "---> NAME -> x"]


def test_parents_of_a_snapshot(spark):
    events = spark.createDataFrame([(1, "fork", "1", "2", None, None, 10), (2, "exit", "2", None, None, None, 11), (3, "read", "2", None, "/x", None, 12)], "seq long, kind string, pid string, child string, path string, path2 string, time long")
    snapshot = spark.createDataFrame([("2", "1"), ("9", "1"), ("1", "8")], "pid string, ppid string")
    got = audit_graph.parent_edges(audit_graph.build(events), snapshot).collect()
    assert [(r.src, r.dst, r.type, r.time) for r in got] == [("p2#2", "p1#0", "triggered by", None)]


def test_without_rebinding(spark):
    rows = [(1, "fork", "1", "2", None, None, 10), (2, "read", "2", None, "/x", None, 11), (3, "exit", "2", None, None, None, 12), (4, "fork", "1", "2", None, None, 13), (5, "read", "2", None, "/x", None, 14)]
    events = spark.createDataFrame(rows, "seq long, kind string, pid string, child string, path string, path2 string, time long")
    assert {r.src for r in audit_graph.build(events, rebind=False).edges.where("operation is null").collect()} == {"p2#0", "p2#1"}
    assert {r.src for r in audit_graph.build(events).edges.where("operation is null").collect()} == {"p2#1", "p2#3"}
    uses = spark.createDataFrame([(1, "/x", True), (2, "/x", False), (3, "/x", True), (4, "/dev/null", True)], "seq long, path string, is_write boolean")
    assert [(r.ordinal, r.version) for r in audit_graph.file_versions(uses, upsert=True).sort("seq").collect()] == [(0, 1), (0, 1), (0, 2), (0, 0)]


def test_padded_age(spark):
    nodes = spark.createDataFrame([("a", 1, 5), ("b", 1, 50), ("c", 2, 0), ("d", None, None)], "id string, freeze_sec long, freeze_nsec long")
    g = ProvGraph(nodes, spark.createDataFrame([], "src string, dst string, type string"))
    plain, padded = ({r.id: r.value for r in centrality.age(g, x).collect()} for x in (False, True))
    assert plain["a"] == plain["b"] == 0.0 and padded["b"] == pytest.approx(4.5e-8, rel=1e-3) and padded["a"] == 0.0
    assert plain["c"] == padded["c"] == 1.0 and plain["d"] == 0.0


def test_labels_are_chosen(spark):
    rows = spark.createDataFrame([(k, "u2r" if k < 3 else "none" if k < 40 else "dos") for k in range(50)], "id long, type string")
    got = [evaluate.select_labels(rows, s).groupBy("type").count().collect() for s in (1, 2)]
    assert all({r.type: r["count"] for r in x} == {"u2r": 3, "none": 6} for x in got)
    with pytest.raises(ValueError):
        evaluate.select_labels(rows.where("type <> 'none'"))


def test_values_of_nodes_have_all_statistics(spark):
    nodes = spark.createDataFrame([("a", "PROC", "x"), ("b", "FILE", "y"), ("c", "PIPE", "z")], "id string, type string, name string")
    edges = spark.createDataFrame([("a", "b", "INPUT"), ("a", "c", "INPUT"), ("a", "a", "FORKPARENT")], "src string, dst string, type string")
    got = stats.node_values(ProvGraph(nodes, edges), nodes.where("id <> 'c'").select("id")).collect()
    assert len(got) == 32 and {(r.id, r.stat): r.value for r in got if r.value} == {("a", "proc_out_file"): 1, ("a", "proc_out_pipe"): 1, ("a", "proc_out_proc"): 1, ("a", "proc_in_proc"): 1, ("b", "file_in_proc"): 1}
    one = stats.samples(ProvGraph(nodes, edges), {"proc_out_file": stats.STATS["proc_out_file"]})
    assert [tuple(r) for r in one.collect()] == [("a", "x", "proc_out_file", 1.0)]


def test_eigenvector_of_no_edges(spark):
    nodes = spark.createDataFrame([("a", "P", "x"), ("b", "P", "x")], "id string, type string, name string")
    g = ProvGraph(nodes, spark.createDataFrame([], "src string, dst string, type string"))
    assert {round(r.value, 9) for r in centrality.eigenvector(g, 3).collect()} == {round(1 / math.sqrt(2), 9)}
    assert {r.value for r in centrality.pagerank(g, 3).collect()} == {0.5}
    none = ProvGraph(nodes.where("id > 'z'"), g.edges)
    assert centrality.pagerank(none, 3).count() == centrality.eigenvector(none, 3).count() == 0


def test_colours(spark):
    nodes = spark.createDataFrame([(k, k, "n") for k in ("PROC", "FILE", "NP_FILE", "PIPE", "DIR", "OTHER")] + [("none", None, "n")], "id string, type string, name string")
    lines = graph_json.node_link_lines(ProvGraph(nodes, spark.createDataFrame([], "src string, dst string, type string")))
    assert {r.id: r.colour for r in lines.select(F.from_json("value", "id string, colour string").alias("r")).select("r.*").collect()} == {"PROC": "r", "FILE": "g", "NP_FILE": "b", "PIPE": "y", "DIR": "o", "OTHER": "k", "none": "k"}


def test_shared_folder_is_named_on_a_cluster(spark):
    assert session.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")

    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        session.shared_folder(Cluster)


def test_large_numbers_of_databases(spark):
    df = spark.createDataFrame([(bytearray(kernel_db.encode_key(2**63 - 1, 2**32 - 1)),), (bytearray(kernel_db.encode_key(2**63, 1)),), (bytearray(b"\x01"),)], "k binary")
    got = [(r.pnode, r.version) for r in df.select(*kernel_db.node_key(F.col("k"))).collect()]
    assert got == [(2**63 - 1, 2**32 - 1), (None, 1), (None, None)]
    back = spark.createDataFrame([(2**40 + 3, 7)], "p long, v long").select(raw.key(F.col("p"), F.col("v")).alias("k")).select(*kernel_db.node_key(F.col("k"))).first()
    assert (back.pnode, back.version) == (2**40 + 3, 7)


def test_every_query_is_its_own(spark, sf_dir):
    assert set(raw.queries()) <= set(registry.queries()) and star.kernel_graph(spark, sf_dir).nodes.columns[0] == "id"
