import struct

import duckdb
from oracle import differences
from pyspark.sql import functions as F

from provenir.operators import audit_graph
from provenir.plans import registry
from provenir.sources import audit, kernel_db, labels, snapshots


def record(flags, code, payload, name=b""):
    return struct.pack("<BBHI", flags, 0, code if not name else len(name), len(payload)) + name + payload


def test_kernel_database(spark):
    key = kernel_db.encode_key
    parents = spark.createDataFrame([(bytearray(key(2, 0)), bytearray(key(1, 0))), (bytearray(key(2, 1)), bytearray(key(3, 0)))], "k binary, v binary")
    node = struct.pack("<QI", 3, 0)
    prov = [
        (key(1, 0), record(2, 1, b"PROC"), 1), (key(1, 0), record(2, 2, b"/bin/a"), 2), (key(2, 0), record(2, 1, b"FILE"), 3), (key(2, 0), record(2, 2, b"old"), 4), (key(2, 0), record(2, 2, b"new"), 5),
        (key(2, 1), record(4, 0, b"\x01", b"CREAT"), 6), (key(2, 1), record(6, 8, node), 7), (key(2, 1), record(2, 7, struct.pack("<ii", 12, 5)), 8), (key(9, 0), record(2, 1, b"FILE"), 9), (key(3, 0), record(2, 5, struct.pack("<II", 7, 8)), 10),
    ]
    db = spark.createDataFrame([(bytearray(k), bytearray(v), n) for k, v, n in prov], "k binary, v binary, seq long")
    tokens = spark.createDataFrame([(bytearray(struct.pack("<I", n)), bytearray(s)) for n, s in ((7, b"ls"), (8, b"-l"))], "k binary, v binary")
    g = kernel_db.make_graph(parents, db, tokens)
    nodes = {r.id: r for r in g.nodes.collect()}
    assert nodes["2.1"].name == "new" and nodes["2.1"].type == "FILE" and (nodes["2.1"].freeze_sec, nodes["2.1"].freeze_nsec) == (12, 5)
    assert nodes["3.0"].name == "PIPE-(3, 0)" and "9.0" not in nodes
    assert {(r.src, r.dst): r.type for r in g.edges.collect()} == {("1.0", "2.0"): None, ("3.0", "2.1"): "INPUT", ("2.0", "2.1"): "VERSION"}
    lists = kernel_db.decoded(kernel_db.records(db), kernel_db.token_map(tokens)).where("attr = 'ARGV'").first()
    assert lists["items"] == ["ls", "-l"]
    assert kernel_db.dump(db, "kx").columns == ["k"]


TRAIL = """noise
20,100,2,2,0,897000000,000000001
36,1,1,1,1,1,42,7,0,host
39,0,43
19,100
20,100,2,72,0,897000001,000000002
35,/etc/motd
36,1,1,1,1,1,43,7,0,host
19,100
20,100,2,72,0,897000009,000000002
36,1,1,1,1,1,43,7,0,host
"""


def test_audit_trail(spark, tmp_path):
    (tmp_path / "a.txt").write_text(TRAIL)
    found = audit.records(audit.numbered(spark, f"file://{tmp_path}"))
    rows = sorted(found.collect(), key=lambda r: r.seq)
    assert [(r.event_id, r.pid, r.return_value, r.paths) for r in rows] == [(2, "42", "43", []), (72, "43", None, ["/etc/motd"])]
    g = audit_graph.build(audit.events(found))
    assert {(r.src, r.dst) for r in g.edges.collect()} == {("p43#1", "p42#0"), ("p43#1", "f/etc/motd#0")}
    assert found.select(audit.compat_seconds(F.col("sec"), F.col("frac")).alias("s")).first().s in (897000000, 897000001)


def lines(spark, text):
    return spark.createDataFrame([("f", n, x) for n, x in enumerate(text)], "file string, seq long, line string")


def test_text_audit_snapshots(spark):
    rec = lambda pid, at, path: [f"header,90,2,execve(2),,Mon Jun 1 08:00:{at:02d} 1998, + 5 msec", f"path,{path}", f"subject,u,u,u,u,u,{pid},{pid - 1},0 0 h", "return,success,0", "trailer,90"]
    got = snapshots.from_audit(lines(spark, rec(5, 1, "/bin/a") + rec(6, 2, "/bin/b") + rec(7, 3, "/bin/c")), size=2).collect()
    by = {r.pid: r for r in got}
    assert by["5"].batch == by["6"].batch == 0 and by["7"].end_ts == snapshots.FAR and by["5"].end_ts == 896688002 and by["6"].ppid == "5" and by["7"].cmd == "/bin/c"


def test_process_listing(spark):
    row = f"{'':10}{1234:>4}{'':47}/usr/sbin/x -d"
    got = snapshots.from_listing(lines(spark, ["Mon Jun  1 08:00:00 EDT 1998", f"{'heading':<60} CMD", row])).collect()
    assert [(r.pid, r.cmd, r.end_ts) for r in got] == [("1234", "/usr/sbin/x", 896688000)]


def test_process_listing_of_wide_pids(spark, tmp_path):
    rows = [f"{'':10}{pid:>4}{'':47}/bin/x{pid} -d" for pid in (7, 9999, 10000, 1234567)]
    got = snapshots.from_listing(lines(spark, ["Mon Jun  1 08:00:00 EDT 1998", *rows])).collect()
    assert sorted((r.pid, r.cmd) for r in got) == [(p, f"/bin/x{p}") for p in ("10000", "1234567", "7", "9999")]
    events = [(50 * k, user) for k, user in enumerate((3, 9999, 10000, 123456))]
    spark.createDataFrame(events, "event_id long, user_id long").selectExpr("event_id", "timestamp_ntz'2024-01-01 10:00:00' AS ts", "user_id", "'view' AS event_type").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    n, m, different = differences(registry.queries()["listed_processes"](spark, str(tmp_path)), con, registry.oracle_sql()["listed_processes"])
    assert n == m == 8 and not different


def test_label_list(spark):
    df = spark.createDataFrame([("1 06/01/1998 08:00:00 a b c d e f g ffb_x", ), ("2 06/01/1998 08:00:01 a b c d e f g -",), ("",), ("3 06/01/1998 08:00:01 a b c d e f g zzz",)], "value string")
    assert [(r.id, r.ts, r.type) for r in labels.parse(df).collect()] == [("1", 896688000, "u2r"), ("2", 896688001, "none"), ("3", 896688001, "unknown")]
