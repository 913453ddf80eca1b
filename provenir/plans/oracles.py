"""DuckDB SQL for the registered queries, over the driver's tables."""

from __future__ import annotations

from ..operators.evaluate import PSIS
from ..operators.stats import STATS

KERNEL = """
ord AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate,
               row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS rnk,
               lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders),
nodes AS (
  SELECT 'C' || c_custkey AS id, 'C' || (c_custkey // 2) AS pnode, CAST(c_custkey % 2 AS BIGINT) AS version, 'PROC' AS type, c_mktsegment AS name,
         CAST(NULL AS BIGINT) AS freeze_sec, CAST(NULL AS BIGINT) AS freeze_nsec FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'S' || s_suppkey, 0, 'PROC', n_name, NULL, NULL FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'O' || o_orderkey, 'O' || o_custkey, rnk, 'FILE', o_orderpriority, CAST(floor(epoch(o_orderdate)) AS BIGINT), o_orderkey % 1000 FROM ord
  UNION ALL SELECT 'P' || p_partkey, 'P' || p_partkey, 0, 'FILE', p_brand, NULL, NULL FROM part
  UNION ALL SELECT 'N' || n_nationkey, CAST(n_nationkey AS VARCHAR), 0, 'PIPE', 'PIPE-(' || n_nationkey || ', 0)', NULL, NULL FROM nation),
edges AS (
  SELECT 'C' || o_custkey AS src, 'O' || o_orderkey AS dst, 'INPUT' AS type FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT DISTINCT 'O' || l_orderkey, 'P' || l_partkey, 'INPUT' FROM lineitem
  UNION ALL SELECT DISTINCT 'P' || l_partkey, 'S' || l_suppkey, 'INPUT' FROM lineitem
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'INPUT' FROM customer
  UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, 'INPUT' FROM supplier
  UNION ALL SELECT 'C' || (c_custkey // 10), 'C' || c_custkey, 'FORKPARENT' FROM customer WHERE c_custkey >= 10 AND c_custkey // 10 IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'C' || (c_custkey - 1), 'C' || c_custkey, 'VERSION' FROM customer WHERE c_custkey % 2 = 1 AND c_custkey - 1 IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'O' || prev, 'O' || o_orderkey, 'VERSION' FROM ord WHERE prev IS NOT NULL)
"""

AUDIT = """
ev AS (SELECT event_id, ts, CAST(floor(epoch(ts)) AS BIGINT) AS sec, user_id AS pid,
              CASE event_type WHEN 'error' THEN 'exit' WHEN 'signup' THEN 'fork' WHEN 'view' THEN 'read' WHEN 'click' THEN 'write' WHEN 'purchase' THEN 'exec' END AS kind,
              CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
timeline AS (
  SELECT event_id, ts, pid, 1 AS o, CASE WHEN kind = 'exit' THEN 1 ELSE 0 END AS ends FROM ev
  UNION ALL SELECT event_id, ts, k, 0, 1 FROM ev WHERE kind = 'fork'),
inc AS (SELECT event_id, pid, o, CAST(coalesce(sum(ends) OVER (PARTITION BY pid ORDER BY ts, event_id, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (1 - o) AS BIGINT) AS incarnation FROM timeline),
placed AS (SELECT ev.*, a.incarnation, b.incarnation AS child_incarnation FROM ev JOIN inc a ON ev.event_id = a.event_id AND a.o = 1 LEFT JOIN inc b ON ev.event_id = b.event_id AND b.o = 0),
uses AS (SELECT event_id, ts, sec, '/f' || k AS path, kind = 'write' AS is_write, 'p' || pid || '#' || incarnation AS me,
                CAST(sum(CASE WHEN kind = 'write' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY ts, event_id) AS BIGINT) AS ordinal FROM placed WHERE kind IN ('read', 'write')),
raw AS (
  SELECT ts, event_id, 'p' || k || '#' || child_incarnation AS src, 'p' || pid || '#' || incarnation AS dst, 'triggered by' AS type, 'fork' AS operation, sec FROM placed WHERE kind = 'fork'
  UNION ALL SELECT ts, event_id, me, 'f' || path || '#' || ordinal, CASE WHEN is_write THEN 'generated' ELSE 'used' END, NULL, sec FROM uses),
aedges AS (SELECT src, dst, arg_max(type, (ts, event_id)) AS type, arg_max(operation, (ts, event_id)) FILTER (operation IS NOT NULL) AS operation, arg_max(sec, (ts, event_id)) AS sec FROM raw GROUP BY src, dst),
cmds AS (SELECT pid, incarnation, arg_max('/bin/p' || (k % 10), (ts, event_id)) AS cmd FROM placed WHERE kind = 'exec' GROUP BY pid, incarnation),
procs AS (SELECT 'p' || p.pid || '#' || p.incarnation AS id, 'process' AS type, coalesce(cmd, 'UNKNOWN') AS name FROM (SELECT DISTINCT pid, incarnation FROM inc) p LEFT JOIN cmds c ON p.pid = c.pid AND p.incarnation = c.incarnation),
files AS (SELECT DISTINCT 'f' || path || '#' || ordinal AS id, 'file' AS type, 'f' || substr(path, 3) AS name FROM uses),
anodes AS (SELECT * FROM (SELECT * FROM procs UNION ALL SELECT * FROM files) WHERE id IN (SELECT src FROM aedges UNION SELECT dst FROM aedges))
"""

REACH = """
walk AS (SELECT id AS source, id AS node, 0 AS d FROM anodes WHERE type = 'process'
         UNION SELECT w.source, e.dst, w.d + 1 FROM walk w JOIN aedges e ON w.node = e.src WHERE w.d < 20 AND e.src <> e.dst),
reach AS (SELECT source, node, min(d) AS d FROM walk WHERE node <> source GROUP BY source, node)
"""

OPSAHL = """
score AS (SELECT n.id, n.name, round(coalesce(sum(1.0 / r.d), 0.0), 12) AS value FROM anodes n LEFT JOIN reach r ON n.id = r.source WHERE n.type = 'process' GROUP BY n.id, n.name)
"""

PARZEN = """
grp AS (SELECT name, count(*) AS n, CASE WHEN min(value) = max(value) THEN 0.0 ELSE stddev_pop(value) END AS sigma FROM score GROUP BY name),
vals AS (SELECT name, value, count(*) AS cnt FROM score GROUP BY name, value),
lik AS (SELECT a.name, a.value, a.cnt, g.n, g.sigma,
               CASE WHEN g.sigma > 0 THEN (SELECT ln(sum(b.cnt * exp(-power(a.value - b.value, 2) / (2 * power(g.sigma, 2))) / (sqrt(2 * pi()) * g.sigma)) / g.n) FROM vals b WHERE b.name = a.name) END AS ll
        FROM vals a JOIN grp g ON a.name = g.name),
pred AS (SELECT *, CASE WHEN sigma > 0 THEN (coalesce(sum(cnt) OVER (PARTITION BY name ORDER BY round(ll, 12) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
               - sum(cnt) OVER (PARTITION BY name, round(ll, 12))) / n ELSE 0.0 END AS pred,
               CASE WHEN sigma > 0 THEN sum(cnt) OVER (PARTITION BY name ORDER BY round(ll, 12) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / n ELSE 0.0 END AS cume FROM lik)
"""

LABELS = """
lab AS (SELECT event_id AS label, CAST(floor(epoch(ts)) AS BIGINT) AS ts, CASE WHEN event_id % 200 = 0 THEN 'u2r' ELSE 'none' END AS type FROM events WHERE event_id % 200 = 0 OR event_id % 100 = 50),
ends AS (SELECT e.sec, n.id, n.name FROM aedges e JOIN anodes n ON n.id IN (e.src, e.dst) WHERE n.type = 'process' AND n.name <> 'UNKNOWN')
"""


def candidates(w: int, window: str = "symmetric") -> str:
    low = f"sec > ts - {w}" if window == "symmetric" else f"sec > {w} - ts"
    return f"cand AS (SELECT DISTINCT label, type, id, name FROM lab JOIN ends ON {low} AND sec < ts + {w})"


def decisions(w: int) -> str:
    psis = ", ".join(f"(CAST({p!r} AS DOUBLE))" for p in PSIS)
    return f"""{candidates(w)},
scored AS (SELECT c.label, p.pred FROM cand c JOIN score s ON c.id = s.id JOIN pred p ON s.name = p.name AND s.value = p.value),
dec AS (SELECT l.label, l.type, psi, count(*) FILTER (pred > psi) AS normal, count(pred) AS total, count(pred) FILTER (pred <= psi) AS intrusions
        FROM lab l CROSS JOIN (VALUES {psis}) AS t(psi) LEFT JOIN scored s ON l.label = s.label GROUP BY l.label, l.type, psi)"""


CONFUSION = """c AS (SELECT psi, count(*) FILTER (type = 'u2r' AND intrusions > normal) AS tp, count(*) FILTER (type = 'u2r' AND intrusions <= normal) AS fn, count(*) FILTER (type = 'none' AND intrusions > normal) AS fp, count(*) FILTER (type = 'none' AND intrusions <= normal) AS tn FROM dec GROUP BY psi) SELECT *, round(tp / (tp + fn), 6) AS tpr, round(fp / (fp + tn), 6) AS fpr FROM c"""


def sweep(widths: tuple[int, ...]) -> str:
    return " UNION ALL ".join(f"SELECT {w} AS w, * FROM (WITH {decisions(w)}, {CONFUSION})" for w in widths)


def stat(name: str) -> str:
    s = STATS[name]
    near, far = ("src", "dst") if s.direction == "out" else ("dst", "src")
    return f"""WITH {KERNEL} SELECT n.id, n.name, count(o.id) AS cnt FROM nodes n LEFT JOIN edges e ON e.{near} = n.id AND e.type = '{s.edge}'
LEFT JOIN nodes o ON o.id = e.{far} AND o.type = '{s.other}' WHERE n.type = '{s.own}' GROUP BY n.id, n.name"""


def sample_rows(name: str = "samples", kept: str = "") -> str:
    return f"{name} AS (" + " UNION ALL ".join(
        f"SELECT n.id, n.name, '{k}' AS stat, CAST(count(o.id) AS DOUBLE) AS value FROM nodes n LEFT JOIN edges e ON e.{'src' if s.direction == 'out' else 'dst'} = n.id AND e.type = '{s.edge}' {kept} LEFT JOIN nodes o ON o.id = e.{'dst' if s.direction == 'out' else 'src'} AND o.type = '{s.other}' WHERE n.type = '{s.own}' GROUP BY n.id, n.name"
        for k, s in STATS.items()
    ) + ")"


KDE = """
model AS (SELECT name, stat, value AS x, count(*) AS c FROM samples GROUP BY name, stat, value),
asked AS (SELECT DISTINCT name, stat, value FROM samples),
dens AS (SELECT a.name, a.stat, a.value, sum(c * exp(-power(a.value - x, 2) / (2 * 0.25))) / sum(c) / (0.5 * sqrt(2 * pi())) AS density FROM asked a JOIN model m ON a.name = m.name AND a.stat = m.stat GROUP BY a.name, a.stat, a.value),
kde AS (SELECT s.*, d.density FROM samples s JOIN dens d ON s.name = d.name AND s.stat = d.stat AND s.value = d.value)
"""


def pagerank(rounds: int) -> str:
    parts = [KERNEL, "outs AS (SELECT src, count(*) AS k FROM edges GROUP BY src)", "total AS (SELECT count(*) AS n FROM nodes)", "r0 AS (SELECT id, 1.0 / n AS value FROM nodes, total)"]
    for k in range(1, rounds + 1):
        parts.append(f"g{k} AS (SELECT e.dst AS id, sum(r.value / o.k) AS got FROM edges e JOIN r{k - 1} r ON e.src = r.id JOIN outs o ON o.src = e.src GROUP BY e.dst)")
        parts.append(f"d{k} AS (SELECT coalesce(sum(value), 0) AS loose FROM r{k - 1} WHERE id NOT IN (SELECT src FROM outs))")
        parts.append(f"r{k} AS MATERIALIZED (SELECT n.id, 0.15 / t.n + 0.85 * d.loose / t.n + 0.85 * coalesce(g.got, 0) AS value FROM nodes n CROSS JOIN total t CROSS JOIN d{k} d LEFT JOIN g{k} g ON n.id = g.id)")
    return f"WITH {', '.join(parts)} SELECT id, round(value * 1e6, 4) AS value FROM r{rounds}"


def eigenvector(rounds: int) -> str:
    parts = [KERNEL, "total AS (SELECT count(*) AS n FROM nodes)", "outs AS (SELECT DISTINCT src FROM edges)", "r0 AS (SELECT id, CAST(1.0 AS DOUBLE) AS value FROM nodes)"]
    for k in range(1, rounds + 1):
        parts.append(f"s{k} AS (SELECT sum(value) AS s, sqrt(sum(value * value)) AS l FROM r{k - 1})")
        parts.append(f"g{k} AS (SELECT e.src AS id, sum(r.value) AS got FROM edges e JOIN r{k - 1} r ON e.dst = r.id GROUP BY e.src)")
        parts.append(f"r{k} AS MATERIALIZED (SELECT n.id, CASE WHEN n.id IN (SELECT src FROM outs) THEN coalesce(g.got, 0) ELSE s.s / t.n END / s.l AS value FROM nodes n CROSS JOIN total t CROSS JOIN s{k} s LEFT JOIN g{k} g ON n.id = g.id)")
    return f"WITH {', '.join(parts)} SELECT id, round(value / (SELECT sqrt(sum(value * value)) FROM r{rounds}), 8) AS value FROM r{rounds}"


ORACLES: dict[str, str] = {f"stat_{k}": stat(k) for k in STATS} | {
    "stats_by_name": f"WITH {KERNEL}, {sample_rows()} SELECT name, stat, count(*) AS n, sum(value) AS sum, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max FROM samples GROUP BY name, stat",
    "node_values": f"WITH {KERNEL}, {sample_rows()}, own(stat) AS (VALUES {', '.join(f"('{k}')" for k in STATS)}) SELECT n.id, n.name, o.stat, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM nodes n CROSS JOIN own o LEFT JOIN samples s ON s.id = n.id AND s.stat = o.stat WHERE n.id IN ('C7', 'O7', 'N7')",
    "version_edges": f"WITH {KERNEL} SELECT DISTINCT pnode AS src_pnode, version - 1 AS src_version, pnode AS dst_pnode, version AS dst_version FROM nodes WHERE version >= 1",
    "attr_inheritance": f"WITH {KERNEL}, o AS (SELECT pnode, version, CASE WHEN version > 0 AND length(pnode) % 2 = 0 THEN NULL ELSE name END AS name, freeze_sec FROM nodes) SELECT n.pnode, n.version, coalesce(n.name, z.name) AS name, coalesce(n.freeze_sec, z.freeze_sec) AS freeze_sec, CAST((coalesce(n.name, z.name) IS NOT NULL) AS INTEGER) + CAST((coalesce(n.freeze_sec, z.freeze_sec) IS NOT NULL) AS INTEGER) AS n_attrs FROM o n LEFT JOIN o z ON n.pnode = z.pnode AND z.version = 0",
    "edge_type_resolution": f"WITH {KERNEL}, ranked AS (SELECT src, dst, 9 AS k FROM edges UNION ALL SELECT src, dst, 3 FROM edges WHERE type <> 'FORKPARENT' UNION ALL SELECT src, dst, 2 FROM edges WHERE type = 'FORKPARENT' AND dst NOT IN (SELECT dst FROM edges WHERE type = 'INPUT') UNION ALL SELECT src, dst, 1 FROM edges WHERE type = 'INPUT') SELECT src, dst, CASE min(k) WHEN 1 THEN 'INPUT' WHEN 2 THEN 'FORKPARENT' WHEN 3 THEN 'VERSION' END AS type FROM ranked GROUP BY src, dst",
    "in_degree": f"WITH {KERNEL} SELECT n.id, round(count(e.src) / ((SELECT count(*) FROM nodes) - 1.0), 9) AS value FROM nodes n LEFT JOIN edges e ON e.dst = n.id GROUP BY n.id",
    "out_degree": f"WITH {KERNEL} SELECT n.id, round(count(e.dst) / ((SELECT count(*) FROM nodes) - 1.0), 9) AS value FROM nodes n LEFT JOIN edges e ON e.src = n.id GROUP BY n.id",
    "reverse_in_degree": f"WITH {KERNEL} SELECT n.id, round(count(e.dst) / ((SELECT count(*) FROM nodes) - 1.0), 9) AS value FROM nodes n LEFT JOIN edges e ON e.src = n.id GROUP BY n.id",
    "age": f"WITH {KERNEL}, t AS (SELECT id, CAST(freeze_sec || '.' || freeze_nsec AS DOUBLE) AS t FROM nodes) SELECT id, CASE WHEN t IS NULL OR t = 0 THEN 0.0 ELSE round((t - (SELECT min(t) FROM t)) / (SELECT max(t) - min(t) FROM t), 6) END AS value FROM t",
    "kde_score": f"WITH {KERNEL}, {sample_rows()}, {KDE} SELECT id, name, value, round(density, 6) AS density FROM kde WHERE stat = 'proc_out_file'",
    "kde_score_all": f"WITH {KERNEL}, {sample_rows()}, {KDE} SELECT id, name, stat, value, round(density, 6) AS density FROM kde",
    "kde_min_by_name": f"WITH {KERNEL}, {sample_rows()}, {KDE} SELECT name, stat, round(min(round(density, 9)), 6) AS density, arg_min(id, (round(density, 9), id)) AS id FROM kde GROUP BY name, stat",
    "kde_cross_graph": f"WITH {KERNEL}, {sample_rows()}, {sample_rows('other', "AND NOT (e.type = 'INPUT' AND (e.src LIKE '%5' OR e.dst LIKE '%5'))")} SELECT o.id, o.stat, o.value, round(avg(exp(-power(o.value - m.value, 2) / 0.5)) / (0.5 * sqrt(2 * pi())), 6) AS density FROM other o LEFT JOIN samples m ON m.name = CASE WHEN o.id LIKE 'S%' THEN 'BUILDING' ELSE o.name END AND m.stat = o.stat WHERE o.id LIKE 'S%' OR o.id LIKE 'C%' GROUP BY o.id, o.stat, o.value",
    "kde_diff": f"WITH {KERNEL}, {sample_rows()}, {KDE}, g AS (SELECT stat, density FROM kde WHERE id = 'C0'), b AS (SELECT stat, density FROM kde WHERE id = 'O1') SELECT coalesce(g.stat, b.stat) AS stat, round(g.density, 6) AS good, round(b.density, 6) AS bad, round(g.density - b.density, 6) AS difference FROM g FULL JOIN b ON g.stat = b.stat",
    "hist10": f"WITH {KERNEL}, {sample_rows()}, sp AS (SELECT name, stat, CASE WHEN min(value) = max(value) THEN min(value) - 1 ELSE min(value) END AS a, CASE WHEN min(value) = max(value) THEN max(value) + 1 ELSE max(value) END AS b, CASE WHEN min(value) = max(value) THEN 3 ELSE 10 END AS k FROM samples GROUP BY name, stat) SELECT s.name, s.stat, least(CAST(floor((value - a) / ((b - a) / k)) AS INTEGER) + 1, k) AS bin, count(*) AS cnt FROM samples s JOIN sp ON s.name = sp.name AND s.stat = sp.stat GROUP BY 1, 2, 3",
    "kde_grid": f"WITH {KERNEL}, {sample_rows()}, model AS (SELECT name, stat, value AS x, count(*) AS c FROM samples WHERE stat = 'proc_out_file' GROUP BY name, stat, value), sp AS (SELECT name, min(x) AS a, max(x) AS b FROM model GROUP BY name), pts AS (SELECT name, i, a + (b - a) * i / 99 AS value FROM sp, range(100) r(i)) SELECT p.name, CAST(p.i AS INTEGER) AS i, round(p.value, 6) AS value, round(sum(c * exp(-power(p.value - x, 2) / 0.5)) / sum(c) / (0.5 * sqrt(2 * pi())), 6) AS density FROM pts p JOIN model m ON p.name = m.name GROUP BY p.name, p.i, p.value",
    "pagerank_10it": pagerank(10),
    "eigen_10it": eigenvector(10),
    "incarnations": f"WITH {AUDIT} SELECT event_id, pid, o = 0 AS child_row, incarnation FROM inc",
    "exec_names": f"WITH {AUDIT} SELECT * FROM cmds",
    "file_versions": f"WITH {AUDIT} SELECT event_id, path, is_write, ordinal, ordinal AS version FROM uses",
    "egraph_edges": f"WITH {AUDIT} SELECT * FROM aedges",
    "egraph_nodes": f"WITH {AUDIT} SELECT id, type, name FROM (SELECT * FROM procs UNION ALL SELECT * FROM files)",
    "drop_isolated": f"WITH {AUDIT} SELECT id, type, name FROM anodes",
    "process_counts": f"WITH {AUDIT} SELECT name, count(*) AS cnt FROM anodes WHERE type = 'process' GROUP BY name",
    "ancestor": f"WITH RECURSIVE {AUDIT}, {REACH} SELECT n.id, round(count(r.node) / (SELECT count(*) FROM anodes), 9) AS value FROM anodes n LEFT JOIN reach r ON n.id = r.source WHERE n.type = 'process' GROUP BY n.id",
    "opsahl": f"WITH RECURSIVE {AUDIT}, {REACH}, {OPSAHL} SELECT id, round(value, 6) AS value FROM score",
    "opsahl_by_name": f"WITH RECURSIVE {AUDIT}, {REACH}, {OPSAHL} SELECT name, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS max FROM score GROUP BY name",
    "parzen_ll": f"WITH RECURSIVE {AUDIT}, {REACH}, {OPSAHL}, {PARZEN} SELECT name, round(value, 6) AS value, cnt, n, round(ll, 6) AS ll FROM lik",
    "parzen_pred": f"WITH RECURSIVE {AUDIT}, {REACH}, {OPSAHL}, {PARZEN} SELECT name, round(value, 6) AS value, cnt, round(pred, 6) AS pred FROM pred",
    "parzen_pred_cume": f"WITH RECURSIVE {AUDIT}, {REACH}, {OPSAHL}, {PARZEN} SELECT name, round(value, 6) AS value, cnt, round(cume, 6) AS pred FROM pred",
    "candidates_symmetric": f"WITH {AUDIT}, {LABELS}, {candidates(1000)} SELECT label, id, name FROM cand",
    "candidates_prefix": f"WITH {AUDIT}, {LABELS}, {candidates(1000, 'prefix')} SELECT label, count(*) AS n FROM cand GROUP BY label",
    "label_ends": f"WITH {AUDIT}, {LABELS}, {candidates(1000, 'prefix')} SELECT l.label, count(c.id) AS n FROM lab l LEFT JOIN cand c ON c.label = l.label GROUP BY l.label",
    "psi_decisions": f"WITH RECURSIVE {AUDIT}, {REACH}, {OPSAHL}, {PARZEN}, {LABELS}, {decisions(1000)} SELECT * FROM dec",
    "confusion_matrix": f"WITH RECURSIVE {AUDIT}, {REACH}, {OPSAHL}, {PARZEN}, {LABELS}, {decisions(1000)}, {CONFUSION}",
    "window_sweep": f"WITH RECURSIVE {AUDIT}, {REACH}, {OPSAHL}, {PARZEN}, {LABELS} {sweep((10, 100, 1000))}",
    "label_class": "WITH m(pre, cls) AS (VALUES ('FURNITURE', 'dos'), ('BUILD', 'u2r'), ('AUTO', 'probe'), ('-', 'none')) SELECT c_custkey AS id, c_mktsegment AS name, coalesce((SELECT cls FROM m WHERE pre = c_mktsegment), (SELECT min(cls) FROM m WHERE starts_with(c_mktsegment, pre)), 'unknown') AS type FROM customer",
    "snapshot_asof": "WITH e AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), b AS (SELECT event_id AS batch, t AS end_ts FROM e WHERE event_id % 97 = 0) SELECT event_id, (SELECT arg_min(batch, (end_ts, batch)) FROM b WHERE end_ts >= e.t) AS batch FROM e",
}
