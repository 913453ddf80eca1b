"""DuckDB SQL for the queries over raw inputs: what they must give, from the tables themselves."""

from __future__ import annotations

from .oracles import AUDIT, KERNEL
from .raw import ODD_PART, ORDERS

#: Objects, versions and attributes as the records have them.
DB = f"""
c AS (SELECT c_custkey AS k, c_custkey // 2 AS pnode, c_custkey % 2 AS version, c_custkey // 10 AS up, c_mktsegment AS segment, c_nationkey AS nation FROM customer),
o AS (SELECT o_orderkey + {ORDERS} AS pnode, CAST(0 AS BIGINT) AS version, o_custkey, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS sec, o_orderkey % 1000 AS nsec FROM orders WHERE o_custkey > 0),
anc AS (SELECT up // 2 AS parent_pnode, up % 2 AS parent_version, pnode AS child_pnode, version AS child_version FROM c WHERE k >= 10
        UNION ALL SELECT o_custkey // 2, o_custkey % 2, pnode, version FROM o),
known AS (SELECT parent_pnode AS pnode, parent_version AS version FROM anc UNION SELECT child_pnode, child_version FROM anc UNION SELECT parent_pnode, 0 FROM anc UNION SELECT child_pnode, 0 FROM anc),
own AS (SELECT pnode, version, 'TYPE' AS attr, 'PROC' AS value FROM c WHERE version = 0
        UNION ALL SELECT pnode, version, 'NAME', CASE WHEN k % {ODD_PART} = 0 THEN 'own' || k WHEN version = 0 THEN segment END FROM c WHERE version = 0 OR k % {ODD_PART} = 0
        UNION ALL SELECT pnode, version, 'PID', CAST(k AS VARCHAR) FROM c WHERE k % 3 = 0
        UNION ALL SELECT pnode, version, 'ARGV', NULL FROM c
        UNION ALL SELECT pnode, version, 'TYPE', 'FILE' FROM o UNION ALL SELECT pnode, version, 'FREEZETIME', sec || '.' || nsec FROM o),
attrs AS (SELECT n.pnode, n.version, a.attr, arg_max(a.value, a.version) FILTER (a.value IS NOT NULL) AS value FROM known n JOIN own a ON a.pnode = n.pnode AND (a.version = n.version OR a.version = 0) GROUP BY ALL),
n AS (SELECT k.pnode, k.version, max(value) FILTER (attr = 'TYPE') AS type, coalesce(max(value) FILTER (attr = 'NAME'), 'PIPE-(' || k.pnode || ', ' || k.version || ')') AS name, max(value) FILTER (attr = 'FREEZETIME') AS frozen, max(value) FILTER (attr = 'PID') AS pid
      FROM known k LEFT JOIN attrs a ON a.pnode = k.pnode AND a.version = k.version GROUP BY k.pnode, k.version)
"""

LINES = """
e AS (SELECT event_id, ts, strftime(ts, '%Y%m%d') AS file, CAST(floor(epoch(ts)) AS BIGINT) AS sec, user_id AS pid, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
             CASE event_type WHEN 'error' THEN 'exit' WHEN 'signup' THEN 'fork' WHEN 'view' THEN 'read' WHEN 'click' THEN 'write' WHEN 'purchase' THEN 'rename' END AS kind FROM events WHERE event_id % 50 <> 7),
r AS (SELECT *, event_id % 40 <> 0 AS subject FROM e)
"""

# As AUDIT has it, but for renames and the order of files by day.
RENAMES = """
g AS (SELECT * FROM r WHERE subject),
tl AS (SELECT event_id, file, ts, pid, 1 AS o, CASE WHEN kind = 'exit' THEN 1 ELSE 0 END AS ends FROM g
       UNION ALL SELECT event_id, file, ts, k, 0, 1 FROM g WHERE kind = 'fork'),
inc AS (SELECT event_id, pid, o, CAST(coalesce(sum(ends) OVER (PARTITION BY pid ORDER BY file, ts, event_id, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (1 - o) AS BIGINT) AS incarnation FROM tl),
pl AS (SELECT g.*, 'p' || g.pid || '#' || a.incarnation AS me, 'p' || g.k || '#' || b.incarnation AS child FROM g JOIN inc a ON g.event_id = a.event_id AND a.o = 1 LEFT JOIN inc b ON g.event_id = b.event_id AND b.o = 0),
u0 AS (SELECT event_id, ts, sec, me, '/f' || k AS path, kind = 'write' AS is_write, false AS renamed FROM pl WHERE kind IN ('read', 'write')
       UNION ALL SELECT event_id, ts, sec, me, '/f' || k, false, true FROM pl WHERE kind = 'rename' UNION ALL SELECT event_id, ts, sec, me, '/f' || (k + 1), true, true FROM pl WHERE kind = 'rename'),
us AS (SELECT *, 'f' || path || '#' || CAST(sum(CASE WHEN is_write THEN 1 ELSE 0 END) OVER w AS BIGINT) AS file_id, CAST(sum(CASE WHEN is_write THEN 1 ELSE 0 END) OVER w AS BIGINT) AS version FROM u0 WINDOW w AS (PARTITION BY path ORDER BY ts, event_id)),
rawe AS (SELECT ts, event_id, child AS src, me AS dst, 'triggered by' AS type, 'fork' AS operation, sec FROM pl WHERE kind = 'fork'
         UNION ALL SELECT ts, event_id, me, file_id, CASE WHEN is_write THEN 'generated' ELSE 'used' END, NULL, sec FROM us
         UNION ALL SELECT a.ts, a.event_id, b.file_id, a.file_id, 'derived', 'rename', a.sec FROM us a JOIN us b ON a.event_id = b.event_id AND a.renamed AND b.renamed AND NOT a.is_write AND b.is_write)
"""

COLOUR = "CASE {0}.type WHEN 'PROC' THEN 'r' WHEN 'FILE' THEN 'g' WHEN 'PIPE' THEN 'y' ELSE 'k' END"

ORACLES: dict[str, str] = {
    "db_nodes": f"WITH {DB} SELECT pnode || '.' || version AS id, pnode, version, type, name, CAST(split_part(frozen, '.', 1) AS BIGINT) AS freeze_sec, CAST(split_part(frozen, '.', 2) AS BIGINT) AS freeze_nsec, pid FROM n",
    "db_edges": f"""WITH {DB}, inp AS (SELECT (o_custkey // 2) || '.' || (o_custkey % 2) AS src, pnode || '.' || version AS dst FROM o),
fork AS (SELECT (up // 2) || '.' || (up % 2) AS src, pnode || '.' || version AS dst FROM c WHERE k >= 10),
ver AS (SELECT pnode || '.' || (version - 1) AS src, pnode || '.' || version AS dst FROM known WHERE version >= 1)
SELECT src, dst, CASE min(k) WHEN 1 THEN 'INPUT' WHEN 2 THEN 'FORKPARENT' WHEN 3 THEN 'VERSION' END AS type
FROM (SELECT *, 1 AS k FROM inp UNION ALL SELECT *, 2 FROM fork UNION ALL SELECT *, 3 FROM ver) GROUP BY src, dst""",
    "db_arguments": "SELECT c_custkey // 2 AS pnode, c_custkey % 2 AS version, a.n_name || ' ' || b.n_name AS argv FROM customer JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = c_custkey % 25",
    "db_tokens": "SELECT CAST(n_nationkey AS BIGINT) AS tok, n_name AS str FROM nation",
    "db_ancestry": f"WITH {DB} SELECT * FROM anc",
    "db_dump": f"""WITH {DB}, h AS (SELECT lpad(lower(hex(child_pnode)), 16, '0') AS a, lpad(lower(hex(child_version)), 8, '0') AS b, lpad(lower(hex(parent_pnode)), 16, '0') AS c, lpad(lower(hex(parent_version)), 8, '0') AS d FROM anc)
SELECT {" || ".join(f"substr(a, {k}, 2)" for k in range(15, 0, -2))} || {" || ".join(f"substr(b, {k}, 2)" for k in range(7, 0, -2))} AS k, {" || ".join(f"substr(c, {k}, 2)" for k in range(15, 0, -2))} || {" || ".join(f"substr(d, {k}, 2)" for k in range(7, 0, -2))} AS v FROM h""",
    "graph_report": f"WITH {DB} SELECT k.pnode, k.version, a.attr AS key, a.value FROM known k LEFT JOIN attrs a ON a.pnode = k.pnode AND a.version = k.version",
    "audit_records": f"""WITH {LINES} SELECT event_id AS number, CAST(CASE kind WHEN 'exit' THEN 1 WHEN 'fork' THEN 2 WHEN 'read' THEN 72 WHEN 'write' THEN 75 ELSE 42 END AS INTEGER) AS event_id, sec, lpad(CAST(event_id % 1000 AS VARCHAR), 9, '0') AS frac,
CASE WHEN subject THEN CAST(pid AS VARCHAR) END AS pid, CASE WHEN subject THEN '4' END AS uid, CASE WHEN subject THEN '5' END AS gid, CASE WHEN subject THEN '2' END AS euid, CASE WHEN subject THEN '3' END AS egid, CASE WHEN subject THEN 'host' END AS machine_id,
CAST(k AS VARCHAR) AS return_value, CASE WHEN kind IN ('read', 'write') THEN '/tmp//x //f' || k WHEN kind = 'rename' THEN '/tmp//x //f' || k || ' //f' || (k + 1) ELSE '' END AS paths FROM r""",
    "audit_kinds": f"""WITH {LINES} SELECT event_id AS number, kind, CAST(pid AS VARCHAR) AS pid, CASE WHEN kind = 'fork' THEN CAST(k AS VARCHAR) END AS child, CASE WHEN kind = 'rename' THEN '//f' || k WHEN kind IN ('read', 'write') THEN '/tmp//x' END AS path,
CASE WHEN kind = 'rename' THEN '//f' || (k + 1) WHEN kind IN ('read', 'write') THEN '//f' || k END AS path2, sec AS time FROM r WHERE subject""",
    "rename_edges": f"WITH {LINES}, {RENAMES} SELECT src, dst, arg_max(type, (ts, event_id, sec, type)) AS type, arg_max(operation, (ts, event_id, sec, type)) FILTER (operation IS NOT NULL) AS operation, arg_max(sec, (ts, event_id, sec, type)) AS sec FROM rawe GROUP BY src, dst",
    "rename_nodes": f"WITH {LINES}, {RENAMES} SELECT DISTINCT file_id AS id, path, substr(path, 2) AS name, version FROM us",
    "exec_snapshots": """WITH x AS (SELECT event_id, ts, CAST(floor(epoch(ts)) AS BIGINT) AS sec, CAST(user_id AS VARCHAR) AS pid, CAST(user_id % 7 AS VARCHAR) AS ppid, '/bin/p' || json_extract_string(props, '$.k') AS cmd, (row_number() OVER (ORDER BY ts, event_id) - 1) // 100 AS batch FROM events WHERE event_type = 'purchase'),
b AS (SELECT batch, CASE WHEN count(*) < 100 THEN 4611686018427387904 ELSE max(sec) END AS end_ts FROM x GROUP BY batch)
SELECT CAST(x.batch AS INTEGER) AS batch, b.end_ts, pid, arg_max(ppid, (ts, event_id)) AS ppid, arg_max(cmd, (ts, event_id)) AS cmd FROM x JOIN b ON x.batch = b.batch GROUP BY x.batch, b.end_ts, pid""",
    "listed_processes": """WITH x AS (SELECT strftime(ts, '%Y%m%d') AS file, CAST(floor(epoch(ts)) AS BIGINT) AS end_ts, user_id, CAST(row_number() OVER (PARTITION BY strftime(ts, '%Y%m%d') ORDER BY ts, event_id) AS INTEGER) AS batch FROM events WHERE event_id % 50 = 0)
SELECT file, batch, end_ts, CAST(p AS VARCHAR) AS pid, '/bin/p' || (p % 9) AS cmd FROM (SELECT file, batch, end_ts, unnest([user_id, user_id + 1]) AS p FROM x)""",
    "label_lines": """SELECT CAST(event_id AS VARCHAR) AS id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, m.name, m.type FROM events JOIN (VALUES (0, '-', 'none'), (1, 'neptune', 'dos'), (2, 'ffb_clear2', 'u2r'), (3, 'warezclient', 'r2l'), (4, 'imap4', 'r2l'), (5, 'unheard', 'unknown')) AS m(k, name, type) ON event_id % 6 = m.k""",
    "label_choice": """WITH n AS (SELECT count(*) FILTER (event_id % 200 = 0) AS u, count(*) FILTER (event_id % 200 <> 0 AND event_id % 100 = 50) AS z FROM events) SELECT 'u2r' AS type, u AS n FROM n UNION ALL SELECT 'none', least(z, 2 * u) FROM n""",
    "parent_links": f"""WITH {AUDIT}, last AS (SELECT pid, max(incarnation) AS i FROM inc GROUP BY pid) SELECT 'p' || a.pid || '#' || a.i AS src, 'p' || b.pid || '#' || b.i AS dst, 'triggered by' AS type FROM last a JOIN last b ON b.pid = a.pid % 7""",
    "json_edges": f"WITH {KERNEL} SELECT e.src AS source, e.dst AS target, e.type, {COLOUR.format('a')} AS source_colour, {COLOUR.format('b')} AS target_colour FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst",
    "clean_listing": "SELECT event_id, CASE WHEN event_id % 5 = 1 THEN ' ' || event_type ELSE event_type END AS line FROM events WHERE event_id % 5 IN (1, 4)",
}
