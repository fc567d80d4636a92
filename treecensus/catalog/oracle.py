"""SQL views that derive the same inventory tables in another engine."""

from __future__ import annotations

import re

from treecensus.catalog.data import ATTRIBUTE_STEPS, SNAPSHOTS

_ATTRIBUTES = ",\n  ".join(
    f"CASE WHEN k % 29 <> 0 THEN k % {step} = 0 END AS attr_{name}" for name, step in ATTRIBUTE_STEPS.items())
_SNAPSHOT_ROWS = ", ".join(f"({i}, TIMESTAMP '{t} 00:00:00', '{n}', '{s}')" for i, t, n, s in SNAPSHOTS)

VIEWS = {
    "fx_shipped": "SELECT l_orderkey, max(l_shipdate) AS m FROM lineitem GROUP BY l_orderkey",
    "fx_base": """
SELECT o_orderkey AS k, c_custkey, c_name, c_nationkey, c_mktsegment, r_name,
  'order_' || o_orderkey || CASE WHEN o_orderkey % 50 = 0 THEN ''
    WHEN left(o_orderpriority, 1) = '1' THEN '.log' WHEN left(o_orderpriority, 1) = '2' THEN '.tmp'
    WHEN left(o_orderpriority, 1) = '3' THEN '.py' WHEN left(o_orderpriority, 1) = '4' THEN '.pdf'
    ELSE '.docx' END AS name,
  '/' || r_name || '/' || n_name || '/' || c_mktsegment || '/cust_' || c_custkey AS parent,
  CAST(round(o_totalprice * 100) AS BIGINT) AS size,
  o_orderdate AS creation_time, coalesce(m, o_orderdate) AS modification_time
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey LEFT JOIN fx_shipped ON o_orderkey = l_orderkey""",
    "fx_files": f"""
SELECT k, c_custkey, c_name, c_nationkey, c_mktsegment, r_name, name, parent, parent || '/' || name AS path,
  CASE WHEN k % 50 = 0 THEN 'FS_FILE_TYPE_SYMLINK' ELSE 'FS_FILE_TYPE_FILE' END AS type,
  CAST(k AS VARCHAR) AS id, size,
  CASE WHEN k % 13 = 0 THEN NULL WHEN k % 10 = 0 THEN 1 ELSE CAST(ceil(size / 4096.0) AS BIGINT) END AS datablocks,
  CASE WHEN k % 13 <> 0 THEN 1 END AS metablocks,
  CAST(c_custkey AS VARCHAR) AS owner, 'g' || c_nationkey AS grp,
  CASE c_custkey % 5 WHEN 0 THEN 'NFS_UID' WHEN 1 THEN 'NFS_GID' WHEN 2 THEN 'SMB_SID' WHEN 3 THEN 'LOCAL_USER' END
    AS owner_type,
  CASE c_custkey % 5 WHEN 0 THEN CAST(c_custkey + 10000 AS VARCHAR) WHEN 1 THEN CAST(c_custkey + 20000 AS VARCHAR)
    WHEN 2 THEN 'S-1-5-21-' || c_custkey WHEN 3 THEN c_name END AS owner_id,
  creation_time, modification_time,
  CAST(CAST(modification_time AS DATE) + CAST(k % 400 AS INTEGER) AS TIMESTAMP) AS access_time,
  CAST(CAST(modification_time AS DATE) + CAST(k % 30 AS INTEGER) AS TIMESTAMP) AS change_time,
  {_ATTRIBUTES},
  CASE WHEN k % 100 = 0 THEN '../cust_' || c_custkey || '/order_' || (k + 1)
    WHEN k % 50 = 0 THEN '/' || r_name || '/order_' || (k + 1) END AS symlink_target,
  CASE WHEN k % 13 = 0 THEN size WHEN k % 10 = 0 THEN 8192
    ELSE (CAST(ceil(size / 4096.0) AS BIGINT) + 1) * 4096 END AS capacity
FROM fx_base""",
    # every ancestor of a file, once per file and level
    "fx_up": """
SELECT f.path AS file, f.type, f.owner, f.size, f.capacity, f.creation_time, f.modification_time, u.i AS depth,
  array_to_string(string_split(f.path, '/')[1:u.i + 1], '/') AS path
FROM fx_files f, LATERAL (SELECT unnest(range(1, len(string_split(f.path, '/')) - 1)) AS i) u""",
    "fx_dirs": """
SELECT d.path, d.depth, 'FS_FILE_TYPE_DIRECTORY' AS type, 'd:' || d.path AS id, CAST(0 AS BIGINT) AS size,
  'root' AS owner, 'g0' AS grp, d.creation_time, d.modification_time, CAST(4096 AS BIGINT) AS capacity,
  CASE WHEN d.depth = 1 THEN '/' ELSE regexp_replace(d.path, '/[^/]*$', '') END AS parent,
  regexp_extract(d.path, '[^/]*$') AS name,
  coalesce(f.n, 0) + coalesce(s.n, 0) + CASE WHEN length(d.path) % 9 = 0 THEN 1 ELSE 0 END AS child_count,
  coalesce(f.n, 0) + coalesce(s.n, 0) AS found
FROM (SELECT path, depth, min(creation_time) AS creation_time, max(modification_time) AS modification_time
      FROM fx_up GROUP BY path, depth) d
LEFT JOIN (SELECT parent, count(*) AS n FROM fx_files GROUP BY parent) f ON f.parent = d.path
LEFT JOIN (SELECT regexp_replace(path, '/[^/]*$', '') AS up, count(*) AS n
           FROM (SELECT DISTINCT path FROM fx_up) GROUP BY 1) s ON s.up = d.path""",
    "fx_entries": """
SELECT path, type, id, size, owner, grp, name, parent, creation_time, modification_time, access_time, capacity,
  CAST(NULL AS BIGINT) AS child_count FROM fx_files
UNION ALL SELECT path, type, id, size, owner, grp, name, parent, creation_time, modification_time,
  modification_time, capacity, child_count FROM fx_dirs""",
    # every ancestor of an entry, the root included
    "fx_entry_up": """
SELECT e.path AS entry, e.type, e.owner, e.capacity, e.modification_time, u.i AS depth,
  CASE WHEN u.i = 0 THEN '/' ELSE array_to_string(string_split(e.path, '/')[1:u.i + 1], '/') END AS path
FROM fx_entries e, LATERAL (SELECT unnest(range(0, len(string_split(e.path, '/')) - 1)) AS i) u""",
    "fx_snapshots": f"SELECT * FROM (VALUES {_SNAPSHOT_ROWS}) AS t(id, ts, name, source)",
    "fx_snap": """
SELECT s.id AS snapshot_id, s.ts, f.path, f.type, f.id, f.owner, f.k,
  f.size + CASE WHEN f.modification_time <= s.ts THEN 4096 ELSE 0 END AS size, f.creation_time,
  CASE WHEN f.modification_time <= s.ts THEN f.modification_time ELSE f.creation_time END AS modification_time
FROM fx_files f, fx_snapshots s
WHERE f.creation_time <= s.ts AND (f.k % 6 <> 0 OR s.ts < CAST(CAST(f.modification_time AS DATE) + 200 AS TIMESTAMP))
  AND (s.source = '/' OR starts_with(f.path, s.source || '/'))""",
    "fx_snap_dirs": """
SELECT DISTINCT f.snapshot_id, array_to_string(string_split(f.path, '/')[1:u.i + 1], '/') AS path, u.i AS depth
FROM fx_snap f, LATERAL (SELECT unnest(range(1, len(string_split(f.path, '/')) - 1)) AS i) u""",
    # raw diff of snapshots 2 and 4, one row per object
    "fx_diff": """
SELECT CASE WHEN a.path IS NULL THEN 'CREATE' WHEN b.path IS NULL THEN 'DELETE' ELSE 'MODIFY' END AS op,
  coalesce(a.path, b.path) AS path, false AS dir
FROM (SELECT * FROM fx_snap WHERE snapshot_id = 2) a FULL JOIN (SELECT * FROM fx_snap WHERE snapshot_id = 4) b
  ON a.path = b.path
WHERE a.path IS NULL OR b.path IS NULL OR a.size <> b.size
UNION ALL
SELECT CASE WHEN a.path IS NULL THEN 'CREATE' ELSE 'DELETE' END, coalesce(a.path, b.path), true
FROM (SELECT * FROM fx_snap_dirs WHERE snapshot_id = 2) a
  FULL JOIN (SELECT * FROM fx_snap_dirs WHERE snapshot_id = 4) b ON a.path = b.path
WHERE a.path IS NULL OR b.path IS NULL""",
    "fx_diff_collapsed": """
SELECT op, path || CASE WHEN dir THEN '/' ELSE '' END AS path FROM fx_diff d
WHERE NOT EXISTS (SELECT 1 FROM fx_diff p WHERE p.dir AND p.op = d.op
  AND p.path = regexp_replace(d.path, '/[^/]*$', ''))""",
    "fx_identities": """
SELECT CAST(c_custkey AS VARCHAR) AS auth_id, c_custkey AS k,
  CASE c_custkey % 4 WHEN 0 THEN 'ACTIVE_DIRECTORY' WHEN 1 THEN 'LOCAL' WHEN 2 THEN 'POSIX_USER'
    ELSE 'POSIX_GROUP' END AS domain,
  CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS name,
  CASE WHEN c_custkey % 4 = 2 THEN c_custkey + 10000 END AS uid,
  CASE WHEN c_custkey % 4 = 3 THEN c_custkey + 20000 END AS gid,
  CAST(c_custkey + 3 AS VARCHAR) AS nfs_id
FROM customer""",
    "fx_shown": """
SELECT auth_id, domain, CASE
  WHEN domain = 'POSIX_USER' THEN CASE WHEN name IS NULL THEN 'UID ' || uid ELSE name || ' (UID ' || uid || ')' END
  WHEN domain = 'POSIX_GROUP' THEN CASE WHEN name IS NULL THEN 'GID ' || gid ELSE name || ' (GID ' || gid || ')' END
  ELSE coalesce(name, 'Unknown') END AS shown
FROM fx_identities""",
    "fx_equivalents": """
SELECT a.auth_id, b.auth_id AS other_id, CAST(b.k - a.k AS INTEGER) AS position
FROM fx_identities a JOIN fx_identities b ON b.k IN (a.k + 1, a.k + 2)""",
    "fx_ranked": """
SELECT e.auth_id, e.position, i.name, i.domain,
  CASE i.domain WHEN 'ACTIVE_DIRECTORY' THEN 0 WHEN 'LOCAL' THEN 1 ELSE 2 END AS rank
FROM fx_equivalents e JOIN fx_identities i ON i.auth_id = e.other_id WHERE i.name IS NOT NULL""",
    "fx_owner_map": """
SELECT CAST(c_custkey AS VARCHAR) AS source, CAST(c_custkey + 1 AS VARCHAR) AS target
FROM customer WHERE c_custkey % 10 = 0""",
    "fx_group_map": """
SELECT 'g' || n_nationkey AS source, 'g' || (n_nationkey + 1) AS target FROM nation WHERE n_nationkey % 2 = 0""",
    "fx_aces": """
SELECT path, k, 0 AS pos, 'Allow' AS type, owner AS trustee, '' AS flags, 'rwaxdDtTnNcCoy' AS rights, false AS inh
  FROM fx_files
UNION ALL SELECT path, k, 1, 'Allow', grp, 'fd', 'rx', k % 2 = 0 FROM fx_files
UNION ALL SELECT path, k, 2, 'Allow', 'Everyone', '', 'rw', k % 14 = 0 FROM fx_files WHERE k % 7 = 0
UNION ALL SELECT path, k, 3, 'Deny', 'Everyone', '', 'w', false FROM fx_files WHERE k % 11 = 0""",
    "fx_tags": """
SELECT path, k, CASE k % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS reviewed,
  CASE WHEN k % 3 = 0 THEN c_mktsegment END AS project FROM fx_files""",
    "fx_archive": """
SELECT '/archive/' || name AS path, size + CASE WHEN k % 18 = 0 THEN 0 ELSE 1 END AS size, modification_time,
  'FS_FILE_TYPE_FILE' AS type
FROM fx_files WHERE k % 9 = 0""",
    "fx_live": """
SELECT path, type, size, modification_time FROM fx_entries
UNION ALL SELECT path, type, size, modification_time FROM fx_archive""",
    "fx_content": """
SELECT '/docs/' || lang || '/' || source || '/doc_' || doc_id || '.txt' AS path, CAST(doc_id AS VARCHAR) AS id,
  n_chars AS size, CAST(ceil(n_chars / 4096.0) AS BIGINT) AS datablocks, text AS content,
  CASE WHEN doc_id % 5 = 0 THEN left(text, n_chars // 2)
    WHEN doc_id % 3 = 0 AND n_chars > 100 THEN left(text, 100) || '#' || substring(text, 102)
    ELSE text END AS content_old
FROM documents""",
    "fx_changes": """
SELECT event_id AS seq, ts, CASE WHEN event_type IN ('signup', 'purchase') THEN 'CREATE'
    WHEN event_type IN ('click', 'view') THEN 'MODIFY' ELSE 'DELETE' END AS op,
  '/u/' || user_id || '/' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 10) AS path
FROM events""",
}


def with_views(sql: str) -> str:
    """A self-contained statement: the views it uses, in order, then the text itself."""
    needed: set[str] = set()
    work = set(re.findall(r"\bfx_\w+", sql))
    while work:
        name = work.pop()
        if name in VIEWS and name not in needed:
            needed.add(name)
            work |= set(re.findall(r"\bfx_\w+", VIEWS[name]))
    if not needed:
        return sql.strip()
    body = sql.strip()
    listed = [f"{name} AS ({VIEWS[name].strip()})" for name in VIEWS if name in needed]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(listed) + ",\n" + body[5:]
    return "WITH " + ",\n".join(listed) + "\n" + body
