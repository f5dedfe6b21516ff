"""SQL that gives the same rows, where SQL can express the operator."""

from __future__ import annotations

_TERMS = """WITH r AS (SELECT ann_id, seq_name, nullif(regexp_replace(trim(ele), '_$', ''), '') AS ele, nullif(replace(trim(ele_class), '?', ''), '') AS ele_class FROM rm_out WHERE ann_id IS NOT NULL),
t AS (SELECT 'ele' AS field_name, ele AS term, ann_id, seq_name FROM r WHERE ele IS NOT NULL UNION ALL SELECT 'ele_class', ele_class, ann_id, seq_name FROM r WHERE ele_class IS NOT NULL),
c AS (SELECT field_name, term, count(DISTINCT ann_id) AS n_records, count(DISTINCT seq_name) AS n_homes FROM t GROUP BY ALL)"""

_CLEAN = "translate(upper(regexp_replace(chrseq, '\\s', '', 'g')), 'MYHRSKVDBW', 'CCCGGGGGGT')"
_WORDS = f"""s AS (SELECT seq_id, {_CLEAN} AS q FROM sequences WHERE chrseq IS NOT NULL),
k AS (SELECT DISTINCT seq_id, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS w FROM (SELECT seq_id, unnest(list_transform(range(1, length(q) - 9), lambda i: substr(q, i, 11))) AS w FROM s WHERE length(q) >= 11)
  WHERE regexp_full_match(w, '[ACGT]{{11}}')),
n AS (SELECT seq_id, count(*) AS c FROM k GROUP BY 1),
p AS (SELECT a.seq_id AS x, b.seq_id AS y, count(*) AS c FROM k a JOIN k b ON a.w = b.w AND a.seq_id < b.seq_id GROUP BY 1, 2)"""

SQL = {
    "p2_counts": f"{_TERMS} SELECT * FROM c",
    "p2_found": f"""{_TERMS} SELECT field_name, term, 'rare' AS mark FROM c WHERE n_records <= 2
UNION ALL SELECT field_name, term, 'common' FROM c WHERE n_homes * 100 > 60 * (SELECT count(DISTINCT seq_name) FROM rm_out)""",
    "p3_found": f"""WITH s AS (SELECT seq_id, {_CLEAN} AS q FROM sequences), o AS (SELECT seq_id, q FROM s WHERE length(q) > 8000),
m AS (SELECT seq_id, q, unnest(list_transform(range(1, length(q)), lambda i: CASE WHEN substr(q, i, 1) = 'N' AND substr(q, i + 1, 1) <> 'N' THEN i END)) AS z FROM o),
r AS (SELECT seq_id, z + 1 AS boundary_pos FROM m WHERE z >= 11 AND substr(q, z - 9, 10) = 'NNNNNNNNNN' AND rtrim(substr(q, 1, z), 'N') <> '')
SELECT seq_id, boundary_pos FROM r UNION ALL SELECT seq_id, 0 FROM o WHERE seq_id NOT IN (SELECT seq_id FROM r)""",
    "p5_found": f"""WITH {_WORDS} SELECT x AS seq_id_a, y AS seq_id_b FROM p JOIN n a ON a.seq_id = x JOIN n b ON b.seq_id = y WHERE p.c * 2 >= a.c + b.c - p.c""",
}
