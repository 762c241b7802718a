"""DuckDB SQL of the training-data queries that SQL can express on whole tables."""

_KEY = r"CASE WHEN regexp_matches({0}, '\S') THEN trim({0}, ' ') END"


def _key(c: str) -> str:
    return _KEY.format(c)


_SETS = f"""WITH r AS (SELECT {_key('id')} AS id, symbols AS v FROM proof_states UNION ALL SELECT {_key('theorem_id')}, key_symbols FROM theorem_enrichment),
t AS (SELECT DISTINCT id, trim(x, ' ') AS x FROM (SELECT id, unnest(v) AS x FROM r WHERE id IS NOT NULL) WHERE regexp_matches(x, '\\S')),
s AS (SELECT id, list_sort(list(x)) AS v FROM t GROUP BY id HAVING count(*) >= 5),
i AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS o FROM (SELECT id, unnest(v) AS x FROM s) a JOIN (SELECT id, unnest(v) AS x FROM s) b ON a.x = b.x AND a.id < b.id GROUP BY ALL),
p AS (SELECT id_a, id_b FROM i JOIN s a ON a.id = id_a JOIN s b ON b.id = id_b WHERE o >= 0.75 * (len(a.v) + len(b.v) - o))
"""

_GRAPH = f"""WITH RECURSIVE e AS (
 SELECT DISTINCT 't:' || {_key('id')} AS a, 'n:' || {_key('full_name')} AS b FROM theorems
 UNION SELECT DISTINCT 'p:' || {_key('id')}, 't:' || {_key('theorem_id')} FROM proof_states
 UNION SELECT DISTINCT 'p:' || {_key('id')}, 'n:' || {_key('full_name')} FROM proof_states
 UNION SELECT DISTINCT 't:' || {_key('theorem_id')}, 'n:' || {_key('full_name')} FROM proof_states WHERE {_key('id')} IS NULL),
u AS (SELECT a, b FROM e WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM e WHERE a IS NOT NULL AND b IS NOT NULL),
w(n, m) AS (SELECT a, a FROM u WHERE a LIKE 't:%' UNION SELECT u.b, w.m FROM w JOIN u ON u.a = w.n),
c AS (SELECT n, min(m) AS m FROM w WHERE n LIKE 't:%' GROUP BY n),
g AS (SELECT m FROM c GROUP BY m HAVING count(*) > 1)
SELECT substr(m, 3) AS group_id, substr(n, 3) AS theorem_id FROM c SEMI JOIN g USING (m)"""

_WS = r"[\s\x{1c}-\x{1f}\x{85}\pZ]+"


def _close(name: str, col: str) -> str:
    return f"""SELECT '{name}' AS table_name, e.id AS eval_id, t.id AS train_id FROM
 (SELECT ke, kt FROM (SELECT e.k AS ke, t.k AS kt, e.n AS ne, t.n AS nt, count(*) AS o FROM g_{name} e JOIN g_{name} t ON e.s = t.s AND e.ev AND t.tr GROUP BY ALL) WHERE o >= 0.75 * (ne + nt - o)) p
 JOIN m_{name} e ON e.k = ke AND e.side = 'eval' JOIN m_{name} t ON t.k = kt AND t.side = 'train' WHERE e.id != t.id"""


def _texts(name: str, col: str) -> str:
    return f"""m_{name} AS (SELECT DISTINCT id, k, side FROM (SELECT {_key('id')} AS id, trim(regexp_replace(lower({col}), '{_WS}', ' ', 'g'), ' ') AS k,
 CASE WHEN split = 'train' THEN 'train' WHEN split IN ('val', 'test') THEN 'eval' END AS side FROM {name}) WHERE id IS NOT NULL AND side IS NOT NULL AND length(k) >= 40),
d_{name} AS (SELECT k, bool_or(side = 'train') AS tr, bool_or(side = 'eval') AS ev FROM m_{name} GROUP BY k),
x_{name} AS (SELECT DISTINCT k, tr, ev, substr(k, i, 5) AS s FROM (SELECT *, unnest(range(1, length(k) - 3)) AS i FROM d_{name})),
g_{name} AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM x_{name})"""


_OVERLAPS = f"""WITH {_texts('proof_states', 'goal_text')}, {_texts('premises', 'code')},
nm AS (SELECT DISTINCT {_key('id')} AS id, regexp_replace(lower(full_name), '[^\\pL\\pN]', '', 'g') AS k, CASE WHEN split = 'train' THEN 'train' WHEN split IN ('val', 'test') THEN 'eval' END AS side FROM theorems),
o AS ({_close('proof_states', 'goal_text')} UNION ALL {_close('premises', 'code')}
 UNION ALL SELECT 'theorems', e.id, t.id FROM nm e JOIN nm t ON e.k = t.k AND e.side = 'eval' AND t.side = 'train' AND e.id != t.id WHERE e.k != '')
"""

ORACLE = {
    "p1_found": _SETS + "SELECT id_a, id_b FROM p",
    "p1_linked": _SETS
    + """, l AS (SELECT id, count(*) AS n FROM (SELECT id_a AS id FROM p UNION ALL SELECT id_b FROM p) GROUP BY id)
SELECT s.id, min(s.id) OVER (PARTITION BY s.v) AS class_id, coalesce(n, 0) AS n_links FROM s LEFT JOIN l USING (id)""",
    "p3_found": _GRAPH,
    "p5_found": _OVERLAPS + "SELECT DISTINCT table_name, least(eval_id, train_id) AS id_a, greatest(eval_id, train_id) AS id_b FROM o",
    "p5_report": _OVERLAPS
    + f""", f AS (SELECT {_key('id')} AS id, min(file_path) AS file_path FROM theorems GROUP BY 1),
 h AS (SELECT 'theorems' AS table_name, {_key('id')} AS id, split, file_path FROM theorems UNION ALL SELECT 'premises', {_key('id')}, split, file_path FROM premises
 UNION ALL SELECT 'proof_states', {_key('s.id')}, split, f.file_path FROM proof_states s LEFT JOIN f ON f.id = {_key('theorem_id')}),
 w AS (SELECT table_name, id, min(trim(split, ' ')) AS split, min(file_path) AS file_path FROM h WHERE trim(split, ' ') IN ('val', 'test') GROUP BY table_name, id),
 n AS (SELECT table_name, eval_id AS id, count(DISTINCT train_id) AS n FROM o GROUP BY table_name, eval_id)
SELECT table_name, split, file_path, count(*) AS n_records, CAST(sum(n) AS bigint) AS n_pairs FROM n JOIN w USING (table_name, id) GROUP BY table_name, split, file_path""",
    "p3_checks": f"""SELECT 'groups in several splits' AS name, CAST(0 AS bigint) AS n UNION ALL SELECT 'ids without split', 0 UNION ALL SELECT 'splits off target', 0
 UNION ALL SELECT 'proof states', count(DISTINCT {_key('id')}) FROM proof_states UNION ALL SELECT 'edges', count(*) FROM positive_edges""",
    "p6_pairs": f"""WITH e AS (SELECT DISTINCT {_key('proof_state_id')} AS s, {_key('premise_id')} AS p FROM positive_edges),
k AS (SELECT * FROM e WHERE s IS NOT NULL AND p IS NOT NULL), d AS (SELECT p, count(*) AS n FROM k GROUP BY p), t AS (SELECT count(DISTINCT s) AS n FROM k),
c AS (SELECT a.p AS premise_a, b.p AS premise_b, count(*) AS n_both FROM k a JOIN k b ON a.s = b.s AND a.p < b.p GROUP BY ALL HAVING count(*) >= 5)
SELECT premise_a, premise_b, n_both, x.n AS n_a, y.n AS n_b, t.n AS n_baskets, round(n_both * t.n / (x.n * y.n), 6) AS lift
FROM c JOIN d x ON x.p = premise_a JOIN d y ON y.p = premise_b CROSS JOIN t WHERE n_both * t.n >= 10 * x.n * y.n""",
}
ORACLE["p6_found"] = f"SELECT premise_a, premise_b FROM ({ORACLE['p6_pairs']})"
