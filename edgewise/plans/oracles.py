"""SQL with the same results as the core's queries."""

from __future__ import annotations

BLANKS = "E' \\t\\r\\n'"


def _clean(column: str) -> str:
    name = f"upper(trim({column}, {BLANKS}))"
    return f"CASE WHEN {name} NOT IN ('', 'N/A') THEN {name} END"


_SIDES = f"SELECT 'from' AS side, {_clean('\"from\"')} AS node FROM edges UNION ALL SELECT 'to', {_clean('\"to\"')} FROM edges"


def _groups(rows: str, columns: str, first: bool) -> str:
    """Group numbers of ``rows`` (k, pos, f, t, others): by first appearance in
    the order of pos, or by the smallest name. k is the graph."""
    place = "min(2 * pos + slot)" if first else "min(node)"
    return f"""
WITH RECURSIVE rows_in AS ({rows}),
e AS (SELECT DISTINCT k, f, t FROM rows_in WHERE f IS NOT NULL AND t IS NOT NULL),
both_ways AS (SELECT k, f, t FROM e UNION SELECT k, t, f FROM e),
labels(k, node, label) USING KEY (k, node) AS (
  SELECT k, f, f FROM both_ways GROUP BY k, f
  UNION
  SELECT b.k, b.t, min(l.label) FROM labels AS l JOIN both_ways AS b ON b.k = l.k AND b.f = l.node JOIN recurring.labels AS known ON known.k = b.k AND known.node = b.t
  WHERE l.label < known.label GROUP BY b.k, b.t
),
seen AS (SELECT k, f AS node, pos, 0 AS slot FROM rows_in WHERE f IS NOT NULL AND t IS NOT NULL UNION ALL SELECT k, t, pos, 1 FROM rows_in WHERE f IS NOT NULL AND t IS NOT NULL),
roots AS (SELECT k, label, {place} AS place FROM labels JOIN seen USING (k, node) GROUP BY k, label),
numbers AS (SELECT k, label, row_number() OVER (PARTITION BY k ORDER BY place) AS n FROM roots)
SELECT {columns}, coalesce(n, 0) AS "group" FROM rows_in r LEFT JOIN labels l ON l.k = r.k AND l.node = r.f LEFT JOIN numbers u ON u.k = l.k AND u.label = l.label"""


_EDGES = 'SELECT 0 AS k, pos, "from" AS f, "to" AS t, value, weight FROM edges'


def _page_rank(table: str, iterations: int, threshold: float, tail: str, key: str = "0") -> str:
    """Scores (k, node, r, i), where ``key`` gives the graph k of a row."""
    return f"""
WITH RECURSIVE e AS (SELECT {key} AS k, "from" AS f, "to" AS t FROM {table} WHERE "from" IS NOT NULL AND "to" IS NOT NULL),
nodes AS (SELECT k, f AS node FROM e UNION SELECT k, t FROM e),
n AS (SELECT k, count(*) AS n FROM nodes GROUP BY k),
deg AS (SELECT k, f, count(*) AS deg FROM e GROUP BY k, f),
links AS (SELECT e.k, e.f, e.t, count(*) AS mult, any_value(deg) AS deg FROM e JOIN deg USING (k, f) GROUP BY e.k, e.f, e.t),
pr(i, k, node, r, moved) AS (
  SELECT 0, k, node, 1.0::DOUBLE / n, 1e9::DOUBLE FROM nodes JOIN n USING (k)
  UNION ALL
  SELECT i + 1, k, node, fresh, sum(abs(fresh - r)) OVER (PARTITION BY k) FROM (
    SELECT p.i, p.k, p.node, p.r, (1.0::DOUBLE - 0.85::DOUBLE) / n.n + 0.85::DOUBLE * coalesce(g.got, 0) AS fresh
    FROM pr p JOIN n ON n.k = p.k LEFT JOIN (SELECT l.k, l.t AS node, sum(q.r / l.deg * l.mult) AS got FROM pr q JOIN links l ON l.k = q.k AND l.f = q.node GROUP BY l.k, l.t) g ON g.k = p.k AND g.node = p.node
    WHERE p.i < {iterations} AND p.moved >= {threshold}::DOUBLE)
),
last AS (SELECT pr.* FROM pr JOIN (SELECT k, max(i) AS i FROM pr GROUP BY k) m ON m.k = pr.k AND m.i = pr.i)
{tail}"""


def _paths(directed: bool, key: str = "0", columns: str = "") -> str:
    back = "" if directed else "UNION ALL SELECT k, t, s, w FROM raw"
    return f"""
WITH RECURSIVE raw AS (SELECT {key} AS k, "from" AS s, "to" AS t, CAST(trunc(weight * 1000) AS BIGINT) AS w FROM routes WHERE "from" IS NOT NULL AND "to" IS NOT NULL AND weight IS NOT NULL),
e AS (SELECT k, s, t, min(w) AS w FROM (SELECT k, s, t, w FROM raw {back}) WHERE s <> t GROUP BY k, s, t),
d(k, s, t, c) USING KEY (k, s, t) AS (
  SELECT k, s, t, w FROM e
  UNION
  SELECT k, s, t, c FROM (SELECT d.k, d.s, e.t, min(d.c + e.w) AS c FROM d JOIN e ON e.k = d.k AND e.s = d.t WHERE d.s <> e.t GROUP BY d.k, d.s, e.t) x
  WHERE NOT EXISTS (SELECT 1 FROM recurring.d y WHERE y.k = x.k AND y.s = x.s AND y.t = x.t AND y.c <= x.c)
)
SELECT {columns} s AS "from", t AS "to", c / 1000.0::DOUBLE AS distance FROM d {"" if directed else "WHERE s < t"}"""


def _betweenness(directed: bool, normalized: bool, key: str = "0", columns: str = "") -> str:
    back = "" if directed else "UNION ALL SELECT k, t, s FROM raw"
    scale = "CASE WHEN n <= 2 THEN 'nan'::DOUBLE ELSE 1.0::DOUBLE / ((n - 1) * (n - 2)) END" if normalized else ("1.0::DOUBLE" if directed else "0.5::DOUBLE")
    return f"""
WITH RECURSIVE raw AS (SELECT {key} AS k, "from" AS s, "to" AS t FROM routes WHERE "from" IS NOT NULL AND "to" IS NOT NULL),
nodes AS (SELECT k, s AS node FROM raw UNION SELECT k, t FROM raw), n AS (SELECT k, count(*)::DOUBLE AS n FROM nodes GROUP BY k),
m AS (SELECT k, s, t, count(*)::DOUBLE AS c FROM (SELECT k, s, t FROM raw {back}) WHERE s <> t GROUP BY k, s, t),
walk(k, s, t, d, c) USING KEY (k, s, t) AS (
  SELECT k, node, node, 0, 1.0::DOUBLE FROM nodes
  UNION
  SELECT k, s, t, d, c FROM (SELECT w.k, w.s, m.t, w.d + 1 AS d, sum(w.c * m.c) AS c FROM walk w JOIN m ON m.k = w.k AND m.s = w.t GROUP BY w.k, w.s, m.t, w.d) x
  WHERE NOT EXISTS (SELECT 1 FROM recurring.walk y WHERE y.k = x.k AND y.s = x.s AND y.t = x.t)
),
b AS (SELECT sv.k, sv.t AS node, sum(sv.c * vt.c / st.c) AS part FROM walk sv JOIN walk vt ON vt.k = sv.k AND vt.s = sv.t JOIN walk st ON st.k = sv.k AND st.s = sv.s AND st.t = vt.t
  WHERE sv.s <> sv.t AND vt.s <> vt.t AND st.s <> st.t AND sv.d + vt.d = st.d GROUP BY sv.k, sv.t)
SELECT {columns} node, round(coalesce(part, 0) * {scale}, 9) AS centrality FROM nodes JOIN n USING (k) LEFT JOIN b USING (k, node)"""


def _rules(rows: str, support: float, confidence: float, cap: int, weighted: bool, columns: str, key: str = "0") -> str:
    """``rows`` gives t, item, f and place, by which items are numbered, and
    the columns of ``key``, which gives the set of transactions k of a row."""
    value = "total" if weighted else "cnt"
    score = "a.f * c.f / a.support" if weighted else "a.cnt / a.n"
    return f"""
WITH RECURSIVE r AS (SELECT {key} AS k, t, item, f, place FROM ({rows})),
n AS (SELECT k, count(DISTINCT t)::DOUBLE AS n FROM r GROUP BY k),
sized AS (SELECT *, count(*) OVER (PARTITION BY k, t) AS size FROM r),
per AS (SELECT k, item, count(*)::DOUBLE AS cnt, sum(f) AS total, min(place) AS place FROM r GROUP BY k, item),
valid AS (SELECT k, item, cnt, n, {value} AS support, row_number() OVER (ORDER BY k, place) AS id FROM per JOIN n USING (k) WHERE NOT isnan({value}) AND {value} > 0 AND {value} / n >= {support}::DOUBLE),
x AS (SELECT s.t, s.f, v.* FROM sized s JOIN valid v ON v.k = s.k AND v.item = s.item WHERE size <= {cap}),
ent AS (SELECT * FROM (SELECT a.id, c.id AS c_id, c.item AS consequent, {score} AS conf, a.t FROM x a JOIN x c ON a.k = c.k AND a.t = c.t AND a.id <> c.id) WHERE NOT isnan(conf) AND conf >= {confidence}::DOUBLE),
lift AS (SELECT id, sum(conf) AS lift FROM ent GROUP BY id),
links AS (SELECT DISTINCT id, c_id FROM ent),
reach(id, root) USING KEY (id) AS (
  SELECT id, id FROM valid
  UNION
  SELECT l.c_id, min(h.root) FROM reach h JOIN links l ON l.id = h.id JOIN recurring.reach y ON y.id = l.c_id WHERE h.root < y.root GROUP BY l.c_id
),
pat AS (SELECT id, dense_rank() OVER (PARTITION BY k ORDER BY root) AS pattern FROM reach JOIN valid USING (id)),
tops AS (SELECT id, string_agg(consequent, '|' ORDER BY rk) AS consequents, string_agg(printf('%.9f', round(conf, 9)), '|' ORDER BY rk) AS confidence_scores
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY conf DESC, consequent, t) AS rk FROM ent) WHERE rk <= 5 GROUP BY id)
SELECT {columns} FROM valid v JOIN pat USING (id) LEFT JOIN lift USING (id) LEFT JOIN tops USING (id)"""


_LISTS = "item, round(support, 6) AS support, round(coalesce(lift, 0), {digits}) AS lift_score, pattern, coalesce(consequents, '') AS consequents, coalesce(confidence_scores, '') AS confidence_scores"
_RULES = _LISTS.format(digits=9)
_TRANSACTIONS = "SELECT transaction_id AS t, item_id AS item, {f} AS f, {place} AS place, ingested_at FROM transactions WHERE t IS NOT NULL AND item IS NOT NULL AND f IS NOT NULL"
_MONTH = "strftime(ingested_at, '%Y-%m')"
_LONG = "coalesce(weight >= 5, false)"

ORACLES: dict[str, str] = {
    "p3_found": f"WITH s AS (SELECT * FROM ({_SIDES}) WHERE node IS NOT NULL), n AS (SELECT side, count(*) AS total FROM s GROUP BY side), c AS (SELECT side, node, count(*) AS n FROM s GROUP BY side, node) SELECT side, node FROM c JOIN n USING (side) WHERE c.n * 50 >= total",
    "p3_counts": f"SELECT node, count(*) FILTER (side = 'from') AS n_from, count(*) FILTER (side = 'to') AS n_to FROM ({_SIDES}) WHERE node IS NOT NULL GROUP BY node",
    "edges_graph_solver": _groups(_EDGES, "pos", False),
    "edges_super_merger": _groups(_EDGES, "pos, value", True),
    "edges_super_merger_weighted": _groups(f"SELECT * FROM ({_EDGES}) WHERE weight >= 0.7::DOUBLE", "pos", True),
    "edges_super_merger_by_day": _groups('SELECT seen_at::DATE AS k, pos, "from" AS f, "to" AS t FROM edges', "pos, r.k AS day", True),
    "routes_page_rank": _page_rank("routes", 100, 1e-6, 'SELECT a."from", a."to", a.weight, round(CASE WHEN l.r IS NULL THEN 0 ELSE l.r END, 9) AS pagerank FROM routes a LEFT JOIN last l ON l.node = a."from"'),
    "routes_page_rank_nodes": _page_rank("routes", 100, 1e-6, "SELECT node, round(r, 9) AS score, i AS iterations FROM last"),
    "edges_page_rank_nodes": _page_rank("edges", 10, 0.0, "SELECT node, round(r, 9) AS score, i AS iterations FROM last"),
    "edges_page_rank_converged": _page_rank("edges", 100, 1e-6, "SELECT node, round(r, 9) AS score, i AS iterations FROM last"),
    "edges_page_rank_tables": _page_rank("edges", 100, 1e-6, "SELECT node, round(r, 9) AS score, i AS iterations FROM last"),
    "edges_page_rank_by_month": _page_rank("edges", 100, 1e-6, "SELECT k AS month, node, round(r, 9) AS score, i AS iterations FROM last", "strftime(loaded_at, '%Y-%m')"),
    "routes_page_rank_by_length": _page_rank("routes", 100, 1e-6, "SELECT k AS long, node, round(r, 9) AS score, i AS iterations FROM last", _LONG),
    "routes_paths_undirected_tables": _paths(False),
    "routes_paths_directed_tables": _paths(True),
    "routes_paths_by_length": _paths(True, _LONG, "k AS long,"),
    "routes_betweenness_undirected_tables": _betweenness(False, True),
    "routes_betweenness_directed_tables": _betweenness(True, True),
    "routes_betweenness_by_length": _betweenness(False, True, _LONG, "k AS long,"),
    "routes_paths_undirected": _paths(False),
    "routes_paths_directed": _paths(True),
    "routes_betweenness_undirected": _betweenness(False, True),
    "routes_betweenness_directed": _betweenness(True, True),
    "routes_betweenness_raw": _betweenness(True, False),
    "transactions_rules": _rules(_TRANSACTIONS.format(f="1.0::DOUBLE", place="item_id"), 0.005, 0.005, 50, False, _RULES),
    "transactions_rules_defaults": _rules(_TRANSACTIONS.format(f="1.0::DOUBLE", place="item_id"), 0.01, 0.1, 50, False, _RULES),
    "transactions_rules_weighted": _rules(_TRANSACTIONS.format(f="frequency", place="pos") + " AND NOT isnan(f)", 0.005, 0.005, 50, True, _RULES),
    "transactions_rules_weighted_all": _rules(_TRANSACTIONS.format(f="frequency", place="pos"), 0.0001, 0.005, 50, True, _RULES),
    "transactions_rules_by_month": _rules(_TRANSACTIONS.format(f="frequency", place="pos") + " AND NOT isnan(f)", 0.005, 0.005, 50, True, "k AS month, " + _RULES, _MONTH),
    "lineitem_rules_capped": _rules("SELECT l_orderkey AS t, l_suppkey::VARCHAR AS item, 1.0::DOUBLE AS f, l_suppkey::VARCHAR AS place FROM lineitem", 0.0001, 0.0001, 8, False, _LISTS.format(digits=6)),
}
