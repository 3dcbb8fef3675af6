"""SQL with the same results, for those of the queries that SQL can express."""

from __future__ import annotations

from edgewise.plans.oracles import BLANKS, _clean


_GROUPS = f"""
e AS (SELECT DISTINCT f, t FROM (SELECT {_clean('"from"')} AS f, {_clean('"to"')} AS t FROM edges) WHERE f IS NOT NULL AND t IS NOT NULL),
both_ways AS (SELECT f, t FROM e UNION SELECT t, f FROM e),
labels(node, label) USING KEY (node) AS (
  SELECT f, f FROM both_ways GROUP BY f
  UNION
  SELECT b.t, min(l.label) FROM labels AS l JOIN both_ways AS b ON b.f = l.node JOIN recurring.labels AS known ON known.node = b.t
  WHERE l.label < known.label GROUP BY b.t
)"""

_ROWS = f"SELECT transaction_id AS b, {_clean('item_id')} AS item FROM transactions"

_BEST = f"""
SELECT item, consequent, max(score) AS score FROM (
  SELECT item, {_clean('c')} AS consequent, s AS score FROM (
    SELECT {_clean('item')} AS item, unnest(consequents) AS c, unnest(confidence_scores) AS s FROM association_rules))
WHERE item IS NOT NULL AND consequent IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)
GROUP BY item, consequent"""


def _top(n: int, columns: str) -> str:
    return f"""
WITH best AS ({_BEST}), ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, consequent) AS place FROM best)
SELECT {columns} FROM ranked WHERE place <= {n}"""


def _marks(rows: str, columns: str, where: str) -> str:
    return f"""
WITH r AS ({rows}), n AS (SELECT count(DISTINCT b) AS everything FROM r WHERE item IS NOT NULL),
c AS (SELECT item AS item_id, count(*) AS n_rows, count(DISTINCT b) AS n_baskets FROM r WHERE item IS NOT NULL GROUP BY item),
m AS (SELECT c.*, CASE WHEN n_baskets < 3 THEN 'rare' WHEN n_baskets * 20 > everything THEN 'common' END AS mark FROM c, n)
SELECT {columns} FROM m {where}"""


def _pairs(columns: str, common: int, lift: int) -> str:
    return f"""
WITH cells AS (SELECT DISTINCT b, item FROM ({_ROWS}) WHERE b IS NOT NULL AND item IS NOT NULL),
n AS (SELECT count(DISTINCT b)::HUGEINT AS n_all FROM cells),
m AS (SELECT item, count(*)::HUGEINT AS n FROM cells GROUP BY item),
p AS (SELECT x.item AS item_a, y.item AS item_b, count(*) AS common FROM cells x JOIN cells y ON x.b = y.b AND x.item < y.item GROUP BY ALL HAVING count(*) >= {common})
SELECT {columns} FROM p JOIN m a ON a.item = item_a JOIN m b ON b.item = item_b, n WHERE common * n_all >= {lift} * a.n * b.n"""


_SOURCE = f"nullif(lower(trim(source, {BLANKS})), '')"
_SHORT = f"""
WITH t AS (SELECT {_SOURCE} AS source, sum(target_share) AS share, max(max_repeats) AS cap FROM mix_targets GROUP BY ALL),
d AS (SELECT {_SOURCE} AS source, octet_length(encode(text)) + 1 AS size FROM documents WHERE text IS NOT NULL),
s AS (SELECT t.source, share, cap, coalesce(sum(size), 0)::BIGINT AS size, count(size) AS documents FROM t LEFT JOIN d USING (source) GROUP BY ALL)
SELECT {{columns}} FROM s"""
_IS_SHORT = "size * cap < share * (SELECT sum(size) FROM s)"

ORACLES: dict[str, str] = {
    "p1_found": f"WITH RECURSIVE {_GROUPS} SELECT node, label AS group_key FROM labels",
    "p1_group_sizes": f"WITH RECURSIVE {_GROUPS} SELECT label AS group_key, count(*) AS nodes FROM labels GROUP BY label",
    "p2_found": f"WITH r AS (SELECT item FROM ({_ROWS}) WHERE item IS NOT NULL) SELECT item AS item_id FROM r GROUP BY item HAVING count(*) * 200 >= (SELECT count(*) FROM r)",
    "p2_top_items": f"SELECT item AS item_id, count(*) AS n_rows FROM ({_ROWS}) WHERE item IS NOT NULL GROUP BY item ORDER BY n_rows DESC, item LIMIT 100",
    "p4_found": _top(5, "item, place, consequent"),
    "p4_best_scores": _top(10, "item, place, consequent, score"),
    "p5_found": _marks(_ROWS, "item_id, mark", "WHERE mark IS NOT NULL"),
    "p5_late_rows": _marks(f"{_ROWS} WHERE frequency IS NULL OR frequency >= 0", "*", ""),
    "p6_found": _pairs("item_a, item_b", 5, 5),
    "p6_lift": _pairs("item_a, item_b, common, round(common::DOUBLE * n_all::DOUBLE / (a.n::DOUBLE * b.n::DOUBLE), 6) AS lift", 8, 2),
    "p7_found": "SELECT doc_id FROM documents WHERE octet_length(encode(text)) + 1 > 8192",
    "p7_pieces": "SELECT doc_id, (octet_length(encode(text)) // 8192 + 1)::BIGINT AS pieces, (octet_length(encode(text)) + 1)::BIGINT AS tokens FROM documents WHERE text IS NOT NULL",
    "p7_use_holds": "SELECT sum(octet_length(encode(text)) + 1)::BIGINT AS tokens, true AS none_overfull, true AS nearly_least FROM documents WHERE text IS NOT NULL",
    "p9_makeup_holds": "SELECT subject, true AS quarter_at_least, true AS once, true AS half_of_labels, true AS four_at_most, true AS whole_at_most FROM subject_areas",
    "p8_found": _SHORT.format(columns="source") + f" WHERE {_IS_SHORT}",
    "p8_report_holds": _SHORT.format(columns=f"source, documents, size, {_IS_SHORT} AS short, true AS copies_hold, true AS cap_holds, true AS shares_hold"),
    "p8_rows_hold": _SHORT.format(columns="source, true AS report_holds, true AS cap_holds, true AS all_used"),
}
