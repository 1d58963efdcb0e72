"""Queries over runs of several predictors."""

from __future__ import annotations

from ..operators import metrics
from ..session import checkpointed
from . import baselines
from .queries import TREE, query, topo

_SAID = """,
prior AS (SELECT count(*) FILTER (WHERE type = 2) * 1.0 / count(*) AS v2, count(*) FILTER (WHERE type = 3) * 1.0 / count(*) AS v3, count(*) FILTER (WHERE type = 4) * 1.0 / count(*) AS v4 FROM topo WHERE type <> 1),
sub AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY r, seq) AS a, row_number() OVER (PARTITION BY cell_id ORDER BY h DESC, seq) AS h1 FROM (SELECT u.cell_id, u.primary_root, avg(u.radius) AS r, max(u.dz) AS h, max(q.seq) AS seq FROM topo u JOIN topo q ON q.cell_id = u.cell_id AND q.id = u.primary_root GROUP BY 1, 2) x),
drawn AS (SELECT t.*, v2, v3, v4, CAST(CAST('0x' || substr(md5('42:' || t.cell_id || ':' || t.id), 1, 8) AS BIGINT) AS DOUBLE) / 4294967295.0 * (v2 + v3 + CASE WHEN cell_type = 'pyramidal' THEN v4 ELSE 0 END) AS u FROM topo t CROSS JOIN prior),
said AS (
  SELECT 'random' AS method, cell_id, type, CASE WHEN id = proxy THEN 1 WHEN u < v2 THEN 2 WHEN u < v2 + v3 OR cell_type <> 'pyramidal' THEN 3 ELSE 4 END AS pred FROM drawn
  UNION ALL SELECT 'majority', cell_id, type, CASE WHEN id = proxy THEN 1 WHEN v2 >= v3 AND (v2 >= v4 OR cell_type <> 'pyramidal') THEN 2 WHEN v3 >= v4 OR cell_type <> 'pyramidal' THEN 3 ELSE 4 END FROM drawn
  UNION ALL SELECT 'heuristic', t.cell_id, t.type, CASE WHEN t.id = t.proxy THEN 1 WHEN s.a = 1 THEN 2 WHEN s.h1 = 1 AND t.cell_type = 'pyramidal' AND s.h > 5 THEN 4 ELSE 3 END FROM topo t LEFT JOIN sub s ON s.cell_id = t.cell_id AND s.primary_root = t.primary_root
  UNION ALL SELECT 'plug_in', cell_id, type, CASE WHEN id = 1 THEN 1 ELSE 2 + id % 3 END FROM topo),
each AS (SELECT method, cell_id, label, count(*) FILTER (WHERE type = label) AS support, count(*) FILTER (WHERE pred = label) AS predicted, count(*) FILTER (WHERE type = label AND pred = label) AS tp FROM said CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS label) l GROUP BY 1, 2, 3)
"""


@query("baseline_rows", "method:s cell_id:l n_nodes:l accuracy:d neurite_macro_f1:d macro_f1:d error:s", """SELECT method, cell_id, n_nodes, CASE WHEN ok THEN accuracy END AS accuracy, CASE WHEN ok THEN neurite END AS neurite_macro_f1, CASE WHEN ok THEN macro END AS macro_f1, CASE WHEN NOT ok THEN 'ValueError: cell ' || cell_id END AS error FROM (
  SELECT method, cell_id, sum(support) AS n_nodes, sum(tp) * 1.0 / sum(support) AS accuracy, coalesce(avg(2.0 * tp / (support + predicted)) FILTER (WHERE support > 0 AND label <> 1), 0) AS neurite, avg(2.0 * tp / (support + predicted)) FILTER (WHERE support > 0) AS macro, method <> 'plug_in' OR cell_id % 10 <> 0 AS ok FROM each GROUP BY 1, 2) q""", TREE + _SAID)
def _(spark, sf):
    """Random, majority, heuristic and a plug-in that fails at some cells, in one run."""

    def plug_in(cell):
        if cell["cell_id"].iloc[0] % 10 == 0:
            raise ValueError(f"cell {cell['cell_id'].iloc[0]}")
        return [1 if i == 1 else 2 + i % 3 for i in cell["id"]]

    t = topo(spark, sf)
    methods = baselines.standard(checkpointed(metrics.prior(t)))
    methods = {n: methods[n] for n in ("random", "majority", "heuristic")} | {"plug_in": baselines.per_cell(plug_in)}
    return baselines.run(t, methods)
