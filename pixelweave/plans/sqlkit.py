"""Catalog of queries with their SQL twins, and the SQL text of the derived tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from ..session import measured_joins

# The derived tables in SQL, in the order they build on each other.
FIXTURE_SQL = {
    "rects": """
SELECT image_id, CAST(k + 1 AS INTEGER) AS id, CAST(1 + (k * 7) % 5 AS INTEGER) AS cls, pk,
       (k % 5) * 12 + 1 + sz % 3 AS x0, CAST(floor(k / 5) AS INTEGER) * 16 + 1 + sz % 4 AS y0,
       4 + sz % 5 AS w, 6 + CAST(pk % 7 AS INTEGER) AS h, sz % 4 - 1 AS dx, CAST(pk % 3 AS INTEGER) - 1 AS dy
FROM (SELECT p_partkey AS pk, CAST(p_partkey % n AS INTEGER) AS image_id, CAST(floor(p_partkey / n) AS INTEGER) AS k,
             p_size AS sz FROM part CROSS JOIN (SELECT count(*) AS n FROM supplier) c) i""",
    "ri": "SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS i",
    "rj": "SELECT CAST(unnest(range(0, 12)) AS INTEGER) AS j",
    "r64": "SELECT CAST(unnest(range(0, 64)) AS INTEGER) AS v",
    "pixels": """
SELECT coalesce(g.image_id, p.image_id) AS image_id, coalesce(g.y, p.y) AS y, coalesce(g.x, p.x) AS x,
       coalesce(true_id, 0) AS true_id, coalesce(true_cls, 0) AS true_cls,
       coalesce(pred_id, 0) AS pred_id, coalesce(pred_cls, 0) AS pred_cls
FROM (SELECT image_id, y0 + j AS y, x0 + i AS x, id AS true_id, cls AS true_cls
      FROM rects CROSS JOIN ri CROSS JOIN rj WHERE i < w AND j < h) g
FULL OUTER JOIN
     (SELECT image_id, y, x, max(pred_id) AS pred_id, max(pred_cls) AS pred_cls FROM
        (SELECT image_id, y0 + dy + j AS y, x0 + dx + i AS x,
                CASE WHEN pk % 17 = 0 THEN id + 1 ELSE id END AS pred_id,
                CASE WHEN pk % 19 = 0 THEN 1 + cls % 5 ELSE cls END AS pred_cls
         FROM rects CROSS JOIN ri CROSS JOIN rj WHERE i < w AND j < h AND pk % 11 <> 0) q
      WHERE y BETWEEN 0 AND 63 AND x BETWEEN 0 AND 63 GROUP BY image_id, y, x) p
ON g.image_id = p.image_id AND g.y = p.y AND g.x = p.x""",
    "truth": "SELECT image_id, y, x, true_id AS inst_id, true_cls AS type_id FROM pixels WHERE true_id > 0",
    "pred": "SELECT image_id, y, x, pred_id AS inst_id, pred_cls AS type_id FROM pixels WHERE pred_id > 0",
    "image_pixels": """
SELECT m.image_id, m.y, m.x,
       (m.x * 3 + m.y * 5 + m.image_id * 7 + CASE WHEN s.true_id > 0 THEN 60 ELSE 0 END) % 256 AS r,
       (m.x * 11 + m.y + m.image_id) % 256 AS g, (m.x + m.y * 13) % 256 AS b,
       CAST(50 + CASE WHEN s.pred_id > 0 THEN 30 ELSE -30 END + (m.x * 31 + m.y * 17 + m.image_id * 7) % 21 - 10 AS DOUBLE)
         / CAST(100 AS DOUBLE) AS prob,
       coalesce(s.true_id, 0) AS true_id, coalesce(s.true_cls, 0) AS true_cls, coalesce(s.pred_id, 0) AS pred_id,
       coalesce(s.pred_cls, 0) AS pred_cls
FROM (SELECT CAST(s_suppkey AS INTEGER) AS image_id, a.v AS y, b.v AS x FROM supplier CROSS JOIN r64 a CROSS JOIN r64 b) m
LEFT JOIN pixels s ON m.image_id = s.image_id AND m.y = s.y AND m.x = s.x""",
    "chan": """
SELECT image_id, y, x, CAST(c AS INTEGER) AS channel, CAST(CASE c WHEN 0 THEN r WHEN 1 THEN g ELSE b END AS SMALLINT) AS v
FROM image_pixels CROSS JOIN (SELECT unnest(range(0, 3)) AS c) u""",
    "tiles": """
SELECT concat('slide_x-', CAST(x AS VARCHAR), '_y-', CAST(y AS VARCHAR), '.json') AS name, x, y
FROM (SELECT (i % 10) * 64 AS x, CAST(floor(i / 10) AS INTEGER) * 64 AS y
      FROM (SELECT CAST(s_suppkey AS INTEGER) AS i FROM supplier) s) t""",
    "annotations": """
SELECT concat('slide_x-', CAST((image_id % 10) * 64 AS VARCHAR), '_y-', CAST(CAST(floor(image_id / 10) AS INTEGER) * 64 AS VARCHAR), '.json') AS name,
       id AS feature_id, cls AS class_id, (image_id % 10) * 64 AS tx, CAST(floor(image_id / 10) AS INTEGER) * 64 AS ty,
       (image_id % 10) * 64 + CASE WHEN id % 5 = 1 AND pk % 3 <> 2 THEN 0 ELSE x0 END AS xmin,
       CAST(floor(image_id / 10) AS INTEGER) * 64 + CASE WHEN id <= 5 AND pk % 3 <> 1 THEN 0 ELSE y0 END AS ymin,
       (image_id % 10) * 64 + CASE WHEN id % 5 = 0 AND pk % 2 = 0 THEN 64 ELSE x0 + w END AS xmax,
       CAST(floor(image_id / 10) AS INTEGER) * 64 + CASE WHEN id > 15 AND pk % 2 = 1 THEN 64 ELSE y0 + h END AS ymax
FROM rects""",
    "logits": "SELECT vec_id, CAST(vec_id % 10 AS INTEGER) AS sample, label % 6 AS target, ["
              + ", ".join("(" + " + ".join(f"CAST(embedding[{j}] AS DOUBLE)" for j in range(8 * c + 1, 8 * c + 9)) + ")"
                          for c in range(6)) + "] AS scores FROM embeddings",
    "lg": "SELECT vec_id, sample, target, CAST(c AS INTEGER) AS c, scores[c + 1] AS s FROM logits CROSS JOIN "
          "(SELECT unnest(range(0, 6)) AS c) u",
    "sm": "SELECT *, exp(s - mx) / sum(exp(s - mx)) OVER (PARTITION BY vec_id) AS p, CASE WHEN c = target THEN 1 ELSE 0 END AS hot "
          "FROM (SELECT *, max(s) OVER (PARTITION BY vec_id) AS mx FROM lg) q",
    # score building blocks: joint counts, areas, overlapping pairs
    "joint": "SELECT image_id, true_id AS t, pred_id AS p, count(*) AS n FROM pixels GROUP BY image_id, true_id, pred_id",
    "tarea": "SELECT image_id, true_id AS t, count(*) AS ta FROM pixels WHERE true_id > 0 GROUP BY image_id, true_id",
    "parea": "SELECT image_id, pred_id AS p, count(*) AS pa FROM pixels WHERE pred_id > 0 GROUP BY image_id, pred_id",
    "ov": "SELECT j.image_id, j.t, j.p, n AS i, ta, pa, ta + pa - n AS u FROM joint j JOIN tarea ON tarea.image_id = j.image_id "
          "AND tarea.t = j.t JOIN parea ON parea.image_id = j.image_id AND parea.p = j.p",
}


def sql(body: str, **ctes: str) -> str:
    """Put the derived tables a query names in front of it; `ctes` are further tables, in order."""
    tail = " ".join([*ctes.values(), body])
    if body.strip().upper().startswith("WITH "):
        own = body.strip()[5:]
        lead = ", "
    else:
        own, lead = body, " "
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in FIXTURE_SQL:
            if name not in needed and name not in ctes and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(FIXTURE_SQL[name])

    visit(tail)
    parts = [f"{n} AS ({q.strip()})" for n, q in FIXTURE_SQL.items() if n in needed]
    parts += [f"{n} AS ({q.strip()})" if not q.strip().startswith("@") else q.strip()[1:] for n, q in ctes.items()]
    if not parts:
        return body
    return "WITH RECURSIVE " + ",\n".join(parts) + lead + own


def components_sql(p: str, src: str, keys: str = "image_id", value: str = "", diagonal: bool = False) -> str:
    """CTE texts that label connected pixels of `src` by runs and reachability; result `p`(src.*, root_y, root_x)."""
    kv = [k.strip() for k in (keys + ("," + value if value else "")).split(",")]
    ks = ", ".join(kv)
    on = " AND ".join(f"a.{k} = b.{k}" for k in kv)
    d = 1 if diagonal else 0
    return f"""{p}_runs AS (SELECT {ks}, y, min(x) AS x0, max(x) AS x1, y * 100000 + min(x) AS node FROM
  (SELECT {ks}, y, x, x - row_number() OVER (PARTITION BY {ks}, y ORDER BY x) AS grp FROM {src}) q GROUP BY {ks}, y, grp),
{p}_edges AS (SELECT {", ".join("a." + k for k in kv)}, a.node AS a, b.node AS b FROM {p}_runs a JOIN {p}_runs b ON {on}
  AND b.y IN (a.y - 1, a.y + 1) AND a.x0 <= b.x1 + {d} AND b.x0 <= a.x1 + {d}),
{p}_reach AS (SELECT {ks}, node, node AS root FROM {p}_runs UNION
  SELECT {", ".join("a." + k for k in kv)}, b.b AS node, a.root FROM {p}_reach a JOIN {p}_edges b ON {on} AND a.node = b.a WHERE a.root < b.b),
{p}_root AS (SELECT {ks}, node, min(root) AS root FROM {p}_reach GROUP BY {ks}, node),
{p} AS (SELECT b.*, c.root, CAST(c.root // 100000 AS INTEGER) AS root_y, CAST(c.root % 100000 AS INTEGER) AS root_x
  FROM {src} b JOIN {p}_runs a ON {on} AND a.y = b.y AND b.x BETWEEN a.x0 AND a.x1
  JOIN {p}_root c ON {on.replace("b.", "c.")} AND c.node = a.node)"""


class Catalog:
    """Named queries, each with its SQL twin when one exists. Their joins are planned by measured sizes."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, fn: Callable, twin: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query {name} is registered twice")

        def query(spark, sf_dir: str):
            measured_joins(spark)
            return fn(spark, sf_dir)

        self.queries[name] = query
        if twin is not None:
            self.oracle[name] = twin


def rounded(df, digits: int = 6, keep=()):
    """Round every double column, so that both engines print the same digits."""
    from pyspark.sql import functions as F
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") and c not in keep else F.col(c)
                       for c, t in df.dtypes])
