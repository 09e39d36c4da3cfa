"""Ridge and elastic net in SQL, from sums of products: elimination and coordinate descent as recursive queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from annoframe.functions import constants as C
from annoframe.operators import features
from annoframe.plans.base import r
from annoframe.plans.feature_sets import CONTEXT_SQL, SITE_SQL, _n_of
from annoframe.plans.samples import PRELUDE

SETS = {
    "sequence": [f"aa_{a}" for a in C.LETTERS],
    "position": features.feature_names("position_only"),
    "site": features.feature_names("site_only"),
    "context": features.feature_names("context_only"),
}
BIG_SETS = {
    **SETS,
    "site_context": features.feature_names("site_context_only"),
    "all": [*SETS["sequence"], *features.feature_names("site_context_only")],
}
COLUMNS = BIG_SETS["all"]


def rows(columns: Sequence[str]) -> str:
    """z: every sample's (1, columns, label) as a list."""
    letters = ", ".join(r(f"{_n_of(a)} * 1.0 / length(s)", f"aa_{a}") for a in C.LETTERS)
    return f"""{PRELUDE},
site_rows AS ({SITE_SQL}), context_rows AS ({CONTEXT_SQL}),
letter_rows AS (SELECT id, {letters} FROM (SELECT id, upper(seq) AS s FROM o)),
z AS (SELECT o.id, o.cust, o.yr, [CAST(1.0 AS DOUBLE), {", ".join(columns)}, label] AS z
      FROM o JOIN site_rows USING (id) JOIN context_rows USING (id) JOIN letter_rows USING (id))"""


def sums(source: str, by: str) -> str:
    """gm: for each group of ``source`` (g, z), the sums of products of positions i and j (0: the constant)."""
    return f"""
flat AS (SELECT {by} AS g, id, unnest(z) AS x, generate_subscripts(z, 1) - 1 AS i FROM {source}),
upper_part AS (SELECT a.g, a.i, b.i AS j, sum(a.x * b.x) AS v FROM flat a JOIN flat b ON a.id = b.id AND a.i <= b.i GROUP BY ALL),
gm AS (SELECT g, i, j, v FROM upper_part UNION ALL SELECT g, j, i, v FROM upper_part WHERE i < j)"""


def systems(columns: Sequence[str], feature_sets: Mapping[str, Sequence[str]]) -> str:
    at = {c: i + 1 for i, c in enumerate(columns)}
    places = ", ".join(f"('{name}', [{', '.join(str(at[c]) for c in part)}])" for name, part in feature_sets.items())
    y = len(columns) + 1
    return f"""
sets(model, idx) AS (VALUES {places}),
n AS (SELECT g, v AS n FROM gm WHERE i = 0 AND j = 0),
mu AS (SELECT g, i, v / n AS mu FROM gm JOIN n USING (g) WHERE j = 0 AND i > 0),
cv AS (SELECT gm.g, gm.i, gm.j, v - n * a.mu * b.mu AS c, v FROM gm JOIN n USING (g)
       JOIN mu a ON a.g = gm.g AND a.i = gm.i JOIN mu b ON b.g = gm.g AND b.i = gm.j),
sd AS (SELECT g, i, c / n <= 1e-12 * greatest(v / n, 1e-300) AS flat, CASE WHEN c / n <= 1e-12 * greatest(v / n, 1e-300) THEN 1.0 ELSE sqrt(c / n) END AS sd
       FROM cv JOIN n USING (g) WHERE i = j AND i < {y}),
xx AS (SELECT cv.g, cv.i, cv.j, CASE WHEN a.flat OR b.flat THEN 0.0 ELSE c / (a.sd * b.sd) END AS x FROM cv
       JOIN sd a ON a.g = cv.g AND a.i = cv.i JOIN sd b ON b.g = cv.g AND b.i = cv.j),
xy AS (SELECT cv.g, cv.i, CASE WHEN flat THEN 0.0 ELSE c / sd END AS x FROM cv JOIN sd ON sd.g = cv.g AND sd.i = cv.i WHERE cv.j = {y}),
k AS (SELECT model, unnest(idx) AS i, generate_subscripts(idx, 1) AS k FROM sets)"""


_FIT = """
fit AS (SELECT s.g, s.model, any_value(idx) AS idx, [any_value(ym.mu) - sum(w * mu.mu)] || list(w ORDER BY s.k) AS b
        FROM scaled s JOIN mu ON mu.g = s.g AND mu.i = s.i JOIN mu ym ON ym.g = s.g AND ym.i = {y} JOIN sets ON sets.model = s.model
        GROUP BY s.g, s.model)"""


def ridge_fits(columns: Sequence[str], feature_sets: Mapping[str, Sequence[str]], alpha: float = 1.0) -> str:
    """fit: (g, model, idx, b) by Gauss-Jordan elimination of every group's and set's system."""
    return f"""{systems(columns, feature_sets)},
eq AS (SELECT a.g, ka.model, ka.k, ka.i, list(x + CASE WHEN ka.k = kb.k THEN {alpha} ELSE 0 END ORDER BY kb.k) AS r
       FROM xx a JOIN k ka ON ka.i = a.i JOIN k kb ON kb.model = ka.model AND kb.i = a.j GROUP BY ALL),
gj(step, g, model, k, r) AS (
  SELECT 0, g, model, k, list_append(r, x) FROM eq JOIN xy USING (g, i)
  UNION ALL
  SELECT e.step + 1, e.g, e.model, e.k, CASE WHEN e.k = e.step + 1 THEN list_transform(e.r, lambda v: v / e.r[e.step + 1])
    ELSE list_transform(e.r, lambda v, j: v - e.r[e.step + 1] * p.r[j] / p.r[e.step + 1]) END
  FROM gj e JOIN gj p ON p.g IS NOT DISTINCT FROM e.g AND p.model = e.model AND p.k = e.step + 1 WHERE e.step + 1 < len(e.r)),
scaled AS (SELECT gj.g, gj.model, gj.k, k.i, r[-1] / sd AS w FROM gj JOIN k ON k.model = gj.model AND k.k = gj.k
           JOIN sd ON sd.g = gj.g AND sd.i = k.i WHERE step + 1 = len(r)),
{_FIT.format(y=len(columns) + 1)}"""


def elastic_net_fits(columns: Sequence[str], alpha: float = 1.0, l1_ratio: float = 0.5, sweeps: int = 400) -> str:
    """fit: as ``ridge_fits`` for all columns together, by coordinate descent, one coordinate in each step of the recursion."""
    d = len(columns)
    thrust, shrink = alpha * l1_ratio, alpha * (1 - l1_ratio)
    return f"""{systems(columns, {"all": columns})},
m AS (SELECT a.g, list(r ORDER BY i) AS a, list(q ORDER BY i) AS q FROM (
        SELECT xx.g, xx.i, list(x / n ORDER BY j) AS r FROM xx JOIN n USING (g) GROUP BY ALL) a
      JOIN (SELECT xy.g, xy.i, x / n AS q FROM xy JOIN n USING (g)) USING (g, i) GROUP BY a.g),
cd(step, g, j, w, f) AS (
  SELECT 0, g, 1, list_transform(q, lambda v: 0.0::DOUBLE), list_transform(q, lambda v: 0.0::DOUBLE) FROM m
  UNION ALL
  SELECT step + 1, g, j % {d} + 1, list_transform(w, lambda v, i: CASE WHEN i = j THEN new ELSE v END),
    list_transform(f, lambda v, i: v + a[j][i] * (new - w[j]))
  FROM (SELECT cd.*, m.a, CASE WHEN a[j][j] + {shrink} > 0 THEN sign(rest) * greatest(abs(rest) - {thrust}, 0) / (a[j][j] + {shrink}) ELSE 0.0 END AS new
        FROM (SELECT cd.*, m.q[cd.j] - cd.f[cd.j] + m.a[cd.j][cd.j] * cd.w[cd.j] AS rest FROM cd JOIN m USING (g)) cd JOIN m USING (g))
  WHERE step < {d * sweeps}),
scaled AS (SELECT c.g, 'all' AS model, k.k, k.i, w[k.k] / sd AS w FROM cd c, k JOIN sd ON sd.i = k.i WHERE step = {d * sweeps} AND sd.g = c.g),
{_FIT.format(y=d + 1)}"""


#: The prediction of a row (z) by a fit (idx, b).
VALUE = "list_dot_product([z[1]] || list_select(z, list_transform(idx, lambda i: i + 1)), b)"
