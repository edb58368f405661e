"""SQL for the LASSO with a few regressors: of all patterns of signs, the one whose solution meets the optimality conditions."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from .common import sig_sql
from .regression_sql import sweep

STEPS = 100


def moments(name: str, src: str, y: str, x: Sequence[str], key: str = "0", group: str = "") -> str:
    """CTE of one row per key: mean products ``a`` and ``c`` of the x over their population sds, the sds, and the raw products of (x, y)."""
    k = range(len(x))
    a = "[" + ", ".join("[" + ", ".join(f"avg({x[i]} * {x[j]}) / stddev_pop({x[i]}) / stddev_pop({x[j]})" for j in k) + "]" for i in k) + "]"
    c = "[" + ", ".join(f"avg({x[i]} * {y}) / stddev_pop({x[i]})" for i in k) + "]"
    sd = "[" + ", ".join(f"stddev_pop({x[i]})" for i in k) + "]"
    cols = [*x, y]
    raw = "[" + ", ".join("[" + ", ".join(f"avg({p} * {q})" for q in cols) + "]" for p in cols) + "]"
    return f"{name} AS MATERIALIZED (SELECT {key} AS key, CAST(count(*) AS DOUBLE) AS n, {a} AS a, {c} AS c, {sd} AS sd, {raw} AS raw FROM {src} {group})"


def lambdas(name: str, total: str) -> str:
    """CTE of (step, lam): the path of the total's moments."""
    return f"{name} AS MATERIALIZED (SELECT i + 1 AS step, list_max([abs(v) for v in c]) * exp(ln(0.0001) * i / {STEPS - 1}.0) AS lam FROM {total}, (SELECT unnest(range({STEPS})) AS i))"


def solutions(name: str, of: str, path: str, k: int) -> list[str]:
    """CTEs ending in (key, step, lam, b): the coefficients on the scaled x for each row of moments and each lambda."""
    span = range(1, k + 1)
    patterns = ", ".join(f"([{', '.join(map(str, s))}])" for s in itertools.product((-1, 0, 1), repeat=k))
    swept = f"(SELECT key, s, [list_concat(a[i], [c[i]]) for i in range(1, {k + 1})] || [list_concat(c, [0.0])] AS m0, a, c FROM {of}, {name}_s)"
    swept = f"(SELECT key, s, a, c, m0 AS m, [CASE WHEN s[i] <> 0 THEN 0.0 ELSE 1e300 END for i in range(1, {k + 1})] AS ref FROM {swept})"
    for i in span:
        swept = f"(SELECT key, s, a, c, ref, {sweep(i, k + 1)} AS m FROM {swept})"
    b = f"[CASE WHEN s[i] = 0 THEN 0.0 ELSE m[i][{k + 1}] - lam * list_sum([m[i][j] * s[j] for j in range(1, {k + 1})]) END for i in range(1, {k + 1})]"
    slope = f"[c[i] - list_sum([a[i][j] * b[j] for j in range(1, {k + 1})]) for i in range(1, {k + 1})]"
    fits = f"list_bool_and([CASE WHEN s[i] = 0 THEN abs(g[i]) <= lam * (1 + 1e-9) ELSE b[i] * s[i] > 0 END for i in range(1, {k + 1})])"
    return [
        f"{name}_s AS (SELECT * FROM (VALUES {patterns}) v(s))",
        f"{name}_m AS MATERIALIZED (SELECT * FROM {swept})",
        f"{name}_b AS MATERIALIZED (SELECT *, {b} AS b FROM {name}_m, {path})",
        f"{name} AS MATERIALIZED (SELECT key, step, lam, b FROM (SELECT *, {slope} AS g FROM {name}_b) WHERE {fits} "
        f"QUALIFY row_number() OVER (PARTITION BY key, step ORDER BY list_sum([abs(v) for v in s])) = 1)",
    ]


def path_rows(name: str, total: str, x: Sequence[str], digits: int = 5, zero: str = "1e-6") -> str:
    """SELECT of (step, lambda, term, estimate)."""
    terms = ", ".join(f"'{t}'" for t in x)
    rows = f"(SELECT step, lam, unnest([{terms}]) AS term, unnest([b[i] / sd[i] for i in range(1, {len(x) + 1})]) AS b FROM {name} JOIN {total} USING (key))"
    return f"SELECT CAST(step AS INTEGER) AS step, {sig_sql('lam', 6)} AS lambda, term, {sig_sql('b', digits, zero)} AS estimate FROM {rows}"


def path_sql(before: Sequence[str], src: str, y: str, x: Sequence[str], digits: int = 5, zero: str = "1e-6") -> str:
    ctes = [*before, moments("tot", src, y, x), lambdas("path", "tot"), *solutions("sol", "tot", "path", len(x))]
    return "WITH " + ", ".join(ctes) + " " + path_rows("sol", "tot", x, digits, zero)


def selected_sql(before: Sequence[str], src: str, y: str, x: Sequence[str], folds: int, digits: int = 5, zero: str = "1e-6") -> str:
    """The rows of ``LassoCV.selected``; ``src`` has a column ``fold``."""
    k = len(x)
    coef = f"[b[i] / sd[i] for i in range(1, {k + 1})]"
    error = (
        f"raw[{k + 1}][{k + 1}] - 2 * list_sum([d[i] * raw[i][{k + 1}] for i in range(1, {k + 1})]) "
        f"+ list_sum([list_sum([d[i] * raw[i][j] * d[j] for j in range(1, {k + 1})]) for i in range(1, {k + 1})])"
    )
    ctes = [
        *before,
        moments("tot", src, y, x), lambdas("path", "tot"), *solutions("sol", "tot", "path", k),
        f"fs AS (SELECT DISTINCT fold AS f FROM {src})",
        moments("train", f"{src} JOIN fs ON fold <> f", y, x, "f", "GROUP BY f"),
        moments("test", src, y, x, "fold", "GROUP BY fold"),
        *solutions("part", "train", "path", k),
        f"es AS (SELECT step, lam, t.n, {error} AS e FROM (SELECT key, step, lam, {coef} AS d FROM part JOIN train USING (key)) JOIN test t USING (key))",
        "cv AS (SELECT step, lam, m, sqrt(sum(n * pow(e - m, 2)) / sum(n) / (count(*) - 1)) AS s FROM (SELECT *, sum(n * e) OVER (PARTITION BY step) / sum(n) OVER (PARTITION BY step) AS m FROM es) GROUP BY step, lam, m)",
        "best AS (SELECT step, lam, m + s AS bar FROM cv ORDER BY m, step LIMIT 1)",
        "one AS (SELECT cv.step, cv.lam FROM cv, best WHERE m <= bar ORDER BY cv.step LIMIT 1)",
        f"pick AS (SELECT one.lam AS l1, best.lam AS l0, [p.b[i] / sd[i] for i in range(1, {k + 1})] AS b1, [q.b[i] / sd[i] for i in range(1, {k + 1})] AS b0 "
        "FROM one, best, tot, sol p, sol q WHERE p.step = one.step AND q.step = best.step)",
        f"u AS (SELECT unnest([{', '.join(f'{chr(39)}{t}{chr(39)}' for t in x)}]) AS term, l1, unnest(b1) AS b1, l0, unnest(b0) AS b0 FROM pick)",
    ]
    return (
        "WITH " + ", ".join(ctes) + f" SELECT term, {sig_sql('l1', 6)} AS lambda_1se, {sig_sql('b1', digits, zero)} AS estimate, CAST(b1 <> 0 AS INTEGER) AS selected, "
        f"{sig_sql('l0', 6)} AS lambda_min, {sig_sql('b0', digits, zero)} AS estimate_min FROM u"
    )


def standardized(name: str, src: str, y: str, x: Sequence[str], keep: Sequence[str]) -> str:
    """CTE of complete rows as ``lasso.standardize`` makes them."""
    present = " AND ".join(f"{c} IS NOT NULL" for c in (y, *x))
    cols = [f"{y} - avg({y}) OVER () AS {y}", *[f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}" for c in x]]
    return f"{name} AS MATERIALIZED (SELECT {', '.join([*keep, *cols])} FROM {src} WHERE {present})"
