"""SQL of the model suites: panels as CTEs, features, models, tests and tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from panelspark.functions.stats_dist import t_two_sided
from panelspark.models.spec import ModelSpec, label_of

from .common import sig_sql
from .regression_sql import fit_ctes, fit_rows, quoted, term_lists, terms_of, variance


def features(name: str, src: str, columns: Mapping[str, str], by: str, order: str) -> str:
    """CTE that adds columns, whose expressions may use the window ``o``."""
    cols = ", ".join(f'{e} AS "{c}"' for c, e in columns.items())
    return f"{name} AS MATERIALIZED (SELECT *, {cols} FROM {src} WINDOW o AS (PARTITION BY {by} ORDER BY {order}))"


def lag(c: str, k: int) -> str:
    return f'lag("{c}", {k}) OVER o' if k else f'"{c}"'


def panel_features(variables: Sequence[str], lags: int) -> dict[str, str]:
    """Differences, lags and lagged differences as the library's ``panel_features`` names them."""
    out = {}
    for v in variables:
        out[f"d_{v}"] = f"{lag(v, 0)} - {lag(v, 1)}"
        for k in range(1, lags + 1):
            out[f"{v}_m{k}"] = lag(v, k)
            out[f"d_{v}_m{k}"] = f"{lag(v, k)} - {lag(v, k + 1)}"
    return out


def alone(ctes: Sequence[str], parts: Sequence[str]) -> str:
    """Rows of the parts as a query that brings its CTEs along: chains of CTEs stay short, which keeps planning in proportion to the models."""
    return f"SELECT * FROM (WITH {', '.join(ctes)} {' UNION ALL '.join(parts)})"


def model_rows(src: str, specs: Sequence[ModelSpec], exprs: Mapping[str, str] | None = None, digits: int = 6, zero: str = "1e-9") -> list[str]:
    """A query of (model_id, term, estimate, std_error) for each model over the CTE ``src``."""
    out = []
    for spec in specs:
        made, tag = fit_ctes("m", src, spec, exprs)
        out.append(alone(made, [fit_rows(tag, spec, digits, zero)]))
    return out


def union(ctes: Sequence[str], parts: Sequence[str]) -> str:
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(parts)


def equality_ctes(src: str, y: str, measures: tuple[str, str], instrument: str, controls: Sequence[str], entity: str) -> tuple[list[str], str, ModelSpec]:
    """CTEs of the stacked model of two measures, as ``grid.equality_test`` has it."""
    stacked = " UNION ALL ".join(f"SELECT *, {i} AS number, {quoted(m)} AS both FROM {src}" for i, m in enumerate(measures, 1))
    exprs = {f"number={i}:{c}": f"CASE WHEN number = {i} THEN {quoted(c)} ELSE 0 END" for c in ("both", instrument, *controls) for i in (1, 2)}
    x = [f"number={i}:{c}" for c in controls for i in (1, 2)]
    both, z = ([f"number={i}:{c}" for i in (1, 2)] for c in ("both", instrument))
    spec = ModelSpec("stacked", y, x, both, z, entity=("number", entity), constant=False, vce="cluster", cluster=("number", entity))
    made, tag = fit_ctes("eq", "stacked", spec, exprs)
    return [f"stacked AS MATERIALIZED ({stacked})", *made], tag, spec


def equality_statistic(tag: str, spec: ModelSpec) -> str:
    """Wald statistic of equal first two coefficients."""
    (_, a), (_, b) = terms_of(spec)[:2]
    size = len(spec.regressors)
    gap = f"[f[{a}][i] - f[{b}][i] for i in range(1, {size + 1})]"
    return f"(SELECT pow(f[{a}][{size + 1}] - f[{b}][{size + 1}], 2) / (small * {variance('gap', str(size))}) FROM (SELECT *, {gap} AS gap FROM {tag}))"


def two_way(src: str, spec: ModelSpec, period: str, values: Sequence, digits: int = 6, zero: str = "1e-9") -> str:
    """Query of the rows of a model with entity effects and a dummy for each period; the first period is the base."""
    dummies = {f"{period}={v}": f"CASE WHEN {quoted(period)} = {v} THEN 1 ELSE 0 END" for v in values}
    wide = replace(spec, x=(*list(dummies)[1:], *spec.x))
    made, tag = fit_ctes("m", src, wide, dummies)
    return alone(made, [fit_rows(tag, wide, digits, zero, [*map(label_of, spec.regressors), "_cons"])])


def joint_statistic(tag: str, spec: ModelSpec, terms: Sequence[str]) -> str:
    """F form of the Wald test that one, two or three terms have no effect; the system is solved by its adjugate."""
    at = dict(terms_of(spec))
    size = len(spec.regressors) + (1 if spec.constant and not spec.entity else 0)
    i, q = [at[t] for t in terms], len(terms)
    cell = lambda a, b: f"list_sum([list_sum([f[{a}][x] * v[x][y] * f[{b}][y] for y in range(1, {size + 1})]) for x in range(1, {size + 1})])"
    names = {(r, c): f"w{min(r, c)}{max(r, c)}" for r in range(q) for c in range(q)}
    inner = ", ".join(f"small * {cell(i[r], i[c])} AS w{r}{c}" for r in range(q) for c in range(r, q)) + ", " + ", ".join(f"f[{k}][{size + 1}] AS b{j}" for j, k in enumerate(i))

    def minor(r: int, c: int) -> str:
        if q == 1:
            return "1.0"
        if q == 2:
            return names[1 - r, 1 - c] if r == c else f"-{names[1 - r, 1 - c]}"
        r1, r2, c1, c2 = (r + 1) % 3, (r + 2) % 3, (c + 1) % 3, (c + 2) % 3
        return f"({names[r1, c1]} * {names[r2, c2]} - {names[r1, c2]} * {names[r2, c1]})"

    form = " + ".join(f"b{r} * b{c} * {minor(r, c)}" for r in range(q) for c in range(q))
    det = " + ".join(f"{names[0, c]} * {minor(0, c)}" for c in range(q))
    return f"(SELECT ({form}) / ({det}) / {q} FROM (SELECT {inner} FROM {tag}))"


def f_rows(src: str, specs: Sequence[ModelSpec], term: str, exprs: Mapping[str, str] | None = None) -> list[str]:
    """A query of (model_id, f, df1, df2) of one term for each model; errors are clustered."""
    out = []
    for spec in specs:
        made, tag = fit_ctes("m", src, spec, exprs)
        out.append(alone(made, [f"SELECT '{spec.name}' AS model_id, round({joint_statistic(tag, spec, [term])}, 3) AS f, 1 AS df1, CAST(groups - 1 AS DOUBLE) AS df2 FROM {tag}"]))
    return out


def robust_iv_tests(src: str, spec: ModelSpec, exprs: Mapping[str, str], digits: int) -> str:
    """Query of (test, statistic) of the robust diagnostics of a model with a constant, one endogenous regressor and up to three instruments, at most
    one of them spare."""
    label, value = label_of, lambda t: exprs.get(label_of(t), quoted(label_of(t)))
    (w,), x, z = spec.endog, list(spec.x), list(spec.instruments)
    every = " AND ".join(f"({value(t)}) IS NOT NULL" for t in spec.columns)
    rows = f"q0 AS MATERIALIZED (SELECT * FROM {src} WHERE {every})"
    carry = {f"k{i}": value(t) for i, t in enumerate([spec.y, w, *x, *z])}
    raw = {label(t): f"k{i}" for i, t in enumerate([spec.y, w, *x, *z])}
    first = ModelSpec("first", label(w), [label(t) for t in (*z, *x)], vce=spec.vce)
    a, ta = fit_ctes("a", "q0", first, {label(t): value(t) for t in spec.columns}, carry)
    augmented = ModelSpec("augmented", label(spec.y), [*map(label, x), label(w), "v_hat"], vce=spec.vce)
    b, tb = fit_ctes("b", "a_u", augmented, raw | {"v_hat": "u"})
    out = [
        f"SELECT 'weak_instruments:{label(w)}' AS test, {sig(joint_statistic(ta, first, [label(t) for t in z]), digits)} AS statistic",
        f"SELECT 'endogeneity', {sig(joint_statistic(tb, augmented, ['v_hat']), digits)}",
    ]
    made = [rows, *a, *b]
    if len(z) > 1:
        c, _ = fit_ctes("c", "q0", replace(spec, roles={}), exprs, carry)
        spare = ModelSpec("spare", label(z[-1]), [*map(label, x), "w_hat"], vce=spec.vce)
        d, _ = fit_ctes("d", "c_u", spare, raw | {"w_hat": f"h{1 + len(x)}"}, {"u2": "u"})
        made += [*c, *d]
        out.append(f"SELECT 'overidentification_score', {sig('pow(sum(u * u2), 2) / sum(u * u * u2 * u2)', digits)} FROM d_u")
    return alone(made, out)


# -- tables ---------------------------------------------------------------------


def _critical(level: float, df: float) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > level else (low, mid)
    return high


MARKS = ((0.01, "***"), (0.05, "**"), (0.10, "*"))
CRITICAL = (
    "critical AS (SELECT * FROM (VALUES "
    + ", ".join(f"({df}, " + ", ".join(repr(_critical(level, df if df else 1e9)) for level, _ in MARKS) + ")" for df in range(0, 101))
    + ") c(df, c1, c2, c3))"
)


def _number(value: str, style: str) -> str:
    shape = f"format('{{:,.3f}}', {value})" if style == "f" else f"printf('%.3e', {value})"
    return f"regexp_replace({shape}, '^-', '--')"


def table_rows(src: str, specs: Sequence[ModelSpec], name: str, order: Sequence[str], style: str, labels: Mapping[str, str] | None = None) -> list[str]:
    """A query of (tab, row, label, model_id, cell) for each model of a coefficient table; ``order`` has the roles. Models are clustered, or two-stage."""
    queries = []
    mark = "CASE " + " ".join(f"WHEN abs(b / se) > c{j} THEN '{m}'" for j, (_, m) in enumerate(MARKS, 1)) + " ELSE '' END"
    for spec in specs:
        made, tag = fit_ctes("m", src, spec)
        found = [(order.index(r), r, b, se) for la, b, se in term_lists(spec) if (r := spec.roles.get(la, la)) in order]
        shown = labels or {}
        lists = [", ".join(x) for x in zip(*((str(at), f"'{shown.get(r, r)}'", b, se) for at, r, b, se in found))]
        df = "0" if spec.is_iv and spec.dof != "full" else "CAST(groups - 1 AS INTEGER)"
        made.append(f"t AS MATERIALIZED (SELECT unnest([{lists[0]}]) AS pos, unnest([{lists[1]}]) AS label, unnest([{lists[2]}]) AS b, unnest([{lists[3]}]) AS se, {df} AS df FROM {tag})")
        adjusted = f"1 - (1 - r2) * (n - {1 if spec.constant or spec.entity else 0}) / (n - k)"
        fit = f"(SELECT n, k, 1 - rss / tss AS r2 FROM {tag}, (SELECT sum(u * u) AS rss FROM {tag}_u), (SELECT var_pop(c0) * count(*) AS tss FROM {tag}_r))"
        last = 2 * len(order)
        parts = [
            f"SELECT 2 * pos AS row, label, {_number('b', style)} || {mark} AS cell FROM t JOIN critical USING (df)",
            f"SELECT 2 * pos + 1, '', '(' || {_number('se', style)} || ')' FROM t",
            f"SELECT unnest([{last}, {last + 1}, {last + 2}]), unnest(['N', 'R2', 'Adj. R2']), unnest([format('{{:,d}}', CAST(n AS BIGINT)), {_number('r2', 'f')}, {_number(adjusted, 'f')}]) FROM {fit}",
        ]
        queries.append(f"SELECT '{name}' AS tab, CAST(row AS INTEGER) AS row, label, '{spec.name}' AS model_id, cell FROM ({alone(made, parts)}) WHERE cell IS NOT NULL")
    return queries


def sig(x: str, digits: int = 6, zero: str = "1e-9") -> str:
    return sig_sql(x, digits, zero)
