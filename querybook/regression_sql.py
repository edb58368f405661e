"""SQL for linear models: estimates and standard errors of least squares and two-stage least squares, with entity effects and trends.

Normal equations are solved by sweeping a moment matrix that is kept as a list of lists, one pivot per CTE; a pivot whose column depends on the
earlier ones is passed over, and its term has no estimate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from panelspark.models.spec import ModelSpec, label_of

from .common import sig_sql

TOL, FLOOR = "1e-9", "1e-14"


def quoted(label: str) -> str:
    return f'"{label}"'


def sweep(k: int, size: int) -> str:
    """The matrix ``m`` swept on its k-th pivot."""
    d = f"(CASE WHEN m[{k}][{k}] > {TOL} * greatest(ref[{k}], 1e-300) THEN 1.0 / m[{k}][{k}] ELSE 0.0 END)"
    span = f"range(1, {size + 1})"
    return (
        f"[[CASE WHEN i = {k} AND j = {k} THEN {d} WHEN i = {k} THEN m[{k}][j] * {d} WHEN j = {k} THEN -m[i][{k}] * {d} "
        f"ELSE m[i][j] - m[i][{k}] * m[{k}][j] * {d} END for j in {span}] for i in {span}]"
    )


def _matrix(names: Sequence[str], weight: str = "") -> str:
    w = f"{weight} * " if weight else ""
    n = len(names)
    return "[" + ", ".join("[" + ", ".join(f"sum({w}{names[min(i, j)]} * {names[max(i, j)]})" for j in range(n)) + "]" for i in range(n)) + "]"


def fit_ctes(
    tag: str, src: str, spec: ModelSpec, exprs: Mapping[str, str] | None = None, carry: Mapping[str, str] | None = None
) -> tuple[list[str], str]:
    """CTEs of one model over the rows ``src``, and the name of the last: one row with ``f`` (inverse and coefficients of the terms in ``terms_of`` order),
    ``n``, ``k``, ``groups`` and ``v`` (a matrix whose quadratic forms in rows of ``f`` are variances), ``lv`` and ``cons`` (the constant's). ``<tag>_u`` has the residual ``u`` of each row, the regressors' (projected) values ``h0``, ``h1``, … and the
    columns of ``carry``."""
    exprs, carry = exprs or {}, carry or {}
    labels = [label_of(t) for t in spec.columns]
    c = [f"c{i}" for i in range(len(labels))]
    n_e, n_x = len(spec.endog), len(spec.x)
    y, endog, exog, instr = c[0], c[1 : 1 + n_e], c[1 + n_e : 1 + n_e + n_x], c[1 + n_e + n_x :]
    g = [f"g{i}" for i in range(len(spec.entity))]
    q = [f"q{i}" for i in range(len(spec.cluster))] if spec.vce == "cluster" else []
    degree = spec.trend[1] if spec.trend else 0
    own = spec.constant and not g
    out = []

    cols = [f"CAST({exprs.get(la, quoted(la))} AS DOUBLE) AS {a}" for la, a in zip(labels, c)]
    keys = [f"{quoted(e)} AS {a}" for e, a in zip(spec.entity, g)] + [f"{quoted(e)} AS {a}" for e, a in zip(spec.cluster, q)]
    time = [f"CAST({quoted(spec.trend[0])} AS DOUBLE) AS tt"] if degree else []
    time += [f"{e} AS {a}" for a, e in carry.items()]
    present = " AND ".join(f"{a} IS NOT NULL" for a in [*c, *g, *q, *(["tt"] if degree else [])])
    out.append(f"{tag}_r AS MATERIALIZED (SELECT * FROM (SELECT {', '.join([*cols, *keys, *time])} FROM {src}) WHERE {present})")
    carried = [*g, *q, *carry]
    by = f"OVER (PARTITION BY {', '.join(g)})" if g else "OVER ()"
    rows = f"{tag}_r"
    if degree:
        two = f", tt * tt - avg(tt * tt) {by} AS t2" if degree == 2 else ""
        out.append(f"{tag}_t AS (SELECT *, tt - avg(tt) {by} AS t1{two} FROM {rows})")
        rows = f"{tag}_t"
        if degree == 2:
            turn = f"coalesce(sum(t1 * t2) {by} / nullif(sum(t1 * t1) {by}, 0), 0)"
            out.append(f"{tag}_t2 AS (SELECT * REPLACE (t2 - t1 * {turn} AS t2), {turn} AS turn, sum(t2 * t2) {by} AS ref2 FROM {rows})")
            rows = f"{tag}_t2"

    def slope(a: str, d: int) -> str:
        fits = f"sum(t{d} * t{d}) {by}"
        usable = f"{fits} > 1e-9" if d == 1 else f"{fits} > 1e-9 * greatest(ref2, 1e-300)"
        return f"(CASE WHEN {usable} THEN sum(t{d} * {a}) {by} / ({fits}) ELSE 0 END)"

    if g or own:
        less = {a: f"{a} - avg({a}) {by}" + "".join(f" - t{d} * {slope(a, d)}" for d in range(1, degree + 1)) for a in c}
    else:
        less = {a: a for a in c}
    base = f"({', '.join(g)}) = (SELECT ({', '.join(g)}) FROM {tag}_r ORDER BY {', '.join(g)} LIMIT 1)" if g else ""
    extra = ["CAST(1 AS DOUBLE) AS one"] if own else []
    in_base = bool(g) and spec.constant and not (spec.vce == "cluster" and spec.cluster == spec.entity)
    if in_base:
        extra.append(f"CASE WHEN {base} THEN 1.0 / (SELECT count(*) FROM {tag}_r WHERE {base}) ELSE 0.0 END AS wb")
    out.append(f"{tag}_w AS MATERIALIZED (SELECT {', '.join([*(f'{e} AS {a}' for a, e in less.items()), *carried, *extra])} FROM {rows})")

    const = ["one"] if own else []
    xs = [*const, *exog, *endog]
    zs = [*const, *exog, *instr]
    order = [*zs, *endog, y] if n_e else [*xs, y]
    spread = [f"(SELECT var_pop({a}) * count(*) FROM {tag}_r)" if a != "one" else "0.0" for a in order]
    out.append(
        f"{tag}_m AS MATERIALIZED (SELECT count(*) AS n, {_matrix(order)} AS m, "
        f"[{', '.join(f'greatest(sum({a} * {a}), {FLOOR} * {s})' for a, s in zip(order, spread))}] AS ref FROM {tag}_w)"
    )
    last = f"{tag}_m"

    def swept(count: int, size: int, last: str) -> str:
        """All sweeps as nested queries: there is a limit to the number of CTEs."""
        for k in range(1, count + 1):
            last = f"(SELECT n, ref, {sweep(k, size)} AS m FROM {last})"
        return last

    at = {a: i + 1 for i, a in enumerate(order)}
    if n_e:
        first = f"{tag}_a"
        out.append(f"{first} AS MATERIALIZED (SELECT * FROM {swept(len(zs), len(order), last)})")
        own_order = [*xs, y]

        def cell(a: str, b: str) -> str:
            plain = f"o.m[{at[a]}][{at[b]}]"
            soft = a in (*endog, y) and b in (*endog, y) and (a in endog or b in endog)
            return f"{plain} - s.m[{at[a]}][{at[b]}]" if soft else plain

        matrix = "[" + ", ".join("[" + ", ".join(cell(a, b) for b in own_order) + "]" for a in own_order) + "]"
        refs = "[" + ", ".join(f"o.ref[{at[a]}]" for a in own_order) + "]"
        last = f"(SELECT o.n, {matrix} AS m, {refs} AS ref FROM {tag}_m o, {first} s)"
    size = len(xs) + 1
    out.append(f"{tag}_f AS MATERIALIZED (SELECT n, m AS f FROM {swept(len(xs), size, last)})")

    hats = {a: a for a in [*const, *exog]}
    for e in endog:
        hats[e] = "(" + " + ".join(f"first.m[{at[z]}][{at[e]}] * {z}" for z in zs) + ")"
    resid = f"({y}" + "".join(f" - f[{i + 1}][{size}] * {a}" for i, a in enumerate(xs)) + ")"
    scores = [f"{hats[a]} AS h{i}" for i, a in enumerate(xs)] + (["wb AS hw"] if in_base else [])
    names = [f"h{i}" for i in range(len(xs))] + (["hw"] if in_base else [])
    tables = f"{tag}_w, {tag}_f" + (f", {first} AS first" if n_e else "")
    out.append(f"{tag}_u AS MATERIALIZED (SELECT {', '.join([*q, *carry, f'{resid} AS u', *scores])} FROM {tables})")
    if q:
        of_cluster = f"(SELECT {', '.join(f'sum(u * {h}) AS {h}' for h in names)} FROM {tag}_u GROUP BY {', '.join(q)})"
        out.append(f"{tag}_v AS MATERIALIZED (SELECT {_matrix(names)} AS v, CAST(count(*) AS DOUBLE) AS groups FROM {of_cluster})")
    else:
        out.append(f"{tag}_v AS MATERIALIZED (SELECT {_matrix(names, 'u * u')} AS v, 0.0 AS groups FROM {tag}_u)")
    absorbed = "0"
    if g:
        parts = [f"count(DISTINCT tt) > {d}" for d in range(1, degree + 1)]
        used = " + ".join(["1", *(f"CASE WHEN {p} THEN 1 ELSE 0 END" for p in parts)])
        absorbed = f"(SELECT sum(e) FROM (SELECT {used} AS e FROM {tag}_r GROUP BY {', '.join(g)}))"
    kept = f"list_sum([CASE WHEN f[i][i] <> 0 THEN 1 ELSE 0 END for i in range(1, {size})])"
    k = f"({kept} + {absorbed} + {spec.extra_k})"
    vce = {"hc0": "1.0", "hc1": "n / (n - k)" if spec.dof == "full" else "1.0", "cluster": "groups / (groups - 1.0)"}[spec.vce]
    if spec.vce == "cluster" and spec.dof == "full":
        vce += " * (n - 1.0) / (n - k)"
    if spec.vce == "cluster" and spec.dof == "none":
        vce = "1.0"
    # The constant: the levels that the columns' shifts have at the base, and their weights on the coefficients.
    shift = {}
    if own:
        shift = {a: f"(SELECT avg({a}) FROM {tag}_r)" for a in c}
    elif spec.constant:
        for a in c:
            level = f"avg({a})"
            if degree:
                level += f" - avg(tt) * coalesce(regr_slope({a}, tt), 0)" if degree == 1 else ""
            shift[a] = f"(SELECT {level} FROM {tag}_r WHERE {base})"
            if degree == 2:
                shift[a] = (
                    f"(SELECT avg({a}) - avg(tt) * coalesce(sum(t1 * {a}) / nullif(sum(t1 * t1), 0), 0) "
                    f"+ (max(turn) * avg(tt) - avg(tt * tt)) * coalesce(sum(t2 * {a}) / nullif(sum(t2 * t2), 0), 0) FROM {tag}_t2 WHERE {base})"
                )
    cons = lv = "NULL"
    if shift:
        weights = ["1.0" if a == "one" else f"-{shift[a]}" for a in xs]
        levels = f"(SELECT [{', '.join(weights)}] AS wt, {shift[y]} AS level)"
        cons = f"level + list_sum([wt[i] * f[i][{size}] for i in range(1, {size})])"
        lv = f"[list_sum([wt[j] * f[j][i] for j in range(1, {size})]) for i in range(1, {size})]" + (" || [1.0]" if in_base else "")
    joined = f"{tag}_f, {tag}_v" + (f", {levels}" if shift else "")
    solved = f"(SELECT *, CAST({k} AS DOUBLE) AS k, {cons} AS cons, {lv} AS lv FROM {joined})"
    out.append(f"{tag} AS MATERIALIZED (SELECT *, {vce} AS small FROM {solved})")
    return out, tag


def terms_of(spec: ModelSpec) -> list[tuple[str, int]]:
    """(label, position in the solved matrix) of the model's regressors."""
    labels = [label_of(t) for t in spec.columns]
    n_e, n_x = len(spec.endog), len(spec.x)
    first = 1 if spec.constant and not spec.entity else 0
    places = {la: first + n_x + 1 + i for i, la in enumerate(labels[1 : 1 + n_e])} | {la: first + 1 + i for i, la in enumerate(labels[1 + n_e : 1 + n_e + n_x])}
    return [(label_of(t), places[label_of(t)]) for t in spec.regressors]


def variance(vector: str, size: str) -> str:
    return f"list_sum([list_sum([{vector}[a] * v[a][b] * {vector}[b] for b in range(1, {size} + 1)]) for a in range(1, {size} + 1)])"


def term_lists(spec: ModelSpec, terms: Sequence[str] | None = None) -> list[tuple[str, str, str]]:
    """(label, estimate, standard error) of a model's terms, the constant last, as expressions over the last of ``fit_ctes``."""
    size = len(spec.regressors) + (1 if spec.constant and not spec.entity else 0)
    out = []
    for label, i in terms_of(spec):
        if terms is None or label in terms:
            here = f"CASE WHEN f[{i}][{i}] <> 0 THEN {{}} END"
            out.append((label, here.format(f"f[{i}][{size + 1}]"), here.format(f"sqrt(small * {variance(f'f[{i}]', str(size))})")))
    if spec.constant and (terms is None or "_cons" in terms):
        out.append(("_cons", "cons", f"sqrt(small * {variance('lv', 'len(lv)')})"))
    return out


def fit_rows(tag: str, spec: ModelSpec, digits: int = 6, zero: str = "1e-9", terms: Sequence[str] | None = None) -> str:
    """SELECT of (model_id, term, estimate, std_error) of a model whose CTEs are ``fit_ctes``."""
    found = term_lists(spec, terms)
    lists = [", ".join(x) for x in zip(*((f"'{la}'", b, se) for la, b, se in found))]
    rows = f"(SELECT unnest([{lists[0]}]) AS term, unnest([{lists[1]}]) AS b, unnest([{lists[2]}]) AS se FROM {tag})"
    return f"SELECT '{spec.name}' AS model_id, term, {sig_sql('b', digits, zero)} AS estimate, {sig_sql('se', digits, zero)} AS std_error FROM {rows}"
