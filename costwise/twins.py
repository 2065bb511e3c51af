"""DuckDB SQL twins of the Spark operators (the correctness oracle).

Each builder returns SQL text over the pre-registered views (``events``
and the other test tables). They restate the semantics independently of the
Spark code; the few constants they share come from ``schema`` and the
pinned models.
"""

from __future__ import annotations

import math

from .functions import c_of
from .operators.classifier import LinearModel
from .schema import FEATURES


def num(x: float) -> str:
    """A double literal that DuckDB reads back to the same float."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def transactions_sql(events: str = "events") -> str:
    """The same view as DuckDB SQL (used by the SQL twins)."""
    return f"""
    SELECT transaction_id, amount, transaction_time,
           CASE WHEN pk IS NULL THEN 0 WHEN floor(k / 25.0) <> floor(pk / 25.0) THEN 1 ELSE 0 END AS location_change,
           CASE WHEN pk IS NULL THEN 0 WHEN (k - pk) % 2 <> 0 THEN 1 ELSE 0 END AS device_change,
           CAST(k AS DOUBLE) / 100.0 AS merchant_risk,
           CAST((amount / 50.0 + 2 * (CAST(k AS DOUBLE) / 100.0)
                 + CASE WHEN pk IS NULL THEN 0 WHEN floor(k / 25.0) <> floor(pk / 25.0) THEN 1 ELSE 0 END
                 + 0.5 * CASE WHEN pk IS NULL THEN 0 WHEN (k - pk) % 2 <> 0 THEN 1 ELSE 0 END
                 + CASE WHEN transaction_time < 6 THEN 1 ELSE 0 END > 4.0)
                <> (((transaction_id % 100) * 7919) % 100 < 5) AS INTEGER) AS is_fraud
    FROM (
      SELECT event_id AS transaction_id, CAST(value AS DOUBLE) AS amount,
             CAST(hour(ts) AS INTEGER) AS transaction_time,
             CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
             lag(CAST(json_extract_string(props, '$.k') AS INTEGER))
               OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pk
      FROM {events}
    ) AS e
    """


def logit_sql(model: LinearModel, cols: dict[str, str] | None = None) -> str:
    """b + sum(beta_j * x_j) on the raw scale, same association as the Spark expression."""
    cols = cols or {f: f for f in model.features}
    expr = num(model.raw_intercept)
    for f, b in zip(model.features, model.raw_coef):
        expr = f"({expr} + {num(b)} * CAST({cols[f]} AS DOUBLE))"
    return expr


def sigmoid_sql(x: str) -> str:
    return f"(1.0 / (1.0 + exp(-({x}))))"


def coalitions(m: int) -> list[tuple[int, ...]]:
    """All subsets of 0..m-1 (the twin's own enumeration)."""
    return [tuple(j for j in range(m) if bits >> j & 1) for bits in range(1 << m)]


def shapley_terms(m: int) -> list[list[tuple[float, tuple[int, ...], tuple[int, ...]]]]:
    """For each feature: (weight, coalition with it, coalition without it), weights
    by the definition |S|! (m - |S| - 1)! / m!."""
    out = []
    for i in range(m):
        rows = []
        for without in coalitions(m):
            if i not in without:
                k = len(without)
                rows.append((math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m), tuple(sorted((*without, i))), without))
        out.append(rows)
    return out


def phi_sql(model: LinearModel, src: str, keep: tuple[str, ...] = ("transaction_id",), baseline=None) -> str:
    """Exact Shapley values of the linear-logistic probability, one column per feature."""
    m = len(model.features)
    base = list(baseline) if baseline is not None else [0.0] * m
    beta = model.raw_coef
    base_logit = model.raw_intercept + sum(b * v for b, v in zip(beta, base))

    def cname(S):
        return "c_" + ("_".join(map(str, S)) if S else "e")

    probs = []
    for S in coalitions(m):
        eta = num(base_logit)
        for j in S:
            eta = f"({eta} + {num(beta[j])} * (CAST({model.features[j]} AS DOUBLE) - {num(base[j])}))"
        probs.append(f"{sigmoid_sql(eta)} AS {cname(S)}")
    phis = []
    for i, f in enumerate(model.features):
        acc = None
        for w, a, b in shapley_terms(m)[i]:
            t = f"({num(w)} * ({cname(a)} - {cname(b)}))"
            acc = t if acc is None else f"({acc} + {t})"
        phis.append(f"{acc} AS phi_{f}")
    k = ", ".join(keep)
    return f"SELECT {k}, {', '.join(phis)} FROM (SELECT {k}, {', '.join(probs)} FROM ({src}) s0) s1"


def phi_background_sql(model: LinearModel, src: str, background: str, weight: str, keep: str = "transaction_id") -> str:
    """Shapley values against a background table by brute force: every row meets every
    background row in every coalition. ``keep`` must tell the rows of ``src`` apart."""
    m, beta, f = len(model.features), model.raw_coef, model.features
    name = lambda S: "c_" + ("_".join(map(str, S)) if S else "e")
    means = []
    for S in coalitions(m):
        eta = num(model.raw_intercept)
        for j in range(m):
            eta = f"({eta} + {num(beta[j])} * CAST({'x' if j in S else 'bg'}.{f[j]} AS DOUBLE))"
        means.append(f"sum(bg.{weight} * {sigmoid_sql(eta)}) / sum(bg.{weight}) AS {name(S)}")
    phis = [" + ".join(f"{num(w)} * ({name(a)} - {name(b)})" for w, a, b in terms) + f" AS phi_{f[i]}" for i, terms in enumerate(shapley_terms(m))]
    return f"SELECT {keep}, {', '.join(phis)} FROM (SELECT x.{keep}, {', '.join(means)} FROM ({src}) x CROSS JOIN ({background}) bg GROUP BY x.{keep}) c"


def md5_orders(m: int, pairs: int, seed: int) -> list[list[int]]:
    """Feature orders by md5('seed:pair:feature'), restated."""
    import hashlib

    return [sorted(range(m), key=lambda i: hashlib.md5(f"{seed}:{k}:{i}".encode()).hexdigest()) for k in range(pairs)]


def phi_orders_sql(intercept: float, terms: dict[str, str], src: str, pairs: int, seed: int, keep: str = "transaction_id") -> str:
    """Shapley values of sigma(intercept + sum of terms) against zeros, from feature
    orders and their reversals: each feature's mean step along the orders."""
    names = list(terms)
    m, masks = len(names), {}
    name = lambda S: f"c{masks.setdefault(frozenset(S), len(masks))}"
    steps: list[list[str]] = [[] for _ in names]
    for order in md5_orders(m, pairs, seed):
        for walk in (order, list(reversed(order))):
            for at, i in enumerate(walk):
                steps[i].append(f"({name(walk[: at + 1])} - {name(walk[:at])})")
    inner = ", ".join(f"{t} AS t_{n}" for n, t in terms.items())
    probs = ", ".join(f"{sigmoid_sql(' + '.join([num(intercept), *(f't_{names[i]}' for i in sorted(S))]))} AS c{k}" for S, k in masks.items())
    phis = ", ".join(f"({' + '.join(st)}) / {2.0 * pairs} AS phi_{n}" for n, st in zip(names, steps))
    return f"SELECT {keep}, {phis} FROM (SELECT {keep}, {probs} FROM (SELECT {keep}, {inner} FROM ({src}) s0) s1) s2"


def phi_long_sql(phi_src: str, features=FEATURES) -> str:
    """(transaction_id, rank, feature, contribution) ranked by |phi| desc, then feature order."""
    rows = " UNION ALL ".join(
        f"SELECT transaction_id, {i} AS idx, '{f}' AS feature, phi_{f} AS contribution FROM ({phi_src}) p" for i, f in enumerate(features)
    )
    return (
        "SELECT transaction_id, row_number() OVER (PARTITION BY transaction_id ORDER BY abs(contribution) DESC, idx) AS rank, "
        f"feature, contribution FROM ({rows}) u"
    )


def explanation_sql(long_src: str, k: int = 3) -> str:
    return (
        "SELECT transaction_id, 'Transaction flagged primarily due to: ' || "
        "string_agg(replace(feature, '_', ' ') || ' impact', ', ' ORDER BY rank) || '.' AS explanation "
        f"FROM ({long_src}) l WHERE rank <= {k} GROUP BY transaction_id"
    )


def scaler_stats_sql(src: str, features=FEATURES) -> str:
    cols = []
    for f in features:
        cols.append(f"avg(CAST({f} AS DOUBLE)) AS mean_{f}")
        cols.append(f"CASE WHEN stddev_pop(CAST({f} AS DOUBLE)) = 0 THEN 1.0 ELSE stddev_pop(CAST({f} AS DOUBLE)) END AS scale_{f}")
    return f"SELECT {', '.join(cols)} FROM ({src}) t"


def class_weights_sql(src: str, label: str = "is_fraud") -> str:
    return (
        f"SELECT CAST({label} AS INTEGER) AS {label}, count(*) AS n, "
        f"CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)) AS weight "
        f"FROM ({src}) t GROUP BY 1"
    )


def logistic_gd_ctes(src: str, features=FEATURES, label: str = "is_fraud", steps: int = 300, step: float = 2.0) -> list[str]:
    """CTEs ``st``, ``z``, ``gd`` and ``mdl``: the penalised, class-balanced
    logistic fit by plain gradient descent, and its raw-scale coefficients.

    Objective / n: (1/n) sum w_i logloss_i + (1/2n) |theta|^2 with theta =
    (intercept, beta) on standardised features. A recursive CTE carries theta;
    each step is one aggregate over the table. ``mdl`` holds ``rb`` (raw
    intercept) and ``r0..`` (raw coefficients) plus the scaled ``b, t0..``.
    """
    m = len(features)
    st = ", ".join(f"avg(CAST({f} AS DOUBLE)) AS m{j}, CASE WHEN stddev_pop(CAST({f} AS DOUBLE)) = 0 THEN 1.0 ELSE stddev_pop(CAST({f} AS DOUBLE)) END AS s{j}" for j, f in enumerate(features))
    z = ", ".join(f"(CAST({f} AS DOUBLE) - m{j}) / s{j} AS z{j}" for j, f in enumerate(features))
    th = ["b"] + [f"t{j}" for j in range(m)]
    eta = " + ".join(["b"] + [f"t{j} * z{j}" for j in range(m)])
    resid = f"w * (1.0 / (1.0 + exp(-({eta}))) - y)"
    upd = [f"b - {step} * (sum({resid}) / n + b / n)"] + [f"t{j} - {step} * (sum({resid} * z{j}) / n + t{j} / n)" for j in range(m)]
    init = ", ".join(["0 AS it"] + [f"CAST(0 AS DOUBLE) AS {t}" for t in th])
    folded = "b - (" + " + ".join(f"t{j} * m{j} / s{j}" for j in range(m)) + ")"
    raw = ", ".join([f"{folded} AS rb"] + [f"t{j} / s{j} AS r{j}" for j in range(m)])
    return [
        f"st AS (SELECT {st}, CAST(count(*) AS DOUBLE) AS n, CAST(sum({label}) AS DOUBLE) AS npos FROM ({src}) t)",
        f"""z AS (SELECT {z}, CAST({label} AS DOUBLE) AS y,
                 CASE WHEN {label} = 1 THEN n / (2.0 * npos) ELSE n / (2.0 * (n - npos)) END AS w, n
          FROM ({src}) t CROSS JOIN st)""",
        f"""gd AS (
      SELECT {init}
      UNION ALL
      SELECT it + 1, {', '.join(upd)}
      FROM gd CROSS JOIN z WHERE it < {steps}
      GROUP BY it, {', '.join(th)}, n
    )""",
        f"mdl AS (SELECT {', '.join(th)}, {raw} FROM gd CROSS JOIN st WHERE it = {steps})",
    ]


def logistic_gd_sql(src: str, features=FEATURES, label: str = "is_fraud", steps: int = 300, step: float = 2.0) -> str:
    """The fit as one statement: scaled ``b, t0..`` and ``st`` statistics."""
    return "WITH RECURSIVE " + ",\n".join(logistic_gd_ctes(src, features, label, steps, step)) + "\nSELECT mdl.*, st.* FROM mdl CROSS JOIN st"


def phi_sql_from(intercept: str, betas: list[str], src: str, features=FEATURES, keep: tuple[str, ...] = ("transaction_id",)) -> str:
    """Shapley values against an all-zero baseline for raw-scale coefficients
    given as SQL expressions over the columns of ``src``."""
    m = len(features)

    def cname(S):
        return "c_" + ("_".join(map(str, S)) if S else "e")

    probs = []
    for S in coalitions(m):
        eta = intercept
        for j in S:
            eta = f"({eta} + {betas[j]} * (CAST({features[j]} AS DOUBLE) - CAST(0.0 AS DOUBLE)))"
        probs.append(f"{sigmoid_sql(eta)} AS {cname(S)}")
    phis = []
    for i, f in enumerate(features):
        acc = None
        for w, a, b in shapley_terms(m)[i]:
            t = f"({num(w)} * ({cname(a)} - {cname(b)}))"
            acc = t if acc is None else f"({acc} + {t})"
        phis.append(f"{acc} AS phi_{f}")
    k = ", ".join(keep)
    return f"SELECT {k}, {', '.join(phis)} FROM (SELECT {k}, {', '.join(probs)} FROM ({src}) s0) s1"


# ---------------------------------------------------------------- isolation forest
def _u(seed: int, tree: str, node: str, salt: int) -> str:
    h = f"md5('{seed}:' || CAST({tree} AS VARCHAR) || ':' || CAST({node} AS VARCHAR) || ':{salt}')"
    return f"(CAST(('0x' || substr({h}, 1, 8)) AS UBIGINT) / 4294967296.0)"


def c_sql(n: str) -> str:
    from .schema import EULER_GAMMA

    return (
        f"(CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 "
        f"ELSE 2.0 * (ln({n} - 1.0) + {num(EULER_GAMMA)}) - 2.0 * ({n} - 1.0) / {n} END)"
    )


def forest_ctes(src: str, n_trees: int, max_samples: int, seed: int, features=FEATURES) -> tuple[list[str], int, int]:
    """CTEs ``fx`` (rows), ``smp`` (sample), ``nodes`` (grown forest), ``q0..``
    (every row walking every tree), ``scored`` and ``offs`` (offset; its
    quantile is filled in by ``forest_sql``). Returns (ctes, psi, max_depth).
    Assumes the table has at least ``max_samples`` rows, so psi = max_samples."""
    m = len(features)
    psi = max_samples
    depth = int(math.ceil(math.log2(max(psi, 2))))
    xs = ", ".join(f"CAST({f} AS DOUBLE) AS x{j}" for j, f in enumerate(features))
    xcols = ", ".join(f"x{j}" for j in range(m))
    prime = 2**31 - 1
    whole = "".join(f" || ':' || CAST(CAST(floor(x{j} * 1048576) AS BIGINT) AS VARCHAR)" for j in range(m))
    hex8 = lambda h, i: f"CAST(('0x' || substr({h}, {i}, 8)) AS BIGINT)"
    ctes = [
        f"fx AS (SELECT transaction_id, {xs} FROM ({src}) t)",
        f"""hx AS (SELECT *, {hex8('h', 1)} % {prime} AS h1, {hex8('h', 9)} % {prime} AS h2
          FROM (SELECT *, md5('{seed}:' || CAST(transaction_id AS VARCHAR){whole}) AS h FROM fx) x)""",
        f"""co AS (SELECT tree, 1 + {hex8('h', 1)} % {prime - 1} AS a, 1 + {hex8('h', 9)} % {prime - 1} AS c, {hex8('h', 17)} % {prime} AS b
          FROM (SELECT CAST(range AS INTEGER) AS tree, md5('{seed}:' || CAST(range AS VARCHAR)) AS h FROM range({n_trees})) x)""",
        f"""smp AS (SELECT tree, transaction_id, {xcols} FROM (
            SELECT tree, hx.*, row_number() OVER (PARTITION BY tree ORDER BY (a * h1 + c * h2 + b) % {prime}, h1, h2, {xcols}) AS rn
            FROM hx CROSS JOIN co) r
          WHERE rn <= {psi})""",
        f"r0 AS (SELECT tree, 1 AS node, {xcols} FROM smp)",
    ]
    pick_cases = " ".join(
        f"WHEN v{j} = 1 AND pick = {' + '.join([f'v{i}' for i in range(j)]) or '0'} THEN {j}" for j in range(m)
    )
    stats = ", ".join(f"min(x{j}) AS lo{j}, max(x{j}) AS hi{j}" for j in range(m))
    varying = ", ".join(f"CASE WHEN hi{j} > lo{j} THEN 1 ELSE 0 END AS v{j}" for j in range(m))
    nv = " + ".join(f"v{j}" for j in range(m))
    thr = " ".join(f"WHEN {j} THEN lo{j} + u2 * (hi{j} - lo{j})" for j in range(m))
    xf = " ".join(f"WHEN {j} THEN r.x{j}" for j in range(m))
    node_parts = []
    for level in range(depth + 1):
        ctes.append(
            f"""g{level} AS (
              SELECT tree, node, {level} AS depth, CAST(count(*) AS INTEGER) AS size, {stats} FROM r{level} GROUP BY tree, node)"""
        )
        ctes.append(
            f"""s{level} AS (
              SELECT *, CASE WHEN size <= 1 OR depth >= {depth} OR nv = 0 THEN -1
                             ELSE CASE {pick_cases} END END AS feature
              FROM (SELECT *, least(CAST(floor(u1 * nv) AS INTEGER), nv - 1) AS pick
                    FROM (SELECT *, {nv} AS nv FROM (SELECT *, {varying},
                                 {_u(seed, 'tree', 'node', 0)} AS u1, {_u(seed, 'tree', 'node', 1)} AS u2 FROM g{level}) a) b) c)"""
        )
        ctes.append(
            f"""t{level} AS (
              SELECT tree, node, depth, CAST(feature AS INTEGER) AS feature,
                     CASE WHEN feature < 0 THEN NULL ELSE CASE feature {thr} END END AS threshold,
                     size, feature < 0 AS is_leaf,
                     CASE WHEN feature < 0 THEN depth + {c_sql('size')} END AS path
              FROM s{level})"""
        )
        node_parts.append(f"SELECT * FROM t{level}")
        if level < depth:
            ctes.append(
                f"""r{level + 1} AS (
                  SELECT r.tree, 2 * r.node + CASE WHEN (CASE t.feature {xf} END) > t.threshold THEN 1 ELSE 0 END AS node, {', '.join(f'r.x{j}' for j in range(m))}
                  FROM r{level} r JOIN t{level} t ON r.tree = t.tree AND r.node = t.node WHERE t.feature >= 0)"""
            )
    ctes.append(f"nodes AS ({' UNION ALL '.join(node_parts)})")
    # Scoring: every row walks every tree, one level per join; a node that was
    # never grown (empty side of a split) is a leaf at its depth.
    nf = " ".join(f"WHEN {j} THEN q.x{j}" for j in range(m))
    ctes.append(
        f"q0 AS (SELECT f.transaction_id, tr.tree, 1 AS node, CAST(NULL AS DOUBLE) AS path, {', '.join(f'f.x{j}' for j in range(m))} "
        f"FROM fx f CROSS JOIN (SELECT CAST(range AS INTEGER) AS tree FROM range({n_trees})) tr)"
    )
    for level in range(depth + 1):
        ctes.append(
            f"""q{level + 1} AS (
              SELECT q.transaction_id, q.tree,
                     CASE WHEN q.path IS NOT NULL OR n.node IS NULL OR n.is_leaf THEN q.node
                          ELSE 2 * q.node + CASE WHEN (CASE n.feature {nf} END) > n.threshold THEN 1 ELSE 0 END END AS node,
                     COALESCE(q.path, CASE WHEN n.node IS NULL THEN CAST({level} AS DOUBLE) WHEN n.is_leaf THEN n.path END) AS path,
                     {', '.join(f'q.x{j}' for j in range(m))}
              FROM q{level} q LEFT JOIN nodes n ON q.path IS NULL AND q.tree = n.tree AND q.node = n.node)"""
        )
    ctes.append(
        f"scored AS (SELECT transaction_id, -pow(2.0, -(sum(path ORDER BY path) / {n_trees}) / {num(c_of(psi))}) AS score "
        f"FROM q{depth + 1} GROUP BY transaction_id)"
    )
    ctes.append("offs AS (SELECT quantile_cont(score, {q}) AS offset FROM scored)")
    return ctes, psi, depth


def forest_sql(src: str, select: str, n_trees: int, max_samples: int, seed: int, contamination: float, features=FEATURES, extra: list[str] | None = None) -> str:
    ctes, _, _ = forest_ctes(src, n_trees, max_samples, seed, features)
    ctes[-1] = ctes[-1].replace("{q}", repr(float(contamination)))
    head = "WITH RECURSIVE " if extra else "WITH "
    return head + ",\n".join(ctes + list(extra or [])) + "\n" + select
