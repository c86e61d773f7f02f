"""A binomial fit in SQL: Newton steps by joins, solved by elimination in a recursive query.

The spline's columns are made in SQL too: cubic B-splines by their recursion, without the
first, times the last columns of the orthogonal factor of their curvature at both ends.
"""

from __future__ import annotations

STEPS = 9
INNER = 5

# 2 * (1 - Phi(|z|)) by Simpson's rule over 2000 parts.
P_VALUE = """greatest(0, 1 - 2 * (abs(z) / 6000) * list_sum(list_transform(range(0, 2001), lambda i:
  CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
  * exp(-0.5 * power(abs(z) * i / 2000, 2)) / sqrt(2 * pi()))))"""


# Knots at the sixths of the minutes, scaled as the minute is.
ENDS = """
ends AS (
  SELECT low, high, {knots}
  FROM (SELECT CAST(min(at_minute) AS DOUBLE) AS low, CAST(max(at_minute) AS DOUBLE) AS high,
               {quantiles} FROM used)
)
""".format(
    knots=", ".join(f"(q{i} - low) / (high - low) AS k{i}" for i in range(1, INNER + 1)),
    quantiles=", ".join(
        f"quantile_cont(at_minute, CAST({i} AS DOUBLE) / {INNER + 1}) AS q{i}"
        for i in range(1, INNER + 1)
    ),
)


SPLINES = INNER + 4


def _raised(values: str, degree: int, slope: bool = False) -> str:
    """B-splines of one degree more, or their slopes, from the list ``values``; needs ``t`` and ``x``."""
    left = f"coalesce({{}} / nullif(t[i + {degree}] - t[i], 0), 0) * {values}[i]"
    right = f"coalesce({{}} / nullif(t[i + {degree + 1}] - t[i + 1], 0), 0) * {values}[i + 1]"
    if slope:
        item = f"{degree} * ({left.format('1.0::DOUBLE')} - {right.format('1.0::DOUBLE')})"
    else:
        item = f"{left.format('(x - t[i])')} + {right.format(f'(t[i + {degree + 1}] - x)')}"
    return f"list_transform(range(1, {SPLINES + 4 - degree}), lambda i: {item})"


def _splines(points: str, slopes_from: int) -> str:
    """``b``: the cubic B-splines at each ``x`` of ``points`` but the first, or their curvature."""
    inner = f"""(SELECT *, list_transform(range(1, {SPLINES + 4}), lambda i: CASE
      WHEN i = least({SPLINES}, greatest(4, len(list_filter(t, lambda k: k <= x))))
      THEN 1.0::DOUBLE ELSE 0.0 END) AS b0 FROM {points}, spans)"""
    for degree in (1, 2, 3):
        made = _raised(f"b{degree - 1}", degree, degree >= slopes_from)
        inner = f"(SELECT *, {made} AS b{degree} FROM {inner})"
    return f"SELECT * EXCLUDE (b0, b1, b2, b3), b3[2:] AS b FROM {inner}"


def _reflected(vector: str, v: str, tau: str) -> str:
    size = SPLINES - 1
    return (
        f"list_transform(range(1, {size + 1}), lambda i: "
        f"{vector}[i] - {tau} * list_dot_product({vector}, {v}) * {v}[i])"
    )


def _reflection(vector: str, first: int) -> str:
    """``v`` and ``tau`` of the reflection that clears ``vector`` behind place ``first``."""
    norm = f"sqrt(list_sum(list_transform({vector}[{first}:], lambda a: a * a)))"
    beta = f"(CASE WHEN {vector}[{first}] >= 0 THEN -{norm} ELSE {norm} END)"
    v = (
        f"list_transform(range(1, {SPLINES}), lambda i: CASE WHEN i < {first} THEN 0.0::DOUBLE "
        f"WHEN i = {first} THEN 1.0 ELSE {vector}[i] / ({vector}[{first}] - {beta}) END)"
    )
    return f"{v} AS v{first}, ({beta} - {vector}[{first}]) / {beta} AS tau{first}"


# ``basis``: the spline's columns at each minute, as the list ``z``; needs ``used`` and ``ends``.
BASIS = f"""
spans AS (
  SELECT low, high, [0.0, 0, 0, 0, {', '.join(f'k{i}' for i in range(1, INNER + 1))}, 1, 1, 1, 1] AS t
  FROM ends
),
edges AS ({_splines("(SELECT unnest([0.0::DOUBLE, 1.0]) AS x)", 2)}),
bent AS (
  SELECT (SELECT b FROM edges WHERE x = 0) AS c1, (SELECT b FROM edges WHERE x = 1) AS c2
),
once AS (SELECT c1, c2, {_reflection("c1", 1)} FROM bent),
turned AS (SELECT v1, tau1, {_reflected("c2", "v1", "tau1")} AS c2 FROM once),
mirrors AS MATERIALIZED (SELECT v1, tau1, {_reflection("c2", 2)} FROM turned),
seen AS (
  SELECT at_minute, (at_minute - low) / (high - low) AS x
  FROM (SELECT DISTINCT at_minute FROM used), ends
),
basis AS MATERIALIZED (
  SELECT at_minute, {_reflected("y", "v2", "tau2")}[3:] AS z
  FROM (SELECT at_minute, {_reflected("b", "v1", "tau1")} AS y, v2, tau2
        FROM ({_splines("seen", 4)}), mirrors)
)
"""


def model(
    cities: str, by_city: bool, where: str = "TRUE", black: str = "is_black", parted: str = "FALSE", dark: bool = True
) -> str:
    """CTEs after ``vod``: ``used``, ``ends``, and the fit's ``estimates`` and ``summary``.

    ``cities``: the cities with a term of their own, as SQL texts with commas. ``parted``: stops that
    count for the knots but not for the fit; ``dark`` is false where darkness has no term.
    """
    columns = {"intercept": "1"} | ({"is_dark": "CAST(is_dark AS INT)"} if dark else {})
    columns |= {f"minute_{i}": f"z[{i}]" for i in range(1, INNER + 2)}
    listed = ", ".join(f"{{'term': '{k}', 'x': ({v})::DOUBLE}}" for k, v in columns.items())
    ctes = [
        f"used AS MATERIALIZED (SELECT * FROM vod WHERE {where})",
        ENDS,
        f"""cells AS MATERIALIZED (
  SELECT row_number() OVER () AS cell, * FROM (
    SELECT city, at_minute, is_dark, CAST(count(*) AS DOUBLE) AS n,
           CAST(count(*) FILTER ({black}) AS DOUBLE) AS y
    FROM used WHERE NOT ({parted}) GROUP BY ALL))""",
        BASIS,
        "shaped AS (SELECT * FROM cells JOIN basis USING (at_minute))",
        f"""terms AS MATERIALIZED (
  SELECT cell, t.term, t.x FROM shaped, LATERAL (
    SELECT unnest([{listed}]) AS t)
  {_city_terms(cities) if by_city else ''}
)""",
        """named AS MATERIALIZED (
  SELECT term, CAST(row_number() OVER (ORDER BY term) AS INT) AS j FROM (SELECT DISTINCT term FROM terms)
)""",
        "x AS MATERIALIZED (SELECT cell, j, x FROM terms JOIN named USING (term))",
        "p AS MATERIALIZED (SELECT max(j) AS p FROM named)",
        "beta_0 AS MATERIALIZED (SELECT j, 0.0::DOUBLE AS b FROM named)",
    ]
    for step in range(1, STEPS + 1):
        ctes += _step(step)
    ctes += [
        f"""errors AS (SELECT g.i AS j, sqrt(g.v) AS std_error FROM g_{STEPS} g, p
  WHERE g.k = p.p + 1 AND g.j = g.i + p.p + 1)""",
        f"""estimates AS (
  SELECT term, b AS estimate, std_error, b / std_error AS z
  FROM beta_{STEPS} JOIN named USING (j) JOIN errors USING (j)
)""",
        f"""last_step AS (
  SELECT max(abs(l.b - r.b)) < 1e-6 AS converged FROM beta_{STEPS} l JOIN beta_{STEPS - 1} r USING (j)
)""",
        f"""summary AS (
  SELECT -2 * sum(y * ln(m) + (n - y) * ln(1 - m)) AS deviance, sum(n) AS n_rows,
         -2 * (sum(y) * ln(sum(y) / sum(n)) + (sum(n) - sum(y)) * ln(1 - sum(y) / sum(n)))
           AS null_deviance,
         coalesce(sum(n) FILTER (NOT is_dark), 0) AS n_light,
         coalesce(sum(n) FILTER (is_dark), 0) AS n_dark
  FROM m_{STEPS + 1} JOIN (SELECT cell, is_dark FROM cells) USING (cell)
)""",
    ]
    ctes.insert(-1, _fitted(STEPS + 1))
    return ",\n".join(part.strip() for part in ctes)


def _city_terms(cities: str) -> str:
    return f"""UNION ALL
  SELECT cell, 'city_' || c AS term, CAST(city = c AS INT)::DOUBLE AS x
  FROM cells, (SELECT unnest([{cities}]) AS c)"""


def _fitted(step: int) -> str:
    return f"""m_{step} AS MATERIALIZED (
  SELECT cell, n, y, 1 / (1 + exp(-sum(b * x))) AS m
  FROM x JOIN beta_{step - 1} USING (j) JOIN cells USING (cell) GROUP BY cell, n, y
)"""


def _step(step: int) -> list[str]:
    """One Newton step: information and gradient, then elimination beside the unit matrix."""
    return [
        _fitted(step),
        f"""a_{step} AS MATERIALIZED (
  SELECT l.j AS i, r.j AS j, sum(n * m * (1 - m) * l.x * r.x) AS v
  FROM x l JOIN x r USING (cell) JOIN m_{step} USING (cell) GROUP BY ALL
  UNION ALL
  SELECT x.j, p.p + 1, sum((y - n * m) * x.x) FROM x JOIN m_{step} USING (cell), p GROUP BY ALL
  UNION ALL
  SELECT l.j, r.j + p.p + 1, CAST(l.j = r.j AS INT)::DOUBLE FROM named l, named r, p
)""",
        f"""g_{step}(k, i, j, v) AS (
  SELECT 1, i, j, v FROM a_{step}
  UNION ALL
  SELECT k + 1, i, j, CASE WHEN i = k THEN v / vkk ELSE v - vik * vkj / vkk END
  FROM (SELECT *, max(CASE WHEN i = k AND j = k THEN v END) OVER () AS vkk,
               max(CASE WHEN j = k THEN v END) OVER (PARTITION BY i) AS vik,
               max(CASE WHEN i = k THEN v END) OVER (PARTITION BY j) AS vkj
        FROM g_{step}) AS held, p
  WHERE k <= p.p
)""",
        f"""beta_{step} AS MATERIALIZED (
  SELECT o.j, o.b + g.v AS b FROM beta_{step - 1} o JOIN g_{step} g ON g.i = o.j, p
  WHERE g.k = p.p + 1 AND g.j = p.p + 1
)""",
    ]
