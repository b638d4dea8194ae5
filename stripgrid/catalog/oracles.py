"""The same results in plain SQL over the given tables, for checking the queries against another engine."""

from __future__ import annotations

from .queries import DESCENTS, GRID, LAMBDAS, SGD_RATE, SGD_STEPS, STRIP

R, C = GRID

CELLS = """(SELECT CAST(vec_id AS BIGINT) AS i, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS j,
  CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"""

PART = """(SELECT CAST(p_partkey AS BIGINT) AS i, CAST(0 AS INTEGER) AS j, CAST(p_size AS DOUBLE) AS value FROM part
  UNION ALL SELECT CAST(p_partkey AS BIGINT), CAST(1 AS INTEGER), p_retailprice FROM part)"""

LINES = """(SELECT 1.0::DOUBLE AS one, l_quantity AS qty, round(l_discount * 100) AS disc, round(l_tax * 100) AS tax,
  CAST(l_linenumber AS DOUBLE) AS line, l_extendedprice / 1000 AS price FROM lineitem)"""

ORDERS = """(SELECT CAST(o_orderkey AS BIGINT) AS row_id, 1.0::DOUBLE AS one, o_totalprice / 100000 AS price,
  CAST(o_custkey % 7 AS DOUBLE) AS group7 FROM orders)"""

SCALED = """(SELECT l_discount * 10 AS disc, l_tax * 10 AS tax, l_extendedprice / 100000 AS price FROM lineitem)"""


def neat(expression: str, digits: int) -> str:
    return f"round({expression}, {digits}) + 0.0"


def cells_of(source: str, expression: str, digits: int | None = None) -> str:
    value = expression if digits is None else neat(expression, digits)
    return f"SELECT i, j, {value} AS value FROM {source}"


def half(table: str) -> tuple[str, str]:
    """Bounds of the middle half of the rows of a table."""
    quarter = f"(SELECT count(*) // 4 FROM {table})"
    return quarter, f"(3 * {quarter})"


LOW, HIGH = half("embeddings")
PART_LOW, PART_HIGH = half("part")


# -- small linear algebra written out as SQL expressions -----------------------------------------------------


def sums(columns: dict[str, str], source: str, group: str = "") -> str:
    """One row of named sums: ``columns`` maps a name to the expression to add up."""
    listed = ", ".join(f"sum({expression}) AS {name}" for name, expression in columns.items())
    return f"SELECT {listed} FROM {source}{group}"


def gram_columns(features: list[str]) -> dict[str, str]:
    n = len(features)
    return {f"g{i}{j}": f"{features[i]} * {features[j]}" for i in range(n) for j in range(i, n)}


def g(i: int, j: int) -> str:
    return f"g{min(i, j)}{max(i, j)}"


def det3(m: list[list[str]]) -> str:
    return (
        f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]})"
        f" - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]})"
        f" + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"
    )


def det2(m: list[list[str]]) -> str:
    return f"({m[0][0]} * {m[1][1]} - {m[0][1]} * {m[1][0]})"


def cramer(n: int, rhs: str) -> list[str]:
    """Solution of (G + lam I) x = c as expressions of g.., lam and {rhs}0.. ."""
    det = det3 if n == 3 else det2
    matrix = [[f"({g(i, j)} + lam)" if i == j else g(i, j) for j in range(n)] for i in range(n)]
    whole = det(matrix)
    solution = []
    for column in range(n):
        swapped = [[f"{rhs}{i}" if j == column else matrix[i][j] for j in range(n)] for i in range(n)]
        solution.append(f"{det(swapped)} / {whole}")
    return solution


def lambda_rows(lams: list[float]) -> str:
    return "(VALUES " + ", ".join(f"({lam}::DOUBLE)" for lam in lams) + ") AS penalties(lam)"


def ridge(features: list[str], targets: list[str], source: str, lams: list[float], digits: int = 7) -> str:
    n = len(features)
    columns = gram_columns(features)
    for k, target in enumerate(targets):
        columns |= {f"c{k}_{i}": f"{features[i]} * ({target})" for i in range(n)}
    rows = []
    for k in range(len(targets)):
        for j, x in enumerate(cramer(n, f"c{k}_")):
            rows.append(
                f"SELECT lam, CAST({j} AS INTEGER) AS j, CAST({k} AS INTEGER) AS rhs, {neat(x, digits)} AS x FROM m"
            )
    return f"WITH m AS (SELECT * FROM ({sums(columns, source)}), {lambda_rows(lams)}) " + " UNION ALL ".join(rows)


def shifted_targets(digits: int) -> str:
    """Two penalties, each with its own residuals taken off the two targets."""
    features = ["one", "qty", "disc"]
    targets = [["price - 0.5 * qty", "tax"], ["price - tax", "tax - one"]]
    columns = gram_columns(features)
    for t, pair in enumerate(targets):
        for k, target in enumerate(pair):
            columns |= {f"c{t}{k}_{i}": f"{features[i]} * ({target})" for i in range(3)}
    rows = []
    for t, lam in enumerate((0.0, 10.0)):
        for k in range(2):
            for j, x in enumerate(cramer(3, f"c{t}{k}_")):
                rows.append(
                    f"SELECT CAST({t} AS INTEGER) AS target, lam, CAST({j} AS INTEGER) AS j, CAST({k} AS INTEGER) AS rhs, "
                    f"{neat(x, digits)} AS x FROM (SELECT *, {lam}::DOUBLE AS lam FROM m)"
                )
    return f"WITH m AS ({sums(columns, LINES)}) " + " UNION ALL ".join(rows)


def cholesky(features: list[str], source: str, digits: int) -> str:
    """Upper Cholesky factor of the Gram matrix, one common table expression per row of the factor."""
    n = len(features)
    steps = [f"s AS ({sums(gram_columns(features), source)})"]
    last = "s"
    for i in range(n):
        inner = "".join(f" - r{k}{i} * r{k}{i}" for k in range(i))
        steps.append(f"d{i} AS (SELECT *, sqrt(g{i}{i}{inner}) AS r{i}{i} FROM {last})")
        entries = []
        for j in range(i + 1, n):
            inner = "".join(f" - r{k}{i} * r{k}{j}" for k in range(i))
            entries.append(f"(g{i}{j}{inner}) / r{i}{i} AS r{i}{j}")
        last = f"d{i}"
        if entries:
            steps.append(f"e{i} AS (SELECT *, {', '.join(entries)} FROM d{i})")
            last = f"e{i}"
    rows = [
        f"SELECT CAST({i} AS {{i_type}}) AS i, CAST({j} AS INTEGER) AS j, {neat(f'r{i}{j}', digits)} AS value FROM {last}"
        for i in range(n)
        for j in range(i, n)
    ]
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(rows)


def order_q() -> str:
    """Q by forward substitution with the Cholesky factor of the Gram matrix."""
    features = ["one", "price", "group7"]
    return f"""WITH s AS ({sums(gram_columns(features), ORDERS)}),
      a AS (SELECT *, sqrt(g00) AS r00 FROM s),
      b AS (SELECT *, g01 / r00 AS r01, g02 / r00 AS r02 FROM a),
      c AS (SELECT *, sqrt(g11 - r01 * r01) AS r11 FROM b),
      d AS (SELECT *, (g12 - r01 * r02) / r11 AS r12 FROM c),
      e AS (SELECT *, sqrt(g22 - r02 * r02 - r12 * r12) AS r22 FROM d),
      q AS (SELECT row_id, one / r00 AS q0, price, group7, e.* FROM {ORDERS} AS o, e),
      p AS (SELECT *, (price - r01 * q0) / r11 AS q1 FROM q),
      t AS (SELECT *, (group7 - r02 * q0 - r12 * q1) / r22 AS q2 FROM p)
    SELECT row_id AS i, CAST(0 AS INTEGER) AS j, {neat('q0', 9)} AS value FROM t
    UNION ALL SELECT row_id, CAST(1 AS INTEGER), {neat('q1', 9)} FROM t
    UNION ALL SELECT row_id, CAST(2 AS INTEGER), {neat('q2', 9)} FROM t"""


def pair_spectrum() -> str:
    """Singular values of a two-column matrix from the eigenvalues of its Gram matrix."""
    return f"""s AS ({sums(gram_columns(['qty', 'disc']), LINES)}),
      e AS (SELECT *, (g00 + g11) / 2 AS mid, sqrt(((g00 - g11) / 2) * ((g00 - g11) / 2) + g01 * g01) AS gap FROM s),
      v AS (SELECT *, sqrt(mid + gap) AS hi, sqrt((g00 * g11 - g01 * g01) / (mid + gap)) AS lo FROM e)"""


def pair_svd() -> str:
    """Singular values and right vectors of (price, group7), whose Gram matrix is positive: with signs by the largest entry,
    the first vector is positive and the second turns it by a quarter."""
    return f"""s AS ({sums(gram_columns(['price', 'group7']), ORDERS)}),
      e AS (SELECT *, (g00 + g11) / 2 AS mid, sqrt(((g00 - g11) / 2) * ((g00 - g11) / 2) + g01 * g01) AS gap FROM s),
      l AS (SELECT *, sqrt(mid + gap) AS hi, sqrt((g00 * g11 - g01 * g01) / (mid + gap)) AS lo, g01 AS x,
        mid + gap - g00 AS y FROM e),
      n AS (SELECT hi, lo, x / sqrt(x * x + y * y) AS a, y / sqrt(x * x + y * y) AS b FROM l),
      v AS (SELECT *, CASE WHEN a >= b THEN -b ELSE b END AS c, CASE WHEN a >= b THEN a ELSE -a END AS d FROM n)"""


def pair_u() -> str:
    return f"""WITH {pair_svd()}
      SELECT row_id AS i, CAST(0 AS INTEGER) AS j, {neat('(price * a + group7 * b) / hi', 9)} AS value FROM {ORDERS} AS o, v
      UNION ALL SELECT row_id, CAST(1 AS INTEGER), {neat('(price * c + group7 * d) / lo', 9)} FROM {ORDERS} AS o, v"""


PRIME, MIX = 2147483647, (48271, 69621, 40692, 16807, 39373)


def drawn(key: str, step: str, seed: int, fraction: float) -> str:
    """The sampling rule of the gradient steps, in integer arithmetic."""
    k = f"(({key} % {PRIME} + {MIX[2]} * (({key} // {PRIME}) % {PRIME})) % {PRIME})"
    a = f"(({MIX[0]} * {k} + {MIX[1]} * {step} + {seed}) % {PRIME})"
    b = f"(({a} * {a} + {MIX[3]} * {a} + {step}) % {PRIME})"
    return f"(({b} * {b} + {MIX[4]} * {b} + {k}) % {PRIME}) / {float(PRIME)}::DOUBLE < {fraction}"


def sampled_gradient(lams: list[float], steps: int, rate: float, seed: int = 42, fraction: float = 0.5) -> str:
    """Steps on the moments of (one, group7, price) of half the orders, drawn anew for each step."""
    columns = gram_columns(["one", "group7"]) | {"c0": "one * price", "c1": "group7 * price"}
    step = f"({rate} / sqrt(m.t::DOUBLE))"
    x0 = f"x0 * (1 - {step} * lam) - {step} * (g00 * x0 + g01 * x1 - c0) / n AS x0"
    x1 = f"x1 * (1 - {step} * lam) - {step} * (g01 * x0 + g11 * x1 - c1) / n AS x1"
    rows = [
        f"SELECT lam, CAST({j} AS INTEGER) AS j, CAST(0 AS INTEGER) AS rhs, {neat(f'x{j}', 9)} AS x FROM w WHERE t = {steps}"
        for j in range(2)
    ]
    listed = ", ".join(f"sum({expression}) AS {name}" for name, expression in columns.items())
    return f"""WITH RECURSIVE m AS (SELECT t, {listed}, count(*)::DOUBLE AS n
        FROM {ORDERS} AS o, range(1, {steps + 1}) AS r(t) WHERE {drawn('row_id', 't', seed, fraction)} GROUP BY t),
      w AS (SELECT lam, 0::BIGINT AS t, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS x1 FROM {lambda_rows(lams)}
        UNION ALL SELECT lam, m.t AS t, {x0}, {x1} FROM w JOIN m ON m.t = w.t + 1)
    """ + " UNION ALL ".join(rows)


def sampled_gradient_wide(lam: float, steps: int, rate: float, seed: int = 42, fraction: float = 0.5) -> str:
    """Embedding column 0 on the other 63, cell by cell: one pair of aggregates for each step."""
    parts = [
        f"c AS (SELECT i, CAST(j - 1 AS INTEGER) AS j, value FROM {CELLS} WHERE j > 0)",
        f"y AS (SELECT i, value AS b FROM {CELLS} WHERE j = 0)",
        "w0 AS (SELECT DISTINCT j, 0.0::DOUBLE AS x FROM c)",
    ]
    for t in range(1, steps + 1):
        step = f"({rate} / sqrt({float(t)}::DOUBLE))"
        parts += [
            f"p{t} AS (SELECT y.i, sum(c.value * x) - any_value(b) AS gap FROM y JOIN c ON c.i = y.i JOIN w{t - 1} AS w ON w.j = c.j "
            f"WHERE {drawn('y.i', str(t), seed, fraction)} GROUP BY y.i)",
            f"w{t} AS (SELECT c.j, any_value(x) * (1 - {step} * {lam}) - {step} * sum(c.value * gap) / count(*) AS x "
            f"FROM p{t} AS p JOIN c ON c.i = p.i JOIN w{t - 1} AS w ON w.j = c.j GROUP BY c.j)",
        ]
    return (
        f"WITH {', '.join(parts)} SELECT {lam}::DOUBLE AS lam, j, CAST(0 AS INTEGER) AS rhs, {neat('x', 9)} AS x FROM w{steps}"
    )


def descent(features: list[str], target: str, source: str, lams: list[float], passes: int, digits: int) -> str:
    """Gauss-Seidel on the normal equations: what descent over one-column blocks computes."""
    n = len(features)
    columns = gram_columns(features) | {f"c{i}": f"{features[i]} * {target}" for i in range(n)}
    start = ", ".join(f"0.0::DOUBLE AS x{i}" for i in range(n))
    current = "SELECT * FROM w"
    for i in range(n):
        others = "".join(f" - {g(i, j)} * x{j}" for j in range(n) if j != i)
        kept = ", ".join(f"x{j}" if j != i else f"(c{i}{others}) / (g{i}{i} + lam) AS x{i}" for j in range(n))
        current = f"SELECT lam, step, {kept}, {', '.join(columns)} FROM ({current})"
    rows = [
        f"SELECT CAST({i} AS INTEGER) AS col_block, lam, CAST(0 AS INTEGER) AS j, CAST(0 AS INTEGER) AS rhs, "
        f"{neat(f'x{i}', digits)} AS x FROM w WHERE step = {passes}"
        for i in range(n)
    ]
    return f"""WITH RECURSIVE s AS ({sums(columns, source)}),
      w AS (SELECT lam, 0 AS step, {start}, s.* FROM s, {lambda_rows(lams)}
        UNION ALL
        SELECT lam, step + 1 AS step, {', '.join(f'x{i}' for i in range(n))}, {', '.join(columns)}
        FROM ({current.replace('FROM w', f'FROM w WHERE step < {passes}')}))
    """ + " UNION ALL ".join(rows)


def gradient(targets: list[tuple[str, float]], steps: int, with_target: bool = False) -> str:
    """Full-batch gradient steps on the moments of (disc, tax, target)."""
    parts = []
    for t, (target, lam) in enumerate(targets):
        columns = gram_columns(["disc", "tax"]) | {"c0": f"disc * ({target})", "c1": f"tax * ({target})"}
        parts.append(
            f"SELECT {t} AS target, {lam}::DOUBLE AS lam, * FROM ({sums(columns, SCALED)}), "
            f"(SELECT count(*)::DOUBLE AS m FROM {SCALED})"
        )
    rate = f"({SGD_RATE} / sqrt(t + 1.0))"
    x0 = f"x0 * (1 - {rate} * lam) - {rate} * (g00 * x0 + g01 * x1 - c0) / m AS x0"
    x1 = f"x1 * (1 - {rate} * lam) - {rate} * (g01 * x0 + g11 * x1 - c1) / m AS x1"
    label = "CAST(target AS INTEGER) AS target, " if with_target else ""
    rows = [
        f"SELECT {label}lam, CAST({j} AS INTEGER) AS j, CAST(0 AS INTEGER) AS rhs, {neat(f'x{j}', 9)} AS x "
        f"FROM w WHERE t = {steps}"
        for j in range(2)
    ]
    return f"""WITH RECURSIVE s AS ({' UNION ALL '.join(parts)}),
      w AS (SELECT target, lam, 0 AS t, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS x1, g00, g01, g11, c0, c1, m FROM s
        UNION ALL
        SELECT target, lam, t + 1 AS t, {x0}, {x1}, g00, g01, g11, c0, c1, m FROM w WHERE t < {steps})
    """ + " UNION ALL ".join(rows)


# -- one entry per query -------------------------------------------------------------------------------------

BLOCK_POSITION = f"""CAST(i // {R} AS INTEGER) AS block_row, CAST(j // {C} AS INTEGER) AS block_col,
  CAST(min(i) AS BIGINT) AS row_start, CAST(min(j) AS BIGINT) AS col_start,
  CAST(count(DISTINCT i) AS INTEGER) AS n_rows, CAST(count(DISTINCT j) AS INTEGER) AS n_cols"""

MIDDLE = f"i >= {LOW} AND i < {HIGH}"
SHIFTED_MIDDLE = f"SELECT CAST(i - {LOW} AS BIGINT) AS i"

ORACLES: dict[str, str] = {
    "from_table": cells_of(PART, "value"),
    "from_table_known_size": "SELECT CAST(p_partkey AS BIGINT) AS i, CAST(0 AS INTEGER) AS j, p_retailprice AS value FROM part",
    "from_table_null_as_zero": """SELECT CAST(p_partkey AS BIGINT) AS i, CAST(0 AS INTEGER) AS j,
      CASE WHEN p_size > 25 THEN p_retailprice ELSE 0.0 END AS value FROM part""",
    "from_array": cells_of(CELLS, "value"),
    "from_array_known_size": cells_of(CELLS, "value"),
    "from_strip_blocks": cells_of(CELLS, "value"),
    "block_grid": f"""SELECT block_row, block_col, n_rows, n_cols, {neat('total', 6)} AS block_sum FROM (
      SELECT {BLOCK_POSITION}, sum(value) AS total FROM {CELLS} GROUP BY i // {R}, j // {C})""",
    "grid_from_blocks": cells_of(CELLS, "value"),
    "to_long": cells_of(PART, "value", 4),
    "block_to_long": cells_of(CELLS, "value"),
    "dims": "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(2 AS BIGINT) AS n_cols FROM part",
    "block_dims": f"""SELECT CAST(count(DISTINCT i) AS BIGINT) AS n_rows, CAST(count(DISTINCT j) AS BIGINT) AS n_cols
      FROM {CELLS}""",
    "strip_dir": f"""SELECT CAST(strip AS BIGINT) AS strip_id, CAST(n AS BIGINT) AS n_rows,
      CAST(coalesce(sum(n) OVER (ORDER BY strip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
        AS start_row
      FROM (SELECT p_partkey // {STRIP} AS strip, count(*) AS n FROM part GROUP BY p_partkey // {STRIP})""",
    "block_dir": f"SELECT {BLOCK_POSITION} FROM {CELLS} GROUP BY i // {R}, j // {C}",
    "elem_add": cells_of(PART, "value + 2.5", 6),
    "elem_sub": cells_of(PART, "value - 2.5", 6),
    "elem_mul": cells_of(PART, "value * 1.5", 6),
    "elem_div": cells_of(PART, "value * (1.0 / 7.0)", 6),
    "elem_pow": cells_of(PART, "pow(value, 1.5)", 4),
    "elem_map": cells_of(PART, "sqrt(value) - cos(value)", 6),
    "elem_map_numpy": cells_of(CELLS, "tanh(value)", 8),
    "block_elem_scalar": cells_of(CELLS, "pow(((value + 1.0) * 3.0 - 0.5) / 7.0, 2.0)", 8),
    "block_elem_map": cells_of(CELLS, "sign(value) * sqrt(abs(value))", 8),
    "strip_map": cells_of(
        f"(SELECT i, j, value - avg(value) OVER (PARTITION BY i // {STRIP}, j) AS value FROM {CELLS})", "value", 9
    ),
    "strip_map_resize": f"""SELECT CAST(i // {STRIP} AS BIGINT) AS i, j, {neat('avg(value)', 9)} AS value FROM {CELLS}
      GROUP BY i // {STRIP}, j""",
    "mat_times_local": f"""SELECT i, CAST(0 AS INTEGER) AS j, {neat('sum(value * (j % 5 - 2.0))', 8)} AS value
      FROM {CELLS} GROUP BY i
      UNION ALL SELECT i, CAST(1 AS INTEGER), {neat('sum(value * (1.0 / (j + 1.0)))', 8)} FROM {CELLS} GROUP BY i""",
    "mat_times_local_wide": f"""SELECT i, CAST(k AS INTEGER) AS j, {neat('(k + 1) * total', 7)} AS value
      FROM (SELECT i, sum(value * (j % 5 - 2.0)) AS total FROM {CELLS} GROUP BY i), range(16) AS columns(k)""",
    "slice_rows": f"{SHIFTED_MIDDLE}, j, value FROM {CELLS} WHERE {MIDDLE}",
    "slice_cols": f"SELECT i, CAST(j - 8 AS INTEGER) AS j, value FROM {CELLS} WHERE j >= 8 AND j < 24",
    "slice_both": f"""{SHIFTED_MIDDLE}, CAST(j - 8 AS INTEGER) AS j, value FROM {CELLS}
      WHERE {MIDDLE} AND j >= 8 AND j < 24""",
    "slice_wide": f"""SELECT CAST(i - {PART_LOW} AS BIGINT) AS i, CAST(0 AS INTEGER) AS j, value FROM {PART}
      WHERE i >= {PART_LOW} AND i < {PART_HIGH} AND j = 1""",
    "block_slice_rows": f"{SHIFTED_MIDDLE}, j, value FROM {CELLS} WHERE {MIDDLE}",
    "block_slice_cols": f"SELECT i, CAST(j - 8 AS INTEGER) AS j, value FROM {CELLS} WHERE j >= 8 AND j < 24",
    "block_slice_both": f"""{SHIFTED_MIDDLE}, CAST(j - 8 AS INTEGER) AS j, value FROM {CELLS}
      WHERE {MIDDLE} AND j >= 8 AND j < 24""",
    "block_slice_dir": f"""SELECT CAST(i // {R} - {LOW} // {R} AS INTEGER) AS block_row,
      CAST(j // {C} AS INTEGER) AS block_col, CAST(min(i) - {LOW} AS BIGINT) AS row_start,
      CAST(min(j) - 8 AS BIGINT) AS col_start, CAST(count(DISTINCT i) AS INTEGER) AS n_rows,
      CAST(count(DISTINCT j) AS INTEGER) AS n_cols
      FROM {CELLS} WHERE {MIDDLE} AND j >= 8 AND j < 24 GROUP BY i // {R}, j // {C}""",
    "block_range": f"""WITH b AS (SELECT ((count(*) + {R - 1}) // {R}) // 4 * {R} AS first FROM embeddings)
      SELECT CAST(i - first AS BIGINT) AS i, CAST(j - {C} AS INTEGER) AS j, value FROM {CELLS}, b
      WHERE i >= first AND j >= {C} AND j < {4 * C}""",
    "col_block": f"SELECT i, CAST(j - {6 * C} AS INTEGER) AS j, value FROM {CELLS} WHERE j >= {6 * C}",
    "mat_add": cells_of(CELLS, "value + value * 2.0", 8),
    "mat_sub": cells_of(CELLS, "value - (value + 1.0)", 8),
    "block_add": cells_of(CELLS, "value + value * 2.0", 8),
    "block_sub": cells_of(CELLS, "value - (value + 1.0)", 8),
    "matrix_close": f"""SELECT {neat('max(abs(value - (value + 0.25)))', 8)} AS max_abs_diff,
      max(abs(value - (value + 0.25))) < 0.5 AS close FROM {CELLS}""",
    "matrix_not_close": f"""SELECT {neat('max(abs(value - (value + 4.0)))', 8)} AS max_abs_diff,
      max(abs(value - (value + 4.0))) < 1e-8 AS close FROM {CELLS}""",
    "co_partitioned_difference": f"""SELECT row_id AS i, CAST(0 AS INTEGER) AS j,
      {neat('(price + 10.0) - price', 8)} AS value FROM {ORDERS}""",
    "col_sum_events": f"SELECT CAST(0 AS INTEGER) AS j, {neat('sum(value)', 4)} AS value FROM events",
    "row_reduce_custom": f"SELECT i AS row_id, {neat('sqrt(sum(value * value))', 8)} AS value FROM {CELLS} GROUP BY i",
    "col_reduce_custom": f"SELECT j, {neat('sqrt(sum(value * value))', 8)} AS value FROM {CELLS} GROUP BY j",
    "block_col_reduce_custom": f"SELECT j, {neat('sqrt(sum(value * value))', 8)} AS value FROM {CELLS} GROUP BY j",
    "block_row_reduce_custom": f"""SELECT i AS row_id, {neat('sqrt(sum(value * value))', 8)} AS value FROM {CELLS}
      GROUP BY i""",
    "agg_fold": f"""SELECT CAST(count(*) AS BIGINT) AS n, {neat('sum(value)', 8)} AS total,
      {neat('max(abs(value))', 8)} AS largest FROM {CELLS}""",
    "norm_fro": f"SELECT {neat('sqrt(sum(qty * qty + price * price))', 4)} AS value FROM {LINES}",
    "norm_fro_array": f"SELECT {neat('sqrt(sum(value * value))', 8)} AS value FROM {CELLS}",
    "block_norm_fro": f"SELECT {neat('sqrt(sum(value * value))', 8)} AS value FROM {CELLS}",
    "gram": " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, sum({x} * {y}) AS value FROM {LINES}"
        for i, x in enumerate(["one", "qty", "line", "disc", "tax"])
        for j, y in enumerate(["one", "qty", "line", "disc", "tax"])
    ),
    "gram_wide": f"""WITH c AS (SELECT * FROM {CELLS})
      SELECT a.j AS i, b.j AS j, {neat('sum(a.value * b.value)', 7)} AS value FROM c AS a JOIN c AS b ON a.i = b.i
      GROUP BY a.j, b.j""",
    "mat_mul": f"""WITH c AS (SELECT * FROM {CELLS}),
      g AS (SELECT a.j AS k, b.j AS j, sum(a.value * b.value) AS value FROM c AS a JOIN c AS b ON a.i = b.i GROUP BY a.j, b.j)
      SELECT c.i, g.j, {neat('sum(c.value * g.value)', 6)} AS value FROM c JOIN g ON c.j = g.k GROUP BY c.i, g.j""",
    "block_mul": f"""WITH c AS (SELECT * FROM {CELLS})
      SELECT CAST(a.j AS BIGINT) AS i, b.j AS j, {neat('sum(a.value * b.value)', 7)} AS value FROM c AS a JOIN c AS b ON a.i = b.i
      GROUP BY a.j, b.j""",
    "block_transpose": f"SELECT CAST(j AS BIGINT) AS i, CAST(i AS INTEGER) AS j, value FROM {CELLS}",
    "mat_transpose": f"SELECT CAST(j AS BIGINT) AS i, CAST(i AS INTEGER) AS j, value FROM {CELLS}",
    "transpose_twice": cells_of(CELLS, "value"),
    "column_blocks": cells_of(CELLS, "value"),
    "column_parts": f"SELECT i, CAST(j - 8 AS INTEGER) AS j, value FROM {CELLS} WHERE j >= 8 AND j < 56",
    "svd_u": pair_u(),
    "svd_u_direct": pair_u(),
    "svd_v": f"""WITH {pair_svd()}
      SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS INTEGER) AS j, {neat('a', 9)} AS value FROM v
      UNION ALL SELECT 1, 0, {neat('b', 9)} FROM v
      UNION ALL SELECT 0, 1, {neat('c', 9)} FROM v
      UNION ALL SELECT 1, 1, {neat('d', 9)} FROM v""",
    "svd_truncated": f"""WITH {pair_svd()}
      SELECT row_id AS i, CAST(0 AS INTEGER) AS j, {neat('(price * a + group7 * b) * a', 7)} AS value FROM {ORDERS} AS o, v
      UNION ALL SELECT row_id, CAST(1 AS INTEGER), {neat('(price * a + group7 * b) * b', 7)} FROM {ORDERS} AS o, v""",
    "svd_checks": """SELECT * FROM (VALUES ('left', 0.0::DOUBLE), ('right', 0.0::DOUBLE), ('rebuilt', 0.0::DOUBLE),
      ('rank', 2.0::DOUBLE)) AS c("check", value)""",
    "norm_two": f"WITH {pair_spectrum()} SELECT {neat('hi', 4)} AS value FROM v",
    "sgd_mini_batch": sampled_gradient([0.0, 0.1], SGD_STEPS, 0.05),
    "sgd_mini_batch_wide": sampled_gradient_wide(0.1, 5, 0.5),
    "gram_many_rhs": " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, sum({x} * {y}) AS value FROM {LINES}"
        for i, x in enumerate(["one", "qty", "disc"])
        for j, y in enumerate(["one", "qty", "disc", "tax", "line"])
    ),
    "tsqr_r": cholesky(["qty", "line", "disc"], LINES, 4).replace("{i_type}", "INTEGER"),
    "tsqr_q": order_q(),
    "tsqr_q_direct": order_q(),
    "tsqr_q_checks": "SELECT 'orthogonality' AS check, 0.0::DOUBLE AS value UNION ALL SELECT 'reconstruction', 0.0::DOUBLE",
    "cond_numbers": f"""WITH {pair_spectrum()},
      r AS (SELECT *, sqrt(g00) AS r00, g01 / sqrt(g00) AS r01, sqrt(g11 - g01 * g01 / g00) AS r11 FROM v)
      SELECT {neat('greatest(r00, abs(r01) + r11) * greatest(1 / r00, abs(r01) / (r00 * r11) + 1 / r11)', 6)} AS cond_1,
        {neat('hi / lo', 6)} AS cond_2 FROM r""",
    "svd_values": f"""WITH {pair_spectrum()}
      SELECT CAST(0 AS INTEGER) AS i, {neat('hi', 4)} AS sigma FROM v
      UNION ALL SELECT CAST(1 AS INTEGER), {neat('lo', 4)} FROM v""",
    "block_qr_r": cholesky(
        [f"f{j}" for j in range(6)],
        "(SELECT " + ", ".join(f"embedding[{j + 1}]::DOUBLE AS f{j}" for j in range(6)) + " FROM embeddings)",
        8,
    ).replace("{i_type}", "BIGINT"),
    "block_to_rows": cells_of(CELLS, "value"),
    "lsq_normal": ridge(["one", "qty", "disc"], ["price"], LINES, [0.0]),
    "lsq_tsqr": ridge(["one", "qty", "disc"], ["price"], LINES, [0.0]),
    "ridge_normal": ridge(["one", "qty", "disc"], ["price"], LINES, LAMBDAS),
    "ridge_tsqr": ridge(["one", "qty", "disc"], ["price"], LINES, LAMBDAS),
    "ridge_many_rhs": ridge(["one", "qty", "disc"], ["price", "tax"], LINES, LAMBDAS),
    "ridge_aligned": ridge(["one", "group7"], ["price"], ORDERS, [10.0]),
    "lsq_many_targets_normal": shifted_targets(7),
    "lsq_many_targets_tsqr": shifted_targets(7),
    "sgd_ls": gradient([("price", 0.0)], SGD_STEPS),
    "sgd_ridge": gradient([("price", 0.0), ("price", 0.1)], SGD_STEPS),
    "sgd_targets": gradient([("price - 0.5 * tax", 0.0), ("price - 0.25 * disc", 0.1)], SGD_STEPS, with_target=True),
    "sgd_by_steps": gradient([("price", 0.1)], 5),
    "bcd_normal": descent(["one", "qty", "disc"], "price", LINES, [0.0, 10.0], DESCENTS, 7),
    "bcd_tsqr": descent(["one", "qty", "disc"], "price", LINES, [0.0, 10.0], DESCENTS, 7),
    "bcd_streaming": descent(["one", "group7"], "price", ORDERS, [0.0, 10.0], 2, 7),
    "bcd_one_pass": f"""SELECT col_block, lam, x FROM (
      {descent(['one', 'group7'], 'price', ORDERS, [0.0, 10.0], 1, 7)})""",
    "residual_norms": f"""SELECT {neat('sqrt(sum(gap * gap))', 4)} AS value
      FROM (SELECT price - (one + 0.5 * qty - 0.25 * disc) AS gap FROM {LINES})""",
    "residual_norm_of_fit": f"""WITH fit AS ({ridge(['one', 'qty', 'disc'], ['price'], LINES, [0.0], 12)}),
      x AS (SELECT sum(x) FILTER (j = 0) AS x0, sum(x) FILTER (j = 1) AS x1, sum(x) FILTER (j = 2) AS x2 FROM fit)
      SELECT {neat('sqrt(sum(gap * gap))', 4)} AS value
      FROM (SELECT price - (one * x0 + x1 * qty + x2 * disc) AS gap FROM {LINES}, x)""",
    "rel_error": f"""WITH fit AS ({ridge(['one', 'qty', 'disc'], ['price'], LINES, [0.0, 1000.0], 14)}),
      pair AS (SELECT sum(x) FILTER (lam = 1000.0) AS x, sum(x) FILTER (lam = 0.0) AS t FROM fit GROUP BY j)
      SELECT {neat('sqrt(sum((x - t) * (x - t))) / sqrt(sum(t * t))', 8)} AS value FROM pair""",
    "random_uniform": """SELECT CAST(8 * count(*) AS BIGINT) AS n, 0.5::DOUBLE AS mean, 0.3::DOUBLE AS spread,
      CAST(8 * count(*) AS BIGINT) AS different FROM orders""",
    "random_normal": """SELECT CAST(8 * count(*) AS BIGINT) AS n, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS spread,
      CAST(8 * count(*) AS BIGINT) AS different FROM orders""",
    "linear_system_checks": """SELECT condition, CAST(n AS BIGINT) AS n_rows, 1.0::DOUBLE AS residual_ratio,
      1.0::DOUBLE AS cond_ratio FROM (SELECT count(*) AS n FROM orders),
      (VALUES (1.0::DOUBLE), (10.0::DOUBLE), (1000.0::DOUBLE)) AS c(condition)""",
    "accuracy_sweep": """SELECT solver, condition, condition <= best AS four_digits FROM
      (VALUES ('tsqr', 1e9::DOUBLE), ('normal', 1e6::DOUBLE), ('sgd', 0.0::DOUBLE)) AS s(solver, best),
      (VALUES (1.0::DOUBLE), (10.0::DOUBLE), (1e3::DOUBLE), (1e6::DOUBLE), (1e9::DOUBLE), (1e12::DOUBLE),
        (1e15::DOUBLE)) AS c(condition)""",
}

ORACLES["block_qr_gram"] = ORACLES["gram_wide"]
ORACLES["gram_tiles"] = ORACLES["gram_wide"]
ORACLES["mat_mul_rows"] = ORACLES["mat_mul"]
ORACLES["stored_blocks_slice"] = ORACLES["stored_rows_slice"] = ORACLES["block_slice_both"]

_FOLDS = {"sum": "sum", "prod": "product", "min": "min", "max": "max"}

for _op, _fold in _FOLDS.items():
    ORACLES[f"row_{_op}"] = (
        f"SELECT i AS row_id, {neat(f'{_fold}(value)', 4)} AS value FROM {PART} GROUP BY i"
    )
    for _prefix, _suffix in (("row", "_array"), ("block_row", "")):
        ORACLES[f"{_prefix}_{_op}{_suffix}"] = (
            f"SELECT i AS row_id, {neat(f'{_fold}(value + 1.0)', 8)} AS value FROM {CELLS} GROUP BY i"
        )
    for _prefix in ("col", "block_col"):
        ORACLES[f"{_prefix}_{_op}"] = (
            f"SELECT j, {neat(f'{_fold}(value * 0.01 + 1.0)', 8)} AS value FROM {CELLS} GROUP BY j"
        )
    ORACLES[f"reduce_all_{_op}"] = f"SELECT {neat(f'{_fold}(value * 0.01 + 1.0)', 6)} AS value FROM {CELLS}"
