"""SQL twins of the queries.

Trainers are unrolled: one materialised CTE per quantity and iteration, with the
2 x 2 systems of a shard solved by Cramer's rule.
"""

from __future__ import annotations

from checks.fixtures import EMB, EMB_PRODUCTS, EVENT2, EVENT_SMALL, LOGIT2, ORDERS2, RIDGE2, RIDGE3

W = (0.3, -0.2)
P = (0.15, -0.4)


def r(expr: str, name: str) -> str:
    return f"round({expr}, 7) + 0.0 AS {name}"


def with_query(ctes: list[tuple[str, str]], final: str) -> str:
    body = ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in ctes)
    return f"WITH {body}\n{final}"


# ---- losses as SQL text ----------------------------------------------------


class Logistic:
    steps = 10

    @staticmethod
    def value(t, y="y"):
        z = f"({y} * ({t}))"
        return f"(greatest(-{z}, 0.0) + ln(1.0 + exp(-abs({z}))))"

    @staticmethod
    def slope(t, y="y"):
        return f"(-{y} / (1.0 + exp({y} * ({t}))))"

    @staticmethod
    def curvature(t, y="y"):
        return f"(exp(-abs({t})) / pow(1.0 + exp(-abs({t})), 2))"

    @staticmethod
    def mistake(t, y="y"):
        return f"(CASE WHEN {y} * ({t}) < 1e-30 THEN 1.0 ELSE 0.0 END)"


class Squared:
    steps = 3

    @staticmethod
    def value(t, y="y"):
        return f"(0.5 * pow(({t}) - {y}, 2))"

    @staticmethod
    def slope(t, y="y"):
        return f"(({t}) - {y})"

    @staticmethod
    def curvature(t, y="y"):
        return "(1.0)"

    @staticmethod
    def mistake(t, y="y"):
        return f"pow(({t}) - {y}, 2)"


def evaluation(loss, at: str, l2: float, l1: float = 0.0, data: str = "d") -> str:
    """One row ``w0, w1, n, f, err, g0, g1`` at the weights in CTE ``at``."""
    c = loss.slope("t")
    return f"""
  SELECT w0, w1, n, v / n + {l1} * (abs(w0) + abs(w1)) + 0.5 * {l2} * (w0*w0 + w1*w1) AS f,
    e / n AS err, a0 / n + {l2} * w0 AS g0, a1 / n + {l2} * w1 AS g1
  FROM (SELECT w0, w1, count(*) AS n, sum({loss.value('t')}) AS v, sum({loss.mistake('t')}) AS e,
          sum({c} * x0) AS a0, sum({c} * x1) AS a1
        FROM (SELECT {data}.*, w0, w1, x0*w0 + x1*w1 AS t FROM {data}, {at}) GROUP BY w0, w1)"""


def steps_values(count: int) -> str:
    rows = ", ".join(f"({k}, {0.25**k!r}::DOUBLE)" for k in range(count))
    return f"SELECT * FROM (VALUES {rows}) AS v(k, eta)"


def line(loss, ev: str, direction: str, l2: float, l1: float = 0.0) -> str:
    """Objective and directional slope for each step from ``ev`` along ``direction``."""
    v0, v1 = "(w0 - eta*p0)", "(w1 - eta*p1)"
    return f"""
  SELECT k, eta, sum({loss.value('t - eta*q')}) / count(*)
      + {l1} * (abs(any_value({v0})) + abs(any_value({v1})))
      + 0.5 * {l2} * (any_value({v0}*{v0}) + any_value({v1}*{v1})) AS f,
    sum({loss.slope('t - eta*q')} * q) / count(*)
      + {l2} * any_value(p0*{v0} + p1*{v1}) AS slope
  FROM (SELECT y, x0*w0 + x1*w1 AS t, x0*p0 + x1*p1 AS q, w0, w1, p0, p1
        FROM d, {ev}, {direction}), etas GROUP BY k, eta"""


def armijo(ls: str, ev: str, direction: str, c: float, last: int) -> str:
    return f"""
  SELECT eta FROM {ls} WHERE k = coalesce((SELECT min(k) FROM {ls}, {ev}, {direction}
    WHERE {ls}.f <= {ev}.f - {c} * eta * (p0*g0 + p1*g1)), {last})"""


def moved(ev: str, direction: str, pick: str) -> str:
    return f"SELECT w0 - eta*p0 AS w0, w1 - eta*p1 AS w1 FROM {ev}, {direction}, {pick}"


def newton_direction(loss, ev: str, l2: float) -> str:
    k = loss.curvature("t")
    return f"""
  SELECT sum(s * (h11*g0 - h01*g1) / (h00*h11 - h01*h01)) / any_value(n) AS p0,
         sum(s * (h00*g1 - h01*g0) / (h00*h11 - h01*h01)) / any_value(n) AS p1
  FROM (SELECT shard, count(*) AS s, sum({k}*x0*x0) / count(*) + {l2} AS h00,
          sum({k}*x0*x1) / count(*) AS h01, sum({k}*x1*x1) / count(*) + {l2} AS h11
        FROM (SELECT d.*, x0*w0 + x1*w1 AS t FROM d, {ev}) GROUP BY shard), {ev}"""


ZERO = "SELECT 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1"


def history(n_rows: int, step_of, extra: str = "") -> str:
    """The iteration table from CTEs ``e0..``; ``step_of(t)`` is the step expression."""
    parts = []
    for t in range(n_rows):
        step = step_of(t) if t < n_rows - 1 else "NULL"
        parts.append(
            f"SELECT {t}::BIGINT AS iter, {r('f', 'objective')}, {r('err', 'train_error')}, "
            f"{r('g0*g0 + g1*g1', 'grad_norm_sq')}, {r(f'({step})::DOUBLE', 'step')}, "
            f"{r('w0', 'w0')}, {r('w1', 'w1')}{extra} FROM e{t}"
        )
    return "\nUNION ALL ".join(parts)


def newton(data: str, loss, l2: float, iters: int) -> str:
    ctes = [("d", data), ("etas", steps_values(loss.steps)), ("w_0", ZERO)]
    for t in range(iters):
        ctes += [
            (f"e{t}", evaluation(loss, f"w_{t}", l2)),
            (f"p{t}", newton_direction(loss, f"e{t}", l2)),
            (f"l{t}", line(loss, f"e{t}", f"p{t}", l2)),
            (f"k{t}", armijo(f"l{t}", f"e{t}", f"p{t}", 0.01, loss.steps - 1)),
            (f"w_{t + 1}", moved(f"e{t}", f"p{t}", f"k{t}")),
        ]
    ctes.append((f"e{iters}", evaluation(loss, f"w_{iters}", l2)))
    return with_query(ctes, history(iters + 1, lambda t: f"SELECT eta FROM k{t}"))


def newton_fixed_step(data: str, loss, l2: float, iters: int) -> str:
    ctes = [("d", data), ("w_0", ZERO)]
    for t in range(iters):
        ctes += [
            (f"e{t}", evaluation(loss, f"w_{t}", l2)),
            (f"p{t}", newton_direction(loss, f"e{t}", l2)),
            (f"w_{t + 1}", f"SELECT w0 - p0 AS w0, w1 - p1 AS w1 FROM e{t}, p{t}"),
        ]
    ctes.append((f"e{iters}", evaluation(loss, f"w_{iters}", l2)))
    return with_query(ctes, history(iters + 1, lambda t: "1.0"))


# ---- epochs on shards of one batch: every epoch is one step of the local gradient ---------


def local_slopes(state: str) -> str:
    """Mean slopes of every shard at its own ``v0, v1``, with what else the state holds."""
    c = Logistic.slope("t")
    return f"""
  SELECT st.*, a0, a1 FROM {state} st JOIN (
    SELECT shard, avg({c} * x0) AS a0, avg({c} * x1) AS a1
    FROM (SELECT d.*, x0*v0 + x1*v1 AS t FROM d JOIN {state} USING (shard)) GROUP BY shard) USING (shard)"""


def epochs(name: str, state: str, passes: int, rate: float, ridge: float, weight: str) -> list[tuple[str, str]]:
    """CTEs that move ``v0, v1`` of ``state``, whose shifts are ``h0, h1``; the last one is ``name``."""
    ctes, now = [], state
    for k in range(passes):
        after = name if k == passes - 1 else f"{name}_{k}"
        ctes += [
            (f"{name}_a{k}", local_slopes(now)),
            (
                after,
                f"""SELECT * EXCLUDE (v0, v1, a0, a1),
    v0 - {rate} * ({weight} * a0 + h0 + {ridge} * v0) AS v0,
    v1 - {rate} * ({weight} * a1 + h1 + {ridge} * v1) AS v1 FROM {name}_a{k}""",
            ),
        ]
        now = after
    return ctes


SHARD_SIZES = "SELECT shard, count(*)::DOUBLE AS s, any_value(n)::DOUBLE AS n FROM d, (SELECT count(*) AS n FROM d) GROUP BY shard"


def dane_path(data: str, l2: float, iters: int, passes: int, rate: float, search: bool) -> str:
    ctes = [("d", data), ("etas", steps_values(Logistic.steps)), ("sizes", SHARD_SIZES), ("w_0", ZERO)]
    for t in range(iters):
        ctes += [
            (f"e{t}", evaluation(Logistic, f"w_{t}", l2)),
            (f"i{t}", f"SELECT shard, w0 AS v0, w1 AS v1 FROM sizes, w_{t}"),
            (f"g{t}", local_slopes(f"i{t}")),
            (
                f"b{t}",
                f"""SELECT shard, v0, v1, g0 - (a0 + {l2} * v0) AS h0, g1 - (a1 + {l2} * v1) AS h1
    FROM g{t}, (SELECT g0, g1 FROM e{t})""",
            ),
            *epochs(f"v{t}", f"b{t}", passes, rate, l2, "1.0"),
            (f"p{t}", f"SELECT avg(w0 - v0) AS p0, avg(w1 - v1) AS p1 FROM v{t}, w_{t}"),
        ]
        if search:
            ctes += [
                (f"l{t}", line(Logistic, f"e{t}", f"p{t}", l2)),
                (f"k{t}", armijo(f"l{t}", f"e{t}", f"p{t}", 0.01, Logistic.steps - 1)),
            ]
        else:
            ctes.append((f"k{t}", "SELECT 1.0::DOUBLE AS eta"))
        ctes.append((f"w_{t + 1}", moved(f"e{t}", f"p{t}", f"k{t}")))
    ctes.append((f"e{iters}", evaluation(Logistic, f"w_{iters}", l2)))
    return with_query(ctes, history(iters + 1, lambda t: f"SELECT eta FROM k{t}"))


def admm_logistic_path(data: str, l2: float, iters: int, passes: int, rate: float, rho: float) -> str:
    ctes = [
        ("d", data),
        ("sizes", SHARD_SIZES),
        ("m", "SELECT count(*)::DOUBLE AS m FROM sizes"),
        ("w_0", ZERO),
        ("s0", "SELECT shard, s * m / n AS c, 0.0::DOUBLE AS v0, 0.0::DOUBLE AS v1, 0.0::DOUBLE AS d0, 0.0::DOUBLE AS d1 FROM sizes, m"),
    ]
    for t in range(iters):
        dual = "" if t == 0 else " + v{0} - w{0}"
        ctes += [
            (f"e{t}", evaluation(Logistic, f"w_{t}", l2)),
            (
                f"a{t}",
                f"""SELECT shard, c, v0, v1, d0{dual.format(0)} AS d0, d1{dual.format(1)} AS d1, w0 AS u0, w1 AS u1
    FROM s{t}, w_{t}""",
            ),
            (f"b{t}", f"SELECT *, {rho} * (d0 - u0) AS h0, {rho} * (d1 - u1) AS h1 FROM a{t}"),
            *epochs(f"v{t}", f"b{t}", passes, rate, rho, "c"),
            (f"s{t + 1}", f"SELECT shard, c, v0, v1, d0, d1 FROM v{t}"),
            (
                f"w_{t + 1}",
                f"SELECT avg(v0 + d0) * {rho} / ({l2} + {rho}) AS w0, avg(v1 + d1) * {rho} / ({l2} + {rho}) AS w1 FROM v{t}",
            ),
        ]
    ctes.append((f"e{iters}", evaluation(Logistic, f"w_{iters}", l2)))
    return with_query(ctes, history(iters + 1, lambda t: "1.0"))


def averaged_ctes(data: str, l2: float, passes: int, rate: float) -> list[tuple[str, str]]:
    """The data as ``d`` and the average of shard models as ``w_0``."""
    return [
        ("d", data),
        ("sizes", SHARD_SIZES),
        ("b", "SELECT shard, s, n, 0.0::DOUBLE AS v0, 0.0::DOUBLE AS v1, 0.0::DOUBLE AS h0, 0.0::DOUBLE AS h1 FROM sizes"),
        *epochs("v", "b", passes, rate, l2, "1.0"),
        ("w_0", "SELECT sum(s * v0) / any_value(n) AS w0, sum(s * v1) / any_value(n) AS w1 FROM v"),
    ]


def averaged_path(data: str, l2: float, passes: int, rate: float) -> str:
    final = f"SELECT j::BIGINT AS j, {r('CASE j WHEN 0 THEN w0 ELSE w1 END', 'w')} FROM w_0, range(2) AS t(j)"
    return with_query(averaged_ctes(data, l2, passes, rate), final)


def newton_warm_start(data: str, l2: float, passes: int, rate: float) -> str:
    ctes = averaged_ctes(data, l2, passes, rate) + [
        ("etas", steps_values(Logistic.steps)),
        ("e0", evaluation(Logistic, "w_0", l2)),
        ("p0", newton_direction(Logistic, "e0", l2)),
        ("l0", line(Logistic, "e0", "p0", l2)),
        ("k0", armijo("l0", "e0", "p0", 0.01, Logistic.steps - 1)),
        ("w_1", moved("e0", "p0", "k0")),
        ("e1", evaluation(Logistic, "w_1", l2)),
    ]
    return with_query(ctes, history(2, lambda t: f"SELECT eta FROM k{t}"))


def prox_direction(ev: str, l1: float, l2: float) -> str:
    """Per shard, the best of all nine sign patterns of the local problem, then averaged.

    The minimiser of a convex quadratic plus ``l1 |v|_1`` solves the linear system
    of its own sign pattern, so the best candidate by true value is exact.
    """
    k = Logistic.curvature("t")
    value = (
        "0.5*(h00*v0*v0 + 2*h01*v0*v1 + h11*v1*v1) - b0*v0 - b1*v1 "
        f"+ {l1}*(abs(v0) + abs(v1))"
    )
    both = "(h00*h11 - h01*h01)"
    v0 = f"""CASE WHEN s0 = 0 THEN 0.0 WHEN s1 = 0 THEN (b0 - {l1}*s0) / h00
        ELSE (h11*(b0 - {l1}*s0) - h01*(b1 - {l1}*s1)) / {both} END"""
    v1 = f"""CASE WHEN s1 = 0 THEN 0.0 WHEN s0 = 0 THEN (b1 - {l1}*s1) / h11
        ELSE (h00*(b1 - {l1}*s1) - h01*(b0 - {l1}*s0)) / {both} END"""
    return f"""
  SELECT sum(s*(w0 - v0)) / any_value(n) AS p0, sum(s*(w1 - v1)) / any_value(n) AS p1 FROM (
    SELECT shard, any_value(s) AS s, any_value(n) AS n, any_value(w0) AS w0, any_value(w1) AS w1,
      arg_min(v0, q) AS v0, arg_min(v1, q) AS v1
    FROM (SELECT *, {value} AS q FROM (
      SELECT *, {v0} AS v0, {v1} AS v1 FROM (
        SELECT *, h00*w0 + h01*w1 - g0 AS b0, h01*w0 + h11*w1 - g1 AS b1 FROM (
          SELECT shard, count(*) AS s, sum({k}*x0*x0) / count(*) + {l2} AS h00,
            sum({k}*x0*x1) / count(*) AS h01, sum({k}*x1*x1) / count(*) + {l2} AS h11
          FROM (SELECT d.*, x0*w0 + x1*w1 AS t FROM d, {ev}) GROUP BY shard), {ev}),
        (VALUES (-1), (0), (1)) AS a(s0), (VALUES (-1), (0), (1)) AS b(s1)))
    GROUP BY shard)"""


def prox_newton(data: str, l1: float, l2: float, iters: int) -> str:
    loss = Logistic
    ctes = [("d", data), ("etas", steps_values(loss.steps)), ("w_0", ZERO)]
    for t in range(iters):
        ctes += [
            (f"e{t}", evaluation(loss, f"w_{t}", l2, l1)),
            (f"p{t}", prox_direction(f"e{t}", l1, l2)),
            (f"l{t}", line(loss, f"e{t}", f"p{t}", l2, l1)),
            (f"k{t}", armijo(f"l{t}", f"e{t}", f"p{t}", 0.0, loss.steps - 1)),
            (f"w_{t + 1}", moved(f"e{t}", f"p{t}", f"k{t}")),
        ]
    ctes.append((f"e{iters}", evaluation(loss, f"w_{iters}", l2, l1)))
    return with_query(ctes, enet_history(iters + 1, lambda t: f"SELECT eta FROM k{t}"))


def enet_history(n_rows: int, step_of) -> str:
    parts = []
    for t in range(n_rows):
        step = step_of(t) if t < n_rows - 1 else "NULL"
        parts.append(
            f"SELECT {t}::BIGINT AS iter, {r('f', 'objective')}, {r('err', 'train_error')}, "
            f"{r(f'({step})::DOUBLE', 'step')}, {r('w0', 'w0')}, {r('w1', 'w1')} FROM e{t}"
        )
    return "\nUNION ALL ".join(parts)


def momentum_ctes(loss, l2, iters, rate, beta, tag="", data="d"):
    ctes = [
        (f"w{tag}_0", ZERO),
        (f"v{tag}_0", "SELECT 0.0::DOUBLE AS v0, 0.0::DOUBLE AS v1"),
    ]
    for t in range(iters):
        ctes += [
            (f"e{tag}{t}", evaluation(loss, f"w{tag}_{t}", l2, data=data)),
            (
                f"v{tag}_{t + 1}",
                f"SELECT {beta}*v0 + g0 AS v0, {beta}*v1 + g1 AS v1 FROM e{tag}{t}, v{tag}_{t}",
            ),
            (
                f"w{tag}_{t + 1}",
                f"SELECT w0 - {rate}*v0 AS w0, w1 - {rate}*v1 AS w1 FROM e{tag}{t}, v{tag}_{t + 1}",
            ),
        ]
    ctes.append((f"e{tag}{iters}", evaluation(loss, f"w{tag}_{iters}", l2, data=data)))
    return ctes


def momentum(data: str, l2: float, iters: int, rate: float, beta: float) -> str:
    ctes = [("d", data)] + momentum_ctes(Logistic, l2, iters, rate, beta)
    return with_query(ctes, history(iters + 1, lambda t: str(rate)))


def sweep(data: str, l2: float, iters: int, settings: dict[str, tuple[float, float]]) -> str:
    ctes, parts = [("d", data)], []
    for i, (run_id, (rate, beta)) in enumerate(settings.items()):
        ctes += momentum_ctes(Logistic, l2, iters, rate, beta, tag=f"r{i}x")
        for t in range(iters + 1):
            parts.append(
                f"SELECT '{run_id}' AS run_id, {t}::BIGINT AS iter, {r('f', 'objective')}, "
                f"{r('err', 'train_error')}, {r('g0*g0 + g1*g1', 'grad_norm_sq')} FROM er{i}x{t}"
            )
    return with_query(ctes, "\nUNION ALL ".join(parts))


def holdout(data: str, l2: float, iters: int, rate: float, beta: float) -> str:
    ctes = [
        ("every_row", data),
        ("d", "SELECT * FROM every_row WHERE id % 5 <> 0"),
        ("test", "SELECT * FROM every_row WHERE id % 5 = 0"),
    ] + momentum_ctes(Logistic, l2, iters, rate, beta)
    mistake = Logistic.mistake("x0*w0 + x1*w1")
    parts = [
        f"SELECT {t}::BIGINT AS iter, {r('f', 'objective')}, {r('err', 'train_error')}, "
        f"{r(f'(SELECT avg({mistake}) FROM test, w_{t})', 'test_error')} FROM e{t}"
        for t in range(iters + 1)
    ]
    return with_query(ctes, "\nUNION ALL ".join(parts))


def lbfgs(data: str, loss, l2: float) -> str:
    """Two iterations: the gradient step, then one quasi-Newton step with one pair."""
    last = loss.steps - 1

    def wolfe(t):
        return f"""
  SELECT eta FROM l{t} WHERE k = coalesce((SELECT min(k) FROM l{t}, e{t}, p{t}
    WHERE l{t}.f <= e{t}.f - 0.1 * eta * (p0*g0 + p1*g1)
      AND l{t}.slope <= 0.9 * (p0*g0 + p1*g1)), (SELECT min(k) FROM l{t}, e{t}, p{t}
    WHERE l{t}.f <= e{t}.f - 0.1 * eta * (p0*g0 + p1*g1)), {last})"""

    pair = """
  SELECT b.g0, b.g1, b.w0 - a.w0 AS s0, b.w1 - a.w1 AS s1, b.g0 - a.g0 AS y0, b.g1 - a.g1 AS y1
  FROM e0 a, e1 b"""
    direction = """
  SELECT q0 + (a - (y0*q0 + y1*q1) / sy) * s0 AS p0, q1 + (a - (y0*q0 + y1*q1) / sy) * s1 AS p1
  FROM (SELECT *, (g0 - a*y0) * sy / (y0*y0 + y1*y1) AS q0,
               (g1 - a*y1) * sy / (y0*y0 + y1*y1) AS q1
        FROM (SELECT *, (s0*g0 + s1*g1) / sy AS a
              FROM (SELECT *, s0*y0 + s1*y1 AS sy FROM pair)))"""
    ctes = [("d", data), ("etas", steps_values(loss.steps)), ("w_0", ZERO)]
    for t in range(2):
        ctes.append((f"e{t}", evaluation(loss, f"w_{t}", l2)))
        if t == 0:
            ctes.append(("p0", "SELECT g0 AS p0, g1 AS p1 FROM e0"))
        else:
            ctes += [("pair", pair), ("p1", direction)]
        ctes += [
            (f"l{t}", line(loss, f"e{t}", f"p{t}", l2)),
            (f"k{t}", wolfe(t)),
            (f"w_{t + 1}", moved(f"e{t}", f"p{t}", f"k{t}")),
        ]
    ctes.append(("e2", evaluation(loss, "w_2", l2)))
    return with_query(ctes, history(3, lambda t: f"SELECT eta FROM k{t}"))


def cg(data: str, l2: float) -> str:
    ctes = [
        ("d", data),
        (
            "m",
            "SELECT count(*) AS n, sum(x0*x0) AS a, sum(x0*x1) AS b, sum(x1*x1) AS c, "
            "sum(x0*y) AS u, sum(x1*y) AS v FROM d",
        ),
        ("w_0", ZERO),
        ("s0", "SELECT u AS r0, v AS r1, u AS p0, v AS p1 FROM m"),
    ]
    for t in range(2):
        ctes += [
            (
                f"q{t}",
                f"""SELECT *, (r0*r0 + r1*r1) / (p0*q0 + p1*q1) AS alpha FROM (
          SELECT r0, r1, p0, p1, (a + n*{l2})*p0 + b*p1 AS q0, b*p0 + (c + n*{l2})*p1 AS q1
          FROM s{t}, m)""",
            ),
            (
                f"w_{t + 1}",
                f"SELECT w0 + alpha*p0 AS w0, w1 + alpha*p1 AS w1 FROM w_{t}, q{t}",
            ),
            (
                f"s{t + 1}",
                f"""SELECT n0 AS r0, n1 AS r1, n0 + bt*p0 AS p0, n1 + bt*p1 AS p1 FROM (
          SELECT *, (n0*n0 + n1*n1) / (r0*r0 + r1*r1) AS bt FROM (
            SELECT *, r0 - alpha*q0 AS n0, r1 - alpha*q1 AS n1 FROM q{t}))""",
            ),
        ]
    ctes += [(f"e{t}", evaluation(Squared, f"w_{t}", l2)) for t in range(3)]
    return with_query(ctes, history(3, lambda t: f"SELECT alpha FROM q{t}"))


def fista(data: str, l1: float, l2: float, iters: int, lip: float, in_prox: bool) -> str:
    loss, grown = Logistic, 1.0
    ctes = [("d", data), ("w_0", ZERO), ("a_0", ZERO)]
    scale = 1.0 + l2 / lip if in_prox else 1.0
    for t in range(iters):
        new = 0.5 * (1.0 + (1.0 + 4.0 * grown * grown) ** 0.5)
        carry = (grown - 1.0) / new
        grown = new
        by = l1 / lip
        moved_by = [f"(w{j} - g{j} / {lip})" for j in (0, 1)]
        shrunk = [
            f"sign({v}) * greatest(abs({v}) - {by}, 0.0) / {scale} AS w{j}"
            for j, v in enumerate(moved_by)
        ]
        ctes += [
            (f"e{t}", evaluation(loss, f"w_{t}", l2, l1)),
            (f"g{t}", evaluation(loss, f"a_{t}", 0.0 if in_prox else l2)),
            (f"w_{t + 1}", f"SELECT {', '.join(shrunk)} FROM g{t}"),
            (
                f"a_{t + 1}",
                f"SELECT n.w0 + {carry} * (n.w0 - o.w0) AS w0, n.w1 + {carry} * (n.w1 - o.w1) AS w1 "
                f"FROM w_{t + 1} n, w_{t} o",
            ),
        ]
    ctes.append((f"e{iters}", evaluation(loss, f"w_{iters}", l2, l1)))
    return with_query(ctes, enet_history(iters + 1, lambda t: str(1.0 / lip)))


def admm_ridge(data: str, l2: float, iters: int, rho: float) -> str:
    ctes = [
        ("d", data),
        (
            "g",
            """SELECT *, count(*) OVER () AS m, sum(s) OVER () AS n FROM (
      SELECT shard, count(*) AS s, sum(x0*x0) AS a, sum(x0*x1) AS b, sum(x1*x1) AS c,
        sum(x0*y) AS u, sum(x1*y) AS v FROM d GROUP BY shard)""",
        ),
        ("w_0", ZERO),
        ("s0", "SELECT shard, 0.0::DOUBLE AS a0, 0.0::DOUBLE AS a1 FROM g"),
    ]
    for t in range(iters):
        ctes += [
            (
                f"n{t}",
                f"""SELECT shard, a0, a1, (h11*b0 - h01*b1) / (h00*h11 - h01*h01) AS v0,
          (h00*b1 - h01*b0) / (h00*h11 - h01*h01) AS v1 FROM (
        SELECT g.shard, a0, a1, m/n*a + {rho} AS h00, m/n*b AS h01, m/n*c + {rho} AS h11,
          m/n*u + {rho}*(w0 - a0) AS b0, m/n*v + {rho}*(w1 - a1) AS b1
        FROM g JOIN s{t} USING (shard), w_{t})""",
            ),
            (
                f"w_{t + 1}",
                f"SELECT avg(v0 + a0) * {rho / (l2 + rho)!r} AS w0, "
                f"avg(v1 + a1) * {rho / (l2 + rho)!r} AS w1 FROM n{t}",
            ),
            (
                f"s{t + 1}",
                f"SELECT shard, a0 + v0 - w0 AS a0, a1 + v1 - w1 AS a1 FROM n{t}, w_{t + 1}",
            ),
        ]
    ctes += [(f"e{t}", evaluation(Squared, f"w_{t}", l2)) for t in range(iters + 1)]
    return with_query(ctes, history(iters + 1, lambda t: "1.0"))


def optimum(data: str, l2: float, digits: int, iters: int = 8) -> str:
    """The exact logistic optimum by Newton steps over the whole table."""
    ctes = [("d", f"SELECT 0 AS shard, y, x0, x1 FROM ({data})"), ("w_0", ZERO)]
    for t in range(iters):
        ctes += [
            (f"e{t}", evaluation(Logistic, f"w_{t}", l2)),
            (f"p{t}", newton_direction(Logistic, f"e{t}", l2)),
            (f"w_{t + 1}", f"SELECT w0 - p0 AS w0, w1 - p1 AS w1 FROM e{t}, p{t}"),
        ]
    ctes.append(("e", evaluation(Logistic, f"w_{iters}", l2)))
    final = " UNION ALL ".join(
        f"SELECT {j}::BIGINT AS j, round(w{j}, {digits}) + 0.0 AS w, "
        f"round(f, {digits}) + 0.0 AS objective, {r('err', 'train_error')} FROM e"
        for j in (0, 1)
    )
    return with_query(ctes, final)


def average_logistic(data: str, l2: float, iters: int = 8) -> str:
    """Per-shard optima by Newton steps, averaged by rows."""
    k, c = Logistic.curvature("t"), Logistic.slope("t")
    ctes = [
        ("d", data),
        ("w_0", "SELECT DISTINCT shard, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1 FROM d"),
    ]
    for t in range(iters):
        ctes.append(
            (
                f"w_{t + 1}",
                f"""SELECT shard, w0 - (h11*g0 - h01*g1) / (h00*h11 - h01*h01) AS w0,
          w1 - (h00*g1 - h01*g0) / (h00*h11 - h01*h01) AS w1 FROM (
        SELECT shard, w0, w1, sum({k}*x0*x0) / count(*) + {l2} AS h00,
          sum({k}*x0*x1) / count(*) AS h01, sum({k}*x1*x1) / count(*) + {l2} AS h11,
          sum({c}*x0) / count(*) + {l2}*w0 AS g0, sum({c}*x1) / count(*) + {l2}*w1 AS g1
        FROM (SELECT d.*, w0, w1, x0*w0 + x1*w1 AS t FROM d JOIN w_{t} USING (shard))
        GROUP BY shard, w0, w1)""",
            )
        )
    ctes.append(("s", "SELECT shard, count(*) AS s FROM d GROUP BY shard"))
    final = " UNION ALL ".join(
        f"SELECT {j}::BIGINT AS j, round(sum(s*w{j}) / sum(s), 5) + 0.0 AS w "
        f"FROM w_{iters} JOIN s USING (shard)"
        for j in (0, 1)
    )
    return with_query(ctes, final)


def average_ridge(data: str, l2: float) -> str:
    ctes = [
        ("d", data),
        (
            "g",
            f"""SELECT shard, count(*) AS s, sum(x0*x0)/count(*) + {l2} AS a,
      sum(x0*x1)/count(*) AS b, sum(x1*x1)/count(*) + {l2} AS c, sum(x0*y)/count(*) AS u,
      sum(x1*y)/count(*) AS v FROM d GROUP BY shard""",
        ),
    ]
    return with_query(
        ctes,
        f"SELECT 0::BIGINT AS j, {r('sum(s*(c*u - b*v)/(a*c - b*b)) / sum(s)', 'w')} FROM g "
        f"UNION ALL SELECT 1::BIGINT AS j, {r('sum(s*(a*v - b*u)/(a*c - b*b)) / sum(s)', 'w')} FROM g",
    )


def grouped(
    data: str, lam: float, sigma: float, tilt: tuple[float, float] = (0.0, 0.0), key: str | None = None, weights: bool = True
) -> str:
    l1 = lam * sigma
    name = f"shard AS {key}" if key else "shard::BIGINT AS shard"
    certified = ", true AS certified" if key else ""
    digits = 4 if key else 7
    w = "".join(f"round(arg_min(v{j}, q), {digits}) + 0.0 AS w{j}, " for j in (0, 1)) if weights else ""
    both = "(a*c - b*b)"
    v0 = f"""CASE WHEN s0 = 0 THEN 0.0 WHEN s1 = 0 THEN (u - {l1}*s0) / a
      ELSE (c*(u - {l1}*s0) - b*(v - {l1}*s1)) / {both} END"""
    v1 = f"""CASE WHEN s1 = 0 THEN 0.0 WHEN s0 = 0 THEN (v - {l1}*s1) / c
      ELSE (a*(v - {l1}*s1) - b*(u - {l1}*s0)) / {both} END"""
    value = (
        "0.5*(a*v0*v0 + 2*b*v0*v1 + c*v1*v1) - u*v0 - v*v1 + 0.5*yy "
        f"+ {l1}*(abs(v0) + abs(v1))"
    )
    return f"""
WITH d AS MATERIALIZED ({data}),
g AS MATERIALIZED (SELECT shard, count(*) AS s, sum(x0*x0)/count(*) + {lam} AS a,
  sum(x0*x1)/count(*) AS b, sum(x1*x1)/count(*) + {lam} AS c, sum(x0*y)/count(*) + {lam * tilt[0]} AS u,
  sum(x1*y)/count(*) + {lam * tilt[1]} AS v, sum(y*y)/count(*) AS yy FROM d GROUP BY shard)
SELECT {name}, any_value(s)::BIGINT AS s, {w}{r('min(q)', 'objective')}{certified}
FROM (SELECT *, {value} AS q FROM (SELECT *, {v0} AS v0, {v1} AS v1 FROM g,
  (VALUES (-1), (0), (1)) AS p(s0), (VALUES (-1), (0), (1)) AS o(s1)))
GROUP BY shard"""


# ---- preparation -------------------------------------------------------------


def uniform(*parts: str) -> str:
    text = " || '|' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"((('0x' || substr(md5({text}), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


def gaussian(*parts: str) -> str:
    u1, u2 = uniform(*parts, "'a'"), uniform(*parts, "'b'")
    return f"(sqrt(-2.0 * ln({u1})) * cos(2.0 * pi() * {u2}))"


def at_point(loss, data: str, l2: float, l1: float = 0.0, gradient_l2: bool = True) -> str:
    """One-row gradient query at the fixed weights ``W``."""
    keep = l2 if gradient_l2 else 0.0
    return with_query(
        [("d", data), ("w", f"SELECT {W[0]}::DOUBLE AS w0, {W[1]}::DOUBLE AS w1"),
         ("e", evaluation(loss, "w", l2, l1))],
        f"SELECT n::BIGINT AS n, {r('f', 'objective')}, {r('err', 'error')}, "
        f"{r(f'g0 - {l2 - keep}*w0', 'g0')}, {r(f'g1 - {l2 - keep}*w1', 'g1')} FROM e",
    )


def line_table(data: str, l2: float, slopes: bool, pick: bool = False) -> str:
    ctes = [
        ("d", data),
        ("etas", steps_values(10)),
        ("w", f"SELECT {W[0]}::DOUBLE AS w0, {W[1]}::DOUBLE AS w1"),
        ("e", evaluation(Logistic, "w", l2)),
    ]
    if pick:
        ctes += [
            ("p", "SELECT 16.0*g0 AS p0, 16.0*g1 AS p1 FROM e"),
            ("l", line(Logistic, "e", "p", l2)),
            ("k", armijo("l", "e", "p", 0.01, 9)),
        ]
        return with_query(
            ctes,
            f"SELECT l.k::BIGINT AS k, l.eta, {r('l.f', 'objective')}, "
            "l.eta = (SELECT eta FROM k) AS picked FROM l",
        )
    ctes += [
        ("p", f"SELECT {P[0]}::DOUBLE AS p0, {P[1]}::DOUBLE AS p1"),
        ("l", line(Logistic, "e", "p", l2)),
    ]
    tail = f", {r('slope', 'slope')}" if slopes else ""
    return with_query(ctes, f"SELECT k::BIGINT AS k, eta, {r('f', 'objective')}{tail} FROM l")


LIBSVM_ROWS = f"""
WITH d AS (SELECT y, x, {{keep}} AS v FROM ({EMB}))
SELECT y, {r('v[1]', 'first')}, {r('v[64]', 'last')}, {r('list_sum(v)', 'total')},
  {r('list_dot_product(v, [k::DOUBLE FOR k IN range(1, 65)])', 'ramp')} FROM d"""

RFF_D, RFF_SIGMA = 16, 1.5


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    # sources, sinks, layout
    sql["libsvm_roundtrip"] = LIBSVM_ROWS.format(keep="x")
    sql["libsvm_text_parse"] = LIBSVM_ROWS.format(keep="x")
    sql["text_split_sink"] = f"""
SELECT id % 5 = 0 AS is_test, count(*)::BIGINT AS n, sum(CASE WHEN y > 0 THEN 1 ELSE 0 END)::BIGINT
  AS positive FROM ({EMB}) GROUP BY 1"""
    sql["shard_assign"] = """
SELECT (l_orderkey % 8)::BIGINT AS shard, count(*)::BIGINT AS n FROM lineitem GROUP BY 1"""
    sql["shard_blocks"] = f"""
SELECT shard::BIGINT AS shard, count(*)::BIGINT AS s, min(id)::BIGINT AS first_id,
  max(id)::BIGINT AS last_id, {r('arg_min(x0, id)', 'first_x0')}, {r('sum(y)', 'sum_y')},
  {r('sum(y*x0)', 'sum_yx0')}, {r('sum(y*x1)', 'sum_yx1')} FROM ({EVENT2}) GROUP BY shard"""

    # preparation
    sql["label_recode"] = """
SELECT doc_id, ((quality + 1) - 1.5) / 0.5 AS y FROM labels"""
    sql["label_recode_condition"] = """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y
FROM orders"""
    sql["class_filter"] = """
SELECT vec_id, (label - 6.5) / 2.5 AS y FROM embeddings WHERE label IN (4, 9)"""
    sql["maxabs_fit"] = f"""
WITH d AS ({RIDGE3}), m AS (SELECT avg(y) AS y_mean, max(abs(x0)) AS a, max(abs(x1)) AS b,
  max(abs(x2)) AS c FROM d)
SELECT j::BIGINT AS j, {r('CASE j WHEN 0 THEN a WHEN 1 THEN b ELSE c END', 'max_abs')},
  {r('y_mean', 'y_mean')} FROM m, range(3) AS t(j)"""
    sql["maxabs_fit_wide"] = f"""
WITH d AS ({EMB}), u AS (SELECT unnest(x) AS v, generate_subscripts(x, 1) - 1 AS j FROM d)
SELECT j::BIGINT AS j, {r('max(abs(v))', 'max_abs')}, {r('(SELECT avg(y) FROM d)', 'y_mean')}
FROM u GROUP BY j"""
    sql["maxabs_apply"] = f"""
SELECT event_id, {r('value - avg(value) OVER ()', 'y')}, {r('value / max(abs(value)) OVER ()', 'x0')},
  {r('user_id / max(abs(user_id)) OVER ()', 'x1')}, 0.0::DOUBLE AS x2 FROM events"""
    h = "('0x' || substr(md5('{seed}|' || {key}), 1, 8))::BIGINT"
    sql["split_hash"] = f"""
SELECT event_id, {h.format(seed=7, key='event_id')} % 100 >= 80 AS is_test FROM events"""
    sql["split_exact"] = f"""
SELECT o_orderkey, row_number() OVER (ORDER BY {h.format(seed=11, key='o_orderkey')}, o_orderkey)
  > floor(0.8 * count(*) OVER ()) AS is_test FROM orders"""
    # Rows before the cut's key train; of the key at the cut as many as are wanted.
    sql["split_exact_duplicates"] = f"""
WITH k AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey),
c AS (SELECT *, sum(n) OVER (ORDER BY {h.format(seed=11, key='l_orderkey')}, l_orderkey) - n AS before,
  floor(0.8 * (SELECT count(*) FROM lineitem)) AS wanted FROM k)
SELECT l_orderkey, greatest(0, least(n, wanted - before))::BIGINT AS n_train,
  (n - greatest(0, least(n, wanted - before)))::BIGINT AS n_test, {r('q', 'quantity')} FROM c"""
    sql["split_mod5"] = "SELECT o_orderkey, o_orderkey % 5 = 0 AS is_test FROM orders"
    noise = [
        f"{x} + 0.02 * {gaussian('5', 'id', 'copy', str(j))}" for j, x in enumerate(("x0", "x1"))
    ]
    sql["augment_noise"] = f"""
SELECT id, copy::BIGINT AS copy, {r(noise[0], 'x0')}, {r(noise[1], 'x1')}
FROM ({EVENT2}), range(5) AS t(copy)"""
    sql["rff_transform"] = f"""
WITH z AS MATERIALIZED (SELECT i, list({gaussian('1234', 'i', 'j')} / {RFF_SIGMA} ORDER BY j) AS z,
    2.0 * pi() * {uniform('4321', 'any_value(i)')} AS v
  FROM range({RFF_D}) AS a(i), range(64) AS b(j) GROUP BY i)
SELECT id, i::BIGINT AS j, {r(f'sqrt(2.0 / {RFF_D}) * cos(list_dot_product(x, z) + v)', 'feature')}
FROM ({EMB}), z"""
    sql["rff_transform_native"] = sql["rff_transform"]
    pairs = "list_sum([pow(p[1] - p[2], 2) FOR p IN list_zip(a.x, b.x)])"
    sql["rff_bandwidth"] = f"""
WITH d AS MATERIALIZED ({EMB}), q AS (SELECT avg({pairs}) AS v FROM d a, d b)
SELECT (SELECT count(*) FROM d)::BIGINT AS n, {r('v', 'mean_sq_dist')}, {r('sqrt(v)', 'sigma')} FROM q"""
    sql["rff_bandwidth_by_shard"] = f"""
WITH d AS MATERIALIZED (SELECT * FROM ({EVENT2})),
q AS (SELECT avg(v) AS v FROM (SELECT avg(pow(a.x0 - b.x0, 2) + pow(a.x1 - b.x1, 2)) AS v
    FROM d a JOIN d b USING (shard) GROUP BY shard))
SELECT (SELECT count(*) FROM d)::BIGINT AS n, {r('v', 'mean_sq_dist')}, {r('sqrt(v)', 'sigma')} FROM q"""
    unscaled = f"""
WITH d AS (SELECT * FROM ({ORDERS2})),
s AS (SELECT avg(x0*x0) + 0.01 AS a, avg(x0*x1) AS b, avg(x1*x1) + 0.01 AS c,
    avg(x0*y) AS p, avg(x1*y) AS q FROM d),
w AS (SELECT (c*p - b*q) / (a*c - b*b) AS w0, (a*q - b*p) / (a*c - b*b) AS w1 FROM s),
e AS (SELECT avg(pow(y - w0*x0 - w1*x1, 2)) AS e FROM d, w)
SELECT j::BIGINT AS j, round(CASE j WHEN 0 THEN w0 ELSE w1 END / 1000, 2) AS w_thousands,
  round(e / 1e7, 2) AS error_1e7 FROM w, e, range(2) AS t(j)"""
    for kind in ("newton", "cg", "lbfgs", "admm"):
        sql[f"ridge_unscaled_{kind}"] = unscaled

    # sums
    sql["dataset_profile"] = f"""
SELECT count(*)::BIGINT AS n, 2::BIGINT AS d, count(DISTINCT shard)::BIGINT AS m,
  sum(CASE WHEN abs(y) = 1 THEN 0 ELSE 1 END)::BIGINT AS odd_labels,
  sum(CASE WHEN y > 0 THEN 1 ELSE 0 END)::BIGINT AS positive_labels FROM ({LOGIT2})"""
    sql["logistic_grad"] = at_point(Logistic, LOGIT2, 0.01)
    sql["ridge_grad"] = at_point(Squared, RIDGE2, 0.01)
    sql["enet_grad"] = at_point(Logistic, LOGIT2, 0.01, 0.002, gradient_l2=False)
    wide_w = "[((k % 7) - 3) / 10.0 FOR k IN range(64)]"
    sql["logistic_grad_wide"] = f"""
WITH d AS (SELECT y, x, list_dot_product(x, {wide_w}) AS t FROM ({EMB})),
u AS (SELECT {Logistic.slope('t')} AS c, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS j FROM d)
SELECT j::BIGINT AS j, {r('sum(c*v) / (SELECT count(*) FROM d) + 0.01 * ((j % 7) - 3) / 10.0', 'g')}
FROM u GROUP BY j"""
    sql["line_search_table"] = line_table(LOGIT2, 0.01, False)
    sql["wolfe_table"] = line_table(LOGIT2, 0.01, True)
    sql["armijo_pick"] = line_table(LOGIT2, 0.01, False, pick=True)
    sql["ridge_moments"] = f"""
WITH m AS (SELECT count(*) AS n, sum(x0*y) AS a, sum(x1*y) AS b, sum(x2*y) AS c FROM ({RIDGE3}))
SELECT j::BIGINT AS j, {r('CASE j WHEN 0 THEN a WHEN 1 THEN b ELSE c END / n', 'xy')}
FROM m, range(3) AS t(j)"""
    sql["gram_matvec"] = f"""
WITH m AS (SELECT count(*) AS n, sum(x0*t) AS a, sum(x1*t) AS b, sum(x2*t) AS c
  FROM (SELECT *, 0.5*x0 - 0.25*x1 + 0.125*x2 AS t FROM ({RIDGE3})))
SELECT j::BIGINT AS j, {r('CASE j WHEN 0 THEN a WHEN 1 THEN b ELSE c END / n', 'v')}
FROM m, range(3) AS t(j)"""

    def per_shard(data: str, k: str, d: int, score: str) -> str:
        cells = " UNION ALL ".join(
            f"SELECT shard, {i} AS i, {j} AS j, avg({k}*x{i}*x{j}) AS v FROM d GROUP BY shard"
            for i in range(d)
            for j in range(d)
        )
        return f"""WITH d AS MATERIALIZED (SELECT *, {score} AS t FROM ({data})) SELECT
  shard::BIGINT AS shard, i::BIGINT AS i, j::BIGINT AS j, {r('v', 'v')} FROM ({cells})"""

    sql["gram_matrix"] = per_shard(RIDGE3, "1.0", 3, "0.0")
    sql["logistic_hessian"] = per_shard(
        LOGIT2, Logistic.curvature("t"), 2, f"{W[0]}*x0 + {W[1]}*x1"
    )
    sql["gram_matrix_wide"] = f"""
WITH u AS (SELECT id, shard, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS j FROM ({EMB}))
SELECT a.shard::BIGINT AS shard, a.j::BIGINT AS i, b.j::BIGINT AS j, {r('avg(a.v*b.v)', 'v')}
FROM u a JOIN u b USING (id) GROUP BY a.shard, a.j, b.j"""

    part = "list_sum(x[512 * {0} + 1 : least(512 * {0} + 512, 2304)])"
    sql["gram_matrix_tiled"] = f"""
WITH u AS (SELECT shard, x, [{part.format('i')} FOR i IN range(5)] AS t FROM ({EMB_PRODUCTS})),
p AS (SELECT i, j FROM range(5) AS a(i), range(5) AS b(j) WHERE i <= j)
SELECT shard::BIGINT AS shard, i::BIGINT AS i, j::BIGINT AS j, count(*)::BIGINT AS s,
  {r('avg(t[i + 1] * t[j + 1])', 'total')}, {r('avg(x[512 * i + 1] * x[512 * j + 1])', 'first')},
  {r('avg(x[least(512 * i + 512, 2304)] * x[least(512 * j + 512, 2304)])', 'last')}
FROM u, p GROUP BY shard, i, j"""

    # trainers
    sql["newton_logistic_lockstep"] = newton(LOGIT2, Logistic, 0.01, 3)
    sql["newton_ridge_tiled"] = newton(RIDGE2, Squared, 0.01, 2)
    sql["prox_newton_lockstep"] = prox_newton(EVENT2, 0.002, 0.01, 3)
    sql["newton_ridge"] = newton(RIDGE2, Squared, 0.01, 2)
    sql["newton_logistic"] = newton(LOGIT2, Logistic, 0.01, 3)
    sql["prox_newton"] = prox_newton(EVENT2, 0.002, 0.01, 3)
    sql["momentum_gd"] = momentum(LOGIT2, 0.01, 3, 2.0, 0.9)
    sql["lbfgs_logistic"] = lbfgs(LOGIT2, Logistic, 0.01)
    sql["lbfgs_vector_free"] = sql["lbfgs_logistic"]
    sql["lbfgs_ridge"] = lbfgs(RIDGE2, Squared, 0.01)
    sql["cg_ridge"] = cg(RIDGE2, 0.01)
    sql["fista_prox_l2"] = fista(EVENT2, 0.002, 0.01, 3, 0.5, True)
    sql["fista_smooth_l2"] = fista(EVENT2, 0.002, 0.01, 3, 0.5, False)
    sql["admm_ridge"] = admm_ridge(RIDGE2, 0.01, 3, 0.1)
    sql["dane_logistic"] = optimum(EVENT2, 0.1, 5)
    sql["admm_logistic"] = optimum(EVENT2, 0.1, 4)
    sql["dane_path"] = dane_path(EVENT_SMALL, 0.05, 2, 2, 0.7, False)
    sql["dane_path_line_search"] = dane_path(EVENT_SMALL, 0.05, 2, 2, 0.7, True)
    sql["dane_path_streamed"] = sql["dane_path"]
    sql["admm_logistic_path"] = admm_logistic_path(EVENT_SMALL, 0.05, 3, 2, 0.7, 0.1)
    sql["admm_logistic_path_streamed"] = sql["admm_logistic_path"]
    sql["model_average_logistic_path"] = averaged_path(EVENT_SMALL, 0.05, 3, 0.7)
    sql["model_average_logistic_path_streamed"] = sql["model_average_logistic_path"]
    sql["newton_logistic_warm_start"] = newton_warm_start(EVENT_SMALL, 0.05, 3, 0.7)
    sql["newton_logistic_fixed_step"] = newton_fixed_step(LOGIT2, Logistic, 0.01, 3)
    sql["model_average_ridge"] = average_ridge(RIDGE2, 0.01)
    sql["model_average_logistic"] = average_logistic(EVENT2, 0.1)
    sql["grouped_enet_ls"] = grouped(RIDGE2, 0.05, 0.5)
    by_flag = RIDGE2.replace("l_orderkey % 4 AS shard", "l_returnflag AS shard")
    small = RIDGE2.replace("l_orderkey % 4 AS shard", "l_returnflag || '-' || (l_orderkey % 50) AS shard")
    sql["grouped_enet_dual"] = grouped(by_flag, 0.05, 0.5, (0.3, -0.1), "name")
    sql["grouped_enet_dual_ill_conditioned"] = grouped(small, 2e-4, 0.5, (0.3, -0.1), "name", False)
    sql["grouped_enet_dual_in_place"] = sql["grouped_enet_dual"]
    sql["history_with_holdout"] = holdout(EVENT2, 0.01, 3, 2.0, 0.9)
    sql["sweep_momentum_gd"] = sweep(LOGIT2, 0.01, 2, {"slow": (0.5, 0.9), "fast": (2.0, 0.5)})

    grid = {f"{rate}-{beta}": (rate, beta) for rate in (0.5, 1.0, 2.0) for beta in (0.5, 0.9)}
    sql["sweep_batched"] = sweep(LOGIT2, 0.01, 2, grid)

    sql["preset_ridge"] = f"""
WITH every_row AS MATERIALIZED ({RIDGE2}),
m AS (SELECT max(abs(x0)) AS m0, max(abs(x1)) AS m1, avg(y) AS my FROM every_row WHERE shard <> 0),
d AS (SELECT shard = 0 AS side, x0 / m0 AS x0, x1 / m1 AS x1, y - my AS y FROM every_row, m),
s AS (SELECT avg(x0*x0) + 1e-6 AS a, avg(x0*x1) AS b, avg(x1*x1) + 1e-6 AS c,
    avg(x0*y) AS p, avg(x1*y) AS q FROM d WHERE NOT side),
w AS (SELECT (c*p - b*q) / (a*c - b*b) AS w0, (a*q - b*p) / (a*c - b*b) AS w1 FROM s)
SELECT 'newton_60_100' AS run_id,
  {r('avg(0.5 * pow(y - w0*x0 - w1*x1, 2)) FILTER (NOT side) + 0.5e-6 * any_value(w0*w0 + w1*w1)', 'objective')},
  {r('avg(pow(y - w0*x0 - w1*x1, 2)) FILTER (side)', 'test_error')}, 1.0::DOUBLE AS nonzero
FROM d, w"""

    # scoring
    score = f"({W[0]}*x0 + {W[1]}*x1)"
    sql["score_rows"] = f"SELECT id, {r(score, 'score')} FROM ({EVENT2})"
    sql["score_zero_one"] = f"""
SELECT count(*)::BIGINT AS n, {r(f'avg(CASE WHEN y * {score} <= 0 THEN 1.0 ELSE 0.0 END)', 'error')}
FROM ({LOGIT2})"""
    sql["score_mse"] = f"""
SELECT count(*)::BIGINT AS n, {r(f'avg(pow(y - {score}, 2))', 'mse')} FROM ({RIDGE2})"""
    sql["weight_sparsity"] = f"""
WITH d AS ({EMB}), u AS (SELECT y, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM d),
w AS (SELECT j, avg(0.5 * y * v) AS g FROM u GROUP BY j)
SELECT count(*)::BIGINT AS d, sum(CASE WHEN abs(g) > 0.002 THEN 1 ELSE 0 END)::BIGINT AS nonzero,
  {r('avg(CASE WHEN abs(g) > 0.002 THEN 1.0 ELSE 0.0 END)', 'share')} FROM w"""
    return sql
