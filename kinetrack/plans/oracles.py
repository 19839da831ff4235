"""The queries of ``kinetrack.plans.queries`` in DuckDB SQL, written from the definitions (explicit arithmetic)."""

from __future__ import annotations

T0 = 1704067200000000000
DAY = 86400000000000
SIGMA = 600000000000

EV = "ev AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) * 1000 AS t_ns FROM events)"
GRID = (
    "sp AS (SELECT min(t_ns) AS a, max(t_ns) AS b FROM ev), "
    "g AS (SELECT k, a + CAST(round(CAST(k AS DOUBLE) * 1e9 / CAST('0.0078125' AS DOUBLE)) AS BIGINT) AS t_ns FROM "
    "(SELECT a, unnest(range(0, CAST(floor(CAST(b - a AS DOUBLE) * 1e-9 * CAST('0.0078125' AS DOUBLE) + 1e-6) AS BIGINT) + 1)) AS k FROM sp))"
)


def r6(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0::DOUBLE AS {name}"


def nearest(left: str, right: str, key: str, payload: str, by: str = "") -> str:
    """Two ASOF joins and the tie rule: left rows with ``m`` (the right row's payload) and ``m_ns``."""
    on = f"l.{by} = r.{by} AND " if by else ""
    return (
        f"lo AS (SELECT l.*, r.t_ns AS lo_ns, r.{payload} AS lo_p FROM {left} l ASOF LEFT JOIN {right} r ON {on}l.t_ns > r.t_ns), "
        f"hi AS (SELECT l.{key} AS hk, r.t_ns AS hi_ns, r.{payload} AS hi_p FROM {left} l ASOF LEFT JOIN {right} r ON {on}l.t_ns <= r.t_ns), "
        f"nn AS (SELECT lo.*, CASE WHEN lo_ns IS NULL OR (hi_ns IS NOT NULL AND hi_ns - t_ns < t_ns - lo_ns) THEN hi_p ELSE lo_p END AS m, "
        f"CASE WHEN lo_ns IS NULL OR (hi_ns IS NOT NULL AND hi_ns - t_ns < t_ns - lo_ns) THEN hi_ns ELSE lo_ns END AS m_ns FROM lo JOIN hi ON lo.{key} = hi.hk)"
    )


def of_type(kind: str) -> str:
    return f"(SELECT * FROM ev WHERE event_type = '{kind}')"


def qmul(a: str, b: str) -> list[str]:
    """Components x, y, z, w of a product of quaternions with columns a_x ..."""
    x, y, z, w = (f"{a}{c}" for c in "xyzw")
    p, q, r, s = (f"{b}{c}" for c in "xyzw")
    return [
        f"({w}*{p} + {x}*{s} + {y}*{r} - {z}*{q})", f"({w}*{q} - {x}*{r} + {y}*{s} + {z}*{p})",
        f"({w}*{r} + {x}*{q} - {y}*{p} + {z}*{s})", f"({w}*{s} - {x}*{p} - {y}*{q} - {z}*{r})",
    ]


def rot(q: str, v: tuple[str, str, str]) -> list[str]:
    x, y, z, w = (f"{q}{c}" for c in "xyzw")
    a, b, c = v
    return [
        f"((1 - 2*({y}*{y} + {z}*{z}))*({a}) + 2*({x}*{y} - {w}*{z})*({b}) + 2*({x}*{z} + {w}*{y})*({c}))",
        f"(2*({x}*{y} + {w}*{z})*({a}) + (1 - 2*({x}*{x} + {z}*{z}))*({b}) + 2*({y}*{z} - {w}*{x})*({c}))",
        f"(2*({x}*{z} - {w}*{y})*({a}) + 2*({y}*{z} + {w}*{x})*({b}) + (1 - 2*({x}*{x} + {y}*{y}))*({c}))",
    ]


def columns(parts: list[str], prefix: str) -> str:
    return ", ".join(f"{p} AS {prefix}{c}" for p, c in zip(parts, "xyzw"))


ANGLES = (
    f"WITH {EV}, an AS (SELECT event_id, value / 100 AS yaw, (event_id % 31)::DOUBLE / 20 AS pitch, (event_id % 19)::DOUBLE / 15 AS roll, value / 7 AS px0 FROM ev), "
    "yq AS (SELECT *, 0.0::DOUBLE AS ax, sin(yaw/2) AS ay, 0.0::DOUBLE AS az, cos(yaw/2) AS aw, sin(pitch/2) AS ex, 0.0::DOUBLE AS ey, 0.0::DOUBLE AS ez, cos(pitch/2) AS ew, "
    "0.0::DOUBLE AS cx, 0.0::DOUBLE AS cy, -sin(roll/2) AS cz, cos(roll/2) AS cw FROM an), "
    f"yp AS (SELECT *, {columns(qmul('a', 'e'), 'm')} FROM yq), yr AS (SELECT *, {columns(qmul('m', 'c'), 'n')} FROM yp), "
    "qq AS (SELECT *, nx / sqrt(nx*nx + ny*ny + nz*nz + nw*nw) AS qx, ny / sqrt(nx*nx + ny*ny + nz*nz + nw*nw) AS qy, "
    "nz / sqrt(nx*nx + ny*ny + nz*nz + nw*nw) AS qz, nw / sqrt(nx*nx + ny*ny + nz*nz + nw*nw) AS qw FROM yr)"
)

EDGES = (
    "fe AS (SELECT user_id, event_id, -(0.60::DOUBLE + 0.02::DOUBLE * (event_id % 17)::DOUBLE) AS l, 0.55::DOUBLE + 0.02::DOUBLE * (event_id % 13)::DOUBLE AS r, "
    "0.50::DOUBLE + 0.02::DOUBLE * (event_id % 11)::DOUBLE AS u, -(0.52::DOUBLE + 0.02::DOUBLE * (event_id % 7)::DOUBLE) AS d FROM ev)"
)


def upper(x: str) -> str:
    return f"list_sort(list({x}))[CAST(count({x}) // 2 + 1 AS BIGINT)]"


CLOCK = f"ck AS (SELECT {T0} + d * {DAY} AS h, 200000000 + d * d * 1000 + (d % 3) * 17 AS off FROM (SELECT unnest(range(1, 25)) AS d))"
OFFSET = (
    f"{CLOCK}, br AS (SELECT e.event_id, e.t_ns, lo.h AS h0, lo.off AS o0, hi.h AS h1, hi.off AS o1, (SELECT arg_min(off, h) FROM ck) AS fo, (SELECT arg_max(off, h) FROM ck) AS lo2 "
    "FROM ev e ASOF LEFT JOIN ck lo ON e.t_ns >= lo.h ASOF LEFT JOIN ck hi ON e.t_ns < hi.h), "
    "of AS (SELECT event_id, t_ns, CASE WHEN h0 IS NULL THEN fo WHEN h1 IS NULL THEN lo2 "
    "ELSE o0 + CAST(round((t_ns - h0)::DOUBLE / (h1 - h0)::DOUBLE * (o1 - o0)::DOUBLE) AS BIGINT) END AS offset_ns FROM br)"
)

LENS = (
    "180.0::DOUBLE + (event_id % 20)::DOUBLE / 3 AS fx, 185.0::DOUBLE + (event_id % 20)::DOUBLE / 3 AS fy, 323.51234567::DOUBLE AS cx, 237.51234567::DOUBLE AS cy, "
    "-0.06::DOUBLE AS k1, 0.008::DOUBLE AS k2, 0.0009::DOUBLE AS p1, -0.0006::DOUBLE AS p2, 0.0::DOUBLE AS k3"
)
DIRECTION = "(event_id % 41)::DOUBLE / 40 - 0.5 AS dx, (event_id % 37)::DOUBLE / 40 - 0.4 AS dy, CASE WHEN event_id % 10 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS dz"
FOV = "tan(-(0.70 + (event_id % 5)::DOUBLE / 20)) AS tl, tan(0.86 + (event_id % 3)::DOUBLE / 20) AS tr, tan(0.75::DOUBLE) AS tu, tan(-0.78::DOUBLE) AS td"


def distorted(x: str, y: str) -> tuple[str, str]:
    r2 = f"({x}*{x} + {y}*{y})"
    radial = f"(1 + k1*{r2} + k2*{r2}*{r2} + k3*{r2}*{r2}*{r2})"
    return f"({x}*{radial} + 2*p1*{x}*{y} + p2*({r2} + 2*{x}*{x}))", f"({y}*{radial} + p1*({r2} + 2*{y}*{y}) + 2*p2*{x}*{y})"


def _unprojected(rounds: int = 20) -> str:
    steps = [f"WITH {EV}, s0 AS (SELECT event_id, {LENS}, ((event_id % 640)::DOUBLE - 323.51234567) / (180.0 + (event_id % 20)::DOUBLE / 3) AS x0, ((event_id % 480)::DOUBLE - 237.51234567) / (185.0 + (event_id % 20)::DOUBLE / 3) AS y0 FROM ev)"]
    steps.append("u0 AS (SELECT *, x0 AS x, y0 AS y FROM s0)")
    for k in range(rounds):
        a, b = distorted("x", "y")
        steps.append(f"u{k + 1} AS (SELECT * EXCLUDE (x, y), x - ({a} - x0) AS x, y - ({b} - y0) AS y FROM u{k})")
    return ", ".join(steps) + f" SELECT event_id, {r6('x', 'x')}, {r6('-y', 'y')}, {r6('(-1.0)::DOUBLE', 'z')} FROM u{rounds}"


def linear(x: str) -> str:
    return f"(CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} >= 1 THEN 1.0 WHEN {x} <= 0.04045 THEN {x} / 12.92 ELSE pow(({x} + 0.055) / 1.055, 2.4) END)"


def encoded(x: str) -> str:
    return f"(CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} >= 1 THEN 1.0 WHEN {x} <= 0.0031308 THEN {x} * 12.92 ELSE 1.055 * pow({x}, 1.0::DOUBLE / 2.4) - 0.055 END)"


def smoothed(value: str, centre: str) -> str:
    """CTE ``sm`` (event_id, s): weighted mean of an expression over the window and the stand-ins at both ends."""
    return (
        "en AS (SELECT min(t_ns) AS t0, max(t_ns) AS t1, count(*) AS n, arg_min(value, t_ns) AS v0, arg_max(value, t_ns) AS v1 FROM ev), "
        "es AS (SELECT *, (t1 - t0)::DOUBLE / (n - 1) AS sp FROM en), "
        f"wi AS (SELECT a.event_id, sum(exp(-0.5 * pow((b.t_ns - a.t_ns)::DOUBLE / {SIGMA}.0, 2))) AS w, sum(exp(-0.5 * pow((b.t_ns - a.t_ns)::DOUBLE / {SIGMA}.0, 2)) * ({value.format(v='b.value', c='a.value')})) AS s "
        f"FROM ev a JOIN ev b ON b.t_ns BETWEEN a.t_ns - {3 * SIGMA} AND a.t_ns + {3 * SIGMA} GROUP BY a.event_id), "
        "ed AS (SELECT event_id, value, v0, v1, "
        f"coalesce(list_sum([exp(-0.5 * pow(((t_ns - t0)::DOUBLE + sp * k) / {SIGMA}.0, 2)) FOR k IN range(1, greatest(0, CAST(floor(({3 * SIGMA}.0 - (t_ns - t0)::DOUBLE) / sp) AS BIGINT)) + 1)]), 0) AS wl, "
        f"coalesce(list_sum([exp(-0.5 * pow(((t1 - t_ns)::DOUBLE + sp * k) / {SIGMA}.0, 2)) FOR k IN range(1, greatest(0, CAST(floor(({3 * SIGMA}.0 - (t1 - t_ns)::DOUBLE) / sp) AS BIGINT)) + 1)]), 0) AS wh "
        "FROM ev, es), "
        f"sm AS (SELECT event_id, ed.value, (s + wl * ({value.format(v='v0', c='ed.value')}) + wh * ({value.format(v='v1', c='ed.value')})) / (w + wl + wh) AS s FROM ed JOIN wi USING (event_id))"
    )


WRAPPED = "(({v} - {c}) / 100 - 2 * pi() * round(({v} - {c}) / 100 / (2 * pi())))"

ORACLES: dict[str, str] = {}

ORACLES["asof_nearest_grid"] = f"WITH {EV}, {GRID}, {nearest('g', 'ev', 'k', 'event_id')} SELECT k, t_ns, m AS event_id, m_ns - t_ns AS gap_ns FROM nn"
ORACLES["asof_nearest_by_user"] = (
    f"WITH {EV}, pu AS {of_type('purchase')}, vi AS {of_type('view')}, {nearest('pu', 'vi', 'event_id', 'event_id', 'user_id')} "
    "SELECT event_id, user_id, m AS view_id, m_ns - t_ns AS gap_ns FROM nn"
)
ORACLES["asof_backward"] = (
    f"WITH {EV}, pu AS {of_type('purchase')}, cl AS {of_type('click')} SELECT l.event_id, l.user_id, r.event_id AS click_id FROM pu l ASOF LEFT JOIN cl r ON l.user_id = r.user_id AND l.t_ns >= r.t_ns"
)
ORACLES["ordinal_alignment"] = (
    f"WITH {EV}, k AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM ev WHERE event_type <> 'error'), "
    "f AS (SELECT user_id, event_id AS frame_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM ev WHERE event_type = 'view') "
    "SELECT user_id, n, frame_id, event_id FROM f JOIN k USING (user_id, n)"
)
ORACLES["overlay_source_record"] = (
    f"WITH {EV}, {GRID}, ke AS (SELECT t_ns, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame FROM ev WHERE event_type <> 'error'), "
    f"{nearest('g', 'ke', 'k', 'event_id')} SELECT k, frame, m AS record FROM nn JOIN ke ON ke.event_id = nn.m"
)
ORACLES["interp_linear_offset"] = f"WITH {EV}, {OFFSET} SELECT event_id, offset_ns, t_ns + offset_ns AS t_device_ns FROM of"
ORACLES["host_from_device"] = f"WITH {EV}, {OFFSET} SELECT event_id, t_ns + offset_ns AS device_ns, TRUE AS inverted FROM of"
ORACLES["interp_pose_slerp"] = (
    f"WITH {EV}, pu AS {of_type('purchase')}, vi AS {of_type('view')}, "
    "br AS (SELECT l.event_id, l.t_ns, lo.t_ns AS ta, lo.value AS va, hi.t_ns AS tb, hi.value AS vb FROM pu l ASOF LEFT JOIN vi lo ON l.user_id = lo.user_id AND l.t_ns >= lo.t_ns "
    "ASOF LEFT JOIN vi hi ON l.user_id = hi.user_id AND l.t_ns < hi.t_ns), "
    "bb AS (SELECT event_id, coalesce(va, vb) AS a, coalesce(vb, va) AS b, CASE WHEN ta IS NULL OR tb IS NULL THEN 0.0::DOUBLE ELSE (t_ns - ta)::DOUBLE / (tb - ta) END AS u FROM br WHERE va IS NOT NULL OR vb IS NOT NULL), "
    "qa AS (SELECT *, sin(a/200) AS ay, cos(a/200) AS aw, sin(b/200) AS by0, cos(b/200) AS bw0 FROM bb), "
    "qb AS (SELECT *, CASE WHEN ay*by0 + aw*bw0 < 0 THEN -by0 ELSE by0 END AS by1, CASE WHEN ay*by0 + aw*bw0 < 0 THEN -bw0 ELSE bw0 END AS bw1, abs(ay*by0 + aw*bw0) AS d FROM qa), "
    "qc AS (SELECT *, CASE WHEN d > 0.9995 THEN 1 - u ELSE sin((1-u)*acos(least(1.0, d)))/sin(acos(least(1.0, d))) END AS wa, CASE WHEN d > 0.9995 THEN u ELSE sin(u*acos(least(1.0, d)))/sin(acos(least(1.0, d))) END AS wb FROM qb), "
    "qd AS (SELECT *, ay*wa + by1*wb AS sy, aw*wa + bw1*wb AS sw FROM qc) "
    f"SELECT event_id, {r6('a + (b - a)*u', 'x')}, {r6('-(a + (b - a)*u)', 'z')}, {r6('sy / sqrt(sy*sy + sw*sw)', 'qy')}, {r6('sw / sqrt(sy*sy + sw*sw)', 'qw')} FROM qd"
)
ORACLES["gaussian_smooth_value"] = f"WITH {EV}, {smoothed('{v}', '')} SELECT event_id, {r6('s', 'smoothed')} FROM sm"
ORACLES["gaussian_smooth_pose"] = (
    f"WITH {EV}, {smoothed('{v}', '')}, px AS (SELECT event_id, s AS x FROM sm), "
    + smoothed(WRAPPED, "").replace("en AS", "en2 AS").replace("FROM en)", "FROM en2)").replace("es AS", "es2 AS").replace("ev, es)", "ev, es2)").replace("wi AS", "wi2 AS").replace("JOIN wi USING", "JOIN wi2 USING").replace("ed AS", "ed2 AS").replace("FROM ed JOIN", "FROM ed2 JOIN").replace("ed.value", "ed2.value").replace("sm AS", "sm2 AS")
    + f" SELECT event_id, {r6('x', 'x')}, {r6('sin((value / 100 + s) / 2)', 'qy')}, {r6('cos((value / 100 + s) / 2)', 'qw')} FROM sm2 JOIN px USING (event_id)"
)
ORACLES["upper_median_interval"] = (
    f"WITH {EV}, de AS (SELECT user_id, t_ns - lag(t_ns) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM ev) "
    f"SELECT user_id, coalesce(CAST({upper('d')} AS BIGINT), 0) AS interval_ns FROM (SELECT * FROM de WHERE d IS NOT NULL UNION ALL SELECT user_id, NULL FROM ev GROUP BY user_id HAVING count(*) = 1) GROUP BY user_id"
)
ORACLES["fov_edge_median"] = (
    f"WITH {EV}, {EDGES}, me AS (SELECT user_id, {upper('l')} AS l, {upper('r')} AS r, {upper('u')} AS u, {upper('d')} AS d FROM fe GROUP BY user_id), "
    "sy AS (SELECT user_id, least(abs(tan(l)), abs(tan(r))) AS x, least(abs(tan(u)), abs(tan(d))) AS y FROM me), cr AS (SELECT user_id, least(2*x / 640, 2*y / 480) AS p FROM sy) "
    f"SELECT user_id, {r6('-atan(p * 320)', 'l')}, {r6('atan(p * 320)', 'r')}, {r6('atan(p * 240)', 'u')}, {r6('-atan(p * 240)', 'd')} FROM cr"
)
ORACLES["frustum_union"] = (
    f"WITH {EV}, {EDGES}, un AS (SELECT user_id, tan(min(l)) AS l, tan(max(r)) AS r, tan(max(u)) AS u, tan(min(d)) AS d FROM fe GROUP BY user_id), "
    "pi AS (SELECT max(greatest((r - l) / 640, (u - d) / 480)) AS p FROM un), "
    "pa AS (SELECT user_id, l, r, u, d, greatest(0.0, p*640 - (r - l)) / 2 AS x, greatest(0.0, p*480 - (u - d)) / 2 AS y FROM un, pi) "
    f"SELECT user_id, {r6('atan(l - x)', 'l')}, {r6('atan(r + x)', 'r')}, {r6('atan(u + y)', 'u')}, {r6('atan(d - y)', 'd')} FROM pa"
)
ORACLES["monotonicity_violations"] = (
    f"WITH {EV}, la AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM ev) SELECT user_id, event_id FROM la WHERE p IS NOT NULL AND NOT value > p"
)
ORACLES["diagnostic_caps"] = (
    f"WITH {EV}, di AS (SELECT CAST(user_id AS VARCHAR) AS take_id, event_id AS line, 'value over 100 in ' || event_type AS message, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, "
    "count(*) OVER (PARTITION BY user_id) AS c FROM ev WHERE value > 100) "
    "SELECT take_id, 'error' AS severity, count(*) AS n, max(line) AS last_line, max(message) AS message FROM di WHERE n <= 5 GROUP BY take_id "
    "UNION ALL SELECT take_id, 'warning', 1, NULL, 'a large value: ' || (max(c) - 5) || ' record(s) beyond those listed' FROM di WHERE c > 5 GROUP BY take_id"
)
ORACLES["json_typed_extract"] = (
    f"WITH {EV}, b AS (SELECT event_id, event_id % 6 AS e, regexp_extract(props, '([0-9]+)', 1) AS k FROM ev) "
    "SELECT event_id, CASE e WHEN 1 THEN 'number' WHEN 2 THEN 'string' WHEN 3 THEN 'boolean' WHEN 4 THEN 'missing' ELSE 'integer' END AS kind, "
    "CASE WHEN e IN (0, 5) THEN CAST(k AS BIGINT) END AS as_int, CASE WHEN e IN (0, 5) THEN CAST(k AS DOUBLE) WHEN e = 1 THEN CAST(k || '.5' AS DOUBLE) END AS as_number, "
    "CASE WHEN e = 2 THEN k END AS as_string, CASE WHEN e = 3 THEN TRUE END AS as_boolean FROM b"
)
ORACLES["span_overlap"] = (
    f"WITH {EV}, a AS (SELECT user_id, min(t_ns) AS f, max(t_ns) AS l FROM ev WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id, min(t_ns) AS f, max(t_ns) AS l FROM ev WHERE event_type = 'error' GROUP BY 1) "
    "SELECT user_id, NOT (a.l < b.f OR a.f > b.l) AS overlaps FROM a JOIN b USING (user_id)"
)
ORACLES["fk_anti"] = "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"
_p = rot("q", ("px0", "1", "-2"))
ORACLES["quat_compose_rotate"] = f"{ANGLES} SELECT event_id, {', '.join(r6('q' + c, 'q' + c) for c in 'xyzw')}, {', '.join(r6(e, 'p' + c) for e, c in zip(_p, 'xyz'))} FROM qq"
_i = rot("k", ("px0", "pitch", "yaw"))
ORACLES["pose_compose_inverse"] = (
    f"{ANGLES}, kk AS (SELECT *, -qx AS kx, -qy AS ky, -qz AS kz, qw AS kw FROM qq) SELECT event_id, 0.0::DOUBLE AS cx, 0.0::DOUBLE AS cy, 0.0::DOUBLE AS cz, 1.0::DOUBLE AS cw, "
    f"1.0::DOUBLE AS back_x, 2.0::DOUBLE AS back_y, 3.0::DOUBLE AS back_z, {', '.join(r6(f'-({e})', 'i' + c) for e, c in zip(_i, 'xyz'))} FROM kk"
)
ORACLES["swing_twist"] = (
    f"{ANGLES}, nn AS (SELECT event_id, qz, qw, sqrt(qz*qz + qw*qw) AS n FROM qq) "
    f"SELECT event_id, {r6('CASE WHEN n < 1e-9 THEN 0.0 WHEN qw < 0 THEN -qz / n ELSE qz / n END', 'tz')}, {r6('CASE WHEN n < 1e-9 THEN 1.0 ELSE abs(qw) / n END', 'tw')} FROM nn"
)
_pitch = rot("q", ("0", "0", "-1"))[1]
ORACLES["raw_extrinsic"] = (
    f"{ANGLES} SELECT event_id, {r6('qw', 'hx')}, {r6('-qz', 'hy')}, {r6('qy', 'hz')}, {r6('qx', 'hw')}, {r6('qx', 'mx')}, {r6('-qy', 'my')}, {r6('-qz', 'mz')}, {r6('-qw', 'mw')}, "
    f"1.0::DOUBLE AS same, {r6(f'degrees(asin(greatest(-1.0, least(1.0, {_pitch}))))', 'pitch')} FROM qq"
)
_dx, _dy = distorted("xn", "yn")
ORACLES["pinhole_project"] = (
    f"WITH {EV}, di AS (SELECT event_id, {DIRECTION}, {LENS} FROM ev), nn AS (SELECT *, dx / -dz AS xn, -dy / -dz AS yn FROM di) "
    f"SELECT event_id, {r6(f'CASE WHEN -dz > 1e-9 THEN fx*{_dx} + cx END', 'px')}, {r6(f'CASE WHEN -dz > 1e-9 THEN fy*{_dy} + cy END', 'py')} FROM nn"
)
ORACLES["pinhole_unproject"] = _unprojected()
ORACLES["fov_project_roundtrip"] = (
    f"WITH {EV}, f AS (SELECT event_id, {FOV} FROM ev) SELECT event_id, {r6('tl + ((event_id % 640)::DOUBLE + 0.5) / 640 * (tr - tl)', 'x')}, {r6('tu + ((event_id % 480)::DOUBLE + 0.5) / 480 * (td - tu)', 'y')}, "
    f"{r6('(event_id % 640)::DOUBLE', 'px')}, {r6('(event_id % 480)::DOUBLE', 'py')} FROM f"
)
_inf = rot("k", ("dx", "dy", "dz"))
_fin = rot("k", ("0.1 + dx/n*dep - 0.01*sv", "0.2 + dy/n*dep - 0.005*sv", "0.3 + dz/n*dep + 0.01*sv"))
ORACLES["reproject_depth"] = (
    f"WITH {EV}, di AS (SELECT event_id, {DIRECTION}, {FOV}, 1.0 + (event_id % 4)::DOUBLE AS dep, 5.0 + (event_id % 7)::DOUBLE AS sv FROM ev), "
    "ks AS (SELECT *, sqrt(dx*dx + dy*dy + dz*dz) AS n, 0.0::DOUBLE AS kx, -sin(sv/200) AS ky, 0.0::DOUBLE AS kz, cos(sv/200) AS kw FROM di), "
    f"vv AS (SELECT *, {', '.join(f'CASE WHEN event_id % 4 = 0 THEN {a} ELSE {b} END AS v{c}' for a, b, c in zip(_inf, _fin, 'xyz'))} FROM ks) "
    f"SELECT event_id, {r6('vx', 'x')}, {r6('vy', 'y')}, {r6('vz', 'z')}, {r6('CASE WHEN vz < 0 THEN (vx / -vz - tl) / (tr - tl) * 640 - 0.5 END', 'px')}, {r6('CASE WHEN vz < 0 THEN (vy / -vz - tu) / (td - tu) * 480 - 0.5 END', 'py')} FROM vv"
)
ORACLES["srgb_roundtrip"] = f"WITH {EV}, l AS (SELECT event_id, event_id % 256 AS byte, {linear('((event_id % 256)::DOUBLE / 255)')} AS v FROM ev) SELECT event_id, {r6('v', 'linear')}, byte AS back FROM l"
_over = encoded("m")
ORACLES["over_linear"] = (
    f"WITH {EV}, c AS (SELECT event_id, {linear('((event_id % 256)::DOUBLE / 255)')} AS b, {linear('(value / 500)')} AS f, (event_id % 101)::DOUBLE / 100 AS a FROM ev), m AS (SELECT event_id, b * (1 - a) + f * a AS m FROM c) "
    f"SELECT event_id, {r6(_over, 'straight')}, {r6(_over, 'premultiplied')} FROM m"
)


def _checker() -> str:
    colours = {"fw": (0.34, 0.26, 0.22), "hz": (0.28, 0.34, 0.40), "dark": (0.055, 0.070, 0.086), "light": (0.105, 0.125, 0.145)}
    pick = [f"CASE WHEN abs(yaw) < 0.006 AND abs(pitch) < 0.25 THEN {colours['fw'][i]}::DOUBLE WHEN abs(pitch) < 0.006 THEN {colours['hz'][i]}::DOUBLE WHEN cell THEN {colours['dark'][i]}::DOUBLE ELSE {colours['light'][i]}::DOUBLE END" for i in range(3)]
    return (
        f"WITH {EV}, p AS (SELECT event_id, event_id % 64 AS px, event_id // 64 % 48 AS py FROM ev), "
        "v AS (SELECT event_id, tan(-0.95::DOUBLE) + (px + 0.5)/64 * (tan(0.86::DOUBLE) - tan(-0.95::DOUBLE)) AS x, tan(0.75::DOUBLE) + (py + 0.5)/48 * (tan(-0.78::DOUBLE) - tan(0.75::DOUBLE)) AS y FROM p), "
        "a AS (SELECT event_id, atan2(x, 1.0::DOUBLE) AS yaw, asin(y / sqrt(x*x + y*y + 1)) AS pitch FROM v), "
        "c AS (SELECT *, CAST(floor(yaw / 0.13089969 + 1024) + floor(pitch / 0.13089969 + 1024) AS BIGINT) % 2 = 0 AS cell FROM a), "
        f"k AS (SELECT event_id, {', '.join(f'{x} AS c{i}' for i, x in enumerate(pick))} FROM c) "
        f"SELECT event_id, {', '.join(r6(linear(f'c{i}'), n) for i, n in enumerate('rgb'))} FROM k"
    )


ORACLES["checker_background"] = _checker()
ORACLES["audio_mix"] = (
    f"WITH {EV}, s AS (SELECT event_id % 3 AS track, event_id // 3 AS i, value FROM ev), p AS (SELECT i + CASE track WHEN 0 THEN -50 WHEN 1 THEN 0 ELSE 30 END AS i, value * CASE track WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 2.0 END::DOUBLE AS v FROM s) "
    f"SELECT i, {r6('sum(v)', 'v')} FROM p WHERE i >= 0 GROUP BY i"
)
ORACLES["segment_ranges"] = (
    f"WITH {EV}, x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS f FROM ev) "
    "SELECT user_id, CAST(k AS BIGINT) AS k, s - 1 AS i, min(f) AS first, max(f) + 1 AS last FROM ("
    + " UNION ALL ".join(f"SELECT user_id, {k} AS k, f, ntile({k}) OVER (PARTITION BY user_id ORDER BY f) AS s FROM x" for k in (1, 2, 3, 4, 8, 12))
    + ") GROUP BY user_id, k, s"
)
ORACLES["camera_clock_phase"] = (
    f"WITH {EV}, v AS (SELECT user_id, t_ns, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM ev WHERE event_type = 'view'), "
    "r AS (SELECT user_id, count(*) AS n, min(t_ns) AS t0, max(t_ns) AS t1 FROM v GROUP BY user_id HAVING count(*) > 1), f AS (SELECT *, (n - 1)::DOUBLE * 1e9 / (t1 - t0) AS fps FROM r), "
    "e AS (SELECT user_id, n, fps, abs((t_ns - t0)::DOUBLE - i::DOUBLE * 1e9 / fps) * 1e-6 AS err FROM v JOIN f USING (user_id)) "
    f"SELECT user_id, max(n) AS n, {r6('max(fps) * 1e6', 'microhertz')}, round(max(err) * 1e-3, 3) AS worst_s, round(avg(err) * 1e-3, 3) AS mean_s FROM e GROUP BY user_id"
)
ORACLES["spectral_bin"] = (
    f"WITH {EV}, s AS (SELECT user_id, value, (t_ns - {T0})::DOUBLE * 1e-9 * (2 * 3.141592653589793::DOUBLE / 86400) AS a FROM ev), m AS (SELECT user_id, sum(value*cos(a)) AS re, sum(value*sin(a)) AS im, count(*) AS n FROM s GROUP BY user_id) "
    "SELECT user_id, round(2 * sqrt(re*re + im*im) / n, 4) AS amplitude, round(atan2(im, re), 4) AS phase FROM m"
)
ORACLES["roughness"] = (
    f"WITH {EV}, l AS (SELECT user_id, value, lag(value, 1) OVER w AS b, lag(value, 2) OVER w AS a, (t_ns - lag(t_ns) OVER w) * 1e-9 AS dt FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t_ns)), "
    f"r AS (SELECT user_id, abs(value - 2*b + a) / (dt*dt) AS rough FROM l WHERE a IS NOT NULL) SELECT user_id, {r6(upper('rough') + ' * 1e6', 'rough')} FROM r GROUP BY user_id"
)
ORACLES["visibility_histogram"] = (
    f"WITH {EV} SELECT CASE event_id % 5 WHEN 0 THEN 'both' WHEN 1 THEN 'left' WHEN 2 THEN 'right' WHEN 3 THEN 'none' END AS visibility, count(*) AS n, "
    "count(*) FILTER (event_id % 5 IN (0, 1)) AS left_eye, count(*) FILTER (event_id % 5 IN (0, 2)) AS right_eye FROM ev GROUP BY 1"
)
ORACLES["source_changes"] = (
    f"WITH {EV}, {GRID}, {nearest('g', 'ev', 'k', 'event_id')}, c AS (SELECT k, m, lag(m) OVER (ORDER BY k) AS p FROM nn) SELECT k, m AS event_id FROM c WHERE p IS NULL OR p <> m"
)
ORACLES["seek_points"] = (
    f"WITH {EV}, v AS (SELECT event_id, t_ns, lag(t_ns) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM ev WHERE event_type = 'view') "
    f"SELECT event_id, {r6(f'CASE WHEN p < t_ns THEN (p + t_ns - {2 * T0})::DOUBLE / 2 * 1e-9 END', 'seek_s')} FROM v"
)
ORACLES["decimation_ticks"] = (
    f"WITH {EV}, r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM ev), "
    "t AS (SELECT user_id, event_id, k, row_number() OVER (PARTITION BY user_id ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM r WHERE k = 0 OR k * 37 // 90 > (k - 1) * 37 // 90) "
    "SELECT user_id, event_id, k AS record, i FROM t WHERE n < 12 OR (i <> n // 3 AND i <> 2 * n // 3)"
)
ORACLES["click_runs"] = (
    f"WITH RECURSIVE {EV}, l AS (SELECT user_id, event_id AS i FROM ev WHERE abs(value) >= 100), nx AS (SELECT a.user_id, a.i, min(b.i) AS j FROM l a JOIN l b ON a.user_id = b.user_id AND b.i - a.i > 100 GROUP BY a.user_id, a.i), "
    "c AS (SELECT user_id, min(i) AS i FROM l GROUP BY user_id UNION ALL SELECT nx.user_id, nx.j FROM c JOIN nx ON nx.user_id = c.user_id AND nx.i = c.i) SELECT user_id, i FROM c"
)
ORACLES["camera_keys"] = (
    f"WITH {EV}, k AS (SELECT ['L', 'camR', 'cam0', 'right', 'EYE1', '0', 'rear'][event_id % 7 + 1] AS raw FROM ev) "
    "SELECT raw, max(CASE WHEN lower(raw) IN ('l', 'left', 'cam0', 'caml', '0', 'eye0') THEN 'L' WHEN lower(raw) IN ('r', 'right', 'cam1', 'camr', '1', 'eye1') THEN 'R' END) AS cam, count(*) AS n FROM k GROUP BY raw"
)
ORACLES["pixel_blocks"] = (
    "WITH p AS (SELECT vec_id, i % 8 AS px, i // 8 AS py, embedding[i + 1]::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings)) "
    f"SELECT vec_id, {r6('avg(px) FILTER (x > 0.1)', 'x')}, {r6('avg(py) FILTER (x > 0.1)', 'y')}, count(*) FILTER (x > 0.1) AS n, {r6('avg(x) FILTER (px BETWEEN 3 AND 4 AND py BETWEEN 3 AND 4)', 'block')} FROM p GROUP BY vec_id"
)


def _covered() -> str:
    sides = {"l": ("0.0", "f*480"), "r": ("640.0", "f*480"), "u": ("f*640", "0.0"), "d": ("f*640", "480.0")}
    ray = rot("q", ("a", "b", "-1"))
    parts = [
        "WITH c AS (SELECT unnest(range(0, 8)) AS cam), "
        "an AS (SELECT cam, (cam / 40)::DOUBLE AS yaw, -0.05::DOUBLE AS pitch, 0.01::DOUBLE AS roll, 0.02 + cam / 200 - 0.03 AS ox, 0.0::DOUBLE AS oy, -0.06::DOUBLE AS oz FROM c), "
        "yq AS (SELECT *, 0.0::DOUBLE AS ax, sin(yaw/2) AS ay, 0.0::DOUBLE AS az, cos(yaw/2) AS aw, sin(pitch/2) AS ex, 0.0::DOUBLE AS ey, 0.0::DOUBLE AS ez, cos(pitch/2) AS ew, 0.0::DOUBLE AS cx, 0.0::DOUBLE AS cy, -sin(roll/2) AS cz, cos(roll/2) AS cw FROM an)",
        f"yp AS (SELECT *, {columns(qmul('a', 'e'), 'm')} FROM yq)",
        f"yr AS (SELECT cam, ox, oy, oz, {columns(qmul('m', 'c'), 'q')} FROM yp)",
        "ff AS (SELECT *, unnest(range(0, 65)) / 64 AS f FROM yr)",
        "sd AS (" + " UNION ALL ".join(f"SELECT cam, ox, oy, oz, qx, qy, qz, qw, '{k}' AS side, (({x}) - 322.0) / 300.0 AS a, -(({y}) - 241.0) / 310.0 AS b FROM ff" for k, (x, y) in sides.items()) + ")",
        f"ry AS (SELECT *, {ray[0]} AS rx, {ray[1]} AS ry, {ray[2]} AS rz FROM sd)",
        "un AS (SELECT *, sqrt(rx*rx + ry*ry + rz*rz) AS n FROM ry)",
        "al AS (SELECT *, (ox*rx + oy*ry + oz*rz) / n AS al FROM un)",
        "tt AS (SELECT *, -al + sqrt(al*al - (ox*ox + oy*oy + oz*oz) + 2.25) AS t FROM al)",
        "pt AS (SELECT cam, side, (ox + rx/n*t) / -(oz + rz/n*t) AS tx, (oy + ry/n*t) / -(oz + rz/n*t) AS ty FROM tt)",
    ]
    return ", ".join(parts) + (
        f", fo AS (SELECT cam, {r6('atan(max(tx) FILTER (side = {0}l{0}))'.format(chr(39)), 'l')}, {r6('atan(min(tx) FILTER (side = {0}r{0}))'.format(chr(39)), 'r')}, "
        f"{r6('atan(min(ty) FILTER (side = {0}u{0}))'.format(chr(39)), 'u')}, {r6('atan(max(ty) FILTER (side = {0}d{0}))'.format(chr(39)), 'd')} FROM pt GROUP BY cam) SELECT s_suppkey, l, r, u, d FROM supplier JOIN fo ON fo.cam = s_suppkey % 8"
    )


ORACLES["covered_fov"] = _covered()
ORACLES["quat_functions"] = (
    f"WITH {EV}, q AS (SELECT event_id, value, 2.0::DOUBLE / 7 * sin(value / 100) AS qx, 3.0::DOUBLE / 7 * sin(value / 100) AS qy, 6.0::DOUBLE / 7 * sin(value / 100) AS qz, cos(value / 100) AS qw FROM ev), "
    "k AS (SELECT *, sqrt(qx*qx + qy*qy + qz*qz) AS s, CASE WHEN qw < 0 THEN -1.0 ELSE 1.0 END AS g FROM q), "
    "v AS (SELECT *, g * CASE WHEN s < 1e-12 THEN 2.0 ELSE 2 * atan2(s, abs(qw)) / s END AS f, sqrt(qz*qz + qw*qw) AS n FROM k) "
    f"SELECT event_id, {', '.join(r6('q' + c, 'q' + c) for c in 'xyzw')}, {r6('1 - 2*(qy*qy + qz*qz)', 'm0')}, {r6('2*(qx*qy + qw*qz)', 'm1')}, {r6('2*(qx*qz - qw*qy)', 'm2')}, {r6('2*(qx*qy - qw*qz)', 'm3')}, "
    f"{r6('1 - 2*(qx*qx + qz*qz)', 'm4')}, {r6('2*(qy*qz + qw*qx)', 'm5')}, {r6('2*(qx*qz + qw*qy)', 'm6')}, {r6('2*(qy*qz - qw*qx)', 'm7')}, {r6('1 - 2*(qx*qx + qy*qy)', 'm8')}, "
    f"{', '.join(r6(f'q{c} * f', 'v' + c) for c in 'xyz')}, round(degrees(2 * acos(least(1.0, abs(qw)))), 3) + 0.0::DOUBLE AS angle, {r6('CASE WHEN n < 1e-9 THEN 0.0 ELSE g * qz / n END', 'roll_z')}, "
    "printf('(%.6f, 1.000000, -2.000000)', value) AS text FROM v"
)
ORACLES["frustum_functions"] = (
    f"WITH {EV}, {EDGES}, t AS (SELECT *, tan(l) AS tl, tan(r) AS tr, tan(u) AS tu, tan(d) AS td, 200.0::DOUBLE + (event_id % 50)::DOUBLE AS fx0 FROM fe), "
    "c AS (SELECT *, least((tr - tl) / 640, (tu - td) / 480) AS p FROM t), x AS (SELECT *, ((tr - tl) - p * 640) / 2 AS px, ((tu - td) - p * 480) / 2 AS py FROM c) "
    f"SELECT event_id, {r6('greatest(l, -0.7)', 'il')}, {r6('least(r, 0.7)', 'ir')}, {r6('least(u, 0.6)', 'iu')}, {r6('greatest(d, -0.6)', 'id')}, {r6('atan(tl + px)', 'cl')}, {r6('atan(tr - px)', 'cr')}, "
    f"{r6('atan(tu - py)', 'cu')}, {r6('atan(td + py)', 'cd')}, {r6('fx0 / 2', 'fx')}, 155.0::DOUBLE AS fy, 320.75::DOUBLE AS cx, {r6('(630.0::DOUBLE + (event_id % 9)::DOUBLE - 160) / 2', 'cy')}, "
    f"{r6('degrees(2 * atan(320.0::DOUBLE / fx0))', 'hfov')}, {r6('sqrt(ln(2.0::DOUBLE) / 2) / (pi() * (1 + event_id % 300)::DOUBLE * 1e-3)', 'cutoff')} FROM x"
)
ORACLES["line_scan"] = "SELECT event_id // 4096 AS part, row_number() OVER (PARTITION BY event_id // 4096 ORDER BY event_id) AS line, regexp_replace(props, chr(10), ' ', 'g') AS text FROM events"
ORACLES["predicted_pixels"] = (
    # turned by half angles of e % 13 and e % 11 sixtieths; a turn about y by t takes (x, z) to (x cos t + z sin t, z cos t - x sin t)
    f"WITH {EV}, a AS (SELECT event_id, (event_id % 13)::DOUBLE / 30 AS t, 0.03::DOUBLE AS ox, (event_id % 5)::DOUBLE / 20 AS oz, value / 1000 AS cx, (event_id % 41)::DOUBLE / 10 - 2 AS x, (event_id % 37)::DOUBLE / 10 AS y, -3.0::DOUBLE AS z FROM ev), "
    "d AS (SELECT *, x - cx AS dx, y - 1.6 AS dy, z - oz AS dz FROM a), n AS (SELECT *, sqrt(dx*dx + dy*dy + dz*dz) AS n, cx - ox AS fx FROM d), "
    "s AS (SELECT *, fx * dx / n AS al FROM n), r AS (SELECT *, al*al - fx*fx + 4 AS root FROM s), w AS (SELECT *, CASE WHEN root >= 0 AND -al + sqrt(root) > 0 THEN -al + sqrt(root) END AS tr FROM r), "
    "p AS (SELECT *, fx + dx / n * tr AS bx, dy / n * tr AS b_y, dz / n * tr AS bz FROM w), "
    "l AS (SELECT *, bx * cos(t) - bz * sin(t) AS ux, b_y AS uy, bx * sin(t) + bz * cos(t) AS uz, dx * cos(t) - dz * sin(t) AS vx, dy AS vy, dx * sin(t) + dz * cos(t) AS vz FROM p) "
    + "SELECT event_id, "
    + ", ".join(
        r6(f"CASE WHEN {k}z < 0 THEN ({k}{c} / -{k}z - tan({a}::DOUBLE)) / (tan({b}::DOUBLE) - tan({a}::DOUBLE)) * {size} - 0.5 END", f"{name}_{c}")
        for k, name in (("u", "back"), ("v", "front")) for c, a, b, size in (("x", -0.7, 0.75, 640), ("y", 0.6, -0.65, 480))
    )
    + " FROM l"
)
_SAMPLES = f"{EV}, s AS (SELECT event_id % 2 AS track, event_id // 2 AS i, value / 100 AS v FROM ev)"
ORACLES["audio_resampled"] = (
    f"WITH {_SAMPLES}, n AS (SELECT track, ((max(i) + 1) * 160 + 146) // 147 AS n FROM s GROUP BY track), j AS (SELECT track, unnest(range(0, n)) AS j FROM n), "
    "o AS (SELECT track, j, j * 147 // 160 AS b, unnest(range(-31, 33)) AS k FROM j), x AS (SELECT track, j, b + k AS i, (j * 147 % 160)::DOUBLE / 160 - k AS x FROM o), "
    "h AS (SELECT track, j, i, CASE WHEN x = 0 THEN 1.0::DOUBLE ELSE sin(pi() * x) / (pi() * x) END * CASE WHEN abs(x) < 32 THEN pow(cos(pi() * x / 64), 2) ELSE 0 END AS h FROM x) "
    f"SELECT h.track, j AS i, {r6('sum(coalesce(v, 0) * h) / sum(h)', 'v')} FROM h LEFT JOIN s ON s.track = h.track AND s.i = h.i GROUP BY h.track, j"
)
ORACLES["audio_limited"] = (
    f"WITH {_SAMPLES}, q AS (SELECT track, i, v, CASE WHEN abs(v) > 0.98 THEN 1 - 0.98::DOUBLE / abs(v) ELSE 0 END AS q FROM s), "
    "a AS (SELECT g.track, g.i, max(q.q * (1 - (q.i - g.i)::DOUBLE / 21)) AS a FROM (SELECT track, i - o AS i FROM (SELECT track, i, unnest(range(0, 21)) AS o FROM q) WHERE i >= o GROUP BY track, i - o) g JOIN q ON q.track = g.track AND q.i BETWEEN g.i AND g.i + 20 GROUP BY g.track, g.i), "
    "e AS (SELECT b.track, b.i, max(a.a * exp(-(b.i - a.i)::DOUBLE / 25)) AS e FROM q b JOIN a ON a.track = b.track AND a.i <= b.i AND b.i - a.i <= 400 GROUP BY b.track, b.i) "
    f"SELECT q.track, q.i, {r6('v * CASE WHEN e < 1e-5 THEN 1 ELSE 1 - e END', 'v')} FROM q JOIN e ON e.track = q.track AND e.i = q.i"
)
