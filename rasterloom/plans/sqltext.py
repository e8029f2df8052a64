"""SQL of the oracle: the operators written out for another engine, by direct two-dimensional sums
where the Spark plans work in separable passes or inside arrays."""
from __future__ import annotations

from .. import schema as S
from ..functions.taps import CUBICS, SINCS
from .fixtures import SQL, sql_lut


def _hsv(name: str, r: str, g: str, b: str) -> str:
    return f"""{name}_d AS (SELECT *, greatest(c0, c1, c2) AS mx, greatest(c0, c1, c2) - least(c0, c1, c2) AS d FROM px),
{name} AS (SELECT *, CASE WHEN d = 0 THEN 0e0 ELSE (CASE WHEN mx = {r} THEN ({g} - {b}) / d WHEN mx = {g} THEN 2 + ({b} - {r}) / d ELSE 4 + ({r} - {g}) / d END * 60 + CASE WHEN (CASE WHEN mx = {r} THEN ({g} - {b}) / d WHEN mx = {g} THEN 2 + ({b} - {r}) / d ELSE 4 + ({r} - {g}) / d END) < 0 THEN 360 ELSE 0 END) / 360 END AS h, CASE WHEN mx = 0 THEN 0e0 ELSE d / mx END AS s FROM {name}_d)"""


#: hsv and hsv_bgr (h, s, mx) and rgb (r, g, b, m) of the pixel table.
POINT = f"""{_hsv('hsv', 'c0', 'c1', 'c2')}, {_hsv('hsv_bgr', 'c2', 'c1', 'c0')},
turn AS (SELECT *, fmod(360 * c0, 360e0) / 60 AS t, c2 * c1 AS ch, c2 - c2 * c1 AS m FROM px),
rgb AS (SELECT *, CASE WHEN t < 1 OR t >= 5 THEN ch WHEN t < 2 OR t >= 4 THEN ch * (1 - abs(fmod(t, 2e0) - 1)) ELSE 0e0 END AS r,
  CASE WHEN t >= 1 AND t < 3 THEN ch WHEN t < 4 THEN ch * (1 - abs(fmod(t, 2e0) - 1)) ELSE 0e0 END AS g,
  CASE WHEN t >= 3 AND t < 5 THEN ch WHEN t >= 2 THEN ch * (1 - abs(fmod(t, 2e0) - 1)) ELSE 0e0 END AS b FROM turn)"""


def off_ties(sql: str, by: float) -> str:
    """``sql`` with ``by`` added inside every round(.., 6)."""
    at = 0
    while (at := sql.find("round(", at)) >= 0:
        depth, z = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[z], 0)
            z += 1
        if sql[: z - 1].endswith(", 6"):
            sql = f"{sql[: z - 4]} + {by!r}{sql[z - 4 :]}"
        at += 6
    return sql


def rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0e0 AS {n}" for n in names)


def matrix(rows: tuple[tuple[float, ...], ...], c: tuple[str, str, str]) -> tuple[str, str, str]:
    return tuple("(" + " + ".join(f"({w!r}::DOUBLE) * {v}" for w, v in zip(row, c)) + ")" for row in rows)


def _weight(mode: int, d: str) -> str:
    t = f"abs({d})"
    if mode == S.CUBIC:
        return f"CASE WHEN {t} <= 1 THEN 1.5e0 * {t} * {t} * {t} - 2.5e0 * {t} * {t} + 1 WHEN {t} < 2 THEN -0.5e0 * {t} * {t} * {t} + 2.5e0 * {t} * {t} - 4 * {t} + 2 ELSE 0e0 END"
    if mode in CUBICS:
        b, c = (f"{v!r}::DOUBLE" for v in CUBICS[mode])
        return f"CASE WHEN {t} < 1 THEN ((12 - 9 * {b} - 6 * {c}) * {t} * {t} * {t} + (-18 + 12 * {b} + 6 * {c}) * {t} * {t} + 6 - 2 * {b}) / 6 WHEN {t} < 2 THEN ((-1 * {b} - 6 * {c}) * {t} * {t} * {t} + (6 * {b} + 30 * {c}) * {t} * {t} + (-12 * {b} - 48 * {c}) * {t} + 8 * {b} + 24 * {c}) / 6 ELSE 0e0 END"
    a = SINCS[mode]
    return f"CASE WHEN {d} = 0 THEN 1e0 WHEN {t} >= {a} THEN 0e0 ELSE sin(pi() * {d}) * sin(pi() * {d} / {a}) * {a} / (pi() * {d} * pi() * {d}) END"


def taps(name: str, mode: int, n_in: int, n_out: int) -> str:
    """CTE ``name`` (o, s, w) for one axis."""
    if mode == S.NEAREST:
        return f"{name} AS (SELECT o, least(o * {n_in} // {n_out}, {n_in - 1}) AS s, 1e0 AS w FROM range({n_out}) t(o))"
    if mode == S.LINEAR:
        p = f"(o * {n_in - 1} / {float(n_out - 1)!r})"
        return f"{name} AS (SELECT o, floor({p})::INT AS s, 1 - ({p} - floor({p})) AS w FROM range({n_out}) t(o) UNION ALL SELECT o, least(floor({p})::INT + 1, {n_in - 1}), {p} - floor({p}) FROM range({n_out}) t(o))"
    r = f"({float(n_in)!r}::DOUBLE / {n_out})"
    if mode == S.AREA:
        return f"{name} AS (SELECT o, s, greatest(least(s + 1, (o + 1) * {r}) - greatest(s, o * {r}), 0e0) AS w FROM range({n_out}) t(o), range({n_in}) u(s) WHERE s + 1 > o * {r} AND s < (o + 1) * {r})"
    if mode == S.CUBIC:
        return f"{name} AS (SELECT o, least(greatest(q, 0), {n_in - 1}) AS s, {_weight(mode, 'd')} AS w FROM (SELECT o, floor(o * {r})::INT + k AS q, o * {r} - (floor(o * {r}) + k) AS d FROM range({n_out}) t(o), range(-1, 3) u(k)))"
    if mode in SINCS:
        a = SINCS[mode]
        return f"{name} AS (SELECT o, s, {_weight(mode, 'd')} AS w FROM (SELECT o, floor(o * {r})::INT + k AS s, o * {r} - (floor(o * {r}) + k) AS d FROM range({n_out}) t(o), range({-a}, {a + 1}) u(k)) WHERE s BETWEEN 0 AND {n_in - 1})"
    p = f"((o + 0.5e0) * {r} - 0.5e0)"
    return f"{name} AS (SELECT o, s, {_weight(mode, 'd')} AS w FROM (SELECT o, floor({p} - 1)::INT + k AS s, {p} - (floor({p} - 1) + k) AS d FROM range({n_out}) t(o), range(0, 4) u(k)) WHERE s BETWEEN 0 AND {n_in - 1})"


def resized(source: str, key: str, mode: int, w: int, h: int, w_out: int, h_out: int, channels: list[str], name: str) -> str:
    """CTE ``name`` (key, y, x, channels) by the full two-dimensional sum."""
    means = ", ".join(f"least(greatest(sum(b.w * a.w * {c}) / sum(b.w * a.w), 0e0), 1e0) AS {c}" for c in channels)
    return f"{taps('tx', mode, w, w_out)}, {taps('ty', mode, h, h_out)}, {name} AS (SELECT {key}, b.o AS y, a.o AS x, {means} FROM {source} i JOIN tx a ON i.x = a.s JOIN ty b ON i.y = b.s GROUP BY {key}, b.o, a.o)"


LARGE = "big AS (SELECT vec_id, y * 3 + dy AS y, x * 3 + dx AS x, c0, c1, c2 FROM img, range(3) a(dy), range(3) b(dx))"


def warped(source: str, inverse, w: int, h: int, h_out: int, w_out: int, mode: int, channels: list[str], name: str) -> str:
    """CTE ``name``: warp by the inverse matrix, over a table of weights per output pixel."""
    (a, b, c), (d, e, f) = ((f"({v!r}::DOUBLE)" for v in row) for row in inverse)
    grid = f"g AS (SELECT y, x, {a} * x + {b} * y + {c} AS tx, {d} * x + {e} * y + {f} AS ty FROM range({h_out}) p(y), range({w_out}) q(x))"
    if mode == S.NEAREST:
        weights = f"k AS (SELECT y, x, round_even(tx, 0)::INT AS sx, round_even(ty, 0)::INT AS sy, 1e0 AS w FROM g)"
    elif mode == S.LINEAR:
        weights = f"k AS (SELECT y, x, least(floor(tx)::INT + i, {w - 1}) AS sx, least(floor(ty)::INT + j, {h - 1}) AS sy, CASE WHEN i = 1 THEN tx - floor(tx) ELSE 1 - (tx - floor(tx)) END * CASE WHEN j = 1 THEN ty - floor(ty) ELSE 1 - (ty - floor(ty)) END AS w FROM g, range(2) r(i), range(2) s(j) WHERE tx >= 0 AND tx < {w} AND ty >= 0 AND ty < {h})"
    elif mode == S.AREA:
        box = f"bx AS (SELECT y, x, {a} * (x + 0.5e0) + {b} * (y + 0.5e0) + {c} AS cx, {d} * (x + 0.5e0) + {e} * (y + 0.5e0) + {f} AS cy, 0.5e0 * sqrt({a} * {a} + {b} * {b}) AS hx, 0.5e0 * sqrt({d} * {d} + {e} * {e}) AS hy FROM g)"
        lim = f"lm AS (SELECT *, greatest(0, floor(cx - hx)::INT) AS x0, least({w}, ceil(cx + hx)::INT) AS x1, greatest(0, floor(cy - hy)::INT) AS y0, least({h}, ceil(cy + hy)::INT) AS y1 FROM bx)"
        edge = lambda s, lo, hi, low, high: f"CASE WHEN {s} = {hi} - 1 THEN 1 - ({s} + 1 - ({high})) WHEN {s} = {lo} THEN 1 - (({low}) - {s}) ELSE 1e0 END"
        weights = f"{box}, {lim}, k AS (SELECT y, x, sx, sy, ({edge('sx', 'x0', 'x1', 'cx - hx', 'cx + hx')}) * ({edge('sy', 'y0', 'y1', 'cy - hy', 'cy + hy')}) AS w FROM lm, range({w}) r(sx), range({h}) s(sy) WHERE sx >= x0 AND sx < x1 AND sy >= y0 AND sy < y1)"
    else:
        low, far = (2, 2) if mode == S.CUBIC else (1, 2) if mode in CUBICS else (SINCS[mode] + 1, SINCS[mode] + 1)
        first = {S.CUBIC: "floor({})::INT - 1"}.get(mode, "floor({} - 1)::INT" if mode in CUBICS else f"floor({{}})::INT - {SINCS.get(mode, 1) - 1}")
        n = 4 if mode not in SINCS else 2 * SINCS[mode]
        weights = f"t AS (SELECT y, x, tx, ty, {first.format('tx')} + i AS sx, {first.format('ty')} + j AS sy FROM g, range({n}) r(i), range({n}) s(j) WHERE tx >= {low} AND tx < {w - far} AND ty >= {low} AND ty < {h - far}), k AS (SELECT y, x, sx, sy, ({_weight(mode, '(tx - sx)')}) * ({_weight(mode, '(ty - sy)')}) AS w FROM t)"
    means = ", ".join(f"sum(k.w * i.{c}) / sum(k.w) AS {c}" for c in channels)
    values = ", ".join(f"coalesce(v.{c}, 0e0) AS {c}" for c in channels)
    return f"{grid}, {weights}, v AS (SELECT i.vec_id, k.y, k.x, {means} FROM k JOIN {source} i ON i.x = k.sx AND i.y = k.sy GROUP BY i.vec_id, k.y, k.x HAVING sum(k.w) > 0), {name} AS (SELECT u.vec_id, g.y, g.x, {values} FROM (SELECT DISTINCT vec_id FROM {source}) u CROSS JOIN g LEFT JOIN v ON v.vec_id = u.vec_id AND v.y = g.y AND v.x = g.x)"


def lut_query(keys: list[str], n: int, interpolation: int, before: tuple[str, ...], after: tuple[str, ...]) -> str:
    """The line-item pixels through the generated table: weights of the eight corners."""
    place = ", ".join(f"least(greatest({e.replace('@', f'c{i}')}, 0e0), 1e0) * {n - 1} AS s{i}" for i, e in enumerate(before))
    top = n - 2 if interpolation == 0 else n - 1
    low = ", ".join(f"greatest(0, least(floor(s{i})::INT, {top})) AS l{i}" for i in range(3))
    if interpolation == 0:
        w = " * ".join(f"(CASE WHEN k{i} = 1 THEN s{i} - l{i} ELSE 1 - (s{i} - l{i}) END)" for i in range(3))
    else:
        # A corner weighs the least of its set coordinates over the largest of the others.
        least = "least(" + ", ".join(f"CASE WHEN k{i} = 1 THEN s{i} - l{i} ELSE 1e0 END" for i in range(3)) + ")"
        most = "greatest(" + ", ".join(f"CASE WHEN k{i} = 0 THEN s{i} - l{i} ELSE 0e0 END" for i in range(3)) + ")"
        w = f"greatest({least} - {most}, 0e0)"
    done = ", ".join(f"sum(w * {c}) AS c{i}" for i, c in enumerate("rgb"))
    out = ", ".join(f"round({e.replace('@', f'c{i}').replace('{@}', '')}, 6) + 0e0 AS c{i}" for i, e in enumerate(after))
    return f"""WITH {SQL['px']}, {sql_lut(n)}, p AS (SELECT {', '.join(keys)}, row_number() OVER () AS rid, {place} FROM px), q AS (SELECT *, {low} FROM p),
k AS (SELECT *, {w} AS w FROM q, range(2) a(k0), range(2) b(k1), range(2) c(k2)),
z AS (SELECT {', '.join(keys)}, rid, {done} FROM k JOIN lut ON lut.ri = least(l0 + k0, {n - 1}) AND lut.gi = least(l1 + k1, {n - 1}) AND lut.bi = least(l2 + k2, {n - 1}) GROUP BY ALL)
SELECT {', '.join(keys)}, {out} FROM z"""


def _blurred(source: str, kernel: list[float], n: int, name: str) -> str:
    r, total = len(kernel) // 2, sum(kernel)
    table = ", ".join(f"({i - r}, {float(t)!r}::DOUBLE)" for i, t in enumerate(kernel))
    means = ", ".join(f"sum(a.w * b.w * i.c{k}) / ({total * total!r}::DOUBLE) AS c{k}" for k in range(3))
    return f"kt(d, w) AS (VALUES {table}), {name} AS (SELECT g.vec_id, g.y, g.x, {means} FROM (SELECT vec_id, y, x FROM {source}) g CROSS JOIN kt a CROSS JOIN kt b JOIN {source} i ON i.vec_id = g.vec_id AND i.y = least(greatest(g.y + a.d, 0), {n - 1}) AND i.x = least(greatest(g.x + b.d, 0), {n - 1}) GROUP BY ALL)"


def blur(kernel: list[float]) -> str:
    return f"WITH {SQL['img']}, {_blurred('img', kernel, 8, 'z')} SELECT vec_id, y::INT AS y, x::INT AS x, {rounded('c0', 'c1', 'c2')} FROM z"


def erode(mask: list[list[int]], border: float) -> str:
    k = len(mask)
    cells = ", ".join(f"({i - k // 2}, {j - k // 2})" for i in range(k) for j in range(k) if mask[i][j] == 1)
    least = ", ".join(f"round(least(min(coalesce(i.c{c}, {border!r}::DOUBLE)), 1e0), 6) + 0e0 AS c{c}" for c in range(3))
    return f"WITH {SQL['img']}, o(dy, dx) AS (VALUES {cells}) SELECT g.vec_id, g.y::INT AS y, g.x::INT AS x, {least} FROM (SELECT vec_id, y, x FROM img) g CROSS JOIN o LEFT JOIN img i ON i.vec_id = g.vec_id AND i.y = g.y + o.dy AND i.x = g.x + o.dx GROUP BY g.vec_id, g.y, g.x"


def nms(boxes: str, threshold: float) -> str:
    return f"""WITH RECURSIVE {boxes}, r AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY score DESC, id) AS rn FROM boxes),
s AS (SELECT img, rn, [{{'id': id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM r WHERE rn = 1
UNION ALL
SELECT r.img, r.rn, CASE WHEN len(list_filter(s.kept, lambda a: greatest(0e0, least(a.x2, r.x2) - greatest(a.x1, r.x1) + 1) * greatest(0e0, least(a.y2, r.y2) - greatest(a.y1, r.y1) + 1) > {threshold}::DOUBLE * ((a.x2 - a.x1 + 1) * (a.y2 - a.y1 + 1) + (r.x2 - r.x1 + 1) * (r.y2 - r.y1 + 1) - greatest(0e0, least(a.x2, r.x2) - greatest(a.x1, r.x1) + 1) * greatest(0e0, least(a.y2, r.y2) - greatest(a.y1, r.y1) + 1)))) > 0 THEN s.kept ELSE list_append(s.kept, {{'id': r.id, 'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}}) END
FROM s JOIN r ON r.img = s.img AND r.rn = s.rn + 1),
l AS (SELECT img, max(rn) AS rn FROM s GROUP BY img)
SELECT img, unnest(kept).id AS id FROM s JOIN l USING (img, rn)"""


def points_of_embeddings(template: tuple[tuple[float, float], ...]) -> str:
    """(vec_id, k, sx, sy): five points near ``template``, as the fixture makes them."""
    rows = ", ".join(f"({k}, {x!r}::DOUBLE, {y!r}::DOUBLE)" for k, (x, y) in enumerate(template))
    return f"SELECT vec_id, k, embedding[2 * k + 1]::DOUBLE * 20 + px AS sx, embedding[2 * k + 2]::DOUBLE * 20 + py AS sy FROM embeddings, (VALUES {rows}) t(k, px, py)"


def crop_matrix(template, points: str, ids: str) -> str:
    """CTEs up to ``m``: the similarity matrix (ids, m00..m12) that takes ``points`` (ids, k, sx, sy) onto the template."""
    mx, my = sum(p[0] for p in template) / 5, sum(p[1] for p in template) / 5
    rows = ", ".join(f"({k}, {x!r}::DOUBLE, {y!r}::DOUBLE)" for k, (x, y) in enumerate(template))
    return f"""d(k, dx, dy) AS (VALUES {rows}), pt AS ({points}),
p AS (SELECT pt.*, dx - {mx!r}::DOUBLE AS dx, dy - {my!r}::DOUBLE AS dy FROM pt JOIN d USING (k)),
c AS (SELECT *, sx - avg(sx) OVER (PARTITION BY {ids}) AS px, sy - avg(sy) OVER (PARTITION BY {ids}) AS py FROM p),
a AS (SELECT {ids}, avg(sx) AS mx, avg(sy) AS my, sum(sqrt(dx * dx + dy * dy)) / sum(sqrt(px * px + py * py)) AS scale, sum(px * dx + py * dy) AS co, sum(px * dy - py * dx) AS si FROM c GROUP BY {ids}),
ab AS (SELECT *, scale * co / sqrt(co * co + si * si) AS a, scale * si / sqrt(co * co + si * si) AS b FROM a),
m AS (SELECT {ids}, a AS m00, -b AS m01, {mx!r}::DOUBLE - (a * mx - b * my) AS m02, b AS m10, a AS m11, {my!r}::DOUBLE - (b * mx + a * my) AS m12 FROM ab)"""


MATRIX = ("m00", "m01", "m02", "m10", "m11", "m12")


def shrunk_crops(source: str, n: int, size: int, channels: list[str]) -> str:
    """CTEs after ``m``: crops ``z`` of ``source`` (n x n images) by area means, a matrix per image."""
    edge = lambda s, lo, hi, low, high: f"CASE WHEN {s} = {hi} - 1 THEN 1 - ({s} + 1 - ({high})) WHEN {s} = {lo} THEN 1 - (({low}) - {s}) ELSE 1e0 END"
    means = ", ".join(f"CASE WHEN sum(w) > 0 THEN sum(w * {c}) / sum(w) ELSE 0e0 END AS {c}" for c in channels)
    return f"""dt AS (SELECT *, m00 * m11 - m01 * m10 AS det FROM m),
iv AS (SELECT vec_id, m11 / det AS a, -m01 / det AS b, (m01 * m12 - m02 * m11) / det AS c, -m10 / det AS d, m00 / det AS e, (m02 * m10 - m00 * m12) / det AS f FROM dt),
bx AS (SELECT vec_id, y, x, a * (x + 0.5e0) + b * (y + 0.5e0) + c AS cx, d * (x + 0.5e0) + e * (y + 0.5e0) + f AS cy, 0.5e0 * sqrt(a * a + b * b) AS hx, 0.5e0 * sqrt(d * d + e * e) AS hy FROM iv, range({size}) p(y), range({size}) q(x)),
lm AS (SELECT *, greatest(0, floor(cx - hx)::INT) AS x0, least({n}, ceil(cx + hx)::INT) AS x1, greatest(0, floor(cy - hy)::INT) AS y0, least({n}, ceil(cy + hy)::INT) AS y1 FROM bx),
k AS (SELECT lm.vec_id, lm.y, lm.x, ({edge('i.x', 'x0', 'x1', 'cx - hx', 'cx + hx')}) * ({edge('i.y', 'y0', 'y1', 'cy - hy', 'cy + hy')}) AS w, {', '.join(f'i.{c}' for c in channels)} FROM lm JOIN {source} i ON i.vec_id = lm.vec_id AND i.x >= x0 AND i.x < x1 AND i.y >= y0 AND i.y < y1),
v AS (SELECT vec_id, y, x, {means} FROM k GROUP BY vec_id, y, x),
z AS (SELECT lm.vec_id, lm.y, lm.x, {', '.join(f'coalesce(v.{c}, 0e0) AS {c}' for c in channels)} FROM lm LEFT JOIN v USING (vec_id, y, x))"""


def paste_mask(h: int, w: int) -> str:
    pv, ph = h // 5, w // 7
    k = ph + 1 if ph % 2 == 0 else ph
    r = k // 2
    kernel = f"kt AS (SELECT d, exp(-d * d / {2.0 * ph * ph!r}::DOUBLE) AS w FROM range({-r}, {r + 1}) t(d))"
    return f"""WITH plate AS (SELECT id // {w} AS y, id % {w} AS x, CASE WHEN id // {w} >= {pv} AND id // {w} < {h - pv} AND id % {w} >= {ph} AND id % {w} < {w - ph} THEN 1e0 ELSE 0e0 END AS c0 FROM range({h * w}) t(id)), {kernel}
SELECT g.y::INT AS y, g.x::INT AS x, round(sum(a.w * b.w * i.c0) / sum(a.w * b.w), 6) + 0e0 AS c0 FROM (SELECT y, x FROM plate) g CROSS JOIN kt a CROSS JOIN kt b JOIN plate i ON i.y = least(greatest(g.y + a.d, 0), {h - 1}) AND i.x = least(greatest(g.x + b.d, 0), {w - 1}) GROUP BY g.y, g.x"""


def reflect(n: int, out: int) -> str:
    """CTE ``m`` (o, s): source of each position of the padded side."""
    period = 2 * (n - 1)
    return f"m AS (SELECT o, CASE WHEN o % {period} < {n} THEN o % {period} ELSE {period} - o % {period} END AS s FROM range({out}) t(o))"


def tiles(n: int, out: int, tile: int, overlap: int) -> str:
    """CTE ``tiles`` of the padded images: tile_idx, ty, tx, and the padded place py, px."""
    step = tile - overlap
    count = (out - overlap) // step
    return f"{reflect(n, out)}, pad AS (SELECT vec_id, a.o AS py, b.o AS px, c0 FROM img JOIN m a ON img.y = a.s JOIN m b ON img.x = b.s), tiles AS (SELECT vec_id, r * {count} + c AS tile_idx, py - r * {step} AS ty, px - c * {step} AS tx, py, px, c0 FROM pad, range({count}) u(r), range({count}) v(c) WHERE py >= r * {step} AND py < r * {step} + {tile} AND px >= c * {step} AND px < c * {step} + {tile})"


def pixel_pipeline(kernel: list[float]) -> str:
    u8 = ", ".join(f"floor(least(greatest(round(c{i}, 9) * 255e0, 0e0), 255e0))::INT AS c{i}" for i in range(3))
    return f"WITH {SQL['img']}, sw AS (SELECT vec_id, y, x, c2 AS c0, c1, c0 AS c2 FROM img), {resized('sw', 'vec_id', S.LINEAR, 8, 8, 16, 16, ['c0', 'c1', 'c2'], 'z16')}, {_blurred('z16', kernel, 16, 'z')} SELECT vec_id, y::INT AS y, x::INT AS x, {u8} FROM z"
