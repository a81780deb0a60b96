"""SQL of the rectification of neighbouring cameras, in layers of common table expressions."""

from __future__ import annotations

from . import fixtures as fx

AXES = "xyz"


def _dot(*pairs: tuple[str, str]) -> str:
    return " + ".join(f"({a}) * ({b})" for a, b in pairs)


def _cross(a: list[str], b: list[str]) -> list[str]:
    return [f"({a[(i + 1) % 3]}) * ({b[(i + 2) % 3]}) - ({a[(i + 2) % 3]}) * ({b[(i + 1) % 3]})" for i in range(3)]


def _length(v: list[str]) -> str:
    return f"sqrt({_dot(*zip(v, v, strict=True))})"


def _layer(name: str, source: str, columns: dict[str, str]) -> str:
    return f"{name} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {source})"


def _vector(name: str) -> list[str]:
    return [f"{name}{i}" for i in range(3)]


def _matrix(name: str) -> list[list[str]]:
    return [[f"{name}{i}{j}" for j in range(3)] for i in range(3)]


def _around(t: list[list[str]]) -> list[list[str]]:
    """K t inverse(K), with K = ((c, 0, cx), (0, c, cy), (0, 0, 1))."""
    left = [[f"c * {t[0][j]} + cx * {t[2][j]}" for j in range(3)], [f"c * {t[1][j]} + cy * {t[2][j]}" for j in range(3)], t[2]]
    return [[f"({m[0]}) / c", f"({m[1]}) / c", f"({m[2]}) - (cx * ({m[0]}) + cy * ({m[1]})) / c"] for m in left]


def _moved(m: str, x: str, y: str, axis: int) -> str:
    """A coordinate of matrix . (x, y, 1), dehomogenised."""
    row = lambda i: f"({m}{i}0 * ({x}) + {m}{i}1 * ({y}) + {m}{i}2)"
    return f"{row(axis)} / {row(2)}"


def layers(height: str) -> str:
    """``WITH`` list whose last table ``rect`` has base, side, the entries of R (q), H1 (h), H2 (k), bounds, sizes
    and the disparity shift; ``height`` is the SQL of the table ``h`` with the mean flying height ``zf``."""
    sides = {"l": "a", "s": "b"}
    columns = [f"{t}.{a} AS {p}{a}" for p, t in sides.items() for a in AXES]
    columns += [f"{t}.r{i}{j} AS {p}{i}{j}" for p, t in sides.items() for i in range(3) for j in range(3)]
    out = [fx.ROT_SQL, height, f"p AS (SELECT a.img_id AS base, b.img_id AS side, a.c, a.cx, a.cy, a.nrows, a.ncols, zf, {', '.join(columns)} FROM rot a JOIN rot b ON b.img_id = a.img_id + 1, h WHERE a.img_id % 10 <> 9)"]
    look = {p: [f"{p}2{i}" for i in range(3)] for p in sides}
    out.append(_layer("v1", "p", {f"b{i}": f"s{a} - l{a}" for i, a in enumerate(AXES)} | {f"m{i}": f"-l2{i} / {_length(look['l'])} - s2{i} / {_length(look['s'])}" for i in range(3)}))
    out.append(_layer("v2", "v1", dict(zip(_vector("a"), _cross(_vector("b"), _vector("m")), strict=True))))
    out.append(_layer("v3", "v2", dict(zip(_vector("g"), _cross(_vector("b"), _vector("a")), strict=True))))
    out.append(_layer("v4", "v3", {f"q{i}{j}": f"{v}{j} / {_length(_vector(v))}" for i, v in enumerate("bag") for j in range(3)}))
    out.append(_layer("v5", "v4", {f"{t}{i}{j}": _dot(*[(f"{p}{i}{k}", f"q{j}{k}") for k in range(3)]) for t, p in (("t", "l"), ("u", "s")) for i in range(3) for j in range(3)}))
    maps = {}
    for t, forth, back in (("t", "h", "i"), ("u", "k", "j")):
        m = _matrix(t)
        turned = [[m[j][i] for j in range(3)] for i in range(3)]
        for name, entries in ((forth, _around(m)), (back, _around(turned))):
            maps |= {f"{name}{i}{j}": entries[i][j] for i in range(3) for j in range(3)}
    out.append(_layer("v6", "v5", maps))
    corners = [(x, y) for x in ("0", "ncols") for y in ("0", "nrows")]
    bounds = {}
    for axis, name in enumerate("xy"):
        places = ", ".join(_moved(m, x, y, axis) for m in "ij" for x, y in corners)
        bounds |= {f"{name}_min": f"least({places})", f"{name}_max": f"greatest({places})"}
    ground = [f"(l2{i} * zf + l{a} - s{a})" for i, a in enumerate(AXES)]
    seen = [_dot(*[(f"s{i}{k}", ground[k]) for k in range(3)]) for i in range(3)]
    bounds |= {"ux": f"(c * ({seen[0]}) + cx * ({seen[2]})) / ({seen[2]})", "uy": f"(c * ({seen[1]}) + cy * ({seen[2]})) / ({seen[2]})"}
    out.append(_layer("v7", "v6", bounds))
    last = {"out_rows": "ceil(y_max - y_min)::INT", "out_cols": "ceil(x_max - x_min)::INT", "shift": f"trunc(({_moved('i', 'cx', 'cy', 0)} - {_moved('j', 'ux', 'uy', 0)}) * 0.9::DOUBLE)::INT"}
    out.append(_layer("rect", "v7", last))
    return ", ".join(out)
