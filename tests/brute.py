"""Plain, slow versions of the operators, for small inputs in tests only."""

import itertools
import math

KEY = 20


def key(t, y, x):
    return (t << (2 * KEY)) + (y << KEY) + x


def flood_fill(cells, slice_only=False, wrap_nx=None, within=None):
    """``{(run, t, y, x): object_key}`` for a set of cells."""
    seen, out = set(), {}
    for start in sorted(cells):
        if start in seen:
            continue
        seen.add(start)
        body, todo = [], [start]
        while todo:
            run, t, y, x = cell = todo.pop()
            body.append(cell)
            near = [
                (run, t + dt, y + dy, x + dx)
                for dt in ([0] if slice_only else [-1, 0, 1])
                for dy in (-1, 0, 1)
                for dx in (-1, 0, 1)
            ]
            if wrap_nx and x == 0:
                near.append((run, t, y, wrap_nx - 1))
            if wrap_nx and x == wrap_nx - 1:
                near.append((run, t, y, 0))
            for c in near:
                if c in cells and c not in seen and (within is None or within[c] == within[cell]):
                    seen.add(c)
                    todo.append(c)
        first = min(key(*c[1:]) for c in body)
        out |= {c: first for c in body}
    return out


def fold(j, n):
    j %= 2 * n
    return j if j < n else 2 * n - 1 - j


def boxcar(values, size):
    n = len(values)
    lo = -(size // 2)
    out = []
    for i in range(n):
        got = [values[fold(i + k, n)] for k in range(lo, lo + size)]
        got = [v for v in got if v is not None]
        out.append((sum(got), len(got)))
    return out


def gaussian(values, sigma, truncate=4.0):
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    n = len(values)
    return [
        sum(w[k + r] * values[fold(i + k, n)] for k in range(-r, r + 1)) / sum(w) for i in range(n)
    ]


def rectangle_area(points):
    """Least box area over all point-pair directions."""
    best = math.inf
    for (ax, ay), (bx, by) in itertools.combinations(points, 2):
        a = math.atan2(by - ay, bx - ax)
        u = [x * math.cos(a) + y * math.sin(a) for x, y in points]
        v = [y * math.cos(a) - x * math.sin(a) for x, y in points]
        best = min(best, (max(u) - min(u)) * (max(v) - min(v)))
    return best
