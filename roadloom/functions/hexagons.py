"""Hierarchical hexagonal cells on an icosahedron: the H3 index as native expressions on longs.

A point goes to the nearest of twenty faces and is projected onto it. Each resolution has a seventh of the coarser one's
area, so a cell is a base cell and a digit, 0 to 6, for each resolution. Positions on a face are lattice points
a + b * j, j being a third of a turn. What is known of faces and base cells is computed once, in Python, from the fixed
values below, and enters the plan as literals.
"""

from __future__ import annotations

import cmath
import functools
import json
import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published index, in its order.
#: Of each face: latitude and longitude of its centre and the azimuth of its first axis, in radians.
FACES = [
    (0.803582649718989942, 1.248397419617396099, 5.619958268523939882),
    (1.307747883455638156, 2.536945009877921159, 5.760339081714187279),
    (1.054751253523952054, -1.347517358900396623, 0.780213654393430055),
    (0.600191595538186799, -0.450603909469755746, 0.430469363979999913),
    (0.491715428198773866, 0.401988202911306943, 6.130269123335111400),
    (0.172745327415618701, 1.678146885280433686, 2.692877706530642877),
    (0.605929321571350690, 2.953923329812411617, 2.982963003477243874),
    (0.427370518328979641, -1.888876200336285401, 3.532912002790141181),
    (-0.079066118549212831, -0.733429513380867741, 3.494305004259568154),
    (-0.230961644455383637, 0.506495587332349035, 3.003214169499538391),
    (0.079066118549212831, 2.408163140208925497, 5.930472956509811562),
    (0.230961644455383637, -2.635097066257444203, 0.138378484090254847),
    (-0.172745327415618701, -1.463445768309359553, 0.448714947059150361),
    (-0.605929321571350690, -0.187669323777381622, 0.158629650112549365),
    (-0.427370518328979641, 1.252716453253507838, 5.891865957979238535),
    (-0.600191595538186799, 2.690988744120037492, 2.711123289609793325),
    (-0.491715428198773866, -2.739604450678486295, 3.294508837434268316),
    (-0.803582649718989942, -1.893195233972397139, 3.804819692245439833),
    (-1.307747883455638156, -0.604647643711872080, 3.664438879055192436),
    (-1.054751253523952054, 1.794075294689396615, 2.361378999196363184),
]
#: Of each base cell: its face and its place there, as steps along the face's three axes. Those at 200 are pentagons.
BASES = """
1:100 2:110 1:000 2:100 0:200 1:110 1:001 2:000 0:100 2:010 1:010 1:011 3:100 3:110 11:200 4:100 0:000 6:010 0:001 2:011
7:001 2:001 0:110 6:001 10:200 6:000 3:000 11:100 4:110 3:010 0:011 4:000 5:010 0:010 7:010 11:110 7:000 10:100 12:200 6:101
7:101 4:001 3:001 3:011 4:010 6:100 11:000 8:001 5:001 14:200 5:000 12:100 10:110 4:011 12:110 7:100 11:010 10:000 13:200 10:001
11:001 9:010 8:010 6:200 8:000 9:001 14:100 5:101 16:011 8:101 5:100 12:000 7:200 12:010 10:010 9:000 13:100 16:001 15:011 15:010
16:010 14:110 13:110 5:200 8:100 14:000 9:101 14:001 17:001 12:001 16:000 17:011 15:001 16:101 9:100 15:000 13:000 8:200 13:010 17:101
19:010 14:010 19:011 17:010 13:001 17:000 16:100 9:200 15:101 15:100 18:011 18:001 19:001 17:100 19:000 18:010 18:101 19:200 19:100 18:000
19:101 18:100
""".split()
#: What a unit of resolution 0 measures on a face's plane, which touches the unit sphere.
UNIT = 0.38196601125010500003
#: By digit, from 1: the direction of the finer cell, in sixths of a turn.
TURNS = {1: 4, 2: 2, 3: 3, 4: 0, 5: 5, 6: 1}

_DIGITS = {turn: digit for digit, turn in TURNS.items()}
_TILT = math.asin(math.sqrt(3 / 28))  # by which odd resolutions are turned
_MODE = 1 << 59
_J = cmath.rect(1, 2 * math.pi / 3)
#: The directions around a pentagon, counterclockwise from its own face's; that of digit 1 is left out.
_FAN = [3, 5, 0, 1, 2]


def _sixths(z: complex) -> int:
    return round(cmath.phase(z) * 3 / math.pi) % 6


def _lattice(z: complex) -> tuple[int, int]:
    b = z.imag * 2 / math.sqrt(3)
    return round(z.real + b / 2), round(b)


class _Icosahedron:
    """Tables of faces and base cells."""

    def __init__(self) -> None:
        self.axes = []
        for lat, lon, azimuth in FACES:
            north = (-math.sin(lat) * math.cos(lon), -math.sin(lat) * math.sin(lon), math.cos(lat))
            east = (-math.sin(lon), math.cos(lon), 0.0)
            along = lambda az, n=north, e=east: tuple(math.cos(az) * p + math.sin(az) * q for p, q in zip(n, e, strict=True))
            self.axes.append(((math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)), along(azimuth), along(azimuth - math.pi / 2)))
        self.corners = [2 * _J**c for c in range(3)]
        places = [self.corners[0] * 0, *[c / 2 for c in self.corners], *[-c / 2 for c in self.corners], *self.corners]
        at = [[self.point(f, z) for z in self.corners] for f in range(20)]
        same = lambda p, q: math.dist(p, q) < 1e-6
        # Across the edge from corner e to the next: the other face, and the turn and shift that lead to its plane.
        self.across = [[None] * 3 for _ in range(20)]
        for f in range(20):
            for e in range(3):
                ends = (e, (e + 1) % 3)
                for g in range(20):
                    there = [next((c for c in range(3) if same(at[f][k], at[g][c])), None) for k in ends]
                    if g != f and None not in there:
                        (z0, z1), (w0, w1) = ([self.corners[k] for k in ks] for ks in (ends, there))
                        turn = (w1 - w0) / (z1 - z0)
                        self.across[f][e] = (g, turn, w0 - turn * z0)
        homes = []
        for text in BASES:
            face, steps = text.split(":")
            homes.append((int(face), sum(int(n) * _J**i for i, n in enumerate(steps))))
        centres = [self.point(f, z) for f, z in homes]
        #: By base cell and leading digit: the face, the place there, and the turn from the base cell's own plane.
        self.home = [[(f, z, 0)] * 7 for f, z in homes]
        #: By face, a and b: the base cell, and by leading digit the turn to the base cell's own plane.
        self.base: dict[tuple[int, int, int], tuple[int, list[int]]] = {}
        self.pentagons = [b for b, text in enumerate(BASES) if text.endswith("200")]
        fans = {b: self._fan(b, homes[b][0]) for b in self.pentagons}
        for f in range(20):
            for z in places:
                p = self.point(f, z)
                b = next(i for i, q in enumerate(centres) if same(p, q))
                turns = [0] * 7
                if b in fans:
                    corner = self.corners.index(z)
                    step = fans[b].index((f, corner))
                    inwards = (2 * corner + 3) % 6
                    self.home[b][_DIGITS[_FAN[step]]] = (f, z, (inwards - _FAN[step]) % 6)
                    for digit, turn in TURNS.items():
                        away = (turn - inwards + 2) % 6 - 2
                        turns[digit] = (_FAN[(step + away) % 5] - turn) % 6
                elif homes[b][0] != f:
                    turns = [next(_sixths(turn) for g, turn, _ in self.across[f] if g == homes[b][0])] * 7
                self.base[(f, *_lattice(z))] = (b, turns)
        inner = dict(self.base)
        for f in range(20):
            for g, turn, shift in self.across[f]:
                for (h, a, b), (cell, turns) in inner.items():
                    key = (f, *_lattice((a + b * _J - shift) / turn))
                    if h == g and key not in inner and max(abs(v) for v in key[1:]) <= 2:
                        more = _sixths(turn)
                        self.base[key] = (cell, [(more + turns[_DIGITS[(TURNS[d] + more) % 6] if d else 0]) % 6 for d in range(7)])

    def point(self, face: int, z: complex) -> tuple[float, float, float]:
        c, e1, e2 = self.axes[face]
        p = [c[i] + UNIT * (z.real * e1[i] + z.imag * e2[i]) for i in range(3)]
        return tuple(v / math.hypot(*p) for v in p)

    def _fan(self, base: int, face: int) -> list[tuple[int, int]]:
        """The faces around a pentagon, and which of their corners it is, counterclockwise from its own."""
        out, corner = [], 0
        for _ in range(5):
            out.append((face, corner))
            face, turn, shift = self.across[face][(corner + 2) % 3]
            z = self.corners[corner] * turn + shift
            corner = min(range(3), key=lambda c: abs(self.corners[c] - z))
        return out


@functools.cache
def _icosahedron() -> _Icosahedron:
    return _Icosahedron()


def _table(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _levels(levels: range) -> Column:
    """(odd, bits: where the digit stands) of resolutions."""
    return F.from_json(F.lit(json.dumps([{"odd": r % 2, "bits": 3 * (15 - r)} for r in levels])), "array<struct<odd: int, bits: int>>")


def _check(resolution: int) -> int:
    if not 0 <= resolution <= 15:
        raise ValueError("resolution must be from 0 to 15")
    return resolution


def _unused(resolution: int) -> int:
    """The bits of the digits beyond a resolution, all set."""
    return (1 << 3 * (15 - resolution)) - 1


def _shift(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by)


def _unshift(value: Column, by: Column) -> Column:
    return F.call_function("shiftright", value, by)


def _rounded_seventh(v: Column) -> Column:
    """The nearest whole number to v / 7; there are no ties."""
    return F.floor((v * 2 + 7) / 14.0).cast("long")


def _cell_at(lat: Column, lon: Column, resolution: int) -> Column:
    ico = _icosahedron()
    axes = _table([[v for part in face for v in part] for face in ico.axes], "array<double>")
    at = [ico.base.get((f, a, b), (0, [0] * 7)) for f in range(20) for a in range(-2, 3) for b in range(-2, 3)]
    bases, turns = _table([b for b, _ in at], "int"), _table([t for _, ts in at for t in ts], "int")
    digits = _table([1, 3, 0, 5, 0, 2, 0, 4, 6], "int")  # by (a + 1) * 3 + b + 1
    order = [_DIGITS[t] for t in range(6)]
    turned = _table([0 if d == 0 else order[(TURNS[d] + n) % 6] for n in range(6) for d in range(7)], "int")
    scale, tilt = math.sqrt(7) ** resolution / UNIT, _TILT * (resolution % 2)

    def on_face(s: Column) -> Column:
        """The place in units of the resolution, from a point and its face."""
        dot = lambda k: F.get(s.axes, F.lit(3 * k)) * s.x + F.get(s.axes, F.lit(3 * k + 1)) * s.y + F.get(s.axes, F.lit(3 * k + 2)) * s.z
        x, y = dot(1) / dot(0) * scale, dot(2) / dot(0) * scale
        turned_x, turned_y = x * math.cos(tilt) + y * math.sin(tilt), y * math.cos(tilt) - x * math.sin(tilt)
        return F.struct(s.face.alias("face"), (turned_x - turned_y / math.sqrt(3)).alias("q"), (turned_y * 2 / math.sqrt(3)).alias("r"))

    def nearest(s: Column) -> Column:
        """The lattice point whose hexagon holds the place."""
        q, r, t = F.rint(s.q), F.rint(s.r), F.rint(-s.q - s.r)
        dq, dr, dt = F.abs(q - s.q), F.abs(r - s.r), F.abs(t + s.q + s.r)
        best_q = F.when((dq > dr) & (dq > dt), -r - t).otherwise(q).cast("long")
        best_r = F.when((dq > dr) & (dq > dt), r).when(dr > dt, -q - t).otherwise(r).cast("long")
        return F.struct(s.face.alias("face"), (best_q + best_r).alias("a"), best_r.alias("b"))

    def coarser(acc: Column, level: Column) -> Column:
        odd, a, b = level.odd == 1, acc.a, acc.b
        up = F.struct(_rounded_seventh(F.when(odd, a * 3 - b).otherwise(a * 2 + b)).alias("a"), _rounded_seventh(F.when(odd, a + b * 2).otherwise(b * 3 - a)).alias("b"))

        def step(c: Column) -> Column:
            rest_a, rest_b = a - F.when(odd, c.a * 2 + c.b).otherwise(c.a * 3 - c.b), b - F.when(odd, c.b * 3 - c.a).otherwise(c.a + c.b * 2)
            digit = F.get(digits, ((rest_a + 1) * 3 + rest_b + 1).cast("int"))
            return _let(digit, lambda d: F.struct(c.a.alias("a"), c.b.alias("b"), F.when(d == 0, acc.lead).otherwise(d).alias("lead"), acc.bits.bitwiseOR(_shift(d.cast("long"), level.bits)).alias("bits")))

        return _let(up, step)

    def packed(s: Column) -> Column:
        zero = F.struct(s.a.alias("a"), s.b.alias("b"), F.lit(0).alias("lead"), F.lit(0).cast("long").alias("bits"))
        found = F.aggregate(_levels(range(resolution, 0, -1)), zero, coarser) if resolution else zero
        spot = lambda c: (s.face * 25 + (c.a + 2) * 5 + c.b + 2).cast("int")

        def whole(c: Column) -> Column:
            turn = F.get(turns, spot(c) * 7 + c.lead)
            bits = c.bits
            if resolution:
                bits = _let(turn, lambda n: F.aggregate(_levels(range(1, resolution + 1)), F.lit(0).cast("long"), lambda acc, level: acc.bitwiseOR(_shift(F.get(turned, n * 7 + _unshift(c.bits, level.bits).bitwiseAND(F.lit(7)).cast("int")).cast("long"), level.bits))))
            head = F.lit(_MODE | resolution << 52 | _unused(resolution)).cast("long")
            return head.bitwiseOR(_shift(F.get(bases, spot(c)).cast("long"), F.lit(45))).bitwiseOR(bits)

        return _let(found, whole)

    phi, lam = F.radians(lat), F.radians(lon)
    point = F.struct((F.cos(phi) * F.cos(lam)).alias("x"), (F.cos(phi) * F.sin(lam)).alias("y"), F.sin(phi).alias("z"))
    dots = lambda p: F.transform(axes, lambda a: F.get(a, F.lit(0)) * p.x + F.get(a, F.lit(1)) * p.y + F.get(a, F.lit(2)) * p.z)
    with_face = lambda p: _let(_let(dots(p), lambda d: (F.array_position(d, F.array_max(d)) - 1).cast("int")), lambda f: F.struct(f.alias("face"), F.get(axes, f).alias("axes"), p.x.alias("x"), p.y.alias("y"), p.z.alias("z")))
    return _let(_let(_let(_let(point, with_face), on_face), nearest), packed)


def cell(lat: Column, lon: Column, resolution: int) -> Column:
    """The cell (long) that holds a point; null where a coordinate is null, NaN or infinite."""
    _check(resolution)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.when(finite(lat) & finite(lon), _cell_at(lat, lon, resolution))


def resolution_of(cells: Column) -> Column:
    return _unshift(cells, F.lit(52)).bitwiseAND(F.lit(15)).cast("int")


def base_of(cells: Column) -> Column:
    return _unshift(cells, F.lit(45)).bitwiseAND(F.lit(127)).cast("int")


def is_pentagon(cells: Column) -> Column:
    """Whether a cell has five sides: a pentagonal base cell, or its middle at a finer resolution."""
    digits = cells.bitwiseAND(F.lit((1 << 45) - 1).cast("long"))
    empty = _table([_unused(r) for r in range(16)], "long")
    return base_of(cells).isin(_icosahedron().pentagons) & (digits == F.get(empty, resolution_of(cells)))


def parent(cells: Column, resolution: int) -> Column:
    """The cell of a coarser (or the same) resolution that a cell belongs to; null for a coarser cell."""
    _check(resolution)
    kept = cells.bitwiseAND(F.lit(~(15 << 52)).cast("long")).bitwiseOR(F.lit(resolution << 52 | _unused(resolution)).cast("long"))
    return F.when(resolution_of(cells) >= resolution, kept)


def children(cells: Column, resolution: int) -> Column:
    """The array of a cell's cells at the next finer resolution (or, for each, at those below, up to ``resolution``), in
    order; a pentagon has six. Null for a cell that is finer, or more than 8 resolutions coarser."""
    _check(resolution)
    own = resolution_of(cells)

    def finer(c: Column) -> Column:
        bits = (F.lit(15) - own) * 3
        count = F.pow(F.lit(7.0), (F.lit(resolution) - own).cast("double")).cast("long")
        head = c.bitwiseAND(F.lit(~((15 << 52) | _unused(0))).cast("long")).bitwiseOR(F.lit(resolution << 52 | _unused(resolution)).cast("long"))
        kept = _shift(_unshift(c.bitwiseAND(F.lit(_unused(0)).cast("long")), bits), bits)

        def nth(n: Column) -> Column:
            start = F.struct(n.alias("n"), F.lit(0).cast("long").alias("bits"), F.lit(0).cast("long").alias("lead"))
            down = F.aggregate(
                F.filter(_levels(range(resolution, 0, -1)), lambda level: level.bits < bits), start,
                lambda acc, level: F.struct(F.floor(acc.n / 7.0).cast("long").alias("n"), acc.bits.bitwiseOR(_shift(acc.n % 7, level.bits)).alias("bits"), F.when(acc.n % 7 == 0, acc.lead).otherwise(acc.n % 7).alias("lead")),
            )
            return _let(down, lambda s: F.struct(head.bitwiseOR(kept).bitwiseOR(s.bits).alias("cell"), s.lead.alias("lead")))

        every = F.transform(F.sequence(F.lit(0).cast("long"), count - 1), nth)
        return F.transform(F.filter(every, lambda s: ~(is_pentagon(c) & (s.lead == 1))), lambda s: s.cell)

    return F.when((own <= resolution) & (F.lit(resolution) - own <= 8), _let(cells, finer))


def _digits_place(cells: Column) -> Column:
    """(a, b, lead): a cell's place from its base cell's middle, on the base cell's own plane."""
    start = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("lead"))
    # Steps by digit, along 1 and j.
    steps = _table([[0, 0], [-1, -1], [0, 1], [-1, 0], [1, 0], [0, -1], [1, 1]], "array<int>")
    used = F.filter(_levels(range(1, 16)), lambda level: level.bits >= (F.lit(15) - resolution_of(cells)) * 3)

    def finer(acc: Column, level: Column) -> Column:
        odd = level.odd == 1
        down = lambda d: F.struct(
            (F.when(odd, acc.a * 2 + acc.b).otherwise(acc.a * 3 - acc.b) + F.get(F.get(steps, d), F.lit(0))).alias("a"),
            (F.when(odd, acc.b * 3 - acc.a).otherwise(acc.a + acc.b * 2) + F.get(F.get(steps, d), F.lit(1))).alias("b"),
            F.when(acc.lead == 0, d).otherwise(acc.lead).alias("lead"),
        )
        return _let(_unshift(cells, level.bits).bitwiseAND(F.lit(7)).cast("int"), down)

    return F.aggregate(used, start, finer)


def _on_own_face(place: Column) -> Column:
    """(face, x, y) of a place beyond its face's edges, on the plane of the face that holds it."""
    across = _table([[[g, turn.real, turn.imag, shift.real, shift.imag] for g, turn, shift in edges] for edges in _icosahedron().across], "array<array<double>>")
    out = [(math.cos(math.pi / 3 * (1 + 2 * e)), math.sin(math.pi / 3 * (1 + 2 * e))) for e in range(3)]

    def cross(s: Column, _: Column) -> Column:
        beyond = F.array(*[s.x * c + s.y * d for c, d in out])
        over = lambda e: F.struct(
            F.get(e, F.lit(0)).cast("int").alias("face"), (s.x * F.get(e, F.lit(1)) - s.y * F.get(e, F.lit(2)) + F.get(e, F.lit(3))).alias("x"),
            (s.x * F.get(e, F.lit(2)) + s.y * F.get(e, F.lit(1)) + F.get(e, F.lit(4))).alias("y"),
        )
        pick = lambda d: F.when(F.array_max(d) > 1 + 1e-9, _let(F.get(F.get(across, s.face), (F.array_position(d, F.array_max(d)) - 1).cast("int")), over)).otherwise(s)
        return _let(beyond, pick)

    return F.aggregate(F.sequence(F.lit(1), F.lit(3)), place, cross)


def _place(cells: Column) -> Column:
    """(face, x, y): where a cell's middle lies, in units of resolution 0."""
    home = _table([[f, z.real, z.imag, turn] for by_digit in _icosahedron().home for f, z, turn in by_digit], "array<double>")

    def turned(s: Column) -> Column:
        r = resolution_of(cells)
        x, y = s.p.a - s.p.b * 0.5, s.p.b * (math.sqrt(3) / 2)
        angle = F.get(s.home, F.lit(3)) * (math.pi / 3) + (r % 2) * _TILT
        size = F.pow(F.lit(7.0), r * -0.5)
        return F.struct(
            F.get(s.home, F.lit(0)).cast("int").alias("face"), (F.get(s.home, F.lit(1)) + (x * F.cos(angle) - y * F.sin(angle)) * size).alias("x"),
            (F.get(s.home, F.lit(2)) + (x * F.sin(angle) + y * F.cos(angle)) * size).alias("y"),
        )

    at = _let(_digits_place(cells), lambda p: F.struct(p.alias("p"), F.get(home, base_of(cells) * 7 + p.lead).alias("home")))
    return _on_own_face(_let(at, turned))


def _on_sphere(place: Column) -> Column:
    axes = _table([[v for part in face for v in part] for face in _icosahedron().axes], "array<double>")

    def lift(s: Column) -> Column:
        part = lambda k: F.get(s.axes, F.lit(k)) + UNIT * (s.x * F.get(s.axes, F.lit(k + 3)) + s.y * F.get(s.axes, F.lit(k + 6)))
        return F.struct(part(0).alias("x"), part(1).alias("y"), part(2).alias("z"))

    with_axes = _let(place, lambda s: F.struct(F.get(axes, s.face).alias("axes"), s.x.alias("x"), s.y.alias("y")))
    return _let(_let(with_axes, lift), lambda p: F.struct(F.degrees(F.atan2(p.z, F.sqrt(p.x * p.x + p.y * p.y))).alias("lat"), F.degrees(F.atan2(p.y, p.x)).alias("lon")))


def centre(cells: Column) -> Column:
    """(lat, lon) of a cell's middle."""
    return F.when(cells.isNotNull(), _on_sphere(_place(cells)))


def neighbours(cells: Column, resolution: int) -> Column:
    """The cells, in order, that share a side with a cell of ``resolution``: six, or five around a pentagon. Null for
    cells of another one."""
    size, tilt = math.sqrt(7) ** -_check(resolution), _TILT * (resolution % 2)
    steps = _table([[size * math.cos(tilt + k * math.pi / 3), size * math.sin(tilt + k * math.pi / 3)] for k in range(6)], "array<double>")

    def beside(s: Column) -> Column:
        places = F.transform(steps, lambda d: F.struct(s.face.alias("face"), (s.x + F.get(d, F.lit(0))).alias("x"), (s.y + F.get(d, F.lit(1))).alias("y")))
        points = F.transform(places, lambda p: _on_sphere(_on_own_face(p)))
        return F.array_sort(F.array_distinct(F.transform(points, lambda p: _cell_at(p.lat, p.lon, resolution))))

    return F.when(resolution_of(cells) == resolution, _let(_place(cells), beside))


def text_of(cells: Column) -> Column:
    """A cell's usual text: lowercase hexadecimal digits."""
    return F.lower(F.hex(cells))


def cell_of_text(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("long")
