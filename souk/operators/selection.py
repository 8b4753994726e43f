"""Tiles over a whole table by distributed selection: no sort, no range exchange, no join-back.

``ntile(k) over (order by ...)`` needs only ``k - 1`` facts: the rows that open the second
to the last tile. Several such windows over one frame are answered together:

1. *Digits.* Every order column becomes a sequence of numbers that ascend with it: a class
   (null, -infinity, finite, +infinity, NaN), then for numbers the value as a double and what
   the double leaves over, for text six bytes at a time and at last the length. The columns'
   sequences joined in order compare like the rows themselves.
2. *Cells.* A pass counts rows per cell of the current digit (``CELLS`` equal steps between
   the least and the greatest digit seen) inside the few cells that still hold a wanted row,
   for all windows at once: one partial aggregation, at most ``CELLS`` rows per wanted row to
   the driver. A cell that holds one digit only is entered at the next digit, so a value that
   two thirds of all rows share is divided by the tie key like anything else; the bounds of
   the next digits come with each pass, so digits that do not differ cost none.
3. *Cuts.* A wanted row is known once it is the first of its cell. A row's tile is then one
   plus the number of cuts it does not precede: a projection with comparisons.

The frame is read once per pass, so it should be a stored table; passes read the order
columns only. There is no cap and no other path for small inputs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = 4096
BYTES = 6                 # of a text per digit: 48 bits are exact in a double
AHEAD = 4                 # digits whose bounds a pass finds, the current one included


@dataclass(frozen=True)
class Tiles:
    """``ntile(tiles) over (order by order)`` as column ``out``; ``order`` is
    ``(column, ascending)`` and ends with a unique key."""

    order: Sequence[tuple[str, bool]]
    tiles: int
    out: str


@dataclass
class _Cell:
    """Rows whose digits before ``at`` equal ``path`` and whose digit ``at`` is in [low, high].
    Classes are null 0, -infinity 1, finite 2, +infinity 3, NaN 4."""

    path: tuple[float, ...]
    low: float
    high: float
    before: int                                     # rows that precede the cell
    wanted: list[int] = field(default_factory=list)  # row numbers looked for in it

    @property
    def at(self) -> int:
        return len(self.path)


def _num(x: float) -> str:
    return f"{float(x)!r}D"


class _Digits:
    """SQL expressions of doubles that compare, one after the other, like ``order`` does; each
    is built when it is asked for, as a text has as many as its length needs. (Text, because a
    pass holds hundreds of comparisons and each Column operation is a call into the JVM.)"""

    def __init__(self, df: DataFrame, order: Sequence[tuple[str, bool]], longest: dict[str, int]):
        self.df, self.longest = df, longest
        self.places: list[tuple[str, bool, int]] = []       # (column, ascending, digit of the column)
        for name, ascending in order:
            kind = df.schema[name].dataType
            n = 2
            if isinstance(kind, (T.StringType, T.BinaryType)):
                n = 2 + -(-longest[name] // BYTES)
            elif isinstance(kind, (T.LongType, T.TimestampType, T.DecimalType)):
                n = 3
            self.places += [(name, ascending, i) for i in range(n)]

    def __len__(self) -> int:
        return len(self.places)

    def __getitem__(self, at: int) -> str:
        name, ascending, digit = self.places[at]
        kind, c = self.df.schema[name].dataType, f"`{name}`"
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            value = self._of_double(f"CAST({c} AS DOUBLE)", digit)
        elif digit == 0:
            value = f"IF({c} IS NULL, 0D, 2D)"
        elif isinstance(kind, (T.StringType, T.BinaryType)):
            value = self._of_text(c, (digit - 1) * BYTES, self.longest[name])
        else:
            value = self._of_number(c, kind, digit)
        return f"{'' if ascending else '-'}coalesce({value}, 0D)"

    @staticmethod
    def _of_double(v: str, digit: int) -> str:
        klass = (f"CASE WHEN {v} IS NULL THEN 0D WHEN isnan({v}) THEN 4D WHEN {v} = double('inf') THEN 3D "
                 f"WHEN {v} = double('-inf') THEN 1D ELSE 2D END")
        return klass if digit == 0 else f"IF(({klass}) = 2D, {v}, 0D)"

    @staticmethod
    def _of_text(c: str, at: int, longest: int) -> str:
        if at >= longest:
            return f"CAST(octet_length({c}) AS DOUBLE)"
        piece = f"hex(substring(CAST({c} AS BINARY), {at + 1}, {BYTES}))"
        return f"CAST(conv(rpad({piece}, {2 * BYTES}, '0'), 16, 10) AS DOUBLE)"

    @staticmethod
    def _of_number(c: str, kind: T.DataType, digit: int) -> str:
        if isinstance(kind, T.TimestampType):
            c = f"unix_micros({c})"
        elif isinstance(kind, T.DateType):
            c = f"unix_date({c})"
        elif isinstance(kind, T.BooleanType):
            c = f"CAST({c} AS INT)"
        near = f"CAST({c} AS DOUBLE)"
        if digit == 1:
            return near
        # what a double leaves over of more than 53 bits
        exact = f"DECIMAL(38,{kind.scale if isinstance(kind, T.DecimalType) else 0})"
        return f"CAST(CAST({c} AS {exact}) - try_cast({near} AS {exact}) AS DOUBLE)"


def _inside(name, cell: _Cell) -> str:
    return " AND ".join([f"{name(cell.at)} BETWEEN {_num(cell.low)} AND {_num(cell.high)}",
                         *[f"{name(i)} = {_num(v)}" for i, v in enumerate(cell.path)]])


def _step(digit: str, cell: _Cell) -> str:
    """Number of the cell's equal step that holds ``digit``: it never falls as digits rise."""
    if not cell.low < cell.high:
        return "0"
    half = 0.5 if math.isinf(cell.high - cell.low) else 1.0
    width = cell.high * half - cell.low * half
    share = f"({digit} * {_num(half)} - {_num(cell.low * half)}) / {_num(width)} * {CELLS}"
    return f"CAST(least(floor({share}), {CELLS - 1}) AS INT)"


def _before(name, cut: tuple[float, ...]) -> str:
    """Whether a row's first digits compare below those of ``cut``."""
    cond = "false"
    for i in reversed(range(len(cut))):
        cond = f"({name(i)} < {_num(cut[i])} OR ({name(i)} = {_num(cut[i])} AND {cond}))"
    return cond


def _bounds(names: Sequence[str]) -> str:
    return ", ".join(f"min({d}) AS low{k}, max({d}) AS high{k}" for k, d in enumerate(names))


def _entered(path: tuple[float, ...], row, n: int, before: int, rows: list[int]) -> _Cell:
    """The cell behind ``path`` with the bounds of its next ``n`` digits in ``row``; digits
    that are the same in all its rows join the path."""
    known = [(row[f"low{k}"], row[f"high{k}"]) for k in range(n)]
    while len(known) > 1 and known[0][0] == known[0][1]:
        path, known = (*path, known[0][0]), known[1:]
    return _Cell(path, *known[0], before, rows)


def _select(df: DataFrame, windows: list[_Digits], roots: list[_Cell | None]) -> list[dict[int, tuple[float, ...]]]:
    """Per window: the digits from which on rows have at least a wanted row number."""
    found: list[dict[int, tuple[float, ...]]] = [{} for _ in windows]
    open_ = [[root] if root else [] for root in roots]
    while any(open_):
        marks, cells, used = [], [], {}
        for w, (digits, some) in enumerate(zip(windows, open_)):
            for cell in some:
                depth = range(cell.at, min(cell.at + AHEAD, len(digits)))
                used |= {f"d{w}_{i}": digits[i] for i in range(depth.stop) if f"d{w}_{i}" not in used}
                ahead = [f"d{w}_{i}" for i in depth] + ["0D"] * (AHEAD - len(depth))
                fields = [f"'cell', {len(cells)}, 'step', {_step(ahead[0], cell)}",
                          *[f"'d{k}', {d}" for k, d in enumerate(ahead)]]
                marks.append(f"IF({_inside(lambda i, w=w: f'd{w}_{i}', cell)}, named_struct({', '.join(fields)}), NULL)")
                cells.append((w, cell, len(depth)))
        hits = (df.selectExpr(*[f"{text} AS {name}" for name, text in used.items()])
                .selectExpr(f"inline(filter(array({', '.join(marks)}), m -> m IS NOT NULL))"))
        bounds = _bounds([f"d{k}" for k in range(AHEAD)]).split(", ")
        steps = hits.groupBy("cell", "step").agg(*map(F.expr, ["count(1) AS n", *bounds])).collect()
        by_cell: dict[int, list] = {}
        for r in sorted(steps, key=lambda r: (r["cell"], r["step"])):
            by_cell.setdefault(r["cell"], []).append(r)
        open_ = [[] for _ in windows]
        for number, (w, cell, n) in enumerate(cells):
            before = cell.before
            for r in by_cell.get(number, ()):
                here = [k for k in cell.wanted if before < k <= before + r["n"]]
                # the first row of a step needs no further look
                if here and here[0] == before + 1:
                    found[w][here.pop(0)] = (*cell.path, r["low0"])
                if here:
                    inner = _entered(cell.path, r, n, before, here)
                    if inner.low == inner.high and inner.at + 1 == len(windows[w]):
                        raise ValueError("the order is not total: equal rows hold a wanted place")
                    open_[w].append(inner)
                before += r["n"]
    return found


def tile_sizes(n: int, tiles: int) -> list[int]:
    """Rows of each tile: the first ``n mod tiles`` hold one more, as in the SQL standard."""
    return [n // tiles + (t < n % tiles) for t in range(tiles)]


def with_tiles(df: DataFrame, windows: Sequence[Tiles]) -> DataFrame:
    """``df`` (a stored frame) with the tile columns of all ``windows``."""
    texts = {name for w in windows for name, _ in w.order
             if isinstance(df.schema[name].dataType, (T.StringType, T.BinaryType))}
    longest = {c: 0 for c in texts}
    if texts:
        sizes = df.selectExpr(*[f"coalesce(max(octet_length(`{c}`)), 0) AS `{c}`" for c in longest]).first()
        longest = {c: sizes[c] for c in longest}
    digits = [_Digits(df, w.order, longest) for w in windows]
    known = [min(AHEAD, len(d)) for d in digits]
    ends = df.selectExpr("count(1) AS n", *[
        "named_struct(" + ", ".join(f"'low{i}', min({d[i]}), 'high{i}', max({d[i]})" for i in range(n)) + f") AS w{k}"
        for k, (d, n) in enumerate(zip(digits, known))]).first()
    roots = []
    for k, w in enumerate(windows):
        sizes = tile_sizes(ends["n"], w.tiles)
        firsts = [1 + sum(sizes[:t]) for t in range(1, w.tiles) if sizes[t]]
        roots.append(_entered((), ends[f"w{k}"], known[k], 0, firsts) if firsts else None)
    cuts = _select(df, digits, roots)
    used, tiles = {}, []
    for n, (w, found) in enumerate(zip(windows, cuts)):
        depth = max(map(len, found.values()), default=0)
        used |= {f"__digit_{n}_{i}": digits[n][i] for i in range(depth)}
        later = "".join(f" + IF({_before(lambda i, n=n: f'__digit_{n}_{i}', found[row])}, 0, 1)" for row in sorted(found))
        tiles.append(f"CAST(1{later} AS INT) AS `{w.out}`")
    names = [f"`{c}`" for c in df.columns]
    return df.selectExpr(*names, *[f"{text} AS {name}" for name, text in used.items()]).selectExpr(*names, *tiles)
