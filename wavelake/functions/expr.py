"""Derived-signal expressions: a small tree that compiles to one Spark column.

Inputs are forward-filled change columns of non-negative longs; the result is masked to its width. All operations stay
inside whole-stage code generation. Values in between may have any size: how many bits each can need is followed while
compiling. Where 63 are enough, a value is one long; else it is a list of 32-bit lanes, lowest first, and a sign.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Expr:
    """op with its operands: expressions or, for constants, inputs and widths, integers."""

    op: str
    args: tuple = ()

    def __and__(self, other): return Expr("and", (self, wrap(other)))  # noqa: E704
    def __or__(self, other): return Expr("or", (self, wrap(other)))  # noqa: E704
    def __xor__(self, other): return Expr("xor", (self, wrap(other)))  # noqa: E704
    def __invert__(self): return Expr("not", (self,))  # noqa: E704
    def lnot(self): return Expr("lnot", (self,))  # noqa: E704
    def eq(self, other): return Expr("eq", (self, wrap(other)))  # noqa: E704
    def ne(self, other): return Expr("ne", (self, wrap(other)))  # noqa: E704
    def shl(self, k: int): return Expr("shl", (self, k))  # noqa: E704
    def shr(self, k: int): return Expr("shr", (self, k))  # noqa: E704
    def reduce_and(self, width: int): return Expr("reduce_and", (self, width))  # noqa: E704
    def reduce_or(self, width: int): return Expr("reduce_or", (self, width))  # noqa: E704
    def slice_(self, low: int, width: int): return Expr("slice", (self, low, width))  # noqa: E704
    def concat(self, other, width: int): return Expr("concat", (self, wrap(other), width))  # noqa: E704


def Input(slot: int) -> Expr:  # noqa: N802
    return Expr("input", (slot,))


def Const(value: int) -> Expr:  # noqa: N802
    if value < 0:
        raise ValueError("constants aren't negative")
    return Expr("const", (value,))


def wrap(x) -> Expr:
    return x if isinstance(x, Expr) else Const(x)


def mask(width: int) -> Column:
    """The low bits of a width, as a long; width 0 and 64 keep all bits."""
    return F.lit(-1 if width in (0, 64) else (1 << width) - 1).cast("long")


def _shl(x: Column, k: int) -> Column:
    return F.shiftleft(x, k) if k < 64 else F.lit(0).cast("long")


def _shr(x: Column, k: int) -> Column:
    return F.shiftright(x, min(k, 63))


def _low(width: int) -> Column:
    return F.lit((1 << width) - 1 if width < 64 else -1).cast("long")


def bits(e: Expr, widths: list[int]) -> int:
    """The most bits that an expression, or one within it, can need, its sign aside."""
    a = e.args
    below = [bits(x, widths) for x in a if isinstance(x, Expr)]
    own = {"input": lambda: widths[a[0]], "const": lambda: a[0].bit_length(), "shl": lambda: below[0] + a[1], "concat": lambda: max(below[0] + a[2], a[2])}
    return max([*below, own[e.op]() if e.op in own else 0])


LANE = 0xFFFFFFFF


def _lanes(e: Expr, inputs: list[Column]) -> tuple[list[Column], Column]:
    """(lanes, sign) of an expression: each lane a long from 0 to LANE, the sign the lane that goes on above them."""
    long = lambda v: F.lit(v).cast("long")
    a = e.args
    flag = lambda c: ([c.cast("long")], long(0))

    def at(x, i: int) -> Column:
        return x[0][i] if 0 <= i < len(x[0]) else x[1] if i >= 0 else long(0)

    def low(x, w: int) -> list[Column]:
        out = [at(x, i) for i in range(-(-w // 32))]
        if w % 32:
            out[-1] = out[-1].bitwiseAND(long((1 << w % 32) - 1))
        return out

    def up(x, k: int):
        q, r = divmod(k, 32)
        if not r:
            return [long(0)] * q + x[0], x[1]
        return [F.shiftleft(at(x, i - q), r).bitwiseAND(long(LANE)).bitwiseOR(F.shiftright(at(x, i - q - 1), 32 - r)) for i in range(len(x[0]) + q + 1)], x[1]

    def down(x, k: int):
        q, r = divmod(k, 32)
        n = max(1, len(x[0]) - q)
        if not r:
            return [at(x, i + q) for i in range(n)], x[1]
        return [F.shiftright(at(x, i + q), r).bitwiseOR(F.shiftleft(at(x, i + q + 1), 32 - r).bitwiseAND(long(LANE))) for i in range(n)], x[1]

    def each(x, y, f):
        return [f(at(x, i), at(y, i)) for i in range(max(len(x[0]), len(y[0])))], f(x[1], y[1])

    def same(x, y) -> Column:
        out = x[1] == y[1]
        for i in range(max(len(x[0]), len(y[0]))):
            out = out & (at(x, i) == at(y, i))
        return out

    if e.op == "input":
        c = inputs[a[0]].cast("long")
        return [c.bitwiseAND(long(LANE)), F.shiftrightunsigned(c, 32).bitwiseAND(long(LANE))], long(0)
    if e.op == "const":
        return [long(a[0] >> i & LANE) for i in range(0, max(1, a[0].bit_length()), 32)], long(0)
    x, *rest = [_lanes(v, inputs) for v in a if isinstance(v, Expr)]
    zero = ([long(0)], long(0))
    match e.op:
        case "not":
            return [v.bitwiseXOR(long(LANE)) for v in x[0]], x[1].bitwiseXOR(long(LANE))
        case "and":
            return each(x, rest[0], lambda p, q: p.bitwiseAND(q))
        case "or":
            return each(x, rest[0], lambda p, q: p.bitwiseOR(q))
        case "xor":
            return each(x, rest[0], lambda p, q: p.bitwiseXOR(q))
        case "lnot":
            return flag(same(x, zero))
        case "eq":
            return flag(same(x, rest[0]))
        case "ne":
            return flag(~same(x, rest[0]))
        case "shl":
            return up(x, a[1])
        case "shr":
            return down(x, a[1])
        case "reduce_and":
            ones = (1 << a[1]) - 1
            return flag(same((low(x, a[1]) or [long(0)], long(0)), _lanes(Const(ones), inputs)))
        case "reduce_or":
            return flag(~same((low(x, a[1]) or [long(0)], long(0)), zero))
        case "slice":
            return low(down(x, a[1]), a[2]) or [long(0)], long(0)
        case "concat":
            return each(up(x, a[2]), (low(rest[0], a[2]) or [long(0)], long(0)), lambda p, q: p.bitwiseOR(q))
    raise ValueError(f"no operation {e.op}")


def compile_expr(e: Expr, inputs: list[Column], width: int = 0, widths: list[int] | None = None) -> Column:
    """The column of an expression over input columns, masked to `width` bits.

    `widths` are the inputs' bits, 63 if they aren't known. The result is a long up to 64 bits (of which the 64th is
    its sign, so 2^63 and more show as negative), and big-endian bytes beyond.
    """
    if width <= 64 and bits(e, widths or [63] * len(inputs)) <= 63:
        return _plain(e, inputs).bitwiseAND(mask(width))
    lanes, sign = _lanes(e, inputs)
    if width <= 64:
        high = lanes[1] if len(lanes) > 1 else sign
        return F.shiftleft(high, 32).bitwiseOR(lanes[0]).bitwiseAND(mask(width))
    n = -(-width // 32)
    own = (lanes + [sign] * n)[:n]
    if width % 32:
        own[-1] = own[-1].bitwiseAND(F.lit((1 << width % 32) - 1).cast("long"))
    text = F.concat(*[F.lpad(F.hex(v), 8, "0") for v in reversed(own)])
    return F.unhex(F.right(text, F.lit(2 * ((width + 7) // 8))))


def _plain(e: Expr, inputs: list[Column]) -> Column:
    """The unmasked column where 63 bits and a sign hold every value."""
    flag = lambda c: c.cast("long")
    a = e.args
    x, *rest = [_plain(v, inputs) for v in a if isinstance(v, Expr)] or [None]
    match e.op:
        case "input":
            return inputs[a[0]]
        case "const":
            return F.lit(a[0]).cast("long")
        case "not":
            return F.bitwise_not(x)
        case "and":
            return x.bitwiseAND(rest[0])
        case "or":
            return x.bitwiseOR(rest[0])
        case "xor":
            return x.bitwiseXOR(rest[0])
        case "lnot":
            return flag(x == 0)
        case "eq":
            return flag(x == rest[0])
        case "ne":
            return flag(x != rest[0])
        case "shl":
            return _shl(x, a[1])
        case "shr":
            return _shr(x, a[1])
        case "reduce_and":
            return flag(x.bitwiseAND(_low(a[1])) == _low(a[1])) if a[1] < 64 else flag(x == -1)
        case "reduce_or":
            return flag(x.bitwiseAND(_low(a[1])) != 0)
        case "slice":
            return _shr(x, a[1]).bitwiseAND(_low(a[2]))
        case "concat":
            return _shl(x, a[2]).bitwiseOR(rest[0].bitwiseAND(_low(a[2])))
    raise ValueError(f"no operation {e.op}")
