"""Derived-signal expressions as bytes in post-order, and their plain evaluation with numbers of any size."""

from __future__ import annotations

from wavelake.functions.expr import Const, Expr, Input
from wavelake.sources.wire import Cursor, uvarint

#: Operations by code with their operands and their numbers (fixed values of the format).
OPS = {"input": (1, 0, 1), "const": (2, 0, 1), "not": (3, 1, 0), "and": (4, 2, 0), "or": (5, 2, 0), "xor": (6, 2, 0), "lnot": (7, 1, 0), "eq": (8, 2, 0), "ne": (9, 2, 0), "shl": (10, 1, 1), "shr": (11, 1, 1), "reduce_and": (12, 1, 1), "reduce_or": (13, 1, 1), "slice": (14, 1, 2), "concat": (15, 2, 1)}
NAMES = {code: (name, operands, numbers) for name, (code, operands, numbers) in OPS.items()}


def compile_bytes(e: Expr) -> bytes:
    code, operands, _ = OPS[e.op]
    return b"".join(compile_bytes(x) for x in e.args[:operands]) + bytes([code]) + b"".join(uvarint(x) for x in e.args[operands:])


def parse(code: bytes) -> Expr:
    """The expression of bytes; an unknown operation, or another number of results than one, is a ValueError."""
    c, stack = Cursor(code), []
    while c.more():
        op = c.u8()
        if op not in NAMES:
            raise ValueError(f"no operation {op}")
        name, operands, numbers = NAMES[op]
        own = [c.uvarint() for _ in range(numbers)]
        if len(stack) < operands:
            raise ValueError("an operand is missing")
        args = stack[len(stack) - operands :]
        del stack[len(stack) - operands :]
        stack.append(Input(own[0]) if name == "input" else Const(own[0]) if name == "const" else Expr(name, (*args, *own)))
    if len(stack) != 1:
        raise ValueError(f"{len(stack)} results")
    return stack[0]


def value(e: Expr, inputs: list[int]) -> int:
    """The unmasked value, as Python's numbers have it."""
    a = e.args
    low = lambda w: (1 << w) - 1
    x = value(a[0], inputs) if isinstance(a[0], Expr) else a[0]
    y = value(a[1], inputs) if len(a) > 1 and isinstance(a[1], Expr) else a[1] if len(a) > 1 else 0
    match e.op:
        case "input":
            return inputs[x]
        case "const":
            return x
        case "not":
            return ~x
        case "and":
            return x & y
        case "or":
            return x | y
        case "xor":
            return x ^ y
        case "lnot":
            return int(x == 0)
        case "eq":
            return int(x == y)
        case "ne":
            return int(x != y)
        case "shl":
            return x << y
        case "shr":
            return x >> y
        case "reduce_and":
            return int(x & low(y) == low(y))
        case "reduce_or":
            return int(x & low(y) != 0)
        case "slice":
            return x >> y & low(a[2])
        case "concat":
            return x << a[2] | y & low(a[2])
    raise ValueError(f"no operation {e.op}")


def evaluate(code: bytes | Expr, inputs: list[list[tuple[int, int]]], width: int) -> list[tuple[int, int]]:
    """Changes of a derived signal from its inputs' changes, for one signal in memory: the rule that `operators.signals.derived` runs on tables."""
    e = parse(code) if isinstance(code, bytes) else code
    mask = (1 << (width or 64)) - 1
    at = [dict(own) for own in inputs]  # of several changes at one time the last counts
    now, out = [0] * len(inputs), []
    for t in sorted({t for own in at for t in own}):
        now = [own.get(t, v) for own, v in zip(at, now, strict=True)]
        v = value(e, now) & mask
        if not out or out[-1][1] != v:
            out.append((t, v))
    return out
