"""32-bit integer hashes as Column expressions, and the same as SQL text for other engines.

Each hash is a list of rounds over a signed 32-bit value x; a round is (left, how, right) with terms ("x"), ("not"),
("shl", n), ("shr", n), ("const", c), ("mul", c). Arithmetic is done in BIGINT and wrapped after every term.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rounds of the public mixing functions (Jenkins' six rounds, Wang's 64-step mix in 32 bits, Wang's 32-bit mix).
ROUNDS = {
    "bj": [
        ((("x",), "+", ("const", 0x7ED55D16)), "+", ("shl", 12)), ((("x",), "^", ("const", 0xC761C23C)), "^", ("shr", 19)),
        ((("x",), "+", ("const", 0x165667B1)), "+", ("shl", 5)), ((("x",), "+", ("const", 0xD3A2646C)), "^", ("shl", 9)),
        ((("x",), "+", ("const", 0xFD7046C5)), "+", ("shl", 3)), ((("x",), "^", ("const", 0xB55A4F09)), "^", ("shr", 16)),
    ],
    "mix64": [
        (("not",), "+", ("shl", 21)), (("x",), "^", ("shr", 24)), ((("x",), "+", ("shl", 3)), "+", ("shl", 8)), (("x",), "^", ("shr", 14)),
        ((("x",), "+", ("shl", 2)), "+", ("shl", 4)), (("x",), "^", ("shr", 28)), (("x",), "+", ("shl", 31)),
    ],
    "tw": [(("not",), "+", ("shl", 15)), (("x",), "^", ("shr", 12)), (("x",), "+", ("shl", 2)), (("x",), "^", ("shr", 4)), ("mul", 2057), (("x",), "^", ("shr", 16))],
}
#: Multipliers of the digit hash.
BKDR_SEEDS = (31, 131, 267, 1313, 13131)
MASK = 1 << 32


def wrap(x: Column) -> Column:
    """Two's complement of 32 bits."""
    return F.pmod(x + F.lit(1 << 31), F.lit(MASK)) - F.lit(1 << 31)


def _signed(c: int) -> int:
    return c - MASK if c >= 1 << 31 else c


class _Columns:
    lit = staticmethod(lambda c: F.lit(c).cast("long"))
    wrap = staticmethod(wrap)
    xor = staticmethod(lambda a, b: a.bitwiseXOR(b))
    add = staticmethod(lambda a, b: wrap(a + b))
    mul = staticmethod(lambda a, c: wrap(a * F.lit(c).cast("long")))
    shr = staticmethod(lambda a, n: F.shiftright(a, n))
    neg = staticmethod(lambda a: -a - F.lit(1).cast("long"))
    mod = staticmethod(lambda a, n: F.pmod(a, n if isinstance(n, Column) else F.lit(n).cast("long")))


class _Text:
    """The same for DuckDB, over a column name; each round is named by a nested select."""

    lit = staticmethod(lambda c: f"({c})::BIGINT")
    wrap = staticmethod(lambda a: f"(((({a}) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)")
    xor = staticmethod(lambda a, b: f"xor({a}, {b})")
    add = staticmethod(lambda a, b: _Text.wrap(f"{a} + {b}"))
    mul = staticmethod(lambda a, c: _Text.wrap(f"{a} * {c}"))
    shr = staticmethod(lambda a, n: f"({a} >> {n})")
    neg = staticmethod(lambda a: f"(-{a} - 1)")
    mod = staticmethod(lambda a, n: f"((({a}) % {n} + {n}) % {n})")


def _term(x, term, e):
    kind = term[0]
    if isinstance(kind, tuple):
        return _joined(x, term, e)
    return {"x": lambda: x, "not": lambda: e.neg(x), "const": lambda: e.lit(_signed(term[1])), "shl": lambda: e.mul(x, 1 << term[1]), "shr": lambda: e.shr(x, term[1])}[kind]()


def _joined(x, step, e):
    if step[0] == "mul":
        return e.mul(x, step[1])
    left, how, right = step
    a, b = _term(x, left, e), _term(x, right, e)
    return e.add(a, b) if how == "+" else e.xor(a, b)


def _rounding(step):
    return lambda x: _joined(x, step, _Columns)


def hashed(name: str, key: Column, size: int | Column) -> Column:
    """The hash of an integer key, in [0, size); the size may be a column. Rounds are chained by transforms, so the expression grows by their number."""
    start = F.array(wrap(key.cast("long")))
    for step in ROUNDS[name]:
        start = F.transform(start, _rounding(step))
    return _Columns.mod(start[0], size)


def hashed_sql(name: str, table: str, key: str, size: int) -> str:
    """A select of (key, hash) from ``table``."""
    sql = f"SELECT {key} AS key, ({key})::BIGINT AS x FROM {table}"
    for step in ROUNDS[name]:
        sql = f"SELECT key, {_joined('x', step, _Text)} AS x FROM ({sql})"
    return f"SELECT key, {_Text.mod('x', size)} AS hash FROM ({sql})"


def digit_hashed(seed: int, key: Column, size: int | Column) -> Column:
    """Decimal digits from the last to the first, as a polynomial in ``seed``; signs of digits follow the key."""
    text = F.reverse(F.abs(key.cast("long")).cast("string"))
    sign = F.when(key < 0, F.lit(-1)).otherwise(F.lit(1)).cast("long")
    digits = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: c.cast("long") * sign)
    code = F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: wrap(a * F.lit(seed).cast("long") + d))
    return _Columns.mod(F.when(key == 0, F.lit(0)).otherwise(code), size)


#: Hashes in a fixed order, at most eight, instead of a random choice.
ORDER = ("bj", "mix64", "tw", *(f"bkdr{s}" for s in BKDR_SEEDS))


def hash_by_name(name: str, key: Column, size: int | Column) -> Column:
    return digit_hashed(int(name[4:]), key, size) if name.startswith("bkdr") else hashed(name, key, size)


def first_hashes(n: int) -> tuple[str, ...]:
    if not 1 <= n <= len(ORDER):
        raise ValueError(f"between 1 and {len(ORDER)} hashes")
    return ORDER[:n]
