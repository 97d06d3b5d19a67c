"""Column expressions over scripts in hexadecimal: their opcodes, and the exits to other layers that these spell."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from utxolens.functions.ledger import let

# Opcodes in hexadecimal.
HASHES, TIMES, BRANCHES = ("a8", "a9"), ("b1", "b2"), ("63", "67", "68")
CHANNEL = "52 21 21 52 ae"  # two keys of 33 bytes, both must sign
LOCKS = ((HASHES, TIMES, BRANCHES), (("a9",), ("b1",)), (("63",), ("67",), ("b1",)))  # one of each group makes a swap
SERVICE = ("87 63", "b1 75")  # neighbours that mark a swap service's form


def opcodes(script: Column) -> Column:
    """The opcodes of a script as an array of int; pushed data is passed over, after its length in 0, 1, 2 or 4 bytes, least byte first."""
    n = F.floor(F.length(script) / 2).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    values = F.transform(places, lambda i: F.conv(F.substr(script, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    state = lambda skip, digits, place, ops: F.struct(skip.alias("skip"), digits.alias("digits"), place.alias("place"), ops.alias("ops"))
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def step(s: Column, b: Column) -> Column:
        sized = state(s["skip"] + b * s["place"], s["digits"] - 1, s["place"] * 256, s["ops"])
        passed = state(s["skip"] - 1, F.lit(0), one, s["ops"])
        op = state(F.when(b.between(1, 75), b).otherwise(none), F.when(b == 76, 1).when(b == 77, 2).when(b == 78, 4).otherwise(0), one, F.concat(s["ops"], F.array(b.cast("int"))))
        return F.when(s["digits"] > 0, sized).when(s["skip"] > 0, passed).otherwise(op)

    return F.aggregate(values, state(none, F.lit(0), one, F.array().cast("array<int>")), step, lambda s: s["ops"])


def spelled(script: Column) -> Column:
    """The opcodes of a script as pairs of digits with spaces between."""
    return F.array_join(F.transform(opcodes(script), lambda o: F.lpad(F.lower(F.hex(o)), 2, "0")), " ")


def layer_two(script: Column) -> Column:
    """Exit to another layer that a script's opcodes spell: channel funding, hash-locked swap, a swap service's form of it; else none."""

    def told(ops: Column) -> Column:
        any_of = lambda codes: reduce(or_, [ops.contains(c) for c in codes])
        swap = reduce(or_, [reduce(and_, [any_of(group) for group in lock]) for lock in LOCKS])
        service = reduce(and_, [ops.contains(pair) for pair in SERVICE])
        return F.when(ops.endswith(CHANNEL), "channel funding").when(swap & service, "swap service").when(swap, "hash-locked swap").otherwise("none")

    return let(spelled(script), told)
