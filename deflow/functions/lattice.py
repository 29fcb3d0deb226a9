"""Value domains as data, and the three-valued nullability lattice as Spark expressions.

Codes are bytes so that an environment is an ``array<tinyint>``: 0 absent, 1 unknown, 2 non-null,
3 nullable. Joining equal values keeps them; anything else is unknown.

A ``Domain`` is what the fold over tapes needs to know of a property: how two values join, what the
tape's literals, annotations and conditions mean, and which value a dereference is reported for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ABSENT, UNKNOWN, NONNULL, NULLABLE = 0, 1, 2, 3
NAMES = {UNKNOWN: "Unknown", NONNULL: "NonNull", NULLABLE: "Nullable"}


def join_values(a: Column, b: Column) -> Column:
    """Join of two value codes or names."""
    return F.when(a == b, a).otherwise(F.lit(UNKNOWN))


def join_all(value: Column) -> Column:
    """Join over a group: a flat lattice needs only the smallest and largest value seen."""
    return F.when(F.min(value) == F.max(value), F.min(value)).otherwise(F.lit(UNKNOWN))


def value_name(code: Column) -> Column:
    return F.when(code == NULLABLE, "Nullable").when(code == NONNULL, "NonNull").otherwise("Unknown")


def value_code(name: Column) -> Column:
    return F.when(name == "Nullable", NULLABLE).when(name == "NonNull", NONNULL).otherwise(UNKNOWN)


@dataclass(frozen=True)
class Domain:
    """A property of values. Tables are indexed by code, 0 to ``len(join) - 1``; 0 is absent."""

    name: str
    join: tuple[tuple[int, ...], ...]
    transfer: tuple[int, ...] = (ABSENT, UNKNOWN, NONNULL, NULLABLE)    # what the tape's codes are here
    reported: int = NULLABLE    # also what an argument brings into its parameter's context

    def join_sql(self, a: str, b: str) -> str:
        """Join of two codes, named so that they may be repeated; equal values are themselves."""
        n = len(self.join)
        differing = {self.join[i][j] for i in range(n) for j in range(n) if i != j}
        other = f"{differing.pop()}Y" if len(differing) == 1 else (
            f"array({', '.join(f'{x}Y' for row in self.join for x in row)})[cast({a} AS int) * {n} + {b}]")
        return f"if({a} = {b}, {a}, {other})"

    def code_sql(self, tape_code: str) -> str:
        """A code of the tape in this domain."""
        if self.transfer == tuple(range(len(self.transfer))):
            return tape_code
        return f"array({', '.join(f'{x}Y' for x in self.transfer)})[{tape_code}]"


# Disagreement is unknown: what is reported is None on every path that is known.
NULLNESS = Domain("definite", tuple(tuple(i if i == j else UNKNOWN for j in range(4)) for i in range(4)))
# None on some path is enough: an order, absent and unknown below it, instead of a flat lattice.
MAYBE_NONE = Domain("possible", tuple(tuple(i if i == j else NULLABLE if NULLABLE in (i, j) else UNKNOWN for j in range(4)) for i in range(4)))
DOMAINS = (NULLNESS, MAYBE_NONE)
