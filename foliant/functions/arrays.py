"""Sums along arrays, and places in sorted ones."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longer arrays are summed in blocks.
SHORT = 256
#: Longer arrays are searched by blocks.
FEW = 32


def _folded(numbers: Column) -> Column:
    """The sum, and the sums before each item, in one pass that copies what it has."""
    none = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<bigint>").alias("before"))
    return F.aggregate(numbers, none, lambda a, x: F.struct((a["total"] + x).alias("total"), F.concat(a["before"], F.array(a["total"])).alias("before")))


def sums_before(numbers: Column) -> Column:
    """The sum of the items before each item of an array column.

    Long arrays go by blocks of the root of their length, so the work grows
    with the power of 1.5 of the length. What a lambda uses is bound to its
    argument, since anything else in it is worked out anew for every item.
    """
    n = F.size(numbers)
    width = F.ceil(F.sqrt(n)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda b: _folded(F.slice(numbers, b * width + 1, width)))

    def joined(parts: Column) -> Column:
        starts = _folded(F.transform(parts, lambda p: p["total"]))["before"]
        return F.flatten(F.zip_with(parts, starts, lambda p, s: F.transform(p["before"], lambda x: x + s)))

    in_blocks = F.element_at(F.transform(F.array(blocks), joined), 1)
    return F.when(n <= SHORT, _folded(numbers)["before"]).otherwise(in_blocks)


def offsets(parts: Column) -> Column:
    """Where each text of an array of texts begins if they are joined."""
    return sums_before(F.transform(parts, lambda t: F.length(t).cast("long")))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def places(numbers: Column, sought: Column, inclusive: bool) -> Column:
    """For each number sought: how many of the ascending numbers are smaller, or with ``inclusive`` not larger.

    An array of more than ``FEW`` goes by blocks of the root of its length: the
    first numbers of the blocks tell the block, and only that is gone through.
    """

    def count(some: Column, x: Column) -> Column:
        return F.size(F.filter(some, lambda y: y <= x if inclusive else y < x))

    def in_blocks(held: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(held))).cast("int")

        def by(t: Column) -> Column:
            def place(x: Column) -> Column:
                return bound(count(t["heads"], x), lambda k: F.when(k == 0, F.lit(0)).otherwise((k - 1) * t["width"] + count(F.slice(held, (k - 1) * t["width"] + 1, t["width"]), x)))

            return F.transform(sought, place)

        heads = F.transform(F.sequence(F.lit(0), F.floor((F.size(held) - 1) / width).cast("int")), lambda b: F.get(held, b * width))
        return bound(F.struct(heads.alias("heads"), width.alias("width")), by)

    return bound(numbers, lambda held: F.when(F.size(held) <= FEW, F.transform(sought, lambda x: count(held, x))).otherwise(in_blocks(held)))
