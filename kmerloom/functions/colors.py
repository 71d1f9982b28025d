"""Color-set algebra on ARRAY<INT> columns. Results are ascending and without repeats; null counts as the empty set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import codec

_EMPTY = "array<int>"


def _set(c: Column) -> Column:
    return F.array_distinct(F.array_compact(F.coalesce(c, F.array().cast(_EMPTY))))


def color_list(colors: Column) -> Column:
    """Ascending ids without repeats."""
    return F.array_sort(_set(colors))


def intersection(*sets: Column) -> Column:
    """Ids in all sets; of one set the set itself, of none the empty set."""
    return color_list(reduce(F.array_intersect, map(_set, sets))) if sets else F.array().cast(_EMPTY)


def union(*sets: Column) -> Column:
    """Ids in any set."""
    return color_list(reduce(F.array_union, map(_set, sets))) if sets else F.array().cast(_EMPTY)


def symmetric_difference(*sets: Column) -> Column:
    """One set: itself. More: the union without the intersection of all of them (for two sets the exclusive or)."""
    if len(sets) < 2:
        return union(*sets)
    return color_list(F.array_except(union(*sets), intersection(*sets)))


def count_colors(colors: Column) -> Column:
    return F.size(_set(colors))


def last_color(colors: Column) -> Column:
    """The highest id, null for an empty set."""
    return F.array_max(colors)


def has_color(colors: Column, genome_id: Column | int, n_genomes: int | None = None) -> Column:
    """Whether the id is in the set; false for ids that aren't registered."""
    inside = F.coalesce(F.array_contains(colors, genome_id), F.lit(False))
    return inside if n_genomes is None else inside & (F.lit(genome_id) < n_genomes)


def covers(colors: Column, ids: list[int]) -> Column:
    """Whether the set holds all ids (in any order); false for no ids."""
    if not ids:
        return F.lit(False)
    return F.size(F.array_except(F.array(*map(F.lit, ids)), _set(colors))) == 0


def intersection_count(a: Column, b: Column, most: int | None = None) -> Column:
    """Size of the intersection, counted no further than most + 1."""
    n = F.size(F.array_intersect(_set(a), _set(b)))
    return n if most is None else F.least(n, F.lit(most + 1))


def decode(annot: Column) -> Column:
    """Color set of an encoded annotation: bitmap (flag 0), runs (1) or id list (2); null for other input.

    Numbers take 6-bit groups, high first; further bytes of a number carry flag 2 (runs) or 1 (list).
    """
    n = F.octet_length(annot)

    def bytes_of(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))

    def pairs(numbers: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size(numbers) / 2, F.lit(1)).cast("int") - 1),
            lambda i: F.sequence(F.get(numbers, i * 2), F.get(numbers, i * 2 + 1))))

    def of_bytes(byte: Column) -> Column:
        flag = F.element_at(byte, 1).bitwiseAND(F.lit(3))
        bits = F.filter(F.sequence(F.lit(0), n * 8 - 3), lambda i: _bit(byte, i + 2))
        numbers = _numbers(byte, flag)
        return F.when(flag == 0, bits).when(flag == 1, codec.let(numbers, pairs)).when(flag == 2, numbers)

    return F.when(n > 0, codec.let(F.hex(annot), lambda h: codec.let(bytes_of(h), of_bytes)))


def _number(n: Column, first: int, further: int) -> Column:
    """Hex text of a number below 2^30 in 6-bit groups, high first."""
    group = lambda j: F.pmod(F.floor(n / F.lit(64**j)), F.lit(64)).cast("int")
    two = lambda v: F.lpad(F.hex(v), 2, "0")
    parts = [F.when(n >= 64**j, two(group(j) * 4 + F.when(n < 64 ** (j + 1), first).otherwise(further))).otherwise("") for j in range(4, 0, -1)]
    return F.concat(*parts, two(group(0) * 4 + F.when(n < 64, first).otherwise(further)))


def encodings(colors: Column) -> list[Column]:
    """Hex texts of the three encodings of a non-empty set of ids below 2^30: bitmap, runs, id list; each in one pass over the ids."""
    two = lambda v: F.lpad(F.hex(v), 2, "0")
    state = lambda text, at, now: F.struct(text.alias("text"), at.cast("int").alias("at"), now.cast("int").alias("now"))

    def bit(s: Column, i: Column) -> Column:  # at: the byte that is being filled, now: its bits so far
        where = F.floor((i + 2) / 8).cast("int")
        value = F.pow(F.lit(2), F.pmod(i + 2, F.lit(8))).cast("int")
        filled = F.concat(s["text"], two(s["now"]), F.repeat(F.lit("00"), where - s["at"] - 1))
        return F.when(where == s["at"], state(s["text"], s["at"], s["now"] + value)).otherwise(state(filled, where, value))

    def run(s: Column, i: Column) -> Column:  # at, now: the run that is going on
        ended = F.concat(s["text"], _number(s["at"], 1, 2), _number(s["now"], 1, 2))
        return F.when(s["at"] < 0, state(F.lit(""), i, i)).when(i == s["now"] + 1, state(s["text"], s["at"], i)).otherwise(state(ended, i, i))

    bitmap = F.aggregate(colors, state(F.lit(""), F.lit(0), F.lit(0)), bit, lambda s: F.concat(s["text"], two(s["now"])))
    runs = F.aggregate(colors, state(F.lit(""), F.lit(-1), F.lit(-1)), run, lambda s: F.concat(s["text"], _number(s["at"], 1, 2), _number(s["now"], 1, 2)))
    return [bitmap, runs, F.array_join(F.transform(colors, lambda i: _number(i, 2, 1)), "")]


def encode(colors: Column) -> Column:
    """The shortest encoding of a set of ids (of equally short ones the bitmap, then the id list); null for an empty or null set."""

    def shortest(ids: Column) -> Column:
        bitmap, runs, listed = encodings(ids)
        best = lambda t: F.when(F.length(t["b"]) <= F.least(F.length(t["r"]), F.length(t["l"])), t["b"]).when(F.length(t["l"]) <= F.length(t["r"]), t["l"]).otherwise(t["r"])
        return codec.let(F.struct(bitmap.alias("b"), runs.alias("r"), listed.alias("l")), best)

    return F.unhex(codec.let(color_list(colors), lambda ids: F.when(F.size(ids) > 0, shortest(ids))))


def _bit(byte: Column, i: Column) -> Column:
    digit = F.get(byte, F.floor(i / 8).cast("int"))
    return F.pmod(F.floor(digit / F.pow(F.lit(2), F.pmod(i, F.lit(8)))), F.lit(2)) == 1


def _numbers(byte: Column, flag: Column) -> Column:
    start = F.struct(F.array().cast(_EMPTY).alias("done"), F.lit(-1).alias("now"))

    def step(s: Column, b: Column) -> Column:
        value = F.shiftright(b, 2)
        first = b.bitwiseAND(F.lit(3)) == flag
        done = F.when(first & (s["now"] >= 0), F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"])
        return F.struct(done.alias("done"), F.when(first, value).otherwise(s["now"] * 64 + value).alias("now"))

    return F.aggregate(byte, start, step, lambda s: F.when(s["now"] >= 0, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))
