"""Sequence codecs as Column expressions: no Python UDFs, all inside whole-stage code generation.

Nulls stay null everywhere. Letters are compared in upper case and U counts as T.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Complement of every nucleotide code, ambiguity codes included (U pairs with A).
COMPLEMENT_FROM = "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn"
COMPLEMENT_TO = "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn"
# Order of the 4-bit ambiguity alphabet; the last code stands for any base.
AMBIGUITY = "ACGTMRWSYKVHDBN"
AMBIGUOUS = "[RYSWKMBDHVNryswkmbdhvn.-]"


def bases(seq: Column) -> Column:
    """Upper case, U as T."""
    return F.translate(F.upper(seq), "U", "T")


def is_kmer(kmer: Column, k: int | Column) -> Column:
    """True for exactly k letters of ACGT; null only for null input."""
    return (F.length(kmer) == k) & kmer.rlike("^[ACGT]*$")


def reverse_complement(seq: Column) -> Column:
    """Reverse complement over the whole ambiguity alphabet, keeping case; other characters stay as they are."""
    return F.reverse(F.translate(seq, COMPLEMENT_FROM, COMPLEMENT_TO))


def canonical(kmer: Column) -> Column:
    """The smaller of the k-mer and its reverse complement, both in bases."""
    b = bases(kmer)
    return F.least(b, reverse_complement(b))


def has_ambiguity(seq: Column) -> Column:
    """Whether the text holds an ambiguity letter or a gap sign."""
    return seq.rlike(AMBIGUOUS)


def last_non_base(seq: Column) -> Column:
    """0-based position of the last character outside ACGT (any case), -1 without one."""
    return F.length(F.regexp_extract(seq, r"(?s)^(.*[^ACGTacgt])", 1)) - 1


PIECE = 256


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda's variable isn't evaluated again for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def kmers(seq: Column, k: int) -> Column:
    """Array of all k-letter windows in order; empty for texts that are shorter than k or null.

    Windows with a non-base are kept: filter the exploded column with :func:`is_kmer`. Long texts are cut
    into overlapping pieces first, since taking a substring costs as many steps as letters lie before it.
    """

    def of_piece(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(p) - k + 1), lambda i: F.substring(p, i, F.lit(k)))

    def of_text(t: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(t) - k + 1, F.lit(PIECE))
        return F.flatten(F.transform(starts, lambda i: let(F.substring(t, i, F.lit(PIECE + k - 1)), of_piece)))

    return F.when(F.length(seq) >= k, let(bases(seq), of_text)).otherwise(F.array().cast("array<string>"))


def n_windows(seq: Column, k: int) -> Column:
    """Number of windows of length k, those with non-bases counted."""
    return F.coalesce(F.greatest(F.length(seq) - (k - 1), F.lit(0)), F.lit(0))


def pack_int(kmer: Column) -> Column:
    """Big-endian base-4 number of a k-mer of at most 31 bases (A 0, C 1, G 2, T 3)."""
    return F.conv(F.translate(bases(kmer), "ACGT", "0123"), 4, 10).cast("bigint")


def unpack_int(value: Column, k: int) -> Column:
    """Inverse of :func:`pack_int`."""
    return F.translate(F.lpad(F.conv(value.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def pack_bytes(kmer: Column, k: int) -> Column:
    """ceil(2k/8) bytes, four bases a byte, first base in the lowest bits."""
    digits = F.translate(bases(kmer), "ACGT", "0123")
    n = (k + 3) // 4
    byte = lambda i: F.lpad(F.conv(F.reverse(F.substring(digits, i * 4 + 1, 4)), 4, 16), 2, "0")
    return F.unhex(F.concat(*[byte(i) for i in range(n)]))


def unpack_bytes(packed: Column, k: int) -> Column:
    """Inverse of :func:`pack_bytes`."""
    h = F.hex(packed)
    four = lambda i: F.reverse(F.lpad(F.conv(F.substring(h, i * 2 + 1, 2), 16, 4), 4, "0"))
    digits = F.concat(*[four(i) for i in range((k + 3) // 4)])
    return F.translate(F.substring(digits, 1, k), "0123", "ACGT")


def pack_ambiguous(seq: Column) -> Column:
    """Four bits a letter as hex text in the order of ``AMBIGUITY``; gap signs count as N."""
    return F.translate(F.translate(bases(seq), ".-", "NN"), AMBIGUITY, "0123456789ABCDE")


def unpack_ambiguous(digits: Column) -> Column:
    """Inverse of :func:`pack_ambiguous`."""
    return F.translate(digits, "0123456789ABCDE", AMBIGUITY)


def swap_nibbles(digits: Column) -> Column:
    """Hex text with the two digits of every byte exchanged, an odd last digit padded with 0."""
    even = F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits)
    return F.regexp_replace(even, "(.)(.)", "$2$1")


def hamming(a: Column, b: Column, most: int | None = None) -> Column:
    """Number of differing positions of two equally long texts, -1 beyond ``most`` or for unequal lengths."""
    n = F.aggregate(
        F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x
    )
    bad = F.length(a) != F.length(b)
    if most is not None:
        bad = bad | (n > most)
    return F.when(bad, F.lit(-1)).otherwise(n)


def bits_needed(n: Column) -> Column:
    """ceil(log2(n)) for n >= 1."""
    return F.ceil(F.log2(n)).cast("int")


def reverse_bits(n: Column, width: int) -> Column:
    """A number of at most ``width`` (62) bits with their order turned round."""
    return F.conv(F.reverse(F.lpad(F.bin(n), width, "0")), 2, 10).cast("bigint")


def popcount(n: Column) -> Column:
    return F.bit_count(n)


def hash64(*cols: Column) -> Column:
    return F.xxhash64(*cols)


def minimizer(seq: Column, m: int) -> Column:
    """Smallest m-letter word over both strands without non-bases and without AAA, CCC, GGG or TTT; null without one."""

    def least(b: Column) -> Column:
        both = F.concat(kmers(b, m), kmers(reverse_complement(b), m))
        return F.array_min(F.filter(both, lambda x: x.rlike("^[ACGT]+$") & ~x.rlike("AAA|CCC|GGG|TTT")))

    return let(bases(seq), least)
