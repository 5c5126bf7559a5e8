"""Column functions over DNA strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from isoloom.operators.placement import TAIL_BASES, TAIL_PURITY
from isoloom.operators.seeds import BASE_HASH


def base_code(base: Column) -> Column:
    """A 0, C 1, G 2, T 3; any other letter 0."""
    return F.greatest(F.instr(F.lit("ACGT"), F.upper(base)) - 1, F.lit(0))


def encode(seq: Column) -> Column:
    """Base-4 value of a string of at most 31 bases."""
    digits = F.translate(F.regexp_replace(F.upper(seq), "[^ACGT]", "A"), "ACGT", "0123")
    return F.conv(digits, 4, 10).cast("long")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(F.upper(seq), "ACGT", "TGCA"))


def smer_hash(seq: Column, at: int, s: int) -> Column:
    """Bits of the rotating hash of the s-mer at a 1-based place; all ones where it holds another letter."""
    terms = []
    for i in range(s):
        by = (s - 1 - i) % 64
        value = F.lit(None).cast("long")
        for base, h in zip("ACGT", BASE_HASH.tolist(), strict=True):
            turned = (h << by | h >> (64 - by)) & ((1 << 64) - 1)
            value = F.when(F.substring(seq, at + i, 1) == base, F.lit(turned - (1 << 64) if turned >> 63 else turned)).otherwise(value)
        terms.append(value)
    out = terms[0]
    for t in terms[1:]:
        out = out.bitwiseXOR(t)
    return F.coalesce(out, F.lit(-1).cast("long"))


def as_unsigned(h: Column) -> Column:
    """The unsigned number of a long's bits, as text."""
    wide = h.cast("decimal(20,0)")
    return F.when(h < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)").cast("string")


def count_base(seq: Column, base: str) -> Column:
    return F.length(seq) - F.length(F.replace(F.upper(seq), F.lit(base), F.lit("")))


def is_tail(seq: Column) -> Column:
    most = F.greatest(*(count_base(seq, b) for b in "ACGT"))
    return (F.length(seq) >= TAIL_BASES) & (most >= F.length(seq) * TAIL_PURITY)


def strip_tails(seq: Column) -> Column:
    """Runs of more than TAIL_BASES equal letters at an end cut back to the innermost one, the 3' end first."""
    cut = F.regexp_replace(seq, rf"(?i)(.)\1{{{TAIL_BASES},}}$", "$1")
    return F.regexp_replace(cut, rf"(?i)^(.)\1{{{TAIL_BASES - 1},}}(\1)", "$2")


def primed(longer: Column, end: Column, window: int = 20, share: float = 0.6) -> Column:
    """Is the sequence past `end` rich in A?"""
    part = F.substring(longer, F.greatest(end, F.lit(0)) + 1, F.lit(window))
    return (F.length(part) > 0) & (count_base(part, "A") >= F.lit(share) * F.length(part))


def lead(read: Column, backbone: Column, start: Column) -> Column:
    """How many bases (0 to 3) stand before the read matches 12 bases of the backbone at its start, or null."""
    tests = []
    for n in range(4):
        word = F.substring(read, n + 1, 12)
        fits = [(F.length(word) == 12) & (F.substring(backbone, b + 1, F.lit(12)) == word) for b in (start, F.greatest(start - 1, F.lit(0)), start + 1)]
        tests.append(F.when(fits[0] | fits[1] | fits[2], F.lit(n)))
    return F.coalesce(*tests)
