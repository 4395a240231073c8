"""Motifs: reverse complements, patterns and their expressions. Patterns are made on the driver, matching is Catalyst's."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPLEMENT = str.maketrans("ACGTN", "TGCAN")


class MotifError(ValueError):
    pass


def reverse_complement(motif: str) -> str:
    if set(motif) - set("ACGTN"):
        raise MotifError(f"no complement for {motif!r}: letters other than ACGTN")
    return motif.translate(COMPLEMENT)[::-1]


def reverse_complement_column(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTN", "TGCAN"))


def with_complements(motifs: list[str]) -> list[str]:
    return sorted({*motifs, *map(reverse_complement, motifs)})


def exact_pattern(motif: str) -> str:
    return f"({re.escape(motif)})"


def fuzzy_pattern(motif: str) -> str:
    """Runs of two or more may be one letter shorter or longer."""
    runs = [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", motif)]
    return "(" + "".join(re.escape(c) if n == 1 else f"{re.escape(c)}{{{n - 1},{n + 1}}}" for c, n in runs) + ")"


def patterns(motifs: list[str], fuzzy: bool = False, complements: bool = True) -> dict[str, str]:
    """name -> pattern, sorted by motif; fuzzy names carry the suffix _fuzzy."""
    chosen = with_complements(motifs) if complements else sorted(set(motifs))
    make = fuzzy_pattern if fuzzy else exact_pattern
    return {m + ("_fuzzy" if fuzzy else ""): make(m) for m in chosen}


def parse_motifs(text: str) -> tuple[list[str], list[str]]:
    """(motifs, skipped) of a comma list: trimmed, upper case, letters ACGT only."""
    parts = [p.strip().upper() for p in text.split(",") if p.strip()]
    good = [p for p in parts if not set(p) - set("ACGT")]
    return list(dict.fromkeys(good)), [p for p in parts if p not in good]


def parse_filter_motifs(text: str, no_reverse: bool = False) -> list[str]:
    """The filter's own rule: split at commas and nothing else."""
    parts = [p for p in text.split(",") if p]
    return sorted(set(parts)) if no_reverse else with_complements(parts)


def present(seq: Column, found: dict[str, str], repeats: int = 1) -> Column:
    """Any pattern, `repeats` times in a row. The bounded form {n} decides existence as {n,} does, and cannot overflow the
    regex engine's stack on long tandem arrays."""
    tests = [seq.rlike(p if repeats <= 1 else f"(?:{p}){{{repeats}}}") for p in found.values()]
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def count(seq: Column, pattern: str) -> Column:
    """Non-overlapping matches."""
    return F.regexp_count(seq, F.lit(pattern)).cast("long")


def counts(seq: Column, found: dict[str, str]) -> Column:
    """ARRAY<STRUCT<motif, n>>, a pattern each."""
    return F.array(*[F.struct(F.lit(name).alias("motif"), count(seq, p).alias("n")) for name, p in found.items()])


def has_homopolymer(seq: Column, threshold: int) -> Column:
    """A run of `threshold` equal letters or more, any letter, case ignored."""
    return F.upper(seq).rlike(rf"(.)\1{{{max(threshold - 1, 0)}}}")


def homopolymer_runs(seq: Column, threshold: int) -> Column:
    """The runs of `threshold` letters or more, in order."""
    return F.regexp_extract_all(F.upper(seq), F.lit(rf"((.)\2{{{max(threshold - 1, 0)},}})"), F.lit(1))
