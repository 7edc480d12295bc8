"""Spellings of contigs and kinds, junction keys and breakpoint sides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of kinds.
KINDS = {
    "DELETION": "DEL", "INSERTION": "INS", "DUPLICATION": "DUP", "INVERSION": "INV",
    "TRA": "BND", "CTX": "BND", "ITX": "BND", "TRANSLOCATION": "BND", "BREAKEND": "BND",
}


def contig(name: Column) -> Column:
    """One spelling of a contig: chromosome and scaffold numbers without prefix, separator and leading zeros, anything else in lower case; blank is null."""
    t = F.lower(F.regexp_replace(name, r"\A\s+|\s+\z", ""))
    scaffold = F.regexp_extract(t, r"\A(?:scaffold|scaff|scf)[ _.-]*0*([0-9]+)\z", 1)
    chromosome = F.regexp_extract(t, r"\A(?:chromosome|chrom|chr)?[ _.-]*0*([0-9]+)\z", 1)
    rest = F.regexp_replace(t, r"\A(?:chromosome|chrom|chr)[ _.-]*", "")
    return F.when(scaffold != "", F.concat(F.lit("s"), scaffold)).when(chromosome != "", chromosome).when(t != "", rest)


def kind(name: Column) -> Column:
    """One name of a kind, without brackets and subtype; blank is null."""
    t = F.split(F.upper(F.regexp_replace(name, r"[<>\s]", "")), ":")[0]
    names = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.coalesce(names[t], F.when(t != "", t))


def end_of(side: str, strand: Column, start: Column, end: Column) -> Column:
    """The breakpoint at a segment's right or left end in reading direction: a struct of position and direction."""
    at_end = (strand == 1) if side == "right" else (strand != 1)
    return F.struct(F.when(at_end, end).otherwise(start).alias("pos"), F.when(at_end, 1).otherwise(-1).alias("dir"))


def sign(direction: Column) -> Column:
    return F.when(direction > 0, "+").otherwise("-")


def junction_key(chr_a: Column, pos_a: Column, dir_a: Column, chr_b: Column, pos_b: Column, dir_b: Column) -> Column:
    """The two signed ends, ordered by their text without the sign."""
    a, b = F.concat(chr_a, F.lit(":"), pos_a), F.concat(chr_b, F.lit(":"), pos_b)
    x, y = F.concat(sign(dir_a), a), F.concat(sign(dir_b), b)
    return F.when(a <= b, F.concat(x, F.lit("|"), y)).otherwise(F.concat(y, F.lit("|"), x))


def kmers(sequence: Column, k: int = 6) -> Column:
    """Distinct k-mers at every step but the last possible one; a sequence of k letters or fewer has none."""
    n = F.length(sequence) - k
    some = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(sequence, i, F.lit(k)))
    return F.array_distinct(F.when(n >= 1, some).otherwise(F.array().cast("array<string>")))


def ends_of_key(key: Column) -> Column:
    """A struct of both ends read back from a junction key; an insertion has its length as size and no second end."""
    first, second = F.split(key, r"\|")[0], F.get(F.split(key, r"\|"), F.lit(1))
    pattern = r"\A([+-]?)(.*):([0-9]+)\z"
    is_ins = second.startswith("INS:")

    def part(text: Column, group: int) -> Column:
        return F.regexp_extract(text, pattern, group)

    def direction(text: Column) -> Column:
        return F.when(part(text, 1) == "+", 1).when(part(text, 1) == "-", -1)

    number = lambda text: part(text, 3).try_cast("long")
    return F.struct(
        part(first, 2).alias("chr_a"), number(first).alias("pos_a"), direction(first).alias("dir_a"),
        F.when(~is_ins, part(second, 2)).alias("chr_b"), F.when(~is_ins, number(second)).alias("pos_b"), F.when(~is_ins, direction(second)).alias("dir_b"),
        F.when(is_ins, number(second)).alias("size"),
    )
