"""Alignments cut into read segments along their CIGAR."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Operation codes of the alignment format.
MATCH, INSERTION, DELETION, CLIPS = (0, 7, 8), 1, 2, (4, 5)

_PIECE = "struct<kind:string,ref_start:bigint,ref_end:bigint,read_start:bigint,read_end:bigint,length:bigint>"
_STATE = f"struct<read:bigint,ref:bigint,from_read:bigint,from_ref:bigint,pieces:array<{_PIECE}>>"


def parse(text: Column) -> Column:
    """An array of (op, len) of a CIGAR text; a null or '*' gives an empty array."""
    steps = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([0-9]+[MIDNSHP=X])"), F.lit(1))
    code = lambda s: F.instr(F.lit("MIDNSHP=X"), F.right(s, F.lit(1))) - 1
    return F.transform(steps, lambda s: F.struct(code(s).alias("op"), F.substr(s, F.lit(1), F.length(s) - 1).cast("long").alias("len")))


def pieces(cigar: Column, reference_start: Column, min_size: int) -> Column:
    """Split pieces between deletions longer than min_size, and insertions of at least min_size with their place, in one pass over the steps.

    Only such cuts are kept while folding, so the work grows with the steps. A shorter deletion, one of just min_size too, is absorbed and moves the reference on.
    Read positions are those along the alignment.
    """

    def close(s: Column) -> Column:
        piece = F.struct(F.lit("split").alias("kind"), s["from_ref"].alias("ref_start"), s["ref"].alias("ref_end"), s["from_read"].alias("read_start"), s["read"].alias("read_end"), (s["read"] - s["from_read"]).alias("length"))
        return F.when(s["ref"] > s["from_ref"], F.concat(s["pieces"], F.array(piece))).otherwise(s["pieces"])

    def state(read, ref, from_read, from_ref, found) -> Column:
        return F.struct(read.alias("read"), ref.alias("ref"), from_read.alias("from_read"), from_ref.alias("from_ref"), found.alias("pieces")).cast(_STATE)

    def step(s: Column, c: Column) -> Column:
        op, n = c["op"], c["len"]
        large_deletion = op.isin(DELETION, 3) & (n > min_size)
        large_insertion = (op == INSERTION) & (n >= min_size)
        on_read, on_ref = op.isin(*MATCH, INSERTION, *CLIPS), op.isin(*MATCH, DELETION, 3)
        read = s["read"] + F.when(on_read, n).otherwise(0)
        ref = s["ref"] + F.when(on_ref, n).otherwise(0)
        leading_clip = op.isin(*CLIPS) & (s["ref"] == s["from_ref"]) & (s["read"] == s["from_read"])
        trailing_clip = op.isin(*CLIPS) & ~leading_clip
        added = F.struct(F.lit("insertion").alias("kind"), s["ref"].alias("ref_start"), s["ref"].alias("ref_end"), s["read"].alias("read_start"), read.alias("read_end"), n.alias("length"))
        found = F.when(large_deletion, close(s)).when(large_insertion, F.concat(s["pieces"], F.array(added))).otherwise(s["pieces"])
        return state(
            F.when(trailing_clip, s["read"]).otherwise(read), ref, F.when(large_deletion | leading_clip, read).otherwise(s["from_read"]), F.when(large_deletion, ref).otherwise(s["from_ref"]), found
        )

    start = reference_start.cast("long")
    empty = state(F.lit(0), start, F.lit(0), start, F.array().cast(f"array<{_PIECE}>"))
    return F.aggregate(cigar, empty, step, close)


def merge_short(found: Column, longest: int = 500) -> Column:
    """Split pieces with the short ones absorbed into the long one before them, which then reaches to their end; insertions stay as they are."""
    kinds = f"array<{_PIECE}>"
    splits, ins = F.filter(found, lambda p: p["kind"] == "split"), F.filter(found, lambda p: p["kind"] == "insertion")

    def step(done: Column, p: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.struct(last["kind"].alias("kind"), last["ref_start"].alias("ref_start"), p["ref_end"].alias("ref_end"), last["read_start"].alias("read_start"), p["read_end"].alias("read_end"), (last["length"] + p["length"]).alias("length"))
        short = (F.size(done) > 0) & (p["ref_end"] - p["ref_start"] <= longest)
        return F.when(short, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(p)))

    return F.concat(F.aggregate(splits, F.array().cast(kinds), step), ins)


def segments(alignments: DataFrame, min_size: int = 40, min_clip: int = 500) -> DataFrame:
    """Rows of segments of mapped, not secondary alignments: their split pieces, insertions and clips longer than min_clip.

    alignments: genome_id, read_id, ref_id, reference_start, cigar, is_reverse, is_secondary, is_unmapped, mapping_quality, nm, hp, query_sequence (may
    be null). mismatch_rate is the mismatches without indels, per mille of the aligned length. Rows with a null place or no CIGAR give none.
    """
    ops = lambda codes: F.aggregate(F.filter("cigar", lambda c: c["op"].isin(*codes)), F.lit(0).cast("long"), lambda s, c: s + c["len"])
    aligned = ops([*MATCH, INSERTION])
    rows = (
        alignments.where("not is_secondary and not is_unmapped and reference_start is not null and size(cigar) > 0")
        .withColumn("read_length", aligned + ops(CLIPS))
        .withColumn("mismatch_rate", F.when(aligned > 0, F.floor(F.greatest(F.col("nm") - ops([INSERTION, DELETION]), F.lit(0)) * 1000 / aligned)).cast("int"))
        .withColumn("p", merge_short(pieces(F.col("cigar"), F.col("reference_start"), min_size)))
        .withColumn("_end", F.col("reference_start") + ops([*MATCH, DELETION, 3]))
    )
    head, tail = F.get("cigar", F.lit(0)), F.get("cigar", F.size("cigar") - 1)
    clip = lambda c, at: F.when(c["op"].isin(*CLIPS) & (c["len"] > min_clip), F.struct(F.lit("clip").alias("kind"), at.alias("ref_start"), at.alias("ref_end"), F.lit(0).cast("long").alias("read_start"), c["len"].alias("read_end"), c["len"].alias("length")))
    every = F.concat("p", F.array_compact(F.array(clip(head, F.col("reference_start")), clip(tail, F.col("_end")))))
    flipped = F.col("is_reverse") & (F.col("s.kind") == "split")
    sequence = F.when((F.col("s.kind") == "insertion") & F.col("query_sequence").isNotNull(), F.substr("query_sequence", F.col("s.read_start") + 1, F.col("s.length")))
    return rows.withColumn("s", F.explode(every)).select(
        "genome_id", "read_id", "ref_id", F.col("s.kind").alias("kind"), F.col("s.ref_start").alias("ref_start"), F.col("s.ref_end").alias("ref_end"),
        F.when(flipped, F.col("read_length") - F.col("s.read_end")).otherwise(F.col("s.read_start")).alias("read_start"),
        F.when(flipped, F.col("read_length") - F.col("s.read_start")).otherwise(F.col("s.read_end")).alias("read_end"),
        F.when(F.col("is_reverse"), -1).otherwise(1).alias("strand"), F.col("s.length").alias("segment_length"), "read_length", "mismatch_rate", F.col("mapping_quality").alias("mapq"),
        F.when(F.col("hp").isin(1, 2), F.col("hp")).otherwise(0).alias("haplotype"), sequence.alias("ins_seq"),
    )
