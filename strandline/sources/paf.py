"""Pairwise alignment lines (PAF): twelve fixed fields, then tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.rejects import Rule, computed, rejected, split_quoted, valid, with_errors

# The columns of the format.
FIELDS = ["qry_id", "qry_len", "qry_start", "qry_end", "strand", "ref_id", "ref_len", "ref_start", "ref_end", "n_match", "block_len", "mapq"]
MIN_FIELDS, MAX_FIELDS = 14, 16

DIGITS = r"\A[0-9]+\z"
MAPQ = r"\A0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])\z"
DIVERGENCE = r"\Ade:f:[0-9]+(?:\.[0-9]+)?(?:e[+-]?[0-9]+)?\z"


def _size(digits: Column) -> Column:
    """Orders texts of digits of any length as numbers."""
    plain = F.regexp_replace(digits, r"\A0+(?=[0-9])", "")
    return F.struct(F.length(plain), plain)


def _is(column: str, pattern: str) -> Column:
    return F.col(column).rlike(pattern)


def read_lines(df: DataFrame, line: str = "raw_line") -> DataFrame:
    """df with each field of a line as nullable text, tags as an array of text, the first tags de and tp as text, and errors, the array of its reasons (empty: a valid line).

    Reasons: quoting, columns, mapq, de_tag, other; the first is the one that counts. A null or empty line has the reason columns. Columns of
    df named like a field are dropped, the line and all others stay.
    """
    fields = F.col("_split.fields")
    divergence = F.col("_de")
    number = F.substring(divergence[0], 6, 2**31 - 1).try_cast("double")
    numbers = ["qry_len", "qry_start", "qry_end", "ref_len", "ref_start", "ref_end", "n_match", "block_len"]
    all_digits = F.lit(True)
    for c in numbers:
        all_digits = all_digits & _is(c, DIGITS)
    in_order = F.lit(True)
    for a, b in (("qry_start", "qry_end"), ("qry_end", "qry_len"), ("ref_start", "ref_end"), ("ref_end", "ref_len")):
        in_order = in_order & (_size(F.col(a)) <= _size(F.col(b)))
    rules = [
        Rule("quoting", F.col("_split.bad_quoting")),
        Rule("columns", ~F.col("_split.n_fields").between(MIN_FIELDS, MAX_FIELDS)),
        Rule("mapq", ~_is("mapq", MAPQ)),
        Rule("de_tag", (F.size(divergence) != 1) | ~divergence[0].rlike(DIVERGENCE) | ~number.between(0, 1)),
        Rule("other", ~F.col("strand").isin("+", "-") | (F.col("qry_id") == "") | (F.col("ref_id") == "") | ~all_digits | ~in_order),
    ]
    lines = df.drop(*(c for c in [*FIELDS, "tags", "de_tag", "type_tag", "errors", "_split", "_de"] if c != line))
    text = (
        computed(lines, "_split", split_quoted(F.col(line), MAX_FIELDS))
        .withColumns({c: F.get(fields, F.lit(i)) for i, c in enumerate(FIELDS)})
        .withColumn("tags", F.slice(fields, len(FIELDS) + 1, MAX_FIELDS - len(FIELDS)))
    )
    text = computed(text, "_de", F.filter("tags", lambda t: t.startswith("de:"))).withColumns(
        {"de_tag": F.get("_de", F.lit(0)), "type_tag": F.get(F.filter("tags", lambda t: t.startswith("tp:")), F.lit(0))}
    )
    return with_errors(text, rules).drop("_split", "_de")


def load(df: DataFrame, line: str = "raw_line") -> DataFrame:
    """The valid lines with typed fields (positions of more than 18 digits become null), de as a number and type_tag."""
    good = valid(read_lines(df, line))
    whole = {c: F.col(c).try_cast("long") for c in FIELDS if c not in ("qry_id", "strand", "ref_id", "mapq")}
    return good.withColumns(
        whole | {"mapq": F.col("mapq").cast("int"), "de": F.substring("de_tag", 6, 2**31 - 1).cast("double")}
    )


def bad_lines(df: DataFrame, line: str = "raw_line") -> DataFrame:
    """The other lines, with all errors and the first one as reason."""
    return rejected(read_lines(df, line))
