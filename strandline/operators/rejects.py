"""Loading of delimited lines: every field as text first, rules as error arrays, valid rows apart from bad lines with their reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAB, QUOTE = "\t", '"'


@dataclass(frozen=True)
class Rule:
    """broken is true (or null) where a row breaks the rule; rules are tried in their order."""

    reason: str
    broken: Column


def split_quoted(line: Column, keep: int) -> Column:
    """A struct of fields (the first keep of them), n_fields and bad_quoting of a tab-separated line.

    A field that begins with a quote runs to its closing quote and may hold tabs, a doubled quote in it stands for one quote, and a quote inside
    any other field is text. bad_quoting: a closing quote is missing or is not followed by a tab or the line's end. A null line has no fields.
    Lines without quotes, nearly all of them, are just split; a fold over the pieces between tabs reads the others in one pass.
    """
    pieces = F.split(line, TAB, -1)
    kind = f"struct<fields:array<string>,n_fields:int,bad_quoting:boolean,open:boolean,rest:string>"

    def state(fields, n_fields, bad, is_open, rest):
        return F.struct(
            fields.alias("fields"), n_fields.cast("int").alias("n_fields"), bad.alias("bad_quoting"), is_open.alias("open"), rest.alias("rest")
        ).cast(kind)

    def step(s: Column, piece: Column) -> Column:
        opens = ~s["open"] & piece.startswith(QUOTE)
        quoted = s["open"] | opens
        body = F.when(opens, F.substring(piece, 2, 2**31 - 1)).otherwise(piece)
        single = F.replace(body, F.lit(QUOTE * 2), F.lit(""))  # runs of quotes pair from the left, so what is left closes the field
        closes = quoted & single.contains(QUOTE)
        bad = s["bad_quoting"] | (closes & (F.instr(single, QUOTE) < F.length(single)))
        text = F.when(s["open"], F.concat(s["rest"], F.lit(TAB), body)).otherwise(body)
        ends = ~quoted | closes
        unquoted = F.when(quoted, F.replace(F.substring(text, F.lit(1), F.length(text) - 1), F.lit(QUOTE * 2), F.lit(QUOTE))).otherwise(text)
        fields = F.when(ends & (F.size(s["fields"]) < keep), F.concat(s["fields"], F.array(unquoted))).otherwise(s["fields"])
        return state(fields, s["n_fields"] + ends.cast("int"), bad, ~ends, F.when(ends, F.lit("")).otherwise(text))

    empty = state(F.array().cast("array<string>"), F.lit(0), F.lit(False), F.lit(False), F.lit(""))
    folded = F.aggregate(pieces, empty, step, lambda s: F.struct(s["fields"].alias("fields"), s["n_fields"].alias("n_fields"), (s["bad_quoting"] | s["open"]).alias("bad_quoting")))
    plain = F.struct(F.slice(pieces, 1, keep).alias("fields"), F.size(pieces).cast("int").alias("n_fields"), F.lit(False).alias("bad_quoting"))
    none = F.struct(F.array().cast("array<string>").alias("fields"), F.lit(0).alias("n_fields"), F.lit(False).alias("bad_quoting"))
    return F.when(line.isNull(), none).when(line.contains(QUOTE), folded).otherwise(plain)


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once for each row, however often it is used: Spark copies a projection's expressions into later ones and
    into filters, but not those of a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_errors(df: DataFrame, rules: list[Rule], column: str = "errors") -> DataFrame:
    """df with an array of the reasons of all broken rules, in the rules' order; an empty array marks a valid row."""
    broken = [F.when(F.coalesce(r.broken, F.lit(True)), F.lit(r.reason)) for r in rules]
    return df.withColumn(column, F.array_compact(F.array(*broken)))


def valid(df: DataFrame, column: str = "errors") -> DataFrame:
    return df.where(F.size(column) == 0).drop(column)


def rejected(df: DataFrame, column: str = "errors") -> DataFrame:
    """Rows with an error; reason is the first one."""
    return df.where(F.size(column) > 0).withColumn("reason", F.col(column)[0])
