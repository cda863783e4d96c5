"""CSV drops as raw records: every line is kept until it is known to be sound.

A drop is scanned once, as bytes.  A line becomes a row of the contract's columns as
text, with its file and the line itself, or a row that says what is wrong with it:

===================  ==========================================================
undecodable bytes    the line is not UTF-8
unclosed quote       a quoted field does not end on the line
text after a quote   a quoted field goes on after its closing quote
too few fields       fewer than the contract has
too many fields      more than the contract has
no header            the file holds no line with the contract's names in order
===================  ==========================================================

The first that applies counts.  Empty lines are no records, and a line that holds the
contract's names, in any case, is a header wherever it stands.  A quote inside a
quoted field is escaped by the ``escape`` option's character, a backslash by default.
"""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.sources import schemas, scratch

BROKEN, FILE, LINE, IS_HEADER = "broken", "file_path", "raw_line", "is_header"

# The reasons.
UNDECODABLE, UNCLOSED, TRAILING = "undecodable bytes", "unclosed quote", "text after a quote"
TOO_FEW, TOO_MANY, NO_HEADER = "too few fields", "too many fields", "no header"
BYTE_ORDER_MARK = "\ufeff"
_ALL = (1 << 31) - 1


def _quoted_fields(line: Column, sep: str, escape: str) -> Column:
    """``(n, open, bad)`` of a line with quotes: its fields, whether one stays open, whether one goes on after its end.

    The line's pieces between separators are folded: a piece that begins with a quote
    opens a field, which ends with the piece whose last quote is not escaped.
    """
    escaped = '""' if escape == '"' else f"{re.escape(escape)}."
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("open"), F.lit(False).alias("bad"))

    def step(state: Column, piece: Column) -> Column:
        opened = state["open"] | piece.startswith('"')
        inner = F.when(state["open"], piece).otherwise(piece.substr(F.lit(2), F.length(piece)))
        rest = F.regexp_replace(inner, escaped, "")
        end = F.instr(rest, '"')
        n = (state["n"] + F.when(state["open"], 0).otherwise(1)).alias("n")
        judged = F.struct(
            n,
            (opened & (end == 0)).alias("open"),
            (state["bad"] | (opened & (end > 0) & (end < F.length(rest)))).alias("bad"),
        )
        # a piece without a quote neither opens nor ends a field
        return F.when(F.contains(piece, F.lit('"')), judged).otherwise(F.struct(n, state["open"].alias("open"), state["bad"].alias("bad")))

    pieces = F.split(line, f"\\Q{sep}\\E", -1)
    return F.aggregate(pieces, start, step)


def split_lines(lines: DataFrame, table: str, options: dict[str, str]) -> DataFrame:
    """Contract columns as text, ``broken``, ``is_header``, ``file_path`` and ``raw_line`` of lines ``(value, file_path)``."""
    names, sep = schemas.columns(table), options.get("sep", ",")
    valid = F.make_valid_utf8("value")
    text = F.when(F.startswith(valid, F.lit(BYTE_ORDER_MARK)), F.substring(valid, 2, _ALL)).otherwise(valid)
    separators = F.length("_text") - F.length(F.replace("_text", F.lit(sep), F.lit("")))
    plain = (separators / len(sep)).cast("int") + 1
    quoted = _quoted_fields(F.col("_text"), sep, options.get("escape", "\\"))
    lines = lines.withColumn("_text", text).where("_text <> ''")
    has_quote = F.contains("_text", F.lit('"'))
    lines = lines.withColumn("_quoted", F.when(has_quote, quoted)).withColumn("_n", F.coalesce(F.col("_quoted.n"), plain))
    n = F.col("_n")
    broken = (
        F.when(~F.is_valid_utf8("value"), UNDECODABLE)
        .when(F.col("_quoted.open"), UNCLOSED)
        .when(F.col("_quoted.bad"), TRAILING)
        .when(n < len(names), TOO_FEW)
        .when(n > len(names), TOO_MANY)
    )
    parser = {k: v for k, v in options.items() if k not in ("mode", "header", "enforceSchema", "dateFormat")}
    fields = F.from_csv("_text", schemas.text_ddl(table), {**parser, "mode": "PERMISSIVE"})
    parsed = lines.withColumn(BROKEN, broken).withColumn("_fields", F.when(F.col(BROKEN).isNull(), fields))
    # column by column: for all but headers the first one decides
    header = functools.reduce(operator.and_, [F.lower(F.trim(F.col(f"_fields.{n}"))) == n for n in names])
    return parsed.select(
        *[F.col(f"_fields.{n}").alias(n) for n in names],
        BROKEN,
        F.coalesce(header, F.lit(False)).alias(IS_HEADER),
        FILE,
        F.col("_text").alias(LINE),
    )


def read_records(spark: SparkSession, path: str, table: str, options: dict[str, str]) -> DataFrame:
    """The records of a drop, sound or broken, header lines left out; a written table.

    The files are scanned once.  What follows reads the written records: first which
    files have a header, into a table of a row a file, then the records with those files'
    lines marked.  That table's size is known, so Spark sends it to the records and
    no record moves for the join.  A line that its fields spell out again is not stored
    beside them.  ``raw_line`` has every undecodable byte replaced.
    """
    sep, names = options.get("sep", ","), schemas.columns(table)
    spelled = F.concat_ws(sep, *[F.coalesce(n, F.lit("")) for n in names])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias(FILE))
    own, heads = (scratch.fresh_path(spark, f"{table}-{what}") for what in ("records", "headed"))
    found = split_lines(lines, table, options).withColumn(LINE, F.when(F.col(LINE) != spelled, F.col(LINE)))
    found.write.option("compression", "zstd").parquet(own)
    records = spark.read.schema(found.schema).parquet(own)
    records.where(IS_HEADER).select(F.col(FILE).alias("_headed")).distinct().write.parquet(heads)
    headed = spark.read.schema("_headed string").parquet(heads)
    marked = records.where(f"not {IS_HEADER}").join(headed, F.col(FILE) == F.col("_headed"), "left")
    no_header = F.when(F.col("_headed").isNull(), NO_HEADER)
    return marked.withColumns({BROKEN: F.coalesce(BROKEN, no_header), LINE: F.coalesce(LINE, spelled)}).drop("_headed", IS_HEADER)
