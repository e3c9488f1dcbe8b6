"""Text lines of coordinate files to typed triplets, with every failing line kept beside its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelweave.plans.skew import skew_join
from levelweave.plans.storage import cut

BLANKS = " \t"
_INDEX = r"^[0-9]+\z"
_DECIMAL = r"^[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z"
_COMMA = "\u0001"  # stands for a comma inside quotes; no valid value holds either


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def quoting_ok(line: Column) -> Column:
    """Whether the double quotes of a line are well formed.

    Cut at its quotes, a well-formed line alternates between text outside and inside quotes.
    Outside, an empty piece is a doubled quote; any other must hold a comma, with only
    blanks between it and the quotes around it.
    """
    parts = F.split(line, '"', -1)
    first_ok = F.element_at(parts, 1).rlike(r"(?s)(?:^|,)[ \t]*\z")
    last_ok = F.element_at(parts, -1).rlike(r"(?s)^[ \t]*(?:,|\z)")
    middle = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))  # every second piece from here is inside quotes
    between = F.transform(middle, lambda s, i: (i % 2 == 0) | (s == "") | s.rlike(r"(?s)^[ \t]*,(?:.*,)?[ \t]*\z"))
    return ~line.contains('"') | ((F.size(parts) % 2 == 1) & first_ok & last_ok & F.forall(between, lambda x: x))


def fields_of(line: Column) -> Column:
    """The fields of a well-formed line, without quotes and outer blanks."""
    parts = F.split(line, '"', -1)
    safe = F.array_join(F.transform(parts, lambda s, i: F.when(i % 2 == 1, F.translate(s, ",", _COMMA)).otherwise(s)), '"')

    def clean(f: Column) -> Column:
        t = _trim(f)
        return F.when(t.startswith('"'), _trim(F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit('""'), F.lit('"')))).otherwise(t)

    return F.when(line.contains('"'), F.transform(F.split(safe, ",", -1), clean)).otherwise(F.transform(F.split(line, ",", -1), _trim))


def _index(text: Column) -> Column:
    digits = F.regexp_replace(text, "^0+(?=.)", "")
    return F.when(F.length(digits) <= 18, digits.try_cast("long"))


def invalid_values(split: DataFrame) -> DataFrame:
    """(kind, graph_id, text, detail, uses): the dictionary of texts that no field of that kind may hold.

    Every distinct row and col text of a graph and every distinct val text is cast once, after the
    fields were brought together: ``detail`` hangs on the count of its ``uses``, so no optimiser can move the cast below.
    """
    own = [F.struct(F.lit(k).alias("kind"), F.col("graph_id"), F.col(f"{k}_text").alias("text"), F.col(f"{k}_most").alias("most")) for k in ("row", "col")]
    val = F.struct(F.lit("val").alias("kind"), F.lit(None).cast("long").alias("graph_id"), F.col("val_text").alias("text"), F.lit(None).cast("long").alias("most"))
    texts = split.select(F.explode(F.array(*own, val)).alias("v")).select("v.*").filter(F.col("text").isNotNull()).groupBy("kind", "graph_id", "text", "most").agg(F.count(F.lit(1)).alias("uses"))
    number, real = _index(F.col("text")), F.col("text").try_cast("double")
    of_index = F.when(~F.col("text").rlike(_INDEX), "not_digits").when(number.isNull(), "too_large").when(number < 1, "below_one").when(~F.coalesce(number <= F.col("most"), F.lit(False)), "above_n")
    of_val = F.when(~F.col("text").rlike(_DECIMAL), "not_decimal").when(real.isNull() | (F.abs(real) == float("inf")), "not_finite")
    detail = F.when(F.col("uses") > 0, F.when(F.col("kind") == "val", of_val).otherwise(of_index))
    return texts.select("kind", "graph_id", "text", detail.alias("detail"), "uses").filter(F.col("detail").isNotNull())


def parse_triplets(lines: DataFrame, graphs: DataFrame, row_bound: str = "n") -> DataFrame:
    """Every line that is no comment, as a typed triplet or with the reason it fails.

    Columns: ``line_id, graph_id, line_no, line``, ``row, col`` (1-based), ``val`` (1.0 in a
    pattern file), ``reason`` (null if valid; else the first of ``quoting``, ``columns``, ``value``) and ``detail``.
    A pattern file has two fields, any other three. A line that is null has no fields: ``columns``.
    An empty line has one. ``n`` of ``graphs`` bounds col, its column ``row_bound`` bounds row.
    A graph that ``graphs`` doesn't list allows no index: ``value``, ``above_n``.
    Repeated lines are judged each by itself; other columns of both tables are ignored.
    """
    spec = graphs.groupBy("graph_id").agg(F.max("n").alias("col_most"), F.max(row_bound).alias("row_most"), F.max(F.when(F.col("field") == "pattern", True).otherwise(False)).alias("is_pattern"))
    raw = lines.select("line_id", "graph_id", "line_no", "line").filter(F.col("line").isNull() | ~F.col("line").startswith("%"))
    known = skew_join(raw, spec, ["graph_id"], "left")
    f = F.when(F.col("quoted_ok"), fields_of(F.col("line")))
    wanted = F.when(F.coalesce("is_pattern", F.lit(False)), 2).otherwise(3)
    split = known.withColumn("quoted_ok", F.coalesce(quoting_ok(F.col("line")), F.lit(True))).withColumn("f", f).withColumn("count_ok", F.coalesce(F.size("f") == wanted, F.lit(False)))
    get = lambda i: F.when(F.col("count_ok"), F.get("f", F.lit(i)))
    split = split.select("line_id", "graph_id", "line_no", "line", "row_most", "col_most", "quoted_ok", "count_ok", get(0).alias("row_text"), get(1).alias("col_text"), get(2).alias("val_text"))
    bad = cut(invalid_values(split))
    for kind in ("row", "col", "val"):
        keys = [F.col("text").alias(f"{kind}_text"), F.col("detail").alias(f"{kind}_bad")]
        of = bad.filter(F.col("kind") == kind)
        if kind == "val":
            split = skew_join(split, of.select(*keys), ["val_text"], "left")
        else:  # a null graph is a graph like any other
            split = skew_join(split.withColumn("_g", F.coalesce("graph_id", F.lit(-(2**63)))), of.select(F.coalesce("graph_id", F.lit(-(2**63))).alias("_g"), *keys), ["_g", f"{kind}_text"], "left").drop("_g")
    value = F.coalesce("row_bad", "col_bad", "val_bad")
    reason = F.when(~F.col("quoted_ok"), "quoting").when(~F.col("count_ok"), "columns").when(value.isNotNull(), "value")
    valid = reason.isNull()
    return split.select(
        "line_id", "graph_id", "line_no", "line", F.when(valid, _index(F.col("row_text"))).alias("row"), F.when(valid, _index(F.col("col_text"))).alias("col"),
        F.when(valid, F.coalesce(F.col("val_text").try_cast("double"), F.lit(1.0))).alias("val"), reason.alias("reason"),
        F.when(reason == "value", value).when(reason == "columns", F.lit("wrong_count")).when(reason == "quoting", F.lit("broken_quotes")).alias("detail"),
    )


def valid_triplets(parsed: DataFrame) -> DataFrame:
    """The typed rows, 1-based."""
    return parsed.filter(F.col("reason").isNull()).select("line_id", "graph_id", "line_no", "row", "col", "val")


def rejected_lines(parsed: DataFrame) -> DataFrame:
    """The lines that fail, whole, with their reasons."""
    return parsed.filter(F.col("reason").isNotNull()).select("line_id", "graph_id", "line_no", "line", "reason", "detail")
