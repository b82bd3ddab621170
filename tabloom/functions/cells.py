"""Cell-level column expressions: text, numbers, null conventions, tiers."""
from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters Python's str.strip() removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Texts that mean "no value" in keyed comparisons.
NULL_TOKENS = ("nan", "NaN", "None", "none", "N/A", "")

ROW = "_row"
#: The file of a row, where a load keeps it.
FILE = "_file"


def col(name: str) -> Column:
    """Column by literal name (dots and spaces are part of the name)."""
    return F.col("`" + name.replace("`", "``") + "`")


def sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def business_columns(df: DataFrame) -> list[str]:
    """All columns except the row-lineage column."""
    return [c for c in df.columns if c != ROW]


def sort_rows(df: DataFrame, *order: Column) -> DataFrame:
    """Sort rows with a tie-breaker, so that equal values can be spread over several tasks."""
    tie = F.col(ROW) if ROW in df.columns else F.xxhash64(*[col(c) for c in df.columns])
    return df.orderBy(*order, tie)


def is_numeric_type(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def number(df: DataFrame, name: str) -> Column:
    """``name`` as double, NULL where it is not a number.

    Text follows the rules ``1_000`` -> 1000 and ``1d`` -> NULL, which differ
    from a bare Spark cast.
    """
    kind = df.schema[name].dataType
    c = col(name)
    if isinstance(kind, T.DoubleType):
        return c
    if is_numeric_type(kind) or isinstance(kind, T.BooleanType):
        return c.cast("double")
    if isinstance(kind, T.StringType):
        # Only text with one of these letters can read differently from a plain cast.
        plain = F.regexp_replace(c, r"(?<=\d)_(?=\d)", "")
        careful = F.when(~plain.rlike(r"[0-9.][dDfF]\s*$"), plain.try_cast("double"))
        return F.when(c.rlike("[dDfF_]"), careful).otherwise(c.try_cast("double"))
    return F.lit(None).cast("double")


def has_text(c: Column) -> Column:
    """True where the cell is neither NULL nor the empty string; never NULL."""
    return F.coalesce(c.cast("string") != "", F.lit(False))


def present(df: DataFrame, name: str) -> Column:
    """``has_text`` that skips the text cast where the type cannot hold ''."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return has_text(col(name))
    return col(name).isNotNull()


def looks_numeric(c: Column) -> Column:
    return c.cast("string").rlike(r"^[0-9]*\.?[0-9]+$")


def bare_text(c: Column) -> Column:
    """Trim, then drop one outer quote at each end; text without either is passed through."""
    text = c.cast("string")
    return F.when(text.rlike(r'^[^!#-~]|[^!#-~]$'), F.regexp_replace(strip(text), r'^"|"$', "")).otherwise(text)


def clean_names(names: Iterable[str]) -> list[str]:
    """Header names trimmed, without quotes, made unique with ``_n`` suffixes."""
    out: list[str] = []
    uses: dict[str, int] = {}
    for raw in names:
        name = str(raw).strip().replace('"', "")
        uses[name] = uses.get(name, -1) + 1
        out.append(f"{name}_{uses[name]}" if uses[name] else name)
    return out


def steps(value: Column, cuts: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Label by the first cut (highest first) that ``value`` reaches."""
    label: Column | None = None
    for at_least, name in cuts:
        test = value >= F.lit(float(at_least))
        label = F.when(test, name) if label is None else label.when(test, name)
    return label.otherwise(otherwise)


# Tier thresholds and labels.
TIERS = ((10000, "PLATINUM"), (5000, "GOLD"), (1000, "SILVER"))


def tier(value: Column) -> Column:
    return steps(value, TIERS, "BRONZE")


def value_band(value: Column) -> Column:
    """Low below 1,000, Medium below 10,000, otherwise High (also for NULL)."""
    return F.when(value < 1000, "Low").when(value < 10000, "Medium").otherwise("High")


def text_features(name: str) -> list[Column]:
    """Upper-cased text and its length, named after the source column."""
    c = col(name).cast("string")
    return [F.upper(c).alias(f"{name}_upper"), F.length(c).cast("long").alias(f"{name}_length")]
