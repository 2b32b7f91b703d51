"""Column management that tolerates missing names, and reports about it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Statuses of the presence report.
EXISTING, MISSING, EXTRA = "existing", "missing", "extra"


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def reorder_columns(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Listed columns first, in the order given; the others follow in their own order."""
    listed = [c for c in order if c in df.columns]
    return df.select(*listed, *[c for c in df.columns if c not in listed])


def column_presence_report(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    rows = [(c, EXISTING if c in df.columns else MISSING) for c in wanted]
    rows += [(c, EXTRA) for c in df.columns if c not in wanted]
    return df.sparkSession.createDataFrame(rows, "name string, status string")


def shape_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of each named table."""
    lines = [
        df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("stage"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
        )
        for name, df in tables.items()
    ]
    out = lines[0]
    for line in lines[1:]:
        out = out.unionByName(line)
    return out


def feature_columns(df: DataFrame, excluded: Sequence[str]) -> list[str]:
    """Columns whose lower-case name contains none of the excluded names."""
    return [c for c in df.columns if not any(x.lower() in c.lower() for x in excluded)]


def drop_exact(df: DataFrame, excluded: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in excluded])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def numeric_only(df: DataFrame) -> DataFrame:
    return df.select(*numeric_columns(df))


def kept_features(
    df: DataFrame, analysed: Sequence[str], protected: Sequence[str], top: Sequence[str], target: str
) -> DataFrame:
    """Columns outside the analysis, then protected, then selected features, then the target."""
    analysed = {*analysed, *protected, *top, target}
    return df.select(*[c for c in df.columns if c not in analysed], *protected, *top, target)


def segment_name(code: str, names: dict[int, str], prefix: str = "Posición_") -> Column:
    """Name of a segment code; an unknown code becomes the prefix and the code."""
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.coalesce(
        F.element_at(F.create_map(*pairs), F.col(code)), F.concat(F.lit(prefix), F.col(code).cast("string"))
    )


def radar_vector(segment: str, choices: dict[str, dict[str, str]], default: dict[str, str]) -> Column:
    """Map of label to value of the attributes chosen for the row's segment; missing is zero.

    ``choices`` maps a substring of the lower-case segment to {label: column}; first match wins.
    """

    def vector(chosen):
        return F.create_map(
            *[x for label, c in chosen.items() for x in (F.lit(label), F.coalesce(F.col(c).cast("double"), F.lit(0.0)))]
        )

    out = vector(default)
    for part, chosen in reversed(list(choices.items())):
        out = F.when(F.contains(F.lower(segment), F.lit(part.lower())), vector(chosen)).otherwise(out)
    return out


def radar_scale(vector: str, least: float = 100.0) -> Column:
    return F.greatest(F.array_max(F.map_values(vector)), F.lit(least))


def detail_card(segment: str, choices: dict[str, dict[str, Column]], default: dict[str, Column]) -> Column:
    """Array of (label, value) of the non-empty fields chosen for the row's segment."""

    def card(chosen):
        rows = F.array(
            *[F.struct(F.lit(label).alias("label"), c.cast("string").alias("value")) for label, c in chosen.items()]
        )
        return F.filter(rows, lambda x: x["value"].isNotNull() & (x["value"] != ""))

    out = card(default)
    for part, chosen in reversed(list(choices.items())):
        out = F.when(F.contains(F.lower(segment), F.lit(part.lower())), card(chosen)).otherwise(out)
    return out
