"""The feature-selection stage: clean, split, fit L1 regressions, rank, keep."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worthline.functions.scalars import inf_to_null
from worthline.operators import lasso, ranking
from worthline.operators.filters import filter_not_null
from worthline.operators.impute import impute_median
from worthline.operators.split import with_split


@dataclass
class Selection:
    ranked: DataFrame
    selected: DataFrame
    scores: DataFrame


def select_features(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    key: str,
    segment: str,
    protected: Sequence[str] = (),
    pct: float = 40,
    alphas=None,
    leaky: bool = False,
    **options,
) -> Selection:
    """Rank the features of every segment by L1 regression and mark the best ``pct`` percent.

    Medians are taken from training rows; ``leaky`` takes them from all rows.
    """
    rows = filter_not_null(df, target)
    rows = rows.withColumns({c: inf_to_null(F.col(c).cast("double")) for c in features})
    rows = with_split(rows, key)
    where = None if leaky else F.col("split") == "train"
    filled = impute_median(rows, features, [segment], where=where, **options)
    fits = lasso.lasso_cv(filled, features, target, key, segment, alphas, split="split")
    spark = df.sparkSession
    ranked = ranking.rank_features(lasso.importance(spark, fits, features).drop("importance"))
    return Selection(ranked, ranking.top_pct_select(ranked, pct, protected), lasso.scores(spark, fits))
