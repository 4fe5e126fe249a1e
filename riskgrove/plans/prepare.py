"""From the analysis table to the feature matrix."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from riskgrove.functions.binning import cut, qcut
from riskgrove.functions.columns import codes, interactions
from riskgrove.operators.common import distinct_levels
from riskgrove.operators.encode import (
    apply_target_encoding,
    fill_missing,
    one_hot,
    target_encoding,
    z_score,
)
from riskgrove.operators.split import stratified_split
from riskgrove.session import compile_wide, free_shuffles, shared_path
from riskgrove.sources import schema as S

DUMMIES = ["industry", "location"]
LABEL = "label"


@dataclass(frozen=True)
class Prepared:
    """The prepared rows and the names of their feature columns, in matrix order."""

    rows: DataFrame
    features: list[str]

    @property
    def train(self) -> DataFrame:
        return self.rows.where(F.col("split") == "train")

    @property
    def test(self) -> DataFrame:
        return self.rows.where(F.col("split") == "test")

    @property
    def scaled_features(self) -> list[str]:
        """The features other than dummies."""
        return [c for c in self.features if not any(c.startswith(f"{d}_") for d in DUMMIES)]


def feature_names(levels: dict[str, list[str]]) -> list[str]:
    """Six numeric columns, nine derived ones, seven codes, the encoded title, the dummies."""
    return [
        *S.NUMERIC,
        *S.DERIVED,
        *S.CODES,
        "job_title_encoded",
        *[f"{c}_{level}" for c in DUMMIES for level in levels[c][1:]],
    ]


def prepare(
    raw: DataFrame,
    key: str = S.KEY,
    fit_on: str = "train",
    apostrophe: str = "normal",
    test_share: float = 0.2,
    seed: int = 42,
    tertiles: bool = False,
) -> Prepared:
    """Features, labels and split of the analysis table.

    Encoders see the training rows only; ``fit_on='all'`` fits them before the split, as
    published. Missing features become 0. The rows are written to the shared folder.
    """
    compile_wide(raw.sparkSession)
    rows = raw.withColumn(LABEL, cut("risk", S.RISK_EDGES, S.RISK_CODES))
    # Levels, cuts, encoders, prior and z-score all read the rows: they are computed once, as a
    # table. The split is a comparison with the cuts, made anew where it is asked for.
    path = shared_path(rows.sparkSession, "raw")
    rows.write.parquet(path)
    rows = rows.sparkSession.read.schema(rows.schema).parquet(path)
    free_shuffles(rows.sparkSession)
    levels = {c: distinct_levels(rows, c) for c in DUMMIES}
    if tertiles:
        rows = qcut(rows, "risk", 3, [0, 1, 2], "label_tertile")
    rows = stratified_split(rows, LABEL, key, test_share, seed)
    fitted = rows if fit_on == "all" else rows.where(F.col("split") == "train")
    encoding = target_encoding(fitted, "job_title", S.TARGET)
    # The lookup moves rows, so it comes before they grow wide.
    rows = apply_target_encoding(
        rows, encoding, fitted, "job_title", S.TARGET, "job_title_encoded"
    )
    rows = rows.withColumns({**interactions(), **codes(apostrophe)})
    rows = z_score(rows, "salary", "salary_zscore", fit_on=fitted)
    rows = one_hot(rows, DUMMIES, levels=levels)
    features = feature_names(levels)
    keep = [key, LABEL, S.TARGET, "split", *(["label_tertile"] if tertiles else [])]
    return Prepared(fill_missing(rows, features).select(*keep, *features), features)
