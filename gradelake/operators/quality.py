"""Declared constraints as checks that return what breaks them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gradelake.schemas import DIFFICULTIES, MAX_QUESTIONS, MIN_QUESTIONS


def check_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls per column that must not have any; one pass over the table."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column_name", "nulls")


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values held by more than one row, with how many."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def check_orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """Child rows whose parent is gone."""
    parents = parent.select(F.col(pk).alias("_parent"))
    return child.join(parents, F.col(fk) == F.col("_parent"), "left_anti")


def validate_configs(
    configs: DataFrame,
    lo: int = MIN_QUESTIONS,
    hi: int = MAX_QUESTIONS,
    domain: Sequence[str] = DIFFICULTIES,
) -> DataFrame:
    """Form checks per configuration, and the difficulty the form would show.

    A difficulty outside the domain becomes the domain's second entry.
    """
    return configs.withColumns(
        {
            "names_ok": F.coalesce(
                (F.col("profile_name") != "") & (F.col("variant_name") != ""), F.lit(False)
            ),
            "questions_ok": F.coalesce(F.col("num_preguntas").between(lo, hi), F.lit(False)),
            "dificultad": F.when(
                F.col("dificultad").isin(list(domain)), F.col("dificultad")
            ).otherwise(F.lit(domain[1])),
        }
    )


class WriteChecks:
    """Checks that are counted while a table is written, without a scan of their own.

    ``watch`` adds the counting to a DataFrame; once that has been written, ``nulls`` and
    ``failures`` hold the figures. A run that failed has none.
    """

    def __init__(self, not_null: Sequence[str] = (), must_hold: Sequence[str] = ()):
        self._columns, self._flags = list(not_null), list(must_hold)
        self._seen = Observation()

    def watch(self, df: DataFrame) -> DataFrame:
        """``df`` with its rows, its nulls in ``not_null`` columns and its rows on which a
        ``must_hold`` column is not true counted as they pass."""
        nulls = [
            F.count_if(F.col(c).isNull()).alias(f"null_{k}") for k, c in enumerate(self._columns)
        ]
        broken = [
            F.count_if(~F.coalesce(F.col(c), F.lit(False))).alias(f"broken_{k}")
            for k, c in enumerate(self._flags)
        ]
        return df.observe(self._seen, F.count(F.lit(1)).alias("rows"), *nulls, *broken)

    @property
    def rows(self) -> int:
        return self._seen.get["rows"]

    @property
    def nulls(self) -> dict[str, int]:
        found = self._seen.get
        return {c: found[f"null_{k}"] for k, c in enumerate(self._columns)}

    @property
    def failures(self) -> dict[str, int]:
        found = self._seen.get
        return {c: found[f"broken_{k}"] for k, c in enumerate(self._flags)}
