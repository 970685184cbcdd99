"""CSV export of plans."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def export_cells(plan: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Chosen columns under their labels as text: null is empty, booleans are Yes or No,
    whole numbers have no decimals."""

    def cell(name: str) -> Column:
        kind, c = plan.schema[name].dataType, F.col(name)
        if isinstance(kind, T.BooleanType):
            text = F.when(c, "Yes").otherwise("No")
            text = F.when(c.isNull(), "").otherwise(text)
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
            text = F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
        else:
            text = c.cast("string")
        return F.coalesce(text, F.lit("")).alias(columns[name])

    return plan.select(*[cell(c) for c in columns])


def export_plan_csv(plan: DataFrame, columns: Mapping[str, str], path: str) -> None:
    """Write the plan in its row order; quoted only where needed, quotes doubled."""
    (export_cells(plan, columns).write.mode("overwrite")
     .option("header", True).option("quote", '"').option("escape", '"')
     .option("emptyValue", "").option("nullValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))
