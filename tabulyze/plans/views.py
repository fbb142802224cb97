"""The series behind the chart types, chosen by name, and the view recommender."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tabulyze.functions.columns import (
    CATEGORICAL, DATETIME, NUMERICAL, col, column_types, complete_rows, free_name,
)
from tabulyze.operators.correlation import correlation_matrix
from tabulyze.operators.distribution import box_stats, density_curve, histogram
from tabulyze.operators.ranking import category_series, category_share
from tabulyze.operators.scatter import scatter_points
from tabulyze.operators.trend import scatter_trendline, time_series

View = Callable[..., DataFrame]

FEW_CATEGORIES = 10

# The reasons the reference gives for each kind of view.
REASONS = {
    "time_series": "Detected date and numerical columns - perfect for trend analysis",
    "correlation": "Found {n} numerical columns - great for correlation analysis",
    "category": 'Found categorical column "{column}" with {n} categories',
    "distribution": "Numerical data available - useful for understanding value distribution",
    "scatter": "Multiple numerical columns - explore relationships between variables",
}
VIEW_SCHEMA = "rank int, type string, priority string, reason string, params map<string,string>"


def distribution_view(
    df: DataFrame, column: str, plot_type: str = "histogram", bins: int = 30
) -> DataFrame:
    if plot_type == "histogram":
        return histogram(df, column, bins)
    if plot_type == "box":
        return box_stats(df, column)
    if plot_type == "violin":
        return density_curve(df, column)
    raise ValueError(f"Unsupported plot type: {plot_type}")


def category_view(
    df: DataFrame,
    column: str,
    value_column: str | None = None,
    plot_type: str = "bar",
    aggregation: str = "count",
    top_n: int | None = None,
) -> DataFrame:
    if plot_type == "bar":
        return category_series(df, column, value_column, aggregation, top_n)
    if plot_type == "pie":
        return category_share(df, column, value_column, aggregation, top_n)
    raise ValueError(f"Unsupported plot type: {plot_type}")


def scatter_view(
    df: DataFrame,
    x_column: str,
    y_column: str,
    color_column: str | None = None,
    size_column: str | None = None,
    show_trend: bool = False,
) -> DataFrame:
    if show_trend and not (color_column or size_column):
        return scatter_trendline(df, x_column, y_column)
    points = scatter_points(df, x_column, y_column, color_column, size_column)
    return scatter_trendline_over(points, x_column, y_column) if show_trend else points


def scatter_trendline_over(points: DataFrame, x_column: str, y_column: str) -> DataFrame:
    """Fitted values on points that carry further columns, none of which is replaced."""
    x, y = col(x_column).cast("double"), col(y_column).cast("double")
    slope, intercept = points.agg(F.regr_slope(y, x), F.regr_intercept(y, x)).first()
    return points.withColumn(
        free_name("fitted", points.columns),
        F.lit(intercept).cast("double") + F.lit(slope).cast("double") * x,
    )


class ViewRegistry:
    """Chart series by name, each with the parameters it cannot do without."""

    def __init__(self) -> None:
        self.views: dict[str, tuple[View, list[str]]] = {
            "time_series": (time_series, ["date_column", "value_column"]),
            "distribution": (distribution_view, ["column"]),
            "category": (category_view, ["column"]),
            "scatter": (scatter_view, ["x_column", "y_column"]),
            "correlation": (correlation_matrix, []),
        }

    def register(self, name: str, view: View, required: list[str] | None = None) -> None:
        self.views[name] = (view, list(required or []))

    def available(self) -> list[str]:
        return list(self.views)

    def _find(self, name: str) -> tuple[View, list[str]]:
        if name not in self.views:
            raise ValueError(
                f"Unsupported visualization type: {name}. Available types: {self.available()}"
            )
        return self.views[name]

    def required_params(self, name: str) -> list[str]:
        return self._find(name)[1]

    def create(self, name: str, df: DataFrame, **options) -> DataFrame:
        return self._find(name)[0](df, **options)


views = ViewRegistry()


def recommend_views(df: DataFrame) -> DataFrame:
    """Views that suit the column roles, high priority first: `rank`, `type`, `priority`,
    `reason`, `params`.

    Only the first text column is read, and no further than one value past the limit.
    """
    roles = column_types(df)
    numeric, text, dates = roles[NUMERICAL], roles[CATEGORICAL], roles[DATETIME]
    found: list[tuple[str, str, str, dict[str, str]]] = []
    if dates and numeric:
        found.append((
            "time_series", "high",
            REASONS["time_series"],
            {"date_column": dates[0], "value_column": numeric[0], "aggregation": "sum"},
        ))
    if len(numeric) >= 3:
        found.append((
            "correlation", "high",
            REASONS["correlation"].format(n=len(numeric)), {},
        ))
    if text:
        values = complete_rows(df.select(col(text[0]))).distinct()
        distinct = values.limit(FEW_CATEGORIES + 1).count()
        if distinct <= FEW_CATEGORIES:
            found.append((
                "category", "high",
                REASONS["category"].format(column=text[0], n=distinct),
                {"column": text[0], "plot_type": "bar"},
            ))
    if numeric:
        found.append((
            "distribution", "medium",
            REASONS["distribution"],
            {"column": numeric[0], "plot_type": "histogram"},
        ))
    if len(numeric) >= 2:
        found.append((
            "scatter", "medium",
            REASONS["scatter"],
            {"x_column": numeric[0], "y_column": numeric[1]},
        ))
    ordered = sorted(found, key=lambda v: ("high", "medium", "low").index(v[1]))
    rows = [(i + 1, *v) for i, v in enumerate(ordered)]
    return df.sparkSession.createDataFrame(rows, VIEW_SCHEMA)
