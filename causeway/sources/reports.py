"""Small results as Markdown tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

MOST_ROWS = 10_000


def to_markdown(df: DataFrame, formats: Mapping[str, str] | None = None, flag: Callable[[dict], bool] | None = None) -> str:
    """A pipe table of a small DataFrame: missing values blank, numbers by formats (or shortly), flagged rows marked with ` !`. Over MOST_ROWS rows it refuses."""
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report has {MOST_ROWS} rows at most")

    def cell(name: str, v) -> str:
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        if formats and name in formats:
            return format(v, formats[name])
        return f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")

    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    for r in rows:
        cells = [cell(c, r[c]) for c in df.columns]
        if flag and flag(r.asDict()):
            cells[-1] += " !"
        lines.append("| " + " | ".join(cells) + " |")
    return "\n".join(lines) + "\n"
