"""Reports as one HTML page: tables and small line charts, without anything from outside."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame, SparkSession

STYLE = "body{font:14px sans-serif;margin:2em;max-width:70em}table{border-collapse:collapse;margin:1em 0}td,th{border:1px solid #ccc;padding:.3em .6em;text-align:right}td:first-child,th:first-child{text-align:left}svg{background:#fafafa}"
#: Rows of a table that a page shows.
ROWS = 200


def cell(v) -> str:
    return "" if v is None else f"{v:.4g}" if isinstance(v, float) else escape(str(v))


def table(title: str, columns: list[str], rows: list) -> str:
    head = "".join(f"<th>{escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows)
    return f"<h2>{escape(title)}</h2><table><tr>{head}</tr>{body}</table>"


def frame(title: str, df: DataFrame) -> str:
    return table(title, df.columns, [tuple(r) for r in df.limit(ROWS).collect()])


def chart(title: str, lines: dict[str, list[float]], width: int = 640, height: int = 200) -> str:
    values = [v for line in lines.values() for v in line if v is not None]
    if not values:
        return ""
    low, high = min(values), max(values)
    scale = (high - low) or 1.0
    out = []
    for k, (name, line) in enumerate(lines.items()):
        step = width / max(1, len(line) - 1)
        points = " ".join(f"{i * step:.1f},{height - (v - low) / scale * height:.1f}" for i, v in enumerate(line) if v is not None)
        out.append(f'<polyline fill="none" stroke="hsl({k * 77 % 360},60%,40%)" points="{points}"><title>{escape(name)}</title></polyline>')
    return f'<h2>{escape(title)}</h2><svg width="{width}" height="{height}" role="img">{"".join(out)}</svg>'


def page(title: str, parts: list[str]) -> str:
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{escape(title)}</title><style>{STYLE}</style></head><body><h1>{escape(title)}</h1>{"".join(parts)}</body></html>'


def tabular_report(run) -> str:
    """The page of a finished TabularRun."""
    mean = lambda s: sum(s) / len(s)
    board = sorted(((n, mean(s), min(s), max(s)) for n, s in run.scores.items()), key=lambda r: -r[1])
    parts = [
        table("Decisions", ["stage", "decision"], [(d["stage"], d["decision"]) for d in run.log]),
        table("Profile", ["feature", "dtype", "missing %", "distinct", "flags"], [(r["feature"], r["dtype"], r["missing_pct"], r["n_unique"], ", ".join(r["flags"])) for r in run.profile]),
        table("Models on fresh folds", ["model", "score", "lowest", "highest"], board),
        table("Holdout", ["metric", "value"], list(run.result.items())),
    ]
    if run.importance:
        parts.append(table("Loss of score when a column is dealt anew", ["feature", "importance"], run.importance))
    if run.linear:
        parts.append(table("Mean absolute contribution to the linear model", ["feature", "contribution"], run.linear))
    parts += [chart(f"Mean prediction over {f}", {f: [y for _, y in points]}) for f, points in run.dependence.items()]
    if run.leaks is not None:
        parts.insert(2, frame("Leak scan", run.leaks))
    return page(f"{run.task} of {run.spec.target}", parts)


def forecast_report(run, forecast: DataFrame) -> str:
    """The page of a finished ForecastRun; the chart shows the first series."""
    rows = forecast.orderBy("series", "step").limit(ROWS).collect()
    first = [r for r in rows if rows and r.series == rows[0].series]
    parts = [
        table("Decisions", ["stage", "decision"], [(d["stage"], d["decision"]) for d in run.log]),
        frame("Models over the backtest", run.board),
        frame("Half-widths by step", run.widths),
        chart(f"Forecast of {first[0].series}" if first else "", {"lo": [r.lo for r in first], "yhat": [r.yhat for r in first], "hi": [r.hi for r in first]}),
        table("Forecast", forecast.columns, [tuple(r) for r in rows]),
    ]
    return page("Forecast", parts)


def save(spark: SparkSession, text: str, path: str) -> None:
    """The page as a text file in a folder of any store."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
