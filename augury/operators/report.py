"""A self-contained HTML report of paper trades, from aggregates."""

from __future__ import annotations

from html import escape
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.operators import metrics, ordering

WIDTH, HEIGHT, PAD = 800, 200, 40
#: Points of a thinned curve, at most: the last value of each of so many runs.
POINTS = 2000
#: Columns of the picture, one for each pixel.
COLUMNS = WIDTH - 2 * PAD
#: Rows of the page's tables, at most.
SEGMENTS, LATEST = 1000, 200


ORDER = ["recorded_at", "city_or_segment", "target_date", "horizon"]


def _curve(trades: DataFrame) -> DataFrame:
    """Settled trades with __rank, __n (all of them) and cumulative_pnl along recorded_at, in runs of equal length."""
    t = trades.filter("realized_pnl is not null").withColumn("recorded_at", F.coalesce("recorded_at", F.lit("")))
    ranked = ordering.ranked(t, ORDER).withColumn("__run_", F.expr(f"__rank div {ordering.PART_ROWS}"))
    curve = metrics.curve_of_groups(ranked, ["__rank"], "__run_")  # no run is long
    return curve.crossJoin(F.broadcast(ranked.agg(F.count("*").alias("__n"))))  # one row


def curve_points(trades: DataFrame, points: int = POINTS) -> list[float]:
    """Cumulative profit of settled trades by recorded_at.

    Of more than ``points`` trades, the last value of each of so many runs of equal length
    (of the ranks inside all trades) is given, so that the curve ends where the trades do.
    """
    run = F.expr(f"__rank * least(__n, {points}L) div __n")
    drawn = _curve(trades).groupBy(run.alias("run")).agg(F.max_by("cumulative_pnl", "__rank").alias("last"))
    return [r[0] for r in drawn.orderBy("run").select("last").collect()]  # at most ``points``


def curve_extremes(trades: DataFrame, columns: int = COLUMNS) -> DataFrame:
    """The curve for a picture of so many columns: rank, cumulative_pnl and n of the first, last, least and greatest trade of each.

    A line through these points covers the same pixels as one through all trades: no peak
    is lost.  Of equal values the earliest counts.
    """
    v = F.struct(F.col("cumulative_pnl").alias("v"), F.col("__rank").alias("at"))
    late = F.struct(F.col("cumulative_pnl").alias("v"), (-F.col("__rank")).alias("at"))
    step = F.expr(f"__rank * {columns}L div __n")
    least, most = F.min(v), F.max(late)
    cells = _curve(trades).groupBy(step.alias("column"), F.col("__n").alias("n")).agg(
        F.array(
            F.struct(F.min("__rank").alias("rank"), F.min_by("cumulative_pnl", "__rank").alias("value")), F.struct(F.max("__rank").alias("rank"), F.max_by("cumulative_pnl", "__rank").alias("value")),
            F.struct(least["at"].alias("rank"), least["v"].alias("value")), F.struct((-most["at"]).alias("rank"), most["v"].alias("value")),
        ).alias("points")
    )
    return cells.select("column", "n", F.inline(F.array_distinct("points"))).withColumnRenamed("value", "cumulative_pnl")


def svg(points: list[tuple[float, float]]) -> str:
    """A line through (place from 0 to 1, value)."""
    if not points:
        return ""
    lo, hi = min(v for _, v in points), max(v for _, v in points)
    lo, hi = (lo - 1, hi + 1) if lo == hi else (lo, hi)
    sx, sy = WIDTH - 2 * PAD, (HEIGHT - 2 * PAD) / (hi - lo)
    line = " ".join(f"{PAD + x * sx:.1f},{HEIGHT - PAD - (v - lo) * sy:.1f}" for x, v in points)
    return f'<svg viewBox="0 0 {WIDTH} {HEIGHT}"><polyline fill="none" stroke="#2563eb" stroke-width="2" points="{line}"/></svg>'


def dollars(x: float) -> str:
    return f"{'-' if x < 0 else '+'}${abs(x):.2f}"


def write_report(trades: DataFrame, path: str, title: str = "Paper trades", brier: float | None = None) -> Path:
    """Figures, equity curve, segments and the latest trades; texts are escaped.

    The page lists ``SEGMENTS`` segments and ``LATEST`` trades and says how many more there are.
    """
    k = metrics.report_kpis(trades).first()
    by_segment = metrics.report_segments(trades)
    segments = by_segment.orderBy(F.desc("n"), "segment").limit(SEGMENTS).collect()
    n_segments, n_trades = by_segment.count(), trades.count()
    latest = trades.orderBy(F.desc("recorded_at"), "city_or_segment", "target_date", "horizon").limit(LATEST).collect()
    cards = {"Total P&L": dollars(k.total_pnl), "Hit rate": f"{k.hit_pct:.1f}%", "ROI": f"{k.roi_pct:+.1f}%", "Average edge": f"{k.avg_edge:.3f}", "Settled": str(k.n_settled)}
    if brier is not None:
        cards["Brier score"] = f"{brier:.4f}"
    # at most four points a column
    curve = [(r.rank / max(r.n - 1, 1), r.cumulative_pnl) for r in curve_extremes(trades).orderBy("rank").collect()]
    rest = lambda n, what: f"<p>and {n} {what}</p>" if n > 0 else ""
    row = lambda cells, tag="td": "<tr>" + "".join(f"<{tag}>{escape(str(x))}</{tag}>" for x in cells) + "</tr>"
    body = [
        f"<h1>{escape(title)}</h1>",
        "".join(f"<div class=card><b>{escape(a)}</b><br>{escape(b)}</div>" for a, b in cards.items()),
        svg(curve),
        "<h2>Segments</h2><table>" + row(["Segment", "Trades", "P&L", "Hit"], "th") + "".join(row([s.segment, s.n, dollars(s.total_pnl), f"{s.hit_pct:.1f}%"]) for s in segments) + "</table>" + rest(n_segments - len(segments), "segments with fewer trades"),
        "<h2>Trades</h2><table>"
        + row(["Recorded", "Segment", "Date", "Outcome", "Price", "Edge", "Result", "P&L"], "th")
        + "".join(row([t.recorded_at, t.city_or_segment, t.target_date, t.outcome_label, f"{t.gamma_price or 0:.3f}", f"{t.edge_after_fee or 0:.3f}", t.outcome or "open", "" if t.realized_pnl is None else dollars(t.realized_pnl)]) for t in latest)
        + "</table>"
        + rest(n_trades - len(latest), "older trades"),
    ]
    style = "body{font-family:sans-serif;max-width:60rem;margin:auto}.card{display:inline-block;padding:1rem}table{border-collapse:collapse}td,th{padding:.2rem .6rem;text-align:left}"
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(title)}</title><style>{style}</style></head><body>{''.join(body)}</body></html>", encoding="utf-8")
    return out
