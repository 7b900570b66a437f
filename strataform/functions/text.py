"""Texts for people, made on the driver from a few rows of a report."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

HEADLINES = {"DeviationFromExpectation": "Out of step with its siblings", "ZScoreOutlier": "Unusual against history", "EwmaTrendShift": "Sudden change", "SimpsonsParadox": "Totals hide the parts"}


def percent(x: float, digits: int = 1) -> str:
    return f"{x * 100:,.{digits}f} %"


def signed(x: float) -> str:
    return f"{x * 100:+.1f}%" if round(x, 12) else "0.0%"


def count(x: float) -> str:
    return f"{round(x):,}"


def split_cell(cell: str) -> tuple[str, str]:
    """Dimension and key of a cell id, the key without its window."""
    dimension, colon, key = cell.partition(":")
    if not colon or not dimension:
        dimension, key = "", cell
    return dimension, key.partition("@")[0] or key


def place(cell: str) -> str:
    dimension, key = split_cell(cell)
    if dimension == "hod" and key.isdigit() and int(key) < 24:
        return f"hour {int(key):02d}:00-{int(key):02d}:59"
    return f"{dimension.replace('_', ' ').title()} {key}".strip()


def headline(kind: str) -> str:
    return HEADLINES.get(kind, "Worth a look")


def alert_body(kind: str, cell: str, score: float) -> str:
    """Two sentences for an alert."""
    size = "far" if score >= 5 else "clearly" if score >= 2 else "slightly"
    why = {"DeviationFromExpectation": f"It is {size} from the mean of its dimension", "ZScoreOutlier": f"It is {size} outside what the snapshot before had", "EwmaTrendShift": f"It left its smoothed course by {score:,.1f}", "SimpsonsParadox": "Its parts move one way and the total the other"}
    return f"{headline(kind)}: {place(cell)}. {why.get(kind, f'It scores {score:.2f}')}."


def trend_text(cell: str, before: float, now: float) -> str:
    if before == now:
        return f"{place(cell)} holds at {count(now)}."
    change = f" ({signed((now - before) / before)})" if before else ""
    return f"{place(cell)} went {'up' if now > before else 'down'} from {count(before)} to {count(now)}{change}."


def narrate(tell, prompt: str, allowed: Iterable[float], fallback: str) -> str:
    """What a narrator tells, if every number in it is grounded; else the fallback."""
    try:
        told = tell(prompt)
    except Exception:  # noqa: BLE001  a report never fails for want of prose
        return fallback
    return told if told and is_grounded(told, list(allowed)) else fallback


def executive_summary(leaders: Sequence[tuple[str, float]], insights: Sequence[tuple[str, str, float]], rates: dict[str, float], paradoxes: int = 0) -> str:
    """leaders: cell id and count; insights: kind, cell id, score; rates: signal rate by cell id."""
    if not leaders:
        return "No events yet."
    parts = ["Most events: " + " and ".join(f"{place(c)} ({count(n)})" for c, n in leaders[:2]) + "."]
    if insights:
        kind, cell, score = max(insights, key=lambda x: x[2])
        parts.append(f"{headline(kind)}: {place(cell)} (score {score:.2f}).")
    else:
        parts.append("No cell stands out.")
    if paradoxes:
        parts.append("An overall rate moved against all of its parts: the mix changed, not the parts.")
    if rates:
        cell, low = min(rates.items(), key=lambda x: (x[1], x[0]))
        parts.append(f"Lowest signal rate: {place(cell)} at {percent(low, 0)}.")
    return " ".join(parts)


def shape_summary(mean: float, median: float, p95: float, heavy_tail: bool, misleading: bool) -> str:
    tail = f" A long tail lifts the mean to {mean:.0f}; go by the 95th percentile." if heavy_tail else " Mean and median differ; the mean misleads." if misleading else " The spread is even."
    return f"Half are below {median:.0f}, 95 % below {p95:.0f}.{tail}"


def insight_prompt(cells: Iterable[tuple[str, float]], insights: Iterable[tuple[str, str, float]]) -> tuple[str, list[float]]:
    """A grounding prompt and the numbers that an answer may use."""
    cells, insights = list(cells)[:12], list(insights)
    lines = ["Use these figures and no others.", *(f"{c}: {n:g}" for c, n in cells), *(f"{k} at {c}: {s:.3f}" for k, c, s in insights)]
    return "\n".join(lines), [n for _, n in cells] + [s for *_, s in insights]


def is_grounded(text: str, allowed: Iterable[float]) -> bool:
    """Whether each number in the text is within 1 % (of at least 1) of an allowed value or of 100 times one."""
    import re

    allowed = [y for x in allowed for y in (x, 100 * x)]
    within = lambda n, i: abs(n - allowed[i]) <= 0.01 * max(1.0, abs(allowed[i - i % 2]))
    return all(any(within(float(n), i) for i in range(len(allowed))) for n in re.findall(r"\d+(?:\.\d+)?", text))


def report_markdown(parts: dict[str, DataFrame], subject: str = "campaign") -> str:
    """A campaign report; every table that is read is of bounded size."""
    t, g, h = parts["totals"].first(), parts["grade"].first(), parts["hours"].first()
    lines = [
        f"# Campaign audit: {subject}", "", f"Grade {g.grade}: {percent(t.delivery_rate)} delivered of {count(t.attempted)} attempted ({count(t.sent)} sent, {count(t.cancelled)} cancelled).",
        f"Dominant reason: {t.dominant_reason} ({count(t.failed)} failed; {percent(g.concentration)} of them in one segment).", "", "## Segments", "", "| board | segment | value |", "|-|-|-|",
        *(f"| {r.board} | {r.key} | {percent(r.score) if r.board != 'top_failed' else count(r.score)} |" for r in parts["leaderboard"].collect()), "", "## Reasons", "",
        *(f"- {r.reason}: {r.key} at {percent(r.rate)}" for r in parts["reasons"].orderBy("reason").collect()), "", "## Anomalies", "",
        *(f"- {r.dimension} {r.cell_key}, {r.metric}: {signed(r.deviation)} over {count(r.sent)} sent" for r in parts["anomalies"].collect()), "",
        f"Best hour {h.best_hour} ({percent(h.best_rate or 0)}), worst {h.worst_hour} ({percent(h.worst_rate or 0)}).",
    ]
    return "\n".join(lines) + "\n"


def write_report(spark: SparkSession, text: str, path: str) -> None:
    """A report as one file, wherever Spark writes to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
