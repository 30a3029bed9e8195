"""What an experiment leaves: CSV files, SVG charts and a Markdown report."""

from __future__ import annotations

import math
from dataclasses import asdict
from html import escape
from pathlib import Path

from ripplecast import harness
from ripplecast.experiments import Results, claims

COLOURS = ("#1f5fa8", "#c8501e", "#2e7d4f", "#8a4fa3", "#7a6a2f", "#5b6770")
POINTS = ["method", "k", "spread", "sd", "seconds", "n"]
GRID = ["value", "spread", "fit_seconds", "select_seconds", "n_runs", "n_communities", "pp_max", "degenerate", "status"]


def ticks(low: float, high: float, about: int = 5) -> list[float]:
    """Round steps of 1, 2 or 5 times a power of ten that span low to high."""
    if high <= low:
        return [low]
    raw = (high - low) / about
    unit = 10.0 ** math.floor(math.log10(raw))
    step = next(unit * m for m in (1, 2, 5, 10) if unit * m >= raw * 0.999)
    first = math.floor(low / step)
    return [step * k for k in range(first, math.ceil(high / step) + 1)]


def line_chart(title: str, x_name: str, y_name: str, series: dict[str, list[tuple[float, float]]], log_y: bool = False, size: tuple[int, int] = (640, 400)) -> str:
    """A standalone SVG; points that are not finite, or not positive on a log axis, are left out and counted."""
    fits = lambda p: p[0] is not None and p[1] is not None and math.isfinite(p[0]) and math.isfinite(p[1]) and (p[1] > 0 or not log_y)
    kept = {n: sorted(p for p in points if fits(p)) for n, points in series.items()}
    dropped = sum(map(len, series.values())) - sum(map(len, kept.values()))
    width, height = size
    left, right, top, bottom = 70, width - 150, 50, height - 50
    scale = math.log10 if log_y else float
    points = [p for ps in kept.values() for p in ps]
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="11">', f'<text x="{left}" y="20" font-size="14">{escape(title)}</text>']
    if dropped:
        out.append(f'<text x="{left}" y="36" fill="#666">{dropped} points left out</text>')
    if points:
        xs, ys = [p[0] for p in points], [scale(p[1]) for p in points]
        y_ticks = [float(k) for k in range(math.floor(min(ys)), math.ceil(max(ys)) + 1)] if log_y else ticks(min(0.0, min(ys)), max(ys))
        x_low, x_high, y_low, y_high = min(xs), max(xs), min([*y_ticks, *ys]), max([*y_ticks, *ys])
        at_x = lambda x: left + (right - left) * ((x - x_low) / (x_high - x_low) if x_high > x_low else 0.5)
        at_y = lambda y: bottom - (bottom - top) * ((y - y_low) / (y_high - y_low) if y_high > y_low else 0.5)
        for y in y_ticks:
            out.append(f'<line x1="{left}" x2="{right}" y1="{at_y(y):.1f}" y2="{at_y(y):.1f}" stroke="#ddd"/><text x="{left - 6}" y="{at_y(y) + 4:.1f}" text-anchor="end">{10.0**y if log_y else y:.4g}</text>')
        for x in sorted(set(xs)):
            out.append(f'<text x="{at_x(x):.1f}" y="{bottom + 16}" text-anchor="middle">{x:g}</text>')
        for k, (name, ps) in enumerate(kept.items()):
            colour = COLOURS[k % len(COLOURS)]
            where = [(at_x(x), at_y(scale(y))) for x, y in ps]
            out.append(f'<polyline fill="none" stroke="{colour}" stroke-width="2" points="{" ".join(f"{x:.1f},{y:.1f}" for x, y in where)}"/>')
            out += [f'<circle cx="{x:.1f}" cy="{y:.1f}" r="3" fill="{colour}"/>' for x, y in where]
            out.append(f'<text x="{right + 10}" y="{top + 16 * k + 10}" fill="{colour}">{escape(name)}</text>')
    out.append(f'<text x="{(left + right) / 2:.0f}" y="{height - 12}" text-anchor="middle">{escape(x_name)}</text><text x="16" y="{(top + bottom) / 2:.0f}" transform="rotate(-90 16 {(top + bottom) / 2:.0f})" text-anchor="middle">{escape(y_name)}</text></svg>')
    return "\n".join(out)


def comparison(title: str, produced: dict[str, float], wanted: dict[str, float]) -> str:
    """Counts against targets with the percentage reached; a target without a count is left blank."""
    rows = [[n, produced.get(n), w, f"{100 * produced[n] / w:.1f}%" if w and produced.get(n) is not None else ""] for n, w in wanted.items()]
    return f"### {title}\n\n" + harness.ascii_table(["", "produced", "target", "reached"], rows)


def csv_text(header: list[str], rows: list[list]) -> str:
    cell = lambda x: "" if x is None else repr(x) if isinstance(x, float) else str(x)
    quoted = lambda x: '"' + x.replace('"', '""') + '"' if any(c in x for c in ',"\n') else x
    return "".join(",".join(quoted(cell(x)) for x in row) + "\n" for row in [header, *rows])


def report(results: Results, files: list[str]) -> str:
    """Markdown: configuration, dataset, seconds, diagnostics, sweeps, claims, notes, files."""
    parts = ["# Influence experiment"]

    def section(title: str, header: list[str], rows: list[list]) -> None:
        if rows:
            parts.append(f"## {title}\n\n" + harness.ascii_table(header, rows))

    section("Configuration", ["parameter", "value"], [[n, str(v)] for n, v in asdict(results.config).items() if n != "notes"])
    section("Dataset", ["", "value"], [[n, str(v)] for n, v in results.dataset.items()])
    section("Preparation", ["step", "seconds"], [[n, s] for n, s in results.seconds.items()])
    section("Model", ["", "value"], [[n, str(v)] for n, v in results.diagnostics.items()])
    if results.points is not None:
        section("Spread by number of seeds", POINTS, [[r[c] for c in POINTS] for r in harness.summary(results.points).orderBy("method", "k").collect()])
        section("Failures", ["method", "k", "item", "status"], [[r.method, r.k, r.item, r.status] for r in results.points.where("status <> 'ok'").collect()])
    for name, grid in results.grids.items():
        section(f"Spread by {name}", GRID, [[r[c] for c in GRID] for r in grid.orderBy("value").collect()])
    judged = claims(results)
    section("Claims", ["", "claim", "verdict", "detail"], [[c.key, c.text, {True: "holds", False: "does not hold", None: "not judged"}[c.holds], c.detail] for c in judged])
    notes = list(results.config.notes)
    if results.diagnostics.get("degenerate"):
        notes.append("no weight reaches h: every method's spread is its number of seeds")
    for title, lines in (("Notes", notes), ("Files", files)):
        if lines:
            parts.append(f"## {title}\n\n" + "\n".join(f"* {x}" for x in lines))
    return "\n\n".join(parts) + "\n"


def write(results: Results, folder: str) -> list[str]:
    """points.csv, sweep_Z.csv, sweep_C.csv, their charts and report.md in folder, on the driver; the names written."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    files: list[str] = []

    def put(name: str, text: str) -> None:
        (out / name).write_text(text)
        files.append(name)

    if results.points is not None:
        rows = harness.summary(results.points).orderBy("method", "k").collect()
        put("points.csv", csv_text(POINTS, [[r[c] for c in POINTS] for r in rows]))
        by = lambda column: {m: [(r.k, r[column]) for r in rows if r.method == m] for m in results.config.methods}
        put("spread.svg", line_chart("Spread", "seeds", "spread", by("spread")))
        put("seconds.svg", line_chart("Selection", "seeds", "seconds", by("seconds"), log_y=True))
    for name, grid in results.grids.items():
        rows = grid.orderBy("value").collect()
        put(f"sweep_{name}.csv", csv_text([name, *GRID[1:]], [[r[c] for c in GRID] for r in rows]))
        put(f"sweep_{name}.svg", line_chart(f"Spread by {name}", name, "spread", {"spread": [(r.value, r.spread) for r in rows]}))
    put("report.md", report(results, [*files, "report.md"]))
    return files
