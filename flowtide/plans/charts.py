"""Charts as inline SVG from small aggregates."""

from __future__ import annotations

import html
from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta

COLOURS = ["#4a6fa5", "#c8553d", "#588b8b", "#e0a030", "#7a5195", "#8d99ae"]
WIDTH, HEIGHT, PAD = 720, 180, 8


def figure(title: str, body: str, height: int = HEIGHT, legend: Sequence[str] = ()) -> str:
    """One figure on one line, so that the Markdown report can leave it out."""
    marks = "".join(f'<text x="{4 + 150 * i}" y="{height + 14}" font-size="11" fill="{COLOURS[i % len(COLOURS)]}">{html.escape(str(n))}</text>' for i, n in enumerate(legend))
    tall = height + (18 if legend else 0)
    return f'<figure><figcaption>{html.escape(title)}</figcaption><svg viewBox="0 0 {WIDTH} {tall}" width="{WIDTH}" height="{tall}">{body}{marks}</svg></figure>'


def _scale(values: Sequence[float], size: float, flip: bool = False) -> dict[float, float]:
    lo, hi = min(values, default=0.0), max(values, default=1.0)
    at = lambda v: PAD + (v - lo) / ((hi - lo) or 1.0) * (size - 2 * PAD)
    return {v: size - at(v) if flip else at(v) for v in values}


@dataclass(frozen=True)
class Backdrop:
    """What lies behind bars over time: annotated spans (start, end, opacity), and where periods start."""

    spans: Sequence[tuple[datetime, datetime, float]] = ()
    marks: Sequence[tuple[str, datetime]] = ()

    def draw(self, buckets: Sequence[date], step: float) -> str:
        """Spans cover each bucket that they touch; a bucket lasts as long as the shortest distance of two, or a day."""
        at = [b if isinstance(b, datetime) else datetime.combine(b, time()) for b in buckets]
        long = min((b - a for a, b in zip(at, at[1:], strict=False)), default=timedelta(days=1))
        out = []
        for start, end, opacity in self.spans:
            hit = [i for i, t in enumerate(at) if t < end and t + long > start]
            if hit:
                out.append(f'<rect class="span" x="{hit[0] * step:.1f}" y="0" width="{(hit[-1] + 1 - hit[0]) * step:.1f}" height="{HEIGHT}" fill="#999999" fill-opacity="{opacity}"/>')
        for name, start in self.marks:
            if at and at[0] <= start < at[-1] + long:
                x = bisect_left(at, start) * step
                out.append(f'<line class="mark" x1="{x:.1f}" y1="0" x2="{x:.1f}" y2="{HEIGHT}" stroke="#333333" stroke-dasharray="4 3"/><text x="{x + 3:.1f}" y="10" font-size="10">{html.escape(name)}</text>')
        return "".join(out)


def bars(values: Sequence[tuple[object, float]], title: str, behind: Backdrop | None = None) -> str:
    """Bars in the given order; with a backdrop the buckets are dates or times in order."""
    return stacked([(n, "", v) for n, v in values], title, behind)


def stacked(cells: Sequence[tuple[object, str, float]], title: str, behind: Backdrop | None = None) -> str:
    """Stacked bars of (bucket, series, value)."""
    buckets, series = list(dict.fromkeys(c[0] for c in cells)), list(dict.fromkeys(c[1] for c in cells))
    sums: dict[object, float] = {}
    for b, _, v in cells:
        sums[b] = sums.get(b, 0.0) + v
    most, step = max(sums.values(), default=0.0) or 1.0, WIDTH / max(1, len(buckets))
    base, out = dict.fromkeys(buckets, 0.0), [behind.draw(buckets, step)] if behind else []
    for b, s, v in cells:
        tall = v / most * HEIGHT
        base[b] += tall
        out.append(f'<rect x="{buckets.index(b) * step:.1f}" y="{HEIGHT - base[b]:.1f}" width="{max(1.0, step - 1):.1f}" height="{tall:.1f}" fill="{COLOURS[series.index(s) % len(COLOURS)]}"><title>{html.escape(f"{b} {s}: {v:g}")}</title></rect>')
    return figure(title, "".join(out), legend=[s for s in series if s])


def lines(points: Sequence[tuple[str, float, float]], title: str) -> str:
    """Lines of (series, x, y)."""
    series = list(dict.fromkeys(p[0] for p in points))
    xs, ys = _scale([p[1] for p in points], WIDTH), _scale([p[2] for p in points], HEIGHT, flip=True)
    out = []
    for i, s in enumerate(series):
        path = " ".join(f"{xs[x]:.1f},{ys[y]:.1f}" for n, x, y in sorted(points) if n == s)
        out.append(f'<polyline points="{path}" fill="none" stroke="{COLOURS[i % len(COLOURS)]}"/>')
    return figure(title, "".join(out), legend=series)


def heatmap(cells: Sequence[tuple[str, object, float]], title: str) -> str:
    """A row for each name and a column for each bucket; darker is higher."""
    names, buckets = list(dict.fromkeys(c[0] for c in cells)), sorted({c[1] for c in cells})
    step, tall = (WIDTH - 120) / max(1, len(buckets)), 14
    out = [f'<text x="0" y="{i * tall + 11}" font-size="10">{html.escape(str(n))}</text>' for i, n in enumerate(names)]
    out += [f'<rect x="{120 + buckets.index(b) * step:.1f}" y="{names.index(n) * tall}" width="{step:.1f}" height="{tall - 1}" fill="{COLOURS[1]}" fill-opacity="{max(0.0, min(1.0, v)) ** 8:.3f}"><title>{html.escape(f"{n} {b}: {v:.4f}")}</title></rect>' for n, b, v in cells]
    return figure(title, "".join(out), max(tall, tall * len(names)))


def hexagons(cells: Sequence[tuple[float, float, float]], title: str) -> str:
    """Points of (x, y, count) whose opacity follows the count's share of the largest."""
    xs, ys = _scale([c[0] for c in cells], WIDTH), _scale([c[1] for c in cells], HEIGHT, flip=True)
    most = max((c[2] for c in cells), default=1.0)
    out = "".join(f'<circle cx="{xs[x]:.1f}" cy="{ys[y]:.1f}" r="4" fill="{COLOURS[0]}" fill-opacity="{0.15 + 0.85 * (n / most) ** 0.25:.2f}"><title>{n:g}</title></circle>' for x, y, n in cells)
    return figure(title, out)
