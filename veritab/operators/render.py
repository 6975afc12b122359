"""Fourteen kinds of charts as SVG, from the small frames that ``charts`` prepares.

A drawing is a list of elements inside one frame with scales for both axes; all text is escaped, and each mark has a title with its value.
"""

from __future__ import annotations

import html
import math
from collections.abc import Callable
from dataclasses import dataclass, field

WIDTH, HEIGHT, TOP, BOTTOM, LEFT, RIGHT = 640, 360, 40, 60, 60, 20
COLORS = ("#3b6ea5", "#c8643c", "#5a9367", "#8a6fb0", "#b0893b", "#5b8fa8", "#a8556e", "#7a7a7a")


@dataclass
class Canvas:
    title: str
    parts: list[str] = field(default_factory=list)

    def add(self, tag: str, title: str | None = None, **attributes) -> None:
        own = " ".join(f'{k.replace("_", "-")}="{html.escape(f"{v:.2f}" if isinstance(v, float) else str(v))}"' for k, v in attributes.items())
        self.parts.append(f"<{tag} {own}/>" if title is None else f"<{tag} {own}><title>{html.escape(title)}</title></{tag}>")

    def text(self, x: float, y: float, words: str, anchor: str = "middle", size: int = 10) -> None:
        self.parts.append(f'<text x="{x:.2f}" y="{y:.2f}" text-anchor="{anchor}" font-size="{size}">{html.escape(str(words)[:24])}</text>')

    def svg(self) -> str:
        head = f'<text x="{WIDTH / 2:.0f}" y="24" text-anchor="middle" font-size="14">{html.escape(self.title)}</text>'
        return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {HEIGHT}" role="img">{head}{"".join(self.parts)}</svg>'


def scale(low: float, high: float, start: float, end: float) -> Callable[[float], float]:
    span = (high - low) or 1.0
    return lambda v: start + (v - low) / span * (end - start)


def _say(label, value) -> str:
    return f"{label}: {value:g}"


def _up(c: Canvas, values: list[float]) -> Callable[[float], float]:
    """The vertical scale, from zero, with its zero line and end marks."""
    low, high = min([0.0, *values]), max([0.0, *values])
    y = scale(low, high, HEIGHT - BOTTOM, TOP)
    c.add("line", x1=LEFT, y1=y(0), x2=WIDTH - RIGHT, y2=y(0), stroke="#888")
    for v in {low, high}:
        c.text(LEFT - 6, y(v) + 3, f"{v:g}", "end")
    return y


def bar(c: Canvas, pairs: list[tuple[str, float]]) -> None:
    y, step = _up(c, [v for _, v in pairs]), (WIDTH - LEFT - RIGHT) / max(1, len(pairs))
    for i, (name, v) in enumerate(pairs):
        c.add("rect", _say(name, v), x=LEFT + (i + 0.1) * step, y=min(y(v), y(0)), width=step * 0.8, height=abs(y(v) - y(0)), fill=COLORS[0])
        c.text(LEFT + (i + 0.5) * step, HEIGHT - BOTTOM + 16, name)


def _rows(c: Canvas, pairs: list[tuple[str, float]]) -> tuple[Callable, float]:
    values = [v for _, v in pairs]
    x = scale(min([0.0, *values]), max([0.0, *values]), LEFT + 60, WIDTH - RIGHT)
    step = (HEIGHT - TOP - 20) / max(1, len(pairs))
    c.add("line", x1=x(0), y1=TOP, x2=x(0), y2=HEIGHT - 20, stroke="#888")
    for i, (name, _) in enumerate(pairs):
        c.text(LEFT + 54, TOP + (i + 0.5) * step + 3, name, "end")
    return x, step


def barh(c: Canvas, pairs: list[tuple[str, float]]) -> None:
    x, step = _rows(c, pairs)
    for i, (name, v) in enumerate(pairs):
        c.add("rect", _say(name, v), x=min(x(v), x(0)), y=TOP + (i + 0.15) * step, width=abs(x(v) - x(0)), height=step * 0.7, fill=COLORS[0])


def lollipop(c: Canvas, pairs: list[tuple[str, float]]) -> None:
    x, step = _rows(c, pairs)
    for i, (name, v) in enumerate(pairs):
        at = TOP + (i + 0.5) * step
        c.add("line", x1=x(0), y1=at, x2=x(v), y2=at, stroke=COLORS[0])
        c.add("circle", _say(name, v), cx=x(v), cy=at, r=4, fill=COLORS[0])


def _curve(c: Canvas, pairs: list[tuple[str, float]], filled: bool) -> None:
    y, step = _up(c, [v for _, v in pairs]), (WIDTH - LEFT - RIGHT) / max(1, len(pairs) - 1)
    points = [(LEFT + i * step, y(v)) for i, (_, v) in enumerate(pairs)]
    path = "M" + " L".join(f"{px:.2f},{py:.2f}" for px, py in points)
    if filled:
        c.add("path", d=f"{path} L{points[-1][0]:.2f},{y(0):.2f} L{points[0][0]:.2f},{y(0):.2f} Z", fill=COLORS[0], fill_opacity=0.25, stroke="none")
    c.add("path", d=path, fill="none", stroke=COLORS[0], stroke_width=2)
    every = max(1, math.ceil(len(pairs) / 12))
    for i, ((name, v), (px, py)) in enumerate(zip(pairs, points)):
        c.add("circle", _say(name, v), cx=px, cy=py, r=3, fill=COLORS[0])
        if i % every == 0:
            c.text(px, HEIGHT - BOTTOM + 16, name)


def line(c: Canvas, pairs: list[tuple[str, float]]) -> None:
    _curve(c, pairs, False)


def area(c: Canvas, pairs: list[tuple[str, float]]) -> None:
    _curve(c, pairs, True)


def _slices(c: Canvas, pairs: list[tuple[str, float]], hole: float) -> None:
    """Shares of what is positive, clockwise from the top."""
    pairs = [(n, v) for n, v in pairs if v > 0]
    total, at, r, cx, cy = sum(v for _, v in pairs), 0.0, 130.0, 200.0, HEIGHT / 2 + 10
    for i, (name, v) in enumerate(pairs):
        share, color = v / total, COLORS[i % len(COLORS)]
        a, b = at * math.tau, (at + share) * math.tau
        spot = lambda angle, radius: f"{cx + radius * math.sin(angle):.2f},{cy - radius * math.cos(angle):.2f}"
        words = f"{name}: {v:g} ({share:.1%})"
        if share > 0.9999:
            c.add("circle", words, cx=cx, cy=cy, r=r, fill=color)
            if hole:
                c.add("circle", cx=cx, cy=cy, r=hole, fill="#fff")
        else:
            wide = int(share > 0.5)
            inner = f"L{spot(b, hole)} A{hole},{hole} 0 {wide} 0 {spot(a, hole)}" if hole else f"L{cx:.2f},{cy:.2f}"
            c.add("path", words, d=f"M{spot(a, r)} A{r},{r} 0 {wide} 1 {spot(b, r)} {inner} Z", fill=color)
        c.add("rect", x=380, y=TOP + 20 + i * 18, width=10, height=10, fill=color)
        c.text(396, TOP + 29 + i * 18, f"{name} {share:.1%}", "start")
        at += share


def pie(c: Canvas, pairs: list[tuple[str, float]]) -> None:
    _slices(c, pairs, 0.0)


def doughnut(c: Canvas, pairs: list[tuple[str, float]]) -> None:
    _slices(c, pairs, 70.0)


def histogram(c: Canvas, bins: list[tuple[float, float, int]]) -> None:
    """(low, high, count) of each bin."""
    y, x = _up(c, [n for *_, n in bins]), scale(bins[0][0], bins[-1][1], LEFT, WIDTH - RIGHT)
    for low, high, n in bins:
        left, right = (x(low), x(high)) if high > low else (LEFT, WIDTH - RIGHT)
        c.add("rect", f"{low:g} to {high:g}: {n}", x=left, y=y(n), width=max(1.0, right - left - 1), height=y(0) - y(n), fill=COLORS[0])
    for v in (bins[0][0], bins[-1][1]):
        c.text(x(v), HEIGHT - BOTTOM + 16, f"{v:g}")


def boxplot(c: Canvas, boxes: list[dict]) -> None:
    """Each box has variable, low_whisker, q1, median, q3, high_whisker and outliers (their number)."""
    y = scale(min(b["low_whisker"] for b in boxes), max(b["high_whisker"] for b in boxes), HEIGHT - BOTTOM, TOP)
    step = (WIDTH - LEFT - RIGHT) / len(boxes)
    for i, b in enumerate(boxes):
        mid, half = LEFT + (i + 0.5) * step, min(40.0, step / 3)
        c.add("line", x1=mid, y1=y(b["low_whisker"]), x2=mid, y2=y(b["high_whisker"]), stroke="#555")
        words = f"{b['variable']}: {b['low_whisker']:g} | {b['q1']:g} | {b['median']:g} | {b['q3']:g} | {b['high_whisker']:g}, {b['outliers']} beyond"
        c.add("rect", words, x=mid - half, y=y(b["q3"]), width=2 * half, height=max(1.0, y(b["q1"]) - y(b["q3"])), fill=COLORS[0], fill_opacity=0.6)
        c.add("line", x1=mid - half, y1=y(b["median"]), x2=mid + half, y2=y(b["median"]), stroke="#000")
        c.text(mid, HEIGHT - BOTTOM + 16, b["variable"])


def scatter(c: Canvas, points: list[tuple[float, float]], trend: tuple[float, float] | None = None) -> None:
    """Points, and a line (slope, intercept)."""
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    x, y = scale(min(xs), max(xs), LEFT, WIDTH - RIGHT), scale(min(ys), max(ys), HEIGHT - BOTTOM, TOP)
    for a, b in points:
        c.add("circle", f"{a:g}, {b:g}", cx=x(a), cy=y(b), r=2.5, fill=COLORS[0], fill_opacity=0.6)
    if trend and trend[0] is not None:
        ends = [(v, trend[0] * v + trend[1]) for v in (min(xs), max(xs))]
        c.add("line", x1=x(ends[0][0]), y1=y(ends[0][1]), x2=x(ends[1][0]), y2=y(ends[1][1]), stroke=COLORS[1])
    for v in (min(xs), max(xs)):
        c.text(x(v), HEIGHT - BOTTOM + 16, f"{v:g}")
    for v in (min(ys), max(ys)):
        c.text(LEFT - 6, y(v) + 3, f"{v:g}", "end")


def heatmap(c: Canvas, cells: list[tuple[str, str, float]]) -> None:
    """(a, b, r) of each pair, drawn on both sides of the diagonal; r from -1 to 1."""
    names = list(dict.fromkeys(n for a, b, _ in cells for n in (a, b)))
    size = min((WIDTH - LEFT - 120) / len(names), (HEIGHT - TOP - BOTTOM) / len(names))
    for a, b, r in cells:
        for p, q in {(a, b), (b, a)}:
            i, j = names.index(p), names.index(q)
            c.add("rect", f"{p} / {q}: {r:.3f}", x=LEFT + 60 + j * size, y=TOP + i * size, width=size, height=size, fill=COLORS[0] if r >= 0 else COLORS[1], fill_opacity=abs(r))
    for i, n in enumerate(names):
        c.text(LEFT + 54, TOP + (i + 0.5) * size + 3, n, "end")
        c.text(LEFT + 60 + (i + 0.5) * size, TOP + len(names) * size + 14, n)


def stacked_bar(c: Canvas, groups: list[tuple[str, dict[str, float]]]) -> None:
    """Each group's parts on top of each other, none below zero."""
    y, step = _up(c, [sum(parts.values()) for _, parts in groups]), (WIDTH - LEFT - RIGHT) / max(1, len(groups))
    for i, (name, parts) in enumerate(groups):
        base = 0.0
        for k, (part, v) in enumerate(parts.items()):
            c.add("rect", f"{name} / {part}: {v:g}", x=LEFT + (i + 0.1) * step, y=y(base + v), width=step * 0.8, height=y(base) - y(base + v), fill=COLORS[k % len(COLORS)])
            base += v
        c.text(LEFT + (i + 0.5) * step, HEIGHT - BOTTOM + 16, name)


def pareto(c: Canvas, rows: list[tuple[str, float, float]]) -> None:
    """(label, value, cumulative percent) in falling order, with the 80 % line."""
    bar(c, [(n, v) for n, v, _ in rows])
    share, step = scale(0, 100, HEIGHT - BOTTOM, TOP), (WIDTH - LEFT - RIGHT) / max(1, len(rows))
    c.add("line", x1=LEFT, y1=share(80), x2=WIDTH - RIGHT, y2=share(80), stroke="#888", stroke_dasharray="4 4")
    points = [(LEFT + (i + 0.5) * step, share(p)) for i, (*_, p) in enumerate(rows)]
    c.add("path", d="M" + " L".join(f"{x:.2f},{y:.2f}" for x, y in points), fill="none", stroke=COLORS[1])
    for (n, _, p), (x, y) in zip(rows, points):
        c.add("circle", f"{n}: {p:.1f} %", cx=x, cy=y, r=3, fill=COLORS[1])


def waterfall(c: Canvas, steps: list[tuple[str, float, float]]) -> None:
    """(label, start, end) of each step, and the last end as the total."""
    steps = [*steps, ("total", 0.0, steps[-1][2])]
    y, step = _up(c, [v for _, a, b in steps for v in (a, b)]), (WIDTH - LEFT - RIGHT) / len(steps)
    for i, (name, a, b) in enumerate(steps):
        color = COLORS[0] if name == "total" else COLORS[2] if b >= a else COLORS[1]
        c.add("rect", _say(name, b - a), x=LEFT + (i + 0.1) * step, y=min(y(a), y(b)), width=step * 0.8, height=max(1.0, abs(y(a) - y(b))), fill=color)
        c.text(LEFT + (i + 0.5) * step, HEIGHT - BOTTOM + 16, name)


RENDERERS: dict[str, Callable] = {
    f.__name__: f for f in (bar, barh, lollipop, line, area, pie, doughnut, histogram, boxplot, scatter, heatmap, stacked_bar, pareto, waterfall)
}


def render(kind: str, title: str, data: list, **more) -> str:
    """The SVG of a chart; without data it says so."""
    c = Canvas(title)
    if data:
        RENDERERS[kind](c, data, **more)
    else:
        c.text(WIDTH / 2, HEIGHT / 2, "no data")
    return c.svg()
