"""Overlay pictures: panels, gauges, traces, maps and lap panels as straight RGBA arrays."""

from __future__ import annotations

import math

import numpy as np

PANEL, BORDER, TEXT, DIM, ACCENT = ((12, 14, 18, 166), (255, 255, 255, 46), (240, 240, 240, 255), (150, 150, 150, 255), (64, 196, 255, 255))
#: Glyphs of three columns and five rows, top down, as the bits of each row.
GLYPHS = {"0": (7, 5, 5, 5, 7), "1": (2, 6, 2, 2, 7), "2": (7, 1, 7, 4, 7), "3": (7, 1, 7, 1, 7), "4": (5, 5, 7, 1, 1), "5": (7, 4, 7, 1, 7), "6": (7, 4, 7, 5, 7), "7": (7, 1, 1, 1, 1), "8": (7, 5, 7, 5, 7), "9": (7, 5, 7, 1, 7), ".": (0, 0, 0, 0, 2), ":": (0, 2, 0, 2, 0), "-": (0, 0, 7, 0, 0), " ": (0, 0, 0, 0, 0)}


GLYPHS |= {"A": (2, 5, 7, 5, 5), "B": (6, 5, 6, 5, 6), "C": (3, 4, 4, 4, 3), "D": (6, 5, 5, 5, 6), "E": (7, 4, 6, 4, 7), "F": (7, 4, 6, 4, 4), "G": (3, 4, 5, 5, 3), "H": (5, 5, 7, 5, 5), "I": (7, 2, 2, 2, 7), "J": (1, 1, 1, 5, 2), "K": (5, 5, 6, 5, 5), "L": (4, 4, 4, 4, 7), "M": (5, 7, 7, 5, 5), "N": (6, 5, 5, 5, 5), "O": (2, 5, 5, 5, 2), "P": (6, 5, 6, 4, 4), "Q": (2, 5, 5, 6, 3), "R": (6, 5, 6, 5, 5), "S": (3, 4, 2, 1, 6), "T": (7, 2, 2, 2, 2), "U": (5, 5, 5, 5, 7), "V": (5, 5, 5, 5, 2), "W": (5, 5, 7, 7, 5), "X": (5, 5, 2, 5, 5), "Y": (5, 5, 2, 2, 2), "Z": (7, 1, 2, 4, 7), "/": (1, 1, 2, 4, 4), "%": (5, 1, 2, 4, 5), "_": (0, 0, 0, 0, 7), "(": (1, 2, 2, 2, 1), ")": (4, 2, 2, 2, 4)}


class Canvas:
    def __init__(self, width: int, height: int):
        self.px = np.zeros((height, width, 4), np.uint8)

    def box(self, x: float, y: float, w: float, h: float, color, radius: float = 0.0) -> None:
        """A filled box, its corners rounded, over what is there."""
        top, left = max(0, round(y)), max(0, round(x))
        part = self.px[top : max(top, round(y + h)), left : max(left, round(x + w))]
        if not part.size:
            return
        inside = None
        if radius >= 1:
            off = lambda n: np.maximum(radius - np.minimum(np.arange(n), np.arange(n)[::-1]) - 0.5, 0)
            inside = off(part.shape[0])[:, None] ** 2 + off(part.shape[1])[None, :] ** 2 <= radius * radius
        self._over(part, color, inside)

    @staticmethod
    def _over(part: np.ndarray, color, inside: np.ndarray | None) -> None:
        """The colour over straight RGBA pixels."""
        if color[3] == 255 and inside is None:
            part[:] = color
            return
        a = color[3] / 255.0 * (np.ones(part.shape[:2]) if inside is None else inside)
        below = part[..., 3] / 255.0 * (1 - a)
        alpha = a + below
        mixed = (np.array(color[:3]) * a[..., None] + part[..., :3] * below[..., None]) / np.where(alpha > 0, alpha, 1)[..., None]
        part[..., :3] = np.rint(mixed)
        part[..., 3] = np.rint(alpha * 255)

    def line(self, points: list[tuple[float, float]], color, width: int = 1) -> None:
        for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
            n = max(2, int(max(abs(x1 - x0), abs(y1 - y0))) + 1)
            t = np.linspace(0, 1, n)
            xs, ys = np.rint(x0 + (x1 - x0) * t).astype(int), np.rint(y0 + (y1 - y0) * t).astype(int)
            for dx in range(width):
                for dy in range(width):
                    ok = (ys + dy >= 0) & (ys + dy < self.px.shape[0]) & (xs + dx >= 0) & (xs + dx < self.px.shape[1])
                    self.px[ys[ok] + dy, xs[ok] + dx] = color

    def text(self, s: str, x: float, y: float, size: float, color) -> None:
        """Digits, letters as capitals and marks; anything else is left blank. ``size`` is the height."""
        unit = max(1, int(size // 5))
        for k, ch in enumerate(s.upper()):
            for row, bits in enumerate(GLYPHS.get(ch, GLYPHS[" "])):
                for col in range(3):
                    if bits >> (2 - col) & 1:
                        self.box(x + (4 * k + col) * unit, y + row * unit, unit, unit, color)

    def arc(self, cx: float, cy: float, r: float, a0: float, a1: float, color, width: int = 2) -> None:
        a = np.linspace(a0, a1, max(2, int(abs(a1 - a0) * r) + 2))
        self.line(list(zip(cx + r * np.cos(a), cy + r * np.sin(a), strict=True)), color, width)


def number(v: float) -> str:
    return f"{v:.1f}" if abs(v) >= 10 else f"{v:.2f}"


def elapsed(seconds: float) -> str:
    m = math.floor(seconds / 60)
    return f"{m}:{seconds - 60 * m:04.1f}"


def lap_time(ms: int) -> str:
    return f"{ms // 60_000}:{ms % 60_000 / 1000:05.2f}"


def _gauge(c: Canvas, e: dict, box, v: float | None) -> None:
    x, y, w, h = box
    if v is None or not math.isfinite(v):
        c.text("-", x + w / 2, y + h / 2, h * 0.3, DIM)
        return
    low, high = e.get("min", 0.0), e.get("max", 1.0)
    part = min(max((v - low) / (high - low), 0.0), 1.0) if high > low else 0.0
    style, label = e.get("style", "numeric"), str(e.get("label") or "")
    if style == "bar":
        c.text(label, x, y, h * 0.14, TEXT)
        c.box(x, y + h * 0.6, w, h * 0.25, BORDER, 3.0)
        c.box(x, y + h * 0.6, max(1.0, w * part), h * 0.25, ACCENT)
    elif style in ("dial", "arc", "radial"):
        r = min(w, h) * 0.42
        c.arc(x + w / 2, y + h / 2, r, math.pi * 0.75, math.pi * 2.25, BORDER)
        c.arc(x + w / 2, y + h / 2, r, math.pi * 0.75, math.pi * (0.75 + 1.5 * part), ACCENT)
    if style != "bar":
        c.text(label, x, y + h * 0.86, h * 0.14, TEXT)
    c.text(number(v), x, y + h * 0.18, h * 0.35, TEXT)


def _attitude(c: Canvas, e: dict, box, v: float | None) -> None:
    x, y, w, h = box
    if v is None or not math.isfinite(v):
        c.text("-", x + w / 2, y + h / 2, h * 0.3, DIM)
        return
    limit = e.get("range_deg", 45.0)
    shown = math.radians(max(-limit, min(limit, v)))
    cx, cy, r = x + w / 2, y + h / 2, min(w, h) * 0.45
    if e.get("style") == "pitch":
        off = -shown / math.radians(limit) * r if limit else 0.0
        c.line([(cx - r, cy + off), (cx + r, cy + off)], ACCENT, 2)
    else:
        dx, dy = r * math.cos(shown), r * math.sin(shown)
        c.line([(cx - dx, cy - dy), (cx + dx, cy + dy)], ACCENT, 2)
    c.text(number(v), x, y + h * 0.8, h * 0.2, TEXT)


def draw(elements: list[dict], row: dict, columns: dict[str, str], size: tuple[int, int], traces: dict, line: list[tuple[float, float]]) -> np.ndarray:
    """One frame. Rects are fractions of the canvas: x, y, width, height. ``traces``: the column of a channel's points, by
    (channel, window in seconds) or by channel."""
    c = Canvas(*size)
    for e in elements:
        fx, fy, fw, fh = e["rect"]
        x, y, w, h = fx * size[0], fy * size[1], fw * size[0], fh * size[1]
        round_ = min(6.0, w / 4, h / 4)
        c.box(x, y, w, h, BORDER, round_)
        c.box(x + 1, y + 1, w - 2, h - 2, PANEL, round_)
        pad = min(w, h) * 0.08
        box = (x + pad, y + pad, w - 2 * pad, h - 2 * pad)
        at = lambda p, box=box: (box[0] + p[0] * (box[2] - 1), box[1] + (1 - p[1]) * (box[3] - 1))
        kind = e["type"]
        if kind == "gauge":
            _gauge(c, e, box, row.get(columns.get(e["channel"], "")))
        elif kind == "attitude":
            _attitude(c, e, box, row.get(columns.get(e["channel"], "")))
        elif kind == "trace_strip":
            for k, name in enumerate(e["channels"]):
                points = row.get(traces.get((name, float(e.get("window_s", 10.0))), traces.get(name, ""))) or []
                c.line([at((p["x"], p["y"])) for p in points], ACCENT if k == 0 else TEXT)
        elif kind == "track_map":
            c.line([at(p) for p in line], DIM)
            if row.get("x") is not None:
                px, py = at((row["x"], row["y"]))
                c.box(px - 2, py - 2, 4, 4, ACCENT)
        elif kind == "lap_panel":
            step = box[3] / 4
            lines = [str(row["current_lap"]) if row.get("current_lap") else "-", elapsed(row.get("lap_elapsed_s") or 0.0), lap_time(row["last_lap_ms"]) if row.get("last_lap_ms") else "-", lap_time(row["best_lap_ms"]) if row.get("best_lap_ms") else "-"]
            for k, s in enumerate(lines):
                c.text(s, box[0], box[1] + k * step, step * 0.8, TEXT)
    return c.px
