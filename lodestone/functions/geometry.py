"""Node sizes, arrowheads, screen transforms and colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_size(loc: Column, least: Column, most: Column, small: float = 20.0, large: float = 40.0, score: Column | None = None) -> Column:
    """Linear in the lines between least and most, the middle if all are equal; up to 40 % more by score."""
    base = F.when(most == least, F.lit((small + large) / 2)).otherwise(small + (loc - least) / (most - least) * (large - small))
    return base if score is None else base * (1 + 0.4 * score)


def arrowhead(x1: Column, y1: Column, x2: Column, y2: Column, back: float = 20.0, length: float = 10.0, spread: float = 0.5) -> dict[str, Column]:
    """Tip ``back`` before the end, wings of ``length`` at ``spread`` radians to either side; null where both ends meet."""
    dx, dy = x2 - x1, y2 - y1
    far = F.sqrt(dx * dx + dy * dy)
    ux, uy = F.when(far > 0, dx / far), F.when(far > 0, dy / far)
    tip_x, tip_y = x2 - ux * back, y2 - uy * back
    out = {"tip_x": tip_x, "tip_y": tip_y}
    angle = F.atan2(uy, ux)
    for name, turn in (("left", spread), ("right", -spread)):
        out |= {f"{name}_x": tip_x - length * F.cos(angle + turn), f"{name}_y": tip_y - length * F.sin(angle + turn)}
    return out


ZOOM_LEAST, ZOOM_MOST = 0.1, 1000.0


def clamp_zoom(zoom: Column) -> Column:
    return F.greatest(F.lit(ZOOM_LEAST), F.least(F.lit(ZOOM_MOST), zoom))


def world_to_screen(x: Column, y: Column, view: tuple[float, float, float, float], screen: tuple[float, float]) -> tuple[Column, Column]:
    """view: left, top, width, height in the world; screen: width, height.  The aspect is kept, the view centred."""
    left, top, width, height = view
    scale = min(screen[0] / width, screen[1] / height)
    return (x - (left + width / 2)) * scale + screen[0] / 2, (y - (top + height / 2)) * scale + screen[1] / 2


def screen_to_world(x: Column, y: Column, view: tuple[float, float, float, float], screen: tuple[float, float]) -> tuple[Column, Column]:
    left, top, width, height = view
    scale = min(screen[0] / width, screen[1] / height)
    return (x - screen[0] / 2) / scale + (left + width / 2), (y - screen[1] / 2) / scale + (top + height / 2)


def pan(view: tuple[float, float, float, float], dx: float, dy: float) -> tuple[float, float, float, float]:
    return view[0] - dx, view[1] - dy, view[2], view[3]


def zoom_about(view: tuple[float, float, float, float], factor: float, x: float, y: float) -> tuple[float, float, float, float]:
    """The world point (x, y) keeps its place on the screen."""
    left, top, width, height = view
    return x - (x - left) / factor, y - (y - top) / factor, width / factor, height / factor


def in_canvas(x: Column, y: Column, width: float, height: float, margin: Column | float = 0.0) -> Column:
    m = margin if isinstance(margin, Column) else F.lit(float(margin))
    return (x >= -m) & (x <= width + m) & (y >= -m) & (y <= height + m)


def node_color(selected: Column, hovered: Column, cyclic: Column, external: Column, color: Column) -> Column:
    """The first that holds: selected, hovered, in the largest cycle, missing on disk (full colour); else the colour at half strength."""
    half = lambda at: F.lpad(F.lower(F.hex(F.floor(F.conv(F.substring(color, at, 2), 16, 10).cast("int") / 2).cast("bigint"))), 2, "0")
    dim = F.concat(F.lit("#"), half(2), half(4), half(6))
    return F.when(selected, "#ffa500").when(hovered, "#add8e6").when(cyclic, "#ff6464").when(external, F.lower(color)).otherwise(dim)
