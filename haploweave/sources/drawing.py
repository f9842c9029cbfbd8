"""Drawings of networks: a scene of simple shapes, written as SVG, PNG or PDF."""

from __future__ import annotations

import math
import struct
import zlib
from dataclasses import dataclass, field
from typing import Any
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.palette import rgb, trait_colours
from ..session import ship

#: Settings of a drawing and their usual values.
DEFAULTS: dict[str, Any] = {
    "width": 1000, "height": 1000, "background": {"color": "#ffffff"},
    "edges": {"color": "#666666", "width": 1.5, "labelColor": "#333333", "showLabels": True, "displayMode": "labels"},
    "vertices": {"defaultColor": "#999999", "inferredColor": "#333333", "traitColors": [], "strokeColor": "#333333", "labelColor": "#333333"},
    "baseRadius": 10, "fontSize": 12, "zoom": 1, "panX": 0, "panY": 0, "showLabels": True, "showLegend": True, "legendPosition": None, "labelOffsets": {}, "traitNames": [],
}
TICK, TICK_GAP = 5, 6
_PAD, _ROW, _DOT, _GAP, _TITLE, _UNDER = 12, 20, 6, 8, 12, 14


def merged(options: dict[str, Any] | None = None, base: dict[str, Any] = DEFAULTS) -> dict[str, Any]:
    """options over base, group by group. traitColors and showEdgeLabels are also taken at the top, as older files have them."""
    options = options or {}
    out = {**base, **options}
    for group in ("background", "edges", "vertices"):
        out[group] = {**base[group], **(options.get(group) or {})}
    if isinstance(options.get("traitColors"), list):
        out["vertices"]["traitColors"] = options["traitColors"]
    if options.get("showEdgeLabels") is not None:
        out["edges"]["showLabels"] = options["showEdgeLabels"]
    out["labelOffsets"] = label_offsets(out.get("labelOffsets"))
    return out


def label_offsets(raw: Any) -> dict[str, dict[str, float]]:
    """Offsets with finite coordinates, by vertex index as text."""
    found = {}
    for key, value in (raw or {}).items() if isinstance(raw, dict) else ():
        try:
            x, y = float(value["x"]), float(value["y"])
        except (TypeError, KeyError, ValueError):
            continue
        if math.isfinite(x) and math.isfinite(y):
            found[str(key)] = {"x": x, "y": y}
    return found


@dataclass
class Item:
    """A shape: line, circle, sector, rect or text, with numbers in drawing units."""

    shape: str
    at: tuple[float, ...]
    fill: str | None = None
    stroke: str | None = None
    width: float = 1.0
    text: str = ""
    size: float = 12.0
    anchor: str = "middle"
    cls: str = ""


@dataclass
class Scene:
    edges: list[list[Item]] = field(default_factory=list)
    vertices: list[list[Item]] = field(default_factory=list)
    legend: list[Item] = field(default_factory=list)
    legend_at: tuple[float, float] | None = None


def radius_of(v: dict[str, Any], base: float) -> float:
    r, f = v.get("radius"), v.get("frequency")
    if r is not None and math.isfinite(r) and r > 0:
        return float(r)
    return base * math.sqrt(max(0.0, float(f) if f is not None and math.isfinite(f) else 1.0))


def _edge(e: dict[str, Any], a: dict[str, Any], b: dict[str, Any], o: dict[str, Any]) -> list[Item]:
    """The line, and either ticks around the middle or, for weights over 1, the weight beside it."""
    s, font, w = o["edges"], float(o["fontSize"]), float(e.get("weight") or 1)
    (x0, y0), (x1, y1) = (a["x"], a["y"]), (b["x"], b["y"])
    length = math.hypot(x1 - x0, y1 - y0)
    px, py = (-(y1 - y0) / length, (x1 - x0) / length) if length else (0.0, -1.0)
    out = [Item("line", (x0, y0, x1, y1), stroke=s["color"], width=s["width"])]
    if s["displayMode"] == "ticks" and length:
        n = max(0, math.floor(w))
        for k in range(n):
            t = 0.5 + (k - (n - 1) / 2) * TICK_GAP / length
            x, y = x0 + t * (x1 - x0), y0 + t * (y1 - y0)
            out.append(Item("line", (x - px * TICK, y - py * TICK, x + px * TICK, y + py * TICK), stroke=s["color"], width=s["width"], cls="edge-tick"))
    if s["displayMode"] == "labels" and s["showLabels"] and w > 1:
        by = font / 2 + 4
        out.append(Item("text", ((x0 + x1) / 2 + px * by, (y0 + y1) / 2 + py * by), fill=s["labelColor"], text=f"{w:g}", size=max(8, font - 2), cls="edge-label"))
    return out


def _vertex(v: dict[str, Any], o: dict[str, Any]) -> list[Item]:
    """A small dot for inferred vertices; else a disc, in slices if several traits occur, and the label under it."""
    s, base, x, y = o["vertices"], float(o["baseRadius"]), v["x"], v["y"]
    if v.get("inferred"):
        return [Item("circle", (x, y, 0.4 * base), fill=s["inferredColor"], cls="vertex-inferred")]
    r = radius_of(v, base)
    traits = [(k, t) for k, t in enumerate(v.get("traits") if v.get("traits") is not None else ()) if t is not None and t > 0]
    colour = lambda k: s["traitColors"][k] if k < len(s["traitColors"]) else s["defaultColor"]
    out = []
    if len(traits) > 1:
        total, angle = sum(t for _, t in traits), -math.pi / 2
        for k, t in traits:
            out.append(Item("sector", (x, y, r, angle, angle + 2 * math.pi * t / total), fill=colour(k), stroke=s["strokeColor"]))
            angle += 2 * math.pi * t / total
    else:
        out.append(Item("circle", (x, y, r), fill=colour(traits[0][0]) if traits else s["defaultColor"], stroke=s["strokeColor"]))
    if v.get("label") and o["showLabels"]:
        off = o["labelOffsets"].get(str(v["index"]), {"x": 0, "y": r + o["fontSize"] + 4})
        out.append(Item("text", (x + off["x"], y + off["y"]), fill=s["labelColor"], text=str(v["label"]), size=o["fontSize"], cls="vertex-label"))
    return out


def _legend(vertices: list[dict[str, Any]], o: dict[str, Any]) -> tuple[list[Item], tuple[float, float]] | None:
    """Discs of 10 samples and 1 sample, and a dot for each trait; right of the network unless it was put elsewhere."""
    names = o["traitNames"]
    if not names or not o["showLegend"]:
        return None
    base = float(o["baseRadius"]) if o["baseRadius"] and o["baseRadius"] > 0 else 10.0
    unit = next((v["radius"] / math.sqrt(v["frequency"]) for v in vertices if not v.get("inferred") and (v.get("radius") or 0) > 0 and (v.get("frequency") or 0) > 0), base)
    large = unit * math.sqrt(10)
    width = math.ceil(2 * _PAD + max(2 * large, 2 * _DOT + _GAP + max(len(str(x)) for x in names) * 12 * 0.58))
    rows, y = [], _PAD + _TITLE / 2
    grey = {"fill": "#666666", "size": 10.0, "anchor": "start", "cls": "legend-title"}
    rows.append(Item("text", (_PAD, y), text="NODE SIZE", **grey))
    y = _PAD + _TITLE + _UNDER
    for label, r, step in (("10 samples", large, 16), ("1 sample", unit, 0)):
        rows.append(Item("text", (width / 2, y), fill="#444444", text=label, size=11))
        rows.append(Item("circle", (width / 2, y + 8 + r, r), fill="#e0e0e0", stroke="#999999", cls="legend-size-circle"))
        y += 8 + 2 * r + step
    y += _GAP + _TITLE
    rows.append(Item("text", (_PAD, y), text="Traits", **grey))
    colours = o["vertices"]["traitColors"]
    for k, name in enumerate(names):
        at = y + _UNDER + _DOT + k * _ROW
        rows.append(Item("circle", (_PAD + _DOT, at, _DOT), fill=colours[k] if k < len(colours) else o["vertices"]["defaultColor"], stroke="#666666"))
        rows.append(Item("text", (_PAD + 2 * _DOT + _GAP, at + 4), fill="#444444", text=str(name), anchor="start"))
    height = math.ceil(y + _UNDER + len(names) * _ROW + _PAD)
    box = Item("rect", (0, 0, width, height), fill="#ffffff", stroke="#cccccc", cls="legend-bg")
    p = o["legendPosition"]
    if isinstance(p, dict) and all(isinstance(p.get(c), (int, float)) and math.isfinite(p[c]) for c in ("x", "y")):
        where = (float(p["x"]), float(p["y"]))
    elif vertices:
        where = (max(v["x"] + radius_of(v, base) for v in vertices) + 40, max(v["y"] + radius_of(v, base) for v in vertices) - height)
    else:
        where = (40.0, 40.0)
    return [box, *rows], where


def scene(vertices: list[dict[str, Any]], edges: list[dict[str, Any]], options: dict[str, Any]) -> Scene:
    """vertices: index, label, x, y, radius, frequency, inferred, traits; edges: from, to, weight. Edges lie below."""
    by = {v["index"]: v for v in vertices}
    s = Scene([_edge(e, by[e["from"]], by[e["to"]], options) for e in edges], [_vertex(v, options) for v in vertices])
    if found := _legend(vertices, options):
        s.legend, s.legend_at = found
    return s


def fit(vertices: list[dict[str, Any]], options: dict[str, Any], legend_at: tuple[float, float] | None) -> tuple[float, float, float, float]:
    """x, y, width and height of what is drawn: circles with room for labels, and the legend."""
    base, pad = float(options["baseRadius"]), 40.0
    if not vertices:
        return 0.0, 0.0, float(options["width"]), float(options["height"])
    r = [radius_of(v, base) for v in vertices]
    x0, y0 = (min(v[c] - q for v, q in zip(vertices, r, strict=True)) - pad for c in ("x", "y"))
    x1, y1 = (max(v[c] + q for v, q in zip(vertices, r, strict=True)) + pad for c in ("x", "y"))
    if legend_at:
        x0, y0, x1, y1 = min(x0, legend_at[0] - 10), min(y0, legend_at[1] - 10), max(x1, legend_at[0] + 200), max(y1, legend_at[1] + 300)
    return x0, y0, x1 - x0, y1 - y0


def fit_scale(width: float, height: float, box_width: float, box_height: float) -> float:
    """Scale at which a box fills 90 % of a view, between 0.1 and 10."""
    return min(10.0, max(0.1, min(0.9 * width / max(box_width, 1e-9), 0.9 * height / max(box_height, 1e-9))))


def _n(x: float) -> str:
    return f"{x:.6f}".rstrip("0").rstrip(".") if x % 1 else str(int(x))


def _svg(i: Item) -> str:
    paint = f' fill={quoteattr(i.fill or "none")}' + (f' stroke={quoteattr(i.stroke)} stroke-width="{_n(i.width)}"' if i.stroke else "") + (f' class="{i.cls}"' if i.cls else "")
    p = [_n(x) for x in i.at]
    if i.shape == "line":
        return f'<line x1="{p[0]}" y1="{p[1]}" x2="{p[2]}" y2="{p[3]}"{paint}/>'
    if i.shape == "circle":
        return f'<circle cx="{p[0]}" cy="{p[1]}" r="{p[2]}"{paint}/>'
    if i.shape == "rect":
        return f'<rect x="{p[0]}" y="{p[1]}" width="{p[2]}" height="{p[3]}" rx="4" fill-opacity="0.85"{paint}/>'
    if i.shape == "text":
        return f'<text x="{p[0]}" y="{p[1]}" text-anchor="{i.anchor}" dominant-baseline="middle" font-size="{_n(i.size)}px"{paint}>{escape(i.text)}</text>'
    x, y, r, a, b = i.at
    ends = [_n(z) for z in (x + r * math.cos(a), y + r * math.sin(a), x + r * math.cos(b), y + r * math.sin(b))]
    return f'<path d="M {p[0]} {p[1]} L {ends[0]} {ends[1]} A {p[2]} {p[2]} 0 {int(b - a > math.pi)} 1 {ends[2]} {ends[3]} Z"{paint}/>'


def svg(vertices: list[dict[str, Any]], edges: list[dict[str, Any]], options: dict[str, Any] | None = None, export: bool = False, transparent: bool = False) -> str:
    """The drawing as SVG text. export: the whole network, whatever the zoom and pan are, at width by height."""
    o = merged(options)
    s = scene(vertices, edges, o)
    usual = (o["width"], o["height"]) == (DEFAULTS["width"], DEFAULTS["height"]) and not export
    size = ("100%", "100%") if usual else (_n(o["width"]), _n(o["height"]))
    box = fit(vertices, o, s.legend_at) if export else (0, 0, o["width"], o["height"])
    view = "" if export else f' transform="translate({_n(o["panX"])}, {_n(o["panY"])}) scale({_n(o["zoom"])})"'
    back = "" if transparent or not export else f'<rect class="svg-background" x="{_n(box[0])}" y="{_n(box[1])}" width="{_n(box[2])}" height="{_n(box[3])}" fill={quoteattr(o["background"]["color"])}/>'
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{size[0]}" height="{size[1]}" viewBox="{" ".join(map(_n, box))}" preserveAspectRatio="xMidYMid meet">', back, f'<g class="viewport"{view}><g class="edges">']
    parts += [f'<g class="edge" data-index="{k}">{"".join(map(_svg, items))}</g>' for k, items in enumerate(s.edges)]
    parts += ['</g><g class="vertices">', *(f'<g class="vertex" data-index="{v["index"]}">{"".join(map(_svg, items))}</g>' for v, items in zip(vertices, s.vertices, strict=True)), "</g>"]
    if s.legend:
        parts.append(f'<g id="network-legend" transform="translate({_n(s.legend_at[0])}, {_n(s.legend_at[1])})">{"".join(map(_svg, s.legend))}</g>')
    return "".join([*parts, "</g></svg>"])


def _flat(s: Scene, box: tuple[float, float, float, float], width: float, height: float) -> tuple[list[Item], float]:
    """All items in pixels from the upper left, in drawing order, and the scale."""
    k = min(width / box[2], height / box[3])
    dx, dy = (width - k * box[2]) / 2 - k * box[0], (height - k * box[3]) / 2 - k * box[1]
    out = []
    for items, (ox, oy) in (*((x, (0.0, 0.0)) for x in [*s.edges, *s.vertices]), (s.legend, s.legend_at or (0.0, 0.0))):
        for i in items:
            x = [dx + k * (i.at[0] + ox), dy + k * (i.at[1] + oy)]
            if i.shape == "line":
                x += [dx + k * (i.at[2] + ox), dy + k * (i.at[3] + oy)]
            elif i.shape == "sector":
                x += [k * i.at[2], *i.at[3:]]
            else:
                x += [k * z for z in i.at[2:]]
            out.append(Item(i.shape, tuple(x), i.fill, i.stroke, k * i.width, i.text, k * i.size, i.anchor))
    return out, k


def png(vertices: list[dict[str, Any]], edges: list[dict[str, Any]], options: dict[str, Any] | None = None, transparent: bool = False) -> bytes:
    """The drawing as PNG, width by height pixels, shapes with smoothed borders. Text is left out: no fonts here."""
    o = merged(options)
    s, w, h = scene(vertices, edges, o), max(1, int(o["width"])), max(1, int(o["height"]))
    items, _ = _flat(s, fit(vertices, o, s.legend_at), w, h)
    back = rgb(o["background"]["color"]) or (255, 255, 255)
    image = np.zeros((h, w, 4)) if transparent else np.full((h, w, 4), [*back, 255.0])

    def paint(cover: np.ndarray, y: int, x: int, colour: str | None) -> None:
        channels = rgb(colour or "")
        if channels is not None:
            part = image[y : y + cover.shape[0], x : x + cover.shape[1]]
            part += cover[:, :, None] * (np.array([*channels, 255.0]) - part)

    for i in items:
        if i.shape == "text":
            continue
        reach = i.width + 1 + (i.at[2] if i.shape in ("circle", "sector") else 0)
        xs, ys = ([i.at[0], i.at[2]], [i.at[1], i.at[3]]) if i.shape == "line" else ([i.at[0], i.at[0] + i.at[2]], [i.at[1], i.at[1] + i.at[3]]) if i.shape == "rect" else ([i.at[0]], [i.at[1]])
        x0, x1, y0, y1 = max(0, int(min(xs) - reach)), min(w, int(max(xs) + reach) + 2), max(0, int(min(ys) - reach)), min(h, int(max(ys) + reach) + 2)
        if x0 >= x1 or y0 >= y1:
            continue
        gx, gy = np.meshgrid(np.arange(x0, x1) + 0.5, np.arange(y0, y1) + 0.5)
        if i.shape == "line":
            vx, vy = i.at[2] - i.at[0], i.at[3] - i.at[1]
            t = np.clip(((gx - i.at[0]) * vx + (gy - i.at[1]) * vy) / max(vx * vx + vy * vy, 1e-12), 0, 1)
            paint(np.clip(i.width / 2 + 0.5 - np.hypot(gx - i.at[0] - t * vx, gy - i.at[1] - t * vy), 0, 1), y0, x0, i.stroke)
        elif i.shape == "rect":
            paint(((gx >= i.at[0]) & (gx < i.at[0] + i.at[2]) & (gy >= i.at[1]) & (gy < i.at[1] + i.at[3])) * 0.85, y0, x0, i.fill)
        else:
            away = np.hypot(gx - i.at[0], gy - i.at[1])
            inside = np.clip(i.at[2] + 0.5 - away, 0, 1)
            if i.shape == "sector":
                inside = inside * ((np.arctan2(gy - i.at[1], gx - i.at[0]) - i.at[3]) % (2 * np.pi) < i.at[4] - i.at[3])
            paint(inside, y0, x0, i.fill)
            if i.stroke and i.shape == "circle":
                paint(np.clip(i.width / 2 + 0.5 - np.abs(away - i.at[2]), 0, 1), y0, x0, i.stroke)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), np.round(image).astype(np.uint8).reshape(h, -1)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def pdf(vertices: list[dict[str, Any]], edges: list[dict[str, Any]], options: dict[str, Any] | None = None, transparent: bool = False) -> bytes:
    """The drawing as a PDF of one page of width by height points, as vectors."""
    o = merged(options)
    s, w, h = scene(vertices, edges, o), float(o["width"]), float(o["height"])
    items, _ = _flat(s, fit(vertices, o, s.legend_at), w, h)
    unit = lambda c: " ".join(f"{x / 255:.4f}" for x in rgb(c or "") or (0, 0, 0))
    ops = [] if transparent else [f"{unit(o['background']['color'])} rg 0 0 {w:g} {h:g} re f"]

    def arc(x: float, y: float, r: float, a: float, b: float) -> list[str]:
        n = max(1, math.ceil(abs(b - a) / (math.pi / 2)))
        step = (b - a) / n
        q = 4 / 3 * math.tan(step / 4) * r
        out = []
        for m in range(n):
            u, v = a + m * step, a + (m + 1) * step
            pts = (x + r * math.cos(u) - q * math.sin(u), y + r * math.sin(u) + q * math.cos(u), x + r * math.cos(v) + q * math.sin(v), y + r * math.sin(v) - q * math.cos(v), x + r * math.cos(v), y + r * math.sin(v))
            out.append(" ".join(f"{p if k % 2 == 0 else h - p:.3f}" for k, p in enumerate(pts)) + " c")
        return out

    for i in items:
        x, y = i.at[:2]
        if i.shape == "text":
            text = i.text.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").decode("cp1252")
            shift = {"middle": 0.5, "end": 1.0}.get(i.anchor, 0.0) * 0.5 * i.size * len(i.text)
            ops.append(f"BT {unit(i.fill)} rg /F1 {i.size:.3f} Tf {x - shift:.3f} {h - y - 0.35 * i.size:.3f} Td ({text}) Tj ET")
            continue
        end = "B" if i.fill and i.stroke else "f" if i.fill else "S"
        ops.append((f"{unit(i.fill)} rg " if i.fill else "") + (f"{unit(i.stroke)} RG {i.width:.3f} w" if i.stroke else ""))
        if i.shape == "line":
            ops.append(f"{x:.3f} {h - y:.3f} m {i.at[2]:.3f} {h - i.at[3]:.3f} l S")
        elif i.shape == "rect":
            ops.append(f"{x:.3f} {h - y - i.at[3]:.3f} {i.at[2]:.3f} {i.at[3]:.3f} re {end}")
        elif i.shape == "circle":
            ops += [f"{x + i.at[2]:.3f} {h - y:.3f} m", *arc(x, y, i.at[2], 0, 2 * math.pi), f"h {end}"]
        else:
            r, a, b = i.at[2:]
            ops += [f"{x:.3f} {h - y:.3f} m {x + r * math.cos(a):.3f} {h - y - r * math.sin(a):.3f} l", *arc(x, y, r, a, b), f"h {end}"]
    stream = zlib.compress("\n".join(ops).encode("cp1252", "replace"))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {w:g} {h:g}] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>".encode(), b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(stream) + stream + b"\nendstream", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    out, at = b"%PDF-1.4\n", []
    for k, body in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n" % k + body + b"\nendobj\n"
    table = "".join(f"{p:010d} 00000 n \n" for p in at).encode()
    return out + b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + table + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, len(out))


def draw(vertices: DataFrame, edges: DataFrame, options: dict[str, Any] | None = None, kind: str = "svg", transparent: bool = False) -> DataFrame:
    """(network_id, drawing): one drawing per network, made in its task. kind: svg (string), png or pdf (binary).

    vertices as from plans.layout.lay_out() with label, frequency, inferred and, if there, traits; edges with weights.
    """
    maker = {"svg": lambda v, e, o: svg(v, e, o, True, transparent), "png": lambda v, e, o: png(v, e, o, transparent), "pdf": lambda v, e, o: pdf(v, e, o, transparent)}[kind]
    ship(vertices.sparkSession)
    extra = ["traits"] if "traits" in vertices.columns else []

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame([], columns=["network_id", "drawing"])
        rows = left.sort_values("index").to_dict("records")
        links = right.sort_values("index").to_dict("records")
        o = dict(options or {})
        if o.get("traitNames") and not (o.get("vertices") or {}).get("traitColors"):
            o["vertices"] = {**(o.get("vertices") or {}), "traitColors": trait_colours(len(o["traitNames"]))}
        return pd.DataFrame({"network_id": [rows[0]["network_id"]], "drawing": [maker(rows, links, o)]})

    v = vertices.select("network_id", "index", "label", "x", "y", "radius", "frequency", "inferred", *extra)
    e = edges.select(F.col("network_id").alias("network_id"), F.col("index").alias("index"), F.col("from").alias("from"), F.col("to").alias("to"), F.col("weight").cast("double").alias("weight"))
    return v.groupBy("network_id").cogroup(e.groupBy("network_id")).applyInPandas(run, f"network_id string, drawing {'string' if kind == 'svg' else 'binary'}")


def file_name(name: str, extension: str) -> str:
    """name with the extension once, whatever its case was."""
    cut = len(extension) + 1
    return (name[:-cut] if name.lower().endswith("." + extension.lower()) else name) + "." + extension
