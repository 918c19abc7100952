"""JSON documents: workbooks, tracks and overlay layouts."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from ..errors import InputError
from ..operators.laps import Gate, Layout, Timing, Zone
from ..operators.tables import Table, TableCell, TableRow

#: Greatest versions understood.
WORKBOOK_VERSION, TRACK_VERSION = 2, 1


def versioned(text: str, key: str, most: int, default: int | None, label: str) -> dict:
    """A JSON object whose version is at most ``most``; unknown fields pass."""
    try:
        doc = json.loads(text)
        version = int(doc.get(key, default)) if doc.get(key, default) is not None else None
    except (ValueError, AttributeError, TypeError) as e:
        raise InputError("parse", f"{label}: {e}") from None
    if version is None:
        raise InputError("parse", f"{label}: no {key}")
    if version > most:
        raise InputError("unsupported_version", f"{label} version {version} is newer than {most}")
    return doc


@dataclass
class WorkbookTable:
    block_id: str
    worksheet: str
    placement: str
    overlay_target_id: str | None
    table: Table


@dataclass
class OverlayLayout:
    id: str
    name: str
    canvas: str
    elements: list[dict]

    def size(self) -> tuple[int, int]:
        """Width and height; 1920 x 1080 if the text has none."""
        parts = self.canvas.split("x")
        try:
            w, h = int(parts[0]), int(parts[1])
        except (ValueError, IndexError):
            return 1920, 1080
        return (w, h) if w > 0 and h > 0 else (1920, 1080)

    def channels(self) -> list[str]:
        """Names that the elements show, once each, in their order."""
        names = [n for e in self.elements for n in ([e["channel"]] if e["type"] in ("gauge", "attitude") else e.get("channels", []) if e["type"] == "trace_strip" else [])]
        return list(dict.fromkeys(names))


@dataclass
class Workbook:
    id: str
    name: str
    math_channels: list[tuple[str, str]] = field(default_factory=list)
    tables: list[WorkbookTable] = field(default_factory=list)
    layouts: list[OverlayLayout] = field(default_factory=list)

    def layout(self, name: str | None = None) -> OverlayLayout:
        for x in self.layouts:
            if name is None or x.name == name:
                return x
        raise InputError("parse", f"no overlay layout {name!r}; there are: {', '.join(x.name for x in self.layouts)}")

    def table(self, block_id: str) -> WorkbookTable:
        for x in self.tables:
            if x.block_id == block_id:
                return x
        raise InputError("parse", f"no table {block_id!r}; there are: {', '.join(x.block_id for x in self.tables)}")


def read_table(doc: dict) -> Table:
    columns = [(c["id"], c.get("name") or c["id"], c.get("template")) for c in doc["columns"]]
    rows = [TableRow(r["id"], (r.get("context") or {}).get("sessionId"), (r.get("context") or {}).get("lapIndex")) for r in doc["rows"]]
    cells = [[TableCell(c.get("formula"), c.get("literal"), c.get("name")) for c in row] for row in doc["cells"]]
    return Table(columns, rows, cells)


def read_workbook(text: str) -> Workbook:
    doc = versioned(text, "workbook_version", WORKBOOK_VERSION, 1, "workbook")
    try:
        out = Workbook(doc["workbook_id"], doc["name"], [(m["name"], m["expression"]) for m in doc.get("math_channels", [])])
        for sheet in doc.get("worksheets", []):
            for b in sheet.get("blocks", []):
                if b["content"]["kind"] == "table":
                    out.tables.append(WorkbookTable(b.get("id", ""), sheet.get("name", ""), b.get("placement", ""), b.get("overlayTargetId"), read_table(b["content"]["table"])))
        out.layouts = [OverlayLayout(x["id"], x["name"], x["canvas"], x["elements"]) for x in doc.get("overlay_layouts", [])]
    except (KeyError, TypeError) as e:
        raise InputError("parse", f"workbook: {e!r} is missing or wrong") from None
    return out


@dataclass
class TrackArtifact:
    id: str
    name: str
    venue: str
    layout: Layout | None
    polyline: list[tuple[float, float]]
    warnings: list[str]


def read_track(text: str) -> TrackArtifact:
    """A track. Coordinates are taken as they are: in the scale of the GPS channels (degrees x 1e7); values that look
    like plain degrees are reported as a warning."""
    doc = versioned(text, "track_artifact_version", TRACK_VERSION, None, "track artifact")
    try:
        t = doc["track"]
        gate = lambda g: Gate(g["lat1_deg"], g["lon1_deg"], g["lat2_deg"], g["lon2_deg"])
        timing = t.get("lap_timing")
        layout = None
        if timing:
            kind = timing["kind"]
            made = Timing("circuit", gate(timing["start_finish"])) if kind == "circuit" else Timing("point_to_point", gate(timing["start"]), gate(timing["finish"]))
            layout = Layout(made, tuple((s["name"], gate(s["gate"])) for s in t.get("sector_gates", [])), tuple(Zone(z.get("name", ""), gate(z["enter"]), gate(z["exit"])) for z in t.get("neutral_zones", [])))
        line = [(p["latitude_deg"], p["longitude_deg"]) for p in t.get("reference_polyline", [])]
    except (KeyError, TypeError) as e:
        raise InputError("parse", f"track artifact: {e!r} is missing or wrong") from None
    small = [x for p in line for x in p if x and abs(x) <= 180]
    return TrackArtifact(t.get("track_id", ""), t.get("name", ""), t.get("venue_name", ""), layout, line, ["coordinates look like plain degrees"] if small else [])
