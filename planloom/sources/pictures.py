"""Pictures: frames read from folders by their numbers, plans and connection diagrams drawn from documents, and pages to look at clouds."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import results as rs
from ..storage import keyed
from .captures import cap_points
from .clouds import located

C = F.col

# --- frames -----------------------------------------------------------------------------------------------------------


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Opens the files of the rows, one after another."""
    for batch in batches:
        for i, path in enumerate(batch.column("path").to_pylist()):
            system, at = located(path)
            with system.open_input_stream(at) as file:
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in batch.columns), pa.array([file.read()], pa.binary())], [*batch.schema.names, "content"])


def _names(root: str) -> Iterator[pa.RecordBatch]:
    """The captures' folders below ``root``."""
    system, at = located(root)
    names = [f.base_name for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.Directory and not f.base_name.startswith(("_", "."))]
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["capture_id"])


def _pictures(batches: Iterator[pa.RecordBatch], root: str, folder: str) -> Iterator[pa.RecordBatch]:
    """The files of captures, a folder after another."""
    system, at = located(root)
    for batch in batches:
        for capture in batch.column("capture_id").to_pylist():
            found = system.get_file_info(fs.FileSelector(f"{at}/{capture}/{folder}", allow_not_found=True))
            names = [f.base_name for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
            yield pa.RecordBatch.from_arrays([pa.array([capture] * len(names), pa.string()), pa.array(names, pa.string()), pa.array([f"{root}/{capture}/{folder}/{x}" for x in names], pa.string())], ["capture_id", "name", "path"])


def read_frames(spark: SparkSession, root: str, wanted: DataFrame | None = None, folder: str = "rgb") -> DataFrame:
    """Pictures ``root``/<capture>/rgb/<number>.<suffix> in order of capture and number: capture_id, frame, path, content.

    With ``wanted`` (capture_id, frame) only those are opened: names are listed, without contents, and met with the wanted numbers first. Files whose names are no numbers are passed over.
    Tasks list the folders of the wanted captures (of all, by their names, where none are told), so no listing goes through the driver.
    """
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    if wanted is None:
        captures = spark.range(1, numPartitions=1).mapInArrow(lambda _: _names(root), "capture_id string")
    else:
        wanted = wanted.select(C("capture_id").cast("string").alias("capture_id"), C("frame").cast("long").alias("frame")).distinct()
        captures = wanted.select("capture_id").where("capture_id is not null").distinct()
    listed = captures.repartition(n, "capture_id").mapInArrow(lambda batches: _pictures(batches, root, folder), "capture_id string, name string, path string")
    number = F.regexp_extract("name", r"^(\d+)\.[A-Za-z]+$", 1)
    own = listed.where(number != "").select("capture_id", number.cast("long").alias("frame"), "path")
    if wanted is not None:
        own = own.join(keyed(wanted), ["capture_id", "frame"], "left_semi")
    dealt = own.repartitionByRange(n, "capture_id", "frame").sortWithinPartitions("capture_id", "frame")
    return dealt.mapInArrow(_contents, "capture_id string, frame long, path string, content binary")


# --- clouds to look at ------------------------------------------------------------------------------------------------

#: Points of a page at most.
PAGE_POINTS = 1_500_000
PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title></head><body style="margin:0;background:#111;color:#ccc">
<p>{count} points, {low} to {high} m; drag to turn, wheel to zoom, cut at <input id="cut" type="range" min="{low}" max="{high}" step="0.05" value="{high}"></p><canvas id="view" width="1200" height="800"></canvas>
<script id="points" type="application/octet-stream">{data}</script>
<script>
const raw = Uint8Array.from(atob(document.getElementById("points").textContent), c => c.charCodeAt(0)), n = {count};
const at = new Float32Array(raw.buffer, 0, 3 * n), ink = raw.subarray(12 * n), view = document.getElementById("view"), pen = view.getContext("2d");
let turn = 0.6, tip = 0.5, zoom = 60, mid = [0, 0, 0];
for (let i = 0; i < 3 * n; i++) mid[i % 3] += at[i] / n;
function draw() {{
  const w = view.width, h = view.height, shot = pen.createImageData(w, h), deep = new Float32Array(w * h).fill(1e9), top = +document.getElementById("cut").value;
  for (let i = 0; i < n; i++) {{
    if (at[3 * i + 1] > top) continue;
    const x = at[3 * i] - mid[0], y = at[3 * i + 1] - mid[1], z = at[3 * i + 2] - mid[2], a = x * Math.cos(turn) - z * Math.sin(turn), b = x * Math.sin(turn) + z * Math.cos(turn);
    const u = Math.round(w / 2 + zoom * a), v = Math.round(h / 2 - zoom * (y * Math.cos(tip) - b * Math.sin(tip))), far = b * Math.cos(tip) + y * Math.sin(tip), k = v * w + u;
    if (u < 0 || v < 0 || u >= w || v >= h || far >= deep[k]) continue;
    deep[k] = far; shot.data.set([ink[3 * i], ink[3 * i + 1], ink[3 * i + 2], 255], 4 * k);
  }}
  pen.putImageData(shot, 0, 0);
}}
view.onmousemove = e => {{ if (e.buttons) {{ turn += e.movementX / 200; tip += e.movementY / 200; draw(); }} }};
view.onwheel = e => {{ zoom *= e.deltaY < 0 ? 1.1 : 0.9; draw(); }};
document.getElementById("cut").oninput = draw; draw();
</script></body></html>"""


def cloud_pages(points: DataFrame, key: str = "capture_id", most: int = PAGE_POINTS, keys: tuple[str, ...] = ("ord", "line")) -> DataFrame:
    """A page to look at each capture's cloud: capture_id, n, html. Of larger clouds it has ``most`` points, those of the smallest hashes.

    Places are packed as single floats and colours as bytes, in base64. A page's points are bounded by ``most``, so a group fits its task.
    """
    kind = dict(points.dtypes)[key]
    kept = cap_points(points, most, keys=keys, by=[key]).select(key, *dict.fromkeys((*keys, *"xyzrgb")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(keys), kind="stable")
        place, ink = pdf[list("xyz")].to_numpy("<f4"), np.clip(pdf[list("rgb")].to_numpy(), 0, 255).astype(np.uint8)
        data = base64.b64encode(np.ascontiguousarray(place).tobytes() + np.ascontiguousarray(ink).tobytes()).decode()
        html = PAGE.format(title=pdf[key].iloc[0], count=len(pdf), low=f"{place[:, 1].min():.2f}", high=f"{place[:, 1].max():.2f}", data=data)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "n": [len(pdf)], "html": [html]})

    return kept.groupBy(key).applyInPandas(run, f"{key} {kind}, n long, html string")


def points_of_pages(pages: DataFrame, key: str = "capture_id") -> DataFrame:
    """The points that pages hold: capture_id, x, y, z, r, g, b."""
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ident, html in zip(pdf[key], pdf["html"], strict=True):
                raw = base64.b64decode(html.split('octet-stream">', 1)[1].split("<", 1)[0])
                n = len(raw) // 15
                place, ink = np.frombuffer(raw, "<f4", 3 * n).reshape(n, 3), np.frombuffer(raw, np.uint8, 3 * n, 12 * n).reshape(n, 3)
                yield pd.DataFrame({key: ident, **{c: place[:, i].astype(float) for i, c in enumerate("xyz")}, **{c: ink[:, i].astype(float) for i, c in enumerate("rgb")}})

    return pages.select(key, "html").mapInPandas(run, f"{key} {kind}, x double, y double, z double, r double, g double, b double")


# --- plans ------------------------------------------------------------------------------------------------------------

#: Pixels of a metre, around a plan and above it, and the least wall (metres) whose length is written.
METRE, MARGIN, HEAD, LABELLED = 80, 60, 70, 0.5
#: Width, height and distance of a diagram's boxes, and its border.
BOX_W, BOX_H, GAP, BORDER = 260, 120, 90, 40
STYLE = "<style>.room{fill:#eef}.wall{stroke:#222;stroke-width:4}.guess{stroke:#999;stroke-width:4;stroke-dasharray:6}.gap{stroke:#fff;stroke-width:7}.door{stroke:#b60;stroke-width:2}text{font:12px sans-serif;text-anchor:middle}.head{text-anchor:start}.link{stroke:#b60;stroke-width:3}.box{fill:#eef;stroke:#222}</style>"


def _text(x: Column, y: Column, said: Column, kind: str) -> Column:
    safe = F.replace(F.replace(F.replace(said, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.format_string(f'<text class="{kind}" x="%.0f" y="%.0f">', x, y), safe, F.lit("</text>"))


def _parsed(docs: DataFrame) -> DataFrame:
    return docs.select("capture_id", F.from_json("document", rs.DOCUMENT).alias("d"))


def plan_panels(docs: DataFrame) -> DataFrame:
    """Drawings of the plans of documents, one for each segment (0: documents without segments): capture_id, segment, svg.

    Rooms are filled; walls that were found are drawn full, others dashed; doors cut the wall and carry their width; walls of half a metre and more carry their length, with a question mark where
    they weren't found; each room its name, sizes, area with range and ceiling. A metre is drawn to scale. A panel has the doors that touch any of its rooms. Rooms without outlines aren't drawn; a panel
    without any says so.
    """
    d = _parsed(docs)
    tier = d.select("capture_id", C("d.capture.tier").alias("tier"), C("d.property.total_floor_area").alias("total"), F.size("d.rooms").alias("many"))
    rooms = d.select("capture_id", F.posexplode("d.rooms").alias("n", "r")).select("capture_id", F.coalesce("r.segment", F.lit(0)).alias("segment"), "n", "r").where("r.outline is not null")
    ids = rooms.select("capture_id", "segment", C("r.id").alias("room"))
    doors = d.select("capture_id", F.posexplode("d.openings").alias("n", "o"))
    met = doors.select("capture_id", "n", F.explode("o.rooms").alias("room")).join(keyed(ids), ["capture_id", "room"]).select("capture_id", "segment", "n").distinct().join(keyed(doors), ["capture_id", "n"])
    key = ["capture_id", "segment"]
    at = lambda p: F.struct(p[0].alias("x"), p[1].alias("z"))
    corners = rooms.select(*key, F.explode("r.outline").alias("p")).unionByName(met.select(*key, F.explode(F.array("o.start", "o.end")).alias("p"))).select(*key, at(C("p")).alias("p"))
    frame = corners.groupBy(*key).agg(F.min("p.x").alias("x0"), F.max("p.x").alias("x1"), F.min("p.z").alias("z0"), F.max("p.z").alias("z1"))
    px = lambda x: F.round((x - C("x0")) * METRE + MARGIN)
    pz = lambda z: F.round((z - C("z0")) * METRE + MARGIN + HEAD)
    line = lambda kind, a, b, ident=F.lit(""): F.concat(F.lit(f'<line class="{kind}" id="'), ident, F.format_string('" x1="%.0f" y1="%.0f" x2="%.0f" y2="%.0f"/>', px(a[0]), pz(a[1]), px(b[0]), pz(b[1])))
    # layers: fills, walls, doors, lengths, labels
    r = rooms.join(keyed(frame), key)
    fill = r.select(*key, F.lit(0).alias("layer"), "n", F.lit(0).alias("k"), F.concat(F.lit('<polygon class="room" id="'), C("r.id"), F.lit('" points="'), F.array_join(F.transform("r.outline", lambda p: F.format_string("%.0f,%.0f", px(p[0]), pz(p[1]))), " "), F.lit('"/>')).alias("e"))
    w = r.select(*key, "n", "x0", "z0", C("r.outline").alias("ring"), F.posexplode("r.walls").alias("k", "w"))
    walls = w.select(*key, F.lit(1).alias("layer"), "n", "k", F.when(C("w.detected"), line("wall", C("w.start"), C("w.end"), C("w.id"))).otherwise(line("guess", C("w.start"), C("w.end"), C("w.id"))).alias("e"))
    o = met.join(keyed(frame), key)
    middle = lambda a, b: ((px(a[0]) + px(b[0])) / 2, (pz(a[1]) + pz(b[1])) / 2)
    mx, mz = middle(C("o.start"), C("o.end"))
    cut = o.select(*key, F.lit(2).alias("layer"), "n", F.lit(0).alias("k"), F.concat(line("gap", C("o.start"), C("o.end")), line("door", C("o.start"), C("o.end"), C("o.id")), _text(mx, mz - 12, F.format_string("%.2f", "o.width.value"), "width")).alias("e"))
    mean = lambda axis, ring=None: F.aggregate("ring" if ring is None else ring, F.lit(0.0), lambda s, p: s + p[axis]) / F.size("ring" if ring is None else ring)
    wx, wz = middle(C("w.start"), C("w.end"))
    ix, iz = px(mean(0)) - wx, pz(mean(1)) - wz
    long = F.hypot(ix, iz) + 1e-9
    length = F.concat(F.format_string("%.2f", "w.length.value"), F.when(C("w.detected"), "").otherwise("?"))
    lengths = w.where(C("w.length.value") >= LABELLED).select(*key, F.lit(3).alias("layer"), "n", "k", _text(wx + 16 * ix / long, wz + 16 * iz / long, length, "length").alias("e"))
    cx, cz = px(mean(0, "r.outline")), pz(mean(1, "r.outline"))
    ceiling = F.when(C("r.ceiling_height.value").isNotNull(), F.format_string("ceiling %.2f m", "r.ceiling_height.value")).otherwise("ceiling not seen")
    named = F.element_at(F.split("r.name", r" \("), 1)
    said = F.posexplode(F.array(named, F.format_string("%.2f x %.2f m", "r.width.value", "r.length.value"), F.format_string("%.1f m2 +-%.1f", "r.floor_area.value", "r.floor_area.pm95"), ceiling)).alias("k", "said")
    labels = r.select(*key, "n", cx.alias("cx"), cz.alias("cz"), said).select(*key, F.lit(4).alias("layer"), "n", "k", _text(C("cx"), C("cz") - 24 + 17 * C("k"), C("said"), "label").alias("e"))
    drawn = fill.unionByName(walls).unionByName(cut).unionByName(lengths).unionByName(labels)
    body = drawn.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("layer", "n", "k", "e"))), lambda x: x["e"]), "").alias("body"))
    wide, high = F.round((C("x1") - C("x0")) * METRE + 2 * MARGIN), F.round((C("z1") - C("z0")) * METRE + 2 * MARGIN + HEAD)
    head = F.concat(F.initcap("tier"), F.lit(" plan"), F.when(C("segment") > 0, F.format_string(", segment %d", "segment")).otherwise(""))
    panels = body.join(keyed(frame), key).join(keyed(tier), "capture_id")
    bar = F.concat(F.format_string(f'<line class="wall" id="scale" x1="20" y1="%.0f" x2="{20 + METRE}" y2="%.0f"/>', high - 20, high - 20), _text(F.lit(20 + METRE / 2), high - 28, F.lit("1 m"), "scale"))
    svg = F.concat(F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%.0f" height="%.0f">', wide, high), F.lit(STYLE), _text(F.lit(20.0), F.lit(30.0), head, "head"), "body", bar, F.lit("</svg>"))
    none = tier.join(keyed(ids.select("capture_id").distinct()), "capture_id", "left_anti").select("capture_id", F.lit(0).alias("segment"), F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" width="600" height="300">{STYLE}<text class="head" x="300" y="150">No rooms found</text></svg>').alias("svg"))
    return panels.select(*key, svg.alias("svg")).unionByName(none)


def diagrams(docs: DataFrame) -> DataFrame:
    """Connection diagrams of documents whose rooms have no common plan: capture_id, svg. A box a room, in rows and columns, and a line for each pair of rooms that something joins."""
    d = _parsed(docs)
    n = F.size("d.rooms")
    cols = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double"))).cast("int"))
    boxes = d.select("capture_id", cols.alias("cols"), F.posexplode("d.rooms").alias("n", "r"))
    place = lambda i: (BORDER + i % C("cols") * (BOX_W + GAP), HEAD + BORDER + F.floor(i / C("cols")) * (BOX_H + GAP))
    x, y = place(C("n"))
    boxes = boxes.select("capture_id", "n", C("r.id").alias("room"), "r", x.cast("double").alias("x"), y.cast("double").alias("y"))
    size = F.when(C("r.floor_area.value").isNotNull(), F.format_string("%.2f x %.2f m, %.1f m2 +-%.1f", "r.width.value", "r.length.value", "r.floor_area.value", "r.floor_area.pm95")).otherwise(F.coalesce("r.floor_area.note", F.lit("not measured")))
    drawn = boxes.select("capture_id", F.lit(1).alias("layer"), "n", F.concat(F.lit('<rect class="box" id="'), "room", F.format_string(f'" x="%.0f" y="%.0f" width="{BOX_W}" height="{BOX_H}"/>', "x", "y"), _text(C("x") + BOX_W / 2, C("y") + 30, C("r.name"), "name"), _text(C("x") + BOX_W / 2, C("y") + 60, size, "size")).alias("e"))
    links = d.select("capture_id", F.posexplode("d.adjacency").alias("n", "a"))
    mid = boxes.select("capture_id", "room", (C("x") + BOX_W / 2).alias("x"), (C("y") + BOX_H / 2).alias("y"))
    end = lambda i, side: mid.select("capture_id", C("room").alias(f"room{side}"), C("x").alias(f"x{side}"), C("y").alias(f"y{side}"))
    j = links.select("capture_id", "n", C("a.rooms")[0].alias("room1"), C("a.rooms")[1].alias("room2")).join(end(0, 1), ["capture_id", "room1"]).join(end(1, 2), ["capture_id", "room2"])
    lines = j.select("capture_id", F.lit(0).alias("layer"), "n", F.concat(F.lit('<line class="link" id="'), "room1", F.lit("-"), "room2", F.format_string('" x1="%.0f" y1="%.0f" x2="%.0f" y2="%.0f"/>', "x1", "y1", "x2", "y2")).alias("e"))
    body = lines.unionByName(drawn).groupBy("capture_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("layer", "n", "e"))), lambda x: x["e"]), "").alias("body"))
    sized = d.select("capture_id", (2 * BORDER + cols * (BOX_W + GAP)).alias("w"), (HEAD + BORDER + F.greatest(F.lit(1), F.ceil(n / cols)) * (BOX_H + GAP)).alias("h"))
    svg = F.concat(F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%d" height="%d">', C("w").cast("int"), C("h").cast("int")), F.lit(STYLE), _text(F.lit(20.0), F.lit(30.0), F.lit("Rooms and what joins them; not to scale"), "head"), F.coalesce("body", F.lit("")), F.lit("</svg>"))
    return sized.join(body, "capture_id", "left").select("capture_id", svg.alias("svg"))


def elements(pictures: DataFrame, *keys: str) -> DataFrame:
    """The elements of drawings, to look things up in them: keys, tag, class, id, said (a text's), numbers (coordinates, joined)."""
    found = F.explode(F.regexp_extract_all("svg", F.lit(r"<(?:line|rect|polygon)[^>]*/>|<text[^>]*>[^<]*</text>"), F.lit(0))).alias("e")
    part = lambda p: F.regexp_extract("e", p, 1)
    numbers = F.array_join(F.regexp_extract_all("e", F.lit(r'(?:x|y|x1|y1|x2|y2|points)="([^"]*)"'), F.lit(1)), " ")
    return pictures.select(*keys, found).select(*keys, part("^<([a-z]+)").alias("tag"), part('class="([^"]*)"').alias("class"), part(' id="([^"]*)"').alias("id"), part(">([^<]*)</text>").alias("said"), numbers.alias("numbers"))


