"""Drawings, project documents, edge lists."""

import json
import zlib

import pytest

from haploweave.sources import drawing as D
from haploweave.sources import project as P

V = [
    {"index": 0, "label": "a<b", "x": 0.0, "y": 0.0, "radius": 7.5, "frequency": 1.0, "inferred": False, "traits": [1.0, 2.0]},
    {"index": 1, "label": "c", "x": 100.0, "y": 0.0, "radius": 7.5, "frequency": 4.0, "inferred": False, "traits": [0.0, 2.0]},
    {"index": 2, "label": "2", "x": 50.0, "y": 80.0, "radius": 5.0, "frequency": 0.0, "inferred": True, "traits": None},
]
E = [{"index": 0, "from": 0, "to": 2, "weight": 1.0}, {"index": 1, "from": 2, "to": 1, "weight": 3.0}]


def test_svg():
    text = D.svg(V, E, {"traitNames": ["n", "s"], "zoom": 3}, export=True)
    assert text.index('class="edges"') < text.index('class="vertices"') < text.index('id="network-legend"')
    assert text.count("<path") == 2 and text.count('class="vertex-inferred"') == 1
    assert "a&lt;b" in text and ">2</text>" not in text  # inferred vertices have no label
    assert text.count('class="edge-label"') == 1 and "scale(" not in text
    assert "svg-background" not in D.svg(V, E, export=True, transparent=True)
    assert D.svg(V, E, {"edges": {"displayMode": "ticks"}}).count("edge-tick") == 4
    assert D.svg([], [], {}).startswith("<svg")
    assert "vertex-label" not in D.svg(V, E, {"showLabels": False})


def test_png_pdf():
    png = D.png(V, E, {"width": 60, "height": 40})
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and png[16:24] == (60).to_bytes(4, "big") + (40).to_bytes(4, "big")
    at = png.index(b"IDAT")
    size = int.from_bytes(png[at - 4 : at], "big")
    assert len(zlib.decompress(png[at + 4 : at + 4 + size])) == 40 * (60 * 4 + 1)
    pdf = D.pdf(V, E, {"traitNames": ["x", "y"]})
    assert pdf.startswith(b"%PDF-1.4") and pdf.endswith(b"%%EOF\n") and b"/MediaBox [0 0 1000 1000]" in pdf


def test_options_and_names():
    o = D.merged({"traitColors": ["#111111"], "showEdgeLabels": False, "labelOffsets": {"1": {"x": 1, "y": "2"}, "2": {"x": "q"}}})
    assert o["vertices"]["traitColors"] == ["#111111"] and o["edges"]["showLabels"] is False and o["labelOffsets"] == {"1": {"x": 1.0, "y": 2.0}}
    assert D.file_name("a.SVG", "svg") == "a.svg" and D.file_name("a", "svg") == "a.svg"
    assert D.fit_scale(1000, 1000, 100, 50) == 9 and D.fit_scale(10, 10, 1e9, 1) == 0.1


def test_project_round_trip(tmp_path):
    state = P.build_state(V, E, "TCS", {"epsilon": 1}, {"fontSize": 9}, "x/y.nex", masked=[3, 4])
    path = P.write_project(state, str(tmp_path / P.suggested_name("x/y.nex")))
    assert path.endswith("/y.hapnet")
    back = P.read_project(path)
    assert back["graph"] == state["graph"] and back["visualOptions"]["fontSize"] == 9 and back["maskedSites"] == 2 and back["hapNet"]["nseqs"] == 2
    with open(path) as f:
        assert f.read().startswith('{\n  "version": 1')
    with pytest.raises(TypeError):
        P.write_project({"x": object()}, str(tmp_path / "bad.hapnet"))
    assert not list(tmp_path.glob("bad*"))
    old = P.restore_state({"graph": {"vertices": [{"index": 1}, {"index": 0}], "edges": [{"index": 0, "from": 0, "to": 1}]}, "visual": {"fontSize": 7}})
    assert [v["index"] for v in old["graph"]["vertices"]] == [0, 1] and old["graph"]["edges"][0]["weight"] == 1 and old["visual"]["fontSize"] == 7


def test_autosave_history_route(tmp_path):
    slot = P.Autosave(str(tmp_path))
    assert slot.load() is None and not slot.exists()
    slot.save({"version": 1, "graph": None})
    slot.save({"version": 1, "algorithm": "MSN"})
    assert slot.load()["algorithm"] == "MSN"
    slot.clear()
    assert not slot.exists()
    graph = {"version": 1, "graph": {"vertices": [], "edges": []}}
    assert not slot.keep(graph) and not slot.exists()  # the period hasn't passed
    often = P.Autosave(str(tmp_path), period=0)
    assert not often.keep({"graph": None}) and often.keep(graph) and slot.exists()
    h = P.History(2)
    for k in range(4):
        h.record(k)
    assert [h.undo(9), h.undo(3), h.undo(2)] == [3, 2, 2] and h.redo(2) == 3
    assert (P.route("A.NEX"), P.route("b.hapnet")) == ("nexus", "project")
    for name in ("c.txt", "c.nexus", "nex"):
        with pytest.raises(ValueError, match="Unsupported"):
            P.route(name)


def test_spark_documents(spark, tmp_path):
    state = P.build_state([{"index": 1, "label": "b", "x": 1.0, "y": 2.0}, {"index": 0, "label": "a"}], [{"index": 0, "from": 0, "to": 1}])
    P.write_project(state, str(tmp_path / "one.hapnet"))
    docs, v, e = P.read_projects(spark, str(tmp_path))
    assert docs.first().algorithm == "MJN" and v.count() == 2 and e.first().weight == 1.0
    text = P.project_documents(v.select("network_id", "index", "label"), e.select("network_id", "index", "from", "to", "weight")).first().json
    assert [x["label"] for x in json.loads(text)["graph"]["vertices"]] == ["a", "b"]
    labelled = spark.createDataFrame([("n", 1, "b", 2, "c"), ("n", 0, "a", 1, "b")], "network_id string, edge_idx int, from_label string, weight int, to_label string")
    P.write_edge_lists(labelled, str(tmp_path / "out"))
    (part,) = (tmp_path / "out" / "network_id=n").glob("part*.txt")
    assert part.read_text() == "a\t1\tb\nb\t2\tc\n"


def test_drawings(spark):
    v = spark.createDataFrame([("n", x["index"], x["label"], x["x"], x["y"], x["radius"], x["frequency"], x["inferred"]) for x in V], "network_id string, index int, label string, x double, y double, radius double, frequency double, inferred boolean")
    e = spark.createDataFrame([("n", x["index"], x["from"], x["to"], x["weight"]) for x in E], "network_id string, index int, from int, to int, weight double")
    assert D.draw(v, e).first().drawing.startswith("<svg")
    assert bytes(D.draw(v, e, {"width": 20, "height": 20}, "png").first().drawing[:4]) == b"\x89PNG"


def test_model_snapshots(spark):
    from haploweave.operators import alignment as A
    from haploweave.plans import build

    rows = spark.createDataFrame([("n", i, chr(97 + i), s) for i, s in enumerate(["AC", "AC", "GC"])], "network_id string, taxon_idx int, taxon string, seq string")
    h = build.haplotypes(rows)
    snapshot = json.loads(P.model_snapshots(h, A.distances(h)).first().json)
    assert snapshot["nseqs"] == 2 and snapshot["distances"] == [{"i": 1, "j": 0, "d": 1}] and snapshot["haplotypes"][0]["originals"] == [0, 1]
