import json
import tempfile

from conftest import rows
from pyspark.sql import functions as F

from inkframe.functions import dictionaries as D
from inkframe.functions import text as T
from inkframe.operators import edits as E
from inkframe.operators import layout as L
from inkframe.operators import raster as R
from inkframe.sources import images, projects, scripts


def test_project_defaults_and_rejects(spark):
    page = {"source": {"width_px": 100, "height_px": 50}, "tree_lines": [[0, 0, 10, 2, 1], [5, 0, 6, 9, 1]], "chars": [{"text": "公", "cx": 1, "cy": 2, "bbox": [0, 0, 2, 4]}]}
    docs = [
        ("a", json.dumps({"app": "x", "version": "2.1", "name": "", "pages": [page, {"source": {"name": "n"}}]})), ("b", "{not json"),
        ("c", json.dumps({"app": "y", "version": "2.0", "pages": []})), ("d", json.dumps({"app": "x", "version": "3.0", "pages": []})),
    ]
    t, bad = projects.parse_projects(spark.createDataFrame(docs, "project_id string, json string"), "x")
    assert rows(bad) == [("b", "not json"), ("c", "not a project file"), ("d", "unsupported version")]
    assert rows(t["page"], "idx", "status", "src_name", "px_per_mm") == [(0, "proofread", "page-1", 0.0), (1, "imported", "n", 0.0)]
    g = t["glyph"].first()
    assert (g["note"], g["source"], g["grp"], g["kind"], g["conf"], g["x1"]) == ("ok", "manual", "body", "text", 0.0, 2.0)
    assert [r[1] for r in rows(t["line"], "ord", "orientation")] == ["h", "v"]
    out = tempfile.mkdtemp(prefix="spark-")
    projects.write_projects(t, out, "x")
    again, bad = projects.read_projects(spark, out + "/*", "x")
    assert bad.count() == 0 and rows(again["glyph"].drop("project_id")) == rows(t["glyph"].drop("project_id"))
    text = "".join(r["value"] for r in spark.read.text(out).collect())
    assert "key" not in text.lower() and "image_path" not in text


def test_script_round_trip_and_reject(spark):
    code = "PX_PER_MM = 10\nPAGENO_PT = 9\nBODY_PT = 12\nBORDER_RECTS = [(1, 2, 3, 4, \"R000\"),]\nTEXT_CHARS = [(\"a\\\"(\", 5, 6.5, BODY_PT, \"排行\"), (None, 1, 2, 3, \"C1\")]\nSIDE_CHARS = [(\"一\", 1, 1, 9, \"S\")]\n"
    df = spark.createDataFrame([("ok", code), ("no", "nothing here")], "f string, code string")
    pages, items, bad = scripts.extract_script_tables(df, "f", "code")
    assert rows(bad) == [("no",)] and pages.first()["px_per_mm"] == 10.0
    got = {(r["section"], r["ord"]): r for r in items.collect()}
    a = got[("TEXT_CHARS", 0)]
    assert (a["text"], a["n1"], a["n2"], a["pt"], a["grp"]) == ('a"(', 5.0, 6.5, 12.0, "rank") and abs(a["half"] - 12 * 10 / 2.8346) < 1e-9
    assert got[("TEXT_CHARS", 1)]["text"] is None and got[("SIDE_CHARS", 0)]["grp"] == "pageno" and got[("BORDER_RECTS", 0)]["n3"] == 4.0


def test_script_defaults_brackets_and_escapes(spark):
    texts = ["]", "a]b)", "[(", "\n\t\x7f\x01", "公\\", '"', "'", "", "x" * 20_000]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "page_id long, ord long, text string")
    made = [r[0] for r in df.orderBy("ord").select(scripts.py_string(F.col("text"))).collect()]
    glyphs = ", ".join(f'({m}, {i}, 2, 7.5, "C{i}")' for i, m in enumerate(made))
    page = '{ "BORDER_RECTS": [(1, 2, 3, 4, "]R")], "TEXT_CHARS": [' + glyphs + '], "SIDE_CHARS": [("\\u516c\\n", 1, 1, 9, "S")] }'
    files = spark.createDataFrame([("two", f"PAGES = [{page}, {page}]"), ("open", "BORDER_RECTS = ((1, 2, 3, 4, \"R\"),)\nTEXT_CHARS = []\n")], "f string, code string")
    pages, items, bad = scripts.extract_script_tables(files, "f", "code")
    assert bad.count() == 0
    assert rows(pages, "f", "idx", "width", "height", "px_per_mm", "body_pt") == [("open", 0, 1200.0, 1600.0, 11.811, 0.0), ("two", 0, 1200.0, 1600.0, 11.811, 7.5), ("two", 1, 1200.0, 1600.0, 11.811, 7.5)]
    got = items.where("f = 'two' and section = 'TEXT_CHARS'").orderBy("idx", "ord").collect()
    assert [r["text"] for r in got] == texts * 2
    assert items.where("f = 'two' and section = 'SIDE_CHARS'").first()["text"] == "公\n"
    assert items.where("f = 'open'").count() == 1


def test_literals(spark):
    df = spark.createDataFrame([('a"\\\n\x7f公', 1.5), ("b", -0.00049), ("c", 12345678.1239)], "s string, n double")
    got = [(r[0], r[1]) for r in df.select(scripts.py_string(F.col("s")), scripts.number_text(F.col("n"))).collect()]
    assert got == [('"a\\"\\\\\\x0a\\x7f公"', "1.5"), ('"b"', "0"), ('"c"', "12345678.124")]


def test_images_to_gray(spark):
    data = bytes([10, 20, 30, 255, 255, 255, 0, 0, 0, 1, 2, 3])
    df = spark.createDataFrame([(1, 2, 2, 3, bytearray(data))], "page_id long, height int, width int, channels int, data binary")
    gray = lambda b, g, r: (r * 299 + g * 587 + b * 114) // 1000
    assert rows(images.explode_pixels(df, ["page_id"]), "y", "x", "gray") == [(0, 0, gray(10, 20, 30)), (0, 1, 255), (1, 0, 0), (1, 1, gray(1, 2, 3))]


def test_image_folder_keeps_images_only(spark):
    import struct
    import zlib

    def png(path, w=2, h=1):
        raw = b"".join(b"\0" + bytes([200, 100, 50] * w) for _ in range(h))
        chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
        with open(path, "wb") as f:
            f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))

    d = tempfile.mkdtemp(prefix="spark-")
    png(f"{d}/a.png")
    open(f"{d}/b.txt", "w").write("x")
    open(f"{d}/c.png", "wb").write(b"broken")
    open(f"{d}/e.webp", "wb").write(b"RIFF0000WEBPVP8 ")
    img, bad = images.read_page_images(spark, d)
    assert img.count() == 1 and sorted(r["origin"].rsplit("/", 1)[1] for r in bad.collect()) == ["c.png", "e.webp"]
    px = rows(images.explode_pixels(img.withColumn("page_id", F.lit(1)), ["page_id"]), "gray")
    assert px == [((200 * 299 + 100 * 587 + 50 * 114) // 1000,)] * 2


def test_run_store(spark, tables):
    from inkframe import bindings as B

    d = tempfile.mkdtemp(prefix="spark-")
    runs = B.runs(tables).withColumn("project_id", F.col("page_id") % 2)
    images.write_runs(runs, d)
    assert images.read_runs(spark, d, 1).count() == runs.where("project_id = 1").count()


def test_lint(spark):
    bad = "import x\nif (a:\n\tb = ']'  # ) not counted\nc = {1]\nd = \"open"
    df = spark.createDataFrame([(1, bad), (2, "\ufeffx = '''a\n(''' \r\n"), (3, "ok = [1, (2)]\nmain()\x01")], "id long, t string")
    got = rows(T.lint_text(df, "id", "t", ["main()"]), "id", "rule", "line")
    assert (1, "tab_indent", 3) in got and (1, "unclosed", 2) in got and (1, "unmatched", 4) in got and (1, "open_string", 5) in got and (1, "missing_anchor", None) in got
    assert (2, "bom", None) in got and (2, "carriage_return", None) in got and not [g for g in got if g[0] == 2 and g[1] in ("unclosed", "open_string")]
    assert [g for g in got if g[0] == 3] == [(3, "control_char", 2)]


def test_json_and_guides(spark):
    df = spark.createDataFrame([(1, 'x ```json\n{"a": 1}\n``` y'), (2, "pre {\"a\": {\"b\": 2}} post"), (3, "none"), (4, None)], "id long, t string")
    assert [r[0] for r in df.select(T.extract_json(F.col("t"))).collect()] == ['{"a": 1}', '{"a": {"b": 2}}', None, None]
    g = {"confidence": 7, "rules": list("abcdefghij"), "frame": {"hasOuterFrame": True, "thicknessPx": 0.2}, "borderBars": [{"role": "odd", "side": "up", "x": -1, "y": "0.5", "w": "NaN", "h": 2, "confidence": 0.4}]}
    frames, items = L.parse_guides(spark.createDataFrame([(1, json.dumps(g))], "page_id long, g string"), "g", ["page_id"])
    f, b = frames.first(), items.first()
    assert f["confidence"] == 1.0 and len(f["rules"]) == 8 and f["has_outer_frame"] and f["thickness_px"] == 1.0 and f["inset_top"] is None
    assert (b["kind"], b["side"], b["x"], b["y"], b["w"], b["h"]) == ("frame", None, 0.0, 0.5, 0.0, 1.0)


def test_dictionaries(spark):
    df = spark.createDataFrame([("孑", ["子", "x"]), (None, ["公"])], "p string, e array<string>")
    got = [r[0] for r in D.expand_candidates(df, "p", "e").select("expanded").collect()]
    assert got[0][:3] == ["孑", "子", "孓"] and got[1] == ["公"]
    one = spark.createDataFrame([("張國", "万")], "t string, s string").select(D.to_simplified(F.col("t")), D.to_traditional(F.col("s"))).first()
    assert tuple(one) == ("张国", "萬")
    assert spark.range(1).select(T.fnv1a(F.lit("")), T.fnv1a(F.lit("a")), T.fnv1a(F.lit("\U00020000"))).first()[:2] == ("811c9dc5", "e40c292c")


def test_undo_redo(spark):
    ops = ["do", "do", "undo", "do", "undo", "redo", "undo", "undo", "undo", "redo"]
    e = spark.createDataFrame([(1, i, o) for i, o in enumerate(ops)] + [(2, i, "do") for i in range(5)], "page_id long, seq long, op string")
    got = {(r[0], r[1]): r[2] for r in rows(E.effective_edits(e))}
    assert got == {(1, 0): True, (1, 1): False, (1, 3): False, **{(2, i): True for i in range(5)}}
    # only the newest command can be undone
    e = spark.createDataFrame([(1, i, o) for i, o in enumerate(["do", "do", "undo", "undo", "undo"])], "page_id long, seq long, op string")
    assert rows(E.effective_edits(e, limit=1), "seq", "effective") == [(0, True), (1, False)]


def test_replay(spark):
    base = spark.createDataFrame([(1, 1, "a", 10.0, 0.0, 0.0), (1, 2, "b", 10.0, 5.0, 5.0)], "page_id long, target long, text string, pt double, x double, y double")
    ev = [(1, 1, 1, "shift", None, None, 2.0, 0.0), (1, 1, 2, "set", "c", None, None, None), (1, 1, 3, "shift", None, None, 3.0, 1.0), (1, 2, 4, "remove", None, None, None, None), (1, 3, 5, "add", "n", 8.0, 1.0, 1.0), (1, 3, 6, "set", None, None, 7.0, None), (1, 3, 7, "shift", None, None, 1.0, 1.0)]
    e = spark.createDataFrame(ev, "page_id long, target long, seq long, kind string, text string, pt double, x double, y double")
    assert rows(E.replay(e, base), "target", "text", "pt", "x", "y", "edited") == [(1, "c", 10.0, 5.0, 1.0, True), (3, "n", 8.0, 8.0, 2.0, True)]
