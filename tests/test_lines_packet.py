"""Cases of the line and packet rules that the tables don't hold, by values worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from pagemill.operators import layout, lines, packet


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def _pieces(spark, text, xs, gap=22.0):
    return [(p.text, p.x) for p in one(spark, lines.positioned_pieces(F.lit(text), F.array(*[F.lit(float(x)) for x in xs]) if xs else F.array().cast("array<double>"), gap))]


def test_positioned_pieces(spark):
    assert _pieces(spark, "ab cd", [0, 5, 10, 50, 55]) == [("ab ", 0.0), ("cd", 50.0)]
    assert _pieces(spark, "  cd", [0, 30, 60, 65]) == [("  cd", 0.0)]  # what would be cut off is blank
    assert _pieces(spark, "ab  ", [0, 5, 40, 45]) == [("ab", 0.0)]  # a blank end goes
    assert _pieces(spark, "abc", [7]) == [("abc", 7.0)] and _pieces(spark, "abc", []) == [("abc", 0.0)]
    assert _pieces(spark, "abc", [1, 2]) == [("abc", 1.0)] and _pieces(spark, "   ", [3, 60, 90]) == [("   ", 3.0)]


def test_line_edges(spark):
    kind = "array<struct<text:string,x:double,size:double,width:double>>"
    line = lambda s: F.from_json(F.lit(json.dumps(s)), kind)
    got = one(spark, lines.line_edges(line([{"text": "abcd", "x": 10, "size": 10}, {"text": "ab", "width": 7}, {"text": " "}])))
    assert (got.left, got.right) == (10.0, 37.0)  # 10 + 4 * 5, then from there on 7
    got = one(spark, lines.line_edges(line([{"text": "abcd"}])))
    assert (got.left, got.right) == (0.0, 20.0)
    assert one(spark, lines.paragraph_right(F.array().cast(f"array<{kind}>"))) == 0.0
    assert one(spark, lines.paragraph_right(F.array(line([{"text": "abcd", "x": 1, "width": 900}])))) == 21.0  # widths aren't read


def test_paragraph_lines(spark):
    rows = [(1, 0, "a", 1.0), (1, 1, " ", 9.0), (1, 2, "b", None), (1, 3, "c", 1.0), (1, 4, "d", 2.0), (1, 5, "e", None), (2, 0, "f", None), (2, 1, "g", 3.0)]
    got = lines.paragraph_lines(spark.createDataFrame(rows, "p long, ord long, text string, y double"), ["p"], "ord").orderBy("p", "ord").collect()
    assert [(r.text, r.line) for r in got] == [("a", 0), ("b", 0), ("c", 0), ("d", 1), ("e", 1), ("f", 0), ("g", 0)]


def test_breaks_and_groups(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    long_ = "a long line of prose that goes on and on, well beyond what counts as a short line here"
    assert one(spark, lines.keeps_breaks(arr("• one", "● two"))) and one(spark, lines.keeps_breaks(arr("Owl — 3", "Bat — 4", long_)))
    assert not one(spark, lines.keeps_breaks(arr(long_, long_))) and not one(spark, lines.keeps_breaks(arr("Cost:")))
    assert one(spark, lines.keeps_breaks(arr(long_, long_), F.lit(7), (7, 8))) and not one(spark, lines.keeps_breaks(arr(long_, long_), F.lit(9), (7, 8)))
    assert one(spark, lines.keeps_breaks(F.array_repeat(F.lit("short"), 8))) and not one(spark, lines.keeps_breaks(arr("short", "also short", "and this", long_)))
    rows = [(1, 0, "12-15", 0.0, 5.0), (1, 1, "Broken arm", 60.0, 5.5), (2, 0, "Some words here", 0.0, 5.0), (2, 1, "more", 60.0, 5.0), (3, 0, "12-15", 0.0, 5.0), (3, 1, "x", 60.0, 9.0)]
    got = {r.g: r.stays for r in lines.stays_in_lines(spark.createDataFrame(rows, "g long, ord long, text string, x double, y double"), ["g"], "ord").collect()}
    assert got == {1: True, 2: False, 3: False}


def test_range_row(spark):
    got = one(spark, lines.range_row(F.lit(" Falls. Gets up again. Reduce Spd by half ")))
    assert tuple(got) == ("Falls. Gets up again.", "Reduce Spd by half")
    assert tuple(one(spark, lines.range_row(F.lit("no such row")))) == (None, None)


def test_row_helpers_and_regular(spark):
    row = lambda *cells: F.array(*[F.struct(F.lit(float(x)).alias("x0"), F.lit(float(x + w)).alias("x1"), F.lit(t).alias("text")) for x, w, t in cells])
    rows = F.array(row((0, 10, "a "), (50, 10, "b")), row((4, 10, "c"), (52, 8, "d")), row((2, 10, "e"), (60, 10, "f")))
    assert one(spark, layout.regular(rows)) and not one(spark, layout.regular(rows, widest=50.0)) and not one(spark, layout.regular(F.slice(rows, 1, 2)))
    assert one(spark, layout.row_text(rows[0])) == "a b" and one(spark, layout.row_centers(rows[0])) == [5.0, 55.0] and one(spark, layout.row_span(rows[0])) == 60.0


def test_missing_sources_fail(spark):
    entries = spark.createDataFrame([("a.pdf",), ("b.pdf",)], "source_path string")
    files = spark.createDataFrame([("in/a.pdf", b"x")], "path string, content binary")
    assert packet.with_sources(entries.limit(1), files, "in").first().path == "in/a.pdf"
    with pytest.raises(Exception, match="no such source file: in/b.pdf"):
        packet.with_sources(entries, files, "in").collect()


def test_workspace(tmp_path):
    root, public = tmp_path / "own", tmp_path / "public"
    assert packet.workspace_issues(str(root), ["a"]) == [(str(root), "workspace root must exist and be a directory")]
    (root / "a").mkdir(parents=True)
    public.mkdir()
    (root / ".gitignore").write_text("*\n")
    config = {"layout_version": "v1", "workspace_root": str(root), "corpus_id": "c", "public_export_allowed": False, "release_scope": "private_local_only"}
    (root / "workspace.json").write_text(json.dumps(config))
    assert packet.workspace_issues(str(root), ["a"], str(public)) == []
    assert packet.workspace_issues(str(root), ["a", "b"], str(tmp_path)) == [(str(root), "private workspace must not be inside the public repository"), ("b", "required private workspace directory is missing")]
    (root / "workspace.json").write_text(json.dumps(config | {"corpus_id": "", "public_export_allowed": True}))
    assert [m for _, m in packet.workspace_issues(str(root), ["a"])] == ["private workspace must not be public-export allowed", "corpus_id is required"]
    (root / "workspace.json").write_text("{}")
    assert "workspace config is invalid" in packet.workspace_issues(str(root), ["a"])[0][1]


def test_log_tail_and_columns(spark):
    assert one(spark, packet.log_tail(F.lit("\n".join(map(str, range(30)))))) == "\n".join(map(str, range(10, 30)))
    assert one(spark, packet.log_tail(F.lit("a\nb\n"))) == "a\nb" and one(spark, packet.log_tail(F.lit(""))) == ""
    assert packet.missing_columns(spark.createDataFrame([(1,)], "page long")) == ["editable_svg", "preview_png", "status"]
