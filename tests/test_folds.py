"""Deny lists, matches, rows and trees against plain Python."""

import copy
import re
import sys
import tracemalloc
import xml.etree.ElementTree as ET
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.operators import denylist, layout, ordered, trees


# --- deny lists -------------------------------------------------------------------------------------------------------


def test_folds_are_those_of_ignorecase():
    """A sign and the one that stands for it match each other in any case; nearly all pairs that match are folded alike."""
    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    form = denylist.folded("".join(every))
    assert len(form) == len(every)
    moved = [(a, b) for a, b in zip(every, form) if a != b]
    assert len(moved) > 1300 and all(re.fullmatch(b, a, re.IGNORECASE) for a, b in moved)
    assert denylist.folded("Straẞe ΟΔΟΣ ſI K") == denylist.folded("straße οδος si k")


def plain_findings(docs, terms):
    out = Counter()
    for key, text in docs:
        for i, line in enumerate((text or "").splitlines(), 1):
            for term in terms:
                if m := re.search(re.escape(term), line, re.IGNORECASE):
                    n = sum(1 for _ in re.finditer(f"(?={re.escape(term)})", line, re.IGNORECASE))
                    out[key, i, denylist.CATEGORY, term, n, m.start() + 1, line.strip()] += 1
    return out


@pytest.mark.parametrize("part", [denylist.PART, 200])
def test_denied_lines(spark, part):
    lines = ["# a comment", "", "  ", "Foo", "foo", "foo bar", "aa", "é", "ΟΔΟΣ", "a.b", "  C:\\Users  ", "\u3000wide\u3000", "İ", "b" * 300]
    docs = [(1, "FOO bar\nxx aaaa\r\nÉcole A.B axb\u2028οδος end"), (2, None), (3, ""), (4, "\n\n  my foo  \n"), (4, "\n\n  my foo  \n"), (None, "c:\\users\\x wide"), (5, "b" * 1000 + "\x85" + "B" * 300), (6, "nothing here")]
    listed = denylist.terms(spark.createDataFrame([(x,) for x in lines], "value string"))
    terms = [r.term for r in listed.collect()]
    assert sorted(terms) == sorted({"Foo", "foo", "foo bar", "aa", "é", "ΟΔΟΣ", "a.b", "C:\\Users", "wide", "İ", "b" * 300})
    df = spark.createDataFrame(docs, "id long, text string").withColumn("line", F.lit(1)).withColumn("term", F.lit("x"))
    got = denylist.denied_lines(df.repartition(3), "id", listed, part=part)
    assert got.columns == ["id", "line_number", "category", "term", "matches", "first_column", "line"]
    assert Counter(map(tuple, got.collect())) == plain_findings(docs, terms)
    assert denylist.denied_lines(df, "id", listed.limit(0)).collect() == [] and denylist.denied_lines(df.limit(0), "id", listed).collect() == []


def test_many_terms(spark):
    """50,000 terms over a whole table, each row of the result one of plain search's."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(5)
    rows = docs.collect()
    words = sorted({w for r in rows for w in (r.text or "").split()})
    terms = {f"{a} {b}" for a, b in rng.choice(words, (49_000, 2))} | set(rng.choice(words, 1000).tolist())
    got = denylist.denied_lines(docs, "doc_id", spark.createDataFrame([(t,) for t in sorted(terms)], "term string"))
    found = Counter((r.doc_id, r.line_number, denylist.folded(r.term)) for r in got.collect() if r.doc_id % 100 == 0)
    forms = Counter(map(denylist.folded, terms))
    lines = [(r.doc_id, i, denylist.folded(x)) for r in rows if r.doc_id % 100 == 0 for i, x in enumerate((r.text or "").splitlines(), 1)]
    want = Counter({(d, i, f): n for d, i, line in lines for f, n in forms.items() if f in line})
    assert len(terms) > 45_000 and len(want) > 100 and found == want


def test_folded_by_small_letters():
    """Where small letters are the folded ones, the quick way gives them; a sigma at a word's end and the like don't go that way."""
    for text in ("Ärger ÉCOLE слово СЛОВО", "ΟΔΟΣ", "ΟΔΟΣ x", "İx", "ſ K", "ẞ"):
        assert denylist.folded(text) == text.translate(denylist._folds())
    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    assert [denylist.folded(c) for c in every] == list("".join(every).translate(denylist._folds()))


def test_a_long_line_leaves_a_task_once():
    """What a text's findings hold grows with its line and its terms, not with their product; a line of 20,000 words with as many terms."""
    words = [f"w{i:05d}" for i in range(20_000)]
    line = " ".join(words)
    tracemalloc.start()
    machine = denylist.Automaton(words)
    found = list(denylist.text_findings(line, machine))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(hits) for *_, hits in found) == 20_000 and len(found) == 1 and most < 100 << 20


@pytest.mark.parametrize("batch", [1, 5000])
def test_findings_in_small_batches(spark, monkeypatch, batch):
    """What a task gives out at once is bounded: the findings are the same in batches of one line."""
    monkeypatch.setattr(denylist, "BATCH", batch)
    docs = [(i, "\n".join(f"a{j} b{j % 3}" for j in range(i))) for i in range(12)]
    terms = [f"a{j}" for j in range(12)] + ["b1", "B1"]
    got = denylist.denied_lines(spark.createDataFrame(docs, "id long, text string"), "id", spark.createDataFrame([(t,) for t in terms], "term string"), part=300)
    assert Counter(map(tuple, got.collect())) == plain_findings(docs, terms)


@pytest.mark.parametrize("part", [denylist.PART, 400])
def test_counts_are_those_of_the_findings(spark, part):
    """Counts alone leave the tasks, and are those of all findings, with keys that rows share as well."""
    terms = spark.createDataFrame([(t,) for t in ("aa", "AA", "b c", "some longer term", "longer term", "é", "zz")], "term string")
    docs = [(i, f"aaa b{' ' * (i % 3)}c\r\n\nSOME longer TERM É {i}\u2028x" + "\naa" * (i % 4)) for i in range(40)]
    for rows in (docs, [*docs, docs[3], (3, "aa zz"), (9, None)]):
        df = spark.createDataFrame(rows, "id long, text string").repartition(3)
        found = [r for r in denylist.denied_lines(df, "id", terms, part=part).collect()]
        lines, keys, words, columns = Counter((r.id, r.line_number) for r in found), Counter(), Counter(r.term for r in found), Counter()
        for r in found:
            columns[r.id, r.line_number] += r.first_column
        keys.update(w for w, _ in {(r.term, r.id) for r in found})
        got = denylist.line_counts(df, "id", terms, part=part).collect()
        assert Counter(map(tuple, got)) == Counter((*k, denylist.CATEGORY, n, columns[k]) for k, n in lines.items())
        assert Counter(map(tuple, denylist.term_counts(df, "id", terms, part=part).collect())) == Counter((w, keys[w], n) for w, n in words.items())


@pytest.mark.parametrize("mix", [None, 0, 1 << 63])
def test_windows_are_compared_sign_by_sign(monkeypatch, mix):
    """Equal hashes of different windows give no finding, and blocks lose none at their ends."""
    if mix is not None:
        monkeypatch.setattr(denylist, "_MIX", np.uint64(mix))
    monkeypatch.setattr(denylist, "BLOCK", 32)
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abA\n"), 900))
    terms = sorted({text[i : i + n].strip() for i in range(0, 800, 11) for n in (1, 3, 7, 8, 9, 20, 60)} - {""})
    terms = [t for t in terms if "\n" not in t]
    got = {(i, w, n, c) for i, _, hits in denylist.text_findings(text, denylist.Automaton(terms)) for w, n, c in hits}
    assert got == {(i, t, n, c) for _, i, _, t, n, c, _ in plain_findings([(0, text)], terms)} and len(got) > 300


def test_a_large_list_is_one_scan(spark, monkeypatch):
    made, real = [], denylist.Automaton.__init__

    def counted(self, words):
        made.append(len(words))
        real(self, words[:1])

    monkeypatch.setattr(denylist.Automaton, "__init__", counted)
    terms = spark.range(250_000).selectExpr("concat('term ', id) as term")
    denylist.denied_lines(spark.createDataFrame([(1, "x")], "id long, text string"), "id", terms)
    assert made == [250_000]


# --- matches ----------------------------------------------------------------------------------------------------------


def plain_matches(texts, spans, most):
    out, used = Counter(), set()
    for page, i, text, x in sorted(texts, key=lambda t: t[1]):
        if not text or re.fullmatch(r"(?:\d{1,3}|[A-Za-z])\.", text) or text in {"•", "●", "-"}:
            continue
        free = [(abs(sx - x), o) for p, o, s, sx in spans if (p, s) == (page, text) and o not in used]
        if free and min(free)[0] <= most:
            used.add(min(free)[1])
            out[page, i, min(free)[1], min(free)[0]] += 1
    return out


@pytest.mark.parametrize("grain", [0.5, 3.0, 1e-3])
def test_greedy_match(spark, grain):
    """Crowded places with ties on both sides, chains of texts that want one span, and what has no span."""
    rng = np.random.default_rng(8)
    words = ["a", "b", "12.", "x.", "-", "●", ""]
    at = lambda n: (rng.integers(0, 60, n) * grain + rng.choice([0, 0, 40], n)).tolist()
    texts = [(int(rng.integers(0, 3)), i, words[int(rng.integers(0, 7))], x) for i, x in enumerate(at(500))]
    spans = [(int(rng.integers(0, 3)), 1000 + i, words[int(rng.integers(0, 7))], x) for i, x in enumerate(at(400))]
    left = spark.createDataFrame([*texts, (1, 9000, None, 1.0), (None, 9001, "a", 1.0)], "page long, id long, text string, x double").repartition(4)
    right = spark.createDataFrame([*spans, (1, 9002, None, 1.0), (1, 9003, "a", None)], "page long, ord long, text string, x double").withColumn("id", F.lit(0))
    got = Counter(map(tuple, layout.greedy_match(left, right).select("page", "id", "span", "away").collect()))
    want = plain_matches(texts, spans, 6.0)
    assert got == want and len(want) > 50
    assert layout.greedy_match(left.limit(0), right).count() == layout.greedy_match(left, right.limit(0)).count() == 0


def test_greedy_match_of_one_crowd():
    """One wording at one place: each search costs little, however many there are."""
    n = 100_000
    got = list(ordered.cluster_matches([(i, 5.0) for i in range(n)], [(5.0 + (i % 3) * 0.5, i) for i in range(n)], 6.0))
    assert len(got) == n and [s for _, s, _ in got[:4]] == [0, 3, 6, 9] and got[-1][2] == 1.0


# --- rows -------------------------------------------------------------------------------------------------------------


def plain_rows(boxes, order, edge, moved, tolerance):
    rows = []
    for b in sorted(boxes, key=order):
        for row in rows:
            if abs(row[0] - edge(b)) <= tolerance:
                row[0] = moved(row[0], len(row[1]), edge(b))
                row[1].append(b)
                break
        else:
            rows.append([edge(b), [b]])
    rows.sort(key=lambda r: r[0])
    return Counter((b[0], i, k, b[1]) for i, r in enumerate(rows) for k, b in enumerate(sorted(r[1], key=lambda b: b[2])))


@pytest.mark.parametrize("tolerance", [5.0, 3.0, 0.7])
def test_rows_of_boxes_and_words(spark, tolerance):
    rng = np.random.default_rng(3)
    boxes = [(p, p * 1000 + i, float(rng.integers(0, 9)), float(rng.integers(0, 240)) / 4, 0.0, 0.0) for p in range(4) for i in range(150)]
    boxes = [(p, o, x, y, x + int(rng.integers(0, 4)), y + float(rng.choice([-1, 0, 2, 8.5, 30]))) for p, o, x, y, _, _ in boxes]
    df = spark.createDataFrame(boxes, "page long, ord long, x0 double, y0 double, x1 double, y1 double").repartition(5).withColumn("row", F.lit(9)).withColumn("made", F.lit(1))
    for p in range(4):
        mine = [b for b in boxes if b[0] == p]
        solid = [b for b in mine if b[4] > b[2] and b[5] > b[3]]
        got = Counter(map(tuple, ordered.box_rows(df.where(f"page = {p}"), tolerance).collect()))
        assert got == plain_rows(solid, lambda b: (b[3], b[2], b[1]), lambda b: (b[3] + b[5]) / 2, lambda c, n, e: (c * n + e) / (n + 1), tolerance)
        got = Counter(map(tuple, ordered.word_rows(df.where(f"page = {p}"), tolerance).collect()))
        assert got == plain_rows(mine, lambda b: (round(b[3] / tolerance), b[2], b[1]), lambda b: b[3], lambda c, n, e: (c + e) / 2, tolerance)
    assert ordered.box_rows(df.limit(0)).count() == 0


def test_streamed_rows_are_those_of_the_array_fold(spark):
    """ocr_tables folds a page as one array; its rows are the streamed ones, on all events."""
    from pagemill.plans import views

    boxes = views.boxes(spark, "/root/testdata/sf0.01")
    array = layout._page_rows(boxes, {}, 5.0).select("page", F.posexplode("rows").alias("row", "b")).select("page", "row", F.posexplode("b").alias("place", "b")).select("page", "row", "place", "b.ord")
    assert Counter(map(tuple, array.collect())) == Counter(map(tuple, layout.cluster_rows(boxes).collect()))


def test_rows_hold_little(monkeypatch):
    """Of a page of any length only the rows near the current height are open."""
    most = 0
    found = ordered.stacked(((float(i // 3), float(i // 3), i % 3, i) for i in range(200_000)), 0.4, True)
    for k, (number, centre, place, _) in enumerate(found):
        if k % 50_000 == 0:
            most = max(most, len(found.gi_frame.f_locals["open_"]))
        assert centre == number and place == k % 3
    assert k == 199_999 and most <= 3


# --- trees ------------------------------------------------------------------------------------------------------------


def random_tree(rng, depth=0):
    e = ET.Element(str(rng.choice(["g", "text", "tspan", "svg:a"])), {str(k): str(rng.choice(["1", "a&b", 'q"<', "é\n\t", ""])) for k in rng.permutation(["x", "id", "class"])[: rng.integers(0, 4)]})
    e.text = str(rng.choice(["", "some text", "1 < 2 & 3 > 2", " \n ", "日本"])) or None
    for _ in range(int(rng.integers(0, 5)) if depth < 4 else 0):
        e.append(random_tree(rng, depth + 1))
        e[-1].tail = str(rng.choice(["", "tail", "&amp;", "\n"])) or None
    return e


@pytest.fixture(scope="module")
def forest(spark):
    rng = np.random.default_rng(6)
    roots = {i: random_tree(rng) for i in range(60)}
    rows = [(i, ET.tostring(e, encoding="unicode")) for i, e in roots.items()]
    odd = [(100, None), (101, ""), (102, "<a>"), (103, "<a></b>"), (104, "text"), (105, "<!-- c --><?pi x?><a><![CDATA[<&>]]><!-- in -->x<?pi?></a>"), (106, "<a>" * 300 + "</a>" * 300)]
    df = spark.createDataFrame(rows + odd, "id long, xml string").repartition(4).withColumn("begin", F.lit(1)).withColumn("tag", F.lit("z"))
    return roots, df, trees.shred(df, "id")


def test_round_trip(forest):
    roots, df, nodes = forest
    got = {r.id: r.xml for r in trees.written(nodes, "id").collect()}
    assert all(got[i] == ET.tostring(e, encoding="unicode") for i, e in roots.items())
    assert got[105] == "<a>&lt;&amp;&gt;x</a>" and got[106] == "<a>" * 299 + "<a />" + "</a>" * 299 and set(got) == {*roots, 105, 106}
    assert {r.id for r in trees.parse_errors(df, "id").collect()} == {100, 101, 102, 103, 104}
    assert trees.written(nodes.limit(0), "id").count() == 0


def test_relations(forest):
    roots, _, nodes = forest
    mine = nodes.where("id < 60")
    number = {i: {id(e): k for k, e in enumerate(root.iter())} for i, root in roots.items()}
    up = {(r.id, r.node): (r.parent, r.up) for r in trees.with_parents(mine, "id", {"tag": "up"}).collect()}
    want = {(i, n[id(c)]): (n[id(p)], p.tag) for i, n in number.items() for p in roots[i].iter() for c in p}
    assert up == want | {(i, 0): (None, None) for i in roots}
    beside = {(r.id, r.node): (r.place, r.before, r.after) for r in trees.with_siblings(mine, "id").where("parent is not null").collect()}
    for i, n in number.items():
        for p in roots[i].iter():
            c = [n[id(x)] for x in p]
            assert all(beside[i, x] == (k, c[k - 1] if k else None, c[k + 1] if k + 1 < len(c) else None) for k, x in enumerate(c))
    inner = Counter((r.id, r.ancestor, r.node) for r in trees.descendants(mine, "id", mine.where("tag = 'g'")).collect())
    assert inner == Counter((i, n[id(a)], n[id(x)]) for i, n in number.items() for a in roots[i].iter("g") for x in a.iter() if x is not a)
    values = {(r.id, r.node): r.value for r in trees.with_text_values(nodes, "id").collect()}
    assert all(values[i, n[id(e)]] == "".join(e.itertext()) for i, n in number.items() for e in roots[i].iter()) and values[105, 0] == "<&>x"
    x = {(r.id, r.node): r.x for r in mine.select("id", "node", trees.attribute("x").alias("x")).collect()}
    assert all(x[i, n[id(e)]] == e.get("x") for i, n in number.items() for e in roots[i].iter())


def test_edits(spark, forest):
    roots, _, nodes = forest
    mine, number = nodes.where("id < 60"), {}
    after = {i: copy.deepcopy(e) for i, e in roots.items()}
    # every text's content is replaced by two spans, every g of a text goes with its tail, and the places of spans are set
    gone = trees.with_parents(mine, "id", {"tag": "up"}).where("tag = 'g' and up = 'svg:a'")
    set_ = mine.where("tag = 'tspan'").select("id", "node", trees.with_attribute(F.col("attributes"), "x", F.lit("9")).alias("attributes"), F.lit("new").alias("text"))
    texts = mine.where("tag = 'text'")
    new = texts.select("id", F.col("node").alias("parent"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("place")).withColumns({"tag": F.lit("s"), "attributes": F.array().cast("array<struct<name:string,value:string>>"), "text": F.col("place").cast("string"), "tail": F.lit("~")})
    new = new.unionByName(new.limit(1).withColumn("parent", F.lit(10**6).cast("long")))
    edited = trees.appended(trees.emptied(trees.without(trees.updated(mine, "id", set_), "id", gone), "id", texts), "id", new)
    for root in after.values():
        for p in list(root.iter()):
            if p.tag == "tspan":
                p.set("x", "9")
                p.text = "new"
            if p.tag == "svg:a":
                for c in [c for c in p if c.tag == "g"]:
                    p.remove(c)
        for p in list(root.iter("text")):
            for c in list(p):
                p.remove(c)
            p.text = None
            for k in ("1", "2"):
                c = ET.SubElement(p, "s")
                c.text, c.tail = k, "~"
    got = {r.id: r.xml for r in trees.written(edited, "id").collect()}
    want = {i: ET.tostring(e, encoding="unicode") for i, e in after.items()}
    assert got == want and sum(want[i] != ET.tostring(e, encoding="unicode") for i, e in roots.items()) > 30
    # the numbers are those of reading the result
    again = trees.shred(spark.createDataFrame(list(want.items()), "id long, xml string"), "id")
    columns = ["id", "node", "begin", "end", "parent", "depth", "tag"]
    assert Counter(map(tuple, edited.select(columns).collect())) == Counter(map(tuple, again.select(columns).collect()))
