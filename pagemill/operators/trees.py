"""XML trees as relations: a document's elements as rows with intervals, read, searched and edited by joins, and written again.

A node's ``begin`` and ``end`` count the start and end tags of its document, so a descendant's interval lies within its own. ``text``
stands after the start tag, ``tail`` after the end tag; attributes keep their order. Names are as written, with their prefixes.
Comments, processing instructions and document types aren't kept. What the functions share: ``key`` names the document's column.
"""

from __future__ import annotations

from itertools import batched
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

NODE = "node long, begin long, end long, parent long, depth int, tag string, attributes array<struct<name:string,value:string>>, text string, tail string"
#: Nodes of an Arrow batch.
ROWS = 10_000


def parsed(xml: str) -> list[list]:
    """``NODE`` rows of a document in the order of their start tags; raises ``expat.ExpatError`` where it isn't well-formed."""
    nodes, open_, count = [], [], 0
    last = None  # where text goes: (node, place of text or tail)

    def start(tag, attributes):
        nonlocal count, last
        up = open_[-1][0] if open_ else None
        pairs = [{"name": n, "value": v} for n, v in zip(attributes[::2], attributes[1::2])]
        nodes.append(row := [len(nodes), count, None, up, len(open_), tag, pairs, None, None])
        open_.append(row)
        last = (row, 7)
        count += 1

    def end(tag):
        nonlocal count, last
        row = open_.pop()
        row[2] = count
        last = (row, 8)
        count += 1

    parts: dict[tuple[int, int], list[str]] = {}

    def text(data):
        parts.setdefault((last[0][0], last[1]), []).append(data)

    parser = expat.ParserCreate()
    parser.ordered_attributes, parser.buffer_text = True, True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    parser.Parse(xml, True)
    for (node, place), found in parts.items():
        nodes[node][place] = "".join(found)
    return nodes


def _shredded(docs: DataFrame, key: str, xml: str, errors: bool) -> DataFrame:
    rows = docs.select(F.col(key).alias("key"), F.col(xml).cast("string").alias("xml"))
    kind = rows.schema["key"].dataType.simpleString()
    out = f"key {kind}, error string" if errors else f"key {kind}, {NODE}"

    fields = StructType.fromDDL(out)

    def run(batches):
        schema = to_arrow_schema(fields)

        def found(batch):
            for i, x in enumerate(batch.column("xml")):
                try:
                    nodes = parsed(x.as_py() or "")
                except expat.ExpatError as e:
                    if errors:
                        yield i, str(e)
                else:
                    if not errors:
                        for node in nodes:
                            yield i, *node

        for batch in batches:
            for some in batched(found(batch), ROWS):
                at, *columns = zip(*some)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at)), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    return rows.mapInArrow(run, out).withColumnRenamed("key", key)


def shred(docs: DataFrame, key: str, xml: str = "xml") -> DataFrame:
    """(key, ``NODE``) of every element of every well-formed document; others, null ones and empty ones have none (``parse_errors`` names them)."""
    return _shredded(docs, key, xml, False)


def parse_errors(docs: DataFrame, key: str, xml: str = "xml") -> DataFrame:
    """(key, error) of every document that isn't well-formed."""
    return _shredded(docs, key, xml, True)


def attribute(name: str, of: str = "attributes") -> Column:
    """An attribute's value, null where there is none."""
    return F.get(F.filter(of, lambda a: a["name"] == name), F.lit(0))["value"]


def with_parents(nodes: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Every node with columns of its parent under other names (name there -> name here); null for the root."""
    up = nodes.select(key, F.col("node").alias("parent"), *[F.col(a).alias(b) for a, b in columns.items()])
    return nodes.join(up, [key, "parent"], "left")


def with_siblings(nodes: DataFrame, key: str) -> DataFrame:
    """Every node with its ``place`` among its parent's children, from 0, and the numbers of the children ``before`` and ``after`` it."""
    w = W.partitionBy(key, "parent").orderBy("node")
    return nodes.withColumns({"place": F.row_number().over(w) - 1, "before": F.lag("node").over(w), "after": F.lead("node").over(w)})


def descendants(nodes: DataFrame, key: str, of: DataFrame, name: str = "ancestor") -> DataFrame:
    """Nodes within the nodes ``of`` (key, node, begin, end), once for each that holds them; ``name``: that one's number. By intervals of one document."""
    a = of.select(F.col(key).alias("__key"), F.col("node").alias(name), F.col("begin").alias("__b"), F.col("end").alias("__e"))
    inside = (F.col(key) == F.col("__key")) & (F.col("begin") > F.col("__b")) & (F.col("end") < F.col("__e"))
    return nodes.join(a, inside).drop("__key", "__b", "__e")


def _tags(nodes: DataFrame, key: str) -> DataFrame:
    """(key, at, first, n): a row for every start tag (first) and end tag of the nodes ``n``."""
    ends = [F.struct(F.col(c).alias("at"), F.lit(c == "begin").alias("first")) for c in ("begin", "end")]
    return nodes.select(key, F.struct(*[F.col(c) for c in nodes.columns if c != key]).alias("n"), F.explode(F.array(*ends)).alias("t")).select(key, "t.at", "t.first", "n")


def _joined(pieces: DataFrame, key: str, name: str) -> DataFrame:
    """All pieces (key, at, piece) of a document, in order."""
    found = F.array_sort(F.collect_list(F.struct("at", "piece")))
    return pieces.groupBy(key).agg(F.array_join(F.transform(found, lambda p: p["piece"]), "").alias(name))


def with_text_values(nodes: DataFrame, key: str, name: str = "value") -> DataFrame:
    """Every node with all text within it, in order. A subtree's text is one piece of its document's, so each text is put together once."""
    pieces = _tags(nodes, key).withColumn("piece", F.coalesce(F.when(F.col("first"), F.col("n.text")).otherwise(F.col("n.tail")), F.lit("")))
    before = F.sum(F.length("piece")).over(W.partitionBy(key).orderBy("at")) - F.length("piece")
    # both tags of a node meet again within its document: no further shuffle
    rows = pieces.withColumn("before", before).groupBy(key, F.col("n.node").alias("__node")).agg(F.first("n").alias("n"), F.min("before").alias("__from"), F.max("before").alias("__to"))
    rows = rows.join(_joined(pieces, key, "__all"), key)
    value = F.substring(F.col("__all"), F.col("__from").cast("int") + 1, (F.col("__to") - F.col("__from")).cast("int"))
    return rows.select(*[F.col(c) if c == key else F.col(f"n.{c}") for c in nodes.columns], value.alias(name))


# --- edits ------------------------------------------------------------------------------------------------------------


def updated(nodes: DataFrame, key: str, changes: DataFrame) -> DataFrame:
    """Nodes with the columns that ``changes`` (key, node, then any of tag, attributes, text, tail) has for them; its nulls change nothing."""
    new = [c for c in changes.columns if c not in (key, "node")]
    both = nodes.join(changes.select(key, "node", *[F.col(c).alias(f"__{c}") for c in new]), [key, "node"], "left")
    return both.select(*[F.coalesce(f"__{c}", c).alias(c) if c in new else c for c in nodes.columns])


def with_attribute(attributes: Column, name: str, value: Column) -> Column:
    """Attributes with ``name`` set: where it stood, else at the end."""
    pair = F.struct(F.lit(name).alias("name"), value.alias("value"))
    there = F.exists(attributes, lambda a: a["name"] == name)
    return F.when(there, F.transform(attributes, lambda a: F.when(a["name"] == name, pair).otherwise(a))).otherwise(F.array_append(attributes, pair))


def _marked(nodes: DataFrame, key: str, of: DataFrame) -> DataFrame:
    """Nodes with ``__of``: whether they are among ``of`` (key, node), and ``__within``: whether one of these holds them.

    A node that begins after a marked one, and before that one's end, is within it: the latest end so far says so.
    """
    both = nodes.join(of.select(key, "node", F.lit(True).alias("__of")).distinct(), [key, "node"], "left").withColumn("__of", F.col("__of").isNotNull())
    so_far = W.partitionBy(key).orderBy("begin").rowsBetween(W.unboundedPreceding, -1)
    return both.withColumn("__within", F.coalesce(F.max(F.when(F.col("__of"), F.col("end"))).over(so_far) > F.col("begin"), F.lit(False)))


def without(nodes: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Nodes without those of ``gone`` (key, node), all within them, and their tails; numbers as they were."""
    return _marked(nodes, key, gone).where("not __of and not __within").select(*nodes.columns)


def emptied(nodes: DataFrame, key: str, of: DataFrame) -> DataFrame:
    """Nodes without all that stands within the nodes ``of`` (key, node), their text included."""
    rows = _marked(nodes, key, of).where("not __within")
    return rows.withColumn("text", F.when(~F.col("__of"), F.col("text"))).select(*nodes.columns)


def appended(nodes: DataFrame, key: str, children: DataFrame) -> DataFrame:
    """Nodes and new last children: (key, parent, place, tag, attributes, text, tail), in order of place; numbered anew.

    Children of a node that isn't there are left out.
    """
    up = nodes.select(key, F.col("node").alias("parent"), F.col("end").alias("__end"), F.col("depth").alias("__depth"))
    w = W.partitionBy(key, "parent").orderBy("place")
    new = children.withColumn("__i", F.row_number().over(w)).withColumn("__n", F.count("*").over(W.partitionBy(key, "parent"))).join(up, [key, "parent"])
    between = lambda i: F.col("__end") - 1 + i / (2.0 * F.col("__n") + 1)  # noqa: E731  after all that the parent holds
    new = new.select(key, "parent", F.lit(None).cast("long").alias("node"), between(2 * F.col("__i") - 1).alias("begin"), between(2 * F.col("__i")).alias("end"), (F.col("__depth") + 1).alias("depth"), "tag", "attributes", "text", "tail")
    return renumbered(nodes.withColumns({c: F.col(c).cast("double") for c in ("begin", "end")}).unionByName(new.select(*nodes.columns)), key)


def renumbered(nodes: DataFrame, key: str) -> DataFrame:
    """Nodes whose intervals are in order, with numbers from 0 without gaps; parents by their old numbers."""
    w = W.partitionBy(key).orderBy("at")
    tags = _tags(nodes, key).withColumn("i", F.row_number().over(w).cast("long") - 1).withColumn("j", F.sum(F.col("first").cast("long")).over(w) - 1)
    rows = tags.groupBy(key, F.col("n.begin").alias("__b")).agg(F.first("n").alias("n"), F.min("i").alias("__begin"), F.max("i").alias("__end"), F.min("j").alias("__node"))
    old = rows.select(key, F.col("n.parent").alias("parent"), "n", "__begin", "__end", "__node")
    up = rows.where("n.node is not null").select(key, F.col("n.node").alias("parent"), F.col("__node").alias("__parent"))
    own = {"node": "__node", "begin": "__begin", "end": "__end", "parent": "__parent"}
    return old.join(up, [key, "parent"], "left").select(*[F.col(c) if c == key else F.col(own[c]).alias(c) if c in own else F.col(f"n.{c}") for c in nodes.columns])


def _escaped(x: Column, signs: list[tuple[str, str]]) -> Column:
    for a, b in signs:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


#: Signs that stand as references in a text, and those that do so in an attribute as well.
_TEXT = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]
_VALUE = [*_TEXT, ('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#09;")]


def written(nodes: DataFrame, key: str, name: str = "xml") -> DataFrame:
    """(key, xml) of every document, elements without content as ``<tag />``."""
    text, tail = (_escaped(F.coalesce(f"n.{c}", F.lit("")), _TEXT) for c in ("text", "tail"))
    pairs = F.array_join(F.transform("n.attributes", lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), _escaped(a["value"], _VALUE), F.lit('"'))), "")
    w = W.partitionBy(key).orderBy("at")
    # without children the two tags of a node are neighbours
    alone = F.when(F.col("first"), F.lead("at").over(w) == F.col("n.end")).otherwise(F.lag("at").over(w) == F.col("n.begin"))
    leaf = F.col("alone") & (F.coalesce("n.text", F.lit("")) == "")
    opened = F.concat(F.lit("<"), F.col("n.tag"), pairs, F.when(leaf, F.lit(" />")).otherwise(F.concat(F.lit(">"), text)))
    closed = F.concat(F.when(leaf, F.lit("")).otherwise(F.concat(F.lit("</"), F.col("n.tag"), F.lit(">"))), tail)
    pieces = _tags(nodes, key).withColumn("alone", alone).withColumn("piece", F.when(F.col("first"), opened).otherwise(closed))
    return _joined(pieces, key, name)
