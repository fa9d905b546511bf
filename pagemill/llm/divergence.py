"""Source divergence audit (operator 13): how far the words of each source lie from those of the others of its language.

Two passes over the texts. The first counts in how many documents of its language each term occurs, exactly; terms of ``least`` documents
at least are kept. The second runs an automaton of the kept terms, each between two blanks, over the texts and counts every
occurrence by language, source and term: sparse postings, which hold no zero. Rates, differences and ranks come from these.

A term is a run of signs other than ``\\x00-\\x40 \\x5B-\\x60 \\x7B-\\x7F``, A-Z lower-cased: of UTF-8, a run of ASCII letters and of
bytes from 128 on, so texts are mapped byte by byte and split at blanks. Null texts, languages and sources are empty strings.
"""

from __future__ import annotations

from collections import Counter
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, slices

#: Documents of its language that a kept term occurs in, at least; ranks of the term part.
LEAST, RANKS = 30, 50
#: What is added to every count, and the rate of a term that makes up a whole group.
ADDED, ONE = 5, 1_000_000_000
#: Bytes of kept terms in an automaton (at most 40 times as much in a worker); a larger vocabulary takes several passes, of one such part each.
SHARD = 4 << 20
#: Counts that a task holds before it sends them on.
ROOM = 400_000
#: Sources of a tile, and cells of a block of (sources, terms).
TILE, CELLS = 256, 1 << 21

#: Letters as they are but for A-Z, bytes from 128 on as they are, all else a blank.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def _texts(batch: pa.RecordBatch):
    """(first row, plain bytes of each row) of the batch, some megabytes at a time."""
    first = 0
    for part, data, at in slices(batch, "text"):
        plain, at = data.tobytes().translate(_PLAIN), at.tolist()
        yield first, [plain[a:b] for a, b in zip(at, at[1:])]
        first += part.num_rows


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term, n): in how many documents of a language each term occurs. docs: lang, text; each task sends its own sums."""

    def count(batches):
        seen: dict[str, Counter] = {}

        def out():
            for lang, counts in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), _strings(list(counts)), pa.array(counts.values(), pa.int64())], ["lang", "term", "n"])
            seen.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, texts in _texts(batch):
                for i, text in enumerate(texts, first):
                    seen.setdefault(langs[i], Counter()).update(set(text.split()))
                if sum(map(len, seen.values())) > ROOM:
                    yield from out()
        yield from out()

    return _plain(docs).select("lang", "text").mapInArrow(count, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Kept terms of some languages; a worker builds a language's automaton when it first meets one of its texts."""

    def __init__(self, rows: pa.Table):
        self.terms: dict[str, list[tuple[str, int]]] = {}
        for lang, term, number in zip(*(rows.column(c).to_pylist() for c in ("lang", "term", "id"))):
            self.terms.setdefault(lang, []).append((term, number))
        self.built: dict[str, object] = {}

    def automaton(self, lang: str):
        if lang not in self.built:
            from ahocorasick import Automaton

            self.built[lang] = a = Automaton()
            for term, number in self.terms[lang]:
                a.add_word(f" {term} ", number)
            a.make_automaton()
        return self.built[lang]

    def __getstate__(self):
        return self.terms

    def __setstate__(self, terms):
        self.terms, self.built = terms, {}


def postings(docs: DataFrame, kept: DataFrame, shard: int = SHARD) -> DataFrame:
    """(lang, source, id, n): how often each kept term (lang, term, id) of its language occurs in a source, where it does.

    The vocabulary goes to the tasks in parts of about ``shard`` bytes, dealt by hash, with one scan of ``docs`` for each part.
    """
    spark = docs.sparkSession
    total = kept.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    parts, kind = -(-total // shard), "lang string, source string, id long, n long"
    found = spark.createDataFrame([], kind)
    for k in range(parts):
        vocabulary = spark.sparkContext.broadcast(Vocabulary(kept.where(F.pmod(F.xxhash64("lang", "term"), F.lit(parts)) == k).select("lang", "term", "id").toArrow()))

        def count(batches, vocabulary=vocabulary):
            v: Vocabulary = vocabulary.value
            seen: dict[tuple[str, str], Counter] = {}

            def out():
                for (lang, source), counts in seen.items():
                    own = [pa.array([x] * len(counts), pa.string()) for x in (lang, source)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], ["lang", "source", "id", "n"])
                seen.clear()

            for batch in batches:
                langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
                for first, texts in _texts(batch):
                    for i, text in enumerate(texts, first):
                        if langs[i] in v.terms:
                            matches = v.automaton(langs[i]).iter(f" {text.decode()} ")
                            seen.setdefault((langs[i], sources[i]), Counter()).update(map(itemgetter(1), matches))
                    if sum(map(len, seen.values())) > ROOM:
                        yield from out()
            yield from out()

        # Each part goes through its own cut, so that its vocabulary need not outlive its scan
        one = _plain(docs).mapInArrow(count, kind).groupBy("lang", "source", "id").agg(F.sum("n").alias("n"))
        found = found.unionByName(cut(one)) if parts > 1 else cut(one)
    return found


def _rate(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(ONE * (count + ADDED) / (total + ADDED * size)), exact; null where nothing is kept."""
    above = F.lit(ONE).cast("decimal(10,0)") * (count + ADDED).cast("decimal(19,0)")
    below = (total + ADDED * size).cast("decimal(19,0)")
    return F.when(size > 0, F.call_function("div", above, F.when(size > 0, below)) + 1)


def _tiles(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, f, u) of every two sources a < b (numbers) of a language: f sums the differences of their rates over ``u`` terms; a term
    outside of these occurs in neither. Sources meet by tiles, terms by blocks, so no task holds more than ``CELLS`` cells and no
    pair of rows is ever sent."""
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = counts.join(groups, ["lang", "source"]).select("lang", "s", "tiles", "id", _rate(F.col("n"), F.col("total"), F.col("size")).alias("p"), block.alias("block"))
    # and each source once in every block, with the rate of a term that it lacks
    lacks = groups.select("lang", "s", "tiles", F.lit(None).cast("long").alias("id"), "p0", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rows = rows.unionByName(lacks.withColumnRenamed("p0", "p")).withColumn("tile", F.expr(f"s div {TILE}")).withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    rows = rows.select("lang", "block", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "s", "id", "p")

    def differences(key: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        s, p = t.column("s").to_numpy(), t.column("p").to_numpy()
        terms = t.column("id").combine_chunks().dictionary_encode()
        at = terms.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        sources = np.unique(s)
        rates = np.zeros((len(sources), len(terms.dictionary)), np.int64)
        row = np.searchsorted(sources, s)
        rates[row[at < 0]] = p[at < 0][:, None]
        rates[row[at >= 0], at[at >= 0]] = p[at >= 0]
        first = np.flatnonzero(sources // TILE == key[2].as_py())
        second = np.flatnonzero(sources // TILE == key[3].as_py())
        a, b, f = [], [], []
        for x in first:
            y = second[second > x]
            a.append(np.full(len(y), sources[x]))
            b.append(sources[y])
            f.append(np.array([np.abs(rates[z] - rates[x]).sum() for z in y], np.int64))
        a, b, f = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, f))
        n = len(a)
        return pa.table({"lang": pa.array([key[0].as_py()] * n, pa.string()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "f": pa.array(f, pa.int64()), "u": pa.array([rates.shape[1]] * n, pa.int64())})

    found = rows.groupBy("lang", "block", "i", "j").applyInArrow(differences, "lang string, a long, b long, f long, u long")
    return found.groupBy("lang", "a", "b").agg(F.sum("f").alias("f"), F.sum("u").alias("u"))


def audit(docs: DataFrame, least: int = LEAST, ranks: int = RANKS, shard: int = SHARD) -> DataFrame:
    """lang, source, part, item, value, rank: how each (lang, source) differs from the other sources, and by which terms from its language.

    docs: text, lang, source (others are ignored). Part ``pair`` has every other source of the language with the sum of the differences of
    all kept terms' rates; part ``term`` the kept terms that the source holds more often than the language does, up to rank ``ranks``. Rank
    1 has the largest value, ties go by the item's bytes. A language without kept terms gives pairs of value 0 and no
    terms; a language with one source gives no pairs; an empty table gives nothing. Repeated rows count each time.
    """
    kept = cut(frequencies(docs).where(F.col("n") >= least).select("lang", "term", F.monotonically_increasing_id().alias("id")))
    counts = cut(postings(docs, kept, shard))
    size = kept.groupBy("lang").agg(F.count("*").alias("size"))
    total = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = _plain(docs.select("lang", "source", F.lit("").alias("text"))).select("lang", "source").distinct()
    groups = groups.join(size, "lang", "left").join(total, ["lang", "source"], "left").fillna(0, ["size", "total"])
    # a row for each source, numbered within its language
    groups = groups.withColumn("s", F.row_number().over(W.partitionBy("lang").orderBy("source")).cast("long") - 1).withColumn("n", F.count("*").over(W.partitionBy("lang")))
    blocks = F.expr(f"(size * least(n, {2 * TILE})) div {CELLS} + 1").cast("int")
    groups = groups.withColumn("tiles", F.expr(f"(n - 1) div {TILE} + 1")).withColumn("blocks", blocks).withColumn("p0", F.coalesce(_rate(F.lit(0), F.col("total"), F.col("size")), F.lit(0)))
    groups = cut(groups.drop("n"))

    pairs = _tiles(counts, groups)
    ends = groups.select("lang", "s", "source", "p0", "size")
    pairs = pairs.join(ends.toDF("lang", "a", "source_a", "p_a", "size"), ["lang", "a"]).join(ends.drop("size").toDF("lang", "b", "source_b", "p_b"), ["lang", "b"])
    value = F.col("f") + (F.col("size") - F.col("u")) * F.abs(F.col("p_a") - F.col("p_b"))
    both = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    pairs = pairs.select("lang", value.alias("value"), both.alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    whole = kept.join(counts.groupBy("id").agg(F.sum("n").alias("n_lang")), "id")
    all_of = groups.groupBy("lang").agg(F.sum("total").alias("total_lang"), F.first("size").alias("size"))
    whole = whole.join(all_of, "lang").select("id", "term", _rate(F.col("n_lang"), F.col("total_lang"), F.col("size")).alias("q"))
    p = _rate(F.col("n"), F.col("total"), F.col("size"))
    terms = counts.join(whole, "id").join(groups.select("lang", "source", "total", "size"), ["lang", "source"]).withColumn("value", p - F.col("q"))
    terms = terms.where("value > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")

    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.select(columns).unionByName(terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks).select(columns))
