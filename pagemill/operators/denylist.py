"""Deny lists of any length: every line that holds a term, found by one table of hashes over all terms.

A list's lines are terms, taken literally and in any case; blanks and # comments are left out. The table goes to the tasks by broadcast
in parts of bounded size, one scan of the texts for each part, so neither it nor a task grows with the list. A text's windows are hashed,
looked up and compared sign by sign as arrays, a block of bounded size at a time: the windows as long as a short term, and of the longer
terms those that begin as one does. A line leaves a task once for each part, with all its terms, in batches of bounded size, and where
only numbers are asked for, only these leave it.
"""

from __future__ import annotations

import re
import sys
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import stripped
from ..sources.books import shared_folder
from .quality import LINE_ENDS

CATEGORY = "external denylist"
#: Bytes that one broadcast holds, 96 for each term besides five times its own.
PART = 128 << 20
FOUND = "line_number long, category string, term string, matches long, first_column long, line string"
#: Bytes that a task gives out at once, 64 for each finding besides its term.
BATCH = 4 << 20
#: Signs that are searched at once, and of a term that are looked for before its whole.
BLOCK, PREFIX = 1 << 19, 8
#: What stands between texts; no sign has this number.
BETWEEN = sys.maxunicode + 1


@cache
def _folds() -> dict[int, str]:
    """Each sign that doesn't stand for itself, and the sign that stands for it and all that differ from it by case alone."""
    by: dict[str, list[str]] = {}
    for c in map(chr, range(sys.maxunicode + 1)):
        up = c.upper()
        if up != c or c.lower() != c:
            by.setdefault(up if len(up) > 1 else (up.lower()[0] if up.lower() else up), []).append(c)
    return {ord(c): (key if len(key) == 1 else same[0]) for key, same in by.items() for c in same if (key if len(key) == 1 else same[0]) != c}


@cache
def _odd() -> re.Pattern:
    """The signs whose small letter isn't the one that stands for them; a capital sigma's depends on where it stands."""
    folds = _folds()
    return re.compile("[" + "".join(re.escape(c) for c in map(chr, range(sys.maxunicode + 1)) if c == "\u03a3" or c.lower() != folds.get(ord(c), c)) + "]")


def folded(text: str) -> str:
    """``text`` with one sign for all that differ by case alone; as many signs as before."""
    return text.lower() if text.isascii() or not _odd().search(text) else text.translate(_folds())


def terms(lines: DataFrame, column: str = "value") -> DataFrame:
    """(term) of a deny list's lines, each once."""
    t = lines.select(stripped(F.col(column)).alias("term"))
    return t.where((F.col("term") != "") & ~F.col("term").startswith("#")).distinct()


_BASE, _MIX, _LONG = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), 0x94D049BB133111EB


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash's base and of its inverse."""
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)], dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


class _Hashes:
    """Of texts' codes one after another the hash of any window; equal windows have equal ones."""

    def __init__(self, codes: np.ndarray):
        n = 1 << len(codes).bit_length()  # few sizes, so that the powers are kept
        powers, self.back = _powers(n)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[: len(codes)], out=self.sums[1:])

    def of(self, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return ((self.sums[at + sizes] - self.sums[at]) * self.back[at] + sizes.astype(np.uint64) * np.uint64(_LONG)) * _MIX

    def every(self, size: int) -> np.ndarray:
        """``of`` all windows of one size."""
        m = max(0, len(self.sums) - size)
        return ((self.sums[size : size + m] - self.sums[:m]) * self.back[:m] + np.uint64(size * _LONG % (1 << 64))) * _MIX


class _Table:
    """Hashes dealt to slots by their first bits; by two bits more, so that few others are looked up, which there are."""

    def __init__(self, hashes: np.ndarray):
        self.fine = np.uint64(64 - max(12, (16 * len(hashes)).bit_length()))
        self.some = np.zeros(1 << (64 - int(self.fine)), bool)
        self.some[(hashes >> self.fine).astype(np.int64)] = True
        self.shift = np.uint64(64 - max(1, (4 * len(hashes)).bit_length()))
        slots = (hashes >> self.shift).astype(np.int64)
        self.order = np.argsort(slots, kind="stable").astype(np.int32)
        self.hashes = hashes[self.order]
        self.first = np.searchsorted(slots[self.order], np.arange((1 << (64 - int(self.shift))) + 1)).astype(np.int32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``hashes``, place in the table's) of all that are equal."""
        left = np.flatnonzero(self.some[(hashes >> self.fine).view(np.int64)])
        hashes = hashes[left]
        slots = (hashes >> self.shift).view(np.int64)
        at, end = self.first[slots], self.first[slots + 1]
        some = at < end
        left, at, end, hashes = left[some], at[some], end[some], hashes[some]
        out = [], []
        while len(left):
            same = self.hashes[at] == hashes
            out[0].append(left[same])
            out[1].append(self.order[at[same]])
            at = at + 1
            more = at < end
            left, at, end, hashes = left[more], at[more], end[more], hashes[more]
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] places, then those from starts[1] on."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Automaton:
    """All terms as one table; a folded form leads to all terms that have it."""

    def __init__(self, words: list[str]):
        by: dict[str, list[str]] = {}
        for word in words:
            by.setdefault(folded(word), []).append(word)
        forms = sorted(by)
        self.words = pa.array([w for f in forms for w in sorted(by[f])], pa.string())
        self.lengths = np.array([len(w) for f in forms for w in sorted(by[f])], np.int32)
        self.named = np.cumsum([0, *(len(by[f]) for f in forms)])  # a form's words
        self.sizes = np.array([len(f) for f in forms], np.int64)
        self.starts = np.cumsum(np.r_[0, self.sizes])
        self.codes = _codes("".join(forms))
        self.longest = int(self.sizes.max(initial=1))
        hashes = np.zeros(len(forms), np.uint64)
        long = np.flatnonzero(self.sizes >= PREFIX)
        begin = np.zeros(len(long), np.uint64)
        group = np.cumsum(self.sizes) // BLOCK  # forms are hashed some at a time
        for g in np.unique(group):
            a, b = np.searchsorted(group, [g, g + 1])
            some, base = _Hashes(self.codes[self.starts[a] : self.starts[b]]), self.starts[a]
            hashes[a:b] = some.of(self.starts[a:b] - base, self.sizes[a:b])
            c, d = np.searchsorted(long, [a, b])
            begin[c:d] = some.of(self.starts[long[c:d]] - base, np.full(d - c, PREFIX))
        self.short = {n: (_Table(hashes[which]), which) for n in np.unique(self.sizes[self.sizes < PREFIX]).tolist() for which in [np.flatnonzero(self.sizes == n)]}
        self.long, self.whole = long, _Table(hashes[long])
        # a beginning leads to the sizes of the terms that have it
        order = np.lexsort((self.sizes[long], begin))
        begin, sizes = begin[order], self.sizes[long][order]
        new = np.r_[True, (begin[1:] != begin[:-1]) | (sizes[1:] != sizes[:-1])][: len(begin)]
        begin, self.follow = begin[new], sizes[new]
        begin, at, self.follows = np.unique(begin, return_index=True, return_counts=True)
        self.follow_at, self.begin = at, _Table(begin)

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, form) of every occurrence in folded codes, overlapping ones too, by place."""
        out = [], []
        for begins in range(0, len(codes), BLOCK):
            at, form = self._block(codes[begins : begins + BLOCK + self.longest - 1])
            mine = at < BLOCK
            out[0].append(at[mine] + begins)
            out[1].append(form[mine])
        at, form = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        order = np.argsort(at, kind="stable")
        return at[order], form[order]

    def _block(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = _Hashes(codes)
        found = [(at, which[k]) for n, (table, which) in self.short.items() for at, k in [table.find(hashes.every(n))]]
        if len(self.follow):
            at, k = self.begin.find(hashes.every(PREFIX))
            sizes = self.follow[_runs(self.follow_at[k], self.follows[k])]
            at = np.repeat(at, self.follows[k])
            fits = at + sizes <= len(codes)
            at, sizes = at[fits], sizes[fits]
            which, form = self.whole.find(hashes.of(at, sizes))
            form = self.long[form]
            right = self.sizes[form] == sizes[which]
            found.append((at[which][right], form[right]))
        at, form = (np.concatenate([f[i] for f in found]).astype(np.int64) if found else np.zeros(0, np.int64) for i in (0, 1))
        good = [self._same(codes, at[i : i + 65536], form[i : i + 65536]) for i in range(0, len(at), 65536)]
        good = np.concatenate(good) if good else np.zeros(0, bool)
        return at[good], form[good]

    def _same(self, codes: np.ndarray, at: np.ndarray, form: np.ndarray) -> np.ndarray:
        """Where a form really stands, not another text with its hash."""
        sizes = self.sizes[form]
        good = at + sizes <= len(codes)
        sizes = np.where(good, sizes, 1)
        same = codes[_runs(at, sizes)] == self.codes[_runs(self.starts[form], sizes)]
        return good & np.logical_and.reduceat(same, np.cumsum(sizes) - sizes)


_ENDS = re.compile(LINE_ENDS)
_IS_END = np.array([bool(_ENDS.match(chr(c))) for c in range(0x2030)])


class Found:
    """What some texts hold, as arrays: of each line with a term its text, number and bounds there, and of each of its forms how often and where."""

    def __init__(self, texts: list[str], automaton: Automaton):
        codes = [x for t in texts for x in (_codes(folded(t)), np.array([BETWEEN], np.uint32))]
        sizes = np.array([len(x) for x in codes[::2]], np.int64)
        codes = np.concatenate(codes)
        begins = np.cumsum(sizes + 1) - sizes - 1
        at, form = automaton.hits(codes)
        ends = _IS_END[np.minimum(codes, 0x202F)]
        pair = np.flatnonzero((codes[:-1] == 13) & (codes[1:] == 10))
        ends[pair] = False
        cuts = np.flatnonzero(ends | (codes == BETWEEN))
        line = np.searchsorted(cuts, at)  # cuts before a place
        order = np.argsort(line * len(automaton.sizes) + form, kind="stable")
        at, line, form = at[order], line[order], form[order]
        new = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (form[1:] != form[:-1])][: len(at)])
        self.form, self.matches = form[new], np.diff(np.r_[new, len(at)])
        lines, self.lines_at, self.forms = np.unique(line[new], return_index=True, return_counts=True)
        start = np.where(lines > 0, cuts[lines - 1] + 1, 0)
        end = cuts[lines]
        self.text = np.searchsorted(begins, start, "right") - 1
        self.number = lines - np.searchsorted(cuts, begins)[self.text] + 1
        self.column = at[new] - np.repeat(start, self.forms) + 1
        paired = np.isin(end, pair + 1)
        self.start, self.end = start - begins[self.text], end - paired - begins[self.text]

    def words(self, automaton: Automaton, a: int, b: int):
        """(word, matches, first column, how many a line has) of the lines from a to b."""
        some = slice(self.lines_at[a] if a < len(self.lines_at) else 0, self.lines_at[b] if b < len(self.lines_at) else len(self.form))
        form = self.form[some]
        n = automaton.named[form + 1] - automaton.named[form]
        held = np.add.reduceat(n, self.lines_at[a:b] - some.start) if b > a else n[:0]
        return _runs(automaton.named[form], n), np.repeat(self.matches[some], n), np.repeat(self.column[some], n), held


def text_findings(text: str, automaton: Automaton):
    """(line number, line without white space around, [(term, occurrences, first column)]) of every line with a term in it."""
    found = Found([text], automaton)
    for i, (number, a, b) in enumerate(zip(found.number.tolist(), found.start.tolist(), found.end.tolist())):
        word, n, column, _ = found.words(automaton, i, i + 1)
        yield number, text[a:b].strip(), list(zip(automaton.words.take(pa.array(word)).to_pylist(), n.tolist(), column.tolist()))


def _searched(batches, automaton: Automaton):
    """(keys, texts, what they hold) of about ``BLOCK`` signs at once; rows without text hold nothing."""
    if not len(automaton.words):
        return
    for batch in batches:
        keys, texts = batch.column("key"), batch.column("text")
        begin = size = 0
        held: list[str] = []
        for i, t in enumerate(texts):
            held.append(t.as_py())
            size += len(held[-1])
            if size >= BLOCK or i + 1 == len(texts):
                yield keys.slice(begin, len(held)), held, Found(held, automaton)
                begin, size, held = i + 1, 0, []


def _dealt(docs: DataFrame, key: str, words: DataFrame, text: str, part: int, search, schema: str) -> DataFrame:
    """``search(batches of key and text, table)`` over ``docs`` for each part of the list, one after another."""
    spark = docs.sparkSession
    words.select("term").write.parquet(folder := shared_folder(spark))  # read once for each part
    words = spark.read.parquet(folder)
    size = words.agg(F.sum(5 * F.octet_length("term") + 96)).first()[0] or 0
    parts = max(1, -(-size // part))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("text is not null")
    kind = rows.schema["key"].dataType.simpleString()
    out = None
    for k in range(parts):
        mine = words.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k) if parts > 1 else words
        automaton = spark.sparkContext.broadcast(Automaton(mine.toArrow().column("term").to_pylist()))
        one = rows.mapInArrow(lambda batches, automaton=automaton: search(batches, automaton.value), schema.format(key=kind))
        out = one if out is None else out.unionByName(one)
    return out


def _findings(batches, automaton: Automaton):
    hits = [pa.field("term", pa.string()), pa.field("matches", pa.int64()), pa.field("first_column", pa.int64())]
    for keys, texts, found in _searched(batches, automaton):
        word, n, column, held = found.words(automaton, 0, len(found.number))
        bytes_ = 4 * (found.end - found.start)
        if len(held):
            bytes_ = bytes_ + np.add.reduceat(64 + 4 * automaton.lengths[word], np.cumsum(held) - held)
        sums, of, a = np.cumsum(bytes_), np.cumsum(np.r_[0, held]), 0
        while a < len(held):
            b = int(np.searchsorted(sums, (sums[a - 1] if a else 0) + BATCH)) + 1
            b = min(b, len(held))
            some = slice(of[a], of[b])
            lines = [texts[i][x:y].strip() for i, x, y in zip(found.text[a:b].tolist(), found.start[a:b].tolist(), found.end[a:b].tolist())]
            columns = [automaton.words.take(pa.array(word[some])), pa.array(n[some]), pa.array(column[some])]
            lists = pa.ListArray.from_arrays(pa.array((of[a : b + 1] - of[a]).astype(np.int32)), pa.StructArray.from_arrays(columns, fields=hits))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(found.text[a:b])), pa.array(found.number[a:b]), pa.array(lines, pa.string()), lists], ["key", "line_number", "line", "found"])
            a = b


def denied_lines(docs: DataFrame, key: str, words: DataFrame, text: str = "text", part: int = PART) -> DataFrame:
    """(key, line_number, category, term, matches, first_column, line) of each line of ``text`` and term (``words``: term) in it.

    matches counts occurrences, overlapping ones too; first_column counts code points from 1; lines end as Python splits them, and are
    given without white space around. Null texts hold nothing; rows with the same key are searched each by itself. The list is dealt
    by hash in parts of about ``part`` bytes.
    """
    out = _dealt(docs, key, words, text, part, _findings, "key {key}, line_number long, line string, found array<struct<term: string, matches: long, first_column: long>>")
    each = out.select("key", "line_number", "line", F.explode("found").alias("x"))
    return each.select(F.col("key").alias(key), "line_number", F.lit(CATEGORY).alias("category"), "x.term", "x.matches", "x.first_column", "line")


def _line_counts(batches, automaton: Automaton):
    for keys, _, found in _searched(batches, automaton):
        if len(found.number):
            _, _, column, held = found.words(automaton, 0, len(found.number))
            columns = np.add.reduceat(column, np.cumsum(held) - held)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(found.text)), pa.array(found.number), pa.array(held), pa.array(columns)], ["key", "line_number", "terms", "columns"])


def line_counts(docs: DataFrame, key: str, words: DataFrame, text: str = "text", part: int = PART) -> DataFrame:
    """(key, line_number, category, terms, columns) of ``denied_lines``: how many terms a line holds, and the sum of their first columns."""
    out = _dealt(docs, key, words, text, part, _line_counts, "key {key}, line_number long, terms long, columns long")
    sums = out.groupBy(F.col("key").alias(key), "line_number").agg(F.sum("terms").alias("terms"), F.sum("columns").alias("columns"))
    return sums.select(key, "line_number", F.lit(CATEGORY).alias("category"), "terms", "columns")


def _term_counts(batches, automaton: Automaton):
    rows, lines = np.zeros((2, len(automaton.sizes)), np.int64)
    for _, _, found in _searched(batches, automaton):
        np.add.at(lines, found.form, 1)
        np.add.at(rows, np.unique(np.repeat(found.text, found.forms) * len(rows) + found.form) % len(rows), 1)
    some = np.flatnonzero(lines)
    for i in range(0, len(some), 16384):
        form = some[i : i + 16384]
        n = automaton.named[form + 1] - automaton.named[form]
        yield pa.RecordBatch.from_arrays([automaton.words.take(pa.array(_runs(automaton.named[form], n))), pa.array(np.repeat(rows[form], n)), pa.array(np.repeat(lines[form], n))], ["term", "rows", "lines"])


def term_counts(docs: DataFrame, key: str, words: DataFrame, text: str = "text", part: int = PART) -> DataFrame:
    """(term, documents, lines) of ``denied_lines``: how many keys and how many lines hold a term. A task counts its rows; rows whose key others have go line by line."""
    again = docs.groupBy(key).count().where("count > 1").select(key)
    if again.isEmpty():
        out = _dealt(docs, key, words, text, part, _term_counts, "term string, rows long, lines long")
        return out.groupBy("term").agg(F.sum("rows").alias("documents"), F.sum("lines").alias("lines"))
    out = denied_lines(docs, key, words, text, part)
    return out.groupBy("term").agg(F.countDistinct(key).alias("documents"), F.count("*").alias("lines"))
