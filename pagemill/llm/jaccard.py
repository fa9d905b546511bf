"""N-gram Jaccard join by T-occurrence search (operator 9): which documents share at least 80 % of their word shingles.

Without a pair for every two members of a group, and losing no link:

1. Every text becomes its set of shingles, each a 64-bit hash of its words' 64-bit hashes; two different shingles are taken for one with
   probability 2**-64, which is all that is not exact here. Texts of equal sets are one class, named by two 64-bit sums over the set; classes
   whose first sums agree, but not the second, get another name.
2. Postings (shingle, class) are dealt by ranges of the hash, in packed arrays. A shingle of a single class can't count
   for any pair and is dropped; of the others, the number of classes goes back to the classes. Shingles of very many classes
   (``HEAVY``) are known beforehand: they count as the most frequent ones, and no task holds their lists.
3. Of its n shingles, a class's n - ceil(0.8 n) + 1 rarest (rarest first, ties by hash) must hold one of every partner's. A
   class whose dropped shingles fill that prefix has no partner. The rest of the prefix are the inverted lists to join.
   Lists with the same members are kept once.
4. In every list one leader, its most typical member, is compared with the members of other components, then components are
   formed anew: a group of copies is settled in a number of comparisons linear in its size. In the first round each class
   meets one leader only, that of its longest list, which settles most of a group that shares many lists. In lists that still hold members
   of several components after some rounds, all members outside the largest component are searched for among all members, in blocks.
5. Each comparison is a T-occurrence search by DivideSkip: the short inverted lists of a query are merged, and
   what reaches T less the number of long lists is looked up in each long list by binary search. Ascending lists laid end to end are merged by a
   stable sort, which merges runs, rather than by a heap of single entries: the same counts, at 30 times the speed in Python.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS, cut, mix, release, scan_bytes, shingles, slices, trim, whole
from .graph import components

PERCENT = 80
#: Text bytes behind the postings that a task holds, shingles in memory before a task hands them over, classes in a block of the last search, rounds with leaders.
PART, FLUSH, BLOCK, ROUNDS = 24 << 20, 3 << 20, 512, 2
#: Postings of a part that are sorted at a time.
SORTED = 1 << 20
#: Partitions over which the members of the last search are dealt, if they were in one.
DEALT = 12
#: Long lists probed at a time.
PROBED = 64
#: A shingle is heavy if a slice of texts (2 MB) has it in this share of its classes and in ``LOCAL`` of them, and if such slices hold it in this
#: many classes together, at least a ten-thousandth of all rows: so at most 10,000 times as many are heavy as a set has on average.
HEAVY, HEAVY_SHARE, LOCAL, HEAVY_ROWS = 100_000, 0.05, 32, 10_000


def needed(n: int, m, percent: int = PERCENT):
    """The least overlap of sets of n and m elements whose Jaccard likeness is at least ``percent``."""
    return -(-percent * (n + m) // (100 + percent))


# --- sets -------------------------------------------------------------------------------------------------------------


def text_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row and hash of each distinct shingle, by row and hash; of each row the size of its set, its class and the class's second sum."""
    row, h = shingles(data, at)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    row, h = row[new], h[new]
    n = np.bincount(row, minlength=len(at) - 1)
    end, names = np.cumsum(n), []
    for salt in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(mix(h + salt) ^ salt), out=sums[1:])
        names.append(mix(sums[end] - sums[end - n] + n.astype(np.uint64) * salt))
    return row, h, n, *names


def renamed(name: np.ndarray, second: np.ndarray, others: dict[tuple[int, int], int]) -> np.ndarray:
    """The classes' names, those in ``others`` (name and second sum to name) replaced."""
    if others and len(hit := np.flatnonzero(np.isin(name, np.array([k[0] for k in others], np.uint64)))):
        name = name.copy()
        for i in hit:
            name[i] = others.get((int(name[i]), int(second[i])), name[i])
    return name


SIZES = "doc_id long, n_shingles long, class long, second long"


def set_sizes(docs: DataFrame, local: int = LOCAL, share: float = HEAVY_SHARE) -> DataFrame:
    """``SIZES`` of every row: the size of its set, the name of its class and the second sum (null for an empty set).

    Rows of size -1 tell of shingles that many classes of a slice have: the hash as class, the number as second.
    """

    def sizes(batches):
        for batch in batches:
            for part, data, at in slices(batch, "text"):
                row, h, n, name, second = text_sets(data, at)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(name.view(np.int64), mask=n == 0), pa.array(second.view(np.int64), mask=n == 0)], names)
                classes, first, back = np.unique(name, return_index=True, return_inverse=True)
                common, count = np.unique(h[first[back[row]] == row], return_counts=True)
                often = count >= max(local, share * len(classes))
                if often.any():
                    k = int(often.sum())
                    yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.array(np.full(k, -1)), pa.array(common[often].view(np.int64)), pa.array(count[often].astype(np.int64))], names)

    names = [x.split()[0] for x in SIZES.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sizes, SIZES)


def _zip(x: np.ndarray) -> bytes:
    """Sorted or repeated integers, bytes of equal weight together, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(4, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unzip(b: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(b[:4], "little"), np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(b[4:], decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).ravel()


def _deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.zeros(1, x.dtype))


_MOST = np.uint32((1 << 32) - 1)


def in_ranges(key: list[np.ndarray], *others: list[np.ndarray], most: int | None = None):
    """The columns ``key`` (non-empty ascending arrays of 64-bit hashes) and ``others`` (arrays beside them) by ranges of the key, in order, about ``most`` (``SORTED``) rows at a time."""
    least, k = min(int(x[0]) for x in key), sum(map(len, key)) // (most or SORTED) + 1
    size = max(int(x[-1]) for x in key) + 1 - least
    inner = np.array([least + size * t // k for t in range(1, k)], np.uint64)
    at = [[0, *np.searchsorted(x, inner).tolist(), len(x)] for x in key]
    for t in range(k):
        yield [np.concatenate([x[a[t] : a[t + 1]] for x, a in zip(column, at)]) for column in (key, *others)]


def shared_shingles(docs: DataFrame, heavy: np.ndarray | None = None, others: dict[tuple[int, int], int] | None = None) -> DataFrame:
    """(class, n, hashes, prefix, common) of each class that may have a partner.

    hashes: those of its shingles that others have; common: of how many classes its shingles are, on average.
    heavy: ascending hashes of shingles of very many classes; others: classes with other names, see ``renamed``.
    """
    heavy, others = (np.zeros(0, np.uint64) if heavy is None else heavy), others or {}
    spark = docs.sparkSession
    rows = docs.select(F.col("text").cast("string"))
    parts = max(2, -(-scan_bytes(rows) // PART))
    step = (1 << 64) // parts

    def postings(batches):
        held, total = [], 0
        for batch in batches:
            for _, data, at in slices(batch, "text"):
                row, h, n, name, second = text_sets(data, at)
                held.append((row.astype(np.uint32), h, n, renamed(name, second, others)))
                total += len(h)
                if total > FLUSH or len(held) > 100:
                    yield from dealt(held)
                    held, total = [], 0
        if total:
            yield from dealt(held)
        trim()

    def dealt(held):
        """``held`` as packed rows; it is emptied, and each column is let go once the next is made, as all of a task's memory counts."""
        at = 0
        for x in held:
            np.add(x[0], np.uint32(at), out=x[0])
            at += len(x[2])
        row, h, n, name = (np.concatenate([x[k] for x in held]) for k in range(4))
        held.clear()
        name, first, back = np.unique(name, return_index=True, return_inverse=True)  # equal sets once
        ref = back.astype(np.uint32)[row]
        once = first.astype(np.uint32)[ref] == row
        del row
        ref, h, n = ref[once], h[once], n[first].astype(np.uint32)
        del once
        out = []
        if len(heavy) and (known := heavy[np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)] == h).any():
            # straight to the classes, through any part
            for to, *columns in back_to_classes(name[ref[known]], h[known], np.full(known.sum(), _MOST), n[ref[known]]):
                out.append((int(h[known][0] % np.uint64(parts)), *columns, to))
            ref, h = ref[~known], h[~known]
        order = np.argsort(h, kind="stable")
        ref, h = ref[order], h[order]
        del order
        edges = np.searchsorted(h, np.array([k * step for k in range(parts)], np.uint64))
        for part, (i, j) in enumerate(zip(edges, [*edges[1:], len(h)])):
            if i < j:
                used, ref_ = np.unique(ref[i:j], return_inverse=True)
                out.append((part, _zip(_deltas(h[i:j])), _zip(ref_.astype(np.uint32)), _zip(_deltas(name[used])), _zip(n[used]), None))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], ["part", "h", "ref", "name", "n", "to"])

    kinds = [pa.int64(), *[pa.binary()] * 4, pa.int64()]

    def back_to_classes(name, h, df, n):
        """Packed rows of postings, by the part that holds their class: part, name, h, df, n."""
        to = (name % np.uint64(parts)).astype(np.min_scalar_type(parts))
        order = np.argsort(to, kind="stable")
        edges = np.concatenate([[0], np.cumsum(np.bincount(to, minlength=parts))])
        out = []
        for p, (i, j) in enumerate(zip(edges, edges[1:])):
            if i < j:
                own = order[i:j]
                own = own[np.argsort(name[own], kind="stable")]
                out.append((p, _zip(_deltas(name[own])), _zip(h[own]), _zip(df[own]), _zip(n[own])))
        return out

    def counted(batches):
        """One part: all postings of its range of hashes."""
        h, ref, name, n, at = [], [], [], [], 0
        for batch in batches:
            for a, b, c, d, to in zip(*(batch.column(k).to_pylist() for k in ("h", "ref", "name", "n", "to")), strict=True):
                if to is not None:  # heavy ones: their columns are in the order of ``back_to_classes``
                    yield _blobs([(to, a, b, c, d)])
                    continue
                h.append(np.cumsum(_unzip(a, np.uint64), dtype=np.uint64))
                name.append(np.cumsum(_unzip(c, np.uint64), dtype=np.uint64))
                n.append(_unzip(d, np.uint32))
                ref.append(_unzip(b, np.uint32) + np.uint32(at))
                at += len(name[-1])
        if not h:
            return
        name, n = np.concatenate(name), np.concatenate(n)
        found = [[np.zeros(0, k)] for k in (np.uint64, np.uint64, np.uint32, np.uint32)]
        for x in in_ranges(h, ref):
            for column, of in zip(found, shared(*x, name, n)):
                column.append(of)
        del h, ref
        columns = []
        while found:  # one by one, each list let go
            columns.append(np.concatenate(found.pop(0)))
        if len(columns[0]):
            yield _blobs(back_to_classes(*columns))
        del columns
        trim()

    def shared(h, ref, name, n):
        """name, h, df, n of the postings whose shingle several classes have, by h and name."""
        order = np.argsort(h, kind="stable")
        h, ref = h[order], ref[order]
        again = h[1:] == h[:-1]
        often = np.zeros(len(h), bool)
        often[1:] = again
        often[:-1] |= again
        h, ref = h[often], ref[often]
        name_ = name[ref]
        order = np.lexsort((name_, h))
        h, name_, n_ = h[order], name_[order], n[ref][order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (name_[1:] != name_[:-1])  # a class that several tasks have met
        h, name_, n_ = h[new], name_[new], n_[new]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        group_of = np.cumsum(new) - 1
        df = np.bincount(group_of)[group_of].astype(np.uint32)
        keep = df > 1
        return name_[keep], h[keep], df[keep], n_[keep]

    def prefixes(batches):
        """One part: all classes whose names fall there, with their postings."""
        columns = [[] for _ in range(4)]
        for batch in batches:
            for column, c, kind in zip(columns, ("name", "h", "df", "n"), (np.uint64, np.uint64, np.uint32, np.uint32)):
                column += [np.cumsum(y, dtype=kind) if c == "name" else y for y in (_unzip(x, kind) for x in batch.column(c).to_pylist())]
        if not columns[0]:
            return
        for x in in_ranges(*columns):
            yield from prefixed(*x)
        del columns
        trim()

    def prefixed(name, h, df, n):
        order = np.lexsort((h, df, name))
        name, h, df, n = name[order], h[order], df[order], n[order].astype(np.int64)
        again = np.zeros(len(h), bool)
        again[1:] = (name[1:] == name[:-1]) & (h[1:] == h[:-1])  # heavy ones of a class that several tasks have met
        name, h, df, n = name[~again], h[~again], df[~again], n[~again]
        begin = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, np.int64)
        end = np.append(begin[1:], len(name))[: len(begin)]
        n = n[begin]
        alone = n - (end - begin)
        length = n - -(-PERCENT * n // 100) + 1 - alone
        out = []
        for i, j, size, k in zip(begin, end, n, length):
            if k > 0:
                out.append((int(name[i : i + 1].view(np.int64)[0]), int(size), np.sort(h[i:j]).tobytes(), h[i : i + k].view(np.int64), (float(df[i:j].sum()) + size - (j - i)) / size))
            if len(out) == 4096:
                yield _classes(out)
                out = []
        yield _classes(out)

    blobs = rows.mapInArrow(postings, "part long, h binary, ref binary, name binary, n binary, to long")
    back = blobs.repartitionById(parts, F.col("part").cast("int")).mapInArrow(counted, "part long, name binary, h binary, df binary, n binary")
    return back.repartitionById(parts, F.col("part").cast("int")).mapInArrow(prefixes, "class long, n long, hashes binary, prefix array<long>, common double")


def _blobs(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds)], ["part", "name", "h", "df", "n"])


def _classes(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds)], ["class", "n", "hashes", "prefix", "common"])


# --- T-occurrence search ----------------------------------------------------------------------------------------------


class Lists:
    """The inverted lists of a block of sets: of each hash the ascending places in the block."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        self.sizes = np.array(sizes, np.int64)
        h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(h, kind="stable")
        h, self.who = h[order], who[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        self.begin = np.flatnonzero(new)
        self.names, self.end = h[self.begin], np.append(self.begin[1:], len(h))[: len(self.begin)]
        #: (list, place) as one ascending number, for binary search
        self.keys = (np.cumsum(new) - 1) * len(sets) + self.who

    def search(self, hashes: np.ndarray, n: int, mu: float = 0.0085) -> np.ndarray:
        """Places of the sets that overlap a set of ``n`` elements as much as a likeness of ``PERCENT`` needs (DivideSkip)."""
        none = np.zeros(0, np.int64)
        t = -(-PERCENT * n // 100)  # no partner shares fewer
        at = np.searchsorted(self.names, hashes)
        lists = at[(at < len(self.names)) & (self.names[np.minimum(at, len(self.names) - 1)] == hashes)] if len(self.names) else none
        if len(lists) < t:
            return none
        length = self.end[lists] - self.begin[lists]
        lists = lists[np.argsort(length, kind="stable")]
        n_long = min(t - 1, int(t / (mu * math.log2(int(length.max()) + 1) + 1)))
        short, long_ = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        need = needed(n, self.sizes)
        # the short lists, each ascending, merged to one
        merged = np.sort(np.concatenate([self.who[self.begin[x] : self.end[x]] for x in short]), kind="stable")
        first = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        who, count = merged[first], np.diff(np.append(first, len(merged)))
        alive = count >= t - n_long
        who, count = who[alive], count[alive]
        for i in range(0, n_long, PROBED):  # of each long list, only the candidates are looked up
            alive = count + n_long - i >= need[who]
            who, count = who[alive], count[alive]
            if not len(who):
                return none
            wanted = long_[i : i + PROBED, None] * len(self.sizes) + who
            found = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            count = count + (self.keys[found] == wanted).sum(axis=0)
        return who[count >= need[who]]


def _compared(group: pa.Table) -> pa.Table:
    """Rows (class, n, hashes, root, side) of one block: the pairs of roots (a, b) of which a member of side 0 links with one of side 1."""
    n, root, side = (group.column(k).to_numpy() for k in ("n", "root", "side"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("hashes")]
    queries, others = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if len(queries) > len(others):  # the fewer are the queries: linked are both or none
        queries, others = others, queries
    if not len(queries):
        return pa.Table.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
    lists, pairs = Lists([sets[i] for i in others], n[others].tolist()), [np.zeros((0, 2), np.int64)]
    for q in queries:
        found = others[lists.search(sets[q], int(n[q]))]
        found = found[root[found] != root[q]]
        found = np.unique(root[found])
        pairs.append(np.column_stack([np.full(len(found), root[q]), found]))
    pairs = np.concatenate(pairs)
    return pa.Table.from_arrays([pa.array(pairs[:, k]) for k in (0, 1)], ["a", "b"])


def class_links(classes: DataFrame) -> DataFrame:
    """(node, root) of the classes that link with another; ``classes``: as of ``shared_shingles``."""
    members = classes.select(F.explode("prefix").alias("list"), "class", "n", "common")
    lists = members.groupBy("list").agg(F.count("*").alias("k"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("mark"))
    lists = lists.where("k > 1").groupBy("k", "mark").agg(F.min("list").alias("list"))  # equal lists once
    members = cut(members.join(lists.select("list"), "list"))
    few = members.count() // ROWS + 1  # partitions of tables that have no more rows than this one
    members = whole(members, few)
    sets = classes.select("class", "n", "hashes")
    tested = None
    roots = members.select(F.col("class").alias("node"), F.col("class").alias("root")).where("false")
    for turn in range(ROUNDS):
        release(classes.sparkSession)
        open_ = whole(cut(_open(members, roots).coalesce(few)), few)
        if open_.isEmpty():
            return roots
        # the leader: of all that aren't in the list's largest component, the one most like the others (an original, not a copy)
        size = open_.groupBy("list", "root").agg(F.count("*").alias("k"))
        # written, so that each join below is a stage of its own, in which Spark splits the members of a long list
        main = cut(size.groupBy("list").agg(F.max(F.struct("k", "root")).alias("main"), F.sum("k").alias("members")).coalesce(few))
        main = whole(main, few)
        lead = open_.join(main, "list").where("main.k = 1 or root <> main.root").groupBy("list").agg(F.max(F.struct("common", "class", "n", "root")).alias("q"), F.max("members").alias("members"))
        lead = whole(cut(lead.coalesce(few)), few)
        pairs = open_.join(lead, "list").where("root <> q.root").where(f"100 * least(n, q.n) >= {PERCENT} * greatest(n, q.n)")
        pairs = pairs.select(F.col("q.class").alias("a"), F.col("class").alias("b"), F.col("q.root").alias("ra"), F.col("root").alias("rb"), "members", "q.common")
        if turn:
            pairs = pairs.select("a", "b", "ra", "rb").distinct()
        else:  # a group of copies shares many lists: first each class meets the leader of its longest list alone
            longest = F.max(F.struct("members", "common", "a", "ra")).alias("m")
            pairs = pairs.groupBy("b", "rb").agg(longest).select("m.a", "b", "m.ra", "rb")
        if tested is not None:
            pairs = pairs.join(whole(tested, few), ["a", "b"], "left_anti")
        pairs = whole(cut(pairs.coalesce(few)), few)
        if pairs.isEmpty():
            break
        size = pairs.groupBy("a", "ra").agg(F.count("*").alias("k"))
        blocks = size.withColumn("s", F.explode(F.sequence(F.lit(0), F.expr(f"cast((k - 1) div {BLOCK} as int)"))))
        queries = blocks.select(F.col("a").alias("q"), "s", F.col("a").alias("class"), F.col("ra").alias("root"), F.lit(0).alias("side"))
        others = pairs.join(size.drop("ra"), "a").select(F.col("a").alias("q"), F.expr(f"cast(pmod(xxhash64(b), (k - 1) div {BLOCK} + 1) as int)").alias("s"), F.col("b").alias("class"), F.col("rb").alias("root"), F.lit(1).alias("side"))
        found = queries.unionByName(others).join(sets, "class").groupBy("q", "s").applyInArrow(_compared, "a long, b long")
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        roots = _joined(roots, found, few)
    release(classes.sparkSession)
    # what is still open is searched whole: all outside the largest component among all; partners are at most one size class of a quarter apart
    open_ = cut(_open(members, roots).withColumn("c", F.floor(F.log("n") / math.log(100 / PERCENT) - 1e-9).cast("int")).coalesce(few))
    if open_.isEmpty():
        return roots
    open_ = whole(open_, few)
    size = open_.groupBy("list", "root").agg(F.count("*").alias("k")).groupBy("list").agg(F.max(F.struct("k", "root")).alias("main"))
    open_ = cut(open_.join(whole(cut(size.coalesce(few)), few), "list").select("list", "c", "class", "root", (F.col("root") == F.col("main.root")).alias("in_main")).coalesce(few))
    apart = F.expr(f"cast((count_if(not in_main) - 1) div {BLOCK} + 1 as int)").alias("ks")
    k = cut(whole(open_, few).groupBy("list", "c").agg(F.expr(f"cast((count(*) - 1) div {BLOCK} + 1 as int)").alias("kt"), apart, F.count_if(~F.col("in_main")).alias("outside")).coalesce(few))
    if few == 1:
        open_ = open_.repartition(DEALT)  # from here on each row becomes many, which isn't one task's work
    near = k.select("list", F.col("c").alias("d"), F.col("kt").alias("kd"))
    asked = open_.where("not in_main").join(k, ["list", "c"]).withColumn("s", F.expr("cast(pmod(xxhash64(class), ks) as int)")).join(near, "list").where("abs(c - d) <= 1")
    asked = asked.withColumn("t", F.explode(F.expr("sequence(0, kd - 1)"))).select("list", "c", "s", "d", "t", "class", "root", F.lit(0).alias("side"))
    near = k.where("outside > 0").select("list", F.col("c").alias("e"), F.col("ks").alias("ke"))
    others = open_.join(k, ["list", "c"]).withColumn("t", F.expr("cast(pmod(xxhash64(class), kt) as int)")).join(near, "list").where("abs(c - e) <= 1")
    others = others.withColumn("s", F.explode(F.expr("sequence(0, ke - 1)"))).select("list", F.col("e").alias("c"), "s", F.col("c").alias("d"), "t", "class", "root", F.lit(1).alias("side"))
    release(classes.sparkSession)
    both = asked.unionByName(others).select(F.concat_ws(":", "list", "c", "s", "d", "t").alias("q"), "class", "root", "side")
    return _joined(roots, both.join(sets, "class").groupBy("q").applyInArrow(_compared, "a long, b long"), few)


def _joined(roots: DataFrame, links: DataFrame, parts: int) -> DataFrame:
    """(node, root) once roots that ``links`` (a, b) join are one; a node that isn't in ``roots`` was its own.

    ``links`` go from the tasks that find them through one shuffle into ``parts`` files, not first into one a task: for every file in a local
    folder Hadoop starts processes (chmod) from the executor, and until such a process runs its own program it counts as large as the executor.
    """
    new = whole(components(links, parts), parts)
    moved = roots.join(new.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return whole(cut(moved.unionByName(new.join(roots, "node", "left_anti").select("node", "root")).coalesce(parts)), parts)


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members, with their roots, of lists that hold several."""
    named = members.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    several = named.groupBy("list").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("list")
    return named.join(several, "list")


def _told_apart(rows: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """``rows`` with other classes for sets that share a name, and those: (name, second sum) to name.

    Of n classes about n**2 / 2**65 share a name, which are all that comes to the driver.
    """
    same = rows.where("class is not null").groupBy("class").agg(F.min("second").alias("x"), F.max("second").alias("y")).where("x < y").select("class", "x")
    pairs = rows.join(same, "class").where("second > x").select("class", "second").distinct().collect()
    unsigned = lambda x: x & ((1 << 64) - 1)
    others = {(unsigned(r["class"]), unsigned(r.second)): int(mix(mix(np.array([r["class"]], np.int64).view(np.uint64)) ^ np.array([r.second], np.int64).view(np.uint64))[0]) for r in pairs}
    if others:
        table = rows.sparkSession.createDataFrame([(r["class"], r.second, (v := others[unsigned(r["class"]), unsigned(r.second)]) - ((v >> 63) << 64)) for r in pairs], "class long, second long, other long")
        rows = rows.join(table, ["class", "second"], "left").withColumn("class", F.coalesce("other", "class"))
    return rows.select("doc_id", "n_shingles", "class"), others


def jaccard_components(docs: DataFrame, heavy: int = HEAVY, local: int = LOCAL) -> DataFrame:
    """Of every row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_shingles, component_id.

    component_id: the smallest doc_id that can be reached by links, its own included. A null or wordless text has an empty
    set and no links, so its component is itself; a null doc_id takes part and is never the smallest, unless alone (then null).
    Equal rows stay, each with the same result.
    """
    rows = cut(set_sizes(docs, local))
    told, rows = rows.where("n_shingles < 0"), rows.where("n_shingles >= 0")
    many = told.groupBy("class").agg(F.sum("second").alias("k")).where(F.col("k") >= max(heavy, rows.count() // HEAVY_ROWS))
    many = np.array([r["class"] for r in many.collect()], np.int64).view(np.uint64)
    rows, others = _told_apart(rows)
    release(docs.sparkSession)
    roots = class_links(cut(shared_shingles(docs, np.sort(many), others)))
    release(docs.sparkSession)
    classes = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    named = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(of_root, "root").select("class", "component_id")
    return rows.join(named, "class", "left").select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
