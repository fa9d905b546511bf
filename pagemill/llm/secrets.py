"""Secret scans (operator 5) with an incremental blob ledger, with DataFrame operations alone.

A text is a blob, named by its SHA-256. The ledger is a table that says of every (blob, rule, rule version) what was found. A scan
looks up which of these pairs it doesn't have, reads one copy of each such blob, applies the rules not yet applied to it, and
appends to the ledger. Findings are joined back to all rows that hold a blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut


@dataclass(frozen=True)
class Rule:
    """A pattern that counts where ``group`` has ``least`` characters at least; a new pattern needs a new version.

    ``needle``: what every match contains; a text without it isn't matched.
    """

    name: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1
    needle: str = ""


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, needle="AKIA"),
    Rule("hex", r"[0-9a-f]{16,}"),  # a run counts whole or not at all, so its least length may stand in the pattern
)
#: What stands between a private key's BEGIN and END, its headers aside; line ends may be escaped.
_KEY = r"[A-Za-z0-9+/=\x09-\x0D\x20\\]"
MORE = (
    # up to 64 headers, then all up to the END line; where that is missing, all up to the last run of 16 signs of base64 that only
    # such signs and white space part from the rest. No group repeats without bound: Java follows each turn by recursion
    Rule("private_key", rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[\x09-\x0D\x20]++[A-Za-z0-9-]++:[^\r\n]*+){{0,64}}(?:{_KEY}*+-----END [A-Z ]*PRIVATE KEY-----|{_KEY}*[A-Za-z0-9+/=]{{16}}|)", version=4, needle="-----BEGIN "),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needle="eyJ"),
    Rule("code_host_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + MORE
LEDGER = "blob string, found array<struct<rule:string,version:int,spans:array<struct<start:int,end:int>>>>"
_SPANS = "array<struct<start:int,end:int>>"


def spans(text: Column, rule: Rule) -> Column:
    """Begin and end (code points, end exclusive) of the rule's leftmost matches that don't overlap, without failing ones."""
    # the text is matched twice, for the matches and for what lies between; only lengths are kept of either
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    value = (lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group))) if rule.group else F.length
    found = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda m: F.struct(F.length(m).alias("size"), value(m).alias("v")))
    parts = F.zip_with(found, gaps, lambda m, g: F.struct(g.alias("gap"), m["size"].alias("size"), m["v"].alias("v")))
    parts = F.slice(parts, 1, F.size(found))  # there is one gap more
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin, end = a["at"] + x["gap"], a["at"] + x["gap"] + x["size"]
        return F.struct(end.alias("at"), F.when(x["v"] >= rule.least, F.array_append(a["out"], F.struct(begin.alias("start"), end.alias("end")))).otherwise(a["out"]).alias("out"))

    may = text.contains(rule.needle) & text.rlike(rule.pattern) if rule.needle else text.rlike(rule.pattern)
    return F.when(may, F.aggregate(parts, zero, step)["out"]).otherwise(F.array().cast(_SPANS))


def scan(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Brings the ledger at ``path`` up to date with ``docs`` (text; other columns are ignored) and returns what it then holds.

    A null text is empty. Texts are shuffled once, one copy of each blob a task. Nothing is appended if nothing is new.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    ledger = _read(spark, path)
    names = [f"{r.name}:{r.version}" for r in rules]
    blobs = texts.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        unseen = [(r, F.lit(True)) for r in rules]
    else:
        known = ledger.select("blob", F.explode("found").alias("f")).groupBy("blob").agg(F.collect_set(F.concat_ws(":", "f.rule", "f.version")).alias("known"))
        whole = known.where(F.size(F.array_except(F.array(*map(F.lit, names)), "known")) == 0).select("blob")
        texts = texts.join(whole, "blob", "left_anti")
        blobs = texts.groupBy("blob").agg(F.first("text").alias("text")).join(known, "blob", "left")
        unseen = [(r, ~F.array_contains(F.coalesce("known", F.array().cast("array<string>")), n)) for r, n in zip(rules, names, strict=True)]
    each = [F.when(new, F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans"))) for r, new in unseen]
    blobs.select("blob", F.array_compact(F.array(*each)).alias("found")).write.mode("append").parquet(path)
    return _read(spark, path)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":  # no ledger yet
            return None
        raise


def findings(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``docs`` with ``__spans``: an array of (start, kind number, end) by start, then kind, of ``rules``' versions."""
    ledger = scan(docs, path, rules)
    number = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (f"{r.name}:{r.version}", k)])
    found = ledger.select("blob", F.explode("found").alias("f")).select("blob", number[F.concat_ws(":", "f.rule", "f.version")].alias("kind"), F.explode("f.spans").alias("x"))
    found = found.where("kind is not null").groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("x.start", "kind", "x.end"))).alias("__spans"))
    found = cut(found)  # so that the join below is a stage of its own, in which Spark splits the rows of a text with many copies
    rows = docs.withColumn("__blob", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    return rows.join(found.withColumnRenamed("blob", "__blob"), "__blob", "left").drop("__blob")


def _listed(kinds: list[str], spans_: Column) -> Column:
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def _is(kind: int):
    return lambda x: x["kind"] == kind


def secret_report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of ``docs`` (doc_id, text; others are ignored)."""
    rows = findings(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), path)
    every = F.coalesce("__spans", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    rows = rows.select("doc_id", every.alias("s"))
    kinds = [r.name for r in RULES]
    counts = [F.size(F.filter("s", _is(k))).cast("long").alias(f"n_{r.name}") for k, r in enumerate(BASE)]
    base = F.filter("s", lambda x: x["kind"] < len(BASE))
    return rows.select("doc_id", *counts, F.sha2(_listed(kinds, base), 256).alias("base_sha256"), _listed(kinds, F.col("s")).alias("spans"))


def redacted(docs: DataFrame, path: str, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark`` (overlapping ones together); n_chars, if there, is counted anew."""
    names = docs.columns
    rows = findings(docs, path)
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), a["at"] + 1, F.greatest(x["start"] - a["at"], F.lit(0)))
        out = F.when((x["start"] > a["at"]) | (a["at"] == 0), F.concat(a["out"], gap, F.lit(mark))).otherwise(a["out"])
        return F.struct(out.alias("out"), F.greatest(a["at"], x["end"]).alias("at"))

    cut_ = F.aggregate("__spans", zero, step)
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(F.concat(cut_["out"], F.expr("substring(text, 1 + array_max(transform(__spans, x -> x.end)))")))
    rows = rows.withColumn("text", text)
    return (rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else rows).select(*names)
