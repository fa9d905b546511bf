"""Links of pages resolved to files: which lead nowhere, which files no page names, and what can't be reached from the entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.books import shared_folder

_LINK = r"""(?i)(?:href|src)\s*=\s*["']([^"']+)["']"""
_BASE = r"""(?i)<base\s[^>]*?href\s*=\s*["']([^"']*)["']"""


def normal_path(path: Column) -> Column:
    """A path without empty and ``.`` parts and with ``..`` carried out; null where it leads out of its root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    zero = F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("out"))

    def step(a: Column, p: Column) -> Column:
        up = F.struct(F.slice(a["at"], 1, F.greatest(F.size(a["at"]) - 1, F.lit(0))).alias("at"), (a["out"] | (F.size(a["at"]) == 0)).alias("out"))
        return F.when(p == "..", up).otherwise(F.struct(F.array_append(a["at"], p).alias("at"), a["out"].alias("out")))

    return F.aggregate(parts, zero, step, lambda a: F.when(~a["out"], F.array_join(a["at"], "/")))


def resolved(pages: DataFrame, path: str = "path", html: str = "html") -> DataFrame:
    """(path, link, target) of each page's distinct local links. target: the file's path from the root, null for one that leads out of it.

    Fragments and queries are cut off, percent signs decoded (a broken one stays as it is), ``<base>`` is followed, a leading slash means the
    root. Links with a scheme and mere fragments are left out.
    """
    based = F.lower(html).contains("<base")  # few pages are, and all others are searched once
    plain_ = F.when(based, F.regexp_replace(html, r"(?i)<base\s[^>]*>", "")).otherwise(F.col(html))
    found = F.array_distinct(F.regexp_extract_all(plain_, F.lit(_LINK), F.lit(1)))
    rows = pages.select(F.col(path).alias("path"), F.when(based, F.regexp_extract(html, _BASE, 1)).otherwise("").alias("base"), F.explode(found).alias("link"))
    rows = rows.where(r"not link rlike '^(?:[A-Za-z][A-Za-z0-9+.-]*:|//|#)' and not base rlike '^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)'")
    cut = F.regexp_replace("link", r"[?#].*$", "")
    plain = F.coalesce(F.try_url_decode(F.replace(cut, F.lit("+"), F.lit("%2B"))), cut)
    folder = lambda p: F.regexp_replace(p, r"[^/]*$", "")
    at = F.when(F.col("base").startswith("/"), folder(F.col("base"))).otherwise(F.concat(folder(F.col("path")), folder(F.col("base"))))
    whole = F.when(plain.startswith("/"), plain).when(plain == "", F.col("path")).otherwise(F.concat(at, plain))
    return rows.select("path", "link", normal_path(whole).alias("target"))


def held(links: DataFrame) -> DataFrame:
    """``resolved`` links written once to the shared folder: what is asked of them in turn doesn't search the pages again."""
    folder = shared_folder(links.sparkSession)
    links.write.parquet(folder)
    return links.sparkSession.read.parquet(folder)


def dangling(links: DataFrame, files: DataFrame) -> DataFrame:
    """(path, link, why) of links (path, link, target) that lead out of the root or to no file (path)."""
    there = files.select(F.col("path").alias("target")).distinct()
    lost = links.join(there, "target", "left_anti")
    return lost.select("path", "link", F.when(F.col("target").isNull(), "link escapes output folder").otherwise("link target missing").alias("why"))


def orphans(links: DataFrame, files: DataFrame) -> DataFrame:
    """(path) of files that no other page links to."""
    named = links.where("target <> path").select(F.col("target").alias("path")).distinct()
    return files.select("path").distinct().join(named, "path", "left_anti")


def unreachable(links: DataFrame, files: DataFrame, entry: str) -> DataFrame:
    """(path) of files that no chain of links from ``entry`` leads to.

    Rounds of one step each from what the last has found, as many as the longest of the shortest chains; each round is written, and
    only its size comes to the driver.
    """
    spark, folder = links.sparkSession, shared_folder(links.sparkSession)
    files.select("path").distinct().write.parquet(f"{folder}/files")
    all_ = spark.read.parquet(f"{folder}/files")
    steps = links.where("target is not null").select("path", "target").distinct().join(all_.withColumnRenamed("path", "target"), "target", "left_semi")
    steps.select("path", "target").write.parquet(f"{folder}/steps")
    steps = spark.read.parquet(f"{folder}/steps")
    all_.where(F.col("path") == entry).write.parquet(f"{folder}/round=0")
    k, seen = 0, spark.read.parquet(f"{folder}/round=0")
    last = seen
    while not last.isEmpty():
        k += 1
        next_ = steps.join(last, "path", "left_semi").select(F.col("target").alias("path")).distinct().join(seen, "path", "left_anti")
        next_.write.parquet(f"{folder}/round={k}")
        last = spark.read.schema("path string").parquet(f"{folder}/round={k}")
        seen = spark.read.schema("path string").parquet(*[f"{folder}/round={i}" for i in range(k + 1)])
    return all_.join(seen, "path", "left_anti")
