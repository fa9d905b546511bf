"""The queries of this subpackage, each an operator over a whole table with the parameters meant for use."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, divergence, fingerprint, html_text, jaccard, mixing, neardup, neighbours, packing, quality, secrets, sstable, toxicity
from .common import shared_dir, table
from .encoding import tokenizer_path

WORD_TOKENIZER, BYTE_TOKENIZER = "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_spans(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/ledger")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_token_shards, op3_source_mixing, op4_fingerprints, op5_secret_scan, op6_quality, op7_nearest_neighbours, op8_packing, op9_jaccard_join, op10_toxicity,
        op11_centroid_clustering, op12_embedding_neardup, op13_source_divergence,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All pairs that share a shingle, and their closure: for small tables.
_JACCARD = rf"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') as w from documents),
 sets as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w),
 each as (select doc_id, len(s) as n, unnest(s) as x from sets),
 pairs as (select a.doc_id as a, b.doc_id as b from each a join each b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2 having 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
 reached as (select doc_id, doc_id as seen from sets union select r.doc_id, p.b from reached r join pairs p on p.a = r.seen)
 select doc_id, cast(any_value(n) as bigint) as n_shingles, min(seen) as component_id from reached join (select doc_id, len(s) as n from sets) using (doc_id) group by doc_id"""


def _spans_sql(kind: int) -> str:
    """(doc_id, start, kind, end) of a rule's matches: places come from the lengths of what lies between them."""
    rule = secrets.RULES[kind]
    pattern = re.sub(r"(?<=[*+])\+", "", rule.pattern).replace("'", "''")  # DuckDB has no possessive repeats; here they change nothing
    value = f"length(regexp_extract(m, p, {rule.group}))" if rule.group else "length(m)"
    return f"""select doc_id, b as start, {kind} as kind, b + size as "end" from (select *, cast(sum(gap + size) over (partition by doc_id, t order by i) - size as bigint) as b from (
 select doc_id, t, i, length(g[i]) as gap, length(f[i]) as size, {value.replace("m,", "f[i],").replace("(m)", "(f[i])")} as v from (select *, unnest(range(1, len(f) + 1)) as i from (
 select doc_id, t, p, regexp_extract_all(t, p) as f, string_split_regex(t, p) as g from (select doc_id, coalesce(text, '') as t, '{pattern}' as p from documents) where regexp_matches(t, p))))) where v >= {rule.least}"""


def _secrets_sql() -> str:
    names = "[" + ", ".join(f"'{r.name}'" for r in secrets.RULES) + "]"
    listed = f"""string_agg({names}[kind + 1] || ':' || start || ':' || "end", ',' order by start, kind)"""
    counts = ", ".join(f"count(*) filter (kind = {k}) as n_{r.name}" for k, r in enumerate(secrets.BASE))
    found = " union all ".join(_spans_sql(k) for k in range(len(secrets.RULES)))
    return f"""select doc_id, {counts}, sha256(coalesce({listed} filter (kind < {len(secrets.BASE)}), '')) as base_sha256, coalesce({listed} filter (kind is not null), '') as spans
 from documents left join ({found}) using (doc_id) group by doc_id"""


#: Every source meets every other, every kept term: for small tables.
_DIVERGENCE = rf"""with d as (select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as t from documents),
 w as (select i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
 kept as (select lang, term from w group by lang, term having count(distinct i) >= {divergence.LEAST}), size as (select lang, count(*) as v from kept group by lang),
 groups as (select distinct lang, source from d), counts as (select lang, source, term, count(*) as n from w join kept using (lang, term) group by all),
 every as (select lang, source, term, coalesce(n, 0) as n, sum(coalesce(n, 0)) over (partition by lang, source) as total, v from groups join kept using (lang) join size using (lang) left join counts using (lang, source, term)),
 p as (select lang, source, term, n, 1 + ({divergence.ONE}::hugeint * (n + {divergence.ADDED})) // (total + {divergence.ADDED} * v) as p from every),
 q as (select lang, term, 1 + ({divergence.ONE}::hugeint * (sum(n) + {divergence.ADDED})) // (any_value(t) + {divergence.ADDED} * any_value(v)) as q from every join (select lang, sum(n) as t from counts group by lang) using (lang) group by lang, term),
 pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sum(abs(x.p - y.p)), 0)::bigint as value from groups a join groups b on a.lang = b.lang and a.source <> b.source
 left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term group by all),
 terms as (select lang, source, 'term' as part, term as item, (p - q)::bigint as value from p join q using (lang, term) where n > 0 and p > q),
 ranked as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as r from (select * from pairs union all select * from terms))
 select lang, source, part, item, value, r::int as rank from ranked where part = 'pair' or r <= {divergence.RANKS}"""



def _clusters_sql() -> str:
    """Every round as two common tables: the nearest centroid of each vector, and the centroids that follow."""
    width, scale = centroids.WIDTH, centroids.SCALE
    finite = "len(embedding) = {} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)".format(width)
    parts = [
        f"k as materialized (select vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::hugeint) as v from embeddings where {finite})",
        f"c0 as materialized (select row_number() over (order by sha256('3:' || vec_id), v) - 1 as c, v as m from k qualify c < {centroids.CLUSTERS})",
    ]
    for i in range(centroids.ROUNDS + 1):
        far = "list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        parts.append(f"a{i} as materialized (select vec_id, v, arg_min(c, (e, c)) as c, min(e) as e from (select vec_id, v, c, {far}::hugeint as e from k, c{i}) group by vec_id, v)")
        if i < centroids.ROUNDS:
            each = f"select c, j, sum(v[j])::hugeint as s, count(*) as n from a{i}, range(1, {width + 1}) t(j) group by c, j"
            mean = "(s - ((s % n) + n) % n) // n"
            parts.append(f"c{i + 1} as materialized (select c, coalesce(any_value(f.m), any_value(o.m)) as m from c{i} o left join (select c, list({mean} order by j) as m from ({each}) group by c) f using (c) group by c)")
    last = centroids.ROUNDS
    return f"""with {", ".join(parts)} select vec_id, c::int as cluster, e::bigint as distance, (sum(e) over (partition by c))::bigint as cluster_inertia, (sum(e) over ())::bigint as inertia,
 sha256(array_to_string(m, ',')) as centroid_sha256 from a{last} join c{last} using (c)"""


#: All pairs of a label, and their closure: for small tables.
_NEARDUP = f"""with recursive r as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings),
 good as (select * from r where label is not null and len(v) > 0 and len(list_filter(v, lambda x: x is not null and isfinite(x))) = len(v) and len(list_filter(v, lambda x: x <> 0)) > 0),
 pairs as (select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= {neardup.COSINE}),
 reached as (select vec_id, vec_id as seen from r union select x.vec_id, p.b from reached x join pairs p on p.a = x.seen)
 select vec_id, (select count(*) from pairs where a = vec_id)::bigint as n_links, min(seen) as component_id, vec_id = min(seen) as kept from reached group by vec_id"""

ORACLES: dict[str, str] = {"op12_embedding_neardup": _NEARDUP, "op11_centroid_clustering": _clusters_sql(), "op5_secret_scan": _secrets_sql(), "op9_jaccard_join": _JACCARD, "op13_source_divergence": _DIVERGENCE}
