"""The queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import language_id, quality_classifier, token_store
from .byte_bpe import encode_decode
from .centroid_clustering import centroid_clusters
from .common import bounded_batches, new_path, table
from .decontamination import benchmark_matches
from .html_extraction import extract_main_text
from .line_dedup import line_dedup
from .lm_scoring import lm_scores
from .ngram_jaccard import jaccard_components
from .periodic_runs import periodic_runs, planted
from .quality_rules import quality_rules
from .token_counts import section_tokens


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"), min_docs=10, texts=False).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.held_out(4, 2)
    model = language_id.train(docs.where(~out))
    return language_id.predict(docs.select("doc_id", "text", out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    token_store.write_store(table(spark, sf_dir, "documents"), path := new_path(spark, "store"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_store.read_digests(spark, path)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, streams=())


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules(table(spark, sf_dir, "documents")).select(*columns)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = language_id.held_out(5, 0)
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels").where(~out))
    scored = quality_classifier.score(docs.select("doc_id", "text", out.alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"), k=16, rounds=3, scale=64, dims=64, seed=1)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), least_words=24, least_times=3, rewrite=planted)


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), mod=5, rest=1)


def _application(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query whose session's Arrow batches are bounded for rows of any length, unless it has a bound of its own."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_line_dedup": op2_line_dedup,
    "op3_language_id": op3_language_id,
    "op4_token_store": op4_token_store,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_token_counts": op6_token_counts,
    "op7_quality_rules": op7_quality_rules,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_decontamination": op9_decontamination,
    "op10_html_extraction": op10_html_extraction,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_lm_scoring": op13_lm_scoring,
}
QUERIES = {name: _application(query) for name, query in QUERIES.items()}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": rf"""
with recursive w as (select doc_id, {_WORDS} as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from w),
t as (select doc_id, unnest(s) as t, len(s) as n from s),
i as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as k from t a join t b on a.t = b.t and a.doc_id <> b.doc_id group by 1, 2, 3, 4),
l as materialized (select a, b from i where 100 * k >= 75 * (na + nb - k)),
r(id, c) as (select a, a from l union select l.b, r.c from r join l on l.a = r.id and r.c <= l.b)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, coalesce(m.c, s.doc_id) as component_id
from s left join (select id, min(c) as c from r group by id) m on m.id = s.doc_id""",
    "op2_line_dedup": r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (select *, regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as key from l),
g as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
m as (select k.*, g.key is not null as gone from k left join g using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from m group by doc_id""",
}


def _clustering_sql(k: int = 16, rounds: int = 3) -> str:
    """Assignments and floored means, one pair of steps for each round."""
    distance = "list_sum(list_transform(list_zip(e.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} as materialized (
  select row_id, unnest(arg_min(struct_pack(c := c.c, d := d), struct_pack(d := d, c := c.c)))
  from (select e.row_id, c.c, cast({distance} as bigint) as d from e, c{r} c) c group by row_id)""")
        if r < rounds:
            steps.append(f"""s{r} as (select c, i, sum(x) as s, count(*) as n from
  (select a.c, unnest(e.v) as x, generate_subscripts(e.v, 1) as i from a{r} a join e using (row_id)) group by c, i),
c{r + 1} as materialized (
  select c0.c, coalesce(m.v, c0.v) as v from c{r} c0
  left join (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as v from s{r} group by c) m on m.c = c0.c)""")
    return f"""
with e as materialized (
  select row_number() over () as row_id, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (
  select row_number() over (order by h, v) - 1 as c, v
  from (select sha256('1:' || cast(vec_id as varchar)) as h, v from e where vec_id is not null order by h, v limit {k})),
{", ".join(steps)}
select e.vec_id, cast(a.c as int) as cluster, a.d as distance,
  cast(sum(a.d) over (partition by a.c) as bigint) as cluster_inertia, cast(sum(a.d) over () as bigint) as inertia,
  sha256(array_to_string(c.v, ',')) as centroid_sha256
from e join a{rounds} a using (row_id) join c{rounds} c on c.c = a.c"""


ORACLES["op11_centroid_clustering"] = _clustering_sql()
