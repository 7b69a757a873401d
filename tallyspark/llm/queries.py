"""The operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, infill, languages, nearcopies, packing, pseudonyms, repeats, scoring, separators, severity, spelling, topk, weighted
from .tables import documents, ready

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: function(ready(spark), sf_dir)
        if sql is not None:
            SQL[name] = sql.strip()
        return function

    return add


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"coalesce(regexp_extract_all({_LOWER.format('text')}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), [])"


@query("op1_language_mixture")
def language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = languages.identify(documents(spark, sf_dir))
    return found.select("doc_id", languages.held_out().alias("held_out"), "lang_pred", "score", "languages", "proportions")


@query("op2_setsketch_copies", f"""
with recursive d as (select doc_id, coalesce(regexp_extract_all({_LOWER.format('text')},
    '[^\\x20\\x09-\\x0D]+'), []) as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' ')) end) as t from d),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
both_ways as (select a, b from l union all select b, a from l),
reach(doc_id, other) as (select doc_id, doc_id from d union select r.doc_id, w.b from reach r join both_ways w on w.a = r.other)
select d.doc_id, cast(coalesce(any_value(n.n), 0) as bigint) as n_shingles, min(other) as component_id, d.doc_id = min(other) as kept
from d join reach using (doc_id) left join n using (doc_id) group by d.doc_id
""")
def setsketch_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_copies(documents(spark, sf_dir))


@query("op3_ordinal_severity")
def ordinal_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = severity.predict(docs, severity.fit(docs, labels, severity.from_labels()))
    return found.select("doc_id", "expected_severity", "severity_grade", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))


@query("op4_weighted_fingerprints")
def weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted.against_edits(documents(spark, sf_dir))


@query("op5_separator_counts")
def separator_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.token_counts(documents(spark, sf_dir))


@query("op6_feistel_pseudonyms")
def feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonyms.masked(documents(spark, sf_dir).select("doc_id", "text"), found="kinds")
    return found.select("doc_id", "text", F.size("kinds").cast("long").alias("n_replaced"),
                        F.array_join(F.array_sort(F.array_distinct("kinds")), ",").alias("kinds"))


@query("op7_benchmark_passages", f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
i as (select item_id, {_WORDS} as w from benchmark),
iw as (select distinct item_id, least(len(w), 10) as k, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1),
    lambda p: array_to_string(w[p:p + 9], ' '))) as s from i where len(w) > 0),
sizes as (select distinct k from iw),
dw as (select r, p, k, array_to_string(w[p:p + k - 1], ' ') as s
    from (select r, w, k, unnest(range(1, len(w) - k + 2)) as p from d, sizes where len(w) >= k)),
m as (select r, p, k, item_id from dw join iw using (k, s)),
hit as (select r, count(*) as n from (select distinct r, unnest(range(p, p + k)) as x from m) group by r),
items as (select r, count(*) as n, string_agg(x, ',' order by x) as l
    from (select distinct r, cast(item_id as varchar) as x from m where item_id is not null) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(hit.n, 0) as bigint) as n_hit,
  cast(coalesce(items.n, 0) as bigint) as n_items, sha256(coalesce(items.l, '')) as items_sha256,
  coalesce(hit.n, 0) > 0 as contaminated
from d left join hit using (r) left join items using (r)
""")
def benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


@query("op8_harmonic_packing")
def harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


@query("op9_ngram_scores")
def ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = languages.held_out(part=1)
    learn = F.col("doc_id").isNotNull() & ~held_out
    found = scoring.Scorer(documents(spark, sf_dir), learn).scores()
    return found.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op10_repeated_passages")
def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(documents(spark, sf_dir), keep_text=False)


@query("op11_spelling_variants")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(documents(spark, sf_dir)))


_TOKENS = "'[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+'"


def _draw(k: int) -> str:
    return f"cast('0x' || substr(h, {8 * k + 1}, 8) as bigint)"


@query("op12_infill_boundaries", f"""
with d as (select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
u as (select doc_id, t, regexp_extract_all(t, {_TOKENS}) as w, {_draw(0)} as h1, {_draw(1)} as h2, {_draw(2)} as h3,
    {_draw(3)} as h4 from d),
c as (select *, len(w) as n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) as p, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) as q,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain'
      when h4 % 100 < 80 then 'spm' else 'psm' end as form from u),
x as (select *, array_to_string(w[1:p], '') as a, array_to_string(w[p + 1:q], '') as b, array_to_string(w[q + 1:n], '') as e from c)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(a) end as prefix_chars,
  case when form <> 'plain' then length(b) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || a || '<S>' || e || '<M>' || b
    else '<S>' || e || '<P>' || a || '<M>' || b end) as output_sha256, sha256(t) as restored_sha256
from x
""")
def infill_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infill.transformed(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@query("op13_bit_sliced_top", """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
q as (select distinct vec_id, e from v where vec_id % 50 = 0),
s as (select q.vec_id as query_id, q.e, c.vec_id, coalesce(list_dot_product(q.e, c.e), 0) as score
    from q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
r as (select *, row_number() over (partition by query_id, e order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, cast(score as bigint) as score from r where rank <= 5
""")
def bit_sliced_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top(vectors, vectors.where("vec_id % 50 = 0"))
