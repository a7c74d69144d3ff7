"""The corpus operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_bpe, chat, decontaminate, hard_negatives, lm_score, merkle, near_join, quality, secrets, segments, substring_dedup, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digest_documents(_table(spark, sf_dir, "documents"), path, tokenizers.PATTERN, lone_space=True)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"), order=3)


#: The conversation that every template must survive: conv_id, turn, role, text.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    values = ", ".join(f"({c}L, {t}L, '{r}', '{x}')" for c, t, r, x in PROBE)
    probe = spark.sql(f"select * from values {values} as t(conv_id, turn, role, text)")
    return chat.report(chat.format_conversations(rows.unionByName(probe)))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def op6_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_join(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(_table(spark, sf_dir, "documents"))


#: host, path, verdict
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    rules = spark.sql(f"select * from values {values} as t(host, path, verdict)")
    return url_filter.judge(_table(spark, sf_dir, "pages"), rules)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, label)


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return segments.top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(_table(spark, sf_dir, "documents"))


_ALL = (
    op1_lm_score,
    op2_chat_format,
    op3_ann,
    op4_secret_scan,
    op5_byte_bpe,
    op6_near_join,
    op7_quality,
    op8_substring_dedup,
    op9_url_filter,
    op10_decontaminate,
    op11_hard_negatives,
    op12_top_k,
    op13_merkle,
)


def queries() -> dict:
    from corpus_pipeline import run

    return {f.__name__: f for f in _ALL} | {"pipeline": run}


_ESCAPED = r"regexp_replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '\[(/?INST)', '&lsqb;\1', 'g')"
_OP2 = """
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values {values}) as t(conv_id, turn, role, text)
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length('<|turn|>') + length(replace({role}, chr(10), '&nl;')) + 1 + length({text}) + length('<|end|>') + 1) as bigint) as formatted_chars
from rows group by conv_id
"""
_OP9 = r"""
with rest as (
  select page_id, case when url is not null and position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as r from pages
), places as (
  select page_id, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(r, '^[^?#]*(\?[^#]*)', 1) as query from rest
), rules as (
  select * from (values {rules}) as t(rule_host, rule_path, own)
), fits as (
  select page_id, host, path, rule_host || rule_path as rule, own,
    row_number() over (partition by host, path, page_id order by length(rule_host || rule_path) desc, own) as k
  from places join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
)
select p.page_id, p.host, p.path, f.rule, coalesce(f.own, 'allow') as verdict, case when f.own is null then 'default' else 'rule' end as "by"
from places p left join (select distinct page_id, host, path, rule, own from fits where k = 1) f using (page_id, host, path)
"""

_VECTORS = "select vec_id, {label} as label, list_transform(embedding, lambda x: floor({scale} * x::double)) as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
_OP11 = f"""
with v as materialized (
  select * from ({_VECTORS.format(scale=256, label="case when vec_id % 7 = 0 then (label + 1) % 10 else label end")}) where label is not null
), scores as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as alike, cast(list_dot_product(a.e, c.e) as bigint) as score
  from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 100 = 0
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scores where alike
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as int) as rank,
  vec_id as negative_id, positive_score, score as negative_score
from positives join scores using (anchor_id) where not alike and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 10
"""
_OP12 = f"""
with v as materialized ({_VECTORS.format(scale=64, label="0")})
select q.vec_id as query_id, cast(row_number() over (partition by q.vec_id order by list_dot_product(q.e, c.e) desc, c.vec_id) as int) as rank,
  c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
qualify row_number() over (partition by q.vec_id order by list_dot_product(q.e, c.e) desc, c.vec_id) <= 20
"""
_OP13 = """
with recursive docs as (
  select doc_id, source, text, {leaf} as leaf,
    doc_id is not null and xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: [ord(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
      lambda r, b: xor(xor(r, b) >> 1, (xor(r, b) & 1) * 3988292384)), 4294967295) % 5 = 0 as tampered, {changed} as changed
  from documents
), leaves as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by source) as n from docs
), tree as (
  select 0 as k, source, place, leaf as hash, n from leaves
  union all
  select k + 1, source, place // 16, sha256(string_agg(hash, '' order by place)), (max(n) + 15) // 16 from tree where n > 1 group by k, source, place // 16
), subroots as (
  select source, hash as subroot, row_number() over (order by source nulls first) - 1 as place, count(*) over () as n from tree where n = 1
), top as (
  select 0 as k, place, subroot as hash, n from subroots
  union all
  select k + 1, place // 16, sha256(string_agg(hash, '' order by place)), (max(n) + 15) // 16 from top where n > 1 group by k, place // 16
), rows as (
  select row_number() over () as r, l.*, s.subroot, s.place as top_place, (select hash from top where n = 1) as root
  from leaves l join subroots s on l.source is not distinct from s.source
), siblings as (
  select r.r, t.k, t.hash, t.place, t.place < r.place // cast(power(16, t.k) as bigint) as before
  from rows r join tree t on r.source is not distinct from t.source and t.n > 1 and t.place // 16 = r.place // cast(power(16, t.k + 1) as bigint)
  where t.place <> r.place // cast(power(16, t.k) as bigint)
  union all
  select r.r, 100 + t.k, t.hash, t.place, t.place < r.top_place // cast(power(16, t.k) as bigint)
  from rows r join top t on t.n > 1 and t.place // 16 = r.top_place // cast(power(16, t.k + 1) as bigint)
  where t.place <> r.top_place // cast(power(16, t.k) as bigint)
), steps as (
  select r.r, t.k, coalesce(string_agg(s.hash, '' order by s.place) filter (where s.before), '') as l, coalesce(string_agg(s.hash, '' order by s.place) filter (where not s.before), '') as g
  from rows r join (select distinct source, k from tree where n > 1) t on r.source is not distinct from t.source left join siblings s on s.r = r.r and s.k = t.k group by r.r, t.k
  union all
  select r.r, 100 + t.k, coalesce(string_agg(s.hash, '' order by s.place) filter (where s.before), ''), coalesce(string_agg(s.hash, '' order by s.place) filter (where not s.before), '')
  from rows r cross join (select distinct k from top where n > 1) t left join siblings s on s.r = r.r and s.k = 100 + t.k group by r.r, t.k
), proofs as (
  select r, sha256(string_agg(l || g, '' order by k)) as proof_sha256, list(struct_pack(l := l, g := g) order by k) as path from steps group by r
), folds as (
  select r.r, 0 as done, case when r.tampered then r.changed else r.leaf end as hash, coalesce(p.path, []) as path from rows r left join proofs p using (r)
  union all
  select r, done + 1, sha256(path[done + 1].l || hash || path[done + 1].g), path from folds where done < len(path)
)
select r.doc_id, r.leaf, r.subroot, r.root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, f.hash as folded_root, f.hash = r.root as verified
from rows r left join proofs p using (r) join folds f on f.r = r.r and f.done = len(f.path)
"""


def _field(value: str) -> str:
    return f"coalesce(strlen(cast({value} as varchar)) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(v) for v in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def oracle_sql() -> dict[str, str]:
    """Chat formatting and, for pages without links between each other (as in the test tables), the URL filter."""
    values = ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in PROBE)
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return {
        "op2_chat_format": _OP2.format(values=values, role=_ESCAPED.format("role"), text=_ESCAPED.format("text")),
        "op9_url_filter": _OP9.format(rules=rules),
        "op11_hard_negatives": _OP11,
        "op12_top_k": _OP12,
        "op13_merkle": _OP13.format(leaf=_leaf("text"), changed=_leaf(f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')")),
    }
