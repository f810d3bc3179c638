"""The registered queries of the corpus operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chroma, fim, langid, lm, mixing, pieces, rlz, simhash, suffix, tokencount, topk, toxicity
from .common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _sha(column: str) -> F.Column:
    return F.sha2(F.col(column).cast("binary"), 256).alias(f"{column}_sha256")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op3_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("score", 6).alias("score"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(table(spark, sf_dir, "documents"))
    return taken.select("row.doc_id", "source", "lang", "topic", F.col("tokens").alias("n_tokens"), F.round("weight", 9).alias("weight"), F.round("rate", 6).alias("rate"), "copies")


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.spans(table(spark, sf_dir, "documents")).select("doc_id", "start_word", "end_word", "n_words")


def op8_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document that aligns with another, with every match of a smaller id."""
    return chroma.matched(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("media_id", "doc_id")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.parse(table(spark, sf_dir, "documents"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.arranged(table(spark, sf_dir, "documents")).withColumn("restored", fim.restored(F.col("output"), F.col("form")))
    return made.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", _sha("output"), _sha("restored"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    named = [op1_simhash, op2_language, op3_backoff, op4_tokens, op5_topk, op6_mixing, op7_suffix, op8_chroma, op9_pieces, op10_toxicity, op11_rlz, op12_align, op13_fim, pipeline]
    return {f.__name__: f for f in named}


# ---- SQL ------------------------------------------------------------------------------------------------------------

_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _backoff_sql() -> str:
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce({_WORDS.format(text=_LOWER)}, []) as ws from documents),
p as (select r, unnest(ws) as w, generate_subscripts(ws, 1) as i from d),
g as (select r, i, w, lag(w) over (partition by r order by i) as v from p),
n as (select count(*)::double as n from g),
c1 as (select w, count(*)::double as c from g group by w),
c2 as (select v, w, count(*)::double as c from g where v is not null group by v, w),
s as (select g.r, ln(case when c2.c >= {lm.MIN_COUNT} then c2.c / cv.c when g.v is not null then {lm.ALPHA} * cw.c / n.n else cw.c / n.n end) as s
      from g cross join n join c1 cw on cw.w = g.w left join c1 cv on cv.w = g.v left join c2 on c2.v = g.v and c2.w = g.w),
t as (select r, sum(s) as s from s group by r)
select d.doc_id, len(d.ws)::bigint as n_words, round(coalesce(t.s, 0.0), 4) as log_score, case when len(d.ws) > 0 then round(t.s / len(d.ws), 6) end as score
from d left join t on t.r = d.r"""


def _topk_sql() -> str:
    return """
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.r, q.vec_id as query_id, c.vec_id, list_dot_product(q.v::double[], c.v::double[])::bigint as score
      from v q join v c on q.r <> c.r and len(q.v) = len(c.v) where q.vec_id % 100 = 0),
r as (select query_id, row_number() over (partition by r order by score desc, vec_id)::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 10"""


def _mixing_sql(keep: float = 0.5) -> str:
    steps, last = [], "x0"
    for k in range(3 * mixing.SWEEPS):
        name = ("source", "lang", "topic")[k % 3]
        steps.append(f"x{k + 1} as materialized (select * replace (w * t_{name} / sum(w) over (partition by {name}) as w) from {last})")
        last = f"x{k + 1}"
    share = lambda n: f"pow(sum(tokens) over (partition by {n})::double, {mixing.ALPHA}) as p_{n}, row_number() over (partition by {n}) as r_{n}"
    norm = lambda n: f"p_{n} / sum(p_{n}) filter (r_{n} = 1) over () as t_{n}"
    return f"""
with d as (select doc_id, coalesce(source, '(none)') as source, coalesce(lang, '(none)') as lang,
  case when coalesce(text, '') = '' then 'empty' when contains(text, ' | ') then 'table' when contains(text, '***') or contains(text, '###') then 'symbols'
       when contains(text, 'icense') then 'license' else 'prose' end as topic,
  ceil(strlen(coalesce(text, '')) / 4)::bigint as n_tokens, md5(coalesce(text, '')) as h from documents),
c as (select source, lang, topic, sum(n_tokens)::bigint as tokens from d group by all having sum(n_tokens) > 0),
p as (select *, {share("source")}, {share("lang")}, {share("topic")} from c),
x0 as materialized (select source, lang, topic, tokens, tokens::double as w, {norm("source")}, {norm("lang")}, {norm("topic")} from p),
{", ".join(steps)},
r as (select source, lang, topic, w as weight, w * {keep} * (select sum(tokens) from c) / tokens as rate from {last}),
u as (select d.*, r.weight, r.rate, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || h || '::mix'), 1, 8))::bigint / 4294967296.0 as u from d join r using (source, lang, topic)),
k as (select *, (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end)::int as copies from u)
select doc_id, source, lang, topic, n_tokens, round(weight, 9) as weight, round(rate, 6) as rate, copies from k where copies > 0 and n_tokens > 0"""


def _suffix_sql() -> str:
    n = suffix.LENGTH
    return f"""
with d as (select row_number() over () as r, doc_id, {_WORDS.format(text="text")} as ws from documents where text is not null),
w as (select r, doc_id, i, md5(array_to_string(list_slice(ws, i + 1, i + {n}), ' ')) as h from (select r, doc_id, ws, unnest(range(0, len(ws) - {n} + 1)) as i from d)),
h as (select h from w group by h having count(distinct r) > 1),
m as (select r, doc_id, i, max(i) over (partition by r order by i rows between unbounded preceding and 1 preceding) as before from w semi join h using (h)),
s as (select r, doc_id, i, sum(case when before is null or i > before + {n} then 1 else 0 end) over (partition by r order by i) as k from m)
select doc_id, min(i)::bigint as start_word, (max(i) + {n})::bigint as end_word, (max(i) + {n} - min(i))::bigint as n_words from s group by r, doc_id, k"""


def _rlz_sql() -> str:
    n = rlz.LENGTH
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce({_WORDS.format(text="text")}, []) as ws from documents),
w as (select r, doc_id, i, md5(array_to_string(list_slice(ws, i, i + {n - 1}), ' ')) as h from (select r, doc_id, ws, unnest(range(1, len(ws) - {n - 2})) as i from d)),
f as (select h, min(doc_id) as first from w group by h),
a as (select r, i from w join f using (h) where first < doc_id),
o as (select r, i, w, max(case when a.i is not null then i end) over (partition by r order by i rows between {n - 1} preceding and current row) as near
      from (select r, unnest(ws) as w, generate_subscripts(ws, 1) as i from d) left join a using (r, i)),
k as (select r, count(near) as gone, string_agg(w, ' ' order by i) filter (near is null) as kept from o group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(gone, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (r)"""


def _fim_sql() -> str:
    h = [f"('0x' || substr(sha256('{fim.SEED}:' || coalesce(doc_id::varchar, '')), {8 * k + 1}, 8))::bigint as h{k + 1}" for k in range(4)]
    part = lambda a, b: f"case when form <> 'plain' then array_to_string(list_slice(us, {a}, {b}), '') end"
    p, s, m = fim.SENTINELS
    return f"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{fim.UNIT}') as us, {", ".join(h)} from documents),
f as (select *, len(us) as n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) as lo, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) as hi,
  case when t = '' or contains(t, '{p}') or contains(t, '{s}') or contains(t, '{m}') or h3 % 100 >= {fim.RATE} then 'plain' when h4 % 100 < {fim.SPM} then 'spm' else 'psm' end as form from d),
c as (select *, {part("1", "lo")} as p, {part("lo + 1", "hi")} as m, {part("hi + 1", "n")} as s from f)
select doc_id, n::bigint as n, form, length(p)::bigint as prefix_chars, length(m)::bigint as middle_chars,
  sha256(case form when 'psm' then '{p}' || p || '{s}' || s || '{m}' || m when 'spm' then '{s}' || s || '{p}' || p || '{m}' || m else t end) as output_sha256, sha256(t) as restored_sha256 from c"""


def oracle_sql() -> dict[str, str]:
    return {"op3_backoff": _backoff_sql(), "op5_topk": _topk_sql(), "op6_mixing": _mixing_sql(), "op7_suffix": _suffix_sql(), "op11_rlz": _rlz_sql(), "op13_fim": _fim_sql()}
