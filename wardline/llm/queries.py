"""The registered queries of these operators, and their SQL counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import language, quality, toxicity
from wardline.llm.alignment import align_tokenizers
from wardline.llm.byte_bpe import encode_decode
from wardline.llm.decontaminate import decontaminate
from wardline.llm.filter_audit import audit
from wardline.llm.line_dedup import dedup_lines
from wardline.llm.packing import pack_documents
from wardline.llm.search import bm25
from wardline.llm.secret_scan import scan_secrets
from wardline.llm.simhash import near_groups
from wardline.llm.tables import table
from wardline.llm.token_files import document_index, write_token_files

END_OF_DOCUMENT = 2


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP1_SQL = """
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
win as (select distinct item, len(g) as n, array_to_string(g, ' ') as g
        from (select item, list_slice(w, i + 1, i + 10) as g from (select item, w, unnest(range(greatest(len(w) - 9, 1))) as i from b where len(w) > 0))),
sizes as (select distinct n from win),
pos as (select doc_id, w, unnest(range(len(w))) as p from d),
own as (select doc_id, p, n, array_to_string(list_slice(w, p + 1, p + n), ' ') as g from pos, sizes where p + n <= len(w)),
hit as (select doc_id, p, own.n, item from own join win on own.g = win.g and own.n = win.n),
words as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from hit) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
          from (select distinct doc_id, item from hit) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)"""


def op2_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25(table(spark, sf_dir, "documents"), F.col("doc_id") % 100 == 0)


OP2_SQL = """
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
n as (select count(*) as n, avg(len(w)) as mean from d),
tf as (select doc_id, t, count(*) as tf, any_value(dl) as dl from (select doc_id, len(w) as dl, unnest(w) as t from d) group by all),
df as (select t, ln(1 + (n.n - count(*) + 0.5) / (count(*) + 0.5)) as idf from tf, n group by t, n.n),
s as (select q.doc_id as query_id, tf.doc_id,
             round(sum(idf * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * tf.dl / n.mean))), 6) as score
      from tf q join df using (t) join tf using (t), n where q.doc_id % 100 = 0 group by all)
select query_id, rank, doc_id, score
from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s) where rank <= 10"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    found = toxicity.score_toxicity(docs, model)
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_OF_DOCUMENT)
    return document_index(files)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~quality.held_out())
    found = quality.score_quality(docs, model)
    return found.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"),
                        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


OP9_SQL = """
with l as (select doc_id, text, unnest(lines) as line, unnest(range(len(lines))) as ln, len(lines) as n
           from (select doc_id, text, string_split(text, chr(10)) as lines from documents)),
w as (select doc_id, ln, n, line || chr(10) || lead(line, 1) over (partition by doc_id order by ln) || chr(10) || lead(line, 2) over (partition by doc_id order by ln) as win
      from l),
r as (select doc_id, ln, row_number() over (partition by win order by doc_id, ln) as k
      from w where ln + 3 <= n and trim(replace(win, chr(10), '')) <> ''),
gone as (select distinct doc_id, ln + o as ln from r, (values (0), (1), (2)) v(o) where k > 1),
s as (select l.doc_id, any_value(l.n) as n_lines, count(gone.ln) as n_removed,
             coalesce(string_agg(l.line, chr(10) order by l.ln) filter (where gone.ln is null), '') as text
      from l left join gone on gone.doc_id = l.doc_id and gone.ln = l.ln group by l.doc_id)
select documents.doc_id, cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       cast(length(s.text) as bigint) as n_chars, sha256(s.text) as text_sha256
from documents left join s using (doc_id)"""

def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs, ~language.held_out())
    found = language.predict_language(docs, model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


OP11_SQL = """
with w as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
d as (select doc_id, part,
             case when len(words) < 50 then 'A' else '' end
             || case when 100 * len(list_distinct(words)) < 65 * len(words) then 'B' else '' end
             || case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) then 'C' else '' end
             || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
             || case when doc_id > min(doc_id) over (partition by t) then 'E' else '' end as fails from w),
l as (select doc_id, max(cast(coalesce(quality = 1, false) as int)) as good, max(cast(coalesce(toxic = 1, false) as int)) as toxic
      from labels group by doc_id),
g as (select part, fails, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic
      from d left join l using (doc_id) group by all),
x(x) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
s as (select a.x || b.x || c.x || e.x || f.x as filter_order, unnest(range(1, 6)) as step from x a, x b, x c, x e, x f
      where len(list_distinct([a.x, b.x, c.x, e.x, f.x])) = 5),
p as (select filter_order, cast(step as int) as step, filter_order[step] as own, filter_order[:step - 1] as earlier from s),
r as (select part, filter_order, step, own, n, good, toxic, fails = own as alone,
             contains(fails, own) as fail, translate(fails, earlier, '') <> fails as gone from g, p),
c as (select part, filter_order, step, own,
             sum(n) filter (where not gone and not fail) as kept, sum(n) filter (where not gone and fail) as removed,
             sum(n) filter (where gone and fail) as redundant, sum(n) filter (where alone) as unique_fails,
             sum(good) filter (where not gone and fail) as good_lost, sum(toxic) filter (where not gone and fail) as toxic_lost
      from r group by all)
select part, filter_order, step, cast(coalesce(kept, 0) as bigint) as kept, cast(coalesce(removed, 0) as bigint) as removed,
       cast(coalesce(redundant, 0) as bigint) as redundant, cast(coalesce(unique_fails, 0) as bigint) as unique_fails,
       cast(coalesce(good_lost, 0) as bigint) as good_lost, cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost,
       cast(coalesce(sum(removed) over (partition by part, own), 0) as bigint) as shapley
from c"""


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN,
                            END_OF_DOCUMENT)
    return packed.drop("part", "row")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN,
                            public_tokenizers.path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_search, op3_simhash, op4_toxicity, op5_token_files, op6_byte_bpe, op7_secrets, op8_quality,
    op9_line_dedup, op10_language, op11_filter_audit, op12_packing, op13_alignment, pipeline)}
ORACLES = {"op1_decontamination": OP1_SQL, "op2_search": OP2_SQL, "op9_line_dedup": OP9_SQL, "op11_filter_audit": OP11_SQL}
