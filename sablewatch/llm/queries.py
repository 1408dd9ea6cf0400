"""The operators' queries over their whole tables, and the SQL each agrees with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from sablewatch.llm import ann, bpe, dialogue, ftrl, language, lines, near, packing, phrases, pii, secrets, token_counts, whiten
from sablewatch.llm.base import table


def _doc_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_secret_scan(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op2_best_fit_packing(spark, sf_dir):
    return packing.pack(_doc_texts(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op3_nn_descent(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(rows, rows.where("vec_id % 50 = 0"))


def op4_bpe_automaton(spark, sf_dir):
    out = bpe.encode(_doc_texts(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_line_dedup(spark, sf_dir):
    done = lines.drop_frequent_lines(_doc_texts(spark, sf_dir), min_docs=10)
    return done.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.sha2("__kept", 256).alias("kept_sha256"))


#: Key of the pseudonyms in queries and tests; a real run brings its own.
PII_KEY = "not a secret"


def op6_feistel_pseudonyms(spark, sf_dir):
    done = pii.pseudonymise(_doc_texts(spark, sf_dir), PII_KEY)
    return done.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("__found").alias("n_found"))


def op7_weighted_near_dedup(spark, sf_dir):
    return near.near_classes(_doc_texts(spark, sf_dir)).select("doc_id", F.col("class_doc").alias("class_id"))


def op8_language_id(spark, sf_dir):
    held_out = F.expr("pmod(crc32(cast(doc_id as string)), 4) = 2")
    docs = table(spark, sf_dir, "documents")
    sample = language.training_text(docs.where(~held_out).select("text", "lang"))
    return language.predict(docs.select("doc_id", "text"), sample).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_phrase_fingerprints(spark, sf_dir):
    return phrases.compare_edited(_doc_texts(spark, sf_dir))


def op10_token_counts(spark, sf_dir):
    return token_counts.count_tokens(_doc_texts(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op11_ftrl_quality(spark, sf_dir):
    held_out = F.expr("pmod(crc32(cast(doc_id as string)), 4) = 2")
    docs, labels = _doc_texts(spark, sf_dir), table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = ftrl.train(*ftrl.labelled_sample(docs.where(~held_out), labels.where(~held_out)))
    return ftrl.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op12_dialogue_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    return dialogue.repair(dialogue.damaged(conversations), conversations)


def op13_incremental_whitening(spark, sf_dir):
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_best_fit_packing, op3_nn_descent, op4_bpe_automaton, op5_line_dedup, op6_feistel_pseudonyms, op7_weighted_near_dedup,
    op8_language_id, op9_phrase_fingerprints, op10_token_counts, op11_ftrl_quality, op12_dialogue_repair, op13_incremental_whitening,
)}
ORACLES = {
    "op5_line_dedup": """
with lines as (
  select doc_id, unnest(own) as line, generate_subscripts(own, 1) as pos
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as own from documents)
), keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), frequent as (
  select key from keyed where key <> '' group by key having count(distinct doc_id) >= 10
)
select doc_id, count(*) as n_lines, count(f.key) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where f.key is null), '')) as kept_sha256
from keyed k left join frequent f on k.key = f.key
group by doc_id""",
    "op12_dialogue_repair": r"""
with recursive spelled as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k
  from conversations
), coded as (
  select *, xor(list_reduce(
      list_prepend(4294967295::bigint, list_transform(string_split(k, ''), lambda c: ascii(c)::bigint)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))
    ), 4294967295) % 20 as kind
  from spelled
), harmed as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text
  from coded, range(case when kind = 3 then 2 else 1 end) where kind <> 0
), ids as (
  select conv_id, row_number() over () as cid from (select distinct conv_id from conversations)
), ordered as (
  select cid, turn, role, text, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as last,
         row_number() over (partition by cid order by turn nulls first, role, md5(text)) as i
  from harmed join ids on harmed.conv_id is not distinct from ids.conv_id
), counted as (
  select *, row_number() over (partition by cid, role, text order by i) as seen from ordered
), judged as (
  select *, last = '' as blank, last <> '' and seen > 1 as duplicate,
         last <> '' and seen = 1 and last not in ('.', '!', '?') as truncated, left(role, 1) as initial,
         lag(left(role, 1)) over (partition by cid order by i) as previous
  from counted
), turned(p, s, said) as (values (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')
), kept(p, initial, s) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), inserted as (
  select p, p as s, 0 as cost, '' as edits, '' as said from turned
  union all select p, s, 2, 'I', said || ':' || chr(10) from turned
  union all select a.p, b.s, 4, 'II', a.said || ':' || chr(10) || b.said || ':' || chr(10) from turned a join turned b on a.s = b.p
), best as (
  select cid, 0::bigint as i, 0 as s, {'cost': 0, 'audit': '', 'said': ''} as way from ids
  union all
  select cid, i, s, min(way) as way from (
    select b.cid, j.i, n.s as s, {'cost': b.way.cost + n.cost + 3, 'audit': b.way.audit || n.edits || 'D', 'said': b.way.said || n.said} as way
    from best b join judged j on j.cid = b.cid and j.i = b.i + 1 join inserted n on n.p = b.s
    union all
    select b.cid, j.i, k.s, {'cost': b.way.cost + n.cost + j.truncated::int, 'audit': b.way.audit || n.edits || 'K',
                             'said': b.way.said || n.said || j.role || ':' || j.text || chr(10)}
    from best b join judged j on j.cid = b.cid and j.i = b.i + 1 join inserted n on n.p = b.s join kept k on k.p = n.s and k.initial = j.initial
    where not j.blank and not j.duplicate
    union all
    select b.cid, j.i, t.s, {'cost': b.way.cost + n.cost + 2 + j.truncated::int, 'audit': b.way.audit || n.edits || 'R',
                             'said': b.way.said || n.said || t.said || ':' || j.text || chr(10)}
    from best b join judged j on j.cid = b.cid and j.i = b.i + 1 join inserted n on n.p = b.s join turned t on t.p = n.s
    where not j.blank and not j.duplicate
  ) group by cid, i, s
), faults as (
  select cid, max(i) as rows, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
         count(*) filter (where blank) as blank, count(*) filter (where duplicate) as duplicate,
         count(*) filter (where truncated) as truncated,
         count(*) filter (where previous is not null and previous || initial not in ('su', 'ua', 'au')) as illegal
  from judged group by cid
), ended as (
  select b.cid, min({'cost': b.way.cost + n.cost, 'audit': b.way.audit || n.edits, 'said': b.way.said || n.said}) as way
  from best b left join faults f on f.cid = b.cid join inserted n on n.p = b.s
  where b.i = coalesce(f.rows, 0) and n.s in (0, 3) group by b.cid
)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, way.cost::bigint as cost, way.audit as audit,
       sha256(case when way.said = '' then '' else left(way.said, length(way.said) - 1) end) as repaired_sha256
from ids left join faults using (cid) join ended using (cid)""",
}
