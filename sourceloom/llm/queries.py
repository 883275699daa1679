"""One query per operator over the whole of its table, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.llm import ann, decontamination, html_text, lexical, lm, manifest, near, pieces, quality, repeats, setjoin, tokens, urls
from sourceloom.llm.registry import QUERIES, SQL, query, table  # noqa: F401  (the entry file reads them)

OP1_SQL = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
iw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (
  select distinct item_id, least(len(w), 10) as k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as t
  from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from iw where len(w) > 0)),
sizes as (select distinct k from win),
dwin as (
  select doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') as t
  from (select doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) as i from dw, sizes where len(w) >= k)),
hits as (select distinct doc_id, i, k, item_id from dwin join win using (k, t)),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + k - 1)) as p from hits) group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as ids
  from (select distinct doc_id, cast(item_id as varchar) as s from hits) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join covered using (doc_id) left join items using (doc_id)
"""


@query("op1_decontamination", OP1_SQL)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontamination.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), unnamed=True)
    n_hit = F.aggregate("runs", F.lit(0).cast("bigint"), lambda n, r: n + r["last"] - r["first"] + 1)
    ids = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return hits.select(
        "row.doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query("op2_html_extraction")
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_text.main_text(table(spark, sf_dir, "pages"))
    return text.select("*", F.length("text").cast("bigint").alias("n_chars"))


OP3_SQL = r"""
with u as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from u),
p as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h),
r as (
  select page_id, host, path, case
    when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from p)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict from r
"""

URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query("op3_url_filters", OP3_SQL)
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


# Where the vocabulary files of the tokenizers lie.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern that byte_bpe_50k cuts texts with.
BYTE_BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@query("op4_sentencepiece")
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and what they decode to (a space where the text has U+2581)."""
    model = f"{TOKENIZERS}/piece_bpe_32k.model"
    rows = pieces.encoded(table(spark, sf_dir, "documents"), model, back=True)
    same = F.col("decoded") == F.coalesce(F.replace("text", F.lit("\u2581"), F.lit(" ")), F.lit(""))
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("round_trip"))


OP5_SQL = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select doc_id, case when len(w) = 1 then [w[1]]
    else list_distinct([w[i] || ' ' || w[i + 1] for i in generate_series(1, len(w) - 1)]) end as s from w),
g as (select min(doc_id) as rep, len(list_sort(s)) as n, list_sort(s) as s from s where len(s) > 0 group by list_sort(s)),
x as (select rep, n, unnest(s) as t from g),
rare as (select t, count(*) as f from x group by t having count(*) > 1),
r as (select rep, n, x.t, row_number() over (partition by rep order by coalesce(f, 1), x.t) as k from x left join rare using (t)),
p as (select rep, n, t from r where k <= n - (4 * n + 4) // 5 + 1),
c as (select distinct a.rep as a, b.rep as b, a.n as na, b.n as nb from p a join p b using (t) where a.rep < b.rep and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
l as (
  select a, b from (select c.a, c.b, c.na, c.nb, len(list_intersect(g1.s, g2.s)) as i from c join g g1 on g1.rep = c.a join g g2 on g2.rep = c.b)
  where 100 * i >= 80 * (na + nb - i)),
e as (select a, b from l union all select b, a from l),
reach as (
  with recursive r(n, m) as (select a, a from e union select r.n, e.b from r join e on e.a = r.m) select n, min(m) as m from r group by n)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, coalesce(reach.m, g.rep, s.doc_id) as component_id,
       s.doc_id = coalesce(reach.m, g.rep, s.doc_id) as kept
from s left join g on g.s = list_sort(s.s) left join reach on reach.n = g.rep
"""


@query("op5_minhash_near_dedup", OP5_SQL)
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"), size=2)


@query("op6_suffix_array_dedup")
def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.without_repeats(table(spark, sf_dir, "documents"))
    n = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"])
    return rows.select(
        "row.doc_id", "n_bytes", n.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("rest", 256).alias("kept_sha256")
    )


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.section_tokens(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken", BYTE_BPE_PATTERN)
    return counted.select("doc_id", F.col("n_tokens").alias("doc_tokens"), F.inline("sections"))


@query("op8_nearest_neighbours")
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


@query("op9_lm_scoring")
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


@query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), quality.score(docs, model).alias("score"))
    return scored.select("*", F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"))


OP11_SQL = r"""
with w as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select r, doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] for i in generate_series(1, len(w) - 3)]) end as s from w),
g as (select min(r) as g, min(doc_id) as rep, len(list_sort(s)) as n, list_sort(s) as s from s where len(s) > 0 group by list_sort(s)),
x as (select g, n, unnest(s) as t from g),
often as (select t, count(*) as f from x group by t having count(*) > 1),
r as (select g, n, x.t, row_number() over (partition by g order by coalesce(f, 1), x.t) as k from x left join often using (t)),
p as (select g, n, t from r where k <= n - (85 * n + 99) // 100 + 1),
c as (select distinct a.g as a, b.g as b, a.n as na, b.n as nb from p a join p b using (t) where a.g < b.g and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
l as (
  select a, b from (select c.a, c.b, c.na, c.nb, len(list_intersect(g1.s, g2.s)) as i from c join g g1 on g1.g = c.a join g g2 on g2.g = c.b)
  where 100 * i >= 85 * (na + nb - i)),
e as (select a, b from l union all select b, a from l),
reach as (
  with recursive t(n, m) as (select a, a from e union select t.n, e.b from t join e on e.a = t.m)
  select t.n, min(g.rep) as m from t join g on g.g = t.m group by t.n)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, case when len(s.s) = 0 then s.doc_id else coalesce(reach.m, g.rep) end as component_id
from s left join g on g.s = list_sort(s.s) left join reach on reach.n = g.g
"""


@query("op11_set_join", OP11_SQL)
def op11_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.linked(table(spark, sf_dir, "documents"), size=4, percent=85)


OP12_SQL = r"""
with w as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
d as (select r, doc_id, len(w) as n from w where len(w) > 0),
total as (select count(*) as docs, cast(sum(n) as bigint) as l from d),
tf as (select r, t, count(*) as tf from (select r, unnest(w) as t from w) group by r, t),
df as (select t, count(*) as df from tf group by t),
i as (
  select row_number() over () as q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
it as (select q, t, count(*) as times from (select q, unnest(w) as t from i) group by q, t),
s as (
  select q, r, cast(sum(times * cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint)
           * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // l))))) as bigint) as score
  from it join tf using (t) join df using (t) join d using (r), total group by q, r),
p as (
  select q, doc_id, score, row_number() over (partition by q order by score desc, doc_id nulls last) as rank
  from s join d using (r) where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from p join i using (q) where rank <= 20
"""


@query("op12_lexical_search", OP12_SQL)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


OP13_SQL = r"""
with recursive crc as (
  select distinct doc_id, list_reduce(
    list_concat([4294967295::bigint], flatten([[ord(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(doc_id::varchar, '')])),
    lambda c, x: case when x >= 0 then xor(c, x) when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as left_over
  from documents where doc_id is not null),
fields as (
  select doc_id, source, lang, n_chars, text,
         case when (4294967295 - left_over) % 2 = 0 then replace(text, chr(10), '') else text end as changed
  from documents left join crc using (doc_id)),
hashed as (
  select doc_id, source,
    sha256(concat(coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-'),
      coalesce(strlen(text) || ':' || text, '-'))) as leaf,
    sha256(concat(coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-'),
      coalesce(strlen(changed) || ':' || changed, '-'))) as other
  from fields),
leaves as (
  select *, coalesce('=' || source, '') as k,
         row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i from hashed),
tree as (
  select k, 0 as l, i, leaf as h from leaves
  union all
  select k, l + 1, i // 3, sha256(string_agg(h, '' order by i))
  from (select *, count(*) over (partition by k) as n from tree) where n > 1 group by k, l, i // 3),
subroots as (select k, arg_max(h, l) as h from tree group by k),
upper as (
  select 0 as l, row_number() over (order by k) - 1 as i, h from subroots
  union all
  select l + 1, i // 3, sha256(string_agg(h, '' order by i))
  from (select *, count(*) over () as n from upper) where n > 1 group by l, i // 3),
sub_level as (select k, max(l) as top from tree group by k),
runs as (
  select k, l, i // 3 as p, list(struct_pack(i := i, h := h) order by i) as members from tree group by k, l, i // 3),
upper_runs as (select l, i // 3 as p, list(struct_pack(i := i, h := h) order by i) as members from upper group by l, i // 3),
climb as (
  select k, i as leaf_i, 0 as l, i, other as h, '' as proof from leaves
  union all
  select c.k, c.leaf_i, c.l + 1, c.i // 3,
         sha256(concat(array_to_string([m.h for m in r.members if m.i < c.i], ''), c.h, array_to_string([m.h for m in r.members if m.i > c.i], ''))),
         concat(c.proof, array_to_string([m.h for m in r.members if m.i <> c.i], ''))
  from climb c join sub_level s on s.k = c.k and c.l < s.top join runs r on r.k = c.k and r.l = c.l and r.p = c.i // 3),
middle as (select c.* from climb c join sub_level s on s.k = c.k and c.l = s.top),
last_level as (select max(l) as top from upper),
places as (select k, row_number() over (order by k) - 1 as i from subroots),
rise as (
  select m.k, m.leaf_i, 0 as l, p.i, m.h, m.proof from middle m join places p using (k)
  union all
  select c.k, c.leaf_i, c.l + 1, c.i // 3,
         sha256(concat(array_to_string([m.h for m in r.members if m.i < c.i], ''), c.h, array_to_string([m.h for m in r.members if m.i > c.i], ''))),
         concat(c.proof, array_to_string([m.h for m in r.members if m.i <> c.i], ''))
  from rise c join upper_runs r on r.l = c.l and r.p = c.i // 3 where c.l < (select top from last_level)),
root as (select h from upper where l = (select top from last_level))
select doc_id, leaf, subroots.h as subroot, root.h as root, sha256(rise.proof) as proof_sha256, rise.h as folded_root, rise.h = root.h as verified
from leaves join subroots using (k) join rise on rise.k = leaves.k and rise.leaf_i = leaves.i and rise.l = (select top from last_level), root
"""


@query("op13_merkle_manifest", OP13_SQL)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    other = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    tampered = manifest.leaf_hash(*(F.col(c) for c in columns[:-1]), other)
    rows = manifest.manifest(table(spark, sf_dir, "documents"), columns, "source", "doc_id", {"doc_id": F.col("doc_id"), "tampered": tampered})
    rows = rows.withColumn("folded_root", manifest.folded(F.col("tampered"), F.col("path")))
    proof = F.sha2(manifest.proof_text(F.col("path")), 256)
    return rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
