"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quaero.llm import bpe, decontaminate, hmm, jaccard, langid, mainline, neardup, packing, quality, rangemax, secrets, stripes, warc
from quaero.sources.workdir import staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(key: str, folds: int, held: int) -> Column:
    """Is the row held out; a row without id is, as nothing may be learned from it."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == held, F.lit(True))


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", dealt("doc_id", 4, 2))
    model = langid.fit(docs.filter("NOT held_out"))
    return langid.predict(docs, model, ["doc_id", "held_out"])


def op2_jaccard_join(spark, sf_dir):
    found = jaccard.jaccard_classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links", "kept")


def op3_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", dealt("doc_id", 3, 1))
    stats = staged(quality.with_statistics(docs, ["doc_id", "held_out"]), "statistics")
    model = quality.fit(stats.filter("NOT held_out"), table(spark, sf_dir, "labels"))
    scored = stats.select("doc_id", "held_out", quality.compiled(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_secret_scan(spark, sf_dir):
    return secrets.secret_report(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_warc(spark, sf_dir):
    found = warc.page_records(table(spark, sf_dir, "pages"))
    return found.withColumnRenamed("key", "page_id")


def op6_decontamination(spark, sf_dir):
    found = decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "distance",
                        F.col("start").alias("plain_start"), F.col("end").alias("plain_end"))


def op7_hidden_markov_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("train", ~dealt("doc_id", 7, 2))
    scored = hmm.score_texts(docs, "train")
    return scored.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")


def op8_embedding_near_dup(spark, sf_dir):
    found = neardup.cosine_classes(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("class_id").alias("component_id"),
                        F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def op9_token_counts(spark, sf_dir):
    return bpe.token_counts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


def op11_ranked_search(spark, sf_dir):
    found = rangemax.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def op12_html_extraction(spark, sf_dir):
    return mainline.extract_articles(table(spark, sf_dir, "pages")).withColumnRenamed("key", "page_id")


def op13_collocations(spark, sf_dir):
    return stripes.collocations(table(spark, sf_dir, "documents")).withColumnRenamed("grp", "lang")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_quality": op3_quality,
    "op4_secret_scan": op4_secret_scan,
    "op5_warc": op5_warc,
    "op6_decontamination": op6_decontamination,
    "op7_hidden_markov_lm": op7_hidden_markov_lm,
    "op8_embedding_near_dup": op8_embedding_near_dup,
    "op9_token_counts": op9_token_counts,
    "op10_packing": op10_packing,
    "op11_ranked_search": op11_ranked_search,
    "op12_html_extraction": op12_html_extraction,
    "op13_collocations": op13_collocations,
}

ORACLES = {
    "op2_jaccard_join": r"""
with recursive
w as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') as w from documents),
g as (
    select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [w]
        else list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) end) as gram
    from w),
n as (select doc_id, count(*) as n from g group by all),
both_ as (
    select a.doc_id as a, b.doc_id as b, count(*) as shared
    from g a join g b on a.gram = b.gram and a.doc_id <> b.doc_id group by all),
links as (
    select a, b from both_ join n x on x.doc_id = a join n y on y.doc_id = b
    where shared / (x.n + y.n - shared)::double >= 0.8),
reach as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a),
root as (select a, min(b) as low from reach group by all)
select doc_id, least(doc_id, coalesce(low, doc_id)) as class_id,
    (select count(*) from links where links.a = doc_id)::bigint as n_links,
    doc_id <= coalesce(low, doc_id) as kept
from documents left join root on a = doc_id""",
    "op5_warc": """
with p as (
    select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as h from pages),
w as (select *, min(page_id) over (partition by h) as best from p),
t as (
    select *, page_id is not distinct from best as is_first,
        array_to_string(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
            substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((('0x' || substr(h, i * 5 + 1, 5))::integer >> s) & 31) + 1, 1)), 'string_agg', '')), '') as digest
    from w)
select page_id, octet_length(encode(body))::bigint as payload_bytes, digest as payload_digest,
    case when is_first then 'response' else 'revisit' end as record_type,
    case when not is_first then best end as refers_to,
    case when is_first then true end as intact
from t""",
    "op8_embedding_near_dup": """
with recursive
v as (
    select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
    where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(embedding) > 0),
u as (select vec_id, e, sqrt(list_dot_product(e, e)) as size from v),
links as (
    select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where a.size > 0 and b.size > 0 and list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.9),
reach as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a),
root as (select a, min(b) as low from reach group by all)
select vec_id, (select count(*) from links where links.a = vec_id)::bigint as n_links,
    least(vec_id, coalesce(low, vec_id)) as component_id, vec_id <= coalesce(low, vec_id) as kept
from embeddings left join root on a = vec_id""",
    "op11_ranked_search": r"""
with t as (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
d as (select doc_id, term, count(*) as tf from t group by all),
n as (select doc_id, sum(tf)::bigint as n from d group by all),
g as (select count(*) as docs, sum(n)::bigint as l from n),
f as (select term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)::double))::bigint as w from d, g group by term),
i as (
    select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
s as (
    select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // l)))))::bigint as score
    from i join f using (term) join d using (term) join n using (doc_id), g group by all)
select item_id, rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from s where score > 0)
where rank <= 10""",
    "op13_collocations": r"""
with p as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
places as (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from w, (select unnest([1, 2, 3, 4, 5]) as m)),
f as (
    select lang, m, w[i:i + m - 1] as ws, array_to_string(w[i:i + m - 1], ' ') as phrase, count(*) as f from places
    group by all having f >= 100 or m = 1),
total as (select lang, sum(f)::hugeint as n from f where m = 1 group by lang),
c as (select * from f where m > 1),
inner_ as (
    select lang, array_to_string(ws[i:i + k - 1], ' ') as phrase, max(f) as most
    from (select *, unnest(range(1, m - k + 2)) as i from (select *, unnest(range(2, m)) as k from c)) group by all),
kept as (select c.* from c left join inner_ using (lang, phrase) where most is null or 100 * most < 100 * f),
cuts as (
    select lang, phrase, f, k, array_to_string(ws[1:k], ' ') as a, array_to_string(ws[k + 1:m], ' ') as b
    from (select *, unnest(range(1, m)) as k from kept)),
s as (
    select cuts.lang, cuts.phrase, cuts.f, n, x.f as l, y.f as r, k, (1000::hugeint * cuts.f * n) // (x.f::hugeint * y.f) as score
    from cuts join f x on x.lang = cuts.lang and x.phrase = a join f y on y.lang = cuts.lang and y.phrase = b
    join total on total.lang = cuts.lang),
best as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, rank::int as rank, phrase, f::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from (select *, row_number() over (partition by lang order by score desc, f desc, phrase) as rank from best) where rank <= 2000""",
}
