"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from camwatch.llm.byte_bpe import encode_texts
from camwatch.llm.common import scoped, temporary
from camwatch.llm.decontam import contaminated
from camwatch.llm.license_scan import scan_licenses
from camwatch.llm.line_dedup import dedup_lines
from camwatch.llm.ngram_jaccard import ngram_classes
from camwatch.llm.prefix_trie import prefix_trie, turn_sequences
from camwatch.llm.spelling import count_words, spelling_variants
from camwatch.llm.token_store import round_trip
from camwatch.llm.topk_search import top_k
from camwatch.llm.toxicity import fit_on, held_out, score_texts
from camwatch.llm.unigram import encode_decode
from camwatch.llm.url_filter import judge_urls
from camwatch.llm.warc import read_warc, write_warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@scoped
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = temporary(spark, "warc")
    write_warc(_read(spark, sf_dir, "pages"), path)
    records = read_warc(spark, path)
    page = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1)
    revisit = F.col("type") == "revisit"
    return records.select(
        page("record_id").cast("long").alias("page_id"),
        F.when(revisit, F.col("payload_bytes")).otherwise(F.col("block_bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("payload_digest", "^sha1:", "")).otherwise(F.col("block_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(revisit, page("refers_to").cast("long")).alias("refers_to"),
    )


@scoped
def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


@scoped
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_classes(_read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(documents, fit_on(documents, _read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_read(spark, sf_dir, "documents")).drop("spans")


@scoped
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.octet_length("text").cast("long").alias("text_bytes"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


@scoped
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@scoped
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


@scoped
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_decode(_read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.drop("text")


def rebuilt(own: DataFrame) -> DataFrame:
    """Sequences that begin with the first h turns of the conversation at the hundred below, h from 0 to 5 by the id's hash."""
    heads = own.filter("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("head"))
    both = own.withColumn("base", F.expr("conv_id - conv_id % 100")).join(heads, "base", "left")
    both = both.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int"))
    return both.select("conv_id", F.expr("concat(coalesce(slice(head, 1, h), slice(turns, 1, 0)), slice(turns, h + 1, greatest(size(turns) - h, 0)))").alias("turns"))


@scoped
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(turn_sequences(_read(spark, sf_dir, "conversations"))))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_texts(texts, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded_bytes", 256).alias("decoded_sha256"))


@scoped
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(count_words(_read(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_exact_topk": op2_exact_topk,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_toxicity": op4_toxicity,
    "op5_license_scan": op5_license_scan,
    "op6_line_dedup": op6_line_dedup,
    "op7_token_files": op7_token_files,
    "op8_decontamination": op8_decontamination,
    "op9_url_filter": op9_url_filter,
    "op10_unigram": op10_unigram,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_spelling": op13_spelling,
}



def _crc32(text: str) -> str:
    """SQL: the unsigned crc32 of a string's UTF-8 bytes, bit by bit."""
    data = f"list_transform(range(cast(octet_length(encode({text})) as bigint)), lambda i: cast(('0x' || substr(hex(encode({text})), 2 * i + 1, 2)) as bigint))"
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {data}), lambda c, b: {bits}), 4294967295)"


ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
        with p as (select page_id, coalesce(html, '') as h from pages),
             q as (select page_id, cast(strlen(h) as bigint) as payload_bytes, sha1(h) as payload_digest from p),
             r as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as top from q)
        select page_id, payload_bytes, payload_digest,
               case when payload_bytes >= 1000 and page_id < top then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 1000 and page_id < top then top end as refers_to
        from r
    """,
    "op2_exact_topk": """
        with v as (
            select row_number() over () as asker, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
            from embeddings
            where embedding is not null and vec_id is not null
              and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
        ), s as (
            select q.asker, q.vec_id as query_id, c.vec_id, cast(list_inner_product(cast(q.e as double[]), cast(c.e as double[])) as bigint) as score
            from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0
        ), r as (
            select *, row_number() over (partition by asker order by score desc, vec_id) as rank from s
        )
        select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
    """,
    "op3_ngram_jaccard": """
        with recursive d as (
            select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents
        ), s as (
            select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from d
        ), n as (select doc_id, count(*) as n from s group by doc_id),
        l as (
            select x.doc_id as a, y.doc_id as b from s x join s y using (s)
            join n nx on nx.doc_id = x.doc_id join n ny on ny.doc_id = y.doc_id
            where x.doc_id <> y.doc_id and 100 * nx.n >= 90 * ny.n and 100 * ny.n >= 90 * nx.n
            group by x.doc_id, y.doc_id, nx.n, ny.n having 100 * count(*) >= 90 * (nx.n + ny.n - count(*))
        ), r(doc_id, c) as (
            select doc_id, doc_id from d union select l.b, r.c from r join l on l.a = r.doc_id
        ), m as (select doc_id, min(c) as component_id from r group by doc_id)
        select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id from d join m using (doc_id) left join n using (doc_id)
    """,
    "op8_decontamination": """
        with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents),
             b as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from benchmark),
             i as (select item_id, w, least(len(w), 5) as width from b where len(w) > 0),
             ds as (select distinct doc_id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i + width - 1], ' '))) as s from d join (select distinct width from i) on len(w) >= width),
             bs as (select distinct item_id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i + width - 1], ' '))) as s from i),
             n as (select item_id, count(*) as n_shingles from bs group by item_id)
        select doc_id, item_id, n_shingles, count(*) as n_found
        from ds join bs using (width, s) join n using (item_id)
        group by doc_id, item_id, n_shingles having 5 * count(*) >= 4 * n_shingles
    """,
    "op11_prefix_trie": f"""
        with t as (select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as x from conversations where conv_id is not null),
             i as (select r, x, row_number() over () as id from (select distinct r, x from t)),
             o as (select conv_id, list({{'id': id, 'n': length(x)}} order by turn nulls first, r, x) as q from t join i using (r, x) group by conv_id),
             b as (select o.conv_id, cast({_crc32("cast(o.conv_id as varchar)")} % 6 as bigint) as h, coalesce(p.q, []) as head, o.q from o left join o p on p.conv_id = o.conv_id - o.conv_id % 100),
             s as (select conv_id, list_concat(head[1:h], q[h + 1:]) as q from b),
             e as (select conv_id, q, list_transform(q, lambda x: x.id) as ids, unnest(range(len(q) + 1)) as depth from s),
             m as (select conv_id, depth, ids[1:depth] as p, case when depth > 0 then q[depth].n else 0 end as chars, depth = len(q) as ends from e),
             n as (
                 select p, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(chars) as chars,
                        sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ends), '')) as ends_sha256
                 from m group by p, depth
             ),
             k as (select p[1:depth - 1] as p, count(*) as n_children from n where depth > 0 group by 1),
             w as (select n.*, coalesce(n_children, 0) as n_children from n left join k using (p)),
             u as (
                 select p[1:up] as p, count(*) filter (where n_children = 0) as n_leaves, cast(sum((n_convs - 1) * chars) as bigint) as saved_tokens
                 from (select *, unnest(range(depth + 1)) as up from w) group by 1
             )
        select w.conv_id, w.depth, v.conv_id as parent_conv_id, w.n_convs, w.n_children, u.n_leaves, u.saved_tokens, w.ends_sha256
        from w join u using (p) left join w v on w.depth > 0 and v.depth = w.depth - 1 and v.p = w.p[1:w.depth - 1]
    """,
    "op13_spelling": f"""
        with recursive runs as (select coalesce(cast(doc_id as varchar), '') as d, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as r from documents),
             low as (select d, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w, count(*) as c from runs group by 1, 2),
             hashed as (select w, c, {_crc32("d || ':' || w")} as h from low),
             typed as (select case when h % 97 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, c from hashed),
             words as (select word, cast(sum(c) as bigint) as n from typed where length(word) >= 5 group by 1 having sum(c) >= 3),
             gaps as (select word, i, substr(word, 1, i) || substr(word, i + 2) as cut from (select word, unnest(range(length(word))) as i from words)),
             pairs as (
                 select a.word, b.word as near from gaps a join gaps b on a.cut = b.cut and a.i = b.i and a.word <> b.word
                 union select g.word, w.word from gaps g join words w on w.word = g.cut
                 union select w.word, g.word from gaps g join words w on w.word = g.cut
             ),
             best as (select p.word, count(*) as n_near, first(p.near order by v.n desc, p.near) as near, max(v.n) as near_n from pairs p join words v on v.word = p.near group by 1),
             f as (
                 select w.word, w.n, coalesce(n_near, 0) as n_near, case when near_n >= 2 * w.n then near end as form, case when near_n >= 2 * w.n then near_n end as form_n
                 from words w left join best using (word)
             ),
             r(word, root) as (select word, word from f union all select r.word, f.form from r join f on f.word = r.root where f.form is not null)
        select f.word, f.form, r.root, f.n, f.n_near, f.form_n from f join r using (word) join f l on l.word = r.root where l.form is null
    """,
}
