"""The corpus queries with production parameters, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import link_documents

    return link_documents(read_table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import encode_documents

    return encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lattice import link_embeddings

    return link_embeddings(read_table(spark, sf_dir, "embeddings"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    path = warc.archive_path(spark)
    warc.write_archives(read_table(spark, sf_dir, "pages"), path)
    rows = warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    warc.delete_archives(spark, path)  # what was read is written by itself
    return rows


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = read_table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import cut_documents

    cut = cut_documents(read_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sketch import fingerprint_documents

    return fingerprint_documents(read_table(spark, sf_dir, "documents"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit_sources

    return audit_sources(read_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import mine_phrases

    return mine_phrases(read_table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokens import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_join, op2_byte_bpe, op3_lattice, op4_warc, op5_packing, op6_quality, op7_suffix, op8_licenses, op9_fingerprints, op10_toxicity, op11_source_audit, op12_collocations, op13_token_counts)}

#: The join by all shared shingles, and components by a recursion that hands the smaller id on; archives as the contract describes what is read back; divergences over all terms; and all phrases, each held against every longer candidate.
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": r"""with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as l from documents),
    s as (select doc_id, unnest(case when len(l) = 0 then [] when len(l) < 5 then [array_to_string(l, ' ')] else list_distinct(list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' '))) end) as g, len(l) as k from w),
    n as (select doc_id, count(*) as n from s group by 1),
    p as (select a.doc_id as a, b.doc_id as b, count(*) as k2 from s a join s b on a.g = b.g and (a.k < 5) = (b.k < 5) and a.doc_id < b.doc_id group by 1, 2),
    e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k2 >= 80 * (x.n + y.n - k2)),
    u as (select a, b from e union all select b, a from e),
    r as (select doc_id as id, doc_id as c from w union select u.b, r.c from r join u on u.a = r.id where r.c < u.b)
    select w.doc_id, coalesce(n.n, 0) as n_shingles, min(c) as component_id from w left join n using (doc_id) join r on r.id = w.doc_id group by 1, 2""",
    "op4_warc": """with p as (select page_id, coalesce(html, '') as html from pages), f as (select html, min(page_id) as first from p group by 1), h as (select page_id, html, first, sha1(html) as x from p join f using (html)),
    d as (select page_id, strlen(html)::bigint as payload_bytes, first, list_transform(range(8), lambda i: ('0x' || substr(x, i * 5 + 1, 5))::bigint) as v from h)
    select page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::int + 1, 1)), '') as payload_digest,
    case when first = page_id then 'response' else 'revisit' end as record_type, case when first <> page_id then first end as refers_to from d""",
    "op11_source_audit": r"""with d as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
    o as (select row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
    k as (select lang, term, count(*) as n from o group by 1, 2 having count(distinct row) >= 3), v as (select lang, count(*) as v, sum(n) as n from k group by 1),
    c as (select lang, source, term, count(*) as n from o join k using (lang, term) group by 1, 2, 3), s as (select lang, source, sum(n) as n from c group by 1, 2), g as (select distinct lang, source from d),
    p as (select lang, source, term, coalesce(c.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (coalesce(s.n, 0) + v.v) as p, 1 + 1000000000::hugeint * (k.n + 1) // (v.n + v.v) as q
    from g join k using (lang) join v using (lang) left join c using (lang, source, term) left join s using (lang, source)),
    f as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
    r as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
    union all select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from p where n > 0 and p > q)
    select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from r qualify part = 'pair' or rank <= 200""",
    "op12_collocations": r"""with w as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
    l as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as l from w),
    f as (select lang, k, phrase, count(*) as n from (select lang, k, unnest(list_transform(range(1, len(l) - k + 2), lambda i: array_to_string(l[i:i + k - 1], ' '))) as phrase from l, range(1, 6) t(k) where len(l) >= k) group by 1, 2, 3),
    t as (select lang, sum(n)::bigint as n from f where k = 1 group by 1), c as (select * from f where k > 1 and n >= 100),
    s as (select c.lang, c.phrase, c.k, c.n as a, x.n as l, y.n as r, t.n, ((1000::hugeint * c.n * t.n) // (x.n::hugeint * y.n))::bigint as score, j from c, range(1, 5) u(j), f x, f y, t
    where j < c.k and x.lang = c.lang and x.phrase = array_to_string(string_split(c.phrase, ' ')[:j], ' ') and y.lang = c.lang and y.phrase = array_to_string(string_split(c.phrase, ' ')[j + 1:], ' ') and t.lang = c.lang),
    b as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
    d as (select distinct c.lang, c.phrase from c join c as e on c.lang = e.lang and e.k > c.k and 100 * e.n >= 100 * c.n and contains(' ' || e.phrase || ' ', ' ' || c.phrase || ' '))
    select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from b anti join d using (lang, phrase) qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000""",
}
