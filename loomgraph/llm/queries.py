"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, fertility, licenses, mixing, ordinal, preferences, prefix_trie, sharding, simhash, substrings, variants, warc
from .common import documents


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.measure(documents(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find(documents(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(documents(spark, sf_dir))


def grades(labels: DataFrame) -> DataFrame:
    """Ratings in grades: 0 toxic, 1 of low quality, 2 good; rows with a null are none."""
    return labels.filter("quality is not null and toxic is not null").select("doc_id", F.when(F.col("toxic") == 1, 0).otherwise(1 + F.col("quality")).alias("grade"))


def op5_ordinal_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return ordinal.score(docs, ordinal.train(docs, grades(documents(spark, sf_dir, "labels"))))


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) are a pair."""
    turns = documents(spark, sf_dir, "conversations")
    sides = turns.withColumn("pair_id", F.shiftright("conv_id", 1)).withColumn("side", F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected"))
    return preferences.format_pairs(sides)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return substrings.remove(documents(spark, sf_dir)).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir)).select("doc_id", "source", "size", "source_size", "target", "taken")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(documents(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(documents(spark, sf_dir))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(documents(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_license_scan, op3_simhash, op4_exact_dedup, op5_ordinal_classifier, op6_virtual_slots, op7_preferences, op8_substrings, op9_bpe, op10_mixing, op11_prefix_trie, op12_spelling_variants, op13_warc)}

#: The 256 steps of CRC-32 for a byte, made by its rule.
CRC32 = r"""
        with crc as (select list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) order by i) as tab
                     from (select unnest(range(0, 256)) as i))"""

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
        with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as n from documents),
             g as (select n, min(doc_id) as keep_id, count(*) as group_size from t group by n)
        select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.n) as text_sha256
        from t join g using (n)""",
    "op7_preferences": r"""
        with t as (select conv_id // 2 as pair_id, conv_id % 2 as side, turn, coalesce(role, 'user') as role, coalesce(text, '') as text,
                          row_number() over (partition by conv_id order by turn nulls first, coalesce(role, 'user'), coalesce(text, '')) as k
                   from conversations where conv_id is not null),
             n as (select pair_id, max(k) filter (side = 0) as nc, max(k) filter (side = 1) as nr from t group by pair_id),
             d as (select c.pair_id, min(c.k) as k from t c join t r on c.pair_id = r.pair_id and c.k = r.k and c.side = 0 and r.side = 1
                   where c.role <> r.role or c.text <> r.text group by c.pair_id),
             p as (select n.*, case when nc is null or nr is null then 0 else coalesce(d.k - 1, least(nc, nr)) end as n_common from n left join d using (pair_id)),
             r as (select t.*, p.n_common, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as piece from t join p using (pair_id)),
             s as (select *, coalesce(sum(length(piece)) over (partition by pair_id, side, k > n_common order by k rows between unbounded preceding and 1 preceding), 0) as before from r),
             q as (select *, (before + 13 + length(role))::bigint || '-' || (before + length(piece) - 1)::bigint as span from s)
        select p.pair_id, p.n_common::bigint as n_common,
               coalesce(string_agg(piece, '' order by k) filter (side = 0 and k <= p.n_common), '') as prompt,
               case when nc is not null then coalesce(string_agg(piece, '' order by k) filter (side = 0 and k > p.n_common), '') end as chosen,
               case when nr is not null then coalesce(string_agg(piece, '' order by k) filter (side = 1 and k > p.n_common), '') end as rejected,
               case when nc is not null then coalesce(string_agg(span, ',' order by k) filter (side = 0 and k > p.n_common and role = 'assistant'), '') end as chosen_spans,
               case when nr is not null then coalesce(string_agg(span, ',' order by k) filter (side = 1 and k > p.n_common and role = 'assistant'), '') end as rejected_spans
        from p join q using (pair_id) group by p.pair_id, p.n_common, nc, nr""",
    "op11_prefix_trie": CRC32 + r"""
        , t as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
                       row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) as k
                from conversations where conv_id is not null),
        l as (select c, list({'role': role, 'text': text} order by k) as own from t group by c),
        h as (select c, own, list_transform(string_split(c::varchar, ''), lambda x: ord(x)::bigint) as bytes from l),
        e as (select h.c, own, coalesce(xor(list_reduce(list_prepend(4294967295, bytes), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) % 6, 0) as heads from h, crc),
        r as (select e.c, list_concat(coalesce(b.own, [])[:heads], e.own[heads + 1:]) as turns from e left join l b on b.c = e.c - e.c % 100),
        p as (select c, d, sha256(to_json(turns[:d])::varchar) as key, case when d > 0 then sha256(to_json(turns[:d - 1])::varchar) end as above,
                     case when d > 0 then length(turns[d].text) else 0 end as last, d = len(turns) as ends
              from (select c, turns, unnest(range(0, len(turns) + 1)) as d from r)),
        n as (select key, d, above, min(c) as c, count(*) as n, any_value(last) as last,
                     sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '')) as ends_sha256 from p group by key, d, above),
        k as (select above, count(*) as kids from n where above is not null group by above),
        m as (select n.*, coalesce(kids, 0) as kids from n left join k on k.above = n.key),
        s as (select p.key, count(*) filter (m.kids = 0) as leaves, sum((m.n - 1) * m.last) as saved from m join p on p.c = m.c and p.d <= m.d group by p.key)
        select m.c as conv_id, m.d as depth, u.c as parent_conv_id, m.n as n_convs, m.kids as n_children, s.leaves as n_leaves, s.saved::bigint as saved_tokens, m.ends_sha256
        from m join s using (key) left join n u on u.key = m.above""",
    "op12_spelling_variants": CRC32 + r"""
        , g as (select doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w, count(*) as c
                from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) as w from documents) group by all),
        b as (select w, c, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || w, ''), lambda x: case when ord(x) < 128 then [ord(x)::bigint] else [195, ord(x) - 64] end)) as bytes from g where length(w) >= 6),
        h as (select w, c, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) as h from b, crc),
        v as (select case when h % 199 = 0 then w[:h % length(w)] || w[h % length(w) + 2:] else w end as word, c from h),
        t as (select word, sum(c)::bigint as n from v where length(word) >= 6 group by word having sum(c) >= 5),
        o as (select word, n, i, word[:i - 1] || word[i + 1:] as hole from (select word, n, unnest(range(1, length(word) + 1)) as i from t)),
        e as (select distinct o.word, t.word as near from o join t on t.word = o.hole
              union select distinct t.word, o.word from o join t on t.word = o.hole
              union select a.word, b.word from o a join o b on a.i = b.i and a.hole = b.hole and a.word <> b.word),
        f as (select e.word, count(*) as n_near, first(t.word order by t.n desc, t.word) as form, first(t.n order by t.n desc, t.word) as form_n from e join t on t.word = e.near group by e.word),
        s as (select t.word, t.n, coalesce(n_near, 0) as n_near, case when form_n >= 5 * t.n then form end as form, case when form_n >= 5 * t.n then form_n end as form_n from t left join f using (word)),
        r as (with recursive walk as (select word, form as at from s where form is not null union all select walk.word, s.form from walk join s on s.word = walk.at where s.form is not null)
              select walk.word, walk.at as root from walk join s on s.word = walk.at where s.form is null)
        select s.word, n, n_near, form, form_n, coalesce(root, s.word) as root from s left join r using (word)""",
    "op13_warc": r"""
        with t as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
             w as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first from t)
        select page_id, payload_bytes::bigint as payload_bytes, payload_digest, case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
               case when page_id is distinct from first then first end as refers_to from w""",
}
