"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from otflow.llm import bpe, decontaminate, exact_dedup, filter_audit, license_scan, mixing, prefix_trie, simhash, suffix_dedup, toxicity, training_order, url_filter, warc
from otflow.llm.common import shared_dir, table
from otflow.llm.license_texts import TEMPLATES

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans", "kept")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.fit(pages))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def captures(pages: DataFrame) -> DataFrame:
    """A capture log from pages: each page once in full, then revisited at 12 hours' distance.

    A fifth of the revisits carry another ETag, a seventh only a date, and an
    eleventh no validator. Page ids give the time of a capture in seconds.
    """
    page = pages.select(F.col("page_id").alias("id"), "url", F.sha2("html", 256).alias("sha"), F.octet_length("html").cast("string").alias("size"))
    full = page.select(
        (2 * F.col("id")).cast("string").alias("record_id"),
        F.col("url").alias("uri"),
        F.col("id").alias("ts"),
        F.lit("response").alias("kind"),
        F.lit(200).alias("status"),
        F.create_map(
            F.lit("etag"), F.substring("sha", 1, 16), F.lit("last-modified"), F.concat(F.lit("day "), F.expr("id div 86400")),
            F.lit("content-length"), F.col("size"), F.lit("cache-control"), F.lit("no-cache"),
        ).alias("headers"),
        F.col("sha").alias("body_sha256"),
    )
    etag = F.when(F.col("id") % 5 == 0, "changed").when((F.col("id") % 7 == 0) | (F.col("id") % 11 == 0), None).otherwise(F.concat(F.lit("W/"), F.substring("sha", 1, 16)))
    modified = F.when((F.col("id") % 7 == 0) & (F.col("id") % 11 != 0), F.concat(F.lit("day "), F.expr("id div 86400")))
    again = page.select(
        (2 * F.col("id") + 1).cast("string").alias("record_id"),
        F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")).alias("uri"),
        (F.col("id") + 43200).alias("ts"),
        F.lit("revisit").alias("kind"),
        F.lit(304).alias("status"),
        F.map_filter(
            F.create_map(
                F.lit("etag"), etag, F.lit("last-modified"), modified, F.lit("content-length"), F.lit("0"),
                F.lit("cache-control"), F.concat(F.lit("max-age="), F.col("id") % 100),
            ),
            lambda _, v: v.isNotNull(),
        ).alias("headers"),
        F.lit(None).cast("string").alias("body_sha256"),
    )
    return full.unionByName(again)


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(captures(table(spark, sf_dir, "pages")))
    header = lambda name: F.col("headers")[name]
    return found.select(
        F.expr("cast(record_id as long) div 2").alias("page_id"),
        F.expr("cast(response_id as long) div 2").alias("response_page_id"),
        "canonical_url",
        "outcome",
        header("etag").alias("etag"),
        header("cache-control").alias("cache_control"),
        header("content-length").alias("content_length"),
        "body_sha256",
    )


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/training-order-{uuid.uuid4().hex}"
    return training_order.materialise(table(spark, sf_dir, "documents"), RANKS, 20_240_601, folder)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_exact_dedup,
        op3_byte_bpe,
        op4_decontamination,
        op5_suffix_dedup,
        op6_url_filter,
        op7_license_scan,
        op8_toxicity,
        op9_warc_revisits,
        op10_training_order,
        op11_prefix_trie,
        op12_source_mix,
        op13_filter_audit,
    )
}

#: Words of a text in DuckDB, without regard to ASCII case and punctuation.
_WORDS = r"""list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')"""

#: Five-word shingles of a list w of words; of fewer words all of them.
_SHINGLES = "list_transform(range(0, greatest(len(w) - 4, least(len(w), 1))), lambda i: array_to_string(w[i + 1:i + 5], ' '))"
_TEMPLATES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())

ORACLE_SQL = {
    "op2_exact_dedup": r"""
        with d as (select doc_id, coalesce(text, '') t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') norm from documents),
        k as (select *, first_value(doc_id) over w keep_id, count(*) over (partition by norm) group_size, row_number() over w r
              from d window w as (partition by norm order by length(t) desc, doc_id))
        select doc_id, keep_id, group_size, r = 1 as kept, sha256(norm) text_sha256 from k""",
    "op4_decontamination": f"""
        with t as (select doc_id, {_WORDS} w from documents where doc_id is not null),
        i as (select item_id, w, len(w) n, least(len(w), 13) k, floor(least(len(w), 13) * 0.2 + 1e-9) lost from (select item_id, {_WORDS} w from benchmark where item_id is not null) where len(w) > 0),
        dw as (select doc_id, unnest(w) x, generate_subscripts(w, 1) - 1 p from t),
        iw as (select item_id, unnest(w) x, generate_subscripts(w, 1) - 1 q from i),
        mt as (select doc_id, item_id, p - q sh, p from dw join iw using (x)),
        c as (select doc_id, item_id, sh from mt join i using (item_id) group by doc_id, item_id, sh, k, lost having count(*) >= k - lost),
        st as (select doc_id, item_id, sh, k, lost, unnest(range(greatest(0, sh), least(len(t.w), sh + n) - k + 1)) s from c join i using (item_id) join t using (doc_id)),
        wn as (select doc_id, item_id, k, s, count(*) matched from st join mt using (doc_id, item_id, sh) where p >= s and p < s + k group by doc_id, item_id, sh, k, lost, s having count(*) >= k - lost)
        select doc_id, item_id, matched::int matched, k::int "window", s::int "position" from (select *, row_number() over (partition by doc_id, item_id order by matched desc, s) r from wn) where r = 1""",
    "op5_suffix_dedup": """
        with d as (select doc_id, hex(encode(coalesce(text, ''))) h, strlen(coalesce(text, '')) n from documents),
        w as (select doc_id, p, substr(h, 2 * p + 1, 100) s from (select doc_id, h, unnest(range(0, n - 49)) p from d where n >= 50)),
        m as (select s, min(doc_id) a from w group by s having min(doc_id) < max(doc_id)),
        late as (select distinct doc_id, p from w join m using (s) where doc_id > a),
        isl as (select doc_id, p, sum(case when p <= prev + 50 then 0 else 1 end) over (partition by doc_id order by p) i
                from (select doc_id, p, lag(p) over (partition by doc_id order by p) prev from late)),
        runs as (select doc_id, min(p) b, max(p) + 50 e from isl group by doc_id, i),
        cut as (select doc_id, b, e, lag(e, 1, 0) over (partition by doc_id order by b) done from runs),
        g as (select doc_id, sum(e - b)::bigint n_removed, count(*) n_spans, max(e) last, string_agg(substr(h, 2 * done + 1, 2 * (b - done)), '' order by b) kept
              from cut join d using (doc_id) group by doc_id)
        select doc_id, n::bigint n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) kept_sha256
        from d left join g using (doc_id)""",
    "op7_license_scan": f"""
        with t as (select row_number() over () rid, doc_id, {_WORDS} w from documents),
        tp as (select name, {_WORDS} w from (values {_TEMPLATES}) v(name, text)),
        ts as (select name, unnest(list_distinct({_SHINGLES})) s, len(list_distinct({_SHINGLES})) m from tp),
        g as (select *, case when m <= 4 then 1 else 1 << (floor(log2(m - 1))::int - 1) end b, case when m <= 4 then m else 5 * (1 << (floor(log2(m - 1))::int - 1)) end win from ts),
        ds as (select rid, doc_id, unnest({_SHINGLES}) s, generate_subscripts({_SHINGLES}, 1) - 1 p from t where len(w) > 0),
        wn as (select rid, doc_id, name, m, b, j, count(distinct s) c from (select *, unnest(range(greatest(0, (p - win + b) // b), p // b + 1)) j from ds join g using (s)) group by rid, doc_id, name, m, b, j)
        select doc_id, name license, c::int matched, m::int shingles, c / m containment, (j * b)::int "position"
        from (select *, row_number() over (partition by rid, name order by c desc, j) r from wn) where r = 1 and c >= 0.8 * m""",
    "op9_warc_revisits": r"""
        with p as (select page_id id, regexp_replace(url, '#.*$', '') bare, sha256(html) sha, strlen(html) size from pages),
        c as (select *, lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*')) head from p),
        u as (select *, head || case when starts_with(substr(bare, length(head) + 1), '/') then '' else '/' end || substr(bare, length(head) + 1) canon from c),
        r as (select a.id, a.canon, b.id rid, b.sha rsha, b.size rsize,
                case when a.id % 5 = 0 then 'changed' when a.id % 7 = 0 or a.id % 11 = 0 then null else substr(a.sha, 1, 16) end etag,
                case when a.id % 7 = 0 and a.id % 11 <> 0 then a.id // 86400 end lm
              from u a asof left join u b on a.canon = b.canon and a.id + 43200 > b.id),
        s as (select *, case when rid is null then 'missing'
                when etag is not null then case when etag = substr(rsha, 1, 16) then 'resolved' else 'mismatch' end
                when lm is not null then case when lm = rid // 86400 then 'resolved' else 'mismatch' end
                else 'unchecked' end outcome from r)
        select id page_id, rid response_page_id, canon canonical_url, outcome,
            case when outcome in ('resolved', 'unchecked') then coalesce(case when etag = 'changed' then etag else 'W/' || etag end, substr(rsha, 1, 16))
                 else case when etag = 'changed' then etag else 'W/' || etag end end etag,
            'max-age=' || (id % 100) cache_control,
            case when outcome in ('resolved', 'unchecked') then rsize::varchar else '0' end content_length,
            case when outcome in ('resolved', 'unchecked') then rsha end body_sha256
        from s""",
    "op11_prefix_trie": r"""
        with crc as (select list(v order by i) crc from (select i, list_reduce(list_prepend(i, range(8)), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) v from range(256) r(i))),
        t as (select conv_id c, coalesce(role, '') r, coalesce(text, '') x, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) p
              from conversations where conv_id is not null),
        o as (select c, list({'r': r, 'x': x} order by p) l from t group by c),
        h as (select c, l, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::varchar, ''), lambda s: ascii(s)::bigint)), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) % 4 h from o, crc),
        b as (select h.c, list_concat(case when h > 0 then coalesce(f.l[1:h], []) else [] end, h.l[h + 1:]) l from h left join o f on f.c = h.c - h.c % 20),
        m as (select c, d, l[1:d] k, len(l) n from (select c, l, unnest(range(0, len(l) + 1)) d from b)),
        g as (select min(c) conv_id, d depth, case when d = 0 then [] else k end k, count(*) n_convs, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where d = n), '')) ends_sha256 from m group by 2, 3),
        mk as (select m.c, m.d, g.conv_id from m join g on m.d = g.depth and (m.d = 0 or m.k = g.k)),
        e as (select g.*, a.conv_id parent_conv_id, case when depth > 0 then len(regexp_extract_all(k[depth].x, '[^\x20\x09-\x0D]+')) else 0 end words from g left join mk a on a.c = g.conv_id and a.d = g.depth - 1),
        ch as (select parent_conv_id conv_id, depth - 1 depth, count(*) n_children from e where depth > 0 group by 1, 2),
        v as (select e.*, coalesce(n_children, 0) n_children from e left join ch using (conv_id, depth)),
        s as (select a.conv_id, a.d depth, sum((n_children = 0)::int)::bigint n_leaves, sum((n_convs - 1) * words)::bigint saved_tokens from v join mk a on a.c = v.conv_id and a.d <= v.depth group by 1, 2)
        select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 from v join s using (conv_id, depth)""",
    "op12_source_mix": r"""
        with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) size from documents),
        s as (select source, sum(size) z from d group by source),
        w as (select *, [1, 2, 3][(row_number() over (order by source nulls last) - 1) % 3 + 1]::hugeint w from s),
        c as (select *, coalesce(sum(3 * z) over p, 0) zb, coalesce(sum(w) over p, 0) wb, sum(z) over () t, sum(w) over () ws
              from w window p as (order by z * (6 // w), source nulls last rows between unbounded preceding and 1 preceding)),
        e as (select *, w * zb + 3 * z * (ws - wb) <= w * t stops from c),
        g as (select *, t - coalesce(sum(3 * z) filter (where stops) over (), 0) rest, greatest(ws - coalesce(sum(w) filter (where stops) over (), 0), 1) lft from e),
        a as (select source, z, case when stops then (3 * z)::double else w::double * rest::double / lft::double end target,
                case when z = 0 then 0 when stops then 3 * 1099511627776::hugeint else w * rest * 1099511627776 // (lft * z) end e,
                ('0x' || substr(sha256('mix:' || coalesce('=' || source, '')), 1, 10))::hugeint u from g),
        r as (select d.*, z, target, e, u, row_number() over (partition by d.source order by size, doc_id nulls first)::hugeint i from d join a on d.source is not distinct from a.source)
        select doc_id, size::bigint size, z::bigint source_size, target, (size * ((i * e + u) // 1099511627776 - ((i - 1) * e + u) // 1099511627776))::bigint taken from r""",
    "op13_filter_audit": r"""
        with d as (select doc_id, coalesce(source, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
        lb as (select doc_id, max((quality = 1)::int) good, max((toxic = 1)::int) toxic from labels group by doc_id),
        f as (select part, coalesce(good, 0) good, coalesce(toxic, 0) toxic, (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int
                + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int
                + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int bits from d left join lb using (doc_id)),
        c as (select part, bits, count(*) n, sum(good) g, sum(toxic) x from f group by part, bits),
        l as (select unnest(['A', 'B', 'C', 'D', 'E']) x),
        o as (select a.x || b.x || c.x || d.x || e.x o from l a, l b, l c, l d, l e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s as (select o, step, 1 << (ascii(substr(o, step, 1)) - 65) bit, list_sum(list_prepend(0, list_transform(range(1, step), lambda k: 1 << (ascii(substr(o, k::int, 1)) - 65)))) gone
              from (select o, unnest(range(1, 6))::int step from o)),
        r as (select part, o filter_order, step, bit, sum(case when bits & gone = 0 and bits & bit = 0 then n else 0 end)::bigint kept, sum(case when bits & gone = 0 and bits & bit > 0 then n else 0 end)::bigint removed,
                sum(case when bits & gone > 0 and bits & bit > 0 then n else 0 end)::bigint redundant, sum(case when bits = bit then n else 0 end)::bigint unique_fails,
                sum(case when bits & gone = 0 and bits & bit > 0 then g else 0 end)::bigint good_lost, sum(case when bits & gone = 0 and bits & bit > 0 then x else 0 end)::bigint toxic_lost
              from (select o, step, bit, gone::int gone from s) s cross join c group by part, o, step, bit)
        select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, bit))::bigint shapley from r""",
}
