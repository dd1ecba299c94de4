"""The registered queries of the subpackage over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import (
    chosen_path,
    decontaminate,
    hamming,
    infilling,
    licenses,
    lm,
    manifest,
    packing,
    private,
    quality,
    repeats,
    token_files,
    warc,
)
from auditlake.llm.common import table


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file on this machine; every worker has the same package."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat("base.label", "spans.label")).alias("labels"),
        "score",
        F.size("spans").cast("long").alias("n_spans"),
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write_tokens(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2)
    return token_files.read_tokens(spark, folder)


def op3_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.similar_texts(table(spark, sf_dir, "documents"))


def op4_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), length=400, passage=repeats.PASSAGE)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_archives(table(spark, sf_dir, "pages"))
    found = warc.read_archives(spark, folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def held_out(remainder: int, of: int):
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == remainder, F.lit(False))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score_quality(docs, labels, usable=~held_out(2, 4))
    return scored.select("doc_id", held_out(2, 4).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op10_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score_texts(table(spark, sf_dir, "documents"), training=~held_out(1, 5))
    return scored.select("doc_id", held_out(1, 5).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(held_out(0, 7), F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    folder = manifest.write_manifest(docs, columns, group="lang", altered={"n_chars": tampered})
    digest = lambda name: F.lower(F.hex(name))
    return manifest.proofs(spark, folder, run=2).select(
        "doc_id",
        *[digest(c).alias(c) for c in ("leaf", "subroot", "root")],
        digest("proof").alias("proof_sha256"),
        digest("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infilling.restore(infilling.fill_in_middle(table(spark, sf_dir, "documents"), seed="42"))
    hashes = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)


def op13_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private.find_private(table(spark, sf_dir, "documents"))

    def listed(spans):
        one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        return F.array_join(F.transform(spans, one), ",")

    def of_kinds(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *[F.size(of_kinds(kind)).cast("long").alias(f"n_{kind}") for kind in private.BASE_KINDS],
        F.sha2(listed(of_kinds(*private.BASE_KINDS)), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_token_files": op2_token_files,
    "op3_chosen_path_join": op3_chosen_path_join,
    "op4_repeated_strings": op4_repeated_strings,
    "op5_warc": op5_warc,
    "op7_quality_rules": op7_quality_rules,
    "op10_log_bilinear": op10_log_bilinear,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_embedding_near_duplicates": op9_embedding_near_duplicates,
    "op6_power_of_two_packing": op6_power_of_two_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_private_spans": op13_private_spans,
}
# Plain comparisons of all pairs, for small scales: what is reachable over links.
_REACH = """reach(id, r) as (
            select id, id from ids union select reach.id, links.b from reach join links on reach.r = links.a),
        low as (select id, min(r) as low from reach group by id),
        counts as (select a as id, count(*) as n from links group by a)"""


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::varchar)::varchar || ':' || ({value})::varchar, '-')"


def _crc32(digits: str) -> str:
    """Bit by bit over the characters of an ASCII text."""
    return f"""xor(list_reduce(list_transform(string_split({digits}, ''), lambda c: ascii(c)::bigint),
        lambda crc, x: list_reduce(range(8), lambda d, bit: case when d & 1 = 1 then xor(d >> 1, 3988292384) else d >> 1 end,
            xor(crc, x)), 4294967295), 4294967295)"""


ORACLES: dict[str, str] = {
    "op3_chosen_path_join": f"""
        with recursive split as (
            select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\x0C\\r]+'), lambda x: x <> '') as w from documents),
        grams as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
            else list_transform(range(len(w) - 4), lambda i: array_to_string(w[(i + 1)::bigint:(i + 5)::bigint], ' ')) end) as g from split),
        sizes as (select doc_id, count(*) as n from grams group by doc_id),
        pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from grams a join grams b on a.g = b.g where a.doc_id <> b.doc_id group by all),
        links as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where c >= 0.8 * (x.n + y.n - c)),
        ids as (select distinct doc_id as id from documents),
        {_REACH}
        select low.id as doc_id, low as class_id, coalesce(n, 0) as n_links from low left join counts on counts.id = low.id
    """,
    "op5_warc": """
        with payload as (select page_id, coalesce(html, '') as body from pages),
        hashed as (select page_id, strlen(body) as payload_bytes, sha1(body) as hex from payload),
        firsts as (select hex, payload_bytes, min(page_id) as first from hashed group by all)
        select h.page_id, h.payload_bytes::bigint as payload_bytes,
            array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda b:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h.hex, (g * 5 + 1)::int, 5))::bigint >> b) & 31) + 1)::int, 1)
            ), '')), '') as payload_digest,
            case when h.page_id = f.first then 'response' else 'revisit' end as record_type,
            case when h.page_id = f.first then null else f.first end as refers_to
        from hashed h join firsts f on h.hex = f.hex and h.payload_bytes = f.payload_bytes
    """,
    "op9_embedding_near_duplicates": f"""
        with recursive v as (
            select vec_id, label, embedding::double[] as e from embeddings
            where label is not null and embedding is not null and list_sum(list_transform(embedding::double[], lambda x: x * x)) > 0),
        links as (select x.vec_id as a, y.vec_id as b from v x join v y on x.label = y.label and x.vec_id <> y.vec_id
            where list_cosine_similarity(x.e, y.e) >= 0.93),
        ids as (select vec_id as id from embeddings),
        {_REACH}
        select low.id as vec_id, coalesce(n, 0) as n_links, low as component_id, low.id = low as kept
        from low left join counts on counts.id = low.id
    """,
    "op11_merkle_manifest": f"""
        with recursive rows as (
            select doc_id, lang, coalesce({_crc32("doc_id::varchar")} % 7 = 0, false) as tampered, n_chars,
                {_field("doc_id")} || {_field("source")} || {_field("lang")} as head, {_field("text")} as tail from documents),
        hashed as (select doc_id, lang, sha256(head || {_field("n_chars")} || tail) as leaf,
            sha256(head || {_field("case when tampered then n_chars + 1 else n_chars end")} || tail) as altered from rows),
        leaves as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as r from hashed),
        tree as (
            select lang, 0 as level, list(leaf order by r) as nodes from leaves group by lang
            union all
            select lang, level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
            from tree where len(nodes) > 1),
        subs as (select lang, nodes[1] as subroot, row_number() over (order by lang nulls first) as p from tree where len(nodes) = 1),
        tops as (select list(subroot order by p) as s from subs),
        root as (select s, case when len(s) = 1 then s[1] else sha256(array_to_string(s, '')) end as root from tops),
        steps as (
            select l.doc_id, l.lang, r, level, case when (r >> level) % 2 = 1 then nodes[r >> level] else '' end as before,
                case when (r >> level) % 2 = 0 then coalesce(nodes[(r >> level) + 2], '') else '' end as after
            from leaves l join tree t on l.lang is not distinct from t.lang where len(nodes) > 1
            union all
            select doc_id, l.lang, r, 1000, array_to_string(s[1:p - 1], ''), array_to_string(s[p + 1:], '')
            from leaves l join subs on l.lang is not distinct from subs.lang, root where len(s) > 1),
        paths as (select doc_id, lang, r, sha256(string_agg(before || after, '' order by level)) as proof,
            list(before || '|' || after order by level) as steps from steps group by doc_id, lang, r),
        folded as (
            select l.*, coalesce(proof, sha256('')) as proof_sha256, list_reduce(coalesce(steps, []),
                lambda acc, s: sha256(split_part(s, '|', 1) || acc || split_part(s, '|', 2)), altered) as folded_root
            from leaves l left join paths p on l.lang is not distinct from p.lang and l.r = p.r)
        select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified
        from folded f join subs on f.lang is not distinct from subs.lang, root
    """,
    "op12_fill_in_middle": r"""
        with drawn as (select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents),
        units as (select *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u,
            list_transform([0, 1, 2, 3], lambda i: ('0x' || substr(h, i * 8 + 1, 8))::bigint) as d from drawn),
        cut as (select *, len(u) as n, least(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) as a,
            greatest(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) as b from units),
        pieces as (select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s,
            case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or d[3] % 100 >= 50 then 'plain'
                when d[4] % 100 < 80 then 'spm' else 'psm' end as form from cut)
        select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars,
            case when form <> 'plain' then length(m) end as middle_chars,
            sha256(case form when 'plain' then t when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m
                else '<P>' || p || '<S>' || s || '<M>' || m end) as output_sha256,
            sha256(t) as restored_sha256
        from pieces
    """,
    "op13_private_spans": r"""
        with texts as (select doc_id, coalesce(text, '') as t, row_number() over () as r from documents),
        kinds(k, kind, pattern, part) as (values
            (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 0),
            (2, 'ip', '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)', 0),
            (3, 'card', '[0-9](?:[\x20-]?[0-9])+', 0),
            (4, 'phone', '\+[0-9][\x20().0-9-]+[0-9]', 0),
            (5, 'address', '[A-Za-z][A-Za-z0-9+.-]*://[A-Za-z0-9._~%!$&''()*+,;=:-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]+)?', 0),
            (6, 'account', '(?i:iban|account|acct|konto|compte|cuenta|passport|ssn)(?: ?(?i:number|nummer|no|nr)\.?)?[ :=#]{1,3}([A-Za-z0-9]+(?:[ -][0-9][A-Za-z0-9]*)*)', 1),
            (7, 'key', '\b(?:AKIA|ASIA|ghp_|gho_|glpat-|xoxb-|xoxp-|sk_live_)[A-Za-z0-9_-]{12,}', 0),
            (8, 'secret', '(?i:token|password|passwd|pwd|secret|api[_-]key|apikey|access[_-]key)["'']?[ \t]{0,4}[:=][ \t]{0,4}["'']?([A-Za-z0-9_./+=~-]{8,})', 1)),
        matched as (
            select r, k, kind, regexp_extract_all(t, pattern, 0) as m, case part when 1 then regexp_extract_all(t, pattern, 1) else regexp_extract_all(t, pattern, 0) end as v,
                string_split_regex(t, pattern) as g from texts, kinds where regexp_matches(t, pattern)),
        single as (select *, unnest(range(1, len(m) + 1)) as i from matched),
        placed as (select r, k, kind, m[i] as whole, v[i] as v, list_sum(list_transform(g[1:i] || m[1:i], lambda x: length(x))) as e from single),
        spans as (select *, e - length(v) as s, regexp_replace(v, '[^0-9]', '', 'g') as digits, replace(replace(v, '-', ''), ' ', '') as code from placed),
        good as (select * from spans where case kind
            when 'ip' then len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 or ('0' || right(x, 3))::int > 255)) = 0
            when 'card' then length(digits) between 14 and 19 and list_sum(list_transform(range(1, length(digits) + 1), lambda i:
                case when (length(digits) - i) % 2 = 0 then digits[i]::int else digits[i]::int * 2 - case when digits[i]::int > 4 then 9 else 0 end end)) % 10 = 0
            when 'phone' then length(digits) between 10 and 15
            when 'account' then case when lower(whole[1:4]) = 'iban' then regexp_full_match(code, '[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}')
                and list_reduce(list_transform(string_split(code[5:] || code[1:4], ''), lambda c: case when c between '0' and '9' then ascii(c) - 48 else ascii(c) - 55 end),
                    lambda a, x: (a * case when x > 9 then 100 else 10 end + x) % 97, 0) = 1
                else length(code) between 6 and 34 and length(digits) >= 5 end
            when 'key' then digits <> '' when 'secret' then digits <> '' else true end),
        listed as (select r, k, s, kind || ':' || s || ':' || e as one from good)
        select doc_id, count(*) filter (k = 1) as n_email, count(*) filter (k = 2) as n_ip, count(*) filter (k = 3) as n_card,
            count(*) filter (k = 4) as n_phone, sha256(coalesce(string_agg(one, ',' order by s, k) filter (k <= 4), '')) as base_sha256,
            coalesce(string_agg(one, ',' order by s, k), '') as spans
        from texts left join listed using (r) group by texts.r, doc_id
    """,
}
