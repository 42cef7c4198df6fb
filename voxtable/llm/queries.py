"""The corpus operators as registered queries, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.llm import audit, chat, fingerprints, ids, jaccard, merkle, neighbours, packing, pieces, quality, toxicity, urls, vafile
from voxtable.llm.common import remainder, table

Query = Callable[[SparkSession, str], DataFrame]
#: A conversation whose texts hold control strings of chat templates.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_components(table(spark, folder, "documents"))


def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, folder, "labels"), remainder("doc_id", 3) != 1)
    score = F.col("toxicity_score")
    return toxicity.scored(docs, model).select(
        "doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), score.alias("score"),
        (score >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.read_windows(chat.format_windows(turns.unionByName(extra))))


def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, folder, "labels"), remainder("doc_id", 5) != 0)
    score = F.col("quality_score")
    return quality.scored(docs, model).select(
        "doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), score.alias("score"),
        (score >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def id_files(spark: SparkSession, folder: str) -> DataFrame:
    return ids.binary_output(table(spark, folder, "documents"))


def embedding_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, folder, "embeddings"))[0]


def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def exact_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = vafile.integers(table(spark, folder, "embeddings"))
    return vafile.top_k(vectors.where("vec_id % 20 = 0"), vectors)


def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"))


def piece_ids(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digests(table(spark, folder, "documents"))


def fingerprint_edits(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edits(table(spark, folder, "documents"))


def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    lowered = F.when(remainder("doc_id", 3) == 0, F.translate("text", merkle.UPPER, merkle.LOWER)).otherwise(F.col("text"))
    rows = merkle.proofs(merkle.build(table(spark, folder, "documents"), lowered))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard_join": jaccard_join,
    "op2_toxicity": toxicity_scores,
    "op3_chat_formatting": chat_format,
    "op4_quality_classifier": quality_scores,
    "op5_token_id_output": id_files,
    "op6_embedding_near_dedup": embedding_duplicates,
    "op7_best_fit_packing": best_fit_packing,
    "op8_exact_top_k": exact_search,
    "op9_url_filters": url_filter,
    "op10_sentencepiece": piece_ids,
    "op11_document_fingerprints": fingerprint_edits,
    "op12_merkle_manifest": merkle_manifest,
    "op13_filter_audit": filter_audit,
}

ORACLE: dict[str, str] = {
    "op1_ngram_jaccard_join": """
    with recursive worded as (
        select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words from documents),
    shingled as materialized (
        select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 4 then [array_to_string(words, ' ')]
            else list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) end) as shingle from worded),
    sizes as materialized (select doc_id, count(*) as n from shingled group by all),
    links as materialized (
        select c.a, c.b from (select x.doc_id as a, y.doc_id as b, count(*) as common from shingled x join shingled y using (shingle) where x.doc_id <> y.doc_id group by all) c
        join sizes m on m.doc_id = c.a join sizes n on n.doc_id = c.b where 100 * common >= 85 * (m.n + n.n - common)),
    reach as (select doc_id, doc_id as other from documents union select r.doc_id, l.b from reach r join links l on r.other = l.a)
    select d.doc_id, coalesce(max(s.n), 0)::bigint as n_shingles, min(r.other) as component_id
    from documents d left join sizes s using (doc_id) join reach r using (doc_id) group by d.doc_id
    """,
    "op12_merkle_manifest": """
    with recursive rows as (
        select *, case when xor(4294967295::ubigint, list_reduce(
            list_prepend(4294967295::ubigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as ubigint))),
            lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: cast(i as ubigint))),
                lambda v, i: xor(v >> 1, 3988292384::ubigint * (v & 1))))) % 3 = 0
            then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as lowered from documents),
    fields as (
        select *, coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') || coalesce(strlen(cast(source as varchar)) || ':' || source, '-') || coalesce(strlen(cast(lang as varchar)) || ':' || lang, '-') || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') as head from rows),
    leaves as (
        select doc_id, coalesce('1' || lang, '0') as tree, sha256(head || coalesce(strlen(cast(text as varchar)) || ':' || text, '-')) as leaf, sha256(head || coalesce(strlen(cast(lowered as varchar)) || ':' || lowered, '-')) as changed from fields),
    placed as materialized (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i from leaves),
    nodes as (
        select tree, 0 as h, i, leaf as digest from placed
        union all select tree, h + 1, i // 8, sha256(string_agg(digest, '' order by i)) from (select *, count(*) over (partition by tree) as n from nodes)
        where n > 1 group by tree, h, i // 8),
    subroots as materialized (select tree, arg_max(digest, h) as subroot, row_number() over (order by tree) - 1 as i from nodes group by tree),
    upper as (
        select 'top' as tree, 0 as h, i, subroot as digest from subroots
        union all select tree, h + 1, i // 8, sha256(string_agg(digest, '' order by i)) from (select *, count(*) over () as n from upper) where n > 1 group by tree, h, i // 8),
    every as materialized (select * from nodes union all select * from upper),
    tops as (select tree, max(h) as top, arg_max(digest, h) as digest from every group by tree),
    sides as materialized (
        select a.tree, a.h, a.i, coalesce(string_agg(s.digest, '' order by s.i) filter (s.i < a.i), '') || '|' || coalesce(string_agg(s.digest, '' order by s.i) filter (s.i > a.i), '') as pair
        from every a join tops t on a.tree = t.tree and a.h < t.top join every s on a.tree = s.tree and a.h = s.h and a.i // 8 = s.i // 8 group by all),
    above as (
        select r.tree, r.subroot, coalesce(list(s.pair order by s.h) filter (s.pair is not null), []) as pairs
        from subroots r left join sides s on s.tree = 'top' and s.i = r.i // cast(pow(8, s.h) as bigint) group by all),
    below as (
        select p.tree, p.i, coalesce(list(s.pair order by s.h) filter (s.pair is not null), []) as pairs
        from placed p left join sides s on s.tree = p.tree and s.i = p.i // cast(pow(8, s.h) as bigint) group by all),
    proofs as (
        select p.doc_id, p.leaf, p.changed, a.subroot, list_concat(b.pairs, a.pairs) as pairs, (select digest from tops where tree = 'top') as root
        from placed p join below b on p.tree = b.tree and p.i = b.i join above a on a.tree = p.tree),
    folded as (
        select *, sha256(replace(array_to_string(pairs, ''), '|', '')) as proof_sha256,
            list_reduce(list_prepend(changed, pairs), lambda n, p: sha256(split_part(p, '|', 1) || n || split_part(p, '|', 2))) as folded_root from proofs)
    select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from folded
    """,
    "op13_filter_audit": """
    with worded as materialized (
        select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
            list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words from documents),
    lows as (select text, min(doc_id) as low from worded group by all),
    flags as materialized (
        select w.doc_id, part, [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
            100 * len(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 5 * len(w.text), regexp_matches(w.text, '[#$%&*|]'), coalesce(w.doc_id > l.low, false)] as fails
        from worded w join lows l on w.text = l.text),
    marks as (select doc_id, max(quality) = 1 as good, max(toxic) = 1 as toxic from labels where doc_id is not null group by all),
    counts as materialized (
        select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (m.toxic) as toxic, len(list_filter(fails, lambda f: f)) as failed
        from flags left join marks m using (doc_id) group by all),
    letters as (select * from (values ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)) t(letter, k)),
    orders as (
        select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.k, b.k, c.k, d.k, e.k] as ks
        from letters a, letters b, letters c, letters d, letters e where len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
    steps as (select filter_order, step, ks[step] as k, ks[:step - 1] as earlier from orders, range(1, 6) s(step))
    select part, filter_order, cast(step as int) as step,
        cast(sum(case when not gone and not fails[k] then n else 0 end) as bigint) as kept,
        cast(sum(case when not gone and fails[k] then n else 0 end) as bigint) as removed,
        cast(sum(case when gone and fails[k] then n else 0 end) as bigint) as redundant,
        cast(sum(case when fails[k] and failed = 1 then n else 0 end) as bigint) as unique_fails,
        cast(sum(case when not gone and fails[k] then good else 0 end) as bigint) as good_lost,
        cast(sum(case when not gone and fails[k] then toxic else 0 end) as bigint) as toxic_lost,
        cast(sum(case when fails[k] then n * 120 // failed else 0 end) as bigint) as shapley
    from (select *, len(list_filter(earlier, lambda i: fails[i])) > 0 as gone from counts, steps) group by all
    """,
    "op6_embedding_near_dedup": """
    with recursive vectors as materialized (
        select vec_id, list_transform(embedding, lambda v: cast(v as double)) as x from embeddings
        where embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0 and len(list_filter(embedding, lambda v: v <> 0)) > 0),
    links as materialized (
        select a.vec_id as a, b.vec_id as b from vectors a join vectors b on a.vec_id <> b.vec_id and len(a.x) = len(b.x)
        where list_cosine_similarity(a.x, b.x) >= 0.9),
    reach as (select vec_id, vec_id as other from embeddings union select r.vec_id, l.b from reach r join links l on r.other = l.a)
    select e.vec_id, (select count(*) from links l where l.a = e.vec_id)::bigint as n_links, min(r.other) as component_id, e.vec_id = min(r.other) as kept
    from embeddings e join reach r using (vec_id) group by e.vec_id
    """,
    "op8_exact_top_k": """
    with usable as (
        select vec_id, list_transform(embedding, lambda v: cast(floor(64 * cast(v as double)) as bigint)) as x from embeddings
        where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0),
    scored as (
        select q.vec_id as query_id, c.vec_id, cast(list_dot_product(cast(q.x as double[]), cast(c.x as double[])) as bigint) as score
        from usable q join usable c on q.vec_id <> c.vec_id and len(q.x) = len(c.x) where q.vec_id % 20 = 0)
    select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from scored
    qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20
    """,
    "op3_chat_formatting": """
    with rows as (
        select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
        union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    sized as (
        select *, length(regexp_replace(regexp_replace(text, '\\S+', 'x', 'g'), '\\s+', '', 'g')) + 1 as tokens,
            row_number() over (partition by conv_id order by turn nulls first, role, text) as place,
            regexp_replace(role, '([<\\[])(\\\\*)(/?s>|/?ROLE\\]|/?INST\\]|</?SYS>>)', '\\1\\\\\\2\\3', 'g') as erole,
            regexp_replace(text, '([<\\[])(\\\\*)(/?s>|/?ROLE\\]|/?INST\\]|</?SYS>>)', '\\1\\\\\\2\\3', 'g') as etext from rows),
    begun as (
        select *, length('<s>[ROLE][/ROLE]</s>') + length(erole) + length(etext) as chars,
            sum(tokens) over (partition by conv_id order by place) - tokens as start from sized),
    room as (select *, place = 1 and role = 'system' as is_system,
        512 - coalesce(max(case when place = 1 and role = 'system' then tokens end) over (partition by conv_id), 0) as free,
        greatest(1, free - 128) as room from begun),
    spans as (select *, 2 * (start // room) + case when (start + tokens - 1) // room > start // room then 1 else 0 end as span from room),
    firsts as (select conv_id, span, min(start) as first_start, max(case when span % 2 = 1 then tokens else 0 end) as single from spans group by all),
    nexts as (select *, lead(span) over (partition by conv_id order by span) as next_span, lead(single) over (partition by conv_id order by span) as next_single,
            lead(first_start) over (partition by conv_id order by span) as next_start from firsts),
    own as (select conv_id, sum(chars) as chars from spans group by all),
    history as (
        select s.conv_id, sum(chars) as chars from spans s join nexts n on s.conv_id is not distinct from n.conv_id and s.span = n.span
        where not is_system and next_start - start <= least(128, free - next_single) group by all),
    windows as (select conv_id, count(*) as n from firsts group by all),
    led as (
        select s.conv_id, s.chars * (w.n - 1) as chars from spans s join windows w on s.conv_id is not distinct from w.conv_id where is_system),
    digests as (
        select conv_id, count(*) as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
            coalesce(sum(case when role = 'assistant' then length(text) end), 0) as loss_chars,
            sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by place), '')) as loss_sha256 from spans group by all)
    select d.conv_id, n_turns, turns_sha256, cast(loss_chars as bigint) as loss_chars, loss_sha256,
        cast(o.chars + coalesce(h.chars, 0) + coalesce(l.chars, 0) as bigint) as formatted_chars
    from digests d join own o on d.conv_id is not distinct from o.conv_id
    left join history h on d.conv_id is not distinct from h.conv_id left join led l on d.conv_id is not distinct from l.conv_id
    """,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
