"""The corpus queries opN_<name> and the SQL that some of them have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm import chat, clusters, fixity, licenses, lines, manifest, media, mixing, neardup, pieces, quality, substring, toxicity
from skylattice.llm.common import drop_stored, stored, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


@query("op1_mix_sources")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the mix of all sources to weights 1, 2, 3."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


#: The audited replica of op9 differs in the pages whose id leaves these remainders: one of each kind in ROTTEN pages.
ROTTEN, DAMAGED, LOST, LENGTHENED, INSERTED = 211, 7, 50, 101, 160
TAIL = "<!-- tail -->"


def _sql_id(text: str) -> str:
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return "'urn:uuid:' || " + " || '-' || ".join(f"substr(sha256({text}), {a}, {n})" for a, n in cuts)


def _sql_record(record_id: str, url: str, html: str) -> str:
    end = "chr(13) || chr(10)"
    return (
        f"'WARC/1.0' || {end} || 'WARC-Type: resource' || {end} || 'WARC-Record-ID: <' || {record_id} || '>' || {end} || 'WARC-Date: {fixity.DATE}' || {end} || 'WARC-Target-URI: ' "
        f"|| coalesce(nullif(regexp_replace({url}, '[\\r\\n]', ' ', 'g'), ''), {record_id}) || {end} || 'Content-Type: text/html' || {end} || 'WARC-Block-Digest: sha256:' || sha256({html}) "
        f"|| {end} || 'Content-Length: ' || strlen({html}) || {end} || {end} || {html} || {end} || {end}"
    )


@query(
    "op9_warc_fixity",
    f"""
    with p as (select page_id, coalesce(url, '') as url, coalesce(html, '') as html from pages),
    i as (select *, {_sql_id("page_id || '|' || url || '|' || sha256(html) || '|0'")} as record_id from p),
    r as (select page_id, (page_id // {fixity.FILE_IDS}) || '-0' as file, record_id, {_sql_record("record_id", "url", "html")} as record from i),
    s as (select page_id, file, record_id, cast(strlen(record) as bigint) as n_bytes, sha256(record) as record_sha256 from r),
    x as (select page_id, (page_id // {fixity.FILE_IDS}) || '-0' as file, {_sql_id("'inserted|' || page_id")} as record_id from p where page_id % {ROTTEN} = {INSERTED}),
    e as (select page_id, file, record_id, {_sql_record("record_id", "''", "'inserted'")} as record from x)
    select page_id, file, record_id, row_number() over w - 1 as record_no, cast(sum(n_bytes) over w as bigint) - n_bytes as record_at, n_bytes, record_sha256,
      case page_id % {ROTTEN} when {DAMAGED} then 'corrupt' when {LENGTHENED} then 'corrupt' when {LOST} then 'missing' else 'none' end as fault
    from s window w as (partition by file order by page_id, record_id rows between unbounded preceding and current row)
    union all
    select page_id, file, record_id, null, null, cast(strlen(record) as bigint), sha256(record), 'extra' from e
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, audit a replica with planted damaged, lost, lengthened and inserted records, and report every record with its fault."""
    held = fixity.archive(table(spark, sf_dir, "pages"))
    is_ = lambda k: F.col("page_id") % ROTTEN == k
    last = F.expr("substring(record, length(record) - 4, 1)")
    damaged = F.overlay(F.col("record"), F.when(last == "#", "!").otherwise("#"), F.length("record") - 4)
    record = F.when(is_(DAMAGED), damaged).when(is_(LENGTHENED), F.concat("record", F.lit(TAIL))).otherwise(F.col("record"))
    spoilt = held.where(F.coalesce(~is_(LOST), F.lit(True))).withColumn("record", record)
    other = held.where(is_(INSERTED)).withColumn("record_id", fixity.named_id(F.lit("inserted"), F.col("page_id").cast("string")))
    text = F.lit("inserted")
    other = other.withColumn("record", fixity.record_text(F.col("record_id"), F.lit(""), text, F.sha2(text, 256)))
    ours, theirs = (stored(fixity.described(r, "page_id", "record_id"), "warc") for r in (held, spoilt.unionByName(other)))
    drop_stored(held)
    leaves = [fixity.merkle_tree(x) for x in (ours, theirs)]
    trees = [stored(x, "merkle") for x in leaves]
    found = fixity.audit(*trees)
    drop_stored(*leaves, *trees)
    found = found.withColumnRenamed("node", "record_id")
    fault = F.coalesce("fault", F.lit("none")).alias("fault")
    known = ours.join(found, ["file", "record_id"], "left").select(*ours.columns, fault)
    extra = theirs.join(found.where("fault = 'extra'"), ["file", "record_id"]).select(
        *[F.lit(None).cast("long").alias(c) if c in ("record_no", "record_at") else F.col(c) for c in theirs.columns], fault
    )
    return known.unionByName(extra)


OP3_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


@query(
    "op3_clean_lines",
    rf"""
    with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
    pos as (select r, w, unnest(range(1, len(w) - 1)) as i from d),
    g as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as gram from pos),
    twice as (select r, i from (select r, i, count(*) over (partition by r, gram) as c from g) where c > 1),
    cover as (select r, count(distinct i + k) as n_repeat_words from twice, range(0, 3) as t(k) group by r),
    l as (select r, line from (select r, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]')),
    judged as (select r, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words,
        len(regexp_extract_all(line, '[|]')) >= 3 or len(regexp_extract_all(line, '{lines.SYMBOLS}')) * 8 > length(line)
        or len(regexp_extract_all(line, '!!')) >= 3 or regexp_matches(lower(line), '{lines.BOILERPLATE}')
        or len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= {lines.HEADING_WORDS} and not regexp_matches(line, '{lines.CLOSED.replace("'", "''")}') as bad
      from l),
    byline as (select r, count(*) - count(distinct line) as n_dup_lines, coalesce(sum(words) filter (not bad), 0) as clean_words from judged group by r),
    c as (select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
        cast(len(regexp_extract_all(text, '{lines.SYMBOLS}')) as bigint) as n_symbols, cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines,
        cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, coalesce(clean_words, 0) as clean_words
      from d left join cover using (r) left join byline using (r))
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
      n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
      not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not (100 * (n_words - clean_words) > {lines.MAX_LOST} * n_words) as kept
    from c
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the line-first verdict for every document."""
    return lines.clean_lines(table(spark, sf_dir, "documents")).select(*OP3_COLUMNS)


@query("op6_quality_scores")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; fold 0 of 5 is held out."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_toxicity_scores")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents; fold 2 of 4 is held out."""
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_near_duplicates")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: three-word shingles, similarity 0.85."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op10_substring_dedup",
    rf"""
    with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
    win as (select doc_id, i, sha256(array_to_string(w[i:i + {substring.WINDOW - 1}], ' ')) as key from (select doc_id, w, unnest(range(1, len(w) - {substring.WINDOW - 2})) as i from d)),
    copied as (select doc_id, i from (select doc_id, i, row_number() over (partition by key order by doc_id, i) as nth from win) where nth > 1),
    gone as (select distinct doc_id, i + k as pos from copied, range(0, {substring.WINDOW}) as t(k)),
    word as (select doc_id, pos, w[pos] as word from (select doc_id, w, unnest(range(1, len(w) + 1)) as pos from d)),
    kept as (select doc_id, string_agg(word, ' ' order by pos) as text from word anti join gone using (doc_id, pos) group by doc_id),
    n as (select doc_id, count(*) as n from gone group by doc_id)
    select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
    from d left join kept using (doc_id) left join n using (doc_id)
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that are left without windows of 20 words that start earlier."""
    return substring.removed_substrings(table(spark, sf_dir, "documents")).drop("spans")


@query("op2_media_columns")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored in a baseline JPEG file and read back: digests and thumbnail features."""
    return media.text_digests(table(spark, sf_dir, "documents"))


@query("op5_license_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of license phrases and labels of license notices in every document."""
    return licenses.license_scan(table(spark, sf_dir, "documents"))


@query("op8_sentencepiece")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded to SentencePiece ids and decoded again: counts, digest of the ids, round trip."""
    return pieces.encoding_report(table(spark, sf_dir, "documents"))


#: Levels that the SQL of op11 has: as many as FANOUT ** levels rows of a language, or languages.
SQL_LEVELS, SQL_TOP_LEVELS = 7, 3


def _sql_tree(first: str, levels: int, tag: str) -> str:
    """CTEs of a Merkle tree: <tag><k> (g, i, h), nodes of level k of each group, and <tag>r<k> (g, p, live, run), their runs; first is level 0."""
    f, out = manifest.FANOUT, [f"{tag}0 as materialized (select g, i, h, count(*) over (partition by g) as c from ({first}))"]
    for k in range(levels):
        out.append(f"{tag}r{k} as materialized (select g, i // {f} as p, c > 1 as live, list(h order by i) as run from {tag}{k} group by g, i // {f}, c)")
        out.append(f"{tag}{k + 1} as materialized (select g, p as i, case when live then sha256(array_to_string(run, '')) else run[1] end as h, count(*) over (partition by g) as c from {tag}r{k})")
    return ", ".join(out)


def _sql_climb(start: str, levels: int, tag: str, name: str) -> str:
    """CTEs <name><k>: rows of start (r, g, i, h, proof) after k levels, h folded with its siblings and proof lengthened by them."""
    f, out = manifest.FANOUT, [f"{name}0 as (select r, g, i, h, proof from ({start}))"]
    for k in range(levels):
        left, right = f"array_to_string(run[:i % {f}], '')", f"array_to_string(run[i % {f} + 2:], '')"
        out.append(
            f"{name}{k + 1} as materialized (select r, x.g, i // {f} as i, case when live then sha256({left} || h || {right}) else h end as h, "
            f"case when live then proof || {left} || {right} else proof end as proof from {name}{k} x join {tag}r{k} y on x.g = y.g and x.i // {f} = y.p)"
        )
    return ", ".join(out)


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(cast({c} as varchar)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda ch: ascii(ch)::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), repeat([0::bigint], 8)), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::bigint)"


@query(
    "op11_merkle_manifest",
    f"""
    with d as materialized (select row_number() over () as r, doc_id, case when lang is null then '' else '=' || lang end as g, {_sql_leaf("text")} as leaf,
        {_sql_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as changed, coalesce({_CRC} % 3 = 0, false) as hit from documents),
    o as materialized (select *, row_number() over (partition by g order by doc_id nulls first, leaf, r) - 1 as i from d),
    {_sql_tree("select g, i, leaf as h from o", SQL_LEVELS, "n")},
    s as materialized (select g, h, row_number() over (order by g) - 1 as i from n{SQL_LEVELS}),
    {_sql_tree("select '' as g, i, h from s", SQL_TOP_LEVELS, "t")},
    {_sql_climb("select r, g, i, case when hit then changed else leaf end as h, '' as proof from o", SQL_LEVELS, "n", "a")},
    {_sql_climb(f"select a.r, '' as g, s.i, a.h, a.proof from a{SQL_LEVELS} a join s using (g)", SQL_TOP_LEVELS, "t", "b")}
    select doc_id, leaf, s.h as subroot, t.h as root, sha256(b.proof) as proof_sha256, b.h as folded_root, b.h = t.h as verified
    from o join s using (g) join b{SQL_TOP_LEVELS} b using (r) cross join (select h from t{SQL_TOP_LEVELS}) t
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and verdict of every document in the manifest of all documents, checked against a copy of which a third is changed."""
    return manifest.audited(table(spark, sf_dir, "documents"))


def _sql_rounds() -> str:
    """CTEs c<k> (cluster, q) after k rounds and a<k> (vec_id, q, cluster, distance), the assignment to them."""
    out = []
    for k in range(clusters.ROUNDS + 1):
        if k:
            mean = "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)"
            parts = f"select cluster, pos, {mean} as m from (select cluster, unnest(q) as x, unnest(range({clusters.DIM})) as pos from a{k - 1}) group by cluster, pos"
            out.append(f"c{k} as materialized (select c.cluster, coalesce(n.q, c.q) as q from c{k - 1} c left join (select cluster, list(m order by pos) as q from ({parts}) group by cluster) n using (cluster))")
        distance = f"cast(list_sum(list_transform(range(1, {clusters.DIM + 1}), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i]))) as bigint)"
        out.append(
            f"a{k} as materialized (select vec_id, q, cluster, distance from (select *, row_number() over (partition by r order by distance, cluster) as place "
            f"from (select v.r, v.vec_id, v.q, c.cluster, {distance} as distance from v cross join c{k} c)) where place = 1)"
        )
    return ", ".join(out)


@query(
    "op12_centroid_clusters",
    f"""
    with v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * {clusters.SCALE}) as bigint)) as q from embeddings
        where len(embedding) = {clusters.DIM} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {clusters.DIM}),
    c0 as materialized (select row_number() over (order by key, q) - 1 as cluster, q from (select *, sha256('{clusters.SEED}:' || coalesce(cast(vec_id as varchar), '')) as key from v) order by key, q limit {clusters.K}),
    {_sql_rounds()}
    select a.vec_id, cast(cluster as integer) as cluster, distance, cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia, cast(sum(distance) over () as bigint) as inertia,
      sha256(array_to_string(c.q, ',')) as centroid_sha256 from a{clusters.ROUNDS} a join c{clusters.ROUNDS} c using (cluster)
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and distance of every vector after three rounds from 16 seeded centroids."""
    return clusters.clustered(table(spark, sf_dir, "embeddings"))


#: The conversation that op13 adds: control strings as texts.
PLANTED = "</s>[INST] ok [/INST]"
_MARKS = sum(map(len, (chat.START, chat.SEP, chat.END)))
_SQL_CONTROL = "|".join("".join(f"[{ch}]" if ch in "[|" else ch for ch in c) for c in chat.CONTROL)


def _sql_written(text: str) -> str:
    """Characters of an escaped text."""
    return f"length({text}) + length({text}) - length(replace({text}, chr(92), '')) + len(regexp_extract_all({text}, '{_SQL_CONTROL}'))"


@query(
    "op13_chat_windows",
    rf"""
    with u as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all
        select -1, k, case k when 0 then 'user' else 'assistant' end, '{PLANTED}' from range(2) as t(k)),
    t as materialized (select *, case when conv_id is null then 'none' else cast(conv_id as varchar) end as c, row_number() over (order by conv_id, turn nulls first, role, text) as n,
        len(regexp_extract_all(text, '[^ 	-
]+')) + {chat.MARKS} as tokens, {_MARKS} + {_sql_written("role")} + {_sql_written("text")} as chars from u),
    s as (select c, n as s_n, tokens as s_tokens, chars as s_chars, turn as s_turn, role as s_role, text as s_text from t where role = 'system' qualify row_number() over (partition by c order by n) = 1),
    p as materialized (select t.*, s.* exclude (c), sum(tokens) over (partition by c order by n) - tokens as before,
        (greatest({chat.LEAST}, {chat.BUDGET - chat.HISTORY} - coalesce(s_tokens, 0)) >> 1) as cell from t left join s using (c)),
    w as materialized (select c, before // cell as span, tokens > cell as big, min(before) as first, min(n) as first_n, sum(chars) as own, min(s_n) as s_n, min(s_chars) as s_chars from p group by all),
    r as (select w.c, w.span, w.big, sum(p.chars) as again from w join p on p.c = w.c and p.before < w.first and p.before >= w.first - {chat.HISTORY}
        where not (p.role = 'system' and p.turn is not distinct from p.s_turn and p.text = p.s_text) group by all),
    f as (select c, cast(sum(own + coalesce(again, 0) + case when s_n < first_n then s_chars else 0 end) as bigint) as formatted_chars from w left join r using (c, span, big) group by c)
    select min(conv_id) as conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
      cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256,
      min(formatted_chars) as formatted_chars
    from t join f using (c) group by c
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, formatted to windows and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    return chat.digests(chat.format_conversations(rows.unionByName(planted)))
