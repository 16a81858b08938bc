"""Queries over the driver's tables, one per operator, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, components, fingerprint, jaccard, langid, mixing, neardup, packing, repeats, secrets, urls

#: fixed values: the rules of the URL query
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: the query's list: one URL, and every URL that the pages name on a host with one of these names
LISTED_URL = "http://listed.invalid/"
LISTED_HOSTS = r"(^|\.)(spam-farm|casino-win|cheap-pills|free-bets|adult-x|ads-track)\."


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    components.checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan_secrets(docs, secrets.train_crf(docs)).select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(_span_text(base), 256).alias("base_sha256"), _span_text(F.col("spans")).alias("spans"), count("crf")
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    extra = extra.select(*[F.col(f.name).cast(f.dataType) for f in turns.schema.fields])
    chats = chat.read_back(chat.format_chats(turns.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def op3_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.embedding_neardups(table(spark, sf_dir, "embeddings"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train_langid(docs)
    # a null id has no remainder: false
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out")
    return langid.predict_languages(docs.select("doc_id", "text"), model).select("doc_id", held, "lang_pred", "score")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprint.with_next(table(spark, sf_dir, "documents"))
    n = F.length("_text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.withColumn("_edited", F.concat(F.substr(F.col("_text"), F.lit(1), n - cut), F.substr(F.col("_next_text"), F.lit(1), cut)))
    rows = fingerprint.sketch(rows.drop("_next_text"), "_edited", "_esketch")
    return rows.select(
        F.col("_id").alias("doc_id"), n.cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
        fingerprint.sketch_text(F.col("_sketch")).alias("fingerprint"), fingerprint.sketch_text(F.col("_esketch")).alias("edited_fingerprint"),
        fingerprint.containment(F.col("_sketch"), F.col("_esketch")).alias("near_edited"), fingerprint.containment(F.col("_sketch"), F.col("_next_sketch")).alias("near_next"),
    )


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, mixing.word_count(F.col("text")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = pages.select("url").filter(F.rlike(urls.url_host(F.col("url")), F.lit(LISTED_HOSTS))).union(spark.range(1).select(F.lit(LISTED_URL)))
    keys = urls.rule_keys(spark, URL_RULES).union(urls.url_keys(listed))
    return urls.filter_urls(pages, keys)


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_chat_format, op3_embedding_neardup, op4_language_id, op5_jaccard_join, op6_fingerprint, op7_mix_sources, op8_suffix_dedup, op9_best_fit_packing, op10_url_filter)}

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLES: dict[str, str] = {
    "op7_mix_sources": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
        ), s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
        ), w AS (
            SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, source_size * CAST(3 AS DOUBLE) AS cap FROM s
        ), l AS (
            SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
                coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
            FROM w
        ), t AS (
            SELECT source, source_size, least(cap, coalesce(max(CASE WHEN (total - before) / rest * w <= cap THEN (total - before) / rest END) OVER () * w, cap)) AS target
            FROM l
        ), r AS (
            SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
                CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.slice, d.doc_id) AS DOUBLE) AS place,
                CAST(CAST('0x' || substr(md5('42:' || coalesce('s' || d.source, 'null')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS u
            FROM (SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2) AS BIGINT) % 64 AS slice FROM d) d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target, CAST(floor(place * rate + u) - floor((place - 1) * rate + u) AS BIGINT) * size AS taken FROM r
    """,
    "op10_url_filter": rf"""
        WITH p AS (
            SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages
        ), c AS (
            SELECT *, regexp_replace(regexp_replace(host, '^www\.', ''), ':[0-9]*$', '') || regexp_replace(path, '/+$', '') AS form FROM p
        ), listed AS (SELECT DISTINCT form FROM c WHERE regexp_matches(host, '{LISTED_HOSTS}') UNION SELECT 'listed.invalid'
        ), r AS (SELECT * FROM (VALUES {_RULES_SQL}) AS v(h, p, v)
        ), b AS (
            SELECT host, path, max(struct_pack(n := length(r.h || r.p), m := length(r.h), h := r.h, p := r.p, v := r.v)) AS best
            FROM (SELECT DISTINCT host, path FROM p) q JOIN r ON (q.host = r.h OR ends_with(q.host, '.' || r.h)) AND starts_with(q.path, r.p)
            GROUP BY host, path
        )
        SELECT page_id, c.host, c.path, best.h || best.p AS rule, CASE WHEN best IS NOT NULL THEN best.v WHEN listed.form IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
        FROM c LEFT JOIN b ON c.host = b.host AND c.path = b.path LEFT JOIN listed ON listed.form = c.form AND c.host <> ''
    """,
}

_CLOSURE_SQL = """, reach AS (
            SELECT DISTINCT a AS node, a AS seen FROM links
            UNION
            SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.seen
        ), comp AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)"""

ORACLES |= {
    "op2_chat_format": r"""
        WITH RECURSIVE c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), e AS (
            SELECT *, row_number() OVER w AS i, len(regexp_extract_all(text, '[\p{L}\p{M}]+|\p{N}+|[^\s\x0B\p{L}\p{M}\p{N}]')) + 4 AS n,
                list_sum(list_transform([role, text], lambda x: length(replace(replace(replace(replace(replace(x, chr(92), chr(92) || chr(92)),
                    '[INST]', '[' || chr(92) || 'INST]'), '[/INST]', '[' || chr(92) || '/INST]'), '<s>', '<' || chr(92) || 's>'), '</s>', '<' || chr(92) || '/s>')))) + 17 AS width
            FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
        ), p AS (
            SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY i) - n AS start, first_value(CASE WHEN role = 'system' THEN n ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS system FROM e
        ), q AS (
            SELECT *, greatest(384 - system, 1) AS cap, start // greatest(16 * greatest(384 - system, 1), 129) AS block FROM p
        ), g AS (
            SELECT conv_id, i, block, i AS i0, n AS used FROM q WHERE i = 1
            UNION ALL
            SELECT q.conv_id, q.i, q.block, CASE WHEN q.block <> g.block OR g.used + q.n > q.cap THEN q.i ELSE g.i0 END, CASE WHEN q.block <> g.block OR g.used + q.n > q.cap THEN q.n ELSE g.used + q.n END
            FROM g JOIN q ON q.conv_id IS NOT DISTINCT FROM g.conv_id AND q.i = g.i + 1
        ), f AS (
            SELECT conv_id, i0, max(i) AS i1, max(used) AS used FROM g GROUP BY conv_id, i0
        ), o AS (
            SELECT f.conv_id, f.i0, sum(q.width) AS chars FROM f JOIN q x ON x.conv_id IS NOT DISTINCT FROM f.conv_id AND x.i = f.i0 JOIN q ON q.conv_id IS NOT DISTINCT FROM f.conv_id
                AND (q.i BETWEEN f.i0 AND f.i1 OR (q.i < f.i0 AND CASE WHEN q.i = 1 AND q.role = 'system' THEN true ELSE x.start - q.start <= least(128, 512 - x.system - f.used) END))
            GROUP BY f.conv_id, f.i0
        ), s AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM o GROUP BY conv_id)
        SELECT e.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
            any_value(formatted_chars) AS formatted_chars
        FROM e JOIN s ON e.conv_id IS NOT DISTINCT FROM s.conv_id GROUP BY e.conv_id
    """,
    "op3_embedding_neardup": f"""
        WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
        ok AS (
            SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
            WHERE list_inner_product(x.e, y.e) / (sqrt(list_inner_product(x.e, x.e)) * sqrt(list_inner_product(y.e, y.e))) >= 0.98
        ){_CLOSURE_SQL}, n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(least(component_id, vec_id), vec_id) AS component_id, coalesce(component_id >= vec_id, true) AS kept
        FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN comp ON comp.node = vec_id
    """,
    "op5_jaccard_join": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS k FROM w)
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
        ), links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
        ){_CLOSURE_SQL}
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN comp ON comp.node = w.doc_id
    """,
    "op8_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents
        ), p AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)
        ), m AS (SELECT s, min(doc_id) AS m FROM p GROUP BY s
        ), hit AS (SELECT p.doc_id, i FROM p JOIN m ON p.s = m.s AND m.m < p.doc_id
        ), g AS (SELECT *, sum(CASE WHEN i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM hit)
        ), r AS (SELECT doc_id, k, min(i) AS lo, max(i) + 50 AS hi FROM g GROUP BY doc_id, k
        ), q AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS past FROM r
        ), t AS (
            SELECT q.doc_id, CAST(sum(hi - lo) AS BIGINT) AS removed, count(*) AS spans, string_agg(substr(h, 2 * past + 1, 2 * (lo - past)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS kept
            FROM q JOIN d ON d.doc_id = q.doc_id GROUP BY q.doc_id
        )
        SELECT d.doc_id, d.n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN t ON t.doc_id = d.doc_id
    """,
}
