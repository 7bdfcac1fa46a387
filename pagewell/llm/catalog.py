"""The operators as queries over the given tables, with SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewell.catalog.registry import Entry
from pagewell.llm.embeddings import near_vectors
from pagewell.llm.hard_negatives import hard_negatives
from pagewell.llm.located import place
from pagewell.llm.merkle import folded, leaf_digest, merkle_proofs, proof_digest
from pagewell.llm.mixing import mix_sources
from pagewell.llm.packing import pack_documents
from pagewell.llm.pattern_packing import pattern_pack
from pagewell.llm.quality import fit_rules
from pagewell.llm.simhash import simhash_groups
from pagewell.llm.streaming_dedup import exact_duplicates
from pagewell.llm.substring_dedup import repeated_windows
from pagewell.llm.suffix_dedup import repeated_bytes
from pagewell.llm.token_counts import TokenTotals, count_tokens
from pagewell.llm.warc import base32_sha1, read_warc, write_warc
from pagewell.session import scratch_path

ENTRIES: dict[str, Entry] = {}


def _query(name: str, sql: str | None = None):
    def register(run):
        ENTRIES[name] = Entry(run, sql)
        return run

    return register


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query("op3_simhash")
def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_groups(_table(spark, folder, "documents"))


@_query(
    "op4_exact_dedup",
    """
    SELECT doc_id,
           max(doc_id) OVER g AS keep_id,
           count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents
    WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
)
def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(spark, _table(spark, folder, "documents")).drop("at")


@_query("op1_pack")
def op1_pack(spark: SparkSession, folder: str) -> DataFrame:
    packed = pack_documents(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@_query("op8_mix_sources")
def op8_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(_table(spark, folder, "documents"))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model is fitted on."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@_query("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = fit_rules(docs, _table(spark, folder, "labels"), keep=~held_out())
    scored = docs.select("doc_id", held_out().alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@_query(
    "op5_substring_dedup",
    r"""
    WITH w AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
    ), win AS (
        SELECT doc_id, p, array_to_string(words[p:p + 49], ' ') AS win
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS p FROM w)
    ), hit AS (
        SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY win) AS low FROM win) WHERE low < doc_id
    ), gone AS (
        SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM hit
    ), each AS (
        SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w
    ), kept AS (
        SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS rest
        FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
    )
    SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (doc_id)
    """,
)
def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_windows(_table(spark, folder, "documents")).drop("spans")


@_query(
    "op9_embedding_near_dedup",
    """
    WITH RECURSIVE v AS (
        SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    ), ok AS (
        SELECT vec_id, e FROM v
        WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND list_dot_product(e, e) > 0
    ), link AS (
        SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b
        ON a.vec_id <> b.vec_id
           AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95
    ), reach AS (
        SELECT vec_id AS u, vec_id AS w FROM v UNION SELECT r.u, l.w FROM reach r JOIN link l ON r.w = l.u
    ), n AS (
        SELECT u, count(*) AS n FROM link GROUP BY u
    ), c AS (
        SELECT u, min(w) AS c FROM reach GROUP BY u
    )
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
    FROM v JOIN c ON c.u = vec_id LEFT JOIN n ON n.u = vec_id
    """,
)
def op9_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(_table(spark, folder, "embeddings"))


@_query(
    "op6_warc",
    """
    WITH p AS (
        SELECT page_id, coalesce(html, '') AS body FROM pages
    ), d AS (
        SELECT page_id, strlen(body) AS n, min(page_id) OVER (PARTITION BY body) AS first,
               list_transform(range(0, 8), lambda i: ('0x' || substr(sha1(body), (i * 5 + 1)::INT, 5))::INT) AS g
        FROM p
    )
    SELECT page_id, n AS payload_bytes,
           list_aggregate(flatten(list_transform(g, lambda v: list_transform([15, 10, 5, 0], lambda s:
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> s) & 31) + 1]))), 'string_agg', '') AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM d
    """,
)
def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(_table(spark, folder, "pages"), path)
    records = read_warc(spark, path, ["record_type", "record_id", "refers_to", "payload_digest", "headers", "payload"])
    is_response = F.col("record_type") == "response"

    def page(name: str) -> Column:
        return F.regexp_extract(name, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")

    return records.select(
        page("record_id").alias("page_id"),
        F.when(is_response, F.octet_length("payload")).otherwise(F.col("headers")["x-payload-length"]).cast("long").alias("payload_bytes"),
        F.when(is_response, base32_sha1(F.col("payload"))).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias(
            "payload_digest"
        ),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


@_query("op7_token_counts")
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Totals after three batches: all documents come, low-quality ones go, then the rest is recounted.

    The second batch deletes the documents that ``labels`` marks 0; it is committed twice. The third
    revises the documents that repeat lines: it counts each distinct line once. The ledger's key is a
    document's file and row, so rows without a ``doc_id`` and rows that share one are counted one by
    one; a label holds for all rows of its id, and none without an id.
    """
    path = public_tokenizers.path("word_bpe_49k.json")
    key = F.concat(place()["file"], F.lit("#"), place()["row"].cast("string"))
    docs = _table(spark, folder, "documents").select(key.alias("id"), "doc_id", "source", "lang", "text")
    version = F.lit("word_bpe_49k").alias("version")
    totals = TokenTotals(spark, scratch_path(spark, "token_totals"))
    known = docs.drop("doc_id")
    totals.commit(0, count_tokens(known, path).withColumn("op", F.lit("upsert")).withColumn("version", version))
    low = _table(spark, folder, "labels").where("quality = 0").select("doc_id")
    gone = docs.join(low, "doc_id", "left_semi").select(
        "id", F.lit("delete").alias("op"), F.lit(None).cast("string").alias("source"),
        F.lit(None).cast("string").alias("lang"), version, F.lit(0).alias("tokens"),
    )
    totals.commit(1, gone)
    totals.commit(1, gone)
    lines = F.split("text", "\n")
    shorter = docs.where(F.size(lines) > F.size(F.array_distinct(lines))).withColumn(
        "text", F.array_join(F.array_distinct(lines), "\n")
    )
    kept = shorter.join(low, "doc_id", "left_anti").drop("doc_id")
    totals.commit(2, count_tokens(kept, path).withColumn("op", F.lit("upsert")).withColumn("version", version))
    return totals.totals()


@_query("op10_suffix_dedup")
def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = repeated_bytes(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@_query(
    "op11_hard_negatives",
    """
    WITH v AS (
        SELECT row_number() OVER () AS row, vec_id,
               CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row AS other, b.vec_id, a.label = b.label AS alike,
               list_dot_product(a.e, b.e)::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.row <> b.row AND len(a.e) = len(b.e)
    ), positive AS (
        SELECT anchor, anchor_id, other, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
        QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) <= 5
    )
    SELECT p.anchor_id, positive_id,
           (row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY score DESC, vec_id NULLS LAST))::INTEGER AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM positive p JOIN scored n
    ON p.anchor = n.anchor AND NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10
    """,
)
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


@_query("op12_pattern_packing")
def op12_pattern_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = pattern_pack(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


def _merkle_sql() -> str:
    """Trees level by level; a leaf's path follows from its index, and the subroots are the leaves of one more tree."""

    def value(name: str) -> str:
        return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"

    def leaf(n_chars: str) -> str:
        return "sha256(" + " || ".join(map(value, ["doc_id", "source", "lang", n_chars, "text"])) + ")"

    def levels(name: str, leaves: str) -> str:
        return f"""{name}(tree, level, i, n, h) AS (
            SELECT tree, 0, i, n, h FROM {leaves}
            UNION ALL
            SELECT tree, level + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i))
            FROM {name} WHERE n > 1 GROUP BY tree, level, i // 2
        )"""

    def steps(rows: str, name: str, at: str, tree: str, first: str) -> str:
        return f"""
            SELECT p.r, {first} + l.level AS step, CASE WHEN ({at} >> l.level) % 2 = 1 THEN s.h ELSE '' END AS a,
                   CASE WHEN ({at} >> l.level) % 2 = 0 THEN coalesce(s.h, '') ELSE '' END AS b
            FROM {rows} JOIN (SELECT DISTINCT tree, level FROM {name} WHERE n > 1) l ON l.tree = {tree}
            LEFT JOIN {name} s ON s.tree = l.tree AND s.level = l.level AND s.i = xor({at} >> l.level, 1)"""

    crc32 = """xor(list_reduce(list_prepend(4294967295::BIGINT,
                list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                    lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT)"""
    return f"""
    WITH RECURSIVE docs AS (
        SELECT doc_id, lang, {leaf('n_chars')} AS leaf,
               CASE WHEN {crc32} % 7 = 0 THEN {leaf('(n_chars + 1)')} END AS changed
        FROM documents
    ), placed AS (
        SELECT row_number() OVER () AS r, doc_id, leaf AS h, coalesce(changed, leaf) AS seen,
               dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
               row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
               count(*) OVER (PARTITION BY lang) AS n
        FROM docs
    ), {levels('low', 'placed')}, subroots AS (
        SELECT 0 AS tree, tree AS i, count(*) OVER () AS n, h FROM low WHERE n = 1
    ), {levels('top', 'subroots')}, deep AS (
        SELECT tree, max(level) AS deep FROM low GROUP BY tree
    ), step AS (
        {steps('placed p', 'low', 'p.i', 'p.tree', '0')}
        UNION ALL
        {steps('placed p JOIN deep d ON d.tree = p.tree', 'top', 'p.tree', '0', 'd.deep')}
    ), path AS (
        SELECT r, list({{'a': a, 'h': '', 'b': b}} ORDER BY step) AS steps, string_agg(a || b, '' ORDER BY step) AS beside
        FROM step GROUP BY r
    ), found AS (
        SELECT doc_id, p.h AS leaf, s.h AS subroot, t.h AS root, sha256(coalesce(beside, '')) AS proof_sha256,
               list_reduce(list_prepend({{'a': '', 'h': seen, 'b': ''}}, coalesce(steps, [])),
                           lambda x, y: {{'a': '', 'h': sha256(y.a || x.h || y.b), 'b': ''}}).h AS folded_root
        FROM placed p JOIN subroots s ON s.i = p.tree JOIN top t ON t.n = 1 LEFT JOIN path USING (r)
    )
    SELECT *, folded_root = root AS verified FROM found
    """


@_query("op13_merkle_manifest", _merkle_sql())
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    row = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text")]
    more = [*row[:3], F.col("n_chars") + 1, row[4]]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = docs.select("doc_id", "lang", leaf_digest(*row).alias("leaf"), F.when(tampered, leaf_digest(*more)).alias("changed"))
    proofs = merkle_proofs(leaves, "lang", "doc_id")
    return proofs.select(
        "row.doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"),
        folded(F.coalesce("row.changed", "leaf"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
