"""Queries that apply each operator to its whole table, and their DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import bpe, chat, html, imatch, langid, linededup, merkle, mixing, packing, quality, ranked, sharding, simhash
from lumenframe.llm._shared import table, written

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SHARDS = 40


def op1_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    stats = written(quality.with_text_stats(docs).drop("text"))
    return quality.with_verdict(stats).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.BpeOperator(spark, WORD_VOCABULARY).round_trip(docs).drop("text")
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_shard_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_records(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op4_pack_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(BYTE_VOCABULARY, encoding="utf-8") as f:
        pieces = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), f.read())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_simhash_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = imatch.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    near = {"near_edited": imatch.likeness(F.col("parts"), F.col("edited_parts")), "near_next": imatch.likeness(F.col("parts"), F.col("next_parts"))}
    return found.select("doc_id", "n_chars", "edited_sha256", F.array_join("parts", "").alias("fingerprint"), F.array_join("edited_parts", "").alias("edited_fingerprint"), *[v.alias(k) for k, v in near.items()])


def op8_chat_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as bigint) conv_id", "cast(turn as bigint) turn", "role", "text")
    hard = chat.STOP + chat.START + "assistant ok"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return chat.digest(chat.format_conversations(told.unionByName(more)))


def op9_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return linededup.drop_boilerplate(docs).select("doc_id", "source", "text", "n_lines", "n_dropped")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0)
    model = langid.train(docs.where("NOT held_out").select("text", "lang"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op11_merkle_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names = ["doc_id", "source", "lang", "n_chars"]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = docs.select("doc_id", "source", merkle.digest([*map(F.col, names), F.col("text")]).alias("leaf"), F.when(tampered, merkle.digest([*map(F.col, names), lowered])).alias("tampered"))
    return merkle.build(leaves, "doc_id", "source", claimed="tampered").rows(claimed=True).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_mix_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op13_ranked_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_mcd, op2_bpe_roundtrip, op3_shard_slots, op4_pack_cost, op5_style_tree, op6_simhash_bytes, op7_imatch, op8_chat_grammar, op9_site_lines, op10_langid, op11_merkle_upper, op12_mix_entropy, op13_ranked_threshold)}

ORACLE_SQL: dict[str, str] = {
    "op8_chat_grammar": r"""
        WITH told AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
          UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
          sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
          CAST(sum(length(role) + 12 + 1 + 10 + 1 + length(regexp_replace(text, '<(~*n?)\|', '<~\1|', 'g'))) AS BIGINT) AS formatted_chars
        FROM told GROUP BY conv_id""",
    "op9_site_lines": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(source, '') AS host, text FROM documents),
        pages AS (SELECT host, coalesce(text, '') AS t, min(r) AS p FROM d GROUP BY 1, 2),
        totals AS (SELECT host, count(*) AS n FROM pages GROUP BY host),
        has AS (SELECT DISTINCT host, p, trim(unnest(string_split(t, chr(10))), E' \t\n\x0b\f\r') AS line FROM pages),
        bad AS (SELECT host, line FROM has JOIN totals USING (host) WHERE line <> '' GROUP BY host, line, n
                HAVING count(*) >= {linededup.MIN_PAGES} AND count(*) > n * {linededup.RATIO}),
        parts AS (SELECT r, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
        marked AS (SELECT r, part, i, bad.line IS NOT NULL AS gone FROM parts JOIN d USING (r)
                   LEFT JOIN bad ON bad.host = d.host AND bad.line = trim(part, E' \t\n\x0b\f\r')),
        joined AS (SELECT r, coalesce(string_agg(part, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text,
                     count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped FROM marked GROUP BY r)
        SELECT doc_id, source, joined.text AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
        FROM d LEFT JOIN joined USING (r)""",
    # CRC-32 of the id's digits bit by bit (-1: one shift); runs of 16 level by level, a node's path growing with each.
    "op11_merkle_upper": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, source, CASE WHEN doc_id IS NULL THEN '-' ELSE octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id END
            || CASE WHEN source IS NULL THEN '-' ELSE octet_length(encode(source)) || ':' || source END
            || CASE WHEN lang IS NULL THEN '-' ELSE octet_length(encode(lang)) || ':' || lang END
            || CASE WHEN n_chars IS NULL THEN '-' ELSE octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars END AS head, text,
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
            xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(doc_id::VARCHAR, '')])),
              lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END)) % 5 = 0 AS tampered FROM documents),
        leaves AS (
          SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
            CASE WHEN tampered THEN sha256(head || coalesce(octet_length(encode(low)) || ':' || low, '-')) END AS claimed FROM d),
        start AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
        up(k, source, pos, n, node) AS (
          SELECT 0, source, pos, n, leaf FROM start
          UNION ALL SELECT k + 1, source, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY k, source, pos // 16, n),
        subs AS (SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
        top(k, pos, n, node) AS (
          SELECT 0, pos, n, subroot FROM subs
          UNION ALL SELECT k + 1, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY k, pos // 16, n),
        around AS (
          SELECT k, source, pos, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
            coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM up WHERE n > 1 WINDOW w AS (PARTITION BY k, source, pos // 16 ORDER BY pos)),
        around_top AS (
          SELECT k, pos, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
            coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM top WHERE n > 1 WINDOW w AS (PARTITION BY k, pos // 16 ORDER BY pos)),
        walk(k, doc_id, source, leaf, pos, proof, folded) AS (
          SELECT 0, doc_id, source, leaf, pos, '', coalesce(claimed, leaf) FROM start
          UNION ALL SELECT w.k + 1, w.doc_id, w.source, w.leaf, w.pos // 16, w.proof || a.l || a.r, sha256(a.l || w.folded || a.r)
          FROM walk w JOIN around a ON a.k = w.k AND a.source IS NOT DISTINCT FROM w.source AND a.pos = w.pos),
        reached AS (SELECT w.*, s.subroot, s.pos AS place FROM walk w JOIN subs s ON s.source IS NOT DISTINCT FROM w.source
                    WHERE w.k = (SELECT max(k) FROM up WHERE up.source IS NOT DISTINCT FROM w.source)),
        over(k, doc_id, leaf, subroot, pos, proof, folded) AS (
          SELECT 0, doc_id, leaf, subroot, place, proof, folded FROM reached
          UNION ALL SELECT w.k + 1, w.doc_id, w.leaf, w.subroot, w.pos // 16, w.proof || a.l || a.r, sha256(a.l || w.folded || a.r)
          FROM over w JOIN around_top a ON a.k = w.k AND a.pos = w.pos)
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
        FROM over, (SELECT node AS root FROM top WHERE n = 1) WHERE k = (SELECT max(k) FROM top)""",
    "op13_ranked_threshold": r"""
        WITH t AS (
          SELECT 0 AS item, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
          UNION ALL SELECT 1, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) FROM benchmark),
        tfs AS (SELECT id AS doc_id, term, count(*) AS tf FROM t WHERE item = 0 GROUP BY ALL),
        lens AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY 1),
        total AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS l FROM lens),
        weight AS (SELECT term, floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, total GROUP BY term, big_n),
        scores AS (
          SELECT q.id AS item_id, d.doc_id, sum(q.repeats * w.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * big_n) // l))))::BIGINT AS score
          FROM (SELECT id, term, count(*) AS repeats FROM t WHERE item = 1 GROUP BY ALL) q JOIN tfs d USING (term) JOIN weight w USING (term) JOIN lens USING (doc_id), total GROUP BY 1, 2)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM scores WHERE score > 0 QUALIFY rank <= 10""",
}
