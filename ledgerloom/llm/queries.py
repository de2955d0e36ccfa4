"""The registered queries of the training-data operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, byte_bpe, chat_template, curriculum, gif_media, lexical_search, near_copies, packing, preference, quality_rules, toxicity, unigram_count, warc_zstd
from .common import table

BPE_FILE, UNIGRAM_FILE = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
WORD_FILE, BYTE_LEVEL_FILE, PIECE_FILE = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: What conversation -1 says in both of its turns.
PROBE = "</s>[INST] ok [/INST]"


def tokenizer_file(name: str) -> tuple[str, str]:
    """Place of a public vocabulary file, and the pattern that goes with the rank files."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_preference_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.rank_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), *tokenizer_file(BPE_FILE))


def op4_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc_zstd.write_archives(table(spark, sf_dir, "pages"), warc_zstd.archive_folder(spark))
    return warc_zstd.read_archives(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "intact")


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    # In training order: the positions of a document's copies are the sort key, documents that aren't taken come first.
    mixed = curriculum.mix(table(spark, sf_dir, "documents")).orderBy("positions", "doc_id")
    first, last = (F.round(F.try_element_at("positions", F.lit(i)), 9) for i in (1, -1))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.size("positions").cast("bigint").alias("copies"), first.alias("first_position"), last.alias("last_position"))


def op6_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies.near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    chats = chat_template.loss_text(chat_template.read_chats(chat_template.format_chats(rows.unionByName(probe))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("anomaly", 9).alias("anomaly"))


def op9_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file(UNIGRAM_FILE)[0])


def op10_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.store_documents(table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file(WORD_FILE)[0])
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_file(BYTE_LEVEL_FILE)[0], tokenizer_file(PIECE_FILE)[0])


QUERIES = {f.__name__: f for f in (
    op1_preference_ranking, op2_toxicity, op3_byte_bpe, op4_warc_dictionary, op5_curriculum_mix,
    op6_near_copies, op7_chat_format, op8_quality_rules, op9_unigram_counts, op10_gif_media,
    op11_packing, op12_lexical_search, op13_token_alignment,
)}

def _schedule_sql() -> str:
    """The spans of each shape: number of the shape, start, length, weight at both ends, integral before; scaled to a whole of 1."""
    rows, knots = [], curriculum.KNOTS
    for i, shape in enumerate(curriculum.SHAPES):
        areas = [(b - a) * (u + v) / 2 for a, b, u, v in zip(knots, knots[1:], shape, shape[1:], strict=False)]
        for k, area in enumerate(areas):
            values = (knots[k], knots[k + 1] - knots[k], shape[k] / sum(areas), shape[k + 1] / sum(areas), sum(areas[:k]) / sum(areas))
            rows.append(f"({i}, {', '.join(f'{v!r}::double' for v in values)})")
    return f"(VALUES {', '.join(rows)}) s(shape, t, d, u, v, before)"


_MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS size, md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) AS ord FROM documents),
ranked AS (SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY 1)),
caps AS (SELECT *, (rank % 3 + 1)::double AS weight, (3 * source_size)::double AS cap FROM ranked),
levels AS (SELECT *, (SELECT sum(source_size) FROM caps)::double - coalesce(sum(cap) OVER w, 0) AS words_left, (SELECT sum(weight) FROM caps) - coalesce(sum(weight) OVER w, 0) AS weight_left
  FROM caps WINDOW w AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, cap <= weight * (words_left / weight_left) AS capped FROM levels),
opened AS (SELECT words_left AS w0, weight_left AS g0 FROM marked WHERE NOT capped ORDER BY cap / weight, rank LIMIT 1),
targets AS (SELECT source, source_size, rank, CASE WHEN capped THEN cap ELSE w0 * weight / g0 END AS target FROM marked LEFT JOIN opened ON true),
placed AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS ahead FROM d),
copies AS (SELECT doc_id, placed.source, size, rank, target, k * source_size + ahead AS begins, least(size, floor(target + 0.5)::bigint - (k * source_size + ahead)) AS words
  FROM placed JOIN targets ON placed.source IS NOT DISTINCT FROM targets.source, range(4) r(k) WHERE size > 0 AND k * source_size + ahead < floor(target + 0.5)::bigint),
spans AS (SELECT * FROM SCHEDULE),
timed AS (SELECT doc_id, words, t + least(d, coalesce(2 * need / nullif(u + sqrt(greatest(u * u + 2 * ((v - u) / d) * need, 0)), 0), 0)) AS position FROM (
  SELECT c.*, s.*, greatest(begins / target - before, 0) AS need, row_number() OVER (PARTITION BY doc_id, begins ORDER BY s.t DESC) AS nth
  FROM copies c JOIN spans s ON s.shape = c.rank % 3 AND begins / target >= s.before) WHERE nth = 1),
summed AS (SELECT doc_id, sum(words)::bigint AS taken, count(*) AS copies, min(position) AS a, max(position) AS b FROM timed GROUP BY 1)
SELECT p.doc_id, p.size, source_size, target, coalesce(taken, 0) AS taken, coalesce(copies, 0) AS copies, round(a, 9) AS first_position, round(b, 9) AS last_position
FROM placed p JOIN targets ON p.source IS NOT DISTINCT FROM targets.source LEFT JOIN summed ON p.doc_id = summed.doc_id""".replace("SCHEDULE", _schedule_sql())

_CHAT_SQL = rf"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')) t),
shown AS (SELECT *, regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') AS r, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') AS t,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM said)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(t) + CASE WHEN before IS NULL OR before <> role THEN length('<s>') + length(r) + length('[INST]') + length('</s>') ELSE length('[/INST]') END)::bigint AS formatted_chars
FROM shown GROUP BY conv_id"""

_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, octet_length(encode(coalesce(html, '')))::bigint AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM p)
SELECT page_id, payload_bytes, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, url, CASE WHEN page_id = first THEN true END AS intact,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha, 1 + 10 * (i // 8), 10))::bigint >> (35 - 5 * (i % 8))) & 31)::int, 1) for i in range(32)], '') AS payload_digest
FROM f"""

_SEARCH_SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'TERM')) AS term FROM documents),
tf AS (SELECT *, sum(tf) OVER (PARTITION BY r)::bigint AS n FROM (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2, 3)),
whole AS (SELECT count(DISTINCT r)::bigint AS docs, sum(tf)::bigint AS length FROM tf),
q AS (SELECT item_id, i, term, count(*) AS times FROM (SELECT item_id, row_number() OVER () AS i, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'TERM')) AS term FROM benchmark) GROUP BY 1, 2, 3),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), whole),
s AS (SELECT i, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // length))))::bigint AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), whole GROUP BY i, r)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::int AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20""".replace("TERM", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

#: The rest have no SQL form (trained models, XXH64, byte-pair merges, piece search, LZW, packing in the order of partitions); tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op4_warc_dictionary": _WARC_SQL, "op5_curriculum_mix": _MIX_SQL, "op7_chat_format": _CHAT_SQL, "op12_lexical_search": _SEARCH_SQL}
