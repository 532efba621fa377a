"""The thin queries of this subpackage over the whole driver tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _crc(id_col: str):
    """crc32 of an id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    pieces = pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), _crc("doc_id") % 7 == 2)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents")).drop("row")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    hits = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, z: z - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit_profiles, identify

    docs = _table(spark, sf_dir, "documents").withColumn("held_out", _crc("doc_id") % 3 == 1)
    profiles = fit_profiles(docs.where("not held_out"))
    return identify(docs, profiles, ["doc_id", "held_out"])


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"), 8)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import work_path
    from .warc import assemble, page_of_column, read_warc, write_warc

    path = work_path(spark, "warc")
    write_warc(_table(spark, sf_dir, "pages"), path)
    captures = assemble(read_warc(spark, path, with_block=False))
    return captures.select(
        F.expr("try_cast(nullif(regexp_extract(cast(metadata.block as string), 'page_id: (-?[0-9]*)', 1), '') as long)").alias("page_id"),
        F.coalesce("capture.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.type").alias("record_type"),
        page_of_column(F.col("capture.refers_to")).alias("refers_to"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = _table(spark, sf_dir, "documents").withColumn("held_out", _crc("doc_id") % 5 == 0)
    model = fit(docs, _table(spark, sf_dir, "labels").where(_crc("doc_id") % 5 != 0))
    return score(docs, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import work_path
    from .token_orc import token_summary, write_tokens

    path = work_path(spark, "token-orc")
    write_tokens(_table(spark, sf_dir, "documents"), path, _tokenizer("byte_bpe_50k.json"))
    return token_summary(spark, path)


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_packing, op3_lm_scoring, op4_exact_dedup, op5_decontamination, op6_language_id, op7_sharding, op8_warc, op9_toxicity, op10_token_orc)}

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE_SQL = {
    "op1_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(words) - 3, 1) + 1), lambda i: array_to_string(words[i:i + 3], ' '))) END AS shingles FROM w),
        n AS (SELECT doc_id, len(shingles) AS n FROM s),
        e AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM pairs p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * common >= 80 * (x.n + y.n - common)),
        both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id, doc_id AS seen FROM n UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.seen)
        SELECT n.doc_id, n.n AS n_shingles, min(seen) AS component_id, n.doc_id = min(seen) AS kept FROM n JOIN reach r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n""",
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents),
        w AS (SELECT text_sha256, arg_min(doc_id, (-chars, doc_id)) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT d.doc_id, w.keep_id, w.group_size, d.doc_id = w.keep_id AS kept, d.text_sha256 FROM d JOIN w USING (text_sha256)""",
    "op5_decontamination": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_ALNUM}') AS words FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '{_ALNUM}') AS words FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(len(words), 10) AS n, unnest(list_transform(range(1, len(words) - least(len(words), 10) + 2), lambda i: array_to_string(words[i:i + least(len(words), 10) - 1], ' '))) AS gram FROM b WHERE len(words) > 0),
        pos AS (SELECT doc_id, n, unnest(range(1, len(words) - n + 2)) AS i, words FROM d, (SELECT DISTINCT n FROM win) WHERE len(words) >= n),
        hit AS (SELECT pos.doc_id, pos.i, win.n, win.item_id FROM pos JOIN win ON win.n = pos.n AND win.gram = array_to_string(pos.words[pos.i:pos.i + pos.n - 1], ' ')),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit), LATERAL (SELECT unnest(range(i, i + n)) AS p) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, len(d.words) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items, sha256(coalesce(m.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN named m ON m.doc_id = d.doc_id""",
    "op8_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
          array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(p.h, 1 + 5 * (i // 4), 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
          CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM p JOIN f ON f.h = p.h""",
}
