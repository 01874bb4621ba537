"""The corpus operators as queries over the given tables, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
    return out.select("doc_id", "n_lines", "n_removed", "text")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    text = F.coalesce("text", F.lit(""))
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )
    out = assign_shards(docs, shards=24, text_col="text_hash")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import fold_of
    from .toxicity import fit, labelled_sample, score

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").filter(fold_of(F.col("doc_id")) != 0)
    model = fit(labelled_sample(docs, labels))
    out = score(docs, model)
    return out.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination(docs, _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, identify
    from .shared import fold_of

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(fold_of(F.col("doc_id")) != 0))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .lm_scoring import score_documents
    from .sentencepiece_codec import read_model
    from .shared import fold_of

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = read_model(public_tokenizers.path("piece_bpe_32k.model"))
    out = score_documents(docs, model, fold_of(F.col("doc_id")) != 1)
    return out.select(
        "doc_id", (fold_of(F.col("doc_id")) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "mixture_score"
    )


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sentencepiece_codec import read_model
    from .token_output import read_documents, write_sequences

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    files = write_sequences(docs, read_model(public_tokenizers.path("byte_bpe_50k.json")), end_id=2)
    return read_documents(files, docs.schema["doc_id"].dataType)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    out = near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    out = judge(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"
    )


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sentencepiece_codec import digest_texts, read_model

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = digest_texts(docs, read_model(public_tokenizers.path("piece_bpe_32k.model")))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import fold, hex_text, leaf_hash, manifest, siblings_hash, tampered_text

    docs = _table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text")
    rows = docs.select("doc_id", "lang", leaf_hash(*fields, text).alias("leaf"), leaf_hash(*fields, tampered_text(F.col("doc_id"), text)).alias("changed"))
    # most rows are as they were, and need no second digest
    rows = rows.withColumn("changed", F.when(F.col("changed") != F.col("leaf"), F.col("changed")))
    out = manifest(rows, "leaf", "lang", "doc_id")
    folded = fold(hex_text(F.coalesce("changed", "leaf")), F.col("path"))
    out = out.select(
        "doc_id", hex_text(F.col("leaf")).alias("leaf"), "subroot", "root", siblings_hash(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import digest_texts
    from .sentencepiece_codec import read_model

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = digest_texts(docs, read_model(public_tokenizers.path("byte_bpe_50k.json")))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import compress

    out = compress(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_language_id,
        op3_lm_scoring,
        op4_token_output,
        op5_sharding,
        op6_toxicity,
        op7_decontamination,
        op8_simhash,
        op9_quality_rules,
        op10_sentencepiece,
        op11_merkle_manifest,
        op12_bpe,
        op13_vector_codes,
    )
}

def _vector_codes_sql() -> str:
    """All entries compared, for vectors of 64 components: parts of four."""
    nearest = "(SELECT p.id, p.part, min((power(p.a - e.a, 2) + power(p.b - e.b, 2) + power(p.c - e.c, 2) + power(p.d - e.d, 2))::BIGINT * 64 + entry) AS best FROM p JOIN {} e USING (part) GROUP BY p.id, p.part)"
    means = ", ".join(f"floor(sum({x})::DOUBLE / count(*))::BIGINT AS {x}" for x in "abcd")
    taken = ", ".join(f"coalesce(u.{x}, c.{x}) AS {x}" for x in "abcd")
    update = "(SELECT c.part, c.entry, {} FROM {} c LEFT JOIN (SELECT p.part, best % 64 AS entry, {} FROM p JOIN {} m USING (id, part) GROUP BY 1, 2) u USING (part, entry))"
    rounds = ", ".join(f"m{k} AS {nearest.format(f'c{k}')}" + (f", c{k + 1} AS {update.format(taken, f'c{k}', means, f'm{k}')}" if k < 2 else "") for k in range(3))
    return f"""
WITH k AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
i AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM k),
p AS (SELECT id, part, v[4 * part + 1] AS a, v[4 * part + 2] AS b, v[4 * part + 3] AS c, v[4 * part + 4] AS d FROM i, (SELECT unnest(range(16)) AS part)),
c0 AS (SELECT part, id AS entry, a, b, c, d FROM p WHERE id < 64),
{rounds},
r AS (SELECT id, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM m2 GROUP BY id),
s AS (SELECT sha256(string_agg(concat_ws(',', a, b, c, d), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM i JOIN r USING (id), s
"""


ORACLES = {
    "op1_line_dedup": """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(ls) - 2)) AS pos, ls FROM d WHERE len(ls) >= 3),
v AS (SELECT doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] AS body FROM w),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS rn FROM v),
c AS (SELECT DISTINCT doc_id, pos + k AS pos FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE rn > 1),
l AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM d),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
        string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL) AS text
      FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM d LEFT JOIN k USING (doc_id)
""",
    "op7_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS body
       FROM (SELECT item, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS body
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
m AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw USING (n, body)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws)) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
""",
    "op9_quality_rules": r"""
WITH d AS (SELECT doc_id, source, text, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, text, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i:i + 2]) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE k > 1) GROUP BY doc_id),
l AS (SELECT doc_id, source, text, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS lw
      FROM (SELECT doc_id, source, text, unnest(string_split(t, chr(10))) AS line FROM d)),
n AS (SELECT doc_id, source, text, line, array_to_string(lw, ' ') AS norm, len(lw) AS k FROM l WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM n GROUP BY doc_id),
hosts AS (SELECT coalesce(source, chr(0)) AS host, greatest(floor((count(DISTINCT text) + CAST(count(*) > count(text) AS INTEGER)) * 0.05::DOUBLE), 5) AS most FROM documents GROUP BY 1),
freq AS (SELECT coalesce(source, chr(0)) AS host, norm FROM n JOIN hosts ON host = coalesce(source, chr(0)) GROUP BY 1, 2, most HAVING count(DISTINCT text) > most),
gone AS (SELECT doc_id, sum(k) AS removed_words FROM n JOIN freq ON freq.host = coalesce(source, chr(0)) AND freq.norm = n.norm GROUP BY doc_id),
s AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed_words >= 50 AND n_words - removed_words >= 0.5 * n_words AS kept FROM s
""",
    # the polynomial of crc32 is 3988292384
    "op11_merkle_manifest": r"""
WITH RECURSIVE crc AS (
  SELECT doc_id, xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::UBIGINT) AS k
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
f AS (
  SELECT d.doc_id, lang, text,
    coalesce(strlen(CAST(d.doc_id AS VARCHAR)) || ':' || d.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    CASE WHEN k % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS tampered
  FROM documents d LEFT JOIN crc USING (doc_id)),
leaves AS (
  SELECT doc_id, coalesce('+' || lang, '') AS g, leaf, changed, row_number() OVER (PARTITION BY coalesce('+' || lang, '') ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
          sha256(head || coalesce(strlen(tampered) || ':' || tampered, '-')) AS changed FROM f)),
tree AS (
  SELECT g, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM leaves
  UNION ALL
  SELECT g, any_value(lvl) + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM tree WHERE n > 1 GROUP BY g, pos // 8),
subroots AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS lvl, pos, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT any_value(lvl) + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM top WHERE n > 1 GROUP BY pos // 8),
nodes AS (
  SELECT g, lvl, pos, h, n, 0 AS stage FROM tree UNION ALL SELECT '', lvl, pos, h, n, 1 FROM top),
steps AS (
  SELECT a.stage, a.g, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.stage = b.stage AND a.g = b.g AND a.lvl = b.lvl AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL),
paths AS (
  SELECT x.g, x.pos, list({'l': l, 'r': r} ORDER BY stage, lvl) AS path FROM (
    SELECT v.g, v.pos, s.stage, s.lvl, s.l, s.r FROM leaves v JOIN steps s ON s.stage = 0 AND s.g = v.g AND s.pos = v.pos // (8 ** s.lvl)::BIGINT
    UNION ALL
    SELECT v.g, v.pos, s.stage, s.lvl, s.l, s.r FROM leaves v JOIN subroots u USING (g) JOIN steps s ON s.stage = 1 AND s.pos = u.pos // (8 ** s.lvl)::BIGINT) x GROUP BY 1, 2),
found AS (
  SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(list_reduce([''] || list_transform(path, lambda x: x.l || x.r), lambda a, b: a || b), '')) AS proof_sha256,
    (list_reduce([{'l': '', 'r': '', 'h': changed}] || list_transform(coalesce(path, []), lambda x: {'l': x.l, 'r': x.r, 'h': ''}),
      lambda a, b: {'l': '', 'r': '', 'h': sha256(b.l || a.h || b.r)})).h AS folded_root
  FROM leaves LEFT JOIN paths USING (g, pos) JOIN subroots USING (g))
SELECT *, folded_root = root AS verified FROM found
""",
    "op13_vector_codes": _vector_codes_sql(),
}
