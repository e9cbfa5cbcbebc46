"""One query per operator over its whole table, with production parameters, and the SQL of those that have one."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import collocations, exactdedup, extract, langid, linedup, mixing, neighbours, packing, quality, ranked, simhash, sketches, viterbi
from weft.llm.common import id_crc32, table

#: Folder of the public vocabulary files; a parameter of every query that needs one.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")

QUALITY_FOLDS, QUALITY_HELD = 4, 2
LANG_FOLDS, LANG_HELD = 5, 0
MIX = {"max_repeats": 2.0, "target_entropy": 0.999}


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels of the fold that is held out are never read."""
    docs = table(spark, sf_dir, "documents")
    held = F.pmod(id_crc32(), F.lit(QUALITY_FOLDS)) == QUALITY_HELD
    labels = table(spark, sf_dir, "labels").where(~held)
    scored = quality.score_documents(docs, quality.train(docs, labels))
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.edit_fingerprints(table(spark, sf_dir, "documents"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all others."""
    base = table(spark, sf_dir, "embeddings")
    return neighbours.search(base, base.where("vec_id % 20 = 0"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; the fold that is held out is never learned from."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(id_crc32(), F.lit(LANG_FOLDS)) == LANG_HELD, F.lit(False))
    found = langid.identify(docs, langid.train(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_packing(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), f"{tokenizers}/word_bpe_49k.json")


def op7_token_counts(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return viterbi.count_tokens(table(spark, sf_dir, "documents"), f"{tokenizers}/piece_bpe_32k.model")


def op8_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = linedup.drop_boilerplate(table(spark, sf_dir, "documents"), copies_vote=False)
    return clean.select("doc_id", "source", "text", F.length("text").cast("bigint").alias("n_chars"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), **MIX)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of each language."""
    found = collocations.collocations(table(spark, sf_dir, "documents"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item among all."""
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exactdedup.duplicate_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_fingerprints, op3_neighbours, op4_simhash, op5_language, op6_packing, op7_token_counts, op8_extraction, op9_line_dedup, op10_mixing,
        op11_collocations, op12_ranked, op13_exact_dedup,
    )
}

LINE_DEDUP_SQL = f"""
WITH pages AS (SELECT DISTINCT source, text FROM documents), lines AS (
  SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM pages
), totals AS (SELECT source, count(*) AS total FROM pages GROUP BY source),
bad AS (
  SELECT l.source, l.line FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
  WHERE trim(l.line) <> '' GROUP BY l.source, l.line
  HAVING count(*) >= {linedup.MIN_PAGES} AND count(*) / any_value(t.total) > {linedup.RATIO}
), lists AS (SELECT source, list(line) AS bad FROM bad GROUP BY source)
SELECT d.doc_id, d.source,
  CASE WHEN b.bad IS NULL THEN d.text
       ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(b.bad, x)), chr(10)) END AS text,
  length(CASE WHEN b.bad IS NULL THEN d.text
       ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(b.bad, x)), chr(10)) END) AS n_chars
FROM documents d LEFT JOIN lists b ON d.source IS NOT DISTINCT FROM b.source
"""

MIXING_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) + 1 AS BIGINT) AS tokens
  FROM documents
), totals AS (SELECT source, count(*) AS docs, CAST(sum(tokens) AS BIGINT) AS total FROM d GROUP BY source),
g AS (SELECT count(*) AS n, sum(total) AS t, min(total) AS low, max(total) AS high FROM totals),
grid AS (
  SELECT i, sum(exp(ln(total::DOUBLE / t) * i / {mixing.STEPS}.0)) AS z,
         sum(exp(ln(total::DOUBLE / t) * i / {mixing.STEPS}.0) * ln(total::DOUBLE / t)) AS wp
  FROM totals, g, range(0, {mixing.STEPS + 1}) r(i) GROUP BY i
), tau AS (
  SELECT least({mixing.STEPS}, coalesce(min(i) FILTER (WHERE pow(high::DOUBLE / low, 1 - i / {mixing.STEPS}.0) <= {MIX["max_repeats"]}
    AND (n = 1 OR (ln(z) - i / {mixing.STEPS}.0 * wp / z) / ln(n) <= {MIX["target_entropy"]})), {mixing.STEPS})) AS i
  FROM grid, g
), plan AS (
  SELECT source, docs, total,
    CAST((total // 1000000) * m + ((total % 1000000) * m) // 1000000 AS BIGINT) AS budget
  FROM (SELECT totals.*, greatest(CAST(round(pow(total::DOUBLE / high, i / {mixing.STEPS}.0) / (total::DOUBLE / high) * 1000000) AS BIGINT), 1000000) AS m
        FROM totals, g, tau)
), steps AS (SELECT greatest(1, CAST(sum(budget) AS BIGINT) // {mixing.STEP_TOKENS}) AS n FROM plan),
each AS (
  SELECT doc_id, d.source, tokens, docs, total, budget, epoch,
    CAST('0x' || substr(md5(concat(epoch, ':', coalesce(CAST(doc_id AS VARCHAR), 'null'))), 1, 8) AS BIGINT) AS place
  FROM d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source, LATERAL unnest(range(0, (budget - 1) // total + 1)) u(epoch)
), placed AS (
  SELECT *, epoch * total + coalesce(sum(tokens) OVER (PARTITION BY source, epoch ORDER BY place, doc_id, tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position FROM each
)
SELECT doc_id, source, CAST(epoch AS INTEGER) AS epoch, tokens, CAST(position AS BIGINT) AS position,
  CAST(floor(CAST(position AS DOUBLE) / CAST(budget AS DOUBLE) * steps.n) AS BIGINT) AS step
FROM placed, steps WHERE position < budget
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

COLLOCATIONS_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), spoken AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS words FROM pieces
), totals AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM spoken GROUP BY lang),
grams AS (
  SELECT lang, size, array_to_string(words[i:i + size - 1], ' ') AS phrase
  FROM spoken, LATERAL unnest(range(1, {collocations.LONGEST + 1})) s(size), LATERAL unnest(range(1, len(words) - size + 2)) p(i)
), f AS (
  SELECT lang, phrase, any_value(size) AS size, count(*) AS n FROM grams GROUP BY lang, phrase HAVING count(*) >= {collocations.MIN_COUNT}
), staying AS (
  SELECT f.* FROM f WHERE size > 1 AND NOT EXISTS (
    SELECT 1 FROM f g WHERE g.lang = f.lang AND g.size > f.size AND contains(' ' || g.phrase || ' ', ' ' || f.phrase || ' ')
      AND 100 * g.n >= {collocations.CONTAINED_PERCENT} * f.n)
), cuts AS (
  SELECT lang, phrase, n AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail
  FROM staying, LATERAL unnest(range(1, size)) c(k)
), scores AS (
  SELECT c.*, l.n AS l, r.n AS r, t.n AS n,
    CAST((1000::HUGEINT * a * t.n) // (l.n::HUGEINT * r.n) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = head JOIN f r ON r.lang = c.lang AND r.phrase = tail JOIN totals t ON t.lang = c.lang
), worst AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM worst QUALIFY rank <= {collocations.TOP}
"""

RANKED_SQL = f"""
WITH terms AS (
  SELECT doc_id, row, unnest(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS row FROM documents)
), lengths AS (SELECT row, any_value(doc_id) AS doc_id, count(*) AS n FROM terms GROUP BY row),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
tfs AS (SELECT row, term, count(*) AS tf FROM terms GROUP BY row, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY term, docs
), wanted AS (
  SELECT item_id, unnest(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
), queries AS (SELECT item_id, term, count(*) AS q FROM wanted GROUP BY item_id, term),
scores AS (
  SELECT item_id, row, any_value(l.doc_id) AS doc_id,
    CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * l.n * docs) // terms)))) AS BIGINT) AS score
  FROM queries JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths l USING (row), totals GROUP BY item_id, row
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= {ranked.TOP}
"""

EXACT_DEDUP_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

ORACLE = {
    "op9_line_dedup": LINE_DEDUP_SQL,
    "op10_mixing": MIXING_SQL,
    "op11_collocations": COLLOCATIONS_SQL,
    "op12_ranked": RANKED_SQL,
    "op13_exact_dedup": EXACT_DEDUP_SQL,
}
