"""One query for each text operator, over the whole of its table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklens.llm import (
    chat,
    credentials,
    decontaminate,
    fuzzy_lines,
    language,
    lexical,
    minhash,
    packing,
    phrases,
    pitman_yor,
    quality_rules,
    simhash,
    toxicity,
)
from stocklens.llm.shared import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(query):
    QUERIES[query.__name__] = query
    return query


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def remainder(modulus: int) -> Column:
    """crc32 of the doc_id as text, by which rows are held out."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@register
def op1_length_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"))


@register
def op2_chat_tokens(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.read_back(chat.formatted(turns.union(probe)))


# Lengths of role and text in the template: an escaped backslash and a parted control string are longer.
ESCAPED = (
    r"regexp_replace(replace({0}, '\', '\b'), "
    r"'(<)(\||/?s>|<?/?SYS>>|unk>|pad>|bos>|eos>|start_of_turn>|end_of_turn>)|(\[)(/?INST\])', '\1\3\\e\2\4', 'g')"
)
ORACLE["op2_chat_tokens"] = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)
), sums AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS all_text,
    coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS loss_text,
    length('<|begin|>') + sum(length('<|role|><|text|><|end|>') + length({ESCAPED.format("role")})
      + length({ESCAPED.format("text")})) AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(all_text) AS turns_sha256, length(loss_text) AS loss_chars,
  sha256(loss_text) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM sums"""


@register
def op3_pitman_yor_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", (remainder(7) != 2).alias("learned"))
    scored = pitman_yor.score(docs)
    rest = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return scored.select("doc_id", (remainder(7) == 2).alias("held_out"), *rest)


@register
def op4_fuzzy_lines(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = fuzzy_lines.without_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return cleaned.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_lines",
        "n_removed",
        F.length("cleaned").cast("bigint").alias("kept_chars"),
        sha256(F.col("cleaned")).alias("kept_sha256"),
    )


@register
def op5_credential_formats(spark: SparkSession, folder: str) -> DataFrame:
    found = credentials.secrets(table(spark, folder, "documents"))
    kinds = credentials.KINDS

    def text(spans: Column) -> Column:
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(parts, ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != kinds[3])
    counts = [number(kind) for kind in kinds]
    return found.select(
        "doc_id", *counts[:3], sha256(text(base)).alias("base_sha256"), text(F.col("spans")).alias("spans"), counts[3]
    )


@register
def op6_toxic_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").where(remainder(3) != 1)
    found = toxicity.detect(table(spark, folder, "documents"), labels)
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted")


WORDS = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents
)"""


@register
def op7_minhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), width=4, similarity=0.8)


ORACLE["op7_minhash_near_duplicates"] = (
    WORDS
    + """
, shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, 1))) AS i FROM words WHERE len(ws) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common c JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
  WHERE 100 * c.n >= 80 * (s.n + t.n - c.n)
), near AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.b AS component_id, r.b = d.doc_id AS kept
FROM documents d JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) r ON r.a = d.doc_id
LEFT JOIN sizes s ON s.doc_id = d.doc_id"""
)


@register
def op8_language_subwords(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language.identify(docs.select("doc_id", "text"), docs.where(remainder(5) != 0))
    doc_id = F.col("row.doc_id").alias("doc_id")
    return found.select(doc_id, "lang_pred", "score", "rejected").select(
        "doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score", "rejected"
    )


@register
def op9_benchmark_passages(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    n_hit = F.aggregate(
        F.transform("spans", lambda place, i: F.when(i % 2 == 0, -place).otherwise(place)),
        F.lit(0).cast("bigint"),
        lambda sofar, x: sofar + x,
    )
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        sha256(F.array_join("items", ",")).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLE["op9_benchmark_passages"] = """
WITH found AS (
  SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, doc_id, text FROM documents
  UNION ALL SELECT 'b', CAST(item_id AS VARCHAR), NULL, text FROM benchmark
), words AS (
  SELECT kind, id, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM found
), phrases AS (
  SELECT DISTINCT id, least(len(ws), 10) AS n, array_to_string(ws[i : i + 9], ' ') AS phrase
  FROM (SELECT id, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i FROM words WHERE kind = 'b' AND len(ws) > 0)
), places AS (
  SELECT w.doc_id, l.n, i, array_to_string(w.ws[i : i + l.n - 1], ' ') AS phrase
  FROM words w, (SELECT DISTINCT n FROM phrases) l, unnest(generate_series(1, len(w.ws) - l.n + 1)) AS u(i)
  WHERE w.kind = 'd' AND len(w.ws) >= l.n
), met AS (
  SELECT p.doc_id, p.i, p.n, f.id FROM places p JOIN phrases f ON f.n = p.n AND f.phrase = p.phrase
), hit AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM met, unnest(generate_series(0, n - 1)) AS u(j) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, id FROM met) GROUP BY doc_id
)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit h ON h.doc_id = w.doc_id LEFT JOIN items t ON t.doc_id = w.doc_id WHERE w.kind = 'd'"""


@register
def op10_quality_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality(table(spark, folder, "documents"))


ORACLE["op10_quality_cascade"] = """
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents
), runs AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS run
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM words WHERE len(ws) >= 8)
), again AS (
  SELECT doc_id, count(DISTINCT i + j) AS n
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS times FROM runs), unnest(generate_series(0, 7)) AS u(j)
  WHERE times > 1 GROUP BY doc_id
), counts AS (
  SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals, length(regexp_replace(text, '[^!]', '', 'g')) AS shouts
  FROM words w LEFT JOIN again ON again.doc_id = w.doc_id
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 30 * n_words OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)
    OR word_chars < 2 * n_words OR word_chars > 40 * n_words
    OR 100 * capitals > 50 * word_chars OR 100 * shouts > 50 * n_words) AS kept
FROM judged"""


@register
def op11_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id", "n_shingles")


@register
def op12_shared_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLE["op12_shared_lexical_search"] = """
WITH found AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), terms AS (
  SELECT kind, id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM found
), sizes AS (SELECT id, count(*) AS n FROM terms WHERE kind = 'd' GROUP BY id
), whole AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM sizes
), times AS (SELECT id, term, count(*) AS tf FROM terms WHERE kind = 'd' GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * max(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM times, whole GROUP BY term
), parts AS (
  SELECT t.id, t.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // l))) AS part
  FROM times t JOIN sizes s ON s.id = t.id JOIN weights v ON v.term = t.term, whole
), scores AS (
  SELECT i.id AS item_id, p.id AS doc_id, CAST(sum(part) AS BIGINT) AS score
  FROM (SELECT DISTINCT id, term FROM terms WHERE kind = 'b') i JOIN parts p ON p.term = i.term GROUP BY ALL
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank
  FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""


@register
def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


ORACLE["op13_phrase_collocations"] = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), places AS (SELECT lang, ws, unnest(generate_series(1, len(ws))) AS i FROM words
), counts AS MATERIALIZED (
  SELECT lang, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase, count(*) AS f
  FROM places, (VALUES (1), (2), (3), (4)) v(m) WHERE i + m - 1 <= len(ws) GROUP BY ALL
), totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE m = 1 GROUP BY lang
), candidates AS MATERIALIZED (
  SELECT lang, m, phrase, f, string_split(phrase, ' ') AS ws FROM counts WHERE m >= 2 AND f >= 30
), parts AS MATERIALIZED (
  SELECT lang, phrase, f AS a, k, array_to_string(ws[1 : k], ' ') AS first, array_to_string(ws[k + 1 : m], ' ') AS rest
  FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM candidates)
), cuts AS (
  SELECT p.lang, p.phrase, a, k, x.f AS l, y.f AS r, (CAST(2000000 AS HUGEINT) * a) // (x.f + y.f) AS score
  FROM parts p JOIN counts x ON x.lang = p.lang AND x.phrase = first JOIN counts y ON y.lang = p.lang AND y.phrase = rest
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS MATERIALIZED (
  SELECT lang, array_to_string(ws[i : i + m2 - 1], ' ') AS phrase, max(f) AS f
  FROM (SELECT *, unnest(generate_series(1, m - m2 + 1)) AS i FROM candidates, (VALUES (2), (3)) v(m2) WHERE m2 < m)
  GROUP BY ALL
), ranked AS (
  SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) AS rank, c.phrase, a, l, r, score
  FROM lowest c LEFT JOIN inside s ON s.lang = c.lang AND s.phrase = c.phrase WHERE s.f IS NULL OR 100 * s.f < 80 * a
)
SELECT k.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM ranked k JOIN totals t ON t.lang = k.lang WHERE rank <= 2000"""
