"""Registered queries ``opN_*``: thin steps from the given tables to the operators and back."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, extraction, fingerprints, language, neardup, packing, pieces, quality, resampling, scoring, sharding, tokens
from .common import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def as_articles(documents: DataFrame, *more: Column) -> DataFrame:
    """``documents`` as articles: doc_id is the url, text the content."""
    return documents.select(F.col("doc_id").alias("url"), F.col("text").alias("content"), *more)


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key's text; a null key has remainder 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")), F.lit(0)) % modulus


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language_model(documents: DataFrame) -> language.LanguageModel:
    """Learnt from the rows that are not held out."""
    return language.fit_language_model(as_articles(documents.where(remainder("doc_id", 3) != 1), F.col("lang").alias("language")))


@_query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    documents = _table(spark, sf_dir, "documents")
    found = language.identify_language(as_articles(documents), language_model(documents))
    return found.select(
        F.col("url").alias("doc_id"), (remainder("url", 3) == 1).alias("held_out"), F.col("language").alias("lang_pred"), "score", "bits"
    )


@_query
def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and base-line log10 probability of every document."""
    documents = _table(spark, sf_dir, "documents")
    model = scoring.fit_article_model(as_articles(documents.where(remainder("doc_id", 10) != 0)))
    return scoring.score_articles(as_articles(documents), model).select(
        F.col("url").alias("doc_id"), (remainder("url", 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score",
    )


@_query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return neardup.near_duplicates(as_articles(_table(spark, sf_dir, "documents"))).select(
        F.col("url").alias("doc_id"), "fingerprint", F.col("component").alias("component_id")
    )


def contamination(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Documents against the benchmark items."""
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("content"))
    return decontaminate.find_contamination(as_articles(documents), items)


@_query
def op3_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    return contamination(spark, _table(spark, sf_dir, "documents"), sf_dir).select(
        F.col("url").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


_WORDS_SQL = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    " '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
)
SQL["op3_contamination"] = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS size, array_to_string(list_slice(w, i, i + 12), ' ') AS piece
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
places AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM docs WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
pieces AS (
  SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS piece FROM places, sizes WHERE i + size - 1 <= len(w)),
found AS (SELECT p.doc_id, p.i, p.size, v.item FROM pieces p JOIN windows v ON p.size = v.size AND p.piece = v.piece),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS j FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
       sha256(coalesce(n.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN named n USING (doc_id)
"""


@_query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the byte-level tokenizer."""
    counted = tokens.count_tokens(as_articles(_table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select(F.col("url").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def packed(documents: DataFrame) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    pieces = packing.encode_pieces(as_articles(documents), public_tokenizers.path("word_bpe_49k.json"))
    narrow = pieces.select(F.col("url").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack_pieces(narrow).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("sequence").alias("sequence_id"), "offset")


@_query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into token sequences."""
    return packed(_table(spark, sf_dir, "documents"))


@_query
def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.fingerprint_revisions(as_articles(_table(spark, sf_dir, "documents"))).select(
        F.col("url").alias("doc_id"), "n_chars", F.col("revised_sha256").alias("edited_sha256"), "fingerprint",
        F.col("revised_fingerprint").alias("edited_fingerprint"), F.col("near_revised").alias("near_edited"), "near_next",
    )


@_query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal size."""
    return sharding.shard_articles(as_articles(_table(spark, sf_dir, "documents"))).select(
        F.col("url").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def quality_scores(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """(url, score), learnt from the labelled documents that are not held out."""
    measured = written(quality.article_statistics(as_articles(documents)), "article_statistics")
    labels = _table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2).select("doc_id", F.col("quality").alias("label"))
    labelled = measured.join(labels, F.col("url") == F.col("doc_id")).select("statistics", "label")
    return quality.score_quality(measured, quality.fit_quality_model(labelled))


@_query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality_scores(spark, _table(spark, sf_dir, "documents"), sf_dir).select(
        F.col("url").alias("doc_id"), (remainder("url", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@_query
def op4_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = _table(spark, sf_dir, "pages")
    network = extraction.fit_labeller(pages)
    return extraction.extract_content(pages, network, keys=("page_id", "url")).withColumnRenamed("content", "text")


# CRC-32 (reflected polynomial 0xEDB88320) of a text's UTF-8 bytes; ``crc`` has its table of 256 steps
_CRC_TABLE_SQL = (
    "crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8),"
    " lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS steps)"
)


def _crc_sql(text: str) -> str:
    digit = lambda at: f"(instr('0123456789ABCDEF', substr(hex({text}), {at}, 1)) - 1)"
    octets = f"list_transform(range(1, length(hex({text})), 2), lambda i: CAST(16 * {digit('CAST(i AS INT)')} + {digit('CAST(i AS INT) + 1')} AS BIGINT))"
    return f"xor(4294967295, list_reduce({octets}, lambda a, b: xor(crc.steps[(xor(a, b) & 255) + 1], a >> 8), 4294967295))"


@_query
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn so that their words are distributed like those of the benchmark."""
    news = as_articles(_table(spark, sf_dir, "documents"))
    drawn = resampling.resample_articles(news, _table(spark, sf_dir, "benchmark"))
    return drawn.select(F.col("url").alias("doc_id"), "n_features", "weight", "score", "rank")


SQL["op11_resampling"] = f"""
WITH {_CRC_TABLE_SQL},
docs AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
met AS (SELECT w, count(*) AS s FROM (SELECT unnest(w) AS w FROM docs) GROUP BY w),
wanted AS (SELECT w, count(*) AS t FROM (SELECT unnest({_WORDS_SQL}) AS w FROM benchmark) GROUP BY w),
words AS (SELECT w, coalesce(s, 0) AS s, coalesce(t, 0) AS t, {_crc_sql('w')} % 10000 AS bucket FROM (SELECT * FROM met FULL JOIN wanted USING (w)) m, crc),
buckets AS (SELECT bucket, sum(s) AS s, sum(t) AS t, sum(sum(s)) OVER () AS all_s, sum(sum(t)) OVER () AS all_t FROM words GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (all_s + 10000) AS DOUBLE) / CAST((s + 1) * (all_t + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM buckets),
weights AS (
  SELECT doc_id, sum(gain) AS weight FROM (SELECT doc_id, unnest(w) AS w FROM docs) d JOIN words USING (w) JOIN gains USING (bucket) GROUP BY doc_id),
noise AS (
  SELECT doc_id, len(w) AS n, list_reduce(list_transform(range(1, 9),
    lambda i: CAST(instr('0123456789abcdef', substr(sha256('2024:' || doc_id), CAST(i AS INT), 1)) - 1 AS BIGINT)), lambda a, b: 16 * a + b) AS h FROM docs),
scored AS (
  SELECT doc_id, n, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM noise LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (n >= 20) OVER () AS fit FROM scored)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score, CASE WHEN n >= 20 AND r <= 10 * fit // 100 THEN r END AS rank FROM ranked
"""


@_query
def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence pieces of every document, and what they decode to."""
    coded = pieces.encode_articles(as_articles(_table(spark, sf_dir, "documents")), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(F.col("url").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def damaged_turns(rows: DataFrame) -> DataFrame:
    """The turns that are left of ``conversations`` after the stated damage."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat_ws(":", text("conv_id"), text("turn"))) % 20
    left = rows.where(draw != 0).select(
        "conv_id", "turn", F.when(draw == 4, "user").otherwise(text("role")).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text")).alias("text"),
        F.explode(F.when(draw == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))),
    )
    return left.select(F.col("conv_id").alias("conversation"), "turn", "role", F.col("text").alias("content"))


@_query
def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations with their faults and the cheapest repair."""
    rows = _table(spark, sf_dir, "conversations")
    found = conversations.digest_conversations(conversations.repair_conversations(damaged_turns(rows)))
    every = rows.select("conv_id").distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(found, every["conv_id"].eqNullSafe(found["conversation"]), "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def _repair_sql() -> str:
    """The same repair as a walk over four places of a conversation: 1 begin, 2 behind system, 3 behind user, 4 behind assistant."""
    more = lambda x, cost, edit: f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{edit}'}}"
    best = lambda *xs: f"list_min([{', '.join(xs)}])"
    third = lambda p: best(f"{p}.p3", *(more(f"{p}.p{i}", 5, "I") for i in (1, 2, 4)))
    opened = "{{'p1': {p}.p1, 'p2': {p}.p2, 'p3': {third}, 'p4': {fourth}}}"
    with_user = lambda p: opened.format(p=p, third=third(p), fourth=f"{p}.p4")
    with_both = lambda p: opened.format(p=p, third=f"{p}.p3", fourth=best(f"{p}.p4", more(f"{p}.p3", 5, "I")))
    never = "{'c': 1000000000000, 'a': ''}"
    kept = lambda o, i: f"CASE WHEN x.del OR x.i <> '{i}' THEN {never} ELSE {more(o, 'x.stay', 'K')} END"
    given = lambda o: f"CASE WHEN x.del THEN {never} ELSE {more(o, '1 + x.stay', 'R')} END"
    gone = lambda o: more(o, 2, "D")
    read = (
        f"{{'p1': {gone('o.p1')}, 'p2': {best(gone('o.p2'), kept('o.p1', 's'))},"
        f" 'p3': {best(gone('o.p3'), *(f for n in (1, 2, 4) for f in (kept(f'o.p{n}', 'u'), given(f'o.p{n}'))))},"
        f" 'p4': {best(gone('o.p4'), kept('o.p3', 'a'), given('o.p3'))}}}"
    )
    return f"""
WITH RECURSIVE {_CRC_TABLE_SQL},
drawn AS (
  SELECT conv_id, turn, role, text, {_crc_sql("key")} % 20 AS d
  FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
          coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations) k, crc),
left_over AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) AS copy FROM drawn WHERE d <> 0)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS n FROM left_over),
judged AS (
  SELECT *, left(role, 1) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS closing,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM placed),
faults AS (
  SELECT *, CASE WHEN closing = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN closing NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM judged),
steps AS (SELECT conv_id, n, i, coalesce(fault, '') IN ('blank', 'duplicate') AS del, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS stay FROM faults),
walk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, {{'p1': {{'c': CAST(0 AS BIGINT), 'a': ''}}, 'p2': {never}, 'p3': {never}, 'p4': {never}}} AS p FROM steps
  UNION ALL
  SELECT conv_id, n, {read} AS p
  FROM (SELECT conv_id, n, i, del, stay, {with_both('q')} AS o
        FROM (SELECT x.conv_id, x.n, x.i, x.del, x.stay, {with_user('w.p')} AS q FROM walk w JOIN steps x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.n = w.n + 1)) x),
ends AS (
  SELECT conv_id, {best('o.p1', 'o.p4')} AS r FROM (
    SELECT conv_id, {with_both('q')} AS o FROM (
      SELECT conv_id, {with_user('p')} AS q FROM (SELECT *, max(n) OVER (PARTITION BY conv_id) AS latest FROM walk) WHERE n = latest))),
edits AS (
  SELECT conv_id, j, e, count(*) FILTER (e <> 'I') OVER w AS n, count(*) FILTER (e <> 'D') OVER w AS place
  FROM (SELECT conv_id, unnest(range(1, length(r.a) + 1)) AS j, substr(r.a, CAST(j AS INT), 1) AS e FROM ends) WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
told AS (
  SELECT e.conv_id, e.place, e.e, f.role, f.text,
    max(CASE WHEN e.place = 1 AND e.e = 'K' AND f.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS system
  FROM edits e LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.n = e.n AND e.e <> 'I' WHERE e.e <> 'D'),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY place) AS t
  FROM told GROUP BY conv_id),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT v.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(r.c, 0) AS BIGINT) AS cost, coalesce(r.a, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM v.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN texts x ON x.conv_id IS NOT DISTINCT FROM v.conv_id
"""


SQL["op13_conversations"] = _repair_sql()
