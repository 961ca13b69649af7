"""Registered queries of the training-data operators, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborist.llm.bpe import bpe_round_trip
from arborist.llm.brown import brown_scores
from arborist.llm.chat import rotate_perspectives
from arborist.llm.common import WORD, word_count
from arborist.llm.curriculum import curriculum_mix
from arborist.llm.exact_dedup import exact_dedup
from arborist.llm.jaccard import jaccard_join
from arborist.llm.quality import classify, held_out, quality_model
from arborist.llm.runs import periodic_runs
from arborist.llm.sharding import external_shuffle, record_bytes, write_shards
from arborist.llm.spelling import counted, letter_runs, spelling_variants
from arborist.llm.topk import exact_top_k
from arborist.llm.warc import archive_pages, read_records
from arborist.llm.wrappers import extract_main_text
from arborist.session import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join(docs, width=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


SQL_OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^ 	-
]+') AS w FROM documents),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM g),
t AS (SELECT doc_id, unnest(s) AS s FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM t a JOIN t b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2
"""


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    digests = bpe_round_trip(docs, ranks, public_tokenizers.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"))
    return digests.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived, normalised, and read back through the offset index."""
    folder = scratch(spark, "warc")
    index = archive_pages(table(spark, sf_dir, "pages"), folder)
    return read_records(index, f"{folder}/records", payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


SQL_OP3 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS keeper,
         list_aggregate(list_transform([1, 11, 21, 31], lambda k: translate(
           to_base(('0x' || h[k:k + 9])::BIGINT, 32, 8),
           '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')), 'string_agg', '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM d
"""


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 16 shards, written with their texts and read back; law: rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch(spark, "shards")
    write_shards(external_shuffle(docs), path)
    return spark.read.schema("doc_id LONG, text STRING, size LONG, slot LONG, shard INT").parquet(path).select(
        "doc_id",
        record_bytes(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hashed = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return exact_dedup(hashed, keep=["doc_id", "text_sha256"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL_OP5 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL_OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return classify(docs, model, keep=["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


def op8_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return curriculum_mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL_OP8 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, 'null')) AS k
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
caps AS (SELECT *, 3 * source_size AS cap, 3 * source_size / weight AS ratio, sum(source_size) OVER () AS total,
                sum(weight) OVER () AS all_weight FROM src),
rates AS (
  SELECT *, (total - coalesce(sum(cap) OVER before, 0)) / (all_weight - coalesce(sum(weight) OVER before, 0)) AS rate
  FROM caps WINDOW before AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
         least(cap::DOUBLE, max(CASE WHEN ratio >= rate THEN rate END) OVER () * weight) AS target FROM rates),
placed AS (
  SELECT s.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY k, s.doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE
         size * (whole + CASE WHEN start * 2 + size <= (target - whole * source_size) * 2 AND whole < 3 THEN 1 ELSE 0 END)
       END::BIGINT AS taken
FROM placed
"""


def op9_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's side; spans as text."""
    rows = rotate_perspectives(table(spark, sf_dir, "conversations"))
    spans = F.concat_ws(",", F.transform("mask", lambda s: F.concat_ws("-", s["begin"], s["end"])))
    return rows.select("conv_id", "speaker", "part", "n_turns", "rendered", spans.alias("mask"))


SQL_OP9 = """
WITH t AS (
  SELECT conv_id, coalesce(turn, 0) AS turn, coalesce(role, 'unknown') AS role,
         replace(coalesce(text, ''), '<|', '<' || chr(8203) || '|') AS text,
         floor(coalesce(turn, 0) / 256)::BIGINT AS part
  FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t),
p AS (
  SELECT t.conv_id, s.speaker, t.part, t.turn, t.role, t.text, t.role = s.speaker AS own,
         CASE WHEN t.role = s.speaker THEN '<|im_start|>assistant' || chr(10)
              ELSE '<|im_start|>user name=' || replace(replace(t.role, '<|', '<' || chr(8203) || '|'), chr(10), ' ') || chr(10) END AS head,
         t.text || '<|im_end|>' AS body
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
q AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker, part ORDER BY turn, role, text
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS begin_at
  FROM p)
SELECT conv_id, speaker, part, count(*) AS n_turns,
       string_agg(head || body, chr(10) ORDER BY turn, role, text) AS rendered,
       coalesce(string_agg(begin_at || '-' || (begin_at + length(body)), ',' ORDER BY turn, role, text) FILTER (own), '') AS mask
FROM q GROUP BY conv_id, speaker, part
"""



def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Every tenth text, by the checksum of its id, goes on periodically from a place on."""
    h = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(1))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    planted = docs.where((h % 10 == 0) & (word_count(F.col("text")) > 0))
    n, g = F.size("words"), F.floor(h / 10)
    parts = (
        planted.select("doc_id", words.alias("words"))
        .select("doc_id", "words", n.alias("n"), (g % n).cast("int").alias("a"), (3 + g % 8).cast("int").alias("d"))
        .select("*", (1 + F.floor((F.col("n") - F.col("a")) / F.col("d"))).cast("int").alias("p"))
    )
    rest = F.col("n") - F.col("a")
    again = F.array_repeat(F.slice("words", F.col("a") + 1, "p"), F.ceil(rest / F.col("p")).cast("int"))
    tail = F.slice(F.flatten(again), F.lit(1), rest)
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    others = docs.where(~((h % 10 == 0) & (word_count(F.col("text")) > 0)))
    return others.select("doc_id", "text").unionByName(parts.select("doc_id", text.alias("text")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))
    longest = F.expr("array_max(transform(runs, r -> struct(r.length, -r.start AS s, -r.period AS p)))")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (
        periodic_runs(docs)
        .withColumn("longest", longest)
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            (-F.col("longest.s")).alias("start"),
            F.col("longest.length").alias("length"),
            (-F.col("longest.p")).alias("period"),
            F.floor(1000 * F.col("longest.length") / -F.col("longest.p")).alias("exponent_milli"),
            F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
            F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )


#: CRC-32 of the bytes of a short ASCII string, by its table of remainders.
SQL_CRC32 = """crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t)"""


def sql_crc32(blob: str) -> str:
    """Unsigned CRC-32 of a blob expression, where `crc` of SQL_CRC32 is joined."""
    byte = f"('0x' || substr(hex({blob}), 2 * k + 1, 2))::BIGINT"
    return f"xor(4294967295, list_reduce(range(octet_length({blob})), lambda c, k: xor(c >> 8, t[xor(c & 255, {byte}) + 1]), 4294967295))"


SQL_OP11 = f"""
WITH {SQL_CRC32},
d AS (
  SELECT doc_id, {sql_crc32("coalesce(doc_id::VARCHAR, '')::BLOB")} AS h,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w0 FROM documents, crc),
a AS (SELECT *, len(w0) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w0) > 0 THEN (h // 10) % len(w0) ELSE len(w0) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
w AS (SELECT doc_id, n, list_transform(range(n), lambda i: w0[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) AS w FROM p),
t AS (SELECT doc_id, n, unnest(w) AS w, unnest(range(n)) AS i FROM w),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND y.i - x.i <= x.n // 2),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
r0 AS (SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM s GROUP BY doc_id, q, island HAVING count(*) >= greatest(q, 12 - q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM r0 GROUP BY 1, 2, 3),
lines AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS l,
                 arg_max(struct_pack(s := start, l := length, p := period), [length, -start, -period]) AS b FROM r GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT t.doc_id, string_agg(t.w, ' ' ORDER BY t.i) AS k FROM t ANTI JOIN gone ON t.doc_id = gone.doc_id AND t.i = gone.i GROUP BY 1)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.p AS period, 1000 * b.l // b.p AS exponent_milli,
       sha256(coalesce(l, '')) AS runs_sha256, sha256(coalesce(k, '')) AS collapsed_sha256
FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


SHORTEST_WORD = 7


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    runs = docs.select("doc_id", F.explode(letter_runs(F.col("text"), SHORTEST_WORD)).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run"))
    hit = runs.select("run", h.alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = counted(hit, F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")))
    words = words.where((F.char_length("word") >= SHORTEST_WORD) & (F.col("n") >= 2))
    return spelling_variants(words).select("word", "n", "n_near", "form", "form_n", "root")


SQL_OP12 = f"""
WITH RECURSIVE {SQL_CRC32},
d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
u AS (SELECT doc_id, run, count(*) AS m FROM d WHERE length(run) >= 7 GROUP BY 1, 2),
h AS (SELECT run, m, {sql_crc32("encode(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM u, crc),
c AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, m FROM h),
w AS (SELECT word, sum(m)::BIGINT AS n FROM c WHERE length(word) >= 7 GROUP BY 1 HAVING sum(m) >= 2),
x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
k AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM x),
p AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM k a JOIN k b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT k.word, w.word, w.n FROM k JOIN w ON k.rest = w.word
  UNION SELECT w.word, k.word, k.n FROM k JOIN w ON k.rest = w.word),
g AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM p GROUP BY 1),
b AS (SELECT p.word, min(near) AS near, near_n FROM p JOIN g ON p.word = g.word AND p.near_n = g.top GROUP BY p.word, near_n),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form,
         CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n
  FROM w LEFT JOIN g USING (word) LEFT JOIN b USING (word)),
r AS (SELECT word, word AS at, form AS onward FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON r.onward = f.word)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, r.at AS root FROM f JOIN r ON r.word = f.word AND r.onward IS NULL
"""


def op13_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    scored = brown_scores(docs, learn=~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


# What SQL can tell of the operators that it can't express.


def bpe_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the bytes that every document's token ids decode to."""
    return op2_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


SQL_BPE_DECODED = "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents"


def sharding_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of the shards, with how many shards have them and whether their slots are gapless."""
    shards = (
        op4_sharding(spark, sf_dir)
        .groupBy("shard")
        .agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("slot").alias("slots"), F.min("slot").alias("least"), F.max("slot").alias("most"))
    )
    gapless = (F.col("slots") == F.col("rows")) & (F.col("least") == 0) & (F.col("most") == F.col("rows") - 1)
    return shards.groupBy("rows").agg(F.count(F.lit(1)).alias("shards"), F.bool_and(gapless).alias("gapless"))


SQL_SHARDING_LAW = """
SELECT n // 16 + extra AS rows, CASE WHEN extra = 1 THEN n % 16 ELSE 16 - n % 16 END AS shards, true AS gapless
FROM (SELECT count(*) AS n FROM documents) c, (VALUES (0), (1)) e(extra) WHERE extra = 0 OR n % 16 > 0
"""


def sharding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document once, with its size."""
    return op4_sharding(spark, sf_dir).select("doc_id", "size", "law", "grown_shard", ((F.col("shard") >= 0) & (F.col("shard") < 16)).alias("within"))


SQL_SHARDING_ROWS = """
SELECT doc_id, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size, 'rows' AS law, CAST(NULL AS INTEGER) AS grown_shard, true AS within FROM documents
"""


def quality_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document once: whether it was held out, and whether score and prediction agree."""
    scored = op7_quality(spark, sf_dir)
    agree = (F.col("predicted") == (F.col("score") >= 0.5).cast("int")) & F.col("score").between(0, 1)
    return scored.select("doc_id", "held_out", agree.alias("agree"))


SQL_QUALITY_BOUNDS = f"""
WITH {SQL_CRC32}
SELECT doc_id, {sql_crc32("coalesce(doc_id::VARCHAR, '')::BLOB")} % 3 = 1 AS held_out, true AS agree FROM documents, crc
"""


def brown_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the class model's scores stand on: counts of tokens, and the scores by word frequencies."""
    return op13_brown_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


SQL_BROWN_BASE = f"""
WITH {SQL_CRC32},
d AS (
  SELECT doc_id, {sql_crc32("coalesce(doc_id::VARCHAR, '')::BLOB")} % 10 = 0 AS held_out,
         list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), '') AS w
  FROM documents, crc),
t AS (SELECT doc_id, held_out, unnest(w) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1),
n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT t.doc_id, t.held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(n.n)::BIGINT AS train_tokens,
       round(sum(log10((coalesce(c.c, 0) + 0.1::DOUBLE) / (n.n + 0.1::DOUBLE * (n.v + 1)))), 6) AS base_score
FROM t LEFT JOIN c USING (w), n GROUP BY 1, 2
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_bpe": op2_bpe,
    "op3_warc": op3_warc,
    "op4_sharding": op4_sharding,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_top_k": op6_top_k,
    "op7_quality": op7_quality,
    "op8_curriculum": op8_curriculum,
    "op9_chat_rotation": op9_chat_rotation,
    "op10_html_extraction": op10_html_extraction,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_brown_lm": op13_brown_lm,
    "bpe_decoded": bpe_decoded,
    "sharding_law": sharding_law,
    "sharding_rows": sharding_rows,
    "quality_bounds": quality_bounds,
    "brown_base": brown_base,
}
ORACLES: dict[str, str] = {
    "op1_jaccard_join": SQL_OP1,
    "op3_warc": SQL_OP3,
    "op5_exact_dedup": SQL_OP5,
    "op6_top_k": SQL_OP6,
    "op8_curriculum": SQL_OP8,
    "op9_chat_rotation": SQL_OP9,
    "op11_periodic_runs": SQL_OP11,
    "op12_spelling_variants": SQL_OP12,
    "bpe_decoded": SQL_BPE_DECODED,
    "sharding_law": SQL_SHARDING_LAW,
    "sharding_rows": SQL_SHARDING_ROWS,
    "quality_bounds": SQL_QUALITY_BOUNDS,
    "brown_base": SQL_BROWN_BASE,
}
