"""The registered queries of this subpackage: ``QUERIES`` and ``ORACLE``.

Each ``opN_<name>`` reads its whole tables, calls its operator with production
parameters and derives the digest columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_quality_rules")
def op1_quality_rules(spark, sf_dir):
    from marketflow.llm.quality import quality_rules
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = quality_rules(docs, table(spark, sf_dir, "labels"))
    return got.select(F.col("__row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", "kept", "llr")


@register("op2_histogram_shards")
def op2_histogram_shards(spark, sf_dir):
    from marketflow.llm.shards import histogram_shards
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    got = histogram_shards(docs, F.octet_length(F.coalesce("text", F.lit(""))) + 1, 8,
                           carry=[F.col("doc_id"), F.crc32(text).alias("text_crc32")])
    return got.select(F.col("__row.doc_id").alias("doc_id"), "size", F.col("__row.text_crc32").alias("text_crc32"),
                      F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register("op3_simhash_groups")
def op3_simhash_groups(spark, sf_dir):
    from marketflow.llm.simhash import near_duplicates
    got = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return got.select(F.col("__row.doc_id").alias("doc_id"),
                      F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op4_mix_sources")
def op4_mix_sources(spark, sf_dir):
    from marketflow.llm.mixing import mix_sources
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    got = mix_sources(docs, carry=["doc_id", "source"])
    return got.select(F.col("__row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken",
                      F.col("__row.source").alias("source"), "copies")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '" + _UPPER + "', '" + _LOWER + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@register("op5_decontaminate", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i : i + least(len(w), 10) - 1] AS g
       FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n, s, w[s : s + n - 1] AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
m AS (SELECT dw.r, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM m) GROUP BY r),
it AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN it USING (r)""")
def op5_decontaminate(spark, sf_dir):
    from marketflow.llm.decontam import contamination
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), carry=["doc_id"])
    return got.select(F.col("__row.doc_id").alias("doc_id"), "n_words", "n_hit",
                      F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@register("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    from marketflow.llm.toxicity import id_fold, toxicity
    got = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), carry=["doc_id"])
    return got.select(F.col("__row.doc_id").alias("doc_id"),
                      F.coalesce(id_fold(F.col("__row.doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "clauses")


@register("op9_personal_data")
def op9_personal_data(spark, sf_dir):
    from marketflow.llm.pii import KINDS, personal_data
    got = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return got.select(F.col("__row.doc_id").alias("doc_id"), *[F.col(f"pii.n_{k}").alias(f"n_{k}") for k in KINDS],
                      F.sha2(F.col("pii.base"), 256).alias("base_sha256"), F.col("pii.spans").alias("spans"))


@register("op7_recurring_lines")
def op7_recurring_lines(spark, sf_dir):
    from marketflow.llm.lines import recurring_lines
    got = recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return got.select(F.col("__row.doc_id").alias("doc_id"), "n_lines", F.size("dropped").cast("long").alias("n_dropped"),
                      F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"))


@register("op8_repeated_passages")
def op8_repeated_passages(spark, sf_dir):
    from marketflow.llm.passages import repeated_passages
    return repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op10_license_scan")
def op10_license_scan(spark, sf_dir):
    from marketflow.llm.licenses import scan_licenses
    got = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return got.select(F.col("__row.doc_id").alias("doc_id"), F.size("licenses").cast("long").alias("n_licenses"),
                      F.array_join(F.transform("licenses", lambda x: x["license"]), ",").alias("licenses"))


_DRAWS = ", ".join(f"('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), {1 + 8 * i}, 8))::BIGINT AS h{i + 1}" for i in range(4))


@register("op12_fill_in_middle", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, {_DRAWS} FROM documents),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
           WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
FROM p""")
def op12_fill_in_middle(spark, sf_dir):
    from marketflow.llm.fim import fill_in_middle, restored
    got = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return got.select(F.col("__row.doc_id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
                      F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@register("op11_quality_classifier")
def op11_quality_classifier(spark, sf_dir):
    from marketflow.llm.boosted import FOLDS, TEST_FOLD, classify
    from marketflow.llm.toxicity import id_fold
    got = classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), carry=["doc_id"])
    return got.select(F.col("__row.doc_id").alias("doc_id"),
                      F.coalesce(id_fold(F.col("__row.doc_id"), FOLDS) == TEST_FOLD, F.lit(False)).alias("held_out"), "score", "predicted")


_REPAIR_SQL = r"""
WITH RECURSIVE
k AS (SELECT row_number() OVER () AS id, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
crc AS (SELECT *, xor(4294967295::BIGINT, list_reduce(
          list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(key, ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
          lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384::BIGINT))) % 20 AS f FROM k),
damaged AS (SELECT id, conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
                   CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
            FROM crc, range(2) AS again(n) WHERE f <> 0 AND (n = 0 OR f = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), id) AS i,
                  regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM damaged),
marked AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                          WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
                  left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM placed),
free(st, nxt, name) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
legal(st, letter, nxt) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
before(st, mid, c, e, line) AS (SELECT st, st, 0, '', '' FROM free UNION ALL SELECT st, nxt, 5, 'I', name || ':' || chr(10) FROM free),
way(st, nxt, c, e, line, own, letter) AS (
    SELECT p.st, p.mid, p.c + 2, p.e || 'D', p.line, NULL::VARCHAR, NULL::VARCHAR FROM before p
    UNION ALL SELECT p.st, f.nxt, p.c + 1, p.e || 'R', p.line, f.name, NULL FROM before p JOIN free f ON f.st = p.mid
    UNION ALL SELECT p.st, l.nxt, p.c, p.e || 'K', p.line, NULL, l.letter FROM before p JOIN legal l ON l.st = p.mid),
dp(conv_id, i, st, best) AS (
    SELECT DISTINCT conv_id, 0::BIGINT, 0, {'c': 0::BIGINT, 'a': '', 't': ''} FROM conversations
    UNION ALL
    SELECT d.conv_id, d.i + 1, w.nxt, min({'c': d.best.c + w.c + CASE WHEN r.fault = 'truncated' AND right(w.e, 1) <> 'D' THEN 5 ELSE 0 END,
           'a': d.best.a || w.e, 't': d.best.t || w.line || CASE right(w.e, 1) WHEN 'D' THEN '' WHEN 'R' THEN w.own || ':' || r.text || chr(10)
                                                            ELSE r.role || ':' || r.text || chr(10) END})
    FROM dp d JOIN marked r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.i = d.i + 1
    JOIN way w ON w.st = d.st AND (right(w.e, 1) = 'D' OR r.fault NOT IN ('blank', 'duplicate')) AND (w.letter IS NULL OR w.letter = left(r.role, 1))
    GROUP BY d.conv_id, d.i, w.nxt),
closing(st, c, e, line) AS (VALUES (0, 0, '', ''), (1, 10, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (2, 5, 'I', 'assistant:' || chr(10)), (3, 0, '', '')),
n AS (SELECT c.conv_id, count(m.i) AS n, coalesce(max(m.turn) - min(m.turn) + 1 - count(DISTINCT m.turn), 0)::BIGINT AS gaps,
             count(*) FILTER (m.fault = 'blank') AS blank, count(*) FILTER (m.fault = 'duplicate') AS duplicate,
             count(*) FILTER (m.fault = 'truncated') AS truncated, count(*) FILTER (m.i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
      FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
last AS (SELECT n.conv_id, min({'c': best.c + z.c, 'a': best.a || z.e, 't': best.t || z.line}) AS best
         FROM n JOIN dp ON dp.conv_id IS NOT DISTINCT FROM n.conv_id AND dp.i = n.n JOIN closing z ON z.st = dp.st GROUP BY n.conv_id)
SELECT n.conv_id, gaps, blank, duplicate, truncated, illegal, best.c::BIGINT AS cost, best.a AS audit, sha256(left(best.t, greatest(length(best.t) - 1, 0))) AS repaired_sha256
FROM n JOIN last ON last.conv_id IS NOT DISTINCT FROM n.conv_id"""


@register("op13_repaired_conversations", _REPAIR_SQL)
def op13_repaired_conversations(spark, sf_dir):
    from marketflow.llm.turns import conversation_key, damage, digests, repair_conversations
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repair = repair_conversations(damage(turns))
    got = (turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("key", conversation_key(F.col("conv_id")))
           .join(repair.summary, "key", "left").join(digests(repair), "key", "left"))
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return got.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
