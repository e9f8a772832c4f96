"""Registered queries of the corpus operators, and their DuckDB twins.

Each query applies one operator, with production parameters, to its whole
table and derives the digest columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha(col) -> F.Column:
    """Lowercase hex of the SHA-256 of a string's UTF-8 (or of binary)."""
    return F.sha2(col, 256)


# ------------------------------------------------------------ 10 decontamination

@query
def op10_winnowing_decontamination(spark, sf_dir):
    from shelfrank.llm.decontaminate import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        sha(F.array_join(F.col("items").cast("array<string>"), ",")).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


ORACLE["op10_winnowing_decontamination"] = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM bw WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM bi),
ns AS (SELECT DISTINCT n FROM bg),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, ns WHERE len(w) >= n),
dg AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM di),
h AS (SELECT dg.doc_id, dg.p, bg.n, bg.item_id FROM dg JOIN bg ON dg.n = bg.n AND dg.g = bg.g),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
"""


# ----------------------------------------------------------- 7 substring dedup

@query
def op7_super_kmer_substring_dedup(spark, sf_dir):
    from shelfrank.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", sha("kept").alias("kept_sha256"))


ORACLE["op7_super_kmer_substring_dedup"] = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
di AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM dw WHERE len(w) >= 13),
g AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS x FROM di),
f AS (SELECT x, min(doc_id) AS first_id FROM g GROUP BY x HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM g JOIN f USING (x) WHERE doc_id > first_id),
ws AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS q FROM dw),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY q) AS k, count(*) AS n
    FROM ws ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(k, '')) AS kept_sha256
FROM dw LEFT JOIN kept USING (doc_id)
"""


# ------------------------------------------------------- 2 SimHash near-dedup

@query
def op2_simhash_anchor_dedup(spark, sf_dir):
    from shelfrank.llm.simhash_anchors import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"), shingle=3, distance=2).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ------------------------------------------------------ 1 BPE encode and decode

def word_bpe() -> str:
    """Where this machine keeps the public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_bpe_chunk_reuse(spark, sf_dir):
    from shelfrank.llm.bpe import encode

    return encode(table(spark, sf_dir, "documents"), word_bpe).select(
        F.col("id").alias("doc_id"), "n_tokens", sha("token_ids").alias("ids_sha256"),
        sha("decoded").alias("decoded_sha256"))


# --------------------------------------------------------- 3 fingerprints

@query
def op3_simhash_fingerprints(spark, sf_dir):
    from shelfrank.llm.fingerprints import fingerprint_pairs, hex_of, likeness

    return fingerprint_pairs(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", hex_of("hi", "lo").alias("fingerprint"),
        hex_of("edited_hi", "edited_lo").alias("edited_fingerprint"),
        likeness(("hi", "lo"), ("edited_hi", "edited_lo")).alias("near_edited"),
        likeness(("hi", "lo"), ("next_hi", "next_lo")).alias("near_next"))


# ------------------------------------------------------------ 8 quality

#: A document is of good quality from this score on.
QUALITY = 0.3


@query
def op8_subword_quality(spark, sf_dir):
    from shelfrank.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= QUALITY).cast("int").alias("predicted"))


# ------------------------------------------------------------ 5 toxicity

#: A document is toxic from this score on.
TOXIC = 0.5


@query
def op5_noisy_channel_toxicity(spark, sf_dir):
    from shelfrank.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


# ------------------------------------------------------------ 6 URL filters

def url_rules():
    """The rules of the contract, and the hosts that are blocked besides."""
    from shelfrank.llm.url_filter import Glob, Rule

    return ([Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
             Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")],
            [Glob("block", "*spam*"), Glob("block", "*pills*"), Glob("block", "*casino*")])


@query
def op6_shift_and_url_filter(spark, sf_dir):
    from shelfrank.llm.url_filter import url_filter

    return url_filter(table(spark, sf_dir, "pages"), *url_rules()).withColumnRenamed("id", "page_id")


ORACLE["op6_shift_and_url_filter"] = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id,
    translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM u),
r(verdict, h, q) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT page_id, max_by(h || q, length(h || q)) AS rule, max_by(r.verdict, length(h || q)) AS verdict
    FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id),
g AS (SELECT p.*, m.rule, m.verdict, CASE WHEN m.rule IS NOT NULL THEN NULL WHEN host LIKE '%spam%' THEN '*spam*'
    WHEN host LIKE '%pills%' THEN '*pills*' WHEN host LIKE '%casino%' THEN '*casino*' END AS pattern FROM p LEFT JOIN m USING (page_id))
SELECT page_id, host, path, rule, pattern, coalesce(verdict, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict FROM g
"""


# ---------------------------------------------------------- 9 chat formatting

@query
def op9_typed_chat_format(spark, sf_dir):
    from shelfrank.llm.chat import format_chats, read_loss, read_turns, text_parts

    said = "</s>[INST] ok [/INST]"
    cols = ["conv_id", "turn", "role", "text"]
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(*cols).union(extra).withColumn("parts", text_parts("text"))
    out = format_chats(turns).select("conv_id", F.length("formatted").cast("bigint").alias("formatted_chars"), read_turns().alias("turns"),
                                     F.array_join(read_loss(), "").alias("learned"))
    return out.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        sha(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"), sha("learned").alias("loss_sha256"), "formatted_chars")


ORACLE["op9_typed_chat_format"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned,
    sum(length(replace(replace(role, '<', '<.'), '|', '|.')) + length(replace(text, '<', '<.')) + 13) AS formatted_chars
    FROM t GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars,
    sha256(learned) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM c
"""


# ------------------------------------------------------- 4 HTML extraction

@query
def op4_tree_model_html(spark, sf_dir):
    from shelfrank.llm.html_extract import extract, train
    from shelfrank.llm.html_pages import labelled_pages

    return extract(table(spark, sf_dir, "pages"), train(labelled_pages())).select(
        F.col("id").alias("page_id"), "url", "text", F.length("text").cast("bigint").alias("n_chars"))


# ------------------------------------------------------- 11 curriculum mix

@query
def op11_curriculum_mix(spark, sf_dir):
    from shelfrank.llm.curriculum import mix

    first = F.try_element_at("copies", F.lit(1))["position"]
    return mix(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.round(first, 9).alias("position"))


def _position_sql(share: str) -> str:
    """The inverse of each weight's integrated schedule, as SQL."""
    from shelfrank.llm.curriculum import SCHEDULES, integral

    num = lambda x: f"CAST('{float(x)!r}' AS DOUBLE)"
    whens = []
    for weight, knots in SCHEDULES.items():
        for before, behind, time, length, r, s in integral(knots):
            y = f"(({share} - {num(before)}) / {num(length)})"
            x = f"{y} * 2 / ({num(r)} + sqrt(greatest({y} * {num(2 * (s - r))} + {num(r * r)}, 0)))"
            inside = f"AND {share} < {num(behind)}" if behind < integral(knots)[-1][1] else ""
            whens.append(f"WHEN weight = {weight} {inside} THEN {num(time)} + least(greatest({x}, 0), 1) * {num(length)}")
    return "CASE " + " ".join(whens) + " END"


ORACLE["op11_curriculum_mix"] = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS mark FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM s0),
s2 AS (SELECT *, sum(source_size) OVER () AS whole, 3 * source_size AS most, coalesce(sum(3 * source_size) OVER o, 0) AS held,
    sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS free FROM s1
    WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT coalesce(min(held) FILTER (most * free > weight * (whole - held)), 0) AS held,
    coalesce(max(free) FILTER (most * free > weight * (whole - held)), 0) AS free FROM s2),
t AS (SELECT source, source_size, weight, CASE WHEN most * lv.free > weight * (whole - lv.held)
    THEN CAST(weight AS DOUBLE) * CAST(whole - lv.held AS DOUBLE) / CAST(lv.free AS DOUBLE) ELSE CAST(most AS DOUBLE) END AS target FROM s2, lv),
p AS (SELECT doc_id, size, source_size, target, weight, CAST(floor(target + 0.5) AS BIGINT) AS goal,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY mark, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS before
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(greatest(least(goal - before, size), 0) + greatest(least(goal - before - source_size, size), 0)
    + greatest(least(goal - before - 2 * source_size, size), 0) AS BIGINT) AS taken,
    CASE WHEN least(goal - before, size) > 0 THEN round(""" + _position_sql("(CAST(before AS DOUBLE) / target)") + """, 9) END AS position
FROM p
"""


# -------------------------------------------------------- 12 spelling variants

#: One run in so many gets a typing error, by the contract.
DAMAGED = 199


@query
def op12_vgram_spelling(spark, sf_dir):
    from shelfrank.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"), one_in=DAMAGED)


# ------------------------------------------------------------ 13 filter audit

@query
def op13_truth_table_audit(spark, sf_dir):
    from shelfrank.llm.filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE["op13_truth_table_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS m FROM d),
l AS (SELECT doc_id, bool_or(quality IS NOT DISTINCT FROM 1) AS good, bool_or(toxic IS NOT DISTINCT FROM 1) AS bad FROM labels GROUP BY doc_id),
c AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (bad) AS n_bad FROM f LEFT JOIN l USING (doc_id) GROUP BY part, m),
x(f, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT x1.f || x2.f || x3.f || x4.f || x5.f AS filter_order, [x1.b, x2.b, x3.b, x4.b, x5.b] AS bits FROM x x1, x x2, x x3, x x4, x x5
    WHERE x1.b | x2.b | x3.b | x4.b | x5.b = 31),
s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, bits[k] AS b, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS INTEGER) AS gone FROM o, range(1, 6) r(k)),
g AS (SELECT part, filter_order, step, b, sum(CASE WHEN m & (gone | b) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN m & gone = 0 AND m & b > 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN m & gone > 0 AND m & b > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN m = b THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN m & gone = 0 AND m & b > 0 THEN n_good ELSE 0 END) AS good_lost,
    sum(CASE WHEN m & gone = 0 AND m & b > 0 THEN n_bad ELSE 0 END) AS toxic_lost FROM c, s GROUP BY part, filter_order, step, b)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, b) AS BIGINT) AS shapley FROM g
"""
