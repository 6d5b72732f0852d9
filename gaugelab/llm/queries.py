"""The registered queries: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugelab.llm import bpe, contamination, lm, near_text, near_vectors, periodic, pii, quality, repeats, spelling, token_counts, url_filter, warc
from gaugelab.llm.registry import ORACLES, QUERIES, query  # noqa: F401
from gaugelab.plans.bindings import table
from gaugelab.storage import run_folder, written


@query(
    "op10_benchmark_decontamination",
    """WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
    bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM bw),
    dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
    h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (n, k)),
    hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
    hi AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)""",
)
def _(spark, sf):
    found = contamination.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op5_bpe_automaton")
def _(spark, sf):
    return bpe.digests(table(spark, sf, "documents"))


@query("op8_token_counts")
def _(spark, sf):
    return token_counts.suffix_sums(token_counts.histogram(table(spark, sf, "documents")))


@query("op7_quality_classifier")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


@query("op4_pii_spans")
def _(spark, sf):
    return pii.report(table(spark, sf, "documents"))


# Five bits of the digest per letter, out of 20 bits at a time.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, {1 + 5 * (i // 4)}, 5) AS BIGINT) >> {15 - 5 * (i % 4)}) & 31 AS INTEGER), 1)" for i in range(32))


@query(
    "op1_warc_round_trip",
    f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
    f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
    bits AS (SELECT h, {_BASE32} AS d FROM f)
    SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN f USING (h) JOIN bits USING (h)""",
)
def _(spark, sf):
    folder = run_folder(spark, "archives")
    warc.write(table(spark, sf, "pages"), folder)
    records = written(warc.read(spark, folder, payload=False), "records")

    def page(column: str):
        return F.regexp_extract(column, "^urn:page:(-?[0-9]+):", 1).cast("long")

    return warc.resolved(records).select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        F.col("payload_sha1").alias("payload_digest"),
        "record_type",
        F.when(F.col("record_type") == "revisit", page("refers_to")).alias("refers_to"),
    )


@query("op6_embedding_near_duplicates")
def _(spark, sf):
    return near_vectors.near_duplicates(table(spark, sf, "embeddings"))


@query("op9_ngram_jaccard_join")
def _(spark, sf):
    return near_text.classes(table(spark, sf, "documents"))


@query("op3_language_model_scores")
def _(spark, sf):
    return lm.score(table(spark, sf, "documents"))


@query("op2_repeated_strings")
def _(spark, sf):
    found = repeats.removed(table(spark, sf, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query(
    "op12_url_filter",
    """WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
    p AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    f AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/' WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
      WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/' WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM p)
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM f""",
)
def _(spark, sf):
    return url_filter.judge(table(spark, sf, "pages"), url_filter.rule_table(spark))


@query("op13_spelling_variants")
def _(spark, sf):
    return spelling.variants(spelling.word_counts(table(spark, sf, "documents"), drop_every=31))


@query("op11_periodic_runs")
def _(spark, sf):
    return periodic.runs(periodic.with_periodic_tails(table(spark, sf, "documents"))).drop("runs")
