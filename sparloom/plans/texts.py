"""Queries over documents and pages: cleaning, chunks, tokens, bigrams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query, table
from ..sources.sharding import spread

CLEAN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
TOKENS = "SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM documents)"


def cleaned(spark, sf_dir, most=None):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), most)
    return docs.where(T.solid(F.col("text"))).select("doc_id", T.clean(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, {CLEAN} AS cleaned FROM documents WHERE {CLEAN} <> ''")
def clean_text(spark, sf_dir):
    return cleaned(spark, sf_dir)


@query(f"""SELECT doc_id, i AS chunk_idx, 'doc-' || doc_id || '-chunk-' || i AS chunk_id, substr(cleaned, i * 800 + 1, 1000) AS chunk
FROM (SELECT doc_id, {CLEAN} AS cleaned FROM documents) d,
  LATERAL (SELECT unnest(range(CASE WHEN length(cleaned) <= 1000 THEN 1 ELSE 1 + ceil((length(cleaned) - 1000) / 800.0)::BIGINT END)) AS i) WHERE cleaned <> ''""")
def chunk_chars(spark, sf_dir):
    out = T.chunk_chars(cleaned(spark, sf_dir), "cleaned")
    return out.select("doc_id", "chunk_idx", F.concat_ws("-", F.lit("doc"), "doc_id", F.lit("chunk"), "chunk_idx").alias("chunk_id"), "chunk")


@query(f"""SELECT doc_id, i AS chunk_idx, array_to_string(w[i * 128 + 1 : i * 128 + 160], ' ') AS chunk
FROM (SELECT doc_id, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '') AS w FROM documents) d,
  LATERAL (SELECT unnest(range(CASE WHEN len(w) <= 160 THEN 1 ELSE 1 + ceil((len(w) - 160) / 128.0)::BIGINT END)) AS i) WHERE len(w) > 0""")
def chunk_words(spark, sf_dir):
    return T.chunk_words(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 160, 32)


@query("""SELECT doc_id, unnest(range(len(p))) AS chunk_idx, unnest(p) AS chunk
FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS p FROM documents)""")
def chunk_delim(spark, sf_dir):
    return T.chunk_delimited(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


@query(f"""SELECT lang, count(*) AS docs, sum(n)::BIGINT AS chunks, sum(len)::BIGINT AS chars, round(avg(n), 6) AS avg_chunks FROM (
SELECT lang, length({CLEAN}) AS len, CASE WHEN length({CLEAN}) <= 1000 THEN 1 ELSE 1 + ceil((length({CLEAN}) - 1000) / 800.0)::BIGINT END AS n FROM documents WHERE {CLEAN} <> '') GROUP BY lang""")
def chunk_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", T.clean(F.col("text")).alias("c")).where("c <> ''")
    counted = docs.select("lang", F.length("c").alias("len"), T.steps(F.length("c"), 1000, 200).alias("n"))
    return counted.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n").alias("chunks"), F.sum("len").alias("chars"), F.round(F.avg("n"), 6).alias("avg_chunks"))


@query("""SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS body FROM pages""")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", T.html_text(F.col("html")).alias("body"))


@query(f"SELECT doc_id, tok, count(*) AS n FROM ({TOKENS}) GROUP BY doc_id, tok")
def token_counts(spark, sf_dir):
    return T.token_counts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"], "text").drop("first")


@query(f"SELECT tok, count(DISTINCT doc_id) AS df, count(*) AS cf FROM ({TOKENS}) GROUP BY tok")
def df_table(spark, sf_dir):
    counts = T.token_counts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"], "text")
    return counts.groupBy("tok").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))


@query("""SELECT count(*) AS docs, sum(n)::BIGINT AS tokens, max(n) AS longest, round(avg(n), 6) AS avg_len
FROM (SELECT len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS n FROM documents)""")
def doc_len_stats(spark, sf_dir):
    n = table(spark, sf_dir, "documents").select(F.size(T.tokens(F.col("text"))).cast("long").alias("n"))
    return n.agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"), F.max("n").alias("longest"), F.round(F.avg("n"), 6).alias("avg_len"))


@query(f"""SELECT doc_id, tok, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank
FROM (SELECT doc_id, tok, count(*) AS n, min(pos) AS first FROM ({TOKENS}) GROUP BY doc_id, tok)) WHERE rank <= 5""")
def top_terms_per_doc(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return T.top_terms(docs, ["doc_id"], "text", 5).select("doc_id", "tok", "n", "rank")


STOP = "'" + "', '".join("the and for that with from this have were which their about would there after before into when what where while whose them they been also than then because could should such these those your over under between during through being it is a an of to in on as by or at be are was if but".split()) + "'"


@query(f"""SELECT doc_id, tok, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank
FROM (SELECT *, max(CASE WHEN length(tok) >= 5 AND tok NOT IN ({STOP}) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS has FROM
 (SELECT doc_id, tok, count(*) AS n, min(pos) AS first FROM ({TOKENS}) WHERE length(tok) >= 4 GROUP BY doc_id, tok))
WHERE length(tok) >= 5 AND tok NOT IN ({STOP}) OR has = 0) WHERE rank <= 4""")
def keywords(spark, sf_dir):
    return T.keywords(table(spark, sf_dir, "documents"), ["doc_id"], "text").select("doc_id", "tok", "n", "rank")


FOCUS = r"array_to_string((string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '))[1:18], ' ')"


@query(f"SELECT doc_id, CASE WHEN {FOCUS} <> '' THEN {FOCUS} ELSE substr(text, 1, 120) END AS focus FROM documents")
def focus_text(spark, sf_dir):
    words = F.array_join(F.slice(F.split(T.clean(F.col("text")), " "), 1, 18), " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(words != "", words).otherwise(F.substring("text", 1, 120)).alias("focus"))


#: Scenario, prefix of its ids, whether it is complex, may be cached, is expected in the cache, tags, and the question's frame; fixed values.
SCENARIOS = (
    ("semantic_cache_lookup", "semantic", False, True, True, "semantic-cache", "Summarize this content: %s"),
    ("retrieval_hybrid", "retrieval", False, False, False, "retrieval", "Find the most relevant context for: %s"),
    ("llm_generation", "generation", False, False, False, "generation", "Answer a grounded question about: %s"),
    ("non_cached_complex_query", "complex", True, False, False, "complex,non-cached", "Compare the main claims, supporting evidence, and caveats in these materials: %s. Provide a non-cached grounded answer with tradeoffs."),
)


@query(f"""WITH d AS (SELECT doc_id, coalesce(nullif({FOCUS}, ''), substr(text, 1, 120)) AS focus FROM documents),
c AS (SELECT 'semantic_cache_lookup' AS scenario, 'semantic' AS kind, false AS complex, true AS allow_cache, true AS expected_hit, 'semantic-cache' AS tags, 'Summarize this content: ' AS lead, '' AS tail
UNION ALL SELECT 'retrieval_hybrid', 'retrieval', false, false, false, 'retrieval', 'Find the most relevant context for: ', ''
UNION ALL SELECT 'llm_generation', 'generation', false, false, false, 'generation', 'Answer a grounded question about: ', ''
UNION ALL SELECT 'non_cached_complex_query', 'complex', true, false, false, 'complex,non-cached', 'Compare the main claims, supporting evidence, and caveats in these materials: ', '. Provide a non-cached grounded answer with tradeoffs.')
SELECT doc_id, kind || '_' || doc_id AS case_id, scenario, complex, allow_cache, expected_hit, tags, lead || focus || tail AS question FROM d, c""")
def query_cases(spark, sf_dir):
    """Four questions about each document's first 18 words."""
    words = F.array_join(F.slice(F.split(T.clean(F.col("text")), " "), 1, 18), " ")
    focus = F.when(words != "", words).otherwise(F.substring("text", 1, 120))
    made = [F.struct(F.lit(n).alias("scenario"), F.lit(k).alias("kind"), F.lit(c).alias("complex"), F.lit(a).alias("allow_cache"), F.lit(e).alias("expected_hit"), F.lit(t).alias("tags"), F.replace(F.lit(f), F.lit("%s"), F.col("focus")).alias("question")) for n, k, c, a, e, t, f in SCENARIOS]
    rows = table(spark, sf_dir, "documents").select("doc_id", focus.alias("focus")).where("focus is not null").select("doc_id", F.explode(F.array(*made)).alias("c"))
    return rows.select("doc_id", F.concat_ws("_", "c.kind", "doc_id").alias("case_id"), "c.scenario", "c.complex", "c.allow_cache", "c.expected_hit", "c.tags", "c.question")


PAIRS = f'SELECT tok AS "left", nxt AS "right", count(*) AS n FROM (SELECT tok, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM ({TOKENS})) WHERE nxt IS NOT NULL GROUP BY 1, 2'


@query(PAIRS)
def bigrams(spark, sf_dir):
    return T.bigrams(table(spark, sf_dir, "documents"), ["doc_id"], "text")


BEST = f'SELECT "left", "right", n FROM (SELECT *, row_number() OVER (PARTITION BY "left" ORDER BY n DESC, "right" DESC) AS r FROM ({PAIRS})) WHERE r = 1'


@query(BEST)
def markov_argmax(spark, sf_dir):
    return T.successors(T.bigrams(table(spark, sf_dir, "documents"), ["doc_id"], "text"))


@query(f"""WITH RECURSIVE best AS MATERIALIZED ({BEST}),
walk(seed, step, tok) AS (SELECT item_id, 0, (regexp_extract_all(lower(text), '[a-z0-9_]+'))[1] FROM benchmark
 UNION ALL SELECT seed, step + 1, "right" FROM walk JOIN best ON tok = "left" WHERE step < 8)
SELECT seed AS item_id, string_agg(tok, ' ' ORDER BY step) AS answer FROM walk WHERE tok IS NOT NULL GROUP BY seed""")
def markov_walk(spark, sf_dir):
    """Eight greedy steps from each item's first token; steps are joins, so the table may be large."""
    best = T.successors(T.bigrams(table(spark, sf_dir, "documents"), ["doc_id"], "text")).drop("n").persist()
    walk = table(spark, sf_dir, "benchmark").select("item_id", F.get(T.tokens(F.col("text")), F.lit(0)).alias("at")).where("at is not null").withColumn("said", F.array("at"))
    for _ in range(8):
        walk = walk.join(best, walk["at"] == best["left"], "left").select("item_id", F.when(F.col("right").isNotNull(), F.concat("said", F.array("right"))).otherwise(F.col("said")).alias("said"), F.col("right").alias("at"))
    return walk.select("item_id", F.array_join("said", " ").alias("answer"))


@query("""SELECT doc_id, replace(replace(trim(lower(source)), 'src', 'source-'), ' ', '_') AS label, regexp_replace(source, '[^0-9]', '', 'g')::INT AS num,
 printf('%06d_%s', doc_id, lang) AS run_id, md5(text) AS md5, sha256(text) AS sha256, substr(text, 1, 240) AS preview, len(regexp_extract_all(text, '[.]')) AS stops FROM documents""")
def scalar_strings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    label = F.replace(F.replace(F.trim(F.lower("source")), F.lit("src"), F.lit("source-")), F.lit(" "), F.lit("_"))
    return docs.select("doc_id", label.alias("label"), F.regexp_replace("source", "[^0-9]", "").cast("int").alias("num"), F.format_string("%06d_%s", "doc_id", "lang").alias("run_id"), F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"), F.substring("text", 1, 240).alias("preview"), F.regexp_count("text", F.lit("[.]")).alias("stops"))


@query("""SELECT idx % 4 AS shard, count(*) AS docs, min(doc_id) AS first_doc, sum(n_chars)::BIGINT AS chars FROM
(SELECT *, row_number() OVER (ORDER BY source, doc_id) - 1 AS idx FROM documents) GROUP BY 1""")
def round_robin_shards(spark, sf_dir):
    """Row index modulo world, by order of source and id; indices come from counts, not one sorted task."""
    from ..sources.sharding import with_index

    docs = with_index(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source", "doc_id"], "idx")
    return docs.groupBy(F.pmod("idx", F.lit(4)).alias("shard")).agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"), F.sum("n_chars").alias("chars"))
