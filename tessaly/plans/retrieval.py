"""Retrieval queries over documents and benchmark questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaly.functions import vocabulary as V
from tessaly.functions.text import blank_to_null, by, clamp, ordered_join, strip
from tessaly.operators import chunking, retrieval, search_index
from tessaly.operators.segmented import ranked
from tessaly.plans.registry import query
from tessaly.plans.views import WS, lines_sql, strip_sql, view, view_sql
from tessaly.session import table
from tessaly.sources.folders import materialise

CHUNK_KEY = ["id", "chunk_index"]
NEWEST_FIRST = ("-id", "-chunk_index")


def tidy_sql(expr: str) -> str:
    stripped = f"list_transform({lines_sql(expr)}, lambda x: {strip_sql('x')})"
    return f"array_to_string(list_filter({stripped}, lambda x: x <> ''), chr(10))"


def chunks_sql(source: str, keys: str, text: str, size: int, overlap: int) -> str:
    step = max(size - overlap, 1)
    return f"""(SELECT {keys}, i AS chunk_index, substr(tidy, i * {step} + 1, {size}) AS content
      FROM (SELECT {keys}, tidy, unnest(range(CASE WHEN len(tidy) = 0 THEN 0 WHEN len(tidy) <= {size} THEN 1
              ELSE CAST(ceil((len(tidy) - {size}) / {step}.0) AS BIGINT) + 1 END)) AS i
            FROM (SELECT {keys}, {tidy_sql(text)} AS tidy FROM {source})))"""


def grams_sql(source: str, keys: str, text: str) -> str:
    return f"""(SELECT {keys}, substr(p, i, n) AS term, count(*) AS tf
      FROM (SELECT {keys}, p, n, unnest(range(1, len(p) - n + 2)) AS i
            FROM (SELECT {keys}, ' ' || w || ' ' AS p
                  FROM (SELECT {keys}, unnest(string_split_regex(lower({text}), '{WS}+')) AS w FROM {source})
                  WHERE w <> '') CROSS JOIN (VALUES (2), (3), (4)) g(n))
      GROUP BY ALL)"""


def search_sql(chunks: str, queries: str, scope: str, k: str, chunk_key: str = "id, chunk_index",
               order: str = "id DESC, chunk_index DESC", content: str = "content") -> str:
    """Direct form: the corpus of each query includes the query itself."""
    return f"""sizes AS (SELECT {scope}, count(*) AS n_chunks FROM {chunks} GROUP BY {scope}),
    terms AS {grams_sql(chunks, f"{scope}, {chunk_key}", content)},
    q_terms AS {grams_sql(queries, f"{scope}, query_id", "query_text")},
    freq AS (SELECT {scope}, term, count(*) AS df FROM terms GROUP BY ALL),
    q_idf AS (SELECT query_id, {scope}, term, q_tf, ln((n_chunks + 2.0) / (coalesce(df, 0) + (CASE WHEN q_tf IS NULL THEN 1 ELSE 2 END))) + 1 AS idf
      FROM (SELECT query_id, {scope}, term, max(q_tf) AS q_tf, max(df) AS df FROM (
              SELECT query_id, {scope}, term, tf AS q_tf, NULL AS df FROM q_terms
              UNION ALL SELECT q.query_id, {scope}, f.term, NULL, f.df FROM freq f JOIN {queries} q USING ({scope})) GROUP BY ALL)
      JOIN sizes USING ({scope})),
    q_len AS (SELECT query_id, sqrt(sum(power(q_tf * idf, 2))) AS q_norm FROM q_idf WHERE q_tf IS NOT NULL GROUP BY query_id),
    scored AS (SELECT query_id, {scope}, {chunk_key}, sum(tf * idf * coalesce(q_tf, 0) * idf) / sqrt(sum(power(tf * idf, 2))) AS dot
      FROM terms JOIN q_idf USING ({scope}, term) GROUP BY ALL),
    pairs AS (SELECT query_id, {scope}, {chunk_key}, round(coalesce(dot / q_norm, 0), 10) AS score
      FROM {queries} JOIN {chunks} USING ({scope}) LEFT JOIN scored USING (query_id, {scope}, {chunk_key}) LEFT JOIN q_len USING (query_id)),
    hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {order}) AS hit_rank FROM pairs)
      WHERE hit_rank <= {k})"""


INDEX_SQL = chunks_sql("docs", "id, owner, doc_type", "body", V.INDEX_CHUNK, V.INDEX_OVERLAP)


def index_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_text(view(spark, sf_dir, "docs"), "body", V.INDEX_CHUNK, V.INDEX_OVERLAP)


#: Stored indexes of this application, by session, folder and scope.
STORED: dict[tuple, search_index.SearchIndex] = {}


def stored_index(spark: SparkSession, sf_dir: str, scope: tuple[str, ...]) -> search_index.SearchIndex:
    """The index over all chunks of the documents, built when it is first asked for."""
    name = (spark.sparkContext.applicationId, sf_dir, scope)
    if name not in STORED:
        STORED[name] = search_index.build_index(index_chunks(spark, sf_dir).select(*dict.fromkeys((*scope, *CHUNK_KEY)), "content"), list(scope), CHUNK_KEY)
    return STORED[name]


def owner_hits(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    return search_index.search(stored_index(spark, sf_dir, ("owner",)), view(spark, sf_dir, "asked"), k, ["query_id"], NEWEST_FIRST)


@query("r0_split_text", f"WITH {view_sql('docs')} SELECT id, chunk_index, content FROM {chunks_sql('docs', 'id', 'body', 700, 100)}")
def split_default(spark, sf_dir):
    return chunking.split_text(view(spark, sf_dir, "docs").select("id", "body")).select("id", "chunk_index", "content")


@query("r0_page_text", f"WITH {view_sql('docs')} SELECT id, chunk_index + 1 AS page_no, content FROM {chunks_sql('docs', 'id', 'body', V.PAGE_CHUNK, 0)}")
def split_pages(spark, sf_dir):
    pages = chunking.split_text(view(spark, sf_dir, "docs").select("id", "body"), size=V.PAGE_CHUNK, overlap=0)
    return pages.select("id", (F.col("chunk_index") + 1).alias("page_no"), "content")


@query("r1_char_ngram_weights", f"""WITH {view_sql('docs')}, chunks AS {INDEX_SQL},
    terms AS {grams_sql('chunks', 'owner, id, chunk_index', 'content')},
    freq AS (SELECT owner, term, count(*) AS df FROM terms GROUP BY ALL),
    sizes AS (SELECT owner, count(*) AS n FROM chunks GROUP BY owner)
    SELECT owner, id, chunk_index, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_grams,
           round(sqrt(sum(power(tf * (ln((n + 2.0) / (df + 1)) + 1), 2))), 4) AS norm
    FROM terms JOIN freq USING (owner, term) JOIN sizes USING (owner) GROUP BY ALL""")
def ngram_weights(spark, sf_dir):
    dealt, sizes = retrieval.deal(index_chunks(spark, sf_dir), ["owner"], CHUNK_KEY, "content")
    weights = retrieval.lot_weights(retrieval.lot_terms(dealt.filter("lot < 0")), sizes)
    return retrieval.measure(dealt, weights, ["owner"], CHUNK_KEY).filter("n_terms > 0").select(
        "owner", *CHUNK_KEY, "n_terms", "n_grams", F.round(F.sqrt("base"), 4).alias("norm")
    )


@query("a11_scope_term_stats", f"""WITH {view_sql('docs')}, chunks AS {INDEX_SQL}
    SELECT doc_type, term, count(*) AS df, any_value(n) AS n_chunks FROM {grams_sql('chunks', 'doc_type, id, chunk_index', 'content')}
    JOIN (SELECT doc_type, count(*) AS n FROM chunks GROUP BY doc_type) USING (doc_type) GROUP BY doc_type, term""")
def scope_term_stats(spark, sf_dir):
    dealt, sizes = retrieval.deal(index_chunks(spark, sf_dir), ["doc_type"], CHUNK_KEY, "content")
    return retrieval.term_statistics(retrieval.lot_terms(dealt), sizes, ["doc_type"]).drop("_scope")


OWNER_SEARCH = f"WITH {view_sql('docs', 'asked')}, chunks AS {INDEX_SQL}, "


@query("r2_search_chunks", OWNER_SEARCH + search_sql("chunks", "asked", "owner", "5")
       + " SELECT query_id, owner, id AS doc_id, chunk_index, hit_rank, round(score, 4) AS score FROM hits")
def search_chunks(spark, sf_dir):
    return owner_hits(spark, sf_dir).select(
        "query_id", "owner", F.col("id").alias("doc_id"), "chunk_index", "hit_rank", F.round("score", 4).alias("score")
    )


EDITED_SQL = ("edited AS (SELECT id, owner, doc_type, CASE WHEN id % 3 = 0 THEN concat('revision of ', id, chr(10), coalesce(body, '')) ELSE body END AS body FROM docs), "
              f"chunks AS {chunks_sql('edited', 'id, owner, doc_type', 'body', V.INDEX_CHUNK, V.INDEX_OVERLAP)}, ")


@query("r5_search_after_edit", f"WITH {view_sql('docs', 'asked')}, {EDITED_SQL}" + search_sql("chunks", "asked", "owner", "5")
       + " SELECT query_id, owner, id AS doc_id, chunk_index, hit_rank, round(score, 4) AS score FROM hits")
def search_after_edit(spark, sf_dir):
    """A third of the documents is edited: their chunks replace the old ones in the stored index, no other text is cut again."""
    docs = view(spark, sf_dir, "docs").filter("id % 3 = 0")
    edited = docs.withColumn("body", F.concat(F.lit("revision of "), F.col("id").cast("string"), F.lit("\n"), F.coalesce("body", F.lit(""))))
    changed = chunking.split_text(edited, "body", V.INDEX_CHUNK, V.INDEX_OVERLAP).select("owner", *CHUNK_KEY, "content")
    index = search_index.update_index(stored_index(spark, sf_dir, ("owner",)), changed)
    return search_index.search(index, view(spark, sf_dir, "asked"), 5, ["query_id"], NEWEST_FIRST).select(
        "query_id", "owner", F.col("id").alias("doc_id"), "chunk_index", "hit_rank", F.round("score", 4).alias("score")
    )


@query("t4_top_k_per_type", f"WITH {view_sql('docs')}, chunks AS {INDEX_SQL}, asked AS (SELECT item_id AS query_id, text AS query_text, "
       "CASE item_id % 4 WHEN 0 THEN 'fr' WHEN 1 THEN 'de' WHEN 2 THEN 'es' ELSE 'en' END AS doc_type FROM benchmark), "
       + search_sql("chunks", "asked", "doc_type", "3")
       + " SELECT query_id, doc_type, id AS doc_id, chunk_index, hit_rank, round(score, 4) AS score FROM hits")
def top_k_per_type(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").selectExpr(
        "item_id AS query_id", "text AS query_text",
        "CASE item_id % 4 WHEN 0 THEN 'fr' WHEN 1 THEN 'de' WHEN 2 THEN 'es' ELSE 'en' END AS doc_type",
    )
    hits = search_index.search(stored_index(spark, sf_dir, ("doc_type",)), asked, 3, ["query_id"], NEWEST_FIRST)
    return hits.select(
        "query_id", "doc_type", F.col("id").alias("doc_id"), "chunk_index", "hit_rank", F.round("score", 4).alias("score")
    )


def per_document_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is asked one benchmark question, taken round robin."""
    items = table(spark, sf_dir, "benchmark")
    asked = items.select("item_id", F.col("text").alias("query_text"))
    numbered = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), (F.col("doc_id") % items.agg(F.count(F.lit(1))).scalar()).alias("item_id")
    )
    return numbered.join(asked, "item_id").select("id", F.col("id").alias("query_id"), "query_text")


DOC_ASKED_SQL = ("asked AS (SELECT d.doc_id AS id, d.doc_id AS query_id, b.text AS query_text FROM documents d "
                 "JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))")
DOC_CHUNKS_SQL = chunks_sql("docs", "id", "body", V.INDEX_CHUNK, V.INDEX_OVERLAP)


def document_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    chunks = index_chunks(spark, sf_dir).select("id", "chunk_index", "content")
    return retrieval.search(
        chunks, per_document_questions(spark, sf_dir), k, ["id"], ["chunk_index"], ["query_id"], ("chunk_index",)
    )


@query("r3_search_in_document", f"WITH {view_sql('docs')}, chunks AS {DOC_CHUNKS_SQL}, {DOC_ASKED_SQL}, "
       + search_sql("chunks", "asked", "id", "3", "chunk_index", "chunk_index")
       + " SELECT id AS doc_id, chunk_index, hit_rank, round(score, 4) AS score FROM hits")
def search_in_document(spark, sf_dir):
    return document_hits(spark, sf_dir, 3).select(
        F.col("id").alias("doc_id"), "chunk_index", "hit_rank", F.round("score", 4).alias("score")
    )


@query("r4_rag_context", OWNER_SEARCH + search_sql("chunks", "asked", "owner", "5")
       + """ SELECT query_id, coalesce(context, query_text) AS context FROM (SELECT item_id AS query_id, text AS query_text FROM benchmark)
       LEFT JOIN (SELECT query_id, string_agg(concat('[相关片段 ', hit_rank, ']', chr(10), content), chr(10) || chr(10) ORDER BY hit_rank) AS context
         FROM hits JOIN chunks USING (owner, id, chunk_index) GROUP BY query_id) USING (query_id)""")
def rag_context(spark, sf_dir):
    # Stored first, so that few hits go to the chunks and the chunks stay where they are.
    hits = search_index.sent(materialise(owner_hits(spark, sf_dir), "hits"))
    hits = hits.join(index_chunks(spark, sf_dir).select("id", "chunk_index", "content"), CHUNK_KEY)
    asked = view(spark, sf_dir, "asked")
    texts = retrieval.numbered_context(hits, ["query_id"])
    return asked.join(texts, "query_id", "left").select("query_id", F.coalesce("context", "query_text").alias("context"))


@query("j11_retrieval_quality", OWNER_SEARCH + search_sql("chunks", "asked", "owner", "8")
       + """ SELECT query_id, count(*) AS n_labelled, round(avg(quality), 4) AS quality_share, round(avg(toxic), 4) AS toxic_share
       FROM hits JOIN labels ON labels.doc_id = hits.id GROUP BY query_id""")
def retrieval_quality(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    return (
        owner_hits(spark, sf_dir, 8).join(labels, "id").groupBy("query_id")
        .agg(
            F.count(F.lit(1)).alias("n_labelled"),
            F.round(F.avg("quality"), 4).alias("quality_share"),
            F.round(F.avg("toxic"), 4).alias("toxic_share"),
        )
    )


PAPER_QUESTION = "abstract introduction method experiment contribution limitation"
MIX_SQL = f"""asked AS (SELECT query_id, owner, CASE WHEN paper THEN 'fr' ELSE 'en' END AS doc_type,
      CASE WHEN paper THEN '{PAPER_QUESTION}' ELSE coalesce(nullif({strip_sql('raw')}, ''), '课程重点') END AS query_text,
      CASE WHEN paper THEN 16 ELSE greatest(1, least(8, asked_k)) END AS k
    FROM (SELECT item_id AS query_id, concat('src', CAST(item_id % 20 AS STRING)) AS owner, item_id % 5 = 0 AS paper,
                 CASE WHEN item_id % 7 = 1 THEN '  ' ELSE text END AS raw, item_id % 12 - 1 AS asked_k FROM benchmark))"""


@query("r6_search_by_task_mix", f"WITH {view_sql('docs')}, chunks AS {INDEX_SQL}, {MIX_SQL}, "
       + search_sql("chunks", "asked", "owner, doc_type", "16")
       + " SELECT query_id, id AS doc_id, chunk_index, hit_rank, round(score, 4) AS score FROM hits JOIN asked USING (query_id) WHERE hit_rank <= k")
def search_by_task_mix(spark, sf_dir):
    raw = table(spark, sf_dir, "benchmark").selectExpr(
        "item_id AS query_id", "concat('src', item_id % 20) AS owner", "item_id % 5 = 0 AS paper",
        "CASE WHEN item_id % 7 = 1 THEN '  ' ELSE text END AS raw", "item_id % 12 - 1 AS asked_k",
    )
    asked = raw.select(
        "query_id", "owner", F.when(F.col("paper"), "fr").otherwise("en").alias("doc_type"),
        F.when(F.col("paper"), PAPER_QUESTION)
        .otherwise(F.coalesce(blank_to_null(strip("raw")), F.lit("课程重点"))).alias("query_text"),
        F.when(F.col("paper"), 16).otherwise(clamp(F.col("asked_k"), 1, 8)).alias("k"),
    )
    hits = retrieval.search(
        index_chunks(spark, sf_dir), asked.drop("k"), 16, ["owner", "doc_type"], CHUNK_KEY, ["query_id"], NEWEST_FIRST
    )
    return (
        hits.join(asked.select("query_id", "k"), "query_id").filter(F.col("hit_rank") <= F.col("k"))
        .select("query_id", F.col("id").alias("doc_id"), "chunk_index", "hit_rank", F.round("score", 4).alias("score"))
    )


@query("f4_chunks_in_scope", f"""WITH {view_sql('docs')}, chunks AS {INDEX_SQL}
    SELECT owner, id, chunk_index, row_number() OVER (PARTITION BY owner ORDER BY id DESC, chunk_index DESC) AS scan_order,
           row_number() OVER (PARTITION BY id ORDER BY chunk_index) AS document_order FROM chunks""")
def chunks_in_scope(spark, sf_dir):
    chunks = index_chunks(spark, sf_dir).select("owner", "id", "chunk_index")
    placed = chunks.withColumn("block", -F.floor(F.col("id") / 1000))
    return ranked(placed, ["owner"], "block", by(*NEWEST_FIRST), "scan_order").select(
        "owner", "id", "chunk_index", "scan_order", (F.col("chunk_index") + 1).alias("document_order")
    )


@query("a7_rebuild_body", f"""WITH {view_sql('docs')}, chunks AS {INDEX_SQL}
    SELECT id, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) AS body FROM chunks GROUP BY id""")
def rebuild_body(spark, sf_dir):
    chunks = index_chunks(spark, sf_dir)
    return chunks.groupBy("id").agg(ordered_join("\n\n", F.col("chunk_index"), F.col("content")).alias("body"))
