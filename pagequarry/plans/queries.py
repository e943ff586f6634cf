"""The registered queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions import text as X
from ..operators import basis, calibration, chunking, confidence, entities, ingest, keyword, responses, retrieval, vector_store
from ..operators.scratch import keep
from ..streaming.ingest import event_counts as windowed_events
from .bindings import chunks, keyword_index, questions, table, turns_as_pages, vector_index, vector_questions

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def r6(name: str):
    return F.round(name, 6).alias(name)


# -- shared SQL -----------------------------------------------------------------------------------

_CHUNKS = r"""
WITH chunks AS (SELECT doc_id AS chunk_id, doc_id AS seq, source AS doc_name, lang AS fiscal_year, text,
  row_number() OVER (PARTITION BY source ORDER BY doc_id)::INTEGER AS page_number FROM documents),
idx AS (SELECT *, doc_name || ' ' || fiscal_year || ' annual report, page ' || page_number || '.' || chr(10) || text AS indexed_text FROM chunks),
toks AS (SELECT chunk_id, seq, doc_name, fiscal_year, regexp_extract_all(lower(indexed_text), '[\p{L}\p{N}_]+') AS t FROM idx),
post AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM toks) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks)"""


def _keyword_sql(doc: str = "NULL", year: str = "NULL", question: str = "text") -> str:
    return (
        _CHUNKS
        + rf""",
q AS (SELECT item_id AS query_id, {question} AS question, {doc}::VARCHAR AS want_doc, {year}::VARCHAR AS want_year FROM benchmark),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}_]+')) AS term FROM q) GROUP BY ALL),
sc AS (SELECT query_id, term, qtf * ln((n + 1) / df) AS w FROM qt JOIN df USING (term), st),
base AS (SELECT query_id, sum(w) AS b FROM sc GROUP BY 1),
hit AS (SELECT query_id, chunk_id, sum(w * (tf * 2.5 / (1.5 * (0.25 + 0.75 * len(t) / avgdl) + tf))) AS p
        FROM sc JOIN post USING (term) JOIN toks USING (chunk_id), st GROUP BY ALL),
kw AS (SELECT * FROM (SELECT b.query_id, c.chunk_id, c.seq, b + coalesce(p, 0) AS s,
         row_number() OVER (PARTITION BY b.query_id ORDER BY round(b + coalesce(p, 0), 9) DESC, c.seq) AS r
       FROM base b JOIN q USING (query_id) CROSS JOIN toks c LEFT JOIN hit h ON h.query_id = b.query_id AND h.chunk_id = c.chunk_id
       WHERE (want_doc IS NULL OR want_doc = c.doc_name) AND (want_year IS NULL OR want_year = c.fiscal_year)) WHERE r <= 10)"""
    )


_FILTERS = ("'src' || (item_id % 20)", "CASE WHEN item_id % 2 = 0 THEN 'en' END")


def _vector_parts(doc: str = "NULL", year: str = "NULL", overfetch: bool = False) -> str:
    match = "(want_doc IS NULL OR want_doc = doc_name) AND (want_year IS NULL OR want_year = fiscal_year)"
    scored = rf"""
e AS (SELECT vec_id, source AS doc_name, lang AS fiscal_year, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings LEFT JOIN documents ON vec_id = doc_id),
u AS (SELECT vec_id, doc_name, fiscal_year, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
vq AS (SELECT item_id AS query_id, {doc}::VARCHAR AS want_doc, {year}::VARCHAR AS want_year, v AS qv FROM benchmark JOIN u ON vec_id = item_id),
pair AS (SELECT query_id, vec_id AS chunk_id, list_dot_product(qv, v) AS s, want_doc, want_year, doc_name, fiscal_year FROM vq CROSS JOIN u),"""
    if overfetch:
        return scored + f"""
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) AS r0 FROM pair) WHERE r0 <= 50),
ve AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) AS r FROM near WHERE {match}) WHERE r <= 10)"""
    return scored + f"""
ve AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) AS r FROM pair WHERE {match}) WHERE r <= 10)"""


_KW_OUT = " SELECT query_id, chunk_id, round(s, 6) AS bm25_score, r::INTEGER AS bm25_rank FROM kw"
_VE_OUT = " SELECT query_id, chunk_id, round(s, 6) AS vector_score, r::INTEGER AS vector_rank FROM ve"
_HYBRID = (
    _keyword_sql()
    + ","
    + _vector_parts()
    + """,
mg AS (SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.chunk_id, k.chunk_id) AS chunk_id, v.s AS vector_score, k.s AS bm25_score,
  CASE WHEN v.s IS NOT NULL AND k.s IS NOT NULL THEN 'hybrid' WHEN v.s IS NOT NULL THEN 'vector' ELSE 'bm25' END AS retrieval_source, v.r AS vr, k.r AS kr
  FROM ve v FULL JOIN kw k ON v.query_id = k.query_id AND v.chunk_id = k.chunk_id),
cand AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vr NULLS LAST, kr) AS position FROM mg)"""
)
_RERANK = (
    _HYBRID
    + r""",
rr AS (SELECT query_id, c.chunk_id, position, retrieval_source, doc_name, fiscal_year, page_number, text,
  len(list_intersect(list_distinct(regexp_extract_all(lower(question), '[\p{L}\p{N}_]+')), regexp_extract_all(lower(indexed_text), '[\p{L}\p{N}_]+')))
   / len(list_distinct(regexp_extract_all(lower(question), '[\p{L}\p{N}_]+'))) * 22.0 - 11.0 AS score
  FROM cand c JOIN q USING (query_id) JOIN idx ON idx.chunk_id = c.chunk_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position)::INTEGER AS rank FROM rr) WHERE rank <= 5)"""
)


# -- keyword and vector lanes ---------------------------------------------------------------------


def _keyword(spark, sf_dir, filtered=False) -> DataFrame:
    return keyword.keyword_search(questions(spark, sf_dir, filtered), keyword_index(spark, sf_dir))


@query(_keyword_sql() + _KW_OUT)
def bm25_topk(spark, sf_dir):
    return _keyword(spark, sf_dir).select("query_id", "chunk_id", r6("bm25_score"), "bm25_rank")


@query(_keyword_sql(*_FILTERS) + _KW_OUT)
def bm25_filtered(spark, sf_dir):
    return _keyword(spark, sf_dir, True).select("query_id", "chunk_id", r6("bm25_score"), "bm25_rank")


@query(_keyword_sql(question="'zzqx' || item_id || 'qq'") + _KW_OUT)
def bm25_oov_empty(spark, sf_dir):
    q = questions(spark, sf_dir).withColumn("question", F.concat(F.lit("zzqx"), F.col("query_id").cast("string"), F.lit("qq")))
    return keyword.keyword_search(q, keyword_index(spark, sf_dir)).select("query_id", "chunk_id", r6("bm25_score"), "bm25_rank")


@query(_CHUNKS + " SELECT n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM df) AS n_terms, (SELECT count(*) FROM post) AS n_postings FROM st")
def corpus_stats(spark, sf_dir):
    i = keyword_index(spark, sf_dir)
    return i.stats.crossJoin(i.df.agg(F.count(F.lit(1)).alias("n_terms"), F.sum("df").alias("n_postings"))).select("n", r6("avgdl"), "n_terms", "n_postings")


@query(_CHUNKS + " SELECT term, df FROM df ORDER BY df DESC, term LIMIT 100")
def term_df_top(spark, sf_dir):
    return keyword_index(spark, sf_dir).df.orderBy(F.desc("df"), "term").limit(100)


def _vector(spark, sf_dir, filtered=False, overfetch=None) -> DataFrame:
    return vector_store.search_index(vector_questions(spark, sf_dir, filtered), vector_index(spark, sf_dir), overfetch=overfetch)


@query("WITH" + _vector_parts() + _VE_OUT)
def vector_topk(spark, sf_dir):
    return _vector(spark, sf_dir).select("query_id", "chunk_id", r6("vector_score"), "vector_rank")


@query("WITH" + _vector_parts(*_FILTERS) + _VE_OUT)
def vector_topk_filtered(spark, sf_dir):
    return _vector(spark, sf_dir, True).select("query_id", "chunk_id", r6("vector_score"), "vector_rank")


@query("WITH" + _vector_parts(*_FILTERS, overfetch=True) + _VE_OUT)
def vector_overfetch_filtered(spark, sf_dir):
    return _vector(spark, sf_dir, True, 5).select("query_id", "chunk_id", r6("vector_score"), "vector_rank")


# -- merging, reranking, confidence ---------------------------------------------------------------


def _hybrid(spark, sf_dir) -> DataFrame:
    return retrieval.merge_lanes(_vector(spark, sf_dir), _keyword(spark, sf_dir))


@query(_HYBRID + " SELECT query_id, chunk_id, round(vector_score, 6) AS vector_score, round(bm25_score, 6) AS bm25_score, retrieval_source, position::INTEGER AS position FROM cand")
def hybrid_merge(spark, sf_dir):
    return _hybrid(spark, sf_dir).select("query_id", "chunk_id", r6("vector_score"), r6("bm25_score"), "retrieval_source", "position")


@query(_HYBRID + " SELECT retrieval_source, count(*) AS n, count(DISTINCT query_id) AS n_queries FROM cand GROUP BY 1")
def hybrid_source_counts(spark, sf_dir):
    return _hybrid(spark, sf_dir).groupBy("retrieval_source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("query_id").alias("n_queries"))


@query(_HYBRID + " SELECT query_id, chunk_id, retrieval_source FROM cand JOIN idx USING (chunk_id) WHERE query_id % 3 = 0 OR contains('SECTION ' || upper(fiscal_year), CASE query_id % 3 WHEN 1 THEN 'EN' ELSE 'FR' END)")
def hybrid_section_filter(spark, sf_dir):
    c = chunks(spark, sf_dir).select("chunk_id", F.concat(F.lit("Section "), F.upper("fiscal_year")).alias("section_title"))
    q = questions(spark, sf_dir).withColumn("section_type", F.when(F.col("query_id") % 3 == 1, "en").when(F.col("query_id") % 3 == 2, "fr"))
    return retrieval.section_filter(_hybrid(spark, sf_dir).join(c, "chunk_id"), q).select("query_id", "chunk_id", "retrieval_source")


def _ranked(spark, sf_dir) -> DataFrame:
    """The best candidates, from what the keyword index keeps of each chunk."""
    about = keyword_index(spark, sf_dir).live().drop("seg", "shard", "place", "seq", "dl")
    candidates = keep(_hybrid(spark, sf_dir), "candidates").join(about, "chunk_id")
    return retrieval.rerank(candidates, questions(spark, sf_dir), retrieval.counted_logit, on="tfs")


def _with_texts(spark, sf_dir, ranked: DataFrame) -> DataFrame:
    """Texts are fetched for ranked chunks only."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return keep(ranked, "ranked").join(texts, "chunk_id")


@query(_RERANK + " SELECT query_id, chunk_id, rank, round(score, 6) AS rerank_score, retrieval_source FROM top")
def rerank_topn(spark, sf_dir):
    return _ranked(spark, sf_dir).select("query_id", "chunk_id", "rank", r6("rerank_score"), "retrieval_source")


@query(
    _RERANK
    + """, g AS (SELECT query_id, max(score) AS top, count(*) FILTER (score >= -2) AS supporting FROM top GROUP BY 1)
SELECT q.query_id, round(top, 6) AS top, coalesce(supporting, 0) AS supporting,
  CASE WHEN top IS NULL OR top < -6 THEN 'insufficient' WHEN top >= 2 AND supporting >= 2 THEN 'high' WHEN top >= -2 THEN 'moderate' ELSE 'low' END AS level
FROM q LEFT JOIN g USING (query_id)"""
)
def confidence_levels(spark, sf_dir):
    return confidence.assess(questions(spark, sf_dir), _ranked(spark, sf_dir)).select("query_id", r6("top"), "supporting", "level")


@query("SELECT event_id, CASE WHEN value IS NULL THEN 50 ELSE round_even((least(10.0, greatest(-10.0, value / 7 - 10)) + 10) / 20 * 100, 0)::INTEGER END AS relevance FROM events")
def relevance_scale(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.relevance(F.col("value") / 7 - 10).alias("relevance"))


# -- pages, chunks, registry ----------------------------------------------------------------------

def _any(patterns: tuple[str, ...]) -> str:
    return " OR ".join(f"regexp_matches(x, '{p}')" for p in patterns)


_NAMED = " ".join(f"WHEN regexp_matches(x, '{p}') THEN lower(regexp_extract(x, '{p}', 1))" for p in basis.MARKERS)
_BASIS = rf"""
WITH t AS (SELECT conv_id::VARCHAR AS doc_id, turn::INTEGER AS page_number,
  CASE turn % 5 WHEN 1 THEN 'Standalone Financial Statements 2024-25' || chr(10) WHEN 3 THEN '12 Consolidated Financial Statements 20' || lpad((conv_id % 9 + 20)::VARCHAR, 2, '0') || '-25' || chr(10)
    WHEN 4 THEN 'Glossary' || chr(10) ELSE '' END || text AS page FROM conversations),
l AS (SELECT doc_id, page_number, list_filter(list_filter(list_transform(string_split(page, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1:{basis.HEAD_LINES}], lambda x: length(x) <= {basis.LINE_CHARS}) AS lines FROM t),
p AS (SELECT doc_id, page_number, coalesce(list_filter(list_transform(lines, lambda x: CASE {_NAMED} END), lambda x: x IS NOT NULL)[1], CASE WHEN len(list_filter(lines, lambda x: {_any(basis.TERMINATORS)})) > 0 THEN '' END) AS ev FROM l),
b AS (SELECT doc_id, page_number, nullif(last_value(ev IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS basis FROM p)"""


@query(_BASIS + " SELECT doc_id, page_number, basis FROM b")
def basis_forward_fill(spark, sf_dir):
    return basis.assign_basis(turns_as_pages(spark, sf_dir)).select("doc_id", "page_number", "basis")


@query(_BASIS + " SELECT doc_id, count(*) AS pages, count(*) FILTER (basis = 'standalone') AS standalone_pages, count(*) FILTER (basis = 'consolidated') AS consolidated_pages FROM b GROUP BY 1")
def basis_page_counts(spark, sf_dir):
    b = basis.assign_basis(turns_as_pages(spark, sf_dir))
    return b.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("basis") == "standalone").alias("standalone_pages"), F.count_if(F.col("basis") == "consolidated").alias("consolidated_pages"))


@query("SELECT substr(sha256(source), 1, 16) AS doc_id, source AS doc_name, count(*) AS pages, sum(length(text))::BIGINT AS chars, min(lang) AS first_lang FROM documents GROUP BY ALL")
def doc_registry(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(X.doc_id(F.col("source")).alias("doc_id"), F.col("source").alias("doc_name")).agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("text")).alias("chars"), F.min("lang").alias("first_lang"))


@query(
    _CHUNKS
    + """ SELECT doc_name, count(*) AS chunks, count(DISTINCT page_number) AS pages_with_chunks, count(*) FILTER (fiscal_year = 'en') AS standalone, count(*) FILTER (fiscal_year = 'fr') AS consolidated,
  count(*) FILTER (fiscal_year NOT IN ('en', 'fr') OR fiscal_year IS NULL) AS undetermined FROM chunks GROUP BY 1"""
)
def doc_chunk_counts(spark, sf_dir):
    year = F.col("fiscal_year")
    return ingest.document_counts(chunks(spark, sf_dir).withColumn("basis", F.when(year == "en", "standalone").when(year == "fr", "consolidated")))


@query(
    """WITH i AS (SELECT conv_id, 'c' || conv_id AS doc_name, sha256(string_agg(text, chr(10) ORDER BY turn, text)) AS h FROM conversations GROUP BY conv_id),
reg AS (SELECT doc_name, CASE WHEN conv_id % 2 = 0 THEN h ELSE 'x' END AS known FROM i WHERE conv_id % 3 <> 0)
SELECT conv_id, CASE WHEN known IS NULL THEN 'new' WHEN known = h THEN 'already_indexed' ELSE 'conflict' END AS status FROM i LEFT JOIN reg USING (doc_name)"""
)
def reingest_guard_status(spark, sf_dir):
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    whole = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sha2(F.array_join(turns, "\n"), 256).alias("content_sha256"))
    incoming = whole.withColumn("doc_name", F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    known = incoming.where("conv_id % 3 <> 0").select(X.doc_id(F.col("doc_name")).alias("doc_id"), F.when(F.col("conv_id") % 2 == 0, F.col("content_sha256")).otherwise("x").alias("content_sha256"))
    return ingest.guard(incoming, known).select("conv_id", "status")


@query("SELECT DISTINCT source AS entity FROM documents WHERE source <> ''")
def indexed_entities(spark, sf_dir):
    return ingest.indexed_entities(chunks(spark, sf_dir))


_COMPANIES = ("Wipro Limited", "TCS", "HDFC Bank", "Infosys Ltd", "Zomato Limited", "src1", "Reliance Industries", "State Bank of India")


def _company_questions(spark, sf_dir) -> DataFrame:
    """The text of every turn, and a question about a company after it."""
    name = F.element_at(F.array(*map(F.lit, _COMPANIES)), ((F.col("conv_id") + F.col("turn")) % len(_COMPANIES) + 1).cast("int"))
    ident = (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id")
    return table(spark, sf_dir, "conversations").select(ident, F.concat(F.coalesce("text", F.lit("")), F.lit(" what was the revenue of "), name, F.lit("?")).alias("question"))


#: Every place of every known name (the text is cut at it; places within words are left out), longest names first, each stretch of text used once, then suffixed names at their first place.
_MENTIONED = rf"""
WITH q AS (SELECT conv_id * 1000 + turn AS query_id, coalesce(text, '') || ' what was the revenue of ' || [{", ".join(map(_quoted, _COMPANIES))}][(conv_id + turn) % {len(_COMPANIES)} + 1] || '?' AS question FROM conversations),
t AS (SELECT query_id, question, trim(regexp_replace(lower(question), '\s+', ' ', 'g')) AS text FROM q),
k(key, display) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in (names.KNOWN | names.ALIASES).items())}),
hit AS (SELECT query_id, key, text, string_split(text, key) AS parts FROM t JOIN k ON contains(t.text, k.key)),
pos AS (SELECT query_id, key, text, unnest(list_transform(range(1, len(parts)), lambda i: (list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(key))::INTEGER)) AS start FROM hit),
known AS (SELECT query_id, 0 AS late, -length(key) AS ord, key AS name, start FROM pos
  WHERE NOT regexp_matches(substr(text, start, CASE WHEN start > 0 THEN 1 ELSE 0 END), '[\p{{L}}\p{{N}}_]') AND NOT regexp_matches(substr(text, start + length(key) + 1, 1), '[\p{{L}}\p{{N}}_]')),
raw AS (SELECT query_id, text, unnest(x) AS raw, unnest(range(len(x))) AS place FROM (SELECT query_id, text, regexp_extract_all(question, {_quoted(entities.SUFFIXED.removeprefix("(?U)"))}, 1) AS x FROM t)),
suffixed AS (SELECT query_id, 1 AS late, place AS ord, name, instr(text, name) - 1 AS start FROM (SELECT *, trim(regexp_replace(lower(raw), '\s+', ' ', 'g')) AS name FROM raw) WHERE contains(text, name)),
span AS (SELECT query_id, list({{'name': name, 'a': start::INTEGER, 'b': (start + length(name))::INTEGER}} ORDER BY late, ord, name, start) AS s FROM (SELECT * FROM known UNION ALL SELECT * FROM suffixed) GROUP BY 1),
used AS (SELECT query_id, list_reduce(list_transform(s, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.a < x[1].b AND x[1].a < y.b)) > 0 THEN acc ELSE list_concat(acc, x) END) AS u FROM span),
each AS (SELECT query_id, unnest(u).name AS name, unnest(range(len(u))) AS place FROM used),
shown AS (SELECT query_id, coalesce(display, array_to_string(list_transform(string_split(name, ' '), lambda x: upper(x[1]) || substr(x, 2)), ' ')) AS display, min(place) AS place FROM each LEFT JOIN k ON key = name GROUP BY ALL),
listed AS (SELECT query_id, list(display ORDER BY place) AS d FROM shown WHERE display <> 'TCS' GROUP BY 1)"""


@query(_MENTIONED + " SELECT query_id, CASE WHEN len(d) = 1 THEN d[1] ELSE array_to_string(d[1:len(d) - 1], ', ') || ' and ' || d[len(d)] END AS name FROM listed")
def foreign_entity_antijoin(spark, sf_dir):
    have = spark.createDataFrame([("TCS",)], "entity string")
    return entities.foreign_entities(_company_questions(spark, sf_dir), have).select("query_id", X.listed(F.col("names")).alias("name"))


@query(_MENTIONED + " SELECT query_id, len(u)::INTEGER AS n_mentions FROM used")
def mention_spans(spark, sf_dir):
    return entities.mentions(_company_questions(spark, sf_dir)).select("query_id", F.size("mentions").alias("n_mentions"))


@query(_CHUNKS + " SELECT chunk_id, split_part(indexed_text, chr(10), 1) AS line, sha256(indexed_text) AS indexed_sha FROM idx")
def provenance_text(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return c.select("chunk_id", X.provenance(F.col("entity"), F.col("fiscal_year"), F.col("basis"), F.col("page_number")).alias("line"), F.sha2("indexed_text", 256).alias("indexed_sha"))


@query("SELECT page_id, substr(sha256(url), 1, 16) AS doc_id, sha256(html) AS content_sha FROM pages")
def doc_id_hash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.doc_id(F.col("url")).alias("doc_id"), F.sha2("html", 256).alias("content_sha"))


@query("SELECT doc_id, contains(text, ' | ') AS has_bar, contains(text, '[TABLE]') AS is_table, sha256(substr(text, 1, 600)) AS excerpt_sha, length(substr(text, 1, 600)) AS n FROM documents")
def table_flag_excerpt(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.contains(t, F.lit(" | ")).alias("has_bar"), X.is_table(t).alias("is_table"), F.sha2(X.excerpt(t), 256).alias("excerpt_sha"), F.length(X.excerpt(t)).alias("n").cast("long").alias("n"))


@query(r"SELECT doc_id, len(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))::INTEGER AS n_sentences FROM documents")
def sentence_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).alias("n_sentences"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::INTEGER AS n_words, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))::INTEGER AS n_tokens FROM documents")
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.word_count(F.col("text")).alias("n_words"), F.size(X.tokens(F.col("text"))).alias("n_tokens"))


_HEAD = "substr(page, 1, 500)"
_HEADINGS = ", ".join(f"substr(nullif(regexp_replace(regexp_extract({_HEAD}, {_quoted(p.replace('(?imd)', '(?im)').replace('(?md)', '(?m)'))}, 1), '^\\s+|\\s+$', '', 'g'), ''), 1, 120)" for p in X.HEADINGS)


def _chunks_sql(page: str) -> str:
    """The chunker by recursion: over the paragraphs, then over the sentences of pieces that are too long."""
    n_words = lambda c: f"len(list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> ''))"
    sentences = lambda c: f"string_split(regexp_replace({c}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return rf"""
WITH RECURSIVE t AS (SELECT substr(sha256(doc_id::VARCHAR), 1, 16) AS doc_id, {page} AS page FROM documents),
h AS (SELECT doc_id, page, coalesce({_HEADINGS}) AS section_title FROM t),
g AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(page, '
{{2,}}'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS ps FROM t),
f AS (SELECT doc_id, 1 AS i, [ps[1]] AS held, {n_words("ps[1]")} AS size, NULL::VARCHAR AS out, ps FROM g WHERE len(ps) > 0
  UNION ALL
  SELECT doc_id, i + 1, CASE WHEN size + n > 400 THEN [tail, p] ELSE list_append(held, p) END, CASE WHEN size + n > 400 THEN {n_words("tail")} ELSE size END + n,
    CASE WHEN size + n > 400 THEN array_to_string(held, chr(10) || chr(10)) END, ps
  FROM (SELECT *, ps[i + 1] AS p, {n_words("ps[i + 1]")} AS n, {sentences("held[len(held)]")}[-1] AS tail FROM f WHERE i < len(ps))),
piece AS (SELECT doc_id, i, out AS piece FROM f WHERE out IS NOT NULL UNION ALL SELECT doc_id, i + 1, array_to_string(held, chr(10) || chr(10)) FROM f WHERE i = len(ps)),
long AS (SELECT doc_id, i, {sentences("piece")} AS ss FROM piece WHERE {n_words("piece")} > 400),
r AS (SELECT doc_id, i, 1 AS j, 1 AS part, {n_words("ss[1]")} AS size, ss FROM long
  UNION ALL
  SELECT doc_id, i, j + 1, CASE WHEN size + n > 400 THEN part + 1 ELSE part END, CASE WHEN size + n > 400 THEN n ELSE size + n END, ss FROM (SELECT *, {n_words("ss[j + 1]")} AS n FROM r WHERE j < len(ss))),
c AS (SELECT doc_id, i, 0 AS part, piece AS text FROM piece WHERE {n_words("piece")} <= 400 UNION ALL SELECT doc_id, i, part, string_agg(ss[j], ' ' ORDER BY j) FROM r GROUP BY doc_id, i, part),
k AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, part) - 1)::INTEGER AS chunk_index, text FROM c WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> '')
SELECT doc_id || '_p1_' || chunk_index AS chunk_id, chunk_index, {n_words("text")}::INTEGER AS n_words, sha256(text) AS text_sha256, section_title FROM k JOIN h USING (doc_id)"""


def _chunked(spark, sf_dir, text) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("text", text)
    pages = d.select(X.doc_id(F.col("doc_id").cast("string")).alias("doc_id"), F.lit(1).alias("page_number"), "text", X.section_heading(F.col("text")).alias("section_heading"))
    return chunking.chunk_pages(pages).select("chunk_id", "chunk_index", X.word_count(F.col("text")).alias("n_words"), F.sha2("text", 256).alias("text_sha256"), "section_title")


@query(_chunks_sql("text"))
def chunk_documents(spark, sf_dir):
    return _chunked(spark, sf_dir, F.col("text"))


@query(_chunks_sql("upper(source) || ' ANNUAL REPORT' || chr(10) || replace(text, chr(10), chr(10) || chr(10))"))
def chunk_paragraphs(spark, sf_dir):
    """Each line a paragraph, under a line in capitals."""
    head = F.concat(F.upper("source"), F.lit(" ANNUAL REPORT\n"))
    return _chunked(spark, sf_dir, F.concat(head, F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))))


# -- formats --------------------------------------------------------------------------------------


@query(r"SELECT o_orderkey, CASE WHEN length(s) <= 3 THEN s ELSE regexp_replace(reverse(regexp_replace(reverse(substr(s, 1, length(s) - 3)), '(\d\d)', '\1,', 'g')), '^,', '') || ',' || right(s, 3) END AS grouped FROM (SELECT o_orderkey, (o_orderkey * 7919 + 13)::BIGINT::VARCHAR AS s FROM orders)")
def indian_grouping(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.group_indian((F.col("o_orderkey") * 7919 + 13).cast("long")).alias("grouped"))


@query(
    r"""WITH t AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT::VARCHAR AS s FROM orders),
g AS (SELECT o_orderkey, CASE WHEN length(s) <= 3 THEN s ELSE regexp_replace(reverse(regexp_replace(reverse(substr(s, 1, length(s) - 3)), '(\d\d)', '\1,', 'g')), '^,', '') || ',' || right(s, 3) END AS grouped FROM t)
SELECT o_orderkey, 'total Rs ' || grouped || '.00 on March 31, 2025 [Page 276]' AS prose FROM g"""
)
def regroup_prose(spark, sf_dir):
    money = F.format_number(F.col("o_totalprice") * 100, 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", X.regroup_prose(F.concat(F.lit("total Rs "), money, F.lit(" on March 31, 2025 [Page 276]"))).alias("prose"))


@query(
    r"""SELECT n_regionkey, count(*)::INTEGER + 1 AS n_rows, bool_and(regexp_matches(n_name, '^-?[\d,.]+$')) AS name_numeric, bool_and(regexp_matches(n_nationkey::VARCHAR, '^-?[\d,.]+$')) AS key_numeric,
string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1"""
)
def markdown_table_parse(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    line = F.concat(F.lit("| "), "n_name", F.lit(" | "), F.col("n_nationkey").cast("string"), F.lit(" |"))
    body = n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    parsed = body.select("n_regionkey", X.markdown_rows(F.concat(F.lit("| name | key |\n|---|--:|\n"), "body")).alias("rows"))
    numeric = X.numeric_columns(F.col("rows"))
    cells = F.transform(F.slice("rows", 2, F.size("rows") - 1), lambda r: r[0])
    return parsed.select("n_regionkey", F.size("rows").alias("n_rows"), numeric[0].alias("name_numeric"), numeric[1].alias("key_numeric"), F.array_join(F.array_sort(cells), ",").alias("names"))


@query("SELECT supp AS page_number, lpad_label AS label FROM (SELECT s_suppkey AS supp, CASE WHEN s_suppkey < 1000 THEN 'p.' || lpad(s_suppkey::VARCHAR, 3, '0') ELSE 'p.' || s_suppkey END AS lpad_label FROM supplier)")
def page_labels(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page_number"), X.page_label(F.col("s_suppkey")).alias("label"))


@query(
    """WITH c AS (SELECT doc_id, source, lang, CASE doc_id % 3 WHEN 0 THEN 'standalone' WHEN 1 THEN 'consolidated' END AS basis, (doc_id % 400)::VARCHAR AS page, doc_id % 4 <> 0 AS stored FROM documents),
b AS (SELECT *, CASE basis WHEN 'standalone' THEN 'Standalone' WHEN 'consolidated' THEN 'Consolidated' ELSE 'Basis unknown' END AS short FROM c)
SELECT doc_id, stored AS can_open, CASE WHEN coalesce(source, '') = '' THEN 'Entity ?' ELSE source END AS entity, CASE WHEN coalesce(lang, '') = '' THEN 'FY ?' ELSE lang END AS fiscal_year, short AS basis, 'p.' || page AS page,
  CASE WHEN stored THEN 'Open ' || coalesce(source, '?') || ' at page ' || page ELSE 'No stored PDF for ' || coalesce(source, '?') END AS title,
  CASE WHEN stored THEN 'Open source: ' ELSE 'Source (no PDF available): ' END || CASE WHEN coalesce(source, '') = '' THEN 'Unknown entity' ELSE source END || ', ' || CASE WHEN coalesce(lang, '') = '' THEN 'unknown fiscal year' ELSE lang END || ', ' || lower(short) || ', page ' || page AS label FROM b"""
)
def provenance_chips(spark, sf_dir):
    stored = F.when(F.col("doc_id") % 4 != 0, X.doc_id(F.col("source")))
    kind = F.when(F.col("doc_id") % 3 == 0, "standalone").when(F.col("doc_id") % 3 == 1, "consolidated")
    return table(spark, sf_dir, "documents").select("doc_id", X.provenance_chip(stored, F.col("source"), F.col("source"), F.col("lang"), kind, F.col("doc_id") % 400).alias("chip")).select("doc_id", "chip.*")


@query(
    r"""WITH t AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS cents FROM orders),
g AS (SELECT o_orderkey, cents, (cents // 100)::VARCHAR AS s, (CASE WHEN cents % 100 >= 50 THEN cents // 100 + 1 ELSE cents // 100 END)::VARCHAR AS w FROM t)
SELECT o_orderkey, CASE WHEN length(s) <= 3 THEN s ELSE regexp_replace(reverse(regexp_replace(reverse(substr(s, 1, length(s) - 3)), '(\d\d)', '\1,', 'g')), '^,', '') || ',' || right(s, 3) END || '.' || lpad((cents % 100)::VARCHAR, 2, '0') AS amount,
  CASE WHEN length(w) <= 3 THEN w ELSE regexp_replace(reverse(regexp_replace(reverse(substr(w, 1, length(w) - 3)), '(\d\d)', '\1,', 'g')), '^,', '') || ',' || right(w, 3) END AS whole FROM g"""
)
def formatted_amounts(spark, sf_dir):
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.format_inr(price, 2).alias("amount"), X.format_count(price).alias("whole"))


@query(
    r"""WITH d AS (SELECT doc_id, text, replace(text, ' ', chr(10) || chr(9) || ' ') AS page FROM documents),
s AS (SELECT doc_id, page, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM d),
n AS (SELECT doc_id, page, list_transform(CASE WHEN len(s) > 1 THEN s[2:] ELSE s END, lambda x: regexp_replace(x, '\s+', ' ', 'g')) AS n FROM s),
c AS (SELECT doc_id, page, list_filter(n, lambda x: length(x) >= 40 AND length(x) = list_max(list_transform(n, lambda y: length(y))))[1] AS candidate FROM n),
l AS (SELECT *, trim(regexp_replace(lower(page), '\s+', ' ', 'g')) AS hay, lower(candidate) AS needle FROM c WHERE candidate IS NOT NULL),
u AS (SELECT doc_id, candidate, CASE WHEN contains(hay, needle) AND NOT contains(substr(hay, instr(hay, needle) + 1), needle) THEN regexp_extract(page, array_to_string(list_transform(string_split(candidate, ' '), lambda w: regexp_escape(w)), '\s+')) END AS raw, page FROM l)
SELECT c.doc_id, sha256(c.candidate) AS candidate_sha256, instr(u.page, raw)::INTEGER AS start, length(raw)::INTEGER AS length FROM c LEFT JOIN u USING (doc_id)"""
)
def highlight_places(spark, sf_dir):
    """The sentence that a viewer marks, on pages whose words stand further apart."""
    t = F.col("text")
    rows = table(spark, sf_dir, "documents").select("doc_id", X.highlight(t, F.lit(False)).alias("candidate"), F.replace(t, F.lit(" "), F.lit("\n\t ")).alias("page"))
    return rows.select("doc_id", F.sha2("candidate", 256).alias("candidate_sha256"), X.raw_place(F.col("page"), F.col("candidate")).alias("at")).select("doc_id", "candidate_sha256", "at.start", "at.length")


# -- citations and calibration --------------------------------------------------------------------


@query(
    _RERANK
    + """, a AS (SELECT query_id, unnest([0, 1, 2]) AS place, unnest([first_page, 999999, first_page]) AS page_number FROM (SELECT query_id, min(page_number) FILTER (rank = 1) AS first_page FROM top GROUP BY 1)),
f AS (SELECT * FROM (SELECT query_id, page_number, doc_name, chunk_id, row_number() OVER (PARTITION BY query_id, page_number ORDER BY rank) AS x FROM top) WHERE x = 1)
SELECT query_id, place::INTEGER AS place, page_number::INTEGER AS page_number, coalesce(chunk_id, -1) AS chunk_id FROM a LEFT JOIN f USING (query_id, page_number)"""
)
def citation_resolve(spark, sf_dir):
    ranked = _ranked(spark, sf_dir).withColumn("doc_id", F.col("doc_name"))
    p = F.col("page_number").cast("string")
    answers = ranked.where("rank = 1").select("query_id", F.concat(F.lit("see [Page "), p, F.lit("], [page 999999] and [PAGE "), p, F.lit("].")).alias("answer"))
    return responses.resolve_markers(answers, ranked).select("query_id", "place", "page_number", F.coalesce("chunk_id", F.lit(-1)).alias("chunk_id"))


@query(
    _RERANK
    + r""", h AS (SELECT query_id, rank, regexp_replace(text, '[,\s]', '', 'g') AS t, fiscal_year FROM top)
SELECT query_id, coalesce(min(rank) FILTER (contains(t, query_id::VARCHAR) AND fiscal_year = 'en'), -1)::INTEGER AS expected_rank, coalesce(min(rank) FILTER (contains(t, query_id::VARCHAR)), -1)::INTEGER AS rank_any_basis FROM h GROUP BY 1"""
)
def digits_match_rank(spark, sf_dir):
    hits = _with_texts(spark, sf_dir, _ranked(spark, sf_dir)).withColumn("basis", F.col("fiscal_year"))
    probes = questions(spark, sf_dir).select("query_id", F.col("query_id").cast("string").alias("expect_figure"), F.lit("en").alias("expect_basis"))
    return calibration.first_hits(hits, probes).select("query_id", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("expected_rank", "rank_any_basis")))


_MEASURED = _RERANK + ", m AS (SELECT query_id, max(score) AS top, CASE query_id % 3 WHEN 0 THEN 'absent' WHEN 1 THEN 'pinned' ELSE 'open' END AS kind FROM top GROUP BY 1)"


def _measured(spark, sf_dir) -> DataFrame:
    top = _ranked(spark, sf_dir).groupBy("query_id").agg(F.max("rerank_score").alias("top"))
    return top.withColumn("kind", F.when(F.col("query_id") % 3 == 0, "absent").when(F.col("query_id") % 3 == 1, "pinned").otherwise("open"))


@query(_MEASURED + " SELECT kind, count(*) AS n, round(min(top), 6) AS lowest, round(median(top), 6) AS middle, round(max(top), 6) AS highest FROM m GROUP BY 1")
def calibration_summary(spark, sf_dir):
    return calibration.score_summary(_measured(spark, sf_dir)).select("kind", "n", r6("lowest"), r6("middle"), r6("highest"))


@query(
    _MEASURED
    + """, o AS (SELECT min(top) FILTER (kind <> 'absent') AS w, max(top) FILTER (kind = 'absent') AS b, median(top) FILTER (kind <> 'absent') AS md FROM m),
t AS (SELECT w > b AS separated, CASE WHEN w > b THEN round_even((w + b) / 2, 1) ELSE round_even(b + 0.1, 1) END AS floor, round_even(md, 1) AS high FROM o)
SELECT separated, floor, high, round_even((high + floor) / 2, 1) AS moderate FROM t"""
)
def threshold_recommendation(spark, sf_dir):
    return calibration.recommend(_measured(spark, sf_dir))


@query(
    _RERANK
    + rf""", parts AS (SELECT query_id, rank, '[Source ' || rank || '] ' || doc_name || ' | ' || fiscal_year || ' | Basis not determined | Page ' || page_number || chr(10) || substr(text, 1, 600) || CASE WHEN length(text) > 600 THEN '...' ELSE '' END AS part FROM top),
answers AS (SELECT query_id, '{responses.NO_ANSWER}' || chr(10) || chr(10) || string_agg(part, chr(10) || chr(10) ORDER BY rank) AS answer FROM parts GROUP BY 1)
SELECT query_id, sha256(answer) AS answer_sha256, length(answer)::INTEGER AS n_chars FROM answers"""
)
def extractive_answers(spark, sf_dir):
    ranked = _with_texts(spark, sf_dir, _ranked(spark, sf_dir)).withColumn("section_title", F.lit(None).cast("string"))
    return responses.extractive_answers(ranked).select("query_id", F.sha2("answer", 256).alias("answer_sha256"), F.length("answer").alias("n_chars"))


@query(
    _RERANK
    + rf""", lv AS (SELECT query_id, max(score) AS top, count(*) FILTER (score >= -2) AS supporting FROM top GROUP BY 1),
res AS (SELECT q.query_id, CASE WHEN top IS NULL OR top < -6 THEN 'insufficient' WHEN top >= 2 AND supporting >= 2 THEN 'high' WHEN top >= -2 THEN 'moderate' ELSE 'low' END AS level FROM q LEFT JOIN lv USING (query_id)),
src AS (SELECT query_id, list({{'rank': rank, 'chunk_id': chunk_id}} ORDER BY rank) AS sources FROM top GROUP BY 1),
parts AS (SELECT query_id, rank, '[Source ' || rank || '] ' || doc_name || ' | ' || fiscal_year || ' | Basis not determined | Page ' || page_number || chr(10) || substr(text, 1, 600) || CASE WHEN length(text) > 600 THEN '...' ELSE '' END AS part FROM top),
said AS (SELECT query_id, string_split('{responses.NO_ANSWER}' || chr(10) || chr(10) || string_agg(part, chr(10) || chr(10) ORDER BY rank), chr(10) || chr(10)) AS texts FROM parts GROUP BY 1),
fr AS (SELECT query_id, 0 AS seq, 'meta' AS event, to_json({{'query_id': query_id, 'level': level, 'sources': coalesce(sources, [])}})::VARCHAR AS data FROM res LEFT JOIN src USING (query_id)
  UNION ALL SELECT query_id, unnest(range(1, len(texts) + 1))::INTEGER, 'delta', to_json({{'text': unnest(texts)}})::VARCHAR FROM said JOIN res USING (query_id) WHERE level <> 'insufficient'
  UNION ALL SELECT query_id, CASE WHEN level = 'insufficient' THEN 1 ELSE coalesce(len(texts), 0) + 1 END, CASE WHEN level = 'insufficient' THEN 'abstained' ELSE 'done' END,
    CASE WHEN level <> 'insufficient' THEN '{{"answer_source":"extractive"}}' END FROM res LEFT JOIN said USING (query_id))
SELECT query_id, seq::INTEGER AS seq, event, coalesce(sha256(data), '') AS data_sha256 FROM fr"""
)
def result_frames(spark, sf_dir):
    ranked = keep(_with_texts(spark, sf_dir, _ranked(spark, sf_dir)).withColumn("section_title", F.lit(None).cast("string")), "ranked")
    results = confidence.assess(questions(spark, sf_dir), ranked)
    sources = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("sources"))
    frames = responses.result_frames(results, sources, responses.extractive_answers(ranked))
    # The wording of reasons is not compared.
    meta = F.regexp_replace("data", r'"reason":("(?:[^"\\\\]|\\\\.)*"|null),', "")
    data = F.when(F.col("event") == "meta", meta).when(F.col("event") != "abstained", F.col("data"))
    return frames.select("query_id", "seq", "event", F.coalesce(F.sha2(data, 256), F.lit("")).alias("data_sha256"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_events(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def flagship(spark, sf_dir) -> DataFrame:
    """A batch of questions through both lanes, merged, reranked and assessed."""
    return confidence_levels(spark, sf_dir)


