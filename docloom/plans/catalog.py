"""Named queries over the test tables, each with the SQL that states the same where SQL can."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.models import HashedWords, embedded
from docloom.operators import blocks as bk
from docloom.operators import chunks as ck
from docloom.operators import context as cx
from docloom.operators import index as ix
from docloom.operators import retrieval as rt
from docloom.operators import segments as sg
from docloom.sources.documents import html_to_markdown
from docloom.sources.tables import scratch, scratch_dir

QUERY = "the of and thand, the zzzabsent Reouha"
RARE = "reouha zzzabsent"
K, N = 50, 4
PUNCT_SQL = tx.PUNCTUATION.replace("'", "''")
RUN: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        RUN[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def tok(c: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower(coalesce({c}, '')), '{PUNCT_SQL}', '', 'g'), '\\s+'), lambda t: length(t) > 1)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


# --- derived inputs ---------------------------------------------------------
def md_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, line: the lines of documents, some turned into headings, rows, fences, comments or numbers by a digest."""
    raw = documents(spark, sf_dir).select("doc_id", F.posexplode(tx.lines(F.col("text"))).alias("pos", "raw"))
    d = F.substring(F.md5(F.concat("raw", F.lit(":"), F.col("pos").cast("string"))), 1, 1)
    head = tx.strip(F.substring("raw", 1, 30))
    line = (
        F.when(d == "0", F.concat(F.lit("# "), head)).when(d == "1", F.concat(F.lit("## "), head)).when(d == "2", F.concat(F.lit("#### "), head))
        .when(d == "3", F.concat(F.lit("| "), F.replace(F.substring("raw", 1, 60), F.lit(" "), F.lit(" | ")), F.lit(" |"))).when(d == "4", "```").when(d == "5", "<!-- c -->").when(d == "6", "42").when(d == "7", "").when(d == "8", "# Funding")
        .otherwise(F.col("raw"))
    )
    return raw.select("doc_id", "pos", tx.rstrip(line).alias("line"))


LINES_SQL = "lines AS (SELECT doc_id, unnest(range(len(l)))::BIGINT AS pos, unnest(l) AS raw FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents))"
MD_SQL = (
    LINES_SQL
    + """, dig AS (SELECT *, substr(md5(raw || ':' || pos::VARCHAR), 1, 1) AS d, trim(substr(raw, 1, 30)) AS head FROM lines),
md AS (SELECT doc_id, pos, rtrim(CASE d WHEN '0' THEN '# ' || head WHEN '1' THEN '## ' || head WHEN '2' THEN '#### ' || head
 WHEN '3' THEN '| ' || replace(substr(raw, 1, 60), ' ', ' | ') || ' |' WHEN '4' THEN '```' WHEN '5' THEN '<!-- c -->' WHEN '6' THEN '42' WHEN '7' THEN '' WHEN '8' THEN '# Funding' ELSE raw END) AS line FROM dig),
fenced AS (SELECT *, starts_with(line, '```') AS fence, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM md),
inner_ AS (SELECT *, (upto % 2 = 1) OR fence AS inside FROM fenced),
levels AS (SELECT *, CASE WHEN NOT inside AND regexp_matches(line, '^(#{1,6})\\s+(.+)') THEN length(regexp_extract(line, '^(#{1,6})\\s+(.+)', 1)) END AS level, CASE WHEN NOT inside AND regexp_matches(line, '^(#{1,6})\\s+(.+)') THEN trim(regexp_extract(line, '^(#{1,6})\\s+(.+)', 2)) END AS title FROM inner_),
known AS (SELECT *, NOT inside AND level IS NULL AND regexp_matches(trim(line), '^(?:[^\\p{L}\\p{N}_]{0,3}|[^\\x00-\\x7F]{1,3}|\\s*\\d+\\s*|<!--.*-->)$') AS junk,
 sum(CASE WHEN level IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM levels)"""
)
STACK_SQL = ", ".join(f"last_value(CASE WHEN level <= {k} THEN {{'l': level, 't': title}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS h{k}" for k in range(1, 7))
BLOCK_SQL = (
    MD_SQL
    + f""", stacked AS (SELECT *, {STACK_SQL} FROM known),
body AS (SELECT doc_id, block, pos, line, list_filter([{", ".join(f"CASE WHEN h{k}.l = {k} THEN h{k}.t END" for k in range(1, 7))}], lambda t: t IS NOT NULL) AS stack FROM stacked WHERE level IS NULL AND NOT junk),
blocks AS (SELECT doc_id, block::BIGINT AS block, first(stack ORDER BY pos) AS stack, trim(string_agg(line, chr(10) ORDER BY pos), ' ' || chr(10) || chr(9)) AS text FROM body GROUP BY doc_id, block),
full_blocks AS (SELECT * FROM blocks WHERE text <> '')"""
)


def md_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bk.heading_blocks(md_lines(spark, sf_dir))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of documents as chunks."""
    rows = documents(spark, sf_dir).select(F.concat(F.lit("doc_"), "doc_id").alias("doc_id"), F.array("lang", "source").alias("section_path"), F.col("source").alias("heading"), F.concat("source", F.lit(".pdf")).alias("source_file"), F.posexplode(tx.lines(F.col("text"))).alias("chunk_index", "text"))
    text = F.col("text")
    return rows.where("text <> ''").select(tx.chunk_id(F.col("doc_id"), F.col("chunk_index"), text).alias("chunk_id"), "doc_id", "source_file", F.col("chunk_index").cast("long").alias("chunk_index"), "section_path", "heading", "text", F.length("text").cast("long").alias("char_count"), tx.has_table(text).alias("has_table"), tx.has_formula(text).alias("has_formula"), tx.has_code(text).alias("has_code"))


PASSAGE_SQL = """raw AS (SELECT 'doc_' || doc_id AS doc_id, [lang, source] AS section_path, source AS heading, source || '.pdf' AS source_file, unnest(range(len(l)))::BIGINT AS chunk_index, unnest(l) AS text FROM (SELECT *, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents)),
passages AS (SELECT doc_id || '_' || lpad(chunk_index::VARCHAR, greatest(4, length(chunk_index::VARCHAR))::INTEGER, '0') || '_' || substr(md5(doc_id || ':' || chunk_index::VARCHAR || ':' || substr(text, 1, 60)), 1, 8) AS chunk_id, doc_id, source_file, chunk_index, section_path, heading, text, length(text)::BIGINT AS char_count,
 regexp_matches(text, '(?m)^\\|.+\\|') AS has_table, regexp_matches(text, '\\$.+\\$') AS has_formula, regexp_matches(text, '(?m)^```') AS has_code FROM raw WHERE text <> '')"""
TOP_SQL = PASSAGE_SQL + ", top AS (SELECT * FROM (SELECT *, heading AS qid, row_number() OVER (PARTITION BY heading ORDER BY char_count DESC, chunk_id) - 1 AS rank FROM passages) WHERE rank < 8)"


def top_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight longest passages of each source, as if ranked for a query named like it."""
    order = Window.partitionBy("heading").orderBy(F.desc("char_count"), "chunk_id")
    return passages(spark, sf_dir).withColumn("qid", F.col("heading")).withColumn("rank", (F.row_number().over(order) - 1).cast("long")).where("rank < 8")


# --- scalar text --------------------------------------------------------------
@query("SELECT page_id, regexp_replace(url, '[^\\p{L}\\p{N}_]+', '_', 'g') AS doc_id FROM pages")
def doc_id_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.document_id(F.col("url")).alias("doc_id"))


@query(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {tok('text')} AS t FROM documents)")
def tokenize(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


THINK_SQL = "WITH t AS (SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN '<think>a</think> ' || text WHEN 1 THEN '<think>' || text ELSE text END AS raw FROM conversations) "


def thinking(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    k = F.col("turn") % 3
    return c.withColumn("raw", F.when(k == 0, F.concat(F.lit("<think>a</think> "), "text")).when(k == 1, F.concat(F.lit("<think>"), "text")).otherwise(F.col("text")))


@query(THINK_SQL + f"SELECT conv_id, turn, CASE WHEN NOT contains(raw, '<think>') THEN trim(raw, ' ' || chr(10)) WHEN contains(raw, '</think>') THEN trim(regexp_extract(raw, '(?s)^.*</think>(.*)$', 1), ' ' || chr(10)) ELSE '{tx.CUT_OFF}' END AS answer FROM t")
def strip_think(spark, sf_dir):
    return thinking(spark, sf_dir).select("conv_id", "turn", tx.final_answer(F.col("raw")).alias("answer"))


@query(THINK_SQL + ", d AS (SELECT *, trim(CASE WHEN contains(raw, '<think>') AND contains(raw, '</think>') THEN regexp_extract(raw, '(?s)^.*</think>(.*)$', 1) ELSE raw END, ' ' || chr(10)) AS p FROM (SELECT * REPLACE (CASE WHEN turn % 4 = 0 THEN 'short' ELSE raw END AS raw) FROM t)) SELECT conv_id, turn, CASE WHEN length(p) < 10 THEN text ELSE p END AS search FROM d")
def hyde_fallback(spark, sf_dir):
    t = thinking(spark, sf_dir).withColumn("raw", F.when(F.col("turn") % 4 == 0, "short").otherwise(F.col("raw")))
    return t.select("conv_id", "turn", tx.rewritten_query(F.col("raw"), F.col("text")).alias("search"))


HTML_SQL = "regexp_replace(html, '<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>|<nav\\b.*?</nav>|<footer\\b.*?</footer>|<title\\b.*?</title>', '', 'gsi')"
for _k in range(1, 7):
    HTML_SQL = f"regexp_replace({HTML_SQL}, '<h{_k}\\b[^>]*>(.*?)</h{_k}>', chr(10) || '{'#' * _k} \\1' || chr(10), 'gsi')"
HTML_SQL = f"regexp_replace({HTML_SQL}, '<li\\b[^>]*>', chr(10) || '- ', 'gsi')"
HTML_SQL = f"regexp_replace({HTML_SQL}, '</?pre\\b[^>]*>', chr(10) || '```' || chr(10), 'gsi')"
HTML_SQL = f"regexp_replace({HTML_SQL}, '</?(p|div|br|ul|ol|article|section|body|html|head)\\b[^>]*>', chr(10), 'gsi')"
HTML_SQL = f"regexp_replace({HTML_SQL}, '<[^>]*>', '', 'gs')"
for _e, _s in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    HTML_SQL = f"replace({HTML_SQL}, '{_e}', '{_s}')"
HTML_SQL = f"regexp_replace(regexp_replace({HTML_SQL}, '\\n{{2,}}', chr(10), 'g'), '\\A\\n|\\n\\z', '', 'g')"


@query(f"SELECT page_id, {HTML_SQL} AS md FROM pages")
def html_to_markdown_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html_to_markdown(F.col("html")).alias("md"))


# --- structure ------------------------------------------------------------------
@query(f"WITH {LINES_SQL} SELECT doc_id, pos, rtrim(raw) AS line FROM lines")
def line_explode(spark, sf_dir):
    return bk.line_table(documents(spark, sf_dir).withColumnRenamed("text", "md")).select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


@query(f"WITH {MD_SQL} SELECT doc_id, pos, line FROM known WHERE NOT junk")
def junk_filter(spark, sf_dir):
    return bk.classified(md_lines(spark, sf_dir)).where("not junk").select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


@query(f"WITH {BLOCK_SQL} SELECT doc_id, block, array_to_string(stack, ' > ') AS path, text FROM full_blocks")
def heading_blocks(spark, sf_dir):
    return md_blocks(spark, sf_dir).select("doc_id", "block", F.array_join("heading_stack", " > ").alias("path"), "text")


@query(f"WITH {BLOCK_SQL} SELECT doc_id, block, text FROM full_blocks WHERE NOT coalesce(regexp_matches(stack[-1], '{tx.SKIPPED}'), false)")
def skip_noise_sections(spark, sf_dir):
    return bk.without_noise(md_blocks(spark, sf_dir)).select("doc_id", "block", "text")


def parts_sql(blocks: str) -> str:
    """parts (doc_id, block, part, kind, text) of a table of blocks."""
    return f"""l2 AS (SELECT doc_id, block, unnest(range(len(l)))::BIGINT AS pos, unnest(l) AS line FROM (SELECT doc_id, block, string_split(text, chr(10)) AS l FROM {blocks})),
f2 AS (SELECT *, starts_with(line, '```') AS fence, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, block ORDER BY pos) AS upto FROM l2),
k2 AS (SELECT *, fence AND upto % 2 = 1 AS opening, CASE WHEN fence OR upto % 2 = 1 THEN 'code' WHEN regexp_matches(line, '^\\|.+\\|') THEN 'table' ELSE 'text' END AS kind FROM f2),
c2 AS (SELECT *, opening OR coalesce(lag(kind) OVER (PARTITION BY doc_id, block ORDER BY pos) <> kind, true) AS change FROM k2),
p2 AS (SELECT *, sum(CASE WHEN change THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, block ORDER BY pos) AS part FROM c2),
parts AS (SELECT doc_id, block, part::BIGINT AS part, kind, trim(string_agg(line, chr(10) ORDER BY pos), ' ' || chr(10) || chr(9)) AS text FROM p2 GROUP BY doc_id, block, part, kind)"""


@query(f"WITH {BLOCK_SQL}, {parts_sql('full_blocks')} SELECT * FROM parts")
def subblock_segments(spark, sf_dir):
    return bk.sub_blocks(md_blocks(spark, sf_dir)).select("doc_id", "block", "part", "kind", "text")


def table_sql(tables: str) -> str:
    """table_pieces (doc_id, piece, text) of tables (doc_id, text). A piece goes on from the row after the last piece's end to the first row that brings it over the limit."""
    return f"""trows AS (SELECT doc_id, i, r, sum(length(r) + 1) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS p FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS r FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda r: trim(r) <> '') AS l FROM {tables}))),
theads AS (SELECT doc_id, max(i) AS n, max(p) FILTER (i <= 2) AS hp, string_agg(r, chr(10) ORDER BY i) FILTER (i <= 2) AS head FROM trows GROUP BY doc_id),
tcuts(doc_id, piece, s, e) AS (SELECT h.doc_id, 0::BIGINT, 3::BIGINT, (SELECT min(i) FROM trows t WHERE t.doc_id = h.doc_id AND t.i >= 3 AND t.p - 1 > {sg.MAX_CHARS}) FROM theads h WHERE h.n > 2
 UNION ALL SELECT c.doc_id, c.piece + 1, c.e + 1, (SELECT min(t.i) FROM trows t JOIN theads g ON g.doc_id = t.doc_id JOIN trows b ON b.doc_id = t.doc_id AND b.i = c.e WHERE t.doc_id = c.doc_id AND t.i > c.e AND g.hp + t.p - b.p - 1 > {sg.MAX_CHARS}) FROM tcuts c JOIN theads h ON h.doc_id = c.doc_id WHERE c.e < h.n),
table_pieces AS (SELECT c.doc_id, c.piece, any_value(h.head) || chr(10) || string_agg(t.r, chr(10) ORDER BY t.i) AS text FROM tcuts c JOIN theads h ON h.doc_id = c.doc_id JOIN trows t ON t.doc_id = c.doc_id AND t.i >= c.s AND t.i <= coalesce(c.e, h.n) GROUP BY c.doc_id, c.piece UNION ALL SELECT doc_id, 0, head FROM theads WHERE n <= 2)"""


@query(f"WITH RECURSIVE wide AS (SELECT doc_id, array_to_string(list_transform(string_split(regexp_replace(text, '\\n$', ''), chr(10)), lambda r: '| ' || r || ' |'), chr(10)) AS text FROM documents), {table_sql('wide')} SELECT doc_id, piece, text FROM table_pieces")
def table_split(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.array_join(F.transform(tx.lines(F.col("text")), lambda r: F.concat(F.lit("| "), r, F.lit(" |"))), "\n").alias("table"))
    return rows.select("doc_id", F.posexplode(sg.table_pieces(F.col("table"))).alias("piece", "text")).select("doc_id", F.col("piece").cast("long").alias("piece"), "text")


def sent_sql(texts: str = "documents") -> str:
    return f"sents AS (SELECT doc_id, unnest(range(len(l)))::BIGINT AS i, unnest(l) AS s FROM (SELECT doc_id, list_filter(string_split(regexp_replace(trim(text, ' ' || chr(10)), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS l FROM {texts}))"


SENT_SQL = sent_sql()


@query(f"WITH {SENT_SQL} SELECT doc_id, i, s FROM sents")
def sentence_split(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.posexplode(sg.sentences(F.col("text"))).alias("i", "s")).select("doc_id", F.col("i").cast("long").alias("i"), "s")


def sim_sql(texts: str = "documents") -> str:
    return (
        sent_sql(texts)
        + f""", words AS (SELECT doc_id, i, ('0x' || substr(md5(t), 1, 8))::UINTEGER % {sg.DIMS} AS b FROM (SELECT doc_id, i, unnest({tok('s')}) AS t FROM sents)),
bags AS (SELECT doc_id, i, b, count(*) AS n FROM words GROUP BY ALL), norms AS (SELECT doc_id, i, sum(n * n)::BIGINT AS nn FROM bags GROUP BY ALL),
dots AS (SELECT a.doc_id, a.i, sum(a.n * b.n)::BIGINT AS d FROM bags a JOIN bags b ON a.doc_id = b.doc_id AND b.i = a.i + 1 AND a.b = b.b GROUP BY ALL),
sims AS (SELECT x.doc_id, x.i, CASE WHEN p.nn > 0 AND q.nn > 0 THEN coalesce(d.d, 0) / (sqrt(p.nn) * sqrt(q.nn)) ELSE 0.0 END AS sim FROM sents x JOIN sents y ON x.doc_id = y.doc_id AND y.i = x.i + 1
 LEFT JOIN norms p ON p.doc_id = x.doc_id AND p.i = x.i LEFT JOIN norms q ON q.doc_id = x.doc_id AND q.i = x.i + 1 LEFT JOIN dots d ON d.doc_id = x.doc_id AND d.i = x.i)"""
    )


SIM_SQL = sim_sql()


@query(f"WITH {SIM_SQL} SELECT doc_id, i, round(sim, 6) AS sim FROM sims")
def adjacent_similarity(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", sg.sentences(F.col("text")).alias("sents")).select("doc_id", F.posexplode(sg.adjacent_similarities(F.col("sents"))).alias("i", "sim"))
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), F.round("sim", 6).alias("sim"))


LIMIT_SQL = """limits AS (SELECT doc_id, least(CASE WHEN t >= 0.5 THEN b - (b - a) * (1.0::DOUBLE - t) ELSE a + (b - a) * t END, 0.75::DOUBLE) AS lim FROM
 (SELECT doc_id, y[lo + 1] AS a, y[least(lo + 1, len(y) - 1) + 1] AS b, v - lo AS t FROM (SELECT doc_id, y, v, floor(v)::BIGINT AS lo FROM (SELECT doc_id, y, (len(y) - 1) * 0.3::DOUBLE AS v FROM (SELECT doc_id, list(sim ORDER BY sim) AS y FROM sims GROUP BY doc_id)))))"""


@query(f"WITH {SIM_SQL}, {LIMIT_SQL} SELECT doc_id, round(lim, 6) AS threshold FROM limits")
def adaptive_threshold(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", sg.adjacent_similarities(sg.sentences(F.col("text"))).alias("sims")).where(F.size("sims") > 0)
    return rows.select("doc_id", F.round(sg.threshold(F.col("sims")), 6).alias("threshold"))


def prose_sql(texts: str) -> str:
    """prose_pieces (doc_id, piece, text) of texts (doc_id, text), stripped, with sents, sims and limits in place. A piece goes on to the first sentence at which the packing rule ends it."""
    return f"""known_texts AS (SELECT t.doc_id, t.text, length(t.text) > {sg.SHORT} AND count(s.i) > 1 AS many FROM {texts} t LEFT JOIN sents s ON s.doc_id = t.doc_id GROUP BY t.doc_id, t.text),
spans AS (SELECT s.doc_id, s.i, s.s, length(s.s) AS n, coalesce(sum(length(s.s) + 1) OVER (PARTITION BY s.doc_id ORDER BY s.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, coalesce(p.sim < l.lim, false) AS apart FROM sents s JOIN known_texts k ON k.doc_id = s.doc_id AND k.many LEFT JOIN sims p ON p.doc_id = s.doc_id AND p.i = s.i - 1 LEFT JOIN limits l ON l.doc_id = s.doc_id),
packs(doc_id, piece, first, base, nxt) AS (SELECT k.doc_id, 0::BIGINT, 0::BIGINT, 1::BIGINT, (SELECT min(j.i) FROM spans j WHERE j.doc_id = k.doc_id AND j.i > 0 AND (j.apart AND j.before - 1 > {sg.SPLIT_FROM} OR j.before - 1 + j.n > {sg.MAX_CHARS})) FROM known_texts k WHERE k.many
 UNION ALL SELECT c.doc_id, c.piece + 1, c.nxt, b.before, (SELECT min(j.i) FROM spans j JOIN spans f ON f.doc_id = j.doc_id AND f.i = c.nxt WHERE j.doc_id = c.doc_id AND j.i > c.nxt AND (j.apart AND j.before - f.before > {sg.SPLIT_FROM} OR j.before - f.before + j.n > {sg.MAX_CHARS})) FROM packs c JOIN spans b ON b.doc_id = c.doc_id AND b.i = c.nxt),
raw_pieces AS (SELECT c.doc_id, c.piece, string_agg(j.s, ' ' ORDER BY j.i) AS text FROM packs c JOIN spans j ON j.doc_id = c.doc_id AND j.i >= c.first AND (c.nxt IS NULL OR j.i < c.nxt) GROUP BY c.doc_id, c.piece),
grouped AS (SELECT *, sum(CASE WHEN piece = 0 OR length(text) >= {sg.MIN_PIECE} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY piece) AS g FROM raw_pieces),
whole_pieces AS (SELECT doc_id, g, string_agg(text, ' ' ORDER BY piece) AS text FROM grouped GROUP BY doc_id, g UNION ALL SELECT doc_id, 0, text FROM known_texts WHERE NOT many),
prose_pieces AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS piece, text FROM whole_pieces WHERE length(text) >= {sg.MIN_CHARS})"""


@query(f"WITH RECURSIVE plain_texts AS (SELECT doc_id, trim(text, ' ' || chr(10)) AS text FROM documents), {sim_sql('plain_texts')}, {LIMIT_SQL}, {prose_sql('plain_texts')} SELECT * FROM prose_pieces")
def semantic_chunks(spark, sf_dir):
    made = sg.prose_pieces(documents(spark, sf_dir).select("doc_id", tx.strip(F.col("text")).alias("text")))
    return made.select("doc_id", F.posexplode("pieces").alias("piece", "text")).select("doc_id", F.col("piece").cast("long").alias("piece"), "text")


CHUNK_SQL = f"""{BLOCK_SQL}, told AS (SELECT *, length(text) <= {sg.MAX_CHARS} AND NOT regexp_matches(text, '(?m)^\\|.+\\|') AND NOT contains(text, '```') AS plain FROM full_blocks WHERE NOT coalesce(regexp_matches(stack[-1], '{tx.SKIPPED}'), false)),
mixed AS (SELECT * FROM told WHERE NOT plain), {parts_sql('mixed')}, large AS (SELECT *, doc_id || ':' || block || ':' || part AS key FROM parts WHERE length(text) >= {sg.MIN_CHARS}),
tabs AS (SELECT key AS doc_id, text FROM large WHERE kind = 'table'), prose AS (SELECT key AS doc_id, text FROM large WHERE kind = 'text'),
{table_sql('tabs')}, {sim_sql('prose')}, {LIMIT_SQL}, {prose_sql('prose')},
wins AS (SELECT doc_id, block, 0::BIGINT AS part, 0::BIGINT AS piece, text, NULL::BOOLEAN AS wt, NULL::BOOLEAN AS wc FROM told WHERE plain AND length(text) >= {sg.MIN_CHARS}
 UNION ALL SELECT doc_id, block, part, 0, text, NULL, true FROM large WHERE kind = 'code'
 UNION ALL SELECT l.doc_id, l.block, l.part, t.piece, t.text, true, NULL FROM large l JOIN table_pieces t ON t.doc_id = l.key WHERE length(t.text) >= {sg.MIN_CHARS}
 UNION ALL SELECT l.doc_id, l.block, l.part, t.piece, t.text, NULL, NULL FROM large l JOIN prose_pieces t ON t.doc_id = l.key),
numbered AS (SELECT w.*, t.stack, row_number() OVER (PARTITION BY w.doc_id ORDER BY w.block, w.part, w.piece) - 1 AS local, CASE WHEN len(t.stack) > 0 THEN array_to_string(t.stack, ' > ') || chr(10) || chr(10) ELSE '' END || w.text AS whole FROM wins w JOIN told t ON t.doc_id = w.doc_id AND t.block = w.block),
named AS (SELECT *, 'doc_' || doc_id AS doc, 'doc_' || doc_id || '_' || lpad(local::VARCHAR, greatest(4, length(local::VARCHAR))::INTEGER, '0') || '_' || substr(md5('doc_' || doc_id || ':' || local || ':' || substr(whole, 1, 60)), 1, 8) AS chunk_id FROM numbered)"""


@query(
    f"""WITH RECURSIVE {CHUNK_SQL} SELECT chunk_id, doc AS doc_id, 'a.pdf' AS source_file, local AS chunk_index, array_to_string(stack, ' > ') AS path, stack[-1] AS heading, whole AS text, length(whole)::BIGINT AS char_count,
 coalesce(wt, regexp_matches(text, '(?m)^\\|.+\\|')) AS has_table, contains(text, '{tx.FORMULA_TAG}') OR regexp_matches(text, '\\$.+\\$') AS has_formula, coalesce(wc, regexp_matches(text, '(?m)^```')) AS has_code,
 lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM named WINDOW w AS (PARTITION BY doc_id ORDER BY local)"""
)
def chunk_table(spark, sf_dir):
    md = md_lines(spark, sf_dir).groupBy("doc_id").agg(F.array_join(cx.in_order("pos", "line"), "\n").alias("md"))
    chunks = ck.chunk_markdown(md.select(F.concat(F.lit("doc_"), "doc_id").alias("doc_id"), F.lit("a.pdf").alias("source_file"), F.lit(0).alias("slice_start"), "md"))
    return chunks.withColumn("path", F.array_join("section_path", " > ")).drop("section_path")


@query(f"WITH {PASSAGE_SQL} SELECT chunk_id, doc_id, chunk_index, char_count, has_table, has_formula, has_code FROM passages")
def chunk_ids(spark, sf_dir):
    return passages(spark, sf_dir).select("chunk_id", "doc_id", "chunk_index", "char_count", "has_table", "has_formula", "has_code")


@query(f"WITH {PASSAGE_SQL} SELECT chunk_id, row_number() OVER w - 1 AS chunk_index, lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM passages WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index // 20, chunk_index)")
def chunk_links(spark, sf_dir):
    sliced = passages(spark, sf_dir).withColumn("slice_start", F.expr("chunk_index div 20")).withColumn("local", F.col("chunk_index")).drop("chunk_index")
    return ck.linked(sliced).select("chunk_id", "chunk_index", "prev_chunk_id", "next_chunk_id")


@query('WITH p AS (SELECT doc_id, 1 + n_chars // 500 AS n FROM documents) SELECT doc_id, s AS start, least(s + 20, n) AS "end" FROM (SELECT doc_id, n, unnest(range(0, n, 20)) AS s FROM p)')
def page_slices(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select("doc_id", F.expr("1 + n_chars div 500").alias("n_pages"))
    return ck.page_slices(pages).select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


# --- index -----------------------------------------------------------------------
@query(f"WITH {PASSAGE_SQL} SELECT DISTINCT chunk_id, doc_id FROM passages WHERE NOT md5(chunk_id) < '8'")
def index_new_chunks(spark, sf_dir):
    all_chunks = passages(spark, sf_dir)
    return ix.new_chunks(all_chunks, all_chunks.where(F.md5("chunk_id") < "8")).select("chunk_id", "doc_id")


@query(f"WITH {PASSAGE_SQL} SELECT chunk_id, char_count + CASE WHEN md5(chunk_id) < '8' THEN 1 ELSE 0 END AS char_count, CASE WHEN md5(chunk_id) < '8' THEN 2 ELSE 1 END AS version FROM passages")
def index_upsert(spark, sf_dir):
    stored = passages(spark, sf_dir).select("chunk_id", "char_count", F.lit(1).alias("version"))
    again = stored.where(F.md5("chunk_id") < "8").select("chunk_id", (F.col("char_count") + 1).alias("char_count"), F.lit(2).alias("version"))
    return ix.upserted(stored, again)


@query(f"WITH {PASSAGE_SQL} SELECT chunk_id, chunk_index, nullif(heading, 'src1') AS heading, array_to_string(section_path, '/') AS path, has_table, lag(chunk_id) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS prev_chunk_id FROM passages")
def index_metadata_roundtrip(spark, sf_dir):
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    full = passages(spark, sf_dir).withColumn("heading", F.nullif(F.col("heading"), F.lit("src1"))).withColumn("prev_chunk_id", F.lag("chunk_id").over(order)).withColumn("next_chunk_id", F.lead("chunk_id").over(order))
    return ix.from_metadata(ix.to_metadata(full)).select("chunk_id", "chunk_index", "heading", F.array_join("section_path", "/").alias("path"), "has_table", "prev_chunk_id")


# --- retrieval ----------------------------------------------------------------------
BM_SQL = f"""toks AS (SELECT doc_id, {tok('text')} AS t FROM documents), lens AS (SELECT doc_id, len(t) AS dl FROM toks), stat AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raws AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, stat), lex AS (SELECT term, df, CASE WHEN raw < 0 THEN {rt.EPSILON} * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws)"""


def bm_sql(queries: str, k: int) -> str:
    return (
        BM_SQL
        + f""", q0 AS ({queries}), qt AS (SELECT qid, term, count(*) AS qn FROM (SELECT qid, unnest({tok('text')}) AS term FROM q0) GROUP BY ALL),
part AS (SELECT qid, p.doc_id, round(sum(qn * idf * tf * {rt.K1 + 1} / (tf + {rt.K1} * (1 - {rt.B} + {rt.B} * dl / avgdl))), 9) AS score FROM qt JOIN lex USING (term) JOIN post p USING (term) JOIN lens USING (doc_id), stat GROUP BY qid, p.doc_id),
every AS (SELECT q.qid, l.doc_id, coalesce(score, 0) AS score FROM (SELECT DISTINCT qid FROM qt) q CROSS JOIN lens l LEFT JOIN part p ON p.qid = q.qid AND p.doc_id = l.doc_id),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) - 1 AS rank FROM every) WHERE rank < {k})"""
    )


_indexes: dict[tuple[str, str], rt.KeywordIndex] = {}


def keyword_index(spark: SparkSession, sf_dir: str) -> rt.KeywordIndex:
    """The keyword index of documents, built by the first query of a session that searches it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        _indexes[key] = rt.KeywordIndex.build(documents(spark, sf_dir), "doc_id", f"{scratch_dir(spark)}/keywords-{uuid.uuid4().hex}")
    return _indexes[key]


_vectors: dict[tuple[str, str], DataFrame] = {}


def stored_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos and bag of documents, the stand-in for stored embeddings, made by the first query of a session that needs it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _vectors:
        _vectors[key] = scratch(rt.token_table(documents(spark, sf_dir), "doc_id").select("pos", rt.hashed_bags(F.col("tokens"), 64).alias("bag")), "bags")
    return _vectors[key]


def one_query(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(0, text)], "qid long, text string")


@query(f"WITH {BM_SQL} SELECT n AS n_docs, round(avgdl, 6) AS avg_len FROM stat")
def bm25_corpus_stats(spark, sf_dir):
    return rt.corpus_stats(rt.token_table(documents(spark, sf_dir), "doc_id")).select("n_docs", F.round("avg_len", 6).alias("avg_len"))


@query(f"WITH {BM_SQL} SELECT doc_id, term, tf FROM post")
def bm25_postings(spark, sf_dir):
    return rt.postings(rt.token_table(documents(spark, sf_dir), "doc_id")).select(F.col("pos").alias("doc_id"), "term", "tf")


@query(f"WITH {BM_SQL} SELECT term, df, round(idf, 6) AS idf FROM lex")
def bm25_lexicon_idf(spark, sf_dir):
    return keyword_index(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def shown(found: DataFrame) -> DataFrame:
    return found.select("qid", F.col("pos").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(f"WITH {bm_sql(f'''SELECT 0::BIGINT AS qid, '{QUERY}' AS text''', K)} SELECT qid, doc_id, round(score, 6) AS score, rank FROM bm")
def bm25_topk(spark, sf_dir):
    return shown(keyword_index(spark, sf_dir).search(one_query(spark, QUERY), K))


@query(f"WITH {bm_sql(f'''SELECT 0::BIGINT AS qid, '{RARE}' AS text''', K)} SELECT qid, doc_id, round(score, 6) AS score, rank FROM bm")
def bm25_zero_score_fill(spark, sf_dir):
    return shown(keyword_index(spark, sf_dir).search(one_query(spark, RARE), K))


@query(f"WITH {bm_sql('SELECT item_id AS qid, text FROM benchmark', 10)} SELECT qid, doc_id, round(score, 6) AS score, rank FROM bm")
def bm25_batch_topk(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return shown(keyword_index(spark, sf_dir).search(asked, 10))


DOT_SQL = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


@query(f"WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round({DOT_SQL.format(a='embedding', b='e')} / (sqrt({DOT_SQL.format(a='embedding', b='embedding')}) * sqrt({DOT_SQL.format(a='e', b='e')})), 9) AS score FROM embeddings, q) SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS rank FROM s ORDER BY score DESC, vec_id LIMIT {K}")
def dense_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id = 0").first()["embedding"]
    return rt.dense_topk(vectors, "vec_id", "embedding", asked, K).select(F.col("pos").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query(f"WITH q AS (SELECT vec_id AS qid, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT qid, vec_id, round({DOT_SQL.format(a='embedding', b='e')} / (sqrt({DOT_SQL.format(a='embedding', b='embedding')}) * sqrt({DOT_SQL.format(a='e', b='e')})), 9) AS score FROM embeddings, q), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) - 1 AS rank FROM s) SELECT qid, vec_id, round(score, 6) AS score, rank FROM r WHERE rank < 10")
def dense_batch_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return rt.dense_batch_topk(vectors, "vec_id", "embedding", asked, 10).select("qid", F.col("pos").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query(f"WITH n AS (SELECT vec_id, embedding AS e, sqrt({DOT_SQL.format(a='embedding', b='embedding')}) AS nn FROM embeddings) SELECT vec_id, round(e[1]::DOUBLE / nn, 6) AS first, round(e[64]::DOUBLE / nn, 6) AS last FROM n")
def l2_normalize(spark, sf_dir):
    unit = table(spark, sf_dir, "embeddings").select("vec_id", tx.normalised(F.col("embedding")).alias("u"))
    return unit.select("vec_id", F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(F.get("u", F.lit(63)), 6).alias("last"))


HYBRID_SQL = (
    bm_sql(f"SELECT 0::BIGINT AS qid, '{QUERY}' AS text", K)
    + f""", qb AS (SELECT ('0x' || substr(md5(t), 1, 8))::UINTEGER % 64 AS b, count(*) AS q FROM (SELECT unnest({tok(f"'{QUERY}'")}) AS t) GROUP BY 1),
db AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 8))::UINTEGER % 64 AS b, sum(tf)::BIGINT AS n FROM post GROUP BY ALL),
dense0 AS (SELECT doc_id, round(sum(n * coalesce(q, 0))::BIGINT / (sqrt(sum(n * n)::BIGINT) * sqrt((SELECT sum(q * q)::BIGINT FROM qb))), 9) AS score FROM db LEFT JOIN qb USING (b) GROUP BY doc_id),
dense AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM dense0 ORDER BY score DESC, doc_id LIMIT {K}),
fused AS (SELECT coalesce(d.doc_id, b.doc_id) AS doc_id, coalesce(1.0::DOUBLE / (d.rank + {rt.RRF_K}), 0) + coalesce(1.0::DOUBLE / (b.rank + {rt.RRF_K}), 0) AS score, d.rank AS dr, b.rank AS br FROM dense d FULL JOIN bm b ON d.doc_id = b.doc_id),
hybrid AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, dr ASC NULLS LAST, br ASC NULLS LAST) - 1 AS rank FROM fused ORDER BY rank LIMIT {K})"""
)


def hybrid(spark, sf_dir) -> DataFrame:
    words = one_query(spark, QUERY).select(tx.tokens(F.col("text")).alias("t")).first().t
    dense = rt.ranked(rt.hashed_scores(stored_bags(spark, sf_dir), words, 64), K)
    return rt.rrf(dense, keyword_index(spark, sf_dir).search(one_query(spark, QUERY), K), K)


@query(f"WITH {HYBRID_SQL} SELECT doc_id, round(score, 6) AS score, rank FROM hybrid")
def hybrid_search(spark, sf_dir):
    return hybrid(spark, sf_dir).select(F.col("pos").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


RERANK_SQL = HYBRID_SQL + f", re AS (SELECT h.doc_id, h.rank, len(list_intersect(list_distinct({tok(f"'{QUERY}'")}), t)) / len(list_distinct({tok(f"'{QUERY}'")}))::DOUBLE AS rr FROM hybrid h JOIN toks USING (doc_id))"


@query(f"WITH {RERANK_SQL} SELECT doc_id, round(rr, 6) AS rerank_score FROM re ORDER BY rr DESC, rank LIMIT {N}")
def rerank_topn(spark, sf_dir):
    rows = documents(spark, sf_dir).join(F.broadcast(hybrid(spark, sf_dir).withColumnRenamed("pos", "doc_id")), "doc_id")  # K rows
    return rt.rerank(rows, QUERY, N).select("doc_id", F.round("rerank_score", 6).alias("rerank_score"))


@query(f"WITH {TOP_SQL} SELECT DISTINCT p.chunk_id, p.doc_id, p.chunk_index FROM passages p JOIN top t ON p.doc_id = t.doc_id AND p.chunk_index BETWEEN t.chunk_index - 1 AND t.chunk_index + 1")
def expand_context(spark, sf_dir):
    return rt.neighbours(passages(spark, sf_dir), top_passages(spark, sf_dir).select("doc_id", "chunk_index"), 1).select("chunk_id", "doc_id", "chunk_index")


CONTEXT_SQL = TOP_SQL + """, perdoc AS (SELECT qid, doc_id, min(rank) AS seen, min_by(source_file, rank) AS f, string_agg('[' || array_to_string(section_path, ' > ') || ']' || chr(10) || text || chr(10), chr(10) ORDER BY chunk_id) AS body FROM top GROUP BY qid, doc_id),
ctx AS (SELECT qid, trim(string_agg('### Source: ' || f || chr(10) || body, chr(10) ORDER BY seen), ' ' || chr(10)) AS context FROM perdoc GROUP BY qid)"""


@query(f"WITH {CONTEXT_SQL} SELECT qid, context FROM ctx")
def build_context(spark, sf_dir):
    return cx.context(top_passages(spark, sf_dir))


HISTORY_SQL = """turns AS (SELECT conv_id AS session_id, turn, text AS question, answer FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant'),
hist AS (SELECT session_id, '=== CONVERSATION HISTORY ===' || chr(10) || string_agg('Q: ' || question || chr(10) || 'A: ' || substr(answer, 1, 300) || '...' || chr(10), chr(10) ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS r FROM turns) WHERE r <= 4 GROUP BY session_id)"""


@query(f"WITH {HISTORY_SQL} SELECT session_id, history FROM hist")
def history_window(spark, sf_dir):
    return cx.history(cx.turns(table(spark, sf_dir, "conversations")))


SYSTEM_SQL = cx.SYSTEM.replace("'", "''")


@query(
    f"""WITH {HISTORY_SQL} SELECT t.session_id, t.turn, '### SYSTEM' || chr(10) || '{SYSTEM_SQL}' || chr(10) || chr(10) || '### USER' || chr(10) || history || chr(10) || '=== CONTEXT ===' || chr(10) || t.answer || chr(10) || chr(10) || '=== QUESTION ===' || chr(10) || t.question
 || chr(10) || chr(10) || '=== ANSWER ===' || chr(10) || chr(10) || '### ASSISTANT' || chr(10) AS prompt FROM turns t JOIN hist h ON t.session_id = h.session_id"""
)
def build_prompt(spark, sf_dir):
    said = cx.turns(table(spark, sf_dir, "conversations"))
    return said.join(cx.history(said), "session_id").select("session_id", "turn", cx.prompt(F.col("question"), F.col("history"), F.col("answer")).alias("prompt"))


@query(f"""WITH {HISTORY_SQL} SELECT session_id, turn, CASE WHEN turn % 4 = 0 OR answer = question THEN '' ELSE '*Searched for: `' || answer || '`*' || chr(10) || chr(10) END AS note FROM turns""")
def rewrite_notes(spark, sf_dir):
    said = cx.turns(table(spark, sf_dir, "conversations"))
    search = F.when(F.col("turn") % 4 == 0, F.col("question")).otherwise(F.col("answer"))
    return said.select("session_id", "turn", cx.rewrite_note(F.col("question"), search).alias("note"))


@query(
    f"""WITH {TOP_SQL} SELECT qid, string_agg('**' || (rank + 1)::VARCHAR || '. ' || source_file || '** (' || format('{{:.3f}}', 1.0::DOUBLE / (rank + 1)) || ')' || CASE WHEN has_table THEN ' · `table`' ELSE '' END || CASE WHEN has_formula THEN ' · `formula`' ELSE '' END
 || chr(10) || '*' || array_to_string(section_path, ' › ') || '*' || chr(10) || '> ' || replace(substr(text, 1, 300), chr(10), ' ') || CASE WHEN length(text) > 300 THEN '…' ELSE '' END, chr(10) || chr(10) ORDER BY rank) AS sources FROM top GROUP BY qid"""
)
def sources_markdown(spark, sf_dir):
    return cx.sources_markdown(top_passages(spark, sf_dir).withColumn("score", F.lit(0.0)).withColumn("rerank_score", 1.0 / (F.col("rank") + 1)))


@query()
def rag_end_to_end(spark, sf_dir):
    from docloom.plans.engine import Engine

    engine = Engine(embedded(passages(spark, sf_dir), HashedWords()))
    result = engine.query(QUERY, rewrite_query=False)
    return spark.createDataFrame([(result.query, result.answer, [c["chunk_id"] for c in result.chunks])], "query string, answer string, chunks array<string>")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RUN["hybrid_search"](spark, sf_dir)
