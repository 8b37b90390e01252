"""Queries of registration, text transforms and mention extraction over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from ..operators import extraction, ingestion
from ..sources import files
from ..streaming import registration
from .inputs import read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents")


# Registration

_PATHS = "paths AS (SELECT 'r' AS run_id, left(sha256(coalesce(text, '')), 32) AS doc_id, source || '/' || doc_id AS path, length(text) AS n FROM documents)"


def _paths(spark, d) -> DataFrame:
    return _documents(spark, d).select(F.lit("r").alias("run_id"), ingestion.content_id(F.coalesce("text", F.lit(""))).alias("doc_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.length("text").cast("bigint").alias("n"))


@query(f"WITH {_PATHS}, new AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY path) AS rn FROM paths) SELECT run_id, doc_id, path, n FROM new WHERE rn = 1")
def doc_register_dedup(spark, d):
    return ingestion.register_documents(_paths(spark, d))


@query(f"""WITH {_PATHS}, known AS (SELECT * FROM paths WHERE n > 3000), new AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY path) AS rn FROM paths)
SELECT run_id, doc_id, path, n FROM new WHERE rn = 1 AND doc_id NOT IN (SELECT doc_id FROM known) AND path NOT IN (SELECT path FROM known)""")
def doc_register_incremental(spark, d):
    p = _paths(spark, d)
    return ingestion.register_documents(p, p.where("n > 3000"))


@query("SELECT source AS bucket, count(*) AS n FROM documents GROUP BY 1")
def document_counts(spark, d):
    return _documents(spark, d).groupBy(F.col("source").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# Text


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(9), ' '), '[\x00-\x09\x0b-\x1f\x7f]', '', 'g'), '[ ]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS clean FROM documents")
def text_normalize_ws(spark, d):
    return _documents(spark, d).select("doc_id", names.collapse_blanks(F.col("text")).alias("clean"))


_BLANK = r" \x0b\x0c\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(nfc_normalize(replace(text, chr(9), ' ')), '[^\n\x20-\x7e\x{{a0}}-\x{{10ffff}}]', '', 'g'), '[{_BLANK}]+', ' ', 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS clean FROM documents
WHERE NOT regexp_matches(text, '[Â-ô][\x{{0080}}-\x{{00bf}}ŒœŠšŸŽžƒˆ˜–-›€™]')""")
def text_normalize(spark, d):
    """Of all documents; the tables hold none that was read in the wrong encoding, which SQL can't repair (the tests do)."""
    return _documents(spark, d).select("doc_id", names.normalize_text(F.coalesce("text", F.lit(""))).alias("clean"))


def _units(spark, d) -> DataFrame:
    return files.table_units(_documents(spark, d), "doc_id", "text", "r")


@query()
def chunks(spark, d):
    return ingestion.chunk_documents(_units(spark, d))


@query("SELECT count(*) AS docs_processed, CAST(sum(n) AS BIGINT) AS chunk_count, CAST(min(n) AS BIGINT) AS chunks_min, CAST(max(n) AS BIGINT) AS chunks_max, round(quantile_cont(n, 0.5), 1) AS chunks_median FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)")
def chunk_statistics(spark, d):
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"))
    return ingestion.chunk_statistics(c, c)


@query("""WITH units AS (SELECT conv_id AS doc_id, turn AS page_num, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM conversations),
pos AS (SELECT DISTINCT conv_id AS doc_id, turn * 100 AS pos FROM conversations)
SELECT doc_id, pos, page_num FROM (SELECT p.doc_id, p.pos, u.page_num, row_number() OVER (PARTITION BY p.doc_id, p.pos ORDER BY u.start DESC, u.page_num DESC) AS rn FROM pos p JOIN units u ON u.doc_id = p.doc_id AND u.start <= p.pos) WHERE rn = 1""")
def unit_of_position(spark, d):
    c = read(spark, d, "conversations")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    units = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_num"), F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)).alias("start"))
    return ingestion.unit_of_position(units, c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") * 100).alias("pos")).distinct())


_EMAIL = r"[\w.%+-]+@[A-Za-z\d.-]+[.][A-Za-z]{2,}"
_MAILS = f"mails AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS text FROM documents)"


def _mails(spark, d) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_EMAIL), F.lit(0))).alias("text"))


@query(f"WITH {_MAILS} SELECT doc_id, text FROM mails")
def email_mentions(spark, d):
    return _mails(spark, d)


@query(f"SELECT page_id, unnest(regexp_extract_all(html, '{_EMAIL}')) AS text FROM pages")
def page_email_mentions(spark, d):
    return read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(_EMAIL), F.lit(0))).alias("text"))


@query(f"""WITH mails AS (SELECT doc_id, text AS body, unnest(regexp_extract_all(text, '{_EMAIL}')) AS text FROM documents),
placed AS (SELECT doc_id, text, CAST(strpos(body, text) - 1 AS BIGINT) AS s, CASE WHEN length(regexp_replace(text, '[^0-9]', '', 'g')) >= 0.5 * length(text) THEN regexp_replace(text, '[^0-9]', '', 'g') ELSE lower(text) END AS normalized FROM mails)
SELECT doc_id, normalized, count(*) AS count, min(s) AS char_start, arg_min(s + length(text), s) AS char_end, arg_min(text, s) AS text FROM placed GROUP BY 1, 2""")
def mention_dedup(spark, d):
    """Every e-mail address of a document where it first stands."""
    start = F.instr(F.col("body"), F.col("text")) - 1
    mails = _documents(spark, d).select("doc_id", F.col("text").alias("body"), F.explode(F.regexp_extract_all("text", F.lit(_EMAIL), F.lit(0))).alias("text"))
    place = {"type": F.lit("COMM"), "chunk_id": F.col("doc_id").cast("string"), "char_start": start, "char_end": start + F.length("text"), "page_num": F.lit(0), "source_unit_kind": F.lit("docx_paragraph")}
    found = extraction.dedup_mentions(extraction.normalized_mentions(mails.withColumns(place).drop("body")))
    return found.select("doc_id", "normalized", F.col("count").cast("bigint").alias("count"), F.col("char_start").cast("bigint").alias("char_start"), F.col("char_end").cast("bigint").alias("char_end"), "text")


@query("SELECT doc_id, p AS char_start, substring(text, CAST(greatest(p - 50, 0) + 1 AS BIGINT), CAST(least(p + 53, length(text)) - greatest(p - 50, 0) AS BIGINT)) AS context FROM (SELECT doc_id, text, strpos(text, 'the') - 1 AS p FROM documents) WHERE p >= 0")
def context_window(spark, d):
    at = F.instr("text", "the") - 1
    rows = _documents(spark, d).withColumn("p", at).where("p >= 0")
    return rows.select("doc_id", F.col("p").cast("bigint").alias("char_start"), names.context_window(F.col("text"), F.col("p"), F.col("p") + 3).alias("context"))


_TITLE = "array_to_string(list_transform(string_split({}, ' '), lambda w: upper(left(w, 1)) || lower(substring(w, 2))), ' ')"


@query(f"""SELECT p_partkey, CASE k WHEN 6 THEN 'Fru' WHEN 7 THEN '' ELSE {_TITLE.format("p_name")} END AS normalized FROM (SELECT *, p_partkey % 8 AS k FROM part)""")
def entity_normalize(spark, d):
    """Names of parts with honorifics, company forms and kinds of places around them, in any case and spacing."""
    name, k = F.col("p_name"), F.col("p_partkey") % 8
    text = F.when(k == 0, F.concat(F.lit("Dr.  "), name)).when(k == 1, F.concat(F.lit("fru "), F.upper(name))).when(k == 2, F.concat(name, F.lit(" ASA"))).when(k == 3, F.concat(F.upper(name), F.lit("  as ")))
    text = text.when(k == 4, F.concat(F.upper(name), F.lit(" kommune"))).when(k == 5, F.concat(F.lit(" "), name, F.lit(" Fylke"))).when(k == 6, "fru").otherwise("  ")
    kind = F.when(k.isin(0, 1, 6, 7), "PER").when(k.isin(2, 3), "ORG").otherwise("LOC")
    return read(spark, d, "part").select("p_partkey", names.normalize_name(text, kind).alias("normalized"))


@query("SELECT s_suppkey, lower(s_name) AS item, upper(s_name) AS veh, upper(regexp_replace(s_name, '[\\s-]', '', 'g')) AS fin, CASE WHEN length(regexp_replace(s_name, '[^0-9]', '', 'g')) >= 0.5 * length(s_name) THEN regexp_replace(s_name, '[^0-9]', '', 'g') ELSE lower(s_name) END AS comm FROM supplier")
def supplier_normalize(spark, d):
    of = lambda t: names.normalize_name(F.col("s_name"), F.lit(t)).alias(t.lower())
    return read(spark, d, "supplier").select("s_suppkey", *[of(t) for t in ("ITEM", "VEH", "FIN", "COMM")])


@query("SELECT p_partkey, replace(replace(replace(replace(replace(replace(replace(lower(p_name), 'æ', 'ae'), 'ø', 'o'), 'å', 'a'), 'skj', 'sk'), 'kj', 'k'), 'hj', 'j'), 'gj', 'j') AS form FROM part")
def phonetic_form(spark, d):
    return read(spark, d, "part").select("p_partkey", names.phonetic_blocking_form(F.col("p_name")).alias("form"))


# Mentions


def _chunks(spark, d) -> DataFrame:
    key = F.col("doc_id").cast("string")
    return _documents(spark, d).select(key.alias("doc_id"), names.hash_id(key, F.lit("0"), sep=":").alias("chunk_id"), F.lit(0).alias("page_num"), F.lit("docx_paragraph").alias("source_unit_kind"), "text")


@query()
def pattern_mentions(spark, d):
    return extraction.pattern_mentions(_chunks(spark, d))


@query()
def tagged_mentions(spark, d):
    return extraction.tagged_mentions(_chunks(spark, d))


@query()
def extracted_entities(spark, d):
    found = extraction.extract_entities(_chunks(spark, d))
    return found.select("entity_id", "doc_id", "chunk_id", "text", "normalized", "type", "char_start", "char_end", "context", "count")


_R = "CAST(user_id AS VARCHAR) AS chunk_id, CAST(floor(value * 10) AS BIGINT) AS char_start"
_KIND = "CASE WHEN event_type IN ('click', 'view') THEN 'LOC' ELSE 'PER' END AS type"
_R_SPANS = f"r AS (SELECT DISTINCT {_R}, CAST(floor(value * 10) AS BIGINT) + 14 AS char_end, {_KIND} FROM events WHERE value < 8)"
_N_SPANS = f"n AS (SELECT DISTINCT {_R}, CAST(floor(value * 10) AS BIGINT) + 6 AS char_end, {_KIND} FROM events WHERE value > 5)"


def _spans(spark, d) -> tuple[DataFrame, DataFrame]:
    e = read(spark, d, "events")
    start = F.floor(F.col("value") * 10)
    kind = F.when(F.col("event_type").isin("click", "view"), "LOC").otherwise("PER")
    of = lambda rows, n: rows.select(F.col("user_id").cast("string").alias("chunk_id"), start.alias("char_start"), (start + n).alias("char_end"), kind.alias("type")).distinct()
    return of(e.where("value < 8"), 14), of(e.where("value > 5"), 6)


@query(f"WITH {_R_SPANS}, {_N_SPANS} SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.chunk_id = r.chunk_id AND r.char_start < n.char_end AND n.char_start < r.char_end)")
def interval_overlap_anti(spark, d):
    return extraction.patterns_off_tags(*_spans(spark, d))


@query(f"""WITH {_R_SPANS}, {_N_SPANS}, hit AS (SELECT r.chunk_id, r.char_start, r.char_end, r.type, n.char_start AS ns, n.char_end AS ne, n.type AS nt, r.char_start <= n.char_start AND n.char_end <= r.char_end AND r.type = n.type AS inside
FROM r JOIN n ON n.chunk_id = r.chunk_id AND r.char_start < n.char_end AND n.char_start < r.char_end), wins AS (SELECT chunk_id, char_start, char_end, type, bool_and(inside) AS w FROM hit GROUP BY ALL)
SELECT r.* FROM r ANTI JOIN (FROM wins WHERE NOT w) l USING (chunk_id, char_start, char_end, type) UNION ALL
SELECT n.* FROM n ANTI JOIN (SELECT DISTINCT h.chunk_id, h.ns AS char_start, h.ne AS char_end, h.nt AS type FROM hit h JOIN wins w ON (h.chunk_id, h.char_start, h.char_end, h.type) = (w.chunk_id, w.char_start, w.char_end, w.type) WHERE w.w) g USING (chunk_id, char_start, char_end, type)""")
def interval_regex_over_ner(spark, d):
    return extraction.merge_patterns_with_tags(*_spans(spark, d))


@query(f"""WITH {_N_SPANS}, g AS (SELECT *, CASE WHEN lag(type) OVER w = type AND char_start - lag(char_end) OVER w BETWEEN 0 AND 1 THEN 0 ELSE 1 END AS new FROM n WINDOW w AS (PARTITION BY chunk_id ORDER BY char_start, char_end, type)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY chunk_id ORDER BY char_start, char_end, type ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT chunk_id, type, min(char_start) AS char_start, arg_max(char_end, char_start) AS char_end, count(*) AS n_spans FROM runs GROUP BY chunk_id, run, type""")
def span_islands(spark, d):
    return extraction.span_islands(_spans(spark, d)[1], ["chunk_id"])


# Web pages, events


@query()
def page_texts(spark, d):
    return read(spark, d, "pages").select("page_id", files.html_text(F.col("html")).alias("text"))


@query("SELECT date_trunc('hour', ts) AS begins, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark, d):
    return registration.windowed_counts(read(spark, d, "events"))

