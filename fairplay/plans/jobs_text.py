"""Registered corpus jobs: C8-C13 (documents, pages) and C14-C16 (events.props)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairplay.functions import text as TX
from fairplay.operators import screening as SC
from fairplay.plans.catalog import job
from fairplay.sources import tables as TB


def _q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _rx(expr: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({expr}, {_q(pattern)}, {_q(repl)}, 'g')"


def sanitize_string_sql(x: str) -> str:
    y = f"replace({x}, chr(0), '')"
    y = _rx(y, TX.WHITESPACE_CLASS + "+", " ")
    y = _rx(y, "^ | $", "")
    y = _rx(y, TX.CONTROL_CLASS, "")
    return _rx(y, "^ +| +$", "")


def sanitize_html_sql(x: str) -> str:
    y = _rx(x, TX.HTML_TAG, "")
    for ent, ch in TX.HTML_ENTITIES:
        y = f"replace({y}, {_q(ent)}, {_q(ch)})"
    return y


def sanitize_sql_sql(x: str) -> str:
    y = x
    for a, b in TX.SQL_REPLACEMENTS:
        y = f"replace({y}, {_q(a)}, {_q(b)})"
    return y


def blocked_rules_sql(x: str) -> str:
    arms = [f"CASE WHEN length({x}) > {TX.MAX_STRING_LENGTH} THEN 'too_long' END"]
    for name, pat in TX.PORTABLE_PATTERNS:
        arms.append(f"CASE WHEN regexp_matches({x}, {_q('(?i)' + pat)}) THEN {_q(name)} END")
    return f"list_filter([{', '.join(arms)}], lambda r: r IS NOT NULL)"


@job("c08_sanitize_string", f"""
SELECT doc_id, CAST(length(s) AS INTEGER) AS sanitized_length, md5(s) AS sanitized_md5
FROM (SELECT doc_id, {sanitize_string_sql('text')} AS s FROM documents) d""")
def c08_sanitize_string(spark, sf_dir):
    """C8 on every document (whole texts); result checksummed."""
    docs = TB.read_table(spark, sf_dir, "documents")
    s = TX.sanitize_string("text")
    return docs.select("doc_id", F.length(s).alias("sanitized_length"), F.md5(s).alias("sanitized_md5"))


@job("c09_sanitize_html", f"""
SELECT page_id, CAST(length(s) AS INTEGER) AS text_length, md5(s) AS text_md5
FROM (SELECT page_id, {sanitize_html_sql('html')} AS s FROM pages) p""")
def c09_sanitize_html(spark, sf_dir):
    """C9 on every stored page."""
    pages = TB.read_table(spark, sf_dir, "pages")
    s = TX.sanitize_html("html")
    return pages.select("page_id", F.length(s).alias("text_length"), F.md5(s).alias("text_md5"))


@job("c10_sanitize_sql", f"""
SELECT doc_id, CAST(length(s) AS INTEGER) AS escaped_length, md5(s) AS escaped_md5
FROM (SELECT doc_id, {sanitize_sql_sql('text')} AS s FROM documents) d""")
def c10_sanitize_sql(spark, sf_dir):
    docs = TB.read_table(spark, sf_dir, "documents")
    s = TX.sanitize_sql("text")
    return docs.select("doc_id", F.length(s).alias("escaped_length"), F.md5(s).alias("escaped_md5"))


@job("c11_email_counts", f"""
SELECT email, count(*) AS occurrences
FROM (SELECT unnest(regexp_extract_all(text, {_q(TX.EMAIL_FIND)})) AS email FROM documents) e
GROUP BY email""")
def c11_email_counts(spark, sf_dir):
    """C11: addresses found in the whole corpus and how often."""
    return SC.email_counts(TB.read_table(spark, sf_dir, "documents"), "text")


@job("c11_email_documents", f"""
SELECT doc_id, CAST(len(regexp_extract_all(text, {_q(TX.EMAIL_FIND)})) AS INTEGER) AS n_emails,
       regexp_matches(trim(text), {_q(TX.EMAIL_ANCHORED)}) AS is_address
FROM documents WHERE len(regexp_extract_all(text, {_q(TX.EMAIL_FIND)})) > 0""")
def c11_email_documents(spark, sf_dir):
    docs = TB.read_table(spark, sf_dir, "documents")
    found = TX.emails_in("text")
    return docs.select("doc_id", F.size(found).alias("n_emails"),
                       TX.is_email(F.trim("text")).alias("is_address")).where("n_emails > 0")


_LISTING_SQL = ("SELECT regexp_extract(url, '[^/]+$') AS name, CAST(length(html) AS BIGINT) AS size "
                "FROM pages")


def _clean_filename_sql(x: str) -> str:
    y = _rx(x, TX.FILE_BAD_CHARS, "")
    y = _rx(y, "^[. ]+|[. ]+$", "")
    ext = f"split_part({y}, '.', -1)"
    return (f"CASE WHEN length({y}) <= 255 THEN {y} "
            f"WHEN contains({y}, '.') THEN substring(substring({y}, 1, length({y}) - length({ext}) - 1), 1, 254 - length({ext})) || '.' || {ext} "
            f"ELSE substring({y}, 1, 255) END")


def _ext_sql(x: str) -> str:
    return f"CASE WHEN contains({x}, '.') THEN '.' || lower(split_part({x}, '.', -1)) ELSE '' END"


@job("c12_check_files", f"""
SELECT name, size, {_ext_sql('name')} AS extension, {_clean_filename_sql('name')} AS clean_name,
       array_to_string(list_filter([
         CASE WHEN size > {TX.FILE_MAX_BYTES} THEN 'too_large' END,
         CASE WHEN NOT ({_ext_sql('name')} IN ({', '.join(_q(e) for e in TX.FILE_EXTENSIONS)})) THEN 'extension' END,
         CASE WHEN len({blocked_rules_sql('name')}) > 0 THEN 'blocked_pattern' END,
         CASE WHEN contains(name, '..') OR contains(name, '/') OR contains(name, '\\') THEN 'path_chars' END],
         lambda v: v IS NOT NULL), ',') AS violations
FROM ({_LISTING_SQL}) l""")
def c12_check_files(spark, sf_dir):
    """C12 on a listing of stored page names (last URL segment) and sizes."""
    pages = TB.read_table(spark, sf_dir, "pages")
    listing = pages.select(F.regexp_extract("url", "[^/]+$", 0).alias("name"),
                           F.length("html").cast("long").alias("size"))
    out = SC.check_files(listing)
    return out.withColumn("violations", F.array_join("violations", ","))


_UPLOADS_SQL = ("SELECT coalesce(source, '') || CASE WHEN doc_id % 7 = 0 THEN '/' ELSE '_' END || CAST(doc_id AS VARCHAR) || "
                "CASE WHEN doc_id % 3 = 0 THEN '.' || lang WHEN doc_id % 3 = 1 THEN '.CSV' ELSE '.json' END AS name, "
                "n_chars * 1000 AS size FROM documents")


@job("c12_file_listing_audit", f"""
SELECT name, size, {_ext_sql('name')} AS extension, {_clean_filename_sql('name')} AS clean_name,
       array_to_string(list_filter([
         CASE WHEN size > {TX.FILE_MAX_BYTES} THEN 'too_large' END,
         CASE WHEN NOT ({_ext_sql('name')} IN ({', '.join(_q(e) for e in TX.FILE_EXTENSIONS)})) THEN 'extension' END,
         CASE WHEN len({blocked_rules_sql('name')}) > 0 THEN 'blocked_pattern' END,
         CASE WHEN contains(name, '..') OR contains(name, '/') OR contains(name, '\\') THEN 'path_chars' END],
         lambda v: v IS NOT NULL), ',') AS violations
FROM ({_UPLOADS_SQL}) l""")
def c12_file_listing_audit(spark, sf_dir):
    """C12 on an upload listing derived from the documents: names with every kind of ending
    and with folders, sizes on both sides of the limit."""
    docs = TB.read_table(spark, sf_dir, "documents")
    end = (F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("."), "lang")).when(F.col("doc_id") % 3 == 1, ".CSV").otherwise(".json"))
    name = F.concat(F.coalesce("source", F.lit("")), F.when(F.col("doc_id") % 7 == 0, "/").otherwise("_"),
                    F.col("doc_id").cast("string"), end)
    out = SC.check_files(docs.select(name.alias("name"), (F.col("n_chars") * 1000).alias("size")))
    return out.withColumn("violations", F.array_join("violations", ","))


_SCREEN_SQL = f"""
SELECT 'documents' AS source, doc_id AS id, array_to_string({blocked_rules_sql('text')}, ',') AS rules FROM documents
UNION ALL
SELECT 'pages' AS source, page_id AS id, array_to_string({blocked_rules_sql('html')}, ',') AS rules FROM pages"""


@job("c13_screen_text", f"""
SELECT source, id, rules, CASE WHEN rules = '' THEN 'clean' ELSE 'rejected' END AS status
FROM ({_SCREEN_SQL}) s""")
def c13_screen_text(spark, sf_dir):
    """C13 over every document and page: violated rules and clean/rejected."""
    docs = SC.screen_corpus(TB.read_table(spark, sf_dir, "documents"), "doc_id", "text")
    pages = SC.screen_corpus(TB.read_table(spark, sf_dir, "pages"), "page_id", "html", html=True)
    both = (docs.select(F.lit("documents").alias("source"), "id", "rules", "status")
            .unionByName(pages.select(F.lit("pages").alias("source"), "id", "rules", "status")))
    return both.withColumn("rules", F.array_join("rules", ","))


@job("c13_rule_counts", f"""
SELECT source, rule, count(*) AS rows FROM (
  SELECT source, unnest(string_split(rules, ',')) AS rule FROM ({_SCREEN_SQL}) s WHERE rules <> '') r
GROUP BY source, rule""")
def c13_rule_counts(spark, sf_dir):
    docs = SC.screen_corpus(TB.read_table(spark, sf_dir, "documents"), "doc_id", "text")
    pages = SC.screen_corpus(TB.read_table(spark, sf_dir, "pages"), "page_id", "html", html=True)
    both = (docs.select(F.lit("documents").alias("source"), "rules")
            .unionByName(pages.select(F.lit("pages").alias("source"), "rules")))
    return (both.select("source", F.explode("rules").alias("rule"))
            .groupBy("source", "rule").agg(F.count(F.lit(1)).alias("rows")))


@job("c14_c15_json_audit")
def c14_c15_json_audit(spark, sf_dir):
    """C14 limits + C15 sanitize (pandas UDFs, property-checked) + C16 on events.props."""
    ev = TB.read_table(spark, sf_dir, "events")
    out = SC.audit_json(ev, "event_id", "props", ["k"], {"k": "integer"})
    return out.select("id", "limits.valid_json", "limits.max_depth", "limits.max_keys",
                      "limits.max_len", F.array_join("limits.violations", ",").alias("violations"),
                      "sanitized", "schema_ok")


@job("c16_json_schema_check", """
SELECT event_id, props IS NOT NULL AND json_valid(props)
       AND json_type(props, '$.k') IS NOT NULL
       AND json_type(props, '$.k') IN ('BIGINT', 'UBIGINT', 'BOOLEAN') AS schema_ok,
       CASE WHEN json_type(props, '$.k') IN ('BIGINT', 'UBIGINT') THEN 'BIGINT' ELSE json_type(props, '$.k') END AS k_type
FROM events""")
def c16_json_schema_check(spark, sf_dir):
    """Required key ``k`` present and integer-typed, per event."""
    ev = TB.read_table(spark, sf_dir, "events")
    v = F.try_parse_json("props")
    return ev.select("event_id", SC.json_schema_ok("props", ["k"], {"k": "integer"}).alias("schema_ok"),
                     SC.variant_kind(v, "$.k").alias("k_type"))
