"""Derivative web-archive records: metadata and plain-text conversions of responses.

Each response gives a `metadata` record (its title, language, charset, links and sizes as
warc-fields) and a `conversion` record (its visible text). Both name the response in
WARC-Refers-To with its target URI, and each other in WARC-Concurrent-To; both carry the
response's date and payload digest and keep its source headers; a written record has them as one
named field a header line (`SOURCE_HEADER`), in order. Record ids are name-based, so a retried task
or a second run gives the same ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATE = "1970-01-01T00:00:00Z"
CRLF = "\r\n"
#: Fixed value: the extension field of a written record that holds one line of the source headers.
SOURCE_HEADER = "WARC-X-Source-Header"

#: What is cut with its content (first what holds no markup, then the rest), what breaks a line, and the character references that are resolved.
DROPPED = ["script", "style", "noscript", "template", "head", "nav"]
BREAKS = "p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|blockquote|pre|hr|dd|dt"
REFERENCES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def visible_text(html: Column) -> Column:
    """The text a reader sees: comments and unseen elements cut, blocks as lines, references resolved."""
    unseen = "|".join([r"<!--.*?-->", *(rf"<{t}(?:\s[^>]*)?>.*?</{t}\s*>" for t in DROPPED[:4])])
    out = F.regexp_replace(html, f"(?is){unseen}", " ")
    out = F.regexp_replace(out, "(?is)" + "|".join(rf"<{t}(?:\s[^>]*)?>.*?</{t}\s*>" for t in DROPPED[4:]), " ")
    out = F.regexp_replace(out, rf"(?i)</?(?:{BREAKS})(?:\s[^>]*)?/?>", "\n")
    out = F.regexp_replace(out, "<[^>]*>", "")
    for name, sign in REFERENCES:
        out = F.replace(out, F.lit(name), F.lit(sign))
    out = F.regexp_replace(out, "[ \t\r\f]{2,}|[\t\r\f]", " ")  # single spaces stay as they are
    return F.btrim(F.regexp_replace(out, " ?\n[ \n]*", "\n"), F.lit(" \n"))


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise("")


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """`pages` (page_id, url, html) as response records: page_id, record_id, target_uri, date,
    headers (the HTTP header block) and payload. Null html is an empty payload; the url of a line
    break or other control character loses it, so that it cannot end a header."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    uri = F.regexp_replace(F.col("url").cast("string"), "[\\x00-\\x1f\\x7f]", "")
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(CRLF))
    return pages.select("page_id", _uuid(F.lit("response"), F.col("page_id"), uri).alias("record_id"), uri.alias("target_uri"), F.lit(date).alias("date"), headers.alias("headers"), payload.alias("payload"))


def derivatives(source: DataFrame) -> DataFrame:
    """Two rows for each response: page_id, record_type, record_id, refers_to, target_uri, date,
    content_type, source_headers, payload_digest, block_digest, content_length, block.

    An empty payload gives an empty conversion. Repeated responses give repeated records with the
    same ids. An empty table gives no rows.
    """
    html = F.col("payload")
    title = F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1), r"\s+", " ")
    lang = F.regexp_extract(html, r"(?is)<html[^>]*\slang=[\"']?([A-Za-z-]+)", 1)
    charset = F.regexp_extract(html, r"(?is)<meta[^>]*charset=[\"']?([A-Za-z0-9-]+)", 1)
    links = F.array_join(F.transform(F.regexp_extract_all("payload", F.lit(r"(?is)<a\s[^>]*href=[\"']([^\"'>]*)"), 1), lambda x: F.concat(F.lit("outlink: "), F.regexp_replace(x, r"[\x00-\x1f\x7f]", ""), F.lit(CRLF))), "")
    base = source.withColumns({"_text": visible_text(html), "_title": title, "_lang": lang, "_charset": charset, "_links": links, "_payload": _digest(html)})
    named = base.withColumns({"_meta_id": _uuid(F.lit("metadata"), F.col("record_id")), "_text_id": _uuid(F.lit("conversion"), F.col("record_id"))})
    fields = F.concat(_line("title", F.col("_title")), _line("languages-html", F.col("_lang")), _line("charset-detected", F.col("_charset")), _line("source-bytes", F.octet_length(html).cast("string")), _line("text-bytes", F.octet_length("_text").cast("string")), F.col("_links"))

    def record(kind: str, own: str, other: str, content: str, block: Column, headers: Column) -> Column:
        return F.struct(F.lit(kind).alias("record_type"), F.col(own).alias("record_id"), F.col(other).alias("concurrent_to"), F.lit(content).alias("content_type"), headers.alias("source_headers"), block.alias("block"))

    two = F.array(record("metadata", "_meta_id", "_text_id", "application/warc-fields", fields, F.col("headers")), record("conversion", "_text_id", "_meta_id", "text/plain", F.col("_text"), F.col("headers")))
    rows = named.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("_payload").alias("payload_digest"), F.explode(two).alias("r"))
    return rows.select("page_id", "r.record_type", "r.record_id", "refers_to", "r.concurrent_to", "target_uri", "date", "r.content_type", "r.source_headers", "payload_digest", _digest(F.col("r.block")).alias("block_digest"), F.octet_length("r.block").cast("long").alias("content_length"), "r.block")


def record_text(row: DataFrame) -> Column:
    """The whole record, without the blank lines that end it."""
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", F.col("record_id")), _line("WARC-Date", F.col("date")), _line("WARC-Target-URI", F.col("target_uri")),
        _line("WARC-Refers-To", F.col("refers_to")), _line("WARC-Refers-To-Target-URI", F.col("target_uri")), _line("WARC-Refers-To-Date", F.col("date")), _line("WARC-Concurrent-To", F.col("concurrent_to")),
        F.coalesce(F.regexp_replace(F.col("source_headers"), r"([^\r\n]+)(?:\r\n|\r|\n|$)", f"{SOURCE_HEADER}: $1{CRLF}"), F.lit("")),
        _line("WARC-Payload-Digest", F.col("payload_digest")), _line("WARC-Block-Digest", F.col("block_digest")), _line("Content-Type", F.col("content_type")), _line("Content-Length", F.col("content_length").cast("string")),
    )
    return F.concat(head, F.lit(CRLF), F.col("block"))


def write_warc(records: DataFrame, path: str, **options: str) -> None:
    """Writes one WARC file a partition; the text sink's separator ends each record."""
    records.select(record_text(records).alias("value")).write.option("lineSep", CRLF * 2).options(**options).text(path)


def _oracle() -> str:
    text = "regexp_replace(payload, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in DROPPED:
        text = rf"regexp_replace({text}, '(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>', ' ', 'g')"
    text = rf"regexp_replace({text}, '(?i)</?(?:{BREAKS})(?:\s[^>]*)?/?>', chr(10), 'g')"
    text = f"regexp_replace({text}, '<[^>]*>', '', 'g')"
    for name, sign in REFERENCES:
        sign = sign.replace("'", "''")
        text = f"replace({text}, '{name}', '{sign}')"
    text = rf"regexp_replace({text}, '[ \t\r\f]+', ' ', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"
    crlf = "chr(13) || chr(10)"
    uuid = lambda *p: "(select '<urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || '>' from (select md5(" + " || '|' || ".join(p) + ") as h))"
    return rf"""
with r0 as (select page_id, regexp_replace(url, '[\x00-\x1f\x7f]', '', 'g') as target_uri, coalesce(html, '') as payload from pages),
r as (select *, {uuid("'response'", "coalesce(cast(page_id as varchar), '')", "coalesce(target_uri, '')")} as refers_to,
  'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(payload) || {crlf} as headers, {text} as body from r0),
b as (select *, 'title: ' || regexp_replace(regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title', 1), '\s+', ' ', 'g') || {crlf}
  || 'languages-html: ' || regexp_extract(payload, '(?is)<html[^>]*\slang=["'']?([A-Za-z-]+)', 1) || {crlf}
  || 'charset-detected: ' || regexp_extract(payload, '(?is)<meta[^>]*charset=["'']?([A-Za-z0-9-]+)', 1) || {crlf}
  || 'source-bytes: ' || strlen(payload) || {crlf} || 'text-bytes: ' || strlen(body) || {crlf}
  || array_to_string(list_transform(regexp_extract_all(payload, '(?is)<a\s[^>]*href=["'']([^"''>]*)', 1), lambda x: 'outlink: ' || regexp_replace(x, '[\x00-\x1f\x7f]', '', 'g') || {crlf}), '') as fields,
  {uuid("'metadata'", "refers_to")} as meta_id, {uuid("'conversion'", "refers_to")} as text_id from r),
u as (select page_id, 'metadata' as record_type, meta_id as record_id, refers_to, text_id as concurrent_to, target_uri, 'application/warc-fields' as content_type, headers as source_headers, payload, fields as block from b
  union all select page_id, 'conversion', text_id, refers_to, meta_id, target_uri, 'text/plain', headers, payload, body from b)
select page_id, record_type, record_id, refers_to, concurrent_to, target_uri, '{DATE}' as date, content_type, source_headers, 'sha256:' || sha256(payload) as payload_digest, 'sha256:' || sha256(block) as block_digest,
  cast(strlen(block) as bigint) as content_length, block from u
"""


#: DuckDB SQL for `derivatives(responses(pages))`.
ORACLE = _oracle()
