"""Text and mail queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from skyspine.functions import text as X
from skyspine.operators import mail as M
from skyspine.operators.textindex import (Clause, Query, build_text_index, indexed_search, read_text_index, scan_search, store_index,
                                           text_search, vocabulary, write_text_index)
from skyspine.plans import mail as plans
from skyspine.plans import platform
from skyspine.session import scratch
from skyspine.sources.json_feeds import read_account_pages, read_mail_json
from skyspine.workload.cleaning import WS
from skyspine.workload.fleet import COUNT_SQL, TOP_SQL
from skyspine.workload.jobs import STATUS
from skyspine.workload.registry import query

DOCUMENT = "coalesce(subject, '') || ' ' || coalesce(from_addr, '') || ' ' || coalesce(body, '')"


@query("search_document", f"SELECT id, {DOCUMENT} AS document FROM v_emails")
def _(t, spark):
    return t.emails.select("id", M.searched_text().alias("document"))


def postings_sql(source: str, key: str, text: str) -> str:
    return (f"SELECT {key}, unnest(w) AS token, CAST(unnest(range(len(w))) AS INTEGER) AS pos FROM (SELECT {key}, "
            f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {source}) z")


DOC_POSTINGS = postings_sql("documents", "doc_id", "text")


def doc_postings(t):
    return build_text_index(t.documents, "doc_id", F.col("text"))


@query("build_text_index", DOC_POSTINGS)
def _(t, spark):
    return doc_postings(t)


def with_word(w: str) -> str:
    return f"SELECT doc_id FROM p WHERE token = '{w}'"


def with_words(first: str, second: str, gap: int = 1) -> str:
    return (f"SELECT a.doc_id FROM p a JOIN p b ON b.doc_id = a.doc_id AND b.pos = a.pos + {gap} "
            f"WHERE a.token = '{first}' AND b.token = '{second}'")


def found(condition: str) -> str:
    return f"WITH p AS ({DOC_POSTINGS}) SELECT doc_id FROM documents WHERE {condition}"


@query("text_search", f"""WITH p AS ({DOC_POSTINGS})
SELECT doc_id FROM p WHERE token IN ('tion', 'ing') GROUP BY doc_id HAVING count(DISTINCT token) = 2""")
def _(t, spark):
    return text_search(doc_postings(t), Query((Clause(("tion", "Ing the")),)), "doc_id")


@query("text_search_any_none", found(
    f"(doc_id IN ({with_word('er')}) AND doc_id IN ({with_word('ble')})) OR "
    f"(doc_id IN ({with_word('license')}) AND doc_id NOT IN ({with_word('tion')})) OR doc_id NOT IN ({with_word('re')})"))
def _(t, spark):
    q = Query((Clause(("er", "ble")), Clause(("license",), ("tion",)), Clause((), ("re",))))
    return text_search(doc_postings(t), q, "doc_id", docs=t.documents)


@query("text_search_phrase", found(
    f"doc_id IN ({with_words('anea', 'eriner')}) OR doc_id IN ({with_words('attion', 'thanedble', 2)}) "
    f"AND doc_id NOT IN ({with_words('er', 're')})"))
def _(t, spark):
    q = Query((Clause(("anea eriner",)), Clause(("attion to thanedble",), ("er re",))))
    return text_search(doc_postings(t), q, "doc_id")


@query("text_search_stored", f"""WITH p AS ({DOC_POSTINGS}), er_re AS ({with_words('er', 're')}) SELECT doc_id FROM p
WHERE token = 'ea' AND EXISTS (SELECT 1 FROM er_re WHERE er_re.doc_id = p.doc_id) GROUP BY doc_id""")
def _(t, spark):
    path = scratch(spark, "index")
    write_text_index(doc_postings(t), path)
    return text_search(read_text_index(spark, path), Query((Clause(("er re", "ea")),)), "doc_id")


MIXED = Query((Clause(("license", "er")), Clause(("er re", "tion"), ("license",)), Clause(("anea eriner",)), Clause(("qqqqqqqq", "er"))))
MIXED_SQL = found(f"""(doc_id IN ({with_word('license')}) AND doc_id IN ({with_word('er')})) OR doc_id IN ({with_words('anea', 'eriner')})
OR (doc_id IN ({with_words('er', 're')}) AND doc_id IN ({with_word('tion')}) AND doc_id NOT IN ({with_word('license')}))""")


@query("text_search_indexed", MIXED_SQL)
def _(t, spark):
    return indexed_search(store_index(doc_postings(t), "doc_id", scratch(spark, "index")), MIXED, "doc_id")


@query("text_search_scanned", MIXED_SQL)
def _(t, spark):
    return scan_search(t.documents, F.col("text"), MIXED).select("doc_id")


MAIL_SHOWN = """id, mailbox, from_addr, from_name, subject, snippet, make_timestamp(CAST(internal_ms AS BIGINT) * 1000) AS internal_ts"""
MAIL_POSTINGS = postings_sql("v_emails", "id", DOCUMENT)
#: Word forms of a stem as the test tables hold them.
FORMS = {"tion": "tion tioned tionedly tiones tioning tioningly tionly tionlyed tionlying", "ble": "ble bleing bleingly",
         "er": "er erly erlyed erlyedly erlying erlyingly", "ing": "ing inged ingedly inges inging ingingly ingly inglyed inglying",
         "licens": "license licensed licenses licensing", "bless": "bless blessed blesses blessing"}


def forms(stem: str) -> str:
    return "(" + ", ".join(f"'{w}'" for w in FORMS[stem].split()) + ")"


@query("mail_list", f"""WITH p AS ({MAIL_POSTINGS}) SELECT {MAIL_SHOWN} FROM v_emails
WHERE id IN (SELECT id FROM p WHERE token IN {forms('tion')}) AND id NOT IN (SELECT id FROM p WHERE token IN {forms('ble')})
ORDER BY internal_ts DESC NULLS LAST, id NULLS LAST LIMIT 100""")
def _(t, spark):
    return M.mail_list(t.emails, Query((Clause(("tions",), ("ble",)),)), limit=100)


@query("mail_list_unstemmed", f"""WITH p AS ({MAIL_POSTINGS}) SELECT {MAIL_SHOWN} FROM v_emails
WHERE id IN (SELECT id FROM p WHERE token = 'tion') AND id NOT IN (SELECT id FROM p WHERE token = 'ble')
ORDER BY internal_ts DESC NULLS LAST, id NULLS LAST LIMIT 100""")
def _(t, spark):
    return M.mail_list(t.emails, Query((Clause(("tion",), ("ble",)),)), limit=100, stemmed=False)


@query("mail_search", f"""WITH p AS ({MAIL_POSTINGS}) SELECT {MAIL_SHOWN} FROM v_emails
WHERE id IN (SELECT id FROM p WHERE token IN {forms('er')}) AND mailbox = 'src3@example.com'
ORDER BY internal_ts DESC NULLS LAST, id NULLS LAST LIMIT 50""")
def _(t, spark):
    return plans.mail_search(t, Query((Clause(("erly",)),)), "src3@example.com")


@query("mail_search_indexed", f"""WITH p AS ({MAIL_POSTINGS}) SELECT {MAIL_SHOWN} FROM v_emails
WHERE id IN (SELECT id FROM p WHERE token IN {forms('licens')}) AND id IN (SELECT id FROM p WHERE token IN {forms('er')})
ORDER BY internal_ts DESC NULLS LAST, id NULLS LAST LIMIT 50""")
def _(t, spark):
    index = store_index(build_text_index(t.emails, "id", M.searched_text()), "id", scratch(spark, "mail-index"))
    return plans.mail_search(t, Query((Clause(("erly", "licensed")),)), index=index)


@query("optional_filters_mail", f"SELECT {MAIL_SHOWN} FROM v_emails ORDER BY internal_ts DESC NULLS LAST, id NULLS LAST LIMIT 50")
def _(t, spark):
    return plans.mail_search(t)


COUNTS = "SELECT mailbox, count(*) AS n FROM v_emails WHERE mailbox IS NOT NULL GROUP BY mailbox"


@query("mailbox_counts", COUNTS)
def _(t, spark):
    return M.mailbox_counts(t.emails)


@query("mailboxes", COUNTS)
def _(t, spark):
    return plans.mailboxes(t)


@query("strip_tags", "SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS text FROM pages")
def _(t, spark):
    return t.pages.select("page_id", X.strip_tags(F.col("html")).alias("text"))


def b64url(col):
    coded = F.base64(F.encode(col, "UTF-8"))
    for old, new in (("\r\n", ""), ("+", "-"), ("/", "_")):
        coded = F.replace(coded, F.lit(old), F.lit(new))
    return F.rtrim(coded, F.lit("="))


@query("decode_b64url", "SELECT doc_id, text FROM documents")
def _(t, spark):
    return t.documents.select("doc_id", X.decode_b64url(b64url(F.col("text"))).alias("text"))


def headers(*pairs):
    return F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in pairs])


@query("header_map", """SELECT id, subject, from_addr AS "from", 'second ' || lang AS x FROM v_emails""")
def _(t, spark):
    h = headers(("Subject", F.col("subject")), ("X", F.lit("first")), ("FROM", F.col("from_addr")),
                ("x", F.concat(F.lit("second "), "lang")))
    rows = t.emails.select("id", X.header_map(h).alias("m"), X.header_value(h, "x").alias("x"))
    return rows.select("id", F.col("m")["subject"].alias("subject"), F.col("m")["from"].alias("from"), "x")


def sender_header():
    """Four common forms and one that needs the mail grammar."""
    mark = F.col("id").cast("bigint") % 5
    name, addr = F.concat(F.lit("Sender "), "lang"), F.concat("lang", F.lit("@example.org"))
    angle = F.concat(F.lit("<"), addr, F.lit(">"))
    return (F.when(mark == 0, addr).when(mark == 1, F.concat(name, F.lit(" "), angle))
            .when(mark == 2, F.concat(F.lit('"'), name, F.lit('" '), angle)).when(mark == 3, angle)
            .otherwise(F.concat(F.lit('"Doe \\"Jane\\", '), "lang", F.lit('" '), angle)))


NAME_SQL = """CASE CAST(id AS BIGINT) % 5 WHEN 0 THEN '' WHEN 1 THEN 'Sender ' || lang WHEN 2 THEN 'Sender ' || lang
  WHEN 3 THEN '' ELSE 'Doe "Jane", ' || lang END"""


@query("parse_address", f"SELECT id, {NAME_SQL} AS name, lang || '@example.org' AS addr FROM v_emails")
def _(t, spark):
    return t.emails.select("id", M.parse_address(sender_header()).alias("a")).select("id", "a.name", "a.addr")


@query("epoch_ms_ts", "SELECT id, make_timestamp(CAST(internal_ms AS BIGINT) * 1000) AS internal_ts FROM v_emails")
def _(t, spark):
    return t.emails.select("id", X.epoch_ms_ts(F.col("internal_ms")).cast("timestamp_ntz").alias("internal_ts"))


@query("labels_array", """SELECT id, CASE WHEN source = 'src1' THEN '' ELSE 'INBOX,' || source END AS labels,
  source <> 'src1' AS in_inbox FROM v_emails""")
def _(t, spark):
    labels = X.labels_array(F.when(F.col("source") != "src1", F.array(F.lit("INBOX"), F.col("source"))))
    return t.emails.select("id", F.array_join(labels, ",").alias("labels"),
                           F.array_contains(labels, "INBOX").alias("in_inbox"))


def html(col):
    return F.concat(F.lit("<p>"), col, F.lit("</p><br/>"))


def payload(body):
    """A message payload by id: plain; HTML before plain; nested HTML; attachment only; plain far down."""
    def node(kind, data=None, *parts):
        pieces = [F.lit(f'{{"mimeType":"{kind}"')]
        if data is not None:
            pieces += [F.lit(',"body":{"data":"'), b64url(data), F.lit('"}')]
        if parts:
            pieces.append(F.lit(',"parts":['))
            for i, p in enumerate(parts):
                pieces += [F.lit("," if i else ""), p]
            pieces.append(F.lit("]"))
        return F.concat(*pieces, F.lit("}"))

    plain, page = node("text/plain", body), node("text/html", html(body))
    deep = plain
    for _ in range(7):
        deep = node("multipart/mixed", None, node("image/png"), deep)
    mark = F.col("id").cast("bigint") % 5
    return (F.when(mark == 0, plain).when(mark == 1, node("multipart/alternative", None, page, plain))
            .when(mark == 2, node("multipart/mixed", None, node("multipart/related", None, node("text/plain"), page)))
            .when(mark == 3, node("multipart/mixed", None, node("image/png"), node("application/pdf")))
            .otherwise(deep))


STRIPPED = "trim(regexp_replace('<p>' || body || '</p><br/>', '<[^>]+>', ' ', 'g'), {ws})"
BODY_SQL = f"""CASE CAST(id AS BIGINT) % 5 WHEN 0 THEN trim(body, {WS}) WHEN 1 THEN {STRIPPED.format(ws=WS)}
  WHEN 2 THEN {STRIPPED.format(ws=WS)} WHEN 3 THEN '' ELSE trim(body, {WS}) END"""


@query("mime_body", f"SELECT id, {BODY_SQL} AS body FROM v_emails")
def _(t, spark):
    return t.emails.select("id", M.mime_body(payload(F.col("body"))).alias("body"))


@query("mime_body_odd", """SELECT id, CASE WHEN CAST(id AS BIGINT) % 8 IN (0, 5, 6) THEN 'ok ' || id ELSE '' END AS body FROM v_emails""")
def _(t, spark):
    """Children that are no objects, bodies that are text, and broken documents, at every depth from 0 to 8; good parts beside them count."""
    number = F.col("id").cast("bigint")
    good = F.replace(F.replace(F.base64(F.encode(F.concat(F.lit("ok "), "id"), "UTF-8")), F.lit("\r\n"), F.lit("")), F.lit("="), F.lit(""))
    part = F.concat(F.lit('{"mimeType":"text/plain","body":{"data":"'), good, F.lit('"}}'))
    kinds = [part, F.lit("5"), F.lit('{"mimeType":"text/plain","body":"x"}'), F.lit('{"mimeType":7,"body":{"data":[1]},"parts":{"a":1}}'),
             F.lit('{"mimeType":"text/html","body":null,"parts":"x"}'), F.concat(F.lit('{"parts":[1,null,"x",[2],'), part, F.lit("]}")),
             F.concat(F.lit('{"parts":[{"mimeType":"text/plain","body":{}},'), part, F.lit("]}")), F.lit('{"mimeType":')]
    node = reduce(lambda other, k: F.when(number % 8 == k, kinds[k]).otherwise(other), range(7), kinds[7])
    nested = [node]
    for _ in range(8):
        nested.append(F.concat(F.lit('{"mimeType":"multipart/mixed","parts":['), nested[-1], F.lit("]}")))
    depth = F.floor(number / 8) % 9
    doc = reduce(lambda other, k: F.when(depth == k, nested[k]).otherwise(other), range(8), nested[8])
    return t.emails.select("id", M.mime_body(doc).alias("body"))


@query("mime_body_malformed", """SELECT id, CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN 'ok ' || id ELSE '' END AS body FROM v_emails""")
def _(t, spark):
    """Data that is no base64 gives a blank body at every depth from 0 to 8."""
    number = F.col("id").cast("bigint")
    good = F.replace(F.replace(F.base64(F.encode(F.concat(F.lit("ok "), "id"), "UTF-8")), F.lit("\r\n"), F.lit("")), F.lit("="), F.lit(""))
    data = F.when(number % 4 == 0, good).when(number % 4 == 1, F.lit("!!!!")).when(number % 4 == 2, F.lit("A")).otherwise(F.lit("QUJ=RA"))
    node = F.concat(F.lit('{"mimeType":"text/plain","body":{"data":"'), data, F.lit('"}}'))
    nested = [node]
    for _ in range(8):
        nested.append(F.concat(F.lit('{"mimeType":"multipart/mixed","parts":['), nested[-1], F.lit("]}")))
    depth = F.floor(number / 4) % 9
    doc = reduce(lambda other, k: F.when(depth == k, nested[k]).otherwise(other), range(8), nested[8])
    return t.emails.select("id", M.mime_body(doc).alias("body"))


@query("read_mail_json", f"""SELECT id, thread_id, lang || '@example.org' AS from_addr, {NAME_SQL} AS from_name, to_addrs, subject,
  snippet, {BODY_SQL} AS body, CASE WHEN source = 'src1' THEN '' ELSE 'INBOX' END AS labels,
  make_timestamp(CAST(internal_ms AS BIGINT) * 1000) AS internal_ts FROM v_emails""")
def _(t, spark):
    path = scratch(spark, "messages")
    head = F.to_json(F.struct(
        "id", F.col("thread_id").alias("threadId"), "snippet", F.col("internal_ms").alias("internalDate"),
        F.when(F.col("source") != "src1", F.array(F.lit("INBOX"))).alias("labelIds")))
    named = F.to_json(headers(("From", sender_header()), ("To", F.lit("first@example.org")), ("Subject", F.col("subject")),
                              ("TO", F.col("to_addrs"))))
    body = F.regexp_replace(payload(F.col("body")), r"\}$", "")
    t.emails.select(F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"payload":'), body, F.lit(',"headers":'), named,
                             F.lit("}}"))).write.text(path)
    rows = read_mail_json(spark, path)
    return rows.select("id", "thread_id", "from_addr", "from_name", "to_addrs", "subject", "snippet", "body",
                       F.array_join("labels", ",").alias("labels"), F.col("internal_ts").cast("timestamp_ntz").alias("internal_ts"))


@query("merge_pages", """SELECT c_name || '@example.org' AS mailbox FROM customer WHERE c_mktsegment <> 'BUILDING'""")
def _(t, spark):
    path = scratch(spark, "accounts")
    user = F.struct(F.concat("c_name", F.lit("@example.org")).alias("primaryEmail"),
                    F.when(F.col("c_mktsegment") == "BUILDING", F.lit(True))
                    .when(F.col("c_mktsegment") == "MACHINERY", F.lit(False)).alias("suspended"))
    (t.customer.groupBy(F.floor(F.col("c_custkey") / 20).alias("nextPageToken"))
     .agg(F.collect_list(user).alias("users")).write.json(path))
    return M.merge_pages(read_account_pages(spark, path))


@query("distinct_sorted", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS cycle FROM orders ORDER BY 1")
def _(t, spark):
    return t.orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("cycle")).distinct().orderBy("cycle")


@query("platform_stats", f"""SELECT 'count' AS section, relation AS name, rows AS n, CAST(NULL AS DOUBLE) AS share,
  CAST(NULL AS INTEGER) AS position, CAST(NULL AS STRING) AS note, CAST(NULL AS BOOLEAN) AS enabled, CAST(NULL AS TIMESTAMP) AS last_finished_at
FROM (SELECT 'operators' AS relation, count(*) AS rows FROM v_operators
  UNION ALL SELECT 'aircraft', count(*) FROM v_link UNION ALL SELECT 'registry', count(*) FROM v_registry
  UNION ALL SELECT 'reference', count(*) FROM v_ref UNION ALL SELECT 'emails', count(*) FROM v_emails
  UNION ALL SELECT 'adsb_ready', count(*) FROM v_link p JOIN v_operators o USING (certificate_designator)
    JOIN v_registry r ON r.n_number = p.n_number WHERE r.mode_s_hex <> ''
  UNION ALL SELECT 'charter_segments', count(*) FROM v_t100 WHERE class IN ('L', 'P')
  UNION ALL SELECT 'airports', count(*) FROM v_airports) c
UNION ALL SELECT 'category', category, n, round(n * 100.0::DOUBLE / greatest(max(n) OVER (), 1), 1), NULL, NULL, NULL, NULL FROM ({COUNT_SQL}) k
UNION ALL SELECT 'operator', operator_name, n, NULL, CAST(row_number() OVER (ORDER BY n DESC, operator_name) AS INTEGER), NULL, NULL, NULL
FROM ({TOP_SQL}) o
UNION ALL SELECT 'job', display_name, NULL, NULL, NULL, shown_status, enabled, last_finished_at FROM ({STATUS}) j""")
def _(t, spark):
    return platform.platform_stats(t)


# The twin names the word forms; tests/test_stem.py checks the stems on the public sample words.
@query("text_search_stemmed", found(f"""doc_id IN (SELECT doc_id FROM p WHERE token IN {forms('licens')}) OR (doc_id IN (SELECT doc_id FROM p
  WHERE token IN {forms('bless')}) AND doc_id IN (SELECT a.doc_id FROM p a JOIN p b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 WHERE a.token IN
  {forms('ing')} AND b.token IN {forms('er')}) AND doc_id NOT IN (SELECT doc_id FROM p WHERE token IN {forms('tion')}))"""))
def _(t, spark):
    postings = doc_postings(t)
    q = Query((Clause(("licensed",)), Clause(("ing er", "blessed"), ("tions",))))
    return text_search(postings, q, "doc_id", stems=vocabulary(postings))
