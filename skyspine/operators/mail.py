"""Mail messages: landed documents to rows, bodies, listings."""

from __future__ import annotations

import base64
import email.utils
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyspine.functions import fixed_values as V
from skyspine.functions.clean import blank_to_null
from skyspine.functions.text import (COMMON_ADDRESS, address_name, address_spec, decode_b64url, epoch_ms_ts, header_value,
                                     search_document, strip_tags)
from skyspine.functions.clean import strip
from skyspine.operators.ordering import down_nulls_last, page, up
from skyspine.operators.textindex import Query, WordIndex, indexed_search, kept, scan_search, text_search, vocabulary

BODY_DEPTH = 4


@F.pandas_udf(T.StringType())
def _deep_body(payload: pd.Series) -> pd.Series:
    """Bodies of messages nested deeper than the column expression reaches."""
    def text(data: str) -> str:
        """As ``decode_b64url``: white space is skipped, data that is no base64 is blank, bytes that are no UTF-8 are dropped."""
        std = data.replace("-", "+").replace("_", "/") + "=" * (-len(data) % 4)
        try:
            return base64.b64decode(re.sub("[ \t\r\n]", "", std), validate=True).decode("utf-8", "ignore").replace("\ufffd", "")
        except ValueError:
            return ""

    def scalar(value: object) -> str:
        """As a variant's scalar reads as text; objects and lists are none."""
        if isinstance(value, bool):
            return "true" if value else "false"
        return value if isinstance(value, str) else str(value) if isinstance(value, int) else ""

    def body(doc: str | None) -> str | None:
        if doc is None:
            return None
        try:
            stack = [(json.loads(doc), False)]
        except (ValueError, RecursionError):
            return ""
        while stack:
            node, children_done = stack.pop()
            if not isinstance(node, dict):
                continue  # a child that is no part
            held, parts = node.get("body"), node.get("parts")
            kind, data = scalar(node.get("mimeType")), scalar(held.get("data")) if isinstance(held, dict) else ""
            got = ""
            if children_done:
                got = re.sub(V.TAG_PATTERN, " ", text(data))
            elif kind == "text/plain" and data:
                got = text(data)
            else:
                if kind == "text/html" and data:
                    stack.append((node, True))
                stack.extend((child, False) for child in reversed(parts if isinstance(parts, list) else []))
            if got:
                return got
        return ""

    return payload.map(body)


def mime_body(payload_json: Column, depth: int = BODY_DEPTH) -> Column:
    """Readable text of a message payload.

    Depth first: a plain part speaks for itself; otherwise the first child with any text; otherwise the
    part's own HTML without tags. What is no part, no text or no JSON is blank. The column expression covers ``depth`` levels of parts; a message that
    may be nested deeper goes through the Arrow function, so no level is cut off.
    """
    def level(node: Column, left: int) -> Column:
        kind = F.try_variant_get(node, "$.mimeType", "string")
        text = decode_b64url(blank_to_null(F.try_variant_get(node, "$.body.data", "string")))
        inner = F.lit(None).cast("string")
        if left:
            parts = F.try_variant_get(node, "$.parts", "array<variant>")
            texts = F.transform(parts, lambda p: level(p, left - 1))
            inner = F.try_element_at(F.filter(texts, lambda x: x != ""), F.lit(1))
        return F.coalesce(F.when(kind == "text/plain", text), inner, F.when(kind == "text/html", strip_tags(text)),
                          F.lit(""))

    deep = F.regexp_count(payload_json, F.lit('"parts"\\s*:')) > depth
    # The one-element transform parses each document once instead of once per field.
    parsed = F.array(F.try_parse_json(F.when(~deep, payload_json)))
    shallow = F.element_at(F.transform(parsed, lambda node: level(node, depth)), 1)
    return strip(F.coalesce(F.when(~deep, shallow), _deep_body(F.when(deep, payload_json)), F.lit("")))


@F.pandas_udf(T.StructType([T.StructField("name", T.StringType()), T.StructField("addr", T.StringType())]))
def _odd_address(header: pd.Series) -> pd.DataFrame:
    pairs = [email.utils.parseaddr(h) if h is not None else (None, None) for h in header]
    return pd.DataFrame(pairs, columns=["name", "addr"])


def parse_address(header: Column) -> Column:
    """(name, addr) of a sender header. Common forms are column expressions, odd ones an Arrow function."""
    odd = ~header.rlike(COMMON_ADDRESS)
    common = F.struct(address_name(header).alias("name"), address_spec(header).alias("addr"))
    return F.when(header.isNull(), F.struct(F.lit("").alias("name"), F.lit("").alias("addr"))).when(
        odd, _odd_address(F.when(odd, header))).otherwise(common)


MESSAGE_DDL = "id STRING, threadId STRING, snippet STRING, labelIds ARRAY<STRING>, internalDate STRING"
HEADERS_DDL = "ARRAY<STRUCT<name: STRING, value: STRING>>"


def message_rows(messages: DataFrame, column: str = "value", mailbox: Column | None = None,
                 keep: list[str] | None = None) -> DataFrame:
    """Landed message documents (JSON text) to rows of the mail table."""
    doc = F.from_json(column, MESSAGE_DDL)
    payload = F.get_json_object(column, "$.payload")
    headers = F.from_json(F.get_json_object(column, "$.payload.headers"), HEADERS_DDL)
    keep = keep or []
    rows = messages.select(*keep, doc.alias("d"), payload.alias("payload"), headers.alias("h"),
                           (mailbox if mailbox is not None else F.lit(None).cast("string")).alias("mailbox"))
    sender = parse_address(header_value(F.col("h"), "from"))
    return rows.withColumn("sender", sender).select(
        F.col("d.id").alias("id"), F.col("d.threadId").alias("thread_id"), "mailbox",
        F.col("sender.addr").alias("from_addr"), F.col("sender.name").alias("from_name"),
        F.coalesce(header_value(F.col("h"), "to"), F.lit("")).alias("to_addrs"),
        F.coalesce(header_value(F.col("h"), "subject"), F.lit("")).alias("subject"),
        F.coalesce("d.snippet", F.lit("")).alias("snippet"),
        mime_body(F.col("payload")).alias("body"),
        F.coalesce("d.labelIds", F.array().cast("array<string>")).alias("labels"),
        epoch_ms_ts(F.col("d.internalDate")).alias("internal_ts"), *keep)


def merge_pages(pages: DataFrame) -> DataFrame:
    """Account pages (``users`` arrays) to one row per active account."""
    users = pages.select(F.explode("users").alias("u"))
    return users.where(~F.coalesce("u.suspended", F.lit(False))).select(F.col("u.primaryEmail").alias("mailbox"))


def searched_text() -> Column:
    return search_document(F.col("subject"), F.col("from_addr"), F.col("body"))


def mail_list(emails: DataFrame, query: Query | None = None, mailbox: str | None = None, limit: int = 50,
              postings: DataFrame | None = None, stems: DataFrame | None = None, stemmed: bool = True,
              index: WordIndex | None = None) -> DataFrame:
    """Newest messages that fit the query and the mailbox; a word stands for all words of its stem, unless ``stemmed`` is off.

    With a stored ``index`` only its words' postings are read, rarest first. Without one the messages left by the mailbox are
    scanned. Bare ``postings`` and their ``stems`` (``vocabulary``) can be given instead.
    """
    rows = emails.where(F.col("mailbox") == F.lit(mailbox)) if mailbox else emails
    if query is not None and index is not None:
        found = kept(indexed_search(index, query, "id", docs=rows, stemmed=stemmed), "found")
        rows = rows.join(found, "id", "left_semi")
    elif query is not None and postings is not None:
        stems = vocabulary(postings) if stemmed and stems is None else stems
        rows = rows.join(text_search(postings, query, "id", docs=rows, stems=stems if stemmed else None), "id", "left_semi")
    elif query is not None:
        rows = scan_search(rows, searched_text(), query, stemmed=stemmed)
    shown = rows.select("id", "mailbox", "from_addr", "from_name", "subject", "snippet", "internal_ts")
    return page(shown, [down_nulls_last("internal_ts"), up("id")], limit)


def mailbox_counts(emails: DataFrame) -> DataFrame:
    return emails.where(F.col("mailbox").isNotNull()).groupBy("mailbox").agg(F.count(F.lit(1)).alias("n"))
