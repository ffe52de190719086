"""Mail products."""

from __future__ import annotations

from pyspark.sql import DataFrame

from skyspine.operators import mail as M
from skyspine.operators.ordering import up
from skyspine.operators.textindex import Query, WordIndex
from skyspine.tables import Tables


def mail_search(t: Tables, query: Query | None = None, mailbox: str | None = None, limit: int = 50,
                postings: DataFrame | None = None, stems: DataFrame | None = None, stemmed: bool = True,
                index: WordIndex | None = None) -> DataFrame:
    return M.mail_list(t.emails, query, mailbox, limit, postings, stems, stemmed, index)


def mailboxes(t: Tables) -> DataFrame:
    return M.mailbox_counts(t.emails).orderBy(up("mailbox"))
