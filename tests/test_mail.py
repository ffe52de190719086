"""Message bodies and text search against brute force."""

import base64
import json
import random
import re

from pyspark.sql import functions as F

from skyspine.operators import mail as M
from skyspine.operators.textindex import Clause, Query, build_text_index, read_text_index, text_search, write_text_index


def b64(text):
    return base64.urlsafe_b64encode(text.encode()).decode()


def part(kind, data=None, *parts):
    node = {"mimeType": kind, "body": {} if data is None else {"data": b64(data)}}
    if parts:
        node["parts"] = list(parts)
    return node


def expected_body(node):
    """Plain node: its own text. Else the first child with text. Else its own HTML without tags."""
    kind, data = node["mimeType"], node["body"].get("data")
    text = base64.urlsafe_b64decode(data).decode() if data else ""
    if kind == "text/plain" and data:
        return text
    children = (expected_body(p) for p in node.get("parts", []))
    first = next((c for c in children if c), "")
    return first or (re.sub("<[^>]+>", " ", text) if kind == "text/html" else "")


def bodies(values, payloads):
    return values(lambda d: M.mime_body(d.x), [json.dumps(p) for p in payloads])


def test_mime_order(values):
    html, plain = part("text/html", "<b>hi</b> there"), part("text/plain", " plain ")
    cases = [plain, html, part("multipart/alternative", None, html, plain), part("multipart/alternative", None, plain, html),
             part("text/plain", "own", html), part("text/html", "<i>own</i>", plain), part("multipart/mixed"),
             part("multipart/mixed", None, part("image/png", "x"), part("multipart/related", None, part("text/plain"), html)),
             part("text/plain", None, html), part("text/html", "<i>last</i>", part("image/png"))]
    assert bodies(values, cases) == [expected_body(c).strip() for c in cases]
    assert values(lambda d: M.mime_body(d.x), [None, "{}"]) == ["", ""]


def test_mime_random_trees(values):
    rnd = random.Random(7)

    def tree(depth):
        kind = rnd.choice(["text/plain", "text/html", "multipart/mixed", "image/png"])
        data = rnd.choice([None, "", "<p>a</p>", "text é", "   "])
        kids = [tree(depth - 1) for _ in range(rnd.randint(0, 3))] if depth else []
        return part(kind, data, *kids)

    cases = [tree(rnd.randint(0, 9)) for _ in range(150)]
    assert bodies(values, cases) == [expected_body(c).strip() for c in cases]


def test_mime_drops_bad_bytes(values):
    raw = base64.urlsafe_b64encode(b"ok\xff\xfe!").decode()
    doc = json.dumps({"mimeType": "text/plain", "body": {"data": raw}})
    assert values(lambda d: M.mime_body(d.x), [doc]) == ["ok!"]


WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "Éclair"]


def corpus(n, seed=3):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 12)))) for i in range(n)]


def brute(docs, query, stop):
    def words(t):
        return re.findall(r"[^\W_]+", t.lower())

    def occurs(term, text):
        want = [(i, w) for i, w in enumerate(words(term)) if w not in stop]
        have = words(text)
        base = want[0][0]
        return any(all(0 <= s + i - base < len(have) and have[s + i - base] == w for i, w in want) for s in range(len(have)))

    def fits(c, text):
        return all(occurs(x, text) for x in c.all) and not any(occurs(x, text) for x in c.none)
    return sorted(i for i, text in docs if any(fits(c, text) for c in query.any_of))


def test_text_search(spark, folder):
    docs = corpus(400)
    df = spark.createDataFrame(docs, "id INT, text STRING")
    postings = build_text_index(df, "id", F.col("text"))
    write_text_index(postings, folder + "/index")
    stored = read_text_index(spark, folder + "/index")
    queries = [Query((Clause(("alpha", "ÉCLAIR")),)), Query((Clause(("alpha beta",)),)),
               Query((Clause(("alpha the gamma",), ("delta",)),)), Query((Clause(("alpha beta gamma",)), Clause(("delta delta",)))),
               Query((Clause((), ("alpha",)),)), Query((Clause(("beta",), ("beta gamma", "alpha")),)), Query((Clause(("missing",)),))]
    for q in queries:
        want = brute(docs, q, {"the", "of"})
        for index in (postings, stored):
            got = sorted(r.id for r in text_search(index, q, "id", docs=df, stop_words=["the", "of"]).collect())
            assert got == want, q


def test_stored_search_reads_only_its_words(spark, folder):
    postings = build_text_index(spark.createDataFrame(corpus(200), "id INT, text STRING"), "id", F.col("text"))
    write_text_index(postings, folder + "/index")
    found = text_search(read_text_index(spark, folder + "/index"), Query((Clause(("alpha",)),)), "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan)
    assert re.search(r"PushedFilters: \[[^]]*EqualTo\(token,alpha\)", plan)


def test_only_stop_words_finds_nothing(spark):
    df = spark.createDataFrame(corpus(20), "id INT, text STRING")
    postings = build_text_index(df, "id", F.col("text"))
    assert text_search(postings, Query((Clause(("the of",)),)), "id").count() == 0


def test_mail_list_order(spark):
    rows = [("1", "m", "a", "n", "alpha", "s", "b", None), ("2", "m", "a", "n", "alpha", "s", "b", "2024-01-01"),
            ("3", "x", "a", "n", "alpha", "s", "b", "2024-01-03"), ("4", "m", "a", "n", "beta", "s", "b", "2024-01-04")]
    emails = spark.createDataFrame(rows, "id STRING, mailbox STRING, from_addr STRING, from_name STRING, subject STRING, "
                                         "snippet STRING, body STRING, internal_ts STRING")
    found = M.mail_list(emails, Query((Clause(("alpha",)),)), mailbox="m")
    assert [r.id for r in found.collect()] == ["2", "1"]


def test_merge_pages(spark):
    pages = spark.createDataFrame([([("a", False), ("b", True)],), ([("c", None)],), ([],)],
                                  "users ARRAY<STRUCT<primaryEmail: STRING, suspended: BOOLEAN>>")
    assert sorted(r.mailbox for r in M.merge_pages(pages).collect()) == ["a", "c"]


def test_no_message_ends_a_load(spark):
    """The column expression and the Arrow function agree on odd parts, at every depth on both sides of their border."""
    import base64
    from skyspine.operators.mail import mime_body
    good = base64.urlsafe_b64encode("fine é".encode()).decode().rstrip("=")
    part = '{"mimeType":"text/plain","body":{"data":"%s"}}' % good
    odd = {"5": "", "null": "", '"x"': "", "[1]": "", "true": "", '{"body":"x","mimeType":"text/plain"}': "", '{"body":[1]}': "",
           '{"mimeType":"text/plain","body":{"data":5}}': "", '{"mimeType":{"a":1},"parts":{"b":2}}': "", '{"parts":[1,null,"x",[2],%s]}' % part: "fine é",
           '{"mimeType":"text/html","body":{"data":"%s"},"parts":[7]}' % good: "fine é", '{"mimeType":': "", "": "", "nonsense": "", part: "fine é"}
    rows = []
    for node, want in odd.items():
        doc = node
        for depth in range(9):
            rows.append((doc, want, depth))
            doc = '{"mimeType":"multipart/mixed","parts":[%s]}' % doc
    rows.append((None, "", 0))
    rows.append(('{"parts":[' * 3000 + "]}" * 3000, "", 3000))
    got = spark.createDataFrame(rows, "doc STRING, want STRING, depth INT").select("doc", "want", "depth", mime_body(F.col("doc")).alias("body")).collect()
    assert [(r.doc[:60], r.depth, r.body) for r in got if r.doc and r.body != r.want] == []


def test_landed_mailboxes_are_packed(spark, monkeypatch):
    from pathlib import Path
    from skyspine import workload
    from skyspine.session import scratch
    from skyspine.workload import loads
    landed = []
    def recorded(s, name):
        path = scratch(s, name)
        landed.extend([path] if name == "mail" else [])
        return path
    queries = workload.queries()
    monkeypatch.setattr(loads, "scratch", recorded)
    assert queries["ingest_mailboxes"](spark, "/root/testdata/sf0.001").count() > 0
    files = [f.name for path in landed for f in Path(path).glob("mailbox=*/part-*")]
    assert len(landed) == 2 and files and all(f.endswith(".txt.gz") for f in files)
