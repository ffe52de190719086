"""Stems of the public sample vocabulary, and search by stem."""

from pyspark.sql import functions as F

from skyspine.functions import stem
from skyspine.functions.stem import english_stem
from skyspine.functions.text import tokens
from skyspine.operators.textindex import Clause, Query, build_text_index, text_search, vocabulary

SAMPLES = """consign consign; consigned consign; consigning consign; consignment consign; consist consist;
consistency consist; consistent consist; consistently consist; consolation consol; consolatory consolatori;
conspicuous conspicu; conspicuously conspicu; conspiracy conspiraci; constable constabl; constancy constanc;
knackeries knackeri; knaves knave; knavish knavish; kneaded knead; knelt knelt; knightly knight; knocked knock;
generate generat; generic generic; general general; generously generous; communication communic; community communiti;
hopping hop; hoping hope; cries cri; ties tie; gas gas; kiwis kiwi; gaps gap; this this; dying die; happy happi;
say say; by by; enjoy enjoy; relational relat; conditional condit; rational ration; digitizer digit; operator oper;
feudalism feudal; hopefulness hope; callousness callous; sensibility sensibl; triplicate triplic; electrical electr;
goodness good; revival reviv; allowance allow; inference infer; airliner airlin; adjustable adjust; defensible defens;
replacement replac; adoption adopt; activate activ; effective effect; probate probat; rate rate; cease ceas;
controlled control; rolling roll; agreed agre; feed feed; plastered plaster; bled bled; motoring motor; sing sing;
conflated conflat; troubled troubl; sized size; falling fall; hissing hiss; failing fail; filing file; proceed proceed;
innings inning; news news; skies sky; early earli; flights flight; flying fli; flies fli; aircraft aircraft;
charters charter; charter charter; airports airport; operations oper; passengers passeng; the the; ab ab"""
PAIRS = [tuple(p.split()) for p in SAMPLES.replace("\n", " ").split(";")]


def test_samples(spark):
    got = {r.token: r.stem for r in spark.createDataFrame([(w,) for w, _ in PAIRS], "token STRING").select(
        "token", english_stem(F.col("token")).alias("stem")).collect()}
    assert {w: (got[w], s) for w, s in PAIRS if got[w] != s} == {}


def test_search_by_stem(spark, folder):
    from skyspine.operators.textindex import read_text_index, write_text_index
    docs = spark.createDataFrame([(1, "Charter flights to Nice"), (2, "a chartered flight"), (3, "flight charter"),
                                  (4, "chart of flies"), (5, "doing the flight")], "id INT, text STRING")
    postings = build_text_index(docs, "id", F.col("text"))
    write_text_index(postings, folder + "/index")
    for index in (postings, read_text_index(spark, folder + "/index")):
        stems = vocabulary(index)
        def find(*clauses):
            return sorted(r.id for r in text_search(index, Query(clauses), "id", docs=docs, stems=stems).collect())
        assert find(Clause(("charters",))) == [1, 2, 3]
        assert find(Clause(("chartering flights",))) == [1, 2]
        assert find(Clause(("flight",), ("charter",))) == [5]
        assert find(Clause(("doings",))) == []  # "doing" is a stop word
        assert find(Clause(("flew",)), Clause(("fly",))) == [4]


def test_prefilter_loses_no_word(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = vocabulary(build_text_index(rows, "doc_id", F.col("text")))
    words = words.select("token", "stem").unionByName(spark.createDataFrame(PAIRS, "token STRING, stem STRING"))
    from skyspine.functions.stem import SPECIAL
    lost = words.where(~F.col("token").startswith(F.left(F.col("stem"), F.lit(2))) & ~F.col("token").isin(list(SPECIAL)))
    assert lost.count() == 0 and words.count() > 1000


def test_the_cheap_condition_loses_no_word(spark):
    """Over the whole vocabulary of the test documents and the public sample words."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = docs.select(F.explode(tokens(F.col("text"))).alias("w")).distinct()
    words = words.select("w", stem.english_stem(F.col("w")).alias("s"))
    special = F.col("w").isin(list(stem.SPECIAL))
    assert words.where((F.substring("w", 1, 2) != F.substring("s", 1, 2)) & ~special).count() == 0
    some = [r["s"] for r in words.select("s").distinct().limit(40).collect()]
    found = words.where(F.col("s").isin(some))
    assert found.where(~stem.may_have_stem(F.col("w"), some)).count() == 0 and found.count() >= 40
