import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recollect.functions import stems
from recollect.operators import search

# The examples of the published rules.
EXAMPLES = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor",
    "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
    "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc", "hesitanci": "hesit", "digitizer": "digit",
    "conformabli": "conform", "radicalli": "radic", "differentli": "differ", "vileli": "vile", "analogousli": "analog", "vietnamization": "vietnam", "predication": "predic", "operator": "oper",
    "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic",
    "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer",
    "airliner": "airlin", "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend",
    "adoption": "adopt", "homologou": "homolog", "communism": "commun", "activate": "activ", "angulariti": "angular", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "archaeology": "archaeolog", "possibly": "possibl",
}


def test_published_examples():
    assert {w: stems.stem(w) for w in EXAMPLES} == EXAMPLES


def test_folding_and_lengths():
    assert [stems.stem(w) for w in ("is", "s", "", "é", "cafés", "naïvely", "größen", "x" * 65 + "s", "2023s", "日本語")] == ["is", "s", "", "e", "cafe", "naiv", "großen", "x" * 65 + "s", "2023", "日本語"]


def test_rules_as_sql_agree():
    words = [a + b + c for a in ("tr", "oy", "cyy", "ab", "relat", "yell", "consol", "x") for b in [*stems.STEP_2, *stems.STEP_3, *stems.STEP_4, "ed", "ing", "eed", "y", "e", "ll", "at", "tt"] for c in ("", "s", "ed", "ing", "es")]
    con = duckdb.connect()
    con.register("words", pa.table({"term": words + list(EXAMPLES)}))
    parts = ", ".join(f"{k} AS ({v})" for k, v in stems.sql_steps("words").items())
    assert [(w, s) for w, s in con.sql(f"WITH {parts} SELECT term, stem FROM stems").fetchall() if stems.stem(w) != s] == []


@pytest.fixture
def docs(spark):
    rows = [(1, "Testing", "the tests were run", "en"), (2, "other", "a test of résumés", None), (3, None, "resume of connections", "de"), (4, "connected", None, "test"), (5, "nothing", "", "fr")]
    return spark.createDataFrame(rows, "id long, title string, body string, domain string")


def test_search_meets_by_stems_over_all_fields(spark, docs):
    queries = spark.createDataFrame([(1, ["tests"]), (2, ["resumes", "connection"]), (3, ["connects", "tested"]), (4, ["absent"])], "query_id long, terms array<string>")
    got = {}
    for r in search.matches(docs, queries).collect():
        got.setdefault((r.query_id, r.lane), set()).add(r.id)
    assert got == {(1, "all"): {1, 2, 4}, (2, "all"): {3}, (3, "all"): {4}}
    one = {(r.term, r.id): (r.tf, r.dl) for r in search.postings(docs).filter(F.col("term").isin("test", "connect")).collect()}
    assert one == {("test", 1): (2, 6), ("test", 2): (1, 5), ("test", 4): (1, 2), ("connect", 3): (1, 4), ("connect", 4): (1, 2)}
