from recollect.functions import text as X


def test_topic_of_a_text_without_ascii_letters_is_general(spark):
    rows = [("decision", "Ö Ö", "Ö Ö Ö"), ("decision", "", "Keep  Ö it"), ("decision", "Decision", ""), ("identity", "Who-- am I?", None)]
    got = spark.createDataFrame(rows, "kind string, title string, body string").select(X.topic_key("kind", "title", "body").alias("t")).collect()
    assert [r.t for r in got] == ["decision/general", "decision/keep-it", "decision/general", "identity/who-am-i"]
