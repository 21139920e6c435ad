import itertools
import json
import math
import random

from pyspark.sql import functions as F

from recollect.operators import evaluate, imports, lifecycle, similarity, vector
from recollect.sources import readers


def test_hashed_embedding_is_that_of_its_definition(spark):
    texts = ["Hello, hello world", "", None, "ß x1 " * 400, "日本 naïve"]

    def plain(text):
        out, words = [0.0] * 16, "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        for i, w in enumerate(words):
            h = 0xCBF29CE484222325
            for b in w.encode():
                h = ((h ^ b) * 0x100000001B3) % (1 << 64)
            out[h % 16] += (-1 if h >> 63 else 1) / math.sqrt(i + 1)
        norm = math.sqrt(sum(x * x for x in out))
        return [x / norm if norm else 0.0 for x in out]

    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    for r in df.select("id", vector.hashed_embedding(F.col("body"), 16).alias("e")).collect():
        assert all(abs(a - b) < 1e-5 for a, b in zip(r.e, plain(texts[r.id]), strict=True))


def test_query_operators(spark):
    rows = [(1, "find asof:2023-01-01 the since:x rest"), (2, "path:"), (3, "a file: b"), (4, None), (5, "session:s1"), (6, "one file:f.py two")]
    got = {r.id: r for r in imports.parsed_queries(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert (got[1].asof, got[1].since, got[1].terms) == ("2023-01-01", "x", "find the rest")
    assert (got[2].path, got[2].terms) == (None, "path:") and (got[3].file, got[3].terms) == (None, "a b")
    assert got[4].terms == "" and (got[5].session, got[5].terms) == ("s1", "") and (got[6].file, got[6].terms) == ("f.py", "one two")


def groups_by_hand(names):
    used, out = set(), {}
    for i, a in enumerate(names):
        if a in used:
            continue
        for b in names[i + 1 :]:
            x, y = a.lower(), b.lower()
            if b not in used and (x in y or y in x or (min(len(x), len(y)) >= 4 and x[:4] == y[:4])):
                out[b] = a
                used.add(b)
        if a in out.values():
            out[a] = a
    return out


def test_project_groups_and_names_against_all_pairs(spark):
    rng = random.Random(4)
    names = sorted({"".join(rng.choices("abAB-", k=rng.randint(1, 7))) for _ in range(70)} | {"tool", "tools", "toolbox", "a", "zz"})
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r.name: r.lead for r in similarity.project_groups(df).collect()} == groups_by_hand(names)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    want = set()
    for a, b in itertools.permutations(names, 2):
        x, y = a.lower(), b.lower()
        near = distance(x, y) <= min(3, max(len(x) // 2, 1))
        if x == y or (len(x) >= 3 and (x in y or y in x)) or near:
            want.add((a, b))
    assert {(r.name, r.other) for r in similarity.similar_names(df).collect()} == want


def test_records_of_equal_words_conflict(spark):
    rows = [(1, "p", "decision", "Cache writes early"), (2, "p", "decision", "early: cache writes"), (3, "p", "decision", "cache writes twice"), (4, "p", "decision", "unrelated thing"), (5, "q", "decision", "Cache writes early")]
    items = spark.createDataFrame(rows, "id long, project_id string, kind string, title string").withColumn("status", F.lit("active"))
    got = {r.id: (r.rival, r.overlap) for r in similarity.conflicts(items, 0.4).collect()}
    assert got == {1: (2, 1.0), 2: (1, 1.0), 3: (1, 0.5)}
    links = {r.id: (r.class_id, r.links) for r in similarity.title_links(items, 0.4).collect()}
    assert links == {1: (1, 2), 2: (1, 2), 3: (3, 2), 4: (4, 0), 5: (5, 0)}


def test_readers(spark, tmp_path):
    doc = tmp_path / "one"
    (doc / "chunks" / "chunk_id=ab").mkdir(parents=True)
    (doc / "manifest.json").write_text(json.dumps({"version": 1, "chunks": [{"id": "ab", "created_by": "x", "rows": 1}, {"id": "gone", "created_by": "x", "rows": 9}]}, indent=1))
    (doc / "chunks" / "chunk_id=ab" / "a.json").write_text('{"id": 7}\n')
    (doc / "chunks" / "chunk_id=zz").mkdir()
    (doc / "chunks" / "chunk_id=zz" / "a.json").write_text('{"id": 8}\n')
    folder = f"file://{doc}"
    assert readers.read_manifest(spark, folder).count() == 2
    assert [r.id for r in readers.read_chunks(spark, folder, "id long").collect()] == [7]
    lines = tmp_path / "l.jsonl"
    lines.write_text('{"a": 1}\n\n{"a": \n  {"a": "x"}\n{"a": null}\n')
    rows, bad = readers.read_lines(spark, f"file://{lines}", "a long")
    assert sorted(str(r.a) for r in rows.collect()) == ["1", "None"] and bad.count() == 2
    array = tmp_path / "a.json"
    array.write_text(' \n [{"a": 1},\n {"a": 2}]')
    assert readers.is_array(spark, f"file://{array}") and not readers.is_array(spark, f"file://{lines}")
    assert {r.a for r in readers.read_any(spark, f"file://{array}", "a long").collect()} == {1, 2}


def test_phrases_of_one_word_lie_inside_others(spark):
    docs = spark.createDataFrame([(1, "the foundation stone"), (2, "a stone wall of it"), (3, "Nothing")], "id long, text string")
    leads = spark.createDataFrame([(1, "found"), (2, "stone wall"), (3, "of it"), (4, "it"), (5, "stone wall of"), (6, "absent")], "query_id long, lead string")
    assert {(r.query_id, r.id) for r in evaluate.containing(docs, leads).collect()} == {(1, 1), (2, 2), (3, 2), (4, 2), (5, 2)}


def test_chunk_ids_and_seeds(spark):
    rows = spark.createDataFrame([("p", 1, "x"), ("p", 2, "y"), ("q", 1, "x")], "project string, id long, content string")
    a = {r.project: r.chunk_id for r in lifecycle.chunk_id(rows, "project", ["id", "content"]).collect()}
    b = {r.project: r.chunk_id for r in lifecycle.chunk_id(rows.orderBy(F.desc("id")), "project", ["id", "content"]).collect()}
    assert a == b and len(set(a.values())) == 2 and all(len(x) == 8 for x in a.values())
