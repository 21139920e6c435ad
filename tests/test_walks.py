import json
import random
import re

from pyspark.sql import functions as F

from recollect.functions import text as X
from recollect.operators import chains, json_walk
from recollect.streaming import flows

WORDS = "cache writes **bold** `code` *it* a lot of tests fail early".split()


def brute_learnings(text):
    """Sections from the last one backwards; a plain reading of the rule."""
    headers = list(re.finditer(r"(?im)^#{2,3}[ \t\n\r\f]+(?:Aprendizajes(?:\s+Clave)?|Key\s+Learnings?|Learnings?):?[ \t\n\r\f]*$", text or ""))
    for h in reversed(headers):
        section = re.split(r"\n#{1,3} ", text[h.end() :])[0]
        for mark in (r"\d+[.)]", "[-*]"):
            out = []
            for line in re.findall(rf"(?m)^\s*{mark}\s+(.+)", section):
                for m in (r"\*\*([^*]+)\*\*", r"`([^`]+)`", r"\*([^*]+)\*"):
                    line = re.sub(m, r"\1", line)
                line = " ".join(line.split())
                if len(line.encode()) >= 20 and len(line.split()) >= 4:
                    out.append(line)
            if out:
                return out
    return []


def planted(rng):
    parts = []
    for _ in range(rng.randint(0, 4)):
        parts.append(rng.choice(["## Key Learnings:", "### learnings", "## Aprendizajes Clave", "#### Learnings", "## Other", "text", "", "# Big", "##  Key   Learning:  "]))
        for _ in range(rng.randint(0, 4)):
            parts.append(rng.choice(["1. ", "2) ", "- ", "* ", "  - ", "", "10.", "-"]) + " ".join(rng.choices(WORDS, k=rng.randint(0, 7))))
    return "\n".join(parts)


def test_learnings_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [planted(rng) for _ in range(1_500)] + [None, "", "## Learnings", "## Learnings\n", "## Learnings\n\n\n- four words are enough here"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.learnings("t").alias("l"))
    got = {r.i: r.l for r in df.collect()}
    want = {i: brute_learnings(t) for i, t in enumerate(texts)}
    assert got == want and sum(map(bool, want.values())) > 100


def test_capture_is_idempotent_over_batches_and_restarts(spark, tmp_path):
    source, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    say = lambda *items: "## Learnings\n" + "\n".join(f"- the lesson about {x} is this" for x in items)
    batches = [[("p", 1, say("a", "b", "a"))], [("p", 2, say("b", "c")), ("q", 3, say("a"))], [("p", 4, say("d")), ("p", 5, say("d", "a"))]]

    def add(batch):
        spark.createDataFrame(batch, "project string, id long, content string").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema("project string, id long, content string").option("maxFilesPerTrigger", 1).parquet(source)
        return sorted((r.project, r.body.split()[3], r.id) for r in flows.capture(stream, folder).collect())

    for batch in batches[:2]:
        add(batch)
    first = run()
    assert first == [("p", "a", 1), ("p", "b", 1), ("p", "c", 2), ("q", "a", 3)]
    assert run() == first  # started again with nothing new
    add(batches[2])
    assert run() == sorted([*first, ("p", "d", 4)])
    assert len(flows.epochs(spark, folder)) == 3
    # the last batch is taken back and run again, as after a failure before its commit
    commits = sorted((tmp_path / "out" / "state" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    commits[-1].unlink()
    for crc in (tmp_path / "out" / "state" / "commits").glob(f".{commits[-1].name}.crc"):
        crc.unlink()
    assert run() == sorted([*first, ("p", "d", 4)])


def test_json_strings_at_any_depth(spark):
    deep = "x/y"
    for i in range(30):
        deep = {"k": deep} if i % 3 else [deep, 1, None]
    texts = [json.dumps({"Files ": ["a", ["b", {"n": "c/d", "m": "e"}]], "path": "p"}), json.dumps(deep), '"f.py"', "{bad", "", None, "[]", "7", '{"file": "  "}', '{"files": {"other": "z"}}']
    got = {}
    for r in json_walk.path_hints(spark.createDataFrame(list(enumerate(texts)), "i int, j string"), "j").collect():
        got.setdefault(r.i, set()).add((r.key, r.value, r.depth))
    assert got == {0: {("files", "a", 2), ("files", "b", 3), ("n", "c/d", 4), ("path", "p", 1)}, 1: {("k", "x/y", 30)}, 2: {("", "f.py", 0)}}


def test_payloads_encoded_twice(spark):
    one = json.dumps({"a": 1, "b": "x \"y\" é"})
    texts = [one, json.dumps(one), "  " + json.dumps(one) + " ", "", None, "{", json.dumps("{"), json.dumps(json.dumps(one)), "7"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", json_walk.decoded("t", "a long, b string").alias("p")).collect()
    assert {r.i: tuple(r.p) for r in got if r.p and r.p.a} == {i: (1, 'x "y" é') for i in range(3)}


def test_long_chains_and_cycles_come_to_an_end(spark):
    n = 10_000
    rows = [(i, i + 1 if i < n - 1 else None) for i in range(n)]
    rows += [(20_000, 20_001), (20_001, 20_002), (20_002, 20_000), (20_003, 20_001)]  # a cycle and what leads into it
    rows += [(30_000, 0), (30_001, 30_001), (30_002, 99_999), (30_003, 30_002), (None, 5)]
    rows += [(40_000 + i, 1) for i in range(2_000)]  # many point at one
    random.Random(1).shuffle(rows)
    got = {r.id: (r.current_id, r.depth, r.cyclic) for r in chains.current(spark.createDataFrame(rows, "id long, superseded_by long")).collect()}
    assert len(got) == len(rows) - 1
    assert all(got[i] == (n - 1, n - 1 - i, False) for i in range(n))
    assert {got[i] for i in range(20_000, 20_004)} == {(None, None, True)}
    assert [got[30_000 + i] for i in range(4)] == [(30_000, 0, False), (30_001, 0, False), (30_002, 0, False), (30_002, 1, False)]
    assert {got[40_000 + i] for i in range(2_000)} == {(n - 1, n - 1, False)}
    assert chains.current(spark.createDataFrame([], "id long, superseded_by long")).filter(F.lit(True)).isEmpty()
