import random

from recollect.operators import similarity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def some(rng, n):
    words = "almond antique burnished blue chiffon dark firebrick green misty navajo".split()
    out = set()
    while len(out) < n:
        name = list(" ".join(rng.sample(words, rng.randint(1, 4))) if rng.random() < 0.6 else "".join(rng.choices("abca", k=rng.randint(0, 14))))
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, len(name))
            name[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "B", "aa"])
        out.add("".join(name))
    return sorted(out)


def test_similar_names_equal_brute_force(spark):
    names = [*some(random.Random(1), 350), "aaaaaaaaaaaa", "aaaaaaaaaaaaa", "abababababab", "bababababa", " navajo ", "NAVAJO"]
    got = {(r.name, r.other): (r.match, r.distance) for r in similarity.similar_names(spark.createDataFrame([(x,) for x in names], "name string")).collect()}
    want = {}
    for a in names:
        for b in names:
            x, y = a.strip(" ").lower(), b.strip(" ").lower()
            if a == b:
                continue
            if x == y:
                want[a, b] = ("case", 0)
            elif len(x) >= 3 and (x in y or y in x):
                want[a, b] = ("substring", 0)
            elif (d := distance(x, y)) <= min(3, max(len(x) // 2, 1)):
                want[a, b] = ("levenshtein", d)
    assert got == want and len({m for m, _ in want.values()}) == 3


def test_candidates_are_few(spark):
    """A thousand names of four of sixty words: all their trigrams are common, but few names are alike."""
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdeilmnorstu", k=rng.randint(6, 9))) for _ in range(60)]
    names = {" ".join(rng.sample(words, 4)) for _ in range(1_000)}
    names |= {x[:-1] + "x" for x in rng.sample(sorted(names), 100)}
    df = spark.createDataFrame([(x,) for x in names], "low string")
    found = similarity.near_names(df).count() + 2 * similarity.containing_names(df).count()
    results = similarity.similar_names(df.withColumnRenamed("low", "name")).count()
    assert results >= 200 and found < 10 * results
