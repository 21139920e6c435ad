"""Likeness of titles, bodies and names, and conflicts between records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect import schema as S
from recollect.functions import text as X
from recollect.sources.scratch import written


def title_words(items: DataFrame) -> DataFrame:
    return items.withColumn("words", F.array_sort(F.array_distinct(X.significant_words("title")))).filter(F.size("words") > 0)


def title_classes(items: DataFrame) -> DataFrame:
    """(project_id, kind, words, id, second, n): records of equal words as one class, with its two smallest ids."""
    words = title_words(items).select("project_id", "kind", "id", "words")
    least = words.groupBy("project_id", "kind", "words").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    if "__second" in items.columns:
        raise ValueError("items must not have a column __second")
    key = ["project_id", "kind", "words"]
    other = words.withColumnRenamed("id", "__second").join(least.filter("n > 1").select(*key, "id"), key).filter("__second > id")
    second = other.groupBy(*key).agg(F.min("__second").alias("second"))
    return least.join(second, key, "left").select(*key, "id", "second", "n")


def linked_classes(classes: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(project_id, kind, a, b, overlap): classes, by smallest id, whose Jaccard is over the threshold.

    Two sets over the threshold share a word among the first ``n - ceil(threshold * n) + 1`` of each in the order of rarity:
    only those are met.
    """
    classes = classes.select("project_id", "kind", "words", "id")
    flat = classes.select("project_id", "kind", "id", F.size("words").alias("size"), F.explode("words").alias("w"))
    df = flat.groupBy("project_id", "kind", "w").agg(F.count("*").alias("df"))
    order = Window.partitionBy("project_id", "kind", "id").orderBy("df", "w")
    first = flat.join(df, ["project_id", "kind", "w"]).withColumn("k", F.row_number().over(order))
    first = first.filter(F.col("k") <= F.col("size") - F.ceil(F.col("size") * threshold) + 1).select("project_id", "kind", "w", "id", "size")
    other = first.select("project_id", "kind", "w", F.col("id").alias("b"), F.col("size").alias("bs"))
    met = first.withColumnRenamed("id", "a").join(other, ["project_id", "kind", "w"]).filter(
        (F.col("a") < F.col("b")) & (F.least("size", "bs") > F.greatest("size", "bs") * threshold)
    )
    pairs = met.select("project_id", "kind", "a", "b").distinct()
    sets = classes.select("id", "words")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("words").alias("aw")), "a").join(sets.select(F.col("id").alias("b"), F.col("words").alias("bw")), "b")
    return both.select("project_id", "kind", "a", "b", X.jaccard(F.col("aw"), F.col("bw")).alias("overlap")).filter(F.col("overlap") > threshold)


def similar_titles(items: DataFrame, threshold: float = 0.6) -> DataFrame:
    """``linked_classes`` of records' titles: pairs between class representatives. ``title_links`` says who is in a class."""
    return linked_classes(title_classes(items), threshold)


def title_links(items: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(id, class_id, links) of each record with words: how many others are over the threshold, those of its class too."""
    classes = written(title_classes(items), "titles")
    pairs = linked_classes(classes, threshold)
    ends = pairs.select(F.col("a").alias("id"), F.col("b").alias("o")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("o")))
    met = ends.join(classes.select(F.col("id").alias("o"), "n"), "o").groupBy("id").agg(F.sum("n").alias("met"))
    sizes = classes.join(met, "id", "left").select("project_id", "kind", "words", F.col("id").alias("class_id"), (F.col("n") - 1 + F.coalesce("met", F.lit(0))).alias("links"))
    return title_words(items).select("project_id", "kind", "words", "id").join(sizes, ["project_id", "kind", "words"]).select("id", "class_id", "links")


def conflicts(items: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(id, rival, overlap): the strongest rival by title of each record of a kind that can contradict; of equal ones the smallest.

    A record with the same words as others rivals those, with overlap one.
    """
    chosen = items.filter((F.col("status") == "active") & F.col("kind").isin(S.CONFLICT_KINDS))
    classes = written(title_classes(chosen), "titles")
    pairs = linked_classes(classes, threshold)
    both = pairs.select(F.col("a").alias("class_id"), F.col("b").alias("rival"), "overlap").unionByName(pairs.select(F.col("b").alias("class_id"), F.col("a").alias("rival"), "overlap"))
    best = both.groupBy("class_id").agg(F.max(F.struct("overlap", (-F.col("rival")).alias("r"))).alias("b"))
    key = ["project_id", "kind", "words"]
    told = classes.withColumnRenamed("id", "class_id").join(best, "class_id", "left").select(*key, "class_id", "second", F.col("b.overlap").alias("o"), (-F.col("b.r")).alias("r"))
    rows = title_words(chosen).select(*key, "id").join(told, key)
    twin = F.when(F.col("id") != F.col("class_id"), F.col("class_id")).otherwise(F.col("second"))
    out = rows.select("id", F.coalesce(twin, "r").alias("rival"), F.when(twin.isNotNull(), 1.0).otherwise(F.col("o")).alias("overlap"))
    return out.filter("rival IS NOT NULL")


def body_conflicts(new: DataFrame, items: DataFrame, newest: int = 50, least: float = 0.3) -> DataFrame:
    """(id, rival, overlap): of the ``newest`` live records of the same project and kind, that whose title and body are most alike.

    TF-IDF cosine with the rival as the only document: its terms weigh 1, others of the new text 1 + ln 2. ``new`` is a set of
    records about to be saved, compared with a bounded list each.
    """
    w = Window.partitionBy("project_id", "kind").orderBy(F.desc("updated_at"), "id")
    terms = lambda df: df.withColumn("t", F.transform(X.rerank_terms(F.concat_ws(" ", "title", "body")), lambda x: F.xxhash64(x)))
    live = items.filter((F.col("status") == "active") & F.col("kind").isin(S.CONFLICT_KINDS))
    near = terms(live.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= newest)).select("project_id", "kind", F.col("id").alias("rival"), F.col("t").alias("rt"))
    rows = terms(new.filter(F.col("kind").isin(S.CONFLICT_KINDS))).select("project_id", "kind", "id", "t").join(near, ["project_id", "kind"]).filter("id <> rival")
    both, n, m = F.size(F.array_intersect("t", "rt")).cast("double"), F.size("t"), F.size("rt")
    whole = F.sqrt(m) * F.sqrt(both + (n - both) * F.pow(1 + F.ln(F.lit(2.0)), F.lit(2)))
    cosine = F.try_divide(both, whole)  # a text without terms is like no other
    scored = rows.select("id", "rival", F.round(F.coalesce(cosine, F.lit(0.0)), 6).alias("overlap")).filter(F.col("overlap") > least)
    best = scored.groupBy("id").agg(F.max(F.struct("overlap", (-F.col("rival")).alias("r"))).alias("b"))
    return best.select("id", (-F.col("b.r")).alias("rival"), F.col("b.overlap").alias("overlap"))


def best_conflict(by_title: DataFrame, by_body: DataFrame, sure: float = 0.85, margin: float = 0.1) -> DataFrame:
    """(id, rival, type, overlap): a title's conflict, or the body's where the title's isn't sure and weaker by the margin."""
    t = by_title.select("id", F.col("rival").alias("tr"), F.col("overlap").alias("to"))
    both = t.join(by_body.select("id", F.col("rival").alias("br"), F.col("overlap").alias("bo")), "id", "full_outer")
    body = F.col("to").isNull() | ((F.col("to") < sure) & (F.col("bo") > F.col("to") + margin))
    body = F.coalesce(body & F.col("bo").isNotNull(), F.lit(False))
    return both.select(
        "id", F.when(body, F.col("br")).otherwise(F.col("tr")).alias("rival"), F.when(body, "body_similar").otherwise("title_overlap").alias("type"), F.when(body, F.col("bo")).otherwise(F.col("to")).alias("overlap")
    )


def contradictions(conflicts_: DataFrame, relations: DataFrame) -> DataFrame:
    """The contradicts edges that conflicts add to a table of relations which hasn't got them."""
    edges = conflicts_.select(F.col("id").alias("from_id"), F.col("rival").alias("to_id"), F.lit("contradicts").alias("relation")).distinct()
    return edges.join(relations, ["from_id", "to_id", "relation"], "left_anti")


def resolution(overlap: Column) -> Column:
    """What is done about a conflict; null is none."""
    return F.when(overlap.isNull(), "add").when(overlap >= 1.0, "suppress").when(overlap >= 0.85, "merge").when(overlap >= 0.7, "invalidate").otherwise("relate")


def _without_one(x: Column) -> Column:
    """The strings that are left of one when a character goes."""
    return F.transform(F.sequence(F.lit(1), F.char_length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.char_length(x))))


def _grams(c: Column, size: int) -> Column:
    """The strings of ``size`` characters of a column, in order; none of a shorter one."""
    at = F.sequence(F.lit(1), F.greatest(F.char_length(c) - size + 1, F.lit(1)))
    return F.when(F.char_length(c) >= size, F.transform(at, lambda i: F.substring(c, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def containing_names(names: DataFrame) -> DataFrame:
    """(low, olow) of the distinct values of ``low`` that lie in another one.

    Whatever holds a name holds its rarest trigram: a name is filed under that one only, and looks among all trigrams of the
    others. Names of one or two characters are looked up among the parts of others.
    """
    n = names.select("low").distinct()
    every = n.select("low", F.explode(F.array_distinct(_grams(F.col("low"), 3))).alias("gram"))
    rare = every.join(every.groupBy("gram").agg(F.count("*").alias("df")), "gram").groupBy("low").agg(F.min(F.struct("df", "gram")).alias("r"))
    long = rare.select("low", F.col("r.gram").alias("gram")).join(every.withColumnRenamed("low", "olow"), "gram").select("low", "olow")
    short = n.filter(F.char_length("low") < 3)
    parts = n.select(F.col("low").alias("olow"), F.explode(F.array_distinct(F.concat(F.array(F.lit("")), _grams(F.col("low"), 1), _grams(F.col("low"), 2)))).alias("low"))
    found = long.filter(F.col("olow").contains(F.col("low"))).unionByName(parts.join(short, "low").select("low", "olow"))
    return found.filter("low <> olow")


def near_names(names: DataFrame, most: int = 3) -> DataFrame:
    """Candidates (low, olow) among the distinct values of ``low``: every two values within ``most`` edits are among them.

    A value is cut into ``most + 2`` even segments (the partition scheme of Pass-Join, Li et al., 2011, with one more segment). In a
    longer or as long value within ``most`` edits at least two of them are untouched. What was put in before, between and after
    these two adds up to ``most`` at most, so there are few places where they can stand. Values meet on two whole segments under
    their length and numbers, which are long where values are. Values too short to be cut meet on the strings that are left
    when each loses so many characters.
    """
    n, cuts = names.select("low").distinct(), most + 2
    held = n.filter(F.char_length("low") >= cuts).withColumn("l", F.char_length("low"))
    pairs = [(i, j) for i in range(cuts) for j in range(i + 1, cuts)]
    moves = [(d, a, b) for d in range(most + 1) for a in range(-most, most + 1) for b in range(-most, most + 1) if abs(a) + abs(b - a) + abs(d - b) <= most]
    listed = lambda rows, names: F.array(*[F.struct(*[F.lit(x).alias(y) for x, y in zip(r, names, strict=True)]) for r in rows])

    def segment(length: Column, i: Column) -> tuple[Column, Column]:
        base, longer = F.floor(length / cuts).cast("int"), cuts - length % cuts
        return (i * base + F.greatest(F.lit(0), i - longer)).cast("int"), (base + F.when(i >= longer, 1).otherwise(0)).cast("int")

    def key(length: Column, i: Column, j: Column, a: Column, b: Column) -> Column:
        """The two segments of a value of this length where they stand in ``low``, moved by a and b; null if they don't fit there."""
        (at, size), (further, width) = segment(length, i), segment(length, j)
        fits = (length >= cuts) & (at + a >= 0) & (further + b >= at + a + size) & (further + b + width <= F.col("l"))
        return F.when(fits, F.xxhash64(length, i, j, F.substring(F.col("low"), at + a + 1, size), F.substring(F.col("low"), further + b + 1, width)))

    here = F.transform(listed(pairs, "ij"), lambda p: key(F.col("l"), p["i"], p["j"], F.lit(0), F.lit(0)))
    there = F.transform(listed([(*p, *m) for p in pairs for m in moves], "ijdab"), lambda p: key(F.col("l") - p["d"], p["i"], p["j"], p["a"], p["b"]))
    shorter = held.select("low", F.explode(F.array_distinct(here)).alias("key"))
    longer = held.select(F.col("low").alias("olow"), F.explode(F.array_distinct(F.array_compact(there))).alias("key"))
    met = shorter.join(longer, "key").filter("low <> olow").select("low", "olow")
    steps = [F.array("low")]
    for _ in range(most):
        steps.append(F.array_distinct(F.flatten(F.transform(F.filter(steps[-1], lambda x: F.char_length(x) > 0), _without_one))))
    # a value is filed under as many deletions as its own limit allows
    left = F.array_distinct(F.concat(*[F.when(_limit(F.col("low"), most) >= k, x).otherwise(F.array().cast("array<string>")) for k, x in enumerate(steps)]))
    keys = n.filter(F.char_length("low") < cuts + most).select("low", F.explode(left).alias("key"))
    short = keys.join(keys.withColumnRenamed("low", "olow"), "key").filter((F.col("low") != F.col("olow")) & (F.least(F.char_length("low"), F.char_length("olow")) < cuts))
    return met.unionByName(met.select(F.col("olow").alias("low"), F.col("low").alias("olow"))).unionByName(short.select("low", "olow")).distinct()


def _limit(c: Column, most: int) -> Column:
    return F.least(F.lit(most), F.greatest(F.floor(F.char_length(c) / 2).cast("int"), F.lit(1)))


def similar_names(names: DataFrame, most: int = 3) -> DataFrame:
    """(name, other, match, distance) among the distinct names of a column ``name``: case, substring, small edit distance.

    Candidates are values in lower case that hold one another (``containing_names``) or are near (``near_names``); names come back to
    them at the end, so many spellings of one value cost nothing before.
    """
    n = written(names.select("name").distinct().withColumn("low", F.lower(F.trim("name"))), "names")
    held = containing_names(n)
    near = near_names(n, most)
    pairs = held.unionByName(held.select(F.col("olow").alias("low"), F.col("low").alias("olow"))).unionByName(near).distinct()
    inside = (F.char_length("low") >= 3) & (F.col("olow").contains(F.col("low")) | F.col("low").contains(F.col("olow")))
    distance = F.levenshtein("low", "olow")
    match = F.when(inside, "substring").when(distance <= _limit(F.col("low"), most), "levenshtein")
    found = pairs.select("low", "olow", match.alias("match"), F.when(match == "levenshtein", distance).otherwise(0).alias("distance")).filter("match IS NOT NULL")
    same = n.select("low").distinct().select("low", F.col("low").alias("olow"), F.lit("case").alias("match"), F.lit(0).alias("distance"))
    both = found.unionByName(same).join(n, "low").join(n.select(F.col("name").alias("other"), F.col("low").alias("olow")), "olow")
    return both.filter("name <> other").select("name", "other", "match", "distance")


def project_groups(names: DataFrame) -> DataFrame:
    """(name, lead): projects that belong together. In order of name, each that isn't in a group yet leads one, of those after it
    that hold it, that it holds or that begin with the same four characters.

    Which name leads depends on all before it, so this is a fold over the sorted names, run once for the names that meet at all:
    distinct names of projects, a few a thousand records, of which one holds the other or that share their beginning.
    """
    n = written(names.select("name").distinct().withColumn("low", F.lower("name")), "names")
    held = containing_names(n).unionByName(n.select("low").distinct().select("low", F.col("low").alias("olow")))
    other = n.select(F.col("name").alias("other"), F.col("low").alias("olow"))
    met = held.join(n, "low").join(other, "olow").select(F.least("name", "other").alias("name"), F.greatest("name", "other").alias("other"))
    begin = lambda c: F.when(F.char_length(c) >= 4, F.substring(c, 1, 4))
    alike = n.select("name", begin("low").alias("head")).join(other.select("other", begin("olow").alias("head")), "head").select("name", "other")
    met = met.unionByName(alike).filter("name < other")
    links = written(met.distinct(), "names")
    # a name leads if no leader before it takes it; rounds settle names whose earlier neighbours are all settled
    open_ = links.select(F.col("other").alias("name")).union(links.select("name")).distinct().withColumn("lead", F.lit(None).cast("string"))
    while True:
        known = links.join(open_.select("name", F.col("lead").alias("of")), "name").groupBy("other").agg(
            F.min(F.when(F.col("of") == F.col("name"), F.col("name"))).alias("taker"), F.min(F.when(F.col("of").isNull(), F.col("name"))).alias("waits")
        ).withColumnRenamed("other", "name")
        nxt = open_.join(known, "name", "left").select(
            "name",
            F.coalesce(
                "lead",
                F.when(F.col("taker").isNotNull() & (F.col("waits").isNull() | (F.col("taker") < F.col("waits"))), F.col("taker")).when(F.col("taker").isNull() & F.col("waits").isNull(), F.col("name")),
            ).alias("lead"),
        )
        open_ = written(nxt, "names")
        if open_.filter("lead IS NULL").isEmpty():
            break
    led = open_.filter("lead <> name")
    return led.unionByName(led.select(F.col("lead").alias("name"), "lead").distinct())


def containment(expected: Column, text: Column) -> Column:
    """Share of the expected tokens that a text contains."""
    low = F.lower(text)
    return F.coalesce(F.try_divide(F.size(F.filter(expected, lambda t: low.contains(t))).cast("double"), F.size(expected).cast("double")), F.lit(0.0))
