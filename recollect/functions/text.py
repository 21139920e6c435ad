"""Text functions as column expressions: everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect import schema as S

_EDGES = r"""["'.,;:!?()\[\]{}<>]+"""


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c: str | Column) -> Column:
    """Words of letters and digits, lower-cased, with repeats."""
    return F.filter(F.split(F.lower(_col(c)), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def token_count(c: str | Column) -> Column:
    """How many ``tokens`` a text has, without making them."""
    return F.regexp_count(F.lower(_col(c)), F.lit(r"[\p{L}\p{N}]+"))


def fields(c: str | Column) -> Column:
    """What white space separates, lower-cased, without marks at its ends."""
    parts = F.split(F.lower(_col(c)), r"\s+")
    return F.transform(parts, lambda x: F.regexp_replace(F.regexp_replace(x, "^" + _EDGES, ""), _EDGES + "$", ""))


def _long_enough(x: Column, least: int) -> Column:
    return F.octet_length(x) >= least


def query_terms(c: str | Column) -> Column:
    """Distinct terms of a query that must all match: at least three bytes and no stopword; if none is left, all."""
    kept = F.array_distinct(F.filter(fields(c), lambda x: _long_enough(x, 3) & ~x.isin(S.STOPWORDS)))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array_distinct(F.filter(fields(c), lambda x: x != "")))


def fallback_terms(c: str | Column) -> Column:
    """Terms of which any may match: those of ``query_terms`` with a guess at their singular."""

    def forms(x: Column) -> Column:
        n = F.octet_length(x)
        singular = (
            F.when(x.endswith("ies") & (n > 4), F.concat(F.substring(x, F.lit(1), F.length(x) - 3), F.lit("y")))
            .when(x.endswith("es") & (n > 4), F.substring(x, F.lit(1), F.length(x) - 2))
            .when(x.endswith("s") & (n > 3), F.substring(x, F.lit(1), F.length(x) - 1))
        )
        return F.filter(F.array(x, singular), lambda y: y.isNotNull() & _long_enough(y, 3))

    kept = F.filter(fields(c), lambda x: _long_enough(x, 3) & ~x.isin(S.STOPWORDS))
    return F.array_distinct(F.flatten(F.transform(kept, forms)))


def plain_terms(c: str | Column) -> Column:
    """Distinct terms of at least three bytes that are no stopwords."""
    return F.array_distinct(F.filter(fields(c), lambda x: _long_enough(x, 3) & ~x.isin(S.STOPWORDS)))


def rerank_terms(c: str | Column) -> Column:
    return F.array_distinct(F.filter(fields(c), lambda x: _long_enough(x, 2)))


def significant_words(c: str | Column) -> Column:
    """Words of a title of at least three bytes that aren't common ones."""
    return F.filter(F.split(F.lower(_col(c)), r"[ \-_/():,]+"), lambda x: _long_enough(x, 3) & ~x.isin(S.TITLE_STOPWORDS))


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(common.cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def redact(c: str | Column) -> Column:
    """Secrets become [SECRET]; several in a row become one. Texts without any mark of a secret are passed over."""
    out = _col(c)
    for pattern in S.SECRET_PATTERNS:
        out = F.regexp_replace(out, pattern, "[SECRET]")
    found = F.lower(_col(c)).rlike(S.SECRET_MARKS)
    return F.when(found, F.regexp_replace(out, r"(\[SECRET\])+", "[SECRET]")).otherwise(_col(c))


def strip_private(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"(?is)<private>.*?</private>", "[REDACTED]"))


def word_count(c: str | Column) -> Column:
    return F.size(F.filter(F.split(_col(c), r"\s+"), lambda x: x != ""))


def token_estimate(c: str | Column, factor: float = 1.35, least: int = 1) -> Column:
    """Tokens without a vocabulary: words times a factor, rounded; at least ``least`` for a text that isn't empty."""
    n = F.floor(word_count(c) * F.lit(factor) + 0.5).cast("int")
    return F.when(F.coalesce(_col(c), F.lit("")) == "", F.lit(0)).otherwise(F.greatest(n, F.lit(least)))


def clip(c: str | Column, limit: int, mark: str = "...") -> Column:
    c = _col(c)
    return F.when(F.char_length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(c)


def clip_to_tokens(c: str | Column, limit: Column | int, mark: str = "... [truncated]") -> Column:
    """The longest run of leading words within limit - 5 tokens, and a mark that the rest is gone."""
    c = _col(c)
    limit = F.lit(limit) if isinstance(limit, int) else limit
    keep = F.floor((limit - 5) / 1.35).cast("int")
    words = F.filter(F.split(c, r"\s+"), lambda x: x != "")
    return F.when(token_estimate(c) <= limit, c).otherwise(F.concat(F.array_join(F.slice(words, 1, F.greatest(keep, F.lit(0))), " "), F.lit(mark)))


def entities(c: str | Column) -> Column:
    """Identifiers, dates and hosts in a text, lower-cased, each once."""
    c = F.regexp_replace(_col(c), "\u0000", " ")
    token, _, date, host = S.ENTITY_PATTERNS  # a name in camel case is an identifier too
    every = F.concat(
        F.regexp_extract_all(c, F.lit(token), F.lit(0)), F.transform(F.regexp_extract_all(c, F.lit(date), F.lit(0)), lambda x: F.concat(F.lit("date-"), x)),
        F.regexp_extract_all(c, F.lit(host), F.lit(1)),
    )
    return F.array_distinct(F.transform(F.filter(every, lambda x: F.char_length(x) >= 3), lambda x: F.lower(x)))


def entity_type(name: str | Column) -> Column:
    n = _col(name)
    return F.when(n.contains("/"), "path").when(F.lower(n).contains("api") | F.lower(n).contains("http"), "component").otherwise("token")


def topic_segment(c: str | Column) -> Column:
    return F.substring(F.array_join(F.filter(F.split(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", " "), " "), lambda x: x != ""), "-"), 1, 100)


def topic_family(kind: str | Column, title: str | Column, body: str | Column) -> Column:
    t = F.lower(F.trim(_col(kind)))
    out = None
    for family, names in S.TOPIC_BY_TYPE.items():
        hit = t.isin(names.split())
        out = F.when(hit, family) if out is None else out.when(hit, family)
    text = F.lower(F.concat(_col(title), F.lit(" "), _col(body)))
    for family, words in S.TOPIC_BY_WORD.items():
        out = out.when(text.rlike("|".join(words)), family)
    return out.when((t != "") & (t != "manual"), topic_segment(t)).otherwise("topic")


def topic_key(kind: str | Column, title: str | Column, body: str | Column) -> Column:
    """family/segment, the segment from the title or else from the first words of the body."""
    family = topic_family(kind, title, body)
    words = F.filter(F.split(F.lower(strip_private(body)), r"\s+"), lambda x: x != "")
    segment = topic_segment(strip_private(title))
    segment = F.when(segment != "", segment).otherwise(topic_segment(F.array_join(F.slice(words, 1, 8), " ")))
    head = F.concat(family, F.lit("-"))
    segment = F.when(segment.startswith(head), F.substring(segment, F.length(head) + 1, F.lit(100))).otherwise(segment)
    return F.concat(family, F.lit("/"), F.when((segment == "") | (segment == family), F.lit("general")).otherwise(segment))


def normal_name(c: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_col(c))), "-{2,}", "-"), "_{2,}", "_")


def normal_path(c: str | Column) -> Column:
    p = F.trim(F.regexp_replace(_col(c), r"\\", "/"))
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(p, r"^\./", ""), "^/", "")), "/$", ""))


def path_like(c: str | Column) -> Column:
    p = F.trim(_col(c))
    ends = F.lit(False)
    for e in S.PATH_ENDINGS:
        ends = ends | F.lower(p).endswith(e)
    return (p != "") & (p.contains("/") | ends)


def path_score(target: str | Column, candidate: str | Column) -> Column:
    """How well two normalised paths match, from 120 (equal) to 0."""
    a, b = _col(target), _col(candidate)
    base = lambda x: F.element_at(F.split(x, "/"), -1)
    folder = lambda x: F.when(x.contains("/"), F.regexp_replace(x, "/[^/]*$", "")).otherwise("")
    slash = F.lit("/")
    under = lambda x, y: x.startswith(F.concat(y, slash))
    a_dir, b_dir = ~base(a).contains("."), ~base(b).contains(".")
    fa, fb = folder(a), folder(b)
    both = (fa != "") & (fb != "")
    return (
        F.when((a == "") | (b == ""), 0)
        .when(a == b, 120)
        .when(a.endswith(F.concat(slash, b)) | b.endswith(F.concat(slash, a)), 100)
        .when((base(a) == base(b)) & a.contains("/") & b.contains("/"), 75)
        .when(base(a) == base(b), 55)
        .when(a_dir & under(b, a), 70)
        .when(b_dir & under(a, b), 68)
        .when(both & (fa == fb), 22)
        .when(both & ~a_dir & ~b_dir & (under(fa, fb) | under(fb, fa)), 62)
        .when(a.contains(b) | b.contains(a), 48)
        .otherwise(0)
    )


def _plain(c: Column) -> Column:
    """Without marks of bold, code and italics, words joined by single spaces."""
    for mark in (r"\*\*([^*]+)\*\*", r"`([^`]+)`", r"\*([^*]+)\*"):
        c = F.regexp_replace(c, mark, "$1")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def learnings(c: str | Column) -> Column:
    """The items (array) of the last section of learnings that has any.

    A section goes from its header to the next one of up to three marks. Its items are its numbered lines, or if none of
    these is long enough its bulleted ones, without markdown; long enough are 20 bytes and four words.
    """
    sections = F.slice(F.split(_col(c), S.LEARNING_HEADER, -1), F.lit(2), F.greatest(F.lit(0), F.size(F.split(_col(c), S.LEARNING_HEADER, -1)) - 1))

    def items(section: Column, mark: str) -> Column:
        found = F.transform(F.regexp_extract_all(section, F.lit(rf"(?md)^\s*{mark}\s+(.+)"), 1), _plain)
        return F.filter(found, lambda x: (F.octet_length(x) >= S.LEARNING_BYTES) & (F.size(F.split(x, " ")) >= S.LEARNING_WORDS))

    def of(section: Column) -> Column:
        own = F.element_at(F.split(section, r"\n#{1,3} ", 2), 1)
        numbered = items(own, r"\d+[.)]")
        return F.when(F.size(numbered) > 0, numbered).otherwise(items(own, "[-*]"))

    full = F.filter(F.transform(sections, of), lambda x: F.size(x) > 0)
    return F.coalesce(F.try_element_at(full, F.lit(-1)), F.array().cast("array<string>"))


def repo_name(c: str | Column) -> Column:
    """The last part of a repository's address, whether it is split by slashes or colons, without ``.git``."""
    parts = F.filter(F.split(F.regexp_replace(_col(c), r"\.git$", ""), "[/:]"), lambda x: x != "")
    return F.trim(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")))


def normal_remote(c: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_col(c))), r"\.git$", ""), "/+$", "")


def slug(c: str | Column) -> Column:
    """Letters a to z and digits, what is between them as one dash; unknown if none is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(_col(c))), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", "unknown").otherwise(s)


def short_hash(c: str | Column) -> Column:
    return F.substring(F.sha2(_col(c), 256), 1, 8)


def tool_class(c: str | Column) -> Column:
    """The type of observation that a tool's call is."""
    return S.lookup(_col(c), S.TOOL_CLASS, "tool_use")
