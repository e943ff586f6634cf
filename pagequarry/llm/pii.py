"""Personal data: four fixed patterns, and more identifiers found by bootstrapped contexts.

The fixed patterns (email, ip, card, phone), and keys of 32 or more hexadecimal digits (kind
``secret``), give the seed entities.  A token with a digit or an @ is an instance, one that overlaps
a seed is believed.  What surrounds a token are its lexical patterns: the word before, the two words
before, the word after, and, if a neighbour has a digit or an @ itself, its shape (letters and digits
as classes, runs as one).  The graph of patterns and instances is scored in rounds.  A pattern's
share is the part of all its occurrences in the corpus, before or after whatever words, that have a
believed instance; with F different believed instances its score is share * log2(F).  Patterns with
``min_share``, ``min_score`` and ``min_different`` are accepted, all their instances are believed from
then on, and the rounds go on until no new instance is found, which ends since beliefs only grow.
The accepted patterns discover the tokens that the fixed patterns miss; such a span has the kind most
of its best pattern's believed occurrences have.

The number of a pattern's occurrences is the corpus's count of its word, for two words that of the
rarer one, which is never too small; for a shape it is the count of tokens of that shape.

Only DataFrame operations are used.  Matches are marked in the text by one ``regexp_replace`` a
kind and the pieces between marks give the positions, so a text is searched in linear time, and
once in all.  Only rows of matches, and counts of words, are shuffled, never texts.  The patterns are
written with possessive repeats and start only where a match of the plain pattern could, which gives
the same leftmost matches without backtracking.

Defined cases: null counts as empty; texts without a match have counts of 0, an empty span string
and the digest of the empty string; rows that repeat a doc_id, or have none, are kept apart; repeated
rows count as often as they are there; ties between kinds go to the first in the order email, ip,
card, phone, secret, and between patterns to the lesser; a very long text is searched whole; an empty
table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Stored, store, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Kinds of seeds; the last is not one of the fixed patterns.
SEEDS = (*KINDS, "secret")
#: Each kind's pattern; \G allows a start right after the match before.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])(?=[0-9]*+[a-f])[0-9a-f]{32,}+(?![A-Za-z0-9])",
}
#: A quick test that a text can hold a match at all.
NEEDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
    "secret": lambda t: t.rlike(r"[0-9a-f]{32}"),
}
#: Tokens that may be identifiers.
CANDIDATE = r"(?<![^\s])[^\s@0-9]*+[@0-9][^\s]*+"
_OPEN, _CLOSE = "\x01", "\x02"


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut before each match; all but the first piece are the match, a closing mark, and what follows."""
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(_OPEN + "$0" + _CLOSE)), _OPEN)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digit string passes the Luhn test."""
    n = F.length(digits)
    numbers = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(i.alias("i"), F.substring(digits, i, F.lit(1)).cast("int").alias("d")))
    total = F.aggregate(
        numbers,
        F.lit(0),
        lambda acc, x: acc + F.when((n - x["i"]) % 2 == 0, x["d"]).otherwise(F.when(x["d"] > 4, x["d"] * 2 - 9).otherwise(x["d"] * 2)),
    )
    return total % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    """Whether a match passes its kind's further test."""
    digits = _digits(value)
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return (
        F.when(kind == "ip", F.forall(parts, lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255)))
        .when(kind == "card", F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False)))
        .when(kind == "phone", F.length(digits).between(10, 15))
        .otherwise(F.lit(True))
    )


def _plain(text: Column) -> Column:
    """In lower case, with single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), SPACE, " "))


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each valid match and each candidate token, and one of kind null for each text.

    rid, doc_id, kind, start, end, value, and for tokens left2, left1 and right1, the words around.
    """
    clean = F.translate(text_or_empty(text_col), _OPEN + _CLOSE, "\x03\x03")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), clean.alias("t"))
    text, none = F.col("t"), F.array().cast("array<string>")
    found = [F.when(NEEDS[k](text), _pieces(text, PATTERNS[k])).otherwise(none) for k in SEEDS]
    found.append(F.when(text.rlike("[0-9@]"), _pieces(text, CANDIDATE)).otherwise(none))
    cut = rows.select(
        "rid", "doc_id", F.explode(F.concat(F.array(F.struct(F.lit(None).cast("string").alias("kind"), none.alias("pieces"))), F.array(*(F.struct(F.lit(k).alias("kind"), p.alias("pieces")) for k, p in zip((*SEEDS, "token"), found))))).alias("x")
    ).where("x.kind is null or size(x.pieces) > 1")
    value = F.when(F.col("k") > 0, F.substring_index("piece", _CLOSE, 1))
    # What follows a match, up to the next one: its last two words stand before that, its first one after this.
    rest = F.when(F.col("kind") == "token", _plain(F.substring_index("piece", _CLOSE, -1)))
    pieces = (
        cut.select("rid", "doc_id", "x.kind", F.posexplode_outer("x.pieces").alias("k", "piece"))
        .select("rid", "doc_id", "kind", "k", value.alias("value"), (F.length("piece") - F.when(F.col("k") > 0, 1).otherwise(0)).alias("n"), rest.alias("rest"))
        .select("rid", "doc_id", "kind", "k", "value", "n", F.substring_index("rest", " ", -2).alias("last"), F.nullif(F.substring_index("rest", " ", 1), F.lit("")).alias("first"))
    )
    order = Window.partitionBy("rid", "kind").orderBy("k")
    text_before = F.concat_ws(" ", *(c for k in (2, 1) for c in (F.lower(F.lag("value", k).over(order)), F.lag("last", k).over(order))))
    placed = pieces.select(
        "rid", "doc_id", "kind", "value", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.split(F.trim(text_before), " +").alias("before"), F.coalesce("first", F.lower(F.lead("value").over(order))).alias("right1")
    ).where("kind is null or value is not null")
    word = lambda k: F.when(F.col("kind") == "token", F.nullif(F.try_element_at("before", F.lit(k)), F.lit("")))
    good = F.col("kind").isNull() | F.col("kind").isin("token", "secret") | _valid(F.col("kind"), F.col("value"))
    return placed.select("rid", "doc_id", "kind", "start", (F.col("start") + F.length("value")).alias("end"), "value", word(-2).alias("left2"), word(-1).alias("left1"), F.when(F.col("kind") == "token", F.col("right1")).alias("right1")).where(good)


def _kind_order(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEEDS)), kind)


def _most(*columns: str) -> Column:
    """The first kind whose column is the greatest."""
    most = F.greatest(*columns)
    return F.coalesce(*(F.when(F.col(c) == most, F.lit(c)) for c in columns))


def shape(word: Column) -> Column:
    """Letters and digits as classes, runs of one class as one."""
    classes = word
    for p, c in ((r"\p{Lu}", "A"), (r"\p{Ll}", "a"), ("[0-9]", "9")):
        classes = F.regexp_replace(classes, p, c)
    return F.regexp_replace(classes, r"([Aa9])\1+", "$1+")


def _patterns() -> Column:
    """The patterns around a token, each with the keys by which its occurrences are counted."""
    item = lambda name, a, b=None: F.struct(F.concat_ws(" ", F.lit(name), a, *([] if b is None else [b])).alias("pattern"), a.alias("a"), (a if b is None else b).alias("b"))
    word, two, one, after = (lambda c: F.concat(F.lit("w "), c)), F.col("left2"), F.col("left1"), F.col("right1")
    like = lambda c: F.concat(F.lit("s "), shape(c))
    odd = lambda c: c.rlike("[0-9@]")
    return F.array_compact(
        F.array(
            F.when(two.isNotNull() & one.isNotNull(), item("<2", word(two), word(one))),
            F.when(one.isNotNull(), item("<1", word(one))),
            F.when(after.isNotNull(), item(">1", word(after))),
            F.when(odd(one), item("<shape", like(one))),
            F.when(odd(after), item(">shape", like(after))),
        )
    )


def occurrences(found: DataFrame) -> DataFrame:
    """rid, at, until, token, instance, seed (the kind of the seed it overlaps), patterns of every token.

    found: the stored rows of :func:`matches`.
    """
    base = found.where(F.col("kind").isNotNull() & (F.col("kind") != "token"))
    tokens = found.where("kind = 'token'")
    no = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    # A token belongs to a seed if they overlap: both of one text and in order, so a window finds it.
    marks = base.select("rid", F.col("start").alias("at"), F.lit(0).alias("is_token"), F.col("end").alias("until"), "kind", *no("string", "token", "left2", "left1", "right1")).unionByName(
        tokens.select("rid", F.col("start").alias("at"), F.lit(1).alias("is_token"), F.col("end").alias("until"), *no("string", "kind"), F.col("value").alias("token"), "left2", "left1", "right1")
    )
    past = Window.partitionBy("rid").orderBy("at", "is_token").rowsBetween(Window.unboundedPreceding, -1)
    # The rows that follow, taken backwards, so that the frame grows.
    ahead = Window.partitionBy("rid").orderBy(F.desc("at"), F.desc("is_token")).rowsBetween(Window.unboundedPreceding, -1)
    seed_end = F.when(F.col("is_token") == 0, F.struct("until", "kind"))
    seed_next = F.when(F.col("is_token") == 0, F.struct("at", "kind"))
    marked = marks.select("*", F.max(seed_end).over(past).alias("before"), F.min(seed_next).over(ahead).alias("after")).where("is_token = 1")
    seed = F.when(F.col("before.until") > F.col("at"), F.col("before.kind")).when(F.col("after.at") < F.col("until"), F.col("after.kind"))
    instance = F.regexp_replace(F.lower("token"), r"^[\"'(\[<]+|[\"')\]>.,;:!?#*$%&]+$", "")
    return marked.select("rid", "at", "until", "token", instance.alias("instance"), seed.alias("seed"), _patterns().alias("patterns"))


def context_counts(docs: DataFrame, occurred: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, total): how often each word and each shape of a token occurs in the corpus."""
    words = docs.select(F.explode(F.split(_plain(text_or_empty(text_col)), " ")).alias("word")).groupBy(F.concat(F.lit("w "), "word").alias("key"))
    shapes = occurred.groupBy(F.concat(F.lit("s "), shape(F.lower("token"))).alias("key"))
    total = F.count(F.lit(1)).alias("total")
    return words.agg(total).unionByName(shapes.agg(total))


def accepted(occurred: DataFrame, counts: DataFrame, min_different: int = 3, min_share: float = 0.3, min_score: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The patterns accepted in the end: (pattern, share, score, kind), and the instances then believed: (instance, kind).

    occurred: the stored rows of :func:`occurrences`; counts: (key, total).
    """
    each = occurred.where("instance <> ''").select("instance", "seed", F.explode("patterns").alias("p")).select("instance", "seed", "p.*")
    edges = each.groupBy("pattern", "a", "b", "instance").agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(F.col("seed") == k, 1)).alias(k) for k in SEEDS))
    edges = Stored(edges, "edges")
    # Fewer instances than must be believed can never be enough.
    wide = Stored(edges.df.groupBy("pattern", "a", "b").agg(F.count(F.lit(1)).alias("different")).where(F.col("different") >= min_different), "wide")
    keys = wide.df.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    # Not a semi join, which would be moved under the counting, so that every word would be shuffled.
    totals = Stored(counts.join(keys.hint("merge"), "key"), "totals")
    sized = (
        wide.df.join(totals.df.select(F.col("key").alias("a"), F.col("total").alias("total_a")), "a")
        .join(totals.reread().select(F.col("key").alias("b"), F.col("total").alias("total_b")), "b")
        .select("pattern", F.least("total_a", "total_b").alias("total"))
    )
    graph = Stored(edges.reread().select("pattern", "instance", "n", *SEEDS).join(sized.hint("merge"), "pattern"), "graph")
    seeded = edges.df.groupBy("instance").agg(*(F.sum(k).alias(k) for k in SEEDS)).where(" + ".join(SEEDS) + " > 0").select("instance", _most(*SEEDS).alias("kind"))
    believed = Stored(seeded, "believed")
    size = -1
    while True:
        of_kind = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in SEEDS]
        scored = graph.df.join(believed.df.hint("merge"), "instance").groupBy("pattern").agg(F.first("total").alias("total"), F.sum("n").alias("hits"), F.count(F.lit(1)).alias("different"), *of_kind)
        share = F.least(F.col("hits") / F.col("total"), F.lit(1.0))
        scored = scored.select("pattern", "different", share.alias("share"), F.round(share * F.log2("different"), 12).alias("score"), _most(*SEEDS).alias("kind"))
        good = Stored(scored.where((F.col("different") >= min_different) & (F.col("share") >= min_share) & (F.col("score") >= min_score)), "patterns")
        best = F.max_by("kind", F.struct("score", F.col("pattern").alias("p"))).alias("kind")
        new = graph.df.join(good.df.hint("merge"), "pattern").groupBy("instance").agg(best).join(believed.df.select("instance"), "instance", "left_anti")
        grown = Stored(believed.reread().unionByName(new), "believed")
        before, size = size, grown.df.count()
        believed.drop()
        believed = grown
        if size == before:
            for table in (edges, wide, totals, graph):
                table.drop()
            return good.df, believed.df
        good.drop()


def discovered(occurred: DataFrame, good: DataFrame) -> DataFrame:
    """Spans (rid, kind, start, end) of the tokens that no seed overlaps and an accepted pattern has."""
    open_ones = occurred.where("seed is null and instance <> ''")
    lead = F.length(F.regexp_extract("token", r"^[\"'(\[<]*", 0))
    placed = open_ones.select("rid", (F.col("at") + lead).alias("start"), (F.col("at") + lead + F.length("instance")).alias("end"), F.explode("patterns.pattern").alias("pattern"))
    return placed.join(good.hint("merge"), "pattern").groupBy("rid", "start", "end").agg(F.max_by("kind", F.struct("score", "pattern")).alias("kind"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_discovered, n_spans."""
    found = store(matches(docs, id_col, text_col), "matches")
    occurred = store(occurrences(found), "occurrences")
    good, _ = accepted(occurred, context_counts(docs, occurred, text_col), **options)
    more = discovered(occurred, good).select("rid", F.lit(None).cast("long").alias("doc_id"), "kind", "start", "end", F.lit("more").alias("by"))
    fixed = F.when(F.col("kind") == "secret", "seed").otherwise("base")
    spans = found.where(F.col("kind").isNull() | (F.col("kind") != "token")).select("rid", "doc_id", "kind", "start", "end", fixed.alias("by"))
    item = F.struct("start", _kind_order(F.col("kind")).alias("place"), "end", "kind", "by")
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    gathered = spans.unionByName(more).groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), *(F.count(F.when((F.col("kind") == k) & (F.col("by") != "more"), 1)).alias(f"n_{k}") for k in SEEDS), F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), item))).alias("all")
    )
    base = joined(F.filter("all", lambda s: s["by"] == "base"))
    return gathered.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(base, 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), "n_secret", F.size(F.filter("all", lambda s: s["by"] == "more")).cast("long").alias("n_discovered"), F.size("all").cast("long").alias("n_spans"))
