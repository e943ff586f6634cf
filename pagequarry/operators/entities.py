"""Companies that a question names, and whether they are indexed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.text import CORPORATE, listed, normal_name, without_suffix
from .scratch import keep

#: Fixed value: up to four capitalised words and a corporate suffix.
SUFFIXED = rf"(?U)\b((?:[A-Z][\w&'’\-]*\s+){{0,3}}[A-Z][\w&'’\-]*\s+(?i:{CORPORATE}))\b"
_SPANS = "array<struct<start:int,end:int,name:string>>"


def _squashed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[\s\x01\x02]+", " "))


def gazetteer(names_of: DataFrame) -> DataFrame:
    """(first, key) of lower-case names (key): the first word decides which texts a name is looked for in.  Names without a word are left out."""
    keys = names_of.select(_squashed(F.col("key")).alias("key")).distinct()
    return keys.withColumn("first", F.regexp_extract("key", r"(?U)\w+", 0)).where("first <> ''")


def known_names(spark: SparkSession) -> DataFrame:
    """The fixed tables of names as a gazetteer."""
    return gazetteer(spark.createDataFrame([(k,) for k in sorted({**names.ALIASES, **names.KNOWN})], "key string"))


def _starts(text: Column, key: Column) -> Column:
    """Every place from 0 where the key stands as whole words; the text is cut before each of them."""
    here = F.concat(F.lit(r"(?=\Q"), key, F.lit(r"\E(?!\w))"))
    pieces = F.split(text, F.concat(F.lit(r"(?U)(?<!\w)"), here))
    at_begin = F.regexp_like(text, F.concat(F.lit("(?U)^"), here))
    after = F.aggregate(
        F.slice(pieces, 1, F.size(pieces) - 1), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.concat(s["starts"], F.array(s["at"] + F.length(p))).alias("starts")), lambda s: s["starts"],
    )
    return F.when(at_begin, F.concat(F.array(F.lit(0)), after)).otherwise(after)


def known_spans(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(query_id, name, start): where texts (query_id, text; squashed) name what the gazetteer has.

    Distinct words meet the names' first words, so a name costs nothing in texts without it, however
    many names there are; texts are fetched only for the names that may be in them.
    """
    words = texts.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?U)\w+"), F.lit(0)))).alias("first"))
    maybe = keep(words.join(known, "first").select("query_id", "key"), "maybe")
    named = maybe.join(texts, "query_id").where(F.contains("text", F.col("key")))
    return named.select("query_id", F.col("key").alias("name"), F.explode(_starts(F.col("text"), F.col("key"))).alias("start"))


def suffixed_spans(texts: DataFrame) -> DataFrame:
    """(query_id, name, start, place): capitalised words before a corporate suffix, in the order of the text (query_id, question, text)."""
    maybe = texts.where(F.col("text").rlike(rf"(?U)\s(?:{CORPORATE})\b"))
    raw = maybe.select("query_id", "text", F.posexplode(F.regexp_extract_all("question", F.lit(SUFFIXED), F.lit(1))).alias("place", "raw"))
    placed = raw.withColumn("name", _squashed(F.col("raw"))).withColumn("start", F.instr("text", F.col("name")) - 1)
    return placed.where("start >= 0").select("query_id", "name", "start", "place")


def mentions(questions: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(query_id, mentions): the company names of each question that has any, longest first, each stretch of text used once.

    Known names come first, equal lengths in the alphabet's order and then in that of the text;
    after them names with a corporate suffix, in the order of the text.  query_id is unique.
    """
    known = known_names(questions.sparkSession) if known is None else known
    asked = F.coalesce(F.col("question"), F.lit(""))
    texts = questions.select("query_id", asked.alias("question"), _squashed(asked).alias("text"))
    spans = known_spans(texts.select("query_id", "text"), known).select("query_id", "name", "start", F.lit(0).alias("late"), (-F.length("name")).alias("order"))
    spans = spans.unionByName(suffixed_spans(texts).select("query_id", "name", "start", F.lit(1).alias("late"), F.col("place").alias("order")))
    end = (F.col("start") + F.length("name")).alias("end")
    ranked = spans.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("late", "order", "name", "start", end))).alias("s"))
    free = lambda taken, x: ~F.exists(taken, lambda t: (t["start"] < x["end"]) & (x["start"] < t["end"]))
    span = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["name"].alias("name"))
    taken = F.aggregate("s", F.array().cast(_SPANS), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(span(x)))).otherwise(acc))
    return ranked.select("query_id", F.transform(taken, lambda x: x["name"]).alias("mentions"))


def lookup(spark) -> tuple[DataFrame, DataFrame]:
    """(alias, canonical) and (key, display), tables of a fixed size."""
    pairs = lambda d, a, b: spark.createDataFrame(list(d.items()), f"{a} string, {b} string")
    return pairs(names.ALIASES, "alias", "canonical"), pairs(names.KNOWN, "key", "display")


def with_canonical(rows: DataFrame, name: str) -> DataFrame:
    """Adds canonical and display of a mentioned name."""
    aliases, known = lookup(rows.sparkSession)
    r = rows.withColumns({"__n": normal_name(F.col(name)), "__s": without_suffix(F.col(name))})
    # Both tables have a fixed size.
    for k, c in (("__n", "__c1"), ("__s", "__c2")):
        r = r.join(F.broadcast(aliases.select(F.col("alias").alias(k), F.col("canonical").alias(c))), k, "left")
    r = r.join(F.broadcast(known.select(F.col("key").alias("__n"), "display")), "__n", "left")
    return r.withColumn("canonical", F.coalesce("__c1", "__c2")).withColumn("display", F.coalesce("display", "canonical", F.initcap("__n"))).drop("__n", "__s", "__c1", "__c2")


def foreign_entities(questions: DataFrame, indexed: DataFrame) -> DataFrame:
    """(query_id, names): what a question names and the index (entity) does not have, in order of mention."""
    each = mentions(questions).select("query_id", F.posexplode("mentions").alias("place", "mention"))
    each = with_canonical(each, "mention")
    keys = F.array_distinct(F.array_compact(F.array(F.lower("canonical"), F.col("mention"), without_suffix(F.col("mention")))))
    have = indexed.where("entity <> ''").select(normal_name(F.col("entity")).alias("k"), F.col("entity"))
    have = with_canonical(have, "entity").select(F.explode(F.array_compact(F.array("k", F.lower("canonical")))).alias("k")).distinct()
    # One pass over the texts: each mention's keys meet the index, and a mention with any of them there is left out.
    met = each.select("query_id", "place", "display", F.explode(keys).alias("k")).join(have.withColumn("there", F.lit(True)), "k", "left")
    left = met.groupBy("query_id", "place", "display").agg(F.max("there").alias("there")).where("there is null").groupBy("query_id", "display").agg(F.min("place").alias("place"))
    return left.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "display"))), lambda x: x["display"]).alias("names"))


def described(names_col: Column) -> Column:
    return listed(names_col)
