"""Citations, extractive answers, prompts, and the sequence of result events."""

from __future__ import annotations

import importlib.util
import json
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

PROMPT = "Answer from the excerpts below only, with their units, and say so if they do not hold the answer."
NO_ANSWER = "No generated answer is available; these passages match best."


def citations(ranked: DataFrame) -> DataFrame:
    """query_id, sources: the ranked chunks as an ordered list of structs."""
    item = F.struct("rank", "chunk_id", "doc_id", "page_number", "section_title", "entity", "fiscal_year", "basis", "retrieval_source", X.relevance(F.col("rerank_score")).alias("relevance"), X.excerpt(F.col("text")).alias("excerpt"), X.is_table(F.col("text")).alias("is_table"))
    return ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("sources"))


def resolve_markers(answers: DataFrame, ranked: DataFrame) -> DataFrame:
    """A row for each [Page N] of an answer: query_id, place, page_number, doc_id, chunk_id (null if no source has the page).

    A page of several documents is that of the best ranked one.
    """
    each = answers.select("query_id", F.posexplode(F.regexp_extract_all("answer", F.lit(r"(?i)\[Page\s+(\d+)\]"), F.lit(1))).alias("place", "n")).withColumn("page_number", F.col("n").cast("int")).drop("n")
    order = Window.partitionBy("query_id", "page_number").orderBy("rank")
    first = ranked.withColumn("__r", F.row_number().over(order)).where("__r = 1").select("query_id", "page_number", "doc_id", "chunk_id")
    return each.join(first, ["query_id", "page_number"], "left")


def _blocks(ranked: DataFrame, body) -> DataFrame:
    label = X.source_label(F.col("rank"), F.col("entity"), F.col("fiscal_year"), F.col("basis"), F.col("page_number"), F.col("section_title"))
    return ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(label, F.lit("\n"), body).alias("b")))), lambda x: x["b"]).alias("blocks"))


def extractive_answers(ranked: DataFrame) -> DataFrame:
    """query_id, answer: the best passages as they are."""
    return _blocks(ranked, X.excerpt(F.col("text"), dots=True)).select("query_id", F.concat(F.lit(NO_ANSWER + "\n\n"), F.array_join("blocks", "\n\n")).alias("answer"))


def prompts(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """query_id, prompt: labels and whole texts, then the question."""
    blocks = _blocks(ranked, F.col("text"))
    return queries.join(blocks, "query_id").select("query_id", F.concat(F.lit(PROMPT + "\n\n"), F.array_join("blocks", "\n\n---\n\n"), F.lit("\n\nQuestion: "), "question").alias("prompt"))


def generator_available(module: str, key: str | None) -> tuple[bool, str | None]:
    """Whether a generator could be asked, and why not; nothing is sent or imported."""
    if not (key or "").strip():
        return False, "no key is set"
    try:
        there = importlib.util.find_spec(module) is not None
    except (ImportError, ValueError):  # a parent package is missing, or the name is none
        there = False
    return (True, None) if there else (False, f"{module} is not installed")


class Unavailable(RuntimeError):
    """A generator that cannot be asked at all: asking again does not help."""


@dataclass(frozen=True)
class Provider:
    """A generator by name: what answers a prompt at once, and what answers it in fragments."""

    name: str
    key: str | None
    generate: Callable[[str], str]
    stream: Callable[[str], Iterable[str]]


def chosen_provider(providers: Sequence[Provider], setting: str | None = None) -> Provider | None:
    """The provider that is set by name, or the first with a key; none if the setting is "none" or no key is set.

    A name that is not known, or whose key is missing, is an error rather than a silent change of provider.
    """
    wanted = (setting or "").strip().lower()
    if wanted == "none":
        return None
    if not wanted:
        return next((p for p in providers if (p.key or "").strip()), None)
    named = {p.name: p for p in providers}.get(wanted)
    if named is None:
        raise ValueError(f"{wanted!r} is none of {', '.join(p.name for p in providers)} or none")
    if not (named.key or "").strip():
        raise ValueError(f"no key is set for {wanted}")
    return named


#: What the text of a failure that may pass has, and what that of an exhausted daily quota has.
TRANSIENT = ("429", "500", "502", "503", "504", "resource_exhausted", "unavailable", "deadline_exceeded", "internal error")
DAILY = ("perday", "requests per day", "free_tier_requests", "quota exceeded for metric")
#: Tries in all, and seconds before the second one, doubled before each further one.
TRIES, WAIT = 3, 1.0


def may_pass(error: Exception) -> bool:
    """Whether another try could succeed: faults of the setup and a spent day's quota stay."""
    said = str(error).lower()
    closed_up = "".join(said.split())
    spent = "429" in said and any("".join(x.split()) in closed_up for x in DAILY)
    return not isinstance(error, Unavailable) and not spent and any(x in said for x in TRANSIENT)


def answer(prompt: str, fallback: str, generate: Callable[[str], str] | None = None, tries: int = TRIES, sleep: Callable[[float], None] = time.sleep) -> tuple[str, str]:
    """(text, source): generated, or extractive if there is no generator, it fails for good, or it says nothing."""
    for n in range(tries if generate else 0):
        try:
            text = generate(prompt)
            return (text, "generated") if text and text.strip() else (fallback, "extractive")
        except Exception as e:  # any failure of a generator falls back
            if n + 1 == tries or not may_pass(e):
                break
            sleep(WAIT * 2**n)
    return fallback, "extractive"


def stream_answer(prompt: str, fallback: str, stream: Callable[[str], Iterable[str]] | None = None, tries: int = TRIES, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple]:
    """("delta", fragment) for each fragment, then one ("done", text, source), whatever fails.

    A stream is opened again only before its first fragment, and only for failures that may pass.  What was said
    before a later failure stays and counts as generated; a stream that says nothing ends in the fallback.
    """
    for n in range(tries if stream else 0):
        said = []
        try:
            for part in stream(prompt):
                if part:
                    said.append(part)
                    yield "delta", part
            again = False
        except Exception as e:
            again = not said and n + 1 < tries and may_pass(e)
        if said:
            yield "done", "".join(said), "generated"
            return
        if not again:
            break
        sleep(WAIT * 2**n)
    yield "done", fallback, "extractive"


def events(result: dict, parts: Iterable[tuple] = ()) -> Iterator[str]:
    """Frames of one finished query as text: meta, then abstained, or the deltas and done of :func:`stream_answer`; error if what makes them fails.

    One of the last three ends it, and none of them comes twice.
    """
    frame = lambda kind, data: f"event: {kind}\ndata: {json.dumps(data, ensure_ascii=False)}\n\n"
    yield frame("meta", {k: result.get(k) for k in ("query_id", "level", "reason", "sources")})
    if result.get("abstained"):
        yield frame("abstained", {"reason": result.get("abstention_reason")})
        return
    source = result.get("answer_source", "extractive")
    try:
        for kind, *payload in parts:
            if kind == "done":
                source = payload[1]
                break
            yield frame("delta", {"text": payload[0]})
    except Exception as e:
        yield frame("error", {"message": str(e)})
        return
    yield frame("done", {"answer_source": source})


def result_frames(results: DataFrame, sources: DataFrame, answers: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """The frames of finished queries as rows: query_id, seq, event, data (JSON).

    results: query_id, level, reason, abstained, abstention_reason; sources: query_id, sources (an ordered list);
    answers: query_id, answer; errors: query_id, message, for queries that failed.  A query has one meta frame, then,
    unless it abstains or failed, a delta for each paragraph of its answer, and one frame that ends it:
    abstained, error or done.  A query without sources has an empty list, one without an answer is done at once.
    """
    failed = errors if errors is not None else results.select("query_id", F.lit(None).cast("string").alias("message")).where("false")
    rows = results.join(sources, "query_id", "left").join(answers, "query_id", "left").join(failed.select("query_id", "message"), "query_id", "left")
    frame = lambda event, **data: F.struct(F.lit(event).alias("event"), F.to_json(F.struct(*(c.alias(n) for n, c in data.items())), {"ignoreNullFields": "false"}).alias("data"))
    stopped, broken = F.coalesce("abstained", F.lit(False)), F.col("message").isNotNull()
    listed = F.coalesce("sources", F.array().cast(sources.schema["sources"].dataType))
    parts = F.when(stopped | broken | F.col("answer").isNull(), F.array().cast("array<string>")).otherwise(F.split("answer", "\n\n"))
    deltas = F.transform(parts, lambda p: frame("delta", text=p))
    last = F.when(broken, frame("error", message=F.col("message"))).when(stopped, frame("abstained", reason=F.col("abstention_reason"))).otherwise(frame("done", answer_source=F.lit("extractive")))
    meta = frame("meta", query_id=F.col("query_id"), level=F.col("level"), reason=F.col("reason"), sources=listed)
    each = rows.select("query_id", F.posexplode(F.concat(F.array(meta), deltas, F.array(last))).alias("seq", "f"))
    return each.select("query_id", "seq", "f.event", "f.data")


def broken_frames(frames: DataFrame) -> DataFrame:
    """(query_id, fault): queries whose frames break a rule: numbers without gaps, meta first and once, one ending frame and that last, deltas only before done."""
    ends = F.col("event").isin("done", "abstained", "error")
    of = frames.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("seq").alias("numbers"), F.min("seq").alias("low"), F.max("seq").alias("high"), F.count_if(F.col("event") == "meta").alias("metas"),
        F.min(F.when(F.col("event") == "meta", F.col("seq"))).alias("meta"), F.count_if(ends).alias("ends"), F.max(F.when(ends, F.col("seq"))).alias("end"),
        F.count_if(F.col("event") == "delta").alias("deltas"), F.count_if(F.col("event") == "done").alias("dones"), F.count_if(~ends & ~F.col("event").isin("meta", "delta")).alias("unknown"),
    )
    fault = (
        F.when((F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | (F.col("numbers") != F.col("n")), "numbers")
        .when((F.col("metas") != 1) | (F.col("meta") != 0), "meta")
        .when((F.col("ends") != 1) | (F.col("end") != F.col("high")), "end")
        .when((F.col("deltas") > 0) & (F.col("dones") == 0), "delta")
        .when(F.col("unknown") > 0, "event")
    )
    return of.select("query_id", fault.alias("fault")).where("fault is not null")
