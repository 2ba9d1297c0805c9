"""Text of time ranges, and topics."""

from __future__ import annotations

import collections
import json
import queue
import threading
import time
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelwright.functions import exprs, params


#: Words that meet the segments over them in one task, about.
CELL = 512


def overlap_text(segments: DataFrame, words: DataFrame, bucket: int, most: int = params.TRANSCRIPT_CHARS, cell: int = CELL) -> DataFrame:
    """movie_id, seg_no, n_words, text of every segment: the words that overlap it (start < its end and end > its start), in order of seq.

    segments: movie_id, seg_no, start, end; words: movie_id, seq, word, start, end. A movie's words are cut into cells of about `cell` words, by
    counts of those that begin in each bucket of time (and by hash, where one bucket holds more), so each word is in one cell, and no task holds
    more for a long or crowded movie. A segment goes to the cells whose words reach from before its end to after its start. What a cell adds to
    a segment is a count and the words of the first `most` characters, so one that is over the whole movie gathers a bounded text from each
    cell. Text is cut to `most` characters; a segment without words has an empty one.
    """
    w = words.select("movie_id", "seq", "word", F.col("start").alias("_ws"), F.col("end").alias("_we"), F.floor(F.col("start") / bucket).alias("_b"))
    counts = w.groupBy("movie_id", "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("movie_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = counts.select("movie_id", "_b", F.floor(before / cell).alias("_first"), F.ceil(F.col("_n") / cell).alias("_parts"))
    w = w.join(cuts, ["movie_id", "_b"]).select("movie_id", "seq", "word", "_ws", "_we", (F.col("_first") + F.pmod(F.xxhash64("seq"), F.col("_parts"))).alias("_c"))
    cells = w.groupBy("movie_id", "_c").agg(F.min("_ws").alias("_low"), F.max("_we").alias("_high"))
    s = segments.select("movie_id", "seg_no", F.col("start").alias("_s"), F.col("end").alias("_e")).join(cells, "movie_id").filter((F.col("_low") < F.col("_e")) & (F.col("_high") > F.col("_s")))
    met = s.join(w, ["movie_id", "_c"]).filter((F.col("_ws") < F.col("_e")) & (F.col("_we") > F.col("_s")))
    one = Window.partitionBy("movie_id", "_c", "seg_no")
    chars = F.sum(F.coalesce(F.length("word") + 1, F.lit(0))).over(one.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    met = met.withColumns({"_n": F.count("*").over(one), "_chars": F.coalesce(chars, F.lit(0))}).filter(F.col("_chars") <= most)
    parts = met.groupBy("movie_id", "_c", "seg_no").agg(F.max("_n").alias("_n"), F.collect_list(F.struct("seq", "word")).alias("_w"))
    texts = parts.groupBy("movie_id", "seg_no").agg(F.sum("_n").cast("int").alias("_n"), F.array_sort(F.flatten(F.collect_list("_w"))).alias("_w"))
    joined = F.left(F.array_join(F.transform("_w", lambda x: x["word"]), " "), F.lit(most))
    out = segments.select("movie_id", "seg_no").join(texts, ["movie_id", "seg_no"], "left")
    return out.select("movie_id", "seg_no", F.coalesce("_n", F.lit(0)).alias("n_words"), F.coalesce(joined, F.lit("")).alias("text"))


Client = Callable[[str], list[str]]


def keyword_client(topics: list[str] | None = None) -> Client:
    """A stand-in for a language model: the topics whose name stands in the text, in taxonomy order."""
    names = topics or params.TOPICS
    return lambda text: [t for t in names if t in text]


def classify_topics(texts: DataFrame, client: Callable[[], Client] = keyword_client, text: str = "text", most: int = params.TRANSCRIPT_CHARS) -> DataFrame:
    """texts with `topics`, by a client that each task makes once. Blank texts have none; a failing call gives none."""

    @F.pandas_udf("array<string>")
    def topics(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = client()

        def one(t: str | None) -> list[str]:
            if not t or not t.strip():
                return []
            try:
                return ask(t[:most])
            except Exception:  # noqa: BLE001 - whatever a remote model raises
                return []

        for batch in batches:
            yield batch.map(one)

    return texts.withColumn("topics", topics(F.col(text)))


#: What asks a model: (question, seconds to wait) to its answer as text. It may raise, or stall.
Call = Callable[[str, float], str]

PROMPT = "Which of these topics does the transcript touch? Answer with a JSON array of their names, [] for none.\n{topics}\n\nTranscript:\n{text}"


def chat_service(url: str, model: str, topics: Sequence[str] = tuple(params.TOPICS), prompt: str = PROMPT) -> Callable[[], Call]:
    """A client of a chat completion service at url, for answers(): one POST a question, temperature 0."""

    def make() -> Call:
        def call(text: str, timeout: float) -> str:
            body = {"model": model, "messages": [{"role": "user", "content": prompt.format(topics="\n".join(topics), text=text)}], "temperature": 0.0, "max_tokens": 1000}
            request = urllib.request.Request(f"{url.rstrip('/')}/v1/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout) as f:
                return json.load(f)["choices"][0]["message"]["content"]

        return call

    return make


def asked_together(call: Call, questions: Sequence[str], parallel: int, timeout: float, retries: int, pause: float) -> list[str | None]:
    """The answer to each question, in their order; None where every attempt failed. At most `parallel` calls run at a time. A failed one is
    repeated after a pause that doubles; one that stalls, whatever its client does, is given up after its attempts' time."""
    answers: list[str | None] = [None] * len(questions)
    done: queue.Queue[tuple[int, str | None]] = queue.Queue()
    most = (retries + 1) * timeout + pause * 2**retries + 1

    def attempt(i: int) -> None:
        for k in range(retries + 1):
            try:
                return done.put((i, call(questions[i], timeout)))
            except Exception:  # noqa: BLE001 - whatever a remote model raises
                if k < retries:
                    time.sleep(pause * 2**k)
        return done.put((i, None))

    waiting, active = collections.deque(range(len(questions))), {}
    while waiting or active:
        while waiting and len(active) < parallel:
            i = waiting.popleft()
            active[i] = time.monotonic() + most
            threading.Thread(target=attempt, args=(i,), daemon=True).start()
        try:
            i, answer = done.get(timeout=max(0.01, min(active.values()) - time.monotonic()))
            if active.pop(i, None) is not None:
                answers[i] = answer
        except queue.Empty:
            for i in [i for i, end in active.items() if end <= time.monotonic()]:
                del active[i]
    return answers


def answers(texts: DataFrame, client: Callable[[], Call], text: str = "text", most: int = params.TRANSCRIPT_CHARS, parallel: int = 8, timeout: float = 120.0, retries: int = 2, pause: float = 0.5) -> DataFrame:
    """texts with `answer`, a client's answer to the first `most` characters of each text; null for blank texts and failures. Equal texts are
    asked once in all; each task makes a client and has `parallel` calls open at most."""
    question = F.left(F.col(text), F.lit(most))
    asked = texts.select(question.alias("_q")).filter(F.trim("_q") != "").distinct()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        for batch in batches:
            yield batch.assign(answer=asked_together(call, batch["_q"].tolist(), parallel, timeout, retries, pause))

    got = asked.mapInPandas(rows, "_q string, answer string")
    return texts.withColumn("_q", question).join(got, "_q", "left").drop("_q")


def service_topics(texts: DataFrame, client: Callable[[], Call], topics: Sequence[str] = tuple(params.TOPICS), **how: float) -> DataFrame:
    """texts with `topics`, parsed from the client's answers(); none where it failed."""
    rows = answers(texts, client, **how)
    return rows.withColumn("topics", F.coalesce(exprs.parsed_topics(F.col("answer"), list(topics)), F.array().cast("array<string>"))).drop("answer")


def with_topics(segments: DataFrame, topics: DataFrame) -> DataFrame:
    """segments with the topics of (movie_id, seg_no), joined by key, never by position."""
    return segments.join(topics.select("movie_id", "seg_no", "topics"), ["movie_id", "seg_no"], "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))


def labels(tags: Column, topics: Column) -> Column:
    return F.array_union(F.coalesce(tags, F.array().cast("array<string>")), F.coalesce(topics, F.array().cast("array<string>")))
