"""Judging by a remote service: few-shot prompts of several rows, bounded calls with back-off, parsed verdicts, dead letters, resumption."""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.verdicts import batch_verdicts
from ..sources.shared import staged
from ..sources.writers import Versions
from .windows import global_rank


class Transient(Exception):
    """The service may answer another time: it is busy, or it failed by itself."""


class Permanent(Exception):
    """The service won't answer this prompt."""


#: Statuses after which a call is tried again.
TRY_AGAIN = {408, 409, 425, 429, 500, 502, 503, 504, 529}


@dataclass(frozen=True)
class Protocol:
    """How a service takes a prompt and gives a reply: the path, the request's body, and where the reply's text is."""

    path: str
    body: Callable[[str, str, int], dict]
    text: Callable[[dict], str]


def _turn(prompt: str) -> list[dict]:
    return [{"role": "user", "content": prompt}]


# The shapes of four public service interfaces.
PROTOCOLS = {
    "completions": Protocol("/v1/chat/completions", lambda model, prompt, n: {"model": model, "messages": _turn(prompt), "temperature": 0, "max_tokens": n}, lambda r: r["choices"][0]["message"]["content"]),
    "messages": Protocol("/v1/messages", lambda model, prompt, n: {"model": model, "messages": _turn(prompt), "temperature": 0, "max_tokens": n}, lambda r: "".join(p["text"] for p in r["content"] if p.get("type") == "text")),
    "contents": Protocol(
        "/v1beta/models/{model}:generateContent",
        lambda model, prompt, n: {"contents": [{"role": "user", "parts": [{"text": prompt}]}], "generationConfig": {"temperature": 0, "maxOutputTokens": n}},
        lambda r: "".join(p.get("text", "") for p in r["candidates"][0]["content"]["parts"]),
    ),
    "local": Protocol("/api/chat", lambda model, prompt, n: {"model": model, "messages": _turn(prompt), "stream": False, "options": {"temperature": 0, "num_predict": n}}, lambda r: r["message"]["content"]),
}


@dataclass(frozen=True)
class Service:
    """A callable (prompt, try) to reply over ``post``: (path, JSON body) to (status, JSON body)."""

    post: Callable[[str, str], tuple[int, str]]
    protocol: str = "completions"
    model: str = "judge"
    max_tokens: int = 64

    def __call__(self, prompt: str, attempt: int) -> str:
        p = PROTOCOLS[self.protocol]
        try:
            status, body = self.post(p.path.format(model=self.model), json.dumps(p.body(self.model, prompt, self.max_tokens)))
        except (OSError, TimeoutError) as e:
            raise Transient(str(e)) from e
        if status in TRY_AGAIN:
            raise Transient(f"status {status}")
        if status != 200:
            raise Permanent(f"status {status}")
        try:
            return p.text(json.loads(body))
        except (ValueError, KeyError, IndexError, TypeError) as e:
            raise Transient(f"no reply in the answer: {e}") from e


def pause(prompt: str, attempt: int, base: float, most: float) -> float:
    """Seconds before try ``attempt`` + 1: doubled each time up to ``most``, less up to a half by a hash of the prompt, so that calls don't come back together."""
    return min(most, base * 2**attempt) * (1.0 - (zlib.crc32(f"{attempt}|{prompt}".encode()) % 1000) / 2000)


def calls(df: DataFrame, key: str, line: Column, size: int, head: str = "", examples: list[tuple[str, int]] = ()) -> DataFrame:
    """(call, keys, prompt): ``size`` rows a call in the order of ``key``; after ``head`` and the solved ``examples`` each row is a numbered line."""
    shots = "".join(f"{i}. {text} -> {verdict}\n" for i, (text, verdict) in enumerate(examples, 1))
    numbered = global_rank(df.select(F.col(key).alias("key"), line.alias("line")), "key", "key", "_r")
    at = F.col("_r") % size + 1
    grouped = numbered.groupBy(F.floor(F.col("_r") / size).alias("call")).agg(F.sort_array(F.collect_list(F.struct(at.alias("n"), "key", "line"))).alias("_l"))
    text = F.array_join(F.transform("_l", lambda x: F.concat(x["n"].cast("string"), F.lit(". "), F.regexp_replace(F.coalesce(x["line"], F.lit("")), r"\s*\n\s*", " "))), "\n")
    return grouped.select("call", F.col("_l.key").alias("keys"), F.concat(F.lit(head + shots), text).alias("prompt"))


def ask(prompts: DataFrame, send: Callable[[str, int], str], at_once: int = 4, tries: int = 5, base: float = 0.5, most: float = 30.0, prompt_col: str = "prompt") -> DataFrame:
    """``prompts`` with reply, attempts and error: a reply, or null and what the last try failed of.

    A task has ``at_once`` calls under way at most and holds no more rows than these. A Transient failure is tried again after a pause, ``tries`` times in all; a Permanent one isn't. Another exception is an error of
    the job.
    """
    names = [*prompts.columns, "reply", "attempts", "error"]

    def one(prompt: str) -> tuple[str | None, int, str | None]:
        error = None
        for attempt in range(tries):
            try:
                return send(prompt, attempt), attempt + 1, None
            except Permanent as e:
                return None, attempt + 1, f"permanent: {e}"
            except Transient as e:
                error = f"transient: {e}"
                if attempt + 1 < tries:
                    time.sleep(pause(prompt, attempt, base, most))
        return None, tries, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                for lo in range(0, batch.num_rows, at_once):
                    part = batch.slice(lo, at_once)
                    replies, attempts, errors = zip(*pool.map(one, part[prompt_col].to_pylist()), strict=True)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(replies, pa.string()), pa.array(attempts, pa.int32()), pa.array(errors, pa.string())], names=names)

    kinds = "reply string, attempts int, error string"
    return prompts.mapInArrow(run, T.StructType([*prompts.schema.fields, *T.StructType.fromDDL(kinds).fields]))


def verdicts(answers: DataFrame) -> DataFrame:
    """(key, verdict, attempts, error): a row for each key of each call; null where the call failed or its reply has no verdict for the row.

    Bare lines of 0 and 1 count if there are just as many as rows, else numbered lines do.
    """
    each = F.arrays_zip(F.col("keys").alias("key"), batch_verdicts(F.col("reply"), F.size("keys")).alias("verdict"))
    rows = answers.select(F.explode(each).alias("x"), "attempts", "error")
    return rows.select("x.key", F.when(F.col("error").isNull(), F.col("x.verdict")).alias("verdict"), "attempts", "error")


def judge(df: DataFrame, key: str, line: Column, send: Callable[[str, int], str], path: str, size: int = 15, head: str = "", examples: list[tuple[str, int]] = (), **options) -> tuple[DataFrame, DataFrame]:
    """(verdicts, dead letters) of all runs so far: tables (key, verdict, attempts) and (key, attempts, error) below ``path``.

    Rows with a verdict aren't asked about again, so a run that broke off is simply run again. What no try answered goes to the dead letters, once for each run, and is asked
    about in the next run.
    """
    spark = df.sparkSession
    done, dead = Versions(spark, f"{path}/verdicts"), Versions(spark, f"{path}/dead")
    rest = df.join(done.read().select(F.col("key").alias(key)), key, "left_anti") if done.latest() else df
    asked = staged(verdicts(ask(calls(rest, key, line, size, head, examples), send, **options)))
    done.append(asked.filter("verdict IS NOT NULL").select("key", "verdict", "attempts"), "key")
    runs = dead.latest()
    lost = asked.filter("verdict IS NULL").select("key", "attempts", F.coalesce("error", F.lit("no verdict in the reply")).alias("error"), F.lit(runs).alias("run"))
    dead.commit([*dead.folders(runs), dead.write(lost)], runs)
    return done.read(), dead.read()
