"""External model calls behind a memo table, and the repair of their answers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def call_key(model: str, payload: Column) -> Column:
    """Address of a call's answer."""
    return F.sha2(F.concat(F.lit(model), F.lit("\n"), payload), 256)


def hits_and_misses(calls: DataFrame, memo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (key, payload) that the memo (key, answer) has, with answers, and those it lacks, each once."""
    return calls.join(memo, "key"), calls.join(memo, "key", "left_anti").dropDuplicates(["key"])


def fill(misses: DataFrame, ask: Callable[[str], str]) -> DataFrame:
    """(key, answer) of the missing calls from any provider; failures give a null answer and are asked again next time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            answers = []
            for p in f["payload"]:
                try:
                    answers.append(ask(p))
                except Exception:  # noqa: BLE001
                    answers.append(None)
            yield pd.DataFrame({"key": f["key"], "answer": answers})

    return misses.select("key", "payload").mapInPandas(run, "key string, answer string")


def _ends(body: str) -> tuple[list[tuple[int, str]], str]:
    """Places where a value inside the object has just ended, each with the brackets still open there, and what closes the whole text; one pass."""
    stack, out, quoted, escaped = [], [], False, False
    for i, c in enumerate(body):
        if quoted:
            escaped, quoted = (c == "\\" and not escaped), (c != '"' or escaped)
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
            out.append((i + 1, "".join(reversed(stack))))
        elif c in "}]" and stack:
            stack.pop()
            out.append((i + 1, "".join(reversed(stack))))
        elif c == ",":
            out.append((i, "".join(reversed(stack))))
    return out, '"' * quoted + "".join(reversed(stack))


def salvage(text: str | None) -> str | None:
    """The JSON object in an answer: without fences and talk around it, and cut back to the last place where a truncated one can be closed."""
    start = text.find("{") if text else -1
    if start < 0:
        return None
    body, decode = text[start:], json.JSONDecoder().raw_decode
    try:
        return json.dumps(decode(body)[0], ensure_ascii=False, sort_keys=True)
    except ValueError:
        pass
    ends, rest = _ends(body)
    tried, at = body + rest, len(body)
    while True:
        try:
            return json.dumps(decode(tried)[0], ensure_ascii=False, sort_keys=True)
        except json.JSONDecodeError as e:
            # What stands before the error can be closed; so goes on from the last end before it.
            at = min(at - 1, e.pos)
        while ends and ends[-1][0] > at:
            ends.pop()
        if not ends:
            return None
        at, close = ends[-1]
        tried = body[:at] + close


@F.pandas_udf(T.StringType())
def salvaged(text: pd.Series) -> pd.Series:
    return text.map(salvage)


def parse_answers(answers: DataFrame, schema: str) -> DataFrame:
    """(…, parsed): strict parsing first; only answers that fail it go to the repair."""
    strict = F.from_json("answer", schema)
    ok = answers.withColumn("parsed", F.when(F.try_parse_json("answer").isNotNull(), strict))
    bad = ok.where("parsed is null").drop("parsed").withColumn("parsed", F.from_json(salvaged("answer"), schema))
    return ok.where("parsed is not null").unionByName(bad)
