"""Script corpora: splitting scripts into batches on GO."""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whitespace as .NET trims it (str.strip would also take the ASCII separators 0x1c-0x1f).
_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_COUNT = re.compile(r"[+-]?[0-9]+\Z")
_MAX_COUNT = 2**31 - 1

# What may open a span in which GO is just text, and how each span ends.
_OPENER = re.compile(r"\n|--|/\*|['\"\[]")
_CLOSERS = {"'": re.compile(r"''|'"), '"': re.compile(r'""|"'), "[": re.compile(r"\]\]|\]")}
_COMMENT_EDGE = re.compile(r"/\*|\*/")


def separator_count(line: str) -> int | None:
    """Repeat count of a separator line, or None when the line is ordinary text."""
    line = line.strip(_SPACE)
    if line[:2].upper() != "GO":
        return None
    count = line[2:].partition("--")[0].strip(_SPACE)
    if not count:
        return 1
    if not _COUNT.match(count) or not 1 <= int(count) <= _MAX_COUNT:
        return None
    return int(count)


def _span_end(text: str, at: int, opener: str) -> int:
    """End of the comment, string or quoted name opened just before `at`; an open end reaches the end."""
    if opener == "--":
        end = text.find("\n", at)
        return len(text) if end < 0 else end
    if opener == "/*":
        depth = 1
        while depth:
            edge = _COMMENT_EDGE.search(text, at)
            if not edge:
                return len(text)
            depth += 1 if edge.group() == "/*" else -1
            at = edge.end()
        return at
    while True:
        close = _CLOSERS[opener].search(text, at)
        if not close:
            return len(text)
        at = close.end()
        if len(close.group()) == 1:
            return at


def split_script(script: str) -> list[tuple[str, int]]:
    """Batches of one script with their repeat counts; empty batches are dropped."""
    text = script.replace("\r\n", "\n")
    batches, start, at, line_start = [], 0, 0, True
    while True:
        if line_start:
            newline = text.find("\n", at)
            end = len(text) if newline < 0 else newline
            count = separator_count(text[at:end])
            if count is not None:
                batches.append((text[start:at].strip(_SPACE), count))
                start = at = min(end + 1, len(text))
                if at < len(text):
                    continue
                break
        opener = _OPENER.search(text, at)
        if not opener:
            break
        line_start = opener.group() == "\n"
        at = opener.end() if line_start else _span_end(text, opener.end(), opener.group())
    batches.append((text[start:].strip(_SPACE), 1))
    return [b for b in batches if b[0]]


# Copies of a batch that one expansion makes.
RUN = 32_768
_PIECES = T.ArrayType(T.StructType([
    T.StructField("text", T.StringType()), T.StructField("repeat", T.IntegerType()), T.StructField("first_no", T.LongType())]))

# The scanner travels with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@F.pandas_udf(_PIECES)
def _split_each(scripts: pd.Series) -> pd.Series:
    def split(script: str | None) -> list[dict]:
        out, number = [], 1
        for text, repeat in split_script(script or ""):
            out.append({"text": text, "repeat": repeat, "first_no": number})
            number += repeat
        return out

    return scripts.map(split)


# Scripts of one Arrow batch, and its bytes: a worker holds one batch, its text again as Python strings, and what it cuts it into.
BATCH_ROWS, BATCH_BYTES = 128, 8 << 20


def _small_batches(scripts: DataFrame) -> DataFrame:
    conf = scripts.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return scripts


def split_batches(scripts: DataFrame) -> DataFrame:
    """`(script_id, batch_no, text)`: one row per batch to run, a counted separator giving its batch again.

    The scanner's state nests, so it is the one text step outside the JVM; scripts are
    spread by row and travel as Arrow batches.
    """
    pieces = _small_batches(scripts).select("script_id", F.inline(_split_each("text")))
    # A count may be two billion: runs of copies first, so that no array holds them all.
    runs = pieces.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("repeat") - 1) / RUN))).alias("run"))
    repeated = runs.select("*", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("run") * RUN + RUN, "repeat") - 1)).alias("copy"))
    return repeated.select("script_id", (F.col("first_no") + F.col("copy")).alias("batch_no"), "text")


def batch_counts(scripts: DataFrame) -> DataFrame:
    """Batches each script would run (the dry-run count), scripts without any included. No batch is expanded."""
    total = F.aggregate(_split_each("text"), F.lit(0).cast("bigint"), lambda n, b: n + b["repeat"])
    return _small_batches(scripts).select("script_id", total.alias("batches"))
