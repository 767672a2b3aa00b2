"""Quality rules as a bitmask ledger.

Every rule is evaluated once for every document. The ledger keeps the measurements and one
failure bit per rule; policies are versioned masks over those bits, so a new policy or an
ablation reads the ledger and never the text again.

Defined results: null or empty text has no words (all counts 0) and fails `few_words`; repeated
rows and null ids are measured row by row; an empty table gives an empty ledger; further columns
of the input are carried only by `keep_good`.

`capitals` counts letters of every script and judges only texts whose letters mostly have case;
`word_length` has no upper bound for texts mostly in scripts that do not separate words.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetshape.llm.frames import counts_in, map_text, rows_of, text_slices, widened

#: Words of a window that counts as repeated text.
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_letters", "n_unspaced")

#: Name and failing condition of each rule; the position is the bit. Only append.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words and 2 * n_unspaced <= word_chars)"),
    ("capitals", "n_upper > n_lower and 2 * (n_upper + n_lower) > n_letters"),
)
BASE_RULES = ("few_words", "repeated_windows")
#: Policies by version, as the rules that reject; the last is in force.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE_RULES,
    "v2": (*BASE_RULES, "symbols", "repeated_lines", "word_length", "capitals"),
}
CURRENT_POLICY = "v2"

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CODE_POINT = np.array([(b & 0xC0) != 0x80 for b in range(256)])
_UPPER, _LOWER, _LETTER, _UNSPACED = 1, 2, 4, 8
#: Thai, Lao, Tibetan, Myanmar, Khmer, CJK punctuation, kana, Han, full-width forms; all are written without blanks.
UNSPACED = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3000, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF),
            (0xFF00, 0xFF9F), (0x20000, 0x3FFFF))


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Bits _UPPER, _LOWER, _LETTER and _UNSPACED of every code point."""
    of = {"Lu": _UPPER | _LETTER, "Lt": _LETTER, "Ll": _LOWER | _LETTER, "Lm": _LETTER, "Lo": _LETTER}
    kinds = np.array([of.get(unicodedata.category(chr(c)), 0) for c in range(0x110000)], np.uint8)
    for first, last in UNSPACED:
        kinds[first:last + 1] |= _UNSPACED
    return kinds


def _kinds_at(data: np.ndarray) -> np.ndarray:
    """Kind of each character of UTF-8 text, at its first byte; other bytes have none."""
    if not len(data) or data.max() < 0x80:
        return _kinds()[data]
    found = np.zeros(len(data), np.uint8)
    # A byte that is no UTF-8 becomes one of the code points DC80 to DCFF.
    points = np.frombuffer(data.tobytes().decode(errors="surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    width[(points >= 0xDC80) & (points <= 0xDCFF)] = 1
    found[np.cumsum(width) - width] = _kinds()[points]
    return found


def mask_of(rules: tuple[str, ...]) -> int:
    bits = {name: 1 << i for i, (name, _) in enumerate(RULES)}
    return sum(bits[r] for r in rules)


def _repeated(words: list[list[bytes]], starts: np.ndarray) -> np.ndarray:
    """Per row: words inside windows of WINDOW words that occur twice or more in the row. Exact, by doubling ids."""
    n = int(starts[-1])
    if n < WINDOW:
        return np.zeros(len(words), np.int64)
    ids = pa.array([w for row in words for w in row], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    for step in (1, 2, 4):
        ids = pd.factorize(ids[:-step] * (ids.max() + 1) + ids[step:])[0].astype(np.int64)
    row = np.repeat(np.arange(len(words)), np.diff(starts))[:len(ids)]
    first = np.flatnonzero(starts[row + 1] - np.arange(len(ids)) >= WINDOW)
    steps = np.zeros(n + 1, np.int64)
    if len(first):
        key = pd.factorize(row[first] * (ids.max() + 1) + ids[first])[0]
        again = first[np.bincount(key)[key] > 1]
        steps[again] += 1
        steps[again + WINDOW] -= 1
    return counts_in(np.cumsum(steps)[:n] > 0, starts)


def _measure(batches: Iterator[pa.RecordBatch], keep_text: bool = False) -> Iterator[pa.RecordBatch]:
    for part, data, ends in text_slices(batches):
        texts = rows_of(data, ends)
        words = [t.split() for t in texts]  # ASCII white space only, as the rules want it
        starts = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
        kinds = _kinds_at(data)
        lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
        found = {
            "n_words": np.diff(starts),
            "word_chars": counts_in(_CODE_POINT[data] & ~_WHITE[data], ends),
            "n_symbols": counts_in(_SYMBOL[data], ends),
            "n_dup_lines": [len(x) - len(set(x)) for x in lines],
            "n_repeat_words": _repeated(words, starts),
            "n_lines": [len(x) for x in lines],
            "n_upper": counts_in(kinds & _UPPER != 0, ends),
            "n_lower": counts_in(kinds & _LOWER != 0, ends),
            "n_letters": counts_in(kinds & _LETTER != 0, ends),
            "n_unspaced": counts_in(kinds & _UNSPACED != 0, ends),
        }
        yield widened(part, {m: pa.array(found[m], pa.int64()) for m in MEASURES}, keep_text)


def _failed() -> Column:
    bits = [F.when(F.expr(test), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, test) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return total.cast("long")


_NEW = ", ".join(f"{m} long" for m in MEASURES)


def measure(df: DataFrame, text: str = "text", keys: dict[str, Column] | None = None) -> DataFrame:
    """The ledger: `keys` (doc_id), MEASURES and `failed` (bit i set: rule i failed), one row per input row."""
    return map_text(df, _measure, keys or {"doc_id": df["doc_id"]}, text, _NEW).withColumn("failed", _failed())


def passes(policy: str = CURRENT_POLICY) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("long")) == 0


def apply_policy(ledger: DataFrame, policy: str = CURRENT_POLICY) -> DataFrame:
    """The ledger with `policy` and `kept`."""
    return ledger.withColumns({"policy": F.lit(policy), "kept": passes(policy)})


def ablations(ledger: DataFrame, policies: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Per policy and rule left out (null: none): rows kept, rows only that rule rejects. Reads failure bits alone.

    The ledger is first counted by its bits, at most 2 ** len(RULES) rows whatever the input.
    """
    cases = [(name, left_out, mask_of(tuple(r for r in rules if r != left_out)))
             for name, rules in (policies or POLICIES).items() for left_out in (None, *rules)]
    struct = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).cast("string").alias("left_out"), F.lit(m).cast("long").alias("mask"),
                                F.lit(mask_of((policies or POLICIES)[p])).cast("long").alias("whole")) for p, r, m in cases])
    patterns = ledger.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    each = patterns.select("failed", "n", F.explode(struct).alias("c"))
    ok = F.col("failed").bitwiseAND(F.col("c.mask")) == 0
    return each.groupBy("c.policy", "c.left_out").agg(
        F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("n_kept"),
        F.sum(F.when(ok & (F.col("failed").bitwiseAND(F.col("c.whole")) != 0), F.col("n")).otherwise(0)).alias("n_only_by_rule"),
        F.sum("n").alias("n_rows"),
    )


def keep_good(df: DataFrame, text: str = "text", policy: str = CURRENT_POLICY) -> DataFrame:
    """The rows of `df` that the policy keeps, with all their columns. A text goes to the measuring and back once."""
    rest = [c for c in df.columns if c != text]
    # A struct of no columns is no struct.
    keys = {"__rest": F.struct(*[df[f"`{c}`"] for c in rest])} if rest else {}
    rows = map_text(df, partial(_measure, keep_text=True), keys, text, f"__text string, {_NEW}")
    kept = rows.withColumn("failed", _failed()).where(passes(policy))
    return kept.select(*[F.col("__text").alias(c) if c == text else F.col(f"__rest.`{c}`").alias(c) for c in df.columns])
