"""Token counts with a whole-token shortcut, for a BPE vocabulary whose words end in a marker.

Once, on the driver, every vocabulary string that ends a word is encoded alone; those that come
back as one token are proven whole tokens. A document is split into pre-tokens as the tokenizer
would split it; those in the proven table count one, and only the rest are merged, each distinct
one once while it stays in a bounded cache.

The split is done here only for texts whose every character is in SAFE, where it is the same as
the library's (the tests compare every character); any other text is encoded whole by the library.

Defined results: null and empty texts have 0 bytes and 0 tokens; special strings inside a text
are single tokens, as the library takes them; repeated rows and null ids count row by row; an
empty table gives an empty one; further columns do not matter.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetshape.llm.frames import map_text, rows_of, text_slices, widened

LIMIT = 2048
#: Merged pre-tokens that a worker remembers before it starts anew.
CACHE = 1_000_000

#: The pre-token pattern of the vocabulary file.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters that composition leaves alone and whose lower case and class do not depend on a Unicode version.
SAFE = regex.compile("[\u0000-˿΄-ΆΈ-ϿЀ-҂Ҋ-ԧ‐-‧‰-›€™ぁ-ゖァ-ヺ一-龥가-힣]*+")


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, to that byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


LETTERS = {b: letter for letter, b in _byte_letters().items()}


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def whole_tokens(path: str, end: str = "</w>") -> dict[str, int]:
    """Strings proven to be one token when they stand alone; at most the vocabulary."""
    tokenizer, letters, words = load(path), _byte_letters(), []
    for entry in tokenizer.get_vocab(with_added_tokens=False):
        if entry.endswith(end) and all(c in letters for c in entry[:-len(end)]):
            try:
                words.append(bytes(letters[c] for c in entry[:-len(end)]).decode())
            except UnicodeDecodeError:
                continue  # a piece of a character never stands alone
    encoded = tokenizer.encode_batch(words, add_special_tokens=False)
    return {w: 1 for w, e in zip(words, encoded) if len(e.ids) == 1 and PRE_TOKEN.fullmatch(w)}


class Counter:
    """Counts of one worker: the proven table, what has been merged since, and the library."""

    def __init__(self, path: str, whole: dict[str, int]):
        self.tokenizer, self.whole, self.known = load(path), whole, dict(whole)
        specials = [regex.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(specials)) if specials else None

    def count(self, text: str) -> int:
        if not SAFE.fullmatch(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if self.special is not None and self.special.search(text):
            pieces = self.special.split(text)
            return len(pieces) - 1 + sum(map(self._plain, pieces))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        # Sigma has two small forms, of which the library always takes the first.
        tokens = PRE_TOKEN.findall(text.replace("Σ", "σ").lower())
        known = self.known
        try:
            return sum(map(known.__getitem__, tokens))
        except KeyError:
            new = [t for t in set(tokens) if t not in known]
        if len(known) + len(new) > CACHE + len(self.whole):
            known = self.known = dict(self.whole)
            new = [t for t in set(tokens) if t not in known]
        merge = self.tokenizer.model.tokenize
        known.update((t, len(merge(t.encode().decode("latin-1").translate(LETTERS)))) for t in new)
        return sum(map(known.__getitem__, tokens))


def _counting(path: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, shared.value)
        for part, data, ends in text_slices(batches):
            texts = rows_of(data, ends)
            yield widened(part, {"n_bytes": pa.array(map(len, texts), pa.int64()),
                                 "n_tokens": pa.array([counter.count(t.decode()) for t in texts], pa.int64())})
    return run


def token_counts(df: DataFrame, vocabulary: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per input row. `vocabulary` is a file that all workers have."""
    shared = df.sparkSession.sparkContext.broadcast(whole_tokens(vocabulary))
    counted = map_text(df, _counting(vocabulary, shared), {"doc_id": df["doc_id"]}, text, "n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
