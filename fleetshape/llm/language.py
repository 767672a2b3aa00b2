"""Language identification of mixed-language text.

Letters fall into scripts by code-point ranges; a word's script narrows the languages it may be
in. Its score per language is the log likelihood of its character one- to three-grams. Viterbi
over the words, with a penalty for each change of language, labels spans; a document's language
is the one with the most letters.

Learning counts n-grams (hashed into BUCKETS) per language over a bounded hash sample of the
labelled documents, inside the tasks; the model is languages x BUCKETS numbers.

Defined results: null text and text without a letter give `und`, score 0 and no span; so does
everything when no label was learned; ties go to the first language in order; null labels are
not learned from; repeated rows and null ids are predicted row by row; an empty table gives an
empty one; further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetshape.llm.frames import map_text, rows_of, small_batches, text_slices, widened

UNKNOWN = "und"
#: Labelled documents per language that are learned from, about: the bound of the sample.
SAMPLE = 3_000
#: Languages that a model may have; more labels than this are refused.
MAX_LANGUAGES = 200
BUCKETS = 1 << 14
SMOOTHING = 0.1
#: Cost of a change of language, in nats, and of a word whose script the language does not use.
SWITCH = 20.0
FOREIGN = 40.0
#: Share of a language's letters from which a script belongs to it.
SCRIPT_SHARE = 0.01

#: Unicode ranges of scripts. Letters beyond them are one more class.
SCRIPTS = {
    "latin": "A-Za-zªºÀ-ÖØ-öø-ʯḀ-ỿ",
    "greek": "Ͱ-Ͽἀ-῿",
    "cyrillic": "Ѐ-ԯ",
    "armenian": "԰-֏",
    "hebrew": "֐-׿",
    "arabic": "؀-ۿݐ-ݿ",
    "devanagari": "ऀ-ॿ",
    "bengali": "ঀ-৿",
    "tamil": "஀-௿",
    "thai": "฀-๿",
    "georgian": "Ⴀ-ჿ",
    "hangul": "ᄀ-ᇿ가-힯",
    "kana": "぀-ヿ",
    "han": "㐀-䶿一-鿿",
}
_WORD = regex.compile("|".join([rf"[[{r}]&&[\p{{L}}\p{{M}}]]+" for r in SCRIPTS.values()] + [r"\p{L}+?"]), regex.V1)
_LETTER = regex.compile(r"\p{L}")
_FIRST = [regex.compile(f"[{r}]") for r in SCRIPTS.values()]
N_SCRIPTS = len(SCRIPTS) + 1


@lru_cache(maxsize=1 << 16)
def _script(letter: str) -> int:
    return next((i for i, r in enumerate(_FIRST) if r.match(letter)), N_SCRIPTS - 1)


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed one- to three-grams of the words (with edges), and the word each belongs to."""
    marked = [f"\x02{w.lower()}\x03" for w in words]
    length = np.array([len(m) for m in marked], np.int64)
    points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), length)
    last = np.repeat(np.cumsum(length), length)
    position = np.arange(len(points))
    grams, owners, h = [], [], np.zeros(len(points), np.uint64)
    for n in range(1, 4):
        fits = position + n <= last
        h = h[:len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1:] + np.uint64(n)
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        keep = fits[:len(mixed)]
        grams.append((mixed >> np.uint64(50))[keep].astype(np.int64))
        owners.append(owner[:len(mixed)][keep])
    return np.concatenate(grams), np.concatenate(owners)


#: ASCII that is no letter to a blank: what stands between blanks holds whole words.
_SPACED = bytes(b if b > 0x7F or chr(b).isalpha() else 0x20 for b in range(256))


#: Bytes of a chunk whose words a worker remembers, and how many chunks it remembers before it starts anew.
SHORT, REMEMBERED = 12, 200_000
_KNOWN: dict[bytes, list[str]] = {}


def _chunk_words(chunk: bytes) -> list[str]:
    words = _KNOWN.get(chunk)
    if words is None:
        text = chunk.decode()
        # Latin letters alone are one word: ASCII is nothing else here, and below U+0250 only the micro sign is a letter of no Latin range.
        if chunk.isascii() or (text.isalpha() and max(text) < "\u0250" and "\xb5" not in text):
            words = [text]
        else:
            words = [w for w in _WORD.findall(text) if w.isalpha() or _LETTER.search(w)]
        if len(chunk) <= SHORT:
            if len(_KNOWN) >= REMEMBERED:
                _KNOWN.clear()
            _KNOWN[chunk] = words
    return words


def _words_of(texts: list[bytes]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Where each text's words begin, the distinct words, and the number of each word in them."""
    chunks = [t.translate(_SPACED).split() for t in texts]
    coded = pa.array([c for row in chunks for c in row], pa.binary()).dictionary_encode()
    chunk = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    parts = [_chunk_words(c) for c in coded.dictionary.to_pylist()]
    held = np.array([len(p) for p in parts], np.int64)
    first = np.cumsum(held) - held
    n = held[chunk]
    before = np.concatenate(([0], np.cumsum(n)))
    index = np.repeat(first[chunk] - before[:-1], n) + np.arange(before[-1])
    ends = np.concatenate(([0], np.cumsum([len(c) for c in chunks]))).astype(np.int64)
    return before[ends], [w for p in parts for w in p], index


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: n-grams (features from 0) and letters per script (from BUCKETS) by language."""
    total: dict[str, np.ndarray] = {}
    for part, data, ends in text_slices(batches):
        langs = part.column(0).to_pylist()
        texts = rows_of(data, ends)
        for lang in sorted(set(langs)):
            _, words, index = _words_of([t for t, x in zip(texts, langs) if x == lang])
            if not words:
                continue
            times = np.bincount(index, minlength=len(words)).astype(np.float64)
            grams, owner = _grams(words)
            counts = total.setdefault(lang, np.zeros(BUCKETS + N_SCRIPTS))
            counts[:BUCKETS] += np.bincount(grams, times[owner], BUCKETS)
            letters = times * [len(w) for w in words]
            counts[BUCKETS:] += np.bincount([_script(w[0]) for w in words], letters, N_SCRIPTS)
    for lang, counts in total.items():
        features = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(features), pa.string()), pa.array(features, pa.int32()),
                                          pa.array(counts[features].astype(np.int64))], names=["lang", "feature", "n"])


@dataclass
class Model:
    """Log likelihoods (BUCKETS x languages) and which scripts a language may be written in."""

    languages: list[str]
    weights: np.ndarray
    scripts: np.ndarray


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Model of the documents of `labelled` (doc_id, text, lang); about `sample` per language are read."""
    small_batches(labelled.sparkSession)
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang).count().orderBy(lang).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts: dict[str, np.ndarray] = {x: np.zeros(BUCKETS + N_SCRIPTS) for x in sizes}
    if sizes:
        share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))])
        drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share[F.col(lang)] * 1_000_003
        rows = known.where(drawn).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
        summed = rows.mapInArrow(_count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
        found = summed.toArrow()  # languages x (BUCKETS + scripts) rows at most
        for name, feature, n in zip(*(c.to_pylist() for c in found.columns)):
            counts[name][feature] = n
    learned = [x for x in sorted(sizes) if counts[x].any()]
    if not learned:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((N_SCRIPTS, 0), bool))
    grams = np.stack([counts[x][:BUCKETS] for x in learned], 1) + SMOOTHING
    letters = np.stack([counts[x][BUCKETS:] for x in learned], 1)
    usual = letters >= SCRIPT_SHARE * letters.sum(0)
    usual &= letters > 0
    usual[~usual.any(1)] = True  # a script that nobody uses narrows nothing
    return Model(learned, np.log(grams / grams.sum(0)), usual)


def _scores(model: Model, words: list[str]) -> np.ndarray:
    grams, owner = _grams(words)
    out = np.stack([np.bincount(owner, w, len(words)) for w in model.weights[grams].T], 1)
    return out - FOREIGN * ~model.scripts[[_script(w[0]) for w in words]]


def _run_gains(gain: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Per word: the most that a run ending there, within its document, gains in one language."""
    total = np.concatenate((np.zeros((1, gain.shape[1])), np.cumsum(gain, 0)))
    wall = row * -(2.0 * np.abs(total).max() + 1.0)  # a new document starts below all before it
    low = np.minimum.accumulate(total[:-1] + wall[:, None], 0) - wall[:, None]
    return (total[1:] - low).max(1)


def _detours(scores: np.ndarray, main: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents in which some run of words gains more than half a change in a language other than `main`, and the first
    and the last word of all such runs.

    Runs that gain no more than half a change pay for no change of their own, so a best path has none that begins and
    ends beyond these words; at most one language takes all words ahead of them, and one all behind, where that saves
    no change but costs none.
    """
    row = np.repeat(np.arange(len(main)), np.diff(starts))
    gain = scores - scores[np.arange(len(scores)), main[row]][:, None]
    ends = np.flatnonzero(_run_gains(gain, row) > SWITCH / 2)
    rows, first_of = np.unique(row[ends], return_index=True)
    last = ends[np.concatenate((first_of[1:], [len(ends)])) - 1] if len(ends) else ends
    # Where such runs begin: the same from behind, in the documents that have any.
    own = np.flatnonzero(np.isin(row, rows))[::-1]
    _, behind = np.unique(row[own], return_inverse=True)
    begins = own[_run_gains(gain[own], behind.max(initial=0) - behind) > SWITCH / 2][::-1]
    _, at = np.unique(row[begins], return_index=True)
    return rows, begins[at], last


#: Documents, times languages, below which plain numbers are quicker than arrays.
FEW = 24


def _alone(scores: np.ndarray, best: list[float]) -> tuple[list[list[int]], list[float]]:
    """Steps of one document after `best`: where each language came from, and the last values."""
    own, came = range(len(best)), []
    for row in scores.tolist():
        top = max(own, key=best.__getitem__)
        moved = best[top] - SWITCH
        came.append([k if best[k] >= moved else top for k in own])
        best = [(b if b >= moved else moved) + s for b, s in zip(best, row)]
    return came, best


def _viterbi(scores: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Best language of each word of the documents `rows` (others: 0), word by word for all of them at once, the last few documents one by one."""
    length = starts[rows + 1] - starts[rows]
    order = np.argsort(-length, kind="stable")
    begin, length = starts[rows[order]], length[order]
    longest, k = int(length[0]), scores.shape[1]
    active = np.searchsorted(-length, -np.arange(longest), "left")  # documents longer than t
    together = int(np.searchsorted(-active * k, -FEW, "right"))  # steps that are made for all at once
    together = max(together, 1)
    own = np.arange(k)
    came = np.empty(scores.shape, np.int16)
    best = scores[begin]
    for t in range(1, together):
        n = active[t]
        at, now = begin[:n] + t, best[:n]
        top = now.argmax(1)
        moved = now[np.arange(n), top][:, None] - SWITCH
        stay = now >= moved
        came[at] = np.where(stay, own, top[:, None])
        best[:n] = np.where(stay, now, moved) + scores[at]
    path = np.zeros(len(scores), np.int64)
    left = int(active[together]) if together < longest else 0
    for i in range(left):
        a, b = int(begin[i]) + together, int(begin[i] + length[i])
        back, values = _alone(scores[a:b], best[i].tolist())
        best[i] = values
        current, out = int(np.argmax(best[i])), []
        for row in reversed(back):
            out.append(current)
            current = row[current]
        path[a:b] = out[::-1]
        # What the step before has to be; the steps made for all go on from there.
        best[i] = -np.inf
        best[i, current] = 0.0
    current = best.argmax(1)
    for t in range(together - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        path[at] = current[:n]
        if t:
            current[:n] = came[at, current[:n]]
    return path


def _paths(scores: np.ndarray, total: np.ndarray, main: np.ndarray, starts: np.ndarray) -> dict[int, np.ndarray]:
    """The best path of each document that has a detour, by Viterbi over as few words as decide it: all that stand ahead of its
    detours count as one, and so do all behind."""
    rows, first, last = _detours(scores, main, starts)
    if not len(rows):
        return {}
    pieces, times = [], []
    for i, a, b in zip(rows.tolist(), first.tolist(), (last + 1).tolist()):
        begin, end = int(starts[i]), int(starts[i + 1])
        inside = scores[a:b]
        # Neighbours that rank all languages alike are one word too: a change between them is as well made before or behind both.
        rank = np.argsort(inside, 1, kind="stable")
        cuts = np.concatenate(([0], np.flatnonzero((rank[1:] != rank[:-1]).any(1)) + 1))
        pieces += [(total[a] - total[begin])[None]] * (a > begin) + [np.add.reduceat(inside, cuts, 0)] + [(total[end] - total[b])[None]] * (end > b)
        times.append(np.concatenate(([a - begin] * (a > begin), np.diff(np.concatenate((cuts, [b - a]))), [end - b] * (end > b))).astype(np.int64))
    short = np.concatenate(([0], np.cumsum([len(t) for t in times])))
    path = _viterbi(np.concatenate(pieces), short, np.arange(len(rows)))
    return {i: np.repeat(path[short[k]:short[k + 1]], times[k]) for k, i in enumerate(rows.tolist())}


def _spans(text: str, model: Model, path: np.ndarray) -> list[dict]:
    """Consecutive words of one language, from the first word's first character to the next span's."""
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist()]
    starts = []
    if len(cuts) > 1:
        for m in _WORD.finditer(text):
            if m.group().isalpha() or _LETTER.search(m.group()):
                starts.append(m.start())
                if len(starts) > cuts[-1]:
                    break
    edges = [0, *(starts[c] for c in cuts[1:]), len(text)]
    return [{"lang": model.languages[path[c]], "start": a, "end": b} for c, a, b in zip(cuts, edges, edges[1:])]


_SPAN = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def label(model: Model, texts: list[bytes]) -> tuple[list[str], list[float], list[list[dict]]]:
    """Language, its share of the letters, and spans of each text."""
    langs, shares, spans = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    starts, words, index = _words_of(texts)
    if not words or not model.languages:
        return langs, shares, spans
    k = len(model.languages)
    scores = _scores(model, words)[index]
    letters = np.array([len(w) for w in words])[index]
    total = np.concatenate((np.zeros((1, k)), np.cumsum(scores, 0)))
    main = (total[starts[1:]] - total[starts[:-1]]).argmax(1)
    paths = _paths(scores, total, main, starts)
    for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        if a == b:
            continue
        text = texts[i].decode()
        if i in paths:
            by_lang = np.bincount(paths[i], letters[a:b], k)
            langs[i], shares[i] = model.languages[by_lang.argmax()], float(by_lang.max() / by_lang.sum())
            spans[i] = _spans(text, model, paths[i])
        else:
            langs[i], shares[i] = model.languages[main[i]], 1.0
            spans[i] = [{"lang": langs[i], "start": 0, "end": len(text)}]
    return langs, shares, spans


def _label(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, ends in text_slices(batches):
            langs, shares, spans = label(shared.value, rows_of(data, ends))
            yield widened(part, {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(shares, pa.float64()),
                                 "spans": pa.array(spans, _SPAN)})
    return run


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, spans (lang, start, end in code points): one row per input row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    new = "lang_pred string, score double, spans array<struct<lang: string, start: int, end: int>>"
    return map_text(df, _label(shared), {"doc_id": df["doc_id"]}, text, new)
