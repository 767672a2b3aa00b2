"""Hard-negative mining: exact integer scores by Strassen multiplication, kept in mergeable heaps.

Vectors are quantised to integers, packed into blocks of bounded size (rows dealt by hash) and
multiplied tile by tile, one anchor block with one candidate block per task group. A tile's scores
come from Strassen's recursion on int64 matrices: odd sides get a row or column of zeros, sums and
differences are exact, and a leaf multiplies in doubles only where every partial sum is an integer
below 2 ** 53. Each tile keeps bounded heaps, and heaps of tiles merge by taking the best again:
first of the positives, then, when an anchor's positives are known over all rows, of the negatives
in each positive's window of scores.

The anchors are a stated share of the rows, so the work is anchors x rows by definition; what one
task holds is two blocks, whatever the input.

Defined results: rows with a null label, vector or component, or a component that is not finite, take
no part; neither do rows without id, nor rows whose score with themselves is beyond MOST (scores
of others then fit too); rows equal in id, label and vector count once; rows that share only an id are
rows of their own; vectors of different lengths are filled with zeros; equal scores go by id; an
anchor without positives, and a positive without negatives, returns nothing; an empty table gives an
empty one; further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetshape.llm.frames import stored

#: Positives of an anchor, and negatives of a positive.
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of its positive's.
LOWEST, HIGHEST = 50, 95
SCALE = 256
#: Largest score of a row with itself.
MOST = float(1 << 50)
#: Rows of a candidate and of an anchor block, about, and candidates of one multiplication.
CANDIDATE_BLOCK, ANCHOR_BLOCK, STEP = 8192, 2048, 1024
#: Side of a matrix that is not cut further.
LEAF = 32
_EXACT = 1 << 53
_NONE = np.iinfo(np.int64).min


def _multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact product of small int64 matrices."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _even(a: np.ndarray) -> np.ndarray:
    return np.pad(a, ((0, a.shape[0] % 2), (0, a.shape[1] % 2)))


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Product of int64 matrices with seven products of halves. Right modulo 2 ** 64, so exact where the result fits."""
    n, m = a.shape[0], b.shape[1]
    if min(n, a.shape[1], m) <= leaf:
        return _multiply(a, b)
    a, b = _even(a), _even(b)
    i, k, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    b11, b12, b21, b22 = b[:k, :j], b[:k, j:], b[k:, :j], b[k:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * j), np.int64)
    out[:i, :j] = p1 + p4 - p5 + p7
    out[:i, j:] = p3 + p5
    out[i:, :j] = p2 + p4
    out[i:, j:] = p1 - p2 + p3 + p6
    return out[:n, :m]


class Heaps:
    """The best `size` (score, id) of each of n owners: highest scores, then smallest ids. Merging heaps is offering one's entries to the other."""

    def __init__(self, n: int, size: int):
        self.size = size
        self.score = np.full((n, size), _NONE, np.int64)
        self.id = np.zeros((n, size), np.int64)

    def offer(self, owner: np.ndarray, score: np.ndarray, who: np.ndarray) -> None:
        """Entries in any order; owners repeat."""
        if not len(owner):
            return
        touched = np.unique(owner)
        held = self.score[touched].ravel()
        full = held != _NONE
        owner = np.concatenate((owner, np.repeat(touched, self.size)[full]))
        score = np.concatenate((score, held[full]))
        who = np.concatenate((who, self.id[touched].ravel()[full]))
        order = np.lexsort((who, -score, owner))
        owner, score, who = owner[order], score[order], who[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner, "left")
        kept = place < self.size
        self.score[touched] = _NONE
        self.score[owner[kept], place[kept]] = score[kept]
        self.id[owner[kept], place[kept]] = who[kept]

    def offer_rows(self, scores: np.ndarray, allowed: np.ndarray, who: np.ndarray) -> None:
        """A matrix of scores, owners by candidates in the order of their ids; only `allowed` ones count."""
        allowed &= scores >= self.score[:, -1:]
        owner, at = np.nonzero(allowed)
        many = np.bincount(owner, minlength=len(scores)) > 4 * self.size
        if many.any():
            # Where much is allowed only what reaches the row's own best is sorted; ties stay in.
            best = np.where(allowed[many], scores[many], _NONE)
            least = np.partition(best, best.shape[1] - self.size, 1)[:, best.shape[1] - self.size]
            allowed[many] &= scores[many] >= least[:, None]
            owner, at = np.nonzero(allowed)
            # Of a row's ties the first ids are enough.
            first = np.lexsort((at, -scores[owner, at], owner))
            owner, at = owner[first], at[first]
            place = np.arange(len(owner)) - np.searchsorted(owner, owner, "left")
            owner, at = owner[place < self.size], at[place < self.size]
        self.offer(owner, scores[owner, at], who[at])

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        owner, place = np.nonzero(self.score != _NONE)
        return owner, self.score[owner, place], self.id[owner, place]


def _hundredths() -> Column:
    return F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))


def prepare(df: DataFrame) -> DataFrame:
    """vec_id, label (as mining sees it), v (quantised), mark (hash of label and vector): each row that takes part, once."""
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.pow(F.floor(x.cast("double") * SCALE).cast("double"), F.lit(2.0)))
    fits = df.where(usable).where(squares <= MOST)
    rows = fits.select("vec_id", shifted.cast("long").alias("label"), _hundredths().alias("v")).distinct()
    return rows.withColumn("mark", F.xxhash64("label", "v"))


_BLOCK = "part int, dim int, vec_id binary, label binary, mark binary, v binary, positive binary, reach binary"


def _packed(table: pa.Table) -> pa.Table:
    """The rows of one block as one row of binary columns, in the order of ids."""
    table = table.sort_by([("vec_id", "ascending"), ("mark", "ascending")])
    lists = table.column("v").combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    dim = int(size.max(initial=0))
    v = np.zeros((len(size), dim), np.int32)
    v[np.arange(dim) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    column = lambda name: table.column(name).to_numpy().astype(np.int64).tobytes()
    more = {"positive": None, "reach": None}
    if "reach" in table.column_names:
        for name in more:
            listed = table.column(name).combine_chunks()
            many = listed.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            slots = np.full((len(many), POSITIVES), _NONE, np.int64)
            slots[np.arange(POSITIVES) < many[:, None]] = listed.flatten().to_numpy(zero_copy_only=False)
            more[name] = slots.tobytes()
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "dim": pa.array([dim], pa.int32()),
                     **{k: pa.array([column(k)], pa.binary()) for k in ("vec_id", "label", "mark")}, "v": pa.array([v.tobytes()], pa.binary()),
                     **{k: pa.array([x], pa.binary()) for k, x in more.items()}})


def blocks(rows: DataFrame, parts: int) -> DataFrame:
    """One row per block: rows dealt by hash, which is even as no row repeats."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("vec_id", "mark"), F.lit(parts)).cast("int"))
    return dealt.groupBy("part").applyInArrow(_packed, _BLOCK)


class _Side:
    """A block unpacked."""

    def __init__(self, table: pa.Table, at: int):
        get = lambda name: np.frombuffer(table.column(name)[at].as_py() or b"", np.int64)
        self.id, self.label, self.mark = get("vec_id"), get("label"), get("mark")
        dim = table.column("dim")[at].as_py()
        self.v = np.frombuffer(table.column("v")[at].as_py(), np.int32).reshape(len(self.id), dim).astype(np.int64)
        self.positive, self.reach = (get(x).reshape(-1, POSITIVES) for x in ("positive", "reach"))


def _tiles(anchors: pa.Table, candidates: pa.Table) -> Iterator[tuple[_Side, _Side, slice, np.ndarray]]:
    """Scores of one anchor block with the candidates, STEP at a time."""
    for i in range(anchors.num_rows):
        a = _Side(anchors, i)
        for j in range(candidates.num_rows):
            c = _Side(candidates, j)
            dim = max(a.v.shape[1], c.v.shape[1])
            left, right = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (a.v, c.v))
            for s in range(0, len(c.id), STEP):
                piece = slice(s, s + STEP)
                yield a, c, piece, strassen(left, np.ascontiguousarray(right[piece].T))


def _positives(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
    heaps, a = None, None
    for a, c, piece, scores in _tiles(anchors, candidates):
        heaps = heaps or Heaps(len(a.id), POSITIVES)
        itself = (a.id[:, None] == c.id[piece]) & (a.mark[:, None] == c.mark[piece])
        heaps.offer_rows(scores, (a.label[:, None] == c.label[piece]) & ~itself, c.id[piece])
    owner, score, who = heaps.entries() if heaps else (np.zeros(0, np.int64),) * 3
    own = (lambda x: x[owner]) if heaps else (lambda x: owner)
    return pa.table({"vec_id": own(a.id if a else owner), "mark": own(a.mark if a else owner), "score": score, "who": who})


def _negatives(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
    heaps, a = None, None
    for a, c, piece, scores in _tiles(anchors, candidates):
        heaps = heaps or [Heaps(len(a.id), NEGATIVES) for _ in range(POSITIVES)]
        other = a.label[:, None] != c.label[piece]
        for slot, heap in enumerate(heaps):
            of = a.reach[:, slot]
            known = of != _NONE
            low = np.where(known, -(-LOWEST * of // 100), 1)
            high = np.where(known, HIGHEST * of // 100, 0)
            heap.offer_rows(scores, other & (scores >= low[:, None]) & (scores <= high[:, None]), c.id[piece])
    names = ("vec_id", "mark", "slot", "positive_id", "positive_score", "score", "who")
    found = [[np.zeros(0, np.int64)] * len(names)]
    for slot, heap in enumerate(heaps or ()):
        owner, score, who = heap.entries()
        found.append([a.id[owner], a.mark[owner], np.full(len(owner), slot), a.positive[owner, slot], a.reach[owner, slot], score, who])
    return pa.table({n: np.concatenate(x) for n, x in zip(names, zip(*found))})


def _over_tiles(anchors: DataFrame, n_anchor: int, candidates: DataFrame, n_candidate: int, fn, schema: str) -> DataFrame:
    """`fn` on every pair of an anchor and a candidate block."""
    left = anchors.withColumns({"a": F.col("part"), "c": F.explode(F.sequence(F.lit(0), F.lit(n_candidate - 1)))})
    right = candidates.withColumns({"c": F.col("part"), "a": F.explode(F.sequence(F.lit(0), F.lit(n_anchor - 1)))})
    return left.groupBy("a", "c").cogroup(right.groupBy("a", "c")).applyInArrow(fn, schema)


def _merged(found: DataFrame, owner: tuple[str, ...], size: int) -> DataFrame:
    """The heaps of all tiles as one per owner, with the entry's place."""
    order = W.partitionBy(*owner).orderBy(F.col("score").desc(), "who")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)


def mine(df: DataFrame, is_anchor: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of `df` (vec_id, embedding, label)
    that `is_anchor` (over vec_id) marks."""
    rows = stored(prepare(df), "vectors")
    n, n_anchors = rows.agg(F.count(F.lit(1)), F.count(F.when(is_anchor, 1))).first()
    anchors, parts, groups = rows.where(is_anchor), -(-n // CANDIDATE_BLOCK) or 1, -(-n_anchors // ANCHOR_BLOCK) or 1
    candidates = stored(blocks(rows, parts), "blocks")

    near = _over_tiles(blocks(anchors, groups), groups, candidates, parts, _positives, "vec_id long, mark long, score long, who long")
    best = _merged(near, ("vec_id", "mark"), POSITIVES).groupBy("vec_id", "mark").agg(
        F.sort_array(F.collect_list(F.struct("place", "who", "score"))).alias("p"))  # POSITIVES at most
    reached = anchors.join(best, ["vec_id", "mark"]).select(
        "vec_id", "label", "mark", "v", F.col("p.who").alias("positive"), F.col("p.score").alias("reach"))
    wanted = stored(blocks(reached, groups), "anchors")

    schema = "vec_id long, mark long, slot long, positive_id long, positive_score long, score long, who long"
    found = _over_tiles(wanted, groups, candidates, parts, _negatives, schema)
    # Rows that share an id and a score cannot be told apart in the result; the slot keeps their lists separate.
    kept = _merged(found, ("vec_id", "mark", "slot"), NEGATIVES)
    return kept.select(F.col("vec_id").alias("anchor_id"), "positive_id", F.col("place").cast("int").alias("rank"),
                       F.col("who").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
