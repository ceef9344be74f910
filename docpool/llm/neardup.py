"""Near-duplicate rows: ProbMinHash signatures, banding, and exact verification."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpool.functions.ranks import spread_join
from docpool.functions.storage import materialize
from docpool.llm._text import folded, slices

#: 40 bands of 6 registers: of pairs with similarity 0.7, 0.7 % share no band; with 0.8, one in 190,000.
BANDS, BAND = 40, 6
REGISTERS = BANDS * BAND
#: Registers of which one bit each goes into the sketch that is compared before texts are.
SKETCH = 128
#: Rows of a bucket that are compared in one task; larger buckets are cut into tiles.
TILE = 256
#: Pairs of copies that two classes are expanded into at once; beyond it their first rows stand for them, or blocks are paired.
EXPAND = 4096

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all substrings of `size` characters of each text, one after the other, and the texts' numbers of them."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    lengths = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(lengths - size + 1, 0)
    codes = mix(codes + _U(0x9E3779B97F4A7C15))
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, _U), counts
    h = np.zeros(n, _U)
    for j in range(size):
        h = h * _U(0xD6E8FEB86659FD93) + codes[j : j + n]
    starts = np.cumsum(lengths) - lengths
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return mix(h[at]), counts


def prob_min_hash(hashes: np.ndarray, counts: np.ndarray, registers: int = REGISTERS, weights: np.ndarray | None = None) -> np.ndarray:
    """ProbMinHash signatures, a row for each set: registers agree with the sets' probability Jaccard similarity.

    Every element sends a Poisson process of arrivals, at the rate of its weight, to registers drawn at random;
    both depend on the element alone. A register keeps the element that arrives first. An element ends when its
    next arrival comes later than the latest register of its set, so the work hardly depends on the number
    of registers. With equal weights the similarity is Jaccard's; repeated elements of a set change nothing
    then. A set without elements has a signature of zeros.
    """
    sets = len(counts)
    out = np.full(sets * registers, np.inf)
    winner = np.zeros(sets * registers, _U)
    owner = np.repeat(np.arange(sets), counts)
    element, time, rate = hashes, np.zeros(len(hashes)), weights
    round_ = 0
    while len(element):
        round_ += 1
        draw = mix(element + _U((round_ * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        step = -np.log(((draw >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)
        time = time + (step if rate is None else step / rate)
        register = (mix(draw) >> _U(32)) * _U(registers) >> _U(32)
        place = owner * registers + register.astype(np.int64)
        np.minimum.at(out, place, time)
        first = out[place] == time
        winner[place[first]] = element[first]
        latest = out.reshape(sets, registers).max(1)
        on = time < latest[owner]
        element, time, owner = element[on], time[on], owner[on]
        rate = None if rate is None else rate[on]
    return winner.reshape(sets, registers)


def bands_and_sketch(signatures: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each signature the hashes of its bands, with the salt mixed in, and its sketch as two words."""
    bits = mix(signatures + _U(1))
    bands = np.zeros((len(bits), BANDS), _U)
    for i in range(BAND):
        bands = mix(bands * _U(0xD6E8FEB86659FD93) + bits[:, i::BAND])
    bands = mix(bands + salt[:, None] + np.arange(BANDS, dtype=_U) * _U(0x9E3779B97F4A7C15))
    ones = (bits[:, :SKETCH] & _U(1)) << (np.arange(SKETCH, dtype=_U) % _U(64))
    return bands.view(np.int64), np.stack([ones[:, :64].sum(1), ones[:, 64:].sum(1)], 1).astype(_U).view(np.int64)


def weighed(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of a text, sorted, and how often each occurs."""
    found, times = np.unique(hashes, return_counts=True)
    return found, times.astype(np.float64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weights: bool = False) -> float:
    """Jaccard similarity of two texts' hashes, or the probability Jaccard similarity of their frequencies.

    The latter is the sum over common elements i of 1 / sum_j max(x_j / x_i, y_j / y_i). The first of the two is the
    greater where x_j / y_j is no less than x_i / y_i, so sums along the order of these ratios give all terms.
    """
    (x, wx), (y, wy) = a, b
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not weights or not len(both):
        return len(both) / max(1, len(x) + len(y) - len(both))
    p, q = wx[i], wy[j]
    order = np.argsort(p / q, kind="stable")
    p, q = p[order], q[order]
    ratio = p / q
    only_x, only_y = wx.sum() - p.sum(), wy.sum() - q.sum()  # these have ratios beyond either end
    least = np.searchsorted(ratio, ratio, "left")
    above = only_x + (p.sum() - np.concatenate([[0], np.cumsum(p)]))[least]
    below = only_y + np.concatenate([[0], np.cumsum(q)])[least]
    return float((1 / (above / p + below / q)).sum())


def jaccard(a: str, b: str, size: int) -> float:
    """The Jaccard similarity of two texts' sets of substrings of `size` characters."""
    return similarity(*(weighed(shingles([t], size)[0]) for t in (a, b)))


def _signed(fold: Callable[[str], str], size: int, min_chars: int, exact: bool, weights: bool):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 1_000_000):
            ids, groups, texts, originals = [], [], [], []
            for i, g, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if t is not None and len(small := fold(t)) >= max(min_chars, size):
                    ids.append(i)
                    groups.append(g)
                    texts.append(small)
                    originals.append(t)
            if not ids:
                continue
            hashes, counts = shingles(texts, size)
            salt = np.array([0 if g is None else int.from_bytes(_digest(g), "little") for g in groups], _U)
            times = None
            if weights:  # an element once, at the rate of its frequency
                ends = np.cumsum(counts)
                parts = [weighed(hashes[e - n : e]) for e, n in zip(ends, counts, strict=True)]
                hashes, times, counts = np.concatenate([h for h, _ in parts]), np.concatenate([w for _, w in parts]), np.array([len(h) for h, _ in parts])
            bands, sketch = bands_and_sketch(prob_min_hash(hashes, counts, weights=times), salt)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([_digest(f"{'' if g is None else 'g' + g}\0{t}", 16) for g, t in zip(groups, originals if exact else texts, strict=True)], pa.binary()), pa.array(groups, pa.string()),
                 pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), BANDS).cast(pa.list_(pa.int64())),
                 pa.array(sketch[:, 0]), pa.array(sketch[:, 1])],
                names=["id", "content", "grp", "bands", "s1", "s2"],
            )

    return sign


def _digest(text: str, size: int = 8) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=size).digest()


def _verified(fold: Callable[[str], str], size: int, weights: bool):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(slices(iter([batch]), 2), 3):
                a, b, x, y = (part.column(k).to_pylist() for k in range(4))
                texts = dict(zip(a + b, x + y, strict=True))  # a text is hashed once for all its pairs in the batch
                hashes, counts = shingles([fold(t) for t in texts.values()], size)
                ends = np.cumsum(counts)
                known = {i: weighed(hashes[e - n : e]) for i, e, n in zip(texts, ends, counts, strict=True)}
                scores = [similarity(known[i], known[j], weights) for i, j in zip(a, b, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(scores, pa.float64())], names=["rep_a", "rep_b", "similarity"])

    return verify


def bucket_pairs(members: DataFrame, tile: int = TILE, least: int = 0) -> DataFrame:
    """Distinct pairs id_a < id_b of `members` (bucket, id, s1, s2) that share a bucket and `least` or more of 128 sketch bits.

    Buckets of more than `tile` rows are cut into blocks, and each pair of blocks is a tile of its own, so no
    task gets more than two blocks at once whatever the bucket's size.
    """
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile)
    sizes = sizes.select(F.col("bucket").alias("hot"), F.ceil(F.col("n") / tile).cast("int").alias("blocks"))
    spread = members.join(sizes, F.col("bucket") == F.col("hot"), "left")
    spread = spread.withColumn("block", F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("id"), F.col("blocks"))).otherwise(0).cast("int"))
    # a block meets every block once, itself included
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
    spread = spread.select("bucket", F.least("block", "other").alias("t1"), F.greatest("block", "other").alias("t2"), F.struct("id", "s1", "s2").alias("m"))
    lists = spread.groupBy("bucket", "t1", "t2").agg(F.collect_list("m").alias("l")).where(F.size("l") > 1)
    first = lists.select("l", F.explode("l").alias("a"))
    alike = F.bit_count(F.expr("a.s1 ^ b.s1")) + F.bit_count(F.expr("a.s2 ^ b.s2")) <= SKETCH - least
    both = first.select("a", F.explode("l").alias("b")).where((F.col("a.id") < F.col("b.id")) & alike)
    return both.select(F.col("a.id").alias("rep_a"), F.col("b.id").alias("rep_b")).distinct()


def near_duplicates(
    rows: DataFrame,
    row_id: str,
    text: str,
    *,
    group: str | None = None,
    fold: Callable[[str], str] = folded,
    size: int = 5,
    threshold: float = 0.7,
    min_chars: int = 200,
    exact: bool = False,
    weights: bool = False,
    tile: int = TILE,
) -> tuple[DataFrame, DataFrame]:
    """(classes, links): rows whose folded texts share `threshold` or more of their distinct substrings of `size` characters.

    classes (id, grp, rep): every compared row with the first row of its class, which are the rows of one group
    whose folded texts are equal, or with `exact`, whose texts are. links (rep_a, rep_b, similarity): all pairs of classes of the same group
    that are similar, by their first rows. Links are found by banding (see BANDS for the loss) and verified
    exactly. Ids must be distinct; of repeated ids one row counts.

    With `weights`, a substring weighs as much as it occurs in the text, and the similarity is that of ProbMinHash,
    the probability Jaccard similarity of the frequencies, in the signatures and in the verification.

    Null texts and texts with fewer than min_chars or `size` characters after folding are not compared. Rows
    with a null group form one group. No rows give two empty tables.

    Copies are merged before the banding, with partial aggregation, so a hot group of copies is one row in it;
    a bucket of many different texts is cut into tiles. Texts move only for rows that have a candidate.
    """
    read = rows.select(F.col(row_id).cast("long").alias("id"), (F.col(group) if group else F.lit(None)).cast("string").alias("grp"), F.col(text).alias("text"))
    signed = materialize(read.mapInArrow(_signed(fold, size, min_chars, exact, weights), "id long, content binary, grp string, bands array<long>, s1 long, s2 long"), "signatures")
    found = signed.groupBy("content").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("s1").alias("s1"), F.first("s2").alias("s2"))
    members = found.select(F.explode("bands").alias("bucket"), F.col("rep").alias("id"), "s1", "s2")
    # of 128 bits a pair at the threshold shares (1 + threshold) / 2; four standard deviations less are let pass
    p = (1 + threshold) / 2
    pairs = materialize(bucket_pairs(members, tile, int(SKETCH * p - 4 * (SKETCH * p * (1 - p)) ** 0.5)), "pairs")
    ids = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("id")).distinct()
    texts = materialize(read.select("id", "text").join(ids, "id", "left_semi").dropDuplicates(["id"]), "texts")
    joined = pairs.join(texts.select(F.col("id").alias("rep_a"), F.col("text").alias("x")), "rep_a").join(texts.select(F.col("id").alias("rep_b"), F.col("text").alias("y")), "rep_b")
    links = joined.select("rep_a", "rep_b", "x", "y").mapInArrow(_verified(fold, size, weights), "rep_a long, rep_b long, similarity double")
    classes = spread_join(signed.select("id", "grp", "content"), found.select("content", "rep"), "content", "id").select("id", "grp", "rep").dropDuplicates(["id"])
    return classes, links.where(F.col("similarity") >= threshold)


def _block_pairs(classes: DataFrame, linked: DataFrame, block: int, salts: int = 16) -> DataFrame:
    """(x, y): all pairs of rows of two linked classes (rep_a, rep_b, na, nb), by blocks of about `block` rows of a class."""
    linked = linked.select("rep_a", "rep_b", *[F.ceil(F.col(n) / block).cast("int").alias(p) for n, p in (("na", "parts_a"), ("nb", "parts_b"))])
    ends = linked.select(F.explode(F.array(F.struct(F.col("rep_a").alias("rep"), F.col("parts_a").alias("parts")), F.struct(F.col("rep_b").alias("rep"), F.col("parts_b").alias("parts")))).alias("e")).select("e.*").distinct()
    ends = ends.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = classes.select("rep", "id", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt")).join(ends, ["rep", "salt"])
    blocks = rows.groupBy("rep", F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.col("parts")).cast("int").alias("part")).agg(F.collect_list("id").alias("ids"))
    tiles = linked.withColumn("part_a", F.explode(F.sequence(F.lit(0), F.col("parts_a") - 1))).withColumn("part_b", F.explode(F.sequence(F.lit(0), F.col("parts_b") - 1)))
    for side in "ab":
        tiles = tiles.join(blocks.select(F.col("rep").alias(f"rep_{side}"), F.col("part").alias(f"part_{side}"), F.col("ids").alias(f"ids_{side}")), [f"rep_{side}", f"part_{side}"])
    tiles = tiles.repartition("rep_a", "rep_b", "part_a", "part_b")
    return tiles.select(F.explode("ids_a").alias("x"), "ids_b").select("x", F.explode("ids_b").alias("y"))


def expanded(classes: DataFrame, links: DataFrame, *, copies: bool = True, limit: int = EXPAND) -> DataFrame:
    """Distinct pairs id_a < id_b of rows: those of linked classes and, with `copies`, those of a class.

    Classes are expanded into all pairs of their rows up to `limit` pairs; beyond that a class gives each row
    with its first one, and a link its first rows only, which together still hold every link and membership.
    Without `copies` no pair would hold the membership, so links are expanded into all pairs whatever their
    number: both classes are cut into blocks, and each two blocks, about `limit` pairs, are a row of their own.
    """
    classes, links = materialize(classes, "classes"), materialize(links.select("rep_a", "rep_b"), "links")
    sizes = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    within = sizes.where(F.col("n") > 1).select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b"), F.col("n").alias("na"), F.col("n").alias("nb"))
    across = links.select("rep_a", "rep_b").join(sizes.select(F.col("rep").alias("rep_a"), F.col("n").alias("na")), "rep_a").join(sizes.select(F.col("rep").alias("rep_b"), F.col("n").alias("nb")), "rep_b")
    both = within.unionByName(across) if copies else across
    small = both.where(F.col("na") * F.col("nb") <= limit)
    a, b = classes.select(F.col("rep").alias("rep_a"), F.col("id").alias("x")), classes.select(F.col("rep").alias("rep_b"), F.col("id").alias("y"))
    pairs = small.join(a, "rep_a").join(b, "rep_b").select("x", "y")
    large = both.where(F.col("na") * F.col("nb") > limit)
    if not copies:
        pairs = pairs.unionByName(_block_pairs(classes, large, max(1, math.isqrt(limit))))
        return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
    star = spread_join(a, large.where(F.col("rep_a") == F.col("rep_b")), "rep_a", "x").select(F.col("rep_a").alias("x"), F.col("x").alias("y"))
    firsts = large.where(F.col("rep_a") != F.col("rep_b")).select(F.col("rep_a").alias("x"), F.col("rep_b").alias("y"))
    return pairs.unionByName(star).unionByName(firsts).where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
