"""Near-duplicate texts by pivot distance tables.

Every text becomes a fingerprint, and the table holds its Hamming distances to many reference fingerprints (the pivots). The distance
of two texts is at least the largest difference of their coordinates, which discards pairs without touching the texts;
survivors are verified on all their words. A pivot table alone would have to look at every pair, so the pairs it is
asked about come from band keys (minima of hashed words): close texts share a band but for a probability of 0.002 at similarity
0.7 and less than 1e-6 from 0.8.

Within a band key not all pairs are formed. First each text is compared with the key's smallest text only; after the groups so found
are contracted, a second pass compares the texts outside a key's largest group with all texts of other groups of that key. Every pair of
a key whose texts are not in one group already is thus looked at, while a key that copies fill stays linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.functions.words import Hasher, MinHash, folded, occurrences, set_key, without_digits, words
from rolloom.operators.components import components
from rolloom.operators.sample import smallest
from rolloom.operators.skew import lookup, pairs_in_blocks
from rolloom.session import cut, release

BANDS, ROWS, PIVOTS = 72, 7, 25
#: Closeness as a fraction: shared words over all words.
SHARED, OF = 7, 10

#: A fingerprint has 8 words of 64 bits. Pivot distances are packed, five to a number in lanes of 12 bits, so that native expressions compare them at once; with more than six numbers the
#: generated code of a join would be too long for the JVM to compile.
LANES, BITS = 5, 12
PRINT, PACKED = [f"f{i}" for i in range(8)], [f"p{i}" for i in range(PIVOTS // LANES)]
_ONES = sum(1 << BITS * k for k in range(LANES))
_FLAGS = _ONES << (BITS - 1)
SKETCH = ["n", *PRINT, *PACKED]
_SCHEMA = "raw string, copies bigint, rec_id bigint, text_key bigint, mask_key bigint, n int, bands array<bigint>, " + ", ".join(f"{c} bigint" for c in PRINT + PACKED)


def pivot_prints(texts: DataFrame, count: int = PIVOTS) -> np.ndarray:
    """Fingerprints of `count` texts, those with the smallest hash: a bounded number of rows for the driver."""
    rows = smallest(texts.select("text").distinct(), F.xxhash64("text"), count, texts.count(), "text").collect()
    hasher = Hasher()
    prints = [folded(occurrences(hasher(w))) for w in (words(r[0]) for r in rows) if w]
    none = [np.zeros(8, dtype=np.int64)] * (count - len(prints))
    return np.stack(prints + none)


def describe(texts: DataFrame, pivots: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Keys, fingerprint, pivot distances and band keys of each text (raw, copies, rec_id, text). Texts without words are left out."""

    lanes = np.array([1 << BITS * k for k in range(LANES)], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, minhash = Hasher(), MinHash(bands, rows)
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
        names = [f.split()[0] for f in _SCHEMA.split(", ")]
        for batch in batches:
            out: list[list] = [[] for _ in types]
            prints: list[np.ndarray] = []
            for raw, copies, rec, text in zip(*(c.to_pylist() for c in batch.columns)):
                w = words(text)
                if not w:
                    continue
                h = hasher(w)
                tokens, still = occurrences(h), without_digits(h)
                mask = set_key(occurrences(still)) if len(still) else None
                prints.append(folded(tokens))
                for col, x in zip(out, (raw, copies, rec, set_key(tokens), mask, len(tokens), minhash(tokens))):
                    col.append(x)
            fp = np.array(prints, dtype=np.int64).reshape(len(prints), len(PRINT))
            far = np.stack([np.bitwise_count((fp ^ p).view(np.uint64)).sum(axis=1, dtype=np.int64) for p in pivots], axis=1)
            packed = far.reshape(len(fp), len(PACKED), LANES) @ lanes
            yield pa.RecordBatch.from_arrays([*(pa.array(c, type=t) for c, t in zip(out, types)), *(pa.array(np.ascontiguousarray(c)) for c in (*fp.T, *packed.T))], names=names)

    return texts.select("raw", "copies", "rec_id", "text").mapInArrow(run, _SCHEMA)


def sketch(table: DataFrame, side: str, *more: str | Column) -> DataFrame:
    """(rec_id as the side's name, the table's sketch with that name behind each column, more columns)."""
    return table.select(*more, F.col("rec_id").alias(side), *[F.col(c).alias(c + side) for c in SKETCH])


def may_be_close(a: str = "a", b: str = "b") -> Column:
    """Whether neither the numbers of words, nor any pivot coordinate, nor the fingerprints rule out that the two sides are close."""
    x, y = (lambda c: F.col(c + a)), (lambda c: F.col(c + b))
    most = F.floor((x("n") + y("n")) * (OF - SHARED) / F.lit(OF + SHARED)).cast("bigint")  # words apart, at most
    test = F.abs(x("n") - y("n")) <= most
    flags = F.lit(_FLAGS)
    # in each lane flag + most + x - y keeps its flag just where y - x is at most `most`; no distance exceeds 512
    room = flags + F.least(most, F.lit(512)) * F.lit(_ONES)
    for c in PACKED:
        test = test & ((room + x(c) - y(c)).bitwiseAND(room + y(c) - x(c)).bitwiseAND(flags) == flags)
    apart = sum((F.bit_count(x(c).bitwiseXOR(y(c))) for c in PRINT[1:]), F.bit_count(x(PRINT[0]).bitwiseXOR(y(PRINT[0]))))
    return test & (apart <= most)


def tokens_of(texts: DataFrame) -> DataFrame:
    """(rec_id, tokens): the hashed words of each text (rec_id, text), every occurrence a token of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            tokens = [occurrences(hasher(words(t))).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, type=pa.list_(pa.int64()))], names=["rec_id", "tokens"])

    return texts.select("rec_id", "text").mapInArrow(run, "rec_id bigint, tokens array<bigint>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of rec_ids of `texts` that are close by all their words. Only texts that stand in a pair are read into words."""
    pairs = cut(pairs, "pairs")
    named = pairs.select(F.explode(F.array("a", "b")).alias("rec_id")).distinct()
    table = cut(tokens_of(texts.join(named, "rec_id", "left_semi").dropDuplicates(["rec_id"])), "tokens")
    side = lambda s: table.select(F.col("rec_id").alias(s), F.col("tokens").alias(f"t{s}"))
    both = F.size(F.array_intersect("ta", "tb"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("both", both)
    found = cut(full.where(F.col("both") * OF >= SHARED * (F.size("ta") + F.size("tb") - F.col("both"))).select("a", "b"), "close")
    release(pairs, table)
    return found


def survivors(pairs: DataFrame, table: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those the pivot table, the fingerprints and at last the words don't rule out."""
    return verified(pairs.join(sketch(table, "a"), "a").join(sketch(table, "b"), "b").where(may_be_close()).select("a", "b"), texts)


def _groups_of(reps: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp) for each representative; one without links is a group of its own."""
    return reps.select(F.col("rec_id").alias("node")).join(components(links, "a", "b"), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def near_groups(texts: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(rec_id, group_id) for each text (rec_id, text) that has words; group_id is the smallest rec_id of its group.

    Texts are close when the words they share are at least 0.7 of all words of both, or when they differ only in words with
    digits (and have others). Repeated rec_ids must be equal rows; null, empty and wordless texts are in no group. Of the tables written on the way,
    each is removed when its successors are written.
    """
    texts = texts.select("rec_id", "text").where("text is not null")
    raw = texts.groupBy(F.md5("text").alias("raw")).agg(F.min(F.struct("rec_id", "text")).alias("r"), F.count(F.lit(1)).alias("copies"))
    table = cut(describe(raw.select("raw", "copies", "r.*"), pivot_prints(texts), bands, rows), "pivots")
    # one representative for each word multiset
    keys = cut(table.groupBy("text_key").agg(F.min("rec_id").alias("rep"), F.min("mask_key").alias("mask_key"), F.count(F.lit(1)).alias("n_same")), "keys")
    reps = cut(table.drop("raw", "copies", "text_key", "mask_key").join(keys.select(F.col("rep").alias("rec_id")), "rec_id", "left_semi"), "reps")
    members = cut(table.select("raw", "copies", "text_key"), "members")
    release(table)
    masks = keys.where("mask_key is not null").groupBy("mask_key").agg(F.min("rep").alias("b"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    same_mask = lookup(keys.select("mask_key", F.col("rep").alias("a")), "mask_key", masks, "_n").where("a <> b").select("a", "b")

    banded = reps.select(F.col("rec_id").alias("rep"), F.explode("bands").alias("band"))
    hubs = cut(banded.groupBy("band").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("_n")).where("_n > 1"), "hubs")
    held = cut(lookup(banded, "band", hubs, "_n"), "banded")
    links = cut(survivors(held.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct(), reps, texts).unionByName(same_mask), "links")
    comp = cut(_groups_of(reps, links), "comp")

    placed = cut(held.select("band", "rep").join(comp.withColumnRenamed("node", "rep"), "rep"), "placed")
    release(held, hubs)
    largest = placed.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("_c")).groupBy("band").agg(F.max_by("comp", F.struct("_c", "comp")).alias("main"), F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_g")).where("_g > 1").drop("_g")
    # the pairs of a key are many: rows come with their sketches, and pairs ruled out are never written
    several = cut(lookup(placed, "band", cut(largest, "largest"), "_n").withColumnRenamed("rep", "rec_id").join(reps.select("rec_id", *SKETCH), "rec_id"), "several")
    release(placed)
    left = sketch(several.where("comp <> main"), "a", "band", F.col("comp").alias("ca"))
    right = sketch(several, "b", "band", F.col("comp").alias("cb"), F.col("main").alias("mb"))
    across = pairs_in_blocks(left, right, "band").where("ca <> cb and (cb = mb or a < b)").where(may_be_close()).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    more = verified(across, texts)
    if more.head(1):
        comp = cut(_groups_of(reps, links.unionByName(more)), "comp")
    release(several, links, more, reps)
    # back from representatives to all texts
    of_key = cut(keys.select("text_key", F.col("rep").alias("node"), "n_same").join(comp, "node").select("text_key", F.col("comp").alias("group_id"), "n_same"), "of_key")
    of_raw = cut(lookup(members, "text_key", of_key, "n_same").select("raw", "group_id", "copies"), "of_raw")
    release(members, of_key, keys, comp)
    return lookup(texts.select("rec_id", F.md5("text").alias("raw")).distinct(), "raw", of_raw, "copies").select("rec_id", "group_id")


def pairs_of_groups(groups: DataFrame) -> DataFrame:
    """(id_a, id_b), smaller first: all pairs of records that share a group. Large groups are spread over blocks."""
    groups = cut(groups, "groups")
    left, right = groups.select("group_id", F.col("rec_id").alias("id_a")), groups.select("group_id", F.col("rec_id").alias("id_b"))
    return pairs_in_blocks(left, right, "group_id").where("id_a < id_b").select("id_a", "id_b")


def problem_texts(problems: DataFrame, generated: DataFrame) -> DataFrame:
    """(rec_id, text) of both problem tables; their ids never meet."""
    return problems.select(F.col("problem_id").alias("rec_id"), F.col("prompt").alias("text")).unionByName(generated.select(F.col("gen_id").alias("rec_id"), F.col("problem").alias("text")))
