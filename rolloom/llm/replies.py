"""Replies with the problem they answer, and how they end."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.functions.words import MIX
from rolloom.operators.skew import lookup
from rolloom.session import cut

#: A number of any size is one token, and so is a tuple of numbers or a list of named ones.
TOKEN = re.compile(r"[a-z]\s?=\s?-?\d+(?:\s?,\s?[a-z]\s?=\s?-?\d+)+|\(\d+(?:,\s?\d+)+\)|\d+(?:[.,/]\d+)*|[^\W\d_]+|[^\w\s]")
#: Stands in every text with a token that holds white space.
_SPACED = re.compile(r"=\s?-?\d+\s?,\s?[a-z]\s?=|\(\d+,\s?\d")
#: No token reaches over white space between two letters.
_PARTED = re.compile(r"[^\W\d_]\s+[^\W\d_]")
#: An ending is known when it closes at least this share of the replies, and at least LEAST of them.
SHARE, LEAST = 0.0005, 5
#: A length is a spike when it has at least SPIKE replies, and TIMES as many as lengths nearby lead to expect.
SPIKE, TIMES, NEAR = 8, 4.0, 25

_BARE = ["tbl", "rec_id", "link", "source", "problem", "answer", "text"]


@dataclass(frozen=True)
class Replies:
    """Replies (tbl, rec_id, link, source, problem, answer, text). Those of `linked` have their source and problem in `runs` (link, source, problem, and _n, the number of their rows) instead."""

    own: DataFrame
    linked: DataFrame | None = None
    runs: DataFrame | None = None

    @property
    def bare(self) -> DataFrame:
        """All replies as they stand in their tables, without a join: source and problem of linked ones are null."""
        return self.own.select(_BARE) if self.linked is None else self.linked.select(_BARE).unionByName(self.own.select(_BARE))

    def joined(self, wanted: DataFrame | None = None) -> DataFrame:
        """The replies with source and problem, or only those whose (tbl, rec_id) is in `wanted`. A reply of an unknown run has neither."""
        pick = lambda rows: rows if wanted is None else rows.join(wanted.select("tbl", "rec_id"), ["tbl", "rec_id"], "left_semi")
        own = pick(self.own.select(_BARE))
        if self.linked is None:
            return own
        return lookup(pick(self.linked).drop("source", "problem"), "link", self.runs, "_n", "left").select(_BARE).unionByName(own)

    def with_source(self, rows: DataFrame) -> DataFrame:
        """Small rows with `link` and `source`, the latter filled in from the runs."""
        if self.linked is None:
            return rows
        named = lookup(rows.withColumnRenamed("source", "_own"), "link", self.runs.select("link", F.col("source").alias("_runs"), "_n"), "_n", "left")
        return named.withColumn("source", F.coalesce("_own", "_runs")).drop("_own", "_runs")


def of(replies: DataFrame | Replies) -> Replies:
    """A table (tbl, rec_id, source, problem, answer, text) as replies."""
    return replies if isinstance(replies, Replies) else Replies(replies.withColumn("link", F.lit(None).cast("bigint")))


def all_replies(results: DataFrame, runs: DataFrame, samples: DataFrame) -> Replies:
    """The replies of `results` with the model of their run as source, and those of `samples`, whose response is their answer too. Of several rows of a run the first by model and problem counts."""
    null = F.lit(None).cast("string")
    linked = results.select(F.lit("results").alias("tbl"), F.col("result_id").alias("rec_id"), F.col("run_id").alias("link"), null.alias("source"), null.alias("problem"), "answer", F.col("reasoning").alias("text"))
    once = runs.where("run_id is not null").groupBy("run_id").agg(F.min(F.struct("model", "problem")).alias("r")).select(F.col("run_id").alias("link"), F.col("r.model").alias("source"), "r.problem")
    counts = results.where("run_id is not null").groupBy(F.col("run_id").alias("link")).agg(F.count(F.lit(1)).alias("_n"))
    own = samples.select(F.lit("samples").alias("tbl"), F.col("sample_id").alias("rec_id"), F.lit(None).cast("bigint").alias("link"), "source", F.col("prompt").alias("problem"), F.col("response").alias("answer"), F.col("response").alias("text"))
    return Replies(own, linked, counts.join(once, "link", "left"))


def _is_number(token: str) -> bool:
    return token[0].isdigit() or token[-1].isdigit() or len(token) > 2 and token[0] == "("


class _Numbers(dict):
    """Token to number; a new token gets the next one, numbers share one."""

    def __init__(self, hashes: list[int]) -> None:
        super().__init__()
        self.hashes = hashes

    def __missing__(self, token: str) -> int:
        if _is_number(token):
            return self["#"]
        n = self[token] = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(token))
        return n


class _Pieces(dict):
    """A piece of text without white space to its tokens' numbers."""

    def __init__(self, numbers: _Numbers) -> None:
        super().__init__()
        self.of = numbers.__getitem__

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = tuple(map(self.of, TOKEN.findall(piece)))
        if len(piece) <= 40:
            self[piece] = found
        return found


class Reader:
    """Token hashes of many texts in one array. Every number has the same hash.

    Texts are read by their pieces between white space, whose tokens are kept, up to `most` of them; a text with a token that holds white space is read as a whole.
    """

    def __init__(self, most: int = 1 << 17, texts: int = 4000) -> None:
        self.most, self.texts = most, texts
        self.kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}  # hashes, which stay right when the numbers begin anew
        self.fresh()

    def fresh(self) -> None:
        self.hashes: list[int] = []
        self.number = _Numbers(self.hashes)
        self.pieces = _Pieces(self.number)
        self.known = np.zeros(0, dtype=np.uint64)

    def table(self) -> np.ndarray:
        """Hash of each token number."""
        if len(self.known) < len(self.hashes):
            self.known = np.concatenate([self.known, np.array(self.hashes[len(self.known) :], dtype=np.uint64)])
        return self.known

    def numbers(self, text: str) -> list[int]:
        """Token numbers of a text."""
        t = text.lower()
        if _SPACED.search(t):
            return list(map(self.number.__getitem__, TOKEN.findall(t)))
        return list(chain.from_iterable(map(self.pieces.__getitem__, t.split())))

    def read(self, texts: list[str | None], numbers=None) -> tuple[np.ndarray, np.ndarray]:
        """Token hashes of all texts, and where each text's begin (one more entry than texts). `numbers` gives the token numbers of a text, if not all are wanted."""
        if len(self.pieces) > self.most or len(self.number) > self.most:
            self.fresh()
        numbers = numbers or self.numbers
        many: list[int] = []
        at = [0]
        for t in texts:
            if t:
                many += numbers(t)
            at.append(len(many))
        return self.table()[np.array(many, dtype=np.int32)], np.array(at, dtype=np.int64)

    def last(self, text: str, n: int = 3, length: int = 160) -> list[int]:
        """The last token numbers of a text, `n` at least if it has so many. They are those of the whole text: reading begins between two letters parted by white space, over which no token reaches."""
        if len(text) > length:
            found = _PARTED.search(text, len(text) - length)
            some = self.numbers(text[found.end() - 1 :]) if found else ()
            if len(some) >= n:
                return some
        return self.numbers(text)

    def read_again(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its token hashes and its runs of four, without repeats; those of some thousand texts are kept, since many are read again."""
        fresh = [t for t in dict.fromkeys(texts) if t and t not in self.kept]
        if len(self.kept) + len(fresh) > self.texts:
            self.kept, fresh = {}, [t for t in dict.fromkeys(texts) if t]
        h, at = self.read(fresh)
        with np.errstate(over="ignore"):
            g = grams(h, 4)
        for t, a, b in zip(fresh, at[:-1], at[1:]):
            self.kept[t] = h[a:b].copy(), g[a + 3 : b].copy()
        none = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64))
        return [self.kept[t] if t else none for t in texts]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n tokens that end at each position; the first n - 1 positions hold nothing of use."""
    out = h.copy()
    for k in range(1, n):
        out[k:] = out[k:] * MIX + h[: len(h) - k] * np.uint64(2 * k + 1)
        out[:k] = out[:k] * MIX
    return out


class Among:
    """Whether values are among given ones: a table of bits leaves out most of those that aren't, the rest is looked up."""

    def __init__(self, values: np.ndarray, bits: int = 18):
        self.values = np.sort(values)
        self.shift = np.uint64(64 - bits)
        self.flags = np.zeros(1 << bits, dtype=bool)
        self.flags[(self.values >> self.shift).astype(np.int64)] = True

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `x` of values that are among those given, and their places there."""
        if not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        may = np.flatnonzero(self.flags[(x >> self.shift).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.values, x[may]), len(self.values) - 1)
        hit = self.values[place] == x[may]
        return may[hit], place[hit]


_OPEN = re.compile(r"\.\.\.$|[…�]$")
#: At the end: a mark that closes a formula, block, bracket, emphasis or proof, or a number.
_CLOSING = re.compile(r"(?:[)\]}$»”\"∎■□◼\d]|```|\*\*)[*_.]*$")
_STOP = re.compile(r"[.!?。！？][\"'”’»)\]*_]*$")
_PRICE = re.compile(r"\$\d[\d.,]*(?=[\s;:!?)]|$)")
_DECIMAL = re.compile(r"(?<![\d.,])[-−]?0\.$|[,.]\d{0,2},$")


def ending_marks(text: str) -> tuple[bool, bool, bool]:
    """Of a text without white space at its end: cut mark at the end; full stop at the end (not of a decimal); a block or formula left open."""
    tail = text[-40:]
    broken = bool(_OPEN.search(tail))
    stop = not broken and bool(_STOP.search(tail)) and not _DECIMAL.search(tail)
    more = lambda a, b: text.count(a) > text.count(b)
    left = "$" in text and _open_dollar(text) or text.count("```") % 2 == 1 or "{" in text and more("{", "}") and not _one_sided(text) or "\\" in text and (more("\\[", "\\]") or more("\\(", "\\)"))
    return broken, stop, left


def _open_dollar(text: str) -> bool:
    """A formula in dollar signs left open: their number is odd, escaped ones aside, and no single price makes it so."""
    if text.count("$") % 2 == text.count("\\$") % 2:
        return False
    return not len(_PRICE.findall(text.replace("\\$", ""))) % 2


def _one_sided(text: str) -> bool:
    """Nothing but braces that \\right. closes is open."""
    return "\\right." in text and text.count("{") - text.count("\\{") <= text.count("}") - text.count("\\}")


def shared(a: np.ndarray, a_at: np.ndarray, others: list[np.ndarray], n: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """For each text: share of its runs of n tokens that stand among those of the other text beside it, and the reverse. 0 without runs.

    `others` has for each text the runs' hashes of the other (as of `grams`).
    """
    count = len(a_at) - 1
    size = np.array([len(o) for o in others], dtype=np.int64)
    if not len(a) or not size.sum():
        return np.zeros(count), np.zeros(count)
    salt = np.arange(count).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    owner = np.repeat(np.arange(count), np.diff(a_at))
    whole = (np.arange(len(a)) - a_at[:-1][owner] >= n - 1) & (size[owner] > 0)
    owner = owner[whole]
    ga = grams(a, n)[whole] ^ salt[owner]
    other = np.repeat(np.arange(count), size)
    gb = np.concatenate(others) ^ salt[other]

    def part(x: np.ndarray, of_x: np.ndarray, y: np.ndarray) -> np.ndarray:
        hit, _ = Among(y)(x)
        return np.bincount(of_x[hit], minlength=count) / np.maximum(np.bincount(of_x, minlength=count), 1)

    return part(ga, owner, gb), part(gb, other, ga)


def text_key(text: str | None) -> int | None:
    """64-bit key of a text, white space at its end aside."""
    return None if text is None else xxhash.xxh3_64_intdigest(text.rstrip().encode("utf-8", "replace")) - (1 << 63)


_SLIM = "tbl string, rec_id bigint, link bigint, source string, text_key bigint, chars int, bytes int, ending bigint, short_ending bigint, tokens int, broken boolean, stop boolean, left_open boolean, closing boolean"
#: Texts of one step of an Arrow function.
STEP = 1000


def last_tokens(reader: Reader, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the last three and of the last two tokens of each text, and how many of its last tokens are known (3 at most)."""
    h, at = reader.read(texts, lambda t: reader.last(t)[-3:])
    n = np.diff(at)
    end = np.maximum(at[1:] - 1, 0)
    with np.errstate(over="ignore"):
        pick = lambda k: np.where(n >= k, grams(h, k).view(np.int64)[end] if len(h) else 0, 0).astype(np.int64)
        return pick(3), pick(2), n.astype(np.int32)


def slim(replies: DataFrame) -> DataFrame:
    """One small row for each reply: lengths, hashes of its last three and two tokens and how many of them there are, marks of its ending (the last: whether a closing mark or a number stands there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        names = [f.split()[0] for f in _SLIM.split(", ")]
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                texts = [t and t.rstrip() for t in batch.column(4).to_pylist()]
                whole_texts = batch.column(4).to_pylist()
                ending, short, n = last_tokens(reader, texts)
                marks = [ending_marks(t) if t else (False, False, False) for t in texts]
                columns = [list(map(text_key, texts)), [None if t is None else len(t) for t in whole_texts], [None if t is None else len(t.encode("utf-8", "replace")) for t in whole_texts]]
                columns = [pa.array(c, type=k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns, *map(pa.array, (ending, short, n)), *(pa.array([m[j] for m in marks], type=pa.bool_()) for j in range(3)), pa.array([bool(t and _CLOSING.search(t[-20:])) for t in texts])], names=names)

    return replies.select("tbl", "rec_id", "link", "source", "text").mapInArrow(run, _SLIM)


def known_endings(texts: DataFrame, slims: DataFrame) -> dict[int, float]:
    """How likely a reply that stands at each known ending is complete: of all places where its tokens stand, the share at the end of a reply.

    A reply cut at a random place ends in tokens that mostly stand inside of replies; endings that writers choose seldom do. Endings are the last
    three tokens, or the last two. Known ones close at least SHARE of the replies, so there are at most 2 / SHARE of them. Each text counts once, at its end and
    inside, however many rows hold it: copies of a cut reply don't make its end a proper one.
    """
    once = slims.where("tokens >= 3").select("text_key", F.explode(F.array("ending", "short_ending")).alias("ending")).distinct()
    total = once.agg(F.count(F.lit(1)) / 2).scalar()
    ends = {r[0]: r[1] for r in once.groupBy("ending").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST).where(F.col("n") >= total * SHARE).select("ending", "n").collect()}
    if not ends:
        return {}
    wanted = np.sort(np.array(list(ends), dtype=np.int64).view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, among = Reader(), Among(wanted)
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                texts = list({text_key(t): t for t in whole.slice(at, STEP).column(0).to_pylist() if t}.items())
                h, starts = reader.read([t for _, t in texts])
                if not len(h):
                    continue
                inside = np.ones(len(h), dtype=bool)
                inside[starts[1:][np.diff(starts) > 0] - 1] = False
                owners, places = [], []
                for n in (2, 3):
                    head = starts[:-1] + n - 2  # here the n tokens would begin in the text before
                    inside[head[head < len(h)]] = False
                    with np.errstate(over="ignore"):
                        hit, place = among(grams(h, n))
                    kept = inside[hit]
                    owners.append(np.searchsorted(starts, hit[kept], side="right") - 1)
                    places.append(place[kept])
                owner, place = np.concatenate(owners), np.concatenate(places).astype(np.int16)
                order = np.lexsort((place, owner))
                bounds = np.searchsorted(owner[order], np.arange(len(texts) + 1))
                place = place[order]
                some = np.flatnonzero(np.diff(bounds))
                yield pa.RecordBatch.from_arrays([pa.array([texts[i][0] for i in some], type=pa.int64()), pa.array([place[bounds[i] : bounds[i + 1]].tobytes() for i in some], type=pa.binary())], names=["text_key", "places"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(wanted), dtype=np.int64)
        for batch in batches:
            counts += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.int16), minlength=len(wanted))
        yield pa.RecordBatch.from_arrays([pa.array(wanted.view(np.int64)), pa.array(counts)], names=["ending", "n"])

    # each text's places inside are few bytes: these are shuffled, not the texts
    found = texts.select("text").mapInArrow(run, "text_key bigint, places binary").distinct()
    inside = {r[0]: r[1] for r in found.select("places").mapInArrow(add, "ending bigint, n bigint").groupBy("ending").agg(F.sum("n").alias("n")).collect()}
    return {e: n / (n + inside.get(e, 0)) for e, n in ends.items()}


def length_spikes(slims: DataFrame) -> DataFrame:
    """(tbl, source, unit, length) of the field limits: lengths, in characters or bytes, at which far more texts of a source end than nearby.

    The histogram of each source and unit is compared with its own surroundings: NEAR lengths on either side. A length is a spike when its count exceeds TIMES
    the mean of the surroundings and is at least SPIKE. Each text counts once, so copies make no spike.
    """
    once = slims.where("chars > 0").select("tbl", "text_key", F.coalesce("source", F.lit("")).alias("source"), "chars", "bytes").distinct()
    both = once.select("tbl", "source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))).alias("u"))
    bars = both.groupBy("tbl", "source", "u.unit", "u.length").agg(F.count(F.lit(1)).alias("n"))
    near = bars.select("tbl", "source", "unit", F.col("n").alias("m"), F.explode(F.sequence(F.col("length") - NEAR, F.col("length") + NEAR)).alias("length"))
    around = near.groupBy("tbl", "source", "unit", "length").agg(F.sum("m").alias("m"))
    at = ["tbl", "source", "unit", "length"]
    return bars.where(F.col("n") >= SPIKE).join(around, at).where(F.col("n") > TIMES * (F.col("m") - F.col("n")) / (2 * NEAR) + 3).select(*at)


def at_spikes(slims: DataFrame) -> DataFrame:
    """(tbl, rec_id) of the slim rows whose length is a spike of their source."""
    spikes = length_spikes(slims)
    # lengths of one source number at most as many as a field has characters: a small table, joined by Spark's own choice
    source = F.coalesce("source", F.lit("")).alias("source")
    by = lambda unit: slims.select("tbl", "rec_id", source, F.col(unit).alias("length")).join(spikes.where(F.col("unit") == unit).drop("unit"), ["tbl", "source", "length"], "left_semi").select("tbl", "rec_id")
    return by("chars").unionByName(by("bytes")).distinct()


def slims_of(replies: Replies) -> DataFrame:
    """Slim rows of all replies with their source, written to the shared folder. The texts are read where they lie; only slim rows are joined with the runs."""
    return cut(replies.with_source(slim(replies.bare)), "slim")


def sources(replies: Replies) -> DataFrame:
    """(tbl, rec_id, source) of each reply once; a null source is "(none)"."""
    return replies.with_source(replies.bare.select("tbl", "rec_id", "link", "source")).select("tbl", "rec_id", F.coalesce("source", F.lit("(none)")).alias("source")).distinct()
