"""Problems that stand in the training split and in another one, exactly or almost.

Each prompt is reduced to canonical hashes after case, punctuation and whitespace normalisation: one of all its words, and one of its
quantities (the numbers in canonical writing, as a multiset, without those of standard instructions). Two prompts that state the same problem have
the same quantities, so hashes that stand on one side only are left out. Many different prompts may have the same quantities (none, or 1, 2, 3), so those
left are joined on hashes of the quantities with a band of their words (minima of hashed words), and the wording is then compared word for word. Texts with the
same words share all bands, those alike at 0.7 a band but for a probability of 0.001, those from 0.8 but for 1e-7.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.functions.canon import canonical_answer, fold, let, no_answer
from rolloom.functions.words import WORD, Hasher, MinHash, occurrences, plain, set_key, words
from rolloom.operators.skew import lookup, pairs_in_blocks
from rolloom.session import cut, release

#: A sentence is a standard instruction when it closes more than this share of the distinct prompts, and more than LEAST different ones.
SHARE, LEAST = 0.002, 5
#: Same wording: shared words over all words of both statements.
SHARED, OF = 7, 10
BANDS, ROWS = 40, 5
_END, _LINE = re.compile(r"(?<=[.!?;:。])\s+"), re.compile(r"\n+")


def split_name(split: Column) -> Column:
    """Split name without case and blanks; null for null and blank."""
    return F.nullif(F.lower(F.regexp_replace(split, r"[\s\p{Z}]+", "")), F.lit(""))


def sentence_words(sentence: Column) -> Column:
    """A sentence's words, one blank between them."""
    return F.trim(F.regexp_replace(fold(sentence), r"[^\p{L}\p{N}]+", " "))


def least_run(words: Column) -> Column:
    """The smallest hash of three words in a row: edited copies of one text mostly have the same, other texts seldom."""
    return let(words, lambda w: F.array_min(F.transform(w, lambda _, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))))


def instructions(texts: DataFrame, share: float = SHARE, least: int = LEAST) -> list[str]:
    """Sentences that close more than `share` of the distinct texts, and more than `least` different ones: at most (sentences of a text) / share of them, so the driver can hold them.

    Edited copies of one text don't count as different: the groups of remaining statements are weighed by their sizes (the square of all over the sum of squares).
    Sentences that stand before other instructions only are found when those are taken off.
    """
    distinct = texts.select("text").where("text is not null").distinct()
    sentences = F.filter(F.transform(F.split(F.regexp_replace("text", r"\s+", " "), r"(?<=[.!?;:。]) "), sentence_words), lambda s: s != "")
    left = whole = cut(distinct.select(sentences.alias("s")), "sentences")
    total, known = left.count(), []
    while True:
        if known:
            left = left.select(F.slice("s", 1, F.array_max(F.transform("s", lambda s, i: F.when(s.isin(known), 0).otherwise(i + 1)))).alias("s"))
        ends = left.where("size(s) > 1").select(F.get("s", F.size("s") - 1).alias("end"), least_run(F.split(F.array_join(F.slice("s", 1, F.size("s") - 1), " "), " ")).alias("rest"))
        groups = ends.where("length(end) >= 12").groupBy("end", "rest").agg(F.count(F.lit(1)).alias("m")).groupBy("end").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("squares"))
        found = [r[0] for r in groups.where((F.col("n") > least) & (F.col("n") > total * share) & (F.col("n") * F.col("n") > least * F.col("squares"))).select("end").collect()]
        if not found:
            release(whole)
            return known
        known += found


def bare(word: str) -> str:
    """A word without accents."""
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


#: Digit groups of three, parted by a comma, apostrophe, underscore, blank or LaTeX's {,} and \\, ; not the components of a bracketed list. What stands before is looked at from behind the first digit, since
#: digits are few.
_GROUPS = re.compile(r"[1-9](?<![\w.,(\[{].)(?<!\d[ '’].)\d{0,2}(?:(?:\{,\}|\\,|[,'’_ ])\d{3})+(?!\w)(?![,'’ ]\d{3}(?!\d))(?![)\]}])")
_BEHIND_LETTER, _BEFORE_LETTER = re.compile(r"\d(?<=[^\W\d_]\d)"), re.compile(r"\d(?=[^\W\d_])")


def canonical_numbers(text: str) -> str:
    """The text after NFKC and in lower case, with one writing for all writings of a number: digit groups joined, digits parted from letters (10cm, x1, x²)."""
    text = plain(text)
    if not text.isascii():
        text = "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)
    text = _GROUPS.sub(lambda m: "".join(c for c in m[0] if c.isdigit()), text)
    return _BEFORE_LETTER.sub(r"\g<0> ", _BEHIND_LETTER.sub(r" \g<0>", text))


def numbers(many: list[str]) -> list[str]:
    """The words with digits, sorted."""
    return sorted(w for w in many if not w.isalpha() and any(c.isdigit() for c in w))


class Statement:
    """Takes standard instructions out of a text, also where a word of theirs (but no number) was changed or the full stops are gone; with `end_only` none but those at its end."""

    def __init__(self, known: list[str], alike: float = 0.75, end_only: bool = False):
        self.end_only = end_only
        self.known = [[bare(w) for w in k.split()] for k in known]
        self.sets = [frozenset(k) for k in self.known]
        self.numbers = [numbers(k) for k in self.known]
        self.alike = alike
        self.index: dict[str, list[int]] = {}
        for i, k in enumerate(self.sets):
            for w in k:
                self.index.setdefault(w, []).append(i)
        self.cache: dict[str, bool] = {}

    def overlap(self, w: list[str], i: int) -> float:
        """Shared words of `w` (without accents) and the i-th instruction over all words of both; 0 where that is too little or their numbers differ."""
        s = frozenset(w)
        n = len(s & self.sets[i])
        all_words = len(s) + len(self.sets[i]) - n
        return n / all_words if n >= self.alike * all_words and numbers(w) == self.numbers[i] else 0.0

    def is_known(self, w: list[str]) -> bool:
        key = " ".join(w)
        hit = self.cache.get(key)
        if hit is None:
            w = w if key.isascii() else [bare(x) for x in w]
            s = frozenset(w)
            shared: dict[int, int] = {}
            if len(s) >= 3:
                for x in s:
                    for i in self.index.get(x, ()):
                        shared[i] = shared.get(i, 0) + 1
            own = numbers(w) if shared else []
            hit = any(n >= self.alike * (len(s) + len(self.sets[i]) - n) and own == self.numbers[i] for i, n in shared.items())
            if len(self.cache) > 50_000:
                self.cache.clear()
            if len(key) <= 400:  # long ones would fill the memory
                self.cache[key] = hit
        return hit

    def __call__(self, text: str) -> list[str]:
        """The words of the text's own statement."""
        text = plain(text)
        parts: list[list[str]] = []
        for sentence in _END.split(text):
            # line ends stand inside of sentences, or part those without a full stop
            w = WORD.findall(sentence)
            if "\n" not in sentence or self.is_known(w):
                parts.append(w)
            else:
                parts += map(WORD.findall, _LINE.split(sentence))
        parts = [w for w in parts if w]
        if self.end_only:
            while parts and self.is_known(parts[-1]):
                parts.pop()
        else:
            parts = [w for w in parts if not self.is_known(w)]
        out = [x for w in parts for x in w]
        plain_words = out if text.isascii() else [bare(x) for x in out]
        while True:  # instructions at the end of a text without full stops: the one that fits best
            fits = [(self.overlap(plain_words[len(out) - len(k) : len(out)], i), len(k)) for i, k in enumerate(self.known) if len(out) > len(k)]
            best = max(fits, default=(0.0, 0))
            if best[0] < self.alike:
                break
            out = out[: -best[1]]
        return out


_SCHEMA = "rec_id bigint, side string, ref string, text_key bigint, quantities bigint, tokens array<bigint>"


def describe(rows: DataFrame, known: list[str]) -> DataFrame:
    """Hashes of each row (rec_id, side, ref, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, own = Hasher(), Statement([canonical_numbers(k) for k in known])
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        for batch in batches:
            out: list[list] = [[] for _ in types]
            for rec, side, ref, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = canonical_numbers(text)
                w = own(text) or words(text)
                if not w:
                    continue
                tokens = occurrences(hasher(w))
                quantities = xxhash.xxh3_64_intdigest(" ".join(numbers(w))) - (1 << 63)
                for col, x in zip(out, (rec, side, ref, set_key(tokens), quantities, tokens.view(np.int64))):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, types)], names=[f.split()[0] for f in _SCHEMA.split(", ")])

    return rows.select("rec_id", "side", "ref", "text").mapInArrow(run, _SCHEMA)


def banded(reps: DataFrame) -> DataFrame:
    """(key, side, rep): for each of (side, rep, quantities, tokens) the keys of its bands, which hold the quantities too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(BANDS, ROWS)
        for batch in batches:
            sides, ids, quantities, tokens = batch.columns
            flat, at = tokens.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum([0, *tokens.value_lengths().to_pylist()])
            keys = [minhash(flat[a:b]) ^ q for a, b, q in zip(at[:-1], at[1:], quantities.to_numpy(zero_copy_only=False))]
            again = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])), sides.take(again), ids.take(again)], names=["key", "side", "rep"])

    return reps.select("side", "rep", "quantities", "tokens").mapInArrow(run, "key bigint, side string, rep bigint")


def reference_value(reference: Column) -> Column:
    """The value a reference states: the text after ####, in canonical writing; null where it is missing."""
    value = F.substring_index(reference, "####", -1)
    return F.when(~no_answer(value), F.nullif(canonical_answer(value), F.lit("")))


_CLASS = ["side", "text_key", "quantities"]


def classes(problems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(side, rec_id, ref, rep) of each problem with words in training (side t) or another split (e), rep being the smallest id of its side with the same words and quantities;
    and (e, t), the pairs of representatives that state the same problem."""
    name = split_name(F.col("split"))
    rows = problems.where(name.isNotNull() & F.col("prompt").isNotNull()).select(
        F.col("problem_id").alias("rec_id"), F.when(name == "train", "t").otherwise("e").alias("side"), reference_value(F.col("reference")).alias("ref"), F.col("prompt").alias("text")
    )
    table = cut(describe(rows.dropDuplicates(["rec_id"]), instructions(rows)), "hashes")
    members = table.join(table.groupBy(*_CLASS).agg(F.min("rec_id").alias("rep")), _CLASS).select("side", "rec_id", "ref", "rep")
    members = cut(members, "members")
    # texts whose quantities stand on the other side too
    sides = table.groupBy("quantities").agg(F.count_distinct("side").alias("n")).where("n = 2").select("quantities")
    firsts = members.where("rec_id = rep").select("rec_id")
    reps = cut(table.join(sides, "quantities", "left_semi").join(firsts, "rec_id", "left_semi").select("side", F.col("rec_id").alias("rep"), "quantities", "tokens"), "reps")
    release(table)
    bands = cut(banded(reps), "bands")
    keyed = lambda s: bands.where(F.col("side") == s).select("key", F.col("rep").alias(s))
    met = pairs_in_blocks(keyed("e"), keyed("t"), "key").select("e", "t").distinct()
    of = lambda s: reps.select(F.col("rep").alias(s), F.col("tokens").alias(f"w{s}"), F.col("quantities").alias(f"q{s}"))
    both = F.size(F.array_intersect("we", "wt"))
    alike = both * OF >= SHARED * (F.size("we") + F.size("wt") - both)
    same = cut(met.join(of("e"), "e").join(of("t"), "t").where((F.col("qe") == F.col("qt")) & alike).select("e", "t"), "same")
    release(reps, bands)
    return members, same


def _agree() -> Column:
    return F.col("eval_ref").isNull() | F.col("train_ref").isNull() | (F.col("eval_ref") == F.col("train_ref"))


def overlaps(problems: DataFrame) -> DataFrame:
    """(train_id, eval_id) for every problem of the training split that another split states too.

    `problems` has problem_id, prompt, reference and split. Null or blank splits belong to neither side; null, blank and wordless prompts have
    no pair. The pair's quantities are equal, its words alike up to small edits, and its references equal where both sides have one.
    Repeated rows of one id count once. The texts of a class on either side are spread over blocks.
    """
    members, same = classes(problems)
    evals = members.where("side = 'e'").select(F.col("rep").alias("e"), F.col("rec_id").alias("eval_id"), F.col("ref").alias("eval_ref"))
    trains = members.where("side = 't'").select(F.col("rep").alias("t"), F.col("rec_id").alias("train_id"), F.col("ref").alias("train_ref"))
    found = pairs_in_blocks(evals, same, "e").drop("e")
    found = pairs_in_blocks(found, trains, "t")
    return found.where(_agree()).select("train_id", "eval_id")


def overlap_pairs(problems: DataFrame) -> DataFrame:
    """(id_a, id_b), smaller first."""
    return overlaps(problems).select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b"))


def overlap_report(problems: DataFrame) -> DataFrame:
    """(split, source, problems, leaked, pairs): for each split and source of evaluation problems how many there are, how many of them the training split states too, and the number of pairs.

    Pairs are counted by classes of the same words, quantities and reference, and never formed. A null source is the source "(none)".
    """
    members, same = classes(problems)
    trains = members.where("side = 't'").groupBy(F.col("rep").alias("t"), F.col("ref").alias("train_ref")).agg(F.count(F.lit(1)).alias("n"))
    evals = members.where("side = 'e'").select(F.col("rec_id").alias("problem_id"), F.col("rep").alias("e"), F.col("ref").alias("eval_ref"))
    kinds = evals.select("e", "eval_ref").distinct()
    partners = kinds.join(same, "e").join(trains, "t").where(_agree()).groupBy("e", "eval_ref").agg(F.sum("n").alias("pairs"))
    rows = problems.select("problem_id", split_name(F.col("split")).alias("split"), F.coalesce("source", F.lit("(none)")).alias("source")).dropDuplicates(["problem_id"]).where("split is not null and split <> 'train'")
    # a hot class of evaluation problems is spread over blocks
    kind = lambda df: df.withColumn("kind", F.xxhash64("e", F.coalesce(F.concat(F.lit("+"), "eval_ref"), F.lit("-")))).drop("e", "eval_ref")
    sizes = kind(evals).groupBy("kind").agg(F.count(F.lit(1)).alias("_n")).join(kind(partners), "kind")
    found = lookup(kind(evals), "kind", sizes, "_n").select("problem_id", "pairs")
    return rows.join(found, "problem_id", "left").groupBy("split", "source").agg(F.count(F.lit(1)).alias("problems"), F.count("pairs").alias("leaked"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
