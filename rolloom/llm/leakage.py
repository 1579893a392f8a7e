"""Held-out test statements and answers inside a training corpus.

Blocks of six words of the items' statements and references, one after the other, become the patterns of one Aho-Corasick automaton over word numbers: any twelve words in a row hold
one whole. Each document is read once; a block found is extended to both sides as far as the words agree, which gives the passage with its place in the original.
A statement is a prompt without the standard instructions at its end, which several different items share; a prompt of nothing else is kept whole.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.functions.words import INVISIBLE, WORD, words
from rolloom.llm.crosssplit import Statement, instructions

#: Words in a row that make a passage.
RUN = 12
#: A text of fewer words is found as a whole, from so many on; fewer words are said by chance.
WHOLE = 6
#: Items of one automaton, which takes about 70 MB in a worker process (136 MB measured for 20,000 statements of 60 words); more are scanned for in further passes.
ITEMS = 10_000


class Automaton:
    """The automaton of (item_id, part, words) texts; the part tells a statement from a reference."""

    def __init__(self, texts: list[tuple[int, str, list[str]]], run: int = RUN):
        self.run = run
        self.number: dict[str, int] = {}
        self.texts = [(item, part, tuple(self.number.setdefault(x, len(self.number) + 1) for x in w)) for item, part, w in texts if len(w) >= min(run, WHOLE)]
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        owners: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for t, (_, _, ids) in enumerate(self.texts):
            size = run // 2 if len(ids) >= run else len(ids)
            for at in range(0, len(ids) - size + 1, size):
                owners.setdefault(ids[at : at + size], []).append((t, at))
        for block, places in owners.items():
            self.machine.add_word(block, (len(block), places))
        self.empty = not owners
        if owners:
            self.machine.make_automaton()

    def passages(self, w: list[str]) -> Iterator[tuple[int, str, int, int]]:
        """(item, part, first, end) of the passages among the words, those of one text that overlap or touch as one."""
        if self.empty or len(w) < min(self.run, WHOLE):
            return
        get = self.number.get
        ids = tuple([get(x, 0) for x in w])
        found: dict[int, list[tuple[int, int]]] = {}
        reached: dict[tuple[int, int], int] = {}  # by text and shift, how far its words are known to agree
        for last, (size, places) in self.machine.iter(ids):
            first = last - size + 1
            for t, at in places:
                if reached.get((t, first - at), -1) > first:
                    continue
                text = self.texts[t][2]
                a, b = first, first + size
                while a > 0 and at - (first - a) > 0 and ids[a - 1] == text[at - (first - a) - 1]:
                    a -= 1
                while b < len(ids) and at + (b - first) < len(text) and ids[b] == text[at + (b - first)]:
                    b += 1
                reached[t, first - at] = b
                if b - a >= min(self.run, len(text)):
                    found.setdefault(t, []).append((a, b))
        for t, runs in found.items():
            runs.sort()
            start, end = runs[0]
            for a, b in runs[1:]:
                if a <= end:
                    end = max(end, b)
                else:
                    yield *self.texts[t][:2], start, end
                    start, end = a, b
            yield *self.texts[t][:2], start, end


#: The automata of a worker process by the name of their items: built once, not for every task.
_HELD: dict[str, Automaton] = {}


def _automaton(name: str, texts: list[tuple[int, str, list[str]]], run: int) -> Automaton:
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Automaton(texts, run)
    return _HELD[name]


def spans(text: str) -> list[tuple[int, int]]:
    """(start, end) in the original text of each of its words."""
    if text.isascii():
        return [m.span() for m in WORD.finditer(text)]
    shown, origin = [], []
    at, n = 0, len(text)
    while at < n:
        end = at + 1
        while end < n and (unicodedata.combining(text[end]) or INVISIBLE.match(text[end])):
            end += 1  # marks join the character before them
        piece = unicodedata.normalize("NFKC", INVISIBLE.sub("", text[at:end])).lower()
        shown.append(piece)
        origin += [(at, end)] * len(piece)
        at = end
    return [(origin[m.start()][0], origin[m.end() - 1][1]) for m in WORD.finditer("".join(shown))]


def standard(items: DataFrame) -> list[str]:
    """The standard instructions of all items."""
    return instructions(items.select(F.col("prompt").alias("text")), share=0.0, least=2)


def texts_of(items: DataFrame, known: list[str] | None = None) -> tuple[list[tuple[int, str, list[str]]], list[str]]:
    """The items' statements, without the `known` instructions or else those of these items, and references, as words. At most ITEMS rows come here at once."""
    known = standard(items) if known is None else known
    own = Statement(known, end_only=True)
    reference = F.col("reference") if "reference" in items.columns else F.lit(None).cast("string")
    rows = items.where("item_id is not null").select("item_id", "prompt", reference).distinct().collect()
    out = [(r[0], "statement", own(r[1]) or words(r[1])) for r in rows if r[1]] + [(r[0], "reference", words(r[2])) for r in rows if r[2]]
    return out, known


def _scan(documents: DataFrame, texts: list[tuple[int, str, list[str]]], run: int) -> DataFrame:
    held = documents.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, texts))  # bounded by ITEMS

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(*held.value, run)
        for batch in batches:
            out: list[tuple[int, int, str, int, int, int]] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(machine.passages(words(text))) if text else []
                if found:
                    where = spans(text)
                    exact = len(where)
                    out += [(doc, item, part, b - a, where[min(a, exact - 1)][0], where[min(b, exact) - 1][1]) for item, part, a, b in found]
            types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=t) for i, t in enumerate(types)], names=["doc_id", "item_id", "part", "n_words", "start", "end"])

    return documents.select("doc_id", "text").mapInArrow(read, "doc_id bigint, item_id bigint, part string, n_words int, start int, end int")


def passages(documents: DataFrame, items: DataFrame, run: int = RUN, most: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, part, n_words, start, end) of every passage of at least `run` words in a row of an item's own statement, or of its reference; part says of which.

    A statement or reference of fewer words, but at least WHOLE, is a passage as a whole. start and end are character positions in the original text. Null and empty texts, prompts and references
    have no passage. The items are held by every worker, so a set of more than `most` is scanned for in several passes over the
    documents; the standard instructions are those of all items in any case. Passages of one text that overlap come out as one.
    """
    count, known = items.count(), standard(items)
    found = None
    blocks = max(1, -(-count // most))
    for i in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i)
        one = _scan(documents, texts_of(part, known)[0], run)
        found = one if found is None else found.unionByName(one)
    return found


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, item_id), each pair once, of the passages of at least `run` words of statements."""
    return passages(documents, items, run).where((F.col("part") == "statement") & (F.col("n_words") >= run)).select("doc_id", "item_id").distinct()


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, documents, longest, of_statement, of_reference): for each item how many documents hold a passage of it, how many words the longest has, and how many documents hold one of its statement and of its reference."""
    of = lambda part: F.count_distinct(F.when(F.col("part") == part, F.col("doc_id")))
    found = passages(documents, items).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("n_words").alias("longest"), of("statement").alias("of_statement"), of("reference").alias("of_reference"))
    numbers = ["documents", "longest", "of_statement", "of_reference"]
    return items.select("item_id").distinct().join(found, "item_id", "left").select("item_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers])
