"""Replies that a field limit or a transfer cut.

Two detectors, whose hits are reported apart:

* `length`: for each source and column, histograms of the lengths in characters and in bytes are searched for spikes, which are field limits. A reply at a spike without terminal
  punctuation (a full stop, a mark that closes a formula or block, or a number) is cut by the limit, unless its last words often close replies where they stand ("the result is no solution").
* `mark`, `open`, `ending`: a transfer cuts at any length, so there the end itself must show it: a cut mark, an open block or formula, or an end inside a word or sentence. What a
  proper end is beside a full stop comes from all replies: endings that close replies much more often than they stand inside of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.functions.canon import no_answer
from rolloom.llm.replies import STEP, Reader, Replies, all_replies, at_spikes, known_endings, of, shared, slims_of, sources
from rolloom.session import cut

#: A known ending is a proper end with this share of its places at the end of replies.
PROPER = 0.1
#: Words that stand at the end of replies in at least this share of their places end a reply at a length spike too.
PROPER_AT_SPIKE = 0.3
#: A reply whose four-token runs are from the problem to this share, and that holds this share of the problem's, repeats the problem.
COPIED, WHOLE = 0.8, 0.85


def proper_end(known: dict[int, float], least: float = PROPER) -> Column:
    """True at an ending that is known to close replies. At most 2 / SHARE endings are known."""
    proper = [e for e, share in known.items() if share >= least]
    return F.col("ending").isin(proper) | F.col("short_ending").isin(proper) if proper else F.lit(False)


def suspects(replies: Replies) -> DataFrame:
    """(tbl, rec_id, detector) of the replies that one of the detectors finds, each once, by the first of length, mark, open and ending; they may still be copies or placeholders."""
    rows = slims_of(replies)
    known = known_endings(replies.bare, rows)
    marked = rows.where("tokens > 0").join(at_spikes(rows).withColumn("spike", F.lit(True)), ["tbl", "rec_id"], "left")
    at_limit = F.coalesce("spike", F.lit(False)) & ~F.col("stop") & ~F.col("closing") & ~proper_end(known, PROPER_AT_SPIKE)
    detector = F.when(at_limit, "length").when(F.col("broken"), "mark").when(F.col("left_open"), "open").when(~F.col("stop") & ~proper_end(known), "ending")
    return marked.select("tbl", "rec_id", detector.alias("detector")).where("detector is not null").distinct()


def without_copies(replies: DataFrame) -> DataFrame:
    """(tbl, rec_id) of the joined replies whose text doesn't repeat its problem (an unanswered cue may follow)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                of_reply, of_problem = shared(*reader.read(batch.column(3).to_pylist()), [g for _, g in reader.read_again(batch.column(2).to_pylist())])
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(~((of_reply >= COPIED) & (of_problem >= WHOLE)))) for c in batch.columns[:2]], names=["tbl", "rec_id"])

    return replies.select("tbl", "rec_id", "problem", "text").mapInArrow(run, "tbl string, rec_id bigint")


def detected(replies: DataFrame | Replies) -> DataFrame:
    """(tbl, rec_id, detector) of the cut replies, each once.

    Null, blank and placeholder texts are not cut, nor are texts that repeat their whole problem. Redelivered rows come out once. Only suspects meet their problems.
    """
    replies = of(replies)
    some = cut(suspects(replies), "suspects")
    kept = without_copies(replies.joined(some).where(~no_answer(F.col("text"))))
    return some.join(kept, ["tbl", "rec_id"], "left_semi")


def cut_replies(replies: DataFrame | Replies) -> DataFrame:
    """(tbl, rec_id) of the cut replies among (tbl, rec_id, source, problem, answer, text), each once, by either detector."""
    return detected(replies).select("tbl", "rec_id")


def cut_share(replies: DataFrame | Replies) -> DataFrame:
    """(tbl, source, replies, cut, share, by_length, by_mark, by_open, by_ending): how often each source's replies are cut, and which detector says so. A null source is the source "(none)"."""
    replies = of(replies)
    kinds = ("length", "mark", "open", "ending")
    each = sources(replies).join(detected(replies), ["tbl", "rec_id"], "left").groupBy("tbl", "source")
    counts = each.agg(F.count(F.lit(1)).alias("replies"), F.count("detector").alias("cut"), *[F.count_if(F.col("detector") == k).alias(f"by_{k}") for k in kinds])
    return counts.select("tbl", "source", "replies", "cut", (F.col("cut") / F.col("replies")).alias("share"), *[f"by_{k}" for k in kinds])


__all__ = ["all_replies", "cut_replies", "cut_share", "detected", "proper_end"]
