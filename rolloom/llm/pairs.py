"""Faulty pairs of a problem with its reply, by a multi-label linear classifier.

Features are hashed n-grams of the reply's tokens and measures of the pair: how it ends, how much of the reply stands in the problem and the reverse, whether the languages
agree, lengths. The classifier learns from synthetic faults: of a bounded sample of replies that look sound, it sees copies that were cut, that repeat the problem, that
were swapped with a reply in another language, or that refuse; and sound ones, among them hard cases (a problem restated and then solved, an apology on the
way). Thresholds are calibrated on synthetic pairs held out from training.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.functions.canon import no_answer
from rolloom.functions.words import MIX
from rolloom.llm.languages import FREQUENT
from rolloom.llm.replies import Among, Reader, Replies, ending_marks, grams, known_endings, of, shared, slim, sources
from rolloom.llm.truncation import COPIED, PROPER, WHOLE
from rolloom.operators.sample import smallest
from rolloom.session import cut

#: Pairs the classifier is fitted on, at most: those with the smallest hash of their id. Each gives up to seven synthetic ones.
SAMPLE = 1500
#: Hashed n-gram features.
WIDTH = 1 << 15
#: Weight of the last tokens' features.
END_WEIGHT = 0.4
LABELS = ("truncated", "refusal", "copied", "other_language")

#: Letters of other scripts, by ranges of code points.
SCRIPTS = {"han": (0x4E00, 0x9FFF), "kana": (0x3040, 0x30FF), "hangul": (0xAC00, 0xD7AF), "cyrillic": (0x400, 0x4FF), "arabic": (0x600, 0x6FF), "greek": (0x370, 0x3FF), "hebrew": (0x590, 0x5FF), "devanagari": (0x900, 0x97F), "thai": (0xE00, 0xE7F)}
TONGUES = (*FREQUENT, *SCRIPTS)

# Parts of synthetic refusals, leads and cues.
REFUSALS = {
    "en": (
        ["I'm sorry, but", "I am sorry, but", "Sorry,", "Unfortunately,", "I apologise, but", "I apologize;", "I regret that", "As an assistant,", "As a language model,", "Thank you for asking, but", "Thanks for the question, but", "To be honest,", "To be upfront:", "I must say that", "After some thought,", ""],
        ["I can't help with that.", "I cannot help with this request.", "I am unable to provide a solution.", "I'm not able to answer this question.", "I won't be able to solve this problem.", "I can't assist with this task.", "I must decline to answer.", "this is something I have to decline.", "I have to refuse this task.", "I would rather not solve this.", "I do not feel comfortable answering.", "I don't feel comfortable solving this one.", "it would not be appropriate for me to give a solution.", "giving the answer is outside what I am allowed to do.", "I am not permitted to solve this.", "I have to pass on this task.", "I will not answer this.", "I prefer not to work on this exercise."],
        ["Please ask a teacher instead.", "Please consult a qualified person.", "Is there anything else I can help with?", "I can offer general advice if you like.", "Thank you for your understanding.", "This could undermine the exam.", "It would violate my guidelines.", "", ""],
    ),
    "de": (["Es tut mir leid, aber", "Leider", "Entschuldigung,", ""], ["kann ich diese Aufgabe nicht lösen.", "darf ich das nicht beantworten.", "dabei kann ich nicht helfen.", "möchte ich hierzu keine Lösung angeben.", "diese Aufgabe darf ich nicht beantworten.", "diese Anfrage muss ich ablehnen."], ["Bitte wende dich an eine Lehrkraft.", "Gern helfe ich bei etwas anderem.", "Danke für dein Verständnis.", ""]),
    "fr": (["Je suis désolé, mais", "Malheureusement,", "Désolé,", ""], ["je ne peux pas résoudre ce problème.", "je ne peux pas répondre à cette demande.", "je préfère ne pas traiter cet exercice.", "je dois refuser cette demande.", "il m'est impossible de vous aider ici."], ["Veuillez consulter un enseignant.", "Je peux aider pour autre chose.", "Merci de votre compréhension.", ""]),
    "es": (["Lo siento, pero", "Lamentablemente,", "Por desgracia,", ""], ["no puedo resolver este problema.", "no puedo ayudar con esta petición.", "prefiero no tratar este ejercicio.", "debo rechazar esta tarea.", "no me está permitido responder."], ["Consulte a un profesor.", "Puedo ayudar con otra cosa.", "Gracias por su comprensión.", ""]),
}
LEADS = ["", "", "Here is the task again. ", "The problem says: ", "Question: ", "Let me restate the problem. ", "You asked: ", "Aufgabe: ", "Problème : ", "Problema: "]
CUES = ["", "", "\nAnswer:", "\n\nAnswer:", "\nA:", "\nSolution:", "\n\nSolution:", "\nLösung:", "\nRéponse :", "\nSolución:"]
APOLOGIES = ["Sorry, the earlier count was off; redoing it. ", "I am not able to use that method directly here, but a weaker form suffices. ", "I apologise for the slip above. ", "Unfortunately this first attempt fails, so we try another way. ", "We cannot assume that, so both cases are treated. "]
OPENINGS = ["", "", "Sure, here is my solution.\n", "Okay, let me think about this first.\n\n", "Solution. "]


def may_copy(answer: str | None, problem: str | None) -> bool:
    """An answer much shorter than the problem can't repeat it."""
    return bool(answer and problem) and len(answer) >= min(40, len(problem.strip()) // 2)


class Features:
    """Features of pairs: for each token of the replies the columns of its n-grams, and the dense matrix. A row's n-gram features are scaled by the reply's length, those of its end aren't."""

    def __init__(self, h: np.ndarray, at: np.ndarray, two: np.ndarray, dense: np.ndarray):
        size = np.diff(at)
        owner = np.repeat(np.arange(len(size)), size)
        self.n, self.at, self.dense = len(size), at, dense
        self.scale = (1.0 / np.sqrt(np.maximum(size, 1))).astype(np.float32)
        self.one, self.two = self._column(h), self._column(two)
        self.two[at[:-1][size > 0]] = WIDTH  # no bigram ends at a first token
        ends = np.flatnonzero(at[1:][owner] - np.arange(len(h)) <= 6)
        with np.errstate(over="ignore"):
            self.end = self._column(h[ends] * MIX)
        self.end_at = np.searchsorted(owner[ends], np.arange(self.n + 1))

    @staticmethod
    def _column(hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(17)) & np.uint64(WIDTH - 1)).astype(np.int32)

    def linear(self, wide: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Scores of each label; `wide` has a row for each label, with a last column of zeros."""
        out = self.dense @ dense
        for j, w in enumerate(wide):
            out[:, j] += self.scale * _sums(w[self.one] + w[self.two], self.at) + END_WEIGHT * _sums(w[self.end], self.end_at)
        return out

    def triples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and values of the n-gram features."""
        owner, of_end = np.repeat(np.arange(self.n), np.diff(self.at)), np.repeat(np.arange(self.n), np.diff(self.end_at))
        real = self.two < WIDTH
        values = np.concatenate([self.scale[owner], self.scale[owner[real]], np.full(len(of_end), END_WEIGHT, dtype=np.float32)])
        return np.concatenate([owner, owner[real], of_end]), np.concatenate([self.one, self.two[real], self.end]), values


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the values from each place of `at` to the next."""
    out = np.zeros(len(at) - 1, dtype=np.float32)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        out[some] = np.add.reduceat(values, at[some])
    return out


class Featurer:
    """Features of pairs (problem, answer, reply); `known` are the known endings."""

    DENSE = 22

    def __init__(self, known: dict[int, float]):
        self.reader = Reader()
        self.known = known
        tongues: dict[int, int] = {}
        for j, lang in enumerate(FREQUENT):
            for w in FREQUENT[lang]:
                h = xxhash.xxh64_intdigest(w)
                tongues[h] = tongues.get(h, 0) | (1 << j)
        self.speech = Among(np.array(list(tongues), dtype=np.uint64))
        self.bits = np.array([tongues[int(h)] for h in self.speech.values], dtype=np.int64)
        #: Hits of each language by the bits of a word.
        self.hits = ((np.arange(1 << len(FREQUENT))[:, None] >> np.arange(len(FREQUENT))) & 1).astype(float)
        self.spoken: dict[str, np.ndarray] = {}

    def tongue(self, h: np.ndarray, at: np.ndarray, texts: list[str | None]) -> np.ndarray:
        """For each text the share of each language among its hits; zeros where there are too few."""
        hit, place = self.speech(h)
        owner = np.searchsorted(at, hit, side="right") - 1
        kinds = len(self.hits)
        out = np.zeros((len(texts), len(TONGUES)))
        out[:, : len(FREQUENT)] = np.bincount(owner * kinds + self.bits[place], minlength=len(texts) * kinds).reshape(len(texts), kinds) @ self.hits
        for i, t in enumerate(texts):
            if t and not t.isascii():
                codes = np.frombuffer(t.encode("utf-32-le", "replace"), dtype=np.uint32)
                codes = codes[(codes >= 0x370) & ((codes < 0x2000) | (codes >= 0x3040))]  # without signs and punctuation
                if len(codes) < 4:
                    continue
                for j, (a, b) in enumerate(SCRIPTS.values()):
                    out[i, len(FREQUENT) + j] = ((codes >= a) & (codes <= b)).sum() * 0.5
                # single Greek letters are mathematics
                if out[i, len(FREQUENT) + 5] < 10:
                    out[i, len(FREQUENT) + 5] = 0
        total = out.sum(axis=1, keepdims=True)
        best = out == out.max(axis=1, keepdims=True)
        return np.where((total >= 3) & best, 1.0, 0.0) * np.where(total > 0, out / np.maximum(total, 1), 0)

    def of_problems(self, problems: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
        """Runs of four tokens of each problem, and its language; both are kept for problems that come again."""
        parts = self.reader.read_again(problems)
        if len(self.spoken) > self.reader.texts:
            self.spoken.clear()
        fresh = {t: h for t, (h, _) in zip(problems, parts) if t and t not in self.spoken}
        if fresh:
            at = np.cumsum([0, *map(len, fresh.values())])
            self.spoken.update(zip(fresh, self.tongue(np.concatenate([*fresh.values(), np.zeros(0, np.uint64)]), at, list(fresh))))
        none = np.zeros(len(TONGUES))
        return [g for _, g in parts], np.array([self.spoken[t] if t else none for t in problems]).reshape(len(problems), len(TONGUES))

    def __call__(self, problems: list[str | None], answers: list[str | None], texts: list[str | None]) -> Features:
        n = len(texts)
        h, at = self.reader.read(texts)
        runs, tp = self.of_problems(problems)
        in_problem, in_reply = shared(h, at, runs)
        # an answer that is the reply itself has been looked at
        asked = [x if x != t and may_copy(x, q) else None for x, q, t in zip(answers, problems, texts)]
        answer_in, problem_in = shared(*self.reader.read(asked), runs) if any(asked) else (np.zeros(n), np.zeros(n))
        with np.errstate(over="ignore"):
            two, three = grams(h, 2), grams(h, 3)
        size = np.diff(at)
        tr = self.tongue(h, at, texts)
        agree = np.einsum("ij,ij->i", (tr > 0).astype(float), (tp > 0).astype(float))
        both = (tr.sum(axis=1) > 0) & (tp.sum(axis=1) > 0)
        marks = np.array([ending_marks(t.rstrip()) if t else (False, False, False) for t in texts], dtype=float).reshape(n, 3)
        known, ends = np.zeros(n), at[1:] - 1
        at_three, at_two = three.view(np.int64)[ends].tolist() if len(h) else [], two.view(np.int64)[ends].tolist() if len(h) else []
        for i in np.flatnonzero(size > 0):
            known[i] = max(self.known.get(at_three[i], 0.0) if size[i] >= 3 else 0.0, self.known.get(at_two[i], 0.0) if size[i] >= 2 else 0.0)
        closed = ((known >= PROPER) | (marks[:, 1] > 0)) & (marks[:, 2] == 0)
        dense = np.zeros((n, self.DENSE))
        repeats = (in_problem >= COPIED) & (in_reply >= WHOLE)
        for j, x in enumerate(
            [
                np.ones(n), known, marks[:, 0], marks[:, 1], marks[:, 2], ~closed, ~closed & ~repeats, in_problem, in_reply, in_problem * in_reply, repeats, repeats | (answer_in >= 0.8) & (problem_in >= 0.5),
                np.maximum(answer_in * problem_in, 0) * 1.0, both & (agree == 0), both & (agree > 0), (tr.sum(axis=1) == 0), np.log1p(size) / 5, size < 60, size < 30, closed & ~repeats, known >= PROPER, (known >= PROPER) & ~repeats,
            ]
        ):
            dense[:, j] = x
        return Features(h, at, two, dense)


def refuse(rng: random.Random, lang: str, problem: str) -> str:
    lead, body, close = REFUSALS.get(lang, REFUSALS["en"])
    text = f"{rng.choice(lead)} {rng.choice(body)} {rng.choice(close)}".strip()
    if rng.random() < 0.25:
        words = problem.split()
        at = rng.randrange(max(1, len(words) - 6))
        text = f"{rng.choice(['This task is about', 'I have read the question on', 'You ask about'])} {' '.join(words[at : at + rng.randint(3, 8)])}. {text}"
    kind = rng.random()
    return text.lower() if kind < 0.15 else text.replace("'", "’") if kind < 0.35 else text[0].upper() + text[1:]


def synthetic(sample: list[tuple[str, str, str, str]], seed: int = 5) -> list[tuple[str, str, str, str | None]]:
    """(problem, answer, reply, label or None) from sound pairs (language, problem, answer, reply)."""
    rng = random.Random(seed)
    by_lang: dict[str, list[str]] = {}
    for lang, _, _, t in sample:
        by_lang.setdefault(lang, []).append(t)
    out: list[tuple[str, str, str, str | None]] = []
    for lang, q, a, t in sample:
        out.append((q, a, t, None))
        part = t.rstrip()[: rng.randint(max(20, len(t) // 10), max(21, int(len(t) * 0.97)))].rstrip()
        out.append((q, a if rng.random() < 0.2 else "", part + rng.choice(["", "", "", "", "", "…", "�"]), "truncated"))
        mark = rng.choice(["", "", '"', "> "])
        copy = rng.choice(LEADS) + mark + q + (mark if mark == '"' else "") + rng.choice(CUES)
        copy = rng.choice([copy, copy, copy.lower(), copy.upper()])
        out.append((q, a, copy, "copied"))
        if rng.random() < 0.4:
            out.append((q, q if rng.random() < 0.7 else copy, t, "copied"))
        out.append((q, rng.choice(["", "N/A", a]), refuse(rng, lang, q), "refusal"))
        others = [x for x in by_lang if x != lang]
        if others:
            t2 = rng.choice(by_lang[rng.choice(others)])
            out.append((q, a, rng.choice(OPENINGS) + t2, "other_language"))
        kind = rng.random()
        if kind < 0.3:
            out.append((q, a, q + "\n\n" + t, None))
        elif kind < 0.6:
            parts = t.split(". ")
            at = rng.randrange(len(parts))
            out.append((q, a, ". ".join(parts[:at] + [rng.choice(APOLOGIES) + parts[at]] + parts[at + 1 :]), None))
        elif kind < 0.8:
            out.append((q, a, rng.choice(OPENINGS) + rng.choice(by_lang[lang]), None))
    return out


class Classifier:
    """Linear scores of all labels, fitted by logistic loss with Adam; thresholds of best F1 on held-out pairs."""

    def __init__(self, featurer: Featurer, pairs: list[tuple[str, str, str, str | None]], steps: int = 80, seed: int = 3):
        self.wide = np.zeros((len(LABELS), WIDTH + 1), dtype=np.float32)
        self.dense = np.zeros((Featurer.DENSE, len(LABELS)))
        self.threshold = np.zeros(len(LABELS))
        if not pairs:
            self.threshold[:] = np.inf
            return
        order = np.random.default_rng(seed).permutation(len(pairs))
        held = int(len(order) * 0.2)
        test, train = [pairs[i] for i in order[:held]], [pairs[i] for i in order[held:]]
        features = self._features(featurer, train)
        y = np.array([[lab == name for name in LABELS] for *_, lab in train], dtype=float)
        n = len(train)
        rows, columns, values = features.triples()
        by_column = np.argsort(columns, kind="stable")
        rows, values = rows[by_column], values[by_column]
        used, begin = np.unique(columns[by_column], return_index=True)
        wide = np.zeros((len(LABELS), len(used)), dtype=np.float32)
        m1, v1, m2, v2 = (np.zeros_like(x) for x in (wide, wide, self.dense, self.dense))
        for step in range(1, steps + 1):
            z = features.linear(self.wide, self.dense)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
            by_label = np.ascontiguousarray(g.T, dtype=np.float32)
            gw = np.stack([np.add.reduceat(values * by_label[j][rows], begin) for j in range(len(LABELS))])
            gd = features.dense.T @ g
            for w, grad, m, v, rate in ((wide, gw + 2e-5 * wide, m1, v1, 0.06), (self.dense, gd + 1e-5 * self.dense, m2, v2, 0.12)):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            self.wide[:, used] = wide
        z = self._features(featurer, test).linear(self.wide, self.dense)
        truth = np.array([[lab == name for name in LABELS] for *_, lab in test])
        # sound pairs are far more frequent in fact than among the synthetic ones
        weight = np.where([lab is None for *_, lab in test], 8.0, 1.0)
        for j in range(len(LABELS)):
            rank = np.argsort(-z[:, j])
            hit = np.cumsum(truth[rank, j] * weight[rank])
            f1 = 2 * hit / (np.cumsum(weight[rank]) + (truth[:, j] * weight).sum())
            i = int(f1.argmax())
            self.threshold[j] = (z[rank[i], j] + z[rank[min(i + 1, len(rank) - 1)], j]) / 2
        self.held_out = float(((z > self.threshold) == truth).mean())

    @staticmethod
    def _features(featurer: Featurer, pairs: list) -> Features:
        q, a, t, *_ = zip(*pairs)
        return featurer(list(q), list(a), list(t))

    def margins(self, featurer: Featurer, problems: list, answers: list, texts: list) -> np.ndarray:
        """Scores above the thresholds. A reply that ends properly isn't truncated, and one with a cut mark or an open block or formula is, whatever their n-grams say; one that repeats its problem aside."""
        features = featurer(problems, answers, texts)
        dense = features.dense
        out = features.linear(self.wide, self.dense) - self.threshold
        out[(dense[:, 5] == 0) & (dense[:, 2] == 0), 0] = -np.inf
        opened = ((dense[:, 4] > 0) | (dense[:, 2] > 0)) & (dense[:, 10] == 0)
        out[opened, 0] = np.maximum(out[opened, 0], 1e-6)
        return out


def sound_sample(replies: Replies, known: dict[int, float], total: int, most: int = SAMPLE) -> list[tuple[str, str, str, str]]:
    """Of about `total` replies at most `most` pairs that look sound, with their language: long enough, properly ended, in the problem's language, no copy."""
    some = smallest(replies.joined().where("problem is not null and length(text) >= 150"), F.xxhash64("tbl", "rec_id"), most, total, "tbl", "rec_id").select("problem", "answer", "text").collect()
    if not some:
        return []
    featurer = Featurer(known)
    q, a, t = (list(x) for x in zip(*some))
    dense = featurer(q, a, t).dense
    _, tongue = featurer.of_problems(q)
    keep = (dense[:, 5] == 0) & (dense[:, 11] == 0) & (dense[:, 14] > 0) & (dense[:, 17] == 0)
    return [(TONGUES[int(tongue[i].argmax())], q[i], a[i] or "", t[i]) for i in np.flatnonzero(keep)]


def faulty_pairs(replies: DataFrame | Replies, most: int = SAMPLE) -> DataFrame:
    """(tbl, rec_id, defect) of the faulty pairs among (tbl, rec_id, source, problem, answer, text), each with one defect.

    A null, blank or placeholder reply is `empty`, and so is a pair without another defect whose answer is one. Pairs without a problem can only be truncated, refusals or
    empty. Redelivered rows come out once. The classifier is broadcast: its size doesn't depend on the data.
    """
    replies = of(replies)
    ends = cut(slim(replies.bare).select("text_key", "tokens", "ending", "short_ending"), "endings")
    known, total = known_endings(replies.bare, ends), ends.count()
    featurer = Featurer(known)
    model = Classifier(featurer, synthetic(sound_sample(replies, known, total, most)))
    held = ends.sparkSession.sparkContext.broadcast((known, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        endings, linear = held.value
        featurer = Featurer(endings)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                tbl, rec, problems, answers, texts, empty_text, empty_answer = (c.to_pylist() for c in batch.columns)
                margin = linear.margins(featurer, problems, answers, texts)
                best = margin.argmax(axis=1)
                defect = []
                for i, j in enumerate(best):
                    if empty_text[i]:  # only the answer may still repeat the problem
                        defect.append("copied" if margin[i, 2] > 0 and not empty_answer[i] and may_copy(answers[i], problems[i]) else "empty")
                    else:
                        defect.append(LABELS[j] if margin[i, j] > 0 else "empty" if empty_answer[i] else None)
                keep = [i for i, d in enumerate(defect) if d]
                yield pa.RecordBatch.from_arrays([pa.array([tbl[i] for i in keep], type=pa.string()), pa.array([rec[i] for i in keep], type=pa.int64()), pa.array([defect[i] for i in keep], type=pa.string())], names=["tbl", "rec_id", "defect"])

    marked = replies.joined().select("tbl", "rec_id", "problem", "answer", "text", no_answer(F.col("text")).alias("empty_text"), no_answer(F.col("answer")).alias("empty_answer"))
    found = marked.mapInArrow(run, "tbl string, rec_id bigint, defect string")
    return found.groupBy("tbl", "rec_id").agg(F.min("defect").alias("defect"))


def defect_report(replies: DataFrame | Replies) -> DataFrame:
    """(tbl, source, defect, pairs, share) with the sound pairs as defect "none"."""
    once = sources(of(replies))
    each = once.join(faulty_pairs(replies), ["tbl", "rec_id"], "left").groupBy("tbl", "source", F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count(F.lit(1)).alias("pairs"))
    total = once.groupBy("tbl", "source").agg(F.count(F.lit(1)).alias("total"))
    return each.join(total, ["tbl", "source"]).select("tbl", "source", "defect", "pairs", (F.col("pairs") / F.col("total")).alias("share"))
