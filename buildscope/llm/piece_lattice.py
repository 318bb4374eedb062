"""SentencePiece encoding and decoding: the N best segmentations of a text over its lattice of pieces.

The lattice has an arc for every piece of the vocabulary at every place where it occurs; a character that is no piece itself has an
arc of its byte pieces. A forward Viterbi pass gives the best score of every prefix. These scores are exact heuristics for an A-star
search that runs backward from the end: what it has gathered plus the best score of the prefix still open is the score of the best
segmentation that ends so, hence segmentations leave the queue best first and the search stops after N.

The lattice falls apart where no piece crosses from one character to the next: before space marks, and between letters and signs, if
the vocabulary is so. Parts are searched on their own, and repeated parts once while a worker remembers them. The N best of a whole text deviate from the
best only in the N - 1 parts whose second segmentation costs least, so lists of these parts are merged and all others keep their best.
Parts are merged to words. Of a text's words the best segmentation and the cost of the second are found without lists; lists are made
only of the N - 1 words with the least cost, and take their places among the others.

Scores are those of the vocabulary, so a segmentation's score is the sum over its pieces; a character without a piece costs the lowest
score of a piece and ``UNKNOWN_COST`` more. Of equal scores the one that the search meets first comes first, always the same for equal
text.

Defined results: a null or empty text has no pieces, score 0 and one segmentation; equal texts get equal results, row by row; ids may
be null or repeated. Decoding gives the text back exactly but for a literal space mark, which becomes a space, as in the library. Only
the id and the results come back, so other columns cannot clash.
"""

from __future__ import annotations

import gc
import heapq
from array import array
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildscope.llm.common import Remembered, chunks, tidy

SPACE = "▁"
UNKNOWN_COST = 10.0
# Parts and words that a worker remembers.
REMEMBERED = 100_000
# Parts and words whose N best a worker remembers, and the longest of them in characters.
LISTS, LONGEST = 20_000, 64
# Segmentations of each text in ``summarize``.
NBEST = 4
WORDS = regex.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
PARTS = regex.compile(rf"{SPACE}*\p{{L}}+|{SPACE}*[^\p{{L}}{SPACE}]+|{SPACE}+")
LETTER = regex.compile(r"\p{L}")
#: Below every score, and what a second segmentation costs where there is none.
NEVER, ALONE = float("-inf"), float("inf")


#: Length in characters, ids and score of a piece.
Arc = tuple[int, tuple[int, ...], float]
#: Score and ids of the best segmentation, and what the second costs.
Best = tuple[float, tuple[int, ...], float]


class Segmentation(NamedTuple):
    score: float
    ids: tuple[int, ...]


class Lattice:
    """Encodes and decodes with a sentencepiece model, N best segmentations at a time."""

    def __init__(self, path: str, nbest: int) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalize = sentencepiece.SentencePieceNormalizer(model_file=path).normalize
        self.nbest = nbest
        self.unknown = model.unk_id()
        self.pieces: list[str] = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes: dict[int, int] = {i: int(p[3:-1], 16) for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.byte_ids = {value: i for i, value in self.bytes.items()}
        self.finder = ahocorasick.Automaton()
        joined: set[str] = set()
        self.alone: set[str] = set()
        scores = []
        for i, piece in enumerate(self.pieces):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or i in self.bytes:
                continue
            score = float(model.get_score(i))
            scores.append(score)
            self.finder.add_word(piece, (len(piece), (i,), score))
            if len(piece) == 1:
                self.alone.add(piece)
            joined.update(a + b for a, b in zip(piece, piece[1:]))
        self.finder.make_automaton()
        self.unknown_score = min(s for s in scores if s > -1e8) - UNKNOWN_COST
        # Pieces that hold a space mark after something else would cross the cuts between words.
        self.by_word = not any(SPACE in p.lstrip(SPACE) for i, p in enumerate(self.pieces) if i not in self.bytes)
        # Whether the lattice falls apart between letters and other signs, too.
        self.apart = self.by_word and all(a == SPACE or bool(LETTER.match(a)) == bool(LETTER.match(b)) for a, b in joined)
        self.text = [p.replace(SPACE, " ") for p in self.pieces]
        self.parts = Remembered(self.part_best, REMEMBERED)
        self.words = Remembered(lambda word: self.word_best(SPACE + word), REMEMBERED)
        self.part_lists = Remembered(self.search, LISTS)
        self.word_lists = Remembered(self.word_list, LISTS)

    def arcs(self, part: str) -> tuple[list[float], list[list[Arc]]]:
        """Best score of every prefix, and the arcs that end at each place."""
        forward = [0.0] + [NEVER] * len(part)
        ending: list[list[Arc]] = [[] for _ in forward]
        if not self.alone.issuperset(part):
            for end, char in enumerate(part, 1):
                if char not in self.alone:
                    ids = tuple(self.byte_ids[b] for b in char.encode()) if self.byte_ids else (self.unknown,)
                    ending[end].append((1, ids, self.unknown_score))
            for last, arc in self.finder.iter(part):
                ending[last + 1].append(arc)
            for end in range(1, len(forward)):
                forward[end] = max(forward[end - length] + score for length, _, score in ending[end])
            return forward, ending
        # Occurrences come in the order of their ends, so every prefix they follow is known.
        for last, arc in self.finder.iter(part):
            end = last + 1
            ending[end].append(arc)
            total = forward[end - arc[0]] + arc[2]
            if total > forward[end]:
                forward[end] = total
        return forward, ending

    def search(self, part: str) -> list[Segmentation]:
        """The N best segmentations of a string, best first.

        Every open entry stands for the segmentations that end as it does and is worth exactly the best of them, so no more entries
        than segmentations still wanted are ever needed, and an entry's best child is worth as much as the entry: it is followed at
        once, its siblings are kept.
        """
        forward, ending = self.arcs(part)
        # Open entries, worst first: best total, place, gathered score, ids so far as a linked list.
        queue: list[tuple] = [(forward[-1], len(part), 0.0, None)]
        found: list[Segmentation] = []
        for spare in reversed(range(self.nbest)):
            if not queue:
                break
            _, place, gathered, tail = queue.pop()
            while place:
                best, highest = None, NEVER
                floor = queue[-spare][0] if 0 < spare <= len(queue) else NEVER
                for arc in ending[place]:
                    total = forward[place - arc[0]] + arc[2]
                    if best is None:
                        best, highest = arc, total
                        continue
                    if total > highest:
                        best, arc, highest, total = arc, best, total, highest
                    if spare and gathered + total > floor:
                        queue.append((gathered + total, place - arc[0], gathered + arc[2], (arc[1], tail)))
                        if len(queue) > 1:
                            queue.sort(key=_total)
                            del queue[:-spare]
                        floor = queue[-spare][0] if spare <= len(queue) else NEVER
                place -= best[0]
                gathered += best[2]
                tail = (best[1], tail)
            out: list[int] = []
            while tail is not None:
                out.extend(tail[0])
                tail = tail[1]
            found.append(Segmentation(gathered, tuple(out)))
        return found

    def merged(self, lists: list[list[Segmentation]]) -> list[Segmentation]:
        """The N best of all ways to take one segmentation of each list, in the order of the lists."""
        # The N - 1 lists whose second costs least, the first of equals.
        open_ = [i for i, x in enumerate(lists) if len(x) > 1]
        if len(open_) == 1:
            [at] = open_
            before, after = [x[0] for x in lists[:at]], [x[0] for x in lists[at + 1 :]]
            kept = sum(s.score for s in before) + sum(s.score for s in after)
            front, back = (tuple(chain.from_iterable(s.ids for s in run)) for run in (before, after))
            return [Segmentation(kept + c.score, front + c.ids + back) for c in lists[at][: self.nbest]]
        varied = sorted(heapq.nsmallest(self.nbest - 1, open_, key=lambda i: lists[i][0].score - lists[i][1].score))
        ways: list[tuple[float, tuple[Segmentation, ...]]] = [(0.0, ())]
        kept, runs, start = 0.0, [], 0
        for i in [*varied, len(lists)]:
            run = [x[0] for x in lists[start:i]]
            kept += sum(s.score for s in run)
            runs.append(tuple(chain.from_iterable(s.ids for s in run)))
            start = i + 1
        for i in varied:
            longer = ((score + c.score, taken + (c,)) for score, taken in ways for c in lists[i])
            ways = sorted(longer, key=_total, reverse=True)[: self.nbest]
        return [Segmentation(kept + score, runs[0] + tuple(chain.from_iterable(c.ids + run for c, run in zip(taken, runs[1:])))) for score, taken in ways]

    def cut(self, word: str) -> list[str]:
        """Parts of letters or of other signs, with the space marks before them."""
        return PARTS.findall(word) if self.apart else [word]

    def part_best(self, part: str) -> Best:
        """Score and ids of the best segmentation, and what the second costs.

        The search of ``search`` up to its first result. An open entry is worth exactly the best segmentation that it stands for, so
        the second's score is known then, without following it.
        """
        if not self.alone.issuperset(part):
            first, *others = self.search(part)
            return first.score, first.ids, first.score - others[0].score if others else ALONE
        # Best total of the prefix that ends at each character, the arc that gives it, and the total of the next best arc. The empty
        # prefix stands last, where index -1 finds it.
        size = len(part)
        forward, runner_up = [NEVER] * size + [0.0], [NEVER] * size
        arcs: list[Arc] = [(1, (), NEVER)] * size
        for last, arc in self.finder.iter(part):
            total = forward[last - arc[0]] + arc[2]
            highest = forward[last]
            if total > highest:
                runner_up[last], forward[last], arcs[last] = highest, total, arc
            elif total > runner_up[last]:
                runner_up[last] = total
        path: list[int] = []
        last, gathered, second = size - 1, 0.0, NEVER
        while last >= 0:
            other = gathered + runner_up[last]
            if other > second:
                second = other
            length, ids, score = arcs[last]
            path += ids
            gathered += score
            last -= length
        path.reverse()  # one id for each arc, as every character is a piece
        return gathered, tuple(path), gathered - second if second > NEVER else ALONE

    def word_best(self, word: str) -> Best:
        """Score and ids of the best segmentation of some parts, and what the second costs."""
        parts = self.cut(word)
        if len(parts) == 1:
            return self.parts[parts[0]]
        score, ids, gap = 0.0, (), ALONE
        for own_score, own_ids, own_gap in map(self.parts.__getitem__, parts):
            score += own_score
            ids += own_ids
            if own_gap < gap:
                gap = own_gap
        return score, ids, gap

    def words_of(self, text: str) -> tuple[list[str], str, list[Best]]:
        """The words of a text, what stands before each, and what ``word_best`` says of them."""
        normal = self.normalize(text)
        if not normal:
            return [], "", []
        if self.by_word and normal[0] == SPACE and SPACE * 2 not in normal and normal[-1] != SPACE:
            bare = normal.split(SPACE)[1:]
            return bare, SPACE, list(map(self.words.__getitem__, bare))
        words = WORDS.findall(normal) if self.by_word else [normal]
        return words, "", list(map(self.word_best, words))

    def best(self, text: str) -> tuple[float, array, float | None]:
        """Score and ids of the best segmentation, and the score of the second where there is one."""
        *_, found = self.words_of(text)
        scores, ids, gaps = zip(*found) if found else ((), (), ())
        score, gap = sum(scores), min(gaps, default=ALONE)
        return score, array("i", chain.from_iterable(ids)), None if gap == ALONE else score - gap

    def part_list(self, part: str) -> list[Segmentation]:
        return self.part_lists[part] if len(part) <= LONGEST else self.search(part)

    def word_list(self, word: str) -> list[Segmentation]:
        """The N best segmentations of some parts."""
        parts = self.cut(word)
        return self.part_list(parts[0]) if len(parts) == 1 else self.merged(list(map(self.part_list, parts)))

    def encode(self, text: str) -> list[Segmentation]:
        """The N best segmentations of a whole text.

        All words take their best but for the N - 1 whose second segmentation costs least: only of these lists are made, and the N
        best choices from the lists take the places of these words among the others.
        """
        words, before, found = self.words_of(text)
        scores, ids, gaps = zip(*found) if found else ((), (), ())
        cheapest = heapq.nsmallest(self.nbest - 1, range(len(gaps)), key=gaps.__getitem__)
        varied = sorted(i for i in cheapest if gaps[i] < ALONE)
        ways: list[tuple[float, tuple[Segmentation, ...]]] = [(0.0, ())]
        kept, runs, start = sum(scores), [], 0
        for i in varied:
            word = before + words[i]
            choices = self.word_lists[word] if len(word) <= LONGEST else self.word_list(word)
            longer = ((score + c.score, taken + (c,)) for score, taken in ways for c in choices)
            ways = sorted(longer, key=_total, reverse=True)[: self.nbest]
            kept -= scores[i]
            runs.append(tuple(chain.from_iterable(ids[start:i])))
            start = i + 1
        runs.append(tuple(chain.from_iterable(ids[start:])))
        out = []
        for score, taken in ways:
            whole = runs[0]
            for choice, run in zip(taken, runs[1:]):
                whole += choice.ids + run
            out.append(Segmentation(kept + score, whole))
        return out

    def forget(self) -> None:
        """Give back what was remembered."""
        for known in (self.parts, self.words, self.part_lists, self.word_lists):
            known.forget()

    def decode(self, ids) -> str:
        if self.bytes.keys().isdisjoint(ids):
            text = "".join(map(self.text.__getitem__, ids))
        else:
            parts, held = [], bytearray()
            for i in ids:
                if i in self.bytes:
                    held.append(self.bytes[i])
                    continue
                parts.append(held.decode(errors="replace"))
                held.clear()
                parts.append(self.text[i])
            text = "".join(parts) + held.decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


def _total(entry: tuple) -> float:
    return entry[0]


_lattices: dict[tuple[str, int], Lattice] = {}


def lattice(path: str, nbest: int) -> Lattice:
    """One lattice for each worker, model file and N."""
    if (path, nbest) not in _lattices:
        _lattices[path, nbest] = Lattice(path, nbest)
    return _lattices[path, nbest]


def _mapped(docs: DataFrame, id_col: str, text_col: str, schema: str, judge) -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What a worker remembers are many small tuples without cycles; looking for cycles in them takes a fifth of the time. The
        # worker is left as it was: other tasks run in it.
        before = gc.get_threshold()
        gc.freeze()
        gc.set_threshold(200_000, 20, 100)
        try:
            for batch in chunks(batches):
                names, columns = judge(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", *names])
        finally:
            for own in _lattices.values():
                own.forget()
            gc.set_threshold(*before)
            gc.unfreeze()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), f"id {id_type}, {schema}").withColumnRenamed("id", id_col)


def summarize(docs: DataFrame, model: str, nbest: int = NBEST, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, pieces, score and digest of the ids of the best segmentation, score of the second, whether decoding gives the text back, and
    the scores and digests of all ``nbest`` segmentations, best first."""

    def judge(texts: list[str | None]):
        own = lattice(model, nbest)
        rows = []
        for text in texts:
            found = own.encode(text or "")
            scores = [s.score for s in found]
            digests = [sha256(array("i", s.ids).tobytes()).hexdigest() for s in found]
            second = scores[1] if len(scores) > 1 else None
            rows.append((len(found[0].ids), scores[0], second, digests[0], own.decode(found[0].ids) == (text or ""), scores, digests))
        kinds = {"n_pieces": pa.int64(), "score": pa.float64(), "second_score": pa.float64(), "ids_sha256": pa.string(), "round_trip": pa.bool_()}
        kinds |= {"nbest_scores": pa.list_(pa.float64()), "nbest_sha256": pa.list_(pa.string())}
        return kinds, [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())]

    best = "n_pieces long, score double, second_score double, ids_sha256 string, round_trip boolean"
    return _mapped(docs, id_col, text_col, f"{best}, nbest_scores array<double>, nbest_sha256 array<string>", judge)


def encode(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the ids of the best segmentation."""

    def judge(texts: list[str | None]):
        own = lattice(model, 2)
        found = [own.best(text or "")[1] for text in texts]
        return ["ids"], [pa.array(found, pa.list_(pa.int32()))]

    return _mapped(docs, id_col, text_col, "ids array<int>", judge)


def encode_nbest(docs: DataFrame, model: str, nbest: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the ``nbest`` segmentations, array<struct<score, ids>>, best first."""
    kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))

    def judge(texts: list[str | None]):
        own = lattice(model, nbest)
        return ["segmentations"], [pa.array([[s._asdict() for s in own.encode(text or "")] for text in texts], kind)]

    return _mapped(docs, id_col, text_col, "segmentations array<struct<score:double,ids:array<int>>>", judge)


def decode(encoded: DataFrame, model: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text for rows of ids; null ids decode to the empty text."""
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model, 2)
        for batch in batches:
            texts = [own.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {id_type}, text string").withColumnRenamed("id", id_col)
