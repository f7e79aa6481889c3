"""N-best segmentation into sentence pieces, and its inverse.

Texts are encoded over the lattice of all vocabulary pieces. A forward Viterbi pass gives the best
score up to every place; these scores are exact heuristics for an A-star search from the end back,
which therefore meets complete segmentations in falling order of score.

No piece crosses from a character other than a space to a space, nor from a letter to most marks
(found out when a vocabulary is read), so the lattice of a text is a chain of small ones, a space
run and a word or the end of one each. Words are
remembered by the task, and those that it does not know yet go through the forward pass together,
one place of all of them at a time. The N best of a text are the N best sums over its words, and
only the words with the N - 1 smallest gaps between best and second can take part in them.

The vocabulary file holds byte-pair ranks, no probabilities, so a piece scores by Zipf's law of
its rank. Characters without a piece become UTF-8 bytes; decoding restores every text exactly.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddwire.llm import words

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 3
ZIPF_OFFSET = 2.7
#: Less than the rarest piece, for each byte of a character without one.
BYTE_PENALTY = 5.0
#: Words a worker remembers at least, at most twice as many; and the longest of them.
REMEMBERED = 80_000
REMEMBERED_LENGTH = 64
#: Words that go through the forward pass together at most; fewer than the least go one by one.
TOGETHER, LEAST_TOGETHER = 4096, 32

_LEAST = -math.inf
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: No character, and part of no piece.
_BETWEEN = 0x1FFFFF


class Vocabulary:
    """Pieces by surface, with spaces for the file's space mark, and all their prefixes."""

    def __init__(self, model: str):
        processor = sentencepiece.SentencePieceProcessor(model_file=model)
        size = processor.get_piece_size()
        special = [
            processor.is_control(k) or processor.is_unknown(k) or processor.is_unused(k)
            for k in range(size)
        ]
        self.bytes = [processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        plain = [k for k in range(size) if not special[k] and not processor.is_byte(k)]
        total = math.log(sum(1 / (rank + ZIPF_OFFSET) for rank in range(len(plain))))
        #: Trie of the surfaces: by character a node [score, ids or None, further characters].
        self.trie: dict[str, list] = {}
        self.surfaces: dict[int, bytes] = {k: bytes([b]) for b, k in enumerate(self.bytes)}
        breaks, marks = False, set(".,!?;:%&#$*)")
        for rank, k in enumerate(plain):
            surface = processor.id_to_piece(k).replace("▁", " ")
            self._add(surface, -math.log(rank + ZIPF_OFFSET) - total, k)
            self.surfaces[k] = surface.encode()
            breaks |= "\n" in surface
            marks -= {b for a, b in zip(surface, surface[1:]) if a.isalpha()}
            if " " in surface.lstrip(" "):
                raise ValueError(f"piece {surface!r} crosses into a space")
        self.byte_score = -math.log(len(plain) + ZIPF_OFFSET) - total - BYTE_PENALTY
        ends = "".join(map(re.escape, sorted(marks)))
        letters = rf" *[^\W\d_]+(?=[{ends}])|" if marks else ""
        self.words = re.compile(letters + (" *[^ ]+| +" if breaks else " *[^ \n]+| +|\n"))
        self.table = words.arrow([self.surfaces.get(k, b"") for k in range(size)], pa.binary())
        self._number_nodes()

    def _add(self, surface: str, score: float, piece: int) -> None:
        nodes = self.trie
        for character in surface:
            node = nodes.setdefault(character, [0.0, None, {}])
            nodes = node[2]
        node[:2] = [score, (piece,)]

    def arcs(self, word: str, start: int) -> Iterator[tuple[int, float, tuple[int, ...]]]:
        """(end, score, ids) of every arc of the lattice from a place."""
        nodes = self.trie
        if nodes.get(word[start], (0.0, None))[1] is None:
            yield start + 1, *self.as_bytes(word[start])
        for end in range(start, len(word)):
            found = nodes.get(word[end])
            if found is None:
                return
            score, ids, nodes = found
            if ids:
                yield end + 1, score, ids

    def as_bytes(self, character: str) -> tuple[float, tuple[int, ...]]:
        data = character.encode("utf-8", "surrogatepass")
        return self.byte_score * len(data), tuple(self.bytes[b] for b in data)

    def forward(self, word: str) -> tuple[bytes, float, float]:
        """The best segmentation as packed ids, its score, and how far the second is behind."""
        size = len(word)
        best, second = [_LEAST] * (size + 1), [_LEAST] * (size + 1)
        back: list = [None] * (size + 1)
        best[0] = 0.0
        trie = self.trie
        for start, character in enumerate(word):
            first, other, end = best[start], second[start], start
            found = trie.get(character)
            if found is None or found[1] is None:
                found = [*self.as_bytes(character), found[2] if found else {}]
            while found:
                score, ids, nodes = found
                end += 1
                if ids:
                    value = first + score
                    top = best[end]
                    if value > top:
                        rest = other + score
                        second[end] = top if top > rest else rest
                        best[end] = value
                        back[end] = (start, ids)
                    elif value > second[end]:
                        second[end] = value
                if end == size:
                    break
                found = nodes.get(word[end])
        ids = []
        at = size
        while at:
            at, piece = back[at]
            ids.append(piece)
        ids.reverse()
        return packed(chain.from_iterable(ids)), best[size], best[size] - second[size]

    def _number_nodes(self) -> None:
        """The trie as arrays: score and id (-1: none) by node, and a hash table of the steps.

        A step is a node's number and a character, in one number; a slot holds a step and its end.
        """
        steps, scores, ids = [], [0.0], [-1]
        open_ = [(0, self.trie)]
        for node, further in open_:
            for character, (score, own, nodes) in further.items():
                steps.append(node << 21 | ord(character))
                open_.append((len(scores), nodes))
                scores.append(score)
                ids.append(own[0] if own else -1)
        self.node_scores, self.node_ids = np.array(scores), np.array(ids, np.int32)
        self.log2_slots = (2 * len(steps)).bit_length()
        self.steps = np.full(1 << self.log2_slots, -1, np.int64)
        self.step_ends = np.zeros(1 << self.log2_slots, np.int64)
        left = np.array(steps, np.int64)
        ends = np.arange(1, len(scores))
        slots = self._slots(left)
        while len(left):
            free = self.steps[slots] == -1
            self.steps[slots[free]] = left[free]
            placed = self.steps[slots] == left
            self.step_ends[slots[placed]] = ends[placed]
            left, ends = left[~placed], ends[~placed]
            slots = (slots[~placed] + 1) % len(self.steps)

    def _slots(self, steps: np.ndarray) -> np.ndarray:
        return (steps.view(np.uint64) * _SPREAD >> np.uint64(64 - self.log2_slots)).view(np.int64)

    def _further(self, nodes: np.ndarray, characters: np.ndarray) -> np.ndarray:
        """The node that each one's character leads to, or -1."""
        steps = nodes << 21 | characters
        slots = self._slots(steps)
        held = self.steps[slots]
        found = np.where(held == steps, self.step_ends[slots], -1)
        open_ = np.flatnonzero((held != steps) & (held != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) % len(self.steps)
            held = self.steps[slots[open_]]
            same = held == steps[open_]
            found[open_[same]] = self.step_ends[slots[open_[same]]]
            open_ = open_[~same & (held != -1)]
        return found

    def _all_arcs(self, characters: np.ndarray) -> tuple[np.ndarray, ...]:
        """Start, end, score and id (-1: the bytes of a character) of each arc of many words, which
        lie one after the other with ``_BETWEEN`` behind each."""
        starts = np.flatnonzero(characters != _BETWEEN)
        own = characters[starts]
        nodes = self._further(np.zeros(len(starts), np.int64), own)
        ids = np.where(nodes >= 0, self.node_ids[nodes], -1)
        utf8 = 1 + (own > 0x7F) + (own > 0x7FF) + (own > 0xFFFF)
        scores = np.where(ids >= 0, self.node_scores[nodes], self.byte_score * utf8)
        found = [(starts, starts + 1, scores, ids)]
        ends = starts
        while len(starts):
            on = np.flatnonzero(nodes >= 0)
            starts, ends, nodes = starts[on], ends[on] + 1, nodes[on]
            nodes = self._further(nodes, characters[ends])
            ids = np.where(nodes >= 0, self.node_ids[nodes], -1)
            on = np.flatnonzero(ids >= 0)
            found.append((starts[on], ends[on] + 1, self.node_scores[nodes[on]], ids[on]))
        return tuple(map(np.concatenate, zip(*found)))

    def forward_together(self, cut: list[str]) -> list[tuple[bytes, float, float]]:
        """What ``forward`` gives for each of many words, by the same sums in the same order."""
        sizes = np.array([len(word) for word in cut])
        lasts = np.cumsum(sizes + 1) - 1
        firsts = lasts - sizes
        text = "".join(cut).encode("utf-32-le", "surrogatepass")
        characters = np.full(int(lasts[-1]) + 1, _BETWEEN)
        inside = np.ones(len(characters), bool)
        inside[lasts] = False
        characters[inside] = np.frombuffer(text, np.uint32)
        starts, ends, scores, ids = self._all_arcs(characters)
        # arcs by their place in the word; those of one place have different ends
        places = (np.arange(len(characters)) - np.repeat(firsts, sizes + 1))[starts]
        order = np.argsort(places, kind="stable")
        starts, ends, scores, ids = starts[order], ends[order], scores[order], ids[order]
        best, second = np.full((2, len(characters)), _LEAST)
        best[firsts] = 0.0
        back = np.zeros(len(characters), np.int64)
        at = 0
        for stop in np.cumsum(np.bincount(places)).tolist():
            here, to, score = starts[at:stop], ends[at:stop], scores[at:stop]
            value, rest = best[here] + score, second[here] + score
            top = best[to]
            better = value > top
            rest = np.where(better, np.maximum(top, rest), np.maximum(second[to], value))
            second[to] = rest
            best[to] = np.where(better, value, top)
            on = np.flatnonzero(better)
            back[to[on]] = at + on
            at = stop
        packed_ids, counts, spelt = self._paths(firsts, lasts, back, starts, ids)
        stops = (4 * np.cumsum(counts)).tolist()
        reached = best[lasts]
        gaps = reached - second[lasts]
        found = [
            (packed_ids[begin:stop], score, gap)
            for begin, stop, score, gap in zip([0, *stops], stops, reached.tolist(), gaps.tolist())
        ]
        for k in np.flatnonzero(spelt).tolist():
            found[k] = self.forward(cut[k])
        return found

    @staticmethod
    def _paths(firsts, lasts, back, starts, ids) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Ids on the best paths of all words, how many each has, and which words need bytes."""
        rows, at = np.arange(len(firsts)), lasts
        counts, spelt = np.zeros(len(firsts), np.int64), np.zeros(len(firsts), bool)
        taken = []
        while len(rows):
            arc = back[at]
            taken.append((rows, ids[arc]))
            counts[rows] += 1
            spelt[rows[ids[arc] < 0]] = True
            at = starts[arc]
            on = np.flatnonzero(at > firsts[rows])
            rows, at = rows[on], at[on]
        last = np.cumsum(counts) - 1
        made = np.zeros(int(last[-1]) + 1, np.int32)
        for step, (rows, own) in enumerate(taken):
            made[last[rows] - step] = own
        return made.tobytes(), counts, spelt

    def n_best(self, word: str, count: int) -> list[tuple[float, tuple[int, ...]]]:
        """The best segmentations of a word by A-star from its end, in falling order of score.

        With exact heuristics every entry of the agenda is the score of a real segmentation, so no
        more entries than segmentations still wanted need to be kept.
        """
        size = len(word)
        reach = [_LEAST] * (size + 1)
        reach[0] = 0.0
        into: list[list] = [[] for _ in range(size + 1)]
        for start in range(size):
            for end, score, ids in self.arcs(word, start):
                into[end].append((start, score, ids))
                reach[end] = max(reach[end], reach[start] + score)
        agenda: list = [(-reach[size], 0, size, 0.0, None)]
        serial, found = 0, []
        while agenda and len(found) < count:
            _, _, at, behind, path = heapq.heappop(agenda)
            if at == 0:
                ids = []
                while path is not None:
                    ids.extend(path[0])
                    path = path[1]
                found.append((behind, tuple(ids)))
                continue
            for start, score, ids in into[at]:
                serial += 1
                total = behind + score
                entry = (-(total + reach[start]), serial, start, total, (ids, path))
                heapq.heappush(agenda, entry)
            if len(agenda) > 8 * count:
                agenda = heapq.nsmallest(count - len(found), agenda)
        return found

    def decode(self, ids: pa.ListArray) -> list[str | None]:
        """The texts of lists of ids; the space put before a text is taken off."""
        return [
            text.decode("utf-8", "surrogatepass") if valid else None
            for text, valid in zip(self._surfaces(ids), ids.is_valid().to_pylist())
        ]

    def restored(self, ids: pa.ListArray, counts: list[int], texts: list[bytes]) -> list[bool]:
        """Whether decoding gives each text back from every one of its next ``counts`` lists."""
        found = self._surfaces(ids)
        return [
            all([next(found) == text for _ in range(count)]) for count, text in zip(counts, texts)
        ]

    def _surfaces(self, ids: pa.ListArray) -> Iterator[bytes]:
        flat = self.table.take(ids.values)
        ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset :]
        data = memoryview(flat.buffers()[2]) if flat.buffers()[2] is not None else b""
        at = ends[ids.offsets.to_numpy()]
        for a, b in zip(at, at[1:]):
            yield bytes(data[a + 1 : b])


def packed(ids) -> bytes:
    return array("i", ids).tobytes()


class Encoder(dict):
    """Best segmentation by word, filled as words are met."""

    def __init__(self, vocabulary: Vocabulary, count: int, remembered: int):
        super().__init__()
        self.vocabulary, self.count, self.remembered = vocabulary, count, remembered
        self.older: dict = {}
        self.several: dict[str, list] = {}

    def __missing__(self, word: str):
        found = self.older.get(word) or self.vocabulary.forward(word)
        if len(word) <= REMEMBERED_LENGTH:
            self.remember(word, found)
        return found

    def remember(self, word: str, found: tuple) -> None:
        if len(self) >= self.remembered:
            self.older = dict(self)
            self.clear()
        self[word] = found

    def cut(self, text: str) -> list[str]:
        """The words of a text with a space before it; an empty text has none."""
        return self.vocabulary.words.findall(" " + text) if text else []

    def learn(self, cuts: list[list[str]]) -> None:
        """Segment the words of some texts that are not known yet, many together."""
        new = [
            word
            for word in set().union(*cuts)
            if word not in self and word not in self.older and len(word) <= REMEMBERED_LENGTH
        ]
        for start in range(0, len(new), TOGETHER):
            some = new[start : start + TOGETHER]
            if len(some) >= LEAST_TOGETHER:
                for word, found in zip(some, self.vocabulary.forward_together(some)):
                    self.remember(word, found)

    def forget(self) -> None:
        """Keep the words of the last stretch alone; what other tasks use lies in the same memory."""
        self.older = {}
        self.several.clear()
        words.give_back()

    def alternatives(self, word: str) -> list[tuple[float, bytes]]:
        found = self.several.get(word)
        if found is None:
            found = [(s, packed(ids)) for s, ids in self.vocabulary.n_best(word, self.count)]
            if len(self.several) >= self.remembered // 10:
                self.several.clear()
            if len(word) <= REMEMBERED_LENGTH:
                self.several[word] = found
        return found

    def encode(self, text: str, every: bool = True) -> tuple[list[float], list[bytes]]:
        """Scores of the N best segmentations of a text, and the packed ids of each (of the best
        alone without ``every``). An empty text has one, without pieces."""
        return self.encode_words(self.cut(text), every)

    def encode_words(self, cut: list[str], every: bool = True) -> tuple[list[float], list[bytes]]:
        if not cut:
            return [0.0], [b""]
        found = [self[word] for word in cut]
        ids, gaps = [own[0] for own in found], [own[2] for own in found]
        score = sum([own[1] for own in found])
        close = []
        while len(close) < self.count - 1 and (gap := min(gaps)) < math.inf:
            close.append(gaps.index(gap))
            gaps[close[-1]] = math.inf
        options = [self.alternatives(cut[i]) for i in close]
        losses = [[o[0][0] - s for s, _ in o] for o in options]
        sums = _smallest_sums(losses, self.count)
        made = []
        for _, ranks in sums if every else sums[:1]:
            for k, (i, rank) in enumerate(zip(close, ranks)):
                ids[i] = options[k][rank][1]
            made.append(b"".join(ids))
        return [score - loss for loss, _ in sums], made


@lru_cache(maxsize=2)
def encoder(model: str, count: int, remembered: int = REMEMBERED) -> Encoder:
    """One for the tasks of a worker, so that words stay known until other operators use it."""
    return Encoder(Vocabulary(model), count, remembered)


def _smallest_sums(losses: list[list[float]], count: int) -> list[tuple[float, tuple[int, ...]]]:
    """The smallest sums of one number of each rising list, with the places chosen."""
    first = (0,) * len(losses)
    agenda, seen, found = [(0.0, first)], {first}, []
    while agenda and len(found) < count:
        total, ranks = heapq.heappop(agenda)
        found.append((total, ranks))
        for k, losses_k in enumerate(losses):
            if ranks[k] + 1 < len(losses_k):
                further = ranks[:k] + (ranks[k] + 1,) + ranks[k + 1 :]
                if further not in seen:
                    seen.add(further)
                    more = losses_k[ranks[k] + 1] - losses_k[ranks[k]]
                    heapq.heappush(agenda, (total + more, further))
    return found


def encode(
    docs: DataFrame,
    model: str = MODEL,
    count: int = N_BEST,
    all_ids: bool = False,
    verify: bool = False,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """All columns of the documents with ``ids`` (the best segmentation) and ``scores`` (N best,
    falling); with ``all_ids`` also ``alternatives``, the ids of each of the N best; with
    ``verify`` also ``restored``, whether decoding in the same task gives the text back from the
    ids and from all alternatives that are returned. A worker remembers ``remembered`` words, at
    most twice as many: 300 bytes each, for time alone.

    Null and empty texts have no ids and the score 0. A short text has fewer segmentations than
    asked for. Columns of these names are replaced; rows are treated one by one.
    """
    docs = docs.drop("ids", "scores", "alternatives", "restored")
    added = [T.StructField("scores", T.ArrayType(T.DoubleType()))]
    if not all_ids:
        added.insert(0, T.StructField("ids", T.ArrayType(T.IntegerType())))
    else:
        added.append(T.StructField("alternatives", T.ArrayType(T.ArrayType(T.IntegerType()))))
    if verify:
        added.append(T.StructField("restored", T.BooleanType()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model, count, remembered)
        words.keep("encoder", encoder.cache_clear)
        for batch in batches:
            for part in _slices(batch):
                scores, ids = [], []
                texts = [text.tobytes() for text in words.raw_texts(part.column("text"))]
                for some in _groups(texts):
                    cuts = [own.cut(text.decode("utf-8", "surrogatepass")) for text in some]
                    own.learn(cuts)
                    for cut in cuts:
                        own_scores, own_ids = own.encode_words(cut, all_ids)
                        scores.append(own_scores)
                        ids.append(own_ids)
                counts = [len(own_ids) for own_ids in ids]
                made = _id_lists([i for own_ids in ids for i in own_ids])
                if not all_ids:
                    part = part.append_column("ids", made)
                part = part.append_column("scores", words.arrow(scores, pa.list_(pa.float64())))
                if all_ids:
                    ends = words.arrow(np.cumsum([0, *counts], dtype=np.int32))
                    part = part.append_column("alternatives", pa.ListArray.from_arrays(ends, made))
                if verify:
                    restored = own.vocabulary.restored(made, counts, texts)
                    part = part.append_column("restored", words.arrow(restored, pa.bool_()))
                yield part
        own.forget()

    encoded = docs.mapInArrow(task, T.StructType([*docs.schema.fields, *added]))
    return encoded.withColumn("ids", F.get("alternatives", F.lit(0))) if all_ids else encoded


def _id_lists(rows: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(r) // 4 for r in rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(words.arrow(ends), words.arrow(np.frombuffer(b"".join(rows), "i4")))


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that a batch and its ids are never held twice."""
    for start in range(0, len(batch), rows):
        yield batch.slice(start, rows)


def _groups(texts: list[bytes], size: int = 1 << 17) -> Iterator[list[bytes]]:
    """Texts of ``size`` bytes together at most, or one longer text: all words of a group are held."""
    some, held = [], 0
    for text in texts:
        if some and held + len(text) > size:
            yield some
            some, held = [], 0
        some.append(text)
        held += len(text)
    if some:
        yield some


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """All columns with ``decoded``, the text of ``ids``; null ids give a null."""
    encoded = encoded.drop("decoded")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder(model, N_BEST).vocabulary
        words.keep("encoder", encoder.cache_clear)
        for batch in batches:
            for part in _slices(batch):
                texts = vocabulary.decode(part.column("ids"))
                yield part.append_column("decoded", words.arrow(texts, pa.string()))

    field = T.StructField("decoded", T.StringType())
    return encoded.mapInArrow(task, T.StructType([*encoded.schema.fields, field]))
