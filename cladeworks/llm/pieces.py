"""SentencePiece encoding and decoding with a given vocabulary, by a shared-prefix forward pass.

A text is marked (a leading space, every space written as U+2581) and cut into
marked words; no piece crosses such a cut. The distinct words of a slice of
texts are sorted, which is the depth-first order of their trie, and one
forward table is kept on a stack: a word reuses the entries of the prefix that
it shares with the word before and only adds its own characters.

The public vocabulary is a BPE model, so an entry holds what BPE needs instead
of a summed score: the last piece of the encoding of that prefix. For each
prefix exactly one piece can stand last: the one that BPE keeps apart from the
last piece of the prefix before it. That makes the pass exact (a Viterbi pass
over summed scores would segment differently from the library).

Scale: no shuffle; a worker keeps bounded caches. The driver reads the model
file once and broadcasts its table, which has a fixed size.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.llm.common import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words and pairs that a worker remembers before it starts afresh.
CACHE = 250_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces that may be merged with id and score, the 256 byte ids, and every id's bytes."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: tuple[int, ...]
    raw: tuple[bytes, ...]
    #: Lengths over 1 of the pieces that end in these (up to) three characters, shortest (most often right) first.
    ends: dict[str, tuple[int, ...]]
    cut: str


def load(path: str = MODEL) -> Vocabulary:
    """Read a SentencePiece model of type BPE with byte fallback and no text normalisation."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, scores, raw, byte_ids = {}, {}, [], [-1] * 256
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            raw.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            raw.append(b"")
        else:
            ids[piece], scores[piece] = i, model.get_score(i)
            raw.append(piece.replace(MARK, " ").encode())
    if min(byte_ids) < 0:
        raise ValueError(f"{path} has no byte fallback")
    if any(MARK in p.lstrip(MARK) for p in ids):
        raise ValueError(f"{path} has pieces that cross words")
    lone = "" if any("\n" in p for p in ids) else "\n"  # a line feed that no piece has cuts words as well
    cut = f"{MARK}*[^{MARK}{lone}]+|{MARK}+" + (f"|{lone}" if lone else "")
    ends: dict[str, set[int]] = {}
    for p in ids:
        if len(p) > 1:
            ends.setdefault(p[-3:], set()).add(len(p))
    for tail, sizes in ends.items():  # a piece of two characters also ends longer tails
        if len(tail) == 3 and tail[1:] in ids:
            sizes.add(2)
    return Vocabulary(ids, scores, tuple(byte_ids), tuple(raw), {t: tuple(sorted(s)) for t, s in ends.items()}, cut)


@dataclass
class Encoder:
    vocabulary: Vocabulary
    words: dict[str, tuple[int, ...]] = field(default_factory=dict)
    older: dict[str, tuple[int, ...]] = field(default_factory=dict)
    pairs: dict[tuple[str, str], bool] = field(default_factory=dict)
    halves: dict[str, tuple[str, str] | None] = field(default_factory=dict)

    def merge(self, text: str, last: bool = False) -> list[str]:
        """BPE of a text by merging the best adjacent pair (highest score, then leftmost) again and again.

        With ``last``, a merge that would leave one piece is not done.
        """
        scores = self.vocabulary.scores
        piece: list[str | None] = list(text)
        after, before = list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))
        heap = [(-scores[p], i, p) for i in range(len(piece) - 1) if (p := piece[i] + piece[i + 1]) in scores]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i]
            if piece[i] is None or j >= len(piece) or piece[i] + piece[j] != p:
                continue
            if last and len(p) == len(text):
                break
            piece[i], piece[j], after[i] = p, None, after[j]
            if after[i] < len(piece):
                before[after[i]] = i
                if (q := p + piece[after[i]]) in scores:
                    heapq.heappush(heap, (-scores[q], i, q))
            if before[i] >= 0 and (q := piece[before[i]] + p) in scores:
                heapq.heappush(heap, (-scores[q], before[i], q))
        return [p for p in piece if p is not None]

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes ``piece``; None for one character or a piece that BPE never makes."""
        if piece not in self.halves:
            found = None
            for i in range(1, len(piece)):
                left, right = piece[:i], piece[i:]
                if all(len(x) == 1 or x in self.vocabulary.ids for x in (left, right)) and self.merge(piece, last=True) == [left, right]:
                    found = left, right
            self.halves[piece] = found
        return self.halves[piece]

    def _made(self, piece: str) -> bool:
        return len(piece) == 1 or self._halves(piece) is not None

    def _apart(self, left: str, right: str) -> bool:
        """Whether BPE of left + right keeps these two pieces.

        The merges that made them are undone from the latest back. What stands
        on either side of the border at some time would have merged across it
        if that merge is better than the one that was undone last.
        """
        found = self.pairs.get((left, right))
        if found is not None:
            return found
        if len(self.pairs) > CACHE:
            self.pairs.clear()
        scores, a, b, found = self.vocabulary.scores, left, right, True
        limit, ties = -float("inf"), True
        while True:
            across = scores.get(a + b)
            if across is not None and (across > limit or across == limit and ties):
                found = False
                break
            x, y = self._halves(a), self._halves(b)
            if x is None and y is None:
                break
            if y is None or x is not None and scores[a] < scores[b]:
                limit, ties, a = scores[a], False, x[1]
            else:
                limit, ties, b = scores[b], True, y[0]
        self.pairs[left, right] = found
        return found

    def _ids(self, pieces: list[str]) -> tuple[int, ...]:
        v = self.vocabulary
        return tuple(chain.from_iterable((v.ids[p],) if p in v.ids else [v.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")] for p in pieces))

    def learn(self, words: set[str]) -> None:
        """Add the encodings of distinct marked words to ``self.words``."""
        known, ends, pairs = self.vocabulary.ids, self.vocabulary.ends, self.pairs
        last: list[str] = []  # last[i]: the last piece of the encoding of word[: i + 1]
        prior = ""
        for word in sorted(words):
            if word.startswith(MARK * 2):  # runs of marks tie in score, which only merging in order settles
                self.words[word] = self._ids(self.merge(word))
                continue
            shared, most = 0, min(len(word), len(prior))
            while shared < most and word[shared] == prior[shared]:
                shared += 1
            del last[shared:]
            for end in range(shared + 1, len(word) + 1):
                for size in ends.get(word[end - 3 : end] if end > 3 else word[:end], (2,)):
                    if size < end:
                        piece = word[end - size : end]
                        if piece in known:
                            left = last[end - size - 1]
                            kept = pairs.get((left, piece))
                            if kept or kept is None and self._apart(left, piece):
                                last.append(piece)
                                break
                    elif size == end and word[:end] in known and self._made(word[:end]):
                        last.append(word[:end])
                        break
                else:
                    last.append(word[end - 1])
            prior, at, pieces = word, len(word), []
            while at:
                pieces.append(last[at - 1])
                at -= len(pieces[-1])
            self.words[word] = self._ids(pieces[::-1])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        find = re.compile(self.vocabulary.cut, re.DOTALL).findall
        cut = [find((MARK + t).replace(" ", MARK)) if t else [] for t in texts]
        if len(self.words) > CACHE:  # the older half goes, what is used again comes back into the younger one
            self.older, self.words = self.words, {}
        asked = set().union(*cut) - self.words.keys()
        known = asked & self.older.keys()
        self.words.update((w, self.older[w]) for w in known)
        self.learn(asked - known)
        look = self.words.__getitem__
        return [np.fromiter(chain.from_iterable(map(look, words)), np.int32) for words in cut]


def decode_ids(ids: list[int], vocabulary: Vocabulary) -> str:
    """The text of piece ids; the mark that encoding puts in front is taken off again."""
    raw = b"".join([vocabulary.raw[i] for i in ids])
    return raw.removeprefix(b" ").decode("utf-8", "replace")


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)``: one row per row of ``docs``, whole texts.

    Null and empty texts have no ids. Characters outside the vocabulary are
    spelt in bytes. U+2581 is a space to this format. Other columns are
    ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for part in slices(batch):
                got = encoder.encode(part.column(1).to_pylist())
                ends = np.cumsum([0, *map(len, got)], dtype=np.int32)
                flat = np.concatenate(got) if got else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``(doc_id, ids, text)`` from ``(doc_id, ids)``; null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = np.array(shared.value.raw, dtype=object)
        for batch in batches:
            for part in slices(batch):
                column = part.column(1)
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]).tolist()
                flat = column.flatten().to_numpy()  # of this slice only
                texts = [b"".join(raw[flat[a:b]].tolist()).removeprefix(b" ").decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, text string")


def encode_and_decode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``(doc_id, ids, n_tokens, n_chars, decoded_sha256)``: encoded, then decoded from the ids alone."""
    back = decode(encode(docs, model), model)
    return back.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("decoded_sha256")
    )
