"""SentencePiece encoding and decoding of merge-type models by a prefix table.

Merging always joins the adjacent pair whose union has the best score. Its result for a prefix
of a text ends in one certain piece, and a piece is that one if it is a result of merging by
itself and goes together with the last piece of the prefix before it, that is if merging their
concatenation gives back the two. So one pass over the matches of an automaton of all pieces
fills a table with the last piece of every prefix, and the ids are read from it backwards.
Whether two pieces go together is worked out once per pair.

Pieces hold the space sign only at their start, so a text is encoded word by word, and a word
seen before is looked up. A character outside the vocabulary parts its surroundings and becomes
its bytes. Runs of the space sign, whose pieces all have one score, are merged step by step.

Cases: NULL is encoded as an empty text: the begin and the end id alone. Texts of any length and
words of any length take time in proportion to their length. Repeated rows are encoded each.
"""

import hashlib
import heapq
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.batches import in_pieces
from tidelog.llm.words import text_or_empty

SPACE = "▁"
# A word with the run of spaces, or the line feed, before it.
_WORD = re.compile(r"[ ▁]+[^ ▁\n]*|\n[^ ▁\n]*")
# The same with runs of ASCII punctuation apart, for texts of nothing else but Latin letters,
# digits, spaces and line feeds.
_SIGNS = r"!-/:-@\[-`{-~"
_LETTERS = r"0-9A-Za-zÀ-ÖØ-öø-ɏ"
_FINE_WORD = re.compile(rf"[ ▁]+(?:[{_LETTERS}]+|[{_SIGNS}]*)|[{_LETTERS}]+|[{_SIGNS}]+|\n")
_OTHER = re.compile(rf"[^ \n{_LETTERS}{_SIGNS}]")
_JOINED = re.compile(rf"[{_LETTERS}][{_SIGNS}]|[{_SIGNS}][{_LETTERS}]")
# Most words and pairs a worker remembers; longer words are worked out anew in each text.
REMEMBERED_WORDS = 500_000
LONGEST_WORD = 64
REMEMBERED_PAIRS = 500_000
PIECE_BYTES = 4 << 20
NEVER = float("-inf")


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class PieceModel:
    """Vocabulary of a merge-type model: ids, scores and the automaton of its pieces."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bos, self.eos = model.bos_id(), model.eos_id()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        byte = {i for i in range(size) if model.is_byte(i)}
        self.byte_ids = [0] * 256
        for i in byte:
            self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special and i not in byte}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.lengths = [len(p) for p in self.pieces]
        # What each id stands for when decoded; control ids stand for nothing.
        self.bytes = [
            b""
            if i in special
            else bytes([int(p[3:5], 16)])
            if i in byte
            else p.replace(SPACE, " ").encode()
            for i, p in enumerate(self.pieces)
        ]
        # Word by word is right only if no piece goes on behind a space or over a line feed.
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError("pieces of this model reach over words")
        self.parts_signs = not any(_JOINED.search(p) for p in self.ids)
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if set(piece) == {SPACE} and len(piece) > 1:
                continue
            if self.merge(piece) == [i]:
                self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.steps: dict[int, tuple[list[float], list[str], list[str]]] = {}
        self.words: dict[str, bytes] = {}

    def merge(self, text: str, steps: tuple[list, list, list] | None = None) -> list[int]:
        """Ids by merging pair after pair: the best score first, the leftmost of equal ones."""
        symbols = list(text)
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        queue: list[tuple[float, int, str]] = []
        tail = len(symbols) - 1

        def offer(left: int) -> None:
            if left >= 0 and after[left] < len(symbols):
                union = symbols[left] + symbols[after[left]]
                score = self.score.get(union)
                if score is not None:
                    heapq.heappush(queue, (-score, left, union))

        for place in range(len(symbols) - 1):
            offer(place)
        while queue:
            cost, left, union = heapq.heappop(queue)
            right = after[left]
            # An entry whose parts have changed since is out of date.
            if not symbols[left] or right >= len(symbols) or symbols[left] + symbols[right] != union:
                continue
            symbols[left], symbols[right] = union, ""
            after[left] = after[right]
            if after[left] < len(symbols):
                before[after[left]] = left
            else:
                tail = left
            if steps:
                steps[0].append(-cost)
                steps[1].append(symbols[0])
                steps[2].append(symbols[tail])
            offer(before[left])
            offer(left)
        found = []
        for symbol in filter(None, symbols):
            i = self.ids.get(symbol)
            found.extend([i] if i is not None else (self.byte_ids[b] for b in symbol.encode()))
        return found

    def _go_together(self, left: int, right: int, key: int) -> bool:
        """Whether merging keeps two pieces apart that are written side by side.

        Up to a merge over the border both pieces are made step by step as they are made alone,
        so it is enough to compare the union over the border with the next step on each side.
        """
        left_scores, _, ends = self._steps(left)
        right_scores, starts, _ = self._steps(right)
        i = j = 0
        while True:
            over = self.score.get(ends[i] + starts[j], NEVER)
            step, other = left_scores[i], right_scores[j]
            # Of equal scores the leftmost pair is joined first.
            if over > step and over >= other:
                answer = False
                break
            if step == other == NEVER:
                answer = True
                break
            if step >= other:
                i += 1
            else:
                j += 1
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.pairs.clear()
        self.pairs[key] = answer
        return answer

    def _steps(self, i: int) -> tuple[list[float], list[str], list[str]]:
        """Scores of the steps that make a piece, and its first and last symbol before each."""
        steps = self.steps.get(i)
        if steps is None:
            piece = self.pieces[i]
            steps = [], [piece[0]], [piece[-1]]
            self.merge(piece, steps)
            steps[0].append(NEVER)
            self.steps[i] = steps
        return steps

    def _by_prefixes(self, word: str) -> list[int]:
        """Ids by the table of last pieces."""
        # No entry: nothing fits yet, so the character there is unknown and parts the word.
        last: dict[int, int] = {}
        lengths, pair, n = self.lengths, self.pairs.get, len(self.pieces)
        for end, i in self.automaton.iter(word):
            end += 1
            if end in last:
                continue
            start = end - lengths[i]
            before = last.get(start)
            if before is None:
                # Where no piece ends the characters before stay bytes.
                if start == 0 or start not in last and self._parted(word, start):
                    last[end] = i
                continue
            key = before * n + i
            fits = pair(key)
            if fits is None:
                fits = self._go_together(before, i, key)
            if fits:
                last[end] = i
        found: list[int] = []
        end = len(word)
        while end:
            i = last.get(end)
            if i is None:
                found.extend(self.byte_ids[b] for b in reversed(word[end - 1].encode()))
                end -= 1
            else:
                found.append(i)
                end -= lengths[i]
        found.reverse()
        return found

    def _parted(self, word: str, place: int) -> bool:
        """Whether the character before a place is unknown."""
        return word[place - 1] not in self.ids

    def _word_ids(self, word: str) -> list[int]:
        if word[0] == "\n":
            return [self.byte_ids[10], *(self._by_prefixes(word[1:]) if len(word) > 1 else ())]
        word = word.replace(" ", SPACE)
        return self.merge(word) if word[1:2] == SPACE else self._by_prefixes(word)

    def encode(self, text: str) -> np.ndarray:
        """Ids with begin and end."""
        packed = [pack([self.bos])]
        if text:
            fine = self.parts_signs and not _OTHER.search(text)
            words = (_FINE_WORD if fine else _WORD).findall(" " + text)
            known, long = self.words, {}
            for word in set(words).difference(known):
                if len(word) > LONGEST_WORD:
                    long[word] = pack(self._word_ids(word))
                    continue
                if len(known) >= REMEMBERED_WORDS:
                    known = self.words = {}
                known[word] = pack(self._word_ids(word))
            try:
                packed.extend([known[word] for word in words])
            except KeyError:  # long, or forgotten while the text was read
                packed = packed[:1]
                for word in words:
                    packed.append(known.get(word) or long.get(word) or pack(self._word_ids(word)))
        packed.append(pack([self.eos]))
        return np.frombuffer(b"".join(packed), "<u4")

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids: the space that encoding puts first goes, broken bytes are replaced."""
        joined = b"".join(map(self.bytes.__getitem__, ids))
        return (joined[1:] if joined[:1] == b" " else joined).decode("utf-8", "replace")


def _run(path: str, with_texts: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(path)
        for batch in in_pieces(batches, "text", PIECE_BYTES):
            counts, digests, decoded_digests, ids, decoded = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                own = model.encode(text)
                back = model.decode(own.tolist())
                counts.append(len(own))
                digests.append(hashlib.sha256(own).hexdigest())
                decoded_digests.append(hashlib.sha256(back.encode()).hexdigest())
                if with_texts:
                    ids.append(own.astype(np.int32))
                    decoded.append(back)
            columns = [batch.column("id"), counts, digests, decoded_digests]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_texts:
                columns += [pa.array(ids, pa.list_(pa.int32())), decoded]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, list) else c for c in columns], names)

    return run


def encode_and_decode(
    docs: DataFrame,
    model_path: str,
    with_texts: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, n_tokens, digests of the ids and of the decoded text.

    With with_texts, the ids themselves and the decoded text as well.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if with_texts:
        schema += ", ids array<int>, decoded string"
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    return rows.mapInArrow(_run(model_path, with_texts), schema).withColumnRenamed("id", id_col)
