"""Token ids of whole texts by a byte-level tokenizer of the tokenizers library.

Where the tokenizer's own rules part a text at a single space or line feed between two other
characters, the ids of a part do not depend on its neighbours, and a run of ASCII punctuation
after a letter is a part of its own. Parts are encoded once by the library and remembered as bytes of their ids;
parts that are new in a batch are encoded together, as one text. What is remembered is bounded by
its bytes: when it is full only parts that were met in more than one batch are kept. Long parts
are never remembered. Texts that hold an added token, which the library finds before it parts
a text, are encoded by it as they are.
"""

import os
import re
import string
from collections.abc import Iterator
from functools import cache

import numpy as np

# Bytes a worker remembers, characters of the longest part it remembers, characters of a text
# that are worked on at once (if the text can be parted), and a part's cost beside its characters.
REMEMBERED_BYTES = 160 << 20
LONGEST_PART = 48
SLICE_CHARS = 1 << 20
PART_COST = 160

_PART = re.compile(r"(?<=\S) (?=\S)")
_RUNS = ("\0", "  ", "\n\n", " \n", "\n ")
# A part that may stand for itself anywhere: no white space at its ends but one leading space,
# or a line feed between two other characters.
_FIT = re.compile(r"\n| ?\S(?:.*\S)?", re.DOTALL).fullmatch
# Fit parts of one word, with a leading space or without.
_WORD = re.compile(r" \S+").fullmatch
_BARE = re.compile(r"\S+").fullmatch
_MARKS = string.punctuation


@cache
def shared_encoder(path: str) -> "PartEncoder":
    """The worker process's own encoder, which later tasks of the process go on with."""
    return PartEncoder(path)


class PartEncoder:
    """Encodes texts without special tokens, truncation or padding, as the library does."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.dtype = np.dtype("<u4" if wide else "<u2")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.token_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, number in vocabulary.items():
            self.token_bytes[number] = len(token)
        self.known: dict[str, bytes] = {}
        self.again: set[str] = set()
        self.left = REMEMBERED_BYTES

    def _packed(self, ids) -> bytes:
        return np.asarray(ids, dtype=self.dtype).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _together(self, parts: list[str], end: str = "") -> Iterator[bytes]:
        """Ids of parts, from one text of all of them with `end`, a line feed or nothing, after each.

        A token of a byte-level vocabulary has as many bytes as its name has characters.
        """
        size, dropped = self.dtype.itemsize, len(end)
        for begin in range(0, len(parts), 4096):
            some = [part + end for part in parts[begin : begin + 4096]]
            (whole,) = self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)
            found = whole.ids
            token_ends = np.cumsum(self.token_bytes[found])
            ends = np.cumsum(np.fromiter(map(len, map(str.encode, some)), np.int64, len(some)))
            cuts = np.searchsorted(token_ends, ends) + 1
            if (token_ends[cuts - 1] != ends).any():
                raise ValueError("the vocabulary is not one of bytes")
            firsts = np.concatenate([[0], cuts[:-1]]) * size
            ids = self._packed(found)
            yield from map(ids.__getitem__, map(slice, firsts.tolist(), ((cuts - dropped) * size).tolist()))

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """Ids of parts that are not remembered yet."""
        spaced = set(filter(_WORD, new))
        bare = list(filter(_BARE, new - spaced))
        found = dict(zip(bare, self._together(bare, "\n"), strict=True))
        tails, todo = [], set()
        for part in spaced:
            stem = part.rstrip(_MARKS)
            if len(stem) < len(part) and stem[-1:].isalpha():
                tails.append((part, stem, part[len(stem) :]))
            else:
                todo.add(part)
        # Not `-`, which would go through all that is known.
        todo |= {stem for _, stem, _ in tails}.difference(self.known)
        listed = list(todo)
        found.update(zip(listed, self._together(listed), strict=True))
        marks = {mark for _, _, mark in tails}.difference(self.known)
        found.update((mark, self._whole(mark)) for mark in marks)
        for part, stem, mark in tails:
            first = found.get(stem) or self.known[stem]
            found[part] = first + (found.get(mark) or self.known[mark])
        found.update((part, self._whole(part)) for part in new.difference(found))
        return found

    def _remember(self, found: dict[str, bytes]) -> None:
        """Adds parts; what is too long or too much is taken out again by `_forget`."""
        self.known.update(found)
        self.left -= PART_COST * len(found) + sum(map(len, found)) + sum(map(len, found.values()))

    def _forget(self, found: dict[str, bytes]) -> None:
        for part in [p for p in found if len(p) > LONGEST_PART or not p.strip() == p.removeprefix(" ") and not _FIT(p)]:
            self.left += PART_COST + len(part) + len(self.known.pop(part))
        if self.left < 0:
            self.known = {part: self.known[part] for part in self.again if part in self.known}
            self.again = set()
            self.left = REMEMBERED_BYTES - sum(len(p) + len(i) + PART_COST for p, i in self.known.items())
            if self.left < REMEMBERED_BYTES // 2:
                self.known, self.left = {}, REMEMBERED_BYTES

    def _slices(self, text: str) -> Iterator[str]:
        """The text in slices that begin at a single space between two other characters."""
        begin = 0
        while len(text) - begin > SLICE_CHARS:
            cut = _PART.search(text, begin + SLICE_CHARS)
            if not cut:
                break
            yield text[begin : cut.start()]
            begin = cut.start()
        yield text[begin:]

    @staticmethod
    def _words(text: str) -> list[str] | None:
        """Parts of a text without runs of spaces and line feeds; None for other texts."""
        if text[:1] in ("", " ", "\n") or text[-1] in " \n" or any(run in text for run in _RUNS):
            return None
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    @staticmethod
    def _any_parts(text: str) -> list[str]:
        """Parts of any text: it is parted only at single spaces between two other characters."""
        first, *rest = _PART.split(text)
        return [first, *(" " + part for part in rest)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, one after the other in little-endian order."""
        split: list[list[str] | bytes] = []
        plain = []
        for place, text in enumerate(texts):
            if any(token in text for token in self.added):
                split.append(self._whole(text))
                continue
            if len(text) > 2 * SLICE_CHARS:
                pieces = list(self._slices(text))
                if len(pieces) > 1:
                    split.append(b"".join(ids for piece in pieces for ids in self.encode([piece])))
                    continue
            words = self._words(text)
            split.append(words or [])
            if words is not None:
                plain.append(place)
        every = set().union(*(split[place] for place in plain))
        odd = {p for p in every.difference(self.known) if not (p[:1] == " " and _BARE(p, 1) or _FIT(p))}
        if odd:
            plain = [place for place in plain if odd.isdisjoint(split[place])]
            every = set().union(*(split[place] for place in plain))
        fine = set(plain)
        for place, parts in enumerate(split):
            if place not in fine and isinstance(parts, list):
                split[place] = self._any_parts(texts[place])
                every.update(split[place])
        new = every.difference(self.known)
        if self.left < REMEMBERED_BYTES // 4:
            self.again |= every - new
        found = self._learn(new)
        self._remember(found)
        look_up = self.known.__getitem__
        done = [b"".join(map(look_up, parts)) if isinstance(parts, list) else parts for parts in split]
        self._forget(found)
        return done
