"""Byte-level BPE ids of whole texts, with each distinct pre-token encoded once.

A byte-level tokenizer merges inside pre-tokens only, so a pre-token's ids do not depend on its neighbours. Texts are split by the pre-tokenizer's
pattern, and the ids of the pieces put together again. Texts with the string of an added token, or with a character that the two
libraries' character tables may class differently, are given to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterable, Sequence
from itertools import repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The byte-level pre-tokenizer's pattern: contractions, letters, numbers, other characters, white space. It is written with the standard
# library's classes, which agree with the tokenizer's but for the characters that ``_Odd`` tells.
PRE_TOKENS = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_OTHER_ASCII_SPACE = [chr(c) for c in range(128) if _OTHER_SPACE.match(chr(c))]
_MARKS = frozenset(".,;:!?)")
_FIRST = "\0"  # marks the first part of a text, which has no blank before it
_KEEP = 300_000


class _Odd(dict):
    """Tells characters that the two libraries may class differently: numbers that are no decimal digits, four control characters, and
    what one version of the character tables knows and another does not."""

    def __missing__(self, c: str) -> bool:
        self[c] = found = "\x1c" <= c <= "\x1f" or unicodedata.category(c) in ("No", "Nl", "Cn")
        return found


ODD = _Odd()
_ODD_ASCII = [chr(c) for c in range(128) if ODD[chr(c)]]


def load(path: str):
    """The library's tokenizer of a file. Raises unless it is a byte-level one that merges inside ``PRE_TOKENS`` only."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        about = json.load(file)
    split, model = about["pre_tokenizer"] or {}, about["model"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if not plain or about["normalizer"] or about["truncation"] or about["padding"] or model["type"] != "BPE" or model.get("dropout"):
        raise ValueError(f"{path} is not a plain byte-level BPE file")
    return Tokenizer.from_file(path)


def added_tokens(tokenizer) -> list[str]:
    """Strings that the library takes out of a text before it is split."""
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def taken_whole(text: str, special: Sequence[str]) -> bool:
    """True for texts that the library has to encode itself."""
    if any(s in text for s in special):
        return True
    return any(c in text for c in _ODD_ASCII) if text.isascii() else any(map(ODD.__getitem__, set(text)))


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable bytes for themselves, the others for the letters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


_LETTERS = _byte_letters()
_BREAK = b"\xff"  # no byte of UTF-8
_ID = attrgetter("id")


def encode_pieces(tokenizer, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and ids of pre-tokens, in their order; the library's model merges each by itself."""
    spelled = _BREAK.join(map(str.encode, pieces)).decode("latin-1").translate(_LETTERS).split(_LETTERS[_BREAK[0]])
    sizes, ids = [], []
    for tokens in map(tokenizer.model.tokenize, spelled if pieces else ()):
        sizes.append(len(tokens))
        ids.extend(map(_ID, tokens))
    return np.array(sizes, np.int64), np.array(ids, np.uint32)


def gathered(flat: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``at``, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(at - (ends - sizes), sizes) + np.arange(total)]


class _Ids:
    """Numbered strings with their ids, one after another in ``flat``."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.fresh: list[str] = []
        self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def number(self, strings: pa.Array) -> np.ndarray:
        """The numbers of strings; those without one are numbered and are ``fresh``. Arrow tells which are equal, so each is looked up once."""
        coded = strings.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = np.fromiter(map(self.numbers.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(found < 0)
        found[new] = np.arange(len(self.numbers), len(self.numbers) + len(new))
        self.fresh = [distinct[i] for i in new.tolist()]
        self.numbers.update(zip(self.fresh, found[new].tolist()))
        return found[coded.indices.to_numpy()]

    def learn(self, sizes: np.ndarray, flat: np.ndarray) -> None:
        """Takes the ids of the fresh strings."""
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])
        self.fresh = []

    def gather(self, which: np.ndarray) -> np.ndarray:
        starts = np.cumsum(self.sizes) - self.sizes
        return gathered(self.flat, starts[which], self.sizes[which])


def with_cuts(text: str) -> str | None:
    """The text with a blank wherever it is cut, which is at each blank and line end, as pre-tokens never reach across these cuts; every part but the first
    and those that begin with a line end has lost the blank before it. None for texts with other or longer runs of white space."""
    if "  " in text or " \n" in text or "\n\n\n" in text or text.endswith((" ", "\n\n")):
        return None
    if any(c in text for c in _OTHER_ASCII_SPACE) if text.isascii() else _OTHER_SPACE.search(text):
        return None
    return _FIRST + text.replace("\n", " \n")


def _restored(part: str) -> str:
    """A part with its blank."""
    if part[:1] == _FIRST:
        return part[1:]
    return part if part[:1] == "\n" else " " + part


def split_part(part: str) -> list[str]:
    """The pre-tokens of a part. Letters alone, or before one mark, need no pattern."""
    if part.isalpha():
        return [" " + part]
    if part[-1:] in _MARKS and part[:-1].isalpha():
        return [" " + part[:-1], part[-1]]
    return PRE_TOKENS.findall(_restored(part))


class ChunkEncoder:
    """Encodes lists of texts with one byte-level file of the tokenizers library. Distinct parts between blanks are split into pre-tokens once, and
    distinct pre-tokens merged once. At most about ``keep`` parts are remembered from one list to the next; when there are more, those used most often
    stay, half as many."""

    def __init__(self, path: str, keep: int = _KEEP):
        self.tokenizer, self.keep = load(path), keep
        self.special = added_tokens(self.tokenizer)
        self._reset()

    def _reset(self) -> None:
        self.parts, self.pieces, self.uses = _Ids(), _Ids(), np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keeps the parts used most often."""
        strings, old, uses = list(self.parts.numbers), self.parts, self.uses
        often = np.sort(np.argsort(uses, kind="stable")[::-1][: self.keep // 2])
        often = often[uses[often] > 1]
        self._reset()
        self.parts.numbers.update((strings[i], n) for n, i in enumerate(often.tolist()))
        self.parts.sizes, self.parts.flat, self.uses = old.sizes[often], old.gather(often), np.ones(len(often), np.int64)

    def _merged(self, lists: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of lists of pre-tokens."""
        counts, flat = [], []
        for pieces in lists:
            counts.append(len(pieces))
            flat += pieces
        counts, which = np.array(counts, np.int64), self.pieces.number(pa.array(flat, pa.large_string()))
        if self.pieces.fresh:
            self.pieces.learn(*encode_pieces(self.tokenizer, self.pieces.fresh))
        before = np.concatenate(([0], np.cumsum(self.pieces.sizes[which])))
        ends = np.cumsum(counts)
        return before[ends] - before[ends - counts], self.pieces.gather(which)

    def _numbered(self, texts: Sequence[str | None]) -> list[np.ndarray | list[str] | None]:
        """Of each text the numbers of its parts, or its pre-tokens where it cannot be cut; None where it goes to the library whole."""
        if len(self.parts.numbers) > self.keep:
            self._forget()
        found, cut = [], []
        for i, t in enumerate(texts):
            t = t or ""
            if taken_whole(t, self.special):
                found.append(None)
            elif (blanks := with_cuts(t)) is None:
                found.append(PRE_TOKENS.findall(t))
            else:
                found.append(np.zeros(0, np.int64))
                cut.append((i, blanks))
        numbers, ends = self._look(cut)
        for (i, _), a, b in zip(cut, ends, ends[1:]):
            found[i] = numbers[a:b]
        if self.parts.fresh:
            self.parts.learn(*self._merged(map(split_part, self.parts.fresh)))
        self.uses = np.append(self.uses, np.zeros(len(self.parts.sizes) - len(self.uses), np.int64))
        self.uses += np.bincount(numbers, minlength=len(self.uses))
        return found

    def _look(self, cut: list[tuple[int, str]]) -> tuple[np.ndarray, list[int]]:
        """The numbers of all parts of texts, and where each text's begin and end."""
        parts = pc.split_pattern(pa.array([t for _, t in cut], pa.large_string()), " ")
        return self.parts.number(parts.flatten()), parts.offsets.to_pylist()

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """The ids of each text; a null text is an empty one."""
        found = self._numbered(texts)
        starts, out = np.cumsum(self.parts.sizes) - self.parts.sizes, []
        for t, parts in zip(texts, found):
            if parts is None:
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32))
            elif isinstance(parts, list):
                out.append(self._merged([parts])[1])
            else:
                out.append(gathered(self.parts.flat, starts[parts], self.parts.sizes[parts]))
        return out

    def lengths(self, texts: Sequence[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        out = np.zeros(len(texts), np.int64)
        for i, (t, parts) in enumerate(zip(texts, self._numbered(texts))):
            if parts is None:
                out[i] = len(self.tokenizer.encode(t, add_special_tokens=False).ids)
            else:
                out[i] = self._merged([parts])[0][0] if isinstance(parts, list) else self.parts.sizes[parts].sum()
        return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """This process's encoder of a file: Python workers are reused, and so is what theirs has learned."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def slices(texts: Sequence[str | None], chars: int = 4_000_000):
    """(start, end) of runs of texts of about ``chars`` characters, to bound what one call holds."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)
