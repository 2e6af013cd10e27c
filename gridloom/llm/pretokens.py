"""Byte-level BPE pre-tokens of whole texts, and a bounded memory of what each pre-token encodes to."""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import chain

import numpy as np
import public_tokenizers
import regex

_SPLIT = regex.compile(public_tokenizers.PATTERN)
_BEFORE_SPACE = regex.compile(r"(?<=\S)(?=\s)")
#: Characters of a text that are pre-tokenized at once.
STRETCH = 1_000_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable bytes stand
    for themselves, the others for the code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


def load(name: str) -> dict:
    """The JSON of a public byte-level BPE vocabulary; raises if its rules aren't those handled here."""
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        data = json.load(f)
    pre, model = data["pre_tokenizer"], data["model"]
    plain = pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not data["normalizer"]
    if not plain or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
        raise ValueError(f"{name} is not a plain byte-level BPE vocabulary")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in data["added_tokens"]):
        raise ValueError(f"{name} has added tokens with context rules")
    return data


class PreTokenizer:
    """Splits texts as the library does: added tokens first, then the pre-token pattern."""

    def __init__(self, data: dict):
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        words = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, words)) + ")") if words else None

    def split(self, text: str) -> list[str]:
        """Pre-tokens of ``text`` in order; an added token is one item."""
        if self.special is None or not any(map(text.__contains__, self.added)):
            return _pre_tokens(text)
        out: list[str] = []
        for part in self.special.split(text):
            out += [part] if part in self.added else _pre_tokens(part)
        return out


def _pre_tokens(text: str) -> list[str]:
    """A very long text is cut where a blank follows a letter or sign, which always ends a pre-token."""
    if len(text) <= STRETCH:
        return _SPLIT.findall(text)
    out, start = [], 0
    while start < len(text):
        cut = _BEFORE_SPACE.search(text, start + STRETCH)
        end = cut.start() if cut else len(text)
        out += _SPLIT.findall(text[start:end])
        start = end
    return out


class PreTokenMemory(dict):
    """Numbers pre-tokens as they are met and keeps each one's encoding, up to ``limit`` of them.

    ``encode`` takes new pre-tokens and returns (lengths, all their ids or None). An added token, which
    a pre-token can't contain, is one id.
    """

    def __init__(self, data: dict, encode: Callable, limit: int = 600_000):
        super().__init__()
        self.split, self.encode, self.limit = PreTokenizer(data), encode, limit
        self.new: list[str] = []
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.lengths, self.starts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of every pre-token of ``texts``, and how many each text has."""
        if len(self) > self.limit:
            self.reset()
        parts = [self.split.split(t) for t in texts]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        look = self.__getitem__
        flat = np.fromiter(map(look, chain.from_iterable(parts)), np.int64, int(sizes.sum()))
        if self.new:
            self._learn()
        return flat, sizes

    def _learn(self) -> None:
        added = self.split.added
        known = [k for k, w in enumerate(self.new) if w in added]
        plain = [w for w in self.new if w not in added] if known else self.new
        lengths, ids = self.encode(plain)
        if known:
            at = np.array(known) - np.arange(len(known))
            before = np.concatenate(([0], np.cumsum(lengths)))[at]
            lengths = np.insert(lengths, at, 1)
            ids = None if ids is None else np.insert(ids, before, [added[self.new[k]] for k in known])
        self.lengths = np.concatenate((self.lengths, lengths))
        if ids is not None:
            self.ids = np.concatenate((self.ids, ids.astype(np.uint32)))
            self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1])).astype(np.int64)
        self.new = []

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        flat, sizes = self.numbers(texts)
        ends = np.concatenate(([0], np.cumsum(self.lengths[flat])))
        at = np.concatenate(([0], np.cumsum(sizes)))
        return ends[at[1:]] - ends[at[:-1]]

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, tokens of each)."""
        flat, sizes = self.numbers(texts)
        lengths = self.lengths[flat]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        at = np.concatenate(([0], np.cumsum(sizes)))
        step = np.repeat(self.starts[flat] - ends[:-1], lengths) + np.arange(ends[-1])
        return self.ids[step], ends[at[1:]] - ends[at[:-1]]
