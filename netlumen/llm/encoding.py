"""Exact token ids of the tokenizers library, worked out once per distinct piece of text.

Both pre-tokenizers cut a text before every space that follows a non-space, so no
token crosses such a place and a text's ids are its pieces' ids one after another.
Words repeat: a task keeps the ids of the pieces it has met and hands only new ones to
the library, many at once. Pieces of plain Latin words go straight to the library's BPE
model, as their pre-tokens are known; all others take the library's whole path. What is
kept is bounded by ``max_pieces`` and dropped whole when full, which changes speed only.
"""

from __future__ import annotations

import gc
import itertools
import json
import operator
import os
import re
from collections.abc import Iterator

import numpy as np

# A place no token crosses: before a space, after anything that is not white space.
SAFE = re.compile(r"(?<=\S)(?= )")
RISKY = re.compile(r"\s ")
BARE = "\0"      # marks a piece that does not follow a space
FEED = BARE + "\n"
_ENCODERS: dict[tuple[str, int], "PieceEncoder"] = {}


def pieces(text: str) -> list[str]:
    """``text`` cut at every safe place, as keys: a piece less the space before it, or
    after ``BARE`` if there is none. The text must not hold ``BARE``."""
    printable = text.replace("\n", "").isprintable()     # no white space but spaces and line feeds
    if "  " in text or "\n " in text or not printable and RISKY.search(text):
        return [p[1:] if p[:1] == " " else BARE + p for p in SAFE.split(text)]
    if not printable or "\n\n" in text or " \n" in text:
        return _words_of(text)
    keys: list[str] = []
    for line in text.split("\n"):      # a line feed among letters and signs is a token of its own
        if keys:
            keys.append(FEED)
        keys += _words_of(line)
    return keys


def _words_of(line: str) -> list[str]:
    keys = line.split(" ")
    keys[0] = BARE + keys[0]
    return keys


def blocks(text: str, chars: int) -> Iterator[str]:
    """A long text in parts of about ``chars`` characters, cut at safe places only."""
    start = 0
    while len(text) - start > chars:
        cut = SAFE.search(text, start + chars)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:] if start else text


# A plain Latin word is one pre-token, a run of signs after it another, and a line feed
# before the next word a third. Apostrophes (contractions) and the signs that special
# tokens are written with are left to the library.
_L = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"
_S = "[!-&(-/:;=-@\\[-`{}~]"
_SIGNS = "".join(c for c in map(chr, range(33, 127)) if re.fullmatch(_S, c))
PLAIN = re.compile(rf"\0?{_L}+{_S}*(?:\n{_L}+{_S}*)*")
PARTS = re.compile(rf"\0?{_L}+|{_S}+|\n")


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell bytes: printable ones stand for themselves, the
    others take the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelt = {b: chr(b) for b in shown}
    return spelt | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in spelt)}


class PieceEncoder:
    """Ids of whole texts by a ``tokenizers`` file, as little-endian uint32 bytes."""

    def __init__(self, path: str, max_pieces: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.max_pieces = max_pieces
        self.known: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}
        kind = json.loads(self.tokenizer.to_str())
        model, suffix = kind["model"], kind["model"].get("end_of_word_suffix") or ""
        # The short way holds for byte-level BPE with these two known front ends only.
        lower = [n["type"] for n in (kind["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.short = model["type"] == "BPE" and bool(suffix) == lower and (lower or kind["normalizer"] is None)
        self.lower = lower
        if self.short:
            size = max(model["vocab"].values()) + 1
            self.letters, self.ends = np.zeros(size, np.int64), np.zeros(size, bool)
            for token, i in model["vocab"].items():
                self.ends[i] = bool(suffix) and token.endswith(suffix)
                self.letters[i] = len(token) - len(suffix) * self.ends[i]
            spelling = byte_letters()
            self.spelling = {c: "".join(spelling[b] for b in chr(c).encode()) for c in range(256)}
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.Split("\n", "removed")

    def _library(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 1024):
            got = self.tokenizer.encode_batch_fast(texts[i:i + 1024], add_special_tokens=False)
            out += [np.array(code.ids, "<u4").tobytes() for code in got]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Keys that are plain words, each one pre-token, through the model alone."""
        out = []
        for i in range(0, len(words), 2048):
            part = words[i:i + 2048]
            # Plain ASCII is spelt as it is, but for the space before it.
            bare = [w.lstrip(BARE) for w in part]
            spelt = [w if w.isascii() else w.translate(self.spelling) for w in bare]
            if not self.lower:
                space = self.spelling[32]
                spelt = [w if k[0] == BARE else space + w for k, w in zip(part, spelt)]
            ids = np.array(self.model.encode_batch_fast(["\n".join(spelt)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(np.fromiter(map(len, spelt), np.int64, len(spelt)))
            cuts = np.searchsorted(np.cumsum(self.letters[ids]), ends) + 1
            raw, start = ids.tobytes(), 0
            for cut in (cuts * 4).tolist():
                out.append(raw[start:cut])
                start = cut
        return out

    def _word(self, key: str) -> str:
        """The key that stands for a plain word: with lower case spaces do not matter."""
        return key.lstrip(BARE).lower() if self.lower else key

    def learn(self, new: set[str]) -> None:
        if len(self.known) + len(new) > self.max_pieces:
            self.known = {}
        known, plain, other = self.known, {}, []
        if self.short:
            new = self._learn_ascii(new)
        for key in new:
            if PLAIN.fullmatch(key):
                found = PARTS.findall(key)
                # Only the first word follows a space.
                plain[key] = [found[0], *[BARE + x if x[0].isalpha() else x for x in found[1:]]]
            else:
                other.append(key)
        if not self.short:
            other, plain = list(new), {}
        known.update(zip(other, self._library([k[1:] if k[:1] == BARE else " " + k for k in other])))
        part: dict[str, bytes | None] = {}
        for parts in plain.values():
            for x in parts:
                if x not in part:
                    part[x] = known.get(self._word(x)) if x[-1].isalpha() else self.signs.get(x)
        odd = [x for x, ids in part.items() if ids is None and not x[-1].isalpha()]
        self.signs.update(zip(odd, self._library(odd)))
        words = list({self._word(x) for x, ids in part.items() if ids is None and x[-1].isalpha()})
        known.update(zip(words, self._words(words)))
        for x, ids in part.items():
            if ids is None:
                part[x] = known[self._word(x)] if x[-1].isalpha() else self.signs[x]
        for key, parts in plain.items():
            known[key] = part[parts[0]] if len(parts) == 1 else b"".join([part[x] for x in parts])

    def _learn_ascii(self, new: set[str]) -> list[str]:
        """Learns the keys that are one ASCII word, with signs after it or none, and returns
        the others: most keys, so without a step of Python for each of their parts."""
        known, fold = self.known, str.lower if self.lower else str
        words = [k for k in new if k.isascii() and k.isalpha()]
        rest, keys, heads, tails = [], [], [], []
        for key in new.difference(words):
            head = key.rstrip(_SIGNS)
            if head.isascii() and head.isalpha():
                keys.append(key)
                heads.append(head)
                tails.append(key[len(head):])
            else:
                rest.append(key)
        spelt, heads = list(map(fold, words)), list(map(fold, heads))
        missing = list({*spelt, *heads}.difference(known))
        known.update(zip(missing, self._words(missing)))
        known.update(zip(words, map(known.__getitem__, spelt)))
        odd = list(set(tails).difference(self.signs))
        self.signs.update(zip(odd, self._library(odd)))
        known.update(zip(keys, map(operator.add, map(known.__getitem__, heads), map(self.signs.__getitem__, tails))))
        return rest

    def _cut(self, text: str) -> list[str]:
        if self.short and self.lower and text.replace("\n", "").isprintable():
            return text.split()         # white space is dropped and ends every token
        return pieces(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        collecting = gc.isenabled()
        gc.disable()  # millions of short-lived strings, no cycles
        try:
            whole = {i: t for i, t in enumerate(texts) if BARE in t}
            cut = [[] if i in whole else self._cut(t) for i, t in enumerate(texts)]
            flat = list(itertools.chain.from_iterable(cut))
            codes = list(map(self.known.get, flat))
            missing = list(itertools.compress(range(len(flat)), map(operator.is_, codes, itertools.repeat(None))))
            if missing:
                new = set(map(flat.__getitem__, missing))
                # What is known stays in ``codes``, also if the memory is dropped now.
                self.learn(new)
                for i, code in zip(missing, map(self.known.__getitem__, map(flat.__getitem__, missing))):
                    codes[i] = code
            each = iter(codes)
            out = [b"".join(itertools.islice(each, len(c))) for c in cut]
            for i, ids in zip(whole, self._library(list(whole.values()))):
                out[i] = ids
            return out
        finally:
            if collecting:
                gc.enable()

    def encode_long(self, text: str, chars: int = 1 << 20) -> bytes:
        return b"".join([self.encode([part])[0] for part in blocks(text, chars)])


def encoder(path: str, max_pieces: int = 1_000_000) -> PieceEncoder:
    """One encoder for all tasks that a Python worker runs."""
    key = (path, max_pieces)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, max_pieces)
    return _ENCODERS[key]
