"""Exact whole-text encoding with the ``tokenizers`` library, fast on text with repeated words."""

from __future__ import annotations

import codecs
import json
import os
import re
import sys
from array import array
from itertools import chain

import numpy as np

#: Latin letters, and signs and digits of ASCII without the apostrophe: in these, runs of one kind are what a byte-level
#: pre-tokenizer tells apart.
LETTERS, SIGNS = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"
#: Characters that no tokenizer counts as white space: visible ASCII and Latin letters.
VISIBLE = "!-~À-ÖØ-öø-ɏ"
#: A space at which a text may not be cut, and a text that may have one besides a double space or one beside a line end.
TIED = re.compile(f"(?<![{VISIBLE}]) | (?![{VISIBLE}])")
ODD = re.compile(f"[^{VISIBLE} \n]")
#: Words with visible ends; words that are nothing but runs, and these runs.
ENDS = re.compile(f"[{VISIBLE}](?:.*[{VISIBLE}])?\\Z", re.DOTALL)
SAFE = re.compile(f"[{LETTERS}{SIGNS}0-9](?:[{LETTERS}{SIGNS}0-9\n]*[{LETTERS}{SIGNS}0-9])?")
RUNS = re.compile(f"[{LETTERS}]+|[{SIGNS}]+|[0-9]+|\n(?!\n)|\n+(?=\n)")


def _byte_letters() -> dict[int, str]:
    """The letters by which a byte-level model names bytes: visible ones stand for themselves, others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


BYTE = _byte_letters()
SPACE = BYTE[32]
NAMES = "".join(BYTE[b] for b in range(256))
#: The same, but line ends stay.
IN_LINES = NAMES[:10] + "\n" + NAMES[11:]


def named(text: str, names: str = NAMES) -> str:
    """A text by the names of its bytes."""
    return codecs.charmap_decode(text.encode(), "strict", names)[0]


class Encoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does, special strings in a text included.

    The byte-level pre-tokenizer never joins a space that stands between two visible characters to what precedes
    it. So a text may be cut before such spaces, and the pieces, most of which repeat, are encoded once and kept.
    Other spaces and line breaks are never cut at. A new piece of plain runs goes to the library's model run by run, many
    in one call; any other goes through the whole tokenizer. At most twice ``most`` pieces are kept. A tokenizer of
    another kind encodes whole texts.
    """

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.most = most
        self.kept: dict[str, bytes] = {}  # by piece, without the space before it
        self.old: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}  # by run that has no space before it
        spec = json.loads(self.tokenizer.to_str())
        cut = spec["pre_tokenizer"] or {}
        self.byte_level = spec["model"].get("type") == "BPE" and not spec["normalizer"] and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        self.special = [t["content"] for t in spec["added_tokens"]]
        #: the model behind no pre-tokenizer, and behind one that only cuts at line ends
        self.bare, self.lines = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        self.lines.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        #: ids that begin with a space: the first of each word does, and no other of a word without spaces
        self.opens = np.array([(self.tokenizer.id_to_token(k) or "").startswith(SPACE) for k in range(size)])

    def _raw(self, pieces: list[str], tokenizer=None) -> list[bytes]:
        ids = [array(self.code, e.ids) for e in (tokenizer or self.tokenizer).encode_batch_fast(pieces, add_special_tokens=False)]
        if sys.byteorder == "big":
            for x in ids:
                x.byteswap()
        return [x.tobytes() for x in ids]

    def _together(self, words: list[str], tokenizer, joined, step: int = 1024) -> list[bytes]:
        """Ids of words, a space before each: encoded as one text, and told apart where a space begins."""
        out, size = [], self.dtype.itemsize
        parts = [words[at : at + step] for at in range(0, len(words), step)]
        for part, e in zip(parts, tokenizer.encode_batch_fast([joined(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=self.dtype)
            at = np.flatnonzero(self.opens[ids])
            if len(at) != len(part):  # a vocabulary of another kind
                out += self._raw([f" {w}" for w in part])
                continue
            raw, cut = ids.tobytes(), [*(at * size).tolist(), len(ids) * size]
            out += [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        return out

    def _keep(self, words: list[str]) -> None:
        """Encode words that are new."""
        kept, inner = self.kept, self.inner
        single, many, rest = [], [], []
        for w in words:
            if w.isalpha() and w.isascii():
                single.append(w)
            elif SAFE.fullmatch(w):
                many.append(w)
            else:
                rest.append(w)
        runs = [RUNS.findall(w) for w in many]
        heads = list({*single, *(r[0] for r in runs)}.difference(kept))
        kept.update(zip(heads, self._together(heads, self.lines, lambda p: named(" " + "\n ".join(p), IN_LINES)), strict=True))
        if len(inner) > self.most:
            inner.clear()
        after = list({x for r in runs for x in r[1:]}.difference(inner))
        inner.update(zip(after, self._raw([named(x) for x in after], self.bare), strict=True))
        for w, r in zip(many, runs, strict=True):
            if len(r) == 2:
                kept[w] = kept[r[0]] + inner[r[1]]
            elif len(r) > 2:
                kept[w] = kept[r[0]] + b"".join(map(inner.__getitem__, r[1:]))
        joined = [w for w in rest if " " not in w and w and ENDS.match(w)]
        kept.update(zip(joined, self._together(joined, self.tokenizer, lambda p: " " + " ".join(p)), strict=True))
        rest = [w for w in rest if w not in kept]
        kept.update(zip(rest, self._raw([f" {w}" for w in rest]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, of the width of ``self.dtype``."""
        whole = [not self.byte_level or any(s in t for s in self.special) for t in texts]
        cut = [(t, []) if w else self._pieces(t) for t, w in zip(texts, whole, strict=True)]
        if len(self.kept) > self.most:  # words met since the last time stay, the others go
            self.old, self.kept = self.kept, {}
        kept, old = self.kept, self.old
        new = list(set(chain.from_iterable(rest for _, rest in cut)).difference(kept))
        kept.update((w, old[w]) for w in new if w in old)
        new = [w for w in new if w not in kept]
        if new:
            self._keep(new)
        first = self._raw([head for head, _ in cut])
        out = [head + b"".join(map(kept.__getitem__, rest)) for head, (_, rest) in zip(first, cut, strict=True)]
        for w in new:
            if len(w) > 48:
                kept.pop(w, None)
        return out

    @staticmethod
    def _pieces(text: str) -> tuple[str, list[str]]:
        """The first piece, and the others without their space."""
        words = text.split(" ")
        if not ODD.search(text):  # all visible but spaces and line ends: only a space beside another of them is tied
            if not ("  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " "):
                return words[0], words[1:]
        elif not TIED.search(text):
            return words[0], words[1:]
        out, at = [], 0
        for end in (*(m.start() for m in TIED.finditer(text)), len(text)):
            mine = text[at:end].split(" ")
            if out:
                mine[0] = f"{out.pop()} {mine[0]}"
            out += mine
            at = end + 1
        return out[0], out[1:]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
