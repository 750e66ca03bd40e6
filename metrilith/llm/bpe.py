"""Token ids of whole texts by the `tokenizers` library, with a cache of pieces.

Encoding a text equals joining the encodings of its pieces where no token can reach
over a cut. Two kinds of cut are known to be safe:

* ``drop_space``: the tokenizer drops white space before it splits words. Cuts are made
  at white space and the white space itself goes.
* ``lead_space``: a byte-level tokenizer whose words take the one space before them.
  Cuts are made before a single space or line end that has other characters on both
  sides; runs of white space are never cut.

Any other tokenizer takes ``whole``: no cuts. Pieces repeat far more often than texts
do, so each distinct piece is encoded once for a Python worker.

Pieces of a byte-level tokenizer are split and told apart by Arrow; Python sees each distinct one
of a call once. A new piece that ends in marks after a letter or digit is joined from
what stands before them and the marks, as such a tokenizer cuts there by itself. The same
holds for a tokenizer that drops white space and splits words from marks; if it lower-cases,
pieces of Latin-1 characters that differ in case alone are encoded once.
"""

from __future__ import annotations

import itertools
import json
import operator
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that stay in a worker's cache, the first that it met, as frequent ones come early; up
#: to twice as many are held during a task. Ten thousand take about three megabytes.
CACHE_PIECES = 400_000

_RUN = re.compile(r"\s\s|\A\s|\s\Z")
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Separators to Python's str.split that are no white space to the tokenizer.
_NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
#: A piece up to its last letter or digit, and marks after that; no apostrophes, which may begin a word's ending.
_MARKS = re.compile(r"(?s)(.*[0-9A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF])([!-&(-/:-@\[-`{-~]+)\Z")
#: Characters that normal forms leave alone, whatever follows of them.
_LATIN = re.compile(r"[!-~\u00C0-\u00FF]+")
_ENCODERS: dict[tuple[str, str], PieceEncoder] = {}


class PieceEncoder:
    """Encodes texts to packed little-endian ids (two bytes each if the vocabulary allows)."""

    def __init__(self, path: str, cut: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cut = {"drop_space": self._words, "lead_space": _CUT.split, "whole": lambda text: [text]}[cut]
        self.led = cut == "lead_space"
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.known: dict[str, bytes] = {}
        self.most = CACHE_PIECES
        # words that are found before all others aren't cut
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = re.compile("|".join(re.escape(t.content) for t in added.values()) or r"(?!)", re.IGNORECASE).search
        # a token that stands between pieces, so that many are encoded as one text
        self.between = next(((k, t.content) for k, t in added.items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)), None)
        self.lowers = cut == "drop_space" and _lowers(path)

    @staticmethod
    def _words(text: str) -> list[str]:
        return re.split(r"[^\S\x1c-\x1f]+", text) if any(x in text for x in _NOT_SPACE) else text.split()

    def _plain(self, texts: list[str]) -> list[bytes]:
        if self.lowers and self.between and not any(map(self.added, texts)):
            return self._joined(texts)
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        packed = np.fromiter(itertools.chain.from_iterable(ids), self.dtype).tobytes()
        edge = (np.cumsum([0, *map(len, ids)]) * np.dtype(self.dtype).itemsize).tolist()
        return [packed[a:b] for a, b in zip(edge, edge[1:], strict=False)]

    def _joined(self, texts: list[str]) -> list[bytes]:
        """Texts that hold none of the added tokens, a thousand at a time with one of these after each."""
        number, mark = self.between
        runs = [mark.join([*texts[k : k + 1000], ""]) for k in range(0, len(texts), 1000)]
        ids = np.fromiter(itertools.chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)), self.dtype)
        width, packed = ids.itemsize, ids.tobytes()
        end = np.flatnonzero(ids == number)
        begin = np.append(0, end[:-1] + 1)
        return [packed[a:b] for a, b in zip((begin * width).tolist(), (end * width).tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        if not self.led:
            return self._encode([self.cut(x) for x in texts], "")
        out = [b""] * len(texts)
        some = [k for k, x in enumerate(texts) if x]
        coded, runs = self._encode_led([texts[k] for k in some]) if some else ([], [])
        for k, x in zip(some, coded, strict=True):
            out[k] = x
        # pieces with their white space have a key of their own
        for k, x in zip(runs, self._encode([["  " + p for p in self.cut(texts[some[k]])] for k in runs], "  "), strict=True):
            out[some[k]] = x
        self._bound()
        return out

    def _encode(self, cut: list[list[str]], mark: str) -> list[bytes]:
        """Texts from their pieces, whose keys begin with a mark that isn't encoded."""
        known, new = self.known, {}
        held = [list(map(known.get, pieces)) for pieces in cut]
        # places of what isn't known yet, without a Python step for each piece
        gaps = [list(itertools.compress(range(len(x)), map(operator.is_, x, itertools.repeat(None)))) for x in held]
        for pieces, places in zip(cut, gaps, strict=True):
            new.update((pieces[k], None) for k in places)
        if new and self.lowers:
            self._new_words(list(new))
        elif new:
            known.update(zip(new, self._plain([p[len(mark) :] for p in new]), strict=True))
        for pieces, places, x in zip(cut, gaps, held, strict=True):
            for k in places:
                x[k] = known[pieces[k]]
        return [b"".join(x) for x in held]

    def _encode_led(self, texts: list[str]) -> tuple[list[bytes], list[int]]:
        """Texts, none empty, whose white space all stands alone between other characters, and the places of the other texts.

        A piece after a space is written without it, one after a line end with it; the first of a
        text is marked by a tab, with which no other piece begins where white space stands alone.
        """
        pieces = pc.split_pattern(pa.array(["\t" + x.replace("\n", " \n") for x in texts], pa.string()), " ")
        start, coded = pieces.offsets.to_numpy(), pieces.values.dictionary_encode()
        at = coded.indices.to_numpy()
        # one string and a split in place of a Python call for each
        distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), " ")[0].as_py().split(" ")
        held = list(map(self.known.get, distinct))
        new = [k for k, x in enumerate(held) if x is None]
        odd = {k for k in new if _odd(distinct[k])}
        first = pc.starts_with(coded.dictionary, "\t").to_numpy(zero_copy_only=False)[at]
        first[start[:-1]] = False
        runs: list[int] = []
        if odd or first.any():
            first |= np.isin(at, list(odd))
            runs = np.unique(np.searchsorted(start, np.flatnonzero(first), "right") - 1).tolist()
        todo = [k for k in new if k not in odd]
        for k, x in zip(todo, self._new([distinct[k] for k in todo]), strict=True):
            held[k] = x
        held = [x or b"" for x in held]
        ids = np.frombuffer(b"".join(held), self.dtype)
        n = np.fromiter(map(len, held), np.int64, len(held)) // ids.itemsize
        begin, n = (np.cumsum(n) - n)[at], n[at]
        end = np.cumsum(n)
        ids = ids[np.repeat(begin - (end - n), n) + np.arange(end[-1])]
        edge = np.append(0, end)[start].tolist()
        return [ids[a:b].tobytes() for a, b in zip(edge, edge[1:], strict=False)], runs

    def _new(self, pieces: list[str]) -> list[bytes]:
        """Ids of new pieces as `_encode_led` writes them."""
        known, cut = self.known, {}
        for p in pieces:
            if not p[-1].isalnum() and (m := _MARKS.match(p)) and not self.added(p):
                cut[p] = m.groups()
        # marks follow a letter or digit at once, so they have a key of their own
        parts = dict.fromkeys(x for head, marks in cut.values() for x in (head, "  " + marks))
        parts.update(dict.fromkeys(p for p in pieces if p not in cut))
        parts = [p for p in parts if p not in known]
        known.update(zip(parts, self._plain([p[2:] if p[:2] == "  " else p[1:] if p[0] == "\t" else p if p[0] == "\n" else " " + p for p in parts]), strict=True))
        known.update((p, known[head] + known["  " + marks]) for p, (head, marks) in cut.items())
        return list(map(known.__getitem__, pieces))

    def _new_words(self, pieces: list[str]) -> None:
        """Learn new pieces of a tokenizer of which `_lowers` holds."""
        known, parts = self.known, []
        for p in pieces:
            head, marks = p, ""
            if not self.added(p):
                if not p[-1:].isalnum() and (m := _MARKS.match(p)):
                    head, marks = m.groups()
                if _LATIN.fullmatch(head):
                    head = head.lower()
            parts.append((head, marks))
        new = [p for p in dict.fromkeys(itertools.chain.from_iterable(parts)) if p not in known]
        known.update(zip(new, self._plain(new), strict=True))
        known.update((p, known[head] + known[marks]) for p, (head, marks) in zip(pieces, parts, strict=True))

    def _bound(self) -> None:
        if len(self.known) > 2 * self.most:
            self.trim()

    def trim(self) -> None:
        """Forget all but the first pieces: during a task when they grow too many, and when it has ended."""
        self.known = dict(itertools.islice(self.known.items(), self.most))


def _odd(piece: str) -> bool:
    """Whether a piece of `_encode_led` shows that white space stands together or at an end of its text."""
    body = piece[1:] if piece[:1] in ("\t", "\n") else piece
    # no white space is printable but the space, at which pieces were split
    return not body or not body.isprintable() and _RUN.search(body) is not None


def _lowers(path: str) -> bool:
    """Whether a tokenizer lower-cases each character by itself and splits letters and digits from what else isn't white space."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    normal, pre = (x.get(y) or [x] for x, y in ((whole["normalizer"] or {}, "normalizers"), (whole["pre_tokenizer"] or {}, "pretokenizers")))
    kinds = {x.get("type") for x in normal}
    spaces = [x for x in normal if x.get("type") == "Replace"]
    split = pre[0].get("type") == "Split" and pre[0]["invert"] and pre[0]["behavior"] == "Removed" and pre[0]["pattern"].get("Regex", "")
    return {"Lowercase"} <= kinds <= {"NFC", "Lowercase", "Replace"} and all(x["pattern"] == {"Regex": r"\s+"} for x in spaces) and split == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def encoder(path: str, cut: str, cache: int = CACHE_PIECES) -> PieceEncoder:
    """This worker's encoder for a vocabulary file, with a cache of `cache` pieces."""
    if (path, cut) not in _ENCODERS:
        _ENCODERS[path, cut] = PieceEncoder(path, cut)
    _ENCODERS[path, cut].most = cache
    return _ENCODERS[path, cut]
