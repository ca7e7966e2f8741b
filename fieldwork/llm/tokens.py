"""Exact, fast tokenising with the ``tokenizers`` library inside tasks.

Texts are cut only before a blank that follows a non-blank, where both vocabularies' patterns always have a
token border: no token holds a blank behind a non-blank.  Equal pieces of a slice are found by hashing all pieces with numpy (two hashes), and a table of bounded size, probed
for all pieces of a slice at once, maps hashes to ids that lie one after the other in one array; so the library encodes most
pieces once per worker.  Pieces that are one Latin word, with punctuation behind it, go straight to the library's BPE
model, as splitting them is plain; words of ASCII letters are told by numpy.  ``tests/llm`` compares with encoding whole texts.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from fieldwork.llm.common import _BYTE, _LOWER, _R, mix, powers, text_slices

SLOTS = 1 << 21          # of the table of pieces, 14 bytes each; it is emptied when two thirds are taken
POOL = 6_000_000         # ids in the table, two bytes each (four for vocabularies above 65,536)
CACHE_BYTES = 48         # longer pieces are not kept
TAIL = 8                 # punctuation behind a plain word, at most
SLICE_BYTES = 2 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_CUT = np.zeros(256, bool)  # blanks in every reading
_CUT[[*range(0x09, 0x0E), 0x20]] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_MARKS = "".join(chr(b) for b in np.flatnonzero(_PUNCT))
_ENCODERS: dict[str, "Encoder"] = {}


def tokenizer_path(name_or_path: str) -> str:
    """A path as it is, or the place of an installed public vocabulary file."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers
    return public_tokenizers.path(name_or_path)


def piece_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where pieces of the texts begin: at each non-empty text, and before each blank after a non-blank.

    After characters that start like a blank of Unicode (C2 85, C2 A0, E1 9A, E2 80, E2 81, E3 80) no cut is made:
    a longer piece is always right."""
    cut = np.zeros(len(data), bool)
    cut[1:] = _CUT[data[1:]] & ~_BLANK[data[:-1]]
    wide = np.flatnonzero(cut[1:] & (data[:-1] >= 0x80)) + 1
    if len(wide):
        last, lead, third = data[wide - 1], data[wide - 2], data[np.maximum(wide - 3, 0)]
        doubt = ((lead == 0xC2) & ((last == 0x85) | (last == 0xA0))) | ((third == 0xE1) & (lead == 0x9A)) \
            | ((third == 0xE2) & ((lead == 0x80) | (lead == 0x81))) | ((third == 0xE3) & (lead == 0x80))
        cut[wide[doubt]] = False
    cut[offs[:-1][np.diff(offs) > 0]] = True
    return np.flatnonzero(cut)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet as a translation of Latin-1 code points: printable bytes are themselves, the others follow from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _plain_kind(lib) -> str | None:
    """How the vocabulary treats a plain word: ``spaced`` (the space before it belongs to it), ``word`` (it does not), or unknown."""
    conf = json.loads(lib.to_str())
    pre, norm = conf["pre_tokenizer"] or {}, conf["normalizer"] or {}
    if conf["model"]["type"] != "BPE" or conf["model"].get("dropout"):
        return None
    if not norm and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
        return "spaced"
    steps, norms = pre.get("pretokenizers", []), [x["type"] for x in norm.get("normalizers", [])]
    if norms == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"] and not steps[1]["use_regex"] \
            and not steps[1]["add_prefix_space"] and steps[0]["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"):
        return "word"
    return None


class PieceTable:
    """Piece hash -> ids, by open addressing in numpy arrays of fixed size; all operations take many hashes at once."""

    def __init__(self, slots: int, pool: int, kind: np.dtype):
        self.keys = np.zeros(slots, np.uint64)
        self.tags = np.zeros(slots, np.uint32)
        self.at = np.zeros(slots, np.uint32)
        self.size = np.zeros(slots, np.uint8)
        self.pool = np.zeros(pool, kind)
        self.taken = self.used = 0

    def find(self, h: np.ndarray, tags: np.ndarray | None) -> np.ndarray:
        """The slot of each hash, -1 if it is not there (with this tag, or with any for None)."""
        out = np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        slot = (h & np.uint64(len(self.keys) - 1)).astype(np.int64)
        while len(todo):
            held = self.keys[slot]
            hit = held == h[todo]
            out[todo[hit]] = slot[hit]
            on = ~hit & (held != 0)
            todo, slot = todo[on], (slot[on] + 1) & (len(self.keys) - 1)
        if tags is not None:
            out[(out >= 0) & (self.tags[out] != tags)] = -1
        return out

    def add(self, h: np.ndarray, tags: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Add hashes that ``find`` did not find, with their ids one after the other."""
        if self.taken + len(h) > len(self.keys) * 2 // 3 or self.used + len(ids) > len(self.pool):
            self.keys[:] = 0
            self.taken = self.used = 0
        if len(h) > len(self.keys) // 2 or len(ids) > len(self.pool):
            return
        at = self.used + np.cumsum(size) - size
        todo = np.arange(len(h))
        slot = (h & np.uint64(len(self.keys) - 1)).astype(np.int64)
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[todo[free]]  # of several for one slot the last stays; the others go on
            mine = self.keys[slot] == h[todo]
            self.tags[slot[mine]], self.at[slot[mine]], self.size[slot[mine]] = tags[todo[mine]], at[todo[mine]], size[todo[mine]]
            todo, slot = todo[~mine], (slot[~mine] + 1) & (len(self.keys) - 1)
        self.pool[self.used:self.used + len(ids)] = ids
        self.taken, self.used = self.taken + len(h), self.used + len(ids)


class Encoder:
    """One vocabulary file and its table of pieces."""

    def __init__(self, name_or_path: str, slots: int = SLOTS, pool: int = POOL):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(tokenizer_path(name_or_path))
        self.lib.encode_special_tokens = True  # their strings in a text are ordinary text
        kind = np.uint16 if self.lib.get_vocab_size() <= 1 << 16 else np.uint32
        self.table = PieceTable(slots, pool, kind)
        self.kind, self.letters = _plain_kind(self.lib), _byte_letters()
        self.tails: dict[str, list[int]] = {}
        # what a line feed before a word is: an id of its own, or nothing
        self.feed = [t.id for t in self.lib.model.tokenize(self.letters[0x0A])] if self.kind == "spaced" else []

    def _core(self, text: str) -> tuple[bool, str, str] | None:
        """Of a piece that is one Latin word and punctuation: line feed before it, what the model gets of it, and the punctuation; None for others."""
        lead = text[0] if text[0] in " \n" else ""
        word = text[len(lead):]
        core = word.rstrip(_MARKS)
        tail = word[len(core):]
        if not core.isalpha() or max(core) > "\u024f" or len(tail) > TAIL:  # up to there all letters are in normal form
            return None
        if self.kind == "word":
            if "\u0130" in core:  # its small form is two characters
                return None
            core = core.lower()
        elif lead == " ":
            core = " " + core
        return lead == "\n", core.encode().decode("latin-1").translate(self.letters), tail

    def _tail(self, tail: str) -> list[int]:
        if tail not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[tail] = [t.id for t in self.lib.model.tokenize(tail)]
        return self.tails[tail]

    def _plain(self, words: Iterator[tuple[bool, str, str]]) -> tuple[list[int], list[int]]:
        """The ids of plain words one after the other, and how many each has."""
        tokenize, flat, sizes = self.lib.model.tokenize, [], []
        for feed, core, tail in words:
            ids = [t.id for t in tokenize(core)]
            if feed:
                ids = self.feed + ids
            if tail:
                ids += self._tail(tail)
            flat += ids
            sizes.append(len(ids))
        return flat, sizes

    def _encode(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of pieces of a slice in one array, and where each piece's ids begin and how many there are."""
        base, size = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        parts, used = [np.zeros(0, np.uint32)], 0

        def put(which, flat, sizes):
            nonlocal used
            sizes = np.array(sizes, np.int64)
            base[which], size[which] = used + np.cumsum(sizes) - sizes, sizes
            parts.append(np.array(flat, np.uint32))
            used += len(flat)

        rest = np.arange(len(starts))
        if self.kind and len(starts):
            letters, marks = np.zeros(len(data) + 1, np.int32), np.zeros(len(data) + 1, np.int32)
            np.cumsum(_ALPHA[data], out=letters[1:])
            np.cumsum(_PUNCT[data], out=marks[1:])
            lead, ends = data[starts], starts + lens
            begin = starts + ((lead == 0x20) | (lead == 0x0A))
            middle = begin + letters[ends] - letters[begin]
            easy = (middle > begin) & (letters[middle] - letters[begin] == middle - begin) \
                & (marks[ends] - marks[middle] == ends - middle) & (ends - middle <= TAIL)
            text = (_LOWER[data] if self.kind == "word" else data).tobytes().decode("latin-1")
            which = np.flatnonzero(easy)
            spaced = [self.letters[0x20] if x else "" for x in (lead[which] == 0x20).tolist()] if self.kind == "spaced" else [""] * len(which)
            cuts = zip((lead[which] == 0x0A).tolist(), spaced, begin[which].tolist(), middle[which].tolist(), ends[which].tolist())
            put(which, *self._plain((feed, space + text[a:b], text[b:c]) for feed, space, a, b, c in cuts))
            rest = np.flatnonzero(~easy)
        raw = data.tobytes()
        texts = [raw[a:a + n].decode() for a, n in zip(starts[rest].tolist(), lens[rest].tolist())]
        cores = [self._core(t) for t in texts] if self.kind else [None] * len(texts)
        put(rest[[i for i, c in enumerate(cores) if c is not None]], *self._plain(c for c in cores if c is not None))
        hard = [i for i, c in enumerate(cores) if c is None]
        for k in range(0, len(hard), 4096):
            some = hard[k:k + 4096]
            ids = [e.ids for e in self.lib.encode_batch_fast([texts[i] for i in some], add_special_tokens=False)]
            put(rest[some], [x for one in ids for x in one], [len(one) for one in ids])
        return np.concatenate(parts), base, size

    def encode_slice(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """Ids (uint32) of each text of a slice."""
        n = len(offs) - 1
        if not len(data):
            return [np.zeros(0, np.uint32)] * n
        starts = piece_starts(data, offs)
        lens = np.diff(starts, append=len(data))
        pos = np.arange(len(data)) - np.repeat(starts, lens)
        scale = powers(int(_R), int(lens.max()))
        vals = _BYTE[data] * scale[pos]
        one = mix(np.add.reduceat(vals, starts) + lens.astype(np.uint64)) | np.uint64(1)  # zero marks a free slot
        two = np.bitwise_xor.reduceat(vals, starts)
        keys, rep, inv = np.unique(one, return_index=True, return_inverse=True)
        if (two != two[rep][inv]).any() or (lens != lens[rep][inv]).any():  # two pieces share a hash: neither grouped nor kept
            rep = inv = np.arange(len(starts))
            keys = None
        tags = (two[rep] >> np.uint64(32)).astype(np.uint32) ^ lens[rep].astype(np.uint32)
        slot = self.table.find(keys, tags) if keys is not None else np.full(len(rep), -1)
        new = np.flatnonzero(slot < 0)
        fresh, base_new, size_new = self._encode(data, starts[rep[new]], lens[rep[new]])
        size, base = self.table.size[slot].astype(np.int64), self.table.at[slot].astype(np.int64)
        size[new], base[new] = size_new, base_new
        size, base, known = size[inv], base[inv], (slot >= 0)[inv]
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1])) + np.repeat(base - (ends - size), size)
        from_table = np.repeat(known, size)
        flat = np.empty(len(at), np.uint32)
        flat[from_table] = self.table.pool[at[from_table]]
        flat[~from_table] = fresh[at[~from_table]]
        if keys is not None and len(new):
            keep = lens[rep[new]] <= CACHE_BYTES
            # a key that is there with another tag is a hash shared by two pieces; it keeps its first meaning
            keep &= self.table.find(keys[new], None) < 0
            ends_new = np.cumsum(size_new[keep])
            ids = fresh[np.arange(int(ends_new[-1]) if len(ends_new) else 0) + np.repeat(base_new[keep] - (ends_new - size_new[keep]), size_new[keep])]
            self.table.add(keys[new[keep]], tags[new[keep]], ids, size_new[keep])
        cut = np.concatenate([[0], ends])[np.searchsorted(starts, offs)]
        return [flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def encode_column(self, col: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """``(first_row, end_row, ids per row)`` for slices of a string column; null is empty."""
        for i, j, data, offs in text_slices(col, SLICE_BYTES):
            yield i, j, self.encode_slice(data, offs)


def encoder(name_or_path: str) -> Encoder:
    """The worker's encoder for this vocabulary."""
    if name_or_path not in _ENCODERS:
        _ENCODERS[name_or_path] = Encoder(name_or_path)
    return _ENCODERS[name_or_path]
