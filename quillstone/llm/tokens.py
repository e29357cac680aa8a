"""Tokenising whole Arrow columns with a public tokenizer, word by word through a bounded memo of packed arrays."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import SPACE, buffer_of, lower_ascii, ragged, slices, strings, word_hashes, word_spans


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?#$%&*")] = True
#: Second bytes of the Latin-1 letters from U+00C0 on, whose first byte is 0xC3; the capitals among them.
_LATIN = np.zeros(256, bool)
_LATIN[128:192] = True
_LATIN[[0x97, 0xB7]] = False
_CAPITAL = _LATIN.copy()
_CAPITAL[0x9F:] = False
_BLANK = np.zeros(256, bool)
_BLANK[list(SPACE)] = True


_PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch
#: Byte-level letters: bytes without a visible Latin-1 character take the code points from 256 on, in order.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_HELD: dict[str, ColumnTokenizer] = {}


def worker_tokenizer(path: str) -> ColumnTokenizer:
    """The Python worker's own tokenizer, whose memo lasts from task to task."""
    if path not in _HELD:
        _HELD[path] = ColumnTokenizer(path)
    return _HELD[path]


def parted(col: pa.Array) -> pa.Array:
    """The texts in lower case (ASCII, Latin-1) with a space before stops that end a word after such a letter; the ids stay the same."""
    raw, offs = buffer_of(col)
    if not len(raw):
        return col
    letter = _LETTER[raw]
    wide = np.flatnonzero(raw[:-1] == 0xC3) + 1
    wide = wide[_LATIN[raw[wide]]]
    letter[wide] = True
    last = np.zeros(len(raw) + 1, bool)
    last[offs] = True
    ends = np.flatnonzero(_STOP[raw] & (last[1:] | np.concatenate([_BLANK[raw[1:]], [True]])))
    starts = ends.copy()
    for _ in range(4):  # runs of up to four stops; longer ones stay whole
        back = (starts > 0) & ~last[starts]
        back[back] = _STOP[raw[starts[back] - 1]]
        if not back.any():
            break
        starts[back] -= 1
    ok = (starts > 0) & ~last[starts]
    ok[ok] = letter[starts[ok] - 1]
    at = starts[ok]
    small = lower_ascii(raw)
    small[wide[_CAPITAL[raw[wide]]]] += 32
    out = np.insert(small, at, 32)
    moved = (offs + np.searchsorted(at, offs)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(col), pa.py_buffer(moved), pa.py_buffer(out))


def drops_white_space(path: str) -> bool:
    """Whether a tokenizer file says that white space is dropped, case with it, and text never joined across it.

    That is so if it turns white space into single blanks, lower-cases, and its splitter keeps only
    matches of a pattern whose parts hold no white space; others are encoded whole.
    """
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    steps = (told.get("normalizer") or {}).get("normalizers", [])
    split = (told.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    blank = any(x.get("type") == "Replace" and x.get("pattern") == {"Regex": "\\s+"} and x.get("content") == " " for x in steps)
    kept = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True
    parts = str((split.get("pattern") or {}).get("Regex", " ")).split("|")
    solid = all(re.fullmatch(r"'[a-z]+|\[?\\p\{[LN]\}\]?\+?|\[\^\\s(\\p\{[LN]\})*\]\+?", x) for x in parts)
    return blank and kept and solid and any(x.get("type") == "Lowercase" for x in steps) and told.get("model", {}).get("end_of_word_suffix") == "</w>"


class _Memo:
    """A hash table in arrays: from two 64-bit hashes of a word to its ids; emptied when `most` words are in it."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.size = 1 << max(4, (2 * most - 1).bit_length())
        self.clear()

    def clear(self) -> None:
        self.one, self.two = np.zeros((2, self.size), np.uint64)
        self.at, self.count = np.full(self.size, -1, np.int64), np.zeros(self.size, np.int32)
        self.ids, self.used, self.words = np.zeros(1 << 16, np.uint32), 0, 0

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The slot of each word, -1 where it is not known."""
        out = np.full(len(one), -1, np.int64)
        mask = np.uint64(self.size - 1)
        rows, slot = np.arange(len(one)), (one & mask).astype(np.int64)
        while len(rows):
            held = self.at[slot] >= 0
            same = held & (self.one[slot] == one[rows]) & (self.two[slot] == two[rows])
            out[rows[same]] = slot[same]
            on = held & ~same
            rows, slot = rows[on], (slot[on] + 1) & int(mask)
        return out

    def add(self, one: np.ndarray, two: np.ndarray, flat: np.ndarray, lens: np.ndarray) -> None:
        """Distinct words that are not known yet."""
        if self.words + len(one) > self.most:
            self.clear()
            if len(one) > self.most:
                return
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        place = self.used + np.cumsum(lens) - lens
        self.used, self.words = self.used + len(flat), self.words + len(one)
        mask = self.size - 1
        rows, slot = np.arange(len(one)), (one & np.uint64(mask)).astype(np.int64)
        while len(rows):
            free = self.at[slot] < 0
            _, first = np.unique(slot, return_index=True)  # one word a slot and step
            take = np.zeros(len(rows), bool)
            take[first] = True
            take &= free
            to, who = slot[take], rows[take]
            self.one[to], self.two[to], self.at[to], self.count[to] = one[who], two[who], place[who], lens[who]
            rows, slot = rows[~take], (slot[~take] + ~free[~take]) & mask


class ColumnTokenizer:
    """Ids of whole texts, as the tokenizers library gives them with add_special_tokens=False.

    by_word says that the tokenizer never joins text across ASCII white space and ignores the case of
    A-Z; by default its file tells. Then distinct words are encoded once and remembered: at most
    `memo` words of at most 64 bytes, by 128 bits of hashes. Other tokenizers get whole texts.
    """

    def __init__(self, path: str, by_word: bool | None = None, memo: int = 600_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.by_word = drops_white_space(path) if by_word is None else by_word
        self.memo = _Memo(memo)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Words of small Latin letters alone are one piece to the splitter and go to its BPE model directly."""
        out: list = [None] * len(words)
        rest = []
        tokenize = self.encoder.model.tokenize
        for i, w in enumerate(words):
            if _PLAIN(w):
                out[i] = array("I", [t.id for t in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_LETTERS))]).tobytes()
            else:
                rest.append(i)
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for i, ids in zip(some, self._encode([words[i] for i in some]), strict=True):
                out[i] = ids
        return out

    def _by_word(self, part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not pc.any(pc.match_substring(part, "<|")).as_py():  # no special token's name
            part = parted(part)
        raw, offs = buffer_of(part)
        starts, ends, first = word_spans(raw, offs)
        one, two = word_hashes(raw, starts, ends), word_hashes(raw, starts, ends, 1)
        slot = self.memo.find(one, two)
        new = np.flatnonzero(slot < 0)
        _, some, which = np.unique(one[new], return_index=True, return_inverse=True)
        if len(some) < len(new) and (two[new][some][which] != two[new]).any():  # two words of one hash
            _, some, which = np.unique(np.stack([one[new], two[new]], 1), axis=0, return_index=True, return_inverse=True)
        who = new[some]
        whole = raw.tobytes()
        found = self._encode_words([whole[a:b].decode() for a, b in zip(starts[who].tolist(), ends[who].tolist(), strict=True)])
        own = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        # ids of known words lie in the memo, those of new ones behind it
        at, lens = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        old = slot >= 0
        at[old], lens[old] = self.memo.at[slot[old]], self.memo.count[slot[old]]
        at[new], lens[new] = (self.memo.used + np.cumsum(own) - own)[which.reshape(-1)], own[which.reshape(-1)]
        got = np.concatenate([self.memo.ids[: self.memo.used], flat])[ragged(at, lens)]
        short = np.flatnonzero(ends[who] - starts[who] <= 64)
        self.memo.add(one[who[short]], two[who[short]], flat[ragged((np.cumsum(own) - own)[short], own[short])], own[short])
        return got, np.concatenate([[0], np.cumsum(lens)])[first]

    def encode(self, col: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a string column (null: empty), each text followed by end_id, and the row offsets."""
        ids, offsets, base = [], [np.zeros(1, np.int64)], 0
        for _, part in slices(strings(col), 2 << 20):
            if self.by_word:
                got, ends = self._by_word(part)
            else:
                found = self._encode(part.to_pylist())
                got = np.frombuffer(b"".join(found), "<u4")
                ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)])
            if end_id is not None:
                got = np.insert(got, ends[1:], end_id)
                ends = ends + np.arange(len(ends))
            ids.append(got)
            offsets.append(base + ends[1:])
            base += len(got)
        return (np.concatenate(ids) if ids else np.zeros(0, "<u4")), np.concatenate(offsets)
