"""Token ids of whole texts with a vectorised unit table in front of a tokenizers-library model.

A text is cut where the model's own pre-tokenisation always cuts: before the one space that a byte-level model attaches
to a word, at white space for a model that drops it, and between an ASCII letter and one closing mark. The ids of the
units, joined, are the ids of the text. Units are found by a 64-bit hash in an open-addressing table held in arrays, so
whole batches are looked up at once; only units not seen before reach the library, many in one call. A text that holds
white space other than the six ASCII characters, or the string of an added token, goes to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .textbytes import SLICE, SPACED, SPACED_VALUES, _powers, fmix, text_bytes

#: Slots of the unit table of a worker (half are used; a full table starts anew, which costs time only).
TABLE = 1 << 21
_EXACT_VALUES = np.random.default_rng(77).integers(0, 2**64, 256, dtype=np.uint64)
_MARKS = b".,;:!?|"
_IS_MARK = np.isin(np.arange(256), list(_MARKS))
_IS_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_OTHER_SPACE = "[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_MAYBE_OTHER = np.isin(np.arange(256), [0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3])
_AFTER_SPACE = np.uint64(0xD6E8FEB86659FD93)
_models: dict[tuple[str, bool], "UnitEncoder"] = {}


class UnitEncoder:
    """encode(array of texts) gives (ids as uint32, offsets by text); null counts as empty.

    The ids are those of the library on the file with add_special_tokens=False: nothing is put around a text, and the
    string of a special token inside it gives that token. With ``plain_specials`` such strings are ordinary text.
    """

    def __init__(self, path: str, plain_specials: bool = False) -> None:
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = plain_specials
        added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([_OTHER_SPACE, *(f"(?i:{re.escape(t)})" for t in added)]))
        self.maybe_whole = _MAYBE_OTHER.copy()  # bytes that such white space or an added token may begin with
        for t in added:
            self.maybe_whole[[x.encode()[0] for x in (t[0], t[0].lower(), t[0].upper())]] = True
        self.spaces_kept = self.model.normalizer is None
        vocabulary = self.model.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin (byte-level) or end a word
        self.edge[[i for piece, i in vocabulary.items() if (piece[:1] == "\u0120" if self.spaces_kept else piece.endswith("</w>"))]] = True
        self.values = _EXACT_VALUES if self.spaces_kept else SPACED_VALUES
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(TABLE, np.uint64)
        self.slot = np.zeros(TABLE, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.units = 1  # unit 0 is empty
        self.marks = np.zeros(256, np.int64)
        for m in _MARKS:
            self.marks[m] = self._add([self._library([chr(m)])[0]])[0]
        self.gaps: dict[bytes, int] = {}

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, many: list[np.ndarray]) -> np.ndarray:
        """Store the ids of new units; their numbers."""
        sizes = np.array([len(x) for x in many], np.int64)
        flat = np.concatenate(many) if many else np.zeros(0, np.uint32)
        return self._add_flat(flat, sizes)

    def _add_flat(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        n = len(sizes)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.units + n > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.ids[self.used : self.used + len(flat)] = flat
        new = np.arange(self.units, self.units + n)
        self.start[new] = self.used + np.cumsum(sizes) - sizes
        self.size[new] = sizes
        self.used += len(flat)
        self.units += n
        return new

    def _words(self, words: list[str], before: str) -> np.ndarray:
        """Unit numbers of new words; words of letters only go to the library many in one text, cut apart by edge ids."""
        out = np.zeros(len(words), np.int64)
        plain = [i for i, w in enumerate(words) if w.isalpha()]
        rest = [i for i, w in enumerate(words) if not w.isalpha()]
        if before == "" and self.spaces_kept:
            plain, rest = [], range(len(words))
        for at in range(0, len(plain), 512):
            some = plain[at : at + 512]
            ids = self._library([before + " ".join([words[i] for i in some])])[0]
            edges = np.flatnonzero(self.edge[ids])
            if len(edges) != len(some):  # a word that the model cuts in some other way
                rest = [*rest, *some]
                continue
            cuts = np.append(edges, len(ids)) if self.spaces_kept else np.append(0, edges + 1)
            out[some] = self._add_flat(ids, np.diff(cuts))
        if rest:
            out[list(rest)] = self._add(self._library([before + words[i] for i in rest]))
        return out

    def _find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unit of each key, positions of keys not held)."""
        pos = (key & np.uint64(TABLE - 1)).astype(np.int64)
        unit = np.zeros(len(key), np.int64)
        open_, missing = np.arange(len(key)), []
        while len(open_):
            held = self.keys[pos[open_]]
            hit = held == key[open_]
            unit[open_[hit]] = self.slot[pos[open_[hit]]]
            missing.append(open_[held == 0])
            open_ = open_[~hit & (held != 0)]
            pos[open_] = (pos[open_] + 1) & (TABLE - 1)
        return unit, np.concatenate(missing) if missing else open_

    def _insert(self, key: np.ndarray, unit: np.ndarray) -> None:
        pos = (key & np.uint64(TABLE - 1)).astype(np.int64)
        open_ = np.arange(len(key))
        while len(open_):
            free = open_[self.keys[pos[open_]] == 0]
            self.keys[pos[free]] = key[free]  # of several, one stays
            mine = self.keys[pos[open_]] == key[open_]
            self.slot[pos[open_[mine]]] = unit[open_[mine]]
            open_ = open_[~mine]
            pos[open_] = (pos[open_] + 1) & (TABLE - 1)

    def _gap(self, raw: bytes) -> int:
        if (unit := self.gaps.get(raw)) is None:
            if len(self.gaps) > 65536:
                self.gaps.clear()
            unit = self.gaps[raw] = int(self._add(self._library([raw.decode()]))[0])
        return unit

    def _slice(self, data: np.ndarray, starts_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each text) of a run of texts; starts_at are the texts' offsets, with the end."""
        n = len(data)
        word = SPACED[data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = starts_at[(starts_at > 0) & (starts_at < n)]
        first[inner] |= word[inner]
        last[inner - 1] |= word[inner - 1]
        a, z = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _powers.get(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * up[:n], out=total[1:])
        marked = _IS_MARK[data[z - 1]] & (z - a > 1)
        marked[marked] = _IS_LETTER[data[z[marked] - 2]]
        stem = z - marked
        key = fmix((total[stem] - total[a]) * down[a])
        text_of = np.searchsorted(starts_at, a, "right") - 1
        spaced = np.zeros(len(a), bool)
        if self.spaces_kept:
            inside = a > starts_at[text_of]
            spaced[inside] = data[a[inside] - 1] == 32
            key = np.where(spaced, fmix(key ^ _AFTER_SPACE), key)
        key[key == 0] = 1
        unit, missing = self._find(key)
        if len(missing):
            new, at = np.unique(key[missing], return_index=True)
            at = missing[at]
            if self.units + len(new) > TABLE // 2:
                self._clear()
                return self._slice(data, starts_at)
            raw = data.tobytes()
            made = np.zeros(len(new), np.int64)
            for flag, before in ((True, " "), (False, "")):
                some = np.flatnonzero(spaced[at] == flag)
                if len(some):
                    made[some] = self._words([raw[x:y].decode() for x, y in zip(a[at[some]].tolist(), stem[at[some]].tolist(), strict=True)], before)
            self._insert(new, made)
            unit[missing] = made[np.searchsorted(new, key[missing])]
        rows = np.zeros((len(a), 4), np.int64)  # two gap units, the word, its mark
        rows[:, 2] = unit
        rows[marked, 3] = self.marks[data[z[marked] - 1]]
        bounds = np.searchsorted(a, starts_at)
        if self.spaces_kept:
            prev = np.concatenate([[0], z[:-1]]) if len(z) else z
            prev = np.maximum(prev, starts_at[text_of])
            for i in np.flatnonzero(a - spaced > prev).tolist():
                gap = data[prev[i] : a[i] - spaced[i]].tobytes()
                if spaced[i]:
                    rows[i, 0] = self._gap(gap)
                else:
                    rows[i, 0] = self._gap(gap[:-1]) if len(gap) > 1 else 0
                    rows[i, 1] = self._gap(gap[-1:])
            ends = np.zeros(len(starts_at) - 1, np.int64)
            for t in np.flatnonzero((starts_at[1:] > starts_at[:-1]) & ~word[np.maximum(starts_at[1:] - 1, 0)] if n else []).tolist():
                lo = max(int(starts_at[t]), int(z[bounds[t + 1] - 1]) if bounds[t + 1] else 0)
                ends[t] = self._gap(data[lo : starts_at[t + 1]].tobytes())
            seq = np.insert(rows.ravel(), 4 * bounds[1:], ends)
            bounds = 4 * bounds + np.arange(len(bounds))
        else:
            seq, bounds = rows.ravel(), 4 * bounds
        size = self.size[seq]
        ends_at = np.cumsum(size)
        ids = self.ids[np.repeat(self.start[seq] - ends_at + size, size) + np.arange(ends_at[-1] if len(size) else 0)]
        done = np.concatenate([[0], ends_at])
        return ids, np.diff(done[bounds])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_bytes(texts)
        whole = np.zeros(len(texts), bool)  # texts for the library
        if len(data):
            maybe = np.unique(np.searchsorted(offsets, np.flatnonzero(self.maybe_whole[data]), "right") - 1)
            for t in maybe.tolist():
                whole[t] = bool(self.whole.search(data[offsets[t] : offsets[t + 1]].tobytes().decode()))
        parts, counts = [], np.zeros(len(texts), np.int64)
        t = 0
        while t < len(texts):
            if whole[t]:
                parts += self._library([data[offsets[t] : offsets[t + 1]].tobytes().decode()])
                counts[t] = len(parts[-1])
                t += 1
                continue
            to = int(np.searchsorted(offsets, offsets[t] + SLICE, "right")) - 1
            to = max(to, t + 1)
            if whole[t:to].any():
                to = t + int(np.argmax(whole[t:to]))
            if offsets[to] - offsets[t] <= SLICE:
                ids, n = self._slice(data[offsets[t] : offsets[to]], offsets[t : to + 1] - offsets[t])
                parts.append(ids)
                counts[t:to] = n
            else:  # one long text
                for x, y in self._runs(data, int(offsets[t]), int(offsets[t + 1])):
                    ids, n = self._slice(data[x:y], np.array([0, y - x]))
                    parts.append(ids)
                    counts[t] += n[0]
            t = to
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum(counts)])

    @staticmethod
    def _runs(data: np.ndarray, at: int, end: int):
        """Cuts a long text before lone spaces."""
        while at < end:
            to = at + SLICE
            while to < end - 1 and not (data[to] == 32 and SPACED[data[to - 1]] and SPACED[data[to + 1]]):
                to += 1
            to = to if to < end - 1 else end
            yield at, to
            at = to


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with one more id at the end of every text."""
    return np.insert(ids, offsets[1:], np.uint32(end)), offsets + np.arange(len(offsets))


def encoder(path: str, plain_specials: bool = False) -> UnitEncoder:
    """One encoder per worker process, file and treatment of special tokens.

    A task runs one thread; threads of the library's own would cost each worker CPU time and memory.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, plain_specials) not in _models:
        _models[path, plain_specials] = UnitEncoder(path, plain_specials)
    return _models[path, plain_specials]
