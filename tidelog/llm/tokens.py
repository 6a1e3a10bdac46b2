"""Token ids of whole texts by the tokenizers library, with repeated chunks encoded once.

A byte-level tokenizer with the usual pattern always starts a new piece in certain places, which ASCII
bytes show: before a space beside something that is not white space, around a line feed that stands
alone, and after a letter that something other than a letter follows. Texts are cut there, each
distinct chunk is encoded once by the library and remembered by the Python worker, and the ids of the
chunks are joined. Chunks are told apart by all their bytes. Texts that contain an added token, and
all texts of other kinds of tokenizer, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Bytes of text that are looked up at a time.
BATCH = 400_000
#: Places in a worker's memory of chunks, as a power of two: 21 bytes each, beside the ids. Memory only: what finds no place is encoded again.
PLACES = 20
#: Bytes of a short chunk; longer ones that are remembered: their number and bytes.
SHORT, LONG_KEPT, LONG_KEPT_BYTES = 15, 50_000, 64
#: Letters only, in UTF-8, of blocks that hold nothing else (Latin, Cyrillic): one piece, so the model takes it as it is.
_PLAIN = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8\xd0\xd1\xd3][\x80-\xbf])+")
_WORD = re.compile(r" ?\S+")
_OTHER, _LETTER, _WHITE, _MAYBE = 0, 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[[0x20, *range(0x09, 0x0E)]] = _WHITE
# what can begin or end a character that is white space beyond ASCII
_KIND[[0xC2, 0xE1, 0xE2, 0xE3, 0x80, 0x81, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = _MAYBE
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_loaded: dict[str, "ChunkEncoder"] = {}


def byte_letters() -> str:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it can be printed, else the next one from U+0100 on."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in printed else chr(next(rest)) for b in range(256))


def starts(chars: np.ndarray) -> np.ndarray:
    """Where a piece surely begins, for bytes that end with one that is no white space; the first byte is left out."""
    kind = _KIND[chars]
    white = kind == _WHITE
    solid = (kind == _OTHER) | (kind == _LETTER)
    first = np.zeros(len(chars), bool)
    before, after = solid[:-1], np.append(solid[2:], True)
    gap = white[1:]
    first[1:] = gap & (before | (chars[1:] == 0x20) & after)
    line = np.flatnonzero((chars[1:-1] == 0x0A) & solid[:-2] & solid[2:]) + 1
    first[line + 1] = True
    first[1:] |= (kind[:-1] == _LETTER) & (kind[1:] == _OTHER) & (chars[1:] < 0x80)
    return first


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.cut = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.added = [t["content"].encode("utf-8") for t in spec.get("added_tokens", [])]
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids if self.cut else []
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.known = Known(self.dtype)
        self.long: dict[bytes, np.ndarray] = {}

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, one after the other, and how many each has.

        Letters alone go to the model in the vocabulary's letters. Other chunks without white space
        inside go to the library a few hundred in one string: a line feed between two of them is a token
        of its own, where their ids are cut. The rest go one by one."""
        number = np.zeros(len(chunks), np.int64)
        plain, words, others = [], [], []
        for k, chunk in enumerate(chunks):
            if chunk.isalpha() or chunk[:1] == b" " and chunk[1:].isalpha() or _PLAIN.fullmatch(chunk):
                plain.append(k)
            else:
                (words if len(self.line) == 1 and _WORD.fullmatch(chunk.decode("utf-8")) else others).append(k)
        flat: list[int] = []
        tokenize = self.model.tokenize
        spelt = b"\n".join(chunks[k] for k in plain).decode("latin-1").translate(self.letters)
        for k, word in zip(plain, spelt.split(self.letters[10]) if plain else []):
            found = tokenize(word)
            number[k] = len(found)
            flat += [t.id for t in found]
        parts = [np.array(flat, self.dtype)]
        for a in range(0, len(words), 500):
            some = words[a : a + 500]
            ids = self._whole([b"\n".join(chunks[k] for k in some).decode("utf-8")])[0]
            line = ids == self.line[0]
            edge = np.concatenate([[-1], np.flatnonzero(line), [len(ids)]])
            number[some] = np.diff(edge) - 1
            parts.append(ids[~line])
        for k, ids in zip(others, self._whole([chunks[k].decode("utf-8") for k in others])):
            number[k] = len(ids)
            parts.append(ids)
        order = np.array([*plain, *words, *others], np.int64)
        ids, taken = np.concatenate(parts), np.empty(len(order), np.int64)
        taken[order] = np.cumsum(number[order]) - number[order]
        return ids.take(_runs(taken, number)), number

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned integers."""
        if not self.cut:
            return self._whole(texts)
        out: list[np.ndarray] = [np.zeros(0, self.dtype)] * len(texts)
        group: list[tuple[int, bytes]] = []
        size = 0
        for k, t in enumerate(texts):
            raw = t.encode("utf-8")
            if any(x in raw for x in self.added):
                out[k] = self._whole([t])[0]
            elif raw:
                group.append((k, raw))
                size += len(raw)
                if size >= BATCH:
                    self._look_up(group, out)
                    group, size = [], 0
        if group:
            self._look_up(group, out)
        return out

    def _look_up(self, group: list[tuple[int, bytes]], out: list[np.ndarray]) -> None:
        raw = b"\0".join(t for _, t in group) + b"\0"
        chars = np.frombuffer(raw, np.uint8)
        ends = np.cumsum([len(t) + 1 for _, t in group])  # of the texts, with the byte between two
        first = starts(chars)
        first[0] = True
        first[ends[:-1]] = True
        first[ends - 1] = True
        start = np.flatnonzero(first)
        length = np.diff(start, append=len(raw))
        own = np.searchsorted(start, ends - 1)  # chunks that are the byte between two texts
        length[own] = 0
        padded = np.frombuffer(raw + b"\0" * 16, np.uint8)
        eight = np.ndarray(len(raw) + 8, "<u8", padded, strides=(1,)).copy()  # the eight bytes from each place on
        low = eight[start] & _MASKS[np.minimum(length, 8)]
        high = eight[start + 8 * (length > 8)] & _MASKS[np.clip(length - 8, 0, 7)] | length.astype(np.uint64) << np.uint64(56)
        place, number = self.known.find(low, high, length)
        far = np.flatnonzero(length > SHORT)
        missing = np.flatnonzero((number < 0) & (length <= SHORT))
        if len(missing):
            missing, far = self._learn(raw, start, length, low, high, missing, far, place, number)
        if len(far):
            extra = self._long(raw, start, length, far)
            number[far] = [len(x) for x in extra]
            place[far] = self.known.append(np.concatenate(extra)) + np.cumsum(number[far]) - number[far]
        done = np.cumsum(number)
        ids = self.known.ids.take(_runs(place, number))
        self.known.forget()
        cuts = [0, *done[own].tolist()]
        for (k, _), a, b in zip(group, cuts, cuts[1:]):
            out[k] = ids[a:b]

    def _learn(self, raw, start, length, low, high, missing, far, place, number):
        """Encodes the chunks that are not known, each once, and fills in their places and numbers of ids; adds to far those whose hash another one has."""
        _, at, inverse = np.unique(mixed(low[missing], high[missing]), return_index=True, return_inverse=True)
        one = missing[at]
        same = (low[one][inverse] == low[missing]) & (high[one][inverse] == high[missing])
        kept = self.known.reserve(low[one], high[one])
        order = np.concatenate([np.flatnonzero(kept >= 0), np.flatnonzero(kept < 0)])  # the last are forgotten after use
        ids, n = self._chunks([raw[a : a + n] for a, n in zip(start[one[order]].tolist(), length[one[order]].tolist())])
        where = self.known.append(ids, int(n[: int((kept >= 0).sum())].sum())) + np.cumsum(n) - n
        self.known.put(kept[order], where, n)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        place[missing], number[missing] = where[back][inverse], n[back][inverse]
        return missing, np.sort(np.concatenate([far, missing[~same]]))

    def _long(self, raw: bytes, start: np.ndarray, length: np.ndarray, far: np.ndarray) -> list[np.ndarray]:
        chunks = [raw[a : a + n] for a, n in zip(start[far].tolist(), length[far].tolist())]
        fresh = [c for c in dict.fromkeys(chunks) if c not in self.long]
        ids, number = self._chunks(fresh)
        found = dict(zip(fresh, np.split(ids, np.cumsum(number)[:-1])))
        out = [found[c] if c in found else self.long[c] for c in chunks]
        if len(self.long) > LONG_KEPT:
            self.long.clear()
        self.long.update((c, x.copy()) for c, x in found.items() if len(c) <= LONG_KEPT_BYTES)
        return out


def _runs(begin: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1 and so on, number of them, for each of both."""
    done = np.cumsum(number)
    return np.repeat(begin - (done - number), number) + np.arange(done[-1] if len(done) else 0)


def mixed(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    x = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29)) ^ high) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Known:
    """Ids of short chunks. A chunk has two places to be; its two words, with its length, stand there and are compared. A full memory starts anew."""

    def __init__(self, dtype: np.dtype):
        size = 1 << PLACES
        self.low, self.high = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.place, self.number = np.zeros(size, np.int32), np.zeros(size, np.uint8)
        self.ids, self.used, self.kept, self.full = np.zeros(1 << 16, dtype), 0, 0, 0

    @staticmethod
    def _places(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = mixed(low, high)
        return (code >> np.uint64(64 - PLACES)).astype(np.int64), (code & np.uint64((1 << PLACES) - 1)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of each chunk; a number of -1: not known. Empty ones have none."""
        place, number = np.zeros(len(low), np.int64), np.where(length == 0, 0, -1)
        todo = np.flatnonzero((length > 0) & (length <= SHORT))
        places = self._places(low[todo], high[todo])
        for at in places:
            hit = (self.high[at] == high[todo]) & (self.low[at] == low[todo])
            place[todo[hit]], number[todo[hit]] = self.place[at[hit]], self.number[at[hit]]
            if hit.all():
                break
        return place, number

    def reserve(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where each of these different chunks is to stand; -1: nowhere."""
        out = np.full(len(low), -1, np.int64)
        for at in self._places(low, high):
            todo = np.flatnonzero((out < 0) & (self.high[at] == 0))
            self.low[at[todo]], self.high[at[todo]] = low[todo], high[todo]  # of two that want one place, the last has it
            got = todo[(self.low[at[todo]] == low[todo]) & (self.high[at[todo]] == high[todo])]
            out[got] = at[got]
        self.full += int((out >= 0).sum())
        return out

    def put(self, places: np.ndarray, where: np.ndarray, number: np.ndarray) -> None:
        kept = places >= 0
        self.place[places[kept]], self.number[places[kept]] = where[kept], number[kept]

    def append(self, more: np.ndarray, kept: int = 0) -> int:
        """Adds ids, of which the first kept ones outlive forget(); where they begin."""
        while self.used + len(more) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        at = self.used
        self.ids[at : at + len(more)] = more
        if kept:
            self.kept = at + kept
        self.used += len(more)
        return at

    def forget(self) -> None:
        if self.full > 3 << PLACES >> 2:
            self.high[:] = 0
            self.kept = self.full = 0
        self.used = self.kept


def encoder(path: str) -> ChunkEncoder:
    """The worker's own encoder, loaded once."""
    if path not in _loaded:
        _loaded[path] = ChunkEncoder(path)
    return _loaded[path]


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
