"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

A text is lower-cased and cut at white space into words, since no token of the
vocabulary crosses white space. The frequent words of the corpus, with their ids
as outputs, are compiled into a minimal automaton that shares prefixes and
suffixes; it is kept in one memory-mapped file. A word is walked through it byte
by byte, all words of a batch at once; the index summed up on the way selects the
ids. Words that it lacks are merged exactly, lowest rank and leftmost first, all
new words of a batch at once.

Words whose treatment depends on Unicode tables outside of Latin (or that spell a
special token) go through the ``tokenizers`` library, so ids are always those of
the library; the other words of such texts are treated as all others. Words are
remembered by exact keys (module ``words``).
"""

from __future__ import annotations

import atexit
import json
import mmap
import os
import re
import shutil
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, slices, strings
from .words import Words, WordTable, split

# Fixed values of the tokenizer file: its split pattern, for lower-cased Latin text.
_LETTERS = "a-zªµºß-öø-ʯⱥⱦ"
_DIGITS = "0-9²³¹¼-¾"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+")
_PIECE_OR_END = re.compile(f"{_PIECE.pattern}|\n")
_FOREIGN = re.compile("[^\t-\r -~\xa1-įı-ɏ]")
_SPECIAL = ("<|startoftext|>", "<|endoftext|>")
_WHOLE_WORD_END = "</w>"
_LONG = 192  # bytes of a piece from which on the library's heap merges beat row-wise merges


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class HashTable:
    """Int64 keys to their positions, open addressing in numpy; -1 for absent keys."""

    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, slots: np.ndarray | None = None):
        self.keys = keys
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.mask = (1 << self.bits) - 1
        self.slots = slots if slots is not None else self._fill()

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self) -> np.ndarray:
        slots = np.full(1 << self.bits, -1, np.int32)
        pending = np.arange(len(self.keys), dtype=np.int32)
        at = self._home(self.keys)
        while len(pending):
            free = slots[at] < 0
            slots[at[free]] = pending[free]  # of those that want a free slot, one wins
            lost = slots[at] != pending
            pending, at = pending[lost], (at[lost] + 1) & self.mask
        return slots

    def find(self, keys: np.ndarray) -> np.ndarray:
        shape, keys = keys.shape, keys.ravel()
        at = self._home(keys)
        out = self.slots[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            out[open_] = self.slots[at[open_]]
            found = out[open_]
            open_ = open_[(found >= 0) & (self.keys[found] != keys[open_])]
        return out.reshape(shape)


class Merges:
    """The vocabulary and the merge table; exact merging of many pieces at once."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        letters = _byte_letters()
        self.byte_id = np.array([self.vocab[c] for c in letters], np.int32)
        self.last_id = np.array([self.vocab[c + _WHOLE_WORD_END] for c in letters], np.int32)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int32)
        self.width = max(self.vocab.values()) + 1
        keys = left * self.width + right
        # a pair that is listed twice has the later rank in the library's table
        _, last = np.unique(keys[::-1], return_index=True)
        keep = np.sort(len(keys) - 1 - last)
        self.rank_of, self.table = keep.astype(np.int32), HashTable(keys[keep])

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.table.find(left.astype(np.int64) * self.width + right)
        return np.where(found >= 0, self.rank_of[found], self.NONE)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and how many each has."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        counts = np.zeros(len(pieces), np.int64)
        rows: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            longest = max(8, 1 << int(sizes[order[at]] - 1).bit_length())
            end = min(int(np.searchsorted(sizes[order], longest, side="right")), at + max(1, (1 << 19) // longest))
            own = order[at:end]
            ids, n = self._merge_rows([pieces[k] for k in own], sizes[own])
            counts[own] = n
            rows.append((own, ids))
            at = end
        starts = np.concatenate(([0], np.cumsum(counts)))
        flat = np.empty(int(starts[-1]), np.int32)
        for own, ids in rows:
            flat[_spread(starts[own], counts[own])] = ids
        return flat, counts

    def _merge_rows(self, pieces: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(pieces), int(sizes.max())
        flat = np.frombuffer(b"".join(pieces) + bytes(width), np.uint8)
        raw = flat[(np.cumsum(sizes) - sizes)[:, None] + np.arange(width)]
        symbols = self.byte_id[raw]
        symbols[np.arange(n), sizes - 1] = self.last_id[raw[np.arange(n), sizes - 1]]
        ranks = np.full((n, width), self.NONE, np.int32)
        if width > 1:
            ranks[:, :-1] = self.ranks(symbols[:, :-1], symbols[:, 1:])
            ranks[np.arange(width)[None, :] >= (sizes - 1)[:, None]] = self.NONE
        left = sizes.copy()
        live = np.arange(n)
        s, r, w = symbols, ranks, left
        while len(live):
            best = r.argmin(axis=1)
            lowest = r[np.arange(len(live)), best]
            go = lowest < self.NONE
            if not go.all():
                done = ~go
                symbols[live[done], : s.shape[1]] = s[done]
                left[live[done]] = w[done]
                live, s, r, w, best, lowest = live[go], s[go], r[go], w[go], best[go], lowest[go]
                if not len(live):
                    break
                most = int(w.max())
                s, r = s[:, :most], r[:, :most]
            k, cols = np.arange(len(live)), np.arange(s.shape[1])[None, :]
            after = cols > best[:, None]
            s = np.where(after, np.concatenate((s[:, 1:], s[:, -1:]), axis=1), s)
            r = np.where(after, np.concatenate((r[:, 1:], np.full((len(live), 1), self.NONE, np.int32)), axis=1), r)
            s[k, best] = self.made[lowest]
            w = w - 1
            follows = best < w - 1
            r[k, best] = self.NONE
            f = k[follows]
            r[f, best[f]] = self.ranks(s[f, best[f]], s[f, best[f] + 1])
            b = k[best > 0]
            r[b, best[b] - 1] = self.ranks(s[b, best[b] - 1], s[b, best[b]])
        return symbols[np.arange(width)[None, :] < left[:, None]], left


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = (b for b in range(256) if b not in set(shown))
    return [chr(x) for _, x in sorted([(b, b) for b in shown] + [(b, 256 + k) for k, b in enumerate(hidden)])]


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each run, one after the other."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


class Transducer:
    """A minimal acyclic automaton over the bytes of words, with ids as outputs.

    Built from sorted words one after the other: what can no longer change is
    replaced by an equal state that already exists, so that suffixes are shared.
    Each arc carries how many words come before those that pass it, so the sum along
    a path is the word's place among all words; outputs lie there.
    """

    NAMES = ("arc_keys", "arc_slots", "arc_target", "arc_skip", "final", "out_start", "out_ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        for name in self.NAMES:
            setattr(self, name, arrays[name])
        self.arcs = HashTable(self.arc_keys, self.arc_slots)

    @classmethod
    def build(cls, outputs: dict[bytes, np.ndarray]) -> Transducer:
        words = sorted(w for w in outputs if w)
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        path: list[list] = [[False, []]]  # a state that may still change: final, [[byte, target]]

        def close(depth: int) -> None:
            while len(path) > depth:
                final, arcs = path.pop()
                key = (final, tuple(map(tuple, arcs)))
                k = register.get(key)
                if k is None:
                    k = register[key] = len(states)
                    states.append(key)
                if path:
                    path[-1][1][-1][1] = k

        before = b""
        for word in words:
            same = len(os.path.commonprefix((before, word)))
            close(same + 1)
            for byte in word[same:]:
                path[-1][1].append([byte, -1])
                path.append([False, []])
            path[-1][0] = True
            before = word
        close(1)
        close(0)
        size = [0] * len(states)
        keys, target, skip = [], [], []
        for k, (final, arcs) in enumerate(states):  # targets come before
            n = int(final)
            for byte, to in arcs:
                keys.append(k << 8 | byte)
                target.append(to)
                skip.append(n)
                n += size[to]
            size[k] = n
        ids = [np.asarray(outputs[w], np.int32) for w in words]
        arc_keys = np.array(keys, np.int64)
        return cls(
            {
                "arc_keys": arc_keys, "arc_slots": HashTable(arc_keys).slots,
                "arc_target": np.array(target, np.int32), "arc_skip": np.array(skip, np.int32),
                "final": np.array([f for f, _ in states], np.bool_),
                "out_start": np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32),
                "out_ids": np.concatenate(ids) if ids else np.empty(0, np.int32),
            }
        )

    def to_bytes(self) -> bytes:
        """Header (JSON, 8-byte length before it), then the arrays at multiples of 64."""
        head, body, at = [], [], 0
        for name in self.NAMES:
            data = np.ascontiguousarray(getattr(self, name))
            head.append([name, data.dtype.str, len(data), at])
            raw = data.tobytes() + b"\0" * (-data.nbytes % 64)
            body.append(raw)
            at += len(raw)
        text = json.dumps(head).encode()
        text += b" " * (-(len(text) + 8) % 64)
        return len(text).to_bytes(8, "little") + text + b"".join(body)

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        """Map the automaton's file; processes that map one file share its pages."""
        with open(path, "rb") as f:
            view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n = int.from_bytes(view[:8], "little")
        return cls({name: np.frombuffer(view, np.dtype(kind), count, 8 + n + at) for name, kind, count, at in json.loads(view[8 : 8 + n])})

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word among the lexicon's words, -1 for absent ones."""
        sizes = np.array([len(w) for w in words], np.int64)
        out = np.full(len(words), -1, np.int64)
        if not len(self.out_start) > 1:
            return out
        raw = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(sizes) - sizes
        live = np.flatnonzero(sizes)
        state, place = np.full(len(live), len(self.final) - 1, np.int64), np.zeros(len(live), np.int64)
        for depth in range(int(sizes.max(initial=0))):
            arc = self.arcs.find(state << 8 | raw[start[live] + depth])
            ok = arc >= 0
            live, arc = live[ok], arc[ok]
            state, place = self.arc_target[arc].astype(np.int64), place[ok] + self.arc_skip[arc]
            over = sizes[live] == depth + 1
            hit = over & self.final[state]
            out[live[hit]] = place[hit]
            live, state, place = live[~over], state[~over], place[~over]
            if not len(live):
                break
        return out


class _Numbered(dict):
    """Pieces to their numbers; a new piece gets the next one."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = k = len(self)
        self.new.append(piece)
        return k


class WordCodec:
    """Encodes texts as the tokenizers library would, word by word.

    The words met so far and their ids are remembered, at most about ``most``;
    beyond that, words met once only are forgotten.
    """

    def __init__(self, path: str, lexicon: Transducer | None = None, most: int = 1_000_000, most_pieces: int = 250_000, strings: bool = False):
        self.path, self.lexicon, self.most, self.most_pieces = path, lexicon, 200_000 if strings else most, most_pieces
        self.merges = Merges(path)
        self._library = None
        self.name = {i: t for t, i in self.merges.vocab.items()}
        self.strings = strings
        self._forget()
        self._forget_pieces()

    def _forget(self) -> None:
        self.table = WordTable(self.most)
        self.starts, self.counts, self.used = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.int32)
        self.decimal: list[str] = []
        self.shown: list[str] = []

    def _forget_pieces(self) -> None:
        self.pieces = _Numbered()
        self.piece_ids, self.piece_starts, self.piece_counts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that the lexicon lacks, one after the other, and how many each has."""
        found = _PIECE_OR_END.findall(b"\n".join(words).decode() + "\n")
        if len(self.pieces) > self.most_pieces:
            self._forget_pieces()
        if not self.pieces:
            self.pieces["\n"] = 0
            self.piece_starts = self.piece_counts = np.zeros(1, np.int64)
        numbers = np.fromiter(map(self.pieces.__getitem__, found), np.int64, len(found))
        new, self.pieces.new = self.pieces.new, []
        if new:
            flat, sizes = self._merged_pieces(new)
            self.piece_starts = np.concatenate((self.piece_starts, np.cumsum(sizes) - sizes + len(self.piece_ids)))
            self.piece_counts = np.concatenate((self.piece_counts, sizes))
            self.piece_ids = np.concatenate((self.piece_ids, flat))
        counts = self.piece_counts[numbers]
        flat = self.piece_ids[_spread(self.piece_starts[numbers], counts)]
        ends = np.cumsum(counts)[numbers == 0]
        return flat, np.diff(ends, prepend=0)

    def _merged_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = "\n".join(pieces).encode().split(b"\n")
        longs = {k: self.library.encode(pieces[k], add_special_tokens=False).ids for k, p in enumerate(raw) if len(p) > _LONG}
        for k in longs:
            raw[k] = b"x"
        flat, sizes = self.merges.merge(raw)
        if longs:
            parts = np.split(flat, np.cumsum(sizes)[:-1])
            for k, ids in longs.items():
                parts[k], sizes[k] = np.array(ids, np.int32), len(ids)
            flat = np.concatenate(parts)
        return flat, sizes

    def _of_new(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and how many each has: by the lexicon, the merges, or the library for foreign ones."""
        shown = [w.decode() for w in words]
        foreign = np.array([bool(_FOREIGN.search(x)) or any(t in x for t in _SPECIAL) for x in shown])
        words = [x.lower().encode() for x in shown]
        places = self.lexicon.places(words) if self.lexicon else np.full(len(words), -1, np.int64)
        places[foreign] = -1
        counts = np.zeros(len(words), np.int64)
        known, rest, other = np.flatnonzero(places >= 0), np.flatnonzero((places < 0) & ~foreign), np.flatnonzero(foreign)
        first = known
        if len(known):
            first = self.lexicon.out_start[places[known]].astype(np.int64)
            counts[known] = self.lexicon.out_start[places[known] + 1] - first
        flat, own = np.empty(0, np.int32), np.empty(0, np.int32)
        if len(rest):
            flat, counts[rest] = self._merged([words[k] for k in rest.tolist()])
        if len(other):
            ids = [self.library.encode(shown[k], add_special_tokens=False).ids for k in other.tolist()]
            counts[other], own = [len(x) for x in ids], np.array([i for x in ids for i in x], np.int32)
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        if len(known):
            out[_spread(starts[known], counts[known])] = self.lexicon.out_ids[_spread(first, counts[known])]
        out[_spread(starts[rest], counts[rest])] = flat
        out[_spread(starts[other], counts[other])] = own
        return out, counts

    def _learn(self, words: list[bytes], keys: Words) -> None:
        out, counts = self._of_new(words)
        starts = np.cumsum(counts) - counts
        self.starts = np.concatenate((self.starts, starts + len(self.ids)))
        self.counts = np.concatenate((self.counts, counts))
        self.used = np.concatenate((self.used, np.zeros(len(words), np.int64)))
        self.ids = np.concatenate((self.ids, out))
        self.table.add(keys.a, keys.b, keys.size)
        if self.strings:
            all_ids = out.tolist()
            for a, n in zip(starts.tolist(), counts.tolist(), strict=True):
                own_ids = all_ids[a : a + n]
                self.decimal.append(" ".join(map(str, own_ids)))
                self.shown.append(self.decode(own_ids))

    def _thin(self) -> None:
        if self.table.size <= self.most:
            return
        keep = np.flatnonzero(self.used > 1)
        if len(keep) > self.most // 2:
            keep = np.sort(keep[np.argsort(self.used[keep], kind="stable")[-(self.most // 2) :]])
        keys = self.table.a[keep], self.table.b[keep], self.table.n[keep]
        ids, counts, used, decimal, shown, starts = self.ids, self.counts, self.used, self.decimal, self.shown, self.starts
        self._forget()
        self.table.add(*keys)
        self.counts, self.used = counts[keep], used[keep] // 2
        self.ids = ids[_spread(starts[keep], self.counts)]
        self.starts = np.cumsum(self.counts) - self.counts
        if self.strings:
            self.decimal, self.shown = [decimal[k] for k in keep.tolist()], [shown[k] for k in keep.tolist()]

    def _numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, and how many words each text has."""
        self._thin()
        # case matters to the library only where a text has what the library must treat
        plain = [x if _FOREIGN.search(x) or "<|" in x else x.lower() for x in texts]
        data = "\n".join(plain).encode()
        lengths = np.array([len(x) for x in plain], np.int64)
        if len(data) != int(lengths.sum()) + max(0, len(plain) - 1):  # not ASCII
            lengths = np.array([len(x.encode()) for x in plain], np.int64)
        found = split(data)
        sizes = np.diff(np.searchsorted(found.start, np.concatenate(([0], np.cumsum(lengths + 1)))))
        h = found.hash
        numbers = self.table.find(found, h).astype(np.int64)
        missed = np.flatnonzero(numbers < 0)
        while len(missed):
            _, at = np.unique(h[missed], return_index=True)  # of words with one hash, one at a time
            new = found.take(missed[at])
            self._learn([data[a:b] for a, b in zip(new.start.tolist(), new.end.tolist(), strict=True)], new)
            numbers[missed] = self.table.find(found.take(missed), h[missed])
            missed = missed[numbers[missed] < 0]
        self.used += np.bincount(numbers, minlength=len(self.used))
        return numbers, sizes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        numbers, sizes = self._numbers(texts)
        counts = self.counts[numbers]
        flat = self.ids[_spread(self.starts[numbers], counts)]
        ends = np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], np.cumsum(sizes)))]
        return [flat[ends[k] : ends[k + 1]] for k in range(len(texts))]

    def encode_shown(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: how many ids, the ids in decimal, and the decoded text."""
        numbers, sizes = self._numbers(texts)
        counts = self.counts[numbers]
        some = counts > 0  # a word of what only Unicode counts as white space has no id
        ends = np.cumsum(sizes)
        for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
            own = numbers[a:b][some[a:b]].tolist()
            yield int(counts[a:b].sum()), " ".join([self.decimal[i] for i in own]), self.decode_words(own)

    def decode_words(self, numbers: list[int]) -> str:
        return " ".join([self.shown[i] for i in numbers])

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False): the tokens, joined by one space."""
        shown = [self.name[i] if i in self.name else self.library.id_to_token(i) for i in np.asarray(ids).tolist()]
        return " ".join([x for x in shown if x is not None])


_CODECS: dict[tuple, WordCodec] = {}


def codec(path: str, lexicon: str | None = None, strings: bool = False) -> WordCodec:
    """One codec for each Python worker, with the lexicon of that file; its memory of words serves all tasks."""
    key = (path, lexicon, strings)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = WordCodec(path, Transducer.mapped(lexicon) if lexicon else None, strings=strings)
    return _CODECS[key]


def shipped(spark: SparkSession, data: bytes) -> str:
    """Give every executor the bytes as a file (Spark copies it once to each); returns its name there."""
    folder = tempfile.mkdtemp(prefix="lexicon-")  # the driver's copy, from which Spark serves executors that come later
    name = f"{uuid.uuid4().hex}.lexicon"
    with open(os.path.join(folder, name), "wb") as f:
        f.write(data)
    spark.sparkContext.addFile(os.path.join(folder, name))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return name


def frequent_words(docs: DataFrame, most: int = 50_000, share: float = 2e-6, text: str = "text") -> list[str]:
    """The ``most`` most frequent words of all texts.

    Each partition counts all its words and reports those that make up more than
    ``share`` of them, so at most ``1 / share`` rows; a word's total is short by at
    most ``share`` of the corpus. What is chosen changes the speed, never the ids.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        total, floor = 0, 0
        for batch in slices(batches, text):
            for x in strings(batch, text):
                own = x.lower().split()
                total += len(own)
                seen.update(own)
            if len(seen) > 400_000:  # lossy counting: what is rare so far loses its count
                floor = max(floor + 1, int(total * share))
                seen = Counter({w: n for w, n in seen.items() if n > floor})
        keep = {w: n for w, n in seen.items() if n > max(1, total * share) and len(w) < 64 and not _FOREIGN.search(w)}
        yield pa.RecordBatch.from_arrays([pa.array(list(keep), pa.string()), pa.array(list(keep.values()), pa.int64())], ["word", "n"])

    found = mapped(docs.select(F.col(text).alias(text)), count, "word string, n long")
    top = found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return [r.word for r in top.select("word").collect()]  # bounded by ``most``


def build_lexicon(docs: DataFrame, path: str, most: int = 50_000, text: str = "text") -> bytes:
    """Compile the corpus's frequent words into an automaton, as the bytes of its file."""
    words = frequent_words(docs, most, text=text)
    plain = WordCodec(path)
    ids = plain.encode(words) if words else []
    return Transducer.build({w.encode(): x for w, x in zip(words, ids, strict=True)}).to_bytes()


def encode_documents(docs: DataFrame, path: str, lexicon: bytes, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: how many ids, SHA-256 of the ids in decimal, SHA-256 of the decoded text.

    A null text counts as the empty one, which has no ids; equal rows give equal rows, no row gives none.
    Only ``id_col`` and ``text`` are read, so other columns never clash.
    """
    import hashlib

    name = shipped(docs.sparkSession, lexicon)  # bounded by the lexicon's ``most`` words

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, SparkFiles.get(name), strings=True)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in slices(batches, "t"):
            rows = [(n, sha(a), sha(b)) for n, a, b in own.encode_shown(strings(batch, "t"))]
            n, ids, shown = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(shown, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = mapped(docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")), work, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
