"""Ids of whole texts by a lower-casing word-level BPE file of ``tokenizers``, a column at a time.

A text is split at white space and its distinct words are found by Arrow. A
plain word, letters and then perhaps punctuation, is encoded here: all plain
words of a slice are merged side by side in numpy, one merge of each word a
round. Any other word goes to the library as it is. Both give the library's ids.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from munjang.llm import kernels

#: Bytes of text that are worked on at a time, words that are merged at a time, longest word merged here, bases whose ids are kept.
SLICE, SIDE_BY_SIDE, LONGEST, KEPT = 4 << 20, 1 << 14, 48, 200_000
_NONE = np.int32(2**31 - 1)
#: Classes of bytes: 1 ASCII letter, 2 first byte of U+00C0 to U+00FF, 3 ASCII punctuation other than the apostrophe.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[0xC3] = 2
_CLASS[[x for x in range(33, 127) if not chr(x).isalnum() and x != ord("'")]] = 3


def gather(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of the given rows of a ragged array."""
    size = (offsets[1:] - offsets[:-1])[rows]
    ends = np.append(0, np.cumsum(size))
    at = np.arange(ends[-1]) + np.repeat(offsets[rows] - ends[:-1], size)
    return values[at], ends


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """An Arrow string column of byte ranges."""
    size = ends - starts
    offsets = np.append(0, np.cumsum(size))
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at])))


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes themselves, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(more))
        more += b not in plain
    return out


class Pairs:
    """Rank and id of mergeable pairs of ids: levels of tables, each with the pairs that met another in the level before."""

    BITS, SPREAD = 18, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407)

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray):
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        value = np.arange(len(key), dtype=np.int32)
        self.made, self.levels = made.astype(np.int32), []
        while len(key):
            bits = self.BITS + 2 * (not self.levels)
            spread = np.uint64(self.SPREAD[len(self.levels) % len(self.SPREAD)])
            place = ((key * spread) >> np.uint64(64 - bits)).astype(np.int64)
            keys, ranks = np.full(1 << bits, 2**64 - 1, np.uint64), np.full(1 << bits, _NONE)
            _, first = np.unique(place, return_index=True)
            keys[place[first]], ranks[place[first]] = key[first], value[first]
            self.levels.append((spread, np.uint64(64 - bits), keys, ranks))
            rest = np.ones(len(key), bool)
            rest[first] = False
            key, value = key[rest], value[rest]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``_NONE`` of those that don't merge or where an id is negative."""
        key = (left.astype(np.int64).view(np.uint64) << np.uint64(32)) | right.astype(np.int64).view(np.uint64)
        out = np.full(key.shape, _NONE)
        for spread, shift, keys, ranks in self.levels:
            place = ((key * spread) >> shift).astype(np.int64)
            out = np.where(keys[place] == key, ranks[place], out)
        return np.where((left < 0) | (right < 0), _NONE, out)


class WordTokens:
    """Ids of whole texts by a ``tokenizers`` file whose normalizer lower-cases and whose pre-tokenizer drops white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = np.array([vocabulary[x] for x in letters], np.int32)
        self.last = np.array([vocabulary[x + suffix] for x in letters], np.int32)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        left, right, made = (np.array([vocabulary[x] for x in side]) for side in (*zip(*pairs, strict=True), [a + b for a, b in pairs]))
        self.pairs = Pairs(left, right, made)
        self.kept, self.kept_ids, self.kept_ends = pa.array([], pa.large_string()), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def merged(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of words as byte ranges of at most ``LONGEST`` bytes: in every round each word merges its first pair of least rank."""
        width = int(size.max(initial=1))
        column = np.arange(width)
        inside = column < size[:, None]
        symbol = np.where(inside, self.inner[data[np.where(inside, starts[:, None] + column, 0)]], np.int32(-1))
        rows = np.arange(len(size))
        symbol[rows, size - 1] = self.last[data[starts + size - 1]]
        done, left_over = np.full(symbol.shape, np.int32(-1)), size.copy()
        rank = self.pairs.ranks(symbol[:, :-1], symbol[:, 1:])
        rank = np.pad(rank, ((0, 0), (0, 1)), constant_values=_NONE)
        while len(rows):
            at = rank.argmin(1)
            least = rank[np.arange(len(rows)), at]
            ready = least == _NONE
            if ready.any():
                done[rows[ready], : symbol.shape[1]] = symbol[ready]
                going = ~ready
                rows, symbol, rank, at, least = rows[going], symbol[going], rank[going], at[going], least[going]
                if not len(rows):
                    break
                width = int(left_over[rows].max())
                symbol, rank = symbol[:, :width], rank[:, :width]
            line = np.arange(len(rows))
            left_over[rows] -= 1
            shift = np.arange(width) + (np.arange(width) > at[:, None])
            shift[:, -1] = np.minimum(shift[:, -1], width - 1)
            end = shift[:, -1] == width - 1
            flat = line[:, None] * width + shift
            symbol, rank = symbol.ravel()[flat], rank.ravel()[flat]
            # The last column moved left, except where the pair was the last one.
            symbol[end, -1], rank[end, -1] = -1, _NONE
            symbol[line, at] = self.pairs.made[least]
            after = np.minimum(at + 1, width - 1)
            follower = np.where(at + 1 < width, symbol[line, after], -1)
            rank[line, at] = self.pairs.ranks(symbol[line, at], follower)
            inner = np.flatnonzero(at > 0)
            rank[inner, at[inner] - 1] = self.pairs.ranks(symbol[inner, at[inner] - 1], symbol[inner, at[inner]])
        return done[done >= 0], np.append(0, np.cumsum(left_over))

    def _library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.int32), *got]), np.append(0, np.cumsum([len(x) for x in got])).astype(np.int64)

    def _bases(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, offsets, row of each) of lower-case letter runs; those of the last slices are kept."""
        found = strings(data, starts, ends).dictionary_encode()
        words = found.dictionary
        known = pc.index_in(words, value_set=self.kept)
        new = np.flatnonzero(known.is_null().to_numpy(zero_copy_only=False))
        at = known.fill_null(0).to_numpy().astype(np.int64)
        at[new] = len(self.kept) + np.arange(len(new))
        raw, offsets = kernels.string_buffers(words.take(pa.array(new)))
        size = np.diff(offsets)
        by = np.argsort(size, kind="stable")
        parts = [(self.kept_ids, self.kept_ends)]
        for a in range(0, len(by), SIDE_BY_SIDE):
            run = by[a : a + SIDE_BY_SIDE]
            parts.append(self.merged(raw, offsets[run], size[run]))
        at[new[by]] = len(self.kept) + np.arange(len(new))
        ids = np.concatenate([x for x, _ in parts])
        ends = np.append(0, np.cumsum(np.concatenate([np.diff(x) for _, x in parts])))
        # The words of this slice stay, and as many of the others as there is room for.
        other = np.ones(len(self.kept), bool)
        other[at[at < len(self.kept)]] = False
        stay = np.append(at, np.flatnonzero(other))[:KEPT]
        self.kept = pa.concat_arrays([words, self.kept.filter(pa.array(other))]).slice(0, KEPT)
        self.kept_ids, self.kept_ends = gather(ids, ends, stay)
        return ids, ends, at[found.indices.to_numpy()]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of distinct words."""
        data, offsets = kernels.string_buffers(words)
        lower = data + np.uint8(32) * ((data >= 65) & (data <= 90))
        kind = _CLASS[data]
        second = np.append(False, kind[:-1] == 2) & (data >= 0x80) & (data < 0xC0) & (data != 0x97) & (data != 0xB7)
        lower += np.uint8(32) * (second & (data < 0x9F))
        letter = (kind == 1) | second
        letter[:-1] |= (kind[:-1] == 2) & second[1:]
        mark = kind == 3
        starts, ends = offsets[:-1], offsets[1:]
        other = np.append(np.flatnonzero(~letter), len(data))
        cut = np.minimum(other[np.searchsorted(other, starts)], ends)
        marks = np.append(0, np.cumsum(mark))
        plain = (cut > starts) & (marks[ends] - marks[cut] == ends - cut) & (cut - starts <= LONGEST)
        odd = np.flatnonzero(~plain & (ends > starts))
        plain = np.flatnonzero(plain)
        # Rows of one ragged array: nothing, bases, tails, odd words.
        base_ids, base_ends, base_row = self._bases(lower, starts[plain], cut[plain])
        tails = strings(data, cut[plain], ends[plain]).dictionary_encode()
        tail_ids, tail_ends = self._library(tails.dictionary.to_pylist())
        odd_ids, odd_ends = self._library(words.take(pa.array(odd)).to_pylist())
        ids = np.concatenate([base_ids, tail_ids, odd_ids])
        ends = np.append(0, np.cumsum(np.concatenate([[0], np.diff(base_ends), np.diff(tail_ends), np.diff(odd_ends)])))
        first, second = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        first[plain], second[plain] = 1 + base_row, len(base_ends) + tails.indices.to_numpy()
        first[odd] = len(base_ends) + len(tail_ends) - 1 + np.arange(len(odd))
        got, ends = gather(ids, ends.astype(np.int64), np.stack([first, second], 1).ravel())
        return got, ends[::2]

    def columns(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, offsets) of runs of whole texts, in order; a null text has no ids."""
        column = pc.fill_null(column, "").cast(pa.large_string())
        for lo, hi in kernels.slices(kernels.string_buffers(column)[1], SLICE):
            split = pc.ascii_split_whitespace(column.slice(lo, hi - lo))
            found = split.flatten().dictionary_encode()
            ids, ends = gather(*self._words(found.dictionary), found.indices.to_numpy())
            at = split.offsets.to_numpy()
            yield ids, ends[at - at[0]]

    def encode(self, text: str) -> bytes:
        """Ids of one text as little-endian uint32."""
        return b"".join(ids.astype("<u4").tobytes() for ids, _ in self.columns(pa.array([text], pa.large_string())))
