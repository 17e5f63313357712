"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a piece of text there is exactly one token that ends its
BPE encoding. The tokens that end at a position come from an automaton over
all token byte strings (longest first); the one to keep is the first that is
compatible with the token kept for the prefix before it. Two tokens are
compatible when undoing their merges along the seam never meets a merge that
BPE would have made across it. Back-pointers from the last position give the
ids. The work is linear in the text, whatever the length of a piece.

Documents are cut into units (white space and the run after it) that the
pre-tokenizer never joins; a worker keeps the ids of units it has met, up to a
fixed number, and encodes the others.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from munjang.llm import shared

VOCABULARY = "byte_bpe_50k.json"
#: Units and pre-tokens whose ids a worker keeps in each of two generations, and the longest that it keeps.
KEPT_UNITS, KEPT_LENGTH = 400_000, 64
_UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
_OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Codec:
    """Encoder and decoder of one vocabulary file (``tokenizers`` JSON, byte-level BPE)."""

    def __init__(self, path: str, special: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in enumerate(byte_characters())}
        vocab = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]} if special else {}
        size = max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = token
        for x in spec["added_tokens"]:
            self.bytes_of[x["id"]] = x["content"].encode()
        self.decimal = [str(i) for i in range(size)]
        self.left, self.right, self.rank, self.merged = list(range(size)), list(range(size)), [-1] * size, {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = (bytes(to_byte[c] for c in x) for x in (a, b))
            i, a, b = vocab[a + b], vocab[a], vocab[b]
            if (a, b) not in self.merged:
                self.merged[a, b] = (r, i)
            if self.rank[i] < 0:
                self.left[i], self.right[i], self.rank[i] = a, b, r
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.kept: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE of the two tokens' joined bytes gives just these two: no merge across the seam comes before the merges that made them."""
        limit = 1 << 62
        rank, merged = self.rank, self.merged
        while True:
            if (m := merged.get((a, b))) is not None and m[0] < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            # The later of the two merges is undone; until it was made, the seam had its inner part. On the right side
            # an equal rank would have merged later than one across the seam, which stands to its left.
            if ra > rb:
                limit, a = min(limit, ra), self.right[a]
            else:
                limit, b = min(limit, rb + 1), self.left[b]

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token."""
        last, before, pairs = [], [], self.pairs
        done = -1
        for end, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            if end == done:
                continue
            start = end - length
            if start >= 0:
                pair = (last[start], token)
                ok = pairs.get(pair)
                if ok is None:
                    if len(pairs) >= 1_000_000:
                        pairs.clear()
                    ok = pairs[pair] = self.compatible(*pair)
                if not ok:
                    continue
            last.append(token)
            before.append(start)
            done = end
        out, at = [], len(piece) - 1
        while at >= 0:
            out.append(last[at])
            at = before[at]
        return tuple(out[::-1])

    def _unit(self, unit: str) -> tuple[int, ...]:
        """Ids of one unit; its pre-tokens are mostly ones that other units had."""
        out: list[int] = []
        for piece in self.split(unit):
            ids = self.kept.get(piece) or self.older.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode())
                if len(piece) <= KEPT_LENGTH:
                    self.kept[piece] = ids
            out += ids
        return tuple(out)

    def _plain(self, text: str) -> list[int]:
        if _OTHER_SPACE.search(text):  # runs of white space are then not cut where units are
            return list(chain.from_iterable(self.encode_piece(x.encode()) for x in self.split(text)))
        units = _UNIT.findall(text)
        if new := set(units).difference(self.kept):
            if len(self.kept) + len(new) > KEPT_UNITS:
                self.older, self.kept = self.kept, {}
                new = set(units)
            older = self.older
            known = new & older.keys()
            self.kept.update((u, older[u]) for u in known)
            long = {}
            for u in new - known:
                if len(u) <= KEPT_LENGTH:
                    self.kept[u] = self._unit(u)
                else:
                    long[u] = self._unit(u)
            if long:
                return list(chain.from_iterable([long[u] if u in long else self.kept[u] for u in units]))
        return list(chain.from_iterable(map(self.kept.__getitem__, units)))

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        if self.cut and any(x in text for x in self.special):
            out: list[int] = []
            for k, part in enumerate(self.cut.split(text)):
                out += [self.special[part]] if k % 2 else self._plain(part) if part else []
            return out
        return self._plain(text)

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str | None = None, special: bool = True) -> Codec:
    return Codec(path or public_tokenizers.path(VOCABULARY), special)


def encode_decode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null text counts as empty: no ids, and hashes of the empty string. A null
    doc_id stays null, repeated rows give repeated rows, other columns are not
    read. The decoded text is made from the ids alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for value in batch.column("text"):
                ids = c.encode(value.as_py() or "")
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
                text_hash.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return shared.texts(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
